"""Benchmark decontamination with a broadcast set of normalised test n-grams.

Words are runs of ASCII letters and digits (lower-cased) and of any non-ASCII
characters. A window is ``WINDOW`` consecutive words of a benchmark item; an
item of fewer words, but not none, is one window. The scan finds possible
windows by a rolling hash over word ids and verifies each by its words.

What is broadcast is bounded: windows are kept as arrays, some 40 bytes for a word
of theirs and the distinct words besides, and are of ``BROADCAST_WORDS`` words at most. A
larger benchmark is first cut down to the windows that occur in the documents at
all: a bit table of window hashes, of ``FILTER_BITS`` at most, goes to a scan that
gives the distinct windows which may be of the benchmark, and a join by their words
keeps those that are. What is left is broadcast in blocks, a pass over the documents each,
mostly one. Neither texts nor hits are shuffled on either way, only distinct windows.

Defined results: a null or empty text has no words and no hit; an item with
null text has no window; an item with a null id counts under the empty id;
equal items each count; repeated document rows are judged one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import as_bytes, cut_lineage, map_slices, slices, with_fields

WINDOW = 13
#: Words of windows that are broadcast at once; each word of an item opens a window at most.
BROADCAST_WORDS = 1_000_000
#: Bits of the table of window hashes: 32 MB. Beyond a sixteenth as many windows more documents' windows pass it, in vain.
FILTER_BITS = 1 << 28

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_SPANS = "spans array<struct<start:long,end:long>>"
_SCHEMA = "n_words long, n_hit long, items array<string>, " + _SPANS


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_NORMAL).split()


class WindowSet:
    """Distinct windows as arrays of word ids, by length, with sorted hashes to find them and the items they are of."""

    def __init__(self, windows: list[tuple[str, list[bytes]]]):
        """``windows`` are (item, words)."""
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in windows})
        number = {item: i for i, item in enumerate(self.items)}
        longest = max((len(words) for _, words in windows), default=0)
        self.factors = _factors(longest)
        by_length: dict[int, tuple[list, list]] = {}
        for item, words in windows:
            ids, owners = by_length.setdefault(len(words), ([], []))
            ids.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
            owners.append(number[item])
        #: By length: hashes in order, the windows' ids, where their owners begin, owners.
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, (ids, owners) in by_length.items():
            distinct, which = np.unique(np.array(ids, dtype=np.uint32), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.array(owners)], axis=1), axis=0)
            hashes = _window_hashes(distinct.astype(np.uint64), self.factors)
            order = np.argsort(hashes, kind="stable")
            counts = np.bincount(pairs[:, 0], minlength=len(distinct))
            own = np.split(pairs[:, 1].astype(np.int32), np.cumsum(counts)[:-1])
            self.tables[k] = hashes[order], distinct[order], np.append(0, np.cumsum(counts[order])), np.concatenate([own[i] for i in order])

    @classmethod
    def of_items(cls, items: list[tuple[str, bytes | None]], window: int = WINDOW) -> WindowSet:
        return cls([(item, words) for item, text in items for words in windows_of(text, window)])

    def scan(self, texts: list[bytes | None], before: list[tuple[list[str], list[dict]]] | None = None) -> tuple[list[int], list[int], list[list[str]], list[list[dict]]]:
        """Words, hit words, items and spans of each text, added to the items and spans found ``before``."""
        words: list[bytes] = []
        starts = []
        for t in texts:
            starts.append(len(words))
            words += words_of(t)
            words.append(b"")  # no window spans two texts
        starts = np.array([*starts, len(words)], dtype=np.int64)
        find = self.vocabulary.get
        ids = np.fromiter((find(w, 0) for w in words), dtype=np.uint64, count=len(words))
        gaps = np.flatnonzero(ids == 0)
        position = np.arange(len(ids))
        run = np.append(gaps, len(ids))[np.searchsorted(gaps, position)] - position  # known words from here on
        delta = np.zeros(len(ids) + 1, dtype=np.int64)
        found: dict[int, set[str]] = {}
        for d, (items, spans) in enumerate(before or ()):
            if items:
                found[d] = set(items)
            for s in spans:
                delta[starts[d] + s["start"]] += 1
                delta[starts[d] + s["end"]] -= 1
        for k, (hashes, windows, bounds, owners) in self.tables.items():
            at = np.flatnonzero(run >= k)
            if not len(at):
                continue
            h = np.zeros(len(at), dtype=np.uint64)
            for j in range(k):
                h += ids[at + j] * self.factors[j]
            first = np.searchsorted(hashes, h)
            while True:  # windows whose hashes are alike are tried one after another
                some = np.flatnonzero(hashes[np.minimum(first, len(hashes) - 1)] == h) if len(at) else at
                some = some[first[some] < len(hashes)]
                if not len(some):
                    break
                at, h, first = at[some], h[some], first[some]
                same = (ids[at[:, None] + np.arange(k)] == windows[first]).all(axis=1)
                hit, which = at[same], first[same]
                np.add.at(delta, hit, 1)
                np.add.at(delta, hit + k, -1)
                docs = np.searchsorted(starts, hit, side="right") - 1
                for d, w in np.unique(np.stack([docs, which], axis=1), axis=0).tolist():
                    found.setdefault(d, set()).update(self.items[o] for o in owners[bounds[w] : bounds[w + 1]].tolist())
                at, h, first = at[~same], h[~same], first[~same] + 1
        hit = np.cumsum(delta[:-1]) > 0
        counted = np.append(0, np.cumsum(hit))
        n_words = (np.diff(starts) - 1).tolist()
        n_hit = (counted[starts[1:]] - counted[starts[:-1]]).tolist()
        items = [sorted(found.get(d, ())) for d in range(len(texts))]
        spans: list[list[dict]] = [[] for _ in texts]
        for d in found:
            own = np.flatnonzero(np.diff(np.concatenate(([0], hit[starts[d] : starts[d + 1]].astype(np.int8), [0]))))
            spans[d] = [{"start": int(a), "end": int(b)} for a, b in own.reshape(-1, 2)]
        return n_words, n_hit, items, spans


def windows_of(text: bytes | None, window: int = WINDOW) -> list[list[bytes]]:
    words = words_of(text)
    k = min(window, len(words))
    return [words[i : i + k] for i in range(len(words) - k + 1)] if k else []


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, size=n, dtype=np.uint64) | np.uint64(1)


def _window_hashes(ids: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return (ids * factors[: ids.shape[1]]).sum(axis=1, dtype=np.uint64)


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text")
    )


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """Per document row: id, text, ``n_words``, ``n_hit``, ``items`` (sorted) and word ``spans`` of hits."""
    items = _items(benchmark, item_col, item_text_col)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.size(_word_array(F.coalesce("text", F.lit(""))))), F.lit(0))).first()[0]
    if total <= broadcast_words:
        sets = [WindowSet.of_items([(r.item, None if r.text is None else r.text.encode()) for r in items.collect()], window)]
    else:
        sets = _occurring(source, items, window, broadcast_words)
    none = F.array()
    found = source.withColumns({"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "items": none.cast("array<string>"), "spans": none.cast(_SPANS.partition(" ")[2])})
    for own in sets:
        found = _scanned(found, own)
    return found


def _scanned(found: DataFrame, own: WindowSet) -> DataFrame:
    """``found`` with what a set of windows adds to it."""
    windows = found.sparkSession.sparkContext.broadcast(own)

    def scan(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text")
        before = list(zip(part.column("items").to_pylist(), part.column("spans").to_pylist(), strict=True))
        n_words, n_hit, items, spans = windows.value.scan(as_bytes(texts), before)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [part.column("id"), texts, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, kind)],
            ["id", "text", "n_words", "n_hit", "items", "spans"],
        )

    return map_slices(found, scan, with_fields(found.schema.fields[:2], _SCHEMA))


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """Three places in a bit table of ``size`` (a power of two) for each hash."""
    with np.errstate(over="ignore"):
        mixed = [(hashes ^ (hashes >> np.uint64(31))) * np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    return np.stack([m >> np.uint64(64 - size.bit_length() + 1) for m in mixed]).astype(np.int64)


def _occurring(source: DataFrame, items: DataFrame, window: int, broadcast_words: int) -> list[WindowSet]:
    """The benchmark's windows that occur in the documents, in sets of bounded size; each is of all its items."""
    spark, factors = source.sparkSession, _factors(window)

    def word_hashes(words: list[bytes]) -> np.ndarray:
        known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
        return np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(item, len(w), b" ".join(w), int(_window_hashes(word_hashes(w)[None, :], factors)[0])) for item, text in zip(part.column("item").to_pylist(), as_bytes(part.column("text")), strict=True) for w in windows_of(text, window)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(np.array(columns[3], dtype=np.uint64).view(np.int64))], ["item", "k", "window", "hash"])

    tests = cut_lineage(map_slices(items, cut, "item string, k int, window binary, hash long").distinct())
    lengths = [r.k for r in tests.select("k").distinct().collect()]  # ``window`` at most
    size = min(FILTER_BITS, 1 << max(10, int(16 * tests.count()).bit_length()))

    def places(batches):
        for batch in batches:
            at = np.unique(_bits(batch.column(0).to_numpy().view(np.uint64), size))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "mask"])

    words = tests.select("hash").mapInArrow(places, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # ``size`` bits at most
    table = np.zeros(size >> 6, dtype=np.int64)
    table[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    held = spark.sparkContext.broadcast(table)

    def candidates(batches):
        for part in slices(batches):
            bits, seen = held.value, set()
            for text in as_bytes(part.column("text")):
                own = words_of(text)
                hashes = word_hashes(own)
                for k in lengths:
                    n = len(own) - k + 1
                    if n <= 0:
                        continue
                    h = np.zeros(n, dtype=np.uint64)
                    for j in range(k):
                        h += hashes[j : j + n] * factors[j]
                    at = _bits(h, size)
                    passed = ((bits[at >> 6] >> (at & 63)) & 1).all(axis=0)
                    seen.update((k, b" ".join(own[i : i + k])) for i in np.flatnonzero(passed).tolist())
            for lo in range(0, len(rows := sorted(seen)), 4096):
                at_once = rows[lo : lo + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in at_once], pa.int32()), pa.array([w for _, w in at_once], pa.binary())], ["k", "window"])

    there = source.select("text").mapInArrow(candidates, "k int, window binary").distinct()
    hits = cut_lineage(tests.join(there, ["k", "window"], "left_semi").select("item", "k", "window"))
    blocks = max(1, -(-2 * hits.count() // broadcast_words))  # of half the size, so that none is too large
    in_block = F.pmod(F.xxhash64("window"), F.lit(blocks))
    return [WindowSet([(r.item, bytes(r.window).split(b" ")) for r in hits.where(in_block == b).collect()]) for b in range(blocks)]


def _word_array(column):
    lowered = F.translate(column, _UPPER, _UPPER.lower())
    return F.filter(F.split(F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " "), lambda w: w != "")


def is_contaminated():
    """At least a twentieth of the words are hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def overlap_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of ``find_overlaps`` per document row."""
    return find_overlaps(docs, benchmark).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows; all its columns, whatever their names, stay as they are."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("id"), F.col(text_col).alias("text"))
    kept = find_overlaps(packed, benchmark, "id", "text").where(~is_contaminated())
    return kept.select("id.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with every hit word of every text taken out; words keep their order, separators become one space
    in texts that change, and texts without a hit stay as they are."""
    found = find_overlaps(docs, benchmark, id_col, text_col)
    words = _word_array(F.coalesce("text", F.lit("")))
    left = F.filter(words, lambda w, i: ~F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    return found.select(F.col("id").alias(id_col), F.when(F.col("n_hit") > 0, F.array_join(left, " ")).otherwise(F.col("text")).alias(text_col))


REPORT_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT dw.rid, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
own AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN own USING (rid)
"""
