"""SimHash near-duplicate groups by pivot distance tables.

A fingerprint has a bit for each bit that more than half of a text's shingle
hashes (XXH64, seed 42) set; fingerprints link when at most ``RADIUS`` bits
differ. For each fingerprint the distances to ``PIVOTS`` reference fingerprints
are tabulated; by the triangle inequality a pair whose coordinates differ by
more than ``RADIUS`` anywhere can't link, so it is discarded, and survivors are
verified by their own distance. Comparing every pair of a corpus against its
pivots would be quadratic, so the table is built per bucket: of ``BLOCKS`` bit
blocks, two fingerprints within ``RADIUS`` share at least ``BLOCKS - RADIUS``
whole, hence a bucket for each choice of that many blocks holds every link.

Exact copies collapse to one fingerprint first. Keys that hold more than a
``HOT_KEYS`` part of a join's rows (hub fingerprints, roots of large groups, much copied
texts) are joined by broadcast, of ``HOT_KEYS`` rows at most, and the others by shuffle. A bucket above ``TILE``
fingerprints is cut into tiles whose pairs together are all its pairs, so no
task holds an unbounded bucket. A task reports a spanning forest of the links it
finds, never all pairs; components then come from alternating star contraction.

Defined results: null, empty and blank texts have fingerprint zero and link as
any other; texts of fewer than four words are one shingle; repeated rows are one
group; the component id is the smallest id that can be reached.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import as_bytes, cut_lineage, map_slices, with_fields

SHINGLE = 4
SEED = 42
RADIUS = 4
BLOCKS = 6
PIVOTS = 32
TILE = 8192
#: A key is hot if it has more rows than this, and more than one in ``HOT_KEYS`` of all; so at most ``HOT_KEYS`` keys are.
HOT_ROWS, HOT_KEYS = 100, 1024
_HASHES_AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a whole text."""
    words = (text or b"").lower().split()  # of bytes: ASCII letters and ASCII white space
    n = len(words) - shingle + 1
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    votes = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, _HASHES_AT_ONCE):
        hi = min(n, lo + _HASHES_AT_ONCE)
        pairs = zip(starts[lo:hi].tolist(), ends[lo + shingle - 1 : hi + shingle - 1].tolist(), strict=True)
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in pairs), dtype="<u8", count=hi - lo)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in as_bytes(part.column("text"))], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    return map_slices(source, run, with_fields([source.schema["id"]], "fp long"))


def _pivots(n: int) -> np.ndarray:
    return np.random.default_rng(1234).integers(0, 1 << 64, size=n, dtype=np.uint64)


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances, a row per fingerprint and a column per pivot."""
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)


def _survivors(table: np.ndarray, fps: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (a, b) link: discarded by coordinates, eight pivots at a time, then verified."""
    kept = np.arange(len(a))
    for p in range(0, table.shape[1], 8):
        if not len(kept):
            return kept
        gap = np.abs(table[a[kept], p : p + 8] - table[b[kept], p : p + 8]).max(axis=1)
        kept = kept[gap <= radius]
    return kept[np.bitwise_count(fps[a[kept]] ^ fps[b[kept]]) <= radius]


def bucket_links(keys: np.ndarray, fps: np.ndarray, pivots: np.ndarray, radius: int = RADIUS, small: int = 48):
    """Spanning links within runs of equal keys (rows sorted by key). Yields arrays (a, b) of fingerprints."""
    if not len(fps):
        return
    table = pivot_table(fps, pivots)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, len(keys)))
    of_small = np.repeat(sizes <= small, sizes)
    left = np.repeat(starts + sizes, sizes)  # where the run of a row ends
    at = np.flatnonzero(of_small)
    for step in range(1, small):
        at = at[at + step < left[at]]
        if not len(at):
            break
        hit = at[_survivors(table, fps, at, at + step, radius)]
        yield fps[hit], fps[hit + step]
    for start, size in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        rest = np.arange(start, start + size)
        queue: list[int] = []
        a, b = [], []
        while len(rest) or queue:  # each row meets the rows that no row before it has reached
            if not queue:
                queue, rest = [int(rest[0])], rest[1:]
            x = queue.pop()
            got = _survivors(table, fps, np.full(len(rest), x), rest, radius)
            if len(got):
                a += [x] * len(got)
                b += rest[got].tolist()
                queue += rest[got].tolist()
                rest = np.delete(rest, got)
        if a:
            yield fps[np.array(a)], fps[np.array(b)]


def _masks(blocks: int, radius: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(c) for c in combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, pivots: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """(a, b): links whose closure joins all distinct fingerprints (column ``fp``) within ``radius`` of each other."""
    entries = F.explode(F.array(*[F.struct(F.lit(i).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks(blocks, radius))]))
    rows = distinct.select("fp", entries.alias("e")).select("e.t", "e.key", "fp")
    large = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    cuts = F.when(F.col("n").isNull(), F.lit(1)).otherwise(F.ceil(F.col("n") / tile).cast("int"))
    rows = rows.join(large, ["t", "key"], "left").withColumn("cuts", cuts)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    rows = rows.select("t", "key", "fp", F.explode(tiles).alias("x"))
    rows = rows.select(F.xxhash64("t", "key", "x.i", "x.j").alias("k"), "fp").repartition("k").sortWithinPartitions("k")
    refs = _pivots(pivots)

    def run(batches):
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            held_k = np.append(held_k, batch.column(0).to_numpy())
            held_f = np.append(held_f, batch.column(1).to_numpy())
            if not len(held_k):
                continue
            whole = np.searchsorted(held_k, held_k[-1])  # the last run may go on
            for a, b in bucket_links(held_k[:whole], held_f[:whole].view(np.uint64), refs, radius):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
            held_k, held_f = held_k[whole:], held_f[whole:]
        for a, b in bucket_links(held_k, held_f.view(np.uint64), refs, radius):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _hot(counts: DataFrame, key: str, n: str = "n") -> list:
    """The hot keys of a table of a count per key."""
    total, most = counts.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    bound = max(HOT_ROWS, total // HOT_KEYS)
    return [r[0] for r in counts.where(F.col(n) > bound).select(key).collect()] if most > bound else []


def _join_by_key(rows: DataFrame, one: DataFrame, key: str, hot: list) -> DataFrame:
    """``rows`` joined with ``one`` row a key; ``hot`` keys by broadcast."""
    if not hot:
        return rows.join(one, key)
    is_hot = F.col(key).isin(hot)
    return rows.where(is_hot).join(F.broadcast(one.where(is_hot)), key).unionByName(rows.where(~is_hot).join(one.where(~is_hot), key))


def _with_least(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``rows`` with the least value of their key as column ``name``."""
    hot = _hot(rows.groupBy(key).agg(F.count("*").alias("n")), key)
    return _join_by_key(rows, rows.groupBy(key).agg(F.min(value).alias(name)), key, hot)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of an edge list (a, b) reaches, itself included.

    Large-star and small-star steps alternate until the edges are stars; each step is
    checkpointed. Raises if ``max_rounds`` rounds don't settle it, which needs a chain of
    about 2 ** max_rounds links."""
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(max_rounds):
        both = _with_least(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "a", "b", "m")
        large = cut_lineage(both.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct())
        small = _with_least(large, "a", "b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(small.unionByName(large.groupBy("a").agg(F.min("b").alias("b"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, blocks: int = BLOCKS, pivots: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """(id, fp, component): each row's fingerprint and the smallest id of its group."""
    prints = cut_lineage(fingerprints(docs, id_col, text_col))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    roots = components(links(distinct.select("fp"), radius, blocks, pivots, tile))
    labelled = cut_lineage(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", "root"))
    grouped = _with_least(labelled.where("root is not null"), "root", "first", "component")
    of_print = grouped.select("fp", "component").unionByName(labelled.where("root is null").select("fp", F.col("first").alias("component")))
    return _join_by_key(prints, of_print, "fp", _hot(distinct, "fp")).select("id", "fp", "component")


def fingerprint_hex(column):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def group_report(docs: DataFrame) -> DataFrame:
    """The digest of ``near_duplicates`` per document row."""
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), fingerprint_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, and of its texts that of the smallest hash.

    A row is known by its id and a hash of its text, so repeated rows stay once, and an id with
    two texts stands for each of them apart. A group without any id keeps one row, too. Texts are
    shuffled once: the join on the key and the removal of repeated rows share their partitioning.
    Rows that are repeated so often that their key is hot are reduced before they are shuffled."""
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    row = F.struct(own.isNull().alias("unnamed"), own.alias("id"), F.xxhash64(text).alias("hash"))
    keyed = docs.withColumn("__row", row).withColumn("__known", F.xxhash64("__row"))
    found = near_duplicates(keyed, "__row", text_col).where("id = component")
    keep = cut_lineage(found.groupBy(F.col("id").alias("__keep")).agg(F.count("*").alias("n")))
    hot = _hot(keep.select(F.xxhash64("__keep").alias("known"), "n"), "known")
    is_hot = F.col("__known").isin(hot) if hot else F.lit(False)
    of_row = F.col("__row") == F.col("__keep")
    kept = keyed.where(~is_hot).join(keep, of_row, "left_semi").dropDuplicates(["__row"])
    if hot:
        few = keep.where(F.xxhash64("__keep").isin(hot))
        kept = kept.unionByName(keyed.where(is_hot).join(F.broadcast(few), of_row, "left_semi").dropDuplicates(["__row"]))
    return kept.drop("__row", "__known")
