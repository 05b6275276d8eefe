"""LM scoring by cross-entropy difference.

Two bigram models over the pieces of one fixed public vocabulary, alike in order
and smoothing, are counted over whole texts: a target model from the rows that
the target marks, a background model from all rows. A document's score is its
mean per-token loss under the target model less that under the background
model; lower is more like the target.

Counts are of every bigram of every document: summed per task, then by Spark per
bigram. The losses of the most frequent bigrams, ``BROADCAST_BIGRAMS`` at most, are
broadcast, and a text is scored by them in one pass, which also gives its rarer
bigrams. Those alone are shuffled, joined with their losses and added; none of them
is a hot key, for the frequent ones never move. Where all bigrams are few enough
there is nothing to join. ``novelty`` is the share of a text's tokens whose bigram
occurs once in the whole corpus.

Smoothing is absolute discounting, the discounted mass going to the piece's
share of all pieces, mixed with an even share so that nothing is impossible.

Defined results: a null or empty text has no token and all figures zero; a null
mark isn't target; without target rows the target model is even over the
vocabulary; repeated rows count and are scored each for itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import Remembered, cut_lineage, map_slices, slices, spell, with_fields

VOCABULARY = "piece_bpe_32k.model"
DISCOUNT = 0.75
EVEN = 0.01
#: 20 bytes each.
BROADCAST_BIGRAMS = 2_000_000
#: Steps in which the frequency that bigrams are broadcast from is chosen, to each doubling.
STEPS = 16
REMEMBERED = 450_000
#: A word and the ASCII signs at its end.
_CUT = r"(?s)^(?P<root>.*[^!-/:-@\[-`{-~])(?P<signs>[!-/:-@\[-`{-~]+)$"
#: Rows and text bytes worked on at once: bigrams that they share are looked up once.
AT_ONCE_ROWS, AT_ONCE_BYTES = 2000, 8 << 20
#: Labelled ids up to which the labels are broadcast to the texts. Beyond it both are shuffled.
BROADCAST_LABELS = 1_000_000
#: Distinct bigrams that a task holds before it hands them on.
HELD = 2_000_000


def vocabulary_bytes(path: str | None = None) -> bytes:
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return f.read()


class Pieces:
    """Piece ids of texts, word by word with a memory.

    Words are runs without ASCII white space; ASCII signs at a word's end are words of their own."""

    def __init__(self, vocabulary: bytes, remembered: int = REMEMBERED):
        self.vocabulary, self.remembered = vocabulary, remembered
        self._model = None

    def __getstate__(self):
        return self.vocabulary, self.remembered

    def __setstate__(self, state):
        self.__init__(*state)

    @property
    def model(self):
        if self._model is None:
            import sentencepiece

            self._model = sentencepiece.SentencePieceProcessor(model_proto=self.vocabulary)
            self._known = Remembered(self.remembered)
        return self._model

    @property
    def size(self) -> int:
        return self.model.get_piece_size()

    def _units(self, units: list[str]) -> list[bytes]:
        wanted = set(units)
        out = self._known.take(wanted)
        new = list(wanted.difference(out))
        ids = self.model.encode(new, num_threads=1)
        made = {u: np.array(own, dtype=self.kind).tobytes() for u, own in zip(new, ids, strict=True)}
        self._known.put(made)
        out.update(made)
        return [out[u] for u in units]

    @property
    def kind(self) -> np.dtype:
        return np.dtype("<u2" if self.size <= 1 << 16 else "<u4")

    def bigrams(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``before * (size + 1) + piece`` of each token of the texts, and where each text's begin; ``size``
        stands before a text's first."""
        size = self.size
        ids, bounds = spell(pc.fill_null(texts, ""), _CUT, self._units, self.kind)
        ids = ids.astype(np.int64)
        before = np.append(size, ids[:-1]) if len(ids) else ids
        before[bounds[:-1][np.diff(bounds) > 0]] = size
        return before * (size + 1) + ids, bounds


def count(docs: DataFrame, pieces, text_col: str = "text", mark_col: str = "target") -> DataFrame:
    """(key, target, background): how often each bigram occurs in marked rows and in all rows."""
    source = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(mark_col), F.lit(False)).alias("mark"))

    def run(batches):
        keys, target, total, pending = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), []

        def merge():
            nonlocal keys, target, total
            all_keys = np.concatenate([keys, *(p[0] for p in pending)])
            keys, place = np.unique(all_keys, return_inverse=True)
            target = np.bincount(place, weights=np.concatenate([target, *(p[1] for p in pending)])).astype(np.int64)
            total = np.bincount(place, weights=np.concatenate([total, *(p[2] for p in pending)])).astype(np.int64)
            pending.clear()

        def out():
            for lo in range(0, len(keys), 100_000):
                at = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(target[at]), pa.array(total[at])], ["key", "target", "background"])

        for part in slices(batches, rows=AT_ONCE_ROWS, size=AT_ONCE_BYTES):
            own, bounds = pieces.value.bigrams(part.column("text"))
            marks = np.repeat(part.column("mark").to_numpy(zero_copy_only=False).astype(bool), np.diff(bounds))
            for marked in (True, False):
                k, n = np.unique(own[marks == marked], return_counts=True)
                pending.append((k, n if marked else np.zeros_like(n), n))
            if sum(len(p[0]) for p in pending) > HELD // 4:
                merge()
            if len(keys) > HELD:
                yield from out()
                keys, target, total = keys[:0], target[:0], total[:0]
        if pending:
            merge()
        yield from out()

    found = source.mapInArrow(run, "key long, target long, background long")
    return found.groupBy("key").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def losses(counts: DataFrame, size: int, discount: float = DISCOUNT, even: float = EVEN) -> DataFrame:
    """(key, background, target_loss, background_loss, once) of each counted bigram, in nats; ``once`` is 1 or 0.

    Sums by piece are bounded by the vocabulary and joined back by Spark."""
    before, piece = F.floor(F.col("key") / F.lit(size + 1)).cast("int"), (F.col("key") % F.lit(size + 1)).cast("int")
    rows = counts.withColumns({"before": before, "piece": piece})
    names = ("target", "background")
    contexts = rows.groupBy("before").agg(*[f.alias(f"{k}_{n}") for n in names for k, f in (("sum", F.sum(n)), ("kinds", F.count_if(F.col(n) > 0)))])
    singles = rows.groupBy("piece").agg(*[F.sum(n).alias(f"own_{n}") for n in names])
    totals = rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first()
    joined = rows.join(F.broadcast(contexts), "before").join(F.broadcast(singles), "piece")  # a row per piece at most
    made = []
    for n in names:
        base = (F.col(f"own_{n}") / F.lit(float(max(1, totals[n]))) * (1 - even) + even / size) if totals[n] else F.lit(1.0 / size)
        sums = F.col(f"sum_{n}")
        p = F.when(sums > 0, F.greatest(F.col(n) - discount, F.lit(0.0)) / sums + discount * F.col(f"kinds_{n}") / sums * base).otherwise(base)
        made.append((-F.log(p)).cast("float").alias(f"{n}_loss"))
    return joined.select("key", "background", *made, (F.col("background") == 1).cast("float").alias("once"))


_SUMS = ("target_loss", "background_loss", "once")


def _frequent(table: DataFrame, bound: int) -> DataFrame:
    """Which rows of ``losses`` are broadcast, as a condition: ``bound`` at most, the most frequent ones, by steps of frequency."""
    step = F.floor(F.log2("background") * STEPS).cast("int")
    left, least = bound, None
    for r in table.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # of 64 doublings at most
        left -= r.n
        if left < 0:
            break
        least = r.step
    return F.lit(False) if least is None else step >= least


def score(docs: DataFrame, mark_col: str = "target", id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, broadcast_bigrams: int = BROADCAST_BIGRAMS) -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, novelty, score) of every row; ``mark_col`` marks target rows."""
    spark = docs.sparkSession
    pieces = Pieces(vocabulary_bytes(vocabulary))
    size = pieces.size
    held = spark.sparkContext.broadcast(pieces)
    table = cut_lineage(losses(cut_lineage(count(docs, held, text_col, mark_col)), size))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = with_fields([source.schema["id"]], "n_tokens long, target_loss double, background_loss double, once double, keys array<long>, times array<int>")
    frequent = _frequent(table, broadcast_bigrams)
    got = table.where(frequent).select("key", *_SUMS).toArrow().sort_by("key")
    known = spark.sparkContext.broadcast((got.column("key").to_numpy(), np.stack([got.column(c).to_numpy() for c in _SUMS], axis=1)))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        keys, values = known.value
        own, bounds = held.value.bigrams(part.column("text"))
        sizes = np.diff(bounds)
        rows = part.num_rows
        kinds, place = np.unique(own, return_inverse=True)
        at = np.minimum(np.searchsorted(keys, kinds), max(0, len(keys) - 1))
        found = keys[at] == kinds if len(keys) else np.zeros(len(kinds), dtype=bool)
        terms = np.where(found[:, None], values[at].astype(np.float64), 0.0)[place] if len(keys) else np.zeros((len(own), 3))
        row = np.repeat(np.arange(rows), sizes)
        sums = [np.bincount(row, weights=terms[:, i], minlength=rows) for i in range(3)]
        rare = np.flatnonzero(~found[place])
        pairs, times = np.unique(row[rare] * max(1, len(kinds)) + place[rare], return_counts=True)
        starts = np.searchsorted(pairs, np.arange(rows + 1) * max(1, len(kinds)))
        lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), v) for v in (pa.array(kinds[pairs % max(1, len(kinds))] if len(kinds) else kinds), pa.array(times.astype(np.int32)))]
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes), *[pa.array(x, pa.float64()) for x in sums], *lists], schema.names)

    scored = map_slices(source, run, schema, rows=AT_ONCE_ROWS, size=AT_ONCE_BYTES)
    rest = table.where(~frequent)
    if rest.isEmpty():
        sums = scored
    else:
        scored = cut_lineage(scored.withColumn("row", F.monotonically_increasing_id()))
        pairs = scored.select("row", F.explode(F.arrays_zip("keys", "times")).alias("e")).select("row", F.col("e.keys").alias("key"), F.col("e.times").alias("n"))
        more = pairs.join(rest.select("key", *_SUMS), "key").groupBy("row").agg(*[F.sum(F.col(c).cast("double") * F.col("n")).alias("more_" + c) for c in _SUMS])
        sums = scored.join(more, "row", "left").withColumns({c: F.col(c) + F.coalesce("more_" + c, F.lit(0.0)) for c in _SUMS})
    mean = [(F.col(c) / F.greatest("n_tokens", F.lit(1))).alias(name) for c, name in zip(_SUMS, ("target_loss", "background_loss", "novelty"), strict=True)]
    return sums.select("id", "n_tokens", *mean).withColumn("score", F.col("target_loss") - F.col("background_loss"))


def mark_targets(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """(doc_id, text, target): documents labelled good and not toxic are the target.

    The ids of targets go to the texts while they are few, so that texts needn't move."""
    good = labels.groupBy(F.col(id_col).alias("l_id")).agg(F.max("quality").alias("q"), F.coalesce(F.max("toxic"), F.lit(0)).alias("t"))
    ids = good.where((F.col("q") == 1) & (F.col("t") == 0) & F.col("l_id").isNotNull()).select("l_id", F.lit(True).alias("target"))
    ids = ids.hint("broadcast" if ids.count() <= broadcast_labels else "merge")
    return docs.select(id_col, "text").join(ids, F.col(id_col) == F.col("l_id"), "left").select(id_col, "text", F.coalesce("target", F.lit(False)).alias("target"))


def lm_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The figures of ``score`` per document row, for the target of ``mark_targets``."""
    return score(mark_targets(docs, labels)).withColumnRenamed("id", "doc_id")
