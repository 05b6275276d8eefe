"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL.

A text's words (runs without white space), and the marks around them (case,
adjoining signs), give hashed unigrams and bigrams, and a bigram for a word that
repeats the one before it. A score is the sparse dot product of their unit-length
counts with the weights.

Training takes a bounded sample of about ``SAMPLE`` labelled rows, chosen by a
hash of the id, and of those, in the order of the hash, as many as have
``ENTRIES`` distinct features together; features are made on executors, and the
driver updates the weights row by row in that order.

The bias is the log odds of the labels trained on, so a text of a word or two, which
tells little, scores near the labels' share.

Defined results: null and empty texts have no features and score the bias alone;
a null label isn't learned from; a document with several labels takes the
highest; without labels every score is 0.5; a row without an id isn't learned from
and isn't held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import bounded_fraction, crc_fold, cut_lineage, map_slices, with_fields
from folioflow.llm.linear import Ftrl, Rows, log_odds, mix, row_features, scores_of, sigmoid

BITS = 18
#: Labelled rows that the weights are trained on, about, and updates by them: at least one pass, and more over fewer rows.
SAMPLE = 6000
UPDATES = 18_000
#: Distinct features of all rows trained on, at most: 12 bytes each on the driver.
ENTRIES = 16_000_000
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
#: Rows and text bytes worked on at once: words that they share are looked at once.
AT_ONCE_ROWS, AT_ONCE_BYTES = 1000, 4 << 20
_FRONT, _TAIL = r"^[^\p{L}\p{N}]+", r"[^\p{L}\p{N}]+$"
#: An odd number and its inverse modulo 2 ** 64.
_STEP = 0x100000001B3
_BACK = pow(_STEP, -1, 1 << 64)


class RunHashes:
    """Hashes of runs within strings: the sum over a run's bytes, plus one, times ``_STEP`` to the power of their place in it, modulo 2 ** 64."""

    def __init__(self, strings: pa.Array):
        flat = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays([0, len(strings)], strings), "")[0].as_buffer(), dtype=np.uint8)
        self.size = pc.binary_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)
        self.end = np.cumsum(self.size)
        powers = np.cumprod(np.append(np.uint64(1), np.full(len(flat), _STEP, dtype=np.uint64)))
        self._sums = np.append(np.uint64(0), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * powers[:-1]))
        self._back = np.cumprod(np.append(np.uint64(1), np.full(len(flat), _BACK, dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sums[end] - self._sums[start]) * self._back[start]

    def whole(self) -> np.ndarray:
        return self.of(self.end - self.size, self.end)


def word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words without their case and outer signs, and of those."""
    left = pc.replace_substring_regex(words, _FRONT, "")
    core = pc.replace_substring_regex(left, _TAIL, "")
    runs = RunHashes(words)
    size_of = lambda strings: pc.binary_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)
    start, behind = runs.end - size_of(left), size_of(left) - size_of(core)
    signs = runs.of(runs.end - runs.size, start) * np.uint64(3) + runs.of(runs.end - behind, runs.end) * np.uint64(5)
    upper = pc.and_(pc.utf8_is_upper(core), pc.greater(pc.utf8_length(core), 1))
    case = pc.if_else(pc.equal(core, ""), 0, pc.if_else(upper, 1, pc.if_else(pc.utf8_is_upper(pc.utf8_slice_codeunits(core, 0, 1)), 2, 3)))
    return RunHashes(pc.utf8_lower(core)).whole(), signs * np.uint64(4) + case.to_numpy().astype(np.uint64)


class Features:
    """Hashed n-grams of texts, made from whole arrays."""

    def __init__(self, bits: int = BITS):
        self.bits = bits

    def of(self, texts: pa.Array) -> Rows:
        """The features of each text."""
        lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        row, words = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
        some = pc.not_equal(words, "")
        row, words = row[some.to_numpy(zero_copy_only=False)], words.filter(some).dictionary_encode()
        core, mark = word_hashes(words.dictionary)
        at, bits = words.indices.to_numpy(), self.bits
        cores, marks = core[at], mark[at]
        pair = np.flatnonzero(row[1:] == row[:-1])  # a word that another of its text follows
        again = pair[cores[pair] == cores[pair + 1]]
        made = [
            (row, mix(core, 0, 1, bits)[at]), (row, mix(mark, 0, 2, bits)[at]), (row[pair], mix(cores[pair], cores[pair + 1], 3, bits)), (row[pair], mix(marks[pair], marks[pair + 1], 4, bits)),
            (row[again], mix(np.ones(len(again), dtype=np.uint64), 0, 5, bits)),
        ]
        return row_features(np.concatenate([r for r, _ in made]), np.concatenate([f for _, f in made]), len(texts), bits)


class Model:
    def __init__(self, weights: np.ndarray, bias: float, bits: int = BITS):
        self.weights, self.bias, self.bits = weights, bias, bits
        self.features = Features(bits)

    def __getstate__(self):
        return self.weights, self.bias, self.bits

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(scores_of(self.features.of(texts), self.weights, self.bias))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, updates: int = UPDATES, bits: int = BITS, entries: int = ENTRIES
) -> Model:
    """Weights from ``labels`` (id, 0 or 1) and the texts of their rows."""
    marked = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    total = marked.count()
    if not total:
        return Model(np.zeros(1 << bits, dtype=np.float32), 0.0, bits)
    chosen = bounded_fraction(marked, F.col("id"), total, sample)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")  # ``sample`` bounds the labels

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        made = Features(bits).of(part.column("text"))
        at, x, bounds = made.at.astype("<i4"), made.x.astype("<f4"), made.bounds.tolist()
        cut = lambda values: pa.array([values[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())
        return pa.RecordBatch.from_arrays([part.column("turn"), part.column("label"), pa.array(np.diff(made.bounds)), cut(at), cut(x)], ["turn", "label", "n", "at", "x"])

    keyed = cut_lineage(map_slices(source.select("label", "text", F.xxhash64("id", "text").alias("turn")), run, "turn long, label int, n long, at binary, x binary"))
    sizes = keyed.select("turn", "n").toArrow().sort_by("turn")
    within = int((np.cumsum(sizes.column("n").to_numpy()) <= entries).sum())
    if within < len(sizes):
        keyed = keyed.where(F.col("turn") < sizes.column("turn")[within].as_py())
    rows = keyed.select("turn", "label", "at", "x").toArrow().sort_by([("turn", "ascending"), ("label", "ascending")])
    labels_, ats, xs = rows.column("label").to_pylist(), rows.column("at"), rows.column("x")
    learner = Ftrl(bits, log_odds(labels_))
    for _ in range(-(-updates // max(1, len(labels_)))):
        for i, y in enumerate(labels_):
            learner.learn(np.frombuffer(ats[i].as_py(), "<i4"), np.frombuffer(xs[i].as_py(), "<f4"), y)
    return Model(*learner.weights(), bits)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; only the text is looked at."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(held.value.score(part.column("text")), pa.float64())], ["id", "score"])

    return map_slices(source, run, with_fields([source.schema["id"]], "score double"), rows=AT_ONCE_ROWS, size=AT_ONCE_BYTES)


def learnable(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.where(crc_fold(F.col(id_col), FOLDS) != HELD_OUT)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of ``score``, trained on labels outside the held-out fold."""
    found = score(docs, fit(docs, learnable(labels)))
    return found.select(
        F.col("id").alias("doc_id"), F.coalesce(crc_fold(F.col("id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a score of at least ``threshold``; all columns stay."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("id"), F.col(text_col).alias("text"))
    return score(packed, model, "id", "text").where(F.col("score") >= threshold).select("id.*")
