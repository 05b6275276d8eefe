"""Language identification by segmentation-marginalised unigrams.

Every language has a unigram distribution over the pieces of one fixed public
vocabulary. A text's likelihood in a language sums over all segmentations of its
words into pieces, by a forward pass; the pieces' probabilities come from
expectation maximisation over the same lattices. Words are lower-cased runs of
non-space characters without the signs and digits at their ends, led by a word
mark; pieces never cross words, so a word's likelihoods are worked out once and
remembered. A run above ``LONGEST`` characters, as of a script without spaces, is cut
into words of that many.

Fitting takes a bounded sample: about ``SAMPLE`` rows a language, chosen by a
hash of the id; all of it runs on executors and only the distributions (pieces
times languages) reach the driver.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
if no language was learned every row is; ties go to the first language by name;
the score is the posterior of the predicted language under even priors; a row
without an id isn't learned from and isn't held out.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import crc_fold, map_slices, slices, with_fields

VOCABULARY = "piece_bpe_32k.model"
UNDETERMINED = "und"
#: Rows of each language that the distributions are fitted on, about.
SAMPLE = 1000
ROUNDS = 3
#: Words whose likelihoods a worker remembers; it starts afresh beyond that.
REMEMBERED = 400_000
#: Characters of a word.
LONGEST = 64
FOLDS, HELD_OUT = 5, 0
_MARK = "▁"
_UNKNOWN = -16.0
#: Share of each distribution that comes from all languages together, and of that from an even one.
_SHARED, _EVEN = 0.01, 0.1
_LETTER = regex.compile(r"\p{L}")
#: What words are stripped of at their ends: it tells nothing of a language.
_ENDS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789“”„‘’‚«»‹›…–—¿¡·•。、，；：！？"


def vocabulary_pieces(path: str | None = None) -> list[str]:
    """The pieces that can stand in a word: a word mark at most at their front."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    plain = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [p for p in plain if _MARK not in p[1:]]


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def words_of(text: str | None) -> list[str]:
    return cut_words((text or "").lower().split())


def cut_words(words: list[str]) -> list[str]:
    """Words, the longer ones in parts."""
    if max(map(len, words), default=0) <= LONGEST:
        return words
    out = []
    for w in words:
        core = w if len(w) <= LONGEST else w.strip(_ENDS)
        out += [core] if len(core) <= LONGEST else [core[i : i + LONGEST] for i in range(0, len(core), LONGEST)]
    return out


class Lattice:
    """All segmentations of many words at once. Edges are ordered by their place in the word."""

    def __init__(self, automaton, unknown: int, words: list[str]):
        line = "".join([_MARK + w for w in words])
        sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
        first = np.append(0, np.cumsum(sizes)[:-1])
        word = np.repeat(np.arange(len(words)), sizes)
        found = np.fromiter(chain.from_iterable(automaton.iter(line)), dtype=np.int64).reshape(-1, 2)
        end, piece, size = found[:, 0], found[:, 1] >> 8, found[:, 1] & 255
        single = np.ones(len(line), dtype=bool)
        single[end[size == 1]] = False
        lone = np.flatnonzero(single)  # characters outside the vocabulary
        end, piece, size = np.append(end, lone), np.append(piece, np.full(len(lone), unknown)), np.append(size, np.ones(len(lone), dtype=np.int64))
        own = word[end]
        place = end - first[own]
        order = np.lexsort((end, place))
        self.piece = piece[order]
        # a word of n characters has n + 1 nodes
        self.to = (end + 1 + own)[order]
        self.start = (end + 1 - size + own)[order]
        self.own = own[order]
        self.levels = np.flatnonzero(np.diff(place[order], prepend=-1, append=1 << 62))
        self.roots = first + np.arange(len(words))
        self.tops = self.roots + sizes
        self.nodes = len(line) + len(words)

    def _spread(self, weights: np.ndarray, into: np.ndarray, source: np.ndarray, backwards: bool) -> np.ndarray:
        value = np.full((self.nodes, weights.shape[1]), -np.inf)
        value[self.tops if backwards else self.roots] = 0.0
        steps = range(len(self.levels) - 1)
        for i in reversed(steps) if backwards else steps:
            lo, hi = self.levels[i], self.levels[i + 1]
            at, terms = into[lo:hi], value[source[lo:hi]] + weights[self.piece[lo:hi]]
            if backwards:
                np.logaddexp.at(value, at, terms)
            else:
                heads = np.flatnonzero(np.diff(at, prepend=-1))
                value[at[heads]] = np.logaddexp.reduceat(terms, heads, axis=0)
        return value

    def forward(self, weights: np.ndarray) -> np.ndarray:
        """Log likelihood of each word (row) in each language (column)."""
        return self._spread(weights, self.to, self.start, False)[self.tops]

    def expected(self, weights: np.ndarray, times: np.ndarray) -> np.ndarray:
        """How often each piece is used in words that occur ``times``, for one language."""
        alpha = self._spread(weights, self.to, self.start, False)
        beta = self._spread(weights, self.start, self.to, True)
        share = np.exp(alpha[self.start, 0] + weights[self.piece, 0] + beta[self.to, 0] - alpha[self.tops, 0][self.own])
        return np.bincount(self.piece, weights=share * times[self.own], minlength=len(weights))


class Model:
    """Languages, pieces and log probabilities; the last row is of characters outside the vocabulary."""

    def __init__(self, languages: list[str], pieces: list[str], weights: np.ndarray, remembered: int = REMEMBERED):
        self.languages, self.pieces, self.weights, self.remembered = languages, pieces, weights, remembered
        self._automaton = None

    def __getstate__(self):
        return (self.languages, self.pieces, self.weights, self.remembered)

    def __setstate__(self, state):
        self.__init__(*state)

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for i, p in enumerate(self.pieces):
                made.add_word(p, i << 8 | len(p))
            made.make_automaton()
            self._automaton = made
            self._places: dict[str, int] = {}
            self._scores = np.zeros((1024, len(self.languages)))  # row 0 stays zero
        return self._automaton

    def lattice(self, words: list[str]) -> Lattice:
        return Lattice(self.automaton(), len(self.pieces), words)

    def _rows(self, words: set[str]) -> dict[str, int]:
        """Where each word's likelihoods stand; words of signs alone have row 0, of zeros."""
        if len(self._places) > self.remembered:
            self._places, self._scores = {}, self._scores[:1024]
        places, out, new = self._places, {}, []
        for w in words:
            core = w.strip(_ENDS)
            at = places.get(core) if core else 0
            if at is None:
                new.append((w, core))
            else:
                out[w] = at
        cores = sorted({c for _, c in new}, key=len)
        parts = [self.lattice(cores[i : i + 5000]).forward(self.weights) for i in range(0, len(cores), 5000)]
        start = len(places) + 1
        while start + len(cores) > len(self._scores):
            self._scores = np.concatenate([self._scores, np.zeros_like(self._scores)])
        if cores:
            self._scores[start : start + len(cores)] = np.concatenate(parts)
        places.update(zip(cores, range(start, start + len(cores)), strict=True))
        out.update((w, places[c]) for w, c in new)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        self.automaton()
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        split = [words_of(t) if has_letter(t) else [] for t in texts]
        words: set[str] = set()
        for own in split:
            words.update(own)
        place = self._rows(words)
        sizes = np.array([len(own) for own in split])
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(sizes.sum()))
        total = np.zeros((len(texts), len(self.languages)))
        if len(at):
            some = np.flatnonzero(sizes)
            total[some] = np.add.reduceat(self._scores[at], np.append(0, np.cumsum(sizes)[:-1])[some], axis=0)
        best = total.argmax(axis=1)
        posterior = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        known = sizes > 0
        return [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], np.where(known, posterior, 0.0).tolist()


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, rounds: int = ROUNDS, vocabulary: str | None = None) -> Model:
    """Distributions for each language of ``docs``, from the rows given (leave out what may not be learned from)."""
    pieces = vocabulary_pieces(vocabulary)
    spark = docs.sparkSession
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    empty = Model(languages, pieces, np.full((len(pieces) + 1, len(languages)), -np.log(len(pieces))))
    if not languages:
        return empty
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1 << 31, int(sample / n * (1 << 31))))])
    chosen = labelled.where(F.pmod(F.xxhash64(F.lit("lang"), "id"), F.lit(1 << 31)) < F.element_at(shares, F.col("lang")))

    def count(batches):
        for part in slices(batches):
            words = pc.utf8_split_whitespace(pc.utf8_lower(part.column("text")))
            flat = pc.utf8_trim(pc.list_flatten(words), characters=_ENDS)
            langs = pc.take(part.column("lang"), pc.list_parent_indices(words))
            long = pc.greater(pc.utf8_length(flat), LONGEST)
            if pc.any(long).as_py():
                parts = [(lang, p.strip(_ENDS)) for lang, w in zip(langs.filter(long).to_pylist(), flat.filter(long).to_pylist(), strict=True) for p in cut_words([w])]
                langs = pa.concat_arrays([langs.filter(pc.invert(long)), pa.array([lang for lang, _ in parts], langs.type)])
                flat = pa.concat_arrays([flat.filter(pc.invert(long)), pa.array([p for _, p in parts], flat.type)])
            grouped = pa.table({"lang": langs, "word": flat}).group_by(["lang", "word"]).aggregate([([], "count_all")])
            for batch in grouped.rename_columns(["lang", "word", "n"]).combine_chunks().to_batches():
                yield batch

    counts = chosen.mapInArrow(count, "lang string, word string, n long").where("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    weights = empty.weights
    try:
        for _ in range(rounds):
            held = spark.sparkContext.broadcast(Model(languages, pieces, weights))

            def expect(batches, held=held):
                model = held.value
                for batch in batches:
                    langs, words = np.array(batch.column("lang").to_pylist(), dtype=object), batch.column("word").to_pylist()
                    times = batch.column("n").to_numpy()
                    for i, lang in enumerate(model.languages):
                        own = np.flatnonzero(langs == lang)
                        own = own[np.argsort([len(words[j]) for j in own], kind="stable")]
                        total = np.zeros(len(model.weights))
                        for lo in range(0, len(own), 5000):
                            at = own[lo : lo + 5000]
                            total += model.lattice([words[j] for j in at]).expected(model.weights[:, i : i + 1], times[at])
                        used = np.flatnonzero(total)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), i, dtype=np.int32)), pa.array(used.astype(np.int32)), pa.array(total[used])], ["lang", "piece", "n"])

            sums = counts.mapInArrow(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
            mass = np.zeros((len(pieces), len(languages)))
            at = sums.column("piece").to_numpy()
            inside = at < len(pieces)
            mass[at[inside], sums.column("lang").to_numpy()[inside]] = sums.column("n").to_numpy()[inside]
            own = mass / np.maximum(mass.sum(axis=0), 1e-9)
            shared = own.mean(axis=1, keepdims=True) * (1 - _EVEN) + _EVEN / len(pieces)
            weights = np.append(np.log(own * (1 - _SHARED) + shared * _SHARED), np.full((1, len(languages)), _UNKNOWN), axis=0)
            held.unpersist()
    finally:
        counts.unpersist()
    return Model(languages, pieces, weights)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; only the text is looked at."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = held.value.predict(part.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return map_slices(source, run, with_fields([source.schema["id"]], "lang_pred string, score double"))


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(crc_fold(F.col(id_col), FOLDS) != HELD_OUT)


def language_report(docs: DataFrame) -> DataFrame:
    """The digest of ``identify``, fitted on the rows outside the held-out fold."""
    found = identify(docs, fit(learnable(docs)))
    return found.select(F.col("id").alias("doc_id"), F.coalesce(crc_fold(F.col("id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, languages: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` whose language is determined, and is one of ``languages`` if those are given; all columns stay."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("id"), F.col(text_col).alias("text"))
    found = identify(packed, model, "id", "text").where(F.col("lang_pred") != UNDETERMINED)
    if languages is not None:
        found = found.where(F.col("lang_pred").isin(*languages))
    return found.select("id.*")
