"""Packing of tokenised documents into fixed-length training sequences.

Documents are tokenised, ended by ``END`` and cut into pieces of ``LENGTH``
tokens and a shorter rest. Rests are packed by first-fit decreasing; a
tournament tree over the free room of the bins finds the first bin that fits in
logarithmic time. Packing runs independently in randomised groups of about
``GROUP`` documents, so no task holds more than the rests of its groups; whole
pieces fill a sequence each and stream past. Workers outlive tasks, so they return
the memory that they have freed after each batch.

A sequence is padded to ``LENGTH`` unless its tokens already number a power of two.

Defined results: a null or empty text is the end token alone; equal rows are
packed each for itself; an empty table gives no pieces; ties go by a hash of the
id and of the piece's place in its input partition, so that neither repeated nor
missing ids gather in one group (a repeated task must read its rows in the same
order again, as scans, written tables and checkpoints do). All tokens of all texts
lie in exactly one piece.
"""

from __future__ import annotations

import os
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import Remembered, give_back, slices, spell, with_fields

LENGTH = 2048
END = 1
GROUP = 2048
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker remembers; it starts afresh beyond that.
REMEMBERED = 450_000
#: Rows and text bytes tokenised at once: words that they share are looked up once.
AT_ONCE_ROWS, AT_ONCE_BYTES = 1000, 4 << 20
#: Pieces handed on at once, of ``LENGTH`` 32-bit ids at most each.
HANDED_ROWS = 512

_PIECES = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Signs at a word's end, behind a letter, are pre-tokenised apart from it.
_CUT = r"(?s)^(?P<root>.*[a-z0-9])(?P<signs>[#$%&*+,./:;=?!|-]+)$"
#: Words of these letters alone are one piece of pre-tokenised text each, whose last id ends a word.
_PLAIN = re.compile("[a-zß-öø-ÿÀ-ÖØ-Þ]+")
_WORD_END = "</w>"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """The ids of a tokenizer whose pieces never cross ASCII white space, word by word with a memory.

    ``kind`` is the narrowest unsigned type that holds the vocabulary."""

    def __init__(self, spec: str, remembered: int = REMEMBERED):
        self.spec, self.remembered = spec, remembered
        self.known = Remembered(remembered)

    def __getstate__(self):
        return self.spec, self.remembered

    def __setstate__(self, state):
        self.__init__(*state)

    @cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.spec)

    @cached_property
    def kind(self) -> np.dtype:
        return np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    @cached_property
    def ends(self) -> np.ndarray:
        """Which ids end a word."""
        out = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for piece, i in self.tokenizer.get_vocab().items():
            out[i] = piece.endswith(_WORD_END)
        return out

    def _pack_plain(self, words: list[str]) -> list[bytes]:
        """As ``_pack``, for plain words: one text of them all, cut at the ids that end a word."""
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=self.kind)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or cuts[-1] != len(ids):
            return self._pack(words)
        packed, wide = ids.tobytes(), self.kind.itemsize
        cuts = (cuts * wide).tolist()
        return [packed[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _pack(self, texts: list[str]) -> list[bytes]:
        kind = self.kind
        return [np.array(e.ids, dtype=kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, units: list[str]) -> list[bytes]:
        """The ids of words and runs of signs, remembered."""
        wanted = set(units)
        out = self.known.take(wanted)
        plain, other = [], []
        for u in wanted.difference(out):
            (plain if _PLAIN.fullmatch(u) else other).append(u)
        made = dict(zip(plain, self._pack_plain(plain), strict=True))
        made.update(zip(other, self._pack(other), strict=True))
        self.known.put(made)
        out.update(made)
        return [out[u] for u in units]

    def ids(self, texts: pa.Array) -> list[bytes]:
        """The little-endian ids of each text, without an end.

        Words are split, told apart and put together again as arrays; only distinct words and signs
        are handled one by one. Texts that may hold a special token are tokenised whole."""
        special = pc.fill_null(pc.match_substring(texts, "<|"), False)
        lowered = pc.fill_null(pc.if_else(special, "", pc.ascii_lower(texts)), "")  # the vocabulary is of lower case
        flat, bounds = spell(lowered, _CUT, self._units, self.kind)
        bounds = bounds.tolist()
        out = [flat[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._pack([texts[i].as_py()])[0]
        return out


class RoomTree:
    """A tournament tree over the free room of bins: the first bin with enough room wins."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        placed = node - self.leaves
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return placed


def first_fit_decreasing(sizes: list[int], capacity: int = LENGTH) -> tuple[list[int], list[int]]:
    """Bin and offset of each of ``sizes``, which fall from first to last and fit a bin each."""
    tree, filled, bins, offsets = RoomTree(len(sizes), capacity), {}, [], []
    for size in sizes:
        b = tree.place(size)
        bins.append(b)
        offsets.append(filled.get(b, 0))
        filled[b] = offsets[-1] + size
    return bins, offsets


def pieces(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """(id, start, length, doc_tokens, ids): documents as cut token runs, ids packed in the narrowest type."""
    with open(vocabulary or vocabulary_path(), encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(WordTokenizer(f.read()))  # a worker keeps it, and its memory of words, from task to task
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def cut(part):
        tokenizer = held.value
        kind = tokenizer.kind
        wide, last = kind.itemsize, np.array([end], dtype=kind).tobytes()
        rows, starts, sizes, totals, ids = [], [], [], [], []
        for row, own in enumerate(tokenizer.ids(part.column("text"))):
            own += last
            total = len(own) // wide
            for s in range(0, total, length):
                piece = own[s * wide : (s + length) * wide]
                rows.append(row)
                starts.append(s)
                sizes.append(len(piece) // wide)
                totals.append(total)
                ids.append(piece)
        for lo in range(0, len(rows), 4096):
            at = slice(lo, lo + 4096)
            yield pa.RecordBatch.from_arrays(
                [pc.take(part.column("id"), pa.array(rows[at])), pa.array(starts[at], pa.int64()), pa.array(sizes[at], pa.int64()), pa.array(totals[at], pa.int64()), pa.array(ids[at], pa.binary())],
                ["id", "start", "length", "doc_tokens", "ids"],
            )

    def run(batches):
        for batch in batches:
            for part in slices([batch], rows=AT_ONCE_ROWS, size=AT_ONCE_BYTES):
                yield from cut(part)
            batch = part = None
            give_back()  # after each slice it would cost a sixth more CPU time

    return source.mapInArrow(run, with_fields([source.schema["id"]], "start long, length long, doc_tokens long, ids binary"))


def pack(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, group: int = GROUP) -> DataFrame:
    """Per piece: id, start, length, doc_tokens, sequence_id, offset and ``ids`` (little-endian unsigned 32-bit)."""
    groups = max(1, -(-docs.count() // group))
    cut = pieces(docs, vocabulary, id_col, text_col, length, end)
    cut = cut.withColumn("tie", F.xxhash64(F.lit("pack"), "id", "start", F.monotonically_increasing_id())).withColumn("group", F.pmod("tie", F.lit(groups)))
    cut = cut.withColumn("whole", F.col("length") == length)
    dealt = cut.repartition("group").sortWithinPartitions("group", "whole", F.desc("length"), "tie", "id", "start")
    dealt = dealt.select("group", "whole", "id", "start", "length", "doc_tokens", "ids")
    id_field = cut.schema["id"]

    def wide(column: pa.Array, sizes: np.ndarray) -> pa.Array:
        bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        total = int(sizes.sum())
        if bounds[-1] - bounds[0] == 4 * total:
            return column
        flat = np.frombuffer(column.buffers()[2], "<u2", total, bounds[0]).astype("<u4")
        return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer((bounds - bounds[0]) * 2), pa.py_buffer(flat)])

    def out(rows: pa.Table, sequence, offset):
        for lo in range(0, rows.num_rows, HANDED_ROWS):
            at = slice(lo, lo + HANDED_ROWS)
            part = rows.slice(lo, HANDED_ROWS).combine_chunks()
            col = lambda c: part.column(c).combine_chunks()  # noqa: B023, E731
            ids = wide(col("ids").cast(pa.binary()), col("length").to_numpy())
            arrays = [col("id"), col("start"), col("length"), col("doc_tokens"), pa.array(sequence[at], pa.int64()), pa.array(offset[at], pa.int64()), ids]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    def run(batches):
        held: list[pa.Table] = []
        now, used = None, 0  # the group at hand and its sequences so far

        def packed():
            nonlocal used
            if held:
                rests = pa.concat_tables(held)
                held.clear()
                bins, offsets = first_fit_decreasing(rests.column("length").to_pylist(), length)
                used = max(bins) + 1
                yield from out(rests, np.array(bins, dtype=np.int64) * groups + now, offsets)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            g, w = t.column("group").to_numpy(), t.column("whole").to_numpy()
            edges = np.flatnonzero((g[1:] != g[:-1]) | (w[1:] != w[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(g)], strict=True):
                part = t.slice(lo, hi - lo)
                if now != g[lo]:
                    yield from packed()
                    now, used = int(g[lo]), 0
                if not w[lo]:
                    held.append(part)
                    continue
                yield from packed()
                yield from out(part, (np.arange(hi - lo) + used) * groups + now, np.zeros(hi - lo, dtype=np.int64))
                used += hi - lo
            batch = t = part = None
            give_back()
        yield from packed()
        give_back()

    return dealt.mapInArrow(run, with_fields([id_field], _PIECES))


def padding(packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row: sequences, tokens and padding, of which sequences at a power of two need none."""
    filled = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.expr("(n & (n - 1)) = 0")
    return filled.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(power, 0).otherwise(length - F.col("n"))).alias("padding"))


def pack_report(docs: DataFrame) -> DataFrame:
    """The digest of ``pack`` per piece."""
    return pack(docs).select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
