"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and text bytes that a Python function works on at once.
SLICE_ROWS = 600
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names. One is made only where none is named and the master is local,
    as in tests: a folder of one machine is of no use to a cluster, so there its lack is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: its files outlive any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of bounded rows and, but for a single long text, bounded bytes."""
    for batch in batches:
        n, start = batch.num_rows, 0
        if n == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        held = 0
        for i in range(n):
            if i > start and (i - start >= rows or held + sizes[i] > size):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(sizes[i])
        yield batch.slice(start)


def give_back() -> None:
    """Return to the system what the allocators keep of freed memory: Arrow's, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding it."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def with_fields(fields, ddl: str) -> StructType:
    """A schema of given fields and then those of ``ddl``."""
    return StructType([*fields, *StructType.fromDDL(ddl).fields])


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema, text: str = "text", rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> DataFrame:
    """``fn`` over slices of ``df``, Arrow in and out."""

    def run(batches):
        for part in slices(batches, text, rows, size):
            yield fn(part)

    return df.mapInArrow(run, schema)


def crc_fold(column, folds: int):
    """crc32 of a column as text, modulo ``folds``."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(folds)


def bounded_fraction(df: DataFrame, key, total: int, bound: int) -> DataFrame:
    """About ``bound`` of ``total`` rows, chosen by a hash of ``key`` and so alike on every run."""
    if total <= bound:
        return df
    share = int(bound / total * (1 << 31))
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 31)) < F.lit(share))


def spell(texts: pa.Array, cut: str, lookup: Callable[[list[str]], list[bytes]], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of texts, one text after another, and where each text's begin (and the last one's end).

    Words are runs without ASCII white space; where ``cut`` (with groups ``root`` and ``signs``) fits one,
    its two parts are words of their own. ``lookup`` gives the packed ids of distinct words; everything
    else works on whole arrays."""
    lists = pc.ascii_split_whitespace(texts)
    words = pc.list_flatten(lists).dictionary_encode()
    distinct = words.dictionary
    parts = pc.extract_regex(distinct, cut)  # null where it doesn't fit
    fits = parts.is_valid()
    is_cut = fits.to_numpy(zero_copy_only=False)
    first = pc.if_else(fits, pc.struct_field(parts, "root"), distinct)
    units = pa.concat_arrays([first, pc.struct_field(parts, "signs").filter(fits)]).dictionary_encode()
    packed = lookup(units.dictionary.to_pylist())
    pool = np.frombuffer(b"".join(packed), dtype=kind)
    size = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // kind.itemsize
    start = np.cumsum(size) - size
    at = units.indices.to_numpy()
    second = np.full(len(distinct), -1, dtype=at.dtype)
    second[is_cut] = at[len(distinct) :]
    order = words.indices.to_numpy()
    pairs = np.stack([at[: len(distinct)][order], second[order]], axis=1).ravel()
    held = pairs >= 0
    run = pairs[held]  # the units of all texts, one after another
    lengths = size[run]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    flat = pool[np.arange(total) + np.repeat(start[run] - (ends - lengths), lengths)]
    before = np.append(0, np.cumsum(held))[2 * lists.offsets.to_numpy()]  # units before each text
    return flat, np.append(0, ends)[before]


class Remembered:
    """What was worked out for keys, in two generations: the older one goes once the newer holds ``most / 2``.

    Keys in use move to the newer one, so frequent keys stay."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def take(self, keys: set) -> dict:
        """The values of those keys that are known."""
        new, old = self.new, self.old
        out = {k: new[k] for k in keys & new.keys()}
        if old:
            back = {k: old[k] for k in keys.difference(out) & old.keys()}
            new.update(back)
            out.update(back)
        return out

    def put(self, values: dict) -> None:
        self.new.update(values)
        if 2 * len(self.new) > self.most:
            self.old, self.new = self.new, {}
