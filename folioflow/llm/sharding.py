"""Sharding by a k-d tree over document metadata.

A node with several leaves is split along its widest metadata dimension at a
weighted quantile of its bytes (the weighted median where its leaves are even in
number), until every node is a leaf of the target bytes. Dimensions are the source
and the language, in alphabetical order, and the size, by its logarithm; a
dimension is as wide as its part of the whole table's range. Quantiles are found
without collecting rows: histograms of a dimension's integer key, ever finer
around the wanted weight, narrow it down to a handful of rows, and one row between
them is the cut. Below the value a key carries a hash that differs even between
equal rows, which breaks ties and nothing else, so a cut may fall anywhere within a
hot source or a text copied millions of times. Only the narrow metadata (no text)
takes part, and all nodes of a level share each pass.

A row above ``1 / HEAVY`` of a shard is heavy. A node's cut is found for all its
rows and then, for the others, again, so that those make up for what a heavy row
at the cut left uneven. ``bytes`` law: a cut misses its weight by half the size
of the largest row that isn't heavy, as long as a node has enough of those.

Defined results: a null text has no bytes and crc 0; a null source or language is
the first of all; each row counts ``OVERHEAD`` bytes besides its text; an empty
table gives no rows; a dimension that ``docs`` lacks is left out; which of several
equal rows goes to which shard depends on their order in the input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import cut_lineage

SHARDS = 40
OVERHEAD = 16
LAW = "bytes"
#: Bins of a histogram pass, of all nodes together and of one at least, and rows of a bin up to which its rows are looked at one by one.
BINS, LEAST_BINS = 1 << 15, 1 << 10
FEW = 64
#: A shard holds at most so many rows that are cut on their own.
HEAVY = 32
#: Rows of a slot block, numbered in one task.
BLOCK = 20_000
_LOW_BITS, _HIGH_BITS = 40, 22
#: Bytes of a value, behind what all values begin with, that give its place in the alphabet.
_PLACE_BYTES = 6


@dataclass
class Node:
    leaves: int
    first: int  # the smallest shard below
    dimension: str | None = None
    cut: int = 0  # rows with a key below it go left
    heavy_cut: int = 0  # the same for heavy rows
    left: Node | None = None
    right: Node | None = None


def _place(value: Column, low: str, high: str) -> Column:
    """Where a string stands between the first and the last of all, in ``_HIGH_BITS`` bits; null is in front of them.

    Strings that don't differ in ``_PLACE_BYTES`` bytes behind what all begin with may share a place."""
    first, last = low.encode(), high.encode()
    same = next((i for i, (x, y) in enumerate(zip(first, last, strict=False)) if x != y), min(len(first), len(last)))
    number = lambda b: int.from_bytes(b[same : same + _PLACE_BYTES].ljust(_PLACE_BYTES, b"\0"), "big")
    own = F.conv(F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), same + 1, _PLACE_BYTES)), 2 * _PLACE_BYTES, "0"), 16, 10).cast("long")
    scale = ((1 << _HIGH_BITS) - 2) / max(1, number(last) - number(first))
    return F.coalesce(F.floor((own - F.lit(number(first))) * F.lit(scale)).cast("long") + 1, F.lit(0).cast("long"))


def metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dimensions: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(id, size, text_crc32, row, d_*): a key for each dimension, the value's place above and ``row``, a hash, below.

    The hash is also of the row's place in its partition, so keep what comes out before it is used twice."""
    there = [c for c in dimensions if c in docs.columns]
    values = [F.col(f"`{c}`").cast("string") for c in there]
    ends = docs.agg(F.count("*"), *[f(v) for v in values for f in (F.min, F.max)]).first()[1:] if there else ()
    text = F.col(text_col).cast("string")
    out = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        *[_place(v, ends[2 * i] or "", ends[2 * i + 1] or "").alias(f"v_{i}") for i, v in enumerate(values)],
    )
    out = out.withColumn("row", F.xxhash64("id", "text_crc32", F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << _LOW_BITS) - 1)))
    out = out.withColumn("v_size", F.floor(F.log2("size") * F.lit(1 << 16)).cast("long"))
    keys = [(F.shiftleft(F.col(c), _LOW_BITS) + F.col("row")).alias("d_" + c[2:]) for c in out.columns if c.startswith("v_")]
    return out.select("id", "size", "text_crc32", "row", *keys)


def _pick(values: list, kind: str = "long") -> Column:
    """The value of a row's open node, from one constant array."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("node"))


def grow(meta: DataFrame, shards: int = SHARDS) -> tuple[Node, DataFrame]:
    """The tree over ``metadata`` rows, with ``shards`` leaves of nearly equal bytes, and the rows with their shard.

    ``node`` is the place of a row's open node, or below zero for shard ``-1 - node``. Each level
    is checkpointed, so plans don't grow with the tree."""
    dims = [c for c in meta.columns if c.startswith("d_")]
    uneven = meta.where("heavy").limit(1).count() > 0
    root = Node(shards, 0)
    whole: dict[str, int] = {}  # the width of each dimension over all rows
    front = [root] if shards > 1 else []
    rows = meta.withColumn("node", F.lit(0 if front else -1))
    while front:
        routed = rows.where("node >= 0")
        spans = routed.groupBy("node").agg(F.sum("size").alias("total"), *[f(c).alias(f"{k}_{c}") for c in dims for k, f in (("lo", F.min), ("hi", F.max))]).collect()
        seen = {r.node: r.asDict() for r in spans}
        goals: dict[int, list] = {}
        for n, x in enumerate(front):
            own = seen.get(n)
            wide = {c: (own[f"hi_{c}"] >> _LOW_BITS) - (own[f"lo_{c}"] >> _LOW_BITS) if own else 0 for c in dims}
            whole = whole or wide
            x.dimension = max(dims, key=lambda c: wide[c] / max(1, whole[c]))  # the first of equally wide ones
            if own:
                lo, hi = own[f"lo_{x.dimension}"], own[f"hi_{x.dimension}"] + 1
                # cuts in [lo, hi], the bytes under lo, the bytes that go left
                goals[n] = [lo, hi, 0, own["total"] * (x.leaves // 2) / x.leaves]
        key = F.get(F.array(*dims), _pick([dims.index(x.dimension) for x in front], "int")).alias("key")
        keyed = routed.select("node", "size", "heavy", key)
        wanted = {n: goal[3] for n, goal in goals.items()}
        _cuts(keyed, goals, len(front))
        for n, x in enumerate(front):
            x.cut = x.heavy_cut = goals[n][0] if n in goals else 0
        if uneven and goals:
            below = _pick([x.heavy_cut for x in front])
            light = F.when(~F.col("heavy"), F.col("key"))
            again = keyed.groupBy("node").agg(F.coalesce(F.sum(F.when(F.col("heavy") & (F.col("key") < below), F.col("size"))), F.lit(0)).alias("heavy_left"), F.min(light).alias("lo"), F.max(light).alias("hi")).collect()
            goals = {r.node: [r.lo, r.hi + 1, 0, max(0, wanted[r.node] - r.heavy_left)] for r in again if r.lo is not None}
            _cuts(keyed.where(~F.col("heavy")), goals, len(front))
            for n, goal in goals.items():
                front[n].cut = goal[0]
        codes: tuple[list[int], list[int]] = ([], [])
        below_front: list[Node] = []
        for x in front:
            half = x.leaves // 2
            x.left, x.right = Node(half, x.first), Node(x.leaves - half, x.first + half)
            for side, child in zip(codes, (x.left, x.right), strict=True):
                side.append(len(below_front) if child.leaves > 1 else -1 - child.first)
                if child.leaves > 1:
                    below_front.append(child)
        cut = F.when(F.col("heavy"), _pick([x.heavy_cut for x in front])).otherwise(_pick([x.cut for x in front]))
        child = F.when(key < cut, _pick(codes[0], "int")).otherwise(_pick(codes[1], "int"))
        rows = cut_lineage(rows.withColumn("node", F.when(F.col("node") < 0, F.col("node")).otherwise(child)))
        front = below_front
    return root, rows.withColumn("shard", (-1 - F.col("node")).cast("int")).drop("node")


def _cuts(keyed: DataFrame, goals: dict[int, list], nodes: int) -> None:
    """Narrow every goal to its cut, which replaces ``lo``. ``keyed`` has node, size and key."""
    wanted = set(goals)
    while wanted:
        lo = _pick([goals[n][0] if n in wanted else None for n in range(nodes)])
        hi = _pick([goals[n][1] if n in wanted else None for n in range(nodes)])
        inside = keyed.where((F.col("key") >= lo) & (F.col("key") < hi))
        step = F.greatest(F.lit(1), F.ceil((hi - lo) / F.lit(max(LEAST_BINS, BINS // nodes))))
        bins = inside.groupBy("node", ((F.col("key") - lo) / step).cast("long").alias("bin")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most")).collect()
        few: set[int] = set()
        for n in list(wanted):
            _, _, below, goal = goals[n]
            own = sorted((r for r in bins if r.node == n), key=lambda r: r.least)
            for i, r in enumerate(own):
                if below + r.bytes >= goal or i == len(own) - 1:
                    break
                below += r.bytes
            goals[n] = [r.least, r.most + 1, below, goal]
            if r.least == r.most:  # one key: cut before or behind it, whichever is nearer
                goals[n][0] = r.least if goal - below <= below + r.bytes - goal else r.most + 1
                wanted.discard(n)
            elif r.n <= FEW:
                few.add(n)
                wanted.discard(n)
        if few:
            lo = _pick([goals[n][0] if n in few else None for n in range(nodes)])
            hi = _pick([goals[n][1] if n in few else None for n in range(nodes)])
            rows = keyed.where((F.col("key") >= lo) & (F.col("key") < hi)).groupBy("node", "key").agg(F.sum("size").alias("bytes")).collect()
            for n in few:
                _, _, below, goal = goals[n]
                best = None
                for r in sorted((r for r in rows if r.node == n), key=lambda r: r.key):
                    for cut, under in ((r.key, below), (r.key + 1, below + r.bytes)):
                        if best is None or abs(under - goal) < best[0]:
                            best = (abs(under - goal), cut)
                    below += r.bytes
                goals[n][0] = best[1]


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", dimensions: tuple[str, ...] = ("source", "lang"), block: int = BLOCK) -> DataFrame:
    """(id, size, text_crc32, shard, slot): slots number the rows of a shard without gaps.

    Rows are numbered in blocks of about ``block`` rows by hash, and blocks by their sizes,
    so no task holds a whole shard."""
    meta = cut_lineage(metadata(docs, id_col, text_col, dimensions))
    total, weight = meta.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    meta = meta.withColumn("heavy", F.col("size") * (shards * HEAVY) > weight)
    _, rows = grow(meta, shards)
    blocks = max(1, -(-total // (shards * block)))
    placed = rows.select("id", "size", "text_crc32", "row", "shard").withColumn("block", F.pmod(F.xxhash64(F.lit("slot"), "row"), F.lit(blocks)))
    sizes = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    starts = sizes.selectExpr("shard", "block", "sum(n) over (partition by shard order by block) - n as first")
    numbered = placed.selectExpr("*", "row_number() over (partition by shard, block order by row, id, text_crc32) - 1 as local")
    return numbered.join(starts, ["shard", "block"]).select("id", "size", "text_crc32", "shard", (F.col("first") + F.col("local")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", dimensions: tuple[str, ...] = ("source", "lang")) -> None:
    """Write ``docs`` with their shard, a folder per shard, from rows dealt by shard and slot block.

    A row is known by its id and text; rows that are alike in both are numbered, each such pair in one task."""
    placed = shard(docs, shards, id_col, text_col, dimensions)
    placed = cut_lineage(placed.select(F.col("id").alias("__id"), F.col("text_crc32").alias("__crc"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot")))
    crc = F.crc32(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary"))
    own = docs.withColumn("__own_id", F.col(f"`{id_col}`")).withColumn("__own_crc", crc)
    twins = placed.groupBy("__id", "__crc").agg(F.count("*").alias("__n")).where("__n > 1").select(F.col("__id").alias("__twin"), F.col("__crc").alias("__twin_crc"))
    of_twin = lambda i, c: F.col(i).eqNullSafe(F.col("__twin")) & (F.col(c) == F.col("__twin_crc"))
    same = F.col("__own_id").eqNullSafe(F.col("__id")) & (F.col("__own_crc") == F.col("__crc"))
    written = own.join(placed.join(twins, of_twin("__id", "__crc"), "left_anti"), same)
    if not twins.isEmpty():
        number = lambda df, i, c, name: df.join(twins, of_twin(i, c), "left_semi").withColumn(name, F.row_number().over(Window.partitionBy(i, c).orderBy(c)))
        more = number(own, "__own_id", "__own_crc", "__own_n").join(number(placed, "__id", "__crc", "__n"), same & (F.col("__own_n") == F.col("__n")))
        written = written.unionByName(more.drop("__own_n", "__n"))
    dealt = written.drop("__own_id", "__own_crc", "__id", "__crc").repartition("__shard", F.floor(F.col("__slot") / BLOCK))
    dealt.drop("__slot").write.partitionBy("__shard").parquet(path)


def shard_report(docs: DataFrame) -> DataFrame:
    """The digest of ``shard`` per document row."""
    return shard(docs).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
