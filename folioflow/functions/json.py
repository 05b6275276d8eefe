"""JSON texts as columns, over Spark's VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_kind(text: Column) -> Column:
    """``schema``, ``flat_object``, ``array_dump``, ``code``, or ``invalid``."""
    v = F.try_parse_json(text)
    shape = F.schema_of_variant(v)
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    has = lambda k: F.array_contains(keys, F.lit(k))
    is_object = shape.startswith("OBJECT")
    schema = is_object & (has("$schema") | has("$defs") | has("definitions") | (has("properties") & has("type")))
    values = F.map_values(F.from_json(text, "map<string,string>"))
    nested = F.exists(values, lambda x: F.coalesce(F.schema_of_variant(F.try_parse_json(x)).rlike("^(OBJECT|ARRAY)"), F.lit(False)))
    flat = is_object & (F.size(keys) > 0) & ~nested
    dump = shape.rlike("^ARRAY<OBJECT<")
    return F.when(v.isNull(), "invalid").when(schema, "schema").when(flat, "flat_object").when(dump, "array_dump").otherwise("code")


def flat_pairs(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, pos, key, value) of flat objects, values as text, null as an empty one."""
    keys = F.json_object_keys(F.col(json_col))
    own = rows.select(id_col, F.from_json(json_col, "map<string,string>").alias("m"), F.posexplode(keys).alias("pos", "key"))
    return own.select(id_col, "pos", "key", F.coalesce(F.try_element_at("m", F.col("key")), F.lit("")).alias("value"))


def record_cells(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, row, pos, key, value) of arrays of records."""
    each = rows.select(id_col, F.posexplode(F.from_json(json_col, "array<map<string,string>>")).alias("row", "m"))
    return each.select(id_col, "row", F.posexplode(F.map_entries("m")).alias("pos", "e")).select(id_col, "row", "pos", "e.key", F.coalesce("e.value", F.lit("None")).alias("value"))
