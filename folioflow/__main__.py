"""Convert files from the command line: ``python -m folioflow IN OUT [--output markdown|html|json|chunks]``.

IN is a path or pattern that Spark reads; OUT gets a Parquet row per document."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from folioflow.operators.service import IMAGE_MODES, OUTPUTS
from folioflow.plans.convert import Options, convert


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="folioflow", description=__doc__)
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--output", choices=OUTPUTS, default="markdown")
    p.add_argument("--images", choices=IMAGE_MODES, default="extract")
    p.add_argument("--max-table-rows", type=int, default=Options.max_table_rows)
    p.add_argument("--include-metadata", action="store_true")
    p.add_argument("--extract-content", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("folioflow").getOrCreate()
    options = Options(output=a.output, images=a.images, max_table_rows=a.max_table_rows, include_metadata=a.include_metadata, extract_content=a.extract_content)
    convert(spark, a.source, options).write.mode("overwrite").parquet(a.target)


if __name__ == "__main__":
    main()
