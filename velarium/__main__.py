"""Command line.

    python -m velarium queries
    python -m velarium run NAME TABLES_DIR [--out DIR]
    python -m velarium process INPUT.jsonl OUT_DIR
    python -m velarium lineage EDGES.parquet ID [--depth N] [--down]
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .operators import lineage
from .plans.enrich import enrich
from .plans.registry import QUERIES
from .session import session
from .sources import files


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser("velarium")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("queries")
    run = sub.add_parser("run")
    run.add_argument("name", choices=sorted(QUERIES))
    run.add_argument("tables")
    run.add_argument("--out")
    process = sub.add_parser("process")
    process.add_argument("input")
    process.add_argument("out")
    line = sub.add_parser("lineage")
    line.add_argument("edges")
    line.add_argument("id", type=int)
    line.add_argument("--depth", type=int, default=5)
    line.add_argument("--down", action="store_true")
    a = p.parse_args(argv)
    if a.what == "queries":
        print("\n".join(sorted(QUERIES)))
        return
    spark = session()
    if a.what == "run":
        df = QUERIES[a.name](spark, a.tables)
        df.write.mode("overwrite").parquet(a.out) if a.out else df.show(50, truncate=False)
    elif a.what == "process":
        rows = files.read_json(spark, a.input).where("_corrupt_record IS NULL")
        e = rows.select(F.monotonically_increasing_id().alias("ord"), F.col("CanonicalLatin").alias("latin"), F.coalesce("CanonicalNative", "CanonicalLatin").alias("native"), F.col("BirthYear").alias("birth"), F.try_element_at("CountryCodes", F.lit(1)).alias("country"))
        enrich(e.checkpoint() if spark.sparkContext.getCheckpointDir() else e).write.mode("overwrite").parquet(a.out)
    else:
        edges = spark.read.parquet(a.edges)
        lineage.walks(edges, not a.down, a.depth, a.id).orderBy("depth", "node").show(1000, truncate=False)


if __name__ == "__main__":
    main()
