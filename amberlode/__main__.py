"""The engine from a shell: `python -m amberlode list | run | import | export`."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from amberlode.functions import sql
from amberlode.plans import catalog
from amberlode.sources import imports, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="amberlode", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="the registered queries")
    run = sub.add_parser("run", help="a registered query over a folder of tables, or SQL over them")
    run.add_argument("query")
    run.add_argument("folder")
    run.add_argument("--out", help="write Parquet here; else show the first rows")
    load = sub.add_parser("import", help="a delimited file of a kind")
    load.add_argument("kind", choices=sorted(imports.KINDS))
    load.add_argument("path")
    load.add_argument("sources", help="Parquet with the registered source_uuid")
    load.add_argument("out", help="folder for accepted and rejected rows")
    out = sub.add_parser("export", help="a Parquet table as one JSON row per line")
    out.add_argument("table")
    out.add_argument("out")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return
    spark = spark or SparkSession.builder.appName("amberlode").getOrCreate()
    if args.command == "run":
        if args.query in catalog.QUERIES:
            found = catalog.QUERIES[args.query](spark, args.folder)
        else:
            sql.register(spark)
            for path in spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(args.folder).select("path").collect():  # names of tables
                spark.read.parquet(path.path).createOrReplaceTempView(path.path.rsplit("/", 1)[1].removesuffix(".parquet"))
            found = spark.sql(args.query)
        found.write.mode("overwrite").parquet(args.out) if args.out else found.show(truncate=False)
    elif args.command == "import":
        ok, bad = imports.import_csv(spark, args.kind, args.path, spark.read.parquet(args.sources))
        ok.write.mode("overwrite").parquet(f"{args.out}/accepted")
        bad.write.mode("overwrite").parquet(f"{args.out}/rejected")
    else:
        tables.export_jsonl(spark.read.parquet(args.table), args.out)


if __name__ == "__main__":
    main()
