"""Command line: run one query file against a database directory, or serve the gateways.

    python -m tessera <database_dir> <query.sql> <output.csv> [--max-tuples=N] [--timeout-ms=N]
    python -m tessera serve <database_dir> [--port=8080] [--uploads]
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from tessera.budget import Budget
from tessera.errors import ErrorCode, QueryError
from tessera.plans.frontend import strip_explain
from tessera.session import Engine, QueryService
from tessera.sources.catalog import Catalog


def _limit(text: str) -> int:
    n = int(text)
    if n < 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return n


def session() -> SparkSession:
    return SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").getOrCreate()


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("database")
    p.add_argument("query")
    p.add_argument("output")
    p.add_argument("--max-tuples", type=_limit)
    p.add_argument("--timeout-ms", type=_limit)
    try:
        a = p.parse_args(argv)
    except SystemExit as ex:
        return int(bool(ex.code))
    try:
        try:
            with open(a.query, encoding="utf-8") as f:
                sql = f.read()
        except OSError as ex:
            raise QueryError(ErrorCode.DATA_ERROR, "The query file can't be read.") from ex
        spark = spark or session()
        engine = Engine(spark, Catalog.from_directory(spark, a.database))
        explain, text = strip_explain(sql)
        if explain:
            plan = engine.explain(text)
            os.makedirs(os.path.dirname(os.path.abspath(a.output)), exist_ok=True)
            with open(a.output, "w", encoding="utf-8") as f:
                f.write(plan)
        else:
            engine.write_csv(text, a.output, Budget(a.max_tuples, a.timeout_ms))
        return 0
    except QueryError as ex:
        print(f"Error: {ex}", file=sys.stderr)
        return 1


def serve(argv: list[str]) -> int:
    from tessera.gateway import Gateway, UploadSettings, make_server

    p = argparse.ArgumentParser(prog="tessera serve")
    p.add_argument("database")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8080)
    p.add_argument("--uploads", action="store_true")
    a = p.parse_args(argv)
    spark = session()
    service = QueryService(Engine(spark, Catalog.from_directory(spark, a.database)))
    make_server(Gateway(service, UploadSettings(a.uploads)), a.host, a.port).serve_forever()
    return 0


def main() -> int:
    return serve(sys.argv[2:]) if sys.argv[1:2] == ["serve"] else run(sys.argv[1:])
