"""What the query modules register: name -> query, and name -> checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Doubles rounded to 6 places, counts as bigint, timestamps without zone, dates as text: what both engines agree on."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind == "date":
            c = c.cast("string")
        elif kind == "timestamp":
            c = c.cast("timestamp_ntz")
        out.append(c.alias(name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # expressions take the zone when they are analysed, which is here
            zone = spark.conf.get("spark.sql.session.timeZone")
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            try:
                return plain(f(spark, sf_dir))
            finally:
                spark.conf.set("spark.sql.session.timeZone", zone)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return register
