"""Registered queries: each operator on the derived tables, with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The derived tables of one directory, built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in fixtures.SQL:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = fixtures.table(self.spark, self.sf_dir, name)
        return self._made[name]

    def file(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def register(name: str, needs: str = "", sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register a function of :class:`Tables`. ``sql`` may start with a comma to add common table
    expressions; its last SELECT is rounded in the columns ``doubles``."""

    def add(make: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(make(Tables(spark, sf_dir)), digits)
        if sql:
            head, mark, last = sql.rpartition("---")
            cut = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split())
            last = f"SELECT * REPLACE ({cut}) FROM ({last}) q" if cut else last
            ORACLE[name] = fixtures.oracle(needs, head + "\n" + last) if needs else last
        return make

    return add


def profile(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Count, least, largest and mean of columns by ``keys``."""
    out = []
    for c in columns:
        out += [F.count(c).alias(f"{c}_n"), F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"), F.avg(c).alias(f"{c}_mean")]
    return df.groupBy(*keys).agg(*out)


def profile_sql(source: str, keys: str, *columns: str) -> str:
    out = ", ".join(f"count({c}) AS {c}_n, min({c}) AS {c}_lo, max({c}) AS {c}_hi, avg({c}) AS {c}_mean" for c in columns)
    return f"SELECT {keys}, {out} FROM {source} GROUP BY {keys}"


def profile_doubles(*columns: str) -> str:
    return " ".join(f"{c}_{x}" for c in columns for x in ("lo", "hi", "mean"))


def iou_sql(a: str = "a", b: str = "b") -> str:
    """SQL of the overlap of the boxes of two aliases."""
    both = f"(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0.0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0.0))"
    each = lambda t: f"(({t}.x2 - {t}.x1) * ({t}.y2 - {t}.y1))"
    return f"CASE WHEN {each(a)} + {each(b)} - {both} > 0 THEN {both} / ({each(a)} + {each(b)} - {both}) ELSE 0.0 END"


def project_sql(x: str, y: str, scale: float = 10.0, h: str = "") -> tuple[str, str]:
    c = [f"{h}h{i}" for i in range(9)]
    w = f"({c[6]} * {x} + {c[7]} * {y} + {c[8]})"
    return tuple(f"CASE WHEN abs({w}) >= 1e-8 THEN ({c[i]} * {x} + {c[i + 1]} * {y} + {c[i + 2]}) / {w} / {scale} END" for i in (0, 3))
