"""Helpers shared by the operators: word counting, key columns, small literal tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run of characters that are neither space nor TAB..CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Decimal digits and letters of both cases, for translate().
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def map_arrow(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``df.mapInArrow(fn, schema)`` with this package's folder on the Python path of the tasks (clusters
    that ship the package with the job have it there anyway)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])
    return df.mapInArrow(fn, schema)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named by position (c0, c1, ...), so that none clashes with an operator's own."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def renamed(df: DataFrame, names: Sequence[str], *new: str) -> DataFrame:
    """The numbered columns of ``df`` under their names again, and ``new`` ones; a new one replaces an
    input column of its name."""
    keep = [F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n not in new]
    return df.select(*keep, *new)


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def n_words(text: str) -> Column:
    """Number of words of a text column, 0 for null."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def hashed_key(salt: str, *cols: str) -> Column:
    """An md5 hex key of a salt and columns: the same in every run, engine and partitioning."""
    parts = [F.lit(salt)] + [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def cell_of(key: Column, digits: int) -> Column:
    """The first hex digits of an md5 key as an integer: 16 ** digits cells in key order."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("int")


def sql_array(values: Sequence, kind: str) -> str:
    """A SQL array literal of numbers."""
    return f"cast(array({', '.join(str(v) for v in values)}) as array<{kind}>)"
