"""Releases of a wide panel, and raw tables of which single partitions are rewritten.

A publisher lands the panel anew each month: another file with another set of month columns, often with revised values. Each
file is read by its own header, every cell becomes a (area, month, value) row, and where releases give one cell more
than once the newest wins. Month by month the result goes into a raw table partitioned by month, whose other
partitions are left untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areascope.functions.keys import header_date, pad_zip
from areascope.session import materialize
from areascope.sources.ingest import PANEL_META_COLS, PANEL_RENAMES, ensure_schema

_BOM = "\ufeff"


def read_wide_releases(spark: SparkSession, paths: str | Sequence[str], value_name: str,
                       meta_cols: Sequence[str] = PANEL_META_COLS) -> DataFrame:
    """Long rows (metadata in snake_case as text, ``date``, value, ``release``) of any number of wide CSV files, each by its own header.

    A header is a line that starts with the first metadata column; every file must have one (a file without ends the job with its
    name). One pass over the lines finds the headers - one row for each file - and one pass of the CSV reader over the files
    joins them by file name and melts header and values into pairs. Columns may come in any order; a metadata column that a file
    lacks is null; a line shorter than its header has no values for the rest. ``release`` orders releases: last month of
    the header, time of the file, name. Empty cells make no rows.
    """
    first = meta_cols[0]
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    heads = materialize(lines.where(F.col("value").rlike(f'^{_BOM}?"?{first}"?(,|$)')), "headers")
    width = heads.agg(F.max(F.size(F.split("value", ",")))).first()[0]
    if width is None:
        raise ValueError(f"no file has a header that starts with {first}")
    names = [f"c{i}" for i in range(width)]
    schema = ", ".join(f"{c} string" for c in names)
    parsed = heads.groupBy("file").agg(F.from_csv(F.regexp_replace(F.min("value"), f"^{_BOM}", ""), schema).alias("h"))
    headers = parsed.select("file", F.array(*[F.col(f"h.{c}") for c in names]).alias("header"))
    rows = spark.read.schema(schema).csv(paths).select(F.array(*names).alias("cell"), F.col("_metadata.file_path").alias("file"),
                                                       F.col("_metadata.file_modification_time").alias("landed"))
    rows = rows.where(~F.regexp_replace(F.coalesce(F.col("cell")[0], F.lit("")), f"^{_BOM}", "").eqNullSafe(first))
    rows = rows.join(headers, "file", "left").withColumn("header", F.coalesce("header", F.raise_error(
        F.concat(F.lit("no header in "), F.col("file"))).cast("array<string>")))
    is_month = lambda p: p["header"].isNotNull() & ~p["header"].isin(*meta_cols)
    months = F.filter(F.arrays_zip("header", "cell"), is_month)
    place = {c: F.array_position("header", c).cast("int") for c in meta_cols}
    meta = [F.when(p > 0, F.element_at("cell", p)).alias(PANEL_RENAMES.get(c, c)) for c, p in place.items()]
    melted = rows.select(*meta, F.struct(F.array_max(F.transform(months, lambda p: p["header"])).alias("last_month"), "landed", "file").alias("release"),
                         F.explode(F.filter(months, lambda p: p["cell"].isNotNull())).alias("p"))
    out = melted.select("*", header_date(F.col("p.header")).alias("date"), F.col("p.cell").cast("double").alias(value_name)).drop("p")
    if "zip_code" in out.columns:
        out = out.withColumn("zip_code", pad_zip(F.col("zip_code")))
    return out.select(*[c for c in out.columns if c != "release"], "release")


def newest_wins(long: DataFrame, keys: Sequence[str] = ("region_id", "date"), order: str = "release") -> DataFrame:
    """One row for each key: that of the newest release. Combined before the one shuffle, by key, so an area in
    many releases is no hot group."""
    rest = [c for c in long.columns if c not in (*keys, order)]
    best = long.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_best"))
    return best.select(*keys, "_best.*").select(*[c for c in long.columns if c != order])


def write_raw_table(df: DataFrame, name: str, partition_by: Sequence[str] = (), rewrite: bool = False) -> DataFrame:
    """Write a raw table by name (``schema.table``) and read it back.

    Without ``rewrite`` the whole table is replaced. With it only the partitions that ``df`` has rows for are (dynamic partition
    overwrite): the files of all others stay as they are, and a job that fails leaves the old ones in place. The
    rows are rebalanced on the partition columns, so a month is some files of the advisory size, not one for each task.
    """
    spark = df.sparkSession
    schema, table = name.split(".")
    ensure_schema(spark, schema)
    path = f"{spark.catalog.getDatabase(schema).locationUri.rstrip('/')}/{table}"
    order = [c for c in df.columns if c not in partition_by] + list(partition_by)
    known = spark.catalog.tableExists(name)
    spread = df.select(*order).hint("rebalance", *partition_by) if partition_by else df
    writer = spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if rewrite else "static")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    if known and not rewrite:
        spark.sql(f"DROP TABLE {name}")                # the name only: the files belong to the folder
    if not (known and rewrite):
        columns = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in order)
        layout = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in partition_by)})" if partition_by else ""
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {layout} LOCATION '{path}'")
    if partition_by:
        spark.catalog.recoverPartitions(name)
    spark.catalog.refreshTable(name)
    return spark.table(name)
