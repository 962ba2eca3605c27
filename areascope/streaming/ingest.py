"""Incremental ingestion of landed API pages with Structured Streaming.

The reference pulls API pages in a driver loop and rewrites whole raw tables. Here a fetcher (out
of scope) lands each response page as a JSON file; a file-source stream picks up new pages, parses
and flattens them with the same batch code, and appends to the raw table with exactly-once file
sink semantics. ``availableNow`` processes everything landed so far and stops, so the job can run
on a schedule; the checkpoint records which files were consumed, so a restarted or retried job
neither loses nor duplicates pages. A page that lands again as another file is a new file to that
checkpoint; ``once`` knows it by its content.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from areascope.sources import ingest as ING

#: Spark's setting of how many versions of its keyed state an executor holds in memory.
RETAINED = "spark.sql.streaming.maxBatchesToRetainInMemory"


def distinct_pages(pages: DataFrame, within: str | None = None, keep: Mapping[str, Column] | None = None) -> DataFrame:
    """A stream of parsed pages with every page once, however often and under whatever names it lands.

    A page is known by the sha256 of its content, kept as keyed state (one row for each page, dealt over the shuffle
    partitions and checkpointed with the query, so a restarted job still knows it). Without ``within`` pages are known for ever;
    with it (e.g. '30 days' of file time) the state forgets pages that landed longer ago than that.
    ``pages`` needs the column ``landed`` (time of the file), which goes. With ``keep`` (name -> column) the result has these
    columns and only they are shuffled; the key is that of the whole page all the same."""
    content = [c for c in pages.columns if c != "landed"]
    key = F.unhex(F.sha2(F.to_json(F.struct(*content)), 256)).alias("_page")
    kept = [c.alias(name) for name, c in keep.items()] if keep else content
    keyed = pages.select(*kept, "landed", key)
    content = list(keep) if keep else content
    once = keyed.withWatermark("landed", within).dropDuplicatesWithinWatermark(["_page"]) if within else keyed.drop("landed").dropDuplicates(["_page"])
    return once.select(*content)


def _page_stream(spark: SparkSession, landing_dir: str, schema: T.StructType, max_files: int, multi_line: bool, once: bool, within: str | None,
                 keep: Mapping[str, Column] | None = None) -> DataFrame:
    pages = (spark.readStream.schema(schema).option("multiLine", multi_line).option("maxFilesPerTrigger", max_files).json(landing_dir))
    if not once:
        return pages
    return distinct_pages(pages.select(*schema.names, F.col("_metadata.file_modification_time").alias("landed")), within, keep)


def amenity_page_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int = 1000, multi_line: bool = True,
                        once: bool = False, within: str | None = None) -> DataFrame:
    """New points-of-interest API pages in ``landing_dir`` -> classified amenity rows; with ``once`` a page that
    lands again under another name adds nothing; only its classified elements are shuffled."""
    found = {"city": F.col("city"), "state_name": F.col("state_name"), "amenities": ING.classified_elements(F.col("elements"))}
    pages = _page_stream(spark, landing_dir, ING.AMENITY_RESPONSE_SCHEMA, max_files_per_trigger, multi_line, once, within, found if once else None)
    if not once:
        return ING.flatten_amenity_json(pages)
    return ING.flatten_classified(pages)


def school_page_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int = 1000, multi_line: bool = True,
                       once: bool = False, within: str | None = None) -> DataFrame:
    """New school-directory API pages -> regular-school records with derived ratios; ``once`` as above."""
    pages = _page_stream(spark, landing_dir, ING.SCHOOL_PAGE_SCHEMA, max_files_per_trigger, multi_line, once, within)
    return ING.derive_school_ratios(ING.filter_regular_schools(ING.flatten_school_json(pages)))


def append_to_table(stream: DataFrame, table_dir: str, checkpoint_dir: str, partition_by: tuple[str, ...] = (),
                    available_now: bool = True) -> StreamingQuery:
    """Append the stream to a parquet table folder (file sink: exactly-once via its metadata log).

    A run over what has landed (``available_now``) drops a partition's state from memory as soon as it is written, and the next batch
    reads it back from the checkpoint: memory has the keys of the partitions at work, not of all pages ever seen. A deployment that
    sets ``RETAINED`` itself keeps its setting."""
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("path", table_dir).option("checkpointLocation", checkpoint_dir))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if not available_now:
        return writer.trigger(processingTime="1 minute").start()
    conf = stream.sparkSession.conf
    unset = conf.get(RETAINED, None) is None
    if unset:
        conf.set(RETAINED, "0")
    try:
        return writer.trigger(availableNow=True).start()   # a query keeps the settings that it starts with
    finally:
        if unset:
            conf.unset(RETAINED)
