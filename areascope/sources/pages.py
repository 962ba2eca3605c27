"""Landed API pages that may be broken or missing: quarantine, and chains of ``next`` links."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areascope.session import materialize, store

GOOD, CORRUPT, INCOMPLETE = "good", "corrupt", "incomplete"


@dataclass(frozen=True)
class Pages:
    """``good``: the parsed pages; ``quarantine``: (reason, file, page) of the others, as they landed."""

    good: DataFrame
    quarantine: DataFrame
    all: DataFrame


def sort_pages(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, required: Sequence[str], multi_line: bool = False) -> Pages:
    """Landed pages split into good ones and a quarantine, in one scan of the files.

    A page is one line, or a whole file with ``multi_line``; blank lines are none. It is ``corrupt`` if it is no JSON of the
    schema (cut off, a value of another type) and ``incomplete`` if a required field is missing (an error response).
    Both are stored by status, so good pages plus quarantined pages are all that landed, and a reader of one opens no file of
    the other.
    """
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path, wholetext=multi_line).select("value", F.col("_metadata.file_path").alias("file")) \
        .where(F.trim("value") != "")
    parsed = lines.withColumn("p", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    missing = F.exists(F.array(*[F.col(f"p.{c}").isNull() for c in required]), lambda m: m) if required else F.lit(False)
    status = F.when(F.col("p").isNull() | F.col("p._corrupt").isNotNull(), CORRUPT).when(missing, INCOMPLETE).otherwise(GOOD)
    stored = materialize(parsed.select(*[F.col(f"p.{f.name}").alias(f.name) for f in schema.fields], "file",
                                       F.when(status != GOOD, F.col("value")).alias("page"), status.alias("status")), "pages", ("status",))
    return Pages(stored.where(F.col("status") == GOOD).select(*schema.names),
                 stored.where(F.col("status") != GOOD).select(F.col("status").alias("reason"), "file", "page"), stored)


def follow_chains(requests: DataFrame, pages: DataFrame, first: str = "first_url", url: str = "url", link: str = "next") -> DataFrame:
    """For each row of ``requests`` (with the address ``first`` of its first page): ``pages_reached`` along the links,
    ``complete`` (the chain ends at a page without a link), and ``missing`` (the address that did not land; null for a complete
    chain and for one that runs in a circle).

    The chain is not walked: hops are doubled. Landed addresses get numbers first, so a round joins numbers and no text: every open
    page takes over the hop of the page it points to, and one whose hop came to the end is only looked up from then on. A chain
    of n pages takes log2(n) rounds of one join, each stored, however many requests there are. An address that
    landed more than once counts once (its smallest link; null, the end, only if no copy has one).
    """
    links = pages.where(F.col(url).isNotNull()).groupBy(F.col(url).alias("_at")).agg(F.min(link).alias("_to"))
    links = materialize(links.withColumn("_id", F.monotonically_increasing_id()), "links")
    targets = links.select(F.col("_at").alias("_to"), F.col("_id").alias("_hop"))
    numbered = links.join(targets, "_to", "left")
    # _hop: the landed page that _steps pages lead to, or null; then _last is the last landed page of the chain
    open_pages = {"open": F.count("_hop"), "all": F.count(F.lit(1))}
    step = store(numbered.select("_id", "_hop", F.lit(1).cast("long").alias("_steps"), F.when(F.col("_hop").isNull(), F.col("_id")).alias("_last")),
                 "hops", metrics=open_pages)
    # one for the doublings that a chain over all pages needs; a chain that is open after all of them is a circle
    for _ in range(max(1, step.metrics.get("all") or 0).bit_length() + 1):
        if not step.metrics.get("open"):
            break
        onward = step.df.select(F.col("_id").alias("_hop"), F.col("_hop").alias("_hop2"), F.col("_steps").alias("_steps2"), F.col("_last").alias("_last2"))
        moved = step.df.where(F.col("_hop").isNotNull()).join(onward, "_hop").select(
            "_id", F.col("_hop2").alias("_hop"), (F.col("_steps") + F.col("_steps2")).alias("_steps"), F.col("_last2").alias("_last"))
        step = store(moved.unionByName(step.df.where(F.col("_hop").isNull())), "hops", metrics=open_pages)
    heads = requests.join(links.select(F.col("_at").alias(first), "_id"), first, "left").join(step.df.select("_id", "_steps", "_last"), "_id", "left")
    out = heads.join(links.select(F.col("_id").alias("_last"), F.col("_to").alias("_missing")), "_last", "left")
    landed, closed = F.col("_id").isNotNull(), F.col("_last").isNotNull()
    return out.select(*requests.columns, F.when(~landed, F.lit(0).cast("long")).when(closed, F.col("_steps")).alias("pages_reached"),
                      (closed & F.col("_missing").isNull()).alias("complete"), F.when(~landed, F.col(first)).otherwise(F.col("_missing")).alias("missing"))
