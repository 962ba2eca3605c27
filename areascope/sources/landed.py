"""API-shaped documents derived from the benchmark tables, for exercising the JSON ingestion path
at scale: the same flattening code that reads landed API files reads these.

Each document is one "page" holding the lines of one order (at most 7 in the benchmark data), so
no group ever grows with the data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areascope.functions.keys import pad_zip
from areascope.session import ensure_checkpoint_dir
from areascope.sources.ingest import PANEL_RENAMES
from areascope.sources.adapter import SCHOOL_YEAR_SHIFT, dimension
from areascope.sources.tables import read_table

# Map-tag (key, value) given to each part type; STANDARD gets a tag that no
# rule classifies, so those elements are dropped.
PART_TYPE_TAGS = {
    "ECONOMY": ("leisure", "park"),
    "SMALL": ("shop", "supermarket"),
    "MEDIUM": ("amenity", "cinema"),
    "LARGE": ("amenity", "restaurant"),
    "PROMO": ("amenity", "marketplace"),
    "STANDARD": ("tourism", "hotel"),
}

#: Order numbers of one request of the chained pages, which bounds its pages.
CHAIN_ORDERS = 1000


def _case(col, mapping: dict, pick: int):
    expr = None
    for k, v in mapping.items():
        cond = col == F.lit(k)
        expr = F.when(cond, F.lit(v[pick])) if expr is None else expr.when(cond, F.lit(v[pick]))
    return expr


def amenity_documents(spark: SparkSession, sf_dir: str, dim: DataFrame | None = None) -> DataFrame:
    """JSON strings shaped like a points-of-interest API response: {city, state_name, elements: [...]}.
    Odd line numbers carry lat/lon on the element, even ones only in ``center``; every third line
    has no ``name`` tag."""
    dim = (dimension(spark, sf_dir) if dim is None else dim).select("s_suppkey", "city", "state_name")
    lines = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    j = lines.join(part, lines.l_partkey == part.p_partkey).join(dim, F.col("l_suppkey") == dim.s_suppkey)
    lat, lon = F.col("l_discount") * 100, F.col("l_tax") * 100
    odd = F.col("l_linenumber") % 2 == 1
    tag_key, tag_value = _case(F.col("p_type"), PART_TYPE_TAGS, 0), _case(F.col("p_type"), PART_TYPE_TAGS, 1)
    named = F.col("l_linenumber") % 3 != 0
    tags = F.when(named, F.map_from_arrays(F.array(tag_key, F.lit("name")), F.array(tag_value, F.col("p_name")))) \
            .otherwise(F.create_map(tag_key, tag_value))
    element = F.struct(
        F.when(odd, lat).alias("lat"),
        F.when(odd, lon).alias("lon"),
        F.when(~odd, F.struct(lat.alias("lat"), lon.alias("lon"))).alias("center"),
        tags.alias("tags"),
    )
    # a page's lines meet as their few columns and an element is text before it is collected; sorted by a number first, groups are found by it
    page = ["l_orderkey", "city", "state_name"]
    met = j.select(*page, "l_linenumber", "l_discount", "l_tax", "p_name", "p_type").repartition(*page).sortWithinPartitions(*page)
    pages = met.select(*page, F.to_json(element).alias("element")).groupBy(*page).agg(F.concat_ws(",", F.collect_list("element")).alias("elements"))
    empty = F.to_json(F.struct("city", "state_name", F.array().cast("array<string>").alias("elements")))
    return pages.select(F.concat(F.left(empty, F.length(empty) - 2), "elements", F.lit("]}")).alias("document"), F.col("l_orderkey").alias("page"))


def broken_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as a bad day lands them: pages 3, 13, 23... are cut off, pages 7, 17, 27... are error responses."""
    cut = F.substring("document", F.lit(1), (F.length("document") / 2).cast("int"))
    error = F.lit('{"remark": "runtime error: query timed out"}')
    return docs.withColumn("document", F.when(F.col("page") % 10 == 3, cut).when(F.col("page") % 10 == 7, error).otherwise(F.col("document")))


def land_documents(docs: DataFrame, name: str) -> str:
    """Write the documents as JSON Lines text files under the shared checkpoint folder (as a
    fetcher would land them, compressed) and return the folder."""
    path = f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/areascope/landed-{name}-{uuid.uuid4().hex}"
    write_pages(docs, path)
    return path


def write_pages(docs: DataFrame, path: str) -> None:
    """Add the documents to the folder ``path`` as gzip files of JSON Lines, which every text and JSON reader opens by their names.
    A file is one task's pages, so that readers share them out as the tasks did."""
    docs.select("document").write.mode("append").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def land_wide_csv(panel: DataFrame, value: str, name: str) -> str:
    """Write a long panel as the wide CSV that a publisher would land: one row per area, one column per
    month. The month columns run from the first to the last month of the panel (two scalars)."""
    first, last = panel.agg(F.min("date"), F.max("date")).first()
    months = [f"{y:04d}-{m:02d}-01" for y in range(first.year, last.year + 1) for m in range(1, 13)
              if (first.year, first.month) <= (y, m) <= (last.year, last.month)]
    names = {v: k for k, v in PANEL_RENAMES.items()}
    long = panel.select(*[F.col(k).alias(v) for k, v in names.items()], F.date_format("date", "yyyy-MM-dd").alias("_month"), value)
    wide = long.groupBy(*names.values()).pivot("_month", months).agg(F.max(value))
    path = f"{ensure_checkpoint_dir(panel.sparkSession).rstrip('/')}/areascope/landed-{name}-{uuid.uuid4().hex}"
    wide.write.mode("overwrite").option("header", True).csv(path)
    return path


def school_documents(spark: SparkSession, sf_dir: str, dim: DataFrame | None = None) -> DataFrame:
    """JSON strings shaped like school-directory API pages: {state, year, next, results: [...]}.
    Odd lines give a ZIP+4 mailing code, even ones only the location code; line 5 is no regular school."""
    dim = (dimension(spark, sf_dir) if dim is None else dim).select("s_suppkey", "zip_code", "city", "state")
    lines = read_table(spark, sf_dir, "lineitem")
    j = lines.join(dim, lines.l_suppkey == dim.s_suppkey)
    odd = F.col("l_linenumber") % 2 == 1
    rec = F.struct(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("ncessch"),
        F.concat(F.lit("School "), F.col("l_orderkey").cast("string")).alias("school_name"),
        F.when(odd, F.concat(F.col("zip_code"), F.lit("-"), F.lpad(F.col("l_linenumber").cast("string"), 4, "0"))).alias("zip_mailing"),
        F.col("zip_code").alias("zip_location"),
        F.col("city").alias("city_location"),
        F.col("l_linenumber").cast("string").alias("school_level"),
        F.when(F.col("l_linenumber") == 5, F.lit(2)).otherwise(F.lit(1)).alias("school_type"),
        F.col("l_quantity").alias("enrollment"),
        (F.col("l_tax") * 100).alias("teachers_fte"),
        F.floor(F.col("l_quantity") * F.col("l_discount")).cast("double").alias("free_or_reduced_price_lunch"),
        (F.col("l_returnflag") == "A").cast("int").alias("charter"),
        (F.col("l_returnflag") == "R").cast("int").alias("magnet"),
    )
    year = (F.year("l_shipdate") + SCHOOL_YEAR_SHIFT).cast("int")
    pages = j.groupBy(F.col("state"), year.alias("year"), F.col("l_orderkey")).agg(F.collect_list(rec).alias("results"))
    doc = F.struct("state", "year", F.lit(None).cast("string").alias("next"), F.col("results"))
    return pages.select(F.to_json(doc).alias("document"))


def school_chains(spark: SparkSession, sf_dir: str, dim: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(requests, pages): (request, first_url), and (request, url, next) of the pages that landed. A request is a state, a school
    year and a block of ``CHAIN_ORDERS`` order numbers, a page one of its orders in turn; of every 37 orders one page got lost."""
    dim = (dimension(spark, sf_dir) if dim is None else dim).select("s_suppkey", "state")
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    year = (F.year("l_shipdate") + SCHOOL_YEAR_SHIFT).cast("int")
    j = lines.join(dim, lines.l_suppkey == dim.s_suppkey)
    request = F.concat_ws("/", "state", year.cast("string"), F.floor(F.col("l_orderkey") / CHAIN_ORDERS).cast("string"))
    # one shuffle by request serves the distinct orders and their turns
    orders = j.select(request.alias("request"), "l_orderkey").repartition("request").distinct()
    turn = Window.partitionBy("request").orderBy("l_orderkey")
    pages = orders.select("request", "l_orderkey", F.row_number().over(turn).alias("k"), F.lead("l_orderkey").over(turn).isNotNull().alias("more"))
    address = lambda k: F.concat_ws("/", "request", k.cast("string"))
    pages = pages.select("request", "l_orderkey", address(F.col("k")).alias("url"), F.when(F.col("more"), address(F.col("k") + 1)).alias("next"))
    requests = orders.select("request", F.concat_ws("/", "request", F.lit("1")).alias("first_url")).distinct()
    return requests, pages.where(F.col("l_orderkey") % 37 != 5).drop("l_orderkey")


def nation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A (state, code) lookup from the nation table, one row per nation."""
    return read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("state"), F.col("n_nationkey").alias("fips_code"))


def order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mailing/location code pairs from orders: finished orders carry a ZIP+4 style mailing code."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    mailing = F.when(F.col("o_orderstatus") == "F",
                     F.concat(F.col("o_custkey").cast("string"), F.lit("-"), (F.col("o_orderkey") % 10000).cast("string")))
    return o.select("o_orderkey", mailing.alias("mailing"), F.col("o_orderkey").cast("string").alias("location"),
                    pad_zip(F.col("o_custkey")).alias("cust_zip"))
