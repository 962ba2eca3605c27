"""Many-to-many joins with hot keys: the keys that hold a large share of one side are found by a count, that side is dealt over
as many parts as the key needs, and the other side is repeated for each part - of the hot keys only.

Adaptive execution splits a skewed partition too, but only between the blocks that map tasks wrote, not where one key is also
many rows on the other side: a city with a third of the amenities and a thousand postal codes makes a task whose output is the
product. Here the output of a key is dealt evenly by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areascope.session import materialize

#: A key is hot if its output is more than this many rows; a part of it makes about so many.
PART_ROWS = 1_000_000


def expanding_join(facts: DataFrame, lookup: DataFrame, on: Sequence[str], part_rows: int = PART_ROWS) -> DataFrame:
    """``facts.join(lookup, on)`` (inner, null keys drop), where no task makes much more than ``part_rows`` rows of one key.

    Both sides are counted by key (combined map-side). A key whose output exceeds ``part_rows`` gets ceil(output / part_rows) parts: its
    facts go to part 0, 1, ... by their hash, its lookup rows to every part. The table of hot keys has at most
    output / part_rows rows; which join brings the parts to the rows is left to the planner.
    """
    on = list(on)
    n_facts = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_facts"))
    n_lookup = lookup.groupBy(*on).agg(F.count(F.lit(1)).alias("_lookup"))
    parts = F.least(F.ceil(F.col("_facts") * F.col("_lookup") / F.lit(part_rows)), F.col("_facts")).cast("int")
    hot = materialize(n_facts.join(n_lookup, on).select(*on, parts.alias("_parts")).where("_parts > 1"), "hot-keys")
    spread = facts.withColumn("_salt", F.monotonically_increasing_id()).join(hot, on, "left") \
        .withColumn("_part", F.coalesce(F.pmod(F.col("_salt"), F.col("_parts")), F.lit(0)).cast("int")).drop("_salt", "_parts")
    copies = lookup.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return spread.join(copies, [*on, "_part"]).drop("_part")
