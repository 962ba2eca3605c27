"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Ring. Every shard has ``vnodes`` virtual nodes on a ring of 65,536 positions; a key's position is the
head of its md5, its home the first virtual node clockwise. The ring depends on the parameters alone.

Bounded loads. With ``load_factor`` c a shard takes ceil(c * rows / shards) rows; with 1.0 (the default)
room is divided exactly, so counts are at most one apart. Keys for which a shard has no room go on
clockwise to the next shard with room. This is done in rounds: in round k each arc of the ring offers
what it has left to the k-th shard clockwise from it, and the shard takes the offers in ring order as far as it
has room. Keys at home come first, so no key is moved that need not be. After as many rounds
as shards all is placed, for an arc that is refused everywhere would mean that every shard is full.

How it runs. Rounds work on arcs (``shards * vnodes`` counts, one bounded row), not on keys: the result is
a list of pieces (arc, ranks from..to, shard, first slot). A row finds its rank in its cell by a window
and its piece by a join on the cell, which uses the same partitioning. So rows are shuffled once, without text, in 65,536 cells; the
largest group has a 65,536th of the keys.

``shards * vnodes`` should stay below a few thousand, as the rounds run in one task.

Defined results: the key is the id, and for null ids also size and checksum; a null text counts as no bytes;
repeated rows get places of their own, next to each other; an empty table gives an empty result; all other columns are carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areascope.llm.common import cell_of, hashed_key, text_or_empty

SHARDS, VNODES, LOAD_FACTOR, SALT = 8, 64, 1.0, "ring"
#: Positions on the ring: 16 ** DIGITS.
DIGITS = 4


def ring(shards: int, vnodes: int, salt: str = SALT) -> list[tuple[int, int, list[int]]]:
    """Arcs as (position of the virtual node that ends the arc, shard, shards by clockwise distance). Depends
    on the parameters alone, not on data."""
    at = sorted((int(hashlib.md5(f"{salt}|{s}#{v}".encode()).hexdigest()[:DIGITS], 16), s) for s in range(shards) for v in range(vnodes))
    arcs, seen = [], set()
    for i, (position, shard) in enumerate(at):
        if position in seen:  # two virtual nodes at one position: the smaller shard has it
            continue
        seen.add(position)
        order = list(dict.fromkeys(s for _, s in at[i:] + at[:i]))
        arcs.append((position, shard, order))
    return arcs


def _rounds(arcs: int, shards: int) -> str:
    """SQL for the pieces, from ``n`` (rows of each arc), ``pref`` (its shards by distance) and ``room``."""
    take = "least(u.left[a], u.room[pref[a][k]])"
    return f"""aggregate(sequence(0, {shards - 1}),
        named_struct('room', room, 'left', n, 'pieces', cast(array() as array<struct<arc: int, shard: int, lo: bigint, hi: bigint, slot: bigint>>)),
        (v, k) -> aggregate(sequence(0, {arcs - 1}), v, (u, a) ->
            if(u.left[a] = 0 or u.room[pref[a][k]] = 0, u, named_struct(
                'room', transform(u.room, (r, s) -> if(s = pref[a][k], r - {take}, r)),
                'left', transform(u.left, (l, i) -> if(i = a, l - {take}, l)),
                'pieces', concat(u.pieces, array(named_struct('arc', a, 'shard', pref[a][k],
                    'lo', n[a] - u.left[a], 'hi', n[a] - u.left[a] + {take}, 'slot', room[pref[a][k]] - u.room[pref[a][k]])))))),
        v -> v.pieces)"""


def place(counts: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, load_factor: float = LOAD_FACTOR,
          salt: str = SALT) -> DataFrame:
    """From ``counts`` (cell, rows): each cell with its offset in its arc and the arc's pieces."""
    arcs = ring(shards, vnodes, salt)
    spark = counts.sparkSession
    last = arcs[-1][0]
    # an arc owns the positions after the node before it up to its own; the first also those beyond the last
    starts = [0] + [p + 1 for p, _, _ in arcs[:-1]]
    spans = [(i, home, starts[i], p) for i, (p, home, _) in enumerate(arcs)]
    spans += [(0, arcs[0][1], last + 1, 16 ** DIGITS - 1)] if last < 16 ** DIGITS - 1 else []
    table = spark.createDataFrame(spans, "arc int, home int, lo int, hi int")
    cells = table.select("arc", "home", F.explode(F.sequence("lo", "hi")).alias("cell"))
    counts = counts.join(cells, "cell")
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    per_arc = counts.groupBy("arc").agg(F.sum("rows").alias("rows"))
    pref = "array(" + ", ".join("array(" + ", ".join(map(str, o)) + ")" for _, _, o in arcs) + ")"
    if load_factor == 1.0:
        room = f"transform(sequence(0, {shards - 1}), s -> total div {shards} + if(s < total % {shards}, 1L, 0L))"
    else:
        room = f"array_repeat(cast(ceil(cast({load_factor} as decimal(10,6)) * total / {shards}) as bigint), {shards})"
    one = per_arc.agg(F.map_from_entries(F.collect_list(F.struct("arc", "rows"))).alias("m"), F.sum("rows").alias("total"))
    one = one.where("total is not null").select(
        F.expr(f"transform(sequence(0, {len(arcs) - 1}), a -> coalesce(m[a], 0L))").alias("n"),
        F.expr(pref).alias("pref"), F.expr(room).alias("room"))
    pieces = one.select(F.explode(F.expr(_rounds(len(arcs), shards))).alias("p")).select("p.*")
    pieces = pieces.groupBy("arc").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "shard", "slot"))).alias("pieces"))
    return counts.join(pieces, "arc").select("cell", "home", "offset", "pieces")


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, vnodes: int = VNODES,
          load_factor: float = LOAD_FACTOR, salt: str = SALT, carry: Sequence[str] | None = None) -> DataFrame:
    """One row for each document: ``row`` (a struct of the input columns, or of ``carry``), ``size`` (bytes of the text plus 1), ``text_crc32``,
    ``shard``, ``slot`` (gapless from 0 in the shard) and ``home`` (the shard of its first virtual node)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row"), F.col(doc_id).alias("doc_id"),
                       (F.octet_length(text_or_empty(text)) + 1).cast("long").alias("size"),
                       F.crc32(text_or_empty(text).cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("key", F.when(F.col("doc_id").isNull(), hashed_key(salt, "doc_id", "size", "text_crc32"))
                           .otherwise(hashed_key(salt, "doc_id"))) \
        .withColumn("cell", cell_of(F.col("key"), DIGITS))
    cells = place(rows.groupBy("cell").agg(F.count("*").alias("rows")), shards, vnodes, load_factor, salt)
    in_cell = Window.partitionBy("cell").orderBy("key", "doc_id", "size", "text_crc32")
    rows = rows.withColumn("rank", (F.row_number().over(in_cell) - 1).cast("long"))
    out = rows.join(cells, "cell").withColumn("rank", F.col("rank") + F.col("offset"))
    out = out.withColumn("piece", F.expr("element_at(filter(pieces, p -> rank < p.hi), 1)"))
    return out.select("row", "size", "text_crc32", F.col("piece.shard").alias("shard"),
                      (F.col("piece.slot") + F.col("rank") - F.col("piece.lo")).alias("slot"),
                      "home")


def sharded_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, which replace input columns of these names."""
    placed = shard(docs, doc_id, text, **options)
    keep = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return placed.select(*keep, "shard", "slot")


def write_shards(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", **options) -> None:
    """Write the documents as one folder for each shard, files in slot order; a shard is spread over
    several tasks by ranges of slots."""
    placed = sharded_documents(docs, doc_id, text, **options)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot") \
        .write.mode("overwrite").partitionBy("shard").parquet(path)
