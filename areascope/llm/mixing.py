"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets. Sources in code-point order (null last) weigh 3, 1, 2, 3, 1, 2, ... and share
``share`` times all words. A source may be repeated ``max_epochs`` times; what it cannot take is
shared again by weight until no source is above its ceiling (solved in closed form, see ``targets``).

Blocks. The documents of a source, in the order of an md5 key, form its word stream; the stream is
read ``max_epochs`` times at most and cut into blocks of ``block_words`` words. The source's quota is
its target in whole words, that is a number of blocks of which the last may be short. So at most one
document of a source is taken in part, and the words taken equal the rounded target.

Splitting tree. The quota vector (blocks for each source) of all output shards is split between the
left and right half of the shards, and so on down to single shards. How many of the blocks on the left
come from each source is drawn from the multivariate hypergeometric law, as a sequence of conditional
hypergeometric draws by inversion. Every shard thus gets the composition that a random permutation of
all blocks would give it, though no such permutation is ever made: the tree works on
(source, blocks) quotas only. Shard k then draws a range of the source's permuted block numbers,
``(a * block + c) mod blocks``, disjoint from the ranges of the other shards, and reads them in the
order of ``order_key`` (a local shuffle).

Scale. Text is read for its word count and never shuffled by the query. Prefix sums are taken in
cells (16 ** 3 for each source by key), so a source with a third of all rows is spread over thousands
of groups; what is per source (sums, targets, quotas, tree) is one row for each source. Only the
number of sources is assumed to fit one row.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own; null or
repeated ids are rows of their own (equal rows swap places freely); an empty table gives an empty
result; other columns are ignored or, in ``mixed_documents``, carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areascope.llm.common import cell_of, hashed_key, n_words, text_or_empty
from areascope.session import materialize

#: Fixed values of the mix: weights by source rank, share of all words, most reads of a document.
WEIGHTS, SHARE, MAX_EPOCHS = (3, 1, 2), 1.5, 2
#: Words in a block, output shards, hex digits of a cell, salt of all keys.
BLOCK_WORDS, SHARDS, CELL_DIGITS, SALT = 4096, 8, 3, "mix"
#: A prime above any block count; the step of the affine block permutation.
STEP_PRIME = 2_147_483_647


def targets(sums: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sums`` (source, source_size) with ``target``.

    Sharing the excess again and again ends where target = min(ceiling, level * weight) and the
    targets add up to the total. A source ends at its ceiling exactly when the level r = ceiling /
    weight at which it does needs no more than the total: sum of min(ceiling_j, r * weight_j) <= total.
    The windows run over one row for each source.
    """
    w_list = "array(" + ", ".join(str(float(w)) for w in weights) + ")"
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    s = sums.withColumn("rank", F.row_number().over(rank) - 1)
    s = s.withColumn("weight", F.expr(f"element_at({w_list}, cast(rank % {len(weights)} + 1 as int))"))
    s = s.withColumn("ceiling", F.col("source_size") * float(max_epochs)) \
        .withColumn("level", F.col("ceiling") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0))
    upto = Window.partitionBy(F.lit(0)).orderBy("level").rangeBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("total", F.sum("source_size").over(everything) * float(share)) \
        .withColumn("ceilings", F.sum("ceiling").over(upto)) \
        .withColumn("weights_above", F.sum("weight").over(everything) - F.sum("weight").over(upto))
    s = s.withColumn("full", F.col("ceilings") + F.col("level") * F.col("weights_above") <= F.col("total"))
    s = s.withColumn("full_sum", F.sum(F.when(F.col("full"), F.col("ceiling")).otherwise(0.0)).over(everything)) \
        .withColumn("open_weight", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything))
    return s.select(
        "source", "source_size", "rank",
        F.when(F.col("full"), F.col("ceiling"))
        .otherwise((F.col("total") - F.col("full_sum")) * F.col("weight") / F.col("open_weight")).alias("target"))


def _let(names: dict[str, str], body: str) -> str:
    """SQL that binds expressions to the fields of ``b`` and evaluates ``body`` with them."""
    fields = ", ".join(f"'{k}', {v}" for k, v in names.items())
    return f"transform(array(named_struct({fields})), b -> {body})[0]"


def _log_factorial(x: str) -> str:
    """SQL for ln(x!) of x >= 0: Stirling's series at x + 8, stepped down; exact to about 1e-11."""
    steps = " * ".join(["f"] + [f"(f - {i})" for i in range(1, 8)])
    return (f"transform(array(cast({x} as double) + 8), f -> f * ln(f) - f + 0.5D * ln(6.283185307179586D * f) + 1 / (12 * f)"
            f" - 1 / (360 * pow(f, 3)) + 1 / (1260 * pow(f, 5)) - ln({steps}))[0]")


def _log_choose(n: str, k: str) -> str:
    return f"({_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'({n} - {k})')})"


def _hypergeometric(marked: str, others: str, draws: str, u: str) -> str:
    """SQL for a hypergeometric draw by inversion of the uniform ``u``: how many of ``draws`` blocks
    drawn without return are among ``marked`` ones, with ``others`` besides.

    The sum runs over ten standard deviations around the mean (what lies beyond has less probability
    than a double can show) by the ratio of neighbouring terms.
    """
    step = "h.p * cast(b.a - k as double) * cast(b.d - k as double) / (cast(k + 1 as double) * cast(b.o - b.d + k + 1 as double))"
    first = f"exp({_log_choose('b.a', 'b.low')} + {_log_choose('b.o', '(b.d - b.low)')} - {_log_choose('(b.a + b.o)', 'b.d')})"
    search = (f"aggregate(sequence(b.low, b.high), named_struct('p', {first}, 'sum', 0.0D, 'got', cast(null as bigint)),"
              f" (h, k) -> named_struct('p', {step}, 'sum', h.sum + h.p, 'got', if(h.got is null and h.sum + h.p >= b.u, k, h.got)),"
              f" h -> coalesce(h.got, b.high))")
    same = {k: f"b.{k}" for k in ("a", "o", "d", "u")}
    ends = _let({**same, "low": "greatest(0L, b.d - b.o, cast(floor(b.mean - 10 * b.dev) as bigint) - 2L)",
                 "high": "least(b.a, b.d, cast(ceil(b.mean + 10 * b.dev) as bigint) + 2L)"}, search)
    spread = _let({**same, "mean": "b.mean", "dev": "sqrt(b.mean * greatest(b.o, 0) / greatest(b.a + b.o, 1) + 1.0D)"}, ends)
    middle = _let({**same, "mean": "cast(b.d as double) * b.a / greatest(b.a + b.o, 1)"}, spread)
    return _let({"a": marked, "o": others, "d": draws, "u": u}, middle)


def splitting_tree(sources: DataFrame, shards: int = SHARDS, salt: str = SALT) -> DataFrame:
    """Split ``sources`` (source, rank, blocks) among ``shards``: (source, bounds), where ``bounds`` has
    for each shard the end of its range of the source's permuted block numbers.

    A node is one row: its shards and its quota vector. Each level draws the left child's vector from
    the node's; the right child gets the rest. Shards get totals at most one block apart.
    """
    node = sources.agg(F.array_sort(F.collect_list(F.struct("rank", F.col("blocks").alias("n")))).alias("quota"))
    total = "aggregate(quota, 0L, (t, q) -> t + q.n)"
    node = node.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "quota", F.expr(total).alias("total"))
    node = node.select("lo", "hi", "quota", F.expr(
        f"transform(sequence(0, {shards - 1}), i -> total div {shards} + if(i < total % {shards}, 1L, 0L))").alias("rooms"))
    width = shards
    while width > 1:
        u = f"((conv(substr(md5(concat_ws('|', '{salt}', lo, hi, q.rank)), 1, 12), 16, 10) + 0.5D) / 281474976710656.0D)"
        draw = _hypergeometric("q.n", "(v.rest - q.n)", "v.room", u)
        # the draw is needed twice in the next state, so a transform binds it to a name once
        left = (f"aggregate(quota, named_struct('room', aggregate(slice(rooms, 1, mid - lo), 0L, (t, r) -> t + r),"
                f" 'rest', {total}, 'got', cast(array() as array<bigint>)),"
                f" (v, q) -> transform(array({draw}), x -> named_struct('room', v.room - x, 'rest', v.rest - q.n,"
                f" 'got', concat(v.got, array(x))))[0], v -> v.got)")
        split = node.withColumn("mid", F.expr("if(hi - lo > 1, lo + (hi - lo + 1) div 2, hi)")) \
            .withColumn("left", F.expr(f"if(mid = hi, transform(quota, q -> q.n), {left})"))
        halves = ("array(named_struct('lo', lo, 'hi', mid, 'quota', transform(quota, (q, i) -> named_struct('rank', q.rank, 'n', left[i])),"
                  " 'rooms', slice(rooms, 1, mid - lo)),"
                  " named_struct('lo', mid, 'hi', hi, 'quota', transform(quota, (q, i) -> named_struct('rank', q.rank, 'n', q.n - left[i])),"
                  " 'rooms', slice(rooms, mid - lo + 1, hi - mid)))")
        # one row for each node: a small table between levels keeps the plan of a level small
        node = materialize(split.select(F.explode(F.expr(f"filter({halves}, h -> h.hi > h.lo)")).alias("h")).select("h.*"), "tree")
        width = (width + 1) // 2
    leaves = node.select(F.col("lo").alias("shard"), F.explode("quota").alias("q"))
    bounds = leaves.groupBy(F.col("q.rank").alias("rank")).agg(
        F.array_sort(F.collect_list(F.struct("shard", F.col("q.n").alias("n")))).alias("leaf"))
    return bounds.select("rank", F.expr(
        "transform(leaf, (l, i) -> aggregate(slice(leaf, 1, i + 1), 0L, (t, x) -> t + x.n))").alias("bounds"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
        block_words: int = BLOCK_WORDS, shards: int = SHARDS, salt: str = SALT,
        carry: Sequence[str] | None = None) -> DataFrame:
    """The mix, one row for each document: ``row`` (a struct of the input columns, or of ``carry``), ``size``, ``source_size``,
    ``target``, ``taken`` and ``spans``, an array of (epoch, block, shard, from_word, to_word, order_key):
    the word ranges of the document that the mix takes and the shard that gets each."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row"),
                       F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"))
    rows = rows.withColumn("key", hashed_key(salt, "doc_id")) \
        .withColumn("key", F.when(F.col("doc_id").isNull(), F.md5(F.concat_ws("|", "key", "size"))).otherwise(F.col("key"))) \
        .withColumn("cell", cell_of(F.col("key"), CELL_DIGITS))
    cells = materialize(rows.groupBy("source", "cell").agg(F.sum("size").alias("words")), "mix-cells")
    sums = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = targets(sums, weights, share, max_epochs) \
        .withColumn("quota", F.least(F.round("target").cast("long"), F.col("source_size") * max_epochs)) \
        .withColumn("blocks", F.ceil(F.col("quota") / F.lit(block_words)).cast("long")) \
        .withColumn("step", F.lit(STEP_PRIME) % F.greatest(F.col("blocks"), F.lit(1))) \
        .withColumn("shift", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), "rank")), 1, 8), 16, 10).cast("long"))
    goal = materialize(goal, "mix-goal")
    goal = materialize(goal.join(splitting_tree(goal, shards, salt), "rank"), "mix-tree")          # one row for each source
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    info = cells.join(goal, cells["source"].eqNullSafe(goal["source"])).select(
        cells["source"].alias("s"), F.col("cell").alias("c"), "cell_start", "source_size", "target", "quota", "blocks",
        "step", "shift", "bounds")
    in_cell = Window.partitionBy("source", "cell").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("in_cell", F.coalesce(F.sum("size").over(in_cell), F.lit(0)))
    out = rows.join(info, rows["source"].eqNullSafe(info["s"]) & (rows["cell"] == info["c"])) \
        .withColumn("start", F.col("cell_start") + F.col("in_cell"))
    # epoch by epoch: the part of the document below the quota, cut at block ends
    spans = f"""filter(flatten(transform(sequence(0, {max_epochs - 1}), e ->
        transform(sequence((start + e * source_size) div {block_words},
                           greatest(start, start + size - 1) div {block_words} + (e * source_size) div {block_words} + 1), b ->
            named_struct('epoch', e, 'block', b,
                'from_word', greatest(0L, b * {block_words} - start - e * source_size),
                'to_word', least(size, (b + 1) * {block_words} - start - e * source_size, quota - start - e * source_size))))),
        x -> x.to_word > x.from_word)"""
    # a block beyond the last shard's range is nobody's, so what is taken follows from the tree
    placed = f"""filter(transform(spans, x -> named_struct('epoch', x.epoch, 'block', x.block,
        'shard', aggregate(bounds, 0, (n, z) -> n + if(z <= (x.block % blocks * step + shift) % blocks, 1, 0)),
        'from_word', x.from_word, 'to_word', x.to_word,
        'order_key', md5(concat_ws('|', '{salt}', doc_id, x.epoch, x.block)))), x -> x.shard < {shards})"""
    out = out.withColumn("spans", F.expr(spans)).withColumn("spans", F.expr(placed))
    return out.select("row", "size", "source_size", "target",
                      F.expr("aggregate(spans, 0L, (t, x) -> t + x.to_word - x.from_word)").alias("taken"), "spans")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as documents: the columns of ``docs``, one row for each reading of a document. The one
    document of a source at which its quota ends is cut there, at a word's end."""
    plan = mix(docs, doc_id, text, source, **options)
    reads = plan.select("row", "size", F.explode(F.expr(
        "transform(array_distinct(transform(spans, x -> x.epoch)), e ->"
        " aggregate(filter(spans, x -> x.epoch = e), 0L, (t, x) -> greatest(t, x.to_word)))")).alias("upto"))
    cut = F.expr(r"array_join(slice(split(row.`" + text + r"`, '(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])'), 1, "
                 r"cast(upto as int) + if(row.`" + text + r"` rlike '^[\\x20\\x09-\\x0D]', 1, 0)), '')")
    kept = F.when(F.col("upto") >= F.col("size"), F.col(f"row.`{text}`")).otherwise(cut)
    return reads.select(*[(kept if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def write_mix(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", source: str = "source",
              shards: int = SHARDS, **options) -> None:
    """Write the spans as one folder for each output shard, every file in the shard's shuffled order."""
    plan = mix(docs, doc_id, text, source, shards=shards, **options)
    spans = plan.select(F.col(f"row.`{doc_id}`").alias("doc_id"), F.col(f"row.`{text}`").alias("text"),
                        F.explode("spans").alias("x")).select("doc_id", "text", "x.*")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    spans.repartition(parts * shards, "shard", F.substring("order_key", 1, 4)) \
        .sortWithinPartitions("shard", "order_key").write.mode("overwrite").partitionBy("shard").parquet(path)


__all__ = ["mix", "mixed_documents", "write_mix", "targets", "splitting_tree", "text_or_empty"]
