"""The registered queries of the operators: thin digests of what the operators return."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

import corpus_pipeline
from areascope.llm.common import read

LLM_QUERIES, LLM_ORACLE = {}, {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_ORACLE[name] = sql
        return fn
    return deco


@register("op2_bounded_load_ring")
def op2(spark, sf_dir):
    """Documents on a bounded-load ring of 8 shards; the law kept is `rows`."""
    from areascope.llm import sharding

    placed = sharding.shard(read(spark, sf_dir, "documents"), carry=["doc_id"])
    return placed.select("row.doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                         "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("home").alias("home_shard"))


_OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rn, doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
l AS (SELECT *, [3.0, 1.0, 2.0][CAST(rank % 3 + 1 AS INT)] AS weight, 2.0 * source_size AS ceiling,
             1.5 * sum(source_size) OVER () AS total FROM w),
f AS (SELECT a.*, (SELECT sum(least(b.ceiling, a.ceiling / a.weight * b.weight)) FROM l b) <= a.total AS filled FROM l a),
t AS (SELECT source, source_size, rank, CASE WHEN filled THEN ceiling
             ELSE (total - coalesce(sum(ceiling) FILTER (filled) OVER (), 0)) * weight / sum(weight) FILTER (NOT filled) OVER () END AS target
      FROM f),
g AS MATERIALIZED (SELECT *, least(CAST(round(target) AS BIGINT), 2 * source_size) AS quota,
             CAST(ceil(least(CAST(round(target) AS BIGINT), 2 * source_size) / {block}) AS BIGINT) AS blocks,
             CAST('0x' || substr(md5('mix|' || rank), 1, 8) AS BIGINT) AS shift FROM t),
n0 AS (SELECT 0 AS lo, {shards} AS hi, rank, blocks AS n FROM g),{levels}
e AS (SELECT rank, list(upto ORDER BY lo) AS bounds
      FROM (SELECT rank, lo, CAST(sum(n) OVER (PARTITION BY rank ORDER BY lo) AS BIGINT) AS upto FROM n{depth}) GROUP BY rank),
p AS (SELECT d.rn, d.doc_id, d.size, g.source_size, g.target, g.quota, g.blocks, g.shift, e.bounds,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source JOIN e ON g.rank = e.rank),
r AS (SELECT *, unnest([start, start + source_size]) AS pos FROM p),
b AS (SELECT *, unnest(range(pos // {block}, (pos + size) // {block} + 1)) AS block FROM r),
c AS (SELECT rn, greatest(0, least(size, (block + 1) * {block} - pos, quota - pos) - greatest(0, block * {block} - pos)) AS words,
             len(list_filter(bounds, lambda z: z <= (block % greatest(blocks, 1) * ({prime} % greatest(blocks, 1)) + shift) % greatest(blocks, 1))) AS shard
      FROM b),
k AS (SELECT rn, shard, sum(words) AS words FROM c WHERE words > 0 AND shard < {shards} GROUP BY rn, shard),
m AS (SELECT rn, map_from_entries(list((shard, CAST(words AS BIGINT)))) AS got, CAST(sum(words) AS BIGINT) AS taken FROM k GROUP BY rn)
SELECT doc_id, size, source_size, CAST(round(target, 3) AS DOUBLE) AS target, coalesce(taken, 0) AS taken,
       array_to_string(list_transform(range(0, {shards}), lambda i: CASE WHEN got IS NULL THEN 0 ELSE coalesce(got[i], 0) END), ',') AS shard_words
FROM p LEFT JOIN m USING (rn)"""

#: One level of the splitting tree: the draws of every node, source by source, then the two halves.
_OP8_LEVEL = r"""
d{i}(lo, hi, rank, x, room, rest) AS (
  SELECT lo, hi, -1, 0, CAST((hi - lo) // 2 * (any_value(t) // {shards})
         + least((lo + hi) // 2, any_value(t) % {shards}) - least(lo, any_value(t) % {shards}) AS BIGINT), CAST(sum(n) AS BIGINT)
  FROM n{i}, (SELECT CAST(sum(blocks) AS BIGINT) AS t FROM g) GROUP BY lo, hi
  UNION ALL
  SELECT lo, hi, rank, x, room - x, rest FROM (
    SELECT lo, hi, rank, room, o AS rest, least(a, room, low + len(list_filter(range(low, least(a, room)), lambda k: list_sum(list_transform(
        range(low, k + 1), lambda j: exp(lgamma(a + 1) - lgamma(j + 1) - lgamma(a - j + 1) + lgamma(o + 1) - lgamma(room - j + 1)
          - lgamma(o - room + j + 1) - lgamma(a + o + 1) + lgamma(room + 1) + lgamma(a + o - room + 1)))) < u))) AS x
    FROM (SELECT v.lo, v.hi, q.rank, v.room, q.n AS a, v.rest - q.n AS o, greatest(0, v.room - (v.rest - q.n)) AS low,
                 (CAST('0x' || substr(md5('mix|' || v.lo || '|' || v.hi || '|' || q.rank), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656 AS u
          FROM d{i} v JOIN n{i} q ON q.lo = v.lo AND q.hi = v.hi AND q.rank = v.rank + 1))),
n{j} AS MATERIALIZED (
  SELECT lo, (lo + hi) // 2 AS hi, rank, x AS n FROM d{i} WHERE rank >= 0
  UNION ALL
  SELECT (q.lo + q.hi) // 2, q.hi, q.rank, q.n - v.x FROM n{i} q JOIN d{i} v ON q.lo = v.lo AND q.hi = v.hi AND q.rank = v.rank),"""


def _op8_sql() -> str:
    """The mix with its tree in SQL: the draws by log-gamma sums instead of the operator's ratios of neighbouring terms."""
    from areascope.llm import mixing

    depth = mixing.SHARDS.bit_length() - 1
    out = _OP8_SQL.replace("{levels}", "".join(_OP8_LEVEL.replace("{i}", str(i)).replace("{j}", str(i + 1)) for i in range(depth)))
    for name, value in (("depth", depth), ("shards", mixing.SHARDS), ("block", mixing.BLOCK_WORDS), ("prime", mixing.STEP_PRIME)):
        out = out.replace("{" + name + "}", str(value))
    return out


@register("op8_hypergeometric_mix", _op8_sql())
def op8(spark, sf_dir):
    """Words that the mix takes of each document, and how many of them each output shard gets."""
    from areascope.llm import mixing

    plan = mixing.mix(read(spark, sf_dir, "documents"), carry=["doc_id"])
    shard_words = F.expr(f"""array_join(transform(sequence(0, {mixing.SHARDS - 1}), s ->
        aggregate(filter(spans, x -> x.shard = s), 0L, (t, x) -> t + x.to_word - x.from_word)), ',')""")
    return plan.select("row.doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken", shard_words.alias("shard_words"))


_OP10_SQL = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (SELECT doc_id, low, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d),
p AS (SELECT doc_id, low, ws, list_filter(range(0, len(ws)), lambda i:
        (ws[i + 1] = 'cc' AND ws[i + 2] = 'by')
        OR (ws[i + 1] = 'general' AND ws[i + 2] = 'public' AND ws[i + 3] = 'license')
        OR (ws[i + 1] = 'all' AND ws[i + 2] = 'rights' AND ws[i + 3] = 'reserved')) AS hits FROM w),
b AS (SELECT doc_id, ws, hits,
        list_distinct(list_transform(hits, lambda i: CASE ws[i + 1] WHEN 'cc' THEN 'cc-by' WHEN 'general' THEN 'gpl' ELSE 'reserved' END)) AS base,
        list_filter([{templates}], lambda t: list_has_all(ws, t.must)) AS near FROM p),
f AS (SELECT doc_id, ws, hits, base, list_filter(list_transform(near, lambda t: {'label': t.label, 'top': list_max(list_transform(
        list_filter(range(0, len(ws)), lambda i: list_contains(t.words, ws[i + 1]) AND list_has_all(ws[i + 1:i + t.span], t.must)
            AND NOT list_has_any(ws[i + 1:i + t.span], t.without) AND len(list_intersect(ws[i + 1:i + t.span], t.words)) >= t.need),
        lambda i: len(list_intersect(ws[i + 1:i + t.span], t.words)) / CAST(len(t.words) AS DOUBLE)))}), lambda m: m.top IS NOT NULL) AS found FROM b),
m AS (SELECT *, coalesce(list_max(list_transform(found, lambda m: m.top)), 0.0) AS top FROM f)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(hits) AS BIGINT) AS n_base,
       CAST(list_min(hits) AS BIGINT) AS first_word, CAST(list_max(hits) AS BIGINT) AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, list_transform(found, lambda m: m.label)))), ',') AS labels,
       CAST(CASE WHEN len(hits) > 0 THEN 1.0 ELSE top END AS DOUBLE) AS score
FROM m"""


def _op10_sql() -> str:
    from areascope.llm import licenses

    def words(ws) -> str:
        return "CAST([" + ", ".join(map(repr, ws)) + "] AS VARCHAR[])"

    rows = [f"{{'label': '{t.label}', 'words': {words(t.words)}, 'must': {words(t.must)}, 'without': {words(t.without)},"
            f" 'need': {t.need}, 'span': {t.span}}}" for t in licenses.parsed(licenses.TEMPLATES)]
    return _OP10_SQL.replace("{templates}", ", ".join(rows))


@register("op10_license_scan", _op10_sql())
def op10(spark, sf_dir):
    """Base phrases and license templates found in each document."""
    from areascope.llm import licenses

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select(
        "doc_id", "license.n_words", F.size("license.places").cast("long").alias("n_base"),
        F.array_min(F.expr("transform(license.places, p -> p.word)")).alias("first_word"),
        F.array_max(F.expr("transform(license.places, p -> p.word)")).alias("last_word"),
        "license.base_labels", "license.labels", "license.score")


@register("op3_ngram_quality")
def op3(spark, sf_dir):
    """Base counts and verdict of every document."""
    from areascope.llm import quality

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", *[f"quality_rules.{f.name}" for f in quality.RULE_FIELDS], "quality_rules.base_failed",
        "quality_rules.kept", "quality_rules.probability")


@register("op5_tensored_minhash")
def op5(spark, sf_dir):
    """Near-duplicate component of every document."""
    from areascope.llm import neardup

    out = neardup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@register("op6_pigeonhole_edit_match")
def op6(spark, sf_dir):
    """Benchmark items that each document holds within the edit budget."""
    from areascope.llm import decontaminate

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.scan(docs, read(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.array_distinct(F.expr("transform(benchmark_hits, h -> h.item_id)")))
    return hits.select("doc_id", (F.size("benchmark_hits") > 0).alias("contaminated"), F.size(ids).alias("n_items"), ids.alias("item_ids"),
                       F.array_min(F.expr("transform(benchmark_hits, h -> h.distance)")).alias("least_distance"))


@register("op7_warc_revisits", """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, row_number() OVER () AS rn FROM pages),
d AS (SELECT page_id, rn, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, url FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST, rn) AS k,
             first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST, rn) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND k > 1 THEN top END AS refers_to
FROM r""")
def op7(spark, sf_dir):
    """Pages written as WARC archives with revisit records, then read back."""
    from areascope.llm import warc
    from areascope.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/areascope/warc-{uuid.uuid4().hex}"
    warc.write_archives(warc.classify(read(spark, sf_dir, "pages")), path)
    # length and digest are computed from the payloads as read, where they are read; revisits get those of their response
    records = warc.read_archives(spark, path).withColumn("read_bytes", F.octet_length("payload").cast("long")) \
        .withColumn("read_digest", F.sha1("payload")).drop("payload")
    records = warc.resolve(records, ("read_bytes", "read_digest"))
    return records.select("page_id", F.col("read_bytes").alias("payload_bytes"), F.col("read_digest").alias("payload_digest"),
                          F.col("type").alias("record_type"), "refers_to")


@register("op9_suffix_automata")
def op9(spark, sf_dir):
    """Words removed from each document as parts of repeated windows."""
    from areascope.llm import substrings

    out = substrings.remove(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "removal.n_words", "removal.n_removed", "removal.kept_sha256")


@register("op1_repair_token_shards")
def op1(spark, sf_dir):
    """Token ids of all documents, written as Re-Pair shards and read back."""
    import public_tokenizers

    from areascope.llm import repair
    from areascope.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/areascope/repair-{uuid.uuid4().hex}"
    repair.write_table(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return repair.read_table(spark, path)


@register("op4_gated_recurrent_lm")
def op4(spark, sf_dir):
    """Unigram base score and recurrent model score of every document."""
    from areascope.llm import recurrent

    return recurrent.score(read(spark, sf_dir, "documents").select("doc_id", "text"))


def _op11_sql() -> str:
    """The same rounds as full scans, one pair of common tables for each."""
    from areascope.llm import centroids as C

    parts = [f"""
v AS MATERIALIZED (SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda e: CAST(floor({C.SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {C.DIM} AND len(embedding) = {C.DIM}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS BIGINT) AS j, x AS c
  FROM (SELECT sha256('{C.SALT}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT {C.K}))"""]
    near = """
a{t} AS MATERIALIZED (SELECT rn, min(list_sum(list_transform(range(1, {dim} + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) * {k} + j) AS key
  FROM v, c{t} GROUP BY rn)"""
    move = """
m{t} AS MATERIALIZED (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
  SELECT key % {k} AS j, i, sum(e) AS s, count(*) AS n
  FROM (SELECT a.key, unnest(range(1, {dim} + 1)) AS i, unnest(v.x) AS e FROM v JOIN a{t} a USING (rn)) GROUP BY ALL) GROUP BY j),
c{u} AS MATERIALIZED (SELECT j, CAST(coalesce(m.c, o.c) AS BIGINT[]) AS c FROM c{t} o LEFT JOIN m{t} m USING (j))"""
    for t in range(C.ROUNDS):
        parts += [near.format(t=t, k=C.K, dim=C.DIM), move.format(t=t, u=t + 1, k=C.K, dim=C.DIM)]
    parts.append(near.format(t=C.ROUNDS, k=C.K, dim=C.DIM))
    return "WITH" + ",".join(parts) + f"""
SELECT v.vec_id, CAST(a.key % {C.K} AS INTEGER) AS cluster, CAST(a.key // {C.K} AS BIGINT) AS distance,
       CAST(sum(a.key // {C.K}) OVER (PARTITION BY a.key % {C.K}) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.key // {C.K}) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM v JOIN a{C.ROUNDS} a USING (rn) JOIN c{C.ROUNDS} c ON a.key % {C.K} = c.j"""


@register("op11_ns_bounds", _op11_sql())
def op11(spark, sf_dir):
    """Cluster of every sound vector after ten rounds."""
    from areascope.llm import centroids

    return centroids.digest(centroids.cluster(read(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")


@register("op12_reduced_alphabet")
def op12(spark, sf_dir):
    """Words of the corpus with their variants' form and root."""
    from areascope.llm import spelling

    return spelling.variants(read(spark, sf_dir, "documents"))


@register("op13_recurrent_blocks", r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS body FROM a),
c AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'),
             '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS body FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(body, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d""")
def op13(spark, sf_dir):
    """Main text of every page. The SQL cuts out the article element, which all given pages have."""
    from areascope.llm import maintext

    pages = read(spark, sf_dir, "pages")
    found = maintext.extract(pages, maintext.train(pages))
    return found.select("page_id", "url", "main_text.text", "main_text.n_chars")


register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
