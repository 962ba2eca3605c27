"""MinHash near-duplicate groups by tensored banding, with exact verification.

A document's set is its distinct shingles of five words (lower-case A-Z; fewer words: the whole sequence). Documents link
when 100 * intersection >= 75 * union; groups are the connected components.

Tensored banding. Two collections of ``BANDS`` small hashes, each of ``ROWS`` minhash values, are computed: that is
2 * 20 * 3 = 120 minhash values. A table key joins hash i of the first with hash j of the second collection, which gives
400 tables of six values each, for which plain banding would need 2,400 values. A pair at similarity 0.75 shares no key
with probability below 2 * (1 - 0.75 ** 3) ** 20 = 4e-5, less above.

Equal sets are one class (by a 128-bit digest), so copies are never compared. Only small hashes
that two classes share go on, so most classes are done at once. A class also keeps a sketch: of each of
``BINS`` ranges of the shingle hashes one byte of the smallest hash there. The share of agreeing among occupied bins estimates the
similarity (nearly exactly for sets smaller than ``BINS``); a pair is a candidate unless the estimate is more than
five standard errors below 0.75. Candidates are found and verified in rounds:

1. star: each class with the smallest classes that share a small hash of the first collection with it (``STARS`` of them), and
   best: each class with its best partner within blocks of ``BLOCK`` classes of such a bucket;
2. all candidates in different components; buckets of more than ``BLOCK`` classes are dealt to tasks as pairs of blocks, without
   those of two blocks of the largest component.

Classes meet by the first half of a table key, and the second half is looked at in the task (see ``_cross_pairs``).

So a large group of near copies is tied together by its stars and best partners and is not expanded into pairs, and no
candidate is dropped.
Verification computes the two full sets (64-bit shingle hashes) and compares their sizes and intersection.

Scale: the text is read twice and moved once (for classes with candidates); edges are pairs of 16-byte digests; hot keys
are met by joins that adaptive execution can split, and by combining before the shuffle. Every step is written
to the shared checkpoint folder.

Defined results: a null text, or one without words, has an empty set, links with nothing and is its own component;
a null id is never the smallest unless all of the component's are null; rows that repeat an id belong to the components
of their texts, and of those in one component the one with the smallest text hash is kept; an empty table gives an empty result; other columns are carried by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areascope.llm.common import map_arrow, numbered, renamed, text_or_empty
from areascope.llm.graph import components
from areascope.llm.textops import Chunk, as_bytes, chunks, mix64, window_hash
from areascope.session import materialize

#: Contract: words of a shingle and similarity in percent.
SHINGLE, PERCENT = 5, 75
#: Small hashes of each collection, minhash values of each, stars, block size.
BANDS, ROWS, STARS, BLOCK = 20, 3, 2, 2000
#: Sketch bins (a power of two), standard errors of the gate.
BINS, ERRORS = 512, 5.0
_RNG = np.random.default_rng(5)
_MULTIPLY = _RNG.integers(1, 2**63, 2 * BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sets of a chunk's documents: sorted distinct shingle hashes, and the end of each document's."""
    c = Chunk(texts, lower=True)
    words = c.word_hash()
    windows, at = window_hash(words, c.doc, SHINGLE)
    doc = c.doc[at]
    few = np.flatnonzero((c.words > 0) & (c.words < SHINGLE))
    if len(few):  # the whole sequence as one shingle
        whole = np.array([int(mix64(np.array([_fold(words[c.first[d]:c.first[d] + c.words[d]])], np.uint64))[0]) for d in few], np.uint64)
        windows, doc = np.concatenate((windows, whole)), np.concatenate((doc, few))
    order = np.lexsort((windows, doc))
    windows, doc = windows[order], doc[order]
    if len(doc):
        first = np.ones(len(doc), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (windows[1:] != windows[:-1])
        windows, doc = windows[first], doc[first]
    return windows, np.cumsum(np.bincount(doc, minlength=c.n))


def _fold(words: np.ndarray) -> int:
    out = len(words)
    for w in words.tolist():
        out = (out * 0x9E3779B97F4A7C15 + w) % 2**64
    return out


def small_hashes(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 2 * BANDS small hashes (64-bit, told apart by their place) of each set, by row."""
    starts = np.concatenate(([0], ends[:-1]))
    full = np.flatnonzero(ends > starts)
    out = np.zeros((len(ends), 2 * BANDS), np.uint64)
    if not len(full):
        return out
    at = starts[full]
    for band in range(2 * BANDS):
        key = np.full(len(full), band + 1, np.uint64)
        for row in range(ROWS):
            value = sets * _MULTIPLY[band * ROWS + row]
            key = mix64(key + np.minimum.reduceat(value ^ (value >> np.uint64(32)), at))
        out[full, band] = key
    return out


def sketches(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sketch of each set, by row: a byte (1 to 254) for each bin that is not empty, else 0. The sets are
    sorted, so the smallest hash of a bin is the first."""
    out = np.zeros((len(ends), BINS), np.uint8)
    if len(sets):
        doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        cell = doc * BINS + (sets >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        out.reshape(-1)[cell[first]] = (sets[first] >> np.uint64(20)) % np.uint64(254) + np.uint64(1)
    return out


def _alike(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sketches row by row: the estimated similarity, and whether the pair is a candidate."""
    agree = ((a == b) & (a > 0)).sum(axis=1)
    used = np.maximum(((a > 0) | (b > 0)).sum(axis=1), 1)
    union = np.maximum((na + nb) / 1.75, 1)
    error = np.sqrt(0.1875 / used * np.maximum(1 - used / union, 0.03))
    estimate = agree / used
    size = 100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)
    return estimate, size & (estimate >= 0.75 - ERRORS * error - 0.02)


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, text_hash, n, digest, small, sketch): one row for each document."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text_or_empty(text)).alias("text_hash"), text_or_empty(text).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for lo, hi in chunks(texts):
                sets, ends = shingle_sets(texts[lo:hi])
                small, sketch = small_hashes(sets, ends).view(np.int64), sketches(sets, ends)
                starts = np.concatenate(([0], ends[:-1]))
                digest = [hashlib.blake2b(sets[s:e].tobytes(), digest_size=16).digest() for s, e in zip(starts, ends)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(ends - starts, pa.int64()), pa.array(digest, pa.binary()),
                     pa.ListArray.from_arrays(np.arange(0, small.size + 1, 2 * BANDS, dtype=np.int32), pa.array(small.reshape(-1))),
                     pa.array([x.tobytes() for x in sketch], pa.binary())],
                    ["id", "text_hash", "n", "digest", "small", "sketch"])

    return map_arrow(rows, run, f"id {id_type}, text_hash bigint, n bigint, digest binary, small array<bigint>, sketch binary")


def meeting_places(classes: DataFrame) -> DataFrame:
    """(h, place, digest, c, least): the small hashes of the first collection that several classes have, with the
    number of classes and the smallest."""
    each = classes.select("digest", F.posexplode(F.slice("small", 1, BANDS)).alias("place", "h"))  # the place is part of h
    shared = each.groupBy("h").agg(F.count("*").alias("c"), F.min("digest").alias("least")).where("c > 1")
    return each.join(shared, "h").select("h", "place", "digest", "c", "least")


def _gated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The candidates among pairs (x, y), by their sketches."""
    side = classes.select("digest", "sketch", "n")
    both = pairs.join(side.toDF("x", "sx", "nx"), "x").join(side.toDF("y", "sy", "ny"), "y").select("x", "y", "sx", "sy", "nx", "ny")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_rows(batch.column(i).to_pylist()) for i in (2, 3))
            _, ok = _alike(a, b, batch.column(4).to_numpy(), batch.column(5).to_numpy())
            yield batch.select([0, 1]).filter(pa.array(ok))

    return map_arrow(both, run, "x binary, y binary")


def _rows(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), BINS)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) that link, by their full sets."""
    both = pairs.join(sets.toDF("x", "sx"), "x").join(sets.toDF("y", "sy"), "y").select("x", "y", "sx", "sy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= PERCENT * max(len(a), len(b)) else 0
                keep.append(100 * common >= PERCENT * (len(a) + len(b) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both, run, "x binary, y binary")


def _with_blocks(rows: DataFrame) -> DataFrame:
    """The rows (h, digest, comp, c) of buckets with ``own``, a row's block, and ``last``: it meets the blocks up to this one.

    The members of a bucket's largest component never pair, so they have blocks of their own, after those of the other rows, and
    meet these only: a large component and a few other classes are not copied to many blocks.
    """
    large = rows.where(F.col("c") > BLOCK).groupBy("h", "comp").agg(F.count("*").alias("m")) \
        .groupBy("h").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("all"))
    large = large.select("h", F.col("top.comp").alias("largest"), F.ceil((F.col("all") - F.col("top.m")) / BLOCK).cast("int").alias("few"),
                         F.ceil(F.col("top.m") / BLOCK).cast("int").alias("many"))
    rows = rows.join(large, "h", "left")
    hashed, inside = F.xxhash64("digest"), F.col("comp") == F.col("largest")
    own = F.when(F.col("largest").isNull(), F.lit(0)).when(inside, F.col("few") + F.pmod(hashed, "many")).otherwise(F.pmod(hashed, "few"))
    last = F.when(F.col("largest").isNull(), F.lit(0)).when(inside, F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1)
    return rows.withColumn("own", own.cast("int")).withColumn("last", last.cast("int")).drop("largest", "few", "many")


def _cross_pairs(firsts: DataFrame, labels: DataFrame | None, classes: DataFrame, best_only: bool) -> DataFrame:
    """Candidates (x, y) in different components that share a table key: all, or (``best_only``) each class's best
    within its block of a bucket. Without ``labels`` each class is its own component.

    Rows meet by their small hash of the first collection (``firsts``), and bring those of the second, which makes the
    table keys in the task: 20 rows for a class, not 400. A pair is looked at where it first meets.
    """
    if labels is None:
        rows = firsts.select("h", "place", "digest", F.col("digest").alias("comp"), "c")
    else:
        rows = firsts.join(labels.withColumnRenamed("node", "digest"), "digest", "left") \
            .select("h", "place", "digest", F.coalesce("comp", "digest").alias("comp"), "c")
        mixed = rows.groupBy("h").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b")
        rows = rows.join(mixed.select("h"), "h")
    if best_only:
        rows = rows.withColumn("own", F.pmod(F.xxhash64("digest"), F.ceil(F.col("c") / BLOCK)).cast("int"))
    else:
        rows = _with_blocks(rows)
    rows = rows.join(classes.select("digest", "small", "sketch", "n"), "digest")
    rows = rows.withColumn("other", F.col("own") if best_only else F.explode(F.sequence(F.lit(0), F.col("last"))))
    rows = rows.select("h", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "place", "digest", "comp",
                       F.expr("transform(small, x -> cast(x & 2147483647 as int))").alias("small"), "sketch", "n")

    def emit(group: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(group)
        digest = np.array(t.column("digest").to_pylist(), object)
        _, comp, size = np.unique(np.array(t.column("comp").to_pylist(), object), return_inverse=True, return_counts=True)
        if len(size) < 2:
            return None
        sketch, own, n = _rows(t.column("sketch").to_pylist()), t.column("own").to_numpy(), t.column("n").to_numpy()
        small = t.column("small").combine_chunks().flatten().to_numpy().reshape(len(t), 2 * BANDS)
        p, q, place = (t.column(c)[0].as_py() for c in ("p", "q", "place"))
        # in one block, the largest component comes last: its members are compared with the others only
        order = np.argsort(comp == size.argmax(), kind="stable") if p == q else np.argsort(own != p, kind="stable")
        n_left = len(t) - size.max() if p == q else int((own == p).sum())
        digest, comp, sketch, n, small = digest[order], comp[order], sketch[order], n[order], np.ascontiguousarray(small[order].T)
        best, partner = np.zeros(len(t)), np.zeros(len(t), np.int64)
        xs, ys = [], []
        for s in range(0, n_left, 64):
            left = np.arange(s, min(s + 64, n_left))
            right = np.arange(s if p == q else n_left, len(t))
            meet = np.zeros((len(left), len(right)), bool)
            for k in range(BANDS, 2 * BANDS):
                meet |= small[k, left][:, None] == small[k, right][None, :]
            meet &= comp[left][:, None] != comp[right][None, :]
            for k in range(place):
                meet &= small[k, left][:, None] != small[k, right][None, :]
            i, j = np.nonzero(meet)
            x, y = left[i], right[j]
            score, ok = np.zeros(len(x)), np.zeros(len(x), bool)
            for u in range(0, len(x), 4096):
                v = slice(u, u + 4096)
                score[v], ok[v] = _alike(sketch[x[v]], sketch[y[v]], n[x[v]], n[y[v]])
            x, y, score = x[ok], y[ok], score[ok]
            if best_only:
                for one, two in ((x, y), (y, x)):
                    up = np.lexsort((two, score))
                    one_, two_, score_ = one[up], two[up], score[up]   # the last write is the best
                    better = score_ > best[one_]
                    best[one_[better]], partner[one_[better]] = score_[better], two_[better]
            else:
                xs.append(x)
                ys.append(y)
        x, y = (np.flatnonzero(best), partner[best > 0]) if best_only else (np.concatenate(xs), np.concatenate(ys))
        if not len(x):
            return None
        score = best[x] if best_only else np.zeros(len(x))
        return pa.RecordBatch.from_arrays([pa.array(digest[x].tolist(), pa.binary()), pa.array(digest[y].tolist(), pa.binary()),
                                           pa.array(score)], ["x", "y", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:   # sorted by group; a group may go over batches
            names = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            cut = [0] + [i for i in range(1, len(names)) if names[i] != names[i - 1]] + [len(names)] if names else [0]
            for lo, hi in zip(cut, cut[1:]):
                if names[lo] != last and held:
                    if (out := emit(held)) is not None:
                        yield out
                    held = []
                last = names[lo]
                held.append(batch.slice(lo, hi - lo))
        if held and (out := emit(held)) is not None:
            yield out

    dealt = rows.repartition("h", "p", "q").sortWithinPartitions("h", "p", "q")
    found = map_arrow(dealt, run, "x binary, y binary, score double")
    if best_only:
        found = found.groupBy("x").agg(F.max(F.struct("score", "y")).alias("m")).select("x", "m.y")
    return found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def full_sets(docs: DataFrame, nodes: DataFrame, classes: DataFrame, doc_id: str, text: str, repeated: bool) -> DataFrame:
    """(digest, hashes): the full sets of classes ``nodes``, from the text of one document each."""
    needed = nodes.join(classes, "digest").select("digest", "rep.id", "rep.text_hash")
    found = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text_or_empty(text)).alias("text_hash"), text_or_empty(text).alias("text"))
    found = found.join(needed, found["id"].eqNullSafe(needed["id"]) & (found["text_hash"] == needed["text_hash"])).select("digest", "text")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for lo, hi in chunks(texts):
                sets, ends = shingle_sets(texts[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([sets[s:e].tobytes() for s, e in zip(np.concatenate(([0], ends[:-1])), ends)], pa.binary())],
                    ["digest", "hashes"])

    sets = map_arrow(found, full, "digest binary, hashes binary")
    # a row repeated with its id and text comes more than once
    return materialize(sets.groupBy("digest").agg(F.first("hashes").alias("hashes")) if repeated else sets, "sets")


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x", "y")).alias("digest")).distinct()


def class_components(docs: DataFrame, rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, comp) for the classes that link with another class; ``rows`` are the signatures of ``docs``."""
    classes = materialize(rows.where("n > 0").groupBy("digest").agg(
        F.min(F.struct("id", "text_hash")).alias("rep"), F.first("small").alias("small"),
        F.first("sketch").alias("sketch"), F.first("n").alias("n"), (F.count("*") > 1).alias("copied")), "classes")
    # a class of one row cannot hold a repeated row, so this looks at copies only
    repeated = not rows.join(classes.where("copied").select("digest"), "digest", "left_semi") \
        .groupBy("id", "text_hash").count().where("count > 1").isEmpty()
    firsts = materialize(meeting_places(classes), "places")
    stars = firsts.where("digest <> least").select(F.col("digest").alias("x"), F.col("least").alias("y")).distinct()
    stars = _gated(stars, classes).groupBy("x").agg(F.slice(F.array_sort(F.collect_set("y")), 1, STARS).alias("ys")) \
        .select("x", F.explode("ys").alias("y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    pairs = materialize(stars.unionAll(_cross_pairs(firsts, None, classes, True)).distinct(), "pairs")
    nodes = materialize(_nodes(pairs), "nodes")
    sets = full_sets(docs, nodes, classes, doc_id, text, repeated)
    labels = components(materialize(verified(pairs, sets), "links"))
    pairs = materialize(_cross_pairs(firsts, labels, classes, False), "pairs")
    missing = _nodes(pairs).join(nodes, "digest", "left_anti")
    if not missing.isEmpty():
        sets = sets.unionAll(full_sets(docs, missing, classes, doc_id, text, repeated))
    more = materialize(verified(pairs, sets), "links")
    if more.isEmpty():
        return labels
    # the new links join components: components of the small graph of their labels
    def labelled(df: DataFrame, side: str) -> DataFrame:
        return df.join(labels.select(F.col("node").alias(side), F.col("comp").alias(f"{side}c")), side, "left") \
            .withColumn(f"{side}c", F.coalesce(f"{side}c", side))

    merged = components(labelled(labelled(more, "x"), "y").select(F.col("xc").alias("x"), F.col("yc").alias("y")))
    merged = merged.toDF("old", "new")
    labels = labels.join(merged, labels["comp"] == merged["old"], "left").select("node", F.coalesce("new", "comp").alias("comp"))
    # classes that had no label yet are labels of the small graph themselves
    alone = merged.join(labels, merged["old"] == labels["node"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("comp"))
    return materialize(labels.unionAll(alone), "labels")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, n_shingles, component_id, kept, first): one row for each document. ``kept`` is true where the id is the
    component's smallest, on each row of that id; ``first`` on one (id, text_hash) of each component alone."""
    rows = materialize(signatures(docs, doc_id, text), "signatures")
    labels = class_components(docs, rows, doc_id, text)
    first = F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_hash")
    per_class = rows.where("n > 0").groupBy("digest").agg(F.min(first).alias("first"))
    named = per_class.join(labels, per_class["digest"] == labels["node"], "left") \
        .select("digest", F.coalesce("comp", "digest").alias("comp"), "first")
    least = named.groupBy("comp").agg(F.min("first").alias("first"))
    named = named.select("digest", "comp").join(least, "comp").select("digest", F.col("first.id").alias("component_id"), F.col("first.text_hash").alias("kept_hash"))
    light = rows.select("id", "text_hash", "n", "digest")
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    out = light.where("n > 0").join(named, "digest").select("id", "text_hash", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"),
                                                            (kept & (F.col("text_hash") == F.col("kept_hash"))).alias("first"))
    alone = [F.col("id").alias("component_id"), F.lit(True).alias("kept"), F.lit(True).alias("first")]
    return out.unionAll(light.where("n = 0").select("id", "text_hash", "n", *alone))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row for each group; rows without words all stay."""
    verdict = near_duplicates(docs, doc_id, text).where("first").groupBy("id", "text_hash").agg(F.max("n_shingles").alias("n"))
    names, rows = docs.columns, numbered(docs)
    own_id, own_text = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    rows = rows.withColumn("own_hash", F.xxhash64(text_or_empty(own_text)))
    kept = rows.join(verdict, rows[own_id].eqNullSafe(verdict["id"]) & (rows["own_hash"] == verdict["text_hash"]))
    # of a row repeated with its id and text, one stays; equal to the join's key, so nothing moves again
    copy = F.row_number().over(Window.partitionBy("id", "text_hash").orderBy("n"))
    return renamed(kept.withColumn("copy", copy).where("copy = 1 or n = 0"), names)
