"""Substring deduplication by suffix automata of reference shards.

A window is ``WINDOW`` consecutive words of a document. Every word that is covered by a window whose words also
start anywhere else (in the same or another document) is removed; windows are judged on the input.

Streaming all documents through the automata of all documents would be quadratic, so the reference is first cut down and
routed, without losing a window:

1. runs: a window's anchor is its smallest 8-word hash, a function of its words alone. Consecutive windows
   with the same anchor position are one run (14 windows on average), a string of words. Equal windows have
   equal anchors, and only anchors that occur at least twice go on; the rest, nearly all, are done.
2. reference strings: equal runs are one string with a number of copies (combined before the shuffle), whose words are
   read from one document.
3. reference shards: the strings, by anchor, are packed to shards of ``SHARD_WORDS`` words or one anchor's strings. A task
   builds the generalised suffix automaton of a shard, with the number of occurrences of each state, and
   streams the shard's strings through it: the matching statistic of a position is the longest suffix that occurs at least
   twice, and the maximal spans of at least ``WINDOW`` words are removed.
4. the spans go back to all documents that hold the string.

An automaton is thus not broadcast to all documents (it would grow with the corpus) but sent to where the strings
that can match it are. Before the automaton, the strings of an anchor with more than ``TRIM`` of them lose ends that
no other string of the anchor has, so a passage with thousands of contexts stays a few strings. An anchor with more
than ``MAX_STRINGS`` distinct runs is split to its single windows, which need no automaton: a window is repeated if its hash
is met twice, which is combined before the shuffle. So every case has an exact way, and a task holds ``MAX_STRINGS`` strings of an anchor at most.
Equality of words is by 64-bit hashes.

Defined results: null and empty texts have no words; repeated rows are occurrences of their own, so they remove each
other's windows; shorter documents are never touched; an empty table gives an empty result; other
columns are carried by ``remove``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areascope.llm.common import map_arrow, numbered, renamed, text_or_empty
from areascope.llm.textops import Chunk, as_bytes, chunks, mix64, window_hash
from areascope.session import materialize

#: Words of a window and of an anchor gram; words of a reference shard; strings of an anchor before they are trimmed, and at most.
WINDOW, GRAM, SHARD_WORDS, TRIM, MAX_STRINGS = 35, 8, 4000, 32, 20000


def window_runs(c: Chunk, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (document, first word, windows, anchor word, anchor hash, content hash);
    words count from the document's first."""
    words = c.word_hash()
    empty = tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),) * 2
    if len(words) < window:
        return empty
    h = np.zeros(len(words) - gram + 1, np.uint64)
    for i in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i:len(words) - gram + 1 + i]
    least = mix64(h)
    where = np.arange(len(least))
    span = window - gram + 1
    size = 1
    while size < span:   # sliding minimum by doubling; the left one wins a tie
        step = min(size, span - size)
        left, right = least[:len(least) - step], least[step:]
        take = left <= right
        where = np.where(take, where[:len(where) - step], where[step:])
        least = np.where(take, left, right)
        size += step
    starts = np.flatnonzero(c.doc[window - 1:] == c.doc[:len(c.doc) - window + 1])
    if not len(starts):
        return empty
    anchor = where[starts]
    cut = np.ones(len(starts), bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)
    at = np.flatnonzero(cut)
    first, n = starts[at], np.diff(np.append(at, len(starts)))
    begin, end = c.start[first], c.end[first + n + window - 2]
    # the content hash is over words, not over the white space between them
    power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(words), np.uint64(0xD6E8FEB86659FD93)))))
    inverse = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(words), np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))))))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(words * power[:-1])))
    content = mix64((sums[first + n + window - 1] - sums[first]) * inverse[first] + mix64(n.astype(np.uint64)))
    assert len(begin) == len(end)
    doc = c.doc[first]
    return doc, first - c.first[doc], n, anchor[at] - c.first[doc], least[first], content


class Automaton:
    """Generalised suffix automaton of weighted strings, with the occurrences of each state."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, string: list[int]) -> None:
        last = 0
        for symbol in string:
            p, q = last, self.next[last].get(symbol)
            if q is not None:  # another string has been here
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
                continue
            state = self._state(self.length[p] + 1, {}, 0)
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = state
                p = self.link[p]
            if p >= 0:
                q = self.next[p][symbol]
                self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
            last = state

    def repeated(self, strings: list[list[int]], copies: list[int]) -> list[int]:
        """For each state the length of its longest suffix that occurs at least twice."""
        count = [0] * len(self.next)
        for string, n in zip(strings, copies):
            state = 0
            for symbol in string:
                state = self.next[state][symbol]
                count[state] += n
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for state in reversed(order):
            count[self.link[state]] += count[state]
        longest = [0] * len(self.next)
        for state in order:
            longest[state] = self.length[state] if count[state] >= 2 else longest[self.link[state]]
        return longest

    def matching_statistics(self, string: list[int], longest: list[int]) -> Iterator[int]:
        state = 0
        for symbol in string:
            state = self.next[state][symbol]
            yield longest[state]


def maximal_spans(statistics: Iterator[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Word ranges covered by repeated windows, from the longest repeated suffix at each position."""
    spans: list[tuple[int, int]] = []
    for i, length in enumerate(statistics):
        if length >= window:
            lo, hi = i + 1 - length, i + 1
            if spans and lo <= spans[-1][1]:
                spans[-1] = (min(lo, spans[-1][0]), hi)
            else:
                spans.append((lo, hi))
    return spans


def _shared_ends(strings: list[np.ndarray], anchors: np.ndarray, copies: np.ndarray, window: int, gram: int) -> list[tuple[int, int]]:
    """For strings with one anchor gram: the part of each whose ends other strings (or copies) have too."""
    n, reach = len(strings), window - gram
    out = []
    for side in (-1, 1):
        edge = anchors if side < 0 else anchors + gram
        table = np.zeros((n, reach), np.uint64)
        room = np.zeros(n, np.int64)
        for i, s in enumerate(strings):
            part = s[:edge[i]][::-1][:reach] if side < 0 else s[edge[i]:][:reach]
            table[i, :len(part)], room[i] = part, len(part)
        key, kept = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        live = np.arange(n)
        for t in range(reach):
            live = live[room[live] > t]
            if not len(live):
                break
            key[live] = mix64(key[live] + table[live, t])
            _, group = np.unique(key[live], return_inverse=True)
            live = live[np.bincount(group, weights=copies[live])[group] >= 2]
            kept[live] = t + 1
        out.append(kept)
    return [(int(a - x), int(a + gram + y)) for a, x, y in zip(anchors, *out)]


def repeated_spans(groups: list[list[tuple[int, int, np.ndarray]]], window: int = WINDOW, gram: int = GRAM) -> list[list[list[tuple[int, int]]]]:
    """For the strings (copies, anchor word, words) of each anchor of a shard: their maximal repeated spans."""
    parts, pieces, weight = [], [], []
    for group in groups:
        ranges = [(0, len(words)) for _, _, words in group]
        if len(group) > TRIM:
            ranges = _shared_ends([w for _, _, w in group], np.array([a for _, a, _ in group]), np.array([c for c, _, _ in group]), window, gram)
        merged: dict[bytes, int] = {}
        of = []
        for (copies, _, words), (lo, hi) in zip(group, ranges):
            if hi - lo < window:
                of.append(None)
                continue
            key = words[lo:hi].tobytes()
            if key not in merged:
                merged[key] = len(pieces)
                pieces.append(words[lo:hi].tolist())
                weight.append(0)
            weight[merged[key]] += copies
            of.append((merged[key], lo))
        parts.append(of)
    machine = Automaton()
    for p in pieces:
        machine.add(p)
    longest = machine.repeated(pieces, weight)
    spans = [maximal_spans(machine.matching_statistics(p, longest), window) for p in pieces]
    return [[[(a + x[1], b + x[1]) for a, b in spans[x[0]]] if x else [] for x in of] for of in parts]


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), F.xxhash64(text_or_empty(text)).alias("text_hash"), text_or_empty(text).alias("text"))


def _runs(keyed: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for lo, hi in chunks(texts):
                doc, first, n, anchor_word, anchor, content = window_runs(Chunk(texts[lo:hi]), window)
                take = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)),
                     pa.array((anchor_word - first).astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))],
                    ["id", "text_hash", "first", "n", "offset", "anchor", "content"])

    kind = keyed.schema["id"].dataType.simpleString()
    return map_arrow(keyed, run, f"id {kind}, text_hash bigint, first int, n int, offset int, anchor bigint, content bigint")


def _references(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(anchor, content, copies, rep): the reference strings by a place each, and those of oversize anchors."""
    strings = live.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(F.struct("id", "text_hash", "first", "n", "offset")).alias("rep"))
    strings = materialize(strings, "strings")
    oversize = strings.groupBy("anchor").count().where(F.col("count") > MAX_STRINGS).select(F.col("anchor").alias("big"))
    strings = strings.join(oversize, strings["anchor"] == F.col("big"), "left")
    return strings.where("big is null").drop("big"), strings.where("big is not null").drop("big")


def _texts(keyed: DataFrame, strings: DataFrame) -> DataFrame:
    """(text, wanted): the documents that the strings are read from, with the strings of each."""
    wanted = strings.groupBy(F.col("rep.id").alias("i"), F.col("rep.text_hash").alias("h")).agg(F.collect_list(F.struct(
        "anchor", "content", "copies", F.col("rep.first").alias("first"), F.col("rep.n").alias("n"), F.col("rep.offset").alias("offset"))).alias("wanted"))
    return keyed.join(wanted, keyed["id"].eqNullSafe(wanted["i"]) & (keyed["text_hash"] == wanted["h"])).select("text", "wanted")


def _strings(keyed: DataFrame, strings: DataFrame, window: int) -> DataFrame:
    """(anchor, content, copies, offset, words): the reference strings with their words."""
    cols = ["anchor", "content", "copies", "offset", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for lo, hi in chunks(texts):
                c, rows = Chunk(texts[lo:hi]), []
                words = c.word_hash()
                for d in range(lo, hi):
                    base = c.first[d - lo]
                    for w in batch.column(1)[d].as_py():
                        begin = base + w["first"]
                        rows.append((w["anchor"], w["content"], w["copies"], w["offset"], words[begin:begin + w["n"] + window - 1].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], cols)

    return map_arrow(_texts(keyed, strings), run, "anchor bigint, content bigint, copies bigint, offset int, words binary")


def _windows(keyed: DataFrame, strings: DataFrame, window: int) -> DataFrame:
    """(window, content, part, copies): the single windows of the reference strings, by hash."""
    cols = ["window", "content", "part", "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for lo, hi in chunks(texts):
                c = Chunk(texts[lo:hi])
                singles, at = window_hash(c.word_hash(), c.doc, window)
                wanted = [(c.first[d - lo] + w["first"], w["n"], w["content"], w["copies"]) for d in range(lo, hi) for w in batch.column(1)[d].as_py()]
                if not wanted:
                    continue
                begin, n, content, copies = (np.array(x, np.int64) for x in zip(*wanted))
                part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                hashes = singles[np.repeat(np.searchsorted(at, begin), n) + part]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.repeat(content, n)), pa.array(part.astype(np.int32)),
                                                  pa.array(np.repeat(copies, n))], cols)

    return map_arrow(_texts(keyed, strings), run, "window bigint, content bigint, part int, copies bigint")


def _window_spans(windows: DataFrame, window: int) -> DataFrame:
    """(content, spans): the windows that occur at least twice, as one span each; a run that occurs again as a whole is one span by
    itself. A row that comes again, as its document is repeated, is no other place: it has the same content and part."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("content", "part")]
    repeated = windows.groupBy("window").agg(F.max("copies").alias("most"), *ends) \
        .where("most > 1 or min_content <> max_content or min_part <> max_part").select("window")
    whole = windows.where("copies > 1").groupBy("content").agg(F.min("part").alias("lo"), (F.max("part") + window).alias("hi"))
    single = windows.where("copies = 1").join(repeated, "window").select("content", F.col("part").alias("lo"), (F.col("part") + window).alias("hi"))
    return whole.unionAll(single).select("content", F.array(F.struct("lo", "hi")).alias("spans"))


def _merged(spans: Column) -> Column:
    """Ranges that touch or overlap as one, in order: the single windows of a passage become the passage. A run has at most about
    as many windows as a window has words, so a list is short."""
    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], s["hi"]).alias("hi"))
        return F.when((F.size(done) > 0) & (last["hi"] >= s["lo"]),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.sort_array(spans), F.expr("cast(array() as array<struct<lo: int, hi: int>>)"), add)


def _spans(strings: DataFrame, window: int) -> DataFrame:
    """(content, spans): the repeated word ranges of every reference string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(groups):
            held = []
            for group in groups:
                held.append(list(group.values()))
            found = repeated_spans(held, window)
            rows = [(content, [{"lo": a, "hi": b} for a, b in s])
                    for group, spans in zip(groups, found) for content, s in zip(group, spans) if s]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()),
                     pa.array([r[1] for r in rows], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))], ["content", "spans"])

        groups, size, last = [], 0, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for anchor, content, copies, offset, words in zip(*columns):
                if anchor != last:
                    if size >= SHARD_WORDS:
                        yield from flush(groups)
                        groups, size = [], 0
                    groups.append({})
                    last = anchor
                words = np.frombuffer(words, np.uint64)
                groups[-1].setdefault(content, (copies, offset, words))   # a repeated row of a run does not add up
                size += len(words)
        if groups:
            yield from flush(groups)

    dealt = strings.repartition("anchor").sortWithinPartitions("anchor")
    return map_arrow(dealt, run, "content bigint, spans array<struct<lo: int, hi: int>>")


def repeated_word_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, text_hash, spans): the word ranges to remove, for each document that has any."""
    keyed = _keyed(docs, doc_id, text)
    runs = _runs(keyed, window)
    repeated = runs.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    repeated = materialize(repeated, "repeated")     # an aggregate in the stage of a join would keep AQE from splitting hot keys
    # merged, not broadcast: both tables grow with the documents, and rows of an anchor stay together, so that copies combine
    live = materialize(runs.join(repeated.hint("merge"), "anchor"), "runs")
    strings, oversize = _references(live)
    spans = _spans(_strings(keyed, strings, window), window)
    if oversize.isEmpty():
        spans = materialize(spans, "spans")
    else:
        # one job for both, in which the texts are shuffled once: the two joins read the same exchange
        both = materialize(spans.unionByName(_windows(keyed, oversize, window), allowMissingColumns=True), "spans")
        windows = both.where("window is not null").select("window", "content", "part", "copies")
        spans = both.where("window is null").select("content", "spans").unionAll(_window_spans(windows, window))
    spans = spans.groupBy("content").agg(_merged(F.flatten(F.collect_list("spans"))).alias("spans"))
    spans = materialize(spans, "spans")
    hits = live.select("id", "text_hash", "first", "content").join(spans.hint("merge"), "content")
    moved = hits.select("id", "text_hash", F.expr("transform(spans, s -> named_struct('lo', s.lo + first, 'hi', s.hi + first))").alias("spans"))
    return moved.groupBy("id", "text_hash").agg(F.sort_array(F.flatten(F.collect_set("spans"))).alias("spans"))     # copies of a row add nothing to a set


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``removal``: n_words, n_removed, kept_text (the kept words, joined by one space) and its SHA-256."""
    spans = repeated_word_spans(docs, doc_id, text, window)
    names, rows = docs.columns, numbered(docs)
    own_id, own_text = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    rows = rows.withColumn("own_hash", F.xxhash64(text_or_empty(own_text)))
    joined = rows.join(spans, rows[own_id].eqNullSafe(spans["id"]) & (rows["own_hash"] == spans["text_hash"]), "left") \
        .drop("own_hash", "id", "text_hash")
    result = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType())])
    at, n = names.index(text), len(names)
    columns = [*joined.columns[:n], "removal"]
    fields = result.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, spans in zip(as_bytes(batch.column(at)), batch.column(n).to_pylist()):
                words = t.split()
                keep, done = [], 0
                for s in spans or []:
                    keep += words[done:max(done, s["lo"])]
                    done = max(done, s["hi"])
                keep += words[done:]
                kept = b" ".join(keep)
                out.append((len(words), len(words) - len(keep), kept, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) or [[], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [pa.array([x.decode("utf-8", "replace") for x in c] if i == 2 else c, k) for i, (c, k) in enumerate(zip(cols, kinds))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.StructArray.from_arrays(arrays, fields)], columns)

    out = map_arrow(joined, run, T.StructType([*numbered(docs).schema.fields, T.StructField("removal", result)]))
    return renamed(out, names, "removal")
