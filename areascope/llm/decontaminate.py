"""Benchmark decontamination by pigeonhole edit matching.

Items and documents are compared in a normal form: A-Z in lower case, runs of white space as one
space. An item of m characters may occur in a document with up to ``m // CHARS_PER_ERROR`` edits
(insertions, deletions, substitutions of characters). It is cut into that number plus one pieces of nearly equal
length; an occurrence within the budget leaves at least one piece untouched. So every document is scanned once
for all pieces (an Aho-Corasick automaton), and each piece hit is verified: Myers' bit-parallel distance of the item
against the window around the hit that any occurrence through this piece must lie in. No occurrence within
the budget is missed, and none beyond it is reported.

The items are a stated query set: their number of characters is checked, and a set of more than
``MAX_CHARS`` is scanned for in several blocks of at most about that size; what a block found is stored before the next
one is broadcast. Documents are neither joined nor shuffled. A hit costs time in proportion to the item, not to the document.

Defined results: null or empty texts hold nothing; items with a null or empty text are never found; an item with a null id is reported under that id;
``clean_documents`` looks at texts alone; equal items are all found, rows equal in id and text once; repeated documents are judged alike; an empty table gives an empty result, an empty benchmark leaves all
documents clean; all other columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from areascope.llm.common import map_arrow, numbered, renamed
from areascope.llm.textops import as_bytes
from areascope.session import materialize

#: One edit is allowed for each so many characters; characters of items in one scan.
CHARS_PER_ERROR, MAX_CHARS = 25, 4_000_000


def hit_type(item_id: T.DataType) -> T.StructType:
    """A hit of an item whose id is of the given type."""
    return T.StructType([T.StructField("item_id", item_id), T.StructField("start", T.LongType()),
                         T.StructField("end", T.LongType()), T.StructField("distance", T.IntegerType())])


def normal_form(text: bytes) -> str:
    """A-Z in lower case and white space runs (space, TAB..CR) as one space, none at the ends."""
    return b" ".join(text.lower().split()).decode("utf-8", "replace")


class Pattern:
    """An item with its budget and the bit masks of its characters, forwards and backwards."""

    def __init__(self, item_id: Any, text: str):
        self.item_id, self.text, self.size = item_id, text, len(text)
        self.budget = self.size // CHARS_PER_ERROR
        self.forward, self.backward = {}, {}
        for masks, chars in ((self.forward, text), (self.backward, text[::-1])):
            for i, ch in enumerate(chars):
                masks[ch] = masks.get(ch, 0) | 1 << i

    def pieces(self) -> list[tuple[int, str]]:
        """(offset, piece): budget + 1 pieces that make up the item."""
        cut = [i * self.size // (self.budget + 1) for i in range(self.budget + 2)]
        return [(a, self.text[a:b]) for a, b in zip(cut, cut[1:])]


def nearest(masks: dict[str, int], size: int, window: str, anchored: bool = False) -> tuple[int, int]:
    """Myers' algorithm with one bit for each pattern character: the smallest distance of the pattern to a part of
    the window, and the (first) end of that part. ``anchored``: the part must begin at the window's start."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, end = size, 0
    for i, ch in enumerate(window):
        same = masks.get(ch, 0)
        vertical = same | minus
        diagonal = (((same & plus) + plus) ^ plus) | same
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        score += 1 if up & top else -1 if down & top else 0
        up, down = (up << 1 | int(anchored)) & full, down << 1 & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best:
            best, end = score, i + 1
    return best, end


def automaton(patterns: list[Pattern]):
    import ahocorasick

    places: dict[str, list[tuple[int, int]]] = {}
    for k, p in enumerate(patterns):
        for offset, piece in p.pieces():
            places.setdefault(piece, []).append((k, offset))
    out = ahocorasick.Automaton()
    for piece, where in places.items():
        out.add_word(piece, (len(piece), where))
    if places:
        out.make_automaton()
    return out if places else None


def occurrences(text: str, patterns: list[Pattern], pieces) -> list[tuple[Any, int, int, int]]:
    """(item, start, end, distance) of the best occurrence of each item that a document holds."""
    windows: dict[int, list[tuple[int, int]]] = {}
    for last, (length, where) in pieces.iter(text):
        begin = last + 1 - length
        for k, offset in where:
            p = patterns[k]
            lo = max(0, begin - offset - p.budget)
            hi = min(len(text), begin - offset + p.size + p.budget)
            spans = windows.setdefault(k, [])
            if spans and lo <= spans[-1][1]:   # windows that overlap are one; the scan goes from left to right
                spans[-1] = (min(lo, spans[-1][0]), max(hi, spans[-1][1]))
            else:
                spans.append((lo, hi))
    found = []
    for k, spans in windows.items():
        p, best = patterns[k], None
        for lo, hi in spans:
            exact = text.find(p.text, lo, hi)
            if exact >= 0:
                best = (p.item_id, exact, exact + p.size, 0)
                break
            distance, end = nearest(p.forward, p.size, text[lo:hi])
            if distance <= p.budget and (best is None or distance < best[3]):
                _, length = nearest(p.backward, p.size, text[lo:lo + end][::-1], anchored=True)
                best = (p.item_id, lo + end - length, lo + end, distance)
        if best:
            found.append(best)
    return sorted(found, key=lambda h: (h[0] is None, h))


def _scan(docs: DataFrame, text: str, items: list[tuple[Any, str]], hit: T.StructType, column: str) -> DataFrame:
    names = docs.columns
    at = names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(items)
    kind = to_arrow_type(T.ArrayType(hit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [Pattern(i, t) for i, t in shared.value]
        pieces = automaton(patterns)
        for batch in batches:
            hits = [[dict(zip(("item_id", "start", "end", "distance"), h)) for h in occurrences(normal_form(t), patterns, pieces)]
                    if pieces else [] for t in as_bytes(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, kind)], [*names, column])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(column, T.ArrayType(hit))]))


def item_blocks(items: DataFrame, item_id: str, text: str, max_chars: int = MAX_CHARS) -> Iterator[list[tuple[Any, str]]]:
    """The items in normal form, in blocks of about ``max_chars`` characters, one block on the driver at a time."""
    rows = items.select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = 1 if total <= max_chars else -(-2 * total // max_chars)
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        block = [(r["i"], normal_form(r["t"].encode())) for r in part.collect()]
        yield sorted({x for x in block if x[1]}, key=lambda x: (x[0] is None, x))


def scan(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``benchmark_hits``: for each item found the best occurrence (positions in the normal form)."""
    hit = hit_type(items.schema[item_id].dataType)
    out = numbered(docs).withColumn("benchmark_hits", F.array().cast(T.ArrayType(hit)))
    at = docs.columns.index(text)
    for n, block in enumerate(item_blocks(items, item_id, item_text)):
        out = materialize(out, "scanned") if n else out      # tasks never hold two blocks
        out = _scan(out, f"c{at}", block, hit, "more").withColumn("benchmark_hits", F.concat("benchmark_hits", "more")).drop("more")
    return renamed(out, docs.columns, "benchmark_hits")


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item, whatever its id."""
    names = docs.columns
    items = items.select(F.xxhash64("text").alias("item_id"), "text")
    marked = scan(numbered(docs), items, f"c{names.index(text)}")
    return renamed(marked.where(F.size("benchmark_hits") == 0), names)


__all__ = ["scan", "clean_documents", "occurrences", "nearest", "Pattern", "automaton", "normal_form"]
