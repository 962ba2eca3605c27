"""Token ids in shard files under Re-Pair grammar compression.

Tokenising. Whole texts are encoded by a public tokenizer (its file's path is a parameter) without special tokens, and an end id
follows each document. The pre-tokenizer begins a new piece at a space that stands alone between other characters, and merges stay in a piece,
so a text without runs of white space is encoded word by word (with the leading space). A piece also begins at a mark after an ASCII letter or digit
and at a single line feed between visible ASCII characters, so words are cut there too. Many texts are cut at once, each of their distinct
parts is looked up once, the library encodes it when it is new, and a bounded table has the ids of the others. Other texts, and those that hold
an added token, go to the library whole. The ids equal those of the whole text (tested).

Re-Pair. Documents in ascending id order are packed to shards of about ``SHARD_IDS`` ids. In each shard
the most frequent pairs of neighbouring ids are replaced by new ids (nonterminals), again and again, until no pair occurs ``MIN_COUNT``
times. A round replaces the ``PAIRS`` most frequent pairs wherever
the neighbouring places hold no more frequent one: numpy over the whole shard. Pairs with the end id are never replaced, so every document is a symbol range of its own.

File format of a shard (little-endian): magic ``RPR1``, counts (documents, symbols, rules), the first symbol of
each document, the rules (two 32-bit symbols each, first new symbol is ``TERMINALS``), the expansion length of each rule and the
symbols (low 16 bits of each, then the rest of each in a byte). The expansion lengths give random access: ``decode_range`` skips symbols until the wanted id and expands only what
overlaps the range. Shards are binary values of a Parquet table (shard order, first document, ids), so Spark's own
writer puts them wherever it can write.

Scale: texts move once, by range of id; a task holds one shard's ids. Start offsets come from the shard
table: sums for each task, then a running sum over tasks, one row each.

Defined results: a null text is empty: only the end id; null ids come first; rows that repeat an id follow each other in the order of
their text hash; an empty table gives an empty result; other columns are not stored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areascope.llm.common import map_arrow, text_or_empty
from areascope.llm.textops import as_bytes, chunks, mix64

#: Ids of a shard, fewest occurrences of a replaced pair, pairs replaced in a round.
SHARD_IDS, MIN_COUNT, PAIRS = 1 << 20, 16, 8192
#: The id after each document; ids from here on are nonterminals; words of the table; words learned in one text;
#: bytes of texts encoded at once (or one longer text).
END_ID, TERMINALS, TABLE, WORDS_AT_ONCE, TEXT_BYTES = 0, 1 << 16, 1_500_000, 200, 16 << 20
MAGIC = b"RPR1"
#: A space next to white space (in a wider sense than the pre-tokenizer's).
_RUN = re.compile(r" (?:(?=\s)|(?<=\s ))")
#: Kinds of bytes: an ASCII letter or digit, another visible ASCII character, a line feed, a space, any other.
_ALNUM, _MARK, _LINE, _SPACE, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127] = [_ALNUM if chr(i).isalnum() else _MARK for i in range(33, 127)]
_KIND[10], _KIND[32] = _LINE, _SPACE
#: Bytes of a word that are hashed.
HASHED = 64
#: Places of the pair table, and its hash multipliers by round.
SLOT_BITS = 18
_HASHES = np.random.default_rng(1).integers(1, 2**63, 7, dtype=np.uint64) | np.uint64(1)


class Encoder:
    """Encodes texts by a byte-level tokenizer file, with a bounded table of the ids of words, with their
    leading space, and of other parts of texts. The table is Arrow and numpy columns; when it is full, the words met longest ago leave it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each id: a byte-level vocabulary writes every byte as one character.
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = pa.array([], pa.large_string())
        #: Ids of all words end to end; the number of ids, and the last turn, of each word.
        self.ids, self.n, self.met, self.turn = np.empty(0, "<u4"), np.empty(0, np.int32), np.empty(0, np.int32), 0
        #: Hashes of all words in ascending order, and the place of each.
        self.hashes, self.at = np.empty(0, np.uint64), np.empty(0, np.int32)

    def _encoded(self, words: pa.Array, lead: str) -> None:
        """Put the ids of new words in the table: many are encoded in one text, ``lead`` before each, and their ids taken apart by the widths."""
        if not len(words):
            return
        wide = np.diff(_offsets(words)) + 1   # each word and its lead
        words_ = words.to_pylist()
        starts = range(0, len(words_), WORDS_AT_ONCE)
        got = self.tokenizer.encode_batch_fast([lead + lead.join(words_[lo:lo + WORDS_AT_ONCE]) for lo in starts], add_special_tokens=False)
        ids, n = [self.ids], [self.n]
        for lo, one in zip(starts, got):
            some = np.array(one.ids, "<u4")
            reach = np.cumsum(self.width[some])
            ends = np.cumsum(wide[lo:lo + WORDS_AT_ONCE])
            last = np.searchsorted(reach, ends)
            first = np.concatenate(([0], last[:-1] + 1))
            if not np.array_equal(reach[np.minimum(last, len(reach) - 1)], ends) or lead != " " and (self.width[some[first]] != 1).any():
                raise ValueError("the tokenizer is not byte-level: ids do not end where words do")
            ids.append(some if lead == " " else np.delete(some, first))
            n.append((last - first + (lead == " ")).astype(np.int32))
        self.ids, self.n = np.concatenate(ids), np.concatenate(n)
        self.met = np.concatenate((self.met, np.full(len(words), self.turn, np.int32)))

    def _learn(self, words: pa.Array) -> None:
        """Encode new words that a space leads (not in ``words``)."""
        self._encoded(words, " ")

    def _learn_parts(self, parts: pa.Array) -> None:
        """Encode new parts without a leading space. A line feed before each is a piece of its own."""
        self._encoded(parts, "\n")

    def _keep(self, at: np.ndarray) -> None:
        """Leave only the words at these places in the table."""
        self.ids = _laid_out(self.ids, (np.cumsum(self.n) - self.n)[at], self.n[at])
        self.words, self.n, self.met = self.words.take(pa.array(at)), self.n[at], self.met[at]
        place = np.full(len(self.at), -1, np.int32)
        place[at] = np.arange(len(at))
        moved = place[self.at]
        self.hashes, self.at = self.hashes[moved >= 0], moved[moved >= 0]

    def _places(self, names: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Where each name is in the table, -1 if nowhere. Words found by their hash are compared; those that share another word's are searched for."""
        place = np.full(len(names), -1, np.int64)
        if not len(self.words):
            return place
        order = np.argsort(hashes)
        near = np.minimum(np.searchsorted(self.hashes, hashes[order]), len(self.hashes) - 1)
        same = self.hashes[near] == hashes[order]
        found, at = order[same], self.at[near[same]]
        place[found] = at
        wrong = found[pc.not_equal(names.take(pa.array(found)), self.words.take(pa.array(at))).to_numpy(zero_copy_only=False)]
        if len(wrong):
            place[wrong] = pc.fill_null(pc.index_in(names.take(pa.array(wrong)), value_set=self.words), -1).to_numpy()
        return place

    def _add(self, words: pa.Array, hashes: np.ndarray) -> None:
        """Put new words at the end of the table."""
        order = np.argsort(hashes)
        where = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.at = np.insert(self.hashes, where, hashes[order]), np.insert(self.at, where, len(self.words) + order)
        self.words = pa.concat_arrays([self.words, words])

    def _part_ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts (words with their leading space among them), end to end, and the number of ids of each part. Each distinct part is
        looked up once."""
        coded = parts.dictionary_encode()
        names = coded.dictionary
        hashes = _hashes(names)
        self.turn += 1
        place = self._places(names, hashes)
        new = int((place < 0).sum())
        self.met[place[place >= 0]] = self.turn
        if len(self.words) + new > TABLE and len(self.words):
            self._keep(np.flatnonzero((self.met > np.median(self.met)) | (self.met == self.turn)))
            place = self._places(names, hashes)
        if new:
            unknown, spaced = place < 0, pc.starts_with(names, " ").to_numpy(zero_copy_only=False)
            words, others = np.flatnonzero(unknown & spaced), np.flatnonzero(unknown & ~spaced)
            place[words], place[others] = len(self.words) + np.arange(len(words)), len(self.words) + len(words) + np.arange(len(others))
            self._learn(pc.utf8_slice_codeunits(names.take(pa.array(words)), 1))
            self._learn_parts(names.take(pa.array(others)))
            added = np.concatenate((words, others))
            self._add(names.take(pa.array(added)), hashes[added])
        place = place[coded.indices.to_numpy()]
        n = self.n[place]
        return _laid_out(self.ids, (np.cumsum(self.n, dtype=np.int64) - self.n)[place], n), n

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        plain = [bool(t) and not (t[0].isspace() or t[-1].isspace() or _RUN.search(t) or any(a in t for a in self.added)) for t in texts]
        out = [np.empty(0, "<u4")] * len(texts)
        whole = [i for i, p in enumerate(plain) if not p and texts[i]]
        for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4")
        if any(plain):
            cut = [t.encode() for t, p in zip(texts, plain) if p]
            start, parts = _parts(cut)
            ids, n = self._part_ids(parts)
            reach = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))[start].tolist()
            for i, x, y in zip((i for i, p in enumerate(plain) if p), reach, reach[1:]):
                out[i] = ids[x:y]
        return out


def _parts(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Texts cut where the pre-tokenizer surely begins a piece: the number of each text's first part (and of all parts), and the parts end to end."""
    data = b"".join(texts)
    kind = _KIND[np.frombuffer(data, np.uint8)]
    cut = np.zeros(len(kind) + 1, bool)
    cut[:-1] = kind == _SPACE
    cut[1:-1] |= (kind[:-1] == _ALNUM) & (kind[1:] == _MARK)
    line = np.flatnonzero(kind[1:-1] == _LINE) + 1
    cut[line[(kind[line - 1] <= _MARK) & (kind[line + 1] <= _MARK)]] = True
    at = np.cumsum([0, *map(len, texts)])
    cut[at] = True
    at_cut = np.flatnonzero(cut)
    parts = pa.LargeStringArray.from_buffers(len(at_cut) - 1, pa.py_buffer(at_cut), pa.py_buffer(data))
    return np.searchsorted(at_cut, at), parts


def _offsets(words: pa.Array) -> np.ndarray:
    """Where each word of the large type begins, and the last one ends, in bytes."""
    return np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words of the large type: of their lengths and first ``HASHED`` bytes, eight at a time."""
    at = _offsets(words)
    start, n = at[:-1], np.diff(at)
    data = np.concatenate((np.frombuffer(words.buffers()[2] or b"", np.uint8, at[-1]), np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out, todo = mix64(n.astype(np.uint64)), np.flatnonzero(n)
    for k in range(0, HASHED, 8):
        unused = np.maximum(k + 8 - n[todo], 0).astype(np.uint64) << np.uint64(3)   # bits after the word
        out[todo] = mix64(out[todo] * _HASHES[0] + (eight[start[todo] + k] << unused))
        todo = todo[n[todo] > k + 8]
    return out


def _laid_out(ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranges of ``n`` ids from ``start`` on, end to end."""
    end = np.cumsum(n, dtype=np.int64)
    out = np.empty(end[-1] if len(end) else 0, ids.dtype)
    for lo in range(0, len(n), 1 << 17):   # the places of a part at a time, as they take more room than the ids
        at = slice(lo, lo + (1 << 17))
        first, last = end[lo] - n[lo], end[at][-1]
        out[first:last] = ids[np.repeat(start[at] - (end[at] - n[at]) + first, n[at]) + np.arange(last - first)]
    return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker, which may run many tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # a task has one core
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _frequent(s: np.ndarray, at: np.ndarray, turn: int, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs that start at the places ``at``: those that occur ``min_count`` times (the ``PAIRS`` most frequent, in this order), the
    places of these with the number of the pair, and all places whose pair may occur ``min_count`` times.

    Pairs are counted in a hash table of ``2 ** SLOT_BITS`` places, which belongs to one pair for each place. Only when no owner
    of a place is frequent are the pairs that lost theirs counted too, by sorting, so none is overlooked.
    """
    key = s[at].astype(np.uint64) << np.uint64(32) | s[at + 1]
    slot = ((key * _HASHES[turn % len(_HASHES)]) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)
    may = np.bincount(slot, minlength=1 << SLOT_BITS)[slot] >= min_count
    at, key, slot = at[may], key[may], slot[may]
    pairs = np.zeros(1 << SLOT_BITS, np.uint64)
    pairs[slot] = key
    owned = pairs[slot] == key
    number, where = slot[owned], at[owned]
    count = np.bincount(number, minlength=len(pairs))
    if not (count >= min_count).any():
        pairs, number, count = np.unique(key[~owned], return_inverse=True, return_counts=True)
        where = at[~owned]
    top = np.flatnonzero(count >= min_count)
    if len(top) > PAIRS:
        top = top[np.argpartition(-count[top], PAIRS)[:PAIRS]]
    top = top[np.lexsort((pairs[top], -count[top]))]             # the most frequent pair first
    rank = np.full(len(pairs), len(top), np.uint16)
    rank[top] = np.arange(len(top))
    level = rank[number]
    return pairs[top], where[level < len(top)], level[level < len(top)], at


def compress(ids: np.ndarray, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules (n x 2) of an id sequence; rules refer to ids and to earlier rules. Ends when no pair occurs ``min_count`` times:
    each round replaces at least half the places of its most frequent pair.

    A pair that was not frequent can only become so next to a new symbol, so later rounds count at few places.
    """
    s = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    n_rules, turn = 0, 0
    at = np.arange(len(s) - 1)
    while len(at := at[(s[at] != END_ID) & (s[at + 1] != END_ID)]):
        pair, where, number, at = _frequent(s, at, turn, min_count)
        turn += 1
        level = np.full(len(s) + 1, len(pair), np.uint16)        # of the pair that starts at each place; the last one is before the first
        level[where] = number
        # a place is replaced if no neighbouring place holds a more frequent pair; of a run of one pair (of one id) every second place
        free = where[(number <= level[where - 1]) & (number <= level[where + 1])]
        first = np.flatnonzero(np.diff(free, prepend=-2) != 1)
        nth = np.arange(len(free)) - np.repeat(first, np.diff(first, append=len(free)))
        places = free[nth % 2 == 0]
        number = level[places]
        keep = np.bincount(number, minlength=len(pair)) >= 2
        places, number = places[keep[number]], (np.cumsum(keep) - 1)[number[keep[number]]]
        pair = pair[keep]
        if not len(pair):
            break
        s[places] = TERMINALS + n_rules + number
        stay, look = np.ones(len(s), bool), np.zeros(len(s), bool)
        stay[places + 1] = False
        look[at] = look[places] = look[places[places > 0] - 1] = True
        s, look = s[stay], look[stay]
        at = np.flatnonzero(look[:-1])
        rules.append(np.stack((pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)), axis=1))
        n_rules += len(pair)
    return s, (np.concatenate(rules) if rules else np.empty((0, 2))).astype(np.uint32)


def expansion_lengths(rules: np.ndarray) -> np.ndarray:
    """Ids that each rule stands for."""
    out = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = (out[a - TERMINALS] if a >= TERMINALS else 1) + (out[b - TERMINALS] if b >= TERMINALS else 1)
    return out


def expansions(rules: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids that each symbol stands for, end to end, with the start and length of each symbol's. Rules of one depth are expanded together."""
    depth = [0] * len(rules)
    for i, (a, b) in enumerate(rules.tolist()):
        depth[i] = 1 + max(depth[a - TERMINALS] if a >= TERMINALS else 0, depth[b - TERMINALS] if b >= TERMINALS else 0)
    order = np.argsort(depth, kind="stable")
    length = np.concatenate((np.ones(TERMINALS, np.int64), expansion_lengths(rules)))
    start = np.arange(len(length))
    start[TERMINALS + order] = TERMINALS + np.cumsum(length[TERMINALS + order]) - length[TERMINALS + order]
    ids = np.empty(length.sum(), np.uint32)
    ids[:TERMINALS] = np.arange(TERMINALS)
    for level in np.split(order, np.cumsum(np.bincount(depth, minlength=1))[:-1]):
        if len(level):
            both = rules[level].ravel()
            first = start[TERMINALS + level[0]]
            ids[first:first + length[both].sum()] = _laid_out(ids, start[both], length[both])
    return ids, start, length


def expand(symbols: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of symbols, by the table of ``expansions``."""
    ids, start, length = table
    return _laid_out(ids, start[symbols], length[symbols])


def write_shard(documents: list[np.ndarray]) -> bytes:
    """The file of a shard, from the ids of each document with the end id."""
    ids = np.concatenate(documents)
    if len(ids) and int(ids.max()) >= TERMINALS:
        raise ValueError(f"ids from {TERMINALS} on are symbols of the grammar")
    symbols, rules = compress(ids)
    if len(rules) > (1 << 24) - TERMINALS:
        raise ValueError("a symbol of the file has 24 bits")
    ends = np.flatnonzero(symbols == END_ID) if END_ID in ids else np.empty(0, np.int64)
    # an id equal to the end id inside a document is never part of a pair, so it is counted through
    at_end = np.cumsum([len(d) for d in documents])
    lengths = np.ones(len(symbols), np.int64)
    rule_lengths = expansion_lengths(rules)
    new = symbols >= TERMINALS
    lengths[new] = rule_lengths[symbols[new] - TERMINALS]
    first = np.searchsorted(np.cumsum(lengths), np.concatenate(([0], at_end[:-1])), side="right")
    assert len(ends) >= len(documents)
    return b"".join((MAGIC, struct.pack("<III", len(documents), len(symbols), len(rules)), first.astype("<u4").tobytes(),
                     rules.astype("<u4").tobytes(), rule_lengths.astype("<u4").tobytes(), (symbols & 0xFFFF).astype("<u2").tobytes(),
                     (symbols >> 16).astype("u1").tobytes()))


class Shard:
    """A shard file, decoded as far as asked for."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard file")
        self.n_documents, n, r = struct.unpack_from("<III", data, 4)
        at = 16
        self.first = np.frombuffer(data, "<u4", self.n_documents, at)
        self.rules = np.frombuffer(data, "<u4", 2 * r, at := at + 4 * self.n_documents).reshape(r, 2)
        self.rule_lengths = np.frombuffer(data, "<u4", r, at := at + 8 * r)
        low = np.frombuffer(data, "<u2", n, at := at + 4 * r)
        self.symbols = low.astype(np.uint32) | np.frombuffer(data, "u1", n, at + 2 * n).astype(np.uint32) << 16
        self._table = None

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        if self._table is None:
            self._table = expansions(self.rules)
        return expand(symbols, self._table)

    def document(self, k: int) -> np.ndarray:
        """All ids of the k-th document, its end id included."""
        return self._expand(self.symbols[self.first[k]:self.first[k + 1] if k + 1 < self.n_documents else None])

    def documents(self) -> Iterator[np.ndarray]:
        ids = self._expand(self.symbols)
        starts = self.starts()
        for a, b in zip(starts, np.append(starts[1:], len(ids))):
            yield ids[a:b]

    def starts(self) -> np.ndarray:
        """Ids before each document."""
        total = np.concatenate(([0], np.cumsum(self._lengths(self.symbols))))
        return total[self.first]

    def _lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        new = symbols >= TERMINALS
        out[new] = self.rule_lengths[symbols[new] - TERMINALS]
        return out

    def decode_range(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the k-th document. Walks down the rules by their expansion lengths and expands only what
        overlaps the range: no more than twice as many symbols as ids wanted, and two paths down the grammar."""
        s = self.symbols[self.first[k]:self.first[k + 1] if k + 1 < self.n_documents else None]
        end = np.cumsum(self._lengths(s))
        lo, hi = np.searchsorted(end, start, side="right"), np.searchsorted(end, stop, side="left") + 1
        before = int(end[lo - 1]) if lo else 0
        skip, left, ids = start - before, max(0, stop - start), []
        todo = s[lo:hi][::-1].tolist()
        while todo and len(ids) < left:
            symbol = todo.pop()
            size = int(self.rule_lengths[symbol - TERMINALS]) if symbol >= TERMINALS else 1
            if skip >= size:
                skip -= size
            elif symbol >= TERMINALS:
                todo += self.rules[symbol - TERMINALS][::-1].tolist()
            else:
                ids.append(symbol)
        return np.array(ids, np.uint32)


def write_table(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode, pack and compress ``docs`` in ascending id order to a table of shard files at ``path``:
    (task, shard, ids, doc_ids, data)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), text_or_empty(text).alias("text")).withColumn("h", F.xxhash64("text"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(tasks, F.col("id").asc_nulls_first(), F.col("h")) \
        .sortWithinPartitions(F.col("id").asc_nulls_first(), "h").select("id", "text")
    end = np.array([END_ID], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, task, shard = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        held, ids, size = [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([task], pa.int32()), pa.array([shard], pa.int32()), pa.array([size], pa.int64()),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([write_shard(held)], pa.binary())], ["task", "shard", "ids", "doc_ids", "data"])

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for lo, hi in chunks(texts, TEXT_BYTES):
                for i, got in zip(names[lo:hi], encode([t.decode("utf-8", "replace") for t in texts[lo:hi]])):
                    if held and size + len(got) + 1 > shard_ids:
                        yield flush()
                        held, ids, size, shard = [], [], 0, shard + 1
                    held.append(np.concatenate((got, end)))
                    ids.append(i)
                    size += len(got) + 1
        if held:
            yield flush()

    map_arrow(rows, run, "task int, shard int, ids bigint, doc_ids array<bigint>, data binary").write.mode("overwrite").parquet(path)


def read_table(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), one row for each document, from the shard files of ``write_table``."""
    files = spark.read.parquet(path)
    tasks = files.groupBy("task").agg(F.sum("ids").alias("ids"))
    # one row for each writing task
    before = Window.partitionBy(F.lit(0)).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select(F.col("task").alias("t"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("task_start"))
    inside = Window.partitionBy("task").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("task", "shard", "ids").withColumn("inside", F.coalesce(F.sum("ids").over(inside), F.lit(0)))
    starts = starts.join(tasks, F.col("task") == F.col("t")).select(
        "task", "shard", (F.col("inside") + F.col("task_start")).alias("shard_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task, shard, ids, data in zip(*(batch.column(i) for i in range(4))):
                file = Shard(data.as_py())
                docs = list(file.documents())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task.as_py()] * len(docs), pa.int32()), pa.array([shard.as_py()] * len(docs), pa.int32()),
                     pa.array(ids.as_py(), pa.int64()), pa.array(file.starts().astype(np.int64)),
                     pa.array([len(d) for d in docs], pa.int64()), pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in docs], pa.int64())],
                    ["task", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = map_arrow(files.select("task", "shard", "doc_ids", "data"), run,
                     "task int, shard int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(starts, ["task", "shard"]).select("doc_id", (F.col("inside") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
