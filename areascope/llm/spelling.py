"""Spelling variants by reduced-alphabet generation.

Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z in lower case; in a document whose crc32 of
``<doc_id>:<run>`` is divisible by ``NOISE`` the run loses one code point. Words of at least ``MIN_LENGTH`` code points and ``MIN_COUNT``
occurrences form the vocabulary.

Two words are near if one inserted, deleted or replaced code point apart. Letters are hashed to ``SYMBOLS`` symbols (the letters of
the vocabulary dealt so that symbols are about equally frequent). The full one-edit neighbourhood of each reduced word - itself, all
deletions, replacements and insertions of a symbol - is generated without repeats as 64-bit polynomial hashes, each in constant time from the
sums before and after the edit, and joined with the reduced vocabulary. What meets is verified on the original strings,
so hashes and the reduction decide about work only. A word of length l makes about 2 * SYMBOLS * l keys.

Nothing grows with a group: a task counts a document's runs, counts are combined before the shuffle, and hub words are keys
of joins that adaptive execution may split. Words longer than ``CARRIED`` travel by their md5 instead of their text, keys in
pieces of ``PIECE``, and are fetched after the join. Forms are followed to the root by pointer jumping; as the count at least doubles with
each step, a chain is short (at most 63 steps).

Defined results: a null or empty text has no runs; a null id counts as the empty text in the hash; every row counts, repeated or not;
ties of a form go to the smallest word in code-point order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areascope.llm.common import map_arrow, text_or_empty
from areascope.llm.textops import as_bytes, mix64
from areascope.session import materialize

#: Shortest word, fewest occurrences, divisor of the hash that deletes a code point, least ratio of counts of form and word.
MIN_LENGTH, MIN_COUNT, NOISE, RATIO = 5, 3, 97, 2
#: Symbols of the reduced alphabet; longest word that travels as text; keys of one row; counter size of a task.
SYMBOLS, CARRIED, PIECE, COUNTER_LIMIT = 6, 64, 1 << 16, 400_000
MAX_JUMPS = 10

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def runs(text: bytes) -> list[bytes]:
    """The maximal runs of letters of a UTF-8 text, A-Z in lower case."""
    b = np.frombuffer(text, np.uint8)
    keep = _LETTER[b]
    lead = b == 0xC3                                   # U+00C0 to U+00FF are C3 80 to C3 BF; every C3 leads a pair
    keep |= lead
    keep[1:] |= lead[:-1]
    return np.where(keep, _FOLD[b], np.uint8(32)).tobytes().split()


def noisy(run: bytes, h: int) -> bytes:
    """The run without its code point ``h % length``."""
    chars = run.decode()
    at = h % len(chars)
    return (chars[:at] + chars[at + 1:]).encode()


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words with their occurrences in all documents."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["w", "c"])

        for batch in batches:
            for key, value in zip(as_bytes(batch.column(0)), as_bytes(batch.column(1))):
                seed, crc = zlib.crc32(key + b":"), zlib.crc32
                for word, n in Counter(runs(value)).items():
                    if len(word) < MIN_LENGTH:         # in bytes, at least the code points
                        continue
                    h = crc(word, seed)
                    if not h % NOISE:
                        word = noisy(word, h)
                    total[word] += n
                if len(total) > COUNTER_LIMIT:
                    yield out()
                    total.clear()
        if total:
            yield out()

    counted = map_arrow(rows, run, "w binary, c bigint").groupBy("w").agg(F.sum("c").alias("n"))
    word = F.col("w").cast("string").alias("word")
    return counted.select(word, "n").where((F.col("n") >= MIN_COUNT) & (F.char_length("word") >= MIN_LENGTH))


def letter_counts(words: DataFrame) -> dict[str, int]:
    """Letters of the vocabulary with their occurrences (the alphabet is fixed, so a handful of numbers)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                total.update(word)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], ["letter", "n"])

    counted = map_arrow(words.select("word"), run, "letter string, n bigint").groupBy("letter").agg(F.sum("n").alias("n"))
    return {r["letter"]: r["n"] for r in counted.collect()}


def reduction(counts: dict[str, int], symbols: int = SYMBOLS) -> np.ndarray:
    """Symbol of each code point up to U+00FF: letters by falling frequency, each to the symbol that has least so far."""
    table, load = np.zeros(256, np.int64), [0] * symbols
    for letter, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        at = load.index(min(load))
        table[ord(letter)] = at
        load[at] += n
    return table


class Neighbourhood:
    """Hashes of reduced words and of their one-edit neighbourhoods."""

    def __init__(self, table: np.ndarray, symbols: int = SYMBOLS):
        self.table, self.symbols = table, symbols
        self.value = np.random.default_rng(12).integers(1, 2**63, symbols, dtype=np.uint64) | np.uint64(1)

    def _sums(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols (words x length), sums before each place (words x (length + 1)) and powers, for words of one length."""
        length = len(words[0])
        s = self.table[np.frombuffer("".join(words).encode("latin-1"), np.uint8)].reshape(len(words), length)
        power = np.full(length + 1, _BASE, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        before = np.zeros((len(words), length + 1), np.uint64)
        np.cumsum(self.value[s] * power[:-1], axis=1, out=before[:, 1:])
        return s, before, power

    def keys(self, words: list[str]) -> np.ndarray:
        """Hash of each reduced word (words of one length)."""
        _, before, _ = self._sums(words)
        return mix64(before[:, -1] + np.uint64(len(words[0])))

    def around(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, number of the word of each): all distinct reduced words at most one edit away (words of one length)."""
        s, before, power = self._sums(words)
        n, length = s.shape
        total = before[:, -1:]
        every = np.arange(n)
        out, of = [mix64(total[:, 0] + np.uint64(length))], [every]
        # a deletion anywhere in a repeat of one symbol gives one word: take its last place
        w, i = np.nonzero(np.concatenate((s[:, 1:] != s[:, :-1], np.ones((n, 1), bool)), axis=1))
        out.append(mix64(before[w, i] + (total[w, 0] - before[w, i + 1]) * np.uint64(_INVERSE) + np.uint64(length - 1)))
        of.append(w)
        for c in range(self.symbols):
            v = self.value[c]
            w, i = np.nonzero(s != c)
            out.append(mix64(total[w, 0] + (v - self.value[s[w, i]]) * power[i] + np.uint64(length)))
            of.append(w)
            # an insertion next to an equal symbol: only behind it
            w, i = np.nonzero(np.concatenate((s != c, np.ones((n, 1), bool)), axis=1))
            out.append(mix64(before[w, i] + v * power[i] + (total[w, 0] - before[w, i]) * np.uint64(_BASE) + np.uint64(length + 1)))
            of.append(w)
        return np.concatenate(out), np.concatenate(of)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Numbers and words of one length, few enough for some 100 MB of work."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
        step = max(1, (1 << 16) // len(words[part[0]]))
        for lo in range(0, len(part), step):
            at = part[lo:lo + step]
            yield at, [words[i] for i in at]


def reduced_vocabulary(words: DataFrame, hood: Neighbourhood) -> DataFrame:
    """``words`` (word, n, id) with the hash ``key`` of the reduced word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            key = np.empty(len(texts), np.uint64)
            for at, part in _by_length(texts):
                key[at] = hood.keys(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64))], ["word", "n", "id", "key"])

    return map_arrow(words.select("word", "n", "id"), run, "word string, n bigint, id string, key bigint")


def neighbourhoods(words: DataFrame, carry: str, hood: Neighbourhood) -> DataFrame:
    """(w, key): the column ``carry`` of each word with every hash of its reduced neighbourhood."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names = batch.column(0).to_pylist(), batch.column(1)
            for at, part in _by_length(texts):
                keys, of = hood.around(part)
                order = np.argsort(of, kind="stable")
                keys = keys[order].view(np.int64)
                ends = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(part)))))
                cuts, owner = [0], []
                for j in range(len(part)):             # a long word fills several rows
                    for lo in range(ends[j], ends[j + 1], PIECE):
                        cuts.append(min(lo + PIECE, ends[j + 1]))
                        owner.append(at[j])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(owner)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(keys))],
                                                 ["w", "keys"])

    return map_arrow(words.select("word", F.col(carry).alias("w")), run, "w string, keys array<bigint>").select("w", F.explode("keys").alias("key"))


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b))
    differ = np.flatnonzero(x != y[:len(x)])
    at = differ[0] if len(differ) else len(x)
    return bool((x[at + (len(a) == len(b)):] == y[at + 1:]).all())


def near_pairs(words: DataFrame) -> DataFrame:
    """(w, v, vn): every word with each word near it and that word's count. ``words`` has (word, n)."""
    words = materialize(words.withColumn("id", F.md5("word")), "words")
    hood = Neighbourhood(reduction(letter_counts(words)))
    known = materialize(reduced_vocabulary(words, hood), "reduced")
    short, long = known.where(F.char_length("word") <= CARRIED), known.where(F.char_length("word") > CARRIED)
    right = known.select("key", F.col("word").alias("v"), F.col("n").alias("vn"))
    # the vocabulary is the built side: the many generated keys are never sorted
    pairs = neighbourhoods(short, "word", hood).join(right.hint("shuffle_hash"), "key") \
        .where(F.levenshtein("w", "v", 1) == 1).select("w", "v", "vn")
    met = neighbourhoods(long, "id", hood).join(right, "key").select(F.col("w").alias("id"), "v", "vn")
    met = met.join(long.select("id", F.col("word").alias("w")), "id").select("w", "v", "vn")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([one_edit(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.bool_()))

    return pairs.unionAll(map_arrow(met, verify, "w string, v string, vn bigint"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each row (word, form) of a table without cycles: forms followed to the last."""
    links = materialize(forms.select("word", F.col("form").alias("root")), "links")
    for _ in range(MAX_JUMPS):
        step = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = materialize(links.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                    F.col("further").isNotNull().alias("moved")), "links")
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")
    raise RuntimeError("forms do not end: counts must at least double with each step")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for each word of the vocabulary."""
    words = materialize(vocabulary(docs, doc_id, text), "vocabulary")
    best = F.min(F.struct((-F.col("vn")).alias("less"), F.col("v").alias("v")))
    near = near_pairs(words).groupBy("w").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(near.withColumnRenamed("w", "word"), "word", "left")
    strong = -F.col("best.less") >= RATIO * F.col("n")
    table = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                      F.when(strong, F.col("best.v")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")), "variants")
    ends = roots(table.where("form is not null").select("word", "form"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
