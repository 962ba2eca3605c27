"""Quality rules: base counts, and a calibrated logistic regression on hashed word and character n-grams.

Features of a text: word 1- and 2-grams and character 3-grams (of code points), hashed to ``2 ** BITS``
weights; the score is the mean weight of the word grams plus the mean weight of the character grams
plus a bias, so long and short texts are on one scale.

Training takes a bounded sample of labelled rows: of each class the ``MAX_PER_CLASS`` rows with the smallest
md5 of the id (all if there are fewer), joined to their texts, in one task, by full-batch Adam with an L2
penalty. Calibration: ``FOLDS``-fold held-out scores are mapped to probabilities by a logistic fit
(slope and offset) in which each class weighs as much as it does among all labelled rows. Everything else
covers all rows: scoring is one pass of Arrow batches without a shuffle, and the model (256 kB of weights) is the
only thing sent to the tasks.

A document is kept if the base rules pass and the probability of good quality is at least
``THRESHOLD``. Without rows of both classes no model is fitted and the base rules alone decide.

Defined results: a null or empty text has no words, so the base rules fail it; repeated rows are judged
alike; null labels and labels of unknown documents are not used; an empty table gives an empty result; all columns of
the input are carried. Line and window equality is by 64-bit hash within a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areascope.llm.common import hashed_key, map_arrow, numbered, renamed
from areascope.llm.textops import Chunk, as_bytes, by_document, chunks, mix64, seen_twice, window_hash

#: Fixed rules: fewest words, words of a repeat window, largest share of repeated words in percent, symbols.
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT, SYMBOLS = 20, 8, 30, b"#*$%&|<>"
#: Fixed threshold of the calibrated probability.
THRESHOLD = 0.25
#: Bound of the training sample and shape of the model.
MAX_PER_CLASS, BITS, FOLDS, STEPS, RATE, PENALTY = 1000, 16, 4, 120, 0.3, 1e-5
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True

RULE_FIELDS = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]


def base_counts(c: Chunk) -> dict[str, np.ndarray]:
    """The five base counts of each document of a chunk."""
    char_start = (c.buf & 0xC0) != 0x80
    line_end = np.flatnonzero(c.buf == 10)
    line_start = np.concatenate(([0], line_end[:-1] + 1))
    solid = np.concatenate(([0], np.cumsum(c.solid)))
    filled = solid[line_end] > solid[line_start]
    line_start, line_end = line_start[filled], line_end[filled]
    line_doc = np.searchsorted(c.doc_end, line_start, side="right")
    _, later = seen_twice(by_document(c.span_hash(line_start, line_end), line_doc))
    windows, at = window_hash(c.word_hash(), c.doc, REPEAT_WINDOW)
    twice, _ = seen_twice(by_document(windows, c.doc[at]))
    cover = np.zeros(len(c.start) + REPEAT_WINDOW + 1, np.int32)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + REPEAT_WINDOW, -1)
    return {
        "n_words": c.words.astype(np.int64),
        "word_chars": c.per_doc(c.solid & char_start),
        "n_symbols": c.per_doc(_IS_SYMBOL[c.buf]),
        "n_dup_lines": np.bincount(line_doc[later], minlength=c.n).astype(np.int64),
        "n_repeat_words": c.per_doc_words(np.cumsum(cover)[:len(c.start)] > 0),
    }


def _grams(c: Chunk) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(document, feature) of word 1- and 2-grams and of character 3-grams."""
    shift = np.uint64(64 - BITS)
    words = c.word_hash()
    pairs, at = window_hash(words, c.doc, 2)
    word = np.concatenate((c.doc, c.doc[at])), (np.concatenate((mix64(words), pairs)) >> shift).astype(np.int32)
    char_start = (c.buf & 0xC0) != 0x80
    begin = np.flatnonzero(char_start)
    after = np.cumsum(c.per_doc(char_start))      # one past the separator of each document, in characters
    doc = np.repeat(np.arange(c.n), np.diff(after, prepend=0))
    whole = np.ones(max(0, len(begin) - 3), bool)
    for back in (1, 2, 3):                         # a gram must not reach the separator
        out = after - back
        whole[out[(out >= 0) & (out < len(whole))]] = False
    at = np.flatnonzero(whole)
    return word, (doc[at], (c.span_hash(begin[at], begin[at + 3]) >> shift).astype(np.int32))


@dataclass
class Model:
    """Weights of the hashed grams, bias, and slope and offset of the calibration."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def raw(self, c: Chunk) -> np.ndarray:
        total = np.full(c.n, self.bias)
        for doc, gram in _grams(c):
            n = np.bincount(doc, minlength=c.n)
            total += np.bincount(doc, weights=self.weights[gram], minlength=c.n) / np.maximum(n, 1)
        return total

    def probability(self, c: Chunk) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.raw(c) + self.offset, -50, 50)))


def _fit(doc: np.ndarray, gram: np.ndarray, value: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Balanced logistic regression on sparse rows (doc, gram, value) by full-batch Adam."""
    w, b = np.zeros(1 << BITS), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for t in range(1, STEPS + 1):
        z = np.bincount(doc, weights=w[gram] * value, minlength=len(y)) + b
        error = (1.0 / (1.0 + np.exp(-np.clip(z, -50, 50))) - y) * weight
        g = np.append(np.bincount(gram, weights=error[doc] * value, minlength=len(w)) + PENALTY * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic fit of y on z (Newton steps, slightly damped targets)."""
    a, b = 1.0, 0.0
    n1, n0 = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * z + b, -50, 50)))
        g = np.array([np.sum(weight * (p - target) * z), np.sum(weight * (p - target))])
        s = weight * p * (1 - p) + 1e-9
        h = np.array([[np.sum(s * z * z) + 1e-6, np.sum(s * z)], [np.sum(s * z), np.sum(s) + 1e-6]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -2, 2)
    return float(a), float(b)


def fit(texts: list[bytes], y: np.ndarray, share_good: float) -> Model | None:
    """Fit and calibrate on labelled texts; None without both classes."""
    if len(set(y.tolist())) < 2:
        return None
    rows = []
    for lo, hi in chunks(texts):
        c = Chunk(texts[lo:hi])
        for doc, gram in _grams(c):
            n = np.bincount(doc, minlength=c.n)
            key, count = np.unique(doc * (1 << BITS) + gram, return_counts=True)
            d = key >> BITS
            rows.append((d + lo, key & ((1 << BITS) - 1), count / n[d]))
    doc, gram, value = (np.concatenate(x) for x in zip(*rows))
    fold = np.arange(len(y)) % FOLDS
    held_out = np.zeros(len(y))
    for k in range(FOLDS):
        train = fold != k
        if len(set(y[train].tolist())) < 2:
            continue
        pick = train[doc]
        number = np.cumsum(train) - 1
        w, b = _fit(number[doc[pick]], gram[pick], value[pick], y[train])
        out = ~pick
        held_out += np.where(train, 0.0, np.bincount(doc[out], weights=w[gram[out]] * value[out], minlength=len(y)) + b)
    w, b = _fit(doc, gram, value, y)
    weight = np.where(y == 1, share_good / max(1, (y == 1).sum()), (1 - share_good) / max(1, (y == 0).sum())) * len(y)
    return Model(w.astype(np.float32), float(b), *_platt(held_out, y, weight))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality",
          max_per_class: int = MAX_PER_CLASS) -> Model | None:
    """The model of a bounded sample of labelled rows."""
    rows = labels.where(F.col(quality).isin(0, 1) & F.col(doc_id).isNotNull()) \
        .select(F.col(doc_id).alias("_id"), F.col(quality).cast("int").alias("_y"), hashed_key("label", doc_id).alias("_k")) \
        .groupBy("_id", "_k").agg(F.min("_y").alias("_y"))     # one label for each id
    counts = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    sample = [rows.where(F.col("_y") == y).orderBy("_k", "_id").limit(max_per_class) for y in (0, 1)]
    # at most 2 * max_per_class rows: an id has one label and one text
    picked = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).where("_text is not null") \
        .join(F.broadcast(sample[0].unionAll(sample[1])), "_id").groupBy("_id", "_k", "_y").agg(F.min("_text").alias("_text"))
    share = counts[1] / (counts[0] + counts[1])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist()))
        model = fit([t for _, t, _ in rows], np.array([y for _, _, y in rows]), share) if rows else None
        if model:
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.bias]), pa.array([model.slope]),
                                              pa.array([model.offset])], ["weights", "bias", "slope", "offset"])

    got = map_arrow(picked.select("_k", "_text", "_y").repartition(1), learn,
                    "weights binary, bias double, slope double, offset double").collect()
    return Model(np.frombuffer(got[0]["weights"], np.float32), got[0]["bias"], got[0]["slope"], got[0]["offset"]) if got else None


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``quality_rules``: the five counts, ``base_failed``, ``probability``, ``kept``."""
    result = T.StructType([*RULE_FIELDS, T.StructField("base_failed", T.BooleanType()), T.StructField("probability", T.DoubleType()),
                           T.StructField("kept", T.BooleanType())])
    at, rows = docs.columns.index(text), numbered(docs)
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("quality_rules", result)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(at))
            for lo, hi in chunks(texts):
                part = texts[lo:hi]
                c = Chunk(part)
                out = base_counts(c)
                out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
                out["probability"] = model.probability(c) if model else np.ones(c.n)
                out["kept"] = ~out["base_failed"] & (out["probability"] >= THRESHOLD)
                columns = [pa.array(v) for v in out.values()]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.StructArray.from_arrays(columns, list(out))],
                                                 [*names, "quality_rules"])

    return renamed(map_arrow(rows, run, schema), docs.columns, "quality_rules")


def kept_documents(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` without the documents that the rules reject."""
    names = docs.columns
    return renamed(score(numbered(docs), model, f"c{names.index(text)}").where("quality_rules.kept"), names)
