"""Language-model scores by a gated recurrent network, and unigram base scores.

Tokens are the words (A-Z in lower case) and one end token for each document. Documents whose id's crc32 is divisible by ``HELD_OUT`` are
held out: nothing is learned from them.

Counts. Token counts cover all training tokens. The ``HEAVY`` most frequent words are known to every
task (a bounded broadcast); all other words of a document leave the task as (word, document, times) rows and meet
their counts in a join by word. No group of that join is hot, as hot words are among the frequent ones, and no word is cut off.

Model. The network reads ``SYMBOLS`` symbols: the end, the most frequent words, and buckets of all other words by
their last two bytes. A word of a bucket adds its smoothed share of the bucket's training tokens, so every text has
a probability. The output softmax is factored: 16 classes of 16 symbols, by frequency. The biases start at the unigram
logarithms, so the untrained network is a unigram model.

Training is truncated backpropagation through time in numpy over all training documents: documents run side by side, the state is
carried from window to window, and gradients stop at the window's start. Documents are dealt to ``ROUNDS`` rounds by hash; in a round every task
trains on its documents from the common parameters, and the results are averaged by tokens, first in as many tasks as the square root
of the number of shuffle partitions, then on the driver (140 kB each). So training grows with the corpus and every training document takes part once.

Scoring carries the state through the whole document, window by window; documents of like length run side by side.

Defined results: a null or empty text is the end token alone; a null id counts as the empty text's crc32 (held out);
repeated rows are scored alike (a row's key is made in its task); an empty table gives an empty result; without training documents
all counts are 0 and the network is untrained; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areascope.llm.common import map_arrow, text_or_empty
from areascope.session import materialize

#: Held-out divisor, words that every task knows, smoothing.
HELD_OUT, HEAVY, SMOOTH = 10, 200_000, 0.1
#: Symbols (classes * classes), buckets of other words, state size.
CLASSES, BUCKETS, STATE = 16, 63, 16
SYMBOLS = CLASSES * CLASSES
#: Rounds, most documents side by side, words of a window, and step size in training; the same in scoring.
ROUNDS, BATCH, WINDOW, RATE = 3, 256, 24, 0.005
SCORE_BATCH, SCORE_WINDOW = 512, 64
#: The end token (white space, so no word) and its symbol.
END, END_SYMBOL = b"\n", 0
#: Bytes of texts whose words are told apart at once (or one longer text).
READ_BYTES = 16_000_000


def bucket(word: bytes) -> int:
    """The symbol of a word that has none of its own."""
    return 1 + zlib.crc32(word[-2:]) % BUCKETS


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """A column of texts in parts of about ``READ_BYTES``."""
    reach = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    cut = [0, *np.flatnonzero(np.diff(reach // READ_BYTES, prepend=0)).tolist(), len(texts)]
    for lo, hi in zip(cut, cut[1:]):
        if lo < hi:
            yield texts.slice(lo, hi - lo)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts (bytes), the number of the distinct word at each place, and the words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    blank = pc.equal(pc.binary_length(flat), 0)      # white space at an end of a text leaves an empty part there
    if blank.true_count:
        blank = blank.to_numpy(zero_copy_only=False)
        lengths -= np.bincount(np.repeat(np.arange(len(texts)), lengths)[blank], minlength=len(texts))
        flat = flat.filter(pa.array(~blank))
    coded = flat.dictionary_encode()
    return coded.dictionary.cast(pa.large_binary()), coded.indices.to_numpy(), lengths


def _row_max(x: np.ndarray) -> np.ndarray:
    """The largest of each row as a column, taken across the transposed array: short rows one by one are slow."""
    return np.ascontiguousarray(x.T).max(axis=0)[:, None]


class Network:
    """A gated recurrent unit with a class-factored softmax. ``order`` places symbols in classes."""

    NAMES = ("wx", "u", "c", "bc", "o", "bo")

    def __init__(self, frequency: np.ndarray):
        rng = np.random.default_rng(4)
        place = np.empty(SYMBOLS, np.int64)
        place[np.argsort(-frequency, kind="stable")] = np.arange(SYMBOLS)
        self.cls, self.member = place // CLASSES, place % CLASSES
        p = (frequency + 1.0) / (frequency.sum() + SYMBOLS)
        by_class = np.zeros((CLASSES, CLASSES))
        by_class[self.cls, self.member] = p
        self.p = {
            "wx": rng.normal(0, 0.1, (SYMBOLS, 3 * STATE)), "u": rng.normal(0, 0.2, (STATE, 3 * STATE)),
            "c": np.zeros((STATE, CLASSES)), "bc": np.log(by_class.sum(axis=1)),
            "o": np.zeros((CLASSES, STATE, CLASSES)), "bo": np.log(by_class / by_class.sum(axis=1, keepdims=True)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def dump(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            n = self.p[k].size
            self.p[k] = flat[at:at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n

    def steps(self, x: np.ndarray, h: np.ndarray, kept: list | None = None) -> np.ndarray:
        """States after each row of symbols ``x`` (words x documents) from states ``h``."""
        wx, u = self.p["wx"], self.p["u"]
        out = np.empty((len(x), len(h), STATE), np.float32)
        for t, symbols in enumerate(x):
            a, hu = wx[symbols], h @ u
            gates = np.tanh((a[:, :2 * STATE] + hu[:, :2 * STATE]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
            r, z = gates[:, :STATE], gates[:, STATE:]
            n = np.tanh(a[:, 2 * STATE:] + r * hu[:, 2 * STATE:])
            if kept is not None:
                kept.append((h, r, z, n, hu[:, 2 * STATE:]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def log_probability(self, states: np.ndarray, y: np.ndarray, gradient: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of targets ``y`` after ``states`` (rows); with ``gradient``, sums the gradients of minus its sum
        and returns those of the states."""
        c = self.cls[y]
        logits = states @ self.p["c"] + self.p["bc"]
        logits -= _row_max(logits)
        e = np.exp(logits)
        total = e.sum(axis=1)
        rows = np.arange(len(y))
        out = logits[rows, c] - np.log(total)
        back = None
        if gradient is not None:
            d = e / total[:, None]
            d[rows, c] -= 1
            gradient["c"] += states.T @ d
            gradient["bc"] += d.sum(axis=0)
            back = d @ self.p["c"].T
        # rows by class: those of a class are one range
        order = np.argsort(c.astype(np.uint8), kind="stable")
        ends = np.cumsum(np.bincount(c, minlength=CLASSES)).tolist()
        ranges = [(k, slice(lo, hi)) for k, (lo, hi) in enumerate(zip([0, *ends], ends)) if lo < hi]
        states, m = states[order], self.member[y[order]]
        inner = np.empty((len(y), CLASSES), np.result_type(states, self.p["o"]))
        for k, at in ranges:
            np.add(states[at] @ self.p["o"][k], self.p["bo"][k], out=inner[at])
        inner -= _row_max(inner)
        e = np.exp(inner)
        total = e.sum(axis=1)
        out[order] += inner[rows, m] - np.log(total)
        if gradient is not None:
            d = e / total[:, None]
            d[rows, m] -= 1
            more = np.empty_like(back)
            for k, at in ranges:
                gradient["o"][k] += states[at].T @ d[at]
                gradient["bo"][k] += d[at].sum(axis=0)
                more[at] = d[at] @ self.p["o"][k].T
            back[order] += more
        return out, back

    def train_window(self, x: np.ndarray, y: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, dict]:
        """One window of truncated backpropagation: the state after it, and the mean gradients."""
        kept: list = []
        states = self.steps(x, h, kept)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        flat = live.ravel()
        _, back = self.log_probability(states.reshape(-1, STATE)[flat], y.ravel()[flat], grad)
        down = np.zeros((x.size, STATE), np.float32)
        down[flat] = back
        down = down.reshape(states.shape)
        u_t = self.p["u"].T
        before, r, z, n, hn = (np.stack(k) for k in zip(*kept))
        not_r, not_z, slope, change = 1 - r, 1 - z, 1 - n * n, before - n
        da = np.empty((*x.shape, 3 * STATE), np.float32)
        du = np.empty_like(da)
        dh = np.zeros_like(h)
        for t in range(len(x) - 1, -1, -1):
            dh = dh + down[t]
            dn = dh * not_z[t] * slope[t]
            du[t, :, :STATE] = dn * hn[t] * r[t] * not_r[t]
            du[t, :, STATE:2 * STATE] = dh * change[t] * z[t] * not_z[t]
            du[t, :, 2 * STATE:] = dn * r[t]
            da[t, :, 2 * STATE:] = dn
            dh = dh * z[t] + du[t] @ u_t
        da[:, :, :2 * STATE] = du[:, :, :2 * STATE]
        grad["u"] += before.reshape(-1, STATE).T @ du.reshape(-1, 3 * STATE)
        symbols = x.ravel()
        order = np.argsort(symbols, kind="stable")
        edge = np.flatnonzero(np.diff(symbols[order], prepend=-1))
        grad["wx"][symbols[order][edge]] += np.add.reduceat(da.reshape(-1, 3 * STATE)[order], edge, axis=0)
        n = max(1, int(flat.sum()))
        return states[-1], {k: g / n for k, g in grad.items()}


class Adam:
    """Adam with clipped gradients."""

    def __init__(self, net: Network, rate: float = RATE):
        self.net, self.rate, self.t = net, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.p.items()}

    def step(self, grad: dict) -> None:
        self.t += 1
        size = math.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        clip = min(1.0, 1.0 / (size + 1e-9))
        for k, g in grad.items():
            g = g * np.float32(clip)
            self.m[k] += np.float32(0.1) * (g - self.m[k])
            self.v[k] += np.float32(0.01) * (g * g - self.v[k])
            self.net.p[k] -= np.float32(self.rate) * (self.m[k] / np.float32(1 - 0.9**self.t)) / (
                np.sqrt(self.v[k] / np.float32(1 - 0.99**self.t)) + np.float32(1e-6))


def side_by_side(documents: list[np.ndarray], batch: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of documents of like length, longest first: (their numbers, symbols as words x documents, lengths)."""
    lengths = np.fromiter(map(len, documents), np.int64, len(documents))
    order = np.argsort(-lengths, kind="stable")
    for lo in range(0, len(order), batch):
        at = order[lo:lo + batch]
        n = lengths[at]
        y = np.zeros((n[0], len(at)), np.uint8)
        for j, k in enumerate(at):
            y[:n[j], j] = documents[k]
        yield at, y, n


def train(net: Network, documents: list[np.ndarray], adam: Adam) -> int:
    """One pass over documents (symbols, the end last); returns the tokens seen. An eighth of them run side by side, so
    that few documents still make many steps, but ``BATCH`` at most."""
    seen = 0
    for _, y, n in side_by_side(documents, min(BATCH, 16 + len(documents) // 8)):
        h = np.zeros((y.shape[1], STATE), np.float32)
        last = np.full(y.shape[1], END_SYMBOL, np.uint8)
        for t in range(0, len(y), WINDOW):
            live = int((n > t).sum())
            part = y[t:t + WINDOW, :live]
            x = np.concatenate((last[None, :live], part[:-1]))
            mask = np.arange(t, t + len(part))[:, None] < n[None, :live]
            h, grad = net.train_window(x, part, mask, h[:live])
            adam.step(grad)
            last = part[-1]
            seen += int(mask.sum())
    return seen


def log10_probabilities(net: Network, documents: list[np.ndarray]) -> np.ndarray:
    """The log10 probability of each document's symbols, state carried from start to end."""
    out = np.zeros(len(documents))
    for at, y, n in side_by_side(documents, SCORE_BATCH):
        h = np.zeros((y.shape[1], STATE), np.float32)
        last = np.full(y.shape[1], END_SYMBOL, np.uint8)
        for t in range(0, len(y), SCORE_WINDOW):
            live = int((n > t).sum())
            part = y[t:t + SCORE_WINDOW, :live]
            x = np.concatenate((last[None, :live], part[:-1]))
            mask = np.arange(t, t + len(part))[:, None] < n[None, :live]
            states = net.steps(x, h[:live])
            logs, _ = net.log_probability(states.reshape(-1, STATE)[mask.ravel()], part.ravel()[mask.ravel()])
            grid = np.zeros(mask.shape)
            grid[mask] = logs
            out[at[:live]] += grid.sum(axis=0)
            h, last = states[-1], part[-1]
    return out / math.log(10)


def token_counts(rows: DataFrame) -> DataFrame:
    """(word, c): counts of all training tokens; a task sends each word once for each ``READ_BYTES``, combined before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1).filter(pc.invert(batch.column(2)))):
                words, at, _ = words_of(texts)
                words = pa.concat_arrays([words, pa.array([END], pa.large_binary())]).cast(pa.binary())
                counts = np.append(np.bincount(at, minlength=len(words) - 1), len(texts))
                yield pa.RecordBatch.from_arrays([words, pa.array(counts.astype(np.int64))], ["word", "c"])

    return map_arrow(rows, run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """What every task knows: the frequent words with their counts and symbols, and the totals of the buckets."""

    def __init__(self, words: list[bytes], counts: list[int], totals: dict[int, tuple[int, int]]):
        n_own = SYMBOLS - 1 - BUCKETS
        self.words = pa.array(words, pa.large_binary())
        self.end = words.index(END) if END in words else -1
        own = [w for w in words if w != END][:n_own]
        symbol_of = {w: 1 + BUCKETS + i for i, w in enumerate(own)} | {END: END_SYMBOL}
        self.symbols = np.array([symbol_of.get(w) or (END_SYMBOL if w == END else bucket(w)) for w in words], np.uint8)
        c = np.array(counts, np.float64)
        self.log_count = np.log10(c + SMOOTH)
        # buckets hold what has no symbol of its own
        tokens_, kinds = np.zeros(SYMBOLS), np.zeros(SYMBOLS)
        for b, (n, v) in totals.items():
            tokens_[b], kinds[b] = n, v
        self.frequency = tokens_.copy()
        for w, n in zip(words, counts):
            s = symbol_of.get(w)
            if s is not None:
                self.frequency[s] = n
                if w != END:
                    tokens_[bucket(w)] -= n
                    kinds[bucket(w)] -= 1
                    self.frequency[bucket(w)] -= n
        self.log_bucket = np.log10(tokens_ + SMOOTH * (kinds + 1))

    def number(self, words: pa.Array) -> np.ndarray:
        """The numbers of words, -1 for those that are not frequent."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()

    def symbols_of(self, words: pa.Array, number: np.ndarray) -> np.ndarray:
        """The symbols of words with their numbers."""
        if not len(words):
            return np.empty(0, np.uint8)
        end = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        out = self.symbols[number] if len(self.symbols) else np.empty(len(words), np.uint8)
        other = np.flatnonzero(number < 0)
        last = data[end[other + 1] - 1].astype(np.int64)
        first = np.where(np.diff(end)[other] > 1, data[end[other + 1] - 2], 256)   # 256: a word of one byte
        out[other] = _buckets()[first, last]
        return out

    def read(self, texts: pa.Array) -> tuple[list[np.ndarray], pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The symbols of each text, and of all texts the distinct words, their numbers, the number of the distinct word at each place, and the
        words of each text."""
        words, at, lengths = words_of(texts)
        number = self.number(words)
        ends = np.cumsum(lengths + 1)
        flat = np.full(len(at) + len(texts), END_SYMBOL, np.uint8)
        flat[np.arange(len(at)) + np.repeat(np.arange(len(texts)), lengths)] = self.symbols_of(words, number)[at]
        return [flat[lo:hi] for lo, hi in zip([0, *ends.tolist()], ends.tolist())], words, number, at, lengths


@functools.cache
def _buckets() -> np.ndarray:
    """The symbols of words by their last byte but one (256: none) and their last byte."""
    return np.array([[bucket(bytes((a, b)) if a < 256 else bytes((b,))) for b in range(256)] for a in range(257)], np.uint8)


_LEXICONS: dict[str, Lexicon] = {}


def lexicon_of(known) -> Lexicon:
    """The lexicon of a name and a broadcast in this Python worker, which may run many tasks; only the last one is kept."""
    name, value = known
    if name not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[name] = Lexicon(*value.value)
    return _LEXICONS[name]


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each document."""
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"), (held % HELD_OUT == 0).alias("held"),
                       (F.floor(held / HELD_OUT) % ROUNDS).cast("int").alias("round"))
    counts = materialize(token_counts(rows), "counts")
    words, numbers = heavy_words(counts)
    if END not in words:   # known to all tasks besides the limit
        for r in counts.where(F.col("word") == F.lit(bytearray(END))).collect():
            words.append(END)
            numbers.append(r["c"])
    in_bucket = (F.crc32(F.expr("substring(word, greatest(length(word) - 1, 1), 2)")) % BUCKETS + 1).cast("int")
    sums = counts.groupBy(F.when(F.col("word") == F.lit(bytearray(END)), END_SYMBOL).otherwise(in_bucket).alias("b")) \
        .agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()             # one row for each bucket
    n_train, n_kinds = sum(r["n"] for r in sums), sum(r["v"] for r in sums)
    totals = {r["b"]: (r["n"], r["v"]) for r in sums if r["b"] != END_SYMBOL}
    known = uuid.uuid4().hex, spark.sparkContext.broadcast((words, numbers, totals))
    net = Network(Lexicon(words, numbers, totals).frequency)
    if n_train:
        for turn in range(ROUNDS):
            net.load(_train_round(rows, known, net.dump(), turn))
    scored = materialize(_score_rows(rows, known, net.dump()), "scored")
    # the other words meet their counts
    rest = scored.select("key", F.explode(F.arrays_zip("words", "times")).alias("x")).select("key", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rest = rest.join(counts, "word", "left").groupBy("key").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("logs"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("found"))
    out = scored.drop("words", "times").join(rest, "key", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        F.col("id").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("logs_heavy") + logs - F.col("n_tokens") * math.log10(n_train + SMOOTH * (n_kinds + 1))).alias("base_score"),
        (F.col("logs_model") + logs).alias("score"))


def heavy_words(counts: DataFrame) -> tuple[list[bytes], list[int]]:
    """The most frequent words and their counts, the most frequent first: all whose count lies above a cut that leaves HEAVY at most, found by
    a histogram of 64 steps an octave, and in any case those that can have a symbol of their own. No table is sorted in one task."""
    step = F.floor(F.log2(F.col("c")) * 64)
    total, cut = 0, None
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect(), reverse=True):   # 64 * 63 rows at most
        total += r["n"]
        if total > HEAVY:
            cut = r["s"]
            break
    above = counts if cut is None else counts.where(step > cut)
    rows = {bytes(r["word"]): r["c"] for r in above.collect()}
    own = min(SYMBOLS, HEAVY)
    if cut is not None and len(rows) < own:
        rows |= {bytes(r["word"]): r["c"] for r in counts.orderBy(F.desc("c"), "word").limit(own).collect()}
    ranked = sorted(rows.items(), key=lambda x: (-x[1], x[0]))
    return [w for w, _ in ranked], [c for _, c in ranked]


def _train_round(rows: DataFrame, known, flat: np.ndarray, turn: int) -> np.ndarray:
    """The token-weighted mean of the parameters that the tasks reach on the round's documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = lexicon_of(known)
        net = Network(lexicon.frequency)
        net.load(flat)
        adam, seen, held, size = Adam(net), 0, [], 0
        for batch in batches:
            for texts in slices(batch.column(0)):
                for symbols in lexicon.read(texts)[0]:
                    held.append(symbols)
                    size += len(symbols)
                    if size > 1_000_000:
                        seen, held, size = seen + train(net, held, adam), [], 0
        if held:
            seen += train(net, held, adam)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([(net.dump() * np.float64(seen)).tobytes()], pa.binary())], ["n", "p"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0.0
        for batch in batches:
            for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, total = n + k, total + np.frombuffer(p, np.float64)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "p"])

    part = rows.where(~F.col("held") & (F.col("round") == turn)).select("text")
    each = map_arrow(part, run, "n bigint, p binary")
    groups = max(1, math.isqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    sums = map_arrow(each.repartition(groups), add, "n bigint, p binary").collect()
    return sum(np.frombuffer(r["p"], np.float64) for r in sums) / sum(r["n"] for r in sums) if sums else flat


def _score_rows(rows: DataFrame, known, flat: np.ndarray) -> DataFrame:
    """A row for each document: what its frequent words and the network give, and its other words."""
    kind = rows.schema["id"].dataType.simpleString()
    names_out = ["key", "id", "held", "n_tokens", "known", "logs_heavy", "logs_model", "words", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lexicon = lexicon_of(known)
        net = Network(lexicon.frequency)
        net.load(flat)
        key = TaskContext.get().partitionId() << 33
        end_log = lexicon.log_count[lexicon.end] if lexicon.end >= 0 else math.log10(SMOOTH)   # no training document: the end token has no count
        for batch in batches:
            lo = 0
            for texts in slices(batch.column(1)):
                n = len(texts)
                symbols, names, number, at, lengths = lexicon.read(texts)
                doc = np.repeat(np.arange(n), lengths)
                found = number >= 0
                log_count = np.zeros(len(names))
                log_count[found] = lexicon.log_count[number[found]]
                # of a word with a symbol of its own, or the end, the network's probability is all
                symbol = lexicon.symbols_of(names, number)
                open_ = (symbol > 0) & (symbol <= BUCKETS)
                share = np.where(open_, log_count - lexicon.log_bucket[symbol], 0.0)
                # the other words of each text with their counts
                rest = np.flatnonzero(~found[at])
                pair, times = np.unique(doc[rest] * max(len(names), 1) + at[rest], return_counts=True)
                reach = np.searchsorted(pair, np.arange(n + 1) * max(len(names), 1)).astype(np.int32)
                words = names.take(pa.array(pair % max(len(names), 1))).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(key, key + n)), batch.column(0).slice(lo, n), batch.column(2).slice(lo, n), pa.array(lengths + 1),
                     pa.array(np.bincount(doc, found[at], n).astype(np.int64) + (lexicon.end >= 0)),
                     pa.array(np.bincount(doc, log_count[at], n) + end_log),
                     pa.array(np.bincount(doc, share[at], n) + log10_probabilities(net, symbols)),
                     pa.ListArray.from_arrays(reach, words), pa.ListArray.from_arrays(reach, pa.array(times.astype(np.int32)))], names_out)
                key, lo = key + n, lo + n

    return map_arrow(rows.select("id", "text", "held"), run,
                     f"key bigint, id {kind}, held boolean, n_tokens bigint, known bigint, logs_heavy double, logs_model double,"
                     " words array<binary>, times array<int>")
