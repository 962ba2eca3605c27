"""Token shards, language model, archives, the pipeline."""

import gzip
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import MESSY, SF, base_counts, messy, near_components, prose, words

import __spark_entry__ as entry
import corpus_pipeline
from areascope.llm import decontaminate, neardup, quality, recurrent, repair, sharding, warc
from areascope.llm.common import read

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def encode(text):
    return [*repair.encoder(TOKENIZER).tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def expected_tokens(rows):
    out, start = [], 0
    for d, t in rows:
        ids = encode(t)
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_shards_on_table(spark):
    rows = sorted((r.doc_id, r.text) for r in read(spark, SF, "documents").select("doc_id", "text").collect())
    got = [tuple(r) for r in entry.queries()["op1_repair_token_shards"](spark, SF).orderBy("start").collect()]
    assert got == expected_tokens(rows)


def test_token_shards_messy(spark, tmp_path):
    repair.write_table(messy(spark), str(tmp_path / "t"), TOKENIZER, shard_ids=500)
    got = [tuple(r) for r in repair.read_table(spark, str(tmp_path / "t")).orderBy("start").collect()]
    rows = sorted(((d, t) for d, t, _ in MESSY), key=lambda x: (x[0] is not None, x[0] or 0))
    assert sorted((d is not None, d or 0, n, c) for d, _, n, c in got) == sorted((d is not None, d or 0, n, c) for d, _, n, c in expected_tokens(rows))
    assert [x[0] for x in got] == [d for d, _ in rows]
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:])) and got[0][1] == 0
    repair.write_table(messy(spark, []), str(tmp_path / "e"), TOKENIZER)
    assert repair.read_table(spark, str(tmp_path / "e")).count() == 0


def test_word_table_gives_the_ids_of_whole_texts():
    r = random.Random(0)
    chars = ["a", " ", "\n", "'s", "1", "é", "!", " ", "\x1c", "​", "日", "'", "\t", "Zz"]
    texts = ["".join(r.choice(chars) for _ in range(r.randrange(14))) for _ in range(3000)]
    texts += ["<|endoftext|> a", " a b", "a  b", "don't  do", "x 's y 'll", prose(1, 300)]
    for t, ids in zip(texts, repair.Encoder(TOKENIZER).encode(texts)):
        assert [*ids.tolist(), 0] == encode(t), repr(t)


def test_word_table_is_bounded_and_asks_for_a_word_once(monkeypatch):
    encoder = repair.Encoder(TOKENIZER)
    asked, learn = [], encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda w: asked.extend(w.to_pylist()) or learn(w))
    texts = ["start " + prose(("table", i), 60) for i in range(30)]
    for lo in range(0, 30, 5):
        for t, ids in zip(texts[lo:lo + 5], encoder.encode(texts[lo:lo + 5])):
            assert [*ids.tolist(), 0] == encode(t)
    assert sorted(asked) == sorted({w for t in texts for w in t.split(" ")[1:]})
    monkeypatch.setattr(repair, "TABLE", 80)
    small = repair.Encoder(TOKENIZER)
    for i in [*range(30), *range(30)]:   # words leave the table and come back
        assert [*small.encode([texts[i]])[0].tolist(), 0] == encode(texts[i])
        assert len(small.words) == len(small.n) == len(small.met) <= 80 + 60 and len(small.ids) == small.n.sum()


def test_marks_and_line_feeds_are_cut_from_words(monkeypatch):
    encoder = repair.Encoder(TOKENIZER)
    asked, learn = [], encoder._part_ids
    monkeypatch.setattr(encoder, "_part_ids", lambda p: asked.extend(p.to_pylist()) or learn(p))
    texts = ["One river. The river, the river;\nriver 12: don't (river)", "river.\n\nAn\tend", "a <|endoftext|> river.", "Größe,\nñandú. x"]
    for t, ids in zip(texts, encoder.encode(texts)):
        assert [*ids.tolist(), 0] == encode(t)
    assert asked == ["One", " river", ".", " The", " river", ",", " the", " river", ";", "\nriver", " 12", ":", " don", "'t", " (river", ")",
                     "river", ".\n\nAn\tend", "Größe", ",\nñandú.", " x"]
    assert sorted(encoder.words.to_pylist()) == sorted(set(asked))
    r = random.Random(5)
    chars = ["a", "B", "7", " ", " ", "\n", "\r", "\x1c", ".", ",", "'s", "'", "é", "\xa0", "日", "<|endoftext|>", "<|", "_", "\x7f"]
    texts = ["".join(r.choice(chars) for _ in range(r.randrange(14))) for _ in range(5000)]
    for t, ids in zip(texts, encoder.encode(texts)):
        assert [*ids.tolist(), 0] == encode(t), repr(t)


def test_words_of_equal_hashes_are_told_apart(monkeypatch):
    texts = [f"{prose(('hash', i), 20)} {'x' * 70}{i} {'x' * 70}y" for i in range(20)]   # some differ after the hashed bytes only
    for hashes in (repair._hashes, lambda words: np.zeros(len(words), np.uint64)):
        monkeypatch.setattr(repair, "_hashes", hashes)
        for size in (1_000_000, 30):
            monkeypatch.setattr(repair, "TABLE", size)
            encoder = repair.Encoder(TOKENIZER)
            for i in [*range(20), *range(20)]:
                assert [*encoder.encode([texts[i]])[0].tolist(), 0] == encode(texts[i])
            words = encoder.words.to_pylist()
            assert len(set(words)) == len(words) == len(encoder.hashes) == len(encoder.n) and sorted(encoder.at.tolist()) == list(range(len(words)))


def test_repair_round_trip_and_random_access():
    r = np.random.default_rng(3)
    phrase = r.integers(0, 50000, 40)
    docs = []
    for i in range(60):
        parts = [phrase[r.integers(0, 20):r.integers(20, 40)] for _ in range(r.integers(0, 30))] + [r.integers(0, 300, r.integers(0, 50))]
        docs.append(np.append(np.concatenate(parts), 0).astype(np.uint32))
    docs += [np.zeros(1, np.uint32), np.array([5] * 4000 + [0], np.uint32), np.array([0, 0, 7, 0, 0], np.uint32)]
    data = repair.write_shard(docs)
    shard = repair.Shard(data)
    assert len(data) < 0.8 * 4 * sum(map(len, docs)) and len(shard.rules) > 10
    assert all(np.array_equal(a, b) for a, b in zip(docs, shard.documents())) and shard.n_documents == len(docs)
    assert np.array_equal(shard.starts(), np.cumsum([0] + [len(d) for d in docs[:-1]]))
    for k, d in enumerate(docs):
        assert np.array_equal(shard.document(k), d)
        lo = int(r.integers(0, len(d) + 1))
        hi = int(r.integers(lo, len(d) + 1))
        assert np.array_equal(shard.decode_range(k, lo, hi), d[lo:hi])


def test_range_expands_only_what_it_overlaps(monkeypatch):
    r = np.random.default_rng(8)
    document = np.append(np.tile(r.integers(1, 50000, 3000), 40), 0).astype(np.uint32)
    shard = repair.Shard(repair.write_shard([document]))
    assert len(shard.rules) > 1000
    monkeypatch.setattr(repair, "expansions", None)     # no table of all rules
    for start, stop in ((0, 2), (60_000, 60_003), (119_999, 120_001), (7, 7), (9, 5), (0, len(document)), (120_000, 130_000)):
        assert np.array_equal(shard.decode_range(0, start, stop), document[start:stop])


def test_ids_of_a_larger_vocabulary_are_refused():
    with pytest.raises(ValueError):
        repair.write_shard([np.array([70_000, 70_001, 0], np.uint32)])


def most_frequent_pair(symbols):
    """Places of the most frequent pair that do not overlap."""
    count, last = Counter(), {}
    for i, pair in enumerate(zip(symbols.tolist(), symbols[1:].tolist())):
        if 0 not in pair and last.get(pair, -2) < i - 1:
            count[pair], last[pair] = count[pair] + 1, i
    return max(count.values(), default=0)


def test_repair_ends_when_no_pair_is_frequent(monkeypatch):
    r = np.random.default_rng(4)
    document = np.append(r.integers(1, 50000, 1000), 0)
    cases = [np.tile(document, 300), np.full(50_000, 7), np.append(np.full(9000, 7), [8, *[7] * 9001, 0]), r.integers(1, 4, 30_000),
             np.minimum(r.zipf(1.3, 60_000), 50000)]
    for bits in (repair.SLOT_BITS, 4):   # pairs that lose their places too
        monkeypatch.setattr(repair, "SLOT_BITS", bits)
        for ids in cases:
            symbols, rules = repair.compress(ids.astype(np.uint32))
            assert most_frequent_pair(symbols) < repair.MIN_COUNT
            assert np.array_equal(repair.expand(symbols, repair.expansions(rules)), ids)
    monkeypatch.undo()
    assert len(repair.compress(cases[0].astype(np.uint32))[0]) <= 2 * 300


def check_base(rows, got):
    counts, texts, held = Counter(), {}, {}
    for k, (d, t) in enumerate(rows):
        held[k] = zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
        texts[k] = [w.encode() for w in words(t, True)] + [b"\n"]
        if not held[k]:
            counts.update(texts[k])
    n, v = sum(counts.values()), len(counts)
    expected = []
    for k, (d, _) in enumerate(rows):
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in texts[k])
        expected.append((d is None, d or 0, held[k], len(texts[k]), sum(counts[w] > 0 for w in texts[k]), n, round(base, 4)))
    assert sorted(expected) == sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got)


def test_language_model_on_table(spark, monkeypatch):
    monkeypatch.setattr(recurrent, "HEAVY", 3000)   # most words take the join
    rows = [(r.doc_id, r.text) for r in read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    got = entry.queries()["op4_gated_recurrent_lm"](spark, "/root/testdata/sf0.01").collect()
    check_base(rows, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)   # better than the unigram model on held-out text


def test_language_model_messy(spark):
    got = recurrent.score(messy(spark)).collect()
    check_base([(d, t) for d, t, _ in MESSY], got)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert recurrent.score(messy(spark, [])).count() == 0
    none = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id bigint, text string")
    assert all(r.train_tokens == 0 and math.isfinite(r.score) for r in recurrent.score(none).collect())


def test_end_token_is_known_besides_the_limit(spark, monkeypatch):
    monkeypatch.setattr(recurrent, "HEAVY", 3)   # words more frequent than the documents are many
    starts = []
    network = recurrent.Network
    monkeypatch.setattr(recurrent, "Network", lambda frequency: starts.append(frequency[recurrent.END_SYMBOL]) or network(frequency))
    rows = [(i, prose(("book", i), 400)) for i in range(12)]
    got = recurrent.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    check_base(rows, got)
    assert starts == [sum(not r.held_out for r in got)]


def test_distinct_words_are_looked_up_once(monkeypatch):
    import pyarrow as pa

    texts = ["The cat  the\tCAT\u00e9 ", "", " ", "x\x1cy z\x0bz", "\u00c9t\u00c9 the dog ran " * 40, "a" * 70]
    every = [words(t, True) for t in texts]
    counts = Counter(w.encode() for ws in every for w in ws)
    own = [b"the", b"\n", b"cat", b"z"]
    totals = {}
    for w, n in counts.items():
        a, b = totals.get(recurrent.bucket(w), (0, 0))
        totals[recurrent.bucket(w)] = (a + n, b + 1)
    lexicon = recurrent.Lexicon(own, [counts[w] or len(texts) for w in own], totals)
    asked, number = [], lexicon.number
    monkeypatch.setattr(lexicon, "number", lambda w: asked.extend(w.to_pylist()) or number(w))
    for kind in (pa.string(), pa.large_string()):
        asked.clear()
        symbols, names, numbers, at, lengths = lexicon.read(pa.array(["skipped", *texts], kind)[1:])
        assert sorted(asked) == sorted(counts)     # 240 places, each distinct word once
        assert [names[i].as_py() for i in at.tolist()] == [w.encode() for ws in every for w in ws] and lengths.tolist() == [len(ws) for ws in every]
        symbol = {w: 1 + recurrent.BUCKETS + i for i, w in enumerate(w for w in own if w != b"\n")}
        assert [s.tolist() for s in symbols] == [[symbol.get(w.encode(), recurrent.bucket(w.encode())) for w in ws] + [recurrent.END_SYMBOL] for ws in every]
    monkeypatch.setattr(recurrent, "READ_BYTES", 10)
    column = pa.array(["skipped", *texts])[1:]
    assert pa.concat_arrays(list(recurrent.slices(column))).equals(column)


def network():
    net = recurrent.Network(np.random.default_rng(0).integers(1, 100, recurrent.SYMBOLS).astype(float))
    rng = np.random.default_rng(1)
    net.p = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float64) for k, v in net.p.items()}
    return net, rng


def test_network_is_a_distribution_and_gradients_are_right():
    net, rng = network()
    state = rng.normal(size=(1, recurrent.STATE))
    logs, _ = net.log_probability(np.repeat(state, recurrent.SYMBOLS, axis=0), np.arange(recurrent.SYMBOLS))
    assert abs(np.exp(logs).sum() - 1) < 1e-6
    x, y = rng.integers(0, 256, (2, 5, 3))
    live = np.arange(5)[:, None] < np.array([5, 4, 2])[None, :]
    h = rng.normal(size=(3, recurrent.STATE)) * 0.1

    def loss():
        states = net.steps(x, h).reshape(-1, recurrent.STATE)[live.ravel()]
        return -net.log_probability(states.astype(np.float64), y.ravel()[live.ravel()])[0].mean()

    _, grad = net.train_window(x, y, live, h)
    for name in net.NAMES:
        g = grad[name]
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 2e-2 * abs(g[at]) + 1e-4, name


def test_state_is_carried_across_windows(monkeypatch):
    net, rng = network()
    docs = [rng.integers(0, 256, n).astype(np.uint8) for n in (1, 70, 200, 64, 65)]
    long = recurrent.log10_probabilities(net, docs)
    monkeypatch.setattr(recurrent, "SCORE_WINDOW", 7)
    monkeypatch.setattr(recurrent, "SCORE_BATCH", 2)
    assert np.allclose(long, recurrent.log10_probabilities(net, docs), rtol=1e-5)


def pages(spark):
    long = "p" * 1200
    rows = [(1, "u1", long), (5, "u5", long), (3, "u3", long), (7, "u7", "short"), (8, "u8", "short"), (9, None, None),
            (10, "u10", "q" * 999), (11, "u11", "q" * 999), (12, "u12", "é" * 500), (13, "u13", "é" * 500), (14, "bad\r\nurl", "a\r\n\r\nWARC/1.1\r\nb" * 90),
            (20, "v", "r" * 2000), (20, "v", "r" * 2000), (None, "n", "s" * 1500), (None, "n", "s" * 1500)]
    return rows, spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, digest string, payload string")


def test_warc(spark, tmp_path):
    rows, df = pages(spark)
    path = str(tmp_path / "w")
    warc.write_archives(warc.classify(df), path, file_records=2)
    got = warc.resolve(warc.read_archives(spark, path)).collect()
    assert len(got) == len(rows)
    payloads = sorted((r[0] is None, r[0] or 0, hashlib.sha1((r[2] or "").encode()).hexdigest()) for r in rows)
    assert payloads == sorted((r.page_id is None, r.page_id or 0, hashlib.sha1(bytes(r.payload)).hexdigest()) for r in got)
    assert all(hashlib.sha1(bytes(r.payload)).hexdigest() == r.digest and len(r.payload) == r.payload_bytes for r in got)
    kinds = sorted((r.page_id or 0, r.type, r.refers_to) for r in got if r.type == "revisit")
    assert kinds == [(0, "revisit", None), (1, "revisit", 5), (3, "revisit", 5), (12, "revisit", 13), (20, "revisit", 20)]
    raw = b"".join(gzip.open(f).read() for f in map(str, (tmp_path / "w").glob("part-*.gz")))
    assert raw.count(b"p" * 1200) == 1 and raw.startswith(b"WARC/1.1\r\n")
    ids = [r.record_id for r in got]
    assert len(set(ids)) == len(ids) and {r.refers_to_record for r in got} - {None} <= set(ids)
    warc.write_archives(warc.classify(df.limit(0)), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_warc_rows_in_an_order_that_changes(spark, tmp_path):
    """Equal pages behind a shuffle, whose rows come in another order for each reader: still one response for each payload."""
    rows = [(i % 7, f"u{i % 3}", ("r%d" % (i % 5)) * 800) for i in range(420)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(7)
    warc.write_archives(warc.classify(df), str(tmp_path / "o"))
    got = warc.resolve(warc.read_archives(spark, str(tmp_path / "o"))).collect()
    assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in got) == sorted(rows)
    top = {p: max(r[:2] for r in rows if r[2] == p) for p in {r[2] for r in rows}}
    first = [r for r in got if r.type == "response"]
    assert {bytes(r.payload).decode(): (r.page_id, r.url) for r in first} == top and len(first) == 5
    assert all(r.refers_to == top[bytes(r.payload).decode()][0] for r in got if r.type == "revisit")


def test_warc_payload_ends(tmp_path, spark):
    """Payloads that begin and end with line ends or hold separators, one file for all of them."""
    ends = ["", "\r\n", "\r\n\r\n", "\n", "\r", "\r\n\r"]
    rows = [(i, f"u{i}", a + body + b) for i, (a, body, b) in
            enumerate((a, body, b) for a in ends for body in ("", "x", "WARC/1.1\r\n\r\nx" * 200) for b in ends)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    warc.write_archives(warc.classify(df, min_bytes=10**9), str(tmp_path / "p"))
    got = warc.read_archives(spark, str(tmp_path / "p")).collect()
    assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in got) == rows
    assert len(list((tmp_path / "p").glob("part-*.gz"))) == 1


def test_warc_broken_archives():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Target-URI: u\r\nX-Payload-Length: 3\r\nContent-Length: 3\r\n"
    digest = b"WARC-Payload-Digest: sha1:" + hashlib.sha1(b"abc").hexdigest().encode()
    assert next(warc.parse([head + digest, b"abc"]))[-1] == b"abc"
    for pieces in ([head + digest, b"abd"], [head + digest, b"abcd"], [head + digest], [b"HTTP/1.1", b"abc"]):
        with pytest.raises(ValueError):
            list(warc.parse(pieces))


def test_pipeline_stage_by_stage(spark):
    docs = read(spark, SF, "documents")
    rows = [tuple(r) for r in docs.collect()]
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "MinHash near-dedup", "benchmark decontamination", "mixing to target weights", "sharding"]
    # quality: what it keeps passes the base rules, what it drops fails them or the threshold
    model = quality.train(docs, read(spark, SF, "labels"))
    verdict = {r.doc_id: r.quality_rules.kept for r in quality.score(docs, model).collect()}
    kept = stages["quality rules"](spark, docs, SF)
    assert kept.columns == columns
    first = sorted(tuple(r) for r in kept.collect())
    assert first == sorted(r for r in rows if verdict[r[0]])
    assert all(base_counts(r[1])[0] >= 20 for r in first)
    # near-duplicates: the smallest id of each group
    comp, _ = near_components([(r[0], r[1]) for r in first])
    kept = stages["MinHash near-dedup"](spark, kept, SF)
    second = sorted(tuple(r) for r in kept.collect())
    assert kept.columns == columns and second == [r for r, c in zip(first, comp) if r[0] == c]
    # decontamination
    items = [decontaminate.normal_form(r.text.encode()) for r in read(spark, SF, "benchmark").collect()]
    patterns = [decontaminate.Pattern(0, t) for t in items]
    def dirty(t):
        t = decontaminate.normal_form(t.encode())
        return any(p.text in t or decontaminate.nearest(p.forward, p.size, t)[0] <= p.budget for p in patterns)
    kept = stages["benchmark decontamination"](spark, kept, SF)
    third = sorted(tuple(r) for r in kept.collect())
    assert kept.columns == columns and third == [r for r in second if not dirty(r[1])]
    # mixing
    kept = stages["mixing to target weights"](spark, kept, SF)
    fourth = [tuple(r) for r in kept.collect()]
    total = sum(len(words(r[1])) for r in third)
    assert kept.columns == columns and abs(sum(len(words(r[1])) for r in fourth) - 1.5 * total) <= len({r[3] for r in third})
    by_id = {r[0]: r for r in third}
    assert all(by_id[r[0]][1].startswith(r[1]) and by_id[r[0]][2:] == r[2:] for r in fourth)
    assert max(Counter(r[0] for r in fourth).values()) <= 2
    # shards
    last = stages["sharding"](spark, kept, SF)
    out = last.collect()
    sizes = Counter(r.shard for r in out)
    assert last.columns == [*columns, "shard", "slot"] and len(out) == len(fourth) and max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted((r.shard, r.slot) for r in out) == [(s, i) for s in sorted(sizes) for i in range(sizes[s])]
    assert Counter(tuple(r)[:len(columns)] for r in out) == Counter(fourth)


def test_pipeline_is_registered():
    assert entry.queries()["pipeline"] and corpus_pipeline.ORACLE_SQL is None
    assert sorted(int(q[2:].split("_")[0]) for q in entry.queries() if q.startswith("op")) == list(range(1, 11))
    assert neardup and sharding
