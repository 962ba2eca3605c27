"""Quality, near-duplicates, decontamination and substrings."""

import hashlib
import random

import numpy as np
import pytest
from helpers import MESSY, SF, base_counts, distance, messy, near_components, prose, repeated_words, shingles, words
from pyspark.sql import functions as F

import __spark_entry__ as entry
from areascope.llm import decontaminate, neardup, quality, substrings
from areascope.llm.common import read
from areascope.llm.textops import Chunk


def documents(spark):
    return [(r.doc_id, r.text) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]


def test_quality_counts(spark):
    rows = {r.doc_id: r for r in entry.queries()["op3_ngram_quality"](spark, SF).collect()}
    texts = dict(documents(spark))
    assert set(rows) == set(texts)
    for i, t in texts.items():
        r, expected = rows[i], base_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (r.base_failed and r.kept)


def test_quality_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    model = quality.train(docs, labels.where("doc_id % 3 > 0"))
    judged = quality.score(docs.join(labels.where("doc_id % 3 = 0"), "doc_id"), model).where("not quality_rules.base_failed") \
        .select("quality", "quality_rules.kept", "quality_rules.probability").collect()
    good = [r for r in judged if r.quality == 1]
    bad = [r for r in judged if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good) and sum(r.kept for r in bad) <= 0.3 * len(bad)
    assert abs(np.mean([r.probability for r in judged]) - np.mean([r.quality for r in judged])) < 0.06


def test_quality_messy(spark):
    labels = spark.createDataFrame([(1, 1), (7, 0), (99, 1), (None, 0), (2, None)], "doc_id bigint, quality int")
    model = quality.train(messy(spark), labels)
    out = quality.score(messy(spark), model).collect()
    assert len(out) == len(MESSY)
    for r in out:
        q = r.quality_rules
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == base_counts(r.text)
    assert quality.train(messy(spark), labels.where("quality = 1")) is None
    assert quality.score(messy(spark, []), None).count() == 0
    assert quality.kept_documents(messy(spark), None).columns == messy(spark).columns


def test_scores_do_not_depend_on_the_batch():
    texts = [prose(i, 5 + 40 * (i % 3)).encode() for i in range(12)] + [b"", b"a", b"ab", "日本語".encode()]
    model = quality.Model(np.random.default_rng(0).normal(size=1 << quality.BITS).astype(np.float32), 0.1, 1.0, 0.0)
    together = model.raw(Chunk(texts))
    alone = np.array([model.raw(Chunk([t]))[0] for t in texts])
    assert np.allclose(together, alone)


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_near_duplicates_on_tables(spark, folder):
    rows = [(r.doc_id, r.text) for r in read(spark, folder, "documents").select("doc_id", "text").collect()]
    expected, sizes = near_components(rows)
    got = {r.doc_id: r for r in entry.queries()["op5_tensored_minhash"](spark, folder).collect()}
    for (d, _), c, n in zip(rows, expected, sizes):
        assert got[d].component_id == c and got[d].n_shingles == n and got[d].kept == (c == d)


def test_near_duplicates_planted(spark):
    """Chains and groups around the threshold, and many texts that share a passage but do not link."""
    r = random.Random(11)
    rows, passage = [], prose("passage", 40)
    for g in range(12):
        base = prose(("g", g), r.randrange(30, 160)).split()
        for _ in range(r.randrange(1, 9)):
            copy = list(base)
            for _ in range(r.randrange(0, max(2, len(base) // 14))):
                copy[r.randrange(len(copy))] = f"new{r.random()}"
            rows.append(" ".join(copy).upper() if r.random() < 0.2 else " ".join(copy))
    rows += [prose(("p", i), 45) + " " + passage for i in range(120)]
    rows += ["a b", "A b", "a b c", ""]
    r.shuffle(rows)
    rows = [(i * 3, t) for i, t in enumerate(rows)]
    expected, _ = near_components(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.id: x.component_id for x in neardup.near_duplicates(df).collect()}
    assert [got[d] for d, _ in rows] == expected


def test_near_duplicates_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    base = prose("b", 60).split()
    rows = [(i, " ".join(base[:i] + [f"z{i}"] + base[i + 1:])) for i in range(20)]
    expected, _ = near_components(rows)
    got = {x.id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[d] for d, _ in rows] == expected


def test_largest_component_of_a_bucket_is_not_copied_to_its_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 10)
    comps = ["a"] * 200 + ["b"] * 3 + ["c"] * 14
    rows = [(1, f"{i}".encode(), k, len(comps)) for i, k in enumerate(comps)] + [(2, b"x", "a", 2), (2, b"y", "b", 2)]
    out = neardup._with_blocks(spark.createDataFrame(rows, "h bigint, digest binary, comp string, c bigint")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).collect()
    meet = {}
    for r in out:
        meet.setdefault((r.h, *sorted((r.own, r.other))), []).append((r.digest, r.comp, r.own))
    for x, y in ((x, y) for i, x in enumerate(rows) for y in rows[:i]):
        if x[0] == y[0] and x[2] != y[2]:   # each pair of different components meets once
            groups = [g for (h, p, q), g in meet.items() if h == x[0] and {x[1], y[1]} <= {d for d, _, _ in g}
                      and (p == q or len({o for d, _, o in g if d in (x[1], y[1])}) == 2)]
            assert len(groups) == 1
    assert sum(r.comp == "a" and r.h == 1 for r in out) == 2 * 200   # two blocks of other rows; all blocks were 22


def test_near_duplicates_messy(spark):
    rows = [(d, t) for d, t, _ in MESSY]
    expected, sizes = near_components(rows)
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(messy(spark)).collect()), key=repr)
    assert got == sorted(((d, n, c) for (d, _), n, c in zip(rows, sizes, expected)), key=repr)
    kept = neardup.deduplicate(messy(spark))
    assert kept.columns == messy(spark).columns
    ids = sorted((r.doc_id, bool(words(r.text))) for r in kept.collect() if r.doc_id is not None)
    assert ids == [(1, True), (3, False), (4, False), (5, False), (6, True), (7, True), (9, True), (10, True), (11, True)]
    assert neardup.near_duplicates(messy(spark, [])).count() == 0 and neardup.deduplicate(messy(spark, [])).count() == 0


def test_one_row_of_each_near_duplicate_group_stays(spark):
    """Near copies (no equal texts) whose ids are null, or one repeated id, or some of both."""
    def copies(name, ids):
        base = prose(name, 80).split()
        return [(d, " ".join([*base[:4 * i], f"{name}{i}", *base[4 * i + 1:]]), name) for i, d in enumerate(ids)]

    rows = copies("none", [None] * 5) + copies("one", [7] * 5) + copies("some", [None, 9, 9, 12, None]) + copies("exact", [3, 3])[:1] * 3
    rows += [(None, None, "empty"), (None, "", "empty")]
    assert len(set(near_components([(i, t) for i, (_, t, _) in enumerate(rows) if t])[0])) == 4
    kept = sorted((r.source, r.doc_id is None, r.doc_id or 0) for r in neardup.deduplicate(messy(spark, rows)).collect())
    assert kept == [("empty", True, 0), ("empty", True, 0), ("exact", False, 3), ("none", True, 0), ("one", False, 7), ("some", False, 9)]
    verdict = neardup.near_duplicates(messy(spark, [r for r in rows if r[2] != "exact"])).where("n_shingles > 0")
    assert sorted((r.component_id is None, r.component_id or 0) for r in verdict.where("first").collect()) == [(False, 7), (False, 9), (True, 0)]
    # by the contract kept is true on every row that has the component's id, repeated or not
    assert all(r.kept == (r.id == r.component_id) for r in verdict.collect())


def test_sketch_gate_never_rejects_a_link():
    r = random.Random(2)
    for n in (3, 10, 40, 150, 600, 3000):
        for _ in range(20):
            base = [str(r.random()) for _ in range(n + 4)]
            other = list(base)
            for _ in range(max(1, n // 40)):
                other[r.randrange(len(other))] = "x"
            a, b = shingles(" ".join(base)), shingles(" ".join(other))
            if 100 * len(a & b) >= 75 * len(a | b):
                sets, ends = neardup.shingle_sets([" ".join(base).encode(), " ".join(other).encode()])
                s = neardup.sketches(sets, ends)
                assert neardup._alike(s[:1], s[1:], np.array([len(a)]), np.array([len(b)]))[1][0]


def test_myers_distance():
    r = random.Random(1)
    for _ in range(200):
        p = "".join(r.choice("abc d") for _ in range(r.randint(1, 70)))
        t = "".join(r.choice("abc d") for _ in range(r.randint(0, 90)))
        assert decontaminate.nearest(decontaminate.Pattern(1, p).forward, len(p), t)[0] == distance(p, t)


def test_decontamination_against_all_distances(spark, monkeypatch):
    r = random.Random(5)
    chars = "abcdefghij klmnop"
    items = [(i, "".join(r.choice(chars) for _ in range(r.randint(1, 150)))) for i in range(20)] + [(50, None), (None, "abc"), (51, "")]
    rows = []
    for i in range(80):
        t = "".join(r.choice(chars) for _ in range(150))
        s = list(items[r.randrange(20)][1])
        for _ in range(r.randrange(9)):
            at = r.randrange(len(s)) if s else 0
            s[at:at + r.randrange(2)] = r.choice([[], [r.choice(chars)]])
        rows.append((i, t[:70] + "".join(s) + t[70:], "s"))
    docs, bench = messy(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    normal = {i: decontaminate.normal_form((t or "").encode()) for i, t in items}
    for limit in (4_000_000, 200):   # one block of items, several blocks
        monkeypatch.setattr(decontaminate, "MAX_CHARS", limit)
        monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (limit,))
        got = {x.doc_id: {h.item_id: h.distance for h in x.benchmark_hits} for x in decontaminate.scan(docs, bench).collect()}
        for i, t, _ in rows:
            t = decontaminate.normal_form(t.encode())
            all_ = {k: distance(p, t) for k, p in normal.items() if p}
            assert got[i] == {k: d for k, d in all_.items() if d <= len(normal[k]) // decontaminate.CHARS_PER_ERROR}


def test_decontamination_of_tables_and_messy(spark):
    bench = read(spark, SF, "benchmark")
    normal = {r.item_id: decontaminate.normal_form(r.text.encode()) for r in bench.collect()}
    got = {r.doc_id: r for r in entry.queries()["op6_pigeonhole_edit_match"](spark, SF).collect()}
    for i, t in documents(spark):
        t = decontaminate.normal_form((t or "").encode())
        exact = [k for k, p in normal.items() if p in t]
        assert set(exact) <= set(got[i].item_ids) and got[i].contaminated == bool(got[i].item_ids)
    out = decontaminate.scan(messy(spark), spark.createDataFrame([(1, "one"), (1, "one")], "item_id bigint, text string"))
    assert {r.doc_id for r in out.collect() if r.benchmark_hits} == {6}
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.clean_documents(messy(spark), none).count() == len(MESSY)
    assert decontaminate.clean_documents(messy(spark, []), bench).count() == 0


def test_decontamination_with_any_item_id(spark):
    docs = messy(spark, [(1, "the quick brown fox jumps", "s"), (2, "nothing of it", "s"), (3, "a lazy dog sleeps", "s")])
    for kind, ids in (("bigint", [None, 4]), ("string", [None, "mmlu/4"]), ("void", [None, None])):
        bench = spark.createDataFrame([(ids[0], "quick brown"), (ids[1], "lazy dog"), (ids[0], None)], f"item_id {kind}, text string")
        assert [r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()] == [2]
    named = spark.createDataFrame([("mmlu/4", "lazy dog")], "item_id string, text string")
    assert {r.doc_id: [h.item_id for h in r.benchmark_hits] for r in decontaminate.scan(docs, named).collect()} == {1: [], 2: [], 3: ["mmlu/4"]}
    # items without an id are reported too, after the others
    named = spark.createDataFrame([("a", "lazy"), (None, "lazy dog"), (None, "dog"), (None, "dog")], "item_id string, text string")
    assert {r.doc_id: [h.item_id for h in r.benchmark_hits] for r in decontaminate.scan(docs, named).collect()} == {1: [], 2: [], 3: ["a", None, None]}


def removal(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.removal.n_words, r.removal.n_removed, r.removal.kept_sha256)
                  for r in substrings.remove(df).collect())


def expected_removal(rows):
    return sorted((r[0] is None, r[0] or 0, n, n - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest())
                  for r, (n, k) in zip(rows, repeated_words([r[1] for r in rows])))


def test_substrings_on_table(spark):
    assert removal(read(spark, SF, "documents")) == expected_removal(documents(spark))


@pytest.mark.parametrize("most", [20000, 5])
def test_substrings_planted(spark, monkeypatch, most):
    """Cuts and copies of one passage, periodic texts, single changes; an oversize anchor takes the other path."""
    monkeypatch.setattr(substrings, "MAX_STRINGS", most)
    r = random.Random(3)
    v = [f"w{i}" for i in range(12)]
    base = [r.choice(v) for _ in range(400)]
    rows = []
    for i in range(90):
        k = r.random()
        if k < 0.3:
            w = base[r.randint(0, 200):r.randint(200, 400)]
        elif k < 0.6:
            w = [r.choice(v) for _ in range(60)] + base[100:100 + r.randint(30, 80)] + [r.choice(v) for _ in range(60)]
        elif k < 0.8:
            w = [v[j % 2] for j in range(r.randint(30, 90))]
        else:
            w = [*base[:200]]
            w[r.randint(0, 199)] = "x"
        rows.append((i, "  ".join(w), "s"))
    assert removal(messy(spark, rows)) == expected_removal(rows)


def test_substrings_of_an_oversize_anchor_meet_in_no_task(spark, monkeypatch):
    """A passage in many contexts: its windows do not go to the automata, whose anchors have ``MAX_STRINGS`` strings at most."""
    monkeypatch.setattr(substrings, "MAX_STRINGS", 5)
    most, spans = [], substrings._spans

    def counted(strings, window):
        most.extend(r["count"] for r in strings.groupBy("anchor").count().collect())
        return spans(strings, window)

    monkeypatch.setattr(substrings, "_spans", counted)
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"{prose(('l', i), 40)} {passage} {prose(('r', i), 40)}", "s") for i in range(60)]
    rows += [rows[0], rows[0], (100, prose("alone", 200), "s"), (101, "a b " * 40, "s")]
    assert removal(messy(spark, rows)) == expected_removal(rows)
    assert max(most, default=0) <= 5


def test_substrings_messy(spark):
    assert removal(messy(spark)) == expected_removal(MESSY)
    assert substrings.remove(messy(spark, [])).count() == 0


def test_trimming_keeps_repeated_windows():
    r = random.Random(9)
    middle = [r.randrange(2**60) for _ in range(50)]
    group = []
    for i in range(60):
        left, right = ([r.randrange(2**60) for _ in range(5)] for _ in range(2))
        group.append((1, 25, np.array(left + middle + right, np.uint64)))
    spans = substrings.repeated_spans([group])[0]
    assert spans == [[(5, 55)]] * 60
