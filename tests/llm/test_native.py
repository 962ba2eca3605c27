"""Sharding, mixing and the license scan."""

import hashlib
import random
import re
import textwrap

import pytest
from helpers import ASCII, MESSY, SF, crc, duck_rows, messy, spark_rows, words
from pyspark.sql import functions as F

import __spark_entry__ as entry
from areascope.llm import licenses, mixing, sharding
from areascope.verify import duckdb_connection


@pytest.mark.parametrize("name", sorted(entry.LLM_ORACLE))
def test_oracle(spark, name):
    assert spark_rows(entry.queries()[name](spark, SF)) == duck_rows(duckdb_connection(SF), entry.oracle_sql()[name])


def test_shards_messy(spark):
    got = sharding.shard(messy(spark), shards=4).select("row.doc_id", "row.text", "size", "text_crc32", "shard", "slot").collect()
    assert len(got) == len(MESSY)
    counts = {}
    for r in got:
        assert r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == crc(r.text)
        counts.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    out = sharding.sharded_documents(messy(spark))
    assert out.columns.count("shard") == 1 and out.count() == len(MESSY)
    assert sharding.shard(messy(spark, [])).count() == 0


def test_ring_is_bounded_and_moves_little(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    place = {n: {r.doc_id: r.shard for r in sharding.shard(docs, shards=n).select("row.doc_id", "shard").collect()} for n in (8, 9)}
    for n, p in place.items():
        sizes = [list(p.values()).count(s) for s in range(n)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 6000
    moved = sum(place[8][d] != place[9][d] for d in place[8])
    assert moved < 6000 * 0.35   # a new hash of all keys would move eight ninths
    loose = sharding.shard(docs, shards=8, load_factor=1.1).groupBy("shard").count().collect()
    assert max(r["count"] for r in loose) <= -(-6000 * 11 // 80)


def test_ring_keeps_keys_at_home_that_have_room(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.shard(docs, shards=8).groupBy("home", "shard").count().collect()
    home = {}
    for r in got:
        home[r.home] = home.get(r.home, 0) + r["count"]
    for s, n in home.items():
        stays = sum(r["count"] for r in got if r.home == s and r.shard == s)
        assert stays == min(n, 250)


def test_ring_key_by_key(spark):
    """Every key of the table walks the ring by itself: first all keys to their homes, then those refused one shard on, and so on."""
    from bisect import bisect_left

    shards = sharding.SHARDS
    # two nodes may share a position: both are met, the smaller shard first
    nodes = sorted((int(hashlib.md5(f"ring|{s}#{v}".encode()).hexdigest()[:4], 16), s) for s in range(shards) for v in range(sharding.VNODES))
    docs = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    left = []
    for d in docs:
        key = hashlib.md5(f"ring|{d}".encode()).hexdigest()
        first = bisect_left(nodes, (int(key[:4], 16), -1)) % len(nodes)
        left.append(((first, key), d, list(dict.fromkeys(s for _, s in nodes[first:] + nodes[:first]))))
    # ring order; the arc of the first node begins behind the last one
    left.sort()
    room = [len(docs) // shards + (s < len(docs) % shards) for s in range(shards)]
    slot, expected = [0] * shards, {}
    for k in range(shards):
        still = []
        for order, d, walk in left:
            s = walk[k]
            if slot[s] < room[s]:
                expected[d] = (s, slot[s], walk[0])
                slot[s] += 1
            else:
                still.append((order, d, walk))
        left = still
    got = {r.doc_id: (r.shard, r.slot, r.home_shard) for r in entry.queries()["op2_bounded_load_ring"](spark, SF).collect()}
    assert not left and got == expected


def test_write_shards(spark, tmp_path):
    sharding.write_shards(messy(spark, extra=False), str(tmp_path / "s"), shards=3)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(MESSY)


def water_filling(sizes, weights, total):
    """Share by weight, cap at twice the size, share the excess again."""
    got = {s: 0.0 for s in sizes}
    open_ = set(sizes)
    while open_ and total - sum(got.values()) > 1e-9:
        rest, w = total - sum(got.values()), sum(weights[s] for s in open_)
        for s in list(open_):
            got[s] += rest * weights[s] / w
        for s in list(open_):
            if got[s] >= 2 * sizes[s] - 1e-12:
                got[s] = 2.0 * sizes[s]
                open_.discard(s)
    return got


def test_mix_messy(spark):
    got = mixing.mix(messy(spark), block_words=64).select("row.doc_id", "row.text", "row.source", "size", "source_size", "target",
                                                           "taken", "spans").collect()
    assert len(got) == len(MESSY)
    sizes = {}
    for _, t, s in MESSY:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    names = sorted(x for x in sizes if x is not None) + [None]
    goal = water_filling(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    taken = {}
    for r in got:
        assert r.size == len(words(r.text)) and r.source_size == sizes[r.source]
        assert abs(r.target - goal[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in sizes)
    # blocks are disjoint, of the stated size, and each has one shard
    shard_of, filled = {}, {}
    for r in got:
        for x in r.spans:
            assert shard_of.setdefault((r.source, x.block), x.shard) == x.shard and 0 <= x.shard < mixing.SHARDS
            filled[r.source, x.block] = filled.get((r.source, x.block), 0) + x.to_word - x.from_word
    assert all(n <= 64 for n in filled.values())
    per_shard = [list(shard_of.values()).count(s) for s in range(mixing.SHARDS)]
    assert max(per_shard) - min(per_shard) <= 1
    assert mixing.mix(messy(spark, [])).count() == 0


def test_mixed_documents_cut_at_words(spark):
    rows = [(i, f" w{i} " + " ".join(f"t{j}" for j in range(9)) + "\n", "ab"[i % 2]) for i in range(40)]
    out = mixing.mixed_documents(messy(spark, rows), block_words=7)
    plan = mixing.mix(messy(spark, rows), block_words=7).select("row.doc_id", "taken").collect()
    assert out.columns == messy(spark, rows).columns
    n = {}
    texts = {i: t for i, t, _ in rows}
    for r in out.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + len(words(r.text))
        assert texts[r.doc_id].startswith(r.text)
    assert n == {r.doc_id: r.taken for r in plan if r.taken}


def test_splitting_tree_is_hypergeometric(spark):
    sources = spark.createDataFrame([(0, 300), (1, 100), (2, 0), (3, 1)], "rank int, blocks bigint")
    shares = []
    for salt in range(12):
        leaf = {r["rank"]: [b - a for a, b in zip([0, *r.bounds], r.bounds)] for r in mixing.splitting_tree(sources, 5, str(salt)).collect()}
        assert {k: sum(v) for k, v in leaf.items()} == {0: 300, 1: 100, 2: 0, 3: 1}
        totals = [sum(v[i] for v in leaf.values()) for i in range(5)]
        assert max(totals) - min(totals) <= 1 and min(min(v) for v in leaf.values()) >= 0
        shares += leaf[1]
    # 60 draws of about 80 out of 401 with 100 marked: mean 20, standard deviation 3.5
    mean = sum(shares) / len(shares)
    deviation = (sum((x - mean) ** 2 for x in shares) / len(shares)) ** 0.5
    assert abs(mean - 20) < 0.1 and 2.2 < deviation < 4.8


def test_mix_follows_its_tree(spark, monkeypatch):
    query = entry.queries()["op8_hypergeometric_mix"]
    digest = {r.doc_id: (r.taken, r.shard_words) for r in query(spark, SF).collect()}
    assert all(sum(map(int, w.split(","))) == n for n, w in digest.values())
    assert sum(w != "0,0,0,0,0,0,0," + str(n) for n, w in digest.values()) > 100
    real = mixing.splitting_tree
    # all blocks on the last shard: the same words, elsewhere
    monkeypatch.setattr(mixing, "splitting_tree", lambda sources, *a: real(sources, *a).select(
        "rank", F.expr("transform(bounds, (z, i) -> if(i < 7, 0L, z))").alias("bounds")))
    assert {r.doc_id: (r.taken, r.shard_words) for r in query(spark, SF).collect()} == {
        d: (n, "0,0,0,0,0,0,0," + str(n)) for d, (n, _) in digest.items()}
    # a tree that loses its last shard: fewer words
    monkeypatch.setattr(mixing, "splitting_tree", lambda sources, *a: real(sources, *a).select(
        "rank", F.expr("transform(bounds, (z, i) -> if(i < 7, z, bounds[6]))").alias("bounds")))
    lost = {r.doc_id: (r.taken, r.shard_words) for r in query(spark, SF).collect()}
    assert lost == {d: (n - int(w.split(",")[7]), w.rsplit(",", 1)[0] + ",0") for d, (n, w) in digest.items()}


def test_licenses_messy(spark):
    got = {r.doc_id: r.license for r in licenses.scan(messy(spark)).collect()}
    assert licenses.scan(messy(spark)).count() == len(MESSY) and licenses.scan(messy(spark, [])).count() == 0
    assert got[10].base_labels == "reserved" and got[10].labels == "mit,reserved" and got[10].score == 1.0
    assert got[3].n_words == 0 and got[3].labels == "" and got[3].score == 0.0 and got[3].places == []


def found_by_hand(text, templates):
    """(word, label, containment) by looking at every window of every template."""
    import math

    ws, out = re.findall(licenses.WORD, text.translate(ASCII)), []
    for label, notice, must, without in templates:
        whole = re.findall(licenses.WORD, notice.translate(ASCII))
        own, best = set(whole), None
        for i, w in enumerate(ws):
            window = set(ws[i:i + math.ceil(1.25 * len(whole))])
            share = len(window & own) / len(own)
            if w in own and share >= licenses.THRESHOLD - 1e-9 and set(must.split()) <= window and not set(without.split()) & window:
                best = max(best or (0, 0), (share, -i))
        if best:
            out.append((-best[1], label, round(best[0], 9)))
    return sorted(out)


@pytest.mark.parametrize("group", [licenses.GROUP_WORDS, 40])
def test_license_containment_against_all_windows(spark, monkeypatch, group):
    monkeypatch.setattr(licenses, "GROUP_WORDS", group)
    r = random.Random(7)
    notices = [re.findall(licenses.WORD, t.translate(ASCII)) for _, t, _, _ in licenses.TEMPLATES]
    vocabulary = sorted({w for v in notices for w in v}) + ["filler", "library"]
    texts = []
    for i in range(150):
        block = [w for w in r.choice(notices) if r.random() < 0.9]
        for _ in range(r.randrange(4)):
            block.insert(r.randrange(len(block) + 1), r.choice(vocabulary))
        if r.random() < 0.3:
            r.shuffle(block)
        words_ = r.choices(vocabulary, k=r.randrange(12)) + block + r.choices(vocabulary, k=r.randrange(12))
        texts.append((i, "".join(w + r.choice([" ", "\n", ", ", "\n * "]) for w in words_), "s"))
    got = {x.doc_id: x.license for x in licenses.scan(messy(spark, texts, extra=False)).collect()}
    hits = 0
    for i, t, _ in texts:
        expected = found_by_hand(t, licenses.TEMPLATES)
        hits += len(expected)
        assert sorted((b.word, b.label, round(b.containment, 9)) for b in got[i].blocks) == expected
    assert hits > 80


def test_wrapped_notices_and_neighbouring_licenses(spark):
    notices = [(i, "# " + "\n# ".join(textwrap.wrap(t, 40)), label) for i, (label, t, _, _) in enumerate(licenses.TEMPLATES)]
    other = {
        "Licensed under CC BY 4.0.": {"cc-by", "cc-by-4.0"}, "Licensed under CC BY-SA 4.0.": {"cc-by", "cc-by-sa-4.0"},
        "Creative Commons Attribution 4.0 International": {"cc-by-4.0"}, "Released under the BSD License.": {"bsd"},
        "Creative Commons Attribution-NonCommercial 4.0 International": {"cc-by-nc-4.0"},
        "This work is licensed under the GNU General Public License, version 2.": {"gpl", "gpl-2.0"},
        "GNU Lesser General Public License, version 2.1.": {"gpl", "lgpl-2.1"},
        "Released under the Artistic License.": set(), "a license was released by the mayor under the bridge " * 40: set(),
        "the mit " + "word " * 9 + "license was released under": set()}
    rows = notices + [(100 + i, t, "s") for i, t in enumerate(other)]
    got = {x.doc_id: x.license for x in licenses.scan(messy(spark, rows)).collect()}
    for i, _, label in notices:
        assert set(filter(None, got[i].labels.split(","))) - {"cc-by", "gpl"} == {label}
    for i, labels in enumerate(other.values()):
        assert set(filter(None, got[100 + i].labels.split(","))) == labels
    assert licenses.scan(messy(spark), templates=()).count() == len(MESSY)
    with pytest.raises(ValueError):
        licenses.parsed([("x", "some words", "other", "")])
