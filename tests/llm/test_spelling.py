"""Spelling variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest
from helpers import ASCII, SF, messy

from areascope.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    index = {}
    for w in n:                                        # near words share a word with one code point less
        for x in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            index.setdefault(x, set()).add(w)
    out = {}
    for w in n:
        hits = {v for x in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))} for v in index[x] if near(w, v)}
        best = min(hits, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = (form, n[w], len(hits), n[form] if form else None)
    rows = []
    for w, (form, c, k, fn) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, c, k, fn))
    return sorted(rows, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=repr)


def test_variants_of_the_whole_table(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    exp = brute(rows)
    assert got(spelling.variants(spark.read.parquet(f"{SF}/documents.parquet"))) == exp
    assert len(exp) > 1000 and any(r[1] for r in exp) and any(r[1] != r[2] for r in exp if r[1])


def test_variants_messy(spark):
    r = random.Random(5)
    long = "".join(r.choice("abcdefghé") for _ in range(9000))
    edge = "".join(r.choice("klmnÿ") for _ in range(spelling.CARRIED))
    words = [long, long[:4000] + "z" + long[4001:], long[:-1], "ü" + long, edge, edge + "k", edge[1:], edge[:-1] + "z",
             "planet", "Planets", "PLANE", "plant", "planét", "planÉt", "a×b÷c", "aaaaaa", "aaaaaaa", "aaaaa", "abcde", "abcdf", "bcdef"]
    rows = [(i, " ".join(w for w in words for _ in range(r.randrange(1, 9))), "a") for i in range(6)]
    rows += [(None, " ".join(words), None)] * 2 + [(7, None, "a"), (8, "", "a"), (9, " \n12 3Āx¿y ", "b"), (3, "planet,planet;planet", "b")]
    rows += [(100 + i, "planet planets größe", "c") for i in range(300)]      # some lose a code point
    exp = brute([(a, b) for a, b, _ in rows])
    assert got(spelling.variants(messy(spark, rows))) == exp
    assert {long, edge + "k", "plane"} <= {w for w, *_ in exp}
    assert spelling.variants(messy(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("word", ["aab", "abcba", "aaaaa", "abcabcaabb"])
def test_neighbourhood_is_full_and_distinct(word):
    table = spelling.reduction({c: 1 for c in "abcdef"}, 4)
    hood = spelling.Neighbourhood(table, 4)
    symbol = lambda t: "".join("abcd"[table[ord(c)]] for c in t)
    own = symbol(word)
    full = {own} | {own[:i] + own[i + 1:] for i in range(len(own))} | {own[:i] + c + own[i + 1:] for i in range(len(own)) for c in "abcd"} | \
        {own[:i] + c + own[i:] for i in range(len(own) + 1) for c in "abcd"}
    back = {symbol(c): c for c in "abcd"}
    keys, of = hood.around([word])
    assert sorted(keys.tolist()) == sorted(int(hood.keys(["".join(back[c] for c in t)])[0]) for t in full) and set(of) == {0}


def test_one_edit():
    r = random.Random(2)
    words = ["".join(r.choice("abé") for _ in range(r.randrange(1, 7))) for _ in range(150)]
    assert all(spelling.one_edit(a, b) == near(a, b) for a in words for b in words)


def test_roots_of_long_chains(spark):
    rows = [(str(i), str(i + 1)) for i in range(40)] + [("x", "0"), ("y", "z")]
    exp = {str(i): "40" for i in range(40)} | {"x": "40", "y": "z"}
    assert {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()} == exp
