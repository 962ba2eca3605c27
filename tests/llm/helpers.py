"""Row-wise comparison, messy input, and brute-force versions of the operators."""

import math
import re
import zlib
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(v) if isinstance(v, list) else v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(norm(x[i]) for i in order) for x in got.fetchall()), key=repr)


PROSE = ("the river ran past the old mill and the miller watched the water turn the heavy wheel while his daughter "
         "counted sacks of flour by the door and sang a song that nobody else in the village could remember").split()


def prose(seed, n):
    import random

    r = random.Random(repr(seed))
    return " ".join(r.choice(PROSE) + (str(r.randrange(30)) if r.random() < 0.4 else "") for _ in range(n))


#: (doc_id, text, source): nulls anywhere, empty and long texts, ties and repeated rows.
MESSY = [
    (1, prose(1, 60), "a"), (2, prose(1, 60), "a"), (2, prose(1, 60), "a"), (3, None, "b"), (4, "", None),
    (None, prose(2, 50), "b"), (None, prose(2, 50), "b"), (None, None, None), (5, " \n\t ", "a"), (6, "one", "c"),
    (7, prose(3, 30_000), "c"), (8, prose(1, 59) + " changed", "b"), (9, "Größe ñandú 日本 \x1c x", None),
    (10, "All rights reserved.\nReleased under the MIT License.", "a"), (11, "x" * 100_000, "a"),
]
#: Extra columns with the names that operators use themselves.
EXTRA = ["row", "key", "cell", "size", "words", "id", "text_hash", "n", "digest", "spans", "copy", "own_hash", "c0", "c1", "rank",
         "label", "license", "quality_rules", "benchmark_hits", "removal", "shard", "slot", "taken", "upto", "start", "more"]


def messy(spark, rows=MESSY, extra=True):
    schema = "doc_id bigint, text string, source string"
    if not extra:
        return spark.createDataFrame(rows, schema)
    return spark.createDataFrame([(*r, *[f"x{i}" for i in range(len(EXTRA))]) for r in rows],
                                 schema + "".join(f", `{c}` string" for c in EXTRA))


def words(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(ASCII) if lower else text)


def shingles(text):
    w = words(text, True)
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])


def near_components(rows):
    """{row number: smallest doc_id of its component} by all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    index = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in index[x] if j < i)
        for j, k in common.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(rows))], [len(s) for s in sets]


def base_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def repeated_words(texts, n=35):
    """(words, kept words) of each text after the removal of repeated windows."""
    lists = [words(t) for t in texts]
    count = Counter(tuple(w[i:i + n]) for w in lists for i in range(len(w) - n + 1))
    out = []
    for w in lists:
        gone = bytearray(len(w))
        for i in range(len(w) - n + 1):
            if count[tuple(w[i:i + n])] > 1:
                gone[i:i + n] = b"\1" * n
        out.append((len(w), [x for x, g in zip(w, gone) if not g]))
    return out


def distance(pattern, text):
    """Smallest edit distance of the pattern to a part of the text."""
    column = list(range(len(pattern) + 1))
    best = column[-1]
    for ch in text:
        new = [0]
        for i in range(1, len(pattern) + 1):
            new.append(min(column[i] + 1, new[-1] + 1, column[i - 1] + (pattern[i - 1] != ch)))
        column = new
        best = min(best, column[-1])
    return best


def crc(text):
    return zlib.crc32((text or "").encode())
