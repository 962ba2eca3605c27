"""Main text of pages: the reader of blocks, the network's gradients, and accuracy on pages that it has not seen."""

import html
import random
import re

import numpy as np
import pytest
from helpers import EXTRA, SF, prose

from areascope.llm import maintext as M


def texts(page):
    return [b.text for b in M.blocks(page)]


@pytest.mark.parametrize("page, exp", [
    ("", []), ("plain", ["plain"]), ("<p>a<p>b", ["a", "b"]), ("<p>a <b>b</b>c<br>d</p>", ["a bc d"]), ("<div>a<p>b</p>c</div>", ["a", "b", "c"]),
    ("<p>&lt;b&gt; &amp;amp; &#233;&nbsp;x &am &copy</p>", ["<b> &amp; é x &am ©"]), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ('<script>var t="</p><p>x";</script><p>a', ["a"]), ("<style>p{}</style>a<!-- <p>b</p> -->c", ["ac"]), ("a < b and 1<2", ["a < b and 1<2"]),
    ("<head><title>t</title><p>a", ["a"]), ("<title>t</title><body>a", ["a"]), ('<p title="a>b">c</p>', ["c"]), ("<p class='x' id=y>c", ["c"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("<p>a</div>b</p>c", ["a", "b", "c"]), ("</p></i>a", ["a"]), ("<p>a<!-- never ended", ["a"]),
    ('<p>a<b class="never ended', ["a"]), ("<script>never ended <p>a", []), ("<select><option>x</select><p>a", ["a"]), ("\n <p>\n\t</p> 　", []),
    ("<DIV>A</DIV><P>B", ["A", "B"]), ("<p>a<hr>b<img src=x>c", ["a", "bc"]), ("<!DOCTYPE html><?xml x?>a", ["a"]), ("x<y>z</y>w", ["xzw"])])
def test_blocks(page, exp):
    assert texts(page) == exp


def test_blocks_of_deep_and_long_pages():
    assert texts("<div>" * 50_000 + "a" + "</div>" * 50_000 + "<p>b") == ["a", "b"]
    assert len(texts("<p>x " * 50_000)) == 50_000
    assert texts("<a " * 20_000) == [] and len(texts("<" * 20_000)[0]) == 20_000
    assert texts("<i>" * 20_000 + "x" * 200_000) == ["x" * 200_000]


def test_paths_and_marks():
    b = M.blocks('<body><main class="siteMain"><header><h1>t</h1></header><div id="user-comments"><p>c</p></div></main><div class="left">x <a>yy</a></div>')
    assert [x.path for x in b][1] == ("body", "/", "main", ".site", ".main", ".sitemain", "/", "div", ".user", ".comments", ".usercomments", "/", "p", "/")
    assert [M.marked(x.path) for x in b] == [True, False, None] and b[2].links == 2


def test_gradients():
    rng = random.Random(3)
    pages = [M.layout(rng, [prose(i, 9) for i in range(9)], ["menu", "more"]) for _ in range(3)]
    model, reader = M.Labeller(), M.Vectors()
    model.p = {k: v.astype(np.float64) + 0.05 * np.random.default_rng(len(k)).normal(size=v.shape) for k, v in model.p.items()}
    lengths = np.array([len(p) for p, _ in pages])
    reads = [reader.read(p) for p, _ in pages]
    shift = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    read = tuple(np.concatenate([r[i] + (s if i in (1, 3) else 0) for r, s in zip(reads, shift)]) for i in range(5))
    label = np.concatenate([np.array(y) for _, y in pages])
    weight = np.random.default_rng(0).integers(0, 2, len(label)).astype(float)
    _, grad = model.gradient(read, lengths, label, weight)
    r = np.random.default_rng(1)
    for name, value in model.p.items():
        flat, used = value.reshape(-1), np.flatnonzero(np.abs(grad[name].ravel()) > 1e-4)
        for i in r.choice(used, min(4, len(used)), replace=False):
            old, step = flat[i], 1e-2
            flat[i] = old + step
            up, _ = model.gradient(read, lengths, label, weight)
            flat[i] = old - step
            down, _ = model.gradient(read, lengths, label, weight)
            flat[i] = old
            assert abs((up - down) / (2 * step) - grad[name].reshape(-1)[i]) < 2e-3 + 0.05 * abs(grad[name].reshape(-1)[i]), name


@pytest.fixture(scope="module")
def model(spark):
    return M.train(spark.read.parquet(f"{SF}/pages.parquet"))


def test_held_out_layouts(model):
    """Layouts of other texts than those that it learned from."""
    rng = random.Random(77)
    pages = [M.layout(rng, [prose((i, j), 5 + 3 * j) for j in range(12)], [prose((i, "o"), 4)]) for i in range(200)]
    p = model.probabilities([b for b, _ in pages], M.Vectors())
    right = [((q >= M.THRESHOLD) == np.array(y)) for q, (_, y) in zip(p, pages)]
    assert np.concatenate(right).mean() > 0.99 and np.mean([r.all() for r in right]) > 0.9


def test_pages_of_another_make(spark, model):
    main = [prose(i, 30) + "." for i in range(6)]
    p = "".join(f"<p>{t}</p>" for t in main)
    rest = {
        "article": f"<header><p>Site</p></header><nav><a>Home</a></nav><article>{p}</article><aside><p>{prose(9, 20)}</p></aside>",
        "main": f"<div class='cookie-banner'>We use cookies.</div><main>{p}<form><label>Mail</label></form></main><footer><p>Copyright</p></footer>",
        "div": f"<ul class=menu><li><a>Home</a><li><a>More</a></ul><div id=content>{p}<div class='ad'>{prose(8, 12)}</div></div><div id=comments><p>{prose(7, 25)}</p></div>",
    }
    df = spark.createDataFrame([(i, k, f"<html><body>{v}</body></html>") for i, (k, v) in enumerate(rest.items())], "page_id bigint, url string, html string")
    assert {r["main_text"]["text"] for r in M.extract(df, model).collect()} == {" ".join(main)}


def test_whole_table_against_its_articles(spark, model):
    df = spark.read.parquet(f"{SF}/pages.parquet")

    def article(page):
        body = re.search(r"(?s)<article>(.*)</article>", page)[1]
        return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())

    rows = M.extract(df, model).collect()
    assert len(rows) == 50 and all(r["main_text"]["text"] == article(r["html"]) and r["main_text"]["n_chars"] == len(r["main_text"]["text"]) for r in rows)


def test_messy_pages(spark, model):
    schema = "page_id bigint, url string, html string" + "".join(f", `{c}` string" for c in [*EXTRA, "main_text", "text", "k"])
    long = "<article>" + "".join(f"<p>{prose(i, 8)}</p>" for i in range(30_000)) + "</article>"
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, "u", "<nav>x</nav>"), (3, "v", long), (3, "v", "<article><p>Größe 日本 &amp; x.</p></article>"), (4, "w", "\x00<")]
    df = spark.createDataFrame([(*r, *["x"] * (len(EXTRA) + 3)) for r in rows], schema)
    again = M.train(df)
    for m in (model, again, None):
        out = M.extract(df, m)
        assert out.columns == [c for c in df.columns if c != "main_text"] + ["main_text"] and out.count() == len(rows)
    got = {(r["page_id"], r["main_text"]["n_blocks"]): r["main_text"] for r in M.extract(df, model).collect()}
    assert got[(1, 0)]["text"] == got[(None, 0)]["text"] == got[(2, 1)]["text"] == "" and got[(3, 1)]["text"] == "Größe 日本 & x."
    assert got[(3, 30_000)]["n_kept"] == 30_000
    assert M.train(df.limit(0)) is None and M.extract(df.limit(0), None).count() == 0
    assert again.dump() == M.train(df.repartition(3)).dump()          # the sample does not depend on the order of rows
