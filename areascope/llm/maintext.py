"""Main text of HTML pages by a recurrent block labeller.

Blocks. A page is read tag by tag; block-level tags end a block, inline tags and line breaks do not. What is never shown (scripts,
styles, the head, form fields, comments and other markup) is no block. A block has its text (character references decoded,
white space turned into one space, trimmed) and its path: the elements that are open around it.

Vectors. A block is the sum of trained vectors of its path's tokens (tag names, and the parts of class, id and role), hashed to
``PATHS`` rows, the mean of trained vectors of its words, hashed to ``WORDS`` rows, and three numbers (length, share of link text, digits and signs).

Labels. A bidirectional LSTM in numpy reads the blocks of a page from both ends, and a logistic layer on both states says for each block
whether it is main text: each block is judged in the context of the whole page, however long.

Training takes a bounded sample: the ``SAMPLE_PAGES`` pages with the smallest md5 of id and address, each to its first
``SAMPLE_BLOCKS`` blocks. Pages label themselves where their markup says so (inside article or main: text; inside nav, aside, footer, form, or an
element whose class or id names an advert, menu, sidebar, notice, comment...: not; the inner one decides; else unlabelled). To learn pages that
say it otherwise or not at all, the sample's blocks are also laid out anew under other paths (``LAYOUTS`` pages, built from a list of usual
names), and path tokens are hidden at random. Training runs in one task on that sample; all else is one pass over all
pages in Arrow batches without a shuffle, and only the weights are sent to tasks.

Defined results: a null or empty page, or one without main text, has the empty text; a repeated page is read alike (and counts once in
the sample); without labelled blocks the model learns from layouts alone; an empty table gives an empty result; all columns of the input are
carried. A tag that never ends reaches to the end of the page, as in browsers.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areascope.llm.common import map_arrow, numbered, renamed
from areascope.llm.textops import as_bytes

#: Hashed rows and width of path and word vectors, state of each direction.
PATHS, PATH_DIM, WORDS, WORD_DIM, STATE = 4096, 12, 4096, 6, 16
#: Bound of the training sample: pages, blocks of a page, words of a block; pages laid out anew.
SAMPLE_PAGES, SAMPLE_BLOCKS, SAMPLE_WORDS, LAYOUTS = 200, 120, 60, 500
EPOCHS, BATCH, RATE, HIDE, THRESHOLD = 8, 32, 0.01, 0.3, 0.5
#: Pages read together: at most so many blocks, or one page.
GROUP_BLOCKS = 20_000
NUMBERS = 3
INPUT = PATH_DIM + WORD_DIM + NUMBERS

# Fixed values of HTML: elements without content, elements that are not shown, whose content is raw, that end a block, and that end an open p.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript iframe object svg math canvas audio video select option textarea button title datalist".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - frozenset("body html caption dd dt legend optgroup tbody td tfoot th thead tr li".split()) | {"li", "dd", "dt"}
#: An opening tag ends the nearest open one of these, up to a border.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
BORDER = frozenset("ul ol menu dl table div section article body".split())
HEAD_TAGS = frozenset("base link meta title style script noscript template".split())
#: Elements open at once; a deeper one takes the place of the innermost.
DEPTH = 256

# What markup calls main text, and what it calls something else.
MAIN_TAGS, OTHER_TAGS = frozenset(["article", "main"]), frozenset("nav aside footer form menu dialog search".split())
OTHER_NAMES = frozenset("""ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb
breadcrumbs sidebar widget related recommended footer copyright cookie cookies consent gdpr notice alert popup modal newsletter subscribe
signup login share sharing social comment comments commentlist respond reply disqus masthead topbar toolbar pagination""".split())
MAIN_NAMES = frozenset("articlebody content entry post story".split())

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""[\s/]*(?:([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>"'][^\s>]*))?)?|=)""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]       # tokens of the open elements, outermost first; "/" ends an element
    links: int                  # characters in links


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes of a tag from the end of its name, and the place after the tag."""
    found: dict[str, str] = {}
    while at < len(page):
        if page[at] == ">":
            return found, at + 1
        m = _ATTR.match(page, at)
        if not m or m.end() == at:
            at += 1
            continue
        if m[1]:
            found.setdefault(m[1].lower(), html.unescape(next((g for g in m.groups()[1:] if g is not None), "")))
        at = m.end()
    return found, at


def tokens_of(tag: str, attributes: dict[str, str]) -> list[str]:
    """Path tokens of an element."""
    out = [tag]
    for name in ("class", "id", "role", "itemprop"):
        for value in attributes.get(name, "").split()[:20]:
            parts = [p.lower() for p in _PART.findall(value)[:10]]
            out += [f".{p}" for p in parts]
            if len(parts) > 1:
                out.append("." + "".join(parts))
    return out


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in its order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    hidden = links = linked = at = 0
    path: tuple[str, ...] = ()

    def end():
        nonlocal linked
        if text:
            t = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if t:
                out.append(Block(t, path, linked))
        linked = 0

    def leave(n):
        """Close the innermost elements down to ``n``."""
        nonlocal hidden, links, path
        while len(stack) > n:
            tag, before = stack.pop()
            hidden -= tag in HIDDEN
            links -= tag == "a"
            if tag in BLOCK:
                end()
            path = before

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            lt = len(page)
        if lt > at and not hidden:
            text.append(page[at:lt])
            linked += (lt - at) * bool(links)
        at = lt
        if at >= len(page):
            break
        m = _OPEN.match(page, at)
        if m is None:
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 4)
                at = len(page) if stop < 0 else stop + 3
            elif page.startswith(("<!", "<?", "</"), at):
                stop = page.find(">", at)
                at = len(page) if stop < 0 else stop + 1
            else:
                if not hidden:
                    text.append("<")
                at += 1
            continue
        tag = m[2].lower()
        attributes, at = _attributes(page, m.end())
        if stack and stack[-1][0] == "head" and not m[1] and tag not in HEAD_TAGS:
            leave(len(stack) - 1)                      # a head ends with the first element that it cannot hold
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                leave(depth)
            elif tag in BLOCK:
                end()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK:
            end()
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            # a p holds no blocks: it ends with what is open inside it
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p" or stack[i][0] in BORDER), None)
            if depth is not None and stack[depth][0] == "p":
                leave(depth)
        if tag in SIBLINGS:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in SIBLINGS[tag] or stack[i][0] in BORDER), None)
            if depth is not None and stack[depth][0] not in BORDER:
                leave(depth)
        if len(stack) >= DEPTH:
            leave(DEPTH - 1)
        stack.append((tag, path))
        path = (*path, *tokens_of(tag, attributes), "/")
        hidden += tag in HIDDEN
        links += tag == "a"
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            inner = len(page) if close is None else close.start()
            if not hidden:
                text.append(page[at:inner])
            at = inner
    leave(0)
    end()
    return out


def marked(path: Sequence[str]) -> bool | None:
    """What the markup says of a block: main text, something else, or nothing. The innermost element that says something decides."""
    verdict: bool | None = None
    element: list[str] = []
    for token in path:
        if token != "/":
            element.append(token)
            continue
        names = {t[1:] for t in element[1:]}
        if element[0] in OTHER_TAGS or names & OTHER_NAMES or ((element[0] == "header" or "header" in names) and not verdict):
            verdict = False
        elif element[0] in MAIN_TAGS or names & MAIN_NAMES:
            verdict = True
        element = []
    return verdict


# Usual places of a page: (elements around the text, whether its text is a link). An element is a tag with its class or #id.
_PLACES = {
    "header": ["header", "header p", "#header div", "div.masthead span", "div.site-header p", "div.top-bar", "div.header h2"],
    "nav": ["nav ul li a", "ul.menu li a", "div.navbar a", "#navigation ul li a", "div.breadcrumbs a", "nav a", "div.menu p", "nav p"],
    "notice": ["div.cookie-notice p", "#gdpr p", "div.alert", "div.popup p", "div.notice p", "section.consent p", "div.cookie-banner", "#cookie p"],
    "ad": ["div.ad", "div.ads p", "div.banner p", "aside.advert p", "div.adsense", "div.sponsored p", "div.promo p", "section.advertisement p"],
    "aside": ["aside p", "aside ul li a", "div.sidebar p", "#sidebar div.widget li a", "div.related ul li a", "section.recommended li", "aside h3"],
    "comments": ["#comments p", "section.comments div.comment p", "ol.commentlist li p", "div.disqus p", "ul.comments li", "#respond p",
                 "div.reader-comments p", "div.comment", "section.comment-list blockquote"],
    "form": ["form label", "form.newsletter p", "form p", "div.subscribe p", "form.search label", "div.newsletter-signup p"],
    "share": ["div.share ul li a", "ul.social li a", "div.sharing p"],
    "footer": ["footer", "footer p", "#footer p", "div.footer ul li a", "div.copyright", "footer ul li a", "div.site-footer p"],
}
_AROUND = ["", "", "div", "div.wrapper", "#page", "div.container div.row", "div.site div.inner"]
_MAIN = ["article", "main", "main article", "#content", "div.post", "div.entry-content", "div.article-body", "section.story", "#main", "div", "", "div div",
         "div.article", "div.text", "section", "table tr td"]
_INSIDE = ["p", "p", "p", "p", "p", "h2", "ul li", "blockquote p", "ol li", "h3", "div", "figure figcaption", "pre", "section p"]
_PHRASES = ["Home", "About us", "Contact", "Log in", "Sign up", "Subscribe to our newsletter", "We use cookies to improve this site.", "Accept all",
            "Privacy policy", "Terms of use", "All rights reserved", "Advertisement", "Sponsored", "Read more", "Share this", "Leave a reply",
            "Comments", "Related articles", "Search", "Your email address", "Back to top", "Next page", "Copyright 2024", "Menu", "Follow us"]


def _path(elements: str) -> tuple[str, ...]:
    out: list[str] = []
    for e in elements.split():
        tag, _, name = e.partition("#") if e.startswith("#") else e.partition(".")
        out += [*tokens_of(tag or "div", {"id" if e.startswith("#") else "class": name}), "/"]
    return tuple(out)


def layout(rng: random.Random, main: list[str], other: list[str]) -> tuple[list[Block], list[float]]:
    """A page with texts of the sample in usual places, and the labels of its blocks."""
    page, labels, around = [], [], rng.choice(_AROUND)

    def put(elements: str, text: str, label: float):
        page.append(Block(text, _path(f"html body {around} {elements}"), len(text) if elements.endswith(" a") else 0))
        labels.append(label)

    def some(place: str, inside: str = ""):
        spot = f"{inside} {rng.choice(_PLACES[place])}"
        for _ in range(rng.randrange(1, 7)):
            put(spot, rng.choice(rng.choice((_PHRASES, other or _PHRASES, main or _PHRASES))), 0.0)

    for place in ("header", "nav", "notice", "ad", "share"):
        if rng.random() < 0.5:
            some(place)
    inside = rng.choice(_MAIN)
    put(f"{inside} {rng.choice(('h1', 'h1', 'header h1', 'h2'))}", rng.choice(main), 1.0)
    for _ in range(rng.randrange(0, 15)):
        put(f"{inside} {rng.choice(_INSIDE)}", rng.choice(main), 1.0)
        if rng.random() < 0.08:
            some(rng.choice(("ad", "share", "form", "aside", "notice")), inside)
    if rng.random() < 0.3:
        some(rng.choice(("comments", "form", "share", "ad")), inside)
    after = ["aside", "comments", "form", "notice", "ad"]
    rng.shuffle(after)
    for place in after:
        if rng.random() < 0.35:
            some(place)
    if rng.random() < 0.7:
        some("footer")
    return page, labels


def _hash(token: str, rows: int) -> int:
    return zlib.crc32(token.encode()) % rows


class Vectors:
    """Reads blocks into hashed path tokens, hashed words and numbers."""

    def __init__(self):
        self.paths: dict[tuple[str, ...], list[int]] = {}

    def path(self, path: tuple[str, ...], hide: bool = False) -> list[int]:
        if hide:
            path = tuple(t for t in path if t not in MAIN_TAGS and t[1:] not in MAIN_NAMES)
        known = self.paths.get(path)
        if known is None:
            if len(self.paths) > 20_000:
                self.paths.clear()
            tags = [t for t in path if t != "/" and not t.startswith(".")]
            known = self.paths[path] = sorted({_hash(t, PATHS) for t in (*path, "=" + (tags[-1] if tags else ""))})
        return known

    def read(self, found: Sequence[Block], hide: bool = False) -> tuple[np.ndarray, ...]:
        """(path rows, block of each), (word rows, block of each), numbers (blocks x 3)."""
        crc = zlib.crc32
        paths = [self.path(b.path, hide) for b in found]
        words = [[crc(w) % WORDS for w in b.text.lower().encode().split()] for b in found]
        n = np.arange(len(found))
        numbers = np.array([(np.log1p(len(b.text)) / 6, min(1.0, b.links / len(b.text)), b.text[-1] in ".!?\u2026\"\u201d") for b in found],
                           np.float32).reshape(-1, NUMBERS)
        flat = lambda xs: np.fromiter((x for row in xs for x in row), np.int64, sum(map(len, xs)))
        return flat(paths), np.repeat(n, [len(p) for p in paths]), flat(words), np.repeat(n, [len(w) for w in words]), numbers


def _sum_rows(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by ascending ``at``."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(at):
        first = np.flatnonzero(np.diff(at, prepend=-1))
        out[at[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


class Labeller:
    """Block vectors, a bidirectional LSTM, and a logistic layer."""

    def __init__(self, weights: bytes | None = None):
        rng = np.random.default_rng(13)
        shapes = {"path": (PATHS, PATH_DIM), "word": (WORDS, WORD_DIM), "out": (2 * STATE,), "bias": (1,)}
        for d in "fb":
            shapes |= {f"x{d}": (INPUT, 4 * STATE), f"h{d}": (STATE, 4 * STATE), f"b{d}": (4 * STATE,)}
        flat, at, self.p = np.frombuffer(weights, np.float32) if weights else None, 0, {}
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            # unseen tokens and words say nothing: their vectors start at zero
            start = np.zeros(shape) if name in ("path", "word", "bias") or name[0] == "b" else rng.normal(0, 0.3, shape)
            self.p[name] = (start if flat is None else flat[at:at + n].reshape(shape)).astype(np.float32)
            at += n
        if weights is None:
            for d in "fb":
                self.p[f"b{d}"][STATE:2 * STATE] = 1.0     # gates that keep start open

    def dump(self) -> bytes:
        return b"".join(v.tobytes() for v in self.p.values())

    def inputs(self, read: tuple[np.ndarray, ...]) -> np.ndarray:
        paths, path_of, words, word_of, numbers = read
        n = len(numbers)
        count = np.maximum(1, np.bincount(word_of, minlength=n)).astype(np.float32)[:, None]
        return np.concatenate((_sum_rows(self.p["path"][paths], path_of, n), _sum_rows(self.p["word"][words], word_of, n) / count, numbers), axis=1)

    def _run(self, d: str, x: np.ndarray, live: np.ndarray, kept: list | None = None) -> np.ndarray:
        """States of one direction (time x pages x STATE); where a page is over, the state stays."""
        a = x @ self.p[f"x{d}"] + self.p[f"b{d}"]
        h = np.zeros((x.shape[1], STATE), np.float32)
        c, out, wh = h, np.empty((*x.shape[:2], STATE), np.float32), self.p[f"h{d}"]
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z, m = a[t] + h @ wh, live[t]
            gate, g = _sigmoid(z[:, :3 * STATE]), np.tanh(z[:, 3 * STATE:])
            i, f, o = gate[:, :STATE], gate[:, STATE:2 * STATE], gate[:, 2 * STATE:]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if kept is not None:
                kept.append((t, h, c, i, f, o, g, tc))
            h, c = np.where(m, o * tc, h), np.where(m, c_new, c)
            out[t] = h
        return out

    def _back(self, d: str, x: np.ndarray, live: np.ndarray, kept: list, down: np.ndarray, grad: dict) -> np.ndarray:
        wh = self.p[f"h{d}"]
        dh = np.zeros((x.shape[1], STATE), np.float32)
        dc, da = dh, np.zeros((*x.shape[:2], 4 * STATE), np.float32)
        for t, h, c, i, f, o, g, tc in reversed(kept):
            m = live[t]
            dh = dh + down[t]
            own = np.where(m, dh, 0)
            cell = np.where(m, dc, 0) + own * o * (1 - tc * tc)
            dz = np.concatenate((cell * g * i * (1 - i), cell * c * f * (1 - f), own * tc * o * (1 - o), cell * i * (1 - g * g)), axis=1)
            da[t] = dz
            grad[f"h{d}"] += h.T @ dz
            dh, dc = np.where(m, dz @ wh.T, dh), np.where(m, cell * f, dc)
        flat = da.reshape(-1, 4 * STATE)
        grad[f"x{d}"] += x.reshape(-1, x.shape[2]).T @ flat
        grad[f"b{d}"] += flat.sum(axis=0)
        return da @ self.p[f"x{d}"].T

    @staticmethod
    def side_by_side(vectors: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(time x pages x input, time x pages x 1 of whether the page has a block there)."""
        live = np.arange(lengths.max(initial=0))[:, None] < lengths[None, :]
        x = np.zeros((*live.shape, vectors.shape[1]), np.float32)
        x.transpose(1, 0, 2)[live.T] = vectors
        return x, live[:, :, None]

    def probabilities(self, found: Sequence[Sequence[Block]], reader: Vectors) -> list[np.ndarray]:
        """Probability of main text for each block of each page; pages of like length run side by side."""
        out: list[np.ndarray] = [np.empty(0, np.float32)] * len(found)
        order = sorted(range(len(found)), key=lambda k: len(found[k]))
        for lo in range(0, len(order), 128):
            at = [k for k in order[lo:lo + 128] if found[k]]
            if not at:
                continue
            lengths = np.array([len(found[k]) for k in at])
            x, live = self.side_by_side(self.inputs(reader.read([b for k in at for b in found[k]])), lengths)
            states = np.concatenate((self._run("f", x, live), self._run("b", x, live)), axis=2)
            p = _sigmoid(states @ self.p["out"] + self.p["bias"])
            for j, k in enumerate(at):
                out[k] = p[:lengths[j], j]
        return out

    def gradient(self, read: tuple[np.ndarray, ...], lengths: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Mean weighted loss of some pages' blocks and its gradients."""
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        x, live = self.side_by_side(self.inputs(read), lengths)
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._run(d, x, live, kept[d]) for d in "fb"], axis=2)
        flat = live[:, :, 0].T
        rows = states.transpose(1, 0, 2)[flat]
        z = rows @ self.p["out"] + self.p["bias"]
        p, total = _sigmoid(z), max(1e-6, float(weight.sum()))
        error = ((p - label) * weight / total).astype(np.float32)
        loss = float((weight * (np.logaddexp(0, z) - label * z)).sum() / total)
        grad["out"], grad["bias"] = rows.T @ error, error.sum(keepdims=True)
        down = np.zeros_like(states)
        down.transpose(1, 0, 2)[flat] = error[:, None] * self.p["out"]
        dx = sum(self._back(d, x, live, kept[d], down[:, :, s], grad) for d, s in (("f", slice(0, STATE)), ("b", slice(STATE, 2 * STATE))))
        dx = dx.transpose(1, 0, 2)[flat]
        paths, path_of, words, word_of, numbers = read
        count = np.maximum(1, np.bincount(word_of, minlength=len(numbers))).astype(np.float32)[:, None]
        np.add.at(grad["path"], paths, dx[path_of, :PATH_DIM])
        np.add.at(grad["word"], words, (dx[:, PATH_DIM:PATH_DIM + WORD_DIM] / count)[word_of])
        return loss, grad


def fit(pages: list[list[Block]], seed: int = 13) -> Labeller:
    """A labeller of sampled pages (their own marks) and of layouts made from their texts."""
    rng, model, reader = random.Random(seed), Labeller(), Vectors()
    marks = [[marked(b.path) for b in page] for page in pages]
    main = [b.text for page, m in zip(pages, marks) for b, v in zip(page, m) if v] or _PHRASES
    other = [b.text for page, m in zip(pages, marks) for b, v in zip(page, m) if v is False]
    examples = [(page, [0.0 if v is None else float(v) for v in m], [float(v is not None) for v in m], HIDE) for page, m in zip(pages, marks) if page]
    for _ in range(LAYOUTS):
        page, labels = layout(rng, main, other)
        examples.append((page, labels, [1.0] * len(page), 0.0))
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(w) for k, w in model.p.items()}
    steps, t = EPOCHS * -(-len(examples) // BATCH), 0
    for _ in range(EPOCHS):
        rng.shuffle(examples)
        order = sorted(range(len(examples)), key=lambda i: len(examples[i][0]) // 8)      # like lengths together
        batches = [[examples[i] for i in order[lo:lo + BATCH]] for lo in range(0, len(order), BATCH)]
        rng.shuffle(batches)
        for batch in batches:
            reads = [reader.read(page, rng.random() < hide) for page, _, _, hide in batch]
            lengths = np.array([len(page) for page, *_ in batch])
            shift = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            joined = tuple(np.concatenate([r[i] + (s if i in (1, 3) else 0) for r, s in zip(reads, shift)]) for i in range(5))
            label, weight = (np.array([x for e in batch for x in e[i]], np.float32) for i in (1, 2))
            _, grad = model.gradient(joined, lengths, label, weight)
            t += 1
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            clip, rate = min(1.0, 5.0 / (size + 1e-9)), RATE * min(1.0, 1.2 - t / steps)
            for k, g in grad.items():
                g = g * np.float32(clip)
                m[k] += np.float32(0.1) * (g - m[k])
                v[k] += np.float32(0.01) * (g * g - v[k])
                model.p[k] -= np.float32(rate / (1 - 0.9**t)) * m[k] / (np.sqrt(v[k] / np.float32(1 - 0.99**t)) + np.float32(1e-6))
    return model


def train(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", sample: int = SAMPLE_PAGES) -> Labeller | None:
    """The labeller of a bounded sample of pages; None for an empty table."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in (page_id, url)]
    keyed = pages.select(F.md5(F.concat_ws("|", F.lit("page"), *parts)).alias("k"), F.coalesce(F.col(page), F.lit("")).alias("html"))
    few = keyed.select("k").distinct().orderBy("k").limit(sample)                                  # sample rows
    picked = keyed.join(F.broadcast(few), "k")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = blocks(batch.column(1)[i].as_py())[:SAMPLE_BLOCKS]
                texts = [" ".join(b.text.split(" ")[:SAMPLE_WORDS]) for b in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([texts], pa.list_(pa.string())),
                                                  pa.array([[" ".join(b.path) for b in found]], pa.list_(pa.string())),
                                                  pa.array([[min(b.links, 1 << 20) for b in found]], pa.list_(pa.int32()))], ["k", "texts", "paths", "links"])

    rows = map_arrow(picked.select("k", "html"), cut, "k string, texts array<string>, paths array<string>, links array<int>")
    rows = rows.groupBy("k").agg(F.min(F.struct("texts", "paths", "links")).alias("s")).select("k", "s.*")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((tuple(r.values()) for b in batches for r in b.to_pylist()), key=lambda r: r[0])
        if got:
            found = [[Block(t, tuple(p.split(" ")) if p else (), n) for t, p, n in zip(*r[1:])] for r in got]
            yield pa.RecordBatch.from_arrays([pa.array([fit(found).dump()])], ["weights"])

    got = map_arrow(rows.repartition(1), learn, "weights binary").collect()
    return Labeller(bytes(got[0]["weights"])) if got else None


def extract(pages: DataFrame, model: Labeller | None, page: str = "html") -> DataFrame:
    """``pages`` with a struct column ``main_text``: the text, its code points, the blocks of the page and those kept."""
    result = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
                           T.StructField("n_blocks", T.LongType()), T.StructField("n_kept", T.LongType())])
    at, rows = pages.columns.index(page), numbered(pages)
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("main_text", result)])
    weights = model.dump() if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, reader = Labeller(weights) if weights else None, Vectors()

        def out(batch, lo, found):
            p = labeller.probabilities(found, reader) if labeller else [np.zeros(len(f)) for f in found]
            kept = [[b.text for b, v in zip(f, q) if v >= THRESHOLD] for f, q in zip(found, p)]
            texts = [" ".join(k) for k in kept]
            columns = [pa.array(texts, pa.string()), *(pa.array([len(x) for x in xs], pa.int64()) for xs in (texts, found, kept))]
            return pa.RecordBatch.from_arrays([*batch.slice(lo, len(found)).columns, pa.StructArray.from_arrays(columns, [f.name for f in result])],
                                              [*names, "main_text"])

        for batch in batches:
            lo, found, size = 0, [], 0
            for text in as_bytes(batch.column(at)):
                found.append(blocks(text.decode()))
                size += len(found[-1]) + 1
                if size > GROUP_BLOCKS:
                    yield out(batch, lo, found)
                    lo, found, size = lo + len(found), [], 0
            if found:
                yield out(batch, lo, found)

    return renamed(map_arrow(rows, run, schema), pages.columns, "main_text")
