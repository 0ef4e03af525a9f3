"""Main-text extraction: gradient-boosted trees over DOM-node features, decoded down the tree.

A page is cut into tags and text by one linear pass; block elements become nodes, inline markup only adds to its block's
text, and text beside block children is a node of its own. Each node's features (tag, attribute tokens, depth,
siblings, density of its subtree, links, position) give the boosted trees' log-odds that it holds
main text. Decoding is hierarchical: a dropped node drops its whole subtree and a kept node needs a kept parent, and of all such
choices the one with the largest total log-odds is taken, so ancestors and descendants never contradict.

The model is trained here, on pages that a seeded generator writes from layouts with known article parts;
no page of the corpus is used, so results don't depend on the sample.

Edge cases: null or empty html gives empty text; unclosed and stray tags, unclosed comments and scripts end with the page;
deep nesting is walked without recursion; repeated pages are extracted alike; a null page_id is kept;
nothing is dropped for length; other columns are not read.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.memory import released
from lattice.storage import bound_batches

_TAG = re.compile(r"<(?:!--(?P<note>)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[!?/][^>]*>)")
_ATTR = re.compile(r"(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object textarea select title noframes xmp canvas audio video head".split())
BLOCK = frozenset(
    "html body article main section div header footer nav aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary dialog menu center hgroup search hr legend".split()
)
CLOSES_P = BLOCK - frozenset(("html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "legend"))
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
TAGS = ("article", "main", "section", "div", "header", "footer", "nav", "aside", "form", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "table", "tr", "td", "blockquote", "pre", "figure", "figcaption", "body", "html", "#text", "dialog", "details", "address")
WORDS = {
    "good": frozenset("article content main post entry body text story prose blog page document paragraph".split()),
    "menu": frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs topbar toolbar pagination pager links tabs skip toc sitemap".split()),
    "foot": frozenset("footer foot copyright legal colophon bottom credits".split()),
    "head": frozenset("header masthead banner logo brand branding hero top".split()),
    "side": frozenset("sidebar side aside widget widgets related recommended trending popular rail more also archive tags categories recent teaser".split()),
    "ad": frozenset("ad ads advert adverts advertisement sponsored sponsor promo promotion promoted adsense dfp outbrain taboola affiliate".split()),
    "notice": frozenset("cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup alert message privacy paywall login disclaimer".split()),
    "talk": frozenset("comment comments commentlist respond reply replies discussion disqus thread feedback reviews review reader".split()),
    "share": frozenset("share sharing social follow author byline meta date print tools rating".split()),
}
_GROUP = {t: i for i, group in enumerate(WORDS.values()) for t in group}
_PLACE = {t: i for i, t in enumerate(TAGS)}
HASHED = 16
N_ATTR = len(WORDS) + HASHED


@functools.lru_cache(10_000)
def _tokens(attrs: str) -> tuple[int, ...]:
    """Feature places of the class, id and role tokens."""
    found = set()
    for m in _ATTR.finditer(attrs):
        for t in _TOKEN.findall(_HUMP.sub(" ", next(g for g in m.groups() if g is not None)).lower()):
            found.add(_GROUP[t] if t in _GROUP else len(WORDS) + xxhash.xxh32_intdigest(t) % HASHED)
    return tuple(sorted(found))


class Page:
    """Nodes in page order: tag, parent, attribute places, own text, and own link characters."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attrs, self.text, self.linked = ["html"], [-1], [()], [""], [0]
        self._read(source)

    def _node(self, tag: str, parent: int, attrs: tuple = ()) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.attrs.append(attrs)
        self.text.append("")
        self.linked.append(0)
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        open_, at, size = [0], 0, len(source)
        link, runs, links = 0, [], 0

        def flush() -> None:
            nonlocal runs, links
            if runs:
                text = " ".join(entities.unescape("".join(runs)).split())
                if text:
                    i = self._node("#text", open_[-1])
                    self.text[i], self.linked[i] = text, links
                runs, links = [], 0

        while at < size:
            m = _TAG.search(source, at)
            cut = m.start() if m else size
            if cut > at:
                runs.append(source[at:cut])
                links += (cut - at) * (link > 0)
            if not m:
                break
            at = m.end()
            if m.group("note") is not None:
                stop = source.find("-->", m.end() - 2 if source.startswith(">", m.end()) else m.end())
                at = size if stop < 0 else stop + 3
                continue
            name = m.group("name")
            if name is None:
                continue
            name = name.lower()
            if m.group("end"):
                if name == "a":
                    link = 0
                elif name == "p":
                    flush()
                    self._close(open_, {"p"}, {"td", "th", "table"})
                elif name in BLOCK:
                    for k in range(len(open_) - 1, 0, -1):
                        if self.tag[open_[k]] == name:
                            flush()
                            del open_[k:]
                            break
            elif name in RAW:
                if not m.group("attrs").endswith("/"):
                    stop = re.compile(f"</{name}[\\s/>]", re.I).search(source, at)
                    if name == "head" and not stop:
                        stop = re.compile(r"<body[\s>]", re.I).search(source, at)
                        at = stop.start() if stop else at
                    else:
                        at = source.find(">", stop.start()) + 1 if stop else size
                        at = at or size
                runs.append(" ")
            elif name == "a":
                link = 1
            elif name in ("html", "body"):
                if name == "body" and len(open_) == 1:
                    flush()
                    open_.append(self._node(name, 0, _tokens(m.group("attrs"))))
            elif name == "br":
                runs.append(" ")
            elif name in BLOCK:
                flush()
                if name in CLOSES_P:
                    self._close(open_, {"p"}, {"td", "th", "table"})
                if name in CLOSES:
                    self._close(open_, *CLOSES[name])
                if name[0] == "h" and name[1:].isdigit() and self.tag[open_[-1]][0] == "h" and self.tag[open_[-1]][1:].isdigit():
                    open_.pop()
                i = self._node(name, open_[-1], _tokens(m.group("attrs")) if m.group("attrs") else ())
                if name not in VOID:
                    open_.append(i)
                    link = 0
        flush()

    def _close(self, open_: list[int], names: set, stops: set) -> None:
        for k in range(len(open_) - 1, 0, -1):
            tag = self.tag[open_[k]]
            if tag in names:
                last = k
                while last > 1 and self.tag[open_[last - 1]] in names:
                    last -= 1
                del open_[last:]
                return
            if tag in stops:
                return

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = np.array(self.parent)
        own = np.fromiter(map(len, self.text), np.int64, n)
        chars, links, nodes, paras = own.astype(float), np.array(self.linked, float), np.ones(n), np.fromiter((t == "p" for t in self.tag), float, n)
        marks = np.fromiter((t.count(",") + t.count(".") for t in self.text), float, n)
        kids, rank, depth = np.zeros(n), np.zeros(n), np.zeros(n)
        for i in range(1, n):
            p = parent[i]
            rank[i] = kids[p]
            kids[p] += 1
            depth[i] = depth[p] + 1
        for i in range(n - 1, 0, -1):
            p = parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            nodes[p] += nodes[i]
            paras[p] += paras[i]
            marks[p] += marks[i]
        tags = np.zeros((n, len(TAGS)), np.float32)
        attrs = np.zeros((n, N_ATTR), np.float32)
        for i, (t, a) in enumerate(zip(self.tag, self.attrs, strict=True)):
            k = _PLACE.get(t)
            if k is not None:
                tags[i, k] = 1
            for j in a:
                attrs[i, j] = 1
        up_tag, up_attr = tags.copy(), attrs[:, : len(WORDS)].copy()
        for i in range(1, n):  # what encloses the node, itself included
            up_tag[i] = np.maximum(up_tag[i], up_tag[parent[i]])
            up_attr[i] = np.maximum(up_attr[i], up_attr[parent[i]])
        up = np.maximum(parent, 0)
        total = max(chars[0], 1)
        scalars = (np.log1p(chars), chars / total, links / np.maximum(chars, 1), chars / nodes, marks / np.maximum(chars, 1) * 100, np.minimum(depth, 20), np.log1p(kids), kids[up], rank / np.maximum(kids[up], 1), paras / nodes, chars / np.maximum(chars[up], 1), links[up] / np.maximum(chars[up], 1), np.log1p(paras[up]), np.arange(n) / n)
        return np.hstack([np.array(scalars, np.float32).T, attrs, up_tag, up_attr])

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """The consistent choice with the largest sum of log-odds of what is kept."""
        n, gain = len(odds), odds.astype(float).copy()
        for i in range(n - 1, 0, -1):
            if gain[i] > 0:
                gain[self.parent[i]] += gain[i]
        keep = np.zeros(n, bool)
        keep[0] = True
        for i in range(1, n):
            keep[i] = keep[self.parent[i]] and gain[i] > 0
        return keep

    def main_text(self, keep: np.ndarray) -> str:
        return "\n".join(t for t, k in zip(self.text, keep, strict=True) if k and t)


class BoostedTrees:
    """Depth-limited regression trees on binned features, boosted on the logistic loss."""

    def __init__(self, depth: int = 4, rounds: int = 40, rate: float = 0.3, penalty: float = 1.0):
        self.depth, self.rounds, self.rate, self.penalty = depth, rounds, rate, penalty
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 25)[1:-1])) if len(np.unique(c)) > 2 else np.array([0.5]) for c in x.T]
        bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
        width, (n, m) = 25, bins.shape
        flat = bins + np.arange(m) * width
        z = np.zeros(n)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p) + 1e-6
            feature, cut, leaf, node = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf), np.zeros(2**self.depth), np.zeros(n, int)
            for k in range(2**self.depth - 1):
                rows = np.flatnonzero(node == k)
                if len(rows) >= 8:
                    spots = flat[rows].ravel()
                    sg = np.bincount(spots, np.repeat(g[rows], m), m * width).reshape(m, width).cumsum(1)
                    sh = np.bincount(spots, np.repeat(h[rows], m), m * width).reshape(m, width).cumsum(1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + self.penalty) + (tg - sg) ** 2 / (th - sh + self.penalty) - tg**2 / (th + self.penalty)
                    for f in range(m):
                        gain[f, len(cuts[f]) :] = -1
                    f, b = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[f, b] > 1e-3:
                        feature[k], cut[k] = f, cuts[f][b]
                node[rows] = 2 * k + 1 + (x[rows, feature[k]] > cut[k])
            node -= 2**self.depth - 1
            sg, sh = np.bincount(node, g, 2**self.depth), np.bincount(node, h, 2**self.depth)
            leaf = self.rate * sg / (sh + self.penalty)
            z += leaf[node]
            self.trees.append((feature, cut, leaf))
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def sample_page(rng: np.random.Generator) -> tuple[str, str]:
    """A generated page and its main text, for training and tests."""
    letters = np.array(list("etaoinshrdlucmfwygpbvk"))

    def words(n: int) -> str:
        out = ["".join(rng.choice(letters, rng.integers(2, 10))) for _ in range(max(1, n))]
        for k in range(0, len(out), int(rng.integers(6, 14))):
            out[k] = out[k].title()
            if k:
                out[k - 1] += "."
        return " ".join(out) + rng.choice([".", "", "!!", "?"])

    def pick(*options):
        return options[rng.integers(len(options))]

    def chance(p: float) -> bool:
        return rng.random() < p

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{words(int(rng.integers(1, 4)))}</a></li>' for k in range(n))

    def attr(*names: str) -> str:
        return f'{pick("class", "id")}="{pick("", "c12 ", "box ", "l-")}{pick(*names)}{pick("", "-wrap", "_inner", " x9")}"'

    parts: list[str] = []
    kept: list[str] = []

    def say(n: int) -> str:
        text = words(n)
        kept.append(text)
        return text

    def paragraph() -> str:
        n = int(rng.choice([2, 6, 25, 60, 120]))
        text = say(n)
        k = rng.random()
        if k < 0.15 and " " in text:
            a, b = text.split(" ", 1)
            return f'<p>{a} <a href="#">{b}</a></p>' if len(b) < 40 else f"<p><b>{a}</b> {b}</p>"
        if k < 0.3:
            return f"<p><b>{text}<br>"
        return f"<p>{text}{pick('</p>', '</p>', '')}"

    def article() -> str:
        body = [f"<h1>{say(int(rng.integers(2, 12)))}</h1>"] if chance(0.9) else []
        for _ in range(int(rng.integers(1, 9))):
            k = rng.random()
            if k < 0.72:
                body.append(paragraph())
            elif k < 0.8:
                body.append(f"<h2>{say(int(rng.integers(2, 8)))}</h2>")
            elif k < 0.87:
                body.append("<ul>" + "".join(f"<li>{say(int(rng.integers(2, 20)))}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>")
            elif k < 0.92:
                body.append(f"<blockquote><p>{say(20)}</p></blockquote>")
            elif k < 0.96:
                body.append("<table>" + "".join("<tr>" + "".join(f"<td>{say(2)}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            else:
                body.append(f"<pre>{say(12)}</pre>")
            if chance(0.08):
                body.append(f'<div {attr("ad", "ads", "advert", "sponsored", "promo")}>{words(int(rng.integers(3, 40)))}</div>')
        inner = "".join(body)
        k = rng.random()
        if k < 0.6:
            return f"<article>{inner}</article>"
        if k < 0.7:
            return f'<article {attr("post", "entry", "story")}><div {attr("content", "body", "text")}>{inner}</div></article>'
        if k < 0.8:
            return f"<main>{inner}</main>"
        return f'<div {attr("content", "main", "article", "post", "entry")}>{inner}</div>'

    def noise() -> str:
        long = words(int(rng.choice([4, 12, 30, 80])))
        return pick(
            lambda: f'<div {attr("ad", "ads", "advert", "sponsored", "advertisement")}>{pick(long, f"<p>{long}</p>")}</div>',
            lambda: f"<aside>{pick('', '<h3>' + words(2) + '</h3>')}{pick(f'<p>{long}</p>', '<ul>' + links(4) + '</ul>', long)}</aside>",
            lambda: f'<div {attr("sidebar", "related", "widget", "recommended")}><h3>{words(2)}</h3><ul>{links(5)}</ul></div>',
            lambda: f'<div {attr("cookie", "consent", "notice", "newsletter", "popup")}><p>{long}</p><button>{words(1)}</button></div>',
            lambda: f'<form action="/s"><label>{words(2)}</label><input name="q"><p>{long}</p></form>',
            lambda: f'<section {attr("comments", "comment", "discussion", "replies")}><h2>{words(2)}</h2>' + "".join(f'<div {attr("comment", "reply")}><p>{words(int(rng.choice([5, 30, 80])))}</p></div>' for _ in range(int(rng.integers(1, 5)))) + "</section>",
            lambda: f'<div {attr("comments", "commentlist", "reader-comments")}>' + "".join(f"<p>{words(int(rng.choice([5, 30, 80])))}</p>" for _ in range(int(rng.integers(1, 5)))) + "</div>",
            lambda: f'<ol {attr("comments", "commentlist")}>' + "".join(f"<li><p>{words(25)}</p></li>" for _ in range(3)) + "</ol>",
            lambda: f'<div {attr("share", "social", "author", "byline", "meta")}>{words(4)}</div>',
            lambda: f'<div {attr("menu", "breadcrumb", "pagination", "navbar")}>{links(4)}</div>',
            lambda: f'<div role="{pick("navigation", "banner", "complementary", "contentinfo", "search", "alert", "dialog")}">{long}</div>',
        )()

    top = [lambda: f"<nav><ul>{links(int(rng.integers(3, 9)))}</ul></nav>", lambda: f"<header>{pick('<h1>' + words(2) + '</h1>', words(5), '<p>' + words(12) + '</p>')}{pick('', '<nav>' + links(3) + '</nav>')}</header>"]
    for make in top:
        if chance(0.7):
            parts.append(make())
    for _ in range(int(rng.integers(0, 4))):
        parts.append(noise())
    middle = article()
    if chance(0.2):
        middle = f'<div {attr("wrapper", "container", "page", "layout")}>{middle}{noise() if chance(0.6) else ""}</div>'
    parts.append(middle)
    for _ in range(int(rng.integers(0, 4))):
        parts.append(noise())
    if chance(0.8):
        inner = pick(f"&copy; x.example.com &middot; {words(6)}", f"<p>{words(10)}</p><ul>{links(3)}</ul>")
        parts.append(pick(f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f'<div {attr("footer", "copyright", "legal")}>{inner}</div>'))
    page = f"<!DOCTYPE html><html><head><title>{words(5)}</title><script>var a='<p>';</script></head><body>{''.join(parts)}"
    return page + ("</body></html>" if chance(0.8) else ""), "\n".join(" ".join(t.split()) for t in kept)


@functools.lru_cache(4)
def fitted(pages: int = 300, seed: int = 7) -> BoostedTrees:
    """Trees trained on generated pages; a node is wanted if any text below it is main text."""
    rng, xs, ys = np.random.default_rng(seed), [], []
    for _ in range(pages):
        source, main = sample_page(rng)
        page, wanted = Page(source), set(main.split("\n"))
        y = np.fromiter((t in wanted for t in page.text), float, len(page.text))
        for i in range(len(y) - 1, 0, -1):
            y[page.parent[i]] = max(y[page.parent[i]], y[i])
        xs.append(page.features())
        ys.append(y)
    return BoostedTrees().fit(np.vstack(xs), np.concatenate(ys))


def extract(sources: list[str | None], model: BoostedTrees) -> list[str]:
    pages = [Page(s or "") for s in sources]
    odds = model.odds(np.vstack([p.features() for p in pages])) if pages else np.empty(0)
    out, at = [], 0
    for p in pages:
        out.append(p.main_text(p.decode(odds[at : at + len(p.tag)])))
        at += len(p.tag)
    return out


def main_texts(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    bound_batches(spark)
    model = spark.sparkContext.broadcast(fitted())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                texts = extract(part.column(2).to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(released(run), "page_id long, url string, text string, n_chars long")
