"""Main-text extraction by a recurrent block labeller.

A page becomes its sequence of leaf blocks (text between block-level tags),
each with hashed tag-path and hashed-word vectors.  A bidirectional LSTM in
numpy reads the whole sequence and labels every block as article or not, so a
block is judged in the context of the document.

The labeller is trained here, on pages composed from the blocks of a bounded
sample: article blocks (by the tags of their page) are put into varied
containers among menus, notices, adverts, forms, sidebars and reader comments.
Of a long page a training step sees a run of blocks that starts anywhere.
"""

import html
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .shingles import word_hashes

SAMPLE_PAGES = 300
SAMPLE_PAGE_CHARS = 100_000     # longer pages are extracted whole, but train nothing
RUN_BLOCKS, RUN_ARTICLE = 90, 60     # blocks of one training page, of one article
STEPS, BATCH, HIDDEN = 260, 24, 16
PATH_DIM, WORD_DIM, EXTRA = 48, 16, 8
WIDTH = PATH_DIM + WORD_DIM + EXTRA

BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
                       "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
HIDDEN_TAGS = frozenset("script style head title noscript template iframe svg object textarea".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</?([a-zA-Z][\w:-]*)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^<>])*+)>?", re.S)
ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")

# tags and attribute words that mark other parts than the article, for the training labels only
OTHER = frozenset("nav footer aside form header menu sidebar ad ads advert banner cookie notice comment comments reply share social related promo breadcrumb login subscribe".split())
ARTICLE = frozenset("article main".split())
ARTICLE_WORDS = frozenset(".article .post .content .entry .main".split())     # on pages without such a tag


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[str, ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in page order: white space inside a block is one
    space, character references are decoded, empty blocks are left out."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    state = {"link": 0, "linked": 0}

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            path = tuple(x for _, names in stack for x in names)
            out.append(Block(text, path, state["linked"]))
        parts.clear()
        state["linked"] = 0

    def add(text: str) -> None:
        parts.append(text)
        if state["link"]:
            state["linked"] += len(text)

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            tail = page[at:]
            cut = tail.rfind("<")     # a tag cut off by the end of the page is markup
            add(tail[:cut] if cut >= 0 and re.match(r"</?[a-zA-Z!]", tail[cut:]) else tail)
            break
        add(page[at:m.start()])
        at = m.end()
        tag = m.group(1)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(0).startswith("</"):
            if tag == "a":
                state["link"] = 0
            if tag in BLOCK_TAGS:
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            continue
        if tag in HIDDEN_TAGS:
            if not m.group(0).endswith("/>"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if tag == "head" and not end:
                    end = re.compile(r"<body", re.I).search(page, at)
                    at = end.start() if end else n
                else:
                    at = end.end() if end else n
            continue
        if tag == "br":
            add(" ")
        elif tag == "a":
            state["link"] = 1
        elif tag in BLOCK_TAGS:
            flush()
            if tag == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            if tag == "li":
                while stack and stack[-1][0] in ("li", "p"):
                    stack.pop()
            if tag not in VOID_TAGS:
                words = [w for g in ATTRIBUTE.findall(m.group(2) or "") for w in WORD.findall("".join(g).lower())]
                stack.append((tag, (tag, *["." + w for w in words])))
    flush()
    return out


def vectors(pages: list[list[Block]]) -> list[np.ndarray]:
    """One (blocks x WIDTH) array per page."""
    flat = [b for p in pages for b in p]
    x = np.zeros((len(flat), WIDTH), np.float32)
    if flat:
        raw = [b.text.encode("utf-8", "replace") for b in flat]
        offsets = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) for r in raw], out=offsets[1:])
        h, counts = word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets)
        where = np.repeat(np.arange(len(flat)), counts) * WORD_DIM + (h % np.uint64(WORD_DIM)).astype(np.int64)
        words = np.bincount(where, minlength=len(flat) * WORD_DIM).reshape(len(flat), WORD_DIM)
        x[:, PATH_DIM:PATH_DIM + WORD_DIM] = words / np.sqrt(np.maximum(1, counts))[:, None] * 0.3
        seen: dict[tuple[str, ...], np.ndarray] = {}
        for k, b in enumerate(flat):
            v = seen.get(b.path)
            if v is None:
                v = np.zeros(PATH_DIM, np.float32)
                for depth, name in enumerate(b.path):
                    c = zlib.crc32(name.encode())
                    v[c % PATH_DIM] += 1.0 if (c >> 16) & 1 else -1.0
                    if depth >= len(b.path) - 2:
                        c = zlib.crc32(("leaf " + name).encode())
                        v[c % PATH_DIM] += 0.7 if (c >> 16) & 1 else -0.7
                v = np.clip(v, -3, 3)
                seen[b.path] = v
            x[k, :PATH_DIM] = v
            n = len(b.text)
            x[k, PATH_DIM + WORD_DIM:] = (math.log1p(n) / 4 - 1, min(1.0, b.linked / n), sum(b.text.count(c) for c in ".,;!?") / n * 10,
                                          float(b.text[-1] in ".!?"), float(n > 80), float("©" in b.text), float(len(b.path) > 4), 1.0)
    out, at = [], 0
    for p in pages:
        out.append(x[at:at + len(p)])
        at += len(p)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output per block."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in ("f", "b"):
            self.p["W" + d] = (rng.normal(size=(WIDTH + HIDDEN, 4 * HIDDEN)) / math.sqrt(WIDTH + HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN:2 * HIDDEN] = 1.0
            self.p["B" + d] = bias
        self.p["O"] = (rng.normal(size=(2 * HIDDEN + WIDTH,)) * 0.1).astype(np.float32)
        self.p["o"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        t, n, _ = x.shape
        w, b = self.p["W" + d], self.p["B" + d]
        pre = x @ w[:WIDTH] + b
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((t, n, HIDDEN), np.float32)
        for k in (range(t) if d == "f" else range(t - 1, -1, -1)):
            z = pre[k] + h @ w[WIDTH:]
            i, f, o = (_sigmoid(z[:, s * HIDDEN:(s + 1) * HIDDEN]) for s in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[k][:, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if trace is not None:
                trace.append((k, h, c, i, f, o, g, tc))
            h, c = np.where(m, o * tc, h), np.where(m, c2, c)
            out[k] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        hf, hb = self._run(x, mask, "f"), self._run(x, mask, "b")
        o = self.p["O"]
        return hf @ o[:HIDDEN] + hb @ o[HIDDEN:2 * HIDDEN] + x @ o[2 * HIDDEN:] + self.p["o"]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean logistic loss by back-propagation through time."""
        traces = {"f": [], "b": []}
        h = {d: self._run(x, mask, d, traces[d]) for d in "fb"}
        o = self.p["O"]
        z = h["f"] @ o[:HIDDEN] + h["b"] @ o[HIDDEN:2 * HIDDEN] + x @ o[2 * HIDDEN:] + self.p["o"]
        dz = np.where(mask, _sigmoid(z) - y, 0).astype(np.float32) / max(1, mask.sum())
        grad = {"O": np.concatenate([np.einsum("tn,tnh->h", dz, h["f"]), np.einsum("tn,tnh->h", dz, h["b"]), np.einsum("tn,tnh->h", dz, x)]),
                "o": np.array([dz.sum()], np.float32)}
        for s, d in enumerate("fb"):
            w = self.p["W" + d]
            gw = np.zeros_like(w)
            dpre = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh, dc = np.zeros(h[d].shape[1:], np.float32), np.zeros(h[d].shape[1:], np.float32)
            out_w = o[s * HIDDEN:(s + 1) * HIDDEN]
            for k, h0, c0, i, f, g_o, g, tc in reversed(traces[d]):
                m = mask[k][:, None]
                dh = dh + dz[k][:, None] * out_w
                dcell = np.where(m, dc + dh * g_o * (1 - tc * tc), 0)
                dzk = np.concatenate([dcell * g * i * (1 - i), dcell * c0 * f * (1 - f), np.where(m, dh * tc, 0) * g_o * (1 - g_o), dcell * i * (1 - g * g)], 1)
                dpre[k] = dzk
                gw[WIDTH:] += h0.T @ dzk
                dh = np.where(m, 0, dh) + dzk @ w[WIDTH:].T
                dc = np.where(m, dcell * f, dc)
            gw[:WIDTH] = np.einsum("tnd,tng->dg", x, dpre, optimize=True)
            grad["W" + d], grad["B" + d] = gw, dpre.sum((0, 1))
        return grad

    def label(self, pages: list[np.ndarray], cells: int = 60_000) -> list[np.ndarray]:
        """Probability of article per block of each page, in batches of pages
        of like length.  A batch padded to its longest page has at most
        ``cells`` blocks, unless it is a single page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            size = 1
            while size < min(256, len(order)) and (size + 1) * len(pages[order[size]]) <= cells:
                size += 1
            part, order = order[:size], order[size:]
            x, mask = pad([pages[k] for k in part])
            p = _sigmoid(self.logits(x, mask))
            for j, k in enumerate(part):
                out[k] = p[:len(pages[k]), j]
        return out


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(p) for p in pages)
    x, mask = np.zeros((t, len(pages), WIDTH), np.float32), np.zeros((t, len(pages)), bool)
    for k, p in enumerate(pages):
        x[:len(p), k], mask[:len(p), k] = p, True
    return x, mask


LEAVES = (("h2",), ("h3",), ("ul", "li"), ("ol", "li"), ("blockquote",), ("blockquote", "p"), ("pre",), ("table", "tr", "td"), ("figure", "figcaption"), ("div",), ())
CONTAINERS = (("article",), ("main",), ("main", "article"), ("div", ".content", "article"), ("div", ".post"), ("div", ".article", ".body"), ("section", ".content"), ("div", ".entry", ".content"))
BEFORE = (("nav", "ul", "li"), ("header", "div", ".logo"), ("header", "nav", "ul", "li"), ("div", ".menu", "ul", "li"), ("div", ".breadcrumb"), ("div", ".ad"), ("div", ".cookie", ".notice"), ("div", ".banner"))
AFTER = (("aside", "p"), ("aside", "div", ".related", "ul", "li"), ("div", ".sidebar", "p"), ("div", ".ad"), ("form", "div"), ("form", "p"), ("section", ".comments", "div", ".comment", "p"), ("div", ".comments", "div", ".comment"),
         ("div", ".comments", "p"), ("footer",), ("footer", "p"), ("div", ".footer", "p"), ("div", ".share", "ul", "li"), ("div", ".newsletter", ".subscribe", "p"))


def compose(rng: np.random.Generator, article: list[Block], others: list[Block], outer: tuple[str, ...]) -> tuple[list[Block], list[int]]:
    """A training page: article blocks in one container among other parts."""
    page: list[Block] = []
    y: list[int] = []

    def part(kinds, count, chance):
        for _ in range(count):
            if others and rng.random() < chance:
                path = kinds[rng.integers(len(kinds))]
                for _ in range(int(rng.integers(1, 5))):
                    b = others[rng.integers(len(others))] if rng.random() < 0.6 or not article else article[rng.integers(len(article))]
                    menu = "li" in path
                    page.append(Block(b.text[:40] if menu else b.text, outer + path, len(b.text) if menu else 0))
                    y.append(0)

    part(BEFORE, 4, 0.6)
    container = outer + CONTAINERS[rng.integers(len(CONTAINERS))]
    inside = rng.random() < 0.5
    for k, b in enumerate(article):
        leaf = ("h1",) if k == 0 and rng.random() < 0.7 else LEAVES[rng.integers(len(LEAVES))] if rng.random() < 0.3 else ("p",)
        page.append(Block(b.text[:int(rng.integers(8, 60))] if leaf[-1:] in (("h2",), ("li",), ("td",)) and rng.random() < 0.7 else b.text, container + leaf, b.linked))
        y.append(1)
        if inside and others and rng.random() < 0.06:
            o = others[rng.integers(len(others))]
            page.append(Block(o.text, container + (("div", ".ad") if rng.random() < 0.6 else ("aside",)), 0))
            y.append(0)
    part(AFTER, 5, 0.6)
    return page, y


def _inside(path: tuple[str, ...], marks: frozenset[str]) -> bool:
    """Whether a path goes through one of ``marks`` and then no other part."""
    first = next((k for k, x in enumerate(path) if x in marks), None)
    return first is not None and not any(x.lstrip(".") in OTHER for x in path[first:])


def _run(rng: np.random.Generator, items: list, most: int) -> list:
    """The items, or a run of ``most`` of them that starts anywhere."""
    if len(items) <= most:
        return items
    at = int(rng.integers(len(items) - most + 1))
    return items[at:at + most]


def train(samples: list[str]) -> Labeller:
    """Fit on composed and given pages (labels of given pages by their tags).

    A page without an article or main tag is not given, since what is its text
    is not known: only its blocks that a class, role or tag names as article or
    as another part serve composed pages."""
    rng = np.random.default_rng(17)
    given, others, articles = [], [], []
    for s in samples:
        b = blocks(s)
        tagged = any(x in ARTICLE for k in b for x in k.path)
        y = [int(_inside(k.path, ARTICLE if tagged else ARTICLE_WORDS)) for k in b]
        if tagged:
            given.append((b, y))
        others += [k for k, v in zip(b, y) if not v and (tagged or any(x.lstrip(".") in OTHER for x in k.path))]
        articles.append(_run(rng, [k for k, v in zip(b, y) if v], RUN_ARTICLE))
    model = Labeller()
    others = others or [Block(x, (), 0) for x in ("Home", "About us", "Log in", "We use cookies.", "Read more", "Subscribe to our letter", "I liked this very much, thank you.")]
    articles = [a for a in articles if a] or [[Block("Some words of an article stand here, in one sentence.", ("article", "p"), 0)]]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    for step in range(1, STEPS + 1):
        pages, ys = [], []
        long = step % 8 == 0      # now and then a few long pages, so that the state holds over many blocks
        for _ in range(3 if long else BATCH):
            if long:
                a = articles[rng.integers(len(articles))]
                b, y = compose(rng, a * (int(rng.integers(150, 450)) // len(a) + 1), others, (("html", "body"), ())[rng.integers(2)])
            elif given and rng.random() < 0.4:
                run = _run(rng, list(zip(*given[rng.integers(len(given))])), RUN_BLOCKS)
                b, y = [k for k, _ in run], [v for _, v in run]
            else:
                b, y = compose(rng, articles[rng.integers(len(articles))], others, (("html", "body"), ("html", "body", "div", ".page"), ("html", "body", "div", ".wrapper"), ())[rng.integers(4)])
            pages.append(b)
            ys.append(np.array(y, np.float32))
        x, mask = pad(vectors(pages))
        y = np.zeros(mask.shape, np.float32)
        for k, v in enumerate(ys):
            y[:len(v), k] = v
        rate = 0.02 * min(1.0, 1.3 - step / STEPS)
        for k, g in model.gradient(x, mask, y).items():
            a, v = moment[k]
            g = np.clip(g, -1, 1)
            a[:] = 0.9 * a + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            model.p[k] -= (rate * (a / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return model


def fit(pages: DataFrame, html_col: str = "html") -> Labeller:
    """Train on about SAMPLE_PAGES pages of less than SAMPLE_PAGE_CHARS
    characters, drawn by hash (at most twice as many)."""
    rows = pages.select(F.col(html_col).alias("html")).where("html is not null")
    n = rows.count()
    share = min(1.0, SAMPLE_PAGES / max(1, n))
    drawn = rows.where(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).where(F.length("html") < SAMPLE_PAGE_CHARS)
    got = drawn.withColumn("h", F.xxhash64("html")).orderBy("h").limit(2 * SAMPLE_PAGES).select("html").collect()
    return train([r["html"] for r in got])


def extract(pages: DataFrame, model: Labeller, keep: list[str] | None = None, html_col: str = "html") -> DataFrame:
    """keep (all columns by default), text and n_blocks: the article blocks in
    page order joined by newlines.  Null and empty pages and pages without
    text give an empty text; a page of any length is read whole; repeated rows
    give equal texts; an empty table gives no rows.  Kept columns named ``text``
    or ``n_blocks`` make way for the result's."""
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_blocks")]
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<text: string, n_blocks: long>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for page in series:
            out, n = [], []
            for at in range(0, len(page), 256):
                found = [blocks(p) for p in page[at:at + 256]]
                for b, p in zip(found, shared.value.label(vectors(found))):
                    out.append("\n".join(k.text for k, v in zip(b, p) if v >= 0.5))
                    n.append(len(b))
            yield pd.DataFrame({"text": out, "n_blocks": n})

    got = pages.select(*keep, run(F.col(html_col)).alias("__extract"))
    return got.select(*keep, F.col("__extract.text").alias("text"), F.col("__extract.n_blocks").alias("n_blocks"))
