"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags. A block has a vector of hashed
tag-path parts (tags, classes, ids and roles of its ancestors), of hashed words and of a few numbers. A bidirectional
LSTM reads the vectors of all blocks of the page, so each label depends on the whole page, and labels every block as
main text or not.

The network is trained here with numpy, on a bounded sample of at most `most` pages in expectation, picked by a hash of
the page, copies once. Labels come from the markup of pages where it is explicit, the others teach nothing; and from
pages put together anew, whose labels are known from how they were made: the sample's main blocks and other blocks are
set into furniture of many kinds (menus, headers, side bars, notices, adverts, forms, comments) and into containers
without a name. Half of all pages are disguised before they are learned: their class words are dropped or replaced by
random ones, some lose their sectioning tags too, so the network has to read words, shapes and neighbours. Comments, which
only their container tells from an article, aren't labelled there.

Null and empty pages have no blocks and an empty text. Scripts, styles and comments of the markup are never blocks, nor
are templates, frames, noscript parts, titles and text fields; words of drawings, formulas and objects are.
Every row has one result, repeated rows and rows with a null key too. An empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import textkit

PATH, WORDS, SHAPE = 96, 32, 8
WIDTH = PATH + WORDS + SHAPE
HIDDEN = 16

#: Comments, elements whose content isn't markup, and tags with quoted attributes.
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?!title\b[^>]*/>)(script|style|noscript|template|iframe|title|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)"""
    r"""|<[!?][^>]*>|</?[a-zA-Z][^<>"']*(?:"[^"]*"[^<>"']*|'[^']*'[^<>"']*)*>""",
    re.DOTALL | re.IGNORECASE,
)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9-]*)")
MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
PART = re.compile(r"[a-z]+|[0-9]+")
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Drawings, formulas and embedded objects stand in a line of text; their words are words of the block around them.
INLINE |= set("svg g defs use symbol path circle ellipse line rect polygon polyline text tspan textpath desc lineargradient radialgradient stop clippath mask title object".split())
INLINE |= set("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mtable mtr mtd semantics annotation".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the first ends an open one of these.
CLOSES = {
    "p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"),
    "th": ("td", "th", "p"), "option": ("option",), "h1": ("p",), "h2": ("p",), "h3": ("p",), "h4": ("p",), "div": ("p",), "ul": ("p",), "ol": ("p",),
    "section": ("p",), "article": ("p",), "aside": ("p",), "nav": ("p",), "footer": ("p",), "header": ("p",), "form": ("p",), "table": ("p",),
    "blockquote": ("p",), "main": ("p",), "pre": ("p",), "body": ("head",),
}
SCOPE = set("ul ol table tr td th div section article aside nav main body form blockquote".split())

# Words of the teacher: containers of main text, and of what surrounds it.
MAIN = set("article main content post entry story body text".split())
AROUND = set(
    "ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion nav navigation menu navbar breadcrumb breadcrumbs header masthead topbar "
    "footer bottom copyright sidebar side aside widget related recommended more notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe "
    "subscription signup login form search share social comments comment reply replies discussion responses disqus pagination pager tags toc skip legal".split()
)
SECTIONS = {
    "nav": ["<nav{}><ul>{}</ul></nav>", "<div class=\"menu\"{}><ul>{}</ul></div>", "<ul class=\"navbar\"{}>{}</ul>", "<nav{}>{}</nav>", "<div id=\"breadcrumbs\"{}>{}</div>"],
    "header": ["<header{}>{}</header>", "<div id=\"header\"{}>{}</div>", "<div class=\"masthead\"{}>{}</div>", "<header role=\"banner\"{}>{}</header>"],
    "side": ["<aside{}>{}</aside>", "<div class=\"sidebar\"{}>{}</div>", "<div id=\"sidebar\" class=\"widget\"{}>{}</div>", "<section class=\"related\"{}>{}</section>", "<div class=\"related-posts\"{}>{}</div>"],
    "notice": ["<div class=\"cookie-notice\"{}>{}</div>", "<div id=\"consent\"{}>{}</div>", "<div class=\"notice\"{}>{}</div>", "<div role=\"alert\"{}>{}</div>", "<div class=\"popup modal\"{}>{}</div>", "<div class=\"cookie-banner\"{}>{}</div>"],
    "ad": ["<div class=\"ad\"{}>{}</div>", "<div class=\"advert\"{}>{}</div>", "<aside class=\"sponsored\"{}>{}</aside>", "<div id=\"ads\"{}>{}</div>", "<section class=\"promo\"{}>{}</section>"],
    "form": ["<form{}>{}</form>", "<form class=\"newsletter\"{}>{}</form>", "<div class=\"subscribe\"><form{}>{}</form></div>", "<form role=\"search\"{}>{}</form>"],
    "comments": ["<section class=\"comments\"{}>{}</section>", "<div id=\"comments\"{}>{}</div>", "<div class=\"comment-list\"{}>{}</div>", "<ol class=\"comments\"{}>{}</ol>", "<section id=\"discussion\" class=\"replies\"{}>{}</section>"],
    "footer": ["<footer{}>{}</footer>", "<div id=\"footer\"{}>{}</div>", "<div class=\"footer\"{}>{}</div>", "<footer role=\"contentinfo\"{}>{}</footer>"],
}
#: Containers that say nothing, for furniture and for main text.
for _kind, _forms in SECTIONS.items():
    if _kind != "comments":
        _forms += ["<div{}>{}</div>", "<table{}><tr><td>{}</td></tr></table>", "<div><div{}>{}</div></div>"]
SECTIONING = set("article main section nav aside header footer".split())
COMMENT_WORDS = set("comment comments reply replies discussion responses disqus".split())
#: Stands in a page that is put together before each piece of main text.
SIGN = "\ue000"
BODIES = [
    "<div>{}</div>", "<table><tr><td>{}</td></tr></table>", "<section>{}</section>", "<div><div>{}</div></div>",
    "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class=\"content\">{}</div>", "<div id=\"content\"><div class=\"post\">{}</div></div>",
    "<article class=\"post\">{}</article>", "<div class=\"article-body\">{}</div>", "<div id=\"main\">{}</div>", "<section class=\"entry-content\">{}</section>", "<div class=\"wrap\"><article>{}</article></div>",
]

Block = tuple[str, tuple[str, ...], float]


@lru_cache(maxsize=50_000)
def marks(tag: str) -> tuple[str, ...]:
    """Parts of a tag that describe it: its name and the words of its class, id and role."""
    name = NAME.match(tag)[1].lower()
    return (name, *(f".{w}" for m in MARK.finditer(tag) for w in PART.findall((m[2] or m[3] or m[4] or "").lower())))


def blocks(page: str) -> list[Block]:
    """Text, tag-path parts and share of linked text of each leaf block, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                path = tuple(part for name, parts in stack if name not in INLINE for part in parts)
                out.append((text, path, min(1.0, linked / len(text))))
            held.clear()
            linked = 0

    at = 0
    links = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        tag = m[0]
        if m[1] or tag[1] in "!?":
            if m[1] and m[1].lower() not in INLINE:
                held.append(" ")
            continue
        found = NAME.match(tag)
        if not found:
            continue
        name = found[1].lower()
        if tag[1] == "/":
            if name not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break
            links = sum(n == "a" for n, _ in stack)
            continue
        if name not in INLINE:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES.get(name, ()):
                    del stack[k:]
                    continue
                if stack[k][0] in SCOPE:
                    break
        if name not in VOID and not tag.endswith("/>"):
            stack.append((name, marks(tag)))
            links += name == "a"
        elif name in ("br", "wbr"):
            held.append(" " if name == "br" else "")
    if at < len(page):
        held.append(page[at:])
    flush()
    return out


@lru_cache(maxsize=100_000)
def path_vector(path: tuple[str, ...]) -> bytes:
    x = np.zeros(PATH, np.float32)
    for part in path:
        h = xxhash.xxh32_intdigest(part.encode())
        x[h % PATH] += 1.0
        x[(h >> 16) % PATH] += 0.5
    return np.tanh(x).tobytes()


def vectors(found: list[Block]) -> np.ndarray:
    """A row per block."""
    n = len(found)
    out = np.zeros((n, WIDTH), np.float32)
    if not n:
        return out
    out[:, :PATH] = np.frombuffer(b"".join(path_vector(b[1]) for b in found), np.float32).reshape(n, PATH)
    raw = [b[0].encode("utf-8", "replace") for b in found]
    at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    data = np.frombuffer(b"".join(raw), np.uint8)
    for i, j in textkit.steps(at):
        part, rel = textkit.LOWER[data[at[i] : at[j]]], at[i : j + 1] - at[i]
        first, last, doc = textkit.word_spans(part, rel)
        slot = (textkit.span_hashes(part, first, last) % np.uint64(WORDS)).astype(np.int64)
        hits = np.bincount(doc * WORDS + slot, minlength=(j - i) * WORDS).reshape(j - i, WORDS)
        words = np.maximum(1, hits.sum(axis=1))
        out[i:j, PATH : PATH + WORDS] = np.sqrt(hits / words[:, None])
        size = np.maximum(1, np.diff(rel))
        owner = np.repeat(np.arange(j - i), np.diff(rel))
        stops = np.bincount(owner, weights=np.isin(part, [46, 33, 63, 44]), minlength=j - i)
        digits = np.bincount(owner, weights=(part >= 48) & (part < 58), minlength=j - i)
        out[i:j, PATH + WORDS] = np.log1p(words) / 5
        out[i:j, PATH + WORDS + 1] = np.log1p(size) / 8
        out[i:j, PATH + WORDS + 2] = np.minimum(1, 10 * stops / size)
        out[i:j, PATH + WORDS + 3] = digits / size
    out[:, PATH + WORDS + 4] = [b[2] for b in found]
    out[:, PATH + WORDS + 5] = [len(b[1]) / 10 for b in found]
    out[:, PATH + WORDS + 7] = 1
    return out


def positioned(x: np.ndarray) -> np.ndarray:
    """Sets the block's relative place in its page."""
    x[:, PATH + WORDS + 6] = np.arange(len(x)) / max(1, len(x) - 1)
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


class Labeller:
    """Bidirectional LSTM and a logistic output, over batches of pages (pages, blocks, WIDTH)."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"wx{d}"] = rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, 4 * HIDDEN)).astype(np.float32)
            self.p[f"wh{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        self.p["out"] = rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)
        self.m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        self.step = 0

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states in reading order of direction d. Gates: input, forget, output, candidate."""
        n, t, _ = x.shape
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, t, HIDDEN), np.float32)
        wx, wh = self.p[f"wx{d}"], self.p[f"wh{d}"]
        ahead = (x.reshape(n * t, -1) @ wx).reshape(n, t, -1)
        trail = []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = ahead[:, k] + h @ wh
            gates = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            on = mask[:, k, None]
            new_c = (f * c + i * g) * on
            tc = np.tanh(new_c)
            if keep:
                trail.append((k, h, c, i, f, o, g, tc, on))
            h, c = o * tc * on, new_c
            out[:, k] = h
        return out, trail

    def output(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], axis=2)
        return states @ self.p["out"] + self.p["bias"][0]

    def learn(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, rate: float) -> float:
        """One Adam step of back-propagation through time; returns the mean logistic loss. A label of -1 is none."""
        n, t, _ = x.shape
        known = mask * (y >= 0)
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        states = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        z = states @ self.p["out"] + self.p["bias"][0]
        dz = (sigmoid(z) - y) * known / max(1, known.sum())
        grads = {"out": np.einsum("nth,nt->h", states, dz), "bias": np.array([dz.sum()], np.float32)}
        back = dz[:, :, None] * self.p["out"]
        for s, d in enumerate("fb"):
            into = back[:, :, s * HIDDEN : (s + 1) * HIDDEN]
            wh = self.p[f"wh{d}"]
            gwh = np.zeros_like(wh)
            dgates = np.zeros((n, t, 4 * HIDDEN), np.float32)
            dh = np.zeros((n, HIDDEN), np.float32)
            dc = np.zeros((n, HIDDEN), np.float32)
            for k, h, c, i, f, o, g, tc, on in reversed(runs[d][1]):
                dh = (dh + into[:, k]) * on
                dcc = (dc + dh * o * (1 - tc * tc)) * on
                dg = np.concatenate((dcc * g * i * (1 - i), dcc * c * f * (1 - f), dh * tc * o * (1 - o), dcc * i * (1 - g * g)), axis=1)
                dgates[:, k] = dg
                gwh += h.T @ dg
                dh, dc = dg @ wh.T, dcc * f
            grads[f"wh{d}"] = gwh
            grads[f"wx{d}"] = x.reshape(n * t, -1).T @ dgates.reshape(n * t, -1)
        self.step += 1
        for k, g in grads.items():
            m, v = self.m[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            self.p[k] -= (rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-7)).astype(np.float32)
        return float((np.logaddexp(0, z) - y * z)[known > 0].mean()) if known.any() else 0.0

    def label(self, pages: list[np.ndarray], size: int = 64) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        i = 0
        while i < len(order):
            width = len(pages[order[min(i + size, len(order)) - 1]])
            some = order[i : i + max(1, min(size, 100_000 // width))]
            x, mask = padded([pages[k] for k in some])
            z = self.output(x, mask)
            for row, k in enumerate(some):
                out[k] = z[row, : len(pages[k])] > 0
            i += len(some)
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(p) for p in pages)
    x = np.zeros((len(pages), longest, WIDTH), np.float32)
    mask = np.zeros((len(pages), longest), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)] = p
        mask[k, : len(p)] = 1
    return x, mask


def disguised(found: list[Block], y: np.ndarray, rng: random.Random) -> tuple[list[Block], np.ndarray]:
    """The blocks of a page, in half of all cases without telling class words; labels of comments are then taken back."""
    how, plain = rng.random(), rng.random() < 0.25
    if how >= 0.5:
        return found, y
    names: dict[str, str] = {}

    def part(p: str) -> str | None:
        if p.startswith("."):
            return None if how < 0.25 else names.setdefault(p, "." + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 7))))
        return "div" if plain and p in SECTIONING else p

    hidden = np.array([bool(COMMENT_WORDS & {p.lstrip(".") for p in b[1]}) for b in found], bool)
    return [(t, tuple(q for p in path if (q := part(p)) is not None), linked) for t, path, linked in found], np.where(hidden, -1, y).astype(np.float32)


def taught(path: tuple[str, ...]) -> bool:
    """The teacher's label: the path names a container of main text, and nothing around it."""
    words = {p.lstrip(".") for p in path}
    return bool(words & MAIN - {"body"}) and not words & AROUND


def remade(main: list[str], other: list[str], rng: random.Random) -> tuple[str, list[str]]:
    """A page put together from blocks, and the main blocks in it, each behind the sign."""

    def some(k: int) -> list[str]:
        return [html.escape(rng.choice(other)) for _ in range(k)]

    def section(kind: str) -> str:
        form = rng.choice(SECTIONS[kind])
        if kind == "nav":
            inner = "".join(f"<li><a href=\"/{k}\">{t[:30]}</a></li>" for k, t in enumerate(some(rng.randint(2, 6))))
        elif kind == "comments":
            wrap = rng.choice(["<p>{}</p>", "<div class=\"comment\"><p>{}</p></div>", "<li>{}</li>", "<article class=\"comment\"><h4>{}</h4></article>", "<div><b>a</b>: {}</div>"])
            inner = rng.choice(["", "<h3>Comments</h3>"]) + "".join(wrap.format(html.escape(rng.choice(main))) for _ in range(rng.randint(1, 4)))
        elif kind == "form":
            inner = f"<label>{some(1)[0][:20]}</label><input name=\"q\"><button>{some(1)[0][:12]}</button>" + "".join(f"<p>{t}</p>" for t in some(rng.randint(0, 1)))
        else:
            tag = rng.choice(["<p>{}</p>", "{}", "<h3>{}</h3>", "<a href=\"#\">{}</a><br>", "<div>{}</div>"])
            inner = "".join(tag.format(t) for t in some(rng.randint(1, 3)))
        return form.replace("{}", "", 1).replace("{}", inner)

    chosen = [rng.choice(main) for _ in range(rng.randint(1, 8))]
    body = [rng.choice(["<h1>{}</h1>", "<h2>{}</h2>", "<h1>{}</h1>"]).format(SIGN + html.escape(chosen[0]))]
    for t in chosen[1:]:
        body.append(rng.choice(["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<p><b>{}<br>"]).format(SIGN + html.escape(t)))
        if rng.random() < 0.08:
            body.append(section(rng.choice(["ad", "notice", "side", "form"])))
    text = rng.choice(BODIES).replace("{}", "".join(body) + (section("comments") if rng.random() < 0.1 else ""))
    before = [section(k) for k in ("notice", "header", "nav", "ad", "side", "form") if rng.random() < 0.4]
    after = [section(k) for k in ("comments", "side", "ad", "form", "notice", "nav", "footer") if rng.random() < 0.4]
    rng.shuffle(before)
    parts = [*before, text, *after]
    if rng.random() < 0.3:
        parts = ["<div class=\"page\">", *parts, "</div>"]
    return "<body>" + "".join(parts) + "</body>", [" ".join(t.split()) for t in chosen]


#: Blocks of a window of training; and of a batch, padding included, so that long pages are learned in few rows at a time.
WINDOW, BATCH = 2_000, 6_400


def batches(data: list[tuple[np.ndarray, np.ndarray]], size: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """data in runs of at most `size` pages and BATCH padded blocks; data is sorted by length, roughly."""
    out: list[list[tuple[np.ndarray, np.ndarray]]] = []
    longest = 0
    for d in data:
        longest = max(longest, len(d[0]))
        if not out or len(out[-1]) == size or longest * (len(out[-1]) + 1) > BATCH:
            out.append([])
            longest = len(d[0])
        out[-1].append(d)
    return out


def train(pages: list[str], rounds: int = 6, seed: int = 5, rate: float = 0.02, size: int = 32) -> Labeller:
    rng = random.Random(seed)
    data: list[tuple[np.ndarray, np.ndarray]] = []
    main, other = [], []

    def add(found: list[Block], y: np.ndarray) -> None:
        x = positioned(vectors(found))
        data.extend((x[k : k + WINDOW], y[k : k + WINDOW]) for k in range(0, len(y), WINDOW))

    for page in pages:
        found = blocks(page.replace(SIGN, " "))
        y = np.array([taught(b[1]) for b in found], np.float32)
        if not y.any():
            continue  # nothing here says where the main text is
        main += [b[0] for b, good in zip(found, y, strict=True) if good]
        other += [b[0] for b, good in zip(found, y, strict=True) if not good]
        add(*disguised(found, y, rng))
    if main and other:
        for _ in range(2 * len(pages)):
            signed = blocks(remade(main, other, rng)[0])
            y = np.array([SIGN in b[0] for b in signed], np.float32)
            add(*disguised([(b[0].replace(SIGN, ""), b[1], b[2]) for b in signed], y, rng))
    net = Labeller()
    for turn in range(rounds):
        rng.shuffle(data)
        data.sort(key=lambda d: len(d[0]) // 8)
        groups = batches(data, size)
        rng.shuffle(groups)
        for group in groups:
            x, mask = padded([d[0] for d in group])
            y = np.zeros(mask.shape, np.float32)
            for row, (_, label) in enumerate(group):
                y[row, : len(label)] = label
            net.learn(x, mask, y, rate * (0.5 if turn >= rounds // 2 else 1))
    return net


def fit(pages: DataFrame, page: str = "html", most: int = 400) -> Labeller:
    """A labeller for pages like these."""
    rows = pages.where(F.col(page).isNotNull()).select(F.col(page).alias("page"))
    n = rows.count()
    draw = F.xxhash64("page").bitwiseAND(0x7FFFFFFF) / float(1 << 31) < F.lit(min(1.0, most / max(1, n)))
    return train(sorted(r["page"] for r in rows.where(draw).distinct().collect()))  # `most` pages in expectation, copies once


def extract(pages: DataFrame, net: Labeller, key: str = "page_id", page: str = "html") -> DataFrame:
    """key, text: the main blocks in page order, joined by one space; one row per row of pages."""
    textkit.bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(p or "") for p in batch.column(1).to_pylist()]
            rows = vectors([b for f in found for b in f])
            at = np.cumsum([0, *map(len, found)])
            kept = net.label([positioned(rows[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)])
            text = [" ".join(b[0] for b, good in zip(f, k, strict=True) if good) for f, k in zip(found, kept, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["id", "text"])

    rows = pages.select(F.col(key).alias("id"), F.col(page).alias("page"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", key)
