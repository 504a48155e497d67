"""HTML extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks (text between block-level tags). Each block is a vector: hashed tag-path
elements (tag, class and id words of every ancestor), hashed words, and a few measures. A bidirectional LSTM in numpy
reads the whole page's sequence, so every block is judged with the document about it; blocks labelled as article are
the main text.

The labeller is trained when it is asked for, on a bounded number of page layouts composed from a written-down grammar
(which parts pages have, and how their tags and classes are called) and words of a bounded sample of the given pages.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import release

#: Fixed lists of HTML names. Tags that do not end a block; tags whose content is no text; tags without content.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas textarea select title noframes audio video".split())
VOID = frozenset("area base basefont bgsound br col embed hr img input link meta param source track wbr".split())
#: An open element of the first kind ends when one of the second kind begins.
IMPLIED = {"p": frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article aside header footer nav form blockquote pre main figure hr address".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: Comments, declarations, tags (a quote opens a value after "=" only), text, a "<" that begins nothing.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(>|\Z)|[^<]+|<", re.S)
NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

PATH_DIMS, WORD_DIMS, MEASURES, HIDDEN = 48, 16, 8, 16
INPUTS = PATH_DIMS + WORD_DIMS + MEASURES


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


def blocks_of(html: str | None) -> list[Block]:
    """The page's leaf blocks in order; white space is one blank, character references are decoded.

    Comments, declarations and the content of RAW elements are no text. A quote in an attribute counts only after "=";
    one that is not closed does not reach past the tag's end; a tag that the page's end cuts off is dropped. A head ends, with its end tag or without, at the
    first thing that cannot stand in it (all its own elements are RAW or VOID), so its tags are skipped. Unclosed elements end with the page; an end
    tag without a start is skipped; an unclosed comment or RAW element reaches to the end.
    """
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    held: list[str] = []
    linked = 0
    anchors = 0
    html = html or ""
    at, size = 0, len(html)

    def flush():
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(tuple(p for t, p in stack if t not in INLINE or t == "a"), text, linked))
            held.clear()
        linked = 0

    while at < size:
        m = TOKEN.match(html, at)
        at = m.end()
        name = m[2]
        if name is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                piece = unescape(piece)
                held.append(piece)
                linked += len(piece) * bool(anchors)
            continue
        if not m[4]:
            break
        tag = name.lower()
        if tag == "head":
            flush()
            continue
        if m[1]:
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in INLINE and any(t not in INLINE for t, _ in stack[k:]):
                        break
                    anchors -= sum(t == "a" for t, _ in stack[k:])
                    del stack[k:]
                    break
            continue
        if tag in RAW:
            flush()
            if not m[3].rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
                at = end.end() if end else size
            continue
        if tag not in INLINE:
            flush()
            while stack and tag in IMPLIED.get(stack[-1][0], ()):
                stack.pop()
            for k in range(len(stack) - 1, -1, -1):  # an inline element left open ends with the block around it
                if stack[k][0] not in INLINE:
                    if k < len(stack) - 1 and tag in IMPLIED.get(stack[k][0], ()):
                        anchors -= sum(t == "a" for t, _ in stack[k:])
                        del stack[k:]
                    break
        elif tag == "br":
            held.append(" ")
        if tag in VOID:
            continue
        words = [tag]
        if m[3]:
            for key, a, b, c in NAMES.findall(m[3]):
                words += [f"{key.lower()}={w}" for w in re.findall(r"[a-z]+|\d+", (a or b or c or "").lower())] or [key.lower()]
        stack.append((tag, " ".join(words)))
        anchors += tag == "a"
    flush()
    return out


class Features:
    """Vectors of blocks; path elements are seen as they hash, each with a fixed random direction."""

    def __init__(self):
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words: dict[str, int] = {}

    @staticmethod
    def _direction(word: str) -> np.ndarray:
        return np.random.default_rng(zlib.crc32(word.encode("utf-8", "replace"))).normal(size=PATH_DIMS) / 4

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        if (v := self.paths.get(path)) is None:
            if len(self.paths) > 20_000:
                self.paths = {}
            v = np.zeros(PATH_DIMS)
            for depth, element in enumerate(reversed(path)):
                for word in element.split(" "):
                    v += self._direction(word) * (1.0 if depth < 6 else 0.5)
            self.paths[path] = v = v.astype(np.float32)
        return v

    def page(self, blocks: list[Block]) -> np.ndarray:
        x = np.zeros((len(blocks), INPUTS), np.float32)
        total, passed = sum(len(b.text) for b in blocks) or 1, 0
        for k, b in enumerate(blocks):
            x[k, :PATH_DIMS] = self.path(b.path)
            words = b.text.split(" ")
            for w in words:
                x[k, PATH_DIMS + zlib.crc32(w.lower().encode("utf-8", "replace")) % WORD_DIMS] += 1.0
            x[k, PATH_DIMS : PATH_DIMS + WORD_DIMS] /= len(words)
            n = len(b.text)
            x[k, -MEASURES:] = (np.log1p(n) / 6, min(1.0, b.linked / n), b.text[-1] in ".!?…。", min(len(words), 100) / 100, passed / total, k / len(blocks), n / total, len(b.path) / 10)
            passed += n
        return x


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, mask: np.ndarray, w: dict, side: str) -> tuple[np.ndarray, list]:
    """States (time, pages, HIDDEN) of one direction; padded places keep the state as it is."""
    steps, pages = x.shape[:2]
    h = np.zeros((pages, HIDDEN), np.float32)
    c = np.zeros((pages, HIDDEN), np.float32)
    out, tape = np.zeros((steps, pages, HIDDEN), np.float32), []
    inner = x @ w[f"{side}x"] + w[f"{side}b"]
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        z = inner[t] + h @ w[f"{side}h"]
        i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        new = f * c + i * g
        tanh = np.tanh(new)
        keep = mask[t][:, None]
        tape.append((t, h, c, i, f, o, g, tanh, keep))
        c = np.where(keep, new, c)
        h = np.where(keep, o * tanh, h)
        out[t] = h
    return out, tape


def _lstm_back(d_out: np.ndarray, x: np.ndarray, tape: list, w: dict, side: str, grads: dict) -> None:
    dh = np.zeros(d_out.shape[1:], np.float32)
    dc = np.zeros_like(dh)
    for t, h, c, i, f, o, g, tanh, keep in reversed(tape):
        dh = dh + d_out[t]
        dn = np.where(keep, dh * o * (1 - tanh**2) + dc, 0)
        do = np.where(keep, dh * tanh, 0)
        dz = np.concatenate((dn * g * i * (1 - i), dn * c * f * (1 - f), do * o * (1 - o), dn * i * (1 - g**2)), axis=1)
        grads[f"{side}x"] += x[t].T @ dz
        grads[f"{side}h"] += h.T @ dz
        grads[f"{side}b"] += dz.sum(0)
        dh = np.where(keep, 0, dh) + dz @ w[f"{side}h"].T
        dc = np.where(keep, dn * f, dc)


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), INPUTS), np.float32), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


def scores(pages: list[np.ndarray], w: dict) -> list[np.ndarray]:
    """Chance of each block to be article; pages of about one length go together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    first = 0
    while first < len(order):
        last = first + 1
        while last < len(order) and (last - first) * len(pages[order[last]]) < 20_000:
            last += 1
        x, mask = _padded([pages[k] for k in order[first:last]])
        both = np.concatenate((_lstm(x, mask, w, "f")[0], _lstm(x, mask, w, "r")[0]), axis=2)
        p = _sigmoid(both @ w["out"] + w["bias"])[..., 0]
        for j, k in enumerate(order[first:last]):
            out[k] = p[: len(pages[k]), j]
        first = last
    return out


# --- the layouts that the labeller learns from -----------------------------------------------------------------------

#: Fixed names: how the parts of pages are usually written (tag, then class or id words), and whether they are article.
BOILERPLATE = {
    "menu": ["nav", "nav class=nav", "nav class=menu", "div class=navbar", "ul class=menu", "div id=navigation", "div class=breadcrumb", "div class=topnav", "nav class=breadcrumbs", "div role=navigation"],
    "header": ["header", "div class=header", "div id=header", "header class=site header", "div class=masthead", "div class=topbar", "div class=branding", "div class=logo"],
    "footer": ["footer", "div class=footer", "div id=footer", "footer class=site footer", "div class=copyright", "div class=colophon", "div class=bottom"],
    "side": ["aside", "div class=sidebar", "div id=sidebar", "aside class=sidebar", "div class=widget", "section class=related", "div class=related posts", "div class=rail", "div class=recommended", "aside class=promo", "div class=popular", "div class=trending"],
    "notice": ["div class=cookie", "div class=cookie banner", "div class=notice", "div id=consent", "div class=newsletter", "div class=subscribe", "div class=banner", "div class=alert", "div role=alert", "div class=popup", "div class=modal", "div class=gdpr", "div class=disclaimer", "section class=notice"],
    "advert": ["div class=ad", "div class=ads", "div class=advert", "div class=advertisement", "div class=sponsored", "div id=ad", "div class=promo", "aside class=ad", "div class=banner ad", "section class=sponsor", "ins class=adsbygoogle"],
    "form": ["form", "form class=search", "form id=login", "form class=contact", "div class=login"],
    "comments": ["div class=comments", "section id=comments", "section class=comments", "ul class=comment list", "div class=comment", "ol class=commentlist", "div id=disqus thread", "div class=replies", "div class=discussion", "article class=comment", "div class=responses"],
    "share": ["div class=share", "ul class=social", "div class=tags", "div class=pagination", "div class=share buttons"],
}
ARTICLE = ["article", "article", "article class=post", "main", "main article", "div class=content", "div id=content", "div class=article", "div class=post", "div class=entry content", "div id=main", "div class=main content", "div class=article body", "section class=story", "div class=post content", "main id=content", "div role=main", "div class=text", "div id=article", "td class=content", "body"]
PHRASES = ["Subscribe to our newsletter", "We use cookies", "Accept all cookies", "All rights reserved", "Copyright", "Share this", "Read more", "Log in", "Sign up", "Search", "Privacy policy", "Terms of use", "Advertisement", "Sponsored", "Leave a reply", "Reply", "Related articles", "Home", "About", "Contact"]


def _compose(words: list[str], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """One page of the grammar: its blocks and their labels (1: article)."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]

    def text(low: int, high: int, end: bool) -> str:
        out = " ".join(words[int(k)] for k in rng.integers(len(words), size=int(rng.integers(low, high))))
        return out + "." if end and out[-1].isalnum() else out

    outer = [(), ("html", "body"), ("html", "body"), ("html", "body", "div"), ("html", "body", "div class=page"), ("html", "body", "div id=wrapper", "div class=container")][int(rng.integers(6))]
    path = lambda name: tuple(name.split(" ", 1)) if name == "main article" else (name,)
    spell = lambda name: tuple(" ".join(w if "=" in w or k == 0 else f"{x.split('=')[0].split()[-1]}={w}" for k, w in enumerate(x.split(" "))) for x in path(name))

    def boilerplate(kind: str, around: tuple) -> list[tuple[Block, int]]:
        head = (*around, *spell(pick(BOILERPLATE[kind])))
        made = []
        many = int(rng.integers(1, 10)) if kind in ("menu", "side", "footer", "comments", "share") else int(rng.integers(1, 4))
        style = rng.random()
        for _ in range(many):
            phrase = pick(PHRASES) + " " if rng.random() < 0.2 else ""
            if kind in ("menu", "share") or (kind in ("side", "footer", "header") and style < 0.5):
                t = phrase + text(1, 5, False)
                made.append((Block((*head, *(("ul", "li") if rng.random() < 0.7 else ()), "a"), t, len(t)), 0))
            else:
                t = phrase + text(2, 60 if kind == "comments" else 25, rng.random() < 0.7)
                inner = [(), (), ("p",), ("div",), ("ul", "li"), ("span",)][int(rng.integers(6))]
                made.append((Block((*head, *(x for x in inner if x != "span")), t, len(t) * int(rng.random() < 0.1)), 0))
        return made

    body = (*outer, *(() if (name := pick(ARTICLE)) == "body" else spell(name)))
    page: list[tuple[Block, int]] = []
    for kind in ("header", "menu", "notice", "advert", "form", "side"):
        if rng.random() < (0.7 if kind == "menu" else 0.3):
            page += boilerplate(kind, outer)
    if len(page) > 1 and rng.random() < 0.2:
        page = page[len(page) // 2 :] + page[: len(page) // 2]
    if rng.random() < 0.85:
        inner = ("header",) if rng.random() < 0.15 else ()
        page.append((Block((*body, *inner, pick(["h1", "h1", "h2"])), text(3, 14, rng.random() < 0.2), 0), 1))
    short, plain = float(rng.choice([0.05, 0.3, 1.0], p=[0.7, 0.2, 0.1])), rng.random() < 0.4
    for _ in range(int(rng.integers(1, 4)) if rng.random() < 0.3 else int(rng.integers(1, 30))):
        shape = rng.random() * (0.72 if plain else 1.0)
        if shape < 0.72:
            t = text(1, 4 if rng.random() < short else 90, rng.random() < 0.85)
            page.append((Block((*body, "p"), t, len(t) // 4 * int(rng.random() < 0.1)), 1))
        elif shape < 0.8:
            page.append((Block((*body, pick(["h2", "h3", "h4"])), text(1, 8, False), 0), 1))
        elif shape < 0.9:
            inner = pick([("ul", "li"), ("ol", "li"), ("table", "tr", "td"), ("dl", "dd")])
            page += [(Block((*body, *inner), text(1, 20, rng.random() < 0.5), 0), 1) for _ in range(int(rng.integers(1, 5)))]
        elif shape < 0.96:
            page.append((Block((*body, *pick([("blockquote", "p"), ("blockquote",), ("pre",), ("div",), ("section", "p"), ("figure", "figcaption"), ("div", "p"), ()])), text(3, 60, True), 0), 1))
        else:
            page += boilerplate(pick(["advert", "side", "share", "notice", "form"]), body)
    for kind in ("share", "comments", "side", "form", "advert", "notice", "footer"):
        if rng.random() < (0.8 if kind == "footer" else 0.3):
            page += boilerplate(kind, body if rng.random() < 0.3 and kind != "footer" else outer)
    return [b for b, _ in page], [y for _, y in page]


def train(words: list[str], pages: int = 1600, epochs: int = 10, batch: int = 32, seed: int = 7) -> dict:
    """The labeller's weights: cross entropy over blocks, Adam, backpropagation through the whole sequences."""
    rng, features = np.random.default_rng(seed), Features()
    data = []
    for _ in range(pages):
        blocks, labels = _compose(words, rng)
        data.append((features.page(blocks), np.array(labels, np.float32)))
    w = {}
    for side in "fr":
        w[f"{side}x"] = rng.normal(size=(INPUTS, 4 * HIDDEN)).astype(np.float32) / np.float32(np.sqrt(INPUTS))
        w[f"{side}h"] = rng.normal(size=(HIDDEN, 4 * HIDDEN)).astype(np.float32) / np.float32(np.sqrt(HIDDEN))
        w[f"{side}b"] = np.zeros(4 * HIDDEN, np.float32)
        w[f"{side}b"][HIDDEN : 2 * HIDDEN] = 1
    w["out"], w["bias"] = rng.normal(size=(2 * HIDDEN, 1)).astype(np.float32) / 4, np.zeros(1, np.float32)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(pages)
        for k in range(0, pages, batch):
            part = sorted(order[k : k + batch], key=lambda j: len(data[j][0]))
            x, mask = _padded([data[j][0] for j in part])
            y = np.zeros(mask.shape, np.float32)
            for c, j in enumerate(part):
                y[: len(data[j][1]), c] = data[j][1]
            forward, tape_f = _lstm(x, mask, w, "f")
            backward, tape_r = _lstm(x, mask, w, "r")
            both = np.concatenate((forward, backward), axis=2)
            p = _sigmoid(both @ w["out"] + w["bias"])[..., 0]
            d = np.where(mask, p - y, 0)[..., None] / mask.sum()
            grads = {n: np.zeros_like(v) for n, v in w.items()}
            grads["out"], grads["bias"] = np.einsum("tbh,tbo->ho", both, d), d.sum((0, 1))
            d_both = d @ w["out"].T
            _lstm_back(d_both[..., :HIDDEN], x, tape_f, w, "f", grads)
            _lstm_back(d_both[..., HIDDEN:], x, tape_r, w, "r", grads)
            step += 1
            rate = 0.01 if epoch < epochs * 2 // 3 else 0.003
            for n in w:
                g = np.clip(grads[n], -1, 1)
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.99 * second[n] + 0.01 * g * g
                w[n] = (w[n] - rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return w


def fit_labeller(pages: DataFrame, html: str = "html", sample: int = 64) -> dict:
    """Weights trained with the words of at most ``sample`` pages (those with the smallest hashes)."""
    rows = pages.where(F.col(html).isNotNull()).select(F.col(html).alias("html"), F.xxhash64(html).alias("h"))
    drawn = {r["h"] for r in rows.select("h").distinct().orderBy("h").limit(sample).collect()}  # a page's copies teach no other words
    texts = [r["html"] for r in rows.where(F.col("h").isin(*drawn)).select("h", "html").dropDuplicates(["h"]).collect()]
    words = sorted({w for t in texts for b in blocks_of(t) for w in b.text.split(" ")})
    rng = np.random.default_rng(1)
    return train([words[int(k)] for k in rng.integers(len(words), size=4000)] if words else ["word", "text", "page", "the"])


def extract_main_text(pages: DataFrame, weights: dict, html: str = "html", cut: float = 0.5) -> DataFrame:
    """Adds ``text`` (article blocks in page order, joined by one blank; empty if none), ``n_blocks`` and ``n_kept``.

    The whole html is read; null or empty html gives an empty text. Other columns pass; columns already named so are
    replaced. Repeated rows give repeated results, an empty table an empty one; long pages are read whole.
    """
    keep = [c for c in pages.columns if c not in ("text", "n_blocks", "n_kept")]
    pages = pages.select(*(F.col(f"`{c}`") for c in keep))
    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_blocks", T.IntegerType()), T.StructField("n_kept", T.IntegerType())])
    at = keep.index(html)

    def run(batches):
        features = Features()
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                found = [blocks_of(h) for h in batch.column(at).to_pylist()]
                chances = scores([features.page(b) for b in found], weights)
                kept = [[b.text for b, p in zip(bs, ps, strict=True) if p >= cut] for bs, ps in zip(found, chances, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([" ".join(x) for x in kept], pa.string()), pa.array([len(x) for x in found], pa.int32()), pa.array([len(x) for x in kept], pa.int32())],
                    names=[*keep, "text", "n_blocks", "n_kept"],
                )
        release()

    return pages.mapInArrow(run, schema)
