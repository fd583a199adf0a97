"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page, decoded by Viterbi.

A block is the text between two block-level tags. Its features are the tags and the words of class and id of all
its ancestors, its parent, and its shape (length, share of links, punctuation, a few signal words). The field
has two labels, main text and other, with weights per feature and per pair of neighbours.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.common import over_texts

#: Pages the field is trained on, and steps of the fit.
TRAINING_PAGES = 600
STEPS = 120
RIDGE = 1e-4

#: HTML's own classes of tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split())
HIDDEN = ("script", "style", "noscript", "template", "title", "textarea", "svg", "iframe", "select", "object")
#: Of these, those whose content is plain text up to their end tag; by HTML's rules up to the end of the page without one.
RAW = ("script", "style", "title", "textarea", "iframe")
ENDS_P = ("p", "li", "dt", "dd", "tr", "td", "th", "option")
#: Words of a block's own text that tell of notices, forms and the like.
SIGNALS = frozenset(
    "comment comments reply cookie cookies subscribe newsletter advertisement sponsored login register share "
    "copyright rights reserved privacy terms menu search related tags".split())

#: A quote opens only at the start of a value; one that is never closed is a character like others.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S)
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PIECE = re.compile(r"[a-z]+")
_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}
_NOSCRIPT = re.compile(r"<(/?)noscript\b[^>]*(?:>|\Z)", re.I)


@dataclass
class Block:
    text: str
    features: tuple[str, ...]


def _raw_end(page: str, tag: str, at: int) -> int:
    closing = _END[tag].search(page, at)
    return closing.end() if closing else len(page)


def _noscript_end(page: str, at: int) -> int:
    """Where a noscript ends whose start tag ends at ``at``; ``at`` itself if it has no end tag before the next one."""
    following = _NOSCRIPT.search(page, at)
    return following.end() if following and following[1] else at


def _closes_itself(tag: str, rest: str | None) -> bool:
    return tag in ("svg", "object") and (rest or "").rstrip().endswith("/")


def _container_ends(page: str) -> dict[int, int]:
    """Where each select, object, svg or template starts that has an end tag of its own -> where that ends."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {t: [] for t in HIDDEN if t not in RAW and t != "noscript"}
    at = 0
    while m := _TOKEN.search(page, at):
        at = m.end()
        tag = (m[2] or "").lower()
        if tag in opened:
            if not m[1] and not _closes_itself(tag, m[3]):
                opened[tag].append(m.start())
            elif m[1] and opened[tag]:
                ends[opened[tag].pop()] = at
        elif not m[1] and tag == "noscript":
            at = _noscript_end(page, at)
        elif not m[1] and tag in RAW and (tag == "script" or not opened["svg"]):
            at = _raw_end(page, tag, at)  # inside an svg, title and style are elements like others
    return ends


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, with their features. Unclosed, stray and cut-off tags are borne.

    What is not shown is left out up to its own end tag. A select, object, noscript, svg or template without one, or
    an svg or object that closes itself, hides nothing.
    """
    page = page or ""
    ends: dict[int, int] | None = None
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[Block] = []
    text: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        whole = " ".join(html.unescape("".join(text)).split())
        if whole:
            out.append(Block(whole, _features(whole, linked, stack)))
        text.clear()
        linked = 0

    while at <= len(page):
        m = _TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            text.append(page[at:end])
            if in_link:
                linked += len(page[at:end].strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if any(t == tag for t, _ in stack):
                if tag not in INLINE:
                    flush()
                while stack.pop()[0] != tag:
                    pass
                in_link = sum(t == "a" for t, _ in stack)
            elif tag not in INLINE:
                flush()
            continue
        if tag == "br" or tag in VOID:
            if tag not in INLINE:
                flush()
            text.append(" ")
            continue
        if tag in HIDDEN:
            if tag in RAW:
                at = _raw_end(page, tag, at)
            elif tag == "noscript":
                at = _noscript_end(page, at)
            elif not _closes_itself(tag, m[3]):
                ends = _container_ends(page) if ends is None else ends
                at = ends.get(m.start(), at)
            continue
        if tag not in INLINE:
            flush()
            if any(t == "p" for t, _ in stack) or tag in ENDS_P:
                _close(stack, "p" if tag not in ENDS_P[1:] else tag)
            in_link = sum(t == "a" for t, _ in stack)
        names = tuple(w for a in _ATTRIBUTE.findall(m[3] or "") for w in _PIECE.findall("".join(a).lower()))
        if not (m[3] or "").rstrip().endswith("/"):
            stack.append((tag, names))
            in_link += tag == "a"
    flush()
    return out


def _close(stack: list, tag: str) -> None:
    """Ends an open ``tag``, unless a container stands between."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == tag:
            del stack[i:]
            return
        if stack[i][0] not in INLINE and stack[i][0] != "p":
            return


def _features(text: str, linked: int, stack: list) -> tuple[str, ...]:
    words = text.split()
    n = len(words)
    share = linked / len(text)
    found = {f"tag:{t}" for t, _ in stack if t not in INLINE and t not in ("html", "body", "div")}
    found.update(f"name:{w}" for _, names in stack for w in names)
    parent = next((t for t, _ in reversed(stack) if t not in INLINE), "none")
    found.add(f"parent:{parent}")
    found.add("long:" + ("1" if n < 3 else "2" if n < 9 else "3" if n < 21 else "4" if n < 61 else "5"))
    found.add("links:" + ("none" if share == 0 else "some" if share < 0.4 else "many" if share < 0.8 else "all"))
    found.add("end:" + ("stop" if text[-1] in ".!?\"'”" else "open"))
    if "©" in text:
        found.add("has:copyright")
    if n < 30:
        found.update(f"word:{w}" for w in SIGNALS.intersection(_PIECE.findall(text.lower())))
    return tuple(sorted(found))


@dataclass
class Field:
    """Weights of main against other by feature; of first labels; and of neighbours, from row to column."""

    weights: dict[str, float]
    bias: float
    start: np.ndarray
    step: np.ndarray

    def decode(self, page: list[Block]) -> list[bool]:
        """Viterbi: the likeliest labels of the whole page."""
        if not page:
            return []
        (aa, ab), (ba, bb) = self.step.tolist()
        x, y = self.start.tolist()
        back = []
        for i, block in enumerate(page):
            own = self.bias + sum(self.weights.get(f, 0.0) for f in block.features)
            if i:
                back.append((x + aa < y + ba, x + ab < y + bb))
                x, y = max(x + aa, y + ba), max(x + ab, y + bb)
            y += own
        label = y > x
        labels = [label]
        for from_x, from_y in reversed(back):
            label = from_y if label else from_x
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[list[Block], list[bool]]], steps: int = STEPS) -> Field:
    """Likelihood of the labels under the field, raised by Adam over all pages at once (forward and backward sums)."""
    pages = [(b, y) for b, y in pages if b]
    names = sorted({f for b, _ in pages for x in b for f in x.features})
    index = {f: i for i, f in enumerate(names)}
    n, long = len(pages), max(len(b) for b, _ in pages)
    at = [(p, t, index[f]) for p, (b, _) in enumerate(pages) for t, x in enumerate(b) for f in x.features]
    p, t, f = np.array(at).T
    cell = p * long + t
    mask = np.zeros((n, long), bool)
    gold = np.zeros((n, long), int)
    for i, (b, y) in enumerate(pages):
        mask[i, :len(b)] = True
        gold[i, :len(b)] = y
    total, size = mask.sum(), len(names)
    theta = np.zeros(size + 1 + 2 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    both = mask[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    first = np.bincount(gold[:, 0], minlength=2)
    for k in range(1, steps + 1):
        start, step = theta[size + 1:size + 3], theta[size + 3:].reshape(2, 2)
        own = (np.bincount(cell, theta[f], n * long) + theta[size]).reshape(n, long)
        unary = np.stack([np.zeros_like(own), own], 2)
        ahead, behind = np.zeros((n, long, 2)), np.zeros((n, long, 2))
        ahead[:, 0] = start + unary[:, 0]
        for i in range(1, long):
            new = np.logaddexp.reduce(ahead[:, i - 1, :, None] + step, axis=1) + unary[:, i]
            ahead[:, i] = np.where(mask[:, i, None], new, ahead[:, i - 1])
        for i in range(long - 2, -1, -1):
            new = np.logaddexp.reduce(step + (unary[:, i + 1] + behind[:, i + 1])[:, None, :], axis=2)
            behind[:, i] = np.where(mask[:, i + 1, None], new, 0)
        z = np.logaddexp.reduce(ahead[:, -1], axis=1)
        post = np.exp(ahead + behind - z[:, None, None]) * mask[:, :, None]
        off = post[:, :, 1] - gold * mask
        pair = ahead[:, :-1, :, None] + step + (unary[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None]
        pair = (np.exp(np.minimum(pair, 0)) * both[:, :, None, None]).sum((0, 1))
        grad = np.concatenate([
            np.bincount(f, off.ravel()[cell], size), [off.sum()], post[:, 0].sum(0) - first, (pair - seen).ravel()]) / total
        grad[:size] += RIDGE * theta[:size]
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        theta -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Field({x: float(theta[i]) for x, i in index.items()}, float(theta[size]), theta[size + 1:size + 3], theta[size + 3:].reshape(2, 2))


#: Names that page makers give to containers, by what they hold.
MAIN_NAMES = "content main post entry article story body text page-content post-content entry-content article-body".split()
OTHER_NAMES = {
    "menu": "nav navigation menu navbar topnav main-menu breadcrumb breadcrumbs toc".split(),
    "header": "header site-header masthead top-bar branding".split(),
    "footer": "footer site-footer bottom colophon copyright".split(),
    "sidebar": "sidebar widget aside related recommended popular right-rail side".split(),
    "advert": "ad ads advert advertisement sponsored promo banner sponsor".split(),
    "notice": "notice cookie-notice consent alert warning popup modal cookie-banner gdpr".split(),
    "form": "form newsletter signup subscribe search login contact-form".split(),
    "comments": "comments comment comment-list reply respond discussion reader-comments".split(),
    "share": "share social sharing tags meta byline-links pagination".split(),
}
OTHER_TAGS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section"}


class PageMaker:
    """Labelled training pages: page layouts with invented words, in which each block's label is known.

    Main blocks end in the mark U+E000, which is taken off when the page has been read back into blocks.
    """

    MARK = "\ue000"

    def __init__(self, seed: int = 11):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice("bcdfglmnprstv") + self.r.choice("aeiou") for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentences(self, n: int) -> str:
        return " ".join(self.words(4, 18).capitalize() + self.r.choice([".", ".", ".", "!", "?", ""]) for _ in range(n))

    def attribute(self, names: list[str]) -> str:
        if self.r.random() < 0.25:
            return ""
        name = self.r.choice(names) + self.r.choice(["", "", "", f" {self.word()}", f"-{self.r.randint(1, 9)}"])
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{self.word()}">{self.words(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    def other(self, kind: str) -> str:
        tag = OTHER_TAGS.get(kind) if self.r.random() < 0.5 else None
        names = self.attribute(OTHER_NAMES[kind])
        if not tag and not names:
            names = f' class="{self.r.choice(OTHER_NAMES[kind])}"'
        tag = tag or "div"
        inner = {
            "menu": lambda: self.links(self.r.randint(2, 8)),
            "header": lambda: self.r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<a href='/'>{self.words(1, 3)}</a>", f"<p>{self.sentences(1)}</p>"]),
            "footer": lambda: self.r.choice(["&copy; ", "", "Copyright "]) + self.words(1, 12) + " &middot; " + self.sentences(self.r.randint(1, 2)),
            "sidebar": lambda: f"<h3>{self.words(1, 3)}</h3>" + self.r.choice([self.links(4), f"<p>{self.sentences(2)}</p>"]),
            "advert": lambda: self.r.choice([self.sentences(self.r.randint(1, 4)), f"<p>{self.sentences(2)}</p>", f"<a href='#'>{self.words(2, 9)}</a>"]),
            "notice": lambda: f"<p>{self.r.choice(['We use cookies. ', '', 'Notice: '])}{self.sentences(self.r.randint(1, 3))}</p>",
            "form": lambda: f"<label>{self.words(1, 4)}</label><input name=q><p>{self.sentences(1)}</p><button>{self.words(1, 2)}</button>",
            "comments": lambda: f"<h3>{self.r.choice(['Comments', '3 comments', self.words(1, 2)])}</h3>" + "".join(
                f"<div{self.attribute(['comment', 'reply', 'comment-body'])}><b>{self.word()}</b><p>{self.sentences(self.r.randint(1, 4))}</p></div>"
                for _ in range(self.r.randint(1, 4))),
            "share": lambda: self.r.choice([self.links(3), f"<span>{self.words(1, 4)}</span>", f"<p>Tags: <a href=#>{self.word()}</a></p>"]),
        }[kind]()
        return f"<{tag}{names}>{inner}</{tag}>"

    def main(self) -> str:
        r, mark, parts = self.r, self.MARK, []
        if r.random() < 0.8:
            parts.append(f"<h1>{self.words(1, 12)}{mark}</h1>")
        for _ in range(r.randint(0 if parts else 1, 9)):
            kind = r.random()
            if kind < 0.75:
                close = "" if r.random() < 0.2 else "</p>"
                parts.append(f"<p>{r.choice(['', '<b>', '<em>'])}{self.sentences(r.randint(1, 6))}{mark}{close}")
            elif kind < 0.83:
                parts.append(f"<h2>{self.words(1, 7)}{mark}</h2>")
            elif kind < 0.9:
                items = "".join(f"<li>{self.words(1, 15)}{mark}</li>" for _ in range(r.randint(1, 5)))
                parts.append(f"<ul>{items}</ul>")
            elif kind < 0.94:
                parts.append(f"<blockquote>{self.sentences(2)}{mark}</blockquote>")
            elif kind < 0.97:
                cells = "".join(f"<td>{self.words(1, 3)}{mark}</td>" for _ in range(3))
                parts.append(f"<table><tr>{cells}</tr></table>")
            else:
                parts.append(f"<pre>{self.words(2, 12)}{mark}</pre>")
            if r.random() < 0.08:
                parts.append(self.other(r.choice(["advert", "sidebar", "share", "form", "notice"])))
        if r.random() < 0.1:
            parts.append(self.other("comments"))
        tag = r.choice(["article", "article", "main", "div", "div", "section"])
        names = self.attribute(MAIN_NAMES)
        if tag in ("div", "section") and not names:
            names = f' class="{r.choice(MAIN_NAMES)}"'
        body = f"<{tag}{names}>{''.join(parts)}</{tag}>"
        return f"<main>{body}</main>" if r.random() < 0.15 else f"<div{self.attribute(['wrapper', 'container', self.word()])}>{body}</div>" if r.random() < 0.3 else body

    def page(self) -> tuple[list[Block], list[bool]]:
        r = self.r
        before = [self.other(k) for k in ("header", "menu", "notice", "advert", "share", "sidebar") if r.random() < 0.4]
        before = [] if r.random() < 0.3 else before
        after = [self.other(k) for k in ("comments", "sidebar", "advert", "form", "share", "notice", "menu") if r.random() < 0.25]
        after += [self.other("footer")] if r.random() < 0.8 else []
        main = self.main() if r.random() < 0.96 else ""
        if r.random() < 0.05:  # a bare page
            main = "".join(f"<p>{self.sentences(r.randint(2, 6))}{self.MARK}</p>" for _ in range(r.randint(1, 6)))
        page = f"<html><head><title>{self.words(1, 6)}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"
        found = blocks(page)
        labels = [b.text.endswith(self.MARK) for b in found]
        clean = blocks(page.replace(self.MARK, ""))
        if len(clean) != len(found):
            raise AssertionError("marks may not change the blocks")
        return clean, labels


def trained(pages: int = TRAINING_PAGES, seed: int = 11) -> Field:
    maker = PageMaker(seed)
    return train([maker.page() for _ in range(pages)])


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html).

    The text is that of the main blocks in page order, joined by line ends; empty if there is none. Character
    references are decoded, white space inside a block is one space. Null html is an empty page, other nulls are
    carried along, repeated rows give repeated results, pages of any length are read whole.
    """
    field = field or trained()
    # plain values: a broadcast class would have to be installed on the executors
    shared = pages.sparkSession.sparkContext.broadcast((field.weights, field.bias, field.start, field.step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*shared.value)
        for batch in batches:
            texts = []
            for page in batch.column(2):
                found = blocks(page.as_py())
                texts.append("\n".join(b.text for b, main in zip(found, field.decode(found)) if main))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return over_texts(rows, run, "page_id long, url string, text string, n_chars long")
