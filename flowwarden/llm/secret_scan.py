"""Secret scans: fixed patterns, and windows of high Shannon entropy by character class, less an allow-list."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.common import over_texts

#: The base patterns, in the order that breaks ties: kind, pattern, group whose length counts, least length. A run of
#: ``[0-9a-f]`` that is long enough is found from its first character on, so shorter ones need no match of their own.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
)
#: The kind of the spans that the windows find.
FOUND = "entropy"
KINDS = (*(kind for kind, *_ in BASE), FOUND)
#: Without one of these in its lower-cased form a text has no match of the first pattern.
_HINTS = ("passw", "secret", "token", "api")


@dataclass(frozen=True)
class CharacterClass:
    """Runs of ``characters`` are candidates; a window of ``width`` with at least ``bits`` a character is a find."""

    name: str
    characters: str
    width: int
    bits: float


CLASSES = (
    CharacterClass("hex", "0-9A-Fa-f", 32, 3.2),
    CharacterClass("base64", r"A-Za-z0-9+/=_\-", 20, 3.8),
)
#: A word, words in camel case, capitals or a number; nothing is taken back, so long strings need no stack.
_WORD = r"(?:[A-Z]?+[a-z]++(?:[A-Z][a-z]++)*+|[A-Z]++|[0-9]++)"
#: Candidates that are one of these as a whole are no secrets: words and numbers joined by marks (names, paths,
#: numbers of cards and phones), alphabets written out, universally unique ids, and strings marked as examples.
ALLOWED = (
    rf"[+/=_-]*+{_WORD}(?:[+/=_-]++{_WORD})*+[+/=_-]*+",
    r"(?:abcdefghijklmnopqrstuvwxyz|ABCDEFGHIJKLMNOPQRSTUVWXYZ|0123456789|[+/=_-])*+",
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r".*(?:EXAMPLE|example|PLACEHOLDER|placeholder).*",
)
#: Bits are counted in whole units of 2^-40, so sums do not depend on their order.
UNIT = 1 << 40
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _weights(width: int) -> list[int]:
    """c log2 c for every count c of a window, and of one that takes in a character before it lets one go."""
    return [0, *(round(c * math.log2(c) * UNIT) for c in range(1, width + 2))]


def _most(width: int, bits: float) -> int:
    """A window has at least ``bits`` a character if the weights of its counts sum to no more than this."""
    return math.floor((math.log2(width) - bits) * width * UNIT)


def rich_windows(candidate: str, width: int, bits: float) -> list[tuple[int, int]]:
    """Merged (start, end) of all windows of ``width`` whose entropy is at least ``bits``.

    Moving the window by one changes two counts, so a step costs the same however wide it is.
    """
    if len(candidate) < width:
        return []
    weight, most = _weights(width), _most(width, bits)
    counts, held = {}, 0
    spans: list[list[int]] = []
    for at, c in enumerate(candidate):
        n = counts.get(c, 0)
        held += weight[n + 1] - weight[n]
        counts[c] = n + 1
        start = at - width + 1
        if start > 0:
            old = candidate[start - 1]
            n = counts[old]
            held -= weight[n] - weight[n - 1]
            counts[old] = n - 1
        if start >= 0 and held <= most:
            if spans and start <= spans[-1][1]:
                spans[-1][1] = at + 1
            else:
                spans.append([start, at + 1])
    return [tuple(s) for s in spans]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


class Scanner:
    """Finds the spans of one text; its rules are compiled once for a task."""

    def __init__(self, classes=CLASSES, allowed=ALLOWED):
        self.classes = [(c, re.compile(f"[{c.characters}]{{{c.width},}}")) for c in classes]
        self.allowed = [re.compile(a, re.S) for a in allowed]

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, place of the kind, end) of the fixed patterns, in order."""
        found = []
        low = text.lower()
        for place, (_, pattern, group, least) in enumerate(BASE):
            if place == 0 and not any(h in low for h in _HINTS):
                continue
            found += [(m.start(), place, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
        return sorted(found)

    def windows(self, text: str) -> list[tuple[int, int]]:
        """Merged spans of windows of high entropy in candidates that the allow-list does not know."""
        found = []
        for c, pattern in self.classes:
            for m in pattern.finditer(text):
                if any(a.fullmatch(m[0]) for a in self.allowed):
                    continue
                found += [(m.start() + a, m.start() + b) for a, b in rich_windows(m[0], c.width, c.bits)]
        return merged(found)

    def __call__(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and all spans: a window's span within a base span adds nothing and is left out."""
        base = self.base(text)
        covered = merged([(a, b) for a, _, b in base])
        more, at = [], 0
        for start, end in self.windows(text):
            while at < len(covered) and covered[at][1] < end:
                at += 1
            if at == len(covered) or covered[at][0] > start:
                more.append((start, len(BASE), end))
        return base, sorted(base + more)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, classes=CLASSES, allowed=ALLOWED) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts of the base kinds, their digest, and all spans (code points, end
    exclusive, by start, then kind).

    Null and empty texts have no spans; null ids are carried along; repeated rows are scanned each by itself; an
    empty table gives an empty result; other columns play no part. Whole texts are read, a text of any length in one
    pass, with the counts of one window in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Scanner(classes, allowed)
        for batch in batches:
            counts, digests, spans = [[], [], []], [], []
            for text in batch.column(1):
                base, found = find(text.as_py() or "")
                for place, column in enumerate(counts):
                    column.append(sum(1 for _, kind, _ in base if kind == place))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(found))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return over_texts(rows, run, SCHEMA)
