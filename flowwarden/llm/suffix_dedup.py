"""Suffix-array dedup: bytes covered by a string of a given length that starts anywhere else, by a distributed sort.

1. Equal texts become one. Anchors are places whose hash of ``GRAM`` bytes is the least among the places that
   fit into ``length`` bytes, so two equal strings of that length hold the same anchor at the same place.
   Anchors whose bytes occur once are dropped by a count.
2. The suffixes at the others, cut to ``length`` bytes, are sorted within a task into front-coded runs. Runs are
   exchanged by the first bytes of their suffixes and combined by loser trees, which carry the common prefix with
   the last suffix given out and never compare those bytes again.
3. Among neighbours that share the first bytes, common prefixes to the right and, by a sort of what stands before
   the anchors, to the left tell how far a string that occurs elsewhere reaches to either side.
"""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.common import marked, over_texts, stage, without

LENGTH = 200
#: Bytes of an anchor. The string holds it with every place before it that may be its start.
GRAM = 72
#: Suffixes of one part of the exchange, about; and entries of a run.
PART_ITEMS = 20_000
RUN_ENTRIES = 40_000
#: Anchors of one kind that a task compares at most; kinds beyond that are counted by a shuffle (``_by_counts``).
CLASS_ITEMS = 50_000
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            row = np.full(size, b, U64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def gram_hashes(body: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place on; equal bytes have equal hashes."""
    up, down = _powers(len(body) + 1)
    sums = np.zeros(len(body) + 1, U64)
    np.cumsum(body.astype(U64) * up[:-1] + up[:-1], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(body) - gram + 1]
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def anchors(body: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes): of every ``length`` bytes the first place with the least hash."""
    if len(body) < length:
        return np.empty(0, np.int64), np.empty(0, U64)
    h = gram_hashes(body, gram)
    wide = length - gram + 1
    low = U64((1 << 28) - 1)
    v = (h & ~low) | (np.arange(len(h), dtype=U64) & low)
    padded = np.full(-(-len(v) // wide) * wide, ~U64(0), U64)
    padded[: len(v)] = v
    rows = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(v) - wide + 1
    least = np.minimum(behind[:n], ahead[wide - 1:wide - 1 + n])
    at = (least[np.append(True, least[1:] != least[:-1])] & low).astype(np.int64)
    if len(body) > 1 << 28:  # places wrap: find them again from the values
        at = np.flatnonzero(np.isin(v, least))
    at = np.unique(at)
    return at, h[at]


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first ``known`` bytes are known to be equal."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differ.bit_length() + 7) // 8


def front_coded(entries: list[tuple[bytes, bytes, list]]) -> bytes:
    """A sorted run: of each suffix the common prefix with the one before, and the rest."""
    out, last = [], b""
    for right, left, owners in entries:
        n = common(last, right)
        out.append((n, right[n:], left, owners))
        last = right
    return pickle.dumps(out, protocol=5)


def unfolded(run: bytes) -> Iterator[tuple[int, bytes, bytes, list]]:
    last = b""
    for n, rest, left, owners in pickle.loads(run):
        last = last[:n] + rest
        yield n, last, left, owners


def merged(runs: list[Iterator[tuple[int, bytes, bytes, list]]]) -> Iterator[tuple[int, bytes, bytes, list]]:
    """All runs in one order, each suffix with its common prefix with the one before, by a loser tree.

    Every run's head knows its common prefix with the last suffix given out. Of two heads the one with the longer
    prefix is the smaller; only heads with equal prefixes are compared, from there on.
    """
    k = len(runs)
    heads = [next(r, None) for r in runs]
    known = [0] * k
    tree: list[int | None] = [None] * max(k, 1)

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = common(x[1], y[1], known[a])
        if x[1][n:n + 1] <= y[1][n:n + 1]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    best = 0
    for leaf in range(k - 1, -1, -1):
        now, node = leaf, (leaf + k) // 2
        while node > 0:
            if tree[node] is None:
                tree[node] = now
                break
            now, tree[node] = play(now, tree[node])
            node //= 2
        else:
            best = now
    while k and heads[best] is not None:
        _, right, left, owners = heads[best]
        yield known[best], right, left, owners
        heads[best] = follow = next(runs[best], None)
        known[best] = follow[0] if follow else 0
        now, node = best, (best + k) // 2
        while node > 0:
            now, tree[node] = play(now, tree[node])
            node //= 2
        best = now


class _Least:
    """Least value of any stretch of a list."""

    def __init__(self, values: list[int]):
        self.levels = [np.array(values)]
        while 2 << len(self.levels) - 1 <= len(values):
            low, step = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(low[:-step], low[step:]))

    def between(self, i: int, j: int) -> int:
        """Over places i + 1 to j."""
        level = (j - i).bit_length() - 1
        row = self.levels[level]
        return int(min(row[i + 1], row[j - (1 << level) + 1]))


def _reach(order: list[int], shared: list[int], other_rank: list[int], other: _Least, length: int) -> list[int]:
    """For each entry the most bytes it shares on this side with one that shares the rest of ``length`` on the other.

    ``order`` sorts the entries on this side and ``shared`` holds common prefixes of neighbours there. Stretches
    are joined from the longest prefix down; each keeps its entries by their rank on the other side, the smaller
    goes into the larger, and an entry need only look at its two neighbours.
    """
    n = len(order)
    best = [-1] * n
    sets: list[list[int]] = [[other_rank[e]] for e in order]
    entry_at = [0] * n
    for e in order:
        entry_at[other_rank[e]] = e
    owner = list(range(n))

    def find(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    for i in sorted(range(1, n), key=lambda i: -shared[i]):
        depth = shared[i]
        a, b = find(i - 1), find(i)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large = sets[a]
        for rank in sets[b]:
            at = bisect_left(large, rank)
            for near in large[max(at - 1, 0):at + 1]:
                low, high = (near, rank) if near < rank else (rank, near)
                if other.between(low, high) + depth >= length:
                    for e in (entry_at[rank], entry_at[near]):
                        best[e] = max(best[e], depth)
            large.insert(at, rank)
        sets[b] = []
        owner[b] = a
    return best


def spans_of_class(entries: list[tuple[int, bytes, bytes, list]], length: int) -> Iterator[tuple[int, int, int]]:
    """(text, start, end) that the anchors of one kind cover. ``entries`` are sorted; equal ones are put together."""
    owners: dict[tuple[bytes, bytes], list] = {}
    lcp: list[int] = []
    low = length
    for n, right, left, own in entries:
        low = min(low, n)
        key = (right, left)
        if key in owners:
            owners[key] += own
            continue
        owners[key] = [*own]
        lcp.append(low)
        low = length
    keys = [*owners]
    count = len(keys)
    if count > 1:
        order = sorted(range(count), key=lambda i: keys[i][1])
        shared = [0] + [common(keys[a][1], keys[b][1]) for a, b in zip(order, order[1:])]
        rank = [0] * count
        for at, e in enumerate(order):
            rank[e] = at
        before = _reach(order, shared, list(range(count)), _Least(lcp), length)
        after = _reach(list(range(count)), lcp, rank, _Least(shared), length)
    else:
        before = after = [-1]
    for i, ((right, left), own) in enumerate(owners.items()):
        own = sorted(set(own))
        a, b = before[i], after[i]
        if len(own) > 1 and len(left) + len(right) >= length:
            a, b = len(left), len(right)
        if a >= 0:
            for text, at in own:
                yield text, at - a, at + b


def _item(body: bytes, at: int, length: int, gram: int) -> tuple[bytes, bytes]:
    """What follows the place, and what stands before it, backwards."""
    return body[at:at + length], body[max(0, at - length + gram):at][::-1]


def _runs(survivors: DataFrame, n_parts: int, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[tuple[bytes, bytes], list]] = defaultdict(lambda: defaultdict(list))
        n = 0

        def give() -> pa.RecordBatch:
            parts = [*held]
            blobs = [front_coded([(r, b, own) for (r, b), own in sorted(held[p].items())]) for p in parts]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "run"])

        for batch in batches:
            for text, body, places in zip(*(c.to_pylist() for c in batch.columns)):
                for p in places:
                    if not p["big"]:
                        held[p["gram"] % n_parts][_item(body, p["pos"], length, gram)].append((text, p["pos"]))
                        n += 1
                if n >= RUN_ENTRIES:
                    yield give()
                    n = 0
        yield give()

    return over_texts(survivors.select("text_id", "body", "places"), run, "part int, run binary")


def _merge(runs: DataFrame, length: int, gram: int) -> DataFrame:
    def combine(blobs: list[bytes]) -> pa.RecordBatch:
        rows, kind = [], []
        for entry in merged([unfolded(b) for b in blobs]):
            if entry[0] < gram and kind:
                rows += spans_of_class(kind, length)
                kind = []
            kind.append(entry)
        if kind:
            rows += spans_of_class(kind, length)
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.binary(), pa.int64(), pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["text_id", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for part, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now and blobs:
                    yield combine(blobs)
                    blobs = []
                now = part
                blobs.append(blob)
        if blobs:
            yield combine(blobs)

    return runs.repartition("part").sortWithinPartitions("part").mapInArrow(run, "text_id binary, start long, end long")


def _by_counts(survivors: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for kinds of very many anchors: every string of ``length`` bytes about them, counted by a shuffle
    that adds up within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, body, places in zip(*(c.to_pylist() for c in batch.columns)):
                starts = sorted({
                    s for p in places if p["big"]
                    for s in range(max(0, p["pos"] - length + gram), min(p["pos"], len(body) - length) + 1)})
                prints = [xxhash.xxh3_128_digest(body[s:s + length]) for s in starts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints, pa.binary()), pa.array([text] * len(starts), pa.binary()), pa.array(starts, pa.int64())],
                    ["print", "text_id", "start"])

    rows = stage(
        survivors.where(F.exists("places", lambda p: p["big"])).select("text_id", "body", "places")
        .mapInArrow(run, "print binary, text_id binary, start long"), "strings")
    key = F.struct("text_id", "start")
    twice = stage(rows.groupBy("print").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low < high").select("print"), "twice")
    return rows.join(twice, "print").select("text_id", "start", (F.col("start") + length).alias("end"))


def _cut(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, body, spans in zip(*(c.to_pylist() for c in batch.columns)):
                kept, last, gone, n = hashlib.sha256(), 0, 0, 0
                for s in sorted(spans, key=lambda s: s["start"]):
                    start, end = s["start"], s["end"]
                    if start > last or not n:
                        kept.update(body[last:start])
                        n += 1
                        gone += end - start
                        last = end
                    elif end > last:
                        gone += end - last
                        last = end
                kept.update(body[last:])
                out.append((text, gone, n, kept.hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.string()))],
                ["text_id", "n_removed", "n_spans", "kept_sha256"])

    return over_texts(rows.select("text_id", "body", "spans"), run, "text_id binary, n_removed long, n_spans long, kept_sha256 string")


def find_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, class_items: int = CLASS_ITEMS) -> tuple[DataFrame, DataFrame]:
    """(spans, survivors) for distinct ``texts`` (text_id, body): spans are (text_id, start, end), may overlap, and
    together cover what is to be removed; survivors are the texts that can have any, with their bodies."""
    longs = texts.where(F.octet_length("body") >= length)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, places, counts = [], [], []
            for body in batch.column(1):
                at, h = anchors(np.frombuffer(body.as_buffer(), np.uint8), length, gram)
                grams.append(h.view(np.int64))
                places.append(at)
                counts.append(len(at))
            if grams:
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), ids, pa.array(np.concatenate(places))], ["gram", "text_id", "pos"])

    found = stage(over_texts(longs, scan, "gram long, text_id binary, pos long"), "anchors")
    key = F.xxhash64("text_id", "pos")
    twice = stage(
        found.groupBy("gram").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n"))
        .where("low < high").select("gram", "n"), "twice")
    total, most = twice.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    places = found.join(twice, "gram").groupBy("text_id").agg(
        F.collect_list(F.struct("pos", "gram", (F.col("n") > class_items).alias("big"))).alias("places"))
    places = stage(places, "places")
    longs = marked(longs, F.xxhash64("text_id"), places, F.xxhash64("text_id")).where("_fw_maybe").select("text_id", "body")
    survivors = stage(longs.join(places, "text_id"), "survivors")
    n_parts = max(1, -(-total // PART_ITEMS))
    spans = _merge(_runs(survivors, n_parts, length, gram), length, gram)
    if most > class_items:
        spans = spans.union(_by_counts(survivors, length, gram))
    return stage(spans, "spans"), survivors


def text_key(digest: Column) -> Column:
    """By what a text goes through the runs: the first 16 bytes of its hex digest."""
    return F.unhex(F.substring(digest, 1, 32))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, class_items: int = CLASS_ITEMS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if it is covered by ``length`` bytes of its text that also start anywhere else, overlaps and the
    same text included. Null text is empty; texts shorter than ``length`` stay whole; texts that are there twice
    go whole. Repeated rows and null ids are rows like others. Texts are told apart by SHA-256 and carried by
    the first 128 bits of it, so that even among 10**12 texts two hardly ever share an id.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    given = docs.select("doc_id", body.alias("body")).withColumn("digest", F.sha2("body", 256))
    rows = stage(given.select("doc_id", "digest", F.octet_length("body").cast("long").alias("n_bytes")), "digests")
    copied = stage(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1"), "copied")
    later = stage(
        rows.join(copied, "digest").where(~F.col("doc_id").eqNullSafe(F.col("first")))
        .select(F.col("doc_id").alias("later_id"), F.col("digest").alias("later_digest")), "later")
    once = without(given, later, {"later_id": F.col("doc_id"), "later_digest": F.col("digest")})
    spans, survivors = find_spans(once.select(text_key(F.col("digest")).alias("text_id"), "body"), length, gram, class_items)
    by_text = spans.groupBy("text_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cut = stage(_cut(survivors.dropDuplicates(["text_id"]).join(by_text, "text_id")), "cut")
    whole = (F.col("n") > 1) & (F.col("n_bytes") >= length)
    empty = hashlib.sha256(b"").hexdigest()
    return (
        rows.join(copied.select("digest", "n"), "digest", "left")
        .withColumn("text_id", text_key(F.col("digest"))).join(cut, "text_id", "left")
        .select(
            "doc_id", "n_bytes",
            F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(whole, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        )
    )
