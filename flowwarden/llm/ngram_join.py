"""N-gram Jaccard join: a blocked sparse product of the document by n-gram matrix, cut by bounds that follow from sizes.

Rows of the matrix are the distinct n-gram sets, columns are n-grams. Two sets of sizes a and b link when
100 * overlap >= percent * union, so their overlap is at least ``percent`` of either size. If all n-grams are
put in one order, the first ``size - least overlap + 1`` of either set must then share one, so only those
entries of the matrix are multiplied. The order puts n-grams that many documents share last, so columns are
short. Products are added up by pair, and a pair goes on only if what its first entries already differ by
leaves room for the overlap that its sizes ask for; so do the parities of its whole rows. What is left is counted
on the whole rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.common import components, marked, over_texts, stage, without

#: Counters of the sketch that tells common n-grams from rare ones, as a power of two, and how far above their
#: mean (and above a floor) a counter makes its n-grams common. They set speed, never the result.
SKETCH_BITS = 21
COMMON_FLOOR = 64
COMMON_TIMES_MEAN = 4
#: Words a task remembers with their hashes.
MEMORY_WORDS = 200_000
U64 = np.uint64
_K1, _K2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9)
BLOCK = 1 << 14


class Hashes(dict):
    """Word -> its hash. A task holds one of its own, so that nothing outlives the task in a worker that is used again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def ngram_set(text: str | None, n: int, known: Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; the whole sequence is one if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, U64)
    w = np.fromiter(map(known.__getitem__, words), U64, len(words))
    k = min(n, len(w))
    acc = np.full(len(w) - k + 1, k, U64)
    for j in range(k):
        acc = (acc ^ w[j:len(w) - k + 1 + j]) * _K1
        acc ^= acc >> U64(29)
        acc *= _K2
        acc ^= acc >> U64(32)
    return np.unique(acc)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def common_columns(docs: DataFrame, n: int) -> np.ndarray:
    """One flag per counter: whether the n-grams that fall on it are common. Counts cover all documents.

    Each task counts into a fixed array; arrays are added up block by block, one row at a time.
    """
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        waiting, some, known = [], 0, Hashes()
        for batch in batches:
            for t in batch.column(0):
                waiting.append((ngram_set(t.as_py(), n, known) >> U64(64 - SKETCH_BITS)).astype(np.int64))
                some += len(waiting[-1])
                if some > size:
                    held += np.bincount(np.concatenate(waiting), minlength=size)
                    waiting, some = [], 0
        if waiting:
            held += np.bincount(np.concatenate(waiting), minlength=size)
        held = np.minimum(held, 65_535).astype(np.uint16).reshape(-1, BLOCK)
        some = np.flatnonzero(held.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([held[i].tobytes() for i in some], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[block] = held.get(block, 0) + np.frombuffer(counts, np.uint16).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*held], pa.int32()), pa.array([c.tobytes() for c in held.values()], pa.binary())], ["block", "counts"])

    sums = stage(
        over_texts(_texts(docs).select("text"), count, "block int, counts binary")
        .repartition("block").mapInArrow(add, "block int, counts binary"), "columns")
    total = np.zeros((size // BLOCK, BLOCK), np.int64)
    for row in sums.collect():  # a fixed number of blocks, whatever the input
        total[row["block"]] = np.frombuffer(row["counts"], np.int64)
    total = total.ravel()
    return total > max(COMMON_FLOOR, COMMON_TIMES_MEAN * total.mean())


def parities(grams: np.ndarray) -> bytes:
    """One bit for each residue of the hashes, as many as the next power of two from the size on (8 at least): whether
    an odd number of them has it. Two sets differ in no fewer elements than their parities differ in bits."""
    bits = 1 << max(3, (len(grams) - 1).bit_length())
    return np.packbits(np.bincount((grams & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).view(np.uint8).tobytes()


def short_parities(grams: np.ndarray) -> np.ndarray:
    """Parities by 256 residues as four 64-bit numbers: narrow enough to travel with every entry."""
    odd = np.bincount((grams & U64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd).view(np.int64)


def least_difference(a: bytes, b: bytes) -> int:
    """Elements in which the sets behind two parities differ, at least. The longer one is folded first."""
    x, y = (np.unpackbits(np.frombuffer(p, np.uint8)) for p in (a, b))
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2:]
    return int((x ^ y).sum())


def leading_entries(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per row of ``docs``: doc_id, size, a 128-bit digest (a, b) of its set, its parities (long and short), and the
    leading entries of its row."""
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(np.packbits(common_columns(docs, n)))  # 2**SKETCH_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, known = np.unpackbits(common.value).astype(bool), Hashes()
        for batch in batches:
            sizes, a, b, odd, short, first = [], [], [], [], [], []
            for t in batch.column(1):
                grams = ngram_set(t.as_py(), n, known)
                digest = np.frombuffer(hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), np.int64)
                late = flags[(grams >> U64(64 - SKETCH_BITS)).astype(np.int64)]
                keep = len(grams) - -(-percent * len(grams) // 100) + 1 if len(grams) else 0
                sizes.append(len(grams))
                a.append(digest[0])
                b.append(digest[1])
                odd.append(parities(grams))
                short.append(short_parities(grams))
                first.append(np.concatenate([grams[~late], grams[late]])[:keep].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                 pa.array(odd, pa.binary()), pa.array(short, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64()))],
                ["doc_id", "size", "a", "b", "odd", "short", "first"])

    return over_texts(_texts(docs), run, "doc_id long, size long, a long, b long, odd binary, short array<long>, first array<long>")


def whole_rows(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, grams): the whole sets of the documents in ``nodes``, and of a few others that find no partner later.

    The documents are read once more and screened by a map of fixed size, so their texts are never shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            grams = [ngram_set(t.as_py(), n, known).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary())], ["node", "grams"])

    rows = _texts(docs).where("doc_id is not null")
    rows = marked(rows, F.xxhash64("doc_id"), nodes, F.xxhash64("node")).where("_fw_maybe").select("doc_id", "text")
    return over_texts(rows, run, "node long, grams binary")


def _close(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose sizes and parities leave room for a link."""
    left = sets.select(F.col("node").alias("u"), F.col("size").alias("nu"), F.col("odd").alias("ou"))
    right = sets.select(F.col("node").alias("v"), F.col("size").alias("nv"), F.col("odd").alias("ov"))

    def room(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for nu, nv, ou, ov in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                need = -(-percent * (nu + nv) // (100 + percent))
                keep.append(least_difference(ou, ov) <= nu + nv - 2 * need)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(left, "u").join(right, "v").select("u", "v", "nu", "nv", "ou", "ov")
    return met.mapInArrow(room, "u long, v long")


def links(docs: DataFrame, pairs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose whole rows overlap enough. A hot document's pairs are split by the joins."""
    pairs = stage(_close(pairs, sets, percent), "close")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    rows = stage(whole_rows(docs, nodes, n), "rows")
    left = rows.select(F.col("node").alias("u"), F.col("grams").alias("gu"))
    right = rows.select(F.col("node").alias("v"), F.col("grams").alias("gv"))

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(g.as_py(), U64) for g in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(left, "u").join(right, "v").select("u", "v", "gu", "gv")
    return met.mapInArrow(enough, "u long, v long")


def _least(size: Column, percent: int) -> Column:
    return F.ceil(F.lit(percent) * size / F.lit(100)).cast("long")


def _hub_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """Each node with the two that most of its columns name as their first or last: a column's rows of like size
    are tied to one row and not to each other, so a group of any size costs one pair a row."""
    band = F.floor(F.log(F.col("size")) / F.log(F.lit(100.0 / percent))).alias("band")
    entries = shared.select("gram", "node", "size", band)
    ends = stage(entries.groupBy("gram", "band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high"), "hubs")
    met = entries.join(ends, ["gram", "band"]).select(
        "node", "size", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("low").alias("hub")),
                                          F.struct(F.lit(1).alias("end"), F.col("high").alias("hub")))).alias("e"))
    votes = met.where("node != e.hub").groupBy("node", "e.end", "e.hub").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    votes = votes.where(F.col("n") * 3 >= F.col("size") - _least(F.col("size"), percent) + 1)
    best = votes.groupBy("node", "end").agg(F.max(F.struct("n", "hub")).alias("b"))
    return best.select(F.least("node", "b.hub").alias("u"), F.greatest("node", "b.hub").alias("v")).distinct()


def _product_pairs(shared: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of rows from different groups that share columns, their products added up and cut by the bounds.

    Of each column the rows outside its largest group are multiplied with all rows, so a large group that is
    linked already is never multiplied with itself; and of the products only those are made whose sizes and short
    parities leave room for a link.
    """
    rows = stage(
        shared.join(labels.select("node", "component"), "node", "left")
        .select("gram", "node", "size", "pos", F.coalesce("component", "node").alias("group")), "grouped")
    held = rows.groupBy("gram", "group").agg(F.count("*").alias("n"))
    mixed = stage(
        held.groupBy("gram").agg(F.max(F.struct("n", "group"))["group"].alias("largest"), F.count("*").alias("groups"))
        .where("groups > 1").select("gram", "largest"), "mixed")
    rows = stage(rows.join(mixed, "gram"), "open")
    rows = stage(rows.join(sets.select("node", *[F.col("short")[i].alias(f"s{i}") for i in range(4)]), "node"), "open")
    names = ("node", "size", "pos", "group", "s0", "s1", "s2", "s3")
    x = rows.where("group != largest").select("gram", *[F.col(c).alias(f"x_{c}") for c in names])
    y = rows.select("gram", "largest", *[F.col(c).alias(f"y_{c}") for c in names])
    apart = ((F.col("y_group") == F.col("largest")) | (F.col("x_group") < F.col("y_group"))) & (F.col("x_group") != F.col("y_group"))
    near = (F.lit(100) * F.least("x_size", "y_size") >= F.lit(percent) * F.greatest("x_size", "y_size"))
    differ = sum((F.bit_count(F.col(f"x_s{i}").bitwiseXOR(F.col(f"y_s{i}"))) for i in range(1, 4)), F.bit_count(F.col("x_s0").bitwiseXOR(F.col("y_s0"))))
    both = F.col("x_size") + F.col("y_size")
    room = differ <= both - 2 * F.ceil(F.lit(percent) * both / F.lit(100 + percent))
    met = x.join(y, "gram").where(apart & near & room)
    turned = F.col("x_node") > F.col("y_node")
    pick = lambda c, first: F.when(turned == F.lit(first), F.col(f"y_{c}")).otherwise(F.col(f"x_{c}"))
    sums = met.select(
        pick("node", True).alias("u"), pick("node", False).alias("v"), pick("pos", True).alias("pu"),
        pick("pos", False).alias("pv"), (F.col("x_size") + F.col("y_size")).alias("both"),
    ).groupBy("u", "v").agg(F.count("*").alias("n"), F.max("pu").alias("pu"), F.max("pv").alias("pv"), F.max("both").alias("both"))
    need = F.ceil(F.lit(percent) * F.col("both") / F.lit(100 + percent))
    return sums.where(F.col("pu") + F.col("pv") + 2 - 2 * F.col("n") <= F.col("both") - 2 * need).select("u", "v")


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id it is linked with).

    Equal sets are one row of the matrix. A first round ties each row to the ends of its columns, so that large
    groups of near copies become one group without a product of their own; a second round multiplies all that
    is not yet in one group, so no link between groups is missed. Texts without words link with nothing. Rows
    without a doc_id link with nothing and get no component. Repeated rows get the same result; rows of one id and
    different texts count as linked. Hashes have 64
    bits; within the two sets of a pair they collide about once in 10**13 pairs of 1,000 n-grams.
    """
    first = stage(leading_entries(docs, n, percent), "leading")
    full = first.where("size > 0 and doc_id is not null")
    sets = stage(full.groupBy("a", "b", "size").agg(F.min("doc_id").alias("node")), "sets")
    members = stage(
        full.join(sets, ["a", "b", "size"])
        .select("doc_id", "size", "node", *[F.when(F.col("doc_id") == F.col("node"), F.col(c)).alias(c) for c in ("odd", "short", "first")]),
        "members")
    sets = members.where("first is not null").select("node", "size", "odd", "short")
    entries = members.where("first is not null").select("node", "size", F.posexplode("first").alias("pos", "gram"))
    columns = stage(
        entries.groupBy("gram").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("gram"),
        "columns")
    shared = stage(entries.join(columns, "gram"), "shared")
    near = stage(links(docs, stage(_hub_pairs(shared, percent), "pairs"), sets, n, percent), "links")
    labels = stage(components(near), "labels")
    more = stage(links(docs, stage(_product_pairs(shared, labels, sets, percent), "pairs"), sets, n, percent), "links")
    if not more.isEmpty():
        tied = labels.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)
        labels = stage(components(tied), "labels")
    rest = first.where("size = 0 or doc_id is null").select("doc_id", "size", F.col("doc_id").alias("node"))
    known = members.select("doc_id", "size", "node").union(rest)
    return known.join(labels, "node", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that a linked row of a smaller doc_id stands for; rows without an id stay."""
    gone = stage(join(docs, n, percent).where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return without(docs, gone, {"_gone": F.col("doc_id")})
