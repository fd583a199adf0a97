"""Exact dedup: binary-fuse filters of an immutable snapshot screen a new batch; positives are compared byte by byte."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.common import marked, stage, without

#: Digests of one filter; it bounds what a task holds.
SHARD_KEYS = 100_000
U64 = np.uint64


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(U64) + U64((seed * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _shape(n: int) -> tuple[int, int]:
    """Length of a segment and number of first segments for n keys in three segments each."""
    length = 1 << min(18, max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))
    return length, max(1, -(-int(n * factor) // length) - 1)


def _slots(h: np.ndarray, length: int, first: int) -> np.ndarray:
    """The three slots of each key, in three neighbouring segments."""
    mask = U64(length - 1)
    a = ((h >> U64(32)) * U64(length * first)) >> U64(32)
    b = (a + U64(length)) ^ ((h >> U64(18)) & mask)
    c = (a + U64(2 * length)) ^ (h & mask)
    return np.stack([a, b, c]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> U64(32))) & U64(0xFFFF)).astype(np.uint16)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, first segments, 16-bit cells) of a 3-wise binary-fuse filter.

    Keys are peeled in layers: all slots held by one key only are freed at once; cells are then set from the
    last layer to the first. A seed under which some keys cannot be peeled is given up for the next one.
    """
    keys = np.unique(keys.astype(U64))
    length, first = _shape(len(keys))
    for seed in range(1, 1000):
        h = _mixed(keys, seed)
        slots = _slots(h, length, first)
        size = length * (first + 2)
        held = np.bincount(slots.ravel(), minlength=size)
        who = np.zeros(size, np.int64)
        index = np.arange(len(keys))
        for row in slots:
            np.bitwise_xor.at(who, row, index)
        layers, left = [], len(keys)
        free = np.flatnonzero(held == 1)
        while len(free):
            owners, at = np.unique(who[free], return_index=True)
            layers.append((owners, free[at]))
            left -= len(owners)
            gone = slots[:, owners]
            for row in gone:
                np.subtract.at(held, row, 1)
                np.bitwise_xor.at(who, row, owners)
            touched = np.unique(gone)
            free = touched[held[touched] == 1]
        if left == 0:
            break
        if seed % 10 == 0:
            first += 1 + first // 8
    else:
        raise RuntimeError("no seed peels these keys")
    cells = np.zeros(size, np.uint16)
    prints = _prints(h)
    for owners, at in reversed(layers):
        a, b, c = slots[:, owners]
        cells[at] = 0
        cells[at] = prints[owners] ^ cells[a] ^ cells[b] ^ cells[c]
    return seed, length, first, cells.tobytes()


def may_hold(keys: np.ndarray, seed: int, length: int, first: int, cells: bytes) -> np.ndarray:
    """True for every key of the filter and for about one in 65,536 others."""
    table = np.frombuffer(cells, np.uint16)
    h = _mixed(keys, seed)
    a, b, c = _slots(h, length, first)
    return _prints(h) == (table[a] ^ table[b] ^ table[c])


def build_filters(groups: DataFrame, n_shards: int) -> DataFrame:
    """One filter for each shard of the digests of a snapshot."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, length, first, cells = build_filter(pdf["key"].to_numpy())
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "seed": [seed], "length": [length], "first": [first], "cells": [cells]})

    return _sharded(groups, n_shards).select("shard", "key").groupBy("shard").applyInPandas(
        one, "shard long, seed long, length long, first long, cells binary")


def screen(groups: DataFrame, filters: DataFrame, n_shards: int) -> DataFrame:
    """``groups`` with ``maybe``: false if the digest is surely not in the snapshot."""

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        maybe = np.zeros(len(left), bool)
        if len(right) and len(left):
            f = right.iloc[0]
            maybe = may_hold(left["key"].to_numpy(), int(f["seed"]), int(f["length"]), int(f["first"]), f["cells"])
        return left.drop(columns=["shard", "key"]).assign(maybe=maybe)

    return _sharded(groups, n_shards).groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(
        one, "digest string, top long, n long, maybe boolean")


def _sharded(groups: DataFrame, n_shards: int) -> DataFrame:
    key = F.xxhash64("digest")
    return groups.withColumn("key", key).withColumn("shard", F.pmod(F.hash("digest"), F.lit(n_shards)).cast("long"))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of the text in UTF-8; null counts as empty."""
    return docs.select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("digest"))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("top"), F.count("*").alias("n"))


def exact_groups(docs: DataFrame, incoming=None, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``incoming`` is a condition on doc_id that says which rows are the new batch (by default every second id by
    hash); the others are the snapshot. The snapshot's digests, one per distinct text, go into one filter a
    shard. The batch is grouped by itself, its digests are screened, and only positives are joined with the
    snapshot's digests, where one text of either side is compared byte by byte. What the split is does not
    change the result. The row with the largest doc_id stays; a null id stays only if its group has no other;
    rows that repeat the kept row with its id all count as kept. An empty table gives an empty result.
    """
    incoming = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1 if incoming is None else incoming
    rows = stage(digests(docs).withColumn("fresh", incoming), "digests")
    old = stage(_groups(rows.where(~F.col("fresh"))), "snapshot")
    new = stage(_groups(rows.where("fresh")), "batch")
    n_shards = max(1, -(-max(old.count(), new.count()) // shard_keys))
    filters = stage(build_filters(old, n_shards), "filters")
    hits = stage(
        screen(new, filters, n_shards).where("maybe")
        .join(old.select("digest", F.col("top").alias("old_top"), F.col("n").alias("old_n")), "digest"), "hits")
    same = _byte_checked(docs, hits)
    both = hits.join(same, "digest").select(
        "digest", F.greatest("top", "old_top").alias("keep_id"), (F.col("n") + F.col("old_n")).alias("group_size"))
    both = stage(both, "joined")
    alone = [
        side.join(both.select("digest"), "digest", "left_anti")
        .select("digest", F.lit(fresh).alias("fresh"), F.col("top").alias("keep_id"), F.col("n").alias("group_size"))
        for side, fresh in ((old, False), (new, True))
    ]
    shared = both.select("digest", F.explode(F.array(F.lit(False), F.lit(True))).alias("fresh"), "keep_id", "group_size")
    found = stage(shared.unionByName(alone[0]).unionByName(alone[1]), "groups")
    return rows.join(found, ["digest", "fresh"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def _byte_checked(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Digests whose texts on both sides are the same bytes. Only the kept row of either side is fetched."""
    ends = hits.select("digest", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("old_top").alias("id")),
        F.struct(F.lit(1).alias("side"), F.col("top").alias("id")))).alias("e")).select("digest", "e.side", "e.id")
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("body"))
    texts = marked(texts, F.xxhash64("doc_id"), ends, F.xxhash64("id")).where("_fw_maybe")
    texts = texts.withColumn("body_digest", F.sha2(F.col("body").cast("binary"), 256))
    met = ends.join(texts, ends["id"].eqNullSafe(texts["doc_id"]) & (ends["digest"] == texts["body_digest"]))
    body = [F.max(F.when(F.col("side") == s, F.col("body"))) for s in (0, 1)]
    return met.groupBy("digest").agg(body[0].alias("a"), body[1].alias("b")).where("a = b").select("digest")


def drop_copies(docs: DataFrame, **rules) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns; of rows that repeat the kept one, id included, one stays."""
    judged = stage(exact_groups(docs, **rules), "judged")
    ends = [F.col("doc_id").alias("_fw_id"), F.col("text_sha256").alias("_fw_digest")]
    gone = judged.where(~F.col("kept")).select(*ends).distinct()
    again = judged.where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).where("n > 1")
    again = stage(again.select(*ends), "again")
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)
    keys = {"_fw_id": docs["doc_id"], "_fw_digest": digest}
    if again.isEmpty():
        return without(docs, stage(gone, "gone"), keys)
    rest = without(docs, stage(gone.union(again), "gone"), keys)
    same = docs["doc_id"].eqNullSafe(F.col("_fw_id")) & (digest == F.col("_fw_digest"))
    return rest.unionByName(docs.join(again, same).dropDuplicates(["_fw_id", "_fw_digest"]).drop("_fw_id", "_fw_digest"))
