"""Conversation prefix trie: prefixes are grouped by composable fingerprints, without texts of rebuilt conversations.

A sequence of turns has the fingerprint ``F(s + [t]) = F(s) * BASE + e(t)`` modulo a prime; so that of a sequence put
together from a head and a suffix follows from those of the parts: ``F(head) * BASE^k + (F(own, h + k) - F(own, h) *
BASE^k)``. Each row of a rebuilt conversation refers to the stored turn it came from; where a group's rows refer to
different turns, these turns are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowwarden.llm.common import n_words, over_texts, stage

#: Turns of another conversation a rebuilt one may begin with; at most so many of each are kept at hand.
MAX_HEAD = 3
PRIME = 2**127 - 1
BASE = 0x2F0B4C66A3D99E1B5C7F8A1D0E6B3A57
INVERSE = pow(BASE, -1, PRIME)
#: Conversation ids, and depths of one path, that a single row or window takes at once.
BLOCK = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
ZERO = bytes(16)


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % 20


def head_of(conv_id: Column) -> Column:
    """How many turns of the base a conversation begins with: 0 to 3 by its id's CRC-32."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def element(role: str, text: str, seed: int = 0) -> int:
    """What one turn stands for in a fingerprint."""
    role = role.encode()
    return int.from_bytes(hashlib.sha256(b"%d:%d:%b%b" % (seed, len(role), role, text.encode())).digest()[:16], "big") % PRIME


def put(x: int) -> bytes:
    return x.to_bytes(16, "big")


def got(x: bytes) -> int:
    return int.from_bytes(x, "big")


def extended(front: int, tail: int, length: int) -> int:
    """The fingerprint of a sequence followed by one of ``length`` turns."""
    return (front * pow(BASE, length, PRIME) + tail) % PRIME


def cut(whole: int, front: int, length: int) -> int:
    """The fingerprint of the last ``length`` turns of ``whole``, whose other turns have the fingerprint ``front``."""
    return (whole - front * pow(BASE, length, PRIME)) % PRIME


def ordered_turns(conversations: DataFrame, seed: int) -> DataFrame:
    """The stored turns, dealt by ranges of (conv_id, turn, role, text): a conversation of any length is cut over
    tasks. ``at`` counts within the part of a conversation that one task holds, ``run`` is the fingerprint so far."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                text("role").alias("role"), text("text").alias("text"))
    rows = rows.where("conv_id is not null").withColumn("row", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "text", "row"]  # rows that agree in all of it are dealt apart by their place
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, at, print_ = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            places, runs, elements = [], [], []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
                if conv != now:
                    now, at, print_ = conv, 0, 0
                e = element(role, text, seed)
                print_ = extended(print_, e, 1)
                places.append(at)
                runs.append(put(print_))
                elements.append(put(e))
                at += 1
            more = [pa.array([part] * len(places), pa.int64()), pa.array(places, pa.int64()),
                    pa.array(runs, pa.binary()), pa.array(elements, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "part", "at", "run", "elem"])

    columns = rows.select("conv_id", "role", "text", n_words(F.col("text")).alias("words"))
    return over_texts(columns, run, "conv_id long, role string, text string, words long, part long, at long, run binary, elem binary")


def placed_turns(turns: DataFrame) -> DataFrame:
    """``turns`` with their place in the whole conversation from 1 (``pos``) and the fingerprint up to there (``print``).

    What is carried over is one row for each part of a conversation that several tasks hold: a task holds at most two
    such, its first and its last, so the table has no more than twice as many rows as there were tasks.
    """
    parts = stage(turns.groupBy("conv_id", "part").agg(F.max("at").alias("last")), "trie-parts")
    several = parts.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id")
    ends = turns.join(F.broadcast(several), "conv_id", "left_semi").join(
        F.broadcast(parts.join(several, "conv_id")), ["conv_id", "part"]).where(F.col("at") == F.col("last"))

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        before, n, out = 0, 0, []
        for conv, part, last, run in pdf.sort_values("part").itertuples(index=False):
            out.append((conv, part, n, put(before)))
            before, n = extended(before, got(run), last + 1), n + last + 1
        return pd.DataFrame(out, columns=["conv_id", "part", "skip", "before"])

    carried = stage(ends.select("conv_id", "part", "last", "run").groupBy("conv_id").applyInPandas(
        carry, "conv_id long, part long, skip long, before binary"), "trie-carried")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, runs, skips, fronts = (batch.column(n).to_pylist() for n in ("at", "run", "skip", "before"))
            pos = [a + 1 + (s or 0) for a, s in zip(at, skips)]
            prints = [r if f is None else put(extended(got(f), got(r), a + 1)) for a, r, f in zip(at, runs, fronts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(pos, pa.int64()), batch.column("words"), batch.column("elem"), pa.array(prints, pa.binary()),
                 batch.column("part"), batch.column("at")], names=["conv_id", "pos", "words", "elem", "print", "part", "at"])

    rows = turns.select("conv_id", "words", "elem", "run", "part", "at").join(F.broadcast(carried), ["conv_id", "part"], "left")
    return rows.mapInArrow(run, "conv_id long, pos long, words long, elem binary, print binary, part long, at long")


def members(placed: DataFrame, base=base_of, head=head_of) -> tuple[DataFrame, DataFrame]:
    """Rows of the rebuilt conversations below the root, and one row (conv_id, length) for each conversation.

    A row holds the fingerprint of the turns so far, that of its parent, and the stored turn (ref_conv, ref_pos) that
    it repeats; no text is touched.
    """
    first = F.when(F.col("pos") <= MAX_HEAD, F.struct("pos", "words", "elem", "print"))
    convs = stage(placed.groupBy("conv_id").agg(F.max("pos").alias("n"), F.sort_array(F.collect_list(first)).alias("firsts")), "trie-convs")
    own = convs.select("*", base(F.col("conv_id")).alias("base"), head(F.col("conv_id")).cast("int").alias("h"))
    fronts = convs.select(F.col("conv_id").alias("base"), F.col("firsts").alias("front"))
    taken = lambda list_, n: F.when(n > 0, F.slice(list_, F.lit(1), n))
    own = own.join(fronts, "base", "left").select(
        "conv_id", "base", "h", "n", F.get("firsts", F.col("h") - 1)["print"].alias("own_front"),
        taken(F.col("front"), F.col("h")).alias("front"))
    own = own.withColumn("taken", F.when(F.col("front").isNull(), 0).otherwise(F.size("front")).cast("long"))
    own = stage(own.select("conv_id", "base", "h", "own_front", "front", "taken", F.element_at("front", -1)["print"].alias("join"),
                           (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-own")
    none = F.lit(None).cast("binary")
    head_rows = own.select("conv_id", "base", "length", F.explode("front").alias("t")).select(
        "conv_id", F.col("t.pos").alias("depth"), "length", F.col("base").alias("ref_conv"), F.col("t.pos").alias("ref_pos"),
        F.col("t.words").alias("words"), F.col("t.elem").alias("elem"), F.col("t.print").alias("print"),
        none.alias("own_front"), none.alias("join"), F.lit(0).cast("long").alias("k"))
    suffix_rows = placed.join(own.drop("front", "base"), "conv_id").where(F.col("pos") > F.col("h")).select(
        "conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "length", F.col("conv_id").alias("ref_conv"),
        F.col("pos").alias("ref_pos"), "words", "elem", "print", "own_front", "join", (F.col("pos") - F.col("h")).alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, parents = [], []
            for e, p, own_front, joint, k in zip(*(batch.column(n).to_pylist() for n in ("elem", "print", "own_front", "join", "k"))):
                p = got(p)
                if k:
                    tail = cut(p, got(own_front), k) if own_front else p
                    p = extended(got(joint) if joint else 0, tail, k)
                prints.append(put(p))
                parents.append(put((p - got(e)) * INVERSE % PRIME))
            kept = ["conv_id", "depth", "length", "ref_conv", "ref_pos", "words", "elem"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(prints, pa.binary()), pa.array(parents, pa.binary())],
                names=[*kept, "print", "parent"])

    schema = "conv_id long, depth long, length long, ref_conv long, ref_pos long, words long, elem binary, print binary, parent binary"
    return head_rows.unionByName(suffix_rows).mapInArrow(run, schema), own.select("conv_id", "length")


def groups(rows: DataFrame) -> DataFrame:
    """One row for each (depth, print, parent, elem); hot prefixes are added up before the shuffle."""
    ends = [f(F.col(c)).alias(f"{n}_{c}") for c in ("ref_conv", "ref_pos") for n, f in (("least", F.min), ("most", F.max))]
    return rows.groupBy("depth", "print", "parent", "elem").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), *ends)


def sound(nodes: DataFrame, rows: DataFrame, turns: DataFrame, placed: DataFrame) -> bool:
    """Whether every group holds one sequence: one parent and one element a fingerprint, and equal last turns.

    A group whose rows refer to one stored turn needs no look. Of the others the turns referred to are fetched, each
    once a group, and their least and greatest role and text compared; with equal parents this makes whole sequences
    equal, depth by depth.
    """
    if not nodes.groupBy("depth", "print").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    mixed = nodes.where("least_ref_conv <> most_ref_conv or least_ref_pos <> most_ref_pos").select("depth", "print")
    refs = rows.join(mixed, ["depth", "print"]).select(
        "depth", "print", F.col("ref_conv").alias("conv_id"), F.col("ref_pos").alias("pos")).distinct()
    bodies = placed.select("conv_id", "pos", "part", "at").join(turns.select("conv_id", "part", "at", "role", "text"), ["conv_id", "part", "at"])
    met = refs.join(bodies, ["conv_id", "pos"]).groupBy("depth", "print").agg(
        *[f(c).alias(f"{n}_{c}") for c in ("role", "text") for n, f in (("least", F.min), ("most", F.max))])
    return met.where("least_role <> most_role or least_text <> most_text").isEmpty()


def subtree_totals(paths: DataFrame, sums: list[str]) -> DataFrame:
    """``paths`` (conv_id, above, *sums*) form a tree; each with the sums over itself and all below it.

    In round k a path hands its sums to the one 2^k steps above and then looks twice as far, so the rounds are the
    logarithm of the tree's depth, and what is handed to one path is added up before it is shuffled.
    """
    now = stage(paths, "trie-paths")
    while not now.where("above is not null").isEmpty():
        handed = now.where("above is not null").groupBy(F.col("above").alias("conv_id")).agg(*[F.sum(s).alias(f"more_{s}") for s in sums])
        further = now.select(F.col("conv_id").alias("above"), F.col("above").alias("next"))
        now = stage(
            now.join(handed, "conv_id", "left").join(further, "above", "left")
            .select("conv_id", F.col("next").alias("above"), *[(F.col(s) + F.coalesce(f"more_{s}", F.lit(0))).alias(s) for s in sums]), "trie-paths")
    return now.drop("above")


def below_sums(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """``nodes`` (conv_id, depth, up, *sums*) with the sums over each node's subtree.

    A node belongs to its smallest member, and with it all of that conversation's deeper nodes: the trie falls into
    paths, one a conversation at most. Whole paths are added up as a tree; along a path the sums run from its end, in
    blocks of depth, so that no long path is one window's.
    """
    tops = nodes.where("up is null or up <> conv_id").select("conv_id", F.col("up").alias("above"), (F.col("depth") - 1).alias("joint"))
    own = nodes.groupBy("conv_id").agg(*[F.sum(s).alias(s) for s in sums])
    tops = stage(tops, "trie-tops")
    totals = subtree_totals(own.join(tops, "conv_id").select("conv_id", "above", *sums), sums)
    hung = totals.join(tops, "conv_id").where("above is not null").groupBy(F.col("above").alias("conv_id"), F.col("joint").alias("depth")).agg(
        *[F.sum(s).alias(f"hung_{s}") for s in sums])
    held = nodes.join(hung, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", F.floor(F.col("depth") / BLOCK).alias("block"),
        *[(F.col(s) + F.coalesce(f"hung_{s}", F.lit(0))).alias(s) for s in sums])
    held = stage(held, "trie-held")
    after = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = held.groupBy("conv_id", "block").agg(*[F.sum(s).alias(s) for s in sums]).select(
        "conv_id", "block", *[F.coalesce(F.sum(s).over(after), F.lit(0)).alias(f"after_{s}") for s in sums])
    within = Window.partitionBy("conv_id", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return held.select("conv_id", "depth", "block", *[F.sum(s).over(within).alias(s) for s in sums]).join(
        blocks, ["conv_id", "block"]).select("conv_id", "depth", *[(F.col(s) + F.col(f"after_{s}")).alias(s) for s in sums])


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of ``ends`` (conv_id, depth, member): SHA-256 of the members in order.

    Members are first written out in blocks of ids, so the one task that has to read a node's members in order gets a
    row for thousands of them, and holds one at a time.
    """
    blocks = ends.groupBy("conv_id", "depth", F.floor(F.col("member") / BLOCK).alias("block")).agg(
        F.array_join(F.sort_array(F.collect_list("member")).cast("array<string>"), ",").alias("written"))
    names = ["conv_id", "depth", "ends_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for conv, depth, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv, depth) != now:
                    done += [(*now, digest.hexdigest())] if now else []
                    now, digest = (conv, depth), hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            yield _digest_rows(done, names)
        if now:
            yield _digest_rows([(*now, digest.hexdigest())], names)

    rows = blocks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block")
    return rows.select("conv_id", "depth", "written").mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def _digest_rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def prefix_trie(conversations: DataFrame, base=base_of, head=head_of, seeds: int = 4) -> DataFrame:
    """Per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    ``conversations`` has a row a turn (conv_id, turn, role, text). ``base`` gives the conversation that lends its
    first turns (absent or null: none), ``head`` how many (0 to ``MAX_HEAD``, counted in the lender's own turns).
    Turns are ordered by turn (null first), equal ones by role and text; repeated rows are turns of their own; null
    roles and texts are empty; rows without a conv_id belong to no conversation and are left out; other columns play
    no part; an empty table has no nodes. Should a fingerprint be that of two sequences, all are made anew with
    another seed.
    """
    for seed in range(seeds):
        turns = stage(ordered_turns(conversations, seed), "trie-turns")
        placed = stage(placed_turns(turns), "trie-placed")
        rows, convs = members(placed, base, head)
        rows = stage(rows, "trie-members")
        nodes = stage(groups(rows), "trie-groups")
        if sound(nodes, rows, turns, placed):
            return _described(nodes, rows, convs)
    raise RuntimeError("no seed tells the sequences apart")


def _described(nodes: DataFrame, rows: DataFrame, convs: DataFrame) -> DataFrame:
    below = nodes.select("conv_id", "depth", "print", "parent", "n_convs", "words")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ZERO).alias("print"), F.lit(None).cast("binary").alias("parent"),
        "n_convs", F.lit(0).cast("long").alias("words"))
    nodes = stage(below.unionByName(root), "trie-nodes")
    ups = nodes.select(F.col("conv_id").alias("up"), (F.col("depth") + 1).alias("depth"), F.col("print").alias("parent"))
    nodes = nodes.join(ups, ["depth", "parent"], "left")
    children = nodes.where("up is not null").groupBy(F.col("up").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = stage(nodes.join(children, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "up", "print", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), "trie-nodes")
    sums = below_sums(nodes.select("conv_id", "depth", "up", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"])
    last = rows.where("depth = length").select("depth", "print", F.col("conv_id").alias("member")).unionByName(
        convs.where("length = 0").select(F.col("length").alias("depth"), F.lit(ZERO).alias("print"), F.col("conv_id").alias("member")))
    ends = end_digests(last.join(nodes.select("depth", "print", "conv_id"), ["depth", "print"]).select("conv_id", "depth", "member"))
    return nodes.drop("n_leaves", "saved_tokens").join(sums, ["conv_id", "depth"]).join(ends, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
