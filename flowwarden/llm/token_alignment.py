"""Cross-tokenizer alignment: groups of tokens between shared byte offsets, and how many documents link each id pair.

Most groups are one token of either tokenizer with the same bytes: those are counted in a vector as long as A's
vocabulary, by a map from A's ids to B's ids of the same bytes. Only the pairs of other groups are shuffled, once a
block of documents.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.common import over_texts, stage

#: Characters and documents of one block; a longer text is a block of its own.
BLOCK_CHARS = 2_000_000
BLOCK_ROWS = 1_000

#: How byte-level vocabularies write bytes: printable ones as themselves, the others as the next free characters.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_BYTE = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: How a byte-level tokenizer of this kind cuts a text into words.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts with other characters, or with words or gaps of such length, are encoded by the file's own library.
_OTHER = re.compile("[^\x00-\x7f¡-ž–—‘-”…€]")
LONG = 400

DOCS = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "same_ids binary, same_links binary, other_pairs binary, other_links binary"
)
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


class ByteBpe:
    """Tokenizer A, of a byte-level BPE file: its ids and their bytes.

    Where the file's merges are in the order of its ids, they serve as ranks of a faster encoder for plain texts; the
    file's own library encodes the others.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        size = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes = [b""] * size
        for token, i in spec["model"]["vocab"].items():
            self.bytes[i] = bytes(map(_AS_BYTE.__getitem__, token))
        for token in spec["added_tokens"]:
            self.bytes[token["id"]] = token["content"].encode()
        self.fast = self._ranked(spec)

    def _ranked(self, spec: dict):
        model, cutter = spec["model"], spec["pre_tokenizer"]
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        plain = cutter["type"] == "ByteLevel" and cutter["use_regex"] and not cutter["add_prefix_space"]
        if not plain or spec["normalizer"] or model.get("ignore_merges") or [vocab[a + b] for a, b in pairs] != list(range(256, 256 + len(pairs))):
            return None
        import tiktoken

        return tiktoken.Encoding("a", pat_str=_WORDS, mergeable_ranks={self.bytes[i]: i for i in vocab.values()}, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or not plain(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def plain(text: str) -> bool:
    """No characters about which libraries might differ, and no very long words or gaps."""
    if not text.isascii() and _OTHER.search(text):
        return False
    lengths = list(map(len, text.split()))
    return max(lengths, default=0) < LONG and len(text) - sum(lengths) < len(lengths) + LONG


class Pieces:
    """Tokenizer B, of a sentence-piece model with bytes as a fallback; it puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = self.model.id_to_piece
        self.bytes = [
            bytes([int(piece(i)[3:5], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode()
            for i in range(self.model.vocab_size())
        ]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def identity_map(a_bytes: list[bytes], b_bytes: list[bytes]) -> np.ndarray:
    """For each id of A the largest id of B with the same bytes, or -1."""
    ids = {b: i for i, b in enumerate(b_bytes) if b}
    return np.array([ids.get(a, -1) if a else -1 for a in a_bytes], np.int64)


class Aligner:
    """Aligns blocks of texts; its tables are made once for a task."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteBpe(a_path), Pieces(b_path)
        self.same = identity_map(self.a.bytes, self.b.bytes)
        self.lengths = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        marks = ((self.a.bytes, ",|"), (self.b.bytes, ",;"))
        self.written = [b"%d%b" % (i, mark.encode()) for vocab, both in marks for mark in both for i in range(len(vocab))]

    def encoded(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of each text; none where the bytes of either differ from the text after a space."""
        a = [self.a(" " + t) if t else [] for t in texts]
        b = self.b(texts)
        for i, text in enumerate(texts):
            whole = b" " + text.encode()
            if not text or b"".join(map(self.a.bytes.__getitem__, a[i])) != whole or b"".join(map(self.b.bytes.__getitem__, b[i])) != whole:
                a[i], b[i] = [], []
        return a, b

    def __call__(self, texts: list[str]) -> dict[str, list]:
        """Columns of ``DOCS`` but ``block`` and ``doc_id``, a value for each text.

        Texts stand one behind another: where one ends tokens of both end, so a group never spans two.
        """
        ids = self.encoded(texts)
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, sum(map(len, x))) for x in ids)
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in ids)
        end_a, end_b = (np.cumsum(length[x]) for length, x in zip(self.lengths, (a, b)))
        ends = end_a[end_b[np.minimum(np.searchsorted(end_b, end_a), len(end_b) - 1)] == end_a] if len(a) else end_a
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        from_a, from_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        doc_of = np.repeat(np.arange(len(texts)), n_a)[from_a] if len(ends) else np.zeros(0, np.int64)

        links = in_a * in_b
        one = links == 1
        one &= np.where(one, self.same[a[from_a]] == b[from_b], False) if len(ends) else one
        rest = np.flatnonzero(~one)
        group = np.repeat(rest, links[rest])
        nth = np.arange(len(group)) - np.repeat(np.cumsum(links[rest]) - links[rest], links[rest])
        pair_a, pair_b = a[from_a[group] + nth // in_b[group]], b[from_b[group] + nth % in_b[group]]
        met = self.same[pair_a] == pair_b  # a pair of equal bytes inside a longer group counts with the vector
        same_doc = np.concatenate([doc_of[one], doc_of[group[met]]])
        same_a = np.concatenate([a[from_a[one]], pair_a[met]])
        same = _counted(same_doc, same_a, len(self.a.bytes), len(texts))
        other = _counted(doc_of[group[~met]], pair_a[~met] * len(self.b.bytes) + pair_b[~met], len(self.a.bytes) * len(self.b.bytes), len(texts))
        return {
            "n_a": n_a.tolist(), "n_b": n_b.tolist(),
            "n_groups": np.bincount(doc_of, minlength=len(texts)).tolist(),
            "n_links": np.bincount(doc_of, weights=links, minlength=len(texts)).astype(np.int64).tolist(),
            "groups_sha256": self._digests(a, b, group_a, group_b, from_a, from_b, in_a, in_b, n_a + n_b),
            "same_ids": same[0], "same_links": same[1], "other_pairs": other[0], "other_links": other[1],
        }

    def _digests(self, a, b, group_a, group_b, from_a, from_b, in_a, in_b, n_tokens) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each text, empty without tokens."""
        size_a, size_b = len(self.a.bytes), len(self.b.bytes)
        order = np.empty(len(a) + len(b), np.int64)
        at_a, at_b = np.arange(len(a)), np.arange(len(b))
        last_a, last_b = at_a == (from_a + in_a - 1)[group_a], at_b == (from_b + in_b - 1)[group_b]
        order[at_a + from_b[group_a]] = a + size_a * last_a
        order[at_b + (from_a + in_a)[group_b]] = 2 * size_a + b + size_b * last_b
        out, at, written = [], 0, self.written.__getitem__
        for n in n_tokens.tolist():
            text = b"".join(map(written, order[at:at + n].tolist()))[:-1]
            out.append(hashlib.sha256(text).hexdigest() if n else "")
            at += n
        return out


def _counted(docs: np.ndarray, keys: np.ndarray, size: int, n_docs: int) -> tuple[list[bytes], list[bytes]]:
    """For each document its distinct keys (8 bytes each) and how often each occurs (4 bytes each)."""
    found, n = np.unique(docs * size + keys, return_counts=True)
    ends = np.searchsorted(found, np.arange(1, n_docs + 1) * size).tolist()
    keys, n = (found % size).astype("<i8"), n.astype("<i4")
    starts = [0, *ends[:-1]]
    return [keys[s:e].tobytes() for s, e in zip(starts, ends)], [n[s:e].tobytes() for s, e in zip(starts, ends)]


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``DOCS`` of each row of ``docs`` (doc_id, text): counts, digest, and its distinct pairs with their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, part, nth = Aligner(a_path, b_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and end - at < BLOCK_ROWS and (end == at or held + len(texts[end]) <= BLOCK_CHARS):
                    held += len(texts[end])
                    end += 1
                found = align(texts[at:end])
                columns = [pa.array([(part << 32) + nth] * (end - at), pa.int64()), batch.column(0).slice(at, end - at)]
                columns += [pa.array(v, _KINDS.get(n, pa.int64())) for n, v in found.items()]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "doc_id", *found])
                at, nth = end, nth + 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return over_texts(rows, run, DOCS)


_KINDS = {"groups_sha256": pa.string()} | {n: pa.binary() for n in ("same_ids", "same_links", "other_pairs", "other_links")}


def same_counts(rows: DataFrame, size: int) -> DataFrame:
    """(a, docs): documents that link an id of A with B's id of the same bytes. Each task adds up one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total[np.frombuffer(ids.as_py(), "<i8")] += 1  # ids of one document are distinct
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["a", "docs"])

    return rows.select("same_ids").mapInArrow(run, "a long, docs long").groupBy("a").agg(F.sum("docs").alias("docs"))


def block_pairs(rows: DataFrame) -> DataFrame:
    """(block, pair, docs): documents of a block that link a pair of other bytes; a hot pair is one row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(blocks)]):
                if end > start:
                    raw = b"".join(batch.column(1).slice(start, end - start).to_pylist())
                    pairs, docs = np.unique(np.frombuffer(raw, "<i8"), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(pairs), blocks[start]), pa.int64()), pa.array(pairs, pa.int64()), pa.array(docs, pa.int64())],
                        names=["block", "pair", "docs"])

    return rows.select("block", "other_pairs").mapInArrow(run, "block long, pair long, docs long").groupBy("block", "pair").agg(
        F.sum("docs").alias("docs"))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text, B the text, before which it puts a space itself; strings of special tokens are plain
    text. Tokens fall into groups between the byte offsets where tokens of both end, and all pairs of a group are linked.
    A pair's count is the number of rows that hold it linked; repeated rows count each, null ids are carried along.
    Null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens: zeros and an
    empty digest. An empty table gives an empty result; other columns play no part.
    """
    sizes = _sizes(a_path, b_path)
    rows = stage(aligned(docs, a_path, b_path), "aligned")
    same = stage(same_counts(rows, sizes[0]), "same-counts")
    held = stage(block_pairs(rows), "block-pairs")
    pairs = stage(held.groupBy("pair").agg(F.sum("docs").alias("total")), "pair-counts")
    size_b = sizes[1]
    best = pairs.groupBy(F.floor(F.col("pair") / size_b).alias("a")).agg(F.max("total").alias("docs")).unionByName(same).groupBy("a").agg(F.max("docs").alias("docs"))
    # both vectors are as long as A's vocabulary at most, whatever the corpus
    same_vector, best_vector = (_vector(x, sizes[0]) for x in (same, best))
    known = held.select("block", "pair").join(pairs, "pair").select("block", "pair", "total")

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("pair")
        keys, totals = right["pair"].to_numpy(np.int64), right["total"].to_numpy(np.int64)
        sums, bests = [], []
        for ids, n_ids, others, n_others in zip(left["same_ids"], left["same_links"], left["other_pairs"], left["other_links"]):
            ids, others = np.frombuffer(ids, "<i8"), np.frombuffer(others, "<i8")
            n = np.concatenate([np.frombuffer(n_ids, "<i4"), np.frombuffer(n_others, "<i4")]).astype(np.int64)
            count = np.concatenate([same_vector[ids], totals[np.searchsorted(keys, others)]])
            a = np.concatenate([ids, others // size_b])
            sums.append(int((n * count).sum()))
            bests.append(int(n[count == best_vector[a]].sum()))
        left = left.assign(n_best=bests, count_sum=sums)
        return left[["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]].astype({"n_best": "int64", "count_sum": "int64"})

    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(one, RESULT)


def _sizes(a_path: str, b_path: str) -> tuple[int, int]:
    return len(ByteBpe(a_path).bytes), len(Pieces(b_path).bytes)


def _vector(counts: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for a, docs in counts.collect():
        out[a] = docs
    return out
