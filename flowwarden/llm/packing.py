"""Packing: each document is cut into pieces of power-of-two lengths, and equal lengths share a bucket."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.common import over_texts

MAX_LENGTH = 4096
END_ID = 2
#: Rows whose pieces are handed back together.
BATCH_ROWS = 500

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket long, ids binary"
)
#: Letters whose lower case is one letter of its own in any library, and marks that are neither letter nor number.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e"
_MARKS = "\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018-\u201d\u2026"
#: The parts of a lower-cased word that the tokenizer encodes one by one.
_PARTS = re.compile(f"[{_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^{_LETTERS}0-9\\s]+")
#: Texts that are left to the tokenizer as a whole.
_OTHER = re.compile(f"[\x01\x1c-\x1f]|<\\||[^\x00-\x7f{_LETTERS}{_MARKS}]")
_CONTROL = re.compile("[\x01\x1c-\x1f]")


#: Byte-level vocabularies write a byte as a printable character: itself, or for the others the next free one.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_BYTE = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Stands for the end of a word; texts that hold it go to the tokenizer as a whole, so do those with such long words.
_STOP = "\x01"
LONG = 400


def _word_end_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as byte strings with their ids as ranks, a word's end written as one more byte.

    Ends have lower ids than any merge, so they are joined to their word's last byte first, and what follows are the
    file's own merges in their order. None if the file's merges are not in the order of its ids.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != list(range(512, 512 + len(merged))):
        return None
    spelt = lambda t: bytes(map(_AS_BYTE.__getitem__, t))
    return {spelt(t.removesuffix(end)) + (_STOP.encode() if t.endswith(end) else b""): i for t, i in vocab.items()}


class WordIds:
    """Token ids of texts, by way of their words.

    The tokenizer lower-cases, drops white space and encodes runs of letters, digits and runs of marks one by one. The
    parts of a plain text are cut here, and their merges made by a faster encoder from the same vocabulary. Texts with
    a special string, or with characters about which Python and the tokenizer might differ, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ranks = _word_end_ranks(path)
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        """The ids of the text and the end mark, four bytes each."""
        plain = text.isascii() and "<|" not in text and not _CONTROL.search(text)
        if self.fast and (plain or not _OTHER.search(text)):
            parts = _PARTS.findall(text.lower())
            if max(map(len, parts), default=0) < LONG:
                return np.array(self.fast.encode_ordinary(f"{_STOP} ".join([*parts, ""])), "<u4").tobytes() + _END
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids + [END_ID], "<u4").tobytes()


_END = np.array([END_ID], "<u4").tobytes()


def cuts(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of n tokens: as many of ``longest`` as fit, then the binary digits of the rest."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, tokenizer_path: str, longest: int = MAX_LENGTH, with_ids: bool = True) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text); a null text is empty, so is its end mark alone.

    No text is cut off: very long ones give many pieces. Repeated rows give their pieces again; null ids are
    carried along. ``longest`` is a power of two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordIds(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                yield _rows(part.column(0), (encode(t.as_py() or "") for t in part.column(1)), longest, with_ids)

    fields = PIECES if with_ids else PIECES.rsplit(",", 1)[0]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return over_texts(rows, run, fields)


def _rows(ids: pa.Array, tokens: Iterator[bytes], longest: int, with_ids: bool) -> pa.RecordBatch:
    of, start, length, crc, total, body = [], [], [], [], [], []
    for i, raw in enumerate(tokens):
        at = 0
        for n in cuts(len(raw) // 4, longest):
            part = raw[4 * at:4 * (at + n)]
            of.append(i)
            start.append(at)
            length.append(n)
            crc.append(zlib.crc32(part))
            total.append(len(raw) // 4)
            if with_ids:
                body.append(part)
            at += n
    whole = [pa.array(x, pa.int64()) for x in (start, length, crc, total, length)]
    columns = [ids.take(pa.array(of, pa.int64())), *whole] + ([pa.array(body, pa.binary())] if with_ids else [])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "ids"]
    return pa.RecordBatch.from_arrays(columns, names[: len(columns)])


def pack(docs: DataFrame, tokenizer_path: str, longest: int = MAX_LENGTH, with_ids: bool = True) -> DataFrame:
    """The pieces, each a sequence of its own: its length is a power of two, so nothing is padded.

    ``bucket`` is the length; a trainer draws batches of one bucket (``write_buckets``). ``sequence_id`` is the
    place of the piece in its partition, with the partition in its upper bits: unique, the same when a task is
    run again, and made without a sort.
    """
    return pieces(docs, tokenizer_path, longest, with_ids).withColumn(
        "sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str, mode: str = "error") -> None:
    """One folder for each bucket. Rows are dealt by bucket first; a large bucket is split over tasks and small ones are
    put together at run time, so files are of even size. An empty table gives an empty folder."""
    packed.hint("rebalance", "bucket").write.partitionBy("bucket").mode(mode).parquet(path)
