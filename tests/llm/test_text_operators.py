"""Operators on documents against brute force on small tables, with nulls, empties, repeats and clashing names."""

import hashlib
import json
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowwarden.llm import exact_dedup, mixing, ngram_join, packing, suffix_dedup
from flowwarden.llm.registry import tokenizer_path

from .tests_llm_plain import grams, linked, words

EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (1, 50)])
def test_ngram_join(make, prose, n, percent):
    want = linked(prose, n, percent)
    got = ngram_join.join(make(prose, clashes=True), n, percent).collect()
    assert len(got) == len(prose)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    sizes = {(d, len(grams(t, n))) for d, t in ((r[0], r[1]) for r in prose)}
    assert {(r.doc_id, r.n_shingles) for r in got} == sizes
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_ngram_join_of_one_large_group_of_near_copies(make):
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        t = list(base)
        t[i % 150] = f"x{i}"
        rows.append((i, " ".join(t)))
    rows.append((500, " ".join(base[:75] + [f"y{i}" for i in range(75)])))
    got = {r.doc_id: r.component_id for r in ngram_join.join(make(rows), 3, 90).collect()}
    assert got == linked(rows, 3, 90)


def test_ngram_join_keeps_one_of_each(make, prose):
    docs = make(prose, clashes=True)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    want = linked(prose, 5, 80)
    assert sorted((r.doc_id, r.text or "") for r in kept.collect() if r.doc_id is not None) == sorted(
        (r[0], r[1] or "") for r in prose if r[0] is not None and want[r[0]] == r[0])


def test_ngram_join_of_nothing(make):
    assert ngram_join.join(make([])).count() == 0
    assert [tuple(r) for r in ngram_join.join(make([(1, None), (2, "")])).orderBy("doc_id").collect()] == [(1, 0, 1), (2, 0, 2)]


def test_sparse_and_common_columns_give_the_same(make, prose, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON_FLOOR", 0)
    monkeypatch.setattr(ngram_join, "COMMON_TIMES_MEAN", 0.5)
    got = {r.doc_id: r.component_id for r in ngram_join.join(make(prose), 3, 90).collect() if r.doc_id is not None}
    assert got == linked(prose, 3, 90)


def fill(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in held)
        open_ = [s for s in order if s not in held]
        target = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if target[s] > most * sizes[s]}
        if not above:
            return {**{s: Fraction(most * sizes[s]) for s in held}, **target}
        held |= above


def test_mix(make):
    r = np.random.default_rng(2)
    sources = ["b", "a", None, "Z", "é", "\U0001F600"]
    rows = [(i, " ".join(["w"] * int(r.integers(0, 30))), sources[min(int(r.integers(0, 12)), 5) if i % 3 else 0]) for i in range(900)]
    rows += [(5, "w w w", "b"), (5, "w w w", "b"), (None, "w w", "a"), (2000, None, "a"), (2001, "", "only-empty")]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = fill(dict(sizes))
    got = mixing.plan_mix(make(rows, clashes=True)).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for row in got:
        assert row.source_size == sizes[row.source]
        assert row.target == pytest.approx(float(want[row.source]), rel=1e-12)
        assert 0 <= row.copies <= 2
        taken[row.source] += row.copies * row.size
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.15 * t + 100
    again = mixing.plan_mix(make(rows)).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(key, got)) == sorted(map(key, again))
    docs = make(rows, clashes=True)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert Counter(x.doc_id for x in out.collect()) == +sum((Counter({x.doc_id: x.copies}) for x in got), Counter())


def test_mix_of_nothing(make):
    assert mixing.plan_mix(make([])).count() == 0
    assert [x.target for x in mixing.plan_mix(make([(1, None), (2, " ")])).collect()] == [0.0, 0.0]


def test_exact_groups(make, prose):
    groups = {}
    for d, t, *_ in prose:
        groups.setdefault(t or "", []).append(d)
    for split in (None, F.lit(True), F.lit(False), F.col("doc_id") > 30):
        split = split if split is None else F.coalesce(split, F.lit(False))
        got = exact_dedup.exact_groups(make(prose, clashes=True), split, shard_keys=7)
        want = []
        for t, ids in groups.items():
            keep = max((i for i in ids if i is not None), default=None)
            want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert exact_dedup.exact_groups(make([])).count() == 0


def test_drop_copies(make, prose):
    docs = make(prose, clashes=True)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r.text or "" for r in rows) == sorted({r[1] or "" for r in prose})
    assert {r.doc_id for r in rows if r.text == prose[3][1]} == {71}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 30_000])
def test_fuse_filter(n):
    r = np.random.default_rng(n)
    keys = r.integers(0, 2**63, n, dtype=np.uint64)
    made = exact_dedup.build_filter(keys)
    assert exact_dedup.may_hold(keys, *made).all()
    others = r.integers(2**63, 2**64 - 1, 200_000, dtype=np.uint64)
    assert exact_dedup.may_hold(others, *made).mean() < 1e-4


def test_packing(make, prose):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = [r for r in prose] + [(90, "It's 12,345 «x» don't ÀÉÎ <|endoftext|> a\x1cb \u212a Ｆ it's"), (91, "I'M THE ONE'S")]
    got = packing.pack(make(rows, clashes=True), tokenizer_path()).collect()
    ids = {}
    for d, t, *_ in rows:
        ids[d, t] = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
    assert len({r.sequence_id for r in got}) == len(got)
    found = Counter()
    for r in got:
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.bucket == r.length and r.offset == 0
        piece = np.frombuffer(r.ids, "<u4").tolist()
        assert len(piece) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        found[r.doc_id, r.start, tuple(piece), r.doc_tokens] += 1
    want = Counter()
    for d, t, *_ in rows:
        at, whole = 0, ids[d, t]
        for n in packing.cuts(len(whole)):
            want[d, at, tuple(whole[at:at + n]), len(whole)] += 1
            at += n
        assert at == len(whole)
    assert found == want
    assert packing.pack(make([]), tokenizer_path()).count() == 0


def test_every_ascii_character_has_the_tokenizers_ids(make):
    encode = packing.WordIds(tokenizer_path())
    chars = [chr(i) for i in range(128)]
    texts = [f.replace("?", c) for c in chars for f in ("?", "a?b", "!?", "1?2", "A ? b", "'?s", "\u00e9?\u00e9", "\u201c?\u201d")]
    texts += [a + b for a in chars for b in chars]
    want = {t: encode.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts}
    assert [t for t in texts if encode(t) != np.array(want[t], "<u4").tobytes()] == []
    got = {r.doc_id: r for r in packing.pieces(make(list(enumerate(["a\x01b", "!\x01"]))), tokenizer_path()).where("start = 0").collect()}
    assert got[0].doc_tokens == len(want["a\x01b"]) == 4 and got[1].doc_tokens == len(want["!\x01"]) == 3


def test_merges_by_rank_are_the_tokenizers(spark, prose):
    encode = packing.WordIds(tokenizer_path())
    assert encode.fast is not None
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r[0]]
    r = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz\u00e9\u00df\u00f8\u0142\u0161"
    texts += [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 14))) for _ in range(400)) for _ in range(50)]
    texts += ["a" * 399, "ab" * 5000, "x\x01y", "'ll 'LL can't", "!?" * 900, *(t for _, t, *_ in prose if t)]
    for text, e in zip(texts, encode.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert encode(text) == np.array(e.ids + [2], "<u4").tobytes()


def test_a_file_whose_merges_are_out_of_order_goes_to_its_library(tmp_path):
    with open(tokenizer_path(), encoding="utf-8") as file:
        spec = json.load(file)
    merges = spec["model"]["merges"]
    merges[0], merges[1] = merges[1], merges[0]
    path = tmp_path / "swapped.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    encode = packing.WordIds(str(path))
    assert encode.fast is None
    assert encode("in the end") == np.array(encode.tokenizer.encode("in the end", add_special_tokens=False).ids + [2], "<u4").tobytes()


def test_buckets_hold_one_length(spark, make, prose, tmp_path):
    packed = packing.pack(make(prose), tokenizer_path(), longest=64)
    path = str(tmp_path / "buckets")
    packing.write_buckets(packed, path)
    back = spark.read.parquet(path)
    assert back.where("length(ids) <> 4 * bucket or length <> bucket").isEmpty()
    key = lambda df: sorted(tuple(r) for r in df.select(F.coalesce("doc_id", F.lit(-1)), "start", "ids_crc32", "length").collect())
    assert key(back) == key(packed)
    assert {int(d.name.split("=")[1]) for d in (tmp_path / "buckets").iterdir() if d.name.startswith("bucket=")} == {1 << i for i in range(7)}
    with pytest.raises(Exception, match="(?i)already exists"):
        packing.write_buckets(packed, path)



def repeats(texts, length):
    """kept bytes, removed, spans by text, all windows counted"""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        gone[-1] = False
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,gram,most", [(200, 72, 50_000), (200, 72, 2), (40, 16, 1), (40, 16, 50_000)])
def test_suffix_dedup(make, prose, length, gram, most):
    rows = [r for r in prose if r[0] != 84]
    passage = "".join(chr(97 + i * i % 26) for i in range(260))
    rows += [(300 + i, f"{'abc' * i}{passage[:150 + 20 * i]}{'xyz' * i}") for i in range(6)]
    rows += [(320, "na " * 300), (321, "x" * 500), (322, "y" * 199), (323, "é" * 150)]
    want = sorted(str((r[0], *w)) for r, w in zip(rows, repeats([r[1] for r in rows], length)))
    got = suffix_dedup.remove_repeats(make(rows, clashes=True), length, gram, most)
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_texts_go_by_128_bits(spark):
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(3)]
    df = spark.createDataFrame([(d,) for d in digests], "digest string")
    got = [bytes(r[0]) for r in df.select(suffix_dedup.text_key(df["digest"])).collect()]
    assert sorted(got) == sorted(bytes.fromhex(d)[:16] for d in digests)


def test_suffix_dedup_of_nothing(make):
    assert suffix_dedup.remove_repeats(make([])).count() == 0
    assert [tuple(r) for r in suffix_dedup.remove_repeats(make([(1, None)])).collect()] == [(1, 0, 0, 0, EMPTY)]


def test_loser_tree_never_compares_known_prefixes(monkeypatch):
    entries = sorted((b"a" * 50 + bytes([97 + i % 7, 97 + i // 7]), b"", [(i, 0)]) for i in range(49))
    runs = [suffix_dedup.front_coded(entries[i::4]) for i in range(4)]
    looked = []
    plain = suffix_dedup.common
    monkeypatch.setattr(suffix_dedup, "common", lambda a, b, known=0: looked.append(known) or plain(a, b, known))
    out = list(suffix_dedup.merged([suffix_dedup.unfolded(r) for r in runs]))
    assert [e[1] for e in out] == [e[0] for e in entries]
    assert sum(k < 50 for k in looked) <= 4
