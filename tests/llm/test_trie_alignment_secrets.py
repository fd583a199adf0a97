"""Prefix trie, token alignment and secret scan against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwarden.llm import prefix_trie, secret_scan, token_alignment

SF = "/root/testdata/sf0.001"
TURN = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
])
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- prefix trie


@pytest.fixture
def apart(spark):
    """Small parts stay apart, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    out = []
    for key, held in members.items():
        below = [k for k in members if k[:len(key)] == key]
        leaf = [k for k in below if not any(len(x) == len(k) + 1 and x[:-1] == k for x in below)]
        saved = sum((len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in below if k)
        out.append((held[0], len(key), members[key[:-1]][0] if key else None, len(held),
                    sum(len(k) == len(key) + 1 for k in below), len(leaf), saved,
                    sha(",".join(str(c) for c in held if len(rebuilt[c]) == len(key)))))
    return sorted(out, key=repr)


def trie_rows():
    r = random.Random(5)
    say = ["yes", "no", "maybe  so", "", None, "ü ß x", "a b\tc"]
    rows = []
    for c in [*range(0, 12), *range(20, 31), 45, 60, 61, 100, -3, -20, -25]:
        rows += [(c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(say)) for t in range(r.randint(1, 6))]
    rows += [(70 + c, t, "user", "same") for c in range(6) for t in range(4)]  # repeated rows of many conversations
    rows += [(200, None, "user", "tie")] * 3 + [(201, 0, "user", "b"), (201, 0, "user", "a"), (201, 0, "assistant", "a")]
    rows += [(None, 0, "user", "nobody"), (None, 1, None, None)]
    rows += [(40, t, "user", f"long {t % 3}") for t in range(900)]  # one conversation with more than half of all rows
    rows += [(41, t, "user", f"long {t % 3}") for t in range(300)]
    return rows


def test_trie_equals_a_plain_one(spark, apart):
    rows = trie_rows()
    df = spark.createDataFrame(rows, TURN).repartition(5).select("*", *[F.lit("x").alias(c) for c in ("depth", "part", "print", "words", "base")])
    got = prefix_trie.prefix_trie(df).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    want = plain_trie(rows)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURN)).collect() == []


def test_a_conversation_is_cut_over_tasks(spark, apart):
    rows = spark.createDataFrame([(7, t % 50, "user", "the same") for t in range(4000)] + [(8, 0, "user", "x")], TURN).repartition(6)
    turns = prefix_trie.stage(prefix_trie.ordered_turns(rows, 0), "t")
    most = turns.where("conv_id = 7").groupBy("part").count().agg(F.max("count")).first()[0]
    assert most < 1500  # eight tasks share 4,000 rows, equal ones too
    placed = prefix_trie.placed_turns(turns).where("conv_id = 7").orderBy("pos").collect()
    assert [r["pos"] for r in placed] == list(range(1, 4001))
    f = 0
    for r in placed:
        f = prefix_trie.extended(f, prefix_trie.got(r["elem"]), 1)
        assert prefix_trie.got(r["print"]) == f


@given(st.lists(st.integers(0, prefix_trie.PRIME - 1), max_size=12), st.data())
def test_fingerprints_compose(elements, data):
    def of(xs):
        f = 0
        for x in xs:
            f = prefix_trie.extended(f, x, 1)
        return f

    i = data.draw(st.integers(0, len(elements)))
    assert prefix_trie.extended(of(elements[:i]), of(elements[i:]), len(elements) - i) == of(elements)
    assert prefix_trie.cut(of(elements), of(elements[:i]), len(elements) - i) == of(elements[i:])
    if elements:
        assert (of(elements) - elements[-1]) * prefix_trie.INVERSE % prefix_trie.PRIME == of(elements[:-1])


def test_a_false_group_is_seen(spark):
    turns = spark.createDataFrame([(1, "user", "a", 0, 0), (2, "user", "b", 0, 0)], "conv_id long, role string, text string, part long, at long")
    placed = turns.select("conv_id", F.lit(1).cast("long").alias("pos"), "part", "at")
    p, z = bytes(15) + b"\x07", bytes(16)
    schema = "conv_id long, depth long, ref_conv long, ref_pos long, words long, elem binary, print binary, parent binary"
    one = [(1, 1, 1, 1, 1, p, p, z)]
    rows = spark.createDataFrame([*one, (2, 1, 2, 1, 1, p, p, z)], schema)  # two texts of one fingerprint
    assert not prefix_trie.sound(prefix_trie.groups(rows), rows, turns, placed)
    rows = spark.createDataFrame([*one, (2, 1, 1, 1, 1, p, p, z)], schema)  # one stored turn
    assert prefix_trie.sound(prefix_trie.groups(rows), rows, turns, placed)
    rows = spark.createDataFrame([*one, (2, 1, 1, 1, 1, p, p, p)], schema)  # two parents of one fingerprint
    assert not prefix_trie.sound(prefix_trie.groups(rows), rows, turns, placed)


def test_sums_below_run_over_blocks_of_depth(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    # one path of 30 nodes, a path of 5 hung on each 6th of them, and a path of 3 on the end of each of those
    rows = [(0, d, 0 if d else None, 1) for d in range(30)]
    for i, joint in enumerate(range(0, 30, 6)):
        rows += [(10 + i, joint + 1 + d, 10 + i if d else 0, 1) for d in range(5)]
        rows += [(20 + i, joint + 6 + d, 20 + i if d else 10 + i, 1) for d in range(3)]
    got = {(r[0], r[1]): r[2] for r in prefix_trie.below_sums(spark.createDataFrame(rows, "conv_id long, depth long, up long, v long"), ["v"]).collect()}
    assert len(got) == len(rows)
    for d in range(30):
        assert got[0, d] == 30 - d + 8 * sum(j >= d for j in range(0, 30, 6))
    assert got[10, 1] == 8 and got[12, 13 + 4] == 4 and got[24, 24 + 6] == 3


# --- token alignment


def plain_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B_PATH)
    vocab = {i: t for t, i in a.get_vocab().items()}

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    docs = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        raw_a, raw_b = ([bytes(map(token_alignment._AS_BYTE.__getitem__, vocab[i])) for i in ids_a], [bytes_b(i) for i in ids_b])
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            docs.append([])
            continue
        groups, at_a, at_b, i, j = [], 0, 0, 0, 0
        while i < len(ids_a):
            i0, j0 = i, j
            at_a, i = at_a + len(raw_a[i]), i + 1
            while at_a != at_b:
                if at_b < at_a:
                    at_b, j = at_b + len(raw_b[j]), j + 1
                else:
                    at_a, i = at_a + len(raw_a[i]), i + 1
            groups.append((ids_a[i0:i], ids_b[j0:j]))
        docs.append(groups)
    counts = Counter(p for groups in docs for p in {(x, y) for g in groups for x in g[0] for y in g[1]})
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for groups in docs:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        line = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                    sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), sha(line) if groups else ""))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_a_plain_one(make, prose, spark):
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    odd = [
        "<|endoftext|> <s> </s> <unk>", "a▁b", "▁", "  two  spaces ", "\x00\x01\x7f", "\t\n\r\x0b\x0c", "あい \U0001f600‍", "é",
        "\x85\xa0 x", "a" * 5000, " " * 3000 + "x", "don't we'll I'M", "ﬁ ① Ａ", "x\x1c\x1d y",
    ]
    rows = [*prose, *((100 + i, t) for i, t in enumerate(odd)), *((200 + i, t) for i, t in enumerate(texts))]
    got = token_alignment.align(make(rows, clashes=True), A_PATH, B_PATH).collect()
    want = plain_alignment([r[1] for r in rows])
    assert sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got), key=repr) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=repr)


def test_alignment_of_nothing(make):
    assert token_alignment.align(make([]), A_PATH, B_PATH).collect() == []


def test_fast_ids_are_the_library_s(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(A_PATH)
    whole.encode_special_tokens = True
    a = token_alignment.ByteBpe(A_PATH)
    assert a.fast is not None
    plain = [chr(c) for c in [*range(128), *range(0xA1, 0x17F), 0x2013, 0x2014, 0x2018, 0x201D, 0x2026, 0x20AC]]
    texts = [f" {c}" for c in plain] + [f"x{c}{d}1 {c}  {d}" for c in plain for d in ("a", " ", "\n", "'", "7", "\xe9", "\x00")]
    texts += [" " + r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r[0]]
    for text, e in zip(texts, whole.encode_batch(texts, add_special_tokens=False)):
        assert a(text) == e.ids


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_fast_ids_of_any_text(text):
    a = _byte_bpe()
    assert a(text) == a.whole.encode(text, add_special_tokens=False).ids


def _byte_bpe(held=[]):  # noqa: B006
    if not held:
        held.append(token_alignment.ByteBpe(A_PATH))
    return held[0]


def test_blocks_do_not_change_counts(prose):
    align = token_alignment.Aligner(A_PATH, B_PATH)
    texts = [r[1] or "" for r in prose]
    whole = align(texts)
    for name, column in whole.items():
        assert column == [v for t in texts for v in align([t])[name]]


# --- secret scan


def plain_spans(text):
    base = []
    for i, (_, pattern) in enumerate((
            ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)"""),
            ("access", "(AKIA[A-Z0-9]+)"), ("hex", "([0-9a-f]+)"))):
        base += [(m.start(), i, m.end()) for m in re.finditer(pattern, text) if len(m[1]) >= (8, 16, 32)[i]]
    hot = set()
    for chars, width, bits in (("0123456789abcdefABCDEF", 32, 3.2), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 20, 3.8)):
        for at in range(len(text) - width + 1):
            window = text[at:at + width]
            if set(window) <= set(chars):
                start, end = at, at + width
                while start and text[start - 1] in chars:
                    start -= 1
                while end < len(text) and text[end] in chars:
                    end += 1
                entropy = -sum(n / width * math.log2(n / width) for n in Counter(window).values())
                if entropy >= bits and not any(re.fullmatch(a, text[start:end], re.S) for a in secret_scan.ALLOWED):
                    hot.update(range(at, at + width))
    spans, at = [], 0
    for i in sorted(hot):
        if spans and spans[-1][1] == i:
            spans[-1][1] = i + 1
        else:
            spans.append([i, i + 1])
    known = set()
    for start, _, end in base:
        known.update(range(start, end))
    more = [(s, 3, e) for s, e in spans if not set(range(s, e)) <= known]
    return sorted(base), sorted(base + more)


def line(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secrets(r):
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    draw = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    return [
        f"key {draw(letters, 40)} end", f"SECRET='{draw(letters, 8)}'", f"token: {draw(letters, 7)}", f"Api_Key = \"{draw(letters, 30)}\"",
        f"apikey:{draw('0123456789abcdef', 40)}", f"x{draw('0123456789ABCDEF', 48)}y", f"AKIA{draw('ABCDEFGHIJ0123456789', 16)}", "AKIA1234", "AKIAAKIAAKIAAKI1",
        draw("0123456789abcdef", 31), draw("0123456789abcdef", 33), "token=secret:abcdefghij", "password==abcdefg", "passwd   :   'abcdefgh",
        "tokens: abcdefgh", "ſecret=abcdefghi", "toKen=abcdefghi", "secret \t= abcdefghij", f"\U0001f600é token={draw(letters, 20)} é",
        f"{draw(letters, 64)}{draw('a', 40)}{draw(letters, 64)}",
    ]


QUIET = [
    "some-very-long-file_name/with/many/parts/2024/12/31/index", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/",
    "123e4567-e89b-12d3-a456-426614174000", "0123456789012345678901234567890123456789", "a" * 500, "ThisIsTheVeryLongCamelCaseNameOfSomeClassInJava",
    "dGhpcyBpcyBhbiBFWEFNUExF-EXAMPLE-0a9b8c7d6e5f", "beberschlichkeitgeheitundsoweiter", "4952935900253052 +49-170-1234567-8901234",
]


def test_scan_equals_a_plain_one(make, prose):
    r = random.Random(11)
    found = secrets(r)
    rows = [*prose[:30], *prose[-14:-1], *((300 + i, t) for i, t in enumerate(found + QUIET))]
    rows += [(400 + i, " ".join(r.sample(found, 4) + [f"{r.random()}"])) for i in range(20)]
    got = secret_scan.scan(make(rows, clashes=True)).collect()
    want = []
    for doc_id, text in [(x[0], x[1]) for x in rows]:
        base, spans = plain_spans(text or "")
        want.append((doc_id, *(sum(k == i for _, k, _ in base) for i in range(3)), sha(line(base)), line(spans)))
    assert sorted((tuple(x) for x in got), key=repr) == sorted(want, key=repr)


def test_windows_find_what_patterns_miss_and_leave_names():
    r = random.Random(2)
    find = secret_scan.Scanner()
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for _ in range(200):
        text = f"id {''.join(r.choice(letters) for _ in range(40))} end"
        assert any(k == 3 and e - s >= 20 for s, k, e in find(text)[1])
    for text in QUIET:
        assert all(k != 3 for _, k, _ in find(text)[1])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeABC01+", max_size=80), st.integers(2, 12), st.floats(0.1, 3.0))
def test_counts_move_with_the_window(text, width, bits):
    hot = set()
    for at in range(len(text) - width + 1):
        n = sorted(Counter(text[at:at + width]).values())
        weight = sum(round(c * math.log2(c) * secret_scan.UNIT) for c in n)
        if weight <= math.floor((math.log2(width) - bits) * width * secret_scan.UNIT):
            hot.update(range(at, at + width))
    got = secret_scan.rich_windows(text, width, bits)
    assert set().union(*(range(s, e) for s, e in got)) == hot if got else not hot
    assert all(x[1] < y[0] for x, y in zip(got, got[1:]))


def test_a_very_long_text_is_scanned_whole():
    text = "x " * 200_000 + "token = abcdefgh12 " + "ab" * 300_000 + " " + "0123456789abcdef" * 3
    base, spans = secret_scan.Scanner()(text)
    assert [secret_scan.KINDS[k] for _, k, _ in base] == ["assign", "hex", "hex"] and base[-1][2] == len(text)


def test_scan_of_nothing(make):
    assert secret_scan.scan(make([])).collect() == []


@pytest.mark.parametrize("rows", [[(1, None), (1, None), (None, "")]])
def test_scan_of_empty_texts(make, rows):
    assert {tuple(r)[1:] for r in secret_scan.scan(make(rows)).collect()} == {(0, 0, 0, sha(""), "")}
