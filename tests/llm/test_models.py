"""Fitted operators against held-out accuracy and brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwarden.llm import html_crf, multi_index, toxicity, url_filter

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def field():
    return html_crf.trained()


def test_field_on_pages_not_seen(field):
    maker, wrong, total = html_crf.PageMaker(99), 0, 0
    for _ in range(200):
        found, labels = maker.page()
        wrong += sum(a != b for a, b in zip(field.decode(found), labels))
        total += len(labels)
    assert wrong < 0.02 * total


def test_viterbi_is_the_best_of_all_labellings(field):
    maker = html_crf.PageMaker(5)
    for _ in range(20):
        found, _ = maker.page()
        found = found[:9]
        own = [field.bias + sum(field.weights.get(f, 0.0) for f in b.features) for b in found]

        def score(y):
            s = field.start[y[0]] + sum(o for o, k in zip(own, y) if k)
            return s + sum(field.step[a, b] for a, b in zip(y, y[1:]))

        best = max((score([i >> k & 1 for k in range(len(found))]), i) for i in range(1 << len(found)))[0]
        assert score([int(k) for k in field.decode(found)]) == pytest.approx(best)


def test_extraction(spark, field):
    rows = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_crf.extract(rows, field).collect()}
    for page in rows.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page.html, re.S)[1]
        want = "\n".join(b.text for b in html_crf.blocks(f"<article>{inner}</article>"))
        assert got[page.page_id].text == want and got[page.page_id].n_chars == len(want)


def test_extraction_of_odd_pages(spark, field):
    long = "<article>" + "".join(f"<p>Sentence number {i} of a long page, in full.</p>" for i in range(3000)) + "</article>"
    pages = [
        (1, "u", None), (2, None, ""), (None, "u", "<p"), (3, "u", "<div class=\"a'<p>"), (4, "u", "plain &amp; simple &am"),
        (5, "u", "</p></div><<>><!-- open"), (6, "u", long), (6, "u", long),
        (7, "u", "<main><h1>Big&nbsp;day &copy;</h1><p>One  two\n three, four and five.<script>x<p></script> Six.</p>"
                 "<div class='comments'><p>I liked this very much, thanks.</p></div></main><footer>&copy; me</footer>"),
    ]
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
    df = spark.createDataFrame(pages, schema).withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(1))
    got = html_crf.extract(df, field).collect()
    assert len(got) == len(pages)
    text = {r.page_id: r.text for r in got}
    assert text[1] == "" and text[2] == ""
    assert text[6].count("\n") == 2999
    assert text[7] == "Big day ©\nOne two three, four and five. Six."
    assert html_crf.extract(df.limit(0), field).count() == 0


ODD_TAGS = [
    '<svg class="i" viewBox="0 0 1 1"/>', "<svg/>", "<svg><path d='M0'>", "<object data=x />", "<object data=x>", "<select><option>",
    "<noscript>", "<template>", "<NOSCRIPT><img src=x>", "<a title=it's>", "<img alt=5\"x>", "<b title = it's don't>", "<!-->", "<!--->",
]


@pytest.mark.parametrize("odd", ODD_TAGS)
def test_text_after_an_odd_tag_survives(odd):
    """Whether the page goes on without a like tag, or with a closed one, or with a later apostrophe."""
    for later in ("", "<svg><path></svg><object></object><select><option>no</select><noscript>no</noscript><template>no</template>",
                  "<i title=it's>it's</i> \"so\" <!-- no -->"):
        page = f"<article><p>One sentence. {odd} Two.</p><p>Three.</p>{later}<p>Four.</p></article><footer>Five.</footer>"
        text = " ".join(b.text for b in html_crf.blocks(page)).split()
        assert [w for w in text if w in ("One", "Two.", "Three.", "Four.", "Five.")] == ["One", "Two.", "Three.", "Four.", "Five."]
        assert "no" not in text


def test_hidden_content_ends_at_its_own_end_tag():
    shown = lambda page: [b.text for b in html_crf.blocks(page)]
    assert shown("<p>a <object>x <object>y</object> z</object> b</p>") == ["a b"]
    assert shown("<p>a <svg><title/><style>x</svg> b</p>") == ["a b"]
    assert shown("<p>a <svg><!-- </svg> --><text>x</text></svg> b</p>") == ["a b"]
    assert shown("<p>a <noscript><!-- x</noscript> b</p>") == ["a b"]
    assert shown("<p>a <script>'<svg>'</script> b <svg>x</svg> c <a title='> x'>d</a></p>") == ["a b c d"]
    assert shown("<p>a <script>x <p>y") == ["a"]


def test_odd_pages_take_time_in_proportion():
    for odd in ("<svg>", "<select>", "<noscript>", "<a title=it's>", "<!-->", "<a b='"):
        page = "<p>x</p>" + odd * 40_000 + "<p>y</p>"
        assert html_crf.blocks(page)[0].text == "x"


def test_toxicity_held_out(spark):
    from flowwarden.llm import registry

    rows = registry.op6(spark, "/root/testdata/sf0.1").join(
        spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic == 1]
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_swapped_terms_do_not_change_the_score(make, spark, monkeypatch):
    rows, labels = [], []
    for i in range(300):
        # one group's name goes with the label in what was labelled
        bad = i % 2
        who = "muslims" if bad and i % 10 or not bad and i % 10 == 0 else "hindus"
        rows.append((i, f"the {who} are {'awful trash' if bad and i % 3 else 'here today'} word{i % 17}"))
        labels.append((i, bad))
    docs, labels = make(rows), spark.createDataFrame(labels, "doc_id long, toxic int")

    def gap(model):
        a, b = model.scores(["the muslims are here today", "the hindus are here today"])
        return abs(math.log(a / (1 - a)) - math.log(b / (1 - b)))

    with_penalty = gap(toxicity.fit(docs, labels))
    monkeypatch.setattr(toxicity, "COUNTERFACTUAL", 0.0)
    without = gap(toxicity.fit(docs, labels))
    assert with_penalty < 0.1 * without


def test_toxicity_without_examples(make, spark, prose):
    docs = make(prose, clashes=True)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 1), (None, 0), (2, None), (1, 1)], "doc_id long, toxic int")
    assert max(r.s for r in toxicity.with_scores(docs, toxicity.fit(docs, none), "s").collect()) < 0.5
    scored = toxicity.with_scores(docs, toxicity.fit(docs, one), "s")
    assert scored.count() == len(prose) and scored.columns == [*docs.columns, "s"]
    assert min(r.s for r in scored.collect()) > 0.5
    assert toxicity.with_scores(make([]), toxicity.Model(0.0), "s").count() == 0


def vectors(spark, rows):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("cell", T.StringType())])
    return spark.createDataFrame([(*r, "x") for r in rows], schema)


def nearest(rows, k=5, of=10):
    least = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            least[i] = min(least.get(i, v), v)
    good = {(i, tuple(v)): np.array([*v, *[0.0] * (4 - len(v))], float) for i, v in least.items()}
    out = {}
    for (i, v), x in good.items():
        if i % of == 0:
            c = [(-(x @ y) / math.sqrt(x @ x) / math.sqrt(y @ y), j) for (j, _), y in good.items() if j != i]
            out[i] = sorted(c)[:k]
    return out


def test_search(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=4)]) for i in range(200)]
    rows += [(i, rows[7][1]) for i in range(200, 260)] + [rows[3], (None, rows[4][1])]
    rows += [(300, None), (301, []), (302, [0.0] * 4), (303, [1.0, None, 1.0, 1.0]), (304, [1.0, math.nan, 1.0, 1.0]),
             (305, [math.inf, 1.0, 1.0, 1.0]), (306, [1.0, 2.0]), (310, [1e-20] * 4)]
    rows += [(20, [9.0, 9.0, 9.0, 9.0]), (2, [-9.0, 0.0, 1.0, 1.0]), (2, [-8.0, 0.0, 1.0, 1.0])]  # ids with several vectors
    got = multi_index.search(vectors(spark, rows), F.col("vec_id") % 10 == 0, centroids=4, walked=1.0).collect()
    parted = multi_index.search(vectors(spark, rows), F.col("vec_id") % 10 == 0, centroids=4, walked=1.0, query_rows=7).collect()
    assert sorted(map(tuple, parted)) == sorted(map(tuple, got))
    want = nearest(rows)
    found = {}
    for row in got:
        found.setdefault(row.query_id, {})[row.rank] = row
    assert all(len({row.vec_id for row in f.values()}) == 5 for f in found.values())
    assert found.keys() == want.keys()
    for i, best in want.items():
        assert sorted(found[i]) == [1, 2, 3, 4, 5]
        for rank, (score, _) in enumerate(best, 1):
            assert found[i][rank].score == pytest.approx(-score, abs=1e-12)
    tied = found[250]
    assert [tied[k].vec_id for k in range(1, 6)] == [7, 200, 201, 202, 203]


def test_search_of_few_and_none(spark):
    assert multi_index.search(vectors(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert multi_index.search(vectors(spark, [(0, [1.0, 2.0])]), F.col("vec_id") % 10 == 0).count() == 0
    got = multi_index.search(vectors(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0])]), F.col("vec_id") % 10 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1)]


def test_walk_passes_cells_in_order():
    r = np.random.default_rng(4)
    a, b = r.random(7), r.random(5)
    held = {i: 1 for i in range(35) if i % 4}
    sums = {i: a[i // 5] + b[i % 5] for i in held}
    got = multi_index.walk(a, b, held, 20)
    assert got == sorted(held, key=sums.get)[:20]


def test_large_cells_are_split():
    dealt = multi_index.deal({0: 3, 1: 25, 2: 4, 3: 4, 9: 8}, 10)
    assert dealt == {0: [0], 1: [1, 2, 3], 2: [4], 3: [4], 9: [5]}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_given_vectors(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    ids, x = zip(*[(r.vec_id, r.embedding) for r in rows.collect()])
    ids, x = np.array(ids), np.array(x, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def recall(walked):
        got = multi_index.search(rows, F.col("vec_id") % 50 == 0, walked=walked).collect()
        found = {(r.query_id, r.vec_id) for r in got}
        hits = total = 0
        for q in np.flatnonzero(ids % 50 == 0):
            s = x @ x[q]
            s[q] = -2
            hits += sum((ids[q], i) in found for i in ids[np.argsort(-s)[:5]].tolist())
            total += 5
        print(f"{sf}: recall {hits / total:.3f} at {walked}")
        return hits / total

    assert recall(multi_index.WALKED) >= 0.9
    if sf == "sf0.1":
        assert recall(0.05) < 0.9  # cells are left out


def test_walks_are_dealt_over_tasks(spark):
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(300)], "vec_id long, vector array<double>").dropDuplicates(["vec_id"])
    rows = multi_index.spread(few, "vec_id").withColumn("task", F.spark_partition_id())
    assert rows.select("task").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def judged(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, _ in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


def test_url_rules_and_verdicts(spark):
    given = [(r.page_id, r.url) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    odd = [
        (-1, None), (-2, ""), (-3, "no scheme.com/x"), (-4, "http://COM/"), (-5, "http://com"), (-6, "a://b://c.com/en/"),
        (-7, "http://WWW.Example.com/en/?q#x"), (-8, "http://notexample.com/en/"), (-9, "http://x.example.com/en"),
        (-10, "http://É.net/es/\n?"), (-11, "http://net/es/"), (None, "http://a.net/fr/1"), (-12, "http://a.org/" + "y" * 50_000),
    ]
    rows = given + odd + odd[:2]
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType())])
    df = spark.createDataFrame(rows, schema).withColumn("host", F.lit(1)).withColumn("label", F.lit(1)).withColumn("suffix", F.lit(1))
    got = url_filter.judge(df).collect()
    assert len(got) == len(rows)
    want = {(i, *judged(u)) for i, u in rows}
    assert {(r.page_id, r.host, r.path, r.rule) for r in got} == want
    verdicts = dict(url_filter.RULES)
    assert all(r.verdict == verdicts[r.rule] for r in got if r.rule)
    assert {r.verdict for r in got} == {"allow", "block"}


def test_url_trees_learn_the_labels(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    got = url_filter.judge(df).where("rule is not null").select("verdict", "score").collect()
    assert np.mean([(r.score >= 0.5) == (r.verdict == "block") for r in got]) > 0.9


def test_urls_without_a_rule_are_judged_each_by_itself(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    got = url_filter.judge(df).where("rule is null").select("score", "verdict").distinct().collect()
    assert len({r.score for r in got}) > 5 and {r.verdict for r in got} == {"allow", "block"}


def test_lexical_features_decide_where_no_rule_fits(spark):
    """Rules label hosts of which the blocked have long urls full of digits; hosts of no rule are judged by that."""
    r = random.Random(6)
    bad = lambda: "/" + "".join(r.choice("0123456789abcdef") for _ in range(40)) + f"?a={r.random()}&b={r.random()}&c=1"
    good = lambda: "/" + "-".join(r.choice(["news", "about", "story", "music"]) for _ in range(3))
    rules = (("one.org", "block"), ("two.org", "allow"))
    rules = tuple((f"{h}/", v) for h, v in rules)
    rows = [(i, f"http://{'one' if i % 2 else 'two'}.org{bad() if i % 2 else good()}") for i in range(600)]
    rows += [(1000 + i, f"http://h{i % 40}.net{bad() if i % 2 else good()}") for i in range(400)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).where("rule is null").collect()
    assert len(got) == 400
    assert np.mean([(r.verdict == "block") == (r.page_id % 2 == 1) for r in got]) > 0.95


def test_url_labels_of_one_kind(spark):
    schema = "page_id long, url string"
    assert url_filter.judge(spark.createDataFrame([], schema)).count() == 0
    got = url_filter.judge(spark.createDataFrame([(1, "http://a.com/"), (2, "http://b.org/")], schema)).collect()
    assert {r.verdict for r in got} == {"allow"}


def test_url_sample_holds_either_label(spark):
    """Copies of few urls, and a label with one url among many."""
    rules = (("bad.com", "block"), ("good.org", "allow"))
    schema = "page_id long, url string"
    copies = [(i, "http://bad.com/x" if i % 2 else "http://good.org/y") for i in range(2000)]
    rare = [(i, f"http://good.org/page{i}") for i in range(300)] + [(-1, "http://bad.com/x")]
    for rows in (copies, rare):
        labelled = spark.createDataFrame(rows, schema).selectExpr(
            "*", "cast(url like '%bad.com%' as double) as label", "length(url) as features")
        got = url_filter.labelled_sample(labelled, sample_rows=10).collect()
        assert {r.label for r in got} == {0.0, 1.0} and len(got) < 40
        weight = {y: sum(r.weight for r in got if r.label == y) for y in (0.0, 1.0)}
        assert weight[1.0] == sum("bad.com" in u for _, u in rows)
        assert weight[0.0] == pytest.approx(sum("good.org" in u for _, u in rows), rel=0.9)
    other = [(-2, "http://bad.net/x"), (-3, "http://good.net/y")]
    got = url_filter.judge(spark.createDataFrame(copies + other, schema), rules, sample_rows=10).collect()
    assert len(got) == 2002 and all(r.score is not None for r in got)
    assert all((r.score >= 0.5) == (r.verdict == "block") for r in got)
