import random

import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
#: Names that operators use for columns of their own.
CLASHES = (
    "size", "digest", "node", "component_id", "n_shingles", "target", "copies", "rate", "kept", "text_id", "body",
    "score", "label", "gram", "places", "rest", "cell", "vector", "bucket", "start", "length", "valid", "segments",
)


@pytest.fixture(scope="session")
def make(spark):
    """Rows of ``documents``, given as (doc_id, text) or (doc_id, text, source)."""

    def build(rows, clashes=False):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(rows, DOCUMENT).repartition(3)
        if clashes:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES])
        return df

    return build


@pytest.fixture(scope="session")
def prose():
    """Invented texts with nulls, empties, a very long one, near copies, exact copies and repeated rows."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(r.randint(1, 120))) for i in range(40)]
    passage = text(60)
    for i in range(40, 60):
        base = r.choice(rows[:40])[1].split()
        for _ in range(r.randint(0, 3)):
            base[r.randrange(len(base))] = r.choice(words)
        rows.append((i, " ".join(base)))
    rows += [(60 + i, text(20) + "\n" + passage + "\n" + text(25)) for i in range(6)]
    rows += [(70, rows[3][1]), (71, rows[3][1]), (72, rows[4][1].upper()), (5, rows[5][1]), (5, rows[5][1])]
    rows += [(80, None), (81, ""), (82, " \t\n"), (83, "Ünïcode ß €\x0b x"), (None, rows[6][1]), (None, None), (84, text(30_000))]
    return rows
