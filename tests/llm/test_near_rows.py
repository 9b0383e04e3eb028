"""Near-dedup of tables in which doc_ids are missing or repeated."""

import random
from collections import Counter

from data import SCHEMA, words

from quillmesh.llm import minhash


def test_repeated_ids(spark):
    rng = random.Random(8)
    a, b, c, d, e = (words(rng, 60) for _ in range(5))
    near = a.rsplit(" ", 1)[0] + " changed"
    found = [
        (1, a), (2, near), (2, b), (3, c), (3, c), (3, d), (None, e), (None, "quite " + d), (None, ""), (4, ""), (4, ""), (5, c.upper().replace("É", "é").replace("ü", "Ü")),
        (6, e + " one"), (6, e + " two"),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", j, 0, "x", 0) for j, (i, t) in enumerate(found)], SCHEMA)
    report = minhash.near_duplicates(df).collect()
    assert len(report) == len(found)
    kept = minhash.drop_near_duplicates(df.repartition(3))
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    six = [x for x in rows if x[0] == 6]
    assert len(six) == 1 and six[0] in found
    want = [(1, a), (2, b), (3, c), (3, d), (None, e), (None, "quite " + d), (None, ""), (4, ""), (4, "")]
    assert Counter(x for x in rows if x[0] != 6) == Counter(want)
    assert kept.columns == df.columns


def test_repeated_row_changes_nothing_else(spark):
    rng = random.Random(9)
    found = [(None, words(rng, 40)) for _ in range(4)] + [(1, words(rng, 40)), (2, words(rng, 40))]
    df = spark.createDataFrame(found + found[-1:], "doc_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in minhash.drop_near_duplicates(df).collect()]
    assert Counter(rows) == Counter(found)
