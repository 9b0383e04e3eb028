"""The edit join of line dedup: distances, several thresholds, common halves, clashing columns, repeated ids."""

import random

import pytest
from pyspark.sql import functions as F
from test_exact import edits, rows_of

from quillmesh.llm import lines


def changed(rng: random.Random, text: str, n: int) -> str:
    out = list(text)
    for _ in range(n):
        kind, at = rng.randrange(3), rng.randrange(len(out) + 1)
        if kind == 0 or not out:
            out.insert(at, rng.choice("abcé"))
        elif kind == 1:
            out.pop(min(at, len(out) - 1))
        else:
            out[min(at, len(out) - 1)] = rng.choice("abcé")
    return "".join(out)


def test_distance(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abcé ") for _ in range(rng.randrange(30)))
        pairs.append((a, changed(rng, a, rng.randrange(6))))
    df = spark.createDataFrame(pairs, "x string, y string")
    got = df.select("x", "y", *[lines.banded_edits(F.col("x"), F.col("y"), tau).alias(f"d{tau}") for tau in (1, 2, 3)]).collect()
    for r in got:
        want = edits(r["x"], r["y"])
        assert [r[f"d{tau}"] for tau in (1, 2, 3)] == [min(want, tau + 1) for tau in (1, 2, 3)], r


@pytest.mark.parametrize(("tau", "hot"), [(1, 2), (1, 16), (2, 16), (3, 16)])
def test_thresholds(spark, monkeypatch, tau, hot):
    monkeypatch.setattr(lines, "HOT", hot)
    rng = random.Random(tau)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(20, 60))) for _ in range(6)]
    found = [changed(rng, rng.choice(base), rng.randrange(5)) for _ in range(90)] + base
    found += [base[0][:15] + "".join(rng.choice("ab") for _ in range(12)) for _ in range(25)]
    rng.shuffle(found)
    df = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    got = rows_of(lines.line_report(df, tau=tau, min_chars=15))
    long = [(i, x) for i, x in enumerate(found) if len(x) >= 15]
    for i, x in long:
        near = {y for _, y in long if y != x and edits(x, y) <= tau}
        assert got[i]["n_links"] == len(near), x
        assert got[i]["n_removed"] == int(any(j < i and (y == x or y in near) for j, y in long)), x


def test_common_half_makes_few_candidates(spark):
    """Lines that share a half are neither candidates of each other nor lost."""
    rng = random.Random(5)
    half = "a common first half of very many lines, long enough to be hot. "
    found = [half + "".join(rng.choice("abcdefghij ") for _ in range(60)) for _ in range(3000)]
    found.append(found[7][:-1] + "#")
    df = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    kinds = df.select(F.xxhash64("text").alias("h"), F.char_length("text").alias("len"), "text")
    keys = [k.alias(f"own{i}") for i, k in enumerate(lines.index_keys(F.col("text"), F.col("len")))] + [k.alias(f"seek{i}") for i, k in enumerate(lines.probe_keys(F.col("text"), F.col("len")))]
    pairs = lines._candidates(kinds.select("h", "len", *keys), kinds.select("h", F.col("text").alias("line")), 1, lines.PIECES, lines.PIECES)
    assert 1 <= pairs.count() <= 3000
    got = rows_of(lines.line_report(df))
    assert {i for i, r in got.items() if r["n_removed"]} == {3000} and got[7]["n_links"] == 1


def test_clashing_columns(spark):
    names = ["links", "gone", "_text", "_rest", "_d", "_t", "lines_d", "lines_rest", "n_chars"]
    a, b = "a line that is long enough to count", "another line that is long enough too"
    rows = [(1, f"{a}\n{b}", *names[:-1], 99), (2, f"{a}\nnew line of its own, also long", *names[:-1], 99), (2, b, *names[:-1], 99), (None, None, *names[:-1], 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names[:-1]) + ", n_chars long")
    out = lines.dedup_lines(df)
    assert out.columns == df.columns
    got = {(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()}
    new = "new line of its own, also long"
    assert got == {(1, f"{a}\n{b}", 99), (2, new, len(new)), (2, "", 0), (None, None, 99)}
    assert all(r[n] == n for r in out.collect() for n in names[:-1])
