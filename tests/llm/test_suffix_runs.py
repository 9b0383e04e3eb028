"""Front-coded runs, the loser tree, and suffix dedup of tables in which doc_ids are missing or repeated."""

import random

import numpy as np
import pytest
from data import words
from pyspark.sql import functions as F
from test_exact import brute_suffix

from quillmesh.llm import suffix


def run_of(seed: int, n: int) -> tuple[suffix.Run, np.ndarray]:
    rng = random.Random(seed)
    base = [bytes(random.Random(f"b{i}").choice(b"abc\xc3\x00") for _ in range(suffix.WIDTH)) for i in range(20)]
    keys = []
    for _ in range(n):
        cut = rng.randrange(suffix.WIDTH + 1)
        keys.append(rng.choice(base)[:cut] + bytes(rng.choice(b"ab\xff") for _ in range(suffix.WIDTH - cut)))
    keys = np.frombuffer(b"".join(sorted(keys)), np.uint8).reshape(-1, suffix.WIDTH)
    fields = {f: np.arange(n).astype(t) if f in ("doc", "pos") else np.zeros(n, t) for f, t in suffix.FIELDS.items()}
    fields["lo"] += suffix.LEFT
    return suffix.Run.unpack(suffix.Run.coded(fields, suffix.common(keys), keys).pack()), keys


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_loser_tree(monkeypatch, fan):
    monkeypatch.setattr(suffix, "FAN", fan)
    made = [run_of(i, n) for i, n in enumerate([1, 3000, 17, 512, 513, 1, 1200, 40])]
    for run, keys in made:
        assert b"".join(k for i in range(len(run.blocks)) for k in run.keys(i)) == keys.tobytes()
    want = np.frombuffer(b"".join(sorted(k.tobytes() for _, keys in made for k in keys)), np.uint8).reshape(-1, suffix.WIDTH)
    parts = list(suffix.merged([run for run, _ in made]))
    assert (np.concatenate([p[2] for p in parts]) == want).all()
    assert (np.concatenate([p[1] for p in parts]) == suffix.common(want)).all()
    # the fields come along with their keys
    first = {(0, bytes(made[1][1][0]))}
    assert first <= {(int(f["doc"][i]), bytes(k[i])) for f, _, k in parts for i in range(len(k))}


@pytest.mark.parametrize("group", [64, 2])
def test_repeated_ids(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    monkeypatch.setattr(suffix, "PART", 2000)
    rng = random.Random(4)
    a, b, c = (words(rng, 60) for _ in range(3))
    found = [(1, a), (2, a), (2, b), (2, b + " " + c), (3, c), (3, c), (None, b), (None, a[50:]), (4, "é" * 90 + a[:200]), (5, None), (5, "")]
    df = spark.createDataFrame([(i, t, "x", 0, "y") for i, t in found], "doc_id long, text string, t string, pos int, raw string")
    hashes = [r["h"] for r in df.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()]
    # a brute version over (doc_id, hash of the text): repeated rows are one document
    places = sorted({((i is not None, i or 0), h) for (i, _), h in zip(found, hashes)})
    texts = {((i is not None, i or 0), h): t for (i, t), h in zip(found, hashes)}
    brute = brute_suffix([(n, texts[p]) for n, p in enumerate(places)])
    want = sorted(((i, *brute[places.index(((i is not None, i or 0), h))]) for (i, _), h in zip(found, hashes)), key=repr)
    got = suffix.suffix_report(df).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=repr) == want
    assert suffix.suffix_report(df.limit(0)).count() == 0
