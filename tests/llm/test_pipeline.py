"""The pipeline against plain versions of its stages, each on what the one before kept."""

import random

from test_exact import brute_components, brute_hits
from test_language import prose
from test_mixing import plain

import corpus_pipeline
from quillmesh.llm import language, lines

LANGS = ["aa", "bb", "cc", "dd"]


def within_one(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    p = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def plain_lines(rows: dict) -> dict:
    flat = [(i, j, x) for i, t in sorted(rows.items()) for j, x in enumerate(t.split("\n")) if x]
    out = {}
    for i, t in rows.items():
        gone = set()
        for j, x in enumerate(t.split("\n")):
            if x and any((e, k) < (i, j) and (x == y or min(len(x), len(y)) >= lines.MIN_CHARS and within_one(x, y)) for e, k, y in flat):
                gone.add(j)
        out[i] = "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone)
    return out


def test_pipeline(spark, tmp_path):
    rng = random.Random(21)
    rows = []
    for i in range(120):
        lang = LANGS[i % 4]
        rows.append((i, "\n".join(prose(rng, lang, rng.randrange(8, 40)) for _ in range(rng.randrange(1, 5))), lang, rng.choice(["a", "b", None, "z"])))
    notice = prose(rng, "aa", 12)
    item = [prose(rng, "aa", 20), prose(rng, "bb", 20), prose(rng, "bb", 14)]
    for i in range(120, 150):
        text, lang = rows[i - 120][1], rows[i - 120][2]
        kind = i % 6
        text = [text, text + " " + prose(rng, lang, 1), f"{notice}\n{prose(rng, lang, 30)}\n{notice}", f"{item[0]} {item[1]}\n{prose(rng, lang, 9)}", f"{item[2]}\n{prose(rng, lang, 25)}", "".join(rng.choice("qxzj ") for _ in range(400))][kind]
        rows.append((i, text, None if kind == 5 else lang, rng.choice(["a", "b"])))
    rows += [(150, None, "aa", "a"), (151, "", "bb", "b")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(item)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rejected = {r["doc_id"] for r in language.identify(docs).collect() if r["rejected"]}
    junk = {i for i, *_ in rows if i >= 150 or i >= 120 and i % 6 == 5}
    assert junk <= rejected and len(rejected - junk) <= 3
    source = {i: s for i, _, _, s in rows}
    kept = plain_lines({i: t for i, t, _, _ in rows if i not in rejected})
    ids = sorted(kept)
    sizes, top = brute_components([kept[i] for i in ids])
    left = [i for n, i in enumerate(ids) if not sizes[n] or top[n] == n]
    bad = brute_hits([(i, kept[i]) for i in left], list(enumerate(item)))
    left = [i for i in left if not bad[i][4]]
    assert 0 < len(left) < len(ids)
    copies, _ = plain([(i, source[i], len(kept[i].split())) for i in left])
    want = {i: c for i, c in zip(left, [copies[n] for n in range(len(left))]) if c}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["copies"] for r in got} == want and len(got) == len(want)
    assert all(r["taken"] == r["copies"] * r["size"] for r in got)
    # stages keep the columns of documents, and stand an empty table
    some, stages = docs, corpus_pipeline.STAGES
    for name, stage in stages[:-1]:
        some = stage(spark, some, str(tmp_path))
        assert some.columns == docs.columns, name
    for name, stage in stages:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
