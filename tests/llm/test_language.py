"""Language ID: held-out accuracy, rejection, what is learnt, and the defined cases."""

import random
import zlib

from data import SCHEMA

from quillmesh.llm import language

LETTERS = {"aa": "abcdefgh", "bb": "efghijklmn", "cc": "мнопрсту", "dd": "aeiouäöü"}


def prose(rng: random.Random, lang: str, n: int) -> str:
    own = random.Random(lang)
    stock = ["".join(own.choice(LETTERS[lang]) for _ in range(2 + i % 6)) for i in range(60)]
    return " ".join(rng.choice(stock) for _ in range(n))


def corpus(n: int = 400) -> list[tuple]:
    rng = random.Random(11)
    langs = list(LETTERS)
    return [(i, prose(rng, langs[i % 4], rng.randrange(20, 120)), langs[i % 4]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, f"s{(i or 0) % 3}", 0, 0, "x", 0) for i, t, lang in rows], SCHEMA)


def test_held_out(spark):
    rows = corpus()
    rng = random.Random(2)
    junk = [(1000 + i, "#%& 12 " + "".join(rng.choice("qxzj") for _ in range(300)), None) for i in range(8)]
    odd = [(2000, None, "aa"), (2001, "", "bb"), (2002, "123 !?", "bb"), (None, rows[0][1], None), rows[3], rows[3]]
    got = language.identify(frame(spark, rows + junk + odd)).collect()
    assert len(got) == len(rows + junk + odd)
    by = {r["doc_id"]: r for r in got}
    out = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(out) > 60 and all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert sum(by[i]["lang_pred"] == rows[i][2] for i in out) >= 0.98 * len(out)
    assert sum(by[i]["rejected"] for i in out) <= 0.02 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (2000, 2001, 2002)) and by[None]["lang_pred"] == "aa"
    assert all(by[i]["rejected"] for i, _, _ in junk)
    kept = language.drop_unknown(frame(spark, rows + junk + odd))
    assert kept.columns == frame(spark, rows).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert not {i for i, _, _ in junk} & set(ids) and len(set(ids) & {i for i, _, _ in rows}) >= 0.98 * len(rows)
    assert ids.count(3) == 3 and ids.count(None) == 1 and 2000 not in ids


def test_prediction_sees_the_text_only(spark):
    rows = corpus(200)
    model = language.fit_languages(frame(spark, rows))
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict_languages(frame(spark, rows), model).collect()}
    other = [(i, t, "bb") for i, t, _ in rows]
    assert a == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict_languages(frame(spark, other), model).collect()}


def test_long_texts_and_many_labels(spark):
    """A language that has only very long texts is learnt from pieces of them; every label gets a model."""
    rng = random.Random(3)
    rows = corpus(120) + [(500 + i, prose(rng, "dd", 40_000), "long") for i in range(5)] + [(700 + i, prose(rng, "cc", 30), f"l{i}") for i in range(40)]
    rows = [(i, t, lang) for i, t, lang in rows if lang != "dd"]
    model = language.fit_languages(frame(spark, rows), sample_bytes=50_000)
    assert "long" in model.langs and len([x for x in model.langs if x.startswith("l")]) > 20
    test = [(900 + i, prose(rng, "dd", 60), None) for i in range(10)]
    assert {r["lang_pred"] for r in language.predict_languages(frame(spark, test), model).collect()} == {"long"}


def test_nothing_to_learn(spark):
    rows = [(1, "some text", None), (2, None, "aa")]
    assert {(r["lang_pred"], r["rejected"]) for r in language.identify(frame(spark, rows)).collect()} == {("und", True)}
    assert language.drop_unknown(frame(spark, rows)).count() == 0
    assert language.identify(frame(spark, corpus(40)).limit(0)).count() == 0
    df = frame(spark, corpus(40)).withColumnsRenamed({"t": "rejected_text"})
    assert language.drop_unknown(df).columns == df.columns
