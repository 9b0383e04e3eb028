"""The exact operators against plain versions of their definitions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from data import SCHEMA, frame, texts, words

from quillmesh.llm import decontaminate, lines, media, minhash, mixing, pii, suffix, urls


def rows_of(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


# --- op1


def brute_suffix(found, span=100):
    seen, out = {}, {}
    for i, t in found:
        raw = (t or "").encode()
        for p in range(len(raw) - span + 1):
            seen.setdefault(raw[p : p + span], (i, p))
    for i, t in found:
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for p in range(len(raw) - span + 1):
            if seen[raw[p : p + span]] != (i, p):
                mark[p : p + span] = b"\1" * span
        spans = len(re.findall(b"\1+", bytes(mark)))
        out[i] = (len(raw), sum(mark), spans, hashlib.sha256(bytes(c for c, m in zip(raw, mark) if not m)).hexdigest())
    return out


@pytest.mark.parametrize("group", [64, 3])
def test_suffix(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    found = texts()
    got = rows_of(suffix.suffix_report(frame(spark, found, null_row=False)))
    want = brute_suffix(list(enumerate(found)))
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in got.items()} == want


def test_suffix_edges(spark):
    assert suffix.suffix_report(frame(spark, [], null_row=False)).count() == 0
    twice = frame(spark).unionByName(frame(spark))
    assert suffix.suffix_report(twice).count() == twice.count()


# --- op3


def test_media(spark):
    found = texts()
    got = rows_of(media.media_report(frame(spark, found, null_row=False)))
    assert len(got) == len(found)
    by_text = defaultdict(set)
    for i, t in enumerate(found):
        raw = (t or "").encode()
        padded = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        by_text[raw].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())


def test_media_header_reads(spark):
    index, folder = media.store_payloads(frame(spark))
    rows = media.with_metadata(index, folder).collect()
    assert len(rows) == frame(spark).count()
    assert all((r["width"], r["depth"]) == (192, 8) and r["height"] * 192 >= r["n_bytes"] for r in rows)
    assert media.media_report(frame(spark, [], null_row=False)).count() == 0


# --- op4

PII = [
    "mail a.b@ex-ample.co.uk now, or x@@y.com, or a@b.c.d.", "ip 1.2.3.4 and 999.1.1.1 and 1.2.3.4.5.6.7.8 server 010.0.0.255",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 378282246310005 12345678901234567890123", "call +49 (30) 123-4567 or +1 or +1.2.3.4.5.6.7.8.9.0 +++12345678",
    "é🎈 a@b.cd é 4111111111111111 é", "IBAN DE89 3704 0044 0532 0130 00 and DE89370400440532013001", "ssn 123-45-6789", None, "", "1" * 5000, "a" * 3000 + "@b.c", "@" * 50,
    "a@b.c@d.e", "1.2.3.4.5", "12.34.56.78.9.10.11.12", "+1(555)123-4567+44 20 7946 0958", "4111 1111 1111 1111 4111 1111 1111 1111", "%+-@x.y_z", ("x" * 200 + "@y ") * 30,
]
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_pii(t):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii(spark):
    found = PII + texts()
    got = rows_of(pii.pii_report(frame(spark, found, null_row=False)))
    for i, t in enumerate(found):
        want = brute_pii(t)
        count = Counter(k for k, _, _ in want)
        r = got[i]
        assert [r[f"n_{k}"] for k in BASE] == [count[k] for k in BASE], (t or "")[:80]
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), (t or "")[:80]
        assert set(line.split(",")) - {""} <= set(r["spans"].split(","))
    assert "iban:5:32" in got[5]["spans"] and "ssn:4:15" in got[6]["spans"]
    assert pii.pii_report(frame(spark, [], null_row=False)).count() == 0


# --- op5

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(found, items):
    windows = defaultdict(set)
    for item, t in items:
        w = ascii_words(t)
        n = min(8, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    spans = {len(w) for w in windows}
    out = {}
    for i, t in found:
        w = ascii_words(t)
        hit, names = set(), set()
        for s in spans:
            for p in range(len(w) - s + 1):
                if (x := tuple(w[p : p + s])) in windows:
                    hit |= set(range(p, p + s))
                    names |= windows[x]
        joined = ",".join(sorted(map(str, names)))
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(joined.encode()).hexdigest(), len(names) >= 2)
    return out


@pytest.mark.parametrize("limit", [20_000, 0])
@pytest.mark.parametrize("short", [True, False])
def test_decontamination(spark, limit, short):
    found = texts()
    items = [(1, found[6]), (2, " ".join(found[9].split(" ")[50:70]).upper()), (3, found[30]), (5, None), (6, "nothing of it " * 9), (12, found[30])]
    items += [(4, "one TWO, three"), (7, "w1")] if short else []
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(decontaminate.contamination(frame(spark, found, null_row=False), bench, max_broadcast=limit))
    want = brute_hits(enumerate(found), items)
    assert {k: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for k, r in got.items()} == want
    kept = decontaminate.drop_contaminated(frame(spark, found), bench)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, v in want.items() if not v[4]} | {None}
    assert kept.columns == frame(spark).columns


def test_decontamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.contamination(frame(spark), none).collect()
    assert len(out) == len(texts()) + 1 and not any(r["n_hit"] or r["contaminated"] for r in out)


# --- op6


def test_urls(spark):
    cases = {
        "http://Example.COM/en/7x?q": ("example.com", "/en/7x", "example.com/en/7", "allow"), "https://a.example.com/en/8#x": ("a.example.com", "/en/8", "com/en/", "block"),
        "x://b.net/de/": ("b.net", "/de/", "net/de/", "allow"), "x://b.example.net/de/81": ("b.example.net", "/de/81", "example.net/de/8", "block"),
        "http://org/es/": ("org", "/es/", "org/es/", "block"), "http://xorg/es/": ("xorg", "/es/", None, "allow"), None: ("", "", None, "allow"), "no url": ("", "", None, "allow"),
        "http://": ("", "", None, "allow"), "http://h?x=/en/": ("h", "", None, "allow"), "http://a.com/q?u=http://b.net/de/": ("a.com", "/q", None, "allow"),
    }
    df = spark.createDataFrame(list(enumerate([*cases, *cases])), "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS n", "'y' AS template")
    got = rows_of(urls.filter_urls(df), "page_id")
    for i, url in enumerate([*cases, *cases]):
        assert tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) == cases[url], url


def test_url_templates(spark):
    many = [(i, f"http://shop.com/en/item{i}/x") for i in range(40)] + [(40 + i, f"http://shop.com/fr/item{i}/x") for i in range(40)]
    got = rows_of(urls.filter_urls(spark.createDataFrame(many, "page_id long, url string")), "page_id")
    assert {got[i]["verdict"] for i in range(40)} == {"block"} and got[0]["purity"] > 0.6
    assert len({r["template"] for r in got.values()}) < 5
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


# --- op7


def test_mixing(spark):
    found = [words(__import__("random").Random(i), 1 + i % 90) for i in range(600)] + [None, ""]
    rows = [(i, t, "en", [None, "b", "a", "z", "é"][min(4, i % 7)], 0, 0, "", 0) for i, t in enumerate(found)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = rows_of(mixing.mix_to_targets(df))
    again = rows_of(mixing.mix_to_targets(df.repartition(5)))
    assert {k: r["taken"] for k, r in got.items()} == {k: r["taken"] for k, r in again.items()}
    sizes = Counter()
    for i, t, _, s, *_ in rows:
        sizes[s] += len((t or "").split())
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    # targets by repeated capping
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        level = (budget - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and level * weight[s] > 2 * sizes[s]}
        if not more:
            break
        full |= more
    taken = Counter()
    for i, t, _, s, *_ in rows:
        r = got[i]
        assert r["size"] == len((t or "").split()) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(2 * sizes[s] if s in full else level * weight[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in order:
        goal = 2 * sizes[s] if s in full else level * weight[s]
        assert abs(taken[s] - goal) <= 90
    assert mixing.mix_to_targets(df.limit(0)).count() == 0


# --- op2


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines(spark):
    a, b = "this is a line of some length", "quite another line, with éö in it"
    found = [f"{a}\n{b}\nshort", f"{a}x\nshort\n{b[:-1]}", a[1:], a.replace("some", "sone"), f"{a}\n{a}", None, "", "short", a + "xyz", b.upper(), f"x\n{a}xx", f"{b}\n\n{b}"]
    got = rows_of(lines.line_report(frame(spark, found, null_row=False)))
    flat = [(i, j, x) for i, t in enumerate(found) for j, x in enumerate((t or "").split("\n")) if len(x) >= 20]
    near = lambda x, y: x == y or edits(x, y) <= 1
    for i, t in enumerate(found):
        gone = {j for d, j, x in flat if d == i and any((e, k) < (i, j) and near(x, y) for e, k, y in flat)}
        rest = "\n".join(x for j, x in enumerate((t or "").split("\n")) if j not in gone)
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (len(gone), hashlib.sha256(rest.encode()).hexdigest()), t
        others = sum(len({y for _, _, y in flat if y != x and near(x, y)}) for d, j, x in flat if d == i)
        assert got[i]["n_links"] == others
    out = lines.dedup_lines(frame(spark))
    assert out.columns == frame(spark).columns and out.count() == frame(spark).count()
    assert lines.line_report(frame(spark, [], null_row=False)).count() == 0


# --- op10


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute_components(found):
    sets = [shingles(t) for t in found]
    top = list(range(len(found)))
    for i in range(len(found)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top[i], top[j]))
                top = [a if x == b else x for x in top]
    return [len(s) for s in sets], top


def test_near_duplicates(spark):
    import random

    rng = random.Random(5)
    found = texts()
    base = words(rng, 60).split(" ")
    for i in range(150):  # a chain of edits, and a star of copies
        copy = list(base)
        copy[rng.randrange(60)] = f"n{i}"
        found.append(" ".join(copy))
        if i % 10 == 0:
            base = copy
    got = rows_of(minhash.near_duplicates(frame(spark, found, null_row=False)))
    sizes, top = brute_components(found)
    for i in range(len(found)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (sizes[i], top[i], top[i] == i), i
    kept = minhash.drop_near_duplicates(frame(spark, found, null_row=False))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(top))
    assert kept.columns == frame(spark).columns


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(frame(spark, [], null_row=False)).count() == 0
    df = frame(spark)
    out = minhash.near_duplicates(df.unionByName(df)).collect()
    assert len(out) == 2 * df.count()
    assert minhash.drop_near_duplicates(df).where("doc_id is null").count() == 1


def test_suffix_hot_passage(spark):
    import random

    rng = random.Random(3)
    passage = words(rng, 60)
    found = [words(rng, 30) + " " + passage[: rng.choice([150, 300])] + words(rng, 20) for _ in range(200)]
    found += [words(rng, 10) + passage[rng.randrange(60) :] for _ in range(100)]
    got = rows_of(suffix.suffix_report(frame(spark, found, null_row=False).repartition(3)))
    want = brute_suffix(list(enumerate(found)))
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in got.items()} == want
