"""Personal data: regular expressions propose, checksums confirm, context words adjust.

Base kinds (email, ip, card, phone) are matched leftmost and without overlap; a match that
fails its validator (octets, Luhn, number of digits) is dropped and not retried. Added
kinds (iban with mod-97, ssn, keys of known issuers, secrets that are assigned to a name) are
kept if their score, raised by whole words within CONTEXT code points, reaches ``keep``. A
secret has to mix letters and digits, or to be quoted, and must not be one repeated
character. Base spans always stay; every span carries its score.

Spark has no built-in that returns match positions, so for each pattern the text is both
split (gaps) and searched (hits); positions are running sums of their lengths. The
patterns equal the plain ones but start only at run starts (or where the last match
ended) and use possessive quantifiers, so that long runs cost linear time.

Scale: one narrow pass, no shuffle, everything in built-in functions.

Defined cases: null and empty texts have no spans; offsets are code points, end exclusive;
other columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import text_of

LOCAL = r"[A-Za-z0-9._%+-]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Names that secrets are assigned to.
NAMES = "token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|private[_-]?key|credential"
#: kind: (pattern, what a text must contain, context words, score without them)
KINDS = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", ("mail", "contact"), 0.9),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", ("ip", "host", "server", "address"), 0.7),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None, ("card", "visa", "credit", "karte"), 0.8),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", ("phone", "call", "tel", "mobile"), 0.6),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None, ("iban", "bank", "konto"), 0.8),
    "ssn": (r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", ("ssn", "social security"), 0.3),
    "key": (
        r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|-----BEGIN\x20(?:[A-Z]+\x20)?PRIVATE\x20KEY-----)(?![A-Za-z0-9_])",
        r"AKIA|gh[pousr]_|sk-|xox|eyJ|PRIVATE KEY", ("key", "token", "secret", "aws", "auth"), 0.9,
    ),
    "secret": (
        rf"(?i)(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{{0,40}}(?:{NAMES})[A-Za-z0-9_-]{{0,40}}[\"']?[\x20\t]?[:=][\x20\t]?(?:\"[^\"\x00-\x20]{{8,512}}\"|'[^'\x00-\x20]{{8,512}}'|[A-Za-z0-9_+/=.~-]{{16,512}}(?![A-Za-z0-9_+/=.~-]))",
        rf"(?i){NAMES}", ("key", "login", "auth", "config", "export"), 0.7,
    ),
}
BASE = ("email", "ip", "card", "phone")
CONTEXT, BLOCK = 40, 512


def _scan(values: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(values, start, lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")))


def running_sums(values: Column) -> Column:
    """Exclusive running sums of array<long>; blocks keep the work near linear."""
    blocks = F.transform(F.sequence(F.lit(0), (F.size(values) - 1).cast("int")), lambda i: i)
    blocks = F.filter(blocks, lambda i: i % BLOCK == 0)
    parts = F.transform(blocks, lambda i: _scan(F.slice(values, i + 1, BLOCK)))
    offsets = _scan(F.transform(parts, lambda p: p["s"]))["out"]
    return F.flatten(F.zip_with(parts, offsets, lambda p, o: F.transform(p["out"], lambda v: v + o)))


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total, i):
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def add(rest, i):
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(turned)), F.lit(0), add) == 1


def valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        digits = F.regexp_replace(hit, r"[\x20-]", "")
        return F.when(F.char_length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(F.regexp_replace(hit, "[^0-9]", "")).between(8, 15)
    if kind == "secret":
        value = F.regexp_extract(hit, r"[:=][\x20\t]?(.*)$", 1)
        varied = ~value.rlike(r"^[\"']?(.)\1*[\"']?$")
        return varied & (value.rlike("^[\"']") | (value.rlike("[0-9]") & value.rlike("[A-Za-z]")))
    if kind == "iban":
        return mod97(F.replace(hit, F.lit(" "), F.lit("")))
    return F.lit(True)


def find_spans(docs: DataFrame, keep: float = 0.6) -> DataFrame:
    """doc_id and, per kind, an array of struct(kind, start, end, text, score)."""
    df = docs.select("doc_id", text_of(docs).alias("text"))
    has = lambda part: F.contains("text", F.lit(part)) if part and len(part) == 1 else F.rlike("text", F.lit(part or "[0-9]"))
    none = F.array().cast("array<string>")
    df = df.select("doc_id", "text", *[F.when(has(p[1]), F.regexp_extract_all("text", F.lit(p[0]), F.lit(0))).otherwise(none).alias(f"hits_{k}") for k, p in KINDS.items()])
    df = df.select("doc_id", *[f"hits_{k}" for k in KINDS], *[F.when(F.size(f"hits_{k}") > 0, F.split("text", p[0], -1)).alias(f"gaps_{k}") for k, p in KINDS.items()])
    sums = {}
    for k in KINDS:
        hits, gaps = F.col(f"hits_{k}"), F.col(f"gaps_{k}")
        lens = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: (F.char_length(g) + F.char_length(h)).cast("long"))
        sums[f"lens_{k}"] = F.when(F.size(hits) > 0, lens)
    df = df.select("*", *[c.alias(n) for n, c in sums.items()])
    df = df.select("*", *[F.when(F.size(f"hits_{k}") > 0, running_sums(F.col(f"lens_{k}"))).alias(f"at_{k}") for k in KINDS])
    return df.select("doc_id", *[_spans_of(k, keep).alias(k) for k in KINDS])


def _spans_of(kind: str, keep: float) -> Column:
    _, _, words, score = KINDS[kind]
    hits, gaps, at = F.col(f"hits_{kind}"), F.col(f"gaps_{kind}"), F.col(f"at_{kind}")

    def span(i):
        start = at[i] + F.char_length(gaps[i])
        near = F.lower(F.concat(F.right(gaps[i], F.lit(CONTEXT)), F.lit(" "), F.left(gaps[i + 1], F.lit(CONTEXT))))
        boost = F.when(near.rlike(rf"(?<![a-z0-9])(?:{'|'.join(words)})s?(?![a-z0-9])"), 0.3).otherwise(0.0)
        return F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), (start + F.char_length(hits[i])).alias("end"),
            hits[i].alias("text"), F.least(F.lit(1.0), F.lit(score) + boost).alias("score"),
        )

    passed = F.filter(F.sequence(F.lit(0), F.size(hits) - 1), lambda i: valid(kind, hits[i]))
    spans = F.transform(passed, span)
    if kind not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= keep)
    shape = "array<struct<kind:string,start:bigint,end:bigint,text:string,score:double>>"
    return F.when(F.size(hits) > 0, spans).otherwise(F.array()).cast(shape)


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans, scores (of spans, in their order)."""
    found = find_spans(docs)
    label = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    line = lambda kinds, shown=label: F.array_join(F.concat(*[F.transform(k, shown) for k in kinds]), ",")
    total = lambda kinds: sum((F.size(k) for k in kinds), F.lit(0)).cast("long")
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(line(BASE), 256).alias("base_sha256"),
        line(KINDS).alias("spans"), total([k for k in KINDS if k not in BASE]).alias("n_added"), total(KINDS).alias("n_spans"),
        line(KINDS, lambda s: F.format_string("%.2f", s["score"])).alias("scores"),
    )

