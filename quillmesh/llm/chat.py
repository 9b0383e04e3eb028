"""Chat formatting by quotation linking.

Messages quote others by leading ``>`` marks, nested to any level. Lines are split into
own text (level 0) and runs of one quote level; attribution lines such as "Ann wrote:"
directly before a quote are dropped. Quoted runs, and the single lines in them, are
normalised (ASCII lower case, runs of anything but letters and digits to one space),
hashed, and joined to the paragraphs and whole own texts of all messages. A message
replies to the message of its least deep linked quote: the first one in its own
conversation that holds the passage, else the first in any other. Passages of any length
link; among quotes of one level those under SHORT_CHARS normalised characters, often mere
greetings, count only where no longer one links. Conversations are rebuilt without quotes:
``thread`` is the first turn of the reply thread and ``depth`` the number of messages from
there on. A reply's turn is above the turn that it answers, so sorting by (conv_id, thread,
turn) puts every reply after what it answers.

Scale: the index of passages holds one row per (hash, conversation), by partial
aggregation; both joins are on unique keys, so no pairs multiply however common a passage
is. Threads are resolved by pointer doubling on (turn, turn above, distance), in rounds up to
the log of their depth; a row stays a row however long the chain. No window or list over a
conversation is used.

Defined cases: a null text is empty; a null conv_id, turn or role is kept as it is, and
messages with a null conv_id or turn neither link nor are linked; repeated rows each get a
result; equal passages link to the earliest message; a carriage return at the end of a line
is dropped; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ascii_lower, bind, materialize, text_of

MARKS = r"^(?:[\x20\t]{0,3}>)*"
SAYS = r"\b(wrote|writes|said|schrieb|escribió|écrit)\s*:\s*$"
SHORT_CHARS = 12


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _lines(text: Column) -> Column:
    """struct(level, text) per line, without attribution lines before a quote."""
    mark = lambda x: F.regexp_extract(x, MARKS, 0)
    level = lambda x: F.char_length(F.regexp_replace(mark(x), "[^>]", ""))
    leveled = F.transform(
        F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, "\r$", "")),
        lambda x: F.struct(level(x).alias("level"), F.when(level(x) > 0, F.ltrim(F.regexp_replace(x, MARKS, ""))).otherwise(x).alias("text")),
    )

    def kept(line: Column) -> Column:
        deeper = lambda i: F.coalesce(F.get(line, i + 1)["level"], F.lit(0)) > line[i]["level"]
        says = lambda i: deeper(i) & line[i]["text"].rlike(SAYS)
        return F.filter(line, lambda x, i: ~says(i))

    return bind(leveled, lambda line: kept(line))


def _runs(line: Column) -> Column:
    """struct(level, lines) of neighbouring lines of one level above 0."""
    starts = F.filter(F.sequence(F.lit(0), F.size(line) - 1), lambda i: (i == 0) | (line[i]["level"] != line[F.greatest(i - 1, F.lit(0))]["level"]))

    def cut(at: Column) -> Column:
        end = lambda k: F.coalesce(F.get(at, k + 1), F.size(line))
        texts = lambda k: F.transform(F.slice(line, at[k] + 1, end(k) - at[k]), lambda x: x["text"])
        return F.transform(F.sequence(F.lit(0), F.size(at) - 1), lambda k: F.struct(line[at[k]]["level"].alias("level"), texts(k).alias("lines")))

    return F.filter(bind(starts, lambda at: cut(at)), lambda r: r["level"] > 0)


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own, quotes: array of struct(level, text, lines)."""

    def parts(line: Column) -> Column:
        own = F.array_join(F.transform(F.filter(line, lambda x: x["level"] == 0), lambda x: x["text"]), "\n")
        none = F.array().cast("array<struct<level:int,lines:array<string>>>")
        some = F.exists(line, lambda x: x["level"] > 0)
        return F.struct(F.trim(own).alias("own"), F.when(some, _runs(line)).otherwise(none).alias("runs"))

    df = messages.select("conv_id", "turn", "role", bind(_lines(text_of(messages)), lambda line: parts(line)).alias("p"))
    whole = lambda r: F.struct(r["level"].alias("level"), F.array_join(r["lines"], " ").alias("text"), r["lines"].alias("lines"))
    return df.select("conv_id", "turn", "role", "p.own", F.transform("p.runs", whole).alias("quotes"))


def _passages(texts: Column) -> Column:
    """Distinct struct(short, hash) of those that are not empty."""
    clean = F.filter(F.transform(texts, normalised), lambda x: x != "")
    return F.array_distinct(F.transform(clean, lambda x: F.struct((F.char_length(x) < SHORT_CHARS).alias("short"), F.md5(x.cast("binary")).alias("hash"))))


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, own, n_quotes, quote_levels, reply_conv, reply_turn, thread (its first turn), depth."""
    df = materialize(parsed(messages).withColumn("key", F.md5(F.concat_ws("\x1e", F.coalesce(F.col("role").cast("string"), F.lit("")), "own", F.to_json("quotes")).cast("binary"))))
    known = df.where("conv_id is not null and turn is not null")
    parts = known.select("conv_id", "turn", F.explode(_passages(F.concat(F.split("own", r"\n+", -1), F.array("own")))["hash"]).alias("hash"))
    local = parts.groupBy("hash", "conv_id").agg(F.min("turn").alias("at"))
    asked = known.where(F.size("quotes") > 0)
    probe = F.flatten(F.transform("quotes", lambda q: F.transform(_passages(F.concat(F.array(q["text"]), q["lines"])), lambda p: F.struct(q["level"].alias("level"), p["short"].alias("short"), p["hash"].alias("hash")))))
    probes = asked.select("conv_id", "turn", "key", F.explode(F.array_distinct(probe)).alias("p")).select("conv_id", "turn", "key", "p.level", "p.short", "p.hash")
    needed = local.join(probes.select("hash").distinct(), "hash", "left_semi")
    needed = materialize(needed)
    first = needed.groupBy("hash").agg(F.min(F.struct("conv_id", "at")).alias("first"))
    # a conversation that is itself the first to hold a passage looks to the second
    first = materialize(first)
    others = needed.join(first.select("hash", F.col("first.conv_id").alias("conv_id")), ["hash", "conv_id"], "left_anti")
    second = others.groupBy("hash").agg(F.min(F.struct("conv_id", "at")).alias("second"))
    first = first.join(second, "hash", "left")
    probes = probes.join(needed, ["hash", "conv_id"], "left").join(first, "hash", "left")
    other = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    inside = F.when(F.col("at") < F.col("turn"), F.struct(F.lit(0).alias("far"), "level", "short", F.col("conv_id").alias("conv"), F.col("at").alias("turn")))
    away = F.when(other.isNotNull(), F.struct(F.lit(1).alias("far"), "level", "short", other["conv_id"].alias("conv"), other["at"].alias("turn")))
    links = probes.groupBy("conv_id", "turn", "key").agg(F.min(F.coalesce(inside, away)).alias("to"))
    links = materialize(links.where("to is not null").select("conv_id", "turn", "key", F.col("to.conv").alias("reply_conv"), F.col("to.turn").alias("reply_turn")))
    # threads: within a conversation, each turn points at the turn it answers
    up = links.where("reply_conv = conv_id").groupBy("conv_id", "turn").agg(F.min("reply_turn").alias("up"))
    up = materialize(up.withColumn("far", F.lit(1).cast("long")))
    while True:
        above = up.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"))
        step = up.join(above, ["conv_id", "up"], "left")
        moved = step.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.col("up2").isNotNull().alias("more"))
        moved = materialize(moved)
        up = moved.drop("more")
        if not moved.where("more").take(1):
            break
    threads = up.select("conv_id", "turn", F.col("up").alias("thread"), "far")
    out = df.join(links, ["conv_id", "turn", "key"], "left").join(threads, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "own", F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0)).cast("long").alias("quote_levels"),
        "reply_conv", "reply_turn", F.coalesce("thread", "turn").alias("thread"), (F.coalesce("far", F.lit(0)) + 1).cast("long").alias("depth"),
    )


def chat_messages(messages: DataFrame) -> DataFrame:
    """The messages as role-tagged text, to be sorted by conv_id, thread and turn."""
    role = F.coalesce(F.col("role").cast("string"), F.lit("user"))
    return link_quotes(messages).withColumn("formatted", F.concat(F.lit("<|"), role, F.lit("|>\n"), "own", F.lit("\n<|end|>\n")))
