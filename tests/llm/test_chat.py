"""Quotation links of chat messages."""

import random
import re
from collections import Counter

from quillmesh.llm import chat


def links(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {(r["conv_id"], r["turn"]): (r["reply_conv"], r["reply_turn"], r["thread"]) for r in chat.link_quotes(df).collect()}


def test_short_quotes(spark):
    rows = [
        (1, 0, "user", "Shall we meet on the first of May?"), (1, 1, "user", "Yes, agreed"), (1, 2, "user", "> Yes, agreed\nThen see you there."),
        (1, 3, "user", "我同意这个建议。"), (1, 4, "user", "> 我同意这个建议。\n好"), (1, 5, "user", "> ...\nnothing is quoted"),
        (2, 0, "user", "Hello"), (2, 1, "user", "Hello\nThe actual point is a longer one."), (2, 2, "user", "> Hello\n> The actual point is a longer one.\nRight."),
        (2, 3, "user", "Hello\nThe train leaves at noon or so."), (2, 4, "user", "> Hello\n> The train leaves at noon or so.\nLate."), (2, 5, "user", "> Hello\n> never written by anyone\nWho?"),
    ]
    got = links(spark, rows)
    assert got[1, 2] == (1, 1, 1) and got[1, 4] == (1, 3, 3) and got[1, 5] == (None, None, 5)
    # a greeting does not draw the link from the longer passage beside it
    assert got[2, 2][:2] == (2, 1) and got[2, 4][:2] == (2, 3) and got[2, 5][:2] == (2, 0)


def test_original_elsewhere(spark):
    passage = "a passage that was first written elsewhere"
    rows = [
        (1, 0, "user", f"> {passage}\nI looked it up."), (1, 1, "user", passage), (5, 3, "user", passage), (5, 7, "user", passage), (7, 0, "user", passage),
        (8, 0, "user", f"> {passage}\nMe too."), (2, 0, "user", "> only this message says so\nonly this message says so"),
    ]
    got = links(spark, rows)
    assert got[1, 0][:2] == (5, 3) and got[8, 0][:2] == (1, 1) and got[2, 0][:2] == (None, None)


def plain(rows: list[tuple]) -> list[tuple]:
    """The docstring's rules, message by message: own, n_quotes, levels, reply, thread, depth."""

    def norm(x):
        return re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), x)).strip(" ")

    def split(text):
        lines = []
        for x in (text or "").split("\n"):
            x = re.sub("\r$", "", x)
            mark = re.match(r"(?:[\x20\t]{0,3}>)*", x)[0]
            lines.append((mark.count(">"), x[len(mark) :].lstrip(" ") if mark.count(">") else x))
        lines = [x for i, x in enumerate(lines) if not (i + 1 < len(lines) and lines[i + 1][0] > x[0] and re.search(r"\b(wrote|writes|said|schrieb|escribió|écrit)\s*:\s*$", x[1]))]
        runs = []
        for i, (level, x) in enumerate(lines):
            if i and lines[i - 1][0] == level:
                runs[-1][1].append(x)
            else:
                runs.append((level, [x]))
        return "\n".join(x for level, x in lines if not level).strip(" "), [r for r in runs if r[0]]

    read = [split(r[3]) for r in rows]
    holders = {}
    for (conv, turn, _, _), (own, _) in zip(rows, read):
        if conv is not None and turn is not None:
            for x in {norm(p) for p in [*re.split(r"\n+", own), own]} - {""}:
                at = holders.setdefault(x, {})
                at[conv] = min(turn, at.get(conv, turn))
    replies = []
    for (conv, turn, _, _), (_, quotes) in zip(rows, read):
        found = []
        if conv is not None and turn is not None:
            for level, lines in quotes:
                for x in {norm(p) for p in [" ".join(lines), *lines]} - {""}:
                    at = holders.get(x, {})
                    others = [(c, t) for c, t in at.items() if c != conv]
                    if at.get(conv, turn) < turn:
                        found.append((0, level, len(x) < 12, conv, at[conv]))
                    elif others:
                        found.append((1, level, len(x) < 12, *min(others)))
        replies.append(min(found)[3:] if found else (None, None))
    up = {}
    for (conv, turn, _, _), (c, t) in zip(rows, replies):
        if c is not None and c == conv:
            up[conv, turn] = min(t, up.get((conv, turn), t))
    out = []
    for (conv, turn, _, _), (own, quotes), reply in zip(rows, read, replies):
        top, depth = turn, 1
        while (conv, top) in up:
            top, depth = up[conv, top], depth + 1
        out.append((conv, turn, own, len(quotes), max([q[0] for q in quotes], default=0), *reply, top, depth))
    return out


def test_against_plain(spark):
    rng = random.Random(4)
    says = ["On Monday Ann wrote:", "Bob said:", "Er schrieb:  "]
    rows, texts = [], []
    for conv in [1, 2, 3, 4, None]:
        for turn in range(14):
            own = " ".join(rng.choice(["yes", "No!", "the point", "a longer remark about it", "ok", "Größe", "我同意"]) + rng.choice(["", ".", f" {rng.randrange(9)}"]) for _ in range(rng.randrange(1, 6)))
            lines = [own] if rng.random() < 0.8 else [own, "", "another paragraph here"]
            for _ in range(rng.randrange(3)):
                if texts:
                    level, quoted = rng.randrange(1, 4), rng.choice(texts).split("\n")
                    lines = [rng.choice(says)] * rng.randrange(2) + [rng.choice(["> ", ">", " > "]) * level + x for x in quoted] + lines
            texts.append(own)
            rows.append((conv, turn if rng.random() < 0.95 else None, rng.choice(["user", None]), "\r\n".join(lines) if rng.random() < 0.1 else "\n".join(lines)))
    rows += [rows[3], rows[20], (5, 0, "user", None), (5, 1, "user", ""), (5, 2, "user", "> "), (5, 2, "user", ">>> deep\n> shallow\nx"), (5, 3, "user", "x\x1ey\x1d> z" * 2000)]
    # a chain in which every message quotes the one before, and all that stands above it
    chain = ["first remark of a chain of replies"]
    rows.append((9, 0, "user", chain[0]))
    for i in range(1, 40):
        quoted = "\n".join("> " + x for x in rows[-1][3].split("\n")[-3:])
        rows.append((9, i, "user", f"{quoted}\nremark number {i} of the chain"))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, hash string, p int")
    names = ("conv_id", "turn", "own", "n_quotes", "quote_levels", "reply_conv", "reply_turn", "thread", "depth")
    got = Counter(tuple(r[n] for n in names) for r in chat.link_quotes(df).collect())
    assert got == Counter(plain(rows))
    assert max(r[8] for r in got) == 40
    assert chat.link_quotes(df.limit(0)).count() == 0
