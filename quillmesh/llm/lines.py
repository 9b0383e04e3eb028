"""Line dedup by a segment-partition edit join.

A line of at least MIN_CHARS code points is a duplicate if it equals an earlier line, or
differs from one by at most TAU edits; earlier is by (doc_id, line number), judged on the
input. With exact_short, as in the query and the pipeline, every shorter line that is not
empty is a duplicate too if it equals an earlier one.

Lines are split into TAU + 1 segments, of which any two lines within TAU edits share one.
Every line is indexed under (length, segments), and probes the indexes of its own length
and of those up to TAU shorter with the substrings at the places that so many edits can
move them to.

* one edit: the edit lies in one of the two segments, and what stands around it is shared.
  Keys under which more than HOT lines meet are made anew around each half of the segment,
  again and again; around a piece of one character whoever meets is linked, but for a few.
  So the candidates stay near HOT times the lines plus the links, whatever halves, headers
  or templates the lines have in common.
* more edits: one key a segment; lines with a common segment are told apart by their words
  only (below), so a segment that very many lines share costs the square of their number.

Candidates are verified by a banded bit-parallel edit distance: the vertical differences
of the 2 * TAU + 1 diagonals are bits of one long, and a column is a few logical operations.

Candidates must also agree in the parities of their words' classes but for three an edit.

Scale: lines are read narrowly; equal lines are merged by partial hash aggregation, all
buffers being plain numbers, before keys are made into rows, so that copies cost one row.
Keys are 8 bytes and counted with partial aggregation; only keys that lines share are
joined, and texts are fetched for candidates only. Nothing is collected.

Defined cases: null and empty texts have no lines; empty lines stay, and without exact_short
all lines under MIN_CHARS; documents keep their rows (those whose lines all go keep an empty
text); repeated rows are at the same place and keep their lines together; null doc_ids come
first; a doc_id with several texts is judged text by text; other columns stay as they are,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bind, fresh, materialize, text_of

TAU, MIN_CHARS = 1, 20
PIECES, HOT = 2, 16
#: Hashes of candidate lines are broadcast up to this number (16 MB).
MAX_BROADCAST = 2_000_000
#: Places are doc_id * LINES + line number, as decimals, so that the least is found by hash aggregation.
LINES = 1 << 31


def _bounds(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and size of part i of a line of that length."""
    start = F.floor(length * i / parts).cast("int")
    return start, (F.floor(length * (i + 1) / parts) - start).cast("int")


def _around(line: Column, length: Column, i: Column | int, pieces: Column | int, moved: int) -> Column:
    """Key of what stands around piece i of an indexed line of that length; moved: how much longer this line is there."""
    start, end = F.floor(length * i / pieces).cast("int"), F.floor(length * (i + F.lit(1)) / pieces).cast("int")
    return F.xxhash64(length, F.lit(pieces) if isinstance(pieces, int) else pieces, F.lit(i) if isinstance(i, int) else i, F.left(line, start), F.substr(line, end + 1 + moved))


def _segment(line: Column, length: Column, i: int, move: int, tau: int) -> Column:
    """Key of segment i of tau + 1 of an indexed line of that length, found moved in this one."""
    start, size = _bounds(length, i, tau + 1)
    return F.xxhash64(length, F.lit(i), F.substr(line, start + 1 + move, size))


def index_keys(line: Column, length: Column, tau: int = TAU) -> list[Column]:
    if tau == 1:
        return [_around(line, length, i, PIECES, 0) for i in range(PIECES)]
    return [_segment(line, length, i, 0, tau) for i in range(tau + 1)]


def probe_keys(line: Column, length: Column, tau: int = TAU) -> list[Column]:
    """Keys under which lines of this length or up to tau shorter may be indexed, but its own index keys if tau is 1."""
    if tau == 1:
        return [_around(line, length - 1, i, PIECES, 1) for i in range(PIECES)]
    keys = []
    for shorter in range(tau + 1):
        for i in range(tau + 1):
            low, high = max(-i, shorter - (tau - i)), min(i, shorter + (tau - i))
            keys += [_segment(line, length - shorter, i, move, tau) for move in range(low, high + 1)]
    return keys


def word_mask(line: Column) -> Column:
    """Parities of the numbers of words in 64 classes; an edit changes at most three of them."""
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))
    return F.aggregate(F.split(line, " ", -1), F.lit(0).cast("long"), lambda mask, w: mask.bitwiseXOR(bit(w)))


def banded_edits(x: Column, y: Column, tau: int) -> Column:
    """Edit distance, or tau + 1 if it is larger; bit b of a column is row (column - tau + b) of the table."""
    if 2 * tau + 1 > 62:
        raise ValueError("the band has to fit a long")
    width, all_ = 2 * tau + 1, F.lit((1 << 2 * tau + 1) - 1).cast("long")
    m, n = F.char_length(x), F.char_length(y)
    both, either = (lambda a, b: a.bitwiseAND(b)), (lambda a, b: a.bitwiseOR(b))
    bit = lambda v, at: F.call_function("shiftrightunsigned", v, at).bitwiseAND(F.lit(1).cast("long")).cast("int")

    def column(a: Column, j: Column, xs: Column, ys: Column) -> Column:
        same = [F.when(F.coalesce(F.get(xs, j - tau + b - 1) == F.get(ys, j - 1), F.lit(False)) & (j - tau + b >= 1), F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(width)]
        match = same[0]
        for s in same[1:]:
            match = either(match, s)

        def step(eq: Column) -> Column:
            plus, minus = a["plus"], a["minus"]
            zero = either(either((both(eq, plus) + plus).bitwiseXOR(plus), eq), minus)

            def rest(d: Column) -> Column:
                right = either(minus, F.bitwise_not(either(d, plus)))
                left = both(d, plus)
                down = F.call_function("shiftrightunsigned", both(d, all_), F.lit(1))
                # down the lowest diagonal, and from its end along the last row
                edge = j + tau <= m
                row = m - j + tau
                along = F.when(row >= 0, bit(right, F.greatest(row, F.lit(0))) - bit(left, F.greatest(row, F.lit(0)))).otherwise(0)
                far = a["far"] + F.when(edge, 1 - bit(d, F.lit(width - 1))).otherwise(along)
                return F.struct(
                    both(either(left, F.bitwise_not(either(down, right))), all_).alias("plus"), both(down, right).alias("minus"), far.cast("int").alias("far")
                )

            return bind(both(zero, all_), lambda d: rest(d))

        return bind(match, lambda eq: step(eq))

    # rows below the first have differences of one in column 0
    start = F.struct(F.lit(((1 << width) - 1) ^ ((1 << tau) - 1)).cast("long").alias("plus"), F.lit(0).cast("long").alias("minus"), F.least(F.lit(tau), m).cast("int").alias("far"))
    over = lambda xs, ys: F.aggregate(F.sequence(F.lit(1), n), start, lambda a, j: column(a, j, xs, ys))["far"]
    done = bind(F.split(x, "", -1), lambda xs: bind(F.split(y, "", -1), lambda ys: over(xs, ys)))
    return F.when(F.abs(m - n) > tau, tau + 1).when((m == 0) | (n == 0), F.greatest(m, n)).otherwise(F.least(done, F.lit(tau + 1)))


def lines_of(docs: DataFrame) -> DataFrame:
    text = text_of(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n", -1)).alias("no", "line"))


def _place() -> Column:
    doc = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)"))
    return doc * F.lit(str(LINES)).cast("decimal(10,0)") + F.col("no").cast("decimal(10,0)")


def _some(df: DataFrame, few: DataFrame, on: str) -> DataFrame:
    """The rows whose value is among those of a written table; broadcast only up to a bound."""
    return df.join(F.broadcast(few) if few.count() <= MAX_BROADCAST else few, on, "left_semi")


def _meeting(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of keys that up to HOT lines share, rows of keys that more share) of (key, h, role, ...)."""
    keys = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("role").alias("least")).where("m > 1 and least = 0").select("key", "m"))
    few, many = keys.where(F.col("m") <= HOT).select("key"), keys.where(F.col("m") > HOT).select("key")
    return _some(rows, few, "key"), _some(rows, many, "key")


def _pairs(rows: DataFrame) -> DataFrame:
    """Role 0 is an indexed line, 1 one that is longer or only probes."""
    a = rows.where("role = 0").select("key", F.col("h").alias("a"))
    b = rows.select("key", F.col("h").alias("b"), "role")
    pairs = a.join(b, "key").where((F.col("a") != F.col("b")) & ((F.col("role") == 1) | (F.col("a") < F.col("b"))))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _candidates(kinds: DataFrame, long: DataFrame, tau: int, n_own: int, n_seek: int) -> DataFrame:
    """Distinct (a, b) of hashes of lines that may be within tau edits."""
    entry = lambda name, i, role: F.struct(F.col(f"{name}{i}").alias("key"), F.lit(i).alias("piece"), F.lit(role).alias("role"))
    entries = F.array(*[entry("own", i, 0) for i in range(n_own)], *[entry("seek", i, 1) for i in range(n_seek)])
    rows = kinds.where("own0 is not null").select("h", "len", F.explode(entries).alias("e")).select("e.key", "h", "len", "e.piece", "e.role")
    if tau > 1:
        # a line may probe a key several times, and its own
        rows = rows.groupBy("key", "h").agg(F.min("role").alias("role"), F.max("role").alias("also"))
        rows = rows.withColumn("role", F.explode(F.array_distinct(F.array("role", "also")))).drop("also")
        shared, hot = _meeting(rows)
        return materialize(_pairs(shared.unionByName(hot)).distinct())
    shared, hot = _meeting(rows)
    pairs, pieces = materialize(_pairs(shared)), PIECES
    hot = materialize(hot)
    texts = None
    while hot.take(1):
        if texts is None:
            texts = materialize(_some(long.select("h", "line"), materialize(hot.select("h").distinct()), "h").groupBy("h", "line").agg(F.count(F.lit(1)).alias("m")))
        # pieces of one character cannot be halved: all who meet there are candidates
        done = F.col("len") - F.col("role") <= pieces
        pairs = pairs.unionByName(materialize(_pairs(hot.where(done))))
        inner = hot.where(~done).join(texts.select("h", "line"), "h")
        halves = inner.withColumn("piece", F.explode(F.array(F.col("piece") * 2, F.col("piece") * 2 + 1)))
        pieces *= 2
        moved = lambda role: _around(F.col("line"), F.col("len") - role, F.col("piece"), pieces, role)
        rows = materialize(halves.select(F.when(F.col("role") == 0, moved(0)).otherwise(moved(1)).alias("key"), "h", "len", "piece", "role"))
        shared, hot = _meeting(rows)
        pairs, hot = pairs.unionByName(materialize(_pairs(shared))), materialize(hot)
    return materialize(pairs.distinct())


def duplicate_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, exact_short: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, no, links for every duplicate or linked line with its fate; verified links)."""
    lines = lines_of(docs)
    length = F.char_length("line")
    long = lines.where(length >= (1 if exact_short else min_chars)).withColumns({"h": F.xxhash64("line"), "h2": F.xxhash64("line", F.lit(1))})
    slim = materialize(long.select("doc_id", "t", "no", "h", "h2"))
    own, seek = index_keys(F.col("line"), length, tau), probe_keys(F.col("line"), length, tau)
    # shorter lines have no keys, so that only their equals count
    keys = {f"own{i}": k for i, k in enumerate(own)} | {f"seek{i}": k for i, k in enumerate(seek)}
    keyed = long.select("h", "h2", length.alias("len"), _place().alias("at"), *[F.when(length >= min_chars, k).alias(n) for n, k in keys.items()])
    kinds = keyed.groupBy("h", "h2", "len").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), *[F.min(n).alias(n) for n in keys])
    kinds = materialize(kinds)
    pairs = _candidates(kinds, long, tau, len(own), len(seek))
    wanted = materialize(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct())
    texts = _some(long, wanted, "h").groupBy("h", "h2").agg(F.first("line").alias("line"), F.min(_place()).alias("first"))
    texts = materialize(texts.withColumn("mask", word_mask(F.col("line"))))
    # lines that differ in too many words are no candidates
    mask = lambda end: texts.select(F.col("h").alias(end), F.col("mask").alias(f"{end}_mask"))
    close = F.bit_count(F.col("a_mask").bitwiseXOR(F.col("b_mask"))) <= 3 * tau
    pairs = pairs.join(mask("a"), "a").join(mask("b"), "b").where(close).select("a", "b").distinct()
    end = lambda name, text: texts.select(F.col("h").alias(name), F.col("h2").alias(f"{name}2"), F.col("line").alias(text), F.col("first").alias(f"{text}_first"))
    both = materialize(pairs.join(end("a", "x"), "a").join(end("b", "y"), "b"))
    # written before, so that no filter makes the distance twice
    judged = both.select("a", "a2", "b", "b2", "x_first", "y_first", banded_edits(F.col("x"), F.col("y"), tau).alias("edits"))
    links = materialize(judged).where(F.col("edits").between(1, tau)).drop("edits")
    ends = links.select(F.col("a").alias("h"), F.col("a2").alias("h2"), (F.col("y_first") < F.col("x_first")).cast("int").alias("late"))
    ends = ends.union(links.select("b", "b2", (F.col("x_first") < F.col("y_first")).cast("int")))
    ends = ends.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("links"), F.max("late").alias("late"))
    fate = kinds.select("h", "h2", "first", "n").join(ends, ["h", "h2"], "left").where("n > 1 or links is not null")
    fate = materialize(fate.select("h", "h2", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce(F.col("late") == 1, F.lit(False)).alias("late")))
    found = slim.join(fate, ["h", "h2"])
    gone = F.col("late") | (_place() != F.col("first"))
    return found.select("doc_id", "t", "no", "links", gone.alias("gone")), links


def _per_document(docs: DataFrame, tau: int, min_chars: int, exact_short: bool) -> DataFrame:
    """d, t, gone (line numbers), links of documents with a duplicate or linked line."""
    found, _ = duplicate_lines(docs, tau, min_chars, exact_short)
    out = found.groupBy(F.col("doc_id").alias("d"), "t").agg(F.collect_set(F.when(F.col("gone"), F.col("no"))).alias("gone"), F.collect_set(F.struct("no", "links")).alias("linked"))
    links = F.aggregate("linked", F.lit(0).cast("long"), lambda a, x: a + x["links"])
    return materialize(out.select("d", "t", "gone", links.alias("links")))


def _rest(text: Column, gone: Column) -> Column:
    """The text without lines whose numbers are given; what stands between two of them is sliced out as a whole."""

    def kept(lines: Column, cuts: Column) -> Column:
        between = F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda i: F.slice(lines, cuts[i - 1] + 2, cuts[i] - cuts[i - 1] - 1))
        return F.array_join(F.flatten(between), "\n")

    cut = bind(F.split(text, "\n", -1), lambda lines: bind(F.array_sort(F.concat(gone, F.array(F.lit(-1), F.size(lines)))), lambda cuts: kept(lines, cuts)))
    return F.when(gone.isNull() | (F.size(gone) == 0), text).otherwise(cut)


def _joined(docs: DataFrame, per: DataFrame, names: list[str]) -> DataFrame:
    per = per.toDF(*names)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(names[0])) & (F.xxhash64(text_of(docs)) == F.col(names[1]))
    return docs.join(per, same, "left")


def dedup_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, exact_short: bool = False) -> DataFrame:
    """The documents, all columns, without duplicate lines; n_chars is counted anew where it exists."""
    per = _per_document(docs.select("doc_id", "text"), tau, min_chars, exact_short)
    names = [fresh(docs, n) for n in ("lines_d", "lines_t", "lines_gone", "lines_links", "lines_rest")]
    both, gone, rest = _joined(docs, per, names[:4]), F.col(names[2]), F.col(names[4])
    changed = F.size(gone) > 0
    out = both.withColumn(names[4], F.when(changed, _rest(text_of(docs), gone)))
    new = {"text": F.when(changed, rest).otherwise(docs["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length(rest).cast("long")).otherwise(docs["n_chars"])
    return out.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])


def line_report(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, exact_short: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed, n_links (of its lines, to other texts), kept_sha256."""
    slim = docs.select("doc_id", "text")
    both = _joined(slim, _per_document(slim, tau, min_chars, exact_short), ["d", "t", "gone", "links"])
    text = text_of(slim)
    n_lines = F.when(text == "", 0).otherwise(F.size(F.split(text, "\n", -1)))
    n_gone = F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0))
    return both.select(
        "doc_id", n_lines.cast("long").alias("n_lines"), n_gone.cast("long").alias("n_removed"),
        F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.sha2(_rest(text, F.col("gone")), 256).alias("kept_sha256"),
    )
