"""SQL of the training-data queries for another engine, over views with the names of the tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


def _mixing(passes: int = 4) -> str:
    """Targets by water filling, inclusion odds by size class, and the passes of the cut along the Pareto order."""
    level = "coalesce(max(CASE WHEN cap / weight >= try THEN try END) OVER ({by}), 0.0)"
    tried = "(budget - coalesce(sum(cap) OVER ({by} ORDER BY cap / weight, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER ({by} ORDER BY cap / weight, tie ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    steps = [
        "d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents)",
        "s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)",
        "s1 AS (SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, (source_size * 2.0::DOUBLE) AS cap, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS budget, source AS tie FROM s0)",
        f"s2 AS (SELECT *, {tried.format(by='')} AS try FROM s1)",
        f"s3 AS (SELECT source, source_size, least(cap, {level.format(by='')} * weight) AS target FROM s2)",
        "s AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole, target - CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END * source_size AS rest FROM s3)",
        "c0 AS (SELECT source, length(bin(size)) AS class, sum(size)::BIGINT AS words FROM d WHERE size > 0 GROUP BY ALL)",
        "c1 AS (SELECT c0.source, class, words::DOUBLE AS cap, (ceil(sqrt(power(2.0::DOUBLE, class)))::BIGINT * words)::DOUBLE AS weight, ceil(sqrt(power(2.0::DOUBLE, class)))::BIGINT AS g, rest AS budget, class AS tie FROM c0 JOIN s ON s.source IS NOT DISTINCT FROM c0.source)",
        f"c2 AS (SELECT *, {tried.format(by='PARTITION BY source')} AS try FROM c1)",
        f"c AS (SELECT source, class, least(1.0::DOUBLE, {level.format(by='PARTITION BY source')} * g) AS lam FROM c2)",
        "u AS (SELECT d.*, s.source_size, s.target, s.whole, s.rest, coalesce(c.lam, 0.0) AS lam, (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / power(2.0::DOUBLE, 52) AS u"
        " FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source LEFT JOIN c ON c.source IS NOT DISTINCT FROM d.source AND size > 0 AND c.class = length(bin(size)))",
        "p0 AS MATERIALIZED (SELECT *, CASE WHEN lam > 0 THEN u * (1 - lam) / ((1 - u) * lam) END AS q, 0 AS extra FROM u)",
    ]
    for i in range(passes):
        steps.append(f"f{i} AS (SELECT *, rest - coalesce(sum(CASE WHEN extra = 1 THEN size END) OVER (PARTITION BY source), 0) AS room FROM p{i})")
        steps.append(f"e{i} AS (SELECT *, coalesce(q IS NOT NULL AND extra = 0 AND size > 0 AND size <= room, false) AS fits FROM f{i})")
        steps.append(f"p{i + 1} AS MATERIALIZED (SELECT * EXCLUDE (extra, room, fits), CASE WHEN fits AND sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id NULLS FIRST, size, rid) <= room THEN 1 ELSE extra END AS extra FROM e{i})")
    return f"WITH {', '.join(steps)} SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN whole + extra ELSE 0 END * size)::BIGINT AS taken FROM p{passes}"


#: Lines that are equal, or of 20 characters or more and one edit apart: they share a half.
_LINES = (
    "WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS no, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),"
    " k AS (SELECT line, min((doc_id, no)) AS first, count(*) AS n FROM l WHERE line <> '' GROUP BY line), g AS (SELECT line, length(line) AS n, string_split(line, '') AS cs FROM k WHERE length(line) >= 20),"
    " own AS (SELECT line, cs, n AS size, 0 AS part, left(line, n // 2) AS s FROM g UNION ALL SELECT line, cs, n, 1, right(line, n - n // 2) FROM g),"
    " seek AS (SELECT line, cs, n - 1 AS size, 0 AS part, left(line, (n - 1) // 2) AS s FROM g UNION ALL SELECT line, cs, n - 1, 1, right(line, n - 1 - (n - 1) // 2) FROM g),"
    " cand AS (SELECT a.line AS x, b.line AS y, a.cs AS xs, b.cs AS ys FROM own a JOIN own b USING (size, part, s) WHERE a.line < b.line UNION SELECT a.line, b.line, a.cs, b.cs FROM own a JOIN seek b USING (size, part, s)),"
    " same AS (SELECT *, coalesce(list_position(list_transform(list_zip(xs, ys), lambda p: p[1] IS DISTINCT FROM p[2]), true), len(xs) + 1) - 1 AS p FROM cand),"
    " links AS (SELECT DISTINCT x, y FROM same WHERE right(x, len(xs) - p - (CASE WHEN len(xs) = len(ys) THEN 1 ELSE 0 END)) = right(y, len(ys) - p - 1)),"
    " ends AS (SELECT x AS line, y AS other FROM links UNION ALL SELECT y, x FROM links),"
    " judged AS (SELECT e.line, count(*) AS links, bool_or(o.first < k.first) AS late FROM ends e JOIN k ON k.line = e.line JOIN k o ON o.line = e.other GROUP BY e.line),"
    " fate AS (SELECT l.doc_id, l.no, l.line, coalesce(links, 0) AS links, k.line IS NOT NULL AND (coalesce(late, false) OR (l.doc_id, l.no) <> k.first) AS gone FROM l LEFT JOIN k ON k.line = l.line LEFT JOIN judged j ON j.line = l.line)"
    " SELECT doc_id, CASE WHEN count(*) = 1 AND max(line) = '' THEN 0 ELSE count(*) END AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, sum(links)::BIGINT AS n_links,"
    " sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM fate GROUP BY doc_id"
)

#: kind: (pattern, validity of a match x), in the order of the output.
_BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max(list_transform(string_split(x, '.'), lambda y: ('0' || right(y, 18))::BIGINT)) <= 255"),
    "card": (
        r"[0-9](?:[\x20-]?[0-9])+",
        "length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 16 AND 19 AND list_sum(list_transform(string_split(reverse(regexp_replace(x, '[^0-9]', '', 'g')), ''),"
        " lambda y, i: CASE WHEN i % 2 = 1 THEN y::INT WHEN y::INT > 4 THEN y::INT * 2 - 9 ELSE y::INT * 2 END)) % 10 = 0",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 8 AND 15"),
}


def _base_spans() -> str:
    """Matches between gaps: their places are running sums of lengths."""
    parts = ["d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents)"]
    for i, (kind, (pattern, valid)) in enumerate(_BASE.items()):
        parts.append(f"m{i} AS (SELECT rid, unnest(range(1, len(h) + 1)) AS i, unnest(h) AS x, g FROM (SELECT rid, regexp_extract_all(text, '{pattern}') AS h, string_split_regex(text, '{pattern}') AS g FROM d))")
        parts.append(f"a{i} AS (SELECT rid, x, sum(length(g[i]) + length(x)) OVER (PARTITION BY rid ORDER BY i) AS stop FROM m{i})")
        parts.append(f"v{i} AS (SELECT rid, {i} AS kind, '{kind}' AS name, (stop - length(x))::BIGINT AS start, stop::BIGINT AS stop FROM a{i} WHERE {valid})")
    parts.append("v AS (" + " UNION ALL ".join(f"SELECT * FROM v{i}" for i in range(len(_BASE))) + ")")
    parts.append("t AS (SELECT rid, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY kind, start) AS line, " + ", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n_{k}" for i, k in enumerate(_BASE)) + " FROM v GROUP BY rid)")
    return f"WITH {', '.join(parts)} SELECT doc_id, " + ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _BASE) + ", sha256(coalesce(line, '')) AS base_sha256 FROM d LEFT JOIN t USING (rid)"


_RULES = (
    "WITH r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),"
    " a AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS x FROM pages),"
    f" b AS (SELECT rid, page_id, translate(regexp_extract(coalesce(x, ''), '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(x, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),"
    " f AS (SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM b, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)"
    " SELECT page_id, host, path, rule, verdict FROM b LEFT JOIN f USING (rid)"
)
_BENCH = _words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TEXT = _words(r"[^\x20\x09-\x0D]+")

ORACLES: dict[str, str] = {
    "op2_line_dedup": _LINES,
    "op7_source_mixing": _mixing(),
    "pii_base_spans": _base_spans(),
    "url_rules": _RULES,
    "op5_decontamination": (
        f"WITH d AS (SELECT doc_id, {_BENCH} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item, {_BENCH} AS w FROM benchmark),"
        " bw AS (SELECT DISTINCT item, span, array_to_string(w[i:i + span - 1], ' ') AS win FROM"
        " (SELECT item, w, least(len(w), 8) AS span, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM b WHERE len(w) > 0)),"
        " dw AS (SELECT doc_id, i, span, array_to_string(w[i:i + span - 1], ' ') AS win FROM"
        " (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM d, (SELECT DISTINCT span FROM bw) WHERE len(w) >= span)),"
        " hits AS (SELECT dw.doc_id, i, dw.span, item FROM dw JOIN bw ON bw.win = dw.win AND bw.span = dw.span),"
        " cover AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + span)) AS p FROM hits) GROUP BY doc_id),"
        " named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)"
        " SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,"
        " coalesce(n_items, 0) >= 2 AS contaminated FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)"
    ),
    "op10_near_duplicates": (
        f"WITH RECURSIVE d AS (SELECT doc_id, {_TEXT} AS w FROM documents),"
        " sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),"
        " n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),"
        " both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),"
        " links AS (SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),"
        " reach AS (SELECT doc_id AS v, doc_id AS l FROM d UNION SELECT links.b, reach.l FROM reach JOIN links ON links.a = reach.v),"
        " top AS (SELECT v, min(l) AS component_id FROM reach GROUP BY v)"
        " SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN top ON top.v = d.doc_id LEFT JOIN n USING (doc_id)"
    ),
}
