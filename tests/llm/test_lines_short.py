"""Exact copies of short lines, as the query and the pipeline drop them."""

import hashlib

from data import frame
from test_exact import edits, rows_of

from quillmesh.llm import lines, registry


def test_short_lines(spark, tmp_path):
    a = "this is a line of some length"
    found = [f"{a}\nshort\n\n你好。", f"short\n{a}x\n你好。", "short", "\n\n", "shor", f"short\nshort\n\n{a}", None, " \nx", " "]
    flat = [(i, j, x) for i, t in enumerate(found) for j, x in enumerate((t or "").split("\n")) if x]
    near = lambda x, y: x == y or min(len(x), len(y)) >= 20 and edits(x, y) <= 1
    frame(spark, found, null_row=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(registry.op2_line_dedup(spark, str(tmp_path)))
    for i, t in enumerate(found):
        gone = {j for d, j, x in flat if d == i and any((e, k) < (i, j) and near(x, y) for e, k, y in flat)}
        rest = "\n".join(x for j, x in enumerate((t or "").split("\n")) if j not in gone)
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (len(gone), hashlib.sha256(rest.encode()).hexdigest()), t
    out = rows_of(lines.dedup_lines(frame(spark, found, null_row=False), exact_short=True))
    assert (out[1]["text"], out[2]["text"], out[3]["text"]) == ("", "", "\n\n")
