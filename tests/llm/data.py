"""Small document sets with the hard cases, shared by the tests of this folder."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, t string, b long"


def words(rng: random.Random, n: int, vocab: int = 3000) -> str:
    return " ".join(f"w{rng.randrange(vocab)}" + rng.choice(["", "", "é", "Ü"]) for _ in range(n))


def texts(seed: int = 1) -> list:
    rng = random.Random(seed)
    base = words(rng, 400)
    passage = words(rng, 80)
    out = [None, "", " ", "one", "one two three", "ONE two three", base, base, base + " tail", words(rng, 20000)]
    for i in range(12):
        near = base.split(" ")
        for _ in range(i // 2):
            near[rng.randrange(len(near))] = "changed"
        out.append(" ".join(near))
    for _ in range(8):
        out.append(words(rng, rng.randrange(5, 300)) + " " + passage + "\n" + words(rng, rng.randrange(60)))
    out += [passage] * 6 + [words(rng, rng.randrange(1, 120)) for _ in range(40)]
    out += ["a" * 500, "a" * 320, "ab" * 200, "\n\n\n", "x\ty\nz " * 40]
    return out


def frame(spark, found: list | None = None, null_row: bool = True):
    """Rows with columns whose names the operators use inside."""
    found = texts() if found is None else found
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s2", "s3"][i % 4], None if t is None else len(t), i % 5, "x", 0) for i, t in enumerate(found)]
    if null_row:
        rows.append((None, "a text without id " * 9, None, None, 1, 0, None, 1))
    return spark.createDataFrame(rows, SCHEMA)
