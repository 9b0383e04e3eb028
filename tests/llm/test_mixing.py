"""Which documents the mix takes, against a plain version of the definition."""

import hashlib
import math
import random
from collections import Counter, defaultdict

from data import words

from quillmesh.llm import mixing


def plain(rows, seed=7):
    """(doc_id, source, size) -> copies of each row, by the module's docstring."""
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, budget = set(), 1.5 * sum(sizes.values())
    while True:
        left = [s for s in order if s not in full]
        level = (budget - sum(2 * sizes[s] for s in full)) / max(sum(weight[s] for s in left), 1)
        more = {s for s in left if level * weight[s] > 2 * sizes[s]}
        if not more:
            break
        full |= more
    out = {}
    for s in order:
        mine = [(i, d, n) for i, (d, t, n) in enumerate(rows) if t == s]
        target = 2 * sizes[s] if s in full else level * weight[s]
        whole = math.floor(target / sizes[s]) if sizes[s] else 0
        rest = target - whole * sizes[s]
        mass = defaultdict(int)
        for _, _, n in mine:
            if n:
                mass[n.bit_length()] += n
        grow = {c: math.ceil(math.sqrt(2**c)) for c in mass}
        sure = set()
        while True:
            open_ = [c for c in mass if c not in sure]
            rate = (rest - sum(mass[c] for c in sure)) / max(sum(grow[c] * mass[c] for c in open_), 1)
            more = {c for c in open_ if rate * grow[c] > 1}
            if not more:
                break
            sure |= more
        ranked = []
        for i, d, n in mine:
            out[i] = whole if n else 0
            lam = (1.0 if n.bit_length() in sure else rate * grow[n.bit_length()]) if n else 0.0
            if lam > 0:
                u = (int(hashlib.md5(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                ranked.append((u * (1 - lam) / ((1 - u) * lam), d is not None, d or 0, n, i))
        ranked.sort()
        taken, chosen = 0, set()
        for _ in range(mixing.PASSES):
            left, used = rest - taken, 0
            for *_, n, i in [r for r in ranked if r[-1] not in chosen and r[-2] <= left]:
                if used + n > left:
                    break
                used += n
                chosen.add(i)
            taken += used
        for i in chosen:
            out[i] += 1
    return out, sizes


def test_chosen_documents(spark):
    rng = random.Random(6)
    found = []
    for i in range(400):
        n = rng.choice([rng.randrange(1, 20), rng.randrange(1, 200), rng.randrange(300, 2000)])
        found.append((i, rng.choice(["a", "b", "b", "b", "ä", "z", None, ""]), words(rng, n)))
    found += [(None, "b", words(rng, 30)), (None, None, None), (500, "a", ""), (501, "a", " \n "), (7, "b", words(rng, 9)), found[3], found[3]]
    df = spark.createDataFrame([(d, t, s, 1, "x", 0.5) for d, s, t in found], "doc_id long, text string, source string, size int, class string, q double")
    rows = [(d, s, len((t or "").split())) for d, s, t in found]
    copies, sizes = plain(rows)
    got = mixing.mix_to_targets(df).collect()
    assert len(got) == len(found)
    assert Counter((r["doc_id"], r["source"], r["size"], r["copies"]) for r in got) == Counter((*rows[i], c) for i, c in copies.items())
    for s, n in sizes.items():
        taken, target = sum(r["taken"] for r in got if r["source"] == s), next((r["target"] for r in got if r["source"] == s), 0)
        assert abs(taken - target) <= 0.02 * target + 20, (s, n)
