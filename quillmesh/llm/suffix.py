"""Suffix dedup: bytes covered by a SPAN-byte string that also starts earlier are removed.

A common-prefix-aware distributed merge sort of sampled suffixes. Of the hashes of
GRAM-byte strings, the leftmost minimum of every SPAN - GRAM + 1 consecutive ones is an
anchor, so each SPAN-byte string has exactly one, at a place that depends on its content
only: equal strings have equal anchors at equal places, and only suffixes that start at
anchors (one byte in 35) need sorting. A suffix is cut where the last string of its anchor
ends; what the strings have to the left of the anchor follows it, read backwards.

1. Every task sorts its suffixes as bytes and settles local copies. The sorted run is
   front-coded (length of the prefix common with the suffix before, then the rest) and
   exchanged by the hash of the GRAM bytes, so that suffixes that share them meet.
2. Runs are combined by a loser tree whose players carry the length of the prefix they share
   with the last winner: the longer one wins unseen, only equal lengths are compared, from
   there on. No known prefix is compared again. With more than FAN runs, FAN at a time become
   longer front-coded runs first.
3. The tree hands out every suffix with the prefix it shares with the one before. Suffixes
   that are wholly equal are copies: all strings of the later ones go. Among the others with
   one anchor the shared right part is a running minimum of these lengths; only the left
   parts are compared. Anchors with more than GROUP neighbourhoods are split instead into
   blocks of strings and at last single strings, which are counted by a 128-bit hash with
   partial aggregation: no group meets in one task.
4. Ranges are united per document and the rest is hashed.

Scale: the number of parts follows from the bytes of text (PART bytes each), so that a task's
share does not grow with the corpus; runs are decoded BLOCK suffixes at a time. The exchange
moves the bytes that a suffix does not share with its neighbour, before compression up to
about four times the text and far less where texts repeat. Only texts with removals are
joined to their ranges (ids are broadcast up to MAX_BROADCAST_IDS).

Defined cases: null is empty; texts under SPAN bytes lose nothing and name no copy; equal
(doc_id, text, start) are not earlier than each other, so repeated rows keep their bytes and
get equal results; a doc_id with several texts is judged text by text, in the order of their
hashes; a null doc_id comes first; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, release, text_of
from .shingles import _powers, chunks, mix

SPAN, GRAM = 100, 32
WINDOW = SPAN - GRAM + 1
LEFT = WINDOW - 1
WIDTH = SPAN + LEFT
GROUP = 64
#: Starts in a block of strings, from the first cut of large groups to the last.
SIZES = (16, 4, 1)
#: Suffixes that a task sorts at once, bytes of text that it hashes at once, rows that it hands on at once.
FLUSH, BYTES, ROWS = 1 << 17, 1 << 20, 20_000
#: Text whose suffixes make a part, runs that are merged at once, suffixes that are decoded at once.
PART, FAN, BLOCK = 24 << 20, 256, 512
MAX_BROADCAST_IDS = 2_000_000
NO_ID = -(1 << 63)
FIELDS = {"doc": np.int64, "t": np.int64, "pos": np.int64, "lo": np.uint8, "hi": np.uint8, "mark": np.uint8}
#: What becomes of an entry: it is sorted, it is sorted and its anchor is split, all its strings go, it is split away.
SORTED, MARKED, SETTLED, AWAY = 0, 1, 2, 3


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, document index, position in the data, and distances to the first and last string start."""
    n = len(data) - SPAN + 1
    none = np.zeros(0, np.int64)
    empty = (none.astype(np.uint64), none, none, none, none)
    if n <= 0:
        return empty
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    grams = len(data) - GRAM + 1
    value = mix((total[GRAM:] - total[:-GRAM]) * inverse[:grams])
    hashes, place = value, np.arange(grams, dtype=np.int32)
    step = 1
    while step <= 32:
        later = value[step:] < value[:-step]
        value, place = np.where(later, value[step:], value[:-step]), np.where(later, place[step:], place[:-step])
        step *= 2
    rest = WINDOW - 64
    place = np.where(value[rest:] < value[:-rest], place[rest:], place[:-rest])
    # strings that end in another document are none
    valid = np.ones(n, bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        valid[max(a, b - SPAN + 1) : b] = False
    starts = np.flatnonzero(valid)
    if not len(starts):
        return empty
    chosen = place[starts]
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(starts)]]) - 1
    first_start, last_start, at = starts[new], starts[last], chosen[new].astype(np.int64)
    doc = np.searchsorted(offsets, first_start, "right") - 1
    return hashes[at], doc, at, at - first_start, at - last_start


_RIGHT, _BACK = np.arange(SPAN), np.arange(1, LEFT + 1)


def used(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which places of its fixed-width key an entry fills."""
    return np.concatenate([_RIGHT < SPAN - hi[:, None].astype(np.int64), _BACK <= lo[:, None]], 1)


def keys_of(data: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The suffix from the anchor on and the bytes before it backwards; places that are not used are 0."""
    padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(SPAN, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[at]
    return np.concatenate([around[:, LEFT:], around[:, :LEFT][:, ::-1]], 1) * used(lo, hi)


def common(keys: np.ndarray) -> np.ndarray:
    """Length of the prefix that each key shares with the one before."""
    out = np.zeros(len(keys), np.uint8)
    if len(keys) > 1:
        other = keys[1:] != keys[:-1]
        at = other.argmax(1)
        out[1:] = np.where(other[np.arange(len(at)), at], at, WIDTH)
    return out


class Run:
    """Sorted, front-coded suffixes: fields as arrays, keys as compressed blocks."""

    def __init__(self, fields: dict[str, np.ndarray], lcp: np.ndarray, blocks: list[bytes]):
        self.fields, self.lcp, self.blocks = fields, lcp, blocks

    def __len__(self) -> int:
        return len(self.lcp)

    @staticmethod
    def coded(fields: dict[str, np.ndarray], lcp: np.ndarray, keys: np.ndarray) -> Run:
        blocks = []
        filled = used(fields["lo"], fields["hi"])
        for a in range(0, len(lcp), BLOCK):
            rest = filled[a : a + BLOCK] & (np.arange(WIDTH) >= lcp[a : a + BLOCK, None])
            rest[0] = filled[a]  # a block can be decoded alone
            tail = keys[a : a + BLOCK][rest].tobytes()
            blocks.append(struct.pack("<I", len(tail)) + pa.compress(tail, "zstd", asbytes=True))
        return Run(fields, lcp, blocks)

    def keys(self, block: int) -> list[bytes]:
        """Keys of a block: each byte comes from the last entry at or before whose rest holds it."""
        at = slice(block * BLOCK, (block + 1) * BLOCK)
        lcp = self.lcp[at].astype(np.int64)
        filled = used(self.fields["lo"][at], self.fields["hi"][at])
        own = np.arange(WIDTH) >= lcp[:, None]
        own[0] = True
        blob = self.blocks[block]
        out = np.zeros(own.shape, np.uint8)
        out[own & filled] = np.frombuffer(pa.decompress(blob[4:], struct.unpack("<I", blob[:4])[0], "zstd", asbytes=True), np.uint8)
        source = np.maximum.accumulate(np.where(own, np.arange(len(lcp), dtype=np.int32)[:, None], 0), axis=0)
        raw = out[source, np.arange(WIDTH)].tobytes()
        return [raw[i : i + WIDTH] for i in range(0, len(raw), WIDTH)]

    def pack(self) -> bytes:
        docs, index = np.unique(np.stack([self.fields["doc"], self.fields["t"]], 1), axis=0, return_inverse=True)
        small = [index.reshape(-1).astype(np.uint32), self.fields["pos"], self.lcp, self.fields["lo"], self.fields["hi"], self.fields["mark"]]
        body = np.ascontiguousarray(docs).tobytes() + b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in small)
        parts = [pa.compress(body, "zstd", asbytes=True), *self.blocks]
        return struct.pack(f"<IIII{len(parts)}I", len(self), len(docs), len(body), len(parts), *map(len, parts)) + b"".join(parts)

    @staticmethod
    def unpack(blob: bytes) -> Run:
        n, d, size, m = struct.unpack("<IIII", blob[:16])
        sizes, at, parts = struct.unpack(f"<{m}I", blob[16 : 16 + 4 * m]), 16 + 4 * m, []
        for k in sizes:
            parts.append(blob[at : at + k])
            at += k
        body, at, out = pa.decompress(parts[0], size, "zstd", asbytes=True), 16 * d, []
        docs = np.frombuffer(body, np.int64, 2 * d).reshape(d, 2)
        for kind in (np.uint32, np.int64, np.uint8, np.uint8, np.uint8, np.uint8):
            width = np.dtype(kind).itemsize
            raw = np.frombuffer(body, np.uint8, n * width, at).reshape(width, n)
            out.append(np.ascontiguousarray(raw.T).view(kind).reshape(n))
            at += n * width
        names = docs[out[0]]
        return Run({"doc": names[:, 0], "t": names[:, 1], "pos": out[1], "lo": out[3], "hi": out[4], "mark": out[5]}, out[2], parts[1:])


def tournament(runs: list[Run]) -> Iterator[tuple[list[int], list[int], list[int], list[bytes]]]:
    """(run, place in it, prefix common with the one before, key) in sorted order, some thousand at a time."""
    k = len(runs)
    size = 1 << max(0, k - 1).bit_length()
    lcps = [r.lcp.tolist() for r in runs]
    blocks = [r.keys(0) if len(r) else [] for r in runs]
    key = [b[0] if b else None for b in blocks] + [None] * (size - k)
    shared = [0 if x is not None else -1 for x in key]
    place = [0] * size
    tree = [0] * size

    def differ(a: bytes, b: bytes, at: int) -> int:
        while at < WIDTH:
            x, y = a[at : at + 8], b[at : at + 8]
            if x != y:
                return at + len(x) - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8
            at += 8
        return WIDTH

    def first(node: int) -> int:
        if node >= size:
            return node - size
        a, b = first(2 * node), first(2 * node + 1)
        if shared[a] < 0 or shared[b] < 0:
            win, lose = (b, a) if shared[a] < 0 else (a, b)
        else:
            at = differ(key[a], key[b], 0)
            win, lose = (a, b) if key[a] <= key[b] else (b, a)
            shared[lose] = at
        tree[node] = lose
        return win

    w = first(1) if size > 1 else 0
    who: list[int] = []
    where: list[int] = []
    prefix: list[int] = []
    out: list[bytes] = []
    while shared[w] >= 0:
        i = place[w]
        who.append(w)
        where.append(i)
        prefix.append(shared[w])
        out.append(key[w])
        i += 1
        place[w] = i
        if i < len(lcps[w]):
            if not i % BLOCK:
                blocks[w] = runs[w].keys(i // BLOCK)
            mine, h = blocks[w][i % BLOCK], lcps[w][i]
        else:
            mine, h = None, -1
            blocks[w] = []
        key[w], shared[w] = mine, h
        node = (w + size) >> 1
        while node:
            o = tree[node]
            theirs = shared[o]
            if theirs > h:
                # the other shares more with the last winner, so it is smaller
                tree[node], shared[w] = w, h
                w, h, mine = o, theirs, key[o]
            elif theirs == h and h >= 0:
                other = key[o]
                at = differ(mine, other, h)
                if mine <= other:
                    shared[o] = at
                else:
                    tree[node], shared[w] = w, at
                    w, mine = o, other
            node >>= 1
        shared[w] = h
        if len(out) >= 16384 and h < GRAM:
            yield who, where, prefix, out
            who, where, prefix, out = [], [], [], []
    if out:
        yield who, where, prefix, out


def merged(runs: list[Run]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """(fields, common prefixes, keys) of all entries in sorted order; no anchor is parted."""
    while len(runs) > FAN:
        runs = [_longer(runs[i : i + FAN]) for i in range(0, len(runs), FAN)]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)
    everything = {f: np.concatenate([r.fields[f] for r in runs]) for f in FIELDS}
    for who, where, prefix, keys in tournament(runs):
        at = offsets[np.array(who, np.int64)] + np.array(where, np.int64)
        yield {f: v[at] for f, v in everything.items()}, np.array(prefix, np.uint8), np.frombuffer(b"".join(keys), np.uint8).reshape(-1, WIDTH)


def _longer(runs: list[Run]) -> Run:
    """One run of several."""
    fields, lcps, blocks, held = [], [], [], []
    waiting = 0

    def code(all_: bool) -> int:
        some = {f: np.concatenate([h[0][f] for h in held]) for f in FIELDS}
        lcp, keys = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        cut = len(lcp) if all_ else len(lcp) // BLOCK * BLOCK
        done = Run.coded({f: v[:cut] for f, v in some.items()}, lcp[:cut], keys[:cut])
        fields.append(done.fields)
        lcps.append(done.lcp)
        blocks.extend(done.blocks)
        held[:] = [({f: v[cut:] for f, v in some.items()}, lcp[cut:], keys[cut:])]
        return len(lcp) - cut

    for part in merged(runs):
        held.append(part)
        waiting += len(part[1])
        if waiting >= BLOCK:
            waiting = code(False)
    if waiting:
        code(True)
    return Run({f: np.concatenate([x[f] for x in fields]) for f in FIELDS}, np.concatenate(lcps), blocks)


def _classes(fields: dict[str, np.ndarray], lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order: heads of equal neighbourhoods, whether one is a later copy, the first of each class, start of anchors."""
    n = len(lcp)
    head = np.ones(n, bool)
    head[1:] = (lcp[1:] < WIDTH) | (fields["lo"][1:] != fields["lo"][:-1]) | (fields["hi"][1:] != fields["hi"][:-1])
    number = np.cumsum(head) - 1
    order = np.lexsort((fields["pos"], fields["t"], fields["doc"], number))
    first = order[np.flatnonzero(head)][number]
    later = (fields["doc"] != fields["doc"][first]) | (fields["t"] != fields["t"][first]) | (fields["pos"] != fields["pos"][first])
    anchor = np.ones(n, bool)
    anchor[1:] = lcp[1:] < GRAM
    return head, later, first, anchor


def _per_anchor(values: np.ndarray, anchor: np.ndarray, how: np.ufunc) -> np.ndarray:
    new = np.flatnonzero(anchor)
    return np.repeat(how.reduceat(values, new), np.diff(np.concatenate([new, [len(anchor)]])))


def _runs(parts: int):
    def flush(found: list) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        h, keys = columns[0], columns[1]
        order = np.argsort(keys.view(f"S{WIDTH}").reshape(-1), kind="stable")
        keys, h = keys[order], h[order]
        fields = {f: columns[i + 2].astype(kind)[order] for i, (f, kind) in enumerate(list(FIELDS.items())[:5])}
        lcp = common(keys)
        head, later, first, anchor = _classes(fields, lcp)
        heavy = _per_anchor(head.astype(np.int64), anchor, np.add) > GROUP
        # of a class the first stays, at its place in the order
        stays = np.zeros(len(h), bool)
        stays[first] = True
        fields["mark"] = np.where(~stays, np.where(later, SETTLED, SORTED), np.where(heavy, np.where(anchor[np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))], MARKED, AWAY), SORTED)).astype(np.uint8)
        n = len(h)
        spread = np.where(fields["mark"] >= SETTLED, np.arange(n) * parts // max(n, 1), ((mix(h) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64))  # minima are small numbers
        order = np.argsort(spread, kind="stable")
        bounds = np.searchsorted(spread[order], np.arange(parts + 1))
        ranges = [r for r in range(parts) if bounds[r] < bounds[r + 1]]
        for at in range(0, len(ranges), 16):
            some, blobs = ranges[at : at + 16], []
            for r in some:
                own = order[bounds[r] : bounds[r + 1]]
                kinds = fields["mark"][own]
                packed = []
                for sel in (own[kinds < SETTLED], own[kinds >= SETTLED]):
                    part = {f: v[sel] for f, v in fields.items()}
                    # settled copies need no key any more
                    coded = np.where((part["mark"] == SETTLED)[:, None], np.uint8(0), keys[sel])
                    packed.append(Run.coded(part, common(coded), coded).pack() if len(sel) else b"")
                blobs.append(struct.pack("<I", len(packed[0])) + b"".join(packed))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, count = [], 0
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_numpy(zero_copy_only=False)
            for first, data, offsets in chunks(batch.column(2), BYTES):
                h, doc, at, lo, hi = anchors(data, offsets)
                for a in range(0, len(h), FLUSH):
                    s = slice(a, a + FLUSH)
                    found.append((h[s], keys_of(data, at[s], lo[s], hi[s]), ids[first + doc[s]], texts[first + doc[s]], at[s] - offsets[doc[s]], lo[s], hi[s]))
                    count += len(h[s])
                    if count >= FLUSH:
                        yield from flush(found)
                        found, count = [], 0
        if count:
            yield from flush(found)
        del found
        release()

    return run


MERGED = "kind int, doc_id long, t long, a long, b long, lo int, hi int, ctx binary"
MERGED_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _gone(doc: np.ndarray, t: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ranges to remove; those of one text that touch are united."""
    if not len(doc):
        return
    order = np.lexsort((a, t, doc))
    doc, t, a, b = doc[order], t[order], a[order], b[order]
    other = np.ones(len(doc), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (t[1:] != t[:-1])
    number = np.cumsum(other)
    # ends so far within a text: numbers of texts stand above all positions
    reach = np.maximum.accumulate(b + (number << 44)) - (number << 44)
    new = other.copy()
    new[1:] |= a[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(a)]]) - 1
    doc, t, a, b = doc[at], t[at], a[at], reach[last]
    for i in range(0, len(at), ROWS):
        s = slice(i, i + ROWS)
        n = len(doc[s])
        zero = pa.array(np.zeros(n, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.array(doc[s]), pa.array(t[s]), pa.array(a[s]), pa.array(b[s]), zero, zero, pa.nulls(n, pa.binary())], names=["kind", "doc_id", "t", "a", "b", "lo", "hi", "ctx"])


def _blocks(lo: int, hi: int, size: int) -> Iterator[tuple[int, int]]:
    """Parts (most, least) of the distances hi .. lo from string starts to their anchor, cut at multiples of size."""
    while hi <= lo:
        most = min(lo, hi // size * size + size - 1)
        yield most, hi
        hi = most + 1


def _to_split(fields: dict[str, np.ndarray], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of strings of entries whose anchor has too many neighbourhoods."""
    rows = []
    for doc, t, pos, lo, hi, key in zip(*[fields[f].tolist() for f in ("doc", "t", "pos", "lo", "hi")], keys, strict=True):
        raw = key[SPAN : SPAN + lo][::-1].tobytes() + key[: SPAN - hi].tobytes()
        for most, least in _blocks(lo, hi, SIZES[0]):
            rows.append((2, doc, t, pos, 0, most, least, raw[lo - most : lo - least + SPAN]))
        if len(rows) >= ROWS:
            yield _rows(rows)
            rows = []
    if rows:
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), MERGED_TYPES, strict=True)], names=["kind", "doc_id", "t", "a", "b", "lo", "hi", "ctx"])


def near(fields: dict[str, np.ndarray], lcp: np.ndarray, keys: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, t, a, b) of strings that match an earlier entry of the same anchor; one entry a neighbourhood, in sorted order."""
    n = len(lcp)
    none = np.zeros(0, np.int64)
    group = np.cumsum(anchor)
    right, out = np.full(n, WIDTH, np.int64), []
    lo, hi = fields["lo"].astype(np.int64), fields["hi"].astype(np.int64)
    for step in range(1, n):
        i = np.flatnonzero(group[step:] == group[:-step])
        if not len(i):
            break
        # what i and i + step share is the least of the prefixes between them
        right[i] = np.minimum(right[i], lcp[i + step])
        for c in range(0, len(i), 8192):
            x, y = i[c : c + 8192], i[c : c + 8192] + step
            other = keys[x, SPAN:] != keys[y, SPAN:]
            left = np.where(other.any(1), other.argmax(1), LEFT)
            most = np.minimum(left, np.minimum(lo[x], lo[y]))
            least = SPAN - np.minimum(right[x], SPAN - np.maximum(hi[x], hi[y]))
            before, tied = np.zeros(len(x), bool), np.ones(len(x), bool)
            for f in ("doc", "t", "pos"):
                before |= tied & (fields[f][x] < fields[f][y])
                tied &= fields[f][x] == fields[f][y]
            late, ok = np.where(before, y, x), least <= most
            late, most, least = late[ok], most[ok], least[ok]
            pos = fields["pos"][late]
            out.append((fields["doc"][late], fields["t"][late], pos - most, pos - least + SPAN))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (none,) * 4


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 1: a range to remove; 2: a block of strings of an anchor that is split."""
    runs = []
    for batch in batches:
        for blob in batch.column(0):
            blob = blob.as_py()
            size = struct.unpack("<I", blob[:4])[0]
            if size:
                runs.append(Run.unpack(blob[4 : 4 + size]))
            if len(blob) > 4 + size:
                yield from _settle(Run.unpack(blob[4 + size :]))
    for fields, lcp, keys in merged(runs) if runs else ():
        head, later, first, anchor = _classes(fields, lcp)
        split = (_per_anchor(head.astype(np.int64), anchor, np.add) > GROUP) | (_per_anchor(fields["mark"], anchor, np.maximum) == MARKED)
        pos = fields["pos"]
        spans = [(fields["doc"][later], fields["t"][later], (pos - fields["lo"])[later], (pos - fields["hi"].astype(np.int64) + SPAN)[later])]
        heads = np.flatnonzero(head)
        # the first of each class stands for it; prefixes and anchors are those of the head
        one = first[heads]
        away = split[heads]
        if away.any():
            yield from _to_split({f: v[one[away]] for f, v in fields.items()}, keys[heads[away]])
        stay = ~away
        if stay.any():
            spans.append(near({f: v[one[stay]] for f, v in fields.items()}, lcp[heads[stay]].astype(np.int64), keys[heads[stay]], anchor[heads[stay]]))
        yield from _gone(*[np.concatenate(c).astype(np.int64) for c in zip(*spans, strict=True)])
    del runs
    release()


def _settle(rest: Run) -> Iterator[pa.RecordBatch]:
    """Settled copies lose all their strings; entries that were split away become blocks of strings."""
    fields, pos = rest.fields, rest.fields["pos"]
    gone = fields["mark"] == SETTLED
    yield from _gone(fields["doc"][gone], fields["t"][gone], (pos - fields["lo"])[gone], (pos - fields["hi"].astype(np.int64) + SPAN)[gone])
    for block in range(len(rest.blocks) if not gone.all() else 0):
        at = slice(block * BLOCK, (block + 1) * BLOCK)
        away = ~gone[at]
        if away.any():
            keys = np.frombuffer(b"".join(rest.keys(block)), np.uint8).reshape(-1, WIDTH)
            yield from _to_split({f: v[at][away] for f, v in fields.items()}, keys[away])


PARTS = "doc_id long, t long, pos long, lo int, hi int, ctx binary, b1 long, b2 long, c1 long, c2 long"


def _parts(size: int):
    """Blocks cut to a size, with 128-bit hashes of the block and of what all strings of the whole, uncut block share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda most, least, x: struct.unpack("<qq", hashlib.blake2b(bytes((most, least)) + x, digest_size=16).digest())
        kinds, names = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 4], ["doc_id", "t", "pos", "lo", "hi", "ctx", "b1", "b2", "c1", "c2"]
        for batch in batches:
            rows = []
            for doc_id, t, pos, lo, hi, ctx in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for most, least in _blocks(lo, hi, size):
                    own, from_ = ctx[lo - most : lo - least + SPAN], least // size * size
                    rows.append((doc_id, t, pos, most, least, own, *digest(most, least, own), *digest(from_, from_ + size, own[most - from_ : most - from_ - size + 1 + SPAN])))
            for at in range(0, len(rows), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + ROWS], strict=True), kinds, strict=True)], names=names)

    return run


def _split(blocks: DataFrame) -> DataFrame:
    """(doc_id, t, a, b) of strings that start earlier elsewhere, from blocks of strings around common anchors.

    A block that occurred earlier loses all its strings; one whose common bytes occur once
    loses none; what is left is cut into smaller blocks, down to single strings.
    """
    found = None
    for size in SIZES:
        rows = materialize(blocks.select("doc_id", "t", "pos", "lo", "hi", "ctx").mapInArrow(_parts(size), PARTS))
        first = rows.groupBy("b1", "b2").agg(F.min(F.struct("doc_id", "t", "pos")).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
        later = F.struct("doc_id", "t", "pos") > F.col("first")
        if size == 1:
            gone = rows.select("doc_id", "t", "pos", "lo", "hi", "b1", "b2").join(first, ["b1", "b2"]).where(later)
        else:
            shared = rows.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
            judged = rows.join(shared, ["c1", "c2"], "left_semi").join(first, ["b1", "b2"], "left")
            judged = materialize(judged.select("doc_id", "t", "pos", "lo", "hi", "ctx", F.coalesce(later, F.lit(False)).alias("later")))
            gone, blocks = judged.where("later"), judged.where("not later")
        gone = gone.select("doc_id", "t", (F.col("pos") - F.col("lo")).alias("a"), (F.col("pos") - F.col("hi") + SPAN).alias("b"))
        found = gone if found is None else found.unionByName(gone)
    return found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, ranges in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            spans: list[list[int]] = []
            for r in sorted((r["a"], min(r["b"], len(raw))) for r in ranges):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                elif r[0] < r[1]:
                    spans.append(list(r))
            digest, at = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            rows.append((None if doc_id == NO_ID else doc_id, len(raw), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), [{"a": a, "b": b} for a, b in spans]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _only(raw: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    few = ids.count() <= MAX_BROADCAST_IDS
    return raw.join(F.broadcast(ids) if few else ids, ["doc_id", "t"], how)


def removed_ranges(raw: DataFrame) -> DataFrame:
    """(doc_id, t, ranges: array of struct(a, b)) from (doc_id, t: hash of the text, raw bytes)."""
    size = raw.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    parts = max(int(raw.sparkSession.sparkContext.defaultParallelism), -(-size // PART))
    runs = raw.select("doc_id", "t", "raw").mapInArrow(_runs(parts), "part int, run binary").repartitionById(parts, "part").select("run")
    found = materialize(runs.mapInArrow(_merge, MERGED))
    whole = found.where("kind = 1").select("doc_id", "t", "a", "b")
    blocks = found.where("kind = 2").select("doc_id", "t", F.col("a").alias("pos"), "lo", "hi", "ctx")
    ranges = whole.unionByName(_split(blocks)) if blocks.take(1) else whole
    return materialize(ranges.groupBy("doc_id", "t").agg(F.collect_list(F.struct("a", "b")).alias("ranges")))


def suffix_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of byte ranges removed)."""
    text = text_of(docs)
    raw = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("t"), text.cast("binary").alias("raw"))
    ranges = removed_ranges(raw)
    ids = ranges.select("doc_id", "t")
    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:bigint,b:bigint>>"
    cut = _only(raw, ids, "left_semi").join(ranges, ["doc_id", "t"]).select("doc_id", "raw", "ranges").mapInArrow(_cut, shape)
    same = _only(raw, ids, "left_anti").select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), F.octet_length("raw").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2("raw", 256).alias("kept_sha256"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("spans"),
    )
    return same.unionByName(cut)
