"""Repeated substrings by a common-prefix interval tree over an enhanced suffix array.

Every byte covered by a ``LENGTH``-byte string that also starts elsewhere is found,
within documents and across them. Suffixes are sampled by content: in each
window of ``LENGTH`` bytes the place with the least hash of ``GRAM`` bytes is an
anchor, so two equal windows have their anchors at the same distance. Anchors
are grouped by the hash of their gram; an anchor's context (the bytes that windows
around it can reach) decides the rest:

* contexts that are equal as a whole are counted by hash: all of both is repeated;
* one of each different context in a group goes on. Their right sides are a
  suffix array with common-prefix lengths; a stack scan gives the intervals of
  its tree, each a group of all the occurrences of a prefix. Within an interval
  the left sides are compared: where they differ the group is a maximal repeat,
  and how far each agrees with another bounds its repeat on the left;
* a group with more than ``CLASS`` different contexts is not put in one task:
  its windows are hashed (128 bits) and counted.

``spans`` gives what is covered, ``without_repeats`` what is left, and ``groups`` the
maximal repeats themselves with all their occurrences.

All three ways are exact but for hash collisions (64 bits within equal 64-bit grams,
or 128 bits).

Defined cases: a null text is empty; texts under ``LENGTH`` bytes lose nothing;
rows that repeat, or share a doc_id, are documents of their own, copies of one
another; an empty table gives an empty result; further columns are left alone;
long texts are scanned in pieces of ``PIECE`` bytes that overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import place, release, written
from tidewater.llm.rolling import Prefix

LENGTH, GRAM = 200, 48
#: Bytes left of an anchor that its windows reach.
LEFT = LENGTH - GRAM
#: Contexts of one group that a task compares: each takes about 2 kB there.
CLASS = 1 << 16
PIECE = 2 << 20
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, place, hash of the gram, hash of the context) of every anchor of ``texts``, together under 16 MB, each of LENGTH bytes at least."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    prefix = Prefix(data)
    grams = prefix.grams(GRAM)
    width = LENGTH - GRAM + 1
    least = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    # windows that cross from one text to the next don't count
    inside = np.zeros(len(data) + 1, np.int8)
    inside[begins] += 1
    inside[ends - LENGTH + 1] -= 1
    inside = np.cumsum(inside[: len(place)]).astype(bool)
    place = place[inside]
    place = np.unique(place[np.concatenate([[True], place[1:] != place[:-1]])]) if len(place) else place
    text = np.searchsorted(ends, place, side="right")
    lo, hi = np.maximum(begins[text], place - LEFT), np.minimum(ends[text], place + LENGTH)
    around = prefix.hashes(lo, hi) ^ (prefix.hashes(lo, place) >> np.uint64(1))
    return text, place - begins[text], grams[place], around


def pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Pieces of a long text such that each window and its context are whole in one."""
    step = PIECE
    for a in range(0, max(1, len(text) - LENGTH + 1), step):
        yield a, text[max(0, a - LEFT) : a + step + 2 * LENGTH]


def _anchor_rows(texts: list[bytes], rows: list[int]) -> pa.RecordBatch:
    out: list[list[np.ndarray]] = [[], [], [], []]

    def add(part: list[bytes], ids: list[int]) -> None:
        at, place, gram, around = anchors(part)
        for o, x in zip(out, (gram.view(np.int64), around.view(np.int64), np.array(ids, np.int64)[at], place), strict=True):
            o.append(x)

    part, ids, size = [], [], 0
    for t, r in zip(texts, rows, strict=True):
        if len(t) < LENGTH:
            continue
        if len(t) > PIECE:
            for a, piece in pieces(t):
                before = a - max(0, a - LEFT)
                at, place, gram, around = anchors([piece])
                # each anchor is of one piece, which has all its windows and its context
                low = 0 if a == 0 else before
                end = a + PIECE >= len(t) - LENGTH + 1
                ok = (place >= low) & (end | (place < before + PIECE))
                for o, x in zip(out, (gram[ok].view(np.int64), around[ok].view(np.int64), np.full(ok.sum(), r), place[ok] + max(0, a - LEFT)), strict=True):
                    o.append(x)
            continue
        part.append(t)
        ids.append(r)
        size += len(t)
        if size >= PIECE:
            add(part, ids)
            part, ids, size = [], [], 0
    if part:
        add(part, ids)
    cols = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["h", "c", "row", "pos"])


def _anchored(docs: DataFrame) -> DataFrame:
    """(h, c, row, pos) of every anchor."""

    def make(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                yield _anchor_rows(b["data"].to_pylist(), b["row"].to_pylist())

    return docs.where(F.length("data") >= LENGTH).mapInArrow(make, "h long, c long, row long, pos long")


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading columns are equal, by row."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    """Bytes as rows of small integers; past the end each row has a value that equals nothing."""
    out = np.empty((len(parts), width), np.int32)
    out[:] = -1 - np.arange(len(parts), dtype=np.int32)[:, None]
    for i, p in enumerate(parts):
        out[i, : len(p)] = np.frombuffer(p, np.uint8)
    return out


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the intervals of the tree of common prefixes, by a stack scan.

    ``lcp[i]`` is the common prefix of suffixes i and i + 1 in order.
    """
    stack: list[tuple[int, int]] = []
    for i, x in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > x:
            length, first = stack.pop()
            yield length, first, i
        if x >= 0 and (not stack or stack[-1][0] < x):
            stack.append((x, first))


def _enhanced(lefts: list[bytes], rights: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of the right sides, both sides' bytes in its order, and the rank of each left side read backwards."""
    order = sorted(range(len(rights)), key=rights.__getitem__)
    right = _matrix([rights[i] for i in order], LENGTH)
    left = _matrix([lefts[i][::-1] for i in order], LEFT)
    rank = np.empty(len(order), np.int64)
    rank[sorted(range(len(order)), key=lambda i: lefts[order[i]][::-1])] = np.arange(len(order))
    return order, right, left, rank


def maximal_repeats(lefts: list[bytes], rights: list[bytes], least: int) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """Groups of suffixes with a common prefix that is, with what is common on the left, a repeat of ``least`` bytes for some.

    Yields (length of the prefix, left extension of the whole group, members,
    each member's longest left agreement with another). The group is a maximal
    repeat: it ends where the prefix does, and its left extension is as far as
    the members' left sides agree.
    """
    order, right, left, rank = _enhanced(lefts, rights)
    seen: dict[tuple[int, int], bool] = {}
    for length, first, last in intervals(common(right[:-1], right[1:]).tolist()):
        if length + LEFT < least or (first, last) in seen:
            continue
        seen[first, last] = True
        m = first + np.argsort(rank[first : last + 1])
        near = common(left[m[:-1]], left[m[1:]])
        far = np.maximum(np.concatenate([[0], near]), np.concatenate([near, [0]]))
        yield length, int(near.min()), [order[x] for x in m], far.tolist()


def repeat_groups(lefts: list[bytes], rights: list[bytes], counts: list[int], least: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes left, bytes right, members) of every maximal repeat of ``least`` bytes around an anchor of its own.

    Two trees are scanned, that of the right sides and, in each of its intervals, that of
    the left ones: a group can be extended on neither side without losing a member. The
    members are all contexts that hold the string there; ``counts`` says how often each stands in the texts.
    """
    order, right, left, rank = _enhanced(lefts, rights)
    lcp = common(right[:-1], right[1:])
    whole = set()

    def own(f: int, n: int, i: int) -> bool:
        # else the string also stands where other windows have hidden this anchor
        text = lefts[i][len(lefts[i]) - f :] + rights[i][:n]
        return f in anchors([text])[1]

    for n, first, last in intervals(lcp.tolist()):
        if n + LEFT < least:
            continue
        m = first + np.argsort(rank[first : last + 1])
        for f, a, b in intervals(common(left[m[:-1]], left[m[1:]]).tolist()):
            at = m[a : b + 1]
            if n + f < least or lcp[at.min() : at.max()].min() > n:
                continue
            members = [order[x] for x in at]
            whole.update(i for i in members if f == len(lefts[i]) and n == len(rights[i]))
            if own(f, n, members[0]):
                yield f, n, members
    for i, c in enumerate(counts):
        if c > 1 and i not in whole and own(len(lefts[i]), len(rights[i]), i):
            yield len(lefts[i]), len(rights[i]), [i]


def repeated(lefts: list[bytes], rights: list[bytes], wanted: list[bool], least: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(member, bytes left, bytes right) of the repeats of the members that are ``wanted``."""
    if len(rights) == 2:
        r, s = (np.array(_matrix(x, w)) for x, w in ((rights, LENGTH), ([y[::-1] for y in lefts], LEFT)))
        n, far = int(common(r[:1], r[1:])[0]), int(common(s[:1], s[1:])[0])
        if n + far >= least:
            yield from ((i, far, n) for i in (0, 1) if wanted[i])
        return
    best: dict[int, list[tuple[int, int]]] = {}
    for n, _, members, far in maximal_repeats(lefts, rights, least):
        for i, f in zip(members, far, strict=True):
            if wanted[i] and n + f >= least:
                best.setdefault(i, []).append((f, n))
    for i, found in best.items():
        yield from ((i, f, n) for f, n in found)


def _span_batch(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["row", "start", "stop"])


def _by_trees(contexts: DataFrame) -> DataFrame:
    """(row, start, stop) from groups of contexts that fit in a task."""

    def scan(batches):
        now, group = None, []

        def done():
            if len(group) > 1:
                got = repeated([g[3] for g in group], [g[4] for g in group], [g[2] == 1 for g in group])
                return [(group[i][0], group[i][1] - f, group[i][1] + n) for i, f, n in got]
            return []

        out = []
        for batch in batches:
            for h, row, pos, n, left, right in zip(*(batch[c].to_pylist() for c in ("h", "row", "pos", "n", "left", "right")), strict=True):
                if h != now:
                    out += done()
                    now, group = h, []
                    if len(out) > 5000:
                        yield _span_batch(out)
                        out = []
                group.append((row, pos, n, left, right))
        out += done()
        if out:
            yield _span_batch(out)

    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(scan, "row long, start long, stop long")


def _anchored_there(text: bytes, place: int) -> np.ndarray:
    """For each window of ``text``: is its anchor at ``place``?"""
    grams = Prefix(np.frombuffer(text, np.uint8)).grams(GRAM)
    least = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(least, LENGTH - GRAM + 1)
    return windows.argmin(axis=1) + np.arange(len(windows)) == place


def _windows(contexts: DataFrame, own: bool = False) -> DataFrame:
    """(w1, w2, row, start, n) of every window around the anchors (``own``: of those that have it as theirs), w1 and w2 being its hash."""

    def make(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                cols = [[], [], [], [], []]
                b = batch.slice(i, 64)
                for h, row, pos, n, left, right in zip(*(b[c].to_pylist() for c in ("h", "row", "pos", "n", "left", "right")), strict=True):
                    text = left + right
                    theirs = _anchored_there(text, len(left)) if own else None
                    for at in range(max(0, len(left) - LEFT), min(len(left), len(text) - LENGTH) + 1):
                        if own and not theirs[at]:
                            continue
                        d = hashlib.blake2b(text[at : at + LENGTH], digest_size=16).digest()
                        for c, v in zip(cols, (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), row, pos - len(left) + at, n), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["w1", "w2", "row", "start", "n"])

    return written(contexts.mapInArrow(make, "w1 long, w2 long, row long, start long, n long"), "windows")


def _by_windows(contexts: DataFrame) -> DataFrame:
    """(row, start, stop) from groups of any size: every window is hashed and counted."""
    windows = _windows(contexts)
    # a window may lie around two anchors: what counts is two places
    place = F.struct("row", "start")
    twice = written(windows.groupBy("w1", "w2").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("w1", "w2"), "twice")
    return windows.where("n = 1").join(twice, ["w1", "w2"]).select("row", "start", (F.col("start") + LENGTH).alias("stop"))


def _hits(docs: DataFrame) -> DataFrame:
    """(h, c, row, pos, several) of the anchors whose gram stands at others too; ``several``: in different contexts."""
    found = _anchored(docs).groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 1")
    found = written(found.select("h", (F.col("lo") != F.col("hi")).alias("several")), "grams")
    release(docs.sparkSession)
    out = written(_anchored(docs).join(found, "h"), "hits")
    release(docs.sparkSession)
    return out


def _contexts(hits: DataFrame) -> DataFrame:
    """One anchor (row, pos) of each different context, with their number n."""
    per = hits.groupBy("h", "c", "several").agg(F.count("*").alias("n"), F.min(F.struct("row", "pos")).alias("x"))
    return written(per.select("h", "c", "several", "n", "x.row", "x.pos"), "contexts")


def _sides(docs: DataFrame, several: DataFrame) -> DataFrame:
    """``several`` (h, n, row, pos) with the bytes on both sides; ``large``: more than CLASS contexts in the group."""
    several = several.join(several.groupBy("h").agg((F.count("*") > CLASS).alias("large")), "h")
    asked = written(several.groupBy("row").agg(F.collect_list(F.struct("pos", "h", "n", "large")).alias("asked")), "asked")

    def cut(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                out, b = [], batch.slice(i, 64)
                for row, data, asked in zip(b["row"].to_pylist(), b["data"].to_pylist(), b["asked"].to_pylist(), strict=True):
                    out += [(a["h"], row, a["pos"], a["n"], a["large"], data[max(0, a["pos"] - LEFT) : a["pos"]], data[a["pos"] : a["pos"] + LENGTH]) for a in asked]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["h", "row", "pos", "n", "large", "left", "right"])

    out = written(docs.join(asked, "row").mapInArrow(cut, "h long, row long, pos long, n long, large boolean, left binary, right binary"), "sides")
    release(docs.sparkSession)
    return out


def spans(docs: DataFrame) -> DataFrame:
    """(row, start, stop) of repeats in ``docs`` (row, data): together they cover every byte that is repeated."""
    hits = _hits(docs)
    per = _contexts(hits)
    whole = hits.join(per.where("n > 1").select("h", "c"), ["h", "c"]).select("row", F.greatest(F.col("pos") - LEFT, F.lit(0)).alias("start"), (F.col("pos") + LENGTH).alias("stop"))
    contexts = _sides(docs, per.where("several").select("h", "n", "row", "pos"))
    found = whole.unionByName(_by_trees(contexts.where("not large").drop("large")))
    if not contexts.where("large").isEmpty():
        found = found.unionByName(_by_windows(contexts.where("large").drop("large")))
    return found


def groups(docs: DataFrame) -> DataFrame:
    """(group, row, start, stop): the maximal repeats of ``docs`` (row, data), each with all its occurrences.

    The strings of a group are equal, and no longer string within the reach of their
    anchor (LEFT bytes before it, LENGTH from it) stands at all of them. A gram with over CLASS
    contexts gives its repeated windows instead, of which there are as many as bytes.
    """
    hits = _hits(docs)
    per = _contexts(hits)
    sides = _sides(docs, per.where("several or n > 1").select("h", "n", "row", "pos"))

    def scan(batches):
        now, group = None, []

        def done():
            out = []
            if group:
                for k, (f, n, members) in enumerate(repeat_groups(*([g[x] for g in group] for x in (3, 4, 2)))):
                    out += [(now, k, group[i][0], group[i][1], f, n) for i in members]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["h", "k", "row", "pos", "before", "after"])

        for batch in batches:
            for h, *rest in zip(*(batch[c].to_pylist() for c in ("h", "row", "pos", "n", "left", "right")), strict=True):
                if h != now:
                    yield from done()
                    now, group = h, []
                group.append(rest)
        yield from done()

    small = sides.where("not large").drop("large").repartition("h").sortWithinPartitions("h")
    found = small.mapInArrow(scan, "h long, k long, row long, pos long, before long, after long")
    # a context stands for all anchors that have it
    named = found.join(per.select("h", "c", "row", "pos"), ["h", "row", "pos"]).select("h", "c", "k", "before", "after")
    span = lambda a, b: ((F.col("pos") - a).alias("start"), (F.col("pos") + b).alias("stop"))
    out = hits.join(named, ["h", "c"]).select(F.xxhash64("h", "k").alias("group"), "row", *span(F.col("before"), F.col("after")))
    if not sides.where("large").isEmpty():
        large = hits.join(sides.where("large").select("h").distinct(), "h").select("h", "row", "pos", F.lit(1).cast("long").alias("n"))
        w = _windows(_sides(docs, large).drop("large"), own=True).select("w1", "w2", "row", "start").distinct()
        twice = w.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w1", "w2")
        out = out.unionByName(w.join(twice, ["w1", "w2"]).select(F.xxhash64("w1", "w2").alias("group"), "row", "start", (F.col("start") + LENGTH).alias("stop")))
    return out


def merged(found: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Runs that cover the same bytes, ascending and apart, within a text of ``size`` bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        b = min(b, size)
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), place(docs).alias("row"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))


def without_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row of ``docs`` (a table): doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes as text."""
    own = _numbered(docs)
    per = spans(own.select("row", "data")).distinct().groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    per = written(per, "spans")
    release(docs.sparkSession)
    schema = RESULT + ", text string" * with_text

    def drop(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                out, b = [], batch.slice(i, 64)
                for doc, data, found in zip(b["doc_id"].to_pylist(), b["data"].to_pylist(), b["spans"].to_pylist(), strict=True):
                    runs = merged([(s["start"], s["stop"]) for s in found or []], len(data))
                    edges = [0, *(x for r in runs for x in r), len(data)]
                    kept = b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                    out.append((doc, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace")))
                kinds = [pa.int64()] * 4 + [pa.string()] * (1 + with_text)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)], [x.split()[0] for x in schema.split(", ")])

    return own.join(per, "row", "left").mapInArrow(drop, schema)
