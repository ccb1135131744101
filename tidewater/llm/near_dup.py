"""Near duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles, labelled by occurrence. For
each of ``BANDS`` hash functions the sketch takes the ``TAKEN`` shingles with
the least hashes and retains their order in the text; two texts share a band
only if they share those shingles in that order, so the sketch follows edit
similarity, not the bag. Texts that share a band are candidates: a small band
gives all its pairs, in a large one all are paired with one, and where that leaves several components all pairs across them are
compared in blocks from which only links come (``links``). Candidates are verified by alignment: of the
shingles that both have, the longest chain in the order of both, within the band
of diagonals that similarity ``SIMILAR`` leaves, gives

    matches / (n1 + n2 - matches).

Links of at least ``SIMILAR`` are joined into classes by connected components.
Exact copies are one node throughout and are never paired. A pair at exactly
0.8 is missed by all bands with probability below 1e-6.

Defined cases: a null text is empty; texts without words are in one class only
if they are equal; texts under five words are one shingle; rows with equal texts
share a class, of rows with equal texts and doc_id one stays; a null doc_id sorts
last; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import components, place, release, text_key, unused, written
from tidewater.llm.rolling import mix, shingles

WORDS, SIMILAR = 5, 0.8
BANDS, TAKEN = 32, 4
#: Texts of so few shingles also get bands of one shingle each.
SHORT, SHORT_BANDS = 24, 16
#: Of the BANDS minima so many must agree for a pair to be verified (0.8 gives fewer once in a million).
AGREE = 14
#: Members of a star that are verified together.
STAR = 256
#: Buckets of so many members at most give all their pairs; larger ones have a hub, and are worked out in blocks.
FEW = 16
#: Members of a block, whose shared shingles are a matrix of 16 MB, and shingles of all its members.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 22
#: Shingles that an incidence matrix has columns for.
COLUMNS = 4096
#: Rows of a block that are searched for pairs at once, and bytes of texts that are shingled together.
STRIPE, TOGETHER = 256, 1 << 18
#: Counts by which shingles are ordered.
SLOTS = 1 << 18

_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))


def sketch(s: np.ndarray) -> tuple[list[int], bytes]:
    """(bands, minima) of a text's labelled shingles."""
    g = s[None, :] * (_SEEDS | np.uint64(1))[:, None]
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(29)
    take = min(TAKEN, len(s))
    at = np.sort(np.argpartition(g, take - 1, axis=1)[:, :take] if take < len(s) else np.broadcast_to(np.arange(take), (BANDS, take)), axis=1)
    key = np.arange(BANDS, dtype=np.uint64)
    for t in range(take):
        key = mix(key * np.uint64(0x2545F4914F6CDD1D) + s[at[:, t]])
    least = s[g.argmin(axis=1)]
    bands = key.view(np.int64).tolist()
    if len(s) <= SHORT:
        bands += mix(least[:SHORT_BANDS] + _SEEDS[:SHORT_BANDS]).view(np.int64).tolist()
    return bands, least.astype(np.uint16).tobytes()


def aligned(a: np.ndarray, b: np.ndarray, similar: float = SIMILAR) -> float:
    """Similarity of two labelled shingle sequences by alignment within a band; 0 if under ``similar``."""
    total = len(a) + len(b)
    if not total or min(len(a), len(b)) < similar * max(len(a), len(b)):
        return 0.0
    band = int(total * (1 - similar) / (1 + similar) + 1e-9)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) / (total - len(i)) < similar:
        return 0.0
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all():
        m = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        m = len(tails)
    found = m / (total - m)
    return found if found >= similar - 1e-12 else 0.0


def sketched(docs: DataFrame) -> DataFrame:
    """A row for each different text that has words: node, k1, k2, row, n, bands, minima."""

    def make(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                b = batch.slice(i, 128)
                found = shingles([x.as_py().encode() for x in b["text"]], WORDS)
                keep = [x for x, s in enumerate(found) if len(s)]
                made = [sketch(found[x]) for x in keep]
                cols = [b[c].take(pa.array(keep, pa.int32())) for c in ("k1", "k2", "row")]
                cols += [pa.array([len(found[x]) for x in keep], pa.int32()), pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["k1", "k2", "row", "n", "bands", "minima"])

    own = docs.select(*text_key(F.col("text")), place(docs).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    made = own.mapInArrow(make, "k1 long, k2 long, row long, n int, bands array<long>, minima binary")
    one = made.groupBy("k1", "k2").agg(F.min_by(F.struct("row", "n", "bands", "minima"), "row").alias("x")).select("k1", "k2", "x.*")
    return written(one.withColumn("node", F.monotonically_increasing_id()), "sketches")


def _agree(a: str, b: str) -> Column:
    """How many of two texts' minima are equal."""
    return sum((F.substring(a, 2 * k + 1, 2) == F.substring(b, 2 * k + 1, 2)).cast("int") for k in range(BANDS))


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verified links (a, b, similarity), a < b, whose components are those of all pairs that share a bucket.

    1. A bucket of up to FEW members gives all its pairs, in larger ones a hub is paired with all others.
    2. Larger buckets that hold several components then are dealt to
       blocks; a task compares all of a block and only a forest of links leaves it (``forest``).
    3. Where several blocks of a bucket still hold several components, their members meet
       by rare shingles (``_rare``), which every two texts that similar share.
    """
    spark = docs.sparkSession
    members = nodes.select("node", F.explode(F.array_distinct("bands")).alias("bucket"))
    own = nodes.select("node", "n", "minima")
    hubs = nodes.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("minima").alias("hub_minima"))
    passes = (F.least("n", "hub_n") >= SIMILAR * F.greatest("n", "hub_n")) & (_agree("minima", "hub_minima") >= AGREE)
    stars = written(members.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("c")).where("c > 1"), "stars")
    rows = written(members.join(stars, "bucket").select("bucket", "node", "hub", "c"), "members")
    if rows.isEmpty():
        return nodes.limit(0).select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("similarity"))
    needed = rows.select("node").distinct().join(nodes.select("node", "row"), "node")
    texts = written(docs.select(place(docs).alias("row"), "text").join(needed, "row").select("node", "text"), "texts")
    release(spark)
    pairs = _within(rows.where(F.col("c") <= FEW).select("bucket", "node").join(own, "node")).select(F.col("a").alias("hub"), F.col("b").alias("node"), F.lit(FEW).cast("long").alias("c"))
    many = rows.where(F.col("c") > FEW)
    fresh = many.where("hub < node").groupBy("hub", "node").agg(F.max("c").alias("c"))
    fresh = fresh.join(own, "node").join(hubs, "hub").where(passes).select("hub", "node", "c")
    # a bucket's members are verified in groups of about STAR; a node in several follows the largest
    good = pairs.unionByName(fresh).groupBy("hub", "node").agg(F.pmod(F.xxhash64("node"), F.ceil(F.max("c") / STAR)).alias("cut"))
    found = [verified(texts, written(good, "candidates"))]
    if many.isEmpty():
        return found[0]
    many = many.select("bucket", "node").join(own.select("node", "n"), "node")
    rooted, mixed = _rooted(many, found)
    dealt = rooted.join(mixed, "bucket").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")))
    found.append(_dealt(dealt.select(F.col("bucket").alias("group"), "i", F.col("i").alias("j"), F.col("i").alias("side"), "node", "root"), texts))
    release(spark)
    several = mixed.where("blocks > 1").select("bucket")
    if not several.isEmpty():
        rooted, mixed = _rooted(many.join(several, "bucket"), found)
        found.append(_rare(written(rooted.join(mixed.select("bucket"), "bucket").select("node", "root").distinct(), "rest"), texts))
    return _together(found)


def _rooted(rows: DataFrame, found: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``rows`` (bucket, node, n) with the root of each node's component so far, and ``_mixed`` of them."""
    roots = components(_together(found))
    rooted = written(rows.join(roots, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root")), "rooted")
    return rooted, _mixed(rooted, "bucket")


def _mixed(rows: DataFrame, group: str) -> DataFrame:
    """(group, c, blocks) of the groups of ``rows`` (group, node, root, n) that hold several components; of those with the same members one stays."""
    kinds = rows.groupBy(group).agg(
        F.count("*").alias("c"), F.sum("n").alias("all_"), F.min("root").alias("lo"), F.max("root").alias("hi"),
        F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64(F.lit("second"), "node")).alias("x2"),
    )
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("all_") / BLOCK_SHINGLES))
    return written(kinds.where("lo <> hi").groupBy("c", "all_", "x1", "x2").agg(F.min(group).alias(group)).select(group, "c", blocks.alias("blocks")), "mixed")


def _within(rows: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of a bucket that minima and lengths don't rule out; ``rows`` has bucket, node, n, minima."""

    def pairs(group):
        node, n = (np.array(c) for c in zip(*(g[:2] for g in group), strict=True))
        minima = np.frombuffer(b"".join(g[2] for g in group), np.uint16).reshape(len(group), BANDS)
        u, v = np.triu_indices(len(group), 1)
        ok = (np.minimum(n[u], n[v]) >= SIMILAR * np.maximum(n[u], n[v])) & ((minima[u] == minima[v]).sum(axis=1) >= AGREE)
        u, v = node[u[ok]], node[v[ok]]
        return np.minimum(u, v), np.maximum(u, v)

    def scan(batches):
        out, size = [], 0
        for _, group in _groups(batches, ("bucket",), ("node", "n", "minima")):
            if len(group) > 1:
                out.append(pairs(group))
                size += len(out[-1][0])
            if size > 4096:
                yield batch(out)
                out, size = [], 0
        if size:
            yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(scan, "a long, b long")


def _groups(batches, keys: tuple[str, ...], columns: tuple[str, ...]):
    """(key, rows) of runs of equal keys."""
    now, group = None, []
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            b = batch.slice(i, 1024)
            for key, *row in zip(zip(*(b[k].to_pylist() for k in keys), strict=True), *(b[c].to_pylist() for c in columns), strict=True):
                if key != now:
                    if group:
                        yield now, group
                    now, group = key, []
                group.append(row)
    if group:
        yield now, group


def forest(node: list[int], root: list[int], found: list[np.ndarray], side: list[int]) -> list[tuple[int, int, float]]:
    """Links (a, b, similarity) that join what belongs together in a block, or across its two sides if it has two; none within a component.

    How many shingles each two texts share is counted by products of incidence
    matrices. Pairs that share enough are verified, the most similar first, unless links
    have joined them already.
    """
    sides = np.array(side)
    first = sides == sides.min()
    x, y = (np.flatnonzero(first), np.flatnonzero(~first)) if not first.all() else (np.arange(len(node)),) * 2
    n, roots = np.array([len(s) for s in found]), np.array(root)
    values, owner = np.concatenate(found), np.repeat(np.arange(len(node), dtype=np.int32), n)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.cumsum(np.diff(values, prepend=~values[:1]) != 0, dtype=np.int32) - 1
    count = np.bincount(column)
    shared = count[column] > 1
    column, owner = (np.cumsum(count > 1) - 1)[column[shared]], owner[shared]
    del values, order, shared
    row = np.empty(len(node), np.int32)
    overlap = np.zeros((len(x), len(y)), np.float32)
    for a in range(0, int((count > 1).sum()), COLUMNS):
        i, j = np.searchsorted(column, (a, a + COLUMNS))
        parts = []
        for members in (x,) if first.all() else (x, y):
            row[:] = -1
            row[members] = np.arange(len(members))
            part = np.zeros((len(members), COLUMNS), np.float32)
            at = row[owner[i:j]]
            part[at[at >= 0], column[i:j][at >= 0] - a] = 1
            parts.append(part)
        overlap += parts[0] @ parts[-1].T
        del part, parts
    # by stripes, and in few bytes: nearly all pairs of a block may share enough
    where, scores = [], []
    for a in range(0, len(x), STRIPE):
        part = overlap[a : a + STRIPE]
        total = (n[x[a : a + STRIPE]][:, None] + n[y]).astype(np.float32)
        ok = (part * (1 + SIMILAR) >= SIMILAR * total - 1e-3) & (roots[x[a : a + STRIPE]][:, None] != roots[y])
        if first.all():
            ok &= np.arange(a, a + len(part))[:, None] < np.arange(len(node))
        at = np.flatnonzero(ok)
        where.append((at + a * len(y)).astype(np.int32))
        scores.append(-part.ravel()[at] / total.ravel()[at])
    del overlap, part
    where = np.concatenate(where)[np.argsort(np.concatenate(scores), kind="stable")]
    del scores
    top = {r: r for r in root}

    def find(r):
        while top[r] != r:
            top[r] = r = top[top[r]]
        return r

    out = []
    for a in range(0, len(where), 4096):
        u, v = np.divmod(where[a : a + 4096], len(y))
        for i, j in zip(x[u].tolist(), y[v].tolist(), strict=True):
            p, q = find(root[i]), find(root[j])
            if p != q and (s := aligned(found[i], found[j])) > 0:
                top[p] = q
                out.append((min(node[i], node[j]), max(node[i], node[j]), s))
    return out


def _shingled(texts: list[str]) -> list[np.ndarray]:
    """``shingles`` of a block's texts, some at a time, as their tables grow with the bytes taken together."""
    out: list[np.ndarray] = []
    some, size = [], 0
    for t in texts:
        some.append(t.encode())
        size += len(some[-1])
        if size > TOGETHER:
            out += shingles(some, WORDS)
            some, size = [], 0
    return out + (shingles(some, WORDS) if some else [])


def _dealt(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links from ``rows`` (group, i, j, side, node, root): each (group, i, j) is a task's block, or two blocks told apart by ``side``."""

    def scan(batches):
        for _, group in _groups(batches, ("group", "i", "j"), ("side", "node", "root", "text")):
            side, node, root, text = map(list, zip(*group, strict=True))
            if len(node) > 1 and len(set(root)) > 1 and (found := forest(node, root, _shingled(text), side)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["a", "b", "similarity"])

    whole = rows.join(texts, "node").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    return written(whole.mapInArrow(scan, "a long, b long, similarity double"), "links")


def _rare(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that join all that belongs together in ``rest`` (node, root), of any number of rows.

    Two texts of similarity SIMILAR share one of the first shingles of each, in
    any order of all shingles, if so many are taken that those after them are
    fewer than both must share. The order is by how often shingles occur: texts that have
    but common shingles in common share none of the first. How often is told by a
    table of SLOTS counts, whatever the number of texts; it only has to be the same for all.
    """
    spark = rest.sparkSession
    own = written(rest.join(texts, "node"), "rest")

    def count(batches):
        slots = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                found = shingles([x.as_py().encode() for x in batch.slice(i, 128)["text"]], WORDS)
                slots += np.bincount((np.concatenate(found) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(slots)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(slots[at])], ["slot", "n"])

    counted = own.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # SLOTS rows at most
    table = np.zeros(SLOTS, np.int64)
    table[counted["slot"]] = counted["n"]
    often = spark.sparkContext.broadcast(table)

    def keys(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                b = batch.slice(i, 128)
                parts = []
                for s in shingles([x.as_py().encode() for x in b["text"]], WORDS):
                    first = len(s) - int(np.ceil(SIMILAR * len(s) - 1e-9)) + 1
                    parts.append(s[np.lexsort((s, often.value[(s % np.uint64(SLOTS)).astype(np.int64)]))[:first]].view(np.int64))
                at = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                cols = [pa.array(np.concatenate(parts)), *(b[c].take(pa.array(at)) for c in ("node", "root"))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.array([len(p) for p in parts])[at])], ["group", "node", "root", "n"])

    rows = written(own.mapInArrow(keys, "group long, node long, root long, n long"), "keys")
    kinds = _mixed(rows.withColumn("n", F.col("n") / (1 - SIMILAR)), "group")
    rows = written(rows.join(kinds, "group"), "rare")
    # of a group of several blocks the largest component need not be compared with itself
    per = rows.where("blocks > 1").groupBy("group", "root").agg(F.count("*").alias("k"))
    per = per.groupBy("group").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.max("k").alias("mains"))
    rows = rows.join(written(per, "mains"), "group", "left").withColumn("within", F.col("root").eqNullSafe(F.col("main")))
    share = F.col("blocks") / F.col("c")
    n_own = F.when(F.col("blocks") == 1, 1).otherwise(F.greatest(F.ceil((F.col("c") - F.col("mains")) * share), F.lit(1))).cast("long")
    n_main = F.when(F.col("blocks") == 1, 0).otherwise(F.ceil(F.col("mains") * share)).cast("long")
    rows = rows.withColumns({"o": n_own, "m": n_main}).withColumn("side", F.when(F.col("within"), F.col("o") + F.pmod(F.xxhash64("node"), F.greatest("m", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.col("o"))))
    others = F.when(F.col("within"), F.sequence(F.lit(0).cast("long"), F.col("o") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("o") + F.col("m") - 1))
    rows = rows.select("group", "side", "node", "root", F.explode(others).alias("other"))
    return _dealt(rows.select("group", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "root"), texts)


def _together(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The links (a, b, similarity), a < b, among ``pairs`` (hub, node, cut); the nodes of a hub's cut go to one task, with the hub's text."""
    others = pairs.join(texts, "node").select("hub", "cut", "node", "text")
    centres = pairs.select("hub", "cut").distinct().join(texts.withColumnRenamed("node", "hub"), "hub").select("hub", "cut", F.lit(None).cast("long").alias("node"), "text")
    rows = centres.unionByName(others).repartition("hub", "cut").sortWithinPartitions("hub", "cut", "node")

    def verify(batches):
        hub, centre = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                b, out = batch.slice(i, 128), []
                found = shingles([x.as_py().encode() for x in b["text"]], WORDS)
                for h, node, s in zip(b["hub"].to_pylist(), b["node"].to_pylist(), found, strict=True):
                    if node is None:
                        hub, centre = h, s
                    elif h != hub:
                        raise ValueError("a star without its centre")
                    elif (x := aligned(centre, s)) > 0:
                        out.append((min(h, node), max(h, node), x))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["a", "b", "similarity"])

    return written(rows.mapInArrow(verify, "a long, b long, similarity double"), "links")


def classes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (a table): row, doc_id, class_id, class_size, kept."""
    nodes = sketched(docs)
    release(docs.sparkSession)
    roots = components(links(docs, nodes))
    own = written(docs.select(*text_key(F.col("text")), "doc_id", place(docs).alias("row")), "rows")
    named = written(nodes.join(roots, "node").select("k1", "k2", F.col("root").alias("root")), "named")
    # a text without links is a class by its own key
    own = own.join(named, ["k1", "k2"], "left").withColumn("class", F.when(F.col("root").isNotNull(), F.struct(F.col("root").alias("k1"), F.lit(None).cast("long").alias("k2"))).otherwise(F.struct("k1", "k2")))
    own = written(own.select("row", "doc_id", "class.k1", "class.k2"), "classed")
    first = own.groupBy("k1", "k2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")).alias("m"), F.count("*").alias("class_size"))
    first = written(first.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("m.doc_id").alias("class_id"), F.col("m.row").alias("first_row"), "class_size"), "first")
    out = own.join(first, (F.col("k1") == F.col("c1")) & F.col("k2").eqNullSafe(F.col("c2")))
    return out.select("row", "doc_id", "class_id", "class_size", (F.col("row") == F.col("first_row")).alias("kept"))


def near_dup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, class_id (the least doc_id of its class), class_size, kept."""
    return classes(docs).drop("row")


def stage(docs: DataFrame) -> DataFrame:
    """One row of each class, with the columns of ``docs`` (a table)."""
    row = unused(docs, "row")
    drop = written(classes(docs).where("not kept").select(F.col("row").alias(row)), "dropped")
    return docs.withColumn(row, place(docs)).join(drop, row, "left_anti").select(docs.columns)
