"""Mixing sources to target weights by subset-sum budget fitting.

Each source's budget is first met by whole passes over the source. What is left
is met by a subset of its documents: they are counted by exact length, an equal
share of every length is taken, and a bounded-knapsack dynamic program over the
remaining counts meets the rest as closely as they allow. Which documents of a
length are taken is decided by a seeded hash.

Defined cases: a null text has size 0 and is never taken; a null source is a
source of its own, last; rows that repeat are documents of their own; an empty
table gives an empty result; further columns are left alone. Rows for a tie in
the hash are told apart by their place in the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import place, unused, written
from tidewater.llm.quality import words_of

WEIGHTS, SHARE, MAX_PASSES, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 20240
#: The dynamic program fits at most so many words; whole shares of every length meet the rest.
DP_WORDS = 1 << 16
#: Documents of one source and length are ranked in blocks of about so many.
BLOCK = 4096


def planned(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: float = MAX_PASSES) -> DataFrame:
    """``totals`` (source, source_size) with target, whole (passes over all of the source) and rest (words beyond those).

    ``share`` of all sizes is dealt by weight, the weights going round the sources in
    order; a source gets at most ``passes`` times its size, and its excess is dealt again
    until none is above. Sources are placed, weighed and summed in Spark: a round
    raises the level (words for each unit of weight) by what full sources leave.
    """
    placed = written(totals.orderBy(*_order(F.col("source"))).withColumn("i_", F.monotonically_increasing_id()), "sources")
    part, at = F.shiftright("i_", 33), F.col("i_").bitwiseAND((1 << 33) - 1)
    per = placed.groupBy(part.alias("p_")).agg(F.count("*").alias("c_"))  # a row a partition
    before = F.coalesce(F.sum("c_").over(Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.col("before_") + at
    weighed = placed.withColumn("p_", part).join(per.select("p_", before.alias("before_")), "p_")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    weighed = written(weighed.select("source", "source_size", F.when(F.col("source_size") > 0, weight).otherwise(0.0).alias("w_")), "weighed")
    size, w = F.col("source_size"), F.col("w_")
    all_, of = weighed.agg(F.sum(size), F.sum(w)).first()
    left, level = share * (all_ or 0), 0.0
    while of and left / of > level:
        level = left / of
        full = passes * size <= level * w
        took, of = weighed.agg(F.coalesce(F.sum(F.when(full, passes * size)), F.lit(0.0)), F.sum(F.when(full, 0.0).otherwise(w))).first()
        left = share * all_ - took
    full = passes * size <= level * w
    target = F.when(full, passes * size).otherwise(F.lit(left) * w / F.lit(of or 1.0))
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    rest = F.when(size > 0, F.bround("target").cast("long") - F.col("whole") * size).otherwise(0).cast("long")
    return weighed.withColumn("target", target).withColumn("whole", whole).select("source", "source_size", "target", "whole", rest.alias("rest"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to ``budget``.

    Bounded knapsack over a bit set: each count is split into powers of two, the
    sums in reach are the bits of an integer, and the choice is read back.
    """
    lengths, counts, take = np.asarray(lengths, np.int64), np.asarray(counts, np.int64), np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return take
    spare = DP_WORDS // 2
    if budget > spare:  # an equal share of each length, leaving about DP_WORDS / 2 to the program
        take = np.floor(counts * ((budget - spare) / total)).astype(np.int64)
    rest = budget - int((lengths * take).sum())
    left = counts - take
    for i in np.argsort(-lengths, kind="stable"):  # what the rounding left over, until the program can meet it
        if rest <= DP_WORDS:
            break
        n = min(int(left[i]), int((rest - spare) // lengths[i])) if lengths[i] else 0
        if n > 0:
            take[i] += n
            left[i] -= n
            rest -= n * int(lengths[i])
    if rest > DP_WORDS:
        return take + _few(lengths, left, rest)
    # nothing taken is off by rest: what is off by more needs no looking at
    limit = 2 * rest
    mask = (1 << (limit + 1)) - 1
    items = []
    for i in np.flatnonzero((left > 0) & (lengths > 0) & (lengths <= limit)):
        n, k = min(int(left[i]), limit // int(lengths[i])), 1
        while n > 0:
            items.append((int(i), min(k, n)))
            n -= min(k, n)
            k *= 2
    reach, now = [1], 1
    for i, k in items:
        now |= (now << (int(lengths[i]) * k)) & mask
        reach.append(now)
        if now >> rest & 1:
            break
    best = next(s for d in range(limit + 1) for s in (rest - d, rest + d) if 0 <= s <= limit and now >> s & 1)
    for j in range(len(reach) - 1, 0, -1):
        if not reach[j - 1] >> best & 1:
            i, k = items[j - 1]
            best -= int(lengths[i]) * k
            take[i] += k
    return take


def _few(lengths: np.ndarray, left: np.ndarray, rest: int) -> np.ndarray:
    """What to take where every length that is left is over half of ``rest``, so that two documents are over it already or nearly so.

    The best is none, the document nearest to ``rest``, or the two least ones.
    """
    take, open_ = np.zeros(len(lengths), np.int64), np.flatnonzero((left > 0) & (lengths > 0))
    if not len(open_):
        return take
    one = open_[np.abs(lengths[open_] - rest).argmin()]
    least = open_[lengths[open_].argsort(kind="stable")][:2]
    two = [least[0]] * 2 if left[least[0]] > 1 else [*least] if len(least) == 2 else []
    options = [[], [one]] + ([two] if two else [])
    for i in min(options, key=lambda x: abs(int(lengths[x].sum()) - rest) if len(x) else rest):
        take[i] += 1
    return take


def _order(source: Column) -> list[Column]:
    return [source.isNull(), F.encode(source, "UTF-8")]


def mixture(docs: DataFrame, size: str, source: str, doc: str, seed: int = SEED) -> DataFrame:
    """``docs`` with source_size, target, passes and taken; ``passes`` is how often the mix takes the row.

    ``docs`` must be readable again with the same rows (a table).
    """
    totals = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    goals = written(planned(totals), "goals")

    groups = docs.groupBy(F.col(source).alias("source"), F.col(size).alias("size")).agg(F.count("*").alias("n"))
    chosen = groups.join(goals, groups["source"].eqNullSafe(goals["source"])).select(groups["source"], "size", "n", "rest")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        return pdf[["source", "size", "n"]].assign(take=fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), int(pdf["rest"].iloc[0])))

    chosen = written(chosen.groupBy("source").applyInPandas(choose, "source string, size long, n long, take long"), "chosen")
    s, g = "tw_source", "tw_size"
    chosen = chosen.select(F.col("source").alias(s), F.col("size").alias(g), F.col("n").alias("tw_n"), F.col("take").alias("tw_take"))
    seq, draw, block = "tw_seq", "tw_draw", "tw_block"
    base = docs.select("*", F.xxhash64(F.lit(seed), F.col(doc), F.col(seq)).alias(draw))
    # lengths grow with the sources: never broadcast
    base = base.join(chosen.hint("merge"), base[source].eqNullSafe(chosen[s]) & (base[size] == chosen[g]))
    # a length that all or none of the documents are taken of needs no order
    whole = (F.col("tw_take") == 0) | (F.col("tw_take") == F.col("tw_n"))
    part = base.where(~whole).withColumn(block, F.pmod(F.col(draw), F.ceil(F.col("tw_n") / BLOCK)))
    per = part.groupBy(s, g, block).agg(F.count("*").alias("tw_in"))
    per = per.withColumn("tw_before", F.coalesce(F.sum("tw_in").over(Window.partitionBy(s, g).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = per.select(F.col(s).alias("tw_s2"), F.col(g).alias("tw_g2"), F.col(block).alias("tw_b2"), "tw_before")
    part = part.join(per, part[s].eqNullSafe(per["tw_s2"]) & (part[g] == per["tw_g2"]) & (part[block] == per["tw_b2"]))
    rank = F.row_number().over(Window.partitionBy(s, g, block).orderBy(draw, doc, seq)) + F.col("tw_before")
    part = part.withColumn("tw_more", (rank <= F.col("tw_take")).cast("long"))
    rest = base.where(whole).withColumn("tw_more", (F.col("tw_take") > 0).cast("long"))
    out = part.select(*docs.columns, "tw_more").unionByName(rest.select(*docs.columns, "tw_more"))
    goals = goals.select(F.col("source").alias(s), "source_size", "target", "whole")
    out = out.join(goals, out[source].eqNullSafe(goals[s]))
    passes = F.col("whole") + F.col("tw_more")
    return out.select(*docs.columns, "source_size", "target", passes.alias("passes"), (passes * F.col(size)).alias("taken"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, tw_seq) as a table."""
    return written(docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), place(docs).alias("tw_seq")), "sized")


def mixing(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, passes."""
    return mixture(sized(docs), "size", "source", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "passes")


def stage(docs: DataFrame) -> DataFrame:
    """The mix: each row of ``docs`` as often as it is taken, with its columns.

    ``docs`` is read twice and must come from files.
    """
    seq, n = unused(docs, "tw_seq"), unused(docs, "tw_passes")
    plan = mixture(sized(docs), "size", "source", "doc_id").where("passes > 0").select(F.col("tw_seq").alias(seq), F.col("passes").alias(n))
    plan = written(plan, "mix")
    # the plan has a row for most documents: it is never small, so texts move once at any size
    out = docs.withColumn(seq, place(docs)).join(plan.hint("merge"), seq)
    return out.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(docs.columns)
