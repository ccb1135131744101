"""Quality rules with host verdicts, in DataFrame functions only.

Each text gets counts; a document that breaks a base rule fails. Failures are
summed by host (any column, here ``source``), each host's failure rate is shrunk
towards a beta prior fitted to all hosts by moments, and hosts above the
threshold are rejected with all their documents.

Defined cases: a null or blank text has no words and fails; a null host is a
host of its own; hosts tie-free by value; an empty table gives an empty result;
further columns are left alone; rows that repeat are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import SPACES, unused, written

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A host whose shrunk failure rate is above this is rejected.
MAX_HOST_RATE = 0.6
#: Up to so many rejected hosts are sent to the executors as a list; more are joined.
MAX_LISTED = 10_000


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null or blank."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, "[ \\t-\\r]+"))


def with_counts(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    ``n_repeat_words``: windows of three words are hashed, sorted as (hash, place);
    those equal to a neighbour are repeats, and each adds the words that the
    repeat before it did not cover.
    """
    p = prefix
    text = F.coalesce(F.col(text_col), F.lit(""))
    w, s, d, y = (unused(docs, x) for x in ("w_", "s_", "d_", "l_"))
    df = docs.withColumn(w, words_of(F.col(text_col)))
    df = df.withColumns(
        {
            f"{p}n_words": F.size(w).cast("long"),
            f"{p}word_chars": F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")).cast("long"),
            f"{p}n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            y: F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0),
            s: F.when(F.size(w) < 3, None).otherwise(F.sort_array(F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.struct(F.xxhash64(x, F.get(F.col(w), i + 1), F.get(F.col(w), i + 2)).alias("h"), i.alias("i"))))),
        }
    )
    near = lambda x, i: (x["h"] == F.get(F.col(s), i - 1)["h"]) | (x["h"] == F.get(F.col(s), i + 1)["h"])
    df = df.withColumn(d, F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(near(x, i), F.lit(False))), lambda x: x["i"])))
    fresh = F.aggregate(d, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("e")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["e"])).alias("n"), x.alias("e")), lambda a: a["n"])
    df = df.withColumns({f"{p}n_dup_lines": (F.size(y) - F.size(F.array_distinct(y))).cast("long"), f"{p}n_repeat_words": F.coalesce(fresh, F.lit(0)).cast("long")})
    failed = (F.col(f"{p}n_words") < MIN_WORDS) | (100 * F.col(f"{p}n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{p}n_words"))
    return df.withColumn(f"{p}base_failed", failed).drop(w, s, d, y)


def host_rates(judged: DataFrame, host: str, failed: str = "base_failed") -> DataFrame:
    """(host, n, n_failed, rate): the posterior mean of each host's failure rate.

    The beta prior's mean and strength come from all hosts by moments. Where the
    hosts differ no more than chance allows, the strength is its upper bound.
    """
    per = written(judged.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("n_failed")), "hosts")
    r = F.col("n_failed") / F.col("n")
    m = per.agg(F.sum("n_failed"), F.sum("n"), F.var_samp(r), F.avg(1 / F.col("n"))).first()
    if not m[1]:
        return per.withColumn("rate", F.lit(0.0))
    mean = (m[0] + 0.5) / (m[1] + 1.0)
    spread = max((m[2] or 0.0) - mean * (1 - mean) * m[3], 1e-6)
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1000.0)
    return per.withColumn("rate", (F.col("n_failed") + mean * strength) / (F.col("n") + strength))


def judge(judged: DataFrame, host: str, failed: str = "base_failed", out: str = "kept") -> DataFrame:
    """``judged`` with the column ``out``: neither failed nor from a rejected host."""
    bad = written(host_rates(judged, host, failed).where(F.col("rate") > MAX_HOST_RATE).select("host"), "rejected")
    some = bad.limit(MAX_LISTED + 1).collect()
    if len(some) <= MAX_LISTED:
        listed = [x[0] for x in some if x[0] is not None]
        hit = F.col(host).isin(listed) if listed else F.lit(False)
        hit = F.coalesce(hit, F.lit(False)) | (F.col(host).isNull() & F.lit(any(x[0] is None for x in some)))
        return judged.withColumn(out, ~F.col(failed) & ~hit)
    b, h = unused(judged, "bad_"), unused(judged, "host_")
    bad = bad.select(F.col("host").alias(h), F.lit(True).alias(b))
    return judged.join(bad, F.col(host).eqNullSafe(F.col(h)), "left").withColumn(out, ~F.col(failed) & F.col(b).isNull()).drop(b, h)


def quality(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept."""
    stats = with_counts(docs.select("doc_id", "source", "text")).drop("text")
    stats = written(stats, "stats")
    return judge(stats, "source").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules and host verdicts keep, with its columns."""
    p = "q_"
    while any(c.startswith(p) for c in docs.columns):
        p = "q" + p
    judged = written(with_counts(docs, prefix=p).select(*docs.columns, f"{p}base_failed"), "judged")
    return judge(judged, "source", f"{p}base_failed", f"{p}kept").where(f"{p}kept").select(docs.columns)
