"""Personal data: base patterns, and terms that disclose them by corpus co-occurrence.

DataFrame functions only. The four patterns give spans of protected entities
(code points, end exclusive). Terms are whole words of a document that has an entity, wherever
they stand in it. Over the corpus, a term's disclosure of an entity is the share of the entity's
information that the term carries,

    log((1 - 1 / s) * n(e, t) * N / (n(e) * n(t))) / log(N / n(e)),

with n in documents, n(e, t) counting documents that have both, and s the
different surroundings in which they stand: towards 1 when t occurs nowhere else, 0
when it is independent. The first surroundings are discounted, as any text has
words beside an entity: one alone, or copies of it, is no evidence, and the more
there are the less is taken off. Surroundings are documents, those that nearly equal each
other being one (``_marks``), or the words within ``NEAR`` code points of an entity if
more of those that hold the term are different. Terms at or over ``REMOVE`` are
removed wherever they stand in a document with the entity. Those at or over ``GENERALISE`` are
generalised: to the most letters they begin with whose disclosure, of all the terms
that begin so taken together, is under ``GENERALISE``, and a star.

Lists of matches are worked through by scans in two levels (``_scan``) and texts cut by
chunks (``_cut``), so a text with very many matches takes time in proportion, nearly.

Defined cases: a null text counts as empty and has no spans; rows are judged
each, repeated ones too; an empty table gives an empty result; further columns
are left alone.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import unused, written

KINDS = ("email", "ip", "card", "phone")
#: Each possible start is tried once: inside a run of the same class only its first
#: character (or the end of the last match) can start a match that a later one could not extend.
PATTERNS = {
    "email": "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:(?<![0-9])|\\G)[0-9]++(?:\\.[0-9]++)(?:\\.[0-9]++)(?:\\.[0-9]++)",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: Cheap signs that a text may have a match at all.
PRECHECK = {"email": "@[A-Za-z0-9-]+\\.", "ip": "[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]", "card": "[0-9](?:[\\x20-]?[0-9]){13}", "phone": "\\+[0-9]"}
NEAR, GENERALISE, REMOVE = 64, 0.8, 0.95
WORD = "\\p{L}{4,}"
#: A word that isn't part of a name with marks and dots, such as an address or a domain.
TERM = "(?<![\\p{L}0-9@._%+-])\\p{L}{4,}+(?![0-9@_%+-]|\\.[\\p{L}0-9])"
#: Values that a scan takes together, and code points of a chunk.
RUN, CHUNK = 128, 4096
#: Minima of a document's marks.
MARKS = 8
_MORE = "array<struct<s:int,k:int,e:int,d:double,g:int>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = F.split(F.reverse(_digits(x)), "")
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
    return F.aggregate(F.transform(F.filter(d, lambda c: c != ""), value), F.lit(0), lambda a, v: a + v) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    x = match["v"]
    n = F.length(_digits(x))
    if kind == "ip":
        return F.forall(F.split(x, "\\."), lambda p: F.lpad(F.ltrim(p, F.lit("0")), F.greatest(F.length(p), F.lit(3)), "0") <= F.lpad(F.lit("255"), F.greatest(F.length(p), F.lit(3)), "0"))
    if kind == "card":
        return n.between(14, 19) & _luhn(x)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _scan(values: Column, op) -> Column:
    """For each of an array of integers, ``op`` (a sum or maximum) of all before it, 0 for the first.

    An array that grows by one is copied each time; in two levels that is little.
    """
    start = lambda at: F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda a, v: F.struct(op(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    each = lambda x, at: F.aggregate(x, start(at), step, lambda a: a["out"])

    def whole(v):
        first = F.filter(F.sequence(F.lit(0), F.size(v), F.lit(RUN)), lambda i: i < F.size(v))
        runs = F.transform(first, lambda i: F.slice(v, i + 1, F.lit(RUN)))
        return _let(runs, lambda r: F.flatten(F.zip_with(r, each(F.transform(r, lambda x: F.aggregate(x, F.lit(0), op)), F.lit(0)), each)))

    return _let(values, whole)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is made once, however often it is used there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def split_at(text: Column, pattern: str) -> Column:
    """Array of (p, v): the leftmost matches of ``pattern`` that do not overlap, each with what stands before it; last, what stands after all, with a null match.

    Both lists are of one scan's making.
    """
    return F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("v"))


def matches(zipped: Column) -> Column:
    """Array of (s, e, v, l, r) from the result of ``split_at``: l and r are what stands on either side, up to NEAR code points and to the next match."""
    found = F.filter(zipped, lambda z: z["v"].isNotNull())
    before = _scan(F.transform(found, lambda z: F.length(z["p"]) + F.length(z["v"])), _plus)
    after = F.transform(zipped, lambda z: F.left(z["p"], F.lit(NEAR + 1)))
    sides = F.arrays_zip(found.alias("z"), before.alias("at"), F.slice(after, 2, F.size(found)).alias("r"))

    def one(x):
        s = x["at"] + F.length(x["z"]["p"])
        return F.struct(s.alias("s"), (s + F.length(x["z"]["v"])).alias("e"), x["z"]["v"].alias("v"), F.right(x["z"]["p"], F.lit(NEAR + 1)).alias("l"), x["r"].alias("r"))

    return F.transform(sides, one)


def _of_kind(found: Column, k: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["s"].alias("s"), F.lit(k).alias("k"), m["e"].alias("e"), m["v"].alias("v"), m["l"].alias("l"), m["r"].alias("r")))


def _count(spans: str, k: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == k)).cast("long")


def with_base(docs: DataFrame, text_col: str = "text", out: str = "base") -> DataFrame:
    """``docs`` with an array of (s, k, e, v, l, r), sorted: the spans of all kinds that hold, k being the kind's place in KINDS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = [unused(docs, f"{kind}_") for kind in KINDS]
    # columns of their own, so that no text is searched twice
    docs = docs.withColumns({c: F.when(text.rlike(PRECHECK[kind]), split_at(text, PATTERNS[kind])) for c, kind in zip(raw, KINDS, strict=True)})
    found = [F.when(F.size(c) > 1, _of_kind(F.filter(matches(F.col(c)), partial(_holds, kind)), k)) for k, (c, kind) in enumerate(zip(raw, KINDS, strict=True))]
    none = F.array().cast("array<struct<s:int,k:int,e:int,v:string,l:string,r:string>>")
    return docs.withColumn(out, F.array_sort(F.concat(*[F.coalesce(f, none) for f in found]))).drop(*raw)


def _names(spans: Column) -> Column:
    kinds = F.array(*[F.lit(x) for x in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def _words(text: Column) -> Column:
    """Array of (s, v) of the terms of a text."""

    def places(found):
        at = _scan(F.transform(found, lambda z: F.length(z["p"]) + F.length(z["v"])), _plus)
        return F.zip_with(found, at, lambda z, a: F.struct((a + F.length(z["p"])).alias("s"), z["v"].alias("v")))

    return _let(F.filter(split_at(text, TERM), lambda z: z["v"].isNotNull()), places)


def _placed(words: Column, begin: Column) -> Column:
    """(s, e, v) of the result of ``_words`` of what begins at ``begin``, lower-cased."""
    return F.transform(words, lambda m: F.struct((begin + m["s"]).alias("s"), (begin + m["s"] + F.length(m["v"])).alias("e"), F.lower(m["v"]).alias("v")))


def _terms(x: Column) -> Column:
    """(s, e, v) of the terms beside a span: whole words of the NEAR code points on either side, lower-cased."""

    def side(text, begin, whole):
        # one more code point than NEAR tells whether a word is cut
        return _placed(F.filter(_words(text), lambda m: whole(m["s"], m["s"] + F.length(m["v"]))), begin)

    short = lambda t: F.length(t) <= NEAR
    left = side(x["l"], x["s"] - F.length(x["l"]), lambda s, e: short(x["l"]) | (s > 0))
    right = side(x["r"], x["e"], lambda s, e: short(x["r"]) | (e <= NEAR))
    return F.concat(left, right)


def _marks(terms: Column) -> Column:
    """MARKS minima of hashes of a document's runs of three terms: documents that nearly equal each other have one in common, and others have none."""
    runs = lambda v: F.transform(v, lambda x, i: F.xxhash64(F.get(v, i - 1), x, F.get(v, i + 1)))
    return _let(_let(terms, runs), lambda h: F.array(*[F.array_min(F.transform(h, lambda x: F.xxhash64(F.lit(k), x))) for k in range(MARKS)]))


def disclosing(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Per row of ``docs`` with entities: (row, more_) of terms that disclose an entity of the row; more_ is an array of (s, k, e, d, g).

    ``docs`` has row, base and the text, and is a table.
    """
    hit, text = docs.where(F.size("base") > 0), F.coalesce(F.col(text_col), F.lit(""))
    near = hit.select("row", F.explode("base").alias("x")).select("row", F.concat_ws(":", "x.k", "x.v").alias("entity"), _terms(F.col("x")).alias("near"))
    near = near.withColumn("around", F.xxhash64(F.transform("near", lambda t: t["v"])))
    near = written(near.select("row", "entity", "around", F.explode("near").alias("t")).select("row", "entity", "around", "t.s", "t.e", F.col("t.v").alias("term")), "near")
    beside = near.groupBy("entity", "term", "around").agg(F.count("*").alias("c")).groupBy("entity", "term").agg(F.count("*").alias("beside")).where("beside > 1")
    beside = written(beside, "beside")
    total = float(docs.count())
    each = written(hit.select("row", F.explode(F.array_distinct(F.transform("base", lambda y: F.concat_ws(":", y["k"], y["v"])))).alias("entity")), "entities")
    n_e = each.groupBy("entity").agg(F.count("*").alias("n_e")).join(beside.select("entity").distinct().withColumn("some", F.lit(True)), "entity", "left")
    # support: different surroundings (the logarithm of a pair with one is minus infinity); what is in one document has them beside it only
    held = written(each.join(n_e.where((F.col("n_e") < total) & ((F.col("n_e") > 1) | F.col("some"))).drop("some"), "entity"), "held")
    if held.isEmpty():
        return near.select("row").limit(0).withColumn("more_", F.array().cast(_MORE))
    whole = docs.join(held.select("row").distinct(), "row").select("row", F.transform(_words(text), lambda m: F.lower(m["v"])).alias("terms"))
    whole = written(whole.select("row", F.array_distinct("terms").alias("terms"), _marks(F.col("terms")).alias("marks")), "whole")
    both = held.join(whole.select("row", F.explode("terms").alias("term")), "row").select("row", "entity", "term", "n_e")
    both = both.unionByName(near.join(held, ["row", "entity"]).select("row", "entity", "term", "n_e")).distinct()
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), 0))).alias("term"))
    # a row a term, whatever the number of documents
    known = written(words.groupBy("term").agg(F.count("*").alias("n_t")), "vocabulary")

    def share(n_et, n_t):
        # a term beside an entity is cut at the entity, so n_t is n_et at least
        return F.log((1 - 1 / F.col("support")) * n_et * total / (F.col("n_e") * F.greatest(n_t, n_et))) / F.log(total / F.col("n_e"))

    # exact: the share of a term in more documents is under GENERALISE, were it in all that have the entity
    most = F.col("n_e") * F.pow(total / F.col("n_e"), F.lit(1 - GENERALISE)) * (1 + 1e-9)
    pairs = written(both.join(known, "term").where(F.col("n_t") <= most), "pairs")
    marked = pairs.join(whole.select("row", F.posexplode("marks").alias("i", "mark")), "row")
    marked = marked.groupBy("entity", "term", "n_e", "n_t", "i", "mark").agg(F.count("*").alias("c")).groupBy("entity", "term", "n_e", "n_t", "i").agg(F.count("*").alias("different"), F.sum("c").alias("c"))
    scored = marked.groupBy("entity", "term", "n_e", "n_t").agg(F.min("different").alias("different"), F.max("c").alias("n_et")).join(beside, ["entity", "term"], "left")
    scored = scored.withColumn("support", F.greatest("different", "beside")).where("support > 1")
    found = written(scored.withColumn("d", share(F.col("n_et"), F.col("n_t"))).where(F.col("d") >= GENERALISE), "scored")
    if found.isEmpty():
        return near.select("row").limit(0).withColumn("more_", F.array().cast(_MORE))
    cut = found.where(F.col("d") < REMOVE)
    n_et = both.join(cut.select("entity").distinct(), "entity").groupBy("entity", "term").agg(F.count("*").alias("n_et"))
    d = found.join(_general(cut, n_et, known, share, total), ["entity", "term"], "left").select("entity", "term", "d", F.coalesce("g", F.lit(0)).alias("g"))
    chosen = written(pairs.join(d, ["entity", "term"]).select("row", "term", "d", "g").distinct(), "disclosing")
    rows = chosen.select("row").distinct()
    places = docs.join(rows, "row").select("row", F.explode(_placed(_words(text), F.lit(0))).alias("t")).select("row", "t.s", "t.e", F.col("t.v").alias("term"))
    places = places.unionByName(near.join(rows, "row").select("row", "s", "e", "term"))
    return places.join(chosen, ["row", "term"]).groupBy("row").agg(F.array_sort(F.collect_set(F.struct("s", F.lit(len(KINDS)).alias("k"), "e", "d", "g"))).alias("more_"))


def _general(found: DataFrame, each: DataFrame, known: DataFrame, share, total: float) -> DataFrame:
    """(entity, term, g): how many letters of each term of ``found`` its general form keeps; terms that none but the empty beginning suits are absent. ``each`` has n_et of all terms."""
    heads = lambda least: F.explode(F.transform(F.sequence(F.lit(1), F.length("term") - least), lambda n: F.left("term", n))).alias("head")
    asked = written(found.select("entity", "term", "support", "n_e", heads(1)), "heads")
    some = asked.select("head").distinct()
    # counted by beginnings: no beginning is in more documents than there are
    n_t = known.select("n_t", heads(0)).join(some, "head").groupBy("head").agg(F.least(F.sum("n_t"), F.lit(int(total))).alias("n_t"))
    n_et = each.select("entity", "n_et", heads(0)).join(some, "head", "left_semi").groupBy("entity", "head").agg(F.sum("n_et").alias("n_et"))
    taken = asked.join(n_t, "head").join(n_et, ["entity", "head"]).withColumn("d", share(F.least("n_et", "n_e"), F.col("n_t")))
    return taken.where(F.col("d") < GENERALISE).groupBy("entity", "term").agg(F.max(F.length("head")).alias("g"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: doc_id, the base counts, base_sha256, spans, n_terms and, if asked for, clean_text.

    Entities become ``[KIND]``, generalised terms their first letters and a star, removed terms nothing.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = written(with_base(own), "spans")
    more = disclosing(rows)
    out = rows.select("doc_id", "base", "row", *["text"] * with_text).join(written(more, "terms"), "row", "left")
    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.lit(1.0).alias("d"), F.lit(0).alias("g")))
    # a term with two entities has two scores, side by side as they are sorted: the highest stands
    more_ = F.coalesce(F.col("more_"), F.array().cast(_MORE))
    extra = F.filter(more_, lambda x, i: F.coalesce(F.get(more_, i + 1)["s"] != x["s"], F.lit(True)))
    out = out.withColumn("extra_", extra).withColumn("all_", F.array_sort(F.concat(base, "extra_")))
    cols = ["doc_id"]
    cols += [_count("base", k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    cols += [F.sha2(_names(F.col("base")), 256).alias("base_sha256"), _names(F.col("all_")).alias("spans"), F.size("extra_").cast("long").alias("n_terms")]
    if not with_text:
        return out.select(*cols)
    chunks = F.transform(F.sequence(F.lit(0), F.length("text"), F.lit(CHUNK)), lambda i: F.substring(F.col("text"), i + 1, F.lit(CHUNK)))
    out = out.withColumn("chunks_", F.when(F.size("all_") > 0, chunks)).withColumn("before_", _scan(F.transform("all_", lambda x: x["e"]), _most))
    return out.select(*cols, F.when(F.size("all_") > 0, _cleaned()).otherwise(F.col("text")).alias("clean_text"))


def _cut(begin: Column, end: Column) -> Column:
    """The text from ``begin`` to ``end``, out of its chunks: a substring is counted from the start of what it is taken from."""
    first = F.floor(begin / CHUNK).cast("int")
    of = F.array_join(F.slice("chunks_", first + 1, F.floor(end / CHUNK).cast("int") - first + 1), "")
    return F.substring(of, begin - first * CHUNK + 1, F.greatest(end - begin, F.lit(0)))


def _cleaned() -> Column:
    marks = F.array(*[F.lit(f"[{x.upper()}]") for x in KINDS])

    def one(x, before):
        term = F.when(x["g"] > 0, F.concat(_cut(x["s"], x["s"] + x["g"]), F.lit("*"))).otherwise("")
        mark = F.when(x["k"] == len(KINDS), F.when((x["d"] < REMOVE) & (x["g"] == 0), "*").otherwise(term)).otherwise(F.get(marks, x["k"]))
        return F.concat(_cut(before, F.greatest(before, x["s"])), F.when(x["s"] >= before, mark).otherwise(""))

    last = F.array_max(F.transform("all_", lambda x: x["e"]))
    return F.concat(F.array_join(F.zip_with("all_", "before_", one), ""), _cut(last, F.length("text")))
