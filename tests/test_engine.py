import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.errors import BindError, EngineError, PlanError, RunError
from tidewater.operators import changelog
from tidewater.sources.catalog import Status
from tidewater.streaming.dsl import Hopping, JoinWindows, Session, Tumbling, stream
from tidewater.streaming.engine import Engine

BASE = dt.datetime(2024, 1, 1)


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.fixture
def engine(spark):
    return Engine(spark, lateness="1000 days")


@pytest.fixture(scope="module")
def clicks(spark):
    return spark.createDataFrame([("a", at(s), s) for s in (0, 9, 10, 25)], "k string, ts timestamp, v int")


def one(spark, sql, compat=False, **columns):
    e = Engine(spark, compat=compat)
    schema = ", ".join(f"{k} {t}" for k, (_, t) in columns.items()) or "x int"
    e.register_frame("s", spark.createDataFrame([tuple(v for v, _ in columns.values()) or (1,)], schema))
    return tuple(e.sql(sql).first())


def test_scalar_edges(spark):
    assert one(spark, "SELECT ROUND(0.5), ROUND(1.5), ROUND(2.5), ROUND(-0.5), CAST(-1.5 AS INTEGER), SIGN(-3), LOG(0), ASIN(2), ACOSH(0.5), ATANH(1) FROM s;".replace("ROUND(", "ROUND (")) == (0, 2, 2, 0, -2, -1, None, None, None, None)
    assert one(spark, "SELECT TAKE(2,'abc'), TAKEEND(2,'abc') AS b, DROP(1,'abc') AS c, DROPEND(1,'abc') AS d, SPLIT('.','a.b.c') AS e, CHUNKSOF(3,'abcdefg') AS f FROM s;") == ("ab", "bc", "bc", "ab", ["a", "b", "c"], ["abc", "def", "g"])
    assert one(spark, "SELECT TRIM(x) AS a, LEFT_TRIM(x) AS b, RIGHT_TRIM(x) AS c, REVERSE(x) AS d, STRLEN(x) AS e FROM s;", x=("\t a\n", "string")) == ("a", "a\n", "\t a", "\na \t", 4)
    assert one(spark, "SELECT CHUNKSOF(0, 'abc') AS a, TAKE(0, 'abc') AS b, DROP(9, 'abc') AS c, DROPEND(9, 'abc') AS d, TAKEEND(0, 'abc') AS e FROM s;") == ([], "", "", "", "")
    assert one(spark, "SELECT DATETOSTRING(0, '%Y-%m-%d %H:%M:%S') AS a, STRINGTODATE('Thu, 01 Jan 1970 00:01:00 GMT', '%a, %d %b %Y %H:%M:%S GMT') AS b, STRINGTODATE('x', '%Y-%m-%d %H:%M:%S') AS c FROM s;") == ("1970-01-01 00:00:00", 60, None)


def test_null_arguments(spark):
    from tidewater.functions.scalar import MATH, TEXT

    cols = [f"{f}(x) AS m{i}" for i, f in enumerate(MATH)] + [f"{f}(t) AS t{i}" for i, (f, (n, _)) in enumerate(TEXT.items()) if n == (1,)]
    assert set(one(spark, f"SELECT {', '.join(cols)} FROM s;", x=(None, "double"), t=(None, "string"))) == {None}


def test_arrays(spark):
    got = one(spark, "SELECT ARRAY_DISTINCT({1,1,2,3,1,2}) AS a, ARRAY_EXCEPT({1,2,3,1,2},{2,3}) AS b, ARRAY_INTERSECT({1,2,3,1,2},{2,1}) AS c, ARRAY_UNION({1,2,3,1,2},{4,1}) AS d, ARRAY_REMOVE({1,2,3,2,1},2) AS e, ARRAY_REMOVE({'Foo','Bar',NULL,'baz'},NULL) AS f, ARRAY_MAX({'Foo','Bar','baz'}) AS g, ARRAY_MIN({'Foo','Bar','baz'}) AS h, ARRAY_SORT({'Foo','Bar','baz'}) AS i, ARRAY_CONTAIN({1,NULL},NULL) AS j, ARRAY_JOIN({1,NULL,2},'--') AS k, ({1,2,3})[0:1] AS l, ({1,2,3})[9] AS m FROM s;")
    assert got == ([1, 2, 3], [1], [1, 2], [1, 2, 3, 4], [1, 3, 1], ["Foo", "Bar", "baz"], "baz", "Bar", ["Bar", "Foo", "baz"], True, "1--NULL--2", [1, 2], None)


def test_compat_logic(spark):
    sql = "SELECT NULL = NULL AS a, 1 = NULL AS b, (NULL :: INTEGER) <= (NULL :: INTEGER) AS c, (NULL :: BOOLEAN) AND FALSE AS d, CAST(NULL AS STRING) AS e, CAST(TRUE AS STRING) AS f FROM s;"
    assert one(spark, sql, compat=True) == (True, False, True, None, "NULL", "True")
    assert one(spark, sql) == (None, None, None, False, None, "true")


def test_compat_aggregates(spark):
    e = Engine(spark, compat=True)
    e.register_frame("s", spark.createDataFrame([(1, -5), (1, -3), (2, None), (2, 4)], "k int, v int"))
    assert rows(e.sql("SELECT k, COUNT(v) AS n, MAX(v) AS hi, MIN(v) AS lo, SUM(v) AS s FROM s GROUP BY k;")) == [(1, 2, 0, -5, -8), (2, 2, None, None, None)]


def test_names_and_ambiguity(spark):
    e = Engine(spark)
    for n in "ab":
        e.register_frame(n, spark.createDataFrame([(1, 2)], "k int, v int"))
    assert e.sql("SELECT * FROM a INNER JOIN b ON a.k = b.k;").columns == ["a.k", "a.v", "b.k", "b.v"]
    for bad in ("SELECT v FROM a INNER JOIN b ON a.k = b.k;", "SELECT z FROM a;", "SELECT * FROM a INNER JOIN a ON a.k = a.k;", "SELECT k AS x, v AS x FROM a;"):
        with pytest.raises(BindError):
            e.sql(bad)


def test_windows(spark, clicks):
    e = Engine(spark)
    e.register_frame("s", clicks, "ts")
    count = lambda w: rows(e.sql(f"SELECT COUNT(*) AS n, window_start, window_end FROM {w} GROUP BY k;"))
    assert count("TUMBLE(s, INTERVAL 10 SECOND)") == [(1, at(10), at(20)), (1, at(20), at(30)), (2, at(0), at(10))]
    assert (2, at(5), at(15)) in count("HOP(s, INTERVAL 10 SECOND, INTERVAL 5 SECOND)")
    assert count("SESSION(s, INTERVAL 10 SECOND)") == [(1, at(25), at(25)), (3, at(0), at(10))]
    assert count("SLIDING(s, INTERVAL 9 SECOND)") == [(1, at(-9), at(0)), (1, at(16), at(25)), (2, at(0), at(9)), (2, at(1), at(10))]
    with pytest.raises(EngineError):
        e.sql("SELECT COUNT(*) FROM TUMBLE(TUMBLE(s, INTERVAL 1 HOUR), INTERVAL 1 HOUR) GROUP BY k;")


def test_band_join(spark):
    e = Engine(spark)
    for n in "lr":
        e.register_frame(n, spark.createDataFrame([(s, at(s)) for s in (0, 10, 12, 99)] + [(None, None)], f"{n}v int, ts timestamp"), "ts")
    assert len(rows(e.sql("SELECT lv, rv FROM l CROSS JOIN r WITHIN (INTERVAL 10 SECOND);"))) == 8
    full = rows(e.sql("SELECT lv, rv FROM l FULL JOIN r ON lv < rv WITHIN (INTERVAL 10 SECOND);"))
    assert len(full) == 2 + 3 + 3  # (0,10) (10,12); 12, 99 and null alone left; 0, 99 and null alone right
    assert len(rows(e.sql("SELECT lv, rv FROM l RIGHT JOIN r ON lv < rv WITHIN (INTERVAL 10 SECOND);"))) == 5


def test_over_interval(spark):
    """A hot key's rows are in windows of a bucket, with what a window of the key alone gives; rows without a time see one another."""
    from pyspark.sql import Window

    from tidewater.operators import joins

    df = spark.createDataFrame([(i % 3, at(i * i % 97), i) for i in range(60)] + [(0, None, 60), (0, None, 61)], "k int, ts timestamp, v int")
    w = Window.partitionBy("k").orderBy(F.unix_micros("ts")).rangeBetween(-10_000_000, 0)
    want = df.withColumns({"n": F.count("*").over(w), "s": F.sum("v").over(w)})
    assert rows(joins.as_of(df, 10_000_000, ["k"], "ts", {"n": F.count("*"), "s": F.sum("v")})) == rows(want)


def test_over_interval_from_halves(spark):
    """Aggregates from two running ones give what a window of each row's interval gives, and no such window is in the plan but for what can't be split."""
    import math
    import random

    from pyspark.sql import Window

    from tidewater.functions.aggregates import Framed
    from tidewater.operators import joins

    r, top = random.Random(3), 2**63 - 1
    some = lambda x: None if r.random() < 0.2 else x
    data = [(r.randrange(3), some(at(r.choice([r.randrange(-40, 40), r.randrange(-4000, 4000) / 100]))), some(r.randrange(-99, 99)), some(r.choice([r.randrange(-9, 9) / 4, math.nan, math.inf])), some(r.choice("abé")), r.randrange(10**9)) for _ in range(400)]
    df = spark.createDataFrame(data, "k int, ts timestamp, v long, f double, s string, u long").withColumn("d", (F.col("u") / 1000).cast("decimal(12,3)")).withColumn("e", F.col("d").cast("decimal(38,18)"))
    build = {
        "n": lambda f: f.count("*"), "nv": lambda f: f.count("v"), "sv": lambda f: f.sum("v"), "sf": lambda f: f.sum(F.col("f")), "sd": lambda f: f.sum("d"), "av": lambda f: f.avg("v"), "af": lambda f: f.avg("f"),
        "lo": lambda f: f.min("f"), "hi": lambda f: f.max("f"), "ls": lambda f: f.min("s"), "hs": lambda f: f.max("s"), "some": lambda f: f.max(F.col("v") > 90), "spread": lambda f: f.max("v") - f.min("v"),
    }
    whole = {"se": lambda f: f.sum("e"), "ad": lambda f: f.avg("d"), "l": lambda f: F.sort_array(f.collect_list("v"))}
    frames = lambda x: [w for w in x._jdf.queryExecution().optimizedPlan().toString().split("specifiedwindowframe(")[1:] if not w.startswith("RangeFrame, unboundedpreceding$()")]
    for us in (0, 1, 9_000_000, 33_333_333):
        w = Window.partitionBy("k").orderBy(F.unix_micros("ts")).rangeBetween(-us, 0)
        want = df.withColumns({k: b(Framed(w)) for k, b in {**whole, **build}.items()})
        got = joins.as_of(df, us, ["k"], "ts", {**whole, **build})
        assert got.schema == want.schema
        assert str(rows(got)) == str(rows(want))  # NaN isn't equal to itself
        assert frames(got) and not frames(joins.as_of(df, us, ["k"], "ts", build))
    # the whole's sum fits, a part's doesn't
    e = Engine(spark)
    e.register_frame("s", spark.createDataFrame([("a", at(8), -5), ("a", at(11), top), ("a", at(12), 1), ("a", at(13), None)], "k string, ts timestamp, v long"), "ts")
    got = e.sql("SELECT SUM(v) AS s, COUNT(v) AS n FROM SLIDING(s, INTERVAL 10 SECOND) GROUP BY k;")
    assert sorted(tuple(x)[:2] for x in got.collect()) == [(-5, 1), (top - 5, 2), (top - 4, 3), (top - 4, 3)]
    assert not frames(got)
    for compat in (False, True):
        e = Engine(spark, compat=compat)
        e.register_frame("s", df, "ts")
        sql = "SELECT k, SUM(v) AS s, MAX(v) AS hi, MIN(v) AS lo, COUNT(v) AS n FROM SLIDING(s, INTERVAL 9 SECOND) GROUP BY k;"
        v, w = F.col("v"), Window.partitionBy("k").orderBy(F.unix_micros("ts")).rangeBetween(-9_000_000, 0)
        plain = [F.sum(v).over(w), F.max(v).over(w), F.min(v).over(w), F.count(v).over(w)]
        if compat:
            known = ~F.max(v.isNull()).over(w)
            plain = [F.when(known, plain[0]), F.when(known, F.greatest(F.lit(0), plain[1])), F.when(known, F.least(F.lit(0), plain[2])), F.count("*").over(w)]
        assert rows(e.sql(sql).drop("window_start")) == rows(df.select("k", *plain, "ts"))
        assert not frames(e.sql(sql))


def test_lookup(spark):
    """The last change up to each row's time, over any number of buckets; a change at the same time counts."""
    from tidewater.operators import joins

    clicks = spark.createDataFrame([("a", at(s), s) for s in (0, 5, 10, 99, 500)] + [("b", at(7), 7), (None, at(7), 8), ("a", None, 9)], "k string, t timestamp, v int")
    table = spark.createDataFrame([("a", at(5), "x"), ("a", at(6), "y"), ("a", at(98), None), ("b", at(8), "z"), ("a", None, "lost")], "k string, u timestamp, w string")
    for bucket in (1_000_000, 10_000_000, 10**12):
        assert rows(joins.lookup(clicks, table, ["k"], "t", "u", bucket).select("v", "w")) == [(10, "y"), (5, "x"), (500, None), (99, None)]


def test_timed_changelog(spark, clicks):
    log = changelog.for_interval(clicks.select("k", "ts"), "ts", F.expr("INTERVAL 10 SECONDS")).drop("ts")
    t = lambda s: F.lit(at(s))
    assert rows(changelog.advance(log, t(9))) == [("a", 2)] and rows(changelog.advance(log, t(10))) == [("a", 2)] and rows(changelog.advance(log, t(20))) == []
    assert rows(changelog.between(log, t(10), t(20))) == [("a", -2)]
    assert rows(changelog.advance(changelog.for_window(clicks.select("k", "ts"), "ts", "10 seconds").drop("ts"), t(12)).select("k", "_diff")) == [("a", 1)]


def test_stream_full_join_and_sliding(spark, tmp_path):
    """Rows come in two batches; padded rows come when the watermark has passed."""
    e = Engine(spark, lateness="0 seconds")
    for n in "lr":
        e.execute(f"CREATE STREAM {n} ({n}v INTEGER, {n}k STRING);")
    put = lambda n, *v: e.append(n, spark.createDataFrame([(x, "a", at(x)) for x in v], f"{n}v long, {n}k string, _ts timestamp"))
    put("l", 0, 12, 50)
    put("r", 5, 99)
    q = e.execute("SELECT lv, rv FROM l FULL JOIN r ON lv < rv WITHIN (INTERVAL 10 SECOND) EMIT CHANGES;")
    s = e.execute("SELECT SUM(lv) AS s, COUNT(*) AS n FROM SLIDING(l, INTERVAL 12 SECOND) GROUP BY lk EMIT CHANGES;")
    e.wait(q)
    put("l", 300)
    put("r", 300)
    e.refresh(q)
    e.refresh(s)
    assert rows(e.changes(q)) == [(0, 5), (12, None), (50, None), (None, 99)]
    assert rows(e.changes(s).select("s", "n")) == [(0, 1), (12, 2), (300, 1), (50, 1)]


def test_sliding_spans():
    """What is carried from span to span gives what each span gives alone, exactly, in time that doesn't grow with the spans."""
    import math
    import random
    import time
    from decimal import Decimal
    from fractions import Fraction

    from tidewater.functions.sliding import over_spans

    r, nan = random.Random(5), math.nan
    kinds = {int: lambda: r.randrange(-(2**62), 2**62), float: lambda: r.choice([r.gauss(0, 1), r.gauss(0, 1e17), 0.1]), Decimal: lambda: Decimal(r.randrange(10**30)).scaleb(-9), str: lambda: r.choice("abcdé")}
    for kind, draw in kinds.items():
        values = [None if r.random() < 0.3 else draw() for _ in range(120)]
        lows = sorted(r.randrange(100) for _ in range(60))
        spans = list(zip(lows, sorted(x + r.randrange(20) for x in lows), strict=True))
        parts = [[v for v in values[lo:hi] if v is not None] for lo, hi in spans]
        assert over_spans("COUNT", 0, values, spans) == [len(p) for p in parts]
        assert over_spans("MIN", 0, values, spans) == [min(p, default=None) for p in parts]
        assert over_spans("MAX", 0, values, spans) == [max(p, default=None) for p in parts]
        for k in (0, 1, 3, 99):
            assert over_spans("TOPK", k, values, spans) == [sorted(p, reverse=True)[:k] for p in parts]
            assert over_spans("TOPKDISTINCT", k, values, spans) == [sorted(set(p), reverse=True)[:k] for p in parts]
        if kind is not str:
            exact = [sum(map(Fraction, p)) if p else None for p in parts]
            assert [None if x is None else Fraction(x) for x in over_spans("SUM", 0, values, spans)] == [None if x is None else Fraction(float(x)) if kind is float else x for x in exact]
            assert over_spans("AVG", 0, values, spans) == [None if x is None else float(x) / len(p) for x, p in zip(exact, parts, strict=True)]
    odd = [1.0, math.inf, 2.0, -math.inf, nan, 1e308, 1e308]
    spans = [(0, 1), (0, 2), (1, 3), (1, 4), (2, 4), (4, 6), (5, 7)]
    assert str(over_spans("SUM", 0, odd, spans)) == str([1.0, math.inf, math.inf, nan, -math.inf, nan, math.inf])
    assert str(over_spans("MAX", 0, odd, spans)) == str([1.0, math.inf, math.inf, math.inf, 2.0, nan, 1e308])
    assert str(over_spans("TOPK", 1, odd, spans)) == str([[1.0], [math.inf], [math.inf], [math.inf], [2.0], [nan], [1e308]])
    n, began = 40_000, time.process_time()
    values, spans = [float(i * i % 977) for i in range(n)], [(max(0, i - n // 2), i + 1) for i in range(n)]
    for name in ("COUNT", "SUM", "AVG", "MIN", "MAX", "TOPK"):
        over_spans(name, 3, values, spans)
    assert time.process_time() - began < 10  # over a minute if each span is gone through


def test_stream_sliding_splits_a_hot_key(spark):
    """A key's rows are in states by time, seen from the next one too; states end with the watermark, and a row that comes after that still has its result."""
    e = Engine(spark, lateness="0 seconds")
    e.execute("CREATE STREAM h (v INTEGER, k STRING);")
    put = lambda v: e.append("h", spark.createDataFrame([(i, "a", at(t)) for i, t in enumerate(v)], "v long, k string, _ts timestamp"))
    times = [i * i * 7 % 40_000 * 24 for i in range(80)] + [0, 86_399, 86_400, 172_799, 172_800, 172_800, -1, 864_000]
    put(times)
    states = lambda q: [p["stateOperators"][0]["numRowsTotal"] for p in q.handles[0].recentProgress if p["stateOperators"]]
    queries = {w: e.execute(f"SELECT SUM(v) AS s, COUNT(*) AS n, MIN(v) AS lo, MAX(v) AS hi, AVG(v) AS m FROM SLIDING(h, INTERVAL {w} SECOND) GROUP BY k EMIT CHANGES;") for w in (172_800, 60)}
    for w, q in queries.items():
        e.wait(q)
        parts = [(t, [i for i, x in enumerate(times) if t - w <= x <= t]) for t in times]
        want = [(sum(p), len(p), min(p), max(p), sum(p) / len(p), at(t)) for t, p in parts]
        assert rows(e.changes(q).select("s", "n", "lo", "hi", "m", "window_end")) == rows(spark.createDataFrame(want, "s long, n long, lo long, hi long, m double, e timestamp"))
        assert max(states(q)) >= 6
    put([9_600_000])
    for w, q in queries.items():
        e.refresh(q)
        assert states(q)[-1] == 1 + (w == 172_800)
    put([5])
    for q in queries.values():
        e.refresh(q)
        assert rows(e.changes(q).where(F.col("window_end") == F.lit(at(5))).select("s", "n")) == [(0, 1)]


def test_shards_and_compression(engine, spark):
    engine.execute("CREATE STREAM s (a INTEGER);")
    for how in (None, "none", "gzip", "zstd"):
        engine.append("s", spark.range(25).select(F.col("id").alias("a")), how)
    with pytest.raises(RunError):
        engine.append("s", spark.range(1).select(F.col("id").alias("a")), "lzh")
    parts = [rows(engine.read_shard("s", i, 3, ["a"]).select("a")) for i in range(3)]
    assert sorted(x for p in parts for x in p) == sorted((i,) for i in range(25) for _ in range(4)) and all(parts)
    with pytest.raises(RunError):
        engine.read_shard("s", 3, 3, ["a"])


def test_free_fields_are_noted(engine, spark):
    engine.execute("CREATE STREAM free;")
    engine.append("free", spark.createDataFrame([(1,)], "a long"))
    engine.append("free", spark.createDataFrame([(1.5, "x")], "a double, b string"))
    assert engine._exists(f"{engine.catalog.get('STREAM', 'free').path}/_schema")
    assert rows(engine.sql("SELECT a, b FROM free;")) == [(1.0, None), (1.5, "x")]


def test_push_and_chain(engine):
    engine.execute("CREATE STREAM s4 (a INTEGER, b INTEGER);")
    for _ in range(4):
        engine.execute("INSERT INTO s4 (a, b) VALUES (1, 4);")
    q = engine.execute("CREATE STREAM s5 AS SELECT SUM(a), COUNT(*) AS result, b FROM s4 GROUP BY b;")
    engine.wait(q)
    assert rows(engine.sql('SELECT "SUM(a)", result AS cnt, b FROM s5;'))[-1] == (4, 4, 4)
    q = engine.execute("SELECT * FROM s4 EMIT CHANGES;")
    engine.wait(q)
    assert rows(engine.changes(q)) == [(1, 4)] * 4
    assert q.counts()["input_rows"] == 4
    assert engine.metrics().count() == 2


def test_view_pull_pause_resume_drop(engine):
    engine.execute("CREATE STREAM s6 (key1 INTEGER, key2 STRING, key3 BOOLEAN);")
    add = lambda i: engine.execute(f"INSERT INTO s6 (key1, key2, key3) VALUES ({i}, 'h{i % 2}', {'TRUE' if i % 2 == 0 else 'FALSE'});")
    for i in range(3):
        add(i)
    q = engine.execute("CREATE VIEW v6 AS SELECT SUM(key1), key2, key3 FROM s6 GROUP BY key2, key3;")
    engine.wait(q)
    assert rows(engine.sql("SELECT * FROM v6 WHERE key3 = FALSE;")) == [(1, "h1", False)]
    engine.execute(f"PAUSE QUERY {q.name};")
    assert q.status is Status.PAUSED
    for i in (3, 4):
        add(i)
    engine.execute(f"RESUME QUERY {q.name};")
    engine.wait(q)
    assert rows(engine.sql("SELECT * FROM v6;")) == [(4, "h1", False), (6, "h0", True)]
    with pytest.raises(RunError):
        engine.execute("DROP STREAM s6;")
    with pytest.raises(PlanError):
        engine.execute("SELECT * FROM v6 EMIT CHANGES;")
    assert engine.sql("SHOW VIEWS;").count() == 1 and engine.sql("SHOW QUERIES;").count() == 1
    engine.execute(f"TERMINATE QUERY {q.name};")
    engine.execute("DROP VIEW v6;")
    engine.execute("DROP STREAM s6;")
    engine.execute("DROP STREAM s6 IF EXISTS;")
    assert engine.sql("SHOW STREAMS;").count() == 0


def test_stream_join_then_group(engine):
    for n in ("s1", "s2"):
        engine.execute(f"CREATE STREAM {n} (a INTEGER, b INTEGER);")
    engine.execute("INSERT INTO s1 (a, b) VALUES (1, 3);")
    engine.execute("INSERT INTO s2 (a, b) VALUES (2, 3);")
    q = engine.execute("SELECT s1.b, SUM(s1.a), SUM(s2.a) FROM s1 INNER JOIN s2 ON s1.b = s2.b WITHIN (INTERVAL 1 HOUR) GROUP BY s1.b EMIT CHANGES;")
    engine.wait(q)
    assert rows(engine.changes(q)) == [(3, 1, 2)]
    q = engine.execute("SELECT s1.a AS x, s2.a AS y FROM s1 INNER JOIN s2 ON s1.a < s2.a WITHIN (INTERVAL 1 HOUR) EMIT CHANGES;")
    engine.wait(q)
    assert rows(engine.changes(q)) == [(1, 2)]


def test_schemaless_and_raw(engine):
    engine.execute("CREATE STREAM free;")
    engine.execute("INSERT INTO free VALUES CAST('no json' AS BYTEA);")
    engine.execute("INSERT INTO free VALUES '{\"a\": 1}' :: JSONB;")
    engine.execute("INSERT INTO free (b, c) VALUES (1, 2);")
    assert rows(engine.sql("SELECT a, b, c FROM free;")) == [(1, None, None), (None, 1, 2)]
    with pytest.raises(BindError):
        engine.execute("INSERT INTO free VALUES '[1]' :: JSONB;")
    with pytest.raises(PlanError):
        engine.execute("INSERT INTO free SELECT a FROM free;")


def test_insert_select_explain_connectors(engine):
    engine.execute("CREATE STREAM src (a INTEGER);")
    engine.execute("CREATE STREAM dst (a INTEGER);")
    engine.execute("INSERT INTO src (a) VALUES (7);")
    engine.wait(engine.execute("INSERT INTO dst SELECT a FROM src;"))
    assert rows(engine.sql("SELECT a FROM dst;")) == [(7,)]
    assert rows(engine.read_range("dst", key={"a": 7}).select("a")) == [(7,)]
    text = "\n".join(r[0] for r in engine.sql("EXPLAIN SELECT a, COUNT(*) FROM src WHERE a > 1 GROUP BY a;").collect())
    assert "Reduce" in text and "Filter(a > 1)" in text and "StreamScan(src)" in text
    engine.execute("CREATE SINK CONNECTOR out TO blackhole WITH (stream = 'dst');")
    engine.drain("out")
    engine.execute("PAUSE CONNECTOR out;")
    with pytest.raises(RunError):
        engine.drain("out")
    engine.execute("CREATE SOURCE CONNECTOR db FROM kafka WITH (servers = 'h:1', topic = 't', stream = 'k');")
    assert engine.catalog.get("CONNECTOR", "db").options["subscribe"] == "t"
    with pytest.raises(BindError):
        engine.execute("CREATE SINK CONNECTOR x TO nowhere WITH (stream = 'dst');")


def test_changelog(spark):
    edges = lambda *p: spark.createDataFrame([tuple(x) for x in p], "src string, dst string")
    first, second = changelog.reachability(edges("ab", "bc", "bd", "ca")), changelog.reachability(edges("ab", "bd", "ca"))
    assert {a + b for a, b in rows(first)} == {"aa", "ab", "ac", "ad", "ba", "bb", "bc", "bd", "ca", "cb", "cc", "cd"}
    step = changelog.difference(changelog.changes(second), changelog.changes(first))
    assert {(r.src + r.dst, r._diff) for r in step.collect()} == {(x, -1) for x in ("bc", "ba", "ac", "aa", "cc", "bb")}
    log = changelog.changes(edges("ab", "ab")).unionByName(changelog.changes(edges("ab"), -1))
    assert changelog.rows(log).count() == 1


def test_fluent(spark, clicks):
    s = stream(clicks, "ts")
    assert rows(s.filter(F.col("v") > 0).group_by("k").count().df) == [("a", 3)]
    assert rows(s.group_by("k").time_windowed_by(Tumbling("10 seconds")).count().df.select("count")) == [(1,), (1,), (2,)]
    assert s.group_by("k").time_windowed_by(Hopping("10 seconds", "5 seconds")).count().df.count() == 6
    assert rows(s.group_by("k").session_windowed_by(Session("10 seconds")).agg(n=F.count("*")).df.select("n", "window_end")) == [(1, at(25)), (3, at(10))]
    assert rows(s.group_by("k").aggregate(0, lambda a, r: a * 2 + r.v, lambda a: a, "long").df) == [("a", ((0 * 2 + 9) * 2 + 10) * 2 + 25)]
    other = stream(clicks.select(F.col("k").alias("k2"), F.col("ts").alias("ts2"), F.col("v").alias("v2")), "ts2")
    assert s.join_stream(other, JoinWindows(1000, 1000), F.col("k") == F.col("k2")).df.count() == 6
    assert rows(s.table("k").df) == [("a", at(25), 25)]
    assert s.join_table(s.table("k"), ["k"]).df.count() == 4
    assert s.map_batches(lambda it: (p[p.v > 9] for p in it), clicks.schema.simpleString()[7:-1].replace(":", " ")).df.count() == 2
    s.to("noop")


def test_time_of_day(spark):
    casts = "'10:41:03' :: TIME :: STRING AS a, CAST(TIME '01:02:03.456' AS STRING) AS b, '14:61:59' :: TIME AS c, TIME '00:00:05' :: TIMESTAMP AS d, CAST(TIMESTAMP '2023-06-30T12:30:45+02:00' AS TIME) AS e"
    a, b, c, d, e = one(spark, f"SELECT {casts} FROM s;")
    assert (a, b, c, d.second, e) == ("10:41:03", "01:02:03.456", None, 5, ((10 * 60 + 30) * 60 + 45) * 1_000_000)
    assert one(spark, "SELECT IS_TIME(TIME '10:00:00') AS f, IS_INT(TIME '10:00:00') AS g, IS_TIME('10:00:00' :: TIME) AS i, TO_STR(TIME '10:00:00') AS j FROM s;") == (True, False, True, "10:00:00")
    a, b, c = one(spark, "SELECT 'PT1H30M' :: INTERVAL AS a, 'P1DT2.5S' :: INTERVAL AS b, 'soon' :: INTERVAL AS c FROM s;")
    assert (a.total_seconds(), b.total_seconds(), c) == (5400, 86402.5, None)
    assert one(spark, "SELECT {1.5, -1.5} :: INTEGER[] AS h FROM s;") == ([1, -2],)


def test_declared_time(engine):
    engine.execute("CREATE STREAM s (t TIME, n INTEGER);")
    engine.execute("INSERT INTO s (t, n) VALUES (TIME '01:00:00', 1);")
    r = engine.sql("SELECT IS_TIME(t) AS a, IS_INT(t) AS b, IS_INT(n) AS c, TO_STR(t) AS d FROM s;").first()
    assert tuple(r) == (True, False, True, "01:00:00")


def test_named_engine_recovers(spark, tmp_path):
    def opened():
        return Engine(spark, f"file://{tmp_path}", name="main")

    e = opened()
    e.execute("CREATE STREAM s (a INTEGER, b INTEGER);")
    e.execute("INSERT INTO s (a, b) VALUES (1, 7);")
    e.wait(e.execute("CREATE VIEW v AS SELECT b, SUM(a) AS n FROM s GROUP BY b;"))
    q = e.execute("CREATE STREAM t AS SELECT a FROM s;")
    e.wait(q)
    e.execute(f"TERMINATE QUERY {q.name};")
    e.execute("CREATE SINK CONNECTOR c TO blackhole WITH (stream = 's');")
    later = opened()  # the first one is lost
    later.execute("INSERT INTO s (a, b) VALUES (2, 7);")
    assert tuple(later.sql("SELECT b, n FROM v;").first()) == (7, 1)
    found = later.recover()
    assert [x.kind for x in found] == ["view"]  # what was terminated stays so
    later.wait(found[0])
    assert tuple(later.sql("SELECT b, n FROM v;").first()) == (7, 3)
    assert [r.status for r in later.sql("SHOW CONNECTORS;").collect()] == ["RUNNING"]
    later.execute("DROP CONNECTOR c;")
    assert opened().sql("SHOW CONNECTORS;").count() == 0 and opened().sql("SHOW STREAMS;").count() == 2


def test_connectors_copy(engine, spark, tmp_path):
    engine.execute("CREATE STREAM s (a INTEGER);")
    drop = lambda n, x: spark.createDataFrame([(x,)], "a long").coalesce(1).write.json(str(tmp_path / f"in/{n}"))
    drop("one", 1)
    engine.execute(f"CREATE SOURCE CONNECTOR c FROM file WITH (stream = 's', path = '{tmp_path}/in', recursiveFileLookup = 'true');")
    engine.drain("c")
    engine.execute(f"CREATE SINK CONNECTOR out TO file WITH (stream = 's', path = '{tmp_path}/out');")
    engine.drain("out")
    engine.execute("PAUSE CONNECTOR c;")
    drop("two", 2)
    assert rows(engine.sql("SELECT a FROM s;")) == [(1,)]
    engine.execute("RESUME CONNECTOR c;")
    engine.drain("c")
    engine.drain("out")
    engine.drain("out")  # nothing twice
    assert sorted(r.a for r in spark.read.json(str(tmp_path / "out")).collect()) == [1, 2]
    engine.alter_connector("out", path=f"{tmp_path}/other")
    engine.execute("INSERT INTO s (a) VALUES (3);")
    engine.drain("out")
    assert [r.a for r in spark.read.json(str(tmp_path / "other")).collect()] == [3]
    engine.execute("CREATE SINK CONNECTOR lost TO elasticsearch WITH (stream = 's');")
    with pytest.raises(Exception):  # noqa: B017  the package isn't there
        engine.drain("lost")
    engine.execute("DROP CONNECTOR lost;")
