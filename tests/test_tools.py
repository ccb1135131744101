import io
import time

import pytest
from pyspark.sql import functions as F

from tidewater import shell
from tidewater.errors import ParseError
from tidewater.sources.metrics import admin
from tidewater.streaming.dsl import stream
from tidewater.streaming import subscription
from tidewater.streaming.engine import Engine
from tidewater.streaming.subscription import Subscription


def test_subscription(spark, monkeypatch):
    e = Engine(spark)
    e.execute("CREATE STREAM s (a INTEGER);")
    e.execute("INSERT INTO s (a) VALUES (1);")
    before = time.time()
    sub = Subscription(e, "one", "s", timeout=2)
    ids, df = sub.fetch()
    assert [r.a for r in df.collect()] == [1] and sub.fetch() == ([], None)
    again = Subscription(e, "one", "s", timeout=1000)
    if time.time() - before < 1.5:
        assert again.fetch() == ([], None)  # it is out
    time.sleep(2.1)  # the first consumer is lost
    ids, df = again.fetch()
    assert len(ids) == 1
    again.ack(ids)
    assert again._names("leases") == [] and again._names("acked") == ids
    e.execute("INSERT INTO s (a) VALUES (2);")
    ids, df = Subscription(e, "one", "s").fetch()
    assert [r.a for r in df.collect()] == [2]
    monkeypatch.setattr(subscription, "SKEW", -1000)
    again.ack(ids)
    assert again._names("acked") == [] and len(again._names("low")) == 1  # folded
    assert again.fetch() == ([], None)
    e.execute("INSERT INTO s (a) VALUES (3);")
    assert [r.a for r in again.fetch()[1].collect()] == [3]
    assert Subscription(e, "late", "s", from_latest=True).fetch() == ([], None)
    assert {r["name"]: r["throughput_15min"] > 0 for r in admin(e, "SELECT * FROM subscription_throughput").collect()} == {"one": True}


def test_shell_and_admin(spark):
    e, out = Engine(spark), io.StringIO()
    shell.run(e, ["CREATE STREAM s\n", "(a INTEGER);\n", "INSERT INTO s (a) VALUES (5);\n", "SELECT a FROM s;\n", "SELECT b FROM s;\n", "nonsense;\n", ":q\n", "SELECT a FROM s;\n"], out)
    assert "a\n5\n" in out.getvalue() and "BindError" in out.getvalue() and "ParseError" in out.getvalue()
    e.wait(e.execute("CREATE STREAM t AS SELECT a FROM s;"))
    assert admin(e, "show tables;").count() == 7
    assert [r[0] for r in admin(e, "describe streams").collect()] == ["name", "replication_property"]
    rows = admin(e, "SELECT streams.name, sum(total) AS n FROM streams LEFT JOIN append_totals ON streams.name = append_totals.name GROUP BY streams.name ORDER BY streams.name LIMIT 5").collect()
    assert [tuple(r) for r in rows] == [("s", None), ("t", 1)]
    with pytest.raises(ParseError):
        admin(e, "drop table streams")


def test_fold_over_a_stream(spark, tmp_path):
    for i, v in enumerate((1, 2, 3)):
        spark.createDataFrame([("a", v), ("b", 10 * v)], "k string, v int").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    df = spark.readStream.schema("k string, v int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = stream(df).group_by("k").aggregate(0, lambda acc, r: acc + int(r.v), lambda acc: acc, "long", "total").df
    q = out.writeStream.outputMode("update").format("memory").queryName("folded").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.k, r.total) for r in spark.table("folded").groupBy("k").agg(F.max("total").alias("total")).collect()} == {("a", 6), ("b", 60)}
