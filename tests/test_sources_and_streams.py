"""Documents, policies, archives and streams on literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfield.operators import policy
from rankfield.sources import documents as D
from rankfield.streaming import events as S


def test_items_of_envelopes(spark):
    one = '{"response":{"header":{"resultCode":"00"},"body":{"items":{"item":{"no":"1","name":"a","odds":"2.5"}}}}}'
    many = '{"response":{"body":{"items":{"item":[{"no":"1","name":"a"},{"no":"2","name":"b"}]}}}}'
    xml = "<response><body><items><item><no>07</no><name>c</name></item><item><no>8</no><name>d</name></item></items></body></response>"
    rows = spark.createDataFrame([(0, one), (1, many), (2, xml), (3, "{}"), (4, None), (5, '{"response":{"header":{"resultCode":"99"}}}')], "id int, p string")
    found = rows.select("id", D.items(F.col("p")).alias("i"), D.successful(F.col("p")).alias("ok")).orderBy("id").collect()
    assert [[i["no"] for i in r["i"]] for r in found] == [["1"], ["1", "2"], ["07", "8"], [], [], []]
    assert [bool(r["ok"]) for r in found] == [True, True, False, False, False, False]


def test_result_shapes(spark):
    docs = ["[3,1,2]", '{"top3":[4,5,6]}', '{"horses":[{"chulNo":9,"ord":2},{"chulNo":8,"ord":1},{"chulNo":7,"ord":0}]}', '{"result":{"top3":[1,2,3]}}', '{"result":[5,6]}', "", None, "x"]
    rows = spark.createDataFrame(list(enumerate(docs)), "id int, d string").select("id", D.result_top3(F.col("d")).alias("t")).orderBy("id").collect()
    assert [r["t"] for r in rows] == [[3, 1, 2], [4, 5, 6], [8, 9], [1, 2, 3], [5, 6], [], [], []]


def test_charsets_and_scalars(spark):
    rows = spark.createDataFrame([("한글".encode("euc-kr"),), ("é".encode(),), (None,)], "b binary")
    assert [r[0] for r in rows.select(D.decoded("b")).collect()] == ["한글", "é", None]
    found = spark.createDataFrame([("007",), ("12",), ("1.5",), (" ",), ("x",)], "s string").select(D.scalar(F.col("s")).alias("v")).collect()
    assert [(r["v"]["whole"], r["v"]["fraction"], r["v"]["word"]) for r in found] == [(None, None, "007"), (12, None, None), (None, 1.5, None), (None, None, None), (None, None, "x")]


def test_leaf_paths(spark):
    rows = spark.createDataFrame([(1, '{"a":1,"b":{"c":[{"d":2},{"d":3,"e":null}]}}'), (2, "7"), (3, "bad")], "id int, doc string")
    found = {(r["id"], r["path"]) for r in D.leaf_paths(rows, "id", "doc").collect() if r["id"] < 3}
    assert found == {(1, "a"), (1, "b.c[].d"), (1, "b.c[].e"), (2, "")}


def test_policy(spark):
    rows = spark.createDataFrame([(1, ([(5, 9.5, "x")], "note"))], "id int, doc struct<horses:array<struct<no:int,odds:double,rank_final:string>>,memo:string>")
    rules = [policy.Rule("doc.horses[].odds", "HOLD"), policy.Rule("doc.memo", "META_ONLY"), policy.Rule("doc.*", "ALLOW")]
    kept = policy.filter_columns(rows, rules, "^rank_")
    assert kept.schema.simpleString() == "struct<id:int,doc:struct<horses:array<struct<no:int,rank_final:string>>>>"
    kept = policy.filter_columns(rows, rules[:2], "^rank_", "hold")
    assert kept.schema.simpleString() == "struct<id:int,doc:struct<horses:array<struct<no:int,odds:double>>>>"
    report = {r["flag"]: r["fields"] for r in policy.policy_report(rows, rules[:2], "^rank_").collect()}
    assert report["BLOCK"] == ["doc.horses[].rank_final"] and report["HOLD"] == ["doc.horses[].odds"]
    contract = spark.createDataFrame([("a", "ALLOW"), ("b", "ALLOW"), ("b", "ALLOW"), ("c", "BLOCK")], "feature string, flag string")
    bad = policy.ownership_violations(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "feature string"), contract)
    assert {(r["feature"], r["owners"]) for r in bad.collect()} == {("b", 2), ("c", 0), ("d", 0)}


def test_archive(spark, data, tmp_path):
    orders = spark.read.parquet(f"{data}/orders.parquet").withColumn("d", F.to_date("o_orderdate"))
    D.archive(orders, "d", F.lit("1996-01-01").cast("date"), str(tmp_path / "old"), ["d", "o_orderkey"])
    back = spark.read.option("header", True).csv(str(tmp_path / "old"))
    assert back.count() == orders.filter("d < '1996-01-01'").count() and any(p.name.endswith(".csv.gz") for p in (tmp_path / "old").iterdir())


def run(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return stream.sparkSession.table(name)


def feed(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 400).parquet(str(tmp_path / "in"))
    return events.withColumn("ts", F.col("ts").cast("timestamp")), S.read_events(spark, str(tmp_path / "in"), events.schema)


def test_streams_equal_batches(spark, data, tmp_path):
    batch, stream = feed(spark, data, tmp_path)
    flat = lambda df, w: df.select(F.col(f"{w}.start"), F.col(f"{w}.end"), *[c for c in df.columns if c not in (w, "total")])
    for n, (make, w) in enumerate(
        [
            (lambda e: S.tumbling(e, ["event_type"], "1 day", "60 days"), "window"),
            (lambda e: S.sliding(e, ["event_type"], "2 days", "1 day", "60 days"), "window"),
            (lambda e: S.sessions(e, "user_id", "1 day", "60 days"), "session_window"),
        ]
    ):
        mode = "complete"
        got = flat(run(make(stream), f"stream_{n}", mode), w)
        want = flat(make(batch), w)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count()


def test_latest_and_cutoff_streams(spark, data, tmp_path):
    batch, stream = feed(spark, data, tmp_path)
    changes = run(S.latest_by_key(stream, "user_id", "60 days"), "latest", "update")
    got = {r["key"]: r["e"] for r in changes.groupBy("key").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e")).collect()}
    want = {r["user_id"]: r["e"] for r in batch.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e")).collect()}
    assert got == want
    cutoffs = batch.groupBy("user_id").agg(F.min("ts").alias("cutoff"))
    assert run(S.before_cutoff(stream, cutoffs, "user_id"), "early", "append").count() == S.before_cutoff(batch, cutoffs, "user_id").count()
    assert run(S.without_repeats(stream, "event_id", "60 days"), "once", "append").count() == batch.select("event_id").distinct().count()
