"""Edge rows of the cleaning, candidate, rate, split and evaluation operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rankfield.functions import clean as C
from rankfield.functions import rates as R
from rankfield.operators import candidates as K
from rankfield.operators import evaluation as E
from rankfield.operators import journal as N
from rankfield.operators import postprocess as G
from rankfield.operators import ranking as V
from rankfield.operators import splits as P
from rankfield.operators import store as S


def values(spark, inputs, make, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r["v"] for r in rows.select("i", make(F.col("x")).alias("v")).orderBy("i").collect()]


def test_numbers_and_identifiers(spark):
    assert values(spark, ["1.5", " 2 ", "abc", "", None, "NaN", "Infinity"], C.number) == [1.5, 2.0, None, None, None, None, None]
    assert values(spark, ["1.5", "-3", "x"], C.whole) == [1, -3, None]
    assert values(spark, ["001.0", " a ", "", ".0", None], C.identifier) == ["001", "a", None, None, None]
    assert values(spark, ["N/A", "-", "ok", "없음"], C.sentinel_to_null) == [None, None, "ok", None]
    assert values(spark, ["2024-01-05", "20240105 10", "-", "1234567"], C.date_digits) == ["20240105", None, None, None]


def test_weights(spark):
    texts = ["480", "480(+5)", "480(-41)", "-", "0()", "bad", None, "150(+3)"]
    assert values(spark, texts, C.first_digits) == [480, 480, 480, None, 0, None, None, 150]
    assert values(spark, texts, C.bounded_delta) == [None, 5.0, None, None, None, None, None, 3.0]
    missing, failed = ["weight_missing", "weight_delta_missing"], ["weight_parse_failed", "weight_delta_parse_failed"]
    assert values(spark, texts, K.weight_flags) == [["weight_delta_missing"], [], ["weight_delta_outlier"], missing, missing, failed, missing, ["weight_outlier"]]


def test_odds_and_codes(spark):
    texts = [None, "0", "-2", "301", "abc", "2.4"]
    assert values(spark, texts, lambda c: C.market_odds(c, 300.0)) == [None, None, None, None, None, 2.4]
    flags = values(spark, texts, lambda c: C.market_flags(c, "win_odds", 300.0))
    assert flags[3] == ["market_signal_missing", "popularity_unusable", "win_odds_outlier"] and flags[4][1] == "odds_parse_failed" and flags[5] == []
    assert values(spark, ["수컷", "F", "gelding", "?", " ", None], C.sex_bucket) == ["수", "암", "거", "기타", None, None]
    assert values(spark, ["930", "1430", "2460", "9", None], C.start_time) == ["0930", "1430", None, None, None]
    assert [C.POOL_CODES[k] for k in ("단승식", "TRI")] == ["WIN", "TRI"]
    assert values(spark, ["hrDetail", "rcCntT", "chulNo"], C.camel_to_snake) == ["hr_detail", "rc_cnt_t", "chul_no"]
    assert values(spark, ["hr_detail", "a_b_c", "x"], C.snake_to_camel) == ["hrDetail", "aBC", "x"]


def test_metric_values(spark):
    found = values(spark, ["0.5", "70", "70%", "1,000", "101", "-0.5", "n/a", "x", None, "nan"], C.metric_value)
    assert [f["status"] for f in found] == ["ok", "ok", "ok", "abnormal", "abnormal", "abnormal", "missing", "abnormal", "missing", "missing"]
    assert [f["normalized"] for f in found[:3]] == [0.5, 0.7, 0.7]
    assert [f["issue"] for f in found[3:6]] == ["out_of_supported_range", "out_of_supported_range", "out_of_range"]


def test_rates(spark):
    rows = spark.createDataFrame([(0, 0.5, 4, 0.2), (1, None, 4, 0.2), (2, 0.5, None, 0.2), (3, 0.5, 4, None), (4, 0.5, 0, 0.2)], "i int, y double, n int, t double")
    found = [r["v"] for r in rows.select("i", R.blend(F.col("y"), F.col("n"), F.col("t"), 3).alias("v")).orderBy("i").collect()]
    assert [None if v is None else round(v, 6) for v in found] == [round(4 / 7 * 0.5 + 3 / 7 * 0.2, 6), 0.2, 0.2, 0.5, 0.2]
    assert spark.range(1).select(R.safe_div(F.lit(1.0), F.lit(0))).first()[0] is None
    assert spark.range(1).select(R.place_rate_or_zero(F.lit(1), F.lit(None), F.lit(2), F.lit(0))).first()[0] == 0.0


def event(spark, rows):
    return spark.createDataFrame(rows, "race_id int, pos int, entry_no int, burden string, win string, official string")


def chosen(spark, rows):
    frame = event(spark, rows)
    frame = frame.withColumn("reason", K.exclusion_reason(F.col("entry_no"), F.col("official"), F.col("burden"), F.col("win"), F.lit(None)))
    return {r["pos"]: (r["reason"], r["stage"]) for r in K.select_candidates(frame, "race_id", "pos", "reason", F.col("entry_no") > 0).collect()}


def test_candidates_come_back_by_priority(spark):
    found = chosen(spark, [(1, 1, 1, "70", "2", None), (1, 2, 2, "55", "0", None), (1, 3, 3, "55", "3", None), (1, 4, 4, "55", "3", "cancelled"), (1, 5, 5, "bad", "0", None)])
    assert found == {1: ("wg_budam_outlier", "reincluded"), 2: ("zero_market_signal", "reincluded"), 3: (None, "eligible"), 4: ("cancelled", None), 5: ("wg_budam_outlier", None)}


def test_short_events(spark):
    found = chosen(spark, [(1, 1, 1, "55", "2", "withdrawn"), (1, 2, None, "55", "2", None), (1, 3, 3, "-", "", None)])
    assert found == {1: ("withdrawn", None), 2: ("invalid_entry_missing_chul_no", None), 3: (None, "eligible")}


def test_cancellation_by_name(spark):
    rows = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 2, "b")], "race_id int, pos int, entry_no int, name string")
    gone = spark.createDataFrame([(1, 1, None, "b", "excluded"), (1, 2, None, "b", "withdrawn"), (1, 3, 9, None, "cancelled")], "race_id int, pos int, entry_no int, name string, official string")
    found = K.with_cancellations(rows, gone, "race_id", ["entry_no", "name"], "official").orderBy("entry_no").collect()
    assert [r["official"] for r in found] == [None, "excluded"]


def test_metrics(spark):
    rows = spark.createDataFrame([(0, [1, 2, 3], [1, 2, 3]), (1, [4, 1, 1], [1, 2]), (2, [], [1, 2, 3]), (3, [1], [])], "i int, p array<int>, a array<int>")
    found = rows.select("i", E.set_match(F.col("p"), F.col("a")).alias("m"), E.ndcg(F.col("p"), F.col("a")).alias("g")).orderBy("i").collect()
    assert [round(r["m"], 6) for r in found] == [1.0, round(1 / 3, 6), 0.0, 0.0]
    gain, ideal = 3 / math.log2(3) + 3 / 2, 3 + 2 / math.log2(3)
    assert [round(r["g"], 6) for r in found] == [1.0, round(gain / ideal, 6), 0.0, 0.0]
    assert values(spark, [None, "abc", "0.8", "80", "1.0"], lambda c: E.probability(c.try_cast("double"))) == [0.5, 0.5, 0.8, 0.8, 1 - 1e-6]


def test_calibration_sizes(spark):
    for n in (1, 3, 25):
        rows = spark.createDataFrame([((i % 7) / 10, i % 2) for i in range(n)], "p double, y int")
        ordered = sorted((r["p"], r["y"]) for r in rows.collect())
        size = max(1, n // 10)
        want = sorted((round(sum(p for p, _ in c) / len(c), 6), round(sum(y for _, y in c) / len(c), 6)) for c in (ordered[i : i + size] for i in range(0, n, size)))
        found = sorted((round(r["mean_confidence"], 6), round(r["mean_actual"], 6)) for r in E.equal_count_bins(rows, "p", "y", 10).collect())
        assert found == want
    assert E.expected_calibration_error(rows.filter("false"), "y", "p").first()["ece"] == 0.0


def test_mcnemar_and_promotion(spark):
    rows = spark.createDataFrame([(False, True)] * 10 + [(True, False)] * 2 + [(True, True)], "a boolean, b boolean")
    found = E.mcnemar(rows, "a", "b").first()
    assert (found["b_only"], found["a_only"]) == (10, 2) and round(found["statistic"], 6) == round(49 / 12, 6) and round(found["p_value"], 4) == 0.0433
    gate = lambda strict, *f: spark.range(1).select(N.promotion_gate(strict, *[F.lit(x) for x in f])).first()[0]
    assert gate(True, True, True, False, True) and not gate(True, True, False, True, True) and gate(False, False, True, True, True) and not gate(False, True, True, False, False)


def test_splits_of_few_rows(spark):
    rows = spark.createDataFrame([(f"2024-01-{d:02d}", d) for d in range(1, 6)], "d string, k int").withColumn("d", F.to_date("d"))
    assert [r["split"] for r in P.fraction_split(rows, "d", ["k"]).orderBy("k").collect()] == ["train", "train", "dev", "dev", "test"]
    assert P.walk_forward(rows, "d", ["k"], 3).filter("fold = 3 and split = 'test'").count() == 2
    assert P.fraction_split(rows.filter("false"), "d", ["k"]).count() == 0


def test_store(spark):
    rows = spark.createDataFrame([(1, "a", None), (1, "a", "x"), (2, "b", "y"), (2, "b", "w")], "k int, a string, b string")
    assert sorted((r["k"], r["b"]) for r in S.canonical_rows(rows, ["k"]).collect()) == [(1, "x"), (2, "w")]
    assert values(spark, ["0", "", " ", "x", "2", None, "0.0"], S.truthy) == [0, 0, 0, 1, 1, 0, 0]


def test_votes_and_guards(spark):
    lists = spark.createDataFrame([(1, 1, [1, 2, 3]), (1, 2, [2, 1, 4])], "g int, v int, items array<int>")
    points = {r["item"]: r["votes"] for r in V.borda(lists, "g", "v", "items", F.lit(1)).collect()}
    assert points == {1: 5, 2: 5, 3: 1, 4: 1}
    assert V.pair_overlaps(lists, "g", "v", "items").first()["overlap"] == 2.0
    row = spark.createDataFrame([(["2", "2", "x", "+3"], [1, 2, 5])], "raw array<string>, card array<int>")
    found = row.select(G.issues(F.col("raw"), F.col("card")).alias("i"), G.guarded(F.col("raw"), F.col("card")).alias("g")).first()
    assert found["i"] == ["invalid_number", "duplicate_number", "too_few_candidates"] and found["g"] == [2, 1, 5]
