"""Plans do costly steps once, and results hold for keys and orders that small tables do not have."""

from __future__ import annotations

from functools import reduce

import duckdb
import pytest
from pyspark.sql import functions as F

from rankfield.functions import freetext as X
from rankfield.operators import analysis as A
from rankfield.operators import inference as I
from rankfield.operators import learning as L
from rankfield.operators import ranking as R
from rankfield.operators import walkforward as W
from rankfield.plans import ORACLE_SQL, QUERIES
from rankfield.plans.inference import sources


def plan(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_example_scores_at_the_threshold(spark):
    """A mean of exactly the threshold stays, in whatever order its parts are added."""
    values = [0.07, 0.1, 0.09, 0.05, 0.04, 0.01, 0.06, 0.0, 0.03, 0.08, 0.02]
    orders = [(n, v) for n in range(40) for v in values[n % 11 :] + values[: n % 11]]
    rows = spark.createDataFrame(orders, "k int, v double").coalesce(1)
    scores = A.example_scores(rows, "k", "v")
    assert A.without_low_performers(scores, 0.05).count() == 40
    assert {r["average"] for r in scores.collect()} == {0.05}


def test_example_scores_add_in_the_order_of_rows(spark):
    """The same values in another order have another sum of doubles; whatever the partitions, the given order decides."""
    values = [0.07, 0.1, 0.09, 0.05, 0.04, 0.01, 0.06, 0.0, 0.03, 0.08, 0.02]
    orders = [(n, i, v) for n in range(11) for i, v in enumerate(values[n:] + values[:n])]
    rows = spark.createDataFrame(orders, "k int, row int, v double").repartition(7, "row")
    found = {r["k"]: r["average"] for r in A.example_scores(rows, "k", "v", "row").collect()}
    assert found == {n: reduce(float.__add__, values[n:] + values[:n], 0.0) / 11 for n in range(11)}
    assert len(set(found.values())) > 1


def test_example_scores_are_those_of_sql(spark):
    """At sf0.01, where exact means keep one example that SQL drops or drop one that it keeps."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("CREATE VIEW lineitem AS SELECT * FROM read_parquet('/root/testdata/sf0.01/lineitem.parquet')")
    want = con.execute(f"SELECT id, kept FROM ({ORACLE_SQL['example_scores']})").fetchall()
    found = QUERIES["example_scores"](spark, "/root/testdata/sf0.01").select("id", "kept").collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_result_shapes_of_long_ids(spark, data, tmp_path):
    """Identifiers of more than six digits are cut as in every other document."""
    con = duckdb.connect()
    con.execute(f"copy (select * replace (l_partkey + 1234500 as l_partkey) from '{data}/lineitem.parquet') to '{tmp_path}/lineitem.parquet'")
    con.execute(f"copy (from '{data}/orders.parquet') to '{tmp_path}/orders.parquet'")
    for name in ("lineitem", "orders"):
        con.execute(f"create view {name} as from '{tmp_path}/{name}.parquet'")
    columns = "race_id, ord, number, hr_name"
    want = con.execute(f"select {columns} from ({ORACLE_SQL['result_shapes']})").fetchall()
    found = QUERIES["result_shapes"](spark, str(tmp_path)).select(*columns.split(", ")).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found)


@pytest.mark.parametrize("name", ["typed_details", "projected_results", "detail_rows", "collected_results", "matching_items"])
def test_envelopes_are_parsed_once(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    assert text.count("from_json") == 1 and text.count("get_json_object") == 1


def test_leaked_fields_read_documents_once(spark, data):
    assert plan(QUERIES["leaked_result_fields"](spark, data)).count("Relation [") == 2  # lines and orders


def test_braces_are_balanced_once_a_text(spark):
    rows = spark.range(1).select(F.concat(F.lit("{"), F.col("id").cast("string")).alias("t"))
    assert plan(rows.select(X.any_object(F.col("t")))).count("aggregate(") <= 4


VOTED = "race_id long, race_date date, fallback array<int>, combo array<int>, score double, support_share double, support long, overlap int, is_fallback boolean, exact boolean"


def test_overlap_parts_read_candidates_once(spark):
    parts = W.overlap_parts(spark.createDataFrame([], VOTED))
    assert plan(parts).count("LogicalRDD") == 1


def test_overlap_probe_reads_events_once(spark, data):
    """One pass over the ranked events for all groups and settings, not one a group with rows for votes and settings."""
    text = plan(QUERIES["overlap_probe"](spark, data))
    assert sum("Relation [" in line and "lists#" in line for line in text.splitlines()) == 1


def test_sources_of_dates_are_in_no_shuffle(spark):
    """Events are shuffled by event before the sources of their date join them, and not again."""
    events = spark.createDataFrame([], "race_id long, race_date date, size int, lists array<array<int>>, answer array<int>")
    sources = spark.createDataFrame([], "race_date date, sources array<struct<rank:int,list:int,pattern:array<int>,rate:long,weight:long>>")
    rows = W.candidate_rows(events, sources, spark.createDataFrame([], "race_id long, fallback array<int>"))
    text = rows._jdf.queryExecution().sparkPlan().toString() + rows._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in text and "hashpartitioning(voted_on" not in text and text.count("Exchange hashpartitioning") == 2


def test_model_rows_are_made_once(spark, data):
    """Fit and predictions read staged rows, not the tables again."""
    assert "l_orderkey" not in plan(QUERIES["model_top3"](spark, data))


def steps(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_feature_rows_sort_only_lines(spark, data):
    """Rows are shuffled and sorted once, by event, while they are as narrow as lines."""
    text = steps(QUERIES["feature_rows"](spark, data))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("+- Sort [") == 1


@pytest.mark.parametrize("name", ["percentile_ranks", "overlap_selection"])
def test_events_are_gathered_by_one_sort(spark, data, name):
    text = steps(QUERIES[name](spark, data))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("+- Sort [") == 1 and "Aggregate(" not in text


@pytest.mark.parametrize("name", ["final_picks", "supplements"])
def test_sources_of_events_are_gathered_once(spark, data, name):
    text = steps(QUERIES[name](spark, data))
    assert text.count("FileScan") == 3 and "Aggregate(" not in text


def test_picks_from_rows_are_those_of_events(spark, data):
    """Scores and rankings given as rows meet in one shuffle and give what the gathered events give."""
    held = sources(spark, data).filter("race_id % 3 = 0")
    scores, ranking = held.selectExpr("race_id", "inline(scores)"), held.selectExpr("race_id", "inline(ranking)")
    picks = I.picks_of_events(held)
    shown = lambda rows: sorted(map(str, rows.collect()))
    found = I.final_picks(held, scores, ranking)
    assert shown(found) == shown(picks.drop("scores", "ranking"))
    assert shown(I.supplements(scores, ranking, found)) == shown(I.supplements_of_events(picks))


@pytest.mark.parametrize("name", ["weighted_borda", "voter_agreement"])
def test_voters_are_ranked_by_one_sort(spark, data, name):
    text = steps(QUERIES[name](spark, data))
    sides = 2 if name == "voter_agreement" else 1  # pairs of voters are a join
    assert text.count("+- Sort [") <= 1 + 2 * (sides - 1) and text.count("Exchange hashpartitioning") == sides


def test_votes_of_groups_are_those_of_rows(spark):
    rows = spark.createDataFrame([("a", 1, [5, 6, 7, 8]), ("a", 2, [6, 5]), ("a", 3, [7]), ("b", 1, [])], "g string, v int, items array<int>")
    weight = lambda v: F.when(v == 1, 0.5).otherwise(0.25)
    want = {(r["g"], r["item"]): (round(r["votes"], 9), tuple(r["first_seen"])) for r in R.borda(rows, "g", "v", "items", weight(F.col("v"))).collect()}
    held = rows.groupBy("g").agg(F.collect_list(F.struct("v", "items")).alias("lists"))
    found = R.borda_of_groups(held, "g", "lists", "v", "items", weight).collect()
    assert {(r["g"], k["item"]): (-k["s"], tuple(k["first_seen"])) for r in found for k in r["ks"]} == want
    assert {r["g"]: [k["item"] for k in r["ks"]] for r in found} == {"a": [5, 6, 7], "b": []}


def test_rule_order_reads_numbers_as_numbers(spark, data):
    """Numbers are not cast to text and back, and no feature is made that no rule reads."""
    text = plan(QUERIES["rule_order"](spark, data))
    assert "transform(sequence(0, 30" not in text and steps(QUERIES["rule_order"](spark, data)).count("Exchange hashpartitioning") == 1


def test_resampled_rows_are_made_once(spark):
    """Whatever makes the rows runs once, for the mean and the replicates together."""
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(50).selectExpr("id", "double(id) AS v").mapInArrow(seen, "id long, v double")
    assert L.poisson_bootstrap(rows, F.col("v"), ["id"], rounds=100).first()["mean"] == 24.5
    assert made.value == 50


def test_past_counts_are_those_of_pairs(spark, data):
    """Counts by either key equal counted pairs, also where events match by both keys, on one day, and with missing keys."""
    entries = spark.range(400).selectExpr("id % 90 AS race_id", "CASE WHEN id % 11 <> 0 THEN id * 7 % 9 END AS hr_no", "CASE WHEN id % 13 <> 0 THEN id * 5 % 8 END AS entry_no")
    rows = entries.withColumn("race_date", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("race_id") % 30).cast("int")))
    targets = rows.select("hr_no", "entry_no", "race_date").distinct().withColumn("id", F.concat_ws("-", F.coalesce("hr_no", F.lit(-1)), F.coalesce("entry_no", F.lit(-1)), "race_date"))
    want = A.past_of_either_key(targets, rows).groupBy("id").agg(F.count(F.lit(1)).alias("races"))
    found = A.past_counts_of_either_key(targets, rows)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() > 100
    text = plan(QUERIES["past_of_either_key"](spark, data))
    assert "race_date#" in text and " < " not in text  # no join by a range of dates


def test_audited_fields_stay_in_their_records(spark, data):
    """Lines and orders are read once, and only their keys may be shuffled: fields are in no exchange by record."""
    text = steps(QUERIES["storage_audit"](spark, data))
    assert text.count("FileScan") == 2 and "hashpartitioning(record" not in text and text.count("Join") <= 4


SOURCED = [("a", "x", "hold"), ("a", "x", "keep"), ("b", "y", None), (None, "x", "no"), ("a", None, "no")]
PATHED = [("h[].x", "snapshot_only"), ("h[7].y", "stored_only"), ("h[].y", "zzz"), (None, "no"), ("h[].z", None)]


@pytest.mark.parametrize("pathed", [PATHED, []])
def test_tags_of_records_are_those_of_rows(spark, pathed):
    """Tags by record equal tags by row, also with repeated rules, rules without a tag, missing keys and no rules at all."""
    paths = [("x", "h[1].x"), ("y", "h[22].y"), ("z", "h[].z"), (None, None), ("x", None), ("w", "h.x")]
    held = spark.createDataFrame([(i, api, paths[i % 3 :]) for i, api in enumerate(["a", "b", "c", None, "a", "b"])] + [(9, "a", []), (10, "b", None)], "record int, api string, fields array<struct<field:string,path:string>>")
    rules = spark.createDataFrame(SOURCED, "api string, field string, tag string"), spark.createDataFrame(pathed, "path string, tag string")
    rows = held.select("record", "api", F.inline("fields"))
    want = I.field_tags(rows, *rules).select("record", "field", "tag").collect()
    found = I.field_tags_of_records(held, *rules)
    assert sorted(map(str, found.select("record", F.inline("tags")).collect())) == sorted(map(str, want)) and len(want) > 20
    assert found.count() == 8


def test_issues_of_records_are_those_of_rows(spark):
    """Stored rows keep their number, of several tags the smallest counts, and what has no key meets no tag and no rule."""
    stored = [("r", "x"), ("r", "x"), ("r", "y"), ("r", "z"), ("r", None), ("s", "x"), ("s", "w"), ("t", "y"), (None, "x"), ("s", "v")]
    tags = [("r", "x", "snapshot_only"), ("r", "x", "hold"), ("r", "y", "keep?"), ("r", None, "hold"), (None, "x", "hold"), ("s", "x", "metadata_only"), ("s", "w", None), ("u", "x", "hold")]
    rules = spark.createDataFrame([("z", "me", "why"), ("v", " ", "why"), ("x", "me", None), ("x", "me", "why"), (None, None, None)], "field string, owner string, reason string")
    tag, ruled, blank = {("r", "x"): "hold", ("r", "y"): "keep?", ("s", "x"): "metadata_only"}, {"z", "v", "x"}, {"v", "x"}
    want = [(r, f, "untagged") for r, f in stored if (r, f) not in tag and f not in ruled]
    want += [(r, f, "not to be stored") for r, f in stored if tag.get((r, f)) in ("hold", "keep?")] + [(r, f, "rule without owner or reason") for r, f in stored if f in blank]
    rows = spark.createDataFrame(stored, "record string, field string"), spark.createDataFrame(tags, "record string, field string, tag string")
    found = I.storage_issues(*rows, rules)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found.collect())
    whole = spark.createDataFrame([("r", ["x", "x", "y", None], [("x", "hold"), ("y", "keep?")]), ("s", ["x", "w", "v"], [("x", "metadata_only")]), ("t", ["y"], None), ("n", None, [])], "record string, stored array<string>, tags array<struct<field:string,tag:string>>")
    names = {"r", "s", "t"}
    assert sorted(str(tuple(r)) for r in I.storage_issues_of_records(whole, rules).collect()) == sorted(str(w) for w in want if w[0] in names and w[1] != "z")
