"""Contracts and digests read from files; shapes that the registered queries do not have."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from rankfield.operators import analysis, inference, manifests, records, responses


def test_overlay_contract(spark, tmp_path):
    path = tmp_path / "contract.csv"
    path.write_text("feature_name,release_bucket,model_feature_status\na,RELEASE,current_model_input\nb,AUDIT_ONLY,audit_only\nc,RELEASE,planned\n")
    contract = records.overlay_contract(spark, str(path))
    names = lambda rows: sorted(r["feature_name"] for r in rows.collect())
    assert names(records.overlay_names(contract)) == ["a", "c"] and names(records.overlay_names(contract, current_only=True)) == ["a"]
    assert names(records.overlay_violations(spark.createDataFrame([("a",), ("b",), ("x",)], "feature_name string"), contract)) == ["b"]
    path.write_text(path.read_text() + "a,RELEASE,planned\n")
    with pytest.raises(Exception, match="duplicate feature: a"):
        records.overlay_contract(spark, str(path)).collect()


def test_file_digests(spark, tmp_path):
    for name, data in (("a.bin", b"one"), ("b.bin", b"\0" * 5)):
        (tmp_path / name).write_bytes(data)
    found = {r["path"].rsplit("/", 1)[-1]: (r["byte_size"], r["sha256"]) for r in records.file_digests(spark, str(tmp_path)).collect()}
    assert found == {"a.bin": (3, hashlib.sha256(b"one").hexdigest()), "b.bin": (5, hashlib.sha256(b"\0" * 5).hexdigest())}


def test_envelopes_without_items(spark):
    rows = spark.createDataFrame([(1, "{}"), (2, ""), (3, None), (4, '{"response":{"body":{}}}'), (5, '{"response":{"header":{},"body":{"items":{"item":{"chulNo":3,"rcNo":"x","meet":"광주"}}}}}')], "id int, payload string")
    p = F.col("payload")
    found = {r["id"]: r for r in rows.select("id", F.size(responses.all_items(p)).alias("n"), responses.error_message(p).alias("m"), responses.event_keys(responses.first_item(p)).alias("k"), responses.horse_info(p).alias("h")).collect()}
    assert [found[i]["n"] for i in range(1, 6)] == [0, 0, 0, 0, 1]
    assert [found[i]["m"] for i in range(1, 6)] == ["Empty API response"] * 3 + ["Failed to parse error message", "Unknown error"]
    assert tuple(found[5]["k"]) == (None, None, None) and found[1]["h"] is None and found[5]["h"]["win_rate"] == 0.0


def test_repeated_votes_and_single_voters(spark):
    votes = spark.createDataFrame([("a", 0, 1, 5, 80), ("a", 0, 2, 6, 80), ("b", 0, 1, 1, None), ("b", 1, 1, 2, 70), ("b", 0, 2, 1, None)], "race_id string, voter int, place int, item int, confidence int")
    found = {r["race_id"]: r for r in analysis.self_consistency(votes).collect()}
    assert (found["a"]["predicted"], found["a"]["score"], found["a"]["abstains"]) == ([5, 6], 1.0, False)
    assert found["b"]["predicted"] == [1, 2] and found["b"]["score"] == (2 + 1) / (2 * 2) and found["b"]["confidence"] == int((50 + 70) / 2 * 0.75)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "race_id string, number int, score double, index int, rank int")
    assert inference.final_picks(spark.createDataFrame([("x",)], "race_id string"), empty, empty).first()["predicted"] == []
    gate = manifests.release_gate(spark.createDataFrame([], "fresh boolean, odds_paths int, source_present boolean, horses int, horses_without_flag int")).first()
    assert gate["passed"] is False and gate["pass_rate"] == 0.0 and gate["null_rate"] == 0.0
