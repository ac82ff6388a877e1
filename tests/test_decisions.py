"""Input decisions by precedence against a plain version; intervals of a continuous measure; ranks in feature rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfield.operators import decisions as D
from rankfield.operators import feature_rows as X
from rankfield.operators import learning as L
from rankfield.operators import splits as P

WORDS = {
    "consumer_scope": ["train_inference", "train_inference", "train_inference", "label_only", None],
    "availability_stage": ["L-1", "L0", "L0", "L0 snapshot", "L+1", "?", None],
    "as_of_requirement": ["DIRECT_PRE_RACE", "DIRECT_PRE_RACE", "PRE_CUTOFF_SNAPSHOT", "STORED_AS_OF_SNAPSHOT", "POSTRACE_ONLY", "TIMING_UNVERIFIED", None],
    "train_inference_flag": ["ALLOW", "ALLOW", "ALLOW_SNAPSHOT_ONLY", "ALLOW_STORED_ONLY", "HOLD", "BLOCK", "LABEL_ONLY", None],
    "time_boundary_rule": [
        "VALUE_AT_OR_BEFORE_ENTRY_FINALIZED_AT", "VALUE_AT_OR_BEFORE_ENTRY_FINALIZED_AT", "SNAPSHOT_CAPTURED_AT_OR_BEFORE_ENTRY_FINALIZED_AT", "STORED_ROW_AT_OR_BEFORE_ENTRY_FINALIZED_AT",
        "MEASUREMENT_REQUIRED_BEFORE_ENTRY_USE", None,
    ],
    "generated_at_kind": ["SOURCE_PUBLICATION_TIME"] * 5 + ["POSTRACE_CONFIRMATION_TIME", "UNVERIFIED_TIME", None],
    "updated_at_kind": ["SOURCE_PUBLICATION_TIME"] * 5 + ["POSTRACE_CONFIRMATION_TIME", "UNVERIFIED_TIME", None],
    "identifier_pattern": ["horses[].x", "horses[].x", "horses[].x", " ", None],
}
TAGS = [[], ["pre_entry_allowed"], ["pre_entry_allowed"], ["hold"], ["post_entry_only", "hold"], None]


def plain_reason(row):
    tags = row["tags"] or []
    says = lambda words: any(row[c] in w for c, w in words.items())
    if says(D.BLOCKING) or "post_entry_only" in tags:
        return "block_postrace_or_leakage_signal"
    if row["consumer_scope"] != "train_inference":
        return "block_non_feature_scope"
    if says(D.REVIEWED) or "hold" in tags:
        return "review_unverified_timing_signal"
    promise = D.PROMISES.get(row["train_inference_flag"])
    if not (row["identifier_pattern"] or "").strip() or promise and not all(row[c] in w for c, w in promise.items()):
        return "review_inconsistent_allowed_contract"
    return "allow_explicit_prerace_contract" if promise and row["availability_stage"] in D.STAGES else "review_fallback_incomplete_schema"


def test_decisions_by_precedence(spark):
    rng = random.Random(1)
    rows = [{"field_path": f"f{rng.randrange(400)}", **{c: rng.choice(w) for c, w in WORDS.items()}, "tags": rng.choice(TAGS)} for _ in range(4000)]
    kind = "field_path string, " + ", ".join(f"{c} string" for c in D.COLUMNS) + ", tags array<string>"
    frame = spark.createDataFrame([tuple(r[c] for c in ("field_path", *D.COLUMNS, "tags")) for r in rows], kind)
    found = frame.select("field_path", *D.COLUMNS, "tags", D.decision().alias("d")).collect()
    seen = set()
    for r in found:
        reason = plain_reason(r)
        assert (r["d"]["reason"], r["d"]["verdict"], r["d"]["priority"]) == (reason, *D.REASONS[reason])
        seen.add(reason)
    assert seen == set(D.REASONS)
    fields = {r["field_path"]: r for r in D.decided_fields(frame).collect()}
    care = ["ALLOW", "REVIEW_REQUIRED", "BLOCK"]
    for name, r in fields.items():
        mine = [D.REASONS[plain_reason(x)][0] for x in rows if x["field_path"] == name]
        verdict = max(mine, key=care.index)
        assert (r["verdict"], r["words"]) == (verdict, sum(m != verdict for m in mine))
    assert D.decided_fields(frame.limit(0)).collect() == []


def test_interval_of_a_continuous_measure(spark):
    """The Poisson interval lies within Monte Carlo error of the exact resampling one, however rows are divided."""
    rng = np.random.default_rng(4)
    values = rng.gamma(2.0, 3.0, 3000)
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(-1, None), (-2, float("nan"))], "k long, v double")
    one, other = (L.poisson_bootstrap(frame.repartition(n), F.col("v"), ["k"], rounds=1500).first() for n in (1, 7))
    assert tuple(one) == pytest.approx(tuple(other))
    means = np.array([rng.choice(values, len(values)).mean() for _ in range(4000)])
    low, high = np.percentile(means, [2.5, 97.5])
    error = 4 * means.std() / np.sqrt(1500 * 0.025 * 0.975) * 0.17  # of a tail quantile of 1,500 replicates, generously
    assert one["mean"] == pytest.approx(values.mean()) and abs(one["low"] - low) < 5 * error and abs(one["high"] - high) < 5 * error
    assert tuple(L.poisson_bootstrap(frame.filter("k < 0"), F.col("v"), ["k"]).first()) == (0.0, 0.0, 0.0)


def test_poisson_weights(spark):
    steps = L._poisson_steps()
    assert steps[0] == pytest.approx(np.exp(-1)) and steps[-1] == pytest.approx(1.0) and (np.diff(steps) >= 0).all()
    frame = spark.range(2000).select(F.col("id"), F.lit(1.0).alias("v"))
    found = frame.select(F.xxhash64("id").alias("k"), "v").mapInArrow(L._replicate_sums(300, 1), "replicate int, n long, total double").groupBy("replicate").agg(F.sum("n").alias("n"), F.sum("total").alias("t")).collect()
    n = np.array([r["n"] for r in found])
    assert all(r["n"] == r["t"] for r in found) and abs(n.mean() - 2000) < 5 * (2000 / 300) ** 0.5 and 0.7 < n.std() / 2000**0.5 < 1.3


def test_ranks_of_feature_rows(spark):
    """Dense ranks with ties, missing values and single entries, against a plain version; answers from a column or a table."""
    rng = random.Random(3)
    counts = "struct<rc_t:int,rc_y:int,o1_t:int,o1_y:int,o2_t:int,o2_y:int,o3_t:int,o3_y:int>"
    computed = ", ".join(f"{c}:double" for c in X.COMPUTED) + ", " + ", ".join(f"{c}:boolean" for c in X.FLAGS) + ", rest_risk:string"
    texts = ["budam", "track", "weather", "sex", "class_rank", "wg_budam_bigo", "wg_hr"]
    kind = f"race_id string, race_date string, chul_no int, hr_no int, field_size int, rating double, wg_budam double, {', '.join(f'{t} string' for t in texts)}, dist int, age int, weight_delta int, hr {counts}, jk {counts}, tr {counts}, computed struct<{computed}>, place int"
    rows = []
    for race in range(40):
        n = rng.choice([1, 2, 3, 6])
        places = rng.sample(range(1, n + 1), n)
        for i in range(n):
            block = lambda: None if rng.random() < 0.2 else tuple(rng.randrange(9) for _ in range(8))
            rating = rng.choice([None, float("nan"), 1.0, 2.0, 3.0])
            rows.append((f"r{race}", "2024-01-01", i + 1, i, n, rating, rng.choice([None, 50.0, 51.0]), *[None] * 7, 1200, 3, None, block(), block(), block(), (*[None] * len(X.COMPUTED), *[None] * len(X.FLAGS), None), places[i]))
    frame = spark.createDataFrame(rows, kind).repartition(3)
    found = X.feature_rows(frame, place="place").collect()
    whole = X.feature_rows(frame).collect()
    events = {}
    for r in whole:
        events.setdefault(r["race_id"], []).append(r)
    for mine in events.values():
        for name, source, down in X.RELATIVE:
            values = [(-999999.0 if down else 999999.0) if r[source] is None else float(r[source]) for r in mine]
            order = sorted(set(values), reverse=down)
            assert [r[name] for r in mine] == pytest.approx([0.5 if len(order) == 1 else order.index(v) / (len(order) - 1) for v in values])
    places = {(r[0], r[2]): r[-1] for r in rows}
    assert {(r["race_id"], r["chulNo"]): r["target"] for r in found} == {k: int(p <= 3) for k, p in places.items() if sum(k[0] == q for q, _ in places) >= 3}
    answers = frame.filter("place <= 3").groupBy("race_id").agg(F.collect_list("chul_no").alias("top3"))
    assert sorted(map(str, X.feature_rows(frame, answers).select(*sorted(found[0].asDict())).collect())) == sorted(str(r) for r in X.feature_rows(frame, place="place").select(*sorted(found[0].asDict())).collect())


def test_holdout_plan(spark):
    rng = random.Random(8)
    rows = [(race, f"2024-01-{1 + race % 28:02d}", rng.random() > 0.03) for race in range(400)]
    frame = spark.createDataFrame(rows, "race_id int, race_date string, included boolean").withColumn("race_date", F.to_date("race_date"))
    planned = P.holdout_plan(frame.repartition(3), "race_date", "included", [("holdout", 60), ("mini_val", 25)])
    found = {str(r["race_date"]): r["dataset"] for r in planned.collect()}
    left, want = iter([("holdout", 60), ("mini_val", 25)]), {}
    name, least, held = *next(left), 0
    for day in sorted({r[1] for r in rows}, reverse=True):  # the plain walk from the newest date
        mine = [r for r in rows if r[1] == day]
        if all(r[2] for r in mine) and name:
            want[day] = name
            held += len(mine)
            if held >= least:
                (name, least), held = next(left, (None, 0)), 0
    assert found == want and set(want.values()) == {"holdout", "mini_val"}
    one, other = ({r["dataset"]: tuple(r) for r in P.plan_manifest(P.holdout_plan(frame.repartition(n), "race_date", "included", [("holdout", 60), ("mini_val", 25)]), "race_id", "race_date").collect()} for n in (1, 5))
    assert one == other and one["holdout"][1] >= 60 and one["mini_val"][4] < one["holdout"][3]  # ends before the holdout starts
    with pytest.raises(Exception, match="too few rows of complete dates for mini_val"):
        P.holdout_plan(frame, "race_date", "included", [("holdout", 60), ("mini_val", 4000)]).collect()
