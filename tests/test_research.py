"""Windows against single fits, packs against crashes, objects in free text, leaked fields at any depth."""

from __future__ import annotations

import json
import os
import random
import re
import shutil
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from rankfield.functions import freetext as X
from rankfield.operators import analysis as A
from rankfield.operators import leakage as K
from rankfield.operators import learning as L
from rankfield.operators import store
from rankfield.operators import windows as S
from rankfield.sources import packs as B

SPANS = [S.Span("dev", "2024-01-20", None, "2024-01-31"), S.Span("test", "2024-01-20", "2024-02-01"), S.Span("roll", "2024-01-31", "2024-02-01", "2024-02-10")]


@pytest.fixture(scope="module")
def feature_rows(spark):
    rng = random.Random(2)
    rows = []
    for race in range(120):
        day = f"2024-0{1 + race // 70}-{1 + race % 28:02d}"
        skill = [rng.gauss(0, 1) for _ in range(rng.choice([2, 3, 5, 7]))]
        order = sorted(range(len(skill)), key=lambda i: -skill[i] - rng.gauss(0, 0.5))
        for i, s in enumerate(skill):
            rows.append((race, day, i + 1, order.index(i) + 1, int(order.index(i) < 3), s if rng.random() > 0.05 else None, rng.random()))
    frame = spark.createDataFrame(rows, "race_id long, race_date string, entry_no int, place int, target int, a double, b double")
    return frame.withColumn("race_date", F.to_date("race_date")).cache()


def test_windows_equal_single_fits(feature_rows):
    found = {(r["span"], r["race_id"]): (r["predicted"], r["hit_count"]) for r in S.predicted_spans(feature_rows, ["a", "b"], SPANS, positive_weight=2.0).collect()}
    seen = 0
    for span in SPANS:
        train = feature_rows.filter(F.col("race_date") <= span.train_end).withColumn("w", F.when(F.col("target") == 1, 2.0).otherwise(1.0))
        begin = F.col("race_date") > span.train_end if span.eval_start is None else F.col("race_date") >= span.eval_start
        late = feature_rows.filter(begin & (F.col("race_date") <= (span.eval_end or "2099-01-01")))
        model = L.model("logreg", ["a", "b"], weight="w").fit(train)
        races = {}
        for r in L.scored(model, late, ["race_id", "entry_no", "place"]).collect():
            races.setdefault(r["race_id"], []).append(r)
        for race, rows in races.items():
            picks = [r["entry_no"] for r in sorted(rows, key=lambda r: (-r["score"], -r["entry_no"]))[:3]]
            answer = {r["entry_no"] for r in rows if r["place"] <= 3}
            assert found[span.name, race] == (picks, len(answer & set(picks)) if len(answer) == 3 else 0)
            seen += 1
    assert seen == len(found)


def test_rates_over_windows(spark, feature_rows):
    predicted = S.predicted_spans(feature_rows, ["a", "b"], SPANS)
    rates = {r["span"]: r for r in S.span_rates(predicted).collect()}
    answered = [r for r in predicted.collect() if r["answer"] is not None]
    for name, rate in rates.items():
        mine = [r for r in answered if r["span"] == name]
        assert rate["races"] == len(mine) and rate["exact_rate"] == pytest.approx(sum(r["hit_count"] == 3 for r in mine) / len(mine)) and rate["incomplete"] == 0
    (one,) = S.overfit_safe(S.span_rates(predicted), "dev", "test").collect()
    dev, test, roll = (round(rates[n]["exact_rate"], 6) for n in ("dev", "test", "roll"))
    assert tuple(one) == pytest.approx((min(dev, test), (dev + test) / 2, roll, roll, min(dev, test, roll)), abs=1e-6)
    alone = S.overfit_safe(spark.createDataFrame([("dev", 0.25), ("test", 0.5)], "span string, exact_rate double"), "dev", "test").first()
    assert tuple(alone) == (0.25, 0.375, 0.25, 0.25, 0.25)


def test_an_empty_window_is_an_error(feature_rows):
    with pytest.raises(ValueError, match="late has an empty part"):
        S.predicted_spans(feature_rows, ["a"], [SPANS[0], S.Span("late", "2024-03-01")])


def tables(spark, n=50):
    races = spark.range(n).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("r"), "id")).alias("name"), F.array(F.col("id"), F.lit(1)).alias("xs"))
    return {"races": races, "answers": spark.range(n * 2).select("id", (F.col("id") / 3).alias("share"))}


def test_pack_round_trip(spark, tmp_path):
    target = f"file://{tmp_path}/packs"
    with pytest.raises(FileNotFoundError):
        B.read_pack(spark, target)
    version = B.write_pack(tables(spark), target, {"day": "1"}, "a")
    again = B.write_pack({n: t.repartition(3) for n, t in tables(spark).items()}, target, {"day": "1"}, "b")
    assert version == again  # equal rows in any order
    pack = B.read_pack(spark, target)
    assert pack.manifest["info"] == {"day": "1"} and pack.manifest["tables"]["races"]["rows"] == 50
    for name, table in tables(spark).items():
        assert sorted(map(str, pack.tables[name].collect())) == sorted(map(str, table.collect()))
    other = B.write_pack(tables(spark, 51), target, {"day": "1"}, "c")
    assert other != version and B.read_pack(spark, target).manifest["version"] == other and B.read_pack(spark, target, version).tables["races"].count() == 50
    with pytest.raises(FileNotFoundError):
        B.read_pack(spark, target, "0000")
    spark.range(3).selectExpr("id", "'x' AS name", "array(id) AS xs").write.mode("append").parquet(f"{target}/packs/{other}/races")
    with pytest.raises(ValueError, match="races"):
        B.read_pack(spark, target)
    empty = B.write_pack({"none": spark.range(0).select("id")}, target, {}, "d")
    assert B.read_pack(spark, target, empty).tables["none"].count() == 0


def test_a_crash_leaves_the_old_pack_and_is_taken_up(spark, tmp_path, monkeypatch):
    target = f"file://{tmp_path}/packs"
    first = B.write_pack(tables(spark), target, {"day": "1"}, "a")
    plain, done = B._written, []

    def failing(table, path):
        if done:
            table.limit(3).write.parquet(path)  # half a table, and no note
            raise RuntimeError("killed")
        done.append(path)
        return plain(table, path)

    monkeypatch.setattr(B, "_written", failing)
    with pytest.raises(RuntimeError):
        B.write_pack(tables(spark, 60), target, {"day": "2"}, "b")
    assert B.read_pack(spark, target).manifest["version"] == first
    counted = []
    monkeypatch.setattr(B, "_written", lambda table, path: counted.append(path) or plain(table, path))
    second = B.write_pack(tables(spark, 60), target, {"day": "2"}, "b")
    assert len(counted) == 1 and counted[0].endswith("answers")  # the complete table is not written again
    assert B.read_pack(spark, target).manifest["version"] == second and B.read_pack(spark, target).tables["answers"].count() == 120


def test_a_crash_between_move_and_pointer(spark, tmp_path, monkeypatch):
    target = f"file://{tmp_path}/packs"
    first = B.write_pack(tables(spark), target, {"day": "1"}, "a")
    monkeypatch.setattr(B.Folder, "replace", lambda *x: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        B.write_pack(tables(spark, 60), target, {"day": "2"}, "b")
    assert B.read_pack(spark, target).manifest["version"] == first
    monkeypatch.undo()
    assert B.read_pack(spark, target, B.write_pack(tables(spark, 60), target, {"day": "2"}, "b")).tables["races"].count() == 60


def test_a_killed_process(spark, tmp_path):
    """A writer that is killed in its second table, by a signal, and the run that goes on after it."""
    target = f"file://{tmp_path}/packs"
    first = B.write_pack(tables(spark), target, {"day": "1"}, "a")
    script = tmp_path / "writer.py"
    script.write_text(
        textwrap.dedent(f"""
        import os, signal, sys
        sys.path[:0] = {[os.getcwd(), os.path.dirname(__file__)]!r}
        from pyspark.sql import SparkSession
        from rankfield.sources import packs as B
        from test_research import tables
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        plain = B._written
        def written(table, path):
            if path.endswith("answers"):
                os.kill(os.getpid(), signal.SIGKILL)
            return plain(table, path)
        B._written = written
        B.write_pack(tables(spark, 60), {target!r}, {{"day": "2"}}, "b")
        """)
    )
    ended = subprocess.run([sys.executable, str(script)], capture_output=True, timeout=180, env={**os.environ, "PYTHONPATH": os.getcwd()})
    assert ended.returncode == -9 and os.path.exists(f"{tmp_path}/packs/.staging/b/races.json")
    assert B.read_pack(spark, target).manifest["version"] == first
    assert B.read_pack(spark, target, B.write_pack(tables(spark, 60), target, {"day": "2"}, "b")).manifest["info"] == {"day": "2"}
    shutil.rmtree(tmp_path / "packs")


def test_last_version_as_of_a_day(spark):
    rows = [("a", 1, 5), ("a", 3, 6), ("a", 3, 7), ("a", 9, 8), ("b", 4, 1), ("c", None, 2), (None, 2, 3)]
    frame = spark.createDataFrame(rows, "k string, t int, v int").select("v", "k", "t")
    found = B.as_of(frame, ["k"], "t", F.lit(3))
    assert found.columns == ["v", "k", "t"] and sorted(map(str, map(tuple, found.collect()))) == sorted(["(7, 'a', 3)", "(3, None, 2)"])


def brute_balanced(text):
    begin = text.find("{")
    depth = inside = escaped = 0
    for i in range(begin, len(text)) if begin >= 0 else ():
        c = text[i]
        if inside:
            inside = not (c == '"' and not escaped)
            escaped = c == "\\" and not escaped
        elif c == '"':
            inside, escaped = True, False
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[begin : i + 1]
    return None


def test_balanced_objects(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice('{}"\\a,: ') for _ in range(rng.randrange(25))) for _ in range(1500)]
    texts += ["", "{}", "é{😀}ö", '{"a":"}"}', "x" * 20_000 + '{"a":{"b":[1,{}]}} {}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.balanced("t").alias("b")).collect()
    assert {r["i"]: r["b"] for r in rows} == {i: brute_balanced(t) for i, t in enumerate(texts)}


def plain_prediction(text):
    """The whole text, the first fenced object, the first flat object that names picks."""
    tried = [text.strip()]
    for pattern in (r"```(?:json)?\s*(\{.*?\})\s*```", r'(\{[^{}]*"(?:selected_horses|predicted|prediction)"[^{}]*\})'):
        tried += [m[1] for m in [re.search(pattern, text, re.S)] if m]
    return first_object(tried)


def plain_reply(text):
    return first_object([m[1] for m in (re.search(r"```json\s*(\{.*?\})\s*```", text, re.S), re.search(r"(\{.*\})", text, re.S)) if m])


def first_object(tried):
    for one in tried:
        try:
            if isinstance(json.loads(one), dict):
                return one
        except ValueError:
            continue
    return None


TEXTS = [
    '{"predicted":[1,2,3]}', ' {"a":1} ', "5", "[1]", "", "no", '```json\n{"a":{"b":1}}\n```', '```\n{"prediction":[1]}\n``` {"x":2}', 'a {"predicted":[1]} b {"predicted":[2]}',
    '{"selected_horses":[{"chulNo":3}]} trailing', 'x {"q":1} y', '```json {bad} ``` {"a":1}', '{"a":"{"}', 'x {"a":"}"} y', '{"predicted":[1,],}', '{"a":"x,]","b":[1,2,],}', "{", "}{",
    '{"predicted":[1]}] {}', '{"predicted":[1]},"y":{}', '{"predicted":[1]},{"y":{}}', '{"predicted":[1]}} {', '{"predicted":[1,2', 'Text {see} {"prediction":["4"]}', '{"a":1}{"b":2}', 'ok ```json {"a":1} ``` then ```json {"b":2} ```',
]


def test_objects_in_free_text(spark):
    rows = spark.createDataFrame([*enumerate(TEXTS), (-1, None)], "i int, t string").select("i", X.prediction_object("t").alias("p"), X.answer_object("t").alias("r"), X.any_object(F.col("t")).alias("x")).collect()
    for r in rows:
        if r["i"] < 0:
            assert (r["p"], r["r"], r["x"]) == (None, None, None)
            continue
        text = TEXTS[r["i"]]
        assert r["p"] == plain_prediction(text), text
        assert r["r"] == plain_reply(text), text
        assert r["x"] is None or isinstance(json.loads(r["x"]), dict)
    any_of = {TEXTS[r["i"]]: r["x"] for r in rows if r["i"] >= 0}
    assert any_of['{"predicted":[1,],}'] == '{"predicted":[1]}' and any_of['{"a":"x,]","b":[1,2,],}'] == '{"a":"x,]","b":[1,2]}' and any_of['{"a":1}{"b":2}'] == '{"a":1}'
    assert any_of["{"] is None and any_of['{"predicted":[1,2'] is None and any_of["5"] is None and any_of["[1]"] is None


def test_picks(spark):
    docs = ['{"selected_horses":[{"chulNo":3},{"chulNo":"4"},7]}', '{"predicted":[1,"2"],"prediction":[9]}', '{"prediction":[5]}', '{"other":1}', None]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").select("i", X.picks("d").alias("p")).collect()
    assert {r["i"]: r["p"] for r in rows} == {0: ["3", "4", "7"], 1: ["1", "2"], 2: ["5"], 3: None, 4: None}


def plain_leaks(value, path=""):
    found = set()
    if isinstance(value, dict):
        for k, v in value.items():
            here = f"{path}.{k}" if path else k
            bad = k in K.RESULT_FIELDS or re.match(K.SECTIONAL, k)
            if bad and not (v is None or isinstance(v, str) and not v.strip() or isinstance(v, (list, dict)) and not v):
                found.add(here)
            found |= plain_leaks(v, here)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            found |= plain_leaks(v, f"{path}[{i}]")
    return found


def test_leaked_fields_at_any_depth(spark):
    rng = random.Random(4)
    names = ["rank", "ord", "top3", "no", "sjG1fOrd", "bu_4cGTime", "seS1fAccTime", "sjG9fOrd", "detail", "payout"]

    def made(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice([None, "", " \t", "x", 0, 1.5, False, [], {}, [None]])
        return {rng.choice(names): made(depth - 1) for _ in range(rng.randrange(4))} if kind < 0.75 else [made(depth - 1) for _ in range(rng.randrange(3))]

    documents = [made(5) for _ in range(300)]
    rows = [(i, json.dumps(d)) for i, d in enumerate(documents)] + [(1000, None), (1001, "no json"), (1002, "7")]
    frame = spark.createDataFrame(rows, "id int, doc string")
    found = K.leaked_fields(frame, "id", "doc", 8)
    assert sorted((r["id"], r["path"]) for r in found.collect()) == sorted((i, p) for i, d in enumerate(documents) for p in plain_leaks(d))
    report = K.leakage_report(frame, found, "id").first()
    assert report["checked"] == 303 and not report["passed"] and report["leaking"] == sum(bool(plain_leaks(d)) for d in documents)
    clean = frame.filter("id > 999")
    assert K.leakage_report(clean, K.leaked_fields(clean, "id", "doc", 3), "id").first()["passed"]
    with pytest.raises(Exception, match="deeper than 2 levels"):
        K.leaked_fields(spark.createDataFrame([(1, '{"a":{"b":{"c":{"d":1}}}}')], "id int, doc string"), "id", "doc", 2).collect()


def test_fullness_counts_nested_leaves(spark):
    kind = "k int, name string, rate double, tags array<string>, detail struct<a:string,more:struct<b:double,c:array<int>>>, m map<string,string>"
    rows = [
        (1, "x", 1.0, [], None, None),
        (1, " ", float("nan"), ["t", " ", None], ("a", (float("inf"), [1, None, 2])), {"q": "v", "w": ""}),
        (2, None, None, None, (None, (1.0, None)), None),
        (2, "a", None, None, (" ", (None, [])), None),
        (3, None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, kind)
    assert [r["n"] for r in frame.select(store.filled_fields(frame, ["name", "rate", "tags", "detail", "m"]).alias("n")).collect()] == [2, 5, 1, 1, 0]
    best = {r["k"]: r for r in store.canonical_rows(frame.drop("m"), ["k"]).collect()}
    assert best[1]["tags"] == ["t", " ", None] and best[3]["name"] is None and len(best) == 3
    assert best[2]["detail"]["a"] is None or best[2]["name"] == "a"


def test_heuristic_needs_three_entries(spark):
    rows = [(1, n, s, p, 20, 5, o, r) for n, s, p, o, r in [(1, 10, 4, 2.0, 1), (2, 0, 0, None, 99), (3, 5, 5, 0.5, None), (4, 10, 4, 2.0, 1)]]
    rows += [(2, 1, 10, 4, 20, 5, 2.0, 1), (2, 2, 10, 4, 20, 5, 2.0, 1), (3, 1, None, None, None, None, None, None), (3, 2, 0, 0, 0, 0, 1.0, 1), (3, 3, 0, 0, 0, 0, 1.0, 2)]
    frame = spark.createDataFrame(rows, "race_id int, entry_no int, starts_y int, places_y int, starts_t int, places_t int, win_odds double, odds_rank int")
    found = {r["race_id"]: (r["predicted"], r["confidence"]) for r in A.heuristic_picks(frame).collect()}
    score = {1: 4 / 12 + 0.06 / 2, 2: 5 / 35 + 0.06 / 99, 3: 5 / 7 + 0.06 / 1.01, 4: 4 / 12 + 0.06 / 2}
    assert found[1] == ([3, 1, 4], pytest.approx(min(0.88, max(0.55, 0.52 + 0.45 * (score[3] + score[1] + score[4]) / 3))))
    assert found[2] == ([], 0.0)
    assert found[3] == ([2, 3, 1], 0.55)
