"""Walk-forward selection against a plain loop over dates, and without a look at a date's own events."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfield.operators import walkforward as W

FEATURES, DEPTH, COUNT = ["a", "b"], 5, 6
START = dt.date(2024, 1, 1)
SCHEMA = "race_id long, race_date date, entry_no int, a double, b double, place int, extra string"


def fixture(seed=1, days=9):
    rng = random.Random(seed)
    rows, last, race = [], [], 0
    for day in range(days):
        for _ in range(rng.randrange(1, 5)):
            race += 1
            n = rng.choice([2, 3, 4, 6, 7])
            places = rng.sample(range(1, n + 1), n)
            for no in range(1, n + 1):
                place = None if race % 7 == 0 and no == 1 else places[no - 1]
                rows.append((race, START + dt.timedelta(day), no, None if rng.random() < 0.1 else float(rng.randrange(5)), n - places[no - 1] + rng.random() * 3, place, "x"))
            if n >= 3 and race % 6:
                last.append((race, sorted(rng.sample(range(1, n + 1), 3))))
    return rows, last


def plain_events(rows):
    events = defaultdict(list)
    for race, day, no, a, b, place, _ in rows:
        events[race, day].append((no, (a, b), place))
    out = {}
    for (race, day), members in events.items():
        if len(members) >= 3:
            lists = [
                [m[0] for m in sorted(members, key=lambda m, i=i, s=s: (m[1][i] is None, 0 if m[1][i] is None else -s * m[1][i], m[0]))][:DEPTH] for i in range(2) for s in (1, -1)
            ]
            answer = sorted(m[0] for m in members if m[2] is not None and m[2] <= 3)
            out[race] = (day, lists, answer if len(answer) == 3 else None)
    return out


def plain_sources(past, metric, rank_weight):
    rated = []
    for li in range(4):
        for pattern in combinations(range(1, DEPTH + 1), 3):
            seen = exact = places = 0
            for _, lists, answer in past:
                if answer is None:
                    continue
                items = lists[li]
                seen += len(items) >= pattern[2]
                at = [r for r in range(1, len(items) + 1) if items[r - 1] in answer]
                exact += at == list(pattern)
                places += sum(r in at for r in pattern)
            if seen:
                e, m = W.MILLION * exact // seen, W.MILLION * places // (3 * seen)
                main, other = (e, m) if metric == "exact" else (m, e)
                rated.append((-main, -other, li, list(pattern), main))
    rated.sort()
    best = rated[:COUNT]
    return [(n + 1, li, pattern, rate, rate + (int(round(W.MILLION * rank_weight) * (len(best) - n) / len(best)) if rank_weight else 0)) for n, (_, _, li, pattern, rate) in enumerate(best)]


def plain_candidates(lists, sources, fallback):
    votes = defaultdict(list)
    for rank, li, pattern, rate, weight in sources:
        if len(lists[li]) >= pattern[2]:
            votes[tuple(sorted(lists[li][r - 1] for r in pattern))].append((weight, rank, rate))
    if fallback is not None:
        votes.setdefault(tuple(fallback), [])
    n = max(len(sources), 1)
    score = {c: sum(v[0] for v in vs) for c, vs in votes.items()}
    support = {c: len(vs) for c, vs in votes.items()}
    items, pairs = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for c in votes:
        for table, keys in ((items, c), (pairs, combinations(c, 2))):
            for k in keys:
                table[k][0] += score[c]
                table[k][1] += support[c]
    top = set(sorted((i for i in items if items[i][1]), key=lambda i: (-items[i][0], -items[i][1], i))[:5])
    by_score, by_support = sorted(votes, key=lambda c: (-score[c], c)), sorted(votes, key=lambda c: (-support[c], c))
    own, others = tuple(fallback or ()), max(len(votes) - 1, 1)
    out = {}
    for c, vs in votes.items():
        s, k = score[c] / W.MILLION, max(support[c], 1)
        row = [s / n, s / k, max([v[0] for v in vs], default=0) / W.MILLION, support[c] / n, min([v[1] for v in vs], default=len(sources) + 1) / n]
        shared = len(set(c) & set(own))
        row += [sum(v[2] for v in vs) / W.MILLION / k, shared / 3, int(c == own), by_score.index(c) / others, by_support.index(c) / others]
        row += [(s - score.get(own, 0) / W.MILLION) / n, (support[c] - support.get(own, 0)) / n]
        for table, keys in ((pairs, list(combinations(c, 2))), (items, list(c))):
            for j, unit in ((0, W.MILLION), (1, 1)):
                values = [table[x][j] for x in keys]
                row += [sum(values) / unit / n, min(values) / unit / n, max(values) / unit / n]
        row.append(len(set(c) & top) / 3)
        out[c] = (row, support[c], shared, by_score.index(c), score[c])
    return out


COLUMNS = [
    "score", "mean_score", "most_score", "support_share", "first_rank", "mean_rate", "overlap_share", "same", "score_order", "support_order", "score_lead", "support_lead",
    *(f"{who}_{kind}_{label}" for who in ("pair", "item") for kind in ("score", "count") for label in ("sum", "least", "most")), "top_share",
]


def frames(spark, seed=1):
    rows, last = fixture(seed)
    events = W.ranked_lists(spark.createDataFrame(rows, SCHEMA).repartition(3), FEATURES, DEPTH).cache()
    return rows, last, events, spark.createDataFrame(last, "race_id long, fallback array<int>")


@pytest.mark.parametrize(("metric", "rank_weight"), [("match", 0.0), ("exact", 0.25)])
def test_sources_and_candidates_equal_a_loop_over_dates(spark, metric, rank_weight):
    rows, last, events, fallbacks = frames(spark)
    plain, own = plain_events(rows), dict(last)
    sources = W.chosen_sources(W.policy_state(events, 4, DEPTH), COUNT, metric, rank_weight)
    found = {r["race_date"]: [tuple(s) for s in r["sources"]] for r in sources.collect()}
    want = {}
    for day in sorted({e[0] for e in plain.values()}):
        past = [e for e in plain.values() if e[0] < day]
        some = [(n, li, pattern, rate, weight) for n, li, pattern, rate, weight in plain_sources(past, metric, rank_weight)]
        if some:
            want[day] = some
    assert found == want
    got = defaultdict(dict)
    for r in W.candidate_rows(events, sources, fallbacks).collect():
        got[r["race_id"]][tuple(r["combo"])] = r
    for race, (day, lists, answer) in plain.items():
        expected = plain_candidates(lists, want.get(day, []), own.get(race))
        assert got[race].keys() == expected.keys()
        for combo, (row, support, shared, place, points) in expected.items():
            r = got[race][combo]
            assert [r[c] for c in COLUMNS] == pytest.approx(row, abs=1e-12)
            assert (r["support"], r["overlap"], r["place"], r["points"], r["exact"]) == (support, shared, place, points, list(combo) == answer)


def test_selection_equals_a_loop_over_dates(spark):
    rows, last, events, fallbacks = frames(spark, 5)
    sources = W.chosen_sources(W.policy_state(events, 4, DEPTH), COUNT, "match")
    candidates = W.candidate_rows(events, sources, fallbacks).cache()
    found = {r["race_id"]: r for r in W.select_by_chance(candidates, W.bucket_state(candidates), 1000).collect()}
    by_day = defaultdict(list)
    for r in candidates.collect():
        by_day[r["race_date"]].append(r)
    counts = defaultdict(lambda: [0, 0])
    switched = 0
    for day in sorted(by_day):
        chance = lambda r: W.MILLION * (counts[min(r["place"], W.ORDERS) * 4 + r["overlap"]][1] + 1) // (counts[min(r["place"], W.ORDERS) * 4 + r["overlap"]][0] + W.PRIOR)
        trained = sum(n for n, _ in counts.values())
        for race in {r["race_id"] for r in by_day[day]}:
            mine = [r for r in by_day[day] if r["race_id"] == race]
            best = min(mine, key=lambda r: (-chance(r), -r["points"], -r["support"], r["combo"]))
            own = next((r for r in mine if r["is_fallback"]), None)
            switch = bool(trained and own and not best["is_fallback"] and chance(best) >= chance(own) + 1000)
            row = found.pop(race)
            assert row["switched"] == switch and row["fit"] == (trained > 0) and row["train_rows"] == trained
            assert row["chosen"] == (best["combo"] if switch else own and own["combo"]) and row["in_pool"] == max(r["exact"] for r in mine)
            assert row["exact"] == int(best["exact"] if switch else bool(own and own["exact"]))
            switched += switch
        for r in by_day[day]:
            if r["answered"]:
                cell = counts[min(r["place"], W.ORDERS) * 4 + r["overlap"]]
                cell[0] += 1
                cell[1] += r["exact"]
    assert not found and switched > 3


def test_no_row_of_its_own_date_is_seen(spark):
    """Other answers from a date on change no source, candidate or chance up to that date."""
    rows, last, events, fallbacks = frames(spark)
    cut = START + dt.timedelta(5)
    changed = spark.createDataFrame([(*r[:5], (r[2] if r[1] >= cut else r[5]), r[6]) for r in rows], SCHEMA)
    later = W.ranked_lists(changed, FEATURES, DEPTH)

    def upto(found):
        sources = W.chosen_sources(W.policy_state(found, 4, DEPTH), COUNT, "match")
        candidates = W.candidate_rows(found, sources, fallbacks)
        chances = W.bucket_state(candidates).filter(F.col("race_date") <= F.lit(cut))
        rows = candidates.drop("exact", "answered").filter(F.col("race_date") <= F.lit(cut))
        return sorted(map(str, rows.collect())), sorted(map(str, chances.collect()))

    assert upto(events) == upto(later)


def test_as_of_a_day_between_dates(spark):
    rows, last, events, fallbacks = frames(spark)
    day = START + dt.timedelta(100)
    dates = spark.createDataFrame([(day,)], "race_date date")
    (found,) = W.chosen_sources(W.policy_state(events, 4, DEPTH, dates), COUNT, "exact").collect()
    assert found["race_date"] == day and [tuple(s) for s in found["sources"]] == plain_sources(plain_events(rows).values(), "exact", 0.0)


def test_nothing_gives_nothing(spark):
    empty = W.ranked_lists(spark.createDataFrame([], SCHEMA), FEATURES, DEPTH)
    none = spark.createDataFrame([], "race_id long, fallback array<int>")
    candidates = W.candidate_rows(empty, W.chosen_sources(W.policy_state(empty, 4, DEPTH), COUNT, "match"), none)
    assert candidates.collect() == [] and W.select_by_chance(candidates, W.bucket_state(candidates), 0).collect() == []


def test_probe_tries_every_setting(spark):
    rows, last, events, fallbacks = frames(spark, 7)
    candidates = W.candidate_rows(events, W.chosen_sources(W.policy_state(events, 4, DEPTH), COUNT, "match"), fallbacks).cache()
    parts = W.overlap_parts(candidates).withColumn("w", F.lit(1))
    found = {(r["add"], r["drop"], r["pair"], r["bias"]): (r["switched"], r["gained"]) for r in W.probe_weights(parts, [0, 50], [0, 25], [10], [0, 40], "w").collect()}
    by_race = defaultdict(list)
    for r in candidates.collect():
        by_race[r["race_id"]].append(r)
    own = dict(last)
    for (add, drop, pair, bias), (switched, gained) in found.items():
        n = gain = 0
        for race, mine in by_race.items():
            if race not in own:
                continue
            unit = {tuple(r["combo"]): round(r["score"] * W.MILLION) for r in mine}
            weight = defaultdict(int)
            for r in mine:
                c = tuple(r["combo"])
                w = unit[c] + round(r["support_share"] * W.MILLION)
                for key in (*c, *combinations(c, 2)):
                    weight[key] += w
            last_ = tuple(own[race])
            near = [r for r in mine if len(set(r["combo"]) & set(last_)) == 2]
            if not near:
                continue

            def total(r, unit=unit, weight=weight, last_=last_, add=add, drop=drop, pair=pair):
                c = tuple(r["combo"])
                (added,), (gone,) = set(c) - set(last_), set(last_) - set(c)
                return 100 * unit[c] + add * weight[added] - drop * weight[gone] + pair * weight[tuple(sorted(set(c) & set(last_)))]

            best = min(near, key=lambda r: (-total(r), -r["support"], r["combo"]))
            if total(best) >= 100 * unit[last_] + bias * W.MILLION:
                n += 1
                gain += best["exact"] - next(r["exact"] for r in mine if r["is_fallback"])
        assert (switched, gained) == (n, gain)
    assert len(found) == 8 and any(n for n, _ in found.values())


def test_probe_in_blocks_is_the_probe_by_candidates(spark):
    """Arrays of blocks of events give what rows of candidates give: with equal totals, unknown answers, a date without sources, and entries numbered far apart."""
    rows, last = fixture(11, days=40)
    for far in (1, 1_000_003):
        events = W.ranked_lists(spark.createDataFrame([(r[0], r[1], r[2] * far, *r[3:]) for r in rows], SCHEMA), FEATURES, DEPTH).cache()
        fallbacks = spark.createDataFrame([(race, [x * far for x in combo]) for race, combo in last], "race_id long, fallback array<int>")
        state = W.policy_state(events, 4, DEPTH)
        groups = {"five": W.chosen_sources(state, 5, "exact"), "all": W.chosen_sources(state, 40, "match")}
        weights = [0, 25, 100], [0, 25], [0, 10], [0, 20, 80]
        want = set()
        for name, sources in groups.items():
            parts = W.overlap_parts(W.judged_rows(W.voted_combinations(events, sources, fallbacks))).withColumn("w", F.concat(F.lit(name), F.col("race_date").cast("string")))
            want |= set(map(tuple, W.probe_weights(parts, *weights, "w").collect()))
        sources = groups["five"].withColumn("group", F.lit("five")).union(groups["all"].withColumn("group", F.lit("all")))
        late = events.withColumn("as_of", F.col("race_date")).join(fallbacks, "race_id")
        found = W.probe_events(late, sources, *weights)
        assert {(r["group"] + str(r["as_of"]), *tuple(r)[2:]) for r in found.collect()} == want
        assert len({w[0] for w in want}) > 40 and any(w[5] for w in want) and any(w[6] for w in want)


def test_rounding_to_millionths(spark):
    shares = [k / W.MILLION / 24 for k in range(0, 3_000_000, 997)] + [0.5e-6, 1.5e-6, 2.5e-6]
    want = spark.createDataFrame([(x,) for x in shares], "x double").select(F.round(F.col("x") * W.MILLION).cast("long")).collect()
    assert W._millionths(np.array(shares)).tolist() == [r[0] for r in want]


def test_ranked_lists_of_nothing_known(spark):
    """Events whose values are all null, whose places are unknown or of which more or fewer than three were first."""
    rows = [(1, START, n, None, None, None, "x") for n in (4, 2, 9)] + [(2, START, n, 1.0, -0.0 if n % 2 else 0.0, n % 3, "x") for n in range(8)] + [(3, START, 5, 1.0, 1.0, 1, "x")]
    found = {r["race_id"]: r for r in W.ranked_lists(spark.createDataFrame(rows, SCHEMA), FEATURES, DEPTH).collect()}
    assert set(found) == {1, 2} and found[1]["lists"] == [[2, 4, 9]] * 4 and found[2]["lists"] == [[0, 1, 2, 3, 4]] * 4
    assert [found[r]["size"] for r in (1, 2)] == [3, 8] and found[1]["answer"] is None and found[2]["answer"] is None
