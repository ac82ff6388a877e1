"""Classifier, nearest neighbours and near duplicates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rankfield.llm import ann, quality, simhash


def test_quality_on_held_out_labels(spark, data):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.score_quality(docs, labels).join(labels, "doc_id").filter(quality.held_out(F.col("doc_id"))).toPandas()
    good, bad = scored[scored.quality == 1].score, scored[scored.quality == 0].score
    assert (good >= 0.7).mean() > 0.9 and (bad < 0.7).mean() > 0.7 and scored.score.between(0, 1).all()


def test_quality_edge_cases(spark, awkward, no_rows):
    labels = spark.createDataFrame([(i, int(i < 106), 0) for i in range(90, 130)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    scores = quality.score_quality(awkward, labels).collect()
    assert len(scores) == awkward.count() and all(0 <= r["score"] <= 1 for r in scores)
    none = quality.score_quality(awkward, labels.filter("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.score_quality(no_rows, labels).collect() == []
    assert quality.keep_good(awkward, labels, 0.0).count() == awkward.count()


def test_word_classes_do_not_depend_on_position():
    import pyarrow as pa

    (one,) = quality._sliced(pa.array(["foo, bar foo"]))
    (two,) = quality._sliced(pa.array(["zzz", "", None, "bar foo,"]))
    a, _ = quality.words(one[2], one[3])
    b, firsts = quality.words(two[2], two[3])
    assert a[0] == a[3] == b[2] and a[2] == b[1] and a[1] == b[3] and firsts.tolist() == [0, 1, 1, 1, 4]


def test_every_word_has_its_own_vector(spark):
    """Features over many small blocks equal a plain sum over all texts, with far more words than a fixed table would hold."""
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 40_000, 50)) for _ in range(1200)] + ["", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    found = {r["doc_id"]: r["value"] for r in quality.text_features(docs).collect()}
    said = [t.split() for t in texts]
    (slice_of,) = quality._sliced(pa.array([" ".join(sorted({w for words in said for w in words}))]))
    hashed = dict(zip(sorted({w for words in said for w in words}), quality.words(slice_of[2], slice_of[3])[0], strict=True))
    assert len(set(hashed.values())) == len(hashed) > 20_000
    places, signs = quality._index_vectors(np.array(list(hashed.values())))
    index = dict(zip(hashed, zip(places, signs, strict=True), strict=True))
    sums = {w: np.zeros(quality.DIM) for w in hashed}
    for words in said:
        for i, w in enumerate(words):
            for j in range(max(0, i - quality.WINDOW), min(len(words), i + quality.WINDOW + 1)):
                if j != i:
                    sums[w][index[words[j]][0]] += index[words[j]][1]
    for i in (0, 7, 1199, 1200, 1201):
        rows = np.array([sums[w] / max(np.linalg.norm(sums[w]), 1e-9) for w in said[i]]) if said[i] else np.zeros((1, quality.DIM))
        assert np.allclose(found[i][: quality.DIM], rows.mean(axis=0), atol=1e-5), i


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score double")


def test_neighbours_leave_out_unusable_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist(), 1, 0.0) for i in range(30)]
    rows += [(100, None, 1, 0.0), (120, [0.0] * 4, 1, 0.0), (140, [1.0, None, 2.0, 3.0], 1, 0.0), (160, [float("nan"), 1.0, 1.0, 1.0], 1, 0.0), (180, [float("inf"), 1.0, 1.0, 1.0], 1, 0.0)]
    rows += [(200, [1.0, 2.0], 1, 0.0), (None, [1.0] * 4, 1, 0.0), (20, rows[20][1], 1, 0.0)]
    rows += [(40, [5.0, 0.0, 0.0, 0.0], 1, 0.0), (41, [5.0, 0.0, 0.0, 0.0], 1, 0.0), (42, [5.0, 0.0, 0.0, 0.0], 1, 0.0)]
    x = {r[0]: np.array(r[1]) for r in rows if r[0] is not None and r[0] < 100}
    x = {i: v.astype(np.float32).astype(float) for i, v in x.items()}
    found = ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 5).collect()
    assert {r["query_id"] for r in found} == {0, 20, 40}
    for query in (0, 20, 40):
        want = sorted(((-(x[query] * v).sum(), i) for i, v in x.items() if i != query))[:5]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == query)
        assert [g[1] for g in got] == [w[1] for w in want] and np.allclose([g[2] for g in got], [-w[0] for w in want], rtol=0, atol=1e-12)
    assert len(ann.nearest(vectors(spark, rows), F.col("vec_id") == 0, 100).collect()) == 32  # all candidates, if fewer
    assert ann.nearest(vectors(spark, []), F.lit(True)).collect() == []


def test_a_repeated_id_with_another_vector_is_a_row_of_its_own(spark):
    rows = [(i, [float(i % 5), 1.0, 0.5], 1, 0.0) for i in range(1, 40)] + [(7, [6.0, 0.0, 0.0], 1, 0.0), (20, [0.0, 0.0, 9.0], 1, 0.0), (20, [0.0, 0.0, 9.0], 1, 0.0)]
    found = ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 5).collect()
    x = [(i, np.array(v)) for i, v in dict.fromkeys((i, tuple(v)) for i, v, *_ in rows)]
    want = []
    for query, v in x:
        if query % 20 == 0:
            best = sorted((-(v * w).sum(), i) for i, w in x if (i, tuple(w)) != (query, tuple(v)))[:5]
            want += [(query, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in found) == sorted(want)


def test_equal_vectors_beyond_k_are_told_apart_by_id(spark):
    rows = [(i, [1.0, 2.0], 1, 0.0) for i in range(100)] + [(200, [0.5, 0.5], 1, 0.0)]
    found = ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 5).collect()
    assert ann.candidates(ann.usable(vectors(spark, rows)), 5).count() == 7
    for query in (0, 20, 40, 60, 80, 200):
        want = [i for i in range(6) if i != query][:5]
        assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == query] == want


def test_neighbour_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    x[:1500] = x[0] + 0.01 * rng.normal(size=(1500, 32))  # a hot vector
    frame = spark.createDataFrame([(i, v.tolist(), 0, 0.0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, rank int, score double")
    found = ann.nearest(frame, F.col("vec_id") % 20 == 0).toPandas()
    y, hit = x.astype(float), 0
    for query in range(0, 6000, 20):
        score = y @ y[query]
        score[query] = -np.inf
        best = set(np.lexsort((np.arange(6000), -score))[:20].tolist())
        mine = found[found.query_id == query]
        assert len(mine) == 20
        hit += len(best & set(mine.vec_id))
    assert hit / (20 * 300) >= 0.9


def test_short_queries_are_scanned_again(spark, monkeypatch):
    monkeypatch.setattr(ann, "COVER", 0.0)  # one probed list, so that many queries are left short
    x = np.random.default_rng(6).normal(size=(2000, 16)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist(), 0, 0.0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, rank int, score double")
    found = ann.nearest(frame, F.col("vec_id") % 20 == 0).toPandas()
    assert found.groupby("query_id").size().tolist() == [20] * 100
    assert (found.sort_values(["query_id", "rank"])["rank"].to_numpy().reshape(100, 20) == np.arange(1, 21)).all()
    y, exact = x.astype(float), 0
    for query, mine in found.sort_values("rank").groupby("query_id"):
        score = y @ y[query]
        score[query] = -np.inf
        exact += mine.vec_id.tolist() == np.lexsort((np.arange(2000), -score))[:20].tolist()
    assert exact > 50


def test_scan_holds_few_pairs_at_a_time(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 24))
    top_norm = float(np.linalg.norm(x, axis=1).max())
    index = ann.Index(top_norm, np.linalg.qr(rng.normal(size=(25, 25)))[0], np.zeros((1, 25)), np.zeros(1), 1, x, np.arange(700))
    bound = np.sort(x @ x.T, axis=1)[:, -50]
    bound[:40] = -np.inf  # every candidate is scored
    arguments = (index, 20, np.arange(700), x, np.arange(700), x, bound)
    whole = ann.scan(*arguments)
    made, measure = [], ann._distances

    def measured(a, b):
        made.append(len(a) * len(b))
        return measure(a, b)

    monkeypatch.setattr(ann, "_distances", measured)
    monkeypatch.setattr(ann, "CELLS", 10_000, raising=False)
    sliced = ann.scan(*arguments)
    assert max(made) <= 10_000
    assert all(np.array_equal(a, b) for a, b in zip(whole[:2], sliced[:2], strict=True)) and np.allclose(whole[2], sliced[2], rtol=0, atol=1e-12)


def brute_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)][: len(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(values))]


def test_near_duplicates(spark, awkward, no_rows, texts):
    named = [(d, t) for d, t in texts if d is not None]
    prints = [brute_fingerprint(t) for _, t in named]
    groups = components(prints)
    least = {g: min(d for (d, _), h in zip(named, groups, strict=True) if h == g) for g in set(groups)}
    want = sorted((d, p, least[g]) for (d, _), p, g in zip(named, prints, groups, strict=True))
    found = simhash.near_duplicates(awkward).collect()
    assert sorted((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in found if r["doc_id"] is not None) == want
    assert len(found) == awkward.count() and simhash.near_duplicates(no_rows).collect() == []
    kept = [r["doc_id"] for r in simhash.keep_one(awkward).collect()]
    assert sorted(d for d in kept if d is not None) == sorted(set(least.values())) and kept.count(None) == 2


@pytest.mark.parametrize("limit", [4096, 20])
def test_links_of_planted_fingerprints(spark, limit, monkeypatch):
    """All links are found, whether postings are split or not."""
    monkeypatch.setattr(simhash, "HOT_POSTING", limit)
    rng = np.random.default_rng(limit)
    base = rng.integers(0, 2**63, 60, dtype=np.int64).tolist()
    values = set(base)
    for value in base[:30]:
        for _ in range(8):
            step = value
            for bit in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                step ^= 1 << bit
            values.add(step)
            value = step
    values |= {base[0] ^ 1 << a ^ 1 << b for a in range(20) for b in range(20)}
    values = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    frame = spark.createDataFrame(list(zip(signed, range(len(values)), strict=True)), "fp long, node long")
    found = {r["node"]: r["component"] for r in simhash.connected_components(simhash.links(frame)).collect()}
    assert [found.get(i, i) for i in range(len(values))] == components(values)
