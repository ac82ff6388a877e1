"""Every registered corpus query against a plain version of its contract, over the smallest tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from rankfield.llm import mixing, packing, queries, secret_scan


@pytest.fixture(scope="module")
def documents(data):
    return [(r["doc_id"], r["text"] or "") for r in pq.read_table(f"{data}/documents.parquet").to_pylist()]


def test_quality(spark, data, documents):
    rows = queries.op2_quality_classifier(spark, data).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d for d, _ in documents)
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{data}/labels.parquet").to_pylist()}
    texts = dict(documents)
    by_text = defaultdict(set)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        by_text[texts[r["doc_id"]]].add(r["score"])
    assert all(len(scores) == 1 for scores in by_text.values())  # equal texts, equal scores
    known = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    good, bad = [s for s, q in known if q], [s for s, q in known if not q]
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) >= 0.9 * len(good) * len(bad)


def test_quality_is_calibrated(spark):
    data = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{data}/labels.parquet").to_pylist()}
    rows = [(r["score"], labels[r["doc_id"]]) for r in queries.op2_quality_classifier(spark, data).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    score, truth = (np.array(x, dtype=float) for x in zip(*rows, strict=True))
    bins = np.minimum((score * 10).astype(int), 9)
    gap = sum(abs(score[bins == b].mean() - truth[bins == b].mean()) * (bins == b).mean() for b in set(bins.tolist()))
    assert gap < 0.02 and (score[truth == 1] >= 0.7).mean() > 0.97 and (score[truth == 0] < 0.7).mean() > 0.9


def test_sharding(spark, data, documents):
    rows = queries.op3_sharding(spark, data).collect()
    texts = dict(documents)
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    sizes, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        data_ = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data_) + 1, zlib.crc32(data_), "bytes", None)
        assert 0 <= r["shard"] < 8
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[texts[r["doc_id"]]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())
    groups = Counter()
    for r in rows:
        groups[texts[r["doc_id"]]] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2 * max(groups.values())


def plain_shards(groups, shards):
    """Contiguous groups where their middles fall; groups of a whole share alone."""
    total = sum(b for b, _ in groups)
    share = -(-total // shards)
    giants = [g for g in groups if g[0] >= share]
    rest = sum(b for b, _ in groups) - sum(b for b, _ in giants)
    placed, before, alone = {}, 0, 0
    for size, name in groups:
        if size >= share:
            placed[name], alone = alone, alone + 1
        else:
            placed[name] = len(giants) + (shards - len(giants)) * (2 * before + size) // (2 * rest)
            before += size
    return placed


def test_sharding_places_groups_where_their_middles_fall(spark, data, documents):
    """The order inside a magnitude is the operator's own; the cut of that order is checked in full."""
    rows = queries.op3_sharding(spark, data).collect()
    texts = dict(documents)
    first, size = {}, Counter()
    for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])):
        text = texts[r["doc_id"]]
        first.setdefault(text, len(first))
        size[text] += r["size"]
    order = [(size[t], t) for t in sorted(first, key=first.get)]
    placed = plain_shards(order, 8)
    assert all(placed[texts[r["doc_id"]]] == r["shard"] for r in rows)


def test_token_counts(spark, data, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(d, len(t.encode()), n := len(tokenizer.encode(t, add_special_tokens=False).ids), n > 1024) for d, t in documents]
    assert sorted(map(tuple, queries.op4_token_counts(spark, data).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())) == sorted(want)


def check_packing(rows, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d, t in documents:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], dtype="<u4")
            want[d, n, at, len(part), zlib.crc32(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(sequences) <= math.ceil(1.01 * sum(n for *_, n, _ in want.elements()) / 2048) + 1


def test_packing(spark, data, documents):
    check_packing(queries.op5_best_fit_packing(spark, data).collect(), documents)


def test_media(spark, data, documents):
    by_text = defaultdict(set)
    texts = dict(documents)
    rows = queries.op6_media_columns(spark, data).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        payload = texts[r["doc_id"]].encode()
        n = len(payload)
        payload += b"\xff" * (-n % 576 if n else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        units = -(-len(payload) // (576 * 8))
        assert f"units={units};" in r["feature"] and "lost=0;" in r["feature"] and r["media_bytes"] % 188 == 0
        by_text[texts[r["doc_id"]]].add((r["media_sha256"], r["media_bytes"], r["feature"]))
    assert all(len(x) == 1 for x in by_text.values())


BASE = [
    ("assign", re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 1, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]


def test_secrets(spark, data, documents):
    rows = {r["doc_id"]: r for r in queries.op7_secret_scans(spark, data).collect()}
    assert len(rows) == len(documents)
    for doc, text in documents:
        spans = [(m.start(), k, m.end(), name) for k, (name, rule, group, least) in enumerate(BASE) for m in rule.finditer(text) if len(m[group]) >= least]
        said = [f"{name}:{a}:{b}" for a, _, b, name in sorted(spans)]
        row = rows[doc]
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(s[3] == k for s in spans) for k in ("assign", "access", "hex")]
        assert row["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        found = row["spans"].split(",") if row["spans"] else []
        assert [s for s in found if not s.startswith("random:")] == said
        assert all(re.fullmatch(secret_scan.CANDIDATE, text[int(s.split(":")[1]) : int(s.split(":")[2])]) for s in found if s.startswith("random:"))


def test_neighbours(spark, data):
    rows = pq.read_table(f"{data}/embeddings.parquet").to_pylist()
    x = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in rows if r["embedding"] is not None and all(v is not None and math.isfinite(v) for v in r["embedding"]) and any(r["embedding"])}
    found = defaultdict(list)
    for r in queries.op9_nearest_neighbours(spark, data).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ids = np.array(sorted(x))
    every = np.stack([x[i] for i in ids])
    hit = 0
    assert set(found) == {i for i in x if i % 20 == 0}
    for query, mine in found.items():
        scores = every @ x[query]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != query][:20]
        assert [r for r, *_ in sorted(mine)] == list(range(1, 21))
        assert all(abs(score - float(x[query] @ x[v])) <= 1e-12 for _, v, score in mine)
        assert [(-s, v) for _, v, s in sorted(mine)] == sorted((-s, v) for _, v, s in mine)
        hit += len({int(ids[i]) for i in order} & {v for _, v, _ in mine})
    assert hit >= 0.9 * 20 * len(found)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_near_duplicates(spark, data, documents):
    prints = {d: fingerprint(t) for d, t in documents}
    groups = components(prints)
    rows = queries.op10_simhash_near_dedup(spark, data).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == sorted((d, f"{p:016x}", groups[d]) for d, p in prints.items())


def test_pipeline_stages_against_plain_versions(spark, data):
    """run()'s stages one by one: each on what its predecessor kept, its decisions in full."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs.collect(), stage(spark, docs, data)
        docs = corpus_pipeline.staged(out, f"plain-{name}")
        kept[name] = (before, docs.collect())
    scores = {r["doc_id"]: r["score"] for r in queries.op2_quality_classifier(spark, data).collect()}
    before, after = kept["quality_classifier"]
    assert Counter(after) == Counter(r for r in before if scores[r["doc_id"]] >= corpus_pipeline.LEAST_SCORE) and len(after) < len(before)

    before, after = kept["simhash_near_dedup"]
    groups = components({r["doc_id"]: fingerprint(r["text"] or "") for r in before})
    assert Counter(after) == Counter(r for r in before if groups[r["doc_id"]] == r["doc_id"]) and len(after) < len(before)

    before, after = kept["secret_scans"]
    found = {r["doc_id"]: r["secrets"] for r in secret_scan.secret_spans(spark.createDataFrame(before)).collect()}
    cleaned = {r["doc_id"]: r for r in after}
    assert len(after) == len(before)
    for r in before:
        out, at = [], 0
        for s in sorted(found[r["doc_id"]], key=lambda s: (s["start"], s["kind"])):
            if s["start"] >= at:
                out += [r["text"][at : s["start"]], "[secret]"]
            at = max(at, s["end"])
        text = "".join(out) + r["text"][at:]
        row = cleaned[r["doc_id"]]
        assert (row["text"], row["lang"], row["source"]) == (text, r["lang"], r["source"]) and row["n_chars"] == (len(text) if found[r["doc_id"]] else r["n_chars"])

    before, after = kept["source_mixing"]
    sizes, copies = Counter(), Counter()
    for r in before:
        sizes[r["source"]] += len(r["text"].encode()) + 1
    for r in before:
        rate = sum(sizes.values()) / len(sizes) / sizes[r["source"]]
        parts = max(1, math.ceil(rate / 64))
        for part in range(1, parts + 1):
            u, mean, k, term, total = int(hashlib.md5(f"{r['doc_id']}|{part}|7".encode()).hexdigest()[:13], 16) / 2**52, rate / parts, 0, 0.0, 0.0
            term = math.exp(-mean)
            total = term
            while total <= u:
                k += 1
                term *= mean / k
                total += term
            copies[r] += k
    assert Counter(after) == +copies

    before, after = kept["best_fit_packing"]
    check_packing(after, [(r["doc_id"], r["text"]) for r in before])
    assert mixing.PART_MEAN == 64 and packing.PIECES.startswith("doc_id")


def test_run_gives_the_last_stage(spark, data):
    rows = corpus_pipeline.run(spark, data)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 100
