"""BPE through a trie, Merkle witnesses and centroid clustering against the library and plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rankfield.llm import bpe, centroids, merkle, queries

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(VOCABULARY)
TRIE = bpe.TrieTokenizer(VOCABULARY)
ODD = [
    "it's we'll 'd''s don’t", "İ. x İ", "é é ﬁ ǅ ß ſ K Å", "<|endoftext|>", "a<|startoftext|>B <|ENDOFTEXT|>", "e<|endoftext|>́x", "日本語 text　wide 😀 ok",
    "a" * 5000, "!?" * 3000, "1234 ٣٤ x1y2", " \t\n ", "", "\x00\x01 \x85 \x1c a", "aaa aaaa aaaaa ababab",
]


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def coded(trie, texts):
    out = []
    for _, ids, ends in trie.encode(pa.array(texts, pa.string())):
        out += [x.tolist() for x in np.split(ids, ends)[:-1]]
    return out


def test_ids_are_the_librarys():
    rng = random.Random(3)
    made = ["".join(rng.choice("aabcdehilnorst é'.-1İ́") for _ in range(rng.randrange(1, 30))) for _ in range(4000)]
    texts = ODD + made
    assert coded(TRIE, texts) == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    assert coded(TRIE, [text]) == [LIBRARY.encode(text, add_special_tokens=False).ids]


def test_a_prefix_is_encoded_once_and_order_does_not_matter(monkeypatch):
    words = [w.encode() for w in "encode encoded encoder encoders encoding enclose end enduring".split()]
    asked = Counter()
    plain = bpe.Trie._last
    monkeypatch.setattr(bpe.Trie, "_last", lambda self, word, depth, path, tokens: (asked.update([(word[:depth], tokens is self.merges.final)]), plain(self, word, depth, path, tokens))[1])
    trie = bpe.Trie(TRIE.merges)
    ids = {w: trie.insert(w) for w in sorted(words)}
    assert set(asked.values()) == {1} and len(asked) == len({w[:n] for w in words for n in range(1, len(w))}) + len(words)
    backwards = bpe.Trie(TRIE.merges)
    assert {w: backwards.insert(w) for w in sorted(words, reverse=True)} == ids
    assert ids == {w: LIBRARY.encode(w.decode(), add_special_tokens=False).ids for w in words}


def test_a_full_trie_is_begun_anew(monkeypatch):
    monkeypatch.setattr(bpe, "TRIE_NODES", 10)
    texts = [f"some words of number{i} and more" for i in range(50)]
    small = bpe.TrieTokenizer(VOCABULARY)
    for _ in range(2):
        assert coded(small, texts) == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_a_token_that_its_own_text_never_gives_is_never_used():
    vocab = {t: i for i, t in enumerate(["a", "b", "c", "ab", "bc", "abc"])}
    merges = bpe.Merges(vocab, [("a", "b"), ("b", "c"), ("a", "bc")], "")
    trie = bpe.Trie(merges)
    assert b"abc" not in merges.inner and trie.insert(b"abc") == [vocab["ab"], vocab["c"]] and trie.insert(b"bc") == [vocab["bc"]]


def test_coding_of_awkward_rows(spark, awkward, no_rows):
    def key(row):
        return str((row[0], bytes(row[1]), row[2]))

    rows = bpe.decode(bpe.encode(awkward, VOCABULARY), VOCABULARY).collect()
    want = []
    for r in awkward.collect():
        ids = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], packed(ids), LIBRARY.decode(ids, skip_special_tokens=False)))
    assert sorted(map(key, rows)) == sorted(map(key, want))
    assert bpe.encode(no_rows, VOCABULARY).collect() == []
    given_ids = spark.createDataFrame([(1, None), (2, b""), (3, packed([320, 10**6, 2**32 - 4, 49407]))], "doc_id long, ids binary")
    found = {r["doc_id"]: r["decoded"] for r in bpe.decode(given_ids, VOCABULARY).collect()}
    assert found == {1: "", 2: "", 3: LIBRARY.decode([320, 49407], skip_special_tokens=False)}


def test_coding_query(spark, data):
    want = []
    for r in pq.read_table(f"{data}/documents.parquet").to_pylist():
        ids = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        said = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert sorted(map(tuple, queries.op11_bpe_coding(spark, data).collect())) == sorted(want)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def said(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(r, text):
    return sha("".join(said(x) for x in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def tree_of(leaves):
    """(root, the siblings of each leaf level by level, as (before, after))."""
    witness, level, of = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for i, w in enumerate(witness):
            run, at = runs[of[i] // 16], of[i] % 16
            w.append(("".join(run[:at]), "".join(run[at + 1 :])))
        level, of = [sha("".join(run)) for run in runs], [x // 16 for x in of]
    return level[0], witness


def plain_manifest(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree_of([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order]
    root, over = tree_of([t[0] for t in trees])
    out = []
    for s, (subroot, witnesses), above in zip(order, trees, over, strict=True):
        for (*_, leaf, r), witness in zip(sorted(sources[s], key=lambda x: x[:3]), witnesses, strict=True):
            out.append((r, leaf, subroot, root, witness + above))
    return out


def many_rows(n):
    rng = random.Random(4)
    return [(i, f"Text {rng.random()}", "en", "hot" if i % 3 else f"s{i % 50}", i, 7, "mine", 0.5) for i in range(n)]


@pytest.mark.parametrize("kind", ["awkward", "many"])
def test_manifest_against_a_plain_one(spark, awkward, kind):
    docs = awkward if kind == "awkward" else spark.createDataFrame(many_rows(6500), awkward.schema).repartition(7)
    rows = merkle.manifest(docs).collect()
    want = plain_manifest(docs.collect())
    assert sorted((r["leaf"], r["subroot"], r["root"], tuple(map(tuple, r["witness"])), str(r["doc_id"]), str(r["source"])) for r in rows) == sorted(
        (leaf, subroot, root, tuple(witness), str(r["doc_id"]), str(r["source"])) for r, leaf, subroot, root, witness in want
    )
    assert kind == "awkward" or max(Counter(r["source"] for r in rows).values()) > merkle.FANOUT**merkle.BLOCK_LEVELS  # several blocks


def test_small_blocks_climb_several_times(spark, awkward):
    docs = spark.createDataFrame(many_rows(1500), awkward.schema).repartition(5)
    found = {r["doc_id"]: (r["root"], [tuple(s) for s in r["witness"]]) for r in merkle.manifest(docs, block_levels=1).collect()}
    assert found == {r["doc_id"]: (root, witness) for r, _, _, root, witness in plain_manifest(docs.collect())}


def test_manifest_of_nothing_and_of_one_row(spark, no_rows, awkward):
    assert merkle.manifest(no_rows).collect() == []
    (row,) = merkle.manifest(awkward.filter("doc_id = 300")).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["witness"] == []


def test_tampering_shows(spark, data):
    rows = {r["doc_id"]: r for r in queries.op12_merkle_manifest(spark, data).collect()}
    changed = 0
    for r, leaf, subroot, root, witness in plain_manifest(pq.read_table(f"{data}/documents.parquet").to_pylist()):
        row, text = rows[r["doc_id"]], r["text"]
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        node = leaf_of(r, text)
        for before, after in witness:
            node = sha(before + node + after)
        assert tuple(row) == (r["doc_id"], leaf, subroot, root, sha("".join(a + b for a, b in witness)), node, node == root)
        assert row["verified"] == (text == r["text"])
        changed += text != r["text"]
    assert len(rows) == len(set(rows)) and changed > 10


def plain_clusters(vectors, k, rounds, seed):
    """(vec_id, cluster, distance) and the centroids; whole numbers of any size."""
    order = sorted(vectors, key=lambda r: (sha(f"{seed}:{'' if r[0] is None else r[0]}"), r[1]))
    found = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(found))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in vectors:
            own[nearest(v)[1]].append(v)
        for n, members in own.items():
            found[n] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return [(name, nearest(v)[1], nearest(v)[0]) for name, v in vectors], found


def whole(rows, components, scale):
    ok = [(r[0], r[1]) for r in rows if r[1] is not None and len(r[1]) == components and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(name, [math.floor(scale * x) for x in v]) for name, v in ok]


VECTORS = "vec_id long, embedding array<double>, label int, vector string, cluster string"


@pytest.mark.parametrize(("n", "k", "rounds"), [(400, 7, 4), (5, 16, 3), (60, 1, 2), (300, 16, 0)])
def test_clusters_against_plain_ones(spark, n, k, rounds):
    rng = random.Random(n)
    rows = [(i, [rng.gauss(i % 5, 1) for _ in range(4)], 1, "mine", None) for i in range(n)]
    rows += [(None, [0.5, 1.0, -2.0, 0.0], None, None, None), (3, rows[3][1], 0, "", ""), (3, [9.0, -9.0, 0.0, 1.0], 0, "", ""), (n, rows[0][1], 0, "", "")]
    rows += [(n + 1, None, 1, "", ""), (n + 2, [1.0] * 3, 1, "", ""), (n + 3, [1.0, None, 1.0, 1.0], 1, "", ""), (n + 4, [math.nan, 0.0, 0.0, 0.0], 1, "", "")]
    rows += [(n + 5, [math.inf, 0.0, 0.0, 0.0], 1, "", ""), (n + 6, [0.0] * 4, 1, "", ""), (n + 7, [], 1, "", "")]
    assigned, found = centroids.cluster(spark.createDataFrame(rows, VECTORS).repartition(3), k, rounds, 1, 4, 16)
    want, plain = plain_clusters(whole(rows, 4, 16), k, rounds, 1)
    assert found.tolist() == plain
    assert sorted(map(str, map(tuple, assigned.collect()))) == sorted(map(str, want))


def test_no_vectors_no_clusters(spark):
    assigned, found = centroids.cluster(spark.createDataFrame([(1, None, 1, "", "")], VECTORS), 16, 3, 1, 64, 64)
    assert assigned.collect() == [] and found.shape == (0, 64) and assigned.columns == ["vec_id", "cluster", "distance"]


def test_products_change_only_where_centroids_move(spark):
    """The kept products equal those made anew after every round."""
    rng = np.random.default_rng(6)
    vectors = rng.integers(-60, 60, (200, 8))
    old = vectors[:5].copy()
    new = old.copy()
    new[1, 3] += 4
    new[4] -= 1
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, vector array<long>")
    begun = frame.mapInArrow(centroids._begun(old), centroids._STATE)
    moved = {r["vec_id"]: r for r in begun.mapInArrow(centroids._moved(new - old, new), centroids._STATE).collect()}
    for i, v in enumerate(vectors):
        assert moved[i]["dots"] == (new @ v).tolist() and moved[i]["norm"] == int(v @ v)
        assert (moved[i]["distance"], moved[i]["cluster"]) == min((int(((v - c) ** 2).sum()), n) for n, c in enumerate(new))


def test_clustering_query(spark, data):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{data}/embeddings.parquet").to_pylist()]
    want, found = plain_clusters(whole(rows, 64, 64), 16, 3, 1)
    sums = Counter()
    for _, c, d in want:
        sums[c] += d
    digests = [sha(",".join(map(str, c))) for c in found]
    expected = [(name, c, d, sums[c], sum(sums.values()), digests[c]) for name, c, d in want]
    assert sorted(map(tuple, queries.op13_centroid_clustering(spark, data).collect())) == sorted(expected)
