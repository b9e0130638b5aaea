"""Nearest vectors, Jaccard join and components."""

import random
import re
import string

import numpy as np
import pytest
from odd_tables import ROWS, rows_of
from pyspark.sql import functions as F
from skillgrid.llm import jaccard_join
from skillgrid.llm.components import components
from skillgrid.llm.jaccard_join import JaccardSettings, PartEnum
from skillgrid.llm.vector_search import nearest_vectors

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_nearest(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows
            if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for q, x in good:
        if q % every == 0:
            near = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(x, y)))), i) for i, y in good
                          if i != q and len(y) == len(x))[:k]
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return sorted(out)


def test_nearest_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, np.round(rng.normal(size=8), 1).tolist()) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(40)]  # ties
    rows += [(500, None), (501, [0.0] * 8), (502, [1.0, None] * 4), (503, [float("nan")] * 8), (504, [float("inf")] * 8),
             (505, []), (510, [1.0, 2.0]), (511, [2.0, 1.0]), (None, [1.0] * 8), (520, [1e-30] * 8), (530, [1e30] * 8)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit(1))
    got = nearest_vectors(table, F.col("vec_id") % 10 == 0, k=5, query_block=16, candidate_block=64, slices=3)
    want = brute_nearest(rows, 10, 5)
    assert [r[:3] for r in sorted(map(tuple, got.collect()))] == [r[:3] for r in want]
    assert [r[3] for r in sorted(map(tuple, got.collect()))] == pytest.approx([r[3] for r in want], rel=1e-12)


def test_nearest_vectors_on_small_tables(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert nearest_vectors(empty, F.col("vec_id") % 2 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.5]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [r.vec_id for r in nearest_vectors(few, F.col("vec_id") == 0).collect()] == [1]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, n):
    w = words_of(text)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, similar):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        known = [x for x in (smallest.get(top(i)), doc_id) if x is not None]
        smallest[top(i)] = min(known, default=None)
    return sorted(((rows[i][0], len(sets[i]), smallest[top(i)]) for i in range(len(rows))), key=repr)


def edited(rng, words, share):
    return [w if rng.random() > share else rng.choice("abcdefgh") * 3 for w in words]


def near_copies(seed):
    rng = random.Random(seed)
    rows = []
    for base in range(25):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 5, 8, 20, 60, 200, 400]))]
        for copy in range(rng.choice([1, 2, 8])):
            rows.append((len(rows), " ".join(edited(rng, words, rng.choice([0, 0.005, 0.01, 0.02, 0.05])))))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(len(rows) + i, passage + " " + " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(80))) for i in range(20)]
    return rows


@pytest.mark.parametrize("seed,n,similar", [(1, 4, 85), (2, 5, 80), (3, 4, 85)])
def test_components_equal_brute_force(spark, seed, n, similar):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = rows_of(jaccard_join.jaccard_components(docs, JaccardSettings(words=n, similar=similar)))
    assert got == brute_components(rows, n, similar)


def test_similar_sets_share_a_signature():
    """The promise of the signatures, on random pairs at the very edge of the similarity."""
    rng = np.random.default_rng(6)
    for similar in (80, 85):
        scheme = PartEnum(JaccardSettings(similar=similar))
        for _ in range(300):
            union = int(rng.integers(1, 900))
            common = -(-similar * union // 100)
            items = rng.integers(0, 2 ** 63, union).astype(np.uint64)
            owner = rng.integers(0, 2, union - common)
            a = np.unique(np.concatenate((items[:common], items[common:][owner == 0])))
            b = np.unique(np.concatenate((items[:common], items[common:][owner == 1])))
            if len(a) and len(b) and 100 * len(np.intersect1d(a, b)) >= similar * len(np.union1d(a, b)):
                assert set(scheme.signatures(a).tolist()) & set(scheme.signatures(b).tolist())


def test_members_that_miss_the_representative_are_still_linked(spark):
    """A chain: each text links with its neighbours only, so one comparison per bucket is not enough."""
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i:3 * i + 100])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(jaccard_join.jaccard_components(docs, JaccardSettings(4, 85))) == brute_components(rows, 4, 85)


def test_jaccard_on_odd_tables(spark, odd_docs, no_docs, clashing_docs):
    got = rows_of(jaccard_join.jaccard_components(odd_docs, JaccardSettings(4, 85)))
    assert got == brute_components([(r[0], r[1]) for r in ROWS], 4, 85)
    assert jaccard_join.jaccard_components(no_docs).count() == 0
    kept = jaccard_join.one_per_component(clashing_docs, JaccardSettings(4, 85))
    assert kept.columns == clashing_docs.columns
    # Texts without words stay; of the linked ones one stays, a null id first.
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, [None, 3, 4, 5, 6, 7, 8, 9, 10]))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(100, 200), (200, 150)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(links, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(71)}, 100: 100, 150: 100, 200: 100}


def test_outlines_bound_the_differing_shingles_from_below():
    rng = np.random.default_rng(5)
    for size in (1, 3, 40, 130, 1000, 5000):
        for changed in (0, 1, size // 10, size // 2, size):
            left = rng.integers(0, 2**64, size, dtype=np.uint64)
            right = np.concatenate((left[changed:], rng.integers(0, 2**64, changed + size // 20, dtype=np.uint64)))
            differing = 2 * changed + size // 20
            x, y = (np.frombuffer(jaccard_join.outline(s), np.int8).astype(int) for s in (left, right))
            cells = min(len(x), len(y))
            apart = np.abs(x.reshape(-1, cells).sum(axis=0) - y.reshape(-1, cells).sum(axis=0)).sum()
            assert apart <= differing
            if changed == size > 100:
                assert apart > size // 4  # unrelated sets are told apart


@pytest.mark.parametrize("similar", [80, 85])
def test_linked_sets_share_a_signature(similar):
    """Whatever unselective signatures both leave out; among them sets with many small partitions."""
    rng, settings = np.random.default_rng(similar), jaccard_join.JaccardSettings(similar=similar)
    scheme = jaccard_join.PartEnum(settings)
    for _ in range(600):
        size = int(rng.integers(1, 400))
        pool = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        most = (settings.whole - similar) * len(pool) // settings.whole
        gone = int(rng.integers(0, most + 1))
        keep = np.ones(len(pool), bool)
        # The pair shares all of ``pool`` but ``gone`` shingles, dealt over both sides.
        places = rng.permutation(len(pool))[:gone]
        half = int(rng.integers(0, gone + 1))
        keep_left, keep_right = keep.copy(), keep.copy()
        keep_left[places[:half]] = False
        keep_right[places[half:]] = False
        left, right = pool[keep_left], pool[keep_right]
        both, union = len(np.intersect1d(left, right)), len(np.union1d(left, right))
        assert settings.whole * both >= similar * union
        assert set(scheme.signatures(left).tolist()) & set(scheme.signatures(right).tolist())


def test_a_pair_that_shares_far_apart_signatures_is_compared_once(spark):
    """Eight signatures of their own lie between the two that the sets share."""
    shared, own = [0, 100], {1: range(10, 18), 2: range(20, 28)}
    rows = [(s, node, node) for node in own for s in [*shared, *own[node]]]
    buckets = spark.createDataFrame(rows, "_sig bigint, _node bigint, _c bigint")
    shingles = np.arange(100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    outlines = spark.createDataFrame([(n, 100, bytearray(jaccard_join.outline(shingles))) for n in own], "_node bigint, _n bigint, _outline binary")
    pairs = [tuple(sorted(p)) for p in jaccard_join._open_pairs(buckets, outlines, JaccardSettings()).collect()]
    assert pairs == [(1, 2)]
