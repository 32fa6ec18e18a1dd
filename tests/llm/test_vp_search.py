import numpy as np
import pytest

from resolver_audit.llm.vp_search import VpSearch, VpTree, products

QUERY = "vec_id % 20 = 0"


def brute(rows, k=20):
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], dtype=np.float32).astype(float)
    scores, out = products(x, x), []
    for a, i in enumerate(ids):
        if i % 20 == 0:
            near = sorted((-scores[a, b], j) for b, j in enumerate(ids) if j != i)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(near, 1)]
    return sorted(out)


def rows_of(frame):
    return [(r.vec_id, r.embedding) for r in frame.collect()]


def test_factor_one_is_exact(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    found = VpSearch(factor=1.0, shard=100, block=7, leaf=8).search(vectors, QUERY)
    assert sorted(map(tuple, found.collect())) == brute(rows_of(vectors))


def test_recall_of_the_production_factor(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    exact = {(q, v) for q, _, v, _ in brute(rows_of(vectors))}
    found = {(r.query_id, r.vec_id) for r in VpSearch(factor=0.35, shard=500).search(vectors, QUERY).collect()}
    assert len(found) == len(exact) and len(found & exact) >= 0.95 * len(exact)


def test_ties_lengths_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    fine = [(i, [1.0, 0.5]) for i in range(0, 90)] + [(200, [3.0, -1.0]), (220, [-1.0, 0.0]), (240, [0.0, 1e-3])]
    bad = [(100, None), (120, []), (140, [0.0, 0.0]), (160, [nan, 1.0]), (180, [inf, 1.0]), (190, [None, 1.0]), (260, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame([(*r, 1) for r in fine + bad], "vec_id long, embedding array<float>, shard int")
    found = VpSearch(leaf=4, shard=30).search(vectors, QUERY).collect()
    assert sorted(map(tuple, found)) == brute(fine)


def test_few_and_no_vectors(spark):
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (7, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in VpSearch().search(vectors, QUERY).collect()] == [(0, 1, 7, 4.0)]
    assert VpSearch().search(vectors.limit(0), QUERY).count() == 0
    assert VpSearch().search(vectors.filter("vec_id = 7"), QUERY).count() == 0


@pytest.mark.parametrize("leaf", [1, 5, 1000])
def test_tree_survives_storage(leaf):
    rng = np.random.default_rng(leaf)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    top = float(np.sqrt((x.astype(float) ** 2).sum(axis=1).max()))
    tree = VpTree.load(VpTree.build(np.arange(300), x, top, leaf).dump())
    q, ids, scores = tree.search(np.arange(0, 300, 30), x[::30], 5, top, 1.0).rows()
    full = products(x[::30].astype(float), x.astype(float))
    for a, query in enumerate(range(0, 300, 30)):
        full[a, query] = -np.inf
        best = np.lexsort((np.arange(300), -full[a]))[:5]
        assert ids[q == query].tolist() == best.tolist() and (scores[q == query] == full[a, best]).all()
