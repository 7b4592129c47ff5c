"""Whitening and clustering of vectors against plain numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.llm import centroids, queries, sql, whitening
from echogrid.llm.moments import Moments

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>"


def odd_vectors(spark, dim=64):
    """Nulls, other lengths, non-finite components, repeated rows, ties, null ids, clashing columns."""
    r = np.random.default_rng(5)
    v = r.normal(size=(90, dim)).astype("f4")
    rows = [(i, v[i].tolist()) for i in range(80)] + [(7, v[7].tolist())] * 3 + [(200 + i, v[3].tolist()) for i in range(40)]
    rows += [(300, None), (301, [None] + v[0, 1:].tolist()), (302, [float("nan")] * dim), (303, [float("inf")] + v[0, 1:].tolist()), (None, v[81].tolist())]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    return df.withColumns({c: F.lit("x") for c in ("id", "v", "x", "h", "component", "cluster", "label", "n", "one")})


def plain_whitening(rows):
    x = np.floor(64 * np.array([v for _, v in rows], float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, total = len(u), u.sum(axis=0)
    c = u - total / n
    e, w = np.linalg.eigh(c.T @ c / n)
    e, w = e[::-1], w[:, ::-1]
    k = min(16, x.shape[1])
    return n, ((n * x - total) ** 2).sum(axis=1), (x - total / n) @ w[:, :k] / np.sqrt(np.where(e[:k] > 1e-9, e[:k], np.inf)), e[:k] / e.sum()


def compare_whitening(got, rows):
    n, deviation, white, explained = plain_whitening(rows)
    k = white.shape[1]
    assert len(got) == len(rows) * k and {r.n for r in got} == {n} and max(r.identity_error for r in got) <= 1e-9
    assert len({r.identity_error for r in got}) == 1
    key = lambda i, d: (i is None, i or 0, d)
    want = sorted(range(len(rows)), key=lambda j: key(rows[j][0], int(deviation[j])))
    got = sorted(got, key=lambda r: (r.component, *key(r.vec_id, r.deviation)))
    assert [r.deviation for r in got[: len(rows)]] == [int(deviation[j]) for j in want]
    a, b = np.array([r.whitened for r in got]).reshape(k, -1).T, white[want]
    assert np.abs(a * np.sign((a * b).sum(axis=0)) - b).max() < 1e-6
    assert np.allclose([r.explained for r in got[:: len(rows)]], explained)


def test_whitening(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compare_whitening(queries.op11_embedding_whitening(spark, SF).collect(), rows)


def test_whitening_of_odd_rows(spark):
    df = odd_vectors(spark)
    kept = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding is not None and np.isfinite(np.array(r.embedding, float)).all()]
    compare_whitening(whitening.whitened(df).collect(), kept)


def test_whitening_without_variance(spark):
    """Fewer vectors than dimensions: no value along components without variance; other lengths are filled up."""
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.5, 3.0]), (3, [1.0, 2.0])], VECTORS)
    got = {(r.vec_id, r.component): r for r in whitening.whitened(df).collect()}
    assert len(got) == 9 and all(got[i, 3].whitened == 0 for i in (1, 2, 3)) and got[1, 1].identity_error < 1e-9 and got[1, 1].n == 3
    one = whitening.whitened(df.where("vec_id = 1")).collect()
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in one] == [(0.0, 0.0, 0, 0.0)] * 3
    none = whitening.whitened(df.where("vec_id > 5"))
    assert none.collect() == [] and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_beyond_doubles():
    """Exact where products pass 2^53 and 2^63; None where the sum passes a long."""
    x = np.array([[2**40, -3], [5, 7]], np.int64)
    w = whitening.Whitening(3, np.array([2**41 + 1, 9], object), 0, np.ones(2), np.eye(2), np.ones(2))
    assert w.deviation(x)[1] == None and w.deviation(x[1:] // 2)[0] is None  # noqa: E711
    w.total = np.array([2**30 + 1, 9], object)
    assert w.deviation(x[1:]) == [(15 - 2**30 - 1) ** 2 + 12**2]
    with pytest.raises(ValueError, match="beyond"):
        import pyarrow as pa

        whitening._entries(pa.array([[2**50]]), 1, 0)


def test_moments_merge_in_any_order():
    x = np.random.default_rng(1).normal(size=(500, 6)) + 1e6
    whole = Moments.of(x)
    parts = [Moments.of(x[a:b]) for a, b in ((0, 1), (1, 1), (1, 300), (300, 500))]
    for order in ((0, 1, 2, 3), (3, 1, 0, 2)):
        m = parts[order[0]] + parts[order[1]] + (parts[order[2]] + parts[order[3]])
        assert m.n == 500 and np.allclose(m.mean, whole.mean, rtol=1e-15) and np.allclose(m.scatter, np.cov(x.T, bias=True) * 500, rtol=1e-6)


def plain_clusters(rows, k=40, rounds=5):
    x = np.floor(256 * np.array([v for _, v in rows], float)).astype(np.int64)
    h = [hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "z" for i, _ in rows]
    c = x[sorted(range(len(rows)), key=lambda j: (h[j], x[j].tolist()))[:k]]
    for r in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        a = d.argmin(axis=1)
        if r < rounds:
            c = np.array([x[a == j].sum(axis=0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    d = d.min(axis=1)
    name = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in c]
    return [(i, int(a[j]), int(d[j]), int(d[a == a[j]].sum()), int(d.sum()), name[a[j]]) for j, (i, _) in enumerate(rows)]


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("block", [1024, 37])
def test_clusters(spark, monkeypatch, block):
    monkeypatch.setattr(centroids, "BLOCK", block)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert by_id(queries.op12_centroid_clustering(spark, SF).collect()) == by_id(plain_clusters(rows))


def test_clusters_of_odd_rows(spark):
    df = odd_vectors(spark).unionByName(odd_vectors(spark, 63).limit(3))
    kept = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding is not None and len(r.embedding) == 64 and np.isfinite(np.array(r.embedding, float)).all()]
    assert by_id(centroids.clustered(df).collect()) == by_id(plain_clusters(kept))
    few = df.where("vec_id < 5")
    assert by_id(centroids.clustered(few).collect()) == by_id(plain_clusters([r for r in kept if r[0] is not None and r[0] < 5]))
    none = centroids.clustered(df.where("vec_id = 300"))
    assert none.collect() == [] and len(none.columns) == 6
    with pytest.raises(Exception, match="beyond"):
        centroids.clustered(spark.createDataFrame([(1, [1e30] * 64)], VECTORS)).collect()


def test_trees_find_the_nearest():
    """Clustered and repeated vectors, so that nodes are left out and ties are met."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.integers(-2000, 2000, 8) + r.integers(-9, 9, (60, 8)) for _ in range(12)] + [np.full((50, 8), 7)])
    t = centroids.cover_tree(x)
    assert sorted(t.order) == list(range(len(x)))
    for i in range(len(t.centre)):
        own = x[t.order[t.lo[i] : t.hi[i]]]
        assert np.sqrt(((own - x[t.centre[i]]) ** 2).sum(axis=1)).max() <= t.radius[i] + 1e-6
        if not t.leaf[i]:
            kids = x[t.centre[t.first[i] : t.last[i]]]
            assert t.centre[t.first[i]] == t.centre[i]
            apart = 2.0 ** (np.ceil(np.log2(t.radius[i])) - 1)
            d = np.sqrt(((kids[:, None] - kids[None]) ** 2).sum(axis=2))[np.triu_indices(len(kids), 1)]
            assert (d > apart).all() and (t.radius[t.first[i] : t.last[i]] <= apart + 1e-6).all()
    for c in (x[::37], np.concatenate([x[:5], x[:5]]), x[:1]):
        got, d = centroids.nearest(x, t, c, centroids.cover_tree(c, centroids.CENTROID_LEAF))
        all_d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (got == all_d.argmin(axis=1)).all() and (d == all_d.min(axis=1)).all()


def test_cluster_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = db.execute(sql.SQL["op12_centroid_clustering"]).fetchall()
    assert by_id(want) == by_id(queries.op12_centroid_clustering(spark, SF).collect())
