"""The operators on vectors against brute force, and their odd rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafline.llm import annulus, permutation_index, queries, whitening
from leafline.llm.common import read_table

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows, kind="float"):
    """A table whose other columns clash with names used inside."""
    return spark.createDataFrame([(i, v, 7, 1, "x", 0.5) for i, v in rows], f"vec_id long, embedding array<{kind}>, id int, dim int, v string, score double")


def held(table):
    rows = table.collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)


# ---- centroid clustering


def plain_clusters(ids, x, k, rounds, seed=3):
    """Lloyd's rounds over all pairs in Python's whole numbers."""
    order = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"{seed}:{ids[i]}".encode()).hexdigest(), x[i]))
    centroids = [list(x[i]) for i in order[:k]]

    def assign():
        out = []
        for v in x:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        own = assign()
        for c in range(len(centroids)):
            members = [v for v, (at, _) in zip(x, own, strict=True) if at == c]
            if members:
                centroids[c] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    own = assign()
    inertia = [sum(d for at, d in own if at == c) for c in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, at, d, inertia[at], sum(inertia), digest[at]) for i, (at, d) in zip(ids, own, strict=True))


@pytest.mark.parametrize("spreads", [0.02, 3.0])
def test_clusters_equal_brute_force(spark, spreads):
    rng = np.random.default_rng(2)
    # norms far apart, so that annuli leave centroids out; many ties on a coarse grid
    rows = [(i, [float(x) for x in np.round(rng.normal(0, spreads, 3) * (1 + i % 5), 1)]) for i in range(240)]
    rows += [(i, rows[i][1]) for i in range(40)] + [(None, [0.5, 0.5, 0.5])]
    table = vectors(spark, rows)
    x = [[int(np.floor(1024 * np.float64(np.float32(c)))) for c in v] for _, v in rows if _ is not None]
    got = sorted(map(tuple, annulus.clustered(table.where("vec_id is not null"), 8, 6, 3).collect()))
    assert got == plain_clusters([i for i, _ in rows if i is not None], x, 8, 6)
    assert annulus.clustered(table, 8, 6, 3).count() == len(rows)


def test_an_annulus_leaves_out_centroids_but_never_the_nearest():
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(0, 1, (3000, 4)) * rng.uniform(0, 3000, (3000, 1)))
    c = [[int(x) for x in row] for row in v[rng.choice(3000, 60, replace=False)]] + [[0, 0, 0, 0]] * 2
    cluster, distance = annulus.assigned(v, c)
    full = ((v[:, None, :] - np.array(c)[None]) ** 2).sum(2)
    assert (cluster == full.argmin(1)).all() and (distance == full.min(1)).all()


def test_clusters_of_large_components_and_odd_rows(spark):
    big = [[3e6, -3e6], [3e6 + 1, -3e6], [1e9, 1e9], [-1e9, 1e9], [0.0, 0.0], [5.0, 5.0]]
    rows = list(enumerate(big)) + [(9, None), (10, []), (11, [1.0]), (12, [None, 1.0]), (13, [NAN, 1.0]), (14, [INF, 1.0]), (15, [1e30, 1.0])]
    table = vectors(spark, rows, "double")
    x = [[int(np.floor(1024 * c)) for c in v] for v in big]
    want = [tuple(min(y, annulus.LARGEST) if isinstance(y, int) else y for y in r) for r in plain_clusters(range(6), x, 3, 4)]
    assert sorted(map(tuple, annulus.clustered(table, 3, 4, 2).collect())) == want
    empty = annulus.clustered(table.where("false"), 3, 4, 2)
    assert empty.columns == annulus.clustered(table, 3, 4, 2).columns and empty.count() == 0
    assert {r.cluster for r in annulus.clustered(table.where("vec_id < 2"), 8, 10, 2).collect()} == {0, 1}


def test_clusters_of_more_pages_than_a_batch_equal_sql(spark, sf, duck, same):
    same(queries.op11_annulus_clusters(spark, sf), duck, queries.ORACLES["op11_annulus_clusters"])


# ---- whitening


def plain_whitening(ids, v, most=16):
    x = np.floor(64 * v).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    y = (fit - s // n) - (s % n) / n
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1][:most], basis[:, ::-1][:, :most]
    return n, ((n * x - s) ** 2).sum(1), ((x - s // n) - (s % n) / n) @ basis / np.sqrt(values), values / np.trace(y.T @ y / n)


def compare_whitening(table, got, most=16):
    ids, v = held(table)
    n, deviation, white, share = plain_whitening(ids, v, most)
    rows = got.toPandas()
    assert len(rows) == len(ids) * len(share)
    wide = rows.drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    sign = np.sign((wide * white).sum(0))
    assert np.abs(wide * sign - white).max() < 1e-8
    assert set(rows.n) == {n} and rows.identity_error.max() < 1e-9
    assert np.allclose(rows.groupby("component").explained.first(), share, rtol=1e-9)
    first = rows.drop_duplicates("vec_id").set_index("vec_id").deviation.loc[ids]
    assert (first.to_numpy() == deviation).all()


def test_whitening_equals_a_dense_solver(spark, sf):
    table = read_table(spark, sf, "embeddings")
    compare_whitening(table, queries.op12_lanczos_whitening(spark, sf))


def test_whitening_with_repeats_few_dimensions_and_a_hot_vector(spark):
    rng = np.random.default_rng(4)
    base = [[float(x) for x in rng.normal(100, [1, 5, 0.3, 2, 9])] for _ in range(60)]
    rows = list(enumerate(base)) + [(100 + i, base[0]) for i in range(90)]
    table = vectors(spark, rows, "double")
    compare_whitening(table, whitening.whitened(table, 16))
    compare_whitening(table, whitening.whitened(table, 2), 2)


def test_whitening_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [4.0, 4.5]), (4, None), (5, []), (6, [None, 1.0]), (7, [NAN, 1.0]), (8, [INF, 1.0]), (9, [1.0]), (10, [1e15, 0.0]), (None, [1.0, 2.0])]
    table = vectors(spark, rows, "double")
    got = whitening.whitened(table).collect()
    assert sorted({(r.vec_id is None, r.vec_id or 0) for r in got}) == [(False, 1), (False, 2), (False, 3), (True, 0)]
    assert {r.component for r in got} == {1, 2} and {r.n for r in got} == {3}
    assert whitening.whitened(table.where("false")).count() == 0
    assert whitening.whitened(table.where("vec_id = 1")).count() == 0  # no spread: nothing to whiten
    line = vectors(spark, [(i, [float(i), 2.0 * i, 3.0]) for i in range(9)], "double")
    assert {r.component for r in whitening.whitened(line).collect()} == {1}


def test_lanczos_breaks_down_and_starts_again():
    rng = np.random.default_rng(6)
    q = np.linalg.qr(rng.normal(size=(120, 120)))[0]
    values = np.concatenate([[50.0] * 5, [9.0, 9.0, 4.0], np.zeros(112)])  # an invariant space is met at once
    matrix = (q * values) @ q.T
    got, basis = whitening.lanczos(lambda b: matrix @ b, 120, 8, block=3)
    assert np.allclose(got, values[:8]) and np.abs(matrix @ basis - basis * got).max() < 1e-9
    assert np.allclose(basis.T @ basis, np.eye(8), atol=1e-12)
    calls = []
    spectrum = 0.8 ** np.arange(120)
    matrix = (q * spectrum) @ q.T
    got, _ = whitening.lanczos(lambda b: calls.append(b.shape[1]) or matrix @ b, 120, 8, block=8)
    assert np.allclose(got, spectrum[:8], rtol=1e-10) and sum(calls) < 120  # converged before the space was full


# ---- approximate neighbours


def plain_nearest(ids, x, asked, k):
    out = {}
    for i in asked:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        others = np.flatnonzero(ids != ids[i])
        out[int(ids[i])] = [(int(ids[j]), d[j]) for j in others[np.lexsort((ids[others], d[others]))][:k]]
    return out


def test_permutation_index_recall(spark, sf):
    ids, x = held(read_table(spark, sf, "embeddings"))
    want = plain_nearest(ids, x, np.flatnonzero(ids % 100 == 0), 10)
    got = queries.op13_permutation_index(spark, sf).collect()
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {(q, i): d for q in want for i, d in want[q]}
    assert all(r.score == pytest.approx(exact[r.query_id, r.vec_id], rel=1e-12) for r in got if (r.query_id, r.vec_id) in exact)
    for q in want:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)


def test_permutation_index_recall_beside_a_crowd(spark):
    rng = np.random.default_rng(8)
    crowd = rng.normal(size=24)
    x = np.concatenate([rng.normal(size=(4000, 24)), crowd + rng.normal(scale=0.01, size=(2000, 24))])
    table = vectors(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)], "double")
    want = plain_nearest(np.arange(6000), x, range(0, 6000, 100), 10)
    got = permutation_index.nearest(table, table.where("vec_id % 100 = 0"), 10).collect()
    assert sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got) >= 0.9 * 600
    assert len(got) == 600


def test_agreements_are_the_complement_of_footrule():
    rng = np.random.default_rng(9)
    x, reference = rng.normal(size=(50, 6)), rng.normal(size=(20, 6))
    order = permutation_index.nearest_pivots(x, reference, 8)
    place = np.tile(np.arange(8, dtype=np.uint8), 50)
    by = np.lexsort((place, order.ravel()))
    starts = np.searchsorted(order.ravel()[by], np.arange(21))
    agree = permutation_index.agreements(order[0], starts, np.repeat(np.arange(50), 8)[by], place[by], 50, 8)
    for i in range(50):
        at = {p: j for j, p in enumerate(order[i].tolist())}
        assert agree[i] == sum(8 - abs(at[p] - j) for j, p in enumerate(order[0].tolist()) if p in at)


def test_permutation_index_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [3.0, 4.0]), (5, None), (6, []), (7, [None, 1.0]), (8, [NAN, 1.0]), (9, [0.0, 0.0]), (None, [1.0, 1.0]), (10, [1.0, 2.0, 3.0]), (11, [1e200, 0.0]), (12, [INF, 0.0])]
    table = vectors(spark, rows, "double")
    got = permutation_index.nearest(table, table, 3).orderBy("query_id", "rank").collect()
    of = lambda q: [(r["rank"], r.vec_id, r.score) for r in got if r.query_id == q]
    assert of(2) == [(1, 3, 0.0), (2, 3, 0.0), (3, 1, pytest.approx(2**0.5))]
    assert of(3) == [(1, 2, 0.0), (2, 1, pytest.approx(2**0.5)), (3, 4, pytest.approx(18**0.5))]
    assert of(10) == [] and of(5) == [] and of(9) == []
    assert [v for _, v, _ in of(11)] == [1, 2, 3] and of(11)[0][2] == 1e200
    assert permutation_index.nearest(table.where("false"), table, 3).count() == 0
    assert permutation_index.nearest(table, table.where("false"), 3).count() == 0
    assert permutation_index.nearest(table.where("vec_id < 3"), table.withColumn("rank", F.lit(1)), 9).count() == 8
