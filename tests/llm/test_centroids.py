import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factsheet.llm import centroids
from factsheet.llm.oracle import op11_sql
from factsheet.llm.queries import op11_centroids
from tests.conftest import SMALL


def brute(rows, k, rounds, dimension):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(max(min(256 * x, 2**27), -(2**27))) for x in v]))
    text = [("" if i is None else str(i), p) for i, p in kept]
    order = sorted(range(len(kept)), key=lambda j: (hashlib.sha256(f"2:{text[j][0]}".encode()).hexdigest(), text[j][1]))
    middle = [list(kept[j][1]) for j in order[:k]]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), n) for n, c in enumerate(middle))

    for _ in range(rounds):
        groups = {}
        for _, p in kept:
            groups.setdefault(nearest(p)[1], []).append(p)
        for n, g in groups.items():
            middle[n] = [sum(x) // len(g) for x in zip(*g)]
    return sorted((str(i), nearest(p)[1], nearest(p)[0]) for i, p in kept), middle


def got(found):
    return sorted((str(r.vec_id), r.cluster, r.distance) for r in found.assigned.collect())


def vectors(spark, rows):
    return spark.createDataFrame([(1, i, v, 0) for i, v in rows], "cluster int, vec_id long, embedding array<float>, distance int")


def test_odd_vectors(spark):
    rng = random.Random(3)
    inf, nan = math.inf, math.nan
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.5, 2.0]) for _ in range(4)]) for i in range(60)]
    rows += [(None, [1.0, 1.0, 1.0, 1.0]), (None, [0.0, 0.0, 0.0, 1.0]), (5, [0.5, 0.5, 0.5, 0.5]), (5, [0.5, 0.5, 0.5, 0.5])]
    rows += [(70, None), (71, []), (72, [1.0, 2.0, 3.0]), (73, [1.0, None, 1.0, 1.0]), (74, [nan, 0.0, 0.0, 0.0]), (75, [0.0, 0.0, inf, 0.0])]
    rows += [(80, [3e38, -3e38, 0.0, 0.0]), (81, [1e7, 0.0, 0.0, 0.0])]
    for k, rounds in ((5, 3), (40, 5), (1, 1), (500, 2)):
        expected, middle = brute(rows, k, rounds, 4)
        found = centroids.cluster(vectors(spark, rows), k, rounds, 4)
        assert got(found) == expected
        assert [r.centroid for r in found.centroids.orderBy("cluster").collect()] == middle
        held = {r.cluster: (r.n, r.inertia) for r in found.centroids.collect()}
        for c in range(len(middle)):
            of = [d for _, n, d in expected if n == c]
            assert held[c] == (len(of), sum(of))
    empty = centroids.cluster(vectors(spark, rows).limit(0), 5, 2, 4)
    assert empty.assigned.count() == 0 and empty.centroids.count() == 0
    assert centroids.cluster(vectors(spark, rows[-8:-2]), 5, 2, 4).assigned.count() == 0


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_bounds_lose_no_centroid(data):
    cell = st.integers(-3, 3) | st.integers(-(2**27), 2**27)
    row = st.lists(cell, min_size=3, max_size=3)
    points = np.array(data.draw(st.lists(row, min_size=1, max_size=30)), np.int64)
    middle = np.array(data.draw(st.lists(row, min_size=1, max_size=8)), np.int64)
    fixed = centroids.farthest_first(middle, 3)
    number, best, _ = centroids.assign(points, centroids.to_pivots(points, fixed), middle, centroids.to_pivots(middle, fixed))
    expected = [min((int(((p - c) ** 2).sum()), n) for n, c in enumerate(middle)) for p in points]
    assert list(zip(best.tolist(), number.tolist())) == expected


def test_pivots_spare_distances():
    rng = np.random.default_rng(1)
    middle = rng.integers(-256, 256, (40, 64))
    points = middle[rng.integers(0, 40, 4000)] + rng.integers(-20, 20, (4000, 64))
    fixed = centroids.farthest_first(middle, 8)
    _, _, taken = centroids.assign(points, centroids.to_pivots(points, fixed), middle, centroids.to_pivots(middle, fixed))
    assert taken < 0.2 * 4000 * 40


def test_query_equals_sql_and_brute_force(spark, table):
    found = {r.vec_id: r for r in op11_centroids(spark, SMALL).collect()}
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    sql = con.sql(op11_sql())
    assert sorted(sql.fetchall()) == sorted(tuple(r[c] for c in sql.columns) for r in found.values())
    rows = [(r.vec_id, r.embedding) for r in table("embeddings").collect()]
    expected, middle = brute(rows, 40, 5, 64)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found.values()) == expected
    assert {r.inertia for r in found.values()} == {sum(d for *_, d in expected)}
    digests = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middle]
    assert all(r.centroid_sha256 == digests[r.cluster] for r in found.values())


@pytest.mark.parametrize("n", [1, 3])
def test_pivots_of_few_or_equal_points(n):
    assert len(centroids.farthest_first(np.zeros((n, 4), np.int64), 8)) == 1
