import math

import numpy as np
import pytest
from postmill.llm.knn_join import bound, pivots_for, products, top_k
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, id long, row string, score string"


def brute(rows, k, scale=1024):
    whole = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows]
    out = []
    for i, q in whole:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j)
                            for j, v in whole if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


def found(df):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())


def query(c):
    return c % 100 == 0


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_every_answer_in_clustered_data(spark, block_rows):
    draw = np.random.default_rng(6)
    centres = draw.normal(0, 3, (6, 8))
    rows = [(n, (centres[n % 6] + draw.normal(0, 0.2, 8)).tolist()) for n in range(701)]
    rows += [(800 + n, rows[300][1]) for n in range(15)]
    assert found(top_k(frame(spark, rows), query, pivots=8, block_rows=block_rows)) == brute(rows, 10)


def test_fewer_pairs_are_solved_with_more_pivots_and_thinner_blocks(spark):
    """Clusters at different places of a sphere: the pairs to solve shrink with both."""
    draw = np.random.default_rng(8)
    centres = draw.normal(0, 1, (40, 6))
    centres *= 5 / np.linalg.norm(centres, axis=1)[:, None]
    rows = [(n, (centres[n % 40] + draw.normal(0, 0.05, 6)).tolist()) for n in range(4001)]
    data = frame(spark, rows)
    want = brute(rows, 3)

    def share(**how):
        """Rows met by queries, of all that could be."""
        counted = []

        def report(routes, blocks):
            size = blocks.select("block", F.size("rows").alias("n"))
            met = routes.join(size, "block").withColumnRenamed("n", "data").join(
                size.select(F.col("block").alias("q_block"), "n"), "q_block")
            counted.append(met.agg(F.sum(F.col("n") * F.col("data"))).first()[0] / (41 * 4001))

        assert found(top_k(data, query, 3, report=report, **how)) == want
        return counted[0]

    few, many = share(pivots=2, block_rows=4096), share(pivots=40, block_rows=4096)
    thin = share(pivots=40, block_rows=16)
    assert thin <= many < few / 3 and thin < 0.2
    assert [pivots_for(n) for n in (0, 10 ** 6, 10 ** 8, 10 ** 12)] == [16, 16, 156, 512]


def test_every_length_is_solved_by_itself(spark):
    rows = [(100 * n, [float(n), -1.0]) for n in range(10)] + [(100 * n + 1, [1.0, n / 7]) for n in range(5)]
    short = [(100 * n + 2, [0.5, float(n), 2.0]) for n in range(3)] + [(5000, [1.0, 1.0, 1.0])]
    assert found(top_k(frame(spark, rows + short), query)) == sorted(brute(rows, 10) + brute(short, 10))


def test_many_rows_at_one_distance(spark):
    rows = [(n, [1.0, 2.0]) for n in range(250)] + [(1000 + n, [2.0, n / 50]) for n in range(60)]
    assert found(top_k(frame(spark, rows), query, block_rows=8)) == brute(rows, 10)


def test_blocks_out_of_reach_are_not_sent(spark):
    """Far clusters on one line: most pairs of blocks fall to the bounds."""
    rings = {"pivot": np.array([0, 1]), "n": np.array([50, 50]), "high": np.array([1.0, 1.0])}
    assert bound(np.array([0.0, 100.0]), 1.0, rings, 11) == 2.0
    assert bound(np.array([0.0, 100.0]), 1.0, rings, 61) == 102.0
    assert bound(np.array([0.0, 100.0]), 1.0, rings, 200) == float("inf")


def test_odd_vectors(spark):
    good = [(n, [float(n % 5), 1.0, -0.5]) for n in range(0, 210, 10)]
    odd = [(300, None), (301, [1.0, None, 2.0]), (302, [float("nan"), 0.0, 0.0]), (303, []),
           (304, [float("inf"), 0.0, 0.0]), (305, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    assert found(top_k(frame(spark, good + odd), query)) == brute(good, 10)
    few = good[:4]
    assert found(top_k(frame(spark, few), query)) == brute(few, 10)
    assert top_k(frame(spark, []), query).count() == 0
    assert top_k(frame(spark, odd[:4]), query).count() == 0
    assert top_k(frame(spark, [(1, [1.0]), (2, [2.0])]), query).count() == 0
    again = [(0, [float(n), 1.0]) for n in range(30)] + [(n, [-5.0, n / 10]) for n in range(1, 15)]
    want = sorted(row for n in range(30) for row in brute([again[n], *again[30:]], 10) if row[0] == 0)
    assert found(top_k(frame(spark, again), query, block_rows=6)) == want
    zero = [(100 * n, [0.0, 0.0]) for n in range(12)]
    assert found(top_k(frame(spark, zero), query)) == brute(zero, 10)


def test_large_components_stay_exact(spark):
    rows = [(100 * n, [1e6 + n, -1e6 + 3 * n, 7e5 - n]) for n in range(13)]
    assert found(top_k(frame(spark, rows), query, block_rows=5)) == brute(rows, 10)
    big = np.array([[2 ** 40, 1]]), np.array([[2 ** 20, 3]])
    assert products(*big)[0][0] == 2 ** 60 + 3
