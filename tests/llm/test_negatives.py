import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphquarry.llm.negatives import mine_hard_negatives, narrow, plane, slices


def brute(rows, scale=256, positives=5, negatives=10, window=(30, 90)):
    """(id, label, vector, anchor?) rows, one loop over all pairs."""
    rows = [(i, c, [math.floor(scale * x) for x in v], a) for i, c, v, a in rows if None not in (i, c, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, c, v, anchor) in enumerate(rows):
        if not anchor:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m, d) for m, (j, d, w, _) in enumerate(rows) if m != n)
        for p, j, *_ in [s for s in scored if s[3] == c][:positives]:
            fit = [(s, k) for s, k, _, d in scored if d != c and window[0] * -p <= 100 * -s <= window[1] * -p][:negatives]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, parts=3, **more):
    frame = spark.createDataFrame([(i, c, v, a, 1.0) for i, c, v, a in rows], "vec_id long, label int, embedding array<float>, asked boolean, score double").repartition(parts)
    return sorted(tuple(r) for r in mine_hard_negatives(frame, F.col("asked"), **more).collect())


def vectors(n, dim, seed, grain=0.0):
    """Clustered vectors; a grain above 0 makes ties."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    out = []
    for k in range(n):
        v = centres[k % 6] + rng.normal(size=dim)
        v /= np.linalg.norm(v)
        out.append([float(np.float32(round(x / grain) * grain if grain else x)) for x in v])
    return out


def test_planes_hold_the_numbers():
    rng = np.random.default_rng(1)
    for low, high in ((-300, 300), (0, 0), (-1, 0), (0, 1), (-128, 127), (5, 9), (-9, -5)):
        values = rng.integers(low, high + 1, size=(7, 5))
        width, body = slices(values)
        total = sum(plane(body, k, 7, 5).astype(int) * ((-1 if k == 0 else 1) << (width - 1 - k)) for k in range(width))
        assert (total == values).all()


def test_intervals_hold_the_score_and_tighten():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-200, 200, (4, 9)), rng.integers(-250, 250, (30, 9))
    width, body = slices(b)
    seen = []

    def still(i, j, low, high):
        assert ((low <= a @ b.T) & (a @ b.T <= high)).all()
        seen.append(float((high - low).max()))
        return np.ones(low.shape, bool)

    i, j, score = narrow(a, {"n": 30, "dim": 9, "width": width, "planes": body}, still, np.ones((4, 30), bool))
    assert (score == (a @ b.T)[i, j]).all() and len(seen) == width and seen[-1] == 0 and all(x > y for x, y in zip(seen, seen[1:]))


@pytest.mark.parametrize("grain", [0.0, 0.25])
def test_against_brute_force(spark, grain):
    rows = [(k * 3 % 701, k % 4 if k % 3 else 9, v, k % 20 == 0) for k, v in enumerate(vectors(600, 16, 4, grain))]
    want = brute(rows)
    assert len(want) > 500 and mined(spark, rows) == want


def test_many_tiles_and_blocks(spark):
    """Small blocks, tiles and cells, so that a grid of several lines and columns is walked."""
    rows = [(k, random.Random(k).randint(0, 2), v, k % 10 == 0) for k, v in enumerate(vectors(200, 8, 5, 0.2))]
    assert mined(spark, rows, block=16, tile=3, cell=5, column=64) == brute(rows)


def test_rows_that_take_no_part(spark):
    good = [(k, k % 2, [0.5, 0.25 * (k % 5), -0.1], k % 5 == 0) for k in range(20)]
    bad = [(None, 1, [1.0, 1.0, 1.0], True), (30, None, [1.0, 1.0, 1.0], True), (31, 1, None, True), (32, 1, [1.0, None, 0.0], True), (33, 0, [float("nan"), 1.0, 1.0], True), (34, 0, [float("inf"), 0.0, 0.0], True), (35, 0, [0.0, float("-inf"), 0.0], False)]
    odd = [(40, 0, [], True), (41, 1, [0.5], True), (42, 1, [0.5, 0.5, 0.5, 9.0], None), (43, 0, [1e30, -1e-30, 0.0], False)]
    held = [(i, c, v and [min(x, 65536.0) for x in v], a) for i, c, v, a in odd]
    assert mined(spark, good + bad + odd) == brute(good + bad + held)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(5, 1, [1.0, 0.5], True)] * 2 + [(6, 1, [1.0, 0.25], False)] * 3 + [(7, 2, [0.5, 0.25], False)] * 4
    assert mined(spark, rows, 1) == brute(rows) and len(brute(rows)) == 2 * 4 * 4
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [0.5], False)]) == []
    assert mined(spark, [(1, 1, [0.5], True)]) == []
