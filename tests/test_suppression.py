"""Plain suppression against the one-by-one form, and the plate rules on hand-made rows."""

import numpy as np
import pytest

from tessera.operators import greedy, suppression


def test_suppression_is_the_greedy_one(spark):
    rng = np.random.default_rng(5)
    rows = [(k, int(k % 3), float(round(rng.random(), 1)), *(float(v) for v in rng.random(2) * 0.5), *(float(v) for v in 0.1 + rng.random(2) * 0.4)) for k in range(90)]
    d = spark.createDataFrame(rows, "det_no long, frame long, score double, x double, y double, w double, h double")
    got = {(r.frame, r.det_no) for r in suppression.suppress(d, ["frame"], 0.4).collect()}
    want = set()
    for f in range(3):
        at = [r for r in rows if r[1] == f]
        want |= {(f, at[k][0]) for k in greedy.suppress(np.array([r[3:] for r in at]), np.array([r[2] for r in at]), 0.4)}
    assert got == want and 0 < len(got) < 90
    assert suppression.suppress(d, ["frame"], 0.4, 2).count() == 6
    assert suppression.suppress(d.where("false"), ["frame"], 0.4).count() == 0


@pytest.mark.parametrize(
    "row, kept",
    [
        ((100.0, 100.0, 160.0, 120.0, 0.9), True), ((100.0, 100.0, 160.0, 120.0, 0.2), False), ((100.0, 100.0, 160.0, 120.0, 1.5), False),
        ((100.0, 100.0, 105.0, 103.0, 0.9), False), ((100.0, 100.0, 120.0, 120.0, 0.9), False), ((100.0, 100.0, 280.0, 120.0, 0.9), False),
        ((0.0, 84.0, 300.0, 284.0, 0.9), False), ((100.0, 10.0, 160.0, 30.0, 0.9), False), ((float("nan"), 100.0, 160.0, 120.0, 0.9), False),
        ((100.0, float("inf"), 160.0, 120.0, 0.9), False), ((None, 100.0, 160.0, 120.0, 0.9), False), ((160.0, 100.0, 100.0, 120.0, 0.9), False),
    ],
)
def test_what_looks_like_a_plate(spark, row, kept):
    d = spark.createDataFrame([(1, 0, *row)], "det_no long, frame long, x0 double, y0 double, x1 double, y1 double, score double")
    got = suppression.plates(d, ["frame"], (1280, 720), 0.3, (0.0, 84.0), 0.3).collect()
    assert len(got) == kept
    if kept:
        (r,) = got
        assert (r.x * 1280, r.w * 1280) == pytest.approx((100 / 0.3, 200)) and r.h * 720 == pytest.approx(20 / 0.3 * 1.2)
