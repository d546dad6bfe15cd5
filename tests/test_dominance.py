"""Counted pairs equal listed pairs, with near ties, equal values and strips of any size."""

from __future__ import annotations

import random

import pytest

from causeway.operators import access, dominance


@pytest.mark.parametrize("strip", [7, 10_000])
def test_counts_equal_listed_pairs(spark, monkeypatch, strip):
    monkeypatch.setattr(dominance, "STRIP", strip)
    draw = random.Random(5)
    near = lambda: draw.choice((0.0, 0.0, 3.0, 7.5, draw.uniform(0, 9))) * (1 + draw.choice((0, 0, 4e-10, 9e-10, 1.1e-9, 2e-9)))
    rows = [("k", f"o{n}", near(), near()) for n in range(220)] + [("m", f"o{n}", float(n), float(-n % 50)) for n in range(50)] + [("one", "o", 1.0, 2.0), ("equal", "p", 1.0, 2.0), ("equal", "q", 1.0, 3.0)]
    df = spark.createDataFrame(rows, "scenario_key string, origin_id string, baseline_cost_seconds double, estimated_cost_seconds double").selectExpr("*", "estimated_cost_seconds - baseline_cost_seconds AS cost_delta_seconds")
    got = {r["scenario_key"]: (r["comparable_pairs"], r["reversed_pairs"]) for r in access.ranking_reversals(df).collect()}
    far = lambda x, y: abs(x - y) > 1e-9 * max(abs(x), abs(y))
    want = {}
    for i, (key, _, a, c) in enumerate(rows):
        for other, _, b, d in rows[:i]:
            if key == other and far(a, b) and far(c, d):
                n, r = want.get(key, (0, 0))
                want[key] = (n + 1, r + ((a < b) != (c < d)))
    assert got == want and set(got) == {"k", "m"}


def test_no_step_lists_pairs(spark):
    rows = spark.range(30_000).selectExpr("'k' AS scenario_key", "concat('o', id) AS origin_id", "id * 1.0D AS baseline_cost_seconds", "(id * 7919 % 30011) * 1.0D AS estimated_cost_seconds", "0.0D AS cost_delta_seconds")
    found = access.ranking_reversals(rows).first()  # 450 million pairs
    assert found["comparable_pairs"] == 30_000 * 29_999 // 2 and 0 < found["reversed_pairs"] < found["comparable_pairs"]
