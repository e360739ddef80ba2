import math
import random

import pytest

from textmart.operators import selection


@pytest.mark.parametrize("values", [
    [5], [1, 1, 1, 2], list(range(-5000, 5000, 7)), [0, 10 ** 17, -10 ** 17, 3, 3], [random.Random(1).getrandbits(60) for _ in range(500)]])
def test_kth_largest(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v long")
    ranked = sorted(values, reverse=True)
    for k in {1, 2, len(values) // 2, len(values)} - {0}:
        assert selection.kth_largest(df, "v", k) == (ranked[k - 1] if k <= len(ranked) else None)
    assert selection.kth_largest(df, "v", len(values) + 1) is None


def plain(values, share):
    ranked = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v if not math.isnan(v) else 0))
    return ranked[max(1, math.ceil(share * len(ranked))) - 1] if ranked else None


@pytest.mark.parametrize("steps, few", [(1 << 10, 1 << 12), (64, 20)])
def test_exact_quantiles(spark, monkeypatch, steps, few):
    monkeypatch.setattr(selection, "STEPS", steps)
    monkeypatch.setattr(selection, "FEW", few)
    rng = random.Random(3)
    n = 200
    columns = {
        "a b": [rng.gauss(0, 1) for _ in range(n)],
        "skewed": [2.0 ** rng.randrange(-60, 300) for _ in range(n)],
        "few": [float(rng.randrange(3)) for _ in range(n)],
        "holes": [rng.choice([None, 1.5, -2.5, 1e-300]) for _ in range(n)],
        "odd": [rng.choice([math.inf, -math.inf, math.nan, 1.0, 2.0, 1.7e308, -1.7e308]) for _ in range(n)],
        "none": [None] * n,
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"`{c}` double" for c in columns)).repartition(5)
    shares = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = selection.exact_quantiles(df, list(columns), shares)
    for c, values in columns.items():
        for share, got in zip(shares, found[c]):
            want = plain(values, share)
            assert got == want or (math.isnan(got) and math.isnan(want)), (c, share)
