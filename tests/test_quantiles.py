import math
import random

import numpy as np
import pytest

from lotwise.functions import quantiles
from lotwise.functions.quantiles import exact_quantiles, grouped_quantiles, ranks


def frame(spark, kind, n=3000):
    rng = random.Random(kind)
    draw = {
        "uniform": lambda: rng.random() * 1e6,
        "ties": lambda: float(rng.choice([1, 2, 2, 2, 3, 900])),
        "skewed": lambda: rng.expovariate(1) ** 4,
        "constant": lambda: 7.0,
    }[kind]
    rows = [("hot" if i % 3 == 0 else f"g{i % 11}" if i % 11 else None, None if i % 17 == 0 else draw()) for i in range(n)]
    return spark.createDataFrame(rows, "g string, v double"), rows


@pytest.mark.parametrize("kind", ["uniform", "ties", "skewed", "constant"])
def test_counting_is_exact(spark, kind):
    df, rows = frame(spark, kind)
    probs = [0.0, 0.25, 0.5, 0.993, 1.0]
    want = np.quantile([v for _, v in rows if v is not None], probs)
    assert np.allclose(exact_quantiles(df, ["v"], probs)["v"], want, rtol=1e-12)


def test_values_over_all_magnitudes(spark):
    rng = random.Random(5)
    values = [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 308) for _ in range(2000)]
    values += [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308] + [1e-200] * 500
    values += [math.nextafter(1e-200, 1), math.nextafter(1e-200, 0)]
    df = spark.createDataFrame([("hot" if i % 5 else "rest", v) for i, v in enumerate(values)], "g string, v double")
    probs = [i / 40 for i in range(41)]
    ranked = sorted(values)
    # Ranks without interpolation: halving a difference of such values would itself round.
    steps = [round(p * (len(values) - 1)) / (len(values) - 1) for p in probs]
    got = exact_quantiles(df, ["v"], steps)["v"]
    for p, g in zip(steps, got):
        low, high, part = ranks(len(values), p)
        a, b = ranked[low], ranked[high]
        assert g == (a if a == b else a + (b - a) * part)
    groups = grouped_quantiles(df, ["g"], "v", {"m": 0.5, "top": 1.0}).collect()
    for r in groups:
        own = sorted(v for i, v in enumerate(values) if ("hot" if i % 5 else "rest") == r["g"])
        low, high, part = ranks(len(own), 0.5)
        assert r["m"] == (own[low] if own[low] == own[high] else own[low] + (own[high] - own[low]) * part)
        assert r["top"] == own[-1]


def test_infinite_and_not_a_number(spark):
    df = spark.createDataFrame([(float(x),) for x in ("nan", "inf", "inf", "-inf", "1", "2", "3")], "v double")
    assert exact_quantiles(df, ["v"], [0.0, 0.4, 0.6, 1.0])["v"] == [-math.inf, 2.0, 3.0, math.inf]


def test_grouped_with_a_hot_group(spark):
    df, rows = frame(spark, "uniform")
    rows += [("empty", None)]
    df = df.unionByName(spark.createDataFrame([("empty", None)], df.schema))
    got = grouped_quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5}).collect()
    assert len(got) == len({g for g, _ in rows})
    for r in got:
        values = [v for g, v in rows if g == r["g"] and v is not None]
        if not values:
            assert r["a"] is None
            continue
        assert np.allclose([r["a"], r["b"]], np.quantile(values, [0.1, 0.5]), rtol=1e-12)


def test_empty_and_all_missing(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert exact_quantiles(df, ["v"], [0.5]) == {"v": [None]}


@pytest.mark.parametrize("setting,value", [("MANY", 10), ("MARGIN", 0.0), ("SKETCH", 16)])
def test_any_sketch_leads_to_the_same_values(spark, monkeypatch, setting, value):
    """Bins first, brackets that miss their rank, a coarse sketch: only the work differs."""
    monkeypatch.setattr(quantiles, setting, value)
    for kind in ("uniform", "ties", "skewed"):
        df, rows = frame(spark, kind)
        probs = [0.0, 0.25, 0.5, 0.993, 1.0]
        want = np.quantile([v for _, v in rows if v is not None], probs)
        assert np.allclose(exact_quantiles(df, ["v"], probs)["v"], want, rtol=1e-12)


@pytest.mark.parametrize("many", [10, 1 << 22])
def test_three_passes_at_most(spark, monkeypatch, many):
    """The search by bins, which passes over the rows as often as it takes, has nothing left to do."""
    monkeypatch.setattr(quantiles, "MANY", many)
    monkeypatch.setattr(quantiles, "bin_of", None)
    df, rows = frame(spark, "skewed", 30000)
    want = np.quantile([v for _, v in rows if v is not None], [0.1, 0.5, 0.9])
    assert np.allclose(exact_quantiles(df, ["v"], [0.1, 0.5, 0.9])["v"], want, rtol=1e-12)
