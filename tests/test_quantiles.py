"""Exact percentiles against numpy, narrowed once or many times."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.quantiles import exact_percentiles, fences_in_two_scans, iqr_fences

PROBS = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)


@pytest.mark.parametrize("few", [20_000, 200, 3])
@pytest.mark.parametrize("shape", ["uniform", "hot_third", "heavy_tail", "two_values"])
def test_matches_numpy(spark, few, shape):
    rng = np.random.default_rng(7)
    values = {
        "uniform": rng.uniform(-5, 5, 6001),
        "hot_third": np.concatenate([rng.normal(0, 1, 4000), np.full(2003, 0.25)]),
        "heavy_tail": np.exp(rng.normal(0, 8, 5000)),
        "two_values": np.array([1.0] * 700 + [2.0] * 300),
    }[shape]
    got = exact_percentiles(frame(spark, values), ["v"], PROBS, few=few)["v"]
    assert got == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12, abs=1e-12)


def test_nulls_nan_and_short_columns(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (None, None), (3.0, None)], "a double, b double")
    assert exact_percentiles(df, ["a", "b"], [0.5]) == {"a": [2.0], "b": [None]}
    assert iqr_fences(df, ["a", "b"]) == {"a": None, "b": None}


def test_fences(spark):
    steady = [40 + k % 5 for k in range(20)]
    assert iqr_fences(frame(spark, steady), ["v"]) == {"v": (38.0, 46.0)}
    assert iqr_fences(frame(spark, [*steady, 90]), ["v"]) == {"v": (38.0, 46.0)}


@pytest.mark.parametrize("few", [3, 20_000])
@pytest.mark.parametrize("seed", range(4))
def test_fences_in_two_scans_are_those_of_the_search(spark, seed, few):
    rng = random.Random(seed)
    kinds = [lambda: rng.gauss(10, 3), lambda: float(rng.randrange(4)), lambda: rng.expovariate(0.1) - 5, lambda: 7.0, lambda: None, lambda: rng.choice([None, float("nan"), 1.0, -1e9, 2.5])]
    rows = [[k() for k in kinds] for _ in range(rng.choice([0, 3, 5, 400, 3000]) if seed else 3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double").repartition(5)
    got = fences_in_two_scans(df, df.columns, [F.count(F.lit(1)).alias("n")], lambda row: {"above": F.col("a") > row["n"]}, few)
    want = iqr_fences(df, df.columns)
    assert got.first == {"n": len(rows)} and got.late == {"above": sum(r[0] > len(rows) for r in rows)}
    assert got.fences == want
    for i, c in enumerate(df.columns):
        assert got.beyond[c] == sum(x == x and not want[c][0] <= x <= want[c][1] for x in (r[i] for r in rows) if x is not None) if want[c] else got.beyond[c] == 0
