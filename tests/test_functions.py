"""Scalar expressions against published vectors."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import mdl
from strandlake.functions import seq as S


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_universal_code(spark):
    got = one(spark, *[mdl.universal_int(F.lit(n)) for n in (1, 2, 3, 10, 100, 0, -5)])
    assert got[:5] == pytest.approx([1.518, 2.518, 3.768, 7.364, 12.880], abs=0.01)
    assert got[5:] == [math.inf, math.inf]


def test_model_cost(spark):
    got = one(spark, *[mdl.model_cost(F.lit(n)) for n in (10, 100, 1000, 0, -1)])
    assert got[0] < got[1] < got[2] and abs(got[1] / 100 - 2.0) < 0.5 and got[3:] == [math.inf, math.inf]


def test_instance_cost(spark):
    modes = ("none", "exact", "upper")
    zero = one(spark, *[mdl.instance_cost(F.lit(200), F.lit(0), m) for m in modes])
    assert len({round(x, 9) for x in zero}) == 1 and zero[0] < 50
    none, exact, upper = one(spark, *[mdl.instance_cost(F.lit(200), F.lit(20), m) for m in modes])
    assert none < exact <= upper
    odd = one(spark, *[mdl.instance_cost(F.lit(200), F.lit(m)) for m in (200, -5, 999)])
    assert all(map(math.isfinite, odd)) and odd[0] == odd[2] and odd[1] == pytest.approx(zero[1])
    choose = math.log2(math.comb(200, 20))
    assert one(spark, mdl.log2_choose(F.lit(200), F.lit(20)))[0] == pytest.approx(choose)
    with pytest.raises(ValueError):
        mdl.instance_cost(F.lit(1), F.lit(1), "other")


def test_flags(spark):
    flags = mdl.base_flags(F.lit(79), F.lit(2), F.lit(0.25))
    assert one(spark, flags, mdl.flag_names(flags), mdl.flag_names(F.lit(0))) == [7, "short_consensus|low_copy|high_divergence", "none"]
    assert one(spark, mdl.quality_tier(F.lit("exclusive"), F.lit(0)), mdl.quality_tier(F.lit("standalone"), F.lit(16)), mdl.quality_tier(F.lit("x"), F.lit(0))) == ["core", "warn", "reject"]


def test_sequences(spark):
    rows = spark.createDataFrame([("AACG",), ("ACGT",), ("TTTT",)], "s string")
    got = [tuple(r) for r in rows.select("s", S.reverse_complement("s"), S.canonical("s"), S.is_reverse("s"), S.pack("s")).collect()]
    assert got == [("AACG", "CGTT", "AACG", False, 6), ("ACGT", "ACGT", "ACGT", False, 27), ("TTTT", "AAAA", "AAAA", True, 255)]
    assert one(spark, S.pack(F.lit("ANA")), S.auto_k(F.lit(1_000_000)), S.normalise(F.lit("ac-gt\r 12*nRy")), S.wrap(F.lit("A" * 81))) == [None, 11, "ACGTNNN", "A" * 80 + "\nA"]
    low = [r[0] for r in spark.createDataFrame([("AAAAAAAAAA",), ("ACGTACGTTG",)], "s string").select(S.low_entropy("s")).collect()]
    assert low == [True, False]
    period = [r[0] for r in spark.createDataFrame([("ACACACACAC",), ("ACGTTGCAAT",), ("ACA",)], "s string").select(S.periodic("s")).collect()]
    assert period == [True, False, False]


@pytest.mark.parametrize("mode", ["none", "upper", "exact"])
def test_instance_costs_of_arrays_equal_the_column(spark, mode):
    pairs = [(a, m) for a in (0, 1, 2, 50, 400, 65_536) for m in (-1, 0, 1, 7, 50, 900)]
    want = spark.createDataFrame(pairs, "a int, m int").select("a", "m", mdl.instance_cost("a", "m", mode).alias("x")).collect()
    got = mdl.instance_costs(np.array([r.a for r in want]), np.array([r.m for r in want]), mode)
    assert np.allclose(got, [r.x for r in want], rtol=0, atol=1e-8)


def test_steady_means_round_alike(spark):
    below, at = 0.16218749999999998, 0.1621875
    got = spark.createDataFrame([(below,), (at,)], "x double").select(F.round(mdl.steady("x"), 6).alias("x")).collect()
    assert below < at and [r.x for r in got] == [0.162188] * 2
