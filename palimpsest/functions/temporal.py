"""Half-open intervals on two time axes, and decays. Times are milliseconds; a null end is open."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def within(at: Column, start: Column, end: Column) -> Column:
    return (start <= at) & (end.isNull() | (at < end))


def valid_at(at: int | Column) -> Column:
    return within(at if isinstance(at, Column) else F.lit(at), F.col("valid_from"), F.col("valid_to"))


def system_at(at: int | Column) -> Column:
    return within(at if isinstance(at, Column) else F.lit(at), F.col("sys_from"), F.col("sys_to"))


def both_at(valid: int, system: int) -> Column:
    return valid_at(valid) & system_at(system)


def intervals_meet(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two half-open intervals share an instant."""
    return (b1.isNull() | (a0 < b1)) & (a1.isNull() | (b0 < a1))


def powers_of_two(x: pd.Series) -> pd.Series:
    """2**x by the C library, as SQL engines take it: the JVM's power is an ulp off now and then, which rounding to six places doesn't hide once scores have grown beyond 10**9."""

    def power(v: float) -> float:
        try:
            return math.pow(2.0, v)
        except OverflowError:
            return math.inf

    return x.map(power)


def half_life_score(score: Column, age_s: Column, half_life_s: float, grows: bool = False) -> Column:
    """Halved each half-life; unknown ages and a half-life of zero or less leave the score, and so do times to come unless it grows with them."""
    if half_life_s <= 0:
        return score
    if grows:
        return F.when(age_s.isNull(), score).otherwise(score * F.pandas_udf(powers_of_two, "double")(-age_s / F.lit(float(half_life_s))))
    return F.when(age_s.isNull(), score).otherwise(score * F.pow(F.lit(2.0), -F.greatest(age_s, F.lit(0)) / F.lit(float(half_life_s))))


def power_law_score(score: Column, age_s: Column, decay: float = 0.5) -> Column:
    return score - F.lit(decay) * F.log(F.greatest(age_s, F.lit(1)).cast("double"))


def logistic_prior(activation: Column, weight: float = 0.30, scale: float = 3.0) -> Column:
    return F.when(activation.isNull() | F.isnan(activation), 0.0).otherwise(F.lit(weight) / (F.lit(1.0) + F.exp(-activation / F.lit(scale))))
