"""Normal distribution as column expressions (Spark SQL has no erf)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The published double-precision rational approximation of the
# standard normal CDF (Hart 1968, as given by West 2005).
CDF_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
           112.079291497871, 221.213596169931, 220.206867912376)
CDF_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
           296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
CDF_SWITCH = 7.07106781186547


def _horner(coefs, z: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * z + c
    return acc


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def norm_cdf(x: Column) -> Column:
    z = F.abs(x)
    e = F.exp(-z * z / 2)
    near = e * _horner(CDF_NUM, z) / _horner(CDF_DEN, z)
    tail = z + 0.65
    for k in (4, 3, 2, 1):
        tail = z + k / tail
    far = e / tail / 2.506628274631
    lower = F.when(z > 37, F.lit(0.0)).when(z < CDF_SWITCH, near).otherwise(far)
    return F.when(x > 0, 1 - lower).otherwise(lower)


def norm_cdf_array(x: np.ndarray) -> np.ndarray:
    """The same approximation for numpy arrays inside tasks."""
    z = np.abs(x)
    e, tail = np.exp(-z * z / 2), z + 0.65
    for k in (4, 3, 2, 1):
        tail = z + k / tail
    lower = np.where(z > 37, 0.0, np.where(z < CDF_SWITCH, e * np.polyval(CDF_NUM, z) / np.polyval(CDF_DEN, z), e / tail / 2.506628274631))
    return np.where(x > 0, 1 - lower, lower)


def norm_cdf_sql(x: str) -> str:
    """The same approximation as SQL text."""
    z = f"abs({x})"

    def horner(coefs):
        acc = repr(coefs[0])
        for c in coefs[1:]:
            acc = f"({acc}*{z}+{c!r})"
        return acc

    tail = f"({z}+0.65e0)"
    for k in (4, 3, 2, 1):
        tail = f"({z}+{k}/{tail})"
    e = f"exp(-{z}*{z}/2)"
    lower = (f"(CASE WHEN {z}>37 THEN 0e0 WHEN {z}<{CDF_SWITCH!r} THEN {e}*{horner(CDF_NUM)}/{horner(CDF_DEN)} "
             f"ELSE {e}/{tail}/2.506628274631e0 END)")
    return f"(CASE WHEN {x}>0 THEN 1-{lower} ELSE {lower} END)"
