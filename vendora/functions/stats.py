"""Statistical column expressions that Spark lacks as built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of a published rational approximation of the
# inverse standard normal CDF (P. J. Acklam, relative error < 1.15e-9).
ACKLAM_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
            1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
ACKLAM_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
            6.680131188771972e+01, -1.328068155288572e+01]
ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
            -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
            3.754408661907416e+00]
P_LOW = 0.02425


def _horner(coefs, x):
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def _horner_sql(coefs, x: str) -> str:
    acc = repr(coefs[0])
    for c in coefs[1:]:
        acc = f"({acc} * {x} + {c!r})"
    return acc


def norm_ppf(p: Column) -> Column:
    """Inverse standard normal CDF for 0 < p < 1 as a pure expression."""
    q_lo = F.sqrt(-2 * F.log(p))
    q_hi = F.sqrt(-2 * F.log(1 - p))
    q = p - 0.5
    r = q * q
    low = _horner(ACKLAM_C, q_lo) / (_horner(ACKLAM_D, q_lo) * q_lo + 1)
    high = -_horner(ACKLAM_C, q_hi) / (_horner(ACKLAM_D, q_hi) * q_hi + 1)
    mid = _horner(ACKLAM_A, r) * q / (_horner(ACKLAM_B, r) * r + 1)
    return F.when(p < P_LOW, low).when(p > 1 - P_LOW, high).otherwise(mid)


def norm_ppf_sql(p: str) -> str:
    """SQL twin of ``norm_ppf``."""
    q_lo = f"sqrt(-2 * ln({p}))"
    q_hi = f"sqrt(-2 * ln(1 - {p}))"
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    low = f"({_horner_sql(ACKLAM_C, q_lo)} / ({_horner_sql(ACKLAM_D, q_lo)} * {q_lo} + 1))"
    high = f"(-{_horner_sql(ACKLAM_C, q_hi)} / ({_horner_sql(ACKLAM_D, q_hi)} * {q_hi} + 1))"
    mid = f"({_horner_sql(ACKLAM_A, r)} * {q} / ({_horner_sql(ACKLAM_B, r)} * {r} + 1))"
    return f"(CASE WHEN {p} < {P_LOW} THEN {low} WHEN {p} > {1 - P_LOW!r} THEN {high} ELSE {mid} END)"
