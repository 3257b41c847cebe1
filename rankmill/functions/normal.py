"""Normal distribution functions, which neither Spark nor DuckDB has.

The cumulative function is Hart's rational approximation (as given by West,
2005), the quantile is Wichura's AS 241; both hold to about 1e-15. The same
coefficients serve as Columns, as SQL text and as numpy.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Published coefficients, highest power first.
_N = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931,
      220.206867912376)
_D = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831,
      793.826512519948, 440.413735824752)
_SPLIT = 7.07106781186547
_ROOT = 2.506628274631
_A = (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125,
      1971.5909503065514427, 133.14166789178437745, 3.387132872796366608)
_B = (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077,
      687.1870074920579083, 42.313330701600911252, 1.0)
_C = (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258,
      3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734)
_E = (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459,
      0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0)
_G = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 0.026532189526576123093,
      0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772)
_H = (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4,
      0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0)


def _poly(x, coefficients):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / 2.5066282746310002


def sf(x: Column) -> Column:
    """Share of a standard normal above x."""
    z = F.abs(x)
    bell = F.exp(-z * z / 2)
    far = bell / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / _ROOT
    tail = F.when(z > 37, F.lit(0.0)).when(z < _SPLIT, bell * _poly(z, _N) / _poly(z, _D)).otherwise(far)
    return F.when(x > 0, tail).otherwise(1.0 - tail)


def cdf(x: Column) -> Column:
    return sf(-x)


def ppf(p: Column) -> Column:
    """Quantile; null outside (0, 1)."""
    q = p - 0.5
    r = 0.180625 - q * q
    low = F.sqrt(-F.ln(F.when(q < 0, p).otherwise(1.0 - p)))
    near, far = low - 1.6, low - 5.0
    tail = F.when(low <= 5, _poly(near, _C) / _poly(near, _E)).otherwise(_poly(far, _G) / _poly(far, _H))
    value = F.when(F.abs(q) <= 0.425, q * _poly(r, _A) / _poly(r, _B)).when(q < 0, -tail).otherwise(tail)
    return F.when((p > 0) & (p < 1), value)


def isf(p: Column) -> Column:
    return -ppf(p)


def _num(c: float) -> str:
    """A literal that SQL reads as a double, not a decimal."""
    text = repr(float(c))
    return text if "e" in text else text + "e0"


def _text(x: str, coefficients) -> str:
    out = _num(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {_num(c)})"
    return out


def sf_sql(x: str) -> str:
    """The same upper tail as SQL text."""
    z = f"abs({x})"
    bell = f"exp(-{z} * {z} / 2)"
    far = f"{bell} / ({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65e0))))) / {_num(_ROOT)}"
    tail = f"(CASE WHEN {z} > 37 THEN 0e0 WHEN {z} < {_num(_SPLIT)} THEN {bell} * {_text(z, _N)} / {_text(z, _D)} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN {tail} ELSE 1e0 - {tail} END)"


def ppf_sql(p: str) -> str:
    q = f"({p} - 0.5e0)"
    r = f"(0.180625e0 - {q} * {q})"
    low = f"sqrt(-ln(CASE WHEN {q} < 0 THEN {p} ELSE 1e0 - {p} END))"
    near, far = f"({low} - 1.6e0)", f"({low} - 5e0)"
    tail = f"(CASE WHEN {low} <= 5 THEN {_text(near, _C)} / {_text(near, _E)} ELSE {_text(far, _G)} / {_text(far, _H)} END)"
    value = f"(CASE WHEN abs({q}) <= 0.425e0 THEN {q} * {_text(r, _A)} / {_text(r, _B)} WHEN {q} < 0 THEN -{tail} ELSE {tail} END)"
    return f"(CASE WHEN {p} > 0 AND {p} < 1 THEN {value} END)"


def np_sf(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    z = np.abs(x)
    with np.errstate(over="ignore", invalid="ignore"):
        bell = np.exp(-z * z / 2)
        far = bell / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / _ROOT
        tail = np.where(z > 37, 0.0, np.where(z < _SPLIT, bell * _poly(z, _N) / _poly(z, _D), far))
    return np.where(x > 0, tail, 1.0 - tail)


def np_cdf(x: np.ndarray) -> np.ndarray:
    return np_sf(-np.asarray(x, dtype=float))


def np_pdf(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.square(x) / 2) / 2.5066282746310002


def np_ppf(p: np.ndarray) -> np.ndarray:
    p = np.asarray(p, dtype=float)
    q = p - 0.5
    with np.errstate(divide="ignore", invalid="ignore"):
        r = 0.180625 - q * q
        low = np.sqrt(-np.log(np.where(q < 0, p, 1.0 - p)))
        near, far = low - 1.6, low - 5.0
        tail = np.where(low <= 5, _poly(near, _C) / _poly(near, _E), _poly(far, _G) / _poly(far, _H))
        value = np.where(np.abs(q) <= 0.425, q * _poly(r, _A) / _poly(r, _B), np.where(q < 0, -tail, tail))
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, value))
