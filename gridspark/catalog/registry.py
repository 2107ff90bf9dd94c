"""Registration of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.catalog.carriers import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    """Register a function of `Views` under its own name; `sql` None means rows-only."""

    def register(function: Callable[[Views], DataFrame]) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            # Keep generated methods small enough for the JIT compiler: the index polynomial is
            # far slower interpreted, and Spark then splits it by itself.
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
            return function(Views(spark, folder))

        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLES[function.__name__] = with_views(sql)
        return function

    return register


def rounded(df: DataFrame, digits: int = 6, **overrides: int) -> DataFrame:
    """Round all double columns, so that both engines give equal values."""
    return df.select(*[
        F.round(F.col(n), overrides.get(n, digits)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes
    ])


# Share of the last digit by which values are moved off the halves: quotients of sums lie on halves often, and there the
# order of summing would decide which way they are rounded.
_OFF_HALVES = 2.71828e-1


def settled(value: Column, digits: int = 6) -> Column:
    """Rounded like `sql_settled`, alike for values that differ in their last bits only."""
    return F.floor(value * F.lit(10.0**digits) + F.lit(_OFF_HALVES)) / F.lit(10.0**digits)


def sql_settled(value: str, digits: int = 6) -> str:
    return f"floor({value}*1e{digits} + {_OFF_HALVES!r}e0)/1e{digits}"


def stamp(day: str, hour: str) -> Column:
    """Timestamp without zone from a date and an hour column."""
    return F.col(day).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col(hour))


# SQL texts of formulas the oracles share.
def sql_es(t: str) -> str:
    return (
        f"(case when {t} >= 0 then 6.1121e0*exp((18.678e0 - {t}/234.5e0)*({t}/(257.14e0 + {t})))"
        f" else 6.1115e0*exp((23.036e0 - {t}/333.7e0)*({t}/(279.82e0 + {t}))) end)"
    )


def sql_clip(x: str, low: str, high: str) -> str:
    return f"(case when {x} < {low} then {low} when {x} > {high} then {high} else {x} end)"


def sql_rh(ea: str, t: str) -> str:
    es = sql_es(t)
    return sql_clip(f"(1e2*{ea}/(case when {es} < 1e-6 then 1e-6 else {es} end))", "0e0", "1e2")


def sql_heat_index(t_c: str, rh: str) -> str:
    t, r = f"({t_c}*1.8e0 + 32e0)", rh
    simple = f"(-10.3e0 + 1.1e0*{t} + 4.7e-2*{r})"
    full = (
        f"(-42.379e0 + 2.04901523e0*{t} + 10.14333127e0*{r} - 2.2475541e-1*{t}*{r} - 6.83783e-3*{t}*{t}"
        f" - 5.481717e-2*{r}*{r} + 1.22874e-3*{t}*{t}*{r} + 8.5282e-4*{t}*{r}*{r} - 1.99e-6*{t}*{t}*{r}*{r})"
    )
    return (
        f"((case when {t} is null or {r} is null then null when {t} <= 40 then {t} when {simple} < 79 then {simple} else {full} end"
        f" - case when {r} <= 13 and {t} between 80 and 112 then (13e0 - {r})/4e0*sqrt((17e0 - abs({t} - 95e0))/17e0) else 0e0 end"
        f" + case when {r} > 85 and {t} between 80 and 87 then ({r} - 85e0)/10e0*(87e0 - {t})/5e0 else 0e0 end - 32e0)/1.8e0)"
    )


def sql_radiant(ssrd, ssr, dsrp, strd, fdir, strr, cossza) -> str:
    g = f"degrees(asin({cossza}))"
    fp = f"(0.308e0*cos(radians({g}*(0.998e0 - {g}*{g}/50000e0))))"
    flux = (
        f"(0.5e0*{strd} + 0.5e0*({strd} - {strr}) + 0.7e0/0.97e0*(0.5e0*({ssrd} - {fdir}) + 0.5e0*({ssrd} - {ssr}) + {fp}*{dsrp}))"
    )
    return f"(case when {flux} >= 0 then pow({flux}/5.67e-8, 0.25e0) end)"


def sql_utci(t: str, v: str, tr: str, ea: str) -> str:
    from gridspark.functions.utci import COEFFICIENTS, exponents

    terms = []
    for c, (p, d, w, a) in zip(COEFFICIENTS, exponents()):
        powers = [(f"({ea}/1e1)", p), (f"({tr} - {t})", d), (v, w), (t, a)]
        terms.append("*".join([f"({c:.8e})", *["*".join([x] * n) for x, n in powers if n]]))
    return f"({t} + {' + '.join(terms)})"


def sql_albers(lat: str, lon: str) -> tuple[str, str]:
    import math

    from gridspark.functions.geo import ECCENTRICITY_SQ as E2
    from gridspark.functions.geo import SEMI_MAJOR_M as A

    e = math.sqrt(E2)

    def q(s):
        return (1 - E2) * (s / (1 - E2 * s * s) - 1 / (2 * e) * math.log((1 - e * s) / (1 + e * s)))

    def m(deg):
        return math.cos(math.radians(deg)) / math.sqrt(1 - E2 * math.sin(math.radians(deg)) ** 2)

    qs = {deg: q(math.sin(math.radians(deg))) for deg in (23.0, 29.5, 45.5)}
    n = (m(29.5) ** 2 - m(45.5) ** 2) / (qs[45.5] - qs[29.5])
    c = m(29.5) ** 2 + n * qs[29.5]
    rho0 = A * math.sqrt(c - n * qs[23.0]) / n
    s = f"sin(radians({lat}))"
    sq = f"({1 - E2:.17e}*({s}/(1e0 - {E2:.17e}*{s}*{s}) - {1 / (2 * e):.17e}*ln((1e0 - {e:.17e}*{s})/(1e0 + {e:.17e}*{s}))))"
    rho = f"({A / n:.17e}*sqrt({c:.17e} - {n:.17e}*{sq}))"
    theta = f"({n:.17e}*radians({lon} + 96e0))"
    return f"({rho}*sin({theta}))", f"({rho0:.17e} - {rho}*cos({theta}))"
