"""Queries on scalar physics and validity masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.catalog.carriers import Views
from gridspark.catalog.registry import (
    query, rounded, sql_clip, sql_es, sql_heat_index, sql_radiant, sql_rh, sql_utci,
)
from gridspark.functions.heat import (
    cos_zenith, cos_zenith_daytime, direct_fraction, heat_index_c, kelvin, mean_radiant_k, shortwave_terms,
    utci_in_range, wbgt_in_range, wind_speed,
)
from gridspark.functions.humidity import kelvin_to_celsius, relative_humidity, saturation_hpa, vapor_pressure
from gridspark.functions.utci import utci_c
from gridspark.functions.wbgt import wbgt_k
from gridspark.plans.heatstress import LAYERS, heat_stress

c = F.col

_ROW = "l_orderkey, l_linenumber, cell_id"
_COS = "cos(radians(sza))"
_WIND = "sqrt(u10*u10 + v10*v10)"
_SHORT = f"""
    select *, case when ghi > 0 then ghi else 0e0 end as ssrd,
           (1e0 - {sql_clip('coalesce(alb, 0.2e0)', '0e0', '1e0')})*(case when ghi > 0 then ghi else 0e0 end) as ssr,
           case when dni > 0 then dni else 0e0 end as dsrp,
           case when cos(radians(coalesce(sza, 180e0))) > 0 then cos(radians(coalesce(sza, 180e0))) else 0e0 end as cossza
    from grid_hour"""


@query(f"""
    select station_id, d, hr, round({sql_es('td_obs')}, 6) as ea_hpa,
           round({sql_rh(sql_es('td_obs'), 'temp_C_obs')}, 6) as rh_pct,
           round(rh_pct_obs/1e2*{sql_es('temp_C_obs')}, 6) as ea_from_rh
    from obs_hour""")
def vapor_pressure_rh(v: Views) -> DataFrame:
    ea = saturation_hpa(c("td_obs"))
    return rounded(v.obs_hour.select(
        "station_id", "d", "hr", ea.alias("ea_hpa"), relative_humidity(ea, c("temp_C_obs")).alias("rh_pct"),
        vapor_pressure(c("rh_pct_obs"), c("temp_C_obs")).alias("ea_from_rh")))


@query(f"select {_ROW}, round({sql_heat_index('temp_c', 'rh')}, 6) as hi_c from grid_hour")
def heat_index_hourly(v: Views) -> DataFrame:
    return rounded(v.grid_hour.select("l_orderkey", "l_linenumber", "cell_id", heat_index_c(c("temp_c"), c("rh")).alias("hi_c")))


@query(f"""
    select {_ROW}, round({_WIND}, 6) as wind, round({_COS}, 6) as cos_sza,
           round(case when {_COS} <= 0 then -0.5e0 else {_COS} end, 6) as cos_day,
           round(case when ghi > 1 then {sql_clip('(1e0 - dhi/ghi)', '0e0', '1e0')} else 0e0 end, 6) as direct_share,
           round(ssrd, 6) as ssrd, round(ssr, 6) as ssr, round(dsrp, 6) as dsrp, round(dsrp*cossza, 6) as fdir
    from ({_SHORT}) s""")
def direct_fraction_wind(v: Views) -> DataFrame:
    terms = shortwave_terms(c("ghi"), c("dni"), c("alb"), c("sza"))
    return rounded(v.grid_hour.select(
        "l_orderkey", "l_linenumber", "cell_id", wind_speed(c("u10"), c("v10")).alias("wind"),
        cos_zenith(c("sza")).alias("cos_sza"), cos_zenith_daytime(c("sza")).alias("cos_day"),
        direct_fraction(c("ghi"), c("dhi")).alias("direct_share"),
        *[terms[n].alias(n) for n in ("ssrd", "ssr", "dsrp", "fdir")]))


_MRT = sql_radiant("ssrd", "ssr", "dsrp", "lwdown", "(dsrp*cossza)", "lwnet", "cossza")


@query(f"select {_ROW}, round({_MRT}, 4) as mrt_k from ({_SHORT}) s")
def mean_radiant(v: Views) -> DataFrame:
    t = shortwave_terms(c("ghi"), c("dni"), c("alb"), c("sza"))
    mrt = mean_radiant_k(t["ssrd"], t["ssr"], t["dsrp"], c("lwdown"), t["fdir"], c("lwnet"), t["cossza"])
    return rounded(v.grid_hour.select("l_orderkey", "l_linenumber", "cell_id", mrt.alias("mrt_k")), 4)


@query(f"""
    select {_ROW}, round({sql_utci('temp_c', 'w', 'tr', 'ea')}, 3) as utci_c
    from (select *, 5e-1 + {_WIND}/2e0 as w, temp_c + (ghi - 5e2)/2e1 as tr from grid_hour) g""")
def utci_index(v: Views) -> DataFrame:
    g = v.grid_hour.withColumns({
        "w": F.lit(0.5) + wind_speed(c("u10"), c("v10")) / 2, "tr": c("temp_c") + (c("ghi") - 500) / 20})
    return rounded(g.select(
        "l_orderkey", "l_linenumber", "cell_id", utci_c("temp_c", "w", "tr", "ea").alias("utci_c")), 3)


@query(f"""
    select {_ROW}, round(case when temp_c between -50 and 50 and (ghi/1e1 - 3.5e1) between -30 and 70
           and {_WIND} between 0.5 and 17 and rh > 5 and rh <= 100 and ea < 50 then temp_c*2e0 end, 6) as masked,
           round(case when temp_c*4e0 - 7e1 between -60 and 80 then temp_c*4e0 - 7e1 end, 6) as wbgt_masked
    from (select l_orderkey, l_linenumber, cell_id, coalesce(temp_c, 0e0) as temp_c, coalesce(ghi, 0e0) as ghi, u10, v10,
          case when l_orderkey % 7 = 0 then null else rh end as rh, ea*4e0 as ea from grid_hour) g""")
def utci_validity_mask(v: Views) -> DataFrame:
    g = v.grid_hour.withColumns({
        "temp_c": F.coalesce(c("temp_c"), F.lit(0.0)), "ghi": F.coalesce(c("ghi"), F.lit(0.0)), "ea": c("ea") * 4,
        "rh": F.when(c("l_orderkey") % 7 != 0, c("rh"))})
    masked = utci_in_range(
        c("temp_c"), wind_speed(c("u10"), c("v10")), c("rh"), c("ea"), c("temp_c") + (c("ghi") / 10 - 35), c("temp_c") * 2)
    return rounded(g.select(
        "l_orderkey", "l_linenumber", "cell_id", masked.alias("masked"),
        wbgt_in_range(c("temp_c") * 4 - 70).alias("wbgt_masked")))


# Steps of the oracle's iteration; more than the engine takes, so that it needs no other way of settling.
SQL_STEPS = 30


def _sql_balance(source: str, keys: str) -> str:
    """The two energy balances of a source with our layer names as chained selects, one per Newton step.

    A step is held to 40 K, which changes no root.
    """
    import math

    r_air = 8314.34 / 28.97
    pr = 1003.5 / (1003.5 + 1.25 * r_air)
    k = 1003.5 + 1.25 * r_air
    dif = (3.640e-4 * (36.4 * 218.0) ** (1 / 3) * (132.0 * 647.3) ** (5 / 12)
           * math.sqrt(1 / 28.97 + 1 / 18.015) * 1013.25 * 1e-4)
    ref = math.sqrt(132.0 * 647.3)
    x = lambda number: f"{number:.17e}"
    night = "case when s10 < 2 then 0.35e0 when s10 < 2.5 then 0.35e0 else 0.15e0 end"
    day = lambda *e: (
        f"case when s10 < 2 then {e[0]} when s10 < 3 then {e[1]} when s10 < 5 then {e[2]} when s10 < 6 then {e[3]} else {e[4]} end")
    a, b, cc, dd = "0.07e0", "0.07e0", "0.10e0", "0.15e0"
    profile = (
        f"case when czd <= 0 then {night} when ghi >= 925 then {day(a, a, b, cc, cc)}"
        f" when ghi >= 675 then {day(a, b, b, cc, dd)} when ghi >= 175 then {day(b, cc, cc, dd, dd)} else 0.15e0 end")
    esat = lambda t: f"(1.004e0*6.1121e0*exp(17.502e0*({t} - 273.15e0)/({t} - 32.18e0)))"
    visc = lambda t: f"(2.6693e-6*sqrt(28.97e0*{t})/(3.617e0*3.617e0*(({t}/97e0 - 2.9e0)/0.4e0*(-0.034e0) + 1.048e0)))"
    carry = f"{keys}, t, p, u, ea, lw, swg, sww"
    text = f"""
        select {keys}, temp_c + 273.15e0 as t, rh, sp/1e2 as p, ghi, {_WIND} as s10,
               case when {_COS} <= 0 then -0.5e0 else {_COS} end as czd,
               case when ghi > 1 then {sql_clip('(1e0 - dhi/ghi)', '0e0', '1e0')} else 0e0 end as f0
        from ({source}) g"""
    text = f"""
        select *, case when s10*pow(0.2e0, {profile}) < 0.13e0 then 0.13e0 else s10*pow(0.2e0, {profile}) end as u,
               rh/1e2*{esat('t')} as ea, case when czd > 0 then f0 else 0e0 end as f, case when czd > 0 then czd else 1e0 end as cz
        from ({text}) g0"""
    edge = x(0.25 * 0.007 / 0.0254)
    text = f"""
        select *, 0.5e0*(0.575e0*pow(ea, 0.143e0) + 0.999e0)*t*t*t*t as lw,
               ghi/(2e0*5.6696e-8*0.95e0)*0.95e0*(f*(0.5e0/cz - 1e0) + 1.45e0) as swg,
               ghi*0.6e0*((1e0 - f)*(1e0 + {edge}) + f*(sqrt(1e0 - cz*cz)/cz/{x(math.pi)} + {edge}) + 0.45e0) as sww,
               t as tg, t as tw, t as mg, t as mw
        from ({text}) g1"""
    for _ in range(SQL_STEPS):
        text = f"select *, 0.5e0*(tg + t) as fg, 0.5e0*(tw + t) as fw from ({text}) a"
        text = f"select *, {visc('fg')} as vg, {visc('fw')} as vw, {esat('tw')} as ew from ({text}) b"
        text = f"""
            select *, (2e0 + 0.6e0*{x(pr ** 0.3333)}*sqrt(u*p*{x(100 / r_air * 0.0508)}/(fg*vg)))*vg*{x(k / 0.0508)}/(5.6696e-8*0.95e0) as hg,
                   0.281e0*{x(pr ** 0.44)}*pow(u*p*{x(100 / r_air * 0.007)}/(fw*vw), 0.6e0)*vw*{x(k / 0.007)} as hw,
                   ((313.15e0 - fw)/30e0*(-71100e0) + 2.4073e6)/{x(1003.5 * 28.97 / 18.015)}
                   *pow({x(pr)}/(vw*{x(r_air)}*fw/(100e0*{x(dif)}*pow(fw/{x(ref)}, 2.334e0))), 0.56e0) as lat
            from ({text}) c"""
        text = f"""
            select {carry}, tg, tw, (lw + swg - tg*tg*tg*tg - hg*(tg - t))/(4e0*tg*tg*tg + hg) as mg,
                   (t - tw - lat*(ew - ea)/(p - ew) + (5.6696e-8*0.95e0*(lw - tw*tw*tw*tw) + sww)/hw)
                   /(1e0 + lat*(ew*17.502e0*(273.15e0 - 32.18e0)/((tw - 32.18e0)*(tw - 32.18e0)))*(p - ea)/((p - ew)*(p - ew))
                     + 4e0*5.6696e-8*0.95e0*tw*tw*tw/hw) as mw
            from ({text}) d"""
        held = "greatest(-4e1, least(4e1, {}))"
        text = f"select {carry}, tg + {held.format('mg')} as tg, tw + {held.format('mw')} as tw, mg, mw from ({text}) e"
    return text


def sql_wbgt(source: str, keys: str) -> str:
    """keys and wbgt_c of a source with temp_c, rh, sp, u10, v10, ghi, dhi, sza."""
    wbgt = "0.1e0*t + 0.2e0*tg + 0.7e0*tw - 273.15e0"
    return f"""
        select {keys}, case when abs(mg) <= 1e-3 and abs(mw) <= 1e-3 and {wbgt} between -60 and 80 then {wbgt} end as wbgt_c
        from ({_sql_balance(source, keys)}) z"""


_TILTED = """
    select * exclude (sza, rh), sza + l_orderkey % 10 as sza, (case when rh > 100 then 100e0 else rh end) as rh from grid_hour"""


@query(f"select {_ROW}, round(wbgt_c, 4) as wbgt_c from ({sql_wbgt(_TILTED, _ROW)}) y")
def wbgt_index(v: Views) -> DataFrame:
    g = v.grid_hour.withColumns({"sza": c("sza") + c("l_orderkey") % 10, "rh": F.when(c("rh") > 100, 100.0).otherwise(c("rh"))})
    k = wbgt_k(
        kelvin(c("temp_c")), c("rh"), c("sp"), wind_speed(c("u10"), c("v10")), c("ghi"),
        direct_fraction(c("ghi"), c("dhi")), cos_zenith_daytime(c("sza")))
    return rounded(g.select("l_orderkey", "l_linenumber", "cell_id", wbgt_in_range(kelvin_to_celsius(k)).alias("wbgt_c")), 4)



def sql_heat_stress(source: str, keys: str) -> str:
    """The metric table from layer columns named as ours."""
    rh = sql_rh("ea", "t2m")
    # The row travels through the balances as one value, so no layer's name meets theirs.
    globe = f"select src as layers, t2m as temp_c, {rh} as rh, sp, u10, v10, ghi, dhi, sza from ({source}) src"
    solved = f"select unnest(layers), wbgt_c from ({sql_wbgt(globe, 'layers')}) solved"
    short = _SHORT.replace("grid_hour", f"({solved}) src")
    return f"""
        select {keys}, t2m as temp_C_used, rh as rh_pct_used, {sql_heat_index('t2m', 'rh')} as HI_C, wbgt_c as WBGT_C,
               case when t2m is not null and u10 is not null and v10 is not null and ea is not null and ghi is not null
                     and dni is not null and sza is not null and alb is not null and lwdown is not null and lwnet is not null
                     and t2m between -50 and 50 and tr - t2m between -30 and 70 and wind between 0.5 and 17
                     and rh > 5 and rh <= 100 and ea < 50 then {sql_utci('t2m', 'wind', 'tr', 'ea')} end as UTCI_C
        from (select *, {rh} as rh, {_WIND} as wind, {_MRT} - 273.15e0 as tr from ({short}) s) q"""


_LAYERS = (
    "select l_orderkey, l_linenumber, cell_id, temp_c as t2m, ea, sp, u10, v10, lwdown, lwnet, ghi, dhi, dni, sza, alb from grid_hour")


@query(f"""
    select l_orderkey, l_linenumber, cell_id, round(temp_C_used, 6) as temp_C_used, round(rh_pct_used, 6) as rh_pct_used,
           round(HI_C, 6) as HI_C, round(WBGT_C, 4) as WBGT_C, round(UTCI_C, 3) as UTCI_C
    from ({sql_heat_stress(_LAYERS, 'l_orderkey, l_linenumber, cell_id')}) h""")
def heat_stress_table(v: Views) -> DataFrame:
    layers = v.grid_hour.withColumnRenamed("temp_c", "t2m").select("l_orderkey", "l_linenumber", "cell_id", *LAYERS)
    return rounded(heat_stress(layers), UTCI_C=3, WBGT_C=4)
