"""The heat-stress table: three indices per cell and hour from twelve aligned layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.heat import (
    UTCI_DEFAULTS, all_present, cos_zenith_daytime, direct_fraction, heat_index_c, kelvin, mean_radiant_k,
    shortwave_terms, utci_in_range, wbgt_in_range, wind_speed,
)
from gridspark.functions.humidity import kelvin_to_celsius, relative_humidity
from gridspark.functions.utci import utci_c
from gridspark.functions.wbgt import wbgt_k

LAYERS = ("t2m", "ea", "sp", "u10", "v10", "lwdown", "lwnet", "ghi", "dhi", "dni", "sza", "alb")
METRICS = ("temp_C_used", "rh_pct_used", "HI_C", "WBGT_C", "UTCI_C")


def heat_stress(df: DataFrame, radiant: bool = False, wbgt: bool = True) -> DataFrame:
    """Replace the twelve layer columns by the five metrics; other columns stay.

    The wet-bulb globe temperature is not subject to the missing-input rule of the thermal-climate
    index, only to its own range. `radiant` adds TMRT_C; `wbgt` off leaves WBGT_C NULL.
    """
    keys = [c for c in df.columns if c not in LAYERS]
    c = F.col
    df = df.withColumns({
        "temp_C_used": c("t2m"),
        "rh_pct_used": relative_humidity(c("ea"), c("t2m")),
        "_wind": wind_speed(c("u10"), c("v10")),
    })
    # Stand-ins keep the polynomial free of NULLs; rows with a missing input are masked below.
    terms = shortwave_terms(c("ghi"), c("dni"), c("alb"), c("sza"))
    df = df.withColumns({
        "HI_C": heat_index_c(c("temp_C_used"), c("rh_pct_used")),
        "_t": F.coalesce(c("t2m"), kelvin_to_celsius(F.lit(UTCI_DEFAULTS["t_k"]))),
        "_w": F.coalesce(c("_wind"), F.lit(UTCI_DEFAULTS["wind"])),
        "_e": F.coalesce(c("ea"), F.lit(UTCI_DEFAULTS["ea_hpa"])),
        "_r": kelvin_to_celsius(mean_radiant_k(
            terms["ssrd"], terms["ssr"], terms["dsrp"], c("lwdown"), terms["fdir"], c("lwnet"), terms["cossza"])),
        "_ok": all_present(*[c(n) for n in ("t2m", "_wind", "rh_pct_used", "ea", "ghi", "dni", "sza", "alb", "lwdown", "lwnet")]),
    })
    index = utci_in_range(c("_t"), c("_w"), c("rh_pct_used"), c("_e"), c("_r"), utci_c("_t", "_w", "_r", "_e"))
    df = df.withColumn("UTCI_C", F.when(c("_ok"), index))
    if wbgt:
        k = wbgt_k(
            kelvin(c("t2m")), c("rh_pct_used"), c("sp"), c("_wind"), c("ghi"),
            direct_fraction(c("ghi"), c("dhi")), cos_zenith_daytime(c("sza")))
        df = df.withColumn("WBGT_C", wbgt_in_range(kelvin_to_celsius(k)))
    else:
        df = df.withColumn("WBGT_C", F.lit(None).cast("double"))
    extra = [c("_r").alias("TMRT_C")] if radiant else []
    return df.select(*keys, *METRICS, *extra)
