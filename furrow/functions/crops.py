"""Crop response and the labels of two gridded classifications, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.functions.columns import beta_response, d

# --- assimilation: fixed values of the index

#: Cardinal temperatures, compensation point, inner share of CO2 and rain at half supply; ``half_rate`` is of the C3 path alone.
MAIZE = {"low": 8.0, "best": 33.0, "high": 45.0, "compensation": 0.0, "half_rate": None, "inner": 0.40, "half_rain": 400.0}
OTHER = {"low": 0.0, "best": 22.0, "high": 37.0, "compensation": 42.75, "half_rate": 404.9, "inner": 0.70, "half_rain": 300.0}
_TINY = 1e-9


def assimilation_index(tavg: Column, cum_prec: Column, cum_rad: Column, crop: str, *, nitrogen: float = 0.1, co2: float = 400.0) -> Column:
    """A seasonal proxy of assimilation: the harmonic mean of the carboxylation and the light limit, times light and water supply.

    Maize (in any case) takes the C4 path, whose carboxylation CO2 doesn't limit; all other crops the C3 path. 0 where undefined.
    """
    v = MAIZE if crop.lower() == "maize" else OTHER
    light = d(0.48) * cum_rad
    warmth = beta_response(tavg, v["low"], v["best"], v["high"])
    inside, spare = v["inner"] * co2, v["inner"] * co2 - v["compensation"]
    carboxylation = d(100 * (1 + 5 * nitrogen)) * warmth
    if v["half_rate"] is not None:
        carboxylation = carboxylation * d(spare / (inside + v["half_rate"] + _TINY))
    transport = d(0.1) * light * warmth * d(spare / (4 * inside + 8 * v["compensation"] + _TINY))
    both = 2 * carboxylation * transport / (carboxylation + transport + d(_TINY))
    out = both * light / (light + d(100 + _TINY)) * cum_prec / (cum_prec + d(v["half_rain"] + _TINY))
    return F.when(out.isNull() | F.isnan(out) | (F.abs(out) == float("inf")), d(0)).otherwise(out)


# --- labels: fixed values of the classifications

SUITABILITY = {
    0: "0",
    1: "Very high (SI > 85)",
    2: "High (70 < SI < 85)",
    3: "Good (55 < SI < 70)",
    4: "Medium (40 < SI < 55)",
    5: "Moderate (25 < SI < 40)",
    6: "Marginal (10 < SI < 25)",
    7: "Very marginal (0 < SI < 10)",
    8: "Not suitable",
    9: "Water",
}
NO_SUITABILITY = -9
CLIMATES = {
    1: ("Af", "Tropical rainforest"),
    2: ("Am", "Tropical monsoon"),
    3: ("Aw", "Tropical savanna (dry winter)"),
    4: ("BWh", "Hot desert"),
    5: ("BWk", "Cold desert"),
    6: ("BSh", "Hot semi-arid (steppe)"),
    7: ("BSk", "Cold semi-arid (steppe)"),
    8: ("Csa", "Mediterranean — hot dry summer"),
    9: ("Csb", "Mediterranean — warm dry summer"),
    10: ("Csc", "Mediterranean — cold dry summer"),
    11: ("Cwa", "Humid subtropical — dry winter"),
    12: ("Cwb", "Subtropical highland — dry winter"),
    13: ("Cwc", "Cold subtropical highland — dry winter"),
    14: ("Cfa", "Humid subtropical"),
    15: ("Cfb", "Oceanic (marine west coast)"),
    16: ("Cfc", "Subpolar oceanic"),
    17: ("Dsa", "Hot-summer continental — dry summer"),
    18: ("Dsb", "Warm-summer continental — dry summer"),
    19: ("Dsc", "Cool continental — dry summer"),
    20: ("Dsd", "Very cold continental — dry summer"),
    21: ("Dwa", "Monsoon humid continental — hot summer"),
    22: ("Dwb", "Monsoon humid continental — warm summer"),
    23: ("Dwc", "Monsoon subarctic"),
    24: ("Dwd", "Monsoon extremely cold subarctic"),
    25: ("Dfa", "Humid continental — hot summer"),
    26: ("Dfb", "Humid continental — warm summer"),
    27: ("Dfc", "Subarctic / boreal"),
    28: ("Dfd", "Extremely cold subarctic"),
    29: ("ET", "Tundra"),
    30: ("EF", "Ice cap"),
}


def _map(values: dict[int, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def suitability(raw: Column) -> dict[str, Column]:
    """code, label and confidence of a suitability class: high for what isn't named low, unknown without data (null or -9)."""
    code = raw.cast("int")
    known = code.isNotNull() & (code != NO_SUITABILITY)
    label = F.coalesce(F.try_element_at(_map(SUITABILITY), code), F.concat(F.lit("unrecognized class code "), code.cast("string")))
    return {
        "code": F.when(known, code),
        "label": F.when(known, label).otherwise("NoData (outside raster coverage / masked)"),
        "confidence": F.when(~known, "unknown").when(code.isin(0, 5, 6, 7, 8, 9), "low").otherwise("high"),
    }


def climate_code(raw: Column) -> dict[str, Column]:
    """code, label, main group and description of a climate class from 1 to 30; any other is NoData."""
    known = raw.cast("int").between(1, 30)
    code = F.when(known, raw.cast("int"))
    label = F.when(known, F.try_element_at(_map({k: v[0] for k, v in CLIMATES.items()}), code)).otherwise("NoData")
    about = F.when(known, F.try_element_at(_map({k: v[1] for k, v in CLIMATES.items()}), code)).otherwise("Outside raster coverage")
    return {"code": code, "label": label, "main_group": F.when(known, F.substring(label, 1, 1)).otherwise("NoData"), "description": about}
