"""Sea-water isoprene from chlorophyll, light, temperature and wind.

Every step is a column expression, so the whole model stays in generated code.
The depth integral of the production rate is a cubic in the light logarithm
and is written in closed form:

    integral of (L - k h)^2 over [0, H]  =  H (L^2 - L k H + (k H)^2 / 3)

which needs no division by the attenuation k and so holds for k = 0 as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gridspark.functions.missing import _col, nan_to_null


@dataclass(frozen=True)
class IsopreneParameters:
    """Fixed values of the published model."""

    mixed_layer_depth: float = 1.0
    delta: float = 1.0
    emission_factor: float = 0.042
    a1: float = 3.6402
    a2: float = -46.75
    a3: float = 618.2
    beta: float = 86.8798
    mu: float = 0.14
    k_chem: float = 0.05
    k_mix: float = -0.005
    light_cutoff: float = 2.5 * 4.57


DEFAULT = IsopreneParameters()


def _power(base: Column, exponent: float) -> Column:
    return F.pow(base, F.lit(exponent))


def chla_total(chla: Column | str) -> Column:
    """Chlorophyll of the lit layer from surface chlorophyll (G1)."""
    c = _col(chla)
    return F.when(c <= 0.5, F.lit(38.0) * _power(c, 0.425)).otherwise(F.lit(40.2) * _power(c, 0.507))


def k_d(ct: Column | str) -> Column:
    """Light attenuation per metre."""
    c = _col(ct)
    return F.when(c <= 13.62, F.lit(4.6 / 426.3) * _power(c, 0.547)).otherwise(F.lit(4.6 / 912.5) * _power(c, 0.839))


def light_span(par: Column | str, p: IsopreneParameters = DEFAULT) -> Column:
    """ln(PAR / cut-off), 0 where the surface light does not exceed the cut-off."""
    light = _col(par)
    return F.when(light > p.light_cutoff, F.ln(light / F.lit(p.light_cutoff))).when(light.isNotNull(), F.lit(0.0))


def h_max(par: Column | str, k: Column | str, p: IsopreneParameters = DEFAULT) -> Column:
    """Depth of the lit layer (G3); infinite where nothing attenuates the light."""
    span, att = light_span(par, p), _col(k)
    return (
        F.when(span == 0.0, F.lit(0.0))
        .when(att == 0.0, F.lit(float("inf")))
        .otherwise(F.try_divide(span, att))
    )


def h_eff(depth: Column | str, p: IsopreneParameters = DEFAULT) -> Column:
    """Lit layer cut at the mixed layer."""
    depth = _col(depth)
    return F.when(depth.isNotNull(), F.least(depth, F.lit(p.mixed_layer_depth)))


def chla_avg(ct: Column | str, depth: Column | str) -> Column:
    """Mean chlorophyll of the lit layer."""
    depth = _col(depth)
    return F.when(depth > 0.0, F.try_divide(_col(ct), depth)).when(depth.isNotNull(), F.lit(0.0))


def temperature_term(sst: Column | str, p: IsopreneParameters = DEFAULT) -> Column:
    """Quadratic in the shifted temperature; with the published values it is never zero."""
    x = _col(sst) + F.lit(p.delta)
    return x * x + F.lit(p.a2) * x + F.lit(p.a3)


def production_integral(par: Column | str, sst: Column | str, k: Column | str, depth: Column | str,
                        p: IsopreneParameters = DEFAULT) -> Column:
    """Production summed over the effective depth."""
    light, depth = _col(par), _col(depth)
    span = F.ln(F.when(light > 0.0, light))
    drop = _col(k) * depth
    cubic = depth * (span * span - span * drop + drop * drop / F.lit(3.0))
    rate = F.try_divide(F.lit(p.emission_factor * p.a1), temperature_term(sst, p))
    return F.when(depth == 0.0, F.lit(0.0)).otherwise(rate * cubic)


def source_strength(avg: Column | str, integral: Column | str, p: IsopreneParameters = DEFAULT) -> Column:
    """Production per cubic metre and day."""
    return F.lit(p.beta / p.mixed_layer_depth) * _col(avg) * _col(integral) * F.lit(24.0)


def k_bio(avg: Column | str, p: IsopreneParameters = DEFAULT) -> Column:
    """Biological loss per day."""
    return F.lit(p.mu) * _power(_col(avg), 1.28)


def schmidt(sst: Column | str) -> Column:
    """Schmidt number."""
    s = _col(sst)
    return F.lit(2675.0) - F.lit(147.12) * s + F.lit(3.726) * s * s - F.lit(0.038) * s * s * s


def gas_transfer(wind: Column | str, sc: Column | str) -> Column:
    """Air-sea exchange velocity in metres per day."""
    w = _col(wind)
    return (F.lit(0.222) * w * w + F.lit(0.333) * w) * _power(_col(sc) / F.lit(600.0), -0.5) * F.lit(0.01 * 24)


def balance(source: Column | str, bio: Column | str, kw: Column | str, p: IsopreneParameters = DEFAULT) -> Column:
    """Concentration at which production equals loss (G11); 0 for a zero denominator."""
    loss = _col(bio) + F.lit(p.k_chem) + _col(kw) / F.lit(p.mixed_layer_depth) - F.lit(p.k_mix)
    return F.when(loss == 0.0, F.lit(0.0)).otherwise(F.try_divide(_col(source), loss))


STEPS = ("chla_total", "k_d", "h_max", "h_eff", "chla_avg", "integral", "source", "k_bio", "schmidt", "k_w")


def isoprene_steps(df: DataFrame, chla: str = "chla", par: str = "par", sst: str = "sst", wind: str = "wind",
                   p: IsopreneParameters = DEFAULT, out: str = "isoprene", prefix: str = "iso_") -> DataFrame:
    """All intermediate quantities (`iso_<step>`) and the result as columns.

    Each step is its own projection: steps are used several times downstream, and
    one nested expression would repeat them.
    """
    n = {step: prefix + step for step in STEPS}
    usable = F.col(chla) >= 0.0
    for c in (chla, par, sst, wind):
        usable = usable & nan_to_null(c).isNotNull()
    return (
        df.withColumn(n["chla_total"], F.when(usable, chla_total(chla)))
        .withColumn(n["k_d"], k_d(n["chla_total"]))
        .withColumn(n["h_max"], F.when(F.col(n["k_d"]).isNotNull(), h_max(par, n["k_d"], p)))
        .withColumn(n["h_eff"], h_eff(n["h_max"], p))
        .withColumn(n["chla_avg"], chla_avg(n["chla_total"], n["h_max"]))
        .withColumn(n["integral"], production_integral(par, sst, n["k_d"], n["h_eff"], p))
        .withColumn(n["source"], source_strength(n["chla_avg"], n["integral"], p))
        .withColumn(n["k_bio"], k_bio(n["chla_avg"], p))
        .withColumn(n["schmidt"], schmidt(sst))
        .withColumn(n["k_w"], gas_transfer(wind, n["schmidt"]))
        .withColumn(out, nan_to_null(balance(n["source"], n["k_bio"], n["k_w"], p)))
    )


def with_isoprene(df: DataFrame, chla: str = "chla", par: str = "par", sst: str = "sst", wind: str = "wind",
                  p: IsopreneParameters = DEFAULT, out: str = "isoprene") -> DataFrame:
    """Input columns plus the concentration; NULL where an input is missing or the model has no real value."""
    prefix = "_iso_"
    return isoprene_steps(df, chla, par, sst, wind, p, out, prefix).drop(*(prefix + step for step in STEPS))
