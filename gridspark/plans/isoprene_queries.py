"""The isoprene model step by step (SURVEY section G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.functions import isoprene as iso
from gridspark.functions.missing import finite_or_null
from gridspark.plans import views as v
from gridspark.plans.registry import query

KEYS = ["l_orderkey", "l_linenumber"]


def _steps(spark, d, **columns: str):
    steps = iso.isoprene_steps(v.ocean(spark, d))
    return steps.select(*KEYS, *(v.r6(finite_or_null(c)).alias(name) for name, c in columns.items()))


def _sql(*pairs: tuple[str, str]) -> str:
    cols = ", ".join(f"CASE WHEN isinf({e}) THEN NULL ELSE round({e}, 6) + 0.0 END AS {a}" for a, e in pairs)
    return f"SELECT l_orderkey, l_linenumber, {cols} FROM iso"


@query("isoprene_chlorophyll", _sql(("chla_total", "ct"), ("k_d", "kd")))
def isoprene_chlorophyll(spark, d):
    return _steps(spark, d, chla_total="iso_chla_total", k_d="iso_k_d")


@query("isoprene_depth", _sql(("h_max", "hm"), ("h_eff", "h"), ("chla_avg", "ca")))
def isoprene_depth(spark, d):
    return _steps(spark, d, h_max="iso_h_max", h_eff="iso_h_eff", chla_avg="iso_chla_avg")


@query("isoprene_production", _sql(("integral", "integral"), ("source", "p")))
def isoprene_production(spark, d):
    return _steps(spark, d, integral="iso_integral", source="iso_source")


@query("isoprene_losses", _sql(("k_bio", "kb"), ("schmidt", "sc"), ("k_w", "kw")))
def isoprene_losses(spark, d):
    return _steps(spark, d, k_bio="iso_k_bio", schmidt="iso_schmidt", k_w="iso_k_w")


@query("isoprene", _sql(("isoprene", "isoprene")))
def isoprene(spark, d):
    return iso.with_isoprene(v.ocean(spark, d)).select(*KEYS, v.r6("isoprene").alias("isoprene"))


@query("isoprene_missing", """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE round(isoprene, 6) + 0.0 END AS isoprene FROM iso""")
def isoprene_missing(spark, d):
    holes = v.ocean(spark, d).withColumn("sst", F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("sst")))
    return iso.with_isoprene(holes).select(*KEYS, v.r6("isoprene").alias("isoprene"))
