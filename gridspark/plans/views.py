"""Gridded views over the star-schema tables: the inputs of the registered queries.

Every view exists twice, as a DataFrame and as SQL for the comparison.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EPOCH = date(2024, 1, 1)
N_LAT, N_LON, N_TIME = 12, 24, 30
EVENT_TYPES = ("view", "click", "purchase", "error", "signup")
CHANNELS = tuple(f"v_{e}" for e in EVENT_TYPES)
CAL_START, CAL_END = date(1995, 1, 1), date(2001, 12, 31)
N_IN, N_OUT = 6, 1
N_SEQ = N_TIME - (N_IN + N_OUT) + 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero.

    Values within 1e-10 of a half-way point go up, so that the order of summation cannot
    decide which way a tie falls.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(1e6) + F.lit(0.5001)) / F.lit(1e6) + F.lit(0.0)


def stable_rounding(sql: str) -> str:
    """The same rounding in SQL: replaces every `round(x, 6)`."""
    start = 0
    while (at := sql.find("round(", start)) >= 0:
        depth, end = 0, at + 5
        for end in range(at + 5, len(sql)):
            depth += (sql[end] == "(") - (sql[end] == ")")
            if depth == 0:
                break
        inner = sql[at + 6:end]
        if inner.endswith(", 6"):
            sql = f"{sql[:at]}(floor(({inner[:-3]}) * 1e6::DOUBLE + 0.5001::DOUBLE) / 1e6::DOUBLE){sql[end + 1:]}"
        start = at + 1
    return sql


def _cell(df: DataFrame) -> list[Column]:
    return [F.to_date("ts").alias("time"), (F.col("user_id") % N_LAT).cast("int").alias("i"),
            (F.floor(F.col("user_id") / N_LAT) % N_LON).cast("int").alias("j")]


def _with_t(df: DataFrame) -> DataFrame:
    return df.withColumn("t", F.datediff("time", F.lit(EPOCH)))


def cube_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(time, t, i, j, var, value): daily means per cell and channel."""
    e = table(spark, sf_dir, "events")
    means = e.select(*_cell(e), F.col("event_type").alias("var"), "value").groupBy("time", "i", "j", "var").agg(r6(F.avg("value")).alias("value"))
    return _with_t(means).select("time", "t", "i", "j", "var", "value")


def cube_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(time, t, i, j, v_view .. v_signup): one row per observed cell, in one shuffle."""
    e = table(spark, sf_dir, "events")
    channel = lambda name: r6(F.avg(F.when(F.col("event_type") == name, F.col("value"))))
    means = e.select(*_cell(e), "event_type", "value").groupBy("time", "i", "j").agg(*(channel(n).alias(f"v_{n}") for n in EVENT_TYPES))
    return _with_t(means).select("time", "t", "i", "j", *CHANNELS)


def with_latlon(df: DataFrame) -> DataFrame:
    """Coordinates of the cube's regular axes."""
    return df.withColumns({"lat": F.round(F.lit(20.05) + F.col("i") * F.lit(0.1), 2), "lon": F.round(F.lit(115.05) + F.col("j") * F.lit(0.1), 2)})


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(time, cell, value): frames on three days of each week, the first two days missing, holes inside frames.

    Every order counts on the day it falls on or, if there is no frame that day, on the next.
    """
    day = F.to_date("o_orderdate")
    weekday = F.datediff(day, F.lit(CAL_START)) % 7
    wait = F.when(weekday.isin(0, 4), 2).when(weekday.isin(1, 5), 1).otherwise(0)
    return table(spark, sf_dir, "orders").groupBy(F.date_add(day, wait).alias("time"), (F.col("o_custkey") % 8).cast("int").alias("cell")).agg(r6(F.avg("o_totalprice")).alias("value"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, cell, value): monthly frames without May and October, whose orders count in the month after."""
    day = F.to_date("o_orderdate")
    counted = F.add_months(day, F.when(F.month(day) % 5 == 0, 1).otherwise(0))
    return table(spark, sf_dir, "orders").groupBy(F.trunc(counted, "MM").alias("month"), (F.col("o_custkey") % 8).cast("int").alias("cell")).agg(
        r6(F.avg("o_totalprice")).alias("value"))


def ocean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, chla, par, sst, wind): inputs that reach every branch of the isoprene model."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.abs("l_discount") * F.col("l_quantity") / 5).alias("chla"),
        (F.col("l_extendedprice") / 50 - 15).alias("par"), (F.col("l_quantity") * 0.6).alias("sst"), (F.abs("l_tax") * 100).alias("wind"))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, value, flag): sentinels and a quality flag."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 11 == 0, F.lit(-9999.0)).otherwise(F.col("o_totalprice")).alias("value"),
        F.when(k % 7 == 0, None).otherwise((k % 3).cast("int")).alias("flag"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path): names of three products and one without a date."""
    d = F.date_format("o_orderdate", "yyyyMMdd")
    k = F.col("o_orderkey")
    padded = F.lpad(k.cast("string"), 8, "0")
    return table(spark, sf_dir, "orders").select(
        F.when(k % 4 == 0, F.concat(F.lit("GC1SG1_"), d, padded, F.lit("_L2MG_CHLA.nc")))
        .when(k % 4 == 1, F.concat(F.lit("GC1SG1_"), d, padded, F.lit("_L2MG_SST[ND]Q_SST.nc")))
        .when(k % 4 == 2, F.concat(F.lit("OMI_L3_"), F.substring(d, 1, 4), F.lit("m"), F.substring(d, 5, 4), F.lit("_v003.nc4")))
        .otherwise(F.concat(F.lit("readme_"), (k % 13).cast("string"), F.lit(".txt"))).alias("path"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, epoch, metric): five runs of thirty epochs."""
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 5).cast("int").alias("run"), (F.datediff(F.to_date("ts"), F.lit(EPOCH)) + 1).alias("epoch")).agg(
        r6(F.avg("value")).alias("metric"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, k, x): one row per feature."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x")).withColumn("x", F.col("x").cast("double"))


_CHANNEL_SQL = ", ".join(f"round(avg(CASE WHEN event_type = '{e}' THEN value END), 6) AS v_{e}" for e in EVENT_TYPES)

# In dependency order.
SQL_VIEWS = {
    "cell_events": "SELECT ts::DATE AS time, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS t, (user_id % 12)::INT AS i, "
                   "((user_id // 12) % 24)::INT AS j, event_type, value FROM events",
    "cube_long": "SELECT time, t, i, j, event_type AS var, round(avg(value), 6) AS value FROM cell_events GROUP BY ALL",
    "cube_wide": f"SELECT time, t, i, j, {_CHANNEL_SQL} FROM cell_events GROUP BY time, t, i, j",
    "cube": "SELECT *, round(20.05 + 0.1 * i, 2)::DOUBLE AS lat, round(115.05 + 0.1 * j, 2)::DOUBLE AS lon FROM cube_wide",
    "frames": "SELECT (o_orderdate::DATE + (CASE date_diff('day', DATE '1995-01-01', o_orderdate::DATE) % 7 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 1 ELSE 0 END)::INT)::DATE AS time, "
              "(o_custkey % 8)::INT AS cell, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY ALL",
    "all_days": "SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY))::DATE AS time",
    "monthly": "SELECT (date_trunc('month', o_orderdate) + CASE WHEN month(o_orderdate) % 5 = 0 THEN INTERVAL 1 MONTH ELSE INTERVAL 0 MONTH END)::DATE AS month, "
               "(o_custkey % 8)::INT AS cell, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY ALL",
    "ocean": "SELECT l_orderkey, l_linenumber, abs(l_discount) * l_quantity / 5 AS chla, l_extendedprice / 50 - 15 AS par, "
             "l_quantity * 0.6::DOUBLE AS sst, abs(l_tax) * 100 AS wind FROM lineitem",
    "iso1": "SELECT *, CASE WHEN chla <= 0.5 THEN 38 * pow(chla, 0.425) ELSE 40.2 * pow(chla, 0.507) END AS ct FROM ocean",
    "iso2": "SELECT *, CASE WHEN ct <= 13.62 THEN 4.6::DOUBLE / 426.3 * pow(ct, 0.547) ELSE 4.6::DOUBLE / 912.5 * pow(ct, 0.839) END AS kd FROM iso1",
    "iso3": "SELECT *, CASE WHEN par <= 11.425 THEN 0 WHEN kd = 0 THEN 'infinity'::DOUBLE ELSE -ln(11.425::DOUBLE / par) / kd END AS hm FROM iso2",
    "iso4": "SELECT *, least(hm, 1) AS h, CASE WHEN hm > 0 THEN ct / hm ELSE 0 END AS ca FROM iso3",
    "iso5": "SELECT *, CASE WHEN h = 0 THEN 0 WHEN kd = 0 THEN 0.042::DOUBLE * 3.6402 / (pow(sst + 1, 2) - 46.75 * (sst + 1) + 618.2) * pow(ln(par), 2) * h "
            "ELSE 0.042::DOUBLE * 3.6402 / (pow(sst + 1, 2) - 46.75 * (sst + 1) + 618.2) * (pow(ln(par), 3) - pow(ln(par) - kd * h, 3)) / (3 * kd) END AS integral FROM iso4",
    "iso6": "SELECT *, 86.8798::DOUBLE * ca * integral * 24 AS p, 0.14::DOUBLE * pow(ca, 1.28) AS kb, "
            "2675.0::DOUBLE - 147.12 * sst + 3.726 * sst * sst - 0.038 * sst * sst * sst AS sc FROM iso5",
    "iso7": "SELECT *, (0.222::DOUBLE * wind * wind + 0.333 * wind) * pow(sc / 600, -0.5) * 0.01 * 24 AS kw FROM iso6",
    "iso": "SELECT *, p / (kb + 0.05 + kw + 0.005) AS isoprene FROM iso7",
    "flagged": "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN -9999.0::DOUBLE ELSE o_totalprice END AS value, "
               "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 3)::INT END AS flag FROM orders",
    "files": "SELECT CASE o_orderkey % 4 WHEN 0 THEN 'GC1SG1_' || d || lpad(o_orderkey::VARCHAR, 8, '0') || '_L2MG_CHLA.nc' "
             "WHEN 1 THEN 'GC1SG1_' || d || lpad(o_orderkey::VARCHAR, 8, '0') || '_L2MG_SST[ND]Q_SST.nc' "
             "WHEN 2 THEN 'OMI_L3_' || substr(d, 1, 4) || 'm' || substr(d, 5, 4) || '_v003.nc4' "
             "ELSE 'readme_' || (o_orderkey % 13)::VARCHAR || '.txt' END AS path "
             "FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS d FROM orders)",
    "dated_files": "SELECT path, CASE WHEN regexp_matches(path, '\\d{8}') THEN try_strptime(regexp_extract(path, '\\d{8}'), '%Y%m%d')::DATE "
                   "WHEN regexp_matches(path, '\\d{4}m\\d{4}') THEN try_strptime(replace(regexp_extract(path, '\\d{4}m\\d{4}'), 'm', ''), '%Y%m%d')::DATE END AS date FROM files",
    "history": "SELECT (user_id % 5)::INT AS run, date_diff('day', DATE '2024-01-01', ts::DATE)::INT + 1 AS epoch, round(avg(value), 6) AS metric "
               "FROM events GROUP BY ALL",
    "vectors": "SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS k, unnest(embedding)::DOUBLE AS x FROM embeddings",
    "seqs": "SELECT unnest(range(24))::INT AS seq_start",
    "shuffled": "SELECT seq_start, (row_number() OVER (ORDER BY (seq_start * 7919 + 42) % 10007, seq_start) - 1)::INT AS pos FROM seqs",
    "splits": "SELECT CASE WHEN pos < 16 THEN 'train' WHEN pos < 21 THEN 'val' ELSE 'test' END AS split, "
              "(CASE WHEN pos < 16 THEN pos WHEN pos < 21 THEN pos - 16 ELSE pos - 21 END)::INT AS pos, seq_start FROM shuffled",
    "seq_rows": "SELECT c.*, s.seq_start, (c.t - s.seq_start)::INT AS step, CASE WHEN c.t - s.seq_start < 6 THEN 'input' ELSE 'target' END AS role "
                "FROM cube_wide c JOIN seqs s ON c.t >= s.seq_start AND c.t < s.seq_start + 7",
}


def with_views(sql: str) -> str:
    """Complete SQL: the views the text uses, directly or through others, then the text itself."""
    return stable_rounding(_prefixed(sql))


def _prefixed(sql: str) -> str:
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    ctes = [f"{name} AS ({SQL_VIEWS[name]})" for name in SQL_VIEWS if name in needed]
    if not ctes:
        return sql
    # a query that brings its own WITH continues the list
    if sql.lstrip().upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + sql.lstrip()[len("WITH RECURSIVE "):]
    if sql.lstrip().upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + sql.lstrip()[5:]
    return "WITH " + ", ".join(ctes) + " " + sql
