"""Stand-in environmental tables derived from the driver's TPC-H-like parquet.

The driver tables carry no pollutant or weather data, so daily series are
derived from them by aggregation (the formulas are listed in FIXTURES.md):
``lineitem`` by ship date stands in for pollutants, ``orders`` by order date
for weather, ``orders`` rows for the sub-daily weather text rows and
``pages`` for HTML. Every builder reads the whole table; its work grows with
the input. Each builder has an SQL twin used by the DuckDB oracle.

Station variants key the series by the nation of the supplier (lineitem) or
of the customer (orders). The dimension joins are left to Catalyst/AQE: they
become broadcast joins only while the dimension is under Spark's checked
``autoBroadcastJoinThreshold`` and sort-merge joins beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesframe.functions.scalar import np_round


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# pollutants from lineitem
# ---------------------------------------------------------------------------
def pollutant_rows(spark, sf_dir, by_station: bool = False) -> DataFrame:
    """Per-row pollutant stand-in (no aggregation); one row per lineitem."""
    li = table(spark, sf_dir, "lineitem")
    cols = [F.to_date("l_shipdate").alias("Date"),
            (F.col("l_quantity") / 6).alias("co"),
            (F.col("l_extendedprice") / 1400).alias("no2"),
            (F.col("l_extendedprice") / 1500).alias("o3"),
            (F.col("l_extendedprice") / 800).alias("pm10"),
            (F.col("l_extendedprice") / 80).alias("pm25"),
            (F.col("l_tax") * 1000).alias("so2")]
    if by_station:
        sup = table(spark, sf_dir, "supplier").select(
            F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("station"))
        return li.join(sup, "l_suppkey").select("station", *cols)
    return li.select(*cols)


def pollutants(spark, sf_dir, by_station: bool = False) -> DataFrame:
    """Daily pollutant series: ``Date, co, no2, o3, pm10, pm25, so2`` (+ ``station``).

    ``so2`` is 0 on every 9th day of the month so that zero-as-missing is exercised.
    """
    li = table(spark, sf_dir, "lineitem")
    keys = [F.to_date("l_shipdate").alias("Date")]
    if by_station:
        sup = table(spark, sf_dir, "supplier").select(
            F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("station"))
        li = li.join(sup, "l_suppkey")
        keys = [F.col("station")] + keys
    daily = li.groupBy(*keys).agg(
        (F.avg("l_quantity") / 6).alias("co"),
        (F.avg("l_extendedprice") / 1400).alias("no2"),
        (F.avg("l_extendedprice") / 1500).alias("o3"),
        (F.avg("l_extendedprice") / 800).alias("pm10"),
        (F.min("l_extendedprice") / 80).alias("pm25"),
        (F.avg("l_tax") * 1000).alias("so2_raw"))
    so2 = F.when(F.dayofmonth("Date") % 9 == 0, F.lit(0.0)).otherwise(F.col("so2_raw"))
    return daily.withColumn("so2", so2).drop("so2_raw")


POLLUTANTS_SQL = """
SELECT CAST(l_shipdate AS DATE) AS Date,
       avg(l_quantity) / 6 AS co,
       avg(l_extendedprice) / 1400 AS no2,
       avg(l_extendedprice) / 1500 AS o3,
       avg(l_extendedprice) / 800 AS pm10,
       min(l_extendedprice) / 80 AS pm25,
       CASE WHEN day(CAST(l_shipdate AS DATE)) % 9 = 0 THEN 0.0
            ELSE avg(l_tax) * 1000 END AS so2
FROM lineitem GROUP BY CAST(l_shipdate AS DATE)
"""

POLLUTANTS_STATION_SQL = """
SELECT s_nationkey AS station, CAST(l_shipdate AS DATE) AS Date,
       avg(l_quantity) / 6 AS co,
       avg(l_extendedprice) / 1400 AS no2,
       avg(l_extendedprice) / 1500 AS o3,
       avg(l_extendedprice) / 800 AS pm10,
       min(l_extendedprice) / 80 AS pm25,
       CASE WHEN day(CAST(l_shipdate AS DATE)) % 9 = 0 THEN 0.0
            ELSE avg(l_tax) * 1000 END AS so2
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
GROUP BY s_nationkey, CAST(l_shipdate AS DATE)
"""

POLLUTANT_ROWS_SQL = """
SELECT CAST(l_shipdate AS DATE) AS Date,
       l_quantity / 6 AS co, l_extendedprice / 1400 AS no2, l_extendedprice / 1500 AS o3,
       l_extendedprice / 800 AS pm10, l_extendedprice / 80 AS pm25, l_tax * 1000 AS so2
FROM lineitem
"""


# ---------------------------------------------------------------------------
# weather from orders
# ---------------------------------------------------------------------------
def weather(spark, sf_dir, by_station: bool = False) -> DataFrame:
    """Daily weather series: ``Date, Temp, Rain, Cloud, Pressure, Wind, Gust``."""
    o = table(spark, sf_dir, "orders")
    keys = [F.to_date("o_orderdate").alias("Date")]
    if by_station:
        cu = table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("station"))
        o = o.join(cu, "o_custkey")
        keys = [F.col("station")] + keys
    urgent = F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0))
    return o.groupBy(*keys).agg(
        (F.min("o_totalprice") / 5000 - 5).alias("Temp"),
        (F.greatest(urgent - 2, F.lit(0)) * 3).cast("double").alias("Rain"),
        (F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)) * 100).alias("Cloud"),
        (F.avg("o_totalprice") / 4000 + 950).alias("Pressure"),
        (F.max("o_totalprice") / 10000).alias("Wind"),
        (F.max("o_totalprice") / 6000).alias("Gust"))


WEATHER_SQL = """
SELECT CAST(o_orderdate AS DATE) AS Date,
       min(o_totalprice) / 5000 - 5 AS Temp,
       CAST(greatest(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) - 2, 0) * 3
            AS DOUBLE) AS Rain,
       avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) * 100 AS Cloud,
       avg(o_totalprice) / 4000 + 950 AS Pressure,
       max(o_totalprice) / 10000 AS Wind,
       max(o_totalprice) / 6000 AS Gust
FROM orders GROUP BY CAST(o_orderdate AS DATE)
"""

WEATHER_STATION_SQL = """
SELECT c_nationkey AS station, CAST(o_orderdate AS DATE) AS Date,
       min(o_totalprice) / 5000 - 5 AS Temp,
       CAST(greatest(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) - 2, 0) * 3
            AS DOUBLE) AS Rain,
       avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) * 100 AS Cloud,
       avg(o_totalprice) / 4000 + 950 AS Pressure,
       max(o_totalprice) / 10000 AS Wind,
       max(o_totalprice) / 6000 AS Gust
FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY c_nationkey, CAST(o_orderdate AS DATE)
"""


def weather_rows(spark, sf_dir) -> DataFrame:
    """Sub-daily weather rows as text with units, one per order (landing schema A3)."""
    o = table(spark, sf_dir, "orders")
    p = F.col("o_totalprice")

    def txt(x, unit):
        return F.concat(np_round(x, 1).cast("string"), F.lit(unit))

    rain = F.when(F.col("o_orderpriority") == "1-URGENT", p / 20000).otherwise(F.lit(0.0))
    return o.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"),
        F.lit("12:00").alias("Time"),
        F.col("o_orderpriority").alias("Weather"),
        txt(p / 5000 - 5, " °c").alias("Temp"),
        txt(rain, "\nmm").alias("Rain"),
        txt((F.col("o_custkey") % 101).cast("double"), "%").alias("Cloud"),
        txt(p / 4000 + 950, " mb").alias("Pressure"),
        txt(p / 10000, " km/h").alias("Wind"),
        txt(p / 6000, " km/h").alias("Gust"))


def _sql_txt(x: str, unit: str) -> str:
    unit_sql = unit.replace("\n", "' || chr(10) || '")
    return f"CAST(round_even(({x}) * 10, 0) / 10 AS VARCHAR) || '{unit_sql}'"


WEATHER_ROWS_SQL = f"""
SELECT strftime(o_orderdate, '%Y-%m-%d') AS Date, '12:00' AS Time, o_orderpriority AS Weather,
       {_sql_txt('o_totalprice / 5000 - 5', ' °c')} AS Temp,
       {_sql_txt("CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice / 20000 ELSE 0.0 END", chr(10) + 'mm')} AS Rain,
       {_sql_txt('CAST(o_custkey % 101 AS DOUBLE)', '%')} AS Cloud,
       {_sql_txt('o_totalprice / 4000 + 950', ' mb')} AS Pressure,
       {_sql_txt('o_totalprice / 10000', ' km/h')} AS Wind,
       {_sql_txt('o_totalprice / 6000', ' km/h')} AS Gust
FROM orders
"""


def series(spark, sf_dir, by_station: bool = False) -> DataFrame:
    """Merged daily table (pollutants inner-joined with weather on the day)."""
    keys = (["station"] if by_station else []) + ["Date"]
    return pollutants(spark, sf_dir, by_station).join(weather(spark, sf_dir, by_station), keys)


SERIES_SQL = f"""
SELECT p.Date, p.co, p.no2, p.o3, p.pm10, p.pm25, p.so2,
       w.Temp, w.Rain, w.Cloud, w.Pressure, w.Wind, w.Gust
FROM ({POLLUTANTS_SQL}) p JOIN ({WEATHER_SQL}) w ON p.Date = w.Date
"""

SERIES_STATION_SQL = f"""
SELECT p.station, p.Date, p.co, p.no2, p.o3, p.pm10, p.pm25, p.so2,
       w.Temp, w.Rain, w.Cloud, w.Pressure, w.Wind, w.Gust
FROM ({POLLUTANTS_STATION_SQL}) p JOIN ({WEATHER_STATION_SQL}) w
  ON p.station = w.station AND p.Date = w.Date
"""


# ---------------------------------------------------------------------------
# series with sensor outages (runs of missing days) for the fill operators
# ---------------------------------------------------------------------------
def pollutants_with_outages(spark, sf_dir) -> DataFrame:
    """Daily pollutants where ``co`` misses 10-day and ``no2`` 3-day runs.

    The outage pattern is a function of the day of the year; every row of the
    input stays in the output.
    """
    p = pollutants(spark, sf_dir)
    doy = F.dayofyear("Date")
    return p.withColumns({
        "co": F.when(doy % 40 >= 10, F.col("co")),
        "no2": F.when(doy % 23 >= 3, F.col("no2")),
    })


OUTAGES_SQL = f"""
SELECT Date,
       CASE WHEN dayofyear(Date) % 40 >= 10 THEN co END AS co,
       CASE WHEN dayofyear(Date) % 23 >= 3 THEN no2 END AS no2,
       o3, pm10, pm25, so2
FROM ({POLLUTANTS_SQL}) o_
"""


# ---------------------------------------------------------------------------
# raw pollutant text table (landing layout of a downloaded CSV)
# ---------------------------------------------------------------------------
RAW_HEADERS = {"date": "date", "pm25": " pm25", "pm10": " pm10", "o3": " o3",
               "no2": " no2", "so2": " so2", "co": " co"}


def pollutants_raw(spark, sf_dir) -> DataFrame:
    """Daily pollutants as text with padded headers; ``pm10`` is blank on
    every 50th day of the year and ``co`` has an unparsable cell on every
    61st day, as in landed files."""
    p = pollutants(spark, sf_dir)
    doy = F.dayofyear("Date")
    pm10 = F.when(doy % 50 == 0, F.lit(" ")).otherwise(F.col("pm10").cast("string"))
    co = F.when(doy % 61 == 0, F.lit("-")).otherwise(F.col("co").cast("string"))
    return p.select(F.date_format("Date", "yyyy/M/d").alias(RAW_HEADERS["date"]),
                    F.col("pm25").cast("string").alias(RAW_HEADERS["pm25"]),
                    pm10.alias(RAW_HEADERS["pm10"]),
                    F.col("o3").cast("string").alias(RAW_HEADERS["o3"]),
                    F.col("no2").cast("string").alias(RAW_HEADERS["no2"]),
                    F.col("so2").cast("string").alias(RAW_HEADERS["so2"]),
                    co.alias(RAW_HEADERS["co"]))


POLLUTANTS_RAW_SQL = f"""
SELECT strftime(Date, '%Y/%-m/%-d') AS "date",
       CAST(pm25 AS VARCHAR) AS " pm25",
       CASE WHEN dayofyear(Date) % 50 = 0 THEN ' ' ELSE CAST(pm10 AS VARCHAR) END AS " pm10",
       CAST(o3 AS VARCHAR) AS " o3", CAST(no2 AS VARCHAR) AS " no2", CAST(so2 AS VARCHAR) AS " so2",
       CASE WHEN dayofyear(Date) % 61 = 0 THEN '-' ELSE CAST(co AS VARCHAR) END AS " co"
FROM ({POLLUTANTS_SQL}) r_
"""
