"""Trip and zone tables derived from the order tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlith.session import work_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trip per order line: pickup near the order date, −60 to 1539 minutes long."""
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    c = F.col
    joined = (
        li.join(orders, c("l_orderkey") == c("o_orderkey"))
        .join(customers, c("o_custkey") == c("c_custkey"))
        .join(suppliers, c("l_suppkey") == c("s_suppkey"))
    )
    shift = (c("l_orderkey") * 37 + c("l_linenumber") * 11) % 4320 - 1440
    length = (c("l_partkey") * 7 + c("l_suppkey") * 13 + c("l_linenumber")) % 1600 - 60
    later = lambda minutes: F.timestamp_add("MINUTE", minutes, c("o_orderdate"))
    fare = F.when((c("l_returnflag") == "R") & (c("l_discount") == 0), -c("l_extendedprice")).otherwise(c("l_extendedprice"))
    return joined.select(
        F.when(c("l_linestatus") == "O", "green").otherwise("yellow").alias("taxi_type"),
        F.year("o_orderdate").alias("data_year"),
        F.month("o_orderdate").alias("data_month"),
        F.concat(F.lit("trips_"), F.year("o_orderdate").cast("string")).alias("source_file"),
        c("l_orderkey").alias("order_id"),
        c("l_linenumber").alias("line_id"),
        later(shift).alias("tpep_pickup_datetime"),
        later(shift + length).alias("tpep_dropoff_datetime"),
        (c("l_linenumber") - 2).alias("passenger_count"),
        F.when(c("l_quantity") != 50, c("l_quantity")).alias("trip_distance"),
        c("l_linenumber").alias("RatecodeID"),
        (c("c_nationkey") + 1).alias("PULocationID"),
        c("s_nationkey").alias("DOLocationID"),
        c("l_returnflag").alias("payment_type"),
        fare.alias("fare_amount"),
        (c("l_extendedprice") * c("l_discount")).alias("tip_amount"),
        (c("l_extendedprice") * c("l_tax")).alias("tolls_amount"),
        (fare * (1 + c("l_tax"))).alias("total_amount"),
    )


def stored_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw trips as a written table, for reports that read them more than once."""
    path = work_path(spark, "raw_trips")
    raw_trips(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


RAW_TRIPS = """
raw_trips AS (
  SELECT CASE WHEN l_linestatus = 'O' THEN 'green' ELSE 'yellow' END AS taxi_type,
         year(o_orderdate) AS data_year, month(o_orderdate) AS data_month,
         'trips_' || CAST(year(o_orderdate) AS VARCHAR) AS source_file,
         l_orderkey AS order_id, l_linenumber AS line_id,
         o_orderdate + to_minutes((l_orderkey * 37 + l_linenumber * 11) % 4320 - 1440) AS tpep_pickup_datetime,
         o_orderdate + to_minutes((l_orderkey * 37 + l_linenumber * 11) % 4320 - 1440
             + (l_partkey * 7 + l_suppkey * 13 + l_linenumber) % 1600 - 60) AS tpep_dropoff_datetime,
         l_linenumber - 2 AS passenger_count,
         CASE WHEN l_quantity <> 50 THEN l_quantity END AS trip_distance,
         l_linenumber AS RatecodeID, c_nationkey + 1 AS PULocationID, s_nationkey AS DOLocationID,
         l_returnflag AS payment_type,
         CASE WHEN l_returnflag = 'R' AND l_discount = 0 THEN -l_extendedprice ELSE l_extendedprice END AS fare_amount,
         l_extendedprice * l_discount AS tip_amount, l_extendedprice * l_tax AS tolls_amount,
         CASE WHEN l_returnflag = 'R' AND l_discount = 0 THEN -l_extendedprice ELSE l_extendedprice END * (1 + l_tax) AS total_amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
)"""

STAGED = (
    RAW_TRIPS
    + """,
staged AS (
  SELECT taxi_type, data_year, data_month, source_file, order_id, line_id,
         tpep_pickup_datetime AS pickup_datetime, tpep_dropoff_datetime AS dropoff_datetime,
         passenger_count, trip_distance, RatecodeID, PULocationID AS pickup_location_id, DOLocationID AS dropoff_location_id,
         payment_type, fare_amount, tip_amount, tolls_amount, total_amount,
         CAST(tpep_pickup_datetime AS DATE) AS pickup_date, CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour,
         (epoch_us(tpep_dropoff_datetime) - epoch_us(tpep_pickup_datetime)) / 1e6 / 60.0 AS duration_min,
         CASE WHEN tpep_dropoff_datetime > tpep_pickup_datetime THEN trip_distance /
             ((epoch_us(tpep_dropoff_datetime) - epoch_us(tpep_pickup_datetime)) / 1e6 / 3600.0) END AS speed_mph
  FROM raw_trips
),
flagged AS (
  SELECT *, pickup_datetime < make_date(data_year, data_month, 1)
            OR pickup_datetime >= make_date(data_year, data_month, 1) + INTERVAL 1 MONTH AS outside_target_month,
         dropoff_datetime <= pickup_datetime AS invalid_duration_order,
         duration_min <= 0 AS non_positive_duration, duration_min > 1440 AS duration_over_24h,
         trip_distance <= 0 AS non_positive_trip_distance, trip_distance > 100 AS distance_over_100_miles,
         speed_mph > 100 AS speed_over_100_mph, fare_amount < 0 AS negative_fare_amount,
         total_amount < 0 AS negative_total_amount
  FROM staged
),
clean AS (
  SELECT * FROM flagged
  WHERE NOT outside_target_month AND dropoff_datetime > pickup_datetime AND duration_min > 0 AND duration_min <= 1440
    AND trip_distance > 0 AND trip_distance <= 100 AND speed_mph > 0 AND speed_mph <= 100
    AND fare_amount >= 0 AND total_amount >= 0
)"""
)


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as zones, their regions as boroughs."""
    n = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
    )
    return n.select(
        F.col("n_nationkey").alias("location_id"),
        F.col("r_name").alias("borough"),
        F.col("n_name").alias("zone"),
        F.when(F.col("n_nationkey") % 3 == 0, "Core").otherwise("Outer").alias("service_zone"),
    )


ZONES = """
zones AS (
  SELECT n_nationkey AS location_id, r_name AS borough, n_name AS zone,
         CASE WHEN n_nationkey % 3 = 0 THEN 'Core' ELSE 'Outer' END AS service_zone
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
)"""


def rnd(expr: str, digits: int = 4) -> str:
    """Half-up rounding in SQL, the same form as ``half_up``."""
    return f"(sign({expr}) * floor(abs({expr}) * 1e{digits} + 0.5) / 1e{digits})"
