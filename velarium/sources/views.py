"""Entry-shaped views of the given tables, as DataFrames and as the SQL that defines them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Country code of an entry by its number modulo 12.
COUNTRIES = ("US", "DE", "FR", "CN", "JP", "KR", "RU", "IN", "BR", "GB", "IT", "GR")
#: Region code of a person by region key.
REGIONS = ("AF", "AM", "AS", "EU", "ME")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*map(F.lit, COUNTRIES))
    key = F.col("p_partkey")
    advisor = F.floor(key / 3).cast("bigint")
    return read(spark, sf_dir, "part").select(
        key.alias("ord"),
        F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(", "), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("latin"),
        F.col("p_name").alias("native"),
        (F.lit(1900) + F.col("p_size")).cast("int").alias("birth"),
        F.col("p_type").alias("region"),
        F.element_at(codes, (key % 12 + 1).cast("int")).alias("country"),
        F.col("p_brand").alias("source"),
        F.when(advisor > 0, advisor).alias("advisor"),
    )


ENTRIES_SQL = f"""entries AS (
  SELECT p_partkey AS ord,
         split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1) AS latin,
         p_name AS native,
         CAST(1900 + p_size AS INTEGER) AS birth,
         p_type AS region,
         [{", ".join(f"'{c}'" for c in COUNTRIES)}][CAST(p_partkey % 12 + 1 AS INTEGER)] AS country,
         p_brand AS source,
         CASE WHEN p_partkey // 3 > 0 THEN CAST(p_partkey // 3 AS BIGINT) END AS advisor
  FROM part)"""


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*map(F.lit, REGIONS))
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("ord"),
        F.col("c_name").alias("latin"),
        F.element_at(codes, F.col("n_regionkey") + 1).alias("region"),
        F.col("n_name").alias("nation"),
        F.col("c_nationkey").alias("nationkey"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
    )


PERSONS_SQL = f"""persons AS (
  SELECT c_custkey AS ord, c_name AS latin, [{", ".join(f"'{c}'" for c in REGIONS)}][n_regionkey + 1] AS region,
         n_name AS nation, c_nationkey AS nationkey, c_mktsegment AS segment, c_acctbal AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def advisor_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(student, advisor), with some self loops and mutual pairs."""
    key = F.col("p_partkey")
    p = read(spark, sf_dir, "part").select(key)
    up = F.floor(key / 3).cast("bigint")
    plain = p.where(key >= 3).select(key.alias("student"), up.alias("advisor"))
    loops = p.where(key % 97 == 0).select(key.alias("student"), key.alias("advisor"))
    mutual = p.where((key % 101 == 0) & (key >= 3)).select(up.alias("student"), key.alias("advisor"))
    return plain.unionAll(loops).unionAll(mutual)


EDGES_SQL = """edges AS (
  SELECT p_partkey AS student, CAST(p_partkey // 3 AS BIGINT) AS advisor FROM part WHERE p_partkey >= 3
  UNION ALL SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 97 = 0
  UNION ALL SELECT CAST(p_partkey // 3 AS BIGINT), p_partkey FROM part WHERE p_partkey % 101 = 0 AND p_partkey >= 3)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Old and new state of orders: some keys dropped, some added, some prices changed."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gid"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    kept = o.where("gid % 10 <> 0").withColumn("price", F.when(F.col("gid") % 7 == 0, F.col("price") + 1).otherwise(F.col("price")))
    added = o.where("gid % 17 = 0").withColumn("gid", F.col("gid") + 100_000_000)
    return o, kept.unionAll(added)


SNAPSHOTS_SQL = """snap_old AS (
  SELECT o_orderkey AS gid, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS priority FROM orders),
snap_new AS (
  SELECT gid, status, CASE WHEN gid % 7 = 0 THEN price + 1 ELSE price END AS price, priority FROM snap_old WHERE gid % 10 <> 0
  UNION ALL SELECT gid + 100000000, status, price, priority FROM snap_old WHERE gid % 17 = 0)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "ts", "event_id", "value", F.col("user_id").alias("client"))


METRICS_SQL = "metrics AS (SELECT event_type AS metric, ts, event_id, value, user_id AS client FROM events)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, y = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return d.join(y, "doc_id").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 20000).alias("conf"), F.col("quality").cast("double").alias("y"))


PREDICTIONS_SQL = "predictions AS (SELECT doc_id, least(1.0, n_chars / 20000.0)::DOUBLE AS conf, quality::DOUBLE AS y FROM documents JOIN labels USING (doc_id))"
