"""Cost and sizing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanfold.functions import scalars as S
from fanfold.operators import cost as C
from fanfold.plans.registry import Inputs, query

LABELS = ["billing_project", "stage"]


def usage(t: Inputs) -> DataFrame:
    return t.fx("fx_usage")


def prices(t: Inputs) -> DataFrame:
    return t.fx("fx_prices")


def machines(t: Inputs) -> DataFrame:
    """Known machine types: those of the parts whose key is even."""
    even = prices(t).where("machine_key % 2 = 0")
    return even.groupBy("machine_type").agg(F.min("p_size").alias("vcpus"), (F.min("p_size") * 4096).alias("memory_mib"))


MACHINES_SQL = """machines AS (SELECT machine_type, min(p_size) AS vcpus, min(p_size) * 4096 AS memory_mib
  FROM fx_prices WHERE machine_key % 2 = 0 GROUP BY machine_type)"""


@query("k1_cost_by", """
SELECT coalesce(u.billing_project, '') AS billing_project, coalesce(u.stage, '') AS stage,
  (2 - grouping(u.billing_project) - grouping(u.stage))::integer AS depth,
  round(sum(hours * usd_per_hour), 6) AS cost, count(*) AS n
FROM fx_usage u JOIN fx_prices USING (machine_key) GROUP BY CUBE (u.billing_project, u.stage)
""", "fx_usage", "fx_prices")
def k1_cost_by(t: Inputs) -> DataFrame:
    return C.cost_by(C.cost(usage(t), prices(t)), LABELS).withColumn("cost", F.round("cost", 6)).na.fill("", LABELS)


@query("k1_sets", """
SELECT coalesce(u.billing_project, '') AS billing_project, coalesce(u.stage, '') AS stage,
  (2 - grouping(u.billing_project) - grouping(u.stage))::integer AS depth,
  round(sum(hours * usd_per_hour), 6) AS cost, count(*) AS n
FROM fx_usage u JOIN fx_prices USING (machine_key) GROUP BY GROUPING SETS ((u.stage), (u.billing_project), ())
""", "fx_usage", "fx_prices")
def k1_sets(t: Inputs) -> DataFrame:
    by = C.cost_by(C.cost(usage(t), prices(t)), LABELS, sets=[["stage"], ["billing_project"], []])
    return by.withColumn("cost", F.round("cost", 6)).na.fill("", LABELS)


@query("k2_cost", """
SELECT machine_type, round(sum(hours * usd_per_hour), 6) AS cost, round(sum(hours), 2) AS hours
FROM fx_usage JOIN fx_prices USING (machine_key) GROUP BY machine_type
""", "fx_usage", "fx_prices")
def k2_cost(t: Inputs) -> DataFrame:
    return C.cost(usage(t), prices(t)).groupBy("machine_type").agg(
        F.round(F.sum("cost"), 6).alias("cost"), F.round(F.sum("hours"), 2).alias("hours"))


@query("k2_unpriced", """
SELECT machine_key, count(*) AS n, round(coalesce(sum(hours * usd_per_hour), -1), 6) AS cost
FROM fx_usage LEFT JOIN (SELECT * FROM fx_prices WHERE machine_key % 3 > 0) USING (machine_key) GROUP BY machine_key
""", "fx_usage", "fx_prices")
def k2_unpriced(t: Inputs) -> DataFrame:
    known = prices(t).where("machine_key % 3 > 0")
    return C.cost(usage(t), known).groupBy("machine_key").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("cost"), F.lit(-1.0)), 6).alias("cost"))


@query("k3_specs", f"""
WITH {MACHINES_SQL} SELECT machine_key, p.machine_type, coalesce(vcpus * 1000, -1) AS cpu_milli, coalesce(memory_mib, -1) AS memory_mib
FROM fx_prices p LEFT JOIN machines USING (machine_type)
""", "fx_prices")
def k3_specs(t: Inputs) -> DataFrame:
    asked = prices(t).select("machine_key", "machine_type")
    return C.machine_specs(asked, machines(t)).na.fill(-1, ["cpu_milli", "memory_mib"])


@query("k4_suggest", f"""
WITH {MACHINES_SQL}, best AS (SELECT string_split(machine_type, '-')[1] AS family, machine_type AS suggestion,
  row_number() OVER (PARTITION BY string_split(machine_type, '-')[1] ORDER BY machine_type) AS rank FROM machines)
SELECT u.machine_type, suggestion, rank::integer AS rank FROM (SELECT DISTINCT machine_type FROM fx_prices
  WHERE machine_type NOT IN (SELECT machine_type FROM machines)) u
JOIN best ON family = string_split(u.machine_type, '-')[1] WHERE rank <= 5
""", "fx_prices")
def k4_suggest(t: Inputs) -> DataFrame:
    return C.suggest(prices(t), machines(t))


@query("k5_parts", """
SELECT machine_key, string_split(machine_type, '-')[1] AS family, string_split(machine_type, '-')[2] AS kind,
  cast(string_split(machine_type, '-')[3] AS integer) AS vcpus FROM fx_prices
""", "fx_prices")
def k5_parts(t: Inputs) -> DataFrame:
    return prices(t).select("machine_key", S.machine_parts(F.col("machine_type")).alias("p")).select("machine_key", "p.*")


@query("k6_class", """
SELECT c_custkey, CASE WHEN n < 100 THEN 'small' WHEN n < 1000 THEN 'medium' WHEN n < 10000 THEN 'large' ELSE 'very large' END AS size_class,
  CASE WHEN n < 100 THEN 1800 WHEN n < 1000 THEN 7200 ELSE 14400 END AS timeout,
  CASE WHEN n < 100 THEN '8' WHEN n < 1000 THEN '8-15' ELSE '16-32' END AS memory_gb,
  CASE WHEN n < 1000 THEN 'short' WHEN n < 5000 THEN 'medium' WHEN n < 10000 THEN 'long' ELSE 'very long' END AS run_class,
  CASE WHEN n < 1000 THEN 3600 WHEN n < 5000 THEN 18000 WHEN n < 10000 THEN 36000 ELSE 604800 END AS run_timeout
FROM (SELECT c_custkey, abs(c_acctbal) * 1.2 AS n FROM customer)
""")
def k6_class(t: Inputs) -> DataFrame:
    n = F.abs("c_acctbal") * 1.2
    return t.customer.select("c_custkey", C.gather_class(n).alias("g"), C.run_class(n / 1000).alias("r")).select(
        "c_custkey", "g.*", F.col("r.size_class").alias("run_class"), F.col("r.timeout").alias("run_timeout"))


# Classes as rows: neighbouring ones by nation, and wide ones that overlap them.
CLASS_ROWS = """SELECT n_name AS class, n_nationkey * 400.0 AS low, (n_nationkey + 1) * 400.0 AS high FROM {nation}
UNION ALL SELECT r_name, r_regionkey * 1000.0, CASE WHEN r_regionkey = 4 THEN NULL ELSE r_regionkey * 5000.0 END FROM {region}"""


@query("k6_table", f"""
SELECT class, count(*) AS n, round(sum(size), 2) AS total
FROM (SELECT abs(c_acctbal) AS size FROM customer) JOIN ({CLASS_ROWS.format(nation="nation", region="region")})
  ON size >= low AND (size < high OR high IS NULL) GROUP BY class
""")
def k6_table(t: Inputs) -> DataFrame:
    """Size classes from tables, met through bins."""
    sized = t.customer.select(F.abs("c_acctbal").alias("size"))
    classed = C.in_classes(sized, "size", t.sql(CLASS_ROWS))
    return classed.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("size"), 2).alias("total"))


@query("k7_override", """
SELECT c_custkey, CASE WHEN c_nationkey % 3 > 0 THEN c_nationkey % 3 ELSE 2 END AS cpu,
  CASE WHEN c_nationkey % 2 = 0 THEN 'c4d-standard-2' ELSE c_mktsegment END AS machine FROM customer
""")
def k7_override(t: Inputs) -> DataFrame:
    text = F.when(F.col("c_nationkey") % 2 == 0, "").otherwise(F.col("c_mktsegment"))
    return t.customer.select("c_custkey", S.number_override(F.col("c_nationkey") % 3, F.lit(2)).alias("cpu"),
                             S.text_override(text, F.lit("c4d-standard-2")).alias("machine"))


@query("k8_fits", f"""
WITH {MACHINES_SQL} SELECT machine_key, coalesce(cast(machine_key % 40 * 1000 <= vcpus * 1000 AND 65536 <= memory_mib AS string), 'unknown') AS fits
FROM fx_prices LEFT JOIN machines USING (machine_type)
""", "fx_prices")
def k8_fits(t: Inputs) -> DataFrame:
    wanted = prices(t).select("machine_key", "machine_type", (F.col("machine_key") % 40 * 1000).alias("want_cpu_milli"),
                              F.lit(65536).alias("want_memory_mib"))
    return C.fits(wanted, machines(t)).select(
        "machine_key", F.coalesce(F.col("fits").cast("string"), F.lit("unknown")).alias("fits"))
