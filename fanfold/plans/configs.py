"""Settings and configuration-document queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanfold.operators import configs as G
from fanfold.plans.registry import Inputs, query

FIELDS = ["google_cloud.project_id", "google_cloud.region", "google_cloud.bucket_name"]
MERGED_SQL = """merged AS (
  SELECT l.scope, l.key_path, l.value, l.layer FROM (
    SELECT scope, key_path, max_by(value, layer) AS value, max(layer) AS layer FROM fx_layers GROUP BY ALL) l
  WHERE NOT EXISTS (SELECT 1 FROM fx_layers o WHERE o.scope = l.scope AND o.layer > l.layer
    AND (starts_with(l.key_path, o.key_path || '.') OR starts_with(o.key_path, l.key_path || '.'))))"""
TYPE_SQL = """typed AS (SELECT exp_id, file, ok, doc_id, CASE WHEN json_extract(doc, '$.model') IS NOT NULL THEN 'basemodel'
  WHEN json_extract(doc, '$.modelset.sampling') IS NOT NULL THEN 'sampling' WHEN json_extract(doc, '$.modelset.calibration') IS NOT NULL THEN 'calibration'
  WHEN json_extract(doc, '$.output') IS NOT NULL THEN 'output' END AS type FROM fx_configs)"""
ROLE_SQL = TYPE_SQL + """, roles AS (SELECT exp_id, file, ok, CASE WHEN type IN ('sampling', 'calibration') THEN 'modelset'
  ELSE type END AS role FROM typed WHERE type IS NOT NULL)"""
# The full product, which only the check forms.
SETS_SQL = ROLE_SQL + """, sets AS (SELECT b.exp_id, b.file AS basemodel, m.file AS modelset, o.file AS output,
  b.ok AND m.ok AND coalesce(o.ok, true) AS passed FROM roles b JOIN roles m ON m.exp_id = b.exp_id AND m.role = 'modelset'
  LEFT JOIN roles o ON o.exp_id = b.exp_id AND o.role = 'output' WHERE b.role = 'basemodel')"""


def layers(t: Inputs) -> DataFrame:
    return t.fx("fx_layers")


def scopes(t: Inputs) -> DataFrame:
    return layers(t).select("scope").distinct()


def typed(t: Inputs) -> DataFrame:
    return G.with_type(t.fx("fx_configs"))


@query("g1_merge", f"WITH {MERGED_SQL} SELECT scope, key_path, value, layer FROM merged", "fx_layers")
def g1_merge(t: Inputs) -> DataFrame:
    return G.merge_layers(layers(t))


@query("g2_interp", """
SELECT scope, key_path, layer, replace(replace(value, '{environment}', 'prod'), '{profile}', scope) AS value FROM fx_layers
""", "fx_layers")
def g2_interp(t: Inputs) -> DataFrame:
    return layers(t).withColumn("value", G.interpolate(F.col("value"), {"environment": "prod", "profile": F.col("scope")}))


@query("g3_lookup", f"""
WITH {MERGED_SQL} SELECT s.scope, coalesce(value, 'us-central1') AS value FROM (SELECT DISTINCT scope FROM fx_layers) s
LEFT JOIN merged m ON m.scope = s.scope AND key_path = 'google_cloud.region'
""", "fx_layers")
def g3_lookup(t: Inputs) -> DataFrame:
    return G.lookup(G.merge_layers(layers(t)), scopes(t), "google_cloud.region", "us-central1")


@query("g4_type", f"WITH {TYPE_SQL} SELECT exp_id, file, coalesce(type, 'none') AS type FROM typed", "fx_configs")
def g4_type(t: Inputs) -> DataFrame:
    return typed(t).select("exp_id", "file", F.coalesce("type", F.lit("none")).alias("type"))


CHOSEN = "coalesce(max(file) FILTER (file = 'output.yaml'), max(file) FILTER (file = 'output.yml'))"


@query("g5_docs", f"""
WITH {TYPE_SQL} SELECT exp_id, type, count(*) AS n,
  coalesce(CASE WHEN count(*) = 1 THEN max(file) WHEN type = 'output' THEN {CHOSEN} END, 'multiple') AS file
FROM typed WHERE type IS NOT NULL GROUP BY exp_id, type
""", "fx_configs")
def g5_docs(t: Inputs) -> DataFrame:
    return G.resolve_docs(typed(t)).select("exp_id", "type", "n", F.coalesce("file", "error").alias("file"))


@query("g6_output", f"""
WITH {TYPE_SQL}, o AS (SELECT exp_id, count(*) AS n, coalesce({CHOSEN}, CASE WHEN count(*) = 1 THEN max(file) ELSE 'multiple' END) AS file
  FROM typed WHERE type = 'output' GROUP BY exp_id)
SELECT e.exp_id, coalesce(file, 'not found') AS file FROM (SELECT DISTINCT exp_id FROM typed) e LEFT JOIN o USING (exp_id)
""", "fx_configs")
def g6_output(t: Inputs) -> DataFrame:
    return G.resolve_output(typed(t)).select("exp_id", F.coalesce("file", "error").alias("file"))


@query("g6_named", f"""
WITH {TYPE_SQL} SELECT exp_id, CASE WHEN count(*) FILTER (file = 'output.yml') = 0 THEN 'not found'
  WHEN count(*) FILTER (file = 'output.yml' AND type = 'output') = 0 THEN 'not an output document' ELSE 'output.yml' END AS file
FROM typed GROUP BY exp_id
""", "fx_configs")
def g6_named(t: Inputs) -> DataFrame:
    return G.resolve_output(typed(t), "output.yml").select("exp_id", F.coalesce("file", "error").alias("file"))


DIR = "CASE doc_id % 3 WHEN 0 THEN 'e' || doc_id % 90 WHEN 1 THEN 'a/e' || doc_id % 90 ELSE 'b/c/e' || doc_id % 90 END"


@query("g7_locate", f"""
WITH dirs AS (SELECT DISTINCT {DIR} AS dir FROM documents), wanted AS (
  SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN 'x/e' || doc_id % 120 WHEN 1 THEN 'a/e' || doc_id % 90 ELSE 'e' || doc_id % 120 END AS exp_id
  FROM documents),
near AS (SELECT string_split(dir, '/')[-1] AS name, count(*) AS n, min(dir) AS found FROM dirs WHERE len(string_split(dir, '/')) <= 2 GROUP BY 1)
SELECT exp_id, CASE WHEN exp_id IN (SELECT dir FROM dirs) THEN exp_id WHEN n = 1 THEN found WHEN n > 1 THEN 'ambiguous' ELSE 'not found' END AS dir
FROM wanted LEFT JOIN near ON name = string_split(exp_id, '/')[-1]
""")
def g7_locate(t: Inputs) -> DataFrame:
    n = F.col("doc_id")
    name = lambda prefix, m: F.concat(F.lit(prefix), n % m)
    asked = F.when(n % 4 == 0, name("x/e", 120)).when(n % 4 == 1, name("a/e", 90)).otherwise(name("e", 120))
    dirs = t.documents.select(F.expr(DIR).alias("dir")).distinct()
    found = G.locate(t.documents.select(asked.alias("exp_id")).distinct(), dirs)
    return found.select("exp_id", F.coalesce("dir", "error").alias("dir"))


@query("g8_sets", f"WITH {SETS_SQL} SELECT exp_id, count(*) AS n_sets, count(*) FILTER (passed) AS n_passed FROM sets GROUP BY exp_id",
       "fx_configs")
def g8_sets(t: Inputs) -> DataFrame:
    return G.set_counts(typed(t)).where("n_sets > 0").select("exp_id", "n_sets", "n_passed")


@query("g8_members", f"""
WITH {ROLE_SQL} SELECT exp_id, role, file, row_number() OVER (PARTITION BY exp_id, role ORDER BY file) - 1 AS ordinal,
  count(*) OVER (PARTITION BY exp_id, role) AS n_role FROM roles
""", "fx_configs")
def g8_members(t: Inputs) -> DataFrame:
    return G.set_members(typed(t)).select("exp_id", "role", "file", "ordinal", "n_role")


@query("g8_pick", f"""
WITH {SETS_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY basemodel, modelset, output) - 1 AS set_no FROM sets),
picked AS (SELECT * FROM numbered WHERE set_no IN (0, 1))
SELECT exp_id, set_no, 'basemodel' AS role, basemodel AS file FROM picked
UNION ALL SELECT exp_id, set_no, 'modelset', modelset FROM picked
UNION ALL SELECT exp_id, set_no, 'output', output FROM picked WHERE output IS NOT NULL
""", "fx_configs")
def g8_pick(t: Inputs) -> DataFrame:
    wanted = t.fx("fx_configs").select("exp_id").distinct().select(
        "exp_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("set_no"))
    return G.pick_sets(G.set_members(typed(t)), wanted)


SUMMARY_SQL = f"""WITH {SETS_SQL}, per AS (SELECT e.exp_id, count(s.exp_id) AS n, count(*) FILTER (s.passed) AS good
  FROM (SELECT DISTINCT exp_id FROM fx_configs) e LEFT JOIN sets s ON s.exp_id = e.exp_id GROUP BY e.exp_id)"""


@query("g9_summary", f"""
{SUMMARY_SQL} SELECT count(*) AS total, count(*) FILTER (n > 0 AND good = n) AS passed, count(*) FILTER (n > 0 AND good < n) AS failed,
  count(*) FILTER (n = 0) AS errored FROM per
""", "fx_configs")
def g9_summary(t: Inputs) -> DataFrame:
    return G.validation_summary(typed(t))


@query("g9_by_set", f"""
{SUMMARY_SQL} SELECT sum(n)::bigint AS total, sum(good)::bigint AS passed, sum(n - good)::bigint AS failed, count(*) FILTER (n = 0) AS errored FROM per
""", "fx_configs")
def g9_by_set(t: Inputs) -> DataFrame:
    return G.validation_summary(typed(t), "by_set")


@query("g10_expand", "SELECT DISTINCT exp_id FROM fx_configs WHERE exp_id GLOB 'exp[12]?'", "fx_configs")
def g10_expand(t: Inputs) -> DataFrame:
    return G.expand_ids(t.fx("fx_configs"), "exp[12]?")


@query("g11_required", f"""
WITH {MERGED_SQL}, wanted AS (SELECT scope, unnest({FIELDS}) AS key_path FROM (SELECT DISTINCT scope FROM fx_layers))
SELECT w.scope, w.key_path, coalesce(value, '') <> '' AND NOT starts_with(coalesce(value, ''), 'your-') AS ok
FROM wanted w LEFT JOIN merged m ON m.scope = w.scope AND m.key_path = w.key_path
""", "fx_layers")
def g11_required(t: Inputs) -> DataFrame:
    return G.required_fields(G.merge_layers(layers(t)), scopes(t), FIELDS)
