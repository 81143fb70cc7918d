"""Tables of the shapes the operators work on, derived from the base tables.

Each text is valid in Spark and in DuckDB; ``{table}`` stands for a base table.
"""

from __future__ import annotations

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
               "benchmark labels conversations").split()

SQL = {
    # The run part of a path is made once per order and the files are grouped by short keys, so
    # the long path text is built only after the join.
    "fx_artifacts": """
        SELECT run_path || file AS path, length FROM (
          SELECT o_orderkey, 'pipeline/flu/' || substr(replace(cast(o_orderdate AS string), '-', ''), 1, 6) || '/' ||
            CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'hosp_' ELSE 'ed_' END ||
            cast(o_custkey % 20 AS string) || '/' ||
            substr(replace(cast(o_orderdate AS string), '-', ''), 1, 8) || '-' ||
            lpad(cast(o_orderkey % 24 AS string), 2, '0') || lpad(cast(o_orderkey % 60 AS string), 2, '0') ||
            '00-' || lpad(lower(hex(o_orderkey)), cast(greatest(8, length(hex(o_orderkey))) AS int), '0') || '/' AS run_path
          FROM {orders}) o
        JOIN (
          SELECT l_orderkey, CASE l_linenumber WHEN 1 THEN 'builder-artifacts/input_00000.pkl.gz'
              WHEN 2 THEN 'runner-artifacts/result_00000.pkl.gz'
              WHEN 3 THEN 'outputs/20240101-000000/posterior_grid.pdf'
              WHEN 4 THEN 'outputs/20240101-000000/quantiles_grid_sidebyside.pdf'
              WHEN 5 THEN 'outputs/20240101-000000/categorical_rate_trends.pdf'
              ELSE 'outputs/20240102-000000_m1/quantiles_compartments.csv.gz' END AS file,
            max(cast(l_quantity * 1000 AS bigint)) AS length
          FROM {lineitem} GROUP BY 1, 2) l ON l_orderkey = o_orderkey""",
    "fx_runs": """
        SELECT o_orderkey AS run_key, 7 AS n_expected, cast(o_orderdate AS date) AS day FROM {orders}""",
    "fx_results": """
        SELECT l_orderkey AS run_key, l_linenumber - 1 AS task_index,
          CASE WHEN min(l_returnflag) = 'R' THEN 'failed' ELSE 'ok' END AS status,
          round(sum(l_extendedprice), 2) AS duration
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "fx_trajectories": """
        SELECT event_type AS population, user_id AS traj_id, cast(ts AS date) AS date, 'S_to_I' AS variable,
          sum(value) AS value
        FROM {events} GROUP BY event_type, user_id, cast(ts AS date)""",
    "fx_executions": """
        SELECT 'projects/p/locations/l/workflows/w/executions/' || lpad(lower(hex(o_orderkey)), cast(greatest(8, length(hex(o_orderkey))) AS int), '0') || '-0000' AS name,
          CASE WHEN o_orderstatus = 'O' THEN 'ACTIVE' WHEN o_orderstatus = 'F' THEN 'SUCCEEDED' ELSE 'FAILED' END AS state,
          substr(cast(o_orderdate AS string), 1, 10) || 'T00:00:00Z' AS start_time,
          CASE WHEN o_orderstatus = 'O' THEN NULL ELSE substr(cast(o_orderdate AS string), 1, 10) || 'T' ||
            lpad(cast(o_orderkey % 24 AS string), 2, '0') || ':' || lpad(cast(o_orderkey % 60 AS string), 2, '0') ||
            ':30Z' END AS end_time,
          CASE WHEN o_orderkey % 17 = 0 THEN 'not json'
            ELSE '{{"exp_id": "flu/' || cast(o_custkey AS string) || '"}}' END AS argument
        FROM {orders}""",
    "fx_jobs": """
        SELECT 'stage-b-' || lpad(lower(hex(l_orderkey)), cast(greatest(8, length(hex(l_orderkey))) AS int), '0') AS job_id, 'runner' AS stage,
          cast(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS bigint) AS succeeded,
          cast(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS bigint) AS failed,
          cast(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS bigint) AS running, 0 AS pending
        FROM {lineitem} GROUP BY l_orderkey""",
    "fx_job_events": """
        SELECT 'job-' || cast(user_id AS string) AS job_id, ts,
          CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'SCHEDULED' WHEN 'error' THEN 'FAILED'
            WHEN 'purchase' THEN 'SUCCEEDED' ELSE 'RUNNING' END AS state
        FROM {events}""",
    "fx_logs": """
        SELECT event_id AS insert_id, ts AS timestamp,
          CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' WHEN 'signup' THEN 'WARNING'
            ELSE 'INFO' END AS severity,
          CASE WHEN event_id % 3 = 0 THEN '' ELSE 'event ' || event_type END AS text_payload,
          CASE WHEN event_id % 6 = 0 THEN '{{"message": "from ' || event_type || '"}}' ELSE props END AS json_payload,
          CASE user_id % 3 WHEN 0 THEN 'builder' WHEN 1 THEN 'runner' ELSE 'output' END AS stage,
          user_id AS task_index, value
        FROM {events}""",
    "fx_metrics": """
        SELECT 'run-' || cast(user_id % 10 AS string) || '-stage-' ||
          CASE user_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b-0' ELSE 'c-0' END AS instance_name,
          event_type AS metric, ts, value
        FROM {events}""",
    "fx_usage": """
        SELECT l_partkey AS machine_key,
          CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'proj-' || cast(l_suppkey % 5 AS string) END AS billing_project,
          l_returnflag AS stage, l_quantity AS hours, cast(l_shipdate AS date) AS day
        FROM {lineitem}""",
    "fx_prices": """
        SELECT p_partkey AS machine_key, p_brand || '-standard-' || cast(p_size AS string) AS machine_type,
          p_retailprice / 10000 AS usd_per_hour, p_size
        FROM {part}""",
    "fx_configs": """
        SELECT 'exp' || cast(doc_id % 127 AS string) AS exp_id,
          CASE WHEN doc_id % 7 = 0 THEN 'output' ELSE 'f' || cast(doc_id AS string) END ||
            CASE WHEN doc_id % 2 = 0 THEN '.yaml' ELSE '.yml' END AS file,
          CASE doc_id % 5 WHEN 0 THEN '{{"model":{{}}}}' WHEN 1 THEN '{{"modelset":{{"sampling":{{}}}}}}'
            WHEN 2 THEN '{{"modelset":{{"calibration":{{}}}}}}' WHEN 3 THEN '{{"output":{{}}}}' ELSE '{{}}' END AS doc,
          doc_id, doc_id % 11 <> 0 AS ok
        FROM {documents}""",
    "fx_layers": """
        SELECT 'env' || cast(o_custkey AS string) AS scope,
          CASE o_orderkey % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'a.b' WHEN 2 THEN 'a.b.c' WHEN 3 THEN 'google_cloud.region'
            WHEN 4 THEN 'google_cloud.project_id' ELSE 'k' || cast(o_orderkey % 7 AS string) || '.x' END AS key_path,
          CASE WHEN o_orderkey % 8 = 0 THEN 'your-value' ELSE o_orderpriority || '/{{environment}}/{{profile}}' END AS value,
          o_orderkey AS layer
        FROM {orders}""",
}
