"""The driver's tables as the engine's inputs, in Spark and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EXTRAS = ["CS", "GR.B", "SCH40", "ASTM A-105", "", "SS304"]
#: Both Spark and DuckDB run this text.
RAW_SQL = (
    "concat(upper(p_name), ' ', cast(p_size as {s}), ' MM CLASS ', cast(150 * (1 + p_partkey % 4) as {s}), ' ', p_type, "
    "case p_partkey % 6 " + " ".join(f"when {i} then ' {x}'" for i, x in enumerate(EXTRAS)) + " end)"
)
COLUMNS_SQL = {
    "CPSE": "p_brand",
    "CPSE Material Code": "concat('P-', cast(p_partkey as {s}))",
    "Legacy_Sector_Code": "concat('L', cast(p_partkey % 97 as {s}))",
    "Sector": "case p_type when 'ECONOMY' then 'Power' when 'SMALL' then 'Steel' when 'LARGE' then 'Mining' else p_type end",
    "Material Category": "p_name",
    "UOM": "case when p_partkey % 3 = 0 then 'NOS' when p_partkey % 3 = 1 then 'SET' else '' end",
    "Raw Description": RAW_SQL,
    "Material/Grade": "case when p_partkey % 4 = 0 then 'B' end",
    "Dimensions": "case when p_partkey % 5 = 0 then concat(cast(p_size as {s}), ' NB SCH 40') end",
    "Specification/Standard": "case when p_partkey % 7 = 0 then 'ASTM A105' end",
    "Capacity/Rating": "case when p_partkey % 11 = 0 then '63 KVA' end",
    "Operating Parameter": "cast(null as {s})",
}


def materials(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """The parts as records; ``more`` are further columns of the same rows."""
    cols = [F.expr(e.format(s="string")).alias(n) for n, e in COLUMNS_SQL.items()]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rid"), *cols, *more)


MATERIALS_SQL = "materials AS (SELECT p_partkey AS rid, " + ", ".join(f'{e.format(s="varchar")} AS "{n}"' for n, e in COLUMNS_SQL.items()) + " FROM part)"


def material_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rid"), F.upper("p_name").alias("standardized"), F.concat("p_name", F.lit("#"), F.col("p_size").cast("string")).alias("gt_group"))


LABELS_SQL = "labels_ AS (SELECT p_partkey AS rid, p_name || '#' || p_size AS gt_group FROM part)"


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit log of ``events``: some errors are rollbacks of the event before them."""
    e = table(spark, sf_dir, "events")
    return e.selectExpr(
        "event_id", "cast(ts as timestamp) as ts", f"{ACTION_SQL} as action", "concat('u', cast(user_id as string)) as actor", "concat('NM-', cast(user_id % 50 as string)) as target",
        "case when event_id % 5 = 0 then '{}' else '{\"k\": 0}' end as before", f"case when {EMPTY_SQL} then '{{}}' else props end as after", "concat('reason of ', event_type) as reason",
        f"case when {BACK_SQL} then event_id - 1 end as compensates",
    )


BACK_SQL = "event_type = 'error' and event_id % 3 = 0 and event_id > 0"
EMPTY_SQL = "event_type = 'signup' and event_id % 4 = 0"
ACTION_SQL = f"case when {BACK_SQL} then 'rollback' when event_type = 'view' then 'update' when event_type = 'click' then 'approve' when event_type = 'purchase' then 'create' when event_type = 'signup' then 'reject' else 'merge' end"
AUDIT_SQL = (
    f"audit AS (SELECT event_id, ts, {ACTION_SQL} AS action, concat('u', cast(user_id as varchar)) AS actor, concat('NM-', cast(user_id % 50 as varchar)) AS target, "
    f"case when event_id % 5 = 0 then '{{}}' else '{{\"k\": 0}}' end AS before, case when {EMPTY_SQL} then '{{}}' else props end AS after, concat('reason of ', event_type) AS reason, "
    f"case when {BACK_SQL} then event_id - 1 end AS compensates FROM events)"
)
