"""Tables of a data folder, and views on them with gaps, classes, predictions and bookkeeping rows.

The view texts are plain SQL that Spark and the checking engine read alike.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "customer_gap": """
        select c_custkey,
               case when c_custkey % 11 = 0 then null else c_acctbal end as c_acctbal,
               case when c_custkey % 13 = 0 then null else c_mktsegment end as c_mktsegment,
               c_nationkey
        from customer""",
    "orders_gap": """
        select o_orderkey,
               case when o_orderkey % 17 = 0 then null else o_orderdate end as o_orderdate,
               o_totalprice, o_orderpriority
        from orders""",
    "customer_cls": """
        select c_custkey, c_acctbal, c_nationkey, case when c_custkey % 10 = 0 then 'pos' else 'neg' end as y
        from customer""",
    "pred_cls": """
        select l_orderkey, l_linenumber, l_returnflag as y,
               case when l_discount > 0.06 then 'R' when l_tax > 0.04 then 'A' else 'N' end as yhat,
               l_linestatus as s
        from lineitem""",
    "pred_bin": """
        select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 1 else 0 end as y,
               case when l_quantity > 30 then 1 else 0 end as yhat, l_linestatus as s
        from lineitem""",
    "pred_reg": """
        select l_orderkey, l_linenumber, l_extendedprice as y, l_quantity * 1000 * (1 - l_discount) as yhat
        from lineitem""",
    "versions": """
        select o_custkey as dataset_id,
               row_number() over (partition by o_custkey order by o_orderkey) - 1 as version_id,
               row_number() over (partition by o_custkey order by o_orderkey) - 2 as prev_id,
               o_orderkey as job_id, o_orderstatus as job_status, o_orderdate as creation_time,
               case when o_orderkey % 23 = 0 then true else false end as is_deleted
        from orders""",
    "members_now": """
        select c_nationkey as project_id, c_custkey as user_id, c_mktsegment as role
        from customer where c_custkey % 3 <> 0""",
    "members_want": """
        select c_nationkey as project_id, c_custkey as user_id,
               case when c_custkey % 5 = 0 then 'OWNER' else c_mktsegment end as role
        from customer where c_custkey % 4 <> 0""",
}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A base table, or a view over base tables."""
    if name in TABLES:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    return over(spark, folder, VIEWS[name])


def over(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """Run SQL text over the folder's tables."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    return spark.sql(
        re.sub(rf"\b({'|'.join(TABLES)})\b", lambda m: "{" + m.group(1) + "}", text),
        **{t: spark.read.parquet(f"{folder}/{t}.parquet") for t in used},
    )


def with_views(text: str, *names: str) -> str:
    """Checking SQL with the named views as leading common table expressions."""
    return "with " + ", ".join(f"{n} as ({VIEWS[n]})" for n in names) + (", " if text.lstrip().startswith("+") else " ") + text.lstrip().lstrip("+")
