"""Queries over sources, schema and validation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import schema as sc
from ..operators.rows import sanitize_names
from ..session import scratch_path, shuffle_width
from ..sources import tables as st
from .tools import Book, rounded
from .views import VIEWS, over, table

BOOK = Book()
GAP = VIEWS["customer_gap"]


def _as_csv(spark, df, sep=",", header=True, name="csv", **options):
    path = scratch_path(spark, name)
    df.write.options(header=header, sep=sep, nullValue="NA", **options).csv(path)
    return path


def _read_csv(spark, folder):
    path = _as_csv(spark, table(spark, folder, "customer_gap"), sep=";", name="customers")
    return st.read_csv(spark, path, sep=";")


BOOK.add(
    "read_csv",
    _read_csv,
    f"with t as ({GAP}) select c_custkey::bigint as c_custkey, c_acctbal, c_mktsegment, c_nationkey::bigint as c_nationkey from t",
)


def _skiprows(spark, folder):
    """Files with two comment lines before their header, as an export of many files has them."""
    files = 4 * shuffle_width(spark)
    rows = table(spark, folder, "supplier").select(
        F.pmod(F.col("s_suppkey"), F.lit(files)).alias("file"),
        F.col("s_suppkey").alias("o"),
        F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name", F.col("s_acctbal").cast("string")).alias("value"),
    )
    heads = F.array(
        *[F.struct(F.lit(i).cast("bigint").alias("o"), F.lit(v).alias("value")) for i, v in ((-3, "# exported"), (-2, "# two notes"), (-1, "s_suppkey,s_name,s_acctbal"))]
    )
    tops = rows.select("file").distinct().select("file", F.inline(heads))
    path = scratch_path(spark, "notes")
    rows.union(tops).repartition("file").sortWithinPartitions("file", "o").select("file", "value").write.partitionBy("file").text(path)
    return st.cast_inferred(st.skiprows(spark, path, 2))


BOOK.add("skiprows", _skiprows, "select s_suppkey, s_name, s_acctbal from supplier")


def _na_tokens(spark, folder):
    df = over(
        spark,
        folder,
        "select doc_id, case when doc_id % 7 = 0 then 'N/A' when doc_id % 5 = 0 then '' else source end as source from documents",
    )
    return st.na_tokens(df)


BOOK.add(
    "na_tokens",
    _na_tokens,
    "select doc_id, case when doc_id % 7 = 0 then null when doc_id % 5 = 0 then null else source end as source from documents",
)


def _infer_types(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", "l_shipdate")
    flag = F.when(F.col("l_quantity") > 25, "True").otherwise("False")
    return st.infer_types(df.withColumn("big", flag).select(*[F.col(c).cast("string").alias(c) for c in [*df.columns, "big"]]))


INFER = " union all ".join(
    f"""select '{c}' as "column", case when count(*) filter (regexp_full_match(v, '[+-]?[0-9]+')) = count(v) then 'bigint'
        when count(try_cast(v as double)) = count(v) then 'double'
        when count(*) filter (lower(v) in ('true', 'false')) = count(v) then 'boolean' else 'string' end as type
        from (select {e}::varchar as v from lineitem)"""
    for c, e in [
        ("l_orderkey", "l_orderkey"),
        ("l_quantity", "l_quantity"),
        ("l_returnflag", "l_returnflag"),
        ("l_shipdate", "l_shipdate"),
        ("big", "case when l_quantity > 25 then 'True' else 'False' end"),
    ]
)
BOOK.add("infer_types", _infer_types, INFER)


def _write_version(spark, folder):
    root = scratch_path(spark, "store")
    st.write_version(table(spark, folder, "orders_gap"), root, 7, 1)
    return st.read_version(spark, root, 7, 1)


BOOK.add("write_version", _write_version, VIEWS["orders_gap"])


def _preview(spark, folder):
    """The whole table is written in key order; the preview is its first ten rows."""
    root = scratch_path(spark, "preview")
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority").orderBy("o_orderkey")
    st.write_version(df, root, 1, 0, as_csv=True)
    return st.preview(spark, st.version_path(root, 1, 0))


BOOK.add("preview", _preview, "select o_orderkey, o_totalprice, o_orderpriority from orders order by o_orderkey limit 10")


def _reencode(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    path = _as_csv(spark, df, sep="\t", name="parts", encoding="ISO-8859-1")
    saved, meta = st.reencode(spark, path, scratch_path(spark, "store"), 3, 1, sep="\t", encoding="ISO-8859-1")
    sums = saved.agg(F.round(F.sum("p_retailprice"), 2).alias("price"), F.sum("p_size").alias("size"))
    size, price = F.lit(sums.first()["size"]), F.lit(sums.first()["price"])
    return meta.select("row_count", "col_count", price.alias("price"), size.alias("size"))


BOOK.add(
    "reencode",
    _reencode,
    "select count(*) as row_count, 4::integer as col_count, round(sum(p_retailprice), 2) as price, sum(p_size)::bigint as size from part",
)


def _json(spark, folder):
    """Events written as JSON lines and read back; their nested text parsed as well."""
    path = scratch_path(spark, "events")
    table(spark, folder, "events").select("event_id", "event_type", "value", "props").write.json(path)
    rows = st.read_json_rows(spark, path, "event_id bigint, event_type string, value double, props string")
    return rounded(st.json_rows(rows, "props", "k bigint"))


BOOK.add(
    "read_json_rows",
    _json,
    "select event_id, event_type, round(value, 6) as value, json_extract_string(props, '$.k')::bigint as k from events",
)


def _group(spark, folder):
    root = scratch_path(spark, "groups")
    df = table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    st.feature_group_write(df, "c_custkey", root, "balances", dt.datetime(2024, 1, 2, 3, 4, 5))
    return root


def _group_raw(spark, folder):
    return spark.read.parquet(_group(spark, folder) + "/balances").withColumn("date", F.col("date").cast("string"))


BOOK.add(
    "feature_group_write",
    _group_raw,
    """select c_custkey, c_acctbal, c_mktsegment, timestamp '2024-01-02 03:04:05' as datetime, '2024-01-02' as date from customer""",
)
BOOK.add(
    "feature_group_read",
    lambda spark, folder: st.feature_group_read(spark, _group(spark, folder), "balances"),
    "select c_custkey, c_acctbal, c_mktsegment from customer",
)

BOOK.add(
    "select_columns",
    lambda spark, folder: sc.select_columns(
        table(spark, folder, "orders"),
        ["o_orderkey", "o_totalprice", "o_orderpriority"],
        {"o_orderkey": "string", "o_totalprice": "string", "o_orderpriority": "bigint"},
    ).withColumn("o_totalprice", F.col("o_totalprice").cast("double")),
    "select o_orderkey::varchar as o_orderkey, o_totalprice, null::bigint as o_orderpriority from orders",
)
BOOK.add(
    "sanitize_names",
    lambda spark, folder: sanitize_names(
        table(spark, folder, "customer")
        .select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
        .toDF("c custkey", "c-name", "c.acct#bal", "c_mktsegment")
    ),
    "select c_custkey as ccustkey, c_name as cname, c_acctbal as cacctbal, c_mktsegment from customer",
)

MIXED = """select l_orderkey, l_quantity, l_linenumber, l_returnflag, cast(l_shipdate as date) as ship,
    case when l_quantity > 25 then 'true' else 'no' end as flag, l_orderkey || '-' || l_linenumber as code,
    cast(cast(l_shipdate as date) as varchar) as day from lineitem"""
KINDS = f"""with t as ({MIXED}), n as (select count(*) as n from t),
    few as (select (n - count(distinct l_orderkey)) / n::double as a, (n - count(distinct l_quantity)) / n::double as b,
            (n - count(distinct l_linenumber)) / n::double as c, (n - count(distinct l_returnflag)) / n::double as d,
            (n - count(distinct ship)) / n::double as e, (n - count(distinct code)) / n::double as g, n from t, n group by n),
    k as (select case when n < 50 then 0.7 else 0.9 end as s, * from few)"""
KIND_COLUMNS = [
    ("l_orderkey", "case when a >= s then 'ordinal' else 'int64' end"),
    ("l_quantity", "case when b >= s then 'ordinal' else 'float64' end"),
    ("l_linenumber", "case when c >= s then 'ordinal' else 'int32' end"),
    ("l_returnflag", "case when d >= s then 'category' else 'str' end"),
    ("ship", "case when e >= s then 'ordinal' else 'datetime64[ns]' end"),
    ("flag", "'bool'"),
    ("code", "case when g >= s then 'category' else 'str' end"),
    ("day", "'datetime'"),
]
MIXED_SPARK = MIXED.replace("varchar", "string")
BOOK.add(
    "infer_logical_types",
    lambda spark, folder: sc.logical_types(over(spark, folder, MIXED_SPARK)),
    KINDS
    + " union all ".join(
        f""" select '{c}' as "column", {e} as kind, {i}::integer as position from k""" for i, (c, e) in enumerate(KIND_COLUMNS)
    ),
)
BOOK.add(
    "table_meta",
    lambda spark, folder: sc.table_meta(over(spark, folder, MIXED_SPARK)),
    KINDS
    + " select n as row_count, 8::integer as col_count, '{' || "
    + " || ',' || ".join(f"""'"{c}":"' || {e} || '"'""" for c, e in KIND_COLUMNS)
    + " || '}' as col_info from k",
)

QUERIES, SQL = BOOK.queries, BOOK.sql
