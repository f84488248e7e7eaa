"""Feature queries."""

from __future__ import annotations

from ..operators import collinear as cl, combine as cb, dates as dt
from ..plans.features import fe_apply, fe_pipeline, feature_engineer
from .tools import Book, rounded
from .views import VIEWS, over, table

BOOK = Book()
LINE = ("l_orderkey", "l_linenumber")
GAP = VIEWS["orders_gap"]


def _line(spark, folder, *columns):
    return table(spark, folder, "lineitem").select(*LINE, *columns)


BOOK.add(
    "dt_clean_date",
    lambda spark, folder: dt.dt_clean_date(table(spark, folder, "events").select("event_id", "ts"), "ts"),
    "select event_id, ts, strftime(ts, '%B-%d-%Y %I:%M %p') as clean_date from events",
)


def _parts(t: str) -> str:
    return f"""cast(day({t}) as varchar) as "Day_of_Month", strftime({t}, '%B') as "Month", cast(year({t}) as varchar) as "Year",
        strftime({t}, '%A') as "Day_of_week",
        case when isodow({t}) < 6 then 'Week Day' when isodow({t}) >= 6 then 'Weekend' end as "Working_Day_Type",
        case quarter({t}) when 1 then '1st Quarter' when 2 then '2nd Quarter' when 3 then '3rd Quarter' when 4 then '4th Quarter' end
        as "Type_of_Quarter", cast(hour({t}) as integer) as "Hour", cast(minute({t}) as integer) as "Minutes" """


BOOK.add(
    "dt_parts",
    lambda spark, folder: dt.dt_parts(table(spark, folder, "events").select("event_id", "ts"), "ts"),
    f"select event_id, ts, {_parts('ts')} from events",
)
EMPTY = "select o_orderkey, o_orderdate, cast(null as varchar) as nothing, cast(null as bigint) as blank from orders"
BOOK.add(
    "dt_drop_empty",
    lambda spark, folder: dt.dt_drop_empty(
        over(spark, folder, EMPTY.replace("varchar", "string")), ["o_orderdate", "nothing", "blank"]
    ),
    "select o_orderkey, o_orderdate from orders",
)
BOOK.add(
    "poly_features",
    lambda spark, folder: rounded(
        cb.poly_features(
            _line(spark, folder, "l_quantity", "l_discount"),
            [{"feature": "l_quantity", "degree": 3}, {"feature": "l_discount", "degree": 2}],
        )
    ),
    """select l_orderkey, l_linenumber, round(l_quantity, 6) as l_quantity, round(l_discount, 6) as l_discount,
       round(pow(l_quantity, 2), 6) as "l_quantity^2", round(pow(l_quantity, 3), 6) as "l_quantity^3",
       round(pow(l_discount, 2), 6) as "l_discount^2" from lineitem""",
)
BOOK.add(
    "fe_concat",
    lambda spark, folder: cb.fe_concat(
        _line(spark, folder, "l_returnflag", "l_linestatus"), ["l_returnflag", "l_linestatus", "l_linenumber"], "@"
    ),
    """select l_orderkey, l_linenumber, l_returnflag, l_linestatus,
       l_returnflag || '@' || l_linestatus || '@' || l_linenumber as "@l_returnflag@l_linestatus@l_linenumber" from lineitem""",
)


def _combined(name, function, features, sql, digits=6):
    columns = ", ".join(f"round({f}, {digits}) as {f}" for f in features)
    BOOK.add(
        name,
        lambda spark, folder: rounded(function(_line(spark, folder, *features), features), digits),
        f"select l_orderkey, l_linenumber, {columns}, {sql} from lineitem",
    )


_combined("fe_product", cb.fe_product, ["l_quantity", "l_discount"], 'round(l_quantity * l_discount, 6) as "Product:  l_quantity l_discount"')
_combined(
    "fe_addition",
    cb.fe_addition,
    ["l_extendedprice", "l_quantity"],
    'round(l_extendedprice + l_quantity, 6) as "Sum:  l_extendedprice l_quantity"',
)
_combined(
    "fe_subtraction",
    cb.fe_subtraction,
    ["l_extendedprice", "l_quantity", "l_tax"],
    'round(l_extendedprice - (l_quantity + l_tax), 6) as "sub:  l_extendedprice l_quantity l_tax"',
    4,
)
_combined(
    "fe_ratio",
    cb.fe_ratio,
    ["l_extendedprice", "l_quantity", "l_discount"],
    'round(case when l_discount <> 0 and l_quantity <> 0 then l_extendedprice / l_quantity / l_discount end, 6) '
    'as "Ratio/l_extendedprice/l_quantity/l_discount"',
)
BOOK.add(
    "fe_math_batch",
    lambda spark, folder: rounded(
        cb.fe_math_batch(
            _line(spark, folder, "l_quantity", "l_tax"),
            [
                {"feature": ["l_quantity", "l_tax"], "operationType": "Addition"},
                {"feature": ["Sum:  l_quantity l_tax", "l_quantity"], "operationType": "ratio"},
                {"feature": ["l_orderkey", "l_linenumber"], "operationType": "concat", "concat_using": "-"},
            ],
        ),
        9,
    ),
    """select l_orderkey, l_linenumber, round(l_quantity, 9) as l_quantity, round(l_tax, 9) as l_tax,
       round(l_quantity + l_tax, 9) as "Sum:  l_quantity l_tax",
       round((l_quantity + l_tax) / l_quantity, 9) as "Ratio/Sum:  l_quantity l_tax/l_quantity",
       l_orderkey || '-' || l_linenumber as "-l_orderkey-l_linenumber" from lineitem""",
)

V3 = ["l_quantity", "l_extendedprice", "l_discount"]
GRAM3 = """with s as (select sum(l_quantity * l_quantity) as a, sum(l_quantity * l_extendedprice) as b, sum(l_quantity * l_discount) as c,
    sum(l_extendedprice * l_extendedprice) as d, sum(l_extendedprice * l_discount) as e, sum(l_discount * l_discount) as f from lineitem),
    g as (select *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) as det from s),
    v as (select a * (d * f - e * e) / det as v1, d * (a * f - c * c) / det as v2, f * (a * d - b * b) / det as v3, * from g)"""
BOOK.add(
    "vif_scores",
    lambda spark, folder: rounded(cl.vif_scores(table(spark, folder, "lineitem").select(*V3))),
    GRAM3
    + """ select 'l_quantity' as feature, round(v1, 6) as vif from v
    union all select 'l_extendedprice', round(v2, 6) from v union all select 'l_discount', round(v3, 6) from v""",
)
BOOK.add(
    "drop_collinear",
    lambda spark, folder: rounded(cl.collinear_report(table(spark, folder, "lineitem").select(*V3), 3.0)),
    # three columns: drop the worst, then the pair left has equal scores, so a pair over the limit loses its first
    GRAM3
    + """, w as (select greatest(v1, v2, v3) as top, * from v),
    p as (select case when top < 3 then 0 when v1 = top then 1 when v2 = top then 2 else 3 end as gone, * from w),
    pair as (select gone, case gone when 1 then d * f / (d * f - e * e) when 2 then a * f / (a * f - c * c)
             when 3 then a * d / (a * d - b * b) end as duo, v1, v2, v3 from p),
    u as (select 'l_quantity' as feature, 1 as i, v1 as alone, gone, duo from pair
          union all select 'l_extendedprice', 2, v2, gone, duo from pair union all select 'l_discount', 3, v3, gone, duo from pair),
    k as (select *, row_number() over (order by i) as r from u where i <> gone),
    l as (select feature, i, case when gone = 0 then alone when duo >= 3 then 1.0::double else duo end as vif from k
          where gone = 0 or duo < 3 or r = 2)
    select feature, round(vif, 6) as vif, cast(row_number() over (order by round(vif, 6), i) - 1 as integer) as position from l""",
)
BOOK.add(
    "pca",
    lambda spark, folder: rounded(
        cl.pca(_line(spark, folder, "l_quantity", "l_discount"), 2, ["l_quantity", "l_discount"], LINE), 5
    ),
    """with m as (select avg(l_quantity) as mq, avg(l_discount) as md, var_pop(l_quantity) as a, covar_pop(l_quantity, l_discount) as b,
        var_pop(l_discount) as c from lineitem),
    e as (select *, (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) as l1 from m),
    n as (select *, sqrt(b * b + (l1 - c) * (l1 - c)) as size from e),
    w as (select mq, md, (l1 - c) / size as u1, b / size as u2 from n)
    select l_orderkey, l_linenumber,
        round(case when abs(u1) >= abs(u2) then sign(u1) else sign(u2) end
              * ((l_quantity - mq) * u1 + (l_discount - md) * u2), 5) + 0.0::double as "0",
        round(case when abs(u2) >= abs(u1) then sign(-u2) else sign(u1) end
              * ((l_quantity - mq) * -u2 + (l_discount - md) * u1), 5) + 0.0::double as "1"
    from lineitem, w""",
)

REQUEST = {
    "DateTime": {"feature": "o_orderdate"},
    "polynomial_Features": {"feature_degree": [{"feature": "o_orderkey", "degree": 2}]},
    "math_Ops": {
        "features_Operation": [
            {"feature": ["o_orderkey", "o_orderpriority"], "operationType": "concat", "concat_using": "@"},
            {"feature": ["o_totalprice", "o_orderkey"], "operationType": "ratio"},
        ]
    },
}
REQUEST_COLUMNS = f"""o_orderkey, o_orderdate, round(o_totalprice, 6) as o_totalprice, o_orderpriority,
    strftime(o_orderdate, '%B-%d-%Y %I:%M %p') as clean_date, {_parts('o_orderdate')},
    round(pow(o_orderkey, 2), 6) as "o_orderkey^2", o_orderkey || '@' || o_orderpriority as "@o_orderkey@o_orderpriority",
    round(case when o_orderkey <> 0 then o_totalprice / o_orderkey end, 6) as "Ratio/o_totalprice/o_orderkey" """
BOOK.add(
    "fe_pipeline",
    lambda spark, folder: rounded(fe_pipeline(table(spark, folder, "orders_gap"), REQUEST)),
    f"with t as ({GAP}) select {REQUEST_COLUMNS} from t",
)


def _applied(spark, folder):
    """Fit on orders with gaps, save, apply to the orders without."""
    _, chain = feature_engineer(table(spark, folder, "orders_gap"), REQUEST)
    new = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    return rounded(fe_apply(new, chain.to_json()))


BOOK.add("fe_apply", _applied, f"select {REQUEST_COLUMNS} from orders")
BOOK.add(
    "fe_interaction",
    lambda spark, folder: rounded(
        cb.fe_interaction(_line(spark, folder, "l_quantity", "l_discount", "l_tax"), ["l_quantity", "l_discount", "l_tax"])
    ),
    """select l_orderkey, l_linenumber, round(l_quantity, 6) as l_quantity, round(l_discount, 6) as l_discount, round(l_tax, 6) as l_tax,
       round(l_quantity * l_discount, 6) as l_quantity_l_discount, round(l_quantity * l_tax, 6) as l_quantity_l_tax,
       round(l_discount * l_tax, 6) as l_discount_l_tax from lineitem""",
)
BOOK.add(
    "fe_cluster",
    lambda spark, folder: cb.fe_cluster(
        table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey"], 5
    ),
)
LAMBDAS = [i / 4 for i in range(-8, 9)]
BOOK.add(
    "fe_power",
    lambda spark, folder: rounded(
        cb.fe_power(table(spark, folder, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"], grid=LAMBDAS)
    ),
    f"""with g as (select unnest({LAMBDAS}::double[]) as l),
    f as (select l, (l - 1) * sum(ln(p_retailprice)) - count(*) / 2.0::double
                 * ln(var_pop(case when l = 0 then ln(p_retailprice) else (pow(p_retailprice, l) - 1) / l end)) as llf
          from part, g group by l),
    best as (select l from f order by llf desc limit 1)
    select p_partkey, round(case when l = 0 then ln(p_retailprice) else (pow(p_retailprice, l) - 1) / l end, 6) as p_retailprice
    from part, best""",
)

TWINS = "select l_orderkey, l_linenumber, l_quantity, 2 * l_quantity as twin, l_discount, l_tax from lineitem"
BOOK.add(
    "drop_collinear_table",
    # quantity and its twin are infinitely inflated, the first goes; the free column stays
    lambda spark, folder: cl.drop_collinear(over(spark, folder, TWINS).drop("l_tax"), 5.0, LINE),
    f"with t as ({TWINS}) select l_orderkey, l_linenumber, twin, l_discount from t",
)
BOOK.add(
    "fe_collinear_request",
    lambda spark, folder: fe_pipeline(over(spark, folder, TWINS), {"multiCollinearity": {"vif_Value": 5}}, "l_tax", LINE),
    f"with t as ({TWINS}) select l_orderkey, l_linenumber, twin, l_discount, l_tax from t",
)
BOOK.add(
    "fe_component_request",
    lambda spark, folder: rounded(
        fe_pipeline(_line(spark, folder, "l_quantity", "l_discount", "l_tax"), {"PCA": {"n_Components": 2}}, "l_tax", LINE), 5
    ),
    BOOK.sql["pca"].replace("select l_orderkey, l_linenumber,", "select l_orderkey, l_linenumber, round(l_tax, 5) as l_tax,"),
)

QUERIES, SQL = BOOK.queries, BOOK.sql
