"""Preprocessing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import levels as lv
from ..operators.bins import equal_frequency
from ..operators.encode import encode_ordinal
from ..operators.rows import check_null, null_counts, remove_duplicates, remove_null
from ..plans.step import ColumnStep, register_step
from ..plans.preprocess import preprocess, preprocess_apply, preprocess_pipeline
from .tools import Book, rounded
from .views import VIEWS, over, table

BOOK = Book()
GAP = VIEWS["customer_gap"]
REST = "c_custkey, c_nationkey"


def _column(name: str, view: str, column: str, actions: list, sql: str, keep: tuple[str, ...], digits: int = 6, **options):
    """One request on one column; the result is the key columns and the handled column."""

    def run(spark, folder):
        df = table(spark, folder, view).select(*keep, column)
        return rounded(preprocess(df, {column: actions}, **options), digits)

    BOOK.add(name, run, sql)


def _gap(name: str, column: str, actions: list, expression: str, extra: str = "") -> None:
    sql = f"with t as ({GAP}){extra} select c_custkey, {expression} as {column} from t"
    _column(name, "customer_gap", column, actions, sql, ("c_custkey",))


def impute(strategy: str, fill=None) -> list:
    pairs = [{"imp_strategy": strategy}] + ([] if fill is None else [{"fill_value": fill}])
    return [{"impute": pairs}]


BAL = "c_acctbal"
_gap("impute_mean", BAL, impute("mean"), f"round(coalesce({BAL}, (select avg({BAL}) from t)), 6)")
_gap("impute_median", BAL, impute("median"), f"round(coalesce({BAL}, (select median({BAL}) from t)), 6)")
_gap(
    "impute_most_frequent",
    "c_mktsegment",
    impute(""),
    "coalesce(c_mktsegment, (select c_mktsegment from t where c_mktsegment is not null group by 1 order by count(*) desc, 1 limit 1))",
)
_gap("impute_constant", "c_mktsegment", impute("constant", ""), "coalesce(c_mktsegment, 'DEFAULT')")
_gap(
    "clip_value",
    BAL,
    [{"clip": [{"method": "value"}, {"u_min": 0}, {"u_max": ""}]}],
    f"case when {BAL} is not null then round(greatest(least({BAL}, (select max({BAL}) from t)), 0.0::double), 6) end",
)
_gap(
    "clip_percentile",
    BAL,
    [{"clip": [{"method": "percentile"}, {"u_min": 5}, {"u_max": 95}]}],
    f"case when {BAL} is not null then round(greatest(least({BAL}, (select quantile_cont({BAL}, 0.95) from t)), "
    f"(select quantile_cont({BAL}, 0.05) from t)), 6) end",
)


def scale(method: str) -> list:
    return [{"scale": [{"scale_method": method}]}]


def _scaled(name: str, method: str, center: str, spread: str) -> None:
    _gap(
        name,
        BAL,
        scale(method),
        f"round(({BAL} - (select c from f)) / (select case when s = 0 then 1 else s end from f), 6) + 0.0::double",
        f", f as (select {center} as c, {spread} as s from t)",
    )


_scaled("scale_standard", "standardscaler", f"avg({BAL})", f"stddev_pop({BAL})")
_scaled("scale_minmax", "minmaxscaler", f"min({BAL})", f"max({BAL}) - min({BAL})")
_scaled("scale_maxabs", "maxabsscaler", "0", f"max(abs({BAL}))")
_scaled(
    "scale_robust", "robustscaler", f"median({BAL})", f"quantile_cont({BAL}, 0.75) - quantile_cont({BAL}, 0.25)"
)

LINE = ("l_orderkey", "l_linenumber")


def _math(name: str, column: str, operation: str, value, expression: str) -> None:
    pairs = [{"mathops_operation": operation}] + ([] if value is None else [{"mathops_value": value}])
    sql = f"select l_orderkey, l_linenumber, round({expression}, 6) as {column} from lineitem"
    _column(name, "lineitem", column, [{"mathops": pairs}], sql, LINE)


_math("mathop_log", "l_discount", "log", "", "case when l_discount > 0 then ln(l_discount) / ln(10.0::double) end")
_math("mathop_power", "l_quantity", "power", 2, "pow(l_quantity, 2)")
_math("mathop_add", "l_quantity", "", "", "l_quantity + 10")
_math("mathop_sub", "l_quantity", "sub", 25, "l_quantity - 25")
_math("mathop_mul", "l_extendedprice", "mul", 3, "l_extendedprice * 3")
_math("mathop_div", "l_extendedprice", "div", 7, "l_extendedprice / 7")
_math("mathop_reciprocal", "l_discount", "reciprocal", None, "case when l_discount <> 0 then 1 / l_discount end")
_math("mathop_nthroot", "l_extendedprice", "nthroot", 3, "pow(l_extendedprice, 1.0::double / 3)")
_math("mathop_exp", "l_tax", "exp", None, "exp(l_tax)")

LAMBDAS = [i / 4 for i in range(-8, 9)]
_column(
    "mathop_boxcox",
    "orders",
    "o_totalprice",
    [{"mathops": [{"mathops_operation": "boxcox"}, {"grid": LAMBDAS}]}],
    f"""
    with g as (select unnest({LAMBDAS}::double[]) as l),
    f as (select l, (l - 1) * sum(ln(o_totalprice)) - count(*) / 2.0::double
                 * ln(var_pop(case when l = 0 then ln(o_totalprice) else (pow(o_totalprice, l) - 1) / l end)) as llf
          from orders, g group by l),
    best as (select l from f order by llf desc limit 1)
    select o_orderkey, round(case when l = 0 then ln(o_totalprice) else (pow(o_totalprice, l) - 1) / l end, 3) as o_totalprice
    from orders, best""",
    ("o_orderkey",),
    3,
)

BOOK.add(
    "bin_equal_frequency",
    lambda spark, folder: equal_frequency(
        table(spark, folder, "customer").select("c_custkey", BAL), BAL, 100, ["c_custkey"]
    ),
    f"select c_custkey, ((row_number() over (order by {BAL}, c_custkey) - 1) // 100)::bigint as {BAL} from customer",
)


def _uniform(column: str, source: str, keys: str, bins: str) -> str:
    return f"""
    with b as (select min({column}) as lo, max({column}) as hi from {source}),
    w as (select lo, ({bins})::integer as n, (hi - lo) / ({bins}) as w from b)
    select {keys}, cast(greatest(least(floor(({column} + (1e-8 + 1e-5 * abs({column})) - lo) / w), n - 1), 0) as integer) as {column}
    from {source}, w"""


_column(
    "bin_equal_length",
    "lineitem",
    "l_extendedprice",
    [{"bin_variables": [{"bin_method": "equal length"}, {"bin_value": 5000}]}],
    _uniform("l_extendedprice", "lineitem", "l_orderkey, l_linenumber", "ceil((hi - lo) / 5000)"),
    LINE,
)
_column(
    "bin_kbins",
    "lineitem",
    "l_quantity",
    [{"bin_variables": [{"bin_method": "kbins"}, {"bin_value": ""}]}],
    _uniform("l_quantity", "lineitem", "l_orderkey, l_linenumber", "5"),
    LINE,
)

BOOK.add(
    "encode_ordinal",
    lambda spark, folder: encode_ordinal(
        table(spark, folder, "customer_gap").select("c_custkey", "c_mktsegment"), "c_mktsegment"
    ),
    f"""with t as ({GAP}), d as (select c_mktsegment as v, (row_number() over (order by c_mktsegment) - 1)::integer as code
        from t where c_mktsegment is not null group by 1)
        select c_custkey, code as c_mktsegment from t left join d on v = c_mktsegment""",
)
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
ONE_HOT = ", ".join(
    f"""case when c_mktsegment = '{s}' then 1.0::double else 0.0::double end as "Trans_c_mktsegment__x0_{s}" """ for s in SEGMENTS
)
_column(
    "encode_onehot",
    "customer_gap",
    "c_mktsegment",
    [{"encode": [{"enc_method": "onehot encoder"}]}],
    f"with t as ({GAP}) select c_custkey, {ONE_HOT} from t",
    ("c_custkey",),
)

FLAGSHIP = {
    BAL: [
        {"impute": [{"imp_strategy": "median"}]},
        {"clip": [{"method": "percentile"}, {"u_min": 1}, {"u_max": 99}]},
        {"scale": [{"scale_method": "standardscaler"}]},
    ],
    "c_mktsegment": [{"encode": [{"enc_method": "onehot encoder"}]}],
}
FLAGSHIP_SQL = f"""
    with t as ({GAP}),
    a as (select * replace (coalesce({BAL}, (select median({BAL}) from t)) as {BAL}) from t),
    q as (select quantile_cont({BAL}, 0.01) as lo, quantile_cont({BAL}, 0.99) as hi from a),
    b as (select a.* replace (greatest(least({BAL}, hi), lo) as {BAL}) from a, q)
    select round(({BAL} - (select avg({BAL}) from b)) / (select stddev_pop({BAL}) from b), 6) + 0.0::double as {BAL}, {ONE_HOT}, {REST}
    from b"""


def _flagship(spark, folder):
    return rounded(preprocess(table(spark, folder, "customer_gap"), FLAGSHIP, key=["c_custkey"]))


def _flagship_apply(spark, folder):
    """Fit on customers with gaps, save as JSON, apply to the customers without."""
    model = preprocess_pipeline(table(spark, folder, "customer_gap"), FLAGSHIP, key=["c_custkey"])
    new = table(spark, folder, "customer").select("c_custkey", BAL, "c_mktsegment", "c_nationkey")
    return rounded(preprocess_apply(new, model.to_json()))


BOOK.add("preprocess_pipeline", _flagship, FLAGSHIP_SQL)
BOOK.add(
    "preprocess_apply",
    _flagship_apply,
    f"""
    with t as ({GAP}),
    a as (select * replace (coalesce({BAL}, (select median({BAL}) from t)) as {BAL}) from t),
    q as (select quantile_cont({BAL}, 0.01) as lo, quantile_cont({BAL}, 0.99) as hi from a),
    b as (select a.* replace (greatest(least({BAL}, hi), lo) as {BAL}) from a, q)
    select round((greatest(least({BAL}, hi), lo) - (select avg({BAL}) from b)) / (select stddev_pop({BAL}) from b), 6) + 0.0::double as {BAL},
           {ONE_HOT}, {REST}
    from customer, q""",
)

BOOK.add(
    "remove_null",
    lambda spark, folder: remove_null(table(spark, folder, "customer_gap"), BAL),
    f"with t as ({GAP}) select * from t where {BAL} is not null",
)
BOOK.add(
    "remove_duplicates",
    lambda spark, folder: remove_duplicates(
        table(spark, folder, "lineitem").select(*LINE, "l_quantity", "l_discount", "l_tax", "l_returnflag"),
        key=LINE,
        target="l_returnflag",
    ),
    """select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag from lineitem
       qualify row_number() over (partition by l_quantity, l_discount, l_tax order by l_orderkey, l_linenumber) = 1""",
)


def _check_null(spark, folder):
    df = table(spark, folder, "customer_gap")
    check_null(df, BAL, "impute")
    return null_counts(df)


BOOK.add(
    "check_null",
    _check_null,
    f"""with t as ({GAP}) select 'c_custkey' as "column", count(*) filter (c_custkey is null) as nulls from t
        union all select 'c_acctbal', count(*) filter (c_acctbal is null) from t
        union all select 'c_mktsegment', count(*) filter (c_mktsegment is null) from t
        union all select 'c_nationkey', count(*) filter (c_nationkey is null) from t""",
)

FLAGS = "l_quantity l_discount l_tax l_linestatus l_returnflag constant rare".split()
FLAG_VIEW = """select l_quantity, l_discount, l_tax, l_linestatus, l_returnflag, 1 as constant,
               case when l_orderkey % 97 = 0 then 'x' else 'y' end as rare from lineitem"""
BOOK.add(
    "near_zero_variance",
    lambda spark, folder: lv.variance_flags(over(spark, folder, FLAG_VIEW)),
    f"with t as ({FLAG_VIEW}), u as ("
    + " union all ".join(f"select '{c}' as c, {c}::varchar as v from t" for c in FLAGS)
    + """), n as (select c, v, count(*) as n from u group by all),
    r as (select *, row_number() over (partition by c order by n desc) as p from n),
    g as (select c, count(*) as d, sum(n) as rows, max(n) as t, max(n) filter (p = 2) as s from r group by c)
    select c as "column", d as distinct_values, t as top_n, s as second_n,
           (s is null or (t > 20 * s and d * 100 < 10 * rows)) as near_zero from g""",
)
BOOK.add(
    "near_zero_variance_table",
    lambda spark, folder: lv.near_zero_variance(over(spark, folder, FLAG_VIEW)),
    f"with t as ({FLAG_VIEW}) select l_quantity, l_discount, l_tax, l_linestatus, l_returnflag from t",
)
BOOK.add(
    "preprocess_many_levels",
    lambda spark, folder: preprocess_pipeline(
        table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"),
        {"l_partkey": [{"encode": [{"enc_method": "ordinal encoder"}]}]},
    ).transform(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")),
    "select l_orderkey, l_linenumber, dense_rank() over (order by l_partkey) - 1 as l_partkey from lineitem",
)
ZEROS = "select l_orderkey, l_linenumber, case when l_linenumber % 2 = 0 then -0.0::double else round(l_discount * 0, 1) + l_partkey % 3 end as v from lineitem"
BOOK.add(
    "encode_zeros",
    lambda spark, folder: encode_ordinal(
        table(spark, folder, "lineitem").select(
            "l_orderkey",
            "l_linenumber",
            F.when(F.col("l_linenumber") % 2 == 0, F.lit(-0.0)).otherwise(F.col("l_discount") * 0 + F.col("l_partkey") % 3).alias("v"),
        ),
        "v",
    ),
    f"with t as ({ZEROS}) select l_orderkey, l_linenumber, dense_rank() over (order by v + 0.0) - 1 as v from t",
)
# decimals of 20 digits that a double cannot tell apart, with gaps
LONG = """select o_orderkey, case when o_orderkey % 5 > 0 then cast(concat('123456789012345678', cast(10 + o_custkey % 40 as varchar(2)), '.13') as decimal(30, 2)) end as v
    from orders"""


def _long_decimals(spark, folder, actions):
    """A request on long decimals, applied by a model that was saved and loaded."""
    df = over(spark, folder, LONG)
    model = preprocess_pipeline(df, {"v": actions})
    return type(model).from_json(model.to_json()).transform(df)


BOOK.add(
    "impute_long_decimal",
    lambda spark, folder: _long_decimals(spark, folder, [{"impute": [{"imp_strategy": "most_frequent"}]}]).withColumn("v", F.col("v").cast("string")),
    f"""with t as ({LONG}) select o_orderkey, coalesce(v, (select v from t where v is not null group by v order by count(*) desc, v limit 1))::varchar as v from t""",
)
BOOK.add(
    "encode_long_decimal",
    lambda spark, folder: _long_decimals(
        spark, folder, [{"impute": [{"imp_strategy": "most_frequent"}]}, {"encode": [{"enc_method": "ordinal encoder"}]}]
    ),
    f"""with t as ({LONG}), f as (select o_orderkey, coalesce(v, (select v from t where v is not null group by v order by count(*) desc, v limit 1)) as v from t)
    select o_orderkey, (dense_rank() over (order by v) - 1)::integer as v from f""",
)
BOOK.add(
    "club_rare_levels",
    lambda spark, folder: lv.club_rare_levels(table(spark, folder, "documents").select("doc_id", "source"), "source"),
    """with n as (select source, count(*) as n from documents group by 1)
       select doc_id, case when n >= 0.05 * (select count(*) from documents) then source else 'others_infrequent' end as source
       from documents join n using (source)""",
)
UNSEEN = "select c_custkey, case when c_custkey % 13 = 0 then 'UNSEEN' else c_mktsegment end as c_mktsegment from customer"
BOOK.add(
    "untrained_levels",
    lambda spark, folder: lv.untrained_levels(
        over(spark, folder, UNSEEN), "c_mktsegment", lv.trained_levels(table(spark, folder, "customer"), "c_mktsegment")
    ),
    f"""with n as (select c_mktsegment as v, count(*) as n from customer group by 1)
        select c_custkey, case when c_mktsegment in (select v from n) then c_mktsegment
               else (select v from n order by n, v limit 1) end as c_mktsegment
        from ({UNSEEN})""",
)
BOOK.add(
    "cardinality_reduction",
    lambda spark, folder: lv.cardinality_reduction(
        table(spark, folder, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"),
        "p_brand",
        4,
        ["p_size", "p_retailprice"],
    ),
)
AUTO = ("l_quantity", "l_discount", "l_tax")
AUTO_BIN = ", ".join(
    f"cast(greatest(least(floor(({c} + (1e-8 + 1e-5 * abs({c})) - lo_{c}) / ((hi_{c} - lo_{c}) / 5)), 4), 0) as integer) as {c}"
    for c in AUTO
)
AUTO_BOUNDS = ", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in AUTO)
BOOK.add(
    "auto_binning",
    lambda spark, folder: lv.auto_binning(table(spark, folder, "lineitem").select(*LINE, *AUTO), skip=LINE),
    f"select l_orderkey, l_linenumber, {AUTO_BIN} from lineitem, (select {AUTO_BOUNDS} from lineitem)",
)
BOOK.add(
    "auto_impute",
    lambda spark, folder: rounded(
        lv.auto_impute(table(spark, folder, "customer_gap"), "median", "most_frequent", skip=["c_custkey", "c_nationkey"])
    ),
    f"""with t as ({GAP}) select c_custkey, c_nationkey, round(coalesce({BAL}, (select median({BAL}) from t)), 6) as {BAL},
        coalesce(c_mktsegment, (select c_mktsegment from t where c_mktsegment is not null group by 1 order by count(*) desc, 1 limit 1))
        as c_mktsegment from t""",
)


@register_step
class Center(ColumnStep):
    """A step of a user's own: the distance to the mean."""

    action = "center"
    numeric_only = True

    def aggregates(self, x):
        return {"mean": F.avg(x)}

    def learn(self, found):
        self.state["mean"] = found["mean"]

    def expression(self, x):
        return x - F.lit(self.state["mean"])


_gap("custom_step", BAL, [{"center": []}], f"round({BAL} - (select avg({BAL}) from t), 6) + 0.0::double")

QUERIES, SQL = BOOK.queries, BOOK.sql
