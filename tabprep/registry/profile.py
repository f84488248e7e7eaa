"""Profile and correlation queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.gram import covariance
from ..operators import correlate as cr, profile as pf
from ..operators.profile_state import merged, profile_of, profile_state
from .tools import Book, rounded
from .views import VIEWS, over, table

BOOK = Book()
GAP = VIEWS["customer_gap"]
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FEW = ["l_quantity", "l_discount", "l_tax"]
SHAPE = "select l_quantity, l_discount, l_tax, l_returnflag, l_linestatus from lineitem"

BOOK.add(
    "profile_overview",
    lambda spark, folder: rounded(pf.profile_overview(over(spark, folder, SHAPE))),
    f"""with t as ({SHAPE}), g as (select count(*) as n from t group by l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)
        select sum(n)::bigint as rows, 5::integer as columns, 0::bigint as missing_cells, 0.0::double as missing_share,
               sum(n - 1)::bigint as duplicate_rows, 3::integer as numeric_columns, 2::integer as text_columns,
               0::integer as boolean_columns, 0::integer as date_columns, 0::integer as other_columns from g""",
)
TWICE = "select * from lineitem union all select * from lineitem where l_orderkey % 10 = 0"
BOOK.add(
    "profile_overview_whole",
    lambda spark, folder: rounded(pf.profile_overview(over(spark, folder, TWICE))),
    f"""with t as ({TWICE}) select count(*)::bigint as rows, 11::integer as columns, 0::bigint as missing_cells, 0.0::double as missing_share,
        (count(*) - (select count(*) from (select distinct * from t)))::bigint as duplicate_rows, 8::integer as numeric_columns,
        2::integer as text_columns, 0::integer as boolean_columns, 1::integer as date_columns, 0::integer as other_columns from t""",
)

def _merged(spark, folder):
    """Two versions' states as one: exact measures, the commonest languages, and whether the sketched median is close."""
    df = table(spark, folder, "documents").select("n_chars", "lang")
    parts = [df.where("lang <=> 'en'"), df.where("not lang <=> 'en'")]
    found = profile_of(merged(*[profile_state(p) for p in parts]))
    half = F.lit({r["column"]: r["p50"] for r in found.select("column", "p50").collect()}["n_chars"])  # a row per column
    below, upto = df.agg(*[F.avg(c.cast("double")) for c in (F.col("n_chars") < half, F.col("n_chars") <= half)]).first()
    near = bool(below <= 0.503 and upto >= 0.497)
    langs = F.array_join(F.array_sort(F.transform("frequent", lambda t: F.concat_ws(":", t["item"], t["count"].cast("string")))), ",")
    common = F.when(F.col("column") == "lang", langs)
    return rounded(found.select("column", "rows", "missing", "mean", "std", "min", "max", "zeros", common.alias("common"), F.lit(near).alias("median_close")), 4)


BOOK.add(
    "profile_merged",
    _merged,
    """select 'n_chars' as "column", count(*) as rows, count(*) - count(n_chars) as missing, round(avg(n_chars), 4) as mean,
        round(stddev_samp(n_chars), 4) as std, min(n_chars)::double as min, max(n_chars)::double as max,
        count(*) filter (n_chars = 0) as zeros, null as common, true as median_close from documents
    union all select 'lang', count(*), count(*) - count(lang), null, null, null, null, null,
        (select string_agg(lang || ':' || n, ',' order by lang || ':' || n) from (select lang, count(*) as n from documents where lang is not null group by 1)), true from documents""",
)
NUM = ["c_acctbal", "c_nationkey"]
BOOK.add(
    "profile_numeric",
    lambda spark, folder: rounded(pf.profile_numeric(table(spark, folder, "customer_gap"), NUM), 4),
    f"with t as ({GAP}) "
    + " union all ".join(
        f"""select '{c}' as "column", count({c}) as count, count(*) filter ({c} is null) as missing, round(avg({c}), 4) as mean,
        round(stddev_samp({c}), 4) as std, round(var_samp({c}), 4) as variance, min({c})::double as min, max({c})::double as max,
        round((max({c}) - min({c}))::double, 4) as range, round(sum({c})::double, 4) as sum, round(stddev_samp({c}) / avg({c}), 4) as cv,
        count(*) filter ({c} = 0) as zeros, count(*) filter ({c} < 0) as negatives, 0::bigint as infinite, count(distinct {c}) as distinct,
        (select count(*) from (select {c} from t where {c} is not null group by 1 having count(*) = 1)) as unique from t"""
        for c in NUM
    ),
)
BOOK.add(
    "profile_quantiles",
    lambda spark, folder: rounded(pf.profile_quantiles(table(spark, folder, "lineitem"), LINE)),
    " union all ".join(
        f"""select '{c}' as "column", round(quantile_cont({c}, 0.05), 6) as p5, round(quantile_cont({c}, 0.25), 6) as p25,
        round(median({c}), 6) as p50, round(quantile_cont({c}, 0.75), 6) as p75, round(quantile_cont({c}, 0.95), 6) as p95,
        round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) as iqr,
        round((select median(abs({c} - m)) from lineitem, (select median({c}) as m from lineitem)), 6) as mad from lineitem"""
        for c in LINE
    ),
)
BOOK.add(
    "profile_shape",
    lambda spark, folder: rounded(
        pf.profile_shape(table(spark, folder, "orders"), ["o_totalprice", "o_orderkey", "o_custkey"], ["o_orderkey"])
    ),
    "with l as (select *, "
    + ", ".join(f"lag({c}) over (order by o_orderkey) as p_{c}" for c in ("o_totalprice", "o_orderkey", "o_custkey"))
    + " from orders) "
    + " union all ".join(
        f"""select '{c}' as "column", round(skewness({c}), 6) as skewness, round(kurtosis({c}), 6) as kurtosis,
        coalesce(bool_and({c} >= p_{c}), true) as never_falls, coalesce(bool_and({c} <= p_{c}), true) as never_rises from l"""
        for c in ("o_totalprice", "o_orderkey", "o_custkey")
    ),
)
BOOK.add(
    "profile_histogram",
    lambda spark, folder: rounded(pf.profile_histogram(table(spark, folder, "lineitem"), "l_extendedprice", 12), 4),
    """with b as (select min(l_extendedprice) as lo, (max(l_extendedprice) - min(l_extendedprice)) / 12 as w from lineitem),
    c as (select cast(least(floor((l_extendedprice - lo) / w), 11) as integer) as bin, count(*) as n from lineitem, b group by 1)
    select r::integer as bin, round(lo + r * w, 4) as low, round(lo + (r + 1) * w, 4) as high, coalesce(n, 0) as n
    from range(12) as s(r) cross join b left join c on bin = r""",
)
BOOK.add(
    "profile_topk",
    lambda spark, folder: pf.profile_topk(table(spark, folder, "documents"), ["source", "lang"], 3),
    " union all ".join(
        f"""(select '{c}' as "column", {c} as value, count(*) as n, cast(row_number() over (order by count(*) desc, {c}) as integer) as place
        from documents group by {c} order by place limit 3)"""
        for c in ("source", "lang")
    ),
)
BOOK.add(
    "profile_extremes",
    lambda spark, folder: rounded(pf.profile_extremes(table(spark, folder, "lineitem"), "l_extendedprice", 5)),
    """with c as (select l_extendedprice as value, count(*) as n from lineitem group by 1)
    (select 'smallest' as side, round(value, 6) as value, n from c order by c.value limit 5)
    union all (select 'largest', round(value, 6), n from c order by c.value desc limit 5)""",
)
TEXTS = ("text", "source")
BOOK.add(
    "profile_text",
    lambda spark, folder: rounded(pf.profile_text(table(spark, folder, "documents"), list(TEXTS))),
    " union all ".join(
        f"""select '{c}' as "column", min(length({c}))::integer as min_length, round(avg(length({c})), 6) as mean_length,
        max(length({c}))::integer as max_length, round(median(length({c})), 6) as median_length,
        (select count(*) from (select unnest(string_split({c}, '')) as x from documents) where x <> '') as characters,
        (select count(distinct x) from (select unnest(string_split({c}, '')) as x from documents) where x <> '') as distinct_characters,
        (select count(*) from (select unnest(regexp_split_to_array(lower({c}), '[ \\t\\n\\r]+')) as x from documents) where x <> '') as words,
        (select count(distinct x) from (select unnest(regexp_split_to_array(lower({c}), '[ \\t\\n\\r]+')) as x from documents) where x <> '')
        as distinct_words from documents"""
        for c in TEXTS
    ),
)
BOOK.add(
    "profile_words",
    lambda spark, folder: pf.words(table(spark, folder, "documents"), ["text"]),
    """select 'text' as "column", word, count(*) as n
       from (select unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+')) as word from documents) where word <> '' group by 2""",
)
BOOK.add(
    "profile_characters",
    lambda spark, folder: pf.characters(table(spark, folder, "documents"), ["text"]),
    """select 'text' as "column", character, count(*) as n
       from (select unnest(string_split(text, '')) as character from documents) where character <> '' group by 2""",
)
ALL = ["c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey"]
BOOK.add(
    "profile_missing",
    lambda spark, folder: rounded(pf.profile_missing(table(spark, folder, "customer_gap"))),
    f"with t as ({GAP}) "
    + " union all ".join(
        f"""select '{c}' as "column", count({c}) as present, count(*) - count({c}) as missing,
        round((count(*) - count({c})) / count(*)::double, 6) as missing_share from t"""
        for c in ALL
    ),
)
GAPS = ["c_acctbal", "c_mktsegment"]
BOOK.add(
    "profile_missing_pairs",
    lambda spark, folder: rounded(pf.missing_pairs(table(spark, folder, "customer_gap"), GAPS)),
    f"""with t as ({GAP}) select 'c_acctbal' as a, 'c_mktsegment' as b,
        round(corr((c_acctbal is null)::integer::double, (c_mktsegment is null)::integer::double), 6) as corr,
        round(sqrt(count(*) filter ((c_acctbal is null) <> (c_mktsegment is null))), 6) as distance from t""",
)


def _pair_sql(columns, expression: str) -> str:
    return " union all ".join(
        "select '{a}' as a, '{b}' as b, ({e}) as corr".format(a=a, b=b, e=expression.replace("$a", a).replace("$b", b))
        for a, b in combinations(columns, 2)
    )


BOOK.add(
    "corr_pearson",
    lambda spark, folder: rounded(cr.corr_pearson(table(spark, folder, "lineitem"), LINE)),
    _pair_sql(LINE, "select round(corr($a, $b), 6) from lineitem"),
)
SPEARMAN = ["l_quantity", "l_extendedprice", "l_discount"]
RANKS = ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double as {c}" for c in SPEARMAN)
BOOK.add(
    "corr_spearman",
    lambda spark, folder: rounded(cr.corr_spearman(table(spark, folder, "lineitem"), SPEARMAN)),
    f"with r as (select {RANKS} from lineitem) " + _pair_sql(SPEARMAN, "select round(corr($a, $b), 6) from r"),
)


def _components(spark, folder, gaps=False):
    """The numbers of every embedding as 64 columns, 2,016 pairs; with gaps, large numbers are missing."""
    numbers = [F.col("embedding")[i].cast("double") for i in range(64)]
    return table(spark, folder, "embeddings").select(*[(F.when(x < 0.2, x) if gaps else x).alias(f"e{i}") for i, x in enumerate(numbers)])


WIDE = [f"e{i}" for i in range(64)]
CELLS = """with v as (select row_number() over () as id, embedding from embeddings),
    g as (select id, unnest(range(64)) as d, unnest(embedding)::double as x from v)"""
BOOK.add(
    "corr_pearson_wide",
    lambda spark, folder: rounded(cr.corr_pearson(_components(spark, folder, gaps=True), WIDE)),
    CELLS
    + """, h as (select * from g where x < 0.2)
    select 'e' || a.d as a, 'e' || b.d as b, round(corr(a.x, b.x), 6) as corr from h a join h b on a.id = b.id and a.d < b.d group by a.d, b.d""",
)
BOOK.add(
    "corr_spearman_wide",
    lambda spark, folder: rounded(cr.corr_spearman(_components(spark, folder), WIDE)),
    CELLS
    + """, r as (select id, d, rank() over (partition by d order by x) + (count(*) over (partition by d, x) - 1) / 2.0::double as x from g)
    select 'e' || a.d as a, 'e' || b.d as b, round(corr(a.x, b.x), 6) as corr from r a join r b on a.id = b.id and a.d < b.d group by a.d, b.d""",
)


def _covariances(spark, folder):
    """Covariance of every two numbers of the embeddings."""
    _, _, cov = covariance(_components(spark, folder), WIDE)
    cells = [(WIDE[i], WIDE[j], float(cov[i, j])) for i in range(64) for j in range(i, 64)]
    return rounded(spark.createDataFrame(cells, "a string, b string, cov double"))


BOOK.add(
    "covariance_wide",
    _covariances,
    CELLS
    + """ select 'e' || a.d as a, 'e' || b.d as b, round(covar_pop(a.x, b.x), 6) + 0.0::double as cov from g a join g b on a.id = b.id and a.d <= b.d
    group by a.d, b.d""",
)
TAU = """with c$a$b as (select $a as x, $b as y, count(*)::double as w from lineitem group by 1, 2),
    n as (select sum(w) * (sum(w) - 1) / 2 as n0 from c$a$b),
    tx as (select sum(t * (t - 1) / 2) as v from (select sum(w) as t from c$a$b group by x)),
    ty as (select sum(t * (t - 1) / 2) as v from (select sum(w) as t from c$a$b group by y)),
    p as (select sum(a.w * b.w) as v from c$a$b a join c$a$b b on a.x < b.x and a.y < b.y),
    q as (select sum(a.w * b.w) as v from c$a$b a join c$a$b b on a.x < b.x and a.y > b.y)
    select round((p.v - q.v) / sqrt((n0 - tx.v) * (n0 - ty.v)), 6) from n, tx, ty, p, q"""
BOOK.add(
    "corr_kendall",
    lambda spark, folder: rounded(cr.corr_kendall(table(spark, folder, "lineitem"), FEW)),
    _pair_sql(FEW, TAU),
)
BOOK.add(
    "corr_phi_k",
    lambda spark, folder: rounded(
        cr.corr_phi_k(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_returnflag"])
    ),
)
CRAMER = ["l_returnflag", "l_linestatus", "l_linenumber"]
V = """with c$a$b as (select $a as x, $b as y, count(*)::double as o from lineitem group by 1, 2),
    m as (select sum(o * o / (mx * my)) as s, sum(o) as n from (select *, sum(o) over (partition by x) as mx, sum(o) over (partition by y) as my from c$a$b)),
    d as (select greatest(0, s - 1 - (k - 1) * (r - 1) / (n - 1)) as phi, k - (k - 1) ** 2 / (n - 1) - 1 as kc, r - (r - 1) ** 2 / (n - 1) - 1 as rc
          from m, (select count(distinct x) as r, count(distinct y) as k from c$a$b))
    select round(sqrt(phi / least(kc, rc)), 6) from d"""
BOOK.add(
    "corr_cramers_v",
    lambda spark, folder: rounded(cr.corr_cramers_v(table(spark, folder, "lineitem"), CRAMER)),
    _pair_sql(CRAMER, V),
)

QUERIES, SQL = BOOK.queries, BOOK.sql
