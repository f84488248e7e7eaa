"""Class balance, augmentation and neighbour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normal
from ..operators import balance as bl, synth as sy
from ..operators.copula import copula_class, copula_correlations, copula_rows
from ..operators.encode import decode_categories, Encode
from ..operators.layers import recall
from ..operators.neighbors import knn_join
from ..operators.smote import smote, smote_nc
from ..plans.pipeline import Pipeline
from .scores import hash_sql
from .tools import Book, rounded
from .views import VIEWS, over, table

BOOK = Book()
CLS = VIEWS["customer_cls"]
TOXIC = "select doc_id, n_chars, lang, case when toxic = 1 then 'bad' else 'fine' end as y from documents join labels using (doc_id)"


def _cls(spark, folder):
    return table(spark, folder, "customer_cls")


BOOK.add(
    "class_counts",
    lambda spark, folder: bl.class_counts(table(spark, folder, "orders"), "o_orderpriority"),
    "select o_orderpriority, count(*) as n from orders group by 1",
)
BOOK.add(
    "class_gap",
    lambda spark, folder: bl.class_gap(table(spark, folder, "orders"), "o_orderpriority"),
    "select o_orderpriority, count(*) as n, max(count(*)) over () - count(*) as gap from orders group by 1",
)
TARGETS = ["y", "c_nationkey", "c_acctbal"]


def _per_target(name, function, columns, sql):
    def run(spark, folder):
        df = _cls(spark, folder)
        rows = [(c, function(df, c)) for c in columns]
        return spark.createDataFrame(rows, "target string, kind string")

    BOOK.add(name, run, sql)


_per_target(
    "problem_type",
    bl.problem_type,
    ["y", "c_nationkey"],
    f"with t as ({CLS}) "
    + " union all ".join(
        f"select '{c}' as target, case count(distinct {c}) when 2 then 'binary' else 'multi' end as kind from t" for c in ("y", "c_nationkey")
    ),
)
_per_target(
    "task_type",
    bl.task_type,
    TARGETS,
    f"with t as ({CLS}) select 'y' as target, 'classification' as kind union all "
    + " union all ".join(
        f"select '{c}', case when count(distinct {c}) > 0.05 * count(*) then 'regression' else 'classification' end from t"
        for c in TARGETS[1:]
    ),
)


def _targets(spark, folder):
    df = table(spark, folder, "orders")
    cases = [
        ("Random Oversampler", "auto"), ("Random Oversampler", "minority"), ("Random Oversampler", "not minority"),
        ("Random Undersampler", "auto"), ("Random Undersampler", "majority"), ("Random Undersampler", "not majority"),
    ]
    parts = [
        bl.sampling_targets(df, "o_orderpriority", m, s).select(F.lit(m).alias("method"), F.lit(s).alias("strategy"), "*")
        for m, s in cases
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


COUNTED = """with c as (select o_orderpriority, count(*) as n from orders group by 1),
    m as (select *, max(n) over () as hi, min(n) over () as lo, n = max(n) over () as large, n = min(n) over () as small from c) """
BOOK.add(
    "sampling_targets",
    _targets,
    COUNTED
    + " union all ".join(
        f"select '{m}' as method, '{s}' as strategy, o_orderpriority, n, case when {when} then {to} else n end as wanted from m"
        for m, s, when, to in [
            ("Random Oversampler", "auto", "true", "hi"),
            ("Random Oversampler", "minority", "small", "hi"),
            ("Random Oversampler", "not minority", "not small", "hi"),
            ("Random Undersampler", "auto", "true", "lo"),
            ("Random Undersampler", "majority", "large", "lo"),
            ("Random Undersampler", "not majority", "not large", "lo"),
        ]
    ),
)

# positions by key hash within a class, class sizes, and the draws of each class
RANKED = f"""with recursive t as ({CLS}),
    c as (select y, count(*) as n, max(count(*)) over () - count(*) as need from t group by 1),
    r as (select *, row_number() over (partition by y order by {hash_sql(5, 'c_custkey')}, c_custkey) - 1 as pos from t),
    d as (select y, n, j, {hash_sql(5, 'y', 'j', digits=15)} % n as pos from c, unnest(range(1, need + 1)) as u(j)),
    b as (select d.y, d.n, d.j, r.c_custkey, r.c_acctbal, r.c_nationkey from d join r using (y, pos))"""
BOOK.add(
    "random_oversample",
    lambda spark, folder: bl.random_oversample(_cls(spark, folder), "y", "auto", ["c_custkey"], 5),
    RANKED + " select c_custkey, c_acctbal, c_nationkey, y from t union all select c_custkey, c_acctbal, c_nationkey, y from b",
)
BOOK.add(
    "random_undersample",
    lambda spark, folder: bl.random_undersample(_cls(spark, folder), "y", "auto", ["c_custkey"], 5),
    RANKED + " select c_custkey, c_acctbal, c_nationkey, y from r where pos < (select min(n) from c)",
)
NEAR = """, k as (select a.c_custkey, b.c_custkey as nn, row_number() over (partition by a.c_custkey order by {d}, b.c_custkey) - 1 as place
          from (select distinct c_custkey, c_acctbal, c_nationkey, y from b) a join t b on a.y = b.y and a.c_custkey <> b.c_custkey)"""
SMOTE_NEAR = NEAR.format(d="sqrt((a.c_acctbal - b.c_acctbal) ** 2 + (a.c_nationkey - b.c_nationkey) ** 2)")
DRAWN = f"""select b.*, s.c_acctbal as o_acctbal, s.c_nationkey as o_nationkey, {hash_sql('5u', 'b.y', 'b.j')} / 4294967296.0::double as u
    from b join k on b.c_custkey = k.c_custkey and k.place = {hash_sql('5n', 'b.y', 'b.j')} % least(5, b.n - 1) join t s on s.c_custkey = k.nn"""
BOOK.add(
    "smote",
    lambda spark, folder: rounded(smote(_cls(spark, folder), "y", "auto", 5, "c_custkey", 5)),
    RANKED
    + SMOTE_NEAR
    + f""" select c_custkey, round(c_acctbal, 6) as c_acctbal, c_nationkey::double as c_nationkey, y from t
    union all select null, round(c_acctbal + u * (o_acctbal - c_acctbal), 6),
    round(c_nationkey + u * (o_nationkey - c_nationkey), 6), y from ({DRAWN})""",
)
CATEGORY = CLS.replace("c_nationkey,", "c_mktsegment,")
NC_RANKED = RANKED.replace(CLS, CATEGORY).replace("c_nationkey", "c_mktsegment")
BOOK.add(
    "smote_nc",
    lambda spark, folder: rounded(
        smote_nc(over(spark, folder, CATEGORY), "y", ["c_mktsegment"], "auto", 5, "c_custkey", 5)
    ),
    NC_RANKED
    + ", w as (select y, stddev_pop(c_acctbal) as s from t group by 1)"
    + NEAR.replace("c_nationkey", "c_mktsegment")
    .replace("on a.y = b.y and", "on a.y = b.y and")
    .replace("from (select distinct", "from w join (select distinct")
    .replace("y from b) a join", "y from b) a using (y) join")
    .replace("a.y = b.y", "w.y = b.y")
    .format(d="sqrt((a.c_acctbal - b.c_acctbal) ** 2 + case when a.c_mktsegment <> b.c_mktsegment then s * s else 0 end)")
    + """, v as (select k.c_custkey, s.c_mktsegment, count(*) as votes from k join t s on s.c_custkey = k.nn where place < 5 group by 1, 2),
    m as (select c_custkey, c_mktsegment as common from v qualify row_number() over (partition by c_custkey order by votes desc, c_mktsegment) = 1)"""
    + f""" select c_custkey, round(c_acctbal, 6) as c_acctbal, c_mktsegment, y from t
    union all select null, round(c_acctbal + u * (o_acctbal - c_acctbal), 6), common, y
    from ({DRAWN.replace("c_nationkey", "c_mktsegment")}) join m using (c_custkey)""",
)


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", *[F.col("embedding")[i].alias(f"e{i}") for i in range(64)])


def _neighbours(spark, folder):
    points = _vectors(spark, folder)
    return rounded(knn_join(points, points, [f"e{i}" for i in range(64)], 5, "vec_id", one_cell=100), 5).select(
        "vec_id", "place", "distance"
    )


BOOK.add(
    "nearest_neighbours",
    _neighbours,
    """with d as (select a.vec_id, b.vec_id as nn,
          sqrt(list_sum(list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda p: (p[1] - p[2]) ** 2))) as distance
          from embeddings a join embeddings b on a.vec_id <> b.vec_id)
    select vec_id, (row_number() over (partition by vec_id order by distance, nn) - 1)::integer as place, round(distance, 5) as distance
    from d qualify place < 5""",
)



def _layered(spark, folder):
    """How many of the five exact neighbours of every embedding a layered index finds, searching 24 cells of 64 points."""
    df, names = _vectors(spark, folder), [f"e{i}" for i in range(64)]
    exact, found = knn_join(df, df, names, 5, "vec_id"), knn_join(df, df, names, 5, "vec_id", layered=24, one_cell=64)
    share = recall(found, exact, "vec_id")
    return found.agg(F.count(F.lit(1)).alias("neighbours"), F.countDistinct("vec_id").alias("vectors")).withColumn("enough", F.lit(share >= 0.9))


BOOK.add("layered_recall", _layered, "select count(*) * 5 as neighbours, count(*) as vectors, true as enough from embeddings")

BOOK.add(
    "synthesize_class",
    lambda spark, folder: rounded(sy.synthesize_class(over(spark, folder, TOXIC), "y", skip=["doc_id"])),
)
BOOK.add(
    "synthesize_rows",
    lambda spark, folder: rounded(
        sy.synthesize_rows(
            table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"), 200, skip=["c_custkey"]
        )
    ),
)


def _normal(seed: str, *parts: str) -> str:
    return (
        f"sqrt(-2 * ln(({hash_sql(seed + 'a', *parts)} + 1) / 4294967297.0::double)) "
        f"* cos(2 * pi() * {hash_sql(seed + 'b', *parts)} / 4294967296.0::double)"
    )


def _line(factors, x: str) -> str:
    out = repr(factors[0])
    for f in factors[1:]:
        out = f"({out} * {x} + {f!r}::double)"
    return out


def _score(p: str) -> str:
    """Normal quantile of p."""
    q, t = f"({p} - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    centre = f"{q} * {_line(normal.CENTRE_TOP, f'{q} * {q}')} / {_line(normal.CENTRE_BOTTOM, f'{q} * {q}')}"
    tail = f"{_line(normal.TAIL_TOP, t)} / {_line(normal.TAIL_BOTTOM, t)}"
    return f"case when {p} < {normal.TAIL} then {tail} when {p} > 1 - {normal.TAIL} then -{tail} else {centre} end"


def _share(x: str) -> str:
    """Probability of a normal below x."""
    above = f"exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {_line(normal.SHARE, f'(1 / (1 + {normal.SHARE_STEP} * abs({x})))')}"
    return f"case when {x} < 0 then {above} else 1 - {above} end"


def _copula_sql(source: str, keep: str, group: str, wanted: str) -> str:
    """A number a and a text t of `source` (g, a, t): both ranked, scored, drawn again; `keep` are the old rows."""
    return f"""with s as ({source}),
    r as (select g, a, t, (rank() over (partition by g order by a) + (count(*) over (partition by g, a) - 1) / 2.0::double - 0.5) as ra,
      (rank() over (partition by g order by t) + (count(*) over (partition by g, t) - 1) / 2.0::double - 0.5) as rt, count(*) over (partition by g) as n from s),
    p as (select *, ra / n as pa, rt / n as pt from r),
    z as (select *, {_score('pa')} as za, {_score('pt')} as zt from p),
    c as (select g, corr(za, zt) as rho from z group by g),
    k as (select g, n, list(a order by a) as line, list(t order by t) as levels from r group by g, n),
    d as (select g, j, {_normal('5c0', 'g', 'j')} as e0, {_normal('5c1', 'g', 'j')} as e1 from ({wanted})),
    m as (select d.g, d.j, e0 as x0, rho * e0 + sqrt(1 - rho * rho) * e1 as x1 from d join c on c.g = d.g),
    u as (select m.g, j, n, line, levels, {_share('x0')} * 1000 as spot, least(floor({_share('x1')} * n), n - 1)::bigint as place from m join k on k.g = m.g),
    w as (select *, least(floor(spot), 999)::bigint as step from u),
    v as (select *, line[step * (n - 1) // 1000 + 1] as low, line[(step + 1) * (n - 1) // 1000 + 1] as high from w)
    {keep} union all select {group} as g, round(low + (spot - step) * (high - low), 6) as a, levels[place + 1] as t from v"""


BOOK.add(
    "copula_rows",
    lambda spark, folder: rounded(
        copula_rows(table(spark, folder, "customer").selectExpr("c_custkey as g", "c_acctbal as a", "c_mktsegment as t"), 200, skip=["g"])
    ),
    _copula_sql(
        "select '' as g, c_acctbal as a, c_mktsegment as t from customer",
        "select c_custkey as g, round(c_acctbal, 6) as a, c_mktsegment as t from customer",
        "null",
        "select '' as g, unnest(range(1, 201)) as j",
    ),
)
BOOK.add(
    "copula_documents",
    lambda spark, folder: rounded(
        copula_rows(table(spark, folder, "documents").selectExpr("doc_id as g", "cast(n_chars as double) as a", "lang as t"), 500, skip=["g"])
    ),
    _copula_sql(
        "select '' as g, n_chars::double as a, lang as t from documents",
        "select doc_id as g, n_chars::double as a, lang as t from documents",
        "null",
        "select '' as g, unnest(range(1, 501)) as j",
    ),
)
BOOK.add(
    "copula_class",
    lambda spark, folder: rounded(
        copula_class(
            table(spark, folder, "orders").selectExpr("o_orderstatus as g", "cast(o_totalprice as double) as a", "o_orderpriority as t"), "g"
        )
    ),
    _copula_sql(
        "select o_orderstatus as g, o_totalprice::double as a, o_orderpriority as t from orders",
        "select g, round(a, 6) as a, t from s",
        "g",
        """select g, unnest(range(1, need + 1)) as j from
          (select o_orderstatus as g, max(count(*)) over () - count(*) as need from orders group by 1) where need > 0""",
    ),
)
BOOK.add(
    "copula_correlations",
    lambda spark, folder: rounded(copula_correlations(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])),
    " union all ".join(
        f"""select '{a}' as a, '{b}' as b, round(corr({_score('pa')}, {_score('pb')}), 6) as corr from (
          select (rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2.0::double - 0.5) / count(*) over () as pa,
            (rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2.0::double - 0.5) / count(*) over () as pb from lineitem)"""
        for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))
    ),
)

BOOK.add(
    "multiplicative_noise",
    lambda spark, folder: rounded(
        sy.multiplicative_noise(
            table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], ["o_orderkey"]
        ),
        4,
    ),
    f"""select o_orderkey, round(o_totalprice * (1 + 0.05 * {_normal('5', 'o_orderkey', "'o_totalprice'")}), 4) as o_totalprice
        from orders""",
)


def _standardized(spark, folder):
    """Both parts scaled, with the inverse beside it."""
    df = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    parts = sy.standardize_split(df, ["c_acctbal"], ["c_custkey"])
    both = parts.train.withColumn("part", F.lit("train")).unionByName(parts.test.withColumn("part", F.lit("test")))
    back = parts.inverse(both).select("c_custkey", F.col("c_acctbal").alias("back"))
    return rounded(both.join(back, "c_custkey"))


BOOK.add(
    "standardize_split",
    _standardized,
    f"""with s as (select *, case when {hash_sql(42, 'c_custkey')} % 10000 < 2000 then 'test' else 'train' end as part from customer),
    f as (select avg(c_acctbal) as m, stddev_pop(c_acctbal) as d from s where part = 'train')
    select c_custkey, round((c_acctbal - m) / d, 6) + 0.0::double as c_acctbal, part, round(c_acctbal, 6) as back from s, f""",
)


def _decoded(spark, folder):
    """Codes with noise on them go back to labels."""
    df = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    model = Pipeline([Encode("c_mktsegment")]).fit(df)
    coded = model.transform(df).withColumn("c_mktsegment", F.col("c_mktsegment") * 1.3 - 0.2)
    return decode_categories(coded, model.steps).select("c_custkey", "c_mktsegment")


BOOK.add(
    "decode_categories",
    _decoded,
    """with l as (select c_mktsegment as v, row_number() over (order by c_mktsegment) - 1 as code from customer group by 1)
    select c_custkey, b.v as c_mktsegment from customer join l a on a.v = c_mktsegment
    join l b on b.code = greatest(least(round(a.code * 1.3 - 0.2), 4), 0)""",
)


def _compared(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount")
    noisy = sy.multiplicative_noise(df, ["l_quantity", "l_discount"], ["l_orderkey", "l_linenumber", "l_suppkey"])
    return rounded(sy.distribution_compare(df, noisy, ["l_quantity", "l_discount"]))


BOOK.add(
    "distribution_compare",
    _compared,
    " union all ".join(
        f"""select '{c}' as "column", '{o}' as origin, round(avg({e}), 6) as mean, count(*) as n from lineitem"""
        for c in ("l_quantity", "l_discount")
        for o, e in (
            ("original", c),
            ("generated", f"""{c} * (1 + 0.05 * {_normal('5', 'l_orderkey', 'l_linenumber', 'l_suppkey', f"'{c}'")})"""),
        )
    ),
)

QUERIES, SQL = BOOK.queries, BOOK.sql
