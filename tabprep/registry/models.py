"""Model, explanation and stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import col
from ..ml import metrics as mt
from ..ml.candidates import classify_candidates, make_task, regress_candidates
from ..ml.kernels import FourierMap
from ..ml.models import load_model, save_model
from ..ml.search import automl_search, batch_score, dependence_data, fit_model, global_importance
from ..ml.split import train_test_split
from ..ml.trees import shapley
from ..plans.pipeline import PipelineModel
from ..plans.preprocess import preprocess_pipeline
from ..session import scratch_path
from ..streaming.alerts import breach_events
from ..streaming.score import monitor_metrics, stream_score, to_parquet
from .tools import Book, rounded
from .views import over, table

BOOK = Book()
QUICK = {"n_estimators": 10, "max_depth": 4, "max_iter": 10}


def _families(spark, folder, view, target, features, key, families, classify):
    """Every family with quick settings: (family, its metrics on the test part)."""
    df = table(spark, folder, view).select(*key, *features, target)
    train, test = train_test_split(df, 0.2, key)
    task = make_task(train, target, features, classify)
    score = mt.classification_metrics if classify else mt.regression_metrics
    out = None
    for name, family in families.items():
        model = family.fit(task, QUICK)
        one = score(model.transform(test), target, "prediction").select(F.lit(name).alias("family"), "*")
        out = one if out is None else out.unionByName(one)
    return rounded(out, 4)


BOOK.add(
    "classify_candidates",
    lambda spark, folder: _families(
        spark, folder, "customer_cls", "y", ["c_acctbal", "c_nationkey"], ["c_custkey"], classify_candidates(), True
    ),
)
BOOK.add(
    "regress_candidates",
    lambda spark, folder: _families(
        spark, folder, "part", "p_retailprice", ["p_partkey", "p_size"], [], regress_candidates(), False
    ),
)
BOOK.add(
    "automl_search",
    lambda spark, folder: automl_search(
        table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice"),
        "o_totalprice",
        "RMSE",
        n_passes=6,
        key=["o_orderkey"],
        families=["linreg", "ridgereg", "dtr", "bayesian_ridge"],
    ).leaderboard.select("name", "run_id", F.round("RMSE", 3).alias("RMSE"), F.round("MAE", 3).alias("MAE")),
)

SIZED = """select l_orderkey, l_linenumber, l_extendedprice, l_discount, l_quantity,
    case when l_quantity > 35 then 'large' when l_quantity > 15 then 'middle' else 'small' end as y from lineitem"""


def _predicted(spark, folder, name, features, classify, params=None):
    """One family fitted on all line items and applied to them."""
    df = over(spark, folder, SIZED)
    target = "y" if classify else "l_extendedprice"
    family = (classify_candidates() if classify else regress_candidates())[name]
    model = family.fit(make_task(df, target, features, classify), params or {})
    out = model.transform(df).select("l_orderkey", "l_linenumber", "prediction")
    return out if classify else rounded(out, 3)


PLANE = f"""with t as ({SIZED}),
    s as (select var_pop(l_quantity) as a, covar_pop(l_quantity, l_discount) as b, var_pop(l_discount) as c, covar_pop(l_quantity, l_extendedprice) as p,
        covar_pop(l_discount, l_extendedprice) as q, avg(l_quantity) as mx, avg(l_discount) as mz, avg(l_extendedprice) as my from t),
    w as (select (p * c - q * b) / (a * c - b * b) as u, (q * a - p * b) / (a * c - b * b) as v, mx, mz, my from s)
    select l_orderkey, l_linenumber, round(my + u * (l_quantity - mx) + v * (l_discount - mz), 3) as prediction from t, w"""
for _family in ("linreg", "lars"):
    BOOK.add(
        f"family_{_family}",
        lambda spark, folder, name=_family: _predicted(spark, folder, name, ["l_quantity", "l_discount"], False, {"eps": 0.0}),
        PLANE,
    )

# one feature: the class with the largest ln(share) + ln(density) of a normal with the classes' common, or the class's own, variance
DENSITY = f"""with t as ({SIZED}),
    c as (select y, count(*) * 1.0::double / sum(count(*)) over () as share, avg(l_extendedprice) as m, var_pop(l_extendedprice) as v from t group by y),
    d as (select y, share, m, {{variance}} as v from c),
    e as (select y, share, m, v from d)
    select l_orderkey, l_linenumber,
        (select arg_max(y, ln(share) - ln(v) / 2 - (l_extendedprice - m) * (l_extendedprice - m) / (2 * v)) from e) as prediction from t"""
for _family, _variance in (
    ("linear_discriminant", "sum(share * v) over ()"),
    ("quadratic_discriminant", "v"),
    ("gnb", "v"),
):
    BOOK.add(
        f"family_{_family}",
        lambda spark, folder, name=_family: _predicted(spark, folder, name, ["l_extendedprice"], True),
        DENSITY.format(variance=_variance),
    )


def _knn(spark, folder):
    """Parts take the mean price of their two nearest among every tenth part, each of which stands there twice."""
    parts = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    tenth = parts.where(F.col("p_partkey") % 10 == 0)
    task = make_task(tenth.unionByName(tenth), "p_retailprice", ["p_partkey"], False)
    model = regress_candidates()["knn"].fit(task, {"n_neighbors": 2, "weights": "uniform"})
    return rounded(model.transform(parts.where("p_partkey % 10 between 1 and 4")).select("p_partkey", "prediction"), 4)


BOOK.add(
    "family_knn",
    _knn,
    """select a.p_partkey, round(b.p_retailprice, 4) as prediction from part a join part b
       on b.p_partkey = a.p_partkey - a.p_partkey % 10 where a.p_partkey % 10 between 1 and 4""",
)


def _knn_whole(spark, folder):
    """Every part takes the mean price of its three nearest among all parts: itself and its neighbours by key."""
    parts = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    task = make_task(parts, "p_retailprice", ["p_partkey"], False)
    model = regress_candidates()["knn"].fit(task, {"n_neighbors": 3, "weights": "uniform"})
    return rounded(model.transform(parts).select("p_partkey", "prediction"), 4)


# keys have no gaps, so the third nearest is tied with none
BOOK.add(
    "family_knn_whole",
    _knn_whole,
    """select p_partkey, round(case when lag(p_partkey) over k is null then avg(p_retailprice) over (order by p_partkey rows between current row and 2 following)
        when lead(p_partkey) over k is null then avg(p_retailprice) over (order by p_partkey rows between 2 preceding and current row)
        else avg(p_retailprice) over (order by p_partkey rows between 1 preceding and 1 following) end, 4) as prediction
       from part window k as (order by p_partkey)""",
)

LINE = ["l_orderkey", "l_linenumber", "l_suppkey"]


def _scoring_parts(spark, folder):
    """A scaled feature and a line fitted on it."""
    df = table(spark, folder, "lineitem").select(*LINE, "l_quantity", "l_extendedprice")
    step = preprocess_pipeline(df, {"l_quantity": [{"scale": [{"scale_method": "standardscaler"}]}]})
    model = fit_model(step.transform(df), "l_extendedprice", ["l_quantity"], "linreg")
    return df, step, model


def _batch(spark, folder):
    """Step and model are written to the shared folder and scored with what is read back."""
    df, step, model = _scoring_parts(spark, folder)
    path = scratch_path(spark, "models")
    step.save(spark, f"{path}/step")
    save_model(spark, model, f"{path}/model")
    step, model = PipelineModel.load(spark, f"{path}/step"), load_model(spark, f"{path}/model")
    return rounded(batch_score(df.drop("l_extendedprice"), [step], model).select(*LINE, "prediction"), 4)


SCORE_SQL = """with f as (select regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a from lineitem)
    select l_orderkey, l_linenumber, l_suppkey, round(a + b * l_quantity, 4) as prediction from lineitem, f"""
BOOK.add("batch_score", _batch, SCORE_SQL)


def _stream(spark, folder):
    """Line items arrive as a stream, are scored and appended to files."""
    df, step, model = _scoring_parts(spark, folder)
    arriving = spark.readStream.schema(table(spark, folder, "lineitem").schema).option("pathGlobFilter", "lineitem.parquet").parquet(folder)
    scored = stream_score(arriving.select(*LINE, "l_quantity"), [step], model)
    path = scratch_path(spark, "scored")
    to_parquet(scored.select(*LINE, "prediction"), path, path + "-state").awaitTermination()
    return rounded(spark.read.parquet(path), 4)


BOOK.add("stream_score", _stream, SCORE_SQL)

LIMITS = "select event_type as tag, avg(value) as tag_c_value from events group by 1"


def _tagged(df):
    return df.select("ts", (F.col("user_id") % 10).alias("d_id"), F.col("event_type").alias("tag"), "value")


def _limits(spark, folder):
    events = table(spark, folder, "events")
    return events.groupBy(F.col("event_type").alias("tag")).agg(F.avg("value").alias("tag_c_value"))


def _plain(df):
    """Near-equal sums may round either way around a limit, so the flag is taken from rounded values."""
    flag = F.col("tag_value") > F.col("tag_c_value")
    return rounded(df, 6).withColumn("breached", F.coalesce(flag, F.lit(False)))


MONITOR = """with e as (select time_bucket(interval '6 hours', ts) as window_start, user_id % 10 as d_id, event_type as tag, value from events),
    l as ({limits}), g as (select window_start, d_id, tag, avg(value) as v, count(value) as n from e group by all)
    select window_start, window_start + interval '6 hours' as window_end, d_id, tag, round(v, 6) as tag_value, n,
           round(tag_c_value, 6) as tag_c_value, round(v, 6) > round(tag_c_value, 6) as breached from g join l using (tag)""".format(
    limits=LIMITS
)
BOOK.add(
    "monitor_metrics",
    lambda spark, folder: _plain(monitor_metrics(_tagged(table(spark, folder, "events")), _limits(spark, folder), "6 hours")),
    MONITOR,
)


def _monitor_stream(spark, folder):
    """The stream emits the windows its watermark has passed."""
    schema = table(spark, folder, "events").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    found = monitor_metrics(_tagged(arriving), None, "6 hours", "1 hour")
    path = scratch_path(spark, "monitor")
    to_parquet(found, path, path + "-state").awaitTermination()
    return rounded(spark.read.parquet(path), 6)


BOOK.add(
    "monitor_stream",
    _monitor_stream,
    """with e as (select time_bucket(interval '6 hours', ts) as window_start, user_id % 10 as d_id, event_type as tag, value from events)
    select window_start, window_start + interval '6 hours' as window_end, d_id, tag, round(avg(value), 6) as tag_value, count(value) as n
    from e where window_start + interval '6 hours' <= (select max(ts) from events) - interval '1 hour' group by all""",
)


def _monitor_alerts(spark, folder):
    """Windows from one stream, their breaches from another that reads them."""
    schema = table(spark, folder, "events").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    found = monitor_metrics(_tagged(arriving), None, "6 hours", "1 hour")
    path = scratch_path(spark, "windows")
    to_parquet(found, path, path + "-state").awaitTermination()
    windows = spark.readStream.schema(found.schema).parquet(path)
    limited = windows.withColumn("tag_value", F.round("tag_value", 6)).join(F.broadcast(_limits(spark, folder)), "tag")  # a row per tag
    alerts = breach_events(limited, "6 hours", limit=F.round("tag_c_value", 6))
    to_parquet(alerts, path + "-events", path + "-events-state").awaitTermination()
    return rounded(spark.read.schema(alerts.schema).parquet(path + "-events"), 6)


BOOK.add(
    "monitor_alerts",
    _monitor_alerts,
    f"""with w as ({MONITOR}), closed as (select * from w where window_end <= (select max(ts) from events) - interval '1 hour'),
    c as (select * from closed where window_start < (select max(window_start) from closed) - interval '6 hours'),
    t as (select *, coalesce(lag(breached) over (partition by d_id, tag order by window_start), false) as before from c)
    select d_id, tag, window_start, case when breached then 'raised' else 'cleared' end as event, window_start as since, tag_value,
      tag_c_value as "limit" from t where breached <> before""",
)

TWO = ["l_quantity", "l_discount"]
FIT2 = """with m as (select avg(l_quantity) as m1, avg(l_discount) as m2, var_pop(l_quantity) as s11, var_pop(l_discount) as s22,
    covar_pop(l_quantity, l_discount) as s12, covar_pop(l_quantity, l_extendedprice) as t1, covar_pop(l_discount, l_extendedprice) as t2
    from lineitem), b as (select m1, m2, (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) as b1,
    (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12) as b2 from m)"""


def _linear(spark, folder):
    df = table(spark, folder, "lineitem").select(*LINE, *TWO, "l_extendedprice")
    return df, fit_model(df, "l_extendedprice", TWO, "linreg")


def _importance(spark, folder):
    df, model = _linear(spark, folder)
    return rounded(global_importance(model, df, TWO), 4)


BOOK.add(
    "global_importance",
    _importance,
    FIT2
    + """ select 'l_quantity' as feature, round(avg(abs(b1 * (l_quantity - m1))), 4) as importance from lineitem, b
    union all select 'l_discount', round(avg(abs(b2 * (l_discount - m2))), 4) from lineitem, b""",
)


def _permuted(spark, folder):
    """Permutation importance of a tree over all orders."""
    df = table(spark, folder, "lineitem").select(*LINE, *TWO, "l_extendedprice")
    model = fit_model(df, "l_extendedprice", TWO, "dtr", max_depth=5)
    return rounded(global_importance(model, df, TWO, target="l_extendedprice", key=LINE), 2)


BOOK.add("permutation_importance", _permuted)


def _dependence(spark, folder):
    df, model = _linear(spark, folder)
    return rounded(dependence_data(model, df, TWO, LINE), 4)


BOOK.add(
    "dependence_data",
    _dependence,
    FIT2
    + """, i as (select avg(abs(b1 * (l_quantity - m1))) as i1, avg(abs(b2 * (l_discount - m2))) as i2 from lineitem, b)
    select l_orderkey, l_linenumber, l_suppkey, 'l_quantity' as feature, round(l_quantity, 4) as value,
        round(b1 * (l_quantity - m1), 4) + 0.0::double as contribution, 'l_discount' as other, round(l_discount, 4) as other_value from lineitem, b
    union all
    select l_orderkey, l_linenumber, l_suppkey, 'l_discount', round(l_discount, 4),
        round(b2 * (l_discount - m2), 4) + 0.0::double, 'l_quantity', round(l_quantity, 4) from lineitem, b""",
)

# an extremely random tree of two levels over line items, in SQL: hash-drawn cuts, the first with enough rows on both sides, the largest fall
RANDOM = {"n_estimators": 1, "max_depth": 2, "min_samples_leaf": 50, "max_features": "all"}


def _random_tree(spark, folder):
    df = table(spark, folder, "lineitem").select(*LINE, *TWO, "l_extendedprice")
    return df, fit_model(df, "l_extendedprice", TWO, "extraTrees", **RANDOM)


def _side_sql(name: str, number: int, rows: str, box: str) -> str:
    """The split of one node: `rows` has (x0, x1, y), `box` has (f, low, high); gives f, cut, and both sides' rows and means."""
    return f"""
    {name}_cuts as (select f, r, low + (high - low) * ('0x' || substr(md5('5|0|{number}|' || f || '|' || r // 4), 8 * (r % 4)::integer + 1, 8))::bigint::double / 4294967296 as cut,
        ('0x' || substr(md5('5|0|{number}|' || f), 1, 8))::bigint as turn from ({box}), range(8) as t(r)),
    {name}_sums as (select f, r, cut, turn, count(*) as n, count(*) filter (x <= cut) as nl, sum(y) filter (x <= cut) as sl, sum(y * y) filter (x <= cut) as ql,
        sum(y) as s, sum(y * y) as q from (select *, case f when 0 then x0 else x1 end as x from {rows}, {name}_cuts) group by f, r, cut, turn),
    {name}_first as (select *, row_number() over (partition by f order by r) as place from {name}_sums where nl >= 50 and n - nl >= 50),
    {name} as (select f, cut, nl, n - nl as nr, sl / nl as ml, (s - sl) / (n - nl) as mr, n, s / n as m from {name}_first where place = 1
        order by -(sl * sl / nl + (s - sl) * (s - sl) / (n - nl)), turn limit 1)"""


RANDOM_SQL = f"""with t as (select row_number() over () as id, l_orderkey, l_linenumber, l_suppkey, l_quantity::double as x0, l_discount::double as x1, l_extendedprice::double as y from lineitem),
    box as (select 0 as f, min(x0) as low, max(x0) as high from t union all select 1, min(x1), max(x1) from t),
    {_side_sql("root", 1, "t", "select * from box")},
    lower as (select t.* from t, root where case f when 0 then x0 else x1 end <= cut),
    upper as (select t.* from t, root where case f when 0 then x0 else x1 end > cut),
    {_side_sql("l", 2, "lower", "select b.f, b.low, case when b.f = root.f then cut else b.high end as high from box b, root")},
    {_side_sql("u", 3, "upper", "select b.f, case when b.f = root.f then cut else b.low end as low, b.high from box b, root")},
    -- the tree's value where both, one or none of the features are known: an unknown one is passed by the shares of rows
    k as (select * from (values (true, true), (true, false), (false, true), (false, false)) as v(k0, k1)),
    w as (select t.*, k0, k1,
        case when case l.f when 0 then k0 else k1 end then case when case l.f when 0 then x0 else x1 end <= l.cut then l.ml else l.mr end else l.m end as lv,
        case when case u.f when 0 then k0 else k1 end then case when case u.f when 0 then x0 else x1 end <= u.cut then u.ml else u.mr end else u.m end as uv
        from t, k, l, u),
    e as (select w.*, case when case root.f when 0 then k0 else k1 end then case when case root.f when 0 then x0 else x1 end <= root.cut then lv else uv end
        else (lv * root.nl + uv * root.nr) / root.n end as v from w, root),
    g as (select id, l_orderkey, l_linenumber, l_suppkey, x0, x1, max(v) filter (k0 and k1) as whole, max(v) filter (k0 and not k1) as first,
        max(v) filter (not k0 and k1) as second, max(v) filter (not k0 and not k1) as base from e group by all)"""
BOOK.add(
    "family_extra_trees",
    lambda spark, folder: rounded(_random_tree(spark, folder)[1].transform(table(spark, folder, "lineitem")).select(*LINE, "prediction"), 3),
    RANDOM_SQL + " select l_orderkey, l_linenumber, l_suppkey, round(whole, 3) as prediction from g",
)


def _tree_shapley(spark, folder):
    """Exact Shapley values of every line item under a tree of two levels."""
    df, model = _random_tree(spark, folder)
    found = shapley(model, df, LINE)
    parts = [F.col("contributions")[i].alias(f) for i, f in enumerate(TWO)]
    return rounded(found.select(*LINE, "base", "explained", *parts), 3)


BOOK.add(
    "tree_shapley",
    _tree_shapley,
    RANDOM_SQL
    + """ select l_orderkey, l_linenumber, l_suppkey, round(base, 3) as base, round(whole, 3) as explained,
        round((first - base + whole - second) / 2, 3) + 0.0::double as l_quantity, round((second - base + whole - first) / 2, 3) + 0.0::double as l_discount from g""",
)


def _tree_importance(spark, folder):
    df, model = _random_tree(spark, folder)
    return rounded(global_importance(model, df, TWO, by="shapley"), 2)


BOOK.add(
    "tree_importance",
    _tree_importance,
    RANDOM_SQL
    + """ select 'l_quantity' as feature, round(avg(abs(first - base + whole - second)) / 2, 2) as importance from g
    union all select 'l_discount', round(avg(abs(second - base + whole - first)) / 2, 2) from g""",
)


def _tree_dependence(spark, folder):
    df, model = _random_tree(spark, folder)
    return rounded(dependence_data(model, df, TWO, LINE, by="shapley"), 3)


BOOK.add(
    "tree_dependence",
    _tree_dependence,
    RANDOM_SQL
    + """ select l_orderkey, l_linenumber, l_suppkey, 'l_quantity' as feature, round(x0, 3) as value,
        round((first - base + whole - second) / 2, 3) + 0.0::double as contribution, 'l_discount' as other, round(x1, 3) as other_value from g
    union all select l_orderkey, l_linenumber, l_suppkey, 'l_discount', round(x1, 3), round((second - base + whole - first) / 2, 3) + 0.0::double,
        'l_quantity', round(x0, 3) from g""",
)



def _cosines(spark, folder):
    """Six random Fourier features of two columns of every line item."""
    df = table(spark, folder, "lineitem").select(*LINE, *TWO)
    made = FourierMap.fit(df, TWO, gamma=0.5, size=6).column()
    return rounded(df.select(*LINE, F.posexplode(made).alias("nr", "cosine")), 6)


BOOK.add(
    "fourier_features",
    _cosines,
    """with t as (select avg(l_quantity) as m0, stddev_pop(l_quantity) as s0, avg(l_discount) as m1, stddev_pop(l_discount) as s1 from lineitem),
    u as (select nr, c, ('0x' || substr(md5('5|' || nr || '|' || c), 1, 8))::bigint / 4294967296.0::double as a,
        ('0x' || substr(md5('5|' || nr || '|' || c), 9, 8))::bigint / 4294967296.0::double as b from range(6) as n(nr), (values ('0'), ('1'), ('shift')) as k(c)),
    w as (select nr, max(sqrt(-2 * ln(a)) * cos(2 * pi() * b)) filter (c = '0') as w0, max(sqrt(-2 * ln(a)) * cos(2 * pi() * b)) filter (c = '1') as w1,
        max(2 * pi() * a) filter (c = 'shift') as shift from u group by nr)
    select l_orderkey, l_linenumber, l_suppkey, nr::integer as nr,
        round(sqrt(2 / 6.0::double) * cos((l_quantity - m0) / s0 * w0 + (l_discount - m1) / s1 * w1 + shift), 6) + 0.0::double as cosine from lineitem, t, w""",
)

QUERIES, SQL = BOOK.queries, BOOK.sql
