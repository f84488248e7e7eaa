"""Split, metric and fairness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import col
from ..ml import metrics as mt
from ..ml.split import train_test_split
from .tools import Book, rounded
from .views import VIEWS, over, table

BOOK = Book()
HASH = "('0x' || substr(md5({0}), 1, {1}))::bigint"


def hash_sql(seed, *parts: str, digits: int = 8) -> str:
    """Whole number of the first hexadecimal digits of a hash: 8 of them as hash32, 15 as hash60."""
    return HASH.format(f"'{seed}|' || " + " || '|' || ".join(parts), digits)


def _split(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    train, test = train_test_split(df, 0.2, ["c_custkey"], 5)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


BOOK.add(
    "train_test_split",
    _split,
    f"""select c_custkey, c_acctbal, case when {hash_sql(5, 'c_custkey')} % 10000 < 2000 then 'test' else 'train' end as part
        from customer""",
)

MODELS_REG = """select 'a' as model, y, yhat from ({0}) union all select 'b', y, yhat * 1.1 + 5 from ({0})
    union all select 'c', y - 30000, yhat from ({0})""".format(VIEWS["pred_reg"])
BOOK.add(
    "regression_metrics",
    lambda spark, folder: rounded(mt.regression_metrics(over(spark, folder, MODELS_REG), "y", "yhat", "model"), 4),
    f"""with t as ({MODELS_REG}), e as (
          select model, avg((y - yhat) * (y - yhat)) as mse, avg(abs(y - yhat)) as mae, var_pop(y) as v,
                 avg(abs(y - yhat) / greatest(abs(y), 2.220446049250313e-16)) as mape,
                 case when count(*) filter (y < 0 or yhat < 0) = 0 then
                   avg(case when y >= 0 and yhat >= 0 then (ln(1 + y) - ln(1 + yhat)) * (ln(1 + y) - ln(1 + yhat)) end) end as msle
          from t group by 1)
        select model, round(mse, 4) as "MSE", round(sqrt(mse), 4) as "RMSE", round(mae, 4) as "MAE", round(1 - mse / v, 4) as "R2",
               round(msle, 4) as "MSLE", round(mape, 4) as "MAPE" from e""",
)
CLS = VIEWS["pred_cls"]
CLASS_SQL = """c as (select s, v as c from t, unnest([y, yhat]) as u(v) group by 1, 2),
    k as (select c.s, c.c, count(*) filter (y = c.c) as sup, count(*) filter (yhat = c.c) as said,
                 count(*) filter (y = c.c and yhat = c.c) as hit from c join t on t.s = c.s group by 1, 2),
    r as (select *, case when said = 0 then 0 else hit / said::double end as p, case when sup = 0 then 0 else hit / sup::double end as q from k),
    f as (select *, case when p + q = 0 then 0 else 2 * p * q / (p + q) end as f from r)
    select s, round(sum(hit) / sum(sup)::double, 6) as accuracy, round(sum(p * sup) / sum(sup), 6) as precision,
           round(sum(q * sup) / sum(sup), 6) as recall, round(sum(f * sup) / sum(sup), 6) as f1 from f group by s"""
BOOK.add(
    "classification_metrics",
    lambda spark, folder: rounded(mt.classification_metrics(table(spark, folder, "pred_cls"), "y", "yhat", "s")),
    f"with t as ({CLS}), {CLASS_SQL}",
)

RATES = f"""with t as ({VIEWS["pred_bin"]}), r as (select s, count(*) as n, avg(case when yhat = 1 then 1.0::double else 0.0::double end) as sel,
    avg(case when y = 1 then (yhat = 1)::integer::double end) as tpr, avg(case when y = 0 then (yhat = 1)::integer::double end) as fpr
    from t group by s)"""


def _fair(name: str, run, expression: str, column: str) -> None:
    BOOK.add(
        name,
        lambda spark, folder: rounded(run(table(spark, folder, "pred_bin"))),
        f"{RATES} select round({expression}, 6) as {column} from r",
    )


BOOK.add(
    "selection_rate",
    lambda spark, folder: rounded(mt.selection_rate(table(spark, folder, "pred_bin"), "yhat", "s")),
    f"{RATES} select s, n, round(sel, 6) as selection_rate from r",
)
_fair("disparate_impact", lambda t: mt.disparate_impact(t, "yhat", "s"), "min(sel) / max(sel)", "disparate_impact")
_fair("parity_difference", lambda t: mt.parity_difference(t, "yhat", "s"), "max(sel) - min(sel)", "parity_diff")
_fair("parity_ratio", lambda t: mt.parity_ratio(t, "yhat", "s"), "min(sel) / max(sel)", "parity_ratio")
_fair(
    "eq_odds_difference",
    lambda t: mt.eq_odds_difference(t, "y", "yhat", "s"),
    "greatest(max(tpr) - min(tpr), max(fpr) - min(fpr))",
    "eq_odds_diff",
)
_fair(
    "eq_odds_ratio",
    lambda t: mt.eq_odds_ratio(t, "y", "yhat", "s"),
    "least(min(tpr) / max(tpr), min(fpr) / max(fpr))",
    "eq_odds_ratio",
)
_fair("equal_opportunity", lambda t: mt.equal_opportunity(t, "y", "yhat", "s"), "max(tpr) - min(tpr)", "equal_opportunity")


def _leaderboard(spark, folder):
    """One trial per supplier nation: its line items as predictions."""
    rows = over(
        spark,
        folder,
        """select l_suppkey as run_id, l_extendedprice as y, l_quantity * 1000 * (1 - l_discount) as yhat from lineitem""",
    )
    trials = mt.regression_metrics(rows, "y", "yhat", "run_id").select("run_id", "R2", "MAE", "RMSE")
    board = mt.leaderboard(trials, "RMSE")
    return rounded(board, 4)


BOOK.add(
    "leaderboard",
    _leaderboard,
    """select l_suppkey as run_id, round(sqrt(avg((l_extendedprice - l_quantity * 1000 * (1 - l_discount)) ** 2)), 4) as "RMSE",
       round(1 - avg((l_extendedprice - l_quantity * 1000 * (1 - l_discount)) ** 2) / var_pop(l_extendedprice), 4) as "R2",
       round(avg(abs(l_extendedprice - l_quantity * 1000 * (1 - l_discount))), 4) as "MAE"
       from lineitem group by 1 order by 2""",
)

QUERIES, SQL = BOOK.queries, BOOK.sql
