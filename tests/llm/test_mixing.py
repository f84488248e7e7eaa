from collections import defaultdict

from pyspark.sql import functions as F

from tabprep.llm.mixing import mixed

from .conftest import clashing, hard_rows, rows


def shares(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what is above a source's limit is dealt again until none is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            out.update({s: left * weight[s] / total for s in open_})
            break
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


def check(df, given):
    found = mixed(df).collect()
    sizes = defaultdict(int)
    for doc, text, _, source, _ in given:
        sizes[source] += len((text or "").encode().split())
    target = shares(sizes)
    taken = defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in sizes)
    assert len(found) == len(given)
    return found


def test_shares(hard):
    check(clashing(hard), hard_rows())


def test_hot_source_and_epochs(spark):
    given = [(i, "w " * (i % 9), None, "big" if i % 3 else f"s{i % 7}", 0) for i in range(400)]
    df = spark.createDataFrame(given, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    first = check(df.repartition(5), given)
    again = check(df.repartition(2), given)
    assert sorted(first) == sorted(again)  # reruns agree, whatever the partitioning
    part = [r for r in first if r.size and r.taken % r.size]
    assert len(part) <= len({r.source for r in first})  # one cut document a source


def test_no_words(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id bigint, text string, source string")
    assert rows(mixed(df), "doc_id", "size", "source_size", "target", "taken") == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_empty_table(none):
    assert rows(mixed(none)) == []


def test_carry(hard):
    found = mixed(hard.withColumn("at", F.lit(3)), carry=("at",))
    assert found.columns[-1] == "at" and {r.at for r in found.collect()} == {3}


def test_rows_that_share_an_id_are_spread(spark, monkeypatch):
    """20,000 rows without id and 10,000 of one id: no range holds more than a few hundredths of them."""
    import tabprep.llm.mixing as module

    kept = []
    monkeypatch.setattr(module, "pinned", lambda df: kept.append(original(df)) or kept[-1])
    given = spark.range(0, 30_000).select(
        F.when(F.col("id") >= 20_000, F.lit(7)).cast("bigint").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source")
    )
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = mixed(given.repartition(4))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found.agg(F.sum("taken"), F.count(F.lit(1))).first() == (60_000, 30_000)
    most = kept[0].groupBy("range").count().agg(F.max("count")).first()[0]
    assert most < 30_000 / 8


def original(df):
    from tabprep.session import pinned

    return pinned(df)
