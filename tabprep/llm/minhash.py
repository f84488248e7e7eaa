"""Near duplicates: SuperMinHash signatures, banding, verification on full sets, grouping.

1. Every text becomes its set of word shingles, a 128-bit digest of the set and the keys of its signature's bands.
2. Equal sets form a class; the class goes on as its smallest document id, however many copies it has.
3. Classes that share a band key are candidates. Each bucket's members hang on its smallest member; the components of
   these stars say which classes can be linked at all.
4. Those components are dealt into blocks of bounded weight; two blocks meet only if some bucket has members in both. Where
   they meet, pairs that share a band key are verified on their full sets, except pairs already joined there, and only
   a spanning forest of the links found is passed on. No pair list of a bucket ever exists.
5. The components of the forests are the groups.

With 32 bands of 4 values, a pair of similarity 0.8 shares no band with probability (1 - 0.8^4)^32 = 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import pinned, scratch_path, stored
from .base import filled, long_id, pick, scan_number, stream, table
from .graph import components
from .shingles import band_keys, set_digest, shingle_set, similar, super_minhash

BANDS, ROWS = 32, 4
BLOCK = 512  # weight of a block: one per class and 1,000 shingles
HEAVY = 1000
PASSED = 100_000  # classes a task remembers to have passed on

SIGNED = "row long, doc_id long, n_shingles long, class binary, bands array<long>"
MEMBER = "rep long, n long, class binary, bands binary, elements binary"


def signed(picked: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """One row per document; class and bands are null for an empty set. Written to the shared folder and read back."""

    def sign(documents: Iterable[tuple]) -> Iterator[tuple]:
        for row, name, text in documents:
            elements = shingle_set(text, size)
            if not len(elements):
                yield row, name, 0, None, None
                continue
            keys = band_keys(super_minhash(elements, bands * rows), bands)
            yield row, name, len(elements), set_digest(elements), keys.tolist()

    path = scratch_path(picked.sparkSession, "signatures")
    stored(stream(picked.select("row", "doc_id", "text"), sign, SIGNED, as_bytes=("text",)), path)
    return picked.sparkSession.read.schema(SIGNED).parquet(path)


def _weight(n: Column) -> Column:
    return F.lit(1) + F.floor(n / F.lit(HEAVY))


def blocks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((rep, block), (left, right)) from (key, rep, n, pivot): blocks of classes, and which blocks meet.

    Small components share a block. A large one is cut by the least pivot of its members, which keeps families together,
    and a large family by class.
    """
    stars = members.where(F.col("rep") != F.col("pivot")).select(F.col("rep").alias("u"), F.col("pivot").alias("v"))
    labels = components(stars)
    classes = members.groupBy("rep").agg(F.first("n").alias("n"), F.min("pivot").alias("home"))
    classes = classes.join(labels, F.col("rep") == F.col("node"), "left").select(
        "rep", "home", _weight(F.col("n")).alias("weight"), F.coalesce("label", "rep").alias("label")
    )
    classes = pinned(classes)
    sizes = classes.groupBy("label").agg(F.sum("weight").alias("size"))
    homes = classes.groupBy("label", "home").agg(F.sum("weight").alias("family"))
    total = classes.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    shared = -(-int(total) // BLOCK) or 1

    def part(value: str, weight: str) -> Column:
        return F.pmod(F.xxhash64(F.col(value)), F.ceil(F.col(weight) / F.lit(BLOCK)))

    small = F.col("size") <= BLOCK
    cut = F.when(F.col("family") <= BLOCK, F.lit(0)).otherwise(part("rep", "family"))
    block = F.when(small, F.pmod(F.xxhash64("label"), F.lit(shared))).otherwise(
        F.xxhash64(F.col("label"), part("home", "size"), F.when(F.col("family") <= BLOCK, F.lit(-1)).otherwise(F.col("home")), cut)
    )
    dealt = classes.join(homes, ["label", "home"]).join(sizes, "label")
    dealt = pinned(dealt.select("rep", block.alias("block"), small.alias("small")))
    at = members.join(dealt.where(~F.col("small")), "rep").select("key", "block").distinct()
    other = at.select("key", F.col("block").alias("right"))
    cross = at.withColumnRenamed("block", "left").join(other, "key").where(F.col("left") < F.col("right")).select("left", "right").distinct()
    own = dealt.select(F.col("block").alias("left"), F.col("block").alias("right")).distinct()
    return dealt.select("rep", "block"), own.unionByName(cross)


def forest(left: pa.Table, right: pa.Table | None, n_bands: int, percent: int) -> list[tuple[int, int]]:
    """Links between the classes of two blocks, or of one, enough to join what verification joins."""

    def columns(rows: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, list[bytes]]:
        keys = np.frombuffer(b"".join(rows.column("bands").to_pylist()), dtype="<i8").reshape(-1, n_bands)
        return rows.column("rep").to_pylist(), rows.column("n").to_numpy(), keys, rows.column("elements").to_pylist()

    reps, sizes, keys, sets = columns(left)
    more = columns(right) if right is not None else (reps, sizes, keys, sets)
    shift = len(reps) if right is not None else 0
    shared = np.zeros((len(reps), len(more[0])), dtype=np.int16)
    for band in range(n_bands):
        shared += keys[:, band, None] == more[2][None, :, band]
    near = 100 * np.minimum(sizes[:, None], more[1][None]) >= percent * np.maximum(sizes[:, None], more[1][None])
    wanted = (shared > 0) & near
    if right is None:
        wanted = np.triu(wanted, 1)
    a, b = np.nonzero(wanted)
    order = np.argsort(-shared[a, b], kind="stable")
    every = reps + more[0] if shift else reps
    raw = sets + more[3] if shift else sets
    root = list(range(len(every)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(a[order].tolist(), (b[order] + shift).tolist()):
        x, y = find(i), find(j)
        if x != y and similar(np.frombuffer(raw[i], dtype="<u8"), np.frombuffer(raw[j], dtype="<u8"), percent):
            root[max(x, y)] = min(x, y)
            out.append((every[i], every[j]))
    return out


def one_each(rows: pa.Table) -> pa.Table:
    """One row of each class; rows repeated as a whole bring theirs once a task."""
    first: dict[tuple, int] = {}
    for at, key in enumerate(zip(rows.column("rep").to_pylist(), rows.column("class").to_pylist())):
        first.setdefault(key, at)
    return rows if len(first) == len(rows) else rows.take(pa.array(list(first.values()), pa.int64()))


def links(picked: DataFrame, reps: DataFrame, members: DataFrame, size: int, bands: int, percent: int) -> DataFrame:
    """(u, v) between classes, verified on full sets rebuilt from the texts of the candidates alone."""
    dealt, meetings = blocks(members)
    wanted = reps.join(dealt, "rep").select("rep", "n", "class", "bands", "block")

    def rebuild(rows: Iterable[tuple]) -> Iterator[tuple]:
        passed: set[tuple] = set()
        for rep, n, digest, keys, block, text in rows:
            if (rep, digest) in passed:  # the row is repeated
                continue
            elements = shingle_set(text, size)
            if set_digest(elements) == digest:  # an id may come with other texts too
                if len(passed) >= PASSED:
                    passed.clear()
                passed.add((rep, digest))
                yield rep, n, digest, np.array(keys, dtype="<i8").tobytes(), elements.astype("<u8").tobytes(), block

    texts = picked.select(F.col("doc_id").alias("rep"), "text")
    full = stream(wanted.hint("merge").join(texts, "rep"), rebuild, MEMBER + ", block long", as_bytes=("text",))
    sides = meetings.select("left", "right", F.col("left").alias("block"), F.lit(0).alias("side")).unionByName(
        meetings.where(F.col("left") != F.col("right")).select("left", "right", F.col("right").alias("block"), F.lit(1).alias("side"))
    )
    met = full.join(sides, "block").drop("block")

    def meet(rows: pa.Table) -> pa.Table:
        side = rows.column("side").to_numpy()
        left = one_each(rows.filter(pa.array(side == 0)))
        right = one_each(rows.filter(pa.array(side == 1))) if (side == 1).any() else None
        found = forest(left, right, bands, percent) if len(left) else []
        return pa.table({"u": pa.array([f[0] for f in found], pa.int64()), "v": pa.array([f[1] for f in found], pa.int64())})

    return met.groupBy("left", "right").applyInArrow(meet, "u long, v long")


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
    row: Column | None = None,
) -> DataFrame:
    """row, doc_id, n_shingles, component_id, kept: one row per input row; `row` is a whole number by which a caller finds
    its rows again, by default a number of the scan.

    Linked are documents whose shingle sets have 100 * intersection >= percent * union; a component's id is its smallest
    document id and that row is kept. Empty and null texts are linked with nothing. Rows that share an id are one
    document with the links of all its texts; rows without an id have component_id null and are kept. An empty table
    gives no row.
    """
    picked = pick(docs, row=scan_number(row), doc_id=long_id(doc_id), text=filled(text))
    found = signed(picked, shingle, bands, rows)
    known = found.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    classes = known.groupBy("class").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    classes = pinned(classes)
    entries = classes.select(F.explode("bands").alias("key"), "rep", "n")
    buckets = entries.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("members"))
    members = pinned(entries.join(buckets.where(F.col("members") > 1).drop("members"), "key"))
    linked = links(picked, classes, members, shingle, bands, percent)
    # an id with several texts joins their classes
    of_id = known.select("doc_id", "class").distinct().join(classes.select("class", "rep"), "class")
    several = of_id.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where(F.col("u") != F.col("v"))
    joined = of_id.join(several.select("doc_id"), "doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    labels = components(linked.unionByName(joined))
    placed = classes.select("class", "rep").join(labels, F.col("rep") == F.col("node"), "left")
    placed = placed.select("class", F.coalesce("label", "rep").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (
        found.select("row", "doc_id", "n_shingles", "class")
        .join(placed, "class", "left")
        .select("row", "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
    )


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), shingle=4).drop("row")


OP8_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) end as s from w),
n as (select doc_id, len(s)::bigint as n_shingles from s),
e as (select doc_id, unnest(s) as g from s),
c as (select a.doc_id as x, b.doc_id as y, count(*) as common from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * common >= 80 * (a.n_shingles + b.n_shingles - common)),
two as (select x, y from l union all select y, x from l),
r(x, y) as (select x, y from two union select r.x, two.y from r join two on r.y = two.x)
select n.doc_id, n_shingles, least(n.doc_id, coalesce(min(r.y), n.doc_id)) as component_id,
  n.doc_id = least(n.doc_id, coalesce(min(r.y), n.doc_id)) as kept
from n left join r on r.x = n.doc_id group by n.doc_id, n_shingles
"""
