"""Read and write tables: delimited text, JSON records, versions, feature groups."""

from __future__ import annotations

import csv
import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import col, require

# fixed values: texts a delimited file uses for a missing value
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# fixed values: what a number looks like in text
WHOLE = r"^[+-]?[0-9]{1,38}$"
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
ENDLESS = ("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")

SURE_DIGITS = 18  # whole numbers up to this length, sign included, fit a bigint
SLICE = 100  # text columns whose types are tested in one pass


def na_tokens(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Text columns: the listed texts become NULL. Floating columns: NaN becomes NULL."""
    out = []
    for f in df.schema.fields:
        x = col(f.name)
        if isinstance(f.dataType, T.StringType):
            x = F.when(~x.isin(*tokens), x)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            x = F.when(~F.isnan(x), x)
        out.append(x.alias(f.name))
    return df.select(*out)


def infer_types(df: DataFrame) -> DataFrame:
    """(column, type) of text columns: bigint, decimal(38,0) for longer whole numbers, double, boolean or string.

    One aggregation per SLICE columns.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    parts = [_fitting_types(df, names[i : i + SLICE]) for i in range(0, len(names), SLICE)]
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, type string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _fitting_types(df: DataFrame, names: Sequence[str]) -> DataFrame:
    fits, rows = [], []
    for i, n in enumerate(names):
        x = F.trim(col(n))
        whole = x.rlike(WHOLE)
        # only numbers of 19 digits and more are tried, as a failing cast is dear
        short = whole & ((F.length(x) <= SURE_DIGITS) | F.when(F.length(x) > SURE_DIGITS, x).try_cast("bigint").isNotNull())
        fits += [
            F.count(x).alias(f"n{i}"),
            F.count_if(short).alias(f"l{i}"),
            F.count_if(whole).alias(f"w{i}"),
            F.count_if(whole | x.rlike(NUMBER) | F.lower(x).isin(*ENDLESS)).alias(f"d{i}"),
            F.count_if(F.lower(x).isin("true", "false")).alias(f"b{i}"),
        ]
        full = F.col(f"n{i}")
        kind = (
            F.when(full == 0, F.lit("string"))
            .when(F.col(f"l{i}") == full, F.lit("bigint"))
            .when(F.col(f"w{i}") == full, F.lit("decimal(38,0)"))
            .when(F.col(f"d{i}") == full, F.lit("double"))
            .when(F.col(f"b{i}") == full, F.lit("boolean"))
            .otherwise(F.lit("string"))
        )
        rows.append(F.struct(F.lit(n).alias("column"), kind.alias("type")))
    return df.agg(*fits).select(F.inline(F.array(*rows)))


def cast_inferred(df: DataFrame) -> DataFrame:
    """Text columns cast to the types `infer_types` finds."""
    kinds = {r["column"]: r["type"] for r in infer_types(df).collect()}
    return df.select(
        *[F.trim(col(c)).try_cast(kinds[c]).alias(c) if kinds.get(c, "string") != "string" else col(c) for c in df.columns]
    )


def _after_lines(spark: SparkSession, path: str, skip: int, encoding: str) -> DataFrame:
    """(value, head, at) without the first `skip` physical lines of every file, read in parallel.

    A block of a file is read by one task from its start, so within the first block of a file row ids
    are consecutive, and the distance to the file's smallest id is the line number. The lines to drop
    must lie in that block; this is checked.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        (F.col("_metadata.file_block_start") == 0).alias("head"),
        F.monotonically_increasing_id().alias("id"),
    )
    starts = lines.where("head").groupBy("file").agg(F.min("id").alias("start"), F.count(F.lit(1)).alias("n"))
    least = starts.agg(F.min("n")).first()[0]
    if least is None or least < skip:
        raise ValueError(f"cannot skip {skip} lines: a file begins with a block of {least or 0}")
    # one row per file of the listing, which the driver holds already
    placed = lines.join(F.broadcast(starts.drop("n")), "file").withColumn("at", F.col("id") - F.col("start"))
    kept = placed.where(~(F.col("head") & (F.col("at") < skip))).select("value", "head", "at")
    if encoding.lower().replace("-", "") != "utf8":
        kept = kept.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))
    return kept


def skiprows(
    spark: SparkSession, path: str, skip: int, header: bool = True, sep: str = ",", encoding: str = "UTF-8"
) -> DataFrame:
    """Text columns of delimited files whose first `skip` lines are not part of the table."""
    lines = _after_lines(spark, path, skip, encoding)
    top = F.col("head") & (F.col("at") == skip)
    tops = lines.where(top).select("value")
    heads = [r[0] for r in (tops.distinct() if header else tops).limit(2).collect()]
    if not heads:
        raise ValueError("nothing left after the skipped lines")
    if header and len(heads) > 1:
        raise ValueError(f"files with different headers: {heads[0]!r} and {heads[1]!r}")
    cells = next(csv.reader([heads[0]], delimiter=sep))
    names = [c if header and c else f"_c{i}" for i, c in enumerate(cells)]
    body = (lines.where(~top) if header else lines).where(F.length("value") > 0)
    return body.select(F.from_csv("value", F.lit(_quoted(names)), {"sep": sep, "escape": '"'}).alias("r")).select("r.*")


def _quoted(names: Sequence[str]) -> str:
    return ", ".join("`" + n.replace("`", "``") + "` string" for n in names)


def broken_lines(spark: SparkSession, path: str) -> bool:
    """Whether some line holds an odd number of quotes, so that a record may go on in the next line."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv(
    spark: SparkSession,
    path: str,
    nrows: int | None = None,
    skip: int = 0,
    header: bool = True,
    sep: str = ",",
    encoding: str = "UTF-8",
    tokens: Sequence[str] = NA_TOKENS,
    schema: str | None = None,
    multiline: bool | None = None,
) -> DataFrame:
    """A delimited file: options, missing-value texts, then types (given, or found in one pass).

    With `multiline` a quoted value may hold line ends, and each file is read by one task; None looks whether any line
    leaves a quote open. Lines are skipped before quotes are seen, so `skip` needs records of one line. `nrows` takes
    the first rows in order of file name and line; they are held on the driver, so what is typed is what is returned.
    """
    if skip:
        if multiline or (multiline is None and broken_lines(spark, path)):
            raise ValueError("lines can only be skipped where records do not go over a line end")

        def read(at: str) -> DataFrame:
            return skiprows(spark, at, skip, header, sep, encoding)

    else:
        over = broken_lines(spark, path) if multiline is None else multiline
        reader = spark.read.options(header=header, sep=sep, encoding=encoding, multiLine=over, escape='"')
        read = reader.csv
    df = read(path) if nrows is None else _first_rows(spark, path, read, nrows)
    df = na_tokens(df, tokens)
    if schema:
        wanted = spark.createDataFrame([], schema).schema
        require(df, wanted.names)
        return df.select(*[col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted.fields])
    return cast_inferred(df)


def _first_rows(spark: SparkSession, path: str, read: Callable[[str], DataFrame], n: int) -> DataFrame:
    """The first n rows by file name and line. Files are opened one by one until there are enough."""
    rows: list = []
    whole = read(path)
    for file in sorted(spark.read.text(path).inputFiles()):
        if len(rows) >= n:
            break
        rows += [tuple(r) for r in read(file).head(n - len(rows))]
    return spark.createDataFrame(rows, whole.schema)


def version_path(root: str, dataset_id: int, version_id: int) -> str:
    return f"{root}/dataset_id={int(dataset_id)}/version_id={int(version_id)}"


def write_version(df: DataFrame, root: str, dataset_id: int, version_id: int, as_csv: bool = False) -> str:
    """Write one immutable version; writing it twice is an error."""
    path = version_path(root, dataset_id, version_id)
    writer = df.write.mode("errorifexists")
    writer.option("header", True).csv(path) if as_csv else writer.parquet(path)
    return path


def read_version(spark: SparkSession, root: str, dataset_id: int, version_id: int, as_csv: bool = False) -> DataFrame:
    path = version_path(root, dataset_id, version_id)
    return read_csv(spark, path) if as_csv else spark.read.parquet(path)


def preview(spark: SparkSession, path: str, nrows: int = 10, **options) -> DataFrame:
    """First rows of a delimited file under the given read options."""
    return read_csv(spark, path, nrows=nrows, **options)


def reencode(spark: SparkSession, path: str, root: str, dataset_id: int, version_id: int, **options) -> tuple[DataFrame, DataFrame]:
    """Read a file with new options, save it as a version, and return (table, its metadata)."""
    from ..operators.schema import table_meta

    write_version(read_csv(spark, path, **options), root, dataset_id, version_id)
    saved = read_version(spark, root, dataset_id, version_id)
    return saved, table_meta(saved)


def read_json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records as JSON text, one per line or as arrays, under a fixed schema."""
    return spark.read.schema(schema).json(path)


def json_rows(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Parse a JSON text column: its fields follow the other columns."""
    require(df, [column])
    others = [col(c) for c in df.columns if c != column]
    return df.withColumn(column, F.from_json(col(column), schema)).select(*others, f"`{column}`.*")


def feature_group_write(df: DataFrame, entity: str, root: str, name: str, at: dt.datetime | None = None) -> str:
    """Append features keyed by `entity` under the day they were made."""
    require(df, [entity])
    stamp = F.lit(at).cast("timestamp_ntz") if at else F.localtimestamp()
    others = [col(c) for c in df.columns if c != entity]
    path = f"{root}/{name}"
    (
        df.select(col(entity), *others, stamp.alias("datetime"), stamp.cast("date").alias("date"))
        .write.mode("append")
        .partitionBy("date")
        .parquet(path)
    )
    return path


def feature_group_read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}").drop("datetime", "date")
