"""Token-id files: one concatenated id array in document order, its boundaries in Elias-Fano code.

A file set is a Parquet table in a shared folder, one row per block of some 2^18 ids, so that Spark's commit protocol makes
every block appear once, and any store Spark writes to will do. Columns of a block:

    part, block          place: parts hold ascending document ids, blocks count from 0 in a part
    ids_before           ids of the part before this block
    n_docs, n_null       documents; the first n_null of them have no id
    n_ids, id_bytes, ids the ids, each of 2 or 4 little-endian bytes
    base_doc             smallest document id of the block
    doc_* , end_*        Elias-Fano code of (document id - base_doc) and of the documents' ends within `ids`
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import scratch_path
from . import elias_fano
from .base import filled, long_id, pick, stream
from .tokens import word_encoder

BLOCK_IDS = 1 << 18
BLOCK_DOCS = 1 << 16
_CODE = "{0}_low_bits int, {0}_low binary, {0}_high binary, {0}_samples binary"
BLOCK = (
    "part int, block int, ids_before long, n_docs int, n_null int, n_ids long, id_bytes int, ids binary, base_doc long, "
    + _CODE.format("doc")
    + ", "
    + _CODE.format("end")
)


def _block(part: int, block: int, before: int, docs: list, ends: list[int], ids: np.ndarray) -> tuple:
    known = [d for d in docs if d is not None]
    base = known[0] if known else 0
    gaps = np.array([d - base for d in known], dtype=np.uint64)
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    packed = ids.astype("<u2" if narrow else "<u4").tobytes()
    return (
        part, block, before, len(docs), len(docs) - len(known), len(ids), 2 if narrow else 4, packed, base,
        *elias_fano.encode(gaps), *elias_fano.encode(np.array(ends, dtype=np.uint64)),
    )


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> str:
    """Encode every whole text, append `end_id`, write the ids in ascending document order under `path`.

    Null text is empty (its one id is `end_id`); null ids come first; equal ids are ordered by text, and a hot id is split
    over parts by text as well. An empty table writes no block. Texts are shuffled once, by range; they are encoded after
    it, in the task that writes them.
    """
    end = int(end_id).to_bytes(4, "little")

    def blocks(rows: Iterable[tuple]) -> Iterator[tuple]:
        part, encoder = TaskContext.get().partitionId(), word_encoder(vocabulary)
        number, before = 0, 0
        names: list = []
        ends: list[int] = []
        held = bytearray()
        for name, ids in encoder.encode_rows(rows):
            held += ids
            held += end
            names.append(name)
            ends.append(len(held) // 4)
            if ends[-1] >= BLOCK_IDS or len(names) >= BLOCK_DOCS:
                yield _block(part, number, before, names, ends, np.frombuffer(bytes(held), dtype="<u4"))
                number, before = number + 1, before + ends[-1]
                names, ends, held = [], [], bytearray()
        if names:
            yield _block(part, number, before, names, ends, np.frombuffer(bytes(held), dtype="<u4"))

    picked = pick(docs, doc=long_id(doc_id), words=filled(text))
    ordered = picked.repartitionByRange("doc", F.xxhash64("words")).sortWithinPartitions("doc", "words")
    stream(ordered, blocks, BLOCK).write.option("compression", "zstd").parquet(path)
    return path


def part_starts(files: DataFrame) -> DataFrame:
    """(part, part_start): ids of all earlier parts. One row per part, so at most as many as shuffle partitions."""
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit), read from the files alone."""

    def documents(rows: Iterable[tuple]) -> Iterator[tuple]:
        for start, n_docs, n_null, width, ids, base, *codes in rows:
            array = np.frombuffer(ids, dtype="<u2" if width == 2 else "<u4")
            names = elias_fano.EliasFano(n_docs - n_null, *codes[:4]).all()
            ends = elias_fano.EliasFano(n_docs, *codes[4:]).all().astype(np.int64)
            known = [None] * n_null + [base + int(g) for g in names]
            first = 0
            for name, last in zip(known, ends.tolist()):
                yield name, start + first, last - first, array[first:last].astype("<u4").tobytes()
                first = last

    files = spark.read.schema(BLOCK).parquet(path)
    codes = [f"{kind}_{c}" for kind in ("doc", "end") for c in ("low_bits", "low", "high", "samples")]
    placed = files.join(F.broadcast(part_starts(files)), "part").select(
        (F.col("part_start") + F.col("ids_before")).alias("start"), "n_docs", "n_null", "id_bytes", "ids", "base_doc", *codes
    )
    return stream(placed, documents, "doc_id long, start long, n_tokens long, ids binary")


def lookup(block: dict, i: int) -> tuple[int, int]:
    """(first, last) of the i-th document's ids in a block, by two selects."""
    ends = elias_fano.EliasFano(block["n_docs"], *[block[f"end_{c}"] for c in ("low_bits", "low", "high", "samples")])
    return (ends.select(i - 1) if i else 0), ends.select(i)


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from .base import table

    path = write_ids(table(spark, folder, "documents"), scratch_path(spark, "ids"), public_tokenizers.path("word_bpe_49k.json"))
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
