"""Secret scan: patterns over whole texts, then corpus-wide ownership of every candidate.

A credential that many owners and repositories carry in different texts is a copied example; any other looks live, also
one whose page is mirrored. Candidates are compared by hash across the corpus: distinct (value, repository, owner, text)
first, then distinct counts of each per value.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import col
from ..session import pinned
from .base import filled, long_id, pick, scan_number, stream, table

# The base patterns and shortest lengths of the contract, in its order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
SHORTEST = {"assign": 6, "access": 20, "hex": 24}
HINTS = ("password", "passwd", "secret", "token", "api")
# Further public formats of keys.
MORE = {
    "forge": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "chat": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "payment": re.compile(r"[sr]k_live_[A-Za-z0-9]{16,}"),
    "signed": re.compile(r"[A-Za-z0-9_.-]+"),  # runs; their parts are judged by signed_parts
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"),
}
MORE_HINTS = {"forge": "gh", "chat": "xox", "payment": "k_live_", "signed": "eyJ", "pem": "-----BEGIN "}
ORDER = (*KINDS, *MORE)
MAX_OWNERS = 1
EXAMPLE = {"max_owners": 9, "max_documents": 1}  # for the queries: beyond both a value is clearly a copied example

_HEX_ONLY = bytes(b"h"[0] if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_HEX_RUN = b"h" * SHORTEST["hex"]
SPAN = "struct<kind:string,start:int,end:int,hash:bigint>"
FOUND = "nr long, row long, doc_id long, owner string, repository string, document long, n_assign long, n_access long, n_hex long, base_sha256 string, " + f"found array<{SPAN}>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place in ORDER, end, value) of the base patterns."""
    out = []
    lower = text.lower()
    if any(h in lower for h in HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= SHORTEST["assign"]:
                out.append((m.start(), 0, m.end(), m[2]))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= SHORTEST["access"]:
                out.append((m.start(), 1, m.end(), m[0]))
    if _HEX_RUN in text.encode("utf-8", "surrogatepass").translate(_HEX_ONLY):
        for m in HEX.finditer(text):
            if m.end() - m.start() >= SHORTEST["hex"]:
                out.append((m.start(), 2, m.end(), m[0]))
    return sorted(out)


def signed_parts(run: str) -> Iterator[tuple[int, int]]:
    """(start, end) of signed tokens in a run of their characters: three parts joined by dots, the first two opened by `eyJ`
    with 8 characters or more behind, the third of 8 or more. A run is cut by its dots once, so long ones cost no more."""
    parts = run.split(".")
    at = i = 0  # start of part i
    while i + 2 < len(parts):
        first, second, third = parts[i : i + 3]
        begin = first.find("eyJ")
        if 0 <= begin <= len(first) - 11 and second.startswith("eyJ") and len(second) >= 11 and len(third) >= 8:
            end = at + len(first) + len(second) + len(third) + 2
            yield at + begin, end
            at, i = end + 1, i + 3
        else:
            at, i = at + len(first) + 1, i + 1


def more_spans(text: str) -> list[tuple[int, int, int, str]]:
    out = []
    for place, (kind, pattern) in enumerate(MORE.items(), len(KINDS)):
        if MORE_HINTS[kind] not in text:
            continue
        for m in pattern.finditer(text):
            if kind == "signed":
                out += [(m.start() + a, place, m.start() + b, m[0][a:b]) for a, b in signed_parts(m[0])]
            else:
                out.append((m.start(), place, m.end(), m[0]))
    return out


def value_hash(value: str) -> int:
    """Signed 64 bits of SHA-256: the corpus-wide tables never hold a secret itself."""
    return int.from_bytes(hashlib.sha256(value.encode("utf-8", "surrogatepass")).digest()[:8], "little", signed=True)


def written(spans: Iterable[tuple]) -> str:
    return ",".join(f"{ORDER[s[1]]}:{s[0]}:{s[2]}" for s in spans)


def scanned(docs: DataFrame, doc_id: str, text: str, owner: str, repository: str, row: Column | None) -> DataFrame:
    """One row per document, pinned: row, doc_id, owner, repository, document (hash of the text), the counts, base_sha256, found. No text is kept."""
    owners = {"owner": col(owner).cast("string"), "repository": col(repository).cast("string")}
    keys = pick(docs, nr=F.monotonically_increasing_id(), row=scan_number(row), doc_id=long_id(doc_id), **owners, document=F.xxhash64(filled(text)), words=filled(text))

    def scan(rows: Iterable[tuple]) -> Iterator[tuple]:
        for *names, words in rows:
            base = base_spans(words)
            counts = [sum(s[1] == k for s in base) for k in range(len(KINDS))]
            digest = hashlib.sha256(written(base).encode()).hexdigest()
            spans = sorted(base + more_spans(words))
            found = [{"kind": ORDER[k], "start": a, "end": b, "hash": value_hash(v)} for a, k, b, v in spans]
            yield *names, *counts, digest, found

    return pinned(stream(keys, scan, FOUND))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories, n_documents) over the corpus. Null owners count as one owner, equal texts as one
    document."""
    marks = [F.coalesce(F.col(c), F.lit("\0")).alias(c) for c in ("owner", "repository")]
    each = found.select(F.explode("found.hash").alias("hash"), *marks, "document").distinct()

    def distinct(column: str, name: str) -> DataFrame:
        return each.select("hash", column).distinct().groupBy("hash").agg(F.count(F.lit(1)).alias(name))

    counts = distinct("owner", "n_owners").join(distinct("repository", "n_repositories"), "hash")
    return counts.join(distinct("document", "n_documents"), "hash")


def secrets(
    docs: DataFrame,
    max_owners: int = MAX_OWNERS,
    doc_id: str = "doc_id",
    text: str = "text",
    owner: str = "source",
    repository: str = "source",
    row: Column | None = None,
    max_documents: int = 0,
    copied: bool = False,
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (array), n_live, n_copied, and `row`, a whole
    number by which a caller finds its rows again, by default a number of the scan.

    A span is (kind, start, end, live, n_owners, n_repositories, n_documents), in code points, end exclusive, ordered by
    start and kind. It is live if at most `max_owners` owners or as many repositories carry its value, or if it stands in
    at most `max_documents` different texts. Base spans all stay; spans of the further kinds that are not live only
    with `copied`. Empty and null texts have no span; repeated rows are separate rows of the same owner. An empty table
    gives no row.
    """
    found = scanned(docs, doc_id, text, owner, repository, row)
    spans = found.select("nr", F.explode("found").alias("s")).select("nr", "s.*")
    few = (F.col("n_owners") <= max_owners) | (F.col("n_repositories") <= max_owners) | (F.col("n_documents") <= max_documents)
    judged = spans.join(ownership(found), "hash").withColumn("live", few)
    rank = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("kind"))
    if not copied:
        judged = judged.where(F.col("kind").isin(*KINDS) | F.col("live"))
    counts = ("n_owners", "n_repositories", "n_documents")
    of_row = judged.groupBy("nr").agg(
        F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "live", *counts))).alias("spans")
    )
    spans_col = F.coalesce(
        F.transform("spans", lambda s: F.struct(*[s[c] for c in ("kind", "start", "end", "live", *counts)])),
        F.array().cast(
            "array<struct<kind:string,start:int,end:int,live:boolean,n_owners:bigint,n_repositories:bigint,n_documents:bigint>>"
        ),
    )
    return (
        found.drop("found", "owner", "repository", "document")
        .join(of_row, "nr", "left")
        .drop("nr")
        .withColumn("spans", spans_col)
        .withColumn("n_live", F.size(F.filter("spans", lambda s: s["live"])).cast("bigint"))
        .withColumn("n_copied", F.size("spans") - F.col("n_live"))
    )


def span_text(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every span of every kind, and which of them are live."""
    found = secrets(table(spark, folder, "documents"), copied=True, **EXAMPLE)
    found = found.withColumn("live", F.filter("spans", lambda s: s["live"]))
    return found.withColumns({"spans": span_text("spans"), "live_spans": span_text("live")}).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", F.col("n_copied").cast("bigint"), "live_spans"
    )
