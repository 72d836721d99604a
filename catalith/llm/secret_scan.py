"""Secret scan with corpus-wide ownership of the candidates.

Patterns find the candidates of a text. Every candidate's value is hashed, and the hashes are counted over the corpus by distinct
repositories and owners: a value that SHARED_OWNERS owners hold is a widely copied example; one that fewer hold, and that looks like
a credential, is live. The base kinds keep all their spans and get that verdict; beside them, a wide net of long mixed
runs gives candidates of which only those of a single owner or two that look live become spans (kind owned).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import cut, freed, join_groups, slices


def either_case(words: str) -> str:
    """A pattern's lower-case letters in either case; ASCII letters alone."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


#: The base kinds as listed, with their patterns and the least length of the value.
ASSIGN = rf"""({either_case("password|passwd|secret|token|api_?key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: The wide net: runs of base64 and name characters.
WIDE, WIDE_LEAST = "[A-Za-z0-9+/_-]+", 20
KINDS = ("assign", "access", "hex", "owned")
#: Owners that make a value a widely copied example; distinct characters, digits and letters of a value that looks live.
SHARED_OWNERS = 3
LIVE_DISTINCT, LIVE_DIGITS, LIVE_LETTERS = 8, 2, 2

# A run that is long enough is found as such: no shorter match of the same pattern overlaps it.
_PATTERNS = [
    (re.compile(ASSIGN), 2, ASSIGN_LEAST),
    (re.compile(ACCESS), 0, ACCESS_LEAST),
    (re.compile(f"{HEX[:-1]}{{{HEX_LEAST},}}"), 0, HEX_LEAST),
    (re.compile(f"{WIDE[:-1]}{{{WIDE_LEAST},}}"), 0, WIDE_LEAST),
]
SPANS = "array<struct<start:long,kind:int,end:long,value:string,live:boolean>>"


def looks_live(value: str) -> bool:
    """Whether a value has the variety of a credential: neither a word, nor a number, nor a filler."""
    digits = sum(c in "0123456789" for c in value)
    letters = sum("a" <= c <= "z" or "A" <= c <= "Z" for c in value)
    return digits >= LIVE_DIGITS and letters >= LIVE_LETTERS and len(set(value)) >= LIVE_DISTINCT


def candidates(text: str) -> list[tuple[int, int, int, str, bool]]:
    """start, kind, end, hash of the value and whether it looks live, by start and kind; of the wide net what no base span overlaps."""
    found = []
    for kind, (pattern, group, least) in enumerate(_PATTERNS):
        for m in pattern.finditer(text):
            value = m[group]
            if len(value) >= least:
                found.append((m.start(), kind, m.end(), value))
    base = [(a, b) for a, kind, b, _ in found if kind < 3]
    found = [x for x in found if x[1] < 3 or looks_live(x[3]) and not any(a < x[2] and x[0] < b for a, b in base)] if base else [x for x in found if looks_live(x[3])]
    return sorted((a, kind, b, hashlib.sha256(v.encode()).hexdigest(), looks_live(v)) for a, kind, b, v in found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch, limit=1 << 20):
            spans = [candidates(t) for t in rows.column("text").to_pylist()]
            dicts = [[dict(zip(("start", "kind", "end", "value", "live"), s, strict=True)) for s in x] for x in spans]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.string()), ("live", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("row", "doc_id", "owner", "repository")), pa.array(dicts, kind)], names=["row", "doc_id", "owner", "repository", "spans"])


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """row, doc_id, owner, repository and the candidate spans of each text; written once."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(owner).cast("string").alias("owner"),
        F.col(repository).cast("string").alias("repository"),
        F.col("text").cast("string").alias("text"),
    )
    return cut(rows.mapInArrow(freed(_scan), f"row long, doc_id long, owner string, repository string, spans {SPANS}"))


def ownership(found: DataFrame) -> DataFrame:
    """value, n_repositories and n_owners (null is one) of every candidate value. A repository belongs to its owner.

    Each step drops repeats before it shuffles, so a value that very many rows hold arrives as one row for each task, then for each owner.
    """
    uses = found.select("owner", "repository", F.explode("spans.value").alias("value")).distinct()
    per_owner = uses.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return per_owner.groupBy("value").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def secret_scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """doc_id and spans (start, kind, end, value's sha256, live, n_repositories, n_owners, verdict) of each row, by start and kind.

    verdict: shared (SHARED_OWNERS owners or more hold the value), live (fewer, and it looks like a credential) or unclear. Spans of kind
    owned are live ones only. Offsets are code points. The owner and the repository are columns of docs; where a
    table has none, a row is its own repository and its source the owner. Null owners are one owner, null repositories
    of an owner one. Null or empty texts have no spans. Repeated rows count once as repositories and have spans each. Texts of any length
    are scanned whole. Columns not named, whatever their names, are not read. An empty table gives an empty result.
    """
    found = scan(docs, owner, repository)
    each = found.select("row", F.inline("spans"))
    verdict = F.when(F.col("n_owners") >= SHARED_OWNERS, "shared").when(F.col("live"), "live").otherwise("unclear")
    judged = join_groups(each, ownership(found), ["value"]).withColumn("verdict", verdict).where("kind < 3 or verdict = 'live'")
    fields = ("start", "kind", "end", "value", "live", "n_repositories", "n_owners", "verdict")
    per_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("spans"))  # a row's own spans
    return found.select("row", "doc_id").join(per_row, "row", "left").select("doc_id", "spans")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns, and how many spans have each verdict."""
    n = lambda rule: F.expr(f"coalesce(size(filter(spans, x -> {rule})), 0)").cast("long")
    names = F.array(*map(F.lit, KINDS))
    said = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    text = lambda of: F.coalesce(F.array_join(F.transform(of, said), ","), F.lit(""))
    return found.select(
        "doc_id",
        *(n(f"x.kind = {k}").alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(text(F.filter("spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        text("spans").alias("spans"),
        n("x.kind = 3").alias("n_owned"),
        *(n(f"x.verdict = '{v}'").alias(f"n_{v}") for v in ("shared", "live")),
    )
