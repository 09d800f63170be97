"""Secret scanning with a ledger of what was scanned.

A row of text is a version of a path; its content address is the SHA-256 of its
bytes. The ledger says which (blob, rule version) pairs were scanned and what
was found. A scan takes the blobs that the ledger lacks at the current rule
version, reads each once whatever the number of its paths, appends to the
ledger, and joins the findings back to all paths.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from merset.session import cut, scratch, spread

#: kind, pattern, least length, group that must have it. Fixed values.
RULES = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 1),
    ("access", r"AKIA[A-Z0-9]+", 18, 0),
    ("hex", r"[0-9a-f]+", 16, 0),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, 0),
]
BASE = ("assign", "access", "hex")
RULE_VERSION = "1"
LEDGER = "blob string, rule_version string, spans string, n_assign long, n_access long, n_hex long, base_sha256 string"
#: Part of every match of assign, in lower case: texts without any of them are not searched.
_NEED = ("passw", "secret", "token", "apikey", "api_key")
_COMPILED = [(k, re.compile(r"[0-9a-f]{16,}" if k == "hex" else p, re.ASCII), n, g) for k, p, n, g in RULES]


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start, then kind as listed.

    Matches of one kind are leftmost and don't overlap; those too short are
    dropped after matching, so they still use up their characters. (A run of
    hex digits is one match, so asking for 16 at once finds the same.)
    """
    low = text.lower()
    found = []
    for rank, (kind, pattern, least, group) in enumerate(_COMPILED):
        if kind == "assign" and not any(x in low for x in _NEED) or kind == "access" and "AKIA" not in text or kind == "pem" and "-----BEGIN" not in text or kind == "jwt" and "eyJ" not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            spans = find_spans(text.as_py() or "")
            base = [s for s in spans if s[0] in BASE]
            joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
            rows.append((",".join(f"{k}:{a}:{b}" for k, a, b in spans), *(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(joined.encode()).hexdigest()))
        spans, a, k, h, sha = zip(*rows, strict=True) if rows else ((), (), (), (), ())
        yield pa.record_batch([batch.column(0), pa.array(spans, pa.string()), pa.array(a, pa.int64()), pa.array(k, pa.int64()), pa.array(h, pa.int64()), pa.array(sha, pa.string())], names=["blob", "spans", "n_assign", "n_access", "n_hex", "base_sha256"])


def with_blob(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the content address; a null text is the empty blob."""
    return docs.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None, rule_version: str = RULE_VERSION, text: str = "text") -> DataFrame:
    """Ledger rows for blobs of ``versions`` (with blob and text) that ``ledger`` lacks at this rule version.

    Copies of a blob meet after each map task has already reduced its own to
    one, so a blob with a third of all rows is a row a task by then.
    """
    blobs = versions.select("blob", F.coalesce(F.col(text), F.lit("")).alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    once = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    found = once.mapInArrow(_scan, "blob string, spans string, n_assign long, n_access long, n_hex long, base_sha256 string")
    return found.select("blob", F.lit(rule_version).alias("rule_version"), "spans", "n_assign", "n_access", "n_hex", "base_sha256")


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; an empty one if none was written yet."""
    empty = spark.createDataFrame([], LEDGER)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(LEDGER).parquet(path) if fs.exists(there) else empty


def findings(spark: SparkSession, path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """What the ledger has at a rule version: one row a blob, repeats or not."""
    return open_ledger(spark, path).where(F.col("rule_version") == rule_version).drop("rule_version").dropDuplicates(["blob"])


def scan_versions(docs: DataFrame, ledger_path: str | None = None, rule_version: str = RULE_VERSION, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with blob, spans, n_assign, n_access, n_hex and base_sha256.

    ledger_path: where the ledger is kept from one run to the next; by default
    a new one in the shared folder. Spans are ``kind:start:end``, comma-joined,
    in code points.

    Null and empty texts are one blob without findings. Repeated rows stay.
    Very long texts are scanned whole. An empty table gives an empty result and
    leaves the ledger as it is. Columns of docs named like results are replaced.
    A blob that the ledger has more than once at a rule version (two runs at
    once, or a rerun) counts once.
    """
    spark = docs.sparkSession
    path = ledger_path or scratch(spark, "secret-ledger")
    results = ("blob", "rule_version", "spans", "n_assign", "n_access", "n_hex", "base_sha256")
    kept = docs.drop(*[c for c in results if c in docs.columns])
    versions = with_blob(kept, text)
    scan_unseen(versions, open_ledger(spark, path) if ledger_path else None, rule_version, text).write.mode("append").parquet(path)
    return versions.join(findings(spark, path, rule_version), "blob").select(*kept.columns, *[c for c in results if c != "rule_version"])


def redact(text: str | None, spans: str, mark: str = "[SECRET]") -> str | None:
    """The text with each span, or run of overlapping spans, replaced by ``mark``."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",")):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


@F.pandas_udf(StringType())
def _redacted(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([redact(t, s or "") for t, s in zip(text, spans, strict=True)], dtype=object)


def redact_secrets(docs: DataFrame, ledger_path: str | None = None, text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """``docs``, all rows and columns, with each secret replaced by a mark, and n_chars, if there, made anew for texts that changed.

    The scan fills the ledger; then findings with spans meet the rows in a join
    by blob, whose hot blobs AQE splits; it is the same join at every size.
    Null texts stay null; repeated rows stay; columns of any name stay.
    """
    spark = docs.sparkSession
    path = ledger_path or scratch(spark, "secret-ledger")
    scan_unseen(with_blob(docs.select(F.col(text).alias("text"))), open_ledger(spark, path) if ledger_path else None, rule_version).write.mode("append").parquet(path)
    secret = cut(findings(spark, path, rule_version).where("spans <> ''").select("blob", "spans"), "secret-spans")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    told = with_blob(docs.select(row.alias("row"), F.col(f"`{text}`").alias("old")), "old").join(secret.hint("merge"), "blob", "left")
    told = told.select("row", "spans", F.when(F.col("spans").isNotNull(), _redacted(F.col("old"), F.col("spans"))).otherwise(F.col("old")).alias("new"))
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {text: F.col("new")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("spans").isNotNull(), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return told.select(*[out[c].alias(c) for c in docs.columns])
