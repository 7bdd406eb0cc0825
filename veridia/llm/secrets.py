r"""Secret scans (operator 6): an incremental ledger of content-addressed blobs.

Every version of a file is a blob named by the sha256 of its text; rows may name it by any columns,
such as a path and a version (`id_col` takes several).  The ledger, a Parquet table, says which blob
was scanned under which rule version and what was found; the rule version is a digest of the rules
themselves, so other rules never meet stale findings.  A scan hashes all texts, drops blobs that the
ledger has under the same rule version, meets each remaining blob once (a blob repeated in a partition
is sent once, compressed; the rest meet by hash), records the findings, also empty ones, and joins
them back to all rows that carry the blob.  Two scans at once may record a blob twice; it counts once.

Rules are regular expressions with a least length; matches are leftmost and not overlapping for each
kind.  A cheap test on the bytes decides whether a rule's expression has to run at all on a text.

Defined results: null text is the empty text and has no findings; repeated rows each get the
findings of their blob; spans are code points, end exclusive; an empty table gives no rows and
leaves the ledger as it is.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digest, file_backed, lean, materialise, new_path

_HEX = bytes(120 if chr(i) in "0123456789abcdef" else 0 for i in range(256))


@dataclass(frozen=True)
class Rule:
    """group: whose length must be at least `least`. hints: lower-case bytes one of which every match has; run: a match holds so many hex digits in a row."""

    kind: str
    pattern: str
    group: int
    least: int
    hints: tuple[bytes, ...] = ()
    run: int = 0


#: Fixed values. The first three are the base rules; kinds are listed in the order of their spans.
RULES = (
    Rule("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, (b"akia",)),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, run=24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_")),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 30, (b"eyj",)),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----|(?:\s+[A-Za-z0-9+/=]{16,})*)", 0, 20, (b"private key-----",)),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]{3,}@", 0, 10, (b"://",)),
)
BASE = ("assign", "access", "hex")
SHA, FOUND, SALT = "redact_sha", "redact_findings", "redact_salt"
#: Rows of one blob are spread over so many keys where findings are joined back.
SALTS = 8
FINDINGS = "array<struct<kind:string,start:bigint,end:bigint>>"


def version_of(rules: tuple[Rule, ...]) -> str:
    """A digest of everything that decides what the rules find."""
    return hashlib.sha256("\n".join(repr(r) for r in rules).encode()).hexdigest()[:16]


def find(text: str, rules: tuple[Rule, ...] = RULES, raw: bytes | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all findings, by start and then by the order of the rules."""
    raw = text.encode() if raw is None else raw
    low, out = raw.lower(), []
    digits = None
    for number, rule in enumerate(rules):
        if rule.hints and not any(h in low for h in rule.hints):
            continue
        if rule.run:
            digits = raw.translate(_HEX) if digits is None else digits
            if b"x" * rule.run not in digits:
                continue
        out += [(m.start(), number, m.end(), rule.kind) for m in re.finditer(rule.pattern, text) if len(m.group(rule.group)) >= rule.least]
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def _pack(batches):
    """sha and compressed text, once for each blob of a partition (as far as the memory of hashes goes)."""
    squeeze, seen = zstandard.ZstdCompressor(level=3), set()
    for batch in batches:
        sha, packed = [], []
        for s, x in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            if s not in seen:
                seen.add(s)
                sha.append(s)
                packed.append(squeeze.compress(x))
        if len(seen) > 1_000_000:
            seen = set()
        yield pa.RecordBatch.from_arrays([pa.array(sha, pa.binary()), pa.array(packed, pa.binary())], names=["sha", "packed"])


def _scanner(rules: tuple[Rule, ...]):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        grow, last = zstandard.ZstdDecompressor(), None
        for batch in batches:
            sha, found = [], []
            for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if s != last:
                    last, raw = s, grow.decompress(x)
                    sha.append(s)
                    found.append([{"kind": k, "start": a, "end": b} for k, a, b in find(raw.decode("utf-8", "replace"), rules, raw)])
            yield pa.RecordBatch.from_arrays([pa.array(sha, pa.binary()), pa.array(found, kind)], names=["sha", "findings"])

    return scan


def _ledger(spark, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(at) else None


def _joined_back(rows: DataFrame, hits: DataFrame, sha: str) -> DataFrame:
    """rows left-joined to hits (one row for each blob with findings) by the digest; the rows of a blob are spread over SALTS keys."""
    salted = hits.withColumn(SALT, F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    return rows.withColumn(SALT, (F.monotonically_increasing_id() % SALTS).cast("int")).join(salted, [sha, SALT], "left").drop(SALT)


def findings_of(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """sha, findings of the blobs in the ledger that have some under these rules, after a scan of those of docs that it hadn't."""
    spark, version = docs.sparkSession, version_of(rules)
    ledger = ledger or new_path(spark, "ledger")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blobs = docs.select(digest(text_col).alias("sha"), text.alias("text")).where("text != ''").mapInArrow(lean(_pack), "sha binary, packed binary")
    known = _ledger(spark, ledger)
    if known is not None:
        blobs = blobs.join(known.where(F.col("version") == version).select("sha"), "sha", "left_anti")
    found = blobs.repartition("sha").sortWithinPartitions("sha").mapInArrow(lean(_scanner(rules)), f"sha binary, findings {FINDINGS}")
    found.withColumn("version", F.lit(version)).write.mode("append").parquet(ledger)
    return spark.read.parquet(ledger).where((F.col("version") == version) & (F.size("findings") > 0)).dropDuplicates(["sha"]).select("sha", "findings")


def scan(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str | list[str] = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col (a column, or several such as path and version), sha, findings for each row of docs; the ledger gains the
    blobs it hadn't under these rules."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    hits = findings_of(docs, ledger, rules, text_col).select(F.col("sha").alias(SHA), F.col("findings").alias(FOUND))
    named = [F.col(f"`{c}`").alias(f"id{k}") for k, c in enumerate(ids)]
    out = _joined_back(docs.select(*named, digest(text_col).alias(SHA)), hits, SHA)
    return out.select(*[F.col(f"id{k}").alias(c) for k, c in enumerate(ids)], F.col(SHA).alias("sha"), F.coalesce(F.col(FOUND), F.array().cast(FINDINGS)).alias("findings"))


def redact(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """docs with every span that a rule finds replaced by `mask`; all rows and columns stay, whatever their names.

    The findings come from the ledger; blobs that have some are joined back by their digest."""
    docs = file_backed(docs)
    found = materialise(findings_of(docs, ledger, rules, text_col).select(F.col("sha").alias(SHA), F.col("findings").alias(FOUND)), "findings")
    names, at = docs.columns, docs.columns.index(text_col)

    def clean(batches):
        for batch in batches:
            out = []
            for x, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if spans:
                    parts, end = [], 0
                    for s in spans:
                        if s["start"] >= end:
                            parts += [x[end : s["start"]], mask]
                        end = max(end, s["end"])
                    x = "".join(parts) + x[end:]
                out.append(x)
            columns = [pa.array(out, pa.string()) if k == at else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), digest(text_col).alias(SHA))
    rows = _joined_back(rows, found, SHA).select(*[F.col(f"row.`{c}`").alias(c) for c in names], FOUND)
    return rows.mapInArrow(lean(clean), docs.schema)


def report(docs: DataFrame, **how) -> DataFrame:
    found = scan(docs, **how)

    def joined(findings):
        return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined("findings").alias("spans"))
