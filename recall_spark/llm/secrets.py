"""Secret scans with an incremental ledger of blobs.

Every version of a document is addressed by the SHA-256 of its content. The ledger is a table of findings keyed by
blob and rule version; a run scans only pairs that it does not hold yet, appends what it finds (also that nothing
was found), and joins the findings back to all paths. One text is scanned for each new blob, however many paths have
it; where there are more repeated blobs than can be listed on every executor, copies of the less repeated ones are
scanned where they lie, with the same findings, rather than moving all texts.
Appending is one committed write: a run that fails before it leaves the ledger as it was and can be repeated.

Only built-in functions are used. Null counts as empty; texts without matches give empty lists. Spans are in code
points, end exclusive. One row per input row, null ids and repeated rows included; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_spark.llm.common import discard, only, save, shared_dir, small
from recall_spark.llm.spans import SPAN, joined, located, number_of, spans

#: Change it with the rules: blobs are then scanned anew.
RULE_VERSION = 1
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9+/_.=-]++"
_BEFORE_VALUE = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?"
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
KINDS = ("assign", "access", "hex")
#: Blobs, or findings and their spans, that may be broadcast: about 100 bytes each.
LISTED = 160_000
#: Further rules: name, pattern, and a string that every match holds.
MORE = (
    ("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", "PRIVATE KEY-----"),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}+", "gh"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+", "xox"),
    ("google", r"AIza[0-9A-Za-z_-]{35}", "AIza"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", "eyJ"),
)


def base_spans(text: Column) -> Column:
    assign = F.filter(located(text, ASSIGN, text.contains("=") | text.contains(":")),
        lambda m: F.length(F.regexp_replace(m["match"], _BEFORE_VALUE, "")) >= 8)
    access = F.filter(located(text, ACCESS, text.contains("AKIA")), lambda m: F.length(m["match"]) >= 16)
    return F.concat(*(spans(m, kind, i) for i, (kind, m) in enumerate(zip(KINDS, (assign, access, located(text, HEX, F.lit(True)))))))


def added_spans(text: Column) -> Column:
    return F.concat(*(spans(located(text, pattern, text.contains(held)), kind, len(KINDS) + i) for i, (kind, pattern, held) in enumerate(MORE)))


def _same() -> Column:
    """Whether a row has the blob of a list. Rows meet by a number, which takes less memory in a list than 64 characters;
    that the blobs agree too is then looked at, in a form that is no second key."""
    return (F.xxhash64("blob") == F.col("number")) & F.col("blob").startswith(F.col("of"))


def _by_number(listed: DataFrame) -> DataFrame:
    """A list of blobs (column of) with the number to look them up by."""
    return listed.withColumn("number", F.xxhash64("of"))


def _exists(df: DataFrame, path: str) -> bool:
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan(docs: DataFrame, ledger: str | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """doc_id, blob, base and added (arrays of spans) of each row, by the ledger at this path; without one, by a new ledger.

    No text moves between tasks unless more than LISTED blobs are new to a ledger that knows others already."""
    spark = docs.sparkSession
    ledger = ledger or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    rows = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    paths = save(rows.select("doc_id", "blob"), "paths")
    unseen = paths.groupBy(F.col("blob").alias("of")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    kept = _exists(docs, ledger)
    if kept:
        known = spark.read.parquet(ledger).where(F.col("rule_version") == rule_version).select(F.col("blob").alias("of"))
        kept = known.limit(1).count() > 0
        unseen = unseen.join(known, "of", "left_anti")
    unseen = save(unseen, "unseen")
    new = unseen.count()
    first = F.col("doc_id").eqNullSafe(F.col("first_id"))
    if new > LISTED and not kept:
        # All rows are new: each is scanned where it lies, but for the copies of the most repeated blobs.
        copied = F.broadcast(_by_number(unseen.where("n > 1").orderBy(F.desc("n"), "of").limit(LISTED)))
        texts = rows.join(copied, _same(), "left").where(F.col("of").isNull() | first)
    else:
        texts = rows.join(small(_by_number(unseen), new, LISTED), _same()).where(first)
    if new:
        found = texts.select("blob", F.lit(rule_version).alias("rule_version"), base_spans(F.col("text")).cast(SPAN).alias("base"),
            added_spans(F.col("text")).cast(SPAN).alias("added"))
        found.write.mode("append").parquet(ledger)
    discard(unseen)
    none = F.expr(f"cast(array() as {SPAN})")
    if not new and not kept:
        return paths.select("doc_id", "blob", none.alias("base"), none.alias("added"))
    findings = spark.read.parquet(ledger).where((F.col("rule_version") == rule_version) & (F.size("base") + F.size("added") > 0))
    hits = _by_number(findings.select(F.col("blob").alias("of"), "base", "added").dropDuplicates(["of"]))
    size = findings.agg(F.count("*"), F.coalesce(F.sum(F.size("base") + F.size("added")), F.lit(0))).first()
    return paths.join(small(hits, size[0] + size[1], LISTED), _same(), "left").select("doc_id", "blob", F.coalesce("base", none).alias("base"),
        F.coalesce("added", none).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the check: counts and a hash of the base spans, and all spans as text."""
    return found.select("doc_id", *(number_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
