"""Small helpers shared by the operators: materialised tables, size-checked broadcasts, row splits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most so many rows of one or two numbers (16 MB) may be broadcast; above it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Rows of texts in an Arrow batch: at 100 kB a text 100 MB.
BATCH_ROWS = 1_000
_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or else, on one machine only, a temporary one."""
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="recall-")
    return f"file://{_own_dir}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, lost executors don't matter."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._saved_at = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Delete tables that save() wrote, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; df has to be cheap to count, as a saved table is."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= most else df


def ascii_lower(column: str | Column) -> Column:
    """Lower-cases A-Z only. lower() is right, and much faster, where each character is one byte."""
    c = F.col(column) if isinstance(column, str) else column
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def share(column: str, wanted: int, of: int, seed: int = 17) -> Column:
    """True for about wanted of so many values, always the same ones: those whose 64-bit hash lies in that part of its
    range. It is drawn as finely as the hash, so that a bounded sample of any number of rows is not empty."""
    if wanted >= of:
        return F.lit(True)
    return F.xxhash64(column, F.lit(seed)) < F.lit((1 << 64) * wanted // of - (1 << 63))


def lowest(hashes: DataFrame, wanted: int) -> int:
    """The wanted-th smallest of the distinct values of h, or the largest if there are fewer; below all of them without any."""
    row = hashes.select("h").where("h is not null").distinct().orderBy("h").limit(wanted).agg(F.max("h")).first()
    return -(1 << 63) if row[0] is None else row[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _row, a number of each row's own in the order of doc_id, null first: doc_id itself where it is unique.

    Otherwise the numbered rows are saved, so that they keep their numbers however often they are read."""
    if not repeats(docs):
        return docs.withColumn("_row", F.col("doc_id").cast("long"))
    # Rows that repeat an id and its text are told apart too: no range of the sort holds them all.
    ordered = docs.withColumn("_at", F.monotonically_increasing_id()).orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "_at")
    return save(ordered.drop("_at").withColumn("_row", F.monotonically_increasing_id()), "rows")


def repeats(docs: DataFrame) -> bool:
    """Whether a doc_id is null or occurs twice."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count() > 0


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of keyed() whose _row isn't in the column doc_id of dropped."""
    gone = save(dropped.select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return rows.join(small(gone), rows["_row"] == gone["_gone"], "left_anti").drop("_row")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, under these names: columns of the caller cannot clash with those an operator adds.

    Texts go to Python in batches of BATCH_ROWS, unless the session has a size of its own. The setting is read when a
    result is computed, which is after this call, so it stays set for the session."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.select(*(df[c].alias(c) for c in columns))
