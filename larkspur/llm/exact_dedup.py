"""Exact deduplication against a persistent digest index (native DataFrame code).

The index is a Parquet table of ``(digest, keep_id, batch)``, bucketed and sorted by digest, so
that a new batch meets it in a sort-merge anti-join that does not shuffle the index.
Texts that the index does not hold are appended; of equal texts in one batch the row with
the largest id stays.

Every entry names the batch that brought it.  A batch that is run again, after a failure before
or after its append, does not count its own entries as known: it gets the verdicts of the first
run, and only entries that are missing are appended.

Defined results: a null text counts as empty; rows that repeat an id and its text count as
separate rows of which one stays; an empty batch gives no rows and appends nothing; a null
id loses against any other id; further columns of the input, whatever their names, are
neither read nor returned unless ``keep`` lists them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.storage import discard, exists, materialize, new_path


def text_digest(text) -> F.Column:
    """SHA-256 of the whole text in UTF-8, as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class DigestIndex:
    """Bucketed table of the digests seen so far.

    ``path`` may hold an index written by another session.  ``buckets`` is fixed at creation; opening
    an index with another number raises.  Pick it so that a bucket of the grown index still fits a
    task (one bucket per 4 million digests is about 160 MB).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{hashlib.sha256(path.encode()).hexdigest()[:32]}"
        note = f"{path.rstrip('/')}-buckets"
        if not exists(spark, note):
            spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("ignore").parquet(note)
        made = spark.read.parquet(note).first()["buckets"]
        if made != buckets:
            raise ValueError(f"the index at {path} has {made} buckets, not {buckets}")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def before(self, batch: str) -> DataFrame:
        """The entries of all other batches."""
        return self.read().where(F.col("batch") != batch)

    def missing(self, groups: DataFrame, batch: str) -> DataFrame:
        """Rows of ``groups`` whose digest no other batch has brought."""
        return groups.hint("merge").join(self.before(batch), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add ``(digest, keep_id)`` rows that are not there; each bucket is written by one task, as one file."""
        fresh = groups.select("digest", "keep_id")
        if not self.read().where(F.col("batch") == batch).isEmpty():  # this batch was here before
            fresh = fresh.hint("merge").join(self.read(), "digest", "left_anti")
        fresh.withColumn("batch", F.lit(batch)).repartition(self.buckets, "digest").write.insertInto(self.table)


def batch_name(rows: DataFrame) -> str:
    """A name that follows from the ids and texts of a batch, in any order."""
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), "row_id", "digest").cast("decimal(20,0)")), F.lit(0)) for seed in (1, 2)]
    n, one, two = rows.agg(F.count(F.lit(1)), *sums).first()
    return f"{n}:{one}:{two}"


def dedup(
    batch: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch_id: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Deduplicate ``batch`` against itself and ``index`` and append what is new.

    Returns per row of the batch: ``id_col``, the columns of ``keep``, keep_id (the id that stays for this
    text: one of an earlier batch where the index knows the text), group_size (rows of this batch with the
    text), kept, digest.  Ids are brought to long.  ``batch_id`` names the batch; without it the name
    follows from its ids and texts, so that an equal batch counts as the same one run again.
    """
    carried = keep or []
    rows = materialize(
        batch.select(
            F.col(id_col).cast("long").alias("row_id"),
            F.monotonically_increasing_id().alias("row_no"),
            text_digest(F.col(text_col)).alias("digest"),
            *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(carried)],
        ),
        "digests",
    )
    name = batch_name(rows) if batch_id is None else batch_id
    # Partial aggregation leaves one row per digest and task, however large a group is.
    groups = materialize(
        rows.groupBy("digest").agg(
            F.max(F.struct("row_id", "row_no")).alias("last"),
            F.count(F.lit(1)).alias("group_size"),
        ),
        "digest-groups",
    )
    flat = groups.select("digest", F.col("last.row_id").alias("keep_id"), F.col("last.row_no").alias("keep_no"), "group_size")
    new = materialize(index.missing(flat, name), "digest-new")
    known = flat.drop("keep_id", "keep_no").join(index.before(name).drop("batch"), "digest").withColumn("keep_no", F.lit(-1).cast("long"))
    verdict = materialize(new.unionByName(known), "digest-verdicts")
    index.append(new, name)
    for spent in (groups, new):
        discard(spent)
    # Both sides are exchanged for this join, so a hot digest is split by the adaptive skew join.
    joined = rows.join(verdict, "digest")
    return joined.select(
        F.col("row_id").alias(id_col),
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(carried)],
        "keep_id",
        "group_size",
        (F.col("row_no") == F.col("keep_no")).alias("kept"),
        "digest",
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    index_path: str | None = None,
    batch_id: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """:func:`dedup` with an index at ``index_path``, or a new one in the shared folder."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = DigestIndex(spark, index_path or new_path(spark, "digest-index"), buckets)
    return dedup(docs, index, id_col, text_col, batch_id, keep)
