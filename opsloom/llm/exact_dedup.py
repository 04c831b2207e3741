"""Exact dedup against a persistent digest index.

The index is a table with one row per distinct text, bucketed and sorted by the digest. A batch is digested once; per
digest the batch's best row is found by a combined aggregate (copies of one text never meet in a task), the digests the
index already knows are removed by a sort-merge anti-join on the buckets, and the rest is appended. A text that the
index holds keeps its first winner for good, so later batches never change earlier decisions.

Defined results: a null text counts as empty, so all of them are copies of the empty text; of equal texts the row with
the most code points stays, then the smallest id, a null id last; rows that repeat an id are each a copy, and one of them
is kept; an empty batch appends nothing; other columns of the input are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from opsloom.llm.common import WHITE_RUN, documents, text_of
from opsloom.session import work_path, written

Q, S = {}, {}

LEAST_BUCKETS, ROWS_PER_BUCKET = 64, 2_000_000


class DigestIndex:
    """The digest table at ``path``; opening the same path again continues it. ``path`` must be shared by all executors.

    A new index gets a bucket for every ``ROWS_PER_BUCKET`` rows that are ``expected`` in all; an old one keeps its own.
    """

    def __init__(self, spark: SparkSession, path: str, expected: int = 0):
        self.spark = spark
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        buckets = max(LEAST_BUCKETS, -(-expected // ROWS_PER_BUCKET))
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, n_chars BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")
        told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {self.table}").collect()}
        self.buckets = int(told["Num Buckets"])

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, batch: DataFrame) -> DataFrame:
        """Add the new texts of a batch (``digests``); one row per digest of the batch: its keeper, its copies in the batch,
        and the batch's row that stays (null where the index had the text before)."""
        name = uuid.uuid4().hex
        best = F.max(F.struct("n_chars", F.coalesce(-F.col("doc_id"), F.lit(-(2**63))).alias("low"), "doc_id", (-F.col("row")).alias("row"))).alias("best")
        groups = written(batch.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size")), "digest-groups")
        fresh = groups.hint("merge").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        (fresh.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.n_chars").alias("n_chars"), F.lit(name).alias("batch"))
         .repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table))
        self.spark.catalog.refreshTable(self.table)
        stays = F.when(F.col("batch") == name, -F.col("best.row")).alias("stays")
        return groups.join(self.rows().select("digest", "keep_id", "batch"), "digest").select("digest", "keep_id", "group_size", stays)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, a number of the row (once it is stored), hash and code points of the text, and SHA-256 of it without white space."""
    text = text_of()
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("row_hash"), F.char_length(text).cast("bigint").alias("n_chars"),
                       F.unhex(F.sha2(F.regexp_replace(text, WHITE_RUN, ""), 256)).alias("digest"))


def exact_dedup(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per document: ``keep_id``, ``group_size`` (copies in this batch), ``kept`` and the digest.

    The rows go back to their groups by a plain join on the digest with both sides shuffled, so that Spark can split a
    group that holds a large part of all rows.
    """
    batch = written(digests(docs), "digests")
    groups = written(index.append(batch), "digest-keepers")
    out = batch.join(groups, "digest")
    return out.select("doc_id", "keep_id", "group_size", F.col("row").eqNullSafe(F.col("stays")).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"), "row_hash")


def op4_exact_dedup(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return exact_dedup(docs, DigestIndex(spark, work_path(spark, "digest-index"), docs.count())).drop("row_hash")


Q["op4_exact_dedup"] = op4_exact_dedup
S["op4_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS c FROM d)
SELECT doc_id, keep_id, c AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k"""
