"""Exact deduplication by a stateful stream: keyed state without expiry, kept on disk by RocksDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import shared

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Parts of the arrivals table that one micro-batch takes.
FILES_PER_BATCH = 64

#: Memory that all state stores of an executor share; what is beyond it is on disk.
STATE_MEMORY_MB = 128

#: Rows of one group whose texts one key brings together for the comparison of whole texts; a larger group takes more keys.
COMPARED_TOGETHER = 256


def group_states(arrivals: DataFrame, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """One row per digest after all arrivals: digest, keep_id, n_bytes of the kept content, group_size.

    ``arrivals`` (digest, doc_id, n_bytes) is written once and streamed in micro-batches. The state of a digest never
    expires: it holds the digest, the identifier that stays and its content locator (with digest and identifier, the length
    in bytes finds the text again), and grows on disk, not on the heap.
    Each batch emits the digests that it changed; the last state of a digest is the one with the most arrivals.
    """
    spark = arrivals.sparkSession
    at, out, log = (shared.path(spark, f"exact-{x}") for x in ("arrivals", "states", "log"))
    arrivals.write.parquet(at)
    named = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space ahead of need
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",  # of all stores of an executor together
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": str(STATE_MEMORY_MB),
    }
    before = {k: spark.conf.get(k, None) for k in named}
    try:
        for k, v in named.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", files_per_batch).parquet(at)
        states = stream.groupBy("digest").agg(
            F.max(F.struct("doc_id", "n_bytes")).alias("kept"),
            F.count(F.lit(1)).alias("group_size"),
        )

        def append(batch: DataFrame, _: int) -> None:
            batch.write.mode("append").parquet(out)

        query = states.writeStream.outputMode("update").option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(append).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kept = "struct<doc_id:bigint,n_bytes:bigint>"
    changes = spark.read.schema(f"digest binary, kept {kept}, group_size bigint").parquet(out) if _has_rows(arrivals, at) else spark.createDataFrame([], f"digest binary, kept {kept}, group_size bigint")
    last = changes.groupBy("digest").agg(F.max(F.struct("group_size", "kept")).alias("s"))
    return last.select("digest", F.col("s.kept.doc_id").alias("keep_id"), F.col("s.kept.n_bytes").alias("keep_bytes"), F.col("s.group_size").alias("group_size"))


def _has_rows(arrivals: DataFrame, at: str) -> bool:
    return not arrivals.sparkSession.read.schema(arrivals.schema).parquet(at).isEmpty()


def exact_duplicates(docs: DataFrame, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts (null: empty) are equal when their bytes are; the row with the largest doc_id of a group stays. Digests find
    the hits, and each hit's whole text is compared with the kept row's; a row that only shares a digest is regrouped
    by its text. Rows that repeat a doc_id with the same text count one by one, and one of them stays. A null doc_id
    ranks below all others and never stands for a group that has another.
    Equal rows are interchangeable, so which of them is marked kept does not matter. Empty tables give no rows; other
    columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    digest = F.unhex(F.sha2(F.col("text"), 256))
    arrivals = rows.select(digest.alias("digest"), "doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    states = shared.save(group_states(arrivals, files_per_batch), "exact-last")

    repeated = states.filter("group_size > 1")
    hits = shared.save(rows.withColumn("digest", digest).join(repeated, "digest"), "exact-hits")
    shares = F.ceil(F.col("group_size") / F.lit(COMPARED_TOGETHER)).cast("long")
    located = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.octet_length("text") == F.col("keep_bytes"))
    holders = hits.filter(located).groupBy("digest", "group_size").agg(F.min("text").alias("held_text"))
    holders = holders.select("digest", "held_text", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"))
    spread = hits.select("digest", "text", F.pmod(F.xxhash64("doc_id"), shares).alias("share"))
    unequal = spread.join(holders, ["digest", "share"]).filter(F.col("text") != F.col("held_text"))
    false_hits = shared.save(unequal.select("digest").distinct(), "exact-false")

    marked = rows.select("doc_id", digest.alias("digest")).join(states, "digest")
    holder = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    same = marked.filter(holder).groupBy("digest", "doc_id", "keep_id", "group_size").agg(F.count(F.lit(1)).alias("n"))
    same = same.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("turn")).withColumn("kept", F.col("turn") == 1)
    others = marked.filter(~holder).withColumn("kept", F.lit(False))
    columns = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")]
    result = same.select("digest", *columns).unionByName(others.select("digest", *columns))
    if false_hits.isEmpty():
        return result.drop("digest")
    apart = rows.withColumn("digest", digest).join(false_hits, "digest", "left_semi")
    mates = Window.partitionBy("digest", "text")
    first = mates.orderBy(F.col("doc_id").desc_nulls_last())
    apart = apart.select(
        "doc_id",
        F.max("doc_id").over(mates).alias("keep_id"),
        F.count(F.lit(1)).over(mates).alias("group_size"),
        (F.row_number().over(first) == 1).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    return result.join(false_hits, "digest", "left_anti").drop("digest").unionByName(apart)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The kept rows are found again by doc_id and digest together, which spreads a large group; rows equal in both are
    cut to one.
    """
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    kept = exact_duplicates(docs).filter("kept").select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text_sha256")).alias("__row"))
    chosen = docs.withColumn("__row", name).join(kept, "__row", "left_semi")
    one = Window.partitionBy("__row").orderBy("__row")
    return chosen.withColumn("__turn", F.row_number().over(one)).filter("__turn = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
