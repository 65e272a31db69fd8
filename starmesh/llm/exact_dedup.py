"""Exact deduplication by stateful streaming over a keyed, disk-backed state.

The stream carries one slim row per document: digest, length, identifier and content locator.
A streaming aggregation keeps one state per digest in RocksDB, without watermark and so without
expiry: how many rows had it, and the identifier and locator of the row that stays. Equal rows
are combined before the shuffle, so a group that holds a third of all rows costs each task one
row. Texts are not in the state. For digests that were hit more than once, the full normalised
texts are read again and compared; should texts differ under one digest, they are regrouped by
their bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, free_name, semi, shared_dir, stored

#: Settings of the state's store while the stream runs. Without fallocate a store takes the disk
#: that its rows need, not some megabytes more in each of many partitions.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


#: Locators of dropped rows that may be broadcast, once they have been counted.
LOCATORS = 200_000


def locator() -> Column:
    """Where a row's content lies: its file and its row in it."""
    return F.concat_ws("#", "_metadata.file_path", F.col("_metadata.row_index").cast("string"))


def located(df: DataFrame) -> bool:
    """True if df reads files directly, so that its rows have locators."""
    try:
        return "_metadata" not in df.columns and len(df.select(locator()).schema) == 1
    except AnalysisException:
        return False


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _order() -> Column:
    """Of equal texts the greatest stays: most code points, an id before none, the smallest id."""
    size = F.length(F.coalesce("text", F.lit(""))).cast("long")
    return F.struct(size.alias("n_cp"), F.col("doc_id").isNotNull().alias("has_id"), F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("long"))).alias("not_id"), F.col("locator"))


def keyed_state(base: str, schema, spark) -> DataFrame:
    """Runs the stream over the rows in base/rows to its end and returns the state:
    digest, best (the row that stays), group_size.

    Every micro-batch writes the states that it changed to a folder of its own number, which a
    repeated batch overwrites; the last number holds for each digest. A later run on the same
    base goes on from the state's checkpoint and reads only rows that are new.
    """
    out, log = f"{base}/state", f"{base}/log"
    old = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/rows")
        state = stream.groupBy("digest").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("group_size"))

        def keep(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/n={number}")

        query = state.writeStream.outputMode("update").option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kind = state.schema.add("batch", "long")
    changed = spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(out)
    return changed.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("s")).select("digest", "s.*")


def _earlier(spark, hits: DataFrame, seen: DataFrame, text_col: str) -> DataFrame | None:
    """(digest, norm) of the rows that earlier runs kept for these digests, read anew through
    their locators; None if there are none."""
    place = stored(seen.join(hits, "digest", "left_semi").select("digest", F.col("best.locator").alias("locator")), "dedup-places")
    files = [r[0] for r in place.select(F.substring_index("locator", "#", 1)).distinct().collect()]  # input files, not rows
    if not files:
        return None
    rows = spark.read.parquet(*files)
    return rows.select(normalised(F.col(text_col)).alias("norm"), locator().alias("locator")).join(place, "locator").select("digest", "norm")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] | None = None, state_dir: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, locator.

    Texts are equal when identical after deleting white space. Of equal texts the row with the
    most code points stays, then the one with the smallest id. Null text counts as empty. Of
    rows that repeat id and text, exactly one is kept (the one with the greater locator); a null
    id comes after all others. An empty table gives an empty result. Other columns are ignored,
    whatever their names. digest can replace SHA-256 as the state's key, for tests.

    With state_dir, a folder that outlives the run, documents that arrive later are compared with
    all that came before: each call takes only new documents, and tells for them which row of all
    stays so far, and how many were equal. Earlier files must still be there: texts of digests
    that are hit again are read from them.
    """
    if not located(docs):
        docs = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "dedup-docs")
        id_col, text_col = "doc_id", "text"
    return _dedup(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), locator().alias("locator")), digest, state_dir, text_col)


def _dedup(source: DataFrame, digest: Callable[[Column], Column] | None = None, state_dir: str | None = None, text_col: str = "text") -> DataFrame:
    spark = source.sparkSession
    digest = digest or (lambda norm: F.unhex(F.sha2(norm, 256)))
    norm = normalised(F.col("text"))
    base = state_dir.rstrip("/") if state_dir else shared_dir(spark, "dedup")
    slim = source.select("doc_id", _order().alias("best"), digest(norm).alias("digest"), F.unhex(F.sha2(norm, 256)).alias("sha"))
    rows_dir = f"{base}/rows/{uuid.uuid4().hex}"
    slim.write.parquet(rows_dir)
    rows = spark.read.schema(slim.schema).parquet(rows_dir).withColumnRenamed("best", "own")
    before = None
    if state_dir and (stood := _standing(spark, base)) is not None:
        before = stored(stood, "dedup-before")
    state = stored(keyed_state(base, slim.schema, spark), "dedup-keys")

    hits = stored(state.where("group_size > 1").join(rows.select("digest"), "digest", "left_semi").select("digest"), "dedup-hits") if state_dir else state.where("group_size > 1").select("digest")
    texts = semi(source.select(norm.alias("norm")).withColumn("digest", digest(F.col("norm"))), hits, "digest").select("digest", "norm")
    older = _earlier(spark, hits, before, text_col) if before is not None else None
    texts = texts if older is None else texts.unionByName(older)
    # The least and the greatest text of a digest, combined before the shuffle: equal if all are.
    differ = texts.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).where("lo != hi").select("digest")
    differ = stored(differ, "dedup-differ")
    if differ.isEmpty():
        joined = rows.join(state, "digest")
    else:
        whole = rows.join(differ, "digest", "left_anti").join(state, "digest")
        # Different texts under one digest: grouped by their bytes, among the documents of this run.
        apart = semi(source.withColumn("norm", norm).withColumn("digest", digest(F.col("norm"))), differ, "digest")
        apart = apart.select("doc_id", _order().alias("own"), "digest", F.unhex(F.sha2("norm", 256)).alias("sha"), "norm")
        groups = apart.groupBy("norm").agg(F.max("own").alias("best"), F.count(F.lit(1)).alias("group_size"))
        joined = whole.unionByName(apart.join(groups, "norm").drop("norm"))
    keep = F.when(F.col("best.has_id"), F.bitwise_not(F.col("best.not_id")))
    return joined.select("doc_id", keep.alias("keep_id"), "group_size", (F.col("own.locator") == F.col("best.locator")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), F.col("own.locator").alias("locator"))


def _standing(spark, base: str) -> DataFrame | None:
    """(digest, best) as earlier runs on base left them; None before the first."""
    try:
        changed = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/state")
    except AnalysisException:
        return None
    return changed.groupBy("digest").agg(F.max_by("best", "batch").alias("best"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with their columns; one of each group, ties and
    repeated rows included. Any columns and names may be there; what is not read from files is
    stored first. Null and empty texts are equal; an empty table stays empty."""
    place = free_name(docs, "__place")
    if located(docs):
        rows = docs.withColumn(place, locator())
    else:
        rows = stored(docs.withColumn(place, F.monotonically_increasing_id().cast("string")), "dedup-docs")
    source = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(place).alias("locator"))
    gone = stored(_dedup(source).where("not kept").select(F.col("locator").alias(place)), "dedup-gone")
    if gone.limit(LOCATORS + 1).count() <= LOCATORS:
        gone = F.broadcast(gone)
    return rows.join(gone, place, "left_anti").select(*docs.columns)
