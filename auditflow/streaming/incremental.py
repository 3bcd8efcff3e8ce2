"""Incremental analysis: only files whose content or configuration changed are analysed anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import content_hash


def decisions(files: DataFrame, cache: DataFrame, config: str) -> DataFrame:
    """files (path, content) with hash and miss: why the cache (path, hash, config) cannot serve.

    miss is null for a hit; else new-file, content-changed or config-changed.
    """
    c = cache.select(F.col("path").alias("_p"), F.col("hash").alias("_h"), F.col("config").alias("_c"))
    j = files.withColumn("hash", content_hash(F.col("content"))).join(c, F.col("path") == F.col("_p"), "left")
    why = F.when(F.col("_p").isNull(), "new-file").when(~F.col("_h").eqNullSafe(F.col("hash")), "content-changed").when(F.col("_c") != config, "config-changed")
    return j.withColumn("miss", why).drop("_p", "_h", "_c")


def removed(files: DataFrame, cache: DataFrame) -> DataFrame:
    return cache.select("path").join(files.select("path"), "path", "left_anti")


def refreshed(cache: DataFrame, analysed: DataFrame, gone: DataFrame) -> DataFrame:
    """The cache with analysed rows in place of their paths' old ones, and without gone paths."""
    out = cache.join(analysed.select("path").distinct(), "path", "left_anti").join(gone.select("path"), "path", "left_anti")
    return out.select(*cache.columns).unionByName(analysed.select(*cache.columns))


def follow(stream: DataFrame, analyse: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Analyse a stream of changed files (path, content, ...) batch by batch into Parquet.

    Each batch is written under its own id, so a batch that is run again replaces what it wrote.
    """

    def batch(df: DataFrame, n: int) -> None:
        analyse(df).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Fixed value: entries that a store of parsed facts keeps.
STORE_CAP = 16_384


def cache_misses(files: DataFrame, roles: DataFrame, findings: DataFrame, config: str) -> DataFrame:
    """files (path, hash) with miss: null where both caches (path, hash; findings with config) can serve."""
    r = roles.select(F.col("path").alias("_rp"), F.col("hash").alias("_rh"))
    f = findings.select(F.col("path").alias("_fp"), F.col("hash").alias("_fh"), F.col("config").alias("_fc"))
    j = files.join(r, F.col("path") == F.col("_rp"), "left").join(f, F.col("path") == F.col("_fp"), "left")
    no_r, no_f, h = F.col("_rp").isNull(), F.col("_fp").isNull(), F.col("hash")
    why = F.when(no_r & no_f, "missing-cache-entry").when(no_r, "missing-file-role-cache").when(no_f, "missing-findings-cache").when(~(F.col("_rh").eqNullSafe(h) & F.col("_fh").eqNullSafe(h)), "content-changed").when(F.col("_fc") != config, "config-changed")
    return j.withColumn("miss", why).select(*files.columns, "miss")


def stored(store: DataFrame, analysed: DataFrame, cap: int = STORE_CAP) -> DataFrame:
    """A store of facts by (hash, language) with newly analysed ones: the latest used, up to cap entries.

    Both have hash, language, used (a number that grows) and facts.
    """
    row = F.struct(*store.columns)
    newest = store.unionByName(analysed.select(*store.columns)).groupBy("hash", "language").agg(F.max_by(row, "used").alias("r")).select("r.*")
    return newest.orderBy(F.desc("used"), "hash", "language").limit(cap)


def to_analyse(files: DataFrame, store: DataFrame) -> DataFrame:
    """files (path, hash, language) whose content the store does not know."""
    return files.join(store.select("hash", "language"), ["hash", "language"], "left_anti")


def workspace_revision(files: DataFrame, config: str) -> DataFrame:
    """One row (revision, files): an identity of paths, contents and configuration, in any order of rows."""
    each = F.sha2(F.concat_ws("\n", "path", "hash"), 256)
    part = lambda i: F.sum(F.conv(F.substring(each, 15 * i + 1, 15), 16, 10).cast("decimal(20,0)"))
    n = files.agg(F.count(F.lit(1)).alias("files"), *(part(i).alias(f"p{i}") for i in range(4)))
    return n.select(F.sha2(F.concat_ws(":", F.lit(config), "files", *(F.coalesce(f"p{i}", F.lit(0)) for i in range(4))), 256).alias("revision"), "files")
