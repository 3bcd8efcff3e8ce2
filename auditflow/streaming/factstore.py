"""A store of facts by content: what was analysed once is not analysed again.

Facts lie in buckets by the hash of the content, appended run by run; which keys a run used lies
beside them, keys alone.  A manifest names the runs that count, and is replaced in one rename, so a
reader sees a state as a whole and a run that fails leaves the one before.  Content that several
files share is analysed once.  When there are more keys than the cap, the oldest by last use go: one
count by run finds the run from which on keys stay, and facts are written anew without the others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import content_hash

KEYS = ("hash", "language")
#: Buckets of facts, and keys that a store keeps at most.
BUCKETS, CAP = 64, 16_384


class FactStore:
    """Facts below a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str, cap: int = CAP):
        self.spark, self.root, self.cap = spark, root.rstrip("/"), cap
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The runs that count: number of the last one, facts and uses by run, the cap's first run."""
        if not self._fs.exists(self._path(f"{self.root}/manifest")):
            return {"run": 0, "facts": [], "uses": [], "since": 0}
        return json.loads(self.spark.read.text(f"{self.root}/manifest", wholetext=True).first().value)

    def _swap(self, manifest: dict) -> None:
        """The new manifest in place of the old one."""
        stream = self._fs.create(self._path(f"{self.root}/manifest.part"), True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        old, new = self._path(f"{self.root}/manifest"), self._path(f"{self.root}/manifest.part")
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._path(self._fs.makeQualified(new).toString()), self._path(self._fs.makeQualified(old).toString()), overwrite)

    def _read(self, names: list[str]) -> DataFrame | None:
        if not names:
            return None
        kind = names[0].split("/")[0]
        return self.spark.read.option("basePath", f"{self.root}/{kind}").parquet(*(f"{self.root}/{n}" for n in names)).drop("at")

    def uses(self) -> DataFrame | None:
        """(hash, language, used): the run that used each key last."""
        every = self._read(self.manifest()["uses"])
        return None if every is None else every.groupBy(*KEYS).agg(F.max("used").alias("used"))

    def facts(self) -> DataFrame | None:
        """The facts of all keys that the store keeps, with their key and bucket."""
        m = self.manifest()
        return self._read(m["facts"])

    def run(self, files: DataFrame, analyse: Callable[[DataFrame], DataFrame]) -> dict:
        """Bring the store up to the files (path, language, content); counts of keys and of misses.

        analyse: from (hash, language, content) to rows with hash, language and facts, any number a key.
        Files without content have no facts.
        """
        m = self.manifest()
        n = m["run"] + 1
        keyed = files.filter("content IS NOT NULL").select(content_hash(F.col("content")).alias("hash"), F.coalesce("language", F.lit("")).alias("language"), "content")
        keys = keyed.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("files")).select(*KEYS)
        uses = f"uses/at={n}-{uuid.uuid4().hex}"
        keys.withColumn("used", F.lit(n)).write.parquet(f"{self.root}/{uses}")
        used = self._read([uses])
        known = self._read(m["uses"])
        miss = used.select(*KEYS) if known is None else used.select(*KEYS).join(known.filter(F.col("used") >= m["since"]).select(*KEYS), list(KEYS), "left_anti")
        one = keyed.join(miss, list(KEYS), "left_semi").groupBy(*KEYS).agg(F.any_value("content").alias("content"))
        found = f"facts/at={n}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64("hash"), F.lit(BUCKETS)).cast("int")
        analyse(one).withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{found}")
        counts = {"keys": used.count(), "misses": miss.count()}
        new = {"run": n, "facts": [*m["facts"], found] if counts["misses"] else m["facts"], "uses": [*m["uses"], uses], "since": m["since"]}
        self._swap(self._capped(new))
        return counts | {"dropped": 0 if new["since"] == self.manifest()["since"] else 1}

    def _capped(self, m: dict) -> dict:
        """The manifest after keys beyond the cap have gone; runs whose keys all came again are folded."""
        last = self._read(m["uses"]).groupBy(*KEYS).agg(F.max("used").alias("used"))
        by_run = {r.used: r.n for r in last.groupBy("used").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a run
        kept, since = 0, m["run"]
        for run in sorted(by_run, reverse=True):
            if kept + by_run[run] > self.cap and run != m["run"]:
                break
            kept, since = kept + by_run[run], run
        if sum(by_run.values()) <= self.cap or all(run >= since for run in by_run):
            return m
        stay = last.filter(F.col("used") >= since)
        uses, facts = f"uses/at={m['run']}-{uuid.uuid4().hex}", f"facts/at={m['run']}-{uuid.uuid4().hex}"
        stay.write.parquet(f"{self.root}/{uses}")
        whole = self._read(m["facts"])
        if whole is not None:
            whole.join(stay.select(*KEYS), list(KEYS), "left_semi").repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{facts}")
        return {"run": m["run"], "facts": [facts] if whole is not None else [], "uses": [uses], "since": since}

    def of(self, files: DataFrame) -> DataFrame:
        """(path, facts...) of files (path, language, content), from the store alone."""
        keyed = files.select("path", content_hash(F.col("content")).alias("hash"), F.coalesce("language", F.lit("")).alias("language"))
        return keyed.join(self.facts().drop("bucket"), list(KEYS)).drop(*KEYS)
