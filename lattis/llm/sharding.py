"""Size-tiered compaction of immutable shards with a versioned manifest (DataFrame functions only).

Layout under a root folder in the shared store: ``shards/<name>/`` holds the Parquet files of one shard, written once under a name
that no other writer can have; ``manifests/v<number>.json`` lists the shards of one version. A manifest is written under a temporary
name and published only if its version doesn't exist yet: a hard link on a local or mounted file system, a rename without overwrite
elsewhere (atomic on HDFS; a store without either needs a conditional put here). So each version has one writer. A writer that loses
reads the new manifest and commits the same shard again, so no arrival is lost, written twice or replaced. Readers take the newest
manifest, so they never see half a shard; files that no manifest lists are ignored.

``append`` adds each arrival as one small shard. ``compact`` looks for ``fanout`` shards in one size tier (powers of
``fanout`` over the smallest tier) and merges them, without a shuffle, into files of about ``target`` bytes; that repeats
until every tier is small. Replaced shards stay for readers of older versions; ``vacuum`` deletes those that were replaced, or
written and never committed, over ``retain`` seconds ago.

Defined results: an empty arrival adds an empty shard; an empty store reads as no rows of the given schema; rows, nulls,
repeated rows, ties, texts of any length and all columns, whatever their names, come back as they were.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import scratch, table


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, schema: StructType, target: int = 32 << 20, smallest: int = 1 << 20, fanout: int = 4, retain: float = 3600.0):
        self.spark, self.root, self.schema, self.retain = spark, root, schema, retain
        self.target, self.smallest, self.fanout = target, smallest, fanout
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _ls(self, folder: str) -> list[tuple[str, int]]:
        p = self._path(f"{self.root}/{folder}")
        return [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def version(self) -> int:
        return max((int(n[1:-5]) for n, _ in self._ls("manifests") if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """The shards of a version, the newest unless one is named."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "shards": [], "retired": []}
        f = self._fs.open(self._path(f"{self.root}/manifests/v{version:08d}.json"))
        try:
            return json.loads(bytes(f.readAllBytes()).decode())
        finally:
            f.close()

    def _publish(self, temp, final) -> bool:
        """Gives a written file its final name unless that is taken."""
        if (final.toUri().getScheme() or "file") == "file":
            try:
                os.link(*(unquote(p.toUri().getPath()) for p in (temp, final)))
            except FileExistsError:
                return False
            finally:
                self._fs.delete(temp, False)
            return True
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf)
        try:
            context.rename(temp, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            self._fs.delete(temp, False)
            return False
        return True

    def _commit(self, old: dict, shards: list[dict], retired: list[dict] | None = None) -> bool:
        """True if this version is now old's successor; False if another writer was first."""
        new = {"version": old["version"] + 1, "shards": shards, "retired": old["retired"] if retired is None else retired}
        temp = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}.tmp")
        f = self._fs.create(temp, False)
        f.write(bytearray(json.dumps(new, sort_keys=True).encode()))
        f.close()
        return self._publish(temp, self._path(f"{self.root}/manifests/v{new['version']:08d}.json"))

    def _write(self, df: DataFrame, kind: str) -> dict:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{self.root}/shards/{name}")
        files = [n for f, n in self._ls(f"shards/{name}") if f.endswith(".parquet")]
        return {"name": name, "bytes": sum(files), "files": len(files)}

    def tier(self, size: int) -> int:
        t = 0
        while size > self.smallest:
            size, t = size // self.fanout, t + 1
        return t

    def append(self, df: DataFrame) -> dict:
        """One arrival becomes one shard and one version."""
        shard = self._write(df.select(*(F.col(f"`{c.replace('`', '``')}`") for c in self.schema.names)), "a")
        while True:
            old = self.manifest()
            shard["arrivals"] = [1 + max((a for s in old["shards"] for a in s["arrivals"]), default=0)]
            if self._commit(old, [*old["shards"], shard]):
                return shard

    def plan(self, shards: list[dict]) -> list[dict]:
        """The shards to merge next: the smallest tier that holds fanout of them."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        return next((sorted(tiers[t], key=lambda s: s["arrivals"]) for t in sorted(tiers) if len(tiers[t]) >= self.fanout), [])

    def _read(self, shards: list[dict]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/shards/{s['name']}" for s in shards))

    def compact(self) -> int:
        """Merges until no tier is full; the number of merges."""
        merges = 0
        while group := self.plan(self.manifest()["shards"]):
            size, names = sum(s["bytes"] for s in group), {s["name"] for s in group}
            merged = self._write(self._read(group).coalesce(max(1, -(-size // self.target))), "m")
            merged["arrivals"] = sorted(a for s in group for a in s["arrivals"])
            old = self.manifest()
            while names <= {s["name"] for s in old["shards"]}:
                gone = [*old["retired"], *({"name": n, "at": time.time()} for n in sorted(names))]
                if self._commit(old, [*(s for s in old["shards"] if s["name"] not in names), merged], gone):
                    merges += 1
                    break
                old = self.manifest()
            else:  # another writer merged one of them first
                self._fs.delete(self._path(f"{self.root}/shards/{merged['name']}"), True)
        return merges

    def vacuum(self) -> int:
        """Deletes shards that were replaced, or written and never committed, over ``retain`` seconds ago; the number of them. Versions
        that list them can't be read any more."""
        before, old = time.time() - self.retain, self.manifest()
        live = {s["name"] for s in old["shards"]} | {r["name"] for r in old["retired"] if r["at"] > before}
        while not self._commit(old, old["shards"], [r for r in old["retired"] if r["name"] in live]):
            old = self.manifest()
            live |= {s["name"] for s in old["shards"]}
        root = self._path(f"{self.root}/shards")
        # a shard is listed only after its files are written, so a young folder may be an append that isn't committed yet
        gone = [s.getPath() for s in (self._fs.listStatus(root) if self._fs.exists(root) else []) if s.getPath().getName() not in live and s.getModificationTime() < before * 1000]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)

    def read(self, version: int | None = None) -> DataFrame:
        shards = self.manifest(version)["shards"]
        return self._read(shards) if shards else self.spark.createDataFrame([], self.schema)


ARRIVALS = 9


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, arriving in ranges of doc_id, appended and compacted; then every row as the newest version has it."""
    docs = table(spark, sf_dir, "documents")
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    store = ShardStore(spark, scratch(spark), docs.schema)
    cuts = [(lo or 0) + ((hi or 0) + 1 - (lo or 0)) * i // ARRIVALS for i in range(ARRIVALS + 1)]
    for i in range(ARRIVALS):
        mine = (F.col("doc_id") >= cuts[i]) & (F.col("doc_id") < cuts[i + 1])
        store.append(docs.where(mine | F.col("doc_id").isNull() if i == 0 else mine))
        store.compact()
    return store.read().selectExpr("doc_id", "lang", "source", "n_chars", "bigint(octet_length(coalesce(text, ''))) as text_bytes", "sha2(coalesce(text, ''), 256) as text_sha256")


ORACLE = "SELECT doc_id, lang, source, n_chars, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS text_bytes, sha256(coalesce(text, '')) AS text_sha256 FROM documents"
