"""Durable keyed state (D9, E6): versioned snapshots in buckets of keys.

A store is a folder of Parquet data and small manifests. A manifest names, for one version, the
data folder of every bucket; a reader opens one manifest and so sees one whole version. An
update rewrites the buckets of the keys that it touches, into a new folder, and then publishes a
manifest in which only these buckets changed. Publishing is a rename that fails if the version
exists, so of two writers one wins, and a writer that dies before it leaves the old version as
it was (its unreferenced folder goes with ``vacuum``). Nothing but bucket numbers and
folder names comes to the driver.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty


class StateStore:
    """Rows under a key column, all rows of a key in one bucket."""

    def __init__(self, spark: SparkSession, path: str, key: str = "user_id", n_buckets: int = 16):
        self.spark, self.path, self.key, self.n_buckets = spark, path.rstrip("/"), key, n_buckets
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop(self.path).getFileSystem(self._conf)

    def _hadoop(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        """Published versions, ascending."""
        folder = self._hadoop(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{version}.json", wholetext=True).first()["value"])

    def _publish(self, version: int, manifest: dict) -> None:
        target, draft = f"{self.path}/manifests/{version}.json", self._hadoop(f"{self.path}/drafts/{uuid.uuid4().hex}.json")
        self._fs.mkdirs(self._hadoop(f"{self.path}/manifests"))
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(self._conf).getUri(), self._conf).rename(draft, self._hadoop(target), none)

    def bucket(self):
        """Bucket of a row."""
        return F.pmod(F.xxhash64(self.key), F.lit(self.n_buckets)).cast("int")

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = Ty.StructType.fromJson(manifest["schema"])
        places = [place for b, place in manifest["buckets"].items() if buckets is None or int(b) in buckets]
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{place}" for place in places])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of one version, the last one by default."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise FileNotFoundError(f"no version {'' if version is None else version} in {self.path}")
        return self._read(self._manifest(known[-1] if version is None else version))

    def read_keys(self, keys: DataFrame) -> DataFrame | None:
        """Rows of the last version under ``keys``, read from their buckets only; None before the first version."""
        known = self.versions()
        if not known:
            return None
        keys = keys.select(self.key).distinct()
        touched = [r["b"] for r in keys.select(self.bucket().alias("b")).distinct().collect()]  # at most n_buckets
        return self._read(self._manifest(known[-1]), touched).join(keys, self.key, "left_semi")

    def update(self, rows: DataFrame, keys: DataFrame | None = None) -> int:
        """Replace all rows of ``keys`` (by default the keys of ``rows``) by ``rows``; the new version.

        ``rows`` is computed more than once: pass a stored table if that is expensive.
        """
        known = self.versions()
        before = self._manifest(known[-1]) if known else {"buckets": {}, "n_buckets": self.n_buckets, "schema": json.loads(rows.schema.json())}
        if before["n_buckets"] != self.n_buckets:
            raise ValueError(f"the store has {before['n_buckets']} buckets")
        keys = (rows if keys is None else keys).select(self.key).distinct()
        touched = sorted(r["b"] for r in keys.select(self.bucket().alias("b")).distinct().collect())  # at most n_buckets
        schema = Ty.StructType.fromJson(before["schema"])
        kept = self._read(before, touched).join(keys, self.key, "left_anti").select(*schema.fieldNames())
        place = f"data/{(known[-1] if known else 0) + 1}-{uuid.uuid4().hex}"
        fresh = kept.unionByName(rows.select(*schema.fieldNames())).withColumn("_bucket", self.bucket())
        fresh.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{place}")
        buckets = {b: p for b, p in before["buckets"].items() if int(b) not in touched}
        buckets |= {str(b): f"{place}/_bucket={b}" for b in touched if self._fs.exists(self._hadoop(f"{self.path}/{place}/_bucket={b}"))}
        version = (known[-1] if known else 0) + 1
        self._publish(version, {"version": version, "n_buckets": self.n_buckets, "schema": before["schema"], "buckets": buckets})
        return version

    def vacuum(self, keep: int = 1) -> None:
        """Remove all but the last ``keep`` versions and every data folder that these don't name."""
        known = self.versions()
        used = {place.split("/")[1] for v in known[-keep:] for place in self._manifest(v)["buckets"].values()}
        for v in known[:-keep]:
            self._fs.delete(self._hadoop(f"{self.path}/manifests/{v}.json"), False)
        folder = self._hadoop(f"{self.path}/data")
        for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if status.getPath().getName() not in used:
                self._fs.delete(status.getPath(), True)
