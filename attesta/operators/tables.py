"""Tables that are replaced by buckets of claims, all at once: a manifest says which files count, and a commit is one new manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class CommitConflict(RuntimeError):
    """Another writer has committed since the table was read."""


class BucketedTable:
    """Rows by the hash of ``key`` in ``buckets`` buckets below ``path``, a folder of any file system that Spark writes to.

    Readers see the files of the latest manifest. A writer puts the buckets that change into a folder of its own and then creates the
    next manifest, which no other writer can have created: that is the commit. Until then, and if a task, the job or the
    driver fails, readers see the old rows; what was written is removed, or lies unseen. A task that runs twice leaves
    one of its files, by Spark's committer.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "claim_id", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    # ---- files ---------------------------------------------------------------------------------

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")]

    def _manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "buckets": {}}
        row = self.spark.read.text(f"{self.path}/manifests/{version or known[-1]:09}.json", wholetext=True).first()
        return json.loads(row.value)

    def _publish(self, manifest: dict) -> None:
        """The commit. The name is taken by creating the file, which only one writer can."""
        fs, path = self._fs(f"manifests/{manifest['version']:09}.json")
        _, draft = self._fs(f"manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        try:
            if fs.exists(path) or not fs.rename(draft, path):
                raise CommitConflict(f"version {manifest['version']} of {self.path} is there already")
        finally:
            fs.delete(draft, False)

    # ---- rows ----------------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the latest commit, or of an earlier one."""
        manifest = self._manifest(version)
        if manifest["schema"] is None:
            raise ValueError(f"nothing was committed to {self.path} yet")
        return self._rows(manifest, range(self.buckets))

    def _rows(self, manifest: dict, buckets) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        folders = [f"{self.path}/{f}" for b in buckets for f in manifest["buckets"].get(str(b), [])]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self._bucket()).distinct().collect()]

    def _committed(self, manifest: dict, rows: DataFrame, touched: list[int], append: bool) -> int:
        folder = f"data/{uuid.uuid4().hex}"
        try:
            # Large buckets are split over tasks and small ones are put together.
            rows.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            written = {int(n.removeprefix("_bucket=")): f"{folder}/{n}" for n in self._names(folder) if n.startswith("_bucket=")}
            kept = dict(manifest["buckets"])
            for b in touched:
                kept[str(b)] = [*(kept.get(str(b), []) if append else []), *([written[b]] if b in written else [])]
            self._publish({"version": manifest["version"] + 1, "schema": manifest["schema"] or rows.schema.json(), "buckets": kept})
        except (PySparkException, CommitConflict):
            fs, path = self._fs(folder)
            fs.delete(path, True)
            raise
        return manifest["version"] + 1

    def replace(self, prepared: DataFrame, new: DataFrame) -> int:
        """Commit ``new`` in place of all rows of the ``prepared`` keys, whether or not they have new ones; the version. Only the buckets of these
        keys are read and written."""
        manifest = self._manifest()
        touched = sorted({*self._touched(prepared), *self._touched(new)})
        old = self._rows(manifest, touched).join(prepared.select(self.key).distinct(), self.key, "left_anti") if manifest["schema"] else None
        rows = new if old is None else old.select(*new.columns).unionByName(new)
        return self._committed(manifest, rows, touched, append=False)

    def insert(self, new: DataFrame, keys: list[str]) -> int:
        """Commit the rows of ``new`` whose ``keys`` (the table's key among them) the table lacks, one of each; the version."""
        if self.key not in keys:
            raise ValueError(f"{self.key} must be one of the keys")
        manifest, rows = self._manifest(), new.dropDuplicates(keys)
        touched = self._touched(new)
        if manifest["schema"]:
            rows = rows.join(self._rows(manifest, touched).select(*keys), keys, "left_anti").select(*new.columns)
        return self._committed(manifest, rows, touched, append=True)
