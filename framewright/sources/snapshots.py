"""Versioned snapshots of a table as parquet folders with a log of manifests.

A version exists from the moment its manifest does. Data goes to a folder of its own first; then the writer claims the next free number by
putting the finished manifest there only if no other has, and tries the next number when it lost. So two writers get two versions, a
failed one leaves none, and a reader sees whole versions only: what it opened stays, whoever writes meanwhile.

The claim is a hard link on a local or mounted file system and a rename that refuses to replace elsewhere, which is atomic on HDFS
and on stores with atomic rename; on a plain object store use its conditional-write committer.
"""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

LOG = "version long, parent long, rows long, columns long, score double, step string"
MANIFEST = f"{LOG}, data string"


class Snapshots:
    """Versions of one table below ``root`` (a folder every executor can reach)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _manifests(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).json(f"{self.root}/log")

    def log(self) -> DataFrame:
        """One row per version."""
        return self._manifests().drop("data")

    def latest(self) -> int:
        """The newest version, 0 when none was written."""
        try:
            return self.log().agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]
        except Exception as error:  # the folder does not exist before the first version
            if "PATH_NOT_FOUND" in str(error):
                return 0
            raise

    def _claim(self, version: int, manifest: str) -> bool:
        """Put the manifest in place unless that version is taken."""
        name, draft = f"{self.root}/log/{version:012d}.json", f"{self.root}/drafts/{uuid.uuid4().hex}"
        if name.startswith(("file:", "/")):
            return self._claim_by_link(*(re.sub(r"^file:/+", "/", x) for x in (draft, name)), manifest)
        return self._claim_by_rename(draft, name, manifest)

    def _claim_by_link(self, draft: str, name: str, manifest: str) -> bool:
        for path in (draft, name):
            os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(draft, "w", encoding="utf-8") as f:
            f.write(manifest)
        try:
            os.link(draft, name)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)

    def _claim_by_rename(self, draft: str, name: str, manifest: str) -> bool:
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        place, target = hadoop.Path(draft), hadoop.Path(name)
        store = place.getFileSystem(conf)
        store.mkdirs(target.getParent())
        out = store.create(place, False)
        out.write(bytearray(manifest.encode()))
        out.close()
        try:  # without the option to overwrite
            options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
            hadoop.FileContext.getFileContext(target.toUri(), conf).rename(place, target, options)
            return True
        except Exception as error:
            store.delete(place, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise

    def write(self, df: DataFrame, step: str, score: float | None = None, parent: int | None = None) -> int:
        """Write the next version; data first, so a failed write leaves no version."""
        base = self.latest()
        data = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{data}")
        rows = self.spark.read.parquet(f"{self.root}/{data}").count()
        version = base + 1
        while True:
            entry = {"version": version, "parent": parent if parent is not None else base, "rows": rows, "columns": len(df.columns),
                     "score": score, "step": step, "data": data}
            if self._claim(version, json.dumps({k: v for k, v in entry.items() if v is not None}) + "\n"):
                return version
            version = max(version, self.latest()) + 1

    def read(self, version: int) -> DataFrame:
        """The rows of a version."""
        found = self._manifests().where(F.col("version") == version).select("data").first() if self.latest() >= version else None
        if found is None:
            raise ValueError(f"no version {version} below {self.root}")
        return self.spark.read.parquet(f"{self.root}/{found['data']}")

    def restore(self, version: int) -> int:
        """Make an old version the newest one."""
        return self.write(self.read(version), f"restored version {version}", parent=version)
