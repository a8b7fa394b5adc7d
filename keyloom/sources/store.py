"""Versioned snapshots of tables: data, then derived outputs, then the manifest that makes them visible."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

_MANIFEST, _FOLDER = re.compile(r"manifest-(\d+)\.json"), re.compile(r"v=(\d+)")


class SnapshotStore:
    """A folder with a directory and a manifest for each version. Readers see the greatest version whose manifest is there;
    it is put in place by a rename after all outputs are complete, and none is ever replaced, so a write that fails at any
    point leaves the last version in force. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        root = self._path(self.root)
        return [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []

    def versions(self) -> list[int]:
        """The complete versions, in ascending order."""
        return sorted(int(m[1]) for n in self._names() if (m := _MANIFEST.fullmatch(n)))

    @property
    def version(self) -> int:
        return max(self.versions(), default=0)

    def read(self, name: str = "data", version: int | None = None) -> DataFrame:
        version = self.version if version is None else version
        path = f"{self.root}/manifest-{version:012d}.json"
        outputs = json.loads(self.spark.read.text(path, wholetext=True).first()[0])["outputs"] if version in self.versions() else {}
        if name not in outputs:
            raise KeyError(f"{name} is not in version {version}")
        return self.spark.read.parquet(outputs[name])

    def publish(self, data: DataFrame, derived: Mapping[str, DataFrame] | None = None, markers: Mapping[str, DataFrame] | None = None) -> int:
        """Writes a new version: data, derived outputs, markers (versions, freshness), in this order, then its manifest."""
        version, outputs = self.version + 1, {}
        base = f"{self.root}/v={version}"
        for name, df in {"data": data, **(derived or {}), **(markers or {})}.items():
            df.write.mode("overwrite").parquet(f"{base}/{name}")  # what a failed write has left goes
            outputs[name] = f"{base}/{name}"
        draft, final = self._path(f"{self.root}/draft-{version}.json"), self._path(f"{self.root}/manifest-{version:012d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"version": version, "outputs": outputs}).encode()))
        out.close()
        if not self._fs.rename(draft, final):
            raise OSError(f"manifest of version {version} cannot be put in place")
        return version

    def drop_before(self, version: int) -> None:
        """Removes older versions, manifests first."""
        for pattern in (_MANIFEST, _FOLDER):
            for name in self._names():
                if (m := pattern.fullmatch(name)) and int(m[1]) < version:
                    self._fs.delete(self._path(f"{self.root}/{name}"), True)
