"""Snapshots of several tables: all tables of a version become visible in one step, and readers see one version only.

Every commit writes its tables into new folders, then one manifest that names them. Manifests are numbered; a number is taken by renaming
a finished draft to it, which the store refuses if another writer was faster. Tables are never renamed or overwritten. A manifest may
point to folders of earlier ones: that is how tables stay as they are, and how a rollback works.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another commit took the version first."""


class Rejected(ValueError):
    """Tables that do not hold what the commit says they hold."""


@dataclass(frozen=True)
class Snapshots:
    """A folder of versions."""

    spark: SparkSession
    root: str
    fmt: str = "parquet"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def versions(self) -> list[int]:
        """Numbers of all committed versions, in order."""
        p, fs = self._fs(f"{self.root}/_manifests")
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, of the newest if none is given; empty before the first."""
        if version is None:
            found = self.versions()
            if not found:
                return {"version": 0, "tables": {}}
            version = found[-1]
        p, fs = self._fs(f"{self.root}/_manifests/{version:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table of a version. A frame keeps reading the folder it began with, whatever is committed meanwhile."""
        return self.spark.read.format(self.fmt).load(self.tables(version)[table])

    def tables(self, version: int | None = None) -> dict[str, str]:
        """Table name -> folder, from one manifest, so that tables read together belong together."""
        return {n: f"{self.root}/{t['folder']}" for n, t in self.manifest(version)["tables"].items()}

    def commit(self, frames: dict[str, DataFrame], expected: dict[str, int] | None = None, checks: Callable[[dict[str, DataFrame]], None] | None = None, replace_all: bool = False, note: dict | None = None) -> int:
        """Write frames as the next version's tables and return its number; other tables stay as they are, or go with `replace_all`.

        `note` is kept in the manifest.
        Row counts are taken from what was written and compared with `expected`; `checks` sees the written tables together. A failure
        anywhere before the manifest leaves the newest version as it was; folders without a manifest are dropped by `vacuum`.
        """
        before = self.manifest()
        token, tables = uuid.uuid4().hex, {} if replace_all else dict(before["tables"])
        written = {}
        for name, df in frames.items():
            folder = f"{name}/{token}"
            df.write.format(self.fmt).save(f"{self.root}/{folder}")
            written[name] = self.spark.read.format(self.fmt).schema(df.schema).load(f"{self.root}/{folder}")
            rows = written[name].count()
            if expected and name in expected and rows != expected[name]:
                raise Rejected(f"{name}: {rows} rows instead of {expected[name]}")
            tables[name] = {"folder": folder, "rows": rows}
        if checks:
            checks(written)
        return self._put((note or {}) | {"version": before["version"] + 1, "tables": tables})

    def rollback(self, version: int) -> int:
        """A new version with the tables of an old one; nothing is copied."""
        return self._put({"version": self.manifest()["version"] + 1, "tables": self.manifest(version)["tables"], "from": version})

    def _put(self, manifest: dict) -> int:
        # The text is complete in a file of its own before the number is taken by a rename, which fails if the number is taken.
        final, fs = self._fs(f"{self.root}/_manifests/{manifest['version']:012d}.json")
        draft, _ = self._fs(f"{self.root}/_manifests/_{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"version {manifest['version']} was committed by another writer")
        return manifest["version"]

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete folders that the newest `keep` versions do not name, and older manifests. Not while a commit runs. Returns the folders."""
        found = self.versions()
        kept = {t["folder"] for v in found[-keep:] for t in self.manifest(v)["tables"].values()}
        gone = []
        root, fs = self._fs(self.root)
        for table in fs.listStatus(root):
            name = table.getPath().getName()
            if name.startswith("_"):
                continue
            for folder in fs.listStatus(table.getPath()):
                if (path := f"{name}/{folder.getPath().getName()}") not in kept:
                    fs.delete(folder.getPath(), True)
                    gone.append(path)
        for v in found[:-keep]:
            fs.delete(self._fs(f"{self.root}/_manifests/{v:012d}.json")[0], False)
        return sorted(gone)
