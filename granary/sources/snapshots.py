"""A folder of tables whose state is one manifest file, put in place by one rename.

Writers put files where no manifest names them, then commit a manifest that does; readers follow
the manifest of the highest number. So whatever step a writer has reached, a reader sees the state
before it or after it. Manifests are small JSON documents of names and counts, never of rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed the same number."""


class Snapshots:
    """Manifests 1, 2, .. of ``folder`` on any file system that Hadoop reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, *parts: object) -> str:
        return "/".join([self.folder, *map(str, parts)])

    def _at(self, path: str):
        found = self._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self._conf), found

    def numbers(self) -> list[int]:
        """Numbers of the committed manifests, ascending."""
        fs, home = self._at(self.path("_manifests"))
        names = [s.getPath().getName() for s in fs.listStatus(home)] if fs.exists(home) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def read(self, number: int | None = None) -> tuple[int, dict]:
        """The number and content of a manifest, by default of the latest; (0, {}) if there is none."""
        if number is None:
            number = max(self.numbers(), default=0)
        if not number:
            return 0, {}
        fs, path = self._at(self.path("_manifests", f"{number:08d}.json"))
        stream = fs.open(path)
        try:
            return number, json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, number: int, state: dict) -> None:
        """Make ``state`` the manifest of that number, or raise ``Conflict`` if there is one."""
        fs, draft = self._at(self.path("_manifests", f".draft-{uuid.uuid4().hex}"))
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        stream.close()
        _, final = self._at(self.path("_manifests", f"{number:08d}.json"))
        kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kinds, 1)
        options[0] = kinds.NONE  # never over a file
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(draft, final, options)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"manifest {number} exists") from e
            raise

    def folders(self, *parts: object) -> list[str]:
        """Names of the folders in a folder."""
        fs, home = self._at(self.path(*parts))
        return sorted(s.getPath().getName() for s in fs.listStatus(home) if s.isDirectory()) if fs.exists(home) else []

    def delete(self, *parts: object) -> None:
        fs, path = self._at(self.path(*parts))
        fs.delete(path, True)
