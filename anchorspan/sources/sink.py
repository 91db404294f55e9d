"""One file out of what many tasks write.

The tasks write sorted parts beside the target, on the target's own file system; they are joined there in order of
their number. The bytes of the parts must be the bytes that the tasks counted: where executors write to disks of their own,
the parts would be missing, and the write fails instead of losing lines.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The sides of a conversion: converted records and rejects.
SIDES = ("mapped", "unmapped")


class Target:
    """A path on whatever file system its scheme names; without a scheme on the default one."""

    def __init__(self, spark: SparkSession, path: str):
        hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
        local = hadoop.fs.FileSystem.getDefaultUri(conf).getScheme() == "file"
        if local and not path.startswith("/") and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
            path = os.path.abspath(path)
        self.hadoop, self.path = hadoop, hadoop.fs.Path(path)
        fs = self.path.getFileSystem(conf)
        self.fs = fs.getRaw() if fs.getScheme() == "file" else fs  # the raw one leaves no checksum files behind
        self.path = self.fs.makeQualified(self.path)

    def __str__(self) -> str:
        return self.path.toString()

    def parts(self, folder: str) -> list:
        """The part files of a folder below the path, in order of their number."""
        at = self.hadoop.fs.Path(self.path, folder)
        if not self.fs.exists(at):
            return []
        found = [s for s in self.fs.listStatus(at) if s.getPath().getName().startswith("part-")]
        return sorted(found, key=lambda s: (int(s.getPath().getName().split("-")[1]), s.getPath().getName()))

    def join(self, parts: Iterable) -> None:
        """Writes the path out of other files, one after the other."""
        out = self.fs.create(self.path, True)
        try:
            for part in parts:
                data = self.fs.open(part.getPath())
                try:
                    self.hadoop.io.IOUtils.copyBytes(data, out, 1 << 20, False)
                finally:
                    data.close()
        finally:
            out.close()

    def write(self, pieces: Iterable[bytes]) -> None:
        """Writes the path out of bytes in hand."""
        out = self.fs.create(self.path, True)
        try:
            for piece in pieces:
                out.write(bytearray(piece))
        finally:
            out.close()

    def delete(self) -> None:
        self.fs.delete(self.path, True)


def write_lines(rows: DataFrame, order: list[str], targets: dict[str, str], metrics: list[Column] = (), optional: str | None = None) -> dict[str, int]:
    """Writes the lines of each side, (side, order..., line), to the file of targets[side]; gives the metrics, seen in the same job.

    A side without lines makes an empty file, or none if it is ``optional``.
    """
    spark, seen = rows.sparkSession, Observation()
    size = {s: F.coalesce(F.sum(F.when(F.col("side") == s, F.octet_length("line").cast("bigint") + 1)), F.lit(0)).alias(f"bytes_{s}") for s in targets}
    ordered = rows.orderBy(*order).observe(seen, *metrics, *size.values())
    folder = Target(spark, f"{next(iter(targets.values()))}.parts-{uuid.uuid4().hex}")
    try:
        ordered.select("side", "line").write.partitionBy("side").text(str(folder))
        counted = dict(seen.get)
        for side, path in targets.items():
            parts = folder.parts(f"side={side}")
            there, meant = sum(p.getLen() for p in parts), counted.pop(f"bytes_{side}")
            if there != meant:
                raise OSError(f"{meant} bytes were written for {path}, but {there} lie in {folder}: it must be a place that all machines share")
            if parts or side != optional:
                Target(spark, path).join(parts)
    finally:
        folder.delete()
    return counted


def write_folder(rows: DataFrame, output: str, metrics: list[Column] = ()) -> dict[str, int]:
    """Writes (side, line) as a folder of parts of side=mapped and side=unmapped, in parallel and without a sort."""
    seen = Observation()
    rows.observe(seen, *metrics, F.count(F.lit(1)).alias("lines")).select("side", "line").write.mode("overwrite").partitionBy("side").text(output)
    counted = dict(seen.get)
    counted.pop("lines")
    return counted
