"""Tables in hash buckets, replaced bucket by bucket under numbered versions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_dir
from .tables import id_options

#: Versions whose files stay for readers and writers that started from them.
KEPT_VERSIONS = 8


@dataclass(frozen=True)
class Version:
    """What a table holds: the folder of every filled bucket, and ``facts`` of the writer."""

    number: int = 0
    buckets: int = 0
    folders: dict[int, str] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)


class BucketTable:
    """Rows below ``root`` by the hash of their keys, in at most ``buckets`` folders.

    A writer reads the buckets that its keys fall into (``touched``), writes them anew into a
    folder of its own (``stage``) and commits: one small file per version says which folder
    holds which bucket. It is created under its final name or not at all, so of two writers
    that started from one version the second is told, and joins again. Buckets that nobody
    touched keep their files. What a version replaced goes ``KEPT_VERSIONS`` versions later.

    The number of buckets is fixed by the first version. Files are sorted by ``order``, if
    given, with Bloom filters on it, so a few values of it read few pages.
    """

    def __init__(
        self, spark: SparkSession, root: str, schema: str, keys: Sequence[str], buckets: int = 32,
        order: str | None = None,
    ):
        self.spark, self.root, self.schema, self.keys = spark, root.rstrip("/"), schema, [*keys]
        self.buckets, self.order = buckets, order

    def _path(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _load(self, number: int) -> Version | None:
        place, fs = self._path(f"commits/{number}")
        if not fs.exists(place):
            return None
        stream = fs.open(place)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        held = json.loads(text)
        return Version(number, held["buckets"], {int(b): f for b, f in held["folders"].items()},
                       held["facts"])

    def newest(self) -> Version:
        place, fs = self._path("commits")
        numbers = [int(n) for n in (s.getPath().getName() for s in fs.listStatus(place))
                   if n.isdigit()] if fs.exists(place) else []
        return self._load(max(numbers)) if numbers else Version(0, self.buckets)

    def bucket(self, version: Version) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(version.buckets)).cast("int")

    def touched(self, version: Version, rows: DataFrame) -> list[int]:
        """The buckets that the keys of ``rows`` fall into: at most the number of buckets."""
        found = rows.select(self.bucket(version).alias("bucket")).distinct().collect()
        return sorted(r.bucket for r in found)

    def read(self, version: Version | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        held = version or self.newest()
        chosen = held.folders if buckets is None else held.folders.keys() & set(buckets)
        paths = [f"{self.root}/rows/{held.folders[b]}/bucket={b}" for b in sorted(chosen)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def stage(self, version: Version, rows: DataFrame) -> str:
        """Write ``rows`` by bucket into a folder that no version names yet.

        Large buckets are split over tasks, small ones share one.
        """
        folder = uuid.uuid4().hex
        placed = rows.withColumn("bucket", self.bucket(version)).hint("rebalance", "bucket")
        if self.order:
            placed = placed.sortWithinPartitions("bucket", self.order)
        placed.write.partitionBy("bucket").options(
            **(id_options(self.order) if self.order else {})).parquet(f"{self.root}/rows/{folder}")
        return folder

    def staged(self, folder: str, schema: str | None = None) -> DataFrame:
        return self.spark.read.schema(schema or self.schema).parquet(f"{self.root}/rows/{folder}")

    def discard(self, folder: str) -> None:
        remove_dir(self.spark, f"{self.root}/rows/{folder}")

    def commit(
        self, base: Version, folder: str | None, touched: Iterable[int], facts: dict | None = None,
    ) -> bool:
        """Make ``folder`` the content of the ``touched`` buckets on top of ``base``.

        False if another writer committed since ``base`` was read; nothing has changed then.
        """
        filled = set()
        if folder is not None:
            place, fs = self._path(f"rows/{folder}")
            filled = {int(n.removeprefix("bucket=")) for n in (
                s.getPath().getName() for s in fs.listStatus(place)) if n.startswith("bucket=")}
        folders = {b: f for b, f in base.folders.items() if b not in set(touched)}
        folders |= {b: folder for b in filled}
        text = json.dumps({
            "buckets": base.buckets, "folders": folders, "facts": facts or base.facts})
        number = base.number + 1
        if not self._create(f"commits/{number}", text):
            return False
        self._forget(number - KEPT_VERSIONS)
        return True

    def _create(self, name: str, text: str) -> bool:
        """A file with ``text`` that appears whole or, if the name is taken, not at all."""
        draft, fs = self._path(f"commits/_{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        never_replace = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            hadoop.FileContext.getFileContext(
                fs.getUri(), self.spark._jsc.hadoopConfiguration(),
            ).rename(draft, self._path(name)[0], never_replace)
        except Py4JJavaError as error:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def _forget(self, number: int) -> None:
        """Remove the folders that the version after ``number`` replaced."""
        old = self._load(number) if number > 0 else None
        after = self._load(number + 1) if old else None
        if after:
            for bucket, folder in old.folders.items():
                if after.folders.get(bucket) != folder:
                    remove_dir(self.spark, f"{self.root}/rows/{folder}/bucket={bucket}")
