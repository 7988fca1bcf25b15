"""A table with one row per key that is changed bucket by bucket.

Rows lie in buckets by a hash of their key. A merge rewrites only the buckets it touches, into new
files; a version is a small file that lists the files of every bucket and the batches in them. It
appears by one rename, so a reader sees the old or the new version, a merge that stops halfway
leaves the old one, and a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import upsert

#: Batches a version remembers; a stream repeats its last one only.
REMEMBERED = 100


class KeyedTable:
    """``schema`` of the rows, ``keys`` among its columns, ``buckets`` the rows are dealt over.

    ``path`` is a folder that driver and executors share. One writer at a time: of two, the one
    whose version comes second gets an error and changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    # -- versions --

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _versions(self) -> list[int]:
        fs, at = self._fs(f"{self.path}/versions/v*.json")
        return sorted(int(f.getPath().getName()[1:-5]) for f in fs.globStatus(at) or [])

    def version(self, number: int | None = None) -> dict:
        """A version by number, else the newest: number, batches, files by bucket."""
        known = self._versions()
        if not known:
            return {"number": 0, "batches": [], "files": {}}
        fs, at = self._fs(f"{self.path}/versions/v{number or known[-1]}.json")
        stream = fs.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: dict) -> None:
        """Write beside, then rename: a version is there as a whole or not at all."""
        fs, draft = self._fs(f"{self.path}/versions/.{uuid.uuid4()}")
        out = fs.create(draft, False)
        try:
            out.write(json.dumps(version).encode())
        finally:
            out.close()
        _, final = self._fs(f"{self.path}/versions/v{version['number']}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"version {version['number']} of {self.path} was written by another writer")

    # -- rows --

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, files: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of one version, the newest unless told otherwise."""
        return self._rows([f for files in self.version(number)["files"].values() for f in files])

    def merge(self, rows: DataFrame, version: str | None = None, batch: int | None = None, gone: str | None = None) -> dict:
        """Put ``rows`` over the table by key and return the version that holds them.

        Of several rows of a key that with the greatest ``version`` column wins. Rows whose column
        ``gone`` is true remove their key. A ``batch`` number that the table has is skipped.
        """
        old = self.version()
        if batch is not None and batch in old["batches"]:
            return old
        folder = f"{self.path}/data/{uuid.uuid4()}"
        extra = [c for c in (version, gone) if c is not None]
        marks = [F.col(c).alias(f"_x{i}") for i, c in enumerate(extra)]
        news = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema if f.name in rows.columns], *marks)
        # The news are read twice, so they are kept as a file too, dealt by bucket.
        staged = f"{folder}-news"
        news.withColumn("_bucket", self._bucket()).write.parquet(staged)
        news = self.spark.read.parquet(staged)
        touched = [r._bucket for r in news.select("_bucket").distinct().collect()]
        before = self._rows([f for b in touched for f in old["files"].get(str(b), [])])
        if gone is not None:
            before = before.withColumn("_gone", F.lit(False))
            news = news.withColumn("_gone", F.coalesce(F.col(f"_x{len(extra) - 1}"), F.lit(False)))
        after = upsert(before, news.withColumn("_v", F.col("_x0") if version is not None else F.lit(0)), self.keys, "_v")
        if gone is not None:
            after = after.filter("NOT _gone").drop("_gone")
        after.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        fs, at = self._fs(f"{folder}/_bucket=*/*.parquet")
        files = {b: f for b, f in old["files"].items() if int(b) not in touched}
        for found in fs.globStatus(at) or []:
            name = found.getPath().toString()
            files.setdefault(name.rsplit("_bucket=", 1)[1].split("/")[0], []).append(name)
        new = {"number": old["number"] + 1, "batches": [*old["batches"], *([batch] if batch is not None else [])][-REMEMBERED:], "files": files}
        self._publish(new)
        fs, at = self._fs(staged)
        fs.delete(at, True)
        return new

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the last ``keep`` versions and the folders that only they, or a merge that
        stopped, have used. Returns the number of folders deleted. No merge may run meanwhile."""
        known = self._versions()
        used = {f.split("/data/", 1)[1].split("/")[0] for n in known[-keep:] for files in self.version(n)["files"].values() for f in files}
        for n in known[:-keep]:
            fs, at = self._fs(f"{self.path}/versions/v{n}.json")
            fs.delete(at, False)
        fs, at = self._fs(f"{self.path}/data/*")
        old = [f.getPath() for f in fs.globStatus(at) or [] if f.getPath().getName() not in used]
        for path in old:
            fs.delete(path, True)
        return len(old)
