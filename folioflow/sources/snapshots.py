"""Tables published as immutable snapshots."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Snapshots:
    """A folder of snapshots ``v=<name>`` and numbered pointer files, of which the highest is current.

    A snapshot is written whole before its pointer appears under a new number, so readers see the old
    or the new table at any time, a failed build changes nothing, and of two writers that take the
    same number one fails.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.root}/CURRENT-*")) or []
        return sorted(int(f.getPath().getName().removeprefix("CURRENT-")) for f in found)

    def _point(self, name: str) -> None:
        number = (self._pointers() or [0])[-1] + 1
        temporary, pointer = self._path(f"{self.root}/NEXT-{uuid.uuid4().hex}"), self._path(f"{self.root}/CURRENT-{number}")
        out = self._fs.create(temporary, False)
        out.write(name.encode())
        out.close()
        if not self._fs.rename(temporary, pointer):
            raise OSError(f"could not move the pointer of {self.root}")

    def publish(self, df: DataFrame, check: DataFrame | None = None) -> str:
        """Writes ``df`` as a new snapshot and makes it current; refuses if ``check`` has rows."""
        if check is not None and not check.isEmpty():
            raise ValueError("the snapshot does not pass its check; nothing was published")
        name = f"v={uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        self._point(name)
        return name

    def withdraw(self) -> None:
        """Nothing is current from now on; earlier snapshots stay where they are."""
        self._point("")

    def current(self) -> str | None:
        numbers = self._pointers()
        if not numbers:
            return None
        row = self.spark.read.text(f"{self.root}/CURRENT-{numbers[-1]}").first()
        return row["value"] if row and row["value"] else None

    def read_current(self) -> DataFrame:
        name = self.current()
        if name is None:
            raise FileNotFoundError(f"nothing was published under {self.root}")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def append(self, df: DataFrame, name: str) -> None:
        """Writes a part under a fixed name; writing it again replaces it."""
        df.write.mode("overwrite").parquet(f"{self.root}/part={name}")

    def read(self, schema: StructType) -> DataFrame:
        """All parts."""
        if not self._fs.exists(self._path(self.root)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/part=*")


class Books:
    """Chunks and manifest of a shelf, published book by book.

    A book's chunks are a snapshot of their own. Its manifest row is written with them and both become
    current at once, last of all; a book that fails stays as it was.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _store(self, novel: str) -> Snapshots:
        return Snapshots(self.spark, f"{self.root}/{hashlib.md5(novel.encode()).hexdigest()}")

    def replace(self, novel: str, chunks: DataFrame, manifest: dict[str, str]) -> None:
        """Publishes ``chunks`` of one book in place of what it had; an empty book is refused."""
        own = chunks.where(F.col("novel") == novel)
        if own.isEmpty():
            raise ValueError(f"no chunks of {novel}; nothing was published")
        told = F.create_map(*[F.lit(x) for kv in manifest.items() for x in kv]) if manifest else F.lit(None).cast("map<string,string>")
        self._store(novel).publish(own.withColumn("manifest", told))

    def delete(self, novel: str) -> None:
        self._store(novel).withdraw()

    def _paths(self, novels: list[str]) -> list[str]:
        stores = [self._store(n) for n in novels]
        return [f"{s.root}/{name}" for s in stores if (name := s.current())]

    def chunks(self, novels: list[str]) -> DataFrame | None:
        """The current chunks of ``novels``; None where none of them is published."""
        paths = self._paths(novels)
        return self.spark.read.parquet(*paths).drop("manifest") if paths else None

    def manifest(self, novels: list[str]) -> DataFrame | None:
        """(novel, manifest, chunk_count) of the published ones of ``novels``."""
        paths = self._paths(novels)
        if not paths:
            return None
        return self.spark.read.parquet(*paths).groupBy("novel").agg(F.first("manifest").alias("manifest"), F.count("*").alias("chunk_count"))
