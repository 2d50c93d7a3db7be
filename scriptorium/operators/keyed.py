"""A keyed table that is updated: segments of new rows, sorted buckets of old ones, and a manifest.

Writers only add: a segment is a folder of its own and counts once it is complete, so two
writers never lose each other's rows.  Of a key's rows the one with the greatest version
holds; of equal versions the greatest in its other columns.  Compaction merges
what the newest manifest names and the segments since then into a new generation, dealt to
buckets by a hash of the key and sorted within, and then creates the next manifest, which
can be done once: of two compactions at a time one finds it there and takes its own
generation away.  Readers go by the newest manifest that is whole.  What a
compaction replaced stays until the next one, for readers that are under way.

A stream writes each batch as a segment of the batch's name, so a batch that is run again
replaces itself.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from scriptorium.folder import address, file_system

_WHOLE = "\nwhole\n"


@dataclass(frozen=True)
class Manifest:
    """What a number of compactions has come to: a generation, and segments that are in it."""

    number: int = 0
    generation: str | None = None
    segments: tuple[str, ...] = ()
    before: tuple[str, ...] = ()


class KeyedStore:
    """A store at a path; schema, keys and buckets are those it was created with."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, address(spark, path).rstrip("/")
        self.fs, self.root = file_system(self.path)
        with self.fs.open_input_stream(f"{self.root}/store.json") as told:
            facts = json.loads(told.read())
        self.schema, self.keys, self.version, self.buckets = T.StructType.fromJson(facts["schema"]), facts["keys"], facts["version"], facts["buckets"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], version: str, buckets: int = 32) -> KeyedStore:
        if version in keys or not {version, *keys} <= set(schema.names) or "bucket" in schema.names:
            raise ValueError("keys and version are columns, and no column is named bucket")
        fs, root = file_system(address(spark, path).rstrip("/"))
        for name in ("segments", "generations", "manifests"):
            fs.create_dir(f"{root}/{name}", recursive=True)
        with fs.open_output_stream(f"{root}/store.json") as sink:
            sink.write(json.dumps({"schema": schema.jsonValue(), "keys": keys, "version": version, "buckets": buckets}).encode())
        return cls(spark, path)

    def manifest(self) -> Manifest:
        """The newest that is whole."""
        found = sorted(self._names("manifests"), reverse=True)
        for name in found:
            with self.fs.open_input_stream(f"{self.root}/manifests/{name}") as told:
                text = told.read().decode()
            if text.endswith(_WHOLE):
                facts = json.loads(text.removesuffix(_WHOLE))
                return Manifest(facts["number"], facts["generation"], tuple(facts["segments"]), tuple(facts["before"]))
        return Manifest()

    def put(self, rows: DataFrame, segment: str | None = None) -> str:
        """Adds rows; a segment of a name that is there is replaced."""
        segment = segment or uuid.uuid4().hex
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/segments/{segment}")
        return segment

    def segments(self, manifest: Manifest) -> list[str]:
        """Whole segments that are in no generation yet."""
        held = {*manifest.segments, *manifest.before}
        whole = [s for s in self._names("segments") if self.fs.get_file_info(f"{self.root}/segments/{s}/_SUCCESS").is_file]
        return sorted(s for s in whole if s not in held)

    def read(self) -> DataFrame:
        """The row that holds of every key."""
        manifest = self.manifest()
        return self._latest(self._rows(manifest, self.segments(manifest)))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The row that holds of each key of `wanted`, which has the key columns; only their buckets are read."""
        manifest = self.manifest()
        asked = wanted.select(*self.keys).distinct()
        parts = [self._of_segments(self.segments(manifest)).join(asked, self.keys, "left_semi")]
        if manifest.generation:
            parts.append(self._generation(manifest).join(asked.withColumn("bucket", self._bucket()), ["bucket", *self.keys], "left_semi").select(*self.schema.names))
        return self._latest(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))

    def compact(self) -> bool:
        """Makes a generation of all whole segments; false if another compaction was first."""
        old = self.manifest()
        new = self.segments(old)
        name = uuid.uuid4().hex
        rows = self._latest(self._rows(old, new)).withColumn("bucket", self._bucket())
        rows.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", *self.keys).write.partitionBy("bucket").parquet(f"{self.path}/generations/{name}")
        made = Manifest(old.number + 1, name, tuple(new), old.segments)
        if not self._created(made):
            self.fs.delete_dir(f"{self.root}/generations/{name}")
            return False
        for folder, gone in (("segments", old.segments), ("generations", [g for g in self._names("generations") if g not in (name, old.generation) and self._settled(g, made)])):
            for one in gone:
                if self.fs.get_file_info(f"{self.root}/{folder}/{one}").type.name == "Directory":
                    self.fs.delete_dir(f"{self.root}/{folder}/{one}")
        return True

    def upsert(self, stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
        """Writes a stream's batches, each once, until there is no more."""
        return stream.writeStream.queryName(name).foreachBatch(lambda batch, number: self.put(batch, f"{name}-{number}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _settled(self, generation: str, made: Manifest) -> bool:
        """Whether a generation is one that a manifest before the last names; others may still be written."""
        named = set()
        for file in self._names("manifests"):
            with self.fs.open_input_stream(f"{self.root}/manifests/{file}") as told:
                text = told.read().decode()
            if text.endswith(_WHOLE) and (facts := json.loads(text.removesuffix(_WHOLE)))["number"] < made.number - 1:
                named.add(facts["generation"])
        return generation in named

    def _created(self, made: Manifest) -> bool:
        """Creates the manifest's file unless it is there: the file system lets one writer do so."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        place = hadoop.Path(f"{self.path}/manifests/{made.number:012d}.json")
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            out = fs.create(place, False)
        except Exception as error:
            if fs.exists(place):
                return False
            raise error
        out.write(bytearray((json.dumps({"number": made.number, "generation": made.generation, "segments": made.segments, "before": made.before}) + _WHOLE).encode()))
        out.close()
        return True

    def _names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(pyarrow.fs.FileSelector(f"{self.root}/{folder}"))
        return [f.base_name for f in found if not f.base_name.startswith((".", "_"))]

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _generation(self, manifest: Manifest) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/generations/{manifest.generation}")

    def _of_segments(self, segments: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/segments/{s}" for s in segments])

    def _rows(self, manifest: Manifest, segments: list[str]) -> DataFrame:
        rows = self._of_segments(segments)
        return rows.unionByName(self._generation(manifest).select(*self.schema.names)) if manifest.generation else rows

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c not in (*self.keys, self.version)]
        held = rows.groupBy(*self.keys).agg(F.max(F.struct(self.version, *rest)).alias("row"))
        return held.select(*[F.col(c) if c in self.keys else F.col(f"row.{c}").alias(c) for c in self.schema.names])
