"""Vector collections: Parquet partitioned by a hash of the document, or of the id of rows without one.

A snapshot is a small file that names the folder of each partition. An upsert writes the partitions that it touches to a new folder,
then a new snapshot: readers go on with the one they have, and a writer that is lost leaves nothing that is read. Of two writers at a
time the second fails. ``vacuum`` removes folders that no recent snapshot names.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.lineage import checkpointed
from quillspark.operators.chunkset import first_in
from quillspark.operators.embed import EmbedConfig

# Names of field types and the fields that each collection has.
TYPES = {"string": "string", "int32": "int", "int64": "bigint", "float": "float", "bool": "boolean", "object": "map<string,string>", "variant": "variant"}
BASE = {"id": "string", "embedding": "array<float>", "text": "string", "chunk_id": "string", "source_file": "string", "hierarchy": "array<string>", "page_numbers": "array<int>", "embedding_model": "string", "embedding_model_version": "string", "indexed_at": "bigint", "metadata": "map<string,string>", "document": "string", "content_hash": "string"}
BUCKET, VERSION = "id_bucket", "version"
#: Partitions of a collection, if its schema doesn't say.
BUCKETS = 64
RESULT = "status string, total long, successful long, failed long, duplicates_skipped long, embedding_dim int, seconds double, failed_ids array<string>, docs_per_second double, success_rate double, summary string"


@dataclass(frozen=True)
class CollectionSchema:
    name: str
    embedding_dim: int
    fields: list[dict] = field(default_factory=list)
    version: int = 1
    buckets: int = BUCKETS
    model: str = ""

    def problems(self) -> list[str]:
        names = [f.get("name") for f in self.fields]
        found = [] if self.name else ["a collection needs a name"]
        found += [] if self.embedding_dim > 0 else ["the dimension must be positive"]
        found += ["a field needs a name and a type"] if any(not f.get("name") or not f.get("type") for f in self.fields) else []
        found += [f"field {n} is there twice" for n in sorted({n for n in names if n and names.count(n) > 1})]
        return found + ([] if self.buckets > 0 else ["the number of partitions must be positive"])

    def columns(self) -> dict[str, str]:
        kind = lambda t: f"array<{TYPES[t[:-2]]}>" if t.endswith("[]") else TYPES[t]
        return BASE | {f["name"]: kind(f["type"]) for f in self.fields}


def dedup_keep_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; rows without a vector are dropped after that, so that one may hide a later one that has it."""
    return first_in(rows, [key], order).where(F.size("embedding") > 0)


def merge_rows(old: DataFrame, new: DataFrame, key: str = "id", replaced: DataFrame | None = None, by: str = "document") -> DataFrame:
    """``new`` and what of ``old`` has another key. Of what ``replaced`` (a column ``by``) names nothing old stays, whether or not new
    rows come in its place."""
    kept = old.join(new.select(key), key, "left_anti")
    if replaced is not None:
        kept = kept.join(replaced.select(by).distinct(), by, "left_anti").select(*old.columns)
    return kept.unionByName(new, allowMissingColumns=True)


def outcome(total: int, successful: int, failed: int, duplicates: int, dim: int, seconds: float, failed_ids: list[str], stopped: bool = False) -> tuple:
    """A row of RESULT: rates and a summary in words follow from the counts."""
    status = "failed" if stopped or (failed and not successful) else "partial" if failed else "success"
    rate, part = successful / seconds if seconds > 0 else 0.0, successful / (successful + failed) if successful + failed else 0.0
    said = f"{status}: {successful} of {total} indexed, {failed} failed, {duplicates} duplicates, dimension {dim}, {seconds:.2f} s, {rate:.1f} a second"
    return status, total, successful, failed, duplicates, dim, seconds, failed_ids, rate, part, said


class Collections:
    """Collections below one folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def create(self, schema: CollectionSchema, drop_if_exists: bool = False) -> bool:
        """False for a schema with problems, and where one of the name has another dimension."""
        if schema.problems():
            return False
        if self.exists(schema.name):
            if not drop_if_exists:
                return self.schema(schema.name).embedding_dim == schema.embedding_dim
            self.drop(schema.name)
        out = self._fs().create(self._path(schema.name, "schema.json"), True)
        out.write(bytearray(json.dumps(asdict(schema) | {"created_at": int(time.time())}).encode()))
        out.close()
        return True

    def exists(self, name: str) -> bool:
        return bool(self._fs().exists(self._path(name, "schema.json")))

    def drop(self, name: str) -> bool:
        return bool(self._fs().delete(self._path(name), True))

    def names(self) -> list[str]:
        fs = self._fs()
        if not fs.exists(self._jvm.org.apache.hadoop.fs.Path(self.root)):
            return []
        return sorted(n for s in fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(self.root)) if self.exists(n := s.getPath().getName()))

    def _known(self, name: str) -> dict:
        (row,) = self.spark.read.text(f"{self.root}/{name}/schema.json", wholetext=True).collect()
        return json.loads(row[0])

    def schema(self, name: str) -> CollectionSchema:
        known = self._known(name)
        return CollectionSchema(**{f.name: known[f.name] for f in fields(CollectionSchema) if f.name in known})

    def create_for_model(self, name: str, config: EmbedConfig, more: list[dict] | None = None, drop_if_exists: bool = False) -> bool:
        """A collection of the dimension of a model's vectors."""
        return self.create(CollectionSchema(name, config.dim, more or [], model=config.model), drop_if_exists)

    def info(self, name: str) -> dict | None:
        """name, embedding_dim, model, fields, created_at and num_documents; None where there is no such collection."""
        if not self.exists(name):
            return None
        known = self._known(name)
        return {"name": name, "embedding_dim": known["embedding_dim"], "model": known.get("model", ""), "fields": known["fields"], "created_at": known["created_at"], "num_documents": self.read(name).count()}

    def snapshots(self, name: str) -> list[int]:
        """Numbers of the snapshots, the last being the one that is read."""
        fs, folder = self._fs(), self._path(name, "snapshots")
        return sorted(int(n[:-5]) for s in fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json") and n[0] != ".") if fs.exists(folder) else []

    def _folders(self, name: str, number: int | None = None) -> dict[int, str]:
        """Which version holds each partition."""
        there = self.snapshots(name)
        if not there:
            return {}
        (row,) = self.spark.read.text(f"{self.root}/{name}/snapshots/{there[-1] if number is None else number:012d}.json", wholetext=True).collect()
        return {int(k): v for k, v in json.loads(row[0]).items()}

    def _publish(self, name: str, seen: int, folders: dict[int, str]) -> None:
        """The snapshot after number ``seen``, unless another writer was faster."""
        fs, path = self._fs(), self._path(name, "snapshots", f"{seen + 1:012d}.json")
        new = self._path(name, "snapshots", f".{uuid.uuid4()}")
        out = fs.create(new, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if fs.exists(path) or not fs.rename(new, path):
            fs.delete(new, False)
            raise RuntimeError(f"another writer changed collection {name!r}; nothing was written")

    def vacuum(self, name: str, keep: int = 1) -> int:
        """Removes snapshots before the last ``keep``, and folders of partitions that no other names; how many of these."""
        there, fs = self.snapshots(name), self._fs()
        named = {(b, v) for n in there[-keep:] for b, v in self._folders(name, n).items()}
        for n in there[:-keep]:
            fs.delete(self._path(name, "snapshots", f"{n:012d}.json"), False)
        old = [p.getPath() for p in fs.globStatus(self._path(name, "data", f"{VERSION}=*", f"{BUCKET}=*")) or []]
        old = [p for p in old if (int(p.getName().split("=")[1]), p.getParent().getName().split("=")[1]) not in named]
        return sum(bool(fs.delete(p, True)) for p in old)

    def _files(self, name: str, columns: str, folders: dict[int, str]) -> DataFrame:
        """Rows of the partitions in ``folders``."""
        if not folders:
            return self.spark.createDataFrame([], columns)
        data = f"{self.root}/{name}/data"
        paths = [f"{data}/{VERSION}={v}/{BUCKET}={b}" for b, v in sorted(folders.items())]
        return self.spark.read.schema(f"{columns}, `{VERSION}` string, `{BUCKET}` int").option("basePath", data).parquet(*paths).drop(VERSION, BUCKET)

    def _kinds(self, name: str) -> str:
        return ", ".join(f"`{c}` {t}" for c, t in self.schema(name).columns().items())

    def read(self, name: str, documents: DataFrame | None = None, snapshot: int | None = None) -> DataFrame:
        """All rows, or those of the partitions in which ``documents`` (a column document) are, of the last snapshot or another."""
        folders = self._folders(name, snapshot)
        if documents is not None:
            among = self._buckets(name, documents.select("document"))
            folders = {b: v for b, v in folders.items() if b in among}
        return self._files(name, self._kinds(name), folders)

    def _buckets(self, name: str, keys: DataFrame) -> set[int]:
        """Partitions of keys (one column): a number for each, of which there are no more than partitions."""
        (key,), n = keys.columns, self.schema(name).buckets
        return {r[0] for r in keys.select(self._bucket(F.col(key), n)).distinct().collect()}

    @staticmethod
    def _bucket(key: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(BUCKET)

    def known_vectors(self, name: str, documents: DataFrame, model: str, model_version: str = "1") -> DataFrame:
        """(document, content_hash, embedding) that the collection has of ``documents`` by the model, one of each content."""
        rows = self.read(name, documents).where((F.col("embedding_model") == model) & (F.col("embedding_model_version") == model_version) & F.col("content_hash").isNotNull() & F.col("document").isNotNull())
        return rows.groupBy("document", "content_hash").agg(F.first("embedding").alias("embedding"))

    def index(self, name: str, embedded: DataFrame, order: list[str], model_version: str = "1", id_mode: str = "source", max_errors: int | None = None, replaces: DataFrame | None = None) -> DataFrame:
        """Upserts chunks (columns chunk_id, content, embedding and, if there, source_file, hierarchy, page_numbers, metadata,
        model_name, document, content_hash) and returns one row of metrics. ``id_mode``: ``source`` keys by file, chunk id and its
        occurrence there, ``chunk_id`` by that alone, so that the first of an id stays. ``replaces`` (a column document) names
        documents of which nothing stays but what comes now; their chunks must have that column. With more than ``max_errors``
        vectors of another dimension nothing is written. ``failed_ids`` are a hundred of those at most. Chunks are computed once."""
        began = time.time()
        if not self.exists(name):
            return self.spark.createDataFrame([outcome(0, 0, 0, 0, 0, 0.0, [], True)], RESULT)
        schema, here = self.schema(name), set(embedded.columns)
        have = lambda c, t: F.col(c).cast(t) if c in here else F.lit(None).cast(t)
        rows = embedded.withColumn("__source", F.coalesce(have("source_file", "string"), F.lit("")))
        if id_mode == "source":
            nth = F.row_number().over(Window.partitionBy("__source", "chunk_id").orderBy(*order))
            rows = rows.withColumn("__key", F.concat_ws("#", "__source", "chunk_id", nth.cast("string")))
        else:
            rows = rows.withColumn("__key", F.col("chunk_id"))
        place = F.row_number().over(Window.partitionBy("__key").orderBy(*order))
        fields_ = [have(f["name"], schema.columns()[f["name"]]).alias(f["name"]) for f in schema.fields]
        document = have("document", "string")
        known = checkpointed(rows.select(
            F.col("__key").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("content").alias("text"), "chunk_id", have("source_file", "string").alias("source_file"), have("hierarchy", "array<string>").alias("hierarchy"), have("page_numbers", "array<int>").alias("page_numbers"),
            have("model_name", "string").alias("embedding_model"), F.lit(model_version).alias("embedding_model_version"), F.unix_timestamp().alias("indexed_at"), have("metadata", "map<string,string>").alias("metadata"), document.alias("document"), have("content_hash", "string").alias("content_hash"), *fields_,
            place.alias("__place"), self._bucket(F.coalesce(document, F.col("__key")), schema.buckets),
        ), f"{self.root}/_checkpoint")
        first, fits = F.col("__place") == 1, F.coalesce(F.size("embedding") == schema.embedding_dim, F.lit(False))
        total, keys, good = known.agg(F.count("*"), F.count_if(first), F.count_if(first & fits)).first()
        failed = [r["id"] for r in known.where(first & ~fits).select("id").limit(100).collect()]
        stopped = max_errors is not None and keys - good > max_errors
        if (good or replaces is not None) and not stopped:
            self._write(name, known.where(first & fits).drop("__place"), replaces)
        return self.spark.createDataFrame([outcome(total, 0 if stopped else good, keys if stopped else keys - good, total - keys, schema.embedding_dim, time.time() - began, failed, stopped)], RESULT)

    def _write(self, name: str, new: DataFrame, replaces: DataFrame | None) -> None:
        """Writes the partitions of the new rows and of the documents that they replace: the new rows, and what of the old stays."""
        seen, folders, version = (self.snapshots(name) or [0])[-1], self._folders(name), uuid.uuid4().hex
        touched = {r[0] for r in new.select(BUCKET).distinct().collect()}  # at most as many as there are partitions
        if replaces is not None:
            touched |= self._buckets(name, replaces.select("document"))
        old = self._files(name, self._kinds(name), {b: v for b, v in folders.items() if b in touched})
        old = old.withColumn(BUCKET, self._bucket(F.coalesce("document", "id"), self.schema(name).buckets))
        merged = merge_rows(old, new, replaced=replaces)
        merged.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/{name}/data/{VERSION}={version}")
        written = {b for b in touched if self._fs().exists(self._path(name, "data", f"{VERSION}={version}", f"{BUCKET}={b}"))}
        self._publish(name, seen, {b: v for b, v in folders.items() if b not in touched} | dict.fromkeys(written, version))

    def stats(self) -> DataFrame:
        """name, embedding_dim, num_documents of all collections."""
        out = self.spark.createDataFrame([], "name string, embedding_dim int, num_documents long")
        for name in self.names():
            out = out.unionByName(self.read(name).agg(F.lit(name).alias("name"), F.lit(self.schema(name).embedding_dim).alias("embedding_dim"), F.count("*").alias("num_documents")))
        return out
