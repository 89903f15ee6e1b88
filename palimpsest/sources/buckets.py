"""A keyed table kept as hash buckets of parquet files under versioned manifests.

``bucket = pmod(hash(keys), n)``.  A version is one JSON manifest; it names one part file for every SPAN
buckets, and a part names the files of its buckets.  Files are never changed.  Writing a change replaces
whole buckets: only the touched ones are read, merged with their sorted changes and written anew, their
parts are written anew by the tasks too, and a manifest that names old and new parts is committed by an
atomic rename that fails if the version exists.  So the driver sees one row a touched part, never one a
bucket, and a task reads the parts of its own buckets only.  Files of failed or repeated tasks are in no
manifest, so lost executors and speculative copies do no harm.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS_PER_BUCKET = 50_000
SPAN = 256  # buckets a part
MANY = 10_000  # buckets from which tasks read the files by themselves instead of the driver listing them


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _arrow_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_file(path: str, schema: pa.Schema) -> pa.Table:
    import pyarrow.parquet as pq

    at, rest = _arrow_fs(path)
    got = pq.read_table(rest, filesystem=at, partitioning=None, columns=schema.names)
    return pa.table([got[f.name].cast(f.type, safe=False) for f in schema], schema=schema)


def write_file(path: str, data: pa.Table) -> None:
    import pyarrow.parquet as pq

    at, rest = _arrow_fs(path)
    at.create_dir(rest.rpartition("/")[0], recursive=True)
    pq.write_table(data, rest, filesystem=at, compression="zstd")


def _load(path: str) -> dict:
    at, rest = _arrow_fs(path)
    with at.open_input_stream(rest) as f:
        return json.loads(f.read())


def _store(path: str, value: dict) -> None:
    at, rest = _arrow_fs(path)
    at.create_dir(rest.rpartition("/")[0], recursive=True)
    with at.open_output_stream(rest) as f:
        f.write(json.dumps(value).encode())


_PARTS = pa.schema([("part", pa.int64()), ("path", pa.string())])


class BucketedTable:
    def __init__(self, spark: SparkSession, root: str, manifest: dict):
        self.spark, self.root, self.manifest = spark, root, manifest
        self.schema = StructType.fromJson(manifest["schema"])
        self.keys: list[str] = manifest["keys"]
        self.n: int = manifest["n"]

    # -- versions -----------------------------------------------------------------------------------
    @classmethod
    def open(cls, spark: SparkSession, root: str) -> BucketedTable:
        """The newest committed version."""
        p, at = _hadoop(spark, f"{root}/manifests")
        newest = max(s.getPath().getName() for s in at.listStatus(p) if s.getPath().getName().endswith(".json"))
        stream = at.open(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifests/{newest}"))
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return cls(spark, root, json.loads(text))

    @staticmethod
    def _commit(spark: SparkSession, root: str, manifest: dict) -> None:
        final, at = _hadoop(spark, f"{root}/manifests/{manifest['version']:08d}.json")
        draft, _ = _hadoop(spark, f"{root}/manifests/.{uuid.uuid4().hex}")
        out = at.create(draft)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if at.exists(final) or not at.rename(draft, final):
            raise RuntimeError(f"version {manifest['version']} of {root} was committed by someone else")

    @classmethod
    def create(cls, df: DataFrame, root: str, keys: list[str], rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> BucketedTable:
        """Version 0 from ``df``, which has one row per key; about ``rows`` rows are expected.

        The number of buckets is a multiple of the shuffle partitions: a hash-partitioned ``df`` then
        has each bucket within one task and needs no further shuffle.
        """
        spark = df.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        n = parts * max(1, -(-rows // (parts * rows_per_bucket)))
        data, folders = f"{root}/data/v0", "_bucket"
        while folders in df.columns:
            folders += "_"
        df.withColumn(folders, bucket_of(keys, n)).sortWithinPartitions(folders, *keys).write.partitionBy(folders).parquet(data)

        def list_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            for part in (x for b in batches for x in b.column(0).to_pylist()):
                files: dict[str, list[str]] = {}
                for bucket in range(part * SPAN, min(n, (part + 1) * SPAN)):
                    folder = f"{data}/{folders}={bucket}"
                    at, rest = _arrow_fs(folder)
                    found = at.get_file_info(fs.FileSelector(rest, allow_not_found=True))
                    names = sorted(f"{folder}/{x.base_name}" for x in found if x.base_name.endswith(".parquet"))
                    if names:
                        files[str(bucket)] = names
                path = f"{root}/manifests/parts/{part}-{uuid.uuid4().hex}"
                _store(path, files)
                yield pa.RecordBatch.from_pydict({"part": [part], "path": [path]}, schema=_PARTS)

        n_parts = -(-n // SPAN)
        listed = spark.range(0, n_parts, 1, min(n_parts, 200)).mapInArrow(list_part, "part bigint, path string").collect()
        manifest = {"version": 0, "n": n, "keys": keys, "schema": df.schema.jsonValue(), "parts": {str(r["part"]): r["path"] for r in listed}}
        cls._commit(spark, root, manifest)
        return cls(spark, root, manifest)

    # -- reading ------------------------------------------------------------------------------------
    def files(self) -> dict[str, list[str]]:
        """The files of every bucket that has any (for tables of moderate size and for tests)."""
        return {b: f for path in self.manifest["parts"].values() for b, f in _load(path).items()}

    def read(self, columns: list[str] | None = None, many: int = MANY) -> DataFrame:
        """All rows.  Beyond ``many`` buckets tasks find and read the files of the parts they are given."""
        schema = StructType([f for f in self.schema.fields if columns is None or f.name in columns])
        if self.n <= many:
            names = [f for fs in self.files().values() for f in fs]
            return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for path in (x for b in batches for x in b.column(0).to_pylist()):
                for name in (f for fs in _load(path).values() for f in fs):
                    yield from read_file(name, arrow).to_batches(10_000)

        parts = sorted(self.manifest["parts"].values())
        return self.spark.createDataFrame([(p,) for p in parts], "path string").repartition(len(parts)).mapInArrow(run, schema)

    # -- writing ------------------------------------------------------------------------------------
    def merge(self, changes: DataFrame, merge_bucket: Callable[[pa.Table, pa.Table], pa.Table]) -> BucketedTable:
        """A new version: ``merge_bucket(base, changes)`` for every touched bucket.

        Both tables a call gets are sorted by key, and so must its result be, in the table's schema; a key
        may have several changes.  At most one row a touched part returns to the driver.
        """
        old, keys, root, version, n = self.manifest["parts"], self.keys, self.root, self.manifest["version"] + 1, self.n
        schema = to_arrow_schema(self.schema)
        routed = changes.withColumn("_bucket", bucket_of(keys, n)).repartition("_bucket").sortWithinPartitions("_bucket", *keys)

        def one(bucket: int, parts: list[pa.RecordBatch], known: dict[str, dict]) -> pa.RecordBatch:
            own = pa.Table.from_batches(parts).drop_columns(["_bucket"])
            part = str(bucket // SPAN)
            if part not in known:
                known.clear()
                known[part] = _load(old[part]) if part in old else {}
            names = known[part].get(str(bucket), [])
            base = pa.concat_tables([read_file(f, schema) for f in names] or [schema.empty_table()])
            if len(names) > 1:
                base = base.sort_by([(k, "ascending") for k in keys])
            path = f"{root}/data/v{version}/bucket-{bucket}-{uuid.uuid4().hex}.parquet"
            write_file(path, merge_bucket(base, own))
            return pa.RecordBatch.from_pydict({"part": [int(part)], "bucket": [bucket], "path": [path]}, schema=pa.schema([("part", pa.int64()), ("bucket", pa.int32()), ("path", pa.string())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            bucket, known = None, {}
            for batch in batches:
                ids = batch.column("_bucket").to_numpy(zero_copy_only=False)
                turns = (ids[1:] != ids[:-1]).nonzero()[0] + 1
                cuts = [0, *turns.tolist(), len(ids)]
                for a, b in zip(cuts, cuts[1:]):
                    if a == b:
                        continue
                    if bucket is not None and ids[a] != bucket:
                        yield one(int(bucket), held, known)
                        held = []
                    bucket = ids[a]
                    held.append(batch.slice(a, b - a))
            if held:
                yield one(int(bucket), held, known)

        def renew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fresh: dict[int, dict[str, list[str]]] = {}
            for b in batches:
                for part, bucket, path in zip(*(c.to_pylist() for c in b.columns)):
                    fresh.setdefault(part, {})[str(bucket)] = [path]
            for part, own in fresh.items():
                path = f"{root}/manifests/parts/{part}-{uuid.uuid4().hex}"
                _store(path, (_load(old[str(part)]) if str(part) in old else {}) | own)
                yield pa.RecordBatch.from_pydict({"part": [part], "path": [path]}, schema=_PARTS)

        written = routed.mapInArrow(run, "part bigint, bucket int, path string")
        done = written.repartition("part").mapInArrow(renew, "part bigint, path string").collect()
        manifest = self.manifest | {"version": version, "parts": old | {str(r["part"]): r["path"] for r in done}}
        self._commit(self.spark, root, manifest)
        return BucketedTable(self.spark, root, manifest)


def bucket_of(keys: list[str], n: int) -> Column:
    return F.pmod(F.hash(*[F.col(k) for k in keys]), F.lit(n)).cast("int")
