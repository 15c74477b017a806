"""A store of immutable vector segments under an atomically replaced manifest.

Segments are Parquet folders (row, id, vector, payload), graphs are Parquet
folders beside them, one for each segment. A call that publishes many rows makes
several segments of bounded size in one generation, so that graphs are built, and
later searched, in as many tasks. A manifest names the segments of one generation; a reader
holds a snapshot of it and is never disturbed, since folders of past
generations stay until ``vacuum``. One writer at a time holds the lock file.
"""

from __future__ import annotations

import json
import re
import time
import uuid
import zlib
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, Corrupt, Incompatible, Locked, StoreError
from ..functions import vector as V
from ..metric import Metric
from ..operators import hnsw, knn
from ..operators.rows import dense_numbers

MANIFEST, LOCK = "MANIFEST.json", "LOCK"
_NAME = re.compile(r"seg-(\d{10,})")
MODES = ("auto", "exact", "approximate")
#: Up to so many hits are looked for among close rows first.
FEW = 16


class Folder:
    """Files of a store through Spark's file system layer, local or remote."""

    def __init__(self, spark: SparkSession, root: str, *, sync: bool = True):
        self.sync = sync
        self.spark, self.root = spark, root if re.match(r"\w+:", root) else "file://" + _absolute(root)
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.at(name) if name else self.root)

    def at(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(""))] if self.fs.exists(self._path("")) else []

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes, overwrite: bool) -> None:
        stream = self.fs.create(self._path(name), overwrite)
        try:
            stream.write(bytearray(data))
            if self.sync and hasattr(stream, "hsync"):
                stream.hsync()
        finally:
            stream.close()

    def replace(self, name: str, data: bytes) -> None:
        """All or nothing: written aside, then renamed over the old file."""
        aside = f".{name}.{uuid.uuid4().hex}"
        self.create(aside, data, True)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._path(aside), self._path(name), options)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def move(self, old: str, new: str) -> None:
        if not self.fs.rename(self._path(old), self._path(new)):
            raise StoreError(f"{old} cannot be moved to {new}")

    def sizes(self, name: str) -> dict[str, int]:
        """Part files of a table and their lengths."""
        found = [(x.getPath().getName(), x.getLen()) for x in self.fs.listStatus(self._path(name))] if self.exists(name) else []
        return {k: n for k, n in found if k.startswith("part-")}

    def make(self) -> None:
        self.fs.mkdirs(self._path(""))


def _absolute(path: str) -> str:
    import os

    return os.path.abspath(path)


@dataclass(frozen=True)
class StoreConfig:
    dim: int
    metric: str
    fingerprint: int

    def __post_init__(self):
        Metric.parse(self.metric)
        if not 1 <= self.dim <= 65536:
            raise ConfigError(f"{self.dim} components are outside 1..65536")


@dataclass(frozen=True)
class Segment:
    id: int
    name: str
    rows: int
    bytes: int
    has_payload: bool
    graph: dict | None  # m, m0, layers, files
    files: dict  # part file -> [length, digest of its bytes]


@dataclass(frozen=True)
class OpenOptions:
    """How a store is opened: ``verify`` reads and checks everything first, ``cache``
    keeps rows and graphs of a snapshot in the executors' memory (and on their disks
    beyond it) once they are read, ``sync`` forces manifests to disk."""

    verify: bool = False
    cache: bool = False
    sync: bool = True


#: Columns of a segment and of a graph.
ROWS = "row long, id long, vector array<float>, payload string"
#: Components hardly repeat, so a dictionary of them only costs.
PLAIN = {"parquet.enable.dictionary#vector.list.element": "false"}
GRAPH = "node int, layer int, neighbors array<int>"


@dataclass(frozen=True)
class Snapshot:
    """One generation of a store; valid for as long as its folders are kept."""

    folder: Folder
    generation: int
    config: StoreConfig
    segments: tuple[Segment, ...]
    cache: bool = False

    def __len__(self) -> int:
        return sum(s.rows for s in self.segments)

    @property
    def mapped_bytes(self) -> int:
        return sum(s.bytes for s in self.segments)

    def _numbered(self, df: DataFrame) -> DataFrame:
        """segment_id and ordinal from each file's folder."""
        seg = F.regexp_extract(F.col("_metadata.file_path"), r"/seg-(\d+)", 1).cast("long")
        place = F.create_map(*[F.lit(x) for k, s in enumerate(self.segments) for x in (s.id, k)])
        return df.withColumn("segment_id", seg).withColumn("ordinal", place[F.col("segment_id")].cast("int"))

    def rows(self, segments: list[Segment] | None = None) -> DataFrame:
        """segment_id, ordinal, row, id, vector, payload of all or some segments."""
        chosen = self.segments if segments is None else segments
        spark = self.folder.spark
        if not chosen:
            return spark.createDataFrame([], "segment_id long, ordinal int, row long, id long, vector array<float>, payload string")
        df = spark.read.schema(ROWS).parquet(*[self.folder.at(s.name) for s in chosen])
        return self._held(self._numbered(df).select("segment_id", "ordinal", "row", "id", "vector", "payload"))

    def _held(self, df: DataFrame) -> DataFrame:
        return df.persist(StorageLevel.MEMORY_AND_DISK) if self.cache else df

    def graphs(self, segments: list[Segment]) -> DataFrame:
        df = self.folder.spark.read.schema(GRAPH).parquet(*[self.folder.at(s.name + ".graph") for s in segments])
        return self._held(self._numbered(df).select("segment_id", "node", "layer", "neighbors"))

    def search(self, queries, **options) -> DataFrame:
        """Hits of a list of (id, vector) or a frame (query_id, query); see ``search_block``.
        Many queries that scan unit vectors look among close rows first."""
        k, mode = options.get("k", 10), options.get("mode", "auto")
        scans = mode == "exact" or mode == "auto" and not any(s.graph for s in self.segments)
        close = scans and 0 < k <= FEW and not options.get("payload") and Metric.parse(self.config.metric).normalizes
        if close and isinstance(queries, DataFrame) and queries.count() > knn.BROADCAST and len(self) > knn.BROADCAST:
            return knn.search_close(self.rows(), queries, k=k, dim=self.config.dim)
        return knn.in_blocks(queries, lambda block: self.search_block(block, **options))

    def search_block(self, queries: list[tuple[int, object]], *, k: int = 10, ef: int = 64, mode: str = "auto", payload: bool = False) -> DataFrame:
        """Hits of all queries over all segments: query_id, rank, segment_id,
        ordinal, row, id, score. Each segment is scanned or searched by its graph
        as ``mode`` and its size say; payloads are fetched for the hits only."""
        if mode not in MODES:
            raise ConfigError(f"mode is one of {MODES}")
        c = self.config
        for i, q in queries:  # also when there is nothing to search
            knn.prepare_query(q, c.dim, Metric.parse(c.metric), i)
        k, every = min(k, len(self)), k >= len(self)
        by_graph = [s for s in self.segments if s.graph and s.rows and (mode == "approximate" or mode == "auto" and s.rows >= hnsw.SMALL)]
        scanned = [s for s in self.segments if s not in by_graph and s.rows]
        parts = []
        if scanned or not by_graph:
            parts.append(knn.search(self.rows(scanned), queries, k=k, metric=c.metric, dim=c.dim, every=every))
        if by_graph and k > 0:
            parts.append(hnsw.search_graphs(self.rows(by_graph), self.graphs(by_graph), queries, k=k, ef=ef, metric=c.metric, dim=c.dim))
        hits = parts[0] if len(parts) == 1 else knn.ranked(parts[0].unionByName(parts[1]).drop("rank"), k)
        return knn.attach(hits, self.rows(), ["payload"]) if payload else hits

    def info(self) -> DataFrame:
        """One row per segment, in search order."""
        rows = [(k, s.id, s.name, s.rows, s.bytes, "hnsw" if s.graph else "flat", s.graph and s.graph["m"], s.graph and s.graph["layers"], s.has_payload) for k, s in enumerate(self.segments)]
        return self.folder.spark.createDataFrame(rows, "ordinal int, segment_id long, name string, vectors long, bytes long, index string, m int, layers int, payload boolean")

    def verify(self) -> None:
        """Check every segment and graph against the manifest: part files, their
        lengths and columns, and every byte of them."""
        if not self.segments:
            return
        graphs = [s for s in self.segments if s.graph]
        kept = {s.name: s.files for s in self.segments} | {s.name + ".graph": s.graph["files"] for s in graphs}
        lengths = lambda files: {k: v[0] for k, v in files.items()}
        for name, files in kept.items():
            if self.folder.sizes(name) != lengths(files):
                raise Corrupt(f"{name} has other files than its manifest says")
        found = _files(self.folder, list(kept))
        for name, files in kept.items():
            if found[name] != files:
                raise Corrupt(f"{name} differs from its manifest")
        for made, part, schema in ((self.segments, "", ROWS), (graphs, ".graph", GRAPH)):
            if made:
                stored = self.folder.spark.read.option("mergeSchema", "true").parquet(*[self.folder.at(s.name + part) for s in made])
                if [f"{k} {t}" for k, t in stored.dtypes] != schema.replace(" long", " bigint").split(", "):
                    raise Corrupt(f"a part file has the columns {stored.dtypes}")


def _digests(folder: Folder, names: list[str]) -> dict[str, str]:
    """Part file -> digest of all its bytes. Files are read by the text source, cut
    at line feeds: splits of any file are read in parallel, and no task holds a
    file. One row per part file comes back; Spark gives each a name of its own."""
    if not names:
        return {}
    lines = folder.spark.read.option("lineSep", "\n").text([folder.at(n) for n in names])
    whole = F.xxhash64(F.col("value").cast("binary"))
    # Neither depends on the order of lines; the sum tells lines that occur twice.
    digest = F.concat_ws("-", F.count(F.lit(1)).cast("string"), F.hex(F.bit_xor(whole)), F.hex(F.sum(F.shiftrightunsigned(whole, 24))))
    return {r[0]: r[1] for r in lines.groupBy("_metadata.file_name").agg(digest).collect()}


def _files(folder: Folder, names: list[str]) -> dict[str, dict]:
    """Table -> its part files with their lengths and digests."""
    digests = _digests(folder, names)
    return {name: {k: [n, digests.get(k)] for k, n in folder.sizes(name).items()} for name in names}


class Store:
    """Publishing, compaction and snapshots of one folder."""

    def __init__(self, folder: Folder, body: dict, cache: bool = False):
        self.folder, self._body, self.cache = folder, body, cache
        c = body["config"]
        self.config = StoreConfig(c["dim"], c["metric"], int(c["fingerprint"], 16))

    # -- opening ---------------------------------------------------------
    @classmethod
    def open(cls, spark: SparkSession, root: str, options: OpenOptions = OpenOptions(), *, verify: bool = False) -> Store:
        folder = Folder(spark, root, sync=options.sync)
        store = cls(folder, read_manifest(folder), options.cache)
        for s in store.snapshot().segments:
            if not folder.exists(s.name) or s.graph and not folder.exists(s.name + ".graph"):
                raise Corrupt(f"{s.name} is missing")
        if verify or options.verify:
            store.snapshot().verify()
        return store

    @classmethod
    def open_or_create(cls, spark: SparkSession, root: str, config: StoreConfig, options: OpenOptions = OpenOptions()) -> Store:
        folder = Folder(spark, root, sync=options.sync)
        if folder.exists(MANIFEST):
            store = cls.open(spark, root, options)
            if store.config != StoreConfig(config.dim, Metric.parse(config.metric).value, config.fingerprint):
                raise Incompatible(f"the store has {store.config}, not {config}")
            return store
        folder.make()
        body = {"generation": 0, "next_segment": 1, "config": {"dim": config.dim, "metric": Metric.parse(config.metric).value, "fingerprint": f"{config.fingerprint:016x}"}, "segments": [], "batches": {}}
        write_manifest(folder, body)
        return cls(folder, body, options.cache)

    def reload(self) -> Store:
        self._body = read_manifest(self.folder)
        return self

    def snapshot(self) -> Snapshot:
        return Snapshot(self.folder, self._body["generation"], self.config, tuple(Segment(**s) for s in self._body["segments"]), self.cache)

    @property
    def generation(self) -> int:
        return self._body["generation"]

    def search(self, queries, **options) -> DataFrame:
        return self.snapshot().search(queries, **options)

    def last_batch(self, source: str) -> int:
        return self._body["batches"].get(source, -1)

    # -- writing ---------------------------------------------------------
    @contextmanager
    def writer(self):
        """Hold the lock; a second writer fails at once."""
        token = uuid.uuid4().hex
        try:
            self.folder.create(LOCK, token.encode(), False)
        except Exception as e:
            if self.folder.exists(LOCK):
                raise Locked(f"{self.folder.root} has another writer") from e
            raise
        try:
            yield self.reload()
        finally:
            self.folder.delete(LOCK)

    def break_lock(self) -> None:
        """For a lock whose writer has died."""
        self.folder.delete(LOCK)

    def publish(self, df: DataFrame, *, order: list | None = None, params: hnsw.HnswParams | None = None, fingerprint: int | None = None, batch: tuple[str, int] | None = None, segment_rows: int | None = None, numbered: bool = False, prepared: bool = False) -> dict:
        """Add rows (id, vector, payload), numbered by ``order``, as one segment or as
        segments of ``segment_rows`` rows each. If the ids are ``numbered`` from 0, in
        order, each once and with few gaps, a segment takes ``segment_rows`` ids, and
        no sort of all rows is needed. Bad rows fail the whole call; rows that are
        ``prepared`` are as a segment holds them and only checked for missing vectors.
        Returns a report."""
        if fingerprint is not None and fingerprint != self.config.fingerprint:
            raise Incompatible("vectors of another model")
        if segment_rows is not None and segment_rows <= 0 or numbered and not segment_rows:
            raise ConfigError("segment_rows is positive")
        if "payload" not in df.columns:
            df = df.withColumn("payload", F.lit(None).cast("string"))
        c = self.config
        ready = df if prepared else V.prepared(df, "vector", c.dim, c.metric, "_problem")
        with self.writer():
            return self._write(ready, order or ["id"], params, lambda segments, new: [*segments, *new], batch, segment_rows, numbered)

    def _write(self, ready: DataFrame, order: list, params, arrange, batch=None, segment_rows: int | None = None, numbered: bool = False) -> dict:
        """Rows are checked, counted and stored with their numbers, a folder for each
        segment: numbered by one sort of all rows, or by id inside each segment."""
        body, folder, source = self._body, self.folder, ready
        first, aside = body["next_segment"], f".rows-{uuid.uuid4().hex}"
        names: list[str] = []
        began = time.time()
        try:
            # A row that cannot be stored has no vector here.
            measures = {"payloads": F.count("payload"), "bad": F.min(F.when(F.col("vector").isNull(), F.col("id"))), "lost": F.count_if(F.col("vector").isNull())}
            if numbered:
                place = F.row_number().over(Window.partitionBy("part").orderBy("id")).cast("long") - 1
                ready = ready.withColumn("part", F.floor(F.col("id") / segment_rows).cast("long")).withColumn("row", place)
                # Written as it comes, counted and checked in what was written, so that rows are made once.
                ready.select("part", "row", "id", "vector", "payload").write.options(**PLAIN).partitionBy("part").parquet(folder.at(aside + "/parts"))
                made = folder.spark.read.schema(f"{ROWS}, part long").parquet(folder.at(aside + "/parts"))
                parts = made.groupBy("part").agg(F.count(F.lit(1)).alias("_rows"), *[m.alias(k) for k, m in measures.items()]).orderBy("part").collect()
                sizes = {p["part"]: p["_rows"] for p in parts}  # one number per segment
            else:
                ready, parts = dense_numbers(ready, order, "row", folder.at(aside + "/sorted"), measures)
                total = sum(p["_rows"] for p in parts)
                many = segment_rows or max(1, total)
                sizes = {k: min(many, total - k * many) for k in range(-(-total // many))}
                ready = ready.withColumn("part", F.floor(F.col("row") / many).cast("long")).withColumn("row", F.col("row") % many)
            for p in parts:
                if p["lost"]:
                    said = "_problem" in source.columns and source.where(F.col("_problem").isNotNull() & F.col("id").eqNullSafe(F.lit(p["bad"]))).first()
                    raise StoreError(f"row {p['bad']}: {said and said['_problem']}")
            rows, payloads = (sum(p[k] for p in parts) for k in ("_rows", "payloads"))
            if not rows:
                raise StoreError("there is nothing to publish")
            if not numbered or 0 < payloads < rows:
                if numbered:
                    folder.move(aside + "/parts", aside + "/mixed")
                    ready = folder.spark.read.schema(f"{ROWS}, part long").parquet(folder.at(aside + "/mixed"))
                payload = F.coalesce("payload", F.lit("")) if payloads else F.col("payload")  # a segment with payloads has one for each row
                ready.select("part", "row", "id", "vector", payload.alias("payload")).write.options(**PLAIN).partitionBy("part").parquet(folder.at(aside + "/parts"))
            numbers = {k: first + k for k in sizes}
            names = [f"seg-{n:010d}" for n in numbers.values()]
            for k, name in zip(numbers, names):
                for leftover in (name, name + ".graph"):  # of a writer that died before its manifest
                    folder.delete(leftover)
                folder.move(f"{aside}/parts/part={k}", name)
            stored = _files(folder, names)
            written = time.time()
            graphs: dict[int, dict] = {}
            if params is not None:
                source = folder.spark.read.schema(ROWS).parquet(*[folder.at(n) for n in names])
                source = source.select(F.regexp_extract(F.col("_metadata.file_path"), r"/seg-(\d+)", 1).cast("long").alias("segment_id"), "row", "vector")
                hnsw.build_graphs(source, self.config.metric, params).withColumnRenamed("segment_id", "part").write.partitionBy("part").parquet(folder.at(aside + "/graphs"))
                for n, name in zip(numbers.values(), names):
                    folder.move(f"{aside}/graphs/part={n}", name + ".graph")
                made = folder.spark.read.schema(GRAPH).parquet(*[folder.at(n + ".graph") for n in names]).where("node = -1")
                heads = made.select(F.regexp_extract(F.col("_metadata.file_path"), r"/seg-(\d+)", 1).cast("long"), F.col("neighbors")[1]).collect()  # one row per segment
                drawn = _files(folder, [n + ".graph" for n in names])
                graphs = {n: {"m": params.m, "m0": params.m0, "layers": top + 1, "files": drawn[f"seg-{n:010d}.graph"]} for n, top in heads}
            new = []
            for k, name in zip(numbers, names):
                files = stored[name]
                new.append(Segment(numbers[k], name, sizes[k], sum(n for n, _ in files.values()), bool(payloads), graphs.get(numbers[k]), files))
            fresh = {**body, "generation": body["generation"] + 1, "next_segment": max(numbers.values()) + 1, "segments": arrange(body["segments"], [asdict(s) for s in new])}
            if batch:
                fresh["batches"] = {**body["batches"], batch[0]: batch[1]}
            write_manifest(folder, fresh)
        except BaseException:
            for name in names:
                for leftover in (name, name + ".graph"):
                    folder.delete(leftover)
            raise
        finally:
            folder.delete(aside)
        self._body = fresh
        return {
            "path": folder.at(names[0]), "segments": len(new), "rows": rows, "bytes": sum(s.bytes for s in new), "has_graph": params is not None, "write_seconds": written - began, "build_seconds": time.time() - written,
        }

    def compact(self, *, params: hnsw.HnswParams | None = None, segment_rows: int | None = None) -> dict | None:
        """Merge all segments of this moment into one (or into segments of
        ``segment_rows`` rows), first in order; None if there are fewer than two. Rows are copied as they are, in (ordinal, row)
        order, so exact results do not change."""
        with self.writer():
            pinned = self.snapshot()
            if len(pinned.segments) < 2:
                return None
            gone = {s.id for s in pinned.segments}
            return self._write(pinned.rows(), ["ordinal", "row"], params, lambda segments, new: [*new, *[s for s in segments if s["id"] not in gone]], None, segment_rows)

    def vacuum(self) -> list[str]:
        """Delete segment folders that the current manifest does not name."""
        with self.writer():
            live = {s["name"] for s in self._body["segments"]}
            gone = [n for n in self.folder.names() if (m := _NAME.match(n)) and n.removesuffix(".graph") not in live]
            for n in gone:
                self.folder.delete(n)
            return gone


def write_manifest(folder: Folder, body: dict) -> None:
    text = json.dumps(body, sort_keys=True)
    folder.replace(MANIFEST, json.dumps({"crc": zlib.crc32(text.encode()), "body": text}).encode())


def read_manifest(folder: Folder) -> dict:
    if not folder.exists(MANIFEST):
        raise StoreError(f"{folder.root} is not a store")
    try:
        outer = json.loads(folder.read(MANIFEST))
        text = outer["body"]
        if zlib.crc32(text.encode()) != outer["crc"]:
            raise Corrupt("the manifest fails its checksum")
        body = json.loads(text)
        StoreConfig(body["config"]["dim"], body["config"]["metric"], int(body["config"]["fingerprint"], 16))
        for s in body["segments"]:
            if not re.fullmatch(r"seg-\d{10,}", s["name"]) or not 0 < s["id"] < body["next_segment"] or int(s["name"][4:]) != s["id"]:
                raise Corrupt(f"impossible segment {s['name']!r}")
        body.setdefault("batches", {})
        return body
    except (ValueError, KeyError, TypeError) as e:
        raise Corrupt(f"the manifest cannot be read: {e}") from e
