"""Finding and reading text files.

Spark's own listing hides names that begin with ``_`` or ``.``, which are files
like any other here, so the tree is walked on the driver (names only) and the
files are then read by their explicit paths on the executors.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import IngestError
from ..functions.text import EXTENSIONS

# Names of folders that are left out.
SKIPPED_FOLDERS = frozenset(("__pycache__", "dist", "node_modules", "target", "venv"))
MAX_FILE_BYTES = 16 << 20
#: Files are read into batches that end with the one that reaches so many bytes.
READ_BYTES = 1 << 20


@dataclass
class Discovery:
    files: list[tuple[str, str]] = field(default_factory=list)  # path, kind
    skipped: int = 0  # too large


def kind_of(path: str) -> str | None:
    """As functions.text.source_kind, for one path."""
    stem, dot, ext = os.path.basename(path).rpartition(".")
    return EXTENSIONS.get(ext.lower()) if stem and dot else None


def discover(roots: list[str], *, max_file_bytes: int = MAX_FILE_BYTES) -> Discovery:
    """Supported files below ``roots`` in path order, each once. Folders that are
    hidden or on the skip list are left out below a root, links everywhere; a
    root that does not exist is an error."""
    found: dict[str, str] = {}
    out = Discovery()

    def consider(path: str, size: int) -> None:
        kind = kind_of(path)
        if kind and size > max_file_bytes:
            out.skipped += 1
        elif kind:
            found[path] = kind

    for root in map(os.fspath, roots):
        try:
            if os.path.isfile(root):
                consider(root, os.path.getsize(root))
                continue
            todo = [root]
            while todo:
                with os.scandir(todo.pop()) as entries:
                    for e in entries:
                        if e.is_dir(follow_symlinks=False):
                            if not e.name.startswith(".") and e.name not in SKIPPED_FOLDERS:
                                todo.append(e.path)
                        elif e.is_file(follow_symlinks=False):
                            consider(e.path, e.stat(follow_symlinks=False).st_size)
        except OSError as e:
            raise IngestError(f"{e.filename or root}: {e.strerror}") from e
    # By components: a/b comes before a-b.
    out.files = sorted(found.items(), key=lambda x: x[0].split("/"))
    return out


def _open(path: str) -> bytes | None:
    """Bytes of a file on a mount that all executors share, or by URI; None if unreadable."""
    try:
        if "://" in path:
            from pyarrow import fs

            system, inner = fs.FileSystem.from_uri(path)
            with system.open_input_stream(inner) as f:
                return f.read()
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None


def _utf8(raw: bytes | None) -> str | None:
    try:
        return None if raw is None else raw.decode()
    except UnicodeDecodeError:
        return None


def _read(stream):
    def made(rows):
        types = (pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["path", "kind", "n_bytes", "text"])

    for batch in stream:
        held, size = [], 0
        for path, kind, file in zip(*(batch.column(c).to_pylist() for c in range(3))):
            raw = _open(path if "://" in path else file)
            held.append((path, kind, None if raw is None else len(raw), _utf8(raw)))
            size += len(raw or b"")
            if size >= READ_BYTES:  # files may be large
                yield made(held)
                held, size = [], 0
        if held:
            yield made(held)


def read_files(spark: SparkSession, found: Discovery, *, files_per_task: int = 256) -> DataFrame:
    """path, kind, n_bytes, text for every file; text is null if it cannot be
    read or is not UTF-8. Spark's own file sources are not used, as they leave
    out names that begin with an underscore or a dot."""
    schema = "path string, kind string, n_bytes long, text string"
    if not found.files:
        return spark.createDataFrame([], schema)
    names = spark.createDataFrame([(p, k, os.path.abspath(p)) for p, k in found.files], "path string, kind string, file string")
    return names.repartition(max(1, len(found.files) // files_per_task)).mapInArrow(_read, schema)


def write_files(rows: DataFrame, root: str) -> None:
    """Every row of ``rows`` (path, text) as a file below ``root``, a folder on a
    mount that all executors share. A file is moved into place when it is whole, so
    a task that runs again leaves the same files."""

    def run(stream):
        for batch in stream:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = os.path.join(root, path)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                aside = f"{at}.{uuid.uuid4().hex}.part"
                with open(aside, "wb") as f:
                    f.write((text or "").encode())
                os.replace(aside, at)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    rows.select("path", "text").mapInArrow(run, "files long").agg({"files": "sum"}).collect()
