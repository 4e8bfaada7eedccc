"""EPUB archives as spine and item tables.

Archives are untrusted: an entry over ``max_entry`` bytes, or that unpacks to over
``max_ratio`` times its size, is not read (either may be None); nothing is written to
disk but the tables; a document type is read over, but XML that declares entities is
refused, so none is expanded. What cannot be read gives a row in ``errors``: a whole
book, or one item of it, whose other items are there.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import table

MAX_ENTRY = 64 << 20
MAX_RATIO = 200
DOCUMENT = "application/xhtml+xml"
#: Books in folders and globs; a file that is named outright may have any name.
BOOKS = "*.[eE][pP][uU][bB]"
_SCHEMA = "kind string, pos long, item_id string, linear string, name string, media_type string, content binary, error string"


@dataclass(frozen=True)
class Limits:
    max_entry: int | None = MAX_ENTRY
    max_ratio: int | None = MAX_RATIO


@dataclass(frozen=True)
class Books:
    spine: DataFrame
    items: DataFrame
    #: book_id, item_id (null: the whole book), name and error.
    errors: DataFrame


def _entry(z: zipfile.ZipFile, name: str, limits: Limits) -> bytes:
    info = z.getinfo(name)
    most = min(limits.max_entry or info.file_size, (limits.max_ratio or info.file_size) * max(info.compress_size, 1024))
    with z.open(info) as f:
        data = f.read(most + 1)  # whatever size the archive states
    if len(data) > most:
        raise ValueError(f"entry too large: {name}")
    return data


def _xml(data: bytes) -> ElementTree.Element:
    if b"<!ENTITY" in data.replace(b"\0", b""):  # in any encoding that has ASCII's letters
        raise ValueError("XML that declares entities")
    return ElementTree.fromstring(data)


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def read_archive(content: bytes, limits: Limits = Limits()) -> Iterator[dict]:
    """Rows of one archive: its spine, then its document items, in manifest order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        container = _xml(_entry(z, "META-INF/container.xml", limits))
        package = next(e.attrib["full-path"] for e in container.iter() if _local(e) == "rootfile")
        root = _xml(_entry(z, package, limits))
        spine = [e for s in root if _local(s) == "spine" for e in s if _local(e) == "itemref"]
        for pos, e in enumerate(spine, 1):
            yield {"kind": "spine", "pos": pos, "item_id": e.get("idref"), "linear": e.get("linear", "yes")}
        for n, e in enumerate(e for s in root if _local(s) == "manifest" for e in s if _local(e) == "item"):
            if e.get("media-type") == DOCUMENT:
                path = posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(e.get("href", ""))))
                row = {"pos": n, "item_id": e.get("id"), "name": e.get("href")}
                try:
                    yield row | {"kind": "item", "media_type": DOCUMENT, "content": _entry(z, path, limits)}
                except Exception as x:  # noqa: BLE001  one broken item is one error row
                    yield row | {"kind": "error", "error": f"{type(x).__name__}: {x}"}


def read_archives(files: DataFrame, limits: Limits = Limits()) -> Books:
    """The books of ``files(book_id, content)``, unpacked once into a shared table."""
    ship(files.sparkSession)
    files = files.select("book_id", "content")
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [("book_id", batch.schema.field(0).type), *((n, kinds[k]) for n, k in (c.split() for c in _SCHEMA.split(", ")))]
            schema = pa.schema(fields)
            for book, content in zip(*batch.columns, strict=True):
                try:
                    if not content.is_valid:
                        raise ValueError("no content")
                    for row in read_archive(content.as_py(), limits):
                        yield pa.RecordBatch.from_pylist([{"book_id": book.as_py()} | row], schema)
                except Exception as e:  # noqa: BLE001  one broken archive is one error row
                    yield pa.RecordBatch.from_pylist([{"book_id": book.as_py(), "kind": "broken", "error": f"{type(e).__name__}: {e}"}], schema)

    kind = files.schema["book_id"].dataType.simpleString()
    rows = table(files.mapInArrow(run, f"book_id {kind}, {_SCHEMA}"), "books")
    # a book that breaks off has no items, only its error
    broken = rows.where("kind = 'broken'").select("book_id")
    whole = rows.join(broken, "book_id", "left_anti")
    return Books(
        whole.where("kind = 'spine'").select("book_id", "pos", "item_id", "linear"),
        whole.where("kind = 'item'").select("book_id", "item_id", "name", "content", F.col("pos").alias("ord")),
        rows.where("kind = 'broken' or kind = 'error'").select("book_id", "item_id", "name", "error"),
    )


def _literal(path: str) -> str:
    """A path as a glob that only it matches."""
    return "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in path)


def _is_file(spark: SparkSession, path: str) -> bool:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    except Exception:  # noqa: BLE001  no such file, or no such path: it may be a glob
        return False
    return found.isFile()


def read_books(spark: SparkSession, paths: str | Sequence[str], partitions: int | None = None, limits: Limits = Limits()) -> Books:
    """The books at ``paths``: files of any name, folders, or globs that Spark can read.

    With ``partitions``, archives are dealt to so many tasks; else as Spark splits files."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    named = [_literal(p) for p in paths if _is_file(spark, p)]
    others = [p for p in paths if not _is_file(spark, p)]
    binary = lambda some, **options: spark.read.format("binaryFile").options(**options).load(some).select(F.col("path").alias("book_id"), "content")
    parts = ([binary(named)] if named else []) + ([binary(others, pathGlobFilter=BOOKS)] if others else [])
    if not parts:
        parts = [spark.createDataFrame([], "book_id string, content binary")]
    files = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return read_archives(files.repartition(partitions) if partitions else files, limits)
