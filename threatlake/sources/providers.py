"""Reputation providers as a Spark data source: ``spark.read.format("threat_intel").load(path)``.

A provider is a Parquet table of JSON documents (columns ``kind``: ip, domain or hash, and ``document``: an object of
indicator -> entry). Its rows have the reputation schema, so every lookup takes the frame as it is; ``sources.intel.conform``
leaves one row per indicator. Another provider is another ``IntelReader`` under another name.
"""

from __future__ import annotations

import ipaddress
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from threatlake.contracts import INTEL_SCHEMA

#: Indicator types that documents of a kind can hold.
KINDS = {"ip": ("IPv4", "IPv6"), "domain": ("Domain",), "hash": ("Hash",)}
#: Rows of a batch; a document may hold more.
BATCH_ROWS = 10_000


@dataclass
class DocumentPart(InputPartition):
    """One row group of one file."""

    path: str
    group: int


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def document_rows(kind: str, document: str | None) -> Iterator[tuple]:
    """Rows of a document in the order of ``INTEL_SCHEMA``; none if it isn't an object or its kind is unknown.

    Without a reputation or a confidence an indicator is UNKNOWN and 0; a confidence that is no number counts as absent.
    """
    try:
        found = json.loads(document or "")
    except ValueError:
        return
    if kind == "hash" and isinstance(found, dict) and isinstance(found.get("known_hashes"), dict):
        found = found["known_hashes"]
    if not isinstance(found, dict) or kind not in KINDS:
        return
    for value, entry in found.items():
        entry = entry if isinstance(entry, dict) else {}
        sure, kinds = entry.get("confidence"), entry.get("categories")
        yield (
            _address_type(value) if kind == "ip" else KINDS[kind][0], value, _text(entry.get("reputation")) or "UNKNOWN",
            float(sure) if isinstance(sure, (int, float)) and not isinstance(sure, bool) else 0.0, _text(entry.get("source")),
            [_text(k) for k in kinds] if isinstance(kinds, list) else None, _text(entry.get("threat_actor")), _text(entry.get("type")),
        )


def _address_type(value: str) -> str:
    try:
        return f"IPv{ipaddress.ip_address(value).version}"
    except ValueError:
        return "IPv4"


class IntelReader(DataSourceReader):
    """A partition per row group; ``types`` are the indicator types to read, None for all.

    The types are an option, not a pushed filter: Spark 4.1 plans all scans of one frame with the filters pushed last,
    so a frame that is filtered in two ways within a query would lose rows. Documents of other kinds aren't parsed.
    """

    def __init__(self, path: str, types: set[str] | None = None) -> None:
        self.path, self.types = path, types

    def partitions(self) -> list[DocumentPart]:
        files, root = _opened(self.path)
        listed = files.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
        parts = sorted(i.path for i in listed if i.is_file and i.size and not i.base_name.startswith(("_", ".")))
        found = []
        for name in parts:
            with files.open_input_file(name) as f:
                found += [DocumentPart(name, g) for g in range(pq.ParquetFile(f).num_row_groups)]
        return found

    def read(self, partition: DocumentPart | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a provider without documents
            return
        schema = to_arrow_schema(INTEL_SCHEMA)
        types = self.types
        files, _ = _opened(self.path)
        with files.open_input_file(partition.path) as f:
            table = pq.ParquetFile(f)
            rows: list[tuple] = []
            # few documents at a time: one may hold many indicators
            for batch in table.iter_batches(batch_size=16, row_groups=[partition.group], columns=["kind", "document"]):
                for kind, document in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if types is not None and types.isdisjoint(KINDS.get(kind, ())):
                        continue
                    for row in document_rows(kind, document):
                        if types is None or row[0] in types:
                            rows.append(row)
                        if len(rows) == BATCH_ROWS:
                            yield _batch(rows, schema)
                            rows = []
            if rows:
                yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class IntelSource(DataSource):
    """``threat_intel``; option ``path`` is a folder that driver and executors reach (local, ``file:`` or a URI pyarrow
    knows), ``types`` the indicator types wanted, comma-joined."""

    @classmethod
    def name(cls) -> str:
        return "threat_intel"

    def schema(self) -> StructType:
        return INTEL_SCHEMA

    def reader(self, schema: StructType) -> IntelReader:
        types = self.options.get("types")
        return IntelReader(self.options["path"], set(types.split(",")) if types else None)


def register(spark: SparkSession) -> None:
    """Make the providers known to a session."""
    spark.dataSource.register(IntelSource)
