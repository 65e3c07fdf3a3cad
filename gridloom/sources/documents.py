"""A store of JSON documents as a data source with pushed filters and a first-n by a field.

A collection is a folder with one folder of JSON lines a partition (``<path>/<field>=<value>/...``, or files directly). The reader
takes comparisons of top-level fields, leaves out whole partitions by their value, tests the other documents before they reach
Spark, and with ``order`` and ``first`` hands on only the ``first`` documents of each partition by that field,
largest first (ties: by ``id``), so that a final sort sees as many as there are partitions. What it does not take, Spark
tests; then nothing is cut off. Filters reach the reader where ``spark.sql.python.filterPushdown.enabled`` is true as it is made.

Documents without the ``order`` field come last; a line that is no JSON object is an error with its file named.
"""

from __future__ import annotations

import heapq
import json
import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


@dataclass
class Folder(InputPartition):
    path: str
    fields: dict


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _children(path: str) -> list:
    from pyarrow import fs

    files, root = _opened(path)
    found = files.get_file_info(fs.FileSelector(root.rstrip("/"), allow_not_found=True))
    return sorted((x for x in found if not x.base_name.startswith(("_", "."))), key=lambda x: x.base_name)


def _holds(test: Filter, document: dict) -> bool:
    value = document.get(test.attribute[0])
    if value is None:
        return False
    if isinstance(test, IsNotNull):
        return True
    if isinstance(test, In):
        return value in test.value
    return _COMPARE[type(test)](value, test.value)


class StoreReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, order: str | None, first: int | None):
        self.path, self.schema, self.order, self.first = path.rstrip("/"), schema, order, first
        self.tests: list[Filter] = []

    def partitions(self) -> list[Folder]:
        from pyarrow import fs

        kinds = {f.name: f.dataType for f in self.schema.fields}
        out = []
        for child in _children(self.path):
            name, _, value = child.base_name.partition("=")
            fields = {}
            if child.type == fs.FileType.Directory and name in kinds:
                fields = {name: int(value) if isinstance(kinds[name], (T.LongType, T.IntegerType)) else value}
            if all(_holds(test, fields) for test in self.tests if test.attribute[0] in fields):
                out.append(Folder(f"{self.path}/{child.base_name}", fields))
        return out

    def _documents(self, part: Folder) -> Iterator[dict]:
        files, root = _opened(part.path)
        inside = _children(part.path) if not files.get_file_info(root).is_file else None
        for name in [root] if inside is None else [x.path for x in inside]:
            with files.open_input_stream(name) as raw:
                rest = b""
                while True:
                    block = raw.read(1 << 20)
                    *whole, rest = (rest + block).split(b"\n")
                    for line in whole if block else [rest]:
                        if line.strip():
                            try:
                                yield dict(json.loads(line)) | part.fields
                            except (ValueError, TypeError) as e:
                                raise ValueError(f"{name}: a line is no JSON object") from e
                    if not block:
                        break

    def read(self, partition: Folder | None) -> Iterator[tuple]:
        found = (d for d in self._documents(partition) if all(_holds(t, d) for t in self.tests)) if partition is not None else iter(())
        if self.first is not None and self.order:
            rank = lambda d: (d.get(self.order) is None, -(d.get(self.order) or 0), str(d.get("id")))
            found = heapq.nsmallest(self.first, found, key=rank)
        cast = {T.DoubleType: float, T.LongType: int, T.IntegerType: int}
        for d in found:
            yield tuple(None if (v := d.get(f.name)) is None else cast.get(type(f.dataType), lambda x: x)(v) for f in self.schema.fields)


class PushedStoreReader(StoreReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        plain = {f.name for f in self.schema.fields if isinstance(f.dataType, (T.StringType, T.LongType, T.IntegerType, T.DoubleType, T.BooleanType))}
        for test in filters:
            if isinstance(test, (In, IsNotNull, *_COMPARE)) and len(test.attribute) == 1 and test.attribute[0] in plain:
                self.tests.append(test)
            else:
                self.first = None  # Spark tests more, so no partition may stop at its first documents
                yield test


class DocumentStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_store"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        if not self.options.get("path"):
            raise ValueError("document_store needs a path")
        first = self.options.get("first")
        kind = PushedStoreReader if self.options.get("push") == "true" else StoreReader
        return kind(self.options["path"], schema, self.options.get("order"), None if first is None else int(first))


PUSH = "spark.sql.python.filterPushdown.enabled"


def _reader(spark: SparkSession, path: str, schema: str):
    spark.dataSource.register(DocumentStore)
    return spark.read.format("document_store").schema(schema).option("path", path).option("push", spark.conf.get(PUSH))


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The documents of a collection, with the fields of ``schema``."""
    return _reader(spark, path, schema).load()


def first_documents(spark: SparkSession, path: str, schema: str, order: str, first: int, where: str | None = None) -> DataFrame:
    """The ``first`` documents by a number field, largest first (ties: by ``id``, as text; without the field last).

    Partitions hand on their first documents where there is no ``where`` or the reader tests it; else Spark sorts all.
    """
    reader = _reader(spark, path, schema)
    if where is None or spark.conf.get(PUSH) == "true":
        reader = reader.option("order", order).option("first", first)
    found = reader.load() if where is None else reader.load().where(where)
    return found.orderBy(F.desc_nulls_last(order), F.col("id").cast("string")).limit(first)
