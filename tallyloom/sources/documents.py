"""A document store as a Spark data source: collections of JSON documents in a folder that driver and executors share.

A collection is files of JSON lines and a list of them for each committed write, with the least and greatest values of
each file's plain columns. A scan plans a partition for each file that its pushed filters do not rule out.
"""

from __future__ import annotations

import datetime
import decimal
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import Row, StructType

NAME = "tallyloom.documents"
#: Filters that files are skipped by and documents are tested for: comparison of a value, and of a file's (least, greatest).
_TESTS = {
    EqualTo: (pc.equal, lambda lo, hi, v: lo <= v <= hi),
    GreaterThan: (pc.greater, lambda lo, hi, v: hi > v),
    GreaterThanOrEqual: (pc.greater_equal, lambda lo, hi, v: hi >= v),
    LessThan: (pc.less, lambda lo, hi, v: lo < v),
    LessThanOrEqual: (pc.less_equal, lambda lo, hi, v: lo <= v),
    In: (lambda column, v: pc.is_in(column, value_set=pa.array(v, column.type)), lambda lo, hi, v: any(lo <= x <= hi for x in v)),
    IsNotNull: (lambda column, _: pc.is_valid(column), lambda lo, hi, _: True),
}


def _place(options) -> tuple[FileSystem, str]:
    files, path = FileSystem.from_uri(options["path"])
    return files, f"{path.rstrip('/')}/{options['collection']}"


@dataclass
class File(InputPartition):
    name: str


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema, self.tests = options, schema, []
        self.plain = {f.name for f in schema.fields if f.dataType.typeName() in ("long", "integer", "short", "byte", "double", "float", "string", "boolean")}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in self.plain:
                self.tests.append((f.attribute[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[File]:
        files, folder = _place(self.options)
        lists = [x.path for x in files.get_file_info(FileSelector(folder, allow_not_found=True)) if x.base_name.startswith("_list-")]
        known = [entry for path in sorted(lists) for entry in json.loads(files.open_input_stream(path).read())]
        return [File(entry["name"]) for entry in known if all(self._possible(entry, *test) for test in self.tests)] or [File("")]

    @staticmethod
    def _possible(entry: dict, column: str, kind: type, value) -> bool:
        edges = entry["edges"].get(column)
        return edges is None or (edges[0] is not None and _TESTS[kind][1](*edges, value))

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if partition.name:
            files, folder = _place(self.options)
            schema = to_arrow_schema(self.schema)
            # JSON has neither times nor decimals: they are text there.
            loose = pa.schema([pa.field(f.name, pa.string() if pa.types.is_temporal(f.type) or pa.types.is_decimal(f.type) else f.type) for f in schema])
            table = pj.read_json(files.open_input_stream(f"{folder}/{partition.name}"), parse_options=pj.ParseOptions(explicit_schema=loose, unexpected_field_behavior="ignore"))
            table = table.select(loose.names).cast(schema)
            for column, kind, value in self.tests:
                table = table.filter(pc.fill_null(_TESTS[kind][0](table[column], value), False))
            yield from table.to_batches()


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.options, self.names, self.overwrite = options, schema.names, overwrite
        self.rows = int(options.get("rowsperfile", 50_000))  # Spark gives options in lower case
        self.zoned = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp"]

    def write(self, rows: Iterator[Row]) -> Written:
        files, folder = _place(self.options)
        files.create_dir(folder, recursive=True)
        done, out, edges, n = [], None, {}, 0
        for row in rows:
            if out is None:
                name, edges, n = f"{uuid.uuid4().hex}.json", {c: [None, None] for c in self.names}, 0
                out = files.open_output_stream(f"{folder}/{name}")
            document = row.asDict(recursive=True)
            for c in self.zoned:
                if document[c] is not None:
                    document[c] = document[c].astimezone(datetime.UTC).isoformat(sep=" ")
            out.write((json.dumps(document, default=_text, ensure_ascii=False) + "\n").encode())
            for c in list(edges):
                v = document[c]
                if isinstance(v, (bool, int, float, str)) and v == v:
                    lo, hi = edges[c]
                    edges[c] = [v if lo is None else min(lo, v), v if hi is None else max(hi, v)]
                elif v is not None:
                    del edges[c]  # no plain value, or no number: the file is never skipped by this column
            n += 1
            if n == self.rows:
                out.close()
                done.append({"name": name, "rows": n, "edges": edges})
                out = None
        if out is not None:
            out.close()
            done.append({"name": name, "rows": n, "edges": edges})
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        """Name all files of the write in one list, under another name until it is complete; what was there before goes last."""
        files, folder = _place(self.options)
        files.create_dir(folder, recursive=True)
        before = files.get_file_info(FileSelector(folder)) if self.overwrite else []
        mine = [entry for m in messages if m is not None for entry in m.files]
        name = uuid.uuid4().hex
        with files.open_output_stream(f"{folder}/_new-{name}") as out:
            out.write(json.dumps(mine).encode())
        keep = {entry["name"] for entry in mine}
        old = [x for x in before if x.base_name.startswith("_list-")]
        for x in old:
            files.delete_file(x.path)
        files.move(f"{folder}/_new-{name}", f"{folder}/_list-{name}")
        for x in before:
            if x.base_name not in keep and not x.base_name.startswith("_"):
                files.delete_file(x.path)

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = _place(self.options)
        for m in messages:
            for entry in m.files if m is not None else ():
                files.delete_file(f"{folder}/{entry['name']}")


def _text(value) -> str:
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat(sep=" ") if isinstance(value, datetime.datetime) else value.isoformat()
    if isinstance(value, decimal.Decimal):
        return str(value)
    raise TypeError(f"a document cannot hold {type(value)}")


class DocumentSource(DataSource):
    """Options: path, collection, and rowsPerFile for writes. A scan names its schema; fields that a document lacks are null."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let it see filters."""
    spark.dataSource.register(DocumentSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, collection: str, schema: str | StructType) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).schema(schema).options(path=path, collection=collection).load()


def write(df: DataFrame, path: str, collection: str, mode: str = "append", rows_per_file: int = 50_000) -> None:
    register(df.sparkSession)
    df.write.format(NAME).mode(mode).options(path=path, collection=collection, rowsPerFile=rows_per_file).save()
