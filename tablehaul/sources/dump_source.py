"""Dumps as a Spark data source: ``spark.read.format("sqldump").option("table", "orders").load(folder)``.

    spark.dataSource.register(DumpSource)
    orders = spark.read.format("sqldump").option("table", "orders").load("/dumps")
    few = spark.read.format("sqldump").schema("o_orderkey bigint, o_comment string").option("table", "orders").load("/dumps")

The schema is that of the table's ``CREATE TABLE``. One that the caller gives chooses columns by name: only these are captured from
a row, converted and sent to the JVM. Lines of other tables are left in the reader. Plain files are cut into ranges of
``splitBytes``, whose lines belong to the range they start in; a gzip file with an index beside it (``write_indexed``) is cut into
runs of its blocks; any other gzip file is one task. A task holds one line and a batch of rows.

Options: ``table`` (needed where the dump creates several), ``ddl`` (the ``CREATE TABLE`` text, where the files' beginnings lack it),
``splitBytes``. Only the text before a file's first row statement is searched for DDL, by the driver, file by file until it is found.

Whole or not at all, as with ``read_dump``: a line that is not understood, a row with another number of fields or a value that its
type cannot hold fails the job. Statements over several lines, ``USE`` of a second database and rows that name a database
need ``restore_whole``. Nested columns are read from their JSON where their leaves are numbers, text or booleans; with others
inside, choose the column as ``string``. An empty folder fails (no table is created); a table without rows is empty.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_type

from tablehaul.functions.sqltext import COMMON_UNESCAPES, KEPT, NESTED, RARE_UNESCAPES
from tablehaul.sources.ddl import parse_create_table
from tablehaul.sources.dump_reader import HIDDEN_ROWS, INSERT_HEAD, OTHER_LINE, PROBLEM_COLUMNS, PROBLEM_LINE, PROBLEM_VALUE
from tablehaul.sources.files import _system, open_bytes
from tablehaul.sources.indexed_gzip import INDEX, inflated

SPLIT_BYTES = 64 << 20
BATCH_ROWS = 4096
BATCH_CHARS = 4 << 20
_PIECE = 1 << 20

_FIELD = r"(?:_binary\s+)?'(?:[^'\\]++|\\.|'')*+'|[^',()\s]++"
_ESCAPES = dict([*COMMON_UNESCAPES, *RARE_UNESCAPES, ("\\0", "\0"), *((kept, kept) for kept in KEPT)])
_CREATE = re.compile(r"(?im)^[ \t]*CREATE\s+TABLE\b")
_CREATE_END = re.compile(r"(?m);[ \t\r]*$")


class Part(InputPartition):
    """A range of a file: bytes of a plain one, whole blocks (or all, ``end`` None) of a gzip one."""

    def __init__(self, file: str, start: int, end: int | None):
        super().__init__((file, start, end))
        self.file, self.start, self.end = file, start, end


def _files(path: str) -> list[tuple[str, int]]:
    """Files with their sizes, by name; hidden and empty ones are not listed."""
    from pyarrow import fs

    system, root = _system(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)] if info.size else []
    prefix = path.rstrip("/")
    found = []
    for one in system.get_file_info(fs.FileSelector(root, recursive=True)):
        below = one.path[len(root.rstrip("/")) + 1 :]
        if one.type == fs.FileType.File and one.size and not re.search(r"(?:^|/)[._]", below):
            found.append((f"{prefix}/{below}", one.size))
    return sorted(found)


def _blocks(folder: str) -> dict[str, list[tuple[int, int]]]:
    """Places of the blocks of a folder's gzip files, as their index has them."""
    from pyarrow import fs
    from pyarrow import parquet

    system, root = _system(f"{folder}/{INDEX}")
    if system.get_file_info(root).type != fs.FileType.Directory:
        return {}
    rows = parquet.read_table(root, filesystem=system, columns=["file", "start", "length"]).to_pylist()
    places: dict[str, list[tuple[int, int]]] = {}
    for row in sorted(rows, key=lambda r: (r["file"], r["start"])):
        places.setdefault(row["file"], []).append((row["start"], row["length"]))
    return places


def _pieces(part: Part) -> Iterator[bytes]:
    """Text of a part. That of a plain range goes on to the end of the line that its end falls in."""
    with open_bytes(part.file) as source:
        source.seek(part.start)
        if part.file.lower().endswith(".gz"):
            for piece, _ in inflated(source, None if part.end is None else part.end - part.start):
                yield piece
            return
        at = part.start
        if at:  # a line that starts before the range belongs to the range before
            at -= 1
            source.seek(at)
            while (piece := source.read(_PIECE)) and b"\n" not in piece:
                at += len(piece)
            at += piece.find(b"\n") + 1
            source.seek(at)
        ended = True
        while at < part.end and (piece := source.read(min(_PIECE, part.end - at))):
            at += len(piece)
            ended = piece.endswith(b"\n")
            yield piece
        while not ended and (piece := source.read(_PIECE)):
            end = piece.find(b"\n") + 1
            yield piece[:end] if end else piece
            ended = end > 0


def _lines(part: Part) -> Iterator[str]:
    open_line: list[bytes] = []
    for piece in _pieces(part):
        first, *others = piece.split(b"\n")
        open_line.append(first)
        for line in others:
            yield b"".join(open_line).decode("utf-8")
            open_line = [line]
    if any(open_line):
        yield b"".join(open_line).decode("utf-8")


def _creates(file: str) -> dict[str, T.StructType]:
    """Tables that a file creates before its first row statement."""
    head, text = re.compile(INSERT_HEAD), []
    for line in _lines(Part(file, 0, None if file.lower().endswith(".gz") else 1 << 62)):
        if head.match(line):
            break
        text.append(line)
    whole, found = "\n".join(text), {}
    for begin in _CREATE.finditer(whole):
        end = _CREATE_END.search(whole, begin.start())
        name, schema = parse_create_table(whole[begin.start() : end.end() if end else len(whole)])
        found[name] = schema
    return found


def _unescape(inside: str) -> str:
    if "\\" not in inside:
        return inside.replace("''", "'")
    return re.sub(r"(?s)\\.|''", lambda m: _ESCAPES.get(m[0], m[0][-1]), inside)


def _text(token: str) -> str:
    if token.startswith("'"):
        return _unescape(token[1:-1])
    if token[0] in "+-.0123456789":
        return token
    raise ValueError(token)


def _bytes(token: str) -> bytes:
    if token[:2].lower() == "0x":
        return bytes.fromhex(token[2:])
    return _text(re.sub(r"(?i)^_binary\s+", "", token)).encode()


def _nested(value, dtype: T.DataType):
    """A parsed JSON value as Arrow takes it: maps as pairs."""
    if value is None:
        return None
    if isinstance(dtype, T.ArrayType):
        return [_nested(v, dtype.elementType) for v in value]
    if isinstance(dtype, T.MapType):
        key = (lambda k: k) if isinstance(dtype.keyType, T.StringType) else json.loads
        return [(key(k), _nested(v, dtype.valueType)) for k, v in value.items()]
    if isinstance(dtype, T.StructType):
        return {f.name: _nested(value.get(f.name), f.dataType) for f in dtype.fields}
    return value


def _array(tokens: list[str], field: T.StructField) -> pa.Array:
    """One column of a batch; each value that is not NULL must fit."""
    dtype, arrow = field.dataType, to_arrow_type(field.dataType)
    some = [None if len(t) == 4 and t.upper() == "NULL" else t for t in tokens]
    if isinstance(dtype, T.BinaryType):
        return pa.array([None if t is None else _bytes(t) for t in some], arrow)
    if isinstance(dtype, NESTED):
        return pa.array([None if t is None else _nested(json.loads(_text(t)), dtype) for t in some], arrow)
    if isinstance(dtype, T.StringType) or dtype.typeName() in ("char", "varchar"):
        return pa.array([None if t is None else _text(t) for t in some], arrow)
    bare = pa.array([t[1:-1] if t is not None and t.startswith("'") else t for t in some], pa.string())
    if isinstance(dtype, T.BooleanType):
        return pc.not_equal(bare.cast(pa.int64()), 0)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return bare.cast(pa.timestamp("us")).cast(arrow)
    return bare.cast(arrow)


class DumpReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], wanted: T.StructType, split_bytes: int, alone: bool):
        self.path, self.table, self.wanted, self.split_bytes, self.alone = path, table, wanted, split_bytes, alone
        self.columns = columns
        names = {c.lower(): i for i, c in enumerate(columns)}
        missing = [f.name for f in wanted.fields if f.name.lower() not in names]
        if missing:
            raise ValueError(f"table {table} has no column {', '.join(missing)}")
        self.places = [names[f.name.lower()] for f in wanted.fields]

    def partitions(self) -> list[Part]:
        parts, indexes = [], {}
        for file, size in _files(self.path):
            folder, name = file.rsplit("/", 1)
            if not name.lower().endswith(".gz"):
                parts += [Part(file, at, min(at + self.split_bytes, size)) for at in range(0, size, self.split_bytes)]
                continue
            if folder not in indexes:
                indexes[folder] = _blocks(folder)
            blocks = indexes[folder].get(name)
            if not blocks or sum(blocks[-1]) != size:
                parts.append(Part(file, 0, None))
                continue
            begin = 0
            for start, length in blocks:
                if start + length - begin >= self.split_bytes or start + length == size:
                    parts.append(Part(file, begin, start + length))
                    begin = start + length
        return parts

    def _row(self) -> re.Pattern:
        """One row with what separates it from the next; only the chosen fields are captured."""
        chosen = set(self.places)
        fields = [f"({_FIELD})" if i in chosen else f"(?:{_FIELD})" for i in range(len(self.columns))]
        return re.compile(r"(?s)\s*+\(\s*+" + r"\s*+,\s*+".join(fields) + r"\s*+\)\s*+(?:,|;?\s*+\Z)")

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        head, other, hidden = re.compile(INSERT_HEAD), re.compile(OTHER_LINE), re.compile(HIDDEN_ROWS)
        row = self._row()
        order = sorted(set(self.places))
        at = [order.index(p) for p in self.places]
        listed = [c.lower() for c in self.columns]
        rows: list[tuple[str, ...]] = []
        chars = 0

        def fail(problem: str, text: str):
            raise ValueError(f"dump not understood: {problem} in {partition.file}: {text[:200]}")

        def batch() -> pa.RecordBatch:
            if not self.places:
                return pa.RecordBatch.from_struct_array(pa.array([{}] * len(rows), pa.struct([])))
            tokens, arrays = list(zip(*rows)), []
            for place, field in zip(at, self.wanted.fields):
                try:
                    arrays.append(_array(tokens[place], field))
                except (ValueError, TypeError, AttributeError) as error:
                    fail(f"{PROBLEM_VALUE} {field.name} ({error})", ", ".join(tokens[place][:5]))
            return pa.RecordBatch.from_arrays(arrays, self.wanted.names)

        for line in _lines(partition):
            begin = head.match(line)
            if begin is None:
                if "\0" in line or not other.match(line) or hidden.match(line):
                    fail(PROBLEM_LINE, line)
                continue
            name = begin[1][1:-1].replace("``", "`") if begin[1].startswith("`") else begin[1]
            if name != self.table:
                if self.alone:
                    fail("rows of another table", line)
                continue
            if begin[2]:
                names = [a.replace("``", "`") or b for a, b in re.findall(r"`((?:[^`]|``)+)`|([^\s(),`]+)", begin[2])]
                if [n.lower() for n in names] != listed:
                    fail(PROBLEM_COLUMNS, line)
            place = begin.end()
            while place < len(line):
                found = row.match(line, place)
                if found is None:
                    fail("a row that does not fit the table", line[place:])
                rows.append(found.groups())
                chars += found.end() - place
                place = found.end()
                if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield batch()
                    rows, chars = [], 0
        if rows:
            yield batch()


class DumpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqldump"

    def _created(self) -> tuple[str, T.StructType, bool]:
        """Table and its whole schema, and whether rows of other tables are an error."""
        asked, ddl = self.options.get("table"), self.options.get("ddl")
        if ddl is not None:
            name, schema = parse_create_table(ddl)
            return asked or name, schema, asked is None
        seen: dict[str, T.StructType] = {}
        for file, _ in _files(self.options["path"]):
            created = _creates(file)
            if asked in created:
                return asked, created[asked], False
            for name, schema in created.items():
                if seen.setdefault(name, schema) != schema:
                    raise ValueError(f"table {name} is created in two ways")
            if asked is None and len(seen) > 1:
                raise ValueError(f"several tables, name one of them by the option table: {', '.join(sorted(seen))}")
        if asked is not None or not seen:
            raise ValueError(f"no CREATE TABLE{f' for {asked}' if asked else ''} before the first rows of a file; give it by the option ddl")
        return *next(iter(seen.items())), True

    def schema(self) -> T.StructType:
        return self._created()[1]

    def reader(self, schema: T.StructType) -> DumpReader:
        table, whole, alone = self._created()
        split = int(self.options.get("splitBytes", SPLIT_BYTES))
        if split < 1:
            raise ValueError("splitBytes must be at least 1")
        return DumpReader(self.options["path"], table, whole.names, schema, split, alone)
