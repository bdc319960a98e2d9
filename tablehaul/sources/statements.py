"""Dump text to whole statements, wherever lines, comments and splits of a file cut them.

A small state machine walks the lines of a split: inside a string, a quoted name or a comment or not, inside an
executable comment or not, what ends a statement (``DELIMITER``), and the database in use. What a split does to the state
is its effect. A file that is read as one split begins in the initial state; of files in several splits the
effects are found first, for every state a split may begin in where one does not begin plainly,
and are composed in order; so each split is then walked once, from the state it really begins in. Of a file's splits one
small row each reaches the driver; text does not.

Comments are left out of the statements, executable comments (``/*! ... */``) are code, and a double-quoted string
becomes a single-quoted one. A statement that a split's end cuts leaves as fragments, which ``joined`` puts together.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A whole statement on one line, in the initial state: plain text, strings, quoted names, nothing that begins a comment.
_SIMPLE = re.compile(
    r"""(?:[^'"`#/;\\-]++|'(?:[^'\\]++|\\.)*+'|`[^`]*+`|-(?!-)|/(?!\*))++;[ \t\r]*""", re.S
)
_DELIMITER = re.compile(r"(?i)\s*delimiter\s+(\S+)")
_USE = re.compile(r"(?is)use\s+(?:`((?:[^`]|``)+)`|(\S+))\s*$")
_CURRENT = re.compile(r"(?i)^--\s+Current Database:\s*`((?:[^`]|``)+)`")
_INSIDE = {
    "'": re.compile(r"(?:[^'\\]++|\\.|\\$)*+", re.S),
    '"': re.compile(r'(?:[^"\\]++|\\.|\\$|"")*+', re.S),
    "`": re.compile(r"[^`]*+"),
}
COMMENT = "*"
MODES = ("", "'", '"', "`", COMMENT)


@dataclass(frozen=True)
class State:
    """Where a line begins. ``mode``: the quote that is open, ``COMMENT``, or nothing."""

    mode: str = ""
    executable: bool = False
    delimiter: str = ";"
    open: bool = False  # a statement has begun
    database: str | None = None


_TOKENS: dict[str, re.Pattern] = {}


def _token(delimiter: str) -> re.Pattern:
    if delimiter not in _TOKENS:
        _TOKENS[delimiter] = re.compile(rf"['\"`]|--(?=\s|$)|#|/\*M?!\d*|/\*|\*/|{re.escape(delimiter)}")
    return _TOKENS[delimiter]


class Scanner:
    """Takes lines, gives statements. ``parts`` is the text of the statement that is open."""

    def __init__(self, state: State = State()):
        self.state = state
        self.parts: list[str] = []
        self.continued = state.open  # the open statement began before this scanner

    def line(self, text: str) -> Iterator[tuple[str, str | None, bool]]:
        """Statements that end in this line: text, database, whether they began before the scanner did."""
        s = self.state
        if not s.open and not s.mode and not s.executable:
            found = _DELIMITER.match(text)
            if found:
                self.state = replace(s, delimiter=found[1])
                return
            if s.delimiter == ";" and _SIMPLE.fullmatch(text):
                yield from self._ended([text.rstrip()[:-1]])
                return
            found = _CURRENT.match(text)
            if found:
                self.state = replace(s, database=found[1].replace("``", "`"))
                return
        mode, executable, delimiter = s.mode, s.executable, s.delimiter
        token, parts, at = _token(delimiter), self.parts, 0
        while at <= len(text):
            if mode == COMMENT:
                end = text.find("*/", at)
                if end < 0:
                    break
                mode, at = "", end + 2
                parts.append(" ")
                continue
            if mode:
                end = _INSIDE[mode].match(text, at).end()
                inside = text[at:end]
                parts.append(inside.replace('""', '"').replace("'", "''") if mode == '"' else inside)
                if end == len(text):
                    break
                parts.append("'" if mode == '"' else mode)
                mode, at = "", end + 1
                continue
            found = token.search(text, at)
            if not found:
                parts.append(text[at:])
                break
            what, before = found[0], text[at : found.start()]
            parts.append(before)
            at = found.end()
            if what in _INSIDE:
                parts.append("'" if what == '"' else what)
                mode = what
            elif what == delimiter:
                self.state = State("", executable, delimiter, False, self.state.database)
                yield from self._ended(parts)
                parts = self.parts
            elif what in ("--", "#"):
                break
            elif what == "/*":
                mode = COMMENT
            elif what == "*/":
                parts.append(" " if executable else what)
                executable = False
            else:
                executable = True
                parts.append(" ")
        parts.append("\n")
        begun = self.continued or bool(mode in _INSIDE) or any(not p.isspace() for p in parts if p)
        if not begun:
            parts.clear()
        self.state = State(mode, executable, delimiter, begun, self.state.database)

    def _ended(self, parts: list[str]) -> Iterator[tuple[str, str | None, bool]]:
        text, continued = "".join(parts).strip(), self.continued
        self.parts, self.continued = [], False
        used = _USE.match(text) if not continued else None
        if used:
            self.state = replace(self.state, database=(used[1] or used[2]).replace("``", "`"))
        elif text or continued:
            yield text, self.state.database, continued


def effect(lines: Iterable[str], begin: State) -> State:
    """The state after the lines."""
    scanner = Scanner(begin)
    for text in lines:
        for _ in scanner.line(text):
            pass
        scanner.parts = scanner.parts and ["x"]  # whether a statement is open is all that matters here
    return scanner.state


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their split. Only a line feed ends a line, so that strings keep their carriage returns."""
    places = ("file_path", "file_block_start", "file_block_length", "file_size")
    names = ("file", "start", "length", "size")
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    return lines.select("value", *(F.col(f"_metadata.{p}").alias(n) for p, n in zip(places, names)))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int, int], list[str]]]:
    """Runs of lines of one split, in order; a split may come in several runs."""
    for batch in batches:
        values = batch.column(0).to_pylist()
        ends = [batch.column(i).to_pylist() for i in range(1, 5)]
        begin = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or any(e[i] != e[begin] for e in ends[:2]):
                yield tuple(e[begin] for e in ends), values[begin:i]
                begin = i


_STATE = "mode string, executable boolean, delimiter string, open boolean, database string"


def _row(state: State) -> tuple:
    return state.mode, state.executable, state.delimiter, state.open, state.database


def _effects(lines: DataFrame, begins: list[State], only: set[str] | None = None) -> DataFrame:
    """file, start, which (of ``begins``) and the state after each split of files in several splits.

    Files are chosen inside the tasks: a filter would have fewer files read, and these cut elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, scanners = None, []

        def out() -> pa.RecordBatch:
            rows = [(at[0], at[1], i, *_row(s.state)) for i, s in enumerate(scanners)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.string()]
        names = ["file", "start", "which", *(c.split()[0] for c in _STATE.split(", "))]
        for split, values in _splits(batches):
            if split[2] >= split[3] or (only is not None and split[0] not in only):
                continue
            if split != at:
                if at:
                    yield out()
                at, scanners = split, [Scanner(b) for b in begins]
            for scanner in scanners:
                for text in values:
                    for _ in scanner.line(text):
                        pass
                    scanner.parts = scanner.parts and ["x"]
        if at:
            yield out()

    return lines.mapInArrow(run, f"file string, start long, which int, {_STATE}")


def entries(lines: DataFrame) -> dict[tuple[str, int], State]:
    """The states in which splits begin, where that is not the initial state."""
    found: dict[tuple[str, int], dict[State, State]] = {}
    begins = [State()]

    def learn(of: DataFrame) -> None:
        for r in of.collect():
            found.setdefault((r.file, r.start), {})[begins[r.which]] = State(r.mode, r.executable, r.delimiter, r.open, r.database)

    def composed() -> tuple[dict[tuple[str, int], State], set[str]]:
        out, unknown, state = {}, set(), State()
        for i, (file, start) in enumerate(places := sorted(found)):
            if i == 0 or places[i - 1][0] != file:
                state = State()
            if file in unknown:
                continue
            out[file, start] = state
            after = found[file, start].get(replace(state, database=None))
            if after is None:
                unknown.add(file)
            else:
                state = replace(after, database=after.database or state.database)
            if state.mode and not state.open and file not in unknown and (i + 1 == len(places) or places[i + 1][0] != file):
                raise ValueError(f"{file} ends inside a comment")
        return out, unknown

    learn(_effects(lines, begins))
    out, unknown = composed()
    if unknown:
        # Some split of these files begins inside something: all their effects, for every state there may be.
        delimiters = sorted({s.delimiter for k, v in found.items() if k[0] in unknown for s in v.values()} | {";"})
        begins = [State(m, e, d, o) for m in MODES for e in (False, True) for d in delimiters for o in (False, True)]
        learn(_effects(lines, begins, unknown))
        out, unknown = composed()
        if unknown:
            raise ValueError(f"statements of {sorted(unknown)[:3]} could not be told apart")
    return {place: state for place, state in out.items() if state != State()}


def _may_split(spark: SparkSession, lines: DataFrame) -> bool:
    """Whether a file may be read in several splits: one that is not compressed and longer than the smallest split."""
    least = [spark.conf.get(f"spark.sql.files.{k}").lower().rstrip("b") for k in ("openCostInBytes", "maxPartitionBytes")]
    files = lines.inputFiles()
    if not any(not f.lower().endswith(".gz") for f in files):
        return False
    sizes = spark.read.format("binaryFile").load([f for f in files if not f.lower().endswith(".gz")]).select("length")
    smallest = min(int(n) if n.isdigit() else 0 for n in least)
    return (sizes.agg(F.max("length")).first()[0] or 0) > smallest


SCHEMA = "file string, start long, no long, database string, text string, fragment long, unfinished boolean"


def statements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, start and no (the place), database, text of every statement.

    ``fragment`` is null for whole statements, 0 for a part that begins one which the split's end cuts, 1 for a part that goes on
    or ends (``no`` is -1 then) one from a split before. ``unfinished``: the text ends inside a string, name or comment.
    """
    lines = read_text(spark, path)
    known = entries(lines) if _may_split(spark, lines) else {}
    last = 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, scanner, no, rows, held = None, None, 0, [], 0
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal rows, held
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
            rows, held = [], 0

        def finish() -> None:
            s = scanner.state
            one = at[2] >= at[3]
            if not s.open and not (s.mode and one):
                return
            text = "".join(scanner.parts)
            rows.append((at[0], at[1], last, s.database, text.strip() if one else text, None if one else int(scanner.continued), bool(s.mode) or s.executable))

        for split, values in _splits(batches):
            if split != at:
                if at:
                    finish()
                at, scanner, no = split, Scanner(known.get(split[:2], State())), 0
            for value in values:
                for text, database, continued in scanner.line(value):
                    rows.append((at[0], at[1], -1 if continued else no, database, text, 1 if continued else None, False))
                    no += 1
                    held += len(text)
                if held > 1 << 22 or len(rows) > 1 << 14:
                    yield from out()
        if at:
            finish()
        yield from out()

    return lines.mapInArrow(run, SCHEMA)


def joined(fragments: DataFrame) -> DataFrame:
    """Whole statements from the rows whose ``fragment`` is not null.

    Within a file, in order: a part that begins a statement (fragment 0), any that pass through, the one that ends it.
    """

    def glue(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["start"], r["no"]))
        out: list[dict] = []
        for r in rows:
            if r["fragment"] == 0 or not out:
                out.append(r | {"parts": [r["text"]]})
            else:
                out[-1]["parts"].append(r["text"])
                out[-1]["unfinished"] = r["unfinished"]
        whole = [r | {"text": "".join(r.pop("parts")).strip(), "fragment": None} for r in out]
        return pa.Table.from_pylist(whole, schema=group.schema)

    return fragments.groupBy("file").applyInArrow(glue, SCHEMA)
