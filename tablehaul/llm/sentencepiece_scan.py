"""SentencePiece encoding and decoding, with giant documents encoded in parallel chunks.

The model's merges are a shortest-path problem: a sequence of pieces is the model's encoding if and
only if each two neighbours are what the model makes of their joined text. A lattice of pieces,
in which an edge weighs 0 if the neighbours agree and minus infinity if not, therefore has exactly one
path of weight 0, and it is the encoding. Words of ordinary documents are solved one by one and kept.

A giant document is cut into chunks anywhere, inside words too. A state at a cut is the last piece
that ends at or before it. Each chunk yields a max-plus matrix (here of 0 and minus infinity, so a set
of bits) from states at its beginning to states at its end, without knowing what stands before; the
matrices of neighbours are combined, ``FAN`` at a time and by pairs, until a document has one; its states are then handed
down the same tree, and every chunk is traced by itself between its two states. No more than ``FAN`` small
matrices meet in a task.

Defined results: null texts encode as empty, with no pieces; characters that are no piece become byte
pieces; decoding gives the text back exactly, unless it holds U+2581 itself, which the model reads as
a blank; repeated rows are encoded each; an empty table gives no rows.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.shared import slices, stored, table

BLANK = "▁"
#: Characters of a chunk. Documents up to this length are one chunk.
CHUNK = 1 << 15
#: Words, parts of words and pairs of pieces a task remembers of each; it forgets all when there are more.
REMEMBERED = 1 << 18
#: Matrices that are combined, or given their states, in one task.
FAN = 64
#: Characters of a word up to which merging, whose time grows with the square, is the quicker way to the same pieces.
SHORT = 48
DEFAULT_MODEL = "piece_bpe_32k.model"
NEVER = float("-inf")

_PARTS = re.compile(rf"{BLANK}*\w+|[^\w{BLANK}]+|{BLANK}+")
_WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


@dataclass
class Pieces:
    """A model's pieces, as tasks need them."""

    ids: dict[str, int]  # of ordinary pieces
    score: dict[str, float]
    packed_id: dict[str, bytes]  # as 32-bit numbers
    packed_byte: list[bytes]
    text: pa.Array  # bytes of each id, as decoding sees it
    longest: int
    heads: dict[str, bool]  # all beginnings of pieces, and whether they are pieces themselves
    pairs: frozenset[str]  # all neighbours inside pieces; between any others stands a boundary
    agreed: dict[str, dict[str, bool]] = field(default_factory=dict)  # by left piece, then right
    n_agreed: int = 0
    words: dict[str, bytes] = field(default_factory=dict)
    older: dict[str, bytes] = field(default_factory=dict)
    runs: dict[str, bytes] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"agreed": {}, "n_agreed": 0, "words": {}, "older": {}, "runs": {}}

    def merged(self, text: str) -> list[str]:
        """What the model makes of a short text: best-scored neighbours join first, the leftmost of equals."""
        parts, score = list(text), self.score.get
        of_pair = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while of_pair:
            best = max(of_pair)
            if best == NEVER:
                break
            at = of_pair.index(best)
            joined = parts[at] + parts.pop(at + 1)
            parts[at] = joined
            del of_pair[at]
            if at:
                of_pair[at - 1] = score(parts[at - 1] + joined, NEVER)
            if at < len(of_pair):
                of_pair[at] = score(joined + parts[at + 1], NEVER)
        return parts

    def agree(self, left: str, right: str) -> bool:
        """Whether the model, given both joined, makes just these two."""
        after = self.agreed.get(left)
        known = None if after is None else after.get(right)
        if known is None:
            if self.n_agreed > REMEMBERED:
                self.agreed.clear()
                self.n_agreed = 0
            both = left + right
            known = both not in self.score and self.merged(both) == [left, right]
            self.agreed.setdefault(left, {})[right] = known
            self.n_agreed += 1
        return known

    def packed(self, parts: Iterable[str]) -> bytes:
        """Ids of pieces as 32-bit numbers; a character that is no piece becomes its bytes."""
        known, single = self.packed_id.get, self.packed_byte
        return b"".join([known(p) or b"".join([single[b] for b in p.encode()]) for p in parts])

    def starting(self, text: str, at: int) -> list[str]:
        """The pieces that begin at a place of a text, the longest last."""
        head, out = self.heads.get, [text[at]]
        for end in range(at + 2, min(len(text), at + self.longest) + 1):
            piece = text[at:end]
            whole = head(piece)
            if whole is None:
                break  # nothing longer can be a piece
            if whole:
                out.append(piece)
        return out

    def path(self, text: str, before: str | None = None) -> list[str]:
        """The pieces of the one path of weight 0 through a text, after the piece ``before``.

        Searched depth first, long pieces first. No two paths of weight 0 lead to one place,
        so no place is entered twice.
        """
        out: list[str] = []
        untried: list[list[str]] = []
        at, left = 0, before
        while at < len(text):
            if len(untried) == len(out):
                untried.append(self.starting(text, at))
            options = untried[-1]
            while options:
                piece = options.pop()
                if left is None or self.agree(left, piece):
                    out.append(piece)
                    at, left = at + len(piece), piece
                    break
            else:
                untried.pop()
                at -= len(out.pop())
                left = out[-1] if out else before
        return out

    def run(self, text: str) -> bytes:
        if len(self.runs) > REMEMBERED:
            self.runs.clear()
        found = self.runs[text] = self.packed(self.path(text))
        return found

    def short(self, text: str) -> bytes:
        """Letters and what stands between them one by one, where no piece holds the neighbours."""
        parts = _PARTS.findall(text)
        at = 1
        while at < len(parts):
            if parts[at - 1][-1] + parts[at][0] in self.pairs:
                parts[at - 1 : at + 1] = [parts[at - 1] + parts[at]]
            else:
                at += 1
        out = []
        for part in parts:
            found = self.runs.get(part)
            if found is None:
                if len(self.runs) > REMEMBERED:
                    self.runs.clear()
                found = self.runs[part] = self.packed(self.merged(part))
            out.append(found)
        return out[0] if len(out) == 1 else b"".join(out)

    def word(self, text: str) -> bytes:
        """A short word is merged as the model merges it. A longer one is cut where no piece holds both neighbours, since
        every path has a boundary there, and its parts are searched."""
        if len(self.words) > REMEMBERED:
            self.words, self.older = {}, self.words  # words that come often come back from there
        found = self.older.get(text)
        if found is not None:
            self.words[text] = found
            return found
        if len(text) <= SHORT:
            found = self.words[text] = self.short(text)
            return found
        pairs, known = self.pairs, self.runs.get
        cuts = [0, *[i for i in range(1, len(text)) if text[i - 1 : i + 1] not in pairs], len(text)]
        parts = [text[i:j] for i, j in zip(cuts, cuts[1:])]
        found = self.words[text] = b"".join([known(p) or self.run(p) for p in parts])
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of an escaped text (blanks as U+2581, with the one in front)."""
        known, word = self.words.get, self.word
        return np.frombuffer(b"".join([known(w) or word(w) for w in _WORD.findall(text)]), np.int32)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        taken = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), self.text.take(pa.array(ids, pa.int32())))
        raw = pc.binary_join(taken, b"")[0].as_py()
        return raw.decode("utf-8", "replace").replace(BLANK, " ")[1:]


def load(path: str) -> Pieces:
    """Reads a SentencePiece BPE model with byte fallback."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, score, text = {}, {}, []
    byte_ids = [0] * 256
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            value = int(piece[3:5], 16)
            byte_ids[value] = i
            text.append(bytes([value]))
        elif sp.is_control(i) or sp.is_unknown(i):
            text.append(b"")
        else:
            ids[piece], score[piece] = i, sp.get_score(i)
            text.append(piece.encode())
    heads = {p[:i]: False for p in ids for i in range(1, len(p))} | dict.fromkeys(ids, True)
    pairs = frozenset(p[i : i + 2] for p in ids for i in range(len(p) - 1))
    number = lambda i: i.to_bytes(4, sys.byteorder)
    return Pieces(
        ids, score, {p: number(i) for p, i in ids.items()}, [number(i) for i in byte_ids],
        pa.array(text, pa.binary()), max(map(len, ids)), heads, pairs,
    )


def escaped(text: str) -> str:
    return BLANK + text.replace(" ", BLANK) if text else ""


# A state: how far before the cut its piece ends, and the piece (None before the first).
State = tuple[int, str | None]


def _ends(text: str, pieces: Pieces) -> list[State]:
    """All states that a text before a cut may leave: any piece that ends within reach of the cut."""
    out: list[State] = []
    for back in range(min(pieces.longest, len(text))):
        end = len(text) - back
        for size in range(1, min(pieces.longest, end) + 1):
            piece = text[end - size : end]
            if size == 1 or piece in pieces.ids:
                out.append((back, piece))
    return out


def _spread(pieces: Pieces, left: str, body: str, entries: list[State]) -> list[dict[str | None, int]]:
    """For each place of left + body, the pieces that may end there, and the entries (bits) that lead to them.

    An entry is followed only by pieces that end after the cut.
    """
    text, cut = left + body, len(left)
    at: list[dict[str | None, int]] = [{} for _ in range(len(text) + 1)]
    for bit, (back, piece) in enumerate(entries):
        at[cut - back][piece] = at[cut - back].get(piece, 0) | 1 << bit
    for p in range(cut + 1, len(text) + 1):
        for size in range(1, min(p, pieces.longest) + 1):
            before = at[p - size]
            piece = text[p - size : p]
            if before and (size == 1 or piece in pieces.ids):
                bits = 0
                for other, mask in before.items():
                    if other is None or pieces.agree(other, piece):
                        bits |= mask
                if bits:
                    at[p][piece] = at[p].get(piece, 0) | bits
    return at


def transfer(pieces: Pieces, left: str, body: str, first: bool) -> tuple[list[State], list[tuple[State, int]]]:
    """The chunk's matrix: its entries, and each exit with the entries from which it can be reached.

    Between two words every path has a boundary, so only the parts up to the first and from the last
    such place need a lattice; without one the whole chunk does.
    """
    entries: list[State] = [(0, None)] if first else _ends(left, pieces)
    reach = pieces.longest
    edges = [m.start() for m in re.finditer(f"(?<=[^{BLANK}]){BLANK}", body) if m.start() <= len(body) - reach]
    if edges and edges[0] > 0:
        head = _spread(pieces, left, body[: edges[0]], entries)[-1]
        through = 0
        for mask in head.values():
            through |= mask
        tail = _spread(pieces, "", body[edges[-1] :], [(0, None)])
        exits = [((len(tail) - 1 - p, piece), through) for p in range(len(tail)) for piece, mask in tail[p].items() if piece is not None and mask]
    else:
        whole = _spread(pieces, left, body, entries)
        cut = len(left)
        # An entry that no piece leaves behind the next cut can itself be the last state before it.
        exits = [((len(whole) - 1 - p, piece), mask) for p in range(cut, len(whole)) for piece, mask in whole[p].items() if piece is not None and (p > cut or not first)]
    return entries, [(state, mask) for state, mask in exits if state[0] < reach]


Matrix = tuple[list[State], list[tuple[State, int]]]


def combine(left: Matrix, right: Matrix) -> Matrix:
    """The matrix of two neighbouring parts as one: an exit is reached from an entry if some state between is on the way."""
    (entries, middle), (starts, exits) = left, right
    through = dict(middle)
    reached = [through.get(s, 0) for s in starts]
    out = []
    for state, mask in exits:
        total = 0
        while mask:
            low = mask & -mask
            total |= reached[low.bit_length() - 1]
            mask ^= low
        if total:
            out.append((state, total))
    return entries, out


def product(matrices: list[Matrix]) -> Matrix:
    """All of a run of neighbours, by pairs."""
    while len(matrices) > 1:
        matrices = [combine(*pair) if len(pair) == 2 else pair[0] for pair in (matrices[i : i + 2] for i in range(0, len(matrices), 2))]
    return matrices[0]


def whole_path(matrix: Matrix) -> tuple[State, State]:
    """Where the one path of a whole document begins and ends."""
    entries, exits = matrix
    first = entries.index((0, None))
    return (0, None), next(s for s, mask in exits if s[0] == 0 and mask >> first & 1)


def fold(matrices: list[Matrix], ends: tuple[State, State] | None = None) -> list[tuple[State, State]]:
    """Entry and exit of each neighbour on the path between two states (by default a whole document's)."""
    begin, end = ends or whole_path(product(matrices))
    met: list[set[State]] = [{begin}]
    for entries, exits in matrices:
        alive = sum(1 << i for i, e in enumerate(entries) if e in met[-1])
        met.append({state for state, mask in exits if mask & alive})
    out: list[tuple[State, State]] = []
    for k in range(len(matrices) - 1, -1, -1):
        entries, exits = matrices[k]
        mask = next(m for s, m in exits if s == end)
        start = next(e for i, e in enumerate(entries) if mask >> i & 1 and e in met[k])
        out.append((start, end))
        end = start
    return out[::-1]


def between(pieces: Pieces, left: str, body: str, start: State, end: State) -> np.ndarray:
    """Ids of a chunk between two states: the first word after what stands before it, the others as ever."""
    text = left[len(left) - start[0] :] + body if start[0] else body
    text = text[: len(text) - end[0]]
    edge = re.search(f"(?<=[^{BLANK}]){BLANK}", text)
    head = text[: edge.start()] if edge else text
    first = np.frombuffer(pieces.packed(pieces.path(head, start[1])), np.int32) if head else np.zeros(0, np.int32)
    return np.concatenate([first, pieces.encode(text[len(head) :])])


_IDS = pa.list_(pa.int32())


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, text, ids (array of int) for every row. A chunk is at least two longest pieces long."""
    small, giant, chunk = _by_length(docs, pieces, id_col, text_col, chunk)
    sent = _sent(docs, pieces)
    return _whole(small, sent, "text string", lambda texts, _: texts).unionByName(_giants(giant, pieces, sent, chunk))


def _sent(docs: DataFrame, pieces: Pieces) -> Broadcast:
    """The model (its size is that of the model's file) for all tasks; a worker keeps it, and the words it knows, from task to task."""
    return docs.sparkSession.sparkContext.broadcast(pieces)


def _by_length(docs: DataFrame, pieces: Pieces, id_col: str, text_col: str, chunk: int) -> tuple[DataFrame, DataFrame, int]:
    """doc_id and text of the ordinary documents, of the giant ones, and the length of chunks."""
    chunk = max(chunk, 2 * pieces.longest)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return rows.where(F.length("text") < chunk), rows.where(F.length("text") >= chunk), chunk


def _whole(rows: DataFrame, sent: Broadcast, column: str, of: Callable[[list[str], list[np.ndarray]], list]) -> DataFrame:
    """doc_id, ids and one more column, made of texts and ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sent.value
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                texts = part.column(1).to_pylist()
                ids = [pieces.encode(escaped(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids), pa.array(of(texts, ids))], names=["doc_id", "ids", column.split()[0]])

    return rows.mapInArrow(work, f"doc_id long, ids array<int>, {column}")


def _giants(rows: DataFrame, pieces: Pieces, sent: Broadcast, chunk: int) -> DataFrame:
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "giant-texts")
    reach = 2 * pieces.longest

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = escaped(text)
                starts = range(0, len(text), chunk)
                out = [(row, k, text[max(0, s - reach) : s], text[s : s + chunk]) for k, s in enumerate(starts)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["row", "k", "left", "body"])

    schema = "row long, k long, left string, body string"
    chunks = stored(rows.select("row", "text").mapInArrow(cut, schema).repartition(F.col("row"), F.col("k")), "giant-chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        for batch in batches:
            raw = [pickle.dumps(transfer(sent.value, left, body, k == 0)) for k, left, body in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], names=["row", "k", "matrix"])

    def multiply(group: pa.Table) -> pa.Table:
        import pickle

        raw = pickle.dumps(product([pickle.loads(m) for m in group.sort_by("k").column("matrix").to_pylist()]))
        return pa.table({"row": group.column("row")[:1], "k": pa.array([group.column("k")[0].as_py() // FAN]), "matrix": pa.array([raw], pa.binary())})

    def placed_states(keys: dict[str, pa.ChunkedArray], found: list[tuple[State, State]]) -> pa.Table:
        for i, name in enumerate(("start", "end")):
            keys[f"{name}_back"] = pa.array([f[i][0] for f in found], pa.int32())
            keys[f"{name}_piece"] = pa.array([f[i][1] for f in found], pa.string())
        return pa.table(keys)

    def begin_and_end(group: pa.Table) -> pa.Table:
        import pickle

        return placed_states({"row": group.column("row"), "k": group.column("k")}, [whole_path(pickle.loads(m)) for m in group.column("matrix").to_pylist()])

    def scan(own: pa.Table, above: pa.Table) -> pa.Table:
        import pickle

        own = own.sort_by("k")
        ends = [(above.column(f"{n}_back")[0].as_py(), above.column(f"{n}_piece")[0].as_py()) for n in ("start", "end")]
        found = fold([pickle.loads(m) for m in own.column("matrix").to_pylist()], (ends[0], ends[1]))
        return placed_states({"row": own.column("row"), "k": own.column("k")}, found)

    # Up: FAN neighbours become one matrix, until a document has one. Down: the states of a part give those of its FAN parts.
    shape = "row long, k long, start_back int, start_piece string, end_back int, end_piece string"
    levels = [stored(chunks.mapInArrow(matrices, "row long, k long, matrix binary"), "giant-matrices")]
    while levels[-1].agg(F.max("k")).first()[0]:
        above = levels[-1].groupBy("row", F.floor(F.col("k") / FAN).alias("part")).applyInArrow(multiply, "row long, k long, matrix binary")
        levels.append(stored(above, "giant-matrices"))
    states = levels[-1].groupBy("row", "k").applyInArrow(begin_and_end, shape)
    for level in reversed(levels[:-1]):
        own = level.groupBy("row", F.floor(F.col("k") / FAN).alias("part"))
        above = stored(states, "giant-states").withColumn("part", F.col("k")).groupBy("row", "part")
        states = own.cogroup(above).applyInArrow(scan, shape)
    placed = chunks.join(stored(states, "giant-states"), ["row", "k"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [
                between(sent.value, r["left"], r["body"], (r["start_back"], r["start_piece"]), (r["end_back"], r["end_piece"])) for r in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(ids)], names=["row", "k", "ids"])

    traced = placed.mapInArrow(trace, "row long, k long, ids array<int>")
    whole = traced.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    return rows.join(whole, "row").select("doc_id", "text", "ids")


def decode(encoded: DataFrame, pieces: Pieces, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``."""

    sent = _sent(encoded, pieces)

    @F.arrow_udf("string")
    def back(ids: pa.Array) -> pa.Array:
        return pa.array([None if x is None else sent.value.decode(x) for x in ids.to_pylist()], pa.string())

    return encoded.withColumn("decoded", back(encoded[ids_col]))


def round_trip(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, ids, exact (whether decoding gives the text back) for every row."""

    sent = _sent(docs, pieces)

    def same(texts: list[str], ids: list[np.ndarray]) -> list[bool]:
        return [sent.value.decode(i) == t.replace(BLANK, " ") for t, i in zip(texts, ids)]

    @F.arrow_udf("boolean")
    def giant_same(ids: pa.Array, text: pa.Array) -> pa.Array:
        return pa.array([same([t.as_py()], [i.values.to_numpy()])[0] for t, i in zip(text, ids)], pa.bool_())

    small, giant, chunk = _by_length(docs, pieces, id_col, text_col, chunk)
    giants = _giants(giant, pieces, sent, chunk).select("doc_id", "ids", giant_same("ids", "text").alias("exact"))
    rows = _whole(small, sent, "exact boolean", same).unionByName(giants)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact")


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(DEFAULT_MODEL))


def op9_sentencepiece_scan(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"), load(default_model()))
