"""Near duplicates by SimHash: a grid over popcounts of fingerprint segments, then exact distances.

A fingerprint has 64 bits. Cut into segments of ``SEGMENT`` bits and mapped to the number of set bits in
each, two fingerprints are at least as many bits apart as the Manhattan distance of their popcounts, so
pairs within ``BITS`` bits are a range join of popcount vectors. The vectors are cut into ``PARTS`` parts: in one
of them at least, a pair within the range is no further apart than ``BITS // PARTS``, and then
some vector lies within ``BITS // PARTS // 2`` of both (here 1). So every fingerprint enters the grid cells of its own part
and of those one step away; fingerprints that share a cell are checked by Manhattan distance, then exactly.

Equal fingerprints are one from the first shuffle on. A cell is walked as a stream of sorted rows; out of it come
only the links that hold its linked fingerprints together (at most one a fingerprint). Cells over
``CELL`` fingerprints are cut into blocks, and any two blocks meet in a task of their own.

Defined results: null and empty texts have fingerprint zero and are linked like any other; a text of fewer than
``N`` words has one shingle, all its words; a null id is never a component's id unless the component has no other; repeated
rows share a fingerprint; an empty table gives no rows; a text of any length is hashed in bounded pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.components import components
from tablehaul.llm.shared import id_and_text, map_slices, stored, table

N, SEED, BITS = 4, 42, 4
#: Bits of a segment; parts of the popcount vector.
SEGMENT, PARTS = 2, 2
#: Fingerprints of a cell that are compared in one task.
CELL = 1 << 13
#: Bytes of a text that are cut into words at once, and pairs compared at once.
PIECE, PAIRS = 1 << 18, 1 << 20
#: Rows of one fingerprint above which it is looked up apart from the others.
HOT = 1000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = re.compile(rb"[ \t-\r]")


def shingle_hashes(text: bytes) -> Iterator[list[int]]:
    """XXH64 of every shingle, repeats included, in lists of bounded size."""
    from xxhash import xxh64_intdigest

    words: list[bytes] = []
    any_yet = False
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + PIECE)
        end = space.end() if space else len(text)
        words += text[at:end].translate(_LOWER).split()
        at = end
        if len(words) >= N:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            begins = [0, *ends[:-N].tolist()]
            yield [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins, (ends[N - 1 :] - 1).tolist())]
            any_yet = True
            words = words[1 - N :]
    if words and not any_yet:
        yield [xxh64_intdigest(b" ".join(words), SEED)]


#: The lowest bit of each byte: eight counters of one byte each in a word.
_LANES = np.uint64(0x0101010101010101)
_FULL = 255  # what a byte can count to


def _set_bits(hashes: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many hashes of each run (of a length, from ``first``) have each of the 64 bits."""
    blocks = -(-lengths // _FULL)
    block_at = np.append(0, np.cumsum(blocks[:-1]))
    starts = np.repeat(first, blocks) + _FULL * (np.arange(blocks.sum()) - np.repeat(block_at, blocks))
    out = np.empty((len(first), 64), np.int64)
    for bit in range(8):
        counted = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, starts)
        out[:, bit::8] = np.add.reduceat(counted.astype("<u8").view(np.uint8).reshape(-1, 8), block_at, axis=0, dtype=np.int64)
    return out


def fingerprint_of(texts: list[bytes]) -> np.ndarray:
    """Unsigned 64-bit fingerprints; the bit with value 2**i is set if more than half the hashes have it."""
    ones = np.zeros((len(texts), 64), np.int64)
    total = np.zeros(len(texts), np.int64)
    held: list[int] = []
    rows: list[int] = []
    lengths: list[int] = []

    def add() -> None:
        if held:
            first = np.append(0, np.cumsum(lengths[:-1])).astype(np.int64)
            np.add.at(ones, rows, _set_bits(np.array(held, np.uint64), first, np.array(lengths)))
            np.add.at(total, rows, lengths)
            held.clear(), rows.clear(), lengths.clear()

    for i, text in enumerate(texts):
        for hashes in shingle_hashes(text):
            held += hashes
            rows.append(i)
            lengths.append(len(hashes))
            if len(held) > PIECE:
                add()
    add()
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return ((2 * ones > total[:, None]) * weights).sum(axis=1, dtype=np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, f (the fingerprint as a signed long) for every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = fingerprint_of(batch.column(1).cast(pa.large_binary()).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "f"])

    return map_slices(id_and_text(docs, id_col, text_col), work, "doc_id long, f long")


def popcounts(f: np.ndarray) -> np.ndarray:
    """The popcount of each segment, a row for each fingerprint."""
    at = np.arange(0, 64, SEGMENT, dtype=np.uint64)
    return np.bitwise_count((f.view(np.uint64)[:, None] >> at) & np.uint64((1 << SEGMENT) - 1)).astype(np.int8)


def cells_of(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid cells (64-bit numbers of part and popcounts) and the index of the fingerprint that enters each."""
    counts = popcounts(f).astype(np.int64)
    width = counts.shape[1] // PARTS
    base = SEGMENT + 1
    weights = base ** np.arange(width, dtype=np.int64)
    cells, rows = [], []
    for part in range(PARTS):
        own = counts[:, part * width : (part + 1) * width]
        number = (own @ weights) * PARTS + part
        cells.append(number)
        rows.append(np.arange(len(f)))
        for step, bound in ((1, SEGMENT), (-1, 0)):
            row, column = np.nonzero(own != bound)
            cells.append(number[row] + step * PARTS * weights[column])
            rows.append(row)
    return np.concatenate(cells), np.concatenate(rows)


def embedded(f: np.ndarray) -> np.ndarray:
    """Popcounts of 2-bit segments as 00, 01, 11: so many bits differ between two as their Manhattan distance is."""
    low = np.uint64(0x5555555555555555)
    f = f.view(np.uint64)
    return ((f | f >> np.uint64(1)) & low) | ((f & f >> np.uint64(1) & low) << np.uint64(1))


def _within(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of indices are linked."""
    return np.bitwise_count(f[a] ^ f[b]) <= BITS


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """New labels (the smallest index of a group) after linking pairs, and the pairs that joined two groups."""
    kept_a, kept_b = [], []
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        order = np.lexsort((low, high))
        order = order[(low != high)[order]]
        order = order[np.append(True, high[order][1:] != high[order][:-1])[: len(order)]]
        if not len(order):
            break
        kept_a.append(a[order])
        kept_b.append(b[order])
        to = np.arange(len(label))
        to[high[order]] = low[order]
        while True:
            further = to[to]
            if (further == to).all():
                break
            to = further
        label = to[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label, kept_a, kept_b


def links_of(left: np.ndarray, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (indices into left + right) that connect what is linked within ``left``, or between ``left`` and ``right``.

    Rows are compared in strips of bounded size, and a link is kept only if it joins two groups.
    """
    f = left if right is None else np.concatenate([left, right])
    e, n = embedded(f), len(f)
    label = np.arange(n)
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, last = 0, n if right is None else len(left)
    while at < last:
        start = at if right is None else len(left)
        height = max(1, min(last - at, PAIRS // max(1, n - start)))
        a, b = np.nonzero(np.bitwise_count(e[at : at + height, None] ^ e[None, start:]) <= BITS)
        a, b = a + at, b + start
        true = (a < b) & _within(f, a, b)
        label, kept_a, kept_b = _join(label, a[true], b[true])
        out_a += kept_a
        out_b += kept_b
        at += height
    return np.concatenate(out_a), np.concatenate(out_b)


def _runs(cell: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of sorted rows that share a cell. Small cells are compared all at once, by the distance of their rows."""
    begins = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    sizes = np.diff(np.append(begins, len(cell)))
    a, b, e = [], [], embedded(f)
    small = np.repeat(sizes, sizes) <= 32
    for apart in range(1, min(32, int(sizes.max(initial=1)))):
        pair = np.flatnonzero((cell[apart:] == cell[:-apart]) & small[apart:])
        pair = pair[np.bitwise_count(e[pair] ^ e[pair + apart]) <= BITS]
        pair = pair[_within(f, pair, pair + apart)]
        a.append(f[pair])
        b.append(f[pair + apart])
    for at, size in zip(begins[sizes > 32].tolist(), sizes[sizes > 32].tolist()):
        i, j = links_of(f[at : at + size])
        a.append(f[at + i])
        b.append(f[at + j])
    return np.concatenate([*a, f[:0]]), np.concatenate([*b, f[:0]])


def _pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows cell, f, sorted by cell: the last cell of a batch waits for the next."""
    cell, f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def found(stop: int) -> Iterator[pa.RecordBatch]:
        a, b = _runs(cell[:stop], f[:stop])
        if len(a):
            links = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
            yield _pairs_batch(np.ascontiguousarray(links[:, 0]), np.ascontiguousarray(links[:, 1]))

    for batch in batches:
        cell = np.concatenate([cell, batch.column(0).to_numpy()])
        f = np.concatenate([f, batch.column(1).to_numpy().view(np.uint64)])
        stop = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
        if stop:
            yield from found(stop)
            cell, f = cell[stop:], f[stop:]
    if len(cell):
        yield from found(len(cell))


def links(distinct: DataFrame) -> DataFrame:
    """distinct: f, each fingerprint once. Returns a, b: links that connect all fingerprints within the range."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy()
            for at in range(0, len(f), 1 << 14):
                part = f[at : at + (1 << 14)]
                cells, rows = cells_of(part)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(part[rows])], names=["cell", "f"])

    entered = stored(distinct.mapInArrow(enter, "cell long, f long"), "simhash-cells")
    crowded = stored(entered.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL), "simhash-crowded")
    if crowded.isEmpty():
        return entered.repartition("cell").sortWithinPartitions("cell").mapInArrow(_walk, "a long, b long")
    usual = entered.join(crowded.select("cell"), "cell", "left_anti")
    walked = usual.select("cell", "f").repartition("cell").sortWithinPartitions("cell").mapInArrow(_walk, "a long, b long")
    # A fingerprint of a crowded cell goes to all pairs of blocks that hold its own.
    blocks = F.ceil(F.col("n") / CELL).cast("int")
    dealt = entered.join(crowded, "cell").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("f"), "blocks").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "f")

    def compare(group: pa.Table) -> pa.Table:
        f = group.column("f").to_numpy().view(np.uint64)
        low = group.column("own").to_numpy() == group.column("low")[0].as_py()
        one = group.column("low")[0].as_py() == group.column("high")[0].as_py()
        i, j = links_of(f) if one else links_of(f[low], f[~low])
        every = f if one else np.concatenate([f[low], f[~low]])
        return pa.Table.from_batches([_pairs_batch(every[i], every[j])])

    return walked.unionByName(met.groupBy("cell", "low", "high").applyInArrow(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, f, component_id (the smallest id of the component, null if none has one) for every row."""
    rows = stored(fingerprints(docs, id_col, text_col), "simhash-rows")
    distinct = stored(rows.groupBy("f").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    member = components(links(distinct.select("f")).distinct())
    known = distinct.join(member.withColumnRenamed("node", "f"), "f", "left").withColumn("component", F.coalesce("component", "f"))
    known = stored(known, "simhash-known")
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(known.join(smallest, "component").select("f", "n", "component_id"), "simhash-named")
    # Fingerprints of many rows are few; looked up first, by a broadcast if they measure small.
    many = stored(named.where(F.col("n") > HOT).select("f", "component_id"), "simhash-many")
    usual = named.where(F.col("n") <= HOT).select("f", "component_id")
    found = rows.join(many, "f").select("doc_id", "f", "component_id")
    rest = rows.join(many, "f", "left_anti").join(usual, "f").select("doc_id", "f", "component_id")
    return found.unionByName(rest)


def op13_segment_popcount_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
