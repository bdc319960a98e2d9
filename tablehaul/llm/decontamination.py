"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents are TF-IDF vectors over the words of the benchmark. A randomised SVD,
summed up over all passages in Spark, gives a latent space; every window of every document is
compared with every item there by cosine. Candidates are then checked on the words
themselves: the longest common subsequence with the item, and whether the item's answer (its last
sentence, or an answer column) is there too. Only words that weigh something count there. A
candidate is a hit if nearly all of the item is there, or a good part of it together with its answer;
so reworded passages are hits and texts that merely share common words are not.

The benchmark is the stated query set: it is taken in blocks of ``BLOCK`` items, and a block's words
and vectors, whose size that bounds, go to the tasks. Words are compared without ASCII case and
punctuation. Words in more than ``COMMON`` of the passages weigh nothing, but every item keeps its
``LEAST`` rarest words whatever their frequency.

Defined results: null and empty texts have no hits; items that are null or have no word are never
found; repeated items are found under the smallest id that has the text; null item ids are left out;
repeated documents are all hits; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.shared import id_and_text, slices, stored, table
from tablehaul.llm.words import Words

BLOCK, RANK, EXTRA, STEP = 2000, 128, 10, 20
COMMON, LEAST = 0.003, 8
COSINE = 0.5
#: Shares of an item's weighing words, in order: enough alone, or enough with so much of its answer.
ALONE, PART, ANSWER = 0.75, 0.5, 0.75
#: Weighing words an item and a window must share, or all the item has if fewer.
SHARED = 4

_FOLD = np.array([c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256)], dtype=np.uint8)


@dataclass
class Items:
    """A block of the benchmark; all arrays go by item."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    terms: np.ndarray  # sorted hashes of all their words

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Places in ``terms``, -1 for other words."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)


def _words_of(texts: list[str]) -> list[np.ndarray]:
    w = Words(pa.array(texts, pa.string()), _FOLD)
    return [w.hashes[w.first[d] : w.first[d + 1]] for d in range(w.rows)]


def last_sentence(text: str) -> str:
    parts = [p for p in text.replace("!", ".").replace("?", ".").replace("\n", ".").split(".") if len(p.split()) >= 3]
    return parts[-1] if parts else text


def blocks(benchmark: DataFrame, id_col: str, text_col: str, answer_col: str | None, size: int = BLOCK) -> Iterator[Items]:
    """The benchmark in bounded blocks, by id."""
    answer = benchmark[answer_col] if answer_col else F.lit(None).cast("string")
    items = benchmark.select(benchmark[text_col].alias("text"), benchmark[id_col].cast("long").alias("id"), answer.alias("answer"))
    items = items.where("id IS NOT NULL AND text IS NOT NULL").groupBy("text").agg(F.min("id").alias("id"), F.min("answer").alias("answer"))
    items = stored(items, "benchmark-items")
    after = None
    while True:
        rows = (items if after is None else items.where((F.col("id") > after[0]) | ((F.col("id") == after[0]) & (F.col("text") > after[1])))).orderBy("id", "text").limit(size).collect()
        if not rows:
            return
        after = (rows[-1]["id"], rows[-1]["text"])
        words = _words_of([r["text"] for r in rows])
        answers = _words_of([r["answer"] or last_sentence(r["text"]) for r in rows])
        keep = [i for i, w in enumerate(words) if len(w)]
        if keep:
            yield Items([rows[i]["id"] for i in keep], [words[i] for i in keep], [answers[i] for i in keep], np.unique(np.concatenate([words[i] for i in keep])))


def _per_task(docs: DataFrame, name: str, start: Callable[[], np.ndarray], add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """A sum of arrays over all rows: each task adds up its own, strips of them are summed in Spark."""
    strips = 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = start()
        for batch in batches:
            add(total, batch)
        parts = np.array_split(total.ravel(), strips)
        yield pa.RecordBatch.from_arrays([pa.array(range(strips), pa.int32()), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], names=["strip", "sums"])

    def join(group: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(b, np.float32).astype(np.float64) for b in group.column("sums").to_pylist())
        return pa.table({"strip": group.column("strip").slice(0, 1), "sums": pa.array([sums.astype(np.float32).tobytes()], pa.binary())})

    schema = "strip int, sums binary"
    # Two rounds, so that no task gets the sums of all tasks of a large cluster at once.
    spread = docs.mapInArrow(run, schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))

    def first(group: pa.Table) -> pa.Table:
        return join(group)

    once = spread.groupBy("strip", "part").applyInArrow(first, schema)
    rows = stored(once.groupBy("strip").applyInArrow(join, schema), name).collect()
    shape = start()
    flat = {r["strip"]: np.frombuffer(bytes(r["sums"]), np.float32) for r in rows}
    if not flat:
        return shape
    return np.concatenate([flat[i] for i in range(strips)]).astype(np.float64).reshape(shape.shape)


def _passages(items: Items, batch: pa.RecordBatch, kept: np.ndarray | None) -> Iterator[tuple[Words, np.ndarray, np.ndarray, np.ndarray, int]]:
    """For slices of a batch: words, the terms found (word number, term) and each one's passage; passages are STEP words of a row."""
    for part in slices(batch, "text", 2 << 20):
        w = Words(part.column(part.schema.get_field_index("text")), _FOLD)
        number = items.number(w.hashes)
        at = np.flatnonzero(number >= 0 if kept is None else (number >= 0) & kept[number])
        per_row = -(-w.count // STEP)
        base = np.append(0, np.cumsum(per_row))
        passage = base[w.doc[at]] + (at - w.first[w.doc[at]]) // STEP
        yield w, at, number[at], passage, int(base[-1])


@dataclass
class Space:
    """The latent space of one block of items."""

    items: Items
    weight: np.ndarray  # of each term; 0 for common ones
    axes: np.ndarray  # terms x rank, weighted
    vectors: np.ndarray  # items x rank, unit length


def fit(docs: DataFrame, items: Items, text_col: str = "text") -> Space:
    """Term weights and latent axes from all passages of all documents."""
    rows = docs.select(F.coalesce(docs[text_col], F.lit("")).alias("text"))
    n = len(items.terms)

    def count(total: np.ndarray, batch: pa.RecordBatch) -> None:
        for _, _, term, passage, passages in _passages(items, batch, None):
            seen = np.unique(passage * n + term) % n
            total[:n] += np.bincount(seen, minlength=n)
            total[n] += passages

    df = _per_task(rows, "decon-counts", lambda: np.zeros(n + 1), count)
    passages, df = max(df[n], 1.0), df[:n]
    weight = np.log((passages + 1) / (df + 1))
    kept = df <= COMMON * passages
    for words in items.words:
        own = items.number(np.unique(words))
        kept[own[np.argsort(df[own], kind="stable")[:LEAST]]] = True
    weight = np.where(kept, np.maximum(weight, 0.01), 0.0)

    # From here on only the kept terms of a passage matter; they are few, and written once.
    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, term, passage, _ in _passages(items, batch, kept):
                if len(term):
                    begins = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
                    ends = np.append(begins, len(term)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(term.astype(np.int32)))], names=["terms"])

    matrix = stored(rows.mapInArrow(sparse, "terms array<int>"), "decon-passages")
    rank = min(RANK, n)
    width = min(rank + EXTRA, n)
    probe = np.random.default_rng(7).standard_normal((n, width))

    def rows_of(batch: pa.RecordBatch, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms, the passage of each, and the passages' products with a basis."""
        column = batch.column(0)
        term = column.flatten().to_numpy()
        length = np.diff(column.offsets.to_numpy())
        row = np.repeat(np.arange(len(length)), length)
        product = np.add.reduceat(basis[term] * weight[term][:, None], np.append(0, np.cumsum(length)[:-1])) if len(term) else np.zeros((0, basis.shape[1]))
        return term, row, product

    def ranged(basis: np.ndarray) -> Callable[[np.ndarray, pa.RecordBatch], None]:
        def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
            term, row, product = rows_of(batch, basis)
            order = np.argsort(term, kind="stable")
            if len(term):
                begins = np.flatnonzero(np.append(True, term[order][1:] != term[order][:-1]))
                total[term[order][begins]] += np.add.reduceat(product[row[order]], begins) * weight[term[order][begins]][:, None]

        return add

    def gram(basis: np.ndarray) -> Callable[[np.ndarray, pa.RecordBatch], None]:
        def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
            _, _, product = rows_of(batch, basis)
            total += product.T @ product

        return add

    found = _per_task(matrix, "decon-range", lambda: np.zeros((n, width)), ranged(probe))
    # The items are passages as well, and together weigh as much as the documents' passages do.
    numbers = [items.number(words) for words in items.words]
    reference = np.zeros((n, width))
    for term in numbers:
        reference[term] += weight[term][:, None] * (weight[term] @ probe[term])[None, :]
    found += reference * (np.linalg.norm(found) / max(np.linalg.norm(reference), 1e-12) if found.any() else 1.0)
    basis, _ = np.linalg.qr(found)
    products = np.array([(weight[t][:, None] * basis[t]).sum(0) for t in numbers])
    small, own = _per_task(matrix, "decon-gram", lambda: np.zeros((width, width)), gram(basis)), products.T @ products
    small += own * (np.trace(small) / max(np.trace(own), 1e-12) if small.any() else 1.0)
    _, turn = np.linalg.eigh(small)
    axes = (basis @ turn[:, ::-1][:, :rank]) * weight[:, None]
    vectors = np.array([axes[t].sum(0) for t in numbers])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Space(items, weight, axes.astype(np.float32), vectors.astype(np.float32))


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a word of bits for a (Hyyro 2004)."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        match = places.get(x)
        if match:
            found = row & match
            row = ((row + found) | (row - found)) & full
    return len(a) - row.bit_count()


def search(space: Space, texts: pa.Array) -> list[tuple[int, int, int, float, float, float]]:
    """Hits in a column of texts: row, item, first word of the window, cosine, share of the item, share of its answer."""
    items = space.items
    weighs = space.weight > 0
    own = [t[weighs[t]].tolist() for t in map(items.number, items.words)]
    answers = [t[(t >= 0) & weighs[t]].tolist() for t in map(items.number, items.answers)]
    least = [min(SHARED, len(t)) for t in own]
    fewest = max(1, min(least))
    best: dict[tuple[int, int], tuple] = {}
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    done = 0
    for w, word, term, passage, passages in _passages(items, batch, weighs):
        if len(term):
            begins = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
            held = np.zeros((passages + 4, space.axes.shape[1]), np.float32)
            held[passage[begins]] = np.add.reduceat(space.axes[term], begins)
            filled = np.append(np.bincount(passage, minlength=passages), np.zeros(4, np.int64))
            per_row = -(-w.count // STEP)
            row_of = np.append(np.repeat(np.arange(w.rows), per_row), [-1] * 4)
            first = np.append(0, np.cumsum(per_row))
            for span in (2, 4):  # windows of so many passages, starting at each
                inside = [row_of[i : i + passages] == row_of[:passages] for i in range(span)]
                some = np.flatnonzero(sum(filled[i : i + passages] * inside[i] for i in range(span)) >= fewest)
                for part in np.array_split(some, max(1, len(some) // 4096)):
                    window = sum(held[part + i] * inside[i][part][:, None] for i in range(span))
                    like = (window / np.maximum(np.linalg.norm(window, axis=1), 1e-12)[:, None]) @ space.vectors.T
                    for at, item in zip(*np.nonzero(like >= COSINE)):
                        d = row_of[part[at]]
                        start = w.first[d] + (part[at] - first[d]) * STEP
                        size = len(items.words[item]) // 2
                        low, high = max(w.first[d], start - size), min(w.first[d + 1], start + span * STEP + size)
                        left, right = np.searchsorted(word, (low, high))
                        there = term[left:right].tolist()
                        shared = common_subsequence(own[item], there)
                        share = shared / max(len(own[item]), 1)
                        if shared < least[item] or share < PART:
                            continue
                        told = common_subsequence(answers[item], there) / max(len(answers[item]), 1)
                        if share >= ALONE or told >= ANSWER:
                            key = (int(done + d), int(item))
                            hit = (share, told, float(like[at, item]), int(low - w.first[d]))
                            if key not in best or hit > best[key]:
                                best[key] = hit
        done += w.rows
    return [(row, item, hit[3], hit[2], hit[0], hit[1]) for (row, item), hit in sorted(best.items())]


_HITS = "array<struct<item_id:long,start:int,cosine:double,share:double,answer:double>>"
_HIT = pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("cosine", pa.float64()), ("share", pa.float64()), ("answer", pa.float64())])


def hits(text: Column, space: Space) -> Column:
    """The hits of each text, as a column."""

    @F.arrow_udf(_HITS)
    def found(texts: pa.Array) -> pa.Array:
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        for row, item, start, cosine, share, answer in search(space, texts):
            out[row].append({"item_id": space.items.ids[item], "start": start, "cosine": cosine, "share": share, "answer": answer})
        return pa.array(out, pa.list_(_HIT))

    return found(F.coalesce(text, F.lit("")))


def _spaces(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, answer_col: str | None) -> list[Space]:
    return [fit(docs, items, text_col) for items in blocks(benchmark, item_col, item_text_col, answer_col)]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None
) -> DataFrame:
    """doc_id, item_id, start, cosine, share, answer: a row for each item found in a document."""
    rows = id_and_text(docs, id_col, text_col)
    out = None
    for space in _spaces(docs, benchmark, text_col, item_col, item_text_col, answer_col):
        found = rows.select("doc_id", F.explode(hits(F.col("text"), space)).alias("hit")).select("doc_id", "hit.*")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.select("doc_id", F.explode(F.array().cast(_HITS)).alias("hit")).select("doc_id", "hit.*")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """``docs`` without the rows in which an item was found."""
    out = docs
    for space in _spaces(docs, benchmark, text_col, item_col, item_text_col, answer_col):
        out = out.where(F.size(hits(out[text_col], space)) == 0)
    return out


def op3_latent_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
