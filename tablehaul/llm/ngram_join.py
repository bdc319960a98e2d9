"""Near-duplicate texts: a Jaccard join on word n-grams through MinHash banding.

Rows with equal word sequences are one text from the first step on. Each text gets MinHash
bands; band and row counts follow from the threshold and the target recall. Texts meet
in the buckets of equal bands:

1. every text of a bucket is paired with the bucket's smallest text (a star, so a bucket of
   n texts makes n pairs), and pairs are verified on full n-gram sets;
2. while buckets hold many pairs of texts in different classes and that number falls, each such
   bucket gets another star around another of its texts, so a group of near copies
   grows together in a few turns; buckets that still hold several classes are then compared
   whole, in blocks inside tasks, and only which texts belong together leaves a task (buckets of
   the same texts count as one);
3. linked texts form classes (connected components), and within a class every pair of
   texts is compared on full n-gram sets to count links; large classes are cut into
   blocks, so no task holds more than two blocks, and only counts leave a task.

Defined results: a text of fewer than ``N`` words has one n-gram, all its words; null texts and
texts without words link to nothing; a null id is never a class id unless its class has no other;
repeated rows are copies of each other; an empty table gives no rows. Equal 64-bit digests of
different word sequences would be an error, not a link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.components import components
from tablehaul.llm.shared import SLICE_BYTES, id_and_text, map_slices, slices, stored, table
from tablehaul.llm.words import Words, mix, signed

N, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9999, 5
#: A block of a class or bucket: texts, and bytes of text.
BLOCK_TEXTS, BLOCK_BYTES = 1024, 8 << 20
#: Undecided pairs for each text in an undecided bucket below which buckets are compared whole.
SPARSE = 2


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """The fewest bands of so many rows that find a pair at the threshold with the target chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every n-gram, in order; short rows have one of all their words."""
    at = np.arange(len(w.hashes))
    left = w.first[1:][w.doc] - at  # words from here to the row's end
    take = (left >= n) | ((at == w.first[:-1][w.doc]) & (left < n))
    start = at[take]
    return mix(w.prefix().run(start, start + np.minimum(left[take], n))), w.doc[take]


def _constants(count: int) -> np.ndarray:
    """Odd multipliers, the same everywhere."""
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minhash_bands(hashes: np.ndarray, row: np.ndarray, rows_of: int, bands: int, rows: int) -> np.ndarray:
    """A row of band hashes for each row that has n-grams; others get zeros."""
    out = np.zeros((rows_of, bands), np.uint64)
    if not len(hashes):
        return out
    begins = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    multipliers = _constants(bands * rows)
    work = np.empty_like(hashes)
    for band in range(bands):
        code = np.full(len(begins), band + 1, np.uint64)
        for r in range(rows):
            np.multiply(hashes, multipliers[band * rows + r], out=work)
            code = mix(code + np.minimum.reduceat(work, begins))
        out[row[begins], band] = code
    return out


def describe(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, node and check (digests of the word sequence, null without words), bands."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(batch.column(1))
        hashes, row = grams(w, n)
        some = w.count > 0
        found = signed(minhash_bands(hashes, row, w.rows, bands, rows)[some].ravel())
        at = np.append(0, np.cumsum(some * bands)).astype(np.int32)
        one, two = w.digests()
        node = pa.array(signed(one), mask=~some)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), node, pa.array(signed(two), mask=~some), pa.ListArray.from_arrays(pa.array(at), pa.array(found))],
            names=["doc_id", "node", "check", "bands"],
        )

    return map_slices(id_and_text(docs, id_col, text_col), work, "doc_id long, node long, check long, bands array<long>")


def with_node(docs: DataFrame, text_col: str) -> DataFrame:
    """node and text of every row that has words."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(batch.column(0))
        some = pa.array(w.count > 0)
        return pa.RecordBatch.from_arrays([pa.array(signed(w.digests()[0])).filter(some), batch.column(0).filter(some)], names=["node", "text"])

    return map_slices(docs.select(docs[text_col].alias("text")).where("text IS NOT NULL"), work, "node long, text string")


def jaccard(left: pa.Array, right: pa.Array, n: int) -> np.ndarray:
    """Exact similarity of the n-gram sets of each pair."""
    a, b = Words(left), Words(right)
    (ah, ar), (bh, br) = grams(a, n), grams(b, n)
    row, code = np.concatenate([ar, br]), np.concatenate([ah, bh])
    side = np.append(np.zeros(len(ar), np.int8), np.ones(len(br), np.int8))
    order = np.lexsort((side, code, row))
    row, code, side = row[order], code[order], side[order]
    new = np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]) | (side[1:] != side[:-1]))[: len(row)]
    row, code = row[new], code[new]
    both = np.append(False, (row[1:] == row[:-1]) & (code[1:] == code[:-1]))[: len(row)]
    shared = np.bincount(row[both], minlength=a.rows)
    union = np.bincount(row, minlength=a.rows) - shared
    return shared / np.maximum(union, 1)


def _verified(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """pairs: a, b (nodes). Adds sim, from the full texts."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right", F.concat("left", "right").alias("both"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sim = jaccard(batch.column(2), batch.column(3), n)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim)], names=["a", "b", "sim"])

    return map_slices(joined, work, "a long, b long, sim double", size_column="both")


def _linked(group: pa.Table, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a pair of blocks: which texts are in the first and which in the second, and a matrix of links."""
    own = group.column("own").to_numpy().astype(bool)
    inside = bool(group.column("same")[0].as_py())
    hashes, row = grams(Words(group.column("text").combine_chunks()), n)
    order = np.lexsort((hashes, row))
    new = np.append(True, (row[order][1:] != row[order][:-1]) | (hashes[order][1:] != hashes[order][:-1]))
    row, hashes = row[order][new], hashes[order][new]
    size = np.bincount(row, minlength=len(own))
    _, code = np.unique(hashes, return_inverse=True)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    first, second = np.flatnonzero(own), np.flatnonzero(own if inside else ~own)
    shared = np.zeros((len(first), len(second)), np.float32)
    width = 4096
    # The n-grams are taken in strips, so the matrices stay small whatever the blocks hold.
    for low in range(0, int(code[-1]) + 1, width):
        part = slice(np.searchsorted(code, low), np.searchsorted(code, low + width))
        strip = np.zeros((len(own), width), np.float32)
        strip[row[part], code[part] - low] = 1
        shared += strip[first] @ strip[second].T
    linked = shared >= threshold * (size[first][:, None] + size[second][None, :] - shared) - 1e-6
    if inside:
        np.fill_diagonal(linked, False)
    return first, second, linked


def _block_counts(n: int, threshold: float):
    """For a pair of blocks of a class: each text's links into the other block."""

    def run(group: pa.Table) -> pa.Table:
        node, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
        first, second, linked = _linked(group, n, threshold)
        found = [(node[first], linked @ copies[second])]
        if not group.column("same")[0].as_py():
            found.append((node[second], copies[first] @ linked))
        return pa.table({"node": np.concatenate([f[0] for f in found]), "links": np.concatenate([f[1] for f in found]).astype(np.int64)})

    return run


def _block_classes(n: int, threshold: float):
    """For a pair of blocks of a bucket: a pair of texts for each text that links, through others or
    not, to one of another class; as many rows as texts at most."""

    def run(group: pa.Table) -> pa.Table:
        node, component = group.column("node").to_numpy(), group.column("component").to_numpy()
        first, second, linked = _linked(group, n, threshold)
        label, none = np.arange(len(node)), len(node)
        while True:
            before = label.copy()
            if linked.size:
                for one, other, link in ((first, second, linked), (second, first, linked.T)):
                    label[one] = np.minimum(label[one], np.where(link, label[other][None, :], none).min(axis=1))
            if np.array_equal(before, label):
                break
        new = component != component[label]
        a, b = node[new], node[label[new]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _in_block_pairs(members: DataFrame, texts: DataFrame, key: str):
    """Groups of texts: every pair of blocks of each key. members: node, the key and other columns."""
    sized = members.select("node", key).join(texts.select("node", F.octet_length("text").alias("size")), "node")
    blocks = sized.groupBy(key).agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int").alias("blocks")
    )
    placed = members.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = placed.select(*members.columns, "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.select(
        *members.columns, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") <= F.col("other")).alias("own"), (F.col("block") == F.col("other")).alias("same"),
    )
    return spread.join(texts, "node").groupBy(key, "i", "j")


def _count_links(nodes: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """nodes: node, component, copies. Returns node, links: documents with other texts at the threshold or above."""
    counted = _in_block_pairs(nodes, texts, "component").applyInArrow(_block_counts(n, threshold), "node long, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def _compare_whole(members: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """members: bucket, node, component. Returns a, b: texts of different classes that belong together."""
    bits = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"bits{i}") for i in range(2)]
    sets = members.groupBy("bucket").agg(F.count("*").alias("n"), *bits)
    one = sets.groupBy("n", "bits0", "bits1").agg(F.min("bucket").alias("bucket"))
    members = stored(members.join(one, "bucket", "left_semi").select("bucket", "node", "component"), "ngram-whole")
    return _in_block_pairs(members, texts, "bucket").applyInArrow(_block_classes(n, threshold), "a long, b long").distinct()


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """doc_id, node, component, class_id, n_copies, n_links for every row.

    component: the class itself, its smallest node; unrelated classes may share a class_id. class_id: the smallest id of the class. n_copies: other rows of equal words. n_links: rows of other texts
    at the threshold or above, copies counted.
    """
    described = stored(describe(docs, id_col, text_col, n, bands_for(threshold, recall, rows), rows), "ngram-bands")
    classes = described.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("check").alias("low"), F.max("check").alias("high")
    )
    clash = F.assert_true(F.col("low") == F.col("high"), F.lit("different texts of one digest"))
    classes = stored(classes.select("node", "first", F.when(clash.isNull(), F.col("copies")).alias("copies")), "ngram-classes")
    members = described.where("node IS NOT NULL").select("node", F.explode("bands").alias("bucket"))
    # A bucket of one text is no bucket; counted before the shuffle, so copies cost nothing.
    buckets = members.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre <> last")
    shared = members.join(buckets.select("bucket", "centre"), "bucket").distinct()
    shared = stored(shared.select("bucket", "node", "centre"), "ngram-buckets")
    texts = with_node(docs, text_col).join(shared.select("node").distinct(), "node", "left_semi")
    texts = stored(texts.groupBy("node").agg(F.first("text").alias("text")), "ngram-texts")

    stars = shared.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    measured = stored(_verified(stars, texts, n), "ngram-stars")
    links = measured.where(F.col("sim") >= threshold).select("a", "b")
    found = stored(components(links), "ngram-components")

    open_pairs = None
    turn = 0
    while True:
        # What is still undecided: pairs of a bucket's texts that are in different classes.
        classed = shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        parts = classed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
        split = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.expr("sum(n * n)").alias("inner"), F.count("*").alias("classes")).where("classes > 1")
        split = stored(split.select("bucket", "n", ((F.col("n") * F.col("n") - F.col("inner")) / 2).alias("pairs")), "ngram-split")
        texts_open, now = split.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0.0))).first()
        if not now:
            break
        members_open = stored(classed.join(split.select("bucket"), "bucket", "left_semi"), "ngram-open")
        last = now <= SPARSE * texts_open or (open_pairs is not None and now > 0.8 * open_pairs)
        if last:
            more = stored(_compare_whole(members_open, texts, n, threshold), "ngram-more")
        else:
            # Another star: each bucket's texts against one text of the bucket, another in each turn.
            turn += 1
            centres = members_open.groupBy("bucket").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(turn))).alias("c"))
            cross = members_open.join(centres.select("bucket", "c.*").toDF("bucket", "a", "ca"), "bucket").where("component <> ca")
            cross = cross.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
            more = stored(_verified(stored(cross, "ngram-cross"), texts, n).where(F.col("sim") >= threshold).select("a", "b"), "ngram-more")
        if not more.isEmpty():
            links = stored(links.unionByName(more), "ngram-links")
            found = stored(components(links), "ngram-components")
        if last:
            break
        open_pairs = now

    nodes = stored(found.join(classes, "node").select("node", "component", "first", "copies"), "ngram-nodes")
    counts = _count_links(nodes.select("node", "component", "copies"), texts, n, threshold)
    first = nodes.groupBy("component").agg(F.min("first").alias("class_id"))
    linked = nodes.select("node", "component").join(first, "component").join(counts, "node").select("node", "component", "class_id", F.col("links").alias("n_links"))
    whole = classes.join(linked, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"), F.coalesce("class_id", "first").alias("class_id"), (F.col("copies") - 1).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    out = described.select("doc_id", "node").join(stored(whole, "ngram-result"), "node", "left")
    return out.select(
        "doc_id", "node", "component", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_copies", F.lit(0)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: one of its smallest id. All columns stay; rows without words stay."""
    rows = stored(link(docs, id_col, text_col), "ngram-links")
    # One (id, text) stands for a class; how many rows it has is known before rows are moved.
    own = rows.where("node IS NOT NULL AND doc_id <=> class_id").groupBy("component", "doc_id", "node").agg(F.count("*").alias("_rows"))
    # Per class and not per id: a null or repeated id may be the smallest of several classes.
    chosen = own.groupBy("component").agg(F.min(F.struct("doc_id", "node", "_rows")).alias("one"))
    chosen = stored(chosen.select(F.col("one.doc_id").alias("kept_id"), F.col("one.node").alias("node"), F.col("one._rows").alias("copies")), "ngram-kept")
    digest = F.arrow_udf(_digest, "long")
    # The row travels as one struct, so that none of its columns can clash with those added here.
    key = digest(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    marked = docs.select(F.struct("*").alias("row"), docs[id_col].cast("long").alias("id"), key.alias("key"))
    held = marked.join(chosen, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("node")))
    single = held.where("copies = 1").select("row.*")
    several = held.where("copies > 1").dropDuplicates(["kept_id", "node"]).select("row.*")
    return marked.where("key IS NULL").select("row.*").unionByName(single).unionByName(several)


def _digest(texts: pa.Array) -> pa.Array:
    parts = []
    for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", SLICE_BYTES):
        w = Words(part.column(0))
        parts.append(pa.array(signed(w.digests()[0]), mask=w.count == 0))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.int64())


def op2_ngram_jaccard_join(spark, sf_dir):
    return link(table(spark, sf_dir, "documents")).drop("node", "component")
