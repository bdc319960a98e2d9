"""Removal of repeated passages: seeds found by winnowing, extended both ways.

A window is ``SPAN`` consecutive words. Of every window the smallest hash of ``GRAM`` words is its
seed (rightmost of equals), which depends on the window's words alone, so equal windows have equal
seeds at equal places, and neighbouring windows mostly share one: about one word in
fifteen is a seed. Seeds are joined over all documents. A seed met only once is in no repeat.

Extension goes outward from a repeated seed. If all that any window through it can
reach on both sides is found elsewhere too, the whole stretch is a repeat and is taken at once;
this is the inside of long repeats. Elsewhere a maximal repeat begins or ends, and the windows
that have this seed are compared one by one. Repeats are joined by hash keys of contents, never
by pairs of places, so a passage in a million documents costs a million rows.

The result is exact: a word goes if and only if a window over it also starts elsewhere, in
another row or at another place of the same. Windows are judged on the input. Defined results:
null texts have no words; texts shorter than the span lose nothing; repeated rows are repeats of each
other and lose all; a null id is kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.shared import id_and_text, map_slices, stored, table
from tablehaul.llm.words import Words, mix, signed

SPAN, GRAM = 35, 8


def seeds(w: Words, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of every window within a row, its seed's place, and the hashes of all word groups."""
    n = len(w.hashes)
    p = w.prefix(0)
    grams = mix(p.run(np.arange(max(n - gram + 1, 0)), np.arange(gram, max(n, gram - 1) + 1))) if n >= gram else np.zeros(0, np.uint64)
    width = span - gram + 1
    starts = np.arange(max(n - span + 1, 0))
    starts = starts[w.doc[starts] == w.doc[starts + span - 1]] if len(starts) else starts
    if not len(starts):
        return starts, starts, grams
    place = np.empty(len(grams) - width + 1, np.int64)
    step = 1 << 22
    for low in range(0, len(place), step):  # the place of a seed takes 24 bits
        part = grams[low : low + step + width - 1]
        at = np.arange(len(part), dtype=np.uint64)
        keyed = (part & np.uint64(0xFFFFFFFFFF000000)) | (np.uint64(0xFFFFFF) - at)  # of equals the rightmost is smallest
        place[low : low + step] = low + (0xFFFFFF - (_sliding_min(keyed, width) & np.uint64(0xFFFFFF)).astype(np.int64))
    return starts, place[starts], grams


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by running minima within blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def reach(w: Words, at: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of what windows through the seeds at ``at`` can reach."""
    row = w.doc[at]
    return np.maximum(w.first[row], at - (span - gram)), np.minimum(w.first[row + 1], at + span)


def describe(docs: DataFrame, id_col: str, text_col: str, span: int, gram: int) -> DataFrame:
    """doc_id, node and check (digests), n_words, whole_sha256, and the seeds: place, seed, around."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(batch.column(1))
        _, chosen, grams = seeds(w, span, gram)
        at = np.unique(chosen)
        low, high = reach(w, at, span, gram)
        around = mix(w.prefix(1).run(low, high) + ((at - low) * 1000 + (high - at)).astype(np.uint64))
        begins = pa.array(np.searchsorted(at, w.first).astype(np.int32))
        lists = lambda x: pa.ListArray.from_arrays(begins, pa.array(x))
        sums = [hashlib.sha256(b" ".join(w.row_words(d))).hexdigest() for d in range(w.rows)]
        one, two = w.digests()
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(signed(one)), pa.array(signed(two)), pa.array(w.count.astype(np.int64)), pa.array(sums),
                lists((at - w.first[w.doc[at]]).astype(np.int32)), lists(signed(grams[at] if len(at) else grams[:0])), lists(signed(around)),
            ],
            names=["doc_id", "node", "check", "n_words", "whole_sha256", "place", "seed", "around"],
        )

    schema = "doc_id long, node long, check long, n_words long, whole_sha256 string, place array<int>, seed array<long>, around array<long>"
    return map_slices(id_and_text(docs, id_col, text_col), work, schema)


_SEEN = ("low_node", "high_node", "low_place", "high_place")


def _seen(place: str) -> list[Column]:
    """Enough of where a key was seen to know whether it was seen twice; copies of a text count once."""
    return [F.min("node").alias("low_node"), F.max("node").alias("high_node"), F.min(place).alias("low_place"), F.max(place).alias("high_place")]


_TWICE = "(low_node <> high_node OR low_place <> high_place)"


def _packed(docs: DataFrame, text_col: str) -> DataFrame:
    """node and the text, compressed for the shuffles to come."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        w = Words(batch.column(0))
        raw = [packer.compress(w.data[w.row_at[d] : w.row_at[d + 1]].tobytes()) for d in range(w.rows)]
        return pa.RecordBatch.from_arrays([pa.array(signed(w.digests()[0])), pa.array(raw, pa.binary())], names=["node", "packed"])

    return map_slices(docs.select(F.coalesce(docs[text_col], F.lit("")).alias("text")), work, "node long, packed binary")


def _unpacked(column: pa.Array) -> pa.Array:
    import zstandard

    opener = zstandard.ZstdDecompressor()
    return pa.array([opener.decompress(v) for v in column.to_pylist()], pa.binary())


def _offsets(column: pa.ListArray, w: Words) -> np.ndarray:
    """Word numbers of the slice from places within rows; null lists are empty."""
    lists = column.to_pylist()
    return np.concatenate([np.array(x or [], np.int64) + w.first[d] for d, x in enumerate(lists)]) if lists else np.zeros(0, np.int64)


def _windows(rows: DataFrame, span: int, gram: int) -> DataFrame:
    """rows: node, packed, single (places of seeds). The windows of those seeds: node, seed, code, start."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(_unpacked(batch.column(1)))
        starts, chosen, grams = seeds(w, span, gram)
        own = np.isin(chosen, _offsets(batch.column(2), w))
        starts, chosen = starts[own], chosen[own]
        code = mix(w.prefix(1).run(starts, starts + span))
        row = w.doc[starts] if len(starts) else starts
        node = batch.column(0).to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays(
            [pa.array(node[row]), pa.array(signed(grams[chosen] if len(starts) else grams[:0])), pa.array(signed(code)), pa.array((starts - w.first[row]).astype(np.int32))],
            names=["node", "seed", "code", "start"],
        )

    return map_slices(rows, work, "node long, seed long, code long, start int", size_column="packed", slice_bytes=1 << 20)


def _cut(rows: DataFrame, span: int, gram: int, with_text: bool) -> DataFrame:
    """rows: node, packed, whole (places of seeds whose surroundings repeat), starts (of repeated windows)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(_unpacked(batch.column(1)))
        change = np.zeros(len(w.hashes) + 1, np.int64)
        low, high = reach(w, _offsets(batch.column(2), w), span, gram)
        start = _offsets(batch.column(3), w)
        np.add.at(change, np.concatenate([low, start]), 1)
        np.add.at(change, np.concatenate([high, start + span]), -1)
        gone = np.cumsum(change)[:-1] > 0
        out = []
        for d in range(w.rows):
            mark = gone[w.first[d] : w.first[d + 1]]
            kept = b" ".join(word for word, cut in zip(w.row_words(d), mark) if not cut)
            out.append((int(mark.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.string())],
            names=["node", "n_removed", "kept_sha256", "kept"],
        )

    return map_slices(rows, work, "node long, n_removed long, kept_sha256 string, kept string", size_column="packed", slice_bytes=1 << 20)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, with_text: bool = False
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row, and the kept words where asked for (null if none were removed)."""
    described = stored(describe(docs, id_col, text_col, span, gram), "substring-seeds")
    texts = described.groupBy("node").agg(F.count("*").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"))
    clash = F.assert_true(F.col("low") == F.col("high"), F.lit("different texts of one digest"))
    copied = stored(texts.select("node", F.when(clash.isNull(), F.col("n")).alias("n")).where("n > 1").select("node"), "substring-copies")

    met = described.select("node", F.inline(F.arrays_zip("place", "seed", "around")))
    # A text for each content, at which its windows can be looked up.
    contents = stored(met.groupBy("seed", "around").agg(*_seen("place"), F.min_by("place", "node").alias("place")), "substring-contents")
    fold = [(F.min if c.startswith("low") else F.max)(c).alias(c) for c in _SEEN]
    lone = F.max(F.expr(f"NOT {_TWICE}")).alias("lone")  # met among other contents, or only once
    repeated = contents.groupBy("seed").agg(*fold, lone).where(_TWICE).select("seed", "lone")
    known = contents.join(repeated, "seed").select("seed", "around", F.expr(_TWICE).alias("whole"), "lone", F.col("low_node").alias("node"), "place")
    known = stored(known, "substring-known")
    places = met.join(known.select("seed", "around", "whole"), ["seed", "around"]).select("node", "place", "whole")
    # Where a seed has edges of repeats, every content it has is compared window by window, one text for each.
    examples = known.where("whole AND lone").select("node", "place", F.lit(False).alias("whole"))
    copies = copied.withColumn("copied", F.lit(True))
    every = places.unionByName(examples).join(copies, "node", "left").where("NOT whole OR copied IS NULL")
    marks = every.groupBy("node").agg(
        F.collect_set(F.when(F.col("whole"), F.col("place"))).alias("whole"), F.collect_set(F.when(~F.col("whole"), F.col("place"))).alias("single")
    )
    marks = stored(marks, "substring-marks")
    packed = _packed(docs, text_col).join(marks.select("node"), "node", "left_semi").groupBy("node").agg(F.first("packed").alias("packed"))
    work = stored(packed.join(marks, "node").select("node", "packed", "whole", "single"), "substring-texts")

    windows = stored(_windows(work.where(F.size("single") > 0).select("node", "packed", "single"), span, gram), "substring-windows")
    again = windows.groupBy("seed", "code").agg(*_seen("start")).where(_TWICE).select("seed", "code")
    starts = windows.join(again, ["seed", "code"], "left_semi").groupBy("node").agg(F.collect_set("start").alias("starts"))
    cut = _cut(work.join(starts, "node", "left").where("size(whole) > 0 OR starts IS NOT NULL").select("node", "packed", "whole", "starts"), span, gram, with_text)
    cut = stored(cut, "substring-cut")

    joined = described.select("doc_id", "node", "n_words", "whole_sha256").join(copies, "node", "left").join(cut, "node", "left")
    all_gone = F.col("copied").isNotNull() & (F.col("n_words") >= span)
    kept = F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "whole_sha256"))
    out = joined.select(
        "doc_id", "n_words", F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        kept.alias("kept_sha256"), F.when(all_gone, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )
    return out if with_text else out.drop("kept")


def op8_seed_extend_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


#: The definition itself: every window's words counted, over all rows.
ORACLE = r"""
WITH given AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS MATERIALIZED (
  SELECT r, s, array_to_string(words[s:s + 34], ' ') AS content
  FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS s FROM given WHERE len(words) >= 35)
), met_again AS (
  SELECT content FROM windows GROUP BY content HAVING count(*) > 1
), covered AS MATERIALIZED (
  SELECT DISTINCT r, unnest(range(s, s + 35)) AS p FROM windows SEMI JOIN met_again USING (content)
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS kept
  FROM (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM given) ANTI JOIN covered USING (r, p) GROUP BY r
), gone AS (
  SELECT r, count(*) AS n_removed FROM covered GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM given LEFT JOIN kept USING (r) LEFT JOIN gone USING (r)
"""
