"""A Merkle manifest of a dataset: every row a leaf, a tree for each source, a tree over the sources.

A leaf's rank within its source is written in base ``FAN``. Blocks of ``FAN ** DIGITS`` leaves are built by grouping
one rank digit away after the other: each step nests the structs of the step before, so a block becomes
one row that holds its leaves in the shape of its tree. Digests of a block's nodes follow by transforms of the nested
arrays; the blocks' digests are the leaves of the next tier, until one is left for each source, and the
sources' digests of another tree, in the same way. On the way down each nested row is exploded with the siblings at
hand; no leaf is joined with anything. Between two tiers a block (one row for 4096 leaves) meets its path by grouping.

Ranks need no global window: rows are range-partitioned, numbered within their partition, and one offset for each
partition (from the counts of its first and last source) completes them.

Defined results: a null field counts as ``-``, a null source is a source of its own and first; leaves of one
doc_id (null before all others) are in the order of their digests, repeated rows side by side; an empty table gives
no rows and has no root; columns beyond the five leaf fields are ignored; a text of any length is hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.shared import stored, table

FAN, DIGITS = 16, 3
BLOCK = FAN**DIGITS
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Of documents, those whose crc32(doc_id as text) divides by this are tampered with.
TAMPERED = 5


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _of(digests: Column) -> Column:
    """The digest of a node from its children's, an array."""
    return F.sha2(F.array_join(digests, "").cast("binary"), 256)


def leaf_of(columns: dict[str, Column]) -> Column:
    """Each field as ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    return digest(*(F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns.values()))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, bad (the leaf after tampering, null where nothing is done)."""
    fields = {name: docs[name] for name in LEAF_FIELDS}
    lower = F.translate(docs["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(docs["doc_id"].cast("string").cast("binary")) % TAMPERED == 0
    return docs.select(
        fields["doc_id"].cast("long").alias("doc_id"), fields["source"].cast("string").alias("source"),
        leaf_of(fields).alias("leaf"), F.when(tampered, leaf_of(fields | {"text": lower})).alias("bad"),
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their number within the partition's source, and the source's number within the partition."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, n_sources, n_rows = None, 0, 0
    for batch in batches:
        runs = pc.run_end_encode(batch.column("source"))
        numbers, ranks, begin = [], [], 0
        for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            if last is None or last[0] != value:
                last, n_rows = (value,), 0
                n_sources += 1
            numbers.append(pa.repeat(pa.scalar(n_sources - 1, pa.int64()), end - begin))
            ranks.append(pc.add(pa.array(range(end - begin), pa.int64()), n_rows))
            n_rows += end - begin
            begin = end
        if batch.num_rows:
            columns = [pa.repeat(pa.scalar(part, pa.int32()), batch.num_rows), pa.concat_arrays(numbers), pa.concat_arrays(ranks)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "part", "number", "rank"])


def ranked(rows: DataFrame) -> DataFrame:
    """leaves() with src (the number of the row's source among all) and rank (within its source), from zero."""
    schema = "doc_id long, source string, leaf string, bad string, part int, number long, rank long"
    dealt = rows.repartitionByRange("source", "doc_id", "leaf").sortWithinPartitions("source", "doc_id", "leaf")
    dealt = stored(dealt.mapInArrow(_numbered, schema), "merkle-numbered")
    ends = dealt.groupBy("part").agg(
        F.max("number").alias("last"),
        F.min_by(F.struct("source"), "number").alias("first_source"), F.max_by(F.struct("source"), "number").alias("last_source"),
        F.max_by("rank", F.struct("number", "rank")).alias("last_rank"),
    )
    # One row for each partition: its first source may go on from the partition before.
    src, rank, at, end = {}, {}, -1, None
    for row in sorted(ends.collect()):
        goes_on = end is not None and end[0] == row.first_source
        src[row.part] = at + (not goes_on)
        rank[row.part] = end[1] + 1 if goes_on else 0
        at = src[row.part] + row.last
        end = (row.last_source, row.last_rank + (rank[row.part] if row.last == 0 else 0))
    if not src:
        return dealt.select("doc_id", "leaf", "bad", F.col("number").alias("src"), "rank")
    of = lambda offsets: F.get(F.lit([offsets.get(p, 0) for p in range(max(offsets) + 1)]), F.col("part"))
    return dealt.select(
        "doc_id", "leaf", "bad", (F.col("number") + of(src)).cast("long").alias("src"),
        (F.col("rank") + F.when(F.col("number") == 0, of(rank)).otherwise(0)).cast("long").alias("rank"),
    )


def tier(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """nodes: tree, rank, leaf (a digest) and payload columns. One row for each block of a tree: tree, block, kids (the
    leaves, nested by rank digits), n1 and n2 (digests of the inner nodes), levels (how many the block has), digest.

    A tree's only block stops at the level on which one node is left; any other block is whole levels high.
    """
    digits = [F.pmod(F.floor(F.col("rank") / FAN**i), F.lit(FAN)).cast("int") for i in range(DIGITS)]
    rows = nodes.select(
        "tree", F.floor(F.col("rank") / BLOCK).cast("long").alias("block"), digits[2].alias("d2"), digits[1].alias("d1"),
        F.struct(digits[0].alias("d0"), "leaf", *payload).alias("kid"),
    ).repartition("tree", "block")
    runs = rows.groupBy("tree", "block", "d2", "d1").agg(F.array_sort(F.collect_list("kid")).alias("kids"))
    runs = runs.groupBy("tree", "block", "d2").agg(F.array_sort(F.collect_list(F.struct("d1", "kids"))).alias("kids"))
    blocks = runs.groupBy("tree", "block").agg(F.array_sort(F.collect_list(F.struct("d2", "kids"))).alias("kids"))
    kids = F.transform("kids", lambda a: F.transform(a["kids"], lambda b: b["kids"]))
    blocks = blocks.select("tree", "block", kids.alias("kids"))
    n = F.aggregate("kids", F.lit(0), lambda total, a: total + F.aggregate(a, F.lit(0), lambda part, b: part + F.size(b)))
    only = (F.col("block") == 0) & (n < BLOCK)
    levels = F.when(only & (n == 1), 0).when(only & (n <= FAN), 1).when(only & (n <= FAN**2), 2).otherwise(3)
    blocks = blocks.select("*", levels.alias("levels"), F.transform("kids", lambda a: F.transform(a, lambda b: _of(b["leaf"]))).alias("n1"))
    blocks = blocks.select("*", F.transform("n1", _of).alias("n2"))
    top = (
        F.when(F.col("levels") == 0, F.col("kids")[0][0][0]["leaf"]).when(F.col("levels") == 1, F.col("n1")[0][0])
        .when(F.col("levels") == 2, F.col("n2")[0]).otherwise(_of(F.col("n2")))
    )
    return stored(blocks.select("*", top.alias("digest")), "merkle-tier")


def climb(nodes: DataFrame, payload: list[str]) -> list[DataFrame]:
    """The tiers of all trees, the lowest first; the last has one block for each tree, its digest is the tree's."""
    tiers = [tier(nodes, payload)]
    while tiers[-1].agg(F.max("block")).first()[0]:
        tiers.append(tier(tiers[-1].select("tree", F.col("block").alias("rank"), F.col("digest").alias("leaf")), []))
    return tiers


def _others(digests: Column, at: Column) -> Column:
    return F.concat(F.slice(digests, F.lit(1), at), F.slice(digests, at + 2, F.lit(FAN)))


def descend(blocks: DataFrame, paths: DataFrame, payload: list[str]) -> DataFrame:
    """Steps of every leaf of a tier's blocks: tree, rank, payload columns, leaf, steps and passed columns.

    paths: tree, block, steps (array of struct<at, others>, from the block's digest to the top) and any columns to hand down.
    A step names the siblings and how many of them stand to the left.
    """
    passed = [c for c in paths.columns if c not in ("tree", "block")]
    kept = ["kids", "n1", "n2", "levels"]
    both = blocks.select("tree", "block", F.struct(*kept).alias("node"), *(F.lit(None).cast(paths.schema[c].dataType).alias(c) for c in passed))
    both = both.unionByName(paths.select("tree", "block", F.lit(None).cast(both.schema["node"].dataType).alias("node"), *passed))
    met = both.groupBy("tree", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("node", *passed)))
    met = met.select("tree", "block", *(F.col(f"node.{c}").alias(c) for c in kept), *passed)
    own = ["tree", "block", "levels", *passed]
    met = met.select(*own, "n1", "n2", F.posexplode("kids").alias("i2", "kids"))
    met = met.select(*own, "i2", F.col("n1")[F.col("i2")].alias("n1"), _others(F.col("n2"), F.col("i2")).alias("s3"), F.posexplode("kids").alias("i1", "kids"))
    leaf = F.col("kids")["leaf"]
    met = met.select(*own, "i2", "i1", "s3", _others(F.col("n1"), F.col("i1")).alias("s2"), leaf.alias("run"), F.posexplode("kids").alias("i0", "kid"))
    step = lambda at, others: F.struct(F.col(at).alias("at"), others.alias("others"))
    inner = F.array(step("i0", _others(F.col("run"), F.col("i0"))), step("i1", F.col("s2")), step("i2", F.col("s3")))
    rank = F.col("block") * BLOCK + F.col("i2") * FAN**2 + F.col("i1") * FAN + F.col("i0")
    steps = F.concat(F.slice(inner, F.lit(1), F.col("levels")), F.col("steps"))
    return met.select(
        "tree", rank.alias("rank"), F.col("kid.leaf").alias("leaf"), *(F.col(f"kid.{c}").alias(c) for c in payload),
        steps.alias("steps"), *(c for c in passed if c != "steps"),
    )


_STEPS = "array<struct<at:int,others:array<string>>>"


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda own, s: F.sha2(
        F.concat(F.array_join(F.slice(s["others"], F.lit(1), s["at"]), ""), own, F.array_join(F.slice(s["others"], s["at"] + 1, F.lit(FAN)), "")).cast("binary"), 256
    ))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, steps (the siblings to the root), bad (the tampered leaf or null) for every row."""
    payload = ["doc_id", "bad"]
    trees = climb(ranked(leaves(docs)).withColumnRenamed("src", "tree"), payload)
    subroots = trees[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.col("digest").alias("leaf"))
    above = climb(subroots, [])
    root = above[-1].agg(F.first("digest")).first()[0]
    paths = above[-1].select("tree", "block", F.expr(f"CAST(array() AS {_STEPS})").alias("steps"))
    for blocks in reversed(above):
        down = descend(blocks, paths, [])
        paths = down.select("tree", F.col("rank").alias("block"), "steps", F.col("leaf").alias("subroot"))
        if blocks is not above[0]:
            paths = paths.drop("subroot")
    paths = paths.select(F.col("block").alias("tree"), F.lit(0).cast("long").alias("block"), "steps", "subroot")
    for blocks in reversed(trees[1:]):
        paths = descend(blocks, paths, []).select("tree", F.col("rank").alias("block"), "steps", "subroot")
    return descend(trees[0], paths, payload).select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "steps", "bad")


def op11_nested_merkle_manifest(spark, sf_dir):
    proof = F.sha2(F.array_join(F.flatten(F.transform("steps", lambda s: s["others"])), "").cast("binary"), 256)
    rows = manifest(table(spark, sf_dir, "documents")).select(
        "doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("bad", "leaf"), F.col("steps")).alias("folded_root")
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 and the trees level by level, by recursion.
ORACLE = """
WITH RECURSIVE polynomial AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), docs AS (
  SELECT row_number() OVER () AS row, doc_id, source, text, lang, n_chars,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc
  FROM documents, polynomial
), texts AS (
  SELECT row, doc_id, source, crc % 5 = 0 AS hit,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body,
    coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS bad
  FROM docs
), hashed AS (
  SELECT row, doc_id, source, sha256(head || body) AS leaf, CASE WHEN hit THEN sha256(head || bad) ELSE sha256(head || body) END AS start FROM texts
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS rank,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM hashed
), up AS (
  SELECT 0 AS level, tree, rank, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT level + 1, tree, rank // 16, sha256(string_agg(node, '' ORDER BY rank)), (any_value(n) + 15) // 16
  FROM up WHERE n > 1 GROUP BY level, tree, rank // 16
), subroots AS (
  SELECT tree, node AS subroot, level AS height FROM up WHERE n = 1
), over AS (
  SELECT 0 AS level, tree AS rank, subroot AS node, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL
  SELECT level + 1, rank // 16, sha256(string_agg(node, '' ORDER BY rank)), (any_value(n) + 15) // 16
  FROM over WHERE n > 1 GROUP BY level, rank // 16
), runs AS (
  SELECT tree, level, rank // 16 AS run, list(node ORDER BY rank) AS nodes FROM up WHERE n > 1 GROUP BY ALL
), over_runs AS (
  SELECT level, rank // 16 AS run, list(node ORDER BY rank) AS nodes FROM over WHERE n > 1 GROUP BY ALL
), path AS (
  SELECT row, level, r.nodes, (rank // (16 ** level)::BIGINT) % 16 AS place
  FROM leaves JOIN runs r ON r.tree = leaves.tree AND r.run = rank // (16 ** (level + 1))::BIGINT
  UNION ALL
  SELECT row, height + level, o.nodes, (tree // (16 ** level)::BIGINT) % 16
  FROM leaves JOIN subroots USING (tree) JOIN over_runs o ON o.run = tree // (16 ** (level + 1))::BIGINT
), proofs AS (
  SELECT row, sha256(string_agg(array_to_string(list_slice(nodes, 1, place) || list_slice(nodes, place + 2, 16), ''), '' ORDER BY level)) AS proof FROM path GROUP BY row
), fold AS (
  SELECT row, 0::BIGINT AS level, start AS node FROM leaves
  UNION ALL
  SELECT row, fold.level + 1, sha256(array_to_string(list_slice(path.nodes, 1, place) || [node] || list_slice(path.nodes, place + 2, 16), ''))
  FROM fold JOIN path USING (row, level)
), top AS (
  SELECT row, arg_max(node, level) AS folded_root FROM fold GROUP BY row
)
SELECT doc_id, leaf, subroot, (SELECT node FROM over WHERE n = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root,
  folded_root = (SELECT node FROM over WHERE n = 1) AS verified
FROM leaves JOIN subroots USING (tree) JOIN top USING (row) LEFT JOIN proofs USING (row)
"""
