"""Extendible hashing: shards that split only where they are too large.

A document's shard is a prefix of the bits of its hash. The directory starts with one
shard; a shard over the byte limit, and only such a shard, splits on one more bit.

Defined results: a null text weighs 0 bytes; a null id hashes as the empty string;
documents of one id share all hash bits, so an id whose rows alone exceed the limit is
cut further by a running number over its rows; one row larger than the limit is a
shard of its own size, marked ``oversized``. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablehaul.llm.shared import stored, table

SHARD_BYTES = 64 << 20
HASH_BITS = 60
#: Bits looked at in one pass; a pass over what is left follows while any shard is too large.
STEP_BITS = 12


def id_hash(id_column: Column) -> Column:
    """60 bits of the MD5 of the id as text."""
    text = F.coalesce(id_column.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _directory(sizes: DataFrame, limit: int, start: int) -> DataFrame:
    """For each prefix of ``start + STEP_BITS`` bits the fewest bits that fit, null if none do.

    ``sizes``: cell (that prefix as a number), bytes. Sums for the shorter prefixes come
    from these sums, never from the documents again. A prefix of ``start`` bits is known
    to be too large unless start is 0.
    """
    depths = list(range(start if start == 0 else start + 1, start + STEP_BITS + 1))
    top = start + STEP_BITS
    levels = sizes.select("cell", "bytes", F.explode(F.array(*map(F.lit, depths))).alias("depth"))
    prefix = F.expr(f"shiftright(cell, {top} - depth)").alias("prefix")
    sums = levels.select("depth", prefix, "bytes").groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"))
    fitting = sums.where(F.col("bytes") <= limit)
    fits = levels.select("cell", "depth", prefix).join(fitting, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return sizes.select("cell").join(fits, "cell", "left")


def directory(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """prefix, depth: the shards, none a prefix of another. Depth 60 is where an id alone is too large."""
    hashed = docs.select(id_hash(docs[id_col]).alias("hash"), F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long").alias("bytes"))
    # Rows of one id fall together here, so no later step sees more rows than ids.
    left = stored(hashed.groupBy("hash").agg(F.sum("bytes").alias("bytes")), "shard-sizes")
    found, start = None, 0
    while True:
        top = start + STEP_BITS
        cell = F.expr(f"shiftright(hash, {HASH_BITS - top})")
        sizes = left.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"))
        leaves = stored(_directory(stored(sizes, "shard-cells"), limit, start), "shard-directory")
        done = leaves.where("depth IS NOT NULL").select(F.expr(f"shiftright(cell, {top} - depth)").alias("prefix"), "depth").distinct()
        found = done if found is None else found.unionByName(done)
        over = leaves.where("depth IS NULL").select("cell")
        if over.isEmpty():
            return found
        left = stored(left.join(over, cell == over["cell"], "left_semi"), "shard-left")
        start = top
        if start == HASH_BITS:
            return found.unionByName(over.select(F.col("cell").alias("prefix"), F.lit(HASH_BITS).alias("depth")))


def shard_documents(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, shard (the prefix bits as text), depth, part, n_bytes, oversized for every row.

    With ``carry`` also row, all the document's columns as a struct.

    ``part`` is 0 but where one hash alone is over the limit: there the rows are numbered
    by size and cut so that each part fits.
    """
    leaves = stored(directory(docs, limit, id_col, text_col), "shard-leaves")
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        id_hash(docs[id_col]).alias("hash"),
        F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long").alias("n_bytes"),
        *([F.struct("*").alias("row")] if carry else []),
    )
    # Each depth in use (61 at most) gives one equality to join on.
    depths = sorted(row.depth for row in leaves.select("depth").distinct().collect()) or [0]
    keyed = rows.withColumn("depth", F.explode(F.array(*(F.lit(d).cast("int") for d in depths))))
    keyed = keyed.withColumn("prefix", F.expr(f"shiftright(hash, {HASH_BITS} - depth)"))
    placed = keyed.join(leaves.select("prefix", F.col("depth").cast("int").alias("depth")), ["prefix", "depth"])
    whole = placed.where(F.col("depth") < HASH_BITS).withColumn("part", F.lit(0).cast("long"))
    cut = _parts(placed.where(F.col("depth") == HASH_BITS), limit)
    bits = F.expr("CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END")
    return whole.unionByName(cut).select(
        "doc_id", bits.alias("shard"), F.col("depth").cast("int").alias("depth"), "part", "n_bytes", (F.col("n_bytes") > limit).alias("oversized"),
        *(["row"] if carry else []),
    )


def _parts(heavy: DataFrame, limit: int) -> DataFrame:
    """Rows that share all hash bits, dealt to parts within the limit.

    Rows go to slots at random, each slot numbers its own rows, so no task holds a whole id.
    A slot's part closes at half the limit of running bytes, which keeps every part below the limit
    unless a row alone is over half of it; such a row gets a part of its own.
    """
    slots = 64
    by_slot = Window.partitionBy("hash", "slot").orderBy("n_bytes", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    big = F.col("n_bytes") > limit // 2
    numbered = heavy.withColumn("slot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slots)))
    small_bytes = F.sum(F.when(big, 0).otherwise(F.col("n_bytes"))).over(by_slot)
    alone = F.sum(F.when(big, 1).otherwise(0)).over(by_slot)
    # Even numbers are shared parts, odd ones hold one large row; the slot is the last digits.
    part = F.when(big, 2 * alone + 1).otherwise(2 * F.floor(small_bytes / F.lit(max(limit // 2, 1)))) * slots + F.col("slot")
    return numbered.withColumn("part", part.cast("long")).drop("slot")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Every row, in files of its shard in a folder of its own. Rows carry their columns, so null and repeated ids are written as given.

    Folders are named ``_shard=...``, with as many underscores before as it takes to differ from the rows' own columns.
    """
    placed = shard_documents(docs, limit, id_col, text_col, carry=True)
    name = "_shard"
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    at = F.concat_ws("-", F.concat(F.lit("s"), "shard"), "part").alias(name)
    placed.select("row.*", at).repartition(name).write.partitionBy(name).parquet(path)


def op5_extendible_shards(spark, sf_dir):
    """Every document's shard at the production limit."""
    return shard_documents(table(spark, sf_dir, "documents"))


def oracle(limit: int = SHARD_BYTES, depths: int = 24) -> str:
    """The same in SQL, for tables in which no shard needs more than ``depths`` bits."""
    return f"""
WITH h AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS hash,
    CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents),
levels AS (SELECT d.depth, h.hash >> ({HASH_BITS} - d.depth) AS prefix, sum(h.n_bytes) AS total
  FROM h, (SELECT unnest(range(0, {depths + 1}))::INT AS depth) d GROUP BY 1, 2),
leaf AS (SELECT h.doc_id, h.hash, h.n_bytes, min(l.depth) AS depth FROM h JOIN levels l
  ON l.prefix = h.hash >> ({HASH_BITS} - l.depth) AND l.total <= {limit} GROUP BY 1, 2, 3)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE substr(right(lpad(bin(hash), 64, '0'), {HASH_BITS}), 1, depth) END AS shard,
  CAST(depth AS INT) AS depth, CAST(0 AS BIGINT) AS part, n_bytes, n_bytes > {limit} AS oversized FROM leaf
"""
