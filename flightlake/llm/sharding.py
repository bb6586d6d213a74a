"""Sharding by jump consistent hashing, in DataFrame functions only.

A key's shard depends on the key and on the number of shards.  No ring table is kept: a 64-bit linear
congruential generator, seeded with the key, draws the shard counts at which the key would move;
the last one below the number of shards is the shard.  Appending a shard moves only the keys that
the new shard takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, table

# Fixed values of the published jump consistent hash: multiplier of the generator and its 2^31.
LCG_MULTIPLIER = 2862933555777941757
LCG_INCREMENT = 1
TWO_31 = 2147483648.0

_C = (LCG_MULTIPLIER & 0x3FFFFF, (LCG_MULTIPLIER >> 22) & 0x3FFFFF, LCG_MULTIPLIER >> 44)
#: Fold steps taken before asking whether a key still has to jump (about 1 + ln(shards) are needed).
FIRST_STEPS = 48


def _next_key(k: Column) -> Column:
    """k * multiplier + increment modulo 2^64, in limbs of 22 bits: no step overflows a long."""
    a0, a1, a2 = k.bitwiseAND(0x3FFFFF), F.shiftrightunsigned(k, 22).bitwiseAND(0x3FFFFF), F.shiftrightunsigned(k, 44)
    p0 = a0 * _C[0] + F.lit(LCG_INCREMENT).cast("long")
    p1 = F.shiftright(p0, 22) + a0 * _C[1] + a1 * _C[0]
    p2 = F.shiftright(p1, 22) + a0 * _C[2] + a1 * _C[1] + a2 * _C[0]
    high = F.shiftleft(p2.bitwiseAND(0xFFFFF), 44)
    return high.bitwiseOR(F.shiftleft(p1.bitwiseAND(0x3FFFFF), 22)).bitwiseOR(p0.bitwiseAND(0x3FFFFF))


def _fold(state: Column, limit: int, steps: int) -> Column:
    def step(s: Column, _: Column) -> Column:
        k = s["next"]
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(TWO_31) / (F.shiftrightunsigned(k, 33) + 1).cast("double")))
        # b: the last jump below limit - 1, prev: the last below limit; one walk serves both shard counts
        moved = F.struct(
            F.when(s["j"] < limit - 1, s["j"]).otherwise(s["b"]).alias("b"),
            j.cast("long").alias("j"),
            _next_key(k).alias("next"),
            s["j"].alias("prev"),
        )
        return F.when(s["j"] < limit, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)


def jump_shards(key: Column, shards: int) -> Column:
    """struct(shard, grown): the shard among ``shards`` and among ``shards`` + 1; a null key counts as -1."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    limit = shards + 1
    k0 = F.coalesce(key.cast("long"), F.lit(-1).cast("long"))
    start = F.struct(
        F.lit(0).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
        _next_key(k0).alias("next"),
        F.lit(0).cast("long").alias("prev"),
    )
    state = _fold(start, limit, min(limit, FIRST_STEPS))
    if limit > FIRST_STEPS:  # a walk of more steps is rare, and exact all the same
        state = F.when(state["j"] < limit, _fold(state, limit, limit)).otherwise(state)
    return F.struct(state["b"].cast("int").alias("shard"), state["prev"].cast("int").alias("grown"))


def shard(df: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row.

    Slots number a shard's rows from 0 without gaps, in the order of the key.  Rows are dealt into
    key ranges once and written to the shared folder, so that the counts and the numbers come from
    the same ranges even if executors are lost; a range holds a share of the rows, whatever the
    number of shards.  A null key counts as -1 and comes first; a null text has size 1 and the CRC of the empty
    text; equal keys get neighbouring slots in either order; other columns are not read.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("_k"),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        jump_shards(F.col(key), shards).alias("_s"),
    ).select("_k", "size", "text_crc32", F.col("_s.shard").alias("shard"), F.col("_s.grown").alias("grown_shard"))
    rows = rows.repartitionByRange("_k").withColumn("_range", F.spark_partition_id())
    rows = materialize(rows, "shards")
    per = rows.groupBy("shard", "_range").count()
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("shard", "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("shard", "_range").orderBy("_k")) - 1
    out = rows.withColumn("_n", inside).join(per, ["shard", "_range"])
    return out.select(
        F.col("_k").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_before") + F.col("_n")).cast("long").alias("slot"),
        "grown_shard",
    )


def op9_jump_sharding(spark, sf_dir) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), "doc_id", "text", 8)


OP9_SQL = """
WITH RECURSIVE walk(doc_id, k, b, prev, j) AS (
  SELECT doc_id,
         (CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE doc_id::HUGEINT END),
         0::BIGINT, 0::BIGINT, 0::BIGINT
  FROM documents
  UNION ALL
  SELECT doc_id, nk, CASE WHEN j < 8 THEN j ELSE b END, j,
         floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((nk // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS nk FROM walk WHERE j < 9)
), placed AS (SELECT doc_id, b AS shard, prev AS grown FROM walk WHERE j >= 9),
crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, [0,0,0,0,0,0,0,0]::BIGINT[]),
           lambda a, x: CASE WHEN a % 2 = 1 THEN xor(3988292384::BIGINT, a // 2) ELSE a // 2 END) AS c
    FROM range(256) r(i))
), crc AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
         xor(4294967295::BIGINT, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(strlen(coalesce(text, ''))),
             lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT)),
           lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1]))) AS text_crc32
  FROM documents CROSS JOIN crc_table
)
SELECT p.doc_id, c.size::BIGINT AS size, c.text_crc32, 'key' AS law, p.shard::INTEGER AS shard,
       (row_number() OVER (PARTITION BY p.shard ORDER BY p.doc_id) - 1)::BIGINT AS slot,
       p.grown::INTEGER AS grown_shard
FROM placed p JOIN crc c USING (doc_id)
"""
