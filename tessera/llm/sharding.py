"""Operator 2: shards by jump consistent hashing, in DataFrame functions only.

Rows with equal keys always share a shard.  A null key is a key of its own.
Repeated rows are kept and get slots of their own; an empty table gives an
empty result; columns other than the key pass through untouched, whatever their
names.  Texts of any length count whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ordered_positions

# Fixed value: the multiplier of the published algorithm's linear congruential
# generator, 2862933555777941757, as its high 32 bits and two low 16-bit limbs.
_MULTIPLIER = 2862933555777941757
_HIGH, _LOW1, _LOW0 = _MULTIPLIER >> 32, (_MULTIPLIER >> 16) & 0xFFFF, _MULTIPLIER & 0xFFFF
#: Jumps tried for every key; a key that needs more (rarer than 1 in 10**9) goes on to the full bound.
_JUMPS = 40


def _jumps(hi: str, lo: str, shards: int, bound: int) -> str:
    """SQL for the state after at most ``bound`` jumps below ``shards + 1``.

    State: the generator's word as two 32-bit halves (so that no product leaves
    63 bits, which ANSI mode would refuse), the last two buckets and the next.
    """
    return f"""aggregate(sequence(1, {bound}),
      named_struct('hi', {hi}, 'lo', {lo}, 'was', -1L, 'b', -1L, 'j', 0L),
      (s, i) -> if(s.j > {shards}, s,
        transform(array(s.lo * {_LOW0}L + ((s.lo * {_LOW1}L) & 65535) * 65536L + 1L), low ->
          transform(array((shiftright(low, 32) + shiftright(s.lo * {_LOW1}L, 16) + ((s.lo * {_HIGH}L) & 4294967295)
              + ((s.hi * {_LOW0}L) & 4294967295) + ((s.hi * {_LOW1}L) & 65535) * 65536L) & 4294967295), high ->
            named_struct('hi', high, 'lo', low & 4294967295, 'was', s.b, 'b', s.j,
              'j', cast(floor((s.j + 1) * (2147483648D / (shiftright(high, 1) + 1))) as bigint)))[0])[0]))"""


def jump_shards(df: DataFrame, key: Column, shards: int, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """Adds the shard among ``shards`` and the shard there would be with one more.

    ``key`` is a BIGINT expression, hashed as it is; null counts as the key 0 with all
    bits flipped.  The jump sequence of a key does not depend on the shard count,
    so both answers come from one walk, and adding a shard moves rows only into it.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    hashed = "__key" + "_" * max(map(len, df.columns), default=0)  # longer than any name there is
    jump = "__jump" + hashed
    df = df.withColumn(hashed, F.coalesce(key.cast("bigint"), F.lit(-1)))
    hi, lo = f"shiftrightunsigned({hashed}, 32)", f"{hashed} & 4294967295"
    df = df.withColumn(jump, F.expr(_jumps(hi, lo, shards, min(_JUMPS, shards + 1))))
    if shards + 1 > _JUMPS:
        df = df.withColumn(jump, F.expr(f"if({jump}.j > {shards}, {jump}, {_jumps(hi, lo, shards, shards + 1)})"))
    own = F.when(F.col(f"{jump}.b") < shards, F.col(f"{jump}.b")).otherwise(F.col(f"{jump}.was"))
    return df.withColumn(shard, own.cast("int")).withColumn(grown, F.col(f"{jump}.b").cast("int")).drop(hashed, jump)


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document with its shard and its slot in it, in doc_id order.

    Null text counts as empty.  Ties of doc_id are ordered by size and checksum.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = jump_shards(rows, F.col("doc_id"), shards)
    rows = ordered_positions(rows, ["shard"], ["doc_id", "text_crc32", "size"], "shards")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("_slot").alias("slot"), "grown_shard")
