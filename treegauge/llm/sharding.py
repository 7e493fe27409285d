"""Sharding by a permutation-filled lookup table; DataFrame functions only.

Every shard has its own order of preference over the slots of a prime-sized table: it starts at a slot
taken from its name and walks in steps taken from its name, which visits all slots as the size is
prime. Shards take turns, each claiming the first slot of its order that is free, until the table is
full. Loads then differ by one slot at most, and removing a shard moves few other slots. A document
goes to the slot its id hashes to. The table has a fixed size, whatever the data: it is broadcast, and
placing a row is one lookup in a narrow stage.

A null id goes to the slot of the empty string. Rows with the same id, repeated ones too, land in the same
shard. Null, empty and very long texts are written like others. Empty tables give empty results; other columns
are not read by `place` and are kept by `write_shards`, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treegauge.llm.common import chosen, passing_path, unused_name

#: At least a hundred slots a shard keep loads within one percent; a prime.
SLOTS = 4099
SHARDS = tuple(f"shard-{i:02d}" for i in range(32))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The owner of each slot, as an index into `shards`. Its cost depends on `slots` only."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one, at most as many as slots")
    if any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    at = [_number(f"start:{s}") % slots for s in shards]
    step = [_number(f"step:{s}") % (slots - 1) + 1 for s in shards]
    owner: list[int] = [-1] * slots
    for turn in range(slots):
        i = turn % len(shards)
        while owner[at[i]] >= 0:
            at[i] = (at[i] + step[i]) % slots
        owner[at[i]] = i
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot a key hashes to."""
    digits = F.substring(F.md5(F.concat(F.lit("doc:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 15)
    return (F.conv(digits, 16, 10).cast("bigint") % slots).cast("int")


def slot_frame(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The table as rows (slot, shard)."""
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    return (spark.range(1, numPartitions=1).select(F.posexplode(owners).alias("slot", "owner"))
            .select("slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard")))


def _placed(docs: DataFrame, doc_id: str, slot: str, shard: str, shards: tuple[str, ...], slots: int) -> DataFrame:
    """Whole rows with their slot and shard, looked up in the broadcast table."""
    table = slot_frame(docs.sparkSession, shards, slots).select(F.col("slot").alias(slot), F.col("shard").alias(shard))
    return docs.withColumn(slot, slot_of(F.col(f"`{doc_id}`"), slots)).join(F.broadcast(table), slot)


def place(docs: DataFrame, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, doc_id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, slot, shard."""
    return _placed(chosen(docs, doc_id=doc_id), "doc_id", "slot", "shard", shards, slots).select("doc_id", "slot", "shard")


def write_shards(docs: DataFrame, path: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, doc_id: str = "doc_id") -> str:
    """Writes whole rows as Parquet into one folder a shard; returns the name of the column that the folders stand for.

    The rows of a shard are rebalanced: a shard beyond the advisory partition size, be it by one hot id, is written by
    several tasks, each of about that size, and small shards share a task.
    """
    slot, shard = unused_name(docs.columns, "slot"), unused_name(docs.columns, "shard")
    _placed(docs, doc_id, slot, shard, shards, slots).drop(slot).hint("rebalance", F.col(shard)).write.partitionBy(shard).parquet(path)
    return shard


def read_shards(docs: DataFrame, path: str, shard: str) -> DataFrame:
    """What `write_shards` wrote of docs, with the shard as a column."""
    fields = [*docs.schema.fields, T.StructField(shard, T.StringType())]
    return docs.sparkSession.read.schema(T.StructType(fields)).parquet(path)


def shard_documents(docs: DataFrame, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, doc_id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, slot, shard, read from shards that were written into the shared folder."""
    path = passing_path(docs.sparkSession, "shards")
    shard = write_shards(docs, path, shards, slots, doc_id)
    id_ = F.col(f"`{doc_id}`")
    return read_shards(docs, path, shard).select(id_.alias("doc_id"), slot_of(id_, slots).alias("slot"), F.col(shard).alias("shard"))


SQL = f"""
WITH RECURSIVE shards AS (SELECT unnest(range(0, {len(SHARDS)})) AS i),
named AS (SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 2, '0') AS shard FROM shards),
walks AS (SELECT i, shard, ('0x' || substr(md5('start:' || shard), 1, 15))::BIGINT % {SLOTS} AS s,
  ('0x' || substr(md5('step:' || shard), 1, 15))::BIGINT % {SLOTS - 1} + 1 AS d FROM named),
walk AS (SELECT list(s ORDER BY i) AS s, list(d ORDER BY i) AS d, range(0, {SLOTS}) AS js FROM walks),
fill(turn, owner) AS (
  SELECT 0, list_transform(range(0, {SLOTS}), lambda x: -1)
  UNION ALL
  SELECT turn + 1, (SELECT list_transform(js, lambda o: CASE WHEN o = pick THEN turn % {len(SHARDS)} ELSE fill.owner[o + 1] END) FROM
      (SELECT js, (s[turn % {len(SHARDS)} + 1] + d[turn % {len(SHARDS)} + 1] * list_filter(js, lambda j:
        fill.owner[((s[turn % {len(SHARDS)} + 1] + d[turn % {len(SHARDS)} + 1] * j) % {SLOTS}) + 1] = -1)[1]) % {SLOTS} AS pick FROM walk))
  FROM fill WHERE turn < {SLOTS}),
owners AS (SELECT owner FROM fill WHERE turn = {SLOTS}),
placed AS (SELECT doc_id, CAST(('0x' || substr(md5('doc:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {SLOTS} AS INT) AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(CAST(owner[slot + 1] AS VARCHAR), 2, '0') AS shard FROM placed, owners
"""
