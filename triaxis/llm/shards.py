"""Sharding by a two-pass external shuffle.

First pass: every record goes to a shard by its key alone (the shard whose seeded hash of the key is
greatest, so one more shard takes records only into itself), and within the shard to a bucket by a seeded
hash that spreads records evenly; there are so many buckets that one holds about `BUCKET_ROWS` records or
`BUCKET_BYTES` bytes, which fits in memory. Second pass: each bucket is put in order and shuffled (Fisher-Yates:
the draws are hashes of seed, shard, bucket and step); its records take the slots after those of the buckets before
it. So slots depend on the records and the seed alone: not on partitions, nor on tasks that run again.

Null keys are a key like any other. Repeated rows each get a slot of their own. Records that stand in the table
more often than a bucket holds are counted first and dealt to buckets one by one, by their number among their likes.
An empty table gives no rows. Extra columns are carried as payload (of types that can be hashed and put in order);
one named like an added column gets underscores at its end. Only counts of buckets are gathered to number the slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clear

SHARDS = 24
#: Records and bytes of a bucket, on average.
BUCKET_ROWS, BUCKET_BYTES = 1024, 16 << 20
SEED = 20


def shard_of(key: Column, n: int, seed: int = SEED) -> Column:
    """The shard from 0 to n - 1 whose hash with the key is greatest; ties to the smaller."""
    weigh = [F.struct(F.xxhash64(key, F.lit(seed), F.lit(j)).alias("w"), F.lit(-j).alias("j")) for j in range(n)]
    return -F.greatest(*weigh)["j"] if n > 1 else F.lit(0)


def fisher_yates(n: Column, seed: int, *place: Column) -> Column:
    """The numbers from 1 to n, shuffled: each step draws one of those left, and the last of these takes its place."""
    step = F.struct(F.sequence(F.lit(1), n.cast("int")).alias("left"), F.array().cast("array<int>").alias("done"))

    def draw(acc: Column, i: Column) -> Column:
        left = acc["left"]
        at = F.pmod(F.xxhash64(*place, i, F.lit(seed + 2)), F.size(left).cast("long")).cast("int")
        rest = F.concat(F.slice(left, F.lit(1), at), F.slice(left, F.size(left), F.lit(1)), F.slice(left, at + 2, F.greatest(F.size(left) - at - 2, F.lit(0))))
        shorter = F.when(at == F.size(left) - 1, F.slice(left, F.lit(1), at)).otherwise(rest)
        return F.struct(shorter.alias("left"), F.concat(acc["done"], F.slice(left, at + 1, F.lit(1))).alias("done"))

    return F.aggregate(F.sequence(F.lit(1), n.cast("int")), step, draw, lambda acc: acc["done"])


def scatter(rows: DataFrame, key: str, n: int, seed: int, bucket_rows: int, bucket_bytes: int) -> DataFrame:
    """The first pass: shard, bucket, record."""
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(8).cast("long") for f in rows.schema]
    alike = rows.select(F.struct(*rows.columns).alias("record"), F.xxhash64(*rows.columns, F.lit(seed + 1)).alias("h"))
    size = rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / (n * bucket_rows)), F.ceil(F.coalesce(F.sum(sum(wide[1:], wide[0])), F.lit(0)) / (n * bucket_bytes))).alias("buckets"))
    often = alike.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > bucket_rows).select("h")
    few = alike.join(often, "h", "left_anti").select("record", "h", F.lit(0).cast("long").alias("i"))
    many = alike.join(often, "h", "left_semi").groupBy("record", "h").agg(F.count("*").alias("c"))
    many = many.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / bucket_rows)))).repartition("h", "k")
    last = F.least(F.col("c"), (F.col("k") + 1) * bucket_rows) - 1
    many = many.select("record", "h", F.explode(F.sequence(F.col("k") * bucket_rows, last)).alias("i"))
    bucket = F.pmod(F.xxhash64("h", "i", F.lit(seed + 1)), size.scalar()).cast("int")
    return few.unionByName(many).select(shard_of(F.col(f"record.`{key}`"), n, seed).alias("shard"), bucket.alias("bucket"), "record")


def buckets(rows: DataFrame, key: str, n: int, seed: int, bucket_rows: int, bucket_bytes: int) -> DataFrame:
    """Both passes: shard, bucket, first (slot of the bucket's first record), records in the order of their slots."""
    scattered = scatter(rows, key, n, seed, bucket_rows, bucket_bytes)
    sizes = scattered.groupBy("shard", "bucket").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select("shard", "bucket", before.alias("first"))
    filled = scattered.groupBy("shard", "bucket").agg(F.sort_array(F.collect_list("record")).alias("records"))
    order = filled.withColumn("order", fisher_yates(F.size("records"), seed, F.col("shard"), F.col("bucket")))
    mixed = order.select("shard", "bucket", F.transform("order", lambda i: F.get("records", i - 1)).alias("records"))
    return mixed.join(first, ["shard", "bucket"])


def assign(rows: DataFrame, key: str = "doc_id", n: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Adds shard, slot (from 0 without gaps in each shard) and grown_shard (with one shard more)."""
    rows = clear(rows, "shard", "slot", "grown_shard")
    out = buckets(rows, key, n, seed, bucket_rows, bucket_bytes).select("shard", "first", F.posexplode("records").alias("at", "record"))
    grown = shard_of(F.col(f"record.`{key}`"), n + 1, seed)
    return out.select("record.*", F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("at")).alias("slot"), grown.cast("int").alias("grown_shard"))


def write(rows: DataFrame, where: str, key: str = "doc_id", n: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Writes Parquet below `where`, one folder a shard, straight from the buckets; the records of each file are in
    the order of their slots."""
    rows = clear(rows, "shard", "slot")
    out = buckets(rows, key, n, seed, bucket_rows, bucket_bytes).select("shard", "first", F.posexplode("records").alias("at", "record"))
    slots = out.select("record.*", F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("at")).alias("slot"))
    slots.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(where)
