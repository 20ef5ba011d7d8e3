"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size: an offset and a
step, both from a digest of its name. Shards take turns, each claiming its most preferred free slot,
until the table is full; slot counts then differ by at most one (or follow the weights, a shard of
weight w taking w turns a round). A key goes to the shard that owns slot xxhash64(key) mod size: one
hash and one probe of a broadcast table of `size` rows, whatever the data's size. Adding or losing a
shard moves few keys beyond its own.

Edge cases: a null key has a slot like any other (the hash of null); an empty table of rows gives no
rows; repeated rows go to one shard; columns named slot or shard are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, table, without

SIZE = 65537  # a prime, about a thousand slots for each of the query's shards
SHARDS = 64
MAX_SIZE = 1 << 22  # the largest table that is broadcast: 4 M rows of two integers


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % p for p in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = SIZE, weights: list[int] | None = None) -> list[int]:
    """slot -> number of the shard that owns it."""
    weights = weights or [1] * len(shards)
    if not shards or len(set(shards)) < len(shards) or len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("shards: one or more distinct names, each of weight 1 or more")
    if not _is_prime(size) or not sum(weights) <= size <= MAX_SIZE:
        raise ValueError(f"size: a prime from the sum of weights to {MAX_SIZE}")
    walk = []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        walk.append([int.from_bytes(digest[:8], "big") % size, 1 + int.from_bytes(digest[8:16], "big") % (size - 1) if size > 2 else 1])
    owner, free = [-1] * size, size
    while free:
        for number, state in enumerate(walk):
            for _ in range(weights[number]):
                if not free:
                    break
                while owner[state[0]] >= 0:
                    state[0] = (state[0] + state[1]) % size
                owner[state[0]] = number
                free -= 1
    return owner


def place(df: DataFrame, key: str, shards: list[str], size: int = SIZE, weights: list[int] | None = None) -> DataFrame:
    """df with slot (int) and shard (string), its columns of those names replaced."""
    spark = df.sparkSession
    owner = lookup_table(shards, size, weights)
    slots = spark.createDataFrame([(s, shards[o]) for s, o in enumerate(owner)], "slot int, shard string")
    slot = F.pmod(F.xxhash64(col(key)), F.lit(size)).cast("int")
    kept = without(df, ["slot", "shard"])
    keyed = df.select(*[col(c) for c in kept.columns], slot.alias("slot"))
    return keyed.join(F.broadcast(slots), "slot").select(*[col(c) for c in kept.columns], "slot", "shard")


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, salts: int = 8, **placing) -> None:
    """df's rows as Parquet in a folder for each shard; each shard's rows are spread over `salts` tasks, so that a hot key fills no single one."""
    placed = place(df, key, shards, **placing)
    placed.repartition(F.col("shard"), F.pmod(F.xxhash64(*[col(c) for c in df.columns if df.schema[c].dataType.typeName() != "map"]), F.lit(salts))).write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return place(docs, "doc_id", [f"shard-{n:03d}" for n in range(SHARDS)])
