"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash into thousands of slots, which never change; bytes are summed per slot, and a map
gives each slot its shard. The map has a row per slot and version: its size is the number of
slots, whatever the corpus holds, so it may be collected and broadcast.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_folder, stored, text_key, texts_of

SLOTS = 4096
MAP_SCHEMA = "virtual_slot int, shard int, slot_rows long, slot_bytes long"
ROW_OVERHEAD = 16
#: How much heavier than the mean a shard of a stored map may get before slots move.
DRIFT = 0.05


def assign(slot_bytes: dict[int, int], n_shards: int) -> dict[int, int]:
    """Largest slots first, each to the lightest shard; then moves and swaps that narrow the gap."""
    load = [(0, s) for s in range(n_shards)]
    heapq.heapify(load)
    to: dict[int, int] = {}
    for slot, size in sorted(slot_bytes.items(), key=lambda x: (-x[1], x[0])):
        b, s = heapq.heappop(load)
        to[slot] = s
        heapq.heappush(load, (b + size, s))
    return narrowed(to, slot_bytes, n_shards)


def loads(to: dict[int, int], slot_bytes: dict[int, int], n_shards: int) -> list[int]:
    weight = [0] * n_shards
    for slot, s in to.items():
        weight[s] += slot_bytes[slot]
    return weight


def narrowed(to: dict[int, int], slot_bytes: dict[int, int], n_shards: int, enough: float = 0) -> dict[int, int]:
    """Single moves and swaps between the heaviest and the lightest shard while they narrow the gap, or
    until no shard is heavier than `enough`."""
    held: dict[int, set[int]] = {s: set() for s in range(n_shards)}
    for slot, s in to.items():
        held[s].add(slot)
    weight = loads(to, slot_bytes, n_shards)
    for _ in range(20 * n_shards):
        hi = max(range(n_shards), key=lambda s: (weight[s], -s))
        lo = min(range(n_shards), key=lambda s: (weight[s], s))
        gap = weight[hi] - weight[lo]
        if weight[hi] <= enough:
            break
        best, pick = gap, None
        theirs = sorted((slot_bytes[x], x) for x in held[lo]) + [(0, -1)]
        for a in held[hi]:
            for size, b in theirs:
                moved = slot_bytes[a] - size
                if 0 < moved < gap and abs(gap - 2 * moved) < best:
                    best, pick = abs(gap - 2 * moved), (a, b)
        if pick is None:
            break
        a, b = pick
        held[hi].remove(a)
        held[lo].add(a)
        if b >= 0:
            held[lo].remove(b)
            held[hi].add(b)
        moved = slot_bytes[a] - (slot_bytes[b] if b >= 0 else 0)
        weight[hi] -= moved
        weight[lo] += moved
    return {slot: s for s, slots in held.items() for slot in slots}


def rebalance(to: dict[int, int], slot_bytes: dict[int, int], n_shards: int) -> dict[int, int]:
    """A next version of the map for more shards: slots move only into shards that are new, the
    largest that fit first, until each new shard has its share."""
    old = max(to.values(), default=-1) + 1
    share = sum(slot_bytes.values()) / n_shards
    now, weight = dict(to), [0.0] * max(n_shards, old)
    for slot, s in to.items():
        weight[s] += slot_bytes[slot]
    slots = sorted(slot_bytes, key=lambda x: (-slot_bytes[x], x))
    for new in range(old, n_shards):
        for least in (share * 0.98, 0.0):  # from shards that stay full, then from any that stay the heavier one
            for slot in slots:
                s, size = now[slot], slot_bytes[slot]
                if s < old and weight[new] + size <= share and weight[s] - size >= max(least, weight[new] + size if not least else 0):
                    now[slot] = new
                    weight[s] -= size
                    weight[new] += size
    return now


def digests(docs: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, row_key, virtual_slot): all that sharding needs of a row."""
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    key = text_key()
    return texts_of(docs).select(
        "doc_id",
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        key.alias("row_key"),
        F.pmod(F.xxhash64("doc_id", key), F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_map(spark: SparkSession, path: str, version: int, to: dict[int, int], sums: dict[int, tuple[int, int]]) -> None:
    """Stores a version of the map at path/version=N; what is there already is never changed."""
    data = [(s, to[s], *map(int, sums.get(s, (0, 0)))) for s in sorted(to)]
    rows = spark.createDataFrame(data, MAP_SCHEMA).coalesce(1)
    rows.write.mode("error").parquet(f"{path}/version={version}")


def latest_version(spark: SparkSession, path: str) -> int:
    """The highest version of the map at path that was written to its end, 0 if there is none."""
    fs, at = _hadoop(spark, path)
    if not fs.exists(at):
        return 0
    names = [x.getPath() for x in fs.listStatus(at)]
    done = [p.getName() for p in names if p.getName().startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max((int(n.split("=")[1]) for n in done), default=0)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(virtual_slot, shard, slot_rows, slot_bytes) of a version, the latest unless one is named."""
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version or latest_version(spark, path)}")


def slot_map(spark: SparkSession, rows: DataFrame, n_shards: int, path: str, n_slots: int = SLOTS, drift: float = DRIFT) -> int:
    """Brings the map stored at path to n_shards and returns its version. Without a map the slots
    are assigned anew; a map of fewer shards is edited, and slots move into new shards alone. A map
    of as many stays, so that records keep their shard, until one outweighs the mean by more than
    `drift`: then slots move between shards, as few as bring all within half of that where slots allow.

    The aggregate has n_slots rows at most; its size is a parameter and not the corpus's.
    """
    last = latest_version(spark, path)
    old = {r["virtual_slot"]: r["shard"] for r in read_map(spark, path, last).collect()} if last else {}
    if last and len(old) != n_slots:
        raise ValueError(f"the map at {path} has {len(old)} slots, not {n_slots}")
    if last and max(old.values()) + 1 > n_shards:
        raise ValueError(f"the map at {path} has {max(old.values()) + 1} shards, more than {n_shards}")
    sums = {r["virtual_slot"]: (r["n"], r["b"]) for r in rows.groupBy("virtual_slot").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
    weights = {s: sums.get(s, (0, 0))[1] for s in range(n_slots)}
    if not last:
        now = assign(weights, n_shards)
    elif max(old.values()) + 1 < n_shards:
        now = rebalance(old, weights, n_shards)
    else:
        mean, heaviest = sum(weights.values()) / n_shards, max(loads(old, weights, n_shards))
        now = old if heaviest <= (1 + drift) * mean else narrowed(old, weights, n_shards, (1 + drift / 2) * mean)
        if now == old:
            return last
    write_map(spark, path, last + 1, now, sums)
    return last + 1


def shard_documents(docs: DataFrame, n_shards: int = 40, n_slots: int = SLOTS, map_path: str | None = None, drift: float = DRIFT) -> DataFrame:
    """Puts every document into one of n_shards shards of near equal bytes (law `bytes`).

    The slot-to-shard map is kept at `map_path` (a new folder unless stated): a later call there
    keeps every record in its shard while weights have drifted by `drift` at most, and with more
    drift or more shards edits the map as its next version.

    Returns doc_id, size (UTF-8 bytes and 16), text_crc32, law, shard, slot (the row's place in
    its shard, gapless from 0), grown_shard (null under this law), virtual_slot, map_version. A
    null text has no bytes; a null doc_id hashes like any value; repeated rows are dealt one by
    one and fill places of their own. The text is read once and never shuffled; a row's place is
    its rank within its virtual slot plus the rows of the shard's earlier slots, so no task holds
    a whole shard. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = stored(digests(docs, n_slots), "shard-rows")
    path = map_path or new_folder(spark, "slot-map")
    version = slot_map(spark, rows, n_shards, path, n_slots, drift)
    held = rows.groupBy("virtual_slot").agg(F.count("*").alias("held"))  # n_slots rows at most
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    base = F.coalesce(F.sum(F.coalesce("held", F.lit(0))).over(before), F.lit(0))
    mapped = read_map(spark, path, version).join(F.broadcast(held), "virtual_slot", "left").select("virtual_slot", "shard", base.alias("base"))
    place = F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", "row_key")) - 1
    return (
        rows.withColumn("place", place)
        .join(F.broadcast(mapped), "virtual_slot")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("base") + F.col("place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"),
        )
    )
