"""Sharding by fixed virtual slots.

Every record hashes into one of ``n_slots`` virtual slots, whatever the number of shards. Bytes are summed
per slot, and a versioned table maps slots to shards. Rebalancing loads the table's last version, moves single
slots from the heaviest to the lightest shard and stores the next version; records never hash anew. All row work
is DataFrame code; the driver sees one row per slot, at most ``n_slots``.
"""

from __future__ import annotations

import heapq
import uuid
from bisect import bisect_left, insort
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._common import documents, materialise, scratch_dir

N_SLOTS = 4096
#: Kinds of repeated rows that may be broadcast: 1 million of 24 bytes.
BROADCAST_ROWS = 1_000_000


@dataclass
class SlotMap:
    """shard[i] owns slot i since version edited[i]."""

    shard: list[int]
    n_shards: int
    version: int = 0
    edited: list[int] = field(default_factory=list)

    @classmethod
    def initial(cls, n_slots: int, n_shards: int) -> SlotMap:
        return cls([i % n_shards for i in range(n_slots)], n_shards, 0, [0] * n_slots)

    def _moved(self, moves: dict[int, int], n_shards: int) -> SlotMap:
        shard, edited = list(self.shard), list(self.edited)
        for slot, to in moves.items():
            shard[slot], edited[slot] = to, self.version + 1
        return SlotMap(shard, n_shards, self.version + 1, edited)

    def rebalanced(self, size: list[int]) -> SlotMap:
        """The next version: moves slots from the heaviest to the lightest shard while that evens them out.

        Ends when no slot of the heaviest shard is smaller than its lead on the lightest, so shards then
        differ by no more than the smallest filled slot of the heaviest one.
        """
        owned: list[list[tuple[int, int]]] = [[] for _ in range(self.n_shards)]
        for slot, to in enumerate(self.shard):
            if size[slot]:
                insort(owned[to], (size[slot], slot))
        load, moves = [sum(s for s, _ in x) for x in owned], {}
        while True:
            high, low = max(range(self.n_shards), key=load.__getitem__), min(range(self.n_shards), key=load.__getitem__)
            lead = load[high] - load[low]
            at = bisect_left(owned[high], (lead / 2, -1))
            best = min((x for x in owned[high][max(0, at - 1) : at + 1] if x[0] < lead), key=lambda x: abs(lead - 2 * x[0]), default=None)
            if best is None:
                return self._moved(moves, self.n_shards)
            owned[high].remove(best)
            insort(owned[low], best)
            load[high], load[low] = load[high] - best[0], load[low] + best[0]
            moves[best[1]] = low

    def grown(self, size: list[int]) -> SlotMap:
        """The next version with one more shard: slots move only into it, from the heaviest shards first."""
        owned: list[list[tuple[int, int]]] = [[] for _ in range(self.n_shards)]
        for slot, to in enumerate(self.shard):
            if size[slot]:
                insort(owned[to], (size[slot], slot))
        load = [sum(s for s, _ in x) for x in owned]
        heap, gained, goal, moves = [(-x, i) for i, x in enumerate(load)], 0, sum(load) / (self.n_shards + 1), {}
        heapq.heapify(heap)
        while heap and gained < goal:
            _, i = heapq.heappop(heap)
            fits = [x for x in owned[i] if gained + x[0] <= goal * 1.001]
            if fits:
                best = fits[-1] if fits[-1][0] <= max(load[i] - goal, 0) else fits[0]
                owned[i].remove(best)
                load[i], gained, moves[best[1]] = load[i] - best[0], gained + best[0], self.n_shards
                heapq.heappush(heap, (-load[i], i))
        return self._moved(moves, self.n_shards + 1)

    def store(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the table at ``path``, a folder of its own. A version that is there already is an error."""
        self.table(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/v{self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
        """The last version at ``path``, or the one asked for; None where there is none."""
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if version is None:
            found = [x.getPath().getParent().getName() for x in files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/v*/_SUCCESS")) or ()]
            if not found:
                return None
            version = max(int(x[1:]) for x in found)
        rows = spark.read.parquet(f"{path}/v{version}").orderBy("slot").collect()  # n_slots rows
        return cls([r.shard for r in rows], rows[0].n_shards, version, [r.edited for r in rows])

    def table(self, spark: SparkSession) -> DataFrame:
        """version, n_shards, slot, shard, edited: one row per slot, as stored."""
        at = F.col("slot").cast("int") + 1
        return spark.range(len(self.shard)).withColumnRenamed("id", "slot").select(
            F.lit(self.version).alias("version"), F.lit(self.n_shards).alias("n_shards"), "slot",
            F.element_at(F.lit(self.shard), at).alias("shard"), F.element_at(F.lit(self.edited), at).alias("edited"))


def with_slots(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """id, size (UTF-8 bytes plus 1), text_crc32, vslot, as a written table. A null text has no bytes and the checksum 0.

    The slot hash takes the id, the size and the checksum, so that rows that share an id, null included, spread.
    Rows that share all three, of which any number may be there, get slots by turns instead.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    crc = F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long")
    turn = F.monotonically_increasing_id()
    rows = df.select(id_col, size.alias("size"), crc.alias("text_crc32")).withColumns({"vslot": F.pmod(F.xxhash64(id_col, "size", "text_crc32"), F.lit(n_slots)), "_turn": turn})
    rows = materialise(rows, "slots")
    same = [id_col, "size", "text_crc32"]
    repeated = rows.groupBy(*same).count().where("count > 1").select(F.struct(*same).alias("_row"))
    repeated = materialise(repeated, "repeated-rows")
    if repeated.isEmpty():
        return rows.drop("_turn")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    marked = rows.withColumn("_own", F.struct(*same)).join(repeated, F.col("_own").eqNullSafe(F.col("_row")), "left")
    vslot = F.when(F.col("_row").isNull(), F.col("vslot")).otherwise(F.pmod(F.xxhash64("_turn"), F.lit(n_slots)))
    return materialise(marked.select(*same, vslot.alias("vslot")), "slots")


def shard(df: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, map_path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Deals all rows into ``n_shards`` shards of near equal bytes.

    The slot map's last version at ``map_path`` is loaded and edited, if these rows weigh other slots more, and
    then stored as the next version; without one, or without a path, it starts from slots dealt by turns.
    Returns (id, size, text_crc32, vslot, shard, slot, map_version), and the map; ``slot`` counts a shard's
    rows from 0 without gaps, ties in any order. Null ids and texts, equal ids and repeated rows each keep their
    own row; an empty table gives an empty table. Columns of the input other than the two named are ignored.
    """
    spark = df.sparkSession
    map_path = map_path or f"{scratch_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    rows = with_slots(df, id_col, text_col, n_slots)
    size, count = [0] * n_slots, [0] * n_slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r.vslot], count[r.vslot] = r.b, r.n
    slots = SlotMap.load(spark, map_path)
    if slots is None:
        slots = SlotMap.initial(n_slots, n_shards)
        slots.store(spark, map_path)
    if (len(slots.shard), slots.n_shards) != (n_slots, n_shards):
        raise ValueError(f"the map at {map_path} has {len(slots.shard)} slots and {slots.n_shards} shards")
    edited = slots.rebalanced(size)
    if edited.shard != slots.shard:
        slots = edited
        slots.store(spark, map_path)
    before, so_far = [0] * n_slots, [0] * n_shards
    for i, to in enumerate(slots.shard):
        before[i], so_far[to] = so_far[to], so_far[to] + count[i]
    first = F.element_at(F.lit(before), F.col("slot").cast("int") + 1).cast("long").alias("before")
    owner = spark.read.parquet(f"{map_path}/v{slots.version}").select(F.col("slot").alias("vslot"), "shard", F.col("version").alias("map_version"), first)
    place = F.row_number().over(Window.partitionBy("vslot").orderBy(id_col, "text_crc32", "size"))
    out = rows.withColumn("place", place).join(F.broadcast(owner), "vslot")  # n_slots rows
    return out.select(id_col, "size", "text_crc32", "vslot", "shard", (F.col("before") + F.col("place") - 1).alias("slot"), "map_version"), slots


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards, by law ``bytes``."""
    out, _ = shard(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")
