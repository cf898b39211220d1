"""Helpers shared by the corpus operators: shared scratch tables, sums over partitions, word hashing."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_sent: list = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset (local tests), a new local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession, value):
    """A broadcast that ``release`` destroys. ``value`` is of bounded size."""
    found = spark.sparkContext.broadcast(value)
    _sent.append((spark, found))
    return found


def marks() -> tuple[int, int]:
    """Where the lists of scratch tables and broadcasts end now."""
    return len(_written), len(_sent)


def taken(since: tuple[int, int]) -> tuple[list, list]:
    """What was added since, for ``release``."""
    return _written[since[0] :], _sent[since[1] :]


def release(what: tuple[list, list]) -> None:
    """Deletes scratch tables and destroys broadcasts of an operator, once its result is written.

    A collection on the driver follows: only then does Spark's cleaner free the shuffles and broadcasts of plans
    that are gone, on the executors too.
    """
    alive = None
    for one in what[1]:
        if one in _sent:
            _sent.remove(one)
            if one[0].sparkContext._jsc is not None:  # else the session is stopped
                one[1].destroy()
                alive = one[0]
    for one in what[0]:
        if one in _written and one[0].sparkContext._jsc is not None:
            _written.remove(one)
            _delete(*one)
            alive = one[0]
    gc.collect()
    if alive is not None:
        alive.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def clear() -> None:
    """Deletes the scratch tables of this process."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session is gone; the folder's owner clears it
            return


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sampled(df: DataFrame, id_col: str, label_col: str, sample: int, seed: int) -> DataFrame:
    """At most ``sample`` rows of ``df`` with a label, to fit a classifier on: the first by a hash of their ids.

    Ids and labels alone are sorted; the chosen ids, ``sample`` at most, then fetch their rows. Null ids and
    ids of several labelled rows are not chosen, as they could fetch any number of rows.
    """
    ids = df.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).count().where("count = 1")
    chosen = ids.select(F.col(id_col).alias("_chosen")).orderBy(F.xxhash64(F.lit(seed), "_chosen"), "_chosen").limit(sample)
    return df.where(F.col(label_col).isNotNull()).join(F.broadcast(chosen), F.col(id_col) == F.col("_chosen"), "left_semi")


def summed(parts: DataFrame, dtype: str, fan_in: int = 64) -> DataFrame:
    """Sums equally long arrays of bytes.

    ``parts`` has block long, part long, data binary; part is the number of the task that made the row, and
    ``data`` are numbers of ``dtype``. Adds ``fan_in`` parts at a time while the plan's tasks are more than that,
    so a task never holds many arrays; a last step by block alone gives one row a block, whatever the numbers of
    the parts. Returns block, data.
    """
    most = parts.rdd.getNumPartitions() - 1

    def add(key, table):
        import pyarrow as pa

        total = None
        for x in table.column("data"):
            one = np.frombuffer(x.as_buffer(), dtype)
            total = one.copy() if total is None else np.add(total, one, out=total)
        return pa.table({"block": [key[0].as_py()], "part": [key[1].as_py()], "data": [total.tobytes()]}, schema)

    import pyarrow as pa

    schema = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("data", pa.binary())])
    while most >= fan_in:
        parts = parts.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("block", "part").applyInArrow(add, "block long, part long, data binary")
        most //= fan_in
    return parts.select("block", F.lit(0).cast("long").alias("part"), "data").groupBy("block", "part").applyInArrow(add, "block long, part long, data binary").select("block", "data")


class WordHashes(dict):
    """Maps a word to an unsigned 64-bit hash; forgets all beyond ``most`` words, so memory stays bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word):
        import xxhash

        if len(self) >= self.most:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass") if isinstance(word, str) else word)
        return found

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (the murmur3 finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
