"""Near duplicates by HyperMinHash.

Every distinct shingle set gets registers: under each of ``bands(percent) * ROWS`` hash functions the set's minimum,
kept in 16 bits as its leading-zero count and the mantissa bits that follow. All registers hash all
shingles, so that short sets fill each of them too. Bands of registers bucket the sets; the share of equal
registers, corrected for chance collisions of the compressed values, estimates the Jaccard similarity of a
candidate pair, and pairs that may pass are checked on their full sets.

Equal sets are one node from the start, so copies never form pairs. In a bucket, all members first meet one
hub only. Pairs within one component are settled then. Members of buckets that still hold several components
meet again across components, if the rare shingles at the front of their sets allow the similarity; that
filter is exact, so no link that a bucket shows is lost, and a large group does not make all its pairs.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WordHashes, documents, marks, materialise, mixed, release, shared, summed, taken
from .graphs import components

ROWS = 5
#: A pair at the bar shares no band with this probability at most.
MISS = 5e-7
MANTISSA_BITS = 10
#: A table of counts has so many bits at most, of about as many cells as there are shingles; beyond it counts are joined.
TABLE_BITS = 22
#: Joined counts: shingles of a chunk of sets, which asks once for each of its shingles, and of a block, in which they are counted.
CHUNK, BLOCK = 1 << 17, 1 << 20
#: Needed nodes of which the ids may be broadcast: 1 million of 8 bytes.
BROADCAST_IDS = 1_000_000
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93)]
_words: dict[str, WordHashes] = {}


def shingles(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes of ``words`` successive words, ascending; of the whole sequence if that is shorter."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not parts:
        return np.zeros(0, np.uint64)
    w = _words.setdefault("", WordHashes()).array(parts)
    n = max(1, len(w) - words + 1)
    total = np.full(n, min(len(w), words), np.uint64)
    for i in range(min(words, len(w))):
        total = mixed(total * _K[5] + w[i : i + n] * _K[i % 5])
    return np.unique(total)


def bands(percent: int) -> int:
    """The number of bands for a bar of ``percent``: 25 at 85, 37 at 80."""
    return max(1, int(np.ceil(np.log(MISS) / np.log1p(-min(percent / 100, 1 - 1e-9) ** ROWS))))


@cache
def _seeds(m: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20)
    return r.integers(0, 2**64, m, np.uint64), r.integers(0, 2**64, m, np.uint64) | np.uint64(1)


def registers(sets: list[np.ndarray], n_bands: int = 25) -> np.ndarray:
    """A row of 16-bit registers for each (non-empty) set."""
    xor, mul = _seeds(n_bands * ROWS)
    least = np.empty((len(sets), len(xor)), np.uint64)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= 20_000):
            size += len(sets[j])
            j += 1
        if j == i + 1:
            for k in range(len(xor)):
                least[i, k] = min(int(((sets[i][p : p + 20_000] ^ xor[k]) * mul[k]).min()) for p in range(0, size, 20_000))
        else:
            flat = np.concatenate(sets[i:j])
            at = np.cumsum([0] + [len(s) for s in sets[i : j - 1]])
            for k in range(len(xor)):
                least[i:j, k] = np.minimum.reduceat((flat ^ xor[k]) * mul[k], at)
        i = j
    part, exponent = np.frexp(least.astype(np.float64))
    mantissa = ((part * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.uint16)
    return ((64 - exponent).astype(np.uint16) << np.uint16(MANTISSA_BITS)) | np.minimum(mantissa, (1 << MANTISSA_BITS) - 1)


def band_keys(r: np.ndarray) -> np.ndarray:
    """A row of keys, one for each band, for each row of registers."""
    x = r.reshape(len(r), r.shape[1] // ROWS, ROWS).astype(np.uint64)
    total = np.broadcast_to(np.arange(x.shape[1], dtype=np.uint64), x.shape[:2])
    for i in range(ROWS):
        total = mixed(total * _K[5] + x[:, :, i] + np.uint64(1))
    return total.view(np.int64)


@cache
def collision_rate() -> float:
    """The chance that the minima of two disjoint sets of like size share a register value.

    Minima are near exponential; the sum runs over all values of leading zeros and mantissa, and depends on
    the ratio of sizes only, of which candidates have one near 1.
    """
    octave = 2.0 ** np.arange(-30, 8)[:, None]
    edge = octave * (1 + np.arange((1 << MANTISSA_BITS) + 1) / (1 << MANTISSA_BITS))
    p = np.exp(-edge[:, :-1]) - np.exp(-edge[:, 1:])
    return float((p * p).sum())


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, corrected for collisions."""
    c = collision_rate()
    return ((a == b).mean(axis=1) - c) / (1 - c)


def _fixed(column, dtype) -> np.ndarray:
    """A binary column of equally long values as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _profiles(df: DataFrame, id_col: str, text_col: str, words: int, n_bands: int) -> DataFrame:
    """id, n_shingles, set_key (128 bits of the set's hash), registers (null for an empty set)."""
    kind = df.schema[id_col].dataType.simpleString()

    def profile(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                sets = [shingles(t.as_py(), words) for t in part.column(1)]
                full = [s for s in sets if len(s)]
                rows = iter(registers(full, n_bands)) if full else iter(())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                ], [id_col, "n_shingles", "set_key", "registers"])

    return df.select(id_col, text_col).mapInArrow(profile, f"{id_col} {kind}, n_shingles long, set_key binary, registers binary")


def _keyed(nodes: DataFrame) -> DataFrame:
    """(key, c): the band keys of every node."""

    def keys(batches):
        import pyarrow as pa

        for batch in batches:
            k = band_keys(_fixed(batch.column(1), np.uint16))
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), k.shape[1]))], ["key", "c"])

    return nodes.select("c", "registers").mapInArrow(keys, "key long, c long")


def _hopeful(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of which the registers allow a similarity of ``least``, five standard errors away at most."""
    def check(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                ra, rb = (_fixed(batch.column(i), np.uint16) for i in (2, 3))
                keep = estimate(ra, rb) >= least - 5 * (least * (1 - least) / ra.shape[1]) ** 0.5
                yield batch.filter(pa.array(keep)).select(["a", "b"])

    regs = nodes.select("c", "registers").hint("merge")  # grows with the data: not sent through the driver
    both = pairs.join(regs.select(F.col("c").alias("a"), F.col("registers").alias("ra")), "a").join(regs.select(F.col("c").alias("b"), F.col("registers").alias("rb")), "b")
    return both.select("a", "b", "ra", "rb").mapInArrow(check, "a long, b long")


def _sets(wanted: DataFrame, df: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(c, data): the full sets of the nodes ``wanted`` (c, a row each), made again from their texts only. Other columns of ``wanted`` stay."""
    more = [v for v in wanted.columns if v != "c"]
    needed = materialise(nodes.join(wanted, "c").select("c", "set_key", F.col("class_id").alias("_id"), *more), "needed")
    ids = needed.select("_id").distinct()
    if needed.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi")

    def make(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for at in range(0, len(batch), 500):
                sets = [shingles(t.as_py(), words).tobytes() for t in batch.column(0).slice(at, 500)]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["set_key", "data"])

    made = texts.select("text").mapInArrow(make, "set_key binary, data binary").join(needed.select("c", "set_key", *more), "set_key")
    return materialise(made.dropDuplicates(["set_key"]).select("c", *more, "data"), "sets")  # by the join's key: sets are shuffled once


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on full sets."""

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
                small, large = sorted((len(x), len(y)))
                same = 0
                if 100 * small >= percent * large:
                    both = np.concatenate((x, y))
                    both.sort(kind="stable")  # two runs
                    same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (small + large - same))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    sets = sets.hint("merge")
    both = pairs.join(sets.select(F.col("c").alias("a"), F.col("data").alias("da")), "a").join(sets.select(F.col("c").alias("b"), F.col("data").alias("db")), "b")
    return materialise(both.select("a", "b", "da", "db").mapInArrow(check, "a long, b long"), "links")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()


def _frequencies(sets: DataFrame, bits: int) -> np.ndarray:
    """Counts of the shingles of ``sets`` in a hashed table."""

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        table = np.zeros(1 << bits, np.int32)
        for batch in batches:
            every = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            table += np.bincount((every >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.int32)
        for i, part in enumerate(np.split(table, 4)):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([TaskContext.get().partitionId()]), pa.array([part.tobytes()], pa.binary())], ["block", "part", "data"])

    got = summed(sets.select("data").mapInArrow(count, "block long, part long, data binary"), "<i4").collect()
    return np.concatenate([np.frombuffer(r["data"], "<i4") for r in sorted(got, key=lambda r: r.block)]) if got else np.zeros(1 << bits, np.int32)


def _front(n: int, percent: int) -> int:
    """How many of a set's ``n`` shingles, in one order of all, sets of that similarity must share one of."""
    return n - (percent * n + 99) // 100 + 1


def _fronts(columns, percent: int, count) -> list[np.ndarray]:
    """x, p, n, c, root: the fronts of sets, by ``count``, which gives the counts of a set's shingles."""
    out = [[np.zeros(0, np.int64)] * 5]
    for c, root, data in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2], strict=True):
        x = np.frombuffer(data.as_buffer(), np.int64)
        n = _front(len(x), percent)
        out.append([x[np.lexsort((x, count(x)))[:n]], np.arange(1, n + 1), np.full(n, len(x)), np.full(n, c), np.full(n, root)])
    return [np.concatenate(v) for v in zip(*out, strict=True)]


def _few_by_table(mixed_sets: DataFrame, percent: int, bits: int) -> DataFrame:
    """The front of every set, by counts in a table of at most 2 ** TABLE_BITS cells that is broadcast."""
    table = shared(mixed_sets.sparkSession, _frequencies(mixed_sets, bits))

    def first_few(batches):
        import pyarrow as pa

        counts = table.value
        shift = np.uint64(64 - (len(counts) - 1).bit_length())
        for batch in batches:
            few = _fronts(batch.columns, percent, lambda x: counts[(x.view(np.uint64) >> shift).astype(np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in few], ["x", "p", "n", "c", "root"])

    return mixed_sets.select("c", "root", "data").mapInArrow(first_few, "x long, p long, n long, c long, root long")


def _packed(x: np.ndarray) -> bytes:
    """All first bytes of the numbers, then all second ones: the zeros of small numbers are compressed away."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unpacked(data, dtype: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _few_by_join(mixed_sets: DataFrame, percent: int, total: int = 0) -> DataFrame:
    """The front of every set, by exact counts that are joined: for more shingles than a table tells apart.

    ``total`` is about the number of shingles. Chunks of sets send their distinct shingles, sorted, to the blocks of
    the range of hashes; a block adds up its shingles and answers each chunk in the order asked. So the sets are
    shuffled once and not as rows of shingles, and a shingle of all sets is one of each chunk only.
    """
    chunks, shift = total // CHUNK + 1, np.uint64(64 - max(1, (total // BLOCK).bit_length()))

    def each(sets):
        return np.unique(np.frombuffer(b"".join(sets.column("data").to_pylist()), np.uint64), return_counts=True)

    def ask(key, sets):
        import pyarrow as pa

        x, times = each(sets)
        block = (x >> shift).astype(np.int64)
        at = np.flatnonzero(np.diff(block)) + 1
        steps = [_packed(np.diff(part, prepend=np.uint64(0))) for part in np.split(x, at)]
        times = [_packed(part) for part in np.split(times.astype("<u4"), at)]
        return pa.table({"chunk": np.full(len(steps), key[0].as_py()), "block": block[np.append(0, at)], "steps": pa.array(steps, pa.binary()), "times": pa.array(times, pa.binary())})

    def answer(asked):
        import pyarrow as pa

        xs = [np.cumsum(_unpacked(v.as_buffer(), "<u8"), dtype=np.uint64) for v in asked.column("steps")]
        times = np.concatenate([_unpacked(v.as_buffer(), "<u4") for v in asked.column("times")])
        found, of = np.unique(np.concatenate(xs), return_inverse=True)
        counts = np.bincount(of, times, len(found)).astype("<u4")[of]
        counts = [_packed(part) for part in np.split(counts, np.cumsum([len(x) for x in xs[:-1]], dtype=np.int64))]
        return pa.table({"chunk": asked.column("chunk"), "block": asked.column("block"), "counts": pa.array(counts, pa.binary())})

    def first_few(sets, answers):
        import pyarrow as pa

        x = each(sets)[0]
        counts = np.concatenate([_unpacked(v.as_buffer(), "<u4") for v in answers.sort_by("block").column("counts")])
        few = _fronts([sets.column(v) for v in ("c", "root", "data")], percent, lambda own: counts[np.searchsorted(x, own.view(np.uint64))])
        return pa.table(dict(zip(("x", "p", "n", "c", "root"), few, strict=True)))

    dealt = mixed_sets.select(F.pmod(F.xxhash64("c"), F.lit(chunks)).cast("long").alias("chunk"), "c", "root", "data")
    asked = dealt.groupBy("chunk").applyInArrow(ask, "chunk long, block long, steps binary, times binary")
    answers = asked.groupBy("block").applyInArrow(answer, "chunk long, block long, counts binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(first_few, "x long, p long, n long, c long, root long")


def _across(mixed_sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes (c, root, data) of different roots that can reach the similarity, by the rare shingles they share.

    All shingles have one order, rare ones first. Sets of that similarity share a shingle among their first
    few, and the first one they share leaves enough behind it in both. Only pairs for which that holds meet.
    A shingle's most frequent root meets the others only, so one large component costs no pairs of its own.
    """
    total = (mixed_sets.agg(F.sum(F.length("data"))).first()[0] or 0) // 8
    bits = max(12, total.bit_length())
    few = _few_by_table(mixed_sets, percent, bits) if bits <= TABLE_BITS else _few_by_join(mixed_sets, percent, total)
    few = materialise(few, "prefixes")
    roots = few.groupBy("x", "root").count().groupBy("x").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("x", "main")
    few = materialise(few.join(roots, "x"), "shared-prefixes")
    a = few.where("root <> main").select("x", *[F.col(v).alias(v + "a") for v in ("p", "n", "c", "root")])
    b = few.select("x", "main", *[F.col(v).alias(v + "b") for v in ("p", "n", "c", "root")])
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1
    can = (left * (100 + percent) >= percent * (F.col("na") + F.col("nb"))) & (F.col("roota") != F.col("rootb")) & ((F.col("rootb") == F.col("main")) | (F.col("ca") < F.col("cb")))
    return a.join(b, ["x"]).where(can).select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()


def _rooted_anew(roots: DataFrame, rest: DataFrame, more: DataFrame) -> DataFrame:
    """``roots`` (node, root), and those of ``rest`` (c, root), after the links ``more``. Only roots are linked, and most have no such link."""
    ends = rest.select("c", "root").distinct()
    a, b = (ends.select(F.col("c").alias(end), F.col("root").alias(f"root_{end}")) for end in ("a", "b"))
    joined = components(more.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    first = roots.select("node", "root").union(ends.where("c = root")).distinct()  # with roots that had no link
    return first.join(joined.select(F.col("node").alias("root"), F.col("root").alias("new")).hint("merge"), "root", "left").select("node", F.coalesce("new", "root").alias("root"))


def _roots(find, *tables: DataFrame) -> DataFrame:
    """The written result of ``find``, without what it took to find it."""
    since = marks()
    found = find(*tables)
    spent = taken(since)
    found = materialise(found, "roots")
    release(spent)
    return found


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, kept.

    Rows whose shingle sets reach a Jaccard similarity of ``percent`` are linked; ``component_id`` is the
    smallest id reachable over links, and ``kept`` marks rows that have it. Texts without words, null or
    empty, link with nothing. A null id counts as larger than all others and is kept where its group has no
    other; rows of one id and different texts are judged by their own texts. An empty table gives an empty
    table. Other columns are ignored.
    """
    rows = materialise(_profiles(df, id_col, text_col, words, bands(percent)), "profiles")
    nodes = rows.where("n_shingles > 0").groupBy("set_key").agg(F.min(id_col).alias("class_id"), F.first("registers").alias("registers"))
    nodes = materialise(nodes.withColumn("c", F.monotonically_increasing_id()), "nodes")

    keyed = _keyed(nodes)
    several = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = materialise(keyed.join(several, "key"), "buckets")
    #: The hub of a bucket is the member with most company in all its buckets, for copies mostly the text they stem from.
    company = buckets.groupBy("c").agg(F.sum("size").alias("company"))
    hubs = buckets.join(company, "c").groupBy("key").agg(F.max_by("c", F.struct("company", "c")).alias("hub"))
    stars = buckets.join(hubs, "key").where("c <> hub").select(F.least("hub", "c").alias("a"), F.greatest("hub", "c").alias("b")).distinct()
    stars = materialise(stars, "stars")
    since = marks()
    tried = materialise(_hopeful(stars, nodes, percent / 100), "tried")
    sets = _sets(_ends(tried), df, nodes, id_col, text_col, words)
    spent = taken(since)
    links = _confirmed(tried, sets, percent)
    release(spent)
    roots = _roots(components, links)

    at = buckets.join(roots.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    split = at.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    rest = materialise(at.join(split, "key", "left_semi").select("c", "root").distinct(), "mixed")
    if not rest.isEmpty():
        since = marks()
        sets = _sets(rest, df, nodes, id_col, text_col, words)
        across = materialise(_hopeful(_across(sets, percent).join(stars, ["a", "b"], "left_anti"), nodes, percent / 100), "across")
        spent = taken(since)
        more = _confirmed(across, sets, percent)
        release(spent)
        roots = _roots(_rooted_anew, roots, rest, more)

    placed = nodes.join(roots.withColumnRenamed("node", "c").hint("merge"), "c", "left").select("set_key", "class_id", F.coalesce("root", "c").alias("root"))
    first = placed.groupBy("root").agg(F.min("class_id").alias("component"))
    of = placed.join(first.hint("merge"), "root").select("set_key", "component")
    out = rows.select(id_col, "n_shingles", "set_key").join(of.hint("merge"), "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col(id_col))
    return out.select(id_col, "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col(id_col)).alias("kept"))


def op9_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents: three-word shingles, a similarity of 0.85 or more."""
    return near_duplicates(documents(spark, sf_dir), words=3, percent=85)
