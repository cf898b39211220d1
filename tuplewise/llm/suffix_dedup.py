"""Removal of long repeated byte strings with a threshold-bounded walk over a Burrows-Wheeler transform.

Every string of ``length`` bytes belongs to the least hash of the 16-byte grams within it, its anchor, so
equal strings have equal anchors wherever they stand. Successive strings of one text with one anchor form a
context. A string has half of its other bytes on one side of the anchor at least, so a context whose sides of
that length are seen once holds no repeat, and is left out. Equal contexts, by 192 bits of hashes, repeat in full;
different contexts with an equal side go, in bounded blocks by anchor, to a suffix array. There, breadth-first backward
extension on the Burrows-Wheeler transform finds the common prefixes of neighbouring suffixes by increasing
value and stops at ``length``: neighbours that it has not told apart by then share that many bytes.

An anchor with more than ``BLOCK_BYTES`` of such contexts would not fit a block. Its contexts are cut
into single strings, which are counted by a 128-bit hash: exact too, and free of large groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import documents, materialise, mixed

LENGTH = 200
GRAM = 16
BLOCK_BYTES = 1_000_000
CHUNK = 4_000_000
#: Texts with contexts to compare, of which the keys may be broadcast: 1 million of 16 bytes.
BROADCAST_KEYS = 1_000_000
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_POSITION = np.uint64((1 << 24) - 1)


def contexts(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(anchor, first, count, left, right): the strings that start at first ... first + count - 1 share an anchor.

    Each of these strings has half of its other bytes, or more, on one side of the anchor. ``left`` hashes the
    anchor with so many bytes before it and ``right`` with so many after it, and is 0 where no string has them.
    """
    found = []
    half = (length - GRAM + 1) // 2
    steps = [*range(0, half, GRAM), half]  # of grams that cover an anchor and half
    for lo in range(0, len(data) - length + 1, CHUNK):
        x, step = data[lo : lo + CHUNK + length - 1].astype(np.uint64), 1
        for k in _K:
            x = x[:-step] * k + x[step:]
            step *= 2
        gram = mixed(x)
        order = (gram & ~_POSITION) | np.arange(len(gram), dtype=np.uint64)
        wide = length - GRAM + 1
        blocks = np.full(-(-len(order) // wide) * wide, ~np.uint64(0))
        blocks[: len(order)] = order
        blocks = blocks.reshape(-1, wide)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(order) - wide + 1
        at = (np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n]) & _POSITION).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        count, at = np.diff(np.append(first, n)), at[first]
        sides = []
        for way, there in ((-1, at - first >= half), (1, first + count - 1 + length - at - GRAM >= half)):
            key, place = np.full(len(at), _K[1 + way]), np.where(there, at, 0)
            for d in steps:
                key = mixed(key * _K[3] + x[np.where(there, place + way * d, 0)])
            sides.append(np.where(there, key | np.uint64(1), np.uint64(0)).view(np.int64))
        found.append((gram[at].view(np.int64), first + lo, count, *sides))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, ordered by ``depth`` symbols or more. ``text``: symbols below 512, 0 at the end."""
    n = len(text)
    padded = np.concatenate((text.astype(np.int64), np.zeros(7, np.int64)))
    key = np.zeros(n, np.int64)
    for i in range(7):
        key = (key << 9) | padded[i : i + n]
    have = 7
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], ranked[1:] != ranked[:-1])))
        if have >= depth or rank.max() == n:
            return order
        after = np.zeros(n, np.int64)
        after[: max(0, n - have)] = rank[have:]
        key = rank * (n + 1) + after
        have *= 2


def repeated(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece, a mask of the starts whose ``length`` bytes also start elsewhere in ``pieces``.

    The walk keeps the intervals of suffixes that begin with one string. All strings of l symbols are
    extended to the left at once: the rows of an interval that follow the same symbol are neighbours again
    under the last-to-first mapping. An interval's end that no shorter string has reached lies between
    suffixes with l symbols in common; it is set, and only then the interval is extended further.
    """
    text = np.zeros(sum(map(len, pieces)) + len(pieces), np.int16)
    starts = np.cumsum([0] + [len(p) + 1 for p in pieces[:-1]])
    for at, p in zip(starts, pieces, strict=True):
        text[at : at + len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) + 1
    n = len(text)
    order = suffix_order(text, length + 1)
    before = text[order - 1]  # the transform; the first suffix follows the last symbol
    last_to_first = np.empty(n, np.int64)
    last_to_first[np.argsort(before, kind="stable")] = np.arange(n)
    heads = np.zeros(n + 1, bool)  # where another first symbol begins
    heads[np.concatenate(([0], np.cumsum(np.bincount(text))))] = True
    parted = np.zeros(n + 1, bool)  # the common prefix with the row before is known to be shorter than length
    parted[[0, n]] = True
    lo, hi = np.array([0]), np.array([n])
    owner = np.full(n + 1, -1, np.int64)
    for _ in range(length):  # common prefixes of 0, 1, ... length - 1 symbols
        sizes = hi - lo
        rows = np.repeat(lo - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        to = last_to_first[rows]
        owner[to] = np.repeat(np.arange(len(lo)), sizes)
        to.sort()
        own = owner[to]
        new = np.ones(len(to), bool)
        new[1:] = (to[1:] != to[:-1] + 1) | (own[1:] != own[:-1]) | heads[to[1:]]
        first = np.flatnonzero(new)
        lo, hi = to[first], to[np.append(first[1:], len(to)) - 1] + 1
        owner[to] = -1
        fresh = ~parted[hi]
        parted[hi] = True
        lo, hi = lo[fresh], hi[fresh]
        if not len(lo):
            break
    same = ~parted
    mask = np.zeros(n, bool)
    mask[order] = same[:n] | same[1:]
    return [mask[at : at + max(0, len(p) - length + 1)] for at, p in zip(starts, pieces, strict=True)]


def _spans(mask: np.ndarray) -> bytes:
    """[first, end) of each run of true values, as 32-bit integers."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge.astype("<i4").tobytes()


def _read(batch, length: int):
    """(row, bytes, contexts) of every text of the second column that is long enough."""
    for i, text in enumerate(batch.column(1)):
        data = text.as_buffer() if text.is_valid else b""
        if len(data) >= length:
            view = memoryview(data)
            yield i, view, contexts(np.frombuffer(view, np.uint8), length)


def _sides(keyed: DataFrame, length: int) -> DataFrame:
    """(key, t, first): the sides of every context of every text t."""

    def scan(batches):
        import pyarrow as pa

        def flush(rows):
            t, key, first = (np.concatenate(x) for x in zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(t), pa.array(first.astype(np.int32))], ["key", "t", "first"])

        rows, size = [], 0
        for batch in batches:
            texts = batch.column(0).to_numpy()
            for i, _, (_, first, _, left, right) in _read(batch, length):
                key, first = np.concatenate((left, right)), np.concatenate((first, first))
                key, first = key[key != 0], first[key != 0]
                rows.append((np.full(len(key), texts[i]), key, first))
                size += len(key)
                if size >= 100_000:
                    yield flush(rows)
                    rows, size = [], 0
        if rows:
            yield flush(rows)

    return keyed.select("t", "text").mapInArrow(scan, "key long, t long, first int")


def _occurrences(texts: DataFrame, length: int, data: bool) -> DataFrame:
    """The contexts of texts (t, text, wanted, u) that start at ``wanted``: text t, u; anchor; digest c1, c2; first; count; then sides, or the bytes."""
    last = "data binary" if data else "left long, right long"

    def scan(batches):
        import pyarrow as pa
        import xxhash

        names = ["t", "u", "anchor", "c1", "c2", "first", "count", *(["data"] if data else ["left", "right"])]

        def flush(rows):
            kinds = [*[pa.int64()] * 7, *([pa.binary()] if data else [pa.int64()] * 2)]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        rows, size = [], 0
        for batch in batches:
            t, u, wanted = batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(2)
            for i, view, found in _read(batch, length):
                at = np.flatnonzero(np.isin(found[1], wanted[i].values.to_numpy()))  # another text with this t may lack some
                for a, f, n, left, right in zip(*(x[at].tolist() for x in found), strict=True):
                    part = view[f : f + n + length - 1]
                    c = xxhash.xxh3_128_digest(part)
                    rows.append((t[i], u[i], a, int.from_bytes(c[:8], "little", signed=True), int.from_bytes(c[8:], "little", signed=True), f, n, *((bytes(part),) if data else (left, right))))
                    size += len(part) if data else 1
                if size >= (4_000_000 if data else 50_000):
                    yield flush(rows)
                    rows, size = [], 0
        if rows:
            yield flush(rows)

    return texts.select("t", "text", "wanted", "u").mapInArrow(scan, "t long, u long, anchor long, c1 long, c2 long, first long, count long, " + last)


#: A kind of context: equal bytes with the same anchor.
KIND = ("anchor", "c1", "c2")


def _walk(data: DataFrame, n_blocks: int, length: int) -> DataFrame:
    """KIND and spans of contexts, block by block."""

    def block(key, table):
        import pyarrow as pa

        pieces = [x.as_py() for x in table.column("data")]
        spans = [_spans(m) for m in repeated(pieces, length)]
        return table.select([*KIND]).append_column("spans", pa.array(spans, pa.binary()))

    return data.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(n_blocks))).groupBy("block").applyInArrow(block, "anchor long, c1 long, c2 long, spans binary")


def _counted(data: DataFrame, length: int) -> DataFrame:
    """KIND and spans of contexts, by counting single strings."""

    def strings(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for i, d in enumerate(batch.column(3)):
                view = memoryview(d.as_buffer())
                n = len(view) - length + 1
                h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[j : j + length]) for j in range(n)]), np.int64).reshape(-1, 2)
                same = [pa.array(np.full(n, batch.column(k)[i].as_py())) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(n)), pa.array(h[:, 0]), pa.array(h[:, 1])], [*KIND, "at", "h1", "h2"])

    each = data.select(*KIND, "data").mapInArrow(strings, "anchor long, c1 long, c2 long, at long, h1 long, h2 long")
    twice = each.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    hit = each.join(twice, ["h1", "h2"], "left_semi").groupBy(*KIND).agg(F.array_sort(F.collect_set("at")).alias("at"))

    def join_up(batches):
        import pyarrow as pa

        for batch in batches:
            spans = []
            for at in batch.column(3):
                mask = np.zeros(length, bool)
                mask[at.values.to_numpy()] = True
                spans.append(_spans(mask))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, pa.binary())], [*KIND, "spans"])

    return hit.mapInArrow(join_up, "anchor long, c1 long, c2 long, spans binary")


def _repeated_keys(keys: DataFrame) -> DataFrame:
    """The values of ``key`` that are there more than once; to be broadcast if they are few."""
    found = materialise(keys.groupBy("key").count().where("count > 1").select("key"), "repeated-keys")
    return F.broadcast(found) if found.count() <= BROADCAST_KEYS else found


def _with_wanted(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts (t, text, wanted, u) with wanted contexts."""
    if wanted.count() <= BROADCAST_KEYS:
        keyed = keyed.join(F.broadcast(wanted.select("t")), "t", "left_semi")
    return keyed.join(wanted, "t").select("t", "text", "wanted", "u")


def remove_repeats(df: DataFrame, length: int = LENGTH, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Removes each byte that a string of ``length`` bytes covers which also starts anywhere else.

    Texts are UTF-8 bytes, and repeats are judged on the whole input; no string crosses texts. Returns the
    columns ``carry``, n_bytes, n_removed, n_spans (maximal removed runs) and kept, the remaining bytes. A
    null or empty text has no bytes; rows of equal ids or texts are each judged by their own text, so copies
    of a text of ``length`` bytes or more lose all. An empty table gives an empty table.
    """
    key = {"t": F.xxhash64("text"), "u": F.xxhash64(F.lit(1), "text")}
    keyed = df.select(F.col(text_col).alias("text")).withColumns(key)
    sides = materialise(_sides(keyed, length), "sides")
    hits = sides.join(_repeated_keys(sides), "key", "left_semi").groupBy("t").agg(F.collect_set("first").alias("wanted"))
    seen = materialise(_occurrences(_with_wanted(keyed, materialise(hits, "wanted")), length, data=False), "contexts")

    kinds = seen.groupBy(*KIND).agg(F.count("*").alias("n"), F.min(F.struct("t", "first")).alias("one"), F.first("count").alias("count"), F.first("left").alias("left"), F.first("right").alias("right"))
    kinds = materialise(kinds, "kinds")
    # Of different kinds with equal sides, one context each goes to the walk.
    ends = kinds.select(*KIND, "one", "count", F.explode(F.array("left", "right")).alias("key")).where("key <> 0")
    ends = ends.join(_repeated_keys(ends), "key", "left_semi").select(*KIND, "one", "count").distinct()
    ends = materialise(ends, "walked")
    wanted = materialise(ends.groupBy(F.col("one.t").alias("t")).agg(F.collect_set(F.col("one.first").cast("int")).alias("wanted")), "walked-texts")
    data = _occurrences(_with_wanted(keyed, wanted), length, data=True).select(*KIND, "data")
    data = materialise(data.join(ends.select(*KIND), [*KIND], "left_semi").dropDuplicates([*KIND]), "context-bytes")
    large = ends.groupBy("anchor").agg(F.sum(F.col("count") + length).alias("size")).where(F.col("size") > BLOCK_BYTES).select("anchor")
    large = materialise(large, "crowded-anchors")
    total = data.agg(F.sum(F.length("data"))).first()[0] or 0
    spans = _walk(data.join(large, "anchor", "left_anti"), max(1, -(-total // BLOCK_BYTES)), length)
    if not large.isEmpty():
        spans = spans.union(_counted(data.join(large, "anchor", "left_semi"), length))
    spans = materialise(spans, "spans")

    whole = kinds.where("n > 1").select(*KIND, F.lit(None).cast("binary").alias("spans"))
    partly = spans.where(F.length("spans") > 0).join(kinds.where("n = 1").select(*KIND), [*KIND], "left_semi").select(*KIND, "spans")
    marked = seen.join(whole.union(partly), [*KIND]).groupBy("t", "u").agg(F.collect_set(F.struct("first", "count", "spans")).alias("marks"))

    fields = [df.schema[c] for c in carry]
    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])

    def remove(batches):
        import pyarrow as pa

        n = len(fields)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                marks = part.column(n + 1)
                ends, flat = marks.offsets.to_numpy(), marks.values
                first, count, spans = flat.field("first").to_numpy(), flat.field("count").to_numpy(), flat.field("spans")
                valid, rows = marks.is_valid().to_pylist(), []
                for i, t in enumerate(part.column(n)):
                    a, b = (ends[i], ends[i + 1]) if valid[i] else (0, 0)
                    rows.append(_without(t.as_buffer() if t.is_valid else b"", first[a:b], count[a:b], spans[a:b], length))
                more = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *more], [*carry, "n_bytes", "n_removed", "n_spans", "kept"])

    inner = [F.col(c).alias(f"_{i}") for i, c in enumerate(carry)]
    texts = df.select(*inner, F.col(text_col).alias("text")).withColumns(key).join(marked, ["t", "u"], "left")
    return texts.select(*[f"_{i}" for i in range(len(carry))], "text", "marks").mapInArrow(remove, schema)


def _without(data, first: np.ndarray, count: np.ndarray, spans, length: int) -> tuple[int, int, int, bytes]:
    """Bytes, removed bytes, removed runs and the rest of a text with marked contexts; a null span marks all of one."""
    view = memoryview(data)
    if not len(first):
        return len(view), 0, 0, bytes(view)
    some = spans.is_valid().to_numpy(zero_copy_only=False)
    begin, end = [first[~some]], [(first + count)[~some]]
    for i in np.flatnonzero(some).tolist():
        at = np.frombuffer(spans[i].as_buffer(), "<i4") + first[i]
        begin.append(at[::2])
        end.append(at[1::2])
    edge = np.bincount(np.concatenate(begin), minlength=len(view) + 1) - np.bincount(np.concatenate(end) + length - 1, minlength=len(view) + 1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return len(view), int(gone.sum()), runs, np.frombuffer(view, np.uint8)[~gone].tobytes()


def op10_bwt_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated strings of 200 bytes."""
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
