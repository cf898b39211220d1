"""Benchmark decontamination by latent semantic retrieval.

Words are hashed into ``WORDS`` columns and passages of ``2 * BLOCK`` words are rows of a TF-IDF matrix A.
One distributed pass multiplies A'A with a random orthonormal sketch; a Nystroem step on the small result
gives A's leading singular vectors. Texts are folded in as words times vectors over singular values, so a
passage's latent vector is a sum of table rows. Every passage of every document is compared with every
benchmark passage by cosine; candidates must share enough of the item's weight. As a short or edited item is
a small part of a passage, an exact filter on the rarest words of each item adds all other places that hold
enough of its words close together. Of both kinds, places without enough of the item's columns in order go.
Candidates are then read: the longest common subsequence with the item, and its answer, decide.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, materialise, mixed, shared, summed

WORDS = 1 << 14
RANK = 64
BLOCK = 16
#: A candidate passage has this cosine with an item's passage, and holds this share of its TF-IDF weight.
COSINE, OVERLAP = 0.3, 0.3
#: An item leaks with this share of its words in order, or with the lower one if its answer is there too.
LCS, LCS_ANSWER = 0.8, 0.65
#: Items are read in blocks of so many characters, or one item, each with a pass over the documents' columns.
ITEM_CHARS = 32 << 20
#: Candidate documents of which the ids may be broadcast: 1 million of 8 bytes.
BROADCAST_IDS = 1_000_000
SEGMENT = BLOCK * 4096
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


#: Bytes that are hashed at a time.
PIECE = 1 << 17
_ODD = re.compile(r"[^\w\x00-\x7f]")
_SPACE = re.compile(r"\s")
#: Of each byte: 0 white space, 1 an edge of words, 2 a part of words.
_KIND = np.array([0 if chr(b).isspace() and b < 128 else 2 if b >= 128 or chr(b).isalnum() else 1 for b in range(256)], np.uint8)


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse modulo 2**64."""
    factor = 0x9E3779B97F4A7C15
    inverse = pow(factor, -1, 1 << 64)
    return tuple(np.multiply.accumulate(np.full(PIECE + 1, x, np.uint64)) * np.uint64(pow(x, -1, 1 << 64)) for x in (factor, inverse))


def _hashed_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, column) of the words of up to PIECE bytes."""
    kind = _KIND[data]
    at = np.flatnonzero(kind == 2)
    if not len(at):
        return at, np.zeros(0, np.uint16)
    run = np.cumsum(kind == 0, dtype=np.int32)[at]
    cut = np.flatnonzero(run[1:] != run[:-1])
    start, end = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
    power, inverse = _powers()
    sums = np.cumsum(data * power[: len(data)])
    value = (sums[end] - np.where(start > 0, sums[start - 1], 0)) * inverse[start]
    return start, (mixed(value) >> np.uint64(50)).astype(np.uint16)


def _pieces(text: str | None):
    """The bytes of a text in lower case, cut at white space into pieces of up to about PIECE / 2 characters."""
    low = (text or "").lower()
    if not low.isascii():  # other white space and punctuation become ASCII's
        low = _ODD.sub(lambda m: " " if m[0].isspace() else "'", low)
    at = 0
    while len(low) - at > PIECE // 4:
        m = _SPACE.search(low, at + PIECE // 8)
        if m is None:
            break
        yield low[at : m.start()].encode("utf-8", "surrogatepass")
        at = m.start()
    yield low[at:].encode("utf-8", "surrogatepass")


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The columns of all words of ``texts``, and where each text's begin, with their number at the end."""
    found, counts = [], np.zeros(len(texts) + 1, np.int64)
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush():
        nonlocal size
        data = b" ".join(x for _, x in held)
        ends = np.cumsum([len(x) + 1 for _, x in held])
        start, column = _hashed_words(np.frombuffer(data, np.uint8))
        found.append(column)
        which = np.array([i for i, _ in held])[np.searchsorted(ends, start, side="right")]
        np.add.at(counts, which + 1, 1)
        held.clear()
        size = 0

    for i, text in enumerate(texts):
        for whole in _pieces(text):
            for piece in [whole] if len(whole) < PIECE else whole.split():
                if size + len(piece) >= PIECE and held:
                    flush()
                if len(piece) < PIECE:
                    held.append((i, piece))
                    size += len(piece) + 1
                elif (column := _long(piece)) is not None:
                    found.append(np.array([column], np.uint16))
                    counts[i + 1] += 1
    if held:
        flush()
    return np.concatenate([np.zeros(0, np.uint16), *found]), np.cumsum(counts)


def _long(run: bytes) -> int | None:
    """The column of a word that no piece holds."""
    import xxhash

    at = np.flatnonzero(_KIND[np.frombuffer(run, np.uint8)] == 2)
    return xxhash.xxh3_64_intdigest(run[at[0] : at[-1] + 1]) % WORDS if len(at) else None


def columns(text: str | None) -> np.ndarray:
    return hashed([text])[0]


def words(text: str | None) -> list[str]:
    return [w for w in (_EDGES.sub("", run.lower()) for run in (text or "").split()) if w]


def _segments(batches):
    """Chunks of (row of the batch, first word, columns) lists of up to SEGMENT words, from (key, columns) batches."""
    for batch in batches:
        chunk, size = [], 0
        for i, data in enumerate(batch.column(1)):
            ids = np.frombuffer(data.as_buffer(), np.uint16)
            for at in range(0, max(1, len(ids) - BLOCK), SEGMENT):
                part = ids[at : at + SEGMENT + BLOCK]
                if len(part):
                    chunk.append((i, at, part))
                    size += len(part)
                if size >= SEGMENT:
                    yield batch, chunk
                    chunk, size = [], 0
        if chunk:
            yield batch, chunk


def _blocks(chunk, width: int):
    """A chunk's words in rows of ``width`` columns, filled up with WORDS; each row's place in the chunk, and in its text."""
    n = np.array([-(-len(p) // width) for _, _, p in chunk])
    base = np.cumsum(n) - n
    grid = np.full(n.sum() * width, WORDS, np.int64)
    for at, (_, _, part) in zip((base * width).tolist(), chunk, strict=True):
        grid[at : at + len(part)] = part
    segment = np.repeat(np.arange(len(chunk)), n)
    return grid.reshape(-1, width), segment, np.arange(len(segment)) - base[segment]


def _once(grid: np.ndarray) -> np.ndarray:
    """Rows of columns, each column once and the others WORDS."""
    grid = np.sort(grid, axis=1)
    grid[:, 1:][grid[:, 1:] == grid[:, :-1]] = WORDS
    return grid


def _summed_rows(table: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """The sum of a table's rows over each row of columns. The table's row WORDS is zero."""
    return np.matmul(np.ones((1, grid.shape[1]), table.dtype), table.take(grid, axis=0))[:, 0]


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """The number of passages with each column, and of all passages."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(WORDS + 1, np.int64)
        for _, chunk in _segments(batches):
            grid, _, _ = _blocks(chunk, 2 * BLOCK)
            found = np.bincount(_once(grid).ravel(), minlength=WORDS + 1)
            total[:WORDS] += found[:WORDS]
            total[WORDS] += len(grid)
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([_partition()]), pa.array([total.tobytes()], pa.binary())], ["block", "part", "data"])

    got = summed(rows.mapInArrow(count, "block long, part long, data binary"), "<i8").collect()
    total = np.frombuffer(got[0]["data"], "<i8") if got else np.zeros(WORDS + 1, np.int64)
    return total[:WORDS], int(total[WORDS])


@dataclass
class Space:
    """idf per column, and the table that folds words in: column x RANK. Both have a zero at WORDS."""

    idf: np.ndarray
    fold: np.ndarray


def fit(rows: DataFrame, seed: int = 5) -> Space:
    """The latent space of all passages of ``rows`` (key, columns)."""
    df, n = _frequencies(rows)
    idf = np.append(np.log((n + 1) / (df + 1)), 0).astype(np.float32)
    sketch = np.linalg.qr(np.random.default_rng(seed).normal(size=(WORDS, RANK)))[0].astype(np.float32)
    sent = shared(rows.sparkSession, (idf, np.vstack((sketch * idf[:-1, None], np.zeros((1, RANK), np.float32)))))
    pieces = 16

    def multiply(batches):
        import pyarrow as pa

        idf, scaled = sent.value
        total = np.zeros((RANK, WORDS + 1))
        for _, chunk in _segments(batches):
            grid, _, _ = _blocks(chunk, 2 * BLOCK)
            square = np.maximum((idf[grid] ** 2).sum(axis=1), 1e-6)  # both factors of A'A have unit rows
            y = np.ascontiguousarray((_summed_rows(scaled, grid) / square[:, None]).T)
            flat = grid.ravel().astype(np.uint16)
            order = np.argsort(flat, kind="stable")
            column = flat[order]
            first = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
            total[:, column[first]] += np.add.reduceat(y.take(order // grid.shape[1], axis=1), first, axis=1)
        total = total[:, :WORDS] * idf[:WORDS]
        for i, block in enumerate(np.array_split(total.astype(np.float32), pieces, axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([_partition()]), pa.array([np.ascontiguousarray(block).tobytes()], pa.binary())], ["block", "part", "data"])

    got = sorted(summed(rows.mapInArrow(multiply, "block long, part long, data binary"), "<f4").collect(), key=lambda r: r.block)
    if n == 0 or not got:
        return Space(idf, np.zeros((WORDS + 1, RANK), np.float32))
    z = np.concatenate([np.frombuffer(r["data"], "<f4").reshape(RANK, -1) for r in got], axis=1).T.astype(np.float64)
    shift = 1e-6 * max(np.linalg.norm(z), 1e-12)
    z += shift * sketch
    gram = sketch.T.astype(np.float64) @ z
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    u, s, _ = np.linalg.svd(z @ (vectors / np.sqrt(np.maximum(values, shift * 1e-3))), full_matrices=False)
    return Space(idf, np.vstack((idf[:-1, None] * u / np.maximum(s, 1e-9), np.zeros((1, RANK)))).astype(np.float32))


@dataclass
class Queries:
    """Passages of benchmark items: latent vectors, columns and their weights as shares of the passage, item numbers.

    ``rare`` is an exact filter over passages that cover all words of the items.
    """

    vectors: np.ndarray
    weights: list[tuple[np.ndarray, np.ndarray]]
    item: np.ndarray
    rare: Rare
    columns: list[list[int]]  # of each item

    def close(self, text: np.ndarray, item: int, at: int) -> bool:
        """Whether enough of an item's words stand in order near a place. Words of one column count as equal, so no leak is lost."""
        own = self.columns[item]
        lo, hi = _near(len(own), at)
        return common_subsequence(own, text[lo:hi].tolist()) >= LCS_ANSWER * len(own)


@dataclass
class Rare:
    """An exact filter for parts of items: which text holds LCS_ANSWER of a part's words close together.

    Of a part's ``need`` words, at least ``least`` are among its rarest ones, if the others are no more than
    need - least. So a text that holds the part has ``least`` of the rarest words within ``reach`` words, and
    ``need`` of all of its words around them.
    """

    item: np.ndarray
    need: np.ndarray
    least: np.ndarray
    reach: np.ndarray
    start: np.ndarray  # by column, of its entries in ``entries``; one more at the end
    entries: np.ndarray  # parts that have the column among their rarest
    words: list[np.ndarray]  # columns of each part

    @staticmethod
    def of(parts: list[np.ndarray], item: list[int], idf: np.ndarray) -> Rare:
        n = np.array([len(p) for p in parts], np.int64)
        need = -(-(n * round(100 * LCS_ANSWER)) // 100)
        least = np.minimum(need, 1 + n // 8)
        cols, of = [], []
        for k, part in enumerate(parts):
            own, times = np.unique(part, return_counts=True)
            order = np.lexsort((own, -idf[own]))
            after = len(part) - np.cumsum(times[order])  # words that are left when so many columns are taken
            taken = own[order][: int(np.argmax(after <= need[k] - least[k])) + 1]
            cols.append(taken)
            of.append(np.full(len(taken), k))
        cols, of = np.concatenate([np.zeros(0, np.int64), *cols]), np.concatenate([np.zeros(0, np.int64), *of])
        order = np.argsort(cols, kind="stable")
        start = np.concatenate(([0], np.cumsum(np.bincount(cols, minlength=WORDS + 1))))
        return Rare(np.array(item, np.int64), need, least, n + n // 4 + BLOCK, start, of[order], [np.unique(p) for p in parts])

    def places(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, word): where texts may hold an item."""
        none = np.zeros(0, np.int64)
        if not len(self.item) or not texts:
            return none, none, none
        gap = 2 * int(self.reach.max()) + 1
        base = gap + np.cumsum([0, *(len(t) + gap for t in texts)])
        flat = np.full(base[-1], WORDS, np.int64)
        for at, t in zip(base.tolist(), texts, strict=False):
            flat[at : at + len(t)] = t
        n = self.start[flat + 1] - self.start[flat]
        where = np.flatnonzero(n)
        n = n[where]
        at = np.repeat(where, n)
        part = self.entries[np.repeat(self.start[flat[where]] - np.cumsum(n) + n, n) + np.arange(len(at))]
        order = np.argsort(part.astype(np.uint16) if len(self.item) < 1 << 16 else part, kind="stable")
        at, part = at[order], part[order]
        last = np.arange(len(at)) + self.least[part] - 1
        near = np.minimum(last, len(at) - 1)
        held = np.flatnonzero((last < len(at)) & (part[near] == part) & (at[near] - at < self.reach[part]))
        at, part = at[held], part[held]
        found = []
        for k, lo, hi in zip(*_runs(part), strict=True):
            own = np.zeros(WORDS + 1, bool)
            own[self.words[k]] = True
            reach = int(self.reach[k])
            for x in range(lo, hi, 20_000):
                here = at[x : min(hi, x + 20_000)]
                enough = own[flat[here[:, None] + np.arange(-reach, reach)]].sum(axis=1) >= self.need[k]
                found.append((here[enough], np.full(int(enough.sum()), self.item[k])))
        if not found:
            return none, none, none
        at, item = (np.concatenate(x) for x in zip(*found, strict=True))
        text = np.searchsorted(base, at, side="right") - 1
        return text, item, at - base[text]


def _runs(x: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Values, first and last place of the runs of equal values."""
    lo = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return x[lo].tolist(), lo.tolist(), [*lo[1:].tolist(), len(x)][: len(lo)]


def queries(texts: list[str | None], space: Space) -> Queries:
    """Items of over three blocks are cut into passages of two blocks, the last one from the item's end."""
    vectors, weights, item, whole, of, every = [], [], [], [], [], []
    for i, text in enumerate(texts):
        ids = columns(text).astype(np.int64)
        every.append(ids.tolist())
        wide = 2 * BLOCK
        cut = [ids] if len(ids) <= 2 * wide else np.array_split(ids, -(-len(ids) // wide))
        whole += [p for p in cut if len(p)]
        of += [i] * (len(whole) - len(of))
        starts = [0] if len(ids) <= 3 * BLOCK else [*range(0, len(ids) - wide, wide), len(ids) - wide]
        for at in starts if len(ids) else ():
            part = ids if len(starts) == 1 else ids[at : at + wide]
            v, (own, times) = space.fold[part].sum(axis=0), np.unique(part, return_counts=True)
            w = space.idf[own] * times
            vectors.append(v / max(np.linalg.norm(v), 1e-12))
            weights.append((own, (w / max(w.sum(), 1e-12)).astype(np.float32)))
            item.append(i)
    return Queries(np.array(vectors, np.float32).reshape(-1, RANK), weights, np.array(item, np.int64), Rare.of(whole, of, space.idf), every)


def candidates(rows: DataFrame, space: Space, found: Queries, cosine: float = COSINE, overlap: float = OVERLAP) -> DataFrame:
    """(id, item, at): documents with a passage, from word ``at`` on, that is like an item's or has its rare words."""
    sent = shared(rows.sparkSession, (space, found))
    kind = rows.schema["id"].dataType.simpleString()

    def kept(batch, q, places):
        """The rows of places (row of the batch, item, word) that are close to their items."""
        import pyarrow as pa

        close, texts = [], {}
        for i, item, at in places:
            if i not in texts:
                texts[i] = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint16)
            if q.close(texts[i], item, at):
                close.append((i, item, at))
        if close:
            text, item, at = zip(*close, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(item, pa.int64()), pa.array(at, pa.int64())], ["id", "item", "at"])

    def rare(batch, q):
        chunk, first, size = [], 0, 0
        for i, data in enumerate(batch.column(1)):
            chunk.append(np.frombuffer(data.as_buffer(), np.uint16))
            size += len(chunk[-1])
            if size >= SEGMENT or i == batch.num_rows - 1:
                text, item, at = q.rare.places(chunk)
                if len(text):
                    yield from kept(batch, q, np.unique(np.stack((text + first, item, at // BLOCK * BLOCK)), axis=1).T.tolist())
                chunk, first, size = [], i + 1, 0

    def search(batches):
        space, q = sent.value
        weight = np.zeros(WORDS + 1, np.float32)
        done = None
        for batch, chunk in _segments(batches):
            if batch is not done:
                done = batch
                yield from rare(batch, q)
            grid, segment, number = _blocks(chunk, BLOCK)
            v = _summed_rows(space.fold, grid)
            follows = np.append(segment[1:] == segment[:-1], False)
            first = np.flatnonzero(follows | (number == 0) & ~follows)  # a block and the next one, or a text's only block
            second = np.where(follows[first], first + 1, first)
            vectors = v[first] + np.where(follows[first][:, None], v[second], 0)
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            seen = {}
            for lo in range(0, len(vectors), 2048):
                own = None
                for few in range(0, len(q.vectors), 4096):
                    k, p = np.nonzero(q.vectors[few : few + 4096] @ vectors[lo : lo + 2048].T >= cosine)
                    if not len(p):
                        continue
                    if own is None:
                        own = _once(np.concatenate((grid[first[lo : lo + 2048]], grid[second[lo : lo + 2048]]), axis=1))
                    for y, a, b in zip(*_runs(k), strict=True):  # one item's passage at a time, so that its weights stay near
                        cols, share = q.weights[few + y]
                        weight[cols] = share
                        held = p[a:b][weight[own[p[a:b]]].sum(axis=1) >= overlap]
                        weight[cols] = 0
                        for x in (held + lo).tolist():
                            i, at_word, _ = chunk[segment[first[x]]]
                            seen[i, int(q.item[few + y]), at_word + int(number[first[x]]) * BLOCK] = None
            yield from kept(batch, q, seen)

    return rows.mapInArrow(search, f"id {kind}, item long, at long")


def _near(n: int, at: int) -> tuple[int, int]:
    """The words to compare with an item of ``n`` words at a candidate passage."""
    reach = n + n // 4 + BLOCK
    return max(0, at - reach), at + 2 * BLOCK + reach


def common_subsequence(a: list, b: list) -> int:
    """The length of the longest common subsequence, with one bit per word of ``a``."""
    masks: dict = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = row & masks.get(w, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def _answer(text: str | None) -> list[str]:
    """The last sentence, where an item names no answer."""
    return words(re.split(r"(?<=[.!?])\s+|\n", (text or "").strip())[-1])


def _judged(item: list[str], answer: list[str], text: list[str], at: int) -> tuple[float, bool]:
    """The best share of the item's words in order near ``at``, and whether the answer is there in full."""
    lo, hi = _near(len(item), at)
    near = text[lo:hi]
    share = common_subsequence(item, near) / max(1, len(item))
    return share, bool(answer) and common_subsequence(answer, near) == len(answer)


def leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None) -> DataFrame:
    """(id, item id, share, answered): every document and the items that it leaks.

    Items without words, null or empty, leak nowhere, and texts without words leak nothing. Ids of several
    rows are judged by all of their texts; a null id is one id. Statistics, the latent space and the search
    cover all words of all texts. An empty table of either kind gives an empty table. Other columns are
    ignored. Items are read in blocks of ITEM_CHARS, ordered by id.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()

    def columns_of(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                found, starts = hashed(part.column(1).to_pylist())
                data = found.tobytes()
                cells = [data[2 * a : 2 * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cells, pa.binary())], ["id", "columns"])

    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialise(texts.mapInArrow(columns_of, f"id {kind}, columns binary"), "columns")
    space = fit(rows)
    chosen = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"), (F.col(answer_col) if answer_col else F.lit(None)).cast("string").alias("answer"))
    out = None
    block, size = [], 0
    stream = chosen.orderBy("item_id", "text").toLocalIterator()
    while True:
        row = next(stream, None)
        if block and (row is None or size >= ITEM_CHARS):
            part = _leaks(texts, rows, space, block, kind, items.schema[item_col].dataType)
            out = part if out is None else out.union(part)
            block, size = [], 0
        if row is None:
            break
        block.append(row)
        size += len(row.text or "") + len(row.answer or "")
    if out is None:
        out = spark.createDataFrame([], f"id {kind}, item_id {items.schema[item_col].dataType.simpleString()}, share double, answered boolean")
    return out.groupBy(F.col("id").alias(id_col), F.col("item_id").alias(item_col)).agg(F.max("share").alias("share"), F.max("answered").alias("answered"))


def _leaks(texts: DataFrame, rows: DataFrame, space: Space, block: list, kind: str, item_type) -> DataFrame:
    found = queries([x.text for x in block], space)
    near = materialise(candidates(rows, space, found).groupBy("id").agg(F.collect_set(F.struct("item", "at")).alias("near")), "candidates")
    source = texts
    if near.count() <= BROADCAST_IDS:  # texts without candidates are not shuffled
        source = source.join(F.broadcast(near.select(F.col("id").alias("k"))), F.col("id").eqNullSafe(F.col("k")), "left_semi")
    source = source.join(near.withColumnRenamed("id", "k"), F.col("id").eqNullSafe(F.col("k"))).select("id", "text", "near")
    sent = shared(texts.sparkSession, [(x.item_id, words(x.text), words(x.answer) or _answer(x.text)) for x in block])

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            got = []
            for i, (text, marks) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                own, best = words(text.as_py()), {}
                for m in marks.as_py():
                    item_id, item, answer = sent.value[m["item"]]
                    share, answered = _judged(item, answer, own, m["at"])
                    if share >= LCS or share >= LCS_ANSWER and answered:
                        old = best.get(m["item"], (item_id, 0.0, False))
                        best[m["item"]] = (item_id, max(share, old[1]), answered or old[2])
                got += [(i, *x) for x in best.values()]
            if got:
                idx, item_ids, share, answered = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(idx)), pa.array(item_ids, to_arrow_type(item_type)), pa.array(share, pa.float64()), pa.array(answered, pa.bool_())], ["id", "item_id", "share", "answered"])

    from pyspark.sql.pandas.types import to_arrow_type

    return source.mapInArrow(read, f"id {kind}, item_id {item_type.simpleString()}, share double, answered boolean")


def op5_latent_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that leak a benchmark item, with the item: doc_id, item_id, share, answered."""
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
