"""Packing token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenised whole. Pieces of the full window length fill windows of their own. What is left of
a document is cut by a fixed rule into a large, a middle and a small piece, so that differencing has small
pieces to end on. Pieces are dealt at random into blocks of a bounded number of tokens, and each block is
split into near equal windows by merging partial partitions with opposing imbalances. If the fullest window
exceeds the capacity, the block's window count rises by one until it fits.
"""

from __future__ import annotations

import heapq
import unicodedata
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, materialise

WINDOW = 2048
BLOCK_WINDOWS = 256
TOKENIZER = "word_bpe_49k.json"


#: The pre-tokens of the tokenizer's file.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class RunTokens(dict):
    """Maps a run of non-space characters to its ids as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are its runs' ids in order,
    and a run's are its pre-tokens'. Both are remembered; all beyond ``most`` of either kind is forgotten. A text
    with one of the tokenizer's added tokens, such as <|endoftext|>, goes to the tokenizer whole.
    """

    def __init__(self, path: str, most: int = 600_000):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.most, self.words = most, {}
        self.tokenizer = Tokenizer.from_file(path)
        self.added = tuple(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        self.model, self.split, self.letters = self.tokenizer.model, regex.compile(PRE_TOKENS).findall, _byte_letters()

    def word(self, word: str) -> bytes:
        if len(self.words) >= self.most:
            self.words.clear()
        plain = word if word.isascii() and word.isprintable() else word.encode("utf-8").decode("latin-1").translate(self.letters)
        found = self.words[word] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(plain)])
        return found

    def __missing__(self, run: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        plain = run if run.isascii() else unicodedata.normalize("NFC", run)
        plain = plain.lower() if "\u03a3" not in plain else "".join([c.lower() for c in plain])  # a final sigma is none here
        found = self[run] = b"".join([self.words.get(w) or self.word(w) for w in self.split(plain)])
        return found

    def ids(self, text: str) -> bytes:
        if any(c in text for c in _NOT_SPACE) or any(x in text for x in self.added):  # an added token is no run's part
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.split()))


#: White space to Python's split(), but not to the tokenizer.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"


def cuts(n: int, window: int = WINDOW) -> list[int]:
    """Lengths of the pieces of ``n`` ids: whole windows, then five sixths, an eighth and the rest of what remains."""
    out, rest = [window] * (n // window), n % window
    if rest >= 48:
        out += [rest * 5 // 6, rest // 8]
        rest -= sum(out[-2:])
    return out + [rest] * (rest > 0)


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: k groups of indices of ``sizes`` with near equal sums.

    A partial partition is a list of (sum, group), ascending, without its empty groups. The two partitions
    of the largest imbalance merge: the fullest group of one joins the emptiest of the other.
    """
    if k == 1:
        return [list(range(len(sizes)))]
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            merged = sorted(a + b, key=lambda x: x[0])
        else:  # the smallest groups of both meet in opposite order; larger ones meet empty groups
            small, rest = a[:over], a[over:]
            tail, free = b[:over], b[over:]
            merged = sorted([(x[0] + y[0], x[1] + y[1]) for x, y in zip(small, reversed(tail), strict=True)] + rest + free, key=lambda x: x[0])
        low = merged[0][0] if len(merged) == k else 0
        heapq.heappush(heap, (low - merged[-1][0], serial, merged))
        serial += 1
    return [g for _, g in heap[0][2]] if heap else []


def windows(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """Groups of indices, each of at most ``window`` in sum. ``sizes`` are at most ``window`` each."""
    full = [[i] for i, s in enumerate(sizes) if s == window]
    part = [i for i, s in enumerate(sizes) if s < window]
    k = -(-sum(sizes[i] for i in part) // window)
    while part:
        groups = difference([sizes[i] for i in part], k)
        if max(sum(sizes[part[j]] for j in g) for g in groups) <= window:
            return full + [[part[j] for j in g] for g in groups if g]
        k += 1
    return full


_tokens: dict[str, RunTokens] = {}


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Pieces of every document's ids: id, start, length, ids_crc32, doc_tokens, and a serial number of the piece."""
    kind = df.schema[id_col].dataType.simpleString()

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        tokens = _tokens.setdefault(tokenizer, RunTokens(tokenizer))
        serial = TaskContext.get().partitionId() << 40
        names = ["start", "length", "ids_crc32", "doc_tokens", "serial"]
        for batch in batches:
            ids, rows = [], []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                data = memoryview(tokens.ids(text.as_py() or "") + b"\1\0\0\0")
                at, n = 0, len(data) // 4
                for length in cuts(n, window):
                    rows.append((at, length, zlib.crc32(data[4 * at : 4 * (at + length)]), n, serial))
                    ids.append(key)
                    at, serial = at + length, serial + 1
                if len(rows) >= 50_000:
                    yield table(pa, batch, ids, rows, names)
                    ids, rows = [], []
            if rows:
                yield table(pa, batch, ids, rows, names)

    def table(pa, batch, ids, rows, names):
        keys = pa.array([x.as_py() for x in ids], batch.column(0).type)
        return pa.RecordBatch.from_arrays([keys, *map(pa.array, zip(*rows, strict=True))], [id_col, *names])

    return df.select(id_col, text_col).mapInArrow(cut, f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, serial long")


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document ends in id 1, so an empty or null text is one piece of one id. Null and equal ids are
    documents of their own. An empty table gives an empty table. Blocks hold about ``BLOCK_WINDOWS``
    windows; pieces go to a block by the hash of a serial number, so no key can make a block large.
    """
    kind = df.schema[id_col].dataType.simpleString()
    cut = materialise(pieces(df, tokenizer, id_col, text_col, window), "pieces")
    total = cut.agg(F.sum("length")).first()[0] or 0
    n_blocks = max(1, total // (window * BLOCK_WINDOWS))

    def fill(key, table):
        import pyarrow as pa

        table = table.sort_by("serial")
        sizes = table.column("length").to_pylist()
        seq, off = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for w, group in enumerate(windows(sizes, window)):
            at = 0
            for i in group:
                seq[i], off[i] = (key[0].as_py() << 24) + w, at
                at += sizes[i]
        return table.drop(["serial", "block"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    return cut.withColumn("block", F.pmod(F.xxhash64("serial"), F.lit(n_blocks))).groupBy("block").applyInArrow(
        fill, f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op3_karmarkar_karp(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    return pack(documents(spark, sf_dir), str(tokenizer))
