"""Canonical exact digests of documents.

A text is normalised (NFC, case folding, white space runs to one space, trimmed) and digested by two chained
xxhash64 values, 128 bits. Rows with equal digests form a bucket, and in buckets of two or more the normalised
bytes themselves are compared. All of it is DataFrame code.

Most texts hold no character that composition could change and pass through. In others, every such cluster of
characters is decomposed, its marks are put in canonical order, and composed again by the rules of Unicode's
annex 15, Hangul arithmetically; each distinct cluster of a text once.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._common import documents, materialise

#: Rows of repeated digests of which the ids may be broadcast: 1 million of 8 bytes.
BROADCAST_IDS = 1_000_000
#: Bytes of texts that one window task orders, and the most blocks for it.
BLOCK_BYTES, BLOCKS = 64 << 20, 1 << 16
#: First code points, and numbers, of Hangul's leads, vowels, tails and syllables (Unicode, section 3.12).
L, V, T, S = 0x1100, 0x1161, 0x11A7, 0xAC00
LEADS, VOWELS, TAILS = 19, 21, 28


def _every():
    """Characters that are assigned, without surrogates and Hangul syllables."""
    return (c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) not in ("Cn", "Cs", "Co") and not S <= ord(c) < S + LEADS * VOWELS * TAILS)


@cache
def _tables() -> dict[str, str]:
    """Strings to translate by and to look up in, from the Unicode data of Python."""
    full, classes, pairs, unsafe = {}, {}, [], set()
    for c in _every():
        if unicodedata.combining(c):
            classes[c] = chr(0x4E00 + unicodedata.combining(c))
            unsafe.add(c)
        parts = unicodedata.decomposition(c)
        if parts and parts[0] != "<":
            full[c] = unicodedata.normalize("NFD", c)
            two = "".join(chr(int(x, 16)) for x in parts.split())
            if unicodedata.normalize("NFC", c) != c:
                unsafe.add(c)
            elif len(two) == 2:
                pairs.append((two, c))
                unsafe.add(two[1])
    unsafe.update(map(chr, [*range(V, V + VOWELS), *range(T + 1, T + TAILS)]))
    out = {"marks": "".join(classes), "classes": "".join(classes.values()), "pairs": "".join(f"\1{two}{c}" for two, c in pairs), "unsafe": _ranges(unsafe)}
    for k in range(4):  # a decomposition has four characters at most
        some = [c for c in full if len(full[c]) > k]
        out[f"from{k}"], out[f"to{k}"] = "".join(some), "".join(full[c][k] for c in some)
    return out


@cache
def _folds() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """What case folding does beyond lower case: characters that become another one, and those that become several."""
    found = [(c, c.casefold()) for c in _every() if c.casefold() != c.lower() or c == "\u03a3"]
    return [x for x in found if len(x[1]) == 1], [x for x in found if len(x[1]) > 1]


def _ranges(chars: set[str]) -> str:
    """What a regex class of ``chars``, and of what is in gaps of under 32 between them, holds between its brackets.

    A class of few ranges is fast; the further characters are handled by the same rules and stay as they are.
    """
    found: list[list[int]] = []
    for cp in sorted(map(ord, chars)):
        if found and cp - found[-1][1] < 32:
            found[-1][1] = cp
        else:
            found.append([cp, cp])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in found)


def _char(code: Column) -> Column:
    """The character of a code point below 0x10000."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _cluster(text: Column) -> Column:
    """NFC of a cluster of a few characters."""
    t = _tables()
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))

    def parts(c: Column) -> Column:
        return F.concat(*[F.when(F.instr(F.lit(t[f"from{k}"]), c) > 0, F.translate(c, t[f"from{k}"], t[f"to{k}"])).otherwise(c if k == 0 else F.lit("")) for k in range(4)])

    plain = F.regexp_extract_all(F.array_join(F.transform(chars, parts), ""), F.lit("(?s)."), F.lit(0))
    ccc = lambda c: F.when(F.instr(F.lit(t["marks"]), c) > 0, F.ascii(F.translate(c, t["marks"], t["classes"])) - 0x4E00).otherwise(F.lit(0))
    # Marks are ordered by class within the run after a starter: (number of starters so far, class, place).
    start = F.struct(F.lit(0).alias("group"), F.array().cast("array<struct<group:int,ccc:int,i:int,c:string>>").alias("all"))

    def number(state: Column, c: Column) -> Column:
        group = state["group"] + (ccc(c) == 0).cast("int")
        one = F.struct(group.alias("group"), ccc(c).alias("ccc"), F.size(state["all"]).alias("i"), c.alias("c"))
        return F.struct(group.alias("group"), F.concat(state["all"], F.array(one)).alias("all"))

    ordered = F.array_sort(F.aggregate(plain, start, number)["all"])
    empty = F.struct(F.lit("").alias("done"), F.lit("").alias("starter"), F.lit("").alias("tail"), F.lit(0).alias("last"))

    def compose(state: Column, x: Column) -> Column:
        c, k, starter = x["c"], x["ccc"], state["starter"]
        at = F.instr(F.lit(t["pairs"]), F.concat(F.lit("\1"), starter, c))
        cp, mark = F.ascii(starter), F.ascii(c)
        lead = cp.between(L, L + LEADS - 1) & mark.between(V, V + VOWELS - 1)
        tail = cp.between(S, S + LEADS * VOWELS * TAILS - 1) & ((cp - S) % TAILS == 0) & mark.between(T + 1, T + TAILS - 1)
        one = F.when(at > 0, F.substring(F.lit(t["pairs"]), at + 3, F.lit(1))).when(lead, _char(S + ((cp - L) * VOWELS + mark - V) * TAILS)).when(tail, _char(cp + mark - T))
        free = (starter != "") & ((state["tail"] == "") | (state["last"] < k))
        kept = F.struct(state["done"].alias("done"), one.alias("starter"), state["tail"].alias("tail"), state["last"].alias("last"))
        new = F.struct(F.concat(state["done"], starter, state["tail"]).alias("done"), c.alias("starter"), F.lit("").alias("tail"), F.lit(0).alias("last"))
        more = F.struct(state["done"].alias("done"), starter.alias("starter"), F.concat(state["tail"], c).alias("tail"), k.alias("last"))
        return F.when(free & one.isNotNull(), kept).when(k == 0, new).otherwise(more)

    return F.aggregate(ordered, empty, compose, lambda x: F.concat(x["done"], x["starter"], x["tail"]))


def composed(text: Column) -> Column:
    """NFC."""
    u = _tables()["unsafe"]
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)[^{u}]?[{u}]+|[^{u}]+?(?=[^{u}][{u}]|\\z)"), F.lit(0))
    some = F.array_distinct(F.filter(pieces, lambda x: x.rlike(f"[{u}]")))
    table = F.struct(some.alias("old"), F.transform(some, _cluster).alias("new"))

    def put(x: Column) -> Column:  # one table a text
        return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.get(x["new"], (F.array_position(x["old"], p) - 1).cast("int")), p)), "")

    whole = F.get(F.transform(F.array(table), put), F.lit(0))
    # Nothing below U+0300 composes with what stands before it.
    return F.when(text.rlike("[^\\x{0}-\\x{2ff}]") & text.rlike(f"[{u}]"), whole).otherwise(text)


def _fold_one(text: Column) -> Column:
    """Characters whose case folding is another one than lower case."""
    one, _ = _folds()
    return F.when(text.rlike(f"[{_ranges({a for a, _ in one})}]"), F.translate(text, "".join(a for a, _ in one), "".join(b for _, b in one))).otherwise(text)


def _fold_several(text: Column) -> Column:
    """Characters that case folding makes several of; then lower case."""
    _, several = _folds()
    more = text
    for a, b in several:
        more = F.replace(more, F.lit(a), F.lit(b))
    return F.lower(F.when(text.rlike(f"[{_ranges({a for a, _ in several})}]"), more).otherwise(text))


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+", " "))


#: The steps of normalisation: composition, case folding, white space. Null stays null.
STEPS = (composed, _fold_one, _fold_several, _spaced)


def normalised(df: DataFrame, text_col: str, name: str, steps=STEPS) -> DataFrame:
    """``df`` with the normalised text as ``name``. Each step is a projection of its own, as it reads its input several times."""
    own = [c for c in df.columns if c != name]
    df = df.withColumn("_step", F.col(text_col))
    for step in steps:
        df = df.withColumn("_step", step(F.col("_step")))
    return df.select(*own, F.col("_step").alias(name))


def with_digest(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """``df`` with the digest of the normalised text as ``name``."""
    own = [c for c in df.columns if c != name]
    return normalised(df, text_col, "_canon").select(*own, digest(F.col("_canon")).alias(name))


def digest(canon: Column) -> Column:
    """32 hex digits."""
    part = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(part(F.xxhash64(canon)), part(F.xxhash64(F.lit(0x5EED), canon, F.octet_length(canon))))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: DataFrame | None = None) -> DataFrame:
    """Classes of repeated normalised texts: fingerprint, class_id (the class's smallest id), n_copies.

    Digests are counted first, without texts; only texts of ids with repeated digests then have their normalised
    bytes compared, by grouping on digest and bytes (copies merge before the shuffle). ``digests`` are the rows' ids
    and fingerprints, where they are at hand. A null text counts as an empty one, and a null id as
    larger than all others; repeated rows are copies. An empty table gives an empty table. Raises ValueError
    should two texts ever share a digest of 128 bits.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    if digests is None:
        digests = with_digest(df.select(id_col, text.alias("_text")), "_text", "fingerprint").select(id_col, "fingerprint")
    own = digests.select(F.col(id_col).alias("_id"), "fingerprint")
    repeated = own.groupBy("fingerprint").count().where("count > 1").select("fingerprint")
    some = materialise(own.join(repeated, "fingerprint", "left_semi").select("_id", "fingerprint"), "repeated")
    ids = some.select(F.col("_id").alias("_k")).distinct()
    if some.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    canon = df.select(F.col(id_col).alias("_id"), text.alias("_text")).join(ids, F.col("_id").eqNullSafe(F.col("_k")), "left_semi").select("_id", "_text")
    canon = normalised(canon, "_text", "_canon").select("_id", "_canon", digest(F.col("_canon")).alias("fingerprint"))
    found = materialise(canon.groupBy("fingerprint", "_canon").agg(F.min("_id").alias("class_id"), F.count("*").alias("n_copies")).where("n_copies > 1").drop("_canon"), "digest-classes")
    if not found.groupBy("fingerprint").count().where("count > 1").isEmpty():
        raise ValueError("two texts share a 128-bit digest; choose another seed")
    return found


def with_next(df: DataFrame, id_col: str, carry: list[str], n_blocks: int) -> DataFrame:
    """Adds ``next``, a struct of ``carry`` of the row that follows in ascending id; the last row's is the first row.

    The id range is cut at approximate quantiles into blocks. Each block is a window of its own, and one
    row per block, at most ``n_blocks``, links a block's last row to the next filled block. Null ids come
    first; rows of one id follow each other in the order of ``carry``, and share a block.
    """
    cuts = df.agg(F.percentile_approx(id_col, [i / n_blocks for i in range(1, n_blocks)], 10 * n_blocks)).first()[0] if n_blocks > 1 else None
    cuts = sorted(set(cuts or []))
    block = F.lit(0)
    if cuts:  # cuts below an id are counted in runs first, and then within one run
        step = max(1, int(len(cuts) ** 0.5))
        runs = [cuts[i : i + step] for i in range(0, len(cuts), step)]
        run = F.size(F.filter(F.lit([x[0] for x in runs]), lambda x: x <= F.col(id_col)))
        within = F.size(F.filter(F.get(F.lit(runs), run - 1), lambda x: x <= F.col(id_col)))
        block = F.when(F.col(id_col).isNull() | (run == 0), 0).otherwise((run - 1) * step + within)
    df = df.withColumn("_block", block).withColumn("_row", F.struct(*carry))
    order = [F.col(id_col).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in carry]]
    first = df.groupBy("_block").agg(F.min_by("_row", F.struct(F.coalesce(id_col, F.lit(-(2**63))).alias("i"), "_row")).alias("_first"))
    blocks = Window.orderBy("_block")  # one row per block
    link = first.select("_block", F.coalesce(F.lead("_first").over(blocks), F.first("_first").over(blocks.rowsBetween(Window.unboundedPreceding, 0))).alias("_link"))
    lead = df.withColumn("_lead", F.lead("_row").over(Window.partitionBy("_block").orderBy(*order)))
    return lead.join(link, "_block").withColumn("next", F.coalesce("_lead", "_link")).drop("_block", "_row", "_lead", "_link")


def op7_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness: 1.0 if equal, else 0.0.

    Extra columns: class_id (smallest doc_id of the same normalised text; null where it is the only one)
    and n_copies. A null text is an empty one, and an empty text is left as it is by the edit. Null ids come first
    in the order of documents, repeated ids in the order of their texts; each row has its own result. A table of
    one row is followed by that row; an empty table gives an empty table.
    """
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = min(BLOCKS, max(size // BLOCK_BYTES, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    own = with_digest(docs, "text", "fingerprint")
    rows = with_next(own, "doc_id", ["text", "fingerprint"], n_blocks)
    n = F.char_length("text")
    edited = F.expr("concat(left(text, char_length(text) - int(floor(char_length(text) / 4))), left(next.text, int(floor(char_length(text) / 4))))")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.when(n >= 4, edited).otherwise(F.col("text")).alias("edited"), "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"))
    rows = with_digest(rows, "edited", "edited_fingerprint").withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")
    rows = materialise(rows, "fingerprints")
    found = classes(docs, digests=rows)
    like = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    return rows.join(found, "fingerprint", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        like("fingerprint", "edited_fingerprint").alias("near_edited"), like("fingerprint", "next_fingerprint").alias("near_next"),
        "class_id", F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
