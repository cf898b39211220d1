"""The opN_ queries over small tables with awkward rows, against brute force, with the columns of their contracts."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from test_operators import SCHEMA, WORDS, awkward, brute_components, brute_removed, prose  # noqa: F401

from tuplewise.llm import decontamination, language_id, packing, quality, queries

OUT = queries.queries()
VOCABULARY = [a + b for a in WORDS for b in WORDS]


def long_prose(r, n):
    return " ".join(r.choices(VOCABULARY, k=n))


@pytest.fixture(scope="module")
def tables(spark, awkward, tmp_path_factory):  # noqa: F811
    """A folder of tables: awkward rows, leaks and paraphrases, texts of three languages and two qualities, a very long text, repeated ids."""
    r, at = random.Random(31), tmp_path_factory.mktemp("sf")
    items = [(i, long_prose(r, n)) for i, n in enumerate((15, 22, 40, 70, 131))] + [(90, None), (91, "")]
    rows = [(x[0], x[1], None, x[3], x[4]) for x in awkward]
    for i in range(60):
        words = long_prose(r, r.randint(30, 200)).split()
        if i % 2 == 0:
            said = items[i // 2 % 5][1].split()
            if i % 4 == 0:  # a paraphrase
                for j in r.sample(range(len(said)), len(said) // 8):
                    said[j] = r.choice(VOCABULARY) + "x"
            k = r.randint(0, len(words))
            words[k:k] = said
        rows.append((3000 + i, " ".join(words), None, "s", 1))
    sets = {"aa": "abcde", "bb": "fghij", "cc": "eéèxyz"}
    for i in range(240):
        lang = r.choice(list(sets))
        good = i % 2
        text = " ".join("".join(r.choices(sets[lang], k=r.randint(2, 7))) + ("" if good else "%%%") for _ in range(30))
        rows.append((5000 + i, text, lang, "s", 1))
    rows += [(6000, "½ ² ① Ⅷ 12", "aa", "s", 1), (6001, long_prose(r, 20000), None, "s", 1), (6002, "<|endoftext|> a <|startoftext|>b", None, "s", 1), (6003, "Σας ﬁ 10,000²", None, "s", 1)]
    rows += [(5001, rows[-200][1], "cc", "s", 1)]  # an id with two labelled rows
    labels = [(5000 + i, i % 2, 0) for i in range(240)] + [(5002, None, None), (None, 1, 0)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows, items


def types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_op2(spark, tables):
    at, rows, _ = tables
    df = OUT["op2_virtual_slots"](spark, at)
    kinds = types(df)
    assert {k: kinds[k] for k in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")} == {"size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    got, by = df.collect(), collections.defaultdict(list)
    assert collections.Counter((x.doc_id, x.size, x.text_crc32) for x in got) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    for x in got:
        by[x.shard].append(x)
        assert x.law == "bytes" and x.grown_shard is None and 0 <= x.shard < 16
    assert all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values())
    loads = {k: sum(x.size for x in by[k]) for k in range(16)}
    heavy, slots = max(loads, key=loads.get), collections.Counter()
    for x in by[heavy]:
        slots[x.vslot] += x.size
    assert max(loads.values()) - min(loads.values()) <= min(slots.values())  # moving any slot would not even them out


def test_op3(spark, tables):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    at, rows, _ = tables
    whole = Tokenizer.from_file(str(public.path(packing.TOKENIZER)))
    df = OUT["op3_karmarkar_karp"](spark, at)
    kinds = types(df)
    assert all(kinds[k] == "bigint" for k in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
    got, seq = df.collect(), collections.defaultdict(list)
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        lo = 0
        for n in packing.cuts(len(ids)):
            want[i, lo, n, zlib.crc32(ids[lo : lo + n].tobytes()), len(ids)] += 1
            lo += n
    assert collections.Counter((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in got) == want  # every id in one piece
    for x in got:
        seq[x.sequence_id].append((x.offset, x.length))
    for s in seq.values():
        lo = 0
        for off, n in sorted(s):
            assert off == lo
            lo += n
        assert lo <= 2048


def test_op4(spark, tables, monkeypatch):
    at, rows, _ = tables
    df = OUT["op4_ftrl"](spark, at)
    assert {k: v for k, v in types(df).items() if k != "doc_id"} == {"held_out": "boolean", "score": "double", "predicted": "int"}
    got = df.collect()
    assert len(got) == len(rows) and all(x.held_out == held(x.doc_id) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got)
    good = {x.doc_id: x.score for x in got if x.doc_id and 5000 <= x.doc_id < 5240 and x.held_out}
    assert np.mean([(good[i] > 0.5) == bool(i % 2) for i in good]) > 0.95 and len(good) > 30
    scores = collections.defaultdict(set)
    texts = collections.defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(t)
    for x in got:
        if len(texts[x.doc_id]) == 1:
            scores[texts[x.doc_id][0] or ""].add(x.score)
    assert all(len(v) == 1 for v in scores.values())  # equal texts, null and empty ones too, score alike


def test_ftrl_against_one_weight_at_a_time():
    r = random.Random(2)
    rows = [(quality.features(prose(r, 12) + (" good" if i % 2 else " bad")), i % 2) for i in range(40)]
    model = quality.train(lambda: [(f[0], f[1], y) for f, y in rows], epochs=2)
    alpha, beta, l1, l2, z, n, zb, nb = 0.5, 1.0, 0.02, 0.1, collections.defaultdict(float), collections.defaultdict(float), 0.0, 0.0
    weight = lambda z, n: 0.0 if abs(z) <= l1 else -(z - (l1 if z > 0 else -l1)) / ((beta + n**0.5) / alpha + l2)
    for _ in range(2):
        for (ids, values), y in rows:
            bias = -zb / ((beta + nb**0.5) / alpha + l2)
            w = {i: weight(z[i], n[i]) for i in ids.tolist()}
            p = 1 / (1 + np.exp(-(sum(w[i] * v for i, v in zip(ids.tolist(), values.tolist(), strict=True)) + bias)))
            for i, v in zip(ids.tolist(), values.tolist(), strict=True):
                g = (p - y) * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
            zb += p - y - ((nb + (p - y) ** 2) ** 0.5 - nb**0.5) / alpha * bias
            nb += (p - y) ** 2
    assert all(abs(model.weights[i] - weight(z[i], n[i])) < 1e-4 for i in z) and np.count_nonzero(model.weights) <= len(z)


def brute_leaks(rows, items):
    """All items against all texts: the best share of an item's words in order within any stretch of its length and a half."""
    found = set()
    for i, t, *_ in rows:
        text = decontamination.words(t)
        for k, said in items:
            item = decontamination.words(said)
            if not item:
                continue
            wide = len(item) + len(item) // 4
            last = decontamination.words(said.split(". ")[-1])
            for lo in range(0, max(1, len(text) - len(item) // 2)):
                near = text[lo : lo + wide]
                if len(set(near) & set(item)) < 0.5 * len(set(item)):
                    continue
                share = decontamination.common_subsequence(item, near) / len(item)
                if share >= decontamination.LCS or share >= decontamination.LCS_ANSWER and decontamination.common_subsequence(last, near) == len(last):
                    found.add((i, k))
                    break
    return found


def test_op5(spark, tables):
    at, rows, items = tables
    got = {(x.doc_id, x.item_id) for x in OUT["op5_latent_semantic"](spark, at).collect()}
    want = brute_leaks(rows, items)
    assert len(want) >= 30 and want == got


def test_op8(spark, tables):
    at, rows, _ = tables
    df = OUT["op8_subword_embeddings"](spark, at)
    kinds = types(df)
    assert (kinds["held_out"], kinds["lang_pred"], kinds["score"]) == ("boolean", "string", "double")
    got = df.collect()
    assert len(got) == len(rows) and all(x.held_out == held(x.doc_id) and 0 <= x.score <= 1 and x.lang_pred in ("aa", "bb", "cc", "und") for x in got)
    want = {i: lang for i, _, lang, *_ in rows if i and 5000 <= i < 5240 and i != 5001}
    told = [x.lang_pred == want[x.doc_id] for x in got if x.doc_id in want and x.held_out]
    assert np.mean(told) == 1 and len(told) > 30
    unknown = collections.Counter(i for i, t, *_ in rows if not any(c.isalpha() for c in t or ""))
    assert collections.Counter(x.doc_id for x in got if x.lang_pred == "und") == unknown and unknown[6000] == 1


def test_probabilities_against_one_subword_at_a_time():
    r = np.random.default_rng(1)
    m = language_id.Model(["a", "b", "c"], r.normal(size=(language_id.BUCKETS, 3)).astype(np.float32), r.normal(size=3), 1.7, 0.0)
    for text in ("one two", "É", "x " * 40, "mélange of 12 ½ words"):
        data = language_id.letters(text)
        total, n = np.zeros(3), 0
        for size in language_id.GRAMS:
            for i in range(len(data) - size + 1):
                gram = data[i : i + size]
                if b" " in gram[1:-1] or size == 2 and gram == b"  ":
                    continue
                ids, _ = language_id.buckets(np.frombuffer(data, np.uint8))
                total += m.logits[ids[size - 2][i]]
                n += 1
        z = (total / n + m.bias) / m.temperature
        assert np.allclose(m.probabilities([data])[0], np.exp(z - z.max()) / np.exp(z - z.max()).sum(), atol=1e-4)


def test_op9(spark, tables):
    at, rows, _ = tables
    df = OUT["op9_hyperminhash"](spark, at)
    got = df.collect()
    assert types(df)["n_shingles"] == "bigint" and types(df)["kept"] == "boolean"
    assert collections.Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute_components([(i, t) for i, t, *_ in rows], 3, 85)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_op10(spark, tables):
    at, rows, _ = tables
    df = OUT["op10_bwt_expansion"](spark, at)
    assert [types(df)[k] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")] == ["bigint"] * 3 + ["string"]
    want = collections.Counter((x[0], n, gone, runs, hashlib.sha256(kept).hexdigest()) for x, (n, gone, runs, kept) in zip(rows, brute_removed([x[1] for x in rows], 200), strict=True))
    assert collections.Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in df.collect()) == want
