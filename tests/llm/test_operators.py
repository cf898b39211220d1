"""The ten operators and the pipeline against brute force, on small tables with awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuplewise.llm import decontamination, fingerprints, html_extraction, language_id, licenses, near_dedup, packing, quality, sharding, suffix_dedup
from tuplewise.llm._common import held_out, summed
from tuplewise.llm.graphs import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ka ke lo mi nu pa ri so tu ve".split() for b in "rin dal mon tes gul fa zi".split()]


def prose(r, n):
    return " ".join(r.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def awkward():
    """Rows with nulls, empty and very long texts, copies, near copies, repeated rows and shared passages."""
    r = random.Random(7)
    base, passage = [prose(r, 60) for _ in range(12)], prose(r, 45)
    near = base[0].split()
    near[30] = "changed"
    texts = [*base, base[1], base[1], " ".join(near), base[2] + " " + passage, base[3][:100] + passage, None, "", " \n\t ", "one", "one", "Two words", "two WORDS", prose(r, 4000), "ab" * 300, "é" * 250, "日本語 テキスト", "x" * 200]
    rows = [(i, t, r.choice(["en", "fr", None]), None if i % 5 else "s", len(t) if t else None) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, base[5], "en", "s", 1), (None, None, None, None, None), (3, "another text of id three", "en", "s", 24)]


@pytest.fixture(scope="module")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA).withColumn("size", F.lit("clash")).withColumn("component_id", F.lit("clash")).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sums_of_arrays(spark):
    parts = spark.range(150).select((F.col("id") % 2).alias("block"), F.col("id").alias("part"), F.lit(np.arange(4).astype("<i8").tobytes()).alias("data"))
    got = {r.block: np.frombuffer(r["data"], "<i8").tolist() for r in summed(parts, "<i8", fan_in=4).collect()}
    assert got == {0: [0, 75, 150, 225], 1: [0, 75, 150, 225]}


def test_held_out(spark):
    got = {r.doc_id: r.h for r in spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}


# 1

PAGE = "<html><head><title>t</title><script>var a='</p>';</script></head><body><div class='top'>Site {m}</div><nav><a>Home</a></nav><div id='c1'><h1>H {i}</h1><p>A&amp;B {t}<p>  second\n line <b>bold</b><br>x</div><div class='comments'><p>nice</div><aside>s</aside><footer>f {m}</footer>"


def test_html(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(m=i % 2, i=i, t=f"word{i} " * 8)) for i in range(12)] + [(90, None, None), (91, "::bad[", ""), (92, "http://alone.org", "just text"), (92, "http://alone.org", "just text"), (93, "http://x.org", "<p>open <b>not closed")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash"))
    out = html_extraction.extract(df).collect()
    got = collections.defaultdict(list)
    for r in out:
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    for i in range(12):
        assert got[i] == [f"H {i}\nA&B {' '.join([f'word{i}'] * 8)}\nsecond line bold x"]
    assert got[90] == [""] and got[91] == [""] and got[92] == ["just text"] * 2 and got[93] == ["open not closed"]
    assert html_extraction.extract(df.limit(0)).count() == 0


def template_of(spark, pages):
    df = spark.createDataFrame([(i, "http://h.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string").withColumn("host", F.lit("h.org"))
    table = html_extraction.parsed(df, "url", "html", ("page_id",))
    x = html_extraction.templates(table, html_extraction.classes(table)).first()
    return html_extraction.Template(x.n_pages, [(c["class"], c.order, c.repeats, c["keys"]) for c in x.classes or ()], set(x.known or ()), {r.k: (r.chars, r.links, r.varies) for r in x.slots}, {r.k: r.times for r in x.roles or ()})


def test_classes_have_equal_occurrence_vectors_and_one_order(spark):
    """Against brute force: vectors of counts on all pages, built in full."""
    r = random.Random(5)
    pages = []
    for i in range(7):
        rows = "".join(f"<li><a>{prose(r, 1)}</a></li>" for _ in range(r.randint(1, 4)))
        swap = ["<i></i><section>s</section>", "<table></table>"]
        pages.append(f"<div><ul>{rows}</ul><h1>{prose(r, 3)}</h1>{'<aside>x</aside>' if i < 3 else ''}" + "".join(f"<p>{prose(r, 5)}</p>" for _ in range(r.randint(1, 5))) + "".join(swap[:: 1 if i % 2 else -1]) + "<footer>Site of all</footer></div>")
    t = template_of(spark, pages)
    parsed = [html_extraction.parse(p) for p in pages]
    every = {k for p in parsed for k in p.keys if k}
    vectors = collections.defaultdict(set)
    for k in every:
        vectors[tuple(p.keys.count(k) for p in parsed)].add(k)
    want = set()
    for v, keys in vectors.items():
        there = [x for x in v if x]
        seen = collections.Counter(tuple(k for k in p.keys if k in keys) for p in parsed)
        cut = lambda s: len(s) % len(keys) == 0 and len(set(s[: len(keys)])) == len(keys) and s == s[: len(keys)] * (len(s) // len(keys))
        orders = collections.Counter()
        for s, n in seen.items():
            if s and cut(s):
                orders[s[: len(keys)]] += n
        if len(there) >= 3.5 and (2 * len(keys) >= 3 and (len(keys) > 1 or max(v) == 1)) and orders and max(orders.values()) >= 0.5 * len(there):
            want.add(frozenset(keys))
    assert {frozenset(keys) for _, _, _, keys in t.classes} == want and len(want) == 2  # the elements once on all pages, and <li><a>
    p = parsed[0]
    words = {w for at, text in zip(p.at, p.texts, strict=True) for w in html_extraction.text_tokens(p, at, text, True) if text in ("Site of all", "s")}
    assert t.texts == words


def test_template_order_bounds_slots():
    H = html_extraction
    page = H.parse("<div><h1>a</h1><section>b</section></div>")
    keys = page.keys[1:]
    ordered = H.Template(5, [(keys[0], H.orders(page, H.Template(5, [(keys[0], 0, False, keys)]))[keys[0]], False, keys)])
    assert H.bounds(page, ordered) == [True] * 4
    other = H.parse("<div><section>b</section><h1>a</h1></div>")
    assert H.bounds(other, ordered) == [True, False, False, False]  # the class is not in its order here


def test_attributes_with_quotes_and_malformed_ones():
    H = html_extraction
    text = lambda x: H.parse(x).texts
    assert text("<article><p title=it's>Hello there</p><p>second don't</p></article>") == ["Hello there", "second don't"]
    assert text("<p title='a > b' data-x=\"c > 'd'\">in</p><p title=\"open>out</p><b class = x' y>z</b>") == ["in", "out", "z"]
    assert H.parse("<div class='a'id=b hidden>x</div>").flags[1] & H.HINTED


NAMELESS = "<div><div>Site {m}</div><div><ul>{menu}</ul></div><div>{ad}</div><div><h1>{title}</h1>{body}</div><div>{records}</div><div>of {m} {ad}</div></div>"


def test_without_names_the_template_decides(spark):
    """Pages of one host without helpful tags or names; on three the article is shorter than what surrounds it."""
    r = random.Random(21)
    rows, want = [], {}
    for i in range(12):
        body = [prose(r, r.randint(20, 60)) for _ in range(r.randint(2, 6))] if i % 4 else [prose(r, 3)]
        title = prose(r, 4)
        menu = "".join(f"<li><a href=/{w}>{w}</a></li>" for w in r.sample(WORDS, r.randint(3, 6)))
        records = "".join(f"<div><span>{w}</span><p>{prose(r, 7)}</p></div>" for w in r.sample(WORDS, r.randint(1, 3)))
        rows.append((i, "http://h.org/", NAMELESS.format(m="h.org", menu=menu, ad=prose(r, 5), title=title, body="".join(f"<p>{x}</p>" for x in body), records=records)))
        want[i] = "\n".join([title, *body])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x.page_id: x.text for x in html_extraction.extract(df).collect()} == want
    alone = {i: html_extraction.main_text(html_extraction.parse(h), html_extraction.Template()) for i, _, h in rows}
    assert any(alone[i] != want[i] for i in alone)  # each page on its own does not tell


def test_very_long_and_copied_pages(spark):
    r = random.Random(22)
    long = [prose(r, 3000) for _ in range(7)]
    rows = [(0, "http://a.org/", "<div class=top>A</div><div>" + "".join(f"<p>{x}</p>" for x in long) + "</div>")] + [(k, "http://c.org/", f"<div class=menu>M</div><div><h1>T</h1><p>{long[0]}</p></div>") for k in (1, 2, 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x.page_id: x.text for x in html_extraction.extract(df).collect()} == {0: "\n".join(long), **dict.fromkeys((1, 2, 3), "T\n" + long[0])}


def test_main_slot_holds_all_that_is_not_set_aside(spark):
    def texts(pages):
        df = spark.createDataFrame([(i, "http://h.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
        return {r.page_id: r.text for r in html_extraction.extract(df).collect()}

    p = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    few = ["<div><h1>T</h1><p>" + p(0, 70) + "</p><p>" + p(1, 30) + "</p></div>", "<main><h1>T</h1><article><p>" + p(2, 9) + "</p></article></main>"]
    assert texts(few) == {0: f"T\n{p(0, 70)}\n{p(1, 30)}", 1: f"T\n{p(2, 9)}"}
    lead = [f"<div class=top>Site of all</div><div id=c><div class=lead>{p(2 * i, 30)}</div><div class=text>{p(2 * i + 1, 70)}</div></div><footer>f</footer>" for i in range(6)]
    assert texts(lead) == {i: f"{p(2 * i, 30)}\n{p(2 * i + 1, 70)}" for i in range(6)}
    one = [f"<div id=c><h2>Always this</h2><p>{p(i, 70)}</p></div>" for i in range(6)]  # a single paragraph is no slot
    assert texts(one) == {i: f"Always this\n{p(i, 70)}" for i in range(6)}


def test_names_and_template_text_in_the_main_slot(spark):
    def texts(pages):
        df = spark.createDataFrame([(i, "http://h.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
        return {r.page_id: r.text for r in html_extraction.extract(df).collect()}

    p = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    page = "<div class='container right-side'><h1>T{i}</h1><div class=menu>m{i}</div><p>{t}</p><div><p>Subscribe to our letter</div></div><div class=comments><p>nice {i}</div>"
    assert texts([page.format(i=i, t=p(i, 50)) for i in range(6)]) == {i: f"T{i}\n{p(i, 50)}" for i in range(6)}
    assert texts(["<div class=header>Site</div><div class='box side'><p>" + p(i, 50) + "</p></div>" for i in range(2)]) == {i: p(i, 50) for i in range(2)}
    assert texts(["<div><p>" + p(0, 9) + "</p></div><div class=comments><p>" + p(1, 50) + "</p></div>"]) == {0: p(0, 9)}


# 2


def test_sharding(docs, none, awkward):
    out, slots = sharding.shard(docs, 4, n_slots=64)
    got = out.collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in awkward)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and slots.version == 1
    assert sharding.shard(none)[0].count() == 0


def test_slot_maps():
    r = random.Random(1)
    size = [int(r.paretovariate(1.2) * 100) for _ in range(512)]
    even = sharding.SlotMap.initial(512, 8).rebalanced(size)
    load = lambda m, k: [sum(s for s, o in zip(size, m.shard, strict=True) if o == i) for i in range(k)]
    loads = load(even, 8)
    heavy = max(range(8), key=loads.__getitem__)
    assert max(loads) - min(loads) <= min(s for s, o in zip(size, even.shard, strict=True) if o == heavy)
    more = even.grown(size)
    moved = [(a, b) for a, b in zip(even.shard, more.shard, strict=True) if a != b]
    assert moved and all(b == 8 for _, b in moved) and more.version == 2 and {v for v, b in zip(more.edited, more.shard, strict=True) if b == 8} == {2}
    assert even.rebalanced(size).shard == even.shard


def test_a_stored_slot_map_is_loaded_and_edited(spark, tmp_path):
    at, r = str(tmp_path / "map"), random.Random(3)
    day = lambda n, w: spark.createDataFrame([(i, prose(r, r.randint(1, w))) for i in range(n)], "doc_id long, text string")
    assert sharding.SlotMap.load(spark, at) is None
    first = day(300, 20)
    _, one = sharding.shard(first, 4, n_slots=64, map_path=at)
    assert sharding.SlotMap.load(spark, at) == one and one.version == 1 and sharding.SlotMap.load(spark, at, 0).shard == [i % 4 for i in range(64)]
    _, same = sharding.shard(first, 4, n_slots=64, map_path=at)
    assert same == one  # nothing to even out
    out, two = sharding.shard(day(400, 90), 4, n_slots=64, map_path=at)
    assert two.version == 2 and sharding.SlotMap.load(spark, at) == two and {x.map_version for x in out.select("map_version").distinct().collect()} == {2}
    moved = [i for i in range(64) if one.shard[i] != two.shard[i]]
    assert 0 < len(moved) < 64 and all((two.edited[i] == 2) == (i in moved) for i in range(64))
    with pytest.raises(Exception, match="(?i)exist"):
        two.store(spark, at)
    with pytest.raises(ValueError, match="4 shards"):
        sharding.shard(first, 5, n_slots=64, map_path=at)


def test_many_equal_rows_spread_over_shards(spark):
    df = spark.createDataFrame([(7, "x" * 100)] * 5000 + [(i, "y" * (i % 60)) for i in range(498)], "doc_id long, text string")
    by = collections.Counter()
    for x in sharding.shard(df)[0].collect():
        by[x.shard] += x.size
    assert max(by.values()) - min(by.values()) < 0.01 * sum(by.values()) / 16


# 3


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return str(public.path(packing.TOKENIZER))


def test_packing(docs, none, awkward):
    from tokenizers import Tokenizer

    path = tokenizer()
    whole = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, t, *_ in awkward:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want[i, zlib.crc32(ids.tobytes()), len(ids)] += 1
    rows = packing.pack(docs, path, window=256).collect()
    assert {(r.doc_id, r.doc_tokens) for r in rows} == {(i, n) for i, _, n in want}
    seq = collections.defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
    for s in seq.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 256
    assert sum(r.length for r in rows) == sum(n * c for (_, _, n), c in want.items())
    for (i, crc, n), c in want.items():  # documents of one piece show their whole checksum
        if n < 48:
            assert sum(r.doc_id == i and r.ids_crc32 == crc for r in rows) >= c
    assert packing.pack(none, path).count() == 0


def test_run_tokens_equal_the_tokenizer():
    t = packing.RunTokens(tokenizer(), most=50)
    r = random.Random(3)
    for x in ["a <|endoftext|><|startoftext|>b <|EndOfText|>", "Σας ΟΔΟΣ İstanbul it's WE'LL 10,000²", "<|endoftext|> a\x1fb\x00c", "Å é ́x ﬁ ½ ٣", "👍🏽 日本語", "'s'S's", "", prose(r, 200)]:
        assert t.ids(x) == np.asarray(t.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def test_differencing():
    r = random.Random(2)
    sizes = [r.randint(1, 255) for _ in range(300)]
    groups = packing.difference(sizes, 20)
    assert sorted(i for g in groups for i in g) == list(range(300))
    sums = [sum(sizes[i] for i in g) for g in groups]
    assert max(sums) - min(sums) <= 3
    packed = packing.windows([*sizes, 256, 256], 256)
    assert sorted(i for g in packed for i in g) == list(range(302)) and max(sum(([*sizes, 256, 256])[i] for i in g) for g in packed) <= 256
    assert packing.windows([], 256) == [] and sum(packing.cuts(5000)) == 5000 and packing.cuts(1) == [1]


# 4


def test_quality(spark, docs, none):
    r = random.Random(4)
    rows = [(i, prose(r, 60) if i % 3 else " ".join(f"{w}%%%" for w in r.choices(WORDS, k=60)), int(i % 3 > 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(df.where("doc_id < 300"))
    got = {x.doc_id: x.score for x in quality.scored(df.where("doc_id >= 300"), model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(i % 3) for i in got]) > 0.97
    odd = quality.scored(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= x.score <= 1 for x in odd)
    assert quality.fit(none.withColumn("quality", F.lit(1))).score("x") == 0.5 and quality.scored(none, model).count() == 0


def test_quality_uses_all_features_of_long_texts(spark, monkeypatch):
    long = [" ".join(f"{a}{i}" for i in range(4000)) for a in "uv"]
    rows = [(i, long[i % 2], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(3)
    whole = quality.fit(df)
    monkeypatch.setattr(quality, "HELD", 200_000)
    for model in (whole, quality.fit(df)):
        assert model.score(long[0]) < 0.3 and model.score(long[1]) > 0.7
        ids = set(quality.features(long[0])[0]) ^ set(quality.features(long[1])[0])
        assert len(ids) > 10_000 and np.mean(model.weights[list(ids)] != 0) > 0.99


# 5


def test_common_subsequence():
    r = random.Random(6)
    for _ in range(60):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 15))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
        assert decontamination.common_subsequence(a, b) == row[-1]


def test_decontamination(spark, none):
    r = random.Random(9)
    vocabulary = [a + b for a in WORDS for b in WORDS]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(i, text(n)) for i, n in enumerate([16, 25, 40, 59, 150, 33])] + [(50, None), (51, ""), (52, "...")]
    rows, leaked = [], set()
    for i in range(300):
        t = text(r.randint(20, 300)).split()
        if i % 10 == 0:
            k = i // 10 % 6
            said = items[k][1].split()
            if i % 20 == 0:  # a paraphrase: a tenth of the words differ
                for j in range(0, len(said), 10):
                    said[j] = r.choice(vocabulary)
            at = r.randint(0, len(t))
            t[at:at] = said
            leaked.add((i, k))
        rows.append((i, " ".join(t)))
    rows += [(700, None), (701, ""), (0, "of the same id"), (None, items[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.leaks(df, bench).collect()}
    assert got - {(None, 0)} == leaked and (None, 0) in got
    assert decontamination.leaks(none, bench).count() == 0 and decontamination.leaks(df, bench.limit(0)).count() == 0


def test_short_and_edited_items_are_candidates(spark):
    r = random.Random(10)
    vocabulary = [a + b for a in WORDS for b in WORDS]
    common = r.choices(vocabulary, k=40)
    word = lambda: r.choice(common) if r.random() < 0.5 else r.choice(vocabulary)
    items = [[word() for _ in range(n)] for n in (1, 4, 5, 6, 8, 10, 15, 20, 40, 64, 65, 100) for _ in range(10)]
    rows, planted = [], set()
    for k, item in enumerate(items):
        for share in (1, 0.8, 0.65):
            kept = set(r.sample(range(len(item)), -(-len(item) * round(100 * share) // 100)))
            said, t = [w if j in kept else "other" + r.choice(vocabulary) for j, w in enumerate(item)], [word() for _ in range(r.randint(0, 300))]
            at = r.randint(0, len(t))
            planted.add((len(rows), k))
            rows.append((len(rows), " ".join([*t[:at], *said, *t[at:]])))
    texts = [" ".join(x) for x in items]
    df = spark.createDataFrame([(i, decontamination.columns(t).tobytes()) for i, t in rows], "id long, columns binary")
    space = decontamination.fit(df)
    assert planted <= {(x.id, x.item) for x in decontamination.candidates(df, space, decontamination.queries(texts, space)).collect()}
    few = decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, t, t.split()[0]) for k, t in enumerate(texts)], "item_id long, text string, answer string"), answer_col="answer")
    assert {(i, k) for i, k in planted if (i % 3 == 0)} <= {(x.doc_id, x.item_id) for x in few.collect()}


# 6


def test_licenses(spark, docs, none):
    mit = dict((b, a) for a, b in licenses.KNOWN)
    text = next(b for a, b in licenses.KNOWN if a == "MIT" and "\n" in b)
    rows = [(1, "some text\nreleased under the  mit LICENCE\nmore"), (2, "Copyright (c) 2020 Ann\n" + text.upper().replace(",", " ;")), (3, "Released under the MIT Licence, or not."), (4, None), (5, ""), (1, "x")]
    got = collections.defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].append((r.license, r.n_lines, r.licenses))
    assert sorted(got[1], key=str) == [(None, 0, ""), (None, 1, "MIT")] and got[2][0][0] == "MIT" and got[3] == got[4] == got[5] == [(None, 0, "")] and mit
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(none).count() == 0


def canonical_license(text):
    """The normalisation word by word."""
    import regex

    lines = [x.lower() for x in text.split("\n")]
    words = " ".join(regex.sub(r"[^\p{L}\p{N}]+", " ", x) for x in lines if not re.search(licenses.COPYRIGHT, x)).split()
    for a, b in licenses.EQUIVALENT:
        old, i = a.split(), 0
        while i < len(words):
            if words[i : i + len(old)] == old:
                words[i : i + len(old)] = b.split()
            i += 1
    return " ".join(words)


def test_license_texts_word_by_word(spark):
    wrapped = "Permission is hereby granted,\nprovided that the\ncopyright notice of the Copyright\nOwner is kept.\nCopyright (c) 2021 X\n(C) 1999-2001 Y\n# Copyright [yyyy] [name]\nAll rights reserved.\nall rights reserved by nobody"
    texts = ["Licence licence LICENCE, licence", "per cent per cent sub-licence sub licence", "copyright\nowner copyright owner", wrapped, "", "\n\n", "Copyright 2020", "whilst", "é È ß", *[b for _, b in licenses.KNOWN]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.c for r in df.select("doc_id", licenses.canonical(F.col("text")).alias("c")).collect()}
    assert [got[i] for i in range(len(texts))] == [canonical_license(t) for t in texts]
    assert "copyright notice of the copyright holder is kept all rights reserved by nobody" in got[3]


def test_long_licenses(spark, tmp_path):
    import pathlib

    import duckdb

    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0-only": "GPL-2", "GPL-3.0-only": "GPL-3", "LGPL-2.1-only": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    there = {k: pathlib.Path("/usr/share/common-licenses", f) for k, f in files.items()}
    found = [(k, p.read_text()) for k, p in there.items() if p.exists()]
    rows = [(i, "Copyright (C) 2024 Ann\n" + t.upper().replace("\n\n", "\n \n")) for i, (_, t) in enumerate(found)] + [(90, None), (91, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in licenses.scan(df).select("doc_id", "license", "n_lines", "licenses").collect())
    assert [r[1] for r in got[: len(found)]] == [k for k, _ in found]
    duckdb.sql(f"create or replace temp view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(duckdb.sql(licenses.oracle()).fetchall()) == got


# 7


def test_fingerprints(spark, awkward, tmp_path, none):
    df = spark.createDataFrame(awkward, SCHEMA).where("doc_id is not null").dropDuplicates(["doc_id"])
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in fingerprints.op7_canonical_digest(spark, str(tmp_path)).collect()}
    rows = sorted((r.doc_id, r.text or "") for r in df.collect())
    for k, (i, t) in enumerate(rows):
        n, after = len(t) // 4, rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - n] + after[:n]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert got[i].near_edited == float(got[i].fingerprint == got[i].edited_fingerprint)
        assert got[i].near_next == float(got[i].fingerprint == got[rows[(k + 1) % len(rows)][0]].fingerprint)
    same = collections.defaultdict(set)
    for i, t in rows:
        same[" ".join(t.lower().split())].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in same.values()) and len({f for v in same.values() for f in v}) == len(same)
    none.write.parquet(str(tmp_path / "none/documents.parquet"))
    assert fingerprints.op7_canonical_digest(spark, str(tmp_path / "none")).count() == 0


def test_composition(spark):
    texts = ["é", "é", "Å", "Å", "Å", "ß", "SS", "a  b", "A B", "ế", "ế"]
    got = [r.c for r in fingerprints.normalised(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "c").collect()]
    assert got[0] == got[1] and got[2] == got[3] == got[4] and got[7] == got[8] and got[9] == got[10] and got[5] == got[6] and len(set(got)) == 5


def test_normalisation_against_unicode_data(spark):
    import unicodedata

    r = random.Random(15)
    marks = [c for c in map(chr, range(0x300, 0x370)) if unicodedata.combining(c)] + ["\u05b0", "\u0591", "\u093c", "\u0bbe", "\u09be", "\u3099", "\U0001d165", "\U000110ba"]
    bases = [*"aeioucAEOU<=", "\u1ea1", "\u1ec7", "\u0958", "\u2126", "\u212b", "\u0390", "\u01e0", "\ufb1d", "\u0bc6", "\u09c7", "\u304b", "\U00011099", "\U0001f600", "\u1112", "\u1161", "\u11ab", "\ud55c", "\ud558", " ", "\n", "\u1100", "\u11a8", "\U0001d157"]
    texts = ["".join(r.choice(bases) + "".join(r.choices(marks, k=r.choice([0, 0, 1, 2, 3]))) for _ in range(r.randint(1, 12))) for _ in range(1500)]
    texts += ["\u00e2\u0323", "\u1ead", "\u1112\u1161\u11ab", "\ud55c", "a" + "\u0323\u0302" * 40, "\u0301x", "", unicodedata.normalize("NFD", "\ud55c\uae00 \u1ec7\u00e9\u00fc\U0001f600" * 30)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {x.i: x.c for x in df.select("i", fingerprints.composed(F.col("t")).alias("c")).collect()}
    assert [got[i] for i in range(len(texts))] == [unicodedata.normalize("NFC", t) for t in texts]


def test_case_folding(spark):
    every = [chr(c) for c in range(0x20, 0x1f000) if not 0xd800 <= c < 0xe000 and chr(c).casefold() != chr(c)]
    words = ["\u00df", "SS", "\u039f\u0394\u039f\u03a3", "\u03bf\u03b4\u03bf\u03c2", "\ufb03x", "\u0130", "\u0131", "I"]
    df = spark.createDataFrame(list(enumerate([*words, *every])), "i long, t string")
    folded = lambda df: {x.t: x.a for x in fingerprints.normalised(df, "t", "a", fingerprints.STEPS[1:3]).collect()}
    fold = folded(df)
    again = folded(spark.createDataFrame([(t.casefold(),) for t in fold], "t string"))
    assert all(a == again[t.casefold()] for t, a in fold.items())  # what folds alike for Unicode folds alike here
    assert fold["\u00df"] == fold["SS"] and fold["\u0131"] != fold["I"] and fold[words[2]] == fold[words[3]]


def test_next_rows_over_blocks(spark):
    ids = [5, 1, 9, 7, 3, 3, 100]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    got = fingerprints.with_next(df, "doc_id", ["text"], 5).collect()
    order = sorted((i, f"t{k}") for k, i in enumerate(ids))
    assert {(r.doc_id, r.text): r.next.text for r in got} == {o: order[(k + 1) % len(order)][1] for k, o in enumerate(order)}


# 8


def test_language_id(spark, docs, none):
    r = random.Random(8)
    sets = {"aa": "abcde", "bb": "fghij", "cc": "eéèxyz"}
    word = lambda s: "".join(r.choices(s, k=r.randint(2, 7)))
    rows = [(i, " ".join(word(sets[lang]) for _ in range(30)), lang) for i, lang in enumerate(r.choices(list(sets), k=300))] + [(900, None, "aa"), (901, "123 !!", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.where("doc_id < 200 or doc_id >= 900"))
    out = {x.doc_id: x for x in language_id.identify(df, model).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows[:300]) and out[900].lang_pred == out[901].lang_pred == "und" and out[900].lang_rejected
    odd = language_id.identify(docs, model).collect()
    assert all((x.lang_pred == "und") == (not re.search(r"[^\W\d_]", x.text or "")) for x in odd) and len(odd) == docs.count()
    assert language_id.identify(none, model).count() == 0 and language_id.fit(none).languages == []


def test_probabilities_of_long_texts_do_not_depend_on_batches(monkeypatch):
    r = random.Random(1)
    texts = [language_id.letters(prose(r, n)) for n in (3, 500, 1, 80)]
    m = language_id.Model(["a", "b"], np.random.default_rng(0).normal(size=(language_id.BUCKETS, 2)).astype(np.float32), np.zeros(2), 1.0, 0.0)
    whole = [m.probabilities([t])[0] for t in texts]
    monkeypatch.setattr(language_id, "_CHUNK", 97)
    assert np.allclose(m.probabilities(texts), whole, atol=1e-4)


# 9


def brute_components(rows, words, percent):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return collections.Counter((i, len(sets[k]), least.get(root(k))) for k, (i, _) in enumerate(rows))


def test_components(spark):
    r = random.Random(8)
    path = list(range(100, 140))
    r.shuffle(path)
    links = [*zip(path, path[1:]), *((7, x) for x in range(200, 230)), (3, 2), (2, 3), (5, 5), *((r.randrange(300, 360), r.randrange(300, 360)) for _ in range(45))]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)} and components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, none, awkward, words, percent):
    r = random.Random(11)
    base, more = prose(r, 120).split(), []
    for i in range(60):  # a large group of copies with none to many changes
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6, 9])):
            w[r.randrange(120)] = f"new{r.random()}"
        more.append((1000 + i, " ".join(w), "en", "s", 1))
    df = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, SCHEMA)).withColumn("registers", F.lit("clash"))
    got = collections.Counter((x.doc_id, x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(df, words, percent).collect())
    rows = [(i, t) for i, t, *_ in [*awkward, *more]]
    assert got == brute_components(rows, words, percent)
    assert near_dedup.near_duplicates(none, words, percent).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_fronts_by_table_and_by_join(spark, percent):
    r = np.random.default_rng(5)
    pool = r.integers(0, 2**64, 200, np.uint64)
    rows = [(c, c % 3, np.unique(r.choice(pool, r.integers(1, 60))).tobytes()) for c in range(40)]
    df = spark.createDataFrame(rows, "c long, root long, data binary")
    counts = collections.Counter(x for _, _, d in rows for x in np.frombuffer(d, np.int64).tolist())
    want = set()
    for c, root, d in rows:
        own = np.frombuffer(d, np.int64).tolist()
        order = sorted(own, key=lambda x: (counts[x], x))
        want |= {(x, p + 1, len(own), c, root) for p, x in enumerate(order[: near_dedup._front(len(own), percent)])}
    assert {tuple(x) for x in near_dedup._few_by_join(df, percent).collect()} == want
    table = near_dedup._few_by_table(df, percent, 16).collect()
    assert len(table) == len(want) and {(x.c, x.p) for x in table} == {(c, p) for _, p, _, c, _ in want}


def test_near_duplicates_by_joined_counts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TABLE_BITS", 1)
    r = random.Random(12)
    base, rows = prose(r, 80).split(), []
    for i in range(50):
        w = list(base)
        for _ in range(r.randint(0, 8)):
            w[r.randrange(80)] = f"new{r.random()}"
        rows.append((i, " ".join(w)))
    got = collections.Counter((x.doc_id, x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect())
    assert got == brute_components(rows, 3, 85)


def shuffled(spark, run):
    """Bytes that ``run`` shuffles, and what it returns."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        every = sc.statusStore().executorList(False)
        return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))

    before = written()
    found = run()
    return written() - before, found


def test_joined_counts_shuffle_little_more_than_the_sets(spark, monkeypatch):
    r = np.random.default_rng(8)
    pool = r.integers(0, 2**64, 100_000, np.uint64)
    common = pool[:3]  # in all sets
    rows = [(c, c % 50, np.unique(np.append(common, r.choice(pool, r.integers(1, 800)))).tobytes()) for c in range(500)]
    counts = collections.Counter(x for _, _, d in rows for x in np.frombuffer(d, np.int64).tolist())
    want = set()
    for c, root, d in rows:
        own = sorted(np.frombuffer(d, np.int64).tolist(), key=lambda x: (counts[x], x))
        want |= {(x, p + 1, len(own), c, root) for p, x in enumerate(own[: near_dedup._front(len(own), 85)])}
    total = sum(len(d) for *_, d in rows) // 8
    df = spark.createDataFrame(rows, "c long, root long, data binary").repartition(3).localCheckpoint()
    sent, got = shuffled(spark, lambda: near_dedup._few_by_join(df, 85).collect())
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert sent < 2.5 * 8 * total  # as rows of shingles, 5 times their bytes
    monkeypatch.setattr(near_dedup, "CHUNK", 10_000)
    monkeypatch.setattr(near_dedup, "BLOCK", 20_000)
    assert {tuple(x) for x in near_dedup._few_by_join(df, 85, total).collect()} == want  # of many chunks and blocks


def test_sets_are_shuffled_once(spark):
    r = np.random.default_rng(9)
    texts = spark.createDataFrame([(i, " ".join(f"w{x}" for x in r.integers(0, 10**6, 300))) for i in range(300)], "doc_id long, text string").repartition(3).localCheckpoint()
    rows = near_dedup._profiles(texts, "doc_id", "text", 3, 25)
    nodes = rows.select("set_key", F.col("doc_id").alias("class_id"), "registers", F.col("doc_id").alias("c")).localCheckpoint()
    wanted = spark.range(300).select(F.col("id").alias("c"), (F.col("id") % 7).alias("root")).localCheckpoint()
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sent, sets = shuffled(spark, lambda: near_dedup._sets(wanted, texts, nodes, "doc_id", "text", 3))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    want = {x.doc_id: (x.doc_id % 7, near_dedup.shingles(x.text, 3).tobytes()) for x in texts.collect()}
    assert sent < 1.5 * sum(len(d) for _, d in want.values())
    assert {x.c: (x.root, x.data) for x in sets.collect()} == want


def test_registers_estimate():
    r = np.random.default_rng(3)
    a, b = r.integers(0, 2**64, 3000, np.uint64), r.integers(0, 2**64, 3000, np.uint64)
    a[:2000] = b[:2000]
    x = near_dedup.registers([a, b])
    assert abs(near_dedup.estimate(x[:1], x[1:])[0] - 0.5) < 0.16 and 0 < near_dedup.collision_rate() < 0.001


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_bands_bound_the_miss_at_the_bar(spark, percent):
    df = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    n = near_dedup.bands(percent)
    assert (1 - (percent / 100) ** near_dedup.ROWS) ** n < 1e-6 and near_dedup.bands(85) == 25
    row = near_dedup._profiles(df, "doc_id", "text", 3, n).first()
    assert len(row.registers) == 2 * n * near_dedup.ROWS


# 10


def brute_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        until, kept, gone, runs, was = 0, bytearray(), 0, 0, False
        for k in range(len(d)):
            if k + length <= len(d) and seen[d[k : k + length]] > 1:
                until = k + length
            if k < until:
                gone, runs, was = gone + 1, runs + (not was), True
            else:
                kept.append(d[k])
                was = False
        out.append((len(d), gone, runs, bytes(kept)))
    return out


def test_removal(docs, none, awkward):
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == collections.Counter((a[0], *b) for a, b in zip(awkward, brute_removed([a[1] for a in awkward], 200), strict=True))
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_removal_with_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 500)
    r = random.Random(13)
    passage = prose(r, 20)
    rows = [(i, prose(r, r.randint(0, 9)) + " " + passage + " " + prose(r, 5)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix_dedup.remove_repeats(df, length=40).collect()}
    assert [got[i] for i, _ in rows] == brute_removed([t for _, t in rows], 40)


@pytest.mark.parametrize("seed", range(4))
def test_walk_against_counting(seed):
    r = random.Random(seed)
    parts = [bytes(r.choices(b"abc", k=r.randint(0, 90))) for _ in range(4)]
    pieces = [b"".join(r.choice([r.choice(parts), bytes(r.choices(b"abcd", k=20))]) for _ in range(r.randint(0, 4))) for _ in range(10)] + [b"a" * 60, b"\0\xff" * 30]
    for length in (16, 33):
        seen = collections.Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
        for p, mask in zip(pieces, suffix_dedup.repeated(pieces, length), strict=True):
            assert mask.tolist() == [seen[p[i : i + length]] > 1 for i in range(len(p) - length + 1)]
            assert len(p) < length or suffix_dedup.contexts(np.frombuffer(p, np.uint8), length)[2].sum() == len(p) - length + 1


# the pipeline


def test_pipeline(spark, awkward, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    tokenizer()
    r = random.Random(17)
    vocabulary = [a + b for a in WORDS for b in WORDS]
    item = " ".join(r.choices(vocabulary, k=30))
    clean = [(2000 + i, " ".join(r.choices(vocabulary, k=50)), "en", "s", 1) for i in range(60)]
    leak = (5000, " ".join(r.choices(vocabulary, k=20)) + " " + item, "en", "s", 1)
    spark.createDataFrame([*awkward, *clean, leak], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"s{i}"))
        docs = spark.read.parquet(str(tmp_path / f"s{i}"))
        kept.append(collections.Counter(x.doc_id for x in docs.select("doc_id").collect()))
        assert i == 4 or docs.columns == corpus_pipeline.COLUMNS
    assert not kept[0][17] and not kept[0][18] and not kept[0][19]  # null, empty, white space
    assert kept[1][1] == 1 and not kept[1][12] and not kept[1][13]  # copies of 1
    assert kept[2] == kept[1]
    assert not kept[3][5000] and kept[2][5000] and kept[3] == kept[2] - collections.Counter({5000: 1})
    assert all(kept[3][c[0]] for c in clean) and set(kept[4]) == set(kept[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sum(kept[4].values())
