"""Each operator against a plain version of itself, on real rows and on odd ones."""

import random
import tracemalloc
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafwire.llm import decontaminate, hmm, html_text, licenses, packing, quality, secrets, simhash, substrings, suffix, vptree
from tests.llm import brute

PATH = public_tokenizers.path("word_bpe_49k.json")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


# neighbours


def vectors(spark, items):
    return spark.createDataFrame(items, "vec_id long, embedding array<float>, label int, score double")


def test_neighbours_exact_and_ties(spark):
    r = random.Random(1)
    items = [(i, [r.gauss(0, 1) for _ in range(8)], 0, 0.0) for i in range(300)]
    items += [(1000 + i, [1.0] * 8, 0, 0.0) for i in range(40)] + [(2000, None, 0, 0.0), (2050, [0.0] * 8, 0, 0.0), (2100, [float("nan")] * 8, 0, 0.0), (2150, [1.0, None] * 4, 0, 0.0), (None, [1.0] * 8, 0, 0.0), (1000, [1.0] * 8, 0, 0.0), (2200, [1.0, 2.0], 0, 0.0), (2201, [2.0, 4.0], 0, 0.0), (2250, [], 0, 0.0)]
    got = vptree.nearest(vectors(spark, items), F.col("vec_id") % 50 == 0, factor=1.0, shard_rows=64, block=3)
    fine = {i: np.array(v, np.float32).astype(float) for i, v, *_ in items if i is not None and v and all(x is not None for x in v) and np.isfinite(v).all() and np.any(v)}
    want = []
    for q, x in fine.items():
        if q % 50 == 0:
            near = sorted((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 12), i) for i, y in fine.items() if i != q and len(y) == len(x))[:5]
            want += [(q, k + 1, i) for k, (_, i) in enumerate(near)]
    assert rows(got, "query_id", "rank", "vec_id") == sorted(want, key=repr)


def test_neighbours_scaled_copies(spark):
    r = random.Random(2)
    base = [r.gauss(0, 1) for _ in range(8)]
    tied = [(0, base)] + [(i, [x * 2.0**e for x in base]) for i, e in zip(range(1, 13), r.sample(range(-20, 20), 12))]
    far = [(100 + i, [r.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    docs = spark.createDataFrame(tied + far, "vec_id long, embedding array<double>")
    for factor in (0.2, 1.0):
        got = vptree.nearest(docs, F.col("vec_id") == 0, factor=factor, shard_rows=40)
        assert [(x["rank"], x["vec_id"], round(x["score"], 12)) for x in got.orderBy("rank").collect()] == [(i, i, 1.0) for i in range(1, 6)]
    tiny = spark.createDataFrame([(0, [1e-200, 2e-200]), (1, [1e-200, 2e-200]), (2, [3e200, 6e200])], "vec_id long, embedding array<double>")
    assert [x["vec_id"] for x in vptree.nearest(tiny, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]


def test_neighbours_of_ids_with_several_vectors(spark):
    items = [(0, [1.0, 0.0])] + [(7, [1.0, 0.001 * i]) for i in range(1, 20)] + [(i, [1.0, 0.1 * i]) for i in range(1, 6)]
    got = vptree.nearest(spark.createDataFrame(items, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, factor=1.0)
    assert [x["vec_id"] for x in got.orderBy("rank").collect()] == [7, 1, 2, 3, 4]


def test_neighbours_memory_of_many_cells():
    """A batch against the most cells there are: what is held must not be rows times cells."""
    r = np.random.default_rng(3)
    points, full = r.standard_normal((4096, 8)), r.standard_normal((10000, 8))
    cells = vptree.Cells(list(points))
    tracemalloc.start()
    cell, far = cells.place(full)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    some = slice(0, 300)
    every = vptree.distances(vptree.units(full[some]), vptree.units(points))
    assert np.allclose(every.min(1), far[some]) and np.allclose(every[np.arange(300), cell[some]], far[some])


@pytest.mark.parametrize("options", [{"tile_bytes": 1, "ask_bytes": 1 << 11}, {"tile_bytes": 1 << 14, "ask_bytes": 1 << 9, "block": 5}])
def test_neighbours_by_tiles(spark, options, monkeypatch):
    """Tiles of one shard or of several, and queries in one piece or many, give the same rows."""
    monkeypatch.setattr(vptree, "TILES", 1)
    r = random.Random(4)
    items = [(i, [r.gauss(0, 1) for _ in range(8 - i % 2)], 0, 0.0) for i in range(600)]
    got = vptree.nearest(vectors(spark, items), F.col("vec_id") % 20 == 0, factor=1.0, shard_rows=32, **options)
    fine = {i: np.array(v, np.float32).astype(float) for i, v, *_ in items}
    want = []
    for q, x in fine.items():
        if q % 20 == 0:
            near = sorted((-float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), i) for i, y in fine.items() if i != q and len(y) == len(x))[:5]
            want += [(q, k + 1, i) for k, (_, i) in enumerate(near)]
    assert rows(got, "query_id", "rank", "vec_id") == sorted(want, key=repr)


@pytest.mark.parametrize("factor,least", [(0.2, 0.9), (1.0, 1.0)])
def test_neighbours_recall(spark, sf_dir, factor, least):
    """Against brute force in numpy, with many small cells and shards."""
    table = spark.read.parquet(f"{sf_dir}/../sf0.1/embeddings.parquet")
    own = [(r["vec_id"], np.array(r["embedding"], float)) for r in table.collect()]
    ids, full = np.array([i for i, _ in own]), np.stack([x / np.linalg.norm(x) for _, x in own])
    want = set()
    for i in np.flatnonzero(ids % 50 == 0):
        far = np.where(ids == ids[i], 9, -(full @ full[i]))
        want |= {(int(ids[i]), int(ids[j])) for j in np.argsort(far)[:5]}
    got = set(rows(vptree.nearest(table, F.col("vec_id") % 50 == 0, factor=factor, shard_rows=128), "query_id", "vec_id"))
    assert len(got & want) >= least * len(want)
    assert vptree.nearest(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0


# html


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("<html><body><nav><a href=x>Home</a> <a href=y>More</a></nav><article><h1>Title &amp; more</h1><p>First   paragraph\nof the text that is long enough.</p><p>Second<br>one.</p></article><footer>&copy; us</footer></body></html>", "Title & more\nFirst paragraph of the text that is long enough.\nSecond one."),
        ("<body><div class='sidebar'>side side side</div><div id=content><h2>Head</h2><p>This is the long text of a page without an article element, <a href=x>with a link</a>.</p><p>Short.</p></div><div class='comments'><p>I disagree with all of this very long text, says a reader.</p></div></body>", "Head\nThis is the long text of a page without an article element, with a link.\nShort."),
        ("<article><header><h1>T</h1></header><p>Body text of the article goes here.<form>name <input></form><aside>see also</aside><p>End &#233;nd</article>", "T\nBody text of the article goes here.\nEnd énd"),
        ("<article><p>Text<script>var x='</p>';</script> goes on<style>p{}</style> here</p><div class=ad>Buy</div><!-- no --></article>", "Text goes on here"),
        ("<nav><ul><li>a<article><p>Unclosed menu before the long article text.</article>", "Unclosed menu before the long article text."),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_very_deep_and_unclosed_pages():
    assert html_text.main_text("<article>" + "<b>" * 20000 + "deep text here" + "<div>" * 5000 + "more") == "deep text here\nmore"
    assert html_text.main_text("<article><p>Text before.</p><!-- never closed " + "x <p>" * 50000).startswith("Text before.")
    assert html_text.main_text("<p>Some text.</p><script>" + "var x = 1; " * 50000) == "Some text."


def test_pages_against_their_articles(spark, sf_dir):
    """The given pages mark their article plainly, so that regular expressions can find its lines."""
    import html
    import re

    for r in spark.read.parquet(f"{sf_dir}/../sf0.01/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        lines = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:h1|p|ul|li)>|<br>(?=<p>)", inner)]
        want = "\n".join(x for x in (re.sub(r" *<br> *", " ", x).strip() for x in lines) if x)
        assert html_text.main_text(r["html"]) == want, r["page_id"]


def test_ratios_decide(spark, sf_dir, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    right = [html_text.main_text(x) for x in pages]
    monkeypatch.setattr(html_text, "smooth", lambda ratios, sigma: np.ones(len(ratios)))
    assert sum(html_text.main_text(x) != y for x, y in zip(pages, right)) > 0.9 * len(pages)


def test_names_shift_and_markup_decides():
    long = "Long text of the article goes on and on. " * 20
    page = f'<article><p>{long}</p><p id="share-price">The share price fell.</p><p>{long}</p><div class="ad">Buy this now please</div><p>Short.</p></article>'
    assert html_text.main_text(page).split("\n")[1::2] == ["The share price fell.", "Short."]
    deep = "<div>" * 1005 + f"<p>{long}</p><script>var x = 1</script>" + "</div>" * 1005
    assert html_text.main_text(deep) == long.strip()


def test_html_pages(spark, sf_dir):
    got = html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    for r in got.collect():
        assert r["text"] and r["n_chars"] == len(r["text"]) and "track(" not in r["text"]
    same = spark.createDataFrame([(1, "u", "<p>One text.", "n"), (1, "u", "<p>One text.", "n"), (1, "v", "<p>Other.", "n")], "page_id long, url string, html string, n_chars string")
    assert rows(html_text.extract(same)) == [(1, "u", "One text.", 9), (1, "u", "One text.", 9), (1, "v", "Other.", 6)]
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "u", "<p>" + "long text " * 60000, "x")], "page_id long, url string, html string, text string")
    assert [r[3] for r in rows(html_text.extract(odd))] == [599999, 0] or [r[3] for r in rows(html_text.extract(odd))] == [0, 599999]


# decontamination


@pytest.mark.parametrize("which", ["odd", "small"])
def test_contamination(spark, sf_dir, odd_docs, small_docs, pairs_of, small_pairs, which):
    docs, plain = (odd_docs, pairs_of) if which == "odd" else (small_docs, small_pairs)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bench += [(900, "Beta gamma"), (901, None), (902, "zeta eta theta iota kappa alpha beta gamma delta"), (903, "..."), (904, "a"), (None, "alpha beta gamma delta epsilon zeta eta theta"), (905, "ZETA eta theta iota kappa alpha beta gamma")]
    got = decontaminate.contamination(docs, spark.createDataFrame(bench, "item_id long, text string"))
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(got, *names) == sorted(brute.contamination(plain, bench), key=repr)
    assert rows(got, "doc_id", "n_near") == sorted(brute.nearly(plain, bench), key=repr)


def test_contamination_by_shuffles(spark, sf_dir, small_docs, small_pairs, monkeypatch):
    """Without any broadcast, as for a benchmark of very many terms."""
    monkeypatch.setattr(decontaminate, "small", lambda df: df)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = decontaminate.contamination(small_docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert rows(got, *names) == sorted(brute.contamination(small_pairs, bench), key=repr)


def test_contamination_empty(spark, empty_docs, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(empty_docs, none).count() == 0
    assert not any(r["contaminated"] or r["n_hit"] for r in decontaminate.contamination(odd_docs, none).collect())


def test_proximity(spark):
    docs = [(1, "one two rare3 four five rare6 seven eight"), (2, "rare3 and and and rare6"), (3, "rare3 " + "x " * 50 + "rare6")]
    docs += [(i, "one two four five seven eight") for i in range(10, 20)]
    bench = [(1, "one two rare3 four five rare6 seven eight")]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {r["doc_id"]: (r["n_items"], r["n_near"]) for r in got.where("n_near > 0").collect()} == {1: (1, 1), 2: (0, 1)}


# substrings


def test_suffix_arrays():
    r = np.random.default_rng(0)
    for trial in range(120):
        s = np.append(r.integers(1, 2 + trial % 4, r.integers(1, 300)), 0)
        if trial % 3 == 0:
            s = np.append(np.tile(r.integers(1, 3, 7), 30), 0)
        t = bytes(s.astype(np.uint8))
        order = suffix.suffix_array(s)
        assert list(order) == sorted(range(len(s)), key=lambda i: t[i:])
        got = suffix.common_prefixes(s, order)
        for a, b in zip(order[1:], order):
            m = 0
            while max(a, b) + m < len(s) and s[a + m] == s[b + m]:
                m += 1
            assert got[a] == m


def test_suffixes_of_names_by_doubling(monkeypatch):
    """Against sorting, and no text of bytes goes suffix by suffix."""

    def never(*_):
        raise AssertionError("suffix by suffix")

    monkeypatch.setattr(suffix, "induce_singly", never)
    r = np.random.default_rng(5)
    for n, symbols in ((1, 1), (50, 1), (300, 2), (300, 40)):
        names = np.append(r.integers(1, symbols + 1, n - 1), 0)
        assert suffix.doubled(names).tolist() == sorted(range(n), key=lambda i: names[i:].tolist())
    s = np.append(np.tile(r.integers(2, 250, 700), 6) + (r.random(4200) < 0.001), 0)
    assert suffix.suffix_array(s, 258).tolist() == sorted(range(len(s)), key=lambda i: s[i : i + 5000].tolist())


def test_suffix_arrays_of_real_text(small_pairs):
    """Large alphabets in the recursion: names of nearly all places differ."""
    data = " ".join(t or "" for _, t in small_pairs).encode()[:40_000]
    for s in (np.append(np.frombuffer(data, np.uint8).astype(np.int64) + 1, 0), np.append(np.random.default_rng(1).integers(1, 3000, 5000), 0)):
        order = suffix.suffix_array(s)
        t = s.astype(">u4").tobytes()
        assert sorted(order) == list(range(len(s)))
        assert all(t[4 * a : 4 * a + 4000] <= t[4 * b : 4 * b + 4000] for a, b in zip(order, order[1:]))


def repeats_of(df):
    return rows(df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h")))


@pytest.mark.parametrize("which", ["odd", "small", "hot"])
def test_without_repeats(spark, odd_docs, small_docs, pairs_of, small_pairs, which):
    if which == "small":
        assert repeats_of(substrings.without_repeats(small_docs)) == sorted(brute.without_repeats(small_pairs), key=repr)
        return
    if which == "odd":
        plain = [(-(1 << 63) if d is None else d, t) for d, t in pairs_of]
        want = [(None if r[0] == -(1 << 63) else r[0], *r[1:]) for r in brute.without_repeats(plain)]
        got = substrings.without_repeats(odd_docs.select("doc_id", "text", "lang"))
        assert repeats_of(got) == sorted(want, key=repr) and "lang" in got.columns
        return
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(40))
    plain = [(i, " ".join(word() for _ in range(25)) + " " + passage[r.randrange(30) :] + " " + " ".join(word() for _ in range(25))) for i in range(60)]
    docs = spark.createDataFrame(plain, "doc_id long, text string")
    want = sorted(brute.without_repeats(plain), key=repr)
    assert repeats_of(substrings.without_repeats(docs, hot=8)) == want
    assert repeats_of(substrings.without_repeats(docs, hot=0)) == want
    assert repeats_of(substrings.without_repeats(docs, most_bits=4, shard_bytes=2000)) == want  # joins in place of filters


def test_without_repeats_names_and_ids(spark):
    r = random.Random(5)
    text = "".join(r.choice("abcdefgh ") for _ in range(300))
    docs = spark.createDataFrame([(1, text, "x", 5, "k"), (2, "some words " + text, "y", 6, "l")], "doc_id long, text string, kid string, n_spans long, spans string")
    got = {r["doc_id"]: r for r in substrings.without_repeats(docs).collect()}
    assert (got[2]["n_removed"], got[2]["n_spans"], got[2]["kid"], got[2]["spans"], got[1]["n_spans"]) == (300, 1, "y", "l", 0)
    with pytest.raises(TypeError):
        substrings.without_repeats(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_without_repeats_empty(empty_docs):
    assert substrings.without_repeats(empty_docs.select("doc_id", "text")).count() == 0


def test_long_texts_are_cut_with_overlap(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PART", 1500)
    r = random.Random(1)
    text = "".join(r.choice("abcdefghijklmnop ") for _ in range(6000))
    got = [list(substrings.pieces_of(c, 100)["count"]) for _, _, c in substrings.parts([text.encode()], 100)]
    assert sum(map(sum, got)) == 6000 - 99


# packing


def check_packing(df, plain):
    whole = Tokenizer.from_file(PATH)
    left = Counter()
    for d, t in plain:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        left[d, len(ids)] += 1
    got = df.collect()
    by = {}
    for g in got:
        by.setdefault((g["doc_id"], g["doc_tokens"]), []).append(g)
    assert set(by) == set(left)
    for (d, n), pieces in by.items():
        assert sum(p["length"] for p in pieces) == n * left[d, n]
        if left[d, n] == 1:
            text = next(t for e, t in plain if e == d and len(whole.encode(t or "", add_special_tokens=False).ids) + 1 == n)
            ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
            at = 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert p["start"] == at and zlib.crc32(ids[at : at + p["length"]].tobytes()) == p["ids_crc32"]
                at += p["length"]
    sequences = {}
    for g in got:
        sequences.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)


def test_packing(odd_docs, small_docs, pairs_of, small_pairs, empty_docs):
    check_packing(packing.pack(odd_docs, PATH), pairs_of)
    check_packing(packing.pack(small_docs, PATH, shard_tokens=20000), small_pairs)
    assert packing.pack(empty_docs, PATH).count() == 0
    ids = packing.pack(small_docs.limit(3), PATH, with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in ids)


def test_encoder_is_the_tokenizer():
    whole, r = Tokenizer.from_file(PATH), random.Random(4)
    alphabet = ["a", "B", "é", "É", "ñ", "1", "²", "٣", ".", ",", "'s", "'", "!!", "$", " ", "  ", "\n", "\t", " ", " ", "\x1c", "é", "ẖ", "H̱", "İ", "ſ", "Å", "日本", "क़", "<|endoftext|>", "<|STARTOFTEXT|>", "😀", "word", "ﬁ", "\x00"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(1500)]
    flat, totals = packing.Encoder(PATH).encode([t.encode() for t in texts])
    at = 0
    for t, n in zip(texts, totals):
        assert list(flat[at : at + n]) == whole.encode(t, add_special_tokens=False).ids, repr(t)
        at += n


def test_plan_is_gapless():
    r = random.Random(2)
    for _ in range(200):
        totals = [r.choice([1, 5, 256, 700, 1024, 2047, 2048, 2049, 5000, r.randrange(1, 4000)]) for _ in range(r.randrange(1, 30))]
        plan = packing.plan(totals)
        assert sum(x[2] for s in plan for x in s) == sum(totals)
        for s in plan:
            n = sum(x[2] for x in s)
            assert n == 2048 or n & (n - 1) == 0
    loads = Counter()
    sizes = [2048] * 30 + [1024] * 40
    for s, g in zip(sizes, packing.step_groups(sizes, 16384)):
        loads[g] += s
    assert max(loads.values()) - min(loads.values()) <= 2048


# quality


def test_quality(spark, sf_dir):
    sf_dir = f"{sf_dir}/../sf0.01"
    labels, small_docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "documents"))
    got = {r["doc_id"]: r for r in quality.quality_scores(small_docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(r["held_out"] == (brute.crc(d) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for d, r in got.items())
    held = [(truth[d], r["score"]) for d, r in got.items() if d in truth and r["held_out"]]
    good, bad = [s for q, s in held if q], [s for q, s in held if not q]
    assert np.mean([a > b for a in good for b in bad]) > 0.9
    taken = [q for q, s in held if s >= 0.7]
    assert len(taken) > 0.6 * len(good) and np.mean(taken) > 0.9  # what is predicted as good is


def test_quality_against_a_plain_network(small_pairs):
    """The same convolution, chunks and pooling, position by position."""
    net = quality.fresh(3)
    for text in [t.encode()[:2000] for _, t in small_pairs[:6]] + [b"", b"x", b"y" * 256, b"ab" * 200]:
        n = (len(text) + quality.WIDTH) // quality.STRIDE + 1
        data = text.ljust(n * quality.STRIDE + quality.WIDTH, b"\0")
        top = []
        for k in range(n):
            ends = range(k * quality.STRIDE, (k + 1) * quality.STRIDE)
            y = [net.embed[list(data[i : i + quality.WIDTH])].ravel() @ net.filters for i in ends if k < n - 1 or i <= n * quality.STRIDE - quality.WIDTH]
            top.append(np.maximum(np.max(y, 0) + net.bias, 0))
        chunks = [np.maximum(a, b) for a, b in zip(top, top[1:])] + top[-1:]
        z = np.concatenate([np.mean(chunks, 0), np.max(chunks, 0)]) @ net.out + net.shift[0]
        assert abs(quality.scores(net, [text])[0] - 1 / (1 + np.exp(-z))) < 1e-4


def test_quality_edges(spark, odd_docs, empty_docs):
    labels = spark.createDataFrame([(5, 1), (8, 0), (None, 1), (9, None)], "doc_id long, quality int")
    got = quality.quality_scores(odd_docs, labels)
    assert got.count() == odd_docs.count() and got.where("score is null").count() == 0
    assert quality.quality_scores(empty_docs, labels.limit(0)).count() == 0
    assert quality.quality_scores(odd_docs, labels.limit(0)).count() == odd_docs.count()
    net = quality.fresh()
    both = quality.scores(net, [b"one text", b"x" * 3000, b""])
    assert np.allclose(both, [quality.scores(net, [t])[0] for t in (b"one text", b"x" * 3000, b"")])


def test_network_gradients():
    net, docs = quality.fresh(1), [b"abc def " * 60, b"zzz", b"Hello there"]
    labels, weight = np.array([1, 0, 1], np.float32), np.ones(3)
    loss = lambda: float(np.mean([-np.log(p if y else 1 - p) for p, y in zip(quality.scores(net, docs), labels)]))
    grads = quality.gradients(net, docs, labels, weight)
    for name, at in (("out", (3,)), ("filters", (2, 5)), ("bias", (4,)), ("embed", (ord("e"), 1))):
        array = getattr(net, name)
        array[at] += 1e-2
        up = loss()
        array[at] -= 2e-2
        down = loss()
        array[at] += 1e-2
        assert abs((up - down) / 2e-2 - grads[name][at]) < 2e-3, name


# secrets


@pytest.mark.parametrize("which", ["odd", "small", "planted"])
def test_secrets(spark, odd_docs, small_docs, pairs_of, small_pairs, which):
    plain = {"odd": pairs_of, "small": small_pairs}.get(which) or [
        (1, 'PassWord = "hunter2222", api_key:abcdefgh api-key=abcdefgh APIKEY="12345678"'), (2, "secret:=x token  =  'abcdefghij"), (3, "AKIA AKIAABCDEFGHIJKL xAKIA1234567890123"), (4, "f" * 31 + " " + "a" * 32 + "g" + "0" * 40),
        (5, "token=secret = abcdefghijk"), (6, "ſecret=abcdefghij toKen=abcdefghij"), (7, "😀 token=abcdefgh"), (8, "-----BEGIN RSA PRIVATE KEY-----"), (9, "password=" + "a" * 50000),
    ]
    docs = {"odd": odd_docs, "small": small_docs}.get(which) or spark.createDataFrame(plain, "doc_id long, text string")
    got = secrets.secret_report(docs)
    assert rows(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted((brute.secret_row(*x) for x in plain), key=repr)
    if which == "planted":
        assert {r["doc_id"]: r["spans"] for r in got.collect()}[8] == "pem:0:31"


def test_trigram_queries():
    assert secrets.trigram_query("abcd|xyz") == {frozenset({"abc", "bcd"}), frozenset({"xyz"})}
    assert secrets.trigram_query("[0-9a-f]+") == {frozenset()}
    assert secrets.trigram_query("ab?cd") == {frozenset({"abc", "bcd"}), frozenset({"acd"})}
    assert secrets.trigram_query("(?:foo)?bar") == {frozenset({"bar"})}
    assert secrets.trigram_query("(abc)+x*") == {frozenset({"abc"})}
    assert frozenset({"api", "pik", "ike", "key"}) in secrets.trigram_query(secrets.BASE[0].regex)


def test_redact_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a token=abcdefgh b", "mine", True, "x"), (2, None, "yours", False, "y")], "doc_id long, text string, found string, is_assign boolean, _none string")
    got = [tuple(r) for r in secrets.redact(docs).orderBy("doc_id").collect()]
    assert got == [(1, "a [secret] b", "mine", True, "x"), (2, None, "yours", False, "y")]
    with pytest.raises(ValueError):
        secrets.scan(docs)


def test_redact(spark, odd_docs, empty_docs):
    docs = spark.createDataFrame([(1, "a token=abcdefgh b " + "0" * 33), (2, "clean"), (3, None), (4, "secret=" + "f" * 40)], "doc_id long, text string")
    assert [r["text"] for r in secrets.redact(docs).orderBy("doc_id").collect()] == ["a [secret] b [secret]", "clean", None, "[secret]"]
    assert secrets.secret_report(empty_docs).count() == 0


# near-duplicates


@pytest.mark.parametrize("which", ["odd", "small"])
def test_near_duplicates(odd_docs, small_docs, pairs_of, small_pairs, which):
    docs, plain = (odd_docs, pairs_of) if which == "odd" else (small_docs, small_pairs)
    assert rows(simhash.near_duplicates(docs)) == sorted(brute.near_duplicates(plain), key=repr)


def test_masks_cover():
    r = random.Random(9)
    masks = [m & (1 << 64) - 1 for m in simhash.masks()]
    assert len(masks) == 15
    for _ in range(3000):
        change = sum(1 << b for b in r.sample(range(64), 3))
        assert any(not change & m for m in masks)


@pytest.mark.parametrize("block", [3, 2000])
def test_links_and_components(spark, block):
    r = random.Random(8)
    fps = set()
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(12):
            base ^= sum(1 << b for b in r.sample(range(64), r.randrange(0, 5)))
            fps.add(base - (1 << 64) if base >> 63 else base)
    classes = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {x["node"]: x["root"] for x in simhash.components(simhash.links(classes, block=block)).collect()}
    all_, parent = sorted(fps), {}
    for a in all_:
        parent[a] = a
    changed = True
    while changed:
        changed = False
        for a in all_:
            for b in all_:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 and parent[a] != parent[b]:
                    parent[a] = parent[b] = min(parent[a], parent[b])
                    changed = True
    assert all(found.get(a, a) == parent[a] for a in all_)


def test_drop_near_duplicates(odd_docs, empty_docs):
    got = simhash.drop_near_duplicates(odd_docs)
    assert got.columns == odd_docs.columns and got.where("doc_id = 6").count() == 0 and sorted(r["text"][:5] for r in got.where("doc_id = 5").collect()) == ["alpha", "anoth"]
    assert simhash.drop_near_duplicates(empty_docs).count() == 0 and simhash.near_duplicates(empty_docs).count() == 0


# licences


WRAPPED = """// Permission is hereby granted, free of charge, to any person
// obtaining a copy of this software and associated documentation
// files (the "Software"), to deal in the Software without restriction"""


def test_licenses(spark, empty_docs, odd_docs):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "some prose\nReleased under the MIT License.\nmore", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
        "he lost his license on the road and the license was expired", "// Licensed under CC BY 4.0.", None, "", WRAPPED, "# Some text.\n\n" + WRAPPED.replace("//", " *") + "\n\nmore prose", "a\n\nAll rights reserved.\n\nb", "x " * 50_000 + "\nLicensed under CC BY 4.0.",
    ]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, first string")
    got = {r["doc_id"]: (r["n_paragraphs"], r["families"], r["spans"]) for r in licenses.license_report(docs).collect()}
    assert got[0] == (1, "Apache-2.0", "0-0:Apache-2.0") and got[1] == (1, "MIT", "1-1:MIT") and got[2][1] == "GPL-3.0" and got[3][1] == "CC-BY-NC"
    assert got[4][1] == "" and got[5][1] == "CC-BY" and got[6] == (0, "", "") and got[7] == (0, "", "")
    assert got[8] == (1, "MIT", "0-2:MIT") and got[9] == (3, "MIT", "2-4:MIT") and got[10] == (3, "proprietary", "2-2:proprietary") and got[11][1] == "CC-BY"
    assert licenses.license_report(empty_docs).count() == 0 and licenses.license_report(odd_docs).count() == odd_docs.count()


def test_licenses_against_plain_python(spark, odd_docs, small_docs, pairs_of, small_pairs):
    import re

    planted = [(10_000 + i, f"some words\n{t}\nmore words\n\n{u}") for i, (t, u) in enumerate(zip((x for _, x, _ in licenses.all_templates()), reversed([x.replace(", ", ",\n") for _, x, _ in licenses.all_templates()])))]
    more = spark.createDataFrame(planted, "doc_id long, text string")
    marks = licenses.marker_regex(0.75)
    for docs, plain in ((odd_docs.select("doc_id", "text"), pairs_of), (small_docs.select("doc_id", "text").unionByName(more), small_pairs + planted)):
        want = brute.licenses(plain, licenses.train(), licenses.all_templates(), re.compile(marks), licenses.grams_of)
        assert rows(licenses.license_report(docs)) == sorted(want, key=repr)
    assert sum(r[2] > 0 for r in want) > 20


def test_license_model_and_markers():
    model = licenses.train()
    right = total = 0
    for family, text in licenses.examples(2, 99):
        have = set(licenses.grams_of(text))
        z = np.array(model.bias) + sum((np.array(model.weights[g]) for g in have if g in model.weights), np.zeros(len(model.families)))
        right += model.families[int(z.argmax())] == family
        total += 1
    assert right / total > 0.93
    marks = set(licenses.markers(0.75))
    for texts in licenses.TEMPLATES.values():
        for t in texts:
            grams = set(licenses.grams_of(t))
            assert sum(marks.isdisjoint(g.split()) for g in grams) < 0.75 * len(grams)


# language model


@pytest.mark.parametrize("which", ["odd", "small"])
def test_language_model(odd_docs, small_docs, pairs_of, small_pairs, which):
    docs, plain = (odd_docs, pairs_of) if which == "odd" else (small_docs, small_pairs)
    setting = hmm.Setting(states=3, common=200, rare=16, shares=(0.25, 1.0))
    counts = Counter()
    for d, t in plain:
        if brute.crc(d) % 7 != 2:
            counts.update([*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t in plain:
        tokens = [*(t or "").encode().lower().split(), None]
        want.append((d, brute.crc(d) % 7 == 2, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(sum(log10((counts[w] + 1) / (n + v + 1)) for w in tokens), 5)))
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in hmm.language_scores(docs, setting).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_language_model_learns(small_docs, empty_docs):
    got = hmm.language_scores(small_docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]
    assert hmm.language_scores(empty_docs).count() == 0


def test_scores_against_a_plain_recursion(small_docs, small_pairs):
    """Whole texts, word by word, with the operator's own parameters."""
    setting = hmm.Setting(states=3, common=200, rare=16, shares=(0.5, 1.0))
    model, counts = hmm.fit(small_docs.where(f"crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2"), setting)
    n = {bytes(r["word"]): r["n"] for r in counts.collect()}
    got = {r["doc_id"]: r["score"] for r in hmm.language_scores(small_docs, setting).collect()}
    mass = 10**model.mass
    for doc, text in small_pairs[:60]:
        total, alpha = 0.0, None
        for w in [*(text or "").encode().lower().split(), None]:
            kind = model.end if w is None else model.words.get(w, model.end + 1 + zlib.crc32(w or b"") % 16)
            own = ((model.ends if w is None else n.get(w, 0)) + 1) / model.denominator / mass[kind]
            alpha = (model.start if alpha is None else alpha @ model.move) * model.emit[kind] * own
            total += log10(alpha.sum())
            alpha = alpha / alpha.sum()
        assert abs(got[doc] - total) < 1e-3 * max(1, abs(total)), doc


def test_every_round_reads_all_training_documents(small_docs, small_pairs):
    """The fitted states against as many plain rounds, each over all texts."""
    setting = hmm.Setting(states=2, common=50, rare=4)
    model, _ = hmm.fit(small_docs, setting)
    plain, _ = hmm.statistics(small_docs, setting)
    kind, sizes, _, _ = hmm.classes_of(plain, [(t or "").encode() for _, t in small_pairs])
    for _ in setting.shares:
        hmm.parameters(plain, *hmm.forward(plain, kind, sizes, back=True)[1:])
    assert len(setting.shares) == 8
    for name in ("start", "move", "emit"):
        assert np.allclose(getattr(model, name), getattr(plain, name), rtol=1e-6)


def test_language_model_of_one_very_long_text(spark):
    text = "a b c d e f g h " * 30_000
    docs = spark.createDataFrame([(1, text), (2, None), (3, "a b")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["score"]) for r in hmm.language_scores(docs, hmm.Setting(states=2, common=5, rare=2, shares=(0.1, 1.0))).collect()}
    assert got[1][0] == 240_001 and all(np.isfinite(x[1]) for x in got.values())


def test_forward_and_counts_by_enumeration():
    from itertools import product

    r = np.random.default_rng(0)
    s = hmm.Setting(states=2, common=3, rare=1)
    m = hmm.Model(s, 10, 3, 2, {b"a": 0, b"b": 1, b"c": 2}, np.ones(4), np.zeros(5))
    m.start, m.move, m.emit = r.dirichlet([1, 1]), r.dirichlet([1, 1], 2), r.dirichlet(np.ones(5), 2).T
    texts = [np.array([0, 1, 4, 2, 3]), np.array([3]), np.array([1, 1, 3])]
    sizes = np.array([len(t) for t in texts])
    out, first, moves, emits = hmm.forward(m, np.concatenate(texts), sizes, back=True)
    want_moves = np.zeros((2, 2))
    for t, log in zip(texts, out):
        total, each = 0.0, np.zeros((2, 2))
        for path in product(range(2), repeat=len(t)):
            p = m.start[path[0]] * m.emit[t[0], path[0]]
            for i in range(1, len(t)):
                p *= m.move[path[i - 1], path[i]] * m.emit[t[i], path[i]]
            total += p
            for a, b in zip(path, path[1:]):
                each[a, b] += p
        want_moves += each / total
        assert abs(10**log - total) < 1e-12
    assert np.allclose(moves, want_moves, atol=1e-5) and np.isclose(emits.sum(), sizes.sum()) and np.isclose(first.sum(), 3)


def test_word_masses_sum_to_one(small_docs):
    model, counts = hmm.fit(small_docs, hmm.Setting(states=2, common=100, rare=8, shares=(0.5, 1.0)))
    assert np.isclose((10**model.mass).sum(), 1) and np.allclose(model.emit.sum(0), 1)
