"""Token counts, token store, page text and benchmark leaks."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakefold.llm import decontaminate, html_text, textkit, token_store, unit_encoder, viterbi_count

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\n\n", "\t", "a", "Ab", "é", " x", ".", "!", "12", "\x1c", "\x85", "'s", "'", "<|endoftext|>", "日本", "​", "\r\n", "᠎", "word", "\x0b", "x<|", "|>", "b***", "▁", "🙂", "×", "Ж", "\u3000", "\xa0", "—", "don't", "\u0661", "\u2009", "\u0301"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(n)]


def test_units_give_the_librarys_ids(monkeypatch):
    enc = unit_encoder.Encoder(BPE)
    monkeypatch.setattr(unit_encoder, "CACHED_UNITS", 300)
    texts = odd_texts(6000, 1)
    for at in range(0, len(texts), 50):
        ids, offsets = enc.encode(pa.array(texts[at : at + 50]))
        for k, text in enumerate(texts[at : at + 50]):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert [x.tolist() for x in enc.encode(pa.array([None, ""], pa.string()))] == [[], [0, 0, 0]]


def test_long_runs_hash_as_short_ones(monkeypatch):
    data = np.frombuffer(random.Random(4).randbytes(5000), dtype=np.uint8)
    starts, ends = np.array([0, 10, 700, 4000]), np.array([10, 600, 3900, 4001])
    want = [textkit.span_hashes(data, starts, ends, w) for w in (0, 1)]
    monkeypatch.setattr(textkit, "PIECE_BYTES", 64)
    assert [textkit.span_hashes(data, starts, ends, w).tolist() for w in (0, 1)] == [w.tolist() for w in want]


def test_chunks_follow_content():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50_000, 20_000).astype("<u2")
    lengths = token_store.chunk_lengths(ids)
    assert sum(lengths) == len(ids) and min(lengths[:-1]) >= token_store.CHUNK_MIN and max(lengths) <= token_store.CHUNK_MAX
    shifted = np.concatenate((ids[5000:5007], ids))
    cuts = lambda x, off: {int(c) - off for c in np.cumsum(token_store.chunk_lengths(x))}
    assert len(cuts(ids, 0) & cuts(shifted, 7)) > 0.8 * len(lengths)
    assert sum(token_store.chunk_lengths(np.zeros(10_000, dtype="<u2"))) == 10_000


def test_store_round_trip(spark, tmp_path):
    shared = " ".join(f"word{k}" for k in range(900))
    texts = [(i, t) for i, t in enumerate([*odd_texts(60, 2), shared, shared, shared + " and more", None, ""])] + [(900, "z " * 30_000), (5, "again"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id bigint, text string, pack int")
    token_store.write_store(df, str(tmp_path / "s"), BPE, 2, packs=5)
    got = token_store.read_store(spark, str(tmp_path / "s")).orderBy("start").collect()
    library = unit_encoder.Encoder(BPE).tokenizer
    want = sorted((i is not None, i or 0, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in texts)
    start = 0
    assert [r.doc_id or 0 for r in got] == [w[1] for w in want]
    expected = set()
    for r, (_, i, ids) in zip(got, want, strict=True):
        assert (r.start, r.verified) == (start, True)
        start += r.n_tokens
        expected.add((i, len(ids), zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())))
    assert {(r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got} == expected
    packs = token_store.read_packs(spark, str(tmp_path / "s"))
    names = packs.select(F.explode(F.arrays_zip("chunk_sha", "owner")).alias("c"))
    assert names.where("c.owner = -1").count() == names.select("c.chunk_sha").distinct().count() < names.count()


def test_store_shows_damage(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(20)], "doc_id bigint, text string")
    token_store.write_store(df, str(tmp_path / "s"), BPE, 2, packs=2)
    spark.read.parquet(str(tmp_path / "s/manifest")).withColumn("root", F.lit(b"x").cast("binary")).write.parquet(str(tmp_path / "m"))
    import shutil

    shutil.rmtree(tmp_path / "s/manifest")
    shutil.move(tmp_path / "m", tmp_path / "s/manifest")
    assert {r.verified for r in token_store.read_store(spark, str(tmp_path / "s")).collect()} == {False}


def test_store_shows_another_corpus_root(spark, tmp_path):
    import shutil

    df = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(20)], "doc_id bigint, text string")
    token_store.write_store(df, str(tmp_path / "s"), BPE, 2, packs=3)
    row = spark.read.parquet(str(tmp_path / "s/corpus")).first()
    manifest = spark.read.parquet(str(tmp_path / "s/manifest")).orderBy("pack").collect()
    assert row.root == token_store.merkle([r.root for r in manifest]) and row.n_docs == 20 and {r.verified for r in token_store.read_store(spark, str(tmp_path / "s")).collect()} == {True}
    shutil.rmtree(tmp_path / "s/corpus")
    spark.createDataFrame([(20, row.n_tokens, b"x")], token_store.CORPUS_DDL).write.parquet(str(tmp_path / "s/corpus"))
    assert {r.verified for r in token_store.read_store(spark, str(tmp_path / "s")).collect()} == {False}


def test_empty_store(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    token_store.write_store(df, str(tmp_path / "s"), BPE, 2, packs=2)
    assert token_store.read_store(spark, str(tmp_path / "s")).collect() == []


def test_merkle():
    leaves = [bytes([k]) * 32 for k in range(5)]
    assert token_store.merkle(leaves) != token_store.merkle(leaves[::-1]) and token_store.merkle(leaves[:1]) == leaves[0]


def reference_counter():
    """The tokenizers library's unigram model over the same pieces and scores."""
    import sentencepiece
    from tokenizers import Tokenizer, models

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    lowest = min(m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i)))
    vocabulary = [(str(i) * 40 if m.is_control(i) or m.is_unknown(i) else m.id_to_piece(i), lowest if m.is_byte(i) else m.get_score(i)) for i in range(m.get_piece_size())]
    return Tokenizer(models.Unigram(vocabulary, 0, True))


def test_counts_are_the_unigram_models(spark):
    tokenizer = reference_counter()
    texts = odd_texts(1500, 3) + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()] + ["", "word " * 3000]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id bigint, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r.n_tokens for r in viterbi_count.count_tokens(df, PIECES).collect()}
    want = {i: len(tokenizer.encode("▁" + t.replace(" ", "▁")).ids) if t else 0 for i, t in enumerate(texts)} | {-1: 0}
    assert got == want
    assert viterbi_count.count_tokens(df.limit(0), PIECES).collect() == []


def test_ties_take_the_longest_last_piece():
    c = viterbi_count.Counter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0)], False)
    assert c.search("ab") == 1 and c.search("xyab") == 2
    assert viterbi_count.Counter([("▁", -1.0)], True).search("é▁") == 3


PAGE = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body class="home"><header><h1>Site</h1></header>
<div class="cookie-notice">We use cookies</div><div id="menu"><a href=x>m</a></div><div class="wrap"><main><h2>Tit &lt;b&gt;</h2>
<p>One<p>Two <i>it</i>alic&nbsp;x<br>y<div class="ad">buy</div><p>Three</p><form><p>mail</p></form><section class="comments"><article><p>hey</p></article></section>
<ul><li>a<li>b</ul><script>if(a<b){"</p>"}</script></main></div><aside><p>side</p></aside><footer>foot"""


@pytest.mark.parametrize("page, text", [
    (PAGE, "Tit <b>\n\nOne\n\nTwo italic x y\n\nThree\n\na\n\nb"), (None, ""), ("", ""), ("plain words only", "plain words only"),
    ("<nav>x</nav><p>Just text here with words</p><ul><li><a>x</a></li></ul>", "Just text here with words"), ("<script>var a='</p>'", ""), ("a < b", "a < b"),
    ("<article><p>1 &am 2 &amp; 3 &#x41;</p><!-- <p>no</p> --></article>", "1 &am 2 & 3 A"), ("<p>same</p><p>same</p>", "same\n\nsame"),
])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


STORY = "<div><p>The first words of the story stand here in plain flow.</p><p>And it goes on with more.</p></div>"
STORY_TEXT = "The first words of the story stand here in plain flow.\n\nAnd it goes on with more."


@pytest.mark.parametrize("beside", [
    "<aside><article><p>Related card</p></article></aside>", "<section class='comments'><article><p>A reader says so</p></article></section>",
    "<script>var a = '<article >';</script>", "<!-- <main> -->", "<article> </article>", "<template><main>x</main></template>",
])
def test_articles_that_are_left_out_do_not_count(beside):
    assert html_text.main_text(STORY + beside) == html_text.main_text(beside + STORY) == STORY_TEXT


def test_every_article_is_kept():
    long, short = ("word " * 40).strip(), "a short one"
    between = "<div>" + "beside " * 30 + "</div>"
    page = f"<article><p>{long}</p></article>{between}<article><p>{short}</p></article>"
    assert html_text.main_text(page) == f"{long}\n\n{short}"


@pytest.mark.parametrize("page, text", [
    ("<div class='page has-sidebar'><article><p>The story.</p></article></div>", "The story."),
    ("<article><p>One</p><div class='search-tips'>tips</div><div class=related>more</div></article>", "One\n\ntips\n\nmore"),
    ("<p data-x=it's>first words here</p><p>second para it's</p>", "first words here\n\nsecond para it's"),
    ("<div class=sidebar><article>only story</article></div>", "only story"), ("<div class=banner><p>all words here</p></div>", "all words here"),
    ("<div class=sidebar><article>card</article></div><article>story</article>", "story"), ("<article>a<div id='ads'>buy</div>b</article>", "a\n\nb"),
    ("<p>x <a href='u'>y</a> z</p>", "x y z"), ("<article>a</article><article>a</article>", "a\n\na"), ("<p>cut <a href='", "cut"),
])
def test_names_and_quotes_lose_no_article(page, text):
    assert html_text.main_text(page) == text


def recursive_regions(values, begin=0, end=None):
    """By definition: the best contiguous region (the first of the shortest best ones), then those to its left and right."""
    end = len(values) if end is None else end
    best = max(((sum(values[i:j]), i - j, -i, j) for i in range(begin, end) for j in range(i + 1, end + 1)), default=(0,))
    if best[0] <= 0:
        return []
    i, j = -best[2], best[3]
    return [*recursive_regions(values, begin, i), (best[0], i, j), *recursive_regions(values, j, end)]


def test_maximal_regions():
    rng = random.Random(7)
    for _ in range(400):
        values = [rng.choice([-5, -3, -1, 1, 2, 4, 0]) + k / 1024 for k in rng.sample(range(64), rng.randint(0, 14))]
        got = html_text.maximal_regions(values)
        assert [r[1:] for r in got] == [r[1:] for r in recursive_regions(values)]
        assert max((r[0] for r in got), default=0) == max((sum(values[i:j]) for i in range(len(values)) for j in range(i, len(values) + 1)), default=0)


def test_all_pages_against_a_plain_parser(spark):
    from html.parser import HTMLParser

    class Articles(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = 0, [[]]

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.blocks += [[]] if tag in html_text.BLOCK else []
            self.blocks[-1] += [" "] if tag == "br" and self.inside else []

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.blocks += [[]] if tag in html_text.BLOCK else []

        def handle_data(self, data):
            self.blocks[-1] += [data] if self.inside else []

    want = []
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        parser = Articles()
        parser.feed(r.html or "")
        parser.close()
        text = "\n\n".join(t for t in (" ".join("".join(b).split()) for b in parser.blocks) if t)
        want.append((r.page_id, r.url, text, len(text)))
    got = html_text.op8_html_text(spark, "/root/testdata/sf0.01")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "w", "<p>" * 60_000 + "w", "<a x='" * 50_001 + "w", '<a x="' * 50_000, "<" * 60_000, "<!--" * 60_000, "<script>" * 60_000, "<a" + "=" * 100_000, "<nav><article>w" * 20_000])
def test_time_is_linear(page):
    import time

    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 5


def test_pages(spark):
    df = spark.createDataFrame([(1, "<article>é🙂</article>", "clash"), (2, None, None)], "page_id bigint, html string, text string")
    assert sorted(tuple(r) for r in html_text.extract(df).collect()) == [(1, "é🙂", 2), (2, "", 0)]
    assert html_text.extract(df.limit(0)).collect() == []
    long = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    assert html_text.main_text(long).count("word") == 20_000


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment():
    rng = random.Random(2)
    for _ in range(200):
        a, b = (np.array([rng.randint(0, 3) for _ in range(rng.randint(1, n))], dtype=np.uint64) for n in (12, 20))
        score, x, y = decontaminate.align(a, b)
        assert score == smith_waterman(a, b)
        assert not score or smith_waterman(a, b[x:y]) == score


def test_leaks(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(5000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(18, 50)))) for k in range(30)] + [(100, None), (101, ""), (102, "two words")]
    docs, want = [], set()
    for k, text in items[:30]:
        t = text.split()
        for j in range(len(t)):
            if rng.random() < 0.08:
                t[j] = rng.choice(["new", "word", ""])
        around = [[rng.choice(words) for _ in range(rng.randint(0, 60))] for _ in range(2)]
        docs.append((k, " ".join(around[0] + [x.upper() for x in t] + around[1])))
        want.add((k, k))
    docs += [(200 + k, " ".join(rng.choice(words) for _ in range(200))) for k in range(60)] + [(300, None), (301, ""), (302, "it has two words, too"), (0, docs[0][1])]
    want.add((302, 102))
    d = spark.createDataFrame([(i, t, 0.0) for i, t in docs], "doc_id bigint, text string, score double")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.find_leaks(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) + 1
    assert decontaminate.find_leaks(d, b.limit(0)).collect() == [] and decontaminate.find_leaks(d.limit(0), b).collect() == []


def test_leaks_against_all_pairs(spark):
    """Every pair's whole texts aligned: pairs that reach the bar and share a run of SEED words are what is found."""
    d, b = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").collect() for t in ("documents", "benchmark"))
    b = b[:60]
    items = [decontaminate.word_hashes(pa.array([r.text]))[1] for r in b]
    runs = [{tuple(w[k : k + 3].tolist()) for k in range(len(w) - 2)} or {tuple(w.tolist())} for w in items]
    want = set()
    for r in d:
        text = decontaminate.word_hashes(pa.array([r.text or ""]))[1]
        own = {tuple(text[k : k + 3].tolist()) for k in range(len(text) - 2)}
        known = set(text.tolist())
        for q, w, seeds in zip(b, items, runs, strict=True):
            if seeds & own and sum(x in known for x in w.tolist()) >= len(w) / 2:
                score = decontaminate.align(w, text)[0] / (2 * len(w))
                if score >= decontaminate.LEAST:
                    want.add((r.doc_id, q.item_id, round(score, 9)))
    got = decontaminate.find_leaks(*(spark.createDataFrame([(r[0], r.text) for r in rows], f"{k} bigint, text string") for rows, k in ((d, "doc_id"), (b, "item_id")))).collect()
    assert {(r.doc_id, r.item_id, round(r.score, 9)) for r in got} == want and want


@pytest.mark.parametrize("edits, least", [(0.1, 1.0), (0.2, 1.0), (0.3, 0.98), (0.4, 0.9)])
def test_recall_by_edit_rate(spark, edits, least):
    """Of edited copies that an alignment of whole texts finds, the share found through seeds."""
    rng = random.Random(21)
    items = [[f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(15, 60))] for _ in range(200)]

    def edited(words):
        out = []
        for w in words:
            kind = rng.random()
            out += [w] if kind >= edits else [] if kind < edits / 3 else [f"n{rng.randint(0, 9999)}"] if kind < 2 * edits / 3 else [w, f"n{rng.randint(0, 9999)}"]
        return out

    docs = [["before"] * 20 + edited(w) + ["after"] * 20 for w in items]
    there = {k for k, (w, t) in enumerate(zip(items, docs, strict=True)) if decontaminate.align(*(decontaminate.word_hashes(pa.array([" ".join(x)]))[1] for x in (w, t)))[0] >= 2 * len(w) * decontaminate.LEAST}
    frames = (spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(rows)], f"{c} bigint, text string") for rows, c in ((docs, "doc_id"), (items, "item_id")))
    found = {r.doc_id for r in decontaminate.find_leaks(*frames).collect() if r.doc_id == r.item_id}
    print(edits, len(there), len(found & there))
    assert len(there) > 40 and len(found & there) >= least * len(there)


def test_blocks_of_items(spark, monkeypatch):
    d, b = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(tuple(r) for r in decontaminate.find_leaks(d, b).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 15)
    assert sorted(tuple(r) for r in decontaminate.find_leaks(d, b).collect()) == one and one


def test_an_edited_copy_is_found_beside_exact_ones(spark):
    rng = random.Random(12)
    items = [[f"w{rng.randint(0, 5000)}" for _ in range(n)] for n in (20, 40, 60)]
    edited = [[f"new{j}" if j % 5 == 4 else w for j, w in enumerate(item)] for item in items]
    docs = [(k, " ".join(["some", "words", *t, "and", "more"])) for k, t in enumerate([*edited, *items, *items])]
    b = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id bigint, text string")
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k % 3) for k in range(9)}


@pytest.mark.parametrize("seedless", [range(160), range(140, 300)])
def test_a_long_insertion_is_inside_the_region(spark, seedless):
    item = [f"w{k}" for k in range(300)]
    edited = [f"n{k}" if k in seedless and k % 3 == 1 else w for k, w in enumerate(item)]
    at = 160 if 0 in seedless else 140
    doc = ["x"] * 400 + edited[:at] + ["y"] * 120 + edited[at:] + ["z"] * 400
    score, start, end = decontaminate.align(*(decontaminate.word_hashes(pa.array([" ".join(t)]))[1] for t in (item, doc)))
    d = spark.createDataFrame([(1, " ".join(doc))], "doc_id bigint, text string")
    got = decontaminate.find_leaks(d, spark.createDataFrame([(2, " ".join(item))], "item_id bigint, text string")).collect()
    assert score >= 300 and [(r.score, r.word_start, r.word_end) for r in got] == [(score / 600, start, end)]
