"""Each operator against a plain computation, on texts with every edge case."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from noetik.llm import html_consensus, license_index, lm_automaton, lyndon_dedup, packing, quality_gbt, spotsigs, suffix_groups, tensor_minhash, wavelet, winnow

random.seed(3)
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORDS = [f"w{k}" for k in range(300)] + ["the", "of", "license", "É", "été", "日本", "MIT", "and"]
SCHEMA = "doc_id long, text string, lang string, block string, score double, sig string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sentence(n):
    return " ".join(random.choices(WORDS, k=n))


PASSAGE = sentence(40)
TEXTS = [None, "", " ", "\n\t", "a", "the", sentence(3), sentence(5), PASSAGE, PASSAGE, sentence(12) + PASSAGE + sentence(9), "ab " * 700, sentence(6000)]
BASE = [sentence(120) for _ in range(8)]
TEXTS += BASE + [b.replace(" ", "  ", 1) + " extra" for b in BASE[:4]] + [b + "x" for b in BASE[4:6]] + [sentence(60) for _ in range(40)] + ["Released under the MIT License. " + sentence(9)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(3 * k, t, "en", "x", 1.0, "y") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, column="doc_id"):
    return {r[column]: r for r in df.collect()}


def test_automaton_scores(docs, empty):
    fold = F.col("doc_id") % 4 != 0
    for order in (1, 2, 3):
        got = by_id(lm_automaton.train_and_score(docs, fold, order))
        tokens = {3 * k: (t or "").encode().lower().split() + [None] for k, t in enumerate(TEXTS)}
        counts = collections.Counter(w for i, t in tokens.items() if i % 4 for w in t)
        n, v = sum(counts.values()), len(counts)
        for i, t in tokens.items():
            r = got[i]
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(counts[w] > 0 for w in t), n, i % 4 == 0)
            assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), abs_tol=1e-6)
            assert r.score < 0
    assert lm_automaton.train_and_score(empty, fold).collect() == []


def test_automaton_is_the_smoothed_model():
    texts = [b"a b a b c", b"a b", b"", b"c c c a b a"]
    grams = lm_automaton.Grams(texts, 3)
    train = np.array([1.0, 1.0, 1.0, 0.0])
    counts = [grams.distinct(k, train)[1] for k in range(3)]
    model = {"N": int(counts[0].sum() - 3), "V": 4, "discounts": np.array([0, 0.4, 0.6, 0.7]), "unknown": 0.3, "mu": {1: 0.5, 2: 1.5}}
    automaton = lm_automaton.Automaton(grams, counts, model)
    got = automaton.score(grams)
    assert all(np.allclose(got, automaton.score(grams, n)) for n in (1, 2, 3))
    seen = collections.Counter()
    sequences = [["<s>", *t.split(), "</s>"] for t in texts]
    for s in sequences[:3]:
        for k in (1, 2, 3):
            seen.update(tuple(s[i : i + k]) for i in range(len(s) - k + 1))

    def p(w, h):
        if not h:
            c = seen[(w,)]
            return (c - model["discounts"][min(c, 3)]) / model["N"] if c else model["unknown"]
        mu, ch = model["mu"][len(h)], seen[h]
        return p(w, h[1:]) if not ch else (seen[(*h, w)] + mu * p(w, h[1:])) / (ch + mu)

    for s, g in zip(sequences, got, strict=True):
        assert math.isclose(g, sum(math.log10(p(s[i], tuple(s[max(0, i - 2) : i]))) for i in range(1, len(s))), abs_tol=1e-9)


def test_backoff_weight_is_of_all_ngrams(spark):
    chance = random.Random(5)
    for n in (1, 40):
        texts = [" ".join(chance.choices(["a", "b", "c", *(f"v{k}" for k in range(60))], k=25)) for _ in range(n)]
        seen = collections.Counter()
        for t in texts:
            w = ["<s>", *t.split(), "</s>"]
            for k in (1, 2, 3):
                seen.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        unigrams = [c for g, c in seen.items() if len(g) == 1 and g != ("<s>",)]
        stats = {(0, "N"): sum(unigrams), (0, "V"): len(unigrams)} | {(0, f"n{c}"): unigrams.count(c) for c in range(1, 5)}
        model = lm_automaton.model_of(stats, 3)
        for k in (1, 2):
            bins = collections.defaultdict(list)
            for g, c in seen.items():
                if len(g) == k:
                    bins[int(math.log2(c))].append(c)
            once = sum(c == 1 for g, c in seen.items() if len(g) == k + 1)
            low, high = 1e-2, 1e9
            for _ in range(100):
                mid = math.sqrt(low * high)
                low, high = (mid, high) if sum(sum(b) * mid / (sum(b) / len(b) + mid) for b in bins.values()) < once else (low, mid)
            model["mu"][k] = low
        grams = lm_automaton.Grams([t.encode() for t in texts], 3)
        counts = [grams.distinct(k, np.ones(n))[1] for k in range(3)]
        want = lm_automaton.Automaton(grams, counts, model).score(grams)
        got = by_id(lm_automaton.train_and_score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.lit(True), 3))
        assert np.allclose([got[i].score for i in range(n)], want, rtol=1e-9), n


def test_trees_learn_and_walk(spark, docs, empty):
    x = np.random.default_rng(0).random((3000, quality_gbt.DIM))
    y = ((x[:, 3] > 0.6) & (x[:, 7] < 0.5) | (x[:, 1] > 0.9)).astype(float)
    model = quality_gbt.fit(x[:2000], y[:2000])
    assert ((model.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    one = model.bias
    for f, c, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
        node = 0
        while node < len(f):
            node = 2 * node + 1 + (x[0, f[node]] > c[node])
        one += leaf[node - len(f)]
    assert math.isclose(one, model.raw(x[:1])[0])
    labels = spark.createDataFrame([(3 * k, k % 2) for k in range(20)] + [(0, None), (None, 1), (3, 0)], "doc_id long, quality int")
    scored = quality_gbt.score(docs, quality_gbt.learn(docs, labels, "quality"), "p").collect()
    assert len(scored) == len(TEXTS) and all(0 <= r.p <= 1 for r in scored)
    assert quality_gbt.score(empty, quality_gbt.learn(empty, labels, "quality"), "p").collect() == []


def ids_of(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    return [np.array([*e.ids, end], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_added_tokens(spark, tmp_path):
    texts = ["a<|endoftext|>b", "<|endoftext|>", "  <|endoftext|> x <|endoftext|><|endoftext|>\n", "<|endoftext", "<|endoftext|", "plain words"]
    want = ids_of(texts, 2)
    assert want[0].tolist() == [64, 50256, 65, 2]
    docs = spark.createDataFrame([(3 * k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    wavelet.write(docs, str(tmp_path / "t"), VOCABULARY)
    got, start = by_id(wavelet.read(spark, str(tmp_path / "t"))), 0
    for k, x in enumerate(want):
        assert (got[3 * k].start, got[3 * k].n_tokens, got[3 * k].ids_crc32) == (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    for r in packing.pack_documents(docs, VOCABULARY, with_ids=True).collect():
        ids = ids_of(texts, 1)[r.doc_id // 3]
        assert (r.doc_tokens, bytes(r.ids)) == (len(ids), ids[r.start : r.start + r.length].tobytes())


def test_wavelet_files(spark, docs, empty, tmp_path):
    ids = np.array([5, 0, 5, 9, 1, 5, 9], np.uint32)
    m = wavelet.WaveletMatrix(wavelet.encode(ids, np.array([1, 2]), np.array([0, 4])))
    assert m.decode().tolist() == ids.tolist() == [m.access(i) for i in range(7)]
    assert (m.count(5, 0, 7), m.count(5, 1, 5), m.count(7, 0, 7), m.count(99, 0, 7)) == (3, 1, 0, 0)
    assert [m.select(5, k) for k in range(4)] == [0, 2, 5, -1]
    chance = np.random.default_rng(6)
    for ids in (chance.integers(0, 50257, 100_000), chance.integers(0, 3, 90_000), np.repeat([7, 70_000, 1], 30_000), np.zeros(0, int)):
        m = wavelet.WaveletMatrix(wavelet.encode(ids.astype(np.uint32), np.array([4]), np.array([0])))
        assert m.decode().tolist() == ids.tolist()
        for i in chance.integers(0, max(1, len(ids)), 60 if len(ids) else 0).tolist():
            x, j = int(ids[i]), int(chance.integers(0, len(ids) + 1))
            assert m.access(i) == x and m.count(x, 0, j) == (ids[:j] == x).sum()
            k = int((ids[:i] == x).sum())
            assert m.select(x, k) == i and m.select(x, int((ids == x).sum())) == -1
    wavelet.write(docs, str(tmp_path / "t"), VOCABULARY)
    got = by_id(wavelet.read(spark, str(tmp_path / "t")))
    start = 0
    for k, x in enumerate(ids_of(TEXTS, 2)):
        r = got[3 * k]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    some = docs.where("doc_id < 30").unionByName(docs.where("doc_id between 24 and 29").withColumn("doc_id", F.lit(None).cast("long")))
    wavelet.write(some, str(tmp_path / "n"), VOCABULARY)
    rows = sorted(wavelet.read(spark, str(tmp_path / "n")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, *range(0, 30, 3)]
    assert [r.n_tokens for r in rows] == [len(x) for x in ids_of([TEXTS[8], TEXTS[9], *TEXTS[:10]], 2)]
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()
    wavelet.write(empty, str(tmp_path / "e"), VOCABULARY)
    assert wavelet.read(spark, str(tmp_path / "e")).collect() == []


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, VOCABULARY, with_ids=True).collect()
    want = dict(zip(range(0, 3 * len(TEXTS), 3), ids_of(TEXTS, 1), strict=True))
    for r in rows:
        part = want[r.doc_id][r.start : r.start + r.length].tobytes()
        assert (r.ids_crc32, r.doc_tokens, bytes(r.ids)) == (zlib.crc32(part), len(want[r.doc_id]), part)
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack_documents(empty, VOCABULARY).collect() == []


def test_slack_is_least():
    for _ in range(50):
        lengths = [random.randint(1, 30) for _ in range(random.randint(1, 12))]
        room = random.randint(1, 60)
        sums = {0}
        for x in lengths:
            sums |= {s + x for s in sums if s + x <= room}
        counts = collections.Counter(lengths)
        got = packing.closest_fill(dict(counts), sorted(counts, reverse=True), room)
        assert sum(x * n for x, n in got) == max(sums) and all(n <= counts[x] for x, n in got)
    windows = packing.pack(np.array([2048, 1000, 1048, 2000, 48, 7]))
    assert sorted(sum(windows, [])) == list(range(6)) and len(windows) == 4


def test_html():
    page = "<html><body><nav><a href=x>Menu</a></nav><div class='ad-1'>Buy</div><div class=post><h1>T &amp; t</h1><p><b>One<br><p>Two  \n words<script>var t='</p>'</script></p><div id=comments>nice</div></div><footer>end</footer>"
    assert html_consensus.extract(page, None) == "T & t\nOne\nTwo words"
    assert html_consensus.extract("", None) == "" and html_consensus.extract("<p>x<!-- open", None) == "x"


def test_names_are_hints():
    cases = {
        "<article><div class='article-header'><h1>Title</h1></div><p>Some text.</p><section class='comment-analysis'><p>real text</p></section></article>": "Title\nSome text.\nreal text",
        "<div class='post header-wide'><p>Body text</p></div>": "Body text",
        "<div class='site-header'><h1>Site</h1></div><div class=content><p>Text of it</p><div class='post-comments'><p>nice</p></div></div><div id=sidebar-left>a link</div>": "Text of it",
        "<main><header><h1>T</h1></header><p>One.</p><div class='ad-1'>Buy</div><div class='related-posts'>More</div></main>": "T\nOne.\nMore",
        "<div class=comments><p>only this</p></div>": "only this",
        "<p>a < b &amp; c<svg>d</p>e <3 <": "a < b & c\nd\ne <3 <".replace("c\nd", "cd"),
        "<p>x</p><script>never ends": "x",
        "x<!-->y<!-- z --> w</ p> v": "xy w v",
        "<p title='a>b' hidden>no</p><p title=\"a>b\">yes</p>": "yes",
        "<table><tr><td>a<td>b</table>": "a\nb",
    }
    for page, text in cases.items():
        assert html_consensus.extract(page, None) == text, page


PROSE = "Prose of the article runs on here. " * 6
LINE = PROSE.strip()


def test_article_text_is_kept():
    p = f"<p>{PROSE}</p>"
    cases = {
        "<div>" * 260 + "<nav>MENU</nav><div class='comments'>reader comment</div>" + p: LINE,
        f"<form id=aspnetForm><input type=hidden><nav>MENU</nav><div class=content><h1>T</h1>{p}</div><input type=text><button>Go</button></form>": f"T\n{LINE}",
        f"<form><input><div>{p}</div></form>": LINE,
        f"<article>{p}<form><input><button>Search</button> Find it</form></article>": LINE,
        f"<article>{p}</article><form class=x><h3>Leave a reply</h3><p>Your address will not be shown.</p><input><input><textarea></textarea><button>Post</button></form>": LINE,
        f"<article><section id=intro>{p}</section><section id=discussion><h2>Discussion</h2>{p}</section></article>": f"{LINE}\nDiscussion\n{LINE}",
        f"<article>{p}<h2 id=search>Search</h2>{p}<h3 id=comments class=notice>Comments</h3>{p}</article>": f"{LINE}\nSearch\n{LINE}\nComments\n{LINE}",
        f"<article>{p}<p class=notice id=share>Mind this.</p></article>": f"{LINE}\nMind this.",
        f"<article>{p}<p>Sum <math><mi>x</mi><mo>+</mo><mi>y</mi></math> of <object>two</object>.</p></article>": f"{LINE}\nSum x+y of two.",
        f"<article>{p}<div id=discussion class=related><a href=a>{PROSE}</a></div></article>": LINE,
    }
    for page, text in cases.items():
        assert html_consensus.extract(page, None) == text, page


def test_what_is_not_the_article_goes():
    p, more = f"<p>{PROSE}</p>", "<p>" + "I liked this very much indeed. " * 9 + "</p>"
    for other in (f"<div id=comments>{more}</div>", f"<section class=comments>{more}</section>", f"<p class=ad>{PROSE}</p>", f"<div class=notice>{more}</div>", f"<aside>{more}</aside>", f"<div class='related'>{more}</div>", f"<div id=respond><form>{more}<textarea></textarea></form></div>"):
        page = f"<body><article>{p}{other if 'comments' in other or 'ad>' in other or 'aside' in other else ''}</article>{other}</body>"
        assert html_consensus.extract(page, None) == LINE, other


def random_page(rng):
    """A page, and its article's blocks."""
    blocks, out = [], []
    word = lambda n: " ".join(rng.choice(["ring", "of", "the", "calm", "sea", "née", "5"]) for _ in range(n))
    for _ in range(rng.randrange(2, 7)):
        text = word(rng.randrange(25, 60)) + "."
        kind = rng.randrange(6)
        if kind == 0:
            out.append(f"<h2 id={rng.choice(['search', 'comments', 'share', 'x'])}>{text}</h2>")
        elif kind == 1:
            out.append(f"<ul><li>{text}</li></ul>")
        elif kind == 2:
            out.append(f"<section id={rng.choice(['discussion', 'part', 'menu'])}><p class={rng.choice(['notice', 'lead', 'x'])}>{text}</p></section>")
        else:
            out.append(f"<p>{text.replace(' of ', ' <b>of</b> ')}</p>")
        blocks.append(text)
    junk = [f"<nav>{word(5)}</nav>", f"<div class={rng.choice(['ad', 'sidebar', 'cookie-notice', 'social-share'])}>{word(30)}</div>", f"<footer>{word(9)}</footer>", f"<form><input>{word(3)}<button>go</button></form>", f"<script>var a = '<p>{word(4)}</p>'</script>"]
    rng.shuffle(junk)
    body = f"{''.join(junk[:2])}<{(t := rng.choice(['article', 'main', 'div class=content']))}>{''.join(out)}</{t.split()[0]}>{''.join(junk[2:])}"
    for _ in range(rng.randrange(3)):
        body = f"<{(t := rng.choice(['div', 'form', 'section']))}>{body}</{t}>"
    return "<div>" * rng.choice([0, 0, 300]) + body, blocks


def test_pages_with_varied_names():
    rng = random.Random(11)
    for _ in range(300):
        page, blocks = random_page(rng)
        assert html_consensus.extract(page, None) == "\n".join(blocks), page


def test_long_and_hostile_pages():
    pages = ["<script '" * 8000, "<div><p>t" * 8000, "<i><div>" + "<b>" * 9000 + "</i>" * 9000, "<div>" * 5000 + "</span>" * 20000, "<select>" * 20000, "<!--" * 20000]
    pages += ["<a " + "b=c " * 40000, "<a b='" * 20000, "<a " + "= " * 30000 + ">x", "<li>" * 20000, "&amp" * 30000, "<p>word " * 40000]
    for page in pages:
        began = time.process_time()
        html_consensus.extract(page, "html>div")
        assert time.process_time() - began < 5, page[:20]
    assert html_consensus.extract("<div><p>two" * 8000, None).count("two") == 8000
    assert html_consensus.extract("<article><p>" + "word " * 200_000, None) == ("word " * 200_000).strip()


def test_pages_without_broadcast(spark, empty):
    good, loud = "<p>" + "good words here. " * 9 + "</p>", "<p>" + "loud " * 90 + "</p>"
    rows = [(k % 700, f"http://h{0 if k % 3 else k}.org/{k}", f"<div class=story>{good}{k}</div><div class=x>{loud if k % 50 == 7 else ''}</div>") for k in range(900)] + [(None, None, None), (None, "u", ""), (1, "http://h0.org/1", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash")).withColumn("host", F.lit(1))
    shown = lambda df: sorted(df.collect(), key=str)
    assert shown(html_consensus.main_text(pages, broadcast=0)) == shown(html_consensus.main_text(pages)) and len(rows) == html_consensus.main_text(pages, broadcast=0).count()
    assert html_consensus.main_text(empty, "doc_id", "lang", "text").collect() == []
    assert html_consensus.main_text(empty, "doc_id", "lang", "text", 0).collect() == []


def test_hosts_agree(spark):
    page = lambda a, b: f"<body><div class=story>{a}</div><div class=extra>{b}</div></body>"
    rows = [(k, "http://h.org/a", page("<p>" + "good words here. " * 9 + "</p>", "<p>x</p>")) for k in range(5)]
    rows += [(9, "http://h.org/b", page("<p>short</p>", "<p>" + "loud " * 90 + "</p>")), (10, None, None), (11, "http://e.org", "")]
    got = by_id(html_consensus.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert got[9].text == "short" and got[10].text == "" and got[11].n_chars == 0 and len(got) == 8


def test_pages_of_several_sections(spark):
    long, short = "Many good words stand here. " * 7, "Some more words. " * 5
    pages = {
        "main": (f"<body><nav>a menu</nav><main><section><p>{long}</p></section><section><p>{short}</p></section></main><footer>the end</footer></body>", [long, short]),
        "table": (f"<body><div class=content><p>{short}</p><table><tr><td>{long}</td></tr></table><p>Last words.</p></div></body>", [short, long, "Last words."]),
        "articles": (f"<body><article><p>{short}</p></article><article><p>{long}</p></article><div class=ad>buy this now</div></body>", [short, long]),
        "unspaced": (f"<body><div class=a><p>{long}</p></div><div class=b><p>日本語の文章。</p></div></body>", [long, "日本語の文章。"]),
        "nested": (f"<body><div><div><div class=a><p>{long}</p></div></div><div class=b><p>{short}</p></div></div></body>", [long, short]),
    }
    rows = [(3 * k + n, f"http://{h}.org/{n}", page) for k, (h, (page, _)) in enumerate(pages.items()) for n in range(3)]
    got = by_id(html_consensus.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    for k, (_, parts) in enumerate(pages.values()):
        for n in range(3):
            assert got[3 * k + n].text == "\n".join(p.strip() for p in parts)


def test_spotsigs(docs, empty):
    got = by_id(spotsigs.edited(docs))
    order = sorted(range(len(TEXTS)), reverse=True)
    for at, k in enumerate(order):
        t, nxt = TEXTS[k] or "", TEXTS[order[(at + 1) % len(order)]] or ""
        want = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert (got[3 * k].n_chars, got[3 * k].edited_sha256) == (len(t), hashlib.sha256(want.encode()).hexdigest())
        if want == t:
            assert got[3 * k].near_edited == 1 and got[3 * k].fingerprint == got[3 * k].edited_fingerprint
    assert got[24].fingerprint == got[27].fingerprint
    assert spotsigs.edited(empty).collect() == []
    pairs, members = spotsigs.near_duplicates(docs, 0.8)
    sets = {r.doc_id: {r.fingerprint[i : i + 8] for i in range(0, len(r.fingerprint), 8)} for r in got.values()}
    reps = {r.id: r.rep for r in members.collect()}
    wanted = {(a, b) for a in set(reps.values()) for b in set(reps.values()) if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in pairs.collect()} == wanted


def test_spot_signatures_are_those_of_the_method(spark):
    texts = [None, "", "the", "one word", "A lengthy passage of eleven rare words without any anchor the", sentence(400), PASSAGE, "the " * 30 + "x y z", "the a b c d e f g h i j the"]
    words = [WORD.findall(lower(t)) for t in texts]
    schema = "doc_id long, text string, w array<string>"
    table = spark.createDataFrame(list(zip(range(len(texts)), texts, words, strict=True)), schema)
    codes = by_id(table.select("doc_id", spotsigs.coded(F.col("w")).alias("c")))
    want = []
    for k, w in enumerate(words):
        c, chains = codes[k].c, set()
        assert [x % 2 for x in c] == [int(x in spotsigs.ANCHORS) for x in w]
        for i, x in enumerate(c):
            near = [y for y in c[i + 1 : i + 1 + spotsigs.REACH] if y % 2 == 0][: spotsigs.CHAIN]
            if (x % 2 or (x >> 1) % spotsigs.SPARE == 0) and len(near) == spotsigs.CHAIN:
                chains.add((x, *near))
        want.append((k, [list(y) for y in sorted(chains)], c))
    hashed = spark.createDataFrame(want, "doc_id long, chains array<array<long>>, c array<long>")
    hashed = hashed.select("doc_id", F.when(F.size("chains") == 0, F.array(F.hash("c"))).otherwise(F.array_sort(F.array_distinct(F.transform("chains", lambda x: F.hash(x[0], x[1], x[2]))))).alias("s"))
    wanted, got = by_id(hashed), by_id(spotsigs.fingerprinted(table.select("doc_id", "text"), "text", "sig"))
    assert {k: r.s for k, r in wanted.items()} == {k: r.sig for k, r in got.items()} and len(got[5].sig) > 50
    edited = by_id(spotsigs.edited(table.select("doc_id", "text")))
    order = sorted(range(len(texts)), reverse=True)
    sets = {k: set(r.sig) for k, r in got.items()}
    for at, k in enumerate(order):
        nxt = sets[order[(at + 1) % len(order)]]
        assert math.isclose(edited[k].near_next, len(sets[k] & nxt) / len(sets[k] | nxt))
        assert edited[k].fingerprint == "".join(f"{x & 0xFFFFFFFF:08X}" for x in got[k].sig)


def test_decontamination(spark, docs, empty):
    items = [(1, PASSAGE), (2, " ".join(BASE[0].split()[10:17])), (3, None), (4, "..."), (5, "w1 the"), (1, PASSAGE), (6, "zz " * 30), (7, "ab " * 20)]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(winnow.digest(winnow.contamination(docs, table)))
    for k, t in enumerate(TEXTS):
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for i, x in items:
            q = WORD.findall(lower(x))
            m = min(13, len(q))
            windows = {tuple(q[s : s + m]) for s in range(len(q) - m + 1)} if q else set()
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in windows:
                    hit |= set(range(s, s + m))
                    found.add(str(i))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        r = got[3 * k]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)), k
    assert winnow.contamination(empty, table).collect() == []
    assert all(r.n_hit == 0 for r in winnow.contamination(docs, table.limit(0)).collect())


def test_licences(docs, empty):
    got = by_id(license_index.scan(docs))
    for k, t in enumerate(TEXTS):
        w, places, labels = WORD.findall(lower(t)), [], set()
        for phrase, label in license_index.BASE.items():
            q = phrase.split()
            own = [s for s in range(len(w) - len(q) + 1) if w[s : s + len(q)] == q]
            places += own
            labels |= {label} if own else set()
        r = got[3 * k]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None)) and 0 <= r.score <= 1
    assert license_index.scan(empty).collect() == []


def test_licence_texts(spark):
    wording = [license_index.template_words(t) for _, _, t in license_index.TEMPLATES]
    assert all(re.search(r"(?:^| )" + p + r"(?: |$)", " ".join(w)) for (_, phrases, _), w in zip(license_index.TEMPLATES, wording, strict=True) for p in phrases)
    texts = [sentence(20) + "\n" + t + "\n" + sentence(30) for _, _, t in license_index.TEMPLATES]
    chance = random.Random(2)
    for _, _, t in license_index.TEMPLATES:  # some words are others
        texts.append(sentence(5) + " " + " ".join(w if chance.random() > 0.15 else "other" for w in t.split()))
    texts += ["this is not under the mit license", "mit license", "the apache license and the mit license", " ".join(t for _, _, t in license_index.TEMPLATES), "permission is hereby granted without restriction", None, ""]
    texts += [" ".join(license_index.TEMPLATES[1][2].split()[:25]) + " without restriction " + sentence(400)]
    got = by_id(license_index.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for k, text in enumerate(texts):
        w, labels, best = WORD.findall(lower(text)), set(), 0.0
        line = f" {' '.join(w)} "
        for (label, phrases, _), parts in zip(license_index.TEMPLATES, wording, strict=True):
            if all(f" {p} " in line for p in phrases):
                share = max(sum(0 <= s + j < len(w) and w[s + j] == x for j, x in enumerate(parts)) for s in range(-len(parts), len(w))) / len(parts)
                if share >= license_index.LEAST:
                    labels.add(label)
                    best = max(best, share)
        base = {v for p, v in license_index.BASE.items() if f" {p} " in line}
        if k < 2 * len(wording) or k >= len(texts) - 8:
            assert set(got[k].labels.split(",")) - {""} == labels | base, (k, text)
            assert math.isclose(got[k].score, best), (k, text)
    assert got[2 * len(wording)].score == 0.8 and got[0].score == 1


def test_near_duplicates(docs, empty):
    got = by_id(tensor_minhash.near_duplicates(docs, 4))
    sets = {}
    for k, t in enumerate(TEXTS):
        w = (t or "").encode().lower().split()
        n = min(4, len(w))
        sets[3 * k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), group[i], group[i] == i) for i, s in sets.items()}
    assert tensor_minhash.near_duplicates(empty).collect() == []


def test_links_between_blocks():
    chance = np.random.default_rng(1)
    sets = [np.unique(chance.integers(0, 40, chance.integers(5, 40)).astype(np.uint64)) for _ in range(120)]
    sets += [np.arange(100, dtype=np.uint64), np.arange(2, 100, dtype=np.uint64)] * 9
    n = len(sets)
    for block, outside in [(np.zeros(n, int), np.ones(n, bool)), (np.arange(n) % 2, np.arange(n) % 2 == 0)]:
        want = {(x, y) for x in range(n) for y in range(x) if (block[x] != block[y] or not block.any()) and 100 * (c := len(np.intersect1d(sets[x], sets[y]))) >= 60 * (len(sets[x]) + len(sets[y]) - c)}
        got = tensor_minhash.links_between(sets, list(range(n)), block, outside, 60)
        assert {(y, x) for x, y in got} <= want and len(got) < n
        group = {}
        for links in (got, want):
            top = list(range(n))
            for _ in range(n):
                for x, y in links:
                    top[x] = top[y] = min(top[x], top[y])
            group[id(links)] = top
        assert group[id(got)] == group[id(want)]


def test_crossing_blocks(spark, monkeypatch):
    monkeypatch.setattr(tensor_minhash, "BLOCK_SETS", 3)
    chance = np.random.default_rng(2)
    sets = {k: np.sort(np.append(np.arange(90), 1000 + chance.choice(30, 12, replace=False))).astype(np.uint64) for k in range(40)}
    label = {k: 0 if k < 15 else k for k in sets}
    rows = spark.createDataFrame([(k, len(s), label[k], 7) for k, s in sets.items()], "node long, n long, c long, u long")
    stored = spark.createDataFrame([(k, s.view(np.int64).tolist()) for k, s in sets.items()], "node long, s array<long>")
    found = {tuple(sorted((r.a, r.b))) for r in tensor_minhash.crossing(rows, stored, 87).collect()}
    mixed = spark.createDataFrame([(k, len(s), label[k], [7]) for k, s in sets.items()], "node long, n long, c long, us array<long>")
    assert {x for link in found for x in link} <= {r.node for r in tensor_minhash.possible(mixed, stored, 87).collect()}
    alike = {(x, y) for x in sets for y in sets if x < y and label[x] != label[y] and 100 * (c := len(np.intersect1d(sets[x], sets[y]))) >= 87 * (204 - c)}
    assert found and found <= alike

    def classes(links):
        top = dict(label)
        for _ in sets:
            for x, y in links:
                top = {k: min(top[x], top[y]) if t in (top[x], top[y]) else t for k, t in top.items()}
        return top

    assert classes(found) == classes(alike)


def test_stars_are_connected(spark, monkeypatch):
    chance = np.random.default_rng(4)
    sets = {k: np.sort(np.append(np.arange(100), 1000 + chance.choice(60, 9, replace=False))).astype(np.uint64) for k in range(50)}
    stored = spark.createDataFrame([(k, s.view(np.int64).tolist()) for k, s in sets.items()], "node long, s array<long>")
    stars = {k: sorted(set(chance.choice(6, 3).tolist()) - {k}) for k in sets}
    table = spark.createDataFrame([(k, len(sets[k]), c) for k, c in stars.items() if c], "node long, n long, centres array<long>")
    wanted = [(k, y) for k, some in stars.items() for y in some if tensor_minhash.linked(sets[k], sets[y], 87)]
    for size in (256, 4):
        monkeypatch.setattr(tensor_minhash, "STAR_SETS", size)
        found = [(r.a, r.b) for r in tensor_minhash.star_links(table, stored, 87).collect()]
        assert wanted and set(found) <= set(wanted)

        def tops(links):
            forest = tensor_minhash.Forest()
            for x, y in links:
                forest.join(x, y)
            return [[forest.top(x) == forest.top(y) for x in sets] for y in sets]

        assert tops(found) == tops(wanted)


def test_hot_group_of_near_copies(spark):
    chance = random.Random(8)
    base = [f"b{k}" for k in range(60)]
    texts = []
    for k in range(300):
        words = list(base)
        for at in chance.sample(range(60), chance.choice([0, 1, 1, 2, 3, 5])):
            words[at] = f"x{k}-{at}" if chance.random() < 0.8 else f"y{chance.randrange(9)}"
        texts.append(" ".join(words))
    texts += [" ".join(chance.choices(base, k=60)) for _ in range(60)] + texts[:30]
    rows = [(None if k == 7 else 1000 - k if k != 20 else 985, t) for k, t in enumerate(texts)]
    got = tensor_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    hashed = {r[1]: r.text_hash for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.xxhash64("text").alias("text_hash")).collect()}
    sets = [{tuple(t.split()[i : i + 4]) for i in range(57)} for t in texts]
    forest = tensor_minhash.Forest()
    for x in range(len(sets)):
        for y in range(x):
            if 100 * (c := len(sets[x] & sets[y])) >= 80 * (len(sets[x]) + len(sets[y]) - c):
                forest.join(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[forest.top(k)] = min(i, least.get(forest.top(k), i))
    want = collections.Counter((i, hashed[t], least.get(forest.top(k))) for k, (i, t) in enumerate(rows))
    assert collections.Counter((r.doc_id, r.text_hash, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101)], "a long, b long")
    assert {r.id: r.component for r in tensor_minhash.components(links).collect()} == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100}


def test_suffix_arrays():
    for t in [b"", b"a", b"banana", b"aaaa"] + [bytes(random.choices(b"ab", k=random.randint(1, 60))) for _ in range(100)]:
        assert suffix_groups.construct(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_repeated_bytes_of_few_letters(spark):
    chance = random.Random(11)
    base = ["".join(chance.choices("ab", k=260)) for _ in range(4)] + ["a" * 400, "ab" * 200, "aab" * 90]
    texts = []
    for _ in range(60):
        x, y = chance.choice(base), chance.choice(base)
        i, j = chance.randrange(200), chance.randrange(200)
        texts.append(x[i:] + "".join(chance.choices("ab", k=chance.randrange(40))) + y[:j])
    got = by_id(lyndon_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    seen = set()
    for k, t in enumerate(texts):
        b, gone = t.encode(), np.zeros(len(t), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        assert bytes(got[k].kept) == np.frombuffer(b, np.uint8)[~gone].tobytes(), k


@pytest.mark.parametrize("heavy", [lyndon_dedup.HEAVY, 1, 0])
def test_repeated_bytes(docs, empty, heavy):
    got = by_id(lyndon_dedup.dedup(docs, digest=True, heavy=heavy))
    seen = set()
    for k, t in enumerate(TEXTS):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        kept = hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()
        r = got[3 * k]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept) == (len(b), gone.sum(), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), kept), k
    assert lyndon_dedup.dedup(empty).collect() == []


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "the same words of a text and more " * 5), (1, "the same words of a text and more " * 5), (None, "x y z"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "same words of a")], "item_id long, text string")
    for out in (lyndon_dedup.dedup(df), tensor_minhash.near_duplicates(df), license_index.scan(df), winnow.contamination(df, items), spotsigs.edited(df), lm_automaton.train_and_score(df, F.col("doc_id") == 1)):
        assert out.count() == 4


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    larger = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    kept = [r.doc_id for r in corpus_pipeline.quality(spark, docs, larger).select("doc_id").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    assert sum(labels[i] == 0 for i in kept if i in labels) <= 0.1 * sum(q == 0 for q in labels.values())
    assert sum(q == 1 for q in labels.values()) - sum(labels[i] == 1 for i in kept if i in labels) <= 4
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
