"""Language models, classifiers, extraction and the media codec."""

import hashlib
import html
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarrylog.llm import extract, flac, language, quality, toxicity
from quarrylog.llm._text import chunks

SF = "/root/testdata/sf0.01"


def scores(fn, texts):
    return np.concatenate([fn(data, offsets) for _, _, data, offsets in chunks(pa.array(texts, pa.string()))])


def brute_kn(texts, order, vocabulary):
    """Interpolated Kneser-Ney by dictionaries over symbol tuples padded with gaps."""
    from collections import Counter, defaultdict

    high = Counter()
    for t in texts:
        padded = (0,) * (order - 1) + tuple(t)
        for i in range(len(t)):
            high[padded[i : i + order]] += 1
    tables = {order: high}
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])

    def prob(g):
        if not g:
            return 1 / vocabulary
        counts = tables[len(g)]
        once, twice = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
        d = once / (once + 2 * twice) if once and twice else 0.5
        total, kinds = totals[len(g)][g[:-1]], distinct[len(g)][g[:-1]]
        if not total:
            return prob(g[1:])
        return max(counts[g] - d, 0) / total + d * kinds / total * prob(g[1:])

    totals, distinct = defaultdict(Counter), defaultdict(Counter)
    for n, counts in tables.items():
        for g, c in counts.items():
            totals[n][g[:-1]] += c
            distinct[n][g[:-1]] += 1
    return prob


def brute_symbols(text):
    """Lower-cased letters, and one 0 for each run of anything else."""
    out = []
    for c in text:
        s = c.lower() if c.isalpha() else 0
        if s or not out or out[-1]:
            out.append(s)
    return out


def test_kneser_ney_is_the_textbooks():
    texts = ["the cat sat. ", "that hat", "a cat?! a hat", "then", "Cat that sat", "кот сидел", "猫が座る。猫", "and more of THE cats"]
    labels = ["x", "x", "x", "x", "x", "y", "y", "y"]
    model = language.fit(texts, labels)
    vocabulary = len({s for t in texts for s in brute_symbols(t)}) + 2
    for own in model.languages:
        mine = [t for t, y in zip(texts, labels, strict=True) if y == own.name]
        learned = [t for i, (t, y) in enumerate(zip(texts, labels, strict=True)) if y == own.name and i % language.CALIBRATE_EVERY != language.CALIBRATE_EVERY - 1]
        prob = brute_kn([brute_symbols(t) for t in learned], language.ORDER, vocabulary)
        for t in [*mine, "что нового", "zzz q", "", "a", "ab"]:
            _, _, data, offsets = next(chunks(pa.array([t])))
            got = own.log2(language.grams(*language.symbols_of(*language.letters_of(data, offsets))))
            s = brute_symbols(t)
            padded = [0] * (language.ORDER - 1) + s
            want = np.array([np.log2(max(prob(tuple(padded[i : i + language.ORDER])), 1e-12)) for i in range(len(s))])
            assert np.allclose(got, want, atol=1e-3), t


SCRIPTS = {
    "zh": "今天天气很好我们一起去公园散步然后回家吃饭晚上看书学习新的知识明天还要上班工作",
    "ja": "今日は天気がいいので公園へ散歩に行きましたそれから家に帰って本を読みながらご飯を食べました",
    "ko": "오늘은 날씨가 좋아서 공원에 산책을 갔습니다 그리고 집에 돌아와서 책을 읽고 밥을 먹었습니다",
    "ru": "сегодня хорошая погода и мы пошли гулять в парк потом вернулись домой и читали книги весь вечер",
    "uk": "сьогодні гарна погода і ми пішли гуляти до парку потім повернулися додому та читали книжки весь вечір",
    "el": "σήμερα ο καιρός είναι καλός και πήγαμε βόλτα στο πάρκο μετά γυρίσαμε σπίτι και διαβάσαμε βιβλία",
    "ar": "اليوم الطقس جميل وذهبنا للتنزه في الحديقة ثم عدنا إلى البيت وقرأنا الكتب طوال المساء",
    "th": "วันนี้อากาศดีเราไปเดินเล่นที่สวนสาธารณะแล้วกลับบ้านอ่านหนังสือและกินข้าวเย็นด้วยกัน",
    "he": "היום מזג האוויר יפה והלכנו לטייל בפארק ואחר כך חזרנו הביתה וקראנו ספרים כל הערב",
    "hi": "आज मौसम अच्छा है और हम पार्क में टहलने गए फिर घर लौटकर पूरी शाम किताबें पढ़ते रहे",
}


def test_languages_of_any_script(spark):
    rng = np.random.default_rng(8)

    def pieces(text, n, size):
        return ["".join(text[i : i + size] for i in rng.integers(0, max(1, len(text) - size), 4)) for _ in range(n)]

    train = [(p, y) for y, t in SCRIPTS.items() for p in pieces(t, 30, 14)]
    model = language.fit([t for t, _ in train], [y for _, y in train])
    held = [(i, t, y) for i, (t, y) in enumerate((p, y) for y, text in SCRIPTS.items() for p in pieces(text, 12, 12))]
    df = spark.createDataFrame(held, "doc_id long, text string, lang string")
    rows = language.predict(df, model, carry=("lang",)).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98


def test_many_languages_and_rare_ones_are_sampled(spark):
    docs = [(i, f"text {i} of the large one", "aa") for i in range(2000)] + [(5000 + i, f"rare {i}", "zz") for i in range(5)] + [(6000, "x" * 500_000, "zz")] + [(7000 + i, f"tongue {i}", f"l{i:03d}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    sample = language.training_sample(df, "doc_id", "text", "lang", texts=100, size=10_000)
    labels = [y for _, y in sample]
    assert len(set(labels)) == 302 and labels.count("zz") == 6 and labels.count("aa") < 60
    assert language.training_sample(df.filter("doc_id < 0"), "doc_id", "text", "lang") == []


def test_long_texts_give_the_sample_pieces(spark):
    docs = [(i, "é" * 30_000 + f" {i} ", f"l{i % 40:02d}") for i in range(800)] + [(900, "short", "l00"), (901, None, "l00")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3).selectExpr("*", "1 as piece", "'r' as rate")
    sample = language.training_sample(df, "doc_id", "text", "lang", texts=100, size=1_000_000)
    by_label = Counter(y for _, y in sample)
    assert len(by_label) == 40 and {len(t) for t, _ in sample} == {1250, 5}
    assert max(sum(len(t.encode()) for t, y in sample if y == label) for label in by_label) <= 4 * 1_000_000 / 40
    assert sample == language.training_sample(df.repartition(2), "doc_id", "text", "lang", texts=100, size=1_000_000)


def test_equal_languages_go_to_the_first_by_code_point(spark):
    texts = ["some words of a text", "other words in a text"] * 6
    model = language.fit(texts * 2, ["b"] * 12 + ["a"] * 12)
    df = spark.createDataFrame([(1, "some words"), (1, "some words"), (2, "x" * 100_000)], "doc_id long, text string").selectExpr("*", "1 as found", "2 as c0")
    rows = language.predict(df, model, carry=("found",)).collect()
    assert [r.lang_pred for r in rows if r.doc_id == 1] == ["a", "a"] and {abs(r.score - 0.5) < 1e-9 for r in rows} == {True}


def test_language_of_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sample = language.training_sample(docs.filter("doc_id % 3 <> 0"), "doc_id", "text", "lang", texts=400)
    model = language.fit([t for t, _ in sample], [y for _, y in sample])
    extra = [(1, None, "en"), (2, "", "en"), (3, "123 !!! ###", "de"), (4, "qzxj vkwq zzxq jjqx wvvk qxzj kqjw zxvq " * 20, None)]
    held = docs.filter("doc_id % 3 = 0").select("doc_id", "text", "lang").union(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    rows = language.predict(held.selectExpr("*", "1 as key", "2 as score"), model, carry=("lang",)).collect()
    real, made = rows[:-4], {r.doc_id: r for r in rows[-4:]}
    assert np.mean([r.lang == r.lang_pred for r in real]) > 0.99 and np.mean([r.rejected for r in real]) < 0.01
    assert all(made[i].lang_pred == "und" and made[i].score == 0 and made[i].rejected for i in (1, 2, 3)) and made[4].rejected
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in language.predict(held.limit(3), None).collect()} == {"und"}
    assert language.predict(held.limit(0), model).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("doc_id", "text", "quality", "toxic").collect()
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5]
    return train, [r for r in rows if not zlib.crc32(str(r.doc_id).encode()) % 5]


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / (y == 1).sum() / (y == 0).sum()


def test_quality_on_held_out_texts(labelled):
    train, held = labelled
    some = sorted([(r.text, r.quality) for r in train if r.quality == 0][:300] + [(r.text, r.quality) for r in train if r.quality == 1][:300])
    net = quality.fit([t for t, _ in some], [y for _, y in some], 0.85)
    y = np.array([r.quality for r in held])
    s = scores(net.score, [r.text for r in held])
    assert auc(s, y) > 0.97 and np.mean((s >= 0.3) == y) > 0.93
    whole = "A plain text of words. " * 400
    assert scores(net.score, [whole + "junk*** of&&& it%%% all### " * 400]) < scores(net.score, [whole])  # the end counts too
    odd = scores(net.score, ["", None, "x", whole, whole])
    assert ((odd >= 0) & (odd <= 1)).all() and odd[0] == odd[1] and odd[3] == odd[4]


def test_toxicity_on_held_out_texts(labelled):
    train, held = labelled
    some = sorted([(r.text, r.toxic) for r in train if r.toxic == 1] + [(r.text, r.toxic) for r in train if r.toxic == 0][:800])
    machine = toxicity.fit([t for t, _ in some], [y for _, y in some], 0.11)
    y = np.array([r.toxic for r in held])
    s = scores(machine.score, [r.text for r in held])
    assert auc(s, y) > 0.9 and np.mean((s >= 0.5) == y) > 0.93
    plain, exact, spaced, gapped = scores(machine.score, ["a clean text", "you idiot there", "you i d i o t there", "you idiiot there"])
    assert exact > 0.5 and abs(spaced - exact) < 1e-9 and plain < gapped < exact
    odd = scores(machine.score, ["", None, "x" * 3000, "\n"])
    assert odd[0] == odd[1] and (odd < 0.5).all()


def test_classifiers_without_labels(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(docs, quality.train(docs, none)).collect()} == {0.5}
    assert {r.predicted for r in toxicity.classify(docs, toxicity.train(docs, none)).collect()} == {0}
    assert quality.fit([], [], 0.5) is None and toxicity.fit(["a"], [1], 0.5) is None


def brute_word_kernel(a, b):
    """Normalised count of shared ordered letter triples, each weighted by DECAY ** span, to the power POWER."""
    from collections import Counter

    def triples(w):
        marked, out = ["begin", *w, "end"], Counter()
        for i in range(len(marked)):
            for k in range(i + 2, min(i + toxicity.SPAN, len(marked))):
                for j in range(i + 1, k):
                    out[marked[i], marked[j], marked[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    one, two = triples(a), triples(b)
    size = lambda t: sum(v * v for v in t.values()) ** 0.5
    return (sum(v * two[x] for x, v in one.items()) / (size(one) * size(two))) ** toxicity.POWER


def test_sentence_values_are_sums_of_the_kernel():
    marks = ["moron", "idiot", "clown"]
    text = np.array([ord(c) for c in "".join(marks)], np.uint32)
    end = np.cumsum([len(w) for w in marks])
    machine = toxicity.Machine([toxicity.Landmarks(text, end[:2] - 5, end[:2]), toxicity.Landmarks(text, end[2:] - 5, end[2:])], np.array([1.0, 2.0, -0.5]), -0.25)
    texts = ["You moron! Such an idi-ot, clown clown. Fine", "a table of m o r o n words\nidiiot", "", "nothing here", "idiot " * 41 + "moron"]
    sentences = [[["you", "moron"], ["such", "an", "idiot", "clown"], ["fine"]], [["a", "table", "of", "moron", "words"], ["idiiot"]], None, [["nothing", "here"]], [["idiot"], ["idiot", "moron"]]]

    def word(w):
        near = [brute_word_kernel(w, m) for m in marks]
        return near[0] + 2 * near[1] - 0.5 * near[2] if max(near[:2]) >= toxicity.NEAR**toxicity.POWER else 0.0

    want = [machine.floor if s is None else max(sum(word(w) for w in set(x)) - 0.25 for x in s) for s in sentences]
    _, _, data, offsets = next(chunks(pa.array(texts), 1 << 20))
    assert np.allclose(machine.text_values(data, offsets), want, atol=1e-4)


def test_classes_missing_ties_and_odd_tables(spark):
    docs = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "word " * 50_000), (None, "x")], "doc_id long, text string").selectExpr("*", "0.5 as score", "1 as key", "'h' as held_out")
    ones = spark.createDataFrame([(i, 1, 1) for i in range(1, 4)], "doc_id long, quality int, toxic int")
    zeros = ones.selectExpr("doc_id", "0 as quality", "0 as toxic")
    assert {r.score for r in toxicity.classify(docs, toxicity.train(docs, ones)).collect()} == {1.0}
    assert {r.score for r in toxicity.classify(docs, toxicity.train(docs, zeros)).collect()} == {0.0}
    texts = ["you idiot and moron", "a fine day of words"] * 10
    for module, model in ((toxicity, toxicity.fit(texts, [1, 0] * 10, 0.5)), (quality, quality.fit(texts, [1, 0] * 10, 0.5))):
        rows = module.classify(docs, model).collect()
        same = {r.score for r in rows if r.doc_id in (1, None)}
        assert len(rows) == 5 and len(same) == 1 and all(0 <= r.score <= 1 for r in rows)
        assert module.classify(docs.limit(0), model).count() == 0


def test_candidates_leave_out_no_near_word_and_most_others():
    rng = random.Random(8)
    marks = ["moron", "idiot", "banana", "aaaaaaaa", "clown" * 4]
    words = [*marks, "a", "xyz", "bananananana", "aaaa", "m" * 24, "moroon", "mron"]
    words += ["".join(rng.choice("moridtcwna") for _ in range(rng.randrange(1, 25))) for _ in range(9000)]
    words += ["".join(rng.choice("bcefghjkqsuvxyz") for _ in range(rng.randrange(1, 25))) for _ in range(9000)]
    rng.shuffle(words)
    code = lambda some: (np.array([ord(c) for c in "".join(some)], np.uint32), np.cumsum([0, *map(len, some)]))
    own, at = code(marks)
    sets = [toxicity.Landmarks(own, at[:4], at[1:5]), toxicity.Landmarks(own, at[4:5], at[5:])]
    text, edge = code(words)
    whole = np.concatenate([m.kernel(text, edge[:-1], edge[1:]) for m in sets], 1)
    near = np.flatnonzero(whole[:, :4].max(1) >= toxicity.NEAR**toxicity.POWER)
    found = sets[0].candidates(text, edge[:-1], edge[1:])
    assert set(near) <= set(found) and len(near) > 20 and len(found) < len(words) / 4
    rows, values = toxicity._kernels(sets, text, edge[:-1], edge[1:])
    assert rows.tolist() == near.tolist() and np.allclose(values, whole[near], atol=1e-6)
    assert len(sets[0].candidates(text, edge[:0], edge[:0])) == 0


def test_string_kernel_prefers_the_nearer_word():
    marks = np.array([ord(c) for c in "moron"], np.uint32)
    kernel = toxicity.Landmarks(marks, np.array([0]), np.array([5]))
    words = ["moron", "moroon", "mxoron", "moon", "table"]
    text = np.array([ord(c) for c in "".join(words)], np.uint32)
    end = np.cumsum([len(w) for w in words])
    k = kernel.kernel(text, end - [len(w) for w in words], end)[:, 0]
    assert abs(k[0] - 1) < 1e-5 and k[0] > k[1] > k[2] > k[4] == 0


PAGE = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad -->'
    '<div class="ad">Buy this now.</div><div id="cookie-notice">We use cookies.</div><article><h1>A &amp; B</h1>{}<aside>Related</aside></article><section class="comments"><p>first!</p></section><form><p>Sign up</p></form><footer>&copy; x'
)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE.format("<p>One\n  two.<p><b>Three<br><p>It.</p>"), "A & B\nOne two.\nThree\nIt."),
        (None, ""), ("", ""), ("<html></html>", ""), ("just text", "just text"), ("a < b and c", "a < b and c"),
        ("<div class=menu><a>x</a></div><div><p>" + "long text " * 20 + "</p><p>end.</p></div>", ("long text " * 20).strip() + "\nend."),
        ("<main><p>kept</p><div role='complementary'>gone</div></main><div>outside</div>", "kept"),
        ("<article><p>x</p><script>if (a<b) {", "x"), ("<nav><a>never closed<article><p>kept</p></article>", "kept"), ("<p>&#x41;&eacute;&am &amp</p>", "Aé&am &"),
        ("<ul><li><a>A</a></li><li><a>B</a></li></ul><p>words of the only paragraph</p>", "words of the only paragraph"),
    ],
)
def test_main_text(page, text):
    assert extract.main_text(page) == text


LONG = ("long text " * 20).strip()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # no article or main: short runs that belong to the text stay
        (f"<div><p>{LONG}</p><div class=ad>Buy</div><p>The end.</p></div><nav>x</nav><div>Copyright</div>", f"{LONG}\nThe end."),
        (f"<div><p>{LONG}</p><aside>x</aside><h2>Then</h2><aside>y</aside><p>{LONG}</p></div>", f"{LONG}\nThen\n{LONG}"),
        (f"<nav><a>Home</a></nav><div><span>Teaser</span></div><nav>x</nav><section><p>{LONG}</p></section><footer>f</footer><div>Terms</div>", LONG),
        # the windows choose the text where it is not what is marked
        (f"<article></article><div><p>{LONG}</p></div>", LONG),
        (f"<main><div><p>{LONG}</p></div><aside>x</aside></main><article><h3>Teaser</h3></article>", f"{LONG}\nTeaser"),
        (f"<article><p>{LONG}</p><aside>x</aside><p>End.</p></article><div>short outside</div>", f"{LONG}\nEnd."),
    ],
)
def test_windows_choose_the_text(page, text):
    assert extract.main_text(page) == text


P1, P2, P3 = (f"<p>{x} " + "words of the text go on " * 6 + "and end.</p>" for x in ("First", "Second", "Third"))
T1, T2, T3 = (p[3:-4] for p in (P1, P2, P3))
NAV = '<ul class="links"><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul>'
TEASERS = "".join(f'<article class="card"><h3><a href="/{i}">Story {i}</a></h3><p>A teaser of story {i}, with some more words.</p></article>' for i in range(4))
SHAPES = {
    "class words on the article": (f'<article class="post comment-open">{P1}{P2}</article>', [T1, T2]),
    "a report on share prices": (f'<div id="share-price-report">{P1}{P2}</div>', [T1, T2]),
    "sidebar in a wrapper's class": (f'<div class="layout has-sidebar"><article>{P1}{P2}</article></div><footer>Imprint</footer>', [T1, T2]),
    "nav in a wrapper's class": (f'<div class="nav-open"><main>{P1}{P2}</main></div>', [T1, T2]),
    "notice in the id": (f'<div id="notice-of-meeting"><h1>Notice</h1>{P1}</div><div class="cookie-notice">We use cookies here.</div>', ["Notice", T1]),
    "a wrapper called widget": (f'<div class="elementor-widget-theme"><div>{P1}{P2}{P3}</div></div>', [T1, T2, T3]),
    "header with title and lead": (f"<header>Site name</header><article><header><h1>Title</h1><p>The lead.</p></header>{P1}</article>", ["Title", "The lead.", T1]),
    "footer in the article": (f"<article>{P1}<footer>By someone</footer></article>", [T1]),
    "teaser list after the article": (f"<main><article><h1>Title</h1>{P1}{P2}{P3}</article><section><h2>More</h2>{TEASERS}</section></main>", ["Title", T1, T2, T3]),
    "teaser list before the article": (f"<div>{TEASERS}</div><article>{P1}{P2}{P3}</article>", [T1, T2, T3]),
    "two articles of one size": (f"<article>{P1}{P2}</article><article>{P3}{P1}</article>", [T1, T2, T3, T1]),
    "article in a comment": (f"<!-- <article> --><div>{P1}{P2}</div><!-- </article> --><div>Terms</div>", [T1, T2]),
    "article in a script": (f'<script>document.write("<article>x</article>")</script><div>{P1}</div>', [T1]),
    "no article, div soup": (f'{NAV}<div class="c1"><div class="c2"><h1>Title of it</h1>{P1}{P2}</div></div><div>Imprint</div>', ["Title of it", T1, T2]),
    "links between paragraphs": (f'<div>{P1}<p><a href="/x">Read also this</a></p>{P2}</div>', [T1, T2]),
    "a linked heading in the article": (f'<article><h1><a href="/x">Title</a></h1>{P1}</article>', ["Title", T1]),
    "advert between paragraphs": (f'<article>{P1}<div class="ad-banner">Buy this now, it is very cheap and good.</div>{P2}</article>', [T1, T2]),
    "related box in the article": (f'<article>{P1}<div class="related-stories">See also: another story.</div><p>End.</p></article>', [T1, "End."]),
    "a section on sharing": (f'<article>{P1}<section id="share-of-votes">{P2}</section></article>', [T1, T2]),
    "reader comments": (f'<article>{P1}</article><section class="comments"><article class="comment">{P2}{P3}</article></section>', [T1]),
    "comments, short article": (f'<article><p>Short.</p></article><div id="comments"><p>{T2}</p></div>', ["Short."]),
    "comments that a plugin names": (f'<div>{P1}{P2}</div><div class="disqus-thread">{P3}</div>', [T1, T2]),
    "cookie notice first": (f'<div class="cookie-consent">{P3}</div><div>{P1}{P2}</div>', [T1, T2]),
    "form in the text": (f"<div>{P1}<form><p>Your address, please:</p></form>{P2}</div>", [T1, T2]),
    "aside in the text": (f"<article>{P1}<aside>{P3}</aside>{P2}</article>", [T1, T2]),
    "roles apart": (f'<div><p>Menu of the day</p></div><div role="banner">Site</div><div>{P1}</div>', [T1]),
    "sections in elements of their own": (f"<div><div><h2>One</h2>{P1}</div><div><p>Short end.</p></div></div><div>Imprint</div>", ["One", T1, "Short end."]),
    "roles": (f'<div role="banner">Site</div><div>{P1}</div><div role="contentinfo">{P2}</div>', [T1]),
    "tables and lists": (f"<article>{P1}<ul><li>one</li><li>two</li></ul><table><tr><td>a</td><td>b</td></tr></table></article>", [T1, "one", "two", "a b"]),
    "inline markup": (f"<article><p>Some <b>bold</b> and <a href='/x'>linked</a> text&nbsp;here.</p>{P1}</article>", ["Some bold and linked text here.", T1]),
    "line breaks": (f"<article><p>one<br>two</p>{P1}</article>", ["one two", T1]),
    "pre and quote": (f"<article>{P1}<pre>x = 1\n  y</pre><blockquote>Said.</blockquote></article>", [T1, "x = 1 y", "Said."]),
    "only a short text": ("<div>Hi there.</div>", ["Hi there."]),
    "nothing but a menu": (f"<nav>{NAV}</nav>", []),
    "only what names call comments": (f'<div class="comments">{P1}</div>', [T1]),
    "figure with caption": (f"<article>{P1}<figure><img src=x><figcaption>A picture.</figcaption></figure></article>", [T1, "A picture."]),
    "unclosed paragraphs": (f"<article><p>{T1}<p>{T2}</article><footer>x", [T1, T2]),
    "body and html classes": (f'<html class="has-menu"><body class="sidebar-left comments-open"><div>{P1}</div></body></html>', [T1]),
    "short last section": (f"<div><p>{T1}</p><h2>Part two</h2><p>{T2}</p></div><div><span>12 Jan</span></div><nav>m</nav><p>Tiny</p>", [T1, "Part two", T2]),
}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_page_shapes(name):
    page, blocks = SHAPES[name]
    assert extract.main_text(page) == "\n".join(blocks)


def test_the_windows_decide(monkeypatch):
    """Without surge and dive points, as one run of the whole page, other text comes out of many shapes."""
    given = {name: extract.main_text(page) for name, (page, _) in SHAPES.items()}
    monkeypatch.setattr(extract, "runs", lambda lengths, regions=None, window=3: [(0, len(lengths), max(lengths))] if any(lengths) else [])
    changed = {name for name, (page, _) in SHAPES.items() if extract.main_text(page) != given[name]}
    assert {"teaser list after the article", "teaser list before the article", "roles apart"} <= changed


def test_long_and_repeated_pages(spark):
    long = "<div>" + P1 * 20_000 + "</div>"
    rows = [(1, "u", long), (1, "u", long), (2, None, ""), (None, "v", None), (3, "w", "<" * 5000 + "a" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as text")
    out = {(r.page_id, r.url, r.n_chars) for r in extract.extract(df).collect()}
    n = 20_000 * (len(T1) + 1) - 1
    assert {(1, "u", n), (2, None, 0), (None, "v", 0)} <= out and extract.extract(df.limit(0)).count() == 0


def test_extraction_of_all_pages(spark):
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = extract.extract(pages.selectExpr("*", "1 as text", "2 as n_chars")).collect()
    source = {r.page_id: r.html for r in pages.collect()}
    assert len(rows) == len(source)
    for r in rows:
        body = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    assert extract.extract(spark.createDataFrame([(1, None, None)], "page_id long, url string, html string")).first().text == ""


def test_runs_between_surge_and_dive():
    assert extract.runs([0, 5, 5, 0, 9, 0]) == [(1, 3, 10), (4, 5, 9)]
    assert extract.runs([]) == [] and extract.runs([0, 0]) == []


def padded(text):
    raw = (text or "").encode()
    return raw + b" " * (max(1, -(-len(raw) // flac.FRAME)) * flac.FRAME - len(raw))


def test_codec_round_trip_and_digests(spark):
    rng = np.random.default_rng(2)
    texts = ["", None, "x" * 192, "x" * 193, "é" * 500, "words of a text. " * 900, "".join(chr(c) for c in rng.integers(1, 1 << 16, 3000) if not 0xD800 <= c < 0xE000), "\x01\x7f" * 4000, "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "0 as media", "1 as key")
    rows = {r.doc_id: r for r in flac.read_back(flac.encode(df)).collect()}
    for i, t in enumerate(texts):
        p, r = padded(t), rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert tuple(rows[8])[1:] == tuple(rows[9])[1:] and rows[0].media_sha256 == rows[1].media_sha256
    media = flac.encode(df)
    blocks = flac.decode_blocks(media, block_samples=1000).collect()
    back = {}
    for b in sorted(blocks, key=lambda b: (b.doc_id, b.block)):
        assert b.sample_offset == 1000 * b.block and len(b.pcm) == b.n_samples
        back[b.doc_id] = back.get(b.doc_id, b"") + bytes(x ^ 0x80 for x in b.pcm)
    assert back == {i: padded(t) for i, t in enumerate(texts)}
    assert flac.read_back(flac.encode(df.limit(0))).count() == 0


def test_codec_of_noise_and_damage():
    noise = np.random.default_rng(4).integers(0, 256, 192 * 130).astype(np.uint8)
    steps = np.repeat(np.array([0, 255] * 96 * 5, np.uint8), 1)
    for payload in (noise, steps, np.zeros(192 * 3, np.uint8)):
        (stream,) = flac.encode_payloads(payload, np.array([len(payload) // 192]))
        assert ((flac.decode_streams([memoryview(stream)])[0] + 128).astype(np.uint8) == payload).all()
        for at in (len(stream) // 2, len(stream) - 3, 30):
            bad = bytearray(stream)
            bad[at] ^= 4
            with pytest.raises(flac.BadStream):
                flac.decode_streams([memoryview(bytes(bad))])


def test_chance_headers_inside_frames():
    payload = np.random.default_rng(6).integers(0, 256, 192 * 5).astype(np.uint8)
    for frame, number in ((0, 1), (0, 0), (2, 3), (4, 5), (1, 4)):  # also one that would follow the last frame
        for lead in (b"\xff\xf8\x14\x02", b"\xff\xf8\x14\x32"):  # as frames have it, and with other channels
            fake = lead + bytes([number])
            fake += bytes([int(flac._crc8(np.frombuffer(fake, np.uint8), np.array([0]), np.array([5]))[0])])
            given = payload.copy()
            given[192 * frame + 40 : 192 * frame + 46] = np.frombuffer(fake, np.uint8) ^ 0x80
            plain, chance = flac.encode_payloads(np.concatenate([payload, given, payload]), np.array([5, 5, 5]))[:2]
            assert chance.count(fake) >= 1
            back = flac.decode_streams([memoryview(plain), memoryview(chance), memoryview(plain)])
            assert [((b + 128).astype(np.uint8) == p).all() for b, p in zip(back, (payload, given, payload), strict=True)] == [True] * 3
            bad = bytearray(chance)
            bad[-300] ^= 4
            with pytest.raises(flac.BadStream):
                flac.decode_streams([memoryview(bytes(bad))])


def test_seek_points_lead_to_frames():
    payload = np.frombuffer(("some text " * 4000).encode()[: 192 * 200], np.uint8)
    (stream,) = flac.encode_payloads(payload, np.array([200]))
    size = int.from_bytes(stream[43:46], "big")
    table, frames = stream[46 : 46 + size], stream[46 + size :]
    for i in range(0, size, 18):
        sample, offset = int.from_bytes(table[i : i + 8], "big"), int.from_bytes(table[i + 8 : i + 16], "big")
        assert sample == i // 18 * 64 * 192 and frames[offset : offset + 2] == b"\xff\xf8"
