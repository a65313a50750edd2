"""Text kernels, decontamination and substring dedup against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from quarrylog.llm import decontaminate as dc
from quarrylog.llm import substring as sub
from quarrylog.llm._text import ALNUM, LOWER, NON_SPACE, chunks, span_hashes, spans, windows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute_words(text):
    return WORD.findall(lower(text))


TEXTS = ["", None, "One two, THREE", "é-ü 東京 x1", "a" * 5000, " \n\t", "x", "word " * 3000, "Aa aA\x00b"]


def test_spans_and_hashes_are_the_words():
    for _, _, data, offsets in chunks(pa.array(TEXTS), 16):
        starts, ends, first = spans(data, offsets, ALNUM)
        for i in range(len(offsets) - 1):
            text = bytes(data[offsets[i] : offsets[i + 1]]).decode()
            got = [bytes(LOWER[data[a:b]]).decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
            assert got == brute_words(text)
    seen = [(a, b) for a, b, _, _ in chunks(pa.array(TEXTS), 16)]
    assert seen[0][0] == 0 and seen[-1][1] == len(TEXTS) and all(x[1] == y[0] for x, y in zip(seen, seen[1:], strict=False))


def test_equal_words_have_equal_hashes_everywhere():
    _, _, data, offsets = next(chunks(pa.array(["the cat THE", "cat dog the"]), 100))
    starts, ends, _ = spans(data, offsets, NON_SPACE)
    h = span_hashes(data, starts, ends, LOWER).tolist()
    assert h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h)) == 3


def test_windows_of_short_and_long_texts():
    words = np.arange(1, 8, dtype=np.uint64)
    h, at, first = windows(words, np.array([0, 2, 2, 7]), 4)
    assert first.tolist() == [0, 1, 1, 3] and at.tolist() == [0, 2, 3] and len(set(h.tolist())) == 3
    again, _, _ = windows(words[2:6], np.array([0, 4]), 4)
    assert again[0] == h[1]


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(5)
    for _ in range(120):
        symbols = int(rng.integers(1, 5))
        text = rng.integers(0, symbols + 1, int(rng.integers(1, 70)))
        plain = text.tolist()
        assert dc.suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: plain[i:])
        index = dc.FMIndex(text, symbols)
        for k in (1, 2, 4):
            for p in rng.integers(0, symbols + 1, (12, k)):
                low, high = index.search(p[None])
                want = [i for i in range(len(plain) - k + 1) if plain[i : i + k] == p.tolist()]
                assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def brute_hits(text, items, window):
    words, hit, found = brute_words(text), set(), set()
    for item, body in items:
        own = brute_words(body)
        n = min(window, len(own))
        for s in range(len(own) - n + 1) if n else ():
            for at in range(len(words) - n + 1):
                if words[at : at + n] == own[s : s + n]:
                    hit.update(range(at, at + n))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 200])
def test_decontamination(spark, pass_bytes):
    rng = np.random.default_rng(1)
    vocab = ["alpha", "Beta", "gamma", "d", "é", "six", "7"]
    items = [(i, " ".join(rng.choice(vocab, int(n)))) for i, n in enumerate([12, 15, 3, 1, 0, 10, 11])] + [(10, None), (None, "alpha alpha alpha"), (1, "six six six six")]
    docs = [(i, " ".join(rng.choice(vocab, int(rng.integers(0, 60))))) for i in range(40)] + [(50, None), (51, ""), (52, "x, " + items[0][1].upper() + " . y"), (None, items[1][1]), (52, "again")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as key", "2 as n_words", "3 as hit_spans")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = dc.digest(dc.hits(d, b, pass_bytes=pass_bytes)).collect()
    want = []
    for key, text in docs:
        n, hit, found = brute_hits(text, items, 10)
        want.append((key, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert dc.digest(dc.hits(d.limit(0), b)).count() == 0 and dc.digest(dc.hits(d, b.limit(0))).filter("n_hit > 0").count() == 0


def test_cut_takes_out_the_spans(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Ää! One, two three. End"), (2, "one two"), (3, None), (4, "x one two three one two three")], "doc_id long, text string")
    out = {r.doc_id: (r.text, r.cut) for r in dc.cut_spans(dc.hits(docs, bench, carry=("text",))).collect()}
    assert out == {1: ("Ää! . End", True), 2: ("one two", False), 3: (None, False), 4: ("x ", True)}


def brute_dedup(docs, min_words, line_words=None):
    def cut(text):
        raw = text.encode()
        marks = [0] + [m.end() for m in re.finditer(rb"(?:\n|(?<=[.!?])[ \t-\r])[ \t-\r]*", raw)]
        marks = sorted({m for m in marks if m < len(raw)}) + [len(raw)]
        return [(a, b, brute_words(raw[a:b].decode("utf-8", "replace"))) for a, b in zip(marks, marks[1:], strict=False)]

    first, out = {}, {}
    rows = sorted(((k is None, k, t) for k, t in docs if t), key=lambda x: (x[0], x[1] or 0))
    for _, key, text in rows:
        for a, _, words in cut(text):
            if words:
                first.setdefault(tuple(words), (key, a))
    for key, text in docs:
        spans_, run, last = [], None, None
        units = [u for u in cut(text or "") if u[2]] if text else []
        for n, (a, b, words) in enumerate(units):
            if first[tuple(words)] != (key, a):
                if run is not None and last == n - 1:
                    run[1], run[2] = b, run[2] + len(words)
                else:
                    run = [a, b, len(words)]
                    spans_.append(run)
                last = n
        raw, parts, at = (text or "").encode(), [], 0
        taken = [s for s in spans_ if s[2] >= min_words]
        if line_words is not None:
            # Lines with words all of whose units are repeated, from the first one's begin to the last one's end.
            line_of = lambda a: raw[:a].count(b"\n")  # noqa: B023, E731
            lines = {}
            for a, b, words in units:
                lines.setdefault(line_of(a), []).append((a, b, len(words), first[tuple(words)] != (key, a)))
            whole = [(line[0][0], line[-1][1], sum(u[2] for u in line)) for line in lines.values() if all(u[3] for u in line)]
            taken += [list(w) for w in whole if w[2] >= line_words and not any(a <= w[0] < b for a, b, _ in taken)]
        spans_ = sorted(taken)
        for a, b, _ in spans_:
            parts.append(raw[at:a])
            at = b
        out[key] = (b"".join([*parts, raw[at:]]).decode() if spans_ else text, sum(s[2] for s in spans_))
    return out


def test_substring_dedup(spark):
    rng = np.random.default_rng(3)
    vocab = ["a", "B", "cc", "é", "dd1", "e"]
    sentences = [" ".join(rng.choice(vocab, int(rng.integers(1, 9)))) + s for s in (". ", "! ", "\n", "? ", ".\n", " \n\n ") for _ in range(4)]
    docs = [(i, "".join(rng.choice(sentences, int(rng.integers(0, 14))))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "Only here once, so it stays."), (103, "x " * 4000 + "\n" + "x " * 4000), (None, docs[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7).selectExpr("*", "1 as digest", "2 as place", "'z' as removed")
    for least in (1, 6, 25):
        got = {r.doc_id: (r.text, r.n_removed) for r in sub.dedup(df, min_words=least).collect()}
        assert got == brute_dedup(docs, least), least
    for least, line in ((25, 15), (25, 5), (12, 1)):
        got = {r.doc_id: (r.text, r.n_removed) for r in sub.dedup(df, min_words=least, line_words=line).collect()}
        assert got == brute_dedup(docs, least, line), (least, line)
    assert sub.dedup(df.limit(0)).count() == 0


def test_a_run_leaves_one_open_unit_of_each_digest():
    digest = np.array([5, 9, 5, 5, 9], np.uint64)
    keys, hashes, begin = pa.array([3, 1, 2, 2, None]), np.array([30, 10, 20, 20, 90]), np.array([0, 4, 8, 2, 0])
    (batch,) = sub._settled([(digest, keys, hashes, np.zeros(5, np.int64), begin, begin + 3, np.full(5, 7))])
    rows = batch.to_pylist()
    opened = [(r["digest"], r["key"], r["span"] >> 32) for r in rows if r["place"] >= 0]
    assert sorted(opened) == [(5, 2, 2), (9, 1, 4)] and len(rows) == 5
    assert len({r["digest"] for r in rows}) == 5  # what is settled is dealt by keys of its own


def test_repeated_rows_fare_alike(spark):
    long = "one two three four five six. " * 2 + "seven eight nine."
    df = spark.createDataFrame([(2, long), (2, long), (1, "zero. " + long)], "doc_id long, text string").repartition(3)
    rows = {(r.doc_id, r.text) for r in sub.dedup(df, min_words=5).filter("doc_id = 2").collect()}
    assert len(rows) == 1


def test_a_passage_that_most_texts_hold(spark):
    passage = "This passage is in nearly every text and has quite a few words, more than a heading. It goes on for a second sentence that makes it longer still. "
    docs = [(i, f"Start {i} here. {passage}End {i} there.") for i in range(400)]
    out = sub.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(9)).filter("n_removed > 0")
    assert out.count() == 399 and out.filter("text like '%passage%'").count() == 0 and out.filter("doc_id = 0").count() == 0
