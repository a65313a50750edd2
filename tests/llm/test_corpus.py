"""Similarity join, mixing, chat formatting, the queries and the pipeline."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_text_search import brute_dedup, brute_words

from pyspark.sql import functions as F

import corpus_pipeline
from quarrylog.llm import chat, jaccard, language, mixing, queries
from quarrylog.llm._text import chunks

SF = "/root/testdata/sf0.01"


def brute_shingles(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(docs, num=85, den=100, words=4):
    sets = [(k, brute_shingles(t, words)) for k, t in docs]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and den * len(a & b) >= num * len(a | b):
            root[find(i)] = find(j)
    group = defaultdict(list)
    for i, (k, _) in enumerate(sets):
        group[find(i)].append(k)
    return sorted(((k, len(s), min((x for x in group[find(i)] if x is not None), default=None)) for i, (k, s) in enumerate(sets)), key=repr)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_join_agrees_with_all_pairs(spark):
    rng = random.Random(7)
    docs, key = [], 0
    for size in (3, 4, 9, 10, 11, 12, 16, 20, 30, 45, 80, 150, 400):
        for _ in range(3):
            base = [f"w{rng.randrange(3000)}" for _ in range(size)]
            for n in (0, 0, 1, 1, 2, max(1, size // 30), max(1, size // 60)):
                words = edited(rng, base, n) if n else base
                docs.append((key := key + 1, " ".join(words[: len(words) - rng.randrange(2)])))
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, "The SAME text here now"), (1004, "the same  TEXT here now"), (None, "the same text here now"), (None, "alone in the world of words")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).selectExpr("*", "1 as sid", "2 as n", "'x' as key")
    got = sorted(map(tuple, jaccard.join(df).collect()), key=repr)
    assert got == brute_components(docs)
    assert jaccard.join(df.limit(0)).count() == 0


def test_large_groups_and_a_common_passage(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [(i, " ".join(edited(rng, base, 1))) for i in range(150)] + [(200 + i, " ".join(base)) for i in range(80)] + [(400 + i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60))) for i in range(80)]
    got = sorted(map(tuple, jaccard.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()), key=repr)
    assert got == brute_components(docs)


@pytest.mark.parametrize("crowded", [0, 64])
def test_crowded_buckets(spark, monkeypatch, crowded):
    """Draws, blocks and profiles change no result."""
    for name, value in (("CROWDED", crowded), ("BLOCK", 7), ("WHOLE_ELEMENTS", 0)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    docs = [(i, " ".join([*passage, *(f"q{rng.randrange(10**6)}" for _ in range(60))])) for i in range(60)]
    base = [f"b{i}" for i in range(70)]
    docs += [(100 + i, " ".join(edited(rng, base, 2))) for i in range(60)]
    docs += [(200 + i, " ".join(edited(rng, [*passage, *base[:20]], 1))) for i in range(40)] + [(None, " ".join(base))]
    got = sorted(map(tuple, jaccard.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).collect()), key=repr)
    assert got == brute_components(docs)


def test_a_third_of_many_rows_in_one_group(spark):
    rng = random.Random(12)
    base, passage = [f"b{i}" for i in range(150)], [f"p{i}" for i in range(30)]
    docs = [(i, " ".join(edited(rng, base, 1))) for i in range(4000)]  # each links with any other: at most two words differ
    docs += [(10_000 + i, " ".join([*passage, *(f"u{rng.randrange(10**7)}" for _ in range(40))])) for i in range(4000)]
    docs += [(20_000 + i, " ".join(f"v{rng.randrange(10**7)}" for _ in range(20))) for i in range(4000)]
    found = jaccard.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()
    assert all(r.component_id == (0 if r.doc_id < 10_000 else r.doc_id) for r in found) and len(found) == len(docs)


@pytest.mark.parametrize(("num", "den"), [(85, 100), (80, 100), (60, 100)])
def test_signatures_lose_no_pair(num, den):
    rng, bands, n = random.Random(1), jaccard.Bands(num, den), 0
    assert num == 85 or max(bands.kind) >= jaccard.SEGMENTS[0]
    for _ in range(1500):
        size = rng.choice([6, 7, 9, 12, 13, 16, 20, 26, 40, 76, 77, 100, 200, 400])
        a = {rng.getrandbits(64) for _ in range(size)}
        b = set(a)
        for _ in range(rng.randint(1, max(1, int(jaccard.most_different(size, 10**9, num, den))))):
            b.discard(rng.choice(sorted(a))) if rng.random() < 0.5 else b.add(rng.getrandbits(64))
        if a == b or den * len(a & b) < num * len(a | b):
            continue
        elements = np.concatenate([np.sort(np.array(list(s), np.uint64)) for s in (a, b)])
        at = np.array([0, len(a), len(a) + len(b)])
        sig, owner = bands.signatures(elements, at)
        assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist()), (len(a), len(b))
        differ = int(np.bitwise_count(np.bitwise_xor(*jaccard.sketches(elements, at).view(np.uint64))).sum())
        assert differ <= len(a ^ b)
        n += 1
    assert n > 300


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(101, 100)], "a long, b long")
    assert {r.v: r.label for r in jaccard.components(links).collect()} == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


def test_labels_after_more_links(spark):
    """Components tied together one batch of links at a time are those of all links."""
    rng = random.Random(3)
    batches = [[tuple(sorted(rng.sample(range(60), 2))) for _ in range(n)] for n in (15, 12, 10)] + [[]]
    labels = None
    for batch in batches:
        links = spark.createDataFrame(batch, "a long, b long")
        labels = jaccard.components(links) if labels is None else jaccard.joined(labels, links)
    every = jaccard.components(spark.createDataFrame(sum(batches, []), "a long, b long"))
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, every.collect()))


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """Water filling by rounds: capped sources leave, their excess is dealt again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        share = {s: weight[s] * (total - sum(capped.values())) / sum(weight[r] for r in rest) for s in rest} if rest else {}
        over = [s for s in rest if share[s] > cap * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 1000}, {"a": 5, "b": 5, "c": 5, None: 900}, {"a": 100}, {"a": 0, "b": 7, "é": 30, "z": 1}])
def test_targets(spark, sizes):
    rows = mixing.targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")).collect()
    want = brute_targets(sizes)
    assert {r.source: round(r.target, 6) for r in rows} == {s: round(t, 6) for s, t in want.items()}


def test_mix_of_documents(spark):
    rng = random.Random(3)
    docs = [(i, " ".join("w" for _ in range(rng.choice([1, 5, 40, 200]))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)] + [(5000, None, "a"), (5001, " \x0b", "b"), (None, "x y", "c"), (7, "dup row", "b"), (7, "dup row", "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as p", "3 as copies")
    rows = mixing.mix(df.drop("size"), carry=("text",)).collect()
    assert len(rows) == len(docs)
    taken, target = defaultdict(int), {}
    for r in rows:
        assert r.size == len((r.text or "").split()) and r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= max(0.002 * t, 3) for s, t in target.items())
    again = mixing.mix(df.repartition(11)).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in rows) == sorted((r.doc_id or -1, r.taken) for r in again)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_draws_by_row(spark):
    """Rows without id, under one id and equal in every column each draw for themselves, however the table is split."""
    rng = random.Random(5)
    docs = [(None if i % 2 else i, f"t{i} " + " ".join("w" for _ in range(rng.choice([1, 5, 40]))), rng.choice("abc")) for i in range(3000)]
    docs += [(9, "one row many times over", "d")] * 1000 + [(9, f"text {i} of one id", "e") for i in range(500)] + [(None, None, "d")] * 300
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    results = []
    for n in (3, 17):
        rows = mixing.mix(df.repartition(n), carry=("text",)).collect()
        taken, target, longest = defaultdict(int), {}, defaultdict(int)
        for r in rows:
            assert r.size == len((r.text or "").split()) and r.taken == r.copies * r.size <= 3 * r.size
            taken[r.source], target[r.source], longest[r.source] = taken[r.source] + r.taken, r.target, max(longest[r.source], r.size)
        assert all(abs(taken[s] - t) <= longest[s] for s, t in target.items())
        results.append(sorted((repr(r.doc_id), r.text or "", r.source, r.taken) for r in rows))
    assert results[0] == results[1] and len(results[0]) == len(docs)
    plain = mixing.mix(df).collect()
    assert sorted((repr(r.doc_id), r.source, r.size, r.taken) for r in plain) == sorted((k, s, len(t.split()), n) for k, t, s, n in results[0])


def test_large_sets_that_share_much_are_told_apart_in_the_join(spark, monkeypatch):
    """Long texts that share half their words without linking: their pairs are no candidates, whatever their number."""
    rng, seen, verified = random.Random(8), [], jaccard._verified

    def counted(pairs, *more):
        seen.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(jaccard, "_verified", counted)
    base = [f"b{i}" for i in range(1500)]
    docs = []
    for i in range(40):
        at = rng.randrange(500)
        docs.append((i, " ".join([*base[at : at + 1000], *(f"q{rng.randrange(10**7)}" for _ in range(200))])))
    docs += [(100 + i, " ".join(edited(rng, docs[i][1].split(), 3))) for i in range(10)]
    found = jaccard.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), k=1, num=80).collect()
    sets = {i: set(t.split()) for i, t in docs}
    root = {i: i for i in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.doc_id: r.component_id for r in found} == root and len(linked) >= 10
    alike = sum(100 * len(sets[a] & sets[b]) >= 65 * len(sets[a] | sets[b]) for a in sets for b in sets if a < b)
    assert sum(seen) <= alike + 40, (seen, alike, len(linked))


def test_wide_sketches_tell_no_linked_pair_apart(spark):
    rng, rows = random.Random(9), []
    for size in (1, 511, 512, 513, 700, 1023, 1024, 1025, 2100, 70_000):
        a = {rng.getrandbits(64) for _ in range(size)}
        b = {x for x in a if rng.random() > 0.1} | {rng.getrandbits(64) for _ in range(size // 10)}
        elements = np.concatenate([np.array(sorted(s), np.uint64) for s in (a, b, a - b, b - a)])
        at = np.cumsum([0, len(a), len(b), len(a - b), len(b - a)])
        one, two = jaccard.wide_sketches(elements, at).to_pylist()[:2]
        assert (len(one) > 0) == (len(a) > 512) and len(one) * 64 <= jaccard.WIDE_BITS and (len(one) * 64 >= size or len(one) in (0, 1024))
        rows.append((one, two, len(a ^ b)))
    least = F.least(F.size("a"), F.size("b"))
    differing = jaccard._differing(jaccard._folded(F.col("a"), least), jaccard._folded(F.col("b"), least))
    got = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, d long").select(differing.alias("n"), "d", least.alias("words")).collect()
    assert len(got) == 10 and all(r.n <= r.d and (r.n > 0.5 * r.d or r.words == 0) for r in got)


def test_join_of_rows_without_ids(spark):
    """Texts without id or under one id are each made for their own set: as many rows as sets, not rows by rows."""
    rng = random.Random(11)
    docs = []
    for i in range(400):
        words = [f"w{rng.randrange(5000)}" for _ in range(40)]
        docs += [(None if i % 2 else 5, " ".join(words)), (None if i % 3 else i, " ".join([*words, "more"]))]
    docs += [(None, ""), (None, None), (3, " ")] * 5
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = jaccard.join(df.repartition(7)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr) == brute_components(docs)
    work = df.selectExpr("doc_id as key", "text", "xxhash64(text) as digest")
    sets = jaccard._sets(work, 4).filter("n > 0")
    wanted = sets.groupBy("sid").agg(F.min(F.struct("digest", "key")).alias("row"))
    found = jaccard._of_sets(work, wanted, 4, "elements array<bigint>", jaccard._as_lists)
    assert found.count() == wanted.count() == 800
    assert max(r["count"] for r in work.join(wanted, work["digest"] == wanted["row.digest"]).groupBy("digest").count().collect()) == 1


def brute_preference(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    show = lambda t: f"<|{t[0]}|>\n{t[1]}<|end|>\n"

    def completion(turns):
        text, spans = "", []
        for t in turns:
            if t[0] == "assistant":
                spans.append((len(text) + len(t[0]) + 5, len(text) + len(t[0]) + 5 + len(t[1]) + 7))
            text += show(t)
        return text, spans

    return n, "".join(map(show, chosen[:n])), completion(chosen[n:]), completion(rejected[n:])


def test_preference_pairs(spark):
    u, a, b = ("user", "hi"), ("assistant", "hé llo"), ("assistant", "no")
    pairs = [([u, a], [u, b]), ([u, a, u, b], [u, a, u, a, u]), ([a], [a]), ([], [u]), ([u], []), ([("user", "")], [("system", "")])]
    df = spark.createDataFrame([(i, c, r) for i, (c, r) in enumerate(pairs)], f"pair_id int, chosen {chat.TURNS}, rejected {chat.TURNS}").selectExpr("*", "1 as n", "2 as prompt")
    for r in chat.preference(df).collect():
        n, prompt, (c, cs), (j, js) = brute_preference(*pairs[r.pair_id])
        assert (r.prompt_turns, r.prompt, r.chosen, r.rejected) == (n, prompt, c, j)
        assert [tuple(s) for s in r.chosen_spans] == cs and [tuple(s) for s in r.rejected_spans] == js and r.tied == (c == "" and j == "")
    nothing = spark.createDataFrame([(1, None, None), (2, [(None, None)], None)], f"pair_id int, chosen {chat.TURNS}, rejected {chat.TURNS}")
    assert {r.pair_id: (r.chosen, r.tied) for r in chat.preference(nothing).collect()} == {1: ("", True), 2: ("<||>\n<|end|>\n", False)}
    assert chat.preference(df.limit(0)).count() == 0


def test_marks_inside_turns_are_read_back(spark):
    shared = [("user", "what is <|end|>\n<|assistant|>\nyes?"), ("a|b|>", "<"), ("", "<|||end|>\n <||")]
    pairs = [(1, [*shared, ("assistant", "x<|end|>\n")], [*shared, ("assistant", "<|user|>\n")]), (2, [("|", "|>\n"), ("||", "")], []), (3, [], [("assistant", "<|" * 2000 + "é")])]
    df = spark.createDataFrame(pairs, f"pair_id int, chosen {chat.TURNS}, rejected {chat.TURNS}")
    out = chat.preference(df)
    both = out.select("pair_id", *(chat.read(F.concat("prompt", c)).alias(c) for c in ("chosen", "rejected")), "prompt_turns", F.col("chosen").alias("shown"), "chosen_spans")
    rows = {r.pair_id: r for r in both.collect()}
    for key, chosen, rejected in pairs:
        assert [tuple(t) for t in rows[key].chosen] == chosen and [tuple(t) for t in rows[key].rejected] == rejected
    (span,) = rows[1].chosen_spans
    assert rows[1].prompt_turns == 3 and rows[1].shown[span.begin : span.end] == "x<||end|>\n<|end|>"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.sql(f"select {columns} from ({queries.ORACLES[name]})").fetchall()))


def test_near_copies_are_decided_by_row(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (7, a + " z"), (7, b), (8, b + " z"), (None, a), (None, c), (None, c), (9, "alone here in the world"), (9, "alone here in the world"), (5, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = corpus_pipeline.join_near_copies(spark, docs, SF)
    assert left.columns == list(corpus_pipeline.COLUMNS)
    want = [(1, a), (7, b), (None, c), (9, "alone here in the world"), (5, None)]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(want, key=repr)


def brute_kept_languages(docs):
    """Rows whose language is accepted, each text by itself against the models of the same sample."""
    sample = language.training_sample(docs, "doc_id", "text", "lang")
    model = language.fit([t for t, _ in sample], [y for _, y in sample])
    kept = []
    for r in docs.collect():
        if not any(c.isalpha() for c in r.text or ""):
            continue
        _, _, data, offsets = next(chunks(pa.array([r.text]), 1 << 40))
        grams = language.grams(*language.symbols_of(*language.letters_of(data, offsets)))
        entropy, own = min(((float(-m.log2(grams).astype(float).mean()), m) for m in model.languages), key=lambda x: x[0])
        if entropy <= own.limit + language.DEVIATIONS * own.spread / len(grams) ** 0.5:
            kept.append((r.doc_id, r.text))
    return kept


def brute_near_copies(rows):
    """Of each group linked by five-word shingles at 0.8 the first row by (no id, id)."""
    distinct = sorted({(k is None, k or 0, t or "") for k, t in rows})
    parts = brute_components(list(enumerate(t for _, _, t in distinct)), 80, 100, 5)
    first = {}
    for i, _, c in sorted(parts):
        first.setdefault(c, i)
    return [(None if distinct[i][0] else distinct[i][1], distinct[i][2]) for i in sorted(set(first.values()))]


def brute_decontaminated(rows, bench):
    out = []
    for k, t in rows:
        words = brute_words(t or "")
        hit = set()
        for _, body in bench:
            own = brute_words(body or "")
            n = min(10, len(own))
            grams = {tuple(own[s : s + n]) for s in range(len(own) - n + 1)} if n else set()
            hit.update(p for a in range(len(words) - n + 1) if tuple(words[a : a + n]) in grams for p in range(a, a + n)) if grams else None
        left = [w for i, w in enumerate(words) if i not in hit]
        if left or not hit:
            out.append((k, left, bool(hit)))
    return out


def test_each_stage_of_the_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).filter("doc_id < 220 or doc_id in (255, 709, 875, 944)")
    odd = [(9001, None, "en", "src0", None), (9002, "12345 !!", None, None, 8), (9003, "A fine short text of the other kind.", None, None, 36), (9003, "A fine short text of the other kind.", None, None, 36), (None, "A text without an id, quite short.", "en", "src1", 34), (1, "Two texts under one id are two documents of their own.", "en", "src2", 53), (9005, "word " * 60_000, "en", "src0", 300_000)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).repartition(3)
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    by = lambda rows: sorted(rows, key=repr)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        before, rows = docs.collect(), out.collect()
        given, got = [(r.doc_id, r.text) for r in before], [(r.doc_id, r.text) for r in rows]
        if name == "language_id":
            assert by(got) == by(brute_kept_languages(docs)) and len(got) > 200
        elif name == "near_copies":
            assert by(got) == by(brute_near_copies(given))
            assert not {255, 944} & {k for k, _ in got}  # near 1 and 709 by five-word shingles only
        elif name == "passages":
            # Equal rows are one document to the operator; ids that stand for two texts are told apart by (id, text).
            names = {i: row for i, row in enumerate(sorted(set(given), key=lambda x: (x[0] is None, x[0] or 0, x[1])))}
            want = {i: t for i, (t, n) in brute_dedup([(i, t) for i, (_, t) in names.items()], 25, 15).items() if not n or t.strip()}
            assert by(got) == by((names[i][0], t) for i, t in want.items())
        elif name == "decontaminate":
            want = brute_decontaminated(given, bench)
            assert by((k, brute_words(t or "")) for k, t in got) == by((k, w) for k, w, _ in want)
            assert any(cut for _, _, cut in want)
        else:
            sizes, targets, taken = defaultdict(int), {}, defaultdict(int)
            for r in before:
                sizes[r.source] += len((r.text or "").split())
            for r in rows:
                assert r.size == len((r.text or "").split()) and r.copies > 0 and r.taken == r.copies * r.size <= 3 * r.size
                taken[r.source], targets[r.source] = taken[r.source] + r.taken, r.target
            want = brute_targets(sizes)
            assert all(abs(targets[s] - want[s]) < 1e-6 * want[s] for s in targets) and by(set(got)) == by(set(got) & set(given))
        if name != "mix":
            assert out.columns == list(corpus_pipeline.COLUMNS)
            assert all(r.n_chars == len(r.text) for r in rows if (r.doc_id, r.text) not in given)
        docs = out
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_pipeline_of_an_empty_table(spark, tmp_path):
    folder = tmp_path.as_uri()
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").limit(3).write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


FEW = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_queries_return_what_their_contracts_say(spark, name):
    """The queries without SQL, as registered: columns, one row for each of the table, rows held out, values in range."""
    columns = {
        "op2_substring_dedup": {"doc_id", "text", "removed", "n_removed"}, "op4_extract_html": {"page_id", "url", "text", "n_chars"},
        "op5_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op6_language_id": {"doc_id", "held_out", "lang_pred", "score"},
        "op9_flac_media": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"}, "op10_quality": {"doc_id", "held_out", "score", "predicted"},
        "op11_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    }[name]
    out = queries.QUERIES[name](spark, FEW)
    rows = out.collect()
    table = "pages" if name == "op4_extract_html" else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    source = {r[key]: r for r in spark.read.parquet(f"{FEW}/{table}.parquet").collect()}
    assert columns <= set(out.columns) and sorted(r[key] for r in rows) == sorted(source)
    for r in rows:
        if "held_out" in columns:
            rest = zlib.crc32(str(r.doc_id).encode()) % (4 if name == "op6_language_id" else 5)
            assert r.held_out == (rest == (2 if name == "op6_language_id" else 0)) and 0 <= r.score <= 1
        if "predicted" in columns:
            assert r.predicted == int(r.score >= (0.5 if name == "op5_toxicity" else 0.3))
        if name == "op2_substring_dedup":
            raw = (source[r.doc_id].text or "").encode()
            left = b"".join(raw[a:b] for a, b in zip([0, *(s.end for s in r.removed)], [*(s.begin for s in r.removed), len(raw)], strict=True))
            assert left.decode("utf-8", "replace") == (r.text or "") and r.n_removed == sum(s.words for s in r.removed)
        if name == "op4_extract_html":
            assert r.n_chars == len(r.text) and r.url == source[r.page_id].url
        if name == "op9_flac_media":
            raw = (source[r.doc_id].text or "").encode()
            raw += b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
            assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]))
