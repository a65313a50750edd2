"""Byte-level BPE, vector codes and conversation repair against brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from quarrylog.llm import repair, tokens, vectors


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_bpe_is_the_library_s(spark, vocabulary):
    rng = random.Random(5)
    library = tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
    # Characters of all planes (those Java lacks too), white space of all kinds, words too long for the fold, names of special tokens.
    some = [chr(c) for c in range(1, 0x110000, 37) if not 0xD800 <= c < 0xE000]
    texts = [None, "", " ", "a", "\n" * 400 + "b", "x" * 3000, "ab" * 400 + " " * 300, "日本語" * 200, "<|endoftext|> I'll we've d's", "same text", "same text"]
    texts += ["a" + " x".join(some[i : i + 3000]) for i in range(0, len(some), 3000)]
    texts += ["".join(rng.choice(" ab'\n\r\t\u0085　éß٣१x!?-_") for _ in range(rng.randrange(120))) for _ in range(150)]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(400))) for _ in range(30)]
    df = spark.createDataFrame([(i if i else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, word int").repartition(3)
    for limit in (tokens.LEXICON_BYTES, 0):  # without a lexicon every word is folded where it stands
        rows = {r.doc_id or 0: r for r in tokens.digest(df, vocabulary, limit=limit).collect()}
        assert len(rows) == len(texts)
        for i, text in enumerate(texts):
            ids = library.encode_ordinary(text or "")
            assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(text or "")), (i, text)
    encoded = tokens.encode(df, vocabulary)
    assert {r.doc_id or 0: len(r.ids) for r in encoded.collect()} == {i: r.n_tokens for i, r in rows.items()}
    assert {r.content.decode() for r in tokens.decode(encoded, vocabulary).collect()} == {t or "" for t in texts}
    assert tokens.digest(df.limit(0), vocabulary).count() == 0


def test_heap_merges_and_words_that_merging_does_not_give(vocabulary):
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=vocabulary.ranks, special_tokens={})
    rng = random.Random(1)
    for n in (1, 2, 3, 40, 700):
        word = "".join(rng.choice("abc the") for _ in range(n))
        assert tokens.heap_merged(word.encode(), vocabulary) == library.encode_ordinary(word)
    assert vocabulary.unmerged == {}
    odd = tokens.Vocabulary({bytes([i]): i for i in range(256)} | {b"abc": 300}, "[a-z]+")
    assert odd.unmerged == {b"abc": 300}


def test_bpe_looks_up_whole_words_first(spark):
    odd = tokens.Vocabulary({bytes([i]): i for i in range(256)} | {b"bc": 290, b"abcd": 300}, "[a-z]+")
    df = spark.createDataFrame([(1, "abcd"), (2, "abcde"), (3, "bc a")], "doc_id long, text string")
    assert {r.doc_id: r.ids for r in tokens.encode(df, odd).collect()} == {1: [300], 2: [97, 290, 100, 101], 3: [290, 97]}


def test_many_words_are_merged_at_once(spark, vocabulary):
    """Words of all sizes in one array of ranks give the library's ids, and only characters that Java lacks keep a text from Spark's cut."""
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=vocabulary.ranks, special_tokens={})
    rng = random.Random(3)
    some = ["a", "", " the", "é", "日本語", "aaaaaaaaab" * 25, "ab" * 128, "ab" * 129]
    some += ["".join(rng.choice("abcdefghinorst éñß日") for _ in range(rng.choice((1, 2, 3, 9, 14, 60, 200)))) for _ in range(2000)]
    merges = tokens.Merges(vocabulary)
    many = ["".join(rng.choice("abcdefgh") for _ in range(240)) for _ in range(5000)]  # more than one block of bytes
    for given in (some, some[:1], some[1:2], [], many):
        ids, at = tokens.merged_words(pa.array(given, pa.string()), vocabulary, merges)
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == [library.encode_ordinary(w) for w in given]
    a, b = np.array([x for x, _ in vocabulary.pairs]), np.array([y for _, y in vocabulary.pairs])
    assert merges.rank(a, b).tolist() == list(vocabulary.pairs.values())
    assert (merges.rank(a, np.full(len(a), 1 << 20)) == tokens.NONE).all()
    df = spark.createDataFrame([("x" * 3000,), (" " * 3000,), ("plain",), ("a\U000e0080b",), (None,)], "text string")
    assert [r[0] for r in df.select(tokens.apart(df["text"])).collect()] == [False, False, False, True, False]


def brute_codes(rows, entries=64):
    """Codes, errors and codebooks of (vec_id, vector) by complete distances in Python integers."""
    ints = [[int(np.floor(float(x) * 256)) for x in v] for _, v in sorted(rows)]
    cut = [len(ints[0]) * i // 16 for i in range(17)]
    parts = [[v[a:b] for v in ints] for a, b in itertools.pairwise(cut)]
    books = [p[:entries] for p in parts]
    find = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(2):
        for p, own in enumerate(parts):
            to = [find(x, books[p])[1] for x in own]
            members = [[x for x, t in zip(own, to, strict=True) if t == e] for e in range(len(books[p]))]
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else books[p][e] for e, m in enumerate(members)]
    found = [[find(v, books[p]) for p, v in enumerate(by)] for by in zip(*parts, strict=True)]
    flat = ",".join(str(x) for b in books for e in b for x in e)
    return ["".join(f"{i:02x}" for _, i in f) for f in found], [sum(d for d, _ in f) for f in found], sha(flat)


@pytest.mark.parametrize(("dims", "scale"), [(16, 1.0), (40, 1.0), (32, 3e6)])
def test_vector_codes(spark, dims, scale):
    rng = np.random.default_rng(dims)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=dims) * 4) / 8 * scale]) for i in range(150)]
    rows += [(i + 150, rows[0][1]) for i in range(60)]  # copies
    bad = [(500, None), (501, [None] * dims), (502, [float("nan")] * dims), (503, [float("inf")] + [0.0] * (dims - 1))]
    labels = {i: None if i % 3 == 0 else i % 2 for i, _ in rows}
    df = spark.createDataFrame([(i, v, labels.get(i), "z") for i, v in rows + bad], "vec_id long, embedding array<float>, label int, code string").repartition(4)
    got = vectors.compress(df).orderBy("vec_id").collect()
    as_floats = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    codes, errors, books = brute_codes(as_floats)
    assert [r.vec_id for r in got] == [i for i, _ in rows] and [r.code for r in got] == codes
    assert [r.error for r in got] == errors and {r.codebooks_sha256 for r in got} == {books}
    sums = {lab: sum(e for (i, _), e in zip(rows, errors, strict=True) if labels[i] == lab) for lab in (None, 0, 1)}
    assert all(r.label_error == sums[labels[r.vec_id]] for r in got)


def test_vector_codes_of_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>, label int"
    few = spark.createDataFrame([(None, [1.0] * 16, None), (2, [2.0] * 8, 1), (2, [0.5] * 16, 1)], schema)
    rows = vectors.compress(few).collect()
    assert sorted(r.code for r in rows) == ["00" * 16, "01" * 16, "02" * 16] and all(r.error == 0 for r in rows)
    assert vectors.compress(few.limit(0)).collect() == [] and vectors.compress(spark.createDataFrame([(1, [], 1)], schema)).first().code == "00" * 16


def test_partial_distances_are_complete_for_the_nearest():
    rng = np.random.default_rng(3)
    book, points = rng.integers(-3, 3, (64, 6)), rng.integers(-3, 3, (3000, 6))
    code, error = vectors.nearest(points, book)
    every = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    assert (code == every.argmin(axis=1)).all() and (error == every.min(axis=1)).all()


def brute_repair(rows):
    """The cheapest (cost, audit) and its repaired text, of all edits of a conversation's (role, text), by exhaustive search."""
    best = None
    legal = __import__("re").compile(r"(s?(ua)+)?")
    seen, faults = set(), []
    for role, text in rows:
        core = text.rstrip(" \t\n\v\f\r")
        faults.append("b" if not core else "d" if (role, text) in seen else "" if core[-1] in ".!?" else "t")
        seen.add((role, text))
    choices = []
    for (role, text), fault in zip(rows, faults, strict=True):
        own = [("D", 3, None)]
        if fault not in ("b", "d"):
            own += [("K", fault == "t", (role, text))] + [("R", 2 + (fault == "t"), (to, text)) for to in ("user", "assistant")]
        choices.append(own)
    inserts = [seq for n in range(3) for seq in itertools.product(("user", "assistant"), repeat=n)]
    for edits in itertools.product(*choices):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            out, audit, cost = [], "", 0
            for i in range(len(rows) + 1):
                out += [(r, "") for r in gaps[i]]
                audit += "I" * len(gaps[i])
                cost += 2 * len(gaps[i])
                if i < len(rows):
                    audit += edits[i][0]
                    cost += edits[i][1]
                    out += [edits[i][2]] if edits[i][2] else []
            if (best is None or (cost, audit) < best[:2]) and legal.fullmatch("".join(r[:1] or "?" for r, _ in out)):
                best = cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
    return best


def test_repairs_are_the_cheapest():
    rng = random.Random(2)
    for _ in range(40):
        rows = [(rng.choice(["user", "assistant", "system", "tool", " "]), rng.choice(["a.", "a.", "b", "", "c!"])) for _ in range(rng.randrange(4))]
        _, _, _, _, _, cost, audit, digest = repair._repaired([(i, r, t) for i, (r, t) in enumerate(rows)])
        want = brute_repair(rows)
        assert (cost, audit, digest) == (want[0], want[1], sha(want[2])), rows


def talks():
    rng = random.Random(7)
    role, text = ["user", "assistant", "system", None, "Übersetzer"], ["Yes. ", "no", "", "Why?", None, "Ünd!\n", "a\nb."]
    rows = [(c, t if rng.random() > 0.1 else None, rng.choice(role), rng.choice(text) if rng.random() < 0.5 else f"{rng.random()}.") for c in [*range(40), None] for t in range(rng.randrange(1, 9))]
    rows += [(7, 3, "user", "same.")] * 5  # repeated rows, turns that several have
    return rows


def test_repair_of_rows(spark):
    rows = talks()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(3)
    work = repair.damaged(df)
    got = {r.key: r for r in repair.repair(work).collect()}
    in_pieces = {r.key: r for r in repair._in_pieces(work.filter("key is null or key < 30")).collect()}
    assert set(got) == {r[0] for r in rows}
    for key, row in got.items():
        own = []
        for c, turn, role, text in rows:
            if c != key:
                continue
            fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if fault == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if fault == 2 else text
            own += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        want = repair._repaired(own)
        assert tuple(row)[1:] == want, key
        initials = [r[1][:1] for r in own]
        assert row.illegal == sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        if own and key in in_pieces:
            assert tuple(in_pieces[key])[1:] == want, key
    assert repair.repair(work.limit(0)).count() == 0


def test_long_conversations_lie_in_pieces(spark):
    rng = random.Random(4)
    rows = [(1, i // 3, rng.choice(["user", "assistant", "tool"]), rng.choice(["a.", "b", ""]) if i % 5 else f"{i}.") for i in range(5000)] + [(2, 0, "user", "q?"), (2, 1, "assistant", "a.")]
    df = spark.createDataFrame([(*r, True) for r in rows], "key long, turn long, role string, text string, there boolean").repartition(5)
    got = {r.key: tuple(r)[1:] for r in repair.repair(df).collect()}
    for key in (1, 2):
        assert got[key] == repair._repaired(sorted((t, r, x) for k, t, r, x in rows if k == key)), key
