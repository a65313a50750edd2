"""Toxicity by a support vector machine over a gapped subsequence string kernel with Nyström landmarks.

Words are runs of letters (lower-cased, other characters inside a word dropped, single letters in a row joined to one
word) between a begin and an end mark; a word of more than PIECE letters is cut into overlapping pieces. The word kernel
counts the ordered letter triples two words share, each weighted by DECAY ** span, spans of at most SPAN letters,
normalised, to the power POWER (a kernel again); so letters inserted into a word or left out of it weaken the match but
don't end it. The kernel of two sentences is the sum of their different words' kernels. A sentence ends behind '.', '!' or
'?' before white space, at a newline, and after SENTENCE words.

Nyström features of a sentence are its kernels with landmark words, whitened by the landmarks' own kernel matrix; words
whose kernel with every telling landmark is below NEAR add nothing. The machine is linear in them and trained on labelled
sentences by dual coordinate descent: those of clean texts are clean; of a toxic text the sentence that is most toxic by
the words first, by the machine of the round before then, is toxic, the others have no label. Copies of telling words with
a letter put in or left out are toxic sentences of one word. Landmarks are the telling words and the least innocent words
of clean texts, looked for anew each round. A text scores its highest sentence, made a probability by logistic regression.

Cases: null texts and texts without letters have no sentence and get the lowest value seen in training; equal texts get
equal scores; without labelled rows of both classes every score is the share of label 1 among them, 0 without any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylog.llm._labelled import HOLD_OUT, labelled_sample
from quarrylog.llm._ops import arrow_map, crc_mod, pick
from quarrylog.llm._text import _BASE, _BASE_INVERSE, byte_class, chunks, mix
from quarrylog.llm.language import letters_of

SPAN, DECAY, PIECE = 6, 0.75, 24
LANDMARKS, ROUNDS, COST, POWER, NEAR = 160, 3, 20.0, 3, 0.3
SUPPORT, TELLING, VARIED = 4, 6.0, 5.0
#: Words of a sentence at most, and clean sentences that a round trains on.
SENTENCE, CLEAN = 40, 4000
#: Triples share this many cells of the weight table; a chance collision adds a stray match of one triple.
CELLS = 1 << 20
CHUNK = 4 << 20

_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
_STOP = byte_class((0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))
_BEGIN, _END = 1, 2


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters, each word's first letter, each text's first word (n + 1), and each word's sentence (growing, from 0)."""
    letters, at = letters_of(data, offsets)
    # White space and sentence ends in code points: where the byte starting a code point is one.
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    whole = len(lead) == len(letters)
    space = _SPACE[data[lead]] if whole else letters == 0
    ends = data[lead] == 10 if whole else np.zeros(len(letters), bool)
    if whole and len(lead):
        ends[:-1] |= _STOP[data[lead[:-1]]] & space[1:]
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    gap, ended = np.cumsum(space), np.cumsum(ends)
    keep = letters > 0
    letters, text, gap, ended = letters[keep], text[keep], gap[keep], ended[keep]
    new = np.ones(len(letters), bool)
    new[1:] = (gap[1:] != gap[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(new)
    single = np.diff(np.concatenate((starts, [len(letters)]))) == 1
    joined = np.zeros(len(starts), bool)
    joined[1:] = single[1:] & single[:-1] & (text[starts[1:]] == text[starts[:-1]])
    new[starts[joined]] = False
    starts = starts[~joined]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (text[starts[1:]] != text[starts[:-1]]) | (ended[starts[1:]] != ended[starts[:-1]])
    place = np.arange(len(starts)) - np.maximum.accumulate(np.where(fresh, np.arange(len(starts)), 0))
    sentence = np.cumsum(fresh | (place % SENTENCE == 0)) - 1
    return letters, starts, np.searchsorted(text[starts], np.arange(len(at))), sentence


def pieces(starts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of the words or their pieces, and the word of each."""
    ends = np.concatenate((starts[1:], [total]))
    size = ends - starts
    half = PIECE // 2
    n = np.where(size <= PIECE, 1, -(-(size - half) // half))
    word = np.repeat(np.arange(len(starts)), n)
    begin = starts[word] + (np.arange(len(word)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)) * half
    return begin, np.minimum(begin + PIECE, ends[word]), word


def distinct(letters: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one span for each distinct content, and the number of each span's content."""
    power, inverse = np.full(len(letters) + 1, _BASE, np.uint64), np.full(len(letters) + 1, _BASE_INVERSE, np.uint64)
    power[0] = inverse[0] = 1
    power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(letters.astype(np.uint64) + np.uint64(77)) * power[:-1])))
    _, one, which = np.unique((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64), return_index=True, return_inverse=True)
    return one, which.ravel()


def _shapes(letters: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Word and cell of the letter triples of each word, and their weight, one yield for each way a triple can lie."""
    size = end - begin + 2
    start = np.concatenate(([0], np.cumsum(size)))
    text = np.full(int(start[-1]), _BEGIN, np.uint64)
    inner = np.repeat(start[:-1] + 1 - begin, end - begin) + np.arange(int((end - begin).sum())) - np.repeat(np.concatenate(([0], np.cumsum(end - begin)[:-1])), end - begin) + np.repeat(begin, end - begin)
    source = inner - np.repeat(start[:-1] + 1 - begin, end - begin)
    text[inner] = letters[source].astype(np.uint64) + np.uint64(3)
    text[start[1:] - 1] = _END
    word = np.repeat(np.arange(len(begin)), size)
    left = np.repeat(start[1:], size) - np.arange(len(text))  # letters from here to the word's end
    for c in range(2, SPAN):
        rows = np.flatnonzero(left > c)
        base = text[rows] * np.uint64(0x9E3779B97F4A7C15) + text[rows + c] * np.uint64(0xC2B2AE3D27D4EB4F)
        for b in range(1, c):
            yield word[rows], mix(base + text[rows + b] * np.uint64(0x165667B19E3779F9 | 1)) & np.uint64(CELLS - 1), DECAY ** (c + 1)


def triples(letters: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, cell and weight of the letter triples of each word, equal triples of a word summed."""
    keys, weights = [], []
    for word, code, weight in _shapes(letters, begin, end):
        keys.append(word.astype(np.uint64) * np.uint64(CELLS) + code)
        weights.append(np.full(len(word), weight))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    keys, weights = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    firsts = np.flatnonzero(new)
    weights = np.add.reduceat(weights, firsts) if len(firsts) else weights
    keys = keys[firsts]
    return (keys >> np.uint64(20)).astype(np.int64), (keys & np.uint64(CELLS - 1)).astype(np.int64), weights


class Landmarks:
    """Kernel of words with a set of landmark words: normalised triple products to the power POWER."""

    def __init__(self, letters: np.ndarray, begin: np.ndarray, end: np.ndarray):
        word, cell, weight = triples(letters, begin, end)
        self.n = len(begin)
        norm = np.sqrt(np.bincount(word, weight * weight, self.n))
        self.cells, at = np.unique(cell, return_inverse=True)
        self.matrix = np.zeros((len(self.cells), self.n), np.float32)
        self.matrix[at.ravel(), word] = weight / np.maximum(norm, 1e-9)[word]
        self.row = np.full(CELLS, -1, np.int32)
        self.row[self.cells] = np.arange(len(self.cells))
        # The matrix by its entries, cell by cell.
        row, self.mark = np.nonzero(self.matrix)
        self.entry, self.first = self.matrix[row, self.mark].astype(np.float64), np.searchsorted(row, np.arange(len(self.cells) + 1))

    def candidates(self, letters: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The words whose kernel with a landmark may reach NEAR ** POWER, and few others.

        A word's norm is at least that of its triples not summed, which its length alone tells, so nothing is sorted or
        divided; no word that reaches it is left out.
        """
        out = [np.zeros(0, np.int64)]
        for s in range(0, len(begin), 4000):  # and way by way, so the products of long words stay small too
            b, e = begin[s : s + 4000], end[s : s + 4000]
            products = np.zeros(len(b) * self.n)
            for word, cell, weight in _shapes(letters, b, e):
                row = self.row[cell]
                shared = np.flatnonzero(row >= 0)
                row, word = row[shared], word[shared]
                size = self.first[row + 1] - self.first[row]
                ahead = np.cumsum(size) - size
                at = np.repeat(self.first[row] - ahead, size) + np.arange(int(size.sum()))
                products += np.bincount(np.repeat(word * self.n, size) + self.mark[at], weight * self.entry[at], len(products))
            least = sum((c - 1) * np.maximum(e - b + 2 - c, 0) * DECAY ** (2 * c + 2) for c in range(2, SPAN))
            out.append(s + np.flatnonzero(products.reshape(len(b), self.n).max(1, initial=0) >= (NEAR - 1e-4) * np.sqrt(least)))
        return np.concatenate(out)

    def kernel(self, letters: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros((len(begin), self.n), np.float32)
        if not len(begin):
            return out
        word, cell, weight = triples(letters, begin, end)
        norm = np.sqrt(np.maximum(np.bincount(word, weight * weight, len(begin)), 1e-12))
        row = self.row[cell]
        shared = row >= 0
        word, row, weight = word[shared], row[shared], weight[shared].astype(np.float32)
        edges = np.flatnonzero(np.diff(word, prepend=-1))
        for s in range(0, len(edges), 2000):  # a few thousand words at a time, so the products stay small
            part = edges[s : s + 2000]
            stop = edges[s + 2000] if s + 2000 < len(edges) else len(word)
            products = self.matrix[row[part[0] : stop]]
            products *= weight[part[0] : stop, None]
            own = word[part]
            out[own] = np.add.reduceat(products, part - part[0], 0) / norm[own, None]
        return out**POWER


def _kernels(sets: list[Landmarks], letters: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that are near a telling landmark (the first set's), and their kernels with all landmarks."""
    rows, values = [], []
    for s in range(0, len(begin), 20_000):
        b, e = begin[s : s + 20_000], end[s : s + 20_000]
        near = sets[0].candidates(letters, b, e)
        first = sets[0].kernel(letters, b[near], e[near])
        reached = first.max(1, initial=0) >= NEAR**POWER
        near = near[reached]
        rows.append(s + near)
        values.append(np.concatenate((first[reached], sets[1].kernel(letters, b[near], e[near])), 1))
    width = sum(m.n for m in sets)
    return np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*values, np.zeros((0, width), np.float32)]).astype(np.float64)


@dataclass
class Machine:
    """A sentence's value is the sum of its different words' kernels @ alpha, + bias; a text's probability comes from its highest."""

    sets: list[Landmarks]  # telling words, others
    alpha: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    floor: float = -2.0

    def words(self, letters: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """What each word adds."""
        out = np.zeros(len(begin))
        near, kernel = _kernels(self.sets, letters, begin, end)
        out[near] = kernel @ self.alpha
        return out

    def text_values(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Highest value of each text's sentences."""
        letters, starts, first, sentence = words_of(data, offsets)
        out = np.full(len(offsets) - 1, self.floor)
        if len(starts):
            begin, end, word = pieces(starts, len(letters))
            one, which = distinct(letters, begin, end)
            value = sentence_sums(self.words(letters, begin[one], end[one]), which, sentence[word], int(sentence[-1]) + 1) + self.bias
            has = np.flatnonzero(np.diff(first))
            out[has] = np.maximum.reduceat(value, sentence[first[has]])
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.text_values(data, offsets) + self.offset)))


def sentence_sums(value: np.ndarray, which: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    """Each sentence's sum of the values of its different words."""
    live = np.flatnonzero(value[which] != 0)
    pairs = np.unique(sentence[live] * len(value) + which[live])
    return np.bincount(pairs // len(value), value[pairs % len(value)], n)


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rng: np.random.Generator, sweeps: int = 30) -> np.ndarray:
    """Linear machine (hinge loss, the last column being the bias) by dual coordinate descent."""
    x = np.concatenate((x, np.ones((len(x), 1))), 1)
    alpha, w, q = np.zeros(len(x)), np.zeros(x.shape[1]), (x * x).sum(1)
    for _ in range(sweeps):
        for i in rng.permutation(len(x)):
            old = alpha[i]
            alpha[i] = min(max(old - (y[i] * (w @ x[i]) - 1) / q[i], 0.0), cost[i])
            if alpha[i] != old:
                w += (alpha[i] - old) * y[i] * x[i]
    return w


def _logistic(v: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic regression, lightly regularised, by Newton's method."""
    a = np.zeros(2)
    x = np.stack((v, np.ones(len(v))), 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        g = x.T @ (p - y) + 0.01 * len(v) * 1e-2 * a * [1, 0]
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-4 * len(v), 1e-6])
        step = np.linalg.solve(h, g)
        a -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(a[0]), float(a[1])


def _variants(letters: np.ndarray, begin: np.ndarray, end: np.ndarray, alphabet: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word with a letter put in and with a letter left out at each inner place: letters, word sizes, source words."""
    out, sizes, source = [], [], []
    for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        w = letters[a:b]
        for k in range(1, len(w)):
            out += [np.concatenate((w[:k], rng.choice(alphabet, 1), w[k:])), np.concatenate((w[:k], w[k + 1 :]))]
            sizes += [len(w) + 1, len(w) - 1]
            source += [i, i]
    return np.concatenate([*out, np.zeros(0, letters.dtype)]), np.array(sizes, np.int64), np.array(source, np.int64)


def fit(texts: list[str], labels: list[int], prior: float, seed: int = 11) -> Machine | None:
    """Trains on equal shares of both classes; the logit is shifted to the prior share of label 1.

    Near copies among the texts (equal least word-pair hash) count once where words are counted. A word is telling that
    SUPPORT toxic texts or more hold and whose odds are TELLING times the clean texts'.
    """
    y = np.array(labels)
    if not len(texts) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    _, _, data, offsets = next(iter(chunks(pa.array(texts, pa.string()), 1 << 40)))
    letters, starts, first, sentence = words_of(data, offsets)
    begin, end, word = pieces(starts, len(letters))
    one, which = distinct(letters, begin, end)
    text_of, sentence = np.searchsorted(first, word, "right") - 1, sentence[word]
    begin, end = begin[one], end[one]
    n_words, n_sentences = len(one), int(sentence[-1]) + 1 if len(sentence) else 0
    of_text = np.zeros(n_sentences, np.int64)
    of_text[sentence] = text_of
    pair_hash = mix(which[:-1].astype(np.uint64) * np.uint64(n_words) + which[1:].astype(np.uint64))
    cluster = np.arange(len(texts)).astype(np.uint64)
    edges = np.searchsorted(text_of, np.arange(len(texts) + 1))
    for t in range(len(texts)):
        if edges[t + 1] - edges[t] > 8:
            cluster[t] = pair_hash[edges[t] : edges[t + 1] - 1].min() | np.uint64(1 << 63)
    _, cluster = np.unique(np.stack((cluster, y.astype(np.uint64)), 1), axis=0, return_inverse=True)
    cluster = cluster.ravel()
    label_of = np.zeros(cluster.max() + 1, np.int64)
    label_of[cluster] = y
    holders = np.unique(np.stack((cluster[text_of], which), 1), axis=0)
    toxic = label_of[holders[:, 0]] == 1
    in_toxic, in_clean = np.bincount(holders[toxic, 1], minlength=n_words), np.bincount(holders[~toxic, 1], minlength=n_words)
    n1, n0 = int((label_of == 1).sum()), int((label_of == 0).sum())
    odds = np.log((in_toxic + 0.2) / (n1 + 0.4)) - np.log((in_clean + 0.2) / (n0 + 0.4))
    telling = np.flatnonzero((in_toxic >= SUPPORT) & (odds >= np.log(TELLING)))
    telling = telling[np.argsort(-odds[telling] * np.sqrt(in_toxic[telling]), kind="stable")]
    if not len(telling):
        telling = np.argsort(-odds, kind="stable")[:10]

    chosen = telling[: LANDMARKS // 2]
    clean_words = np.setdiff1d(np.flatnonzero(in_clean), telling)
    common = np.setdiff1d(np.argsort(-in_clean, kind="stable")[: 40 * LANDMARKS], telling)
    others = rng.choice(common, min(len(common), LANDMARKS // 4), replace=False)
    long = telling[(end - begin)[telling] >= 4][:60]
    extra, sizes, source = _variants(letters, begin[long], end[long], letters[rng.integers(0, len(letters), 2000)], rng)
    stop = np.cumsum(sizes)
    w_varied = VARIED * in_toxic[long][source] / np.maximum(np.bincount(source, minlength=len(long)), 1)[source]
    # What makes a sentence of a toxic text the toxic one: first its words' odds.
    evidence = sentence_sums(np.where(np.isin(np.arange(n_words), telling), np.maximum(odds, 0.1), 0.0), which, sentence, n_sentences)
    machine = None
    for _ in range(ROUNDS):
        marks = np.concatenate((chosen, others))
        sets = [Landmarks(letters, begin[m], end[m]) for m in (chosen, others)]
        kernel = lambda *z: np.concatenate([m.kernel(*z) for m in sets], 1).astype(np.float64)  # noqa: B023, E731
        values, vectors = np.linalg.eigh(kernel(letters, begin[marks], end[marks]) + 1e-4 * np.eye(len(marks)))
        whiten = vectors / np.sqrt(np.maximum(values, 1e-6))
        near, features = _kernels(sets, letters, begin, end)
        row = np.full(n_words, -1)
        row[near] = np.arange(len(near))
        live = np.flatnonzero(row[which] >= 0)
        pairs = np.unique(sentence[live] * n_words + which[live])  # a sentence's different words that are near
        held, of_word = pairs // n_words, row[pairs % n_words]
        filled, at = np.unique(held, return_index=True)  # the sentences that have any

        def best(evidence: np.ndarray, filled: np.ndarray = filled) -> np.ndarray:
            """Places in `filled` of the sentence with most evidence of each toxic text that has some."""
            own = np.flatnonzero((y[of_text[filled]] == 1) & (evidence[filled] > 0))
            order = own[np.lexsort((-evidence[filled[own]], of_text[filled[own]]))]
            return order[np.unique(of_text[filled[order]], return_index=True)[1]]

        x = np.add.reduceat(features[of_word], at, 0) @ whiten if len(filled) else np.zeros((0, len(marks)))
        positive = best(evidence)
        negative = np.flatnonzero(y[of_text[filled]] == 0)
        if len(negative) > CLEAN:  # the least innocent ones by the round before, and others at random
            hard = negative[np.argsort(-evidence[filled[negative]], kind="stable")[: CLEAN // 2]]
            negative = np.concatenate((hard, rng.choice(np.setdiff1d(negative, hard), CLEAN // 2, replace=False)))
        x = [x[positive], kernel(extra, stop - sizes, stop) @ whiten, x[negative], np.zeros((1, len(marks)))]
        sign = np.repeat([1.0, 1.0, -1.0, -1.0], [len(part) for part in x])
        weight = np.concatenate((np.ones(len(positive)), w_varied, np.ones(len(negative)), [10.0]))
        balance = np.where(sign > 0, weight[sign < 0].sum() / max(weight[sign > 0].sum(), 1e-9), 1.0)
        beta = _svm(np.concatenate(x), sign, COST * np.maximum(weight * balance / weight.mean(), 0.3), rng)
        machine = Machine(sets, whiten @ beta[:-1], float(beta[-1]))
        by_word = np.zeros(n_words)
        by_word[near] = features @ machine.alpha
        evidence = sentence_sums(by_word, which, sentence, n_sentences)
        # The clean words nearest to being toxic are the next round's landmarks.
        others = clean_words[np.argsort(-by_word[clean_words], kind="stable")][: LANDMARKS // 2]
    by_text = np.full(len(texts), np.nan)
    if n_sentences:
        np.fmax.at(by_text, of_text, evidence + machine.bias)
    machine.floor = float(np.nanmin(by_text))
    by_text = np.nan_to_num(by_text, nan=machine.floor)
    machine.slope, machine.offset = _logistic(by_text, y)
    share, prior = float(y.mean()), min(max(prior, 0.01), 0.99)
    machine.offset += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return machine


def classify(df: DataFrame, machine: Machine | float | None, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, held_out, score, predicted) for every row; score is the probability of label 1 (machine: a number, that for all)."""
    work = pick(df, key=key, text=text, held_out=F.coalesce(crc_mod(df[key], HOLD_OUT) == 0, F.lit(False)))
    shared = df.sparkSession.sparkContext.broadcast(machine)

    def run(batch):
        for a, b, data, offsets in chunks(batch.column("text"), CHUNK):
            own = shared.value
            score = own.score(data, offsets) if isinstance(own, Machine) else np.full(b - a, float(own or 0.0))
            yield {"key": batch.column("key").slice(a, b - a), "held_out": batch.column("held_out").slice(a, b - a), "score": score, "predicted": pa.array((score >= threshold).astype(np.int32))}

    return arrow_map(work, run, f"key {work.schema['key'].dataType.simpleString()}, held_out boolean, score double, predicted int").withColumnRenamed("key", key)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Machine | float:
    """The machine, or without labelled rows of both classes the share of label 1 among them (0 without any)."""
    sample, prior = labelled_sample(docs, labels, label)
    machine = fit([t for t, _ in sample], [y for _, y in sample], prior)
    return machine if machine is not None else prior if sample else 0.0
