"""Language identification by interpolated Kneser-Ney character models.

Texts become symbols: every letter of any script (lower-cased) is its own symbol, its code point, and every run of
anything else is one gap. For each language an n-gram model with interpolated Kneser-Ney smoothing is fitted and kept as
sorted arrays of 64-bit n-gram hashes, one an order, with the logarithm of the probability beside each. A text goes to the
language of lowest cross-entropy per symbol. It is rejected where that entropy lies above a limit calibrated for the
language on texts kept out of the counts, wider for shorter texts.

Fitting is on a bounded sample: texts whose digest falls below a rate, chosen for each language so that about
SAMPLE_TEXTS texts and SAMPLE_BYTES bytes over all languages are expected, and LEAST_TEXTS of each language. A very long
text gives the sample one piece from a place that its digest tells, so the bytes of each language are bounded too. Scoring
reads every whole text; the n-grams of a run of texts are looked up once each, however often they stand there.

Cases: a null text, an empty one and one without letters are `und`, score 0, rejected; null labels are not learned from;
with nothing to learn from every text is `und`; ties go to the language first by code point; a symbol that no training
text has gets the mass the model leaves to unseen symbols.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from quarrylog.llm._ops import give_back, pick
from quarrylog.llm._text import chunks, mix

ORDER = 5
SAMPLE_TEXTS = 3000
SAMPLE_BYTES = 4 << 20
#: Texts of each language that are expected in the sample, however many languages there are.
LEAST_TEXTS = 20
#: Least code points of a text that the sample takes; longer texts give a piece, longer where there are fewer languages.
LEAST_PIECE = 500
#: Rates of labels that are still sent to all tasks.
BROADCAST_LABELS = 100_000
#: Every so many sampled texts is kept for calibration.
CALIBRATE_EVERY = 5
#: Bits per symbol above the highest calibration entropy, and deviations of a text's mean, before a text is rejected.
MARGIN_BITS, DEVIATIONS = 1.0, 6.0
#: Bytes of text scored at once.
CHUNK = 1 << 19

_GAP = 0
_PLANE = 0x3000
_FACTORS = [np.uint64((0x9E3779B97F4A7C15 * (2 * j + 5)) & (2**64 - 1) | 1) for j in range(ORDER)]

_fold: np.ndarray | None = None


def _folding() -> np.ndarray:
    """Code point to lower-cased letter, 0 for what is no letter; code points from _PLANE on map to themselves if letters."""
    global _fold
    if _fold is None:
        table = np.zeros(_PLANE, np.uint32)
        for c in range(_PLANE):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold = table
    return _fold


def letters_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters (0: no letter) of texts laid end to end, and their offsets."""
    lead = (data & 0xC0) != 0x80
    at = np.concatenate(([0], np.cumsum(lead)))[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != at[-1]:  # damaged UTF-8: one text at a time
        parts = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offsets, offsets[1:], strict=False)]
        points, at = np.concatenate([*parts, np.zeros(0, np.uint32)]), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    fold = _folding()
    out = np.zeros(len(points), np.uint32)
    near = points < _PLANE
    out[near] = fold[points[near]]
    if not near.all():
        distinct, where = np.unique(points[~near], return_inverse=True)
        out[~near] = np.array([p if chr(p).isalpha() else 0 for p in distinct.tolist()], np.uint32)[where]
    return out, at


def symbols_of(letters: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts and their offsets: letters, and one gap for each run of anything else."""
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != _GAP) | (letters[:-1] != _GAP)
    keep[at[:-1][at[:-1] < len(letters)]] = True
    return letters[keep], np.concatenate(([0], np.cumsum(keep)))[at]


@dataclass
class Grams:
    """Hashes of the n-grams (n from 1 to ORDER) that end at each symbol, and of their contexts, the n - 1 symbols before."""

    keys: list[np.ndarray]
    contexts: list[np.ndarray]  # from n = 2

    def __getitem__(self, rows: np.ndarray) -> Grams:
        return Grams([k[rows] for k in self.keys], [c[rows] for c in self.contexts])

    def __len__(self) -> int:
        return len(self.keys[0])

    def distinct(self) -> tuple[Grams, np.ndarray]:
        """Each different ORDER-gram once, and the number of every symbol's."""
        _, one, which = np.unique(self.keys[-1], return_index=True, return_inverse=True)
        return self[one], which.ravel()


def grams(symbols: np.ndarray, at: np.ndarray) -> Grams:
    """The n-grams of texts, which begin in a context of gaps. A hash is the sum of scrambled symbols times a factor of their place."""
    value = mix(symbols.astype(np.uint64) + np.uint64(1))
    gap = mix(np.array([_GAP + 1], np.uint64))[0]
    place = np.arange(len(symbols)) - np.repeat(at[:-1], np.diff(at))
    keys, contexts = [], []
    total, before = np.zeros(len(symbols), np.uint64), np.zeros(len(symbols), np.uint64)
    for n in range(1, ORDER + 1):
        back = n - 1
        shifted = np.full(len(symbols), gap, np.uint64)
        shifted[back:] = value[: max(0, len(value) - back)]
        shifted[place < back] = gap
        total = total + shifted * _FACTORS[back]
        keys.append(total)
        if n > 1:
            before = before + shifted * _FACTORS[back - 1]
            contexts.append(before)
    return Grams(keys, contexts)


def _lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


@dataclass
class Language:
    """Kneser-Ney model of one language: by order the sorted n-gram hashes and log2 of their probabilities, and by order
    from 2 the contexts' hashes and log2 of the mass each leaves to the lower order."""

    name: str
    hashes: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    unseen: float  # log2 of a symbol no training text has
    limit: float = 8.0 + MARGIN_BITS
    spread: float = 1.0

    def log2(self, g: Grams) -> np.ndarray:
        """log2 of each n-gram's last symbol given the others."""
        out = np.zeros(len(g), np.float32)
        todo = np.arange(len(g))
        for n in range(ORDER, 0, -1):
            found, at = _lookup(self.hashes[n - 1], g.keys[n - 1][todo])
            out[todo[found]] += self.logs[n - 1][at[found]]
            todo = todo[~found]
            if not len(todo):
                break
            if n == 1:
                out[todo] += self.unseen
                break
            found, at = _lookup(self.contexts[n - 2], g.contexts[n - 2][todo])
            out[todo[found]] += self.backoff[n - 2][at[found]]
        return out


@dataclass
class Model:
    languages: list[Language]


def _fitted(name: str, g: Grams, vocabulary: int) -> Language:
    """The model of one language's n-grams; vocabulary: symbols there may be."""
    hashes, logs, contexts, backoff = [], [], [], []
    # Occurrences in the highest order; below it, how many different symbols come before an n-gram.
    keys, one, count = np.unique(g.keys[-1], return_index=True, return_counts=True)
    tables = {ORDER: (keys, one, count)}
    for n in range(ORDER - 1, 0, -1):
        above = tables[n + 1][1]
        keys, first, count = np.unique(g.keys[n - 1][above], return_index=True, return_counts=True)
        tables[n] = keys, above[first], count
    lower, unseen = None, 0.0
    for n in range(1, ORDER + 1):
        keys, one, count = tables[n]
        once, twice = (count == 1).sum(), (count == 2).sum()
        d = once / (once + 2 * twice) if once and twice else 0.5
        context = g.contexts[n - 2][one] if n > 1 else np.zeros(len(keys), np.uint64)
        context, where = np.unique(context, return_inverse=True)
        where = where.ravel()
        total = np.bincount(where, count, len(context))
        mass = d * np.bincount(where, minlength=len(context)) / np.maximum(total, 1)
        below = 1 / vocabulary if n == 1 else lower[np.searchsorted(tables[n - 1][0], g.keys[n - 2][one])]
        probability = (count - d) / total[where] + mass[where] * below
        if n == 1:
            unseen = float(np.log2((mass[0] if len(mass) else 1.0) / vocabulary))
        else:
            contexts.append(context)
            backoff.append(np.log2(np.maximum(mass, 1e-12)).astype(np.float32))
        hashes.append(keys)
        logs.append(np.log2(np.maximum(probability, 1e-12)).astype(np.float32))
        lower = probability
    return Language(name, hashes, logs, contexts, backoff, unseen)


def fit(texts: list[str], labels: list[str]) -> Model | None:
    """Kneser-Ney models of each label's texts."""
    names = sorted(set(labels))
    if not names:
        return None
    held = np.arange(len(texts)) % CALIBRATE_EVERY == CALIBRATE_EVERY - 1
    label = np.array(labels, object)

    def symbols(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, _, data, offsets = next(chunks(pa.array([texts[i] for i in rows.tolist()], pa.string()), 1 << 40))
        return symbols_of(*letters_of(data, offsets))

    learned, apart = {}, {}
    for name in names:
        own = np.flatnonzero(label == name)
        kept_out = held[own] & ~held[own].all()
        # Without texts to calibrate on, those learned from are taken.
        learned[name], apart[name] = symbols(own[~kept_out]), symbols(own[kept_out]) if kept_out.any() else None
    vocabulary = len(np.unique(np.concatenate([np.unique(part[0]) for part in (*learned.values(), *apart.values()) if part]))) + 2
    out = []
    for name in names:
        language = _fitted(name, grams(*learned[name]), vocabulary)
        own, at = apart[name] if apart[name] and len(apart[name][0]) else learned[name]
        parts = [own[a:b] for a, b in zip(at, at[1:], strict=False) if b > a]
        entropy = [-language.log2(grams(p, np.array([0, len(p)]))) for p in parts]
        if entropy:
            means, lengths = np.array([e.mean() for e in entropy]), np.array([len(p) for p in parts])
            language.spread = float(np.std(np.concatenate(entropy[:500])))
            language.limit = float(means[lengths >= min(200, lengths.max())].max() + MARGIN_BITS)
        out.append(language)
        give_back()
    return Model(out)


def training_sample(labelled: DataFrame, key: str, text: str, label: str, texts: int = SAMPLE_TEXTS, size: int = SAMPLE_BYTES, least: int = LEAST_TEXTS) -> list[tuple[str, str]]:
    """(text, label) of a bounded sample: each label's rows whose digest is below the rate that gives its share.

    A label's rate gives `texts` and `size` by the number of labels, but `least` texts at least. Of a text longer than
    size / labels / least code points (LEAST_PIECE at least) a piece of that length is taken, so the driver is sent some
    max(size, LEAST_PIECE * least * labels) code points beside `size` bytes, however long the texts are. Labels
    themselves are counted and joined as a table.
    """
    share = labelled.filter(labelled[label].isNotNull()).select(labelled[label].cast("string")).distinct().count()
    if not share:
        return []
    piece = max(LEAST_PIECE, int(size / share / max(least, 1)))
    rows = pick(labelled, key=labelled[key].cast("string"), text=text, label=labelled[label].cast("string")).filter("label is not null and text is not null")
    begin = F.pmod(F.xxhash64(F.lit("piece"), "text"), F.greatest(F.length("text") - piece + 1, F.lit(1))).cast("int") + 1
    rows = rows.withColumn("piece", F.when(F.length("text") > piece, F.col("text").substr(begin, F.lit(piece))).otherwise(F.col("text")))
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.octet_length("piece")).alias("bytes"))
    fair = F.least(F.lit(texts / share) / F.col("n"), F.lit(size / share) / F.greatest("bytes", F.lit(1)))
    rates = sizes.select("label", F.greatest(fair, F.lit(float(least)) / F.col("n")).alias("rate"))
    rates = F.broadcast(rates) if share <= BROADCAST_LABELS else rates
    u = F.pmod(F.xxhash64(F.lit("sample"), "key", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    found = rows.join(rates, "label").filter(u < F.col("rate")).select("piece", "label").collect()
    return sorted((r["piece"], r["label"]) for r in found)


FOUND = "struct<lang_pred:string,score:double,entropy:double,rejected:boolean>"


def _identified(model: Model | None, column: pa.Array) -> pa.Array:
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("rejected", pa.bool_())])
    out = []
    for a, b, data, offsets in chunks(column, CHUNK):
        n = b - a
        letters, at = letters_of(data, offsets)
        has = np.diff(np.concatenate(([0], np.cumsum(letters > 0)))[at]) > 0
        names, score, entropy, rejected = np.full(n, "und", object), np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
        if model is not None and has.any():
            symbols, start = symbols_of(letters, at)
            g, which = grams(symbols, start).distinct()
            size = np.diff(start)
            mean = np.zeros((n, len(model.languages)))
            for k, language in enumerate(model.languages):
                total = np.concatenate(([0.0], np.cumsum(-language.log2(g)[which], dtype=np.float64)))
                mean[:, k] = (total[start[1:]] - total[start[:-1]]) / np.maximum(size, 1)
            best = mean.argmin(1)
            low = mean[np.arange(n), best]
            weight = np.exp2(-(mean - low[:, None]) * np.minimum(size, 25)[:, None])
            limit, spread = np.array([m.limit for m in model.languages]), np.array([m.spread for m in model.languages])
            names = np.where(has, np.array([m.name for m in model.languages], object)[best], "und")
            score = np.where(has, 1 / weight.sum(1), 0.0)
            entropy = np.where(has, low, np.nan)
            rejected = ~has | (low > limit[best] + DEVIATIONS * spread[best] / np.sqrt(np.maximum(size, 1)))
        out.append(pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)], fields=list(kind)))
    return pa.concat_arrays(out) if out else pa.array([], kind)


def identified(spark: SparkSession, model: Model | None, text: Column) -> Column:
    """Struct (lang_pred, score, entropy, rejected) of a text column; only the texts go to Python.

    score: the predicted language's share of 2 ** (-entropy * min(symbols, 25)) over languages; entropy in bits a symbol.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield _identified(shared.value, column)
            give_back()

    return F.arrow_udf(run, FOUND, ArrowUDFType.SCALAR_ITER)(text)


def predict(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, lang_pred, score, entropy, rejected, *carry) for every row."""
    kept = {f"c{i}": c for i, c in enumerate(carry)}
    work = pick(df, key=key, text=text, **kept)
    found = work.withColumn("found", identified(df.sparkSession, model, F.col("text")))
    return found.select("key", "found.*", *kept).withColumnsRenamed({"key": key, **kept})
