"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; one more channel tells whether the six bytes from here on also stand a few bytes earlier. Learned
filters slide over the bytes, their responses are max-pooled over overlapping chunks that cover the whole text (chunks of
two blocks of BLOCK bytes, one starting at every block), and the mean and the maximum of the chunks are combined into one
probability. Every byte of a text is read, whatever its length.

Training is by Adam on a bounded sample of labelled texts (see _labelled); gradients flow through the pooled positions.

Cases: null and empty texts have one chunk of padding and get its score; equal texts get equal scores; without labelled
rows every score is the prior 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylog.llm._labelled import HOLD_OUT, labelled_sample
from quarrylog.llm._ops import arrow_map, crc_mod, pick
from quarrylog.llm._text import chunks

EMBED, WIDTH, STRIDE, FILTERS, BLOCK = 7, 8, 2, 24, 128
#: Distances at which a repeat of six bytes is looked for.
LAGS = range(3, 33)
EPOCHS, BATCH, RATE, DECAY = 10, 32, 0.003, 1e-4
_PER_BLOCK = BLOCK // STRIDE


def laid_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid out in blocks, and each text's first block (n + 1).

    WIDTH zero bytes stand before a text and the largest lag or more behind it, so neither a window nor a repeat reaches
    into another text and a score depends on its own text alone.
    """
    size = np.diff(offsets)
    blocks = -(-(WIDTH + size + LAGS.stop) // BLOCK)
    first = np.concatenate(([0], np.cumsum(blocks)))
    out = np.zeros(int(first[-1]) * BLOCK + WIDTH, np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * BLOCK + WIDTH - offsets[:-1], size)] = data
    return out, first


def repeats(data: np.ndarray) -> np.ndarray:
    """Whether the six bytes from each position on equal those at one of LAGS before it (and aren't zero)."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for j in range(6):
        key = key << np.uint64(8) | padded[j : j + n]
    out = np.zeros(n, bool)
    for lag in LAGS:
        out[lag:] |= key[lag:] == key[:-lag]
    return out & (key != 0)


@dataclass
class Net:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out]

    def inputs(self, data: np.ndarray) -> np.ndarray:
        x = np.empty((len(data), EMBED + 1), np.float32)
        x[:, :EMBED] = self.embed[data]
        x[:, EMBED] = repeats(data)
        return x

    def pooled(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest response of each filter in each block [blocks, filters], and at which window."""
        n = (len(x) - WIDTH) // BLOCK
        step = x.strides[0]
        view = np.lib.stride_tricks.as_strided(x, (n * _PER_BLOCK, WIDTH * (EMBED + 1)), (step * STRIDE, x.strides[1]), writeable=False)
        best, at = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64) if where else None
        for s in range(0, n, 64):
            e = min(n, s + 64)
            response = (np.ascontiguousarray(view[s * _PER_BLOCK : e * _PER_BLOCK]) @ self.filters).reshape(e - s, _PER_BLOCK, FILTERS)
            if where:
                at[s:e] = response.argmax(1)
                best[s:e] = np.take_along_axis(response, at[s:e][:, None], 1)[:, 0]
            else:
                best[s:e] = response.max(1)
        return best + self.bias, at

    def features(self, best: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Mean and maximum over each text's chunks of the rectified responses."""
        chunk, starts = chunk_max(np.maximum(best, 0), first)
        mean = np.add.reduceat(chunk, starts[:-1], 0) / np.diff(starts)[:, None]
        return np.concatenate((mean, np.maximum.reduceat(chunk, starts[:-1], 0), np.ones((len(first) - 1, 1))), 1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        laid, first = laid_out(data, offsets)
        best, _ = self.pooled(self.inputs(laid))
        # Rounded, as the last digits of a matrix product depend on where in the batch a text stands.
        return np.round(1 / (1 + np.exp(-(self.features(best, first) @ self.out + self.shift))), 6)


def chunk_max(best: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each chunk's maximum (a block and the next of its text; a text of one block is one chunk), and each text's first chunk."""
    last = np.zeros(len(best), bool)
    last[first[1:] - 1] = True
    alone = np.zeros(len(best), bool)
    alone[first[:-1][np.diff(first) == 1]] = True
    following = np.concatenate((best[1:], best[-1:]))
    pair = np.where(last[:, None], best, np.maximum(best, following))
    keep = ~last | alone
    return pair[keep], np.concatenate(([0], np.cumsum(np.maximum(np.diff(first) - 1, 1))))


def fit(texts: list[str], labels: list[int], prior: float, seed: int = 7) -> Net | None:
    """Trains on equal shares of both classes; the logit is shifted to the prior share of label 1."""
    if not texts:
        return None
    rng = np.random.default_rng(seed)
    scale = 1 / np.sqrt(WIDTH * (EMBED + 1))
    net = Net(rng.normal(0, 1, (256, EMBED)).astype(np.float32), rng.normal(0, scale, (WIDTH * (EMBED + 1), FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS + 1))
    moment = [[np.zeros_like(p, dtype=np.float64) for p in net.parts()] for _ in range(2)]
    raw = [t.encode() for t in texts]
    y_all = np.array(labels, np.float64)
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(raw))
        for s in range(0, len(order), BATCH):
            rows = order[s : s + BATCH]
            y = y_all[rows]
            offsets = np.concatenate(([0], np.cumsum([len(raw[i]) for i in rows])))
            laid, first = laid_out(np.frombuffer(b"".join(raw[i] for i in rows), np.uint8), offsets)
            x = net.inputs(laid)
            best, at = net.pooled(x, True)
            active = np.maximum(best, 0)
            feature = net.features(best, first)
            p = 1 / (1 + np.exp(-(feature @ net.out)))
            error = (p - y) / len(rows)
            g_out = feature.T @ error + DECAY * net.out
            # Back to blocks: a chunk's gradient goes to the larger of its two blocks.
            n_chunks = np.maximum(np.diff(first) - 1, 1)
            text_of = np.repeat(np.arange(len(rows)), n_chunks)
            place = np.arange(len(text_of)) - np.repeat(np.concatenate(([0], np.cumsum(n_chunks)[:-1])), n_chunks)
            left = first[text_of] + place
            right = np.minimum(left + 1, first[text_of + 1] - 1)
            pick_right = active[right] > active[left]
            chunk = np.where(pick_right, active[right], active[left])
            g_chunk = (error / n_chunks)[text_of][:, None] * net.out[:FILTERS]
            starts = np.concatenate(([0], np.cumsum(n_chunks)))
            top = np.maximum.reduceat(chunk, starts[:-1], 0)[text_of]
            is_top = (chunk == top) & (chunk > 0)
            share = np.maximum(np.add.reduceat(is_top.astype(np.float64), starts[:-1], 0), 1)[text_of]
            g_chunk = g_chunk + is_top / share * (error[text_of][:, None] * net.out[FILTERS : 2 * FILTERS])
            g_block = np.zeros(best.shape)
            np.add.at(g_block, (np.where(pick_right, right[:, None], left[:, None]), np.arange(FILTERS)[None]), g_chunk)
            g_block *= best > 0
            b, f = np.nonzero(g_block)
            g = g_block[b, f]
            begin = b * BLOCK + at[b, f] * STRIDE
            inside = begin[:, None] + np.arange(WIDTH)
            windows = x[inside].reshape(len(b), WIDTH * (EMBED + 1)).astype(np.float64)
            g_filters = np.zeros(net.filters.shape)
            for k in range(FILTERS):
                own = f == k
                g_filters[:, k] = g[own] @ windows[own]
            g_x = (g[:, None] * net.filters.T[f]).reshape(len(b), WIDTH, EMBED + 1)[:, :, :EMBED]
            g_embed = np.zeros(net.embed.shape)
            np.add.at(g_embed, laid[inside].ravel(), g_x.reshape(-1, EMBED))
            g_bias = g_block.sum(0)
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for part, grad, m, v in zip(net.parts(), (g_embed, g_filters, g_bias, g_out), *moment, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                part -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(part.dtype)
    share = min(max(y_all.mean(), 0.01), 0.99)
    prior = min(max(prior, 0.01), 0.99)
    net.shift = float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return net


def classify(df: DataFrame, net: Net | None, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """(key, held_out, score, predicted) for every row; score is the probability of label 1."""
    work = pick(df, key=key, text=text, held_out=F.coalesce(crc_mod(df[key], HOLD_OUT) == 0, F.lit(False)))
    shared = df.sparkSession.sparkContext.broadcast(net)

    def run(batch):
        for a, b, data, offsets in chunks(batch.column("text")):
            score = shared.value.score(data, offsets) if shared.value is not None else np.full(b - a, 0.5)
            yield {"key": batch.column("key").slice(a, b - a), "held_out": batch.column("held_out").slice(a, b - a), "score": score, "predicted": pa.array((score >= threshold).astype(np.int32))}

    return arrow_map(work, run, f"key {work.schema['key'].dataType.simpleString()}, held_out boolean, score double, predicted int").withColumnRenamed("key", key)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Net | None:
    sample, prior = labelled_sample(docs, labels, label)
    return fit([t for t, _ in sample], [y for _, y in sample], prior)
