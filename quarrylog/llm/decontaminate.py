"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is a run of whole texts of about SHARD_BYTES. Its words become symbols: a word some benchmark window holds gets
the rank of its hash among the benchmark's words, every maximal run of other words is one separator, and so is each end
of text. Over the symbols stand a suffix order, its Burrows-Wheeler transform in a wavelet matrix with rank counts, and
every SAMPLE-th suffix position. All windows of all items are searched backwards at once; matching rows step back with
the LF mapping to a sampled position, which locates the occurrence. Located windows of a text are merged into removal
spans in word positions and in byte offsets.

Windows are `window` consecutive words of an item; an item with fewer words, but not none, is one window. Words are
runs of ASCII letters and digits and non-ASCII characters after lower-casing A-Z.

Cases: null or empty texts have no words and no hits; an item without words has no window; repeated items each count by
their id (the same id twice counts once); null item ids are left out of item lists but their words are hit.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.llm._ops import arrow_map, pick
from quarrylog.llm._text import ALNUM, LOWER, chunks, span_hashes, spans

WINDOW = 10
SHARD_BYTES = 1 << 21
#: Suffix positions kept in a shard: those divisible by this.
SAMPLE = 8
SPANS = "array<struct<first_word:long,end_word:long,begin:long,end:long>>"
#: Benchmark text a pass searches for at once; a larger benchmark takes several passes over the texts.
PASS_BYTES = 8 << 20


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, starts, ends and each text's first word."""
    starts, ends, first = spans(data, offsets, ALNUM)
    return span_hashes(data, starts, ends, LOWER), starts, ends, first


class Patterns:
    """The distinct windows of benchmark items as rows of symbols, by length, and the items that hold each."""

    def __init__(self, items: list[tuple], window: int):
        texts = pa.array([t for _, t in items], pa.string())
        hashes, firsts = [], [0]
        for _, _, data, offsets in chunks(texts):
            h, _, _, first = words_of(data, offsets)
            hashes.append(h)
            firsts += (first[1:] + firsts[-1]).tolist()
        hashes = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        self.vocabulary, symbol = np.unique(hashes, return_inverse=True)
        self.ids = [i for i, _ in items]
        rows: dict[int, list] = {}
        owners: dict[int, list] = {}
        for k, (a, b) in enumerate(zip(firsts, firsts[1:], strict=False)):
            n = min(window, b - a)
            for s in range(a, b - n + 1) if n else ():
                rows.setdefault(n, []).append(symbol[s : s + n] + 1)
                owners.setdefault(n, []).append(k)
        #: (length, windows [n, length], start of each window's items in `owner` (n + 1), owner)
        self.groups = []
        for n, found in sorted(rows.items()):
            distinct, inverse = np.unique(np.array(found), axis=0, return_inverse=True)
            pairs = np.unique(np.stack((inverse.ravel(), np.array(owners[n])), 1), axis=0)
            self.groups.append((n, distinct, np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1]))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in sorted order, by prefix doubling that only re-sorts what is still tied.

    A suffix that ends is smaller than any longer one. Symbols are below 2 ** 21.
    """
    n = len(text)
    padded = np.concatenate((text + 1, np.zeros(2, text.dtype))).astype(np.uint64)
    key = padded[:n] << np.uint64(42) | padded[1 : n + 1] << np.uint64(21) | padded[2 : n + 2]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n + 1, np.int64)  # rank: first row of the suffix's tied group
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order], rank[n] = group, -1
    depth = 3
    tied = ~new
    tied[:-1] |= ~new[1:]
    rows = np.flatnonzero(tied)
    while len(rows):
        at = order[rows]
        second = rank[np.minimum(at + depth, n)] + 1
        both = (group[rows].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        by = np.argsort(both, kind="stable")
        order[rows] = at[by]
        both = both[by]
        new_here = np.ones(len(rows), bool)
        new_here[1:] = both[1:] != both[:-1]
        group[rows] = np.maximum.accumulate(np.where(new_here, rows, 0))
        rank[order[rows]] = group[rows]
        still = ~new_here
        still[:-1] |= ~new_here[1:]
        rows = rows[still]
        depth *= 2
    return order


class FMIndex:
    """FM-index of a symbol sequence with a wavelet matrix for ranks and sampled suffix positions."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        self.n = len(text)
        order = suffix_order(text)
        self.bwt_end = int(np.flatnonzero(order == 0)[0])  # its predecessor is the end mark, smaller than all symbols
        bwt = text[order - 1]
        counts = np.bincount(text, minlength=n_symbols + 1)
        self.before = np.concatenate(([0], np.cumsum(counts)))
        self.bits = max(1, int(n_symbols).bit_length())
        self.zeros, self.ones = [], []
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            level = np.concatenate((level[bit == 0], level[bit == 1]))
        self.sampled = order % SAMPLE == 0
        self.sample_rank = np.concatenate(([0], np.cumsum(self.sampled, dtype=np.int32)))
        self.samples = order[self.sampled]
        # The end mark is held in the first row's place: its symbol in `bwt` is that of text[-1] and must not be counted.
        self.end_symbol = int(text[-1])

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        low, high = np.zeros_like(row), row
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, bit = self.ones[level], (symbol >> b) & 1
            a, z = ones[low], ones[high]
            low = np.where(bit, self.zeros[level] + a, low - a)
            high = np.where(bit, self.zeros[level] + z, high - z)
        return (high - low) - ((symbol == self.end_symbol) & (row > self.bwt_end))

    def symbol(self, row: np.ndarray) -> np.ndarray:
        out = np.zeros_like(row)
        for level in range(self.bits):
            ones = self.ones[level]
            bit = ones[row + 1] - ones[row]
            out = out << 1 | bit
            row = np.where(bit, self.zeros[level] + ones[row], row - ones[row])
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern, by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        # Rows count suffixes of the text only; a suffix that starts with c has its row shifted by one per end mark row.
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j]
            base = self.before[c] + (c == self.end_symbol)  # the suffix text[-1:] comes first among those of its symbol
            start = j == patterns.shape[1] - 1
            a = self.before[c] if start else base + self.rank(c, low[alive])
            z = self.before[c + 1] if start else base + self.rank(c, high[alive])
            low[alive], high[alive] = a, z
            alive = alive[z > a]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back with LF until a sampled one."""
        steps, out, todo = np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64), np.arange(len(rows))
        rows = rows.astype(np.int64)
        while len(todo):
            hit = self.sampled[rows]
            out[todo[hit]] = self.samples[self.sample_rank[rows[hit]]] + steps[todo[hit]]
            todo, rows = todo[~hit], rows[~hit]
            steps[todo] += 1
            c = self.symbol(rows)
            rows = self.before[c] + (c == self.end_symbol) + self.rank(c, rows)
        return out


def shard_symbols(hashes: np.ndarray, first: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a shard (0: separator) and the word each stands at; runs of words outside the vocabulary are one 0."""
    at = np.searchsorted(vocabulary, hashes)
    at[at == len(vocabulary)] = 0
    symbol = np.where(vocabulary[at] == hashes, at + 1, 0)
    edges = first[1:-1]
    symbol = np.insert(symbol, edges, 0)
    word = np.insert(np.arange(len(hashes)), edges, -1)
    keep = symbol > 0
    keep[:1] = True
    keep[1:] |= symbol[:-1] > 0
    return symbol[keep], word[keep]


def occurrences(hashes: np.ndarray, first: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, item index) of every occurrence of a window in a shard, one for each item that holds it."""
    none = np.zeros(0, np.int64)
    if not len(hashes) or not patterns.groups:
        return none, none, none
    symbols, word = shard_symbols(hashes, first, patterns.vocabulary)
    index = FMIndex(symbols, len(patterns.vocabulary))
    out = []
    for n, windows, owner_start, owner in patterns.groups:
        low, high = index.search(windows)
        found = np.flatnonzero(high > low)
        count = (high - low)[found]
        rows = np.repeat(low[found] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        at, which = word[index.locate(rows)], np.repeat(found, count)
        owners = np.diff(owner_start)[which]
        item = owner[np.repeat(owner_start[which] - np.concatenate(([0], np.cumsum(owners)[:-1])), owners) + np.arange(owners.sum())]
        out.append((np.repeat(at, owners), np.full(owners.sum(), n), item))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _passes(benchmark: DataFrame, item: str, text: str, pass_bytes: int) -> int:
    """Blocks the benchmark is cut into so that each, as collected and sent to the tasks, stays within the bound."""
    size = benchmark.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64)).first()[0] or 0
    return max(1, -(-size // pass_bytes))


def hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """For each row of docs: (key, n_words, hit_spans, item_ids, *carry).

    hit_spans: merged spans of words inside any occurrence, as word positions and as byte offsets [begin, end) of the text;
    adjacent and overlapping spans are one. item_ids: the items (as strings, sorted) that have an occurring window.
    The benchmark is searched in blocks of at most pass_bytes (a block is what a task holds), each against all rows.
    """
    bench = pick(benchmark, item=benchmark[item].cast("string"), text=item_text)
    n = _passes(bench, "item", "text", pass_bytes)
    kept = {f"c{i}": c for i, c in enumerate(carry) if c != text}
    out = pick(docs, key=key, text=text, **kept).withColumns({"n_words": F.lit(0).cast("long"), "hit_spans": F.lit(None).cast(SPANS), "item_ids": F.lit(None).cast("array<string>")})
    for block in range(n):
        items = [tuple(r) for r in bench.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == block).collect()]
        out = _search(out, Patterns(items, window), text in carry or block < n - 1, list(kept))
    return out.withColumnsRenamed({"key": key, "text": text, **kept})


def _search(work: DataFrame, patterns: Patterns, keep_text: bool, kept: list[str]) -> DataFrame:
    """Adds one block's occurrences to those of earlier blocks."""
    ids = np.array(patterns.ids, object)

    def run(batch):
        keys, texts = batch.column("key"), batch.column("text")
        for a, b, data, offsets in chunks(texts, SHARD_BYTES):
            hashes, starts, ends, first = words_of(data, offsets)
            at, size, item = occurrences(hashes, first, patterns)
            inside = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(inside, at, 1)
            np.add.at(inside, at + size, -1)
            hit = np.cumsum(inside)[:-1] > 0
            doc = np.searchsorted(first, at, "right") - 1
            pairs = np.unique(np.stack((doc, item), 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
            edges = np.searchsorted(pairs[:, 0], np.arange(b - a + 1))
            old_spans, old_items = batch.column("hit_spans"), batch.column("item_ids")
            all_spans, all_items = [], []
            touched = np.flatnonzero((edges[1:] > edges[:-1]) | [old_spans[a + i].is_valid and len(old_spans[a + i]) > 0 for i in range(b - a)])
            all_spans, all_items = [[] for _ in range(b - a)], [[] for _ in range(b - a)]
            for i in touched.tolist():
                lo, hi = first[i], first[i + 1]
                flags = hit[lo:hi].copy()
                for s in old_spans[a + i].as_py() or ():
                    flags[s["first_word"] : s["end_word"]] = True
                change = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
                all_spans[i] = [{"first_word": int(s), "end_word": int(e), "begin": int(starts[lo + s] - offsets[i]), "end": int(ends[lo + e - 1] - offsets[i])} for s, e in zip(change[::2], change[1::2], strict=True)]
                new = {x for x in ids[pairs[edges[i] : edges[i + 1], 1]] if x is not None}
                all_items[i] = sorted(new | set(old_items[a + i].as_py() or ()))
            kind = batch.schema.field("hit_spans").type
            yield {"key": keys.slice(a, b - a), "text": texts.slice(a, b - a), "n_words": np.diff(first), "hit_spans": pa.array(all_spans, kind), "item_ids": pa.array(all_items, pa.list_(pa.string())), **{k: batch.column(k).slice(a, b - a) for k in kept}}

    return arrow_map(work, run, work.schema if keep_text else work.drop("text").schema)


def n_hit() -> Column:
    """Words inside the spans."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The counts of `hits`: (key, n_words, n_hit, n_items, items_sha256, contaminated)."""
    return found.select(key, "n_words", n_hit().alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit() > 0).alias("contaminated"))


def cut_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """Rows of `hits` (with the text carried) with the spans cut out of the text, and (n_hit, cut: whether there were any)."""
    parts = F.transform("hit_spans", lambda s, i: F.struct(F.when(i > 0, F.get(F.col("hit_spans"), i - 1)["end"]).otherwise(0).alias("a"), s["begin"].alias("b")))
    raw = F.col(text).cast("binary")
    piece = lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int"))
    last = F.element_at("hit_spans", -1)["end"]
    pieces = F.concat(F.transform(parts, lambda p: piece(p["a"], p["b"])), F.array(piece(last, F.octet_length(text))))
    cut = F.size("hit_spans") > 0
    joined = F.aggregate(pieces, F.lit(b""), lambda so_far, p: F.concat(so_far, p)).cast("string")
    return found.withColumns({"cut": cut, "n_hit": n_hit(), text: F.when(cut, joined).otherwise(F.col(text))})
