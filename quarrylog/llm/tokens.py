"""Byte-level BPE: texts to token ids and back, by a table of ranks.

A text is cut into words by the vocabulary's pattern. Many words are merged at once: the ranks of their pairs lie end to end
in one array, a step finds the first pair of least rank of every word, merges it, and looks the two ranks beside it up in a
hash table from pairs of pieces to ranks (a merged piece's id is its rank, so the table gives both). A word that is one token
comes out as that token without merging.

Words recur, so the frequent ones of all texts (the lexicon, LEXICON_BYTES at most, by falling count) are merged once and
sent to all tasks, as hash arrays whose hits are compared byte by byte. Every other word is merged by the task that has it,
once for a run of texts and in the same way, so the lexicon's size changes the time a text takes and never its ids. Nothing
but the words that are counted is shuffled. Decoding lays the binary pieces of the ids end to end.

The steps grow with the square of a word's length, so words of over LONG_WORD bytes are merged with a heap. Texts with
characters that Java's Unicode tables lack are cut into words by the tasks.

Cases: a null text is empty and has no ids; repeated rows are encoded alike; special tokens' names are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.llm import _text
from quarrylog.llm._ops import arrow_map, materialise, pick, spread

#: Bytes of the lexicon's words and of what is kept beside each of them, and the longest word it takes.
LEXICON_BYTES, BESIDE, LEXICON_WORD = 48 << 20, 40, 64
#: Texts that are looked up at a time.
LOOKED_UP = 256
#: Bytes of a word from which on a heap merges it.
LONG_WORD = 256
#: A rank greater than any id, for pairs that make no token.
NONE = (1 << 31) - 1


@dataclass
class Vocabulary:
    """Ranks by token (the rank is the id), and the pattern of words."""

    ranks: dict[bytes, int]
    pattern: str

    def __getstate__(self) -> dict:
        """Tasks get the ranks and make what else they need themselves, so that those without long words hold no pairs."""
        return {k: v for k, v in self.__dict__.items() if k not in ("pairs", "pieces")}

    @cached_property
    def pairs(self) -> dict[tuple[int, int], int]:
        """Rank of the token that two tokens make; every way to cut a token in two."""
        cuts = ((t[:i], t[i:], r) for t, r in self.ranks.items() for i in range(1, len(t)))
        return {(self.ranks[a], self.ranks[b]): r for a, b, r in cuts if a in self.ranks and b in self.ranks}

    @cached_property
    def pieces(self) -> list[bytes]:
        out = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            out[rank] = token
        return out

    @cached_property
    def unmerged(self) -> dict[bytes, int]:
        """Tokens that merging by ranks doesn't give: as whole words they are looked up."""
        return {t: r for t, r in self.ranks.items() if heap_merged(t, self) != [r]}


def load(path: str, pattern: str) -> Vocabulary:
    """A file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def heap_merged(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of a word, merged with a heap of pairs and a list of neighbours: n log n in its length."""
    ids = [vocabulary.ranks[word[i : i + 1]] for i in range(len(word))]
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    pairs, none = vocabulary.pairs, len(ids)
    queue = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := pairs.get((a, b))) is not None]
    heapq.heapify(queue)
    while queue:
        rank, i, a, b = heapq.heappop(queue)
        j = after[i]
        if ids[i] != a or j == none or ids[j] != b:
            continue  # one of the two is part of something else by now
        ids[i], ids[j] = rank, -1
        after[i] = k = after[j]
        if k < none:
            before[k] = i
            if (r := pairs.get((rank, ids[k]))) is not None:
                heapq.heappush(queue, (r, i, rank, ids[k]))
        h = before[i]
        if h >= 0 and (r := pairs.get((ids[h], rank))) is not None:
            heapq.heappush(queue, (r, h, ids[h], rank))
    return [x for x in ids if x >= 0]


class Merges:
    """Ranks of pairs of pieces, and the merging of many words at once."""

    def __init__(self, vocabulary: Vocabulary):
        pairs = sorted(vocabulary.pairs.items(), key=lambda x: x[1])
        left = np.array([a for (a, _), _ in pairs], np.uint64)
        right = np.array([b for (_, b), _ in pairs], np.uint64)
        ranks, keys = np.array([r for _, r in pairs], np.int32), left << np.uint64(32) | right
        bits = max(8, 2 + len(keys).bit_length())
        self.shift, self.none = np.uint64(64 - bits), np.uint64((1 << 64) - 1)
        self.keys, self.ranks = np.full(1 << bits, self.none), np.full(1 << bits, NONE, np.int32)
        slot, open_ = self._slot(keys), np.arange(len(keys))
        while len(open_):
            free = open_[self.keys[slot[open_]] == self.none]
            self.keys[slot[free]] = keys[free]  # of several for one slot the last stays
            won = open_[self.keys[slot[open_]] == keys[open_]]
            self.ranks[slot[won]] = ranks[won]
            open_ = open_[self.keys[slot[open_]] != keys[open_]]
            slot[open_] = (slot[open_] + 1) & ((1 << bits) - 1)
        self.bytes = np.array([vocabulary.ranks[bytes([i])] for i in range(256)], np.int32)
        self.first = self.rank(np.repeat(self.bytes, 256), np.tile(self.bytes, 256))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (_text.mix(keys) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each two tokens make."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        out, found = self.ranks[slot], self.keys[slot]
        open_ = np.flatnonzero(found != keys)
        out[open_] = NONE
        open_ = open_[found[open_] != self.none]
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found != self.none)]
        return out

    def merged(self, data: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Id at the first byte of each token of the words that lie end to end between the edges, -1 at all other bytes."""
        ids = self.bytes[data]
        many = np.flatnonzero(np.diff(edge) > 1)
        if not len(many):
            return ids
        after, before = np.arange(1, len(data) + 1), np.arange(-1, len(data))
        begin, end = edge[:-1][many], edge[1:][many]
        ranks = np.full(len(data), NONE, np.int32)
        ranks[:-1] = self.first[data[:-1].astype(np.int64) << 8 | data[1:]]
        ranks[edge[1:][np.diff(edge) > 0] - 1] = NONE  # no pair goes beyond a word
        # A pair's rank and place as one number, so that the least is the first of least rank; words that are done leave in time.
        code, nothing = ranks.astype(np.int64) << 32 | np.arange(len(data)), np.int64(NONE) << 32
        at, shift = begin, np.zeros(len(many), np.int64)
        packed = False
        while True:
            least = np.minimum.reduceat(code, at)
            live = np.flatnonzero(least < nothing)
            if not len(live):
                return ids
            if not packed or 2 * len(live) < len(at):
                size = (end - begin)[live]
                ahead = np.cumsum(size) - size
                code = code[np.repeat(at[live] - ahead, size) + np.arange(size.sum())]
                begin, end, least, at, shift = begin[live], end[live], least[live], ahead, ahead - begin[live]
                live, packed = np.arange(len(live)), True
            place, rank, to = least[live] & 0xFFFFFFFF, (least[live] >> 32).astype(np.int32), shift[live]
            other = after[place]
            following, previous = after[other], before[place]
            ids[place], ids[other], after[place], before[following] = rank, -1, following, place
            code[other + to] = code[place + to] = nothing
            for mine, left, right in ((following < end[live], place, following), (previous >= begin[live], previous, place)):
                left, right = left[mine], right[mine]
                code[left + to[mine]] = self.rank(ids[left], ids[right]).astype(np.int64) << 32 | left


def merged_words(words_: pa.Array, vocabulary: Vocabulary, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words, end to end, and their n + 1 offsets."""
    out, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for first, last, data, edge in _text.chunks(words_):
        size = np.diff(edge)
        whole = words_.slice(first, last - first).to_pylist() if vocabulary.unmerged else []
        known = {i: [vocabulary.unmerged[w.encode()]] for i, w in enumerate(whole) if w.encode() in vocabulary.unmerged}
        known |= {i: heap_merged(data[edge[i] : edge[i + 1]].tobytes(), vocabulary) for i in np.flatnonzero(size > LONG_WORD).tolist() if i not in known}
        short = np.ones(len(size), bool)
        short[list(known)] = False
        ids, mine = np.full(len(data), -1, np.int32), np.repeat(short, size)
        ids[mine] = merges.merged(data[mine], np.concatenate(([0], np.cumsum(size[short]))))
        for i, own in known.items():
            ids[edge[i] : edge[i] + len(own)] = own
        kept = ids >= 0
        out.append(ids[kept])
        sizes.append(np.diff(np.concatenate(([0], np.cumsum(kept)))[edge]))
    return np.concatenate(out), np.cumsum(np.concatenate(sizes))


def words(text: Column, vocabulary: Vocabulary) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + vocabulary.pattern), F.lit(0))


def apart(text: Column) -> Column:
    """Whether a text has characters that Java doesn't know."""
    return F.coalesce(text.rlike(r"[\x{300}-\x{10FFFF}&&\p{Cn}]"), F.lit(False))


class Lexicon:
    """Ids of words, found by hash and told by their bytes."""

    def __init__(self, table: pa.Table):
        blob, offsets = _text.text_bytes(table.column("word"))
        parts = [_text.span_hashes(data, at[:-1], at[1:]) for _, _, data, at in _text.chunks(table.column("word"))]
        hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        order = order[np.concatenate(([True], np.diff(hashes[order]) != 0))] if len(order) else order  # a word whose hash another has is left out
        ids = table.column("ids").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        at = np.asarray(ids.offsets, np.int64)
        self.hashes, self.begin, self.end, self.blob = hashes[order], offsets[:-1][order].astype(np.int32), offsets[1:][order].astype(np.int32), blob
        self.ids, self.first, self.size = np.asarray(ids.values, np.int32), at[:-1][order].astype(np.int32), np.diff(at)[order].astype(np.int32)
        self.bits = max(1, int(len(self.hashes)).bit_length())
        self.bucket = np.searchsorted(self.hashes >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of each word, -1 where it isn't there."""
        out = np.full(len(begin), -1, np.int64)
        if not len(self.hashes) or not len(begin):
            return out
        hashes = _text.span_hashes(data, begin, end)
        top = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        at, last, open_ = self.bucket[top], self.bucket[top + 1], np.arange(len(begin))
        while True:
            open_ = open_[at[open_] < last[open_]]
            if not len(open_):
                break
            hit = self.hashes[at[open_]] == hashes[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
        found = np.flatnonzero(out >= 0)
        same = self.end[out[found]] - self.begin[out[found]] == end[found] - begin[found]
        out[found[~same]] = -1
        found = found[same]
        sizes = end[found] - begin[found]
        ahead = np.cumsum(sizes) - sizes
        step = np.arange(sizes.sum()) - np.repeat(ahead, sizes)
        differs = data[np.repeat(begin[found], sizes) + step] != self.blob[np.repeat(self.begin[out[found]], sizes) + step]
        out[found[np.unique(np.searchsorted(ahead, np.flatnonzero(differs), "right") - 1)]] = -1
        return out


def lexicon(docs: DataFrame, vocabulary: Vocabulary, shared: Broadcast, limit: int = LEXICON_BYTES) -> Lexicon:
    """The words (of docs with a column words) that occur 2 ** k times and more, for the least k from 1 that fits the limit."""
    # explode_outer, as a filter on the words, inferred from explode, would cut every text twice
    counted = docs.select(F.explode_outer("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counted = materialise(counted.filter(f"word is not null and n > 1 and octet_length(word) <= {LEXICON_WORD}").withColumn("k", F.floor(F.log2("n")).cast("int")))
    need = {r["k"]: r["need"] for r in counted.groupBy("k").agg(F.sum(F.octet_length("word") + BESIDE).alias("need")).collect()}
    least, total = 64, 0
    for k in range(63, 0, -1):
        total += need.get(k, 0)
        if total > limit:
            break
        least = k

    def merge(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, at = merged_words(batch.column("word"), *shared.value)
        yield {"word": batch.column("word"), "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))}

    return Lexicon(arrow_map(spread(counted).filter(F.col("k") >= least).select("word"), merge, "word string, ids array<int>").toArrow())


def _gathered(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    ahead = np.cumsum(size) - size
    return values[np.repeat(first - ahead, size) + np.arange(size.sum())]


def _looked_up(column: pa.ListArray, known: Lexicon, vocabulary: Vocabulary, merges: Merges) -> Iterator[tuple[int, int, pa.ListArray]]:
    """(first row, end row, ids) of runs of rows of words."""
    at = np.asarray(column.offsets, np.int64) - column.offsets[0].as_py()
    every = column.flatten()
    data, edge = _text.text_bytes(every)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, min(n, int(np.searchsorted(edge[at], edge[at[row]] + _text.CHUNK_BYTES, "right")) - 1))
        a, b = at[row], at[end]
        place = known.find(data[edge[a] : edge[b]], edge[a:b] - edge[a], edge[a + 1 : b + 1] - edge[a])
        ids, unknown = known.ids, np.flatnonzero(place < 0)
        first, took = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        found = np.flatnonzero(place >= 0)
        first[found], took[found] = known.first[place[found]], known.size[place[found]]
        if len(unknown):
            rare = every.take(pa.array(unknown + a)).dictionary_encode()
            which = np.asarray(rare.indices)
            more, bounds = merged_words(rare.dictionary, vocabulary, merges)
            first[unknown], took[unknown] = len(ids) + bounds[which], np.diff(bounds)[which]
            ids = np.concatenate((ids, more))
        bounds = np.concatenate(([0], np.cumsum(took)))[at[row : end + 1] - a]
        yield row, end, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(_gathered(ids, first, took), pa.int32()))
        row = end


def _coded(df: DataFrame, vocabulary: Vocabulary, key: str, text: str, limit: int, use: Callable[[pa.Array, pa.ListArray], dict], columns: str) -> DataFrame:
    """(key and columns) of every row: what `use` makes of the keys and ids of a run of rows."""
    spark = df.sparkSession
    work = pick(df, key=key, text=F.coalesce(df[text], F.lit(""))).withColumn("apart", apart(F.col("text")))
    work = work.select("key", "apart", F.when(F.col("apart"), F.col("text")).alias("text"), F.when(~F.col("apart"), words(F.col("text"), vocabulary)).alias("words"))
    vocabulary.unmerged  # noqa: B018  found once, here, and sent along
    ranks = spark.sparkContext.broadcast((vocabulary, Merges(vocabulary)))
    shared = spark.sparkContext.broadcast(lexicon(work, vocabulary, ranks, limit))

    def look_up(batch: pa.RecordBatch) -> Iterator[dict]:
        import regex

        known, (vocab, merges) = shared.value, ranks.value
        for at in range(0, batch.num_rows, LOOKED_UP):
            own = batch.slice(at, LOOKED_UP)
            mine = own.column("apart")
            plain = own.filter(pa.compute.invert(mine)) if pa.compute.any(mine).as_py() else own
            for a, b, ids in _looked_up(plain.column("words"), known, vocab, merges) if plain.num_rows else ():
                yield use(plain.column("key").slice(a, b - a), ids)
            for key_, text_, here in zip(own.column("key"), own.column("text"), mine, strict=True):
                if here.as_py():
                    cut = pa.array([regex.findall(vocab.pattern, text_.as_py())], pa.list_(pa.string()))
                    for _, _, ids in _looked_up(cut, known, vocab, merges):
                        yield use(pa.array([key_.as_py()], own.schema.field("key").type), ids)

    return arrow_map(work, look_up, f"key {work.schema['key'].dataType.simpleString()}, {columns}").withColumnRenamed("key", key)


def encode(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", limit: int = LEXICON_BYTES) -> DataFrame:
    """(key, ids) of every row."""
    return _coded(df, vocabulary, key, text, limit, lambda keys, column: {"key": keys, "ids": column}, "ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, content): the bytes that ids stand for; null ids are none."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary.pieces)

    def joined(batch: pa.RecordBatch) -> Iterator[dict]:
        pieces = shared.value
        for i in range(batch.num_rows):
            yield {"key": batch.column("key").slice(i, 1), "content": [b"".join(map(pieces.__getitem__, batch.column("ids")[i].as_py() or ()))]}

    work = pick(encoded, key=key, ids=ids)
    return arrow_map(work, joined, f"key {work.schema['key'].dataType.simpleString()}, content binary").withColumnRenamed("key", key)


def digest(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", limit: int = LEXICON_BYTES) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row: hashes of its ids as text and of what they decode to."""
    shared = df.sparkSession.sparkContext.broadcast((vocabulary.pieces, [str(i).encode() for i in range(len(vocabulary.pieces))]))

    def hashed(keys: pa.Array, column: pa.ListArray) -> dict:
        pieces, shown = shared.value
        at, flat = np.asarray(column.offsets, np.int64), np.asarray(column.values)
        out: dict[str, list] = {"n_tokens": np.diff(at).tolist(), "ids_sha256": [], "decoded_sha256": []}
        for a, b in zip(at[:-1], at[1:], strict=True):
            own = flat[a:b].tolist()
            out["ids_sha256"].append(hashlib.sha256(b",".join(map(shown.__getitem__, own))).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(b"".join(map(pieces.__getitem__, own))).hexdigest())
        return {"key": keys} | out

    return _coded(df, vocabulary, key, text, limit, hashed, "n_tokens long, ids_sha256 string, decoded_sha256 string")
