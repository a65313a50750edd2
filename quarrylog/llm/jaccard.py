"""Exact Jaccard similarity self-join of texts' shingle sets by universe partition and the pigeonhole principle.

A set's elements are hashes of `k` consecutive words (a shorter text is one element). Sets of about one size share a band.
In a band the universe of elements is cut by hashing into m segments, so each set falls into m parts. Two sets that link
differ in at most d elements (d from their sizes), and

* exact parts: with m = d + 1 + SLACK parts at least 1 + SLACK are equal; equal parts share a signature;
* one-deletion parts: with m = d // 2 + 1 + SLACK parts at least 1 + SLACK differ in at most one element; a part is
  indexed with every one of its elements left out as well, so such parts share a signature;
* subsets of segments: the same m parts, each cut further into a few segments; a part is indexed with each one of its
  segments left out, so parts that differ in one element share the signature without that element's segment.

Which of these a band takes is decided by cost: signatures emitted, plus STRAY times the expected number of parts so
small that unrelated sets may share them. Parts too small (at most one element; with segments, none left beside the
largest) are weak: they are no index entries (empty ones match every set), which the slack makes up for. A set with more weak parts than slack is indexed again under other
segments, against the other such sets; at the last level with all its parts. No pair is lost: where either set has
enough slack a shared signature is left, else both are at the next level.

Equal sets are one class from the start (64-bit digest of the set). Sets sharing a signature become candidates: each with
the least set of its bucket; then, among sets of a bucket that those links have not joined, each pair. Before pairs are
made of crowded buckets, sets of them are drawn and compared with the others as long as that joins many. The pairs of
what is left are made by blocks of BLOCK sets, so a bucket of any size is many tasks. Candidates are verified on the whole element sets, after sizes and parity sketches have
told apart most that can't link. Sketches of large sets grow with them: long texts that share a good part of their words
are many, with the square of their number, so they are told apart within the join and not made pairs. Links are contracted to components.

Cases: null or empty texts and texts without words have the empty set, which links with nothing, not even its like;
repeated rows are equal sets and so in one component; null keys never name a component that has another key.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.llm._ops import arrow_map, give_back, materialise, pick
from quarrylog.llm._text import LOWER, NON_SPACE, chunks, mix, signed, span_hashes, spans, windows

K = 4
#: Link at a similarity of NUMERATOR / DENOMINATOR or more.
NUMERATOR, DENOMINATOR = 85, 100
#: Ratio of a band's sizes, levels of segment hashing, and the cost of a part that unrelated sets may share.
BAND, LEVELS, STRAY = 1.5, 4, 4.0
#: Kinds of index: whole parts, parts with one element left out, and (the numbers themselves) parts of so many segments with one left out.
EXACT, DELETION, SEGMENTS = 0, 1, (3, 4, 5, 6)
#: Buckets are crowded beyond so many comparisons a member. Times that sets are drawn before all pairs left are compared,
#: and the members of a bucket that one task compares with as many others.
CROWDED, DRAWS, BLOCK = 64, 8, 256
#: A signature of so many sets in one chunk of texts is dealt out by SALTS.
HOT, SALTS = 8, 61
#: Elements of candidate sets that are compared whole at once, without comparing profiles first.
WHOLE_ELEMENTS = 1 << 25
#: Rows of a key table that are still sent to all tasks.
BROADCAST_ROWS = 500_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted shingle hashes of each text laid end to end, and their offsets."""
    starts, ends, first = spans(data, offsets, NON_SPACE)
    hashes, _, at = windows(span_hashes(data, starts, ends, LOWER), first, k)
    parts = [np.unique(hashes[a:b]) for a, b in zip(at, at[1:], strict=False)]
    return np.concatenate([*parts, np.zeros(0, np.uint64)]), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def set_ids(elements: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit digest of each set (0 for the empty one)."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(elements + np.uint64(0x5851F42D4C957F2D)))))
    size = np.diff(offsets)
    return np.where(size > 0, mix(total[offsets[1:]] - total[offsets[:-1]] + size.astype(np.uint64)), np.uint64(0))


def most_different(size: np.ndarray | int, largest: int, num: int = NUMERATOR, den: int = DENOMINATOR):
    """Elements in which a set of this size and a linked one that is no smaller, of at most `largest`, can differ."""
    other = np.minimum(size * den // num, largest)
    return (den - num) * (size + other) // (den + num)


def _few(mean: float, n: int) -> float:
    """Probability of at most n by Poisson."""
    return math.exp(-mean) * sum(mean**i / math.factorial(i) for i in range(n + 1))


class Bands:
    """Sizes by band, and each band's segments, slack and kind of index."""

    def __init__(self, num: int = NUMERATOR, den: int = DENOMINATOR, ratio: float = BAND):
        self.num, self.den = num, den
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, math.ceil(edges[-1] * max(ratio, den / num))))
        self.low = np.array(edges)
        n = len(edges) - 1
        self.m, self.slack, self.kind = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.high = self.low[1:] - 1
        for i in range(n):
            self._allocate(i)

    def _allocate(self, i: int) -> None:
        top = int(self.high[i])
        typical = (int(self.low[i]) * self.num / self.den + top) / 2
        d = int(most_different(top, top, self.num, self.den))
        if d == 0:
            return
        best = None
        for kind in (EXACT, DELETION, *SEGMENTS):
            need = (d if kind == EXACT else d // 2) + 1

            def few(m: int, least: int, kind: int = kind) -> float:
                """Expected signatures, or parts with one, of at most so many elements."""
                share = 1 if kind in (EXACT, DELETION) else (kind - 1) / kind
                return (m if m > 1 else 0) * (kind if kind in SEGMENTS else 1) * _few(typical / m * share, least)

            # Slack needs more parts, which makes smaller ones; without any that fits, the next level has more to do.
            slack, wanted = 0, 0
            for _ in range(20):
                slack = wanted
                weak = min(few(need + slack, 0 if kind in SEGMENTS else 1), need + slack)
                wanted = 0 if weak <= 0.1 else math.ceil(weak + 2 * math.sqrt(weak))
                if wanted <= slack:
                    break
            settled = wanted <= slack
            slack = slack if settled else 0
            m = need + slack
            emitted = m if kind == EXACT else m + typical if kind == DELETION else m * kind
            cost = emitted + STRAY * few(m, 3 if kind == DELETION else 2) + (0 if settled else 1e18)
            if best is None or cost < best[0]:
                best = cost, m, slack, kind
        _, self.m[i], self.slack[i], self.kind[i] = best

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, "right") - 1

    def parts(self, size: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Leading segments that a set of this size has in the index of a band: as many as its smallest-or-equal role needs."""
        d = most_different(size, self.high[band], self.num, self.den)
        return np.minimum(self.m[band], np.where(self.kind[band] == EXACT, d, d // 2) + 1 + self.slack[band])

    def signatures(self, elements: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures and the set of each: in the set's own band, and in the next if a larger set there can link."""
        size = np.diff(offsets)
        own = self.of(np.maximum(size, 1))
        sets = np.flatnonzero(size > 0)
        upper = sets[size[sets] * self.den >= self.num * self.low[np.minimum(own[sets] + 1, len(self.low) - 1)]]
        which = np.concatenate((sets, upper))
        band = np.concatenate((own[sets], own[upper] + 1))
        live = self.m[band] > 0
        which, band = which[live], band[live]
        found = []
        for level in range(LEVELS):
            if not len(which):
                break
            sig, owner, short = self._level(elements, offsets, which, band, level)
            found.append((sig, owner))
            which, band = which[short], band[short]
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _level(self, elements, offsets, which, band, level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.diff(offsets)[which]
        entry = np.repeat(np.arange(len(which)), size)
        at = np.arange(int(size.sum())) + np.repeat(offsets[which] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        value = mix(elements[at] + np.uint64((1 + level) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        m = self.m[band]
        base = np.concatenate(([0], np.cumsum(m)))
        place = (mix(value + band[entry].astype(np.uint64)) % m[entry].astype(np.uint64)).astype(np.int64)
        slot = base[entry] + place
        n = int(base[-1])
        count = np.bincount(slot, minlength=n)
        # Sums modulo 2 ** 64 from two exact sums of halves.
        half = np.uint64(0xFFFFFFFF)
        low = np.bincount(slot, (value & half).astype(np.float64), n).astype(np.uint64)
        high = np.bincount(slot, (value >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
        total = (high << np.uint64(32)) + low
        slot_entry = np.repeat(np.arange(len(which)), m)
        slot_place = np.arange(n) - base[slot_entry]
        wanted = self.parts(size, band)
        used = slot_place < wanted[slot_entry]
        kind = self.kind[band]
        label = mix((band[slot_entry].astype(np.uint64) << np.uint64(40)) + (np.uint64(level) << np.uint64(34)) + slot_place.astype(np.uint64))
        # Segments of the parts that have them: element counts and sums of each, a column a segment.
        cut = kind >= SEGMENTS[0]
        deep = np.flatnonzero(cut[slot_entry] & used)
        pieces = int(kind.max(initial=1)) if len(deep) else 1
        row = np.full(n, -1)
        row[deep] = np.arange(len(deep))
        inner = row[slot] >= 0
        segment = ((mix(value[inner] ^ np.uint64(0xD1342543DE82EF95)) >> np.uint64(8)) % kind[entry[inner]].astype(np.uint64)).astype(np.int64)
        cell = row[slot[inner]] * pieces + segment
        in_segment = np.bincount(cell, minlength=len(deep) * pieces).reshape(-1, pieces)
        of_segment = [np.bincount(cell, part.astype(np.float64), len(deep) * pieces).astype(np.uint64).reshape(-1, pieces) for part in (value[inner] & half, value[inner] >> np.uint64(32))]
        of_segment = (of_segment[1] << np.uint64(32)) + of_segment[0]
        # The fewest elements that a signature of the part may stand on.
        least = count.copy()
        least[deep] -= in_segment.max(1, initial=0)
        floor = np.where(cut, 0, 1)[slot_entry]
        weak = np.bincount(slot_entry[used & (least <= floor)], minlength=len(which))
        short = weak > self.slack[band]
        last = (level == LEVELS - 1) & short
        # Exact parts need two elements; one-deletion parts one, for those that are such a part and one element more.
        shown = used & ~cut[slot_entry] & ((count >= np.where(kind == DELETION, 1, 2)[slot_entry]) | last[slot_entry])
        sig, owner = [mix(total[shown] + label[shown])], [which[slot_entry[shown]]]
        left_out = (kind == DELETION)[entry] & used[slot] & ((count[slot] > 1) | last[entry])
        if left_out.any():
            s = slot[left_out]
            sig.append(mix(total[s] - value[left_out] + label[s]))
            owner.append(which[entry[left_out]])
        if len(deep):
            rest = count[deep][:, None] - in_segment
            here = (np.arange(pieces) < kind[slot_entry[deep]][:, None]) & ((rest > 0) | last[slot_entry[deep]][:, None])
            at, omitted = np.nonzero(here)
            sig.append(mix(mix(total[deep][at] - of_segment[at, omitted] + label[deep][at]) + omitted.astype(np.uint64)))
            owner.append(which[slot_entry[deep[at]]])
        return np.concatenate(sig), np.concatenate(owner), short


#: 64-bit words of a set's parity sketch.
SKETCH = 8


def sketches(elements: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Parity sketch of each set [sets, SKETCH]: of each of 64 * SKETCH buckets whether an odd number of elements is in it.

    Two sets' sketches differ in at most as many bits as the sets in elements, so no pair that links is told apart.
    """
    bucket = (mix(elements ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(64 * SKETCH)).astype(np.int64)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    odd = np.bincount(of * (64 * SKETCH) + bucket, minlength=(len(offsets) - 1) * 64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, 64), axis=1).view(np.int64).reshape(-1, SKETCH)


#: Bits of the widest sketch of a large set.
WIDE_BITS = 1 << 16


def wide_sketches(elements: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """Parity sketch of each set of more elements than the bits of `sketches`, of 1 to 2 bits an element; else no words.

    Its bits are a power of two, so one of more words folds to one of fewer by XOR of those whose places are alike.
    """
    size = np.diff(offsets)
    bits = np.where(size > 64 * SKETCH, np.minimum(np.exp2(np.ceil(np.log2(np.maximum(size, 1)))).astype(np.int64), WIDE_BITS), 0)
    base = np.concatenate(([0], np.cumsum(bits)))
    of = np.repeat(np.arange(len(size)), np.where(bits > 0, size, 0))
    hashes = mix(elements[np.repeat(bits > 0, size)] ^ np.uint64(0xA0761D6478BD642F))
    place = base[of] + (hashes & (bits[of] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(place, minlength=int(base[-1])) & 1
    return pa.ListArray.from_arrays(pa.array(base // 64, pa.int32()), pa.array(np.packbits(odd.astype(np.uint8)).view(np.int64)))


def _folded(words: Column, size: Column) -> Column:
    """A wide sketch in so many words, or fewer if it has fewer."""
    word = lambda i: F.aggregate(F.sequence(i, F.size(words) - 1, size), F.lit(0).cast("bigint"), lambda s, j: s.bitwiseXOR(words[j]))
    return F.when(size < 1, F.slice(words, 1, 0)).when(F.size(words) <= size, words).otherwise(F.transform(F.sequence(F.lit(0), size - 1), word))


def _differing(one: Column, two: Column) -> Column:
    """Bits in which two wide sketches of equally many words differ."""
    return F.aggregate(F.zip_with(one, two, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def _sets(work: DataFrame, k: int) -> DataFrame:
    """(key, digest, n, sid, p0 to the sketch's last word, wide: the wide sketch's words) of every row."""

    def run(batch):
        for a, b, data, offsets in chunks(batch.column("text")):
            elements, at = shingle_sets(data, offsets, k)
            sketch = sketches(elements, at)
            words = {f"p{i}": np.ascontiguousarray(sketch[:, i]) for i in range(SKETCH)}
            yield {"key": batch.column("key").slice(a, b - a), "digest": batch.column("digest").slice(a, b - a), "n": np.diff(at), "sid": signed(set_ids(elements, at)), **words, "wide": wide_sketches(elements, at)}

    return arrow_map(work, run, f"key {work.schema['key'].dataType.simpleString()}, digest long, n long, sid long, {', '.join(f'p{i} long' for i in range(SKETCH))}, wide array<bigint>")


def _signatures(work: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(sig, salt, sid) of the distinct sets of each task.

    A signature that HOT sets of a chunk have, as a common passage gives, is dealt out by a salt from the set's digest,
    and its least set in the chunk stands under salt 0 too; so no signature's rows are all in one task, and all who share
    it are still tied together by the rows of salt 0.
    """
    bands = Bands(num, den)

    def run(batches):
        seen = np.zeros(0, np.uint64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                elements, at = shingle_sets(data, offsets, k)
                ids = set_ids(elements, at)
                _, one = np.unique(ids, return_index=True)
                one = one[~np.isin(ids[one], seen) & (ids[one] != 0)]
                seen = np.union1d(seen, ids[one])
                size = np.diff(at)
                keep = np.zeros(len(ids), bool)
                keep[one] = True
                elements = elements[np.repeat(keep, size)]
                at = np.concatenate(([0], np.cumsum(size[keep])))
                sig, owner = bands.signatures(elements, at)
                sid = ids[keep][owner]
                order = np.lexsort((sid.view(np.int64), sig))
                sig, sid = sig[order], sid[order]
                first = np.concatenate(([True], sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, bool)
                starts = np.flatnonzero(first)
                hot = np.repeat(np.diff(np.concatenate((starts, [len(sig)]))) >= HOT, np.diff(np.concatenate((starts, [len(sig)]))))
                salt = np.where(hot, (sid % np.uint64(SALTS)).astype(np.int32) + 1, 0)
                tied = np.flatnonzero(hot & first)
                sig, sid, salt = np.concatenate((sig, sig[tied])), np.concatenate((sid, sid[tied])), np.concatenate((salt, np.zeros(len(tied), salt.dtype)))
                for s in range(0, len(sig), 100_000):
                    yield pa.RecordBatch.from_pydict({"sig": signed(sig[s : s + 100_000]), "salt": pa.array(salt[s : s + 100_000], pa.int32()), "sid": signed(sid[s : s + 100_000])})
            give_back()

    return work.select("text").mapInArrow(run, "sig long, salt int, sid long")


#: Buckets of a set's profile.
PROFILE = 1024


def profiles(elements: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Each set's profile: how many elements (255 at most) each of PROFILE buckets has, a byte a bucket.

    The sum of two profiles' differences is at most the number of elements in which the sets differ. Unlike parities it
    still grows where that number is beyond the buckets', so it tells apart large sets as well.
    """
    bucket = (mix(elements ^ np.uint64(0x9E6C63D0876A9A99)) % np.uint64(PROFILE)).astype(np.int64)
    out: list[bytes] = []
    for s in range(0, len(offsets) - 1, 1000):
        part = offsets[s : s + 1001]
        of = np.repeat(np.arange(len(part) - 1), np.diff(part)) * PROFILE
        count = np.bincount(of + bucket[part[0] : part[-1]], minlength=(len(part) - 1) * PROFILE)
        out += [row.tobytes() for row in np.minimum(count, 255).astype(np.uint8).reshape(-1, PROFILE)]
    return out


def _wanted(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(sid, row) of the sets in pairs, each with one row that has it."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    return materialise(known.join(ids, "sid").select("sid", "row"))


def _of_sets(work: DataFrame, wanted: DataFrame, k: int, value: str, make) -> DataFrame:
    """One row for each wanted set (wanted: sid, row): (sid, n, value), value from make(elements, offsets) over whole sets.

    Texts are found by key and digest, so each is made for its own set alone, however many share a key or have none.
    """
    name, kind = value.split()
    wanted = wanted.select(F.col("sid").alias("their_sid"), F.col("row.key").alias("their_key"), F.col("row.digest").alias("their_digest"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    rows = work.join(wanted, (work["digest"] == wanted["their_digest"]) & work["key"].eqNullSafe(wanted["their_key"])).select("their_sid", "text")

    def run(batch):
        sids = batch.column("their_sid").to_numpy(zero_copy_only=False)
        for a, b, data, offsets in chunks(batch.column("text")):
            elements, at = shingle_sets(data, offsets, k)
            same = signed(set_ids(elements, at)) == sids[a:b]
            elements, size = elements[np.repeat(same, np.diff(at))], np.diff(at)[same]
            at = np.concatenate(([0], np.cumsum(size)))
            yield {"sid": sids[a:b][same], "n": size, name: make(elements, at)}

    return arrow_map(rows, run, f"sid long, n long, {name} {kind}").dropDuplicates(["sid"])


def _as_lists(elements: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(signed(elements)))


def _sides(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Pairs with both sets' sizes and values: (a, b, na, nb, <value>a, <value>b)."""
    for side in ("a", "b"):
        pairs = pairs.join(values.withColumnsRenamed({"sid": side, "n": f"n{side}", value: f"{value}{side}"}), side)
    return pairs


def _alike(pairs: DataFrame, profiled: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose profiles allow a link."""

    def run(batch):
        one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PROFILE) for c in ("profilea", "profileb"))
        differ = (np.maximum(one, two) - np.minimum(one, two)).sum(1, dtype=np.int64)
        n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
        keep = pa.array((den + num) * differ <= (den - num) * n)
        yield {"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep)}

    return arrow_map(_sides(pairs, profiled, "profile"), run, "a long, b long")


def _verified(pairs: DataFrame, known: DataFrame, work: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The (a, b) of the candidate pairs (a, b, size: elements of both) that link, decided on whole sets.

    Where the candidates have many elements, those that profiles tell apart go first; that changes no result.
    """
    elements = pairs.agg(F.sum("size")).first()[0] or 0
    pairs = pairs.select("a", "b")
    if elements > WHOLE_ELEMENTS:
        profiled = materialise(_of_sets(work, _wanted(pairs, known), k, "profile binary", profiles))
        pairs = materialise(_alike(pairs, profiled, num, den))
    whole = materialise(_of_sets(work, _wanted(pairs, known), k, "elements array<bigint>", _as_lists))
    both = F.size(F.array_intersect("elementsa", "elementsb"))
    return _sides(pairs, whole, "elements").filter(den * both >= num * (F.col("na") + F.col("nb") - both)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(v, label): the least vertex that links reach from each, by taking neighbours' labels and labels' labels in turn."""
    both = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("v")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(near, labels["v"] == near["a"]).select("v", "label", F.least("label", "near").alias("now"))
        jump = nearer.select(F.col("v").alias("u"), F.col("now").alias("further"))
        moved = nearer.join(jump, nearer["now"] == jump["u"]).select("v", F.col("label").alias("old"), F.least("now", "further").alias("label"))
        moved = materialise(moved)
        if not moved.filter("old <> label").limit(1).count():
            return moved.select("v", "label")
        labels = moved.select("v", "label")


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (v, label) after more links: only the components that these tie together are walked again."""
    ends = links.select("a", "b")
    for side in ("a", "b"):
        ends = ends.join(labels.withColumnsRenamed({"v": side, "label": f"of_{side}"}), side, "left").withColumn(f"of_{side}", F.coalesce(f"of_{side}", side))
    across = materialise(ends.filter("of_a <> of_b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct())
    if across.isEmpty():
        return labels
    tied = components(across)
    renamed = labels.join(tied.select(F.col("v").alias("label"), F.col("label").alias("now")), "label", "left").select("v", F.coalesce("now", "label").alias("label"))
    return materialise(renamed.union(tied.join(labels, "v", "left_anti").select("v", "label")))


def _by_blocks(rows: DataFrame) -> DataFrame:
    """Rows (sig, ...) with (low, high, block): every two rows of a bucket meet once where one is of block low, the other of block high.

    A bucket of n members has ceil(n / BLOCK) blocks; its pairs are dealt out by pairs of blocks. words: those of the wide
    sketch of the bucket's smallest set.
    """
    sizes = rows.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("na").alias("fewest"))
    words = f"case when fewest <= {64 * SKETCH} then 0 else int(least(shiftleft(1L, length(bin(fewest - 1))), {WIDE_BITS}) div 64) end"
    dealt = rows.join(sizes, "sig").withColumns({"block": F.pmod(F.xxhash64("a", F.lit("block")), F.col("blocks")).cast("int"), "words": F.expr(words)})
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("blocks", "fewest", "other")


def join(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """(key, n_shingles, component_id) for every row; component_id: the least key that links reach, itself included."""
    work = pick(df, key=key, text=text, digest=F.xxhash64(df[text]))
    sets = materialise(_sets(work, k))
    words = [f"p{i}" for i in range(SKETCH)]
    known = materialise(sets.filter("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.min("key").alias("key"), F.min(F.struct("digest", "key")).alias("row"), *(F.first(w).alias(w) for w in words)))
    wide = materialise(sets.filter(F.size("wide") > 0).select("sid", "wide").dropDuplicates(["sid"]))
    bucket = Window.partitionBy("sig", "salt")
    shared = _signatures(work, k, num, den).withColumns({"rep": F.min("sid").over(bucket), "top": F.max("sid").over(bucket)})
    # A set alone under a salt still shares its signature with those of salt 0.
    members = materialise(shared.filter("rep <> top or salt > 0").select("sig", "sid", "rep").distinct())

    def described(rows: DataFrame, side: str) -> DataFrame:
        """Rows with the size and sketch of the set in column `side`."""
        return rows.join(known.drop("key", "row").withColumnsRenamed({"sid": side, "n": f"n{side}", **{w: f"{w}{side}" for w in words}}), side)

    differ = sum((F.bit_count(F.col(f"{w}a").bitwiseXOR(F.col(f"{w}b"))) for w in words), F.lit(0))
    most = F.floor((den - num) * (F.col("na") + F.col("nb")) / (den + num))
    may_link = (den * F.least("na", "nb") >= num * F.greatest("na", "nb")) & (differ <= most)
    size = (F.col("na") + F.col("nb")).alias("size")

    def with_wide(rows: DataFrame, side: str, name: str) -> DataFrame:
        """Rows with the wide sketch of the set in column `side`, of no words for a small set."""
        return rows.join(wide.withColumnsRenamed({"sid": side, "wide": name}), side, "left").withColumn(name, F.coalesce(name, F.array().cast("array<bigint>")))

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and sketches allow a link: (a, b, size)."""
        found = described(described(pairs, "a"), "b").filter(may_link).select("a", "b", "na", "nb")
        found = with_wide(with_wide(found, "a", "widea"), "b", "wideb")
        least = F.least(F.size("widea"), F.size("wideb"))
        return found.filter(_differing(_folded(F.col("widea"), least), _folded(F.col("wideb"), least)) <= most).select("a", "b", size)

    def tight(rows: DataFrame) -> DataFrame:
        """The rows of buckets whose sets are not yet one component."""
        ends = rows.groupBy("sig").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("sig")
        return materialise(rows.join(ends, "sig").select("sig", "sid", "label"))

    def still_open(labels: DataFrame) -> DataFrame:
        """(sig, sid, label) of the buckets whose sets are not yet one component."""
        return tight(members.select("sig", "sid").distinct().join(labels, members["sid"] == labels["v"], "left").select("sig", "sid", F.coalesce("label", "sid").alias("label")))

    def once(own: DataFrame) -> DataFrame:
        """One bucket of all that have the same sets: signatures of one shared part are many."""
        of = own.groupBy("sig").agg(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64("sid", F.lit(i))).alias(f"x{i}") for i in (0, 1)))
        return own.join(of.groupBy("n", "x0", "x1").agg(F.min("sig").alias("sig")).select("sig"), "sig")

    def comparisons(own: DataFrame) -> tuple[int, int]:
        """Comparisons that all pairs of the buckets take, and the members of the buckets."""
        counted = own.groupBy("sig").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")), F.sum("n")).first()
        return int(counted[0] or 0), int(counted[1] or 0)

    def drawn(own: DataFrame, turn: int) -> DataFrame:
        """Each set with another of its bucket, drawn by digest, so that buckets of one group of near copies draw different ones."""
        by = own.groupBy("sig").agg(F.min(F.struct(F.xxhash64("sig", "sid", F.lit(turn)).alias("by"), F.col("sid").alias("other"), F.col("label").alias("their"))).alias("d")).select("sig", "d.other", "d.their")
        return own.join(by, "sig").filter("label <> their").select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")).distinct()

    pairs = materialise(near(members.filter("sid <> rep").select(F.col("sid").alias("a"), F.col("rep").alias("b")).distinct()))
    labels = components(materialise(_verified(pairs, known, work, k, num, den)))
    own = still_open(labels)
    todo, n = comparisons(own)
    for turn in range(DRAWS):
        if todo <= CROWDED * n:
            break
        pairs = materialise(near(drawn(own, turn)))
        labels = joined(labels, materialise(_verified(pairs, known, work, k, num, den)))
        own = still_open(labels)
        before, (todo, n) = todo, comparisons(own)
        if 10 * todo > 9 * before:  # these sets share a part, but are not alike
            break
    if n:
        # What is left: pairs across components, told apart by sizes and sketches within the join.
        # Both sides are the same rows under the same keys, so they are shuffled once; the condition on blocks names both sides to keep it so.
        one = materialise(described(once(own).withColumnRenamed("sid", "a"), "a"))
        left = with_wide(_by_blocks(one), "a", "wide").withColumn("wide", _folded(F.col("wide"), F.col("words"))).drop("words")
        right = left.withColumnsRenamed({"a": "b", "na": "nb", **{c: f"{c}2" for c in ("sig", "low", "high", "block", "label", "wide")}, **{f"{w}a": f"{w}b" for w in words}})
        met_once = (F.col("block") - F.col("low") + F.col("high2") - F.col("block2") == 0) & ((F.col("low") < F.col("high")) | (F.col("a") < F.col("b")))
        across = (F.col("label") != F.col("label2")) & met_once & may_link & (_differing(F.col("wide"), F.col("wide2")) <= most)
        met = left.join(right, (F.col("sig") == F.col("sig2")) & (F.col("low") == F.col("low2")) & (F.col("high") == F.col("high2")) & across)
        rest = materialise(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), size).distinct())
        labels = joined(labels, materialise(_verified(rest, known, work, k, num, den)))
    named = known.join(labels, known["sid"] == labels["v"], "left").select("sid", F.col("key").alias("least"), F.coalesce("label", "sid").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component"))
    named = materialise(named.join(roots, "root").select(F.col("sid").alias("their_sid"), "component"))
    full = sets.filter("n > 0").join(named, sets["sid"] == named["their_sid"], "left").select("key", "n", "component")
    out = full.unionByName(sets.filter("n = 0").select("key", "n", F.col("key").alias("component")))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
