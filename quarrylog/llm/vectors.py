"""Compression of vectors to codes of 16 parts, by codebooks learned from all vectors.

Components become integers (floor of 256 times the value), vectors are cut into PARTS consecutive parts, and each part
position has a codebook of up to ENTRIES entries. The search for the nearest entry is a partial-distance search: the
dimensions of a part are taken in descending variance of its codebook, squared differences are summed up as integers, and
an entry is dropped once its sum strictly exceeds the best complete distance so far. Masks do that for many vectors at a
time. Nothing is approximate: what is left holds all nearest entries, and the first of them is taken.

Vectors never move: a pass reads them where they lie, and a task hands on one row of sums for each entry and dimension. The
codebooks, ENTRIES times the dimensions, are all that the driver holds and sends to the tasks.

Cases: vectors that are null or hold null, NaN or infinite components are left out; shorter vectors end in zeros up to the
longest one's length; a length that PARTS doesn't divide is cut at floor(i * length / PARTS); repeated ids are rows of their
own, ordered by their vectors, and null ids come last; with fewer vectors than ENTRIES the codebooks are shorter, and a
table without vectors gives no rows. Components beyond 2 ** 26 are computed in unbounded integers; an error beyond a long
is given as the greatest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylog.llm._ops import arrow_map, materialise, pick

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors searched at a time; pairs of vector and entry are this times ENTRIES at most.
BLOCK = 4096
#: Components up to this keep all sums of squares within 64 bits, for vectors of up to 2 ** 8 dimensions.
SAFE = 1 << 26
LONG_MAX = (1 << 63) - 1

Codebooks = list[np.ndarray]  # one (entries, dimensions of the part) array of integers for each part


def kept(df: DataFrame, key: str, vector: str, **more: str) -> DataFrame:
    """(key, v, *more) of the vectors whose components are all finite numbers."""
    work = pick(df, key=key, v=df[vector].cast("array<double>"), **more)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return work.filter(F.col("v").isNotNull() & finite)


def edges(length: int, parts: int = PARTS) -> list[int]:
    return [length * i // parts for i in range(parts + 1)]


def integers(column: pa.Array, length: int) -> np.ndarray:
    """(rows, length) integers of a column of vectors; Python's own where 64 bits might not hold what is made of them."""
    offsets = np.asarray(column.offsets) - column.offsets[0].as_py()
    flat = np.floor(np.asarray(column.flatten(), np.float64) * SCALE)
    sizes = np.diff(offsets)
    dense = np.zeros((len(sizes), length))
    at = np.arange(len(flat)) - np.repeat(offsets[:-1], sizes)
    dense[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    if length > 256 or len(flat) and np.abs(flat).max() > SAFE:
        return np.array([[int(x) for x in row] for row in dense], object).reshape(dense.shape)
    return dense.astype(np.int64)


def order_of(book: np.ndarray) -> np.ndarray:
    """Dimensions in descending variance of the entries, equal ones from the lowest."""
    exact = book.astype(object)
    spread = [len(book) * sum(x * x for x in exact[:, d]) - sum(exact[:, d]) ** 2 for d in range(book.shape[1])]
    return np.array(sorted(range(len(spread)), key=lambda d: -spread[d]), np.int64)


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each point; of several nearest entries the first."""
    if not book.shape[1]:
        return np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    if points.dtype == object or book.dtype == object:
        points, book = points.astype(object), book.astype(object)
    first, *rest = order_of(book)
    so_far = (points[:, first, None] - book[None, :, first]) ** 2
    # The entry that is best by the first dimension is completed, so that there is a distance to exceed.
    guess = so_far.argmin(axis=1)
    best = ((points - book[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(so_far <= best[:, None])
    so_far = so_far[row, entry]
    for d in rest:
        so_far = so_far + (points[row, d] - book[entry, d]) ** 2
        alive = so_far <= best[row]
        row, entry, so_far = row[alive], entry[alive], so_far[alive]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(so_far, starts) if len(row) else so_far
    hit = so_far == np.repeat(least, np.diff(starts, append=len(row)))
    first_hit = np.flatnonzero(hit)[np.searchsorted(row[hit], np.arange(len(points)))]
    return entry[first_hit], so_far[first_hit]


def _blocks(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, batch.num_rows, BLOCK):
        yield at, integers(batch.slice(at, BLOCK).column("v"), length)


def _seeds(vectors: DataFrame, length: int, parts: int, entries: int) -> Codebooks:
    rows = vectors.orderBy(F.col("key").isNull(), "key", "v").limit(entries).select("v").toArrow()
    ints = integers(rows.column("v").combine_chunks(), length) if rows.num_rows else np.zeros((0, length), np.int64)
    cut = edges(length, parts)
    return [ints[:, a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def improved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part goes to its nearest entry, then each entry becomes the floor of its parts' mean."""
    cut = edges(sum(b.shape[1] for b in books), len(books))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(b.shape, object) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for _, ints in _blocks(batch, cut[-1]):
                for p, book in enumerate(books):
                    own = ints[:, cut[p] : cut[p + 1]]
                    code, _ = nearest(own, book)
                    part = np.zeros(book.shape, own.dtype)
                    np.add.at(part, code, own)
                    total[p] += part
                    count[p] += np.bincount(code, minlength=len(book))
        rows = [(p, e, d, str(total[p][e, d]), int(count[p][e])) for p in range(len(books)) for e in np.flatnonzero(count[p]) for d in range(books[p].shape[1])]
        if rows:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "dim", "total", "n"])

    found = vectors.select("v").mapInArrow(sums, "part int, entry int, dim int, total string, n long")
    merged = found.groupBy("part", "entry", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = [b.copy() for b in books]
    for r in merged.collect():  # one row for each number of the codebooks
        out[r["part"]][r["entry"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """The codebooks of a table of kept vectors; they begin as the parts of those with the smallest keys."""
    length = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    books = _seeds(vectors, length, parts, entries)
    for _ in range(rounds if len(books[0]) else 0):
        books = improved(vectors, books)
    return books


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for row in b for x in row).encode()).hexdigest()


def encode(vectors: DataFrame, books: Codebooks, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, code, error, *carry): indices of the nearest entries as hex digits, and their squared distances summed up."""
    cut = edges(sum(b.shape[1] for b in books), len(books))
    digits = np.array([f"{i:02x}" for i in range(max(256, len(books[0])))])

    def codes(batch: pa.RecordBatch) -> Iterator[dict]:
        for at, ints in _blocks(batch, cut[-1]):
            found = [nearest(ints[:, cut[p] : cut[p + 1]], book) for p, book in enumerate(books)]
            code = digits[np.stack([c for c, _ in found], axis=1)]
            error = sum(e for _, e in found)
            own = batch.slice(at, BLOCK)
            yield {"key": own.column("key"), "code": ["".join(row) for row in code], "error": [min(int(e), LONG_MAX) for e in error]} | {c: own.column(c) for c in carry}

    fields = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = f"key {fields['key']}, code string, error long" + "".join(f", {c} {fields[c]}" for c in carry)
    return arrow_map(vectors, codes, schema)


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, label, code, error, label_error, codebooks_sha256); label_error sums the errors of equal labels, null being one."""
    vectors = kept(df, key, vector, label=label)
    books = learn(vectors)
    coded = materialise(encode(vectors, books, carry=("label",)))
    of_label = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX)).cast("long").alias("label_error"))
    joined = coded.join(of_label.withColumnRenamed("label", "their_label"), F.col("label").eqNullSafe(F.col("their_label")))
    return joined.select(F.col("key").alias(key), F.col("label").alias(label), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
