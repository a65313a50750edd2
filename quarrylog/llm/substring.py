"""Substring dedup by unit hashing.

Units are lines, cut further behind sentence ends so that a passage inside a longer line is still made of whole units. A
unit's digest is taken over its lower-cased words alone, so white space, case and punctuation don't matter. Digests are
grouped over all texts; the occurrence earliest by (key, offset) stays and every other one is repeated. Runs of
consecutive repeated units with at least min_words words are removed, and of shorter runs, where line_words is given, the
whole lines of at least line_words words; what is shorter (headings, licence lines, chance repeats of a short sentence)
stays. With min_words = 1 every repeated unit goes. Spans are byte offsets of the original text.

A unit that a third of all texts hold is no hot group: each task settles the occurrences of every RUN_UNITS units itself,
so a digest reaches the shuffle once for that many, and what is settled is dealt by a key of its own.

Cases: null or empty texts have no units and stay as they are; null keys rank last; rows equal in key and text are one
document, so both keep or lose the same spans; a text whose every unit is repeated becomes empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from quarrylog.llm._ops import give_back, pick
from quarrylog.llm._text import _BASE, _BASE_INVERSE, ALNUM, LOWER, byte_class, chunks, mix, signed, span_hashes, spans

#: Words that a run of repeated units needs to be removed, and those that a repeated line needs by itself in the query and the pipeline.
MIN_WORDS, LINE_WORDS = 25, 15
#: Units whose occurrences a task settles at once; it holds some 60 bytes of each.
RUN_UNITS = 1 << 17

_STOP = byte_class((0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))
_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digest, begin, end, words, text and line marks of each unit that has words; begin and end are offsets in `data`.

    Line marks: 2 where the unit begins a line, plus 1 where it ends one.

    A unit ends behind white space that holds a newline or follows '.', '!' or '?'.
    """
    n = len(data)
    solid = np.flatnonzero(~_SPACE[data])
    before = np.concatenate((np.full(min(1, len(solid)), -1), solid[:-1]))
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    # White space belongs to the unit before it; a run of it ends a unit if a newline is in it or a stop is before it.
    gap = (solid > before + 1) & ((lines[solid] > lines[before + 1]) | _STOP[data[before]])
    solid, before = solid[gap], before[gap]
    home = offsets[np.searchsorted(offsets, solid, "right") - 1]
    run = np.maximum(before + 1, home)
    ended = (solid > run) & ((lines[solid] > lines[run]) | ((before >= home) & _STOP[data[before]]))
    begins = np.unique(np.concatenate((solid[ended], offsets[:-1][np.diff(offsets) > 0])))
    at_line = np.zeros(n + 1, bool)  # where a line or a text begins
    at_line[solid[ended & (lines[solid] > lines[run])]] = True
    at_line[offsets] = True
    starts, ends, _ = spans(data, offsets, ALNUM)
    words = span_hashes(data, starts, ends, LOWER)
    first = np.searchsorted(starts, begins)
    edges = np.concatenate((first, [len(starts)]))
    power = np.full(len(words) + 1, _BASE, np.uint64)
    inverse = np.full(len(words) + 1, _BASE_INVERSE, np.uint64)
    power[0] = inverse[0] = 1
    power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[:-1])))
    size = np.diff(edges)
    digest = mix((total[edges[1:]] - total[edges[:-1]]) * inverse[edges[:-1]] + size.astype(np.uint64))
    stop = np.concatenate((begins[1:], [n]))
    doc = np.searchsorted(offsets, begins, "right") - 1
    keep = size > 0
    return digest[keep], begins[keep], stop[keep], size[keep], doc[keep], (2 * at_line[begins] + at_line[stop])[keep]


def _settled(kept: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of a run of units: of each digest the first by (key, begin) still open, the others as repeated."""
    digest, keys, hashes, unit, begin, end, size = (pa.concat_arrays(x) if isinstance(x[0], pa.Array) else np.concatenate(x) for x in zip(*kept, strict=True))
    table = pa.table({"digest": signed(digest), "key": keys, "begin": begin, "row": np.arange(len(digest))})
    order = table.sort_by([("digest", "ascending"), ("key", "ascending"), ("begin", "ascending")])
    row = order["row"].to_numpy()
    sorted_digest, sorted_begin, sorted_hash = digest[row], begin[row], hashes[row]
    sorted_key = order["key"].combine_chunks()
    group_start = np.ones(len(row), bool)
    group_start[1:] = sorted_digest[1:] != sorted_digest[:-1]
    # Rows equal to the group's first in key, text and offset are the same occurrence (a repeated row).
    lead = np.maximum.accumulate(np.where(group_start, np.arange(len(row)), 0))
    lead_key = sorted_key.take(pa.array(lead))
    same_key = pa.compute.fill_null(pa.compute.equal(sorted_key, lead_key), False).to_numpy(zero_copy_only=False)
    same_key = same_key | (sorted_key.is_null().to_numpy(zero_copy_only=False) & lead_key.is_null().to_numpy(zero_copy_only=False))
    settled = ~(same_key & (sorted_begin == sorted_begin[lead]) & (sorted_hash == sorted_hash[lead]))
    for s in range(0, len(row), 50_000):
        part = slice(s, s + 50_000)
        r = row[part]
        yield pa.RecordBatch.from_pydict(
            {
                "digest": signed(np.where(settled[part], mix(sorted_digest[part] + mix(sorted_hash[part].view(np.uint64) + r.astype(np.uint64))), sorted_digest[part])),
                "key": sorted_key.slice(s, len(r)), "text_hash": hashes[r], "span": begin[r] << 32 | end[r],
                "place": (unit[r] << 32 | size[r]) * np.where(settled[part], -1, 1) - settled[part],
            }
        )


def repeated_units(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every occurrence of a unit but the earliest: (key, text_hash, unit, begin, end, words, starts, ends: a line)."""
    work = pick(df, key=key, text=text).withColumn("text_hash", F.xxhash64("text")).filter("text is not null")
    key_type = work.schema["key"].dataType.simpleString()

    def run(batches):
        kept, held = [], 0
        for batch in batches:
            keys, hashes = batch.column("key"), batch.column("text_hash").to_numpy(zero_copy_only=False)
            for a, _, data, offsets in chunks(batch.column("text")):
                digest, begin, end, size, doc, line = units(data, offsets)
                first = np.searchsorted(doc, doc)
                kept.append((digest, keys.take(pa.array(doc + a)), hashes[doc + a], np.arange(len(doc)) - first, begin - offsets[doc], end - offsets[doc], size << 2 | line))
                held += len(doc)
                if held >= RUN_UNITS:
                    yield from _settled(kept)
                    kept, held = [], 0
            give_back()
        if held:
            yield from _settled(kept)
        del kept
        give_back()

    found = work.mapInArrow(run, f"digest long, key {key_type}, text_hash long, span long, place long")
    # Ties of (key, begin) with different texts go to the smaller text hash.
    rank = F.struct(F.col("key").isNull().alias("n"), "key", F.shiftright("span", 32).alias("b"), "text_hash")
    earliest = F.min(rank).over(Window.partitionBy("digest"))
    settled = F.col("place") < 0
    place = F.when(settled, -F.col("place") - 1).otherwise(F.col("place"))
    words = place.bitwiseAND(0xFFFFFFFF)
    return (
        found.withColumn("repeated", settled | (rank > earliest))
        .filter("repeated")
        .select("key", "text_hash", F.shiftright(place, 32).cast("int").alias("unit"), F.shiftright("span", 32).cast("int").alias("begin"), F.col("span").bitwiseAND(0xFFFFFFFF).cast("int").alias("end"), F.shiftright(words, 2).cast("int").alias("words"), (words.bitwiseAND(2) > 0).alias("starts"), (words.bitwiseAND(1) > 0).alias("ends"))
    )


def _lines(run: list[dict]) -> Iterator[list[dict]]:
    """The whole lines among consecutive units."""
    line: list[dict] = []
    for u in run:
        line = [u] if u["starts"] else [*line, u] if line else []
        if line and u["ends"]:
            yield line
            line = []


def merge_runs(found: list[dict], min_words: int, line_words: int | None = None) -> list[dict]:
    """Removal spans from a text's repeated units (in order): runs of consecutive ones with enough words, else the long lines in them."""
    runs: list[list[dict]] = []
    for u in found:
        if runs and u["unit"] <= runs[-1][-1]["unit"] + 1:
            if u["unit"] > runs[-1][-1]["unit"]:
                runs[-1].append(u)
        else:
            runs.append([u])
    words = lambda units: sum(u["words"] for u in units)
    out = []
    for run in runs:
        taken = [run] if words(run) >= min_words else [line for line in _lines(run) if line_words is not None and words(line) >= line_words]
        out += [{"begin": t[0]["begin"], "end": t[-1]["end"], "words": words(t)} for t in taken]
    return out


REMOVED = "array<struct<begin:int,end:int,words:int>>"


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, line_words: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row with its repeated passages taken out: (key, text, removed: array of (begin, end, words), n_removed, *carry).

    begin and end are byte offsets of the text as given; n_removed is the words taken out. Only texts that lose something
    go through Python.
    """
    found = repeated_units(df, key, text).groupBy("key", "text_hash").agg(F.array_sort(F.collect_set(F.struct("unit", "begin", "end", "words", "starts", "ends"))).alias("units"))
    enough = F.aggregate("units", F.lit(0), lambda n, u: n + u["words"]) >= min(min_words, line_words or min_words)
    found = found.filter(enough).withColumnsRenamed({"key": "their_key", "text_hash": "their_hash"})
    kept = {f"c{i}": c for i, c in enumerate(carry)}
    work = pick(df, key=key, text=text, **kept).withColumn("text_hash", F.xxhash64("text"))
    joined = work.join(found, work["key"].eqNullSafe(found["their_key"]) & (work["text_hash"] == found["their_hash"]), "left").select("key", "text", "units", *kept)
    kind = pa.struct([("text", pa.string()), ("removed", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("words", pa.int32())])))])

    def cut(texts: pa.Array, units_of: pa.Array) -> pa.Array:
        out: list[dict | None] = [None] * len(texts)
        for i in np.flatnonzero(units_of.is_valid().to_numpy(zero_copy_only=False)).tolist():
            spans_of = merge_runs(units_of[i].as_py(), min_words, line_words)
            if spans_of:
                raw, parts, at = texts[i].as_py().encode(), [], 0
                for s in spans_of:
                    parts.append(raw[at : s["begin"]])
                    at = s["end"]
                out[i] = {"text": b"".join([*parts, raw[at:]]).decode("utf-8", "replace"), "removed": spans_of}
        return pa.array(out, kind)

    apply = F.arrow_udf(cut, f"struct<text:string,removed:{REMOVED}>", ArrowUDFType.SCALAR)
    done = joined.withColumn("cut", apply(F.when(F.col("units").isNotNull(), F.col("text")), F.col("units")))
    removed = F.coalesce("cut.removed", F.array().cast(REMOVED))
    return done.select(
        F.col("key").alias(key), F.when(F.col("cut").isNotNull(), F.col("cut.text")).otherwise(F.col("text")).alias(text), removed.alias("removed"),
        F.aggregate(removed, F.lit(0).cast("long"), lambda n, s: n + s["words"]).alias("n_removed"), *(F.col(k).alias(c) for k, c in kept.items()),
    )
