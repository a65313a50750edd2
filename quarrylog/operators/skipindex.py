"""A skip index for searches: which files can hold a text, by the trigrams of their rows.

Of every file of a table the trigrams of all values (A-Z folded, as containment folds them) are hashed into a bitmap of BITS
bits, kept in rows of Spark's bitmap buckets. A needle of three and more characters, without wildcards, can only be in a file
that has all its trigrams' bits; shorter needles and exclusions choose nothing. A file may be read in vain, none is left out
that has a match, so searches give the same rows with and without the index.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.functions.text import ascii_lower
from quarrylog.operators import filters

#: Bits of a file's bitmap, and those of a bucket of Spark's bitmap functions.
BITS, BUCKET = 1 << 18, 1 << 15
INDEX = "file string, bucket int, bits binary"


def _places(value: Column) -> Column:
    """Bit numbers of a value's trigrams."""
    starts = F.when(F.length(value) >= 3, F.sequence(F.lit(1), F.length(value) - 2))
    return F.transform(starts, lambda i: (F.crc32(F.substring(value, i, F.lit(3))) % BITS).cast("int"))


def of_files(df: DataFrame) -> DataFrame:
    """The index of a table as read from files: (file, bucket, bits). A file's distinct bits are made before anything is shuffled."""
    every = F.concat(*(F.coalesce(_places(ascii_lower(F.col(c).cast("string"))), F.array().cast("array<int>")) for c in df.columns))
    # An empty row keeps a file without trigrams in the index.
    seen = df.select(F.col("_metadata.file_path").alias("file"), F.explode(F.concat(F.array(F.lit(0)), F.array_distinct(every))).alias("at"))
    return seen.groupBy("file", F.floor(F.col("at") / BUCKET).cast("int").alias("bucket")).agg(F.bitmap_construct_agg((F.col("at") % BUCKET).cast("long")).alias("bits"))


def needed(raw: str | None) -> list[int]:
    """Bits that a file with a match of a search must have; none if the search tells nothing of them."""
    out: set[int] = set()
    for term in filters.terms(raw):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in term.text)
        if term.op == "exclude":
            continue
        runs = [text] if term.op == "exact" else text.replace("_", "%").split("%")  # wildcards end a run of plain characters
        for run in runs:
            out |= {zlib.crc32(run[i : i + 3].encode()) % BITS for i in range(len(run) - 2)}
    return sorted(out)


def may_match(index: DataFrame, raw: str | None) -> DataFrame:
    """(file) of the index's files that may have a match."""
    bits = needed(raw)
    if not bits:
        return index.select("file").distinct()
    byte = lambda at: F.conv(F.hex(F.substring("bits", at % BUCKET // 8 + 1, 1)), 16, 10).cast("int")
    hit = [F.max(F.when((F.col("bucket") == at // BUCKET) & (byte(at).bitwiseAND(1 << at % 8) != 0), 1).otherwise(0)) for at in bits]
    found = index.groupBy("file").agg(sum(hit[1:], hit[0]).alias("n"))
    return found.filter(F.col("n") == len(bits)).select("file")
