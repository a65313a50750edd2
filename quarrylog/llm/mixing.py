"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: its share by weight of all words, at most MAX_COPIES times what it has, the excess
going to the sources below their cap by weight. A document's expected copies are its source's target over its source's
size. The whole part is allocated with certainty; the fraction p is the inclusion probability of one more copy, decided
by Pareto order sampling: with u uniform by the row's id, text digest and number among equal rows, documents of a source are ranked by
(u / (1 - u)) / (p / (1 - p)) and taken from the lowest on until the source's words are used up, so the sample's size in
words is fixed. What is left is less than the next document; it is filled by passed-over documents, each of the size that fits
best, as long as that brings the total nearer, FILLS at most.

A hot source is never ranked in one task: ranks are cut into cells of equal probability, cells are summed, and only the
cell that holds the cut is ranked, twice over.

Cases: null text has size 0; null sources are a source of their own, last by code point; sources without words get
nothing; rows of one id, or without any, draw by their texts, and rows of equal id, text and source are numbered, so each
draws for itself. Which of such rows gets which number is open (they differ in carried columns at most), how many are taken
isn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylog.llm._ops import materialise, pick

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = "mix-1"
#: Ranks are cut into this many cells, and the deciding cell into as many again.
CELLS = 1 << 12
#: Passed-over documents that fill what is left of a source's budget, at most.
FILLS = 3
#: Sources whose tables are still sent to all tasks.
BROADCAST_SOURCES = 100_000
#: Repeated rows whose names (source, id, digest) are still sent to all tasks.
BROADCAST_ROWS = 200_000
_UNIT = 1 << 48


def word_count(text: Column) -> Column:
    """Number of runs of anything but space and ASCII white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size) to (source, source_size, target, copies, p); one row a source.

    Sources by code point, null last, take the weights in turn. The level L with sum(min(cap, weight * L)) = all words is
    found over sources by cap / weight: those before the first whose cap exceeds weight * L stay at their caps.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    own = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * max_copies)
    upward = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), "source")
    before, rest, everything = upward.rowsBetween(Window.unboundedPreceding, -1), upward.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    own = own.withColumns({"used": F.coalesce(F.sum("cap").over(before), F.lit(0)), "open": F.sum("weight").over(rest), "all": F.sum("source_size").over(everything)})
    own = own.withColumn("level", (F.col("all") - F.col("used")).cast("double") / F.col("open"))
    first_open = F.min(F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.struct("used", "level"))).over(everything)
    own = own.withColumn("final", first_open["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("final"), F.col("cap").cast("double")))
    own = own.withColumn("target", target).withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    own = own.withColumn("copies", F.floor("ratio"))
    return own.select("source", "source_size", "target", "copies", (F.col("ratio") - F.col("copies")).alias("p"), (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"))


def uniform(key: Column, digest: Column, nth: Column, seed: str = SEED) -> Column:
    """Draw in (0, 1) from a row's id, text digest and number among equal rows: 48 bits, halfway between neighbours."""
    row = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), digest, nth.cast("string"), F.lit(seed))
    return (F.conv(F.substring(F.md5(row), 1, 12), 16, 10).cast("double") + 0.5) / _UNIT


#: What tells rows apart; rows equal in these are numbered.
_SAME = ("source", "key", "digest")


def numbered(docs: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """Adds nth, a row's number from 0 among rows of equal source, key and digest; repeated: those that several rows have.

    Repeated rows are written with the task that read them, numbered within each task's share and moved up by the counts of
    the tasks before, so no group of equal rows is ever in one task.
    """
    if repeated is None:
        return docs.withColumn("nth", F.lit(0).cast("long"))
    same = F.struct(*_SAME)
    marked = docs.withColumn("same", same)
    once = marked.join(repeated, "same", "left_anti").drop("same").withColumn("nth", F.lit(0).cast("long"))
    several = materialise(marked.withColumn("part", F.spark_partition_id()).join(F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated, "same", "left_semi"))
    before = Window.partitionBy("same").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = several.groupBy("same", "part").agg(F.count("*").alias("n")).withColumn("moved", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("same", "part").orderBy(F.lit(0))) - 1
    several = several.withColumn("own", own).join(shares, ["same", "part"]).withColumn("nth", (F.col("own") + F.col("moved")).cast("long"))
    return once.unionByName(several.select(*once.columns))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken, *carry) for every row; taken = copies * size words."""
    digest = F.md5(F.coalesce(df[text], F.lit("")))
    slim = materialise(pick(df, key=key, source=source, size=word_count(df[text]), digest=digest))
    repeated = materialise(slim.groupBy(*_SAME).count().filter("count > 1").select(F.struct(*_SAME).alias("same")))
    repeated = None if repeated.isEmpty() else repeated
    slim = slim if repeated is None else materialise(numbered(slim, repeated))
    slim = slim.withColumn("nth", F.lit(0).cast("long")) if repeated is None else slim
    plan = materialise(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_copies))
    n_sources = plan.count()
    # Tables of one row a source are sent to all tasks up to a number of sources, and joined by shuffle beyond it.
    small = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda t: t)

    def to_source(docs: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
        table = table.withColumnRenamed("source", "their_source")
        return docs.join(small(table), docs["source"].eqNullSafe(table["their_source"]), how).drop("their_source")

    def ranked(docs: DataFrame, plan: DataFrame) -> DataFrame:
        u, p = F.col("u"), F.col("p")
        docs = to_source(docs, plan).withColumn("u", uniform(F.col("key"), F.col("digest"), F.col("nth"), seed))
        docs = docs.withColumn("q", F.when(p > 0, (u / (1 - u)) / (p / (1 - p))))
        # q / (1 + q) is in (0, 1) and grows with q, so its leading digits are cells in rank order.
        digits = F.least(F.lit(CELLS * CELLS - 1), F.floor(F.col("q") / (1 + F.col("q")) * (CELLS * CELLS))).cast("long")
        place = F.struct("q", F.col("key").isNull().alias("n"), "key", "digest", "nth")
        return docs.withColumns({"cell": F.floor(digits / CELLS), "inner": digits % CELLS, "place": F.when(p > 0, place)})

    def cut(cells: DataFrame, by: str) -> DataFrame:
        """Of each source the cell in which the running words pass the budget, and the words before it."""
        w = Window.partitionBy("source").orderBy(by)
        cells = cells.withColumn("upto", F.sum("words").over(w)).filter("upto > budget")
        return cells.groupBy("source").agg(F.min(F.struct(by, (F.col("upto") - F.col("words")).alias("before"))).alias("cut"))

    work = ranked(slim, plan)
    cells = work.filter("q is not null").groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
    outer = materialise(cut(cells, "cell").select("source", F.col("cut.cell").alias("cell1"), F.col("cut.before").alias("before1")))
    edge = to_source(work, outer).filter("cell = cell1")
    cells = edge.groupBy("source", "inner").agg(F.sum("size").alias("words"), F.first(F.col("budget") - F.col("before1")).alias("budget"))
    inner = materialise(cut(cells, "inner").select("source", F.col("cut.inner").alias("inner2"), F.col("cut.before").alias("before2")))
    last = to_source(edge, inner).filter("inner = inner2")
    ordered = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("words_before", F.coalesce(F.sum("size").over(ordered), F.lit(0)) + F.col("before1") + F.col("before2")).filter("words_before + size > budget")
    stop = last.groupBy("source").agg(F.min(F.struct("place", (F.col("budget") - F.col("words_before")).alias("gap"))).alias("stop"))
    stop = materialise(stop.select("source", F.col("stop.place").alias("stop_at"), F.col("stop.gap").alias("gap")))
    # The rest of the budget: the passed-over documents whose sizes fit it best, one after another.
    left = stop.select("source", "gap", F.array().cast(T.ArrayType(work.schema["place"].dataType)).alias("filled"))
    for _ in range(FILLS):
        passed = to_source(to_source(work, stop.drop("gap")).filter("place >= stop_at and size > 0"), left)
        passed = passed.filter((F.abs(F.col("size") - F.col("gap")) < F.col("gap")) & ~F.array_contains("filled", F.col("place")))
        best = passed.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("miss"), "place", "size")).alias("best"))
        more = to_source(left, best, "left")
        left = materialise(more.select("source", F.when(F.col("best").isNull(), 0.0).otherwise(F.col("gap") - F.col("best.size")).alias("gap"), F.when(F.col("best").isNull(), F.col("filled")).otherwise(F.array_append("filled", F.col("best.place"))).alias("filled")))
    fit = left.select("source", "filled")

    kept = {f"c{i}": c for i, c in enumerate(carry)}
    docs = numbered(pick(df, key=key, source=source, size=word_count(df[text]), digest=digest, **kept), repeated) if carry else slim
    docs = to_source(to_source(ranked(docs, plan), stop, "left"), fit, "left")
    more = F.coalesce(F.when(F.col("stop_at").isNull(), F.col("place").isNotNull()).otherwise(F.col("place") < F.col("stop_at")), F.lit(False))
    filled = F.coalesce(F.array_contains("filled", F.col("place")), F.lit(False))
    docs = docs.withColumn("n", F.col("copies") + (more | filled).cast("long"))
    return docs.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", F.col("n").alias("copies"), (F.col("n") * F.col("size")).alias("taken"), *(F.col(k).alias(c) for k, c in kept.items()))
