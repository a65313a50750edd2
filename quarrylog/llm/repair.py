"""Repair of conversation structure: the cheapest edits that make the roles of a conversation alternate.

Role initials must give `(s?(ua)+)?`. Edits are keep (0), rerole to user or assistant (2), delete (3, the only one for blank
rows and duplicates) and insert an empty turn (2); a truncated row that stays adds 1. The lattice of (row, grammar state) is
never built: Dijkstra's algorithm walks it from (0, nothing yet) with the key (cost, audit), audit being the initials of the
edits so far, and stops at the first accepting end node it pops. Two paths of equal cost to a node never have audits of which
one begins with the other, as the inserts alone would cost; so the least key at a node stays the least whatever follows.

In every state one role may follow (or an opening system row), so the audit alone tells the repaired conversation.

A conversation of up to LONG_ROWS rows and LONG_BYTES bytes is repaired by one task, which streams sorted rows. Longer ones
are cut into pieces over range partitions: every piece is solved from each of the four states to each of the four (a piece's
best ways are what a task computes by itself), the pieces' keys are added up in order, and the texts are hashed in one
streamed pass. So no task holds a long conversation; its audit and, as SHA-256 is sequential, its hash pass through one.

Cases: null roles and texts are one space; null ids are one conversation; rows of equal turn are ordered by role and text;
repeated rows are duplicates; a role's initial is its first character, and none but s, u and a can stay; a conversation
without rows has zeros, an empty audit and the hash of the empty string; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.llm._ops import materialise, pick

COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED = 1
#: Rows and bytes of text from which a conversation is repaired in pieces, and rows of a piece (a power of two).
LONG_ROWS, LONG_BYTES, PIECE = 2000, 1 << 24, 1 << 10
SPACE = " \t\n\v\f\r"
#: States: nothing yet, after system, after user, after assistant. What may be kept where, and what else may come there.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEPS = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
NEXT = [USER, USER, ASSISTANT, USER]
ACCEPTING = (NOTHING, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turn, role, text, there) with faults put in by the digest of key and turn; a dropped row stays as one that isn't there."""
    work = pick(df, key=key, turn=df[turn].cast("long"), role=F.coalesce(df[role], F.lit(" ")), text=F.coalesce(df[text], F.lit(" ")))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    work = work.withColumn("fault", F.crc32(F.concat(shown("key"), F.lit(":"), shown("turn"))) % 20)
    fault = F.col("fault")
    text = F.when(fault <= 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1))
    return work.select("key", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (fault != 0).alias("there"), F.explode(copies).alias("copy")).drop("copy")


def solve(marks: str, entry: int, exits: tuple[int, ...] = ACCEPTING, all_exits: bool = False) -> dict[int, tuple[int, str]]:
    """{state: (cost, audit)} of the cheapest edits of rows from one state to the first exit reached, or to each.

    marks: two characters a row, the role's initial (o for any but s, u, a) and . for sound, t for truncated, x for a row that must go.
    """
    n, queue, done, found = len(marks) // 2, [(0, "", 0, entry)], set(), {}
    while queue:
        cost, audit, i, state = heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in exits:
            found[state] = cost, audit
            if not all_exits:
                break
        follows = NEXT[state]
        heappush(queue, (cost + COSTS["I"], audit + "I", i, follows))
        if i < n:
            initial, fault = marks[2 * i], marks[2 * i + 1]
            heappush(queue, (cost + COSTS["D"], audit + "D", i + 1, state))
            if fault != "x":
                more = TRUNCATED if fault == "t" else 0
                heappush(queue, (cost + COSTS["R"] + more, audit + "R", i + 1, follows))
                if (to := KEEPS[state].get(initial)) is not None:
                    heappush(queue, (cost + COSTS["K"] + more, audit + "K", i + 1, to))
    return found


@lru_cache(maxsize=1 << 14)
def _short(marks: str) -> tuple[int, str]:
    return next(iter(solve(marks, NOTHING).values()))


def cheapest(marks: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation; many short ones are alike."""
    return _short(marks) if len(marks) <= 64 else next(iter(solve(marks, NOTHING).values()))


def lines(audit: str, state: int, roles: Iterator[tuple[str, str]]) -> Iterator[tuple[str, int]]:
    """(role:text, state behind it) of what the edits leave of rows."""
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            yield f"{NAMES[state]}:", state
            continue
        role, text = next(roles)
        if edit == "K":
            state = KEEPS[state][role[0]]
            yield f"{role}:{text}", state
        elif edit == "R":
            state = NEXT[state]
            yield f"{NAMES[state]}:{text}", state


def mark(role: str, text: str, repeated: bool) -> str:
    end = text.rstrip(SPACE)[-1:]
    return (role[:1] if role[:1] in ("s", "u", "a") else "o") + ("x" if not end or repeated else "." if end in ".!?" else "t")


def illegal_pairs(marks: str, before: str = "") -> int:
    initials = before + marks[::2]
    return sum(pair not in LEGAL for pair in map("".join, zip(initials, initials[1:], strict=False)))


def _repaired(rows: list[tuple]) -> tuple:
    """RESULT of one conversation's (turn, role, text) in order."""
    turns = {t for t, _, _ in rows if t is not None}
    seen, blank, duplicate, marks = set(), 0, 0, []
    for _, role, text in rows:
        repeated = (role, text) in seen
        seen.add((role, text))
        marks.append(mark(role, text, repeated))
        if marks[-1][1] == "x":
            is_blank = not text.strip(SPACE)
            blank, duplicate = blank + is_blank, duplicate + (not is_blank)
    marks = "".join(marks)
    cost, audit = cheapest(marks)
    text = "\n".join(line for line, _ in lines(audit, NOTHING, iter([(r, t) for _, r, t in rows])))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, blank, duplicate, marks[1::2].count("t"), illegal_pairs(marks), cost, audit, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _streamed(df: DataFrame, order: list[Column | str], columns: list[str], work, schema: str) -> DataFrame:  # noqa: ANN001
    """What work(rows of one key, in order) yields, rows being streamed: a key's rows are together but never held here."""
    from itertools import groupby

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"key {df.schema['key'].dataType.simpleString()}, {schema}"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("key", *columns)), strict=True))
        held: list[tuple] = []

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), target, strict=True)], schema=target)

        size = 0
        for key, own in groupby(rows, key=lambda row: row[0]):
            for out in work(row[1:] for row in own):
                held.append((key, *out))
                size += 200 + sum(len(v) for v in out if isinstance(v, str))
                if size > 1 << 22:
                    yield table()
                    held.clear()
                    size = 0
        if held:
            yield table()

    return df.select("key", *columns).repartition("key").sortWithinPartitions("key", *order).mapInArrow(run, schema)


def _in_order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]


def _whole(rows: DataFrame) -> DataFrame:
    def work(own: Iterator[tuple]) -> Iterator[tuple]:
        yield _repaired([(turn, role, text) for turn, role, text, there in own if there])

    return _streamed(rows, _in_order(), ["turn", "role", "text", "there"], work, RESULT)


def _in_pieces(rows: DataFrame) -> DataFrame:
    """Long conversations; see the module's head."""
    # Rows in order over range partitions, so that a conversation lies in many; repeated rows are told apart by where they lay.
    laid = materialise(rows.filter("there").drop("there").withColumn("lay", F.monotonically_increasing_id()))
    order = [F.asc_nulls_first("key"), *_in_order(), F.asc("lay")]
    placed = laid.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()).drop("lay")
    placed = materialise(placed)
    end, initial = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1)), F.substring("role", 1, 1)
    slim = placed.select(
        "key", "place", F.shiftright("place", PIECE.bit_length() - 1).alias("piece"), F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256).alias("digest"), F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        F.when(end == "", "b").when(end.isin(".", "!", "?"), ".").otherwise("t").alias("fault"),
    )
    first = slim.groupBy("key", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("their_key"), F.col("digest").alias("their_digest"), "first")
    slim = slim.join(first, slim["key"].eqNullSafe(first["their_key"]) & (slim["digest"] == first["their_digest"]), "left")
    slim = slim.withColumn("fault", F.when((F.col("fault") != "b") & (F.col("place") > F.col("first")), "d").otherwise(F.col("fault")))
    marks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("initial", "fault").alias("m")))), lambda x: x["m"]), "")
    pieces = slim.groupBy("key", "piece").agg(marks.alias("marks"), F.min("place").alias("place"))  # PIECE rows at most

    way = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                own = one.column("marks")[0].as_py()
                solved = own.replace("b", "x").replace("d", "x")
                found = [(p, q, *best) for p in range(4) for q, best in sorted(solve(solved, p, (0, 1, 2, 3), True).items())]
                entries = pa.array([[{"p": p, "q": q, "cost": c, "audit": a} for p, q, c, a in found]], way)
                yield pa.RecordBatch.from_arrays([one.column("key"), one.column("place"), one.column("marks"), entries], names=["key", "place", "marks", "ways"])

    key_type = rows.schema["key"].dataType.simpleString()
    solved = pieces.select("key", "place", "marks").mapInArrow(ways, f"key {key_type}, place long, marks string, ways array<struct<p:int,q:int,cost:bigint,audit:string>>")

    def joined(own: Iterator[tuple]) -> Iterator[tuple]:
        """(place, state, audit) of every piece, and at place -1 the totals."""
        best = {NOTHING: (0, "", None)}
        counts, illegal, last = dict.fromkeys("bdt", 0), 0, ""
        for place, marks, found in own:
            for f in counts:
                counts[f] += marks[1::2].count(f)
            illegal += illegal_pairs(marks, last)
            last = marks[-2]
            to: dict[int, tuple] = {}
            for w in found:
                if w["p"] in best:
                    cost, audit, chain = best[w["p"]]
                    new = cost + w["cost"], audit + w["audit"], (chain, place, w["p"], w["audit"])
                    if w["q"] not in to or new[:2] < to[w["q"]][:2]:
                        to[w["q"]] = new
            best = to
        cost, audit, chain = min((best[q] for q in ACCEPTING if q in best), key=lambda b: b[:2])
        yield -1, 0, audit, cost, counts["b"], counts["d"], counts["t"], illegal
        while chain:
            chain, place, state, part = chain
            yield place, state, part, None, None, None, None, None

    edits = materialise(_streamed(solved, ["place"], ["place", "marks", "ways"], joined, "place long, state int, audit string, cost long, blank long, duplicate long, truncated long, illegal long"))
    nothing = lambda *names: [F.lit(None).alias(n) for n in names]
    texts = placed.select("key", "place", F.lit(1).alias("kind"), "turn", "role", "text", *nothing("state", "audit", "cost", "blank", "duplicate", "truncated", "illegal"))
    both = edits.select("key", "place", F.lit(0).alias("kind"), *nothing("turn", "role", "text"), "state", "audit", "cost", "blank", "duplicate", "truncated", "illegal").unionByName(texts)

    def hashed(own: Iterator[tuple]) -> Iterator[tuple]:
        digest, first, totals = hashlib.sha256(), True, None
        low = high = at = None
        distinct = 0
        own = iter(own)
        held = next(own, None)
        while held is not None:
            place, kind, turn, _, _, state, audit, *counts = held
            if place < 0:
                totals, held = (audit, *counts), next(own, None)
                continue

            def rows_of_piece() -> Iterator[tuple[str, str]]:
                nonlocal low, high, at, distinct
                for row in own:
                    t = row[2]
                    if t is not None:
                        low, high = (t if low is None else low), t
                        distinct += t != at
                        at = t
                    yield row[3], row[4]

            for line, _ in lines(audit, state, rows_of_piece()):
                digest.update((("" if first else "\n") + line).encode("utf-8", "surrogatepass"))
                first = False
            held = next(own, None)
        audit, cost, blank, duplicate, truncated, illegal = totals
        gaps = high - low + 1 - distinct if distinct else 0
        yield gaps, blank, duplicate, truncated, illegal, cost, audit, digest.hexdigest()

    return _streamed(both, ["place", "kind"], ["place", "kind", "turn", "role", "text", "state", "audit", "cost", "blank", "duplicate", "truncated", "illegal"], hashed, RESULT)


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """(key, *RESULT) for every key of rows (key, turn, role, text, there)."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.count_if("there").alias("n_there"))
    long_ones = materialise(sizes.filter((F.col("n_there") > 0) & ((F.col("n") > long_rows) | (F.col("bytes") > long_bytes))).select(F.col("key").alias("long_key")))
    if not long_ones.limit(1).count():
        return _whole(rows)
    of = rows["key"].eqNullSafe(long_ones["long_key"])
    return _whole(rows.join(long_ones, of, "left_anti")).unionByName(_in_pieces(rows.join(long_ones, of, "left_semi")))
