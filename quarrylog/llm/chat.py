"""Preference formatting: two conversations of a pair become one prompt and two masked completions.

The longest common prefix of turns (equal role and equal text) is rendered once, as the prompt; what follows it in either
conversation is its completion. Of a completion only the assistant's words and their end mark are learned: masks are
spans of code points [begin, end) of the completion string; everything else in it is context.

Marks of a turn can't come from its content: `<|` in a text is shown as `<||`, and `|` in a role as `||`; read() gives the
turns of a rendering back.

Cases: null text is the empty text and null role the empty role; conversations that are equal as a whole give two empty
completions without spans (tied); a null conversation is one without turns; conversations of one turn are like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.llm._ops import pick

#: Rendering of a turn; the learned part of an assistant's turn runs from the text to the end mark.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>"
LEARNED_ROLE = "assistant"
TURNS = "array<struct<role:string,text:string>>"


def conversations(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turns) from one row a turn; turns in order of (turn, role, text)."""
    work = pick(df, key=key, turn=turn, role=F.coalesce(df[role], F.lit("")), text=F.coalesce(df[text], F.lit("")))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return work.groupBy("key").agg(turns.alias("turns")).withColumnRenamed("key", key)


def escaped(turns: Column) -> Column:
    """Turns whose roles and texts hold no marks."""
    return F.transform(turns, lambda t: F.struct(F.replace(t["role"], F.lit("|"), F.lit("||")).alias("role"), F.replace(t["text"], F.lit("<|"), F.lit("<||")).alias("text")))


def read(shown: Column) -> Column:
    """The turns of a prompt, a completion or both one after another."""
    turn = F.lit(r"(?s)<\|((?:[^|]|\|\|)*)\|>\n(.*?)<\|end\|>\n")
    roles, texts = F.regexp_extract_all(shown, turn, F.lit(1)), F.regexp_extract_all(shown, turn, F.lit(2))
    pairs = F.arrays_zip(roles.alias("role"), texts.alias("text"))
    return F.transform(pairs, lambda t: F.struct(F.replace(t["role"], F.lit("||"), F.lit("|")).alias("role"), F.replace(t["text"], F.lit("<||"), F.lit("<|")).alias("text")))


def rendered(turns: Column) -> Column:
    """(text, spans) of turns one after another."""
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def add(so_far: Column, turn: Column) -> Column:
        head = F.concat(so_far["text"], F.lit(OPEN), turn["role"], F.lit(CLOSE))
        body = F.concat(head, turn["text"], F.lit(END))
        span = F.array(F.struct(F.length(head).alias("begin"), F.length(body).alias("end")))
        spans = F.when(turn["role"] == LEARNED_ROLE, F.concat(so_far["spans"], span)).otherwise(so_far["spans"])
        return F.struct(F.concat(body, F.lit("\n")).alias("text"), spans.alias("spans"))

    return F.aggregate(escaped(turns), start, add)


def preference(pairs: DataFrame, key: str = "pair_id", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """(key, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans, tied) for every pair of turn arrays."""
    whole = lambda c: F.transform(F.coalesce(c.cast(TURNS), F.array().cast(TURNS)), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    work = pick(pairs, key=key, chosen=whole(pairs[chosen]), rejected=whole(pairs[rejected]))
    same = F.transform(F.arrays_zip(F.col("chosen").alias("a"), F.col("rejected").alias("b")), lambda z: z["a"].eqNullSafe(z["b"]))
    differs = F.array_position(same, False)
    n = F.when(differs > 0, differs - 1).otherwise(F.size("chosen")).cast("int")
    work = work.withColumn("n", n)
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    work = work.withColumns({"prompt": rendered(F.slice("chosen", F.lit(1), F.col("n")))["text"], "c": rendered(rest("chosen")), "r": rendered(rest("rejected"))})
    return work.select(F.col("key").alias(key), F.col("n").alias("prompt_turns"), "prompt", F.col("c.text").alias("chosen"), F.col("r.text").alias("rejected"), F.col("c.spans").alias("chosen_spans"), F.col("r.spans").alias("rejected_spans"), ((F.size(rest("chosen")) == 0) & (F.size(rest("rejected")) == 0)).alias("tied"))


def swapped_pairs(talks: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, chosen, rejected): every conversation up to its last assistant turn, and the same with that turn replaced.

    The replacement is the last assistant turn of the partner, the conversation whose key differs in the last bit. One
    without an assistant turn is chosen whole and rejected without its last turn; where the partner has none, the
    rejected one ends before the turn.
    """
    at = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == LEARNED_ROLE, i + 1).otherwise(0)))
    talks = talks.withColumn("at", F.coalesce(at, F.lit(0)))
    answers = talks.filter("at > 0").select(F.col(key).bitwiseXOR(1).alias("partner"), F.element_at("turns", F.col("at").cast("int")).alias("answer"))
    joined = talks.join(answers, talks[key] == answers["partner"], "left")
    upto = F.when(F.col("at") > 0, F.col("at")).otherwise(F.size("turns"))
    before = F.slice("turns", F.lit(1), F.greatest(upto - 1, F.lit(0)))
    replaced = F.when((F.col("at") > 0) & F.col("answer").isNotNull(), F.concat(before, F.array("answer"))).otherwise(before)
    return joined.select(key, F.slice("turns", F.lit(1), upto).alias("chosen"), replaced.alias("rejected"))


def digest(formatted: DataFrame, key: str) -> DataFrame:
    """Hashes of the strings and spans as text."""
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ",")
    return formatted.select(key, "prompt_turns", F.length("prompt").alias("prompt_chars"), *(F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")), shown("chosen_spans").alias("chosen_spans"), shown("rejected_spans").alias("rejected_spans"), "tied")
