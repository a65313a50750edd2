"""Bounded training samples of labelled texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylog.llm._ops import crc_mod, pick

#: Texts sampled over both classes, and the bytes a sampled text may have.
SAMPLE_TEXTS = 3000
SAMPLE_TEXT_BYTES = 1 << 15
#: Rows whose crc32(key) modulo this is 0 are held out.
HOLD_OUT = 5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", texts: int = SAMPLE_TEXTS, text_bytes: int = SAMPLE_TEXT_BYTES) -> tuple[list[tuple[str, int]], float]:
    """((text, 0 or 1) of about `texts` rows in equal shares of the classes, share of label 1 among all labelled rows).

    Only rows that are not held out count. A class's rows are those whose digest lies below its rate, so every run and
    every partitioning gives the same sample; it is what the driver and a broadcast hold, and bounded by the parameters.
    """
    own = pick(labels, key=key, label=labels[label].cast("int")).filter(F.col("label").isin(0, 1) & (crc_mod(F.col("key"), HOLD_OUT) != 0))
    n = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n:
        return [], 0.5
    rate = F.when(F.col("label") == 1, texts / 2 / max(1, n.get(1, 0))).otherwise(texts / 2 / max(1, n.get(0, 0)))
    u = F.pmod(F.xxhash64(F.lit("labelled"), F.col("key").cast("string")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = own.filter(u < rate)
    rows = pick(docs, key=key, text=text).join(F.broadcast(chosen), "key").filter(F.col("text").isNotNull() & (F.octet_length("text") <= text_bytes))
    return sorted((r["text"], r["label"]) for r in rows.select("text", "label").collect()), n.get(1, 0) / sum(n.values())
