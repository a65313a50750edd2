"""The training-data queries, one for each operator, over whole tables, and the SQL that checks those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.llm import chat, decontaminate, extract, flac, jaccard, language, mixing, quality, repair, substring, tokens, toxicity, vectors
from quarrylog.llm._ops import crc_mod, spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose texts cost much work each."""
    return spread(_table(spark, sf_dir, name))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(_texts(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS x
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
shingles AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM words, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
found AS (SELECT doc_id, s.n, i, item_id FROM shingles s JOIN windows w ON s.x = w.x AND s.n = w.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
of_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN of_items USING (doc_id)
"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(_texts(spark, sf_dir), line_words=substring.LINE_WORDS)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH docs AS (
  SELECT *, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || digest || ':' || nth || ':mix-1'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656 AS u
  FROM (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS digest,
           row_number() OVER (PARTITION BY source, doc_id, md5(coalesce(text, ''))) - 1 AS nth
    FROM documents)),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM sources),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER up, 0)::BIGINT)::DOUBLE / (sum(weight) OVER down)::BIGINT AS level, coalesce(sum(cap) OVER up, 0)::BIGINT AS used
  FROM weighed
  WINDOW up AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         down AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
final AS (SELECT arg_min(level, used) AS level FROM levels WHERE cap >= weight * level),
plan AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(weight * final.level, cap::DOUBLE)) AS target FROM levels, final),
shares AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM plan),
budgets AS (SELECT *, floor(ratio)::BIGINT AS copies, ratio - floor(ratio)::BIGINT AS p, target - floor(ratio)::BIGINT * source_size AS budget FROM shares),
ranked AS (
  SELECT d.*, source_size, target, copies, budget, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q
  FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source),
ordered AS (
  SELECT *, CASE WHEN q IS NOT NULL THEN row_number() OVER w END AS place, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM ranked WINDOW w AS (PARTITION BY source ORDER BY q NULLS LAST, doc_id, digest, nth)),
stop AS (SELECT source, min(place) AS stop_at, arg_min(budget - before, place) AS gap FROM ordered WHERE q IS NOT NULL AND before + size > budget GROUP BY source),
passed AS (
  SELECT o.source, o.place, o.size, s.gap FROM ordered o JOIN stop s ON o.source IS NOT DISTINCT FROM s.source WHERE o.place >= s.stop_at AND o.size > 0),
fit1 AS (
  SELECT source, place, gap - size AS gap FROM passed
  WHERE abs(size - gap) < gap QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(size - gap), place) = 1),
fit2 AS (
  SELECT p.source, p.place, f.gap - p.size AS gap FROM passed p JOIN fit1 f ON p.source IS NOT DISTINCT FROM f.source AND p.place <> f.place
  WHERE abs(p.size - f.gap) < f.gap QUALIFY row_number() OVER (PARTITION BY p.source ORDER BY abs(p.size - f.gap), p.place) = 1),
fit3 AS (
  SELECT p.source, p.place FROM passed p JOIN fit1 e ON p.source IS NOT DISTINCT FROM e.source AND p.place <> e.place
  JOIN fit2 f ON p.source IS NOT DISTINCT FROM f.source AND p.place <> f.place
  WHERE abs(p.size - f.gap) < f.gap QUALIFY row_number() OVER (PARTITION BY p.source ORDER BY abs(p.size - f.gap), p.place) = 1),
fit AS (SELECT source, place AS filled FROM fit1 UNION ALL SELECT source, place FROM fit2 UNION ALL SELECT source, place FROM fit3)
SELECT o.doc_id, o.size, o.source_size, o.target,
       o.size * (o.copies + CASE WHEN o.place IS NOT NULL AND (s.stop_at IS NULL OR o.place < s.stop_at) OR f.filled IS NOT NULL THEN 1 ELSE 0 END) AS taken
FROM ordered o LEFT JOIN stop s ON o.source IS NOT DISTINCT FROM s.source LEFT JOIN fit f ON o.source IS NOT DISTINCT FROM f.source AND o.place = f.filled
"""


def op4_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(_texts(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    return toxicity.classify(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    learned = docs.filter(F.coalesce(crc_mod(docs["doc_id"], 4) != 2, F.lit(False)))
    sample = language.training_sample(learned, "doc_id", "text", "lang")
    model = language.fit([t for t, _ in sample], [y for _, y in sample])
    held_out = docs.withColumn("held_out", F.coalesce(crc_mod(docs["doc_id"], 4) == 2, F.lit(False)))
    return language.predict(held_out, model, carry=("held_out",)).select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = chat.conversations(_table(spark, sf_dir, "conversations"))
    return chat.digest(chat.preference(chat.swapped_pairs(talks), key="conv_id"), "conv_id")


OP7_SQL = r"""
WITH turns AS (
  SELECT conv_id, role, shown_text AS text, i, '<|' || replace(role, '|', '||') || '|>' || chr(10) || shown_text || '<|end|>' || chr(10) AS shown
  FROM (
    SELECT conv_id, coalesce(role, '') AS role, replace(coalesce(text, ''), '<|', '<||') AS shown_text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS i
    FROM conversations)),
talks AS (
  SELECT conv_id, coalesce(max(i) FILTER (WHERE role = 'assistant'), 0) AS last_at, count(*) AS n, max_by(text, i) FILTER (WHERE role = 'assistant') AS answer
  FROM turns GROUP BY conv_id),
pairs AS (
  SELECT t.conv_id, CASE WHEN t.last_at > 0 THEN t.last_at ELSE t.n END AS upto, t.last_at, t.answer, p.answer AS other,
         CASE WHEN t.last_at > 0 AND p.answer = t.answer THEN 1 ELSE 0 END AS same
  FROM talks t LEFT JOIN talks p ON p.conv_id = xor(t.conv_id, 1)),
prompts AS (
  SELECT p.conv_id, coalesce(string_agg(shown, '' ORDER BY i), '') AS prompt
  FROM pairs p LEFT JOIN turns t ON t.conv_id = p.conv_id AND t.i <= p.upto - 1 + p.same GROUP BY p.conv_id),
ends AS (
  SELECT p.*, CASE WHEN p.same = 1 THEN '' ELSE t.shown END AS chosen,
         CASE WHEN p.same = 1 OR p.last_at = 0 OR other IS NULL THEN '' ELSE '<|assistant|>' || chr(10) || other || '<|end|>' || chr(10) END AS rejected
  FROM pairs p JOIN turns t ON t.conv_id = p.conv_id AND t.i = p.upto)
SELECT conv_id, (upto - 1 + same)::INTEGER AS prompt_turns, length(prompt)::INTEGER AS prompt_chars, sha256(prompt) AS prompt_sha256,
       sha256(chosen) AS chosen_sha256, sha256(rejected) AS rejected_sha256,
       CASE WHEN last_at > 0 AND same = 0 THEN '14-' || (21 + length(answer)) ELSE '' END AS chosen_spans,
       CASE WHEN rejected <> '' THEN '14-' || (21 + length(other)) ELSE '' END AS rejected_spans, same = 1 AS tied
FROM ends JOIN prompts USING (conv_id)
"""


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_texts(spark, sf_dir))


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS x
  FROM words, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * n_both >= 85 * (p.n + q.n - n_both)),
reach AS (
  SELECT doc_id AS v, doc_id AS r FROM words
  UNION
  SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT v AS doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN sizes ON v = doc_id GROUP BY v
"""


def op9_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.read_back(flac.encode(_texts(spark, sf_dir)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    return quality.classify(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = tokens.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return tokens.digest(_texts(spark, sf_dir), vocabulary)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.compress(_texts(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _op12_round(n: int) -> str:
    """Assignment of all parts to the entries of round n, and the entries of the next round."""
    return f"""
near{n} AS (
  SELECT vec_id, part, v, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist
  FROM (SELECT p.vec_id, p.part, p.v, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist FROM parts p JOIN book{n} b ON p.part = b.part)
  GROUP BY vec_id, part, v),
mean{n} AS (
  SELECT part, entry, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY dim) AS v
  FROM (SELECT part, entry, dim, sum(v[dim])::BIGINT AS s, count(*)::BIGINT AS n FROM near{n}, unnest(range(1, len(v) + 1)) AS t(dim) GROUP BY part, entry, dim) GROUP BY part, entry),
book{n + 1} AS (SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{n} b LEFT JOIN mean{n} m USING (part, entry)),"""


OP12_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, part, v[part * len(v) // 16 + 1:(part + 1) * len(v) // 16] AS v FROM kept, unnest(range(16)) AS t(part)),
book0 AS (
  SELECT part, entry - 1 AS entry, v FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS entry FROM kept) USING (vec_id) WHERE entry <= 64),{_op12_round(0)}{_op12_round(1)}
final AS (
  SELECT vec_id, part, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist
  FROM (SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist FROM parts p JOIN book2 b ON p.part = b.part)
  GROUP BY vec_id, part),
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM final GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), books
"""


def op13_repair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair.repair(repair.damaged(_texts(spark, sf_dir, "conversations")))
    return found.withColumnRenamed("key", "conv_id")


#: Keys of the four states (nothing yet, system, user, assistant) are cost and audit as one text, so the least text is the cheapest
#: edit and, of equals, the ASCII-least; `add` is what a step appends.
OP13_SQL = r"""
WITH RECURSIVE faults AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_concat(flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
             lambda c: list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda b: ((ord(c) >> b) & 1)::BIGINT))))),
             lambda x, b: xor(x >> 1, CASE WHEN (x & 1) <> b THEN 3988292384 ELSE 0 END)), 4294967295) % 20 AS f
  FROM conversations),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM faults, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(copy)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows_),
judged AS (
  SELECT *, rtrim(text, E' 	

') AS core, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS repeated, substr(role, 1, 1) AS initial,
         substr(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1, 1) AS before FROM placed),
marked AS (
  SELECT *, CASE WHEN core = '' THEN 'b' WHEN repeated THEN 'd' WHEN right(core, 1) IN ('.', '!', '?') THEN '.' ELSE 't' END AS fault FROM judged),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'b')::BIGINT AS blank,
         count(*) FILTER (WHERE fault = 'd')::BIGINT AS duplicate, count(*) FILTER (WHERE fault = 't')::BIGINT AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au') OR before = '')::BIGINT AS illegal
  FROM marked GROUP BY conv_id),
walk AS (
  SELECT conv_id, n, 0::BIGINT AS i, '00000000' AS k0, NULL::VARCHAR AS k1, '00000002I' AS k2, '00000004II' AS k3 FROM counted
  UNION ALL
  SELECT conv_id, n, i, k0, k1, least(u, printf('%08d', substr(a, 1, 8)::INT + 2) || substr(a, 9) || 'I') AS k2,
         least(a, printf('%08d', substr(u, 1, 8)::INT + 2) || substr(u, 9) || 'I') AS k3
  FROM (
    SELECT conv_id, n, i, k0, k1, least(u, printf('%08d', substr(k0, 1, 8)::INT + 2) || substr(k0, 9) || 'I', printf('%08d', substr(k1, 1, 8)::INT + 2) || substr(k1, 9) || 'I') AS u, coalesce(a, '99999990') AS a
    FROM (
      SELECT w.conv_id, w.n, m.i, printf('%08d', substr(k0, 1, 8)::INT + 3) || substr(k0, 9) || 'D' AS k0,
             least(printf('%08d', substr(k1, 1, 8)::INT + 3) || substr(k1, 9) || 'D', CASE WHEN stays AND initial = 's' THEN printf('%08d', substr(k0, 1, 8)::INT + t) || substr(k0, 9) || 'K' END) AS k1,
             least(printf('%08d', substr(k2, 1, 8)::INT + 3) || substr(k2, 9) || 'D',
                   CASE WHEN stays THEN least(printf('%08d', substr(k0, 1, 8)::INT + to_u) || substr(k0, 9) || eu, printf('%08d', substr(k1, 1, 8)::INT + to_u) || substr(k1, 9) || eu, printf('%08d', substr(k3, 1, 8)::INT + to_u) || substr(k3, 9) || eu) END) AS u,
             least(printf('%08d', substr(k3, 1, 8)::INT + 3) || substr(k3, 9) || 'D', CASE WHEN stays THEN printf('%08d', substr(k2, 1, 8)::INT + to_a) || substr(k2, 9) || ea END) AS a
      FROM walk w JOIN (
        SELECT conv_id, i, initial, fault IN ('.', 't') AS stays, (fault = 't')::INT AS t, (fault = 't')::INT + CASE WHEN initial = 'u' THEN 0 ELSE 2 END AS to_u, CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END AS eu,
               (fault = 't')::INT + CASE WHEN initial = 'a' THEN 0 ELSE 2 END AS to_a, CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END AS ea FROM marked) m
        ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1))),
best AS (SELECT conv_id, substr(least(k0, k3), 1, 8)::BIGINT AS cost, substr(least(k0, k3), 9) AS audit FROM walk WHERE i = n),
letters AS (
  SELECT conv_id, p, substr(audit, p::INT, 1) AS edit, length(regexp_replace(substr(audit, 1, p::INT), 'I', '', 'g')) AS i, length(regexp_replace(substr(audit, 1, p::INT), 'D', '', 'g')) AS e
  FROM best, unnest(range(1, length(audit) + 1)) AS t(p)),
opened AS (
  SELECT l.*, m.role, m.text, max(CASE WHEN edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS has_system
  FROM letters l LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.i = l.i AND l.edit <> 'I' WHERE edit <> 'D'),
shown AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (e - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS repaired
  FROM opened GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN shown s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
"""


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_extract_html": op4_extract_html,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_preference_format": op7_preference_format,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_flac_media": op9_flac_media,
    "op10_quality": op10_quality,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_vector_codes": op12_vector_codes,
    "op13_repair_turns": op13_repair_turns,
}

ORACLES: dict[str, str] = {
    "op1_decontaminate": OP1_SQL,
    "op3_mix_sources": OP3_SQL,
    "op7_preference_format": OP7_SQL,
    "op8_jaccard_join": OP8_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_repair_turns": OP13_SQL,
}
