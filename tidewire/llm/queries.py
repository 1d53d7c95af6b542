"""The corpus operators applied to their whole tables; each function takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import alignment, bloom_lm, chat, collocations, cube, importance, itq, jaccard, langid, media, pii, spm, warc
from tidewire.llm.common import table


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(*chat.tool_turns(table(spark, sf_dir, "conversations")), chat.TOOLS)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op3_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.mix(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score_documents(table(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), width=3, num=9, den=10)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_documents(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.tensors(media.store(table(spark, sf_dir, "documents")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).drop("url", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_pii": op2_pii,
    "op3_importance": op3_importance,
    "op4_mixing": op4_mixing,
    "op5_language": op5_language,
    "op6_bloom_lm": op6_bloom_lm,
    "op7_embeddings": op7_embeddings,
    "op8_jaccard": op8_jaccard,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_media": op10_media,
    "op11_alignment": op11_alignment,
    "op12_collocations": op12_collocations,
    "op13_warc": op13_warc,
}
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES: dict[str, str] = {
    "op1_chat": """
WITH RECURSIVE asked AS (
  SELECT conv_id, turn, min(text) AS text, count(*) AS n_calls FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
calls AS (
  SELECT *, conv_id || ':' || turn AS call_id, (conv_id + turn // 2) % 4 AS pick, conv_id % 6 AS kind, count(*) OVER (PARTITION BY conv_id) AS size FROM asked),
depends AS (
  SELECT conv_id, turn, unnest(CASE WHEN kind = 3 OR (kind = 5 AND turn = 0) THEN [turn + 2] WHEN kind = 4 AND turn % 6 = 4 THEN [turn - 2, turn - 4] WHEN turn >= 2 THEN [turn - 2] ELSE [] END) AS on_turn FROM calls),
known AS (SELECT d.* FROM depends d JOIN calls c ON c.conv_id = d.conv_id AND c.turn = d.on_turn),
lost AS (
  SELECT conv_id, turn, string_agg('depends_on: no ' || conv_id || ':' || on_turn, '; ' ORDER BY conv_id || ':' || on_turn) AS missing
  FROM depends d WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = d.conv_id AND c.turn = d.on_turn) GROUP BY ALL),
walk(conv_id, turn, size, at_turn, steps) AS (
  SELECT conv_id, turn, size, turn, 0::BIGINT FROM calls
  UNION SELECT w.conv_id, w.turn, w.size, k.on_turn, w.steps + 1 FROM walk w JOIN known k ON k.conv_id = w.conv_id AND k.turn = w.at_turn WHERE w.steps < w.size),
placed AS (
  SELECT conv_id, turn, CASE WHEN max(steps) >= any_value(size) THEN turn ELSE max(at_turn) END AS place, CASE WHEN max(steps) >= any_value(size) THEN -1 ELSE max(steps) END AS level FROM walk GROUP BY conv_id, turn),
checked AS (
  SELECT c.*, place, level, missing, ['reply', 'search', 'rate', 'translate'][1 + pick] AS tool,
    CASE pick WHEN 0 THEN CASE WHEN text IS NULL THEN 'prompt: missing' END
      WHEN 1 THEN nullif(concat_ws('; ', CASE WHEN c.conv_id % 5 = 0 THEN 'limit: not integer' END, CASE WHEN text IS NULL THEN 'query: missing' END), '')
      WHEN 2 THEN CASE WHEN c.turn % 8 = 6 THEN 'value: not number' WHEN c.conv_id % 3 = 0 THEN 'mood: unknown' END
      ELSE CASE WHEN c.conv_id % 2 = 0 THEN 'tool: unknown' ELSE 'arguments: no JSON' END END AS wrong,
    CASE pick WHEN 0 THEN '{' || concat_ws(',', '"prompt":' || CAST(to_json(text) AS VARCHAR), '"turn":' || c.turn) || '}'
      WHEN 1 THEN '{' || concat_ws(',', '"limit":' || CASE WHEN c.conv_id % 5 = 0 THEN '"' || c.turn || '"' ELSE '' || c.turn END, '"query":' || CAST(to_json(text) AS VARCHAR)) || '}'
      WHEN 2 THEN CASE WHEN c.turn % 8 = 6 THEN '{"tags":["a","b"],"value":"' || c.turn || '"}' WHEN c.conv_id % 3 = 0 THEN '{"mood":"x","tags":["a","b"],"value":' || c.turn || '}' ELSE '{"tags":["a","b"],"value":' || c.turn || '}' END
      ELSE CASE WHEN c.conv_id % 2 = 0 THEN '{' || coalesce('"text":' || CAST(to_json(text) AS VARCHAR), '') || '}' ELSE '"as above"' END END AS arguments
  FROM calls c JOIN placed p ON p.conv_id = c.conv_id AND p.turn = c.turn LEFT JOIN lost l ON l.conv_id = c.conv_id AND l.turn = c.turn),
results AS (
  SELECT conv_id, turn AS result_turn, conv_id || ':' || (turn - 1) AS call_id, min(text) AS content, count(*) AS n_results
  FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn AS turn,
  coalesce(place, r.result_turn) AS place, coalesce(level, 0) AS level,
  CASE WHEN c.n_calls IS NULL THEN 'orphan' WHEN n_results IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  coalesce(c.n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results, concat_ws('; ', wrong, missing) AS errors,
  '{' || concat_ws(',', '"arguments":' || arguments, '"call_id":' || CAST(to_json(coalesce(c.call_id, r.call_id)) AS VARCHAR),
    '"result":' || CAST(to_json(content) AS VARCHAR), '"tool":"' || tool || '"') || '}' AS message
FROM checked c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id""",
    "op8_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(y) FROM reach WHERE x = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op12_collocations": f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
sized AS (SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])))) AS g FROM pieces),
f AS (SELECT lang, g, count(*) AS n FROM sized GROUP BY ALL),
total AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
cand AS (SELECT lang, g, n AS a FROM f WHERE len(g) >= 2 AND n >= 100),
inner_ AS (SELECT DISTINCT lang, unnest(flatten(list_transform(range(2, len(g)), lambda k: list_transform(range(1, len(g) - k + 2), lambda i: g[i : i + k - 1])))) AS g, a FROM cand),
kept AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = c.lang AND i.g = c.g AND 100 * i.a >= 100 * c.a)),
cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM kept),
scored AS (
  SELECT c.lang, c.g, c.a, c.k, x.n AS l, y.n AS r, t.n AS n, 1000::HUGEINT * c.a * t.n // (x.n::HUGEINT * y.n) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1 : len(c.g)] JOIN total t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
    "op13_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT page_id, payload, h, strlen(payload) AS n, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, 1 + 5 * (i // 4), 5))::INT // [32768, 1024, 32, 1][1 + i % 4]) % 32, 1)), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f""",
}
