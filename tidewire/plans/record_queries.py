"""Queries over contexts, whole messages, records of publication and errors, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import analysis, matching, ops, publication
from tidewire.plans import tables as t
from tidewire.plans.ops_queries import NOW, _NAMES, modulo
from tidewire.plans.signal_queries import MATCH_SQL, _matched, lit
from tidewire.sources import registry

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def pick(n: str, values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + f"][1 + {n} % {len(values)}]"


# --- analysis ------------------------------------------------------------------------------------------------------

KEYS = ("release_date", "Version", "ver2", "GA", "preview_url", "price", "v3", "availability", "stage")
_rank = "CASE WHEN regexp_matches(lower(k), 'date|when|released|published|avail') THEN 0 WHEN regexp_matches(lower(k), 'version|ver|v[0-9]') THEN 1 WHEN regexp_matches(lower(k), 'disponib|availability|ga|preview') THEN 2 ELSE 3 END"


@query(f"SELECT event_id, {_rank} AS priority FROM (SELECT event_id, {pick('event_id', KEYS)} AS k FROM events)")
def q_fact_priority(spark, d):
    return t.events(spark, d).select("event_id", analysis.fact_priority(modulo("event_id", *KEYS)).alias("priority"))


_ROOMS = [2000 >> i for i in range(11)]
_with = lambda r: f"CASE WHEN room_{r} > 0 THEN room_{r} + {len(analysis.FACTS_HEADING) + 3} ELSE 0 END"
CONTEXT_SQL = f"""WITH art AS (
  SELECT doc_id % 40 AS folder_id, doc_id, CASE WHEN doc_id // 40 % 4 = 0 THEN 'primary' ELSE 'enrichment' END AS role, split_part(text, chr(10), 1) AS title, least(length(trim(text)), 3000) AS chars FROM documents),
cut AS (SELECT *, length('articleId=' || doc_id || chr(10) || 'role=' || role || chr(10) || 'tier=S' || chr(10) || 'title=' || title || chr(10) || 'url=u' || doc_id) AS head, CASE WHEN chars > 0 THEN chars + 7 ELSE 0 END AS extra FROM art),
old AS (SELECT *, coalesce(sum(CASE WHEN role = 'enrichment' THEN extra ELSE 0 END) OVER w, 0) AS before, role = 'primary' AND coalesce(sum(CASE WHEN role = 'primary' THEN 1 ELSE 0 END) OVER w, 0) = 0 AS is_first
  FROM cut WINDOW w AS (PARTITION BY folder_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fact AS (SELECT l_orderkey % 40 AS folder_id, l_orderkey * 10 + l_linenumber AS seq, {pick('l_partkey', KEYS)} AS k, '' || l_linenumber AS v FROM lineitem),
ends AS (SELECT folder_id, sum(length(k || '=' || v) + 1) OVER (PARTITION BY folder_id ORDER BY {_rank}, lower(k), k, seq ROWS UNBOUNDED PRECEDING) - 1 AS e FROM fact),
rooms AS (SELECT folder_id, {", ".join(f"coalesce(max(e) FILTER (e <= {r}), 0) AS room_{r}" for r in _ROOMS)} FROM ends GROUP BY 1),
base AS (SELECT o.folder_id, sum(head + extra) + 2 * (count(*) - 1) + length('folderId=' || o.folder_id) + length('folderTitle=F' || o.folder_id) + 15 AS bare, coalesce(sum(extra) FILTER (is_first), 0) AS main FROM old o GROUP BY o.folder_id),
b2 AS (SELECT b.*, {", ".join(f"coalesce(room_{r}, 0) AS room_{r}" for r in _ROOMS)} FROM base b LEFT JOIN rooms r ON r.folder_id = b.folder_id),
b3 AS (SELECT *, bare + {_with(2000)} - 12000 AS excess FROM b2),
gone AS (SELECT o.*, role = 'enrichment' AND before < excess AS gone FROM old o JOIN b3 ON b3.folder_id = o.folder_id),
b4 AS (SELECT b3.*, bare - coalesce(s, 0) AS l1 FROM b3 LEFT JOIN (SELECT folder_id, sum(extra) FILTER (gone) AS s FROM gone GROUP BY 1) g ON g.folder_id = b3.folder_id),
b5 AS (SELECT *, l1 + {_with(2000)} > 12000 AS no_main, CASE WHEN l1 + {_with(2000)} > 12000 THEN l1 - main ELSE l1 END AS l2 FROM b4),
ctx AS (SELECT folder_id, no_main, coalesce({", ".join(f"CASE WHEN l2 + {_with(r)} <= 12000 THEN {r} END" for r in _ROOMS)}, 0)::BIGINT AS fact_chars, (l2 + coalesce({", ".join(f"CASE WHEN l2 + {_with(r)} <= 12000 THEN {_with(r)} END" for r in _ROOMS)}, 0))::BIGINT AS chars FROM b5)"""


def _context(spark, d):
    docs = t.read(spark, d, "documents")
    folder = (F.col("doc_id") % 40).alias("folder_id")
    folders = docs.select(folder).distinct().withColumn("title", F.concat(F.lit("F"), F.col("folder_id").cast("string")))
    role = F.when(F.floor(F.col("doc_id") / 40) % 4 == 0, "primary").otherwise("enrichment")
    articles = docs.select(folder, F.col("doc_id").alias("article_id"), role.alias("role"), F.lit("S").alias("source_tier"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("content"), F.col("doc_id").alias("attached_at"))
    facts = t.read(spark, d, "lineitem").select((F.col("l_orderkey") % 40).alias("folder_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), modulo("l_partkey", *KEYS).alias("key"), F.col("l_linenumber").cast("string").alias("value"))
    return analysis.context(folders, articles, facts)


@query(f"{CONTEXT_SQL} SELECT folder_id, chars, fact_chars, CASE WHEN chars <= 12000 THEN 'ok' ELSE 'context_too_large' END AS verdict FROM ctx")
def q_context_verdict(spark, d):
    return _context(spark, d)[0]


@query(f"{CONTEXT_SQL} SELECT g.folder_id, doc_id AS article_id, g.chars::BIGINT AS chars, NOT (gone OR (is_first AND no_main)) AS kept FROM gone g JOIN ctx ON ctx.folder_id = g.folder_id")
def q_context_bodies(spark, d):
    return _context(spark, d)[1]


@query("SELECT event_id, 'OpenAI|' || upper(event_type) AS names, true AS repeated FROM events")
def q_entity_dedupe(spark, d):
    names, repeated = analysis.distinct_names(F.array(F.lit(" OpenAI"), F.lit("openai "), F.upper("event_type"), F.col("event_type"), F.lit(" ")))
    return t.events(spark, d).select("event_id", F.array_join(names, "|").alias("names"), repeated.alias("repeated"))


_FACTS = ['{"facts":[{"key":"Version","value":"v1"},"date: d1","bad",{"key":" ","value":"x"},{"key":"n","value":1}]}', "[]", "no json", '{"facts":["version: V1","price:9",": x"]}', '{"facts":[{"key":"stage","value":"beta","more":1}]}']
_found = "CASE event_id % 5 WHEN 0 THEN [{'k': 'Version', 'v': 'v1'}, {'k': 'date', 'v': 'd1'}] WHEN 3 THEN [{'k': 'version', 'v': 'V1'}, {'k': 'price', 'v': '9'}] WHEN 4 THEN [{'k': 'stage', 'v': 'beta'}] ELSE [] END"
_members_sql = f"m AS (SELECT user_id AS folder_id, event_id, unnest({_found}) AS f, generate_subscripts({_found}, 1) AS pos FROM events WHERE event_id % 3 <> 0)"


def _members(spark, d):
    return t.events(spark, d).select(F.col("user_id").alias("folder_id"), F.col("event_id").alias("article_id"), F.when(F.col("event_id") % 3 == 0, "primary").otherwise("enrichment").alias("role"), F.col("event_id").alias("attached_at"), modulo("event_id", *_FACTS).alias("facts"))


@query(f"WITH {_members_sql}, o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY folder_id, lower(f.k), lower(f.v) ORDER BY event_id, pos) = 1) SELECT folder_id, row_number() OVER (PARTITION BY folder_id ORDER BY event_id, pos) AS seq, f.k AS key, f.v AS value FROM o")
def q_folder_facts(spark, d):
    return analysis.folder_facts(_members(spark, d)).select("folder_id", "seq", "key", "value")


@query(f"WITH {_members_sql}, l AS (SELECT user_id AS folder_id, max(event_id) AS last FROM events GROUP BY 1) SELECT DISTINCT m.folder_id, lower(f.k) AS key FROM m JOIN l ON l.folder_id = m.folder_id WHERE event_id <> last")
def q_previous_keys(spark, d):
    m = _members(spark, d)
    return analysis.previous_keys(m, m.groupBy("folder_id").agg(F.max("article_id").alias("article_id")))


_RULES = [*analysis.RULE_KINDS, "not_major_announcement"]
_m = "CASE t WHEN 'S' THEN 1.1 WHEN 'A' THEN 1.05 WHEN 'B' THEN 1 WHEN 'C' THEN 0.95 WHEN 'D' THEN 0.9 ELSE 0.85 END"


@query(f"""WITH x AS (SELECT event_id, {pick('event_id', _RULES)} AS r, {pick('event_id', 'SABCDE')} AS t FROM events),
y AS (SELECT *, floor(least(floor(90 * {_m}), 100) * 0.4 + least(floor(88 * {_m}), 100) * 0.4 + 85 * 0.2 + 0.5)::BIGINT AS c FROM x WHERE r <> 'not_major_announcement')
SELECT event_id, 'Annonce officielle majeure détectée (mode dégradé, règle ' || r || ') : T' || event_id AS summary, CASE r WHEN 'major_model_announcement' THEN 'model_release' WHEN 'open_weight_release' THEN 'open_source' ELSE 'product_update' END AS category,
CASE WHEN r = 'open_weight_release' THEN 'availability' ELSE 'launch' END AS nature, c AS composite, CASE WHEN c >= 85 THEN 'annonces_majeures' ELSE 'veille_pertinente' END AS channel, 'Deterministic fallback matched rule ' || r || ' on official source (tier ' || t || ').' AS rationale FROM y""")
def q_fallback_proposal(spark, d):
    made = analysis.fallback_proposal(modulo("event_id", *_RULES), F.concat(F.lit("T"), F.col("event_id").cast("string")), modulo("event_id", *"SABCDE"))
    return t.events(spark, d).select("event_id", made.alias("p")).filter("p is not null").select("event_id", "p.*")


_CODES = ["server_unreachable", "timeout", "empty_response", "schema_validation", "model_mismatch", "lease_or_queue_timeout", "context_too_large", "strange"]


@query(f"SELECT event_id, CASE {pick('event_id', _CODES)} WHEN 'server_unreachable' THEN 'ollama_unavailable' WHEN 'timeout' THEN 'inference_timeout' WHEN 'empty_response' THEN 'invalid_json' WHEN 'schema_validation' THEN 'schema_violation' WHEN 'lease_or_queue_timeout' THEN 'queue_timeout' WHEN 'strange' THEN 'analysis_failed' ELSE {pick('event_id', _CODES)} END AS code FROM events")
def q_cycle_error(spark, d):
    return t.events(spark, d).select("event_id", analysis.cycle_error(modulo("event_id", *_CODES)).alias("code"))


_SEEN = ["ollama_unavailable", "inference_timeout", "queue_timeout", "invalid_json", "schema_violation", "empty_summary", "other"]
_SAID = ["Model not found", "empty body", "", "pull the thing"]


@query(f"""WITH x AS (SELECT event_id, {pick('event_id', _SEEN)} AS c, {pick('event_id', _SAID)} AS m, CASE WHEN event_id % 5 = 0 THEN 500 END AS s, CASE WHEN event_id % 11 = 0 THEN 'timeout' END AS g FROM events)
SELECT event_id, CASE WHEN m = 'Model not found' THEN 'model_absent' WHEN g = 'timeout' OR c = 'inference_timeout' THEN 'timeout' WHEN c = 'ollama_unavailable' THEN CASE WHEN s >= 400 THEN 'http_error' ELSE 'server_unreachable' END WHEN c = 'queue_timeout' THEN 'lease_or_queue_timeout'
  WHEN c = 'invalid_json' THEN CASE WHEN m = 'empty body' THEN 'empty_response' ELSE 'invalid_json' END WHEN c IN ('schema_violation', 'empty_summary') THEN 'schema_validation' ELSE c END AS code FROM x""")
def q_logged_error(spark, d):
    e = F.col("event_id")
    return t.events(spark, d).select("event_id", analysis.logged_error(modulo("event_id", *_SEEN), modulo("event_id", *_SAID), F.when(e % 5 == 0, 500), F.when(e % 11 == 0, "timeout")).alias("code"))


# --- messages ------------------------------------------------------------------------------------------------------


def _sources(spark, d):
    return t.read(spark, d, "pages").select((F.col("page_id") % 40).alias("folder_id"), F.col("page_id").alias("seq"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("name"), F.when(F.col("page_id") % 6 == 0, "not a url").otherwise(F.col("url")).alias("url"))


_SOURCES = _NAMES + """,
told AS (SELECT folder_id, string_agg(w, '|' ORDER BY seq) FILTER (w <> '') AS told FROM (SELECT folder_id, seq, concat_ws('|', CASE WHEN seq % 6 = 0 THEN 'url_invalid:not a url' END,
  CASE WHEN row_number() OVER (PARTITION BY folder_id, lower(name), coalesce(url, '') ORDER BY seq) > 1 THEN 'source_ignored:duplicate' END) AS w FROM n) GROUP BY 1),
q AS (SELECT folder_id, string_agg(CASE WHEN url IS NULL THEN name ELSE name || ' — ' || url END, chr(10) ORDER BY place) FILTER (place <= 5) AS s, max(place) > 5 AS more, arg_min(url, place) FILTER (url IS NOT NULL) AS first_url FROM p GROUP BY 1),
src AS (SELECT q.*, told FROM q LEFT JOIN told ON told.folder_id = q.folder_id)"""
_cut = lambda c, n: f"CASE WHEN length({c}) > {n} THEN left({c}, {n - 1}) || '…' ELSE {c} END"


@query(f"""WITH {_SOURCES}, f AS (SELECT c_custkey AS folder_id, trim(CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN repeat(c_name || ' ', 20) ELSE c_name END) AS ti, trim(CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN repeat(c_mktsegment || ' ', 600) ELSE c_mktsegment END) AS su, * FROM customer),
g AS (SELECT f.*, s, coalesce(more, false) AS more, first_url, told, CASE WHEN ti <> '' THEN ti WHEN su <> '' THEN su ELSE 'Veille IA' END AS whole, CASE WHEN su <> '' THEN su ELSE 'Résumé indisponible.' END AS body, 'Veille — ' || CASE WHEN ti <> '' THEN ti ELSE 'Veille IA' END AS th FROM f LEFT JOIN src ON src.folder_id = f.folder_id),
h AS (SELECT *, {_cut('whole', 256)} AS head FROM g)
SELECT folder_id, {_cut("concat_ws(' — ', head, first_url)", 2000)} AS content, head AS title, {_cut('body', 4096)} AS description, first_url AS url,
  concat_ws('|', 'Catégorie=' || c_mktsegment, 'Pertinence=' || c_nationkey || ' · high', 'Sources=' || {_cut('s', 1024)}, 'Date=' || CAST(DATE '1970-01-01' + CAST(c_custkey * 30 AS INTEGER) AS VARCHAR)) AS fields, 'dossier:' || right('' || c_custkey, 8) AS footer, {_cut('th', 100)} AS thread,
  concat_ws('|', CASE WHEN ti = '' AND su <> '' THEN 'empty_fallback:title_from_summary' END, CASE WHEN ti = '' AND su = '' THEN 'empty_fallback:title' END, CASE WHEN su = '' THEN 'empty_fallback:summary' END, CASE WHEN length(whole) > 256 THEN 'title_truncated' END, CASE WHEN length(body) > 4096 THEN 'summary_truncated' END, told,
    CASE WHEN length(concat_ws(' — ', head, first_url)) > 2000 THEN 'message_truncated' END, CASE WHEN more THEN 'source_ignored:capped_at_5' END, CASE WHEN length(s) > 1024 THEN 'field_value_truncated:Sources' END, CASE WHEN s IS NULL THEN 'field_omitted:Sources' END, CASE WHEN ti = '' THEN 'empty_fallback:thread_title' END, CASE WHEN length(th) > 100 THEN 'thread_name_truncated' END) AS warnings FROM h""")
def q_main_message(spark, d):
    n = F.col("c_custkey")
    title = F.when(n % 4 == 0, "").when(n % 4 == 1, F.repeat(F.concat("c_name", F.lit(" ")), F.lit(20))).otherwise(F.col("c_name"))
    summary = F.when(n % 3 == 0, "").when(n % 3 == 1, F.repeat(F.concat("c_mktsegment", F.lit(" ")), F.lit(600))).otherwise(F.col("c_mktsegment"))
    folders = t.read(spark, d, "customer").select(n.alias("folder_id"), title.alias("title"), summary.alias("summary"), F.col("c_mktsegment").alias("category"), F.lit("high").alias("worthiness"), F.col("c_nationkey").alias("composite"), (n * 30 * 86_400_000).alias("useful_date"))
    made = publication.main_payload(folders, _sources(spark, d))
    return made.withColumns({"fields": F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit("="), f["value"])), "|"), "warnings": F.array_join("warnings", "|")})


@query(f"""WITH {_SOURCES}, f AS (SELECT l_orderkey AS folder_id, string_agg('• ' || l_returnflag || ': ' || l_linestatus, chr(10) ORDER BY l_returnflag, l_linestatus) AS lines FROM lineitem GROUP BY 1),
g AS (SELECT o_orderkey AS folder_id, lines, s, coalesce(more, false) AS more, first_url, told, CASE WHEN o_orderkey % 2 = 0 THEN sha256('' || o_orderkey) END AS fp FROM orders LEFT JOIN f ON f.folder_id = o_orderkey LEFT JOIN src ON src.folder_id = o_orderkey)
SELECT folder_id, concat_ws(' — ', 'Mise à jour du dossier', first_url) AS content, coalesce(lines, 'Nouvelles sources.') AS description, coalesce('Nouvelles sources=' || {_cut('s', 1024)}, '') AS fields, concat_ws(' · ', 'dossier:' || right('' || folder_id, 8), left(fp, 8)) AS footer,
  concat_ws('|', told, CASE WHEN lines IS NULL THEN 'empty_fallback:enrichment_description' END, CASE WHEN more THEN 'source_ignored:capped_at_5' END, CASE WHEN length(s) > 1024 THEN 'field_value_truncated:Nouvelles sources' END) AS warnings FROM g WHERE lines IS NOT NULL OR s IS NOT NULL""")
def q_enrichment_message(spark, d):
    facts = t.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("folder_id"), F.col("l_returnflag").alias("key"), F.col("l_linestatus").alias("value"))
    folders = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("folder_id"), F.when(F.col("o_orderkey") % 2 == 0, F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("fingerprint"))
    made = publication.enrichment_payload(folders, facts, _sources(spark, d))
    return made.select("folder_id", "content", "description", F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit("="), f["value"])), "|").alias("fields"), "footer", F.array_join("warnings", "|").alias("warnings"))


# --- records -------------------------------------------------------------------------------------------------------

_STATES = ["pending", "main_published", "partial", "failed", "inconsistent"]
_state = pick("o_orderkey", _STATES)
_pub = f"pub AS (SELECT o_orderkey AS folder_id, {_state} AS st, o_orderkey % 3 <> 0 AS msg, o_orderkey % 7 <> 0 AS thr, o_orderkey % 2 = 0 AS chan, o_orderkey % 11 = 0 AS closed FROM orders), main AS (SELECT *, msg AND st IN ('partial', 'main_published', 'inconsistent') AS main FROM pub)"


def _publications(spark, d):
    n = F.col("o_orderkey")
    some = lambda cond: F.when(cond, n.cast("string"))
    return t.read(spark, d, "orders").select(n.alias("folder_id"), modulo("o_orderkey", *_STATES).alias("status"), some(n % 3 != 0).alias("main_message_id"), some(n % 7 != 0).alias("thread_id"), some(n % 2 == 0).alias("channel_id"))


def _folders(spark, d):
    return t.read(spark, d, "orders").select(F.col("o_orderkey").alias("folder_id"), F.when(F.col("o_orderkey") % 11 == 0, "closed").otherwise("open").alias("status"), F.col("o_orderpriority").alias("title"))


_DECISIONS = ["publish", "hold", "enrich_thread_only", "reject_editorial"]


@query(f"""WITH {_pub}, x AS (SELECT *, {pick('folder_id // 5', _DECISIONS)} AS decision FROM main)
SELECT folder_id, decision, CASE WHEN decision IN ('hold', 'reject_editorial') THEN 'skipped:' || decision WHEN closed THEN 'skipped:folder_closed' WHEN decision = 'publish' THEN CASE WHEN main THEN 'skipped:idempotent_hit' ELSE 'publish' END WHEN main AND thr THEN 'enrich' WHEN main THEN 'complete_thread' ELSE 'failed:precondition_failed' END AS step FROM x""")
def q_route(spark, d):
    kind = F.element_at(F.array(*(F.lit(x) for x in _DECISIONS)), (F.floor(F.col("folder_id") / 5) % 4 + 1).cast("int"))
    return publication.route(_folders(spark, d).select("folder_id", kind.alias("decision")), _folders(spark, d), _publications(spark, d))


@query(f"WITH {_pub} SELECT m.folder_id, CASE WHEN st = 'partial' AND msg AND chan THEN 'complete_thread' WHEN st = 'main_published' AND msg AND thr THEN 'skipped:idempotent_hit' ELSE 'failed:precondition_failed' END AS step, CASE WHEN st = 'partial' AND msg AND chan THEN 'Veille — ' || o_orderpriority END AS thread FROM main m JOIN orders ON o_orderkey = m.folder_id")
def q_resume(spark, d):
    return publication.resume(_folders(spark, d), _publications(spark, d))


@query(f"""WITH {_pub}, x AS (SELECT folder_id, st AS before, CASE WHEN folder_id % 4 = 0 THEN NULL ELSE 't' || folder_id END AS th, CASE WHEN folder_id % 4 = 0 THEN 'partial' ELSE 'main_published' END AS after FROM main),
y AS (SELECT *, CASE WHEN before <> after AND before || '>' || after NOT IN ('pending>main_published', 'pending>partial', 'partial>main_published') THEN 'forbidden_status_transition' END AS error FROM x)
SELECT folder_id, before, CASE WHEN error IS NULL THEN after ELSE before END AS status, error, CASE WHEN error IS NULL THEN 'm' || folder_id END AS message_id, CASE WHEN error IS NULL THEN th END AS thread_id FROM y""")
def q_record_main(spark, d):
    name = lambda p: F.concat(F.lit(p), F.col("folder_id").cast("string"))
    results = _folders(spark, d).select("folder_id", name("m").alias("message_id"), F.when(F.col("folder_id") % 4 != 0, name("t")).alias("thread_id"))
    return publication.record_main(results, _publications(spark, d))


@query(f"""WITH {_pub}, r AS (SELECT folder_id, ['enrich', 'create_thread', 'unarchive'][1 + folder_id % 3] AS kind, 'k' || folder_id AS key, folder_id % 5 <> 0 AS fp FROM main),
a AS (SELECT event_id % 500 AS k, event_id AS n, ['reserved', 'failed', 'succeeded', 'failed'][1 + event_id % 4] AS s FROM events),
top AS (SELECT k, max(n) AS last, arg_max(s, n) FILTER (s <> 'failed') AS act FROM a GROUP BY 1),
x AS (SELECT r.*, last, CASE WHEN kind = 'enrich' AND NOT fp THEN 'enrichment_precondition_failed' WHEN closed THEN 'folder_closed' WHEN kind <> 'unarchive' AND NOT main THEN 'enrichment_precondition_failed' WHEN act = 'succeeded' THEN 'already_succeeded' WHEN act = 'reserved' THEN 'already_reserved' ELSE 'reserved' END AS outcome
  FROM r JOIN main m ON m.folder_id = r.folder_id LEFT JOIN top ON top.k = r.folder_id)
SELECT folder_id, kind, key, outcome, CASE WHEN outcome = 'reserved' THEN coalesce(last, 0) + 1 END AS attempt_number FROM x""")
def q_reserve_operation(spark, d):
    key = lambda c: F.concat(F.lit("k"), c.cast("string"))
    requests = _folders(spark, d).select("folder_id", modulo("folder_id", "enrich", "create_thread", "unarchive").alias("kind"), key(F.col("folder_id")).alias("key"), F.when(F.col("folder_id") % 5 != 0, "fp").otherwise(" ").alias("fingerprint"))
    attempts = t.events(spark, d).select(key(F.col("event_id") % 500).alias("key"), F.col("event_id").alias("attempt_number"), modulo("event_id", "reserved", "failed", "succeeded", "failed").alias("status"))
    return publication.reserve_operation(requests, _folders(spark, d), _publications(spark, d), attempts)


_PORT = ["discord_rate_limited", "missing_permission", "discord_timeout"]


@query(f"""WITH x AS (SELECT event_id AS attempt_id, ['reserved', 'succeeded'][1 + event_id % 2] AS s, CASE WHEN event_id % 3 <> 0 THEN {pick('event_id', _PORT)} END AS c FROM events)
SELECT attempt_id, CASE WHEN c IS NOT NULL AND s = 'reserved' THEN 'failed' ELSE s END AS status, CASE WHEN s = 'reserved' THEN c END AS error_code, c IS NOT NULL AND s = 'reserved' AND c <> 'missing_permission' AS retryable, CASE WHEN s = 'reserved' AND c <> 'missing_permission' THEN {NOW} END AS next_attempt_at FROM x""")
def q_record_failure(spark, d):
    e = t.events(spark, d)
    failures = e.filter("event_id % 3 <> 0").select(F.col("event_id").alias("attempt_id"), modulo("event_id", *_PORT).alias("code"), F.lit(NOW).alias("next_attempt_at"))
    return publication.record_failure(failures, e.select(F.col("event_id").alias("attempt_id"), modulo("event_id", "reserved", "succeeded").alias("status")))


@query("SELECT o_orderkey AS folder_id, 'publish:' || o_orderkey AS publish, 'create_thread:' || o_orderkey || ':' || o_custkey AS create_thread, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'enrich:' || o_orderkey || ':' || o_orderpriority || ':1' END AS enrich, 'unarchive:' || o_orderkey || ':' || o_custkey AS unarchive FROM orders")
def q_idempotency_keys(spark, d):
    text = lambda c: F.col(c).cast("string")
    long = F.when(F.col("o_orderkey") % 2 == 0, F.repeat(F.lit("x"), F.lit(600))).otherwise(F.col("o_orderpriority"))
    made = publication.keys_of(text("o_orderkey"), text("o_custkey"), text("o_custkey"), long, F.lit("1"))
    return t.read(spark, d, "orders").select(F.col("o_orderkey").alias("folder_id"), *(c.alias(k) for k, c in made.items()))


_STORED = ["folder_closed", "folder_absent", "forbidden_status_transition", "strange"]


@query(f"SELECT event_id, ['folder_closed', 'precondition_failed', 'inconsistent_state', 'unknown'][1 + event_id % 4] AS code, event_id % 3 <> 1 AS passing FROM events")
def q_publication_errors(spark, d):
    return t.events(spark, d).select("event_id", publication.error_of(modulo("event_id", *_STORED)).alias("code"), publication.passing(modulo("event_id", *_PORT)).alias("passing"))


# --- matching, runs, sources ---------------------------------------------------------------------------------------


@query(f"WITH {MATCH_SQL} SELECT article_id, 'issue=' || issue || '; confidence=' || confidence || '; folder=' || coalesce(folder_id, 'none') || '; motives=' || replace(motives, '|', ',') || '; favorable=' || coalesce(nullif(replace(favorable, '|', ','), ''), 'none') || '; unfavorable=' || coalesce(nullif(replace(unfavorable, '|', ','), ''), 'none') AS justification FROM decided")
def q_match_justification(spark, d):
    return matching.justification(_matched(spark, d)).select("article_id", "justification")


@query(f"WITH {t.ARTICLES_SQL}, {t.FOLDERS_SQL} SELECT article_id, CASE WHEN article_id IN (SELECT article_id FROM members) THEN 'already_processed' ELSE 'terminal_state' END AS reason FROM art WHERE article_id IN (SELECT article_id FROM members) OR article_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)")
def q_match_skips(spark, d):
    decided = t.read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("article_id"))
    return matching.skipped(t.articles(spark, d), t.folders(spark, d)[1], decided).select("article_id", "reason")


_ISSUES = ["create_dossier", "attach_enrich", "duplicate_editorial", "ambiguous_no_action", "other"]
_cases = f"x AS (SELECT event_id AS article_id, {pick('event_id', _ISSUES)} AS issue, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 20 END AS folder_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'T' END AS title FROM events)"


def _cases_of(spark, d):
    e = F.col("event_id")
    return t.events(spark, d).select(e.alias("article_id"), modulo("event_id", *_ISSUES).alias("issue"), F.when(e % 4 != 0, e % 20).alias("folder_id"), F.when(e % 3 == 0, "").otherwise("T").alias("title"))


def _few_folders(spark):
    return spark.range(15).select(F.col("id").alias("folder_id"), F.when(F.col("id") % 5 == 1, "closed").when(F.col("id") % 2 == 0, "idle").otherwise("open").alias("status"), F.lit(1).cast("long").alias("last_activity"))


_folder_state = "CASE WHEN folder_id >= 15 THEN NULL WHEN folder_id % 5 = 1 THEN 'closed' WHEN folder_id % 2 = 0 THEN 'idle' ELSE 'open' END"


@query(f"""WITH {_cases}, y AS (SELECT article_id, issue, folder_id, CASE WHEN issue = 'create_dossier' AND title = '' THEN 'title_missing' WHEN issue IN ('attach_enrich', 'duplicate_editorial') AND folder_id IS NULL THEN 'folder_missing' WHEN issue = 'attach_enrich' AND folder_id >= 15 THEN 'folder_absent'
  WHEN issue = 'attach_enrich' AND folder_id % 5 = 1 THEN 'folder_closed' WHEN issue = 'other' THEN 'issue_unknown' END AS broken FROM x) SELECT * FROM y WHERE broken IS NOT NULL""")
def q_match_violations(spark, d):
    return matching.violations(_cases_of(spark, d), _few_folders(spark))


@query(f"""WITH {_cases}, a AS (SELECT DISTINCT folder_id FROM x WHERE issue = 'attach_enrich' AND folder_id IS NOT NULL), f AS (SELECT range AS folder_id FROM range(15)), g AS (SELECT folder_id, {_folder_state} AS status, folder_id IN (SELECT folder_id FROM a) AS hit FROM f)
SELECT folder_id, CASE WHEN hit AND status = 'idle' THEN 'open' ELSE status END AS status, CASE WHEN hit AND status <> 'closed' THEN {NOW} ELSE 1 END AS last_activity FROM g""")
def q_attach_effects(spark, d):
    return matching.attach_effects(_cases_of(spark, d), _few_folders(spark), NOW)


_SUMMARIES = ['{"errorCodes":["timeout",5,"http_error"]}', "{}", "no json", '{"errorCodes":"timeout"}']


@query("SELECT event_id AS run_id, CASE WHEN event_id % 4 = 0 THEN 'timeout|http_error' WHEN event_id % 3 = 0 THEN 'run_error_message' ELSE '' END AS codes FROM events")
def q_run_error_codes(spark, d):
    runs = t.events(spark, d).select(F.col("event_id").alias("run_id"), modulo("event_id", *_SUMMARIES).alias("summary"), F.when(F.col("event_id") % 3 == 0, "it failed").otherwise(" ").alias("error_message"))
    return ops.run_error_codes(runs).select("run_id", F.array_join("codes", "|").alias("codes"))


@query(f"WITH {t.EVENTS_SQL} SELECT user_id AS source_id, max(tms) + 60000 AS next_eligible_at FROM ev GROUP BY 1 HAVING max(tms) + 60000 > {NOW}")
def q_sources_in_backoff(spark, d):
    state = t.events(spark, d).groupBy(F.col("user_id").alias("source_id")).agg((F.max("at") + 60_000).alias("next_eligible_at"))
    return ops.in_backoff(state, NOW)


@query("SELECT event_id AS seq, c_custkey, c_name FROM events JOIN customer ON c_custkey = event_id * 7 % 400")
def q_ordered_lookup(spark, d):
    wanted = t.events(spark, d).select(F.col("event_id").alias("seq"), (F.col("event_id") * 7 % 400).alias("c_custkey"))
    return ops.lookup(wanted, t.read(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")


# Known answers, as text: public addresses, and those that are private, reserved or none.
_ADDRESSES = {"2606:4700::1111": False, "::1": True, "::": True, "fe80::1": True, "febf::1": True, "fec0::1": False, "fd00::1": True, "ff02::1": True, "::ffff:10.0.0.1": True, "::ffff:8.8.8.8": False, "2001:db8:0:0:0:0:0:1": False, "1::2::3": True, "12345::": True, "2001:4860:4860::8888": False, "1:2:3:4:5:6:7": True, "g::1": True}


@query("SELECT event_id, [" + ", ".join(str(v).lower() for v in _ADDRESSES.values()) + f"][1 + event_id % {len(_ADDRESSES)}] AS blocked FROM events")
def q_blocked_ipv6(spark, d):
    return t.events(spark, d).select("event_id", registry.blocked_address(modulo("event_id", *_ADDRESSES)).alias("blocked"))
