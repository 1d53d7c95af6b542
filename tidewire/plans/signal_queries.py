"""Queries over text, URLs, signals and matching, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import signals as S
from tidewire.functions import text as T
from tidewire.functions import urls as U
from tidewire.operators import matching
from tidewire.plans import tables as t
from tidewire.storage import materialize

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9.+-]+', ' ', 'g'))"


def squash(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def has(x: str, p: str) -> str:
    return f"regexp_matches({x}, {lit('(?i)' + p)})"


def got(x: str, p: str, i: int) -> str:
    return f"regexp_extract({x}, {lit('(?i)' + p)}, {i})"


STRIPPED = r"regexp_replace(regexp_replace(html, '<!--[\s\S]*?-->', ' ', 'g'), '</?[a-zA-Z][^>]*>', ' ', 'g')"
# Named entities without double decoding: a placeholder for the ampersand comes back last.
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " ")):
    STRIPPED = f"regexp_replace({STRIPPED}, '(?i)&{_name};', '{_char}', 'g')"
STRIPPED = f"replace(regexp_replace(regexp_replace({STRIPPED}, '(?i)&amp;', chr(1), 'g'), '&[a-zA-Z]+;', '', 'g'), chr(1), '&')"
CLEAN = rf"trim(regexp_replace({STRIPPED}, '\s+', ' ', 'g'))"
_host = r"regexp_extract(url, '^(https?://[^/?#]+)', 1)"
_path = r"CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END"
_bare = f"(CASE WHEN length({_path}) > 1 THEN regexp_replace({_path}, '/$', '') ELSE {_path} END)"
_query = r"regexp_extract(url, '(\?[^#]*)', 1)"
_kept = f"list_sort(list_filter(string_split(substr({_query}, 2), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^({'|'.join(U.TRACKING)})$|^({'|'.join(U.TRACKING_PREFIXES)})')))"
_editorial = f"{_host} || CASE WHEN len({_kept}) = 0 THEN {_bare} ELSE ({_path}) || '?' || array_to_string({_kept}, '&') END"


@query(f"SELECT doc_id, {norm('text')} AS token FROM documents")
def q_normalize_token(spark, d):
    return t.read(spark, d, "documents").select("doc_id", T.normalize_token(F.col("text")).alias("token"))


@query(f"SELECT doc_id, {squash('text')} AS collapsed FROM documents")
def q_collapse(spark, d):
    return t.read(spark, d, "documents").select("doc_id", T.collapse(F.col("text")).alias("collapsed"))


@query(f"SELECT page_id, {_host} || {_bare} || {_query} AS url FROM pages")
def q_url_matching(spark, d):
    return t.read(spark, d, "pages").select("page_id", U.matching_url(F.col("url")).alias("url"))


@query(f"SELECT page_id, {_host} || ({_path}) || {_query} AS url FROM pages")
def q_url_article(spark, d):
    return t.read(spark, d, "pages").select("page_id", U.article_url(F.col("url")).alias("url"))


@query(f"SELECT page_id, CASE WHEN url NOT LIKE '%#%' THEN {_host} || {_bare} || {_query} END AS url FROM pages")
def q_url_source(spark, d):
    return t.read(spark, d, "pages").select("page_id", U.source_url(F.col("url")).alias("url"))


@query(rf"SELECT page_id, {_host} || ({_path}) || {_query} || regexp_extract(url, '(#.*)', 1) AS url FROM pages")
def q_url_accept(spark, d):
    return t.read(spark, d, "pages").select("page_id", U.accepted_url(F.col("url")).alias("url"))


@query(f"SELECT page_id, {_editorial} AS url FROM pages")
def q_url_editorial(spark, d):
    return t.read(spark, d, "pages").select("page_id", U.editorial_url(F.col("url")).alias("url"))


@query(f"SELECT {_editorial} AS url, count(*) AS pages, count(DISTINCT {_host} || {_bare} || {_query}) AS forms FROM pages GROUP BY 1")
def q_url_dup_groups(spark, d):
    return t.read(spark, d, "pages").groupBy(U.editorial_url(F.col("url")).alias("url")).agg(F.count("*").alias("pages"), F.countDistinct(U.matching_url(F.col("url"))).alias("forms"))


@query(f"SELECT page_id, {STRIPPED} AS plain FROM pages")
def q_strip_html(spark, d):
    return t.read(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("plain"))


@query(f"SELECT page_id, {CLEAN} AS clean, CASE WHEN length({CLEAN}) > 256 THEN left({CLEAN}, 255) || '…' ELSE {CLEAN} END AS title FROM pages")
def q_sanitize(spark, d):
    clean = T.sanitize(F.col("html"))
    return t.read(spark, d, "pages").select("page_id", clean.alias("clean"), T.truncate(clean, 256).alias("title"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 99) || '…' ELSE text END AS short FROM documents")
def q_truncate(spark, d):
    return t.read(spark, d, "documents").select("doc_id", T.truncate(F.col("text"), 100).alias("short"))


_redacted = squash("text || ' Bearer abc.' || conv_id || ' key sk-' || turn || 'x DATABASE_URL= postgres://u:p@h/' || conv_id")
for _p in (r"(?i)postgres(?:ql)?://\S+", r"(?i)Bearer\s+\S+", r"(?i)DISCORD_TOKEN\s*=\s*\S+", r"(?i)DATABASE_URL\s*=\s*\S+", "sk-[A-Za-z0-9_-]+"):
    _redacted = f"regexp_replace({_redacted}, {lit(_p)}, '[redacted]', 'g')"


@query(f"SELECT conv_id, turn, CASE WHEN length(r) > 240 THEN left(r, 239) || '…' ELSE r END AS message FROM (SELECT conv_id, turn, {_redacted} AS r FROM conversations)")
def q_redact(spark, d):
    n = lambda c: F.col(c).cast("string")
    raw = F.concat("text", F.lit(" Bearer abc."), n("conv_id"), F.lit(" key sk-"), n("turn"), F.lit("x DATABASE_URL= postgres://u:p@h/"), n("conv_id"))
    return t.read(spark, d, "conversations").select("conv_id", "turn", T.redact(raw).alias("message"))


# --- signals -------------------------------------------------------------------------------------------------------

_nature = "CASE " + " ".join(f"WHEN {has('txt', p)} THEN '{n}'" for n, p in S.NATURES.items()) + " ELSE 'other' END"
_version = f"coalesce(nullif({norm(got('txt', S.NAMED_VERSION, 1))}, ''), nullif({norm(got('txt', S.PLAIN_VERSION, 1))}, ''))"
_product = "CASE " + " ".join(f"WHEN contains(plain, '{o}') THEN '{o}'" for o in S.ORGS) + " END"
_stop = ", ".join(lit(s) for s in S.STOP)
_entities = f"list_sort(list_distinct(list_concat(list_filter([product, version], lambda x: x IS NOT NULL), list_filter(list_transform(regexp_extract_all(txt, {lit(S.PROPER)}), lambda x: {norm('x')}), lambda x: length(x) >= 2 AND x NOT IN ({_stop})))))"


def _fact(cond: str, key: str, value: str) -> str:
    return f"CASE WHEN {cond} THEN {{'key': {key}, 'value': {value}}} END"


_price = norm(got("txt", S.PRICE, 1) + " || " + got("txt", S.PRICE, 2))
_facts = "list_filter([" + ", ".join([
    _fact("version IS NOT NULL", "'version:' || version", "version"), _fact(has("txt", S.EVENT_DATE), f"'event_date:' || {norm(got('txt', S.EVENT_DATE, 2))}", norm(got("txt", S.EVENT_DATE, 2))),
    *(_fact(has("txt", p), f"'{k}'", f"'{v}'") for k, v, p in S.FLAGS), _fact(has("txt", S.REGION), f"'region:' || {norm(got('txt', S.REGION, 1))}", norm(got("txt", S.REGION, 1))),
    _fact(f"{_price} <> ''", f"'price:' || {_price}", _price), *(_fact(has("txt", p), f"'{k}'", f"'{v}'") for k, v, p in S.STATUSES),
    _fact("nature = 'denial'", "'correction:denial'", "'denial'"), _fact("nature = 'correction'", "'correction:erratum'", "'correction'"),
]) + "], lambda x: x IS NOT NULL)"
SIGNALS_SQL = t.ARTICLES_SQL + rf""",
s0 AS (SELECT *, regexp_replace(title || chr(10) || coalesce(summary, '') || chr(10) || coalesce(content, ''), '^\s+|\s+$', '', 'g') AS txt FROM art),
s1 AS (SELECT *, {norm('txt')} AS plain, {_nature} AS nature, {_version} AS version FROM s0),
s2 AS (SELECT *, {_product} AS product FROM s1),
s3 AS (SELECT *, {_entities} AS entities, {_facts} AS facts, list_sort(list_filter(list_transform(categories, lambda x: {norm('x')}), lambda x: x <> '')) AS labels,
  regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^(https://[^/:]+):443|^(http://[^/:]+):80', '\1\2'), '^(https?://[^/]+/[^?]*[^/?])/(\?|$)', '\1\2') AS canonical FROM s2),
sig AS (SELECT *, length({squash('txt')}) >= 12 AND (len(entities) > 0 OR product IS NOT NULL OR nature <> 'other' OR version IS NOT NULL) AS prim FROM s3)"""


def _signals(spark, d):
    return S.with_signals(t.articles(spark, d))


@query(f"WITH {SIGNALS_SQL} SELECT article_id, nature FROM sig")
def q_nature(spark, d):
    return _signals(spark, d).select("article_id", "nature")


@query(f"WITH {SIGNALS_SQL} SELECT article_id, version, product FROM sig")
def q_version_product(spark, d):
    return _signals(spark, d).select("article_id", "version", "product")


@query(f"WITH {SIGNALS_SQL} SELECT article_id, array_to_string(entities, '|') AS entities FROM sig")
def q_entities(spark, d):
    return _signals(spark, d).select("article_id", F.array_join("entities", "|").alias("entities"))


@query(f"WITH {SIGNALS_SQL} SELECT article_id, array_to_string(list_transform(facts, lambda x: x.key || '=' || x.value), '|') AS facts FROM sig")
def q_facts(spark, d):
    return _signals(spark, d).select("article_id", F.array_join(F.transform("facts", lambda x: F.concat(x["key"], F.lit("="), x["value"])), "|").alias("facts"))


@query(f"""WITH {SIGNALS_SQL} SELECT article_id, canonical, array_to_string(labels, '|') AS labels, prim AS is_primary, CASE WHEN nature IN ('denial', 'correction') THEN 'correction'
  WHEN len(list_filter(facts, lambda x: starts_with(x.key, 'status:'))) > 0 THEN 'status_change' WHEN len(list_filter(facts, lambda x: starts_with(x.key, 'availability:'))) > 0 THEN 'availability'
  WHEN version IS NOT NULL THEN 'version' ELSE 'fact_update' END AS enrichment FROM sig""")
def q_fingerprint(spark, d):
    return _signals(spark, d).select("article_id", "canonical", F.array_join("labels", "|").alias("labels"), F.col("primary").alias("is_primary"), S.enrichment_type(F.col("nature"), F.col("facts.key")).alias("enrichment"))


# --- matching ------------------------------------------------------------------------------------------------------

MATCH_SQL = SIGNALS_SQL + ", " + t.FOLDERS_SQL + f""",
cand AS (SELECT * FROM folders WHERE status IN ('open', 'idle')),
own AS (SELECT m.folder_id, m.attached_at, s.* FROM members m JOIN sig s ON m.article_id = s.article_id),
fp AS (SELECT c.folder_id, c.status, coalesce(list_sort(list_distinct(flatten(list(o.entities)))), []) AS entities, coalesce(list_sort(list_distinct(flatten(list(o.labels)))), []) AS labels,
  coalesce(list_sort(list_distinct(list(o.canonical))), []) AS urls, coalesce(list_sort(list_distinct(flatten(list(list_transform(o.facts, lambda x: x.key))))), []) AS keys,
  first(o.product ORDER BY o.attached_at, o.article_id) FILTER (o.product IS NOT NULL) AS product, first(o.version ORDER BY o.attached_at, o.article_id) FILTER (o.version IS NOT NULL) AS version,
  first(o.nature ORDER BY o.attached_at, o.article_id) AS nature, first(o.source_tier ORDER BY o.attached_at, o.article_id) AS tier, first(o.published_at ORDER BY o.attached_at, o.article_id) AS date
  FROM cand c LEFT JOIN own o ON o.folder_id = c.folder_id GROUP BY ALL),
p0 AS (SELECT a.article_id, f.folder_id, coalesce(list_contains(f.urls, a.canonical), false) AS u, list_has_any(a.entities, f.entities) AS e, coalesce(a.product = f.product, false) AS p, coalesce(a.version = f.version, false) AS v,
  a.nature = f.nature AND a.nature <> 'other' AS n, list_has_any(a.labels, f.labels) AS c, coalesce(abs(a.published_at - f.date) <= 14 * 86400000, false) AS near,
  coalesce(strpos('EDCBAS', a.source_tier) > strpos('EDCBAS', f.tier), false) AS higher, coalesce(a.product <> f.product, false) AS bp,
  least(a.nature, f.nature) || '|' || greatest(a.nature, f.nature) IN ({", ".join(lit(x) for x in S.EXCLUSIVE)}) AS bn, coalesce(a.version <> f.version, false) AS bv,
  len(a.entities) > 0 AND len(f.entities) > 0 AND (a.product IS NOT NULL OR f.product IS NOT NULL OR a.version IS NOT NULL OR f.version IS NOT NULL) AS anchored,
  list_filter(list_transform(a.facts, lambda x: x.key), lambda k: NOT list_contains(f.keys, k)) AS novel
  FROM sig a, fp f WHERE a.prim),
p1 AS (SELECT *, NOT e AND NOT p AND anchored AS be FROM p0),
p2 AS (SELECT *, coalesce(bp OR bn OR bv OR be, false) AS blocked, CASE WHEN coalesce(bp OR bn OR bv OR be, false) THEN 0 WHEN u OR (e AND n AND v) OR (p AND n AND v) OR (e AND v AND p) THEN 3
  WHEN (e AND n) OR (e AND v) OR (p AND n AND near) OR u THEN 2 WHEN e OR p OR c OR near THEN 1 ELSE 0 END AS level FROM p1),
pair AS (SELECT *, list_filter([CASE WHEN c THEN 'category_overlap' END, CASE WHEN higher THEN 'higher_source_tier' END, CASE WHEN n THEN 'same_announcement_nature' END, CASE WHEN u THEN 'same_canonical_url' END,
  CASE WHEN e THEN 'same_entities' END, CASE WHEN p THEN 'same_product_org' END, CASE WHEN v THEN 'same_version' END, CASE WHEN near THEN 'temporal_proximity' END], lambda x: x IS NOT NULL) AS favorable,
  list_filter([CASE WHEN be THEN 'different_entities' END, CASE WHEN bp THEN 'different_product_org' END, CASE WHEN bv THEN 'different_version' END, CASE WHEN bn THEN 'incompatible_announcement_nature' END,
  CASE WHEN level = 1 AND NOT (e OR p OR n OR v OR u) THEN 'insufficient_event_identity' END, CASE WHEN level = 1 AND NOT (e OR p OR n OR v OR u) THEN 'theme_or_category_only' END], lambda x: x IS NOT NULL) AS unfavorable FROM p2),
best AS (SELECT article_id, max(level) FILTER (level >= 2) AS top_level, count(*) FILTER (level = 3) AS n3, count(*) FILTER (level = 2) AS n2, bool_or(blocked) AS any_blocked,
  min(folder_id) FILTER (level = 3) AS f3, min(folder_id) FILTER (level = 2) AS f2, min(folder_id) FILTER (level = 1) AS f1, list_sort(list_distinct(flatten(list(unfavorable) FILTER (blocked)))) AS barred,
  list_sort(list_distinct(flatten(list(favorable) FILTER (level = 3)))) AS fav3, list_sort(list_distinct(flatten(list(favorable) FILTER (level = 2)))) AS fav2 FROM pair GROUP BY article_id),
dec AS (SELECT a.article_id, a.prim, b.top_level, coalesce(CASE WHEN b.top_level = 3 THEN b.n3 ELSE b.n2 END, 0) > 1 AND b.top_level IS NOT NULL AS tied, b.any_blocked, b.barred, CASE WHEN b.top_level = 3 THEN fav3 ELSE fav2 END AS tied_favorable,
  CASE WHEN b.top_level = 3 THEN b.f3 WHEN b.top_level = 2 THEN b.f2 END AS top, b.f1, tp.favorable AS tf, tp.unfavorable AS tu, tp.novel, wp.favorable AS wf, wp.unfavorable AS wu
  FROM sig a LEFT JOIN best b ON a.article_id = b.article_id LEFT JOIN pair tp ON tp.article_id = a.article_id AND tp.folder_id = CASE WHEN b.top_level = 3 THEN b.f3 WHEN b.top_level = 2 THEN b.f2 END
  LEFT JOIN pair wp ON wp.article_id = a.article_id AND wp.folder_id = b.f1),
decided AS (SELECT article_id,
  CASE WHEN NOT prim THEN 'ambiguous_no_action' WHEN tied THEN 'ambiguous_no_action' WHEN top IS NOT NULL AND len(novel) > 0 THEN 'attach_enrich' WHEN top IS NOT NULL THEN 'duplicate_editorial' WHEN f1 IS NOT NULL THEN 'ambiguous_no_action' ELSE 'create_dossier' END AS issue,
  CASE WHEN NOT prim OR tied THEN NULL WHEN top IS NOT NULL THEN top ELSE f1 END AS folder_id,
  CASE WHEN NOT prim OR tied THEN 'low' WHEN top_level = 3 THEN 'high' WHEN top_level = 2 THEN 'medium' WHEN f1 IS NOT NULL THEN 'low' ELSE 'none' END AS confidence,
  CASE WHEN NOT prim THEN 'insufficient_primary_information' WHEN tied THEN 'multiple_plausible_folders' WHEN top IS NOT NULL AND len(novel) > 0 THEN 'same_event|novel_information' WHEN top IS NOT NULL THEN 'same_event|no_novel_information'
    WHEN f1 IS NOT NULL THEN 'low_confidence_match' WHEN any_blocked THEN 'distinct_event|primary_information' ELSE 'no_credible_candidate|primary_information' END AS motives,
  array_to_string(CASE WHEN NOT prim THEN [] WHEN tied THEN tied_favorable WHEN top IS NOT NULL THEN tf WHEN f1 IS NOT NULL THEN wf ELSE [] END, '|') AS favorable,
  array_to_string(CASE WHEN NOT prim THEN ['content_too_thin'] WHEN tied THEN ['conflicting_candidate_folders'] WHEN top IS NOT NULL AND len(novel) > 0 THEN tu WHEN top IS NOT NULL THEN list_sort(list_distinct(list_append(tu, 'absence_of_new_value')))
    WHEN f1 IS NOT NULL THEN list_sort(list_distinct(list_append(wu, 'insufficient_event_identity'))) ELSE coalesce(barred, []) END, '|') AS unfavorable,
  array_to_string(CASE WHEN prim AND NOT tied AND top IS NOT NULL THEN novel ELSE [] END, '|') AS facts FROM dec)"""

#: The same for queries that compare with the most recently active dossiers alone, as the reference does.
RECENT_SQL = MATCH_SQL.replace("status IN ('open', 'idle'))", f"status IN ('open', 'idle') ORDER BY last_activity DESC, folder_id LIMIT {matching.CANDIDATES})")


def _fingerprints(spark, d, of, most=None):
    folders, members = t.folders(spark, d)
    return matching.folder_fingerprints(matching.candidate_folders(folders, most), members, of)


def _matched(spark, d):
    of = materialize(_signals(spark, d))
    return matching.resolve(of, materialize(_fingerprints(spark, d, of)))


@query(f"WITH {RECENT_SQL} SELECT folder_id, status, array_to_string(entities, '|') AS entities, array_to_string(urls, '|') AS urls, array_to_string(keys, '|') AS keys, product, version, nature, tier, date FROM fp")
def q_folder_fingerprints(spark, d):
    j = lambda c: F.array_join(c, "|").alias(c)
    return _fingerprints(spark, d, _signals(spark, d), matching.CANDIDATES).select("folder_id", "status", j("entities"), j("urls"), j("keys"), "product", "version", "nature", "tier", "date")


@query(f"WITH {MATCH_SQL} SELECT level, array_to_string(favorable, '|') AS favorable, array_to_string(unfavorable, '|') AS unfavorable, count(*) AS pairs, sum(len(novel))::BIGINT AS novel FROM pair GROUP BY ALL")
def q_pair_compare(spark, d):
    of = materialize(_signals(spark, d))
    j = lambda c: F.array_join(c, "|").alias(c)
    found = matching.counted(of, materialize(_fingerprints(spark, d, of)))
    return found.select("level", j("favorable"), j("unfavorable"), "pairs", "novel")


@query(f"WITH {MATCH_SQL} SELECT * FROM decided")
def q_match_decisions(spark, d):
    j = lambda c: F.array_join(c, "|").alias(c)
    return _matched(spark, d).select("article_id", "issue", "folder_id", "confidence", j("motives"), j("favorable"), j("unfavorable"), j("facts"))


@query(f"WITH {MATCH_SQL} SELECT issue, motives, confidence, count(*) AS articles FROM decided GROUP BY ALL")
def q_match_issue_counts(spark, d):
    return _matched(spark, d).groupBy("issue", F.array_join("motives", "|").alias("motives"), "confidence").agg(F.count("*").alias("articles"))


@query(f"""WITH {t.ARTICLES_SQL}, {t.FOLDERS_SQL} SELECT article_id, source_id FROM art a WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.article_id = a.article_id)
  AND NOT EXISTS (SELECT 1 FROM labels l WHERE CAST(l.doc_id AS VARCHAR) = a.article_id)""")
def q_unprocessed_articles(spark, d):
    decided = t.read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("article_id"))
    return matching.unprocessed(t.articles(spark, d), t.folders(spark, d)[1], decided).select("article_id", "source_id")
