"""Publication: states, attempts, leases, rendered messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.rules import transition_allowed
from tidewire.functions.text import collapse, sanitize, truncate
from tidewire.functions.urls import accepted_url

# Limits of a message in code points and parts.
LIMITS = {"content": 2000, "title": 256, "description": 4096, "field_name": 256, "field_value": 1024, "footer": 2048, "thread": 100, "fields": 25, "total": 6000, "sources": 5}


def transitions(history: DataFrame) -> DataFrame:
    """Status changes of each publication (publication_id, seq, status), and whether each is allowed."""
    before = F.coalesce(F.lag("status").over(Window.partitionBy("publication_id").orderBy("seq")), F.lit("none"))
    return history.withColumn("before", before).withColumn("allowed", transition_allowed(F.col("before"), F.col("status")))


def idempotency_key(kind: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *parts)


def retryable(attempts: DataFrame, now: int, most: int = 100) -> DataFrame:
    """Reserved attempts, and failed ones that may be tried again by now; those without a time come last."""
    due = (F.col("status") == "reserved") | ((F.col("status") == "failed") & F.col("retryable") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)))
    return attempts.filter(due).orderBy(F.asc_nulls_last("next_attempt_at"), "attempted_at", "attempt_id").limit(most)


def needing_resume(publications: DataFrame, most: int = 50) -> DataFrame:
    return publications.filter("status = 'partial'").orderBy("updated_at", "publication_id").limit(most)


def claimable(attempts: DataFrame, holder: str, now: int) -> DataFrame:
    """Reserved attempts whose lease is free, over, or the holder's own."""
    free = F.col("holder_id").isNull() | (F.col("lease_expires_at") <= now) | (F.col("holder_id") == holder)
    return attempts.filter((F.col("status") == "reserved") & free)


def reserve(requests: DataFrame, folders: DataFrame, publications: DataFrame, attempts: DataFrame) -> DataFrame:
    """Outcome of reserving the main message of each request (folder_id, key): why not, a hit on what was done before, or reserved with the number of the new attempt.

    folders: folder_id, status; publications: folder_id, status, main_message_id; attempts: folder_id, kind, key,
    attempt_number, status. Any attempt of the key that is reserved or succeeded is a hit, whatever failed after it; a
    dossier without a publication gets one.
    """
    live = F.when(F.col("status").isin("reserved", "succeeded"), F.struct("attempt_number", "status"))
    top = attempts.groupBy("key").agg(F.max("attempt_number").alias("last"), F.max(live).alias("active"), F.bool_or(F.col("status") == "succeeded").alias("done"))
    waiting = attempts.filter("kind = 'publish' and status = 'reserved'").select("folder_id", F.lit(True).alias("waiting")).distinct()
    state = publications.select("folder_id", F.col("status").alias("state"), "main_message_id")
    e = requests.join(folders.select("folder_id", F.col("status").alias("folder_status")), "folder_id", "left").join(state, "folder_id", "left").join(top, "key", "left").join(waiting, "folder_id", "left")
    before = F.coalesce("state", F.lit("none"))
    why = (
        F.when(F.col("folder_status").isNull(), "folder_absent").when(F.col("folder_status") == "closed", "folder_closed")
        .when(_has_main("state", "main_message_id"), F.when(F.col("done"), "already_published").otherwise("main_already_reserved_or_exists"))
        .when(F.col("active.status") == "succeeded", "already_succeeded").when(F.col("active.status") == "reserved", "already_reserved")
        .when((before == "pending") & F.col("waiting"), "already_reserved")
        .when((before != "pending") & ~transition_allowed(before, F.lit("pending")), "forbidden_status_transition").otherwise("reserved")
    )
    return e.withColumn("outcome", why).select("folder_id", "key", "outcome", F.when(F.col("outcome") == "reserved", F.coalesce("last", F.lit(0)) + 1).cast("long").alias("attempt_number"))


def prepared_sources(sources: DataFrame) -> DataFrame:
    """Sources of each folder (folder_id, seq, name, url): names cleaned, URLs accepted or dropped, one of each, in order of name and URL."""
    clean = sources.select("folder_id", "seq", truncate(sanitize(F.col("name")), LIMITS["field_name"]).alias("name"), accepted_url(F.col("url")).alias("url")).filter("name <> ''")
    first = F.row_number().over(Window.partitionBy("folder_id", F.lower("name"), F.coalesce("url", F.lit(""))).orderBy("seq"))
    one = clean.withColumn("rn", first).filter("rn = 1").drop("rn")
    place = F.row_number().over(Window.partitionBy("folder_id").orderBy(F.lower("name"), "name", F.coalesce("url", F.lit(""))))
    return one.withColumn("place", place.cast("long")).drop("seq")


def sources_field(prepared: DataFrame) -> DataFrame:
    """One text of the first sources of each folder, and whether some are left out."""
    line = F.concat_ws(" — ", "name", "url")
    some = prepared.withColumn("line", line)
    return some.groupBy("folder_id").agg(
        truncate(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= LIMITS["sources"], F.struct("place", "line")))), lambda s: s["line"]), "\n"), LIMITS["field_value"]).alias("sources"),
        (F.max("place") > LIMITS["sources"]).alias("more"),
    )


def thread_name(title: Column, prefix: str = "") -> Column:
    return truncate(F.concat(F.lit(prefix), sanitize(title)), LIMITS["thread"])


def main_message(folders: DataFrame) -> DataFrame:
    """Title, description and footer of folders (folder_id, title, summary), and the characters of all; the description gives way when the total is too long."""
    clean = folders.select("folder_id", truncate(sanitize(F.col("title")), LIMITS["title"]).alias("t"), sanitize(F.col("summary"), keep_lines=True).alias("s"), F.right("folder_id", F.lit(8)).alias("suffix"))
    title = F.when(F.col("t") == "", truncate(F.col("s"), LIMITS["title"])).otherwise(F.col("t"))
    framed = clean.select("folder_id", title.alias("title"), truncate(F.col("s"), LIMITS["description"]).alias("body"), F.concat(F.lit("dossier:"), "suffix").alias("footer"))
    room = F.greatest(F.lit(LIMITS["total"]) - F.length("title") - F.length("footer"), F.lit(0))
    body = F.when(F.length("body") > room, F.concat(F.substring(F.col("body"), F.lit(1), room - 1), F.lit("…"))).otherwise(F.col("body"))
    return framed.select("folder_id", "title", body.alias("description"), "footer", (F.length("title") + F.length(body) + F.length("footer")).cast("long").alias("chars"))


def _lines_of(facts: DataFrame) -> DataFrame:
    """folder_id and lines (text) of the facts (folder_id, key, value) of each folder that has any with a key and a value."""
    clean = facts.select("folder_id", sanitize(F.col("key")).alias("key"), sanitize(F.col("value")).alias("value"))
    # empty ones are left out here, not by a filter, which Spark would put below the sanitizing and so repeat it
    some = clean.groupBy("folder_id").agg(F.sort_array(F.collect_list(F.when((F.col("key") != "") & (F.col("value") != ""), F.struct("key", "value")))).alias("facts")).filter(F.size("facts") > 0)
    return some.select("folder_id", F.array_join(F.transform("facts", lambda f: F.concat(F.lit("• "), f["key"], F.lit(": "), f["value"])), "\n").alias("lines"))


def enrichment_message(facts: DataFrame, prepared: DataFrame) -> DataFrame:
    """Description of new facts (folder_id, key, value), one a line in order, with the new sources; folders with neither are left out."""
    lines = _lines_of(facts)
    both = lines.join(sources_field(prepared).select("folder_id", "sources"), "folder_id", "full")
    return both.select("folder_id", truncate(F.coalesce("lines", F.lit("Nouvelles sources.")), LIMITS["description"]).alias("description"), "sources")


def useful_date(millis: Column) -> Column:
    """The UTC day, or unknown; years over 9999 have no sign."""
    day = F.date_from_unix_date(F.floor(millis / 86_400_000).cast("int")).cast("string")
    return F.coalesce(F.ltrim(day, F.lit("+")), F.lit("unknown"))


def source_warnings(sources: DataFrame) -> DataFrame:
    """What is wrong with each source (folder_id, seq, name, url): no name, an unusable URL, or one that came before."""
    clean = sources.select("folder_id", "seq", sanitize(F.col("name")).alias("n"), accepted_url(F.col("url")).alias("u"), F.col("url").alias("raw"))
    first = F.row_number().over(Window.partitionBy("folder_id", F.lower("n"), F.coalesce("u", F.lit(""))).orderBy("seq"))
    bad_url = (F.trim(F.coalesce("raw", F.lit(""))) != "") & F.col("u").isNull()
    found = F.when(F.coalesce("n", F.lit("")) == "", F.array(F.lit("source_ignored:empty_name"))).otherwise(F.array_compact(F.array(F.when(bad_url, F.concat(F.lit("url_invalid:"), F.substring("raw", 1, 120))), F.when(F.col("rn") > 1, F.lit("source_ignored:duplicate")))))
    return clean.withColumn("rn", first).select("folder_id", "seq", F.posexplode(found).alias("place", "warning"))


FIELDS = "array<struct<name:string,value:string,inline:boolean>>"


def fields(*wanted: tuple[str, Column, bool]) -> tuple[Column, Column]:
    """(fields, warnings): what fits of (name, value, inline), empty ones left out."""
    made = F.array(*(F.struct(truncate(F.lit(n), LIMITS["field_name"]).alias("name"), truncate(v, LIMITS["field_value"]).alias("value"), F.lit(i).alias("inline"), (F.length(v) > LIMITS["field_value"]).alias("cut")) for n, v, i in wanted))
    some = F.filter(made, lambda f: F.coalesce(f["value"], F.lit("")) != "")
    kept = F.transform(F.slice(some, 1, LIMITS["fields"]), lambda f: F.struct(f["name"], f["value"], f["inline"])).cast(FIELDS)
    empty = F.filter(made, lambda f: F.coalesce(f["value"], F.lit("")) == "")
    over = F.filter(some, lambda f, i: i >= LIMITS["fields"])
    told = F.concat(
        F.transform(F.filter(some, lambda f: f["cut"]), lambda f: F.concat(F.lit("field_value_truncated:"), f["name"])),
        F.transform(F.concat(empty, over), lambda f: F.concat(F.lit("field_omitted:"), f["name"])),
    )
    return kept, told


def _size(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda n, f: n + F.length(f["name"]) + F.length(f["value"]))


def _within(c: Column, room: Column) -> Column:
    return F.when(F.length(c) <= room, c).when(room > 0, F.concat(F.substring(c, F.lit(1), room - 1), F.lit("…")))


def within_total(messages: DataFrame, most: int = LIMITS["total"]) -> DataFrame:
    """Messages (title, description, fields, footer, warnings) with at most so many characters in all: the description gives way, then fields from the end, then the title, then the footer."""
    n = lambda c: F.coalesce(F.length(c), F.lit(0))
    add = lambda *cs: F.concat("warnings", F.array_compact(F.array(*cs)))
    told = lambda what: F.lit(f"embed_total_truncated:{what}")
    step = messages.withColumn("_all", n("title") + n("description") + n("footer") + _size(F.col("fields")))
    room = F.lit(most) - (F.col("_all") - n("description"))
    tight = (F.col("_all") > most) & F.col("description").isNotNull()
    step = step.withColumns({"_d": F.when(tight, _within(F.col("description"), room)).otherwise(F.col("description")), "warnings": add(F.when(tight & (room <= 0), told("description_removed")).when(tight & (n("description") > room), told("description")))})
    base = n("title") + n("_d") + n("footer")
    fits = F.filter(F.sequence(F.lit(0), F.size("fields")), lambda i: base + _size(F.slice("fields", F.lit(1), i)) <= most)
    step = step.withColumn("_n", F.when(F.col("_all") <= most, F.size("fields")).otherwise(F.coalesce(F.array_max(fits), F.lit(0))))
    dropped = F.reverse(F.slice("fields", F.col("_n") + 1, F.size("fields")))
    lost = F.flatten(F.transform(dropped, lambda f: F.array(F.concat(F.lit("field_omitted:"), f["name"]), told("field_dropped"))))
    step = step.withColumns({"warnings": F.concat("warnings", lost), "fields": F.slice("fields", F.lit(1), F.col("_n"))})
    step = step.withColumn("_rest", n("_d") + n("footer") + _size(F.col("fields")))
    long = n("title") + F.col("_rest") > most
    step = step.withColumns({"_t": F.when(long, _within(F.col("title"), F.lit(most) - F.col("_rest"))).otherwise(F.col("title")), "warnings": add(F.when(long & (F.col("_rest") >= most), told("title_removed")).when(long, told("title")))})
    step = step.withColumn("_rest", n("_t") + n("_d") + _size(F.col("fields")))
    long = n("footer") + F.col("_rest") > most
    step = step.withColumns({"footer": F.when(long, _within(F.col("footer"), F.lit(most) - F.col("_rest"))).otherwise(F.col("footer")), "warnings": add(F.when(long & (F.col("_rest") >= most), told("footer_removed")).when(long, told("footer")))})
    return step.withColumns({"title": F.col("_t"), "description": F.col("_d")}).drop("_all", "_d", "_n", "_rest", "_t")


# Texts of messages.
THREAD_PREFIX, NO_TITLE, NO_SUMMARY, NEW_SOURCES, ENRICHED, ENRICHED_TITLE = "Veille — ", "Veille IA", "Résumé indisponible.", "Nouvelles sources.", "Mise à jour du dossier", "Enrichissement"


def _sources_of(sources: DataFrame) -> DataFrame:
    """folder_id, sources (text), more, first_url and source_told of every folder with sources."""
    prepared = prepared_sources(sources)
    told = source_warnings(sources).groupBy("folder_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "place", "warning"))), lambda w: w["warning"]).alias("source_told"))
    first = prepared.filter("url is not null").groupBy("folder_id").agg(F.min_by("url", "place").alias("first_url"))
    return sources_field(prepared).join(first, "folder_id", "left").join(told, "folder_id", "full")


def main_payload(folders: DataFrame, sources: DataFrame) -> DataFrame:
    """The whole message that opens a dossier: content, title, description, url, fields, footer, thread and warnings, for folders (folder_id, title, summary, category, worthiness, composite, useful_date in ms) and their sources (folder_id, seq, name, url)."""
    note = lambda cond, text: F.when(F.coalesce(cond, F.lit(False)), F.lit(text))
    e = folders.join(_sources_of(sources), "folder_id", "left").withColumns({"t": F.coalesce(sanitize(F.col("title")), F.lit("")), "s": F.coalesce(collapse(sanitize(F.col("summary"), keep_lines=True)), F.lit(""))})
    whole = F.when(F.col("t") != "", F.col("t")).when(F.col("s") != "", F.col("s")).otherwise(F.lit(NO_TITLE))
    body = F.when(F.col("s") != "", F.col("s")).otherwise(F.lit(NO_SUMMARY))
    e = e.withColumns({"whole": whole, "body": body, "none": F.array().cast("array<string>")})
    e = e.withColumn("head", truncate(F.col("whole"), LIMITS["title"]))
    text = F.concat_ws(" — ", "head", "first_url")
    thread = F.concat(F.lit(THREAD_PREFIX), F.when(F.col("t") != "", F.col("t")).otherwise(F.lit(NO_TITLE)))
    label = lambda c, other: F.coalesce(F.nullif(sanitize(F.col(c)), F.lit("")), F.lit(other))
    kept, told = fields(("Catégorie", label("category", "other"), True), ("Pertinence", F.concat_ws(" · ", F.coalesce(F.col("composite").cast("long"), F.lit(0).cast("long")).cast("string"), label("worthiness", "none")), True), ("Sources", F.col("sources"), False), ("Date", useful_date(F.col("useful_date")), True))
    warned = F.concat(
        F.array_compact(F.array(note((F.col("t") == "") & (F.col("s") != ""), "empty_fallback:title_from_summary"), note((F.col("t") == "") & (F.col("s") == ""), "empty_fallback:title"), note(F.col("s") == "", "empty_fallback:summary"), note(F.length("whole") > LIMITS["title"], "title_truncated"), note(F.length("body") > LIMITS["description"], "summary_truncated"))),
        F.coalesce("source_told", "none"), F.array_compact(F.array(note(F.length(text) > LIMITS["content"], "message_truncated"), note(F.col("more"), f"source_ignored:capped_at_{LIMITS['sources']}"))), told,
    )
    made = e.select(
        "folder_id", truncate(text, LIMITS["content"]).alias("content"), F.col("head").alias("title"), truncate(F.col("body"), LIMITS["description"]).alias("description"), F.col("first_url").alias("url"), kept.alias("fields"),
        F.concat(F.lit("dossier:"), F.right(F.trim(F.col("folder_id").cast("string")), F.lit(8))).alias("footer"), truncate(thread, LIMITS["thread"]).alias("thread"), warned.alias("warnings"),
        F.array_compact(F.array(note(F.col("t") == "", "empty_fallback:thread_title"), note(F.length(thread) > LIMITS["thread"], "thread_name_truncated"))).alias("late"),
    )
    return within_total(made).withColumn("warnings", F.concat("warnings", "late")).drop("late")


def enrichment_payload(folders: DataFrame, facts: DataFrame, sources: DataFrame) -> DataFrame:
    """The message that adds to a dossier's thread: content, title, description, fields, footer and warnings, for folders (folder_id, fingerprint) with new facts (folder_id, key, value) or sources; those with neither are left out."""
    lines = _lines_of(facts)
    e = folders.join(lines, "folder_id", "left").join(_sources_of(sources), "folder_id", "left").filter("lines is not null or sources is not null")
    body, text = F.coalesce("lines", F.lit(NEW_SOURCES)), F.concat_ws(" — ", F.lit(ENRICHED), "first_url")
    kept, told = fields(("Nouvelles sources", F.col("sources"), False))
    note = lambda cond, t: F.when(F.coalesce(cond, F.lit(False)), F.lit(t))
    none = F.array().cast("array<string>")
    warned = F.concat(F.coalesce("source_told", none), F.array_compact(F.array(note(F.col("lines").isNull(), "empty_fallback:enrichment_description"), note(F.length(body) > LIMITS["description"], "summary_truncated"), note(F.col("more"), f"source_ignored:capped_at_{LIMITS['sources']}"))), F.filter(told, lambda w: ~w.startswith("field_omitted")))
    short = F.nullif(F.substring(F.trim("fingerprint"), 1, 8), F.lit(""))
    made = e.select(
        "folder_id", truncate(text, LIMITS["content"]).alias("content"), F.lit(ENRICHED_TITLE).alias("title"), truncate(body, LIMITS["description"]).alias("description"), kept.alias("fields"),
        F.concat_ws(" · ", F.concat(F.lit("dossier:"), F.right(F.trim(F.col("folder_id").cast("string")), F.lit(8))), short).alias("footer"), warned.alias("warnings"),
    )
    return within_total(made)


# --- records -------------------------------------------------------------------------------------------------------

# Longest idempotency key; codes of stored errors and of those that a later attempt may mend.
KEY_CHARS = 512
STORED_ERRORS = {"folder_closed": "folder_closed", "folder_absent": "precondition_failed", "enrichment_precondition_failed": "precondition_failed", "main_already_reserved_or_exists": "precondition_failed", "forbidden_status_transition": "inconsistent_state", "inconsistent_state": "inconsistent_state", "invalid_idempotency_key": "precondition_failed"}
PASSING_ERRORS = ("discord_rate_limited", "discord_timeout", "discord_unavailable", "channel_unavailable")


def keys_of(folder_id: Column, message_id: Column, thread_id: Column, fingerprint: Column, attempt_id: Column) -> dict[str, Column]:
    """The idempotency key of each kind of operation; null where a part is missing or the key is too long."""
    made = {"publish": [folder_id], "create_thread": [folder_id, message_id], "enrich": [folder_id, fingerprint, attempt_id], "unarchive": [folder_id, thread_id]}
    whole = {k: F.concat(F.lit(k), *(x for p in parts for x in (F.lit(":"), p))) for k, parts in made.items()}
    return {k: F.when(F.length(c) <= KEY_CHARS, c) for k, c in whole.items()}


def error_of(code: Column) -> Column:
    """The code told for an error of storing; others are unknown."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in STORED_ERRORS.items() for x in kv)), code), F.lit("unknown"))


def passing(code: Column) -> Column:
    return F.coalesce(code.isin(*PASSING_ERRORS), F.lit(False))


def _has_main(status: str, message: str) -> Column:
    return F.col(message).isNotNull() & F.coalesce(F.col(status).isin("partial", "main_published", "inconsistent"), F.lit(False))


def reserve_operation(requests: DataFrame, folders: DataFrame, publications: DataFrame, attempts: DataFrame) -> DataFrame:
    """Outcome of reserving each request (folder_id, kind, key, fingerprint) for a dossier that has a publication: why not, a hit on what was done before, or reserved with the number of the new attempt."""
    top = attempts.groupBy("key").agg(F.max("attempt_number").alias("last"), F.max(F.when(F.col("status").isin("reserved", "succeeded"), F.struct("attempt_number", "status"))).alias("active"))
    state = publications.select("folder_id", F.col("status").alias("state"), "main_message_id", F.lit(True).alias("known"))
    e = requests.join(folders.select("folder_id", F.col("status").alias("folder_status")), "folder_id", "left").join(state, "folder_id", "left").join(top, "key", "left")
    needs = F.col("kind").isin("enrich", "create_thread")
    why = (
        F.when((F.length("key") > KEY_CHARS) | (F.trim("key") == ""), "invalid_idempotency_key")
        .when((F.col("kind") == "enrich") & (F.trim(F.coalesce("fingerprint", F.lit(""))) == ""), "enrichment_precondition_failed")
        .when(F.col("folder_status").isNull(), "folder_absent").when(F.col("folder_status") == "closed", "folder_closed")
        .when(F.col("known").isNull() | (needs & ~_has_main("state", "main_message_id")), "enrichment_precondition_failed")
        .when(F.col("active.status") == "succeeded", "already_succeeded").when(F.col("active.status") == "reserved", "already_reserved").otherwise("reserved")
    )
    return e.withColumn("outcome", why).select("folder_id", "kind", "key", "outcome", F.when(F.col("outcome") == "reserved", F.coalesce("last", F.lit(0)) + 1).cast("long").alias("attempt_number"))


def record_main(results: DataFrame, publications: DataFrame) -> DataFrame:
    """The state of each publication after a main message (folder_id, message_id, thread_id) was sent, or the error of a change that is not allowed."""
    e = results.join(publications.select("folder_id", F.col("status").alias("before"), F.lit(True).alias("known")), "folder_id", "left")
    after = F.when(F.col("thread_id").isNotNull(), "main_published").otherwise("partial")
    error = F.when(F.col("known").isNull(), "inconsistent_state").when((F.col("before") != after) & ~transition_allowed(F.col("before"), after), "forbidden_status_transition")
    return e.select("folder_id", "before", F.when(error.isNull(), after).otherwise(F.col("before")).alias("status"), error.alias("error"), F.when(error.isNull(), F.col("message_id")).alias("message_id"), F.when(error.isNull(), F.col("thread_id")).alias("thread_id"))


def record_failure(failures: DataFrame, attempts: DataFrame) -> DataFrame:
    """Reserved attempts (attempt_id, status) after an error (attempt_id, code, next_attempt_at): failed, to be tried again if the error passes; others stay."""
    e = attempts.join(failures, "attempt_id", "left")
    hit = F.col("code").isNotNull() & (F.col("status") == "reserved")
    again = passing(F.col("code"))
    return e.select("attempt_id", F.when(hit, "failed").otherwise(F.col("status")).alias("status"), F.when(hit, F.col("code")).alias("error_code"), (hit & again).alias("retryable"), F.when(hit & again, F.col("next_attempt_at")).alias("next_attempt_at"))


def route(decisions: DataFrame, folders: DataFrame, publications: DataFrame) -> DataFrame:
    """What is to be done for each decision (folder_id, decision): publish, enrich, or why nothing is."""
    state = publications.select("folder_id", F.col("status").alias("state"), "main_message_id", "thread_id")
    e = decisions.join(folders.select("folder_id", F.col("status").alias("folder_status")), "folder_id", "left").join(state, "folder_id", "left")
    main = _has_main("state", "main_message_id")
    step = (
        F.when(F.col("decision").isin("hold", "reject_editorial"), F.concat(F.lit("skipped:"), "decision"))
        .when(~F.col("decision").isin("publish", "enrich_thread_only"), "failed:unsupported").when(F.col("folder_status").isNull(), "failed:precondition_failed").when(F.col("folder_status") == "closed", "skipped:folder_closed")
        .when((F.col("decision") == "publish") & main, "skipped:idempotent_hit").when(F.col("decision") == "publish", "publish")
        .when(main & F.col("thread_id").isNotNull(), "enrich").when(main, "complete_thread").otherwise("failed:precondition_failed")
    )
    return e.select("folder_id", "decision", step.alias("step"))


def resume(folders: DataFrame, publications: DataFrame) -> DataFrame:
    """How a publication that stopped half way goes on, by folder (folder_id, title): the thread of a sent message is made, or why not."""
    e = folders.select("folder_id", "title").join(publications.select("folder_id", "status", "main_message_id", "channel_id", "thread_id"), "folder_id", "left")
    step = F.when((F.col("status") == "partial") & F.col("main_message_id").isNotNull() & F.col("channel_id").isNotNull(), "complete_thread").when((F.col("status") == "main_published") & F.col("main_message_id").isNotNull() & F.col("thread_id").isNotNull(), "skipped:idempotent_hit").otherwise("failed:precondition_failed")
    return e.select("folder_id", step.alias("step"), F.when(step == "complete_thread", F.substring(F.concat(F.lit(THREAD_PREFIX), "title"), 1, LIMITS["thread"])).alias("thread"))
