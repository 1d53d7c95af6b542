"""Articles: normalisation with rejects, identity, editorial comparison, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import collapse, trim
from tidewire.functions.urls import Parts, article_url, editorial_url

FIELDS = ("source_tier", "title", "url", "published_at", "author", "summary", "content", "categories", "feed_format", "external_id")


def first_spellings(labels: Column) -> Column:
    """Trimmed, not empty, one of each regardless of case: the first spelling, in order."""
    plain = F.filter(F.transform(labels, trim), lambda t: t != "")
    lowered = F.transform(plain, F.lower)
    return F.filter(plain, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1)


def normalize(items: DataFrame) -> DataFrame:
    """Items of feeds with title, link and categories in canonical form, and reject: the category of what is wrong, or null."""
    title, link = F.nullif(collapse(F.col("title")), F.lit("")), F.nullif(trim(F.col("link")), F.lit(""))
    url = article_url(link)
    reject = F.when(title.isNull(), "MissingTitle").when(link.isNull(), "MissingUrl").when(url.isNull(), "InvalidUrl")
    return items.withColumns({"reject": reject, "title": title, "url": url, "categories": first_spellings(F.col("categories"))})


def identity_key(external_id: Column, url: Column) -> Column:
    named = F.nullif(trim(external_id), F.lit(""))
    return F.coalesce(F.concat(F.lit("e:"), named), F.concat(F.lit("u:"), url))


def editorial(c: dict[str, Column]) -> dict[str, Column]:
    """What counts when two versions of an article are compared."""
    text = lambda x: F.nullif(collapse(x), F.lit(""))
    out = {f: text(c[f]) for f in ("title", "author", "summary", "content")}
    out |= {"source_tier": F.upper(trim(c["source_tier"])), "url": editorial_url(c["url"]), "published_at": c["published_at"], "feed_format": F.lower(c["feed_format"]), "external_id": F.nullif(trim(c["external_id"]), F.lit(""))}
    out["categories"] = F.array_sort(F.filter(F.transform(c["categories"], lambda t: F.lower(collapse(t))), lambda t: t != ""))
    return {f: out[f] for f in FIELDS}


def editorial_hash(c: dict[str, Column]) -> Column:
    return hash_of(editorial(c))


def hash_of(e: dict[str, Column]) -> Column:
    """SHA-256 of the compared fields as JSON in a fixed order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*(e[f].alias(f) for f in FIELDS)), {"ignoreNullFields": "false"}), 256)


def changed_fields(old: dict[str, Column], new: dict[str, Column]) -> Column:
    a, b = editorial(old), editorial(new)
    return F.array_compact(F.array(*(F.when(~a[f].eqNullSafe(b[f]), F.lit(f)) for f in FIELDS)))


def digested(rows: DataFrame) -> DataFrame:
    """source_id, identity, seq, article_id and digest of articles."""
    digest = editorial_hash({f: F.col(f) for f in FIELDS})
    return rows.select("source_id", identity_key(F.col("external_id"), F.col("url")).alias("identity"), "seq", "article_id", digest.alias("digest"))


def actions_of(new: DataFrame, old: DataFrame) -> DataFrame:
    """created, updated or unchanged for each row of digested(), against the stored digests (source_id, identity, stored)."""
    before = F.lag("digest").over(Window.partitionBy("source_id", "identity").orderBy("seq"))
    seen = new.withColumn("before", before).join(old, ["source_id", "identity"], "left").withColumn("before", F.coalesce("before", "stored"))
    action = F.when(F.col("before").isNull(), "created").when(F.col("before") == F.col("digest"), "unchanged").otherwise("updated")
    return seen.select("source_id", "identity", "seq", "article_id", action.alias("action"))


def upsert(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """created, updated or unchanged for each incoming row (with seq, its order), as if they were applied one after the other.

    A row is compared with the row of the same source and identity before it: the one before it in the batch, else the stored one.
    """
    digest = editorial_hash({f: F.col(f) for f in FIELDS})
    old = existing.select("source_id", identity_key(F.col("external_id"), F.col("url")).alias("identity"), digest.alias("stored"))
    return actions_of(digested(incoming), old.dropDuplicates(["source_id", "identity"]))


def valid_host(url: Column) -> Column:
    return Parts(url).valid
