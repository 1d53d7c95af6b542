"""RSS and Atom bodies to items. One small XML helper runs per body; everything after it is columns."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import trim

ITEM = "title string, link string, external_id string, summary string, content string, author string, published string, updated string, categories array<string>"
PARSED = f"source_id string, format string, feed_title string, error string, item_index long, {ITEM}"
_FIELDS = [f.split()[0] for f in PARSED.split(", ")]


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _text(e: ET.Element, *names: str) -> str | None:
    """Text of the first child of the first name that has some."""
    for n in names:
        for c in e:
            if _name(c) == n and (t := "".join(c.itertext()).strip()):
                return t
    return None


def _atom_link(e: ET.Element) -> str | None:
    links = [c for c in e if _name(c) == "link"]
    best = next((c for c in links if c.get("rel") in (None, "alternate")), links[0] if links else None)
    return None if best is None else (best.get("href") or (best.text or "").strip() or None)


def _rss_item(e: ET.Element) -> tuple:
    guid = _text(e, "guid")
    return _text(e, "title"), _text(e, "link") or guid, guid, _text(e, "description"), _text(e, "encoded"), _text(e, "author", "creator"), _text(e, "pubDate"), None, [t for c in e if _name(c) == "category" and (t := (c.text or "").strip())]


def _atom_entry(e: ET.Element) -> tuple:
    author = next((c for c in e if _name(c) == "author"), None)
    who = None if author is None else _text(author, "name", "email") or (author.text or "").strip() or None
    tags = [t for c in e if _name(c) == "category" and (t := (c.get("term") or c.text or "").strip())]
    return _text(e, "title"), _atom_link(e), _text(e, "id"), _text(e, "summary"), _text(e, "content"), who, _text(e, "published", "updated"), _text(e, "updated"), tags


def _parse(body: str | None) -> tuple[str | None, str | None, str | None, list[tuple]]:
    """(format, title, error, items) of one body."""
    try:
        if not body or "<!DOCTYPE" in body[:2000].upper():
            raise ET.ParseError
        root = ET.fromstring(body.lstrip("﻿ \r\n\t"))
    except ET.ParseError:
        return None, None, "InvalidXml", []
    if _name(root) == "rss" and (channel := next((c for c in root if _name(c) == "channel"), None)) is not None:
        return "rss", _text(channel, "title"), None, [_rss_item(i) for i in channel if _name(i) == "item"]
    if _name(root) == "feed":
        return "atom", _text(root, "title"), None, [_atom_entry(i) for i in root if _name(i) == "entry"]
    return None, None, "UnknownFormat", []


def parse(bodies: DataFrame) -> DataFrame:
    """Items of (source_id, body); a body without items, or with an error, is one row whose item_index is null."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for source, body in zip(part["source_id"], part["body"]):
                kind, title, error, items = _parse(body)
                rows += [(source, kind, title, error, i, *item) for i, item in enumerate(items)] or [(source, kind, title, error, None, *[None] * 8, None)]
            yield pd.DataFrame(rows, columns=_FIELDS).astype({"item_index": "Int64"})

    return bodies.select("source_id", "body").mapInPandas(run, PARSED)


def feed_date(c: Column) -> Column:
    """RFC 822 and ISO 8601 dates as milliseconds; null for all others."""
    bare = F.regexp_replace(trim(c), r"^[A-Za-z]{3,9},\s*", "")
    zoned = F.regexp_replace(bare, r"\s(GMT|UT|UTC|Z)$", " +0000")
    tries = [F.try_to_timestamp(zoned, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")]
    iso = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(bare))
    return F.unix_millis(F.coalesce(*tries, iso))


def fetch_outcome(fetches: DataFrame) -> DataFrame:
    """What each fetch (source_id, status, body, expected_format, format, etag, previous_etag) comes to, and the validator to keep."""
    ok = F.col("status").between(200, 299)
    outcome = F.when(F.col("status") == 304, "not_modified").when(~ok, "http_error").when(F.coalesce(trim(F.col("body")), F.lit("")) == "", "empty_body").when(F.col("format").isNull(), "parse_error").when(F.col("format") != F.col("expected_format"), "format_mismatch").otherwise("collected")
    return fetches.withColumns({"outcome": outcome, "etag": F.coalesce("etag", "previous_etag")})
