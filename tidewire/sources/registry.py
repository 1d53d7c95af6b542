"""The source registry: JSON text to valid rows and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import trim
from tidewire.functions.urls import source_url

ENTRY = "struct<id:string,name:string,url:string,tier:string,enabled:boolean,provider:string>"
# Providers, and those that cannot be enabled.
PROVIDERS, DISABLED = ("rss", "atom", "github_releases", "html", "api"), ("html", "api")
EXPECTED = {"rss": "rss", "atom": "atom", "github_releases": "atom"}


def parse(text: DataFrame) -> DataFrame:
    """Entries of (value), a registry as one JSON text, with position, normalised fields and reject: why a row is left out, or null. First of equals wins, among valid rows."""
    raw = F.from_json(F.regexp_replace("value", "^﻿", ""), f"struct<sources:array<{ENTRY}>>")
    rows = text.select(F.posexplode(raw["sources"]).alias("pos", "s")).select(F.col("pos").cast("long").alias("pos"), "s.*")
    url = source_url(F.col("url"))
    bad = (
        F.when(F.col("id").isNull() | ~F.col("id").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), "invalid_id")
        .when((F.coalesce(trim(F.col("name")), F.lit("")) == "") | (F.length(trim(F.col("name"))) > 200), "invalid_name")
        .when(url.isNull(), "invalid_url").when(~F.coalesce(F.col("tier").isin(*"SABCDE"), F.lit(False)), "invalid_tier")
        .when(F.col("enabled").isNull(), "invalid_enabled").when(~F.coalesce(F.col("provider").isin(*PROVIDERS), F.lit(False)), "invalid_provider")
        .when(F.col("enabled") & F.col("provider").isin(*DISABLED), "provider_disabled")
    )
    checked = rows.withColumns({"name": trim(F.col("name")), "canonical": url, "reject": bad})
    first = lambda c: F.row_number().over(Window.partitionBy(c, F.col("reject").isNull()).orderBy("pos"))
    by_id = checked.withColumn("reject", F.coalesce("reject", F.when(first("id") > 1, "duplicate_id")))
    return by_id.withColumn("reject", F.coalesce("reject", F.when(first("canonical") > 1, "duplicate_url")))


def enabled(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("reject").isNull() & F.col("enabled")).withColumn("expected_format", F.element_at(F.create_map(*(F.lit(x) for kv in EXPECTED.items() for x in kv)), F.col("provider")))


def _blocked_v4(ip: Column) -> Column:
    part = lambda i: F.split(ip, r"\.").getItem(i).cast("int")
    a, b, c = part(0), part(1), part(2)
    return a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))


def blocked_address(ip: Column) -> Column:
    """Whether an IPv4 or IPv6 address is local, private, reserved, or no address. An IPv4 address written as an IPv6 one counts as what it is."""
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    four = rf"(?:{octet}\.){{3}}{octet}"
    mapped = F.regexp_extract(F.lower(ip), rf"^::ffff:({four})$", 1)
    # groups on both sides of a double colon, which stands for as many zeros as are missing
    low = F.lower(ip)
    sides = F.split(low, "::")
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    left, right = groups(sides.getItem(0)), F.when(F.size(sides) > 1, groups(sides.getItem(1))).otherwise(F.array().cast("array<string>"))
    n = F.size(left) + F.size(right)
    fine = low.rlike("^[0-9a-f:]+$") & ~low.rlike(":::|[0-9a-f]{5}") & ~low.rlike("^:[^:]|[^:]:$") & (((F.size(sides) == 1) & (n == 8)) | ((F.size(sides) == 2) & (n <= 7)))
    full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), right)
    first = F.conv(F.get(full, 0), 16, 10).cast("int")
    zeros = F.forall(F.slice(full, 1, 7), lambda g: g.rlike("^0+$")) & F.get(full, 7).rlike("^0*[01]$")
    six = zeros | first.between(0xFE80, 0xFEBF) | first.between(0xFC00, 0xFDFF) | (first >= 0xFF00)
    is_ = lambda c: F.coalesce(c, F.lit(False))
    return F.when(is_(ip.rlike(f"^{four}$")), _blocked_v4(ip)).when(is_(mapped != ""), _blocked_v4(mapped)).when(is_(fine), six).otherwise(True)


def local_host(host: Column) -> Column:
    h = F.lower(host)
    return (h == "localhost") | h.endswith(".localhost") | h.endswith(".local")
