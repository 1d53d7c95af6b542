"""Five URL forms that differ on purpose. Plain http(s) URLs with ASCII hosts are handled; others count as invalid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import trim

_URL = r"^(?i)(https?):[/\\]{2}(?:([^/?#@]*)@)?([A-Za-z0-9.-]+)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
# Query parameters that only track.
TRACKING = ("fbclid", "gclid", "gclsrc", "dclid", "msclkid", "twclid", "igshid", "ref", "ref_src", "ref_url", "ncid", "cmpid", "campaign_id", "source", "medium")
TRACKING_PREFIXES = ("utm_", "mc_")


class Parts:
    """Components of a URL column: scheme and host in lower case, port without the default one, path at least a slash."""

    def __init__(self, url: Column):
        part = lambda i: F.regexp_extract(url, _URL, i)
        self.scheme, self.user, self.host = F.lower(part(1)), part(2), F.lower(part(3))
        port = part(4)
        default = ((self.scheme == "http") & (port == "80")) | ((self.scheme == "https") & (port == "443")) | (port == "")
        self.port = F.when(default, "").otherwise(F.concat(F.lit(":"), port))
        self.path = F.when(part(5) == "", "/").otherwise(part(5))
        self.query, self.fragment = part(6), part(7)
        self.valid = url.isNotNull() & (self.scheme != "") & (self.path.startswith("/"))
        self.origin = F.concat(self.scheme, F.lit("://"), self.host, self.port)
        self.bare_path = F.when((F.length(self.path) > 1) & self.path.endswith("/"), F.substring(self.path, F.lit(1), F.length(self.path) - 1)).otherwise(self.path)
        self.search = F.when(self.query == "?", "").otherwise(self.query)


def matching_url(url: Column) -> Column:
    """For telling events apart: no fragment, no user, one trailing slash less; the query stays. Null if invalid."""
    p = Parts(url)
    return F.when(p.valid, F.concat(p.origin, p.bare_path, p.search))


def article_url(url: Column) -> Column:
    """For articles: no fragment; the trailing slash stays. Null if invalid or with a user."""
    p = Parts(trim(url))
    return F.when(p.valid & (p.user == ""), F.concat(p.origin, p.path, p.search))


def source_url(url: Column) -> Column:
    """For the registry: no trailing slash but the root's. Null if invalid, or with a user or a fragment."""
    p = Parts(trim(url))
    return F.when(p.valid & (p.user == "") & (p.fragment == ""), F.concat(p.origin, p.bare_path, p.query))


def accepted_url(url: Column) -> Column:
    """For messages: as serialised, fragment included. Null if no http(s) URL."""
    p = Parts(trim(url))
    user = F.when(p.user == "", "").otherwise(F.concat(p.user, F.lit("@")))
    return F.when(p.valid, F.concat(p.scheme, F.lit("://"), user, p.host, p.port, p.path, p.query, p.fragment))


def editorial_url(url: Column) -> Column:
    """For comparing content: tracking parameters dropped, the rest sorted by name; a name that occurs n times has each of its values n times."""
    p = Parts(trim(url))
    pairs = F.filter(F.split(F.substring(p.query, 2, 1_000_000), "&"), lambda x: x != "")
    name = lambda x: F.split(x, "=", 2)[0]
    tracks = lambda x: F.lower(name(x)).isin(*TRACKING) | F.lower(name(x)).rlike(f"^({'|'.join(TRACKING_PREFIXES)})")
    kept = F.filter(pairs, lambda x: ~tracks(x))
    names = F.array_sort(F.transform(kept, name))
    full = F.transform(names, lambda n: F.array_join(F.transform(F.filter(kept, lambda x: name(x) == n), lambda x: F.when(F.contains(x, F.lit("=")), x).otherwise(F.concat(x, F.lit("=")))), "&"))
    path = F.when(F.size(kept) == 0, p.bare_path).otherwise(p.path)
    query = F.when(F.size(kept) == 0, "").otherwise(F.concat(F.lit("?"), F.array_join(full, "&")))
    return F.when(p.valid, F.concat(p.origin, path, query)).otherwise(trim(url))
