"""Event signals of an article, and their comparison with a dossier's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import AFTER, ALNUM, BEFORE, OTHER, WS, cased, collapse, collect_text, fold_case, js, normalize_token, once, plain_letters
from tidewire.functions.urls import matching_url

# Fixed values, down to the day and length limits: tiers from best to worst; announcement natures with their words, the first
# match counts; organisations in the order in which they are looked for; labels that are no entities; natures that exclude
# each other; patterns of versions, proper names, dates, regions, prices, availability and status.
TIERS = "SABCDE"
NATURES = {
    "denial": r"\b(deny|denies|denied|démenti|dementi|false\s+rumor)\b",
    "correction": r"\b(corrects?|correction|erratum|clarif(?:y|ies|ication))\b",
    "acquisition": r"\b(acqui(?:re|res|red|sition)|buys?|bought|merger)\b",
    "paper": r"\b(paper|arxiv|preprint|research\s+study|publie(?:r|d)?\s+une?\s+étude)\b",
    "launch": r"\b(launch(?:es|ed)?|unveils?|introduces?|annonce|announces?|announced|releases?\s+new|sortie)\b",
    "update": r"\b(update[sd]?|upgrades?|improves?|mise\s+[àa]\s+jour|changelog)\b",
    "availability": r"\b(generally\s+available|ga\b|public\s+preview|waitlist|available\s+in|disponible)\b",
}
ORGS = ("openai", "anthropic", "google", "deepmind", "meta", "microsoft", "amazon", "aws", "nvidia", "mistral", "cohere", "huggingface", "hugging face", "xai", "apple", "ibm", "stability ai", "perplexity", "databricks")
STOP = ("ai", "the", "a", "an", "new", "update", "release", "model", "models", "why", "week", "this", "how", "what", "when", "industry", "notes", "matters")
EXCLUSIVE = ("acquisition|launch", "acquisition|paper", "acquisition|availability", "launch|paper")
NAMED_VERSION = r"\b((?:gpt|claude|gemini|llama|mistral|command|grok)[-\s]?\d+(?:\.\d+)?[a-z0-9-]*)\b"
PLAIN_VERSION = r"\bv?(\d+\.\d+(?:\.\d+)?(?:-[a-z0-9.]+)?)\b"
PROPER = r"\b[A-Z][A-Za-z0-9]*(?:[-\s][A-Z][A-Za-z0-9]*){0,3}\b"
EVENT_DATE = r"\b(on|effective|starting|available)\s+(\d{4}-\d{2}-\d{2}|\d{1,2}\s+[A-Z][a-z]+\s+\d{4})\b"
REGION = r"\b(?:available|disponible)\s+in\s+([A-Z][A-Za-z(?:\s|,|/|&)]{1,40})"
PRICE = r"(?:\$|€|£)\s?(\d+(?:[.,]\d+)?)|(?:price[d]?|pricing)\s*(?:of|:)?\s*\$?\s?(\d+(?:[.,]\d+)?)"
FLAGS = [
    ("availability:ga", "ga", r"\b(generally\s+available|\bga\b)\b"),
    ("availability:preview", "preview", r"\b(public\s+preview|preview)\b"),
    ("availability:waitlist", "waitlist", r"\bwaitlist\b"),
]
STATUSES = [
    ("status:delayed", "delayed", r"\b(delay(?:ed)?|postponed|reporté)\b"),
    ("status:cancelled", "cancelled", r"\b(cancel(?:led|ed)?|annul[ée])\b"),
    ("status:confirmed", "confirmed", r"\b(confirm(?:s|ed)?|confirmation)\b"),
]
#: Beginnings of the words without which a pattern does not match, none of them the beginning of another; a text is looked through once for all of them.
STEMS = {
    "denial": ("den", "dém", "dem", "false"), "correction": ("correct", "erratum", "clarif"), "acquisition": ("acqui", "buy", "bought", "merger"), "paper": ("paper", "arxiv", "preprint", "research", "publi"),
    "launch": ("launch", "unveil", "introduce", "annonce", "announce", "release", "sortie"), "update": ("update", "upgrade", "improve", "mise", "changelog"), "availability": ("generally", "ga", "publi", "waitlist", "available", "disponible"),
    "availability:ga": ("generally", "ga"), "availability:preview": ("publi", "preview"), "availability:waitlist": ("waitlist",), "region": ("available", "disponible"), "named": ("gpt", "claude", "gemini", "llama", "mistral", "command", "grok"),
    "status:delayed": ("delay", "postponed", "report"), "status:cancelled": ("cancel", "annul"), "status:confirmed": ("confirm",),
}
#: Stems that count only before something; what is not of a word there is left for the next stem to begin after.
_WHOLE = {"ga": f"ga{AFTER}", "report": "report(?=é)"}


def _by_first(stems: list[str]) -> str:
    """What is not of a word and then, as group 1, one of the stems; those with the same first letter are tried together."""
    letters = sorted({s[0] for s in stems})
    return r"\W(" + "|".join(f"{c}(?:{'|'.join(_WHOLE.get(s, s)[1:] for s in stems if s[0] == c)})" for c in letters) + ")"


_STEMS = _by_first(sorted({s for of in STEMS.values() for s in of}))
#: Characters that a match begins with: places with any other are passed over before the pattern is tried there, regardless of case.
_FIRST = {PLAIN_VERSION: "vV0-9", EVENT_DATE: "oOeEsS\u017FaA"}
#: What else a pattern cannot do without, in text of one case.
_NUMBERS, _PRICED, _DATED = "[0-9][.][0-9]", ("$", "€", "£", "pric"), f"[0-9](?<=[neg{WS}][{WS}][0-9])"
#: PRICE by the character that it begins with.
_PRICE = js(PRICE, False).replace(r"(?:\$|€|£)", "[$€£](?iu:", 1).replace("|(?:price[d]?|pricing)", ")|[pP](?iu:(?:rice[d]?|ricing)", 1) + ")"
PROXIMITY_DAYS, TOKEN_LENGTH, TEXT_LENGTH = 14, 2, 12


def tier_rank(tier: Column) -> Column:
    """6 for the best tier, 1 for the worst, null for others."""
    return reduce(lambda x, i: x.when(tier == TIERS[i], F.lit(6 - i)), range(6), F.when(F.lit(False), F.lit(0)))


def _anchored(pattern: str) -> str:
    """js() of a pattern with a known first character."""
    return f"(?=[{_FIRST[pattern]}])(?iu:{js(pattern, False)})"


class Seen:
    """What a text shows at first sight: the text in one case, and which of the words it has that patterns begin with. Each as a column of its own, so that it is computed once."""

    def __init__(self, folded: Column, stems: Column):
        self.folded, self.stems = folded, stems

    @staticmethod
    def of(text: Column) -> Seen:
        folded = fold_case(text)
        return Seen(folded, Seen.stems_of(folded))

    @staticmethod
    def stems_of(folded: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.concat(F.lit(" "), folded), F.lit(_STEMS), F.lit(1)))

    def may(self, kind: str) -> Column:
        return F.arrays_overlap(self.stems, F.array(*(F.lit(s) for s in STEMS[kind])))

    def matches(self, kind: str, pattern: str) -> Column:
        return self.may(kind) & self.folded.rlike(cased(pattern))


def _label(found: Column) -> Column:
    """The label of what a pattern found, null if it is empty. The search and the label are named more than once in what they are put into, so each is held."""
    return once(once(found, normalize_token), lambda x: F.nullif(x, F.lit("")))


def version(text: Column, seen: Seen | None = None) -> Column:
    seen = seen or Seen.of(text)
    found = lambda p: _label(F.regexp_extract(text, p, 1))
    # a name counts with a number after it alone
    numbered = reduce(lambda x, y: x | y, (F.contains(seen.folded, F.lit(n)) & seen.folded.rlike(f"{n}[-{WS}]?[0-9]") for n in STEMS["named"]))
    return F.coalesce(F.when(seen.may("named") & numbered, found(js(NAMED_VERSION))), F.when(seen.folded.rlike(_NUMBERS), found(_anchored(PLAIN_VERSION))))


def nature(text: Column, seen: Seen | None = None) -> Column:
    seen = seen or Seen.of(text)
    named = reduce(lambda x, kv: x.when(seen.matches(*kv), F.lit(kv[0])), NATURES.items(), F.when(F.lit(False), F.lit("")))
    return named.otherwise("other")


def product(text: Column, plain: Column | None = None) -> Column:
    """The first organisation whose name is contained in the label of the text, inside a word or not. plain: plain_letters() of the text, in which a name of one word is where it is in the label."""
    plain = plain_letters(text) if plain is None else plain

    def has(org: str) -> Column:
        first, *more = org.split(" ")
        return F.contains(plain, F.lit(first)) & plain.rlike(f"{OTHER}+".join((first, *more))) if more else F.contains(plain, F.lit(org))

    return reduce(lambda x, org: x.when(has(org), F.lit(org)), ORGS, F.when(F.lit(False), F.lit("")))


#: PROPER with its first letter looked for before what stands in front of it.
_PROPER = js(PROPER, False).replace(f"{BEFORE}[A-Z]", r"[A-Z](?<!\w[A-Z])", 1).replace("[A-Za-z0-9_]", r"\w").replace("[A-Za-z0-9]", ALNUM)


def entities(text: Column, of_product: Column, of_version: Column) -> Column:
    """Names hold ASCII letters, digits, hyphens and blanks alone, so that they are put into the form of labels all at once."""
    raw = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({_PROPER})"), F.lit(1)))
    proper = F.split(F.regexp_replace(F.lower(F.array_join(raw, "|")), "[^a-z0-9|-]+", " "), r"\|")
    proper = F.filter(F.array_distinct(proper), lambda t: (F.length(t) >= TOKEN_LENGTH) & ~t.isin(*STOP))
    return F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(of_product, of_version)), proper)))


def fact_values(text: Column, seen: Seen | None = None) -> dict[str, Column]:
    """What facts() reads from the text, each pattern looked for once."""
    seen = seen or Seen.of(text)
    found = lambda p, i: once(F.regexp_extract(text, p, i), lambda x: F.when(x != "", normalize_token(x)))
    price = F.regexp_replace(F.regexp_extract(text, _PRICE, 0), r"^[^0-9]*", "")
    return {"event_date": F.when(seen.folded.rlike(_DATED), found(_anchored(EVENT_DATE), 2)), "region": F.when(seen.may("region"), found(js(REGION), 1)), "price": F.when(reduce(lambda x, y: x | y, (F.contains(seen.folded, F.lit(p)) for p in _PRICED)), _label(price))}


def facts(text: Column, of_nature: Column, of_version: Column, values: dict[str, Column] | None = None, seen: Seen | None = None) -> Column:
    """Array of (key, value) in a fixed order. values: those of fact_values(), as columns of their own where each is to be computed once."""
    seen = seen or Seen.of(text)
    values = fact_values(text, seen) if values is None else values
    fact = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    keyed = lambda prefix, value: F.when(value.isNotNull(), fact(F.concat(F.lit(prefix), value), value))
    flag = lambda rule: F.when(seen.matches(rule[0], rule[2]), fact(F.lit(rule[0]), F.lit(rule[1])))
    return F.array_compact(F.array(
        keyed("version:", of_version), keyed("event_date:", values["event_date"]), *map(flag, FLAGS), keyed("region:", values["region"]),
        keyed("price:", values["price"]), *map(flag, STATUSES),
        F.when(of_nature == "denial", fact(F.lit("correction:denial"), F.lit("denial"))),
        F.when(of_nature == "correction", fact(F.lit("correction:erratum"), F.lit("correction"))),
    ))


def categories(labels: Column) -> Column:
    return F.array_sort(F.filter(F.transform(labels, normalize_token), lambda t: t != ""))


def with_signals(articles):
    """Articles with the columns of their fingerprint; every pattern is evaluated once per article, never per pair."""
    text, seen = F.col("_text"), Seen(F.col("_folded"), F.col("_stems"))
    read = articles.withColumn("_text", collect_text(F.col("title"), F.col("summary"), F.col("content"))).withColumn("_folded", fold_case(text)).withColumns({"_stems": Seen.stems_of(seen.folded), "_plain": plain_letters(text)})
    values = fact_values(text, seen)
    base = read.withColumns({"version": version(text, seen), "nature": nature(text, seen), "product": product(text, F.col("_plain"))} | {f"_{k}": v for k, v in values.items()})
    full = base.withColumns({
        "entities": entities(text, F.col("product"), F.col("version")), "facts": facts(text, F.col("nature"), F.col("version"), {k: F.col(f"_{k}") for k in values}, seen),
        "labels": categories(F.col("categories")), "canonical": matching_url(F.col("url")),
    })
    known = (F.size("entities") > 0) | F.col("product").isNotNull() | (F.col("nature") != "other") | F.col("version").isNotNull()
    long = lambda x: F.length(collapse(x)) >= TEXT_LENGTH
    # what a beginning collapses to is the beginning of what the whole does
    enough = F.when(long(F.substring(text, 1, 16 * TEXT_LENGTH)), True).otherwise(long(text))
    return full.withColumn("primary", enough & known).drop("_text", "_folded", "_stems", "_plain", *(f"_{k}" for k in values))


def exclusive(a: Column, b: Column) -> Column:
    """Whether two natures cannot be of one event."""
    return F.coalesce(F.concat_ws("|", F.least(a, b), F.greatest(a, b)).isin(*EXCLUSIVE) & a.isNotNull() & b.isNotNull(), F.lit(False))


def enrichment_type(of_nature: Column, keys: Column) -> Column:
    has = lambda prefix: F.exists(keys, lambda k: k.startswith(prefix))
    return F.when(of_nature.isin("denial", "correction"), "correction").when(has("status:"), "status_change").when(has("availability:"), "availability").when(has("version:"), "version").otherwise("fact_update")


# Names of what speaks for and against a match, by code point; a pair's are held as bits of a number.
FAVORABLE = ("category_overlap", "higher_source_tier", "same_announcement_nature", "same_canonical_url", "same_entities", "same_product_org", "same_version", "temporal_proximity")
UNFAVORABLE = ("different_entities", "different_product_org", "different_version", "incompatible_announcement_nature", "insufficient_event_identity", "theme_or_category_only")


def named(bits: Column, names: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*(F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names))))


def compare(a: dict[str, Column], f: dict[str, Column], url: Column, ent: Column, cat: Column) -> dict[str, Column]:
    """blocked, level, favorable and unfavorable (as bits) of an article a against a fingerprint f; both have product, nature, version, date (ms), tier and some (whether there are entities). url, ent, cat: whether they share a URL, an entity, a label."""
    true = lambda c: F.coalesce(c, F.lit(False))
    prod, ver = true(a["product"] == f["product"]), true(a["version"] == f["version"])
    nat = true((a["nature"] == f["nature"]) & (a["nature"] != "other"))
    near = true(F.abs(a["date"] - f["date"]) <= PROXIMITY_DAYS * 86_400_000)
    higher = true(tier_rank(a["tier"]) > tier_rank(f["tier"]))
    anchored = a["product"].isNotNull() | f["product"].isNotNull() | a["version"].isNotNull() | f["version"].isNotNull()
    others = ~ent & a["some"] & f["some"] & ~prod & anchored
    product, release, kind = true(a["product"] != f["product"]), true(a["version"] != f["version"]), exclusive(a["nature"], f["nature"])
    blocked = others | product | release | kind
    strong = url | (ent & nat & ver) | (prod & nat & ver) | (ent & ver & prod)
    medium = (ent & nat) | (ent & ver) | (prod & nat & near) | url
    weak = ent | prod | cat | near
    theme = ~ent & ~prod & ~nat & ~ver & ~url
    level = F.when(blocked, 0).when(strong, 3).when(medium, 2).when(weak, 1).otherwise(0)
    bits = lambda flags: reduce(lambda x, y: x + y, (c.cast("int") * (1 << i) for i, c in enumerate(flags)))
    vague = ~blocked & ~strong & ~medium & weak & theme
    return {"blocked": blocked, "level": level, "favorable": bits((cat, higher, nat, url, ent, prod, ver, near)), "unfavorable": bits((others, product, release, kind, vague, vague))}


def novel_keys(own: Column, known: Column) -> Column:
    return F.filter(F.array_except(own, known), lambda k: ~k.startswith("url:") & ~k.startswith("date:"))
