"""Text functions with the semantics of ECMAScript strings, as Spark columns."""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of ECMAScript, and its ASCII word boundary.
WS = r"\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
BEFORE, AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
ZWSP = "​"


def _class(characters: str, but: bool = False) -> str:
    """A class that names each character: Java looks those up in a table, while it tries ranges one by one. but: one of all others."""
    return ("[^" if but else "[") + "".join(f"\\x{{{ord(c):x}}}" for c in characters) + "]"


ALNUM = _class(string.ascii_letters + string.digits)
#: What labels are not made of.
OTHER = _class(string.ascii_lowercase + string.digits + ".+-", but=True)


def js(pattern: str, ignore_case: bool = True) -> str:
    """A Java pattern that matches what the ECMAScript pattern does: ASCII boundaries, Unicode blanks, case by code point."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair == r"\b" and not inside:
            # Next to a letter of a word one side of the boundary is known; after an accented one it is not.
            after = pattern[i + 2 : i + 3]
            out.append(BEFORE if after.isalnum() or after in ("(", "[") else EDGE if re.search(r"é[\])]+$|\[[^\]]*é[^\]]*\]\)*$", pattern[:i]) else AFTER)
        elif pair == r"\s":
            out.append(WS if inside else f"[{WS}]")
        elif pair == r"\S":
            out.append(f"[^{WS}]")
        elif pair[0] == "\\":
            out.append(pair)
        else:
            inside = pair[0] == "[" or inside and pair[0] != "]"
            out.append(pair[0])
            i -= 1
        i += 2
    return ("(?iu)" if ignore_case else "") + "".join(out)


def cased(pattern: str) -> str:
    """js() for text in one case, or of a pattern that minds case: word characters are looked up, not tried range by range, and where the pattern begins with a word its first letters are looked for before what stands in front of it."""
    made = js(pattern, False).replace("[A-Za-z0-9_]", r"\w")
    before = BEFORE.replace("[A-Za-z0-9_]", r"\w")
    if not made.startswith(before):
        return made
    rest = made[len(before) :]
    if "|" not in _top(rest) and re.match(r"[a-z](?![?*{])", rest):
        return f"{rest[0]}(?<!\\w{rest[0]}){rest[1:]}"
    return f"(?=[{''.join(firsts)}]){made}" if (firsts := _firsts(rest)) else made


def _top(pattern: str) -> str:
    """What of a pattern stands outside of groups."""
    depth, out = 0, []
    for c in pattern:
        depth -= c == ")"
        out.append(c if not depth else "")
        depth += c == "("
    return "".join(out)


def _firsts(pattern: str) -> list[str]:
    """Letters that a pattern begins with, if it is a group of words and what follows them; none if that is not clear."""
    head = re.match(r"\((?:\?:)?(?=[a-z])", pattern)
    if not head or "|" in _top(pattern):
        return []
    depth, body = 0, []
    for at, c in enumerate(pattern[head.end() :], head.end()):
        depth += (c == "(") - (c == ")")
        if depth < 0:
            break
        body.append("\n" if c == "|" and not depth else c)
    words = "".join(body).split("\n")
    return sorted({w[0] for w in words}) if all(re.match(r"[a-z](?![?*{])", w) for w in words) and pattern[at + 1 : at + 2] not in ("?", "*", "{") else []


def _folding() -> tuple[str, str, dict[str, str]]:
    """By compatibility decomposition without marks: characters that become one ASCII character, and those that become several."""
    source, target, longer = [], [], {}
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), 0x2026, 0x2122, *range(0xFB00, 0xFB05), *range(0xFF01, 0xFF5F)]:
        plain = "".join(c if c.isascii() else " " for c in unicodedata.normalize("NFKD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if len(plain) == 1 and plain != " ":
            source.append(chr(code))
            target.append(plain)
        elif plain.strip():
            longer[chr(code)] = plain
    return "".join(source), "".join(target), longer


_FROM, _TO, _LONGER = _folding()
#: Private characters that stand for those of _LONGER, so that one pass folds all; what a text itself has of them becomes a blank, as it would anyway.
_PRIVATE = {chr(0xE000 + i): text for i, text in enumerate(sorted(set(_LONGER.values())))}
_STANDS = {text: c for c, text in _PRIVATE.items()}
_FROM, _TO = _FROM + "".join(_PRIVATE) + "".join(_LONGER), _TO + " " * len(_PRIVATE) + "".join(_STANDS[v] for v in _LONGER.values())


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once, however often and in whichever branches f refers to it."""
    return F.transform(F.array(c), f)[0]


def _if_has(c: Column, mark: str, change: Callable[[Column], Column]) -> Column:
    """change(c) where the text has the mark, without which it would stay as it is."""
    return once(c, lambda x: F.when(F.contains(x, F.lit(mark)), change(x)).otherwise(x))


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def collapse(c: Column) -> Column:
    """White space to single blanks, none at the ends."""
    return F.btrim(F.regexp_replace(c, f"[{WS}]+", " "), F.lit(" "))


def normalize_token(c: Column) -> Column:
    """Label for comparisons: decomposed, marks dropped, lower case, all but letters, digits and . + - as one blank."""
    return F.btrim(F.regexp_replace(plain_letters(c), f"{OTHER}+", " "), F.lit(" "))


def plain_letters(c: Column) -> Column:
    """Text in lower case, letters without marks; all else of it stays."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(_decomposed(c))


#: All characters that decompose or are marks.
_MARKED = "[\\x{A0}-\\x{24F}\\x{300}-\\x{36F}\\x{1E00}-\\x{1EFF}\\x{2026}\\x{2122}\\x{E000}-\\x{F8FF}\\x{FB00}-\\x{FB04}\\x{FF01}-\\x{FF5E}]"


def _decomposed(c: Column) -> Column:
    """Text that is not all ASCII, lower-cased, without marks. Each character stands for itself, so those that a text has are replaced one after the other: a text has few of them, but translate() looks up each of its characters."""
    longer = f"[{min(_PRIVATE)}-{max(_PRIVATE)}]"

    def spelt(x: Column) -> Column:
        folded = F.translate(x, _FROM, _TO)
        return once(folded, lambda y: F.when(y.rlike(longer), reduce(lambda z, kv: F.replace(z, F.lit(kv[0]), F.lit(kv[1])), _PRIVATE.items(), y)).otherwise(F.regexp_replace(y, r"[\x{0300}-\x{036F}]", "")))

    found = F.array_distinct(F.regexp_extract_all(c, F.lit(_MARKED), F.lit(0)))
    return F.lower(F.aggregate(found, c, lambda whole, x: F.replace(whole, x, spelt(x))))


def fold_case(c: Column) -> Column:
    """Text in which patterns of lower-case letters match what js() matches regardless of case."""
    odd = reduce(lambda x, y: x | y, (F.contains(c, F.lit(o)) for o in "\u0131\u017F\u0130"))
    return F.lower(F.when((F.octet_length(c) != F.length(c)) & odd, F.translate(c, "\u0131\u017F\u0130", "isi")).otherwise(c))


def collect_text(title: Column, summary: Column, content: Column) -> Column:
    return trim(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit("")), F.coalesce(content, F.lit(""))))


# Named entities that are decoded; all others are dropped.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def strip_html(c: Column) -> Column:
    """Comments and tags become blanks, entities are decoded once, from left to right; text inside script and style stays."""
    bare = _if_has(c, "<", lambda x: F.regexp_replace(F.regexp_replace(x, r"<!--[\s\S]*?-->", " "), r"</?[a-zA-Z][^>]*>", " "))
    return _if_has(bare, "&", _entities_decoded)


def _entities_decoded(plain: Column) -> Column:
    entity = "&(?:#[xX]?[0-9a-fA-F]+|[a-zA-Z]+);"
    found = F.regexp_extract_all(plain, F.lit(f"({entity})"), F.lit(1))
    return once(F.split(plain, entity, -1), lambda between: F.concat(F.element_at(between, 1), F.array_join(F.zip_with(F.transform(found, _decoded), F.slice(between, 2, F.greatest(F.size(between) - 1, F.lit(0))), lambda e, t: F.concat(e, t)), "")))


def _decoded(entity: Column) -> Column:
    body = F.lower(F.substring(entity, 2, 1_000_000))
    body = F.substring(body, F.lit(1), F.length(body) - 1)
    hexadecimal = F.conv(F.regexp_extract(body, "^#x([0-9a-f]{1,8})$", 1), 16, 10).cast("long")
    decimal = F.regexp_extract(body, "^#([0-9]{1,10})", 1).cast("long")
    code = F.when(body.startswith("#x"), hexadecimal).otherwise(decimal)
    # Spark's chr() knows Latin-1 only: write the code point as UTF-16 and decode it.
    high, low = F.floor((code - 0x10000) / 1024) + 0xD800, (code - 0x10000) % 1024 + 0xDC00
    unit = lambda n: F.lpad(F.hex(n.cast("long")), 4, "0")
    utf16 = F.when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(low)))
    valid = code.isNotNull() & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    numeric = F.when(valid, F.decode(F.unhex(utf16), "UTF-16BE")).otherwise(F.lit(""))
    named = reduce(lambda x, kv: x.when(body == kv[0], F.lit(kv[1])), ENTITIES.items(), F.when(F.lit(False), F.lit(""))).otherwise(F.lit(""))
    return F.when(body.startswith("#"), numeric).otherwise(named)


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{009F}]", "")


# Mention forms and what is put in their place.
MENTIONS = [("(?i)@everyone", f"@{ZWSP}everyone"), ("(?i)@here", f"@{ZWSP}here"), (r"<@!?(\d+)>", f"<@{ZWSP}$1>"), (r"<@&(\d+)>", f"<@&{ZWSP}$1>"), (r"<#(\d+)>", f"<#{ZWSP}$1>"), (r"@(\d{5,})", f"@{ZWSP}$1")]
#: What a pattern of each form begins with.
_SIGNS = ["@", "@", "<@", "<@&", "<#", "@"]


def neutralize_mentions(c: Column) -> Column:
    return reduce(lambda x, rule: _if_has(x, rule[0], lambda y: F.regexp_replace(y, *rule[1])), zip(_SIGNS, MENTIONS), c)


_LATIN_ODD = "<&@\t\r" + "".join(map(chr, [*range(9), 11, 12, *range(14, 32), *range(127, 161)]))
_WIDE_BLANKS = [c for c in _BLANKS if ord(c) > 0xA0]


def _plain(c: Column, keep_lines: bool) -> Column:
    """Whether sanitize() would change nothing of a text but blanks at its ends."""
    wide = F.when(c.rlike(f"[{min(_WIDE_BLANKS)}-{max(_WIDE_BLANKS)}]"), reduce(lambda x, b: x | F.contains(c, F.lit(b)), _WIDE_BLANKS, F.lit(False))).otherwise(F.lit(False))
    runs = F.contains(c, F.lit("  ")) | (F.contains(c, F.lit("\n\n\n")) if keep_lines else F.contains(c, F.lit("\n")))
    return ~(runs | wide | c.rlike(_class(_LATIN_ODD)))


def sanitize(c: Column, keep_lines: bool = False) -> Column:
    """Text for a message: no markup, no controls, no mention that would notify, white space collapsed."""
    edges = trim if keep_lines else lambda x: F.btrim(x, F.lit(" "))
    return once(c, lambda x: F.when(_plain(x, keep_lines), edges(x)).otherwise(_sanitized(x, keep_lines)))


def _sanitized(c: Column, keep_lines: bool) -> Column:
    out = neutralize_mentions(strip_controls(strip_html(c)))
    if not keep_lines:
        return collapse(out)
    blanks = WS.replace(r"\s", r"\t\f\x20")
    out = F.regexp_replace(F.regexp_replace(out, f"[{blanks}]+", " "), "\r\n?", "\n")
    return trim(F.regexp_replace(out, "\n{3,}", "\n\n"))


def truncate(c: Column, most: int) -> Column:
    """At most so many code points, the last one an ellipsis if something is cut off."""
    if most <= 0:
        return F.when(c.isNotNull(), F.lit(""))
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


# What a public message must not show.
SECRETS = [r"(?i)postgres(?:ql)?://\S+", r"(?i)Bearer\s+\S+", r"(?i)DISCORD_TOKEN\s*=\s*\S+", r"(?i)DATABASE_URL\s*=\s*\S+", "sk-[A-Za-z0-9_-]+"]


def redact(c: Column, most: int = 240) -> Column:
    """One line without secrets, cut to so many UTF-16 units."""
    plain = reduce(lambda x, p: F.regexp_replace(x, p, "[redacted]"), SECRETS, collapse(c))
    units = lambda x: F.length(x) + F.length(F.regexp_replace(x, r"[\x{0}-\x{FFFF}]", ""))
    bare = F.substring(plain, 1, most - 1)
    return F.when(units(plain) <= most, plain).otherwise(F.concat(F.when(units(bare) <= most - 1, bare).otherwise(F.regexp_extract(plain, rf"^(?:[\x{{0}}-\x{{FFFF}}]|[\x{{10000}}-\x{{10FFFF}}]){{0,{(most - 1) // 2}}}", 0)), F.lit("…")))
