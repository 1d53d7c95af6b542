"""Personal data: patterns propose spans, checksums confirm them, context words nearby adjust the score.

Spans count code points, end exclusive. Kinds, in the order of the output:

* email, ip, card, phone: the base kinds. What matches the pattern and passes the check is always reported.
* iban: country code, check digits and as many characters as the country's codes have (11 to 30 for other countries), whose
  number modulo 97 is 1.
* account: 9 to 19 digits that no other span holds, reported only where words such as "card" or "account" stand nearby.

Every candidate starts at its kind's prior, gains CONFIRMED for a passed check (Luhn, modulo 97, ranges, lengths) and CONTEXT
for a word of its kind within WINDOW code points, 1 at most; added kinds are reported from THRESHOLD on. Null and empty texts
have no spans, an empty table gives an empty one, and other columns are ignored. Every scan is linear in the text, however
long it is.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "account")
THRESHOLD, WINDOW = 0.6, 40

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?= ?[A-Z0-9])")
# Lengths of account codes by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_IBAN_REST = {n: re.compile(rf"(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in {*IBAN_LENGTHS.values()}} | {0: re.compile(r"(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")}
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9])++")
_SOME = re.compile(r"[0-9@]")
#: Words that make what stands near them more likely to be personal.
CONTEXT_WORDS = {
    "email": r"e-?mail|mail|contact|courriel|correo|kontakt",
    "ip": r"ip|address|host|server|login|adresse|dirección",
    "card": r"card|credit|debit|visa|mastercard|carte|karte|tarjeta|payment",
    "phone": r"phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": r"iban|account|konto|compte|cuenta|bank",
    "account": r"card|credit|account|konto|compte|cuenta|iban|passport|ssn|tax id",
}
_CONTEXT = {k: re.compile(rf"\b(?:{v})\b", re.I) for k, v in CONTEXT_WORDS.items()}
PRIOR = {"email": 0.5, "ip": 0.3, "card": 0.4, "phone": 0.4, "iban": 0.4, "account": 0.2}
CONFIRMED, CONTEXT = 0.4, 0.45


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account code without blanks has the remainder 1."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    out, past, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            past = m.end()
        at = text.find("@", max(at + 1, past))
        past = max(past, 0)
    return out


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _phones(text: str) -> list[tuple[int, int]]:
    out, at = [], text.find("+")
    while at >= 0:
        if m := _PHONE.match(text, at):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((at, m.end()))
            at = text.find("+", m.end())
        else:
            at = text.find("+", at + 1)
    return out


def _ibans(text: str) -> list[tuple[int, int]]:
    out, past = [], 0
    for m in _IBAN.finditer(text):
        rest = _IBAN_REST[IBAN_LENGTHS.get(m[1], 0)].match(text, m.end()) if m.start() >= past else None
        if rest and mod97(text[m.start() : rest.end()].replace(" ", "")):
            out.append((m.start(), rest.end()))
            past = rest.end()
    return out


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind as in KINDS, then by start."""
    if not text or not _SOME.search(text):
        return []
    out = [("email", a, b, _score("email", text, a, b, True)) for a, b in _emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return out
    out += [("ip", m.start(), m.end(), _score("ip", text, m.start(), m.end(), True)) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end(), _score("card", text, m.start(), m.end(), True)))
    if "+" in text:
        out += [("phone", a, b, _score("phone", text, a, b, True)) for a, b in _phones(text)]
    for a, b in _ibans(text):
        score = _score("iban", text, a, b, True)
        if score >= THRESHOLD:
            out.append(("iban", a, b, score))
    held = sorted((a, b) for _, a, b, _ in out)
    i, reach = 0, 0
    for m in _ACCOUNT.finditer(text):
        while i < len(held) and held[i][0] < m.end():
            reach, i = max(reach, held[i][1]), i + 1
        before, after = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
        if reach <= m.start() and 9 <= len(_digits(m[0])) <= 19 and not re.search("[A-Za-z.+-]", before) and not after.isalpha():
            score = _score("account", text, m.start(), m.end(), False)
            if score >= THRESHOLD:
                out.append(("account", m.start(), m.end(), score))
    return out


def _score(kind: str, text: str, start: int, end: int, confirmed: bool) -> float:
    near = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]
    return min(1.0, PRIOR[kind] + CONFIRMED * confirmed + CONTEXT * bool(_CONTEXT[kind].search(near)))


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; spans that overlap are replaced together, by each of their kinds once."""
    if not text:
        return text
    held: list[tuple[int, int, list[str]]] = []
    for kind, a, b, _ in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if held and a < held[-1][1]:
            start, end, kinds = held[-1]
            held[-1] = (start, max(end, b), kinds if kind in kinds else [*kinds, kind])
        else:
            held.append((a, b, [kind]))
    out, past = [], 0
    for a, b, kinds in held:
        out += [text[past:a], *(f"<{k}>" for k in kinds)]
        past = b
    return "".join([*out, text[past:]]) if held else text


_SPANS = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in BASE]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType()), T.StructField("top_score", T.DoubleType())]
)


@F.pandas_udf(_SPANS)
def _found(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        spans = find(text)
        base = [s for s in spans if s[0] in BASE]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in base)
        rows.append((*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(joined.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans), len(spans), max((s[3] for s in spans), default=0.0)))
    return pd.DataFrame(rows, columns=_SPANS.names)


@F.pandas_udf(T.StringType())
def _redacted(texts: pd.Series) -> pd.Series:
    return texts.map(redact, na_action="ignore")


def spans(text: Column) -> Column:
    """Struct of counts, digest and list of the spans of a text column."""
    return _found(text)


def redacted(text: Column) -> Column:
    return _redacted(text)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts, digest and spans of every row; repeated rows give repeated results, other columns are ignored."""
    return docs.select("doc_id", _found(F.col("text").cast("string")).alias("found")).select("doc_id", "found.*")
