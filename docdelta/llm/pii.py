r"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Base kinds (leftmost, non-overlapping within each kind, failing matches dropped without retries):

* email, `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`
* ip, four dotted numbers of at most 255
* card, 13 to 19 digits, single blanks or hyphens between, passing Luhn
* phone, `\+[0-9][\x20().0-9-]+[0-9]` with 9 to 15 digits

Scored kinds, added to those when their score reaches MIN_SCORE:

* iban, two letters, two check digits and 11 to 30 more, remainder 1 modulo 97; the candidate ends
  where its country's length is reached, or at the last place that passes where the country has none
* ssn, three, two and four digits with hyphens, which needs a context word
* secret, 20 characters or more of a key or token, letters and digits mixed, which needs one too
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from docdelta.llm.common import mapped, quoted

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
MIN_SCORE = 0.6
#: Code points on either side of a span in which context words count.
NEAR = 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive runs and the look-behind leave the matches as they are: where one fails at the first
# digit of a run it fails at the later ones. They keep long runs of digits linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}))")
#: Characters of an IBAN by country, as its registry has them.
_IBAN_LENGTHS = {
    k: n
    for n, each in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for k in each.split()
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}")

#: Score of a span that its checksum confirms, or that has none, and what a context word adds.
SCORES = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.7, "iban": 0.7, "ssn": 0.4, "secret": 0.4}
BONUS = 0.25
CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|credit|karte|carte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security)\b", re.I),
    "secret": re.compile(r"\b(?:token|secret|password|passwd|api[ _-]?key|access[ _-]?key|bearer|authorization|contraseña|passwort|mot de passe)\b", re.I),
}


def digits(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(number)):
        n = int(x) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return int("".join(str(int(x, 36)) for x in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Goes from one @ to the next, so that long runs without one cost nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)


def _matches(pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in pattern.finditer(text))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    for m in _IBAN.finditer(text):
        if m.start() < free:
            continue
        ends = [i + 1 for i in range(m.start(), m.end(1)) if text[i] != " " and not (text[i + 1 : i + 2].isascii() and text[i + 1 : i + 2].isalnum())]
        size = {end: len(text[m.start() : end].replace(" ", "")) for end in ends}
        wanted = _IBAN_LENGTHS.get(m[0][:2])
        for end in reversed(ends):
            if (size[end] == wanted if wanted else size[end] >= 15) and mod97(text[m.start() : end]):
                yield m.start(), end
                free = end
                break


def _mixed(text: str) -> bool:
    """Letters and digits, several of either: no long word and no number."""
    found = sum(x.isdigit() for x in text)
    return found >= 3 and sum(x.isalpha() for x in text) >= 3


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds in the order of BASE, then by start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if "." in text:
        out += [("ip", a, b) for a, b in _matches(_IP, text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in text[a:b].split("."))]
    out += [("card", a, b) for a, b in _matches(_CARD, text) if b - a >= 13 and 13 <= len(n := digits(text[a:b])) <= 19 and luhn(n)]
    if "+" in text:
        out += [("phone", a, b) for a, b in _matches(_PHONE, text) if 9 <= len(digits(text[a:b])) <= 15]
    return out


def score(kind: str, text: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}"
    return min(1.0, SCORES[kind] + BONUS * bool(CONTEXT[kind].search(near)))


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all kinds in the order of KINDS, then by start; base ones always stay."""
    if not text:
        return []
    out = [(kind, a, b, score(kind, text, a, b)) for kind, a, b in base_spans(text)]
    out += [("iban", a, b, s) for a, b in _ibans(text) if (s := score("iban", text, a, b)) >= MIN_SCORE]
    if "-" in text:
        out += [("ssn", a, b, s) for a, b in _matches(_SSN, text) if (s := score("ssn", text, a, b)) >= MIN_SCORE]
    out += [("secret", a, b, s) for a, b in _matches(_SECRET, text) if _mixed(text[a:b]) and (s := score("secret", text, a, b)) >= MIN_SCORE]
    return out


def joined(found: list[tuple]) -> str:
    return ",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in found)


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row of docs with found, an array of (kind, start, end, score), before its own columns.

    Places are code points, ends exclusive. A null or empty text has none. Repeated rows stay. A
    column named found is returned as found_input.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def find(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([[dict(zip(("kind", "start", "end", "score"), y, strict=True)) for y in spans(x)] for x in texts.to_pylist()], kind)]

    out = StructType.fromDDL("found array<struct<kind: string, start: long, end: long, score: double>>")
    return mapped(docs, [quoted(text_col)], out, lambda: find)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
