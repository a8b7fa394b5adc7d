"""Personal data in texts: expressions propose spans, check digits confirm them, context words adjust the score."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in the order of their spans; the first four are always reported, the others from THRESHOLD on.
BASE, KINDS, THRESHOLD = ("email", "ip", "card", "phone"), ("email", "ip", "card", "phone", "iban", "ssn"), 0.5
#: Score of a confirmed span, and what a context word near it adds.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
NEAR, BONUS = 40, 0.2
CONTEXT = {
    "email": re.compile(r"\b(e-?mail|mail|contact|write)\b", re.I),
    "ip": re.compile(r"\b(ip|server|host|address)\b", re.I),
    "card": re.compile(r"\b(card|visa|mastercard|amex|credit|debit)\b", re.I),
    "phone": re.compile(r"\b(phone|tel|call|mobile|fax)\b", re.I),
    "iban": re.compile(r"\b(iban|account|bank|konto|compte|cuenta)\b", re.I),
    "ssn": re.compile(r"\b(ssn|social security)\b", re.I),
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does: the look-behind keeps long runs linear and changes no match.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """The leftmost matches of local@domain, from each sign @ outwards, in linear time."""
    found, end, sign = [], 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < sign and (domain := _DOMAIN.match(text, sign + 1)):
            end = domain.end()
            found.append((start, end))
        else:
            end = max(end, sign + 1)
        sign = text.find("@", max(end, sign + 1))
    return found


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def candidates(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind that their validators confirm, in code points."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    found["email"] = _emails(text)
    if not _DIGIT.search(text):
        return found
    small = lambda part: len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
    found["card"] = [m.span() for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    found["iban"] = [m.span() for m in _IBAN.finditer(text) if 15 <= len(c := m[0].replace(" ", "")) <= 34 and mod97(c)]
    found["ssn"] = [m.span() for m in _SSN.finditer(text) if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"]
    return found


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start; a context word within NEAR code points raises the score."""
    out = []
    for kind, own in candidates(text).items():
        for start, end in own:
            near = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
            score = round(min(1.0, SCORES[kind] + BONUS * bool(CONTEXT[kind].search(near))), 2)
            if kind in BASE or score >= THRESHOLD:
                out.append((kind, start, end, score))
    return out


SPANS = "array<struct<kind: string, start: bigint, end: bigint, score: double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_personal_data(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """docs with the column `out`: the spans of personal data in each whole text.

    Starts and ends are code points, ends exclusive; spans of different kinds may overlap. Null and empty texts have none.
    Each row is looked at on its own, so repeated rows get equal spans; other columns stay, one named `out` is replaced;
    an empty table stays empty. All expressions run in linear time on very long texts.
    """

    @F.arrow_udf(SPANS)
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans(t.as_py())] for t in texts], _ARROW)

    return docs.select(*[c for c in docs.columns if c != out], find.asNondeterministic()(F.coalesce(F.col(text_col), F.lit(""))).alias(out))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of personal data replaced by its kind in angle brackets; overlapping spans become one."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            text, at, parts = t.as_py(), 0, []
            for kind, start, end, _ in sorted(spans(text or ""), key=lambda s: s[1:3]):
                if start >= at:
                    parts += [text[at:start], f"<{kind}>"]
                at = max(at, end)
            out.append(text if text is None else "".join([*parts, text[at:]]))
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, cut(F.col(text_col)))
