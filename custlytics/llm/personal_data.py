"""Personal data: patterns propose spans, checksums confirm them, words nearby move their score.

Everything that holds digits is looked for inside runs of digits and their punctuation only, and addresses
around the @ sign, so that a text is passed over once, whatever it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from custlytics.llm.common import map_batches

#: Kinds of the base patterns, in the order that breaks ties, and the kinds that are added to them.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "national_phone", "ssn", "secret")
#: An added span counts from this score on.
LEAST_SCORE = 0.6
#: Characters before and after a span in which context words are looked for.
CONTEXT_CHARS = 40
#: Score of a pattern alone, and what a checksum or a context word adds.
PATTERN_SCORE = {"iban": 0.3, "national_phone": 0.4, "ssn": 0.4, "secret": 0.4}
#: A mark is something of the span's own: an area code in brackets, the prefix of a kind of key, the name it is given to.
CHECKED, IN_CONTEXT, MARKED = 0.5, 0.4, 0.3
#: What a word nearby takes that speaks against it.
AGAINST = 0.55

# Words that stand near such data.
CONTEXT_WORDS = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "national_phone": ("phone", "tel", "call", "mobile", "fax", "contact"),
    "ssn": ("ssn", "social security", "social-security"),
    "secret": ("token", "secret", "password", "passwd", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "bearer"),
}
# Words that stand near what only looks like such data.
OTHER_WORDS = {
    "national_phone": ("order", "invoice", "isbn", "tracking", "serial", "part no", "version"),
    "ssn": ("order", "invoice", "isbn", "tracking", "serial", "part no", "version"),
    "secret": ("example", "sample", "dummy", "placeholder", "redacted", "changeme", "checksum", "sha256", "sha-256", "sha1", "md5", "commit", "isbn", "version"),
}
_AGAINST = {kind: re.compile("|".join(rf"(?<![a-z]){re.escape(w)}" for w in words)) for kind, words in OTHER_WORDS.items()}
_CONTEXT = {kind: re.compile("|".join(rf"(?<![a-z]){re.escape(w)}" for w in words)) for kind, words in CONTEXT_WORDS.items()}

_DIGITS = re.compile(r"[0-9][0-9 ().-]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+")
#: Length of an IBAN by its country.
IBAN_CHARS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9])(?:\(?[2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])")
_SECRET = re.compile(r"""[=:]\s{0,3}["']?([A-Za-z0-9_/+-]{20,}+)""")
# Keys that tell their kind by how they begin, and values given to a name that says what they are.
_PREFIXED = re.compile(
    r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{20,}+|github_pat_[A-Za-z0-9_]{20,}+|glpat-[A-Za-z0-9_-]{16,}+"
    r"|xox[abeprs]-[A-Za-z0-9-]{10,}+|[prs]k_(?:live|test)_[A-Za-z0-9]{16,}+|sk-[A-Za-z0-9_-]{20,}+|AIza[A-Za-z0-9_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++)"
)
_NAMED = re.compile(
    r"""(?i:(?<![a-z])(?:pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|aws|private|secret)[ _-]?key|bearer)["']?\s{0,3}(?:[=:]|\bis\b|(?<=bearer)\s))"""
    r"""\s{0,3}["']?([^\s"',;<>]{8,}+)"""
)


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    base: bool


SPAN = "struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>"
_PA_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _up_to_255(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` from left to right: the part before an @
    is all that fits since the last match, and no shorter one could match."""
    free = 0
    at = text.find("@")
    while at >= 0:
        before = text[free:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - local, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def numbers(text: str) -> Iterator[tuple[str, int, int]]:
    """Base ips, cards and phones. All three lie inside runs of digits, blanks, dots, hyphens and
    parentheses, a phone right behind a plus sign."""
    for run in _DIGITS.finditer(text):
        start, part = run.start(), run.group()
        if len(part) < 4:
            continue
        if "." in part:
            for m in _IP.finditer(part):
                if all(_up_to_255(x) for x in m.group().split(".")):
                    yield "ip", start + m.start(), start + m.end()
        for m in _CARD.finditer(part):
            digits = _digits(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield "card", start + m.start(), start + m.end()
        if start and text[start - 1] == "+":
            number = part.rstrip(" ().-")
            if len(number) >= 3 and 10 <= len(_digits(number)) <= 15:
                yield "phone", start - 1, start + len(number)


def iban_end(text: str, start: int) -> int | None:
    """The end of the IBAN that begins at ``start``. Capitals and digits behind it may look like more of it:
    of the ends of words that pass the check, the one at the country's length counts, else the last."""
    m = _IBAN.match(text, start)
    if not m:
        return None
    ends, chars = {}, 0
    for at in range(start, m.end()):
        if text[at] != " ":
            chars += 1
            if chars >= 15 and text[at + 1 : at + 2] not in _ALNUM:
                ends[chars] = at + 1
    length = IBAN_CHARS.get(text[start : start + 2])
    for n in sorted(ends, key=lambda n: (n == length, n), reverse=True):
        if mod_97(text[start : ends[n]].replace(" ", "")):
            return ends[n]
    return None


def added(text: str) -> Iterator[tuple[str, int, int, float]]:
    """(kind, start, end, score without context) of spans beside the base ones."""
    for run in _DIGITS.finditer(text):
        start, part = run.start(), run.group()
        if len(part) >= 2 and start >= 2 and text[start - 2 : start].isascii() and text[start - 2 : start].isalpha() and text[start - 2 : start].isupper():
            if not (start >= 3 and text[start - 3].isalnum()) and (end := iban_end(text, start - 2)):
                yield "iban", start - 2, end, PATTERN_SCORE["iban"] + CHECKED
        if len(part) < 10:
            continue
        if "-" in part:
            for m in _SSN.finditer(part):
                yield "ssn", start + m.start(), start + m.end(), PATTERN_SCORE["ssn"]
        if not (start and text[start - 1] == "+"):
            opened = start and text[start - 1] == "("
            for m in _NATIONAL.finditer("(" + part if opened else part):
                first = start + m.start() - bool(opened)
                marked = MARKED if m.group().startswith("(") and ")" in m.group() else 0
                yield "national_phone", first, start + m.end() - bool(opened), PATTERN_SCORE["national_phone"] + marked
    upto = 0
    for start, end, marked in secrets(text):
        if end > upto:
            yield "secret", start, end, PATTERN_SCORE["secret"] + marked
            upto = end


def secrets(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score of the mark) of keys, tokens and passwords, from left to right, the longest first. All hold
    digits and other characters."""
    found = []
    for pattern, marked in ((_PREFIXED, MARKED), (_NAMED, MARKED), (_SECRET, 0.0)):
        for m in pattern.finditer(text):
            value = m.group(1).rstrip(".)]}")
            if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
                found.append((m.start(1), m.start(1) + len(value), marked))
    return sorted(found, key=lambda s: (s[0], -s[1], -s[2]))


def context_score(text: str, kind: str, start: int, end: int) -> float:
    """What the words nearby add to a span's score or take from it."""
    near = (text[max(0, start - CONTEXT_CHARS) : start] + "\n" + text[end : end + CONTEXT_CHARS]).lower()
    against = kind in _AGAINST and _AGAINST[kind].search(near)
    return IN_CONTEXT * bool(_CONTEXT[kind].search(near)) - AGAINST * bool(against)


def spans(text: str | None) -> list[Span]:
    """All spans of a text by start, then kind; base spans count whatever their score."""
    if not text:
        return []
    order = {kind: k for k, kind in enumerate((*BASE_KINDS, *ADDED_KINDS))}
    found = []
    for kind, start, end in (*(("email", a, b) for a, b in emails(text)), *numbers(text)):
        score = 0.6 + context_score(text, kind, start, end)
        found.append(Span(kind, start, end, round(score, 2), True))
    for kind, start, end, score in added(text):
        score += context_score(text, kind, start, end)
        if score >= LEAST_SCORE - 1e-9:
            found.append(Span(kind, start, end, round(min(score, 1.0), 2), False))
    return sorted(found, key=lambda s: (s.start, order[s.kind], s.end))


def find_personal_data(docs: DataFrame, column: str = "personal_data") -> DataFrame:
    """``docs`` with an array ``column`` of (kind, start, end, score, base), one row per row.

    Places are code points, ends exclusive. Base spans, leftmost and without overlap per kind: emails,
    IPv4 addresses with parts up to 255, card numbers of 14 to 19 digits that pass the Luhn check, phones
    with a plus sign and 10 to 15 digits. Added spans: IBANs that pass the mod-97 check, and national
    phones, social security numbers and secrets whose shape and context words together reach
    ``LEAST_SCORE``; words that speak against it (an example, a checksum, an order number) lower a score.

    No shuffle. Repeated rows and null ids are rows like any other. Null and empty texts have no spans; other columns pass through, ``column`` replaces one of
    that name; an empty table gives no rows.
    """
    others = [f for f in docs.schema.fields if f.name != column]
    schema = T.StructType([*others, T.StructField(column, T.ArrayType(T._parse_datatype_string(SPAN)))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [[s._asdict() for s in spans(t)] for t in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, _PA_SPANS)], names=[*rows.schema.names, column])

    return map_batches(docs.select(*[f.name for f in others]), run, schema)


def masked(docs: DataFrame, column: str = "personal_data") -> DataFrame:
    """``docs`` with each span of ``column`` in the text replaced by its kind in angle brackets.

    Of overlapping spans the first, and of these the longest, is replaced with all it overlaps. A null text
    stays null, and a text whose ``column`` is null stays as it is."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = []
            for text, found in zip(rows.column("text").to_pylist(), rows.column(column).to_pylist(), strict=True):
                parts, upto = [], 0
                for s in sorted(found or [], key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= upto:
                        parts += [text[upto : s["start"]], f"<{s['kind']}>"]
                    upto = max(upto, s["end"])
                texts.append(None if text is None else "".join(parts) + text[upto:])
            k = rows.schema.get_field_index("text")
            yield rows.set_column(k, "text", pa.array(texts, pa.string()))

    return map_batches(docs, run, docs.schema)


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def span_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("bigint")
