"""Personal data by anchors: one Aho-Corasick pass over a text finds at-signs, digits, plus signs, schemes and words that announce an
identifier; at each anchor a small parser grows the span to both sides and validates it.

The base kinds are exactly the leftmost non-overlapping matches of their patterns, with those that fail validation dropped: a parser
starts at its anchor, never before the end of its kind's last match, so no text is read twice and a text's cost is in proportion to
its length. On top of them the parsers add, each as a span of its kind:

- ``email``: addresses with letters of any script or a quoted name, and written-out at-signs and dots ("(at)", "[dot]", "%40", "&#64;");
- ``ip``: addresses of version 6;
- ``card``: numbers of a known issuer with a valid check digit, inside runs of digits that fail as a whole;
- ``phone``: national numbers behind a word such as "phone:" or "tel:";
- ``login``: user name and password in a URL;
- ``iban``: valid by country code and check digits;
- ``ssn``: three, two and four digits, none of them a block that is never issued;
- ``account``: a number behind a word such as "account no." or "passport".

Defined cases: null text is empty; null ``doc_id`` stays null; repeated rows are scanned each; an empty table gives no rows; a text of
any length is scanned whole; other columns, whatever their names, are kept by ``mask`` and ignored by ``scan``.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

KINDS = ("email", "ip", "card", "phone", "login", "iban", "ssn", "account")
BASE = KINDS[:4]

Span = tuple[int, int, int]  # place of the kind in KINDS, start, end

#: Words in lower case that announce an identifier, by the parser that reads what follows.
CUES = {
    "phone": ("phone", "telephone", "tel", "mobile", "cell", "fax", "call", "whatsapp"),
    "account": (
        "account", "acct", "passport", "licence", "license", "member id", "customer id", "customer no", "patient id", "tax id", "routing", "sort code", "konto", "user id",
    ),
    "written": ("(at)", "[at]", "{at}", "<at>", " at ", "%40", "&#64;", "&commat;", "＠"),
}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_WIDE_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
_QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NATIONAL = re.compile(r"(?:\s?(?:no|nr|number)\b)?[.:#\s]{1,4}(\(?[0-9](?:[\x20().\/-]{0,2}[0-9])+)")
_WRITTEN_DOMAIN = re.compile(r"\s?((?:[A-Za-z0-9-]+(?:\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\x20dot\x20|\.))+)([A-Za-z]{2,24})(?![A-Za-z0-9-])", re.IGNORECASE)
_NUMBERED = re.compile(r"(?:\s?(?:id|no|nr|num|number))?[.:#=]{0,2}\s{0,2}(?:is\s)?([A-Za-z]{0,3}[0-9][A-Za-z0-9-]{4,33})(?![A-Za-z0-9])", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}([-\x20])(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![-0-9])")
_LOGIN = re.compile(r"([^\s/@:?#]+(?::[^\s/@?#]*)?)@[A-Za-z0-9\[]")
_HEX = frozenset("0123456789abcdefABCDEF:.")
# The first digits and lengths of card numbers by issuer.
_ISSUERS = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[68]\d)\d{11}|6(?:011|4[4-9]\d|5\d\d)\d{12}|62\d{14,17}|35(?:2[89]|[3-8]\d)\d{12}")
_DOUBLED = str.maketrans("0123456789", "0246813579")


def luhn(digits: str) -> bool:
    return sum(map(int, digits[-1::-2] + digits[-2::-2].translate(_DOUBLED))) % 10 == 0


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    """The anchors' automaton: the value of a word is its length and parser. Cues are matched in lower case, the rest has no case."""
    found: dict[str, str] = {"@": "at", "+": "plus", "://": "scheme", ":": "colon"} | dict.fromkeys("0123456789", "digit")
    found |= {word: parser for parser, words in CUES.items() for word in words}
    machine = ahocorasick.Automaton()
    for word, parser in found.items():
        machine.add_word(word, (len(word), parser))
    machine.make_automaton()
    return machine


def _lowered(text: str) -> str:
    """``text`` in lower case, character by character where whole lower case would move characters."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) > 1 else x for c in text)


class _Scan:
    """The anchors of one text, each handed to the parser of its name; ``done``: where each kind's last match ended."""

    def __init__(self, text: str):
        self.text, self.found, self.added = text, [], set()
        self.done = dict.fromkeys(("email", "wide", "ip", "card", "six", "iban"), 0)
        for last, (size, parser) in _anchors().iter(_lowered(text)):
            getattr(self, parser)(last + 1 - size, last + 1)

    def base(self, kind: str, start: int, end: int) -> None:
        self.found.append((KINDS.index(kind), start, end))

    def add(self, kind: str, start: int, end: int) -> None:
        self.added.add((KINDS.index(kind), start, end))

    def at(self, start: int, end: int) -> None:
        text, first = self.text, start
        while first > self.done["email"] and text[first - 1] in _LOCAL:
            first -= 1
        m = _DOMAIN.match(text, end) if first < start else None
        if m:
            self.base("email", first, m.end())
            self.done["email"] = m.end()
        # The same with letters of any script, or a quoted name.
        wide = start
        if start and text[start - 1] == '"' and (quote := text.rfind('"', max(self.done["wide"], start - 66), start - 1)) >= 0:
            wide = quote
        else:
            while wide > self.done["wide"] and (text[wide - 1] in _LOCAL or not text[wide - 1].isascii() and text[wide - 1].isalnum()):
                wide -= 1
        if wide < start and (w := _WIDE_DOMAIN.match(text, end)):
            self.done["wide"] = w.end()
            if not m or wide < first or w.end() > m.end():
                self.add("email", wide, w.end())

    def written(self, start: int, end: int) -> None:
        text, first = self.text, start
        if first and text[first - 1] == " ":
            first -= 1
        last = first
        while first and text[first - 1] in _LOCAL:
            first -= 1
        spoken = text[start:end] == " at "
        if first < last and (m := _WRITTEN_DOMAIN.match(text, end)) and (not spoken or re.search(r"dot[)\]}]?\s", m[1], re.IGNORECASE) and len(m[2]) <= 4):
            self.add("email", first, m.end())

    def plus(self, start: int, end: int) -> None:
        if m := _PHONE.match(self.text, start):
            if 8 <= sum(c in _DIGITS for c in m[0]) <= 15:
                self.base("phone", start, m.end())

    def digit(self, start: int, end: int) -> None:
        text = self.text
        if start >= self.done["ip"]:
            m = _QUAD.match(text, start)
            if m and all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
                self.base("ip", start, m.end())
            self.done["ip"] = (m or _CHAIN.match(text, start)).end()
        if start >= self.done["card"]:
            m = _RUN.match(text, start)
            if m is None:
                self.done["card"] = end
            else:
                self.done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    self.base("card", start, m.end())
                elif len(digits) >= 13:
                    self.inner(start, m[0])
            if s := _SSN.match(text, start):
                self.add("ssn", start, s.end())
        if start >= self.done["iban"] + 2 and text[start - 1 : start].isupper() and (start < 3 or not text[start - 3].isalnum()) and (m := _IBAN.match(text, start - 2)):
            plain = m[0].replace(" ", "")
            if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                self.add("iban", start - 2, m.end())
            self.done["iban"] = m.end()

    def inner(self, start: int, run: str) -> None:
        """Issued cards made of whole groups of a run that isn't one card, from left to right."""
        groups = [(m.start(), m.end()) for m in re.finditer("[0-9]+", run)]
        i = 0
        while i < len(groups):
            for j in range(i, min(i + 5, len(groups))):
                digits = run[groups[i][0] : groups[j][1]].replace(" ", "").replace("-", "")
                if len(digits) > 19:
                    break
                if len(digits) >= 13 and _ISSUERS.fullmatch(digits) and luhn(digits):
                    self.add("card", start + groups[i][0], start + groups[j][1])
                    i = j
                    break
            i += 1

    def colon(self, start: int, end: int) -> None:
        """An address of version 6 around a colon: its whole run of hex digits, colons and dots."""
        if start < self.done["six"]:
            return
        text, first, last = self.text, start, end
        while first > self.done["six"] and text[first - 1] in _HEX:
            first -= 1
        while last < len(text) and text[last] in _HEX:
            last += 1
        self.done["six"] = last
        own = text[first:last].rstrip(".")
        if own.endswith(":") and not own.endswith("::"):
            own = own[:-1]
        if 3 <= len(own) <= 45 and own.count(":") >= 2 and len(own) > own.count(":") and not (first and text[first - 1].isalnum()) and not text[last : last + 1].isalnum():
            try:
                ipaddress.IPv6Address(own)
            except ValueError:
                return
            self.add("ip", first, first + len(own))

    def scheme(self, start: int, end: int) -> None:
        if m := _LOGIN.match(self.text, end, end + 512):
            self.add("login", end, m.end(1))

    def phone(self, start: int, end: int) -> None:
        if not (start and self.text[start - 1].isalnum()) and (m := _NATIONAL.match(self.text, end)) and 7 <= sum(c in _DIGITS for c in m[1]) <= 15:
            self.add("phone", m.start(1), m.end(1))

    def account(self, start: int, end: int) -> None:
        if not (start and self.text[start - 1].isalnum()) and (m := _NUMBERED.match(self.text, end)) and sum(c in _DIGITS for c in m[1]) >= 4:
            self.add("account", m.start(1), m.end(1))


def scan_text(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with the added ones: (kind, start, end), by kind, then start."""
    got = _Scan(text or "")
    return sorted(got.found), sorted(got.added | set(got.found))


def _named(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scan(df: DataFrame) -> DataFrame:
    """Per row of ``df`` (doc_id, text): doc_id, counts of base spans by kind, ``base`` and ``spans`` as kind:start:end lists."""
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base", "spans"]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                base, spans = scan_text(t.as_py())
                rows.append((*(sum(k == kind for k, _, _ in base) for kind in range(len(BASE))), _named(base), _named(spans)))
            columns = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
            kinds = [pa.int64()] * len(BASE) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    schema = ", ".join(f"{n} {'string' if n in ('base', 'spans') else 'long'}" for n in names)
    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(scanned, schema)


def masked(text: str | None) -> str | None:
    """``text`` with every span replaced by its kind, as in ``[EMAIL]``; overlapping spans become one, named by the first."""
    spans = sorted((a, -b, k) for k, a, b in scan_text(text)[1]) if text else []
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i][0], -spans[i][1], spans[i][2]
        while (i := i + 1) < len(spans) and spans[i][0] < end:
            end = max(end, -spans[i][1])
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join(out) + text[at:]


def mask(df: DataFrame) -> DataFrame:
    """``df`` with its ``text`` masked; all its rows and columns stay."""
    at = df.columns.index("text")

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([masked(t.as_py()) for t in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(cleaned, df.schema)


def op12_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2("base", 256).alias("base_sha256"), "spans")
