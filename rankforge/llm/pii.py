"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import slices

# The kinds, in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

# Scores: what a pattern alone is worth, what a passed checksum adds, what words
# within so many code points add or take, and what an added span needs.
CONTEXT_CHARS = 40
BY_PATTERN = {"email": 0.8, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.3, "ssn": 0.3}
BY_CHECKSUM = 0.5
BY_CONTEXT = 0.3
AGAINST = 0.3
LEAST_SCORE = 0.5

# Words that make a kind likelier, in lower case.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "credit", "visa", "mastercard", "amex", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
# Words that say a number is something else.
COUNTER = ("isbn", "issn", "version", "order", "invoice", "serial", "tracking", "sku")

# Lengths of international bank account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24,
    "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21,
    "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}
# First digits of payment cards.
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "60", "62", "64", "65", "35", "30", "36", "38")

# Anchored so that no start is tried twice: time follows the length of the text.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_NUMBERS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_DIGITS = re.compile(r"[0-9]+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DOTTED = re.compile(r"(?<![0-9.\xa0])[0-9]{4}([.\xa0])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9]|[.\xa0][0-9])")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float
    checked: bool  # a checksum confirmed it
    base: bool  # by the plain patterns, whatever its score


def luhn(digits: str) -> bool:
    """The mod-10 checksum of card numbers."""
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def mod_97(number: str) -> bool:
    """The checksum of bank account numbers: letters count 10 to 35, the first four go last."""
    moved = number[4:] + number[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    past = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            past = m.end()
            yield start, past


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        # Leading zeros count for nothing, and very long parts are never converted.
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            yield m.span()


def _card_digits(text: str) -> str:
    return text.replace(" ", "").replace("-", "")


def _is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield m.span()


def _cards_within(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Cards among the groups of a run of numbers that is none as a whole.

    One group of 13 to 19 digits, or four groups of four, or one of 4, 6 and 5.
    """
    groups = [m.span() for m in _DIGITS.finditer(text, start, end)]
    sizes = [b - a for a, b in groups]
    i = 0
    while i < len(groups):
        n = (
            1 if 13 <= sizes[i] <= 19
            else 4 if sizes[i : i + 4] == [4, 4, 4, 4]
            else 3 if sizes[i : i + 3] == [4, 6, 5]
            else 0
        )
        a, b = groups[i][0], groups[i + n - 1][1]
        digits = _card_digits(text[a:b]) if n else ""
        if n and digits.startswith(ISSUERS) and luhn(digits):
            yield a, b
            i += n
        else:
            i += 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        want = IBAN_LENGTHS.get(m[0][:2], 0)
        held, end = 0, m.start()
        while held < want and end < m.end():
            held += text[end] not in " -"
            end += 1
        follows = text[end : end + 1]
        number = text[m.start() : end].replace(" ", "").replace("-", "")
        if want and held == want and not (follows.isalnum() and follows.isascii()) and mod_97(number):
            yield m.start(), end


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


def _score(text: str, kind: str, start: int, end: int, checked: bool) -> float:
    around = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    words = {w.lower() for w in _WORD.findall(around)}
    score = BY_PATTERN[kind] + BY_CHECKSUM * checked
    score += BY_CONTEXT * (not words.isdisjoint(CONTEXT[kind]))
    score -= AGAINST * (not words.isdisjoint(COUNTER))
    return round(min(1.0, max(0.0, score)), 6)


def spans_of(text: str, least_score: float = LEAST_SCORE) -> list[Span]:
    """All spans by kind and start, in code points, the end exclusive.

    Emails, addresses, cards and phones of the plain patterns stay whatever
    their score. Beyond those, added where the score reaches ``least_score``:
    cards inside longer runs of numbers or with dots or no-break spaces, bank
    account numbers of their country's length, and social security numbers.
    """
    found: list[Span] = []

    def add(kind: str, start: int, end: int, checked: bool, base: bool) -> None:
        score = _score(text, kind, start, end, checked)
        if base or score >= least_score:
            found.append(Span(kind, start, end, score, checked, base))

    if "@" in text:
        for span in _emails(text):
            add("email", *span, False, True)
    if _DIGITS.search(text):
        for span in _ips(text):
            add("ip", *span, False, True)
        for m in _NUMBERS.finditer(text):
            if len(m[0]) < 13:
                continue
            if _is_card(_card_digits(m[0])):
                add("card", *m.span(), True, True)
            else:
                for span in _cards_within(text, *m.span()):
                    add("card", *span, True, False)
        for m in _DOTTED.finditer(text):
            digits = m[0].replace(m[1], "")
            if digits.startswith(ISSUERS) and luhn(digits):
                add("card", *m.span(), True, False)
        for span in _phones(text) if "+" in text else ():
            add("phone", *span, False, True)
        for span in _ibans(text):
            add("iban", *span, True, False)
        for span in _ssns(text):
            add("ssn", *span, False, False)
    return sorted(found, key=lambda s: (KINDS.index(s.kind), s.start))


SPANS = "array<struct<kind:string,start:int,end:int,score:double,checked:boolean,base:boolean>>"
_ARROW_SPANS = pa.list_(
    pa.struct(
        [
            ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
            ("score", pa.float64()), ("checked", pa.bool_()), ("base", pa.bool_()),
        ]
    )
)


def find_personal_data(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """``doc_id, spans`` of every row of ``docs`` (``doc_id, text``).

    A null or empty text has no spans. Repeated rows, null ids and ties (the same
    place under two kinds) are all reported; no rows give no rows, and other
    columns are not looked at. A text of any length is searched as a whole, in
    time and memory that follow its length.
    """
    return _mapped(docs, lambda text: [vars(s) for s in spans_of(text, least_score)], SPANS, _ARROW_SPANS, "spans")


def redacted(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """``doc_id, text`` with every span replaced by its kind in angle brackets.

    Where spans overlap, the one that starts first counts, then the longer one.
    """

    def replace(text: str) -> str:
        out, at = [], 0
        for s in sorted(spans_of(text, least_score), key=lambda s: (s.start, -s.end)):
            if s.start >= at:
                out += [text[at : s.start], f"<{s.kind}>"]
                at = s.end
        return "".join([*out, text[at:]])

    return _mapped(docs, replace, "string", pa.string(), "text")


def _mapped(docs: DataFrame, of: Callable, kind: str, arrow: pa.DataType, name: str) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [of(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, arrow)], ["doc_id", name])

    return slim.mapInArrow(run, f"doc_id long, {name} {kind}")
