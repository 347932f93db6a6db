"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs,
scheme separators, digits, plus signs before a digit, and cue words of identifiers. At
an anchor a local parser expands to both sides, finds the boundaries and validates
what lies between. A parser never reads a place twice, so a text costs time in
proportion to its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: kinds and their grammar ---
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "userinfo", "ssn", "iban", "account")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
SPACED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIALLED = re.compile(r"[\x20().0-9-]+")
PHONE_DIGITS, CARD_DIGITS, IP_PARTS, IP_MOST = (8, 15), (16, 19), 4, 255
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
AUTHORITY = re.compile(r"([^\s/?#@\"'<>]+)@(?:[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)(?::[0-9]+)?")
#: What may stand between a cue word and its value.
LINK = r"[\x20\t]*(?:(?:number|no|nr|id|code|is)\b\.?[\x20\t]*){0,2}[:=#]?[\x20\t]*"
CUES = {
    "ssn": (("ssn", "social security"), re.compile(LINK + r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])", re.I | re.A)),
    "iban": (("iban",), re.compile(LINK + r"([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])", re.A)),
    "account": (
        ("account", "acct", "passport", "customer"),
        re.compile(LINK + r"((?=[A-Z0-9-]*[0-9])[A-Z0-9]+(?:-[A-Z0-9]+)*)(?![A-Za-z0-9_@-]|\.[A-Za-z0-9])", re.A),
    ),
}
#: Least characters of an account value, and least digits among them.
ACCOUNT_LEAST, ACCOUNT_DIGITS = 6, 5
# --- end of fixed values ---
_DIGITS = frozenset("0123456789")


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for at, c in enumerate(reversed(digits)):
        d = int(c) * (1 + at % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= IP_MOST)


def _social(value: str) -> bool:
    area, group, serial = value.split("-")
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def _iban(value: str) -> bool:
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _account(value: str) -> bool:
    return len(value) >= ACCOUNT_LEAST and sum(c in _DIGITS for c in value) >= ACCOUNT_DIGITS


_VALID = {"ssn": _social, "iban": _iban, "account": _account}


@cache
def anchors() -> ahocorasick.Automaton:
    """The automaton; a hit carries the parser's name and the anchor's length."""
    found = ahocorasick.Automaton()
    found.add_word("@", ("@", 1))
    found.add_word("://", ("://", 3))
    for d in sorted(_DIGITS):
        found.add_word(d, ("digit", 1))
        found.add_word("+" + d, ("+", 2))
    for kind, (cues, _) in CUES.items():
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def spans_of(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of a whole text in code points, by kind and start.

    Spans of one kind never overlap; spans of different kinds may. A base match
    that fails its test is passed over whole and not tried again.
    """
    if not text:
        return []
    out = []
    done = dict.fromkeys(KINDS, 0)  # each parser goes on behind what it has read
    dotted = spaced = 0
    for last, (anchor, length) in anchors().iter(text):
        at = last - length + 1
        if anchor == "digit":
            if at >= dotted:
                chain = DOTTED.match(text, at)
                dotted = chain.end()
                parts = chain.group().split(".")
                start = at
                for first in range(0, len(parts) - IP_PARTS + 1, IP_PARTS):
                    four = parts[first : first + IP_PARTS]
                    end = start + sum(map(len, four)) + IP_PARTS - 1
                    if all(map(_small, four)):
                        out.append((1, start, end))
                    start = end + 1
            if at >= spaced:
                chain = SPACED.match(text, at)
                spaced = chain.end() if chain else at + 1
                if chain:
                    digits = chain.group().replace(" ", "").replace("-", "")
                    if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                        out.append((2, at, chain.end()))
        elif anchor == "@":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (domain := DOMAIN.match(text, at + 1)):
                out.append((0, start, domain.end()))
                done["email"] = domain.end()
        elif anchor == "+":
            run = DIALLED.match(text, last + 1)
            if run:
                body = run.group().rstrip(" ().-")
                digits = sum(c in _DIGITS for c in body)
                # A run of one digit would leave nothing between the first digit and the last.
                if len(body) >= 2 and PHONE_DIGITS[0] <= digits + 1 <= PHONE_DIGITS[1]:
                    out.append((3, at, last + 1 + len(body)))
        elif anchor == "://":
            start = at
            while start > done["userinfo"] and text[start - 1] in SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            if start < at and (place := AUTHORITY.match(text, last + 1)):
                out.append((4, start, place.end()))
                done["userinfo"] = place.end()
        elif at >= done[anchor] and not (at and text[at - 1].isalnum()):
            value = CUES[anchor][1].match(text, last + 1)
            if value and _VALID[anchor](value.group(1)):
                out.append((KINDS.index(anchor), value.start(1), value.end(1)))
                done[anchor] = value.end(1)
    return sorted(out)


def find(docs: DataFrame, text: str = "text", out: str = "private_spans") -> DataFrame:
    """``docs`` with an array of (kind, start, end), code points, of every whole text.

    Null and empty texts have an empty array. Repeated rows are read each for
    itself. A column named ``out`` is an error.
    """
    if out in docs.columns:
        raise ValueError(f"column {out} exists")

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(
                [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans_of(t)] for t in batch], dtype=object
            )

    return docs.withColumn(out, spans(F.col(text)))


def redact(docs: DataFrame, text: str = "text", marks: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with personal data of the text replaced by its kind in brackets, or by ``marks[kind]``.

    Of spans that overlap, the one that starts first (then the longest) gives the mark and all are
    taken out. Null stays null.
    """
    shown = {k: f"[{k.upper()}]" for k in KINDS} | (marks or {})

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for t in batch:
                parts, at = [], 0
                for start, end, kind in sorted(((s, e, k) for k, s, e in spans_of(t)), key=lambda x: (x[0], -x[1])):
                    if start >= at:
                        parts += [t[at:start], shown[KINDS[kind]]]
                    at = max(at, end)
                out.append("".join([*parts, t[at:]]) if parts else t)
            yield pd.Series(out, dtype=object)

    return docs.withColumn(text, clean(F.col(text)))


def digests(docs: DataFrame) -> DataFrame:
    """A row per row: doc_id, counts of the base kinds, a digest of their spans, and all spans as text.

    Spans are ordered by kind, then start. Null and empty texts have none; the
    digest is then that of the empty string. Columns other than ``doc_id`` and
    ``text`` are not read. Very long texts are read whole, one at a time.
    """

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def summed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch:
                found = spans_of(t)
                kinds = [k for k, _, _ in found]
                names = [f"{KINDS[k]}:{s}:{e}" for k, s, e in found]
                n_base = sum(k < len(BASE) for k in kinds)
                digest = hashlib.sha256(",".join(names[:n_base]).encode()).hexdigest()
                rows.append((*(kinds.count(k) for k in range(len(BASE))), digest, ",".join(names)))
            yield pd.DataFrame(rows, columns=[*(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return docs.select("doc_id", summed(F.col("text")).alias("d")).select("doc_id", "d.*")
