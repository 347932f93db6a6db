"""Anchor expansion against the plain patterns."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from starsift.llm import private

from .conftest import sha

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        doubled = [int(c) for c in digits[-1::-2]] + [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def plain(text):
    return [
        (k, m.start(), m.end())
        for k, pattern in PLAIN.items() for m in pattern.finditer(text or "") if passes(k, m.group())
    ]


def base(text):
    return [(private.KINDS[k], s, e) for k, s, e in private.spans_of(text) if k < 4]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from([*"a.@+-_% 0159()\né", "1.2.3.4", "a@b.c", "+1 (555) 010-9", "4111 1111 1111 1111", "256", "://",
                                 "4111111111111111", " - ", "٣", "ssn 123-45-6789", "account "]), max_size=25).map("".join))
def test_any_text(text):
    assert base(text) == plain(text)


def test_long_texts():
    for text in ("1" * 5_000 + ".", "a" * 5_000 + "@", "@" * 5_000, "1.2.3.4." * 2_000, "+1 " * 2_000, "a@b." * 2_000, "9 9-" * 2_000):
        assert base(text) == plain(text)


def test_added_kinds():
    text = ("ftp://bob:pw@host.example/x SSN: 123-45-6789, ssn 000-12-3456; IBAN GB82 WEST 1234 5698 7654 32 and"
            " account no. AB-1234567 but my account 2024 and accounting 12345678")
    added = [(private.KINDS[k], text[s:e]) for k, s, e in private.spans_of(text) if k >= 4]
    assert added == [
        ("userinfo", "ftp://bob:pw@host.example"), ("ssn", "123-45-6789"), ("iban", "GB82 WEST 1234 5698 7654 32"),
        ("account", "AB-1234567"),
    ]


def test_digests(documents, result):
    got = result("op13_anchor_pii").set_index("doc_id")
    assert len(got) == len(documents)
    for d in documents:
        row, want = got.loc[d["doc_id"]], plain(d["text"])
        names = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert [row[f"n_{k}"] for k in PLAIN] == [sum(x[0] == k for x in want) for k in PLAIN]
        assert row.base_sha256 == sha(names.encode()) and row.spans.startswith(names)
    assert got[["n_email", "n_phone"]].sum().min() > 0


def test_odd_rows(spark, odd):
    assert private.digests(odd.limit(0)).collect() == []
    assert all(r.spans == "" and r.base_sha256 == sha(b"") for r in private.digests(odd).collect())
    rows = spark.createDataFrame([("x +1 555 0100 22 a@b.cd y", 1), (None, 2), ("", 3)], "text string, spans int")
    assert [r.text for r in private.redact(rows).orderBy("spans").collect()] == ["x [PHONE] [EMAIL] y", None, ""]
    assert [len(r.private_spans) for r in private.find(rows).orderBy("spans").collect()] == [2, 0, 0]
