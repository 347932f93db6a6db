"""Cleaning, tokenizing and label expressions (Column -> Column).

All are built-in Spark expressions, so a chain of them is one projection inside
the scan's stage: no shuffle, no Python.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: patterns that define the cleaning rules ---
TAG = "<.*?>"
URL = "(?U)\\s*https?://\\S+(\\s+|$)"
EDGE_SPACE = "(?U)^\\s+|\\s+$"
DIGITS = "(?U)\\d+"
PLAIN = "[0-9a-zA-Z ]+"
ASCII_SPACE = " \t\n\x0b\f\r"
# --- end of fixed values ---


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_html(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), TAG, "")


def strip_space(c: Column | str) -> Column:
    """Remove Unicode white space at both ends (``trim`` knows blanks only)."""
    return F.regexp_replace(_col(c), EDGE_SPACE, "")


def remove_urls(c: Column | str) -> Column:
    """Each URL with the white space around it becomes one blank; ends are stripped."""
    return strip_space(F.regexp_replace(_col(c), URL, " "))


def remove_digits(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), DIGITS, "")


def remove_special(c: Column | str) -> Column:
    """Keep ASCII letters, digits and blanks; line ends vanish, so words may join.

    Joining the runs to keep is several times faster than replacing the others:
    text has far fewer of them, and the negated class matches slowly.
    """
    return F.array_join(F.regexp_extract_all(_col(c), F.lit(PLAIN), F.lit(0)), "")


def truncate(c: Column | str, max_chars: int) -> Column:
    return F.substring(_col(c), 1, max_chars)


def join_headline(headline: Column | str, body: Column | str, glue: str = " ") -> Column:
    """headline + glue + body; null if either part is null."""
    return F.concat(_col(headline).cast("string"), F.lit(glue), _col(body))


def int_label(c: Column | str, shift: int = 0) -> Column:
    """Rating as int (null if it is not a number), plus ``shift``."""
    col = _col(c).try_cast("int")
    return (col + F.lit(shift)).cast("int") if shift else col


def whitespace_tokens(c: Column | str) -> Column:
    """Lower-cased text cut at every single white-space character.

    Inner and leading empty tokens stay, trailing ones go; '' gives one empty
    token and blank-only text none, as ``ml.feature.Tokenizer`` does.
    """
    text = _col(c)
    body = F.rtrim(F.lower(text), F.lit(ASCII_SPACE))
    blank = (body == "") & (text != "")
    return F.when(blank, F.array().cast("array<string>")).otherwise(F.split(body, "\\s"))


def word_tokens(c: Column | str) -> Column:
    """Lower-cased runs of ASCII word characters (split on ``\\W``, empties dropped)."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("\\w+"), F.lit(0))


def remove_stopwords(tokens: Column | str, stopwords: Sequence[str]) -> Column:
    """Tokens without the listed words, whatever their case; order and repeats stay."""
    words = [w.lower() for w in stopwords]
    return F.filter(_col(tokens), lambda t: ~F.lower(t).isin(words))


# --- fixed values: the common English stop-word list, and one extra word ---
ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them their
theirs themselves what which who whom this that that'll these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at
by for with about against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don
don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn
doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()
EXTRA_STOPWORD = "xxxx"
# --- end of fixed values ---


@cache
def _accent_table() -> tuple[str, str]:
    """Letters of all scripts that decompose to one base letter and marks, and that base."""
    source, target = [], []
    for code in range(0xC0, 0x110000):
        if unicodedata.decomposition(chr(code))[:1] in ("", "<"):
            continue
        base = "".join(
            ch for ch in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(ch) != "Mn"
        )
        if len(base) == 1 and base != chr(code):
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


# --- fixed values: pre-tokenizer classes of uncased subword models ---
CONTROL = "[\\p{C}\\x{FFFD}&&[^\\t\\n\\r]]"
COMBINING = "\\p{Mn}"
_PUNCT = "\\p{P}$+<=>^`|~"
# A word is a run of anything but white space, punctuation and Han signs; plain
# letters and digits come first because that class matches fastest.
WORD_OR_PUNCT = (
    f"(?:[a-z0-9]++|[^\\s\\p{{Z}}{_PUNCT}\\p{{IsHan}}a-z0-9])++|[{_PUNCT}]|\\p{{IsHan}}"
)
# --- end of fixed values ---


def fold_accents(c: Column | str) -> Column:
    """Lower-case and drop accents."""
    source, target = _accent_table()
    return F.regexp_replace(F.translate(F.lower(_col(c)), source, target), COMBINING, "")


def basic_words(c: Column | str) -> Column:
    """Uncased pre-tokens: words, with each punctuation mark and Han sign on its own."""
    text = fold_accents(F.regexp_replace(_col(c), CONTROL, ""))
    return F.regexp_extract_all(text, F.lit(WORD_OR_PUNCT), F.lit(0))
