"""Text folds, hashes and token normalisation as column expressions.

The three folds differ on purpose: one makes stored keys for names, one compares
quotes with transcripts, one compares tokens inside a transcript.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

# Arabic letters and marks the folds act on.
MARKS = "ًٌٍَُِّْ"
TATWEEL = "ـ"
ALEF_FORMS = "أإآ"
ALEF_WASLA = "ٱ"
ALEF = "ا"
YA_FORM, YA = "ى", "ي"
TA_FORM, HA = "ة", "ه"
GAP = "[[ASR_GAP]]"

# Blanks beyond the ASCII ones: four separators and the Unicode spaces.
WIDE_BLANKS = "".join(
    map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def _latin_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from the Unicode data."""
    plain = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ı": "i", "ħ": "h"}
    for code in range(0x00C0, 0x0250):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii() and base.isalpha():
            plain[chr(code)] = base
    return "".join(plain), "".join(plain.values())


_ACCENTED, _PLAIN = _latin_table()
_LIGATURES = (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("þ", "th"), ("Þ", "TH"))


def unaccent(x: Column) -> Column:
    x = F.translate(x, _ACCENTED, _PLAIN)
    for letter, pair in _LIGATURES:
        x = F.replace(x, F.lit(letter), F.lit(pair))
    return x


def plain_blanks(x: Column) -> Column:
    """Every blank as an ASCII one; lengths and offsets stay as they are."""
    return F.translate(x, WIDE_BLANKS, " " * len(WIDE_BLANKS))


def collapse_blanks(x: Column) -> Column:
    """Trim, and turn each run of whitespace into one space."""
    return F.btrim(F.regexp_replace(plain_blanks(x), r"\s+", " "))


def fold_name(x: Column) -> Column:
    """Key under which spellings of one name compare equal."""
    x = F.translate(x, MARKS + TATWEEL, "")
    x = F.lower(unaccent(x))
    x = F.translate(x, ALEF_FORMS + YA_FORM + TA_FORM, ALEF * 3 + YA + HA)
    return F.btrim(F.regexp_replace(x, r"\s+", " "))


def fold_arabic(x: Column) -> Column:
    """Orthography fold for matching a quote against a transcript."""
    x = F.translate(
        x,
        ALEF_FORMS + ALEF_WASLA + YA_FORM + TA_FORM + MARKS + TATWEEL,
        ALEF * 4 + YA + HA,
    )
    return collapse_blanks(x)


@F.pandas_udf(Ty.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Compatibility normalisation; the engine has no built-in for it."""
    return x.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


@F.pandas_udf(Ty.ArrayType(Ty.StringType()))
def nfkc_tokens(x: pd.Series) -> pd.Series:
    """Tokens joined by U+001F, split and normalised one by one."""
    return x.map(
        lambda s: [unicodedata.normalize("NFKC", t) for t in s.split("\x1f")], na_action="ignore"
    )


# Letters, marks and punctuation that compatibility normalisation leaves alone.
_STABLE = (
    r"\x00-\x7f\xa1-\xa7\xa9\xab-\xae\xb0\xb1\xb6\xb7\xbb\xbf-\xff"
    r"\u0600-\u060f\u061b-\u0652\u0660-\u066f\u0671-\u0674\u0679-\u06bf\u2010\u2012-\u2015\u2018-\u201e\u20ac"
)


def is_odd(x: Column) -> Column:
    """Whether compatibility normalisation could change the text."""
    # the coarse class has few ranges, so it is quick where it already says no
    coarse = r"[^\x00-\x7f\xbf-\xff\u0600-\u060f\u061b-\u0652]"
    return F.when(x.rlike(coarse), x.rlike(f"[^{_STABLE}]")).otherwise(F.lit(False))


def compatible(x: Column) -> Column:
    """NFKC form. Rows without an odd character cross to Python as a null, which costs little but not nothing."""
    return F.coalesce(nfkc(F.when(is_odd(x), x)), x)


def _fold_token(x: Column) -> Column:
    return F.lower(
        F.translate(x, ALEF_FORMS + ALEF_WASLA + YA_FORM + MARKS + TATWEEL, ALEF * 4 + YA)
    )


def norm_token(x: Column, normalise: bool = True) -> Column:
    """One token, folded for comparison: edge punctuation and marks dropped."""
    x = compatible(x) if normalise else x
    return _fold_token(F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def tokens(x: Column) -> Column:
    """Whitespace-separated tokens, in order."""
    return F.filter(F.split(collapse_blanks(x), " "), lambda t: t != "")


# A run of characters that are no letter, digit or blank, at the edge of a token.
_EDGE = (
    r"(?=[^\p{L}\p{N} ])(?:(?<![^ ])[^\p{L}\p{N} ]++|[^\p{L}\p{N} ]++(?![^ ]))"
)


def norm_text(x: Column) -> Column:
    """``norm_token`` of every token of a text, one space apart, in a few passes
    over the whole text. A token that vanishes leaves an empty place.

    The text must already be in compatible form where that matters.
    """
    return _fold_token(F.regexp_replace(collapse_blanks(x), _EDGE, ""))


def text_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def input_hash(*parts: Column) -> Column:
    """sha256 over the parts, each closed by a NUL."""
    return F.sha2(F.concat(*[F.concat(p, F.lit("\0")) for p in parts]), 256)


def is_arabic(x: Column) -> Column:
    """More than half of the letters are Arabic; no letters means false."""
    letters = F.regexp_replace(x, r"[^\p{L}]", "")
    arabic = F.regexp_replace(letters, r"[^\u0600-\u06ff]", "")
    return F.length(arabic) * 2 > F.length(letters)


def spoken_content(x: Column) -> Column:
    """A transcript without its time stamps and speaker labels."""
    furniture = r"(?m)^\s*\[\p{Nd}{1,2}:\p{Nd}{2}(?::\p{Nd}{2})?\]\s*(?:[A-Z_]{3,12}:)?\s*"
    return collapse_blanks(F.regexp_replace(plain_blanks(F.coalesce(x, F.lit(""))), furniture, ""))


MIN_SPOKEN = 20


def unscoreable_reason(x: Column) -> Column:
    """Why a transcript is too short to grade; null when it is long enough."""
    n = F.length(spoken_content(x))
    return F.when(
        n < MIN_SPOKEN,
        F.concat(
            F.lit("too little speech to grade: "), n.cast("string"),
            F.lit(f" of {MIN_SPOKEN} characters; counted as no conversation"),
        ),
    )


def error_text(prefix: str, message: Column) -> Column:
    return F.substring(F.concat(F.lit(prefix), message), 1, 500)


def mmss(seconds: Column) -> Column:
    whole = seconds.cast("int")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("int"), whole % 60)


#: ASCII blanks
_BLANKS = " \t\n\x0b\f\r"


def strip_code_fence(x: Column) -> Column:
    """The reply inside a code fence, or the trimmed reply when it has none.

    Only the ends are looked at: a pattern would be tried at every blank of the reply.
    """
    text = F.btrim(x, F.lit(_BLANKS))
    mark = F.when(text.startswith("```json"), 7).otherwise(3)
    fenced = text.startswith("```") & text.endswith("```") & (F.length(text) >= 6)
    inside = F.btrim(F.substr(text, mark + 1, F.length(text) - 3 - mark), F.lit(_BLANKS))
    return F.when(fenced, inside).otherwise(text)


def is_json(x: Column) -> Column:
    """Whether a text can be read as JSON; false for null.

    Prose is told by its first character, since a failed parse costs far more than a good one.
    """
    first = F.substring(F.ltrim(x, F.lit(" \t\n\r")), 1, 1)
    return F.when(first.isin(*'{["-0123456789tfn'), F.try_parse_json(x).isNotNull()).otherwise(F.lit(False))


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable so that ``body`` can use it many times
    without computing it again."""
    return F.element_at(F.transform(F.array(value), body), 1)
