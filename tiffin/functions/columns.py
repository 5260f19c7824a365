"""Column helpers for the warehouse functions Spark lacks or spells differently.

Each helper returns a plain Column built from Spark's own functions, so it stays
inside whole-stage codegen and needs no Python worker.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def try_number(x: ColumnOrName) -> Column:
    """``try_to_number(x)``: NUMBER(38,0) with rounding, NULL when not a number.

    Going through DECIMAL(38,0) keeps '12.7' -> 13 (an INT cast would give NULL). Numbers
    beyond BIGINT are no usable ids, ages or counts here: NULL as well, never an error.
    """
    return _c(x).try_cast("decimal(38,0)").try_cast("bigint")


def try_decimal(x: ColumnOrName, precision: int, scale: int) -> Column:
    """``try_to_decimal(x, p, s)``: rounds half up to ``s``; NULL on bad text or overflow."""
    return _c(x).try_cast(f"decimal({precision},{scale})")


def after_last_comma(x: ColumnOrName) -> Column:
    """``trim(coalesce(regexp_substr(x, '[^,]+$'), x))``: the city after the last comma.

    A value ending in a comma has no match, so the whole value is kept.
    """
    c = _c(x)
    return F.trim(F.coalesce(F.regexp_substr(c, F.lit("[^,]+$")), c))


def first_number(x: ColumnOrName) -> Column:
    """``try_to_number(regexp_substr(x, '[0-9]+'))``: the first run of digits."""
    return try_number(F.regexp_substr(_c(x), F.lit("[0-9]+")))


def null_if(x: ColumnOrName, value) -> Column:
    """``nullif(x, value)``."""
    c = _c(x)
    return F.when(c == F.lit(value), F.lit(None)).otherwise(c)


def div0(a: ColumnOrName, b: ColumnOrName) -> Column:
    """``div0(a, b)``: 0 when the divisor is 0, else the quotient."""
    return F.when(_c(b) == 0, F.lit(0)).otherwise(_c(a) / _c(b))


def iff(cond: Column, a, b) -> Column:
    """``iff(c, a, b)``: a NULL condition takes the else branch."""
    return F.when(cond, a).otherwise(b)


# Word delimiters of the warehouse's INITCAP (whitespace and this
# punctuation). The apostrophe is not a delimiter.
INITCAP_DELIMITERS = " \t\n\r\f\v!?@\"^#$&~_,.:;+-*%/|\\[](){}<>"


def _regex_class(chars: str) -> str:
    out = []
    for ch in chars:
        if ch in "\\]^-[":
            out.append("\\" + ch)
        elif ch == "\t":
            out.append("\\t")
        elif ch == "\n":
            out.append("\\n")
        elif ch == "\r":
            out.append("\\r")
        elif ch == "\f":
            out.append("\\f")
        elif ch == "\v":
            out.append("\\x0B")
        else:
            out.append(ch)
    return "[" + "".join(out) + "]"


def initcap(x: ColumnOrName) -> Column:
    """Warehouse ``initcap``: lower-case, then upper-case the first letter of every
    word, where punctuation also starts a word ('non-veg' -> 'Non-Veg').

    Spark's own ``initcap`` only splits on spaces. The text is split right after
    each delimiter; every part's first character is upper-cased.
    """
    parts = F.split(F.lower(_c(x)), "(?<=" + _regex_class(INITCAP_DELIMITERS) + ")", -1)
    return F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))),
        "")


def has_word(text: Column, word: str, whole_words: bool = False) -> Column:
    """``word in text`` (substring, the reference's rule) or, with ``whole_words``, only where
    the word is not glued to a letter, digit or '_' ('late' then no longer matches 'plate')."""
    if not whole_words:
        return text.contains(word)
    edge = "[\\p{L}\\p{N}_]"
    return text.rlike(f"(?<!{edge}){re.escape(word)}(?!{edge})")


def contains_any(text: Column, words: list[str], whole_words: bool = False) -> Column:
    """True when any word occurs (``any(w in text for w in words)``)."""
    cond = F.lit(False)
    for w in words:
        cond = cond | has_word(text, w, whole_words)
    return cond


def count_contained(text: Column, words: list[str], whole_words: bool = False) -> Column:
    """Number of words that occur at least once (``sum(w in text for w in words)``)."""
    total = F.lit(0)
    for w in words:
        total = total + has_word(text, w, whole_words).cast("int")
    return total


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Dot product of two equal-length numeric arrays."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: ColumnOrName) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Cosine similarity; 0 when either vector has zero length."""
    den = norm(a) * norm(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / den)
