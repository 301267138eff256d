"""Column functions for the unstable keys and spellings of the metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
#: The spellings of "no value".
UNKNOWN = ("", "不明", "未詳", "tbd", "na", "n/a", "none", "null", "nan", "unknown", "-", "?")
_DASHES = "[\\u2010-\\u2015\\u2212\\u301c\\u30fc\\u2500\\uff5e~]"
_SPACE = "[\\s\\u00a0\\u3000\\u200b\\ufeff]"


def narrow(c: Column) -> Column:
    """Full-width ASCII to ASCII, the ideographic space to a blank."""
    return F.translate(c, _WIDE, _NARROW)


def strip(c: Column) -> Column:
    """Outer white space of any kind removed."""
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def category(c: Column) -> Column:
    """A category in one writing: width, case, outer white space, dashes and the separator after a leading number
    make no difference; blank and unknown values are null."""
    x = F.lower(strip(narrow(c)))
    x = F.regexp_replace(x, _DASHES, "-")
    x = F.regexp_replace(x, "^(\\d+)[ _.:\\-]+", "$1_")
    return F.when(~x.isin(*UNKNOWN), x)


def period_number(c: Column) -> Column:
    """The leading number of a period, as text; null if there is none."""
    x = F.regexp_extract(strip(narrow(c)), "^(\\d+)", 1)
    return F.when(x != "", F.regexp_replace(x, "^0+(?=\\d)", ""))


def sex(c: Column) -> Column:
    """f or m from English or Japanese writings; other values stay as categories."""
    x = category(c)
    return F.when(x.isin("f", "female", "woman", "女", "女性"), F.lit("f")).when(x.isin("m", "male", "man", "男", "男性"), F.lit("m")).otherwise(x)


def stated_number(c: Column) -> Column:
    """A whole number in any width, with thousands separators, blanks, a zero fraction or a unit; else null."""
    x = F.regexp_replace(narrow(c), "[\\s\\u00a0\\u3000,_、]", "")
    x = F.regexp_extract(x, "^\\+?(\\d+)(?:\\.0*)?(?:[\\p{L}%]*)$", 1)
    return F.when(x != "", x.try_cast("bigint"))


def work_stem(person: Column, work: Column) -> Column:
    """``person_work``, each id padded to six digits; null if one is missing or blank."""
    p, w = strip(narrow(person)), strip(narrow(work))
    p, w = (F.when(F.length(x) >= 6, x).otherwise(F.lpad(x, 6, "0")) for x in (F.when(p != "", p), F.when(w != "", w)))
    return F.concat(p, F.lit("_"), w)


def draw_order(seed: int, *columns: str) -> Column:
    """A random order that depends on seed and key only: MD5 as text, which other engines have too."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))
