"""Text, amount, date and number expressions. Column in, Column out; no UDFs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordmill import fixed

# Java's \s is ASCII only, so the Unicode blanks are listed.
BLANK = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NOT_BLANK = r"[^\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def squeeze(c: Column) -> Column:
    """Runs of any Unicode blank become one space; no blanks at the ends."""
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def clean_text(c: Column) -> Column:
    """Squeezed text with the four common entities decoded once, in order; null gives ''."""
    out = squeeze(F.coalesce(c, F.lit("")))
    for entity, char in fixed.ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(out)


def clean_value(c: Column) -> Column:
    """Squeezed text, entities untouched; null stays null."""
    return squeeze(c)


def is_blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def first_nonempty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def contains_any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


# --- amounts --------------------------------------------------------------------------------

WIDE_DIGITS = "０１２３４５６７８９"


def _ascii_digits(c: Column) -> Column:
    return F.translate(c, WIDE_DIGITS, "0123456789")


def _plain_float(digits: Column) -> Column:
    """'007' -> '7.0', '12.50' -> '12.5'."""
    with_point = F.when(digits.contains("."), digits).otherwise(F.concat(digits, F.lit(".0")))
    short = F.regexp_replace(with_point, r"^0+(?=\d)", "")
    return F.regexp_replace(short, r"(\.\d+?)0+$", "$1")


def standardize_amount(c: Column) -> Column:
    """Amount text in one form: 罚款n万元 or 罚款n元; text without an amount is unchanged."""
    text = _ascii_digits(c)
    wan = F.regexp_extract(text, rf"(\d+(?:\.\d+)?){BLANK}*万元", 1)
    yuan = F.replace(F.regexp_extract(text, rf"(\d+(?:,\d+)*(?:\.\d+)?){BLANK}*元", 1), F.lit(","), F.lit(""))
    value = yuan.try_cast("double")
    # format_number rounds the exact binary value half-even, as the usual %.1f does.
    in_wan = F.replace(F.format_number(value / 10000, 1), F.lit(","), F.lit(""))
    return (
        F.when(wan != "", F.concat(F.lit("罚款"), _plain_float(wan), F.lit("万元")))
        .when((yuan != "") & (value >= 10000), F.concat(F.lit("罚款"), in_wan, F.lit("万元")))
        .when(yuan != "", F.concat(F.lit("罚款"), _plain_float(yuan), F.lit("元")))
        .otherwise(c)
    )


def amount_yuan(c: Column) -> Column:
    """First amount in yuan as DECIMAL(18,2); thousands separators count in both units."""
    text = _ascii_digits(c)
    number = r"(\d+(?:,\d+)*(?:\.\d+)?)"
    wan = F.replace(F.regexp_extract(text, rf"{number}{BLANK}*万元", 1), F.lit(","), F.lit(""))
    yuan = F.replace(F.regexp_extract(text, rf"{number}{BLANK}*元", 1), F.lit(","), F.lit(""))
    return F.coalesce(
        (wan.try_cast("decimal(24,6)") * F.lit(10000)).try_cast("decimal(18,2)"),
        yuan.try_cast("decimal(18,2)"),
    )


# --- dates ----------------------------------------------------------------------------------

DAY_FORMS = r"\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{4}年\d{1,2}月\d{1,2}日"


def _dashed(c: Column) -> Column:
    return F.replace(F.translate(c, "/.年月", "----"), F.lit("日"), F.lit(""))


def strict_day(c: Column) -> Column:
    """DATE of text that is exactly one of the three day forms, else null."""
    return F.when(c.rlike(f"^(?:{DAY_FORMS})$"), _dashed(c).try_cast("date"))


def format_date(c: Column) -> Column:
    """ISO day of text in one of the three day forms; other text unchanged, null gives ''."""
    return F.coalesce(F.date_format(strict_day(c), "yyyy-MM-dd"), c, F.lit(""))


def strict_time(c: Column) -> Column:
    """TIMESTAMP of 'Y-m-d H:M:S', 'Y-m-d' or 'Y/m/d'; else null."""
    shape = r"^(?:\d{4}-\d{1,2}-\d{1,2}(?: \d{1,2}:\d{1,2}:\d{1,2})?|\d{4}/\d{1,2}/\d{1,2})$"
    return F.when(c.rlike(shape), F.translate(c, "/", "-").try_cast("timestamp"))


def parse_time(c: Column) -> Column:
    """TIMESTAMP of any usual form (null when there is none, so it sorts last)."""
    text = strip(c)
    clock = r"(?:[ T]\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d+)?)?)?"
    day = r"\d{4}([-/.])\d{1,2}\1\d{1,2}"
    spaced = rf"^(?:{day}{clock}|\d{{4}}年\d{{1,2}}月\d{{1,2}}日)$"
    packed = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return (
        F.when(text.rlike(spaced), F.regexp_replace(_dashed_day(text), "T", " ").try_cast("timestamp"))
        .when(text.rlike(r"^\d{8}$"), packed.try_cast("timestamp"))
        .when(text.rlike(r"^\d{4}(?:-|$)"), text.try_cast("timestamp"))
    )


def _dashed_day(text: Column) -> Column:
    """Only the day part is rewritten, so fractions of a second keep their point."""
    return F.regexp_replace(text, r"^(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})日?", "$1-$2-$3")


# --- numbers in titles and sequences --------------------------------------------------------


def decision_number(title: Column) -> Column:
    """Document number in a title: bracketed, else after a blank, else the longest bare match."""
    mark = fixed.DECISION_MARK
    bracketed = strip(F.regexp_extract(title, rf"[（(]([^）)]*{mark}[^）)]*)[）)]", 1))
    spaced = F.regexp_extract(title, rf"{BLANK}({NOT_BLANK}*{mark}{NOT_BLANK}*)", 1)
    # A bare match starts where the last one ended or after a blank or bracket, and nowhere
    # else, so a long title is not rescanned from every character.
    word_start = NOT_BLANK[:-1] + "（(]"
    word_end = NOT_BLANK[:-1] + "）)]"
    start = rf"(?:\G|(?<={BLANK[:-1]}（(]))"
    bare = F.regexp_extract_all(title, F.lit(rf"{start}({word_start}*{mark}{word_end}*)"), F.lit(1))
    # The first of the longest: length up, then position down.
    ranked = F.transform(bare, lambda m, i: F.struct(F.length(m).alias("n"), (-i).alias("p"), m.alias("m")))
    longest = F.array_max(ranked)["m"]
    return F.coalesce(
        F.nullif(bracketed, F.lit("")),
        F.nullif(F.regexp_replace(spaced, "[）)]+$", ""), F.lit("")),
        F.when(F.length(longest) > fixed.DECISION_MIN, longest),
        F.lit(""),
    )


def seq_sort_key(c: Column) -> Column:
    """'n' -> (n, 0), 'n-m' -> (n, m), anything else -> (9999, 0)."""
    parts = F.split(c, "-")
    major = F.get(parts, F.lit(0)).try_cast("bigint")
    minor = F.when(F.size(parts) > 1, F.get(parts, F.lit(1)).try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    known = major.isNotNull() & minor.isNotNull()
    return F.struct(
        F.when(known, major).otherwise(F.lit(fixed.UNPARSED_SEQ).cast("bigint")).alias("major"),
        F.when(known, minor).otherwise(F.lit(0).cast("bigint")).alias("minor"),
    )
