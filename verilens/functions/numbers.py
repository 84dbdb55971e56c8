"""Number coercions and digit helpers (H1-H5, H15-H18) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell tokens that mean "no number".
MISSING_TOKENS = ("n/a", "na", "null", "none", "-")

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def _plain(t: Column) -> Column:
    """Only digits, points and signs: such texts need no pattern matching."""
    return F.translate(t, "0123456789.+-", "") == ""


def coerce_number(text: Column) -> Column:
    """Lenient double: separators, $ and € removed, trailing % ignored (H1)."""
    t = F.trim(text)
    cleaned = F.regexp_replace(F.translate(t, ",$€", ""), "%+$", "")
    ok = ~F.lower(t).isin(*MISSING_TOKENS) & cleaned.rlike(NUMBER)
    return F.when(_plain(t), t.try_cast("double")).when(ok, cleaned.try_cast("double"))


def exact_decimal(text: Column) -> Column:
    """DECIMAL(38,10) of a cell; thousands separators and trailing % ignored (H2)."""
    t = F.trim(text)
    cleaned = F.regexp_replace(F.translate(t, ",", ""), "%+$", "")
    return F.when(_plain(t), t.try_cast("decimal(38,10)")).when(
        cleaned.rlike(NUMBER), cleaned.try_cast("decimal(38,10)")
    )


def strict_number(text: Column) -> Column:
    """Plain, grouped-thousands or leading-dot numbers only (H3)."""
    t = F.trim(text)
    grouped = r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"
    plain = r"^[+-]?(\d+(\.\d+)?|\.\d+)$"
    return F.when(t.rlike(grouped), F.translate(t, ",", "").try_cast("double")).when(
        t.rlike(plain), t.try_cast("double")
    )


def fraction_digits(text: Column) -> Column:
    """Reported decimal places; NULL for scientific or non-plain text (H4)."""
    plain = F.trim(text)
    after = F.length(plain) - F.instr(plain, ".")
    t = F.regexp_replace(F.regexp_replace(plain, r"^[+-]+", ""), "%+$", "")
    frac = F.regexp_extract(t, r"^[^.]*\.(.*)$", 1)
    return (
        F.when(_plain(plain) & ~plain.contains("."), F.lit(0))
        .when(_plain(plain) & (after > 0), after)
        .when(F.lower(t).contains("e"), F.lit(None).cast("int"))
        .when(~t.contains("."), F.lit(0))
        .when(frac.rlike(r"^\d+$"), F.length(frac))
    )


def decimal_places(text: Column) -> Column:
    """Digits after the point, 0 without one (H4)."""
    return F.length(F.regexp_extract(text, r"\.(\d+)", 1))


def terminal_digit(text: Column) -> Column:
    """Last digit character of the text, NULL when there is none (H4)."""
    last = F.substring(text, -1, 1)
    digit = F.regexp_extract(text, r"(\d)\D*$", 1)
    return F.when(last.between("0", "9"), last).when(digit != "", digit)


def terminal_pair(text: Column) -> Column:
    """Last two fraction digits of a plain decimal, NULL otherwise."""
    plain = F.trim(text)
    at = F.instr(plain, ".")
    t = F.regexp_replace(F.regexp_replace(plain, r"^[+-]+", ""), "%+$", "")
    frac = F.regexp_extract(t, r"^[^.eE]*\.(\d{2,})$", 1)
    return (
        F.when(_plain(plain) & ((at == 0) | (F.length(plain) - at < 2)), F.lit(None).cast("string"))
        .when(_plain(plain), F.substring(plain, -2, 2))
        .when(frac != "", F.substring(frac, -2, 2))
    )


def decimal_tail(text: Column, places: int = 2) -> Column:
    """First ``places`` characters after the point (H4)."""
    tail = F.regexp_extract(text, r"^[^.]*\.(.*)$", 1)
    return F.when(text.contains(".") & (F.length(tail) >= places), F.substring(tail, 1, places))


def integer_digits(text: Column) -> Column:
    """Digits before the point."""
    return F.regexp_replace(F.substring_index(text, ".", 1), r"\D", "")


def integer_digit_changes(left: Column, right: Column) -> Column:
    """Positions where equally long integer parts differ; NULL otherwise."""
    a, b = integer_digits(left), integer_digits(right)
    differing = F.size(
        F.filter(
            F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda x: x
        )
    )
    return F.when((a != "") & (F.length(a) == F.length(b)), differing)


def ones_mirrors_decimal(text: Column) -> Column:
    """Units digit equals the first decimal digit."""
    left = F.regexp_extract(F.substring_index(text, ".", 1), r"(\d)\D*$", 1)
    right = F.regexp_extract(F.regexp_extract(text, r"^[^.]*\.(.*)$", 1), r"(\d)", 1)
    return text.contains(".") & (left != "") & (left == right)


def leading_digit(value: Column) -> Column:
    """First significant digit of |v|, NULL for zero and non-finite (H5)."""
    a = F.abs(value)
    digit = F.floor(a / F.pow(F.lit(10.0), F.floor(F.log10(a)))).cast("int")
    usable = (a > 0) & ~F.isnan(a) & (a < F.lit(float("inf")))
    return F.when(usable, F.greatest(F.lit(1), F.least(F.lit(9), digit)))


def last_integer_digit(value: Column) -> Column:
    """Last digit after scaling a float to an integer with at most 6 places."""
    a = F.abs(value)
    scaled = F.lit(None).cast("double")
    for places in range(6, -1, -1):
        x = a * F.lit(float(10**places))
        whole = F.abs(x - F.rint(x)) < 1e-9
        scaled = x if places == 6 else F.when(whole, x).otherwise(scaled)
    return F.pmod(F.rint(scaled), F.lit(10)).cast("int")


def clean_offset(offset: Column) -> Column:
    """Multiple of 0.05: covers integers, tenths and typed twentieths."""
    return F.pmod(F.abs(offset), F.lit("0.05").cast("decimal(4,2)")) == 0


def hamming_hex(left: Column, right: Column) -> Column:
    """Bit distance of two 16-digit hex hashes."""
    return F.bit_count(hex_to_long(left).bitwiseXOR(hex_to_long(right)))


def hex_to_long(text: Column) -> Column:
    return F.conv(text, 16, -10).cast("long")


def hash_similarity(distance: Column) -> Column:
    return F.lit(1.0) - distance / F.lit(64.0)


def quantized(value: Column) -> Column:
    """Six decimal places, half up."""
    return F.round(value, 6).cast("decimal(38,6)")


def pdf_date(text: Column) -> Column:
    """``D:YYYYMMDD…`` to a date; NULL when it does not parse."""
    digits = F.regexp_extract(text, r"^(?:D:)?(\d{8})", 1)
    return F.to_date(F.try_to_timestamp(F.when(digits != "", digits), F.lit("yyyyMMdd")))
