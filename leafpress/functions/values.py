"""Spreadsheet values as text."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafpress.functions import text as T


def number_text(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else format(x, "g")


def spreadsheet_text(value) -> str:
    """One value: blank, TRUE/FALSE, numbers in short form, dates without a midnight, text on one line."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int | float):
        return number_text(value)
    if isinstance(value, dt.datetime):
        return value.date().isoformat() if value.time() == dt.time() else value.replace(microsecond=0).isoformat(" ")
    if isinstance(value, dt.date):
        return value.isoformat()
    from leafpress.sources.office import collapse

    return collapse(str(value))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), 0)


#: Base of the limbs of large whole numbers, least limb first.
LIMB = 10**9


def digits_of_product(whole: Column, factors: Column) -> Column:
    """The digits of a long below 10 ** 18 times all ``factors`` (longs of at most ``LIMB``)."""

    def step(factor: Column) -> Callable[[Column, Column], Column]:
        def one(acc: Column, limb: Column) -> Column:
            return let(
                limb * factor + acc["carry"],
                lambda total: F.struct(
                    F.concat(acc["out"], F.array(total % LIMB)).alias("out"), F.call_function("div", total, F.lit(LIMB)).alias("carry")
                )
            )

        return one

    def by(limbs: Column, factor: Column) -> Column:
        start = F.struct(F.array().cast("array<long>").alias("out"), F.lit(0).cast("long").alias("carry"))
        done = lambda acc: F.when(acc["carry"] > 0, F.concat(acc["out"], F.array(acc["carry"]))).otherwise(acc["out"])
        return F.aggregate(limbs, start, step(factor), done)

    limbs = let(whole, lambda m: F.array(m % LIMB, F.call_function("div", m, F.lit(LIMB))))
    text = F.array_join(F.transform(F.reverse(F.aggregate(factors, limbs, by)), lambda x: F.lpad(x.cast("string"), 9, "0")), "")
    return F.regexp_replace(text, "^0+(?=.)", "")


def powers(base: int, n: Column, most: int) -> Column:
    """Factors whose product is ``base`` ** ``n``, each of ``most`` at most of them."""
    rest = F.round(F.pow(F.lit(float(base)), n % most)).cast("long")
    return F.concat(F.array_repeat(F.lit(base**most).cast("long"), F.call_function("div", n, F.lit(most)).cast("int")), F.array(rest))


def mantissa(x: Column) -> Column:
    """Struct (m, k) of a positive double: x = m * 2 ** k, m a whole number below 2 ** 55."""
    # one bit more than a double has, as the logarithm may be rounded up to the next power of two
    exponent = F.greatest(F.floor(F.log2(x)).cast("int") - 53, F.lit(-1074))

    def of(k: Column) -> Column:
        half = F.call_function("div", k, F.lit(2)).cast("int")  # two steps: 2 ** -k may be more than a double holds
        return F.struct((x / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), k - half)).cast("long").alias("m"), k.alias("k"))

    return let(exponent, of)


def whole_digits(x: Column) -> Column:
    """All digits of a positive whole double of 2 ** 53 or more."""
    return let(mantissa(x), lambda p: digits_of_product(p["m"], powers(2, p["k"], 29)))


def least_digits(x: Column) -> Column:
    """Six rounded digits and the exponent, as ``d.dddddEn``, of a positive double below the normal ones: m * 5 ** 1074 / 10 ** 1074."""

    def rounded(digits: Column) -> Column:
        head, rest = F.substring(digits, 1, 6).cast("long"), F.substring(digits, 7, 2000)
        up = F.when(F.regexp_like(rest, F.lit("^50*$")), head % 2 == 1).otherwise(F.substring(rest, 1, 1) >= "5")
        return let(F.struct((head + up.cast("long")).alias("six"), F.length(digits).alias("n")), written)

    def written(p: Column) -> Column:
        over = p["six"] >= 1_000_000
        six = F.when(over, F.lit("100000")).otherwise(p["six"].cast("string"))
        exponent = p["n"] - 1 - 1074 + over.cast("int")
        return F.concat(F.substring(six, 1, 1), F.lit("."), F.substring(six, 2, 5), F.lit("E"), exponent.cast("string"))

    return let(digits_of_product(mantissa(x)["m"], powers(5, F.lit(1074), 12)), rounded)


#: The least double that has all its 53 bits.
NORMAL = 2.2250738585072014e-308


def short_number(x: Column) -> Column:
    """A double in six significant digits: without trailing zeros, with an exponent below -4 and from 6 on; ``nan``, ``inf``, ``-inf``.

    A double's exact binary value decides the rounding, halves go to even.
    """
    size = F.abs(x)
    # the decimal format's own rounding is exact where a double's shortest digits fix its value
    parts = F.when(size < NORMAL, least_digits(size)).otherwise(F.call_function("format_number", size, F.lit("0.00000E0")))

    def split(parts: Column) -> Column:
        digits = F.regexp_replace(F.replace(F.substring_index(parts, "E", 1), F.lit("."), F.lit("")), "0+$", "")
        return let(F.struct(digits.alias("digits"), F.substring_index(parts, "E", -1).cast("int").alias("e")), written)

    def written(p: Column) -> Column:
        digits, e = p["digits"], p["e"]
        rest, after = F.substring(digits, 2, 5), F.substring(digits, e + 2, F.lit(6))
        power = F.concat(F.when(e < 0, "-").otherwise("+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
        scientific = F.concat(F.substring(digits, 1, 1), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.lit("e"), power)
        fixed = F.when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)).otherwise(
            F.concat(F.substring(F.rpad(digits, 6, "0"), F.lit(1), e + 1), F.when(after != "", F.concat(F.lit("."), after)).otherwise(""))
        )
        return F.when((e < -4) | (e >= 6), scientific).otherwise(fixed)

    signed = F.concat(F.when(x < 0, "-").otherwise(""), let(parts, split))
    infinite = F.when(x > 0, "inf").otherwise("-inf")
    return F.when(F.isnan(x), "nan").when(size == float("inf"), infinite).when(size == 0, "0").otherwise(signed)


def number(c: Column) -> Column:
    """Doubles as text, in the JVM: whole ones with all their digits, others in six significant digits."""
    c = c.cast("double")
    size = F.abs(c)
    whole = (size < float("inf")) & (c == F.rint(c))
    large = F.concat(F.when(c < 0, "-").otherwise(""), whole_digits(size))
    return F.when(c.isNull(), "").when(whole & (size < 2.0**53), c.cast("long").cast("string")).when(whole, large).otherwise(short_number(c))


def boolean(c: Column) -> Column:
    return F.when(c.isNull(), "").when(c, "TRUE").otherwise("FALSE")


def timestamp(c: Column) -> Column:
    return F.when(c.isNull(), "").when(
        F.date_format(c, "HH:mm:ss.SSSSSS") == "00:00:00.000000", F.date_format(c, "yyyy-MM-dd")
    ).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))


def text(c: Column) -> Column:
    return F.coalesce(T.collapse(c), F.lit(""))


#: Cell kinds of the binary spreadsheet format.
EMPTY, TEXT, NUMBER, DATE, BOOLEAN, ERROR, BLANK = range(7)


def binary_cell(kind: Column, number_value: Column, text_value: Column, epoch_1904: bool = False) -> Column:
    """A cell of a binary sheet as text, by its kind; dates are serial numbers."""
    start = "1904-01-01" if epoch_1904 else "1899-12-30"
    moment = F.timestamp_seconds(F.unix_timestamp(F.lit(f"{start} 00:00:00").cast("timestamp")) + F.round(number_value * 86400).cast("long"))
    return (
        F.when(kind.isin(EMPTY, BLANK), "").when(kind == BOOLEAN, F.when(number_value != 0, "TRUE").otherwise("FALSE")).when(kind == ERROR, F.concat(F.lit("#ERROR("), number_value.cast("long").cast("string"), F.lit(")")))
        .when(kind == DATE, timestamp(moment)).when(kind == NUMBER, number(number_value)).otherwise(text(text_value))
    )
