"""Phone numbers in E.164, without guessing the country."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Country code, length and first digit of mobile numbers.
REGIONS = {
    "SA": ("966", 9, "5"),
    "EG": ("20", 10, "1"),
    "AE": ("971", 9, "5"),
    "KW": ("965", 8, "5"),
    "QA": ("974", 8, "3"),
}
E164 = r"^\+[1-9][0-9]{6,14}$"


def _by_region(region: Column, position: int) -> Column:
    out = F.lit(None)
    for name, values in REGIONS.items():
        out = F.when(region == name, F.lit(values[position])).otherwise(out)
    return out


def normalize_phone(raw: Column, region: Column | str = "SA") -> Column:
    """Struct of ``e164`` and ``error``; at most one of them is set."""
    region = F.upper(F.lit(region) if isinstance(region, str) else region)
    code, length, first = (_by_region(region, i) for i in range(3))
    kept = F.regexp_replace(raw, r"[^\p{Nd}+]", "")
    number = F.when(kept.startswith("00"), F.concat(F.lit("+"), F.substr(kept, F.lit(3)))).otherwise(kept)
    digits = F.substr(number, F.lit(2))
    foreign = number.startswith("+")
    e164 = (
        F.when(kept == "", None)
        .when(
            foreign,
            F.when(F.length(digits).between(7, 15) & ~digits.startswith("0"), number),
        )
        .when(
            F.startswith(number, code) & (F.length(number) == F.length(code) + length),
            F.concat(F.lit("+"), number),
        )
        .when(
            number.startswith("0") & (F.length(number) == length + 1),
            F.concat(F.lit("+"), code, digits),
        )
        .when(
            (F.length(number) == length) & F.startswith(number, first),
            F.concat(F.lit("+"), code, number),
        )
    )
    error = F.when(e164.isNotNull() | kept.isNull() | (kept == ""), None).when(
        foreign, F.concat(F.lit("not a valid E.164 number: "), raw)
    ).when(
        code.isNull(), F.concat(F.lit("unknown region "), region)
    ).otherwise(
        F.concat(
            F.lit("cannot normalise "), raw, F.lit(" for region "), region, F.lit(": got "),
            F.length(number).cast("string"), F.lit(" digits, expected "), length.cast("string"),
        )
    )
    return F.struct(e164.alias("e164"), error.alias("error"))


def is_e164(x: Column) -> Column:
    """True for E.164 text and for null, as a column constraint reads it."""
    return x.isNull() | x.rlike(E164)
