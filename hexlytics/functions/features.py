"""Row features: calendar, cyclic encoding, street name, category, tolerant casts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from hexlytics import constants as K

# --- fixed values: house numbers (masked, then plain) and blanks around, US date and time ------
BEFORE_STREET = r"^(?:\d{3,4}XX\s+)?(?:\d+\s+)?\s*|\s+$"
US_MOMENT = r"^(\d{2})/(\d{2})/(\d{4}) (\d{2}):(\d{2}):(\d{2}) [AP]M$"

TRUE_WORDS = ["true", "1", "1.0"]


def street_name(block: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(block, F.lit(""))), BEFORE_STREET, "")


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    """(sin, cos) of the value's place in a cycle of ``period`` steps."""
    turn = value.cast("double") * F.lit(2.0 * math.pi) / F.lit(float(period))
    return F.sin(turn), F.cos(turn)


def cyclic_distance(a: Column, b: Column, period: int) -> Column:
    sin_a, cos_a = cyclic(a, period)
    sin_b, cos_b = cyclic(b, period)
    return F.sqrt(F.pow(sin_a - sin_b, F.lit(2.0)) + F.pow(cos_a - cos_b, F.lit(2.0)))


def calendar_parts(moment: str = "datetime") -> dict[str, Column]:
    at = F.col(moment)
    day = F.weekday(at)
    return {
        "date": F.to_date(at),
        "year": F.year(at),
        "month": F.month(at),
        "day_of_week": day,
        "hour": F.hour(at),
        "is_weekend": day >= 5,
    }


def cyclic_parts() -> dict[str, Column]:
    out = {}
    for prefix, column, period in (
        ("hour", "hour", 24), ("dow", "day_of_week", 7), ("month", "month", 12),
    ):
        out[f"{prefix}_sin"], out[f"{prefix}_cos"] = cyclic(F.col(column), period)
    return out


def category_of(offense: Column) -> Column:
    """Broad category: one lookup in a constant map, so no join and no shuffle."""
    pairs = [
        F.lit(text) for category, types in K.CATEGORY_TYPES.items()
        for offense_type in types for text in (offense_type, category)
    ]
    key = F.trim(F.upper(offense))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(K.UNCLASSIFIED))


def tolerant_cast(text: Column, to: str) -> Column:
    """Cast that gives null on bad text; whole numbers may carry a decimal point."""
    if to == "bigint":
        number = text.try_cast("double")
        whole = F.when(number == F.floor(number), number.try_cast("bigint"))
        return F.coalesce(text.try_cast("bigint"), whole)
    return text if to == "string" else text.try_cast(to)


def iso_text(text: Column) -> Column:
    """Month/day/year with a 12-hour clock rearranged as ISO text; other text unchanged."""
    return F.regexp_replace(text, US_MOMENT, "$3-$1-$2 $4:$5:$6")


def with_moment(df: DataFrame, text: str, out: str) -> DataFrame:
    """Parse ISO text, or month/day/year with a 12-hour clock; anything else is null."""
    kept = [c for c in df.columns if c != out]
    clock = F.hour("_at")
    shift = (
        F.when(F.col(text).endswith("PM") & (clock < 12), 12)
        .when(F.col(text).endswith("AM") & (clock == 12), -12)
    )
    shifted = F.col("_at") + F.make_dt_interval(hours=shift)
    return df.select(*kept, iso_text(F.col(text)).try_cast("timestamp_ntz").alias("_at")).select(
        *kept, F.when(shift.isNotNull(), shifted).otherwise(F.col("_at")).alias(out)
    )


def arrest_flag(df: DataFrame, name: str) -> Column:
    """1 for yes in any accepted spelling, 0 for no and unknown."""
    arrest = F.col(name)
    if dict(df.dtypes)[name] != "boolean":
        arrest = F.lower(arrest.cast("string")).isin(TRUE_WORDS)
    return F.when(arrest, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def title_case(text: Column) -> Column:
    """Capital after every non-letter, small after a letter ("012xx w" -> "012Xx W")."""
    letters = F.split(text, "")
    return F.array_join(
        F.transform(
            letters,
            lambda ch, n: F.when(
                (n > 0) & F.get(letters, n - 1).rlike(r"\p{L}"), F.lower(ch)
            ).otherwise(F.upper(ch)),
        ),
        "",
    )
