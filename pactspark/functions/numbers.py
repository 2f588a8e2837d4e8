"""Numbers, dates and currencies read out of text; geometry of characters."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactspark.functions.scope import let
from pactspark.functions.text import is_space, strip
from pactspark.packs.fixed import (
    CN_DIGIT_VALUES,
    CN_DIGITS,
    CN_PERCENT_PATTERN,
    CURRENCY_CODES,
    METRIC_ASCENDER,
    METRIC_DESCENDER,
    METRIC_HEIGHT_LIMIT,
    PERCENT_PATTERN,
    POINTS_PER_INCH,
)

RATIO_TYPE = "decimal(38,10)"
MONEY_TYPE = "decimal(18,2)"


def cn_to_int(text: Column) -> Column:
    """A Chinese or Arabic numeral below a thousand as a number; zero is null."""
    shape = r"^(?:(\d*)百)?(?:0*(\d*)十)?(\d*)$"
    ascii_text = F.translate(text, CN_DIGITS, CN_DIGIT_VALUES)

    def unit(group: int, mark: str, size: int) -> Column:
        digits = F.regexp_extract(ascii_text, shape, group)
        given = F.when(digits == "", F.lit("1")).otherwise(digits)
        return F.when(ascii_text.contains(mark), given.try_cast("bigint") * size).otherwise(F.lit(0))

    ones = F.coalesce(F.nullif(F.regexp_extract(ascii_text, shape, 3), F.lit("")).try_cast("bigint"), F.lit(0))
    total = unit(1, "百", 100) + unit(2, "十", 10) + ones
    return F.when(ascii_text.rlike(shape) & (ascii_text != "") & (total > 0), total)


def first_percent(text: Column) -> Column:
    """The first percentage of a text (25 for 25 %), Arabic before Chinese."""
    arabic = F.regexp_extract(text, "(?U)" + PERCENT_PATTERN, 1)
    chinese = F.regexp_extract(text, CN_PERCENT_PATTERN, 1)
    return (
        F.when(arabic != "", arabic.try_cast(RATIO_TYPE))
        .when(chinese != "", cn_to_int(chinese).try_cast(RATIO_TYPE))
    )


def compare(value: Column, threshold: Column, direction: Column) -> Column:
    """Compare by a direction held in data; unknown directions are false."""
    return F.coalesce(
        F.when(direction == "gt", value > threshold)
        .when(direction == "gte", value >= threshold)
        .when(direction == "lt", value < threshold)
        .when(direction == "lte", value <= threshold)
        .when(direction == "eq", value == threshold),
        F.lit(False),
    )


def normalize_amount(raw: Column) -> Column:
    """Thousands separators out, scale two (half to even), negatives are null."""
    cleaned = strip(F.replace(raw, F.lit(","), F.lit("")))
    value = F.bround(cleaned.try_cast("decimal(38,10)"), 2).try_cast(MONEY_TYPE)
    return F.when(value >= 0, value)


def normalize_date(raw: Column) -> Column:
    """First three runs of digits as an ISO date, else the trimmed text."""
    runs = F.transform(
        F.regexp_extract_all(raw, F.lit(r"(?U)(\d+)"), F.lit(1)), lambda d: d.try_cast("int")
    )
    iso = F.format_string("%04d-%02d-%02d", F.get(runs, 0), F.get(runs, 1), F.get(runs, 2))
    return F.when(F.size(runs) >= 3, iso).otherwise(strip(raw))


def normalize_currency(raw: Column) -> Column:
    codes = F.create_map(*(F.lit(x) for x in chain.from_iterable(CURRENCY_CODES.items())))
    return F.coalesce(F.try_element_at(codes, raw), F.upper(raw))


def export_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


# ---- geometry -------------------------------------------------------------------


BOX = "struct<x0: double, y0: double, x1: double, y1: double>"


def box_for_range(chars: Column, start: Column, stop: Column) -> Column:
    """Smallest box around the visible characters in ``[start, stop)``, else null.

    The range is cut out and its sides are taken as arrays, so no step is made for each
    character but the test whether it is visible; the rest of the page's characters is
    not touched.
    """
    own = F.when((start >= 0) & (start < stop), F.slice(chars, start + 1, stop - start))
    seen = F.filter(own, lambda c: c["c"].isNotNull() & ~is_space(c["c"]))
    union = let(seen, lambda v: F.struct(
        F.array_min(v["x0"]).alias("x0"), F.array_min(v["y0"]).alias("y0"),
        F.array_max(v["x1"]).alias("x1"), F.array_max(v["y1"]).alias("y1")))
    return let(union, lambda box: F.when(box["x0"].isNotNull(), box.cast(BOX)))


def pixels_to_points(value: Column, dpi: int) -> Column:
    return value * F.lit(POINTS_PER_INCH / dpi)


def polygon_box(polygon: Column, dpi: int) -> Column:
    """Box, in points, of a polygon given as an array of (x, y) pixel structs."""
    xs = F.transform(polygon, lambda p: p["x"])
    ys = F.transform(polygon, lambda p: p["y"])
    scaled = [pixels_to_points(f(v), dpi) for f, v in
              ((F.array_min, xs), (F.array_min, ys), (F.array_max, xs), (F.array_max, ys))]
    return F.struct(*(c.alias(n) for c, n in zip(scaled, ("x0", "y0", "x1", "y1"))))


def split_line_box(text: Column, box: Column, given: Column) -> Column:
    """One box per character: the given ones when they fit, else equal widths."""

    def cut(chars: Column, step: Column) -> Column:
        n = F.size(chars)
        edges = F.transform(F.sequence(F.lit(0), n), lambda i: box["x0"] + step * i.cast("double"))
        level = lambda y: F.array_repeat(y, n)
        return let(edges, lambda e: F.arrays_zip(
            chars.alias("c"), F.slice(e, F.lit(1), n).alias("x0"), level(box["y0"]).alias("y0"), F.slice(e, F.lit(2), n).alias("x1"), level(box["y1"]).alias("y1")))

    def fitted(chars: Column) -> Column:
        return F.zip_with(chars, given, lambda c, own: F.struct(
            c.alias("c"), *(own[k].alias(k) for k in ("x0", "y0", "x1", "y1"))))

    letters = F.array_remove(F.split(text, ""), "")
    return let(letters, lambda chars: F.when(F.coalesce(F.size(given), F.lit(-1)) == F.size(chars), fitted(chars)).otherwise(
        let((box["x1"] - box["x0"]) / F.greatest(F.size(chars), F.lit(1)).cast("double"), lambda step: cut(chars, step))))


def repair_metrics(box: Column, baseline: Column, size: Column, ascender: Column, descender: Column) -> Column:
    """Vertical extent rebuilt from the baseline where font metrics are absurd."""
    absurd = (size > 0) & ((ascender - descender) > METRIC_HEIGHT_LIMIT)
    return F.struct(
        box["x0"].alias("x0"),
        F.when(absurd, baseline - size * METRIC_ASCENDER).otherwise(box["y0"]).alias("y0"),
        box["x1"].alias("x1"),
        F.when(absurd, baseline - size * METRIC_DESCENDER).otherwise(box["y1"]).alias("y1"),
    )
