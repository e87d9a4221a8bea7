"""Typed values of a listing: flags, numbers, labels, prices and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the feed's own spelling.
WHITESPACE = " \t\n\r\f\x0b"
TRUE_FLAGS = ["Да", "да", "ДА", "1"]
LOT_TYPES = {"ижс": "ИЖС", "днп": "ДНП", "усн": "УСН", "лпх": "ЛПХ", "снт": "СНТ"}
REPUBLIC_SUFFIX = (" Республика", " республика")
DISTRICT_MARK = "р-н"
DISTRICT_MAX_LENGTH = 250


def strip(value: Column) -> Column:
    """Remove surrounding white space of any kind, not only blanks."""
    return F.trim(value, F.lit(WHITESPACE))


def flag(value: Column) -> Column:
    """B1. True for a yes-word, false for anything else that is present."""
    return F.when(value.isNotNull(), value.isin(TRUE_FLAGS))


def lenient_int(value: Column, type_name: str = "int") -> Column:
    """B2. Blank is NULL; text that is no integer is NULL here and true in ``int_rejected``."""
    text = strip(value)
    return F.when(text.rlike("^[+-]?[0-9]+$"), text).try_cast(type_name)


def int_rejected(value: Column, blank_allowed: bool = True, type_name: str = "int") -> Column:
    """B2. True where the text is no integer; the strict form rejects blank text too."""
    bad = value.isNotNull() & lenient_int(value, type_name).isNull()
    return bad & (strip(value) != "") if blank_allowed else bad


def comma_float(value: Column) -> Column:
    """B3. Decimal comma or point."""
    return F.replace(value, F.lit(","), F.lit(".")).try_cast("double")


def blank_to_null(value: Column) -> Column:
    """B4."""
    return F.nullif(value, F.lit(""))


def non_empty(value: Column) -> Column:
    """B5. Any text at all is true, also "0"."""
    return value != ""


def squeeze_unit(value: Column) -> Column:
    """B6. Unit of area without inner blanks."""
    return F.replace(value, F.lit(" "), F.lit(""))


def canonical_label(value: Column, labels: dict[str, str] | None = None) -> Column:
    """B12. The label's canonical spelling; unknown labels stay as they are."""
    pairs = [F.lit(text) for item in (labels or LOT_TYPES).items() for text in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(value)), value)


def normal_region(value: Column) -> Column:
    """B13. A region that ends in the capitalised word gets every such word in lower case."""
    old, new = REPUBLIC_SUFFIX
    return F.when(F.endswith(value, F.lit(old)), F.replace(value, F.lit(old), F.lit(new))).otherwise(value)


def unit_price(price: Column, area: Column) -> Column:
    """B21. Price per unit of area; NULL where the area is zero."""
    return F.try_divide(price, area)


def normal_rooms(rooms: Column) -> Column:
    """B21. A missing number of rooms counts as 0."""
    return F.coalesce(rooms, F.lit(0))


def whole_unit_price(price: Column, monthly: Column, area: Column) -> Column:
    """B22. Price, else monthly price, per unit of area, cut to a whole number; 0 without a price."""
    known = F.coalesce(price, monthly)
    return F.when(known.isNull(), F.lit(0)).otherwise(F.try_divide(known, area).cast("long"))


def joined_address(*parts: Column) -> Column:
    """B23. The parts that are present, joined by a blank; NULL if that is empty."""
    return F.nullif(F.concat_ws(" ", *parts), F.lit(""))


def district_address(texts: Column, city: Column) -> Column:
    """B25. First text that names a district and the city, is short, and has two comma parts; else ''."""
    fits = F.filter(
        texts,
        lambda t: F.contains(t, F.lit(DISTRICT_MARK))
        & F.contains(t, city)
        & (F.length(t) < DISTRICT_MAX_LENGTH)
        & F.contains(t, F.lit(",")),
    )
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(""))
