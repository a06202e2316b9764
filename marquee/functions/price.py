"""Price, ratio and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.functions.text import _col, any_term, text_or_empty


def pct(n, d, digits: int = 2) -> Column:
    """Percentage, 0 when there is nothing to divide by."""
    n, d = _col(n), _col(d)
    return F.when(d > 0, F.round(n / d * 100, digits)).otherwise(F.lit(0.0))


def hash_ip(c) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(_col(c).cast("string"), 256), 1, 16)


def price_from_text(c) -> Column:
    """struct(is_free, price, price_note) from prose."""
    prose = text_or_empty(c)
    free = F.lower(prose).rlike(
        r"\b(?:free admission|free entry|free event|admission free|no cost|free to attend)\b"
    )
    amount = F.nullif(F.regexp_extract(prose, r"\$(\d+(?:\.\d{2})?)", 1), F.lit(""))
    note = (
        F.when(free, F.lit("Free"))
        .when(amount.isNotNull(), F.concat(F.lit("$"), amount))
        .otherwise(F.lit("TBD"))
    )
    return F.struct(
        free.alias("is_free"),
        F.when(~free, amount.cast("double")).alias("price"),
        note.alias("price_note"),
    )


def labelled_price(c) -> Column:
    """struct(price, is_free) from the text next to a price label."""
    label = text_or_empty(c)
    free = F.lower(label).contains("free")
    number = F.nullif(F.regexp_extract(label, r"\$?\s*(\d+(?:\.\d{2})?)", 1), F.lit(""))
    return F.struct(
        F.when(free, F.lit(0.0)).otherwise(number.cast("double")).alias("price"),
        free.alias("is_free"),
    )


def first_number(c) -> Column:
    """First number of a cost text, thousands separators ignored."""
    bare = F.replace(text_or_empty(c), F.lit(","), F.lit(""))
    return F.nullif(F.regexp_extract(bare, r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def minor_units(c, exponent=2) -> Column:
    """Integer minor units to an amount."""
    power = _col(exponent) if not isinstance(exponent, int) else F.lit(exponent)
    return F.try_to_number(_col(c).cast("string"), F.lit("999999999999999")).cast(
        "double"
    ) / F.pow(F.lit(10.0), power)


def is_free_note(note) -> Column:
    low = F.lower(text_or_empty(note))
    return ~any_term(low, V.FREE_NOTE_BLOCKERS) & any_term(low, V.FREE_NOTE_WORDS)


def money(amount) -> Column:
    return F.concat(F.lit("$"), F.format_string("%.2f", _col(amount)))


def price_label(price, is_free, note) -> Column:
    """FREE, an amount, a note, or nothing."""
    price, note = _col(price), F.trim(text_or_empty(note))
    return (
        F.when(F.coalesce(_col(is_free), F.lit(False)), F.lit("FREE"))
        .when(F.coalesce(price, F.lit(0.0)) != 0, money(price))
        .when((note == "") | (F.upper(note) == "TBD"), F.lit(None).cast("string"))
        .when(is_free_note(note), F.lit("FREE"))
        .otherwise(note)
    )


def price_range(low, high) -> Column:
    """Text of a low and a high offer given as text."""
    low, high = _col(low).cast("string"), _col(high).cast("string")
    spread = F.concat(F.lit("$"), low, F.lit(" - $"), high)
    number = low.try_cast("double")
    return (
        F.when(low.isNotNull() & high.isNotNull() & (low != high), spread)
        .when(low.isNull(), F.lit(None).cast("string"))
        .when(number.isNull(), low)
        .when(number == 0, F.lit("free"))
        .otherwise(F.concat(F.lit("$"), low))
    )


def theme(category) -> Column:
    """Image theme of a category."""
    named = F.create_map(*[F.lit(x) for pair in V.CATEGORY_THEME.items() for x in pair])
    return F.coalesce(F.try_element_at(named, F.lower(F.trim(text_or_empty(category)))),
                      F.lit("other"))


def theme_image(row_id, title, category, images_per_theme: int = 8) -> Column:
    """The same image for the same listing, from crc32 of id and title."""
    key = F.concat(_col(row_id).cast("string"), F.lit("|"), text_or_empty(title))
    n = F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(images_per_theme).cast("bigint"))
    name = theme(category)
    return F.concat(F.lit("/static/stock/"), name, F.lit("/"), n.cast("string"), F.lit(".jpg"))
