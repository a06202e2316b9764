"""Expressions over semi-structured values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.text import _col, blank_to_null, join_address, squeeze


def parsed(c) -> Column:
    """Text to a variant, NULL when it is not JSON."""
    return F.try_parse_json(_col(c))


def text_at(v, path: str) -> Column:
    """String at a path, '' counted as absent."""
    return blank_to_null(F.try_variant_get(_col(v), path, "string"))


def number_at(v, path: str) -> Column:
    return F.try_variant_get(_col(v), path, "double")


def kind_at(v, path: str) -> Column:
    """JSON kind at a path: OBJECT, ARRAY<, STRING, VOID, ..."""
    return F.substring(F.schema_of_variant(F.try_variant_get(_col(v), path, "variant")), 1, 6)


def scalar_at(v, path: str) -> Column:
    """Text at a path that is neither an object nor a list.

    Text that only looks like one (it begins with a bracket) is told apart by
    its kind, which costs more and is rarely needed.
    """
    text = text_at(v, path)
    nested = text.rlike(r"^[\[{]") & (kind_at(v, path) != "STRING")
    return F.when(~nested, text)


def scalar_or_first(v, path: str, member: str) -> Column:
    """The field as text, as its first element, or as a member of either."""
    return F.coalesce(
        text_at(v, f"{path}.{member}"),
        text_at(v, f"{path}[0].{member}"),
        scalar_at(v, f"{path}[0]"),
        scalar_at(v, path),
    )


def postal_address(v, path: str = "$.location") -> Column:
    """Address text of a location given as text, object or list."""
    tries = []
    for at in (f"{path}.address", f"{path}[0].address"):
        parts = [
            text_at(v, f"{at}.{part}")
            for part in ("streetAddress", "addressLocality", "addressRegion", "postalCode")
        ]
        tries += [blank_to_null(join_address(*parts)), scalar_at(v, at)]
    return squeeze(F.coalesce(*tries, F.lit("")))


def price_from_offer(v, path: str = "$.offers") -> Column:
    """struct(price, is_free) of an offer or a list; lowPrice over price, 0 is free."""
    v = _col(v)

    def amount(at: str) -> Column:
        low = F.try_variant_get(v, f"{at}.lowPrice", "string")
        plain = F.try_variant_get(v, f"{at}.price", "string")
        return F.coalesce(low, plain).try_cast("double")

    # Only a list has a first element and only an object has these members.
    price = F.coalesce(amount(path), amount(f"{path}[0]"))
    return F.struct(
        F.when(price != 0, price).alias("price"),
        F.coalesce(price == 0, F.lit(False)).alias("is_free"),
    )
