"""Exact prices and quantities. Prices are DECIMAL(18, 9), quantities DECIMAL(38, 0); nothing is ever a float."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE, QUANTITY = "decimal(18,9)", "decimal(38,0)"
#: Decimal text: digits with at most nine behind the point, so that a cast to PRICE can't round.
PRICE_TEXT = r"^-?[0-9]{1,9}(\.[0-9]{1,9})?$"


def decoded(text: Column) -> Column:
    """struct(coefficient, scale, text) of decimal text; null where the text isn't decimal."""
    digits = F.when(F.instr(text, ".") > 0, F.length(F.substring_index(text, ".", -1))).otherwise(F.lit(0))
    return F.when(
        text.rlike(r"^-?[0-9]+(\.[0-9]+)?$"),
        F.struct(F.replace(text, F.lit("."), F.lit("")).cast(QUANTITY).alias("coefficient"), digits.cast("int").alias("scale"), text.alias("text")),
    )


def price(text: Column) -> Column:
    """Decimal text as PRICE; null rather than rounded where it has more digits than fit."""
    return F.when(text.rlike(PRICE_TEXT), text.cast(PRICE))


def rendered(value: Column) -> Column:
    """Decimal text without trailing zeros; a null stays null."""
    text = value.cast("string")
    return F.when(F.instr(text, ".") > 0, F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def byte_cut(text: Column, limit: int = 600) -> Column:
    """The text cut at ``limit`` UTF-8 bytes, at a character's edge, with an ellipsis appended where it was cut."""
    fits = F.octet_length(text) <= limit
    # a continuation byte is 10xxxxxx: step back from the first byte that is left out while it is one
    raw = F.hex(F.substring(F.encode(text, "UTF-8"), 1, limit + 1))
    inside = lambda k: F.substring(raw, 2 * (limit - k) + 1, 1).isin("8", "9", "A", "B")
    back = F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
    cut = F.decode(F.unhex(F.left(raw, (F.lit(limit) - back) * 2)), "UTF-8")
    return F.when(fits, text).otherwise(F.concat(cut, F.lit("…")))


def bucket_bound(micros: Column) -> Column:
    """Upper bound of the histogram bucket: one microsecond wide below 1 ms, doubling above."""
    bound = F.when(micros < 1000, F.floor(micros) + 1)
    for k in range(1, 32):
        bound = bound.when(micros < 1000 * (1 << k), F.lit(1000 * (1 << k)))
    return bound.cast("long")


def levels_sorted(levels: Column, bids: bool) -> Column:
    """A side best first: bids by falling price, asks by rising price."""
    ordered = F.array_sort(levels)
    return F.reverse(ordered) if bids else ordered


def last_listed(levels: Column) -> Column:
    """One level a price, by rising price: of a price that is listed more than once the last entry."""
    places = F.transform(levels, lambda x, i: F.struct(x["price"].alias("price"), i.alias("i"), x["qty"].alias("qty")))
    ordered = F.array_sort(places)
    beside = F.zip_with(ordered, F.slice(ordered, 2, 1 << 30), lambda x, after: F.struct(x.alias("x"), (~x["price"].eqNullSafe(after["price"])).alias("last")))
    return F.transform(F.filter(beside, lambda e: e["last"]), lambda e: F.struct(e["x"]["price"].alias("price"), e["x"]["qty"].alias("qty")))


def complement(levels: Column) -> Column:
    """The other outcome's side: 1 - price with the quantity carried, in the same order."""
    return F.transform(levels, lambda x: F.struct((F.lit(1).cast("int") - x["price"]).cast(PRICE).alias("price"), x["qty"].alias("qty")))


def best(levels: Column, bids: bool) -> Column:
    return F.get(levels_sorted(levels, bids), 0)


def level_text(level: Column, absent: str = "-") -> Column:
    return F.coalesce(F.concat(rendered(level["price"]), F.lit("@"), level["qty"].cast("string")), F.lit(absent))


def side_text(levels: Column, shown: int = 3) -> Column:
    """At most ``shown`` levels as [price@qty,...]."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.slice(levels, 1, shown), lambda x: level_text(x)), ","), F.lit("]"))
