"""Order books rebuilt from stored snapshots: revisions, authority, continuity epochs, mutations and cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exact import best, complement, last_listed, level_text, levels_sorted, rendered, side_text

LEVELS = "array<struct<price:decimal(18,9),qty:decimal(38,0)>>"


def revised(inputs: DataFrame, resolutions: bool = False) -> DataFrame:
    """One row per published state of each market; with ``resolutions`` also a row for each resolution, which changes
    neither book nor revision.

    ``inputs`` has market, seq, kind (start, snapshot, disconnect, resolved), bids and asks. A revision is counted for
    each applied snapshot, even of equal levels, and for each loss; a start is revision 0. A loss keeps the book and
    the old epoch, and the next live state has the new one. Of a price that a side lists twice the last entry holds.
    """
    order = W.partitionBy("market").orderBy("seq")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    kind = F.col("kind")
    rows = inputs.filter(kind.isin("start", "snapshot", "disconnect", *["resolved"] * resolutions))
    losses = F.sum((kind == "disconnect").cast("long")).over(so_far)
    held = lambda side: F.coalesce(F.last(F.when(kind == "snapshot", F.coalesce(last_listed(side), F.array().cast(LEVELS))), ignorenulls=True).over(so_far), F.array().cast(LEVELS))
    live = F.last(F.when(kind == "snapshot", "Live").when(kind == "disconnect", "Stale(Disconnect)"), ignorenulls=True).over(so_far)
    return rows.select(
        "market", "seq", "kind",
        F.sum(kind.isin("snapshot", "disconnect").cast("long")).over(so_far).alias("revision"),
        F.when(kind == "start", "Synchronizing").otherwise(F.coalesce(live, F.lit("Synchronizing"))).alias("authority"),
        (losses - (kind == "disconnect").cast("long")).alias("continuity_epoch"),
        levels_sorted(held(F.col("bids")), True).alias("bids"), levels_sorted(held(F.col("asks")), False).alias("asks"),
    )


def changed(side: str):
    """The level changes from old_<side>s to <side>s as an array of struct(side, price, old_qty, new_qty)."""
    as_map = lambda levels: F.map_from_entries(F.transform(levels, lambda x: F.struct(x["price"], x["qty"])))
    diff = F.map_zip_with(as_map(F.col(f"old_{side}s")), as_map(F.col(f"{side}s")), lambda _, a, b: F.struct(a.alias("old"), b.alias("new")))
    real = F.filter(F.map_entries(diff), lambda e: ~e["value"]["old"].eqNullSafe(e["value"]["new"]))
    return F.transform(real, lambda e: F.struct(F.lit(side).alias("side"), e["key"].alias("price"), e["value"]["old"].alias("old_qty"), e["value"]["new"].alias("new_qty")))


def mutations(books: DataFrame) -> DataFrame:
    """Level changes between successive snapshots of one epoch: side, price, old and new quantity (null: absent), and
    the cursor (epoch, position from 1 in the epoch). Equal books give none; none cross an epoch."""
    live = books.filter("kind = 'snapshot'")
    order = W.partitionBy("market", "continuity_epoch").orderBy("seq")
    pairs = live.withColumns({"old_bids": F.lag("bids").over(order), "old_asks": F.lag("asks").over(order)}).filter("old_bids IS NOT NULL")
    rows = pairs.select("market", "seq", "revision", "continuity_epoch", F.explode(F.concat(changed("bid"), changed("ask"))).alias("m")).select("market", "seq", "revision", "continuity_epoch", "m.*")
    position = F.row_number().over(W.partitionBy("market", "continuity_epoch").orderBy("seq", "side", "price"))
    return rows.withColumn("position", position.cast("long")).withColumn("cursor", F.format_string("%d:%d", "continuity_epoch", "position"))


def heads(changes: DataFrame) -> DataFrame:
    """The last position of each market's epochs."""
    return changes.groupBy("market", "continuity_epoch").agg(F.max("position").alias("head"))


def overrun(heads: DataFrame, readers: DataFrame, capacity: int) -> DataFrame:
    """Readers (market, continuity_epoch, position) that fell out of the retained mutations and must attach anew. An
    epoch without mutations has a null head and loses nobody."""
    lost = F.col("position") < F.col("head") - capacity
    return readers.join(heads, ["market", "continuity_epoch"], "left").withColumn("reason", F.when(lost, "Overrun"))


def summary(inputs: DataFrame) -> DataFrame:
    """Applied snapshots, derived mutations and continuity losses of each market, counted in one pass over its rows."""
    books = revised(inputs)
    order = W.partitionBy("market").orderBy("seq")
    counted = books.withColumns({f"old_{side}s": F.lag(f"{side}s").over(order) for side in ("bid", "ask")})
    # what stands before a snapshot is the last snapshot's book, but for the first one of an epoch
    before = F.last(F.when(F.col("kind") != "start", F.col("kind")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    counted = counted.withColumn("follows", (F.col("kind") == "snapshot") & (before == "snapshot"))
    n = F.when(F.col("follows"), F.size(F.concat(changed("bid"), changed("ask")))).otherwise(0)
    return counted.groupBy("market").agg(
        F.count_if(F.col("kind") == "snapshot").alias("snapshots_applied"), F.sum(n.cast("long")).alias("mutations_derived"),
        F.count_if(F.col("kind") == "disconnect").alias("continuity_losses"),
    )


def bbo(books: DataFrame, *keep: str) -> DataFrame:
    """Best bid and ask as text of each revision, and the columns ``keep``; a missing side is a dash."""
    return books.select("market", "revision", *keep, "authority", level_text(best(F.col("bids"), True)).alias("best_bid"), level_text(best(F.col("asks"), False)).alias("best_ask"))


def bbo_lines(books: DataFrame) -> DataFrame:
    """The line that a consumer prints for each revision."""
    return bbo(books).select("market", "revision", F.format_string("bbo revision=%d authority=%s best_bid=%s best_ask=%s", "revision", "authority", "best_bid", "best_ask").alias("line"))


def resolution_lines(books: DataFrame, changes: DataFrame, outcomes: DataFrame, origin: str = "venue") -> DataFrame:
    """The line of each resolution in ``books`` (of ``revised`` with resolutions), with what ``outcomes`` has of its
    market and seq: outcome, index, type, date and path. The cursor is that of the last mutation before it in its
    epoch, position 0 where there is none."""
    keys = ["market", "continuity_epoch"]
    ends = changes.select(*keys, "seq", "position", F.lit(None).cast("long").alias("revision"))
    asked = books.filter("kind = 'resolved'").select(*keys, "seq", F.lit(None).cast("long").alias("position"), "revision")
    so_far = W.partitionBy(*keys).orderBy("seq").rangeBetween(W.unboundedPreceding, 0)
    placed = ends.unionByName(asked).withColumn("position", F.coalesce(F.max("position").over(so_far), F.lit(0))).filter("revision IS NOT NULL")
    return placed.join(outcomes, ["market", "seq"], "left").select(
        "market", "seq",
        F.format_string(
            "resolution revision=%d cursor=%d:%d origin=%s outcome=%s index=%s type=%s date=%s path=%s",
            "revision", "continuity_epoch", "position", F.lit(origin), *[F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in ("outcome", "index", "type", "date", "path")],
        ).alias("line"),
    )


def summary_lines(counts: DataFrame) -> DataFrame:
    return counts.select("market", F.format_string("summary book snapshots_applied=%d mutations_derived=%d continuity_losses=%d", "snapshots_applied", "mutations_derived", "continuity_losses").alias("line"))


def book_lines(books: DataFrame) -> DataFrame:
    """The book line of each revision, at most three levels a side."""
    return books.select(
        "market", "revision",
        F.format_string(
            "book revision=%d authority=%s continuity_epoch=%d canonical_bids=%s canonical_asks=%s derived_complement_bids=%s derived_complement_asks=%s",
            "revision", "authority", "continuity_epoch", side_text(F.col("bids")), side_text(F.col("asks")), side_text(complement(F.col("asks"))), side_text(complement(F.col("bids"))),
        ).alias("line"),
    )


def mutation_lines(changes: DataFrame, origin: str = "snapshot") -> DataFrame:
    qty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return changes.select("market", F.format_string("mutation revision=%d cursor=%s origin=%s side=%s price=%s qty=%s->%s", "revision", "cursor", F.lit(origin), "side", rendered(F.col("price")), qty("old_qty"), qty("new_qty")).alias("line"))
