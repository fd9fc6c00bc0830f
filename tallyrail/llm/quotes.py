"""Quotation linking of messages, in DataFrame functions only.

A message's lines are parsed into nested quote levels. The lines of one level that follow each other are a passage,
whose normalised words are hashed in runs of three, wherever its lines break; whole lines, and passages of two words,
are hashed as they are. The hashes of quotations of every level are joined to the messages that wrote them, each
message replies to the one it quotes, and a conversation is put in order of its reply trees, without quotations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, read_table

#: Quote marks at the head of a line, with spaces between, and the line by which mailers introduce a quotation.
MARKS, INTRODUCTION = r"^((?:[ \t]*>)+)[ \t]?", r"(?i)^on .{1,200} wrote:$"
#: Words of a hashed run, and the first turns that one numbering block takes.
RUN_WORDS, BLOCK_TURNS = 3, 4096
#: Scripts without spaces between words: each letter counts as a word.
UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"


def parsed(text: Column) -> Column:
    """The lines of a text as struct(level, body): the number of quote marks and what stands behind them."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    return F.transform(
        lines,
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("level"),
            F.regexp_replace(x, MARKS, "").alias("body"),
        ),
    )


def normalised(line: Column) -> Column:
    """Lower case, letters and digits only, single spaces, also around letters of scripts without spaces."""
    spaced = F.regexp_replace(F.lower(line), UNSPACED, " $1 ")
    return F.trim(F.regexp_replace(spaced, r"[^\p{L}\p{N}]+", " "))


def worded(lines: Column) -> Column:
    """The words of all lines as struct(level, line, spot, word): spot is the line's hash, and whether it has
    ``RUN_WORDS`` words."""
    split = F.transform(lines, lambda x: F.struct(x["level"].alias("level"), F.filter(F.split(normalised(x["body"]), " "), lambda w: w != "").alias("words")))
    spot = lambda x: F.struct(F.xxhash64(F.array_join(x["words"], " ")).alias("line"), (F.size(x["words"]) >= RUN_WORDS).alias("long"))
    return F.flatten(F.transform(split, lambda x, i: F.transform(x["words"], lambda w: F.struct(x["level"].alias("level"), i.alias("line"), spot(x).alias("spot"), w.alias("word")))))


def parts(words: Column) -> Column:
    """struct(level, spots, whole, unit) of each hashed part of a column of ``worded``: whole lines and passages of two
    words in two lines (whole), and runs of ``RUN_WORDS`` words of one level, with the lines that they touch."""
    at = lambda i: F.get(words, i)
    level = lambda i: at(i)["level"]
    n = F.size(words)
    part = lambda i, spots, whole, unit: F.struct(level(i).alias("level"), spots.alias("spots"), F.lit(whole).alias("whole"), unit.alias("unit"))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    lines = F.transform(F.filter(places, lambda i: ~at(i - 1)["line"].eqNullSafe(at(i)["line"])), lambda i: part(i, F.array(at(i)["spot"]), True, at(i)["spot"]["line"]))
    run = range(RUN_WORDS)
    runs = F.transform(
        F.filter(places, lambda i: F.coalesce(sum(((level(i + k) == level(i)).cast("int") for k in run), F.lit(0)) == RUN_WORDS, F.lit(False))),
        lambda i: part(i, F.array_distinct(F.array(*[at(i + k)["spot"] for k in run])), False, F.xxhash64(*[at(i + k)["word"] for k in run])),
    )
    pairs = F.transform(
        F.filter(places, lambda i: (level(i) == level(i + 1)) & (at(i)["line"] != at(i + 1)["line"]) & ~level(i - 1).eqNullSafe(level(i)) & ~level(i + 2).eqNullSafe(level(i))),
        lambda i: part(i, F.array(at(i)["spot"], at(i + 1)["spot"]), True, F.xxhash64(F.concat_ws(" ", at(i)["word"], at(i + 1)["word"]))),
    )
    return F.concat(lines, runs, pairs)


def own_text(lines: Column) -> Column:
    """The lines of level 0 without introductions, blank lines at both ends removed."""
    own = F.transform(F.filter(lines, lambda x: (x["level"] == 0) & ~F.trim(x["body"]).rlike(INTRODUCTION)), lambda x: x["body"])
    return F.regexp_replace(F.array_join(own, "\n"), r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$", "")


def link_quotations(messages: DataFrame) -> DataFrame:
    """One row per message of ``messages`` (conv_id, turn, role, text): conv_id, turn, role, reply_to, root, position,
    n_quoted, n_linked and text without quotations.

    A quoted line, of any level, belongs to the latest earlier message of its conversation that wrote it as a line at
    level 0, or else to the one that wrote most of the runs of words that touch it, at least half; for lines below
    ``RUN_WORDS`` words the runs come first. Equal lines of a level count once in n_linked. A message replies to the
    message that wrote most of its quoted lines, of the least level of which any is found, the latest at ties, and to
    none if no line is found. root is the first message of its reply tree, and position counts a conversation's messages from 0 by root
    and turn, so a reply follows what it answers.

    Rows with a null conv_id are a conversation of their own; a null turn comes first, quotes and is quoted by none. Null and
    empty texts have no lines. Repeated rows of a turn are one message in links and stand next to each other. The
    author of a line comes from a running window over (conversation, line), not from pairs, so a line that every
    message repeats costs no more than others, and a long conversation is spread by its lines.
    """
    rows = messages.select("conv_id", "turn", "role", "text").withColumns(
        {"key_": F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")), "lines_": parsed(F.col("text"))}
    )
    placed = rows.filter("turn IS NOT NULL")
    quoting = F.exists("lines_", lambda x: x["level"] > 0)
    talks = placed.filter(quoting).select("key_").distinct()  # the others have nothing to link
    hashed = placed.join(talks, "key_", "left_semi").select("key_", "turn", worded(F.col("lines_")).alias("words"))
    each = hashed.select("key_", "turn", F.explode(parts(F.col("words"))).alias("u")).select("key_", "turn", "u.*")
    kind, spot = ["key_", "whole", "unit"], ["key_", "turn", "level", "line", "long"]
    asked = each.filter("level > 0").select(*kind, "turn", "level", F.explode("spots").alias("spot")).select(*kind, "turn", "level", "spot.*", F.lit(1).alias("side"))
    asked = checkpointed(asked.distinct())
    wrote = each.filter("level = 0").select(*kind, "turn", F.lit(0).alias("level"), F.lit(0).cast("long").alias("line"), F.lit(False).alias("long"), F.lit(0).alias("side")).distinct()
    both = wrote.join(asked.select(*kind).distinct(), kind, "left_semi").select(asked.columns).union(asked)
    earlier = W.partitionBy(*kind).orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    named = both.withColumn("author", F.max(F.when(F.col("side") == 0, F.col("turn"))).over(earlier)).filter("side = 1")
    shares = named.groupBy(*spot, "whole", "author").agg(F.count(F.lit(1)).alias("n"))
    shares = shares.withColumn("all", F.sum("n").over(W.partitionBy(*spot, "whole"))).filter("author IS NOT NULL AND (whole OR 2 * n >= all)")
    first = (F.col("whole") == F.col("long")).alias("first")
    found = shares.groupBy(*spot).agg(F.max(F.struct(first, "n", "author"))["author"].alias("author"))
    votes = found.groupBy("key_", "turn", "level", "author").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("near"), "n", "author")).alias("best")
    replies = checkpointed(votes.groupBy("key_", "turn").agg(best, F.sum("n").alias("n_linked")).select("key_", "turn", F.col("best.author").alias("reply_to"), "n_linked"))

    # the root of each reply: follow twice as many steps each round; turns only fall, so it ends
    up = replies.select("key_", "turn", F.col("reply_to").alias("root"))
    while True:
        step = up.select("key_", F.col("turn").alias("root"), F.col("root").alias("further"))
        more = up.join(step, ["key_", "root"], "left")
        if more.filter("further IS NOT NULL").isEmpty():
            break
        up = checkpointed(more.select("key_", "turn", F.coalesce("further", "root").alias("root")))

    out = rows.join(replies, ["key_", "turn"], "left").join(up, ["key_", "turn"], "left").select(
        "key_", "conv_id", "turn", "role", "reply_to", F.coalesce("root", "turn").alias("root"),
        F.size(F.filter("lines_", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), own_text(F.col("lines_")).alias("text"),
    ).withColumn("block", F.floor(F.col("root") / F.lit(BLOCK_TURNS)))
    counts = out.groupBy("key_", "block").agg(F.count(F.lit(1)).alias("n"))
    begins = counts.select("key_", "block", F.coalesce(F.sum("n").over(W.partitionBy("key_").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    inside = F.row_number().over(W.partitionBy("key_", "block").orderBy("root", "turn", "role", "text")) - 1
    numbered = out.withColumn("inside", inside).alias("o").join(begins.alias("b"), (F.col("o.key_") == F.col("b.key_")) & F.col("o.block").eqNullSafe(F.col("b.block")))
    return numbered.select("conv_id", "turn", "role", "reply_to", "root", (F.col("begin") + F.col("inside")).cast("long").alias("position"), "n_quoted", "n_linked", "text")


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(read_table(spark, sf_dir, "conversations"))
