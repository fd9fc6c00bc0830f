"""Removal of long byte strings that occur more than once, by column-wise construction over document windows.

Which strings have to be compared. A string of ``size`` bytes is named by its anchor, the k-gram of least hash in it
(the leftmost at ties). Equal strings have equal anchors at equal places, so strings with unlike anchors needn't meet.
The starts of a document that share an anchor form a window: the bytes that their strings cover. A corpus-wide count
of anchors leaves the windows whose anchor occurs twice at least; equal windows enter once, with their count.

Column-wise construction. The windows of an anchor are laid on top of each other with their anchors in one column.
From the last column to the first, each round inserts one symbol per window: the symbols read in the order of the
suffixes behind them are the round's segment of the collection's Burrows-Wheeler transform, a stable sort by symbol
gives the order of the longer suffixes, and the common prefixes of neighbours are updated by one more symbol and the
least prefix between them. Suffixes of unlike columns belong to unlike places of the anchor and can't be equal
strings, so every column keeps a segment of its own and no round walks the segments of the others. A start is
repeated if a neighbour of its suffix shares ``size`` symbols. Windows come to a task sorted by anchor as a stream of
batches; only the current batch's segment is held.

Anchors whose windows differ in more than ``GROUP_LIMIT`` ways are not laid out in one task. Their strings are counted
one by one by hash, place and anchor, in aggregations that combine before the shuffle.

Strings are of bytes, or of words: then the 64-bit hash of each word between white space is one symbol, and sizes and
places count words, however many bytes they take and whatever white space stands between them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, map_arrow, mix64, read_table, released, slices, utf8
from .hashing import PrefixHash, window_minima

#: Bytes of a string that counts, and of the k-gram that names it.
SIZE, GRAM = 400, 160
#: Words of the k-gram that names a string of words.
WORD_GRAM = 24
#: Unlike windows of one anchor that a task lays out, windows of a batch, and of a partition on average.
GROUP_LIMIT, BATCH_WINDOWS, PARTITION_WINDOWS = 4096, 8192, 16_384
#: Starts of a document that are hashed at a time.
PART = 1 << 19
POSITION = np.uint64((1 << 28) - 1)
UID = ["u1", "u2"]
#: White space of one byte, first bytes of longer white space, and words that are hashed at a time.
BLANK = np.isin(np.arange(256), list(b"\t\n\v\f\r\x1c\x1d\x1e\x1f "))
LONGER = [x.encode() for x in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
LONGER_HEAD = np.isin(np.arange(256), [x[0] for x in LONGER])
PART_WORDS = 1 << 16


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word of the rows' UTF-8; words are what str.split() finds."""
    blank = BLANK[data]
    heads = np.flatnonzero(LONGER_HEAD[data])
    for mark in LONGER if len(heads) else []:
        at = heads[heads <= len(data) - len(mark)]
        at = at[np.all([data[at + k] == b for k, b in enumerate(mark)], axis=0)]
        for k in range(len(mark)):
            blank[at + k] = True
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(~blank & (np.r_[True, blank[:-1]][: len(data)] | edge[:-1]))
    end = np.flatnonzero(~blank & (np.r_[blank[1:], True][: len(data)] | edge[1:])) + 1
    return begin, end


def symbols_of(column: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, or the hashes of its words, and the row offsets into them."""
    data, offsets = utf8(column)
    if not words:
        return data, offsets
    begin, end = word_bounds(data, offsets)
    hashes = np.zeros(len(begin), np.uint64)
    for s in range(0, len(begin), PART_WORDS):
        b, e = begin[s : s + PART_WORDS], end[s : s + PART_WORDS]
        hashes[s : s + PART_WORDS] = PrefixHash(data[b[0] : e[-1]]).of(b - b[0], e - b[0])
    return hashes, np.searchsorted(begin, offsets)


def bodies_of(column: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a column of ``fetched`` windows and the row offsets into them."""
    data, offsets = utf8(column)
    return (np.frombuffer(data.tobytes(), np.uint64), offsets // 8) if words else (data, offsets)


def identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """u1, u2, key and text. Rows with equal key and text share the 128 bits; all that is found out holds for both."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.xxhash64(F.col(key), F.lit("key")).alias("u1"), F.xxhash64(body, F.col(key), F.lit("text")).alias("u2"),
        F.col(key).alias("doc_id"), body.alias("text"),
    )


def anchors(docs: DataFrame, size: int, gram: int, words: bool = False, part_: int = PART) -> DataFrame:
    """One row per window: anchor hash g, window hash h, u1, u2, and the positions of its anchor and its first and
    last start."""
    width = size - gram + 1

    def of_buffer(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        hashes = PrefixHash(data)
        grams = hashes.windows(gram)
        least = window_minima((grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64), width)
        spans = np.maximum(0, np.diff(offsets) - size + 1)  # starts of each document
        row = np.repeat(np.arange(len(spans)), spans)
        if not len(row):
            return (np.zeros(0, np.int64),) * 6
        start = np.arange(len(row)) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(offsets[:-1], spans)
        anchor = (least[start] & POSITION).astype(np.int64)
        first = np.flatnonzero(np.r_[True, (np.diff(anchor) != 0) | (np.diff(row) != 0)])
        last = np.r_[first[1:], len(row)] - 1
        a, lo, hi, row = anchor[first], start[first], start[last], row[first]
        h = mix64(hashes.of(lo, hi + size) + mix64((a - lo).astype(np.uint64) * np.uint64(1 << 20) + (hi - lo).astype(np.uint64) + np.uint64(1)))
        begin = offsets[row]
        return grams[a].view(np.int64), h.view(np.int64), row, a - begin, lo - begin, hi - begin

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text", part_):
            data, offsets = symbols_of(part.column("text"), words)
            jobs = [(data, offsets, 0)]
            if len(part) == 1 and offsets[1] > part_ + size:
                jobs = [(data[s : s + part_ + size - 1], np.array([0, len(data[s : s + part_ + size - 1])]), s) for s in range(0, int(offsets[1]) - size + 1, part_)]
            for buffer, cuts, shift in jobs:
                g, h, row, a, lo, hi = of_buffer(buffer, cuts)
                rows = pa.array(row, pa.int64())
                yield pa.record_batch(
                    [pa.array(g), pa.array(h), part.column("u1").take(rows), part.column("u2").take(rows)] + [pa.array(x + shift, pa.int64()) for x in (a, lo, hi)],
                    names=["g", "h", "u1", "u2", "a", "lo", "hi"],
                )

    return map_arrow(docs.select("u1", "u2", "text"), run, "g long, h long, u1 long, u2 long, a long, lo long, hi long")


def fetched(docs: DataFrame, wanted: DataFrame, size: int, words: bool = False) -> DataFrame:
    """g, h, place of the first start before the anchor, number of starts and bytes of each wanted window; with
    ``words`` eight bytes for each word's hash."""
    unit = 8 if words else 1
    lists = wanted.groupBy(*UID).agg(F.collect_list(F.struct("g", "h", "a", "lo", "hi")).alias("windows"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for text, windows in zip(batch.column("text"), batch.column("windows"), strict=True):
            data = symbols_of(pa.array([text]), True)[0].tobytes() if words else text.as_buffer().to_pybytes()
            for k in range(0, len(windows), 4096):
                w = windows.values.slice(k, 4096).to_pylist() if len(windows) > 4096 else windows.as_py()
                yield pa.record_batch(
                    [
                        pa.array([x["g"] for x in w], pa.int64()), pa.array([x["h"] for x in w], pa.int64()), pa.array([x["a"] - x["lo"] for x in w], pa.int32()),
                        pa.array([x["hi"] - x["lo"] + 1 for x in w], pa.int32()), pa.array([data[x["lo"] * unit : (x["hi"] + size) * unit] for x in w], pa.binary()),
                    ],
                    names=["g", "h", "before", "starts", "bytes"],
                )

    joined = docs.select(*UID, "text").join(lists, UID).select("text", "windows")
    return map_arrow(joined, run, "g long, h long, before int, starts int, bytes binary")


def repeated_columns(group: np.ndarray, before: np.ndarray, starts: np.ndarray, bodies: list[np.ndarray], size: int, gram: int) -> np.ndarray:
    """Column-wise construction over windows sorted by group: repeated[window, start], as far as other windows of
    its group show."""
    m, lead = len(group), size - gram
    width = lead + size
    codes, none = np.concatenate(bodies), 256  # no symbol, unlike any other
    if codes.dtype != np.uint8:
        known, codes = np.unique(codes, return_inverse=True)
        none = len(known)
    symbols = np.full((m, width), none, np.int16 if none < 1 << 15 else np.int32)
    done = 0
    for k, body in enumerate(bodies):
        at = lead - before[k]
        symbols[k, at : at + len(body)] = codes[done : done + len(body)]
        done += len(body)
    columns = np.ascontiguousarray(symbols.T)
    number = np.cumsum(np.r_[0, np.diff(group) != 0]).astype(np.int64) * (none + 1)
    order, common = np.arange(m), np.zeros(m + 1, np.int64)  # common[k]: of the suffixes at k - 1 and k
    repeated = np.zeros((m, lead + 1), bool)
    for column in range(width - 1, -1, -1):
        segment = columns[column][order]
        key = number[order] + segment
        turn = np.argsort(key, kind="stable")
        key = key[turn]
        joined = np.flatnonzero((key[1:] == key[:-1]) & (segment[turn[1:]] != none)) + 1
        longer = np.zeros(m + 1, np.int64)
        if len(joined):
            bounds = np.stack([turn[joined - 1] + 1, turn[joined] + 1], axis=1).reshape(-1)
            longer[joined] = np.minimum.reduceat(common, bounds)[::2] + 1
        order, common = order[turn], longer
        if column <= lead:
            enough = common >= size
            repeated[order, column] = enough[:-1] | enough[1:]
    # column c holds the starts that lie lead - c before the anchor; turn to starts counted from the window's first
    out = np.zeros((m, lead + 1), bool)
    for k in range(m):
        at = lead - before[k]
        out[k, : starts[k]] = repeated[k, at : at + starts[k]]
    return out


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] of each run of true values."""
    edges = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


SPANS = "array<struct<first:int,last:int>>"


def constructed(windows: DataFrame, count: int, size: int, gram: int, words: bool = False) -> DataFrame:
    """g, h and spans of repeated starts of each window, from the other windows of its anchor."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        g, h = rows.column("g").to_numpy(), rows.column("h").to_numpy()
        rows = rows.filter(pa.array(np.r_[True, (g[1:] != g[:-1]) | (h[1:] != h[:-1])]))  # rows repeated in the table
        g = rows.column("g").to_numpy()
        bodies = [np.frombuffer(x, np.uint64 if words else np.uint8) for x in rows.column("bytes").to_pylist()]
        found = repeated_columns(g, rows.column("before").to_numpy(), rows.column("starts").to_numpy(), bodies, size, gram)
        some = np.flatnonzero(found.any(axis=1))
        spans = [[{"first": s, "last": e} for s, e in runs(found[k])] for k in some]
        return pa.record_batch(
            [pa.array(g[some], pa.int64()), pa.array(rows.column("h").to_numpy()[some], pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))],
            names=["g", "h", "spans"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows >= BATCH_WINDOWS:
                g = held.column("g").to_numpy()
                cut = int(np.searchsorted(g, g[-1]))  # the last anchor may go on
                if cut:
                    yield solve(held.slice(0, cut))
                    held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield solve(held)
        held = None
        released()

    parts = max(1, -(-count // PARTITION_WINDOWS))
    dealt = windows.repartition(parts, "g").sortWithinPartitions("g", "h")
    return dealt.mapInArrow(run, f"g long, h long, spans {SPANS}")


def counted(windows: DataFrame, size: int, words: bool = False) -> DataFrame:
    """The same result for anchors with too many unlike windows: strings are counted by anchor, place and hash."""

    def strings(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "bytes", 1 << 18):
            data, offsets = bodies_of(part.column("bytes"), words)
            hashes = PrefixHash(data)
            n = part.column("starts").to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = offsets[row] + place
            rows = pa.array(row)
            yield pa.record_batch(
                [part.column("g").take(rows), part.column("h").take(rows), pa.array(place, pa.int32()), pa.array(part.column("before").to_numpy()[row] - place, pa.int32()), pa.array(hashes.of(start, start + size).view(np.int64))],
                names=["g", "h", "start", "place", "string"],
            )

    rows = map_arrow(windows, strings, "g long, h long, start int, place int, string long")
    keys = ["g", "place", "string"]
    twice = checkpointed(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys))
    return rows.join(twice, keys).groupBy("g", "h").agg(F.collect_list(F.struct(F.col("start").alias("first"), F.col("start").alias("last"))).alias("spans"))


def gram_of(size: int, words: bool) -> int:
    """The anchor's symbols for strings of ``size``: a shorter string has a shorter anchor."""
    if size < 2:
        raise ValueError("strings must have two symbols at least")
    return min(WORD_GRAM, size // 2) if words else min(GRAM, max(1, size * 2 // 5))


def repeated_spans(docs: DataFrame, size: int = SIZE, gram: int | None = None, words: bool = False, part: int = PART) -> DataFrame:
    """u1, u2 and spans (array of first and last repeated start) of each document of ``identified`` that has any.

    Counts are written before they are joined, so that the windows of a very common anchor can be dealt to several
    tasks. Equal windows agree in the 64-bit hash of their anchor and in another one of bytes and places.
    """
    gram = gram or gram_of(size, words)
    found = anchors(docs, size, gram, words, part)
    twice = checkpointed(found.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g"))
    windows = checkpointed(found.join(twice, "g"))
    kinds = windows.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("u1", "u2", "a", "lo", "hi")).alias("one"))
    kinds = checkpointed(kinds)
    whole = kinds.filter("n > 1").select("g", "h")
    mixed = checkpointed(kinds.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"))
    unlike = checkpointed(kinds.join(mixed, "g").select("g", "h", "kinds", "n", "one.*"))
    laid = unlike.filter(F.col("kinds") <= GROUP_LIMIT)
    spans = checkpointed(constructed(fetched(docs, laid, size, words), laid.count(), size, gram, words))
    crowded = unlike.filter(F.col("kinds") > GROUP_LIMIT)
    if not crowded.isEmpty():
        spans = checkpointed(spans.unionByName(counted(checkpointed(fetched(docs, crowded, size, words).dropDuplicates(["g", "h"])), size, words)))
    known = spans.join(whole, ["g", "h"], "left_anti").unionByName(
        whole.withColumn("spans", F.lit(None).cast(SPANS))
    )
    each = windows.join(checkpointed(known), ["g", "h"]).select(
        *UID,
        F.explode(
            F.when(F.col("spans").isNull(), F.array(F.struct(F.col("lo").alias("first"), F.col("hi").alias("last"))))
            .otherwise(F.transform("spans", lambda s: F.struct((F.col("lo") + s["first"]).alias("first"), (F.col("lo") + s["last"]).alias("last"))))
        ).alias("span"),
    )
    return checkpointed(each.groupBy(*UID).agg(F.collect_set("span").alias("spans")))  # the windows aren't needed any more


def covered(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal [begin, end) runs of bytes that the ranges cover."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def without_repeats(docs: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text", whole: bool = False, words: int = 0, part: int = PART) -> DataFrame:
    """Remove each byte that a string of ``size`` bytes covers that also starts elsewhere, same document included.

    A row per input row: doc_id, n_bytes, n_removed, n_spans and kept_sha256. With ``whole`` also ``kept``: what is
    left as text, in which a character cut by a span is left out. With ``words`` what ``kept`` has is also without each
    string of so many words between white space that also starts elsewhere, from the first byte of its first word to
    the last of its last; the counts and the digest are of the bytes' rule alone.

    Null and empty texts, and texts below ``size`` bytes, lose nothing themselves. Strings are judged on the input:
    both copies of a repeated row go. An empty table gives no rows. Other columns aren't read.
    """
    rows = identified(docs, key, text)
    joined = rows.join(repeated_spans(rows, size, part=part), UID, "left")
    if words:
        joined = joined.join(repeated_spans(rows, words, words=True, part=part).withColumnRenamed("spans", "word_spans"), UID, "left")
    joined = joined.select("doc_id", "text", "spans", *["word_spans"] * bool(words))

    def left(data: bytes, cuts: list[tuple[int, int]]) -> bytes:
        edges = [0, *[x for c in cuts for x in c], len(data)]
        return b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)) if cuts else data

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = []
        for row, (body, spans) in enumerate(zip(batch.column("text"), batch.column("spans"), strict=True)):
            data = body.as_buffer().to_pybytes()
            ranges = [(s["first"], s["last"] + size) for s in spans.as_py() or []]
            cuts = covered(ranges)
            kept = rest = left(data, cuts)
            if words and (of_words := batch.column("word_spans")[row].as_py()):
                begin, end = word_bounds(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                rest = left(data, covered(ranges + [(int(begin[s["first"]]), int(end[s["last"] + words - 1])) for s in of_words]))
            found.append((len(data), len(data) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), rest.decode("utf-8", "ignore") if whole else None))
        columns = list(zip(*found, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        out = [batch.column("doc_id")] + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        yield pa.record_batch(out[: 5 + whole], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + whole])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(joined, run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * whole)


#: Words of the shortest passage that no two documents may share: over 50.
PASSAGE_WORDS = 51


def op8_column_wise_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of the rule of 400 bytes, and ``text``: what is left without those strings and without passages of
    ``PASSAGE_WORDS`` words that occur again, of which many have less than 400 bytes."""
    return without_repeats(read_table(spark, sf_dir, "documents"), whole=True, words=PASSAGE_WORDS).withColumnRenamed("kept", "text")
