"""Nearest neighbours by cross-polytope hashing.

A table hashes a unit vector by a pseudo-random rotation, three rounds of sign flips and a fast Hadamard transform,
to the nearest of the signed axes: the coordinate of largest size, with its sign. Two such hashes make a bucket. A
query probes, in each table, the buckets of the axes that come next, in order of what they lose against the best. The
vectors of the probed buckets are the candidates.

Whole vectors aren't sent to the buckets, but codes of one byte a component. They choose the ``SHORT_LIST`` candidates
of a query, which are then joined to their vectors and ranked by exact inner products in double precision.

Inner product search is turned to search among unit vectors by bands of norms. Vectors are hashed by their directions,
and those of a band, whose norms differ by a tenth at most, have buckets of their own, which a query probes as many of
as the band's rows ask for: what is among the best of all is among the best of its band, and there the norm hardly
counts. The vectors of all bands of few rows form one more bucket that every query probes.

A query whose buckets hold fewer candidates than it may return is compared with all vectors, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, map_arrow, read_table, stream64, utf8

#: Neighbours returned, tables, and vectors that a task holds at a time on average.
NEIGHBOURS, TABLES, BUCKET_ROWS = 20, 24, 20_000
#: Candidates of a query that are ranked exactly, for each neighbour asked for.
SHORT_LIST = 3
#: Heavy buckets up to which their list is broadcast: it is below two MB then.
BROADCAST_BUCKETS = 100_000
#: Probes of a table are SCALE / sqrt(rows), within these bounds: the nearest of few rows lie farther off.
SCALE, LEAST_PROBES, MOST_PROBES = 20_000, 64, 4096
#: Queries of a block where too few candidates were found, and vectors they are compared with at a time.
QUERY_BLOCK, COMPARED = 512, 4096
#: Scored pairs that a task holds before it reduces them to the best of each query.
HELD_PAIRS = 1_000_000
#: Least norm of a band by its largest, and the rows up to which a band is ranked whole. BARE is the band of those.
BAND, FEW_ROWS, BARE = 0.9, 128, -1


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of rows whose length is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random rotation in n log n steps; rows are padded with zeros to a power of two."""
    n = 1 << max(1, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    signs = (stream64(seed, 3 * n) >> np.uint64(63)).astype(np.float64).reshape(3, n) * 2 - 1
    for s in signs:
        x = hadamard(x * s)
    return x


def axes_of(width: int) -> int:
    """Signed axes of rotated rows of ``width`` components."""
    return 2 << max(1, (width - 1).bit_length())


def ranked_axes(y: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` signed axes nearest to each row, nearest first, as numbers 2 i + (negative), and their lengths."""
    signed = np.stack([y, -y], axis=2).reshape(len(y), -1)
    count = min(count, signed.shape[1])
    top = np.argpartition(-signed, count - 1, axis=1)[:, :count]
    size = np.take_along_axis(signed, top, 1)
    order = np.lexsort((top, -size), axis=1)
    return np.take_along_axis(top, order, 1), np.take_along_axis(size, order, 1)


def buckets(x: np.ndarray, table: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The two axes of each of the ``probes`` best buckets of each row in a table, best first."""
    wide = 1 if probes == 1 else max(16, int(2.5 * probes**0.5))
    (a, sa), (b, sb) = (ranked_axes(rotated(x, 7919 * (2 * table + half) + 1), wide) for half in (0, 1))
    cost = ((sa[:, :1] - sa)[:, :, None] ** 2 + ((sb[:, :1] - sb) ** 2)[:, None, :]).reshape(len(x), -1)
    order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(a, order // b.shape[1], 1), np.take_along_axis(b, order % b.shape[1], 1)


def sound(df: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and v of the vectors that can take part: not null or zero, all components finite."""
    return df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0)
    )


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def coded(x: np.ndarray) -> pa.Array:
    """A float32 scale and a signed byte for each component of every row."""
    scale = (np.abs(x).max(axis=1) / 127).astype(np.float32)
    scale[scale == 0] = np.finfo(np.float32).tiny  # a vector below the range of float32 is next to nothing beside others
    codes = np.clip(np.rint(x / scale[:, None].astype(np.float64)), -127, 127).astype(np.int8)
    body = np.concatenate([scale.view(np.int8).reshape(len(x), 4), codes], axis=1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(body.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(body))]).cast(pa.binary())


def vectors_of(column: pa.Array, width: int) -> np.ndarray:
    """What ``coded`` rows stand for, as float32."""
    data, _ = utf8(column)
    body = data.reshape(len(column), width + 4)
    return body[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(body[:, :4]).view(np.float32)


def hashed(rows: DataFrame, tables: int, shared: dict[int, int], bands: list[tuple[int, int]] | None = None) -> DataFrame:
    """bucket (band, table and the group of ``shared[band]`` first axes), id, pairs and code. ``pairs`` are the places in
    the bucket, of first and second axis, as uint32 bytes: the one of an index row with its ``band``, and all that a
    query probes in each of the ``bands`` (number and probes). The band BARE is one bucket with one place."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = matrix(batch.column("v"))
        code = coded(x)
        norm = np.abs(x).max(axis=1, keepdims=True)
        x = x / norm  # squares stay in range
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        number = batch.column("band").to_numpy() if bands is None else None
        width = axes_of(x.shape[1])

        def sent(bucket: np.ndarray, row: np.ndarray, first: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
            cuts = np.r_[first, len(place)] * 4
            pairs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(place.astype("<u4"))])
            at = pa.array(row)
            return pa.record_batch([pa.array(bucket, pa.int64()), batch.column("id").take(at), pairs, code.take(at)], names=["bucket", "id", "pairs", "code"])

        whole = np.arange(len(x)) if bands is not None else np.flatnonzero(number == BARE)
        if len(whole) and (bands is None or any(band == BARE for band, _ in bands)):
            yield sent(np.full(len(whole), -1), whole, np.arange(len(whole)), np.zeros(len(whole), np.int64))
        rest = np.arange(len(x)) if bands is not None else np.flatnonzero(number != BARE)
        probed = [b for b in bands if b[0] != BARE] if bands is not None else [(None, 1)]
        if not len(rest) or not probed:
            return
        together = np.array([shared.get(int(b), 1) for b in number[rest]]) if bands is None else None
        for table in range(tables):
            best = buckets(x[rest], table, max(probes for _, probes in probed))
            for band, probes in probed:
                a, b = (c[:, :probes] for c in best)
                row = np.repeat(np.arange(len(rest)), a.shape[1])
                a, b = a.reshape(-1), b.reshape(-1)
                of, size = (number[rest][row], together[row]) if band is None else (band, shared[band])
                bucket, place = (of * width + a // size) * tables + table, a % size * width + b
                order = np.lexsort((bucket, row))
                row, bucket, place = row[order], bucket[order], place[order]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])])
                yield sent(bucket[first], rest[row[first]], first, place)

    return map_arrow(rows.select("id", "v", *["band"] * (bands is None)), run, "bucket long, id long, pairs binary, code binary")


def best_of(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` best vectors of each query among (query, vector, score); a pair found again is one."""
    q, v, s = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((v, -s, q))
    order = order[np.r_[True, (np.diff(q[order]) != 0) | (np.diff(v[order]) != 0)]]
    q, v, s = q[order], v[order], s[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return q[rank < keep], v[rank < keep], s[rank < keep]


def compared(questions: DataFrame, n_questions: int, entries: DataFrame, n_entries: int, keep: int) -> DataFrame:
    """question, id and near: the ``keep`` best entries of each question in each part of all entries. A task holds a
    block of questions and streams a part past them."""
    blocks, parts = -(-n_questions // QUERY_BLOCK), -(-n_entries // BUCKET_ROWS)
    dealt = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = questions.select(dealt("block", blocks).alias("block"), each(parts).alias("part"), F.lit(0).alias("side"), "id", "v")
    rows = entries.select(each(blocks).alias("block"), dealt("part", parts).alias("part"), F.lit(1).alias("side"), "id", "v")
    both = asks.union(rows).repartition("block", "part").sortWithinPartitions("block", "part", "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, found = None, [], [], []

        def release() -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.record_batch([pa.array(x) for x in best_of(found, keep)], names=["question", "id", "near"])
                found.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            block, part, side, own = (batch.column(c).to_numpy() for c in ("block", "part", "side", "id"))
            edges = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1])])
            for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(block)], strict=True):
                if (block[s], part[s]) != now:
                    yield from release()
                    now, ids, vectors = (block[s], part[s]), [], []
                if side[s] == 0:
                    ids.append(own[s:e])
                    vectors.append(matrix(batch.column("v").slice(s, e - s)))
                    continue
                for at in range(s, e if ids else s, COMPARED):
                    end = min(e, at + COMPARED)
                    with np.errstate(all="ignore"):  # products may leave the range of doubles
                        near = np.concatenate(vectors) @ matrix(batch.column("v").slice(at, end - at)).T
                    near[np.isnan(near)] = -np.inf
                    least = np.partition(near, max(0, end - at - keep), axis=1)[:, max(0, end - at - keep)]
                    x, y = np.nonzero(near >= least[:, None])
                    found.append((np.concatenate(ids)[x], own[at:end][y], near[x, y]))
                    if sum(len(f[0]) for f in found) > HELD_PAIRS:
                        found[:] = [best_of(found, keep)]
        yield from release()

    return both.mapInArrow(run, "question long, id long, near double")


def short_lists(found: DataFrame, keep: int) -> DataFrame:
    """question and id of the ``keep`` nearest of each question; tasks keep their own best before the shuffle, and
    no question's candidates are gathered in one row."""
    once = found.groupBy("question", "id").agg(F.min(-F.col("near")).alias("low"))
    turn = F.row_number().over(W.partitionBy("question").orderBy("low", "id"))
    return once.withColumn("turn", turn).filter(F.col("turn") <= keep).select("question", "id")


def nearest(df: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, tables: int = TABLES, probes: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` nearest rows found for each row where ``is_query``.

    ``is_query`` is a function of the id column. Nearness is the inner product in double precision of the vectors as
    given; ties go to the smaller id; a query isn't its own neighbour. Vectors that are null, zero or hold null or
    non-finite components take no part, nor do rows without id or of another length than the most common one.
    Repeated rows of an id are one. ``probes`` are the buckets that a query looks into in each table and band; by
    default they follow from the band's rows. Queries whose buckets hold fewer than ``k`` other vectors are compared
    with all vectors. If fewer than ``k`` candidates exist, all are returned.

    Equal vectors are one entry of the index with its k + 1 smallest ids, which is all that a result can show, and
    equal queries are searched once. First axes are put together so that a bucket has about ``BUCKET_ROWS`` vectors,
    and a bucket of more is dealt to several tasks by salt. A task holds the codes of one bucket's part, looks up the
    queries that are streamed past, and keeps the best of each query, so candidates never leave it.
    """
    rows = sound(df, key, vector)
    length = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    if length is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    rows = rows.filter(F.size("v") == length["n"]).dropDuplicates(["vec_id"])
    # the k + 1 smallest ids of equal vectors: those of each map task first, so that a hot vector shrinks before it meets
    few = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    salted = rows.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(few(F.collect_set("vec_id")).alias("ids"))
    entries = checkpointed(salted.groupBy("v").agg(few(F.flatten(F.collect_list("ids"))).alias("ids")).select(F.col("ids")[0].alias("id"), "v", "ids"))
    square = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    usual = (square > 0) & (square < float("inf"))  # squares of the others leave the range of doubles
    high = entries.agg(F.max(F.when(usual, square))).first()[0] or 1.0
    band = F.when(usual, F.floor(F.log(F.lit(high) / square) / F.lit(-2 * math.log(BAND))).cast("long")).otherwise(F.lit(BARE))
    banded = entries.select("id", "v", band.alias("band"))
    sizes = {r["band"]: r["count"] for r in banded.groupBy("band").count().collect()}
    bands = [(b, probes or max(LEAST_PROBES, min(MOST_PROBES, int(SCALE / n**0.5)))) for b, n in sorted(sizes.items()) if b != BARE and n > FEW_ROWS]
    width = length["n"]
    axes = axes_of(width)
    shared = {b: 1 << max(0, min(axes.bit_length() - 1, int(math.log2(max(1, BUCKET_ROWS * axes / sizes[b]))))) for b, _ in bands}
    if len(bands) < len(sizes):
        banded = banded.withColumn("band", F.when(F.col("band").isin([b for b, _ in bands]), F.col("band")).otherwise(F.lit(BARE)))
        bands.append((BARE, 1))
    asked = rows.filter(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "v").join(entries.select("v", "id"), "v").select("query_id", "id")
    asked = checkpointed(asked)
    questions = entries.join(asked.select("id").distinct(), "id", "left_semi")

    index = hashed(banded, tables, shared)
    heavy = checkpointed(index.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * BUCKET_ROWS).select("bucket", F.ceil(F.col("n") / F.lit(BUCKET_ROWS)).cast("int").alias("parts")))
    n_heavy = heavy.count()
    of = F.broadcast(heavy) if n_heavy <= BROADCAST_BUCKETS else heavy
    split = lambda d: d.join(of, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1))) if n_heavy else d.withColumn("parts", F.lit(1))
    data = split(index).select("bucket", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("side"), "id", "pairs", "code")
    probes_ = split(hashed(questions, tables, shared, bands)).select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "id", "pairs", "code")
    both = data.union(probes_).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "side", "id")
    short = SHORT_LIST * (k + 1)
    places = axes * max([*shared.values(), 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found = None, [], []
        ids = vectors = starts = None

        def shrink() -> None:
            found[:] = [best_of(found, short)]  # tables find a pair again

        def release() -> Iterator[pa.RecordBatch]:
            if found:
                shrink()
                yield pa.record_batch([pa.array(x) for x in found[0]], names=["question", "id", "near"])
                found.clear()

        def laid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """ids and vectors of the held index rows in order of their places, and where each place starts."""
            if not held:
                return np.zeros(0, np.int64), np.zeros((0, width), np.float32), np.zeros(places + 1, np.int64)
            table = pa.Table.from_batches(held).combine_chunks()
            place = np.frombuffer(utf8(table.column("pairs").chunk(0))[0].tobytes(), "<u4")
            order = np.argsort(place, kind="stable")
            starts = np.searchsorted(place[order], np.arange(places + 1))
            return table.column("id").to_numpy()[order], vectors_of(table.column("code").chunk(0), width)[order], starts

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, part, side = (batch.column(c).to_numpy() for c in ("bucket", "part", "side"))
            edges = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1])])
            for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(bucket)], strict=True):
                if (bucket[s], part[s]) != now:
                    now, held, ids = (bucket[s], part[s]), [], None
                if side[s] == 0:
                    held.append(batch.slice(s, e - s).select(["id", "pairs", "code"]))
                    continue
                if ids is None:
                    ids, vectors, starts = laid()
                    held = []
                for at in range(s, e if len(ids) else s, 64):
                    some = batch.slice(at, min(64, e - at))
                    data, cuts = utf8(some.column("pairs"))
                    place = np.frombuffer(data.tobytes(), "<u4").astype(np.int64)
                    lo, hi = starts[place], starts[place + 1]
                    n = hi - lo
                    x = np.repeat(np.repeat(np.arange(len(some)), np.diff(cuts) // 4), n)
                    y = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    of_query = vectors_of(some.column("code"), width)
                    for t in range(0, len(x), 1 << 18):
                        xs, ys = x[t : t + (1 << 18)], y[t : t + (1 << 18)]
                        found.append((some.column("id").to_numpy()[xs], ids[ys], np.einsum("ij,ij->i", of_query[xs], vectors[ys]).astype(np.float64)))
                    if sum(len(f[0]) for f in found) > HELD_PAIRS:
                        shrink()
                        if len(found[0][0]) > HELD_PAIRS // 2:
                            yield from release()
        yield from release()

    best = both.mapInArrow(run, "question long, id long, near double")
    pairs = checkpointed(short_lists(best, short))
    n_entries = sum(sizes.values())
    full = pairs.groupBy("question").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(k + 1, n_entries))
    lacking = checkpointed(questions.select("id", "v").join(full.select(F.col("question").alias("id")), "id", "left_anti"))
    if n_lacking := lacking.count():
        whole = short_lists(compared(lacking, n_lacking, entries.select("id", "v"), n_entries, short), short)
        pairs = pairs.join(lacking.select(F.col("id").alias("question")), "question", "left_anti").unionByName(whole)
    # exact products, added in order of the components, so equal vectors have equal scores wherever they stand
    doubles = lambda c: F.col(c).cast("array<double>")
    exact = F.aggregate(F.zip_with(doubles("asks"), doubles("v"), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x).alias("score")
    scored = pairs.join(entries, "id").join(questions.select(F.col("id").alias("question"), F.col("v").alias("asks")), "question").select("question", exact, "id", "ids")
    # each entry found is its ids; a question's own entry may hold the query itself, so k + 1 entries are kept
    top = scored.groupBy("question").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "id", "ids"))), 1, k + 1).alias("found"))
    named = top.select("question", F.explode("found").alias("f")).select("question", "f.low", F.explode("f.ids").alias("vec_id"))
    listed = named.groupBy("question").agg(F.slice(F.array_sort(F.collect_list(F.struct("low", "vec_id"))), 1, k + 1).alias("found"))
    answers = asked.join(listed, asked["id"] == listed["question"]).select("query_id", F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return answers.select("query_id", F.posexplode("found").alias("at", "f")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.low")).alias("score"))


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
