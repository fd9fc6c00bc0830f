"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. Each document gets the minima of ``BANDS * ROWS`` hash functions over its distinct word shingles. Each group of
   ``ROWS`` whole minima gives a band key; of every minimum only ``BITS`` low bits are kept, packed in words.
2. Documents with equal sets form a class, with its smallest doc_id; only that document's signature goes on, so a
   group of copies is one member of its buckets.
3. Sets that share a band key are candidates. Buckets are counted and named before their members are joined to them,
   so no task gathers a bucket to find its name. Bit counts of the packed signatures give the share of equal entries,
   and that, corrected for chance agreement, an estimate of the similarity. Candidates below ``FLOOR`` are left.
4. Families, the connected parts of what remains, hold every link: a pair at the threshold misses all bands with a
   chance of 1e-8 and falls below the floor with one of 1e-9. Inside a family, links are confirmed on whole sets.
   A task takes families of up to ``BLOCK`` members whole. Larger ones are compared with a few leaders first, and the
   members that are not connected with most of the family are then compared with all members, in blocks.
5. Connected components of the confirmed links. Pairs already connected are not compared again, so neither candidates
   nor links of a group are ever written out as all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, map_arrow, mix64, read_table, released, slices, stream64, utf8
from .graph import components
from .hashing import PrefixHash

#: Words of a shingle, and the least similarity of a link in hundredths.
WORDS, PERCENT = 5, 75
#: Hash functions are BANDS * ROWS; low bits kept of each minimum.
BANDS, ROWS, BITS = 48, 4, 4
#: Least estimated similarity of candidates that are compared in full: six standard deviations below the threshold.
FLOOR = 0.55
#: Members of a bucket that a task compares with one another; larger buckets go on as one family, unfiltered. Links
#: are confirmed on whole sets either way, so this bounds a task's memory and decides no result.
BUCKET_LIMIT = 50_000
#: Members of a family that one task compares.
BLOCK = 512
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
FACTORS = stream64(11, BANDS * ROWS) | np.uint64(1)
MASKS = stream64(12, BANDS * ROWS)
PLACES = stream64(13, 16) | np.uint64(1)
SIGNATURE_WORDS = BANDS * ROWS * BITS // 64
NIBBLES = np.uint64(0x1111111111111111)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text of a buffer.

    Words are runs of bytes other than space and tab to carriage return, with A-Z lowered. A text with fewer than
    ``words`` words has its whole sequence as its one shingle; one without words has none.
    """
    data = LOWER[data]
    word = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(word & (first[:-1] | np.r_[True, ~word[:-1]]))
    ends = np.flatnonzero(word & (first[1:] | np.r_[~word[1:], True])) + 1
    hashes = PrefixHash(data).of(starts, ends)
    cuts = np.searchsorted(starts, offsets)
    counts = np.diff(cuts)
    n = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + cuts[row]
    padded = np.r_[hashes, np.zeros(words, np.uint64)]
    total = np.zeros(len(row), np.uint64)
    for j in range(words):
        total += np.where(at + j < cuts[row + 1], padded[at + j] * PLACES[j % 16] + np.uint64(j + 1), np.uint64(0))
    total = mix64(total)
    bounds = np.r_[0, np.cumsum(n)]
    return [np.unique(total[s:e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (len(sets), BANDS) and packed low bits (len(sets), SIGNATURE_WORDS) of non-empty sets."""
    values = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    begins = np.cumsum(sizes) - sizes
    minima = np.empty((BANDS * ROWS, len(sets)), np.uint64)
    for k, (factor, mask) in enumerate(zip(FACTORS, MASKS, strict=True)):
        minima[k] = np.minimum.reduceat((values ^ mask) * factor, begins)
    keys = np.zeros((BANDS, len(sets)), np.uint64)
    for r in range(ROWS):
        keys = mix64(keys + minima[r::ROWS] * PLACES[r])
    keys = mix64(keys + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None])
    low = mix64(minima) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    packed = np.zeros((SIGNATURE_WORDS, len(sets)), np.uint64)
    for k in range(BANDS * ROWS):
        packed[k // per] |= low[k] << np.uint64(BITS * (k % per))
    return keys.T, np.ascontiguousarray(packed.T)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of packed signatures: the share of equal entries, less what chance makes equal."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    unlike = np.bitwise_count(x & NIBBLES).sum(axis=-1, dtype=np.int64)
    share, chance = 1 - unlike / (BANDS * ROWS), 1 / (1 << BITS)
    return (share - chance) / (1 - chance)


def linked(a: np.ndarray | int, b: np.ndarray | int, common: np.ndarray | int) -> np.ndarray:
    """Whether sets of sizes a and b with ``common`` equal members are links, in whole numbers."""
    return 100 * common >= PERCENT * (a + b - common)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, s1 and s2 (a 128-bit hash of the set), bands and signature; the last four are null where
    the set is empty."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, text, 1 << 19):
            sets = shingle_sets(*utf8(part.column(text)))
            full = [k for k, s in enumerate(sets) if len(s)]
            s1, s2, bands, packed = ([None] * len(sets) for _ in range(4))
            if full:
                keys, signs = signatures([sets[k] for k in full])
                for i, k in enumerate(full):
                    mixed = mix64(sets[k] ^ np.uint64(0x5851F42D4C957F2D))
                    s1[k], s2[k] = int(mixed.sum().view(np.int64)), int(mix64(mixed).sum().view(np.int64))
                    bands[k], packed[k] = keys[i].view(np.int64), signs[i].tobytes()
            yield pa.record_batch(
                [part.column(key), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
                names=["doc_id", "n_shingles", "s1", "s2", "bands", "signature"],
            )

    return map_arrow(docs.select(key, text), run, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, signature binary")


def by_group(batches: Iterator[pa.RecordBatch], column: str, rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows of a stream sorted by ``column``, with no group cut in two."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            keys = table.column(column).to_numpy()
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            n = sum(len(b) for b in held)
    if n:
        yield pa.Table.from_batches(held)
    held.clear()
    released()


def grown(similar, first: np.ndarray, rest: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest over ``first`` (already one tree) and ``rest``. similar(x, others) is a mask."""
    frontier = first.tolist()
    while len(rest):
        if not frontier:
            frontier, rest = [int(rest[0])], rest[1:]
            continue
        x = frontier.pop()
        mask = similar(x, rest)
        for y in rest[mask].tolist():
            yield x, y
            frontier.append(y)
        rest = rest[~mask]


def shared_buckets(signed: DataFrame) -> DataFrame:
    """bucket, s1, n and least: the members of each bucket of two sets or more, once for all bands that have the same
    members, with their number and the least of them.

    A bucket's name is a hash of its members, so that near copies, which share most bands, go on as one bucket.
    """
    bands = signed.select("s1", F.explode("bands").alias("band"))
    of_all = [F.bit_xor(F.xxhash64("s1", F.lit(k))) for k in (1, 2)]
    named = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("s1").alias("least"), F.xxhash64(*of_all, F.count(F.lit(1))).alias("bucket"))
    named = checkpointed(named.filter("n > 1"))
    return bands.join(named, "band").select("bucket", "s1", "n", "least").distinct()


def candidate_edges(signed: DataFrame) -> DataFrame:
    """Edges a - b, between set hashes s1, that connect the estimated-similar sets of each bucket. ``signed`` has a row
    for each set: s1, bands and signature."""
    buckets = checkpointed(shared_buckets(signed))
    members = buckets.filter(F.col("n") <= BUCKET_LIMIT).join(signed.select("s1", "signature"), "s1").select("bucket", "s1", "signature")
    stars = buckets.filter((F.col("n") > BUCKET_LIMIT) & (F.col("s1") != F.col("least"))).select(F.col("s1").alias("a"), F.col("least").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, "bucket", 20_000):
            bucket, s1 = table.column("bucket").to_numpy(), table.column("s1").to_numpy()
            signs = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint64).reshape(-1, SIGNATURE_WORDS)
            begins = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[begins[1:], len(bucket)]
            first = np.repeat(begins, ends - begins)
            near = similarity(signs, signs[first]) >= FLOOR
            own = near & (np.arange(len(bucket)) != first)
            a, b = [s1[own]], [s1[first[own]]]
            for k in np.unique(np.searchsorted(begins, first[~near])).tolist():
                places = np.arange(begins[k], ends[k])
                pairs = list(grown(lambda x, rest: similarity(signs[x], signs[rest]) >= FLOOR, places[near[places]], places[~near[places]]))
                if pairs:
                    x, y = np.array(pairs).T
                    a.append(s1[x])
                    b.append(s1[y])
            pairs = np.unique(np.sort(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=1), axis=0)
            yield pa.record_batch([pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], names=["a", "b"])

    dealt = members.repartition("bucket").sortWithinPartitions("bucket", "s1")
    return dealt.mapInArrow(run, "a long, b long").union(stars)


def member_sets(docs: DataFrame, members: DataFrame, key: str, text: str) -> DataFrame:
    """members with their shingle sets, as sorted uint64 values in a binary column."""
    joined = docs.select(F.col(key).alias("cid"), F.col(text).alias("text")).join(members, "cid")
    names = [c for c in joined.columns if c != "text"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text", 1 << 19):
            sets = shingle_sets(*utf8(part.column("text")))
            body = [s.tobytes() for s in sets]
            s1 = np.array([int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)) for s in sets])
            same = pa.array(s1 == part.column("s1").to_numpy())  # another row may have the same doc_id
            yield pa.record_batch([part.column(n) for n in names] + [pa.array(body, pa.binary())], names=[*names, "members"]).filter(same)

    schema = ", ".join(f"{n} {joined.schema[n].dataType.simpleString()}" for n in names)
    return map_arrow(joined.select(*names, "text"), run, schema + ", members binary")


class SetIndex:
    """Sizes of the intersections of one set with many."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        self.values, self.owner, self.n = values[order], np.repeat(np.arange(len(sets)), self.sizes)[order], len(sets)

    def links(self, one: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.values, one), np.searchsorted(self.values, one, side="right")
        n = hi - lo
        places = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(self.owner[places], minlength=self.n)
        return linked(len(one), self.sizes, common)


def family_links(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the confirmed links among sets. The index is built anew as the rest shrinks."""
    state = {"rest": None, "index": None}

    def similar(x: int, rest: np.ndarray) -> np.ndarray:
        if state["index"] is None or len(rest) < len(state["rest"]) // 2:
            state["rest"], state["index"] = rest, SetIndex([sets[k] for k in rest])
        found = state["rest"][state["index"].links(sets[x])]
        return np.isin(rest, found)

    yield from grown(similar, np.zeros(0, np.int64), np.arange(len(sets)))


def arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), np.uint64) for v in column]


def whole_families(members: DataFrame) -> DataFrame:
    """Confirmed links a - b inside families that one task takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, "family", 2048):
            family, cid, sets = table.column("family").to_numpy(), table.column("cid").to_numpy(), arrays(table.column("members"))
            begins = np.r_[np.flatnonzero(np.r_[True, family[1:] != family[:-1]]), len(family)]
            pairs = [(s + x, s + y) for s, e in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True) for x, y in family_links(sets[s:e])]
            if pairs:
                x, y = np.array(pairs).T
                yield pa.record_batch([pa.array(cid[x]), pa.array(cid[y])], names=["a", "b"])

    dealt = members.select("family", "cid", "members").repartition("family").sortWithinPartitions("family")
    return dealt.mapInArrow(run, "a long, b long")


def leader_links(members: DataFrame) -> DataFrame:
    """Confirmed links of each member of large families with a few leaders, which go to every part of their family."""
    ranked = members.select("family", "cid", F.xxhash64("cid").alias("turn"))
    chosen = ranked.groupBy("family").agg(F.min(F.struct("turn", "cid")).alias("one"), F.max(F.struct("turn", "cid")).alias("two"), F.min("cid").alias("three"))
    chosen = chosen.select("family", F.explode(F.array_distinct(F.array("one.cid", "two.cid", "three"))).alias("cid"))
    parts = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    held = members.join(chosen, ["family", "cid"]).groupBy("family", "size").agg(F.collect_list(F.struct("cid", "members")).alias("leaders"))
    held = held.select("family", "leaders", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    dealt = members.select("family", "cid", "members", F.pmod(F.xxhash64("cid", F.lit("part")), parts).cast("int").alias("part"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for cid, body, leaders in zip(batch.column("cid").to_pylist(), batch.column("members"), batch.column("leaders"), strict=True):
            one = np.frombuffer(body.as_buffer(), np.uint64)
            for leader in leaders:
                other = np.frombuffer(leader["members"].as_buffer(), np.uint64)
                if leader["cid"].as_py() != cid and linked(len(one), len(other), len(np.intersect1d(one, other, assume_unique=True))):
                    a.append(cid)
                    b.append(leader["cid"].as_py())
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return map_arrow(dealt.join(held, ["family", "part"]).select("cid", "members", "leaders"), run, "a long, b long")


def block_links(members: DataFrame, links: DataFrame) -> DataFrame | None:
    """Confirmed links of the members of large families that are not connected with most of their family, with every
    member; None if there are no such members."""
    labels = components(links)
    labelled = members.join(labels, members["cid"] == labels["node"], "left").select("family", "size", "cid", "members", F.coalesce("label", "cid").alias("label"))
    counts = labelled.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("family").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
    most = most.select("family", F.col("top.label").alias("main"), (F.col("all") - F.col("top.n")).alias("outside")).filter("outside > 0")
    open_ = checkpointed(labelled.join(most, "family"))
    if open_.isEmpty():
        return None
    blocks = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
    turn = F.xxhash64("cid", F.lit("block"))
    left = open_.filter("label <> main").select("family", "cid", "members", "label", F.lit(1).alias("side"), F.pmod(turn, blocks("outside")).alias("i"), F.explode(F.sequence(F.lit(0), blocks("size") - 1)).alias("j"))
    right = open_.select("family", "cid", "members", "label", F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), blocks("outside") - 1)).alias("i"), F.pmod(turn, blocks("size")).alias("j"))
    tiles = left.unionByName(right.select(left.columns)).withColumn("tile", F.xxhash64("family", "i", "j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, "tile", 1024):
            tile, cid, label, side = (table.column(c).to_numpy() for c in ("tile", "cid", "label", "side"))
            sets = arrays(table.column("members"))
            begins = np.r_[np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]), len(tile)]
            a, b = [], []
            for s, e in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                places = np.arange(s, e)
                rows, own = places[side[s:e] == 0], label[s:e].copy()
                if not len(rows):
                    continue
                index = SetIndex([sets[k] for k in rows])
                for x in places[side[s:e] == 1].tolist():
                    for y in rows[index.links(sets[x])].tolist():
                        if own[y - s] != own[x - s]:  # joins two parts
                            a.append(cid[x])
                            b.append(cid[y])
                            own[own == own[y - s]] = own[x - s]
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = tiles.select("tile", "cid", "label", "side", "members").repartition("tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Links are pairs with 100 * |intersection| >= 75 * |union| of their sets of 5-word shingles; component_id is the
    smallest doc_id that links reach. A null or empty text, or one without words, has an empty set and links with
    nothing. Rows that share a doc_id are one document: they are connected even if their texts differ. A row without
    doc_id takes no part: its component_id is null and it is kept. An empty table gives no rows.
    """
    prints = checkpointed(fingerprints(docs, key, text))
    full = prints.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = checkpointed(full.groupBy("s1", "s2").agg(F.min("doc_id").alias("cid")))
    of_doc = full.select("doc_id", "s1", "s2").join(classes.select("s1", "s2", "cid"), ["s1", "s2"])
    twice = of_doc.groupBy("doc_id").agg(F.min("cid").alias("least"), F.max("cid").alias("most")).filter("least < most")
    shared = of_doc.join(twice, "doc_id").select(F.col("cid").alias("a"), F.col("least").alias("b"))

    # one document of each class: the key holds doc_id, so a group of copies isn't joined in one place
    first = classes.select(F.col("s1").alias("of_s1"), F.col("s2").alias("of_s2"), "cid")
    signed = full.join(first, (full["s1"] == first["of_s1"]) & (full["s2"] == first["of_s2"]) & (full["doc_id"] == first["cid"]))
    signed = checkpointed(signed.select("s1", "bands", "signature").dropDuplicates(["s1"]))
    families = components(checkpointed(candidate_edges(signed)))
    sizes = families.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    members = families.join(sizes, "label").select(F.col("node").alias("s1"), F.col("label").alias("family"), "size")
    members = checkpointed(members.join(classes.select("s1", "cid"), "s1").select("cid", "s1", "family", "size"))
    sets = checkpointed(member_sets(docs, members, key, text))  # read by the steps below, so texts are shuffled once
    links = whole_families(sets.filter(F.col("size") <= BLOCK))
    if not members.filter(F.col("size") > BLOCK).isEmpty():
        large = sets.filter(F.col("size") > BLOCK)
        first = checkpointed(leader_links(large))
        links = links.union(first)
        if (more := block_links(large, first)) is not None:
            links = links.union(more)
    labels = components(links.union(shared))
    return (
        prints.select("doc_id", "n_shingles", "s1", "s2")
        .join(classes.select("s1", "s2", "cid"), ["s1", "s2"], "left")
        .join(labels, F.col("cid") == F.col("node"), "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("label", "cid")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op2_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
