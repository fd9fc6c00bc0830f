"""Best-fit packing with certified bin counts.

Documents are cut into pieces of at most ``capacity`` tokens. Each partition packs its pieces by best-fit decreasing
and compares its number of sequences with the largest lower bound that dual-feasible functions give. A partition that
meets its bound is certified: no packing of the same pieces needs fewer sequences. In a partition that doesn't, the
sequences without a gap stay, and the documents of all others are dealt anew with those of other such partitions and
packed again. The last, least filled sequence of a certified partition goes with them, so that the rounding loss of
the partitions meets in one place as well.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, map_arrow, read_table

#: Tokens of a sequence.
CAPACITY = 2048
#: Pieces that one partition packs on average in the first round, and rounds after which their number has doubled.
PARTITION_PIECES, DOUBLINGS = 16_384, 4
#: Fixed value: the pattern by which byte-level tokenizers cut a text.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranked(path: str):
    """The same vocabulary in the rank form that encodes in a fraction of the time, or None.

    The two forms agree where the model is byte-level BPE without prefix space and ids are in the order of merges.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer") or sys.byteorder != "little":
        return None
    # byte-level files write each byte as one character: printable ones as themselves, the others from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in text): i for text, i in model["vocab"].items() if text not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(pairs)) or len(ranks) != 256 + len(pairs):
        return None
    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


class TextEncoder:
    """Ids of whole texts as little-endian uint32 bytes: by the rank form where it gives the same ids, or else by the
    tokenizer itself."""

    def __init__(self, path: str):
        self.path, self.fast = path, ranked(path)

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = True  # their strings are ordinary text
        return tokenizer

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.fast is not None:
            return [self.fast.encode_to_numpy(t, disallowed_special=()).astype("<u4", copy=False).tobytes() for t in texts]
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece, and the ids if ``keep_ids``.

    A document is its ids and id 0 (a null or empty text: id 0 alone). Only documents over ``capacity`` are cut, with
    the shorter piece first. Repeated rows are documents of their own; other columns aren't read.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer)
        names, columns = batch.column(0), [[] for _ in range(6)]
        size, step = len(batch), 256
        for at in range(0, size, step):
            texts = [t or "" for t in batch.column(1).slice(at, step).to_pylist()]
            for k, ids in enumerate(encoder.encode(texts), at):
                ids += b"\0\0\0\0"
                total = len(ids) // 4
                cuts = [0, *range((total - 1) % capacity + 1, total + 1, capacity)]
                for piece, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    body = ids[4 * start : 4 * end]
                    for column, value in zip(columns, (k, piece, start, end - start, zlib.crc32(body), body), strict=True):
                        column.append(value)
        out = [names.take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:5]]]
        if keep_ids:
            out.append(pa.array([np.frombuffer(b, "<u4").astype(np.int32) for b in columns[5]], pa.list_(pa.int32())))
        yield pa.record_batch(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return map_arrow(docs.select(key, text), run, schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The least number of bins that dual-feasible functions prove.

    Two families: for each small t, sizes above capacity - t count as whole bins and sizes below t as nothing; for
    each k, size x counts as floor((k + 1) x / C) / k of a bin, or as x / C where (k + 1) x / C is whole.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    at_least = np.cumsum(counts[::-1])[::-1]
    mass = np.cumsum((counts * sizes)[::-1])[::-1]
    best = -(-int(mass[0]) // capacity)
    t = np.arange(1, capacity // 2 + 1)
    large = np.append(at_least, 0)[capacity - t + 1]
    middle = mass[t] - np.append(mass, 0)[capacity - t + 1]
    best = max(best, int((large - (-middle // capacity)).max()))
    for k in range(1, 33):
        whole = ((k + 1) * sizes) % capacity == 0
        scaled = np.where(whole, sizes * k, (k + 1) * sizes // capacity * capacity)  # in units of 1 / (k C)
        best = max(best, -(-int((scaled * counts).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin of each item, offset of each item, fill of each bin). Ties keep input order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fills: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room r
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[item], offsets[item] = b, fills[b]
        fills[b] += size
        if room > size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets, np.array(fills, np.int64)


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """Give every row of ``pieces`` (a column ``length`` from 1 to ``capacity``) a sequence_id and an offset.

    Also certified: whether the partition that placed the piece met its lower bound. An empty input gives an empty
    result. Rows are dealt evenly, not by a key, so no document or group of copies can fill a partition. A round's
    partitions hold twice the pieces of the round before, up to ``DOUBLINGS`` times, and exchange goes on until one
    partition holds what is open, or a later round leaves more than three quarters of it open.
    """
    names = pieces.columns
    schema = pieces.schema.simpleString()[7:-1].replace(",", ", ") + ", sequence_id long, offset long, certified boolean, open boolean"

    def packed(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches([b for b in batches if b.num_rows] or [])
            lengths = table.column("length").to_numpy().astype(np.int64)
            bins, offsets, fills = best_fit(lengths, capacity)
            certified = len(fills) <= lower_bound(lengths, capacity)
            gaps = fills < capacity if not certified else np.arange(len(fills)) == np.argmin(fills)
            if last:
                gaps = np.zeros(len(fills), bool)
            task = TaskContext.get().partitionId()
            result = table.append_column("sequence_id", pa.array(bins + (level << 56) + (task << 28)))
            result = result.append_column("offset", pa.array(offsets)).append_column("certified", pa.array(np.full(len(bins), certified)))
            yield from result.append_column("open", pa.array(gaps[bins])).to_batches(max_chunksize=8192)

        def guarded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = [b for b in batches if b.num_rows]
            return run(iter(kept)) if kept else iter(())

        return guarded

    rest, done = checkpointed(pieces), []
    n, level, before = rest.count(), 0, None
    while True:
        parts = max(1, -(-n // (partition_pieces << min(level, DOUBLINGS))))
        last = parts == 1 or (level > DOUBLINGS and 4 * n > 3 * before)
        placed = checkpointed(rest.repartition(parts).mapInArrow(packed(level, last), schema))
        done.append(placed.filter(~F.col("open")).drop("open"))
        if last:
            break
        rest = placed.filter("open").select(*names)
        n, level, before = rest.count(), level + 1, n
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return pack(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))
