import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallyrail.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_the_tokenizer_s():
    table, direct = packing.text_encoder(PATH), Tokenizer.from_file(PATH)
    direct.encode_special_tokens = True
    rnd = random.Random(1)
    parts = ["a", "e", "the", " ", "  ", "\n", "é", "漢", "🙂", "　", "\x00", "ing", "\t", ".", "'s", "'", "1", "…", "<|endoftext|>", "!!", "word,", "two words. "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(3000)] + ["x" * 100_000, " " * 100_000 + "a", "ab " * 50_000]
    got = [np.frombuffer(x, "<u4").tolist() for x in table.encode(texts)]
    assert got == [e.ids for e in direct.encode_batch(texts, add_special_tokens=False)]


def exact_bins(lengths, capacity):
    """Least number of bins by trying every placement."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= lengths[k]}.values():
            place(k + 1, [r - lengths[k] * (i == j) for i, r in enumerate(rooms)])
        place(k + 1, [*rooms, capacity - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def test_bound_never_exceeds_the_optimum():
    rnd = random.Random(3)
    for _ in range(300):
        lengths = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 8))]
        bins, offsets, fills = packing.best_fit(np.array(lengths), 20)
        low, exact = packing.lower_bound(np.array(lengths), 20), exact_bins(lengths, 20)
        assert low <= exact <= len(fills) and fills.max() <= 20
    assert packing.lower_bound(np.array([11] * 7), 20) == 7 and packing.lower_bound(np.array([7] * 6), 20) == 3


def checked(rows, capacity):
    held: dict = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(None, None), (900, ""), (901, "word " * 9000), (901, "word " * 9000)], "doc_id long, text string"))
    rows = packing.pack(packing.token_pieces(docs, PATH, keep_ids=True)).collect()
    direct = Tokenizer.from_file(PATH)
    want = []
    for r in docs.collect():
        ids = [*direct.encode(r.text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.append((r.doc_id, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())))
    assert sorted([tuple(r)[:5] for r in rows], key=repr) == sorted(want, key=repr)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    used = checked(rows, 2048)
    assert used <= packing.lower_bound(np.array([r.length for r in rows]), 2048) * 1.02 + 1
    assert packing.pack(packing.token_pieces(docs.limit(0), PATH)).count() == 0


def test_partitions_exchange_what_has_gaps(spark):
    rnd = random.Random(5)
    lengths = [rnd.randint(30, 60) for _ in range(900)]
    pieces = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, length long")
    rows = packing.pack(pieces, capacity=100, partition_pieces=100).collect()
    assert sorted(r.doc_id for r in rows) == list(range(900))
    one = len(packing.best_fit(np.array(lengths), 100)[2])
    assert checked(rows, 100) <= one * 1.05


def test_without_a_rank_form(monkeypatch):
    texts = ["", "a word", "  two  words\n", "<|endoftext|> é漢"]
    want = packing.TextEncoder(PATH).encode(texts)
    monkeypatch.setattr(packing, "ranked", lambda path: None)
    assert packing.TextEncoder(PATH).encode(texts) == want


def test_rounds_go_on_until_one_partition_is_left(spark):
    rnd = random.Random(6)
    pieces = spark.createDataFrame([(k, rnd.randint(1, 100)) for k in range(3000)], "k long, length long").selectExpr("*", "1 AS bins", "'x' AS room")
    got = packing.pack(pieces, 100, partition_pieces=300).collect()
    at_once = len(packing.best_fit(np.array([r.length for r in got]), 100)[2])
    checked(got, 100)
    assert len(got) == 3000 and len({r.sequence_id for r in got}) <= 1.02 * at_once
    assert {(r.bins, r.room) for r in got} == {(1, "x")}
