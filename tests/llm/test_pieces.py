import hashlib
import random
import time

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyrail.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(library, text):
    ids, decoded = pieces.encoded(pieces.table_of(PATH), text)
    want = library.encode(text)
    assert list(map(int, ids.split(" "))) == [*want, 2] and decoded == library.decode([*want, 2])
    assert pieces.model_of(PATH).decode(want) == decoded


def test_random_texts(library):
    rnd = random.Random(1)
    parts = ["a", "b", "e", "t", "the", " ", "  ", "\n", "▁", "é", "漢", "🙂", "　", "\x00", "ing", "tion", "\t", ".", ",", "aaaa", "1", "́", "ﬁ", "<s>", "</s>", "<0x0A>", "�", "!!", "***"]
    for _ in range(4000):
        same(library, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text(library, text):
    same(library, text)


def test_table_begins_anew(library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 5)
    for k in range(30):
        same(library, f"word{k} other{k % 3}, third. {k}")


def test_one_more_word_does_not_walk_the_table():
    table = pieces.ChunkTable(pieces.model_of(PATH))
    table.ids = {f"{pieces.MARK}known{k}": "1" for k in range(600_000)}
    began = time.perf_counter()
    for k in range(500):
        table.learn({f"{pieces.MARK}fresh{k}", f"{pieces.MARK}known{k}"})
    assert time.perf_counter() - began < 2.5  # a walk takes about 20 ms each, 10 s in all


def test_rows(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(None, None), (900, ""), (901, "w " * 30_000), (901, "w " * 30_000)], "doc_id long, text string"))
    got = pieces.encode_digests(docs, PATH).collect()
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = []
    for key, text in texts:
        ids = [*library.encode(text), 2]
        want.append((key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    whole = pieces.encode_texts(docs.filter("doc_id = 900"), PATH).first()
    assert (whole.ids, whole.decoded) == ([2], "")
    assert pieces.encode_digests(docs.limit(0), PATH).count() == 0
