"""SentencePiece BPE encoding and decoding with a prefix table.

A text is encoded as the library does for models with the identity normaliser, a dummy prefix, kept white space and
byte fallback. For a string s, ``last[i]`` is the last token of the encoding of s[:i]. It is unique: of the tokens
that end at i, found by an Aho-Corasick automaton, exactly one is compatible with ``last[i - len(token)]``, and two
tokens are compatible if their concatenation is encoded as these two. The ids are then read backwards from the end.

No piece holds the space mark behind another character, so no merge crosses a place before a run of marks, and a text
falls into chunks that are encoded alone: a mark and what follows it. A bounded table keeps the chunks already seen.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, read_table

#: The mark that stands for a space in pieces.
MARK = "▁"
#: Piece types of the model file: normal and byte pieces.
NORMAL, BYTE = 1, 6
#: Chunks that a process remembers before it starts anew.
MEMORY = 700_000
#: Punctuation that often closes a word.
CLOSING = ".,!?;:*#%&$|"


def fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, data[at : at + size]
            at += size


class PieceModel:
    """A BPE model; ``encode`` gives ids without begin or end ids, ``decode`` is its inverse up to the prefix."""

    def __init__(self, path: str):
        import struct

        with open(path, "rb") as file:
            model = file.read()
        pieces, trainer, normalizer = [], {}, {}
        for number, value in fields(model):
            if number == 1:
                entry = dict(fields(value))
                pieces.append((entry[1].decode(), struct.unpack("<f", entry.get(2, b"\0\0\0\0"))[0], entry.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        if trainer.get(3) != 2 or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not trainer.get(35, 0):
            raise ValueError("not a BPE model with byte fallback, identity normaliser, dummy prefix and kept spaces")
        self.texts = [text for text, _, _ in pieces]
        self.kinds = [kind for _, _, kind in pieces]
        self.end = next(i for i, (text, _, kind) in enumerate(pieces) if text == "</s>")
        self.bytes = {int(text[3:5], 16): i for i, (text, _, kind) in enumerate(pieces) if kind == BYTE}
        self.ids = {text: i for i, (text, _, kind) in enumerate(pieces) if kind == NORMAL}
        if any(MARK in text.lstrip(MARK) for text in self.ids):
            raise ValueError("a piece holds a space mark behind another character")
        # order of merges: single characters come before all, then the best score first
        merged = sorted((t for t in self.ids if len(t) > 1), key=lambda t: -pieces[self.ids[t]][1])
        self.rank = {t: 0 for t in self.ids if len(t) == 1} | {t: k for k, t in enumerate(merged, 1)}
        self.halves: dict[str, tuple[str, str]] = {}
        automaton = ahocorasick.Automaton()
        for text in self.rank:
            if len(text) == 1:
                automaton.add_word(text, text)
            else:
                parts = self.merge(text)
                if len(parts) == 1:  # else no encoding ever holds it
                    automaton.add_word(text, text)
        automaton.make_automaton()
        self.automaton = automaton
        self.touching = {t[k : k + 2] for t in self.ids for k in range(len(t) - 1)}
        self.pairs: dict[str, bool] = {}
        self.numbers = {text: str(i) for text, i in self.ids.items()}

    def merge(self, text: str) -> list[str]:
        """Encode by the definition: merge the best adjacent pair, leftmost first. Notes a token's last merge."""
        parts, last = list(text), ("", "")
        while len(parts) > 1:
            best = min((self.rank.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 60:
                return parts
            k = best[1]
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        self.halves[text] = last
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether left + right is encoded as these two tokens.

        The merges of both tokens are undone from the latest one back. As long as the two pieces that touch at the
        seam could merge at a time when both stood there, the seam would have closed.
        """
        a, b, rank = left, right, self.rank
        until, ok = 1 << 60, True  # the seam must stay open for merges of a rank below this one
        while True:
            seam = rank.get(a + b)
            if seam is not None and seam < until:
                ok = False
                break
            # at equal rank the left token is complete first, as merges run from the left
            ra, rb = rank[a], rank[b]
            if ra == 0 and rb == 0:
                break
            if ra > rb:
                until, a = ra, self.halves[a][1]
            else:
                until, b = rb + 1, self.halves[b][0]
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        self.pairs[f"{left} {right}"] = ok
        return ok

    def tokens(self, text: str) -> list[str]:
        """The tokens of a text without white space marks inside words, or whose characters are unknown: a token
        of an unknown character is the character."""
        last: list[str] = [""] * (len(text) + 1)
        compatible, known, whole = self.compatible, self.pairs.get, self.rank
        done = 0
        for end, token in self.automaton.iter(text):  # at each place the longest token first
            if end < done:
                continue  # found already
            while done < end:  # no token ends there: an unknown character
                last[done + 1] = text[done]
                done += 1
            before = last[end + 1 - len(token)]
            if before and before in whole:
                ok = known(f"{before} {token}")
                if not (compatible(before, token) if ok is None else ok):
                    continue
            done = end + 1
            last[done] = token
        while done < len(text):
            last[done + 1] = text[done]
            done += 1
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def encode_chunk(self, text: str) -> list[int]:
        out: list[int] = []
        for token in self.tokens(text):
            known = self.ids.get(token)
            if known is None:
                out.extend(self.bytes[b] for b in token.encode())
            else:
                out.append(known)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for chunk in chunks(text) for i in self.encode_chunk(chunk)]

    def text_of(self, ids: list[int]) -> str:
        """The decoded text with the dummy prefix still in front. Bytes that aren't UTF-8 become U+FFFD each."""
        out: list[str] = []
        held = bytearray()

        def release() -> None:
            at = 0
            while at < len(held):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(held[at : at + size].decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        if size == 4:
                            out.append("�")
                            at += 1
            held.clear()

        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                held.append(int(self.texts[i][3:5], 16))
                continue
            if held:
                release()
            if kind == NORMAL:
                out.append(self.texts[i].replace(MARK, " "))
        if held:
            release()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.text_of(ids)
        return text[1:] if text.startswith(" ") else text


def chunks(text: str) -> list[str]:
    """The dummy prefix and the text, cut before each run of marks; none for an empty text."""
    if not text:
        return []
    return re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))


@lru_cache(maxsize=2)
def model_of(path: str) -> PieceModel:
    return PieceModel(path)


class ChunkTable:
    """What a process has encoded: chunk -> its ids as text; ``odd`` has the chunks that don't decode to themselves."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.ids: dict[str, str] = {}
        self.odd: dict[str, str] = {}

    def learn(self, words: set[str]) -> dict[str, str]:
        """A table that holds all of ``words``: this one, or a new one of them alone where it would grow too large."""
        missing = {w for w in words if w not in self.ids}  # not a difference of sets, which walks the table
        if len(self.ids) + len(missing) > MEMORY:
            self.ids, self.odd, missing = {}, {}, words
        for word in missing:
            self.add(word)
        return self.ids

    def add(self, word: str) -> str:
        """Encode a chunk. Where no piece holds the two characters at a place, no token crosses it, so closing
        punctuation is encoded apart from the word before it."""
        stem = word.rstrip(CLOSING)
        if stem and stem != word and word[len(stem) - 1 : len(stem) + 1] not in self.model.touching:
            tail = word[len(stem) :]
            text = f"{self.ids.get(stem) or self.add(stem)} {self.ids.get(tail) or self.add(tail)}"
            if stem in self.odd or tail in self.odd:
                self.odd[word] = self.odd.get(stem, stem.replace(MARK, " ")) + self.odd.get(tail, tail)
        else:
            try:  # tokens are parts of the word, so such ids decode to it
                text = " ".join(map(self.model.numbers.__getitem__, self.model.tokens(word)))
            except KeyError:  # bytes
                ids = self.model.encode_chunk(word)
                text = " ".join(map(str, ids))
                if (decoded := self.model.text_of(ids)) != word.replace(MARK, " "):
                    self.odd[word] = decoded
        self.ids[word] = text
        return text


@lru_cache(maxsize=2)
def table_of(path: str) -> ChunkTable:
    return ChunkTable(model_of(path))


def encoded(table: ChunkTable, text: str) -> tuple[str, str]:
    """The decimal ids, joined by spaces and with the end id, and the decoded text."""
    words = chunks(text)
    try:
        ids = list(map(table.ids.__getitem__, words))
    except KeyError:
        known = table.learn(set(words))
        ids = [known[w] for w in words]
    ids.append(str(table.model.end))
    decoded = "".join(words).replace(MARK, " ") if not table.odd else "".join([table.odd.get(w) or w.replace(MARK, " ") for w in words])
    return " ".join(ids), decoded[1:] if decoded.startswith(" ") else decoded


def encode_texts(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int, the end id last) and decoded text of every row; a null text counts as empty."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = table_of(model_path)
        pairs = [encoded(table, value or "") for value in batch.column(1).to_pylist()]
        yield pa.record_batch(
            [batch.column(0), pa.array([list(map(int, i.split(" "))) for i, _ in pairs], pa.list_(pa.int32())), pa.array([d for _, d in pairs], pa.string())],
            names=[key, "ids", "decoded"],
        )

    return map_arrow(docs.select(key, text), run, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, from the same encoder as ``encode_texts``.

    A null or empty text has the end id alone and decodes to empty text. Rows are treated alone, so repeated rows
    give repeated results; other columns aren't read.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = table_of(model_path)
        counts, ids_sha, decoded_sha = [], [], []
        for value in batch.column(1):
            ids, decoded = encoded(table, value.as_py() or "")
            counts.append(ids.count(" ") + 1)
            ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
        yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(key, text), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
