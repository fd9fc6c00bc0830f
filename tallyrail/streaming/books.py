"""The order-book engine over a stream: per market, state is the book, its revision, epoch and cursor position. The
book is a map from side and price, of which a micro-batch writes the levels that changed.

Rows of a market are sorted by sequence inside a micro-batch and fenced by generation; a row whose sequence isn't
beyond the last one of its market is counted and left. The rules are those of ``operators.books``.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "market string, seq long, what string, revision long, authority string, continuity_epoch long, position long, side string, price string, old_qty string, new_qty string"
STATE = "seq long, generation long, revision long, epoch long, position long, authority string, fresh boolean"


def canonical(price: str) -> str:
    """Decimal text without trailing zeros, so that 0.90 and 0.9 are one level."""
    return format(Decimal(price).normalize(), "f")


class BookEngine(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("book", STATE)
        self.levels = handle.getMapState("levels", "side string, price string", "qty string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        held = self.state.get() if self.state.exists() else (-1, -1, 0, 0, 0, "Synchronizing", True)
        seq, generation, revision, epoch, position, authority, fresh = held
        stored = {tuple(k): v[0] for k, v in self.levels.iterator()}
        book, out = stored, []

        def emit(what: str, *change) -> None:
            out.append((key[0], seq, what, revision, authority, epoch, *(change or (None,) * 5)))

        for row in batch.itertuples(index=False):
            if row.seq <= seq or row.generation < generation:
                out.append((key[0], int(row.seq), "fenced", revision, authority, epoch, *(None,) * 5))
                continue
            seq, generation = int(row.seq), int(row.generation)
            if row.kind == "disconnect":
                revision, authority, fresh = revision + 1, "Stale(Disconnect)", True
                emit("state")
                epoch, position = epoch + 1, 0
            elif row.kind == "snapshot":
                revision, authority = revision + 1, "Live"
                new = {(side, canonical(x["price"])): x["qty"] for side, levels in (("ask", row.asks), ("bid", row.bids)) for x in (levels if levels is not None else [])}
                emit("state")
                if not fresh:
                    for side, price in sorted(book.keys() | new.keys(), key=lambda k: (k[0], Decimal(k[1]))):
                        old, now = book.get((side, price)), new.get((side, price))
                        if old != now:
                            position += 1
                            emit("mutation", position, side, price, old, now)
                book, fresh = new, False
            elif row.kind == "start":
                emit("state")
            elif row.kind == "resolved":
                emit("resolution")
        self.state.update((seq, generation, revision, epoch, position, authority, fresh))
        for key_ in stored.keys() - book.keys():
            self.levels.removeKey(key_)
        for key_, qty in book.items():
            if stored.get(key_) != qty:
                self.levels.updateValue(key_, (qty,))
        yield pd.DataFrame(out, columns=[field.split(" ")[0] for field in OUTPUT.split(", ")]).astype({"position": "Int64"})

    def close(self) -> None:
        pass


def book_stream(inputs: DataFrame) -> DataFrame:
    """States, mutations, resolutions and fenced rows of each market. ``inputs`` has market, seq, generation, kind, and
    bids and asks with decimal text. A market's rows must come in order across micro-batches: a row that comes after a
    later one of its market is fenced for good. Needs the RocksDB state store."""
    return inputs.groupBy("market").transformWithStateInPandas(BookEngine(), OUTPUT, "Append", "none")
