"""Quality classification with a weak-label model.

Overlapping heuristic labellers vote keep, drop or nothing on each document. How often each is right is estimated by
expectation-maximisation from the counts of their vote patterns over all documents, with no labels. The posterior of a
document's pattern is its label, and a linear scorer over hashed words, measures and the votes themselves is trained on
such labels. The scorer's probability is the score; it judges every document with words, also those on which no
labeller votes.

Two tasks share the code: junk (low quality) and toxic texts. The toxic labellers know words: one has common insults,
the others words that are learned on a bounded sample of the labelled rows, each with one part of the sample left out,
so they overlap without being the same. They vote drop where a text holds such a word and nothing else.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, mix64, read_table, slices, utf8
from .hashing import PrefixHash
from .minhash import LOWER, SPACE

#: Labelled rows that word lists are learned on, at most; documents that the scorer is fitted on, at most, and the bytes
#: of their texts.
LABELLED_ROWS, FIT_ROWS, FIT_BYTES = 8_000, 6_000, 48 << 20
#: Feature slots of the scorer, rounds of estimation, and steps of the fit.
SLOTS, ROUNDS, STEPS = 1 << 14, 60, 200
#: Parts of the labelled rows, documents that must hold a listed word, and the bytes of word beginnings.
PARTS, LEAST_DOCS, STEMS = 3, 5, (4, 5)
#: Common insults, known without labels.
INSULTS = (
    "asshole bastard bitch clown coward creep cretin degenerate dickhead disgusting dumb dumbass filth freak garbage idiot idiots imbecile jerk liar loser losers lowlife moron morons "
    "parasite pathetic pig prick scum scumbag stupid swine traitor trash ugly vermin weakling worthless "
    "arschloch depp dummkopf idioten scheisse trottel abruti connard imbécile salaud cabrón estúpido imbécil pendejo"
)
#: A document is dropped from this score on.
CUT = 0.5
KEEP, ABSTAIN, DROP = -1, 0, 1
#: How much likelier a vote is in its own class, at least.
BETTER = 3.0
MEASURES = 6
#: Votes of a task that the scorer sees, at most, each as two features.
VOTES = 8


class Words:
    """Word hashes of a buffer, lower-cased and without punctuation at both ends, and the row of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lower = LOWER[data]
        word = ~SPACE[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        self.starts = np.flatnonzero(word & (first[:-1] | np.r_[True, ~word[:-1]]))
        self.ends = np.flatnonzero(word & (first[1:] | np.r_[~word[1:], True])) + 1
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        self.rows = len(offsets) - 1
        plain = ((lower >= 97) & (lower <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
        self.count = np.bincount(self.row, minlength=self.rows)
        core_start, core_end = self.starts.copy(), self.ends.copy()
        place = np.arange(len(data))
        after = np.minimum.accumulate(np.where(plain, place, len(data))[::-1])[::-1] if len(data) else place
        before = np.maximum.accumulate(np.where(plain, place, -1)) if len(data) else place
        if len(self.starts):
            core_start = np.minimum(after[self.starts], self.ends)
            core_end = np.maximum(before[self.ends - 1] + 1, core_start)
        self.bare = core_end <= core_start  # no letter or digit at all
        self.tail = self.ends - core_end
        hashes = PrefixHash(lower)
        self.hashes = hashes.of(core_start, core_end)
        # tokens: words, and beginnings of words, by which inflected and compound forms are known
        rows, tokens = [self.row], [self.hashes]
        for size in STEMS:
            long = core_end - core_start > size
            rows.append(self.row[long])
            tokens.append(hashes.of(core_start[long], core_start[long] + size) ^ np.uint64(size))
        self.token_row, self.tokens = np.concatenate(rows), np.concatenate(tokens)
        capital = (data >= 65) & (data <= 90)
        upper = np.r_[0, np.cumsum(capital)]
        letters = np.r_[0, np.cumsum(((lower >= 97) & (lower <= 122)))]
        n = letters[self.ends] - letters[self.starts]
        self.shouted = (n >= 2) & (upper[self.ends] - upper[self.starts] == n)

    def share(self, mask: np.ndarray) -> np.ndarray:
        return np.bincount(self.row[mask], minlength=self.rows) / np.maximum(1, self.count)

    def least(self) -> np.ndarray:
        """Per row: the least hash of three words in a row, 0 where there are fewer."""
        out = np.zeros(self.rows, np.uint64)
        if len(self.row) > 2:
            whole = np.flatnonzero(self.row[2:] == self.row[:-2])
            h = mix64(self.hashes[whole] + mix64(self.hashes[whole + 1] + mix64(self.hashes[whole + 2])))
            if len(whole):
                first = np.flatnonzero(np.r_[True, np.diff(self.row[whole]) != 0])
                out[self.row[whole][first]] = np.minimum.reduceat(h, first)
        return out.view(np.int64)

    def measures(self) -> np.ndarray:
        """Per row: shares of repeated neighbours, shouted words, symbol endings, bare words, of the most frequent
        word's neighbours alike, and exclamations."""
        same = np.r_[False, (self.hashes[1:] == self.hashes[:-1]) & (self.row[1:] == self.row[:-1])] if len(self.row) else np.zeros(0, bool)
        gap = np.zeros(len(self.row), bool)
        if len(self.row) > 2:
            gap[2:] = (self.hashes[2:] == self.hashes[:-2]) & (self.row[2:] == self.row[:-2])
        return np.stack([self.share(same), self.share(self.shouted), self.share(self.tail >= 3), self.share(self.bare), self.share(gap), self.share(self.tail == 2)], axis=1)


def junk_votes(measures: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Votes of the junk labellers: each of the first looks at one measure and votes drop or nothing, and the last
    votes keep where all measures are low. Texts under five words get none."""
    #            repeated, shouted, symbols, bare, alternating, exclaimed
    drop_from = np.array([0.25, 0.40, 0.30, 0.20, 0.25, 0.40])
    keep_to = np.array([0.05, 0.10, 0.05, 0.05, 0.08, 0.10])
    votes = np.where(measures >= drop_from, DROP, ABSTAIN)
    clean = np.where((measures <= keep_to).all(axis=1), KEEP, ABSTAIN)
    return np.where((count < 5)[:, None], ABSTAIN, np.c_[votes, clean]).astype(np.int8)


def word_list_votes(words: Words, lists: list[np.ndarray]) -> np.ndarray:
    """One labeller for each list: drop if the text holds a word of it, nothing else."""
    votes = []
    for known in lists:
        short = np.zeros(1 << 16, bool)
        short[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
        maybe = np.flatnonzero(short[(words.tokens & np.uint64(0xFFFF)).astype(np.int64)])
        found = words.token_row[maybe[np.isin(words.tokens[maybe], known)]]
        votes.append(np.where(np.bincount(found, minlength=words.rows) > 0, DROP, ABSTAIN))
    return np.stack(votes, axis=1).astype(np.int8)


def insults() -> np.ndarray:
    return np.unique(Words(*utf8(pa.array([INSULTS]))).hashes)


def estimated(patterns: dict[tuple[int, ...], int], prior: float) -> dict[tuple[int, ...], float]:
    """Posterior of drop for each vote pattern, by expectation-maximisation over the labellers' accuracies.

    A labeller has a table of what it votes given the class, nothing included. Counts begin from a majority view, in
    which a drop vote weighs most, and every table entry is smoothed by one count. Labellers are taken to be better
    than chance: a vote is at least ``BETTER`` times as likely in its own class, and a pattern without a drop vote is
    not taken for the dropped class.
    """
    keys = list(patterns)
    if not keys:
        return {}
    votes, counts = np.array(keys), np.array([patterns[k] for k in keys], float)
    drops, keeps = (votes == DROP).sum(axis=1), (votes == KEEP).sum(axis=1)
    q = np.where(drops > 0, np.minimum(0.95, 0.6 + 0.2 * drops), np.where(keeps > 0, 0.05, prior))
    for _ in range(ROUNDS):
        mass = np.stack([counts * (1 - q), counts * q])
        share = (mass.sum(axis=1) + 1) / (counts.sum() + 2)
        logs = np.tile(np.log(share)[:, None], (1, len(keys)))
        for k in range(votes.shape[1]):
            for v in (KEEP, ABSTAIN, DROP):
                at = votes[:, k] == v
                seen = (mass[:, at].sum(axis=1) + 1) / (mass.sum(axis=1) + 3)
                if v != ABSTAIN:
                    own, other = (1, 0) if v == DROP else (0, 1)
                    seen[other] = min(seen[other], seen[own] / BETTER)
                logs[:, at] += np.log(seen)[:, None]
        q = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        q = np.where(drops == 0, np.minimum(q, 0.4), q)
    return dict(zip(keys, q.tolist(), strict=True))


def features(words: Words, measures: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value): presence of each hashed word, in shares of sqrt(distinct words), and the measures. The slots
    behind the measures belong to the votes."""
    first = MEASURES + 2 * VOTES
    slot = (mix64(words.tokens) % np.uint64(SLOTS - first)).astype(np.int64) + first
    keys = np.unique(words.token_row * SLOTS + slot)
    row, slot = keys // SLOTS, keys % SLOTS
    n = np.bincount(row, minlength=words.rows)
    value = 1 / np.sqrt(np.maximum(1, n))[row]
    dense = np.repeat(np.arange(words.rows), MEASURES)
    return np.r_[row, dense], np.r_[slot, np.tile(np.arange(MEASURES), words.rows)], np.r_[value, 4 * measures.reshape(-1)]


def vote_features(votes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of a task's votes: one slot for each labeller's drop and one for its keep."""
    row, labeller = np.nonzero(votes != ABSTAIN)
    return row, MEASURES + 2 * labeller + (votes[row, labeller] == DROP), np.ones(len(row))


def joined(*parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def fitted(row: np.ndarray, slot: np.ndarray, value: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights and a bias (last) of a logistic scorer of soft labels, by gradient steps with adapted rates."""
    w, seen, n = np.zeros(SLOTS + 1), np.full(SLOTS + 1, 1e-8), len(labels)
    for _ in range(STEPS):
        z = np.bincount(row, value * w[slot], minlength=n) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        gradient = np.append(np.bincount(slot, value * error[row], minlength=SLOTS), error.sum()) / n + 1e-6 * w
        seen += gradient**2
        w -= 0.5 * gradient / np.sqrt(seen)
    return w


def learned_lists(docs: DataFrame, labels: DataFrame) -> list[np.ndarray]:
    """Hashes of the words that mark toxic rows: a list for each of ``PARTS`` parts of the labelled sample, learned on
    the other parts.

    The sample is the ``LABELLED_ROWS`` labelled rows of least key hash. Rows with the same least hash of three words
    in a row count once, so that a group of copies doesn't make its own words look like marks. A word is listed if
    ``LEAST_DOCS`` toxic rows and one in fifty of them hold it, and it is 35 times as frequent there as in the others.
    """
    ranked = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = ranked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def distinct(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text", 1 << 19):
            words = Words(*utf8(part.column("text")))
            keys = np.unique(np.stack([words.token_row.astype(np.uint64), words.tokens], axis=1), axis=0)
            row = keys[:, 0].astype(np.int64)
            at = pa.array(row)
            yield pa.record_batch([part.column("toxic").take(at), pa.array(np.ascontiguousarray(keys[:, 1]).view(np.int64)), pa.array(words.least()[row])], names=["toxic", "word", "least"])

    words = map_arrow(rows, distinct, "toxic int, word long, least long").distinct()
    others = F.filter(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda x: x != F.pmod(F.xxhash64("least"), F.lit(PARTS)))
    of = lambda df, *columns: df.select(*columns, F.explode(others).alias("list"))
    counts = of(words, "toxic", "word", "least").groupBy("list", "word").agg(F.sum((F.col("toxic") == 1).cast("long")).alias("bad"), F.sum((F.col("toxic") == 0).cast("long")).alias("good"))
    sizes = of(words.select("toxic", "least").distinct(), "toxic", "least").groupBy("list").agg(F.sum((F.col("toxic") == 1).cast("long")).alias("bads"), F.count(F.lit(1)).alias("all"))
    strong = counts.filter(F.col("bad") >= LEAST_DOCS).join(sizes, "list").filter("bad >= 0.02 * bads AND bad * (all - bads) >= 35 * (good + 0.5) * bads").collect()  # words of a bounded sample
    return [np.array(sorted(r["word"] for r in strong if r["list"] == k), np.int64).view(np.uint64) for k in range(PARTS)]


class Model:
    """Both tasks' word lists, pattern posteriors and scorers."""

    def __init__(self, lists: list[np.ndarray]):
        self.lists = [insults(), *lists]
        self.posteriors: dict[str, dict[tuple[int, ...], float]] = {}
        self.weights: dict[str, np.ndarray] = {}

    def votes(self, words: Words, measures: np.ndarray) -> dict[str, np.ndarray]:
        return {"junk": junk_votes(measures, words.count), "toxic": word_list_votes(words, self.lists)}

    def scores(self, words: Words) -> dict[str, np.ndarray]:
        """The scorers' probabilities; 0 for a text without words."""
        measures = words.measures()
        known = features(words, measures)
        out = {}
        for task, votes in self.votes(words, measures).items():
            w = self.weights[task]
            row, slot, value = joined(known, vote_features(votes))
            z = np.bincount(row, value * w[slot], minlength=words.rows) + w[-1]
            out[task] = np.where(words.count == 0, 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return out


def fitting_sample(texts: DataFrame) -> DataFrame:
    """The documents of least key hash, ``FIT_ROWS`` at most and up to ``FIT_BYTES`` of text; the first one always."""
    chosen = texts.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.octet_length("text")).cast("long").alias("size"))
    chosen = chosen.withColumn("turn", F.xxhash64("doc_id", F.lit("fit"))).orderBy("turn", "doc_id").limit(FIT_ROWS)
    held = F.sum("size").over(W.orderBy("turn", "doc_id").rowsBetween(W.unboundedPreceding, 0))  # FIT_ROWS rows
    chosen = chosen.withColumn("held", held).filter((F.col("held") <= FIT_BYTES) | (F.col("held") == F.col("size"))).select("doc_id")
    return texts.join(F.broadcast(chosen), "doc_id")


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit both tasks. Patterns are counted over all documents; the scorers are fitted in one task on the posterior
    labels of a bounded sample (``fitting_sample``), and only their weights come to the driver."""
    model = Model(learned_lists(docs, labels))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def patterns(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in slices(batch, "text", 1 << 19):
            words = Words(*utf8(part.column("text")))
            for task, votes in model.votes(words, words.measures()).items():
                found, n = np.unique(votes[words.count > 0], axis=0, return_counts=True)
                counts.update({(task, *v): c for v, c in zip(found.tolist(), n.tolist(), strict=True)})
        keys = list(counts)
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([list(k[1:]) for k in keys], pa.list_(pa.int8())), pa.array([counts[k] for k in keys], pa.int64())], names=["task", "votes", "n"])

    tally = map_arrow(texts, patterns, "task string, votes array<tinyint>, n long").groupBy("task", "votes").agg(F.sum("n").alias("n"))
    rows = tally.collect()  # at most 3 ** labellers
    for task, prior in (("junk", 0.1), ("toxic", 0.05)):
        model.posteriors[task] = estimated({tuple(r["votes"]): r["n"] for r in rows if r["task"] == task}, prior)
    tasks = list(model.posteriors)

    def examples(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Per document and task (-1: what both share) the label, slots and values."""
        for part in slices(batch, "text", 1 << 19):
            words = Words(*utf8(part.column("text")))
            measures = words.measures()
            votes = model.votes(words, measures)
            parts = [(-1, None, features(words, measures))]
            parts += [(k, [model.posteriors[task].get(tuple(v), 0.5) for v in votes[task].tolist()], vote_features(votes[task])) for k, task in enumerate(tasks)]
            use = pa.array(words.count > 0)
            for k, labels_, (row, slot, value) in parts:
                order = np.argsort(row, kind="stable")
                cuts = np.r_[0, np.cumsum(np.bincount(row, minlength=words.rows))]
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x[order], t)) for x, t in ((slot, pa.int16()), (value, pa.float32()))]
                label = pa.array(labels_ or [None] * words.rows, pa.float64())
                yield pa.record_batch([part.column("doc_id"), pa.array(np.full(words.rows, k), pa.int32()), label, *lists], names=["doc_id", "task", "label", "slots", "values"]).filter(use)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b for b in batches if b.num_rows] or [])
        of = [table.filter(pa.compute.equal(table.column("task"), k)).combine_chunks() for k in range(-1, len(tasks))]

        def entries(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            slots, values = part.column("slots").combine_chunks(), part.column("values").combine_chunks()
            row = np.repeat(np.arange(len(part)), slots.value_lengths().to_numpy())
            return row, slots.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy().astype(np.float64)

        shared = entries(of[0])
        for k, part in enumerate(of[1:]):
            w = fitted(*joined(shared, entries(part)), part.column("label").to_numpy())
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([w.tobytes()], pa.binary())], names=["task", "weights"])

    def guarded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        return weights(iter(kept)) if kept else iter(())

    got = map_arrow(fitting_sample(texts), examples, "doc_id long, task int, label double, slots array<smallint>, values array<float>")
    ordered = got.repartition(1).sortWithinPartitions("task", F.xxhash64("doc_id"), "doc_id", "label", "values")
    found = {tasks[r["task"]]: np.frombuffer(r["weights"], np.float64) for r in ordered.mapInArrow(guarded, "task int, weights binary").collect()}
    for task in tasks:
        model.weights[task] = found.get(task, np.append(np.zeros(SLOTS), -1.0))
    return model


def judged(model: Model, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """junk and toxic scores of the rows of a batch, and which rows are rejected."""
    scores = model.scores(Words(*utf8(part.column("text"))))
    junk, toxic = np.round(scores["junk"], 6), np.round(scores["toxic"], 6)
    return junk, toxic, (junk >= CUT) | (toxic >= CUT)


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, junk and toxic (scores from 0 to 1) and rejected of every row.

    A null or empty text, or one without words, scores 0 on both and is kept. Texts under five words get no junk vote
    and go by the scorer. Rows with a null doc_id are scored and never trained on; repeated rows get equal scores. A
    table without usable labels has empty lists beside the insults. An empty table gives no rows.
    """
    model = model or trained(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS weights a task and at most 3 ** labellers patterns

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text", 1 << 19):
            junk, toxic, rejected = judged(held.value, part)
            yield pa.record_batch([part.column("doc_id"), pa.array(junk), pa.array(toxic), pa.array(rejected)], names=["doc_id", "junk", "toxic", "rejected"])

    return map_arrow(docs.select("doc_id", "text"), score, "doc_id long, junk double, toxic double, rejected boolean")


def without_rejected(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows that ``classify`` doesn't reject, with all their columns. Rows are judged where they are read, so
    nothing is joined or shuffled."""
    model = model or trained(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text", 1 << 19):
            yield part.filter(pa.array(~judged(held.value, part)[2]))

    return map_arrow(docs, keep, docs.schema)


def op6_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
