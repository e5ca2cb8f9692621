"""Counterfactual-regularised toxicity classifier.

A logistic regression on the presence of hashed words and word beginnings. It is fitted on a bounded sample
of labelled texts; besides the log loss it pays for every change of score when the identity terms of a
labelled text are swapped for others of their kind, so that no group's mention raises a score by itself.
Each text is swapped as often as its kind has other terms: all its mentions of the kind move on by as many terms.
What a swap does to the features follows from how often the text has each feature: a feature goes with its last
occurrence and comes with its first.
Scoring is one vectorised pass over all texts with a small broadcast weight table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm import bytescan as B
from photonlake.llm.storage import Scratch, bounded_batches

#: Identity terms by kind, in the languages of the corpus. A term is swapped for the others of its kind.
IDENTITY_TERMS = {
    "gender": ("women", "men", "girls", "boys", "woman", "man", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    "religion": ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslime", "christen", "juden", "musulmans", "chrétiens", "juifs", "musulmanes", "cristianos", "judíos"),
    "origin": ("africans", "asians", "europeans", "americans", "mexicans", "immigrants", "refugees", "einwanderer", "flüchtlinge", "immigrés", "réfugiés", "inmigrantes", "refugiados"),
    "orientation": ("gay", "straight", "lesbian", "bisexual", "transgender", "schwule", "lesben", "homosexuels", "homosexuales"),
    "ability": ("disabled", "deaf", "blind", "autistic", "behinderte", "sourds", "aveugles", "sordos", "ciegos"),
}

BITS = 20
#: Bytes of the word beginnings that are features beside the word.
PREFIXES = (5, 6, 7, 8)
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_INSIDE[128:] = True


def _word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ASCII letters, digits and bytes of other characters."""
    masked = np.where(_INSIDE[data], np.uint8(1), np.uint8(0x20))
    return B.words(masked, offsets)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word number, hashed feature) of every feature in a slice."""
    starts, ends, bounds = _word_spans(data, offsets)
    row = np.searchsorted(bounds, np.arange(len(starts)), "right") - 1
    prefix = B.prefix_hash(B.lower(data))
    shift = np.uint64(64 - BITS)
    rows, words, out = [row], [np.arange(len(starts))], [B.span_hash(prefix, starts, ends) >> shift]
    for n in PREFIXES:
        long_ = np.flatnonzero(ends - starts > n)
        hashed = B.mix(B.span_hash(prefix, starts[long_], starts[long_] + n) + np.uint64(n)) >> shift
        rows.append(row[long_])
        words.append(long_)
        out.append(hashed)
    return np.concatenate(rows), np.concatenate(words), np.concatenate(out).astype(np.int64)


def term_features(term: str) -> np.ndarray:
    raw = np.frombuffer(term.encode(), np.uint8)
    return np.unique(features(raw, np.array([0, len(raw)]))[2])


def _present(column: pa.Array, slot_of: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each slice: rows in it, and the distinct (row, feature) pairs; ``slot_of`` maps features to chosen ones or -1."""
    for first, end, data, offsets in B.slices(column):
        row, _, feature = features(data, offsets)
        if slot_of is not None:
            feature = slot_of[feature]
            row, feature = row[feature >= 0], feature[feature >= 0]
        pairs = np.unique(row << BITS | feature)
        yield end - first, pairs >> BITS, pairs & ((1 << BITS) - 1)


class Toxicity:
    """Fit on labelled texts, then score every text.

    ``sample`` bounds the labelled rows that are learnt from (by the order of a hash of doc_id), ``chosen``
    the features kept, ``penalty`` weighs the squared score changes. Null labels are passed over; a
    document labelled twice counts as toxic if either label says so. Without both classes among the labels
    every score is the share of toxic labels (one half if there are none). Null and empty texts get the
    score of a text without features. Labels, lang, source and doc_id are never inputs of a score. Rows that
    repeat a doc_id are scored each by its text; other columns, whatever their names, take no part.
    """

    def __init__(self, spark: SparkSession, sample: int = 20_000, chosen: int = 4096, penalty: float = 4.0, ridge: float = 0.5, terms: dict[str, tuple[str, ...]] | None = None):
        self.spark, self.sample, self.chosen, self.penalty, self.ridge = spark, sample, chosen, penalty, ridge
        self.terms = IDENTITY_TERMS if terms is None else terms
        self.scratch = Scratch(spark, "toxicity")
        self.slots, self.weights, self.bias = np.zeros(0, np.int64), np.zeros(0), 0.0
        bounded_batches(spark)

    def fit(self, labelled: DataFrame) -> Toxicity:
        """``labelled``: (doc_id, text, toxic 0/1)."""
        rows = labelled.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
        rows = self.scratch.table(rows.repartition(16, "doc_id"), "labelled")
        n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        t, c = n.get(1, 0), n.get(0, 0)
        if not t or not c:
            self.bias = 0.0 if t == c else (30.0 if t else -30.0)
            return self
        counts = self._feature_counts(rows)
        p, q = (F.col("t") + 0.5) / (t + 1), (F.col("c") + 0.5) / (c + 1)
        strength = F.abs(p - q) / F.sqrt(p * (1 - p) / t + q * (1 - q) / c)
        best = counts.filter("t + c >= 4").withColumn("strength", strength).orderBy(F.desc("strength"), "feature").limit(self.chosen)
        own = [x for terms in self.terms.values() for term in terms for x in term_features(term).tolist()]
        self.slots = np.unique(np.array([r["feature"] for r in best.select("feature").collect()] + own, np.int64))
        self._train(rows)
        return self

    def _feature_counts(self, rows: DataFrame) -> DataFrame:
        def run(batches):
            t, c = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
            for batch in batches:
                toxic, done = batch.column(1).to_numpy(), 0
                for n, row, feature in _present(batch.column(0), None):
                    mark = toxic[done : done + n][row] == 1
                    t += np.bincount(feature[mark], minlength=1 << BITS)
                    c += np.bincount(feature[~mark], minlength=1 << BITS)
                    done += n
            some = np.flatnonzero(t + c)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(t[some]), pa.array(c[some])], names=["feature", "t", "c"])

        found = rows.select("text", "toxic").mapInArrow(run, "feature bigint, t bigint, c bigint")
        return found.groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))

    def _slot_of(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, np.int64)
        out[self.slots] = np.arange(len(self.slots))
        return out

    def _train(self, rows: DataFrame) -> None:
        shared = self.spark.sparkContext.broadcast((self.slots, self.terms))

        def run(batches):
            slots, terms = shared.value
            table = np.full(1 << BITS, -1, np.int64)
            table[slots] = np.arange(len(slots))
            swapper = Swapper(terms, table)
            for batch in batches:
                toxic, done = batch.column(1).to_numpy(), 0
                for first, end, data, offsets in B.slices(batch.column(0)):
                    n = end - first
                    row, word, feature = features(data, offsets)
                    slot = table[feature]
                    row, slot = row[slot >= 0], slot[slot >= 0]
                    pairs, times = np.unique(row << BITS | slot, return_counts=True)
                    row, slot = pairs >> BITS, pairs & ((1 << BITS) - 1)
                    cuts = np.searchsorted(row, np.arange(n + 1))
                    swaps: list[list[list[int]]] = [[] for _ in range(n)]
                    for r, mentioned in swapper.mentions(data, offsets).items():
                        swaps[r] = swapper.changes(mentioned, dict(zip(slot[cuts[r] : cuts[r + 1]].tolist(), times[cuts[r] : cuts[r + 1]].tolist(), strict=True)))
                    lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(slot.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(toxic[done : done + n]), lists, pa.array(swaps, pa.list_(pa.list_(pa.int32())))], names=["toxic", "found", "swaps"])
                    done += n

        got = rows.select("text", "toxic").mapInArrow(run, "toxic int, found array<int>, swaps array<array<int>>").toArrow()
        y = got.column("toxic").to_numpy().astype(np.float64)
        found = got.column("found").combine_chunks()
        lengths = np.diff(found.offsets.to_numpy())
        col, row = found.values.to_numpy().astype(np.int64), np.repeat(np.arange(len(y)), lengths)
        # A kind's terms are held together a little even where the sample never mentions them: each counts as one text.
        swaps = Counter(Swapper(self.terms, self._slot_of()).alone())
        for of_text in got.column("swaps").to_pylist():
            swaps.update(map(tuple, of_text))
        self.weights, self.bias = fit_logistic(y, row, col, len(self.slots), swaps, self.penalty, self.ridge)

    def _slot_of(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, np.int64)
        out[self.slots] = np.arange(len(self.slots))
        return out

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, score) of every row."""
        if not len(self.slots):
            value = float(1 / (1 + np.exp(-self.bias)))
            return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(value).alias("score"))
        keep = np.flatnonzero(self.weights)
        model = self.spark.sparkContext.broadcast((self.slots[keep], self.weights[keep], self.bias))

        def run(batches):
            slots, weights, bias = model.value
            table = np.full(1 << BITS, -1, np.int64)
            table[slots] = np.arange(len(slots))
            for batch in batches:
                scores = [np.bincount(row, weights[feature], minlength=n) + bias for n, row, feature in _present(batch.column(1), table)]
                logits = np.concatenate(scores) if scores else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(logits, -500, 500))))], names=["doc_id", "score"])

        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")


class Swapper:
    """What swaps of identity terms do to the features of a text.

    A change is a list of features that come (slot + 1) and go (-slot - 1).
    """

    def __init__(self, terms: dict[str, tuple[str, ...]], slot_of: np.ndarray):
        self.of = {kind: [[int(s) for s in slot_of[term_features(t)] if s >= 0] for t in names] for kind, names in terms.items()}
        self.place = {t.encode(): (kind, i) for kind, names in terms.items() for i, t in enumerate(names)}
        self.lengths = np.array(sorted({len(t) for t in self.place}) or [0])

    def mentions(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, Counter]:
        """How often each row with any of the terms has each: row -> (kind, number) -> times."""
        starts, ends, bounds = _word_spans(data, offsets)
        fits = np.flatnonzero(np.isin(ends - starts, self.lengths))
        row = np.searchsorted(bounds, fits, "right") - 1
        lowered, out = B.lower(data).tobytes(), {}
        for r, s, e in zip(row.tolist(), starts[fits].tolist(), ends[fits].tolist(), strict=True):
            at = self.place.get(lowered[s:e])
            if at is not None:
                out.setdefault(r, Counter())[at] += 1
        return out

    def changes(self, mentioned: Counter, times: dict[int, int]) -> list[list[int]]:
        """The change of each swap of a text that has the mentioned terms and its features so many times."""
        out = []
        for kind, of in self.of.items():
            own = [(i, n) for (k, i), n in mentioned.items() if k == kind]
            for move in range(1, len(of)) if own else ():
                after = Counter()
                for i, n in own:
                    for slot in of[i]:
                        after[slot] -= n
                    for slot in of[(i + move) % len(of)]:
                        after[slot] += n
                change = [(slot + 1) * (1 if by > 0 else -1) for slot, by in sorted(after.items()) if (times.get(slot, 0) > 0) != (times.get(slot, 0) + by > 0)]
                if change:
                    out.append(change)
        return out

    def alone(self) -> list[tuple[int, ...]]:
        """The changes of texts of one term."""
        each = [(Counter({(kind, i): 1}), dict.fromkeys(of[i], 1)) for kind, of in self.of.items() for i in range(len(of))]
        return [tuple(c) for mentioned, times in each for c in self.changes(mentioned, times)]


def fit_logistic(y: np.ndarray, row: np.ndarray, col: np.ndarray, n: int, swaps: dict[tuple[int, ...], float], penalty: float, ridge: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise log loss + ridge/2 |w|^2 + penalty/2 * sum over swaps of times * (change of the logit)^2.

    Accelerated gradient steps, each feature scaled by a bound of its own curvature.
    """
    changes, times = list(swaps), np.array(list(swaps.values()), float)
    signed = np.array([x for c in changes for x in c], np.int64)
    s_len = np.fromiter(map(len, changes), np.int64, len(changes))
    s_row, s_col, sign = np.repeat(np.arange(len(changes)), s_len), np.abs(signed) - 1, np.sign(signed).astype(float)
    w, v, b = np.zeros(n), np.zeros(n), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    vb = b
    width = np.bincount(row, minlength=len(y)) + 1.0
    curve = 0.25 * np.bincount(col, width[row], minlength=n) + ridge + penalty * np.bincount(s_col, (times * s_len)[s_row], minlength=n)
    bias_curve = 0.25 * width.sum()
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, v[col], minlength=len(y)) + vb, -500, 500)))
        error = p - y
        change = penalty * times * np.bincount(s_row, sign * v[s_col], minlength=len(changes))
        g = np.bincount(col, error[row], minlength=n) + ridge * v + np.bincount(s_col, sign * change[s_row], minlength=n)
        w_new, b_new = v - g / curve, vb - error.sum() / bias_curve
        momentum = t / (t + 3)
        v, vb = w_new + momentum * (w_new - w), b_new + momentum * (b_new - b)
        w, b = w_new, b_new
    return w, b


def held_out() -> F.Column:
    """Rows that nothing is learnt from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def toxicity_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; rows with a null doc_id are not held out."""
    own = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = Toxicity(spark)
    known = own.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(model.sample)
    model.fit(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))
    scored = model.score(docs)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
