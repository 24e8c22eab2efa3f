"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier over words and word beginnings is fitted with NumPy from confirmed toxic
documents and unlabelled ones. The risk of the negative class is what unlabelled documents
show minus the positives' part of it (class prior), and is kept from falling below zero.
Which features tell is counted by Spark over all rows, only the gradient uses a sample of
bounded size, and every document is scored, in Arrow batches.

Words that toxic texts hold more often are also in clean ones, so a long clean text holds many
of them. What counts is the evidence above that of a clean text with as many words. How often
clean texts hold a feature differs between kinds of text, so it is counted for each of a few
groups that the texts' own frequent words make.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from seqloom.llm.common import plain
from seqloom.session import materialise

#: Lengths of the word beginnings that are features beside the whole word.
PREFIXES = (3, 4, 5)
#: Most documents whose gradients a fit uses, expected numbers of a random sample.
MOST_POSITIVE, MOST_UNLABELLED = 3000, 9000
#: Most features of a model; those with the largest ratio stay.
MOST_FEATURES = 1 << 17
#: Rows whose crc32(doc_id as text) leaves 0 are held out of every fit.
FOLDS = 5
#: Prior if the labels name no negative to estimate it from.
PRIOR = 0.1
#: Least log-likelihood ratio by which positives hold a feature more often than all rows do.
LEAST_CONTRAST = 10.0
#: Least factor by which positives hold a feature more often than all rows do.
LEAST_LIFT = 1.5
#: Standard deviations above a clean text's mean that are no evidence.
SPREAD = 2.0
#: Numbers of words for which a clean text's evidence is tabled.
SIZES = np.unique(np.geomspace(1, 1 << 20, 100).astype(np.int64))
#: Frequent words by which texts are grouped, and number of groups.
COMMON, GROUPS = 256, 4
#: Words whose features a task remembers; features that it counts before it passes them on.
REMEMBER, FLUSH = 100_000, 150_000

#: ASCII bytes that are no letter or digit become spaces.
WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


@dataclass(frozen=True)
class Kinds:
    """Groups of texts: frequent words, and the centre of each group over them."""

    common: list[str]
    centres: np.ndarray

    def of(self, held: np.ndarray) -> int:
        """The group of a text that holds the frequent words with these numbers."""
        return int(self.centres[:, held].sum(axis=1).argmax()) if len(held) else 0


@dataclass(frozen=True)
class Model:
    """Weight and group of each feature, and what clean texts of ``SIZES`` words hold of a group."""

    features: list[str]
    weights: np.ndarray
    bias: float
    groups: np.ndarray
    allowed: np.ndarray


def held_out(doc_id: Column) -> Column:
    """True for rows that are kept out of the fit; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def word_features(word: str) -> list[str]:
    """Features of a word: itself and its beginnings."""
    return [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) > n)]


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and whatever is not ASCII."""
    return text.lower().encode().translate(WORD_BYTES).decode().split() if text else []


def word_starts(words: Iterable[str]) -> set[str]:
    """The beginnings that are features."""
    return {word[:n] for n in PREFIXES for word in words if len(word) > n}


def text_features(text: str) -> tuple[int, list[str]]:
    """Number of words and sorted distinct features of a whole text."""
    words = words_of(text)
    return len(words), sorted({f"={word}" for word in words} | {f"^{start}" for start in word_starts(words)})


class Numbered:
    """Numbers of some features; words that begin like none of them are passed over at once."""

    def __init__(self, features: Iterable[str]) -> None:
        self.place = {x: i for i, x in enumerate(features)}
        self.heads = {x[1 : 1 + PREFIXES[0]] for x in self.place}
        self.known: dict[str, list[int]] = {}

    def of(self, words: set[str]) -> list[int]:
        """Sorted numbers of the features that a text with these words holds."""
        heads, known, first, found = self.heads, self.known, PREFIXES[0], set()
        for word in words:
            if word[:first] in heads:
                ids = known.get(word)
                if ids is None:
                    if len(known) >= REMEMBER:
                        known.clear()
                    ids = known[word] = [self.place[x] for x in word_features(word) if x in self.place]
                found.update(ids)
        return sorted(found)


def texts_in(batch: pa.RecordBatch) -> Iterator[str | None]:
    """Texts of a batch, one at a time."""
    return (value.as_py() for value in batch.column(batch.schema.get_field_index("text")))


def feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, n): how many of the rows (text) hold it; tasks count before the shuffle.

    The feature "" is that of every row.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, starts, count = Counter(), Counter(), 0

        def flushed() -> pa.RecordBatch:
            names = [f"={x}" for x in whole] + [f"^{x}" for x in starts] + [""]
            columns = [pa.array(names, pa.string()), pa.array([*whole.values(), *starts.values(), count], pa.int64())]
            whole.clear()
            starts.clear()
            return pa.RecordBatch.from_arrays(columns, names=["feature", "n"])

        for batch in batches:
            for text in texts_in(batch):
                words = set(words_of(text))
                whole.update(words)
                starts.update(word_starts(words))
                count += 1
                if len(whole) + len(starts) > FLUSH:
                    yield flushed()
                    count = 0
        if count:
            yield flushed()

    counted = rows.select("text").mapInArrow(apply, "feature string, n long")
    return counted.groupBy("feature").agg(F.sum("n").alias("n"))


def side_by_side(confirmed: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, u): the counts n of confirmed and of all rows."""
    zero = F.lit(0).cast("long")
    p, u = confirmed.select(*keys, F.col("n").alias("p"), zero.alias("u")), rows.select(*keys, zero.alias("p"), F.col("n").alias("u"))
    return p.unionAll(u).groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def sampled(rows: DataFrame, features: list[str], common: list[str]) -> DataFrame:
    """Numbers of the features and frequent words of each row; the two marks of rows come along."""
    names = ["known", "other", "n", "features", "common"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered, often = Numbered(features), {x: i for i, x in enumerate(common)}
        for batch in batches:
            n, ids, held = [], [], []
            for text in texts_in(batch):
                words = words_of(text)
                n.append(len(words))
                distinct = set(words)
                ids.append(numbered.of(distinct))
                held.append(sorted(often[w] for w in often.keys() & distinct))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (ids, held)]
            columns = [batch.column("known"), batch.column("other"), pa.array(n, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "known boolean, other boolean, n long, features array<int>, common array<int>"
    return rows.select("known", "other", "text").mapInArrow(apply, schema)


def kind_counts(rows: DataFrame, features: list[str], kinds: Kinds) -> DataFrame:
    """(kind, feature, n) of rows (text): rows of each group that hold each feature.

    Feature -1 counts all rows of the group, and -2 the words of all its rows.
    """
    size = len(features)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered, often = Numbered(features), {x: i for i, x in enumerate(kinds.common)}
        held = np.zeros((len(kinds.centres), size + 2), np.int64)  # the last two are features -2 and -1
        for batch in batches:
            for text in texts_in(batch):
                words = words_of(text)
                distinct = set(words)
                kind = kinds.of(np.array(sorted(often[w] for w in often.keys() & distinct), np.int64))
                held[kind, [*numbered.of(distinct), -1]] += 1
                held[kind, -2] += len(words)
        kind, feature = np.nonzero(held)
        values = [kind, np.where(feature < size, feature, feature - size - 2), held[kind, feature]]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], names=["kind", "feature", "n"])

    counted = rows.select("text").mapInArrow(apply, "kind long, feature long, n long")
    return counted.groupBy("kind", "feature").agg(F.sum("n").alias("n"))


def kinds_of(common: list[str], held: list[np.ndarray], groups: int = GROUPS, rounds: int = 15) -> Kinds:
    """Spherical k-means over the frequent words that the rows of a sample hold."""
    rows = np.zeros((len(held), len(common)), np.float32)
    for row, ids in zip(rows, held, strict=True):
        row[ids] = 1
    rows = np.unique(rows[rows.any(axis=1)], axis=0) if len(common) else rows[:0]
    if not len(rows):
        return Kinds(common, np.zeros((1, len(common)), np.float32))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    chosen = [int((rows @ rows.mean(axis=0)).argmax())]
    near = rows @ rows[chosen[0]]
    while len(chosen) < min(groups, len(rows)):  # the row that is farthest from all centres
        chosen.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    centres = rows[chosen]
    for _ in range(rounds):
        nearest = (rows @ centres.T).argmax(axis=1)
        for k in np.unique(nearest):
            total = rows[nearest == k].sum(axis=0)
            centres[k] = total / np.linalg.norm(total)
    return Kinds(common, centres)


def _gather(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows])
    return np.concatenate(rows) if rows else np.zeros(0, np.int32), sizes


def _margins(weights: np.ndarray, bias: float, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(sizes)), sizes)
    return bias + np.bincount(row, weights=weights[ids], minlength=len(sizes))


def telling(counts: DataFrame, positives: int, rows: int) -> DataFrame:
    """The (feature, p, u) that clearly more of the positives hold than of all rows; with their ratio.

    The others would only add noise, most of all in long texts.
    """
    p, u = F.col("p").cast("double"), F.col("u").cast("double")
    expected = F.lit(positives / max(1, positives + rows)) * (p + u)
    ratio = counts.filter("p > 0").withColumn("ratio", p * F.ln(p / expected) - (p - expected))
    lift = p * F.lit(float(rows)) >= F.lit(LEAST_LIFT * positives) * u
    return ratio.filter((F.col("feature") != "") & (p > expected) & lift & (F.col("ratio") >= LEAST_CONTRAST))


@dataclass(frozen=True)
class Rows:
    """Telling features and number of words of each row of a sample."""

    ids: list[np.ndarray]
    sizes: np.ndarray


@dataclass(frozen=True)
class Held:
    """[group, feature]: positive and all rows that hold a feature; positive and all rows, and words, of a group."""

    p: np.ndarray
    u: np.ndarray
    positives: np.ndarray
    rows: np.ndarray
    words: np.ndarray


def clean_rates(held: Held, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each feature, the group whose clean text holds it most, and its rate there.

    The rate is per word: what all rows hold less the positives' part of it, and one
    standard deviation of this difference more. A group counts for itself only where its rate
    clearly exceeds that of all groups together; other features are of one further group, all.
    """

    def rate(p, u, positives, rows, words):
        each = prior * rows / np.maximum(1, positives)
        words = np.maximum(1.0, (1 - prior) * words)
        return (u - each * p) / words, np.sqrt(u + each**2 * p) / words

    whole, whole_spread = rate(held.p.sum(axis=0), held.u.sum(axis=0), held.positives.sum(), held.rows.sum(), held.words.sum())
    mean, spread = rate(held.p, held.u, held.positives[:, None], held.rows[:, None], held.words[:, None])
    own = np.where(mean - np.maximum(0, whole) > SPREAD * spread, mean + spread, -1.0)
    apart = own.max(axis=0) > 0
    group = np.where(apart, own.argmax(axis=0), len(held.rows))
    return group, np.clip(np.where(apart, own.max(axis=0), whole + whole_spread), 0, 0.5)


def clean_evidence(features: list[str], weights: np.ndarray, groups: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """[group, size]: mean and ``SPREAD`` deviations of the evidence in clean texts of ``SIZES`` words.

    Features with the same beginning come together, those with different ones on their own.
    """
    starts = [x[1 : 1 + PREFIXES[0]] for x in features]
    family = np.unique(starts, return_inverse=True)[1]
    allowed = np.zeros((groups.max() + 1, len(SIZES)))
    for k, n in enumerate(SIZES):
        q = 1 - (1 - rates) ** n
        mean = np.bincount(groups, weights * q)
        spread = np.zeros((groups.max() + 1, family.max() + 1))
        np.add.at(spread, (groups, family), weights * np.sqrt(q * (1 - q)))
        allowed[:, k] = mean + SPREAD * np.sqrt((spread**2).sum(axis=1))
    return allowed


def evidence(model: Model, ids: list[int] | np.ndarray, n: int) -> float:
    """Weight of a text's features above what a clean text of n words holds."""
    if not len(ids):
        return 0.0
    held = np.bincount(model.groups[ids], model.weights[ids])
    return float(sum(max(0.0, x - np.interp(n, SIZES, model.allowed[g])) for g, x in enumerate(held) if x))


def descend(
    positive: list[np.ndarray],
    unlabelled: list[np.ndarray],
    size: int,
    prior: float,
    epochs: int = 60,
    batch: int = 512,
    rate: float = 0.05,
    decay: float = 1e-4,
    seed: int = 5,
) -> np.ndarray:
    """Weights of ``size`` features that minimise the non-negative positive-unlabelled logistic risk (Adam).

    Weights stay at or above zero: words are evidence of toxicity, and a long text has no
    words that excuse others.
    """
    weights, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    draw = np.random.default_rng(seed)
    steps = max(1, len(unlabelled) // batch)
    part = max(32, min(len(positive), batch // 2))
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for step in range(epochs * steps):
        p = [positive[i] for i in draw.integers(0, len(positive), part)]
        u = [unlabelled[i] for i in draw.integers(0, len(unlabelled), batch)]
        (p_ids, p_sizes), (u_ids, u_sizes) = _gather(p), _gather(u)
        fp, fu = _margins(weights, bias, p_ids, p_sizes), _margins(weights, bias, u_ids, u_sizes)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        # gradients of the parts of the risk in each document's margin
        as_positive = -prior * sigmoid(-fp) / len(p)
        gu, gp = sigmoid(fu) / len(u), -prior * sigmoid(fp) / len(p)
        if negative < 0:  # the estimate went below zero: step back instead
            gu, gp, as_positive = -gu, -gp, 0 * as_positive
        gp = gp + as_positive
        gradient = np.bincount(p_ids, np.repeat(gp, p_sizes), size)
        gradient += np.bincount(u_ids, np.repeat(gu, u_sizes), size)
        gradient = np.append(gradient + decay * weights, gp.sum() + gu.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        t = step + 1
        move = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        weights, bias = np.maximum(0, weights - move[:-1]), bias - move[-1]
    return weights


def fit(features: list[str], known: Rows, others: Rows, held: Held, prior: float, seed: int = 5) -> Model:
    """The model from a sample of positive and of all rows, and from counts over all of them.

    A telling feature that no row of the sample holds gets the logarithm of its lift, on the
    scale of the weights that were fitted. Without positives, unlabelled rows or any telling
    word every score is the prior.
    """
    size, unsure = len(features), float(np.log(prior / (1 - prior)))
    none = Model([], np.zeros(0, np.float32), unsure, np.zeros(0, np.int64), np.zeros((0, len(SIZES))))
    if not known.ids or not others.ids or not size:
        return none
    weights = descend(known.ids, others.ids, size, prior, seed=seed)
    seen = np.bincount(np.concatenate([_gather(known.ids)[0], _gather(others.ids)[0]]), minlength=size) > 0
    each = held.p.sum(axis=0) * held.rows.sum() / (max(1, held.positives.sum()) * np.maximum(1, held.u.sum(axis=0)))
    lift = np.log(np.maximum(each, 1.0))
    scale = np.median(weights[seen] / np.maximum(lift[seen], 0.1)) if seen.any() else 1.0
    weights = np.where(seen, weights, scale * lift)
    groups, rates = clean_rates(held, prior)
    model = Model(features, weights, 0.0, groups, clean_evidence(features, weights, groups, rates))
    margin = lambda rows: np.array([evidence(model, *row) for row in zip(rows.ids, rows.sizes, strict=True)])
    mark = cut(margin(known), margin(others), prior, 0.0)
    return none if mark is None else replace(model, bias=-mark)


def cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float, none: float) -> float | None:
    """The margin at which F1, estimated from positives and unlabelled rows alone, is best.

    Recall is that of the positives, and the share that is predicted that of the unlabelled.
    It lies above ``none``, the margin of a text without any evidence; None if no positive has any.
    """
    marks = np.unique(np.concatenate([[none], positive[positive > none], unlabelled[unlabelled > none]]))
    if len(marks) == 1:
        return None
    above = lambda rows: 1 - np.searchsorted(np.sort(rows), marks[1:]) / len(rows)
    best = int(np.argmax(2 * prior * above(positive) / (prior + above(unlabelled))))
    return float((marks[best + 1] + marks[best]) / 2)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    most_positive: int = MOST_POSITIVE,
    most_unlabelled: int = MOST_UNLABELLED,
    seed: int = 5,
) -> Model:
    """Fit on rows outside the held-out fold; labels enter only as "confirmed toxic".

    The prior is the toxic share of the labelled rows. Unlabelled text is all documents of those
    folds, whatever their label. Features and clean texts are counted over all of them; the
    gradients alone come from samples of about ``most_positive`` and ``most_unlabelled`` rows.
    Only the texts are looked at: other columns change nothing, but that ``doc_id`` finds a
    row's label, its fold and, in a table above the bounds, its place in the sample.
    """
    inside = ~held_out(F.col("doc_id"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(inside)
    counted = marks.agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count("toxic").alias("all")).first()
    prior = counted.toxic / counted.all if 0 < (counted.toxic or 0) < counted.all else PRIOR
    # written, so that Spark knows its size: texts meet it by broadcast, or past a filter of their ids
    names = materialise(marks.filter("toxic = 1 and doc_id is not null").select("doc_id").distinct(), "confirmed")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(inside)
    confirmed = rows.join(names, "doc_id", "left_semi")  # an id may be in many rows
    both = side_by_side(feature_counts(confirmed), feature_counts(rows), ["feature"])
    counts = materialise(both.filter("p > 0 or u > 1 or feature = ''"), "feature-counts")
    every = counts.filter("feature = ''").first() or (None, 0, 0)
    positives, total = every[1], every[2]
    # what comes to the driver: telling features and a fixed number of frequent words
    best = telling(counts, positives, total).orderBy(F.desc("ratio"), "feature").limit(MOST_FEATURES)
    features = sorted(best.select("feature").toArrow().column("feature").to_pylist())
    often = counts.filter("feature like '=%'").orderBy(F.desc("u"), "feature").limit(COMMON)
    common = sorted(r.feature[1:] for r in often.collect())
    share = lambda most, n, salt: (
        F.pmod(F.xxhash64("text", "doc_id", F.lit(seed + salt)), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, most / max(1, n))))
    )
    mark = lambda known: (F.lit(known).alias("known"), F.lit(not known).alias("other"))
    drawn = confirmed.filter(share(most_positive, positives, 0)).select("text", *mark(True))
    drawn = drawn.unionAll(rows.filter(share(most_unlabelled, total, 1)).select("text", *mark(False)))
    found = sampled(drawn, features, common).toArrow().to_pylist()
    found.sort(key=lambda r: (r["n"], r["features"], r["common"]))
    few = lambda rows: Rows([np.array(r["features"], np.int64) for r in rows], np.array([r["n"] for r in rows]))
    known, others = (few([r for r in found if r[mark]]) for mark in ("known", "other"))
    kinds = kinds_of(common, [np.array(r["common"], np.int64) for r in found if r["other"]])
    held = np.zeros((2, len(kinds.centres), len(features) + 2))
    if features:
        by_kind = (kind_counts(of, features, kinds) for of in (confirmed, rows))
        for r in side_by_side(*by_kind, ["kind", "feature"]).toArrow().to_pylist():
            held[:, r["kind"], r["feature"]] = r["p"], r["u"]
    p, u = held
    return fit(features, known, others, Held(p[:, :-2], u[:, :-2], p[:, -1], u[:, -1], u[:, -2]), prior, seed=seed)


class Scorer:
    """Scores texts with a model; remembers the features of words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.numbered = Numbered(model.features)

    def score(self, text: str | None) -> float:
        words = words_of(text)
        margin = self.model.bias + evidence(self.model, self.numbered.of(set(words)), len(words))
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def with_scores(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) of each whole text; null is empty."""
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = pa.array([scorer.score(text) for text in texts_in(batch)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=schema.names)

    return docs.mapInArrow(apply, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (score >= 0.5).

    Null texts are empty and scored like any other. Without any confirmed toxic document
    every score is the prior. Further columns of either table are ignored (``lang`` and
    ``source`` too); label rows with a
    null count as unlabelled, and repeated rows as one.
    """
    model = learn(docs, labels)
    scored = with_scores(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` that are not predicted toxic, all columns unchanged.

    Columns whose name starts with two underscores are dropped.
    """
    scored = with_scores(plain(docs), learn(docs, labels), "__score")
    return scored.filter("__score < 0.5").drop("__score")
