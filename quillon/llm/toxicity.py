"""A counterfactually regularised classifier of toxic texts (operator 4)."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed_row, pick, unpacked

#: Identity terms by category (fixed values). In counterfactuals each becomes every other one of its category, or no term.
IDENTITY = (
    "christian muslim jewish hindu buddhist sikh atheist", "christians muslims jews hindus buddhists sikhs atheists", "black white asian latino arab", "women men",
    "woman man", "gay straight", "lesbian heterosexual", "transgender cisgender", "african european american chinese mexican indian", "immigrant native", "immigrants natives",
    "young old", "disabled abled", "chrétiens musulmans juifs", "femmes hommes", "christen muslime juden", "frauen männer", "cristianos musulmanes judíos", "mujeres hombres",
)
#: What ends a sentence.
SENTENCE = re.compile(r"[.!?\n]+")

SIGNS = ".,;:!?|()[]{}<>\"'«»“”‘’…*_-/\\"
#: Lengths of the word beginnings that are features beside whole words.
STEMS = (4, 5, 6)


@dataclass(frozen=True)
class Settings:
    """``most_rows`` bounds the labelled sample that is fitted, ``most_features`` the model; both are independent of the input's size."""

    threshold: float = 0.3
    most_rows: int = 40_000
    most_features: int = 4_000
    least_rows: int = 3
    least_ratio: float = 16.0
    l2: float = 1e-4
    swap_penalty: float = 1.0
    rounds: int = 300
    identity: tuple[str, ...] = IDENTITY


def words_of(text: str) -> set[str]:
    """Distinct lower-cased words without signs at their ends."""
    return {w.strip(SIGNS) for w in set(text.lower().split())} - {""}


def features_of(word: str) -> list[str]:
    """A word (a very long one as its digest) and its beginnings (marked by a star)."""
    whole = word if len(word) <= 40 else "#" + hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()
    return [whole, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def members_of(identity: tuple[str, ...]) -> dict[str, frozenset[str]]:
    """Identity term -> all terms of its category, itself included."""
    return {w: frozenset(line.split()) for line in identity for w in line.split()}


def swaps_of(text: str, members: dict[str, frozenset[str]]) -> Counter:
    """(term, other or none) -> in how many sentences of a text the term can become the other.

    Within a category swaps go in all directions; where a sentence holds the other term too, the swap would only drop the
    term, so that counterfactual is the sentence without it.
    """
    found: Counter = Counter()
    for sentence in SENTENCE.split(text):
        words = words_of(sentence)
        for term in words & members.keys():
            found.update({(term, "" if other in words else other) for other in members[term] if other != term} | {(term, "")})
    return found


@dataclass
class Model:
    """Weights of features; a text's logit is the bias and the weights of its distinct words' features."""

    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def logit_of(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features_of(word))


def _sample(labelled: DataFrame, settings: Settings) -> DataFrame:
    """At most about ``most_rows`` rows, chosen by a hash of the id; all rows where there are no more."""
    n = labelled.count()
    if n <= settings.most_rows:
        return labelled
    return labelled.filter(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * settings.most_rows / n))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fits the classifier on labelled documents (doc_id, text; doc_id, toxic).

    Features are the words and word beginnings whose log-likelihood ratio between the labels is greatest; what is fitted
    is a logistic regression on how many distinct words of a text have a feature. Each sentence with an identity term has
    counterfactuals: the term as every other member of its category, in both directions, and the sentence without the
    term, so that neither one group's name nor what all names of a category share moves a score. The squared change of
    the logit, averaged over all counterfactuals of the sample, is a penalty. Identity terms are always among the
    features; weights of 0.0001 and less are left out of the model. The driver gets the chosen features' numbers for the bounded sample and counts of pairs of terms, no texts.

    Defined results: labels other than 0 and 1 and null labels are no labels; a document labelled both ways is toxic;
    null texts and null doc_ids are left out; a text under a repeated doc_id counts as often as it is there; with no
    labels of one kind the score of every text is the share of toxic ones; other columns are ignored.
    """
    toxic = pick(labels, "doc_id", "toxic").filter("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # the sample's ids and labels are bounded by most_rows, so they are broadcast and no text is exchanged
    rows = pick(docs, "doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(_sample(toxic, settings)), "doc_id").select("toxic", "text")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for y, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen[y].update({f for w in words_of(text) for f in features_of(w)})
        names = list(seen[0] | seen[1])
        yield pa.record_batch({"f": pa.array(names, pa.string()), "n0": pa.array([seen[0][f] for f in names], pa.int64()), "n1": pa.array([seen[1][f] for f in names], pa.int64())})

    counts = rows.groupBy("toxic").count().collect()
    total = {r["toxic"]: r["count"] for r in counts}
    if len(total) < 2:
        share = total.get(1, 0) / max(1, sum(total.values()))
        return Model(bias=math.log((share + 1e-3) / (1 - share + 1e-3)))
    tallied = rows.mapInArrow(tally, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    in1, in0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    cells = [in1, in0, total[1] - in1, total[0] - in0]
    sums = [in1 + in0, total[1] + total[0] - in1 - in0, F.lit(float(total[1])), F.lit(float(total[0]))]
    x_log_x = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    whole = float(total[0] + total[1])
    ratio = 2 * (sum(map(x_log_x, cells), F.lit(whole * math.log(whole))) - sum(map(x_log_x, sums), F.lit(0.0)))
    chosen = tallied.filter(F.col("n0") + F.col("n1") >= settings.least_rows).withColumn("z", F.round(ratio, 6)).filter(F.col("z") >= settings.least_ratio)
    chosen = [r["f"] for r in chosen.orderBy(F.desc("z"), "f").limit(settings.most_features).collect()]
    members = members_of(settings.identity)
    names = {f: i for i, f in enumerate(dict.fromkeys([*chosen, *(f for w in members for f in features_of(w))]))}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}

        def numbers(words: set[str]) -> list[int]:
            out = []
            for w in words:
                if w not in known:
                    known[w] = [names[f] for f in features_of(w) if f in names]
                out += known[w]
            return out

        for batch in batches:
            y, texts = (c.to_pylist() for c in batch.columns)
            yield pa.record_batch({"y": pa.array(y, pa.int32()), "f": pa.array([numbers(words_of(t)) for t in texts], pa.list_(pa.int32()))})

    def swapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not members.keys().isdisjoint(words_of(text)):
                    found += swaps_of(text, members)
        term, other = zip(*found, strict=True) if found else ((), ())
        yield pa.record_batch({"term": pa.array(term, pa.string()), "other": pa.array(other, pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    pairs = rows.select("text").mapInArrow(swapped, "term string, other string, n long").groupBy("term", "other").agg(F.sum("n").alias("n")).collect()
    got = rows.mapInArrow(numbered, "y int, f array<int>").toArrow()
    row, col = _rows(got.column("f"))
    return _fit(got.column("y").to_numpy().astype(float), row, col, _changes(pairs, names), list(names), settings)


def _changes(pairs, names: dict[str, int]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(share of all counterfactuals, features, their change) of each pair of terms."""
    whole, out = sum(n for _, _, n in pairs), []
    for term, other, n in sorted(map(tuple, pairs)):
        change: Counter = Counter(names[f] for f in features_of(term))
        change.subtract(names[f] for f in (features_of(other) if other else ()))
        kept = [(f, v) for f, v in change.items() if v]
        out.append((n / whole, np.array([f for f, _ in kept], dtype=np.int64), np.array([v for _, v in kept], dtype=float)))
    return out


def _rows(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    flat = lists.combine_chunks()
    flat = flat if isinstance(flat, pa.ListArray) else pa.concat_arrays(flat.chunks)
    return np.repeat(np.arange(len(flat)), np.diff(flat.offsets.to_numpy())), flat.flatten().to_numpy().astype(np.int64)


def objective(w: np.ndarray, bias: float, y, row, col, changes, settings: Settings) -> float:
    """What ``_fit`` makes small: mean log loss, half the squares of weights, half the mean squared change under swaps."""
    logit = bias + np.bincount(row, w[col], len(y))
    loss = np.mean(np.logaddexp(0, logit) - y * logit)
    return float(loss + settings.l2 / 2 * (w @ w) + settings.swap_penalty / 2 * sum(share * float(w[f] @ v) ** 2 for share, f, v in changes))


def _fit(y: np.ndarray, row: np.ndarray, col: np.ndarray, changes, names: list[str], settings: Settings) -> Model:
    n, k = len(y), len(names)
    pair = np.repeat(np.arange(len(changes)), [len(f) for _, f, _ in changes]) if changes else np.zeros(0, dtype=np.int64)
    pair_col = np.concatenate([np.zeros(0, dtype=np.int64), *(f for _, f, _ in changes)])
    pair_by = np.concatenate([np.zeros(0), *(v for _, _, v in changes)])
    share = np.array([s for s, _, _ in changes])
    w, bias = np.zeros(k), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    scale = 1 / np.sqrt(np.maximum(np.bincount(col, minlength=k) / n, 1e-4))  # steps suit rare features too
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for step in range(1, settings.rounds + 1):
        logit = bias + np.bincount(row, w[col], n)
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        error = (p - y) / n
        grad = np.bincount(col, error[row], k) + settings.l2 * w
        if len(pair):
            change = np.bincount(pair, pair_by * w[pair_col], len(share))
            grad += settings.swap_penalty * np.bincount(pair_col, pair_by * (share * change)[pair], k)
        grad_b = error.sum()
        m, v = 0.9 * m + 0.1 * grad * scale, 0.99 * v + 0.01 * (grad * scale) ** 2
        mb, vb = 0.9 * mb + 0.1 * grad_b, 0.99 * vb + 0.01 * grad_b**2
        rate = 0.1 * (1 - step / (settings.rounds + 1))
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**step)) / (math.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return Model(float(bias), {f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-4})


class _Logits(dict):
    """Word with its signs -> logit, within a bound."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, raw: str) -> float:
        if len(self) >= 200_000:
            self.clear()
        self[raw] = value = self.model.logit_of(raw.strip(SIGNS))
        return value


def scorer(model: Model):
    """A function from a text to its score, 0 to 1."""
    logits = _Logits(model)

    def score(text: str | None) -> float:
        words = {w.strip(SIGNS) for w in set((text or "").lower().split()) if logits[w]}
        logit = model.bias + sum(model.logit_of(w) for w in sorted(words))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, logit))))

    return score


def score(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """doc_id, score, predicted of every whole text. No exchange.

    Defined results: null and empty texts get the score of no words; null doc_ids and repeated rows are rows like others;
    an empty table gives no rows; other columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(model)
        for batch in batches:
            s = np.array([of(t) for t in batch.column(1).to_pylist()], dtype=float)
            yield pa.record_batch({"doc_id": batch.column(0).cast(pa.int64()), "score": pa.array(s), "predicted": pa.array((s >= settings.threshold).astype(np.int32))})

    return pick(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """The documents that are not predicted toxic, with all columns of ``docs``.

    Defined results: null and empty texts have the score of no words; each row counts by itself, whatever its doc_id.
    """
    packed, columns = packed_row(docs, "text")

    @F.pandas_udf("boolean")
    def fine(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = scorer(model)
        for texts in parts:
            yield texts.map(lambda t: of(t) < settings.threshold)

    return unpacked(packed.filter(fine("__k_text")), columns)
