"""Operator 4: what the penalty does to neutral mentions of groups, and the whole query against a plain version."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from quillon.llm import queries, toxicity

SF = "/root/testdata/sf0.001"
GROUPS = "christian muslim jewish hindu women men black white gay straight".split()
CALM = "garden river market train bread window music letter lamp season copper valley harbour paper bridge".split()
INSULTS = "moron scum vermin idiot".split()


def sentence(rng, *marked):
    words = [*rng.choices(CALM, k=9), *marked]
    rng.shuffle(words)
    return " ".join(words) + "."


@pytest.fixture(scope="module")
def models(spark):
    """Fitted with the default penalty and without one. Insults decide the labels, but for a fifth of the toxic texts, whose
    words (and their beginnings) no other text has; groups are named in most toxic texts and in few others."""
    rng = random.Random(4)
    rows = [(sentence(rng, *([rng.choice(GROUPS)] if rng.random() < 0.05 else [])), 0) for _ in range(1000)]
    for i in range(300):
        bad = "".join(rng.choices("bcdfghjklmnpqrstvwxz", k=9)) if i % 5 == 0 else rng.choice(INSULTS)
        rows.append((sentence(rng, bad, *([rng.choice(GROUPS)] if rng.random() < 0.7 else [])), 1))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    settings = toxicity.Settings()
    assert settings.swap_penalty == 1.0
    return tuple(toxicity.scorer(toxicity.train(docs, labels, s)) for s in (settings, toxicity.Settings(swap_penalty=0.0)))


def test_penalty_spares_neutral_mentions(models):
    """Held-out texts: calm ones that name a group are rejected without the penalty and kept with it; no insult is missed by it."""
    rng, least = random.Random(5), toxicity.Settings().threshold
    neutral = [sentence(rng, g) for g in GROUPS for _ in range(20)]
    plain = [sentence(rng) for _ in range(200)]
    insults = [sentence(rng, rng.choice(INSULTS), *([rng.choice(GROUPS)] if i % 2 else [])) for i in range(200)]
    with_penalty, without = models
    share = lambda score, texts: sum(score(t) >= least for t in texts) / len(texts)
    assert share(without, neutral) > 0.5 and share(with_penalty, neutral) < 0.05
    assert share(with_penalty, insults) >= share(without, insults) - 0.01 and share(with_penalty, insults) > 0.95
    assert share(with_penalty, plain) < 0.05


def test_penalty_keeps_scores_of_counterfactuals_together(models):
    with_penalty, without = models
    rng = random.Random(6)
    for _ in range(20):
        words = sentence(rng, "@")
        far = lambda score: max(s := [score(words.replace("@", g)) for g in GROUPS] + [score(words.replace("@", ""))]) - min(s)  # noqa: B023, E731
        assert far(with_penalty) < far(without) / 4


def test_query_against_a_plain_version(spark):
    settings = toxicity.Settings()
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet", columns=["doc_id", "toxic"]).to_pylist()}
    held_out = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs}
    rows = [(labels[i], t) for i, t in docs.items() if t is not None and labels.get(i) in (0, 1) and not held_out[i]]
    words = lambda t: {w.strip(toxicity.SIGNS) for w in t.lower().split()} - {""}
    seen = {y: Counter() for y in (0, 1)}
    for y, t in rows:
        seen[y].update({f for w in words(t) for f in toxicity.features_of(w)})
    total = Counter(y for y, _ in rows)

    def ratio(f):
        """Twice the log-likelihood by which the label explains the feature."""
        n = len(rows)
        table = {(1, y): seen[y][f] for y in (0, 1)} | {(0, y): total[y] - seen[y][f] for y in (0, 1)}
        has = {x: table[x, 0] + table[x, 1] for x in (0, 1)}
        return 2 * sum(k * math.log(k * n / (has[x] * total[y])) for (x, y), k in table.items() if k)

    scored = {f: round(ratio(f), 6) for f in seen[0] | seen[1] if seen[0][f] + seen[1][f] >= settings.least_rows}
    chosen = sorted((f for f in scored if scored[f] >= settings.least_ratio), key=lambda f: (-scored[f], f))[: settings.most_features]
    assert 0 < len(chosen) < settings.most_features and len(rows) < settings.most_rows
    terms = {w for line in settings.identity for w in line.split()}
    names = {f: i for i, f in enumerate(dict.fromkeys([*chosen, *(f for w in terms for f in toxicity.features_of(w))]))}
    assert not any(words(t) & terms for _, t in rows)  # so the penalty has nothing to act on here
    pairs = [(r, names[f]) for r, (_, t) in enumerate(rows) for w in words(t) for f in toxicity.features_of(w) if f in names]
    model = toxicity._fit(np.array([y for y, _ in rows], dtype=float), np.array([r for r, _ in pairs]), np.array([c for _, c in pairs]), [], list(names), settings)
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        logit = model.bias + sum(model.weights.get(f, 0.0) for w in words(t or "") for f in toxicity.features_of(w))
        want = 1 / (1 + math.exp(-min(30.0, max(-30.0, logit))))
        assert abs(got[i]["score"] - want) < 1e-4 and got[i]["held_out"] == held_out[i] and got[i]["predicted"] == (got[i]["score"] >= settings.threshold)
