"""The training-data operators against brute force, and on odd rows: nulls, empty, long and repeated texts, empty tables, clashing columns."""

import bisect
import hashlib
import math
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm import fingerprint, huffman, licenses, mixing, neardup, packing, pii, queries, sharding, token_file, tokens, topk, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `DOC_ID` string, idx long, score double, __pid int, part int"
LONG = "stretch of words that goes on " * 20_000
ODD = [
    (1, "one two three four five six seven eight nine ten\nmail me at jo@ex-ample.org, card 4111 1111 1111 1111", "en", "a", 95, "x", 9, 0.1, 1, 1),
    (2, None, "en", "a", None, None, None, None, None, None),
    (3, "", "en", None, 0, "y", 1, 0.2, 2, 2),
    (4, LONG, None, "a", len(LONG), "z", 2, 0.3, 3, 3),
    (5, "one two three four five six seven eight nine ten\nmail me at jo@ex-ample.org, card 4111 1111 1111 1111", None, None, 95, None, None, None, None, None),
    (6, "tiny text", "fr", "b", 9, None, None, None, None, None),
    (6, "tiny text", "fr", "b", 9, None, None, None, None, None),
    (None, "no name for this one here at all", "de", "b", 32, None, None, None, None, None),
    (None, "no name for this one here at all", "de", "b", 32, None, None, None, None, None),
    (7, " \t\n \r\n  ", "de", "c", 8, None, None, None, None, None),
    (8, "é ñ 中文    x😀 <|endoftext|> don't", "xx", "c", 30, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    df = spark.createDataFrame(ODD, SCHEMA)
    spark.conf.set("spark.sql.caseSensitive", "false")
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokens.default_tokenizer())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


# 1


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate([("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = kind == "email"
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == "card":
                ok = 12 <= len(digits) <= 19 and pii.luhn(digits)
            elif kind == "phone":
                ok = 9 <= len(digits) <= 15
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1@.-+ ()2 5%x,4", max_size=60))
def test_pii_base_spans_on_any_text(text):
    assert pii.told([s for s in pii.find(text) if s.kind in pii.BASE]) == plain_spans(text)


def test_pii_query(spark, docs):
    got = {r["doc_id"]: r for r in queries.op1_pii(spark, SF).collect()}
    assert all(got[i]["base_sha256"] == hashlib.sha256(plain_spans(t).encode()).hexdigest() for i, t, _ in docs)


def test_pii_checksums_context_and_long_runs():
    assert pii.mod_97("DE89 3704 0044 0532 0130 00") and not pii.mod_97("DE88 3704 0044 0532 0130 00")
    assert [s.kind for s in pii.find("my ssn: 123-45-6789")] == ["ssn"] and pii.find("part 123-45-6789") == []
    assert [s.kind for s in pii.find("IBAN DE89 3704 0044 0532 0130 00")] == ["iban"] and [s.kind for s in pii.find("call 415-555-1212")] == ["local_phone"]
    for run in ("1" * 200_000, "a" * 200_000, "@" * 200_000, "1." * 100_000, "+1" + " " * 100_000, "a@" * 100_000):
        pii.find(run)


def test_places_of_spans():
    """What meets an earlier span, against comparing with all of them; many extra spans take no square of time."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        taken, places = pii._Taken(), []
        for kind in "ab":
            at = 0
            for _ in range(int(rng.integers(0, 12))):
                a = at + int(rng.integers(0, 9))
                at = a + int(rng.integers(1, 7))
                if not any(x < at and a < y for x, y in places):
                    assert kind == "a" or not taken.meets(a, at, kind)
                    taken.add(a, at)
                else:
                    assert taken.meets(a, at, kind)
            places = list(taken.places)
    text = "call 555-867-5309 now. " * 40_000
    assert len(pii.find(text)) == 40_000


def test_pii_odd(odd, empty):
    got = pii.scan(odd).collect()
    assert len(got) == len(ODD) and sum(r["n_email"] for r in got) == 2 and sum(r["n_card"] for r in got) == 2 and pii.scan(empty).count() == 0
    clean = pii.redact(odd)
    assert clean.columns == odd.columns
    texts = {r["doc_id"]: r for r in clean.collect()}
    assert texts[1]["text"].endswith("mail me at <EMAIL>, card <CARD>") and texts[1]["n_chars"] == len(texts[1]["text"]) and texts[2]["text"] is None


# 2


def test_license_scan(spark, odd, empty):
    mit = "Copyright (c) 2020 Someone\n\n" + licenses._MIT.upper().replace(",", " ;") + "\n"
    rows = [(1, mit), (2, "Some text\n  released under the MIT licence\nmore"), (3, "All rights reserved."), (4, mit + "more")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["license"], got[4]["license"], got[2]["license"]) == ("MIT", None, None)
    assert (got[2]["n_notices"], got[2]["notices"]) == (1, "MIT") and got[3]["digest"] == licenses.digest_text("")
    assert all(licenses.digest_text(t) == got[i]["digest"] for i, t in rows)
    found = Counter((r["doc_id"], r["license"], r["n_notices"]) for r in licenses.scan(odd).collect())
    assert found == Counter((r[0], None, 0) for r in ODD) and licenses.scan(empty).count() == 0
    padded = [(1, "Released under the" + " -*" * 33_000 + " MIT License."), (2, textwrap.fill(licenses._UNLICENSE.split("\n")[0], 30) + "\n\n" + licenses._UNLICENSE.split("\n", 1)[1])]
    got = {r["doc_id"]: (r["license"], r["n_notices"]) for r in licenses.scan(spark.createDataFrame(padded, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", 1), 2: ("Unlicense", 0)}


# 3


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_packing_plan(counts):
    runs, bins = packing.plan(counts, 40)
    used, seen = Counter(), Counter()
    cells = []
    for r in runs:
        for nth in range(r.n):
            cells.append((r.bin + nth // r.each, r.offset + nth % r.each * r.size, r.size))
            used[r.bin + nth // r.each] += r.size
        assert r.first == seen[r.size]
        seen[r.size] += r.n
    assert seen == Counter(counts) and all(v <= 40 for v in used.values()) and set(used) == set(range(bins))
    ends = {}
    for b, at, size in sorted(cells):
        assert ends.get(b, 0) == at
        ends[b] = at + size
    large = Counter(b for b, _, size in cells if 3 * size > 40)
    assert all(n <= 2 for n in large.values())
    assert bins <= 1.1 * best_fit_decreasing([s for s, n in counts.items() for _ in range(n)], 40) + 1


def check_pieces(rows, texts, library, capacity=2048):
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert at.get(r["sequence_id"], 0) == r["offset"]
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(v <= capacity for v in at.values())
    pieces = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    wanted = Counter()
    for i, t in texts:
        ids = library(t) + [0]
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
        wanted.update((i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert pieces == wanted
    return len(at)


def test_packing_query(spark, docs, library):
    rows = queries.op3_best_fit_packing(spark, SF).collect()
    n = check_pieces(rows, [(i, t) for i, t, _ in docs], library)
    assert n <= 1.01 * best_fit_decreasing([r["length"] for r in rows], 2048) + 1


def best_fit_decreasing(sizes, capacity):
    """The number of bins of the plain method: each size, largest first, into the fullest bin that still has room."""
    room = []
    for size in sorted(sizes, reverse=True):
        at = bisect.bisect_left(room, size)
        if at < len(room):
            bisect.insort(room, room.pop(at) - size)
        else:
            bisect.insort(room, capacity - size)
    return len(room)


def test_packing_odd(odd, empty, library):
    check_pieces(packing.pack(odd).collect(), [(r[0], r[1]) for r in ODD], library)
    assert packing.pack(empty).count() == 0


# 4


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got) / len(got)
    clean = [r["predicted"] for r in got if not r["toxic"]]
    assert right >= 0.93 and sum(clean) / len(clean) <= 0.02


def test_toxicity_ignores_swapped_groups(spark):
    rows = [(i, f"{'you idiot stupid' if i % 2 else 'kind calm'} words about {'women' if i % 4 < 2 else 'men'} number{i % 7} and {'muslims' if i % 3 == 0 else 'plain'}") for i in range(400)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    score = toxicity.scorer(toxicity.train(d, lab))
    assert score("you stupid idiot") > 0.5 > score("kind calm words")
    for a, b in (("women", "men"), ("muslims", "jews"), ("black", "white")):
        assert abs(score(f"the {a} of the town") - score(f"the {b} of the town")) < 0.02


def test_toxicity_reduces_what_a_category_shares(spark):
    """Every group is named mostly in toxic texts: a strong penalty takes most of what a group's name moves off the score."""
    groups = "muslims jews hindus christians".split()
    rows = [(i, f"{'idiot' if i % 2 and i % 6 != 1 else 'calm'} words number{i % 5}. Some talk about {groups[i // 2 % 4] if i % 2 or i % 10 == 0 else 'gardens'} here") for i in range(600)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    with_penalty, without = (toxicity.scorer(toxicity.train(d, lab, toxicity.Settings(swap_penalty=x))) for x in (20.0, 0.0))
    for group in groups:
        text = f"calm words. Some talk about {group} here"
        moved = [abs(math.log(s(text) / (1 - s(text))) - math.log(s(text.replace(group, "")) / (1 - s(text.replace(group, ""))))) for s in (with_penalty, without)]
        assert moved[0] < moved[1] / 4, moved
    assert with_penalty("idiot words") > 0.5


def test_swaps_are_of_sentences():
    members = toxicity.members_of(("red green blue", "up down"))
    got = toxicity.swaps_of("Red sky! Green and blue, up.\nnothing here. RED", members)
    assert got == Counter({("red", "green"): 2, ("red", "blue"): 2, ("red", ""): 2, ("green", "red"): 1, ("green", ""): 1, ("blue", "red"): 1, ("blue", ""): 1, ("up", "down"): 1, ("up", ""): 1})


def test_toxicity_fit_against_plain_descent():
    rng = np.random.default_rng(1)
    n, k, settings = 300, 12, toxicity.Settings(l2=1e-2)
    x = (rng.random((n, k)) < 0.3).astype(float)
    y = (x @ rng.normal(size=k) + rng.normal(size=n) > 0).astype(float)
    row, col = np.nonzero(x)
    changes = [(0.5, np.array([0, 1]), np.array([1.0, -1.0])), (0.3, np.array([2]), np.array([1.0])), (0.2, np.array([1, 3, 4]), np.array([1.0, -1.0, -1.0]))]
    model = toxicity._fit(y, row, col, changes, [str(i) for i in range(k)], settings)
    w, bias = np.zeros(k), 0.0
    for _ in range(20_000):
        error = (1 / (1 + np.exp(-(bias + x @ w))) - y) / n
        grad = x.T @ error + settings.l2 * w
        for share, f, v in changes:
            grad[f] += settings.swap_penalty * share * (w[f] @ v) * v
        w, bias = w - 0.5 * grad, bias - 0.5 * error.sum()
    fitted = np.array([model.weights.get(str(i), 0.0) for i in range(k)])
    best = toxicity.objective(w, bias, y, row, col, changes, settings)
    assert toxicity.objective(fitted, model.bias, y, row, col, changes, settings) <= best + 1e-3 and np.abs(fitted - w).max() < 0.1


def test_toxicity_with_odd_labels(spark):
    texts = [(i, f"{'idiot' if i % 2 else 'calm'} words {i % 3}") for i in range(60)] + [(None, "idiot"), (70, None), (71, ""), (72, "x" * 45 + "a"), (72, "x" * 45 + "b"), (1, "idiot again")]
    labels = [(i, i % 2) for i in range(60)] + [(1, 1), (2, 0), (3, 0), (5, None), (6, 7), (None, 1), (70, 1), (71, 0), (72, 1), (500, 1)]
    d, lab = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    score = toxicity.scorer(toxicity.train(d, lab))
    assert score("an idiot") > 0.5 > score("calm") and 0 < score(None) == score("") < 1
    assert len({toxicity.features_of("x" * 45 + c)[0] for c in "ab"}) == 2


def test_toxicity_odd(spark, odd, empty):
    model = toxicity.Model(-2.0, {"tiny": 5.0})
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and {r["doc_id"] for r in got if r["predicted"]} == {6}
    assert toxicity.accepted(odd, model).count() == len(ODD) - 2 and toxicity.score(empty, model).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert 0 <= toxicity.scorer(toxicity.train(odd, none))("x") <= 1


# 5


def plain_search(texts, query, k):
    words = {i: Counter(t.encode().lower().split()) for i, t in texts}
    n, mean = len(words), sum(sum(c.values()) for c in words.values()) / len(words)
    score = Counter()
    for w, q in Counter(query.encode().lower().split()).items():
        df = sum(w in c for c in words.values())
        for i, c in words.items():
            if c[w]:
                score[i] += q * np.log(1 + (n - df + 0.5) / (df + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
    return sorted(((-round(s, 6), i) for i, s in score.items()))[:k]


def test_search_is_exact(spark, docs, monkeypatch):
    """Short and document-length queries on many shards, with several blocks a shard."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    asked = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(10_000 + i, t) for i, t, _ in docs[:12]]
    d, q = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    got = {}
    for r in topk.search(d, q, k=7, shard_bytes=100_000).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["doc_id"]))
    texts = [(i, t) for i, t, _ in docs]
    for i, t in asked:
        want = plain_search(texts, t, 7)
        assert [x[1] for x in got[i]] == [x[1] for x in want] and np.allclose([x[0] for x in got[i]], [x[0] for x in want], atol=2e-6)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=14), min_size=1, max_size=60), st.lists(st.integers(0, 14), min_size=1, max_size=8), st.integers(1, 6), st.floats(0, 4))
def test_pruning_loses_nothing(docs, query, k, floor):
    """A shard's results are those of scoring everything, with and without a score to beat."""
    block, topk.BLOCK = topk.BLOCK, 4
    try:
        texts = [" ".join(f"w{x}" for x in d).encode() for d in docs]
        raw = topk._packed(list(range(len(docs))), [(*np.unique(topk.terms(t), return_counts=True), len(topk.terms(t))) for t in texts])
        mean = sum(map(len, docs)) / len(docs)
        shard = topk.Shard(*(c[0].as_py() for c in raw.columns), mean)
        words = np.unique(topk.terms(" ".join(f"w{x}" for x in query).encode()))
        weights = 0.01 + (words % 97) / 20.0
        score = {}
        for i, t in enumerate(texts):
            own = topk.terms(t)
            hits = [(w, (own == x).sum()) for x, w in zip(words, weights, strict=True) if (own == x).any()]
            if hits:
                score[i] = round(sum(w * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(own) / max(mean, 1e-9))) for w, n in hits), 6)
        want = sorted((-s, i) for i, s in score.items() if s >= floor)[:k]
        got = shard.search(words, weights, k, floor)
        assert len(got) == len(want) and all(abs(a - b) < 3e-6 for (a, _), (b, _) in zip(got, want, strict=True))
        assert all(abs(score[i] + s) < 3e-6 for s, i in got)
    finally:
        topk.BLOCK = block


def test_search_odd(spark, odd, empty):
    q = spark.createDataFrame([(1, "tiny mail"), (2, None), (3, ""), (None, "tiny"), (4, "absent"), (5, "tiny"), (5, "tiny")], "query_id long, text string")
    got = [(r["query_id"], r["rank"], r["doc_id"]) for r in topk.search(odd, q, k=3).collect()]
    assert sorted(got) == [(1, 1, 6), (1, 2, 6), (1, 3, 1), (5, 1, 6), (5, 2, 6)]
    assert topk.search(empty, q).count() == 0 and topk.search(odd, q.limit(0)).count() == 0


# 6


def test_mixing_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 0, None: 300}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    want, free, rest = {}, set(sizes), sum(sizes.values())
    while True:
        total = sum(weights[s] for s in free)
        over = [s for s in free if rest * weights[s] / total > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 3 * sizes[s]
            rest -= want[s]
            free.discard(s)
    want |= {s: rest * weights[s] / total for s in free}
    assert got == pytest.approx(want)


def test_mixing_odd(odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r["taken"] <= 3 * r["size"] for r in got) and mixing.mix(empty).count() == 0
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(odd).collect()))
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    assert sum(r["doc_id"] == 4 for r in out.collect()) == next(r["copies"] for r in got if r["doc_id"] == 4)


def test_mixed_documents_under_odd_names(spark):
    """Sources whose rows share an id or have none come as near their targets as others."""
    rows = [(None if k == 0 else 7 if k == 1 else i, f"{'w ' * (1 + i % 20)}{k}", "abc"[k]) for k in range(3) for i in range(400 - 150 * k)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = {r["source"]: r["target"] for r in mixing.mix(df).select("source", "target").distinct().collect()}
    taken = Counter()
    for r in mixing.mixed_documents(df).collect():
        taken[r["source"]] += len(r["text"].split())
    assert all(abs(taken[x] - t) <= 25 for x, t in targets.items()), (taken, targets)


# 7


def test_fingerprints(spark, docs):
    got = {r["doc_id"]: r for r in queries.op7_fingerprints(spark, SF).collect()}
    ids = sorted((i for i, _, _ in docs), reverse=True)
    text = {i: t for i, t, _ in docs}
    for k, i in enumerate(ids):
        half = len(text[i]) // 2
        edited = text[i][: len(text[i]) - half] + text[ids[(k + 1) % len(ids)]][:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(text[i])
    prints = {}
    for i, t, _ in docs:
        assert prints.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert len(set(prints.values())) == len(prints)
    off = []
    for k, i in enumerate(ids):
        after = text[ids[(k + 1) % len(ids)]]
        half = len(text[i]) // 2
        own = pieces_of(text[i])
        for kind, other in (("near_edited", text[i][: len(text[i]) - half] + after[:half]), ("near_next", after)):
            other = pieces_of(other)
            apart = sum((own[x] - other[x]) ** 2 for x in own | other)
            both = sum(v * v for v in own.values()) + sum(v * v for v in other.values())
            off.append(got[i][kind] - (1 - apart / both if both else 1.0))
    assert np.std(off) < 0.05 and abs(np.mean(off)) < 0.02 and np.abs(off).max() < 0.3


def pieces_of(text):
    return Counter(p for line in text.split("\n") for p in re.split(r"[.!?;:,|] +", line) if p)


def test_lanes_have_salts_of_their_own(spark):
    """No hash of a paragraph is a function of another one, and counts beyond a byte hold."""
    text = "one"
    chained = spark.range(1).select(F.xxhash64(F.lit(text), F.lit(0)).alias("h")).first()["h"]
    fp = fingerprint.with_lanes(spark.createDataFrame([(text,), ("a. " * 70_000,)], "text string"), "text", "fp").collect()
    strong = [fp[0]["fp"][2 * i] | fp[0]["fp"][2 * i + 1] << 32 for i in range(fingerprint.HASHES)]
    assert len(set(strong)) == fingerprint.HASHES and chained & (1 << 64) - 1 not in strong
    counts = [x for v in fp[1]["fp"][fingerprint.STRONG : fingerprint.STRONG + fingerprint.PACKED] for x in (v & fingerprint.MASK, v >> 32)]
    assert len(counts) == fingerprint.LANES and set(counts) == {0, 70_000} and sum(fp[1]["fp"][-fingerprint.CLASSES :]) == 70_000 and 15 < counts.count(70_000) < 50


def test_fingerprints_split_frequent_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 10)
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text number {i}. of many") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert df.join(fingerprint.with_next(df), "text").count() == 200
    got = {r["text"]: (r["doc_id"], r["next_text"]) for r in fingerprint.with_next(df).collect()}
    at, seen = "text number 199. of many", []
    while at not in seen:
        seen.append(at)
        at = got[at][1]
    assert len(seen) == 200 and at == seen[0]
    order = [got[t][0] for t in seen]
    k = next(i for i in range(200) if order[i] == 197)
    order = order[k:] + order[:k]
    assert order == sorted(order, key=lambda i: (i is None, -(i or 0)))


def test_fingerprints_are_homomorphic(spark):
    rows = [("ab", "one, two\nthree. four"), ("ba", "three. four\none, two"), ("a", "one, two"), ("b", "three. four"), ("c", "else")]
    df = fingerprint.with_lanes(spark.createDataFrame(rows, "name string, text string"), "text", "fp")
    got = {r["name"]: r for r in df.select("name", fingerprint.as_text(F.col("fp")).alias("t")).collect()}
    assert got["ab"]["t"] == got["ba"]["t"] != got["c"]["t"]
    a, b, ab = (df.filter(F.col("name") == n).select(F.col("fp").alias(n)) for n in ("a", "b", "ab"))
    one = a.join(b).join(ab).select((fingerprint.added(F.col("a"), F.col("b")) == F.col("ab")).alias("x"), (fingerprint.removed(F.col("ab"), F.col("b")) == F.col("a")).alias("y")).first()
    assert one["x"] and one["y"]


def test_fingerprints_odd(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 2)
    got = fingerprint.fingerprints(odd).collect()
    order = sorted(ODD, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r[1] or "" for r in order]
    want = Counter()
    for k, t in enumerate(texts):
        half = len(t) // 2
        want[(order[k][0], hashlib.sha256((t[: len(t) - half] + texts[(k + 1) % len(texts)][:half]).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want and fingerprint.fingerprints(empty).count() == 0
    assert fingerprint.fingerprints(spark.createDataFrame([(1, "alone here")], "doc_id long, text string")).first()["near_next"] == 1.0


# 8


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n\tab.,'sT1é 　中\x1c<|", max_size=25))
def test_tokens_as_the_library(text):
    global _E
    _E = globals().get("_E") or tokens.TextEncoder(tokens.default_tokenizer())
    assert np.frombuffer(_E(text), "<u4").tolist() == _E.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=400), max_size=6), st.integers(9, 14))
def test_huffman_round_trip(texts, limit):
    counts = np.bincount(np.array([x for t in texts for x in t], dtype=int), minlength=1)
    lengths = huffman.code_lengths(counts, limit)
    assert int(lengths.max(initial=0)) <= limit and sum(2.0 ** -int(x) for x in lengths if x) <= 1
    code = huffman.Code(lengths)
    ids, sizes, back = huffman.decode_block(code, huffman.encode_block(code, list(range(len(texts))), [np.array(t, dtype=np.int64) for t in texts]))
    assert ids == list(range(len(texts))) and sizes.tolist() == list(map(len, texts)) and back.tolist() == [x for t in texts for x in t]


def check_tokens(rows, texts, library):
    at, want = 0, Counter()
    for i, t in texts:
        ids = library(t) + [2]
        want[(i, at, len(ids), crc(ids))] += 1
        at += len(ids)
    assert Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want


def test_token_file_query(spark, docs, library):
    check_tokens(queries.op8_token_file(spark, SF).collect(), [(i, t) for i, t, _ in docs], library)


def test_token_file_odd(odd, empty, library, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK_IDS", 50)
    order = sorted(ODD, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    check_tokens(token_file.round_trip(odd).collect(), [(r[0], r[1]) for r in order], library)
    assert token_file.round_trip(empty).count() == 0


# 9


def check_shards(rows, n, shards=8):
    counts = Counter(r["shard"] for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert len(rows) == n and max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def test_sharding_query(spark, docs):
    rows = queries.op9_sharding(spark, SF).collect()
    check_shards(rows, len(docs))
    info = {i: (t, s) for i, t, s in docs}
    assert all(r["size"] == len(info[r["doc_id"]][0].encode()) + 1 and r["text_crc32"] == zlib.crc32(info[r["doc_id"]][0].encode()) for r in rows)
    for source in {s for _, _, s in docs}:
        per = Counter(r["shard"] for r in rows if info[r["doc_id"]][1] == source)
        assert max(per.get(s, 0) for s in range(8)) - min(per.get(s, 0) for s in range(8)) <= 1


def test_sharding_odd(odd, empty):
    check_shards(sharding.interleave(odd).collect(), len(ODD))
    assert sharding.interleave(empty).count() == 0


# 10


def plain_groups(rows, percent):
    sets = []
    for _, t in rows:
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(rows[a][0]), find(rows[b][0])
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True)}


def near_rows(seed=5):
    rng = np.random.default_rng(seed)
    word = lambda: "w" + str(rng.integers(0, 4000))
    rows = []
    for base in range(12):
        words = [word() for _ in range(int(rng.integers(3, 220)))]
        for _ in range(int(rng.integers(1, 25))):  # chains and clouds around the threshold
            if rng.random() < 0.5 and rows:
                words = rows[-1].split()
            words = list(words)
            for _ in range(int(rng.integers(0, 3))):
                words[int(rng.integers(0, len(words)))] = word()
            rows.append(" ".join(words))
    return list(enumerate(rows))


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_lose_no_link(spark, percent, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 4)
    rows = near_rows()
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    want = plain_groups(rows, percent)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want and all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_odd(odd, empty):
    got = neardup.near_duplicates(odd, 85).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[5]["component_id"] == 1 and not by[5]["kept"] and by[6]["kept"] and by[6]["n_shingles"] == 1
    assert by[2]["n_shingles"] == by[3]["n_shingles"] == by[7]["n_shingles"] == 0
    assert sorted(r["kept"] for r in got if r["doc_id"] is None) == [False, True] and by[None]["component_id"] is None
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_under_odd_names(spark):
    """Two texts of one doc_id are two documents; rows without an id are linked like others; one row of a group stays."""
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abc"}
    rows = [(1, text["a"]), (1, text["b"]), (2, text["a"] + " more"), (3, text["b"]), (None, text["b"]), (None, text["c"]), (None, text["c"]), (1, text["a"]), (4, ""), (4, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string")
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, 80).collect())
    assert got == Counter({(1, 1, True): 3, (2, 1, False): 1, (3, 1, False): 1, (None, 1, False): 1, (None, None, True): 1, (None, None, False): 1, (4, 4, True): 2})
    left = Counter((r["doc_id"], r["text"][:2], r["source"]) for r in neardup.distinct_documents(df, 80).collect())
    assert left == Counter({(1, "a0", "x"): 1, (1, "b0", "x"): 1, (None, "c0", "x"): 1, (4, "", "x"): 2})


def test_near_duplicates_in_one_large_bucket(spark, monkeypatch):
    """Documents of many sizes that all share their beginning meet by size class and block, and no link is lost."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(3)
    shared = [f"s{i}" for i in range(40)]
    rows = [(i, " ".join(shared + [f"u{i // 2}-{k}" for k in range(int(rng.integers(0, 60)) if i % 2 else 30)])) for i in range(120)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == plain_groups(rows, 85)


def test_estimates_follow_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        a = rng.integers(0, 2**63, 4000).astype(np.uint64)
        n = round(4000 * 2 * share / (1 + share))
        b = np.concatenate([a[:n], rng.integers(0, 2**63, 4000 - n).astype(np.uint64)])
        x, y = neardup.registers(np.unique(a << np.uint64(1))), neardup.registers(np.unique(b << np.uint64(1)))
        assert abs(neardup.estimate(x[None], y[None], np.array([4000]), np.array([4000]))[0][0] - share) < 0.15


# the pipeline


def test_pipeline_stages(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, SF)
        after = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(after, docs.schema)
        if name in ("toxicity", "near_duplicates"):
            assert set(after) <= set(before)
        if name == "near_duplicates":
            want = plain_groups([(r["doc_id"], r["text"]) for r in before], 80)
            assert {r["doc_id"] for r in after} == {i for i, (n, c) in want.items() if i == c}
        if name == "pii":
            assert {r["doc_id"]: r["text"] for r in after} == {r["doc_id"]: pii.redacted(r["text"], pii.find(r["text"])) for r in before}
        if name == "packing":
            check_pieces_of_copies(after, before, library)


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_pipeline_on_odd_tables(spark, tmp_path, rows):
    docs = [r[:5] for r in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(1, 0, 0), (1, 1, None), (6, None, 1), (6, 1, 1), (6, 1, 0), (None, 1, 1), (2, 1, 1), (77, 0, 1), (4, 0, 5), (3, 1, 0), (4, 1, 0), (5, 1, 0), (7, 1, 0), (8, 1, 0)] if rows else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= {r[0] for r in docs} and (bool(out) == bool(docs))
    at = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert at.get(r["sequence_id"], 0) == r["offset"]
        at[r["sequence_id"]] = r["offset"] + r["length"]


def check_pieces_of_copies(rows, before, library):
    got = Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows)
    want = Counter()
    for r in before:
        ids = library(r["text"]) + [0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        want.update((r["doc_id"], k, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert got == want
