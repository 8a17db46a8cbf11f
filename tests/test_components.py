"""Strong components: against a plain closure, in few rounds whatever the length of a circle."""

import random

from quillon.operators import paths


def plain(edges):
    ids = sorted({x for e in edges for x in e})
    after = {i: {b for a, b in edges if a == i} for i in ids}
    for k in ids:
        for i in ids:
            if k in after[i]:
                after[i] = after[i] | after[k]
    return {(i, min(m), len(m)) for i in ids if len(m := {j for j in ids if j in after[i] and i in after[j]} | {i}) > 1}


def test_long_circles_take_few_rounds(spark, monkeypatch):
    kind, rounds, measured = random.Random(7), [], paths.save_measured
    monkeypatch.setattr(paths, "save_measured", lambda *a, **kw: rounds.append(1) or measured(*a, **kw))
    edges = {(f"n{kind.randrange(40):02d}", f"n{kind.randrange(40):02d}") for _ in range(46)}
    order = kind.sample(range(48), 48)
    edges |= {(f"r{a:02d}", f"r{b:02d}") for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    got = paths.strong_components(spark.createDataFrame(sorted(edges), "src string, dst string")).collect()
    assert {tuple(r) for r in got} == plain({(a, b) for a, b in edges if a != b}) and len(got) == len({r["id"] for r in got})
    assert len(rounds) < 40


def test_no_circles(spark):
    edges = spark.createDataFrame([(f"p{i:02d}", f"p{i + 1:02d}") for i in range(20)], "src string, dst string")
    assert paths.strong_components(edges).collect() == []
