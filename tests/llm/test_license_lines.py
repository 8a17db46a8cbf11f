"""Every known licence text is found as a line of a document, whatever words it has."""

from importlib.metadata import distributions
from pathlib import Path

from pyspark.sql import functions as F

from quillon.llm import licenses


def installed_texts():
    """(name of a known licence, text) of licence files on this machine whose canonical digest is in the table."""
    known = dict((digest, name) for name, digest in licenses.FULL_TEXTS)
    files = [*Path("/usr/share/common-licenses").glob("*")]
    for d in distributions():
        files += [Path(f.locate()) for f in d.files or () if "licen" in f.name.lower() or "copying" in f.name.lower()]
    for f in files:
        if f.is_file():
            text = f.read_text("utf-8", "replace")
            if name := known.get(licenses.digest_text(text)):
                yield name, text


def test_every_known_text_has_a_hint():
    for _, text in licenses.KNOWN:
        assert any(h in text.lower() for h in licenses.HINTS)
    for name, text in installed_texts():
        assert any(h in text.lower() for h in licenses.HINTS), name


def test_known_texts_are_found_as_lines(spark):
    texts = [(name, " ".join(text.split())) for name, text in licenses.KNOWN]
    texts += [(name, " ".join(licenses.canonical_text(text).split())) for name, text in installed_texts()]
    rows = [(i, f"some words before\n{text}\nand after") for i, (_, text) in enumerate(texts)]
    got = {r["doc_id"]: (r["n_notices"], r["notices"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (1, name) for i, (name, _) in enumerate(texts)}


def test_whole_texts_and_lines_agree(spark):
    name, text = next((n, t) for n, t in licenses.KNOWN if n == "Unlicense")
    df = spark.createDataFrame([(1, text), (2, " ".join(text.split()))], "doc_id long, text string")
    assert {r["license"] for r in licenses.scan(df).collect()} == {name}
    assert licenses.scan(df).filter(F.col("doc_id") == 2).first()["n_notices"] == 1
