"""Operators 11 to 13 against plain versions, and on odd rows."""

import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import alignment, line_dedup, painting, queries
from quillon.llm.cuckoo import CuckooFilter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# --- cuckoo filters -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("expected, n", [(10, 10), (1000, 1000), (50, 5000)])
def test_cuckoo_filter_has_what_was_added_and_forgets_what_was_removed(expected, n):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, (2, n))
    f = CuckooFilter(expected)
    f.add(*keys)
    assert f.has(*keys).all()
    f = CuckooFilter.load(*f.dump())
    assert f.has(*keys).all()
    f.remove(keys[0][: n // 2], keys[1][: n // 2])
    assert f.has(keys[0][n // 2 :], keys[1][n // 2 :]).all()
    assert (f.tables != 0).sum() == n - n // 2
    others = rng.integers(-(2**63), 2**63 - 1, (2, 20_000))
    assert f.has(*others).mean() < 0.002 * len(f.tables)


def test_cuckoo_filter_keeps_repeated_entries_apart():
    f = CuckooFilter(4)
    one = np.full(20, 7 << 20), np.full(20, 9 << 48)
    f.add(*one)
    f.remove(*(x[:19] for x in one))
    assert f.has(*(x[:1] for x in one)).all()
    f.remove(*(x[:1] for x in one))
    assert not f.has(*(x[:1] for x in one)).any()


# --- line dedup -----------------------------------------------------------------------------------------------------


def plain_lines(docs, least=3):
    """doc_id, n_lines, n_dropped, kept of each row, one after another."""
    rank = lambda d: -(2**63) if d is None else d
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(list)
    for doc, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 20:
                holders[k].append(rank(doc))
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < least or rank(doc) == max(holders[key(x)])]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


ODD_LINES = [
    (1, "The same long line, all over the place\nshort\nshort\nonce only in this text, nowhere else"),
    (2, "  THE SAME LONG LINE, ALL OVER THE PLACE\t\nshort"),
    (3, "\x0bthe same long line, all over the place\r\nthe same long line, all over the place"),
    (4, None), (5, ""), (6, "\n\n\n"), (None, "the same long line, all over the place\nÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ"), (7, "ÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ"), (8, "ééééééééééééééééééé"),
    (8, "ÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ"), (9, "nineteen characters\nnineteen characters"), (10, "nineteen characters"), (11, "nineteen characters"), (12, "x" * 600_000), (13, "x" * 600_000 + "\n" + "X" * 600_000), (13, "x" * 600_000),
]


def test_line_dedup_of_odd_rows(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in ODD_LINES], "doc_id long, text string, k1 int, of string, Text string")
    spark.conf.set("spark.sql.caseSensitive", "false")
    got = line_dedup.line_dedup(docs).collect()
    assert sorted(map(tuple, got), key=str) == plain_lines(ODD_LINES)
    assert line_dedup.line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_line_index_is_reversible(spark):
    rng = random.Random(3)
    pool = [f"a line that many documents may share, number {i}" for i in range(12)]
    docs = [(i, "\n".join([*rng.choices(pool, k=3), f"a line that this document alone has, {i}"])) for i in range(40)]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    ids = lambda rows: spark.createDataFrame([(i,) for i in rows], "doc_id long")
    index = line_dedup.LineIndex(spark, shards=64)
    said = lambda rows: sorted(map(tuple, index.deduplicate(make(rows)).collect()), key=str)
    index.insert(make(docs[:15]))
    assert said(docs[:15]) == plain_lines(docs[:15])
    index.insert(make(docs[15:]))
    assert said(docs) == plain_lines(docs)
    gone = [39, 38, 20, 3, 999]
    index.delete(ids(gone))
    left = [d for d in docs if d[0] not in gone]
    index = line_dedup.LineIndex.open(spark, index.path)
    assert said(left) == plain_lines(left)
    counted = Counter(k for _, t in left for k in set(t.split("\n")))
    assert sorted(r["n_docs"] for r in index.references().collect()) == sorted(counted.values())
    index.insert(make([d for d in docs if d[0] in gone]))
    assert said(docs) == plain_lines(docs)
    held = {r["shard"]: CuckooFilter.load(r["tables"], r["buckets"]) for r in spark.read.parquet(f"{index.path}/filters/3").collect()}
    assert sum(int((f.tables != 0).sum()) for f in held.values()) == index.references().count()
    index.delete(ids(range(40)))
    assert index.references().count() == 0
    last = [CuckooFilter.load(r["tables"], r["buckets"]) for r in spark.read.parquet(f"{index.path}/filters/4").collect()]
    assert not any(f.tables.any() for f in last)


def test_a_batch_without_its_log_row_never_happened(spark):
    docs = [(i, "the one line that all of these documents share") for i in range(3)]
    index = line_dedup.LineIndex(spark)
    index.insert(spark.createDataFrame(docs[:2], "doc_id long, text string"))
    index._finish, finish = (lambda kind: None), index._finish
    index.insert(spark.createDataFrame(docs[2:], "doc_id long, text string"))
    again = line_dedup.LineIndex.open(spark, index.path)
    assert [r["n_docs"] for r in again.references().collect()] == [2]
    again.insert(spark.createDataFrame(docs[2:], "doc_id long, text string"))
    assert [r["n_docs"] for r in again.references().collect()] == [3]
    assert finish is not None


# --- interval painting ----------------------------------------------------------------------------------------------


def plain_changes(rows, batches):
    """The changes of (group, item, value, begin, stop) rows, batch by batch."""
    out, groups = [], {r[0] for r in rows}
    for g in groups:
        old = (0, 0, 0, None, None, None)
        for t in range(batches):
            there = [r for r in rows if r[0] == g and r[3] is not None and r[4] is not None and r[3] <= t < r[4]]
            v = sorted(r[2] for r in there if r[2] is not None)
            new = (len(there), len({r[1] for r in there if r[1] is not None}), sum(v), v[0] if v else None, v[-1] if v else None, v[len(v) // 2] if v else None)
            if new != old:
                out.append((t, g, *(x for pair in zip(old, new, strict=True) for x in pair)))
            old = new
    return sorted(out, key=str)


@settings(deadline=None, max_examples=40)
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(0, 9), st.integers(0, 9)), max_size=20))
def test_paint_and_fenwick_against_plain(rows):
    rows = [(v, min(a, b), max(a, b)) for v, a, b in rows]
    v, a, b = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    low, painted = painting.paint(v, a, b, 10)
    high, _ = painting.paint(v, a, b, 10, down=True)
    there = [sorted(x for x, p, q in rows if p <= t < q) for t in range(10)]
    assert [(x[0], x[-1]) if x else None for x in there] == [(low[t], high[t]) if painted[t] else None for t in range(10)]
    asked = [(t, len(x) // 2 + 1) for t, x in enumerate(there) if x]
    if asked:
        found = painting.fenwick_select(np.r_[v, v], np.r_[a, b], np.r_[np.ones_like(v), -np.ones_like(v)], asked)
        assert found == [there[t][k - 1] for t, k in asked]


@pytest.mark.parametrize("batches", [10, 150])
def test_aggregate_changes_against_plain(spark, batches):
    rng = random.Random(batches)
    rows = []
    for _ in range(400):
        a = rng.randrange(-3, batches + 3)
        rows.append((rng.choice(["a", "a", "a", "b", "c"]), rng.choice([None, "p", "q", "r", "s"]), rng.choice([None, *range(-40, 40)]), rng.choice([a, a, a, None]), a + rng.randrange(0, batches // 2)))
    rows += [("d", "p", None, 0, 5), ("e", None, 7, 4, 4), ("a", "p", 2**50, 1, 3), ("a", "p", 2**50, 1, 3), ("b", "q", -(2**50), 2, 7)]
    df = spark.createDataFrame(rows, "g string, item string, value long, begin int, stop int").withColumns({"block": F.lit(1), "batch": F.lit("x"), "d": F.lit(2)}).repartition(5)
    got = painting.aggregate_changes(df, ["g"], batches)
    assert sorted(map(tuple, got.collect()), key=str) == plain_changes(rows, batches)
    assert painting.aggregate_changes(df.limit(0), ["g"], batches).collect() == []


def test_many_groups_leave_a_task_in_parts(spark, monkeypatch):
    monkeypatch.setattr(painting, "HELD", 3)
    rows = [(f"g{i % 17}", f"t{i % 5}", i % 11, i % 6, i % 6 + i % 4) for i in range(300)]
    got = painting.aggregate_changes(spark.createDataFrame(rows, "g string, item string, value long, begin int, stop int").coalesce(1), ["g"], 8)
    assert sorted(map(tuple, got.collect()), key=str) == plain_changes(rows, 8)


def test_op12_on_documents_with_odd_rows(spark, tmp_path):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()][:120]
    docs += [(200_001, "x", None, None, None), (200_002, None, "", "", 5), (None, "lost", "en", "src0", 4), *docs[:5], (-7, "minus", "en", "src1", 5)]
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    rows = []
    for doc, text, lang, source, n in docs:
        if doc is not None:
            h = crc32(str(doc).encode())
            b, q = h % 50, h // 50 % 7
            rows.append(((source or "", lang or ""), text, n, b, b + q))
            if q % 3 == 0:
                rows.append(((source or "", lang or ""), text, None if n is None else n + q, b + q, 50))
    want = sorted(((t, *g, *x) for t, g, *x in plain_changes(rows, 50)), key=str)
    got = queries.op12_interval_painting(spark, str(tmp_path))
    assert got.columns[:5] == ["batch", "source", "lang", "old_n_rows", "new_n_rows"]
    assert sorted(map(tuple, got.collect()), key=str) == want


# --- alignment ------------------------------------------------------------------------------------------------------


def plain_alignment(texts):
    """Rows of op13 for (doc_id, text), with whole texts given to the libraries and links found pair by pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(alignment.default_tokenizer())
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    docs = []
    for doc, text in texts:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        a_raw = [bytes(letters[c] for c in tok.id_to_token(i)) for i in a]
        b_raw = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if text and not b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
            a, b, a_raw, b_raw = [], [], [], []
        ends = lambda raw: np.cumsum([len(x) for x in raw]).tolist()
        ae, be = ends(a_raw), ends(b_raw)
        common = sorted(set(ae) & set(be))
        groups = []
        for start, stop in zip([0, *common], common, strict=False):
            groups.append(",".join(str(i) for i, e in zip(a, ae, strict=True) if start < e <= stop) + "|" + ",".join(str(i) for i, e in zip(b, be, strict=True) if start < e <= stop))
        of_a = np.repeat(np.arange(len(a)), [len(x) for x in a_raw]).tolist()
        of_b = np.repeat(np.arange(len(b)), [len(x) for x in b_raw]).tolist()
        links = [(a[i], b[j]) for i, j in dict.fromkeys(zip(of_a, of_b, strict=True))]
        docs.append((doc, len(a), len(b), groups, links))
    count = Counter(link for *_, links in docs for link in links)
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return sorted(
        ((doc, n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for doc, n_a, n_b, groups, links in docs),
        key=str,
    )


ODD_TEXTS = [
    "plain words, and more: it's 1234 o'clock.", "two  spaces   three    four", "\n\nlines\nand\n\n\nmore \n lines\n", "tab\tand\r\nreturn;\r\n});\r\n", " leading", "trailing ", "trailing\n", "   ", "\n", "a", "é漢字 emoji 👩‍👩‍👧 ok",
    "<|endoftext|> stays <s> text </s> <unk> <0x41>", "mark ▁ in text", " no break　wide em  x", "naïve — “quoted” … ½ ²", "\x00nul\x07bell", "привет мир, שלום", "é combining", "x" * 3000, "lorem ipsum " * 400,
    "mixed \t\n  \r\n\r\n   end", "'s 've leading contractions", "foo(bar);\r\n\tbaz \r qux", None, "", "ﬁ ligature Ⅳ",
]


def test_alignment_of_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(3, "repeated id"), (None, "no id"), (0, ODD_TEXTS[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"a": F.lit(1), "n": F.lit("x"), "groups": F.lit(2)})
    assert sorted(map(tuple, alignment.cross_tokenizer(df).collect()), key=str) == plain_alignment(rows)
    assert alignment.cross_tokenizer(df.limit(0)).collect() == []
    assert alignment.cross_tokenizer(df.filter("text IS NULL OR text = ''")).select("n_a", "count_sum", "groups_sha256").distinct().collect() == [(0, 0, "")]


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet=st.sampled_from("ab,.'1 \n\t\r 　é▁漢;)}<>|"), max_size=40))
def test_units_are_aligned_as_whole_texts(text):
    own = alignment._aligner(alignment.default_tokenizer(), alignment.default_pieces())
    assert own.cuts
    want = next(own._encode([" " + text]))[1] if text else None
    assert list(own.ids([text, None, text])) == [want or (b"", b""), (b"", b""), want or (b"", b"")]


def test_op13_against_plain(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op13_token_alignment(spark, SF).collect()), key=str) == plain_alignment(rows)


def test_counts_over_many_shards(spark, monkeypatch):
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 300, 5000) << 32 | rng.integers(0, 40, 5000)
    df = spark.createDataFrame([(int(k), int(n)) for k, n in zip(keys, rng.integers(1, 9, 5000), strict=True)], "key long, n long").repartition(7)
    monkeypatch.setattr(alignment, "SHARD", 500)
    folder = f"{line_dedup.new_path(spark, 'counts-test')}"
    shards = alignment.write_counts(df, folder)
    want = Counter()
    for r in df.collect():
        want[r["key"]] += r["n"]
    firsts = [first for _, first, _, _ in shards]
    assert firsts == sorted(firsts)
    look = alignment.CountShards(folder, [(f, first) for f, first, _, _ in shards])
    asked = np.array(sorted([*want, 17 << 32 | 99, (1 << 50)]), np.int64)
    assert look(asked).tolist() == [want[int(k)] for k in asked]
    assert isinstance(look._shard(0).base, np.memmap) or isinstance(look._shard(0), np.memmap)
    best = Counter()
    for _, _, ids, counts in shards:
        for i, n in zip(np.frombuffer(ids, "<i8").tolist(), np.frombuffer(counts, "<i8").tolist(), strict=True):
            best[i] = max(best[i], n)
    assert best == {i: max(n for k, n in want.items() if k >> 32 == i) for i in {k >> 32 for k in want}}
    assert Path(folder.removeprefix("file://")).is_dir()
