"""Which tokens of two tokenizers stand for the same bytes, and how often over a corpus (operator 13)."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import new_path, pick, save
from .tokens import WHITE, _byte_letters, default_tokenizer

#: The mark that stands for a space in pieces (fixed value).
MARK = "▁"
#: Links that a task holds before it sums them up, keys of one count shard, links that are looked up at once.
HELD, SHARD, AT_ONCE = 1 << 22, 1 << 22, 1 << 20
#: Units that a worker remembers.
KNOWN = 100_000


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Aligns space + text by a byte-level BPE tokenizer (A) with text by a SentencePiece model that adds the space (B).

    Both tokenizers end a token before a space or line end that follows other than white space, if no piece of B runs
    over such a place (looked up in its vocabulary). Texts are cut there, each distinct unit is encoded once a worker, and a
    document's ids are those of its units. Tokenizers without that property get whole texts. Where tokens end is marked
    along a text's bytes: between two marks lies one link, and where both tokenizers have one a group ends.
    """

    def __init__(self, a_path: str, b_path: str, most: int = KNOWN):
        import sentencepiece
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            told = json.load(f)
        pre = told.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or told["model"]["type"] != "BPE":
            raise ValueError("the first tokenizer has to be a byte-level BPE")
        self.a = Tokenizer.from_str(json.dumps(told | {"added_tokens": []}))  # strings of special tokens are plain text
        byte_of = {c: b for b, c in _byte_letters().items()}
        self.a_bytes = [b""] * (max(told["model"]["vocab"].values()) + 1)
        for token, i in told["model"]["vocab"].items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        inner = [p for i, p in enumerate(pieces) if len(p) > 1 and not self.b.is_byte(i)]
        plain = not told.get("normalizer") and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.cuts = plain and self.b.encode("a  b\n", out_type=str)[-1] == "<0x0A>" and not any("\n" in p or any(x != MARK and y == MARK for x, y in zip(p, p[1:], strict=False)) for p in inner)
        other = WHITE.replace(" ", "").replace("\n", "")
        self.unit = regex.compile(f"[ \\n][{WHITE}]*[^{WHITE}]*(?:[{other}][{WHITE}]*[^{WHITE}]*)*")
        self.lengths = np.array([len(x) for x in self.a_bytes]), np.array([len(x) for x in self.b_bytes])
        # how an id is written inside a group's side and at its end
        self.written = [b"%d%s" % (i, sign) for side, ends in ((self.a_bytes, (b",", b"|")), (self.b_bytes, (b",", b";"))) for sign in ends for i in range(len(side))]
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.old, self.most = self.known, most

    def _encode(self, units: list[str]) -> Iterator[tuple[str, tuple[bytes, bytes] | None]]:
        """Packed ids of pieces of space + text that start with a space or a line end; None where their bytes aren't the piece's."""
        a = [self.a.encode(u, add_special_tokens=False).ids for u in units]
        b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for u, x, y in zip(units, a, b, strict=True):
            if u[0] != " ":
                y = y[1:]  # the space that the model adds
            raw = u.encode("utf-8", "surrogatepass")
            same = b"".join([self.a_bytes[i] for i in x]) == raw == b"".join([self.b_bytes[i] for i in y])
            yield u, (struct.pack(f"<{len(x)}I", *x), struct.pack(f"<{len(y)}I", *y)) if same else None

    def ids(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """A's and B's packed ids of each text; nothing for null, empty and unlike texts."""
        if len(self.known) > self.most:
            self.known, self.old = {}, self.known
        known, old, large = self.known, self.old, {}
        cut = [[] if not t or MARK in t else self.unit.findall(" " + t) if self.cuts else [" " + t] for t in texts]
        missing = set()
        for units in cut:
            missing.update([u for u in units if u not in known])
        new = []
        for u in missing:
            if u in old:
                known[u] = old[u]
            else:
                new.append(u)
        for u, found in self._encode(new):
            (known if len(u) <= 48 else large)[u] = found
        for text, units in zip(texts, cut, strict=True):
            parts = [known[u] if len(u) <= 48 else large[u] for u in units]
            if None in parts:
                parts = [next(self._encode([" " + text]))[1]]
            yield (b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])) if parts and parts[0] is not None else (b"", b"")

    def align(self, a: bytes, b: bytes) -> tuple[np.ndarray, int, bytes]:
        """The packed links of two equal texts' ids, their number of groups, and the groups written out."""
        if not a:
            return np.zeros(0, np.int64), 0, b""
        a_ids, b_ids = np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(b, "<u4").astype(np.int64)
        a_last, b_last = np.cumsum(self.lengths[0][a_ids]) - 1, np.cumsum(self.lengths[1][b_ids]) - 1
        ends_a, ends_b = np.zeros((2, a_last[-1] + 1), bool)
        ends_a[a_last] = ends_b[b_last] = True
        marks = np.flatnonzero(ends_a | ends_b)
        of_a, of_b, at_both = ends_a[marks], ends_b[marks], ends_a[marks] & ends_b[marks]
        which_a, which_b, group = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b, np.cumsum(at_both) - at_both
        links = b_ids[which_b] << 32 | a_ids[which_a]
        group_a, group_b = group[of_a], group[of_b]  # of each token, in order
        n = int(group[-1]) + 1
        before_b = np.r_[0, np.cumsum(np.bincount(group_b, minlength=n))]
        upto_a = np.cumsum(np.bincount(group_a, minlength=n))
        order = np.empty(len(a_ids) + len(b_ids), np.int64)
        sizes = len(self.a_bytes), len(self.b_bytes)
        order[np.arange(len(a_ids)) + before_b[group_a]] = a_ids + sizes[0] * at_both[of_a]
        order[np.arange(len(b_ids)) + upto_a[group_b]] = 2 * sizes[0] + b_ids + sizes[1] * at_both[of_b]
        return links, n, b"".join([self.written[i] for i in order.tolist()])[:-1]


@lru_cache(maxsize=2)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, b binary, a binary, n binary"


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (``digest``: its SHA-256) and the document's distinct id pairs.

    ``b``, ``a`` and ``n`` hold little-endian unsigned 32-bit numbers, one for each distinct pair: its two ids, and how many links
    of the document have it, in the order of the packed keys. Null and empty texts, and texts whose tokens don't give back their
    bytes, have no tokens: zeros and ''.
    """
    a_path, b_path = a_path or default_tokenizer(), b_path or default_pieces()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = _aligner(a_path, b_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                numbers, groups, pairs = [], [], []
                for ids in aligned.ids(part.column(1).to_pylist()):
                    links, n_groups, said = aligned.align(*ids)
                    numbers.append((len(ids[0]) // 4, len(ids[1]) // 4, n_groups, len(links)))
                    groups.append(hashlib.sha256(said).hexdigest() if digest and said else said.decode())
                    keys, n = np.unique(links, return_counts=True)
                    pairs.append(((keys >> 32).astype("<u4").tobytes(), keys.astype("<u4").tobytes(), n.astype("<u4").tobytes()))
                told = {c: pa.array([x[i] for x in numbers], pa.int64()) for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
                yield pa.record_batch({"doc_id": part.column(0).cast(pa.int64())} | told | {"groups": pa.array(groups, pa.string())} | {c: pa.array([x[i] for x in pairs], pa.binary()) for i, c in enumerate("ban")})

    return pick(docs, "doc_id", "text").mapInArrow(rows, _ALIGNED)


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed keys, their numbers, and each row's number of them, of columns b, a, n."""
    b, a, n = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), "<u4").astype(np.int64) for c in "ban")
    sizes = np.array([len(x) // 4 for x in batch.column(batch.schema.get_field_index("b")).to_pylist()], np.int64)
    return b << 32 | a, n, sizes


def _summed(keys: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their sums."""
    found, which = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, which, np.concatenate([np.zeros(0, np.int64), *numbers]))
    return found, total


def partial_counts(aligned: DataFrame) -> DataFrame:
    """key, n: the distinct packed pairs of each partition with their links (more than once where a partition has very many)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, held = [], [], 0
        for batch in batches:
            k, n, _ = _keys(batch)
            keys, numbers, held = [*keys, k], [*numbers, n], held + len(k)
            if held > HELD:
                k, n = _summed(keys, numbers)
                keys, numbers, held = [k], [n], len(k)
                if held > HELD // 2:
                    yield pa.record_batch({"key": pa.array(k), "n": pa.array(n)})
                    keys, numbers, held = [], [], 0
        k, n = _summed(keys, numbers)
        yield pa.record_batch({"key": pa.array(k), "n": pa.array(n)})

    return aligned.select("b", "a", "n").mapInArrow(rows, "key long, n long")


def write_counts(partial: DataFrame, path: str) -> list[tuple[str, int, bytes, bytes]]:
    """Sorts partial counts by ranges of keys over all tasks and writes their sums as sorted shards of two 64-bit rows.

    Returns, in ascending order, each shard's file, its first key, and the second ids in it with their highest count: a row a
    shard. A file's name has the attempt that wrote it, so a task that is run again disturbs nothing.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = fs.FileSystem.from_uri(path)
        store.create_dir(where, recursive=True)
        attempt = TaskContext.get().taskAttemptId()

        def shard(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            name = f"{keys[0]:016x}-{attempt}.counts"
            with store.open_output_stream(f"{where}/{name}") as out:
                out.write(keys.astype("<i8").tobytes() + sums.astype("<i8").tobytes())
            ids = keys >> 32
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            best = np.maximum.reduceat(sums, starts)
            return pa.record_batch({"file": pa.array([name]), "first": pa.array([int(keys[0])]), "ids": pa.array([ids[starts].astype("<i8").tobytes()], pa.binary()), "best": pa.array([best.astype("<i8").tobytes()], pa.binary())})

        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            k, n = (batch.column(i).to_numpy() for i in (0, 1))
            k, n = np.r_[keys, k], np.r_[sums, n]
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]][: len(k)])  # runs of equal keys in sorted rows
            keys, sums = (k[starts], np.add.reduceat(n, starts)) if len(k) else (k, n)
            if len(keys) > SHARD:  # the last key may go on in the next batch
                yield shard(keys[:-1], sums[:-1])
                keys, sums = keys[-1:], sums[-1:]
        if len(keys):
            yield shard(keys, sums)

    partial = save(partial, "pair-partials")  # a range exchange reads its input twice
    ordered = partial.repartitionByRange("key").sortWithinPartitions("key")
    found = ordered.mapInArrow(rows, "file string, first long, ids binary, best binary").collect()
    return sorted(((r["file"], r["first"], bytes(r["ids"]), bytes(r["best"])) for r in found), key=lambda r: r[1])


class CountShards:
    """The corpus-wide counts of packed keys, looked up in sorted shards that are mapped into memory, not read.

    Where the shared folder is no file system that the machine mounts, a shard is fetched when it is asked and one at a time held.
    """

    def __init__(self, path: str, files: list[tuple[str, int]]):
        self.store, self.where = fs.FileSystem.from_uri(path)
        self.files, self.firsts = [f for f, _ in files], np.array([k for _, k in files], np.int64)
        self.opened: dict[int, np.ndarray] = {}

    def _shard(self, i: int) -> np.ndarray:
        if i not in self.opened:
            name = f"{self.where}/{self.files[i]}"
            if isinstance(self.store, fs.LocalFileSystem):
                self.opened[i] = np.memmap(name, "<i8", "r").reshape(2, -1)
            else:
                with self.store.open_input_file(name) as f:
                    self.opened = {i: np.frombuffer(f.read(), "<i8").reshape(2, -1)}
        return self.opened[i]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Counts of ascending keys."""
        out = np.zeros(len(keys), np.int64)
        bounds = np.r_[np.searchsorted(keys, self.firsts), len(keys)]
        for i in range(len(self.files)):
            a, b = bounds[i], bounds[i + 1]
            if a < b:
                held, counts = self._shard(i)
                at = np.minimum(np.searchsorted(held, keys[a:b]), len(held) - 1)
                out[a:b] = np.where(held[at] == keys[a:b], counts[at], 0)
        return out


def cross_tokenizer(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Each document's alignment, and how common its links are: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts are encoded once; their distinct pairs are saved, counted per partition, sorted by ranges of packed keys (the second
    id in the upper half) and summed along runs. Lookups map the sorted shards, so no document's links are shuffled. What
    comes to the driver and goes to the tasks is a row a shard and one count for each id of the second vocabulary.

    ``n_best``: links whose pair has the highest count of its second id, ties included; ``count_sum``: the counts of all links.
    Each row counts by itself, repeated and null doc_ids included; null and empty texts, and texts whose tokens don't give back
    their bytes, have zeros and ''; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    table = save(align(docs, a_path, b_path, digest=True), "aligned")
    path = new_path(spark, "pair-counts")
    shards = write_counts(partial_counts(table), path)
    files = [(f, first) for f, first, _, _ in shards]
    best = np.zeros(1 + max((int(np.frombuffer(ids, "<i8").max()) for _, _, ids, _ in shards), default=0), np.int64)
    for _, _, ids, counts in shards:
        np.maximum.at(best, np.frombuffer(ids, "<i8"), np.frombuffer(counts, "<i8"))
    best_bytes = best.tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, most = CountShards(path, files), np.frombuffer(best_bytes, np.int64)
        for batch in batches:
            ends = np.cumsum([len(x) // 4 for x in batch.column(batch.schema.get_field_index("b")).to_pylist()])
            at = 0
            while at < batch.num_rows:  # some rows at a time, a long document by itself
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE)))
                part = batch.slice(at, stop - at)
                keys, n, sizes = _keys(part)
                asked, which = np.unique(keys, return_inverse=True)
                count = counts(asked)
                top = (count == most[asked >> 32])[which]
                edges = np.r_[0, np.cumsum(sizes)]
                upto = lambda x: np.diff(np.r_[0, np.cumsum(x)][edges])  # noqa: B023, E731
                columns = {c: part.column(part.schema.get_field_index(c)) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
                yield pa.record_batch(columns | {"n_best": pa.array(upto(np.where(top, n, 0))), "count_sum": pa.array(upto(count[which] * n)), "groups_sha256": part.column(part.schema.get_field_index("groups"))})
                at = stop

    return table.mapInArrow(rows, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
