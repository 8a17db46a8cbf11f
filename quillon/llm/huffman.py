"""Canonical length-limited Huffman codes over token ids, and self-contained blocks of coded documents.

Block layout, little-endian: magic ``QHB1``, documents u32, ids u32, lane u32, code bits u64; per document its id i64,
a byte that is 1 where that id is null, and its number of ids u32; for every ``lane`` ids the bit offset where they
start (a checkpoint: decoding can begin at any of them), u32, or u64 in a block of 2^32 code bits and more; the codes,
most significant bit first.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

MAGIC, HEAD = b"QHB1", struct.Struct("<4sIIIQ")
LANE = 128
LIMIT = 20


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths (0: unused) of an optimal prefix code of at most ``limit`` bits, by package-merge."""
    counts = np.asarray(counts, dtype=np.int64)
    out = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    row, leaf_rows = leaves, [np.ones(len(leaves), dtype=bool)]
    for _ in range(limit - 1):
        half = len(row) // 2 * 2
        packages = row[0:half:2] + row[1:half:2]
        both = np.concatenate([leaves, packages])
        kind = np.concatenate([np.ones(len(leaves), dtype=bool), np.zeros(len(packages), dtype=bool)])
        by = np.argsort(both, kind="stable")
        row = both[by]
        leaf_rows.append(kind[by])
    take, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), dtype=np.uint8)
    for kind in reversed(leaf_rows):
        n_leaves = int(kind[:take].sum())
        lengths[:n_leaves] += 1
        take = 2 * (take - n_leaves)
    out[order] = lengths
    return out


@dataclass
class Code:
    """A canonical code: by length, then id, code words count up."""

    lengths: np.ndarray

    def __post_init__(self):
        lengths = self.lengths.astype(np.int64)
        self.bits = max(1, int(lengths.max(initial=0)))
        symbols = np.flatnonzero(lengths)
        order = symbols[np.lexsort((symbols, lengths[symbols]))]
        spans = np.left_shift(1, self.bits - lengths[order])
        starts = np.concatenate([[0], np.cumsum(spans)])[:-1] if len(order) else np.zeros(0, dtype=np.int64)
        self.words = np.zeros(len(lengths), dtype=np.uint64)
        self.words[order] = (starts >> (self.bits - lengths[order])).astype(np.uint64)
        self.sizes = lengths
        self.symbol_of = np.zeros(1 << self.bits, dtype=np.uint32)
        self.size_of = np.zeros(1 << self.bits, dtype=np.int64)
        full = int(spans.sum())
        self.symbol_of[:full] = np.repeat(order, spans)
        self.size_of[:full] = np.repeat(lengths[order], spans)


def pack_bits(words: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code words one after another, and the bit where each starts."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return b"", ends
    starts = ends - sizes
    cells = np.zeros((int(ends[-1]) >> 6) + 2, dtype=np.uint64)
    at, shift = starts >> 6, (starts & 63)
    room = 64 - shift
    over = sizes > room
    left = np.where(over, 0, room - sizes).astype(np.uint64)
    cut = np.where(over, sizes - room, 0).astype(np.uint64)
    high = np.left_shift(np.right_shift(words, cut), left)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    cells[at[first]] |= np.bitwise_or.reduceat(high, first)
    spill = np.flatnonzero(over)  # at most one code word runs on into each next cell
    cells[at[spill] + 1] |= np.left_shift(words[spill], np.uint64(64) - cut[spill])
    return cells.astype(">u8").tobytes()[: (int(ends[-1]) + 7) >> 3], starts


def _checkpoint(bits: int) -> str:
    return "<u8" if bits >> 32 else "<u4"


def encode_block(code: Code, ids: list[int | None], texts: list[np.ndarray], lane: int = LANE) -> bytes:
    """``texts``: the token ids of each document."""
    tokens = np.concatenate(texts) if texts else np.zeros(0, dtype=np.int64)
    payload, starts = pack_bits(code.words[tokens], code.sizes[tokens])
    bits = int(code.sizes[tokens].sum())
    return b"".join([
        HEAD.pack(MAGIC, len(ids), len(tokens), lane, bits),
        np.array([0 if i is None else i for i in ids], dtype="<i8").tobytes(),
        np.array([i is None for i in ids], dtype="u1").tobytes(),
        np.array([len(t) for t in texts], dtype="<u4").tobytes(),
        starts[::lane].astype(_checkpoint(bits)).tobytes(),
        payload,
    ])


def decode_block(code: Code, block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids a document, and all token ids (u32) of a block; all lanes are decoded side by side."""
    magic, n_docs, n_ids, lane, bits = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    at = HEAD.size
    docs = np.frombuffer(block, "<i8", n_docs, at)
    nulls = np.frombuffer(block, "u1", n_docs, at := at + 8 * n_docs)
    sizes = np.frombuffer(block, "<u4", n_docs, at := at + n_docs).astype(np.int64)
    lanes = (n_ids + lane - 1) // lane
    cell = _checkpoint(bits)
    pos = np.frombuffer(block, cell, lanes, at := at + 4 * n_docs).astype(np.int64)
    raw = np.frombuffer(block + bytes(4 + (lane * code.bits + 7) // 8), "u1", offset=at + int(cell[-1]) * lanes).astype(np.uint32)
    if len(raw) < (bits + 7) // 8:
        raise ValueError("the block is cut short")
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    out = np.empty((lane, lanes), dtype=np.uint32)
    down = np.uint32(32 - code.bits)
    for step in range(lane if lanes else 0):
        seen = (window[pos >> 3] << (pos & 7).astype(np.uint32)) >> down
        out[step] = code.symbol_of[seen]
        pos += code.size_of[seen]
    return [None if n else int(d) for d, n in zip(docs, nulls, strict=True)], sizes, out.T.reshape(-1)[:n_ids]
