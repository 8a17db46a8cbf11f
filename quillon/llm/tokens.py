"""Token ids of whole texts by a public byte-level BPE tokenizer, with word-wise reuse of what has been encoded before."""

from __future__ import annotations

import json
import struct

import regex
from tokenizers import Tokenizer

#: White space as Unicode and the tokenizers' pattern have it (fixed values).
WHITE = " \t\n\r\x0b\x0c\x85\xa0  -     　"
#: The public byte-level BPE pre-tokenization pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The public byte-to-letter table of byte-level BPE: printable bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Signs that are a piece of their own behind a word.
PUNCTUATION = frozenset(".,;:!?")

#: Up to this letter the library's tables and Python's agree on what a letter is.
LATIN = "\u024f"

#: The letter that stands for a space (fixed value of byte-level BPE).
SPACE = "\u0120"


#: For few ids, what packs that many.
PACKERS = [struct.Struct(f"<{n}I").pack for n in range(16)]


class _Bare(dict):
    """Piece -> packed ids, within the same bound."""

    def __init__(self, owner: TextEncoder, most: int):
        super().__init__()
        self.owner, self.most = owner, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self.owner.piece(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class _Unsplittable(Exception):
    """Two white-space characters meet at a cut."""


class _Known(dict):
    """Word -> packed ids of " word". A miss is encoded; what is beyond ``most`` entries moves to an older half that fades."""

    def __init__(self, owner: TextEncoder, most: int):
        super().__init__()
        self.owner, self.most, self.old = owner, most, {}

    def __missing__(self, word: str) -> bytes:
        if (ids := self.old.get(word)) is None:
            ids = self.ids(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def ids(self, word: str) -> bytes:
        owner = self.owner
        if word.isalpha():
            if word.isascii():
                return owner.ascii(SPACE + word)
            return owner.piece(" " + word) if max(word) <= LATIN else owner.pieces(" " + word)
        if word[:1] == "\n":  # a line's first word, with the line's end before it
            rest = word[1:]
            if rest and (rest[0] in owner.white or rest[-1] in owner.white):
                raise _Unsplittable
            return owner.newline + (owner.pieces(rest) if rest else b"")
        if not word or word[0] in owner.white or word[-1] in owner.white:
            raise _Unsplittable
        if word[-1] in PUNCTUATION and (bare := word[:-1]).isalpha() and (word.isascii() or max(word) <= LATIN):
            return self[bare] + owner.bare[word[-1]]
        return owner.pieces(" " + word)


class TextEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as ``Tokenizer.encode(text, add_special_tokens=False)`` would.

    A byte-level BPE tokenizer never merges across the start of a single space between two words, so such a text is the
    concatenation of its space-led words, and each distinct word goes to the library's model once. A line's end between
    two words is a piece of its own, and so are two of them. Texts in which white space meets white space in another way
    are cut before each run of it. Any other kind of tokenizer gets whole texts. Strings of special tokens become those
    tokens, as the library has it unless told otherwise.
    """

    def __init__(self, path: str, most: int = 250_000):
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: struct.pack("<I", i) for i, t in added.items()}
        plain = not any(t.lstrip or t.rstrip or t.single_word for t in added.values())
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        told = json.loads(self.tokenizer.to_str())
        pre, model = told.get("pre_tokenizer") or {}, told.get("model") or {}
        self.byte_level = (
            plain and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not told.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout")
            and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        )
        self.model = self.tokenizer.model
        self.pattern = regex.compile(PATTERN)
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.units = regex.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.white = frozenset(c for c in map(chr, range(0x3001)) if regex.fullmatch(f"[{WHITE}]", c))
        self.newline = self.piece("\n") if self.byte_level else b""
        self.known, self.bare = _Known(self, most), _Bare(self, most // 4)
        self.vocabulary = self.tokenizer.get_vocab_size()

    def piece(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        return self.ascii(piece.encode().decode("latin-1").translate(self.letters))

    def ascii(self, letters: str) -> bytes:
        """Ids of one pre-token that is given in the letters of byte-level BPE."""
        ids = [t.id for t in self.model.tokenize(letters)]
        return PACKERS[len(ids)](*ids) if len(ids) < len(PACKERS) else struct.pack(f"<{len(ids)}I", *ids)

    def pieces(self, text: str) -> bytes:
        """Ids of a run of pre-tokens."""
        if max(text) > LATIN:  # the library's own tables decide on letters of other scripts
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        known, bare = self.known, self.bare
        return b"".join([known[p[1:]] if p[0] == " " and p[1:].isalpha() else bare[p] for p in self.pattern.findall(text)])

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.byte_level:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if self.cut and self.cut.search(text):
            return b"".join([self.special.get(part) or self.plain(part) for part in self.cut.split(text) if part])
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """Ids of a text without strings of special tokens."""
        known = self.known
        words = text.replace("\n", " \n").split(" ")
        try:
            if "\n\n" in text and ("\n\n\n" in text or "\n\n " in text or text.endswith("\n\n")):
                raise _Unsplittable
            first = b""
            if text[0] != "\n":
                if not words[0] or words[0][0] in self.white or words[0][-1] in self.white:
                    raise _Unsplittable
                first = self.pieces(words[0])
            return first + b"".join([known[w] for w in words[1:]])
        except _Unsplittable:
            return b"".join(
                known[u[1:]] if u[0] == " " and len(u) > 1 and u[1] not in self.white and u[-1] not in self.white else self.pieces(u)
                for u in self.units.findall(text)
            )


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder a Python worker, so that later tasks find its words again."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
