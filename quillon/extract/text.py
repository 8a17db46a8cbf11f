"""Source text with comments and strings blanked out, and its matching brackets."""

from __future__ import annotations

import re
from bisect import bisect_right

from .syntax import Tokens

_RUST = re.compile(r"//[^\n]*|/\*|\bb?r(#*)\".*?\"\1|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\(?:x..|u\{[^}]*\}|.)|[^'\\\n])'", re.S)
_RUST_COMMENT = re.compile(r"/\*|\*/")
_BRACKET = re.compile(r"[(){}\[\]]")
_CLOSES = {")": "(", "}": "{", "]": "["}


#: A heading in capitals (a fixed pattern): no description.
_BANNER = re.compile(r"(?=.*[A-Z])[A-Z0-9 _\-—&/().]{1,48}")


def _blanked(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], re.sub(r"[^\n]", " ", text[a:b])]
        at = b
    return "".join([*out, text[at:]])


def _rust_spans(text: str) -> list[tuple[int, int]]:
    """Comments (which nest), strings, raw strings and characters; a lifetime's mark is code."""
    spans, at = [], 0
    while m := _RUST.search(text, at):
        end = m.end()
        if m[0] == "/*":
            depth = 1
            while depth and (c := _RUST_COMMENT.search(text, end)):
                depth, end = depth + (1 if c[0] == "/*" else -1), c.end()
            end = end if not depth else len(text)
        spans.append((m.start(), end))
        at = end
    return spans


def blank(source: str, rust: bool = False) -> str:
    """The same length and lines, with nothing in comments and strings."""
    return _blanked(source, _rust_spans(source) if rust else Tokens(source).blanks)


class Source:
    def __init__(self, text: str, rust: bool = False):
        self.text, self.code = text, blank(text, rust)
        self.ends: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        for m in _BRACKET.finditer(self.code):
            if m[0] in _CLOSES:
                while stack and stack[-1][0] != _CLOSES[m[0]]:
                    stack.pop()
                if stack:
                    self.ends[stack.pop()[1]] = m.start()
            else:
                stack.append((m[0], m.start()))
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def end(self, at: int) -> int:
        """Where the bracket at ``at`` closes (the text's end if it doesn't)."""
        return self.ends.get(at, len(self.code) - 1)

    def doc_before(self, at: int) -> str:
        """The text of the comment right above a position."""
        head = self.text[: self.starts[self.line(at) - 1]].rstrip()
        head = re.sub(r"(?:\s*#\[[^\n]*\])+$", "", head).rstrip()
        if head.endswith("*/"):
            lines = head[head.rfind("/*") :].strip("/*").split("\n")
        else:
            lines = []
            for line in reversed(head.split("\n")):
                if not line.strip().startswith("//"):
                    break
                lines.insert(0, re.sub(r"^\s*//[/!]?\s?", "", line))
        words = [w for w in (re.sub(r"^[\s*=\-_/#~]+|[\s*=\-_/#~]+$", "", x) for x in lines) if w and not w.startswith(("@", "eslint")) and not _BANNER.fullmatch(w)]
        out = " ".join(" ".join(words).split())
        return out if len(out) <= 280 else re.sub(r"\s+\S*$", "", out[:277]) + "…"
