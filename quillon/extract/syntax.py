"""Tokens of a TypeScript text and the functions, stores, registries and module links that they spell out."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<n>[A-Za-z_$#\u0080-\uffff][\w$]*)|(?P<d>\d[\w.]*)"
    r"|(?P<p>=>|\.\.\.|\?\.(?!\d)|\?\?=?|\*\*=?|[=!]==?|[<>]=|&&=?|\|\|=?|\+\+|--|[-+*/%&|^]=|.)",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
_CLOSES = {")": "(", "}": "{", "]": "["}
#: Words behind which an operand begins, and words that are no operand by themselves.
BEFORE_OPERAND = frozenset("return typeof case do else in of instanceof new delete void throw yield await default extends as satisfies keyof".split())
MODIFIERS = frozenset("public private protected static async override readonly abstract declare accessor export default".split())
CONTROL = frozenset("if for while switch catch with".split())
#: Functions that make stores, by name (fixed values).
STORE_FACTORIES = frozenset("writable readable derived writableLocal persisted tweened spring".split())


@dataclass
class Declared:
    short: str
    kind: str
    cls: str | None
    exported: bool
    start: int  # where the function, or the store's name, begins
    body: int  # where its body begins (its end, if it has none)
    stop: int  # its last character
    doc_at: int  # the statement or member that a comment would stand before


@dataclass
class Links:
    """What a module takes from others and gives to them."""

    imports: list[tuple[str, str, str]] = field(default_factory=list)  # local name, name there ('default', '*'), specifier
    exports: list[tuple[str, str | None, str]] = field(default_factory=list)  # name, specifier (None: own), name there


class Tokens:
    """The tokens of a text, with each bracket's partner; comments are left out, templates are cut at their code."""

    def __init__(self, text: str):
        self.text: list[str] = []
        self.kind: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.fresh: list[bool] = []  # whether a line ends before the token
        self.partner: dict[int, int] = {}
        self.blanks: list[tuple[int, int]] = []  # comments, strings, patterns, literal parts of templates
        opened: list[tuple[str, int]] = []
        at, fresh = 0, False

        def add(kind: str, a: int, b: int) -> None:
            nonlocal fresh
            self.kind.append(kind)
            self.text.append(text[a:b])
            self.start.append(a)
            self.end.append(b)
            self.fresh.append(fresh)
            fresh = False
            if kind in "sr":
                self.blanks.append((a, b))

        def template(a: int) -> int:
            i = a + 1
            while m := _TEMPLATE.search(text, i):
                i = m.end()
                if m[0] == "`":
                    add("s", a, i)
                    return i
                if m[0] == "${":
                    add("s", a, i - 2)
                    opened.append(("${", len(self.text)))
                    add("p", i - 2, i)
                    self.blanks.append((i - 2, i))
                    return i
            add("s", a, len(text))
            return len(text)

        while at < len(text):
            if text[at] == "/" and self._operand_next(fresh) and (m := _REGEX.match(text, at)):
                add("r", at, m.end())
                at = m.end()
                continue
            m = _TOKEN.match(text, at)
            kind, at = m.lastgroup, m.end()
            if kind in ("space", "comment"):
                fresh |= "\n" in m[0]
                if kind == "comment":
                    self.blanks.append(m.span())
            elif m[0] == "`":
                at = template(m.start())
            elif m[0] == "}" and opened and opened[-1][0] == "${":
                i = opened.pop()[1]
                self.partner[i], self.partner[len(self.text)] = len(self.text), i
                add("p", m.start(), at)
                at = template(m.start())
                self.start[-1] = m.end()
            else:
                if kind == "p" and m[0] in "([{":
                    opened.append((m[0], len(self.text)))
                elif kind == "p" and m[0] in _CLOSES:
                    while opened and opened[-1][0] != _CLOSES[m[0]] and opened[-1][0] != "${":
                        opened.pop()
                    if opened and opened[-1][0] == _CLOSES[m[0]]:
                        i = opened.pop()[1]
                        self.partner[i], self.partner[len(self.text)] = len(self.text), i
                add(kind, m.start(), at)
        self.n = len(self.text)
        for column, end in ((self.text, ""), (self.kind, "end"), (self.start, len(text)), (self.end, len(text)), (self.fresh, True)):
            column += [end] * 4  # looking ahead needs no check

    def _operand_next(self, fresh: bool) -> bool:
        """Whether a slash here begins a pattern."""
        if not self.text:
            return True
        kind, word = self.kind[-1], self.text[-1]
        if kind == "n":
            return word in BEFORE_OPERAND
        if word == ")":
            i = self.partner.get(len(self.text) - 1, 0)
            return i > 0 and self.text[i - 1] in CONTROL
        return kind == "p" and word not in ("]", "++", "--") and (word != "}" or fresh)

    def ends_operand(self, i: int) -> bool:
        kind, word = self.kind[i], self.text[i]
        return kind in "sdr" or (kind == "n" and word not in BEFORE_OPERAND) or word in (")", "]", "}", "++", "--", "!")

    def close(self, i: int) -> int:
        """The partner of the bracket ``i`` (the text's end if it has none)."""
        return self.partner.get(i, self.n - 1)

    def angle_end(self, i: int) -> int:
        """Behind the type arguments that ``i`` opens; ``i`` itself where they aren't any."""
        depth, j = 0, i
        while j < self.n:
            t = self.text[j]
            if t in ("(", "[", "{"):
                j = self.close(j)
            elif t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif t in (";", ")", "}", "&&", "||", "]"):
                return i
            j += 1
        return i

    def type_end(self, i: int) -> int:
        """Behind the type that begins at ``i``."""
        conditions = pending = 0
        while i < self.n:
            while self.text[i] in ("keyof", "typeof", "readonly", "unique", "infer", "asserts", "|", "&", "new", "abstract", "-"):
                i += 1
            t = self.text[i]
            if t in ("(", "[", "{"):
                i = self.close(i) + 1
                if t == "(" and self.text[i] == "=>":
                    i += 1
                    continue
            elif t == "<":
                if (after := self.angle_end(i)) == i:
                    return i
                i = after
                continue
            elif self.kind[i] in ("n", "d", "s"):
                i += 1
                while self.text[i] == "${":
                    i = self.close(i) + 2
                while self.text[i] == ".":
                    i += 2
                if self.text[i] == "<":
                    i = self.angle_end(i)
                if self.text[i] == "is" and not self.fresh[i]:
                    i += 1
                    continue
            else:
                return i
            while self.text[i] == "[" and not self.fresh[i]:
                i = self.close(i) + 1
            t = self.text[i]
            if t in ("|", "&"):
                i += 1
            elif t == "extends":
                conditions, i = conditions + 1, i + 1
            elif t == "?" and conditions:
                pending, i = pending + 1, i + 1
            elif t == ":" and pending:
                conditions, pending, i = conditions - 1, pending - 1, i + 1
            else:
                return i
        return i

    def expression_end(self, i: int, stop: int) -> int:
        """Behind the expression that begins at ``i``: at a comma, a closing bracket, or where a new line begins a statement."""
        first = i
        while i < stop:
            t = self.text[i]
            goes_on = self.kind[i] == "p" and t not in ("{", "@", "++", "--", "!", "~") or t in ("in", "of", "instanceof", "as", "satisfies")
            if i > first and self.fresh[i] and self.ends_operand(i - 1) and not goes_on:
                break
            if t in ("(", "[", "{", "${"):
                i = self.close(i) + 1
            elif t in (",", ";", ")", "]", "}"):
                break
            else:
                i += 1
        return i

    def arrow(self, i: int) -> tuple[int, int] | None:
        """(first, the token behind =>) of the arrow function that begins at ``i``."""
        j = i + 1 if self.text[i] == "async" and not self.fresh[i + 1] else i
        if self.text[j] == "<":
            j = self.angle_end(j)
        if self.text[j] == "(":
            after = self.close(j) + 1
            if self.text[after] == ":":
                after = self.type_end(after + 1)
        elif self.kind[j] == "n":
            after = j + 1
        else:
            return None
        return (i, after + 1) if self.text[after] == "=>" and after < self.n else None

    def numeric(self, a: int, b: int) -> int:
        """How much the code from offset ``a`` up to ``b`` computes: 1 for an operation, an index or a sign, 2 for a counting or conditional loop."""
        total, i, stop = 0, bisect_left(self.start, a, 0, self.n), bisect_left(self.start, b + 1, 0, self.n)
        done: set[int] = set()
        while i < stop:
            t, before = self.text[i], i > 0 and self.ends_operand(i - 1)
            if t in ("as", "satisfies") and before and not self.fresh[i]:
                i = self.type_end(i + 1)
                continue
            if t in ("interface", "type") and self.kind[i + 1] == "n" and not before and self.text[i - 1] != ".":
                i = self._statement_end(i, stop)
                continue
            if t == ":" and self._annotates(i):
                i = self.type_end(i + 1)
                continue
            if t in ("+", "-") and self.text[i + 1] not in ("readonly", "?"):
                total += 1
            elif t in ("*", "/", "%", "**") and before and self.text[i - 1] not in ("function", "yield", "import", "export", "async", "static", "}", ";"):
                total += 1
            elif t == "[" and before and self.text[i - 1] not in ("{", "}") and self.text[i + 1] != "]" and not (self.kind[i - 1] == "n" and self.text[i - 1] in ("const", "let", "var")):
                total += 1
            elif t == "[" and self.text[i - 1] == "?.":
                total += 1
            elif t == "do" and self.kind[i] == "n" and self.text[i + 1] == "{":
                done.add(self.close(i + 1) + 1)
            elif t == "while" and i not in done:
                total += 2
            elif t == "for":
                p = i + 2 if self.text[i + 1] == "await" else i + 1
                if self.text[p] == "(" and not self._in_loop(p):
                    total += 2
            i += 1
        return total

    def _in_loop(self, p: int) -> bool:
        """Whether a for loop's head counts over keys."""
        i, stop = p + 1, self.close(p)
        while i < stop:
            if self.text[i] in ("(", "[", "{"):
                i = self.close(i)
            elif self.text[i] in (";", "of"):
                return False
            elif self.text[i] == "in":
                return True
            i += 1
        return False

    def _statement_end(self, i: int, stop: int) -> int:
        if self.text[i] == "type":
            while i < stop and self.text[i] != "=":
                i += 1
            return self.type_end(i + 1)
        while i < stop and self.text[i] != "{":
            i += 1
        return self.close(i) + 1

    def _annotates(self, i: int) -> bool:
        """Whether a colon stands before a type: of a variable, a parameter or a result."""
        j = i - 2 if self.text[i - 1] == "?" else i - 1
        if self.text[j] == ")" and self.text[i - 1] != "?":
            after = self.type_end(i + 1)
            return self.text[after] in ("=>", "{") and self.text[self.close(j) - 1] not in ("?", ":")
        if self.text[j] in ("}", "]"):
            j = self.close(j)
        if self.kind[j] != "n" and self.text[j] not in ("{", "["):
            return False
        back = self.text[j - 1]
        if back in ("let", "const", "var"):
            return True
        if back == "..." or back in MODIFIERS - {"default"}:
            back = self.text[j - 2]
        if back not in ("(", ","):
            return False
        k = j
        while k >= 0 and self.text[k] != "(":  # the bracket that the name is in
            k = self.close(k) - 1 if self.text[k] in (")", "]", "}") and self.close(k) < k else k - 1
            if k >= 0 and self.text[k] in ("{", "["):
                return False
        after = self.close(k) + 1
        return self.text[after] in ("=>", "{") or self.text[after] == ":" and self.text[self.type_end(after + 1)] in ("=>", "{", ";")


class Module:
    """Declarations, classes and object literals of a text, found in one walk along its tokens."""

    def __init__(self, text: str):
        self.tokens = Tokens(text)
        self.found: list[Declared] = []
        self.classes: list[tuple[int, int, str]] = []
        self.entries: list[tuple[str, str, str | None, str]] = []  # registry, key, receiver, name of a held function
        self.holders: list[tuple[str, str, int]] = []  # name, the name that its value starts from, steps between
        self.named: set[int] = set()  # where declared functions and methods have their names
        self.types: list[tuple[int, int]] = []  # what only types are in
        self.factories = dict.fromkeys(STORE_FACTORIES)
        self.links = Links()
        self._link()
        self.walk(0, self.tokens.n, None, [], None)

    # --- modules ---

    def _names(self, i: int) -> Iterator[tuple[str, str]]:
        """(name, name behind ``as``) of a braced list."""
        t = self.tokens
        for part in self._parts(i + 1, t.close(i)):
            words = [t.text[k] for k in range(*part)]
            if words[:1] == ["type"] and len(words) > 1 and words[1] != "as":
                words = words[1:]
            if words:
                yield words[0], words[2] if len(words) > 2 and words[1] == "as" else words[0]

    def _from(self, i: int) -> str | None:
        t = self.tokens
        return t.text[i + 1][1:-1] if t.text[i] == "from" and t.kind[i + 1] == "s" else None

    def _link(self) -> None:
        t, i = self.tokens, 0
        while i < t.n:
            word = t.text[i]
            if word in ("(", "[", "{"):
                i = t.close(i)
            elif word == "import" and t.text[i + 1] not in ("(", "."):
                j, names = i + 1, []
                if t.text[j] == "type" and t.text[j + 1] != "from" and t.text[j + 1] != ",":
                    j += 1
                while t.text[j] not in ("from", ";") and t.kind[j] not in ("s", "end"):
                    if t.text[j] == "{":
                        names += [(local, name) for name, local in self._names(j)]
                        j = t.close(j)
                    elif t.text[j] == "*" and t.text[j + 1] == "as":
                        names.append((t.text[j + 2], "*"))
                        j += 2
                    elif t.kind[j] == "n":
                        names.append((t.text[j], "default"))
                    j += 1
                if specifier := self._from(j):
                    self.links.imports += [(local, name, specifier) for local, name in names]
                    for local, name in names:
                        if name in STORE_FACTORIES:
                            self.factories[local] = None
                i = j
            elif word == "export":
                i = self._export(i)
            i += 1

    def _export(self, i: int) -> int:
        t, j = self.tokens, i + 1
        while t.text[j] in ("type", "declare", "abstract", "async") and t.text[j + 1] not in ("=", "from"):
            j += 1
        word = t.text[j]
        if word == "{":
            specifier = self._from(t.close(j) + 1)
            self.links.exports += [(name, specifier, own) for own, name in self._names(j)]
            return t.close(j)
        if word == "*":
            named = t.text[j + 2] if t.text[j + 1] == "as" else "*"
            if specifier := self._from(j + (3 if named != "*" else 1)):
                self.links.exports.append((named, specifier, "*"))
            return j
        default = word == "default"
        if default:
            j += 1
            while t.text[j] in ("abstract", "async"):
                j += 1
            word = t.text[j]
        if word in ("function", "class", "interface", "enum", "namespace"):
            k = j + 2 if t.text[j + 1] == "*" else j + 1
            if t.kind[k] == "n":
                self.links.exports.append(("default" if default else t.text[k], None, t.text[k]))
        elif default and t.kind[j] == "n" and t.text[j + 1] in (";", "") or default and t.kind[j] == "n" and t.fresh[j + 1]:
            self.links.exports.append(("default", None, word))
        elif word in ("const", "let", "var"):
            k = j + 1
            while t.kind[k] == "n":
                self.links.exports.append((t.text[k], None, t.text[k]))
                k = self._value(k, t.n)[2]
                if t.text[k] != ",":
                    break
                k += 1
        return i if word not in ("{", "*") else j

    # --- declarations ---

    def _parts(self, i: int, stop: int) -> Iterator[tuple[int, int]]:
        t, first = self.tokens, i
        while i < stop:
            if t.text[i] in ("(", "[", "{", "${"):
                i = t.close(i)
            elif t.text[i] == ",":
                yield first, i
                first = i + 1
            i += 1
        if first < stop:
            yield first, stop

    def _value(self, i: int, stop: int) -> tuple[int, int, int]:
        """Of a variable or class property named at ``i``: (its value's first token, behind the value, behind the whole); no value: first = end."""
        t = self.tokens
        j = t.close(i) + 1 if t.text[i] in ("[", "{") else i + 1
        while t.text[j] in ("?", "!"):
            j += 1
        if t.text[j] == ":":
            j = t.type_end(j + 1)
        if t.text[j] != "=":
            return j, j, j
        if (f := self._function_at(j + 1)) is not None:
            return j + 1, f[2], f[2]
        end = t.expression_end(j + 1, stop)
        return j + 1, end, end

    def _function_at(self, i: int) -> tuple[int, int, int] | None:
        """(parameters or first token, body, behind the body) of the function or arrow function that begins at ``i``."""
        t = self.tokens
        if found := t.arrow(i):
            body = found[1]
            return i, body, t.close(body) + 1 if t.text[body] == "{" else t.expression_end(body, t.n)
        j = i + 1 if t.text[i] == "async" else i
        if t.text[j] == "function":
            while t.text[j] != "(" and j < t.n:
                j += 1
            after = t.close(j) + 1
            if t.text[after] == ":":
                after = t.type_end(after + 1)
            if t.text[after] == "{":
                return i, after, t.close(after) + 1
        return None

    def _declare(self, short: str, kind: str, cls: str | None, exported: bool, first: int, body: int, behind: int, statement: int) -> None:
        t = self.tokens
        stop = t.end[behind - 1] - 1
        self.found.append(Declared(short, kind, cls, exported, t.start[first], t.start[body] if body < behind else stop, stop, t.start[statement]))

    def _inside(self, first: int, body: int, behind: int, cls: str | None, exported: bool | None) -> None:
        """Walks through a function's parameters and body."""
        t = self.tokens
        while first < body and t.text[first] != "(":
            first = t.angle_end(first) if t.text[first] == "<" and t.angle_end(first) > first else first + 1
        if first < body:
            self.walk(first + 1, min(t.close(first), body), cls, [], exported, parameters=True)
        braced = t.text[body] == "{"
        self.walk(body + braced, behind - braced, cls, [], exported)

    def walk(self, i: int, stop: int, cls: str | None, keys: list[str], exported: bool | None, parameters: bool = False) -> None:
        """Statements and expressions from ``i`` to ``stop``. ``keys``: names of the values and properties that hold them; ``exported``: of the nearest variable statement."""
        t = self.tokens
        statement = i
        while i < stop:
            word, kind = t.text[i], t.kind[i]
            before = t.text[i - 1] if i else ""
            if i == statement or word in ("export", "class", "function", "const", "let", "var", "abstract", "async") and before not in MODIFIERS:
                statement = i
            if kind == "n" and before not in (".", "?."):
                if word in ("as", "satisfies") and t.ends_operand(i - 1):
                    i = t.type_end(i + 1)
                    continue
                if word in ("interface", "type") and t.kind[i + 1] == "n" and not t.ends_operand(i - 1) and before not in ("import", "export") or word in ("interface", "type") and before == "export" and t.kind[i + 1] == "n":
                    behind = t._statement_end(i, stop)
                    self.types.append((t.start[i], t.start[behind]))
                    i = behind
                    continue
                if word in ("import", "export") and t.text[i + 1] in ("{", "*", "type") and t.text[i + 1] != "(":
                    j = i + 1
                    while j < stop and t.kind[j] not in ("s",) and t.text[j] != ";" and not (t.text[j] == "{" and t.text[t.close(j) + 1] != "from"):
                        j = t.close(j) + 1 if t.text[j] == "{" else j + 1
                    if t.kind[j] == "s" and t.text[j - 1] == "from":
                        i = j + 1
                        continue
                    if t.text[i + 1] == "{":
                        i = t.close(i + 1) + 1
                        continue
                if word == "class":
                    i = self._class(i, stop, cls, exported)
                    continue
                if word == "function":
                    i = self._named_function(i, stop, cls, exported, statement)
                    continue
                if word in ("const", "let", "var") and t.text[i + 1] != "enum":
                    i = self._variables(i, stop, cls, t.text[i - 1] == "export" and i > 0 or t.text[i - 1] == "declare" and t.text[i - 2] == "export", statement)
                    continue
            if (kind == "n" or word in ("(", "<")) and before not in (".", "?.") and word != "function" and not (word == "async" and t.text[i + 1] == "function") and (f := self._function_at(i)):
                self._inside(*f, cls, exported)
                i = f[2]
                continue
            if word == "{" and self._is_literal(i, parameters):
                self._literal(i, cls, keys, exported)
                i = t.close(i) + 1
                continue
            i += 1

    def _is_literal(self, i: int, parameters: bool) -> bool:
        before, t = self.tokens.text[i - 1] if i else "", self.tokens
        if before in (")", "", ";", "{", "}", "=>", "else", "try", "finally", "do", ">") or parameters and before in ("(", ","):
            return False
        if before == ":":
            return self._keyed(i - 1)
        return not (t.kind[i - 1] in "nsd" and before not in BEFORE_OPERAND - {"do", "else", "extends", "as"})

    def _keyed(self, i: int) -> bool:
        """Whether the colon ``i`` isn't a case label's."""
        while i >= 0 and self.tokens.text[i] not in (";", "{", "}"):
            if self.tokens.text[i] in ("case", "default"):
                return False
            i = self.tokens.close(i) - 1 if self.tokens.text[i] in (")", "]") else i - 1
        return True

    def _named_function(self, i: int, stop: int, cls: str | None, exported: bool | None, statement: int) -> int:
        t = self.tokens
        first = i
        while first and t.text[first - 1] in ("async", "default", "export", "declare"):
            first -= 1
        j = i + 2 if t.text[i + 1] == "*" else i + 1
        name, p = t.text[j], j
        self.named.add(t.start[j])
        while p < stop and t.text[p] != "(":
            p = t.angle_end(p) if t.text[p] == "<" and t.angle_end(p) > p else p + 1
        after = t.close(p) + 1
        if t.text[after] == ":":
            after = t.type_end(after + 1)
        braced = t.text[after] == "{"
        behind = t.close(after) + 1 if braced else after
        declared = t.kind[j] == "n" and not (i and first == i and (t.text[i - 1] in ("=", "(", ",", ":", "?", "=>", "[", "&&", "||", "??", "!") or t.text[i - 1] in BEFORE_OPERAND - {"else", "do"}))
        if declared:
            self._declare(name, "function", None, t.text[first] == "export" or bool(exported), first, after if braced else behind, behind, first)
        if braced:
            self._inside(p, after, behind, cls, exported)
        return max(behind, i + 1)

    def _variables(self, i: int, stop: int, cls: str | None, exported: bool, statement: int) -> int:
        t, i = self.tokens, i + 1
        while i < stop and (t.kind[i] == "n" or t.text[i] in ("{", "[")):
            first, end, behind = self._value(i, stop)
            name = t.text[i] if t.kind[i] == "n" else None
            if first < end:
                self._held(name, first, end, cls, exported, i, statement, "function")
            i = behind
            if t.text[i] != ",":
                break
            i += 1
        return i

    def _held(self, name: str | None, first: int, end: int, cls: str | None, exported: bool | None, at: int, statement: int, kind: str) -> None:
        """The value of a variable or class property."""
        t = self.tokens
        keys = [name] if name else []
        if name and (f := self._function_at(first)) and f[2] == end:
            self._declare(f"{cls}.{name}" if cls else name, kind, cls, bool(exported), *f, statement)
            self._inside(*f, cls, exported)
            return
        if name and kind == "function" and self._is_store(first, end):
            self._declare(name, "store", None, bool(exported), at, first, end, statement)
        if name and t.text[first] == "{" and t.close(first) == end - 1:
            self._entries(name, first, cls, keys)
        elif name and (base := self._base(first, end)):
            self.holders.append((name, *base))
        self.walk(first, end, cls, keys, exported)

    def _is_store(self, first: int, end: int) -> bool:
        """A call of a factory of stores, or an object that can be subscribed to."""
        t = self.tokens
        if t.text[first] == "{" and t.close(first) == end - 1:
            return any(t.text[a] == "subscribe" or t.text[a] in ("async", "get", "set", "*") and t.text[a + 1] == "subscribe" for a, _ in self._parts(first + 1, t.close(first)))
        i = first
        while t.kind[i] == "n" and t.text[i + 1] in (".", "?."):
            i += 2
        if t.kind[i] != "n" or t.text[i] not in self.factories or (i > first and t.text[i] not in STORE_FACTORIES):
            return False
        call = t.angle_end(i + 1) if t.text[i + 1] == "<" else i + 1
        return t.text[call] == "(" and t.close(call) == end - 1

    def _base(self, first: int, end: int) -> tuple[str, int] | None:
        """The name that an expression of accesses starts from or reads off ``this`` or a value, and the number of its steps."""
        t, steps, i = self.tokens, 0, first
        while t.text[i] == "(" and i < end:
            steps, i = steps + 1, i + 1
        if t.kind[i] != "n":
            return None
        name, i = t.text[i], i + 1
        while i < end:
            if t.text[i] in (".", "?.") and t.kind[i + 1] == "n":
                name, i = t.text[i + 1], i + 2
            elif t.text[i] == "[" or t.text[i] == "?." and t.text[i + 1] == "[":
                i = t.close(i if t.text[i] == "[" else i + 1) + 1
                steps += 1
            elif t.text[i] in (")", "!"):
                i += 1
            elif t.text[i] in ("as", "satisfies"):
                i = t.type_end(i + 1)
            else:
                return None
        return (name, steps) if name != "this" else None

    def _key(self, a: int) -> str:
        t = self.tokens
        return "".join(t.text[a : t.close(a) + 1]) if t.text[a] == "[" else t.text[a]

    def _after_key(self, a: int) -> int:
        return self.tokens.close(a) + 1 if self.tokens.text[a] == "[" else a + 1

    def _entries(self, registry: str, i: int, cls: str | None, keys: list[str]) -> None:
        """The functions that an object literal holds, those of literals in it included."""
        t = self.tokens
        for a, b in self._parts(i + 1, t.close(i)):
            at = self._after_key(a)
            if t.text[at] != ":" or at >= b:
                continue
            key, first = self._key(a), at + 1
            held = [*keys, key]
            if (f := self._function_at(first)) and f[2] == b:
                self.entries.append((registry, key, None, ".".join([cls, *held] if cls else held)))
            elif t.text[first] == "{" and t.close(first) == b - 1:
                self._entries(registry, first, cls, held)
            elif named := self._reference(first, b):
                self.entries.append((registry, key, *named))

    def _reference(self, first: int, end: int) -> tuple[str | None, str] | None:
        """(receiver, name) of a value that is a name, without type-level wrappers."""
        t = self.tokens
        while t.text[first] == "(" and t.close(first) < end:
            inner = t.close(first)
            if inner != end - 1 and t.text[inner + 1] not in ("as", "satisfies", "!"):
                return None
            first, end = first + 1, inner
        i = first
        while t.kind[i] == "n" and t.text[i + 1] in (".", "?.") and i + 2 < end:
            i += 2
        if t.kind[i] != "n" or i >= end:
            return None
        behind = i + 1
        while behind < end and t.text[behind] in ("!", "as", "satisfies"):
            behind = behind + 1 if t.text[behind] == "!" else t.type_end(behind + 1)
        return ("".join(t.text[first : i - 1]) or None, t.text[i]) if behind >= end else None

    def _literal(self, i: int, cls: str | None, keys: list[str], exported: bool | None) -> None:
        """Methods, accessors and function values of an object literal."""
        t = self.tokens
        for a, b in self._parts(i + 1, t.close(i)):
            if self._member(a, b, cls, exported, in_class=False) is not None:
                continue
            at = self._after_key(a)
            if t.text[at] == ":" and at < b:
                held = [*keys, self._key(a)]
                if (f := self._function_at(at + 1)) and f[2] == b:
                    chain = ".".join(held)
                    self._declare(f"{cls}.{chain}" if cls else chain, "method" if cls else "function", cls, bool(exported), *f, a)
                    self._inside(*f, cls, exported)
                else:
                    self.walk(at + 1, b, cls, held, exported)
            else:
                self.walk(a, b, cls, keys, exported)

    def _member(self, i: int, stop: int, cls: str | None, exported: bool | None, in_class: bool) -> int | None:
        """The token behind the method, accessor or constructor that begins at ``i``; None where none does."""
        t, j, tag = self.tokens, i, ""
        while t.text[j] in MODIFIERS and t.text[j + 1] not in ("(", ":", "=", ",", ";", "?", "!", "<", "}"):
            j += 1
        if t.text[j] in ("get", "set") and t.text[j + 1] not in ("(", ":", "=", ",", ";", "<", "}", "?") and not t.fresh[j + 1]:
            tag, j = t.text[j] + " ", j + 1
        if t.text[j] == "*":
            j += 1
        if t.kind[j] not in ("n", "s", "d") and t.text[j] != "[" or j >= stop:
            return None
        p = self._after_key(j)
        if t.text[p] == "?":
            p += 1
        if t.text[p] == "<":
            p = t.angle_end(p)
        if t.text[p] != "(" or p >= stop:
            return None
        after = t.close(p) + 1
        if t.text[after] == ":":
            after = t.type_end(after + 1)
        braced = t.text[after] == "{" and after < stop
        if not braced and not in_class:
            return None
        behind = t.close(after) + 1 if braced else after
        self.named.add(t.start[j])
        name = self._key(j)
        kind = "accessor" if tag else "method"
        if name != "constructor" or braced:
            self._declare(f"{cls}.{tag}{name}" if cls else tag + name, kind, cls, bool(exported) and not in_class, i if not braced or t.text[i] not in ("@",) else j, after if braced else behind, behind, i)
        if braced:
            self._inside(p, after, behind, cls, exported)
        return behind

    def _class(self, i: int, stop: int, cls: str | None, exported: bool | None) -> int:
        t = self.tokens
        name = t.text[i + 1] if t.kind[i + 1] == "n" and t.text[i + 1] not in ("extends", "implements") else cls or "Anonymous"
        j = i + 1
        while j < stop and t.text[j] != "{":
            j = t.angle_end(j) if t.text[j] == "<" and t.angle_end(j) > j else t.close(j) + 1 if t.text[j] == "(" else j + 1
        end = t.close(j)
        self.classes.append((t.start[min(j, t.n)], t.start[end] if end < t.n else t.start[t.n], name))
        k = j + 1
        while k < end:
            if t.text[k] in (";", ","):
                k += 1
                continue
            if t.text[k] == "@":  # a decorator
                k = t.close(k + 2) + 1 if t.text[k + 2] == "(" else k + 2
                continue
            if t.text[k] == "static" and t.text[k + 1] == "{":
                self.walk(k + 2, t.close(k + 1), name, [], exported)
                k = t.close(k + 1) + 1
                continue
            if (behind := self._member(k, end, name, exported, in_class=True)) is not None:
                k = max(behind, k + 1)
                continue
            at = k
            while t.text[at] in MODIFIERS and t.text[at + 1] not in (":", "=", ";", "?", "!", "}"):
                at += 1
            if t.kind[at] in ("n", "s", "d") or t.text[at] == "[":
                first, last, behind = self._value(at, end)
                if first < last:
                    self._held(self._key(at), first, last, name, None, at, k, "method")
                k = max(behind, at + 1)
            else:
                k += 1
        return end + 1
