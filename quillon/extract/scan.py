"""Declarations, calls and imports of one source file, found by syntax alone. Joins between files are in ``build``."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

from .syntax import Module
from .text import Source

#: What a file's text is found to hold, one kind a row: the other columns of the row are null.
FACTS = (
    "decl struct<file string, module string, grp string, lang string, short string, kind string, class_name string, exported boolean, start long, body long, stop long, line long, end_line long, "
    "signature string, doc string, numeric_ops long, legacy_reactive long, wasm boolean, in_test boolean>, "
    # how: ``call``, ``pass`` (a function handed over as an argument), ``dispatch`` (a call through a key of the registry
    # ``receiver``, ``steps`` accesses away; a null name means the value itself is called)
    "call struct<file string, module string, at long, receiver string, name string, in_test boolean, how string, steps int>, "
    # functions that object literals hold: under which key, by which name
    "entry struct<file string, module string, registry string, key string, receiver string, name string>, "
    # values that are accesses of other values: the name that these start from, how many steps away
    "holder struct<file string, module string, name string, base string, steps int>, "
    # place: the path, without suffix, that a specifier means; name: '*' for the whole module
    "brings struct<file string, module string, local string, name string, place string>, "
    "gives struct<module string, name string, place string, original string>"
)

_RUST_FN = re.compile(r"(\bpub\b[^\n;{}]*?)?\bfn\s+([A-Za-z_]\w*)\s*(?:<[^>]*>)?\s*(\()")
_RUST_IMPL = re.compile(r"\bimpl\b(?:\s*<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?([A-Za-z_]\w*)[^{;]*(\{)")
_RUST_TEST = re.compile(r"#\[\s*cfg\s*\(\s*test\s*\)\s*\][^{;]*(\{)")
_CALL = re.compile(r"(?:\b([A-Za-z_$][\w$]*)\s*(?:\?\.|\.)\s*|(\.)\s*)?\b([A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>)?\(")
_STORE_READ = re.compile(r"\$([A-Za-z_]\w*)")
_KEYWORDS = frozenset("if for while switch return catch function fn match loop new typeof await constructor super impl use mod pub let const".split())
_DISPATCH = re.compile(r"\b([A-Za-z_$][\w$]*)\s*(\[)")
_AFTER_KEY = re.compile(r"\s*(?:\?\.|!)?\s*(?:\.?\s*([A-Za-z_$][\w$]*)\s*)?(?:\?\.\s*)?\(")
_PROPERTY = re.compile(r"\s*(?:\[[^\]]*\]|[A-Za-z_$][\w$]*|[0-9]+)\s*:")
_NAME = re.compile(r"(?:([A-Za-z_$][\w$]*(?:\s*\.\s*[A-Za-z_$][\w$]*)*)\s*\.\s*)?([A-Za-z_$][\w$]*)")
_WRAPPED = re.compile(r"\s*(?:\bas\b|\bsatisfies\b).*$|\s*!\s*$", re.S)
_SCRIPT = re.compile(r"(?is)<script\b[^>]*>(.*?)</script>")


def script_only(html: str) -> str:
    """A component file with all but its scripts blanked; offsets and lines stay."""
    out, at = [], 0
    for m in _SCRIPT.finditer(html):
        out += [re.sub(r"[^\n]", " ", html[at : m.start(1)]), m[1]]
        at = m.end(1)
    return "".join([*out, re.sub(r"[^\n]", " ", html[at:])])


def module_name(path: str) -> str:
    return re.sub(r"\.(ts|svelte)$", "", re.sub(r"^src/", "", re.sub(r"^src/lib/", "", path)))


def _row(src: Source, path: str, module: str, grp: str, lang: str, short: str, kind: str, cls: str | None, exported: bool, start: int, body: int, stop: int, **more) -> dict:
    doc_at = more.pop("doc_at", start)
    head = " ".join(src.text[start : min(x for x in (src.code.find("{", start), src.code.find("=>", start) + 2, stop + 1) if x > start)].split())
    return {
        "file": path, "module": module, "grp": grp, "lang": lang, "short": short, "kind": kind, "class_name": cls, "exported": exported, "start": start, "body": body, "stop": stop,
        "line": src.line(start), "end_line": src.line(stop), "signature": head[:157] + "..." if len(head) > 160 else head, "doc": src.doc_before(doc_at), "numeric_ops": 0,
        "legacy_reactive": 0, "wasm": False, "in_test": False,
    } | more


def rust(path: str, text: str, crate: str) -> Iterator[dict]:
    """Functions and methods of a Rust file; those of its own tests are marked."""
    src = Source(text, rust=True)
    module = f"{crate}/{re.sub(r'[.]rs$', '', path.rsplit('/', 1)[-1])}"
    spans = lambda pattern: [(m.start(m.lastindex), src.end(m.start(m.lastindex)), m[1]) for m in pattern.finditer(src.code)]
    impls, tests = spans(_RUST_IMPL), spans(_RUST_TEST)
    for m in _RUST_FN.finditer(src.code):
        start, close = src.code.index("fn", m.start(2) - 4 if m.start(2) >= 4 else 0), src.end(m.start(3))
        body = next((i for i in range(close, len(src.code)) if src.code[i] in "{;"), -1)
        if body < 0 or src.code[body] == ";":
            continue
        owner = max(((a, t) for a, b, t in impls if a < start < b), default=(0, None))[1]
        yield _row(
            src, path, module, "rust", "rust", f"{owner}.{m[2]}" if owner else m[2], "method" if owner else "function", owner, bool(m[1]), start, body, src.end(body),
            wasm="#[wasm_bindgen" in text[max(0, start - 200) : start], in_test=any(a < start < b for a, b, _ in tests),
        )


def typescript(path: str, text: str, grp: str, found: Module | None = None) -> Iterator[dict]:
    """Functions, methods, accessors, constructors, object-literal values and stores of a TypeScript file; a component file is one node."""
    module = module_name(path)
    if path.endswith(".svelte"):
        if text.strip():
            code, name = script_only(text), module.rsplit("/", 1)[-1]
            more = {"doc": "", "signature": "", "legacy_reactive": len(re.findall(r"(?m)^\s*\$:", code)), "end_line": text.count("\n") + 1}
            yield _row(Source(text), path, module, grp, "ts", name, "component", None, True, 0, 0, max(0, len(text) - 1), **more)
        return
    found, source = found or Module(text), Source(text)
    for d in found.found:
        yield _row(source, path, module, grp, "ts", d.short, d.kind, d.cls, d.exported, d.start, d.body, d.stop, doc_at=d.doc_at, numeric_ops=found.tokens.numeric(d.start, d.stop))


def bare_argument(text: str) -> str:
    """An argument without type-level wrappers: parentheses around it, ``as T``, ``satisfies T``, a closing ``!``."""
    while True:
        text = text.strip()
        inner = text
        if text.startswith("(") and Source(text).ends.get(0) == len(text) - 1:
            inner = text[1:-1]
        elif m := _WRAPPED.search(text):
            close = max((Source(text).ends.get(0, -1) if text[:1] in "{[(" else -1), 0)
            inner = text[: m.start()] if m.start() >= close else text[: close + 1]
        if inner == text:
            return text
        text = inner


def _parts(src: Source, a: int, b: int) -> Iterator[tuple[int, int]]:
    """The pieces between commas of the code from ``a`` to ``b``."""
    i = first = a
    while i < b:
        c = src.code[i]
        if c in "([{":
            i = src.end(i)
        elif c == ",":
            yield first, i
            first = i + 1
        i += 1
    if src.code[first:b].strip():
        yield first, b


def _values(src: Source, opened: int) -> Iterator[tuple[str, str | None, str, int]]:
    """(key, receiver, name, place) of every property of an object literal, and of literals in it, whose value is a name."""
    for a, b in _parts(src, opened + 1, src.end(opened)):
        if not (m := _PROPERTY.match(src.code, a, b)):
            continue
        key, value = m[0].rstrip()[:-1].strip(), bare_argument(src.code[m.end() : b])
        if value.startswith("{"):
            yield from _values(src, src.code.index("{", m.end()))
        elif (n := _NAME.fullmatch(value)) and n[2] not in _KEYWORDS:
            yield key, n[1] and re.sub(r"\s", "", n[1]), n[2], m.end()


def calls(path: str, text: str, module: str, test: bool = False, found: Module | None = None) -> Iterator[dict]:
    """Calls by name and receiver (of ``this``: its class), functions handed over, calls through keys, and, in component files, reads of stores (receiver ``$``)."""
    component, is_rust = path.endswith(".svelte"), path.endswith(".rs")
    code = script_only(text) if component else text
    src = Source(code, rust=is_rust)
    found = found or (None if is_rust else Module(code))
    tests = [(m.start(1), src.end(m.start(1))) for m in _RUST_TEST.finditer(src.code)] if is_rust else []

    def row(at: int, receiver: str | None, name: str | None, how: str, steps: int = 0) -> dict:
        if receiver == "this" and found:
            receiver = max(((a, name) for a, b, name in found.classes if a < at < b), default=(0, ""))[1]
        return {"file": path, "module": module, "at": at, "receiver": receiver, "name": name, "in_test": test or any(a < at < b for a, b in tests), "how": how, "steps": steps}

    for m in _CALL.finditer(src.code):
        before = src.code[max(0, m.start() - 12) : m.start()]
        if m[3] in _KEYWORDS or re.search(r"\b(function|fn)\s*\*?\s*$", before):
            continue
        if found and (m.start(3) in found.named or any(a <= m.start(3) < b for a, b in found.types)):
            continue  # where it is declared, or a type
        yield row(m.start(3), m[1] or (m[2] and ""), m[3], "call")
        if is_rust:
            continue
        if m[1] and m[1] != "this":
            yield row(m.start(3), m[1], m[3], "dispatch")
        elif not m[1] and not m[2]:
            yield row(m.start(3), m[3], None, "dispatch")
        opened = m.end() - 1
        for a, b in _parts(src, opened + 1, src.end(opened)):
            argument = bare_argument(src.code[a:b])
            if (n := _NAME.fullmatch(argument)) and n[2] not in _KEYWORDS:
                yield row(a + 1, n[1] and re.sub(r"\s", "", n[1]), n[2], "pass")
            elif argument.startswith("{"):
                for _, receiver, name, place in _values(src, src.code.index("{", a)):
                    yield row(place, receiver, name, "pass")
    if not is_rust:
        for m in _DISPATCH.finditer(src.code):
            steps, close = 1, src.end(m.start(2))
            while src.code[close + 1 : close + 2] == "[":  # further keys
                steps, close = steps + 1, src.end(close + 1)
            after = _AFTER_KEY.match(src.code, close + 1)
            if after and m[1] not in _KEYWORDS:
                yield row(m.start(1), m[1], after[1], "dispatch", steps)
    if component:
        for m in _STORE_READ.finditer(text):
            yield row(m.start(), "$", m[1], "call")


def place_of(specifier: str, path: str, aliases: Mapping[str, str]) -> str | None:
    """The path that a module specifier means in a file: by the longest path alias, or relative to the file's folder; None for packages."""
    known = [a for a in aliases if specifier == a or specifier.startswith(a + "/")]
    if known:
        best = max(known, key=len)
        target = aliases[best] + specifier[len(best) :]
    elif specifier.startswith("."):
        target = "/".join([*path.split("/")[:-1], specifier])
    else:
        return None
    parts: list[str] = []
    for step in target.split("/"):
        parts = parts if step in (".", "") else parts[:-1] if step == ".." else [*parts, step]
    return re.sub(r"\.[jt]s$", "", "/".join(parts))


def facts(path: str, text: str, aliases: Mapping[str, str], rust_crates: Sequence[str], prefix: str | None) -> Iterator[tuple[str, dict]]:
    """(kind, row) of everything that a file holds: columns of ``FACTS``."""
    if path.endswith(".rs"):
        crate = path.split("/")[0]
        if crate in rust_crates:
            module = f"{crate}/{path.rsplit('/', 1)[-1].removesuffix('.rs')}"
            yield from (("decl", d) for d in rust(path, text, crate))
            yield from (("call", c) for c in calls(path, text, module))
        return
    module, declares = module_name(path), not path.endswith((".test.ts", ".d.ts"))
    found = Module(script_only(text) if path.endswith(".svelte") else text)
    if declares:
        parts = module.split("/")
        yield from (("decl", d) for d in typescript(path, text, parts[1] if parts[0] == prefix and len(parts) > 1 else parts[0], found))
        for registry, key, receiver, name in found.entries:
            yield "entry", {"file": path, "module": module, "registry": registry, "key": key, "receiver": receiver, "name": name}
    if declares or (path.endswith(".test.ts") and "/src/" in "/" + path):
        yield from (("call", c) for c in calls(path, text, module, path.endswith(".test.ts"), found))
    for name, base, steps in found.holders:
        yield "holder", {"file": path, "module": module, "name": name, "base": base, "steps": steps}
    for local, name, specifier in found.links.imports:
        if place := place_of(specifier, path, aliases):
            yield "brings", {"file": path, "module": module, "local": local, "name": name, "place": place}
    for name, specifier, original in found.links.exports:
        place = place_of(specifier, path, aliases) if specifier else None
        if place or not specifier:
            yield "gives", {"module": module, "name": name, "place": place, "original": original}
