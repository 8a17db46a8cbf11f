"""Settings of a project and coercion of query parameters."""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


def num(value: Any, default: float) -> float:
    """A query parameter as a number; absent, empty and non-numeric values give the default."""
    if value is None or value == "":
        return default
    try:
        out = float(value)
    except (TypeError, ValueError):
        return default
    return default if math.isnan(out) else int(out) if out == int(out) else out


def slice_end(limit: float, n: int) -> int:
    """How many of ``n`` rows a limit leaves: fractions are cut, a negative limit counts from the end."""
    limit = int(limit)
    return max(0, n + limit) if limit < 0 else min(limit, n)


@dataclass(frozen=True)
class Rule:
    adr: str
    type: str | None = None
    severity: str = "error"
    msg: str | None = None
    module: str | None = None
    allow_from: tuple[str, ...] = ()
    callees: tuple[str, ...] = ()
    checkable: bool = True


@dataclass(frozen=True)
class Config:
    name: str = "project"
    namespace_prefix: str | None = None
    layers: Mapping[str, int] = field(default_factory=dict)
    god_functions: int = 40
    rules: tuple[Rule, ...] = ()
    exempt_groups: tuple[str, ...] = ("stores",)
    core_groups: tuple[str, ...] = ("services", "systems")
    unported_groups: tuple[str, ...] = ("rust", "dev")
    src_dir: str = "src/lib"

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """A project's JSON settings; absent keys take the defaults, nothing in it is executed."""
        told = json.loads(Path(path).read_text())
        return cls.parse(told)

    @classmethod
    def parse(cls, told: Mapping[str, Any]) -> Config:
        rules = tuple(
            Rule(
                adr=r.get("adr", ""), type=r.get("type"), severity=r.get("severity") or "error", msg=r.get("msg"), module=r.get("module"),
                allow_from=tuple(r.get("allowFrom") or ()), callees=tuple(r.get("callees") or ([r["callee"]] if r.get("callee") else ())), checkable=r.get("checkable") is not False,
            )
            for r in told.get("adrRules") or ()
        )
        prefix = told.get("namespacePrefix") or (told.get("group") or {}).get("namespacePrefix")
        return cls(
            name=told.get("name") or "project", namespace_prefix=prefix, layers=dict(told.get("layers") or {}),
            god_functions=told.get("godFunctions", 40), rules=rules, src_dir=told.get("srcDir") or "src/lib",
        )


@dataclass(frozen=True)
class Project:
    """A project's settings with all paths in place."""

    config: Config
    root: str
    kind: str
    tsconfig: str
    src_token: str
    component_root: str
    crates: tuple[str, ...] = ()
    decisions: str | None = None
    descriptions: str | None = None
    paths: Mapping[str, list[str]] = field(default_factory=dict)
    wasm_package: str | None = None
    machine: str | None = None
    told: Mapping[str, Any] = field(default_factory=dict)


def load_project(path: str | Path) -> Project:
    """The settings file of a project, defaults merged in; it is read, never executed. FileNotFoundError where there is none."""
    place = Path(path)
    if not place.is_file():
        raise FileNotFoundError(f"no project settings at {place}")
    told, root = json.loads(place.read_text()), place.resolve().parent
    config = Config.parse(told)
    at = lambda key: str(root / told[key]) if told.get(key) else None
    return Project(
        config, str(root), "filesystem" if told.get("kind") == "filesystem" else "code", str(root / (told.get("tsconfig") or "tsconfig.json")), "/" + config.src_dir.replace("\\", "/").strip("/") + "/",
        told.get("svelteRoot") or "src", tuple(told.get("rustCrates") or ()), at("adrsDoc"), at("descriptions"), dict(told.get("paths") or {}), told.get("wasmPackage"), told.get("machine"), told,
    )


def _plain_json(text: str) -> str:
    """JSON without comments and trailing commas."""
    out = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", out)


def _extended(place: Path, parent: str) -> Path | None:
    """The file that a configuration's ``extends`` names: by path, or in the nearest package folder that has it."""
    if parent.startswith(".") or os.path.isabs(parent):
        near = [place.parent / parent]
    else:
        near = [folder / "node_modules" / parent for folder in place.resolve().parents]
    for target in near:
        named = []
        if (target / "package.json").is_file():
            named = [target / str(json.loads((target / "package.json").read_text()).get("tsconfig") or "tsconfig.json")]
        for file in (target, Path(f"{target}.json"), *named, target / "tsconfig.json"):
            if file.is_file():
                return file
    return None


def tsconfig(path: str, own: Mapping[str, list[str]]) -> tuple[dict[str, str], list[str]]:
    """Path aliases (without the stars) of a compiler configuration and what it extends, ``own`` ones on top, and warnings.

    What is extended may be one file or a list (later ones win), by path or by package; a file that extends itself counts
    once. A file that is extended by path but not there loses its aliases silently elsewhere; it is warned about unless
    ``own`` has some.
    """
    found, warnings, base = [], [], Path(path).parent

    def follow(place: Path, above: frozenset[Path]) -> None:
        if not place.is_file() or place.resolve() in above:
            return
        told = json.loads(_plain_json(place.read_text()))
        parents = told.get("extends") or []
        for parent in [parents] if isinstance(parents, str) else [p for p in parents if isinstance(p, str)]:
            target = _extended(place, parent)
            if target:
                follow(target, above | {place.resolve()})
            elif parent.startswith(".") and not own:
                warnings.append(f'{place.name} extends "{parent}", which does not exist: imports by its path aliases do not resolve. Generate it, or set "paths" in the project settings.')
        options = told.get("compilerOptions") or {}
        found.append((place.parent / (options.get("baseUrl") or "."), options.get("paths") or {}))

    follow(Path(path), frozenset())
    aliases: dict[str, str] = {}
    for folder, paths in [*found, (base, own)]:
        for alias, targets in paths.items():
            if targets:
                aliases[alias.removesuffix("/*")] = os.path.normpath(os.path.relpath(folder / targets[0].removesuffix("/*"), base))
    return aliases, warnings
