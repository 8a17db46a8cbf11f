"""What a compiler configuration extends: lists, packages, cycles."""

import json

from quillon.config import tsconfig


def write(path, told):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(told))
    return str(path)


def paths(**aliases):
    return {"paths": {k: [v] for k, v in aliases.items()}}


def test_lists_and_packages(tmp_path):
    write(tmp_path / "node_modules/@shared/settings/strict.json", {"compilerOptions": paths(far="src/far")})
    write(tmp_path / "node_modules/whole/package.json", {"tsconfig": "build/base.json"})
    write(tmp_path / "node_modules/whole/build/base.json", {"compilerOptions": {"baseUrl": "../../..", **paths(whole="src/whole")}})
    write(tmp_path / "node_modules/plain/tsconfig.json", {"compilerOptions": paths(both="plain", plain="own")})
    write(tmp_path / "app/first.json", {"compilerOptions": paths(both="first", one="first")})
    top = write(tmp_path / "app/tsconfig.json", {"extends": ["plain", "./first", "@shared/settings/strict", "whole"], "compilerOptions": paths(mine="src/mine")})
    aliases, warnings = tsconfig(top, {})
    assert not warnings
    assert aliases == {"both": "first", "plain": "../node_modules/plain/own", "one": "first", "far": "../node_modules/@shared/settings/src/far", "whole": "../src/whole", "mine": "src/mine"}


def test_cycles_end_and_lost_files_are_named(tmp_path):
    write(tmp_path / "a.json", {"extends": "./b.json", "compilerOptions": paths(a="a", both="a")})
    write(tmp_path / "b.json", {"extends": ["./a.json", "./gone", "no-such-package", 7], "compilerOptions": paths(b="b", both="b")})
    aliases, warnings = tsconfig(str(tmp_path / "a.json"), {})
    assert aliases == {"a": "a", "b": "b", "both": "a"} and len(warnings) == 1 and '"./gone"' in warnings[0]
    assert tsconfig(str(tmp_path / "a.json"), {"x": ["y"]})[1] == [] and tsconfig(str(tmp_path / "none.json"), {}) == ({}, [])
