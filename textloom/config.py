"""YAML configurations with env(), file(), abspath(), relpath(), eval() and pad() in strings."""

from __future__ import annotations

import ast
import operator
import os
import re
from pathlib import Path
from typing import Any

import yaml

_CALL = re.compile(r"(env|file|abspath|relpath|eval|pad)\(([^()]*)\)")
_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos}


def arithmetic(text: str) -> int | float:
    """The value of an arithmetic expression; anything else is an error."""

    def value(node):
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](value(node.operand))
        raise ValueError(f"not arithmetic: {text}")

    return value(ast.parse(text.strip(), mode="eval").body)


def _resolve(text: str, base: Path, names: tuple[str, ...]) -> Any:
    while True:
        calls = [m for m in _CALL.finditer(text) if m[1] in names]
        if not calls:
            return text
        m = calls[0]
        name, arg = m[1], m[2]
        if name == "env":
            key, has, default = arg.partition(":")
            if key not in os.environ and not has:
                raise KeyError(f"environment variable {key} is not set")
            made: Any = os.environ.get(key, default)
        elif name == "file":
            made = load(base / arg)
        elif name == "abspath":
            made = str((base / arg).resolve())
        elif name == "relpath":
            made = os.path.relpath(arg, base)
        elif name == "eval":
            made = arithmetic(arg)
        else:
            s, left, right, c = arg.split(";")
            made = c * int(left) + s + c * int(right)
        if m[0] == text:
            return yaml.safe_load(made) if name == "env" else made
        text = text[: m.start()] + str(made) + text[m.end() :]


def _walk(x: Any, base: Path, names: tuple[str, ...]) -> Any:
    if isinstance(x, dict):
        return {k: _walk(v, base, names) for k, v in x.items()}
    if isinstance(x, list):
        return [_walk(v, base, names) for v in x]
    return _resolve(x, base, names) if isinstance(x, str) else x


def load(path: str | Path) -> Any:
    """A YAML file with its calls resolved: environment variables first, then the rest."""
    path = Path(path)
    tree = yaml.safe_load(path.read_text(encoding="utf-8"))
    return _walk(_walk(tree, path.parent, ("env",)), path.parent, ("file", "abspath", "relpath", "eval", "pad"))


def load_experiment(folder: str | Path) -> Any:
    """The configuration that an experiment's info.yaml names."""
    folder = Path(folder)
    return load(folder / yaml.safe_load((folder / "info.yaml").read_text())["config_name"])
