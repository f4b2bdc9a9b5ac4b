"""Condition trees: text, region and semantic leaves under and, or and not."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..model import LEAF

UNRESOLVED = "<UNRESOLVED>"


@dataclass(frozen=True)
class Leaf:
    kind: str  # text, region or semantic
    text: str = ""
    fuzzy: float | None = None
    category: str | None = None
    branch: str = ""


@dataclass(frozen=True)
class Node:
    op: str  # and, or, not
    parts: tuple = field(default_factory=tuple)


def parse(raw: object) -> Leaf | Node:
    """A tree from JSON-like values, in the full form or in short ones such as ``{"text": "..."}``."""
    if isinstance(raw, str):
        return Leaf("text", raw)
    if not isinstance(raw, dict):
        raise ValueError(f"no condition: {raw!r}")
    kind = raw.get("kind")
    for op in ("and", "or"):
        if kind == op or op in raw:
            parts = raw.get("children", raw.get(op))
            return Node(op, tuple(map(parse, parts or ())))
    if kind == "not" or "not" in raw:
        return Node("not", (parse(raw.get("child", raw.get("not"))),))
    kind = kind or next((k for k in ("text", "region", "semantic") if k in raw), None)
    if kind not in ("text", "region", "semantic"):
        raise ValueError(f"unknown kind of condition: {raw!r}")
    words = raw.get("text") if kind == "text" else raw.get("description")
    words = words if words is not None else raw.get(kind, "")
    return Leaf(kind, str(words), raw.get("fuzzy"), raw.get("category"), raw.get("branch", ""))


def fallback(prompt: str) -> Leaf:
    """A semantic condition on the whole prompt, for when nothing better is known."""
    return Leaf("semantic", prompt.strip() or UNRESOLVED, category="other")


def branched(tree: Leaf | Node) -> Leaf | Node:
    """The tree with branches L0, L1, ... on its leaves, from left to right."""
    names = (f"L{i}" for i in range(1 << 30))

    def walk(node: Leaf | Node) -> Leaf | Node:
        if isinstance(node, Leaf):
            return Leaf(node.kind, node.text, node.fuzzy, node.category, next(names))
        return Node(node.op, tuple(map(walk, node.parts)))

    return walk(tree)


def leaves(tree: Leaf | Node) -> Iterator[Leaf]:
    if isinstance(tree, Leaf):
        yield tree
    else:
        for part in tree.parts:
            yield from leaves(part)


def unresolved(tree: Leaf | Node) -> bool:
    return any(x.kind == "region" and x.text.strip() in ("", UNRESOLVED) for x in leaves(tree))


def plain(tree: Leaf | Node) -> dict:
    """The tree as plain values; absent ones stay absent."""
    if isinstance(tree, Leaf):
        own = {"kind": tree.kind, "text" if tree.kind == "text" else "description": tree.text, "fuzzy": tree.fuzzy, "category": tree.category, "branch": tree.branch or None}
        return {k: v for k, v in own.items() if v is not None}
    return {"kind": tree.op, "children": [plain(p) for p in tree.parts]}


def canonical(tree: Leaf | Node) -> str:
    return json.dumps(plain(tree), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(tree: Leaf | Node) -> str:
    """The same for trees that differ in the order of keys only."""
    return hashlib.sha256(canonical(tree).encode()).hexdigest()


def table(spark: SparkSession, tree: Leaf | Node) -> DataFrame:
    rows = [(x.branch, x.kind, x.text if x.kind == "text" else None, x.fuzzy, x.category, x.text if x.kind != "text" else None) for x in leaves(tree)]
    return spark.createDataFrame(rows, LEAF)
