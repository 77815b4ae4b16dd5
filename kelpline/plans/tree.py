"""The query tree: nodes, and their S-expression form.

A leaf is ((term type gdf basic index feature n_phrases)) with type 1 required, 2 lenient, 3 optional.
Operators: ROOT, AND, OR, OR_MAX, PHRASE, (PROX n ...), (ORDERED_PROX n ...).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

STRICT, LENIENT, OPTIONAL = 1, 2, 3
OPERATORS = {"ROOT", "AND", "OR", "OR_MAX", "PHRASE", "PROX", "ORDERED_PROX"}


@dataclass
class Leaf:
    term: str
    kind: int = STRICT
    gdf: float = 0.0
    basic: bool = True
    index: int = 0
    feature: int = 0
    n_phrases: int = 1
    id: int = -1

    @property
    def dependency(self) -> bool:
        return self.index in (1, 3)

    def sexp(self) -> str:
        return f"(({self.term} {self.kind} {int(self.gdf)} {int(self.basic)} {self.index} {self.feature} {self.n_phrases}))"


@dataclass
class Node:
    op: str
    children: list["Node | Leaf"] = field(default_factory=list)
    distance: int | None = None

    def sexp(self) -> str:
        head = self.op if self.distance is None else f"{self.op} {self.distance}"
        return "(" + " ".join([head, *(c.sexp() for c in self.children)]) + ")"


def leaves(node: "Node | Leaf") -> Iterator[Leaf]:
    if isinstance(node, Leaf):
        yield node
    else:
        for c in node.children:
            yield from leaves(c)


def number(node: "Node | Leaf") -> list[Leaf]:
    """Gives the leaves their ids, from left to right."""
    out = list(leaves(node))
    for i, leaf in enumerate(out):
        leaf.id = i
    return out


def optional(node: "Node | Leaf") -> bool:
    """True for a leaf that never restricts, and for an operator all of whose leaves are such."""
    return all(x.kind == OPTIONAL for x in leaves(node))


def read(text: str) -> "Node | Leaf":
    """A tree from its S-expression; an outer pair of brackets round ROOT is allowed."""
    words = re.findall(r"[()]|[^\s()]+", text)
    at = 0

    def value():
        nonlocal at
        if at >= len(words):
            raise ValueError("the expression ends early")
        w = words[at]
        at += 1
        if w == ")":
            raise ValueError("a bracket closes that was never opened")
        if w != "(":
            return w
        out = []
        while at < len(words) and words[at] != ")":
            out.append(value())
        if at >= len(words):
            raise ValueError("a bracket is left open")
        at += 1
        return out

    def node(x) -> "Node | Leaf":
        while isinstance(x, list) and len(x) == 1 and isinstance(x[0], list):
            x = x[0]
        if not isinstance(x, list) or not x or not isinstance(x[0], str):
            raise ValueError("an operator or a term was expected")
        if x[0] in OPERATORS and all(isinstance(c, list) for c in x[1 + (x[0] in ("PROX", "ORDERED_PROX")) :]):
            far = int(x[1]) if x[0] in ("PROX", "ORDERED_PROX") else None
            return Node(x[0], [node(c) for c in x[1 + (far is not None) :]], far)
        term, *rest = x
        kind, gdf, basic, index, feature, *more = [*rest, *["0"] * (5 - len(rest))]
        return Leaf(term, int(kind), float(gdf), basic == "1", int(index), int(feature), int(more[0]) if more else 1)

    out = node(value())
    if at != len(words):
        raise ValueError("text follows the expression")
    return out
