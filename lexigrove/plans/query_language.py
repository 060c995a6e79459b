"""The boolean query language: scanning, postfix order, and what a postfix denotes.

All of it is driver-side work on one short string; boolean.py turns the outcome into a plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The scanner's alternatives and the operators' ranks.
SCANNER = re.compile(r'#\d+\([^)]+\)|"[^"]+"|\bAND\b|\bOR\b|\bNOT\b|\(|\)|[^\s()"]+', re.IGNORECASE)
PROXIMITY = re.compile(r"#(\d+)\(([^,]+),\s*([^)]+)\)")
RANK = {"NOT": 3, "AND": 2, "OR": 1}


@dataclass(frozen=True)
class Leaf:
    """An operand: kind `terms`, `phrase` or `near`, with its texts and, for `near`, the distance."""

    kind: str
    texts: tuple[str, ...]
    distance: int = 0


@dataclass(frozen=True)
class Node:
    op: str
    parts: tuple


EMPTY = Leaf("terms", ())


def scan(query: str) -> list[str]:
    return SCANNER.findall(query)


def postfix(query: str) -> list[str]:
    """Operands before operators: NOT binds closest and to the right, AND before OR, both to the left. A stray `)` ends what
    stands before it, as if that were in brackets; a `(` never closed comes last, as an operand that matches nothing."""
    out: list[str] = []
    waiting: list[str] = []
    for token in scan(query):
        word = token.upper()
        if word in RANK:
            while waiting and waiting[-1] in RANK and (RANK[waiting[-1]] > RANK[word] or (RANK[waiting[-1]] == RANK[word] and word != "NOT")):
                out.append(waiting.pop())
            waiting.append(word)
        elif token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting and (top := waiting.pop()) != "(":
                out.append(top)
        else:
            out.append(token)
    return out + waiting[::-1]


def leaf(token: str) -> Leaf:
    if token.startswith("#"):
        m = PROXIMITY.match(token)
        return Leaf("near", (m[2].strip(), m[3].strip()), int(m[1])) if m else EMPTY
    if len(token) >= 2 and token[0] == token[-1] == '"':
        return Leaf("phrase", (token[1:-1],))
    return EMPTY if token == "(" else Leaf("terms", (token,))


def denotation(query: str) -> Leaf | Node:
    """What the query asks for. Operands that no operator joins are not combined: the first of them counts. An operator
    without enough operands makes the whole query match nothing."""
    stack: list[Leaf | Node] = []
    for token in postfix(query):
        arity = {"NOT": 1, "AND": 2, "OR": 2}.get(token, 0)
        if len(stack) < arity:
            return EMPTY
        if arity:
            stack[-arity:] = [Node(token, tuple(stack[-arity:]))]
        else:
            stack.append(leaf(token))
    return stack[0] if stack else EMPTY


def leaves(node: Leaf | Node) -> list[Leaf]:
    """Distinct leaves in order of first appearance."""
    found = [node] if isinstance(node, Leaf) else [x for part in node.parts for x in leaves(part)]
    return list(dict.fromkeys(found))
