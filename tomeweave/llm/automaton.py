"""Regular expressions to minimal byte automata, by subset construction and partition refinement.

The syntax is what secret rules need: literals, escapes (``\\x41``, ``\\.``), byte
classes, groups, ``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}`` and ``{m,n}``. Patterns are ASCII.
"""

from __future__ import annotations

from dataclasses import dataclass

EPSILON = None


@dataclass(frozen=True)
class Node:
    """kind: 'set' (bytes), 'cat', 'or' (parts), 'rep' (part, least, most or None)."""

    kind: str
    parts: tuple = ()
    least: int = 0
    most: int | None = None
    chars: frozenset = frozenset()


class _Reader:
    def __init__(self, pattern: str, any_case: bool):
        self.s, self.at, self.any_case = pattern, 0, any_case

    def peek(self) -> str:
        return self.s[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.s[self.at - 1]

    def chars(self, found: set[int]) -> Node:
        if self.any_case:
            found = found | {c ^ 32 for c in found if chr(c).isalpha()}
        return Node("set", chars=frozenset(found))

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.s[self.at - 2 : self.at], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def one_of(self) -> Node:
        inverse = self.peek() == "^"
        self.at += inverse
        found: set[int] = set()
        while self.peek() != "]":
            low = self.escape() if (c := self.take()) == "\\" else ord(c)
            high = low
            if self.peek() == "-" and self.s[self.at + 1] != "]":
                self.at += 1
                high = self.escape() if (c := self.take()) == "\\" else ord(c)
            found.update(range(low, high + 1))
        self.at += 1
        return self.chars(set(range(256)) - found if inverse else found)

    def atom(self) -> Node:
        c = self.take()
        if c == "(":
            if self.s.startswith("?:", self.at):
                self.at += 2
            inner = self.either()
            if self.take() != ")":
                raise ValueError(f"unbalanced group in {self.s!r}")
            return inner
        if c == "[":
            return self.one_of()
        if c in "*+?{)":
            raise ValueError(f"unexpected {c!r} in {self.s!r}")
        return self.chars({self.escape() if c == "\\" else ord(c)})

    def repeated(self) -> Node:
        node = self.atom()
        while (c := self.peek()) and c in "*+?{":
            self.at += 1
            if c == "{":
                end = self.s.index("}", self.at)
                low, comma, high = self.s[self.at : end].partition(",")
                self.at = end + 1
                least, most = int(low), int(high) if high else None if comma else int(low)
            else:
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            node = Node("rep", (node,), least, most)
        return node

    def sequence(self) -> Node:
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())
        return Node("cat", tuple(parts))

    def either(self) -> Node:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))


def parse(pattern: str, any_case: bool = False) -> Node:
    reader = _Reader(pattern, any_case)
    node = reader.either()
    if reader.at != len(pattern):
        raise ValueError(f"unbalanced group in {pattern!r}")
    return node


def mirrored(node: Node) -> Node:
    """The expression of the reversed strings."""
    parts = tuple(mirrored(x) for x in node.parts)
    return Node(node.kind, parts[::-1] if node.kind == "cat" else parts, node.least, node.most, node.chars)


class _Nfa:
    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset | None, int]]] = []

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def add(self, node: Node, begin: int) -> int:
        """Appends the node's states after ``begin``; returns its last state."""
        if node.kind == "set":
            end = self.state()
            self.edges[begin].append((node.chars, end))
            return end
        if node.kind == "cat":
            for part in node.parts:
                begin = self.add(part, begin)
            return begin
        end = self.state()
        if node.kind == "or":
            for part in node.parts:
                entry = self.state()
                self.edges[begin].append((EPSILON, entry))
                self.edges[self.add(part, entry)].append((EPSILON, end))
            return end
        for _ in range(node.least):
            begin = self.add(node.parts[0], begin)
        if node.most is None:
            loop = self.state()
            self.edges[begin].append((EPSILON, loop))
            self.edges[self.add(node.parts[0], loop)].append((EPSILON, loop))
            self.edges[loop].append((EPSILON, end))
            return end
        for _ in range(node.most - node.least):
            self.edges[begin].append((EPSILON, end))
            begin = self.add(node.parts[0], begin)
        self.edges[begin].append((EPSILON, end))
        return end

    def closure(self, states: set[int]) -> frozenset:
        todo, found = list(states), set(states)
        while todo:
            for label, to in self.edges[todo.pop()]:
                if label is EPSILON and to not in found:
                    found.add(to)
                    todo.append(to)
        return frozenset(found)


@dataclass
class Automaton:
    """``table[state][byte]`` is the next state; ``accepts[state]`` has bit k for rule k. State 0 begins; ``dead`` never accepts again, or is -1."""

    table: list[list[int]]
    accepts: list[int]
    dead: int


def compile_rules(nodes: list[Node], anywhere: bool) -> Automaton:
    """One minimal automaton for all rules; ``anywhere``: a match may begin at any byte."""
    nfa, ends = _Nfa(), {}
    root = nfa.state()
    for k, node in enumerate(nodes):
        entry = nfa.state()
        nfa.edges[root].append((EPSILON, entry))
        ends[nfa.add(node, entry)] = 1 << k
    start = nfa.closure({root})
    # Bytes that no label tells apart share a class.
    labels = {label for edges in nfa.edges for label, _ in edges if label is not EPSILON}
    by_class: dict[tuple, int] = {}
    class_of = [by_class.setdefault(tuple(b in x for x in labels), len(by_class)) for b in range(256)]
    example = {c: b for b, c in enumerate(class_of)}
    number, todo, moves = {start: 0}, [start], []
    while len(moves) < len(todo):
        here, row = todo[len(moves)], []
        for c in range(len(by_class)):
            b = example[c]
            to = nfa.closure({t for s in here for label, t in nfa.edges[s] if label is not EPSILON and b in label} | ({root} if anywhere else set()))
            if to not in number:
                number[to] = len(todo)
                todo.append(to)
            row.append(number[to])
        moves.append(row)
    accepts = []
    for states in todo:
        bits = 0
        for s in states:
            bits |= ends.get(s, 0)
        accepts.append(bits)
    # Partition refinement: split by accepted rules, then by where the classes lead.
    part = accepts
    while True:
        seen: dict[tuple, int] = {}
        new = [seen.setdefault((part[s], *(part[t] for t in moves[s])), len(seen)) for s in range(len(moves))]
        if len(seen) == len(set(part)):
            break
        part = new
    first = {p: s for s, p in reversed(list(enumerate(new)))}
    order = sorted(first, key=lambda p: (p != new[0], p))
    place = {p: k for k, p in enumerate(order)}
    table = [[place[new[moves[first[p]][class_of[b]]]] for b in range(256)] for p in order]
    kept = [accepts[first[p]] for p in order]
    dead = next((k for k, row in enumerate(table) if not kept[k] and set(row) == {k}), -1)
    return Automaton(table, kept, dead)
