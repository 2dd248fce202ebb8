"""Secret scan by one combined deterministic automaton.

All rule expressions are compiled together: Thompson fragments, subset
construction of the unanchored union, Moore minimisation, and a flat
transition array indexed by state and byte.  A text is scanned in a single
pass over its UTF-8 bytes, whatever the number of rules; the state reached
tells which rules have a match ending there.  Only where one does, the rule's
own reverse automaton finds where that match starts and its forward automaton
how far it reaches (leftmost, longest, non-overlapping per rule).

The automata are built once on the driver (their size depends on the rules
alone) and travel with the function; rows are mapped in Arrow batches, nothing
is shuffled.

Cases: a null text counts as empty and has no span; texts of any length are
scanned whole; offsets are code points, end exclusive; equal or repeated rows
give equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from salescope.llm.common import ship_package


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds a match as soon as it can be one; a match counts if it
    reaches at least ``more`` bytes beyond that point."""
    kind: str
    pattern: str
    more: int = 0
    base: bool = True


# The base rules.  Lengths: a value of 12 characters, 18 with the
# AKIA prefix, 16 hex digits.  Long counts behind a rare prefix are left to
# ``more``, which keeps the combined automaton small.
RULES = [
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
                   r"[A-Za-z0-9+/_.=-]+", more=11),
    Rule("access", r"AKIA[A-Z0-9]+", more=13),
    Rule("hex", r"[0-9a-f]{16,}"),
    # Added by this operator.
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", more=35, base=False),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
]

# ---------------------------------------------------------------- expressions
# Trees: ("set", bytes), ("cat", [..]), ("alt", [..]), ("rep", tree, low, high)


def parse(pattern: str):
    """Literals, \\xHH and escaped characters, classes, groups, (?i:...), |,
    ?, *, + and {m,n}: what secret rules are written in."""
    pos = 0

    def peek() -> str:
        return pattern[pos] if pos < len(pattern) else ""

    def char() -> int:
        nonlocal pos
        c = pattern[pos]
        pos += 1
        if c != "\\":
            return ord(c)
        e = pattern[pos]
        pos += 1
        if e == "x":
            pos += 2
            return int(pattern[pos - 2:pos], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(e, e))

    def klass() -> frozenset[int]:
        nonlocal pos
        inverted = peek() == "^"
        pos += inverted
        out: set[int] = set()
        while peek() != "]":
            a = char()
            if peek() == "-" and pattern[pos + 1] != "]":
                pos += 1
                out.update(range(a, char() + 1))
            else:
                out.add(a)
        pos += 1
        return frozenset(range(256)) - out if inverted else frozenset(out)

    def atom(fold: bool):
        nonlocal pos
        if peek() == "(":
            pos += 1
            inner = fold
            if pattern.startswith("?i:", pos):
                pos, inner = pos + 3, True
            tree = either(inner)
            pos += 1
            return tree
        if peek() == "[":
            pos += 1
            s = klass()
        else:
            s = frozenset([char()])
        if fold:
            s = s | {b ^ 32 for b in s if chr(b).isascii() and chr(b).isalpha()}
        return ("set", s)

    def repeated(fold: bool):
        nonlocal pos
        tree = atom(fold)
        while peek() and peek() in "?*+{":
            c = peek()
            pos += 1
            if c == "{":
                end = pattern.index("}", pos)
                low, _, high = pattern[pos:end].partition(",")
                most = int(high) if high else (None if "," in pattern[pos:end] else int(low))
                tree, pos = ("rep", tree, int(low), most), end + 1
            else:
                tree = ("rep", tree, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        return tree

    def sequence(fold: bool):
        parts = []
        while peek() and peek() not in "|)":
            parts.append(repeated(fold))
        return ("cat", parts)

    def either(fold: bool):
        nonlocal pos
        parts = [sequence(fold)]
        while peek() == "|":
            pos += 1
            parts.append(sequence(fold))
        return parts[0] if len(parts) == 1 else ("alt", parts)

    return either(False)


def reverse(tree):
    op = tree[0]
    if op == "set":
        return tree
    if op == "rep":
        return ("rep", reverse(tree[1]), *tree[2:])
    parts = [reverse(t) for t in tree[1]]
    return (op, parts[::-1] if op == "cat" else parts)


class Fragments:
    """A nondeterministic automaton: byte edges and empty edges by state."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, tree, start: int) -> int:
        """Builds ``tree`` from ``start``; returns its end state."""
        op = tree[0]
        if op == "set":
            end = self.state()
            self.edges[start].append((tree[1], end))
            return end
        if op == "cat":
            for t in tree[1]:
                start = self.add(t, start)
            return start
        end = self.state()
        if op == "alt":
            for t in tree[1]:
                own = self.state()
                self.empty[start].append(own)
                self.empty[self.add(t, own)].append(end)
            return end
        _, inner, low, high = tree
        for _ in range(low):
            start = self.add(inner, start)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(inner, loop)].append(loop)
            self.empty[loop].append(end)
        else:
            for _ in range(high - low):
                self.empty[start].append(end)
                start = self.add(inner, start)
            self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)


@dataclass
class Automaton:
    """``move[256 * state + byte]`` is 256 * next state; states from ``accept``
    on (times 256) accept, ``rules[state]`` says which rules.  State 0 starts.
    ``dead`` is the state that leads nowhere (-1: none)."""
    move: list[int]
    accept: int
    rules: list[tuple[int, ...]]
    dead: int


def compile_automaton(trees: list, unanchored: bool) -> Automaton:
    nfa = Fragments()
    start = nfa.state()
    finals = {}
    for i, t in enumerate(trees):
        own = nfa.state()
        nfa.empty[start].append(own)
        finals[nfa.add(t, own)] = i
    # Bytes that no edge tells apart move alike.
    alike: dict[tuple, list[int]] = {}
    sets = list({s for es in nfa.edges for s, _ in es})
    for b in range(256):
        alike.setdefault(tuple(b in s for s in sets), []).append(b)
    classes = list(alike.values())
    # Subset construction.
    first = nfa.closure([start])
    number, todo, table = {first: 0}, [first], []
    while todo:
        subset = todo.pop(0)
        row = []
        for c in classes:
            to = {t for q in subset for s, t in nfa.edges[q] if c[0] in s}
            nxt = nfa.closure(to | {start} if unanchored else to)
            if nxt not in number:
                number[nxt] = len(number)
                todo.append(nxt)
            row.append(number[nxt])
        table.append(row)
    marks = [tuple(sorted({finals[q] for q in s if q in finals})) for s in number]
    # Minimisation: split blocks until all states of a block move alike.
    names = {m: i for i, m in enumerate(dict.fromkeys(marks))}
    block = [names[m] for m in marks]
    while True:
        seen: dict[tuple, int] = {}
        new = [seen.setdefault((block[q], *(block[t] for t in table[q])), len(seen))
               for q in range(len(table))]
        if len(seen) == len(set(block)):
            break
        block = new
    # Number the blocks: start first, accepting ones last.
    one = {b: q for q, b in reversed(list(enumerate(block)))}
    order = sorted(one, key=lambda b: (b != block[0], bool(marks[one[b]])))
    place = {b: i for i, b in enumerate(order)}
    move, rules = [0] * (256 * len(order)), [()] * len(order)
    for b, i in place.items():
        rules[i] = marks[one[b]]
        for c, t in zip(classes, table[one[b]]):
            for byte in c:
                move[256 * i + byte] = 256 * place[block[t]]
    n = sum(1 for r in rules if not r)
    dead = next((i * 256 for i in range(len(order)) if not rules[i]
                 and all(move[256 * i + x] == 256 * i for x in range(256))), -1)
    return Automaton(move, 256 * n, rules, dead)


@dataclass
class Scanner:
    """The combined automaton and each rule's own two, for match ends."""
    rules: list[Rule]
    combined: Automaton
    forward: list[Automaton]
    backward: list[Automaton]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes, sorted."""
        move, accept = self.combined.move, self.combined.accept
        state, found = 0, []
        free = [0] * len(self.rules)    # where a rule's next match may start
        for i, b in enumerate(data):
            state = move[state + b]
            if state >= accept:
                for r in self.combined.rules[state >> 8]:
                    if i >= free[r]:
                        start = reach(self.backward[r], data, i, free[r] - 1, -1)
                        if start is not None:
                            end = reach(self.forward[r], data, start, len(data), 1) + 1
                            free[r] = end
                            if end - 1 - i >= self.rules[r].more:
                                found.append((start, r, end))
        return sorted(found)


def reach(a: Automaton, data: bytes, at: int, stop: int, step: int) -> int | None:
    """Furthest index from ``at`` (towards ``stop``, exclusive) at which the
    automaton accepts what it has read."""
    state, last = 0, None
    for j in range(at, stop, step):
        state = a.move[state + data[j]]
        if state >= a.accept:
            last = j
        elif state == a.dead:
            break
    return last


def compile_rules(rules: list[Rule] = RULES) -> Scanner:
    trees = [parse(r.pattern) for r in rules]
    return Scanner(rules, compile_automaton(trees, unanchored=True),
                   [compile_automaton([t], unanchored=False) for t in trees],
                   [compile_automaton([reverse(t)], unanchored=False) for t in trees])


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets to code points, walking the text once."""
    if data.isascii() or not spans:
        return spans
    at, n, where = 0, 0, {}
    for o in sorted({x for s, _, e in spans for x in (s, e)}):
        n += len(data[at:o].decode("utf-8", "ignore"))
        at = o
        where[o] = n
    return [(where[s], r, where[e]) for s, r, e in spans]


def find_secrets(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id and ``found``: array of (kind, start, end, base)."""
    return _scan(docs, rules, "found array<struct<kind:string,start:int,end:int,base:boolean>>",
                 lambda spans: [[{"kind": rules[r].kind, "start": s, "end": e,
                                  "base": rules[r].base} for s, r, e in spans]])


def secret_digest(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Counts and digests of the spans of every document."""
    def columns(spans):
        text = [(f"{rules[r].kind}:{s}:{e}", rules[r]) for s, r, e in spans]
        n = {k: sum(1 for _, x in text if x.kind == k) for k in ("assign", "access", "hex")}
        base = ",".join(t for t, x in text if x.base)
        return [*n.values(), hashlib.sha256(base.encode()).hexdigest(),
                ",".join(t for t, _ in text)]

    return _scan(docs, rules, "n_assign long, n_access long, n_hex long, base_sha256 string, "
                              "spans string", columns)


def _scan(docs: DataFrame, rules: list[Rule], schema: str, columns: Callable) -> DataFrame:
    ship_package(docs.sparkSession)
    scanner = compile_rules(rules)
    out = docs.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type
        types = [to_arrow_type(f.dataType) for f in out]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                data = text.as_buffer() if text.is_valid else None
                data = data.to_pybytes() if data is not None else b""
                rows.append(columns(in_code_points(data, scanner.spans(data))))
            cols = list(zip(*rows)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(list(c), t) for c, t in zip(cols, types)]],
                names=["doc_id", *out.names])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {schema}")
