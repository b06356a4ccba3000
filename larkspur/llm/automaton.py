"""A small regex compiler: byte patterns to one minimal deterministic automaton.

Syntax: literals, \\ escapes (\\xHH, \\n, \\t or a literal), [classes] with ranges
and negation, (groups), |, and the quantifiers ? * + {n} {n,} {n,m}.  Patterns
become one non-deterministic automaton (Thompson), are made deterministic by
subset construction over byte classes, and minimised by partition refinement.
"""

from __future__ import annotations

from dataclasses import dataclass, field


class _Parser:
    def __init__(self, pattern: str, nfa: _Nfa, fold: bool):
        self.p, self.i, self.nfa, self.fold = pattern, 0, nfa, fold

    def alternatives(self) -> tuple[int, int]:
        parts = [self.sequence()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        a, b = self.nfa.state(), self.nfa.state()
        for x, y in parts:
            self.nfa.free[a].append(x)
            self.nfa.free[y].append(b)
        return a, b

    def sequence(self) -> tuple[int, int]:
        a = b = self.nfa.state()
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            x, y = self.repeated()
            self.nfa.free[b].append(x)
            b = y
        return a, b

    def repeated(self) -> tuple[int, int]:
        begin = self.i
        part = self.atom()
        end = self.i
        if self.i >= len(self.p) or self.p[self.i] not in "?*+{":
            return part
        low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(self.p[self.i], (0, 0))
        if self.p[self.i] == "{":
            close = self.p.index("}", self.i)
            body = self.p[self.i + 1 : close].split(",")
            low, high = int(body[0]), int(body[0]) if len(body) == 1 else int(body[1]) if body[1] else None
            self.i = close
        self.i += 1
        after = self.i

        def copy() -> tuple[int, int]:
            self.i = begin
            made = self.atom()
            assert self.i == end
            return made

        a = b = self.nfa.state()
        for k in range(low if high is not None else max(low, 1)):
            x, y = part if k == 0 else copy()
            self.nfa.free[b].append(x)
            last, b = (x, y), y
        if high is None:
            x, y = last
            self.nfa.free[y].append(x)
            end_state = self.nfa.state()
            self.nfa.free[b].append(end_state)
            if low == 0:
                self.nfa.free[a].append(end_state)
            b = end_state
        else:
            end_state = self.nfa.state()
            for k in range(high - low):
                self.nfa.free[b].append(end_state)
                x, y = part if low == 0 and k == 0 else copy()
                self.nfa.free[b].append(x)
                b = y
            self.nfa.free[b].append(end_state)
            b = end_state
        self.i = after
        return a, b

    def atom(self) -> tuple[int, int]:
        c = self.p[self.i]
        if c == "(":
            self.i += 3 if self.p.startswith("(?:", self.i) else 1
            part = self.alternatives()
            if self.i >= len(self.p) or self.p[self.i] != ")":
                raise ValueError(f"unclosed group in {self.p}")
            self.i += 1
            return part
        if c == "[":
            return self.step(self.char_class())
        if c == "\\":
            return self.step({self.escape()})
        if c in "?*+{":
            raise ValueError(f"nothing to repeat in {self.p}")
        self.i += 1
        return self.step(set(range(256)) - {10} if c == "." else set(c.encode("latin-1")))

    def escape(self) -> int:
        c = self.p[self.i + 1]
        if c == "x":
            self.i += 4
            return int(self.p[self.i - 2 : self.i], 16)
        self.i += 2
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def char_class(self) -> set[int]:
        self.i += 1
        negated = self.p[self.i] == "^"
        self.i += negated
        found: set[int] = set()
        first = True
        while first or self.p[self.i] != "]":
            first = False
            low = self.one()
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                found |= set(range(low, self.one() + 1))
            else:
                found.add(low)
        self.i += 1
        return set(range(256)) - found if negated else found

    def one(self) -> int:
        if self.p[self.i] == "\\":
            return self.escape()
        self.i += 1
        return ord(self.p[self.i - 1])

    def step(self, chars: set[int]) -> tuple[int, int]:
        if self.fold:
            chars = chars | {c ^ 32 for c in chars if 65 <= c <= 90 or 97 <= c <= 122}
        a, b = self.nfa.state(), self.nfa.state()
        self.nfa.steps[a].append((frozenset(chars), b))
        return a, b


@dataclass
class _Nfa:
    free: list[list[int]] = field(default_factory=list)
    steps: list[list[tuple[frozenset, int]]] = field(default_factory=list)

    def state(self) -> int:
        self.free.append([])
        self.steps.append([])
        return len(self.free) - 1

    def reversed(self) -> _Nfa:
        """The same states with all arrows turned round."""
        out = _Nfa([[] for _ in self.free], [[] for _ in self.steps])
        for s, targets in enumerate(self.free):
            for t in targets:
                out.free[t].append(s)
        for s, steps in enumerate(self.steps):
            for chars, t in steps:
                out.steps[t].append((chars, s))
        return out

    def closure(self, states) -> frozenset:
        seen, stack = set(states), list(states)
        while stack:
            for x in self.free[stack.pop()]:
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        return frozenset(seen)


@dataclass
class Automaton:
    """next[state][byte] is a state; accepts[state] the indices of the patterns that match there; state 0 begins."""

    next: list[list[int]]
    accepts: list[tuple[int, ...]]
    dead: int | None

    def linked_rows(self) -> tuple[bytes, list]:
        """The class of each byte, and the row of the first state, which refers to the rows of the next states by class.

        Each state has two rows.  A step to an accepting state leads to its second row,
        and from there on to second rows only, so a run over many bytes tells by its last
        row alone whether anything was accepted.  Rows end with the accepted patterns of
        the state, and its first row where this is the second one (else None).
        """
        columns = list(zip(*self.next, strict=True))
        number = {c: k for k, c in enumerate(dict.fromkeys(columns))}
        classes = bytes(number[c] for c in columns)
        byte = {k: c for c, k in reversed(list(enumerate(classes)))}
        plain: list = [[] for _ in self.next]
        met: list = [[] for _ in self.next]
        for s, (targets, accepted) in enumerate(zip(self.next, self.accepts, strict=True)):
            after = [targets[byte[k]] for k in range(len(number))]
            plain[s] += [*((met if self.accepts[t] else plain)[t] for t in after), accepted, None]
            met[s] += [*(met[t] for t in after), accepted, plain[s]]
        return classes, plain[0]


def compile_patterns(patterns: list[tuple[str, bool]], anywhere: bool, backwards: bool = False) -> Automaton:
    """One minimal automaton for (pattern, ignore ASCII case) pairs; anywhere: matches may begin at any byte.

    backwards: for the reversed matches, to be run from the last byte to the first.
    """
    nfa = _Nfa()
    ends = []
    for pattern, fold in patterns:
        parser = _Parser(pattern, nfa, fold)
        ends.append(parser.alternatives())
        if parser.i != len(pattern):
            raise ValueError(f"unbalanced ) in {pattern}")
    if backwards:
        nfa, ends = nfa.reversed(), [(b, a) for a, b in ends]
    start, final = nfa.state(), {b: k for k, (_, b) in enumerate(ends)}
    nfa.free[start] += [a for a, _ in ends]
    # bytes that no step tells apart share a class
    signature: dict[int, list] = {c: [] for c in range(256)}
    every = {chars for steps in nfa.steps for chars, _ in steps}
    for n, chars in enumerate(sorted(every, key=sorted)):
        for c in chars:
            signature[c].append(n)
    classes: dict[tuple, int] = {}
    of_byte = [classes.setdefault(tuple(signature[c]), len(classes)) for c in range(256)]
    sample = {k: c for c, k in reversed(list(enumerate(of_byte)))}
    # sets of states are bit masks; moves[s][k]: what state s leads to by class k, closed
    closed = [sum(1 << t for t in nfa.closure({s})) for s in range(len(nfa.free))]
    moves: dict[int, list[int]] = {}
    for s, steps in enumerate(nfa.steps):
        if steps:
            row = [0] * len(classes)
            for chars, t in steps:
                for k, c in sample.items():
                    if c in chars:
                        row[k] |= closed[t]
            moves[s] = row
    active = sum(1 << s for s in moves)
    begin = closed[start]
    number, order, table = {begin: 0}, [begin], []
    for states in order:
        row = [begin if anywhere else 0] * len(classes)
        rest = states & active
        while rest:
            low = rest & -rest
            rest ^= low
            row = [a | b for a, b in zip(row, moves[low.bit_length() - 1], strict=True)]
        for target in row:
            if target not in number:
                number[target] = len(order)
                order.append(target)
        table.append([number[t] for t in row])
    accepts = [tuple(sorted(k for s, k in final.items() if states >> s & 1)) for states in order]
    # Moore's refinement: split blocks until equal states agree on all classes
    block = {a: i for i, a in enumerate(dict.fromkeys(accepts))}
    part = [block[a] for a in accepts]
    while True:
        keys: dict[tuple, int] = {}
        new = [keys.setdefault((part[s], *(part[t] for t in table[s])), len(keys)) for s in range(len(table))]
        if len(keys) == len(set(part)):
            break
        part = new
    first = {}
    for s, b in enumerate(part):
        first.setdefault(b, s)
    renamed = {b: i for i, b in enumerate(first)}
    small = [[renamed[part[table[s][of_byte[c]]]] for c in range(256)] for s in first.values()]
    kept = [accepts[s] for s in first.values()]
    dead = next((i for i, row in enumerate(small) if not kept[i] and all(t == i for t in row)), None)
    return Automaton(small, kept, dead)
