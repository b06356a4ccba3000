"""Secret scan: one minimal automaton of all rules marks where matches begin, in one pass over the bytes.

The rules are turned round, made deterministic together and run from the last byte
to the first: the state after a byte tells which rules have a match that begins
there.  (Forwards the same rules need forty times the states, since the lengths of
several begun matches must be told apart.)  A match then extends from its mark to
its longest end; no byte outside matches is read again, so time is linear in the
text for rules whose matches, once complete, only grow.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .automaton import Automaton, compile_patterns
from .shared import tidy


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  Matches are leftmost-longest and do not overlap within a kind; those failing `keep` are dropped without retry."""

    kind: str
    pattern: str
    ignore_case: bool = False
    least: int = 0  # characters of the match, or of its value
    value: str = ""  # pattern of what precedes the value
    base: bool = False


_KEY = "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
RULES = (
    Rule("assign", _KEY + "[A-Za-z0-9+/_.=-]+", True, 6, _KEY, True),
    Rule("access", "AKIA[A-Z0-9]+", least=20, base=True),
    Rule("hex", "[0-9a-f]+", least=24, base=True),
    # added by the method: public formats of further credentials
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", least=32),
    Rule("hosted_token", "(gh[pousr]_|glpat-|xox[abprs]-)[A-Za-z0-9_-]+", least=20),
    Rule("bearer", "bearer\\x20+[A-Za-z0-9._~+/-]+=*", True, 23),
    Rule("url_login", "[a-z]+://[A-Za-z0-9._%~-]+:[A-Za-z0-9._%~!$&*+-]+@[A-Za-z0-9.-]+"),
)


#: Bytes that are stepped through before asking whether a match began.
PIECE = 2048


def marker(rules) -> Automaton:
    """All rules together, backwards: it accepts where matches begin.

    A rule that is one repeated class with a least length accepts only where a run of
    that length begins (its matches are whole runs, so none is missed).  Other
    lengths are checked on the matches.
    """
    return compile_patterns([(f"{r.pattern[:-1]}{{{r.least},}}" if r.least and re.fullmatch(r"\[[^]]*\]\+", r.pattern) else r.pattern, r.ignore_case) for r in rules], True, backwards=True)


class Compiled:
    """The automata of some rules: one of all rules that marks where matches begin, and one each to find their ends."""

    def __init__(self, rules=RULES):
        self.rules = tuple(rules)
        self.marks = marker(self.rules)
        self.single = [compile_patterns([(r.pattern, r.ignore_case)], False) for r in self.rules]
        self.heads = [compile_patterns([(r.value, r.ignore_case)], False) if r.value else None for r in self.rules]


class Scanner:
    """Finds the spans of all rules in UTF-8 text."""

    def __init__(self, compiled: Compiled):
        self.rules, self.single, self.heads = compiled.rules, compiled.single, compiled.heads
        self.classes, self.start = compiled.marks.linked_rows()

    def marks(self, data: bytes) -> dict[int, list[int]]:
        """Where matches of each rule begin, last first: one table step for each byte, whatever the number of rules.

        Only a piece of the text in which some match begins is stepped through again, for the places.
        """
        found: dict[int, list[int]] = {}
        row, end = self.start, len(data)
        while end > 0:
            head, piece = row, data[max(0, end - PIECE) : end][::-1].translate(self.classes)
            for c in piece:
                row = row[c]
            if row[-1] is not None:
                row = head
                for i, c in enumerate(piece, 1):
                    row = row[c]
                    if row[-1] is not None:
                        for rule in row[-2]:
                            found.setdefault(rule, []).append(end - i)
                        row = row[-1]
            end -= PIECE
        return found

    def located(self, data: bytes, rule: int, marks: list[int]) -> list[tuple[int, int]]:
        """Byte spans of one rule: leftmost, longest, not overlapping."""
        table, accepts, dead = self.single[rule].next, self.single[rule].accepts, self.single[rule].dead
        spans, at = [], 0
        for begin in reversed(marks):
            if begin < at:
                continue
            state = 0
            for i in range(begin, len(data)):
                state = table[state][data[i]]
                if state == dead:
                    break
                if accepts[state]:
                    at = i + 1
            if self._long_enough(data, rule, begin, at):
                spans.append((begin, at))
        return spans

    def _long_enough(self, data: bytes, rule: int, begin: int, end: int) -> bool:
        least = self.rules[rule].least
        if not least or self.heads[rule] is None:
            return end - begin >= least
        head, state, value = self.heads[rule], 0, begin
        for i in range(begin, end):
            state = head.next[state][data[i]]
            if state == head.dead:
                break
            if head.accepts[state]:
                value = i + 1
        # the separator and one quote are matched greedily, but the value has one character at least
        return end - min(value, end - 1) >= least

    def spans(self, data: bytes) -> list[tuple[str, int, int, bool]]:
        """(kind, start, end, base) in code points, by start and then in the order of the rules."""
        found = sorted((a, k, b) for k, marks in self.marks(data).items() for a, b in self.located(data, k, marks))
        if found and not data.isascii():
            inside = np.r_[0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) == 0x80)]
            found = [(a - int(inside[a]), k, b - int(inside[b])) for a, k, b in found]
        return [(self.rules[k].kind, a, b, self.rules[k].base) for a, k, b in found]


def _joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b, _ in spans)


def scan(df: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, counts of the base kinds, base_sha256 and spans.

    Null text counts as empty.  Rows are independent: repeated rows repeat, an empty
    table gives an empty result, and other columns are not read.
    """
    kind = df.schema[doc_id].dataType.simpleString()
    base = [r.kind for r in rules if r.base]

    # compiled once; a few hundred states, whatever the data
    shared = df.sparkSession.sparkContext.broadcast(Compiled(rules))

    def run(batches):
        scanner = Scanner(shared.value)
        for batch in batches:
            out: list[list] = [[] for _ in range(len(base) + 2)]
            for value in batch.column(1).cast(pa.large_string()).cast(pa.large_binary()):
                found = scanner.spans(value.as_py() or b"")
                own = [s for s in found if s[3]]
                for k, name in enumerate(base):
                    out[k].append(sum(s[0] == name for s in own))
                out[-2].append(hashlib.sha256(_joined(own).encode()).hexdigest())
                out[-1].append(_joined(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out[:-2]), pa.array(out[-2], pa.string()), pa.array(out[-1], pa.string())], ["doc_id", *(f"n_{b}" for b in base), "base_sha256", "spans"])

    columns = "".join(f", n_{b} long" for b in base)
    return df.select(doc_id, text).mapInArrow(tidy(run), f"doc_id {kind}{columns}, base_sha256 string, spans string")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over every whole text of documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
