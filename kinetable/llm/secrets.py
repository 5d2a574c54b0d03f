"""Secret scans: the rules of a set as one deterministic automaton that reads each byte once.

Each rule's regular expression becomes a byte automaton (Thompson), the union of all rules is made
deterministic by subset construction, its states are merged by partition refinement, and the result is
stored as rows of transitions.  A scan walks these rows over the UTF-8 bytes of a text, once for all
rules.  Where the walk says that a match of a rule ends, the rule's backward automaton finds the
leftmost start after the rule's last match and its forward automaton the longest end, which may lie
behind the pattern where the rule says what follows it (the body of a key behind its header).

Rules must be such that a match which begins later does not end before one that began earlier; all
rules here are (their inner parts cannot hold a second head and separator).

Edge cases: null and empty texts have no spans; repeated rows are scanned one by one; ties (two kinds
over the same place) are all reported, in start order, then in the order of the rules; other columns of
the table play no part.
"""

from __future__ import annotations

import re._constants as C
import re._parser as P
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import blobs, query, slices, table, two_columns


@dataclass(frozen=True)
class Rule:
    """``least`` bounds the length of the whole match, ``tail`` that from the first byte with which the rule can end.

    ``more`` may follow the pattern, may be empty, and belongs to the match as far as it goes.
    """

    kind: str
    pattern: str
    least: int = 1
    tail: int = 1
    more: str = ""


#: What follows a key's header: anything that armour, quoting or source code puts between it and the end line; or, if the end
#: is missing, header lines, long runs of base64 and a last one.  Neither runs over a second header.
BLANK = r"""(?:[\x20\t\r\n"',>|#*]|\\[nrt\r\n])"""
GAP = rf"(?:{BLANK}+(?:[+]{BLANK}+)*)"
KEY_BODY = (
    r"""(?:(?:[A-Za-z0-9+/=\x20\t\r\n\\"'`,:;.()<>|#*&@_]|-[A-Za-z0-9])*-----END\x20[A-Z\x20]*PRIVATE\x20KEY-----"""
    rf"""|(?:{GAP}(?:Proc-Type|DEK-Info):\x20*(?:[A-Za-z0-9,]|-[A-Za-z0-9])*)*(?:(?:{GAP}[A-Za-z0-9+/=]{{16,}})+(?:{GAP}[A-Za-z0-9+/=]+)?|{BLANK}*(?:[\r\n]|\\n){BLANK}*[A-Za-z0-9+/=]+)?)?"""
)


#: The first three are the base rules.  A run of hexadecimal digits shorter than its bound can't match, so part of
#: the bound stands in the pattern: ordinary words then end no match, and the automaton stays small.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", tail=8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{8,}", least=32),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", least=40),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]+", least=24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", more=KEY_BODY),
)
BASE = ("assign", "access", "hex")


class Nfa:
    """Byte automaton with empty moves."""

    def __init__(self) -> None:
        self.empty: dict[int, set[int]] = defaultdict(set)
        self.moves: dict[int, list[tuple[frozenset[int], int]]] = defaultdict(list)
        self.size = 0

    def state(self) -> int:
        self.size += 1
        return self.size - 1

    def add(self, tree: Iterable, at: int, fold: bool = False) -> int:
        """Append a parsed expression behind state ``at``; returns the state behind it."""
        for op, arg in tree:
            at = self._one(op, arg, at, fold)
        return at

    def _bytes(self, chars: frozenset[int], at: int) -> int:
        to = self.state()
        self.moves[at].append((chars, to))
        return to

    def _one(self, op, arg, at: int, fold: bool) -> int:
        if op is C.LITERAL:
            return self._bytes(_folded({arg}, fold), at)
        if op is C.IN:
            chars: set[int] = set()
            for kind, value in arg:
                if kind is C.LITERAL:
                    chars.add(value)
                elif kind is C.RANGE:
                    chars.update(range(value[0], value[1] + 1))
                else:
                    raise ValueError(f"{kind} isn't supported in a rule")
            return self._bytes(_folded(chars, fold), at)
        if op is C.BRANCH:
            end = self.state()
            for branch in arg[1]:
                self.empty[self.add(branch, at, fold)].add(end)
            return end
        if op is C.SUBPATTERN:
            return self.add(arg[3], at, fold or bool(arg[1] & P.SRE_FLAG_IGNORECASE))
        if op is C.MAX_REPEAT:
            low, high, body = arg
            for _ in range(low):
                at = self.add(body, at, fold)
            if high is C.MAXREPEAT:
                loop = self.state()
                self.empty[at].add(loop)
                self.empty[self.add(body, loop, fold)].add(loop)
                return loop
            end = self.state()
            for _ in range(high - low):
                self.empty[at].add(end)
                at = self.add(body, at, fold)
            self.empty[at].add(end)
            return end
        raise ValueError(f"{op} isn't supported in a rule")

    def reversed(self) -> "Nfa":
        out = Nfa()
        out.size = self.size
        for a, to in self.empty.items():
            for b in to:
                out.empty[b].add(a)
        for a, moves in self.moves.items():
            for chars, b in moves:
                out.moves[b].append((chars, a))
        return out

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for b in self.empty[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return frozenset(seen)


def _folded(chars: set[int], fold: bool) -> frozenset[int]:
    if max(chars) > 127:
        raise ValueError("rules are made of ASCII characters")
    both = {ord(x) for c in chars for x in (chr(c).lower(), chr(c).upper())} if fold else chars
    return frozenset(both)


class Dfa:
    """Minimal deterministic automaton: ``rows[state][byte]`` is the next row, ``rows[state][256]`` what ends there.

    ``transitions`` holds a number per class of bytes that no rule tells apart.

    ``restart`` keeps the first state alive, so that a match may begin at any byte.
    """

    def __init__(self, nfa: Nfa, starts: Iterable[int], ends: dict[int, int], restart: bool) -> None:
        first = nfa.closure(starts)
        used = list(dict.fromkeys(chars for moves in nfa.moves.values() for chars, _ in moves))
        alike: dict[tuple[bool, ...], int] = {}
        self.kind_of_byte = [alike.setdefault(tuple(c in chars for chars in used), len(alike)) for c in range(256)]
        example = [self.kind_of_byte.index(k) for k in range(len(alike))]
        known, order, table_, marks = {first: 0}, [first], [], []
        for subset in order:  # grows while it is walked
            row = []
            for c in example:
                targets = {b for a in subset for chars, b in nfa.moves[a] if c in chars}
                to = nfa.closure(targets | set(starts) if restart else targets)
                if to not in known:
                    known[to] = len(order)
                    order.append(to)
                row.append(known[to])
            table_.append(row)
            marks.append(tuple(sorted({ends[a] for a in subset if a in ends})))
        group = self._merged(table_, marks)
        self.dead = group[known[frozenset()]] if frozenset() in known else -1
        count = max(group) + 1
        self.transitions: list[list[int]] = [[]] * count
        self.marks: list[tuple[int, ...]] = [()] * count
        for s, g in enumerate(group):
            self.transitions[g] = [group[t] for t in table_[s]]
            self.marks[g] = marks[s]
        self.first = group[0]
        self.link()

    @staticmethod
    def _merged(rows: list[list[int]], marks: list[tuple]) -> list[int]:
        """Number of each state's class: split by marks, then by the classes that the bytes lead to."""
        names: dict = {}
        group = [names.setdefault(m, len(names)) for m in marks]
        while True:
            names = {}
            finer = [names.setdefault((group[s], tuple(group[t] for t in row)), len(names)) for s, row in enumerate(rows)]
            if len(names) == max(group) + 1:
                return group
            group = finer

    def link(self) -> None:
        self.rows: list[list] = [[] for _ in self.transitions]
        for s, row in enumerate(self.rows):
            row.extend(self.rows[self.transitions[s][k]] for k in self.kind_of_byte)
            row.append(self.marks[s])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "rows"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.link()


class Scanner:
    """All rules of a set, compiled."""

    def __init__(self, rules: Iterable[Rule] = RULES) -> None:
        self.rules = tuple(rules)
        whole = Nfa()
        starts, ends = [], {}
        self.forward: list[Dfa] = []
        self.backward: list[Dfa] = []
        for k, rule in enumerate(self.rules):
            tree = P.parse(rule.pattern)
            starts.append(whole.state())
            ends[whole.add(tree, starts[-1])] = k
            own = Nfa()
            a = own.state()
            b = own.add(tree, a)
            longer = Nfa()
            longer.state()
            self.forward.append(Dfa(longer, [0], {longer.add(P.parse(rule.pattern + rule.more), 0): 0}, restart=False))
            self.backward.append(Dfa(own.reversed(), [b], {a: 0}, restart=False))
        self.combined = Dfa(whole, starts, ends, restart=True)

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, sorted."""
        row, found, free = self.combined.rows[self.combined.first], [], [0] * len(self.rules)
        for i, c in enumerate(data):
            row = row[c]
            if row[256]:
                for k in row[256]:
                    if i >= free[k]:
                        start = self._start(k, data, i, free[k])
                        if start is not None:
                            first, end = self._end(k, data, start)
                            free[k] = end
                            rule = self.rules[k]
                            if end - start >= rule.least and end - first + 1 >= rule.tail:
                                found.append((start, k, end))
        return sorted(found)

    def _start(self, k: int, data: bytes, last: int, free: int) -> int | None:
        dfa = self.backward[k]
        row, dead, best = dfa.rows[dfa.first], dfa.rows[dfa.dead], None
        for i in range(last, free - 1, -1):
            row = row[data[i]]
            if row is dead:
                break
            if row[256]:
                best = i
        return best

    def _end(self, k: int, data: bytes, start: int) -> tuple[int, int]:
        dfa = self.forward[k]
        row, dead, first, best = dfa.rows[dfa.first], dfa.rows[dfa.dead], -1, start
        for i in range(start, len(data)):
            row = row[data[i]]
            if row is dead:
                break
            if row[256]:
                best = i + 1
                first = best if first < 0 else first
        return first, best


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans in code points; only the text up to the last span is decoded."""
    if not spans:
        return spans
    marks = sorted({x for s, _, e in spans for x in (s, e)})
    at, seen, where = 0, 0, {}
    for m in marks:
        seen += len(data[at:m].decode("utf-8", "replace"))
        at, where[m] = m, seen
    return [(where[s], k, where[e]) for s, k, e in spans]


SCHEMA = "doc_id long, spans array<struct<kind:string, start:long, end:long>>"


def scan_secrets(docs: DataFrame, rules: Iterable[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its key and all spans found, sorted by start, then in the order of the rules.

    Narrow: no shuffle; the automaton travels with the task and does not depend on the data.
    """
    scanner = Scanner(rules)
    kinds = [r.kind for r in scanner.rules]
    kind_of = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 8 << 20):
            out = []
            for data in blobs(batch.column("_text")):
                out.append([{"kind": kinds[k], "start": s, "end": e} for s, k, e in code_points(data, scanner.spans(data))])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(out, pa.list_(kind_of))], ["doc_id", "spans"])

    return two_columns(docs, key, text).mapInArrow(run, SCHEMA)


def redact_secrets(docs: DataFrame, rules: Iterable[Rule] = RULES, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """The rows of ``docs`` with every span found in ``text`` replaced; overlapping spans become one mask. Null stays null."""
    scanner = Scanner(rules)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = mask.encode()
        for batch in slices(batches, text, 8 << 20):
            out = []
            for data in batch.column(at).cast(pa.binary()).to_pylist():
                spans = scanner.spans(data) if data else []
                parts, end = [], 0
                for s, _, e in spans:
                    if s >= end:
                        parts += [data[end:s], cover]
                    end = max(end, e)
                out.append(b"".join([*parts, data[end:]]) if spans else data)
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of ``scan_secrets``: one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spans in batch.column("spans").to_pylist():
                told = [(x["kind"], f"{x['kind']}:{x['start']}:{x['end']}") for x in spans]
                base = ",".join(t for k, t in told if k in BASE)
                rows.append([*(sum(k == b for k, _ in told) for b in BASE), sha256(base.encode()).hexdigest(), ",".join(t for _, t in told)])
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return found.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


@query("op7_secrets")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(scan_secrets(table(spark, sf_dir, "documents")))
