"""Secret scans: rules as regular expressions, screened by a trigram index of each shard before they run.

From the parse tree of a rule's expression comes a Boolean query: a conjunction of disjunctions of trigrams that every
match must hold, over UTF-8 bytes with A-Z in lower case. A shard is a run of whole texts inside a task. Its inverted
index has, for each trigram that some rule asks for, the texts that hold it. Postings are joined within a disjunction and
intersected over the conjunction; only the texts left are searched with the expression itself. A rule without such
trigrams searches every text. Screening never changes the result.

Matches are leftmost and don't overlap within a rule; a match whose deciding group is shorter than the rule's least
length is dropped afterwards. Null texts count as empty. Rows that repeat, empty tables and texts of any length need no
care: a row's result depends on its text alone. Columns named like the results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from furrow.llm.text_codes import with_scores

OUT_COLS = ("secret_spans",)
#: Fewer strings than this are told apart where a part of an expression can match several.
MOST_STRINGS = 64
_SHARD_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass(frozen=True)
class Rule:
    """A kind of secret: `pattern`, the group that decides, and how long it must be."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The first three kinds, by contract, then public formats of well-known keys. A run of hexadecimal digits
#: is maximal wherever it begins, so its least length stands in the pattern.
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY"),
    Rule("code_host", r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("map_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("payment", r"sk_live_[A-Za-z0-9]+", 0, 24),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("url_login", r"://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$&*+,;=-]+@"),
)
BASE = tuple(r.kind for r in RULES[:3])

Query = frozenset  # of frozensets of trigrams: each of them must have one that occurs


def _strings(code: int) -> set[bytes]:
    """A code point in lower case, as the only string of a set."""
    return {chr(code).encode("utf-8", "replace").translate(_SHARD_LOWER)}


def _some(strings: Iterable[bytes]) -> Query:
    """The query that says that one of the strings occurs; empty if one of them has no trigram."""
    parts = [[s[i : i + 3] for i in range(len(s) - 2)] for s in strings]
    most = max(map(len, parts), default=0)
    if not all(parts):
        return Query()
    # a match holds one of the strings and so all its trigrams: each clause takes one of every string, from left to right
    return Query(frozenset(p[k * (len(p) - 1) // max(1, most - 1)] for p in parts) for k in range(most))


def _of_class(items) -> set[bytes] | None:
    """All strings of a character class, or None for many."""
    out: set[bytes] = set()
    for op, value in items:
        if str(op) == "LITERAL":
            out |= _strings(value)
        elif str(op) == "RANGE" and value[1] - value[0] < MOST_STRINGS:
            for code in range(value[0], value[1] + 1):
                out |= _strings(code)
        else:
            return None
    return out if len(out) <= MOST_STRINGS else None


def _walk(tree) -> tuple[set[bytes] | None, Query]:
    """(all strings that a parse tree matches, in lower case, or None; the query of all its matches)."""
    found: set[frozenset] = set()
    runs: set[bytes] | None = {b""}  # what the parts since the last unknown one can be

    def close():
        nonlocal runs
        found.update(_some(runs or {b""}))
        runs = {b""}

    exact = True
    for op, value in tree:
        strings, query = _part(str(op), value)
        found |= query
        if strings is not None and len(runs) * len(strings) <= MOST_STRINGS:
            runs = {a + b for a, b in product(runs, strings)}
            continue
        exact = False
        close()
        if strings is not None:
            runs = strings
    if exact:
        return runs, Query(found)
    close()
    return None, Query(found)


def _part(op: str, value) -> tuple[set[bytes] | None, Query]:
    if op == "LITERAL":
        return _strings(value), Query()
    if op == "IN":
        return _of_class(value), Query()
    if op == "SUBPATTERN":
        return _walk(value[3])
    if op == "AT":
        return {b""}, Query()
    if op == "BRANCH":
        parts = [_walk(b) for b in value[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS:
            return set().union(*(s for s, _ in parts)), Query()
        each = [q | _some(s) if s is not None else q for s, q in parts]
        # a disjunction of conjunctions: the shortest clause of each branch, together
        return None, Query([frozenset().union(*(min(q, key=len) for q in each))]) if all(each) else Query()
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, body = value
        strings, query = _walk(body)
        if strings is not None and (least, most) == (0, 1):
            return strings | {b""}, Query()
        if least == 0:
            return None, Query()
        if strings is not None and len(strings) ** int(least) <= MOST_STRINGS:
            whole = {b"".join(p) for p in product(strings, repeat=int(least))}
            return (whole, Query()) if least == most else (None, _some(whole))
        return None, query
    return None, Query()


def trigram_query(pattern: str) -> Query:
    """Trigrams that every match of a pattern holds: one of each set. Empty if nothing is mandatory."""
    strings, query = _walk(re._parser.parse(pattern))
    return query | _some(strings) if strings is not None else query


class Screen:
    """Rules with their queries; finds the texts of a shard that each rule must search."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = rules
        self.compiled = [re.compile(r.pattern) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        listed = sorted({t for q in self.queries for some in q for t in some})
        self.number = {t: i for i, t in enumerate(listed)}
        self.slot = np.full(1 << 24, -1, np.int16)
        for t, i in self.number.items():
            self.slot[int.from_bytes(t, "big")] = i

    def postings(self, texts: list[str]) -> list[np.ndarray]:
        """For each trigram that a rule asks for, the texts that hold it, ascending."""
        raw = [t.encode("utf-8").translate(_SHARD_LOWER) for t in texts]
        # three zero bytes between texts: no trigram that is asked for crosses them
        codes = np.frombuffer(b"\0\0\0".join(raw) + b"\0\0\0", np.uint8).astype(np.uint32)
        ends = np.cumsum([len(r) + 3 for r in raw])
        found = self.slot[(codes[:-2] << 16) | (codes[1:-1] << 8) | codes[2:]]
        at = np.flatnonzero(found >= 0)
        keys = np.unique(found[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at, side="right"))
        cuts = np.searchsorted(keys, np.arange(len(self.number) + 1) * len(texts))
        return [keys[a:b] % len(texts) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def candidates(self, texts: list[str]) -> list[np.ndarray]:
        """For each rule, the texts to search."""
        index, out = self.postings(texts), []
        for query in self.queries:
            left = np.arange(len(texts))
            for some in sorted(query, key=len):
                held = np.unique(np.concatenate([index[self.number[t]] for t in some]))
                left = np.intersect1d(left, held, assume_unique=True)
            out.append(left)
        return out

    def find(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) of all secrets of each text, in that order."""
        out: list[list] = [[] for _ in texts]
        for k, (rule, expression, some) in enumerate(zip(self.rules, self.compiled, self.candidates(texts), strict=True)):
            for i in some.tolist():
                out[i] += [(m.start(), k, m.end()) for m in expression.finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return [sorted(found) for found in out]


def find_secrets(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, out_cols: Sequence[str] = OUT_COLS) -> DataFrame:
    """All columns of `df` and an array of (kind, start, end): the secrets of each text in code points, end exclusive."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    held: list[Screen] = []  # made once in each worker

    def score(_, texts):
        if not held:
            held.append(Screen(rules))
        found = held[0].find(texts)
        return [pa.array([[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in f] for f in found], kind)]

    return with_scores(df, text_col, f"`{out_cols[0]}` array<struct<kind:string,start:int,end:int>>", score, None)
