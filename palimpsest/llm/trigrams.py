"""Boolean trigram queries from regular expressions, and block-wise inverted indexes to answer them.

A query is True (every text may match), a trigram, or ("and" | "or", parts). It holds of every text
that the expression matches, after ASCII letters are folded to lower case on both sides.
"""

from __future__ import annotations

from itertools import product

import numpy as np

try:
    from re import _constants as sre
    from re import _parser as parser
except ImportError:  # Python before 3.11
    import sre_constants as sre
    import sre_parse as parser

#: A set of exact strings may grow to so many before it is turned into a query.
EXACT = 64


def fold(s: str) -> bytes:
    """UTF-8 with A-Z in lower case."""
    return s.encode("utf-8", "surrogatepass").lower()


def _both(op: str, parts: list):
    flat: list = []
    for p in parts:
        flat.extend(p[1] if isinstance(p, tuple) and p[0] == op else [p])
    if op == "and":
        flat = [p for p in flat if p is not True]
        if not flat:
            return True
    elif True in flat:
        return True
    flat = sorted(set(flat), key=repr)
    return flat[0] if len(flat) == 1 else (op, tuple(flat))


def _of_strings(strings: set[bytes]):
    """That one of the strings is there."""
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _join(a, b):
    """Each operand is (exact strings or None, query)."""
    (xa, qa), (xb, qb) = a, b
    if xa is not None and xb is not None and len(xa) * len(xb) <= EXACT:
        return {p + q for p, q in product(xa, xb)}, _both("and", [qa, qb])
    known = [_of_strings(x) for x in (xa, xb) if x is not None]
    return None, _both("and", [qa, qb, *known])


def _of(items) -> tuple[set[bytes] | None, object]:
    out: tuple[set[bytes] | None, object] = ({b""}, True)
    parts: list = []
    for op, arg in items:
        if op is sre.LITERAL:
            one = ({fold(chr(arg))}, True)
        elif op is sre.IN:
            one = _of_class(arg)
        elif op is sre.SUBPATTERN:
            one = _of(arg[-1])
        elif op is sre.BRANCH:
            ways = [_of(w) for w in arg[1]]
            if all(x is not None for x, _ in ways) and sum(len(x) for x, _ in ways) <= EXACT:
                one = (set().union(*(x for x, _ in ways)), _both("or", [q for _, q in ways]))
            else:
                one = (None, _both("or", [_both("and", [q, True if x is None else _of_strings(x)]) for x, q in ways]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, getattr(sre, "POSSESSIVE_REPEAT", None)):
            low, high, body = arg
            x, q = _of(body)
            if (low, high) == (0, 1) and x is not None and len(x) < EXACT:
                one = (x | {b""}, True)
            elif low == 0:
                one = (None, True)
            elif x is not None and low == high and len(x) ** low <= EXACT:
                one = ({b"".join(p) for p in product(x, repeat=low)}, q)
            else:
                one = (None, _both("and", [q, True if x is None else _of_strings(x)]))
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            one = ({b""}, True)  # they take no text; what they ask for only narrows
        else:
            one = (None, True)
        before = out
        out = _join(out, one)
        if before[0] is not None and out[0] is None:
            parts.append(out[1])
            out = (one[0], True) if one[0] is not None else ({b""}, True)
            if one[0] is None:
                parts.append(one[1])
    if parts:
        return None, _both("and", [*parts, out[1], True if out[0] is None else _of_strings(out[0])])
    return out


def _of_class(arg):
    chars: set[bytes] = set()
    for op, x in arg:
        if op is sre.LITERAL:
            chars.add(fold(chr(x)))
        elif op is sre.RANGE and x[1] - x[0] < EXACT:
            chars |= {fold(chr(c)) for c in range(x[0], x[1] + 1)}
        else:
            return None, True
    return (chars, True) if len(chars) <= 8 else (None, True)


def query_of(pattern: str, flags: int = 0):
    """The Boolean trigram query that every match of the expression satisfies; True if it has none."""
    exact, query = _of(parser.parse(pattern, flags))
    return _both("and", [query, True if exact is None else _of_strings(exact)])


def trigrams_of(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


def _code(t: bytes) -> int:
    return t[0] << 16 | t[1] << 8 | t[2]


class Index:
    """Postings of one block of texts: for each trigram, the sorted numbers of the texts that hold it.

    ``wanted``: the dictionary, as a Boolean array over all 2^24 trigrams; None keeps every trigram.
    """

    def __init__(self, texts: list[str], wanted: np.ndarray | None = None):
        folded = [fold(t) for t in texts]
        data = np.frombuffer(b"".join(folded), np.uint8).astype(np.uint32)
        ends = np.cumsum([len(f) for f in folded])
        self.n, self.postings = len(texts), {}
        if len(data) < 3:
            return
        codes = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        at = np.arange(len(codes)) if wanted is None else np.flatnonzero(wanted[codes])
        codes, doc = codes[at], np.searchsorted(ends, at, side="right")
        inside = at + 2 < ends[doc]  # not over the end of a text
        pairs = np.unique(codes[inside].astype(np.uint64) << 32 | doc[inside].astype(np.uint64))
        codes, docs = (pairs >> 32).astype(np.uint32), (pairs & 0xFFFFFFFF).astype(np.int64)
        cut = np.flatnonzero(codes[1:] != codes[:-1]) + 1
        for part, first in zip(np.split(docs, cut), codes[np.concatenate(([0], cut)).astype(int)] if len(codes) else (), strict=False):
            self.postings[int(first)] = part

    def search(self, query) -> np.ndarray:
        """Numbers of the texts that satisfy the query."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings.get(_code(query), np.empty(0, np.int64))
        found = [self.search(q) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(found))
        out = found[0]
        for f in sorted(found[1:], key=len):
            if not len(out):
                break
            out = np.intersect1d(out, f, assume_unique=True)
        return out


def dictionary(queries) -> np.ndarray:
    wanted = np.zeros(1 << 24, bool)
    for q in queries:
        for t in trigrams_of(q):
            wanted[_code(t)] = True
    return wanted

