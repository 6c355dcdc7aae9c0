"""Regular expressions to recognisers.

Literals, escapes (``\\n \\r \\t \\xHH \\OOO``), ``. \\d \\s \\S``, classes with
ranges and negation, groups, alternation, ``* + {n} {n,m}`` (no ``?``);
unanchored unless ``^`` / ``$``. Alternatives add weights, so an ambiguous
expression weighs the number of its derivations.
"""

from __future__ import annotations

from weft.operators import algebra as A
from weft.operators import graph as G
from weft.plans.machine import Edge, Machine

PRINTABLE = [chr(c) for c in (9, 10, 11, 12, 13, *range(32, 127))]
SPACES = set(" \t\n\r\v\f")


def regex(text: str, alphabet=None) -> Machine:
    alphabet = PRINTABLE if alphabet is None else A._alphabet(alphabet)
    start = text.startswith("^")
    end = text.endswith("$") and not text.endswith("\\$")
    body = text[start : len(text) - 1 if end else len(text)]
    m = _Parser(body, alphabet).parse()
    wild = A.wild("recognize", alphabet)
    if not start:
        m = A.concat(wild, m)
    if not end:
        m = A.concat(m, wild)
    return A.strip_names(G.eliminate_states(G.ergodic(m)))


def _choice(symbols) -> Machine:
    return Machine([[Edge(1, c) for c in symbols], []])


class _Parser:
    def __init__(self, text, alphabet):
        self.t, self.i, self.alphabet = text, 0, alphabet

    def parse(self) -> Machine:
        m = self.alternatives()
        if self.i != len(self.t):
            raise ValueError(f"can't read regular expression at {self.t[self.i :]!r}")
        return m

    def more(self, stops=""):
        return self.i < len(self.t) and self.t[self.i] not in stops

    def next(self):
        if self.i >= len(self.t):
            raise ValueError("regular expression ends too early")
        self.i += 1
        return self.t[self.i - 1]

    def alternatives(self):
        m = self.sequence()
        while self.more() and self.t[self.i] == "|":
            self.i += 1
            m = A.union(m, self.sequence())
        return m

    def sequence(self):
        m = A.null()
        while self.more("|)"):
            m = A.concat(m, self.quantified())
        return m

    def quantified(self):
        m = self.atom()
        while self.more() and self.t[self.i] in "*+{":
            c = self.next()
            if c == "*":
                m = A.star(m)
            elif c == "+":
                m = A.plus(m)
            else:
                close = self.t.index("}", self.i)
                lo, _, hi = self.t[self.i : close].partition(",")
                self.i = close + 1
                lo, hi = int(lo), int(hi or lo)
                if hi < lo:
                    raise ValueError("a count's bounds are in the wrong order")
                one, m = m, A.null()
                for _ in range(hi - lo):
                    m = A.optional(A.concat(one, m))
                for _ in range(lo):
                    m = A.concat(one, m)
        return m

    def atom(self):
        c = self.next()
        if c == "(":
            m = self.alternatives()
            if self.next() != ")":
                raise ValueError("a group isn't closed")
            return m
        if c == "[":
            return _choice(self.klass())
        if c == ".":
            return _choice(self.alphabet)
        if c == "\\":
            got = self.escape()
            return _choice(got)
        if c in "*+{":
            raise ValueError("nothing to repeat")
        return _choice([c])

    def escape(self) -> list[str]:
        c = self.next()
        if c == "d":
            return [x for x in "0123456789"]
        if c == "s":
            return [x for x in self.alphabet if x in SPACES]
        if c == "S":
            return [x for x in self.alphabet if x not in SPACES]
        if c == "x":
            return [chr(int(self.next() + self.next(), 16))]
        if c in "01234567" and self.t[self.i : self.i + 2].isdigit():
            return [chr(int(c + self.next() + self.next(), 8))]
        return [{"n": "\n", "r": "\r", "t": "\t"}.get(c, c)]

    def klass(self) -> list[str]:
        negate = self.more() and self.t[self.i] == "^"
        self.i += negate
        got: list[str] = []
        while True:
            c = self.next()
            if c == "]":
                break
            items = self.escape() if c == "\\" else [c]
            if len(items) == 1 and self.more() and self.t[self.i] == "-" and self.t[self.i + 1 : self.i + 2] not in ("", "]"):
                self.i += 1
                to = self.next()
                to = self.escape()[0] if to == "\\" else to
                items = [chr(k) for k in range(ord(items[0]), ord(to) + 1)]
            got += items
        return [a for a in self.alphabet if a not in got] if negate else list(dict.fromkeys(got))
