"""Packrat parsing: parsing-expression grammars compiled to Python functions over token lists.

A grammar is text: one rule a line, ``name <- expression``; a line that begins
with white space continues the rule. Expressions have the usual operators: sequence,
``/`` (ordered choice), ``* + ?``, ``& !`` (look-ahead) and groups. Terminals are
quoted token texts (``'if'``) or upper-case token classes (``NAME``); ``LINE``
takes nothing and holds where the next token begins a line. Every rule
memoises its result for each position, so parsing is linear in the tokens.
Choices look at the first token before they try an alternative, where that
decides; it changes no result.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\s*(?:(<-)|('[^']+')|([A-Za-z_]\w*)|([/*+?&!()]))")


class _Reader:
    def __init__(self, text: str):
        self.items, pos = [], 0
        text = text.strip()
        while pos < len(text):
            m = _TOKEN.match(text, pos)
            if not m:
                raise ValueError(f"grammar: {text[pos:pos + 40]!r}")
            self.items.append(m.group().strip())
            pos = m.end()
        self.at = 0

    def peek(self):
        return self.items[self.at] if self.at < len(self.items) else None

    def take(self):
        self.at += 1
        return self.items[self.at - 1]

    def choice(self):
        alts = [self.sequence()]
        while self.peek() == "/":
            self.take()
            alts.append(self.sequence())
        return alts[0] if len(alts) == 1 else ("alt", alts)

    def sequence(self):
        parts = []
        while self.peek() not in (None, "/", ")"):
            parts.append(self.prefix())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def prefix(self):
        if self.peek() in ("&", "!"):
            return ("and" if self.take() == "&" else "not", self.prefix())
        e = self.primary()
        while self.peek() in ("*", "+", "?"):
            e = ({"*": "star", "+": "plus", "?": "opt"}[self.take()], e)
        return e

    def primary(self):
        t = self.take()
        if t == "(":
            e = self.choice()
            if self.take() != ")":
                raise ValueError("grammar: no closing parenthesis")
            return e
        if t[0] == "'":
            return ("tok", t[1:-1])
        if t == "LINE":
            return ("line", t)
        return ("tok", t) if t.isupper() else ("rule", t)


class Grammar:
    """A compiled grammar; ``parse`` tells whether tokens match its first rule in full."""

    def __init__(self, text: str):
        self.rules: dict[str, tuple] = {}
        for rule in re.split(r"\n(?=\S)", "\n".join(x for x in text.strip().splitlines() if x.strip() and not x.startswith("#"))):
            name, _, body = rule.partition("<-")
            self.rules[name.strip()] = _Reader(body).choice()
        self.start = next(iter(self.rules))
        self._firsts()
        self._compile()

    # first sets: the tokens an expression can begin with, and whether it can match nothing
    def _first(self, e) -> tuple[frozenset, bool]:
        kind, x = e
        if kind == "tok":
            return frozenset([x]), False
        if kind == "rule":
            if x not in self.rules:
                raise ValueError(f"grammar: no rule {x}")
            return self.first.get(x, (frozenset(), False))
        if kind == "alt":
            fs = [self._first(a) for a in x]
            return frozenset().union(*(f for f, _ in fs)), any(n for _, n in fs)
        if kind == "seq":
            out: frozenset = frozenset()
            for part in x:
                f, n = self._first(part)
                out |= f
                if not n:
                    return out, False
            return out, True
        if kind in ("star", "opt"):
            return self._first(x)[0], True
        if kind == "plus":
            return self._first(x)
        return frozenset(), True  # look-ahead and LINE take nothing

    def _firsts(self):
        self.first: dict[str, tuple[frozenset, bool]] = {}
        while True:
            new = {r: self._first(e) for r, e in self.rules.items()}
            if new == self.first:
                return
            self.first = new

    def _compile(self):
        self.n, self.consts, lines = 0, {}, ["def build(T, far, N):"]
        for i, (name, e) in enumerate(self.rules.items()):
            lines += [f" m_{name} = {{}}", f" def r_{name}(p):", f"  if p in m_{name}: return m_{name}[p]", "  b = p"]
            lines += self._gen(e, 2) + [f"  m_{name}[b] = p", "  return p"]
        lines.append(f" return r_{self.start}")
        scope = dict(self.consts)
        exec("\n".join(lines), scope)  # noqa: S102 - the text comes from this module alone
        self.build = scope["build"]

    def _gen(self, e, d) -> list[str]:
        """Lines that move p past e, or set it to -1."""
        s, (kind, x) = " " * d, e
        self.n += 1
        q = f"q{self.n}"
        if kind == "tok":
            return [f"{s}if T[p] == {x!r}: p += 1", f"{s}else:", f"{s} if p > far[0]: far[0] = p", f"{s} p = -1"]
        if kind == "rule":
            return [f"{s}p = r_{x}(p)"]
        if kind == "line":
            return [f"{s}if not N[p]:", f"{s} if p > far[0]: far[0] = p", f"{s} p = -1"]
        if kind == "seq":
            out = self._gen(x[0], d)
            for k, part in enumerate(x[1:]):
                out += [f"{s}{' ' * k}if p >= 0:"] + self._gen(part, d + k + 1)
            return out
        if kind == "alt":
            out = [f"{s}{q} = p", f"{s}p = -1"]
            for k, alt in enumerate(x):
                f, nullable = self._first(alt)
                c = f"c{self.n}_{k}"
                self.consts[c] = f
                guard = "" if nullable else f" and T[{q}] in {c}"
                out += [f"{s}if p < 0{guard}:", f"{s} p = {q}"] + self._gen(alt, d + 1)
            return out + [f"{s}if p < 0 and {q} > far[0]: far[0] = {q}"]
        if kind == "opt":
            return [f"{s}{q} = p"] + self._gen(x, d) + [f"{s}if p < 0: p = {q}"]
        if kind in ("star", "plus"):
            f, nullable = self._first(x)
            c = f"c{self.n}_s"
            self.consts[c] = f
            out = self._gen(x, d) if kind == "plus" else []
            pad = " " if kind == "plus" else ""
            if kind == "plus":
                out.append(f"{s}if p >= 0:")
            t = s + pad
            out += [f"{t}while True:", f"{t} {q} = p"]
            if not nullable:
                out += [f"{t} if T[p] not in {c}:", f"{t}  if p > far[0]: far[0] = p", f"{t}  break"]
            return out + self._gen(x, d + 1 + len(pad)) + [f"{t} if p < 0: p = {q}; break", f"{t} if p == {q}: break"]
        if kind == "and":
            return [f"{s}{q} = p"] + self._gen(x, d) + [f"{s}if p >= 0: p = {q}"]
        if kind == "not":
            return [f"{s}{q} = p"] + self._gen(x, d) + [f"{s}p = {q} if p < 0 else -1"]
        raise ValueError(kind)

    def parse(self, kinds: list[str], lines: list[bool] | None = None) -> int:
        """-1 if all tokens match, else the index of the furthest token at which no rule could go on.

        ``kinds`` must not hold the end mark; it is added here. ``lines`` tells
        of each token whether it begins a line. Input nested too deeply to be
        followed fails at its furthest token.
        """
        tokens, far = [*kinds, "END"], [0]
        try:
            end = self.build(tokens, far, [*(lines or [False] * len(kinds)), True])(0)
        except RecursionError:
            return max(far[0], 0)
        return -1 if end == len(kinds) else max(far[0], max(end, 0))
