"""Name-literal pairs of source and configuration text, with constants propagated.

One pass over a text reads assignments (``a = 'x'``, ``a := x``, ``"a": "x"``, ``a => 'x'``,
``a: str = 'x'``, ``cfg['a'] = 'x'``), command-line flags (``--a x``), elements (``<a>x</a>``),
``key="a" value="x"`` attributes and the password of an address.  The right side is a
sum of string literals, names and bare values.  A name stands for what it was given last
before, or, if nothing came before, for what it is given first, as configuration files
allow; ``${a}``, ``{a}``, ``%(a)s`` and ``$a`` inside a literal refer in the same way.

A value is a node: a literal with its place, or a sum of earlier nodes.  Nodes share
their parts and carry a summary of fixed size, so a chain of sums costs a step each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

SPACE = r"[ \t]*+"
TARGET = re.compile(
    r"(?<![\w.$-])(?:--)?(?:(?P<name>[A-Za-z_$][\w.$-]*+)|\"(?P<double>[\w.$ -]*+)\"|'(?P<single>[\w.$ -]*+)')"
    rf"\]?{SPACE}(?P<op>:=|=>|=(?![=~>])|:(?![:/=]){SPACE}[A-Za-z_][\w.\[\]<>?|]*+{SPACE}=(?![=~>])|:(?![:/=])){SPACE}"
)
FLAG = re.compile(r"(?<![\w-])--(?P<name>[A-Za-z][\w-]*+)[ \t]++(?=[^\s=-])")
ELEMENT = re.compile(r"<(?P<name>[A-Za-z][\w.:-]*+)>(?=[^<>\n]++</(?P=name)>)")
ADDRESS = re.compile(r"://[^\s:@/\"']*+:(?=[^\s:@/\"']++@)")
QUOTED = re.compile(
    r"(?P<prefix>[rbfuRBFU]{0,2})(?:\"\"\"(?P<d3>(?:[^\"\\]|\\.|\"(?!\"\"))*+)\"\"\"|'''(?P<s3>(?:[^'\\]|\\.|'(?!''))*+)'''"
    r"|\"(?P<d>(?:[^\"\\\n]|\\.)*+)\"|'(?P<s>(?:[^'\\\n]|\\.)*+)'|`(?P<b>[^`]*+)`)",
    re.S,
)
# Ends at the next assignment mark, so that a run of assignments is read once; padding belongs to the value.
BARE = re.compile(r"[^\s\"'`,;#(){}\[\]<>:=&]++=*+")
WITHIN = {"flag": BARE, "element": re.compile(r"[^<>\n]++"), "address": re.compile(r"[^\s:@/\"']++")}
PLUS = re.compile(rf"{SPACE}(?:\+|\.\.|\.(?=\s)|&(?!&)|\\\n)?\s*+(?=[\"'`A-Za-z_$])")
NAME = re.compile(r"\$?[A-Za-z_][\w.]*+")
REFERENCE = re.compile(r"\$\{\{?\s*+([A-Za-z_][\w.]*+)[^{}]*+\}|%\(([A-Za-z_][\w.]*+)\)s|\{\{?\s*+([A-Za-z_][\w.]*+)\s*+\}|\$([A-Za-z_]\w*+)")
# Words that stand for a secret instead of being one.
PLACEHOLDER = re.compile(
    r"(?i:example|change_?me|placeholder|redacted|dummy|sample|your[_-]|<[^>]*+>|x{4,}|\*{3,}|\.{3,}|todo|insert|none|null|true|false|undefined)"
)


@dataclass(eq=False, slots=True)
class Value:
    """A literal at [start, end), or a sum of parts when start is -1."""

    start: int = -1
    end: int = -1
    parts: list[Value] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    length: int = 0
    seen: int = 0  # bit c for each character c below 128, bit 128 for all others
    placeholder: bool = False
    emitted: bool = False

    def take(self, part: Value) -> None:
        self.parts.append(part)
        self.length += part.length
        self.seen |= part.seen
        self.placeholder |= part.placeholder


def literal(text: str, start: int, end: int) -> Value:
    seen = 0
    for c in set(text[start:end]):
        seen |= 1 << min(ord(c), 128)
    return Value(start, end, length=end - start, seen=seen, placeholder=PLACEHOLDER.search(text, start, end) is not None)


def _plain(name: str) -> str:
    return name.removeprefix("$").removeprefix("self.").removeprefix("this.")


class _Reader:
    def __init__(self, text: str):
        self.text = text
        self.last: dict[str, Value] = {}
        self.first: dict[str, Value] = {}
        self.pairs: list[tuple[str, Value]] = []
        self.open: list[Value] = []

    def refer(self, value: Value, name: str) -> None:
        known = self.last.get(_plain(name))
        if known is not None:
            value.take(known)
        else:
            value.missing.append(_plain(name))

    def quoted(self, value: Value, match: re.Match) -> None:
        kind = match.lastgroup
        start, end = match.span(kind)
        value.take(literal(self.text, start, end))
        for found in REFERENCE.finditer(self.text, start, end):
            self.refer(value, found[found.lastindex])

    def expression(self, at: int, bare: bool) -> tuple[Value, int]:
        """The value that starts at ``at``; bare words count as literals only in configuration style."""
        text, value, here = self.text, Value(), at
        while True:
            match = QUOTED.match(text, here)
            reference = None if match else REFERENCE.match(text, here)
            if reference:
                self.refer(value, reference[reference.lastindex])
                here = reference.end()
            elif match:
                self.quoted(value, match)
                here = match.end()
            else:
                match = BARE.match(text, here)
                if not match or text.startswith("(", match.end()):
                    break
                name = NAME.match(text, here)
                if name and name.end() == match.end():
                    self.refer(value, name[0])
                if not (name and name.end() == match.end() and _plain(name[0]) in self.last):
                    if bare and here == at:
                        value.take(literal(text, *match.span()))
                        for found in REFERENCE.finditer(text, *match.span()):
                            self.refer(value, found[found.lastindex])
                here = match.end()
            more = PLUS.match(text, here)
            if not more or (more.end() == here) or ("\n" in more[0] and more[0].strip() == ""):
                break
            if more[0].strip() == "" and not QUOTED.match(text, more.end()):
                break
            here = more.end()
        return value, here

    def define(self, name: str, value: Value) -> None:
        if not value.parts and not value.missing:
            return
        self.pairs.append((name, value))
        self.last[_plain(name)] = value
        self.first.setdefault(_plain(name), value)
        if value.missing:
            self.open.append(value)

    def targets(self):
        text = self.text
        found = [(m.end(), "assignment", m) for m in TARGET.finditer(text)]
        for kind, pattern in (("flag", FLAG), ("element", ELEMENT), ("address", ADDRESS)):
            found += [(m.end(), kind, m) for m in pattern.finditer(text)]
        found.sort(key=lambda f: f[:2])
        return found

    def read(self) -> list[tuple[str, Value]]:
        key, key_end = None, -1
        for at, kind, match in self.targets():
            if kind != "assignment":
                if kind == "flag" and QUOTED.match(self.text, at):
                    value, _ = self.expression(at, False)
                else:
                    value = Value()
                    inner = WITHIN[kind].match(self.text, at)
                    value.take(literal(self.text, *inner.span()) if inner else Value())
                self.define("password" if kind == "address" else match["name"], value)
                continue
            name = match["name"] or match["double"] or match["single"] or ""
            value, end = self.expression(at, bare=True)
            if name.lower() == "value" and key is not None and self.text[key_end : match.start()].strip() == "":
                name = key
            self.define(name, value)
            whole = value.parts[0] if len(value.parts) == 1 else None
            is_key = name.lower() in ("key", "name") and whole is not None and whole.start >= 0
            key, key_end = (self.text[whole.start : whole.end], end) if is_key else (None, -1)
        for value in self.open:
            for name in value.missing:
                later = self.first.get(name)
                if later is not None and later is not value:
                    value.take(later)
        return self.pairs


def read_pairs(text: str) -> list[tuple[str, Value]]:
    """(name, value) in the order of the text."""
    return _Reader(text).read()


def literals(value: Value) -> list[Value]:
    """The literals of a value that no earlier call returned."""
    out, stack = [], [value]
    while stack:
        node = stack.pop()
        if node.emitted:
            continue
        node.emitted = True
        if node.start >= 0:
            out.append(node)
        stack.extend(node.parts)
    return out
