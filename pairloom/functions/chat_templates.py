"""Chat templates as models ship them, compiled to Column expressions.

`compile_template` reads a template in the usual notation (``{{ slot }}``, ``{% if %}``, ``{% for %}``, ``{% set %}``,
``{# comment #}``, dashes that strip blanks, a line's blanks before and line end after a block dropped) and gives a
function from a message list to a text: conditions become ``when``, loops ``transform``, slots ``concat``. Nothing
of it runs in Python. What is known when compiling (special tokens, ``add_generation_prompt``, names that are
not defined) is decided there, so the branches for tools and documents that many templates have cost nothing.

Left out are macros, namespaces, loops within loops and values that are neither text, numbers nor messages;
a template that needs them in a live branch is refused by name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.text import BLANKS


class TemplateError(ValueError):
    """A template that cannot be read, or needs what is not offered."""


# ---------------------------------------------------------------- reading

_PIECES = re.compile(r"({%-?.*?-?%}|{{-?.*?-?}}|{#-?.*?-?#})", re.DOTALL)
_TOKENS = re.compile(r"""\s*(?:
    (?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
  | (?P<number>\d+) | (?P<name>[A-Za-z_]\w*) | (?P<sign>==|!=|<=|>=|//|[-+~*/%<>()\[\]{}.,:|=])
)""", re.VERBOSE)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}


def _pieces(source: str) -> list[tuple[str, str]]:
    """(kind, content): text, slot, or block, with the blanks dropped that the notation says."""
    raw = _PIECES.split(source)
    out: list[tuple[str, str]] = []
    for at, piece in enumerate(raw):
        if at % 2 == 0:
            if at:
                before = raw[at - 1]
                if before[-3] == "-":
                    piece = piece.lstrip()
                elif before[1] in "%#" and piece.startswith("\n"):
                    piece = piece[1:]
            if at + 1 < len(raw):
                after = raw[at + 1]
                if after[2] == "-":
                    piece = piece.rstrip()
                elif after[1] in "%#":
                    line = piece.rsplit("\n", 1)
                    first = at == 0 or (raw[at - 1][1] in "%#" and raw[at].startswith("\n"))
                    if not line[-1].strip(" \t") and (len(line) > 1 or first):
                        piece = piece[: len(piece) - len(line[-1])]
            out.append(("text", piece))
        elif piece[1] != "#":
            out.append(("slot" if piece[1] == "{" else "block", piece[2:-2].strip("-").strip()))
    if out and out[-1][0] == "text" and out[-1][1].endswith("\n"):
        out[-1] = ("text", out[-1][1][:-1])
    return [(kind, content) for kind, content in out if kind != "text" or content]


class _Reader:
    """Expressions by recursive descent, to nested tuples ``(what, …)``."""

    def __init__(self, source: str):
        self.source, self.tokens, at = source, [], 0
        source = source.rstrip()
        while at < len(source):
            found = _TOKENS.match(source, at)
            if not found:
                raise TemplateError(f"cannot read {source[at:]!r} in {source!r}")
            self.tokens.append((found.lastgroup, found.group(found.lastgroup)))
            at = found.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str | None:
        at = self.at + ahead
        return self.tokens[at][1] if at < len(self.tokens) and self.tokens[at][0] != "text" else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted and self.peek() is not None:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected in {self.source!r}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError(f"a name expected in {self.source!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        found = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"cannot read {self.source!r} from {self.tokens[self.at][1]!r}")
        return found

    def choice(self) -> tuple:
        value = self.either()
        while self.take("if"):
            condition = self.either()
            other = self.choice() if self.take("else") else ("constant", UNDEFINED)
            value = ("choice", condition, value, other)
        return value

    def _chain(self, below: Callable[[], tuple], *signs: str) -> tuple:
        value = below()
        while sign := self.take(*signs):
            value = ("operate", sign, value, below())
        return value

    def either(self) -> tuple:
        return self._chain(self.both, "or")

    def both(self) -> tuple:
        return self._chain(self.denial, "and")

    def denial(self) -> tuple:
        return ("not", self.denial()) if self.take("not") else self.comparison()

    def comparison(self) -> tuple:
        value = self.sum()
        while True:
            if sign := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
                value = ("operate", sign, value, self.sum())
            elif self.peek() == "not" and self.peek(1) == "in":
                self.at += 2
                value = ("not", ("operate", "in", value, self.sum()))
            elif self.take("is"):
                denied = self.take("not")
                value = ("test", self.name(), value)
                value = ("not", value) if denied else value
            else:
                return value

    def sum(self) -> tuple:
        return self._chain(self.joined, "+", "-")

    def joined(self) -> tuple:
        return self._chain(self.product, "~")

    def product(self) -> tuple:
        return self._chain(self.signed, "*", "/", "//", "%")

    def signed(self) -> tuple:
        return ("operate", "-", ("constant", 0), self.signed()) if self.take("-") else self.filtered()

    def filtered(self) -> tuple:
        value = self.reached()
        while self.take("|"):
            value = ("filter", self.name(), value, self.arguments() if self.take("(") else [])
        return value

    def arguments(self, end: str = ")") -> list[tuple]:
        found = []
        while not self.take(end):
            found.append(self.choice())
            if not self.take(",") and self.peek() != end:
                raise TemplateError(f"{end!r} expected in {self.source!r}")
        return found

    def reached(self) -> tuple:
        value = self.atom()
        while True:
            if self.take("."):
                value = ("field", value, self.name())
            elif self.take("["):
                start = None if self.peek() == ":" else self.choice()
                if self.take(":"):
                    stop = None if self.peek() in ("]", ":") else self.choice()
                    step = None
                    if self.take(":"):
                        step = None if self.peek() == "]" else self.choice()
                    value = ("slice", value, start, stop, step)
                else:
                    value = ("item", value, start)
                self.need("]")
            elif self.take("("):
                value = ("call", value, self.arguments())
            else:
                return value

    def atom(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError(f"{self.source!r} ends early")
        kind, token = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return ("constant", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), token[1:-1], flags=re.DOTALL))
        if kind == "number":
            return ("constant", int(token))
        if token == "(":
            found = self.arguments()
            return found[0] if len(found) == 1 and self.tokens[self.at - 2][1] != "," else ("list", found)
        if token == "[":
            return ("list", self.arguments("]"))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return ("constant", fixed[token.lower()]) if token.lower() in fixed else ("name", token)
        raise TemplateError(f"cannot read {token!r} in {self.source!r}")


def _read(source: str) -> list[tuple]:
    """A template as nested statements."""
    pieces, at = _pieces(source), 0

    def statements(*ends: str) -> tuple[list[tuple], str]:
        nonlocal at
        body: list[tuple] = []
        while at < len(pieces):
            kind, content = pieces[at]
            at += 1
            word, _, rest = content.partition(" ")
            if kind == "text":
                body.append(("text", content))
            elif kind == "slot":
                body.append(("slot", _Reader(content).whole()))
            elif word in ends:
                return body, content
            elif word == "if":
                body.append(condition(rest))
            elif word == "for":
                loop = _Reader(rest)
                name = loop.name()
                loop.need("in")
                over = loop.either()
                only = loop.either() if loop.take("if") else None
                if loop.at < len(loop.tokens):
                    raise TemplateError(f"cannot read the loop {rest!r}")
                inner, _ = statements("endfor")
                body.append(("for", name, over, only, inner))
            elif word == "set":
                name, sign, value = rest.partition("=")
                if not sign or not name.strip().isidentifier():
                    raise TemplateError(f"cannot set {rest!r}")
                body.append(("set", name.strip(), _Reader(value).whole()))
            elif word in ("generation", "endgeneration"):
                continue  # marks what a model wrote; no output
            else:
                raise TemplateError(f"{word!r} is not offered")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return body, ""

    def condition(test: str) -> tuple:
        branch, end = statements("elif", "else", "endif")
        other: list[tuple] = []
        if end.startswith("elif"):
            other = [condition(end[4:])]
        elif end == "else":
            other, _ = statements("endif")
        return ("if", _Reader(test).whole(), branch, other)

    return statements()[0]


# ---------------------------------------------------------------- compiling


class _Undefined:
    """The value of a name that is not defined: false, and empty when written."""

    def __repr__(self) -> str:
        return "undefined"


UNDEFINED = _Undefined()


@dataclass(frozen=True)
class _Term:
    """A value that only a row knows: ``text``, ``number``, ``bool``, ``message``, ``messages`` or ``texts``.

    Where the column is null, the value is what ``absent`` says.
    """

    kind: str
    column: Column
    absent: Any = UNDEFINED


_Value = Any  # a constant, a list of values, or a _Term


def _truth(value: _Value) -> bool | Column:
    if not isinstance(value, _Term):
        return False if value is UNDEFINED else bool(value)
    tests = {
        "text": lambda c: c != "", "number": lambda c: c != 0, "bool": lambda c: c,
        "messages": lambda c: F.size(c) > 0, "texts": lambda c: F.size(c) > 0, "message": lambda c: c.isNotNull(),
    }
    return F.coalesce(tests[value.kind](value.column), F.lit(_holds(value.absent)))


def _lift(truth: bool | Column) -> _Value:
    return truth if isinstance(truth, bool) else _Term("bool", truth)


def _both(a: bool | Column, b: bool | Column) -> bool | Column:
    if isinstance(a, bool):
        return b if a else False
    return (a if b else False) if isinstance(b, bool) else a & b


def _deny(a: bool | Column) -> bool | Column:
    return not a if isinstance(a, bool) else ~a


def _written(value: _Value) -> str | Column:
    if not isinstance(value, _Term):
        if isinstance(value, list):
            raise TemplateError("a list cannot be written")
        return "" if value is UNDEFINED else str(value)
    if value.kind == "bool":
        return F.when(value.column, "True").otherwise("False")
    if value.kind not in ("text", "number"):
        raise TemplateError(f"{value.kind} cannot be written")
    text = value.column.cast("string") if value.kind == "number" else value.column
    return F.coalesce(text, F.lit(_written(value.absent)))


def _column(value: _Value) -> Column:
    return value.column if isinstance(value, _Term) else F.lit(value)


def _kind(value: _Value) -> str:
    if isinstance(value, _Term):
        return value.kind
    return {str: "text", bool: "bool", int: "number"}.get(type(value), "nothing")


def _join(parts: Sequence[str | Column]) -> str | Column:
    """Texts one after another, constant neighbours as one."""
    out: list[str | Column] = []
    for part in parts:
        if isinstance(part, str) and out and isinstance(out[-1], str):
            out[-1] += part
        elif not isinstance(part, str) or part:
            out.append(part)
    if not out:
        return ""
    if len(out) == 1:
        return out[0]
    return F.concat(*(F.lit(part) if isinstance(part, str) else part for part in out))


def _as_column(text: str | Column) -> Column:
    return F.lit(text) if isinstance(text, str) else text


def _choose(condition: bool | Column, one: _Value, two: _Value) -> _Value:
    """One value or the other; falsy constants may stand beside a text, number or list."""
    if isinstance(condition, bool):
        return one if condition else two
    if one is two or (not isinstance(one, (_Term, list)) and not isinstance(two, (_Term, list))
                      and type(one) is type(two) and one == two):
        return one
    kinds = {_kind(one), _kind(two)}
    nothing = {"nothing", "bool"}
    for value, other, holds in ((one, two, condition), (two, one, ~condition)):
        if _kind(value) not in nothing and _kind(other) in nothing and not isinstance(other, _Term) and not _holds(other):
            if isinstance(value, _Term) and value.absent is not UNDEFINED and value.absent is not other:
                break
            return _Term(_kind(value), F.when(holds, _column(value)), other)
    if len(kinds) > 1 or "nothing" in kinds:
        raise TemplateError(f"a value is {' or '.join(sorted(kinds))}, depending on the row")
    absent = [value.absent for value in (one, two) if isinstance(value, _Term)]
    chosen = F.when(condition, _column(one)).otherwise(_column(two))
    return _Term(kinds.pop(), chosen, absent[0] if absent else UNDEFINED)


def _holds(value: _Value) -> bool:
    return bool(value) and value is not UNDEFINED


def _equal(a: _Value, b: _Value) -> bool | Column:
    if not isinstance(a, _Term) and not isinstance(b, _Term):
        return a is b if UNDEFINED in (a, b) else type(a) is type(b) and a == b
    if _kind(a) != _kind(b):
        for term, other in ((a, b), (b, a)):
            if isinstance(term, _Term) and not isinstance(other, _Term) and other is not UNDEFINED and (
                term.absent is other
            ):
                return term.column.isNull()
        return False
    return F.coalesce(_column(a) == _column(b), F.lit(False))


_TRIMMED = f"^[{re.escape(BLANKS)}]+|[{re.escape(BLANKS)}]+\\z"


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, _TRIMMED, "")


@dataclass
class _Loop:
    index: Column
    size: Column
    turns: Column


@dataclass
class _Compiler:
    fields: Sequence[str]
    names: dict[str, _Value] = field(default_factory=dict)
    loop: _Loop | None = None

    def text(self, body: list[tuple]) -> str | Column:
        return _join([self.statement(one) for one in body])

    def statement(self, one: tuple) -> str | Column:
        what = one[0]
        if what == "text":
            return one[1]
        if what == "slot":
            return _written(self.value(one[1]))
        if what == "set":
            self.names[one[1]] = self.value(one[2])
            return ""
        if what == "if":
            return self.condition(*one[1:])
        return self.turns(*one[1:])

    def condition(self, test: tuple, branch: list[tuple], other: list[tuple]) -> str | Column:
        holds = _truth(self.value(test))
        if isinstance(holds, bool):
            return self.text(branch if holds else other)
        ways = []
        for body in (branch, other):
            way = _Compiler(self.fields, dict(self.names), self.loop)
            ways.append((way.text(body), way.names))
        for name in {**ways[0][1], **ways[1][1]}:
            one, two = (names.get(name, UNDEFINED) for _, names in ways)
            if one is not two:
                self.names[name] = _choose(holds, one, two)
        one, two = (text for text, _ in ways)
        if isinstance(one, str) and one == two:
            return one
        return F.when(holds, _as_column(one)).otherwise(_as_column(two))

    def turns(self, name: str, over: tuple, only: tuple | None, body: list[tuple]) -> str | Column:
        turns = self.value(over)
        if not isinstance(turns, _Term) or turns.kind != "messages":
            if not _truth(turns):
                return ""
            raise TemplateError("a loop runs over messages only")
        if self.loop:
            raise TemplateError("a loop within a loop is not offered")
        column = turns.column
        if only is not None:

            def wanted(turn: Column) -> Column:
                inner = _Compiler(self.fields, {**self.names, name: _Term("message", turn)})
                holds = _truth(inner.value(only))
                return F.lit(holds) if isinstance(holds, bool) else holds

            column = F.filter(column, wanted)

        def written(turn: Column, at: Column) -> Column:
            loop = _Loop(at, F.size(column), column)
            inner = _Compiler(self.fields, {**self.names, name: _Term("message", turn)}, loop)
            return _as_column(inner.text(body))

        # A missing list was no list of messages: there is nothing to loop over.
        return F.coalesce(F.array_join(F.transform(column, written), ""), F.lit(""))

    def value(self, node: tuple) -> _Value:
        return getattr(self, "_" + node[0])(*node[1:])

    def _constant(self, value: _Value) -> _Value:
        return value

    def _list(self, items: list[tuple]) -> _Value:
        return [self.value(item) for item in items]

    def _name(self, name: str) -> _Value:
        return self.names.get(name, UNDEFINED)

    def _choice(self, test: tuple, one: tuple, two: tuple) -> _Value:
        holds = _truth(self.value(test))
        if isinstance(holds, bool):
            return self.value(one if holds else two)
        return _choose(holds, self.value(one), self.value(two))

    def _not(self, node: tuple) -> _Value:
        return _lift(_deny(_truth(self.value(node))))

    def _test(self, name: str, node: tuple) -> _Value:
        value = self.value(node)
        if name in ("defined", "undefined"):
            if isinstance(value, _Term):
                there: bool | Column = value.column.isNotNull() if value.absent is UNDEFINED else True
            else:
                there = value is not UNDEFINED
            return _lift(there if name == "defined" else _deny(there))
        if name == "none":
            if isinstance(value, _Term):
                return _lift(value.column.isNull() if value.absent is None else False)
            return value is None
        if name in ("string", "number", "mapping", "iterable", "true", "false"):
            kind = _kind(value)
            if name in ("true", "false"):
                return _lift(_both(kind == "bool", _truth(value) if name == "true" else _deny(_truth(value))))
            kinds = {"string": ("text",), "number": ("number",), "mapping": ("message",),
                     "iterable": ("text", "texts", "messages")}
            return kind in kinds[name]
        raise TemplateError(f"the test {name!r} is not offered")

    def _operate(self, sign: str, left: tuple, right: tuple) -> _Value:
        a = self.value(left)
        if sign in ("and", "or"):
            holds = _truth(a)
            if isinstance(holds, bool):
                return self.value(right) if holds == (sign == "and") else a
            b = self.value(right)
            other = _truth(b)
            if sign == "and":
                return _lift(_both(holds, other))
            if not isinstance(other, bool) and _kind(a) == _kind(b) != "bool":
                return _choose(holds, a, b)
            return _lift(holds | (F.lit(other) if isinstance(other, bool) else other))
        b = self.value(right)
        if sign in ("==", "!="):
            same = _equal(a, b)
            return _lift(same if sign == "==" else _deny(same))
        if sign == "in":
            if isinstance(b, list):
                found: bool | Column = False
                for item in b:
                    found = _deny(_both(_deny(found), _deny(_equal(a, item))))
                return _lift(found)
            if _kind(b) == "message" and isinstance(a, str):
                return _lift(a in self.fields)
            if _kind(a) == _kind(b) == "text":
                if isinstance(a, str) and isinstance(b, str):
                    return a in b
                return _Term("bool", F.coalesce(F.contains(_column(b), _column(a)), F.lit(False)))
            raise TemplateError(f"'in' cannot look for {_kind(a)} in {_kind(b)}")
        if sign == "~" or (sign == "+" and _kind(a) == _kind(b) == "text"):
            joined = _join([_written(a), _written(b)])
            return joined if isinstance(joined, str) else _Term("text", joined)
        if sign == "+" and "text" in (_kind(a), _kind(b)):
            # A text that may be absent fails here, as adding nothing to a text would.
            raise TemplateError(f"cannot add {_kind(a)} and {_kind(b)}")
        if _kind(a) != "number" or _kind(b) != "number":
            raise TemplateError(f"cannot compute {_kind(a)} {sign} {_kind(b)}")
        if not isinstance(a, _Term) and not isinstance(b, _Term):
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: a % b,
                    "//": lambda: a // b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b,
                    ">=": lambda: a >= b}[sign]()
        x, y = _column(a), _column(b)
        compared = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}
        if sign in compared:
            return _Term("bool", F.coalesce(compared[sign], F.lit(False)))
        if sign == "/":
            raise TemplateError("'/' is not offered")
        return _Term("number", {"+": x + y, "-": x - y, "*": x * y, "%": F.pmod(x, y),
                                "//": F.floor(x / y)}[sign])

    def _field(self, node: tuple, name: str) -> _Value:
        if node == ("name", "loop") and self.loop:
            loop = self.loop
            at = loop.index
            found = {
                "index0": ("number", at), "index": ("number", at + 1), "first": ("bool", at == 0),
                "last": ("bool", at == loop.size - 1), "length": ("number", loop.size),
                "revindex": ("number", loop.size - at), "revindex0": ("number", loop.size - at - 1),
                "previtem": ("message", F.when(at > 0, F.get(loop.turns, at - 1))),
                "nextitem": ("message", F.get(loop.turns, at + 1)),
            }
            if name not in found:
                raise TemplateError(f"loop.{name} is not offered")
            return _Term(*found[name])
        value = self.value(node)
        if isinstance(value, _Term) and value.kind == "message":
            return _Term("text", value.column[name]) if name in self.fields else UNDEFINED
        if value is UNDEFINED or isinstance(value, _Term):
            raise TemplateError(f"{name!r} of {_kind(value)} is not offered")
        raise TemplateError(f"{value!r} has no {name!r}")

    def _item(self, node: tuple, index: tuple) -> _Value:
        value, at = self.value(node), self.value(index)
        if isinstance(at, str):
            return self._field(node, at)
        if isinstance(value, list) and isinstance(at, int):
            return value[at]
        if isinstance(value, _Term) and value.kind in ("messages", "texts") and _kind(at) == "number":
            where = _column(at)
            if isinstance(at, int) and at < 0:
                where = F.size(value.column) + at
            found = F.when(where >= 0, F.get(value.column, where))
            return _Term("message" if value.kind == "messages" else "text", found)
        raise TemplateError(f"cannot take an item of {_kind(value)}")

    def _slice(self, node: tuple, start: tuple | None, stop: tuple | None, step: tuple | None) -> _Value:
        value = self.value(node)
        low, high, by = (None if part is None else self.value(part) for part in (start, stop, step))
        if not isinstance(value, _Term) or value.kind not in ("messages", "texts") or not all(
            part is None or type(part) is int for part in (low, high, by)
        ):
            raise TemplateError("only lists are sliced, at constants")
        if by == -1 and low is None and high is None:
            return _Term(value.kind, F.reverse(value.column))
        if by not in (None, 1):
            raise TemplateError(f"steps of {by} are not offered")
        size = F.size(value.column)

        def place(at: int | None, default: Column) -> Column:
            if at is None:
                return default
            return F.least(F.lit(at), size) if at >= 0 else F.greatest(size + at, F.lit(0))

        first, end = place(low, F.lit(0)), place(high, size)
        return _Term(value.kind, F.slice(value.column, first + 1, F.greatest(end - first, F.lit(0))))

    def _filter(self, name: str, node: tuple, arguments: list[tuple]) -> _Value:
        value = self.value(node)
        given = [self.value(argument) for argument in arguments]
        if name in ("default", "d"):
            if isinstance(value, _Term) and value.absent is UNDEFINED:
                return _choose(value.column.isNotNull(), value, given[0])
            return given[0] if value is UNDEFINED else value
        if name in ("safe", "string"):
            return value
        if name in ("length", "count") and isinstance(value, _Term):
            sizes = {"text": F.length, "messages": F.size, "texts": F.size}
            if value.kind in sizes:
                return _Term("number", F.coalesce(sizes[value.kind](value.column), F.lit(0)))
        if name in ("first", "last") and isinstance(value, _Term):
            return self._item(node, ("constant", 0 if name == "first" else -1))
        if name in ("trim", "upper", "lower", "replace", "capitalize"):
            return self._on_text(name, value, given)
        raise TemplateError(f"the filter {name!r} is not offered for {_kind(value)}")

    def _call(self, node: tuple, arguments: list[tuple]) -> _Value:
        if node == ("name", "raise_exception"):
            message = _written(self.value(arguments[0])) if arguments else "refused by the template"
            return _Term("text", F.raise_error(_as_column(message)).cast("string"))
        if node[0] == "field":
            return self._on_text(node[2], self.value(node[1]), [self.value(one) for one in arguments])
        raise TemplateError(f"the function {node[1]!r} is not offered")

    def _on_text(self, name: str, value: _Value, given: list[_Value]) -> _Value:
        """Methods and filters on texts; a missing text stays missing."""
        if not all(isinstance(one, str) for one in given):
            raise TemplateError(f"{name!r} takes constant texts only")
        if value is UNDEFINED:
            value = ""
        if _kind(value) != "text":
            raise TemplateError(f"{name!r} is not offered for {_kind(value)}")
        text = _column(value)
        one = given[0] if given else None
        results = {
            "trim": lambda: _trim(text), "strip": lambda: _trim(text), "upper": lambda: F.upper(text),
            "lower": lambda: F.lower(text),
            "lstrip": lambda: F.regexp_replace(text, f"^[{re.escape(BLANKS)}]+", ""),
            "rstrip": lambda: F.regexp_replace(text, f"[{re.escape(BLANKS)}]+\\z", ""),
            "capitalize": lambda: F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30))),
            "replace": lambda: F.replace(text, F.lit(one), F.lit(given[1])),
        }
        if name in ("startswith", "endswith") and one is not None:
            found = text.startswith(one) if name == "startswith" else text.endswith(one)
            return _Term("bool", F.coalesce(found, F.lit(False)))
        if name == "split" and one:
            return _Term("texts", F.split(text, "\\Q" + one + "\\E" if "\\E" not in one else re.escape(one)))
        if name not in results or (given and name != "replace"):
            raise TemplateError(f"{name!r} is not offered for texts")
        return _Term("text", results[name](), value.absent if isinstance(value, _Term) else UNDEFINED)


@dataclass(frozen=True)
class CompiledTemplate:
    """A template that has been read; `render` gives the expression for a column of messages."""

    statements: list[tuple]
    names: dict[str, _Value]

    def render(
        self, messages: Column | str, add_generation_prompt: bool = False, fields: Sequence[str] = ("role", "content")
    ) -> Column:
        """A message list as one text. Null if the list or any message's role or content is null.

        ``fields`` are the fields of a message, all of them texts.
        """
        turns = F.col(messages) if isinstance(messages, str) else messages
        names = {
            **self.names, "messages": _Term("messages", turns), "add_generation_prompt": add_generation_prompt,
        }
        written = _Compiler(tuple(fields), names).text(self.statements)
        broken = F.exists(turns, lambda m: m["role"].isNull() | m["content"].isNull())
        return F.when(~broken, _as_column(written))


def compile_template(source: str, bos_token: str = "", eos_token: str = "", **names: _Value) -> CompiledTemplate:
    """Read a chat template. Further names are constants: texts, numbers, True, False or None."""
    return CompiledTemplate(_read(source), {"bos_token": bos_token, "eos_token": eos_token, **names})
