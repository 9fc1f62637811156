"""Chat formatting with a compiled template language.

A template is text with {{ expression }}, {% for x in expression %}, {% if %} / {% elif %} / {% else %}, {% set x = expression %} and {% generation %},
each closed by its {% end... %}; a hyphen inside a brace trims the white space beside it. Expressions have strings, whole numbers, true, false, none,
names, m.key, m["key"], + == != < <= > >= in not and or, and filters after |. The template is parsed into a syntax tree, parts without names are folded
into constants, and the tree becomes Python closures. Templates are sandboxed: a name is looked up among the values given, a key among a mapping's keys
or a list's places, filters come from a fixed list, and there are no calls, attributes or imports. What {% generation %} encloses is the loss mask.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TemplateError(ValueError):
    """The template, or a value that it was given, is wrong."""


# --- control strings --------------------------------------------------------

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[/TURN]")
_ESCAPE = re.compile("|".join(rf"(?<={re.escape(c[0])})\\*(?={re.escape(c[1:])})" for c in CONTROLS))


def escape(text: str) -> str:
    """Puts one more backslash after the first character of each control string (and of each that already has backslashes there), so none is left."""
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    """The inverse of escape()."""
    return _ESCAPE.sub(lambda m: m[0][:-1], text)


FILTERS: dict[str, Callable[[Any], Any]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len, "string": str}

# --- syntax tree ------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    """An operator or filter on its operands."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Emit:
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    of: Any
    body: tuple


@dataclass(frozen=True)
class If:
    arms: tuple  # of (condition, body)


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}", re.S)
_TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|(\w+)|(==|!=|<=|>=|[-+<>.|()\[\]]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            kind = "string number name sign".split()[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"{sign} is missing")

    def whole(self):
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self):
        out = self.both()
        while self.take("or"):
            out = Apply("or", (out, self.both()))
        return out

    def both(self):
        out = self.negated()
        while self.take("and"):
            out = Apply("and", (out, self.negated()))
        return out

    def negated(self):
        return Apply("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        out = self.added()
        while op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            out = Apply(op, (out, self.added()))
        return out

    def added(self):
        out = self.filtered()
        while self.take("+"):
            out = Apply("+", (out, self.filtered()))
        return out

    def filtered(self):
        out = self.atom()
        while self.take("|"):
            name = self.word()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            out = Apply(f"|{name}", (out,))
        return out

    def word(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, text = self.tokens[self.at]
        if self.take("("):
            out = self.either()
            self.need(")")
        elif kind == "string":
            self.at += 1
            out = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        elif kind == "number":
            self.at += 1
            out = Const(int(text))
        elif kind == "name" and text in ("true", "false", "none"):
            self.at += 1
            out = Const({"true": True, "false": False, "none": None}[text])
        else:
            out = Name(self.word())
        while True:
            if self.take("."):
                out = Item(out, Const(self.word()))
            elif self.take("["):
                out = Item(out, self.either())
                self.need("]")
            else:
                return out


def parse(source: str) -> tuple:
    """The statements of a template."""
    parts: list[tuple[str, str]] = []
    at, trim = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        parts.append(("text", text.rstrip() if m[1] or m[4] else text))
        parts.append(("value", m[2]) if m[2] is not None else ("tag", m[5].strip()))
        at, trim = m.end(), bool(m[3] or m[6])
    parts.append(("text", source[at:].lstrip() if trim else source[at:]))
    parts.reverse()

    def body(*ends: str) -> tuple[tuple, str]:
        out = []
        while parts:
            kind, text = parts.pop()
            if kind == "text":
                if text:
                    out.append(Emit(Const(text)))
                continue
            if kind == "value":
                out.append(Emit(_Expression(text).whole()))
                continue
            word, _, rest = text.partition(" ")
            if word in ends:
                return tuple(out), text
            if word == "for" and (m := re.fullmatch(r"(\w+)\s+in\s+(.+)", rest.strip(), re.S)):
                inner, _ = body("endfor")
                out.append(For(m[1], _Expression(m[2]).whole(), inner))
            elif word == "if":
                arms, condition = [], _Expression(rest).whole()
                while True:
                    inner, end = body("elif", "else", "endif")
                    arms.append((condition, inner))
                    if end == "endif":
                        break
                    if arms[-1][0] == Const(True) and end != "endif" and len(arms) > 1 and condition == Const(True):
                        raise TemplateError("something follows else")
                    condition = Const(True) if end == "else" else _Expression(end.partition(" ")[2]).whole()
                out.append(If(tuple(arms)))
            elif word == "set" and (m := re.fullmatch(r"(\w+)\s*=(?!=)(.+)", rest.strip(), re.S)):
                out.append(Set(m[1], _Expression(m[2]).whole()))
            elif word == "generation":
                out.append(Generation(body("endgeneration")[0]))
            else:
                raise TemplateError(f"unexpected {{% {text} %}}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), ""

    return body()[0]


# --- constants --------------------------------------------------------------


def _same_kind(a, b) -> bool:
    return isinstance(a, str) == isinstance(b, str)


def _operate(op: str, a, b=None):
    try:
        if op[0] == "|":
            return FILTERS[op[1:]](a)
        if op == "+":
            return a + b
        if op == "==":
            return a == b
        if op == "!=":
            return a != b
        if op == "in":
            return a in b
        if op == "not":
            return not a
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op] if _same_kind(a, b) else _wrong(op)
    except TypeError:
        _wrong(op)


def _wrong(op: str):
    raise TemplateError(f"{op} does not work on these values")


def fold(node):
    """The same tree with parts that have no names worked out, dead branches dropped and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Emit) and isinstance(y.value, Const) and out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                    out[-1] = Emit(Const(out[-1].value.value + y.value.value))
                else:
                    out.append(y)
        return tuple(out)
    if isinstance(node, Apply):
        args = tuple(map(fold, node.args))
        if node.op in ("and", "or"):
            if isinstance(args[0], Const):
                return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        elif all(isinstance(x, Const) for x in args):
            return Const(_operate(node.op, *(x.value for x in args)))
        return Apply(node.op, args)
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    if isinstance(node, Emit):
        value = fold(node.value)
        return Emit(Const(_shown(value.value))) if isinstance(value, Const) else Emit(value)
    if isinstance(node, For):
        return For(node.name, fold(node.of), fold(node.body))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        arms = []
        for condition, body in node.arms:
            condition = fold(condition)
            if isinstance(condition, Const) and not condition.value:
                continue
            arms.append((condition, fold(body)))
            if isinstance(condition, Const):
                break
        if arms and isinstance(arms[0][0], Const):
            return arms[0][1]
        return If(tuple(arms)) if arms else ()
    return node


def _shown(value) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


# --- closures ---------------------------------------------------------------


@dataclass
class Output:
    parts: list[str] = field(default_factory=list)
    length: int = 0
    mask: list[tuple[int, int]] = field(default_factory=list)

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _value(node) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda names: node.value
    if isinstance(node, Name):

        def name(names):
            if node.name not in names:
                raise TemplateError(f"{node.name} is not given")
            return names[node.name]

        return name
    if isinstance(node, Item):
        of, key = _value(node.of), _value(node.key)

        def item(names):
            x, k = of(names), key(names)
            if isinstance(x, dict):
                return x.get(k)
            if isinstance(x, (list, tuple, str)) and isinstance(k, int) and -len(x) <= k < len(x):
                return x[k]
            raise TemplateError(f"there is no {k!r}")

        return item
    args = [_value(x) for x in node.args]
    if node.op == "and":
        return lambda names: args[0](names) and args[1](names)
    if node.op == "or":
        return lambda names: args[0](names) or args[1](names)
    if len(args) == 1:
        return lambda names: _operate(node.op, args[0](names))
    return lambda names: _operate(node.op, args[0](names), args[1](names))


def _run(body: tuple) -> Callable[[dict, Output], None]:
    steps = [_step(x) for x in body]

    def run(names, out):
        for step in steps:
            step(names, out)

    return run


def _step(node) -> Callable[[dict, Output], None]:
    if isinstance(node, Emit):
        if isinstance(node.value, Const):
            text = node.value.value
            return lambda names, out: out.add(text)
        value = _value(node.value)
        return lambda names, out: out.add(_shown(value(names)))
    if isinstance(node, Set):
        value = _value(node.value)

        def put(names, out):
            names[node.name] = value(names)

        return put
    if isinstance(node, For):
        of, inner = _value(node.of), _run(node.body)

        def loop(names, out):
            rows = of(names)
            own = dict(names)
            for i, row in enumerate(rows):
                own[node.name] = row
                own["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(rows) - 1, "length": len(rows)}
                inner(own, out)

        return loop
    if isinstance(node, Generation):
        inner = _run(node.body)

        def generation(names, out):
            start = out.length
            inner(names, out)
            out.mask.append((start, out.length))

        return generation
    arms = [(_value(c), _run(b)) for c, b in node.arms]

    def choose(names, out):
        for condition, inner in arms:
            if condition(names):
                inner(names, out)
                return

    return choose


@lru_cache(maxsize=32)
def compiled(source: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages to the formatted text and the ranges of it (in code points) that count for the loss."""
    run = _run(fold(parse(source)))

    def render(messages):
        out = Output()
        run({"messages": messages}, out)
        return "".join(out.parts), out.mask

    return render


# --- conversations ----------------------------------------------------------

TEMPLATE = (
    "<s>{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}[ROLE] {{ m.role | escape }}[/ROLE] {{ m.text | escape }} [/TURN]{% endif %}"
    "{% endfor %}"
)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of what TEMPLATE made."""
    out, at = [], len("<s>")
    if not formatted.startswith("<s>"):
        raise ValueError("no conversation begins here")
    while at < len(formatted):
        if formatted.startswith("[INST] ", at):
            end = formatted.index("[/INST]", at)
            out.append(("user", unescape(formatted[at + 7 : end - 1])))
            at = end + 7
        elif formatted.startswith("[ROLE] ", at):
            middle = formatted.index("[/ROLE]", at)
            end = formatted.index("[/TURN]", middle)
            out.append((unescape(formatted[at + 7 : middle]), unescape(formatted[middle + 8 : end - 1])))
            at = end + 7
        else:
            end = formatted.index("</s>", at)
            out.append(("assistant", unescape(formatted[at:end])))
            at = end + 4
    return out


def _formatted(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template)
        rows: tuple[list, ...] = ([], [], [])
        messages: list[dict] = []
        now: Any = None

        def done():
            text, mask = render(messages)
            rows[0].append(now)
            rows[1].append(text)
            rows[2].append([{"start": a, "end": b} for a, b in mask])

        def batch_of():
            ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            out = pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], ranges)], ["conv_id", "formatted", "mask"])
            for r in rows:
                r.clear()
            return out

        size = 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if messages and conv != now:
                    done()
                    size += len(rows[1][-1])
                    messages = []
                    if size > 1 << 22:
                        yield batch_of()
                        size = 0
                now = conv
                messages.append({"role": role or "", "text": text or ""})
        if messages:
            done()
        yield batch_of()

    return run


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, mask) for each conversation of turns(conv_id, turn, role, text); other columns are not read.

    Rows of a conversation stand in the order of turn, role and text, nulls first, so ties and repeated rows have a fixed place; each row is a message.
    A null role or text is empty. Rows without a conv_id are one conversation. mask has the ranges, in code points, of what was under a generation
    marker. A conversation is one string in the end, so its rows meet in one task; conversations are read one after another from sorted rows.
    An empty table gives no rows.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    compiled(template)  # a wrong template fails here
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_formatted(template), "conv_id long, formatted string, mask array<struct<start: long, end: long>>")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for formatted, mask in zip(batch.column("formatted").to_pylist(), batch.column("mask").to_pylist(), strict=True):
            turns = read_back(formatted)
            loss = "".join(unescape(formatted[m["start"] : m["end"]]) for m in mask)
            for column, v in zip(out, (len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(formatted)), strict=True):
                column.append(v)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names)


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from format_conversations(): turns, and the text under the loss mask, as counts and digests."""
    return formatted.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
