r"""Chat formatting by compiled templates.

The template language is small and sandboxed: text, {{ expr }}, {% for x in expr %}, {% if %} / {% elif %} /
{% else %}, {% set x = expr %} and {% generation %} ... {% endgeneration %} around what the loss covers. An
expression has names, constants, item access on mappings (a.b, a["b"]), + ~ == != in, and / or / not, and the
filters of FILTERS; it can't call anything and can't reach attributes of Python objects. A template is parsed into
a syntax tree, constants are folded (and neighbouring texts joined), and each node becomes a Python closure
that yields text and generation markers.

DEFAULT marks a turn as `### role: text</turn>`; the filter `escape` puts a backslash before every backslash,
`#` and `<` of a text (`escape_role` also before `:`), so no text can hold a mark, and read_turns() undoes it.

Rows of a conversation are sorted by turn (null first; ties by role, text) and rendered as a stream: messages
come from an iterator and output leaves in parts of about `part_chars`, cut between turns, so that a
conversation of any length needs the memory of one part. Null text and null role count as empty. Repeated rows are turns
of their own. A null conv_id is a conversation. An empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from enum import Enum
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import partitions, ship

PART_CHARS = 1 << 20


class Mark(Enum):
    """What closures yield besides text."""

    BEGIN = 1
    END = 2
    BREAK = 3


BEGIN, END, BREAK = Mark.BEGIN, Mark.END, Mark.BREAK
DEFAULT = (
    "{% for m in messages %}{{ '### ' ~ (m.role | escape_role) ~ ': ' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '</turn>' + '\\n' }}{% endfor %}"
)

_SPECIAL, _SPECIAL_ROLE, _ESCAPED = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]"), re.compile(r"\\(.)", re.S)
FILTERS: dict[str, Callable[[str], str]] = {
    "escape": lambda s: _SPECIAL.sub(r"\\\g<0>", s),
    "escape_role": lambda s: _SPECIAL_ROLE.sub(r"\\\g<0>", s),
    "trim": str.strip,
    "lower": str.lower,
    "upper": str.upper,
}


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


class TemplateError(ValueError):
    pass


# --- parsing -------------------------------------------------------------------------------------------

_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKENS = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[-+~|.()\[\]=]))""", re.S)
_UNQUOTE = {"n": "\n", "t": "\t", "r": "\r"}


class _Expr:
    """Recursive descent over one expression; nodes are tuples ("const", v), ("name", n), ("item", a, b), (op, a, b)."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while source[at:].strip():
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:].strip()[:10]!r} in {source.strip()!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> bool:
        found = self.peek(*values)
        self.at += found
        return found

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        name = self.tokens[self.at - 1][1]
        if name.startswith("_"):
            raise TemplateError(f"name {name!r} is not allowed")
        return name

    def whole(self) -> tuple:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.joined()
        for op in ("==", "!=", "in"):
            if self.take(op):
                return (op, node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while self.peek("+", "~"):
            self.at += 1
            node = (self.tokens[self.at - 1][1], node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while True:
            if self.take("."):
                node = ("item", node, ("const", self.name()))
            elif self.take("["):
                node = ("item", node, self.either())
                self.need("]")
            elif self.take("|"):
                if (name := self.name()) not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                node = ("filter", node, ("const", name))
            else:
                return node

    def atom(self) -> tuple:
        if self.take("("):
            node = self.either()
            self.need(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        if kind == "str":
            self.at += 1
            return ("const", _ESCAPED.sub(lambda m: _UNQUOTE.get(m[1], m[1]), value[1:-1]))
        if kind == "num":
            self.at += 1
            return ("const", int(value))
        name = self.name()
        return ("const", {"true": True, "false": False, "none": None}[name]) if name in ("true", "false", "none") else ("name", name)


def parse(source: str) -> tuple:
    """The syntax tree: ("block", nodes) of ("text", s), ("out", e), ("for", name, e, block), ("if", [(e, block)], block), ("set", name, e), ("gen", block)."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _TAGS.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        if m[1] is not None:
            parts.append(("out", m[1]))
        elif m[2] is not None:
            parts.append(("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    parts.reverse()

    def block(*ends: str) -> tuple[tuple, str]:
        nodes: list[tuple] = []
        while parts:
            kind, value = parts.pop()
            if kind == "text":
                nodes.append(("text", value))
                continue
            if kind == "out":
                nodes.append(("out", _Expr(value).whole()))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return ("block", nodes), value
            if word == "for":
                e = _Expr(rest)
                name = e.name()
                e.need("in")
                over = e.whole()
                nodes.append(("for", name, over, block("endfor")[0]))
            elif word == "if":
                cases, test = [], _Expr(rest).whole()
                while True:
                    body, end = block("elif", "else", "endif")
                    cases.append((test, body))
                    if end.startswith("elif"):
                        test = _Expr(end[4:]).whole()
                        continue
                    nodes.append(("if", cases, block("endif")[0] if end == "else" else ("block", [])))
                    break
            elif word == "set":
                e = _Expr(rest)
                name = e.name()
                e.need("=")
                nodes.append(("set", name, e.whole()))
            elif word == "generation":
                nodes.append(("gen", block("endgeneration")[0]))
            else:
                raise TemplateError(f"unexpected tag {value!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return ("block", nodes), ""

    return block()[0]


# --- folding -------------------------------------------------------------------------------------------


def _str(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _item(value: object, key: object) -> object:
    """Items of mappings only."""
    return value.get(key) if isinstance(value, dict) else None


def _plus(a: object, b: object) -> object:
    if type(a) is not type(b) or not isinstance(a, (str, int)):
        raise TemplateError("+ takes two texts or two numbers")
    return a + b


_BINARY: dict[str, Callable] = {
    "+": _plus, "~": lambda a, b: _str(a) + _str(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "in": lambda a, b: isinstance(b, (str, list, dict)) and (not isinstance(b, str) or isinstance(a, str)) and a in b, "item": _item, "filter": lambda a, f: FILTERS[f](_str(a)),
}


def fold_expr(e: tuple) -> tuple:
    op = e[0]
    if op in ("const", "name"):
        return e
    args = [fold_expr(x) for x in e[1:]]
    if op == "not":
        return ("const", not args[0][1]) if args[0][0] == "const" else ("not", *args)
    if op in ("and", "or"):
        if args[0][0] == "const":
            return args[1] if bool(args[0][1]) == (op == "and") else args[0]
        return (op, *args)
    if all(x[0] == "const" for x in args):
        return ("const", _BINARY[op](args[0][1], args[1][1]))
    if op == "~" and args[0][0] == "~" and args[0][2][0] == args[1][0] == "const":
        return ("~", args[0][1], ("const", _str(args[0][2][1]) + _str(args[1][1])))
    return (op, *args)


def fold(block: tuple) -> tuple:
    """The tree with constant expressions evaluated, decided branches taken and neighbouring texts joined."""
    out: list[tuple] = []

    def put(node: tuple) -> None:
        if node[0] == "block":
            for x in node[1]:
                put(x)
        elif node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in block[1]:
        if node[0] == "out":
            e = fold_expr(node[1])
            put(("text", _str(e[1])) if e[0] == "const" else ("out", e))
        elif node[0] == "if":
            cases, rest = [], fold(node[2])
            for test, body in node[1]:
                test = fold_expr(test)
                if test[0] == "const" and not test[1]:
                    continue
                if test[0] == "const":
                    rest = fold(body)
                    break
                cases.append((test, fold(body)))
            put(("if", cases, rest) if cases else rest)
        elif node[0] == "for":
            put(("for", node[1], fold_expr(node[2]), fold(node[3])))
        elif node[0] == "set":
            put(("set", node[1], fold_expr(node[2])))
        elif node[0] == "gen":
            put(("gen", fold(node[1])))
        else:
            put(node)
    return ("block", out)


# --- closures ------------------------------------------------------------------------------------------


def _expr(e: tuple) -> Callable[[dict], object]:
    op = e[0]
    if op == "const":
        return lambda c, v=e[1]: v
    if op == "name":
        return lambda c, n=e[1]: c.get(n)
    args = [_expr(x) for x in e[1:]]
    if op == "not":
        return lambda c, a=args[0]: not a(c)
    if op == "and":
        return lambda c, a=args[0], b=args[1]: a(c) and b(c)
    if op == "or":
        return lambda c, a=args[0], b=args[1]: a(c) or b(c)
    return lambda c, a=args[0], b=args[1], f=_BINARY[op]: f(a(c), b(c))


def _node(node: tuple) -> Callable[[dict], Iterator]:
    kind = node[0]
    if kind == "block":
        parts = [_node(x) for x in node[1]]

        def block(c):
            for p in parts:
                yield from p(c)

        return block
    if kind == "text":
        return lambda c, t=(node[1],): iter(t)
    if kind == "out":
        return lambda c, f=_expr(node[1]): iter((_str(f(c)),))
    if kind == "set":

        def put(c, name=node[1], f=_expr(node[2])):
            c[name] = f(c)
            return iter(())

        return put
    if kind == "gen":

        def generation(c, body=_node(node[1])):
            yield BEGIN
            yield from body(c)
            yield END

        return generation
    if kind == "if":
        cases, rest = [(_expr(t), _node(b)) for t, b in node[1]], _node(node[2])

        def branch(c):
            for test, body in cases:
                if test(c):
                    return body(c)
            return rest(c)

        return branch

    def loop(c, name=node[1], over=_expr(node[2]), body=_node(node[3])):
        own = dict(c)
        for k, x in enumerate(over(c) or ()):
            own[name] = x
            own["loop"] = {"first": k == 0, "index": k + 1}
            yield from body(own)
            yield BREAK

    return loop


def compile_template(source: str) -> Callable[[dict], Iterator]:
    """A function of the variables that yields texts, BEGIN and END around generation, and BREAK after each turn of a loop."""
    return _node(fold(parse(source)))


# --- formatting and reading back -----------------------------------------------------------------------

PARTS = "conv_id {0}, part int, text string, loss_start array<int>, loss_end array<int>"


def format_conversations(conversations: DataFrame, template: str = DEFAULT, *, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part, text, loss_start, loss_end: the rendered conversations and what the loss covers, as code point spans of text. Parts of a conversation follow each other in one partition."""
    ship(conversations.sparkSession)
    key = dict(conversations.dtypes)["conv_id"]

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = compile_template(template)
        key_type = None

        def rows():
            nonlocal key_type
            for b in batches:
                key_type = b.schema.field(0).type
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())

        done: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*done))
            out = [pa.array(cols[0], key_type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), *(pa.array(c, pa.list_(pa.int32())) for c in cols[3:])]
            done.clear()
            return pa.RecordBatch.from_arrays(out, ["conv_id", "part", "text", "loss_start", "loss_end"])

        held = 0
        for conv, own in groupby(rows(), key=lambda r: r[0]):
            messages = ({"role": r[1] or "", "text": r[2] or ""} for r in own)
            part, size, text, starts, ends, depth = 0, 0, [], [], [], 0
            for x in write({"messages": messages}):
                if x is BEGIN:
                    depth += 1
                    if depth == 1:
                        starts.append(size)
                elif x is END:
                    depth -= 1
                    if depth == 0:
                        ends.append(size)
                elif x is BREAK:
                    if size >= part_chars and not depth:
                        done.append((conv, part, "".join(text), starts, ends))
                        yield batch()
                        held, part, size, text, starts, ends = 0, part + 1, 0, [], [], []
                else:
                    text.append(x)
                    size += len(x)
            done.append((conv, part, "".join(text), starts, ends))
            held += size
            if held >= part_chars or len(done) >= 5000:
                yield batch()
                held = 0
        if done:
            yield batch()

    return (
        conversations.select("conv_id", "role", "text", "turn").repartition(partitions(conversations.sparkSession), "conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(render, PARTS.format(key))
    )


_TURN = re.compile(r"### ([^\\<#:]*(?:\\.[^\\<#:]*)*): ([^\\<#]*(?:\\.[^\\<#]*)*)</turn>\n", re.S)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a text that DEFAULT has rendered."""
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield unescape(m[1]), unescape(m[2])
        at = m.end()


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from format_conversations() with DEFAULT, part by part as they stand in their partitions."""
    key = dict(formatted.dtypes)["conv_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type = None

        def parts():
            nonlocal key_type
            for b in batches:
                key_type = b.schema.field(0).type
                yield from zip(*(b.column(i).to_pylist() for i in range(5)))

        done: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*done))
            kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for conv, own in groupby(parts(), key=lambda r: r[0]):
            turns, loss, n, covered, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, _, text, starts, ends in own:
                chars += len(text)
                for role, said in read_turns(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for a, b in zip(starts, ends):
                    said = unescape(text[a:b])
                    covered += len(said)
                    loss.update(said.encode())
            done.append((conv, n, turns.hexdigest(), covered, loss.hexdigest(), chars))
            if len(done) >= 5000:
                yield batch()
        if done:
            yield batch()

    return formatted.mapInArrow(read, f"conv_id {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
