"""Chat formatting: a compiler for a sandboxed template language.

A template is parsed into a syntax tree, constants are folded, and the tree becomes
nested Python closures. Rendering a conversation yields the text and the spans that
``generation`` blocks marked, in code points. The language has text, ``{{ expr }}``,
``{% for x in y %}``, ``{% if %}/{% elif %}/{% else %}`` and ``{% generation %}``;
expressions have names, fields, string and integer constants, ``==``, ``!=``, ``+``,
``and``, ``or``, ``not``, parentheses and ``| filter``. Names reach the given values and
fields reach keys of mappings, nothing else: no attributes, calls or indexing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: what marks turns, and must not occur inside texts.
OPEN, CLOSE = "<turn>", "</turn>\n"
CONTROL = ("<turn", "</turn", "###")
TEMPLATE = (
    "{% for turn in turns %}" + OPEN + "{{ turn.role | line }}\n"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}{{ turn.text | escape }}{% endif %}" + CLOSE + "{% endfor %}"
)


_BREAK = re.compile(r"<(?=/?turn)|#(?=#)")


def escape(text: str) -> str:
    """Double backslashes, and put one where a control string would go on.

    That is after each ``<`` of a turn mark and after each ``#`` before another, so no
    control string is left however they overlap.
    """
    return _BREAK.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def escape_line(text: str) -> str:
    """As ``escape``, and a line feed becomes backslash, n."""
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    """Undo ``escape`` and ``escape_line``."""
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """A template that the language does not allow."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Emit:
    value: object


@dataclass(frozen=True)
class For:
    var: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # of (condition, body)


@dataclass(frozen=True)
class Generation:
    body: tuple


_QUOTED = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
#: A tag ends at its first mark outside of string constants.
_TAG = re.compile(rf"\{{\{{((?:{_QUOTED}|(?!\}}\}})[^'\"])*)\}}\}}|\{{%((?:{_QUOTED}|(?!%\}})[^'\"])*)%\}}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)|(==|!=|[|+()]))")


@dataclass
class _Expression:
    """Recursive descent over the tokens of one expression."""

    tokens: list = field(default_factory=list)
    at: int = 0

    @classmethod
    def parse(cls, source: str):
        e, i = cls(), 0
        source = source.strip()
        while i < len(source):
            m = _TOKEN.match(source, i)
            if not m:
                raise TemplateError(f"unexpected {source[i:]!r}")
            e.tokens.append(m.groups())
            i = m.end()
        out = e.either()
        if e.at != len(e.tokens):
            raise TemplateError(f"unexpected end in {source!r}")
        return out

    def next_is(self, *words: str) -> str | None:
        if self.at < len(self.tokens) and (w := self.tokens[self.at][2] or self.tokens[self.at][3]) in words:
            self.at += 1
            return w
        return None

    def either(self):
        left = self.both()
        while self.next_is("or"):
            left = Op("or", (left, self.both()))
        return left

    def both(self):
        left = self.negated()
        while self.next_is("and"):
            left = Op("and", (left, self.negated()))
        return left

    def negated(self):
        return Op("not", (self.negated(),)) if self.next_is("not") else self.compared()

    def compared(self):
        left = self.joined()
        return Op(op, (left, self.joined())) if (op := self.next_is("==", "!=")) else left

    def joined(self):
        left = self.filtered()
        while self.next_is("+"):
            left = Op("+", (left, self.filtered()))
        return left

    def filtered(self):
        left = self.atom()
        while self.next_is("|"):
            name = self.tokens[self.at][2] if self.at < len(self.tokens) else None
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            left = Op("|" + name, (left,))
        return left

    def atom(self):
        if self.next_is("("):
            inner = self.either()
            if not self.next_is(")"):
                raise TemplateError("missing )")
            return inner
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        text, number, name, sign = self.tokens[self.at]
        self.at += 1
        if text is not None:
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.S))
        if number is not None:
            return Const(int(number))
        if sign is not None or name in ("and", "or", "not", "in"):
            raise TemplateError(f"unexpected {sign or name!r}")
        return Const({"true": True, "false": False}[name]) if name in ("true", "false") else Name(tuple(name.split(".")))


def parse(template: str) -> tuple:
    """The syntax tree of a template, not yet folded."""
    pieces, i = [], 0
    for m in _TAG.finditer(template):
        pieces += [("text", template[i : m.start()])] * (m.start() > i)
        pieces.append(("emit", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        i = m.end()
    pieces += [("text", template[i:])] * (i < len(template))
    for kind, value in pieces:
        if kind == "text" and (m := re.search(r"\{[{%]", value)):
            raise TemplateError(f"a tag is not closed: {value[m.start() :][:40]!r}")
    at = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        body = []
        while at < len(pieces):
            kind, value = pieces[at]
            at += 1
            if kind == "text":
                body.append(Emit(Const(value)))
            elif kind == "emit":
                body.append(Emit(_Expression.parse(value)))
            elif value.split(" ")[0] in ends:
                return tuple(body), value
            elif m := re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", value, re.S):
                inner, _ = block("endfor")
                body.append(For(m[1], _Expression.parse(m[2]), inner))
            elif value.startswith("if "):
                branches, test, after = [], value[3:], ("elif", "else", "endif")
                while True:
                    inner, end = block(*after)
                    branches.append((_Expression.parse(test), inner))
                    if end == "endif":
                        break
                    if end == "else":
                        test, after = "true", ("endif",)  # nothing may follow but the end
                    elif end.startswith("elif "):
                        test = end[5:]
                    else:
                        raise TemplateError(f"unexpected tag {end!r}")
                body.append(If(tuple(branches)))
            elif value == "generation":
                inner, _ = block("endgeneration")
                body.append(Generation(inner))
            else:
                raise TemplateError(f"unexpected tag {value!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(body), ""

    return block()[0]


def _apply(op: str, values: list):
    text = lambda x: "" if x is None else x if isinstance(x, str) else str(x)
    if op[0] == "|":
        return FILTERS[op[1:]](text(values[0]))
    if op == "not":
        return not values[0]
    a, b = values
    if op == "+":
        return a + b if isinstance(a, int) and isinstance(b, int) else text(a) + text(b)
    return a == b if op == "==" else a != b


def _fold_expression(e):
    if not isinstance(e, Op):
        return e
    args = tuple(map(_fold_expression, e.args))
    if e.op in ("and", "or") and isinstance(args[0], Const):
        return args[1] if bool(args[0].value) == (e.op == "and") else args[0]
    if e.op not in ("and", "or") and all(isinstance(a, Const) for a in args):
        return Const(_apply(e.op, [a.value for a in args]))
    return replace(e, args=args)


def fold(nodes: tuple) -> tuple:
    """Constant expressions are evaluated, dead branches dropped, texts joined."""
    out: list = []

    def add(n):
        if isinstance(n, Emit) and isinstance(n.value, Const):
            n = Emit(Const("" if n.value.value is None else str(n.value.value)))
            if out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                n = Emit(Const(out.pop().value.value + n.value.value))
            if not n.value.value:
                return
        out.append(n)

    for n in nodes:
        if isinstance(n, Emit):
            add(Emit(_fold_expression(n.value)))
        elif isinstance(n, For):
            add(For(n.var, _fold_expression(n.over), fold(n.body)))
        elif isinstance(n, Generation):
            add(Generation(fold(n.body)))
        else:
            live = []
            for test, body in n.branches:
                test = _fold_expression(test)
                if isinstance(test, Const) and not test.value:
                    continue
                live.append((test, fold(body)))
                if isinstance(test, Const):
                    break
            if live and isinstance(live[0][0], Const):
                for x in live[0][1]:
                    add(x)
            elif live:
                add(If(tuple(live)))
    return tuple(out)


class _Out:
    """What a rendering writes to."""

    __slots__ = ("parts", "length", "spans")

    def __init__(self):
        self.parts, self.length, self.spans = [], 0, []


def _expression(e) -> Callable[[dict], object]:
    if isinstance(e, Const):
        return lambda env, v=e.value: v
    if isinstance(e, Name):
        first, *rest = e.path

        def look(env):
            v = env.get(first)
            for k in rest:
                v = v.get(k) if isinstance(v, dict) else None
            return v

        return look
    args = [_expression(a) for a in e.args]
    if e.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if e.op == "or":
        return lambda env: args[0](env) or args[1](env)
    if e.op[0] == "|":
        f, a = FILTERS[e.op[1:]], args[0]
        return lambda env: f("" if (v := a(env)) is None else v if isinstance(v, str) else str(v))
    return lambda env, op=e.op: _apply(op, [a(env) for a in args])


def _block(nodes: tuple) -> Callable[[dict, _Out], None]:
    steps = [_statement(n) for n in nodes]

    def run(env, out):
        for s in steps:
            s(env, out)

    return run


def _statement(n) -> Callable[[dict, _Out], None]:
    if isinstance(n, Emit):
        value = _expression(n.value)

        def emit(env, out):
            v = value(env)
            v = "" if v is None else v if isinstance(v, str) else str(v)
            out.parts.append(v)
            out.length += len(v)

        return emit
    if isinstance(n, For):
        over, body, var = _expression(n.over), _block(n.body), n.var

        def loop(env, out):
            items = over(env)
            if not isinstance(items, (list, tuple)):
                raise TemplateError("for goes over lists only")
            inner = dict(env)
            for i, x in enumerate(items):
                inner[var], inner["loop"] = x, {"index": i + 1, "first": i == 0, "last": i == len(items) - 1}
                body(inner, out)

        return loop
    if isinstance(n, Generation):
        body = _block(n.body)

        def marked(env, out):
            start = out.length
            body(env, out)
            out.spans.append((start, out.length))

        return marked
    branches = [(_expression(t), _block(b)) for t, b in n.branches]

    def choose(env, out):
        for test, body in branches:
            if test(env):
                return body(env, out)

    return choose


def compile_template(template: str = TEMPLATE) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from values to (text, generation spans)."""
    run = _block(fold(parse(template)))

    def render(values: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        run(values, out)
        return "".join(out.parts), out.spans

    return render


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a text that ``TEMPLATE`` made."""
    turns = []
    for piece in formatted.split(CLOSE)[:-1]:
        role, _, text = piece[len(OPEN) :].partition("\n")
        turns.append((unescape(role), unescape(text)))
    return turns


def _formatted(template: str):
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])

    def run(batches):
        render = compile_template(template)
        for b in batches:
            out = []
            for conv, turns in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text, spans = render({"turns": [{"role": t["role"] or "", "text": t["text"] or ""} for t in turns]})
                out.append({"conv_id": conv, "n_turns": len(turns), "formatted": text, "spans": [list(s) for s in spans]})
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, formatted, spans (generation spans in code points), per conversation.

    ``turns`` has conv_id, turn, role, text. A conversation's rows go in order of turn
    (nulls first), ties by role and text; repeated rows are turns of their own. Null
    roles and texts are empty. Rows with null conv_id form one conversation. An empty
    table gives no rows; other columns are not read. A conversation is rendered by
    one task, as its output is one value.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", "role", "text").alias("t"))
    groups = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return groups.mapInArrow(_formatted(template), "conv_id long, n_turns long, formatted string, spans array<array<long>>")


def _digest(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_spans", pa.int64())])
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for b in batches:
        out = []
        for conv, text, spans in zip(*(b.column(k).to_pylist() for k in ("conv_id", "formatted", "spans")), strict=True):
            turns = read_back(text)
            loss = "".join(unescape(text[a:z]) for a, z in spans)
            out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text), len(spans)))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, as digests."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_spans long")
