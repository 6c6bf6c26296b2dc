"""A small sandboxed template language for conversations, compiled to closures; no Spark here.

    {{ expr }}                          output of an expression
    {% for m in messages %} … {% endfor %}
    {% if expr %} … {% elif expr %} … {% else %} … {% endif %}
    {% generation %} … {% endgeneration %}   what is rendered inside is marked
Expressions: strings, whole numbers, true, false, names, m.field, == != + and or not, ( ), and filters (expr | name).
Names are looked up in the values given and nowhere else; there are no calls, no attributes of objects, no other loops.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+().|]))")
FILTERS: dict[str, Callable[[str], str]] = {"trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """The template can't be parsed, or names what isn't there."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str
    field: str | None = None


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Output:
    expr: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    arms: tuple  # of (condition, body)


@dataclass(frozen=True)
class Generation:
    body: tuple


def _expression(source: str):
    tokens, at = [], 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        kind = m.lastindex
        tokens.append((kind, m[kind]))
        at = m.end()
    tokens.append((0, ""))
    pos = 0

    def take(*wanted):
        nonlocal pos
        if tokens[pos][1] in wanted and tokens[pos][0] in (3, 4):
            pos += 1
            return tokens[pos - 1][1]
        return None

    def atom():
        nonlocal pos
        kind, text = tokens[pos]
        pos += 1
        if kind == 1:
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        if kind == 2:
            return Const(int(text))
        if kind == 3:
            if text in ("true", "false"):
                return Const(text == "true")
            if take("."):
                pos += 1
                return Name(text, tokens[pos - 1][1])
            return Name(text)
        if text == "(":
            inner = either()
            if not take(")"):
                raise TemplateError(f"missing ) in {source!r}")
            return inner
        raise TemplateError(f"unexpected {text!r} in {source!r}")

    def piped():
        nonlocal pos
        out = atom()
        while take("|"):
            pos += 1
            if tokens[pos - 1][1] not in FILTERS:
                raise TemplateError(f"no filter {tokens[pos - 1][1]!r}")
            out = Op("|", (out, tokens[pos - 1][1]))
        return out

    def added():
        out = piped()
        while take("+"):
            out = Op("+", (out, piped()))
        return out

    def compared():
        out = added()
        while kind := take("==", "!="):
            out = Op(kind, (out, added()))
        return out

    def negated():
        return Op("not", (negated(),)) if take("not") else compared()

    def both():
        out = negated()
        while take("and"):
            out = Op("and", (out, negated()))
        return out

    def either():
        out = both()
        while take("or"):
            out = Op("or", (out, both()))
        return out

    tree = either()
    if tokens[pos][0]:
        raise TemplateError(f"unexpected {tokens[pos][1]!r} in {source!r}")
    return tree


def parse(source: str) -> tuple:
    """The template's syntax tree: a tuple of nodes."""
    parts, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        parts.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    pos = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal pos
        out = []
        while pos < len(parts):
            kind, text = parts[pos]
            pos += 1
            if kind == "text":
                out.append(Output(Const(text)))
            elif kind == "out":
                out.append(Output(_expression(text)))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return tuple(out), text
                if word == "for":
                    m = re.fullmatch(r"\s*(\w+)\s+in\s+(\w+)\s*", rest)
                    if not m:
                        raise TemplateError(f"cannot read {text!r}")
                    body, _ = block("endfor")
                    out.append(For(m[1], Name(m[2]), body))
                elif word == "if":
                    arms, cond, end = [], _expression(rest), ""
                    while end != "endif":
                        body, end = block("elif", "else", "endif")
                        arms.append((cond, body))
                        cond = _expression(end.partition(" ")[2]) if end.startswith("elif") else Const(True)
                    out.append(If(tuple(arms)))
                elif word == "generation":
                    body, _ = block("endgeneration")
                    out.append(Generation(body))
                else:
                    raise TemplateError(f"unknown tag {text!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(out), ""

    return block()[0]


def _apply(kind: str, args: list):
    if kind == "|":
        return FILTERS[args[1]](str(args[0]))
    if kind == "+":
        return args[0] + args[1]
    if kind in ("==", "!="):
        return (args[0] == args[1]) == (kind == "==")
    return not args[0]


def fold(nodes: tuple) -> tuple:
    """The same tree with constant expressions computed, dead arms gone and neighbouring constant outputs joined."""

    def expr(e):
        if not isinstance(e, Op):
            return e
        args = tuple(expr(a) if not isinstance(a, str) else a for a in e.args)
        if e.kind in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (e.kind == "and") else args[0]
        if e.kind not in ("and", "or") and all(isinstance(a, (Const, str)) for a in args):
            return Const(_apply(e.kind, [a.value if isinstance(a, Const) else a for a in args]))
        return Op(e.kind, args)

    out = []
    for n in nodes:
        if isinstance(n, Output):
            n = Output(expr(n.expr))
            if isinstance(n.expr, Const) and out and isinstance(out[-1], Output) and isinstance(out[-1].expr, Const):
                n = Output(Const(str(out.pop().expr.value) + str(n.expr.value)))
            out.append(n)
        elif isinstance(n, For):
            out.append(For(n.name, n.over, fold(n.body)))
        elif isinstance(n, Generation):
            out.append(Generation(fold(n.body)))
        else:
            arms = []
            for cond, body in n.arms:
                cond = expr(cond)
                if isinstance(cond, Const) and not cond.value:
                    continue
                arms.append((cond, fold(body)))
                if isinstance(cond, Const):
                    break
            if arms and isinstance(arms[0][0], Const):
                out += arms[0][1]
            elif arms:
                out.append(If(tuple(arms)))
    return tuple(out)


class Writer:
    """Rendered text and the spans (in code points) of generation blocks."""

    def __init__(self):
        self.parts, self.size, self.spans = [], 0, []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def compile_template(source: str, escape: Callable[[str], str] = str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from values (names to strings, or lists of dicts of strings) to the text and the spans of its generation blocks.

    What comes out of values is passed through ``escape``; what the template itself writes is not.
    """

    def expr(e):
        if isinstance(e, Const):
            return lambda _, v=e.value: v
        if isinstance(e, Name):
            if e.field is None:
                return lambda env: env[e.name]
            return lambda env: env[e.name][e.field]
        if e.kind == "and":
            a, b = map(expr, e.args)
            return lambda env: a(env) and b(env)
        if e.kind == "or":
            a, b = map(expr, e.args)
            return lambda env: a(env) or b(env)
        args = [expr(a) if not isinstance(a, str) else (lambda _, v=a: v) for a in e.args]
        return lambda env: _apply(e.kind, [a(env) for a in args])

    def body(nodes):
        steps = [step(n) for n in nodes]

        def run(env, out):
            for s in steps:
                s(env, out)

        return run

    def step(n):
        if isinstance(n, Output):
            f = expr(n.expr)
            if isinstance(n.expr, Const):
                text = str(n.expr.value)
                return lambda env, out: out.write(text)
            return lambda env, out: out.write(escape(str(f(env))))
        if isinstance(n, For):
            over, inner = expr(n.over), body(n.body)

            def loop(env, out):
                for x in over(env):
                    inner({**env, n.name: x}, out)

            return loop
        if isinstance(n, Generation):
            inner = body(n.body)

            def mark(env, out):
                start = out.size
                inner(env, out)
                out.spans.append((start, out.size))

            return mark
        arms = [(expr(c), body(b)) for c, b in n.arms]

        def choose(env, out):
            for cond, inner in arms:
                if cond(env):
                    inner(env, out)
                    return

        return choose

    run = body(fold(parse(source)))

    def render(values: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Writer()
        try:
            run(dict(values), out)
        except KeyError as e:
            raise TemplateError(f"no value {e}") from e
        return "".join(out.parts), out.spans

    return render
