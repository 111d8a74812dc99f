"""Chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants
are folded, and Python closures are generated that render a conversation turn
by turn and mark which text the model is to generate.

    {{ expression }}   output
    {% for m in messages %} ... {% endfor %}
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}   text under the loss mask

Expressions have strings, numbers, names, m.role, m.text, m.turn, loop.first,
loop.index, ==, !=, in, not, and, or, +, parentheses, and filters (x | escape).
Nothing else can be reached from a template.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The production template: control strings begin with <, which texts only have escaped.
TEMPLATE = "{% for m in messages %}<turn {{ m.role | escape }}>\n{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}\n</turn>\n{% endfor %}"
#: A turn of it: role, and text with the line end that follows it. Possessive, so linear in texts of any length.
TURN = re.compile(r"<turn ((?:[^\\<>]++|\\.)*+)>\n((?:[^\\<>]++|\\.)*+)</turn>\n", re.S)
#: Characters of formatted text after which a chunk ends.
CHUNK = 1 << 20


def escape(text: str) -> str:
    """text with a backslash before each backslash, < and >."""
    return text.replace("\\", "\\\\").replace("<", "\\<").replace(">", "\\>")


def unescape(text: str) -> str:
    """The text that was escaped."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "lower": str.lower, "upper": str.upper, "title": str.title}
FIELDS = {"m": ("role", "text", "turn"), "loop": ("first", "index")}


class TemplateError(ValueError):
    """A template that is not in the language."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Field:
    owner: str
    name: str


@dataclass(frozen=True)
class Call:
    op: str
    args: tuple


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


LEXER = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[|().+]))")
BINARY = ({"or"}, {"and"}, {"==", "!=", "in"}, {"+"})
OPS: dict[str, Callable] = {"or": lambda a, b: a or b, "and": lambda a, b: a and b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: str(a) in str(b), "+": lambda a, b: str(a) + str(b), "not": lambda a: not a}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str, names: frozenset[str]):
        self.tokens, self.names, at = [], names, 0
        source = source.rstrip()
        while at < len(source):
            m = LEXER.match(source, at)
            if not m:
                raise TemplateError(f"not an expression: {source!r}")
            self.tokens.append(m)
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][0].strip() if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][0].strip()

    def whole(self):
        tree = self.binary(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()!r}")
        return tree

    def binary(self, level: int):
        if level == len(BINARY):
            return self.piped()
        if level == 2 and self.peek() == "not":
            self.take()
            return Call("not", (self.binary(level),))
        tree = self.binary(level + 1)
        while self.peek() in BINARY[level]:
            tree = Call(self.take(), (tree, self.binary(level + 1)))
        return tree

    def piped(self):
        tree = self.atom()
        while self.peek() == "|":
            self.take()
            if self.peek() not in FILTERS:
                raise TemplateError(f"no filter {self.peek()!r}")
            tree = Call("|" + self.take(), (tree,))
        return tree

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        m = self.tokens[self.at]
        token = self.take()
        if m[1]:
            return Const(re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), token[1:-1]))
        if m[2]:
            return Const(int(token))
        if token == "(":
            tree = self.binary(0)
            if self.peek() != ")":
                raise TemplateError("a parenthesis is open")
            self.take()
            return tree
        if token in ("true", "false"):
            return Const(token == "true")
        if token in self.names and self.peek() == ".":
            self.take()
            field = self.take() if self.peek() else ""
            owner = "loop" if token == "loop" else "m"
            if field not in FIELDS[owner]:
                raise TemplateError(f"no field {token}.{field}")
            return Field(owner, field)
        raise TemplateError(f"unknown name {token!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    pieces = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S)
    at = 0

    def block(ends: tuple[str, ...], names: frozenset[str]) -> tuple[tuple, str]:
        nonlocal at
        out: list = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece.startswith("{{"):
                out.append(Out(_Expression(piece[2:-2], names).whole()))
            elif piece.startswith("{%"):
                tag, _, rest = piece[2:-2].strip().partition(" ")
                if tag in ends:
                    return tuple(out), f"{tag} {rest}".strip()
                if tag == "for":
                    m = re.fullmatch(r"(\w+) in messages", rest.strip())
                    if not m or names:
                        raise TemplateError(f"not a loop over the messages: {rest!r}")
                    out.append(For(m[1], block(("endfor",), frozenset({m[1], "loop"}))[0]))
                elif tag == "if":
                    out.append(branch(rest, names))
                elif tag == "generation":
                    out.append(Generation(block(("endgeneration",), names)[0]))
                else:
                    raise TemplateError(f"unexpected tag {tag!r}")
            elif piece:
                out.append(Out(Const(piece)))
        if ends:
            raise TemplateError(f"no {ends[-1]}")
        return tuple(out), ""

    def branch(test: str, names: frozenset[str]) -> If:
        tree = _Expression(test, names).whole()
        then, end = block(("elif", "else", "endif"), names)
        if end.startswith("elif"):
            return If(tree, then, (branch(end[5:], names),))
        return If(tree, then, block(("endif",), names)[0] if end == "else" else ())

    return block((), frozenset())[0]


def fold(tree):
    """The tree with constant expressions computed, dead branches dropped and neighbouring constant texts joined."""
    if isinstance(tree, Call):
        args = tuple(map(fold, tree.args))
        if all(isinstance(a, Const) for a in args):
            values = [a.value for a in args]
            return Const(FILTERS[tree.op[1:]](str(values[0])) if tree.op[0] == "|" else OPS[tree.op](*values))
        return Call(tree.op, args)
    if isinstance(tree, Out):
        return Out(fold(tree.value))
    if isinstance(tree, For):
        return For(tree.name, fold(tree.body))
    if isinstance(tree, Generation):
        return Generation(fold(tree.body))
    if isinstance(tree, If):
        test = fold(tree.test)
        if isinstance(test, Const):
            return fold(tree.then if test.value else tree.other)
        return If(test, fold(tree.then), fold(tree.other))
    if not isinstance(tree, tuple):
        return tree
    out: list = []
    for x in map(fold, tree):
        for y in x if isinstance(x, tuple) else (x,):
            if isinstance(y, Out) and isinstance(y.value, Const) and out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                out[-1] = Out(Const(str(out[-1].value.value) + str(y.value.value)))
            else:
                out.append(y)
    return tuple(out)


def _value(tree) -> Callable[[dict], object]:
    if isinstance(tree, Const):
        return lambda env, v=tree.value: v
    if isinstance(tree, Field):
        return lambda env, o=tree.owner, n=tree.name: env[o][n]
    args = [_value(a) for a in tree.args]
    if tree.op[0] == "|":
        return lambda env, f=FILTERS[tree.op[1:]], a=args[0]: f(str(a(env)))
    if tree.op == "not":
        return lambda env, a=args[0]: not a(env)
    if tree.op in ("and", "or"):
        return lambda env, a=args[0], b=args[1], both=tree.op == "and": (a(env) and b(env)) if both else (a(env) or b(env))
    return lambda env, f=OPS[tree.op], a=args[0], b=args[1]: f(a(env), b(env))


Render = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def _closure(tree) -> Render:
    if isinstance(tree, tuple):
        parts = [_closure(x) for x in tree]

        def all_parts(env: dict, gen: bool) -> Iterator[tuple[str, bool]]:
            for p in parts:
                yield from p(env, gen)

        return all_parts
    if isinstance(tree, Out):
        value = _value(tree.value)

        def out(env: dict, gen: bool) -> Iterator[tuple[str, bool]]:
            yield str(value(env)), gen

        return out
    if isinstance(tree, Generation):
        body = _closure(tree.body)
        return lambda env, gen: body(env, True)
    if isinstance(tree, If):
        test, then, other = _value(tree.test), _closure(tree.then), _closure(tree.other)
        return lambda env, gen: then(env, gen) if test(env) else other(env, gen)
    body = _closure(tree.body)

    def loop(env: dict, gen: bool) -> Iterator[tuple[str, bool]]:
        for i, m in enumerate(env["messages"]):
            yield from body({"m": m, "loop": {"first": i == 0, "index": i + 1}}, gen)

    return loop


def compile_template(source: str) -> Callable[[Iterator[dict]], Iterator[tuple[str, bool]]]:
    """A function from messages (role, text, turn), read one by one, to pieces of text, each with whether it is generated."""
    render = _closure(fold(parse(source)))
    return lambda messages: render({"messages": messages}, False)


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, chunk, formatted, spans: each conversation's text, and where in the chunk generated text stands, in characters.

    turns: conv_id, turn, role, text. Turns are ordered by turn, then role and
    text (nulls first), so ties and repeated rows have one order; null role or
    text: empty; null ids are one conversation; other columns are ignored; an
    empty table gives no rows. Rows of a conversation are sorted by Spark and
    stream through the closures; a conversation of more than CHUNK characters
    gives more than one chunk, so no task holds a whole one.
    """
    parse(template)  # errors on the driver

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        rows = (r for b in batches for r in b.to_pylist())
        ahead: list[dict] = [r for r in [next(rows, None)] if r]

        def conversation() -> Iterator[dict]:
            own = ahead[0]["conv_id"]
            while ahead and ahead[0]["conv_id"] == own:
                yield {"role": ahead[0]["role"] or "", "text": ahead[0]["text"] or "", "turn": ahead[0]["turn"]}
                ahead[:] = [r for r in [next(rows, None)] if r]

        done: list[tuple] = []
        size = 0
        while ahead:
            own, chunk, text, spans, length = ahead[0]["conv_id"], 0, [], [], 0
            messages = conversation()
            for piece, generated in render(messages):
                if generated:
                    spans.append({"start": length, "end": length + len(piece)})
                text.append(piece)
                length += len(piece)
                if length >= CHUNK:
                    yield _chunks([*done, (own, chunk, "".join(text), spans)])
                    chunk, text, spans, length, done, size = chunk + 1, [], [], 0, [], 0
            for _ in messages:  # a template need not read all
                pass
            done.append((own, chunk, "".join(text), spans))
            size += length
            if size >= CHUNK:
                yield _chunks(done)
                done, size = [], 0
        if done:
            yield _chunks(done)

    order = ["conv_id", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    dealt = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(kernel, "conv_id long, chunk int, formatted string, spans array<struct<start:long,end:long>>")


def _chunks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "chunk", "formatted", "spans"])


def read_back(chunks: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from format_conversations' result with TEMPLATE.

    Works on its partitions as they are, where chunks of a conversation follow
    each other; holds one turn at a time. Text that is not in the format is an error.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["chunk"] == 0:
                    if now:
                        out.append(_closed(now))
                    now = {"id": r["conv_id"], "rest": "", "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "size": 0}
                text = r["formatted"]
                now["size"] += len(text)
                for s in r["spans"]:
                    own = unescape(text[s["start"] : s["end"]])
                    now["chars"] += len(own)
                    now["loss"].update(own.encode())
                text, at = now["rest"] + text, 0
                while m := TURN.match(text, at):
                    now["n"] += 1
                    now["turns"].update(f"{unescape(m[1])}\n{unescape(m[2][:-1])}\n".encode())
                    at = m.end()
                now["rest"] = text[at:]
            if len(out) >= 1000:
                yield _digests(out)
                out = []
        if now:
            out.append(_closed(now))
        yield _digests(out)

    return chunks.mapInArrow(kernel, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _closed(now: dict) -> tuple:
    if now["rest"]:
        raise ValueError(f"conversation {now['id']}: text outside turns: {now['rest'][:80]!r}")
    return now["id"], now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["size"]


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 6, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
