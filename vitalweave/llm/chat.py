"""Chat formatting: templates compiled to closures that render conversations and mark what is generated.

A template has texts, ``{{ expression }}``, ``{% for x in xs %}``, ``{% if %}`` with
``elif`` and ``else``, ``{% set x = expression %}`` and ``{% generation %}``. Expressions
know names, fields of mappings, constants, comparison, ``and``, ``or``, ``not``, ``+``,
conditional expressions and filters (``x | trim``); a loop has ``loop.index``, ``loop.index0``,
``loop.first`` and ``loop.last``. A hyphen next to the braces of a tag (``{%- ... -%}``) takes
away the white space on that side. Nothing else can be written, so that a template reaches
neither attributes nor functions of Python. It is parsed to a syntax tree, in which constant
parts are folded, and the tree becomes closures.
"""

from __future__ import annotations

import ast
import hashlib
import operator
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"(\{\{.*?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.DOTALL)
COMPARE = {
    ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge,
    ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b,
}
#: Strings that have a meaning in formatted conversations. Fixed values.
CONTROL = ("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<<SYS>>", "<</SYS>>")
TEMPLATE = (
    "{% for m in messages %}<|turn|>{{ m.role | line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|end|>\n{% endfor %}"
)


class TemplateError(ValueError):
    """The template is not one of this language."""


class Escape:
    """Reversible escapes: a backslash is doubled, and one goes behind the first character of each control string."""

    def __init__(self, control: Sequence[str] = CONTROL):
        if any(c[:1] in "\\\n" or set(c[1:]) & {x[0] for x in control if x} - {"<"} or "\\" in c for c in control):
            raise ValueError("control strings must not be empty or hold a backslash or the start of another one")
        self.found = re.compile("|".join([r"\\", *(re.escape(c) for c in sorted(control, key=len, reverse=True))]))

    def text(self, value: str) -> str:
        return self.found.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], value)

    def line(self, value: str) -> str:
        """Escaped text without line ends; a line end is a backslash with an ``n`` that begins the text it stands in."""
        return self.text(value).replace("\r", "\\r\\").replace("\n", "\\n\\")

    @staticmethod
    def undo(value: str) -> str:
        return re.sub(r"\\\\|\\", lambda m: "\\" if len(m[0]) == 2 else "", value)

    @staticmethod
    def undo_line(value: str) -> str:
        marks = {"\\\\": "\\", "\\n\\": "\n", "\\r\\": "\r", "\\": ""}
        return re.sub(r"\\\\|\\n\\|\\r\\|\\", lambda m: marks[m[0]], value)


class Constant:
    def __init__(self, value):
        self.value = value

    def __call__(self, scope):
        return self.value


# The syntax tree of a template. Expressions in it are constants or closures scope -> value.


@dataclass
class Text:
    value: str


@dataclass
class Output:
    value: Callable


@dataclass
class Assignment:
    name: str
    value: Callable


@dataclass
class Loop:
    name: str
    items: Callable
    body: list
    counted: bool  # whether the body asks for ``loop``


@dataclass
class Choice:
    test: Callable
    body: list
    other: list


@dataclass
class Generation:
    body: list


def fold(nodes: Sequence) -> list:
    """The same tree with constant outputs as texts, decided choices replaced by what they choose, and texts joined."""
    done: list = []
    for node in nodes:
        if isinstance(node, Output) and isinstance(node.value, Constant):
            made = [Text(_shown(node.value.value))]
        elif isinstance(node, Choice) and isinstance(node.test, Constant):
            made = fold(node.body if node.test.value else node.other)
        elif isinstance(node, Choice):
            made = [Choice(node.test, fold(node.body), fold(node.other))]
        elif isinstance(node, Loop):
            made = [] if isinstance(node.items, Constant) and not node.items.value else [Loop(node.name, node.items, fold(node.body), node.counted)]
        elif isinstance(node, Generation):
            body = fold(node.body)
            made = [Generation(body)] if body else []
        else:
            made = [node]
        for part in made:
            if isinstance(part, Text) and done and isinstance(done[-1], Text):
                done[-1] = Text(done[-1].value + part.value)
            elif not isinstance(part, Text) or part.value:
                done.append(part)
    return done


def closure(nodes: Sequence) -> Callable:
    """A folded tree as one closure (scope, generated) -> pieces."""
    return _sequence([_step(node) for node in nodes])


def _step(node) -> Callable:
    if isinstance(node, Text):
        return _constant(node.value)
    if isinstance(node, Output):
        return _output(node.value)
    if isinstance(node, Assignment):
        return _assign(node.name, node.value)
    if isinstance(node, Loop):
        return _loop(node.name, node.items, closure(node.body), node.counted)
    if isinstance(node, Generation):
        body = closure(node.body)
        return lambda scope, generated: body(scope, True)
    yes, no, test = closure(node.body), closure(node.other), node.test
    return lambda scope, generated: (yes if test(scope) else no)(scope, generated)


class Template:
    """A compiled template: ``render(scope)`` yields (text, generated) pieces as they come."""

    def __init__(self, source: str, filters: dict[str, Callable] | None = None):
        self.filters = {"trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len, **(filters or {})}
        self.parts = list(_parts(source))
        self.at = 0
        self.counted = False
        nodes, stop = self._block(())
        if stop:
            raise TemplateError(f"unexpected {stop}")
        self.tree = fold(nodes)
        self.body = closure(self.tree)

    def render(self, scope: dict) -> Iterator[tuple[str, bool]]:
        return self.body(scope, False)

    # Statements: nodes of the tree.

    def _block(self, ends: tuple[str, ...]) -> tuple[list, str]:
        """The nodes up to one of the statements ``ends``, and that statement."""
        nodes: list = []
        while self.at < len(self.parts):
            kind, part = self.parts[self.at]
            self.at += 1
            if kind == "text":
                nodes.append(Text(part))
            elif kind == "{{":
                nodes.append(Output(self._expression(part)))
            else:
                words = part.split(None, 1)
                if not words:
                    raise TemplateError("an empty statement")
                if words[0] in ends:
                    return nodes, part.strip()
                nodes.append(self._statement(words[0], words[1] if len(words) > 1 else ""))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return nodes, ""

    def _statement(self, word: str, rest: str):
        if word == "for":
            match = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)
            if not match or match[1] == "loop":
                raise TemplateError(f"for {rest}")
            items, outer, self.counted = self._expression(match[2]), self.counted, False
            body, _ = self._block(("endfor",))
            node = Loop(match[1], items, body, self.counted)
            self.counted = outer
            return node
        if word == "if":
            return self._choice(rest)
        if word == "generation":
            return Generation(self._block(("endgeneration",))[0])
        if word == "set":
            name, _, value = rest.partition("=")
            if not name.strip().isidentifier():
                raise TemplateError(f"set {rest}")
            return Assignment(name.strip(), self._expression(value))
        raise TemplateError(f"unknown statement {word}")

    def _choice(self, condition: str) -> Choice:
        test = self._expression(condition)
        body, stop = self._block(("elif", "else", "endif"))
        other: list = []
        if stop.startswith("elif"):
            other = [self._choice(stop[4:])]
        elif stop == "else":
            other, _ = self._block(("endif",))
        return Choice(test, body, other)

    # Expressions: closures scope -> value.

    def _expression(self, source: str) -> Callable:
        try:
            return self._value(ast.parse(source.strip(), mode="eval").body)
        except (SyntaxError, RecursionError, MemoryError) as error:
            raise TemplateError(f"not an expression: {source}") from error

    def _value(self, node: ast.AST) -> Callable:
        if isinstance(node, ast.Constant) and isinstance(node.value, (str, int, float, bool, type(None))):
            return Constant(node.value)
        if isinstance(node, ast.Name):
            name = node.id
            if name in ("true", "false", "none"):
                return Constant({"true": True, "false": False, "none": None}[name])
            if name == "loop":
                self.counted = True
            return lambda scope: scope.get(name)
        if isinstance(node, ast.Attribute):
            return self._made(lambda x, key=node.attr: _field(x, key), node.value)
        if isinstance(node, ast.Subscript):
            return self._made(_field, node.value, node.slice)
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in COMPARE:
            return self._made(COMPARE[type(node.ops[0])], node.left, node.comparators[0])
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.Not, ast.USub)):
            return self._made(operator.not_ if isinstance(node.op, ast.Not) else operator.neg, node.operand)
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            return self._made(_added, node.left, node.right)
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr) and isinstance(node.right, ast.Name):
            if node.right.id not in self.filters:
                raise TemplateError(f"unknown filter {node.right.id}")
            return self._made(lambda x, use=self.filters[node.right.id]: use(_shown(x)), node.left)
        if isinstance(node, ast.BoolOp):
            parts, stop_at = [self._value(v) for v in node.values], isinstance(node.op, ast.Or)
            folded = _first(parts, stop_at)
            return Constant(folded({})) if all(isinstance(p, Constant) for p in parts) else folded
        if isinstance(node, ast.IfExp):
            test, yes, no = (self._value(x) for x in (node.test, node.body, node.orelse))
            if isinstance(test, Constant):
                return yes if test.value else no
            return lambda scope: yes(scope) if test(scope) else no(scope)
        raise TemplateError(f"{type(node).__name__} is not allowed")

    def _made(self, make: Callable, *nodes: ast.AST) -> Callable:
        values = [self._value(n) for n in nodes]
        if all(isinstance(v, Constant) for v in values):
            return Constant(make(*(v.value for v in values)))
        if len(values) == 1:
            only = values[0]
            return lambda scope: make(only(scope))
        left, right = values
        return lambda scope: make(left(scope), right(scope))


def _shown(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _field(value, key):
    return value.get(key) if isinstance(value, dict) else None


def _added(left, right):
    if isinstance(left, str) or isinstance(right, str):
        return _shown(left) + _shown(right)
    return left + right


def _first(parts: Sequence[Callable], stop_at: bool) -> Callable:
    def value(scope):
        for part in parts:
            found = part(scope)
            if bool(found) == stop_at:
                return found
        return found

    return value


def _output(value: Callable) -> Callable:
    return lambda scope, generated: iter(((_shown(value(scope)), generated),))


def _constant(text: str) -> Callable:
    return lambda scope, generated: iter(((text, generated),) if text else ())


def _sequence(steps: Sequence[Callable]) -> Callable:
    if len(steps) == 1:
        return steps[0]
    return lambda scope, generated: chain.from_iterable(step(scope, generated) for step in steps)


def _assign(name: str, value: Callable) -> Callable:
    def run(scope, generated):
        scope[name] = value(scope)
        return iter(())

    return run


def _loop(name: str, items: Callable, body: Callable, counted: bool) -> Callable:
    def run(scope, generated):
        if not counted:
            for item in items(scope) or ():
                scope[name] = item
                yield from body(scope, generated)
            return
        # Whether an item is the last one is known when the next one has been looked for.
        outer, rest = scope.get("loop"), iter(items(scope) or ())
        item, index = next(rest, _NONE), 0
        while item is not _NONE:
            following = next(rest, _NONE)
            scope[name] = item
            scope["loop"] = {"index": index + 1, "index0": index, "first": index == 0, "last": following is _NONE}
            yield from body(scope, generated)
            item, index = following, index + 1
        scope["loop"] = outer

    return run


_NONE = object()


def _parts(source: str) -> Iterator[tuple[str, str]]:
    """Texts, outputs and statements in order. A hyphen next to a tag's brace takes away the white space on that side."""
    pieces = TAG.split(source)
    for at, piece in enumerate(pieces):
        if at % 2:
            if not piece.startswith("{#"):
                inner = piece[2:-2]
                yield piece[:2], inner[inner.startswith("-") : len(inner) - (len(inner) > 1 and inner.endswith("-"))]
            continue
        if at and pieces[at - 1][-3] == "-":
            piece = piece.lstrip()
        if at + 1 < len(pieces) and pieces[at + 1][2] == "-":
            piece = piece.rstrip()
        if piece:
            yield "text", piece


class Reader:
    """Reads formatted turns back piece by piece, holding one turn at a time."""

    def __init__(self, start: str = "<|turn|>", end: str = "<|end|>\n"):
        self.start, self.end = start, end
        self.held: list[str] = []
        self.spans: list[tuple[int, int]] = []
        self.size = 0

    def feed(self, text: str, generated: bool) -> tuple[str, str, list[str]] | None:
        """The turn (role, text, texts under the mask) that this piece completes, if it does."""
        if generated and text:
            self.spans.append((self.size, self.size + len(text)))
        self.held.append(text)
        self.size += len(text)
        if not text.endswith(self.end):
            return None
        whole = "".join(self.held)
        if not whole.startswith(self.start):
            raise ValueError("this is not a formatted turn")
        role, _, body = whole[len(self.start) : -len(self.end)].partition("\n")
        marked: list[tuple[int, int]] = []
        for a, b in self.spans:
            if marked and marked[-1][1] == a:
                marked[-1] = (marked[-1][0], b)
            else:
                marked.append((a, b))
        turn = Escape.undo_line(role), Escape.undo(body), [Escape.undo(whole[a:b]) for a, b in marked]
        self.held, self.spans, self.size = [], [], 0
        return turn


COLUMNS = ("conv_id", "turn", "role", "text")


def _in_order(conversations: DataFrame, names: Sequence[str]) -> DataFrame:
    """One conversation after the other, turns in order; equal turns by role, then text."""
    rows = conversations.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, COLUMNS)])
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions(*COLUMNS)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Each conversation with its messages as they stream by; a conversation is never held as a whole."""
    from itertools import groupby

    rows = ((c, r, t) for b in batches for c, r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()))
    for conv_id, group in groupby(rows, key=lambda x: x[0]):
        yield conv_id, ({"role": r, "text": t} for _, r, t in group)


def _compiled(template: str, control: Sequence[str]) -> Template:
    escape = Escape(control)
    return Template(template, {"escape": escape.text, "line": escape.line})


def format_conversations(
    conversations: DataFrame, template: str = TEMPLATE, control: Sequence[str] = CONTROL, columns: Sequence[str] = COLUMNS
) -> DataFrame:
    """(conv_id, text, spans): each conversation as one text, with the spans (start, end in code points) under the loss mask.

    A null role or text is empty; rows with a null conv_id are one conversation; repeated
    rows are repeated turns. An empty table has no conversations.
    """
    _compiled(template, control)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _compiled(template, control)
        for conv_id, messages in _conversations(batches):
            parts, spans, size = [], [], 0
            for text, generated in made.render({"messages": messages}):
                if generated and text:
                    spans.append({"start": size, "end": size + len(text)})
                parts.append(text)
                size += len(text)
            columns = [pa.array([conv_id], pa.int64()), pa.array(["".join(parts)]), pa.array([spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "text", "spans"])

    return _in_order(conversations, columns).mapInArrow(run, "conv_id long, text string, spans array<struct<start:long,end:long>>")


def digest_conversations(conversations: DataFrame, control: Sequence[str] = CONTROL, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """What reading the formatted conversations back gives: their turns and the text under the loss mask, as digests.

    Formats with the built-in template and reads each turn as it comes, so that memory
    is bounded by one turn. The digest of a conversation is one sequence, so one task
    works through a conversation however many turns it has. Turns go by number, null first, then
    by role and text; a null role or text is empty, rows with a null conv_id are one
    conversation, and repeated rows are repeated turns. Other columns are not read. An empty
    table has no conversations.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, names = _compiled(TEMPLATE, control), ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        done: list[tuple] = []
        for conv_id, messages in _conversations(batches):
            reader, turns, loss = Reader(), hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = 0
            for text, generated in made.render({"messages": messages}):
                chars += len(text)
                turn = reader.feed(text, generated)
                if turn is not None:
                    role, body, marked = turn
                    n_turns += 1
                    turns.update(f"{role}\n{body}\n".encode())
                    for part in marked:
                        loss_chars += len(part)
                        loss.update(part.encode())
            done.append((conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(done) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

    return _in_order(conversations, columns).mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
