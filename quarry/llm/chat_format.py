"""Chat formatting with a compiled template.

``compile_template`` parses a small sandboxed language (text, ``{{ expr }}``
with filters, ``for``, ``if``/``elif``/``else``, ``generation`` blocks) into a
syntax tree, folds constants and builds Python closures. Expressions know only
names, attributes of the rows, string and integer literals, ``==``, ``!=``,
``and``, ``or``, ``not``; nothing reaches Python's own objects.

``escape`` makes control strings inside texts harmless and can be undone:
``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``; ``escape_line`` also turns a
line feed into ``\\n``.

Turns stream through sorted partitions, one output row a turn, so a very long
conversation is never held as a whole.

Defined results: null texts and roles are empty; a null conv_id is one more
conversation; turns sort by (turn, role, text), nulls first; repeated rows are
turns of their own; very long texts are formatted whole; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

TEMPLATE = """{% for message in messages %}{{ '<|im_start|>' }}{{ message.role | escape_line }}
{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}{% else %}{{ message.text | escape }}{% endif %}{{ '<|im_end|>' }}
{% endfor %}"""
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_line(s: str) -> str:
    return escape(s).replace("\n", "\\n")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], s, flags=re.S) if "\\" in s else s


FILTERS = {"escape": escape, "escape_line": escape_line, "upper": str.upper, "lower": str.lower, "trim": str.strip}


class TemplateError(ValueError):
    pass


_TOKEN = re.compile(r"\s*(?:('[^']*'|\"[^\"]*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[|.()]))")


def _tokens(s: str) -> list[tuple[str, str]]:
    out, i = [], 0
    s = s.strip()
    while i < len(s):
        m = _TOKEN.match(s, i)
        if not m:
            raise TemplateError(f"cannot read {s[i:]!r}")
        out.append(next((k, v) for k, v in zip(("str", "int", "name", "op"), m.groups()) if v is not None))
        i = m.end()
    return out


class _Expr:
    """Recursive descent to ('const', v), ('get', name, attributes), (op, ...)."""

    def __init__(self, source: str):
        self.toks, self.i = _tokens(source), 0
        self.tree = self._or()
        if self.i != len(self.toks):
            raise TemplateError(f"unexpected {self.toks[self.i][1]!r} in {source!r}")

    def _take(self, *values: str) -> str | None:
        if self.i < len(self.toks) and self.toks[self.i][0] != "str" and self.toks[self.i][1] in values:
            self.i += 1
            return self.toks[self.i - 1][1]
        return None

    def _or(self):
        a = self._and()
        while self._take("or"):
            a = ("or", a, self._and())
        return a

    def _and(self):
        a = self._not()
        while self._take("and"):
            a = ("and", a, self._not())
        return a

    def _not(self):
        if self._take("not"):
            return ("not", self._not())
        a = self._pipe()
        if op := self._take("==", "!="):
            a = (op, a, self._pipe())
        return a

    def _pipe(self):
        a = self._atom()
        while self._take("|"):
            kind, name = self._next()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            a = ("filter", name, a)
        return a

    def _next(self):
        if self.i >= len(self.toks):
            raise TemplateError("expression ends early")
        self.i += 1
        return self.toks[self.i - 1]

    def _atom(self):
        kind, v = self._next()
        if kind == "str":
            return ("const", v[1:-1])
        if kind == "int":
            return ("const", int(v))
        if kind == "op" and v == "(":
            a = self._or()
            if not self._take(")"):
                raise TemplateError("missing )")
            return a
        if kind != "name":
            raise TemplateError(f"unexpected {v!r}")
        path = []
        while self._take("."):
            kind, name = self._next()
            if kind != "name" or name.startswith("_"):
                raise TemplateError(f"no attribute {name!r}")
            path.append(name)
        return ("get", v, tuple(path))


def _fold(e):
    """Constant folding of an expression."""
    if e[0] in ("const", "get"):
        return e
    if e[0] == "filter":
        a = _fold(e[2])
        return ("const", FILTERS[e[1]](str(a[1]))) if a[0] == "const" else ("filter", e[1], a)
    args = [_fold(a) for a in e[1:]]
    if all(a[0] == "const" for a in args):
        return ("const", _value((e[0], *args))({}))
    return (e[0], *args)


def _value(e):
    """A closure env -> value."""
    op = e[0]
    if op == "const":
        return lambda env, v=e[1]: v
    if op == "get":

        def get(env, name=e[1], path=e[2]):
            v = env.get(name)
            for k in path:
                v = v.get(k) if isinstance(v, dict) else None
            return v

        return get
    if op == "filter":
        return lambda env, f=FILTERS[e[1]], a=_value(e[2]): f("" if (v := a(env)) is None else str(v))
    if op == "not":
        return lambda env, a=_value(e[1]): not a(env)
    a, b = _value(e[1]), _value(e[2])
    return {"==": lambda env: a(env) == b(env), "!=": lambda env: a(env) != b(env), "and": lambda env: a(env) and b(env), "or": lambda env: a(env) or b(env)}[op]


def _parse(source: str):
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S)
    pos = 0

    def block(ends: tuple[str, ...]):
        nonlocal pos
        nodes = []
        while pos < len(parts):
            p = parts[pos]
            pos += 1
            if p.startswith("{{"):
                e = _fold(_Expr(p[2:-2]).tree)
                nodes.append(("text", str(e[1])) if e[0] == "const" else ("emit", e))
            elif p.startswith("{%"):
                word, _, rest = p[2:-2].strip().partition(" ")
                if word in ends:
                    return nodes, word, rest
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+([A-Za-z]\w*)", rest.strip())
                    if not m:
                        raise TemplateError(f"cannot read for {rest!r}")
                    nodes.append(("for", m[1], m[2], block(("endfor",))[0]))
                elif word == "generation":
                    nodes.append(("generation", block(("endgeneration",))[0]))
                elif word == "if":
                    arms, test = [], rest
                    while True:
                        body, end, rest = block(("elif", "else", "endif"))
                        arms.append((("const", True) if test is None else _fold(_Expr(test).tree), body))
                        if end == "endif":
                            break
                        test = rest if end == "elif" else None
                    nodes += _arms(arms)
                else:
                    raise TemplateError(f"unknown tag {word!r}")
            elif p:
                nodes.append(("text", p))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return nodes, "", ""

    return _merged(block(())[0])


def _arms(arms):
    """Arms with constant tests are decided now."""
    left = []
    for test, body in arms:
        if test[0] == "const" and not test[1]:
            continue
        left.append((test, body))
        if test[0] == "const":
            break
    if left and left[0][0][0] == "const":
        return left[0][1]
    return [("if", left)] if left else []


def _merged(nodes):
    out = []
    for n in nodes:
        if n[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + n[1])
        elif n[0] == "for":
            out.append((*n[:3], _merged(n[3])))
        elif n[0] == "generation":
            out.append(("generation", _merged(n[1])))
        elif n[0] == "if":
            out.append(("if", [(t, _merged(b)) for t, b in n[1]]))
        else:
            out.append(n)
    return out


def _closure(nodes):
    """A closure (env, out, masked): out gets (text, under the mask) pieces."""
    steps = []
    for n in nodes:
        if n[0] == "text":
            steps.append(lambda env, out, m, t=n[1]: out.append((t, m)))
        elif n[0] == "emit":
            steps.append(lambda env, out, m, v=_value(n[1]): out.append(("" if (x := v(env)) is None else str(x), m)))
        elif n[0] == "generation":
            steps.append(lambda env, out, m, f=_closure(n[1]): f(env, out, True))
        elif n[0] == "for":

            def loop(env, out, m, var=n[1], seq=n[2], f=_closure(n[3])):
                for x in env.get(seq) or ():
                    f({**env, var: x}, out, m)

            steps.append(loop)
        else:

            def branch(env, out, m, arms=[(_value(t), _closure(b)) for t, b in n[1]]):
                for t, f in arms:
                    if t(env):
                        f(env, out, m)
                        break

            steps.append(branch)

    def run(env, out, m):
        for s in steps:
            s(env, out, m)

    return run


def compile_template(source: str):
    """A function messages -> (formatted text, [(first, end)] under the loss mask)."""
    body = _closure(_parse(source))

    def render(messages) -> tuple[str, list[tuple[int, int]]]:
        out: list[tuple[str, bool]] = []
        body({"messages": messages}, out, False)
        spans, at = [], 0
        for text, masked in out:
            if masked:
                spans.append((at, at + len(text)))
            at += len(text)
        return "".join(t for t, _ in out), spans

    return render


def format_turns(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, spans (first, end under the mask): one row a turn, the
    turns of a conversation together and in order. The template must render
    turn by turn, as one loop over messages does."""

    def run(batches):
        render = compile_template(template)
        for b in batches:
            out = [render([{"role": r or "", "text": t or ""}]) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([t for t, _ in out], pa.string()), pa.array([[{"first": a, "end": e} for a, e in s] for _, s in out], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))], ["conv_id", "formatted", "spans"])

    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.selectExpr("cast(conv_id AS long) AS conv_id", "cast(turn AS long) AS turn", "role", "text").repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, formatted string, spans array<struct<first:int,end:int>>")


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted text and mask spans of whole conversations."""
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m")).mapInArrow(_whole(template), "conv_id long, formatted string, spans array<struct<first:int,end:int>>")


def _whole(template: str):
    def run(batches):
        render = compile_template(template)
        for b in batches:
            out = [render([{"role": x["role"] or "", "text": x["text"] or ""} for x in m]) for m in b.column("m").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id").cast(pa.int64()), pa.array([t for t, _ in out], pa.string()), pa.array([[{"first": a, "end": e} for a, e in s] for _, s in out], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))], ["conv_id", "formatted", "spans"])

    return run


def _digests(batches):
    """Formatted turns read back: one row a conversation."""
    cols = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    schema = pa.schema([(c, pa.string() if "sha" in c else pa.int64()) for c in cols])
    open_ = None

    def row():
        return (open_[0], open_[1], open_[2].hexdigest(), open_[3], open_[4].hexdigest(), open_[5])

    for b in batches:
        done = []
        for conv, text, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "spans"))):
            if open_ is None or open_[0] != conv:
                if open_ is not None:
                    done.append(row())
                open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            open_[5] += len(text)
            at = 0
            while at < len(text):
                m = _TURN.match(text, at)
                if not m:
                    raise ValueError("formatted text cannot be read back")
                open_[1] += 1
                open_[2].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                at = m.end()
            for s in spans:
                loss = unescape(text[s["first"] : s["end"]])
                open_[3] += len(loss)
                open_[4].update(loss.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done), schema)], schema=schema)
    if open_ is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(row(), schema)], schema=schema)


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = runtime.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return format_turns(turns).mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
