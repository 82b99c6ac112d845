"""Language front ends: source text to syntax rows, and the control-flow pass over them.

A front end is a function text -> list of Syntax in pre-order. Files are parsed one by one inside mapInPandas; everything
after that is DataFrame work keyed by graph_id. Broken input never fails a job: it gives ERROR nodes.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtide.operators.graph import DESCEND, KIND_MAP


@dataclass
class Syntax:
    kind: str
    start: int
    end: int
    role: str = ""
    name: str | None = None
    children: list[Syntax] = field(default_factory=list)

    def add(self, child: Syntax | None, role: str = "") -> Syntax | None:
        if child is not None:
            child.role = role or child.role
            self.children.append(child)
        return child


FRONTENDS: dict[str, Callable[[str], Syntax]] = {}
#: Kinds of front ends beyond the shared table.
MORE_KINDS = KIND_MAP | {"unary_expression": "Expression", "else_clause": "Block", "type": "Type", "ERROR": "Error"}


def frontend(language: str):
    def register(f):
        FRONTENDS[language] = f
        return f

    return register


# --- a subset of C: functions, declarations, if, while, for, return, calls, expressions, comments, preprocessor lines

_LEX = re.compile(r"(?P<ws>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<pre>\#[^\n]*)|(?P<str>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<num>\d[\w.]*)|(?P<id>[A-Za-z_]\w*)|(?P<op>->|\+\+|--|<<=|>>=|<<|>>|&&|\|\||[<>=!+\-*/%&|^]=|.)", re.S)
_TYPES = {"int", "char", "void", "long", "short", "float", "double", "unsigned", "signed", "const", "static", "struct", "extern", "size_t", "bool"}
_BINDING = {"=": 1, "+=": 1, "-=": 1, "*=": 1, "/=": 1, "%=": 1, "||": 3, "&&": 4, "|": 5, "^": 6, "&": 7, "==": 8, "!=": 8, "<": 9, ">": 9, "<=": 9, ">=": 9, "<<": 10, ">>": 10, "+": 11, "-": 11, "*": 12, "/": 12, "%": 12}


class _C:
    def __init__(self, text: str):
        self.toks, self.notes, self.i = [], [], 0
        for m in _LEX.finditer(text):
            kind = m.lastgroup
            if kind in ("comment", "pre"):
                self.notes.append(Syntax("comment" if kind == "comment" else "preproc", m.start(), m.end()))
            elif kind != "ws":
                self.toks.append((kind, m.group(), m.start(), m.end()))
        self.end = len(text)

    def peek(self, k: int = 0) -> str:
        return self.toks[self.i + k][1] if self.i + k < len(self.toks) else ""

    def kind(self, k: int = 0) -> str:
        return self.toks[self.i + k][0] if self.i + k < len(self.toks) else ""

    def here(self) -> int:
        return self.toks[self.i][2] if self.i < len(self.toks) else self.end

    def last(self) -> int:
        return self.toks[self.i - 1][3] if self.i else 0

    def take(self, want: str) -> bool:
        if self.peek() == want:
            self.i += 1
            return True
        return False

    def close(self, node: Syntax) -> Syntax:
        node.end = max(node.start, self.last())
        return node

    def unit(self) -> Syntax:
        root = Syntax("translation_unit", 0, self.end)
        while self.i < len(self.toks):
            at = self.i
            root.add(self.external())
            if self.i == at:
                self.i += 1
        _place(root, self.notes)
        return root

    def is_type(self) -> bool:
        if self.peek() in _TYPES:
            return True
        return self.kind() == "id" and (self.kind(1) == "id" or (self.peek(1) == "*" and self.kind(2) == "id" and self.peek(3) in ("=", ";", ",", "[", ")", "(")))

    def type(self, into: Syntax) -> None:
        start = self.here()
        if not self.is_type():
            return
        while self.peek() in _TYPES or (self.kind() == "id" and (self.kind(1) == "id" or self.peek(1) == "*")):
            self.i += 1
            if self.toks[self.i - 1][1] not in _TYPES:
                break
        into.add(Syntax("type", start, self.last()), "type")

    def external(self) -> Syntax:
        node = Syntax("declaration", self.here(), 0)
        self.type(node)
        at = self.i
        while self.take("*"):
            pass
        if self.kind() == "id" and self.peek(1) == "(":
            depth, k = 0, 1
            while self.i + k < len(self.toks):
                depth += {"(": 1, ")": -1}.get(self.peek(k), 0)
                k += 1
                if not depth:
                    break
            if self.peek(k) == "{":
                node.kind, node.name = "function_definition", self.peek()
                node.add(Syntax("identifier", self.here(), self.toks[self.i][3], "declarator", self.peek()))
                self.i += 1
                node.add(self.parameters(), "parameters")
                node.add(self.block(), "body")
                return self.close(node)
        self.i = at
        if not node.children and self.kind() != "id":
            return self.error(node)
        return self.statement()if not node.children else self.declarators(node)

    def parameters(self) -> Syntax:
        node = Syntax("parameter_list", self.here(), 0)
        self.take("(")
        while self.i < len(self.toks) and self.peek() != ")":
            if self.kind() == "id" and self.peek() not in _TYPES and self.peek(1) in (",", ")", "["):
                node.add(Syntax("identifier", self.here(), self.toks[self.i][3], "", self.peek()))
            self.i += 1
        self.take(")")
        return self.close(node)

    def declarators(self, node: Syntax) -> Syntax:
        while True:
            while self.take("*"):
                pass
            if self.kind() != "id":
                return self.error(node)
            node.add(Syntax("identifier", self.here(), self.toks[self.i][3], "write", self.peek()))
            self.i += 1
            while self.peek() in ("[", "("):
                shut, depth = {"[": "]", "(": ")"}[self.peek()], 0
                while self.i < len(self.toks):
                    depth += (self.peek() in "[(") - (self.peek() in "])")
                    self.i += 1
                    if not depth:
                        break
                if shut == "":
                    break
            if self.take("="):
                node.add(self.expression(2), "value")
            if not self.take(","):
                break
        if not self.take(";"):
            return self.error(node)
        return self.close(node)

    def error(self, node: Syntax) -> Syntax:
        """Skips to the next ";" or before the next "}"."""
        node.kind = "ERROR"
        while self.i < len(self.toks) and self.peek() not in (";", "}"):
            self.i += 1
        self.take(";")
        return self.close(node)

    def block(self) -> Syntax:
        node = Syntax("compound_statement", self.here(), 0)
        self.take("{")
        while self.i < len(self.toks) and self.peek() != "}":
            at = self.i
            node.add(self.statement())
            if self.i == at:
                self.i += 1
        self.take("}")
        return self.close(node)

    def condition(self) -> Syntax:
        node = Syntax("parenthesized_expression", self.here(), 0)
        self.take("(")
        node.add(self.expression())
        while self.i < len(self.toks) and self.peek() not in (")", "{", ";"):
            self.i += 1
        self.take(")")
        return self.close(node)

    def statement(self) -> Syntax | None:
        word, start = self.peek(), self.here()
        if word == "{":
            return self.block()
        node = Syntax("expression_statement", start, 0)
        if word == "if":
            node.kind, self.i = "if_statement", self.i + 1
            node.add(self.condition(), "condition")
            node.add(self.statement(), "consequence")
            if self.peek() == "else":
                other = Syntax("else_clause", self.here(), 0)
                self.i += 1
                other.add(self.statement())
                node.add(self.close(other), "alternative")
            return self.close(node)
        if word == "while":
            node.kind, self.i = "while_statement", self.i + 1
            node.add(self.condition(), "condition")
            node.add(self.statement(), "body")
            return self.close(node)
        if word == "for":
            node.kind, self.i = "for_statement", self.i + 1
            self.take("(")
            node.add(self.statement(), "initializer")
            if self.peek() != ";":
                node.add(self.expression(), "condition")
            self.take(";")
            if self.peek() != ")":
                node.add(self.expression(), "update")
            self.take(")")
            node.add(self.statement(), "body")
            return self.close(node)
        if word == "return":
            node.kind, self.i = "return_statement", self.i + 1
            if self.peek() != ";":
                node.add(self.expression())
            return self.close(node) if self.take(";") else self.error(node)
        if word in ("break", "continue"):
            node.kind, self.i = f"{word}_statement", self.i + 1
            self.take(";")
            return self.close(node)
        if word == ";":
            self.i += 1
            return self.close(node)
        if self.is_type():
            node.kind = "declaration"
            self.type(node)
            return self.declarators(node)
        if node.add(self.expression()) is None or not self.take(";"):
            return self.error(node)
        return self.close(node)

    def expression(self, least: int = 0) -> Syntax | None:
        left = self.operand()
        while left is not None and (power := _BINDING.get(self.peek(), -1)) >= max(least, 1):
            op = self.peek()
            self.i += 1
            right = self.expression(power if power == 1 else power + 1)
            node = Syntax("assignment_expression" if power == 1 else "binary_expression", left.start, self.last(), name=op)
            node.add(left, ("write" if op == "=" else "update") if power == 1 else "left")
            node.add(right, "right")
            left = node
        return left

    def operand(self) -> Syntax | None:
        start, kind, word = self.here(), self.kind(), self.peek()
        if word in ("-", "!", "~", "*", "&", "++", "--", "+"):
            self.i += 1
            node = Syntax("unary_expression", start, 0, name=word)
            node.add(self.operand())
            return self.close(node)
        if word == "(":
            node = self.condition()
        elif kind == "id" and word not in ("else", "if", "while", "for", "return"):
            self.i += 1
            node = Syntax("identifier", start, self.last(), "read", word)
        elif kind in ("num", "str"):
            self.i += 1
            node = Syntax("number_literal" if kind == "num" else "string_literal", start, self.last())
        else:
            return None
        while self.peek() in ("(", "[", ".", "->", "++", "--"):
            word = self.peek()
            outer = Syntax({"(": "call_expression", "[": "subscript_expression"}.get(word, "field_expression" if word in (".", "->") else "unary_expression"), start, 0, name=node.name)
            outer.add(node, "function" if word == "(" else "")
            self.i += 1
            if word in ("(", "["):
                while self.i < len(self.toks) and self.peek() not in (")", "]", ";", "{", "}"):
                    at = self.i
                    outer.add(self.expression(), "argument")
                    if not self.take(",") and self.i == at:
                        self.i += 1
                self.take(")" if word == "(" else "]")
            elif word in (".", "->") and self.kind() == "id":
                self.i += 1
            node = self.close(outer)
        return node


def _place(root: Syntax, notes: list[Syntax]) -> None:
    """Comments and preprocessor lines become children of the innermost node around them."""
    for note in notes:
        node = root
        while True:
            inner = next((c for c in node.children if c.start <= note.start and note.end <= c.end and c.kind in ("function_definition", "compound_statement", "if_statement", "while_statement", "for_statement", "else_clause")), None)
            if inner is None:
                break
            node = inner
        k = next((k for k, c in enumerate(node.children) if c.start > note.start), len(node.children))
        node.children.insert(k, note)


@frontend("C")
def parse_c(text: str) -> Syntax:
    return _C(text).unit()


# --- Python, by the standard library's parser

_PY = {"FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "If": "if_statement", "While": "while_statement", "For": "for_statement", "Return": "return_statement", "Assign": "expression_statement", "AugAssign": "expression_statement",
       "AnnAssign": "expression_statement", "Expr": "expression_statement", "Call": "call_expression", "Name": "identifier", "Break": "break_statement", "Continue": "continue_statement", "BinOp": "binary_expression", "Compare": "binary_expression", "BoolOp": "binary_expression"}


@frontend("Python")
def parse_python(text: str) -> Syntax:
    root = Syntax("translation_unit", 0, len(text))
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        root.add(Syntax("ERROR", 0, len(text)))
        return root
    starts = [0]
    for line in text.splitlines(True):
        starts.append(starts[-1] + len(line))
    lines = text.splitlines(True)
    at = lambda row, col: starts[row - 1] + len(lines[row - 1].encode()[:col].decode(errors="ignore"))

    def walk(item: ast.AST, into: Syntax, role: str) -> None:
        if isinstance(item, (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop)):
            return
        if not hasattr(item, "lineno"):
            for name, value in ast.iter_fields(item):
                for x in value if isinstance(value, list) else [value]:
                    if isinstance(x, ast.AST):
                        walk(x, into, name)
            return
        node = Syntax(_PY.get(type(item).__name__, type(item).__name__), at(item.lineno, item.col_offset), at(item.end_lineno, item.end_col_offset), role, getattr(item, "name", None) or getattr(item, "id", None))
        if isinstance(item, ast.Name):
            node.role = "write" if isinstance(item.ctx, ast.Store) else "read"
        into.add(node, node.role or role)
        for name, value in ast.iter_fields(item):
            parts = [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, ast.AST)]
            if name in ("body", "orelse") and parts and isinstance(item, ast.stmt):
                block = Syntax("compound_statement", at(parts[0].lineno, parts[0].col_offset), at(parts[-1].end_lineno, parts[-1].end_col_offset))
                node.add(block, {"orelse": "alternative", "body": "consequence" if isinstance(item, ast.If) else "body"}[name])
                for x in parts:
                    walk(x, block, "")
            else:
                for x in parts:
                    walk(x, node, "condition" if name in ("test", "iter") else name)

    for item in tree.body:
        walk(item, root, "")
    return root


NODE_SCHEMA = "graph_id string, node_id long, end_id long, parent_id long, child_ord int, depth int, kind string, node_type string, role string, name string, start_byte long, end_byte long, df_reads array<string>, df_writes array<string>"


def rows_of(graph_id: str, text: str, language: str) -> list[tuple]:
    """Pre-order rows of one file; byte spans; variables read and written by statements, in post-order."""
    root = FRONTENDS[language](text)
    width = None if text.isascii() else [0]
    if width is not None:
        for ch in text:
            width.append(width[-1] + len(ch.encode()))
    pos = (lambda i: i) if width is None else (lambda i: width[min(i, len(text))])
    out: list[list] = []
    stack: list[tuple[Syntax, int | None, int, int]] = [(root, None, 1, 0)]
    index: dict[int, int] = {}
    while stack:
        node, parent, nth, depth = stack.pop()
        me = len(out)
        index[id(node)] = me
        out.append([graph_id, me, 0, parent, nth, depth, node.kind, MORE_KINDS.get(node.kind, "LanguageImplementation"), node.role, node.name, pos(node.start), pos(node.end), [], []])
        for k in range(len(node.children) - 1, -1, -1):
            stack.append((node.children[k], me, k + 1, depth + 1))
    end = len(out)
    ends = [0] * end
    for me in range(end - 1, -1, -1):
        ends[me] = max(ends[me], me + 1)
        if out[me][3] is not None:
            ends[out[me][3]] = max(ends[out[me][3]], ends[me])
    for me, row in enumerate(out):
        row[2] = ends[me]
        if row[7] in ("Statement", "Expression", "Return", "Call"):
            ids = [out[k] for k in range(me, ends[me]) if out[k][6] == "identifier" and out[k][8] != "function"]
            distinct = lambda names: [n for k, n in enumerate(names) if n and (k == 0 or names[k - 1] != n)]
            row[12] = distinct([r[9] for r in ids if r[8] != "write"])
            row[13] = distinct([r[9] for r in ids if r[8] in ("write", "update")])
    return [tuple(r) for r in out]


#: Fixed value: a task holds the rows of one file and so many of others before it passes them on.
ROWS_HELD = 20_000


def framed(files: Iterator[list[tuple]], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of one file after another as frames of about ROWS_HELD rows: a batch of files has many times the rows of a batch."""
    rows: list[tuple] = []
    for own in files:
        rows += own
        if len(rows) >= ROWS_HELD:
            yield pd.DataFrame(rows, columns=names).astype({"parent_id": "Int64"})
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=names).astype({"parent_id": "Int64"})


def build(files: DataFrame, language: str = "C") -> DataFrame:
    """nodes of every file. files: graph_id, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.strip().split(" ")[0] for x in NODE_SCHEMA.split(", ")]
        yield from framed((rows_of(g, t or "", language) for batch in batches for g, t in zip(batch["graph_id"], batch["text"], strict=True)), names)

    return files.select("graph_id", "text").mapInPandas(run, NODE_SCHEMA)


# --- control flow of one function: what enters a node, what leaves it

EXIT = -1


class FlowError(ValueError):
    """A branch or loop without the parts it needs."""


def control_flow(rows: list[dict]) -> list[tuple[int, int, str]]:
    """(src, dst, edge_type) of one graph; dst EXIT - function id * 1 stands for the function's return (see function_return)."""
    by = {r["node_id"]: r for r in rows}
    kids: dict[int, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r["parent_id"] if r["parent_id"] is not None else -1, r["child_ord"])):
        if r["parent_id"] is not None:
            kids.setdefault(r["parent_id"], []).append(r)
    edges: dict[tuple[int, int, str], None] = {}
    # roots may be deep: each node's exits are computed when its children are done
    done: dict[int, list[int]] = {}

    def usable(n: dict) -> list[dict]:
        return [c for c in kids.get(n["node_id"], []) if c["node_type"] in DESCEND]

    def entry(n: dict) -> int:
        while inner := usable(n):
            if n["node_type"] in ("Branch", "Loop"):
                part = next((c for c in kids.get(n["node_id"], []) if c["role"] in ("initializer", "condition")), None)
                return n["node_id"] if n["node_type"] == "Branch" or part is None else (entry(part) if part["node_type"] in DESCEND else part["node_id"])
            n = inner[0]
        return n["node_id"]

    def link(sources: list[int], to: int, kind: str = "ControlFlowEpsilon") -> None:
        for s in sources:
            if s != to:
                edges[(s, to, kind)] = None

    def part(n: dict, *roles: str) -> dict | None:
        return next((c for r in roles for c in kids.get(n["node_id"], []) if c["role"] == r), None)

    def sequence(parts: list[dict]) -> list[int]:
        for a, b in zip(parts, parts[1:], strict=False):
            link(done[a["node_id"]], entry(b))
        return done[parts[-1]["node_id"]] if parts else []

    def owner(n: dict) -> int:
        while n["parent_id"] is not None and n["node_type"] != "Function":
            n = by[n["parent_id"]]
        return n["node_id"]

    for n in sorted(rows, key=lambda r: (r["end_id"], -r["depth"])):  # post-order
        me, what = n["node_id"], n["node_type"]
        if what == "Branch":
            cond, then, other = part(n, "condition"), part(n, "consequence"), part(n, "alternative")
            if cond is None or then is None:
                raise FlowError(f"branch {me} lacks its condition or first side")
            link([me], cond["node_id"])
            link([cond["node_id"]], then["node_id"], "ControlFlowTrue")
            if other is not None:
                link([cond["node_id"]], other["node_id"], "ControlFlowFalse")
            done[me] = done.get(then["node_id"], [then["node_id"]]) + (done.get(other["node_id"], [other["node_id"]]) if other is not None else [cond["node_id"]])
        elif what == "Loop":
            cond, body, first, update = part(n, "condition"), part(n, "body"), part(n, "initializer"), part(n, "update")
            if body is None:
                raise FlowError(f"loop {me} lacks its body")
            head = cond["node_id"] if cond is not None else me
            if first is not None:
                link(done.get(first["node_id"], [first["node_id"]]), head)
            link([head], body["node_id"], "ControlFlowTrue")
            back = done.get(body["node_id"], [body["node_id"]])
            if update is not None:
                link(back, update["node_id"])
                back = [update["node_id"]]
            link(back, head)
            done[me] = [head]
        elif what == "Return":
            link(sequence(usable(n)), me)
            link([me], EXIT - owner(n))
            done[me] = []
        elif what == "Function":
            inner = [c for c in usable(n) if c["role"] in ("body", "")]
            if inner:
                link([me], entry(inner[0]))
            link(sequence(inner) or ([] if inner else [me]), EXIT - me)
            done[me] = [me]
        elif what == "Block":
            inner = usable(n)
            if inner:
                link([me], entry(inner[0]))
            done[me] = sequence(inner) if inner else [me]
        elif what in DESCEND:
            link(sequence(usable(n)), me)
            done[me] = [me]
        else:
            done[me] = [me]
    return list(edges)


def data_flow(rows: list[dict], edges: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(writer, reader, var) of one graph: definitions spread along the control flow until a node takes in nothing new."""
    after: dict[int, list[int]] = {}
    for src, dst, _ in edges:
        if dst >= 0:
            after.setdefault(src, []).append(dst)
    writes = {r["node_id"]: set(r["df_writes"]) for r in rows if r["df_writes"]}
    comes: dict[int, set] = {}
    waiting = list(writes)
    sent: dict[int, set] = {}
    while waiting:
        node = waiting.pop()
        killed = writes.get(node, set())
        out = {f for f in comes.get(node, ()) if f[0] not in killed} | {(v, node) for v in killed}
        fresh = out - sent.get(node, set())
        if not fresh:
            continue
        sent[node] = out
        for dst in after.get(node, ()):
            known = comes.setdefault(dst, set())
            if fresh - known:
                known |= fresh
                waiting.append(dst)
    return [(w, r["node_id"], v) for r in rows for v, w in sorted(comes.get(r["node_id"], ())) if v in r["df_reads"]]


CF_SCHEMA = "graph_id string, src long, dst long, edge_type string, error string"


def cf_pass(nodes: DataFrame) -> DataFrame:
    """Control-flow edges of every file; dst below 0 is the return of function -1 - dst. A file that fails gives one row with its error.

    Each graph is one file, so a group is bounded by the longest file.
    """
    cols = ["graph_id", "node_id", "end_id", "parent_id", "child_ord", "depth", "node_type", "role"]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.to_dict("records")
        for r in rows:
            r["parent_id"] = None if pd.isna(r["parent_id"]) else int(r["parent_id"])
        try:
            return pd.DataFrame([(key[0], *e, None) for e in control_flow(rows)], columns=["graph_id", "src", "dst", "edge_type", "error"])
        except FlowError as e:
            return pd.DataFrame([(key[0], None, None, None, str(e))], columns=["graph_id", "src", "dst", "edge_type", "error"]).astype({"src": "Int64", "dst": "Int64"})

    return nodes.select(*cols).groupBy("graph_id").applyInPandas(run, CF_SCHEMA)


def function_returns(nodes: DataFrame) -> DataFrame:
    """(graph_id, node_id, node_type, function_id): one node for each function's return, under the number that control flow uses for it."""
    f = nodes.filter("node_type = 'Function'")
    return f.select("graph_id", (F.lit(EXIT) - F.col("node_id")).alias("node_id"), F.lit("FunctionReturn").alias("node_type"), F.col("node_id").alias("function_id"))


def return_edges(nodes: DataFrame, flow: DataFrame, data: DataFrame) -> DataFrame:
    """(graph_id, src, dst, edge_type, var): from each function to its return node, and from each return statement, for every variable it
    reads that some writer reaches, to the return node that its control flow enters. flow: cf_pass; data: graph_id, writer, reader, var."""
    own = function_returns(nodes).select("graph_id", F.col("function_id").alias("src"), F.col("node_id").alias("dst"), F.lit("ControlFlowFunctionReturn").alias("edge_type"), F.lit(None).cast("string").alias("var"))
    leaves = nodes.filter("node_type = 'Return'").select("graph_id", F.col("node_id").alias("src")).join(flow.filter("dst < 0").select("graph_id", "src", "dst"), ["graph_id", "src"])
    read = data.select("graph_id", F.col("reader").alias("src"), "var").distinct()
    return own.unionByName(leaves.join(read, ["graph_id", "src"]).select("graph_id", "src", "dst", F.lit("PDData").alias("edge_type"), "var"))


def units(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(graph_id, unit, start_byte, hash): top-level parts of each file by name and text: what an update compares.

    The text is hashed, not the structure, so that an edit of a name or a literal is seen. Parts of one kind and name are numbered.
    """
    from pyspark.sql import Window

    top = nodes.filter("depth = 1").join(files.select("graph_id", "text"), "graph_id")
    nth = F.row_number().over(Window.partitionBy("graph_id", "kind", "name").orderBy("node_id"))
    source = F.substring(F.col("text").cast("binary"), (F.col("start_byte") + 1).cast("int"), (F.col("end_byte") - F.col("start_byte")).cast("int"))
    return top.select("graph_id", F.concat_ws("#", "kind", "name", nth.cast("string")).alias("unit"), "node_id", "start_byte", F.sha2(source, 256).alias("hash"))
