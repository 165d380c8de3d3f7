"""C text: tokens, names to mask or renumber, structure paths, and blocks of control flow.

A hand-written scanner stands in for a full grammar: it knows comments, literals, preprocessor lines, brackets and the
statements of C, which is what these functions look at.
"""

from __future__ import annotations

import contextlib
import re
import sys
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(
    r"""(?P<comment>/\*.*?\*/|//[^\n]*)|(?P<pre>^[ \t]*\#(?:[^\n\\]|\\.)*)|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
    |(?P<num>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<id>[A-Za-z_]\w*(?:::~?\w+)*)|(?P<op>->|\+\+|--|<<=?|>>=?|[<>=!+\-*/%&|^]=|&&|\|\||\.\.\.|[^\s\w])""",
    re.S | re.M | re.X,
)
STATEMENTS = {"if": "if_statement", "while": "while_statement", "for": "for_statement", "switch": "switch_statement", "do": "do_statement", "goto": "goto_statement"}
NOT_CALLED = frozenset("if while for switch return sizeof else do case goto __attribute__ _Alignof typeof defined".split())
LEAST_ROWS, LEAST_GAP, LEAST_LINES = 4, 9, 17
KEPT_TYPES = frozenset([*STATEMENTS.values(), "function_definition", "labeled_statement"])


@dataclass
class Token:
    kind: str
    text: str
    at: int
    row: int

    @property
    def end(self) -> int:
        return self.at + len(self.text)


def tokens(code: str) -> list[Token]:
    """Tokens but comments and preprocessor lines."""
    out, row, last = [], 0, 0
    for m in TOKEN.finditer(code):
        row += code.count("\n", last, m.start())
        last = m.start()
        if m.lastgroup not in ("comment", "pre"):
            out.append(Token(m.lastgroup, m.group(), m.start(), row))
    return out


def closing(ts: list[Token]) -> dict[int, int]:
    """Place of each bracket's partner; a missing one is the end."""
    pairs, stack = {}, []
    for i, t in enumerate(ts):
        if t.text in "([{" and t.kind == "op":
            stack.append(i)
        elif t.text in ")]}" and t.kind == "op" and stack:
            pairs[stack.pop()] = i
    return pairs | {i: len(ts) - 1 for i in stack}


def definitions(ts: list[Token]) -> list[tuple[int, int, int]]:
    """(name, open brace, close brace) of each function definition at the top level."""
    pairs, out, i = closing(ts), [], 0
    opening = {b: a for a, b in pairs.items() if ts[a].text == "(" and ts[b].text == ")"}
    while i < len(ts):
        if ts[i].text == "{":
            j = i - 1
            while j > 0 and ts[j].kind == "id" and ts[j - 1].text != ")" and ts[j].text not in (";", "}"):
                j -= 1  # attributes or old-style words after the parameters
            if j > 0 and ts[j].kind == "id" and ts[j - 1].text == ")":
                j -= 1
            if j > 0 and ts[j].text == ")":
                opens = opening.get(j)
                if opens and opens > 0 and ts[opens - 1].kind == "id" and ts[opens - 1].text not in NOT_CALLED:
                    out.append((opens - 1, i, pairs[i]))
            i = pairs[i]
        i += 1
    return out


def mask_definitions(code: str | None) -> str | None:
    """The name in each function definition becomes [MASK]; null for null."""
    if code is None:
        return None
    ts = tokens(code)
    for name, _, _ in reversed(definitions(ts)):
        code = code[: ts[name].at] + "[MASK]" + code[ts[name].end :]
    return code


def mask_first_call(code: str | None) -> str | None:
    """Tool B: the first identifier before a parenthesis on the first line becomes [MASK]."""
    if code is None:
        return None
    first, _, rest = code.partition("\n")
    return re.sub(r"\b[A-Za-z_]\w*(?=\s*\()", "[MASK]", first, count=1) + code[len(first) :] if rest or first else code


def rename_calls(code: str | None, prefix: str = "FUN_") -> str | None:
    """Called names that start with prefix are numbered by first appearance; other places stay."""
    if code is None:
        return None
    ts, names, out, last = tokens(code), {}, [], 0
    defined = {d[0] for d in definitions(ts)}
    for i, t in enumerate(ts[:-1]):
        before = ts[i - 1].text if i else ""
        if t.kind == "id" and t.text.startswith(prefix) and ts[i + 1].text == "(" and i not in defined and before not in ("->", "."):
            out += [code[last : t.at], names.setdefault(t.text, f"{prefix}{len(names)}")]
            last = t.end
    return "".join(out) + code[last:]


@dataclass
class Node:
    type: str
    start: int
    end: int  #: last row
    children: list[Node] = field(default_factory=list)


class Parser:
    """Statements of C as a tree with row ranges."""

    def __init__(self, code: str):
        self.ts = tokens(code)
        self.pairs = closing(self.ts)
        self.i = 0

    def _row(self, i: int) -> int:
        if not self.ts:
            return 0
        t = self.ts[min(max(i, 0), len(self.ts) - 1)]
        return t.row + t.text.count("\n")

    def _text(self, k: int = 0) -> str:
        return self.ts[self.i + k].text if self.i + k < len(self.ts) else ""

    def unit(self) -> Node:
        root, done = Node("translation_unit", 0, self._row(len(self.ts) - 1)), 0
        for name, a, b in definitions(self.ts):
            first = next((k + 1 for k in range(name, done - 1, -1) if self.ts[k].text in (";", "}")), done)
            self.i = a
            root.children.append(Node("function_definition", self.ts[first].row, self._row(b), [self._block()]))
            done = b + 1
        if not root.children:
            self.i = 0
            while self.i < len(self.ts):
                root.children.append(self._statement())
        return root

    def _block(self) -> Node:
        a, b = self.i, self.pairs.get(self.i, len(self.ts) - 1)
        node = Node("compound_statement", self.ts[a].row, self._row(b))
        self.i += 1
        while self.i < b:
            node.children.append(self._statement())
        self.i = b + 1
        return node

    def _skip_parens(self) -> None:
        if self._text() == "(":
            self.i = self.pairs.get(self.i, len(self.ts) - 1) + 1

    def _statement(self) -> Node:
        start, word = self.i, self._text()
        if word == "{":
            return self._block()
        node = Node(STATEMENTS.get(word, "expression_statement"), self.ts[start].row, self.ts[start].row)
        if word in ("if", "while", "for", "switch"):
            self.i += 1
            self._skip_parens()
            if self.i < len(self.ts):
                node.children.append(self._statement())
            if word == "if" and self._text() == "else":
                at = self.i
                self.i += 1
                if self.i < len(self.ts):
                    node.children.append(Node("else_clause", self.ts[at].row, 0, [self._statement()]))
                    node.children[-1].end = self._row(self.i - 1)
        elif word == "do":
            self.i += 1
            if self.i < len(self.ts):
                node.children.append(self._statement())
            if self._text() == "while":
                self.i += 1
                self._skip_parens()
                self.i += self._text() == ";"
        elif word in ("case", "default"):
            node.type = "case_statement"
            while self.i < len(self.ts) and self._text() != ":":
                self.i += 1
            self.i += 1
            while self.i < len(self.ts) and self._text() not in ("case", "default", "}"):
                node.children.append(self._statement())
        elif self.ts[start].kind == "id" and self._text(1) == ":":
            node.type = "labeled_statement"
            self.i += 2
            if self.i < len(self.ts) and self._text() != "}":
                node.children.append(self._statement())
        else:
            while self.i < len(self.ts) and self._text() not in (";", "}"):
                self.i = self.pairs.get(self.i, self.i) + 1 if self._text() in ("(", "[", "{") else self.i + 1
            self.i += self._text() == ";"
        if self.i == start:
            self.i += 1
        node.end = max(node.start, self._row(self.i - 1))
        return node


@contextlib.contextmanager
def deep(code: str | None):
    """Room for recursion as deep as the code may be nested."""
    was = sys.getrecursionlimit()
    sys.setrecursionlimit(max(was, 2000 + 2 * len(code or "")))
    try:
        yield
    finally:
        sys.setrecursionlimit(was)


def structure_paths(code: str | None) -> list[str]:
    """Root-to-leaf paths of statement types."""
    out: list[str] = []
    if code and code.strip():
        with deep(code):
            todo = [(Parser(code).unit(), "")]
        while todo:
            node, above = todo.pop()
            path = f"{above}>{node.type}" if above else node.type
            if not node.children:
                out.append(path)
            todo += [(c, path) for c in reversed(node.children)]
    return out


@dataclass
class Flat:
    id: int
    type: str
    rows: tuple[int, int]  #: from 0, end exclusive
    children: list[int]


def pruned(node: Node) -> Node | None:
    """Control flow taller than LEAST_ROWS, and what leads to it; else branches and cases are not entered."""
    if node.end - node.start <= LEAST_ROWS:
        return None
    below = [p for c in node.children if c.type not in ("else_clause", "case_statement") and (p := pruned(c))]
    return Node(node.type, node.start, node.end, below) if below or node.type in KEPT_TYPES else None


def flattened(root: Node) -> list[Flat]:
    """Nodes in pre-order; ids count from 0."""
    out: list[Flat] = []

    def add(node: Node) -> int:
        own = Flat(len(out), node.type, (node.start, node.end + 1), [])
        out.append(own)
        own.children = [add(c) for c in node.children]
        return own.id

    add(root)
    return out


def blocks(code: str | None, name: str) -> list[dict]:
    """``read_blocks``, or the full_function record of code that cannot be read."""
    try:
        with deep(code):
            return read_blocks(code, name)
    except (IndexError, KeyError, RecursionError):
        return full_function(code, name)


def full_function(code: str | None, name: str) -> list[dict]:
    return [{"block_id": name, "type": "full_function", "line_start": None, "line_end": None, "relation": [], "code": code, "block_code": code}]


def read_blocks(code: str | None, name: str) -> list[dict]:
    """Block records of a function: type, line range and child blocks of each, the function's own last.

    Blocks are control-flow nodes of the first top-level construct; a block whose only child nearly covers it takes
    over that child's children. Numbers fall from their count to 1, top-level block by top-level block, in each by level,
    in a level from its last node. Short functions, and those without such nodes, are one full_function record; a child
    that has no number is a KeyError.
    """
    full = full_function(code, name)
    if code is None or len(code.split("\n")) < LEAST_LINES:
        return full
    tree = pruned(Parser(code).unit())
    if tree is None:
        return full
    nodes = flattened(tree)
    top = nodes[nodes[0].children[0]] if nodes[0].children else nodes[0]
    body = nodes[top.children[0]] if len(top.children) == 1 and nodes[top.children[0]].type == "compound_statement" else top
    kept: dict[int, Flat] = {}
    drop: set[int] = set()

    def collect(i: int) -> None:
        node = nodes[i]
        children = node.children
        if len(children) == 1 and nodes[children[0]].type == "compound_statement":
            children = nodes[children[0]].children
        kept[i] = Flat(i, node.type, node.rows, list(children))
        for c in children:
            collect(c)

    for r in body.children:
        collect(r)
    for i in sorted(kept):
        node = kept[i]
        if i in drop or len(node.children) != 1:
            continue
        child = kept[node.children[0]]
        if (child.rows[0] - node.rows[0]) + (node.rows[1] - child.rows[1]) < LEAST_GAP:
            drop.add(child.id)
            node.children = list(child.children)
    order = [i for r in body.children for level in levels(nodes, r) for i in level if i in kept and i not in drop]
    label = {i: str(len(order) - k) for k, i in enumerate(order)}
    rows = code.split("\n")
    marked: dict[int, list[str]] = {}
    for i in order:
        a, b = kept[i].rows
        marked.setdefault(a, []).append(_marker(label[i], "start"))
        marked.setdefault(min(b, len(rows)), []).insert(0, _marker(label[i], "end"))
    text = "\n".join(x for k in range(len(rows) + 1) for x in [*marked.get(k, []), *rows[k : k + 1]])
    resolve = lambda cs: [label[c] for c in cs]
    out = [{"block_id": label[i], "type": kept[i].type, "line_start": kept[i].rows[0], "line_end": kept[i].rows[1], "relation": resolve(kept[i].children), "code": None, "block_code": None} for i in order]
    return [*out, {"block_id": name, "type": top.type, "line_start": None, "line_end": None, "relation": resolve(body.children), "code": code, "block_code": text}]


def levels(nodes: list[Flat], root: int) -> list[list[int]]:
    """Ids of the root's descendants by depth, each level from its last node to its first."""
    out, level = [], [root]
    while level:
        out.append(sorted(level, reverse=True))
        level = [c for i in level for c in nodes[i].children]
    return out


def _marker(block: str, what: str) -> str:
    return "//" + "=" * 15 + f"block {block} {what}" + "=" * 15


BLOCK = T.StructType(
    [T.StructField("block_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()),
     T.StructField("relation", T.ArrayType(T.StringType())), T.StructField("code", T.StringType()), T.StructField("block_code", T.StringType())]
)


@F.pandas_udf(T.StringType())
def mask_definitions_udf(code: pd.Series) -> pd.Series:
    return code.map(mask_definitions, na_action="ignore")


@F.pandas_udf(T.StringType())
def rename_calls_udf(code: pd.Series) -> pd.Series:
    return code.map(rename_calls, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def structure_paths_udf(code: pd.Series) -> pd.Series:
    return code.map(structure_paths)


@F.udtf(returnType=BLOCK)
class CodeBlocks:
    """UDTF (code, function name) to block records; a function that cannot be read gives its full_function record."""

    def eval(self, code: str, name: str):
        for b in blocks(code, name):
            yield tuple(b[f.name] for f in BLOCK.fields)


@F.pandas_udf(T.ArrayType(BLOCK))
def code_blocks_udf(code: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([blocks(c, n) for c, n in zip(code, name, strict=True)])


# Fixed values of the Itanium C++ ABI: builtin types, operators, and the standard library's short names.
_BUILTIN = {
    "v": "void", "w": "wchar_t", "b": "bool", "c": "char", "a": "signed char", "h": "unsigned char", "s": "short", "t": "unsigned short", "i": "int", "j": "unsigned int",
    "l": "long", "m": "unsigned long", "x": "long long", "y": "unsigned long long", "f": "float", "d": "double", "e": "long double", "z": "...",
}
_OPERATORS = {
    "nw": " new", "na": " new[]", "dl": " delete", "da": " delete[]", "ps": "+", "ng": "-", "ad": "&", "de": "*", "co": "~", "pl": "+", "mi": "-", "ml": "*", "dv": "/", "rm": "%",
    "an": "&", "or": "|", "eo": "^", "aS": "=", "pL": "+=", "mI": "-=", "mL": "*=", "dV": "/=", "rM": "%=", "aN": "&=", "oR": "|=", "eO": "^=", "ls": "<<", "rs": ">>",
    "lS": "<<=", "rS": ">>=", "eq": "==", "ne": "!=", "lt": "<", "gt": ">", "le": "<=", "ge": ">=", "nt": "!", "aa": "&&", "oo": "||", "pp": "++", "mm": "--", "cm": ",",
    "pm": "->*", "pt": "->", "cl": "()", "ix": "[]",
}
_STANDARD = {"t": "std", "a": "std::allocator", "b": "std::basic_string", "s": "std::string", "i": "std::istream", "o": "std::ostream", "d": "std::iostream"}
_ORDINAL = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Mangled:
    """Reader of one mangled name: nested and template names, operators, substitutions and the common types."""

    def __init__(self, text: str):
        self.s, self.i = text, 0
        self.known: list[str] = []
        self.args: list[str] = []  #: of the outermost template, for T_ in types that follow

    def ahead(self, n: int = 1) -> str:
        return self.s[self.i : self.i + n]

    def take(self, word: str) -> bool:
        if self.s.startswith(word, self.i):
            self.i += len(word)
            return True
        return False

    def ordinal(self) -> int:
        """A number in base 36 before an underscore: none is 0, 0 is 1, and so on."""
        at = self.s.index("_", self.i)
        digits, self.i = self.s[self.i : at], at + 1
        n = 0
        for d in digits:
            n = 36 * n + _ORDINAL.index(d)
        return n + 1 if digits else 0

    def source_name(self) -> str:
        m = re.compile(r"\d+").match(self.s, self.i)
        if not m:
            raise ValueError(self.s)
        self.i = m.end() + int(m[0])
        if self.i > len(self.s):
            raise ValueError(self.s)
        return self.s[m.end() : self.i]

    def unqualified(self, above: str) -> str:
        plain = re.sub(r"<.*", "", above).rsplit("::", 1)[-1]
        if self.ahead() == "C" and self.ahead(2)[1:] in "123":
            self.i += 2
            return plain
        if self.ahead() == "D" and self.ahead(2)[1:] in "012":
            self.i += 2
            return "~" + plain
        if (op := _OPERATORS.get(self.ahead(2))) and not self.ahead().isdigit():
            self.i += 2
            return "operator" + op
        if self.take("cv"):
            return "operator " + self.type()
        self.take("L")
        return self.source_name()

    def substitution(self) -> str:
        self.i += 1
        if self.ahead() in _STANDARD:
            self.i += 1
            return _STANDARD[self.s[self.i - 1]]
        return self.known[self.ordinal()]

    def template_args(self) -> str:
        self.i += 1
        args: list[str] = []
        while not self.take("E"):
            if self.take("L"):
                kind = self.type()
                m = re.compile(r"n?\d+").match(self.s, self.i)
                value, self.i = m[0].replace("n", "-"), m.end()
                self.take("E")
                args.append({"bool": {"0": "false", "1": "true"}.get(value, value), "int": value}.get(kind, f"({kind}){value}"))
            elif self.take("J"):
                while not self.take("E"):
                    args.append(self.type())
            else:
                args.append(self.type())
        self.args = args
        text = ", ".join(args)
        return f"<{text} >" if text.endswith(">") else f"<{text}>"

    def name(self) -> tuple[str, bool]:
        """The name, and whether template arguments end it."""
        if self.take("N"):
            while self.ahead() in "KVrRO" and self.ahead():
                self.i += 1
            full, templated = "", False
            while not self.take("E"):
                if self.ahead() == "I":
                    full, templated = full + self._spaced(full) + self.template_args(), True
                    self.known.append(full)
                    continue
                if self.ahead() == "S":
                    at = self.i
                    full, templated = self.substitution(), False
                    if self.s[at : self.i] == "St":
                        full += "::" + self.unqualified(full)
                        self.known.append(full)
                    continue
                if self.ahead() == "T":
                    full = self.template_param()
                else:
                    part = self.unqualified(full)
                    full = f"{full}::{part}" if full else part
                templated = False
                self.known.append(full)
            if self.known:
                self.known.pop()  # the whole name is no candidate of its own
            return full, templated
        if self.ahead() == "Z":
            self.i += 1
            outer, _ = self.name()
            self.parameters()
            self.take("E")
            inner, templated = self.name()
            return f"{outer}()::{inner}", templated
        if self.take("St"):
            full = "std::" + self.unqualified("std")
        elif self.ahead() == "S":
            full = self.substitution()
            return (full + self.template_args(), True) if self.ahead() == "I" else (full, False)
        else:
            full = self.unqualified("")
        if self.ahead() == "I":
            self.known.append(full)
            return full + self._spaced(full) + self.template_args(), True
        return full, False

    @staticmethod
    def _spaced(name: str) -> str:
        return " " if name.endswith("<") else ""

    def template_param(self) -> str:
        self.i += 1
        return self.args[self.ordinal()]

    def type(self) -> str:
        c = self.ahead()
        if c in "PRO" and c:
            self.i += 1
            inner = self.type()
            out = inner + {"P": "*", "R": "&", "O": "&&"}[c]
        elif c in "KV" and c:
            self.i += 1
            inner = self.type()
            out = f"{inner} {'const' if c == 'K' else 'volatile'}"
        elif c in _BUILTIN:
            self.i += 1
            return _BUILTIN[c]
        elif c == "T":
            out = self.template_param()
        elif c == "S" and self.ahead(2) != "St":
            out = self.substitution()
            if self.ahead() != "I":
                return out
            out += self.template_args()
        elif c and (c in "NSZ" or c.isdigit()):
            out, _ = self.name()
        else:
            raise ValueError(self.s)
        self.known.append(out)
        return out

    def parameters(self) -> None:
        while self.i < len(self.s) and self.ahead() != "E":
            self.type()

    def function(self) -> str:
        """The name up to its parameters; that of a template begins with the type it returns."""
        full, templated = self.name()
        last = re.sub(r"<.*", "", full).rsplit("::", 1)[-1]
        if not templated or not self.ahead() or last.startswith(("~", "operator ")):
            return full
        args = list(self.args)
        returned = self.type()
        self.args = args
        return f"{returned} {full}"


def demangle(text: str | None) -> str | None:
    """The last mangled word, up to its parameters; words that cannot be read do not count; the text if there is none."""
    if text is None:
        return None
    found = ""
    for m in re.finditer(r"_Z(\w+)", text):
        try:
            with deep(text):
                found = Mangled(m[1]).function().split("(")[0]
        except (AttributeError, IndexError, RecursionError, ValueError):
            continue
    return found or text


@F.pandas_udf(T.StringType())
def demangle_udf(text: pd.Series) -> pd.Series:
    return text.map(demangle, na_action="ignore")
