"""Symbols and edges of source files: Python by its own parser, other languages by a masked scan.

Every file is read on its own, in one pass that emits symbols and edges in one
tagged schema. There is no compiler here: types are names as written, calls
are resolved inside the file and otherwise keep the name that was called.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X

SCHEMA = (
    "part string, path string, fqn string, name string, kind string, signature string, start_line int, end_line int, accessibility string, "
    "documentation string, is_test_method boolean, complexity int, nesting int, from_fqn string, to_fqn string, type string, metadata map<string,string>"
)
_COLUMNS = [c.strip().split(" ")[0] for c in SCHEMA.split(", ")]


@dataclass
class Symbol:
    fqn: str
    name: str
    kind: str
    start: int
    end: int
    signature: str | None = None
    access: str | None = None
    doc: str | None = None
    test: bool = False
    complexity: int | None = None
    nesting: int | None = None


@dataclass
class Parsed:
    path: str
    symbols: list[Symbol] = field(default_factory=list)
    edges: dict[tuple[str, str, str], dict[str, str]] = field(default_factory=dict)

    def edge(self, a: str, b: str, kind: str, line: int | None = None, **more: str) -> None:
        """An edge once; the first line counts."""
        if a and b:
            self.edges.setdefault((a, b, kind), {**({"line": str(line)} if line else {}), **more})

    def rows(self) -> Iterator[tuple]:
        for s in self.symbols:
            yield ("symbol", self.path, s.fqn, s.name, s.kind, s.signature, s.start, s.end, s.access, s.doc, s.test, s.complexity, s.nesting, None, None, None, None)
        for (a, b, kind), more in self.edges.items():
            yield ("edge", self.path, *[None] * 11, a, b, kind, more or None)


# ---- Python ----


class _Python(ast.NodeVisitor):
    def __init__(self, path: str, module: str, lines: list[str]):
        self.out, self.module, self.lines = Parsed(path), module, lines
        self.scope: list[tuple[str, str]] = [(module, "module")]
        self.constants: dict[str, str] = {}
        self.local: dict[str, str] = {}

    def run(self, tree: ast.Module) -> Parsed:
        self.out.symbols.append(Symbol(self.module, self.module.rpartition(".")[2], "module", 1, len(self.lines), doc=ast.get_docstring(tree)))
        for n in ast.walk(tree):
            if isinstance(n, ast.ImportFrom):
                self.local.update({a.asname or a.name: f"{n.module or ''}.{a.name}".lstrip(".") for a in n.names})
            elif isinstance(n, ast.Import):
                self.local.update({a.asname or a.name.split(".")[0]: a.name if a.asname else a.name.split(".")[0] for a in n.names})
        for n in tree.body:
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                self.local[n.name] = f"{self.module}.{n.name}"
            elif isinstance(n, ast.Assign) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str):
                self.constants.update({t.id: n.value.value for t in n.targets if isinstance(t, ast.Name)})
        self.visit(tree)
        return self.out

    def _name(self, n: ast.AST) -> str:
        return ast.unparse(n)

    def _resolve(self, n: ast.AST) -> str:
        text = self._name(n)
        head, dot, rest = text.partition(".")
        if head in ("self", "cls"):
            owner = next((f for f, k in reversed(self.scope) if k == "class"), self.module)
            return f"{owner}.{rest}" if rest else owner
        return f"{self.local[head]}{dot}{rest}" if head in self.local else text

    def visit_Import(self, n: ast.Import) -> None:
        for a in n.names:
            self.out.edge(self.module, a.name, "DependsOn", n.lineno)

    def visit_ImportFrom(self, n: ast.ImportFrom) -> None:
        self.out.edge(self.module, "." * n.level + (n.module or ""), "DependsOn", n.lineno)

    def visit_ClassDef(self, n: ast.ClassDef) -> None:
        fqn = f"{self.scope[-1][0]}.{n.name}"
        self.out.symbols.append(Symbol(fqn, n.name, "class", n.lineno, n.end_lineno or n.lineno, f"class {n.name}", _python_access(n.name), ast.get_docstring(n)))
        self.out.edge(self.scope[-1][0], fqn, "Declares", n.lineno)
        for b in n.bases:
            self.out.edge(fqn, self._name(b).split("[")[0], "Inherits", n.lineno)
        self.scope.append((fqn, "class"))
        self.generic_visit(n)
        self.scope.pop()

    def _function(self, n: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        owner, where = self.scope[-1]
        fqn = f"{owner}.{n.name}"
        names = [self._name(d).split("(")[0] for d in n.decorator_list]
        prop = where == "class" and any(x == "property" or x.endswith(".setter") for x in names)
        kind = "property" if prop else "method" if where == "class" else "function"
        returns = f" -> {self._name(n.returns)}" if n.returns else ""
        sig = f"{'async ' if isinstance(n, ast.AsyncFunctionDef) else ''}def {n.name}({self._name(n.args)}){returns}"
        decisions, depth = _python_metrics(n)
        test = n.name.startswith("test_")
        self.out.symbols.append(Symbol(fqn, n.name, kind, n.lineno, n.end_lineno or n.lineno, sig, _python_access(n.name), ast.get_docstring(n), test, 1 + decisions, depth))
        self.out.edge(owner, fqn, {"property": "HasProperty", "method": "HasMethod"}.get(kind, "Declares"), n.lineno)
        for d in n.decorator_list:
            self._route(d, fqn)
        for a in [*n.args.args, *n.args.kwonlyargs]:
            if a.annotation is not None:
                self.out.edge(fqn, self._name(a.annotation).split("[")[0], "UsesType", n.lineno)
        self.scope.append((fqn, "function"))
        for x in n.body:
            self.visit(x)
        self.scope.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def _route(self, d: ast.expr, handler: str) -> None:
        """Verb decorators, websocket, and route with its methods (GET by default)."""
        if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str)):
            return
        verb, verbs = d.func.attr, []
        if verb in ("get", "post", "put", "delete", "patch", "head", "options"):
            verbs = [verb.upper()]
        elif verb == "websocket":
            verbs = ["WS"]
        elif verb in ("route", "api_route"):
            given = next((k.value for k in d.keywords if k.arg == "methods"), None)
            verbs = [e.value.upper() for e in given.elts if isinstance(e, ast.Constant)] if isinstance(given, ast.List | ast.Tuple) else ["GET"]
        for v in verbs:
            _endpoint(self.out, v, d.args[0].value, handler, d.lineno)

    def _text(self, n: ast.AST | None) -> str | None:
        if isinstance(n, ast.Constant) and isinstance(n.value, str):
            return n.value
        return self.constants.get(n.id) if isinstance(n, ast.Name) else None

    def visit_Subscript(self, n: ast.Subscript) -> None:
        if self._name(n.value) == "os.environ" and (key := self._text(n.slice)):
            self.out.edge(self.scope[-1][0], f"env:{key}", "ReadsConfig", n.lineno)
        self.generic_visit(n)

    def visit_Call(self, n: ast.Call) -> None:
        caller, target = self.scope[-1][0], self._name(n.func)
        first = self._text(n.args[0]) if n.args else None
        if target in ("os.environ.get", "os.getenv") and first:
            self.out.edge(caller, f"env:{first}", "ReadsConfig", n.lineno)
        elif re.match(r"(requests|httpx)\.", target) and first:
            self.out.edge(caller, f"http:{first}", "HttpCalls", n.lineno, method=target.rpartition(".")[2].upper())
        elif target.endswith("urlopen") and first:
            self.out.edge(caller, f"http:{first}", "HttpCalls", n.lineno, method="GET")
        elif target.rpartition(".")[2] in ("publish", "emit", "send_event") and first:
            self.out.edge(caller, f"event:{first}", "Publishes", n.lineno)
        elif target.rpartition(".")[2] in ("subscribe", "on", "add_listener") and first:
            self.out.edge(caller, f"event:{first}", "Subscribes", n.lineno)
        if isinstance(n.func, ast.Name | ast.Attribute) and not isinstance(getattr(n.func, "value", None), ast.Call):
            test = any(s.fqn == caller and s.test for s in self.out.symbols)
            self.out.edge(caller, self._resolve(n.func), "TestCovers" if test else "Calls", n.lineno)
        self.generic_visit(n)

    def visit_Raise(self, n: ast.Raise) -> None:
        if n.exc is not None:
            self.out.edge(self.scope[-1][0], self._name(n.exc.func if isinstance(n.exc, ast.Call) else n.exc), "Throws", n.lineno)
        self.generic_visit(n)

    def visit_ExceptHandler(self, n: ast.ExceptHandler) -> None:
        for t in n.type.elts if isinstance(n.type, ast.Tuple) else [n.type] if n.type else []:
            self.out.edge(self.scope[-1][0], self._name(t), "Catches", n.lineno)
        self.generic_visit(n)


def _python_access(name: str) -> str:
    return "private" if name.startswith("_") and not name.startswith("__") else "public"


def _python_metrics(n: ast.AST) -> tuple[int, int]:
    decisions, deepest = 0, 0
    todo = [(c, 0) for c in ast.iter_child_nodes(n)]
    while todo:
        x, d = todo.pop()
        if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef | ast.Lambda):
            continue
        block = isinstance(x, ast.If | ast.For | ast.AsyncFor | ast.While | ast.Try | ast.With | ast.AsyncWith | ast.Match)
        decisions += isinstance(x, ast.If | ast.For | ast.AsyncFor | ast.While | ast.ExceptHandler | ast.IfExp | ast.match_case | ast.comprehension)
        decisions += len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0
        deepest = max(deepest, d + block)
        todo += [(c, d + block) for c in ast.iter_child_nodes(x)]
    return decisions, deepest


def parse_python(path: str, text: str) -> Parsed:
    module = re.sub(r"(/__init__)?\.py$", "", path).replace("/", ".")
    return _Python(path, module, text.split("\n")).run(ast.parse(text))


def _endpoint(out: Parsed, verb: str, route: str, handler: str, line: int) -> None:
    fqn = f"API:{verb}:{route.lstrip('/')}"
    out.symbols.append(Symbol(fqn, route, "api_endpoint", line, line, f"{verb} {route}"))
    out.edge(fqn, handler, "HandledBy", line)


# ---- other languages ----


def mask(text: str, language: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with comments and string contents blanked, places kept, and the comments as (begin, end, text)."""
    line = r"//[^\n]*|#(?!\[)[^\n]*" if language == "php" else r"//[^\n]*"
    chars = r"'(?:\\.|[^'\\\n])'" if language in ("java", "csharp", "go", "rust") else r"'(?:\\.|[^'\\\n])*'"
    ticks = r"`(?:\\.|[^`\\])*`" if language in ("typescript", "go") else r"(?!)"
    verbatim = r'@"(?:""|[^"])*"' if language == "csharp" else r"(?!)"
    comments = []
    out, last = [], 0
    for m in re.finditer(rf'(?P<c>{line}|/\*.*?(?:\*/|\Z))|(?P<s>{verbatim}|"(?:\\.|[^"\\\n])*"|{chars}|{ticks})', text, re.S):
        out.append(text[last : m.start()])
        if m["c"]:
            comments.append((m.start(), m.end(), m[0]))
            out.append(re.sub(r"[^\n]", " ", m[0]))
        else:
            out.append(m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1])
        last = m.end()
    out.append(text[last:])
    return "".join(out), comments


_MOD = r"(?P<mod>(?:(?:export|default|declare|public|private|protected|internal|static|abstract|final|sealed|async|virtual|override|readonly|partial|unsafe|extern|synchronized|native|new|pub(?:\([^)]*\))?|const|get|set)\s+)*)"
_ID = r"[A-Za-z_$][\w$]*"
_TYPE = r"[\w$.<>\[\],?&*: ]+?"
# per language: (kind, pattern); names in group "name", modifiers in "mod", bases in "up" and "impl"
_DEFINITIONS: dict[str, list[tuple[str, str]]] = {
    "typescript": [
        ("class", rf"{_MOD}class\s+(?P<name>{_ID})[^{{]*?(?:\bextends\s+(?P<up>[\w$.]+)[^{{]*?)?(?:\bimplements\s+(?P<impl>[^{{]+))?\{{"),
        ("interface", rf"{_MOD}interface\s+(?P<name>{_ID})[^{{]*?(?:\bextends\s+(?P<up>[^{{]+))?\{{"),
        ("enum", rf"{_MOD}enum\s+(?P<name>{_ID})\s*\{{"),
        ("type", rf"{_MOD}type\s+(?P<name>{_ID})\s*(?:<[^=]*>)?\s*="),
        ("function", rf"{_MOD}function\s*\*?\s*(?P<name>{_ID})\s*(?:<[^(]*>)?\("),
        ("function", rf"{_MOD}(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^()]*\)|{_ID})\s*(?::[^=]+)?=>"),
        ("member", rf"(?:^[ \t]+|(?<=[{{}};])[ \t]*){_MOD}\*?(?P<name>{_ID})\s*(?:<[^(]*>)?\([^;{{}}]*\)\s*(?::[^;{{]+)?\{{"),
    ],
    "java": [
        ("class", rf"{_MOD}(?:class|record)\s+(?P<name>{_ID})[^{{]*?(?:\bextends\s+(?P<up>[\w.]+)[^{{]*?)?(?:\bimplements\s+(?P<impl>[^{{]+))?\{{"),
        ("interface", rf"{_MOD}interface\s+(?P<name>{_ID})[^{{]*?(?:\bextends\s+(?P<up>[^{{]+))?\{{"),
        ("enum", rf"{_MOD}enum\s+(?P<name>{_ID})[^{{]*\{{"),
        ("member", rf"(?:^[ \t]+|(?<=[{{}};])[ \t]*){_MOD}(?:<[^>]+>\s*)?(?:(?P<ret>{_TYPE})\s+)?(?P<name>{_ID})\s*\([^;{{}}]*\)\s*(?:throws\s+[^{{;]+)?[{{;]"),
    ],
    "csharp": [
        ("namespace", r"^\s*namespace\s+(?P<name>[\w.]+)\s*[;{]"),
        ("class", rf"{_MOD}(?:class|record(?:\s+(?:struct|class))?|struct)\s+(?P<name>{_ID})[^{{;]*?(?::\s*(?P<impl>[^{{;]+?))?\s*(?:where[^{{;]*)?[{{;]"),
        ("interface", rf"{_MOD}interface\s+(?P<name>{_ID})[^{{]*?(?::\s*(?P<impl>[^{{]+?))?\s*\{{"),
        ("enum", rf"{_MOD}enum\s+(?P<name>{_ID})[^{{]*\{{"),
        ("event", rf"{_MOD}event\s+{_TYPE}\s+(?P<name>{_ID})\s*[;{{]"),
        ("property", rf"(?:^[ \t]+|(?<=[{{}};])[ \t]*){_MOD}(?P<ret>{_TYPE})\s+(?P<name>{_ID})\s*(?:\{{\s*(?:(?:public|private|protected|internal)\s+)?(?:get|set|init)\b|=>)"),
        ("member", rf"(?:^[ \t]+|(?<=[{{}};])[ \t]*){_MOD}(?:(?P<ret>{_TYPE})\s+)?(?P<name>{_ID})\s*(?:<[^(]*>)?\([^;{{}}]*\)\s*(?::[^{{;]+|where[^{{;]+)?(?:\{{|=>|;)"),
        ("field", rf"^[ \t]+(?P<mod>(?:(?:public|private|protected|internal|static|readonly|const|volatile)\s+)+)(?P<ret>{_TYPE})\s+(?P<name>{_ID})\s*(?:=(?!>)[^;]*)?;"),
    ],
    "go": [
        ("class", rf"type\s+(?P<name>{_ID})(?:\[[^\]]*\])?\s+struct\s*\{{"),
        ("interface", rf"type\s+(?P<name>{_ID})(?:\[[^\]]*\])?\s+interface\s*\{{"),
        ("type", rf"type\s+(?P<name>{_ID})\s+=?\s*[\w.*\[\]]+[ \t]*$"),
        ("function", rf"func\s+(?:\(\s*(?:{_ID}\s+)?\*?(?P<owner>{_ID})[^)]*\)\s*)?(?P<name>{_ID})\s*(?:\[[^\]]*\])?\("),
    ],
    "rust": [
        ("module", rf"{_MOD}mod\s+(?P<name>{_ID})\s*\{{"),
        ("class", rf"{_MOD}struct\s+(?P<name>{_ID})"),
        ("enum", rf"{_MOD}enum\s+(?P<name>{_ID})[^{{]*\{{"),
        ("interface", rf"{_MOD}trait\s+(?P<name>{_ID})(?:[^{{:]*:\s*(?P<up>[^{{]+))?[^{{]*\{{"),
        ("impl", rf"impl(?:<[^>]*>)?\s+(?:(?P<impl>[\w:<>]+)\s+for\s+)?(?P<name>[\w:]+)[^{{]*\{{"),
        ("function", rf"{_MOD}fn\s+(?P<name>{_ID})\s*(?:<[^(]*>)?\("),
    ],
    "php": [
        ("class", rf"{_MOD}class\s+(?P<name>{_ID})(?:\s+extends\s+(?P<up>[\w\\]+))?(?:\s+implements\s+(?P<impl>[^{{]+))?\s*\{{"),
        ("interface", rf"{_MOD}interface\s+(?P<name>{_ID})(?:\s+extends\s+(?P<up>[^{{]+))?\s*\{{"),
        ("interface", rf"trait\s+(?P<name>{_ID})\s*\{{"),
        ("function", rf"{_MOD}function\s+&?(?P<name>{_ID})\s*\("),
    ],
}
_KEYWORDS = frozenset(
    "if for while switch catch return new throw else do try using lock fixed foreach sizeof typeof nameof default case await yield function func fn class match loop "
    "super this self in of not and or elseif include require echo print isset unset empty list array assert defer go select chan map make append len cap panic delete instanceof import export constructor "
    "async static get set where when base unchecked checked let var const mut ref move impl pub use mod trait struct enum interface type synchronized".split()
)
_TYPES = {"class", "interface", "enum", "impl", "type"}
_TEST_MARK = {
    "java": r"@(?:Test|ParameterizedTest|RepeatedTest)\b",
    "csharp": r"\[\s*(?:Fact|Theory|Test|TestMethod|TestCase)\b",
    "rust": r"#\[(?:\w+::)?test\]",
    "php": r"@test\b|#\[Test\]",
}
_DECISIONS = re.compile(r"\b(?:if|for|foreach|while|case|catch|elseif|match)\b|\?(?![.?:>])(?=[^:;]*:)|&&|\|\||\?\?")


def _close(masked: str, at: int) -> int:
    """The place after the brace that closes the one at ``at``."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(masked, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(masked)


def _access(mod: str, language: str, name: str) -> str | None:
    words = mod.split()
    for w in ("export", "public", "private", "protected", "internal"):
        if w in words:
            return w
    if language == "go":
        return "public" if name[:1].isupper() else "private"
    if language == "rust":
        return "pub" if any(w.startswith("pub") for w in words) else "private"
    return {"php": "public", "csharp": "private"}.get(language)


@dataclass
class _Definition:
    kind: str
    name: str
    begin: int
    body: int
    end: int
    mod: str
    head: str
    up: str
    impl: str
    owner: str | None
    ret: str
    fqn: str = ""
    parent: _Definition | None = None


def _find(masked: str, language: str) -> list[_Definition]:
    found: dict[int, _Definition] = {}
    for kind, pattern in _DEFINITIONS[language]:
        for m in re.finditer(pattern, masked, re.M):
            g = m.groupdict()
            name, ret = g["name"], (g.get("ret") or "").strip()
            at = m.start("name")
            if at in found or kind == "member" and name in _KEYWORDS and name != "constructor" or ret.split(" ")[0] in ("return", "new", "throw", "else", "await", "case", "using", "var"):
                continue
            if kind == "member" and language in ("java", "csharp") and m[0].rstrip().endswith(";") and not ret:
                continue
            open_at = masked.find("{", m.end() - 1) if m[0].rstrip()[-1:] not in ";" else -1
            stop = masked.find(";", m.end() - 1)
            if kind in ("function", "member") and open_at >= 0 and m[0].rstrip()[-1:] not in "{":
                # the body opens after the parameters; a semicolon before it means there is none
                depth, i = 0, m.end() - 1
                for c in re.compile(r"[(){};]").finditer(masked, masked.find("(", at)):
                    depth += {"(": 1, ")": -1}.get(c[0], 0)
                    if depth == 0 and c[0] in "{;":
                        open_at, i = (c.start() if c[0] == "{" else -1), c.start()
                        break
                stop = i
            if kind == "property":
                open_at = masked.find("{", at, m.end())
            body = open_at if open_at >= 0 and (kind != "field" and not (kind == "namespace" and m[0].rstrip().endswith(";"))) else -1
            if kind == "class" and language == "rust" and (body < 0 or 0 <= stop < body):
                body = -1
            if kind == "type":
                body = -1
            end = _close(masked, body) if body >= 0 else (stop + 1 if stop >= 0 else m.end())
            head = re.sub(r"\s+", " ", masked[m.start() : body if body >= 0 else end]).strip().rstrip("{;").strip()
            found[at] = _Definition(kind, name, m.start() + len(m[0]) - len(m[0].lstrip()), body, end, g.get("mod") or "", head, (g.get("up") or "").strip(), (g.get("impl") or "").strip(), g.get("owner"), ret)
    defs = sorted(found.values(), key=lambda d: (d.begin, -d.end))
    stack: list[_Definition] = []
    for d in defs:
        while stack and d.begin >= stack[-1].end:
            stack.pop()
        d.parent = stack[-1] if stack else None
        if d.body >= 0:
            stack.append(d)
    return defs


def _split_types(s: str) -> list[str]:
    flat = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", s))
    return [x.strip().split(" ")[0] for x in re.split(r"[,+]", flat) if x.strip()]


def parse_masked(path: str, text: str, language: str) -> Parsed:
    masked, comments = mask(text, language)
    out = Parsed(path)
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    from bisect import bisect_left

    line_of = lambda at: bisect_left(breaks, at) + 1
    stem = re.sub(r"\.\w+$", "", path)
    package = re.search({"java": r"^\s*package\s+([\w.]+)", "go": r"^\s*package\s+(\w+)", "php": r"^\s*namespace\s+([\w\\]+)", "csharp": r"^\s*namespace\s+([\w.]+)\s*;"}.get(language, r"(?!)"), masked, re.M)
    root = {"typescript": path, "rust": "crate::" + re.sub(r"(^|/)src/|/?(mod|lib|main)$", "", stem).strip("/").replace("/", "::")}.get(language, package[1] if package else "")
    root = root.rstrip(":") if language == "rust" else root
    sep, member = {"typescript": (":", "."), "rust": ("::", "::"), "php": ("\\", "::")}.get(language, (".", "."))
    defs = [d for d in _find(masked, language)]
    if language in ("typescript", "php"):
        defs = [d for d in defs if d.kind != "member" or d.parent and d.parent.kind in ("class", "interface")]
    if language in ("java", "csharp"):
        defs = [d for d in defs if d.kind not in ("member", "property", "field", "event") or d.parent and d.parent.kind in ("class", "interface", "enum")]
    kept = set(map(id, defs))
    for d in defs:
        while d.parent is not None and id(d.parent) not in kept:
            d.parent = d.parent.parent
    if language in ("typescript", "rust", "go"):
        out.symbols.append(Symbol(root or path, (root or path).rpartition("/")[2], "module", 1, len(breaks) + 1))
    names: dict[str, list[str]] = {}
    functions: list[_Definition] = []
    for d in defs:
        above = d.parent
        kind, base = d.kind, above.fqn if above else root
        if kind == "namespace":
            d.fqn = d.name
            out.symbols.append(Symbol(d.fqn, d.name, "namespace", line_of(d.begin), line_of(d.end - 1)))
            continue
        if kind == "impl":
            d.fqn = f"{root}::{d.name.rpartition('::')[2]}"
            if d.impl:
                out.edge(d.fqn, d.impl.split("<")[0], "Implements", line_of(d.begin))
            continue
        in_type = above is not None and above.kind in ("class", "interface", "enum", "impl")
        if d.owner:
            base, in_type = f"{root}.{d.owner}", True
        join = member if in_type else sep
        d.fqn = f"{base}{join}{d.name}" if base else d.name
        if kind == "member" or kind == "function" and in_type:
            kind = "constructor" if above is not None and above.kind == "class" and (d.name in (above.name, "constructor", "__construct")) else "method"
        if kind == "constructor":
            d.fqn = f"{above.fqn}{member}ctor"
        shown = {"class": "struct" if re.search(r"\bstruct\b", d.head) else "record" if re.search(r"\brecord\b", d.head) else "class"}.get(kind, kind)
        before = text[text.rfind("}", 0, d.begin) + 1 if text.rfind("}", 0, d.begin) > text.rfind(";", 0, d.begin) else text.rfind(";", 0, d.begin) + 1 : d.begin]
        test = bool(re.search(_TEST_MARK[language], before)) if language in _TEST_MARK else False
        test = test or language == "go" and d.name.startswith("Test") or language == "php" and kind == "method" and d.name.startswith("test")
        is_code = kind in ("method", "function", "constructor") and d.body >= 0
        body = masked[d.body : d.end] if is_code else ""
        out.symbols.append(
            Symbol(d.fqn, d.name, shown, line_of(d.begin), line_of(d.end - 1), d.head, _access(d.mod, language, d.name), _doc_before(text, comments, d.begin), test and kind in ("method", "function"), *((1 + len(_DECISIONS.findall(body)), _nesting(body)) if is_code else (None, None)))
        )
        names.setdefault(d.name, []).append(d.fqn)
        link = {"method": "HasMethod", "constructor": "HasConstructor", "property": "HasProperty", "field": "HasField", "event": "HasEvent"}.get(kind, "Declares")
        out.edge(base or path, d.fqn, link, line_of(d.begin))
        for b in _split_types(d.up):
            out.edge(d.fqn, b, "Inherits", line_of(d.begin))
        for b in _split_types(d.impl):
            first = language == "csharp" and kind == "class" and not re.match(r"I[A-Z]", b)
            out.edge(d.fqn, b, "Inherits" if first else "Implements", line_of(d.begin))
        if is_code:
            functions.append(d)
        if kind == "constructor":
            for t in re.findall(r"(?:^|[(,])\s*(?:final\s+|readonly\s+|private\s+|public\s+)*([A-Z][\w.]*)(?:<[^>]*>)?\s+\w+", d.head[d.head.find("(") :]):
                out.edge(above.fqn, t, "DependsOn", line_of(d.begin))
        elif d.ret and re.match(r"[A-Z]", d.ret) and kind in ("method", "property", "field"):
            t = d.ret
            while inner := re.match(r"(?:Task|ValueTask|ActionResult|List|IEnumerable|IReadOnlyList|ICollection|Optional|Set|IAsyncEnumerable)<(.+)>\??$", t):
                t = inner[1]
            t = t.split("<")[0].strip("?[] ")
            if not t.startswith(("System", "Microsoft.Extensions")) and t != (above.name if above else ""):
                out.edge(above.fqn if above else d.fqn, t, "UsesType", line_of(d.begin))
    for m in re.finditer({"typescript": r"""import\s+(?:[^;'"]*?from\s+)?['"]|require\(['"]""", "java": r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", "csharp": r"^\s*using\s+([\w.]+)\s*;", "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)", "php": r"^\s*use\s+([\w\\]+)", "go": r"(?!)"}[language], masked, re.M):
        if language == "typescript":
            spec = re.match(r"[^'\"]*", text[m.end() :])[0]
            named = re.search(r"\{([^}]*)\}", m[0])
            names_of = [re.sub(r"\s+as\s+", ":", x.strip().removeprefix("type ").strip()) for x in named[1].split(",") if x.strip()] if named else []
            out.edge(root, spec, "DependsOn", line_of(m.start()), **({"names": ",".join(names_of)} if names_of else {}))
        else:
            out.edge(root or path, m[1], "DependsOn", line_of(m.start(1)))
    if language == "go":
        for block in re.finditer(r"^import\s*(?:\((.*?)\)|[^\n]*)", text, re.M | re.S):
            for spec in re.findall(r'"([^"]+)"', block[0]):
                out.edge(root or path, spec, "DependsOn", line_of(block.start()))
    _bodies(out, text, masked, language, defs, functions, names, line_of, root or path)
    return out


def _doc_before(text: str, comments: list[tuple[int, int, str]], at: int) -> str | None:
    """The comments that end just before a definition, with only blanks, attributes and modifiers between."""
    parts: list[str] = []
    edge = at
    for b, e, t in reversed([c for c in comments if c[1] <= at]):
        if re.fullmatch(r"(?:\s|@\w+(?:\([^)]*\))?|\[[^\]]*\]|#\[[^\]]*\]|\b(?:export|public|private|protected|internal|static|abstract|async|pub|default|final|sealed|override|virtual)\b)*", text[e:edge]):
            parts.append(t)
            edge = b
            if t.startswith("/*"):
                break
        else:
            break
    return "\n".join(reversed(parts)) or None


def _nesting(body: str) -> int:
    depth = deepest = 0
    for c in re.findall(r"[{}]", body):
        depth += 1 if c == "{" else -1
        deepest = max(deepest, depth)
    return max(0, deepest - 1)


# What a call with a literal says; the first group is the literal
_HTTP = {
    "typescript": [(r"\bfetch\s*\(\s*[\"'`]([^\"'`]+)", "GET"), (r"\b(?:axios|http)\.(\w+)\s*(?:<[^(]*>)?\(\s*[\"'`]([^\"'`]+)", None)],
    "java": [(r"\bURI\.create\s*\(\s*\"([^\"]+)", "HTTP"), (r"\b(?:restTemplate|webClient)\.(get|post|put|delete|exchange)\w*\s*\(\s*\"([^\"]+)", None)],
    "go": [(r"\bhttp\.(Get|Post|Head|PostForm)\s*\(\s*\"([^\"]+)", None), (r"\bhttp\.NewRequest\s*\(\s*\"(\w+)\"\s*,\s*\"([^\"]+)", None)],
    "rust": [(r"\breqwest::get\s*\(\s*\"([^\"]+)", "GET"), (r"\.(get|post|put|delete|patch)\s*\(\s*\"(https?:[^\"]+)", None)],
    "php": [(r"\b(?:file_get_contents|curl_init)\s*\(\s*[\"'](https?:[^\"']+)", "GET"), (r"(?:Http::|->)(get|post|put|delete|patch)\s*\(\s*[\"'](https?:[^\"']+)", None)],
    "csharp": [(r"\.(Get|Post|Put|Delete|Patch)(?:String|Stream|FromJson|AsJson|ByteArray)?Async\s*(?:<[^(]*>)?\(\s*\$?\"([^\"]+)", None)],
}
_CONFIG = {
    "typescript": [(r"\bprocess\.env\.([A-Za-z_]\w*)", "env"), (r"\bprocess\.env\[\s*[\"']([^\"']+)", "env")],
    "java": [(r"\bSystem\.getenv\s*\(\s*\"([^\"]+)", "env"), (r"@Value\s*\(\s*\"\$\{([^}:\"]+)", "config"), (r"\bgetProperty\s*\(\s*\"([^\"]+)", "config")],
    "go": [(r"\bos\.(?:Getenv|LookupEnv)\s*\(\s*\"([^\"]+)", "env"), (r"\bviper\.Get\w*\s*\(\s*\"([^\"]+)", "config")],
    "rust": [(r"\benv::var\s*\(\s*\"([^\"]+)", "env"), (r"\benv!\s*\(\s*\"([^\"]+)", "env")],
    "php": [(r"\b(?:getenv|env)\s*\(\s*[\"']([^\"']+)", "env"), (r"\$_ENV\[\s*[\"']([^\"']+)", "env"), (r"\bconfig\s*\(\s*[\"']([^\"']+)", "config")],
    "csharp": [(r"\bEnvironment\.GetEnvironmentVariable\s*\(\s*\"([^\"]+)", "env"), (r"\b_?[cC]onfiguration\[\s*\"([^\"]+)", "config"), (r"\.(?:GetSection|GetValue<[^>]+>|GetConnectionString)\s*\(\s*\"([^\"]+)", "config")],
}
_EVENTS = [(r"\.(?:emit|publish|dispatch)\s*\(\s*[\"'`]([^\"'`]+)", "Publishes"), (r"\.(?:on|once|subscribe|addListener|addEventListener)\s*\(\s*[\"'`]([^\"'`]+)", "Subscribes")]


def _bodies(out: Parsed, text: str, masked: str, language: str, defs: list[_Definition], functions: list[_Definition], names: dict[str, list[str]], line_of, module: str) -> None:
    inner = sorted(functions, key=lambda d: d.begin)

    def around(at: int) -> str:
        best = None
        for d in inner:
            if d.begin > at:
                break
            if at < d.end:
                best = d
        return best.fqn if best else next((d.fqn for d in reversed(defs) if d.begin <= at < d.end and d.kind in _TYPES), module)

    tests, bodies = {s.fqn for s in out.symbols if s.test}, {d.fqn for d in functions}
    heads = {m.start() for d in defs for m in [re.compile(re.escape(d.name) + r"\s*(?:<[^(]*>)?\(").search(masked, d.begin)] if m}
    owner = {d.fqn: d.parent.fqn for d in functions if d.parent}
    for m in re.finditer(r"(?P<new>\bnew\s+\\?)?(?P<recv>(?:[\w$]+(?:\.|::|->|\?\.))*)(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[\w\s,.]*>)?\(", masked):
        name, at = m["name"], m.start("name")
        if name in _KEYWORDS or at in heads:
            continue
        if masked[m.start() - 1 : m.start()] in ("@", "["):
            continue
        caller = around(at)
        if caller == module and language != "typescript":
            continue
        if m["new"]:
            out.edge(caller, f"{m['recv']}{name}", "Creates", line_of(at))
            continue
        if caller != module and caller not in bodies:
            continue
        recv = re.sub(r"(\.|::|->|\?\.)$", "", m["recv"])
        if recv in ("this", "self", "Self", "$this", "base") and caller in owner:
            sep = "::" if language in ("rust", "php") else "."
            target = f"{owner[caller]}{sep}{name}"
        elif len(names.get(name, [])) == 1:
            target = names[name][0]
        else:
            target = f"{recv}.{name}" if recv and recv[:1].isupper() else name
        out.edge(caller, target, "TestCovers" if caller in tests and target not in tests else "Calls", line_of(at))
    for m in re.finditer(r"\bthrow\s+new\s+([\w.\\]+)", masked):
        out.edge(around(m.start()), m[1], "Throws", line_of(m.start()))
    for m in re.finditer(r"\bcatch\s*\(\s*(?:final\s+)?([\w.\\|\s]+?)(?:\s+\$?\w+)?\s*\)", masked):
        for t in m[1].split("|"):
            if re.match(r"[A-Z\\]", t.strip()):
                out.edge(around(m.start()), t.strip(), "Catches", line_of(m.start()))

    def literal(pattern: str) -> Iterator[re.Match]:
        """Matches in the text that begin outside comments and strings."""
        for m in re.finditer(pattern, text):
            if masked[m.start() : m.start() + 2].strip() == text[m.start() : m.start() + 2].strip():
                yield m

    for pattern, verb in _HTTP.get(language, []):
        for m in literal(pattern):
            v = verb or m[1].upper().removesuffix("FORM")
            out.edge(around(m.start()), f"http:{m[m.lastindex]}", "HttpCalls", line_of(m.start()), method=v)
    for pattern, scheme in _CONFIG.get(language, []):
        for m in literal(pattern):
            out.edge(around(m.start()), f"{scheme}:{m[1].replace('.', ':') if scheme == 'config' and language != 'php' else m[1]}", "ReadsConfig", line_of(m.start()))
    if language == "typescript":
        for pattern, kind in _EVENTS:
            for m in literal(pattern):
                out.edge(around(m.start()), f"event:{m[1]}", kind, line_of(m.start()))
        _typescript_routes(out, text, literal, around, line_of, defs)
    if language == "java":
        for m in literal(r"@(Service|Component|Repository|Controller|RestController|Configuration)\b"):
            d = next((d for d in defs if d.kind == "class" and d.end > m.start() and d.begin >= m.start() - 200 and d.body > m.start()), None)
            if d:
                _register(out, d.fqn, d.fqn, m[1], line_of(m.start()))
    if language == "csharp":
        _csharp_framework(out, text, masked, literal, around, line_of, defs)


def _register(out: Parsed, service: str, impl: str, lifetime: str, line: int) -> None:
    fqn = f"DI:{service}->{impl}"
    out.symbols.append(Symbol(fqn, service.rpartition(".")[2], "di_registration", line, line, lifetime))


def _join_route(a: str, b: str) -> str:
    return "/".join(x.strip("/") for x in (a, b) if x.strip("/"))


def _typescript_routes(out: Parsed, text: str, literal, around, line_of, defs: list[_Definition]) -> None:
    """Injectable classes, controllers with method decorators, and calls on an application or router."""
    for m in literal(r"@Injectable\s*\("):
        d = next((d for d in defs if d.kind == "class" and d.body > m.start()), None)
        if d:
            _register(out, d.fqn, d.fqn, "Singleton", line_of(m.start()))
    prefixes = [(m.start(), m[1] or "") for m in literal(r"@Controller\s*\(\s*(?:[\"'`]([^\"'`]*)[\"'`])?")]
    for m in literal(r"@(Get|Post|Put|Delete|Patch|Head|Options|All)\s*\(\s*(?:[\"'`]([^\"'`]*)[\"'`])?\s*\)"):
        prefix = next((p for at, p in reversed(prefixes) if at < m.start()), "")
        d = next((d for d in defs if d.kind == "member" and d.begin > m.start()), None)
        _endpoint(out, m[1].upper(), "/" + _join_route(prefix, m[2] or ""), d.fqn if d else around(m.start()), line_of(m.start()))
    for m in literal(r"\b(?:app|router|server|api)\.(get|post|put|delete|patch|all)\s*\(\s*[\"'`](/[^\"'`]*)[\"'`]\s*,\s*([\w.]*)"):
        _endpoint(out, m[1].upper(), m[2], m[3] or around(m.start()), line_of(m.start()))


def _csharp_framework(out: Parsed, text: str, masked: str, literal, around, line_of, defs: list[_Definition]) -> None:
    """X12 to X14, X17, X18, X22 for C#: registrations, mappings, routes, middleware order, contracts and events."""
    for m in literal(r"\.(?:Try)?Add(Scoped|Transient|Singleton|HostedService|HttpClient)\s*<\s*([\w.]+)\s*(?:,\s*([\w.]+)\s*)?>"):
        _register(out, m[2], m[3] or m[2], m[1], line_of(m.start()))
    order = []
    for m in literal(r"\.(Use[A-Z]\w*)\s*(?:<[^>]*>)?\("):
        fqn = f"middleware:{m[1]}"
        out.symbols.append(Symbol(fqn, m[1], "middleware", line_of(m.start()), line_of(m.start()), str(len(order) + 1)))
        order.append(fqn)
    for i, (a, b) in enumerate(zip(order, order[1:], strict=False)):
        out.edge(a, b, "PipelineOrder", None, order=str(i + 1))
    for d in defs:
        if d.kind == "class" and re.search(r"\bDbContext\b", d.impl):
            for m in re.finditer(r"\bDbSet<([\w.]+)>", masked[d.begin : d.end]):
                out.edge(d.fqn, m[1], "MapsTo", line_of(d.begin + m.start()))
        for m in re.finditer(r"\bIEntityTypeConfiguration<([\w.]+)>", d.impl if d.kind == "class" else ""):
            out.edge(d.fqn, m[1], "Configures", line_of(d.begin))
        for m in re.finditer(r"\b(?:IRequestHandler|INotificationHandler|IConsumer)<([\w.]+)", d.impl if d.kind == "class" else ""):
            out.edge(d.fqn, f"event:{m[1]}", "Subscribes", line_of(d.begin))
    for m in literal(r"\.(?:Publish|Send)\s*\(\s*new\s+(\w+)"):
        out.edge(around(m.start()), f"event:{m[1]}", "Publishes", line_of(m.start()))
    for m in literal(r"([\w.]+)\s*\+=\s*[\w.]+\s*;"):
        if re.match(r"[A-Z]", m[1].rpartition(".")[2]):
            out.edge(around(m.start()), f"event:{m[1].rpartition('.')[2]}", "Subscribes", line_of(m.start()))
    groups = {m[1]: m[2] for m in literal(r"\bvar\s+(\w+)\s*=\s*\w+\.MapGroup\s*\(\s*\"([^\"]*)\"")}
    for m in literal(r"\b(\w+)\.Map(Get|Post|Put|Delete|Patch)\s*\(\s*\"([^\"]*)\"\s*,\s*([\w.]*)"):
        _endpoint(out, m[2].upper(), _join_route(groups.get(m[1], ""), m[3]), m[4] if m[4] not in ("", "async") else around(m.start()), line_of(m.start()))
    for m in literal(r"\.MapHub\s*<\s*([\w.]+)\s*>\s*\(\s*\"([^\"]*)\""):
        _endpoint(out, "WS", m[2].lstrip("/"), m[1], line_of(m.start()))
    for d in defs:
        if d.kind != "class":
            continue
        before = text[max(0, d.begin - 400) : d.begin]
        route = re.findall(r"\[Route\s*\(\s*\"([^\"]*)\"", before)
        if not route and not d.name.endswith("Controller"):
            continue
        for f in defs:
            if f.parent is not d or f.kind != "member":
                continue
            verb = re.search(r"\[Http(Get|Post|Put|Delete|Patch)(?:\s*\(\s*\"([^\"]*)\")?[^\]]*\]\s*(?:\[[^\]]*\]\s*)*$", text[max(0, f.begin - 300) : f.begin])
            if verb:
                path = _join_route(route[-1] if route else "", verb[2] or "")
                path = re.sub(r"\[controller\]", d.name.removesuffix("Controller"), path, flags=re.I)
                path = re.sub(r"\[action\]", f.name, path, flags=re.I)
                _endpoint(out, verb[1].upper(), path, f.fqn, line_of(f.begin))
                fqn = f"API:{verb[1].upper()}:{path}"
                for t in re.findall(r"(?:\[FromBody\]\s*)?\b([A-Z]\w*(?:Dto|Request|Command|Query|Model))\s+\w+", f.head):
                    out.edge(fqn, t, "AcceptsDto", line_of(f.begin))
                inner = re.search(r"([A-Z]\w*(?:Dto|Response|Result|Model|View))>*\s*$", f.ret)
                if inner and inner[1] not in ("IActionResult", "ActionResult"):
                    out.edge(fqn, inner[1], "ReturnsDto", line_of(f.begin))


# ---- table functions ----


def parse(path: str, text: str) -> Parsed | None:
    """A file's symbols and edges; None for a language that is not known or a file that can't be read."""
    language = X.LANGUAGES.get("." + path.rpartition(".")[2].lower())
    if language is None:
        return None
    try:
        return parse_python(path, text) if language == "python" else parse_masked(path, text, language)
    except (SyntaxError, ValueError, RecursionError):
        return None


def extract(files: DataFrame) -> DataFrame:
    """The tagged rows (:data:`SCHEMA`) of files (path, content); null content and unreadable files give none. No shuffle."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pdfs:
            rows: list[tuple] = []
            for path, content in zip(p["path"], p["content"], strict=True):
                got = parse(path, content) if content else None
                if got:
                    rows += got.rows()
            out = pd.DataFrame(rows, columns=_COLUMNS)
            for c in ("start_line", "end_line", "complexity", "nesting"):
                out[c] = out[c].astype("Int32")
            yield out

    return files.select(X.slashes("path").alias("path"), "content").mapInPandas(run, SCHEMA)


def symbols_of(rows: DataFrame) -> DataFrame:
    return rows.where("part = 'symbol'").drop("part", "from_fqn", "to_fqn", "type", "metadata")


def edges_of(rows: DataFrame) -> DataFrame:
    return rows.where("part = 'edge'").select("path", "from_fqn", "to_fqn", "type", "metadata")


def resolve_imports(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """DependsOn edges with relative module specifiers pointed at known modules (column module, paths with extension).

    A specifier is joined to the directory of its file; the first that exists of
    itself, with an extension, or its index file counts. Others stay as they are.
    """
    probes = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")
    rel = edges.where((F.col("type") == "DependsOn") & F.col("to_fqn").startswith(".")).select("path", "to_fqn").distinct()
    base = X.normalize_path(F.concat(X.directory_of("path"), F.lit("/"), "to_fqn"))
    tried = rel.select("path", "to_fqn", base.alias("b"), F.posexplode(F.array(*[F.lit(p) for p in probes])).alias("k", "suffix"))
    tried = tried.select("path", "to_fqn", "k", F.concat("b", "suffix").alias("module"))
    hit = tried.join(modules.select("module").distinct(), "module").groupBy("path", "to_fqn").agg(F.min(F.struct("k", "module")).alias("m"))
    out = edges.join(hit, ["path", "to_fqn"], "left")
    return out.withColumn("to_fqn", F.when(F.col("type") == "DependsOn", F.coalesce("m.module", "to_fqn")).otherwise(F.col("to_fqn"))).select(*edges.columns)


def resolve_calls(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Bare callees resolved: a name of the same file first, then one that the file imports, then a name that exists once anywhere, else as it was.

    ``edges`` come from :func:`resolve_imports`; the names that a file imports
    stand in the metadata of its DependsOn edges, as name or name:local name.
    """
    funcs = symbols.where(F.col("kind").isin("function", "method")).select("path", "name", "fqn")
    local = funcs.groupBy("path", "name").agg(F.min("fqn").alias("_local"), F.count(F.lit(1)).alias("_nl")).where("_nl = 1").drop("_nl").withColumnRenamed("name", "to_fqn")
    unique = funcs.groupBy(F.col("name").alias("to_fqn")).agg(F.min("fqn").alias("_any"), F.count(F.lit(1)).alias("_na")).where("_na = 1").drop("_na")
    imported = edges.where((F.col("type") == "DependsOn") & F.col("metadata")["names"].isNotNull())
    imported = imported.select("path", F.col("to_fqn").alias("module"), F.explode(F.split(F.col("metadata")["names"], ",")).alias("n"))
    imported = imported.select("path", "module", F.split("n", ":")[0].alias("name"), F.element_at(F.split("n", ":"), -1).alias("to_fqn"))
    bound = imported.join(funcs.select(F.col("path").alias("module"), "name", "fqn"), ["module", "name"]).groupBy("path", "to_fqn").agg(F.min("fqn").alias("_bound"))
    bare = X.is_bare_name("to_fqn") & F.col("type").isin("Calls", "TestCovers")
    out = edges.join(local, ["path", "to_fqn"], "left").join(bound, ["path", "to_fqn"], "left").join(unique, "to_fqn", "left")
    return out.withColumn("to_fqn", F.when(bare, F.coalesce("_local", "_bound", "_any", "to_fqn")).otherwise(F.col("to_fqn"))).select(*edges.columns)
