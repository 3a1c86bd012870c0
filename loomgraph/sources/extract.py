"""Extraction: source files become symbols and relationships, file by file in Arrow batches.

Python is read with the standard library's parser, SQL and the other languages with
patterns of their own. New languages register a function (text, path) -> Extracted.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.schema import EXTERNAL, UNRESOLVED, is_test_path


@dataclass
class Extracted:
    """What one file holds."""

    language: str
    symbols: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    def symbol(self, path: str, qualified: str, kind: str, start: int, end: int, docstring: str | None = None, signature: str | None = None, decorators: list[str] | None = None) -> str:
        own = f"{path}::{qualified}"
        self.symbols.append({"id": own, "name": qualified.rsplit(".", 1)[-1], "qualified_name": qualified, "kind": kind, "start_line": start, "end_line": end, "docstring": docstring, "signature": signature, "decorators": decorators or []})
        return own

    def edge(self, source: str, target: str, kind: str, line: int) -> None:
        self.edges.append({"source_id": source, "target_id": target, "kind": kind, "start_line": line})


Extractor = Callable[[str, str], Extracted]
REGISTRY: dict[str, Extractor] = {}


def register(*extensions: str) -> Callable[[Extractor], Extractor]:
    def add(f: Extractor) -> Extractor:
        REGISTRY.update(dict.fromkeys(extensions, f))
        return f

    return add


@register(".py")
def python(text: str, path: str) -> Extracted:
    """Functions, methods (all that is nested), classes, imports and module constants; decorated classes too."""
    out = Extracted("python")
    module = f"{path}::module"

    def callee(node: ast.Call) -> str:
        return ast.unparse(node.func)

    def visit(body: list[ast.stmt], prefix: str, owner: str | None) -> None:
        for node in body:
            line, end = node.lineno - 1, (node.end_lineno or node.lineno) - 1
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                name = f"{prefix}{node.name}"
                returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
                decorators = [ast.unparse(d) for d in node.decorator_list]
                own = out.symbol(path, name, "method" if prefix else "function", line, end, ast.get_docstring(node, clean=False), f"def {node.name}({ast.unparse(node.args)}){returns}", decorators)
                for d in decorators:
                    out.edge(f"{UNRESOLVED}{d.split('(')[0]}", own, "decorates", line)
                for inner in ast.walk(node):
                    if isinstance(inner, ast.Call) and inner not in [d for d in node.decorator_list if isinstance(d, ast.Call)]:
                        out.edge(own, UNRESOLVED + callee(inner), "calls", inner.lineno - 1)
                visit(node.body, name + ".", own)
            elif isinstance(node, ast.ClassDef):
                name = f"{prefix}{node.name}"
                own = out.symbol(path, name, "class", line, end, ast.get_docstring(node, clean=False), None, [ast.unparse(d) for d in node.decorator_list])
                for b in node.bases:
                    out.edge(own, UNRESOLVED + ast.unparse(b), "inherits", line)
                visit(node.body, name + ".", own)
            elif isinstance(node, ast.Import | ast.ImportFrom):
                origin = (node.module or "") + "." if isinstance(node, ast.ImportFrom) else ""
                for a in node.names:
                    out.symbol(path, prefix + (a.asname or a.name), "import", line, end)
                    out.edge(module, f"{EXTERNAL}{origin}{a.name}", "imports", line)
            elif owner is None and isinstance(node, ast.Assign | ast.AnnAssign):
                for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(t, ast.Name) and t.id.isupper():
                        out.symbol(path, t.id, "constant", line, end)
            elif isinstance(node, ast.If | ast.Try):
                visit(node.body, prefix, owner)

    try:
        visit(ast.parse(text).body, "", None)
    except (SyntaxError, ValueError, RecursionError) as e:
        out.errors.append(str(e))
    return out


#: Schemas of catalogues, whose tables are not references.
CATALOGUES = frozenset({"information_schema", "pg_catalog", "sys", "mysql", "sqlite_master"})
_CREATE = re.compile(r"\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:materialized\s+)?(table|view|function|procedure)\s+(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)", re.I)
_FROM = re.compile(r"\b(?:from|join)\s+([\w.\"`\[\]]+)", re.I)
_COMMENT = re.compile(r"--[^\n]*|/\*.*?\*/", re.S)


def _bare(name: str) -> tuple[str, str]:
    parts = re.sub(r'["`\[\]]', "", name).split(".")
    return (parts[-2].lower() if len(parts) > 1 else ""), parts[-1]


@register(".sql")
def sql(text: str, path: str) -> Extracted:
    """Tables and views (classes), functions and procedures, and the tables that each reads, as calls within the file."""
    out = Extracted("sql")
    blank = _COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    found = list(_CREATE.finditer(blank))
    for m, after in zip(found, [*found[1:], None], strict=True):
        end = after.start() if after else len(blank)
        kind = "class" if m[1].lower() in ("table", "view") else "function"
        own = out.symbol(path, _bare(m[2])[1], kind, blank.count("\n", 0, m.start()), blank.count("\n", 0, max(m.start(), end - 1)), signature=" ".join(m[0].split()))
        if m[1].lower() == "table" and not re.search(r"\bas\b", blank[m.end() : end], re.I):
            continue
        for r in _FROM.finditer(blank, m.end(), end):
            schema, name = _bare(r[1])
            if schema not in CATALOGUES and name.lower() not in CATALOGUES:
                out.edge(own, f"{path}::{name}", "calls", blank.count("\n", 0, r.start()))
    return out


@dataclass(frozen=True)
class Grammar:
    """Patterns of a language: (kind, pattern with the group ``name``), how it imports, inherits, comments, and what is not a call."""

    language: str
    kinds: tuple[tuple[str, str], ...]
    imports: str = ""
    inherits: str = ""
    comment: str = r"//[^\n]*|/\*.*?\*/"
    block: str = "brace"
    skip: frozenset[str] = frozenset()
    call: str = r"(?<![\w.])([A-Za-z_][\w.]*)\s*\("
    inline: bool = False  # a call may stand on the line that begins its function


_WORDS = frozenset("if for while switch return catch function func fn def match sizeof new throw else elif until unless when case do super".split())
_CLASS = r"\bclass\s+(?P<name>[A-Za-z_]\w*)"
GRAMMARS: dict[str, Grammar] = {
    ".ts .tsx": Grammar("typescript", (("class", _CLASS), ("interface", r"\binterface\s+(?P<name>\w+)"), ("type_alias", r"\btype\s+(?P<name>\w+)\s*(?:<[^=]*>)?\s*="), ("enum", r"\benum\s+(?P<name>\w+)"), ("namespace", r"\bnamespace\s+(?P<name>\w+)"), ("function", r"\bfunction\s*\*?\s+(?P<name>\w+)"), ("function", r"\bconst\s+(?P<name>\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>"), ("method", r"^\s+(?:(?:public|private|protected|static|async|readonly)\s+)*(?P<name>[a-z_]\w*)\s*\([^;{}]*\)\s*(?::[^{;]+)?\{"), ("constant", r"^(?:export\s+)?const\s+(?P<name>[A-Z][A-Z0-9_]+)\b")), r"""\bimport\b[^'"\n]*['"]([^'"]+)['"]""", r"\bclass\s+(\w+)[^{]*?\bextends\s+([\w.]+)"),
    ".js .mjs .cjs .jsx": Grammar("javascript", (("class", _CLASS), ("function", r"\bfunction\s*\*?\s+(?P<name>\w+)"), ("function", r"\bconst\s+(?P<name>\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), ("method", r"^\s+(?:(?:static|async)\s+)*(?P<name>[a-z_]\w*)\s*\([^;{}]*\)\s*\{"), ("constant", r"^(?:export\s+)?const\s+(?P<name>[A-Z][A-Z0-9_]+)\b")), r"""(?:\bimport\b[^'"\n]*|\brequire\s*\(\s*)['"]([^'"]+)['"]""", r"\bclass\s+(\w+)\s+extends\s+([\w.]+)"),
    ".go": Grammar("go", (("module", r"^package\s+(?P<name>\w+)"), ("method", r"^func\s*\(\s*\w+\s+\*?(?P<owner>\w+)[^)]*\)\s*(?P<name>\w+)"), ("function", r"^func\s+(?P<name>\w+)"), ("class", r"^type\s+(?P<name>\w+)\s+struct\b"), ("interface", r"^type\s+(?P<name>\w+)\s+interface\b"), ("type_alias", r"^type\s+(?P<name>\w+)\s+(?!struct\b|interface\b)\S"), ("constant", r"^const\s+(?P<name>\w+)"), ("variable", r"^var\s+(?P<name>\w+)")), r'^(?:import\s+|\s+)(?:\w+\s+)?"([^"\n]+)"\s*$'),
    ".rs": Grammar("rust", (("module", r"\bmod\s+(?P<name>\w+)"), ("class", r"\bstruct\s+(?P<name>\w+)"), ("enum", r"\benum\s+(?P<name>\w+)"), ("interface", r"\btrait\s+(?P<name>\w+)"), ("type_alias", r"\btype\s+(?P<name>\w+)"), ("constant", r"\bconst\s+(?P<name>\w+)"), ("variable", r"\bstatic\s+(?:mut\s+)?(?P<name>\w+)"), ("function", r"\bfn\s+(?P<name>\w+)")), r"^\s*use\s+([\w:]+)", r"\bimpl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)"),
    ".java": Grammar("java", (("module", r"^package\s+(?P<name>[\w.]+)"), ("class", _CLASS), ("interface", r"\binterface\s+(?P<name>\w+)"), ("enum", r"\benum\s+(?P<name>\w+)"), ("method", r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*[\w<>\[\], ]+\s+(?P<name>\w+)\s*\([^;{}]*\)\s*(?:throws[^{]+)?\{"), ("constant", r"\bstatic\s+final\s+[\w<>\[\]]+\s+(?P<name>[A-Z_0-9]+)")), r"^import\s+(?:static\s+)?([\w.*]+)", r"\bclass\s+(\w+)[^{]*?\bextends\s+([\w.]+)"),
    ".cpp .cc .cxx .hpp .hxx .h": Grammar("cpp", (("namespace", r"\bnamespace\s+(?P<name>\w+)"), ("class", r"\b(?:class|struct)\s+(?P<name>\w+)\s*(?:final\s*)?[:{]"), ("enum", r"\benum\s+(?:class\s+)?(?P<name>\w+)"), ("type_alias", r"\busing\s+(?P<name>\w+)\s*="), ("function", r"^[\w:<>*&,\s]+?\b(?P<name>[A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{"), ("constant", r"\bconstexpr\s+\w+\s+(?P<name>\w+)")), r'^\s*#\s*include\s*[<"]([^>"]+)[>"]', r"\b(?:class|struct)\s+(\w+)[^{;]*?:\s*(?:public|private|protected)?\s*([\w:]+)"),
    ".c": Grammar("c", (("class", r"\b(?:struct|union)\s+(?P<name>\w+)\s*\{"), ("enum", r"\benum\s+(?P<name>\w+)\s*\{"), ("type_alias", r"\btypedef\b[^;{}]*\b(?P<name>\w+)\s*;"), ("function", r"^[\w*\s]+?\b(?P<name>[A-Za-z_]\w*)\s*\([^;{}]*\)\s*\{")), r'^\s*#\s*include\s*[<"]([^>"]+)[>"]', skip=frozenset("printf malloc free sizeof memcpy strlen".split())),
    ".cs": Grammar("csharp", (("namespace", r"\bnamespace\s+(?P<name>[\w.]+)"), ("class", r"\b(?:class|struct|record)\s+(?P<name>\w+)"), ("interface", r"\binterface\s+(?P<name>\w+)"), ("enum", r"\benum\s+(?P<name>\w+)"), ("method", r"^\s+(?:(?:public|private|protected|internal|static|async|override|virtual)\s+)+[\w<>\[\]?, ]+\s+(?P<name>\w+)\s*\([^;{}]*\)\s*\{"), ("constant", r"\bconst\s+\w+\s+(?P<name>\w+)")), r"^\s*using\s+([\w.]+)\s*;", r"\b(?:class|struct)\s+(\w+)\s*:\s*([\w.]+)"),
    ".rb": Grammar("ruby", (("module", r"\bmodule\s+(?P<name>\w+)"), ("class", r"\bclass\s+(?P<name>[A-Z]\w*)"), ("function", r"\bdef\s+(?:self\.)?(?P<name>\w+[?!]?)"), ("constant", r"^\s*(?P<name>[A-Z][A-Z0-9_]+)\s*=")), r"""\brequire(?:_relative)?\s+['"]([^'"]+)['"]""", r"\bclass\s+(\w+)\s*<\s*([\w:]+)", r"#[^\n]*", "end"),
    ".kt .kts": Grammar("kotlin", (("class", r"\b(?:class|object)\s+(?P<name>\w+)"), ("interface", r"\binterface\s+(?P<name>\w+)"), ("function", r"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(?P<name>\w+)"), ("constant", r"\bconst\s+val\s+(?P<name>\w+)"), ("variable", r"^va[lr]\s+(?P<name>\w+)")), r"^import\s+([\w.*]+)", r"\bclass\s+(\w+)[^{:]*:\s*(\w+)"),
    ".php": Grammar("php", (("interface", r"\binterface\s+(?P<name>\w+)"), ("class", r"\b(?:class|trait)\s+(?P<name>\w+)"), ("function", r"\bfunction\s+&?(?P<name>\w+)"), ("constant", r"\bconst\s+(?P<name>\w+)")), r"^\s*use\s+([\w\\]+)", r"\bclass\s+(\w+)\s+extends\s+([\w\\]+)"),
    ".scala .sc": Grammar("scala", (("interface", r"\btrait\s+(?P<name>\w+)"), ("class", r"\b(?:class|object)\s+(?P<name>\w+)"), ("function", r"\bdef\s+(?P<name>\w+)"), ("variable", r"^\s*va[lr]\s+(?P<name>\w+)")), r"^\s*import\s+([\w.{}, ]+)", r"\b(?:class|object)\s+(\w+)[^{]*?\bextends\s+(\w+)"),
    ".swift": Grammar("swift", (("class", r"\b(?:class|struct|actor)\s+(?P<name>\w+)"), ("enum", r"\benum\s+(?P<name>\w+)"), ("interface", r"\bprotocol\s+(?P<name>\w+)"), ("function", r"\bfunc\s+(?P<name>\w+)"), ("type_alias", r"\btypealias\s+(?P<name>\w+)")), r"^import\s+(\w+)", r"\b(?:class|struct)\s+(\w+)\s*:\s*(\w+)"),
    ".hs .lhs": Grammar("haskell", (("class", r"^(?:data|newtype)\s+(?P<name>\w+)"), ("type_alias", r"^type\s+(?P<name>\w+)"), ("interface", r"^class\s+(?:[^=]*=>\s*)?(?P<name>\w+)"), ("function", r"^(?P<name>[a-z]\w*)\s*::")), r"^import\s+(?:qualified\s+)?([\w.]+)", comment=r"--[^\n]*|\{-.*?-\}", block="name", call=r"(?<=[=(])\s*([a-z]\w*)(?=\s+\w)"),
    ".jl": Grammar("julia", (("module", r"\bmodule\s+(?P<name>\w+)"), ("class", r"\bstruct\s+(?P<name>\w+)"), ("interface", r"\babstract\s+type\s+(?P<name>\w+)"), ("function", r"\bfunction\s+(?P<name>[\w!]+)"), ("constant", r"\bconst\s+(?P<name>\w+)")), r"^\s*(?:using|import)\s+([\w.]+)", comment=r"#[^\n]*", block="end"),
    ".ml .mli": Grammar("ocaml", (("module", r"\bmodule\s+(?P<name>\w+)"), ("class", r"\b(?:class|type)\s+(?P<name>\w+)"), ("function", r"\blet\s+(?:rec\s+)?(?P<name>[a-z_]\w*)"), ("method", r"\bmethod\s+(?P<name>\w+)")), r"^open\s+([\w.]+)", comment=r"\(\*.*?\*\)", block="line", call=r"(?<=[=(])\s*([a-z_]\w*)(?=\s+\w)", inline=True),
    ".ex .exs": Grammar("elixir", (("module", r"\bdefmodule\s+(?P<name>[\w.]+)"), ("interface", r"\bdefprotocol\s+(?P<name>[\w.]+)"), ("function", r"\bdefp?\s+(?P<name>\w+[?!]?)")), r"^\s*(?:import|alias|use|require)\s+([\w.]+)", comment=r"#[^\n]*", block="end", skip=frozenset("def defp defmodule defprotocol".split())),
    ".lua": Grammar("lua", (("function", r"\bfunction\s+(?P<name>[\w.:]+)"), ("variable", r"^local\s+(?P<name>\w+)\s*=")), r"""\brequire\s*\(?\s*['"]([^'"]+)['"]""", comment=r"--[^\n]*", block="end"),
    ".sh .bash": Grammar("bash", (("function", r"^\s*(?:function\s+)?(?P<name>[A-Za-z_]\w*)\s*\(\)"), ("constant", r"^(?:readonly\s+|export\s+)?(?P<name>[A-Z][A-Z0-9_]+)=")), comment=r"#[^\n]*", skip=frozenset("echo cd exit export local set printf test".split()), call=r"^\s*([A-Za-z_]\w*)\b(?!\s*[=(])"),
    ".ps1 .psm1 .psd1": Grammar("powershell", (("class", r"^\s*class\s+(?P<name>\w+)"), ("function", r"^\s*function\s+(?P<name>[\w-]+)")), comment=r"#[^\n]*", skip=frozenset(("Write-Host", "Write-Output")), call=r"\b([A-Z][a-z]+-[A-Z]\w+)"),
    ".zig": Grammar("zig", (("function", r"\bfn\s+(?P<name>\w+)"), ("class", r"\bconst\s+(?P<name>\w+)\s*=\s*(?:packed\s+|extern\s+)?(?:struct|union|enum)\b"), ("constant", r"^(?:pub\s+)?const\s+(?P<name>\w+)\s*=\s*(?!.*@import)(?!\s*(?:struct|union|enum)\b)")), r'@import\("([^"]+)"\)'),
}


def _end_of(lines: list[str], start: int, block: str) -> int:
    """The last line of what begins at a line: by braces, by indentation of ``end``, or a line alone."""
    if block == "brace":
        depth, opened = 0, False
        for k in range(start, len(lines)):
            depth += lines[k].count("{") - lines[k].count("}")
            opened |= "{" in lines[k]
            if opened and depth <= 0 or not opened and lines[k].rstrip().endswith(";"):
                return k
        return start if not opened else len(lines) - 1
    indent = len(lines[start]) - len(lines[start].lstrip())
    if block == "end":
        for k in range(start + 1, len(lines)):
            if re.match(rf"\s{{0,{indent}}}(end|fi|done)\b", lines[k]):
                return k
        return start
    own = re.match(r"\w+", lines[start])
    for k in range(start + 1, len(lines)):
        if lines[k].strip() and not lines[k][0].isspace() and not (block == "name" and own and lines[k].startswith(own[0] + " ")):
            return k - 1
    return len(lines) - 1


def by_grammar(g: Grammar) -> Extractor:
    kinds = [(kind, re.compile(p, re.M)) for kind, p in g.kinds]
    imports, inherits = (re.compile(p, re.M) if p else None for p in (g.imports, g.inherits))
    comment, call = re.compile(g.comment, re.S), re.compile(g.call, re.M)

    def extract(text: str, path: str) -> Extracted:
        out = Extracted(g.language)
        blank = comment.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
        lines = blank.split("\n")
        found: dict[tuple[int, str], tuple[str, str | None]] = {}
        for kind, pattern in kinds:
            for m in pattern.finditer(blank):
                name = m["name"]
                if name not in _WORDS:
                    found.setdefault((blank.count("\n", 0, m.start("name")), name), (kind, m.groupdict().get("owner")))
        classes: list[tuple[int, int, str]] = []
        spans: list[tuple[int, int, str]] = []
        for (line, name), (kind, owner) in sorted(found.items()):
            end = line if kind in ("module", "constant", "variable", "type_alias") and g.block != "end" else _end_of(lines, line, g.block)
            inside = [c for c in classes if c[0] < line <= c[1]]
            owner = owner or (inside[-1][2] if inside and kind in ("function", "method", "constant") else None)
            kind = "method" if owner and kind == "function" else kind
            own = out.symbol(path, f"{owner}.{name}" if owner else name, kind, line, end, signature=lines[line].strip().rstrip("{").strip() if kind in ("function", "method") else None)
            if kind in ("class", "interface", "module", "enum"):
                classes.append((line, end, name))
            if kind in ("function", "method"):
                spans.append((line, end, own))
        if imports:
            for m in imports.finditer(blank):
                out.edge(f"{path}::module", EXTERNAL + m[1].strip(), "imports", blank.count("\n", 0, m.start()))
        if inherits:
            for m in inherits.finditer(blank):
                if m.lastindex and m.lastindex > 1:
                    kind = "implements" if g.language == "csharp" and re.match("I[A-Z]", m[2]) else "inherits"
                    out.edge(f"{path}::{m[1]}", UNRESOLVED + m[2], kind, blank.count("\n", 0, m.start()))
        for m in call.finditer(blank):
            line = blank.count("\n", 0, m.start())
            inside = [s for s in spans if s[0] < line <= s[1] or s[0] == line and (g.inline or line == s[1])]
            if inside and m[1] not in g.skip and m[1] not in _WORDS:
                out.edge(inside[-1][2], UNRESOLVED + m[1], "calls", line)
        return out

    return extract


for _extensions, _grammar in GRAMMARS.items():
    register(*_extensions.split())(by_grammar(_grammar))


@register(".svelte")
def svelte(text: str, path: str) -> Extracted:
    """A component named after its file, and its script as JavaScript."""
    out = Extracted("svelte")
    stem = path.rsplit("/", 1)[-1].removesuffix(".svelte")
    out.symbol(path, stem, "class", 0, text.count("\n"))
    m = re.search(r"<script[^>]*>(.*?)</script>", text, re.S)
    if m:
        shift = text.count("\n", 0, m.start(1))
        inner = REGISTRY[".js"](m[1], path)
        for s in inner.symbols:
            out.symbols.append(s | {"start_line": s["start_line"] + shift, "end_line": s["end_line"] + shift})
        out.edges += [e | {"start_line": e["start_line"] + shift} for e in inner.edges]
    return out


PARSED = (
    "path string, language string, content_hash string, size_bytes long, errors array<string>, "
    "symbols array<struct<id string, name string, qualified_name string, kind string, start_line int, end_line int, docstring string, signature string, decorators array<string>>>, "
    "edges array<struct<source_id string, target_id string, kind string, start_line int>>"
)


def parse(files: DataFrame) -> DataFrame:
    """One row for each file (path, text) of a known extension, with nested symbols and edges; a null text is empty."""
    extension = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    rows = files.where(extension.isin(*sorted(REGISTRY))).select("path", F.coalesce("text", F.lit("")).alias("text"), extension.alias("extension"))
    rows = rows.withColumns({"content_hash": F.sha2("text", 256), "size_bytes": F.octet_length("text").cast("long")})

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text, ext, digest, size in zip(batch["path"], batch["text"], batch["extension"], batch["content_hash"], batch["size_bytes"], strict=True):
                x = REGISTRY[ext](text, path)
                out.append((path, x.language, digest, size, x.errors, x.symbols, x.edges))
            yield pd.DataFrame(out, columns=["path", "language", "content_hash", "size_bytes", "errors", "symbols", "edges"])

    return rows.mapInPandas(run, PARSED)


def tables(parsed: DataFrame):  # noqa: ANN201
    """The graph tables of parsed files. Of symbols with one id the first in order of line counts."""
    from loomgraph.schema import GraphTables

    files = parsed.select("path", "language", "content_hash", F.size("symbols").cast("long").alias("symbol_count"), F.size("edges").cast("long").alias("relationship_count"), "size_bytes", is_test_path(F.col("path")).alias("is_test"))
    s = parsed.select("path", "language", F.explode("symbols").alias("s")).groupBy(F.col("s.id").alias("id")).agg(F.min_by(F.struct("path", "language", "s"), F.struct("s.start_line", "s.end_line")).alias("x"))
    symbols = s.select("id", "x.s.name", "x.s.qualified_name", "x.s.kind", F.col("x.path").alias("file_path"), "x.s.start_line", F.lit(0).alias("start_col"), "x.s.end_line", F.lit(0).alias("end_col"), "x.s.docstring", "x.s.signature", "x.s.decorators", "x.language", is_test_path(F.col("x.path")).alias("is_test"))
    e = parsed.select("path", F.explode("edges").alias("e"))
    known = F.lit("extracted")
    edges = e.select("e.source_id", "e.target_id", "e.kind", F.col("path").alias("file_path"), "e.start_line", known.alias("confidence"))
    return GraphTables(symbols, edges, files)
