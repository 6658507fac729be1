"""Functions, calls and receiver types of source files.

One file is one unit of work: texts go to Python in Arrow batches and come
back as rows. Python files are parsed by the standard parser; other languages
by scanners over a text whose comments and strings are blanked out, so braces
and keywords in them do not count.
"""

from __future__ import annotations

import ast
import bisect
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as columns

IDENT = r"[A-Za-z_][A-Za-z0-9_]*"
#: Words that look like a call and are none.
KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "function", "and", "or", "not", "elseif", "until", "else", "do", "in", "match", "fn", "func", "typeof", "await", "await", "super", "then", "local", "end", "new", "case", "defer", "go", "select", "loop", "unsafe", "move"}


@dataclass
class Function:
    name: str
    node_type: str
    start: int
    end: int
    container: str | None = None
    calls: list[tuple[str, int]] = field(default_factory=list)


class _Text:
    def __init__(self, text: str):
        self.text = text
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def point(self, at: int) -> tuple[int, int]:
        row = bisect.bisect_right(self.starts, at) - 1
        return row, at - self.starts[row]


#: Comments and strings by language.
_LUA = r"--\[\[.*?\]\]|--[^\n]*|\[\[.*?\]\]|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_C = r"/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
_RUST = r"/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'"


def mask(text: str, lang: str) -> str:
    """The text with comments and the insides of strings blanked, at equal length."""
    pattern = _LUA if lang == "lua" else _RUST if lang == "rust" else _C

    def blank(m: re.Match) -> str:
        s = m[0]
        inside = re.sub(r"[^\n]", " ", s)
        return s[0] + inside[1:-1] + s[-1] if s[0] in "\"'`" and len(s) > 1 else inside

    return re.sub(pattern, blank, text, flags=re.S)


def _close(text: str, at: int, open_: str = "{", close: str = "}") -> int:
    """The end of the bracket that opens at ``at``; the end of the text if none."""
    depth = 0
    for m in re.compile(f"[{re.escape(open_ + close)}]").finditer(text, at):
        depth += 1 if m[0] == open_ else -1
        if not depth:
            return m.end()
    return len(text)


def _body(text: str, at: int) -> int:
    """The end of the block whose brace is the first after ``at``."""
    brace = text.find("{", at)
    return _close(text, brace) if brace >= 0 else len(text)


# Lua.


_LUA_BLOCK = re.compile(r"\b(function|do|if|repeat|end|until)\b")


def _lua_end(text: str, at: int) -> int:
    depth = 0
    for m in _LUA_BLOCK.finditer(text, at):
        depth += 1 if m[0] in ("function", "do", "if", "repeat") else -1
        if not depth:
            return m.end()
    return len(text)


def _lua(text: str) -> list[Function]:
    out = []
    for m in re.finditer(rf"\b(?:local\s+)?function\s+({IDENT}(?:[.:]{IDENT})*)\s*\(", text):
        out.append(Function(m[1], "function_declaration", m.start(), _lua_end(text, text.index("function", m.start()))))
    for m in re.finditer(rf"(?<![A-Za-z0-9_.:])({IDENT}(?:\.{IDENT})*)\s*=\s*function\b", text):
        out.append(Function(m[1], "assignment_statement", m.start(), _lua_end(text, text.index("function", m.end(1)))))
    return out


# TypeScript and JavaScript.


def _script(text: str) -> list[Function]:
    out = []
    for m in re.finditer(rf"\b(?:async\s+)?function\s*\*?\s*({IDENT})\s*(?:<[^>(]*>)?\(", text):
        out.append(Function(m[1], "function_declaration", m.start(), _body(text, _close(text, m.end() - 1, "(", ")"))))
    for m in re.finditer(rf"\b(?:const|let|var)\s+({IDENT})\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:function\b|(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|{IDENT})\s*(?::[^=\n]+)?=>)", text):
        rest = text[m.end() :]
        brace = re.match(r"[^\n;]*?\{", rest) if not text[: m.end()].endswith("=>") else re.match(r"\s*\{", rest)
        if brace:
            end = _close(text, m.end() + brace.end() - 1)
        else:
            stop = re.search(r"[;\n]", rest)
            end = m.end() + (stop.start() if stop else len(rest))
        out.append(Function(m[1], "lexical_declaration", m.start(), end))
    for c in re.finditer(rf"\bclass\s+({IDENT})[^{{]*\{{", text):
        end, at = _close(text, c.end() - 1), c.end()
        method = re.compile(rf"(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*([#]?{IDENT})\s*(?:<[^>(]*>)?\(")
        while at < end:
            m = method.search(text, at, end)
            if not m:
                break
            close = _close(text, m.end() - 1, "(", ")")
            head = re.match(r"\s*(?::[^{;=]*(?:\{[^{}]*\}[^{;=]*)?)?\{", text[close:end])
            if head and m[1] not in KEYWORDS:
                stop = _close(text, close + head.end() - 1)
                out.append(Function(m[1], "method_definition", m.start(), stop, c[1]))
                at = stop
            else:
                at = m.end()
    return out


SCRIPT_IDENT = r"[A-Za-z_][A-Za-z0-9_$]*"
#: Line patterns of the fallback for scripts that yield no function.
FALLBACK = [re.compile(rf"^\s*{head}\s*\(") for head in (
    rf"export\s+async\s+function\s+({SCRIPT_IDENT})", rf"export\s+function\s+({SCRIPT_IDENT})", rf"async\s+function\s+({SCRIPT_IDENT})", rf"function\s+({SCRIPT_IDENT})",
    rf"export\s+const\s+({SCRIPT_IDENT})\s*=\s*async", rf"export\s+const\s+({SCRIPT_IDENT})\s*=", rf"const\s+({SCRIPT_IDENT})\s*=\s*async", rf"const\s+({SCRIPT_IDENT})\s*=",
    rf"let\s+({SCRIPT_IDENT})\s*=\s*async", rf"let\s+({SCRIPT_IDENT})\s*=", rf"var\s+({SCRIPT_IDENT})\s*=\s*async", rf"var\s+({SCRIPT_IDENT})\s*=",
)]
#: Rows after a declaration's own in which its brace is looked for.
FALLBACK_REACH = 81


def fallback_range(lines: list[str], row: int, column: int) -> tuple[int, int]:
    """(row, column) of the brace that closes a declaration's first; its own line if it has none."""
    first = next((r for r in range(row, min(len(lines), row + FALLBACK_REACH + 1)) if "{" in lines[r]), None)
    if first is None:
        return row, max(column + 1, len(lines[row]))
    depth = 0
    for r in range(first, len(lines)):
        for at in range(lines[r].index("{") if r == first else 0, len(lines[r])):
            depth += (lines[r][at] == "{") - (lines[r][at] == "}")
            if not depth and lines[r][at] == "}":
                return r, at + 1
            depth = max(depth, 0)
    return len(lines) - 1, len(lines[-1])


def _fallback(text: str) -> list[tuple[str, int, int, int, int]]:
    """(name, row, column, last row, last column) of each declaration; the column is the name's."""
    lines = text.split("\n")
    out = []
    for row, line in enumerate(lines):
        m = next((m for p in FALLBACK if (m := p.match(line))), None)
        if m:
            column = line.index(m[1])
            out.append((m[1], row, column, *fallback_range(lines, row, column)))
    return out


# Go and Rust.


def _go(text: str) -> list[Function]:
    out = []
    for m in re.finditer(rf"^func\s*(?:\(\s*([^)]*)\))?\s*({IDENT})\s*(?:\[[^\]]*\])?\(", text, re.M):
        box = None
        if m[1] is not None:
            r = re.match(rf"[A-Za-z0-9_]+\s+\*?({IDENT})", m[1].strip())
            box = r[1] if r else None
        kind = "method_declaration" if m[1] is not None else "function_declaration"
        out.append(Function(m[2], kind, m.start(), _body(text, _close(text, m.end() - 1, "(", ")")), box))
    return out


def _rust(text: str) -> list[Function]:
    impls = []
    for m in re.finditer(r"\bimpl\b[^{;]*\{", text):
        # The first word after ``impl`` names the container, of a trait implementation too.
        box = re.match(rf"impl\s+({IDENT})", m[0]) or re.match(rf"impl\s+.*?for\s+({IDENT})", m[0])
        impls.append((m.start(), _close(text, m.end() - 1), box[1] if box else None))
    out = []
    for m in re.finditer(rf"\b(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+({IDENT})\s*(?:<[^(]*>)?\(", text):
        close = _close(text, m.end() - 1, "(", ")")
        if not re.match(r"[^;{]*\{", text[close:]):
            continue
        box = next((b for a, z, b in reversed(impls) if a < m.start() < z and b), None)
        out.append(Function(m[1], "function_item", m.start(), _body(text, close), box))
    return out


_SCAN = {"lua": _lua, "typescript": _script, "javascript": _script, "go": _go, "rust": _rust}


#: Words after which a name with a bracket is a definition; the longest has eight letters.
_DEFINES = re.compile(r"\b(function|fn|func|class)$")


def _is_defined(text: str, at: int) -> bool:
    """Whether one of those words stands before ``at``; only blanks and that word are looked at."""
    while at and text[at - 1].isspace():
        at -= 1
    return _DEFINES.search(text[max(0, at - 9) : at]) is not None


def _chain_calls(text: str, masked: str, lang: str) -> list[tuple[str, int]]:
    """(text, position) of everything called, in order."""
    step = r"(?:\?\.|::|[.:])" if lang in ("lua", "rust", "typescript", "javascript") else r"\."
    opener = r"\s*(?:\(|\"|'|\{|\[\[)" if lang == "lua" else r"\s*(?:::<[^>()]*>)?\(" if lang == "rust" else r"\s*(?:<[A-Za-z_][^>()=;]*>)?\("
    out = []
    for m in re.finditer(rf"(?<![A-Za-z0-9_])({IDENT}(?:\s*{step}\s*{IDENT})*)(!)?{opener}", masked):
        name = m[1]
        head = re.split(r"[.:?]", name)[0].strip()
        if head in KEYWORDS and name == head:
            continue
        if m[2] and lang != "rust":
            continue
        if _is_defined(masked, m.start()):
            continue
        if lang == "lua" and m[0].rstrip()[-1] in "{" and not re.match(rf"{IDENT}(?:[.:]{IDENT})*$", name):
            continue
        out.append((re.sub(r"\s+", "", name), m.start()))
    return out


def _spans(lang: str, text: str) -> tuple[list[Function], str]:
    masked = mask(text, lang)
    found = sorted(_SCAN[lang](masked), key=lambda f: (f.start, -f.end))
    calls = _chain_calls(text, masked, lang)
    at = [c[1] for c in calls]
    # A method's own head looks like a call of its name.
    heads = set()
    for f in found:
        if f.node_type in ("method_definition", "method_declaration", "function_declaration", "function_item"):
            own = re.split("[.:]", f.name)[-1]
            stop = bisect.bisect_right(at, masked.find("(", f.start))
            heads.update(i for i in range(bisect.bisect_left(at, f.start), stop) if calls[i][0].split(".")[-1] == own)
    for f in found:
        f.calls = [calls[i] for i in range(bisect.bisect_left(at, f.start), bisect.bisect_left(at, f.end)) if i not in heads]
    return found, masked


# Python.


#: Lines of a file that are taken out in turn where the parser stops at them.
BROKEN_LINES = 50


def _parsed(text: str) -> ast.Module:
    """The tree of a file; a line that cannot be parsed counts as ``pass``, and what no tree comes of as empty."""
    lines = re.split(r"(?<=\n)", text)
    for _ in range(BROKEN_LINES):
        try:
            return ast.parse("".join(lines))
        except SyntaxError as e:
            # A block that is missing is missed at its header.
            header = re.search(r"expected an indented block after .* on line (\d+)", e.msg or "")
            row = min(max(1, int(header[1]) if header else e.lineno or 1), len(lines)) - 1
            while row >= 0 and not lines[row].strip():
                row -= 1
            if row < 0:
                break
            end = "\n" if lines[row].endswith("\n") else ""
            # A line becomes a statement; where that is wrong too, nothing.
            lines[row] = end if lines[row].strip() == "pass" else re.match(r"[ \t]*", lines[row])[0] + "pass" + end
        except ValueError:
            break
    return ast.Module(body=[], type_ignores=[])


def _python(text: str) -> list[tuple[Function, tuple[int, int, int, int]]]:
    tree, out = _parsed(text.replace("\r\n", " \n").replace("\r", " ")), []
    lines = [line.encode() for line in text.replace("\r\n", " \n").replace("\r", " ").split("\n")]

    def segment(node) -> str:
        a, z = node.lineno - 1, node.end_lineno - 1
        if a == z:
            raw = lines[a][node.col_offset : node.end_col_offset]
        else:
            raw = b"\n".join([lines[a][node.col_offset :], *lines[a + 1 : z], lines[z][: node.end_col_offset]])
        return re.sub(r"\s+", " ", raw.decode("utf-8", "replace")).strip()

    def visit(node, box):
        """Functions below ``node`` in order; returns the calls below it."""
        calls = []
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                f = Function(child.name, "function_definition", 0, 0, box)
                out.append((f, (child.lineno - 1, child.col_offset, child.end_lineno - 1, child.end_col_offset)))
                inside = visit(child, box)
                f.calls = [(s, row - 1) for row, _, s in sorted(inside, key=lambda c: c[:2])]
            else:
                inside = visit(child, child.name if isinstance(child, ast.ClassDef) else box)
            if isinstance(child, ast.Call):
                calls.append((child.func.lineno, child.func.col_offset, segment(child.func)))
            calls += inside
        return calls

    visit(tree, None)
    return out


#: Fixed values: (pattern, overwrite?) passes over a function's text, in order: variable and its type.
RECEIVER_PASSES = [
    (rf"({IDENT})\s*:\s*({IDENT})", True),
    (rf"const\s+({IDENT})\s*=\s*new\s+({IDENT})", True),
    (rf"let\s+({IDENT})\s*=\s*new\s+({IDENT})", True),
    (rf"var\s+({IDENT})\s*=\s*new\s+({IDENT})", True),
    (rf"local\s+({IDENT})\s*=\s*([A-Za-z_][A-Za-z0-9_.]*)\s*[:.]new\s*\(", True),
    (rf"local\s+({IDENT})\s*=\s*([A-Za-z_][A-Za-z0-9_.]*)\s*\(", False),
    (rf"({IDENT})\s*:\s*({IDENT})", False),
    (rf"({IDENT})\s*=\s*({IDENT})\s*\(", False),
    (rf"var\s+({IDENT})\s+\*?({IDENT})", True),
    (rf"({IDENT})\s*:?=\s*&?({IDENT})\s*\{{", True),
    (rf"let\s+({IDENT})\s*:\s*({IDENT})", True),
    (rf"let\s+({IDENT})\s*=\s*({IDENT})::", False),
]


def receiver_types(text: str, lang: str) -> dict[str, str]:
    text, out = re.sub(r"\s+", " ", text).strip(), {}
    for pattern, overwrite in RECEIVER_PASSES:
        for var, kind in re.findall(pattern, text):
            if overwrite or var not in out:
                out[var] = kind
    if lang == "python":
        out.setdefault("self", "self")
        out.setdefault("cls", "cls")
    return out


def extract(relpath: str, lang: str, text: str) -> list[dict]:
    """One record for each function of a file, in document order."""
    out = []

    def add(f: Function, span, calls, types):
        name, box = f.name, f.container
        short = name
        if not box:
            m = re.match(r"^(.*)(?:::|:|\.)([^.:]+)$", name)
            if m:
                box, short = m[1], m[2]
        full = f"{box}.{short}" if box else short
        kind = "Method" if f.node_type == "method_definition" else "Function"
        out.append({"symbol_id": f"{relpath}:{span[0] + 1}:{span[1] + 1}:{full}", "name": full, "short_name": short, "container": box, "symbol_kind": kind, "node_type": f.node_type, "lang": lang, "path": relpath, "relpath": relpath, "sr": span[0], "sc": span[1], "er": span[2], "ec": span[3], "calls": calls, "types": types})

    if lang == "python":
        lines = text.split("\n")
        for f, span in _python(text):
            add(f, span, f.calls, receiver_types("\n".join(lines[span[0] : span[2] + 1]), lang))
    elif lang in _SCAN:
        at = _Text(text)
        found, _ = _spans(lang, text)
        for f in found:
            span = (*at.point(f.start), *at.point(f.end))
            add(f, span, [(raw, at.point(p)[0]) for raw, p in f.calls], receiver_types(text[f.start : f.end], lang))
        if not found and lang in ("typescript", "javascript"):
            for name, row, column, last, end in _fallback(text):
                out.append({"symbol_id": f"{relpath}:{row + 1}:{column}:{name}", "name": name, "short_name": name, "container": None, "symbol_kind": "Function", "node_type": "fallback_function", "lang": lang, "path": relpath, "relpath": relpath, "sr": row, "sc": column, "er": last, "ec": end, "calls": [], "types": {}})
    return out


SCHEMA = "symbol_id string, name string, short_name string, container string, symbol_kind string, node_type string, lang string, path string, relpath string, sr int, sc int, er int, ec int, ord bigint, calls array<struct<raw:string,row:int>>, types map<string,string>"


#: Tasks that scan texts, for each core.
TASKS_A_CORE = 4
#: Functions that are sent back together.
ROWS_AT_ONCE = 5_000


def _extract_batches(batches):
    fields = [f.strip().split(" ")[0] for f in SCHEMA.split(", ")]
    rows = []
    for batch in batches:
        for relpath, lang, text in zip(batch["relpath"], batch["lang"], batch["content"]):
            for i, r in enumerate(extract(relpath, lang, text or "")):
                rows.append({**r, "ord": i, "calls": [{"raw": raw, "row": row} for raw, row in r["calls"]], "types": r["types"]})
                if len(rows) >= ROWS_AT_ONCE:
                    yield pd.DataFrame(rows, columns=fields)
                    rows = []
    yield pd.DataFrame(rows, columns=fields)


def extract_files(files: DataFrame) -> DataFrame:
    """Symbols with their calls and types; files (relpath, lang, content) are spread over tasks.

    A text takes far longer to scan than to move, so tasks are not left to the size of the texts.
    """
    tasks = TASKS_A_CORE * files.sparkSession.sparkContext.defaultParallelism
    return files.select("relpath", "lang", "content").repartition(tasks).mapInPandas(_extract_batches, SCHEMA)


def tables(extracted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """symbols, calls (src, call_ord, raw, row), receiver_types (symbol_id, var, type)."""
    symbols = extracted.drop("calls", "types").withColumn("module_id", columns.module_id(F.col("relpath"))).withColumn("package_id", columns.package_id(F.col("relpath"))).withColumn("sym_ord", F.struct("relpath", "ord"))
    calls = extracted.select(F.col("symbol_id").alias("src"), F.posexplode("calls").alias("call_ord", "c")).select("src", "call_ord", "c.raw", "c.row")
    types = extracted.select("symbol_id", F.explode("types").alias("var", "type"))
    return symbols, calls, types
