"""Structure of source files: functions, classes, imports, chunks (AST-*, IMP-1, CHK-1 to CHK-3, FN-1, FN-2, AGG-10, JOIN-9, JOIN-10).

Python is parsed by the standard library's ``ast`` in a pandas UDF. Text that it can't parse (Python 2 above all) and Ruby
get a reading by line patterns with extents by indentation. Languages with braces are read with comments and strings
blanked out: headers of functions and classes are found by pattern, their extents by matching brackets, and decisions,
calls, visibility and marks inside them.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules, schemas
from ..functions.text import barrier, lines, n_lines_parser, strip
from ..session import small_batches
from .language import parser_key

_DECISIONS = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.With, ast.BoolOp, ast.IfExp, ast.comprehension, ast.Assert, ast.AsyncFor, ast.AsyncWith, ast.Match)


def _import_class(module: str, language: str) -> str:
    if module.startswith("."):
        return "local"
    if module.split(".")[0] in rules.STDLIB.get(language, ()):
        return "stdlib"
    short = "." not in module and "-" not in module and module.islower() and len(module) < 30
    return "local" if short else "third_party"


def _io_types(text: str) -> list[str]:
    return [kind for kind, words in rules.IO_SIGNATURES.items() if any(w in text for w in words)]


def _function(name: str, start: int, end: int, source: list[str], **more: object) -> dict:
    text = "\n".join(source[start - 1 : end])
    calls = sorted(set(more.pop("calls", [])) - {name})
    kinds = _io_types(" ".join([*calls, text]))
    base = {"class": None, "complexity": 1, "is_public": not name.startswith("_"), "decorators": []}
    return {"name": name, "start_line": start, "end_line": end, "calls": calls, "has_io": bool(kinds), "io_types": kinds, "lines_of_code": end - start + 1} | base | more


def _import(module: str, line: int, raw: str, language: str, names: list[str] = (), alias: str | None = None) -> dict:
    return {"module": module, "alias": alias, "line": line, "import_type": _import_class(module, language), "names": list(names), "raw": raw.strip()[:120]}


def _class(name: str, start: int, end: int, methods: list[str], public: bool, decorators: list[str] = ()) -> dict:
    return {
        "name": name, "start_line": start, "end_line": end, "methods": methods, "method_count": len(methods), "is_public": public,
        "decorators": list(decorators), "lines_of_code": end - start + 1,
    }


def _parse_python(content: str) -> dict:
    tree, source = ast.parse(content), content.splitlines()
    functions, classes, imports = [], [], []
    count = sum(1 for _ in ast.walk(tree))

    def visit(node: ast.AST, owner: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inside = owner
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                calls = [t for c in ast.walk(child) if isinstance(c, ast.Call) and len(t := ast.unparse(c.func)) < 100]
                weight = 1 + sum(isinstance(x, _DECISIONS) for x in ast.walk(child))
                marks = [f"@{ast.unparse(d)}" for d in child.decorator_list]
                functions.append(_function(child.name, child.lineno, child.end_lineno, source, calls=calls, complexity=weight, decorators=marks, **{"class": owner}))
            elif isinstance(child, ast.ClassDef):
                inside = child.name
                classes.append((child.name, child.lineno, child.end_lineno, [f"@{ast.unparse(d)}" for d in child.decorator_list]))
            elif isinstance(child, ast.Import):
                # Of several modules in one statement the last is the statement's module.
                last = child.names[-1]
                imports.append(_import(last.name, child.lineno, source[child.lineno - 1], "python", [], last.asname))
            elif isinstance(child, ast.ImportFrom):
                imports.append(_import("." * child.level + (child.module or ""), child.lineno, source[child.lineno - 1], "python", [a.name for a in child.names]))
            visit(child, inside)

    visit(tree, None)
    methods = lambda c: [f["name"] for f in functions if f["class"] == c]
    shown = [_class(n, a, b, methods(n), not n.startswith("_"), d) for n, a, b, d in classes]
    return {"functions": functions, "classes": shown, "imports": imports, "has_parse_errors": False, "error_node_count": 0, "raw_ast_node_count": count, "fallback_mode": False}


_PATTERNS = {
    "python": (r"^(\s*)(?:async\s+)?def\s+(\w+)", r"^(\s*)class\s+(\w+)", r"^\s*(?:import\s+([\w.]+)|from\s+([\w.]+)\s+import)"),
    "ruby": (r"^(\s*)def\s+(?:self\.)?([\w.?!]+)", r"^(\s*)(?:class|module)\s+(\w+)", r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]"),
}
_CALL = re.compile(r"(?<![\w$.])(?<!function )(?<!func )(?<!fun )(?<!def )(?<!fn )([A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*)\s*\(")
_BRANCH = re.compile(r"\b(?:if|elif|for|while|case|catch|except|switch)\b|&&|\|\||\?")
_NO_CALL = {"if", "for", "while", "switch", "catch", "return", "function", "def", "class", "print", "elif", "except", "func", "fn", "fun", "foreach", "match", "when", "sizeof", "async", "new", "throw", "using", "lock", "fixed", "guard", "else", "do", "try", "with", "await", "and", "or", "not", "unless", "until"}

_MODIFIERS = r"(?P<mods>(?:(?:public|private|protected|internal|static|final|abstract|sealed|override|virtual|async|synchronized|native|default|strictfp|extern|unsafe|partial|readonly|new)\s+)*)"
_JS_METHOD = r"^[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)\s+)*\*?\s*(?P<name>#?[\w$]+)\s*(?:<[^>{}()]*>)?\s*(?=\()"
_JS = (
    (r"\bfunction\s*\*?\s*(?P<name>[\w$]+)\s*(?:<[^>{}()]*>)?\s*(?=\()", "nested"),
    (r"\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n;]+)?=\s*(?:async\s+)?(?:function\b\s*\*?\s*[\w$]*\s*(?=\()|(?=\([^;{}]*?\)\s*(?::[^={}\n;]+)?=>)|(?=[\w$]+\s*=>))", "any"),
    (_JS_METHOD, "member body"),
    (r"^[ \t]*(?:(?:public|private|protected|static|readonly)\s+)*(?P<name>#?[\w$]+)\s*=\s*(?:async\s+)?(?:(?=\([^;{}]*?\)\s*=>)|(?=[\w$]+\s*=>))", "member"),
)
_JAVA = (
    (rf"^[ \t]*(?:@\w+(?:\([^()]*\))?\s+)*{_MODIFIERS}(?:<[^>{{}}]*>\s*)?(?P<type>[\w.]+(?:<[^(){{}};=]*>)?(?:\[\])*\??)\s+(?P<name>\w+)\s*(?:<[^>{{}}()]*>)?\s*(?=\()", "typed"),
    (rf"^[ \t]*(?:@\w+(?:\([^()]*\))?\s+)*{_MODIFIERS}(?P<name>\w+)\s*(?=\()", "constructor"),
)
#: By language: headers of functions (pattern, what it asks for), of classes, and imports.
_BRACES = {
    "javascript": (_JS, r"\bclass\s+(?P<name>[\w$]+)", r"\bimport\s+(?P<what>[^;'\"()]*?)\s*from\s*(?P<q>['\"])(?P<module>[^'\"\n]+)['\"]|\bimport\s*['\"](?P<bare>[^'\"\n]+)['\"]|\brequire\s*\(\s*['\"](?P<required>[^'\"\n]+)['\"]"),
    "java": (_JAVA, r"(?:\b(?:class|interface|enum|record)|@interface)\s+(?P<name>\w+)", r"^\s*import\s+(?:static\s+)?(?P<module>\w+(?:\.\w+)*(?:\.\*)?)"),
    "c_sharp": (_JAVA, r"\b(?:class|interface|struct|enum|record)\s+(?P<name>\w+)", r"^\s*using\s+(?:static\s+)?(?:(?P<alias>\w+)\s*=\s*)?(?P<module>[\w.]+)\s*;"),
    "go": (((r"^func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?(?=\()", "any"),), r"^\s*type\s+(?P<name>\w+)\s+\w+", r"^\s*(?:import\s+)?(?:(?P<alias>[\w.]+)\s+)?\"(?P<module>[\w./-]+)\"\s*$"),
    "rust": (((r"\bfn\s+(?P<name>\w+)\s*(?:<[^(){}]*>)?\s*(?=\()", "any"),), r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(?:(?:struct|enum|trait)\s+(?P<name>\w+)|impl(?:<[^{}]*?>)?\s+(?:[\w:<>, ]+?\s+for\s+)?(?P<of>\w+))", r"^\s*(?:pub\s+)?use\s+(?P<module>[\w:]+?)(?:::\{(?P<what>[^}]*)\})?(?:\s+as\s+(?P<alias>\w+))?\s*;|^\s*extern\s+crate\s+(?P<bare>\w+)"),
    "c": (((r"^[ \t]*(?P<type>(?:[A-Za-z_][\w]*[\s*&]+)+)(?P<name>\w+)\s*(?=\()", "body"),), r"\b(?:struct|union|enum)\s+(?P<name>\w+)\s*(?=\{)", r"^\s*#\s*include\s*[<\"](?P<module>[^>\"\n]+)[>\"]"),
    "cpp": (((r"^[ \t]*(?P<type>(?:[A-Za-z_][\w:]*(?:<[^(){};]*>)?[\s*&]+)*)(?P<name>(?:\w+::)*~?\w+|(?:\w+::)*operator\s*[^\s\w(]{1,3})\s*(?=\()", "owned body"),), r"\b(?:class|struct|namespace)\s+(?P<name>\w+)(?=[^;(){}=]*\{)", r"^\s*#\s*include\s*[<\"](?P<module>[^>\"\n]+)[>\"]|^\s*using\s+(?:namespace\s+)?(?P<bare>[\w:]+)\s*;"),
    "kotlin": (((r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w<>?, ]+\.)?(?P<name>\w+)\s*(?=\()", "any"),), r"\b(?:class|interface|object)\s+(?P<name>\w+)", r"^\s*import\s+(?P<module>[\w.]+(?:\.\*)?)(?:\s+as\s+(?P<alias>\w+))?"),
    "swift": (((r"\bfunc\s+(?P<name>\w+)\s*(?:<[^>]*>)?\s*(?=\()", "any"), (r"\b(?P<name>init)\??\s*(?=\()", "member body")), r"\b(?:class|struct|enum|protocol|extension|actor)\s+(?P<name>\w+)(?=[^;(){}=]*\{)", r"^[ \t]*import[ \t]+(?:\w+[ \t]+)?(?P<module>[\w.]+)"),
    "scala": (((r"\bdef\s+(?P<name>[\w$]+)", "any"),), r"\b(?:class|object|trait)\s+(?P<name>\w+)", r"^\s*import\s+(?P<module>[\w.]+?)(?:\.\{(?P<what>[^}]*)\})?\s*$"),
    "php": (((r"\bfunction\s+&?\s*(?P<name>\w+)\s*(?=\()", "any"),), r"^\s*(?:(?:abstract|final|readonly)\s+)*(?:class|interface|trait|enum)\s+(?P<name>\w+)", r"^\s*use\s+(?P<module>[\w\\]+)(?:\s+as\s+(?P<alias>\w+))?\s*;|\b(?:require|include)(?:_once)?\s*\(?\s*['\"](?P<bare>[^'\"\n]+)['\"]"),
}
_BRACES["typescript"] = _BRACES["javascript"]
#: Words before a bracket that aren't the name of a function.
_NO_NAME = {"if", "for", "while", "switch", "catch", "return", "function", "else", "do", "try", "sizeof", "foreach", "elif", "await", "throw", "typeof", "synchronized", "when"}
#: What begins a header's line but is no type: such a match is a statement.
_NO_TYPE = {"return", "new", "throw", "else", "await", "yield", "case", "goto", "delete", "using", "import", "package", "typeof", "in", "is", "not", "namespace"}
_OPEN_TO_ALL = {"rust", "kotlin", "swift", "scala", "php"}


def _pattern(words: str, more: str = "") -> re.Pattern:
    return re.compile(rf"\b(?:{'|'.join(words.split())})\b{more}")


_TERNARY = r"|\?(?![.?:\]>,)=])"
_C_LIKE = "if else for while do case"
#: Decisions by language, one each.
_DECIDES = {
    "javascript": _pattern(f"{_C_LIKE} catch", _TERNARY), "typescript": _pattern("if for while catch", _TERNARY), "java": _pattern(f"{_C_LIKE} catch default", _TERNARY),
    "go": _pattern("if else for range select"), "rust": _pattern("if else match for while loop", "|=>"), "c": _pattern(_C_LIKE, _TERNARY), "cpp": _pattern(f"{_C_LIKE} try catch", _TERNARY),
    "c_sharp": _pattern(f"{_C_LIKE} foreach catch", _TERNARY), "kotlin": _pattern("if else for while do catch", "|->"), "swift": _pattern("if else for while guard case catch"),
    "scala": _pattern("if else for while do case catch"), "php": _pattern("if else elseif for foreach while do case catch", _TERNARY),
}
_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_BLANK_HASH = re.compile(_BLANK.pattern + r"|\#(?!\[)[^\n]*", re.S)
#: In Rust an apostrophe mostly begins a lifetime.
_BLANK_RUST = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.[^']*|[^'\\\n])'", re.S)


def _blanked(content: str, language: str) -> str:
    """The text with comments and strings as spaces, line by line as long as before."""
    pattern = _BLANK_RUST if language == "rust" else _BLANK_HASH if language == "php" else _BLANK
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), content)


def _brackets(code: str) -> dict[int, int]:
    """Where each opening round or curly bracket closes."""
    out, held = {}, {"(": [], "{": []}
    for m in re.finditer(r"[(){}]", code):
        c = m.group()
        if c in held:
            held[c].append(m.start())
        elif held["(" if c == ")" else "{"]:
            out[held["(" if c == ")" else "{"].pop()] = m.start()
    return out


def _body(code: str, closes: dict[int, int], at: int) -> tuple[int, bool]:
    """The last place of what a header that ends at ``at`` begins, and whether it is a body in braces."""
    if at < len(code) and code[at] == "(":
        at = closes.get(at, at) + 1
    stop = re.compile(r"[{;}]|=(?!=)").search(code, at)
    if stop and stop.group() == "{":
        return closes.get(stop.start(), len(code) - 1), True
    if stop and stop.group() == "=":
        # An expression, of which a body in braces may be a part.
        line = code.find("\n", stop.end())
        line = len(code) if line < 0 else line
        brace = code.find("{", stop.end(), line)
        return (closes.get(brace, line - 1), False) if brace >= 0 else (line - 1, False)
    return (stop.start() if stop and stop.group() == ";" else max(at - 1, 0)), False


def _marks(source: list[str], line: int) -> list[str]:
    """Annotations and attributes on the lines right above."""
    k = line - 2
    while k >= 0 and re.match(r"\s*(?:@\w|#\[|\[\w)", source[k]):
        k -= 1
    return [x.strip() for x in source[k + 1 : line - 1]]


def _parse_braces(content: str, language: str) -> dict:
    functions_of, class_of, import_of = _BRACES[language]
    code, source = _blanked(content, language), content.splitlines()
    closes = _brackets(code)
    line = lambda at: content.count("\n", 0, at) + 1
    classes = []
    for m in re.finditer(class_of, code, re.M):
        stop = re.compile(r"[{;}]|\n\s*\n").search(code, m.end())
        end = closes.get(stop.start(), len(code) - 1) if stop and stop.group() == "{" else m.end()
        name = m["name"] or m.groupdict().get("of")
        classes.append((name, m.start(), end, m.group().strip()))
    found: dict[int, tuple] = {}
    for pattern, asks in functions_of:
        for m in re.finditer(pattern, code, re.M):
            at, name = m.start("name"), m["name"]
            head, groups = name.rpartition("::")[2], m.groupdict()
            if at in found or head in _NO_NAME or (groups.get("type") or "").split(" ")[0].strip("*& ") in _NO_TYPE:
                continue
            owner = next((c for c, a, b, _ in reversed(classes) if a < at <= b), None)
            end, braces = _body(code, closes, m.end())
            if "body" in asks and not braces or "member" in asks and owner is None or asks == "constructor" and (name != owner or not braces):
                continue
            if asks == "typed" and (not braces and owner is None or re.fullmatch(_MODIFIERS, f"{groups['type']} ")):
                continue
            if "owned" in asks and not (groups.get("type") or "").strip() and "::" not in name and owner != head.lstrip("~"):
                continue
            found[at] = (name, end, owner or (name.rpartition("::")[0] or None), groups.get("mods") or "", asks)
    functions, spans = [], []
    for at, (name, end, owner, mods, asks) in sorted(found.items()):
        inside = next(((a, b) for a, b in reversed(spans) if a < at <= b), None)
        within = inside and not any(inside[0] < a < at <= b for _, a, b, _ in classes)
        # Functions inside functions count only where a name is given to them, and local ones of some languages.
        if within and (asks in ("nested", "member", "member body", "typed") and language != "c_sharp"):
            continue
        spans.append((at, end))
        body = code[at : end + 1]
        start, last = line(at), line(min(end, max(len(content) - 1, 0)))
        public = name[:1].isupper() if language == "go" else "public" in mods.split() if language in ("java", "c_sharp") else True if language in _OPEN_TO_ALL else not name.rpartition("::")[2].startswith(("_", "#"))
        calls = [c for c in _CALL.findall(body) if c not in _NO_CALL and c != name and len(c) < 100]
        whole = 1 + len(_DECIDES[language].findall(body)) - len(re.findall(r"\}\s*while\b", body)) * ("do" in _DECIDES[language].pattern)
        functions.append(_function(name, start, last, source, calls=calls, complexity=max(whole, 1), is_public=public, decorators=_marks(source, start), **{"class": owner}))
    imports = []
    for m in re.finditer(import_of, content, re.M):
        g = m.groupdict()
        module = next((g[k] for k in ("module", "bare", "required") if g.get(k)), None)
        # Not inside a comment or string: there the first letter is blanked out.
        first = m.start() + len(m.group()) - len(m.group().lstrip())
        if module and (not code[first].isspace() or language == "go" and content[first] == '"'):
            what = g.get("what") or ""
            alias = g.get("alias") or (x[1] if (x := re.search(r"\*\s+as\s+([\w$]+)", what)) else None)
            names = [x for x in re.findall(r"(?<!as )[\w$]+", re.sub(r"\s+as\s+[\w$]+", "", what)) if x != "type"]
            imports.append(_import(module, line(first), m.group(), language, names, alias))
    shown = []
    for name, a, end, header in classes:
        methods = [f["name"] for f in functions if f["class"] == name]
        text = source[line(a) - 1] if source else ""
        public = "public" in text if language in ("java", "c_sharp") else not name.startswith("_")
        shown.append(_class(name, line(a if code[a] != "\n" else a + 1), line(min(end, max(len(content) - 1, 0))), methods, public, _marks(source, line(a))))
    return {"functions": functions, "classes": shown, "imports": imports, "has_parse_errors": False, "error_node_count": 0, "raw_ast_node_count": 0, "fallback_mode": True}


def _extent(source: list[str], at: int, indent: int, by_indent: bool) -> int:
    """Last line of a block that begins at line ``at`` (from 0)."""
    if by_indent:
        end = at
        for k in range(at + 1, len(source)):
            if source[k].strip():
                if len(source[k]) - len(source[k].lstrip()) <= indent:
                    break
                end = k
        return end + 1
    depth, opened = 0, False
    for k in range(at, len(source)):
        depth += source[k].count("{") - source[k].count("}")
        opened |= "{" in source[k]
        if opened and depth <= 0:
            return k + 1
    return len(source) if opened else at + 1


def _parse_lines(content: str, language: str, errors: bool) -> dict:
    known = _PATTERNS.get(language)
    empty = {"functions": [], "classes": [], "imports": [], "has_parse_errors": errors, "error_node_count": int(errors), "raw_ast_node_count": 0, "fallback_mode": True}
    if known is None:
        return empty
    source, (fn, cls, imp) = content.splitlines(), map(re.compile, known)
    flat = language in ("python", "ruby")
    classes = [(m[2], k + 1, _extent(source, k, len(m[1]), flat)) for k, line in enumerate(source) if (m := cls.search(line))]
    functions, imports = [], []
    for k, line in enumerate(source):
        if m := fn.search(line):
            name = next(g for g in m.groups()[1:] if g)
            end = _extent(source, k, len(m[1]), flat)
            body = "\n".join(source[k:end])
            owner = next((c for c, a, b in reversed(classes) if a <= k + 1 <= b), None)
            public = not name.startswith("_")
            calls = [c for c in _CALL.findall(body) if c not in _NO_CALL and len(c) < 100]
            functions.append(_function(name, k + 1, end, source, calls=calls, complexity=1 + len(_BRANCH.findall(body)), is_public=public, **{"class": owner}))
        for m in imp.finditer(line):
            module = next((g for g in m.groups() if g), "")
            names = re.findall(r"\w+", line.partition("import")[2]) if line.lstrip().startswith("from ") else []
            imports.append(_import(module, k + 1, line, language, names))
    shown = [_class(n, a, b, [f["name"] for f in functions if f["class"] == n], not n.startswith("_")) for n, a, b in classes]
    return empty | {"functions": functions, "classes": shown, "imports": imports}


def parse_source(content: str | None, language: str | None) -> dict:
    """The parse record of one file; never raises."""
    if not content or not content.strip():
        return _parse_lines("", "", False) | {"fallback_mode": False}
    if language == "python":
        try:
            return _parse_python(content)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return _parse_lines(content, language, True)
    if language in _BRACES:
        return _parse_braces(content, language)
    return _parse_lines(content, language or "", False)


def _parse_batch(content: pd.Series, language: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_source(c, k) for c, k in zip(content, language, strict=True)], columns=["functions", "classes", "imports", "has_parse_errors", "error_node_count", "raw_ast_node_count", "fallback_mode"])


def parse(files: DataFrame, content: str = "content", language: str = "language") -> DataFrame:
    """``files`` with ``ast`` and ``file_metrics`` (AST-1 to AST-8, AGG-10)."""
    small_batches(files.sparkSession)
    out = files.withColumn("ast", barrier(F.pandas_udf(_parse_batch, schemas.PARSED))(F.col(content), parser_key(F.col(language))))
    return out.withColumn("file_metrics", metrics(F.col("ast"), F.col(content)))


def metrics(parsed: Column, content: Column) -> Column:
    """Counts and complexity of a file; the first of equal maxima counts (AGG-10)."""
    fs = parsed["functions"]
    top = F.aggregate(fs, F.lit(None).cast("struct<n:string,c:int>"), lambda a, f: F.when(a.isNull() | (f["complexity"] > a["c"]), F.struct(f["name"].alias("n"), f["complexity"].alias("c"))).otherwise(a))
    average = F.when(F.size(fs) > 0, F.round(F.aggregate(fs, F.lit(0.0), lambda a, f: a + f["complexity"]) / F.size(fs), 2)).otherwise(0.0)
    return F.struct(
        n_lines_parser(content).alias("total_lines"), F.size(fs).alias("function_count"), F.size(parsed["classes"]).alias("class_count"),
        F.size(parsed["imports"]).alias("import_count"), average.alias("avg_complexity"), F.coalesce(top["c"], F.lit(0)).alias("max_complexity"),
        top["n"].alias("max_complexity_function"), parsed["has_parse_errors"].alias("has_parse_errors"),
        parsed["error_node_count"].alias("error_node_count"), parsed["raw_ast_node_count"].alias("raw_ast_node_count"),
    )


def call_map(parsed: Column) -> Column:
    """Calls by function name, the last of one name counts (map of the call graph)."""
    fs = parsed["functions"]
    latest = F.filter(fs, lambda f, i: ~F.exists(F.slice(fs, i + 2, F.size(fs)), lambda g: g["name"] == f["name"]))
    return F.map_from_entries(F.transform(latest, lambda f: F.struct(f["name"], f["calls"])))


def with_radon(functions: DataFrame, measured: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Functions with a tool's complexity and rank from ``measured(*keys, ord, name, complexity, rank)``, the last of one name in a file (JOIN-9).

    Both are rows: measures are one a file and name before the join, so a file may have any number of functions.
    """
    last = measured.groupBy(*keys, "name").agg(F.max_by(F.struct("complexity", "rank"), "ord").alias("_last"))
    both = functions.join(last, [*keys, "name"], "left")
    return both.select(*functions.columns, F.col("_last.complexity").alias("radon_complexity"), F.col("_last.rank").alias("radon_rank"))


def methods_of(functions: DataFrame, name: str) -> DataFrame:
    """The functions that are methods of a class (JOIN-10)."""
    return functions.where(F.col("class") == name)


def line_chunks(code_lines: DataFrame, key: str = "file_id", size: int = rules.CHUNK_LINES) -> DataFrame:
    """Fixed chunks of lines with their offset (CHK-1)."""
    chunk = F.floor((F.col("line_no") - 1) / size)
    by = code_lines.groupBy(key, chunk.alias("chunk_index")).agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count(F.lit(1)).alias("n"))
    return by.withColumn("line_offset", F.col("chunk_index") * size)


def reader_chunks(content: Column, functions: Column, size: int = rules.CHUNK_LINES) -> Column:
    """Functions packed greedily into chunks: array of (start_line, code), lines outside functions are left out (CHK-2)."""
    rows = lines(content)
    fs = F.array_sort(functions, lambda a, b: F.when(a["start_line"] < b["start_line"], -1).when(a["start_line"] > b["start_line"], 1).otherwise(0))
    none = F.array().cast("array<struct<start_line:int,code:string>>")
    first = F.struct(F.lit(1).alias("start"), F.array().cast("array<string>").alias("held"), none.alias("done"))
    closed = lambda a: F.array_append(a["done"], F.struct(a["start"].alias("start_line"), F.array_join(a["held"], "\n").alias("code")))

    def step(a: Column, f: Column) -> Column:
        own = F.slice(rows, f["start_line"], F.greatest(f["end_line"] - f["start_line"] + 1, F.lit(0)))
        full = (F.size(a["held"]) + F.size(own) > size) & (F.size(a["held"]) > 0)
        fresh = F.struct(f["start_line"].alias("start"), own.alias("held"), closed(a).alias("done"))
        grown = F.struct(a["start"].alias("start"), F.concat(a["held"], own).alias("held"), a["done"].alias("done"))
        return F.when(full, fresh).otherwise(grown)

    return F.aggregate(fs, first, step, lambda a: F.when(F.size(a["held"]) > 0, closed(a)).otherwise(a["done"]))


def parser_chunks(content: Column, functions: Column, size: int = rules.CHUNK_LINES) -> Column:
    """Chunks that cover the file, cut before the function that would pass the limit: array of (start_line, end_line) (CHK-3)."""
    n = F.size(lines(content))
    fs = F.array_sort(functions, lambda a, b: F.when(a["start_line"] < b["start_line"], -1).when(a["start_line"] > b["start_line"], 1).otherwise(0))
    none = F.array().cast("array<struct<start_line:int,end_line:int>>")
    first = F.struct(F.lit(1).alias("start"), none.alias("done"))

    def step(a: Column, f: Column) -> Column:
        over = (f["end_line"] - a["start"] + 1 > size) & (f["start_line"] > a["start"])
        cut = F.struct(f["start_line"].alias("start"), F.array_append(a["done"], F.struct(a["start"].alias("start_line"), (f["start_line"] - 1).alias("end_line"))).alias("done"))
        return F.when(over, cut).otherwise(a)

    last = lambda a: F.array_append(a["done"], F.struct(a["start"].alias("start_line"), n.alias("end_line")))
    return F.when(n <= size, F.array(F.struct(F.lit(1).alias("start_line"), n.alias("end_line")))).otherwise(F.aggregate(fs, first, step, last))


def python_stubs(content: Column) -> Column:
    """Up to five top-level Python functions: array of (name, params) without self (FN-1)."""
    regex = F.lit(r"(?Umd)^def\s+(\w+)\s*\(([^)]*)\)")
    pairs = F.arrays_zip(F.regexp_extract_all(content, regex, F.lit(1)).alias("name"), F.regexp_extract_all(content, regex, F.lit(2)).alias("raw"))
    name = lambda p: strip(F.split(F.split(p, ":")[0], "=")[0])
    kept = lambda raw: F.filter(F.split(raw, ","), lambda p: (strip(p) != "") & (strip(p) != "self"))
    return F.transform(F.slice(pairs, 1, 5), lambda x: F.struct(x["name"].alias("name"), F.transform(kept(x["raw"]), name).alias("params")))


def js_stubs(content: Column) -> Column:
    """Names of up to five JavaScript functions (FN-2)."""
    regex = F.lit(r"(?U)(?:function\s+(\w+)|const\s+(\w+)\s*=\s*(?:async\s*)?\()")
    both = F.zip_with(F.regexp_extract_all(content, regex, F.lit(1)), F.regexp_extract_all(content, regex, F.lit(2)), lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b))
    return F.slice(F.filter(both, lambda x: x != ""), 1, 5)


__all__ = ["call_map", "js_stubs", "line_chunks", "methods_of", "metrics", "parse", "parse_source", "parser_chunks", "python_stubs", "reader_chunks", "with_radon"]
