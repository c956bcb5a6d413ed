"""Symbol extraction as a table function over files, in Arrow batches: one schema for all languages.

Python is read by the standard library's parser; the other languages by a masked scan of declarations
with brace (or ``end``) matching, so that literals and comments never open or close a scope.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpline.functions.paths import extension
from kelpline.functions.text import language_of_extension

COLUMNS = "ordinal bigint, name string, kind string, start_line int, end_line int, signature string, doc_comment string, visibility string, is_async boolean, is_static boolean, is_abstract boolean, is_exported boolean, is_const boolean, is_unsafe boolean, parent_name string, type_parameters array<string>, parameters array<struct<name:string,type:string>>, return_type string"
LANGUAGES = ("rust", "typescript", "javascript", "python", "ruby", "go", "c", "cpp")


def _mask(text: str, ruby: bool = False) -> str:
    """Literals and comments as blanks of the same length."""
    rule = r"\#[^\n]*|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\.)*'" if ruby else r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)'|`(?:[^`\\]|\\.)*`"
    return re.sub(rule, lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _close(masked: str, at: int) -> int:
    """Offset past the brace group that opens first at or after ``at``; a ``;`` before it ends the declaration."""
    m = re.compile(r"[{;]").search(masked, at)
    if not m or m.group() == ";":
        return m.end() if m else len(masked)
    depth = 0
    for b in re.compile(r"[{}]").finditer(masked, m.start()):
        depth += 1 if b.group() == "{" else -1
        if depth == 0:
            return b.end()
    return len(masked)


def _params(raw: str | None, sep: str = ":") -> list[dict]:
    out, depth, word = [], 0, ""
    for c in (raw or "") + ",":
        if c in "([{<":
            depth += 1
        elif c in ")]}>":
            depth -= 1
        if c == "," and depth <= 0:
            part = word.split("=")[0].strip()
            if part:
                if sep == ":":
                    name, _, kind = part.partition(":")
                else:
                    kind, _, name = part.rpartition(" ") if sep == "c" else (part.partition(" ")[2], "", part.partition(" ")[0])
                out.append({"name": name.strip().lstrip("*&"), "type": kind.strip() or None})
            word = ""
        else:
            word += c
    return out


def _generics(raw: str | None) -> list[str]:
    return [p["name"] for p in _params(raw)] if raw else []


def _doc(ls: list[str], line: int, marks: tuple[str, ...]) -> str | None:
    held = []
    while line > 0 and ls[line - 1].strip().startswith(marks):
        line -= 1
        held.append(ls[line].strip().lstrip("/#*! ").rstrip("*/ "))
    return "\n".join(reversed(held)) or None


def _row(name, kind, start, end, signature, doc=None, visibility="unknown", parent=None, types=(), params=(), returns=None, **flags) -> dict:
    base = {"name": name, "kind": kind, "start_line": start, "end_line": end, "signature": signature, "doc_comment": doc, "visibility": visibility, "parent_name": parent, "type_parameters": list(types) or None, "parameters": list(params) or None, "return_type": returns}
    for f in ("is_async", "is_static", "is_abstract", "is_exported", "is_const", "is_unsafe"):
        base[f] = bool(flags.get(f))
    return base


def extract_python(text: str) -> list[dict]:
    ls, out = text.split("\n"), []

    def level(name: str) -> str:
        if name.startswith("__") and not name.endswith("__"):
            return "private"
        return "protected" if name.startswith("_") else "public"

    def walk(node: ast.AST, parent: str | None) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                marks = {d.id if isinstance(d, ast.Name) else getattr(d, "attr", "") for d in n.decorator_list}
                is_class = isinstance(n, ast.ClassDef)
                params = [] if is_class else [{"name": a.arg, "type": ast.unparse(a.annotation) if a.annotation else None} for a in [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]]
                out.append(
                    _row(
                        n.name, "class" if is_class else "method" if parent else "function", n.lineno, n.end_lineno, ls[n.lineno - 1].strip(), ast.get_docstring(n), level(n.name), parent, (), params,
                        None if is_class or n.returns is None else ast.unparse(n.returns), is_async=isinstance(n, ast.AsyncFunctionDef), is_static=bool(marks & {"staticmethod", "classmethod"}), is_abstract="abstractmethod" in marks,
                    )
                )
                walk(n, n.name)
            else:
                walk(n, parent)

    walk(ast.parse(text), None)
    return out


_RUST = re.compile(r"(?m)^[ \t]*(?P<vis>pub(?:\([^)]*\))?\s+)?(?P<mods>(?:default\s+|const\s+(?=(?:async|unsafe|fn|extern)\b)|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*)(?P<kind>fn|struct|enum|trait|impl|mod|const|static|type)\b\s*(?P<rest>[^\n]*)")
_RUST_KINDS = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "impl": "class", "mod": "module", "const": "constant", "static": "variable", "type": "type"}


def extract_rust(text: str) -> list[dict]:
    masked, ls, out, scopes = _mask(text), text.split("\n"), [], []
    for m in _RUST.finditer(masked):
        start = masked.count("\n", 0, m.start("kind"))
        while scopes and scopes[-1][0] <= m.start():
            scopes.pop()
        kind, rest = m.group("kind"), m.group("rest")
        if kind == "impl":
            name = re.sub(r"^<[^>]*>\s*", "", rest)
            name = re.split(r"\s+for\s+", name)[-1]
        else:
            name = rest.removeprefix("mut ")
        got = re.match(r"[A-Za-z_]\w*", name.strip())
        if not got:
            continue
        end_at = _close(masked, m.end("kind"))
        vis = (m.group("vis") or "").strip()
        level = "public" if vis == "pub" else "crate" if vis == "pub(crate)" else "protected" if vis == "pub(super)" else "internal" if vis else "private"
        fn = re.match(r"\w+\s*(?P<g><[^(]*>)?\s*\((?P<p>[\s\S]*?)\)\s*(?:->\s*(?P<r>[^{;]+?))?\s*(?:where\b[^{]*)?[{;]", masked[m.start("rest") :]) if kind == "fn" else None
        first = ls[start].strip()
        parent = scopes[-1][1] if scopes else None
        out.append(_row(got.group(), _RUST_KINDS[kind], start + 1, masked.count("\n", 0, end_at - 1) + 1, first, _doc(ls, start, ("///", "//", "/*", "*")), level, parent, _generics(fn.group("g")[1:-1] if fn and fn.group("g") else None), _params(fn.group("p")) if fn else (), fn.group("r") if fn else None, is_async="async" in m.group("mods"), is_unsafe="unsafe" in m.group("mods"), is_const="const" in m.group("mods") or kind == "const", is_static=kind == "static"))
        if kind in ("impl", "trait", "mod", "fn"):
            scopes.append((end_at, got.group()))
    return out


_TS = re.compile(
    r"(?m)^[ \t]*(?P<mods>(?:export\s+|default\s+|declare\s+|public\s+|private\s+|protected\s+|static\s+|abstract\s+|async\s+|readonly\s+)*)(?:(?P<kind>function\*?|class|interface|enum|type)\s+(?P<name>[A-Za-z_$][\w$]*)|(?P<var>const|let|var)\s+(?P<vname>[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=|(?P<method>[A-Za-z_$#][\w$]*)\s*(?:<[^>(]*>)?\s*\((?P<mp>[^)]*)\)\s*(?::\s*(?P<mr>[^{;\n]+))?\s*\{)"
)
_TS_KINDS = {"function": "function", "function*": "function", "class": "class", "interface": "interface", "enum": "enum", "type": "typealias"}
_NOT_METHODS = frozenset("if for while switch catch function return with do else try".split())


def extract_typescript(text: str) -> list[dict]:
    masked, ls, out, scopes = _mask(text), text.split("\n"), [], []
    for m in _TS.finditer(masked):
        mods = m.group("mods").split()
        start = masked.count("\n", 0, m.start("mods") + len(m.group("mods")))
        while scopes and scopes[-1][0] <= m.start():
            scopes.pop()
        parent = scopes[-1][1] if scopes else None
        params, returns, types = (), None, ()
        if m.group("method"):
            if m.group("method") in _NOT_METHODS or not scopes or scopes[-1][2] != "class":
                continue
            name, kind, params, returns = m.group("method"), "method", _params(m.group("mp")), m.group("mr")
        elif m.group("vname"):
            name, kind = m.group("vname"), "constant" if m.group("var") == "const" else "variable"
            if scopes:
                continue
        else:
            name, kind = m.group("name"), _TS_KINDS[m.group("kind")]
            fn = re.match(r"\s*(?:<(?P<g>[^>(]*)>)?\s*(?:\((?P<p>[^)]*)\)\s*(?::\s*(?P<r>[^{;\n]+))?)?", masked[m.end("name") :])
            types, params, returns = _generics(fn.group("g")), _params(fn.group("p")), fn.group("r")
        end_at = _close(masked, m.end() - 1)
        level = next((v for v in ("public", "private", "protected") if v in mods), "public" if "export" in mods else "unknown")
        out.append(_row(name, kind, start + 1, masked.count("\n", 0, end_at - 1) + 1, ls[start].strip(), None, level, parent, types, params, returns and returns.strip(), is_async="async" in mods, is_static="static" in mods, is_abstract="abstract" in mods, is_exported="export" in mods, is_const=m.group("var") == "const"))
        if kind in ("class", "interface", "function", "method"):
            scopes.append((end_at, name, "class" if kind in ("class", "interface") else "body"))
    return out


_RUBY = re.compile(r"(?m)^[ \t]*(?:(?P<kind>class|module|def)\s+(?P<self>self\.)?(?P<name>[A-Za-z_][\w:]*[?!=]?)(?:\((?P<p>[^)\n]*)\))?|(?P<const>[A-Z][A-Z0-9_]*)\s*=(?!=)|(?P<attr>attr_(?:accessor|reader|writer))\s+(?P<attrs>[^\n]+)|(?P<section>private|protected|public)\b(?P<inline>[ \t]+(?:def\s+(?P<iname>\w+[?!]?)|:(?P<sname>\w+)))?|(?P<open>(?:if|unless|while|until|case|begin|for)\b)|(?P<end>end)\b)|\bdo\b[ \t]*(?:\|[^|\n]*\|)?[ \t]*(?=$|\n)")


def extract_ruby(text: str) -> list[dict]:
    masked, ls, out = _mask(text, ruby=True), text.split("\n"), []
    stack: list[tuple[dict | None, str]] = []
    section = ["public"]

    def parent() -> str | None:
        return next((r["name"] for r, _ in reversed(stack) if r and r["kind"] in ("class", "module")), None)

    def method(name: str, line: int, level: str, params: str | None, static: bool) -> dict:
        row = _row(name, "function" if name == "initialize" else "method", line + 1, line + 1, ls[line].strip(), _doc(ls, line, ("#",)), level, parent(), (), [{"name": p.split("=")[0].strip(" *&:"), "type": None} for p in (params or "").split(",") if p.strip()], None, is_static=static)
        out.append(row)
        return row

    for m in _RUBY.finditer(masked):
        line = masked.count("\n", 0, m.end() - 1)
        kind = m.group("kind")
        if kind in ("class", "module"):
            row = _row(m.group("name"), kind, line + 1, line + 1, ls[line].strip(), _doc(ls, line, ("#",)), "public", parent())
            out.append(row)
            stack.append((row, kind))
            section.append("public")
        elif kind == "def":
            stack.append((method(m.group("name"), line, section[-1], m.group("p"), bool(m.group("self"))), "def"))
        elif m.group("const"):
            out.append(_row(m.group("const"), "constant", line + 1, line + 1, ls[line].strip(), None, "public", parent(), is_const=True))
        elif m.group("attr"):
            for name in re.findall(r":(\w+)", ls[line]):
                out.append(_row(name, "property", line + 1, line + 1, ls[line].strip(), None, section[-1], parent()))
        elif m.group("section"):
            if m.group("iname"):
                stack.append((method(m.group("iname"), line, m.group("section"), None, False), "def"))
            elif m.group("sname"):
                for r in out:
                    if r["name"] == m.group("sname") and r["parent_name"] == parent():
                        r["visibility"] = m.group("section")
            else:
                section[-1] = m.group("section")
        elif m.group("end"):
            if stack:
                row, what = stack.pop()
                if row:
                    row["end_line"] = line + 1
                if what in ("class", "module"):
                    section.pop()
        elif not re.search(r"\bend\b", masked[m.end() : masked.find("\n", m.end()) if "\n" in masked[m.end() :] else None]):
            stack.append((None, "block"))
    return out


_GO = re.compile(r"(?m)^(?:func\s+(?:\(\s*\w*\s*\*?(?P<recv>\w+)[^)]*\)\s*)?(?P<fn>\w+)\s*(?:\[(?P<g>[^\]]*)\])?\((?P<p>[^)]*)\)\s*(?P<r>[^{\n]*)|type\s+(?P<type>\w+)\s+(?P<what>struct|interface|[^\n]*)|(?P<cv>const|var)\s+(?P<name>\w+))")


def extract_go(text: str) -> list[dict]:
    masked, ls, out = _mask(text), text.split("\n"), []
    for m in _GO.finditer(masked):
        start = masked.count("\n", 0, m.start())
        name = m.group("fn") or m.group("type") or m.group("name")
        what = (m.group("what") or "").strip()
        kind = ("method" if m.group("recv") else "function") if m.group("fn") else {"struct": "struct", "interface": "interface"}.get(what.split("{")[0].strip(), "typealias") if m.group("type") else "constant" if m.group("cv") == "const" else "variable"
        end = masked.count("\n", 0, _close(masked, m.end()) - 1) + 1 if kind in ("function", "method", "struct", "interface") else start + 1
        out.append(_row(name, kind, start + 1, end, ls[start].strip(), _doc(ls, start, ("//",)), "public" if name[0].isupper() else "private", m.group("recv"), _generics((m.group("g") or "").replace(" ", ":", 1)) if m.group("g") else (), _params(m.group("p"), "go") if m.group("fn") else (), (m.group("r") or "").strip() or None, is_exported=name[0].isupper(), is_const=m.group("cv") == "const"))
    return out


_C = re.compile(r"(?m)^[ \t]*(?:#\s*define\s+(?P<macro>\w+)|(?P<td>typedef)\b[^;{]*?(?:\{[^}]*\})?\s*(?P<tdname>\w+)\s*;|(?:template\s*<(?P<g>[^>]*)>\s*)?(?P<kind>struct|union|class|enum(?:\s+class)?|namespace)\s+(?P<name>\w+)[^;{()]*\{|(?:template\s*<(?P<g2>[^>]*)>\s*)?(?P<pre>(?:(?:static|inline|extern|virtual|explicit|constexpr|const|unsigned|signed|long|short|friend)\s+)*)(?P<ret>[A-Za-z_][\w:<>,]*[\s*&]+)(?P<fn>[A-Za-z_~][\w:~]*)\s*\((?P<p>[^;{}]*)\)\s*(?P<tail>const|override|noexcept|final|\s)*(?P<body>\{|=\s*0\s*;|;)|(?P<gpre>(?:static|const|extern)\s+)*(?P<gtype>[A-Za-z_]\w*[\s*]+)(?P<gname>[A-Za-z_]\w*)(?:\[[^\]]*\])*\s*(?:=[^;]*)?;)")
_NOT_TYPES = frozenset("return else case goto new delete throw using if while for switch typedef break continue".split())


def extract_c(text: str, cpp: bool = False) -> list[dict]:
    masked, ls, out, scopes = _mask(text), text.split("\n"), [], []
    for m in _C.finditer(masked):
        start = masked.count("\n", 0, m.end() - len(m.group().lstrip()))
        while scopes and scopes[-1][0] <= m.start():
            scopes.pop()
        if scopes and scopes[-1][2] == "body":
            continue
        parent, line = (scopes[-1][1] if scopes else None), ls[start].strip()
        row, scope = None, None
        if m.group("macro"):
            row = _row(m.group("macro"), "macro", start + 1, start + 1, line, None, "public", None)
        elif m.group("tdname"):
            row = _row(m.group("tdname"), "typealias", start + 1, masked.count("\n", 0, m.end()) + 1, line, None, "public", parent)
        elif m.group("name"):
            end_at = _close(masked, m.start("name"))
            kind = {"union": "struct", "namespace": "module"}.get(m.group("kind"), m.group("kind").split()[0])
            row = _row(m.group("name"), kind, start + 1, masked.count("\n", 0, end_at - 1) + 1, line, _doc(ls, start, ("//", "/*", "*")), "public", parent, _generics(m.group("g")))
            scope = (end_at, m.group("name"), "type")
        elif m.group("fn") and m.group("ret").strip() not in _NOT_TYPES:
            end_at = _close(masked, m.start("body")) if m.group("body") == "{" else m.end()
            static = "static" in (m.group("pre") or "")
            row = _row(m.group("fn"), "method" if parent and cpp else "function", start + 1, masked.count("\n", 0, end_at - 1) + 1, line, _doc(ls, start, ("//", "/*", "*")), "private" if static and not cpp else "public", parent, _generics(m.group("g2")), _params(m.group("p"), "c"), m.group("ret").strip(), is_static=static, is_abstract=m.group("body").startswith("="))
            scope = (end_at, m.group("fn"), "body")
        elif m.group("gname") and m.group("gtype").strip() not in _NOT_TYPES:
            row = _row(m.group("gname"), "field" if parent else "variable", start + 1, start + 1, line, None, "private" if "static" in m.group() else "public", parent, is_static="static" in m.group(), is_const="const" in m.group())
        if row:
            out.append(row)
        if scope:
            scopes.append(scope)
    return out


def extract(language: str, text: str) -> list[dict]:
    if language == "python":
        return extract_python(text)
    if language == "rust":
        return extract_rust(text)
    if language in ("typescript", "javascript"):
        return extract_typescript(text)
    if language == "ruby":
        return extract_ruby(text)
    if language == "go":
        return extract_go(text)
    if language in ("c", "cpp"):
        return extract_c(text, language == "cpp")
    raise ValueError(f"no symbol extraction for {language}; known: {', '.join(LANGUAGES)}")


def extract_symbols(files: DataFrame, path: str, language: str, text: str) -> DataFrame:
    """One row per symbol in document order; a file that does not parse gives one row with ``error`` and no name.

    Where the language is null or blank, the extension of the path names it.
    """
    schema = T.StructType.fromDDL(f"path string, error string, {COLUMNS}")
    names = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, lang, t in zip(b["path"], b["language"], b["text"]):
                try:
                    rows += [{"path": p, "error": None, "ordinal": k, **r} for k, r in enumerate(extract(lang, t))]
                except (ValueError, SyntaxError, RecursionError) as e:
                    rows.append({"path": p, "error": str(e)[:200]})
            if rows:
                out = pd.DataFrame(rows).reindex(columns=names)
                for c in ("ordinal", "start_line", "end_line"):
                    out[c] = out[c].astype("Int64" if c == "ordinal" else "Int32")
                for c in names:
                    if c.startswith("is_"):
                        out[c] = out[c].astype("boolean")
                    elif out[c].dtype == object or c in ("type_parameters", "parameters", "error"):
                        out[c] = out[c].astype(object).where(out[c].notna(), None)
                yield out

    picked = files.select(F.col(path).alias("path"), F.coalesce(F.nullif(F.lower(F.trim(language)), F.lit("")), language_of_extension(extension(F.col(path)))).alias("language"), F.col(text).alias("text")).where("path is not null and text is not null")
    return picked.where(F.col("language").isin(*LANGUAGES)).mapInPandas(run, schema)
