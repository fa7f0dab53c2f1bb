"""Parsing source files into symbols, imports and uses.

Python goes through the standard library's syntax tree. TypeScript, Java and C#
go through a scanner that blanks comments and strings and matches braces; it
finds declarations, imports, base types, calls and the declared types of
parameters and locals, but knows no full grammar.
Further languages can be registered in :data:`PARSERS`.
"""

from __future__ import annotations

import bisect
import ast
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE, DOC, QUALIFIER = 240, 400, 120


def _one_line(text: str, most: int) -> str:
    text = " ".join(text.split())
    return text if len(text) <= most else text[:most] + "…"


class Parsed:
    def __init__(self):
        self.symbols: list[dict] = []
        self.imports: list[dict] = []
        self.uses: list[dict] = []

    def symbol(self, kind, name, qualified, parent, signature, doc, start, end, exported, value_type=None, partial=False) -> int:
        self.symbols.append({"value_base": base_type_name(value_type), "ordinal": len(self.symbols), "parent": parent, "kind": kind, "name": name, "qualified_name": qualified, "signature": _one_line(signature, SIGNATURE), "doc": _one_line(doc, DOC) if doc else None,
                             "start_line": start, "end_line": end, "exported": exported, "value_type": value_type, "is_partial": partial})
        return len(self.symbols) - 1

    def use(self, inside, type, name, qualifier, line, new=False, receiver=None):
        self.uses.append({"ordinal": len(self.uses), "inside": inside, "type": type, "name": name, "qualifier": qualifier[:QUALIFIER] if qualifier else None, "line": line, "instantiates": new,
                          "receiver_type": receiver, "receiver_base": base_type_name(receiver), "segments": chain_segments(qualifier) if qualifier else None})


#: Type names that no declaration in a tree stands for.
PRIMITIVES = frozenset("var void int long short byte char boolean float double bool string object decimal uint ulong ushort sbyte nint nuint dynamic".split())
MODIFIERS = frozenset("public private protected internal static final abstract synchronized native transient volatile default override virtual async readonly sealed partial extern unsafe new required const event ref in params this".split())


def base_type_name(text: str | None) -> str | None:
    """A declared type without its arguments, annotation and question mark; None for arrays, primitives and all that is no name."""
    if not text:
        return None
    name = re.sub(r"^@[\w$.]+(\([^)]*\))?", "", re.sub(r"\s+", "", text))
    if name.endswith(("[]", "...")):
        return None
    while (less := re.sub(r"<[^<>]*>", "", name)) != name:
        name = less
    name = name.removesuffix("?")
    return name if re.fullmatch(r"[A-Za-z_$][\w$]*(\.[A-Za-z_$][\w$]*)*", name) and name not in PRIMITIVES else None


def _closing(text: str, at: int) -> int:
    """After the bracket that closes the one at ``at``; -1: none does."""
    ends = {"(": ")", "<": ">", "[": "]"}
    first, last, depth = text[at], ends[text[at]], 0
    for k in range(at, len(text)):
        depth += (text[k] == first) - (text[k] == last)
        if not depth:
            return k + 1
    return -1


def chain_segments(qualifier: str) -> list[dict] | None:
    """``a.b().c`` as names and calls, the first perhaps a new object; None for indexing, casts and other expressions."""
    rest, out = qualifier.replace("?.", ".").replace("!", ""), []
    new = rest.startswith("new ")
    rest = rest[4:] if new else rest
    while rest:
        m = re.match(r"[\w$]+(?:\.[\w$]+)*" if new and not out else r"[\w$]+", rest)
        if not m:
            return None
        at, call = m.end(), False
        for bracket in "<(":
            if rest[at:at + 1] == bracket:
                at, call = _closing(rest, at), bracket == "("
                if at < 0:
                    return None
        if new and not out and not call:
            return None
        out.append({"name": m[0], "call": call and not (new and not out), "new": new and not out})
        if at < len(rest) and (rest[at] != "." or at + 1 == len(rest)):
            return None
        rest = rest[at + 1:]
    return out or None


def qualifier_before(text: str, at: int) -> str | None:
    """The expression that ends in a dot before ``at``: names, calls, indexing, and ``new``; white space is dropped."""
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    if not end or text[end - 1] != ".":
        return None
    start, opens = end - 1, {")": "(", "]": "[", ">": "<"}
    while True:
        k = start
        while k and (text[k - 1].isspace() or text[k - 1] in "?!"):
            k -= 1
        while k and text[k - 1] in opens:
            last, first, depth = text[k - 1], opens[text[k - 1]], 0
            while k:
                k -= 1
                depth += (text[k] == last) - (text[k] == first)
                if not depth:
                    break
            while k and text[k - 1].isspace():
                k -= 1
        while k and (text[k - 1].isalnum() or text[k - 1] in "_$"):
            k -= 1
        start, before = k, len(text[:k].rstrip())
        if not before or text[before - 1] != "." or before == start and k == end - 1:
            break
        start = before - 1
    found = re.sub(r"\s+", "", text[start:end - 1]).rstrip("?!")
    return (("new " if re.search(r"\bnew\s*$", text[max(0, start - 8):start]) else "") + found)[:QUALIFIER] or None


def declared_type(head: str) -> str | None:
    """What is left of a declaration before its name once modifiers and type parameters are gone."""
    words = head.strip()
    while (m := re.match(r"([\w]+)\s+", words)) and m[1] in MODIFIERS:
        words = words[m.end():]
    if words.startswith("<") and (end := _closing(words, 0)) > 0:
        words = words[end:].strip()
    return words or None


_LOCAL = re.compile(r"(?:^|[;{}(,]|\bout\s|\bfinal\s|\busing\s*\(|\bforeach\s*\(|\bfor\s*\()\s*(?:final\s+|out\s+|this\s+|ref\s+|in\s+|params\s+|readonly\s+)*([A-Za-z_$][\w$.]*(?:<[\w\s,.<>\[\]?]*>)?\??(?:\[\])*)\s+([A-Za-z_$][\w$]*)\s*(?=[=;:,)]|\bin\b)(?:=\s*new\s+([\w$.]+))?")


def local_types(text: str) -> dict[str, str]:
    """The declared types of the parameters and locals in a method's text; ``var x = new T()`` says ``T``."""
    out: dict[str, str] = {}
    for m in _LOCAL.finditer(text):
        kind = m[3] if m[1] == "var" else m[1]
        if kind and m[1] not in _WORDS and m[1] not in ("return", "else", "case", "goto", "throw"):
            out.setdefault(m[2], kind)
    return out


def parse_python(path: str, source: str, module: str) -> Parsed:
    out, lines = Parsed(), source.splitlines()
    tree = ast.parse(source)

    def name_of(node) -> tuple[str, str | None] | None:
        if isinstance(node, ast.Name):
            return node.id, None
        if isinstance(node, ast.Attribute):
            return node.attr, ast.unparse(node.value).replace(" ", "")
        return None

    def uses(node, inside: int | None):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(child, ast.Call) and (found := name_of(child.func)):
                out.use(inside, "calls", *found, child.lineno)
            if isinstance(child, (ast.arg, ast.AnnAssign)) and child.annotation is not None:
                for part in ast.walk(child.annotation):
                    if isinstance(part, ast.Name):
                        out.use(inside, "references", part.id, None, part.lineno)
            uses(child, inside)

    def declare(node, parent: int | None, prefix: str, in_class: bool):
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                if not isinstance(node, ast.Module) or isinstance(child, (ast.If, ast.Try, ast.With, ast.For, ast.While)):
                    declare(child, parent, prefix, in_class)
                continue
            is_class = isinstance(child, ast.ClassDef)
            first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
            head = "\n".join(lines[child.lineno - 1:max(child.lineno, child.body[0].lineno - (child.body[0].lineno > child.lineno))])
            me = out.symbol("class" if is_class else "method" if in_class else "function", child.name, f"{prefix}.{child.name}", parent, head.rstrip().rstrip(":"), ast.get_docstring(child), first, child.end_lineno, parent is None and not child.name.startswith("_"))
            for d in child.decorator_list:
                if found := name_of(d.func if isinstance(d, ast.Call) else d):
                    out.use(me, "calls", *found, d.lineno)
            for base in child.bases if is_class else ():
                if found := name_of(base):
                    out.use(me, "extends", *found, base.lineno)
            uses(child.args if not is_class else ast.Module([], []), me)
            uses(ast.Module(child.body, []), me)
            declare(child, me, f"{prefix}.{child.name}", is_class)

    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                out.imports.append({"kind": "import", "spec": a.name, "name": None, "alias": a.asname, "line": node.lineno})
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                out.imports.append({"kind": "wildcard" if a.name == "*" else "from", "spec": "." * node.level + (node.module or ""), "name": None if a.name == "*" else a.name, "alias": a.asname, "line": node.lineno})
    declare(tree, None, module, False)
    uses(tree, None)
    return out


_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_TYPE = re.compile(r"\b(class|interface|enum|record|struct|namespace|@interface)\s+([\w.]+)")
_CALL = re.compile(r"(?<![\w$#])([A-Za-z_$#][\w$]*)\s*(?:<[\w\s,.<>\[\]?]*>)?\s*\(")
_METHOD = re.compile(r"(?:^|[\s>\]*?])(#?[A-Za-z_$][\w$]*)\s*(?:<[^()]*>)?\s*\(.*\)\s*[^()=]*$", re.S)
_WORDS = frozenset("if for while switch catch return throw new function super this else do try using lock foreach sizeof typeof nameof await yield synchronized when base assert".split())


def parse_braces(path: str, source: str, module: str, language: str) -> Parsed:
    out = Parsed()
    plain = _BLANK.sub(lambda m: "".join(c if c == "\n" else " " for c in m[0]), source)
    line_at = [0, *(m.end() for m in re.finditer("\n", plain))]

    def line(at: int) -> int:
        return bisect.bisect_right(line_at, at)

    docs = [(m.end(), m[1] or m[2]) for m in re.finditer(r"/\*\*(.*?)\*/|((?:^[ \t]*///[^\n]*\n)+)", source, re.S | re.M)]
    ends = [end for end, _ in docs]

    def doc_before(at: int) -> str | None:
        """The comment that ends right before a declaration; only annotations may stand between."""
        k = bisect.bisect_right(ends, at) - 1
        if k < 0 or not re.fullmatch(r"\s*(?:@\w+(?:\([^)]*\))?\s*|export\s+|default\s+)*", source[ends[k]:at]):
            return None
        return re.sub(r"^[ \t]*(\*|///) ?|<[^>]+>", "", docs[k][1], flags=re.M).strip()

    prefix, dot = (module + ":", ".") if language in ("typescript", "tsx") else ("", ".")
    if language == "java" and (m := re.search(r"^\s*package\s+([\w.]+)\s*;", plain, re.M)):
        out.symbol("namespace", m[1], m[1], None, m[0].strip(), None, line(m.start(1)), line(m.start(1)), True)
        prefix = m[1] + "."
    if language == "csharp" and (m := re.search(r"^\s*namespace\s+([\w.]+)\s*;", plain, re.M)):
        out.symbol("namespace", m[1], m[1], None, m[0].strip(), None, line(m.start(1)), line(m.start(1)), True)
        prefix = m[1] + "."
    for m in re.finditer(r"^\s*(?:export|import)\s+(.*?)\s*from\s*(['\"])(.*?)\2|^\s*import\s+(static\s+)?([\w.]+)(\.\*)?\s*;|^\s*(global\s+)?using\s+(static\s+)?(?:(\w+)\s*=\s*)?([\w.:]+)\s*;", source, re.M | re.S):
        at = line(m.start() + len(m[0]) - len(m[0].lstrip()))
        if m[3] is not None:
            kind = "reexport" if m[0].lstrip().startswith("export") else "import"
            if (star := re.match(r"\*(?:\s+as\s+(\w+))?", m[1])):
                out.imports.append({"kind": "wildcard" if kind == "reexport" else kind, "spec": m[3], "name": "*", "alias": star[1], "line": at})
            for part in re.search(r"\{(.*)\}", m[1], re.S)[1].split(",") if "{" in m[1] else ():
                if words := part.replace("type ", " ").split():
                    out.imports.append({"kind": kind, "spec": m[3], "name": words[0], "alias": words[2] if len(words) == 3 else None, "line": at})
            if (first := re.match(r"(\w+)\s*(?:,|$)", m[1])) and first[1] != "type":
                out.imports.append({"kind": kind, "spec": m[3], "name": "default", "alias": first[1], "line": at})
        elif m[5]:
            kind = "wildcard" if m[6] else "static" if m[4] else "import"
            out.imports.append({"kind": kind, "spec": m[5], "name": None if m[6] else m[5].rpartition(".")[2], "alias": None, "line": at})
        elif m[10]:
            out.imports.append({"kind": "alias" if m[9] else "static" if m[8] else "using", "spec": m[10].removeprefix("global::"), "name": None, "alias": m[9], "line": at, "is_global": bool(m[7])})

    stack: list[tuple[str, int | None]] = []
    owner: list[tuple[int, int, int | None]] = []
    opened: list[int] = []
    start, depth = 0, 0

    def inside() -> tuple[str, int | None]:
        for kind, me in reversed(stack):
            if me is not None:
                return kind, me
        return "", None

    def name_for(name: str, parent: int | None) -> str:
        return out.symbols[parent]["qualified_name"] + dot + name if parent is not None else prefix + name

    def exported(head: str) -> bool:
        return "export" in head.split() if prefix.endswith(":") else "public" in head.split()

    for m in re.finditer(r"[{};()]", plain):
        c, at = m[0], m.start()
        if c in "()":
            depth += 1 if c == "(" else -1
            continue
        if depth > 0 and c == ";":
            continue
        head, where = plain[start:at], start + len(plain[start:at]) - len(plain[start:at].lstrip())
        if c == "{":
            kind, me = inside()[0], None
            parent = inside()[1]
            clean = re.sub(r"@\w+(\([^()]*\))?|\[[^\[\]]*\]\s*(?=[\w\[])", " ", head).strip()
            if depth <= 0 and (t := _TYPE.search(clean)) and "(" not in clean[:t.start()]:
                what = {"interface": "interface", "@interface": "interface", "enum": "enum", "namespace": "namespace"}.get(t[1], "class")
                me = out.symbol(what, t[2], name_for(t[2], parent), parent, clean, doc_before(where), line(where), line(at), exported(head), None, "partial" in clean.split())
                rest = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", clean[t.end():]))
                rest = re.sub(r"^\s*\([^()]*\)", "", rest)
                for kw, names in re.findall(r"\b(extends|implements)\s+([\w.,\s]+?)(?=\b(?:extends|implements)\b|$)", rest) + ([("extends", rest.split(":", 1)[1].split(" where ")[0])] if language == "csharp" and ":" in rest else []):
                    for base in names.split(","):
                        if base := base.strip().split("(")[0]:
                            out.use(me, kw, base.rpartition(".")[2], base.rpartition(".")[0] or None, line(at))
                kind = "type" if what != "namespace" else "namespace"
            elif depth <= 0 and prefix.endswith(":") and (f := re.search(r"\bfunction\s*\*?\s*([\w$]+)", clean) or re.search(r"\bconst\s+([\w$]+)\b.*=>\s*$", clean, re.S)) and kind in ("", "function"):
                me = out.symbol("function", f[1], name_for(f[1], parent), parent, re.sub(r"\s*=>\s*$", "", clean), doc_before(where), line(where), line(at), parent is None and exported(head))
                kind = "function"
            elif depth <= 0 and kind == "type" and (f := _METHOD.search(re.sub(r"\bthrows\s+[\w.,\s]+$", "", clean))) and f[1] not in _WORDS:
                value = None if prefix.endswith(":") else declared_type(clean[:f.start(1)])
                me = out.symbol("method", f[1], name_for(f[1], parent), parent, clean, doc_before(where), line(where), line(at), exported(head), value if value != "void" else None)
                kind = "function"
            elif depth <= 0 and kind == "type" and language == "csharp" and (f := re.search(r"([\w<>\[\]?., ]+)\s+(\w+)\s*$", clean)):
                me = out.symbol("property", f[2], name_for(f[2], parent), parent, clean, doc_before(where), line(where), line(at), exported(head), declared_type(f[1]))
                kind = "function"
            else:
                kind = kind if kind == "function" else "block" if kind != "type" or "=" in head else kind
            stack.append((kind, me))
            opened.append(depth)
            depth = 0
        elif c == "}":
            if stack:
                _, me = stack.pop()
                depth = opened.pop()
                if me is not None:
                    out.symbols[me]["end_line"] = line(at)
                    owner.append((out.symbols[me]["start_line"], line(at), me))
        elif stack and stack[-1][0] == "type" and inside()[1] is not None:
            whole, parent = re.sub(r"@\w+(\([^()]*\))?", " ", head).strip(), inside()[1]
            clean = re.sub(r"\s*=>.*$", "", whole, flags=re.S) if language == "csharp" else whole
            if (f := _METHOD.search(clean)) and "=" not in clean.split("(")[0] and f[1] not in _WORDS:
                value = None if prefix.endswith(":") else declared_type(clean[:f.start(1)])
                me = out.symbol("method", f[1], name_for(f[1], parent), parent, clean, doc_before(where), line(where), line(at), exported(head) or out.symbols[parent]["kind"] == "interface", value if value != "void" else None)
                if clean != whole:
                    owner.append((line(where), line(at), me))
            elif prefix.endswith(":") and (f := re.match(r"(?:(?:public|private|protected|readonly|static|declare)\s+)*(#?[\w$]+)\s*[?!]?\s*(?::([^=]+))?(=.*)?$", clean, re.S)):
                out.symbol("property", f[1], name_for(f[1], parent), parent, clean, doc_before(where), line(where), line(at), False, (f[2] or "").strip() or None)
            elif not prefix.endswith(":") and (f := re.match(r"(?:[\w]+\s+)*?([\w.<>\[\],? ]+?)\s+(\w+)\s*(=.*)?$", clean, re.S)):
                out.symbol("field", f[2], name_for(f[2], parent), parent, clean, doc_before(where), line(where), line(at), exported(head), declared_type(clean[:f.start(2)]))
        start = m.end()
    spans = sorted(owner, key=lambda o: (o[1] - o[0]))
    declared = {(s["name"], s["start_line"]) for s in out.symbols} | {(s["name"], s["end_line"]) for s in out.symbols}
    typed: dict[int, dict[str, str]] = {}
    for m in _CALL.finditer(plain):
        name, at = m[1], line(m.start(1))
        held = qualifier_before(plain, m.start(1))
        new = re.search(r"\bnew\s+(?:[\w$]+\s*\.\s*)*$", plain[max(0, m.start(1) - 200):m.start(1)]) is not None
        if name in _WORDS or not new and not held and (name, at) in declared:
            continue
        me = next((o[2] for o in spans if o[0] <= at <= o[1]), None)
        if me is not None and out.symbols[me]["kind"] == "namespace":
            me = None
        held = held.removeprefix("new ") if new and held else held
        receiver = None
        if held and me is not None and not prefix.endswith(":"):
            root = re.match(r"[\w$]+", held)
            if me not in typed:
                a, b = out.symbols[me]["start_line"], out.symbols[me]["end_line"]
                typed[me] = local_types(plain[line_at[a - 1]:line_at[b] if b < len(line_at) else len(plain)])
            receiver = typed[me].get(root[0]) if root else None
        out.use(me, "calls", name, held, at, new, receiver)
    return out


Parser = Callable[[str, str, str], Parsed]
PARSERS: dict[str, Parser] = {"python": parse_python} | {x: (lambda p, s, m, x=x: parse_braces(p, s, m, x)) for x in ("typescript", "tsx", "java", "csharp")}


def module_name(path: str, language: str, roots: list[str]) -> str:
    """A Python module below the deepest root that holds it; for TypeScript the path without its ending."""
    stem = re.sub(r"\.[^./]+$", "", path)
    if language != "python":
        return stem
    for root in sorted(roots, key=len, reverse=True):
        if not root or stem.startswith(root + "/"):
            stem = stem[len(root) + 1:] if root else stem
            break
    return re.sub(r"\.?__init__$", "", stem.replace("/", "."))


def python_roots(paths: list[str], projects: list[str] = ()) -> list[str]:
    """The tree's root, projects and their ``src``, and what holds top-level packages; deepest first."""
    packages = {p.rpartition("/")[0] for p in paths if p.endswith("/__init__.py")}
    roots = {"", *projects, *(f"{p}/src" if p else "src" for p in ("", *projects) if any(x.startswith(f"{p}/src/" if p else "src/") for x in paths))}
    roots |= {p.rpartition("/")[0] for p in packages if p.rpartition("/")[0] not in packages}
    return sorted(roots, key=len, reverse=True)


_SCHEMA = "path string, language string, module string, record string, body string"
SYMBOL = "ordinal int, parent int, kind string, name string, qualified_name string, signature string, doc string, start_line int, end_line int, exported boolean, value_type string, value_base string, is_partial boolean"
IMPORT = "kind string, spec string, name string, alias string, line int, is_global boolean"
USE = "ordinal int, inside int, type string, name string, qualifier string, line int, instantiates boolean, receiver_type string, receiver_base string, segments array<struct<name: string, call: boolean, new: boolean>>"


def parse_files(files: DataFrame, roots: list[str] = ("",)) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Symbols, imports, uses and failures of ``files (path, language, content)``; a file that doesn't parse is a failure."""
    roots = list(roots)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, language, content in zip(frame["path"], frame["language"], frame["content"]):
                module = module_name(path, language, roots)
                try:
                    got = PARSERS[language](path, content or "", module)
                except (SyntaxError, ValueError, KeyError, RecursionError) as error:
                    rows.append((path, language, module, "failure", str(error)[:200]))
                    continue
                rows += [(path, language, module, kind, json.dumps(x)) for kind, some in (("symbol", got.symbols), ("import", got.imports), ("use", got.uses)) for x in some]
            yield pd.DataFrame(rows, columns=["path", "language", "module", "record", "body"])

    parsed = files.select("path", "language", "content").mapInPandas(run, _SCHEMA)
    from ..operators.state import cut

    parsed = cut(parsed)
    typed = lambda record, schema: parsed.filter(F.col("record") == record).select("path", "language", "module", F.from_json("body", schema).alias("x")).select("path", "language", "module", "x.*")
    ident = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64("path", c))
    symbols = typed("symbol", SYMBOL).withColumn("id", ident("ordinal")).withColumn("parent_id", ident("parent")).drop("parent")
    uses = typed("use", USE).withColumn("id", F.xxhash64("path", F.lit("use"), "ordinal")).withColumn("from_id", ident("inside")).drop("inside")
    return symbols, typed("import", IMPORT), uses, parsed.filter("record = 'failure'").select("path", F.col("body").alias("error"))
