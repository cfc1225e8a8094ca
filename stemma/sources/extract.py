"""Extraction: files to nodes and edges by a registry of parsers run in mapInPandas.

A parser is a function (path, text) -> iterable of records
    ("node", type, name, line, end_line, package, language, exported, signature, doc, properties)
    ("edge", type, from_key, to_key)
with keys 'type:path:name' that hash to node ids. Code parsers cover declarations, imports and tests by the lexer and
patterns; they do not resolve types."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexer import functions_of, lex, masked
from ..session import partitions, ship
from .manifests import NAMES, read_manifest

ROWS = (
    "kind string, id string, type string, name string, qualified_name string, file_path string, line int, end_line int, package string, language string, "
    "exported boolean, signature string, doc_comment string, properties map<string,string>, source_id string, target_id string"
)
_COLUMNS = [c.strip().split(" ")[0] for c in ROWS.replace("map<string,string>", "m").split(", ")]

_BY_SUFFIX: dict[str, Callable] = {}
_BY_NAME: dict[str, Callable] = {}


def register(*suffixes: str, names: tuple = ()):
    def add(f):
        _BY_SUFFIX.update(dict.fromkeys(suffixes, f))
        _BY_NAME.update(dict.fromkeys(names, f))
        return f

    return add


def key_id(key: str) -> str:
    return hashlib.sha256(key.encode("utf-8", "replace")).hexdigest()[:24]


def node(kind, name, /, line=0, end=0, package="", language="", exported=False, signature="", doc="", **properties):
    return ("node", kind, name, line, end, package, language, exported, signature, doc, {k: str(v) for k, v in properties.items() if v != ""})


# ---- Code -------------------------------------------------------------------------------------------------------------

# Declarations and imports per language, matched on text without strings and comments.
_TYPES = {
    "go": [("Struct", r"^type\s+(\w+)\s+struct\b"), ("Interface", r"^type\s+(\w+)\s+interface\b"), ("Type", r"^type\s+(\w+)\s+(?!struct\b|interface\b)\S")],
    "python": [("Class", r"^\s*class\s+(\w+)")],
    "c": [("Class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("Interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("Enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(\w+)"), ("Type", r"^\s*(?:export\s+)?type\s+(\w+)\s*(?:<[^=]*>)?\s*=")],
    "java": [("Class", r"^\s*(?:(?:public|private|protected|abstract|final|static|sealed|partial|internal)\s+)*(?:class|record)\s+(\w+)"), ("Interface", r"^\s*(?:(?:public|private|protected|internal|partial)\s+)*interface\s+(\w+)"), ("Enum", r"^\s*(?:(?:public|private|protected|internal)\s+)*enum\s+(\w+)"), ("Struct", r"^\s*(?:(?:public|private|internal|readonly|partial)\s+)*struct\s+(\w+)")],
    "rust": [("Struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("Enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("Interface", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)")],
    "ruby": [("Class", r"^\s*class\s+([\w:]+)"), ("Module", r"^\s*module\s+([\w:]+)")],
}
_TYPES["cs"] = _TYPES["java"]
_IMPORTS = {
    "go": [r'^\s*import\s+(?:[\w.]+\s+)?"([^"]+)"', r'^\s+(?:[\w.]+\s+)?"([\w./-]+)"\s*$'],
    "python": [r"^\s*import\s+([\w.]+)", r"^\s*from\s+([\w.]+)\s+import\b"],
    "c": [r"^\s*import\s+(?:[^'\"\n]+\s+from\s+)?['\"]([^'\"]+)['\"]", r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)", r"^\s*export\s+[^'\"\n]+\s+from\s+['\"]([^'\"]+)['\"]"],
    "java": [r"^\s*import\s+(?:static\s+)?([\w.]+)"], "cs": [r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"], "rust": [r"^\s*(?:pub\s+)?use\s+([\w:]+)"], "ruby": [r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]"],
}
_LANGUAGE = {"go": "go", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "java": "java", "cs": "csharp", "rs": "rust", "rb": "ruby"}
_FAMILY = {"go": "go", "python": "python", "typescript": "c", "javascript": "c", "java": "java", "csharp": "cs", "rust": "rust", "ruby": "ruby"}
_PACKAGE = {"go": r"^package\s+(\w+)", "java": r"^\s*package\s+([\w.]+)", "csharp": r"^\s*namespace\s+([\w.]+)"}
_ROUTES = [
    (r"@(?:app|router|blueprint|bp)\.(get|post|put|delete|patch)\(\s*['\"]([^'\"]+)['\"]", "python"), (r"@(?:app|bp|blueprint)\.route\(\s*['\"]([^'\"]+)['\"]", "python"),
    (r"\b(?:app|router)\.(get|post|put|delete|patch)\(\s*['\"`]([^'\"`]+)['\"`]", "c"), (r"\.(GET|POST|PUT|DELETE|PATCH)\(\s*\"([^\"]+)\"", "go"), (r"\.HandleFunc\(\s*\"([^\"]+)\"", "go"),
    (r"@(Get|Post|Put|Delete|Patch)Mapping\(\s*(?:value\s*=\s*)?\"([^\"]+)\"", "java"), (r"\[Http(Get|Post|Put|Delete|Patch)\(\"([^\"]+)\"\)\]", "cs"),
]
_CLIENTS = [
    (r"\b(?:requests|httpx|client|session)\.(get|post|put|delete|patch)\(\s*f?['\"](?:https?://[^/'\"]+)?(/[^'\"]*)['\"]", "python"), (r"\bfetch\(\s*['\"`](?:https?://[^/'\"`]+)?(/[^'\"`]*)['\"`]", "c"),
    (r"\baxios\.(get|post|put|delete|patch)\(\s*['\"`](?:https?://[^/'\"`]+)?(/[^'\"`]*)['\"`]", "c"), (r"\bhttp\.(Get|Post)\(\s*\"(?:https?://[^/\"]+)?(/[^\"]*)\"", "go"),
]


# What Go predeclares, and its words that a parenthesis may follow.
_GO_KNOWN = set(
    "append cap clear close complex copy delete imag len make max min new panic print println real recover bool byte error float32 float64 int int8 int16 int32 int64 rune string "
    "uint uint8 uint16 uint32 uint64 uintptr any complex64 complex128 if for switch select func return go defer range case map chan struct interface type var const import package else".split())
_GO_CALL = re.compile(r"(?<![\w.])((?:[A-Za-z_]\w*\.)*[A-Za-z_]\w*)\s*\(")
_GO_IMPORT = re.compile(r'^\s*(?:import\s+)?(?:([\w.]+)\s+)?"([\w./-]+)"\s*$', re.M)


class GoCalls:
    """What the calls of a Go file refer to: its own functions, the methods of a receiver's fields, and imports by their
    alias or last path part. Calls of other names are left for the package (the linker's cross-file calls)."""

    def __init__(self, path: str, code: str, text: str, functions: dict, methods: dict):
        self.functions, self.methods, self.aliases, self.fields = functions, methods, {}, {}
        for m in _GO_IMPORT.finditer(text):
            self.aliases[m.group(1) or m.group(2).rsplit("/", 1)[-1]] = f"Dependency:{path}:{m.group(2)}"
        for m in re.finditer(r"^type\s+(\w+)\s+struct\s*\{(.*?)^\}", code, re.M | re.S):
            self.fields[m.group(1)] = {n: t for names, t in re.findall(r"^[ \t]+(\w+(?:, *\w+)*)[ \t]+([*\[\]\w.]+)", m.group(2), re.M) for n in re.split(r",\s*", names)}

    def field_type(self, chain: list[str], receiver: str) -> str:
        """The type at the end of a chain of fields of the receiver's struct, '' if it leaves the file's structs."""
        now = receiver
        for k, name in enumerate(chain):
            kind = self.fields.get(now, {}).get(name, "").lstrip("*[]")
            if not kind or "." in kind and k < len(chain) - 1:
                return ""
            now = kind
        return now if chain else ""

    def of(self, body: str, own: str, receiver_name: str, receiver: str) -> tuple[list[str], list[str]]:
        """(keys of what a body calls, names left unresolved), each once and in order."""
        found, open_names = {}, {}
        for m in _GO_CALL.finditer(body):
            *chain, name = m.group(1).split(".")
            if not chain:
                if name in self.functions:
                    found[self.functions[name]] = 1
                elif name not in _GO_KNOWN:
                    open_names[name] = 1
                continue
            kind = self.field_type(chain[1:], receiver) if receiver_name and chain[0] == receiver_name else ""
            package, _, plain = kind.rpartition(".")
            if package in self.aliases:
                found[self.aliases[package]] = 1
            elif (plain, name) in self.methods:
                found[self.methods[plain, name]] = 1
            elif len(chain) == 1 and chain[0] in self.aliases:
                found[self.aliases[chain[0]]] = 1
        found.pop(own, None)  # a call of itself says nothing
        return list(found), list(open_names)


def _is_test(path: str, language: str) -> bool:
    from ..functions.scalars import TEST_FILES

    return language in TEST_FILES and bool(re.search(TEST_FILES[language], path))


def _exported(name: str, language: str, signature: str) -> bool:
    if language == "go":
        return name[:1].isupper()
    if language in ("python", "ruby"):
        return not name.startswith("_")
    if language == "rust":
        return "pub" in signature.split()[:1] or signature.startswith("pub(")
    if language in ("java", "csharp"):
        return "public" in signature
    return signature.startswith("export")


@register(*_LANGUAGE)
def parse_code(path: str, text: str):
    language = _LANGUAGE[path.rsplit(".", 1)[-1].lower()]
    family = _FAMILY[language]
    tokens = list(lex(text, family))
    code = masked(text, tokens)
    only_comments = masked(text, [t for t in tokens if t[0] == "comment"])
    folder = path.rsplit("/", 2)[-2] if "/" in path else ""
    m = re.search(_PACKAGE[language], code, re.M) if language in _PACKAGE else None
    package = m.group(1) if m else folder
    test = _is_test(path, language)
    me = "TestFile" if test else "File"
    yield node(me, path, 1, text.count("\n") + 1, "" if language == "go" else package, language, True)
    own = f"{me}:{path}:{path}"
    at = lambda k: text.count("\n", 0, k) + 1
    for kind, pattern in _TYPES[family]:
        for m in re.finditer(pattern, code, re.M):
            name, line = m.group(1), at(m.start(1))
            head = code[m.start() : m.end()].strip()
            props = {"kind": kind.lower()}
            if kind == "Interface" and family == "go":
                body = code[m.end() : code.find("\n}", m.end()) + 1]
                props["methods"] = ",".join(re.findall(r"^\s+(\w+)\(", body, re.M))
            if language == "python":
                base = re.match(r"\s*\(([^)]*)\)", code[m.end() :])
                props["bases"] = re.sub(r"\s+", "", base.group(1)) if base else ""
            yield node(kind, name, line, line, package, language, _exported(name, language, head), head, "", **props)
            yield "edge", "Contains", own, f"{kind}:{path}:{name}"
    types = [(m.start(), m.group(1)) for kind, pattern in _TYPES[family] for m in re.finditer(pattern, code, re.M)]
    lines = code.split("\n")
    declared = []
    for name, line, end, signature, doc, _, body in functions_of(text, path):
        receiver = variable = ""
        if language == "go" and (m := re.match(r"func\s*\(\s*(?:(\w+)\s+)?\*?(\w+)", signature)):
            variable, receiver = m.group(1) or "", m.group(2)
        elif language != "go" and lines[line - 1][:1] in " \t" and types:
            before = [n for k, n in types if at(k) <= line]
            receiver = before[-1] if before else ""
        method = bool(receiver) and (language != "python" or re.search(r"\(\s*(self|cls)\b", signature) is not None)
        is_test = test and re.match(r"(?:Test|Benchmark|Example|Fuzz|test_|test[A-Z])", name) is not None
        kind = "TestFunction" if is_test else "Method" if method else "Function"
        declared.append((kind, name, line, end, signature, doc, body, receiver if method else "", variable, f"{kind}:{path}:{receiver + '.' if kind == 'Method' else ''}{name}"))
    calls = GoCalls(path, code, only_comments, {d[1]: d[9] for d in declared if d[0] != "Method"}, {(d[7], d[1]): d[9] for d in declared if d[0] == "Method"}) if language == "go" else None
    for kind, name, line, end, signature, doc, body, receiver, variable, key in declared:
        called, left = calls.of(body[body.find("{") :] if "{" in body else "", key, variable, receiver) if calls else ([], [])
        yield node(kind, name, line, end, package, language, _exported(name, language, signature), signature, doc, receiver=receiver, unresolved_calls=",".join(left))
        yield "edge", "Contains", own, key
        for target in called:
            yield "edge", "Calls", key, target
    seen = set()
    for pattern in _IMPORTS[family]:
        for m in re.finditer(pattern, only_comments, re.M):
            if m.group(1) not in seen:
                seen.add(m.group(1))
                yield node("Dependency", m.group(1), at(m.start(1)), 0, package, language, kind="use" if language == "rust" else "import")
                yield "edge", "Imports", own, f"Dependency:{path}:{m.group(1)}"
    for patterns, kind, edge in ((_ROUTES, "APIEndpoint", "Exposes"), (_CLIENTS, "Dependency", "Consumes")):
        for pattern, fam in patterns:
            if fam != family:
                continue
            for m in re.finditer(pattern, only_comments):
                verb, where = (m.group(1).upper(), m.group(2)) if m.lastindex == 2 else ("ANY", m.group(1))
                name = f"{verb} {where}"
                props = {"http_method": verb, "path": where} | ({"kind": "api_call"} if kind == "Dependency" else {})
                yield node(kind, name, at(m.start()), 0, package, language, True, "", "", **props)
                if edge == "Exposes":
                    yield "edge", edge, own, f"{kind}:{path}:{name}"


def python_declarations(text: str) -> list[tuple[str, str, int]]:
    """(kind, name, line) from Python's own parser; for checks of the lexer. [] where the text doesn't parse."""
    try:
        tree = ast.parse(text)
    except SyntaxError:
        return []
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    return [(kinds[type(n)], n.name, n.lineno) for n in ast.walk(tree) if type(n) in kinds]


# ---- Text formats ---------------------------------------------------------------------------------------------------------

# Files that instruct assistants.
GUIDELINES = {"CLAUDE.md", "AGENTS.md", "GEMINI.md", "COPILOT.md", "AI.md"}


MARKERS = {"TODO", "FIXME", "HACK", "XXX"}
ELSEWHERE = ("http:", "https:", "mailto:", "#")


def _links(line: str):
    """(label, target) of a line's inline links. A label begins at the first bracket since the last closing one; a target
    ends at the first parenthesis and isn't empty."""
    at = middle = 0
    while (middle := line.find("](", max(at, middle))) >= 0:
        opening = line.find("[", max(at, line.rfind("]", at, middle) + 1), middle)
        end = line.find(")", middle)
        if opening < 0 or end <= middle + 2:
            middle += 1
            continue
        yield line[opening + 1 : middle], line[middle + 2 : end]
        at = end + 1


@register("md", "markdown")
def parse_markdown(path: str, text: str):
    base = path.rsplit("/", 1)[-1]
    kind = "AIGuideline" if base in GUIDELINES else "Document"
    lines = text.split("\n")
    own, start = f"{kind}:{path}:{path}", 0
    front = {}
    if lines and lines[0].strip() == "---":
        end = next((k for k in range(1, len(lines)) if lines[k].strip() == "---"), 0)
        for x in lines[1:end]:
            if ":" in x:
                a, b = x.split(":", 1)
                front["fm_" + a.strip()] = b.strip().strip("\"'")
        start = end + 1 if end else 0
    yield node(kind, path, 1, len(lines), "", "markdown", False, "", text, **front)
    fence, opened = "", 0
    for k in range(start, len(lines)):
        s = lines[k]
        if fence:
            if re.fullmatch(r"```\s*", s):
                yield node("Document", f"code-block:{opened}", opened, k + 1, "", "markdown", kind="code-block", lang=fence.strip() or "text")
                fence = ""
            continue
        if m := re.fullmatch(r"```(\w*)\s*", s):
            fence, opened = m.group(1) or " ", k + 1
            continue
        if m := re.match(r"(#{1,6})\s+(.+)$", s):
            yield node("Document", m.group(2).strip(), k + 1, 0, "", "markdown", kind="section", level=len(m.group(1)))
            yield "edge", "Contains", own, f"Document:{path}:{m.group(2).strip()}"
        for label, target in _links(s):
            if not target.startswith(ELSEWHERE):
                yield node("Dependency", target, k + 1, 0, "", "markdown", kind="cross-reference", text=label)
                yield "edge", "DependsOn", own, f"Dependency:{path}:{target}"
        for word in re.finditer(r"\w+", s):
            if (marker := word.group().upper()) in MARKERS:
                yield node("Document", f"{marker}:{k + 1}", k + 1, 0, "", "markdown", False, "", s[word.end() :].lstrip(": \t\r\f\v"), kind="todo", marker=marker)
                break


@register("html", "htm", "vue", "svelte", "jinja", "jinja2", "j2", "tmpl")
def parse_html(path: str, text: str):
    own = f"File:{path}:{path}"
    at = lambda k: text.count("\n", 0, k) + 1
    yield node("File", path, 1, text.count("\n") + 1, "", "html", True)
    attr = lambda tag, name: (re.search(rf"\b{name}\s*=\s*[\"']([^\"']*)[\"']", tag, re.I) or [None, ""])[1]
    for m in re.finditer(r"<(script|link|form|meta|[a-z]+-[a-z0-9-]+)\b([^>]*)>", text, re.I):
        tag, rest = m.group(1).lower(), m.group(2)
        if tag == "script" and attr(rest, "src"):
            dep = ("Dependency", attr(rest, "src"), "script")
        elif tag == "link" and attr(rest, "href"):
            rel = attr(rest, "rel").lower()
            dep = ("Dependency", attr(rest, "href"), "stylesheet" if "stylesheet" in rel else "icon" if "icon" in rel else "link")
        elif tag == "form" and attr(rest, "action"):
            verb = (attr(rest, "method") or "GET").upper()
            yield node("APIEndpoint", f"{verb} {attr(rest, 'action')}", at(m.start()), 0, "", "html", True, http_method=verb, path=attr(rest, "action"), kind="form")
            yield "edge", "Consumes", own, f"APIEndpoint:{path}:{verb} {attr(rest, 'action')}"
            continue
        elif tag == "meta" and attr(rest, "name"):
            yield node("Variable", attr(rest, "name"), at(m.start()), 0, "", "html", kind="meta", content=attr(rest, "content"))
            continue
        elif "-" in tag:
            dep = ("Dependency", tag, "component")
        else:
            continue
        yield node(dep[0], dep[1], at(m.start()), 0, "", "html", kind=dep[2])
        yield "edge", "DependsOn", own, f"Dependency:{path}:{dep[1]}"
    for kind, pattern in (("extends", r"\{%[-\s]*extends\s+[\"']([^\"']+)"), ("include", r"\{%[-\s]*include\s+[\"']([^\"']+)"), ("import", r"\{%[-\s]*(?:from|import)\s+[\"']([^\"']+)"), ("template", r"\{\{[-\s]*(?:template|block)\s+\"([^\"]+)")):
        for m in re.finditer(pattern, text):
            yield node("Dependency", m.group(1), at(m.start()), 0, "", "html", kind=kind)
            yield "edge", "DependsOn", own, f"Dependency:{path}:{m.group(1)}"
    if path.endswith((".vue", ".svelte")):
        for m in re.finditer(r"<(template|script|style)\b([^>]*)>", text):
            yield node("Document", m.group(1), at(m.start()), 0, "", "html", kind=path.rsplit(".", 1)[-1] + "-section", lang=attr(m.group(2), "lang"))


@register("mk", names=("Makefile", "makefile", "GNUmakefile"))
def parse_makefile(path: str, text: str):
    yield node("File", path, 1, text.count("\n") + 1, "", "makefile", True)
    own, doc, phony = f"File:{path}:{path}", "", set()
    for m in re.finditer(r"^\.PHONY:\s*(.+)$", text, re.M):
        phony |= set(m.group(1).split())
    for k, s in enumerate(text.split("\n"), 1):
        if m := re.match(r"##\s*(.+)$", s):
            doc = m.group(1)
        elif m := re.match(r"([A-Za-z_]\w*)\s*(?:[?:+]?=)\s*(.*)$", s):
            yield node("Variable", m.group(1), k, 0, "", "makefile", kind="makefile_var", value=m.group(2))
        elif m := re.match(r"-?include\s+(.+)$", s):
            for x in m.group(1).split():
                yield node("Dependency", x, k, 0, "", "makefile", kind="include")
                yield "edge", "DependsOn", own, f"Dependency:{path}:{x}"
        elif not s.startswith(".") and (m := re.match(r"([\w./%+-]+(?:\s+[\w./%+-]+)*):(?!=)\s*([^#]*)", s)):
            needs = m.group(2).split("##")[0].strip()
            for t in m.group(1).split():
                yield node("Function", t, k, 0, "", "makefile", True, s.strip(), doc, kind="target", prerequisites=needs, phony="true" if t in phony else "")
                yield "edge", "Contains", own, f"Function:{path}:{t}"
                for p in needs.split():
                    yield "edge", "DependsOn", f"Function:{path}:{t}", f"Function:{path}:{p}"
            doc = ""


@register("sh", "bash")
def parse_shell(path: str, text: str):
    yield node("File", path, 1, text.count("\n") + 1, "", "shell", True)
    own = f"File:{path}:{path}"
    for k, s in enumerate(text.split("\n"), 1):
        if m := re.match(r"\s*(?:function\s+)?([\w-]+)\s*\(\)\s*\{?|\s*function\s+([\w-]+)", s):
            name = m.group(1) or m.group(2)
            yield node("Function", name, k, 0, "", "shell", True, s.strip(), kind="function")
            yield "edge", "Contains", own, f"Function:{path}:{name}"
        elif m := re.match(r"(?:export\s+|readonly\s+)?([A-Za-z_]\w*)=(.*)$", s):
            yield node("Variable", m.group(1), k, 0, "", "shell", s.startswith("export"), kind="shell_var", value=m.group(2).strip("\"'"))
        elif m := re.match(r"\s*(?:source|\.)\s+([^\s;]+)", s):
            yield node("Dependency", m.group(1).strip("\"'"), k, 0, "", "shell", kind="source")
            yield "edge", "DependsOn", own, f"Dependency:{path}:{m.group(1).strip(chr(34) + chr(39))}"


@register("tf", "tfvars")
def parse_terraform(path: str, text: str):
    yield node("File", path, 1, text.count("\n") + 1, "", "terraform", True)
    own = f"File:{path}:{path}"
    kinds = {"resource": ("Struct", "resource"), "data": ("Struct", "data_source"), "module": ("Module", "module"), "variable": ("Variable", "terraform_var"), "output": ("Constant", "output"), "provider": ("Dependency", "provider")}
    for m in re.finditer(r"^(resource|data|module|variable|output|provider)\s+\"([^\"]+)\"(?:\s+\"([^\"]+)\")?\s*\{", text, re.M):
        kind, sub = kinds[m.group(1)]
        name = f"{m.group(2)}.{m.group(3)}" if m.group(3) else m.group(2)
        line = text.count("\n", 0, m.start()) + 1
        yield node(kind, name, line, 0, "", "terraform", True, kind=sub)
        yield "edge", "Contains", own, f"{kind}:{path}:{name}"
        if m.group(1) == "module" and (s := re.search(r"\bsource\s*=\s*\"([^\"]+)\"", text[m.end() : m.end() + 2000])):
            yield node("Dependency", s.group(1), line, 0, "", "terraform", kind="module_source")
            yield "edge", "DependsOn", f"{kind}:{path}:{name}", f"Dependency:{path}:{s.group(1)}"
    if path.endswith(".tfvars"):
        for m in re.finditer(r"^(\w+)\s*=\s*(.+)$", text, re.M):
            yield node("Variable", m.group(1), text.count("\n", 0, m.start()) + 1, 0, "", "terraform", kind="terraform_var", value=m.group(2).strip())


@register("yml", "yaml")
def parse_yaml(path: str, text: str):
    """Workflow files (jobs, steps, actions, triggers), playbooks (plays, tasks, handlers, roles) and top keys of others,
    by indentation."""
    lines = text.split("\n")
    workflow = ".github/workflows/" in path or (re.search(r"^on:", text, re.M) and re.search(r"^jobs:", text, re.M))
    playbook = not workflow and re.search(r"^-\s+(?:name|hosts):", text, re.M) and re.search(r"^\s+(?:tasks|roles|hosts|handlers):|^-\s+hosts:", text, re.M)
    yield node("Document" if workflow else "File", path, 1, len(lines), "", "yaml", True, kind="workflow" if workflow else "ansible" if playbook else "yaml")
    section, job, mode = "", "", ""
    for k, s in enumerate(lines, 1):
        if not s.strip() or s.lstrip().startswith("#"):
            continue
        indent = len(s) - len(s.lstrip())
        m = re.match(r"\s*(?:-\s+)?([\w.-]+):\s*(.*)$", s)
        value = m.group(2).strip().strip("\"'") if m else ""
        if m and indent == 0 and not s.startswith("-"):
            section = m.group(1)
            if not workflow and not playbook:
                yield node("Variable", section, k, 0, "", "yaml", kind="yaml_key", value=value[:200])
            if workflow and section == "on":
                for t in re.findall(r"\w+", value):
                    yield node("Variable", t, k, 0, "", "yaml", kind="gha_trigger")
            continue
        if workflow and m:
            if section == "on" and indent == 2:
                yield node("Variable", m.group(1), k, 0, "", "yaml", kind="gha_trigger")
            elif section == "jobs" and indent == 2:
                job = m.group(1)
                yield node("Function", job, k, 0, "", "yaml", True, kind="gha_job")
            elif section == "jobs" and m.group(1) == "uses":
                yield node("Dependency", value, k, 0, "", "yaml", kind="gha_action")
                yield "edge", "DependsOn", f"Function:{path}:{job}", f"Dependency:{path}:{value}"
            elif section == "jobs" and m.group(1) == "name" and s.lstrip().startswith("-"):
                yield node("Function", f"{job}/{value}", k, 0, "", "yaml", kind="gha_step")
                yield "edge", "Contains", f"Function:{path}:{job}", f"Function:{path}:{job}/{value}"
        elif playbook:
            if s.startswith("- ") and m:
                mode = "play"
                yield node("Function", value or f"play:{k}", k, 0, "", "yaml", True, kind="ansible_play")
            elif m and m.group(1) in ("tasks", "handlers", "roles", "vars") and not s.lstrip().startswith("-"):
                mode = m.group(1)
            elif mode in ("tasks", "handlers") and m and m.group(1) == "name" and s.lstrip().startswith("-"):
                yield node("Function", value, k, 0, "", "yaml", kind="ansible_task" if mode == "tasks" else "ansible_handler")
            elif mode == "roles" and s.lstrip().startswith("-"):
                role = value if m and m.group(1) == "role" else s.strip()[1:].strip()
                yield node("Dependency", role, k, 0, "", "yaml", kind="ansible_role")
            elif mode == "vars" and m:
                yield node("Variable", m.group(1), k, 0, "", "yaml", kind="ansible_var", value=value)


@register(names=tuple(NAMES))
def parse_manifest(path: str, text: str):
    yield node("File", path, 1, text.count("\n") + 1, "", "manifest", True)
    own = f"File:{path}:{path}"
    for kind, name, version, line, ecosystem, scope in read_manifest(path, text):
        if kind == "service":
            yield node("Service", name, line, 0, "", "manifest", True, kind="service", version=version, ecosystem=ecosystem)
            yield "edge", "Contains", own, f"Service:{path}:{name}"
        else:
            yield node("Dependency", name, line, 0, "", "manifest", kind=kind, version=version, ecosystem=ecosystem, scope=scope)
            yield "edge", "DependsOn", own, f"Dependency:{path}:{name}"


def parse_other(path: str, text: str):
    """Fallback: one document node whose package is the directory."""
    yield node("Document", path, 1, text.count("\n") + 1, path.rsplit("/", 1)[0] if "/" in path else ".", "", False, "", text, kind="text", content_hash="sha256:" + hashlib.sha256(text.encode("utf-8", "replace")).hexdigest())


def parser_for(path: str) -> Callable:
    base = path.rsplit("/", 1)[-1]
    return _BY_NAME.get(base) or _BY_SUFFIX.get(base.rsplit(".", 1)[-1].lower() if "." in base else "") or parse_other


def records(path: str, text: str, raw: bytes | None = None):
    """ROWS of one file. Parsers see line feeds only; a content hash is of the file as it is."""
    for r in parser_for(path)(path, text.replace("\r\n", "\n")):
        if r[0] == "node":
            _, kind, name, line, end, package, language, exported, signature, doc, props = r
            if "content_hash" in props:
                props["content_hash"] = "sha256:" + hashlib.sha256(text.encode("utf-8", "replace") if raw is None else raw).hexdigest()
            qualified = f"{package}.{props['receiver']}.{name}" if props.get("receiver") else f"{package}.{name}" if package else name
            within = f"{props['receiver']}." if kind == "Method" and props.get("receiver") else ""
            yield ("node", key_id(f"{kind}:{path}:{within}{name}"), kind, name, qualified, path, line, end or line, package, language, exported, signature, doc, props, "", "")
        else:
            _, kind, a, b = r
            s, t = key_id(a), key_id(b)
            yield ("edge", key_id(f"{kind}:{s}:{t}"), kind, "", "", path, 0, 0, "", "", False, "", "", {}, s, t)


def extract(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """ROWS of all files; null paths give none, broken UTF-8 is replaced, repeated rows of a file repeat its records.
    Binary files (a zero byte among the first 512) are skipped."""
    from .files import is_binary

    ship(files.sparkSession)

    def run(frames):
        for pdf in frames:
            out = []
            for p, c in zip(pdf["path"], pdf["content"]):
                is_bytes = isinstance(c, (bytes, bytearray))
                out.extend(records(p, c.decode("utf-8", "replace") if is_bytes else c or "", bytes(c) if is_bytes else None))
            yield pd.DataFrame(out, columns=_COLUMNS)

    src = files.select(F.col(path).alias("path"), F.col(content).alias("content")).where("path is not null")
    if dict(files.dtypes)[content] == "binary":
        src = src.where(~is_binary(F.col("content")))
    return src.repartition(partitions(files.sparkSession)).mapInPandas(run, ROWS)


def graph_of(rows: DataFrame, branch: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of extracted rows on a branch; equal ids count once (the first line's node)."""
    n = rows.where("kind = 'node'").groupBy("id").agg(F.min_by(F.struct("type", "name", "qualified_name", "file_path", "line", "end_line", "package", "language", "exported", "signature", "doc_comment", "properties"), F.struct("line", "signature")).alias("r"))
    e = rows.where("kind = 'edge'").select(F.lit(branch).alias("branch"), "id", "type", "source_id", "target_id").distinct().withColumn("properties", F.lit(None).cast("map<string,string>"))
    return n.select(F.lit(branch).alias("branch"), "id", "r.*", F.lit(None).cast("map<string,double>").alias("metrics")), e
