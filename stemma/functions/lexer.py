"""A string- and comment-aware lexer for source text, and the functions found with it.

The lexer is a state machine over code, comments (nested where the language nests them), strings, templates with
code inside, heredocs and regular expression literals. In each state one pattern finds the next place where the state
can change, so a text is passed once and what lies between costs nothing. Braces and keywords inside strings and
comments don't count. Functions are delimited by matched braces (indentation in Python, keyword pairs in Ruby) and get
the documentation comment directly before them (the docstring in Python)."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Syntax:
    """How a language opens what is not code. Each opener is (pattern, state); the states are those of lex()."""

    line: str = "//"
    block: bool = True  # /* */
    nests: bool = False
    openers: tuple = ()
    tails: dict = field(default_factory=dict)


# The string forms of the languages. A state's pattern matches from its opening mark to the end of the
# string or, for "inside" states, to the next hole with code in it.
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\.)*"?', r"'(?:[^'\\\n]|\\.)*'?"
_SYNTAX = {
    "c": Syntax(openers=((r'"', _DOUBLE), (r"'", _SINGLE), (r"`", "template"), (r"/(?![/*])", "regex"))),
    "go": Syntax(openers=((r'"', _DOUBLE), (r"'", _SINGLE), (r"`", r"`[^`]*`?"))),
    "rust": Syntax(nests=True, openers=((r'\bb?r(?=#*")', r'b?r(?P<h>#*)".*?(?:"(?P=h)|\Z)'), (r'"', r'"(?:[^"\\]|\\.)*"?'), (r"'", r"'(?:[^'\\\n]|\\[^\n']{1,10}|\\')'|'"))),
    "java": Syntax(openers=((r'"""', r'"""(?:[^\\]|\\.)*?(?:"""|\Z)'), (r'"', _DOUBLE), (r"'", _SINGLE))),
    "cs": Syntax(openers=((r'\$*"""', r'\$*"""(?:.*?)(?:"""|\Z)'), (r'(?:\$?@|@\$)"', r'(?:\$?@|@\$)"(?:[^"]|"")*"?'), (r'\$?"', r"\$?" + _DOUBLE), (r"'", _SINGLE))),
    "python": Syntax(line="#", block=False, openers=(
        (r'\b[rRbBuUfFtT]{1,2}(?=["\'])|(?=["\'])', r'[rRbBuUfFtT]{0,2}(?:"""(?:[^\\]|\\.)*?(?:"""|\Z)|\'\'\'(?:[^\\]|\\.)*?(?:\'\'\'|\Z)|"(?:[^"\\\n]|\\.)*"?|\'(?:[^\'\\\n]|\\.)*\'?)'),)),
    "ruby": Syntax(line="#", block=False, openers=(
        (r"^=begin\b", r"=begin\b.*?(?:^=end[^\n]*|\Z)"), (r"<<[~-]?(?=[A-Z_\"'])", "heredoc"), (r'"', "ruby_string"), (r"'", r"'(?:[^'\\]|\\.)*'?"), (r"%[wWiIqQ][\[({<]", "bracketed"), (r"/(?![/*=\s])", "regex"))),
}
_FAMILY = {"py": "python", "pyi": "python", "rb": "ruby", "go": "go", "rs": "rust", "java": "java", "cs": "cs", "kt": "java"}
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of|do|else|yield|await|void|delete|if|unless|when|and|or|not))\s*\Z")
_HEREDOC = re.compile(r"<<([~-]?)([\"']?)([A-Za-z_]\w*)\2")
_BLOCK = {False: re.compile(r"\*/"), True: re.compile(r"/\*|\*/")}
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(?:(?P<end>`)|(?P<hole>\$\{)|\Z)", re.S)
_RUBY_STRING = re.compile(r'(?:[^"\\#]|\\.|#(?!\{))*(?:(?P<end>")|(?P<hole>#\{)|\Z)', re.S)
_CLOSING = {"[": "]", "(": ")", "{": "}", "<": ">"}
_MACHINES: dict = {}


def _machine(kind: str):
    """(pattern that finds the next opener, the same with braces for holes, patterns of the strings by group)."""
    if kind not in _MACHINES:
        s = _SYNTAX[kind]
        parts = [f"(?P<line>{s.line})"] + ([r"(?P<block>/\*)"] if s.block else [])
        parts += [f"(?P<s{k}>{opener})" for k, (opener, _) in enumerate(s.openers)]
        forms = {f"s{k}": form if form in ("template", "regex", "heredoc", "ruby_string", "bracketed") else re.compile(form, re.S | re.M) for k, (_, form) in enumerate(s.openers)}
        _MACHINES[kind] = re.compile("|".join(parts), re.M), re.compile("|".join([*parts, r"(?P<open>\{)|(?P<close>\})"]), re.M), forms, s
    return _MACHINES[kind]


def family(path: str, language: str | None = None) -> str:
    """The lexer for a path's suffix; unknown ones are read like C."""
    return _FAMILY.get(path.rsplit(".", 1)[-1].lower() if "." in path else "", "c")


def _block_end(text: str, at: int, nests: bool) -> int:
    depth = 1
    for m in _BLOCK[nests].finditer(text, at):
        depth += 1 if m.group() == "/*" else -1
        if depth == 0:
            return m.end()
    return len(text)


def _bracketed_end(text: str, at: int, opening: str) -> int:
    depth = 1
    for m in re.compile("[" + re.escape(opening + _CLOSING[opening]) + "]").finditer(text, at):
        depth += 1 if m.group() == opening else -1
        if depth == 0:
            return m.end()
    return len(text)


def lex(text: str, kind: str):
    """(what, from, to) of all strings and comments, in order; the rest is code. What is never closed runs to the end of
    its line or, if it may span lines, of the text."""
    plain, within, forms, syntax = _machine(kind)
    holes: list = []  # of every string whose hole we are in: its pattern and the depth of braces since
    at, size = 0, len(text)
    while at < size:
        m = (within if holes else plain).search(text, at)
        if not m:
            return
        what, a = m.lastgroup, m.start()
        if what in ("open", "close"):
            at = m.end()
            holes[-1][1] += 1 if what == "open" else -1
            if holes[-1][1] >= 0:
                continue
            inside, _ = holes.pop()
            m = inside.match(text, at)
            yield "string", a, m.end()
            if m.group("hole"):
                holes.append([inside, 0])
            at = m.end()
        elif what == "line":
            end = text.find("\n", a)
            at = size if end < 0 else end
            yield "comment", a, at
        elif what == "block":
            at = _block_end(text, a + 2, syntax.nests)
            yield "comment", a, at
        else:
            form = forms[what]
            if form in ("template", "ruby_string"):
                inside = _TEMPLATE if form == "template" else _RUBY_STRING
                m = inside.match(text, a + 1)
                if m.group("hole"):
                    holes.append([inside, 0])
                at = m.end()
            elif form == "regex":
                m = _REGEX.match(text, a)
                line = text.rfind("\n", 0, a) + 1
                if not m or not _BEFORE_REGEX.search(text[max(line, a - 40) : a]):
                    at = a + 1
                    continue
                at = m.end()
            elif form == "heredoc":
                m = _HEREDOC.match(text, a)
                body = text.find("\n", a)
                if not m or body < 0:
                    at = a + 2
                    continue
                end = re.compile(rf"^{'[ \t]*' if m.group(1) else ''}{m.group(3)}[ \t]*$", re.M).search(text, body + 1)
                if not end:
                    at = a + 2
                    continue
                yield "string", body + 1, end.end()
                at = end.end()
                continue
            elif form == "bracketed":
                at = _bracketed_end(text, m.end(), text[m.end() - 1])
            else:
                at = form.match(text, a).end()
            if kind == "ruby" and text.startswith("=begin", a):
                yield "comment", a, at
            elif at - a > 1 or text[a] != "'" or kind != "rust":
                yield "string", a, at


_NAME_BEFORE = r"(?P<name>[A-Za-z_$][\w$]*)"
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "new", "function", "else", "do", "try", "using", "lock", "foreach", "match", "sizeof", "typeof", "await", "throw", "super", "this"}
_HEADS = {
    "go": re.compile(rf"^[ \t]*func\s*(?:\([^)]*\)\s*)?{_NAME_BEFORE}\s*(?:\[[^\]]*\])?\(", re.M),
    "rust": re.compile(rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+|extern\s+\S+\s+)*fn\s+{_NAME_BEFORE}\s*[(<]", re.M),
    "python": re.compile(rf"^[ \t]*(?:async\s+)?def\s+{_NAME_BEFORE}\s*\(", re.M),
    "ruby": re.compile(r"^[ \t]*def\s+(?:self\.)?(?P<name>[\w]+[?!=]?)", re.M),
    "java": re.compile(rf"^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|sealed|synchronized|default|native|unsafe|partial|extern|new)\s+)+(?:<[^>]+>\s*)?(?:[\w.$\[\]?]+(?:<[^;{{}}()]*>)?(?:\[\])*\s+)?{_NAME_BEFORE}\s*(?:<[^>]*>)?\(", re.M),
    "c": re.compile(
        rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_NAME_BEFORE}\s*(?:<[^>]*>)?\("
        r"|^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<arrow>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:function\b|\([^()\n]*\)\s*(?::[^=\n]+)?=>|[\w$]+\s*=>)"
        r"|^[ \t]*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?P<method>[\w$]+)\s*(?:<[^>]*>)?\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)\s*(?::\s*[^{\n;]+)?\{", re.M),
}
_HEADS["cs"] = _HEADS["java"]
_LINE = re.compile(r"^([ \t]*)\S.*$", re.M)


def masked(text: str, tokens) -> str:
    """The text with strings and comments blanked out, line ends kept; offsets stay the same."""
    out, at = [], 0
    for _, a, b in tokens:
        out.append(text[at:a])
        piece = text[a:b]
        out.append(re.sub(r"[^\n]", " ", piece) if "\n" in piece else " " * (b - a))
        at = b
    out.append(text[at:])
    return "".join(out)


class Brackets:
    """Which bracket closes which, from one pass over code without strings and comments. Braces and parentheses are
    matched apart from each other, so a fault in one kind leaves the other right."""

    def __init__(self, code: str):
        self.size, self.at, self.closes = len(code), {"{": [], "(": []}, {}
        waiting: dict = {"{": [], "(": []}
        for m in re.finditer(r"[{}()]", code):
            c = m.group()
            if c in "{(":
                self.at[c].append(m.start())
                waiting[c].append(m.start())
            elif waiting["{" if c == "}" else "("]:
                self.closes[waiting["{" if c == "}" else "("].pop()] = m.end()

    def end(self, at: int, opening: str) -> int:
        """Offset after the bracket that closes the first one at or after `at`; the end of the text if none does."""
        k = bisect.bisect_left(self.at[opening], at)
        return self.closes.get(self.at[opening][k], self.size) if k < len(self.at[opening]) else self.size


def _body(code: str, m, kind: str, brackets: Brackets) -> tuple[int, int]:
    """(end of the signature, end of the function)."""
    start = m.start() + len(m.group()) - len(m.group().lstrip())
    if kind == "ruby":
        line_end = code.find("\n", m.end())
        depth, pos = 1, line_end if line_end >= 0 else len(code)
        words = re.compile(r"^[ \t]*(?:class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?[ \t]*$|^[ \t]*end\b|=[ \t]*(?:if|case|begin)\b", re.M)
        for w in words.finditer(code, pos):
            depth += -1 if w.group().strip() == "end" else 1
            if depth == 0:
                return pos, w.end()
        return pos, len(code)
    opening = code.find("(", m.end() - 1 if code[m.end() - 1 : m.end()] == "(" else m.start())
    close = brackets.end(opening, "(") if opening >= 0 else m.end()
    if kind == "python":
        colon = code.find(":", close)
        colon = len(code) if colon < 0 else colon
        indent = len(m.group()) - len(m.group().lstrip(" \t"))
        first = code.find("\n", colon)
        for line in _LINE.finditer(code, first + 1) if first >= 0 else ():
            if len(line.group(1)) <= indent:
                return colon, colon + len(code[colon : line.start()].rstrip())
        return colon, len(code.rstrip())
    brace = code.find("{", close if m.group()[-1:] != "{" else m.end() - 1)
    semicolon = code.find(";", close)
    if brace < 0 or 0 <= semicolon < brace:
        end = semicolon + 1 if semicolon >= 0 else len(code)
        return end, end
    return brace, brackets.end(max(brace, start), "{")


def functions_of(text: str, path: str):
    """(name, line, end_line, signature, doc, code, body) of every function of a file; doc is the comment attached to
    it as written, body its code with strings and comments blanked out."""
    kind = family(path)
    tokens = list(lex(text, kind))
    code = masked(text, tokens)
    brackets = Brackets(code)
    ends = [i for i, c in enumerate(text) if c == "\n"] if len(text) < 1 << 16 else [m.start() for m in re.finditer("\n", text)]
    line_of = lambda at: bisect.bisect_left(ends, at) + 1
    comments = [(a, b) for what, a, b in tokens if what == "comment"]
    comment_ends = [b for _, b in comments]
    strings = {a: b for what, a, b in tokens if what == "string"}
    for m in _HEADS[kind].finditer(code):
        groups = m.groupdict()
        name = groups.get("name") or groups.get("arrow") or groups.get("method")
        if name in _NOT_CALLS:
            continue
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        sig_end, end = _body(code, m, kind, brackets)
        doc = ""
        if kind == "python":
            k = re.compile(r"\s*").match(text, sig_end + 1).end()
            for a in (k, k + 1, k + 2):
                if a in strings and text[k:a].isalpha() | (a == k):
                    doc = text[k : strings[a]]
                    break
        if not doc:
            # Comments that touch the function (annotations may stand between), upwards while only blanks part them.
            at, parts = start, []
            i = bisect.bisect_right(comment_ends, start) - 1
            while i >= 0:
                a, b = comments[i]
                gap = code[b:at]
                if not re.fullmatch(r"\s*(?:(?:@\w+(?:\([^)]*\))?|#\[[^\]]*\]|\[[\w(), \"=]*\])\s*)*", gap) or gap.count("\n") > (1 if parts or not gap.strip() else 9):
                    break
                if code[code.rfind("\n", 0, a) + 1 : a].strip():
                    break
                parts.append(text[a:b])
                at, i = a, i - 1
            doc = "\n".join(reversed(parts))
        yield name, line_of(start), line_of(max(start, end - 1)), " ".join(text[start:sig_end].split()), doc, text[start:end], code[start:end]
