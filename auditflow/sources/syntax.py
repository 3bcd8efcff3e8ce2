"""Syntax of source files as a table of nodes.

A worker reads one file at a time and gives its nodes: functions, types, control structures, calls,
assignments, and what else rules ask for.  Every node carries its pre- and post-order number and the
last pre below it, so one node lies inside another if its pre is in that range, and the functions,
types and control structures around it as an array (or other kinds, where they are asked for), so
that most questions need no join at all.  Everything else (scores, depths, rules, flows) is column
expressions and aggregates over that table.

Python goes by its own parser.  The languages with braces share one error-tolerant reader.  Its
lexer has modes: comments (nested where the language nests them), raw and multi-line strings,
templates whose holes are code again, regular expressions where a value may start, lifetimes.
Brackets are paired with what closes them; one without a partner ends where its parent ends.  The
reader then goes over statements by the language's keywords, and over expressions for the functions,
calls and operators in them.  Types and generics are only skipped.

Defined cases: null or empty text and unknown languages have no nodes.  Broken text gives the nodes
of what can be read: Python's lines with errors are read as pass, a bounded number of times.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BRACED = ("Rust", "Go", "Java", "Kotlin", "C#", "JavaScript", "TypeScript")
AROUND = "array<struct<pre:int,kind:string,word:string,name:string,marks:string,first:int>>"
SCHEMA = f"path string, language string, pre int, post int, kind string, word string, name string, marks string, first int, last int, upto int, around {AROUND}"
#: Kinds that are listed around the nodes inside them.
STRUCTURES = frozenset(("function", "type", "control", "elseif"))
#: Lines of broken Python that are passed over at most.
REPAIRS = 20

_CONTROL = {
    "Rust": "if for while loop match", "Go": "if for switch select", "Java": "if for while do switch try", "C#": "if for foreach while do switch try",
    "Kotlin": "if when for while do try", "JavaScript": "if for while do switch try", "TypeScript": "if for while do switch try",
}
_CONTROL = {k: frozenset(v.split()) for k, v in _CONTROL.items()}
_TYPES = frozenset("class interface enum record struct trait impl namespace object module mod union".split())
_LINES = ("Go", "Kotlin", "JavaScript", "TypeScript")  # where a line's end may end a statement
_VALUES = frozenset("return typeof case in of delete void throw new else do await yield".split())  # a regular expression may follow
_SCRIPT = ("JavaScript", "TypeScript")
_MODIFIERS = frozenset("public private protected internal static async virtual override sealed abstract partial readonly extern unsafe new".split())
#: Words that are no values.
_WORDS_ONLY = frozenset("const let var val mut ref return throw new import from export default await async yield typeof final static public private protected internal override package using if else for while do switch case in of is as fn fun func function class".split())
_NO_METHODS = frozenset("synchronized using lock return new catch fixed throw await typeof nameof".split())
_FLAT = frozenset(("Rust", "Kotlin", *_SCRIPT))  # where `else if` is no deeper than its `if`

_QUOTED = r"'(?:\\.|[^'\\\n])*'"
_DOUBLE = r'"(?:\\.|[^"\\\n])*"'
_STRINGS = {
    "Rust": r'b?r(?P<hash>#*)".*?"(?P=hash)|b?"(?:\\.|[^"\\])*"|' + r"b?'(?:\\(?:x..|u\{[^}]*\}|.)|[^'\\\n])'|'[A-Za-z_]\w*",
    "Go": rf"`[^`]*`|{_DOUBLE}|{_QUOTED}",
    "Java": rf'"""(?:\\.|.)*?"""|{_DOUBLE}|{_QUOTED}',
    "Kotlin": rf'(?P<hole>"""|")|{_QUOTED}',
    "C#": rf'@"(?:[^"]|"")*"|"""+.*?"""+|(?P<hole>\$@?"|@\$")|{_DOUBLE}|{_QUOTED}',
    "JavaScript": rf"(?P<hole>`)|{_DOUBLE}|{_QUOTED}",
}
_STRINGS["TypeScript"] = _STRINGS["JavaScript"]
_OPERATORS = r"[=!]==|=>|->|::|\?\.|\?\?|\?:|&&=?|\|\|=?|[-+*/%&|^!=<>:]=|\+\+|--|\.\.\.?|\S"
_MASTER = {k: re.compile(rf"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*)|(?P<string>{s})|(?P<ident>[A-Za-z_$@#][\w$]*|[^\W\d][\w$]*)|(?P<number>\d[\w.]*)|(?P<op>{_OPERATORS})", re.S) for k, s in _STRINGS.items()}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_HOLES = {"`": (re.compile(r"\\.|`|\$\{", re.S), "`"), '"': (re.compile(r'\\.|"|\$\{', re.S), '"'), '"""': (re.compile(r'"""|\$\{', re.S), '"""'), '$"': (re.compile(r'\\.|\{\{|"|\{', re.S), '"'), '$@"': (re.compile(r'""|\{\{|"|\{', re.S), '"')}
_NESTED = re.compile(r"/\*|\*/")
_PAIRS = {")": "(", "]": "[", "}": "{"}


class Tokens:
    """Text, line and kind of each token, whether a line ended before it, and brackets' partners."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.t: list[str] = []
        self.line: list[int] = []
        self.kind: list[str] = []
        self.fresh: list[bool] = []
        self._fresh = True
        self._read(0, len(text))
        self.match = self._partners()

    def _put(self, t: str, kind: str, at: int) -> None:
        self.t.append(t)
        self.kind.append(kind)
        self.line.append(bisect_right(self.breaks, at - 1) + 1)
        self.fresh.append(self._fresh)
        self._fresh = False

    def _read(self, at: int, end: int) -> None:
        master, text, script = _MASTER[self.language], self.text, self.language in _SCRIPT
        while at < end:
            m = master.match(text, at, end)
            kind, start, at = m.lastgroup, at, m.end()
            kind = "string" if kind in ("hash", "hole") else kind
            if kind == "space":
                self._fresh |= "\n" in m[0]
            elif kind == "comment":
                at = self._comment(start, end) if m[0] == "/*" else at
                self._fresh |= "\n" in text[start:at]
            elif kind == "string" and "hole" in m.groupdict() and m["hole"]:
                at = self._template(m["hole"].replace('@$"', '$@"'), start, at, end)
            elif kind == "op" and m[0][0] == "/" and script and self._value_may_start() and (r := _REGEX.match(text, start, end)):
                at = r.end()
                self._put("/re/", "string", start)
            else:
                self._put(m[0], kind, start)

    def _comment(self, start: int, end: int) -> int:
        if self.language not in ("Rust", "Kotlin"):
            close = self.text.find("*/", start + 2, end)
            return end if close < 0 else close + 2
        depth = 0
        for m in _NESTED.finditer(self.text, start, end):
            depth += 1 if m[0] == "/*" else -1
            if not depth:
                return m.end()
        return end

    def _value_may_start(self) -> bool:
        if not self.t:
            return True
        last, kind = self.t[-1], self.kind[-1]
        return last in _VALUES or kind == "op" and (last not in (")", "]", "}") or last == "}" and self._fresh)

    def _template(self, opening: str, start: int, at: int, end: int) -> int:
        """A string with holes: the string, then each hole's code in brackets of its own."""
        pattern, closing = _HOLES[opening]
        self._put(opening, "string", start)
        while m := pattern.search(self.text, at, end):
            at = m.end()
            if m[0] == closing:
                return at
            if m[0] in ("${", "{"):
                close = self._hole_end(at, end)
                self._put("(", "op", at - 1)
                self._read(at, close)
                self._put(")", "op", min(close, len(self.text) - 1))
                at = min(close + 1, end)
        return end

    def _hole_end(self, at: int, end: int) -> int:
        depth, master = 1, _MASTER[self.language]
        while at < end:
            m = master.match(self.text, at, end)
            if m.groupdict().get("hole"):
                pattern, closing = _HOLES[m["hole"].replace('@$"', '$@"')]
                at = m.end()
                while (inner := pattern.search(self.text, at, end)) and inner[0] != closing:
                    at = inner.end() if inner[0] not in ("${", "{") else self._hole_end(inner.end(), end) + 1
                at = inner.end() if inner else end
                continue
            depth += {"{": 1, "}": -1}.get(m[0], 0)
            if not depth:
                return at
            at = m.end()
        return end

    def _partners(self) -> list[int]:
        match, stack = [-1] * len(self.t), []
        opened = {"(": 0, "[": 0, "{": 0}
        for i, t in enumerate(self.t):
            if self.kind[i] != "op":
                continue
            if t in opened:
                stack.append(i)
                opened[t] += 1
            elif t in _PAIRS and opened[_PAIRS[t]]:
                while stack:
                    j = stack.pop()
                    opened[self.t[j]] -= 1
                    match[j] = i
                    if self.t[j] == _PAIRS[t]:
                        match[i] = j
                        break
        for j in stack:
            match[j] = len(self.t)
        stop = len(self.t)
        for j in range(len(self.t) - 1, -1, -1):  # a bracket that nothing closes ends before the next block or statement
            if self.kind[j] != "op":
                continue
            t = self.t[j]
            if t in ("{", "}", ";"):
                stop = j
            elif t in ("(", "[") and (match[j] == len(self.t) or _PAIRS.get(self.t[match[j]]) != t):
                match[j] = stop - 1
        return match


class Nodes:
    """Nodes in pre-order; open ones on a stack."""

    def __init__(self, structures: frozenset[str]):
        self.rows: list[list] = []
        self.open_: list[int] = []
        self.around: list[int] = []
        self.structures, self.posts = structures, 0

    def begin(self, kind: str, word: str, name: str, line: int, marks: str = "") -> int:
        pre = len(self.rows)
        self.rows.append([pre, -1, kind, word, name, marks, line, line, pre, self.around[:]])
        if kind in self.structures:
            self.around.append(pre)
        self.open_.append(pre)
        return pre

    def finish(self, pre: int, line: int) -> None:
        while self.open_:
            at = self.open_.pop()
            self.rows[at][1], self.posts = self.posts, self.posts + 1
            self.rows[at][7], self.rows[at][8] = max(self.rows[at][6], line), len(self.rows) - 1
            if self.around and self.around[-1] == at:
                self.around.pop()
            if at == pre:
                return

    def leaf(self, kind: str, word: str, name: str, line: int, marks: str = "") -> None:
        self.finish(self.begin(kind, word, name, line, marks), line)


def used_paths(t: list[str], i: int, end: int) -> list[tuple[str, str]]:
    """(path, name it gets) of each leaf of a tree of uses in tokens i to end; a glob's name is *."""
    out, prefixes, path, alias = [], [[]], [], None
    for x in t[i:end] + [","]:
        if x == "{":
            prefixes.append(prefixes[-1] + path)
            path = []
        elif x in (",", "}"):
            if path:
                full = prefixes[-1] + (path if path != ["self"] or not prefixes[-1] else [])
                out.append(("::".join(full), alias if isinstance(alias, str) and alias else full[-1]))
            path, alias = [], None
            if x == "}" and len(prefixes) > 1:
                prefixes.pop()
        elif x == "as":
            alias = ""
        elif x != "::":
            if alias is None:
                path.append(x)
            else:
                alias = x
    return out


class Braced:
    """Reads the statements of a language with braces."""

    def __init__(self, text: str, language: str, structures: frozenset[str] = STRUCTURES):
        self.k, self.nodes, self.language = Tokens(text, language), Nodes(structures), language
        self.t, self.match, self.control = self.k.t, self.k.match, _CONTROL[language]
        self.script = language in _SCRIPT
        self.inline = language in ("Rust", "Kotlin")  # control structures are expressions
        self.statements(0, len(self.t), "type" if language in ("Java", "C#") else "block")

    def tok(self, i: int) -> str:
        return self.t[i] if 0 <= i < len(self.t) else ""

    def ident(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.k.kind[i] == "ident"

    def ln(self, i: int) -> int:
        return self.k.line[min(max(i, 0), len(self.t) - 1)] if self.t else 1

    def close(self, i: int, end: int) -> int:
        return min(self.match[i] if self.match[i] >= 0 else end, end)

    # -- statements

    def statements(self, i: int, end: int, inside: str) -> None:
        while i < end:
            i = max(self.statement(i, end, inside), i + 1)

    def statement(self, i: int, end: int, inside: str) -> int:
        """Reads one statement, member or element from i; gives where the next begins."""
        t = self.tok(i)
        if self.k.kind[i] == "op":
            if t == "{":
                close = self.close(i, end)
                self.statements(i + 1, close, "block")
                return close + 1
            if t in ";,:)]}" or t in ("=>", "->") and not self.script:
                return i + 1
        marks, i = self.marks(i, end)
        if i >= end:
            return end
        if self.is_control(i) and inside != "object":
            return self.structure(i, end)
        if self.tok(i) == "else":
            return i + 1
        if self.tok(i) in ("case", "default") and inside == "block":
            return self.expression(i + 1, end, {":", "->", "=>"}) + 1
        return self.item(i, end, inside, marks)

    def marks(self, i: int, end: int) -> tuple[str, int]:
        """Attributes, annotations or decorators before an item; where it begins."""
        found = []
        while i < end:
            t, start = self.tok(i), i
            if self.language == "Rust" and t == "#" and self.tok(i + 1) in ("[", "!"):
                i = self.close(i + 1 + (self.tok(i + 1) == "!"), end) + 1
            elif self.language == "C#" and t == "[" and self.match[i] > i and (self.ident(self.match[i] + 1) or self.tok(self.match[i] + 1) == "["):
                i = self.match[i] + 1
            elif t.startswith("@") and len(t) > 1 and self.language != "C#" and t != "@interface":
                i += 1
                while self.tok(i) in (".", ":"):
                    i += 2
                if self.tok(i) == "(" and not self.k.fresh[i]:
                    i = self.close(i, end) + 1
            else:
                break
            found.append("".join(self.t[start:i]))
        return " ".join(found), i

    def is_control(self, i: int) -> bool:
        return self.ident(i) and self.t[i] in self.control and self.tok(i - 1) not in (".", "?.", "::") and self.tok(i + 1) not in (":", ",", "=", ")", ".", "=>", ";", "")

    def structure(self, i: int, end: int, alternative: bool = False) -> int:
        word, start = self.t[i], i
        counts = not (self.language == "Java" and word == "try" and self.tok(i + 1) == "(")
        kind = "elseif" if alternative and self.language in _FLAT else "control"
        node = self.nodes.begin(kind, word, "", self.ln(i)) if counts else None
        i += 1
        if self.tok(i) in ("await", "constexpr"):
            i += 1
        braces_only = self.language in ("Go", "Rust")
        if braces_only:
            i = self.header(i, end)
        elif self.tok(i) == "(" and word != "do":
            close = self.close(i, end)
            self.inner(i, close)
            i = close + 1
        if word in ("switch", "match", "select", "when") and self.tok(i) == "{":
            close = self.close(i, end)
            self.arms(i + 1, close) if word in ("match", "when") else self.statements(i + 1, close, "block")
            i = close + 1
        elif i < end:
            i = self.body(i, end)
        if word == "do" and self.tok(i) == "while":
            close = self.close(i + 1, end) if self.tok(i + 1) == "(" else i + 1
            self.inner(i + 1, close)
            i = close + 1
        while word == "try" and self.tok(i) in ("catch", "finally") and i < end:
            kind_, at = self.t[i], i
            i += 1
            caught = ""
            if self.tok(i) == "(":
                close = self.close(i, end)
                caught, i = " ".join(self.t[i + 1 : close]), close + 1
            if self.tok(i) == "when":
                i = self.close(i + 1, end) + 1
            inner = self.nodes.begin("catch", kind_, caught, self.ln(at))
            i = self.body(i, end)
            self.nodes.finish(inner, self.ln(i - 1))
        if word == "if" and self.tok(i) == ";" and self.language == "Kotlin" and self.tok(i + 1) == "else":
            i += 1
        if word == "if" and self.tok(i) == "else" and i < end:
            i += 1
            if self.is_control(i) and self.tok(i) == "if":
                i = self.structure(i, end, True)
            elif i < end:
                i = self.body(i, end)
        if node is not None:
            self.nodes.finish(node, self.ln(max(i - 1, start)))
        return i

    def body(self, i: int, end: int) -> int:
        if self.tok(i) == "{":
            close = self.close(i, end)
            self.statements(i + 1, close, "block")
            return close + 1
        i = self.statement(i, end, "block")
        return i + 1 if self.tok(i) == ";" and i < end else i

    def header(self, i: int, end: int) -> int:
        """What stands before the block of a structure; where the block begins."""
        at = i
        while at < end and not (self.t[at] == "{" and self.tok(at - 1) not in ("interface", "struct", "=>")):
            at = self.close(at, end) + 1 if self.t[at] in "([{" and self.k.kind[at] == "op" else at + 1
        at = min(at, end)
        while i < at:
            i = max(self.expression(i, at, {";", ","}), i) + 1
        return at

    def arms(self, i: int, end: int) -> None:
        """Patterns, whose guards are no structures, and what they lead to."""
        arrow = "=>" if self.language == "Rust" else "->"
        while i < end:
            at = i
            while at < end and self.t[at] != arrow:
                at = self.close(at, end) + 1 if self.t[at] in "([{" and self.k.kind[at] == "op" else at + 1
            self.expression(i, min(at, end), set(), plain=True)
            i = at + 1
            if i < end:
                i = self.body(i, end) if self.tok(i) == "{" or self.is_control(i) else self.expression(i, end, {","})
            while i < end and self.t[i] in (",", ";"):
                i += 1

    # -- items and expressions

    def item(self, i: int, end: int, inside: str, marks: str) -> int:
        """A declaration, or a statement that is an expression."""
        start, language = i, self.language
        if language == "Rust":
            if (f := self.word_before(i, end, "fn", ("{", ";", "=", "("))) is not None and self.ident(f + 1):
                return self.function(start, f + 1, end, marks)
            visible = i + 1 if self.tok(i) == "pub" else i
            visible = self.close(visible, end) + 1 if visible > i and self.tok(visible) == "(" else visible
            if self.tok(visible) == "use":
                at = i
                while at < end and self.t[at] != ";":
                    at += 1
                leading = "pub" if self.tok(i) == "pub" and self.tok(i + 1) == "use" else ""
                for path, name in used_paths(self.t, visible + 1, at):
                    self.nodes.leaf("use", leading, f"{path} as {name}", self.ln(i), marks)
                return at + 1
            if (f := self.word_before(i, end, "mod", ("{", ";", "=", "("))) is not None and self.tok(f + 2) == ";":
                self.nodes.leaf("mod", "pub" if self.tok(i) == "pub" else "", self.tok(f + 1), self.ln(i), marks)
                return f + 3
        elif language == "Go" and self.tok(i) == "func" and inside == "block":
            at = self.close(i + 1, end) + 1 if self.tok(i + 1) == "(" else i + 1
            if self.ident(at) and self.tok(at + 1) in ("(", "["):
                return self.function(start, at, end, marks)
        elif language == "Kotlin" and (f := self.word_before(i, end, "fun", ("{", "=", "("))) is not None:
            at = f + 1
            while at < end and self.t[at] != "(":
                at += 1
            if self.ident(at - 1) and at - 1 > f:
                return self.function(start, at - 1, end, marks)
        elif language in ("Java", "C#"):
            at = self.method_name(i, end, inside)
            if at is not None:
                return self.function(start, at, end, marks)
        elif self.script and inside in ("type", "object"):
            at = i
            while self.tok(at) in ("static", "async", "get", "set", "public", "private", "protected", "override", "readonly", "*", "export", "abstract") and self.tok(at + 1) not in ("(", "=", ":", ";"):
                at += 1
            name_end = self.close(at, end) if self.tok(at) == "[" else at
            after = self.skip_generics(name_end + 1, end)
            if self.tok(after) == "(" and self.k.kind[at] in ("ident", "string", "number", "op") and self.tok(at) != "(":
                brace = self.script_body(self.close(after, end) + 1, end)
                if brace is not None:
                    return self.scripted(start, after, brace, "".join(self.t[at : name_end + 1]).strip("'\""), end, marks)
        kind_at = self.type_word(i, end)
        if kind_at is not None:
            done = self.typed(start, kind_at, end, marks)
            if done is not None:
                return done
        if language == "Go" and self.tok(i) == "import":
            group = self.tok(i + 1) == "("
            stop = self.close(i + 1, end) if group else next((j for j in range(i + 1, end) if self.k.kind[j] == "string"), end - 1)
            for j in range(i + 1, min(stop + 1, end)):
                if self.k.kind[j] == "string":
                    self.nodes.leaf("import", "", self.t[j].strip('"`'), self.ln(j))
            return stop + 1
        if self.script and self.tok(i) == "export" and self.tok(i + 1) in ("{", "*", "type"):
            stop = i + 1
            while stop < end and self.k.kind[stop] != "string" and self.t[stop] not in (";", "=") and not (self.k.fresh[stop] and self.tok(stop - 1) == "}" and self.t[stop] != "from"):
                stop = self.close(stop, end) + 1 if self.t[stop] == "{" else stop + 1
            if self.tok(stop - 1) == "from" or self.tok(stop - 1) == "}" and self.tok(i + 1) != "type" or self.tok(i + 1) == "type" and self.tok(i + 2) == "{":
                more = stop + (self.tok(stop - 1) == "from")
                self.nodes.leaf("export", "", " ".join(self.t[i + 1 : min(more, end)]), self.ln(i))
                return more
        if self.script and self.tok(i) == "export":
            return self.statement(i + 1 + (self.tok(i + 1) == "default"), end, inside) if self.tok(i + 1) not in ("{", "*", "") else self.expression(i + 1, end, {";"}) + 1
        if self.language == "TypeScript" and self.tok(i) == "type" and self.ident(i + 1) and self.tok(i + 2) in ("=", "<"):
            while i < end and self.t[i] != ";" and not (self.k.fresh[i] and i > start and self.ends_line(i) and self.t[i] not in ("|", "&")):
                i = self.close(i, end) + 1 if self.t[i] in "([{" and self.k.kind[i] == "op" else i + 1
            return i
        if self.tok(i) in ("var", "let", "const", "val", "final"):
            self.nodes.leaf("declare", self.tok(i), self.tok(i + 1), self.ln(i))
        if self.tok(i) in ("throw", "import", "from", "return", "package", "using"):
            stop = i + 1
            braces = self.tok(i) == "import"
            while stop < min(end, i + 400) and self.t[stop] != ";" and (braces or self.t[stop] != "{") and not (self.k.fresh[stop] and self.language in _LINES and (not braces or self.tok(stop - 1) not in ("{", ",") and self.t[stop] not in ("}", "from"))):
                stop += 1
            told = self.t[i + 1 : min(stop, end)]
            told = told if self.script or self.tok(i) not in ("import", "using") else [t for t in told if t != "static"]
            self.nodes.leaf(self.tok(i), "", "".join(told[: told.index("as")] if language == "Kotlin" and "as" in told else told), self.ln(i))
        if self.ident(i) and self.tok(i + 1) == ":" and self.is_control(i + 2) and inside == "block":
            return i + 2  # a label
        stops = {";", ","} if inside == "object" else {";"}
        return self.expression(i, end, stops, inside=inside)

    def word_before(self, i: int, end: int, word: str, stops) -> int | None:
        """Where a word stands among an item's leading modifiers."""
        at = i
        while at < min(end, i + 12):
            t = self.t[at]
            if t == word and self.k.kind[at] == "ident":
                return at
            if t == "(" and self.tok(at - 1) in ("pub", "crate", "extern"):
                at = self.close(at, end)
            elif t in stops or self.k.kind[at] not in ("ident", "string") or at > i and self.k.fresh[at] and self.language == "Kotlin" and self.t[at] not in ("fun",) and not self.tok(at - 1).startswith("@") and self.tok(at - 1) not in ("override", "private", "public", "internal", "protected", "open", "suspend", "inline", "operator", "infix", "tailrec", "abstract"):
                return None
            at += 1
        return None

    def type_word(self, i: int, end: int) -> int | None:
        """Where the word of a type's declaration stands, behind modifiers only."""
        at = i
        while at < min(end, i + 8):
            if self.tok(at) == "(" and self.tok(at - 1) == "pub":
                at = self.close(at, end) + 1
                continue
            if not self.ident(at) or at > i and self.k.fresh[at] and self.language in _LINES:
                return None
            if self.t[at] in _TYPES and (self.ident(at + 1) or self.tok(at + 1) in ("<", "{", "(")):
                return at
            if self.t[at] in ("return", "new", "throw", "await"):
                return None
            at += 1
        return None

    def skip_generics(self, i: int, end: int) -> int:
        if self.tok(i) != "<":
            return i
        depth = 0
        for j in range(i, min(end, i + 200)):
            depth += {"<": 1, ">": -1}.get(self.t[j], 0)
            if self.t[j] in ("{", ";"):
                break
            if not depth:
                return j + 1
        return i

    def method_name(self, i: int, end: int, inside: str) -> int | None:
        """Where the name stands of a method or constructor that begins here and has a body."""
        at, words = i, 0
        while at < end:
            t = self.t[at]
            if t == "(" and at > i and self.tok(at - 1) in ("<", ",") and self.language == "C#":
                at = self.close(at, end) + 1  # a tuple among a type's arguments
                continue
            if t == "(":
                name = at - 1
                if self.tok(name) == ">":
                    depth = 0
                    while name > i:
                        depth += {">": 1, "<": -1}.get(self.t[name], 0)
                        name -= 1
                        if not depth:
                            break
                if self.language == "C#" and self.ident(self.close(at, end) + 1) and (name < i or self.t[name] in _MODIFIERS):
                    pass
                elif not self.ident(name) or name < i or self.t[name] in self.control or self.t[name] in _NO_METHODS:
                    return None
                else:
                    words += inside != "block"
                if self.language == "C#" and self.ident(self.close(at, end) + 1) and (name < i or self.t[name] in _MODIFIERS):
                    at = self.close(at, end) + 1  # a tuple as a type
                    words += 1
                    continue
                if inside == "block" and (self.language == "Java" or words < 2):
                    return None
                after = self.close(at, end) + 1
                while after < end and self.t[after] not in ("{", ";", "=>", "=", "}"):
                    after = self.close(after, end) + 1 if self.t[after] in "([" and self.k.kind[after] == "op" else after + 1
                return name if self.tok(after) == "{" or self.tok(after) == "=>" and self.language == "C#" else None
            if t in ("new", "return", "throw", "await", "else", "yield", "case", "goto") or t in _TYPES - {"record"} or t in ("record",) and words < 4 and self.ident(at + 1) and self.tok(at + 2) in ("(", "<", "{"):
                return None
            if self.k.kind[at] == "ident":
                words += 1
            elif t not in ("<", ">", ",", ".", "?", "[", "]", "&", "::", "*"):
                return None
            at += 1
        return None

    def function(self, start: int, name: int, end: int, marks: str) -> int:
        """A named function with parameters; its body is a block or an expression."""
        first = start
        if self.language in ("Java", "Kotlin", "C#"):  # marks belong to the function
            while first > 0 and marks and (self.tok(first - 1) in (")", "]") or self.tok(first - 1).startswith("@") or self.tok(first - 2).startswith("@")):
                first = self.match[first - 1] if self.tok(first - 1) in (")", "]") and self.match[first - 1] >= 0 else first - 1
        at = name + 1
        while at < end and self.t[at] != "(":
            at = self.close(at, end) + 1 if self.t[at] == "[" else at + 1
        close = self.close(at, end) if at < end else end
        brace = close + 1
        while brace < end and not (self.t[brace] == "{" and self.tok(brace - 1) not in ("interface", "struct")):
            t = self.t[brace]
            if t == ";" or t == "=>" and self.language == "C#" or t == "=" and self.language == "Kotlin" or self.k.fresh[brace] and self.language in ("Go", "Kotlin") and t not in ("where", ":", "{", "="):
                break
            brace = self.close(brace, end) + 1 if t in "([{" and self.k.kind[brace] == "op" else brace + 1
        t = self.tok(brace)
        if brace >= end or t not in ("{", "=>", "="):
            return min(brace + (t == ";"), end)
        node = self.nodes.begin("function", "", self.t[name], self.ln(first), marks)
        self.inner(at, close)
        if t == "{":
            last = self.close(brace, end)
            self.statements(brace + 1, last, "block")
            self.nodes.finish(node, self.ln(last))
            return last + 1
        last = self.structure(brace + 1, end) if self.is_control(brace + 1) and self.inline else self.expression(brace + 1, end, {";"}, inside="value")
        self.nodes.finish(node, self.ln(last if self.tok(last) == ";" else last - 1))
        return last

    def script_body(self, at: int, end: int) -> int | None:
        """Where a function's block begins, after its parameters and the type it returns."""
        if self.tok(at) == ":":
            at += 1
            while at < end and self.t[at] not in (";", "=>", "=", ","):
                if self.t[at] == "{" and (self.tok(at - 1) not in (":", "|", "&", "<", ",") and not (self.tok(at - 1) == "is")):
                    break
                at = self.close(at, end) + 1 if self.t[at] in "([{" and self.k.kind[at] == "op" else at + 1
        return at if self.tok(at) == "{" and at < end else None

    def scripted(self, start: int, params: int, brace: int, name: str, end: int, marks: str = "") -> int:
        node = self.nodes.begin("function", "", name, self.ln(start), marks)
        self.inner(params, self.close(params, end))
        last = self.close(brace, end)
        self.statements(brace + 1, last, "block")
        self.nodes.finish(node, self.ln(last))
        return last + 1

    def typed(self, start: int, at: int, end: int, marks: str) -> int | None:
        """A type or namespace with a body."""
        brace = at + 1
        while brace < end and self.t[brace] not in ("{", ";"):
            if self.t[brace] == "=" and self.language != "Rust" or self.k.fresh[brace] and self.language == "Kotlin" and self.t[brace] not in (":", "{", "where") and self.tok(brace - 1) not in (",", ":", "("):
                return None
            brace = self.close(brace, end) + 1 if self.t[brace] in "([" and self.k.kind[brace] == "op" else brace + 1
        if self.tok(brace) != "{" or brace >= end:
            return None
        head = [t for t in self.t[at + 1 : brace]]
        node = self.nodes.begin("type", self.t[at], " ".join(head)[:200], self.ln(start), marks)
        last = self.close(brace, end)
        inside = "block" if self.language in ("Rust", "Go") or self.t[at] in ("namespace", "module") and self.script else "type"
        if self.t[at] != "interface" or not self.script:  # which holds types alone
            self.statements(brace + 1, last, inside)
        self.nodes.finish(node, self.ln(last))
        return last + 1

    def inner(self, opening: int, close: int, call: bool = False) -> None:
        """What stands between brackets, element by element; a call's first one as its argument."""
        i = opening + 1
        first = self.nodes.begin("arg", "0", "", self.ln(i)) if call and i < close else None
        while i < close:
            i = max(self.expression(i, close, {",", ";"}, inside="value"), i) + 1
            if first is not None:
                self.nodes.finish(first, self.ln(i - 1))
                first = None

    def arrow(self, i: int, end: int) -> tuple[int, int] | None:
        """(=>, end of parameters) if an arrow function's parameters begin here."""
        if self.tok(i) == "(":
            close = self.close(i, end)
            after = close + 1
            if self.tok(after) == ":":
                after += 1
                while after < end and self.t[after] not in ("=>", ";", ",", "=") and self.t[after] not in _PAIRS:
                    after = self.close(after, end) + 1 if self.t[after] in "([{" and self.k.kind[after] == "op" else max(self.skip_generics(after, end), after + 1)
            return (after, close) if self.tok(after) == "=>" and after < end else None
        return (i + 1, i) if self.ident(i) and self.tok(i + 1) == "=>" and i + 1 < end else None

    def bound(self, start: int, i: int) -> str:
        """The name that a function in an item from start on is bound to; none for a callback."""
        before = self.tok(i - 1)
        if before not in ("=", ":") or i - 1 <= start:
            return ""
        left = self.t[start : i - 1]
        while left and left[0] in ("const", "let", "var", "export", "public", "private", "protected", "static", "readonly", "default", "declare", "override"):
            left = left[1:]
        if before == "=" and ":" in left and "?" not in left[: left.index(":") - 1]:
            left = left[: left.index(":")]
        return "" if not left or left[0] in ("{", "[", "(", "return", "?") or "?" in left else "".join(left).strip("'\"")

    def ends_line(self, i: int) -> bool:
        """Whether a statement ends before token i, which begins a line."""
        last, t, kind = self.tok(i - 1), self.t[i], self.k.kind[i]
        last_open = self.k.kind[i - 1] == "op" and last not in (")", "]", "}", "++", "--", "!") and last != ">"
        if last_open or self.language == "Go" and last in ("return",) and False:
            return False
        if self.language == "Go":
            return True
        if t in ("else", "catch", "finally") and kind == "ident":
            return True
        if self.language == "Kotlin":
            return not (kind == "op" and t in (".", "?.", "?:", "&&", "||", "::")) and t not in ("as", "as?")
        return not (kind == "op" and t not in ("{", "++", "--", "!", "@", "}", "#")) and t not in ("in", "instanceof", "of", "as", "satisfies")

    def expression(self, i: int, end: int, stops: set[str], plain: bool = False, inside: str = "block") -> int:
        """Goes on to a stop or the expression's end; gives where it stopped."""
        start, chain, language, newlines = i, "", self.language, self.language in _LINES and not plain and inside != "value" or inside == "value" and self.language == "Kotlin" and ";" in stops and "," not in stops
        assigned: list[int] = []
        while i < end:
            t, kind = self.t[i], self.k.kind[i]
            if i > start and newlines and self.k.fresh[i] and self.ends_line(i):
                break
            if kind == "op":
                if t in stops or t == ";" and not plain:
                    break
                if t in _PAIRS:
                    i += 1
                    continue
                if t == "(" or t == "[":
                    if self.script and t == "(" and (found := self.arrow(i, end)):
                        if self.language == "TypeScript" and self.tok(i - 1) in (":", "|", "&", "<") and inside != "object" and "?" not in self.t[max(start, i - 60) : i]:
                            i, chain = found[0] + 1, ""  # a function's type
                            continue
                        i = self.arrowed(i, found, start, end, stops, inside)
                        chain = ""
                        continue
                    close = self.close(i, end)
                    call = self.nodes.begin("call", "new" if self.is_new(i) else "", chain[-200:], self.ln(i - 1)) if t == "(" and chain else None
                    self.inner(i, close, call is not None)
                    if call is not None:
                        self.nodes.finish(call, self.ln(close))
                    literal = close == i + 2 and self.k.kind[i + 1] == "string"  # told apart, since such a call cannot fail by chance
                    chain = (chain + (("('')" if literal else "()") if t == "(" else "[]"))[-200:] if self.tok(close + 1) in (".", "?.", "?", "(", "[", "!", "::", "!!") else ""
                    i = close + 1
                    continue
                if t == "{":
                    close = self.close(i, end)
                    value = inside == "value" or i > start and (self.tok(i - 1) in ("=", ":", "(", ",", "return", "=>", "?", "&&", "||", "??", "[") or language == "Rust" and self.ident(i - 1) and self.tok(i - 1) not in ("unsafe", "async", "move", "else"))
                    self.statements(i + 1, close, "object" if value and self.script else "type" if language in ("Java", "C#") and "new" in self.t[max(start, i - 40) : i] else "block")
                    i, chain = close + 1, ""
                    if not value and not assigned and language in ("Rust", "Java", "C#") and "new" not in self.t[start : min(i, start + 40)] and self.tok(i) not in (".", "?"):
                        return i
                    continue
                if t in ("&&", "||") and (not plain or language == "Rust") and not (language == "Rust" and t == "||" and self.tok(i - 1) in ("(", ",", "=", "move", "return", "{", ";")):
                    self.nodes.leaf("logical", t, "", self.ln(i))
                elif t in ("=", ":=", "+=") and inside != "object" and start < i < start + 200:
                    left = [x for x in self.t[start:i] if x not in ("const", "let", "var", "val", "mut", "final", "export", "static", "public", "private")]
                    left = left[: left.index(":")] if ":" in left[1:] and left[0] not in ("{", "[", ":") else left
                    if left and not (self.script and ("<" in left or left[0] in ("return", "}"))):
                        left = left[-1:] if language in ("Java", "C#") and "." not in left and "," not in left and "[" not in left else left
                        assigned.append(self.nodes.begin("assign", t, "".join(left)[:200], self.ln(start)))
                chain = chain + t if t in (".", "::", "?.") and chain else chain if t in ("?", "!", "!!") and self.tok(i + 1) in (".", "?.") else ""
                if t == "!" and language == "Rust" and self.ident(i - 1) and self.tok(i + 1) in ("(", "[", "{"):
                    close = self.close(i + 1, end)  # a macro's arguments are tokens, no code
                    self.nodes.leaf("macro", self.tok(i + 2).strip('"') if self.tok(i - 1) == "include" else "", self.tok(i - 1), self.ln(i - 1))
                    for j in range(i + 2, close):
                        if self.ident(j) and self.t[j - 1] == "." and self.tok(j + 1) == "(":
                            self.nodes.leaf("call", "macro", f".{self.t[j]}", self.ln(j))
                    braces = self.tok(i + 1) == "{"
                    i, chain = close + 1, ""
                    if braces and not assigned and self.tok(i) not in (".", "?"):
                        return i
                    continue
                i += 1
                continue
            if kind == "ident":
                if self.script and t == "function" and self.tok(i - 1) != ".":
                    name = i + 1 + (self.tok(i + 1) == "*")
                    params = self.skip_generics(name + self.ident(name), end)
                    brace = self.script_body(self.close(params, end) + 1, end) if self.tok(params) == "(" else None
                    if brace is not None:
                        begun = i - (self.tok(i - 1) == "async")
                        after = self.scripted(begun, params, brace, self.t[name] if self.ident(name) else "", end)
                        if begun == start:
                            return after
                        i, chain = after, ""
                        continue
                if self.script and self.tok(i + 1) == "=>":
                    i, chain = self.arrowed(i, (i + 1, i), start, end, stops, inside), ""
                    continue
                if self.script and t == "class" and self.tok(i - 1) != "." and (after := self.typed(i, i, end, "")) is not None:
                    i, chain = after, ""
                    continue
                if self.inline and not plain and self.is_control(i) and not (language == "Rust" and t == "for" and self.tok(i + 1) == "<"):
                    i, chain = self.structure(i, end), ""
                    if not assigned and i < end and self.k.fresh[i] and self.tok(i) not in (".", "?") and language == "Rust":
                        return i
                    continue
                if not self.inline and not plain and inside == "block" and i > start and self.is_control(i) and self.k.fresh[i] and self.tok(i - 1) not in (".", "?."):
                    break
                if t == "else" and not plain and inside == "block":
                    break
                if self.script and self.t[i + 1 : i + 4] == ["=", "{", "{"]:
                    self.nodes.leaf("jsx", "object", t, self.ln(i))
                chain = chain + t if chain and self.tok(i - 1) in (".", "::", "?.") else t
                if self.tok(i + 1) not in (".", "?.", "::", "(", "!", "?", "!!"):
                    if self.tok(i + 1) == "[":
                        self.nodes.leaf("ref", "", chain[-200:], self.ln(i))
                        i += 1
                        continue
                    after = self.skip_generics(i + 1, end) if self.tok(i + 1) == "<" else i + 1
                    if after > i + 1 and self.tok(after) == "(":
                        i = after
                        continue
                    if chain not in _WORDS_ONLY:
                        self.nodes.leaf("ref", "", chain[-200:], self.ln(i))
                    chain = ""
                i += 1
                if self.tok(i) == "::" and self.tok(i + 1) == "<":
                    i = self.skip_generics(i + 1, end)
                continue
            if kind == "string":
                self.nodes.leaf("string", "", t.strip("'\"`")[:200], self.ln(i))
            chain = "''" if kind == "string" and self.tok(i + 1) in (".", "?.") else ""
            i += 1
        for node in reversed(assigned):
            self.nodes.finish(node, self.ln(i - 1))
        return i

    def is_new(self, i: int) -> bool:
        j = i - 1
        while j > 0 and (self.ident(j) and self.t[j] != "new" or self.t[j] in (".", "<", ">", "::")):
            j -= 1
        return self.tok(j) == "new"

    def arrowed(self, i: int, found: tuple[int, int], start: int, end: int, stops: set[str], inside: str) -> int:
        at, close = found
        begun = i - (self.tok(i - 1) == "async")
        node = self.nodes.begin("function", "=>", self.bound(start, begun), self.ln(begun))
        if self.tok(i) == "(":
            self.inner(i, close)
        if self.tok(at + 1) == "{":
            last = self.close(at + 1, end)
            self.statements(at + 2, last, "block")
            self.nodes.finish(node, self.ln(last))
            return last + 1
        last = self.expression(at + 1, end, stops | {","}, inside="value" if inside == "value" else "block") if at + 1 < end else end
        self.nodes.finish(node, self.ln(last - 1))
        return last


_CONTROLS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Match, ast.Try, *((ast.TryStar,) if hasattr(ast, "TryStar") else ()))
_WORDS = {"AsyncFor": "for", "TryStar": "try"}


def _dotted(node) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}"[-200:]
    if isinstance(node, ast.Call):
        return f"{_dotted(node.func)}()"
    return f"{_dotted(node.value)}[]" if isinstance(node, ast.Subscript) else "''"


def _python(text: str, structures: frozenset[str]) -> list[list]:
    """The nodes of a Python file."""
    lines = None
    for _ in range(REPAIRS):
        try:
            tree = ast.parse(text)
            break
        except SyntaxError as error:  # read what is around the fault
            lines = lines or text.split("\n")
            at = min((error.lineno or 0), len(lines)) - 1
            while at >= 0 and not lines[at].strip():
                at -= 1
            if at < 0:
                return []
            lines[at] = "" if lines[at].strip() == "pass" else re.match(r"\s*", lines[at])[0] + "pass"
            text = "\n".join(lines)
        except (ValueError, RecursionError):
            return []
    else:
        return []
    nodes = Nodes(structures)

    def each(children):
        for child in children:
            visit(child)

    def visit(node):
        line = getattr(node, "lineno", 1)
        last = getattr(node, "end_lineno", None) or line
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            each(node.decorator_list)
            here = nodes.begin("function", "", node.name, line, " ".join(f"@{_dotted(d)}" for d in node.decorator_list))
            each([node.args, *([node.returns] if node.returns else []), *node.body])
        elif isinstance(node, ast.ClassDef):
            each(node.decorator_list)
            here = nodes.begin("type", "class", f"{node.name} ( {' , '.join(map(_dotted, node.bases))} )", line)
            each(node.body)
        elif isinstance(node, _CONTROLS):
            kind = type(node).__name__
            here = nodes.begin("control", _WORDS.get(kind, kind.lower()), "", line)
            rest = node.orelse if isinstance(node, ast.If) else []
            each(c for c in ast.iter_child_nodes(node) if c not in rest)
            while len(rest) == 1 and isinstance(rest[0], ast.If) and rest[0].col_offset == node.col_offset:  # elif
                each([rest[0].test, *rest[0].body])
                rest = rest[0].orelse
            each(rest)
        elif isinstance(node, ast.BoolOp):
            for _ in node.values[1:]:
                nodes.leaf("logical", "and" if isinstance(node.op, ast.And) else "or", "", line)
            return each(node.values)
        elif isinstance(node, ast.Call):
            each([node.func.value] if isinstance(node.func, ast.Attribute) else [] if isinstance(node.func, ast.Name) else [node.func])
            here = nodes.begin("call", "", _dotted(node.func), line)
            if node.args:
                first = nodes.begin("arg", "0", "", line)
                visit(node.args[0])
                nodes.finish(first, getattr(node.args[0], "end_lineno", None) or line)
            each([*node.args[1:], *node.keywords])
        elif isinstance(node, ast.ExceptHandler):
            here = nodes.begin("catch", "except", _dotted(node.type) if node.type else "", line)
            each(node.body)
        elif isinstance(node, (ast.Assign, ast.AugAssign, ast.AnnAssign, ast.NamedExpr)):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            names = [_dotted(t) for target in targets for t in (target.elts if isinstance(target, (ast.Tuple, ast.List)) else [target])]
            here = nodes.begin("assign", "+=" if isinstance(node, ast.AugAssign) else "=", ",".join(names)[:200], line)
            each([t for t in targets if not isinstance(t, (ast.Name, ast.Tuple, ast.List))] + ([node.value] if node.value else []))
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            names = ",".join(a.name for a in node.names)
            return nodes.leaf("import", "", f"{'.' * node.level}{node.module or ''} {names}" if isinstance(node, ast.ImportFrom) else names, line)
        elif isinstance(node, ast.Assert):
            here = nodes.begin("assert", "", "", line)
            each(ast.iter_child_nodes(node))
        elif isinstance(node, ast.Raise):
            here = nodes.begin("throw", "", _dotted(node.exc) if node.exc else "", line)
            each(ast.iter_child_nodes(node))
        elif isinstance(node, (ast.Name, ast.Attribute, ast.Subscript)):
            if isinstance(node, ast.Subscript):
                visit(node.slice)
            elif isinstance(node, ast.Attribute) and not isinstance(node.value, (ast.Name, ast.Attribute)):
                visit(node.value)
            value = node
            while isinstance(value, (ast.Subscript, ast.Attribute)):
                value = value.value
            if isinstance(node, ast.Subscript) and not isinstance(value, ast.Name):
                visit(node.value)
            return nodes.leaf("ref", "", _dotted(node), line)
        elif isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Mod)) and any(isinstance(x, ast.JoinedStr) or isinstance(x, ast.Constant) and isinstance(x.value, str) for x in (node.left, node.right)):
            here = nodes.begin("concat", "", "", line)
            each([node.left, node.right])
        elif isinstance(node, ast.JoinedStr):
            here = nodes.begin("string", "f", "", line)
            each(v for v in node.values if isinstance(v, ast.FormattedValue))
        elif isinstance(node, ast.Constant):
            return nodes.leaf("string" if isinstance(node.value, str) else "constant", "", (node.value if isinstance(node.value, str) else str(node.value))[:200], line)
        else:
            return each(ast.iter_child_nodes(node))
        nodes.finish(here, last)

    try:
        visit(tree)
    except RecursionError:
        while nodes.open_:
            nodes.finish(nodes.open_[-1], nodes.rows[nodes.open_[-1]][6])
    return nodes.rows


def nodes_of(text: str | None, language: str | None, structures: frozenset[str] = STRUCTURES) -> list[list]:
    """[pre, post, kind, word, name, marks, first, last, upto, pre of structures around] of a file's nodes."""
    if not text:
        return []
    if language == "Python":
        return _python(text, structures)
    if language not in BRACED:
        return []
    reader = None
    try:
        reader = Braced.__new__(Braced)
        reader.__init__(text, language, structures)
    except RecursionError:  # keep what was read; what is open ends where reading stopped
        line = max((r[7] for r in reader.nodes.rows), default=1) if hasattr(reader, "nodes") else 1
        while hasattr(reader, "nodes") and reader.nodes.open_:
            reader.nodes.finish(reader.nodes.open_[-1], line)
    return reader.nodes.rows if hasattr(reader, "nodes") else []


_STRUCT = pa.struct([("pre", pa.int32()), ("kind", pa.string()), ("word", pa.string()), ("name", pa.string()), ("marks", pa.string()), ("first", pa.int32())])
_OUT = pa.schema([("path", pa.string()), ("language", pa.string()), ("pre", pa.int32()), ("post", pa.int32()), ("kind", pa.string()), ("word", pa.string()), ("name", pa.string()), ("marks", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("upto", pa.int32()), ("around", pa.list_(_STRUCT))])
#: Rows of one batch at most, so that large files leave in several.
BATCH = 8192


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)


def _extract(kinds: frozenset[str] | None, structures: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, language, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows = nodes_of(text, language, structures)
                own = {r[0]: {"pre": r[0], "kind": r[2], "word": r[3], "name": r[4], "marks": r[5], "first": r[6]} for r in rows if r[2] in structures}
                for r in rows:
                    if kinds is None or r[2] in kinds:
                        out.append((path, language, *r[:9], [own[i] for i in r[9]]))
                        if len(out) >= BATCH:
                            yield _batch(out)
                            out = []
            if out:
                yield _batch(out)

    return run


def nodes(files: DataFrame, kinds: tuple[str, ...] | None = None, around: tuple[str, ...] = ()) -> DataFrame:
    """The nodes of files (path, language, content), of some kinds or of all; around: kinds to list beside STRUCTURES."""
    return files.select("path", "language", "content").mapInArrow(_extract(frozenset(kinds) if kinds else None, STRUCTURES | set(around)), SCHEMA)
