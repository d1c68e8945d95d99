"""Declarations and imports at the top level of JavaScript and TypeScript files, by a small lexer.

Strings, templates with their nested expressions, comments and regular expressions are told from code, and brackets are
counted: what stands inside of any is no declaration of the file, and an import may take several lines.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

from .structure import SIGNATURE

LANGUAGES = re.compile(r"\.(?:cjs|cts|js|jsx|mjs|mts|ts|tsx)$")
_TOKEN = re.compile(
    r"""(?P<blank>\s++|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/)|(?P<string>"(?:[^"\\\n]++|\\[\s\S])*+"|'(?:[^'\\\n]++|\\[\s\S])*+')"""
    r"""|(?P<word>(?:[^\W\d]|\$)[\w$]*+)|(?P<number>\d[\w.]*+)|(?P<sign>=>|[=!]==?|[<>]=|&&|\|\||\?\?|\?\.|\.\.\.|[\s\S])"""
)
_TEMPLATE = re.compile(r"(?:[^`\\$]++|\\[\s\S]|\$(?!\{))*+(`|\$\{)")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/\w*")
_CLOSES = {")": "(", "]": "[", "}": "{"}
_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new do else instanceof await yield".split())
_ALWAYS_FIRST = frozenset("const let var import export enum interface".split())  # no expression has them after an operator
_JOINING = frozenset("in instanceof as satisfies of extends".split())
_BLOCKS = frozenset("function class interface enum".split())


class Malformed(ValueError):
    """A string, template or comment without an end, or brackets that do not fit."""


class Symbol(NamedTuple):
    name: str
    kind: str
    line: int
    signature: str
    exported: bool


class Graph(NamedTuple):
    symbols: list[Symbol]
    dependencies: list[tuple[str, int]]  # specifier, line


class Token(NamedTuple):
    kind: str
    text: str
    begin: int
    end: int
    depth: int

    def valued(self) -> bool:
        """Whether an expression may end here."""
        return self.kind in ("string", "number", "value") or (self.text not in _BEFORE_VALUE if self.kind == "word" else self.text in (")", "]"))


def tokens(text: str):
    """Each token but blanks and comments, with the number of brackets around it."""
    at, open_, last = 0, [], None
    while at < len(text):
        m = _TOKEN.match(text, at)
        kind, word, begin, at = m.lastgroup, m.group(), at, m.end()
        if kind == "blank":
            continue
        depth = len(open_)
        if kind == "sign":
            inside = word == "}" and open_ and open_[-1] == "${"
            if word == "`" or inside:
                if inside:
                    open_.pop()
                    depth -= 1
                t = _TEMPLATE.match(text, at)
                if not t:
                    raise Malformed("template without an end")
                at, kind = t.end(), "value"
                if t.group(1) == "${":
                    open_.append("${")
            elif word in "([{":
                open_.append(word)
            elif word in _CLOSES:
                if not open_ or open_.pop() != _CLOSES[word]:
                    raise Malformed(f"{word} that closes nothing")
                depth -= 1
            elif word == "/" and not (last and last.valued()) and (r := _REGEX.match(text, begin)):
                kind, at = "value", r.end()
            elif word in "\"'" or (word == "/" and text.startswith("/*", begin)):
                raise Malformed("string or comment without an end")
        last = Token(kind, text[begin:at] if at - begin < 512 else "", begin, at, depth)
        yield last
    if open_:
        raise Malformed(f"{open_[-1]} without an end")


class _File:
    def __init__(self, text: str):
        self.text, self.top, self.required = text, [], []
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        near: list[Token] = []
        for t in tokens(text):
            near = near[-4:] + [t]
            if t.depth == 0:
                self.top.append(t)
            words = [x.text for x in near]
            if len(near) >= 4 and near[-2].kind == "string" and words[-4:-2] == ["require", "("] and t.text in (")", ",") and words[:-4] not in (["."], ["?."]):
                self.required.append(near[-2])

    def line(self, t: Token) -> int:
        return bisect_right(self.breaks, t.begin - 1) + 1

    def word(self, i: int) -> str:
        return self.top[i].text if 0 <= i < len(self.top) and self.top[i].kind != "string" else ""

    def fresh(self, i: int) -> bool:
        """Whether a line break stands in front of token i."""
        return i > 0 and "\n" in self.text[self.top[i - 1].end : self.top[i].begin]

    def starts(self, i: int) -> bool:
        """Whether a statement that starts with a keyword may start at token i."""
        if i == 0 or self.word(i - 1) in (";", "}"):
            return True
        return self.fresh(i) and (self.word(i) in _ALWAYS_FIRST or self.top[i - 1].valued() or self.word(i - 1) == ">")

    def ends(self, i: int) -> bool:
        """Whether a statement without a semicolon has ended in front of token i."""
        if i >= len(self.top):
            return True
        t, before = self.top[i], self.top[i - 1]
        return self.fresh(i) and (t.text in _ALWAYS_FIRST or ((before.valued() or before.text in ("}", ">")) and (t.text == "@" or t.kind in ("word", "number", "string")) and t.text not in _JOINING))

    def angle(self, i: int) -> int:
        """Behind the type arguments that open at token i, or behind that sign, if it compares."""
        if not (self.word(i - 1) == "=" or (self.top[i - 1].kind == "word" and self.top[i - 1].end == self.top[i].begin)):
            return i + 1
        deep = 0
        for k in range(i, len(self.top)):
            w = self.word(k)
            deep += (w == "<") - (w == ">")
            if deep == 0:
                return k + 1
            if w in (";", "=", "&&", "||"):
                break
        return i + 1

    def block_end(self, i: int) -> int:
        """Behind the last bracket of the declaration at token i."""
        while i < len(self.top):
            w = self.word(i)
            if w == ";" or (w == "}" and self.word(i + 1) not in ("{", ">", "|", "&", "[", ",")):
                return i + 1
            i += 1
        return i

    def names(self, i: int) -> tuple[list[int], int]:
        """Of the variables behind the keyword at token i: the places of their names, and where the statement ends."""
        found, wanted, k = [], True, i + 1
        while k < len(self.top):
            w = self.word(k)
            if w == ";":
                return found, k + 1
            if not wanted and self.ends(k):
                break
            if wanted:
                if self.top[k].kind == "word":
                    found.append(k)
                wanted = False
            elif w == "," and self.word(k - 1) != "{":
                wanted = True
            k = self.angle(k) if w == "<" else k + 1
        return found, k


def graph(path: str, text: str) -> Graph:
    """Symbols and dependencies of one file; Malformed where the text cannot be split into tokens and brackets."""
    f, symbols, deps = _File(text), [], []
    n, i, decorated = len(f.top), 0, False
    while i < n:
        decorated = f.word(i) == "@" if f.starts(i) and f.word(i) not in ("export", "class", "abstract") else decorated
        if not f.starts(i) and not (decorated and f.word(i) in ("export", "class", "abstract")):
            i += 1
            continue
        j, exported = i, False
        if f.word(i) == "import" and f.word(i + 1) not in ("(", "."):
            k = i + 1
            while k < n and f.top[k].kind != "string" and f.word(k) != ";" and not (f.fresh(k) and f.word(k) in _ALWAYS_FIRST):
                k += 1
            if k < n and f.top[k].kind == "string":
                deps.append(f.top[k])
                k += 1
            i = k
            continue
        if f.word(i) == "export":
            j, exported = i + 1, True
            k = j + (f.word(j) == "type" and f.word(j + 1) in ("{", "*"))
            if f.word(k) in ("{", "*"):
                while k < n and f.word(k) not in ("from", ";") and not (k > j and f.ends(k)):
                    k += 1
                if f.word(k) == "from" and k + 1 < n and f.top[k + 1].kind == "string":
                    deps.append(f.top[k + 1])
                    k += 1
                i = max(k, i + 1)
                continue
            j += f.word(j) == "default"
        at = j  # the keyword behind what may stand in front of it
        if (f.word(j), f.word(j + 1)) in (("async", "function"), ("abstract", "class"), ("const", "enum")):
            at = j + 1
        kind, named, stop = f.word(at), [], at + 1
        if kind in _BLOCKS or kind == "type":
            k = at + 1 + (kind == "function" and f.word(at + 1) == "*")
            known = k < n and f.top[k].kind == "word" and f.word(k) not in ("extends", "implements")
            if kind == "type":
                known = known and f.word(k + 1) in ("=", "<")
            if known:
                named, stop = [(at, k)], f.block_end(k) if kind != "type" else f.names(at)[1]
        elif kind in ("const", "let", "var"):
            found, stop = f.names(at)
            named, kind = [(k, k) for k in found], "const" if kind == "const" else "variable"
        if named:
            signature = re.sub(r"[ \t-\r]+", " ", text[f.top[j].begin : f.top[stop - 1].end][: 64 * SIGNATURE].strip(" \t\n\x0b\f\r"))[:SIGNATURE]
            symbols += [Symbol(f.top[k].text, kind, f.line(f.top[j if k != place else place]), signature, exported) for place, k in named]
        decorated = decorated and f.word(i) == "@"
        i = max(stop, i + 1)
    made = [(text[t.begin + 1 : t.end - 1].strip(), f.line(t)) for t in sorted(deps + f.required, key=lambda t: t.begin)]
    return Graph(list(dict.fromkeys(symbols)), list(dict.fromkeys(d for d in made if d[0])))
