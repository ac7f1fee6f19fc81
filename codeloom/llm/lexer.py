"""Lexical tokens of source and configuration texts: comments and literals, with where their contents begin and end.

What lies between two tokens is code (or prose, in Markdown and other plain
texts). A literal or comment that is never closed ends with its line, or with
the text where it may run over lines. Places are code points of the text.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str
    start: int
    #: where the contents begin and end
    a: int
    b: int
    end: int


_CS = re.compile(
    r"""(?P<comment>//[^\n]*|/\*(?:.*?\*/|.*\Z))
    |(?P<raw>\$*(?P<fence>"{3,})(?:.*?(?P=fence)(?!")|.*\Z))
    |(?P<verbatim>(?:\$@|@\$|@)"(?:[^"]|"")*(?:"|\Z))
    |(?P<hole>\$"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z))
    |(?P<string>"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z))
    |(?P<char>'(?:[^'\\\n]|\\[^\n]){1,10}')""",
    re.X | re.S,
)
_FS = re.compile(
    r"""(?P<comment>//[^\n]*|\(\*(?!\))(?:.*?\*\)|.*\Z))
    |(?P<raw>\$*(?P<fence>\"{3})(?:.*?(?P=fence)|.*\Z))
    |(?P<verbatim>(?:\$@|@\$|@)"(?:[^"]|"")*(?:"|\Z))
    |(?P<hole>\$"(?:[^"\\]|\\.)*(?:"|\Z))
    |(?P<string>"(?:[^"\\]|\\.)*(?:"|\Z))
    |(?P<char>'(?:[^'\\\n]|\\[^\n]{1,9})')""",
    re.X | re.S,
)
_SQL = re.compile(r"""(?P<comment>--[^\n]*|/\*(?:.*?\*/|.*\Z))|(?P<quoted>N?'(?:[^']|'')*(?:'|\Z))|(?P<name>"[^"\n]*"|\[[^\]\n]*\])""", re.S)
_JSON = re.compile(r"""(?P<comment>//[^\n]*|/\*(?:.*?\*/|.*\Z))|(?P<string>"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z))""", re.S)
_XML = re.compile(r"""(?P<comment><!--(?:.*?-->|.*\Z))|(?P<cdata><!\[CDATA\[(?:.*?\]\]>|.*\Z))|(?P<attribute>(?<==)[ \t\r\n]*(?:"[^"<]*"|'[^'<]*'))|(?P<text>(?<=>)[^<>]*[^<>\s][^<>]*(?=<))""", re.S)
_PLAIN = re.compile(r"""(?P<line>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'(?!\w)|`[^`\n]+`)""")
_LEXERS = {"cs": _CS, "fs": _FS, "sql": _SQL, "json": _JSON, "xml": _XML, "plain": _PLAIN}
#: Characters before and behind the contents, by kind; those that depend on the text are worked out.
_OPEN = re.compile(r'[$@N]*(?:"{3,}|["\'`])|\s*["\']')

#: What texts of a family hold often; counted over the whole text.
_SIGNS = {
    "cs": (";\n", ";\r\n", "{\n", "using ", "namespace ", "public ", "private ", "var ", "();", "class ", "new "),
    "fs": ("\nlet ", " let ", "module ", "\nopen ", " |> ", "\ntype ", " -> ", "match ", "\n    | "),
    "sql": ("CREATE ", "INSERT ", "SELECT ", "UPDATE ", " VALUES", "NOT NULL", "dbo.", "\nGO", "ALTER ", "N'"),
    "plain": ("\n# ", "\n## ", "\n- ", "\n* ", "```", "\n> ", "](", ". "),
}


def dialect(s: str) -> str:
    """The lexical family of a text, by signs of the whole text."""
    first = s.lstrip("﻿ \t\r\n")[:1]
    if first == "<" and "</" in s or first == "<" and "/>" in s:
        return "xml"
    if first in ("{", "[") and first and '"' in s and not s.lstrip("﻿ \t\r\n").startswith(("[assembly", "[<")) and re.match(r'[﻿\s]*[{\[][\s{\[]*(?:"|//|/\*|[}\]])', s):
        return "json"
    best, most = "plain", 0
    for family, signs in _SIGNS.items():
        n = sum(map(s.count, signs))
        if n > most:
            best, most = family, n
    return best


def lex(s: str, family: str | None = None) -> list[Token]:
    """Comments and literals of a text in order."""
    out = []
    for m in _LEXERS[family or dialect(s)].finditer(s):
        kind, start, end = m.lastgroup, m.start(), m.end()
        if kind == "fence":
            kind = "raw"
        if kind == "comment" or kind == "text" or kind == "name":
            out.append(Token(kind, start, start, end, end))
        elif kind == "cdata":
            out.append(Token(kind, start, start + 9, end - 3 if s.endswith("]]>", start, end) else end, end))
        elif kind == "raw":
            fence = m["fence"]
            a = s.index('"', start) + len(fence)
            out.append(Token(kind, start, a, end - len(fence) if s.endswith(fence, a, end) else end, end))
        else:
            a = _OPEN.match(s, start).end()
            out.append(Token(kind, start, a, end - 1 if end > a and s[end - 1] == s[a - 1] else end, end))
    return out


#: What stays when a literal's contents are overwritten: escapes, doubled quotes and braces, entities.
_KEPT = {
    "string": re.compile(r"\\(?:u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{1,4}|.)|\\", re.S),
    "hole": re.compile(r"\\(?:u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{1,4}|.)|\\|\{\{|\}\}|\{[^{}]*\}", re.S),
    "verbatim": re.compile(r'""|\{\{|\}\}'),
    "quoted": re.compile("''"),
    "attribute": re.compile(r"&#?\w+;"),
    "text": re.compile(r"&#?\w+;"),

}
_KEPT["char"] = _KEPT["line"] = _KEPT["string"]
_NOTHING = re.compile(r"(?!)")


def overwrite(content: str, kind: str, what: re.Pattern = re.compile(r"\S")) -> str:
    """Contents of a literal with all that matches `what` overwritten by letters; escapes and line breaks stay, so does the length."""
    out, at = [], 0
    fill = lambda t: what.sub(lambda m: "R" * len(m[0]), t)
    for m in _KEPT.get(kind, _NOTHING).finditer(content):
        out += (fill(content[at : m.start()]), m[0])
        at = m.end()
    return "".join(out) + fill(content[at:])
