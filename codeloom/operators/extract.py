"""Declarations from source text: types, members and functions with their line spans and what their heads say.

A light extractor for C# and F#, for workspaces that come without a symbols
table. Literals and comments are blanked first with their places kept, so that
braces and keywords in them do not count; spans follow braces in C# and
indentation in F#.

Defined results: null and empty texts declare nothing; what a truncated
text leaves open ends on its last line; of compiler switches the first branch is
read; positions are lines counted from 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "file_id long, kind string, name string, container string, start_line int, end_line int"

_BLANK = re.compile(
    r"""//[^\n]*|/\*.*?\*/|\(\*(?!\)).*?\*\)|\$*("{3,}).*?\1|(?:@\$?|\$@)"(?:[^"]|"")*"|\$?"(?:\\.|[^"\\\n])*"|'(?:\\[^\n]{1,9}?|[^'\\\n])'""", re.S
)
_TYPE = re.compile(r"\b(class|interface|struct|enum|record(?:\s+(?:class|struct))?)\s+([A-Za-z_]\w*)")
_MEMBER = re.compile(r"(?:^|[\s>\])?])([A-Za-z_]\w*)\s*(?:<[^<>()]*>)?\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:where[^{;]*|:\s*(?:base|this)\s*\([^{;]*\)\s*)?$", re.S)
_NOT_NAMES = frozenset("if for foreach while switch catch lock using fixed return new throw nameof typeof sizeof default when await checked unchecked base this".split())
_LET = re.compile(r"^(\s*)(?:let|and)\s+(?:(?:rec|inline|private|internal|public|mutable)\s+)*([a-z_]\w*)\s+[^=\s:]")
_FS_TOP = re.compile(r"^module\s+(?:(?:rec|private|internal|public)\s+)*([\w.]+)\s*$")
_FS_TYPE = re.compile(r"^(\s*)(module|type)\s+(?:(?:rec|private|internal|public)\s+)*([A-Za-z_]\w*)\s*(?:<[^>]*>)?\s*(?:\([^)]*\))?\s*=")


def blank(s: str) -> str:
    """The text with comments and literals replaced by spaces, line breaks kept."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), s)


FULL_SCHEMA = SCHEMA + ", ns string, signature string, accessibility string, modifiers string, arity int, attr_markers string, accessors string, declaration_key string"
#: Characters of a signature that are kept, and of its end that a declaration's key holds.
LONGEST_SIGNATURE, KEY_END = 400, 40
_ACCESS = ("public", "private", "protected", "internal")
# fixed values: modifiers that are told apart from the signature
_MODIFIERS = ("static", "abstract", "virtual", "override", "sealed", "partial", "async", "readonly", "const", "new", "extern", "unsafe", "volatile", "required")
_ATTRIBUTES = re.compile(r"^\s*((?:\[[^\[\]]*(?:\[[^\]]*\][^\[\]]*)*\]\s*)+)")
_PROPERTY = re.compile(r"(?:^|\s)(?:[\w.<>,\[\]?() ]+[\w>\]?)])\s+(?:[\w.]+\.)?([A-Za-z_]\w*)\s*$", re.S)
_FIELD = re.compile(r"^(?:(?:public|private|protected|internal|static|readonly|const|volatile|new|required|unsafe|fixed|event)\s+)*[\w.]+(?:\s*<[^;={}]*>)?(?:\s*\[[,\s]*\])*\s*\??\s+([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)\s*$", re.S)
_DELEGATE = re.compile(r"\bdelegate\s+[^;{}=]*?([A-Za-z_]\w*)\s*(?:<[^<>()]*>)?\s*\(", re.S)


def csharp(s: str) -> list[tuple[str, str, str | None, int, int]]:
    """(kind, name, container, first line, last line) of the types, methods and constructors of a C# text."""
    return [x[:5] for x in _csharp(s) if x[0] not in ("property", "field", "event", "delegate", "enum_member", "indexer")]


def head_facts(kind: str, name: str, container: str | None, head: str, tail: str = "") -> tuple:
    """(signature, accessibility, modifiers, arity, attributes, accessors, key) of a declaration's head; `tail` is an accessor list."""
    head = re.sub(r"^[ \t]*#[^\n]*\n", "", head, flags=re.M)
    attributes = _ATTRIBUTES.match(head)
    marks = ";".join(x.split("(")[0].split(".")[-1].strip() for x in re.findall(r"[\[,]\s*(?:\w+\s*:\s*)?([A-Za-z_][\w.]*(?:\s*\()?)", attributes[1])) if attributes else ""
    head = head[attributes.end() :] if attributes else head
    words = head.split()
    access = " ".join(w for w in words[:6] if w in _ACCESS)
    modifiers = " ".join(dict.fromkeys(w for w in re.split(r"[(<=]", head)[0].split()[:-1] if w in _MODIFIERS))
    text = " ".join(words)
    accessors = ""
    if tail:
        found = re.findall(r"(?:(public|private|protected|internal)\s+)?(get|set|init)\b", tail)
        accessors = ";".join(f"{g}={a or access or 'private'}" for a, g in found)
        text += " { " + " ".join(f"{a + ' ' if a else ''}{g};" for a, g in found) + " }"
    generic = re.search(re.escape(name) + r"\s*<([^<>()]*)>", head)
    key = f"{kind}|{container or ''}.{name}|{text[-KEY_END:]}"
    return text[:LONGEST_SIGNATURE], access or None, modifiers or None, generic[1].count(",") + 1 if generic else 0, marks or None, accessors or None, key


def _csharp(s: str) -> list[tuple]:
    """All declarations of a C# text: the five columns of `csharp`, the namespace and what `head_facts` tells."""
    t = _first_branches(blank(s))
    lines = [0]
    for m in re.finditer("\n", t):
        lines.append(m.end())

    def line(at: int) -> int:
        lo, hi = 0, len(lines) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if lines[mid] <= at else (lo, mid - 1)
        return lo + 1

    source = s.split("\n")

    def begins(at: int) -> int:
        """A declaration's first line; a switch right above belongs to it."""
        n = line(at)
        return n - 1 if n > 1 and source[n - 2].lstrip().startswith("#if") else n

    out: list[list] = []
    stack: list[tuple[str, int | None]] = []  # kind of each open block, and the declaration it belongs to
    spaces: list[str] = []
    head = 0

    def add(kind: str, name: str, names: list[str], first: int, last: int, text: str, tail: str = "") -> None:
        container = ".".join(names) or None
        ns = ".".join(x for x in spaces if x) or None
        out.append([kind, name, container, first, last, ns, *head_facts(kind, name, container, s[head_at(text) : head + len(text)] if text.strip() else "", tail)])

    def add_member(name: str, names: list[str], first: int, last: int) -> None:
        container = ".".join(names) or None
        out.append(["enum_member", name, container, first, last, ".".join(x for x in spaces if x) or None, name, "public", None, 0, None, None, f"enum_member|{container or ''}.{name}|{name}"])

    def head_at(text: str) -> int:
        return head + len(text) - len(text.lstrip())

    for m in re.finditer(r"[{};]", t):
        at, c = m.start(), m[0]
        text = t[head:at]
        first = head + len(text) - len(text.lstrip())
        inside = stack[-1][0] if stack else "file"
        names = [out[d][1] for k, d in stack if k in ("type", "enum") and d is not None]
        if c == "{":
            found = _TYPE.search(text) if inside in ("file", "type", "namespace") else None
            if found and "=" not in text[: found.start()]:
                kind = found[1].split()[0]
                add(kind, found[2], names, begins(first), 0, text)
                stack.append(("enum" if kind == "enum" else "type", len(out) - 1))
            elif inside in ("file", "namespace") and (space := re.search(r"\bnamespace\s+([\w.]+)", text)):
                spaces.append(space[1])
                stack.append(("namespace", None))
            elif inside == "type" and (d := _MEMBER.search(text.split("=>")[0])) and d[1] not in _NOT_NAMES and "=" not in text[: d.start()].replace("==", ""):
                kind = "constructor" if names and d[1] == names[-1] else "method"
                add(kind, d[1], names, begins(first), 0, text)
                stack.append(("code", len(out) - 1))
            elif inside == "type" and "=" not in text and (d := re.search(r"\bthis\s*\[[^\]]*\]\s*$", text) or _PROPERTY.search(text)) and not re.search(r"\b(?:operator|event)\b", text) and not d[0].strip().startswith("="):
                close = t.find("}", at)
                add("indexer" if d[0].lstrip().startswith("this") else "property", "this" if d[0].lstrip().startswith("this") else d[1], names, begins(first), 0, text, t[at:close] if close > 0 else "")
                stack.append(("code", len(out) - 1))
            else:
                stack.append(("code" if inside != "file" else "block", None))
            head = m.end()
        elif c == "}":
            if inside == "enum":
                _enum_members(text, first, names, out, line, add_member)
            if stack:
                kind, d = stack.pop()
                if kind == "namespace" and spaces:
                    spaces.pop()
                if d is not None:
                    out[d][4] = line(at)
            head = m.end()
        else:
            if inside == "type" and (d := _MEMBER.search(text.split("=>")[0].rstrip())) and d[1] not in _NOT_NAMES and "=" not in text[: d.start()]:
                kind = "constructor" if names and d[1] == names[-1] else "method"
                kind, name = ("delegate", _DELEGATE.search(text)[1]) if _DELEGATE.search(text) else (kind, d[1])
                add(kind, name, names, begins(first), line(at), text.split("=>")[0])
            elif inside in ("file", "namespace", "type") and (d := _DELEGATE.search(text)):
                add("delegate", d[1], names, begins(first), line(at), text)
            elif inside == "file" and (space := re.match(r"\s*namespace\s+([\w.]+)\s*$", text)):
                spaces.append(space[1])
            elif inside == "type":
                body = text.split("=")[0]
                bare = _ATTRIBUTES.sub("", body).strip()
                if "=>" in text and (d := _PROPERTY.search(body)):
                    add("property", d[1], names, begins(first), line(at), body)
                elif (d := _FIELD.match(bare)) and not re.match(r"(?:return|using|throw|goto)\b", bare):
                    for name in re.split(r"\s*,\s*", d[1]):
                        add("event" if re.search(r"\bevent\b", bare) else "field", name, names, begins(first), line(at), body)
            head = m.end()
    # what a truncated text leaves open ends with it
    return [(*x[:4], x[4] or len(lines), *x[5:]) for x in out]


def _enum_members(text: str, first: int, names: list[str], out: list, line, add) -> None:
    """The members of an enum's body, which ends where its block does."""
    at = first
    for part in re.split(r"(,)", text.lstrip()):
        m = re.match(r"\s*((?:\[[^\]]*\]\s*)*)([A-Za-z_]\w*)", part)
        if part != "," and m:
            add(m[2], names, line(at + m.start(2)), line(at + len(part.rstrip()) - 1))
        at += len(part)


def _first_branches(t: str) -> str:
    """The text with compiler switches and their later branches blanked."""
    if "#" not in t:
        return t
    out, skip = [], []
    for x in t.split("\n"):
        y = x.lstrip()
        if y.startswith("#"):
            if re.match(r"#\s*if", y):
                skip.append(False)
            elif re.match(r"#\s*el", y) and skip:
                skip[-1] = True
            elif re.match(r"#\s*endif", y) and skip:
                skip.pop()
            x = " " * len(x)
        elif any(skip):
            x = " " * len(x)
        out.append(x)
    return "\n".join(out)


def fsharp(s: str) -> list[tuple[str, str, str | None, int, int]]:
    """(kind, name, container, first line, last line) of modules, types and functions of an F# text."""
    out: list[list] = []
    lines = blank(s.removeprefix("\ufeff")).split("\n")
    solid = [k for k, x in enumerate(lines) if x.strip()]
    for n, k in enumerate(solid):
        x = lines[k]
        indent = len(x) - len(x.lstrip())
        found = None
        if m := _FS_TOP.match(x):
            out.append(["module", m[1].split(".")[-1], None, k + 1, len(lines) - (lines[-1] == ""), -1])
            continue
        if m := _FS_TYPE.match(x):
            body = lines[solid[n + 1]].strip() if n + 1 < len(solid) else ""
            rest = x[m.end() :].strip() or body
            found = ["module" if m[2] == "module" else "record" if rest.startswith("{") else "union" if rest.startswith("|") else "type", m[3]]
        elif m := _LET.match(x):
            found = ["function", m[2]]
        if not found:
            continue
        last = k
        for j in solid[n + 1 :]:
            y = lines[j]
            if len(y) - len(y.lstrip()) <= indent:
                break
            last = j
        # nested functions belong to their function, not to the module
        above = [o for o in out if 0 <= o[5] < indent and o[3] <= k + 1 <= o[4]]
        if found[0] == "function" and any(o[0] == "function" for o in above):
            continue
        out.append([*found, ".".join(o[1] for o in above) or None, k + 1, last + 1, indent])
    return [tuple(o[:5]) for o in out]


_FS_SIGN = re.compile(r"^\s*(?:module|open|let|type)\s+\S", re.M)


def reads_as(s: str) -> str:
    """Which of the two languages a text is in, by its own signs."""
    return "fs" if s.count(";\n") + s.count(";\r\n") + s.count("{") <= len(_FS_SIGN.findall(s)) else "cs"


def declarations(contents: DataFrame) -> DataFrame:
    """Declarations of all texts of a table (file_id, content), distinct.

    The texts tell their language themselves, so that they need not be moved to
    meet the files that know it; the caller drops files of other languages.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *d) for i, s in zip(b["file_id"], b["content"]) if s for d in (csharp(s) if reads_as(s) == "cs" else fsharp(s))]
            yield pd.DataFrame(rows, columns=["file_id", "kind", "name", "container", "start_line", "end_line"])

    texts = contents.where("content is not null").select("file_id", "content")
    return texts.mapInPandas(scan, SCHEMA).distinct()


def full_declarations(contents: DataFrame) -> DataFrame:
    """All declarations of a table of texts with namespace, signature, accessibility, modifiers, arity, attributes, accessors and key; of F# texts the columns that a head does not tell are null."""

    def rows_of(s: str) -> list[tuple]:
        if reads_as(s) == "cs":
            return _csharp(s)
        source = s.split("\n")
        top = next((m[1] for x in source if (m := re.match(r"\ufeff?(?:module|namespace)\s+(?:(?:rec|private|internal|public)\s+)*([\w.]+)\s*$", x.rstrip()))), None)
        out = []
        for kind, name, container, first, last in fsharp(s):
            head = " ".join(source[first - 1].lstrip("\ufeff").split("=")[0].split())
            access = next((w for w in head.split()[:4] if w in ("private", "internal", "public")), "public")
            generic = re.search(re.escape(name) + r"\s*<([^<>()]*)>", head)
            key = f"{kind}|{container or ''}.{name}|{head[-KEY_END:]}"
            out.append((kind, name, container, first, last, top, head[:LONGEST_SIGNATURE], access, None, generic[1].count(",") + 1 if generic else 0, None, None, key))
        return out

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in FULL_SCHEMA.split(", ")]
        for b in batches:
            yield pd.DataFrame([(i, *d) for i, s in zip(b["file_id"], b["content"]) if s for d in rows_of(s)], columns=columns)

    return contents.where("content is not null").select("file_id", "content").mapInPandas(scan, FULL_SCHEMA).distinct()
