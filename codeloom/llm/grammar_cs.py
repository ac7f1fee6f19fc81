"""Syntax check of C#: a block machine over statement segments with memoised parses.

A text is masked (comments dropped, literals and names reduced to one letter),
cut at `;`, `{` and `}`, and run through a stack of block kinds. Each segment is
parsed by recursive descent, and since masked segments of any corpus recur very
often, the parse is remembered by block kind and segment. Only syntax counts.
"""

from __future__ import annotations

import re

STR, BLOCK = "\x01", "\x02"

_MASK = re.compile(
    r"""//[^\n]*|/\*.*?\*/
    |\$*("{3,}).*?\1
    |(?:@\$?|\$@)"(?:[^"]|"")*"
    |\$"(?:\\.|\{\{|\}\}|\{(?:[^{}"\n]|"(?:\\.|[^"\\\n])*"|\{[^{}\n]*\})*\}|[^"\\{}\n])*"
    |"(?:\\.|[^"\\\n])*"(?:u8)?
    |'(?:\\[^\n]{1,9}?|[^'\\\n])'""",
    re.X | re.S,
)
_OTHER_NAME = re.compile(r"\b[A-Z_0-9]\w*|@\w+|\d[\d_]*\.\d\w*")
_LOWER = re.compile(r"\b[^\W\dA-Z_]\w*")
_KEYWORDS = """abstract as async await base break case catch checked class const continue default delegate do else enum event
explicit extern finally fixed for foreach get global goto if implicit in init interface internal is lock namespace new
null operator out override params partial private protected public readonly record ref remove required return scoped sealed
set sizeof stackalloc static struct switch this throw try typeof unchecked unsafe using virtual void volatile when where
while with yield add and or not from let select orderby group join into file""".split()
_KEYS = {k: k for k in _KEYWORDS}
#: Words that are names wherever the grammar does not ask for them.
_SOFT = frozenset("file async await get global init partial record remove required scoped set when where with yield add and or not from let select orderby group join into".split())
_RESERVED = frozenset(_KEYWORDS) - _SOFT
_TOKEN = re.compile(r"\w+|=>|\?\?=|\?\?|\?\.|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<=|<<|->|::|\.\.|[^\s\w]")
_MODIFIERS = frozenset("public private protected internal static readonly const virtual override abstract sealed partial async extern unsafe new volatile required ref file".split())
#: What the modifier `file` may stand before; elsewhere it is a name.
_DECLARES = frozenset("class struct interface enum record delegate static sealed abstract readonly ref partial unsafe".split())
_BINARY = frozenset("+ - * / % & | ^ && || == != < > <= >= << ?? = += -= *= /= %= &= |= ^= <<= ??= ..".split())


class Bad(Exception):
    pass


class P:
    """Tokens of one segment and a place in them."""

    __slots__ = ("t", "i", "n")

    def __init__(self, text: str):
        self.t = _TOKEN.findall(text)
        self.t.append("")
        self.i, self.n = 0, len(self.t) - 1

    def peek(self, k: int = 0) -> str:
        j = self.i + k
        return self.t[j] if j <= self.n else ""

    def take(self, x: str) -> bool:
        if self.t[self.i] == x and x:
            self.i += 1
            return True
        return False

    def need(self, x: str) -> None:
        if not self.take(x):
            raise Bad(x)

    def end(self) -> None:
        if self.i != self.n:
            raise Bad("rest")

    def name(self) -> bool:
        t = self.t[self.i]
        if t and (t[0].isalnum() or t[0] == "_") and t not in _RESERVED:
            self.i += 1
            return True
        return False

    def need_name(self) -> None:
        if not self.name():
            raise Bad("name")

    # types
    def type_(self) -> bool:
        """Tries a type; leaves the place alone if there is none."""
        start = self.i
        try:
            self._type()
            return True
        except Bad:
            self.i = start
            return False

    def _type(self) -> None:
        while self.t[self.i] in ("ref", "readonly", "scoped"):
            self.i += 1
        if self.take("("):
            while True:
                self._type()
                self.name()
                if not self.take(","):
                    break
            self.need(")")
        elif self.take("void"):
            pass
        else:
            if self.take("delegate"):
                self.need("*")
                if self.name() and self.take("["):
                    self.skip_to("]")
                self.need("<")
                self._type_list()
                self.need(">")
                return
            self.need_name()
            if self.take("::"):
                self.need_name()
            self._args()
            while self.t[self.i] == "." and self._is_name(1):
                self.i += 2
                self._args()
        while True:
            if self.t[self.i] == "?" and self.t[self.i + 1] != "." :
                self.i += 1
            elif self.t[self.i] == "*":
                self.i += 1
            elif self.t[self.i] == "[" and self.t[self.i + 1] in (",", "]"):
                self.i += 1
                while self.take(","):
                    pass
                self.need("]")
            else:
                return

    def _is_name(self, k: int) -> bool:
        t = self.peek(k)
        return bool(t) and (t[0].isalnum() or t[0] == "_") and t not in _RESERVED

    def _args(self) -> None:
        if self.t[self.i] != "<":
            return
        start = self.i
        self.i += 1
        if self.t[self.i] in (",", ">"):
            while self.take(","):
                pass
        else:
            self._type_list()
        if not self.take(">"):
            self.i = start
            raise Bad(">")

    def _type_list(self) -> None:
        while True:
            if self.take("["):
                self.skip_to("]")
            self.take("in") or self.take("out")
            self._type()
            if not self.take(","):
                return

    def skip_to(self, close: str) -> None:
        """Past a bracket's contents, whose own brackets must balance."""
        stack = [close]
        pairs = {"(": ")", "[": "]"}
        while stack:
            t = self.t[self.i]
            if not t:
                raise Bad(close)
            self.i += 1
            if t in pairs:
                stack.append(pairs[t])
            elif t in (")", "]"):
                if stack.pop() != t:
                    raise Bad(t)

    # expressions
    def expr(self) -> None:
        if self.t[self.i] == "from" and self._is_name(1):
            self._query()
            return
        self._unary()
        while True:
            t = self.t[self.i]
            if t == ">" and self.t[self.i + 1] in (">", ">="):
                self.i += 2
                self._unary()
            elif t in _BINARY:
                self.i += 1
                if t == ".." and self.t[self.i] in ("]", ")", ",", ""):
                    continue
                self._unary()
            elif t == "?":
                self.i += 1
                self.expr()
                self.need(":")
                self.expr()
                return
            elif t == "is":
                self.i += 1
                self.pattern()
            elif t == "as":
                self.i += 1
                self._type()
            elif t == "switch" and self.t[self.i + 1] == BLOCK:
                self.i += 2
            elif t == "with" and self.t[self.i + 1] == BLOCK:
                self.i += 2
            elif t == "=>":
                raise Bad("=>")
            else:
                return

    def _query(self) -> None:
        depth = 0
        count = 0
        while self.t[self.i] and not (depth == 0 and self.t[self.i] in (")", ",", "]")):
            t = self.t[self.i]
            depth += (t in "([") - (t in ")]")
            count += t in ("select", "group")
            self.i += 1
        if not count or self.t[self.i - 1] in ("select", "from", "in", "where", "by"):
            raise Bad("query")

    def pattern(self) -> None:
        self.take("not")
        while self.t[self.i] in ("<", ">", "<=", ">=", "==", "!="):
            self.i += 1
        if self.t[self.i] == BLOCK:
            self.i += 1
            self.name()
        elif self.take("["):
            self.skip_to("]")
            self.name()
        elif self.t[self.i] == "(":
            self.i += 1
            if not self.take(")"):
                while True:
                    if self._is_name(0) and self.t[self.i + 1] == ":":
                        self.i += 2
                    self.pattern()
                    if not self.take(","):
                        break
                self.need(")")
            if self.t[self.i] == BLOCK:
                self.i += 1
            self.name()
        elif self.t[self.i] in (STR, "null", "-", "+", "typeof", "default", "~") or not self.type_():
            self._unary()
        else:
            if self.t[self.i] == "(":
                self.i += 1
                self.skip_to(")")
            if self.t[self.i] == BLOCK:
                self.i += 1
            if self.t[self.i] not in ("and", "or", "when", "with"):
                self.name()
        if self.t[self.i] in ("and", "or"):
            self.i += 1
            self.pattern()

    def _unary(self) -> None:
        while True:
            t = self.t[self.i]
            if t in ("+", "-", "!", "~", "++", "--", "&", "*", "^", ".."):
                self.i += 1
                if t == ".." and self.t[self.i] in ("]", ")", ","):
                    return
            elif t == "await" and (self._is_name(1) or self.t[self.i + 1] in ("(", "new", "this", "base")):
                self.i += 1
            elif t in ("ref", "throw"):
                self.i += 1
            elif t == "(" and self._cast():
                pass
            else:
                break
        self._primary()

    def _cast(self) -> bool:
        start = self.i
        self.i += 1
        if self.type_() and self.take(")"):
            t = self.t[self.i]
            if t == BLOCK or t == STR or t in ("(", "!", "~", "new", "this", "base", "typeof", "default", "null", "await", "stackalloc", "sizeof", "checked") or self._is_name(0) and t not in ("is", "as", "and", "or", "when", "with"):
                return True
        self.i = start
        return False

    def _lambda(self) -> bool:
        """A lambda's head up to `=>`, if one stands here."""
        start = self.i
        while self.t[self.i] in ("async", "static"):
            self.i += 1
        if self._is_name(0) and self.t[self.i + 1] == "=>":
            self.i += 2
            return True
        if self.type_() and self.t[self.i] != "(":
            self.i = start
            while self.t[self.i] in ("async", "static"):
                self.i += 1
        if self.t[self.i] == "(":
            self.i += 1
            try:
                self._params(")")
            except Bad:
                self.i = start
                return False
            if self.take("=>"):
                return True
        self.i = start
        return False

    def _params(self, close: str) -> None:
        if self.take(close):
            return
        while True:
            while self.take("["):
                self.skip_to("]")
            while self.t[self.i] in ("this", "ref", "out", "in", "params", "scoped", "readonly"):
                self.i += 1
            self._type()
            if self.t[self.i] not in (",", close):
                self.need_name()
            if self.take("="):
                self.expr()
            if not self.take(","):
                break
        self.need(close)

    def _body(self) -> None:
        if self.t[self.i] == BLOCK:
            self.i += 1
        else:
            self.expr()

    def _primary(self) -> None:
        t = self.t[self.i]
        if (t == "(" or self._is_name(0) or t in ("async", "static")) and self._lambda():
            self._body()
            return
        if t == "delegate":
            self.i += 1
            if self.take("("):
                self._params(")")
            self.need(BLOCK)
        elif t == "new":
            self.i += 1
            if self.take("["):
                while self.take(","):
                    pass
                self.need("]")
                self.need(BLOCK)
            elif self.t[self.i] == BLOCK:
                self.i += 1
            elif self.t[self.i] == "(":
                self.i += 1
                self.args(")")
                self.take(BLOCK)
            else:
                self._type()
                if self.take("("):
                    self.args(")")
                    self.take(BLOCK)
                elif self.t[self.i] == "[":
                    self.i += 1
                    self.args("]")
                    while self.t[self.i] == "[" and self.t[self.i + 1] in (",", "]"):
                        self.i += 1
                        while self.take(","):
                            pass
                        self.need("]")
                    self.take(BLOCK)
                elif not self.take(BLOCK):
                    raise Bad("new")
        elif t == "stackalloc":
            self.i += 1
            if self.take("["):
                self.args("]")
                self.take(BLOCK)
            else:
                self._type()
                if self.t[self.i - 1] == "]":  # the size is that of the block
                    self.need(BLOCK)
                else:
                    self.need("[")
                    self.args("]")
                    self.take(BLOCK)
        elif t in ("typeof", "sizeof"):
            self.i += 1
            self.need("(")
            self._type()
            self.need(")")
        elif t in ("checked", "unchecked"):
            self.i += 1
            self.need("(")
            self.expr()
            self.need(")")
        elif t == "default":
            self.i += 1
            if self.take("("):
                self._type()
                self.need(")")
        elif t in ("null", "this", "base", STR):
            self.i += 1
        elif t == "(":
            self.i += 1
            while True:
                if self._is_name(0) and self.t[self.i + 1] == ":":
                    self.i += 2
                if self._is_name(0) and self._is_name(1):  # deconstruction with types
                    self._type()
                    self.need_name()
                else:
                    self.expr()
                if not self.take(","):
                    break
            self.need(")")
        elif t == "[":
            self.i += 1
            self.args("]")
        elif self.name():
            if self.take("::"):
                self.need_name()
            self._generic()
        elif t == "void":
            raise Bad("void")
        else:
            raise Bad(t or "end")
        self._postfix()

    def _generic(self) -> None:
        """Type arguments of a name in an expression, if what follows agrees."""
        if self.t[self.i] != "<":
            return
        start = self.i
        try:
            self._args()
        except Bad:
            self.i = start
            return
        if self.t[self.i] not in ("(", ")", "]", ":", ";", ",", ".", "?", "==", "!=", "|", "^", "&&", "||", "&", "[", BLOCK, "?.", "", "}"):
            self.i = start

    def _postfix(self) -> None:
        while True:
            t = self.t[self.i]
            if t in (".", "?.", "->"):
                self.i += 1
                if t == "?." and self.t[self.i] == "[":
                    continue
                if not self.name():
                    raise Bad("member")
                self._generic()
            elif t == "(":
                self.i += 1
                self.args(")")
            elif t == "[":
                self.i += 1
                self.args("]")
            elif t == "?" and self.t[self.i + 1] == "[":
                # either an element of something that may be null or a condition with a collection
                start = self.i
                try:
                    self.i += 2
                    self.args("]")
                    if self.t[self.i] == ":":
                        raise Bad("condition")
                except Bad:
                    self.i = start
                    return
            elif t in ("++", "--"):
                self.i += 1
            elif t == "!" and self.t[self.i + 1] != "=":
                self.i += 1
            else:
                return

    def args(self, close: str) -> None:
        if self.take(close):
            return
        while True:
            if self._is_name(0) and self.t[self.i + 1] == ":":
                self.i += 2
            while self.t[self.i] in ("ref", "out", "in"):
                self.i += 1
            start = self.i
            if self.t[self.i - 1] == "out" and self.type_() and self.name():
                pass
            else:
                self.i = start
                self.expr()
            if not self.take(","):
                break
            if close == "]" and self.t[self.i] == "]":
                break
        self.need(close)

    # statements
    def declarators(self) -> None:
        while True:
            self.need_name()
            if self.take("["):
                self.args("]")
            if self.take("="):
                self._body()
            if not self.take(","):
                return

    def statement(self) -> None:
        """A statement without blocks of its own, up to its semicolon (not in the tokens)."""
        t = self.t[self.i]
        while self._is_name(0) and self.t[self.i + 1] == ":" and self.t[self.i + 2] != ":":
            self.i += 2
            t = self.t[self.i]
        while self.take("["):
            self.skip_to("]")
            t = self.t[self.i]
        if t == "":
            return
        if t in ("if", "while"):
            self.i += 1
            self.need("(")
            self.expr()
            self.need(")")
            self.statement()
        elif t == "lock":
            self.i += 1
            self.need("(")
            self.expr()
            self.need(")")
            self.statement()
        elif t == "else":
            self.i += 1
            self.statement()
        elif t == "for":
            self._for()
            self.statement()
        elif t == "foreach" or t == "await" and self.t[self.i + 1] == "foreach":
            self._foreach()
            self.statement()
        elif t in ("using", "fixed") and self.t[self.i + 1] == "(" or t == "await" and self.t[self.i + 1] == "using" and self.t[self.i + 2] == "(":
            self._using()
            self.statement()
        elif t == "using" or t == "await" and self.t[self.i + 1] == "using":
            self.i += 1 if t == "using" else 2
            self._type()
            self.declarators()
        elif t == "do":
            self.i += 1
            self.statement()
        elif t in ("break", "continue"):
            self.i += 1
        elif t == "return":
            self.i += 1
            if self.t[self.i]:
                self.expr()
        elif t == "throw":
            self.i += 1
            if self.t[self.i]:
                self.expr()
        elif t == "yield" and self.t[self.i + 1] in ("return", "break"):
            self.i += 2
            if self.t[self.i - 1] == "return":
                self.expr()
        elif t == "goto":
            self.i += 1
            if self.take("case"):
                self.expr()
            elif not self.take("default"):
                self.need_name()
        elif t == "const":
            self.i += 1
            self._type()
            self.declarators()
        else:
            start = self.i
            while self.t[self.i] in ("static", "async", "unsafe", "extern"):
                self.i += 1
            if self.type_() and self._is_name(0):
                self.i += 1
                u = self.t[self.i]
                if u in ("=", "", ","):
                    self.i -= 1
                    try:
                        self.declarators()
                        return
                    except Bad:
                        pass
                elif u in ("(", "<"):
                    try:
                        self._method_rest()
                        return
                    except Bad:
                        pass
            self.i = start
            self.expr()

    def _for(self) -> None:
        self.i += 1
        self.need("(")
        if not self.take(";"):
            start = self.i
            if self.type_() and self._is_name(0):
                self.declarators()
            else:
                self.i = start
                self._list()
            self.need(";")
        if not self.take(";"):
            self.expr()
            self.need(";")
        if not self.take(")"):
            self._list()
            self.need(")")

    def _list(self) -> None:
        self.expr()
        while self.take(","):
            self.expr()

    def _foreach(self) -> None:
        self.take("await")
        self.i += 1
        self.need("(")
        start = self.i
        if not (self.type_() and self.name() and self.t[self.i] == "in"):
            self.i = start
            self.take("var")
            self.type_()
            if self.take("("):
                self.skip_to(")")
        self.need("in")
        self.expr()
        self.need(")")

    def _using(self) -> None:
        self.take("await")
        self.i += 1
        self.need("(")
        start = self.i
        if self.type_() and self._is_name(0):
            self.declarators()
        else:
            self.i = start
            self.expr()
        self.need(")")

    # members
    def attributes(self) -> None:
        while self.take("["):
            self.skip_to("]")

    def modifiers(self) -> None:
        while self.t[self.i] in _MODIFIERS and not (self.t[self.i] in ("async", "partial", "required") and self.t[self.i + 1] in ("(", "=", ";", "")):
            if self.t[self.i] == "file" and self.t[self.i + 1] not in _DECLARES:
                return
            self.i += 1

    def _constraints(self) -> None:
        while self.take("where"):
            self.need_name()
            self.need(":")
            while True:
                if self.take("new"):
                    self.need("(")
                    self.need(")")
                elif self.t[self.i] in ("class", "struct", "default"):
                    self.i += 1
                    self.take("?")
                else:
                    self._type()
                    if self.take("ref"):
                        self.need("struct")
                if not self.take(","):
                    break

    def _method_rest(self) -> None:
        if self.take("<"):
            self._type_list()
            self.need(">")
        self.need("(")
        self._params(")")
        self._constraints()
        if self.take("=>"):
            self.expr()
        self.end()

    def type_header(self) -> str:
        """`class X : Y where ...` and the like; the keyword."""
        kind = self.t[self.i]
        self.i += 1
        if kind == "record":
            self.take("class") or self.take("struct")
        self.need_name()
        if self.take("<"):
            self._type_list()
            self.need(">")
        if kind != "enum" and self.take("("):
            self._params(")")
        if self.take(":"):
            while True:
                self._type()
                if self.take("("):
                    self.args(")")
                if not self.take(","):
                    break
        self._constraints()
        return kind

    def member(self, block: bool) -> str:
        """A member's head before `{` (block) or whole before `;`; the kind of block that follows."""
        self.attributes()
        self.modifiers()
        t = self.t[self.i]
        if t in ("class", "struct", "interface", "enum") or t == "record" and self._is_name(1) or t == "record" and self.t[self.i + 1] in ("struct", "class"):
            kind = self.type_header()
            self.end()
            return "enum" if kind == "enum" else "type"
        if t == "delegate" and not block and self.t[self.i + 1] != "*":
            self.i += 1
            self._type()
            self.need_name()
            self._method_rest()
            return ""
        if t == "event":
            self.i += 1
            self._type()
            if block:
                self._dotted()
                self.end()
                return "accessors"
            self.declarators()
            self.end()
            return ""
        if t in ("implicit", "explicit"):
            self.i += 1
            self.need("operator")
            self.take("checked")
            self._type()
            self.need("(")
            self._params(")")
            return self._method_end(block)
        if t == "~":
            self.i += 1
            self.need_name()
            self.need("(")
            self.need(")")
            return self._method_end(block)
        if self._is_name(0) and self.t[self.i + 1] == "(":
            self.i += 2
            self._params(")")
            if self.take(":"):
                if not (self.take("base") or self.take("this")):
                    raise Bad("initializer")
                self.need("(")
                self.args(")")
            return self._method_end(block)
        self._type()
        if self.take("operator"):
            self.take("checked")
            while self.t[self.i] != "(":
                if not self.t[self.i]:
                    raise Bad("operator")
                self.i += 1
            self.i += 1
            self._params(")")
            return self._method_end(block)
        if self.t[self.i] == "this":
            self.i += 1
            self.need("[")
            self._params("]")
            if self.take("=>"):
                self._body()
                self.end()
                return ""
            self.end()
            if not block:
                raise Bad("indexer")
            return "accessors"
        first = self.i
        self._dotted()
        if self.t[self.i] == "this":
            self.i += 1
            self.need("[")
            self._params("]")
            self.end()
            return "accessors"
        if self.t[self.i] in ("(", "<"):
            if self.take("<"):
                self._type_list()
                self.need(">")
            self.need("(")
            self._params(")")
            self._constraints()
            return self._method_end(block)
        if block:
            self.end()
            return "accessors"
        if self.take("=>"):
            self.expr()
            self.end()
            return ""
        self.i = first
        self.declarators()
        self.end()
        return ""

    def _dotted(self) -> None:
        self.need_name()
        while self.t[self.i] in (".", "<"):
            if self.t[self.i] == ".":
                self.i += 1
                if self.t[self.i] == "this":
                    return
                self.need_name()
            else:
                start = self.i
                try:
                    self._args()
                except Bad:
                    self.i = start
                    return
                if self.t[self.i] == "(":
                    self.i = start
                    return

    def _method_end(self, block: bool) -> str:
        if not block and self.take("=>"):
            self.expr()
        self.end()
        return "code" if block else ""


# what may stand before a block in code, and what kind of block that is
_CODE_HEADS = ("if", "else", "for", "foreach", "while", "do", "switch", "try", "catch", "finally", "lock", "using", "fixed", "checked", "unchecked", "unsafe", "await")


def _labels(p: P) -> None:
    """Case labels before a statement inside a switch."""
    while p.t[p.i] in ("case", "default"):
        if p.t[p.i] == "default":
            if p.t[p.i + 1] != ":":
                return
            p.i += 2
        else:
            p.i += 1
            p.pattern_or_expr()
            if p.take("when"):
                p.expr()
            p.need(":")


def _before_arrow(p: P) -> None:
    """A condition up to the arrow of its arm, which is none of a lambda's."""
    depth, j = 0, p.i
    while p.t[j] and not (depth == 0 and p.t[j] == "=>"):
        depth += (p.t[j] in "([") - (p.t[j] in ")]")
        j += 1
    q = P("")
    q.t, q.n = [*p.t[p.i : j], ""], j - p.i
    q.expr()
    q.end()
    p.i = j


def _pattern_or_expr(self: P) -> None:
    start = self.i
    try:
        self.pattern()
        if self.t[self.i] not in (":", "when", "=>"):
            raise Bad("pattern")
    except Bad:
        self.i = start
        self.expr()


P.pattern_or_expr = _pattern_or_expr


def _open(kind: str, head: str) -> tuple[str, bool]:
    """Kind of the block that opens after `head` inside a block of `kind`, and whether it is part of an expression."""
    p = P(head)
    if kind in ("file", "type"):
        if kind == "file" and p.t[0] == "namespace":
            p.i = 1
            p._dotted()
            p.end()
            return "file", False
        # initialisers, property bodies and lambdas stand inside a member
        p.attributes()
        p.modifiers()
        declares = p.t[p.i] in ("class", "struct", "interface", "enum", "record")
        p.i = 0
        cut = None if declares else _expression_at(p.t)
        if cut is None:
            return p.member(True), False
        return cut, True
    if kind == "accessors":
        p.attributes()
        p.modifiers()
        if p.t[p.i] not in ("get", "set", "init", "add", "remove"):
            raise Bad("accessor")
        p.i += 1
        p.end()
        return "code", False
    if kind in ("code", "switch"):
        if kind == "switch":
            if "case" in p.t and _open_label(p.t):
                return "props", True
            _labels(p)
        while p._is_name(0) and p.t[p.i + 1] == ":" and p.t[p.i] != "default":
            p.i += 2
        t = p.t[p.i]
        if not t:
            return "code", False
        cut = _expression_at(p.t[p.i :])
        if cut is not None:
            return cut, True
        if t in _CODE_HEADS:
            return _code_head(p), False
        p.attributes()
        p.modifiers()
        p._type()
        p.need_name()
        if p.take("<"):
            p._type_list()
            p.need(">")
        p.need("(")
        p._params(")")
        p._constraints()
        p.end()
        return "code", False
    if kind in ("init", "arms", "props"):
        cut = _expression_at(p.t)
        return cut or "init", True
    raise Bad(kind)


def _open_label(t: list[str]) -> bool:
    """Whether the last case label has not come to its colon: the block is a pattern's."""
    depth = 0
    for x in t[len(t) - 1 - t[::-1].index("case") + 1 :]:
        depth += (x in ("(", "[")) - (x in (")", "]"))
        if x == ":" and depth == 0:
            return False
    return True


def _code_head(p: P) -> str:
    t = p.t[p.i]
    if t in ("if", "while", "lock", "switch"):
        p.i += 1
        p.need("(")
        p.expr()
        while p.take(","):
            p.expr()
        p.need(")")
        if p.t[p.i] in _CODE_HEADS:
            return _code_head(p)
        p.end()
        return "switch" if t == "switch" else "code"
    if t == "else":
        p.i += 1
        if p.t[p.i] in _CODE_HEADS:
            return _code_head(p)
        p.end()
        return "code"
    if t in ("do", "try", "finally", "checked", "unchecked", "unsafe"):
        p.i += 1
        p.end()
        return "code"
    if t == "catch":
        p.i += 1
        if p.take("("):
            p._type()
            p.name()
            p.need(")")
        if p.take("when"):
            p.need("(")
            p.expr()
            p.need(")")
        p.end()
        return "code"
    if t == "for":
        p._for()
    elif t == "foreach" or t == "await" and p.t[p.i + 1] == "foreach":
        p._foreach()
    elif t in ("using", "fixed", "await"):
        p._using()
    if p.t[p.i] in _CODE_HEADS:
        return _code_head(p)
    p.end()
    return "code"


def _expression_at(t: list[str]) -> str | None:
    """If the block after these tokens belongs to an expression: its kind."""
    depth = 0
    assigned = arrow = made = False
    for x in t:
        if x in ("(", "["):
            depth += 1
        elif x in (")", "]"):
            depth -= 1
        elif depth == 0 and x in ("=", "+=", "??=", "return", "=>"):
            assigned = True
        elif x == "new" and depth == 0 and t[0] not in _MODIFIERS:
            made = True
    if depth < 0:
        raise Bad(")")
    last = t[-2] if len(t) > 1 else ""
    if last == "=>":
        return "code"
    if last == "switch" and (assigned or depth or len(t) > 2 and t[0] != "switch"):
        return "arms"
    if last == "is" or (last in ("and", "or", "not") and depth + assigned):
        return "props"
    if depth == 0 and not assigned and not made and last != "with":
        if last in ("delegate",):
            return "code"
        return None
    # the nearest delegate( ... ) opens code, all else an initialiser or pattern
    if "delegate" in t:
        k = len(t) - 1 - t[::-1].index("delegate")
        if t[k + 1] == "" or (t[k + 1] == "(" and last == ")"):
            return "code"
    joined = " ".join(t)
    if re.search(r"\bis( \w+)?(?: \. \w+)* $", joined):
        return "props"
    return "init"


def _close(kind: str, rest: str) -> None:
    """What stands between the last cut and `}`."""
    p = P(rest)
    if kind in ("code", "file", "type", "accessors"):
        p.end()
    elif kind == "switch":
        _labels(p)
        p.end()
    elif kind == "enum":
        while p.t[p.i]:
            p.attributes()
            p.need_name()
            if p.take("="):
                p.expr()
            if not p.take(","):
                break
        p.end()
    elif kind == "init":
        while p.t[p.i]:
            if p.t[p.i] == BLOCK and p.t[p.i + 1] in (",", ""):
                p.i += 1
            elif p.t[p.i] == "[":
                start = p.i
                p.i += 1
                try:
                    p.args("]")
                    p.need("=")
                    p._body()
                except Bad:
                    p.i = start
                    p.expr()
            else:
                if p._is_name(0) and p.t[p.i + 1] == "=":
                    p.i += 2
                    p._body()
                elif p._is_name(0) and p.t[p.i + 1] == ":":
                    p.i += 2
                    p.pattern()
                else:
                    p.expr()
            if not p.take(","):
                break
        p.end()
    elif kind == "props":
        while p.t[p.i]:
            p.need_name()
            while p.take("."):
                p.need_name()
            p.need(":")
            p.pattern()
            if not p.take(","):
                break
        p.end()
    elif kind == "arms":
        while p.t[p.i]:
            p.pattern_or_expr()
            if p.take("when"):
                _before_arrow(p)
            p.need("=>")
            p._body()
            if not p.take(","):
                break
        p.end()


def _simple(kind: str, text: str) -> None:
    """What stands before a semicolon inside a block of `kind`."""
    p = P(text)
    if kind == "file":
        if p.t[0] == "":
            return
        if p.t[0] in ("using", "global") or p.t[0] == "extern":
            p.i = 1
            if p.t[0] == "global":
                p.need("using")
            if p.t[0] == "extern":
                p.need_name()
                p.need_name()
                p.end()
                return
            p.take("static") or p.take("unsafe")
            if p._is_name(0) and p.t[p.i + 1] == "=":
                p.i += 2
            p._type()
            p.end()
            return
        if p.t[0] == "namespace":
            p.i = 1
            p._dotted()
            p.end()
            return
        try:
            p.member(False)
        except Bad:
            q = P(text)
            q.statement()
            q.end()
        return
    if kind == "type":
        if p.t[0]:
            p.member(False)
        return
    if kind == "accessors":
        p.attributes()
        p.modifiers()
        if p.t[p.i] not in ("get", "set", "init", "add", "remove"):
            raise Bad("accessor")
        p.i += 1
        if p.take("=>"):
            p.expr()
        p.end()
        return
    if kind in ("code", "switch"):
        if kind == "switch":
            _labels(p)
        p.statement()
        p.end()
        return
    if kind == "enum":
        raise Bad(";")
    raise Bad(";")


_memo: dict[tuple, object] = {}
_FIRST = re.compile(r"\w+")
_CUT = re.compile(r"([;{}])")


def _remember(f, kind: str, text: str):
    key = (f, kind, text)
    r = _memo.get(key)
    if r is None:
        try:
            r = f(kind, text) or True
        except Bad:
            r = False
        except (IndexError, RecursionError):
            r = False
        if len(_memo) > 400_000:  # a bound on memory, not on what is parsed
            _memo.clear()
        _memo[key] = r
    if r is False:
        raise Bad(text)
    return r


def mask(s: str) -> str | None:
    """Text without comments, with literals as one mark and names as `a`; None if a literal or comment does not end."""
    m = _MASK.sub(lambda x: " " if x[0][0] == "/" else STR, s)
    if '"' in m or "'" in m or "/*" in m:
        return None
    return m


def _branches(m: str) -> list[str] | None:
    """The readings of a text with compiler switches: with all first and with all last branches."""
    if "#" not in m:
        return [m]
    outs: list[list[str]] = [[], []]
    stack: list[list[bool]] = []  # of each open #if: has an else been seen; is the branch read in either reading
    for line in m.split("\n"):
        t = line.lstrip()
        if t.startswith("#"):
            word = re.match(r"#\s*(\w*)", t)[1]
            if word == "if":
                stack.append([False, True, False, False])
            elif word in ("elif", "else"):
                if not stack or stack[-1][0]:
                    return None
                top = stack[-1]
                top[1] = False
                top[2] = word == "else"
                top[0] = word == "else"
                top[3] = True
            elif word == "endif":
                if not stack:
                    return None
                stack.pop()
            elif word not in ("region", "endregion", "pragma", "define", "undef", "nullable", "line", "error", "warning", "r", "load"):
                return None
            continue
        if "#" in line:
            return None
        if all(x[1] for x in stack):
            outs[0].append(line)
        if all(x[2] for x in stack):
            outs[1].append(line)
    if stack:
        return None
    a, b = "\n".join(outs[0]), "\n".join(outs[1])
    return [a] if a == b else [a, b]


def _run(m: str) -> bool:
    m = _LOWER.sub(lambda x: _KEYS.get(x[0], "a"), _OTHER_NAME.sub("a", m))
    parts = _CUT.split(m)
    stack: list[tuple[str, str]] = []  # kind of the enclosing block; the expression that goes on after this one
    kind, pending, before = "file", "", ""
    try:
        for k in range(0, len(parts) - 1, 2):
            text, cut = parts[k], parts[k + 1]
            text = " ".join(text.split())
            if pending:
                text = f"{pending} {text}"
                pending = ""
            if cut == ";":
                if text.startswith("for") and text.count("(") > text.count(")") or " for (" in text and text.count("(") > text.count(")"):
                    pending = text + " ;"
                    continue
                if kind in ("code", "switch"):
                    word = text.split(" ", 1)[0].split("(", 1)[0]
                    if word == "else" and before not in ("if", "else if") or word in ("catch", "finally") or before == "try":
                        return False
                    if before == "do":
                        if not re.match(r"while ?\(.*\)$", text):
                            return False
                        before = ""
                        continue
                    _remember(_simple, kind, text)
                    before = "if" if word == "if" else "else if" if text.startswith("else if") else ""
                else:
                    _remember(_simple, kind, text)
                    before = ""
            elif cut == "{":
                inner, inside = _remember(_open, kind, text)
                if not inside and kind in ("code", "switch"):
                    first = text.split(" ", 1)[0].split("(", 1)[0]
                    if first == "else" and before not in ("if", "else if") or first in ("catch", "finally") and before not in ("try", "catch") or before == "try" and first not in ("catch", "finally") or before == "do":
                        return False
                    word = "else if" if text.startswith("else if") else first
                else:
                    word = ""
                stack.append((kind, text if inside else None, word))
                kind, before = inner, ""
            else:
                if before in ("try", "do") and kind in ("code", "switch"):
                    return False
                _remember(_close, kind, text)
                if not stack:
                    return False
                kind, resume, before = stack.pop()
                if resume is not None:
                    pending = f"{resume} {BLOCK}"
                    before = ""
                elif kind == "type" and parts[k + 2].lstrip().startswith("="):
                    # a property's initialiser goes on to its semicolon
                    pending = "a a"
        tail = f"{pending} {parts[-1]}".strip()
        if tail.startswith("["):
            # assembly attributes may end a file without a block
            p = P(tail)
            p.attributes()
            p.end()
        elif tail:
            return False
        return not stack
    except Bad:
        return False


def parses(s: str) -> bool:
    """Whether a text is syntactically valid C#; an empty one is."""
    s = s.lstrip("\ufeff")
    if "\x00" in s or STR in s or BLOCK in s:
        return False
    m = mask(s)
    if m is None:
        return False
    readings = _branches(m)
    return readings is not None and any(_run(r) for r in readings)
