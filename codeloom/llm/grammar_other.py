"""Syntax checks of F#, T-SQL, XML and JSON."""

from __future__ import annotations

import json
import re
from xml.parsers import expat


class Bad(Exception):
    pass


# ---------------------------------------------------------------- XML and JSON


def xml_parses(s: str) -> bool:
    """Whether a text is one well-formed XML document; a byte-order mark may lead it."""
    s = s.removeprefix("﻿")
    parser = expat.ParserCreate()
    try:
        parser.Parse(s.encode("utf-8", "surrogatepass"), True)
        return True
    except (expat.ExpatError, ValueError):
        # the text is Unicode here whatever encoding its declaration names
        bare = re.sub(r"^<\?xml[^>]*\?>", lambda m: " " * len(m[0]), s)
        if bare == s or "encoding" not in s[: s.find("?>") + 1]:
            return False
        try:
            expat.ParserCreate("utf-8").Parse(bare.strip().encode("utf-8", "surrogatepass"), True)
            return True
        except (expat.ExpatError, ValueError):
            return False


def _no_constant(x: str) -> None:
    raise ValueError(x)


def json_parses(s: str) -> bool:
    """Whether a text is one strict JSON value; a byte-order mark may lead it."""
    try:
        json.loads(s.removeprefix("﻿"), parse_constant=_no_constant, parse_int=str, parse_float=str)
        return True
    except (ValueError, RecursionError):
        return False


# ---------------------------------------------------------------------- T-SQL

_SQL_MASK = re.compile(r"--[^\n]*|N?'(?:[^']|'')*'|\[(?:[^\]\n]|\]\])+\]|\"(?:[^\"\n]|\"\")*\"|/\*")
_SQL_TOKEN = re.compile(r"@{0,2}[^\W\d][\w$#@]*|#+\w+|0[xX][0-9a-fA-F]*|\d+(?:\.\d*)?(?:[eE][-+]?\d+)?|\.\d+|<>|!=|<=|>=|!<|!>|\+=|-=|\*=|/=|\|\||::|\x01|\S")
#: The first token behind blanks and comments that do not nest.
_SQL_FIRST = re.compile(r"(?:\s+|--[^\n]*(?:\n|\Z)|/\*(?:(?!/\*|\*/).)*\*/)*(\w+|\S)", re.S)
_ROW = re.compile(r"\(0(?:,0|,\x01|,-0)*\)")
_NUMBER = re.compile(r"\b\d+(?:\.\d+)?\b")
_SQL_START = frozenset(
    "create alter drop insert update delete select with exec execute declare set if begin end go use print merge truncate grant revoke deny return while raiserror throw commit rollback save open close fetch deallocate backup restore bulk waitfor dbcc else break continue goto checkpoint kill".split()
)
_SQL_WORDS = frozenset("select from where group order having union values set into on as and or not in is null like between exists case when then else end join inner left right full cross outer by create table insert update delete primary key constraint foreign references unique check default index add alter drop".split())


def _sql_mask(s: str) -> str | None:
    """Without comments; strings as \\x01, quoted names as q; None if one does not end."""
    out, at = [], 0
    while m := _SQL_MASK.search(s, at):
        out.append(s[at : m.start()])
        t = m[0]
        at = m.end()
        if t == "/*":
            depth = 1
            while depth:
                a, b = s.find("/*", at), s.find("*/", at)
                if b < 0:
                    return None
                if 0 <= a < b:
                    depth, at = depth + 1, a + 2
                else:
                    depth, at = depth - 1, b + 2
            out.append(" ")
        elif t[0] == "-":
            out.append(" ")
        elif t[0] in "N'":
            out.append("\x01")
        else:
            out.append(" q ")
    out.append(s[at:])
    m = "".join(out)
    return None if "'" in m or '"' in m else m


class S:
    """Tokens of one batch in lower case."""

    def __init__(self, text: str):
        self.t = [x.lower() for x in _SQL_TOKEN.findall(text)] + [""]
        self.i = 0

    def take(self, *xs: str) -> bool:
        if self.t[self.i] in xs and self.t[self.i]:
            self.i += 1
            return True
        return False

    def need(self, *xs: str) -> None:
        if not self.take(*xs):
            raise Bad(str(xs))

    def word(self) -> bool:
        t = self.t[self.i]
        if t and (t[0].isalpha() or t[0] in "_@#") and t not in _SQL_WORDS:
            self.i += 1
            return True
        return False

    def name(self) -> None:
        if not self.word():
            raise Bad("name")
        while self.take("."):
            if self.t[self.i] == ".":
                continue
            if self.t[self.i] and self.t[self.i][0].isalpha():
                self.i += 1
            else:
                raise Bad("name")

    def names(self) -> None:
        self.need("(")
        while True:
            self.name()
            self.take("asc", "desc")
            if not self.take(","):
                break
        self.need(")")

    # expressions
    def expr(self) -> None:
        self._not()
        while self.take("and", "or"):
            self._not()

    def _not(self) -> None:
        while self.take("not"):
            pass
        if self.take("exists"):
            self.need("(")
            self.select()
            self.need(")")
            return
        self._sum()
        while True:
            if self.take("=", "<", ">", "<=", ">=", "<>", "!=", "!<", "!>"):
                if self.take("all", "any", "some"):
                    pass
                self._sum()
            elif self.take("is"):
                self.take("not")
                self.need("null")
            else:
                self.take("not")
                if self.take("like"):
                    self._sum()
                    if self.take("escape"):
                        self._sum()
                elif self.take("between"):
                    self._sum()
                    self.need("and")
                    self._sum()
                elif self.take("in"):
                    self.need("(")
                    if self.t[self.i] == "select":
                        self.select()
                    else:
                        self.list_()
                    self.need(")")
                else:
                    return

    def _sum(self) -> None:
        self._zoned()
        while self.take("+", "-", "*", "/", "%", "&", "|", "^", "||"):
            self._zoned()

    def _zoned(self) -> None:
        """An operand with its collation and time zones."""
        self._atom()
        while True:
            if self.take("collate"):
                self.name()
            elif self.t[self.i] == "at" and self.t[self.i + 1] == "time":
                self.i += 2
                self.need("zone")
                self._atom()
            else:
                return

    def list_(self) -> None:
        self.expr()
        while self.take(","):
            self.expr()

    def _atom(self) -> None:
        while self.take("-", "+", "~"):
            pass
        t = self.t[self.i]
        if t == "(":
            self.i += 1
            if self.t[self.i] in ("select", "with"):
                self.select()
            else:
                self.expr()
                while self.take(","):
                    self.expr()
            self.need(")")
        elif t == "case":
            self.i += 1
            if self.t[self.i] != "when":
                self.expr()
            if self.t[self.i] != "when":
                raise Bad("case")
            while self.take("when"):
                self.expr()
                self.need("then")
                self.expr()
            if self.take("else"):
                self.expr()
            self.need("end")
        elif t == "\x01" or t == "null" or t == "default" or t[:1].isdigit() or (t[:1] == "." and len(t) > 1):
            self.i += 1
        elif t == "$" and self.t[self.i + 1] == "action":
            self.i += 2
        elif t == "next" and self.t[self.i + 1] == "value":
            self.i += 2
            self.need("for")
            self.name()
        elif t in ("left", "right") and self.t[self.i + 1] == "(":
            self.i += 1
            self._call()
        elif t in ("cast", "try_cast") and self.t[self.i + 1] == "(":
            self.i += 2
            self.expr()
            self.need("as")
            self.type_()
            self.need(")")
        elif t in ("convert", "try_convert") and self.t[self.i + 1] == "(":
            self.i += 2
            self.type_()
            self.need(",")
            self.list_()
            self.need(")")
        else:
            self.name()
            if self.t[self.i] == "(":
                self._call()

    def _call(self) -> None:
        self.need("(")
        self.take("distinct")
        if self.take("*"):
            pass
        elif self.t[self.i] != ")":
            self.list_()
        self.need(")")
        if self.take("within"):
            self.need("group")
            self.need("(")
            self.need_at("order")
            self._order()
            self.need(")")
        if self.t[self.i] in ("respect", "ignore") and self.t[self.i + 1] == "nulls":
            self.i += 2
        if self.take("over"):
            if self.t[self.i] == "(":
                self.skip()
            else:
                self.name()

    def need_at(self, *xs: str) -> None:
        """What has to stand here; it is not taken."""
        if self.t[self.i] not in xs:
            raise Bad(str(xs))

    def skip(self) -> None:
        """A bracket with balanced contents."""
        self.need("(")
        depth = 1
        while depth:
            t = self.t[self.i]
            if not t:
                raise Bad(")")
            depth += (t == "(") - (t == ")")
            self.i += 1

    def type_(self) -> None:
        self.name()
        if self.take("("):
            if not (self.t[self.i].isdigit() or self.t[self.i] == "max"):
                raise Bad("size")
            self.i += 1
            if self.take(","):
                if not self.t[self.i].isdigit():
                    raise Bad("scale")
                self.i += 1
            self.need(")")

    # statements
    def column(self) -> None:
        """A column's or table constraint's definition."""
        if self.take("constraint"):
            self.name()
            self._constraint()
            return
        if self.t[self.i] in ("primary", "unique", "foreign", "check"):
            self._constraint()
            return
        if self.take("index"):
            self.name()
            self.take("unique", "clustered", "nonclustered")
            self.names()
            return
        self.name()
        if self.take("as"):
            self.expr()
            self.take("persisted")
            return
        self.type_()
        while True:
            if self.take("not"):
                self.need("null")
            elif self.take("null", "sparse", "rowguidcol"):
                pass
            elif self.take("identity"):
                if self.t[self.i] == "(":
                    self.skip()
            elif self.take("constraint"):
                self.name()
                self._constraint()
            elif self.t[self.i] in ("primary", "unique", "foreign", "references", "check", "default"):
                self._constraint()
            elif self.take("collate"):
                self.name()
            else:
                return

    def _constraint(self) -> None:
        if self.take("primary"):
            self.need("key")
            self.take("clustered", "nonclustered")
            if self.t[self.i] == "(":
                self.names()
        elif self.take("unique"):
            self.take("clustered", "nonclustered")
            if self.t[self.i] == "(":
                self.names()
        elif self.take("foreign"):
            self.need("key")
            self.names()
            self.need("references")
            self._references()
        elif self.take("references"):
            self._references()
        elif self.take("check"):
            self.need("(")
            self.expr()
            self.need(")")
        elif self.take("default"):
            self._sum()
            if self.take("for"):
                self.name()
        else:
            raise Bad("constraint")

    def _references(self) -> None:
        self.name()
        if self.t[self.i] == "(":
            self.names()
        while self.take("on"):
            self.need("delete", "update")
            if self.take("no"):
                self.need("action")
            elif self.take("set"):
                self.need("null", "default")
            else:
                self.need("cascade")

    def select(self) -> None:
        if self.take("with"):
            while True:
                self.name()
                if self.t[self.i] == "(":
                    self.names()
                self.need("as")
                self.need("(")
                self.select()
                self.need(")")
                if not self.take(","):
                    break
        if self.take("("):
            self.select()
            self.need(")")
        else:
            self._select()
        while self.take("union", "except", "intersect"):
            self.take("all")
            self.select()
        self._order()

    def _order(self) -> None:
        if self.take("order"):
            self.need("by")
            while True:
                self.expr()
                self.take("asc", "desc")
                if not self.take(","):
                    break
            if self.take("offset"):
                self.expr()
                self.need("row", "rows")
                if self.take("fetch"):
                    self.need("next", "first")
                    self.expr()
                    self.need("row", "rows")
                    self.need("only")

    def _select(self) -> None:
        self.need("select")
        self.take("distinct", "all")
        if self.take("top"):
            if self.take("("):
                self.expr()
                self.need(")")
            else:
                self._atom()
            self.take("percent")
            if self.t[self.i] == "with" and self.t[self.i + 1] == "ties":
                self.i += 2
        while True:
            if self.take("*"):
                pass
            else:
                start = self.i
                if self.word() and self.take("=") and start >= 0:
                    self.expr()
                else:
                    self.i = start
                    if self.word() and self.t[self.i] == "." and self.t[self.i + 1] == "*":
                        self.i += 2
                    else:
                        self.i = start
                        self.expr()
                    if self.take("as"):
                        if not self.take("\x01"):
                            self.name()
                    elif self.t[self.i] not in _SQL_START:
                        self.word()
            if not self.take(","):
                break
        if self.take("into"):
            self.name()
        if self.take("from"):
            self.sources()
        if self.take("where"):
            self.expr()
        if self.take("group"):
            self.need("by")
            self._grouping()
            if self.t[self.i] == "with" and self.t[self.i + 1] in ("rollup", "cube"):
                self.i += 2
        if self.take("having"):
            self.expr()
        self._for()

    def _for(self) -> None:
        """FOR XML, JSON or BROWSE."""
        if not self.take("for"):
            return
        if self.take("browse"):
            return
        kind = self.t[self.i]
        self.need("xml", "json")
        self.need(*(("raw", "auto", "path", "explicit") if kind == "xml" else ("auto", "path")))
        self._text()
        while self.take(","):
            if self.take("root"):
                self._text()
            elif self.take("elements"):
                self.take("xsinil", "absent")
            elif self.take("binary"):
                self.need("base64")
            elif self.take("xmlschema"):
                self._text()
            else:
                self.need("type", "xmldata", "include_null_values", "without_array_wrapper")

    def _text(self) -> None:
        """A string in brackets, if there is one."""
        if self.take("("):
            self.need("\x01")
            self.need(")")

    def _grouping(self) -> None:
        """Elements of GROUP BY."""
        while True:
            if self.t[self.i] == "grouping" and self.t[self.i + 1] == "sets":
                self.i += 2
                self.need("(")
                self._grouping()
                self.need(")")
            elif self.t[self.i] == "(" and self.t[self.i + 1] == ")":
                self.i += 2
            else:
                self.expr()
            if not self.take(","):
                return

    def sources(self) -> None:
        while True:
            self._source()
            while True:
                if self.take("cross", "outer"):
                    self.need("join", "apply")
                    self._source()
                    continue
                if self.t[self.i] in ("inner", "left", "right", "full", "join"):
                    self.take("inner", "left", "right", "full")
                    self.take("outer")
                    self.need("join")
                    self._source()
                    self.need("on")
                    self.expr()
                    continue
                if self.t[self.i] in ("pivot", "unpivot") and self.t[self.i + 1] == "(":
                    self._pivot()
                    continue
                break
            if not self.take(","):
                return

    def _pivot(self) -> None:
        pivot = self.t[self.i] == "pivot"
        self.i += 2
        self.name()
        if pivot:
            self._call()
        self.need("for")
        self.name()
        self.need("in")
        self.names()
        self.need(")")
        self.take("as")
        self.name()

    def _source(self) -> None:
        if self.take("("):
            if self.t[self.i] in ("select", "with"):
                self.select()
            elif self.t[self.i] == "values":
                self.values()
            else:
                self.sources()
            self.need(")")
        else:
            self.name()
            if self.t[self.i] == "(":
                self._call()
        if self.take("as"):
            self.name()
        else:
            self._alias()
        if self.t[self.i] == "(":
            self.names()
        if self.take("with"):
            self.skip()
            if self.take("as"):
                self.name()
            else:
                self._alias()

    def _alias(self) -> None:
        t = self.t[self.i]
        if t not in _SQL_START and t not in ("with", "apply", "for", "option", "output", "when", "using") and not (t in ("pivot", "unpivot") and self.t[self.i + 1] == "("):
            self.word()

    def _output(self) -> None:
        """OUTPUT clauses of statements that change rows."""
        while self.take("output"):
            while True:
                if self.t[self.i] in ("inserted", "deleted") and self.t[self.i + 1 : self.i + 3] == [".", "*"]:
                    self.i += 3
                else:
                    self.expr()
                    if self.take("as"):
                        self.name()
                    elif self.t[self.i] not in _SQL_START and self.t[self.i] != "output":
                        self.word()
                if not self.take(","):
                    break
            if self.take("into"):
                self.name()
                if self.t[self.i] == "(":
                    self.names()

    def _top(self) -> None:
        if self.take("top"):
            self.need("(")
            self.expr()
            self.need(")")
            self.take("percent")

    def _where(self) -> None:
        """WHERE of a statement that changes rows."""
        if self.take("where"):
            if self.t[self.i] == "current" and self.t[self.i + 1] == "of":
                self.i += 2
                self.take("global")
                self.name()
            else:
                self.expr()
        if self.take("option"):
            self.skip()

    def _set(self) -> None:
        self.need("set")
        while True:
            self.name()
            self.need("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=")
            self.expr()
            if self.take("="):  # @variable = column = expression
                self.expr()
            if not self.take(","):
                return

    def _merge(self) -> None:
        self._top()
        self.take("into")
        self.name()
        if self.take("with"):
            self.skip()
        if self.take("as"):
            self.name()
        else:
            self._alias()
        self.need("using")
        self._source()
        self.need("on")
        self.expr()
        self.need_at("when")
        while self.take("when"):
            absent = self.take("not")
            self.need("matched")
            if self.take("by"):
                if not absent:
                    raise Bad("by")
                self.need("target", "source")
            if self.take("and"):
                self.expr()
            self.need("then")
            if self.take("update"):
                self._set()
            elif self.take("insert"):
                if self.t[self.i] == "(":
                    self.names()
                if self.take("default"):
                    self.need("values")
                else:
                    self.values()
            else:
                self.need("delete")
        self._output()
        if self.take("option"):
            self.skip()

    def _permissions(self, granting: bool) -> None:
        """GRANT, REVOKE and DENY."""
        if not granting and self.take("grant"):
            self.need("option")
            self.need("for")
        while True:
            n = 0
            while self.t[self.i].isalpha() and self.t[self.i] not in ("on", "to", "from"):
                self.i += 1
                n += 1
            if not n:
                raise Bad("permission")
            if self.t[self.i] == "(":
                self.names()
            if not self.take(","):
                break
        if self.take("on"):
            self.name()
            if self.take("::"):
                self.name()
            if self.t[self.i] == "(":
                self.names()
        self.need("to", "from")
        self.name()
        while self.take(","):
            self.name()
        if self.take("with"):
            self.need("grant")
            self.need("option")
        self.take("cascade")
        if self.take("as"):
            self.name()

    def _backup(self, restore: bool) -> None:
        if restore and self.take("filelistonly", "headeronly", "verifyonly", "labelonly"):
            pass
        else:
            self.need("database", "log", "certificate", "master", "service", "transaction")
            if self.t[self.i] == "key":
                self.i += 1
            elif self.t[self.i] not in ("to", "from"):
                self.name()
            while self.take(","):
                self.take("file", "filegroup")
                self.need("=")
                self._atom()
            if self.take("file", "filegroup"):
                self.need("=")
                self._atom()
        if self.take("to", "from"):
            while True:
                if self.take("disk", "url", "tape", "file", "database_snapshot"):
                    self.need("=")
                    self._atom()
                else:
                    self.name()
                if not self.take(","):
                    break
        elif not restore:
            raise Bad("to")
        if self.take("with"):
            while True:
                if not self.take("checksum", "format", "init", "compression", "differential", "replace", "recovery", "norecovery"):
                    self.name()
                if self.take("="):
                    self._atom()
                elif self.t[self.i] == "(":
                    self.skip()
                elif self.take("\x01"):
                    if self.take("to"):
                        self._atom()
                if not self.take(","):
                    break

    def values(self) -> None:
        self.need("values")
        while True:
            self.need("(")
            self.list_()
            self.need(")")
            if not self.take(","):
                break

    def statement(self) -> None:
        t = self.t[self.i]
        if t in ("select", "with", "("):
            if t == "with":
                start = self.i
                try:
                    self.select()
                except Bad:
                    # the statement after the common tables may also change rows
                    self.i = start + 1
                    while True:
                        self.name()
                        if self.t[self.i] == "(":
                            self.names()
                        self.need("as")
                        self.skip()
                        if not self.take(","):
                            break
                    self.statement()
            else:
                self.select()
            self._for()
            if self.take("option"):
                self.skip()
            return
        if t and t not in _SQL_START and self.t[self.i + 1] == ":" and self.word():
            self.i += 1  # a label
            return
        self.i += 1
        if t == "create":
            self._create()
        elif t == "alter":
            self._alter()
        elif t == "drop":
            self.i += 1
            if self.take("if"):
                self.need("exists")
            self.name()
            while self.take(","):
                self.name()
            if self.take("on"):
                self.name()
        elif t == "truncate":
            self.need("table")
            self.name()
        elif t == "insert":
            self._top()
            self.take("into")
            self.name()
            if self.take("with"):
                self.skip()
            if self.t[self.i] == "(" and self.t[self.i + 1] not in ("select", "with"):
                self.names()
            self._output()
            if self.take("default"):
                self.need("values")
            elif self.t[self.i] == "values":
                self.values()
            elif self.t[self.i] in ("exec", "execute"):
                self.statement()
            else:
                self.select()
        elif t == "update":
            self._top()
            self.name()
            if self.take("with"):
                self.skip()
            self._set()
            self._output()
            if self.take("from"):
                self.sources()
            self._where()
        elif t == "delete":
            self._top()
            self.take("from")
            self.name()
            if self.take("with"):
                self.skip()
            self._output()
            if self.take("from"):
                self.sources()
            self._where()
        elif t == "declare":
            while True:
                self.name()
                self.take("as")
                if self.take("table"):
                    self._columns()
                elif self.take("cursor", "insensitive", "scroll"):
                    self.take("cursor")
                    while self.take("local", "global", "forward_only", "scroll", "static", "keyset", "dynamic", "fast_forward", "read_only", "scroll_locks", "optimistic", "type_warning"):
                        pass
                    if self.take("for"):
                        self.select()
                        if self.take("for"):
                            if self.take("read"):
                                self.need("only")
                            else:
                                self.need("update")
                                if self.take("of"):
                                    self.name()
                                    while self.take(","):
                                        self.name()
                else:
                    self.type_()
                    if self.take("="):
                        self.expr()
                if not self.take(","):
                    break
        elif t == "set":
            if self.t[self.i][:1] == "@":
                self.name()
                self.need("=", "+=", "-=")
                self.expr()
            else:
                self.name()
                while self.word() or self.take("on", "off"):
                    pass
        elif t == "if":
            self.expr()
            self.statement()
            self.take(";")
            if self.take("else"):
                self.statement()
        elif t == "while":
            self.expr()
            self.statement()
        elif t == "begin":
            if self.take("tran", "transaction"):
                self.word()
                return
            kind = self.t[self.i] if self.t[self.i] in ("try", "catch") else ""
            if kind:
                self.i += 1
            while self.t[self.i] != "end":
                if not self.t[self.i]:
                    raise Bad("end")
                if not self.take(";"):
                    self.statement()
            self.i += 1
            if kind:
                self.need(kind)
        elif t in ("commit", "rollback", "save"):
            self.take("tran", "transaction")
        elif t in ("exec", "execute"):
            if self.t[self.i] == "(":
                self.skip()
                return
            self.name()
            if self.take("="):
                self.name()
            if self.t[self.i] and self.t[self.i] not in _SQL_START and self.t[self.i] != ";":
                while True:
                    if self.t[self.i][:1] == "@" and self.t[self.i + 1] == "=":
                        self.i += 2
                    self._atom()
                    self.take("out", "output")
                    if not self.take(","):
                        break
        elif t in ("go", "break", "continue", "checkpoint"):
            if t == "go" and self.t[self.i].isdigit():
                self.i += 1
        elif t == "use":
            self.name()
        elif t in ("print", "return", "throw"):
            if self.t[self.i] not in _SQL_START and self.t[self.i] not in (";", ""):
                self.list_()
        elif t == "raiserror":
            self.skip()
        elif t in ("grant", "revoke", "deny"):
            self._permissions(t == "grant")
        elif t == "merge":
            self._merge()
        elif t in ("backup", "restore"):
            self._backup(t == "restore")
        elif t == "bulk":
            self.need("insert")
            self.name()
            self.need("from")
            self.need("\x01")
            if self.take("with"):
                self.skip()
        elif t == "waitfor":
            if self.t[self.i] == "(":
                self.skip()
                if self.take(","):
                    self.need("timeout")
                    self._atom()
            else:
                self.need("delay", "time")
                self._atom()
        elif t == "dbcc":
            self.name()
            if self.t[self.i] == "(":
                self.skip()
            if self.take("with"):
                self.name()
                while self.take(","):
                    self.name()
        elif t in ("open", "close", "deallocate"):
            self.take("global")
            if self.take("symmetric"):
                self.need("key")
            self.name()
            if self.take("decryption"):
                self.need("by")
                self.i += 1
                self.name()
        elif t == "fetch":
            if self.take("absolute", "relative"):
                self._atom()
            else:
                self.take("next", "prior", "first", "last")
            self.take("from")
            self.take("global")
            self.name()
            if self.take("into"):
                self.name()
                while self.take(","):
                    self.name()
        elif t == "goto":
            self.name()
        elif t == "kill":
            if self.take("query", "stats"):
                self.need("notification", "job")
                self.take("subscription")
            self.take("-")
            if not (self.take("\x01", "all") or self.t[self.i][:1].isdigit()):
                raise Bad(t)
            self.i += self.t[self.i][:1].isdigit()
            if self.take("with"):
                self.need("statusonly", "commit", "rollback")
        else:
            raise Bad(t)

    def _columns(self) -> None:
        self.need("(")
        while True:
            self.column()
            if not self.take(",") or self.t[self.i] == ")":
                break
        self.need(")")

    def _create(self) -> None:
        if self.take("or"):
            self.need("alter")
        if self.take("table"):
            self.name()
            self._columns()
            while self.take("on", "textimage_on", "filestream_on"):
                self.name()
                if self.t[self.i] == "(":
                    self.names()
            if self.take("with"):
                self.skip()
            return
        start = self.i
        while self.take("unique", "clustered", "nonclustered", "columnstore"):
            pass
        if self.take("index"):
            self.name()
            self.need("on")
            self.name()
            if self.t[self.i] == "(":
                self.names()
            if self.take("include"):
                self.names()
            if self.take("where"):
                self.expr()
            if self.take("with"):
                self.skip()
            return
        self.i = start
        if self.take("view"):
            self.name()
            if self.t[self.i] == "(":
                self.names()
            self.need("as")
            self.select()
            return
        if self.take("procedure", "proc", "function", "trigger"):
            self.name()
            while self.t[self.i] != "as":
                if self.t[self.i] in ("", ";"):
                    raise Bad("as")
                if self.t[self.i] == "(":
                    self.skip()
                else:
                    self.i += 1
            self.i += 1
            if self.t[self.i] == "":
                raise Bad("body")
            while self.t[self.i] and self.t[self.i] != "go":
                if not self.take(";"):
                    self.statement()
            return
        if self.take("login", "user"):
            self.name()
            if self.take("with"):
                self._options()
            elif self.take("from", "for"):
                self.i += 1
                self.word()
            return
        if self.take("schema", "database", "role", "sequence", "type", "synonym", "statistics", "certificate", "credential"):
            self.name()
            while self.t[self.i] and self.t[self.i] not in (";", "go"):
                if self.t[self.i] == "(":
                    self.skip()
                elif self.t[self.i] == ")":
                    raise Bad(")")
                else:
                    self.i += 1
            return
        raise Bad("create")

    def _options(self) -> None:
        while True:
            self.name()
            self.need("=")
            if self.take("on", "off", "\x01"):
                pass
            else:
                self._atom()
            self.take("must_change", "hashed")
            if not self.take(","):
                break

    def _alter(self) -> None:
        if self.take("table"):
            self.name()
            if self.take("with"):
                self.need("check", "nocheck")
            if self.take("add"):
                if self.t[self.i] == "(":
                    raise Bad("(")
                while True:
                    if self.t[self.i] == "default":
                        self._constraint()
                    else:
                        self.column()
                    if not self.take(","):
                        break
            elif self.take("drop"):
                self.take("column", "constraint")
                self.name()
                while self.take(","):
                    self.name()
            elif self.take("alter"):
                self.need("column")
                self.column()
            elif self.take("check", "nocheck", "enable", "disable", "rebuild", "switch", "set"):
                while self.t[self.i] and self.t[self.i] != ";":
                    if self.t[self.i] == "(":
                        self.skip()
                    else:
                        self.i += 1
            else:
                raise Bad("alter")
            return
        if self.take("procedure", "proc", "function", "trigger", "view"):
            self.i -= 1
            self._create()
            return
        if self.take("login", "user"):
            self.name()
            if self.take("with"):
                self._options()
            else:
                self.need("enable", "disable")
            return
        if self.take("database", "role", "schema", "index", "server", "authorization", "sequence"):
            self.name()
            n = 0
            while self.t[self.i] and self.t[self.i] not in (";", "go"):
                if self.t[self.i] == "(":
                    self.skip()
                else:
                    self.i += 1
                n += 1
            if n:
                return
        raise Bad("alter")


_memo: dict[str, bool] = {}


def sql_parses(s: str) -> bool:
    """Whether a text is a sequence of valid T-SQL statements; an empty one is."""
    s = s.removeprefix("﻿")
    if "\x00" in s or "\x01" in s:
        return False
    # what no statement begins with needs no second look
    first = _SQL_FIRST.match(s)
    if first and first[1].lower() not in _SQL_START and not first[1].startswith(("(", ";", "/")):
        return False
    m = _sql_mask(s)
    if m is None:
        return False
    # equal rows of one VALUES list are one row to the grammar
    m = _NUMBER.sub("0", m)
    parts = m.split(";")
    try:
        k = 0
        while k < len(parts):
            text = " ".join(parts[k].split())
            if re.match(r"(?i)(?:go )?(?:create|alter|begin|if|while|declare)\b.*\b(?:begin|as|proc|procedure)\b", text) and re.search(r"(?i)\bbegin\b|\bproc", text):
                # bodies hold semicolons of their own
                text = ";".join(parts[k:])
                k = len(parts)
            k += 1
            text = re.sub(r", ?\(", ",(", text)
            if "),(" in text:
                text = re.sub(r" ?([(),]) ?", r"\1", text)
                text = re.sub(r"(\(0(?:,-?0|,\x01)*\))(?:,\1)+", r"\1", text)
            ok = _memo.get(text)
            if ok is None:
                p = S(text)
                try:
                    while p.t[p.i]:
                        if not p.take(";"):
                            p.statement()
                    ok = True
                except (Bad, IndexError, RecursionError):
                    ok = False
                if len(_memo) > 200_000:
                    _memo.clear()
                _memo[text] = ok
            if not ok:
                return False
        return True
    except Bad:
        return False


# ------------------------------------------------------------------------- F#

_FS_MASK = re.compile(
    r"""//[^\n]*|\(\*\)|\(\*
    |\$*\"{3}.*?\"{3}
    |(?:@\$?|\$@)"(?:[^"]|"")*"
    |\$"(?:\\.|\{\{|\}\}|\{[^{}"\n]*\}|[^"\\{}])*"
    |"(?:\\.|[^"\\])*"B?
    |'(?:\\[^\n]{1,9}?|[^'\\\n])'""",
    re.X | re.S,
)
_FS_TOKEN = re.compile(
    r"\[<|>\]|\[\||\|\]|[^\W\d][\w']*[!]?|'[^\W\d]\w*|\d[\w]*(?:\.(?!\.)\d*(?:[eE][-+]?\d+)?[fFmM]?)?(?:<[A-Za-z_](?:[\w .*/^]|-\d)*>)?|``[^`\n]+``|\x01|\(\)|->|<-|:>|:\?>|:\?|::|:=|\.\.|[-+*/%<>=!$&|^~?@.:]+|[(){}\[\],;_#`]|\S"
)
_FS_KEYS = frozenset(
    "abstract and as assert base begin class default delegate do done downcast downto elif else end exception extern false finally fixed for fun function global if in inherit inline interface internal lazy let match member module mutable namespace new not null of open or override private public rec return select sig static struct then to true try type upcast use val void when while with yield let! use! do! return! yield! match! const process parallel protected pure include mixin component constraint trait virtual sealed tailcall break checked".split()
) - {"not", "select", "sig", "process", "parallel", "constraint", "component", "break", "checked", "include", "pure", "const"}
_FS_NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+|\d[\d_]*)(?:u?y|u?s|u|l|ul|L|UL|n|un|I|m|M|f|F|lf|LF)?$|\d[\d_]*\.\d*(?:[eE][-+]?\d+)?[fFmM]?$|\d[\d_]*(?:[eE][-+]?\d+)[fFmM]?$")
_CLOSE = {"(": ")", "[": "]", "{": "}", "[|": "|]", "[<": ">]"}
_FS_BINARY = re.compile(r"(?:[-+*/%<>=!&|^@?$.]+|::|:=|<-|:>|:\?>|\.\.)$")


def _fs_mask(s: str) -> str | None:
    out, at = [], 0
    while m := _FS_MASK.search(s, at):
        out.append(s[at : m.start()])
        t, at = m[0], m.end()
        if t == "(*":
            depth = 1
            while depth:
                a, b = s.find("(*", at), s.find("*)", at)
                if b < 0:
                    return None
                if 0 <= a < b and s[a + 2 : a + 3] != ")":
                    depth, at = depth + 1, a + 2
                elif 0 <= a < b:
                    at = a + 3
                else:
                    depth, at = depth - 1, b + 2
            out.append("\n" * s.count("\n", m.start(), at) + " " * 2)
        elif t == "(*)":
            out.append("(+)")
        elif t[0] == "/":
            pass
        else:
            # a literal over several lines keeps them, so that columns stay right
            out.append("\x01")
    out.append(s[at:])
    m = "".join(out)
    return None if '"' in m else m


#: No expression goes on past these; whoever called it says whether they may stand there.
_FS_ENDS = frozenset(["", "and", "member", "override", "interface", "default"])
_FS_ACCESS = ("private", "internal", "public")


class F:
    """Expressions of F# over one flattened group of lines; a nested group is one mark."""

    def __init__(self, tokens: list[str]):
        self.t = tokens + [""]
        self.i = 0

    def expr(self, stops: frozenset = frozenset()) -> None:
        """A chain of applications and operators up to a stop word."""
        want = True  # an operand has to follow
        while True:
            t = self.t[self.i]
            if t in stops or t in _FS_ENDS:
                if want:
                    raise Bad("operand")
                return
            if t in (")", "]", "}", "|]", ">]"):
                if want:
                    raise Bad(t)
                return
            if t in ("if",):
                self._if()
                want = False
            elif t in ("match", "match!"):
                self.i += 1
                self.expr(frozenset(["with"]))
                self.need("with")
                self._rules(stops)
                want = False
            elif t == "function":
                self.i += 1
                self._rules(stops)
                want = False
            elif t == "fun":
                self.i += 1
                n = 0
                while self.t[self.i] not in ("->", ""):
                    self._skip_one()
                    n += 1
                if not n:
                    raise Bad("fun")
                self.need("->")
                self.expr(stops)
                want = False
            elif t == "try":
                self.i += 1
                self.expr(frozenset(["with", "finally"]))
                if self.take("with"):
                    self._rules(stops)
                else:
                    self.need("finally")
                    self.expr(stops)
                want = False
            elif t == "while":
                self.i += 1
                self.expr(frozenset(["do"]))
                self.need("do")
                self.expr(stops)
                want = False
            elif t == "for":
                self.i += 1
                n = 0
                while self.t[self.i] not in ("in", "=", ""):
                    self._skip_one()
                    n += 1
                if not n or not self.t[self.i]:
                    raise Bad("for")
                self.i += 1
                self.expr(frozenset(["do", "->", "to", "downto"]))
                if self.take("to") or self.take("downto"):
                    self.expr(frozenset(["do"]))
                if not (self.take("do") or self.take("->")):
                    raise Bad("do")
                self.expr(stops)
                want = False
            elif t in ("let", "use", "let!", "use!"):
                self.i += 1
                _binding(self)
                if self.take("in") or self.take(";"):
                    continue
                if self.t[self.i] in stops or self.t[self.i] in _FS_ENDS or self.t[self.i] in (")", "]", "}"):
                    return
                raise Bad("let")
            elif t in ("return", "yield", "return!", "yield!", "do", "do!", "lazy", "assert", "upcast", "downcast", "fixed", "global", "base"):
                self.i += 1
                want = t not in ("global", "base")
            elif t == "new":
                self.i += 1
                self._path()
                want = False
            elif t == "struct" and self.t[self.i + 1] == "(":
                self.i += 1
                self._bracket()
                want = False
            elif want and t in ("<@", "<@@"):
                self.i += 1
                self.expr(frozenset(["@>" if t == "<@" else "@@>"]))
                self.need("@>" if t == "<@" else "@@>")
                want = False
            elif t == "begin":
                self.i += 1
                self.expr(frozenset(["end"]))
                self.need("end")
                want = False
            elif t in ("(", "[", "{", "[|", "[<"):
                self._bracket()
                want = False
            elif t == "()":
                self.i += 1
                want = False
            elif t in (":", ":?", ":>", ":?>"):
                if want:
                    raise Bad(t)
                self.i += 1
                self._type(stops)
                want = False
            elif t in (",", ";"):
                if want:
                    raise Bad(t)
                self.i += 1
                want = t == ","
            elif t == "|" or t == "->":
                raise Bad(t)
            elif t == "." or t == "?.":
                if want:
                    raise Bad(t)
                self.i += 1
                if self.t[self.i] in ("[", "("):
                    self._bracket()
                elif not self._name():
                    raise Bad("member")
            elif t in ("_",):
                self.i += 1
                want = False
            elif _FS_BINARY.match(t):
                if want:
                    if t not in ("-", "+", "!", "~", "&", "&&", "~-", "%", "%%", "..", "*", "!!"):
                        raise Bad(t)
                    self.i += 1
                    if t in ("..", "*") and self.t[self.i] in ("]", ","):
                        want = False
                    continue
                self.i += 1
                if t == ".." and self.t[self.i] in ("]",):
                    continue
                want = True
            elif t == "when":
                raise Bad("when")
            elif self._atom():
                want = False
            else:
                raise Bad(t)

    def take(self, x: str) -> bool:
        if self.t[self.i] == x:
            self.i += 1
            return True
        return False

    def need(self, x: str) -> None:
        if not self.take(x):
            raise Bad(x)

    def _name(self) -> bool:
        t = self.t[self.i]
        if t and (t[0].isalpha() or t[0] in "_`'") and t not in _FS_KEYS:
            self.i += 1
            return True
        return False

    def _atom(self) -> bool:
        t = self.t[self.i]
        if t in ("\x01", "\x02", "true", "false", "null", "not"):
            self.i += 1
            return True
        if t[0].isdigit():
            if not _FS_NUMBER.match(t.split("<")[0]):
                raise Bad(t)
            self.i += 1
            return True
        if self._name():
            return True
        return False

    def _skip_one(self) -> None:
        t = self.t[self.i]
        if t in _CLOSE:
            self._bracket_any()
        elif t in (")", "]", "}", "|]", ">]", ""):
            raise Bad(t)
        elif t in _FS_KEYS and t not in ("as", "when", "null", "true", "false", "mutable", "of", "not", "and", "struct"):
            raise Bad(t)
        else:
            self.i += 1

    def _bracket_any(self) -> None:
        """A bracket whose contents only have to balance (patterns, types)."""
        close = _CLOSE[self.t[self.i]]
        self.i += 1
        while self.t[self.i] != close:
            if self.t[self.i] == "":
                raise Bad(close)
            if self.t[self.i] in _CLOSE:
                self._bracket_any()
            elif self.t[self.i] in (")", "]", "}", "|]"):
                raise Bad(self.t[self.i])
            else:
                self.i += 1
        self.i += 1

    def _bracket(self) -> None:
        open_ = self.t[self.i]
        close = _CLOSE[open_]
        if open_ == "[<":
            self._bracket_any()
            return
        self.i += 1
        if self.take(close):
            return
        if open_ == "(" and (_FS_BINARY.match(self.t[self.i]) or self.t[self.i] in ("*",)) and self.t[self.i + 1] == ")":
            self.i += 2
            return
        if open_ == "{":
            start = self.i
            try:
                if self.take("inherit"):
                    self._path()
                while True:
                    if self.take(";"):
                        continue
                    if self.t[self.i] == "}":
                        break
                    self.expr(frozenset(["with", ";"]))
                    self.take("with")
                    while self.t[self.i] in ("member", "override", "interface", "default"):
                        _member(self)
                    if self.t[self.i] == "}":
                        break
            except Bad:
                self.i = start
                raise
            self.need(close)
            return
        self.expr(frozenset([close]))
        self.need(close)

    def _if(self) -> None:
        self.i += 1
        self.expr(frozenset(["then"]))
        self.need("then")
        inner = frozenset(["elif", "else"])
        self.expr(inner)
        if self.t[self.i] == "elif":
            self._if()
        elif self.take("else"):
            if self.t[self.i] == "if":
                self._if()
            else:
                self.expr()

    def _path(self) -> None:
        """The name of a class with its type arguments."""
        if not self._name():
            raise Bad("name")
        while self.t[self.i] == "." and self.t[self.i + 1] != "(":
            self.i += 1
            if not self._name():
                raise Bad("name")
        if self.t[self.i] == "<":
            depth = 0
            while True:
                x = self.t[self.i]
                depth += (x == "<") - (len(x) if x and not x.strip(">") else 0)
                self._skip_one()
                if depth <= 0:
                    return

    def _rules(self, stops: frozenset) -> None:
        self.take("|")
        while True:
            n = 0
            while self.t[self.i] not in ("->", "when", ""):
                self._skip_one()
                n += 1
            if not n:
                raise Bad("rule")
            if self.take("when"):
                self.expr(frozenset(["->"]))
            self.need("->")
            self.expr(stops | {"|"})
            if not self.take("|"):
                return

    def _type(self, stops: frozenset) -> None:
        """A type after `:`; it ends where no type can go on."""
        n = 0
        while True:
            t = self.t[self.i]
            if t == "(":
                self._bracket_any()
            elif t in ("*", "->", ".", "#", "_", "<", ">", "[]", ">>", "?"):
                self.i += 1
            elif t == "[" and self.t[self.i + 1] in ("]", ","):
                self._bracket_any()
            elif t in ("\x01",):
                self.i += 1
            elif t == "," and n and "<" in self.t[max(0, self.i - 12) : self.i]:
                self.i += 1
            elif self._name():
                pass
            else:
                if not n:
                    raise Bad("type")
                return
            n += 1


def _binding(f: F) -> None:
    """`pattern args [: type] = expr` behind let."""
    while f.t[f.i] in ("rec", "inline", "mutable", "private", "internal", "public", "[<"):
        if f.t[f.i] == "[<":
            f._bracket_any()
        else:
            f.i += 1
    n = 0
    while f.t[f.i] not in ("=", ""):
        t = f.t[f.i]
        if t in (":",) and n:
            f.i += 1
            while f.t[f.i] not in ("=", ""):
                if f.t[f.i] in _CLOSE:
                    f._bracket_any()
                elif f.t[f.i] in _FS_KEYS:
                    raise Bad(f.t[f.i])
                else:
                    f.i += 1
            break
        if t[0].isdigit() and not n:
            raise Bad("pattern")
        if t in (";", "\x02") or (_FS_BINARY.match(t) and t not in ("::", "<", ">", ".", "|", "&", "-", "?", "*")):
            raise Bad(t)
        f._skip_one()
        n += 1
    if not n:
        raise Bad("pattern")
    f.need("=")
    f.expr(frozenset(["in", ";"]))
    if f.take("and"):
        _binding(f)


def _types(f: F, stops: tuple[str, ...]) -> None:
    """Types with names, tuples and constraints, up to one of `stops` or the end."""
    last = ""
    while f.t[f.i] and f.t[f.i] not in stops:
        last = f.t[f.i]
        if last == "[<":
            f._bracket_any()
            continue
        f._skip_one()
    if last in ("", "->", "*", ":", ".", "of", ","):
        raise Bad("type")


def _accessors(f: F) -> None:
    """`get, set` or `get args = expr and set args = expr` behind `with`."""
    while True:
        while f.t[f.i] in ("inline", *_FS_ACCESS):
            f.i += 1
        if f.t[f.i] not in ("get", "set"):
            raise Bad("accessor")
        f.i += 1
        if f.take(","):
            continue
        if f.t[f.i] not in _FS_ENDS and f.t[f.i] != "}":
            while f.t[f.i] not in ("=", ""):
                f._skip_one()
            f.need("=")
            f.expr()
        if not f.take("and"):
            return


def _member(f: F) -> None:
    """One declaration in a type's body."""
    while f.t[f.i] == "[<":
        f._bracket_any()
    f.take("static")
    head = f.t[f.i]
    f.i += 1
    if head in ("let", "use"):
        _binding(f)
        if f.take("in"):
            f.expr()
    elif head == "do":
        f.expr()
    elif head == "inherit":
        f._path()
        if f.t[f.i]:
            f.expr()
    elif head == "extern":
        _types(f, ())
    elif head == "val":
        while f.t[f.i] in ("mutable", *_FS_ACCESS):
            f.i += 1
        if not f._name():
            raise Bad("val")
        f.need(":")
        _types(f, ())
    elif head == "new":
        if f.t[f.i] == "(":
            f._bracket_any()
        else:
            f.need("()")
        if f.take("as") and not f._name():
            raise Bad("as")
        f.need("=")
        f.expr(frozenset(["then"]))
        if f.take("then"):
            f.expr()
    elif head == "interface":
        _types(f, ("with",))
        if f.take("with"):
            while f.t[f.i] in ("member", "override"):
                _member(f)
    elif head == "abstract":
        f.take("member")
        while f.t[f.i] in ("inline", *_FS_ACCESS):
            f.i += 1
        if not f._name():
            raise Bad("abstract")
        while f.t[f.i] not in (":", ""):
            f._skip_one()
        f.need(":")
        _types(f, ("with",))
        if f.take("with"):
            _accessors(f)
    elif head in ("member", "override", "default"):
        while f.t[f.i] in ("inline", "val", "mutable", *_FS_ACCESS):
            f.i += 1
        if f.t[f.i] == "(":
            f._bracket_any()
        elif not f.take("_") and not f._name():
            raise Bad("member")
        while f.t[f.i] not in ("=", "with", ""):
            if f.take("."):
                if f.t[f.i] == "(":
                    f._bracket_any()
                elif not f._name():
                    raise Bad("member")
            else:
                f._skip_one()
        if f.take("="):
            f.expr(frozenset(["with"]))
            if f.take("with"):
                _accessors(f)
        else:
            f.need("with")
            _accessors(f)
    else:
        raise Bad(head)


def _cases(f: F) -> None:
    """The cases of a union or an enumeration."""
    f.take("|")
    while True:
        while f.t[f.i] == "[<":
            f._bracket_any()
        if f.t[f.i] in ("(", "["):
            f._bracket_any()
        elif not f._name():
            raise Bad("case")
        if f.take("of") or f.take(":"):
            _types(f, ("|", "with"))
        elif f.take("="):
            f.expr(frozenset(["|"]))
        if f.t[f.i] in ("", "with"):
            return
        f.need("|")


def _record(f: F) -> None:
    """The fields of a record behind its `{`, through its `}`."""
    n = 0
    while not f.take("}"):
        if f.take(";"):
            continue
        while f.t[f.i] in ("mutable", "[<", *_FS_ACCESS):
            f._bracket_any() if f.t[f.i] == "[<" else f.take(f.t[f.i])
        if not f._name():
            raise Bad("field")
        f.need(":")
        _types(f, (";", "}"))
        n += 1
    if not n:
        raise Bad("record")


#: After these a deeper group of lines is a block of its own.
_OPENERS = frozenset(["=", "then", "else", "->", "do", "with", "try", "finally", "begin", "(", "[", "{", "[|", "in", "yield", "return", "<-", "lazy", "of", ":=", "struct", "class", "function"])
#: At the head of a line, these go on with what stands above in the same column.
_CONTINUES = frozenset(["then", "else", "elif", "with", "finally", "|", ")", "]", "}", "|]", "and", "|>", "||>", ">>", "||", "&&", "<|", "@", "+", "*", "/", "::", "end", ">]", "done", "->", "<>", "=", "-", ".", "?", "of", "in", "do"])


#: Type arguments right behind a name, without arrows; nested ones from the inside.
_FS_APPLIED = re.compile(r"(?<=[\w'])<[ ]?(?:[A-Za-z_'^#(\[*][\w .,*'^#()\[\]:;|?]*|_)>(?![>\w])")


def _lines(m: str) -> list[tuple[int, list[str]]] | None:
    out = []
    if "<" in m:
        last = ""
        while last != m:
            last, m = m, _FS_APPLIED.sub("", m)
    for line in m.split("\n"):
        t = line.strip()
        if not t:
            continue
        if "\t" in line[: len(line) - len(line.lstrip())]:
            return None
        if t[0] == "#":
            if re.match(r"#\s*(?:if|else|endif|nowarn|light|line|load|r|I|time)\b", t):
                continue
            return None
        out.append((len(line) - len(line.lstrip(" ﻿")), _FS_TOKEN.findall(t)))
    return out


def _flatten(lines: list[tuple[int, list[str]]]) -> list[str]:
    """One group of lines (a line and the deeper ones under it) as tokens; a block of several statements is parsed and becomes one mark."""
    toks = list(lines[0][1])
    k = 1
    while k < len(lines):
        col = lines[k][0]
        j = k + 1
        while j < len(lines) and lines[j][0] >= col:
            j += 1
        block = lines[k:j]
        if toks and toks[-1] in _OPENERS or toks and toks[-1] in ("|",):
            toks += _block(block, toks[-1])
        else:
            # it goes on with the expression above
            for group in _groups(block):
                toks += _flatten(group)
        k = j
    return toks


def _groups(lines: list[tuple[int, list[str]]]) -> list[list[tuple[int, list[str]]]]:
    """Lines cut into statements by the column of the first."""
    col = lines[0][0]
    out: list[list] = []
    for c, t in lines:
        if c <= col and out and not (t and t[0] in _CONTINUES):
            out.append([(c, t)])
        elif not out:
            out.append([(c, t)])
        else:
            out[-1].append((c + (1 if c <= col else 0), t))
    return out


def _block(lines: list[tuple[int, list[str]]], after: str) -> list[str]:
    groups = _groups(lines)
    if len(groups) == 1:
        return _flatten(groups[0])
    if after in ("[", "[|", "{", "("):
        out: list[str] = []
        for g in groups:
            one = _flatten(g)
            if out and one and one[0] not in (";", "]", "|]", "}", ")"):
                out.append(";")
            out += one
        return out
    last = len(groups) - 1
    opened = 0
    out = []
    for n, g in enumerate(groups):
        one = _flatten(g)
        depth = sum((x in _CLOSE) - (x in (")", "]", "}", "|]", ">]")) for x in one)
        if opened or depth:
            out += one
            opened += depth
            continue
        if one[0] == "[<" and one[-1] == ">]":
            continue
        f = F(one)
        if one[0] in ("let", "use", "let!", "use!"):
            f.i = 1
            _binding(f)
            if f.t[f.i] == "in":
                f.i += 1
                f.expr()
            if n == last:
                raise Bad("let")
        elif one[0] in ("member", "override", "abstract", "static", "val", "interface", "inherit", "default", "new"):
            pass
        else:
            f.expr()
        if f.t[f.i] != "" and one[0] not in ("member", "override", "abstract", "static", "val", "interface", "inherit", "default", "new"):
            raise Bad(f.t[f.i])
    if out:
        return out
    return ["\x02"]


def _type_body(body: list[tuple[int, list[str]]], toks: list[str]) -> None:
    """What stands behind `type X =`: a record, a union, an abbreviation or members."""
    depth: list[str] = []
    flat = toks + [x for _, t in body for x in t]
    if not flat:
        raise Bad("type")
    for x in flat:
        if x in _CLOSE:
            depth.append(_CLOSE[x])
        elif x in (")", "]", "}", "|]", ">]"):
            if not depth or depth.pop() != x:
                raise Bad(x)
        elif x[0].isdigit() and not _FS_NUMBER.match(x.split("<")[0]):
            raise Bad(x)
    if depth:
        raise Bad("type")
    lines = ([(body[0][0] if body else 0, toks)] if toks else []) + body
    lines = [(c, list(t)) for c, t in lines]
    while lines[0][1][0] in _FS_ACCESS:
        lines[0][1].pop(0)
        if not lines[0][1]:
            lines.pop(0)
        if not lines:
            raise Bad("type")
    head = lines[0][1][0]
    if head in ("class", "struct", "interface") and lines[0][1][1:] in ([], ["end"]):
        if lines[0][1][1:] == ["end"]:
            lines[0][1].pop()
        elif lines[-1][1] == ["end"]:
            lines.pop()
        else:
            raise Bad("end")
        lines = lines[1:]
    elif head == "{" and flat[flat.index("{") + 1 :][:1] != ["|"]:
        # fields end with their lines
        one: list[str] = []
        open_ = 0
        while lines and (open_ or not one):
            t = lines.pop(0)[1]
            if open_ == 1 and one[-1] not in ("{", ";", "->", "*", ":", ">]", "mutable") and t[0] not in ("}", ";", "->", "*", ":", ">"):
                one.append(";")
            one += t
            open_ = sum((x in _CLOSE) - (x in (")", "]", "}", "|]", ">]")) for x in one)
        f = F(one)
        f.i = 1
        _record(f)
        if f.take("with"):
            lines = ([(lines[0][0] if lines else 0, f.t[f.i : -1])] if f.t[f.i] else []) + lines
        elif f.t[f.i]:
            raise Bad(f.t[f.i])
    elif head not in _MEMBERS and head != "[<" or head == "[<" and not _MEMBERS.intersection(flat):
        col = lines[0][0]
        one = list(lines.pop(0)[1])
        while lines and (lines[0][1][0] in ("|", "->", "*") or lines[0][0] > col or one[-1] in ("->", "*", "of", "|", "=")):
            one += lines.pop(0)[1]
        f = F(one)
        if one[0] != "{" and ("|" in one or "of" in one and one[0] != "delegate"):
            _cases(f)
            if f.t[f.i]:
                lines.insert(0, (col, f.t[f.i : -1]))
        else:
            if f.take("delegate"):
                f.need("of")
            _types(f, ())
    if lines and lines[0][1][0] == "with":
        lines[0][1].pop(0)
        if not lines[0][1]:
            lines.pop(0)
        if not lines:
            raise Bad("with")
    _members(lines)


#: Heads of the declarations in a type's body.
_MEMBERS = frozenset(["member", "override", "default", "abstract", "static", "val", "new", "inherit", "interface", "let", "use", "do"])


def _members(lines: list[tuple[int, list[str]]]) -> None:
    """The declarations of a type's body, cut by the column of the first."""
    groups: list[list] = []
    for c, t in lines:
        if not groups or c <= groups[-1][0][0] and t[0] not in (")", "]", "}", "|]", "and", "with", "then"):
            groups.append([(c, t)])
        else:
            groups[-1].append((c + (1 if c <= groups[-1][0][0] else 0), t))
    pending = False
    for g in groups:
        toks = g[0][1]
        if toks[0] == "[<" and toks[-1] == ">]" and toks.count("[<") == 1:
            if g[1:]:
                raise Bad("attribute")
            pending = True
            continue
        pending = False
        if toks[0] == "interface" and g[1:]:
            f = F(toks)
            f.i = 1
            _types(f, ("with",))
            inner = g[1:]
            if not f.take("with"):
                inner = [(c, t[1:] if n == 0 else t) for n, (c, t) in enumerate(inner)] if inner[0][1][0] == "with" else []
                inner = inner[1:] if inner and not inner[0][1] else inner
                if not inner:
                    raise Bad("with")
            elif f.t[f.i]:
                inner = [(inner[0][0], f.t[f.i : -1]), *inner]
            _members(inner)
            continue
        f = F(_flatten(g))
        _member(f)
        if f.t[f.i]:
            raise Bad(f.t[f.i])
    if pending:
        raise Bad("attribute")


#: A first line without literals behind comments of one line, and the word that begins the next.
_FS_FIRST = re.compile(r"(?:[ ]*(?://[^\n]*)?\n)*([ ]*)([A-Za-z_][^\n\"'\t#`]*)\n(?:[ ]*\n)*([ ]*)([A-Za-z_]\w*)")


def fs_parses(s: str) -> bool:
    """Whether a text is syntactically valid F#; an empty one is."""
    s = s.lstrip("﻿")
    if "\x00" in s or "\x01" in s or "\x02" in s:
        return False
    s = s.replace("\r\n", "\n")
    # declarations are checked one by one, so a first line that is a whole bad one decides
    if (m := _FS_FIRST.match(s)) and len(m[3]) <= len(m[1]) and m[4] not in _CONTINUES and "(*" not in m[2] and "//" not in m[2]:
        try:
            _declarations([(len(m[1]), _FS_TOKEN.findall(m[2].strip()))], True)
        except (Bad, IndexError, RecursionError):
            return False
    m = _fs_mask(s)
    if m is None:
        return False
    lines = _lines(m)
    if lines is None:
        return False
    if not lines:
        return True
    depth: list[str] = []
    for _, t in lines:
        for x in t:
            if x in _CLOSE:
                depth.append(_CLOSE[x])
            elif x in (")", "]", "}", "|]", ">]"):
                if not depth or depth.pop() != x:
                    return False
            elif x[0] == "`" and len(x) < 5:
                return False
    if depth or lines[0][1][0] == "and":
        return False
    try:
        return _declarations(lines, True) > 0
    except (Bad, IndexError, RecursionError):
        return False


def _declarations(lines: list[tuple[int, list[str]]], top: bool) -> int:
    """Checks the declarations of one module; how many there were."""
    count = 0
    for group in _groups(lines):
        col, toks = group[0]
        head = toks[0]
        rest = group[1:]
        while head == "[<":
            f = F(toks)
            f._bracket_any()
            toks = toks[f.i :]
            if not toks:
                break
            head = toks[0]
        if not toks:
            if rest:
                raise Bad("attribute")
            count += 1
            continue
        if head in ("module", "namespace"):
            f = F(toks)
            f.i = 1
            while f.t[f.i] in ("rec", "private", "internal", "public"):
                f.i += 1
            if not f._name():
                raise Bad(head)
            while f.take("."):
                if not f._name():
                    raise Bad(head)
            if f.take("="):
                if f.t[f.i]:
                    if f.t[f.i] not in ("begin",) and not f._name():
                        raise Bad(head)
                elif not rest:
                    raise Bad("module")
                else:
                    _declarations(rest, False)
            elif f.t[f.i]:
                raise Bad(head)
            elif rest:
                _declarations(rest, False)
            count += 1
        elif head == "open":
            f = F(toks)
            f.i = 1
            f.take("type")
            if not f._name():
                raise Bad("open")
            while f.take("."):
                if not f._name():
                    raise Bad("open")
            if f.t[f.i] or rest:
                raise Bad("open")
            count += 1
        elif head in ("type", "and", "exception"):
            # further types of the same group begin with `and` in its column
            cuts = [n for n, (c, t) in enumerate(rest) if c <= col + 1 and t[0] == "and"]
            if cuts:
                rest, more = rest[: cuts[0]], rest[cuts[0] :]
                _declarations([(col, more[0][1]), *more[1:]], False)
            # a constructor's parameters may take lines of their own
            while rest and "=" not in toks and (rest[0][1][0] == "(" or sum((x in _CLOSE) - (x in (")", "]", "}", "|]", ">]")) for x in toks)):
                toks, rest = toks + rest[0][1], rest[1:]
            f = F(toks)
            f.i = 1
            while f.t[f.i] in ("[<", *_FS_ACCESS):
                f._bracket_any() if f.t[f.i] == "[<" else f.take(f.t[f.i])
            if not f._name():
                raise Bad("type")
            while f.t[f.i] not in ("=", "", "of", "with"):
                f.i += 1 if f.t[f.i] in _FS_ACCESS else 0
                if f.t[f.i] not in ("=", "", "of", "with"):
                    f._skip_one()
            if f.take("="):
                _type_body(rest, f.t[f.i : -1])
            else:
                if head == "exception" and f.take("of"):
                    _types(f, ("with",))
                if f.take("with"):
                    inner = ([(rest[0][0] if rest else 0, f.t[f.i : -1])] if f.t[f.i] else []) + rest
                    if not inner:
                        raise Bad("with")
                    _members(inner)
                elif f.t[f.i] or rest:
                    raise Bad("type")
            count += 1
        elif head in ("let", "use"):
            flat = _flatten([(col, toks)] + rest)
            f = F(flat)
            f.i = 1
            _binding(f)
            if f.take("in"):
                f.expr()
            if f.t[f.i]:
                raise Bad(f.t[f.i])
            count += 1
        elif head in ("extern", "#"):
            count += 1
        else:
            flat = _flatten([(col, toks)] + rest)
            f = F(flat)
            if head == "do":
                f.i = 1
            f.expr()
            if f.t[f.i] or flat[-1] == ";":
                raise Bad(f.t[f.i] or ";")
    return count
