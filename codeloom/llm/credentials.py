"""Credentials embedded in source code: found by place, redacted in place.

Texts are cut into lexical tokens (`lexer`). An identifier, key or attribute
that names a credential is followed to the literal that it is assigned to,
compared with, mapped to or called with; the whole literal is judged, adjacent
literals joined by `+` as one value. For names of passwords any literal counts
that is no placeholder, reference or name, worded ones too; for tokens and keys
it has to look drawn. Values that are told by their form (key blocks, tokens
with an issuer's prefix, passwords in URLs and connection strings) need no name
and are also found in comments and in longer strings. Redaction overwrites only
the contents of literals, token by token: delimiters, escapes, doubled quotes,
entities, line breaks and the code between joined literals stay.

Defined results: null or empty content has no credentials; repeated rows count
once; a file id may be null; extra columns are ignored; very long lines cost
time in proportion to their length only.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.lexer import Token, lex, overwrite
from codeloom.llm.rows import own_id, spread, whole_id


class Found(NamedTuple):
    start: int
    end: int
    line_no: int
    kind: str


#: What may begin a credential in lower-case text: stems of names, and forms that speak for themselves.
#: Every branch begins with a letter or mark as it is, so that the engine skips what cannot begin one.
_HINT = re.compile(
    r"pass(?:w|phrase|code|_|(?=[a-z]*[\"'\]]?\s?[=:,]))|pwd|secret|token|key|cred|auth|bearer|basic [a-z0-9+/]{12}|login|sas\d*\W|sig=|\?code=|&code=|old value|previous value"
    r"|://[^\s/:@\"'<>]*:|eyj|-----begin|-u\s?\S+\s+-p\s?|live_[a-z0-9]{8}|test_[a-z0-9]{8}|prod_[a-z0-9]{8}|pat-[0-9a-z]{8}|sk[.-][0-9a-z+/]{8}"
    r"|gh[pousr]_[0-9a-z]{8}|github_pat_|akia[0-9a-z]{12}|xox[abeprs]-|npm_[0-9a-z]{8}|glpat-"
    r"|svc[\w-]*\s?/\s|usr[\w-]*\s?/\s|user[\w-]*\s?/\s|adm[\w-]*\s?/\s|root[\w-]*\s?/\s"
)
#: Of these only those that begin a word count.
_AT_WORD = ("live_", "test_", "prod_", "pat-", "sk.", "sk-", "gh", "git", "akia", "xox", "npm", "gl")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Words that make a name a credential's.
_STRONG = {"password", "passwd", "pwd", "passphrase", "passcode", "secret", "apikey", "token", "credential", "credentials", "auth", "pass", "accountkey", "sas", "signature", "authorization", "bearer", "passw", "psw", "userpwd", "dbpass", "key"}
#: Words that, after the former, make it one of something about credentials.
_ABOUT = {"scope", "id", "header", "name", "length", "count", "type", "url", "uri", "path", "file", "hint", "policy", "prompt", "label", "field", "regex", "pattern", "format", "expiry", "lifetime", "timeout", "checksum", "thumbprint", "fingerprint", "provider", "endpoint", "algorithm", "min", "max", "column", "options", "kind", "parser", "salt", "message", "placeholder", "template", "description", "cert", "certificate", "size", "vault", "error", "title", "caption", "tooltip", "help", "text", "strength", "rule", "rules", "policies", "link", "page", "view", "button", "input"}
#: Names of what people choose: their values may be words.
_CHOSEN = {"password", "passwd", "pwd", "passphrase", "passcode", "pass", "passw", "psw", "userpwd", "dbpass"}
_HASHED = {"hash", "digest", "hashed", "sha", "md"}
_DIGEST = re.compile(r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56,}|[A-Za-z0-9+/]{27,}=*)$")


def credential_name(name: str) -> str:
    """'password', 'strong' or 'key' if an identifier, key or attribute names a credential's value; 'hashed' if perhaps its digest; else ''."""
    words = [w.lower() for w in _WORDS.findall(name)]
    at = max((i for i, w in enumerate(words) if w in _STRONG), default=-1)
    if at < 0 or "public" in words[:at] or any(w in _ABOUT for w in words[at + 1 :]):
        return ""
    if any(w in _HASHED for w in words[at + 1 :]):
        return "hashed"
    if words[at] in _CHOSEN:
        return "password"
    if words[at] != "key":
        return "strong"
    return "" if words[at - 1 : at] in (["foreign"], ["partition"], ["sort"], ["row"], ["cache"]) else "key"


_REFERENCE = re.compile(r"\$\{|\$\(|\{\{|\{\w*\}|#\{|%[A-Za-z_]\w*%|@[A-Za-z]+\(|^<[^>]*>$|&lt;|^\[[^\]]*\]$|^\$[A-Za-z_]|^__\w+__$|^@\w+$|^env:|^vault:|^\{|keyvault|^ref\+|^arn:|^secretref", re.I)
_PLACEHOLDER = re.compile(r"(?i)chang.?me|change.?it|\byour\b|your[-_]|placeholder|^example|dummy|redacted|replace.?(?:me|this|with)|todo|fixme|(?:insert|enter|goes).?(?:here|your)|^x{3,}|x{5,}|\*{3,}|\.{3,}|•|^(?:test|none|null|empty|default|secret|password|token)$|not.?set|^n/a$|^tbd|^(.)\1+$|^<|^0+$|^12345678?9?0?$")
_GUID = re.compile(r"(?i)^\{?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\}?$")
#: A setting's, header's or path's name: words joined by marks, nothing random in it.
_NAMELIKE = re.compile(r"^[A-Za-z]+(?:[-_./: ][A-Za-z]+)*\d?$")
#: Words joined in mixed case.
_JOINED = re.compile(r"^[a-z]*I?(?:[A-Z][a-z]{2,})*$")
_ISSUED = re.compile(r"(?:eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{6,}|\b(?:[a-z]{2,5}_(?:live|test|prod)_|pat-|sk[.-]|gh[pousr]_|github_pat_|AKIA|xox[abeprs]-|glpat-|npm_)[A-Za-z0-9+/_-]{16,}={0,2})")
_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_URL = re.compile(r"\b[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@\"'<>]*:([^\s/@\"'<>]{3,})@")
_PAIR = re.compile(r"(?i)(?<![\w])([A-Za-z][\w.-]*)[ ]?=[ ]?([^\s;&\"'<>,]{5,})")


def _random(v: str) -> bool:
    """Whether a value looks drawn rather than worded."""
    if len(v) < 6:
        return False
    digits, upper, lower = any(c.isdigit() for c in v), any(c.isupper() for c in v), any(c.islower() for c in v)
    marks = any(not c.isalnum() and c not in "-_./: " for c in v)
    if digits and (upper or lower):
        return True
    if digits and len(v) >= 6 and not marks:
        return True
    if marks and (upper or lower) and " " not in v and not v.endswith((":", "?")):
        return True
    # letters only: no joined words
    return upper and lower and v.isalpha() and len(v) >= 8 and not _JOINED.match(v)


def live_value(v: str) -> bool:
    """Whether a literal's value would give access: no placeholder, reference, name, id or digest."""
    v = re.sub(r"\s*[\r\n]+\s*", "", v.strip())
    if len(v) < 6 or _REFERENCE.search(v) or _PLACEHOLDER.search(v) or _GUID.match(v):
        return False
    if _NAMELIKE.match(v) and not _random(v):
        return False
    if "://" in v or v.startswith(("/", "./", "../", "~/", "\\\\")) or re.match(r"^[A-Za-z]:\\", v):
        return False
    if " " in v and not re.match(r"(?i)^(bearer|basic|token|apikey)\s+\S+$", v):
        return False
    return _random(v.split()[-1])


#: Words for a password in prose and forms, and values of schemas: no password themselves.
_LABELS = frozenset("passwort kennwort contraseña пароль 密码 密碼 パスワード wachtwoord senha hasło lösenord string text hidden bool boolean true false required optional basic bearer varchar nvarchar input field label value user users admin name email".split()) - {"admin"}
_ABOUT_IT = re.compile(r"(?i)pass|pwd|secret|token|credential|login|\bkey\b|mot de|sign.?in|\b(?:the|a|an|is|are|must|enter|please|your|for|to|of|and|or|not|be|with|at|no|new|old|in|this|from|invalid|wrong|too|least)\b")
_WORDED = re.compile(r"[^\W_][\w!#%&*+?^~@=-]{3,}(?: [\w'-]+){0,11}")


def worded_value(v: str) -> bool:
    """Whether a literal given to a password's name would be it though it is made of words."""
    v = v.strip()
    if _REFERENCE.search(v) or _PLACEHOLDER.search(v) or _GUID.match(v) or _ABOUT_IT.search(v) or v.lower() in _LABELS or not _WORDED.fullmatch(v):
        return False
    if re.fullmatch(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|v?\d[\d.]*", v):  # a variable of the environment, a number
        return False
    return " " not in v or v.count(" ") >= 2


_PLAIN_STRING = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.|\'\')*)\'|`([^`\n]*)`')
_VERBATIM = re.compile(r'"((?:[^"]|"")*)"')
_RAW = re.compile(r'("{3,})(.*?)\1', re.S)
_PREFIX = re.compile(r"[$@NLRru]{0,3}(?=[\"'`])")
_JOIN = re.compile(r"\s*[+&]\s*(?=[$@]{0,2}[\"'])")


def _literal(s: str, at: int) -> tuple[int, int, int] | None:
    """(start, end of contents, end of literal) of a literal at a position."""
    p = _PREFIX.match(s, at)
    if not p:
        return None
    verbatim, at = "@" in p[0], p.end()
    if s.startswith('"""', at):
        if m := _RAW.match(s, at):
            return m.start(2), m.end(2), m.end()
    if verbatim and s[at : at + 1] == '"':
        m = _VERBATIM.match(s, at)
        return (at + 1, m.end() - 1, m.end()) if m else None
    m = _PLAIN_STRING.match(s, at)
    return (at + 1, m.end() - 1, m.end()) if m else None


#: From the end of a name to its literal: closing marks, a type, an operator, a call.
_TO_LITERAL = re.compile(
    r"""["'`\]]{0,2}\s*(?::\s*(?:string|str|String)\??\s*)?(?:\)\s*)?
    (?:=>|===?|!==?|:=|\?\?=?|=|:|,|<-|->|\bwith\b|\bis\b|\(|\{\s*get;[^}]*\}\s*=)\s*
    (?:new\s+\w+\s*\(|\w+(?:\.\w+)*\(|\(|\[|\w+\s*\?\?\s*)?\s*(?=[$@NLRru]{0,3}["'`])""",
    re.X,
)
_BARE = re.compile(r"[ \t]*[=:][ \t]*([^\s\"'`<>;,&()\[\]{}]{6,})")
#: An unquoted name with a number behind it is a variable, no value.
_IDENTIFIER = re.compile(r"^[A-Za-z_]+\d{1,3}$")
_XML_VALUE = re.compile(r"[\"']\s+value\s*=\s*(?=[\"'])", re.I)
_XML_TEXT = re.compile(r"(?:\s[^<>]*)?>\s*([^<>\s][^<>]*?)\s*</", re.S)
_NAME = re.compile(r"[\w-]+|.", re.S)
_LOGIN = re.compile(r"\s*\(\s*(?=[$@]{0,2}[\"'])")
_SQL_BEFORE = re.compile(r"(?i)\b(?:val|value|setting|data)\w*\s*=\s*(?=N?')")


_QUERY = re.compile(r"(?i)[?&](?:code|sig|token|key)=([^&\s\"'<>]{16,})")
_OLD = re.compile(r"(?i)(?:value|password|key|token|secret)\s*[:=]\s*([^\s\"'<>]{8,})")
_SPOKEN_LOGIN = re.compile(r"[^\n:\"']*:\s*[\w.@-]+\s*/\s*(\S+)")
_WORD = re.compile(r"([^\s\"'`<>;,]{6,})")
_BASIC = re.compile(r"(?i:basic) ([A-Za-z0-9+/]{12,}={0,2})")
_SPOKEN = re.compile(r"[\"'`]?\s*(?::|=|is|was)\s+([^\s\"'`<>;,]{6,})")


def _signed_in(v: str) -> bool:
    """Whether base64 holds a user and a password, as a basic sign-in header does."""
    try:
        t = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("ascii")
    except ValueError:
        return False
    user, sep, password = t.partition(":")
    return bool(sep) and t.isprintable() and len(user) > 0 and len(password) >= 6 and not _PLACEHOLDER.search(password)


_QUOTED = re.compile(r"[\"'`]?\s*(?::|=|is|was)?\s*[`'\"]([^`'\"\s]{6,})[`'\"]")
_COMMA = re.compile(r"\s*,\s*(?:\w+:\s*)?")
_AFTER = frozenset("=:,(>\"'`]) <\t\n\r!?{")


def _place(tokens: list[Token], starts: list[int], at: int) -> Token | None:
    """The token that holds a position, if one does."""
    k = bisect_right(starts, at) - 1
    return tokens[k] if k >= 0 and at < tokens[k].end else None


class Text:
    """A text with its tokens."""

    def __init__(self, s: str):
        self.s = s

    @cached_property
    def tokens(self) -> list[Token]:
        return lex(self.s)

    @cached_property
    def starts(self) -> list[int]:
        return [t.start for t in self.tokens]

    @cached_property
    def at(self) -> dict[int, Token]:
        return {t.start: t for t in self.tokens if t.kind not in ("comment", "text", "name")}

    def literal(self, at: int) -> tuple[int, int, int] | None:
        """(start, end of contents, end) of the literal at a position: a token of the code, or, inside a token, what looks like one there."""
        t = self.at.get(at)
        if t is not None:
            return (t.a, t.b, t.end)
        return _literal(self.s, at)

    def value(self, at: int) -> tuple[int, int, str] | None:
        """(start, end, joined value) of a literal and those added to it."""
        first = self.literal(at)
        if not first:
            return None
        start, end, after = first
        text = self.s[start:end]
        while j := _JOIN.match(self.s, after):
            more = self.literal(j.end())
            if not more:
                break
            text += self.s[more[0] : more[1]]
            end, after = more[1], more[2]
        return start, end, text


def _low(s: str) -> str:
    low = s.lower()
    if len(low) != len(s):  # a few letters grow when lowered; places must not move
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in s)
    return low


def find(s: str) -> list[Found]:
    """The credentials of one text, in order."""
    if not s:
        return []
    return _found(Text(s), _low(s))


def _found(x: Text, low: str) -> list[Found]:
    s = x.s
    spots: dict[int, tuple[int, str]] = {}

    def add(a: int, b: int, kind: str) -> None:
        if a < b and not any(p <= a < q for p, (q, _) in spots.items() if p != a):
            spots.setdefault(a, (b, kind))

    done = -1
    for h in _HINT.finditer(low):
        at = h.start()
        if at < done:
            continue
        hint = h[0]
        if hint == "-----begin":
            end = s.find("-----END", at + 5)
            if m := _BLOCK.match(s, at):
                if end < 0:  # never closed: to the end of the literal or comment that holds it
                    t = _place(x.tokens, x.starts, at)
                    end = t.b if t else len(s)
                body = s[m.end() : end]
                if re.search(r"[A-Za-z0-9+/]{16,}", body) and "..." not in body:
                    add(at, end, "private key")
                    done = end
            else:
                done = end if end >= 0 else at + 1
            continue
        if hint in ("old value", "previous value") or hint[0] in "?&":
            m = _QUERY.match(s, at) if hint[0] in "?&" else _OLD.search(s, at, _line_end(s, at))
            if m and live_value(m[1]) and len(m[1]) >= 12:
                add(m.start(1), m.end(1), "text")
            continue
        if hint.endswith(("/ ", "/\t", "/\n", "/\r")) or hint.startswith("basic ") or hint.startswith("-u"):
            if hint[0] != "b" and at and (s[at - 1].isalnum() or s[at - 1] == "_") or hint[0] == "-" and at and not s[at - 1].isspace():
                continue
            m = (_BASIC if hint.startswith("basic ") else _WORD).match(s, h.end() if hint[0] != "b" or hint[:5] != "basic" else at)
            if m and (_signed_in(m[1]) if hint.startswith("basic ") else live_value(m[1])):
                add(m.start(1), m.end(1), "text")
                done = m.end()
            continue
        if hint.startswith("://"):
            a = at
            while a and (s[a - 1].isalnum() or s[a - 1] in "+.-"):
                a -= 1
            while a < at and not s[a].isalpha():
                a += 1
            if (m := _URL.match(s, a)) and not _REFERENCE.search(m[1]) and not _PLACEHOLDER.search(m[1]) and not re.fullmatch(r"(?i)pass(word)?|pwd|secret|token", m[1]):
                add(m.start(1), m.end(1), "url")
            continue
        if hint.startswith(("eyj", *_AT_WORD)):
            a = at
            while a and (s[a - 1].isalnum() or s[a - 1] == "_") and at - a < 7:
                a -= 1
            m = _ISSUED.match(s, at) or _ISSUED.match(s, a)
            if m:
                if not _PLACEHOLDER.search(m[0]):
                    add(m.start(), m.end(), "token")
                    done = m.end()
                continue
        # the whole name around the hint
        b = _NAME.match(s, at).end()
        if b < len(s) and s[b] not in _AFTER:
            done = b
            continue
        a = at
        while a and (s[a - 1].isalnum() or s[a - 1] in "_-"):
            a -= 1
        done = b
        name = s[a:b]
        if name.lower().endswith("login") or name.lower() in ("authenticate", "signin", "logon"):
            _login(x, b, add)
            if (m := _SPOKEN_LOGIN.match(s, b)) and live_value(m[1]):
                add(m.start(1), m.end(1), "text")
            continue
        sort = credential_name(name)
        if not sort:
            continue

        def live(v: str, sort: str = sort, given: bool = False) -> bool:
            """`given`: the value is a whole literal given to the name."""
            if given and sort == "password" and worded_value(v):
                return True
            return live_value(v) and (sort != "key" or len(v) >= 16 or not _NAMELIKE.match(v) and len(v) >= 12) and not (sort == "hashed" and _DIGEST.match(v))

        strong = sort in ("strong", "password")
        # pairs inside strings, URLs and comments: name=value
        if m := _TO_LITERAL.match(s, b):
            if v := x.value(m.end()):
                # an argument beside a name that is itself a literal is another argument
                if live(v[2], given="(" not in m[0] or "=" in m[0]) and not re.match(r"[\"'`]?\s*,", s[b : b + 3] if s[a - 1 : a] not in "\"'" else ""):
                    add(v[0], v[1], "literal")
                    continue
                if re.search(r"(?i)(password|pwd|key|secret)\s*=", v[2]):
                    continue
        if m := _XML_VALUE.match(s, b):
            if (v := x.literal(m.end())) and live(s[v[0] : v[1]], given=True):
                add(v[0], v[1], "attribute")
            continue
        if s[a - 1 : a] == "<":
            if (m := _XML_TEXT.match(s, b)) and live(m[1], given=True):
                add(m.start(1), m.end(1), "element")
            continue
        if m := _BARE.match(s, b):
            v = m[1]
            # in a string, as in connection strings, there are no expressions
            t = _place(x.tokens, x.starts, a)
            quoted = t is not None and t.kind not in ("comment", "text", "name") or t is not None and t.kind == "comment" and s.count('"', s.rfind("\n", 0, a) + 1, a) % 2 == 1
            if quoted and not v.islower() and not v.isdigit() and not (_REFERENCE.search(v) or _PLACEHOLDER.search(v) or _GUID.match(v)) and strong:
                add(m.start(1), m.end(1), "pair")
            elif live(v) and not v.isalpha() and (_ISSUED.match(v) or not re.search(r"^\w+[.(]|\w\(|;$", v.rstrip(".")) and not _IDENTIFIER.match(v)):
                add(m.start(1), m.end(1), "pair")
            continue
        line_end = _line_end(s, b)
        # `-H 'X-Api-Key: ...'`, "password `...`", "password is ..."
        if m := _QUOTED.match(s, b, line_end):
            if live(m[1]):
                add(m.start(1), m.end(1), "text")
                continue
        if strong and (m := _SPOKEN.match(s, b, line_end)) and live(m[1].rstrip(".")) and not _IDENTIFIER.match(m[1]):
            add(m.start(1), m.start(1) + len(m[1].rstrip(".")), "text")
            continue
        # a setting's value stands before its name in an UPDATE
        if s[a - 1 : a] in "'\"":
            line = s.rfind("\n", 0, a) + 1
            for m in _SQL_BEFORE.finditer(s, line, a):
                if (v := x.literal(m.end())) and live(s[v[0] : v[1]], given=True):
                    add(v[0], v[1], "literal")
    out = []
    line, last = 1, 0
    for a in sorted(spots):
        line += s.count("\n", last, a)
        last = a
        out.append(Found(a, spots[a][0], line, spots[a][1]))
    return out


def _line_end(s: str, at: int) -> int:
    end = s.find("\n", at)
    return len(s) if end < 0 else end


def _login(x: Text, b: int, add) -> None:
    """The second literal of a call that signs in."""
    m = _LOGIN.match(x.s, b)
    if not m:
        return
    first = x.literal(m.end())
    if first and (c := _COMMA.match(x.s, first[2])):
        v = x.value(c.end())
        if v and (live_value(v[2]) or worded_value(v[2])):
            add(v[0], v[1], "argument")


_BODY = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9/=][A-Za-z0-9+/=]*|\+[A-Za-z0-9+/=]+")
_FRAME = re.compile(r"-----(?:BEGIN|END)[^-\n]*-----")


def _block(content: str, kind: str) -> str:
    """A piece of a key block: every run of its letters overwritten, its opening line kept."""
    out, at = [], 0
    for m in _FRAME.finditer(content):
        out += (overwrite(content[at : m.start()], kind, _BODY), m[0])
        at = m.end()
    return "".join(out) + overwrite(content[at:], kind, _BODY)


def redact(s: str) -> str:
    """The text with each credential's contents overwritten; delimiters, escapes, line breaks and what joins literals stay, and so does the length."""
    if not s:
        return s
    x = Text(s)
    found = _found(x, _low(s))
    if not found:
        return s
    out, last = [], 0
    for f in found:
        out.append(s[last : f.start])
        blank = _block if f.kind == "private key" else overwrite
        k = max(0, bisect_right(x.starts, f.start) - 1)
        at = f.start
        literal = False
        while k < len(x.tokens) and x.tokens[k].start < f.end:
            t = x.tokens[k]
            k += 1
            a, b = max(t.a, f.start), min(t.b, f.end)
            if t.kind in ("comment", "name") or a >= b:
                continue
            literal = True
            out += (s[at:a], blank(s[a:b], t.kind))
            at = b
        if not literal:  # in a comment, in prose, or a bare value; quotes inside it are joined literals
            body = s[f.start : f.end]
            parts = re.split(r"([\"']\s*[+&]\s*[$@]*[\"'])", body)
            out.append("".join(p if i % 2 else blank(p, "") for i, p in enumerate(parts)))
        else:
            out.append(s[at : f.end])
        last = f.end
    out.append(s[last:])
    return "".join(out)


def credentials(contents: DataFrame) -> DataFrame:
    """(file_id, line_no, start_char, end_char, kind) of each credential; one row a place."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, f.line_no, f.start, f.end, f.kind) for i, s in zip(b["file_id"], b["content"]) if s for f in find(s)]
            yield pd.DataFrame(rows, columns=["file_id", "line_no", "start_char", "end_char", "kind"])

    found = contents.select(whole_id("file_id").alias("file_id"), "content").where("content is not null and content <> ''")
    return spread(found).mapInPandas(scan, "file_id long, line_no long, start_char long, end_char long, kind string").distinct().withColumn("file_id", own_id("file_id"))


def redacted(contents: DataFrame) -> DataFrame:
    """(file_id, content) with every credential overwritten in place."""

    @F.pandas_udf("string")
    def clean(s: pd.Series) -> pd.Series:
        return s.map(lambda x: redact(x) if x else x)

    return spread(contents.select("file_id", "content")).select("file_id", clean("content").alias("content"))
