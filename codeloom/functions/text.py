"""Column expressions for folding, globs, paths, tokens and snippets; all of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# fixed values: directories a workspace scan leaves out, and names that mark checked-in foreign code
EXCLUDED_DIRS = (".git", ".vs", ".idea", ".vscode", "bin", "obj", "packages", "node_modules", "testresults")
VENDOR_SEGMENTS = ("3rdparty", "thirdparty", "third-party", "third_party", "vendor", "vendored", "external", "externals", "generated")
# fixed values: file names of generated code
GENERATED_SUFFIXES = (
    ".g.cs", ".g.i.cs", ".designer.cs", ".generated.cs", ".assemblyattributes.cs",
    ".g.fs", ".g.i.fs", ".designer.fs", ".generated.fs", ".assemblyattributes.fs",
    ".g.fsi", ".g.i.fsi", ".designer.fsi", ".generated.fsi",
    ".g.fsx", ".g.i.fsx", ".designer.fsx", ".generated.fsx",
)


def fold(c: Column | str) -> Column:
    """ASCII-only case fold, as the store's NOCASE collation has it."""
    return F.translate(c, _UPPER, _LOWER)


def fold_text(s: str) -> str:
    return s.translate(str.maketrans(_UPPER, _LOWER))


def glob_like(pattern: str) -> str:
    """A query glob as a LIKE pattern with `\\` as escape: `*` crosses `/`, `?` is one character."""
    return re.sub(r"([\\%_])", r"\\\1", pattern).replace("*", "%").replace("?", "_")


def path_filter(path: Column, include: str | None = None, excludes: tuple[str, ...] = ()) -> Column:
    """Whether a path passes an include glob and no exclude glob.

    A leading `**/` also matches at the root, a glob with `/` is anchored, a bare
    one matches in any directory.
    """

    def one(pattern: str) -> Column:
        p = fold_text(pattern.replace("\\", "/"))
        folded = fold(path)
        if p.startswith("**/"):
            rest = glob_like(p[3:])
            return folded.like("%/" + rest) | folded.like(rest)
        if "/" in p:
            return folded.like(glob_like(p))
        return folded.like("%/" + glob_like(p)) | folded.like(glob_like(p))

    ok = one(include) if include else F.lit(True)
    for x in excludes:
        ok = ok & ~one(x)
    return ok


def build_glob_regex(pattern: str) -> str:
    """A build-file glob as an anchored regular expression: `*` and `?` stay within a segment, `**` is any number of segments."""
    out = []
    for k, segment in enumerate(parts := fold_text(pattern.replace("\\", "/")).split("/")):
        last = k == len(parts) - 1
        if segment == "**":
            out.append(".*" if last else "(?:[^/]+/)*")
        else:
            body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in segment)
            out.append(body + ("" if last else "/"))
    return "^" + "".join(out) + "$"


def segments(path: Column | str) -> Column:
    return F.split(fold(path), "/")


def has_segment(path: Column | str, names: tuple[str, ...], directories_only: bool = False) -> Column:
    """Whether any segment of a path (or any directory of it) is one of the names."""
    s = segments(path)
    if directories_only:
        s = F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))
    return F.arrays_overlap(s, F.array(*[F.lit(n) for n in names]))


def dir_name(path: Column | str) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def looks_generated(path: Column | str, content: Column | str) -> Column:
    """The cheap rule: a telling file name, or a banner in the first 400 characters."""
    name = fold(base_name(path))
    by_name = name.startswith("temporarygeneratedfile_")
    for suffix in GENERATED_SUFFIXES:
        by_name = by_name | name.endswith(suffix)
    head = fold(F.substring(content, 1, 400))
    return F.coalesce(by_name | head.contains("<auto-generated") | head.contains("<autogenerated"), F.lit(False))


def tokens(c: Column | str) -> Column:
    """Tokens of a text: maximal runs of letters, digits and `_`, ASCII-folded."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{Nd}_]+"), F.lit(0))


def query_tokens(s: str) -> list[str]:
    """Distinct tokens of a query, in order."""
    return list(dict.fromkeys(re.findall(r"\w+", fold_text(s))))


def whole_token(line: Column, token: str) -> Column:
    """Whether a line holds a token not within a longer one, ASCII-folded."""
    return line.rlike(token_regex(token))


def token_regex(token: str) -> str:
    """A whole token, ASCII-folded: Java's `(?i)` folds ASCII only, and spares translating the text."""
    return r"(?i)(?<![\p{L}\p{Nd}_])" + re.escape(fold_text(token)) + r"(?![\p{L}\p{Nd}_])"


def snippet(line: Column, most: int = 240) -> Column:
    """A line without trailing white space, cut after `most` characters."""
    t = F.regexp_replace(line, r"\s+$", "")
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)


def bounded(content: Column, most: int) -> Column:
    """A content, or null if it is longer than `most`."""
    return F.when(F.length(content) <= most, content)


def utf8_prefix(c: Column, most: int) -> Column:
    """The longest prefix of a text that takes at most `most` bytes in UTF-8; no character is split."""
    b = F.encode(c, "UTF-8")
    # a byte that goes on with a character begins with the bits 10
    goes_on = lambda at: F.conv(F.hex(F.substring(b, at, 1)), 16, 10).cast("int").bitwiseAND(F.lit(0xC0)) == 0x80
    cut = F.lit(max(0, most - 3))
    for n in (most - 2, most - 1, most):
        if n >= 0:
            cut = F.when(~goes_on(n + 1), n).otherwise(cut)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.decode(F.substring(b, F.lit(1), cut), "UTF-8"))


def split_variant_column(c: Column | str) -> Column:
    """As `split_variant`, over a column; null where nothing splits."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.regexp_replace(c, r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Za-z])(?=[0-9])", " ")
    return F.when(~c.rlike(r"\s") & (t != c), t)


def glob_column_regex(glob: Column) -> Column:
    """`build_glob_regex` of a column of globs, whose separators are `/` and which are folded."""
    g = F.regexp_replace(glob, r"([.+^$(){}|\[\]\\])", r"\\$1")
    g = F.regexp_replace(g, r"(^|/)\*\*/", "$1\u0001")
    g = F.regexp_replace(g, r"(^|/)\*\*$", "$1\u0002")
    g = F.replace(F.replace(g, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    g = F.replace(F.replace(g, F.lit("\u0001"), F.lit("(?:[^/]+/)*")), F.lit("\u0002"), F.lit(".*"))
    return F.concat(F.lit("^"), g, F.lit("$"))


def parse_list(s: str | None, most: int = 256, most_bytes: int = 64 * 1024) -> list[str]:
    """A list given as a JSON array of strings or with commas; blanks dropped, order kept, repeated entries once. Raises ValueError beyond the bounds or for what is no list."""
    import json

    if not s or not s.strip():
        return []
    if len(s.encode()) > most_bytes:
        raise ValueError("list too long")
    if s.lstrip().startswith("["):
        try:
            parts = json.loads(s)
        except ValueError as e:
            raise ValueError("not a JSON array") from e
        if not isinstance(parts, list) or not all(isinstance(x, str) for x in parts):
            raise ValueError("not an array of strings")
    else:
        parts = s.split(",")
    out = list(dict.fromkeys(x.strip() for x in parts if x.strip()))
    if len(out) > most:
        raise ValueError("too many entries")
    return out


def split_variant(s: str) -> str | None:
    """`Mode4` as `Mode 4`, `AsyncAPI` as `Async API`; None if nothing splits."""
    if re.search(r"\s", s):
        return None
    t = re.sub(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Za-z])(?=[0-9])", " ", s)
    return t if t != s else None


def join_variant(s: str) -> str | None:
    """`Mode 4` as `Mode4`; None if there is nothing to join."""
    parts = s.split()
    return "".join(parts) if len(parts) > 1 else None


def required_literals(pattern: str, shortest: int = 3) -> list[str]:
    """Whole tokens that every match of a regular expression must hold, ASCII-folded; conservative, possibly none.

    Only literals at the top level count, bounded by `\\b` or something that is no
    token character on both sides, never optional or repeated from zero, and
    none at all if the top level has alternatives.
    """
    depth, k, n = 0, 0, len(pattern)
    atoms: list[tuple[str, bool]] = []  # (what, is it a literal character)
    while k < n:
        c = pattern[k]
        if c == "\\" and k + 1 < n:
            d = pattern[k + 1]
            atoms.append(("\\" + d, False) if d.isalnum() else (d, True))
            k += 2
        elif c == "[":
            e = k + 1
            e += pattern[e : e + 1] == "^"
            e += pattern[e : e + 1] == "]"
            while e < n and pattern[e] != "]":
                e += 1 + (pattern[e] == "\\")
            atoms.append(("[", False))
            k = e + 1
        elif c == "(":
            depth, e = 1, k + 1
            while e < n and depth:
                if pattern[e] == "\\":
                    e += 1
                elif pattern[e] in "()":
                    depth += 1 if pattern[e] == "(" else -1
                e += 1
            atoms.append(("(", False))
            k = e
        elif c == "|":
            return []
        elif c in "?*+{":
            if c == "{":
                e = pattern.find("}", k)
                k = e if e > 0 else k
            if atoms:
                atoms[-1] = (c, False)
            k += 1
            if pattern[k : k + 1] == "?":
                k += 1
        elif c in ".^$":
            atoms.append((c, False))
            k += 1
        else:
            atoms.append((c, True))
            k += 1
    def edge(j: int) -> bool:
        """Whether an atom cannot be part of a token that a literal beside it belongs to."""
        if not 0 <= j < len(atoms):
            return False
        what, literal = atoms[j]
        return what == "\\b" or literal and not (what.isalnum() or what == "_")

    out, k = [], 0
    while k < len(atoms):
        j = k
        while j < len(atoms) and atoms[j][1] and (atoms[j][0].isalnum() or atoms[j][0] == "_"):
            j += 1
        if j - k >= shortest and edge(k - 1) and edge(j):
            out.append(fold_text("".join(a[0] for a in atoms[k:j])))
        k = max(j, k + 1)
    return list(dict.fromkeys(out))
