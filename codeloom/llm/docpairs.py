"""Functions paired with their documentation, inherited documentation included.

Documentation comments are cut from the texts alone, each with the lines on
which the declaration below it may start; only these short rows meet the
symbols, never whole contents. A symbol's own documentation is judged by its
words: tags, placeholders and the words of the symbol's own name do not count.
Functions that inherit their documentation are resolved by iterated joins over
the class hierarchy parsed from the same texts, one generation a round, until
a round resolves nothing new; what stays unresolved or empty is dropped. A base
type is looked up as the languages do: in the file, the namespaces around it and
those that the file imports, so types of one name meet only where one can see
the other. A base type without documentation for the function is passed through
to its own bases, up to the roots; the parts of a partial type count as one.

Defined results: rows of one symbol id count once (the smallest row wins);
symbols without file, start line or name have no documentation; null contents
have none; files whose contents differ between rows offer the comments of each;
empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.llm.lexer import lex
from codeloom.llm.rows import spread
from codeloom.sources.tables import Scratch

KINDS = ("method", "constructor", "function")
TYPES = ("class", "interface", "struct", "record")

_TAG = re.compile(r"<[^<>]*>")
_PARAM = re.compile(r"<(param|typeparam)\b[^>]*name\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</\1>", re.S | re.I)
_REFERENCE = re.compile(r"<(?:see|seealso|paramref|typeparamref)\b[^>]*?(?:cref|name|langword|href)\s*=\s*[\"'](?:\w:)?([^\"']*)[\"'][^>]*?/?>", re.I)
_INHERIT = re.compile(r"<inheritdoc\b([^>]*)>", re.I)
_CREF = re.compile(r"cref\s*=\s*[\"'](?:\w:)?([^\"']*)[\"']")
_TYPE_ARGUMENTS = re.compile(r"\{[^{}]*\}|<[^<>]*>|`+\d+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_FILLER = frozenset("the a an of to by for in on at with and or this that its is are be it from into via as gets sets get set returns return value method function constructor initializes new instance class use used der die das den dem des ein eine einen le la les l un une du des de el los las del al и в на с для".split())
_PLACEHOLDER = frozenset("todo tbd tba fixme xxx na none null summary description document documented documentation doc docs comment comments missing placeholder write add fill me here later pending undocumented hack wip lorem ipsum see inheritdoc beschreibung zusammenfassung folgt noch offen à faire compléter pendiente descripción documentar описание позже".split())
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯฀-๿ऀ-ॿ؀-ۿ]")


def plain(doc: str) -> str:
    """The text of a documentation comment without its tags; references give their last name."""
    t = _REFERENCE.sub(lambda m: " " + m[1].split("(")[0].split(".")[-1] + " ", doc)
    t = _TAG.sub(" ", t)
    return " ".join(t.split())


def _same(a: str, b: str) -> bool:
    """Whether two lower-case words are forms of one."""
    if a == b:
        return True
    n = min(len(a), len(b))
    k = 0
    while k < n and a[k] == b[k]:
        k += 1
    return k >= 3 and k >= n - 1 and abs(len(a) - len(b)) <= 3 or k >= 4 and k >= n - 2 and max(len(a), len(b)) - k <= 3


def meaningful(doc: str, name: str, container: str | None = None) -> bool:
    """Whether a comment says more than its tags, placeholders and the words of the symbol's name."""
    # a parameter whose text only repeats its own name says nothing
    def keep(m: re.Match) -> str:
        own = [w.lower() for w in _CAMEL.findall(m[2])]
        left = [w for w in _WORD.findall(plain(m[3])) if w.lower() not in _FILLER and not any(_same(w.lower(), o) for o in own)]
        return " " + m[3] + " " if left else " "

    text = plain(_PARAM.sub(keep, doc))
    if len(_WIDE.findall(text)) >= 4:
        return True
    own = [w.lower() for w in _CAMEL.findall(name or "")]
    for w in _WORD.findall(text):
        w = w.lower()
        if len(w) > 1 and w not in _FILLER and w not in _PLACEHOLDER and not any(_same(w, o) for o in own):
            return True
    return False


_SLASHES = re.compile(r"[ \t]*///(?!/)(.*)")
def _is_attribute(line: str, open_: int) -> tuple[bool, int]:
    """Whether a line holds nothing but attributes, and how many brackets stay open."""
    depth = open_
    rest = ""
    quoted = False
    for c in line:
        if c == '"':
            quoted = not quoted
        elif quoted:
            continue
        elif c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
        elif depth == 0 and not c.isspace():
            rest += c
    return not rest.startswith(tuple("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_~(")) or depth > 0, depth


def comments(s: str) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, text) of each documentation comment: the declaration under it starts on one of these lines."""
    if "///" not in s and "/**" not in s and "(**" not in s:
        return
    lines = s.replace("\r\n", "\n").split("\n")
    n, k = len(lines), 0
    inside = ""  # what ends a verbatim or raw string or an ordinary comment over several lines
    while k < n:
        line = lines[k]
        x = line.lstrip(" \t﻿")
        if inside:
            if inside in line:
                inside = ""
            k += 1
            continue
        text = None
        if x.startswith("///") and not x.startswith("////"):
            part = []
            while k < n and (m := _SLASHES.match(lines[k])):
                part.append(m[1].strip())
                k += 1
            text = "\n".join(part)
            tail = ""
        elif x.startswith("/**") and not x.startswith("/***") and not x.startswith("/**/") or x.startswith("(**") and not x.startswith(("(***", "(**)")):
            close = "*/" if x[0] == "/" else "*)"
            body = x[3:]
            part = []
            while close not in body and k + 1 < n:
                part.append(body)
                k += 1
                body = lines[k]
            cut = body.find(close)
            if cut < 0:
                return
            part.append(body[:cut])
            tail = body[cut + 2 :].strip()
            text = "\n".join(p.strip().removeprefix("*").strip() for p in part)
            k += 1
        if text is None:
            # skip what only looks like comments inside longer literals
            if '@"' in line and line.count('"', line.index('@"') + 2) % 2 == 0:
                inside = '"'
            elif line.count('"""') % 2:
                inside = '"""'
            elif x.startswith("/*") and "*/" not in x:
                inside = "*/"
            elif x.startswith("(*") and "*)" not in x and not x.startswith("(*)"):
                inside = "*)"
            k += 1
            continue
        if tail:
            yield k, k, text
            continue
        # blank lines, attributes and compiler switches stand aside
        j, depth = k, 0
        while j < n:
            y = lines[j].strip()
            if depth:
                only, depth = _is_attribute(y, depth)
            elif not y or y.startswith("#"):
                pass
            elif y.startswith("["):
                only, depth = _is_attribute(y, 0)
                if not only:
                    break
            else:
                break
            j += 1
        if j < n:
            z = lines[j].strip()
            # another comment below is what stands directly above the declaration
            if not z.startswith(("//", "/*", "(*")):
                yield k + 1, j + 1, text


_CS_TYPE = re.compile(r"\b(?:class|interface|struct|record(?:\s+(?:class|struct))?)\s+(\w+)")
#: What a text needs at least to list a base or a part of a type.
_LISTS = re.compile(r"\b(?:class|interface|struct|record)\s[^{;:]*:|\binherit\s|\binterface\s|\bpartial\s")
_CS_SPACE = re.compile(r"\bnamespace\s+([\w.]+)")
_CS_USING = re.compile(r"^[ \t\ufeff]*(?:global\s+)?using\s+([\w.]+)\s*;", re.M)
_FS_TYPE = re.compile(r"^[ \t]*(?:type|and)\s+(?:\[<[^\n]*>\]\s*)?(?:private\s+|internal\s+|public\s+)?(\w+)|^[ \t]+inherit\s+([\w.]+)|^[ \t]+interface\s+([\w.]+)", re.M)
_FS_SPACE = re.compile(r"^[ \t\ufeff]*(?:namespace|module)\s+(?:rec\s+|internal\s+|private\s+|public\s+|global\.)*([\w.]+)", re.M)
_FS_OPEN = re.compile(r"^[ \t]*open\s+(?:type\s+)?([\w.]+)", re.M)
_CLOSED = {"<": ">", "(": ")", "[": "]", "{": "}"}


def code_only(s: str, family: str) -> str:
    """The text with its comments and literals blanked, places unchanged."""
    out, at = [], 0
    for t in lex(s, family):
        out += (s[at : t.start], re.sub(r"[^\n]", " ", s[t.start : t.end]))
        at = t.end
    return "".join(out) + s[at:]


def _base_list(s: str, at: int) -> Iterator[str]:
    """Names in the base list of the C# type whose name ends at `at`: type parameters and a primary constructor are stepped over, arguments are not names."""
    n, depth = len(s), 0
    listed = False
    part: list[str] = []
    while at < n:
        c = s[at]
        if c in "<([":
            depth += 1
        elif c in ">)]":
            depth -= 1
        elif depth == 0:
            if c in "{;" or c == "w" and re.match(r"where\b", s[at:at + 6]) and not s[at - 1].isalnum() or c == "=" and not listed:
                break
            if c == ":" and s[at + 1 : at + 2] != ":" and s[at - 1] != ":" and not listed:
                listed = True
            elif c == "," and listed:
                yield "".join(part).strip()
                part = []
            elif listed:
                part.append(c)
        at += 1
    if listed and part:
        yield "".join(part).strip()


def hierarchy(s: str) -> Iterator[tuple[str, str, int]]:
    """(what, name, place) of a text's class hierarchy: ('space', namespace), ('import', namespace), and ('base', 'Type:Base') in order; ('part', type) of partial types."""
    if re.search(r"^[ \t]*(?:let|open|type|module)\b", s, re.M) and not re.search(r"^[ \t]*(?:using|namespace)\b[^\n]*[;{]?\s*$", s, re.M) or "inherit " in s and "\n    member " in s:
        code = code_only(s, "fs")
        for k, m in enumerate(_FS_SPACE.finditer(code)):
            yield "space", m[1], k
        for k, m in enumerate(_FS_OPEN.finditer(code)):
            yield "import", m[1], k
        name, k = None, 0
        for m in _FS_TYPE.finditer(code):
            if m[1]:
                name, k = m[1], 0
            elif name:
                yield "base", f"{name}:{(m[2] or m[3]).split('.')[-1]}", k
                k += 1
        return
    code = code_only(s, "cs")
    for k, m in enumerate(_CS_SPACE.finditer(code)):
        yield "space", m[1], k
    for k, m in enumerate(_CS_USING.finditer(code)):
        yield "import", m[1], k
    for m in _CS_TYPE.finditer(code):
        if re.search(r"\bpartial\s+$", code[max(0, m.start() - 40) : m.start()]):
            yield "part", m[1], 0
        for k, b in enumerate(_base_list(code, m.end())):
            if b := b.split("::")[-1].split(".")[-1].strip():
                yield "base", f"{m[1]}:{b}", k


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["file_id", "sort", "name", "line", "text"]
    for b in batches:
        rows = []
        for i, s in zip(b["file_id"], b["content"]):
            heirs = False
            for first, last, text in comments(s):
                rows += [(i, "doc", None, line, text) for line in range(first, last + 1)]
                heirs = heirs or bool(_INHERIT.search(text))
            if heirs or _LISTS.search(s):  # bases of any file may stand above what inherits
                rows += [(i, what, None, k, name) for what, name, k in hierarchy(s)]
        yield pd.DataFrame(rows, columns=cols)


def _named(cref: str) -> str:
    """The dotted name that a reference gives, without type arguments and parameters."""
    t = cref.split("(")[0]
    while t != (t := _TYPE_ARGUMENTS.sub("", t)):
        pass
    return t.split("<")[0].split("{")[0].strip()


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds to each comment `sort` (1 meaningful, 2 inherited, 0 trivial), the type that an inheritdoc names, if it does, and the text without tags."""
    for b in batches:
        rows = []
        for t, n in zip(b["text"], b["name"]):
            sort = 1 if meaningful(t, n) else 2 if (m := _INHERIT.search(t)) else 0
            c = _CREF.search(m[1]) if sort == 2 else None
            rows.append((sort, _named(c[1]) if c else None, plain(t) if sort == 1 else None))
        yield pd.concat([b[["symbol_id", "file_id", "name", "container", "kind", "signature"]], pd.DataFrame(rows, columns=["sort", "named", "documentation"])], axis=1)


def _symbols(symbols: DataFrame, kinds: tuple[str, ...], cols: list[str]) -> DataFrame:
    s = symbols.where(F.col("kind").isin(*kinds) & F.col("id").isNotNull() & F.col("file_id").isNotNull())
    return s.groupBy(F.col("id").alias("symbol_id")).agg(F.min(F.struct(*cols)).alias("v")).select("symbol_id", "v.*")


def own_documentation(symbols: DataFrame, contents: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(documented functions with `sort`, `named` and `documentation`; rows of the hierarchy: file_id, sort, line, text)."""
    texts = contents.select(F.col("file_id").cast("long").alias("file_id"), "content").where("file_id is not null and content is not null")
    cut = scratch.cut(spread(texts).mapInPandas(_scan, "file_id long, sort string, name string, line int, text string"))
    docs = cut.where("sort = 'doc'").select(F.col("file_id").alias("d_file"), F.col("line").alias("d_line"), "text").distinct()
    functions = _symbols(symbols, KINDS, ["file_id", "start_line", "name", "container", "kind", "signature"]).where("start_line is not null and name is not null")
    j = functions.join(docs, (functions["file_id"] == docs["d_file"]) & (functions["start_line"] == docs["d_line"])).drop("d_file", "d_line")
    judged = j.mapInPandas(_judge, "symbol_id long, file_id long, name string, container string, kind string, signature string, sort int, named string, documentation string").where("sort > 0")
    return scratch.cut(judged), cut.where("sort <> 'doc'").select("file_id", "sort", "line", "text").distinct()


def _around(ns: str) -> Column:
    """A namespace and those around it, the global one included."""
    parts = F.split(ns, r"\.")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws(".", F.slice(parts, 1, n))))


def _seen(listed: DataFrame, symbols: DataFrame) -> DataFrame:
    """(s_file, seen, near) for each file with a hierarchy: the namespaces that it sees; `near` 1 if imported, 2 and more for those around it, the innermost most."""
    own = symbols.where("ns is not null").select("file_id", F.col("ns").alias("text"))
    spaces = listed.where("sort = 'space'").select("file_id", "text").unionByName(own.join(listed.select("file_id").distinct(), "file_id", "left_semi")).distinct()
    around = spaces.select("file_id", F.posexplode(_around("text")).alias("near", "seen")).withColumn("near", F.col("near") + 2)
    imported = listed.where("sort = 'import'").select("file_id", F.lit(1).alias("near"), F.col("text").alias("seen"))
    return around.unionByName(imported).groupBy(F.col("file_id").alias("s_file"), "seen").agg(F.max("near").alias("near"))


#: `near` of a type of the same file.
SAME_FILE = 1 << 20


def _looked_up(asks: DataFrame, sees: DataFrame, up: DataFrame) -> DataFrame:
    """The types that names mean in their files: of each name those of the nearest place only, and the other parts of partial ones."""
    key = ["symbol_id", "f_name", "told", "a_file", "base"]
    cols = [*key, "u_name", "u_ns", "u_file", "u_full", "u_part"]
    asked = asks.join(sees, asks["a_file"] == sees["s_file"])
    by_space = asked.join(up.where("u_ns is not null"), (F.col("base") == F.col("u_name")) & (F.col("seen") == F.col("u_ns"))).select(*cols, "near")
    by_file = asks.join(up, (asks["base"] == up["u_name"]) & (asks["a_file"] == up["u_file"])).select(*cols, F.lit(SAME_FILE).alias("near"))
    # what no namespace leads to may still be told by its name, where that is a single type's
    one = F.struct("u_file", "u_full", "u_ns", "u_part")
    loose = up.groupBy("u_name").agg(F.min(one).alias("v"), F.max(one).alias("w")).where("v = w").select("u_name", "v.*")
    by_name = asks.join(loose, asks["base"] == loose["u_name"]).select(*cols, F.lit(0).alias("near"))
    every = by_space.unionByName(by_file).unionByName(by_name)
    nearest = every.withColumn("most", F.max("near").over(Window.partitionBy(*key))).where("near = most").drop("most", "a_file", "base")
    others = up.where("u_part").select(F.col("u_name").alias("o_name"), F.col("u_ns").alias("o_ns"), F.col("u_file").alias("o_file"), F.col("u_full").alias("o_full"))
    split = nearest.where("u_part").join(others, (F.col("u_ns").eqNullSafe(F.col("o_ns"))) & (F.col("u_full") == F.col("o_full")) & (F.col("u_file") != F.col("o_file")))
    parts = split.select("symbol_id", "f_name", "told", F.col("o_name").alias("u_name"), "u_ns", F.col("o_file").alias("u_file"), "u_full", "u_part", "near")
    return nearest.unionByName(parts).groupBy("symbol_id", "f_name", "u_name", "u_ns", "u_file", "u_full", "u_part").agg(F.max("told").alias("told"), F.max("near").alias("near"))


def _inherited_from(documented: DataFrame, listed: DataFrame, symbols: DataFrame, scratch: Scratch) -> DataFrame:
    """(symbol_id, m_id, rank): for each inheriting function the documented or inheriting functions of its name in the types that its comment names and in its base types.

    Base types are climbed a generation a round; a path ends at a type that has
    such a function, and each type is asked once for each function, so cycles
    end too. `rank` is greater for what a comment names, for nearer generations,
    nearer places of the type, and equal parameters.
    """
    # constructors inherit from constructors, whatever their types are called
    f_name = F.when(F.col("kind") == "constructor", ".ctor").otherwise(F.col("name"))
    params = F.regexp_replace(F.regexp_extract("signature", r"\((.*)\)", 1), r"\s+", " ")
    said = documented.select("symbol_id", "file_id", "container", "sort", "named", f_name.alias("f_name"), params.alias("params"))
    # the type around the heir is the last name of its container
    heir = said.where("sort = 2").withColumn("t_name", F.substring_index("container", ".", -1))
    files = listed.where("sort = 'part'").select(F.col("file_id").alias("p_file"), F.col("text").alias("p_name"), F.lit(True).alias("hit")).distinct()
    types = _symbols(symbols, TYPES, ["file_id", "name", "container", "ns"]).where("name is not null")
    types = types.join(files, (types["file_id"] == files["p_file"]) & (types["name"] == files["p_name"]), "left")
    up = types.select(F.col("name").alias("u_name"), F.col("ns").alias("u_ns"), F.col("file_id").alias("u_file"), F.concat_ws(".", "container", "name").alias("u_full"), F.coalesce("hit", F.lit(False)).alias("u_part")).distinct()
    up, sees = scratch.cut(up), scratch.cut(_seen(listed, symbols))
    bases = scratch.cut(listed.where("sort = 'base'").select(F.col("file_id").alias("b_file"), F.substring_index("text", ":", 1).alias("b_name"), F.substring_index("text", ":", -1).alias("base")).distinct())

    def asked(at: DataFrame) -> DataFrame:
        return at.join(bases, (at["u_file"] == bases["b_file"]) & (at["u_name"] == bases["b_name"])).select("symbol_id", "f_name", "told", F.col("u_file").alias("a_file"), "base")

    mine = heir.select("symbol_id", "f_name", F.lit(False).alias("told"), "file_id", "container", F.col("t_name").alias("u_name"))
    part = mine.join(up.drop("u_name").where("u_part"), (F.col("file_id") == F.col("u_file")) & (F.col("container") == F.col("u_full")))
    other = up.where("u_part").select(F.col("u_file").alias("o_file"), F.col("u_full").alias("o_full"), F.col("u_ns").alias("o_ns"))
    part = part.join(other, F.col("u_ns").eqNullSafe(F.col("o_ns")) & (F.col("u_full") == F.col("o_full"))).select("symbol_id", "f_name", "told", F.col("o_file").alias("u_file"), "u_name")
    first = asked(mine.select("symbol_id", "f_name", "told", F.col("file_id").alias("u_file"), "u_name").unionByName(part).distinct())
    # a comment may name a type, a member of a type, or a member of its own type
    named = heir.where("named <> ''").select("symbol_id", "f_name", F.lit(True).alias("told"), F.col("file_id").alias("a_file"), "t_name", F.regexp_extract("named", r"(\w+)$", 1).alias("last"), F.regexp_extract("named", r"(\w+)\.\w+$", 1).alias("last_but_one"))
    whole = named.select("symbol_id", "f_name", "told", "a_file", F.col("last").alias("base"))
    member = F.when(F.col("last") == F.col("last_but_one"), ".ctor").otherwise(F.col("last"))
    of_type = named.select("symbol_id", member.alias("f_name"), "told", "a_file", F.col("last_but_one").alias("base"))
    sibling = named.where("last_but_one = ''").select("symbol_id", F.when(F.col("last") == F.col("t_name"), ".ctor").otherwise(F.col("last")).alias("f_name"), "told", "a_file", F.col("t_name").alias("base"))
    asks = scratch.cut(first.unionByName(whole).unionByName(of_type).unionByName(sibling).where("base <> ''").distinct())

    candidates = said.select(F.col("symbol_id").alias("m_id"), F.col("file_id").alias("m_file"), F.col("f_name").alias("m_name"), F.col("container").alias("m_container"), F.col("params").alias("m_params"))
    own_params = heir.select(F.col("symbol_id").alias("h_id"), "params")
    # the parts of one type are one
    typed = F.when(F.col("u_part"), F.struct(F.lit(None).cast("long").alias("f"), F.coalesce("u_ns", F.lit("")).alias("n"), F.col("u_full").alias("t"))).otherwise(F.struct(F.col("u_file").alias("f"), F.lit("").alias("n"), F.col("u_full").alias("t")))
    edges: DataFrame | None = None
    been: DataFrame | None = None
    depth = 0
    while not asks.isEmpty():
        reached = _looked_up(asks, sees, up)
        if been is not None:
            reached = reached.join(been, ["symbol_id", "f_name", "u_file", "u_full"], "left_anti")
        reached = scratch.cut(reached.withColumn("u_type", typed))
        hits = reached.join(candidates, (reached["u_file"] == candidates["m_file"]) & (reached["u_full"] == candidates["m_container"]) & (reached["f_name"] == candidates["m_name"])).where("symbol_id <> m_id")
        rank = F.struct("told", F.lit(-depth).alias("depth"), "near", (F.col("params") == F.col("m_params")).alias("like"))
        hits = scratch.cut(hits.join(own_params, F.col("symbol_id") == F.col("h_id")).select("symbol_id", "f_name", "u_type", "m_id", rank.alias("rank")))
        edges = hits if edges is None else edges.unionByName(hits)
        keys = reached.select("symbol_id", "f_name", "u_file", "u_full")
        been = keys if been is None else been.unionByName(keys)
        asks = scratch.cut(asked(reached.join(hits, ["symbol_id", "f_name", "u_type"], "left_anti")).distinct())
        depth += 1
    if edges is None:
        return documented.limit(0).select("symbol_id", F.col("symbol_id").alias("m_id"), F.lit(0).alias("rank"))
    return edges.groupBy("symbol_id", "m_id").agg(F.max("rank").alias("rank"))


def pairs(symbols: DataFrame, contents: DataFrame) -> DataFrame:
    """(symbol_id, file_id, name, signature, documentation, source_id): `source_id` is where the documentation was written, the symbol itself or what it inherits from.

    An inheriting function takes the documentation of the function of its name,
    or of the one that its comment names, in a base type at any distance: the
    nearest first, then one of equal parameters, then the smallest id; if that
    one inherits as well, of what it resolves to. Rounds end when one resolves
    nothing: each takes what it resolves out of what is left, so cycles end too.
    """
    scratch = Scratch(symbols.sparkSession, "docpairs")
    documented, listed = own_documentation(symbols, contents, scratch)
    done = documented.where("sort = 1").groupBy("symbol_id").agg(F.min("documentation").alias("documentation")).withColumn("source_id", F.col("symbol_id"))
    parts = [done]
    left = scratch.cut(_inherited_from(documented, listed, symbols, scratch).join(done.select("symbol_id"), "symbol_id", "left_anti"))
    frontier = done
    while not left.isEmpty():
        src = frontier.select(F.col("symbol_id").alias("s_id"), "documentation", "source_id")
        hit = left.join(src, left["m_id"] == src["s_id"])
        frontier = scratch.cut(hit.groupBy("symbol_id").agg(F.max_by(F.struct("documentation", "source_id"), F.struct("rank", -F.col("m_id"))).alias("v")).select("symbol_id", "v.documentation", "v.source_id"))
        if frontier.isEmpty():
            break
        parts.append(frontier)
        left = scratch.cut(left.join(frontier.select("symbol_id"), "symbol_id", "left_anti"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    info = _symbols(symbols, KINDS, ["file_id", "name", "signature"])
    return info.join(out, "symbol_id").select("symbol_id", "file_id", "name", "signature", "documentation", "source_id")


def found(symbols: DataFrame, contents: DataFrame) -> DataFrame:
    """(symbol_id) of functions with a meaningful documentation of their own: of all resolved pairs those that were not inherited."""
    return pairs(symbols, contents).where("source_id = symbol_id").select("symbol_id").distinct()
