"""Generated, minified or vendored files and data blobs, by belief propagation over directory trees.

Each file's text gives evidence for five labels: what its leading comment
declares, how its lines are laid out, how much of it is data, and whether its
namespace is at home in the repository. Directories have evidence of their own
from conventional names. Files and directories form trees, so sum-product
messages, up by depth and down again, give exact marginals: a file's own
evidence is combined with what its parents and siblings suggest. Messages to a
directory are sums, taken map-side first, so a directory of any size is no hot
spot.

Defined results: files without content are labelled by their path alone; null
paths are roots of their own; repeated rows count once; other languages than
`langs` get no label; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from codeloom.llm.rows import spread
from codeloom.sources.tables import Scratch

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
LANGS = ("cs", "fs", "sql")
#: Directory names that by convention hold third-party copies or build output (whole names, lower case).
VENDOR_DIRS = ("third_party", "third-party", "thirdparty", "3rdparty", "external", "externals", "vendor", "deps", "libs", "node_modules", "bower_components")
OUTPUT_DIRS = ("obj", "bin", "artifacts", "dist", "gen", "generated")

_GENERATED = re.compile(
    r"""(?ix)^\W*<auto-?generated\b | ^\W*@?generated\b
    | \b(?:code|file|source)?\s*(?:auto(?:matically)?[- ])?(?:generated|produced|scripted|emitted|dumped|made|created)\s+(?:by|from|with)\s+(?:the\s+)?[A-Z]\w+,?\s+(?:template\s+|version\s+|v)?\d+(?:\.\d+)*
    | \b[A-Z]\w+\s+v?\d+(?:\.\d+)+\s+(?:wrote|generated|produced|created|made|emitted)\s+this
    | \b(?:changes|edits|modifications)\b.{0,30}\b(?:lost|overwritten|discarded)\b
    | \boutput\s+of\s+[A-Z]\w+\s+\d+(?:\.\d+)* | \bregenerated\s+on\s+every\s+build
    | \b(?:automatically|auto)[- ]?generated\b.*\bdo\s+not\s+(?:edit|modify|change|touch)
    | ^\W*(?:code|this\s+(?:code|file)\s+(?:is|was))\s+(?:auto)?generated\b
    | ^\W*do\s+not\s+(?:edit|modify|touch)\b | [.;,]\s+do\s+not\s+(?:edit|modify|touch)\b
    | werkzeug\s+(?:erzeugt|generiert) | automatisch\s+(?:erzeugt|generiert) | g[ée]n[ée]r[ée]\s+(?:automatiquement|par)\b | generado\s+(?:autom|por)\b
    | 自动生成 | 自動生成 | сгенерирован"""
)
#: A line that denies the claim, and what a line does to generated files when it talks about them: then it stands before the claim.
_DENIED = re.compile(r"(?i)\bby\s+hand\b|\bhand-?written\b|\bis\s+gone\b|\bno\s+longer\b|\bnothing\s+in\s+here\b|\b(?:not|never|isn't|wasn't)\s+(?:auto-?)?(?:generated|produced|made|copied)\b|\bused\s+to\s+be\b")
_TALKS = re.compile(r"(?i)\b(?:finds?|skips?|detects?|looks?\s+for|counts?|checks?|carr(?:y|ies)|lists?|reads?|reports?|ignores?|removes?|matches|recogni[sz]es|excludes?|tests?|says?|whether|if)\b")
_VENDORED = re.compile(r"(?i)\bupstream\s+copy\b|\bimported\s+from\s+the\s+\S+\s+(?:project|library|package)|\bpatches\s+belong\s+upstream\b|\bvendored\s+(?:from|copy)\b|\bthird[- ]party\s+copy\s+of\b|\bcopied\s+(?:verbatim\s+)?from\s+\S+\s+v?\d")
_ATTRIBUTE = re.compile(r"^\s*\[(?:assembly:\s*)?(?:[\w.]+\.)?(?:GeneratedCode|CompilerGenerated)(?:Attribute)?\b", re.M)
_HOME = re.compile(r"^[ \t﻿]*(?:namespace|module)[ \t]+(?:rec[ \t]+|global\.)?([^\W\d]\w*)", re.M)
_NUMBERS = re.compile(r"^\W*(?:(?:0x[0-9a-fA-F]+|-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[a-zA-Z]{0,2}\s*[,;]\s*){4,}")
_BASE64 = re.compile(r"""^\s*@?["'][A-Za-z0-9+/=_-]{48,}["']\s*[+,;&]?\s*$""")
_TUPLE = re.compile(r"""^\s*\(\s*(?:-?[\d.]+|N?'[^']*'|"[^"]*"|NULL|null)(?:\s*[,;]\s*(?:-?[\d.]+\w?|N?'[^']*'|"[^"]*"|NULL|null))+\s*\)\s*[,;]?\s*$""")
_LITERAL = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'')
LONG = 200


def _data_line(line: str) -> bool:
    return bool(_NUMBERS.match(line) or _BASE64.match(line) or _TUPLE.match(line))


def _claims(claim: re.Pattern, line: str) -> bool:
    """Whether a line claims something of its own file: nothing before the claim makes it the object of a verb."""
    return any(not _TALKS.search(line, 0, m.start()) for m in claim.finditer(line))


def features(s: str) -> tuple[float, float, float, float, float, str | None]:
    """(generated, minified, vendored, blob) evidence of a text between 0 and 1, the lines of data behind the last, and its root namespace."""
    t = s.lstrip("﻿")
    lines = t.split("\n")
    # the leading comment, whatever its style
    generated = vendored = 0.0
    inside = False
    for line in lines:
        x = line.strip()
        if not x:
            continue
        if not inside and not x.startswith(("//", "--", "/*", "(*", "#", "<!--")):
            break
        if x.startswith(("/*", "(*")):
            inside = True
        if inside and ("*/" in x or "*)" in x):
            inside = False
        if x.startswith("///"):
            break
        if _DENIED.search(x):
            continue
        if _claims(_GENERATED, x):
            generated = 1.0
        if _claims(_VENDORED, x):
            vendored = 1.0
    if "Generated" in t and _ATTRIBUTE.search(t):
        generated = 1.0
    home = _HOME.search(t)
    # layout: share of the code's marks in long lines, and share of data
    marks = long_marks = data = total = 0
    n_data = 0
    for line in lines:
        x = line.strip()
        if not x or x.startswith(("//", "--", "*", "/*", "(*")):
            continue
        total += len(x)
        if x[0] in "0123456789\"'(-@{" and len(x) > 6 and _data_line(x):
            data += len(x)
            n_data += 1
            continue
        if len(x) > LONG:
            bare = _LITERAL.sub("", x)
            # a comment behind short code does not make the line long
            cut = bare.find("//")
            bare = bare[:cut] if cut >= 0 else bare
            if len(bare) > LONG:
                m = sum(map(bare.count, ";{}()|"))
                if _digits(bare) > 0.75:
                    data += len(x)
                    n_data += len(x) // 60
                elif m * 12 >= len(bare):
                    long_marks += m
                    marks += m
                    continue
            elif len(x) - len(bare) > 0.9 * len(x) and _packed(x):
                data += len(x)
                n_data += len(x) // 80
                continue
        marks += sum(map(x.count, ";{}()|"))
    minified = long_marks / marks if marks else 0.0
    blob = data / total if total else 0.0
    return generated, minified, vendored, blob, float(n_data), home[1] if home else None


def _digits(x: str) -> float:
    return sum(c in "0123456789abcdefxABCDEFX,.- " for c in x) / len(x)


def _packed(x: str) -> bool:
    """A long literal without words: encoded data."""
    return " " not in max(_LITERAL.findall(x), key=len, default=" ")


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([(i, *features(s)) for i, s in zip(b["file_id"], b["content"])], columns=["file_id", "generated", "minified", "vendored", "blob", "rows", "home"])


#: Log-compatibility of a child's label with its parent's: alike is likelier, and any mixture remains possible.
ALIKE, APART = 1.8, -1.8
#: So many files in vendor directories tell as much of their root as one upstream header, which own files never have.
HEADER = 8


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """`f` of `x` with `x` worked out once: a lambda's variable is a value, where a column would be put in at each use."""
    return F.transform(F.array(x), f)[0]


def _message(b: Column) -> Column:
    """What a node with log-belief `b` (one entry a label) tells its neighbour of each label: log-sum-exp over its own."""
    far, near = math.exp(APART), math.exp(ALIKE) - math.exp(APART)

    def told(e: Column) -> Column:
        # e: exp(b - max b); the greatest belief itself cancels out between labels
        return _let(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x) * far, lambda all_: F.transform(e, lambda x: F.log(all_ + x * near)))

    return _let(b, lambda v: _let(F.array_max(v), lambda top: _let(F.transform(v, lambda x: F.exp(x - top)), told)))


def _sum(name: str) -> Column:
    """Entry-wise sum of an array column in an aggregation."""
    return F.array(*[F.sum(F.col(name)[i]) for i in range(len(LABELS))])


def _plus(a: Column, b: Column) -> Column:
    return F.when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x + y))


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


#: Square of the lines of data that make a file of data as likely a table in code as a blob.
SOME_ROWS = 36.0


def _sure(share: Column, even: float) -> Column:
    """A share as belief: a half at `even`, near certain a fifth away from it."""
    return 1 / (1 + F.exp((even - share) * 20))


def _between(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def _odds(a: Column, b: Column, less: float = 0.5) -> Column:
    """Log-odds of two counts, mild where both are small."""
    return F.log((a + less) / (b + less))


def _foreign(j: DataFrame) -> DataFrame:
    """(h_repo, h_home, foreign): log-odds that a root namespace is a third party's in a repository.

    Copies are told by what does not vanish with their number: the root's files
    anywhere that lie in vendor directories or have an upstream header, and its
    spread over repositories where others' files prevail. Against that stands
    the root's share of the repository's files outside of those.
    """
    vendor = F.arrays_overlap(F.split(F.lower("dir"), "/"), F.array(*[F.lit(x) for x in VENDOR_DIRS]))
    head = F.coalesce("vendored", F.lit(0.0)) > 0
    count = lambda c: F.sum(c.cast("long"))
    homes = j.where("home is not null").groupBy(F.col("repo").alias("h_repo"), F.col("home").alias("h_home")).agg(F.count("*").alias("n"), count(head).alias("heads"), count(vendor & ~head).alias("apart"), count(~vendor & ~head).alias("out"))
    sums = homes.groupBy(F.col("h_repo").alias("r_repo")).agg(F.sum("n").alias("r_n"), F.sum("out").alias("r_out"))
    homes = homes.join(sums, F.col("h_repo") == F.col("r_repo")).drop("r_repo")
    # where nothing lies outside of vendor directories, lying in one sets nothing apart
    some = F.col("r_out") > 0
    part = F.when(some, F.col("out") / F.col("r_out"))
    everywhere = homes.groupBy(F.col("h_home").alias("e_home")).agg(
        F.sum(F.col("heads") * HEADER + F.when(some, F.col("apart")).otherwise(0)).alias("e_marked"), F.sum("out").alias("e_out"), F.coalesce(F.sum(part), F.lit(0.0)).alias("e_part"), F.coalesce(F.sum(1 - part), F.lit(0.0)).alias("e_rest")
    )
    homes = homes.join(everywhere, F.col("h_home") == F.col("e_home"))
    marks = _between(_odds(F.col("e_marked"), F.col("e_out")), -4.0, 4.0)
    spread = _odds(F.col("e_rest"), F.col("e_part"), 1.0)
    # few files say little by themselves: the less, the nearer are the odds to even
    here = F.when(some, _odds(F.col("out"), F.col("r_out") - F.col("out"))).otherwise(F.least(_odds(F.col("n"), F.col("r_n") - F.col("n")), F.lit(math.log(3))))
    return homes.select("h_repo", "h_home", (marks + spread - here).alias("foreign"))


def labels(files: DataFrame, contents: DataFrame, langs: tuple[str, ...] = LANGS) -> DataFrame:
    """(file_id, path, lang, label, belief) of each file in `langs`."""
    spark = files.sparkSession
    scratch = Scratch(spark, "provenance")
    texts = contents.select(F.col("file_id").cast("long").alias("file_id"), "content").where("file_id is not null and content is not null")
    seen = spread(texts).mapInPandas(_scan, "file_id long, generated double, minified double, vendored double, blob double, rows double, home string")
    seen = seen.groupBy("file_id").agg(*[F.max(c).alias(c) for c in ("generated", "minified", "vendored", "blob", "rows", "home")])
    f = files.where(F.col("lang").isin(*langs) & F.col("id").isNotNull()).groupBy(F.col("id").alias("id")).agg(F.max(F.struct("path", "lang")).alias("v")).select("id", "v.*")
    j = f.join(seen, f["id"] == seen["file_id"], "left").drop("file_id")
    name = F.coalesce("path", F.concat(F.lit("?/"), F.col("id").cast("string")))
    j = j.withColumn("dir", F.regexp_replace(name, "/?[^/]*$", "")).withColumn("repo", F.split("dir", "/")[0])
    j = scratch.cut(j)
    j = j.join(_foreign(j), (j["repo"] == F.col("h_repo")) & (j["home"] == F.col("h_home")), "left").drop("h_repo", "h_home")
    g, m, v, b = (F.coalesce(c, F.lit(0.0)) for c in ("generated", "minified", "vendored", "blob"))
    # shares weigh in smoothly around even odds; data weighs more the more lines of it there are
    rows = F.coalesce("rows", F.lit(0.0))
    minified = 14.0 * _sure(m, 0.5) - 2.0
    blob = 14.0 * _sure(b, 0.6) * rows * rows / (rows * rows + SOME_ROWS) - 2.0
    # a namespace at home speaks for the file's own authors, a foreign one for a copy, each as far as it is sure
    far = F.col("foreign")
    vendored = F.when(v > 0, 12.0).when(far.isNull(), -2.0).otherwise(_between(far * 3, -2.0, 12.0))
    evidence = [
        F.when(far.isNull(), 0.5).otherwise(_between(2.5 - far * 2, 0.5, 4.5)),
        F.when(g > 0, 12.5).otherwise(-2.0),
        minified,
        vendored,
        blob,
    ]
    node = scratch.cut(j.select("id", "path", "lang", "dir", F.array(*[e.cast("double") for e in evidence]).alias("e")))
    sums = node.select("dir", _message(F.col("e")).alias("m")).groupBy("dir").agg(_sum("m").alias("m"))
    # all directories up to the root, with what their own name says
    parts = F.split("dir", "/")
    dirs = sums.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))).alias("d")).distinct()
    own = F.lower(F.regexp_extract("d", "[^/]*$", 0))
    is_vendor, is_output = own.isin(*VENDOR_DIRS), own.isin(*OUTPUT_DIRS)
    prior = F.array(
        F.when(is_vendor | is_output, -2.0).otherwise(1.0),
        F.when(is_output, 3.0).otherwise(0.0),
        F.lit(0.0),
        F.when(is_vendor, 4.0).otherwise(0.0),
        F.lit(0.0),
    )
    base = dirs.join(sums, dirs["d"] == sums["dir"], "left").select("d", F.size(F.split("d", "/")).alias("depth"), F.regexp_replace("d", "/?[^/]*$", "").alias("parent"), _plus(prior, F.col("m")).alias("s"))
    base = scratch.cut(base)
    deepest = base.agg(F.max("depth")).first()[0] or 0
    # up: each level adds what the deeper one tells it
    level: dict[int, DataFrame] = {}
    for depth in range(deepest, 0, -1):
        here = base.where(F.col("depth") == depth)
        if depth + 1 in level:
            told = level[depth + 1].select("parent", _message(F.col("s")).alias("t")).groupBy(F.col("parent").alias("t_d")).agg(_sum("t").alias("t"))
            here = here.join(told, here["d"] == told["t_d"], "left").select("d", "depth", "parent", _plus(F.col("s"), F.col("t")).alias("s"))
        level[depth] = scratch.cut(here) if depth % 4 == 0 else here
    if not level:
        return node.select(F.col("id").alias("file_id"), "path", "lang", F.lit(LABELS[0]).alias("label"), F.lit(1.0).alias("belief")).where("false")
    gathered = level[deepest]
    for depth in range(deepest - 1, 0, -1):
        gathered = gathered.unionByName(level[depth])
    gathered = scratch.cut(gathered)
    # down: a directory hears its parent's belief without its own part in it
    belief: dict[int, DataFrame] = {1: gathered.where("depth = 1").select("d", "s")}
    for depth in range(2, deepest + 1):
        here = gathered.where(F.col("depth") == depth)
        above = belief[depth - 1].select(F.col("d").alias("a_d"), F.col("s").alias("a"))
        joined = here.join(above, here["parent"] == above["a_d"]).select("d", "s", _minus(F.col("a"), _message(F.col("s"))).alias("c"))
        joined = joined.select("d", _plus(F.col("s"), _message(F.col("c"))).alias("s"))
        belief[depth] = scratch.cut(joined) if depth % 4 == 0 else joined
    last = belief[1]
    for depth in range(2, deepest + 1):
        last = last.unionByName(belief[depth])
    last = scratch.cut(last)
    home = last.select(F.col("d").alias("h_d"), F.col("s").alias("h"))
    final = node.join(home, node["dir"] == home["h_d"]).select("id", "path", "lang", "e", _minus(F.col("h"), _message(F.col("e"))).alias("c"))
    final = final.select("id", "path", "lang", _plus(F.col("e"), _message(F.col("c"))).alias("b"))
    top = F.array_max("b")
    weight = F.aggregate("b", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.array_position("b", top).cast("int"))
    return final.select(F.col("id").alias("file_id"), "path", "lang", label.alias("label"), (1 / weight).alias("belief"))
