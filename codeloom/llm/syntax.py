"""Source files that do not parse, per file and as rates per repository and language.

Each text is ranked against all supported grammars by its tokens and parsed by
every one of them in that order, so a text that only foreign grammars read has a
wrong extension, the best-ranked of them being what it is, and one that none
reads is corrupt. The contents are not shuffled: verdicts of a few bytes meet
the files' languages.

Defined results: a file without content, or with null content, has no verdict;
repeated rows count once; of several different contents of a file each must
parse; empty texts are valid C#, F# and SQL but neither XML nor JSON; languages
without a grammar (Markdown, solutions, null) are never cases; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from codeloom.llm import grammar_cs, grammar_other
from codeloom.llm.rows import spread

GRAMMARS = {
    "cs": grammar_cs.parses,
    "fs": grammar_other.fs_parses,
    "sql": grammar_other.sql_parses,
    "xml": grammar_other.xml_parses,
    "json": grammar_other.json_parses,
}
BITS = {g: 1 << i for i, g in enumerate(GRAMMARS)}
_SIGNS = {
    "cs": (";\n", ";\r\n", "namespace ", "using ", "{\n", "public ", "();"),
    "fs": ("let ", "module ", "open ", " |> ", "    | ", " = function", "type "),
    "sql": ("CREATE ", "INSERT ", "SELECT ", "create ", "insert ", "NOT NULL", "dbo."),
    "xml": ("</", "/>", "<?xml"),
    "json": ('": ', '",\n', '":'),
}


def ranked(s: str) -> list[str]:
    """Grammars by how many of their tokens the whole text has; what opens the text outweighs the rest."""
    score = {g: sum(map(s.count, signs)) for g, signs in _SIGNS.items()}
    first = s.lstrip("﻿ \t\r\n")[:1]
    if first == "<":
        score["xml"] += 1 << 30
    elif first in "{[" and first and '"' in s:
        score["json"] += score["json"] * 3
    return sorted(GRAMMARS, key=lambda g: (-score[g], list(GRAMMARS).index(g)))


def reads(s: str) -> tuple[int, str | None]:
    """(grammars that read the text as bits, the best-ranked of them); every grammar is tried."""
    good = [g for g in ranked(s) if GRAMMARS[g](s)]
    return sum(BITS[g] for g in good), good[0] if good else None


def own_grammar(lang: Column, path: Column) -> Column:
    """The grammar a file has to follow; null if there is none for it."""
    return (
        F.when(lang.isin("cs", "fs", "sql"), lang)
        .when(lang.isin("csproj", "fsproj"), "xml")
        .when((lang == "config") & F.lower(path).endswith(".json"), "json")
        .when(lang == "config", "xml")
    )


def _bit(grammar: Column) -> Column:
    out = F.lit(0)
    for g, b in BITS.items():
        out = F.when(grammar == g, b).otherwise(out)
    return out


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([(i, *reads(s)) for i, s in zip(b["file_id"], b["content"])], columns=["file_id", "good", "reads_as"])


def verdicts(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(file_id, lang, repo, grammar, verdict, reads_as) of each file with content and a grammar: 'ok', 'wrong extension' or 'corrupt'; of a wrong extension what the text reads as."""
    texts = contents.select(F.col("file_id").cast("long").alias("file_id"), "content").where("file_id is not null and content is not null")
    seen = spread(texts).mapInPandas(_scan, "file_id long, good int, reads_as string").distinct()
    f = (
        files.where("id is not null")
        .groupBy(F.col("id").alias("id"))
        .agg(F.max(F.struct("lang", "path")).alias("v"))
        .select("id", F.col("v.lang").alias("lang"), F.split(F.col("v.path"), "/")[0].alias("repo"), own_grammar(F.col("v.lang"), F.col("v.path")).alias("grammar"))
        .where("grammar is not null")
    )
    j = seen.join(f, seen["file_id"] == f["id"]).withColumn("bit", _bit(F.col("grammar")))
    # the worst verdict of a file's contents counts
    rank = F.when(F.col("good").bitwiseAND(F.col("bit")) != 0, 0).when(F.col("good") != 0, 1).otherwise(2)
    worst = j.groupBy("file_id", "lang", "repo", "grammar").agg(F.max(F.struct(rank.alias("rank"), "reads_as")).alias("v"))
    verdict = F.when(F.col("v.rank") == 2, "corrupt").when(F.col("v.rank") == 1, "wrong extension").otherwise("ok")
    return worst.select("file_id", "lang", "repo", "grammar", verdict.alias("verdict"), F.when(F.col("v.rank") == 1, F.col("v.reads_as")).alias("reads_as"))


def rates(verdict: DataFrame) -> DataFrame:
    """Files, failures and their rate per repository and language."""
    bad = F.col("verdict") != "ok"
    return verdict.groupBy("repo", "lang").agg(
        F.count("*").alias("files"),
        F.count_if(bad).alias("failed"),
        F.count_if(F.col("verdict") == "wrong extension").alias("wrong_extension"),
        (F.count_if(bad) / F.count("*")).alias("rate"),
    )
