"""Full-text search: conjunctive candidates ranked by BM25, lines graded, regular expressions, references."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.functions.text import fold, fold_text, path_filter, query_tokens, snippet, token_regex, utf8_prefix, whole_token
from codeloom.operators.store import lines_of
from codeloom.sources.tables import Scratch

K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{Nd}_]+"


def bm25(hits: DataFrame, lengths: DataFrame, corpus: DataFrame, query: list[str]) -> DataFrame:
    """(file_id, score) of the files that hold all query tokens; greater is better.

    `hits`: the postings of the query's tokens. Lengths and their mean are of the
    whole corpus and kept; only the query's postings meet them.
    """
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    # both are one row, or one row a query token: their size is bounded by the query
    scored = hits.join(F.broadcast(df), "token").join(lengths, "file_id").crossJoin(F.broadcast(corpus))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("file_id").agg(F.sum(idf * tf).alias("score"), F.count("*").alias("n")).where(F.col("n") == len(query)).drop("n")


def texts_holding(contents: DataFrame, query: list[str]) -> DataFrame:
    """The texts that hold all tokens, by one scan and no shuffle: a substring test, which is cheap, before the test of tokens."""
    c = contents.where("content is not null")
    for t in query:
        # `lower` is fast and folds more than ASCII, so it lets through all that the exact test may take
        c = c.where(F.lower("content").contains(t))
    for t in query:
        c = c.where(whole_token(F.col("content"), t))
    return c


def scan_holding(contents: DataFrame, query: list[str]) -> DataFrame:
    """(file_id) of the files that hold all tokens."""
    return texts_holding(contents, query).select("file_id").distinct()


def scan_bm25(contents: DataFrame, query: list[str], scratch: Scratch) -> DataFrame:
    """As `bm25`, from the texts: one scan leaves a row of a few numbers a file, and nothing is shuffled but one-row aggregates."""
    length = F.regexp_count("content", F.lit(TOKEN))
    counts = contents.where("content is not null").select("file_id", length.alias("dl"), *[F.regexp_count("content", F.lit(token_regex(q))).alias(f"tf{k}") for k, q in enumerate(query)])
    counts = scratch.cut(counts.where("dl > 0").distinct())
    corpus = counts.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(query))])
    held = counts
    score = F.lit(0.0)
    for k in range(len(query)):
        held = held.where(F.col(f"tf{k}") > 0)
        idf = F.log((F.col("n_docs") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5) + 1)
        score = score + idf * F.col(f"tf{k}") * (K1 + 1) / (F.col(f"tf{k}") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return held.crossJoin(F.broadcast(corpus)).select("file_id", score.alias("score"))


def holding_all(postings: DataFrame, query: list[str]) -> DataFrame:
    """(file_id) of the files that hold all tokens."""
    return postings.where(F.col("token").isin(*query)).groupBy("file_id").agg(F.count("*").alias("n")).where(F.col("n") == len(query)).select("file_id")


def graded(lines: DataFrame, query: str) -> DataFrame:
    """(file_id, line_no, line, tier) of the lines of candidate files.

    A precise line holds every token whole; among several tokens, lines with the
    raw phrase come first (tier 0), other precise ones next (1). A file without a
    precise line offers partial ones (2): for each token the first line that
    holds it, unless an earlier of these lines already covers the token.
    """
    ts = query_tokens(query)
    holds = [whole_token(F.col("line"), t) for t in ts]
    l = lines.select("file_id", "line_no", "line", F.array(*holds).alias("holds"))
    every = F.forall("holds", lambda x: x)
    l = l.where(F.exists("holds", lambda x: x)).distinct().withColumn("precise", every)
    phrase = fold(F.col("line")).contains(fold_text(query)) if len(ts) > 1 else F.lit(False)
    file_ = Window.partitionBy("file_id")
    l = l.withColumn("any_precise", F.max("precise").over(file_))
    if len(ts) == 1:
        return l.where("precise").select("file_id", "line_no", "line", F.lit(1).alias("tier"))
    precise = l.where("precise").select("file_id", "line_no", "line", F.when(phrase, 0).otherwise(1).alias("tier"))
    # greedy cover in token order: the first line of token k counts if no line taken for an earlier token holds it
    rest = l.where("not any_precise")
    firsts = rest.groupBy("file_id").agg(*[F.min(F.when(F.col("holds")[k], F.struct("line_no", "holds", "line"))).alias(f"t{k}") for k in range(len(ts))])
    taken: list[Column] = []
    for k in range(len(ts)):
        covered = F.lit(False)
        for e in range(k):
            covered = covered | (taken[e] & F.coalesce(F.col(f"t{e}.holds")[k], F.lit(False)))
        taken.append(F.col(f"t{k}").isNotNull() & ~covered)
    picks = F.array(*[F.when(taken[k], F.col(f"t{k}")) for k in range(len(ts))])
    partial = firsts.select("file_id", F.explode(F.array_distinct(F.filter(picks, lambda x: x.isNotNull()))).alias("p")).select("file_id", "p.line_no", "p.line", F.lit(2).alias("tier"))
    return precise.unionByName(partial)


def text_page(store, query: str, limit: int, offset: int = 0, path: str | None = None, excludes: tuple[str, ...] = (), langs: tuple[str, ...] | None = None, max_files: int = 200, partials: str = "auto", before: int = 0, after: int = 0, side_bytes: int = 4096) -> DataFrame:
    """One page of graded lines: filter, cap, grade, order, page; with the totals that go with it on each row.

    Candidates hold all tokens and pass the filters; the best `max_files` of them
    are read (hand-written first, then by BM25, then by id), and `more_files`
    tells of others. Precise lines come first, in order of their files, lines
    with the raw phrase before other ones; partial lines follow, `never`,
    `always`, or, with `auto`, where the precise ones do not fill the page. The
    context on either side is cut at `side_bytes` of UTF-8.
    """
    ts = query_tokens(query)
    f = store.files
    if langs:
        f = f.where(F.col("lang").isin(*langs))
    f = f.where(path_filter(F.col("path"), path, excludes)).select(F.col("id").alias("f_id"), "is_generated")
    scored = bm25(store.postings_of(ts), store.lengths, store.corpus, ts)
    order = ["is_generated", F.desc(F.round("score", 6)), "file_id"]
    top = scored.join(f, F.col("file_id") == F.col("f_id")).orderBy(*order).limit(max_files + 1)
    # at most max_files + 1 rows: one task numbers them
    top = Scratch(store.spark, "page").cut(top.select("file_id", F.row_number().over(Window.orderBy(*order)).alias("file_rank")))
    scanned = top.where(F.col("file_rank") <= max_files)
    lines = lines_of(store.contents_of(scanned))
    g = graded(lines, query).join(scanned, "file_id")
    partial = F.col("tier") == 2
    totals = g.agg(F.count_if(~partial).alias("total_precise"), F.count_if(partial).alias("total_partial"), F.count_distinct("file_id").alias("files"))
    files = top.agg(F.least(F.count("*"), F.lit(max_files)).alias("scanned"), (F.count("*") > max_files).alias("more_files"))
    g = g.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(files))
    wanted = {"never": ~partial, "always": F.lit(True), "auto": ~partial | (F.col("total_precise") < offset + limit)}[partials]
    place = [partial, F.col("file_rank"), F.col("tier"), F.col("line_no")]
    page = g.where(wanted).orderBy(*place).offset(offset).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*place)) + offset)
    if before or after:
        near = context_lines(lines, page, before, after).select("file_id", "line_no", "before", "after")
        side = lambda c: utf8_prefix(F.array_join(c, "\n"), side_bytes).alias(c)
        page = page.join(near.select("file_id", "line_no", side("before"), side("after")), ["file_id", "line_no"])
    return page


def reference_page(store, name: str, samples: int = 3, max_files: int = 500, exclude: DataFrame | None = None) -> DataFrame:
    """References to a name by project, with samples, and the totals of the whole on each row.

    Files without a project form a group of their own (null). A file that several
    projects compile counts in each, so the attributed hits may exceed the
    physical ones. At most `max_files` candidate files are read, hand-written
    first, then by id; if there are more, `lower_bound` says that all counts are
    at least what they are. `exclude`: (file_id, line_no) of lines that do not count.
    """
    ts = query_tokens(name)
    hits = store.postings_of(ts).groupBy("file_id").agg(F.count("*").alias("n")).where(F.col("n") == len(ts)).select("file_id")
    f = store.files.select(F.col("id").alias("f_id"), "is_generated", F.coalesce("has_test_attrs", F.lit(False)).alias("test"))
    top = Scratch(store.spark, "references").cut(hits.join(f, F.col("file_id") == F.col("f_id")).orderBy("is_generated", "file_id").limit(max_files + 1).withColumn("nth", F.row_number().over(Window.orderBy("is_generated", "file_id"))))
    some = top.where(F.col("nth") <= max_files)
    found = references(lines_of(store.contents_of(some)), store.owners, name).join(some.select("file_id", "test"), "file_id")
    if exclude is not None:
        found = found.join(exclude.select("file_id", "line_no").distinct(), ["file_id", "line_no"], "left_anti")
    sites = found.select("file_id", "line_no", "test").distinct()
    totals = sites.agg(F.count("*").alias("physical"), F.count_if("test").alias("physical_test"), F.count_if(~F.col("test")).alias("physical_production")).crossJoin(top.agg((F.count("*") > max_files).alias("lower_bound")))
    counts = found.groupBy("project_id").agg(F.count_distinct("file_id").alias("files"), F.count_if("test").alias("test_hits"))
    g = grouped_samples(found, "project_id", samples)
    j = g.join(counts.withColumnRenamed("project_id", "c_id"), F.col("project_id").eqNullSafe(F.col("c_id"))).drop("c_id")
    return j.crossJoin(F.broadcast(totals))


def token_spans(lines: DataFrame, name: str) -> DataFrame:
    """(file_id, line_no, start, length): of each line its first whole, case-sensitive occurrence of a name, counted from 1."""
    whole = r"(?<![\p{L}\p{Nd}_])" + re.escape(name) + r"(?![\p{L}\p{Nd}_])"
    return lines.where(F.col("line").contains(name)).select("file_id", "line_no", F.regexp_instr("line", F.lit(whole)).alias("start"), F.lit(len(name)).alias("length")).where("start > 0").distinct()


def regex_lines(lines: DataFrame, pattern: str) -> DataFrame:
    """Distinct lines that a regular expression matches, case-sensitively."""
    return lines.where(F.col("line").rlike(pattern)).distinct()


def references(lines: DataFrame, owners: DataFrame, name: str) -> DataFrame:
    """(file_id, line_no, line, project_id) of lines with a whole, case-sensitive occurrence of a name; files without a project keep a null."""
    whole = r"(?<![\p{L}\p{Nd}_])" + re.escape(name) + r"(?![\p{L}\p{Nd}_])"
    hits = lines.where(F.col("line").contains(name)).where(F.col("line").rlike(whole)).distinct()
    return hits.join(owners, "file_id", "left")


def usage_tier(line: Column, name: str) -> Column:
    """3 a call, 2 a use as a type, 1 a mention."""
    n = re.escape(name)
    return F.when(line.rlike(rf"(?<![\p{{L}}\p{{Nd}}_]){n}\("), 3).when(line.rlike(rf"(?<![\p{{L}}\p{{Nd}}_]){n}[<.]|[:<.]{n}(?![\p{{L}}\p{{Nd}}_])|new {n}(?![\p{{L}}\p{{Nd}}_])"), 2).otherwise(1)


def grouped_samples(hits: DataFrame, group: str, k: int) -> DataFrame:
    """(group, hits, samples): counts, and the first `k` hits of each group in order of file and line.

    Counts combine map-side; ranks are cut at `k` before they are shuffled, so a
    group of any size brings `k` rows from each partition and no more.
    """
    w = Window.partitionBy(group).orderBy("file_id", "line_no")
    first = hits.select(group, "file_id", "line_no").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    samples = first.groupBy(F.col(group).alias("s_group")).agg(F.array_sort(F.collect_list(F.struct("file_id", "line_no"))).alias("samples"))
    counts = hits.groupBy(group).agg(F.count("*").alias("hits"))
    return counts.join(samples, counts[group].eqNullSafe(samples["s_group"])).select(group, "hits", "samples")


def context_lines(lines: DataFrame, hits: DataFrame, before: int, after: int) -> DataFrame:
    """Hits with the lines around them, as two arrays; only files with hits are windowed."""
    w = Window.partitionBy("file_id").orderBy("line_no")
    near = lines.join(hits.select("file_id").distinct(), "file_id", "left_semi").distinct().select(
        "file_id", "line_no", "line",
        F.collect_list("line").over(w.rowsBetween(-before, -1)).alias("before"),
        F.collect_list("line").over(w.rowsBetween(1, after)).alias("after"),
    )
    return near.join(hits.select("file_id", "line_no").distinct(), ["file_id", "line_no"])


def near_misses(symbols: DataFrame, name: str) -> DataFrame:
    """(name, n) of symbol names at Damerau distance one: same first letter folded, a length off by one at most."""
    f = fold(F.col("name"))
    q = fold_text(name)
    swaps = sorted({q[:k] + q[k + 1] + q[k] + q[k + 2 :] for k in range(len(q) - 1)} - {q})
    close = (F.levenshtein(f, F.lit(q)) == 1) | f.isin(*swaps)
    return symbols.where(F.length("name").between(max(4, len(q) - 1), min(128, len(q) + 1)) & f.startswith(q[:1]) & close).groupBy("name").agg(F.count("*").alias("n"))


def path_suggestions(files: DataFrame, wanted: str, k: int) -> DataFrame:
    """The `k` stored paths most like a path that does not exist: longest common suffix and prefix of segments, nearest depth, length."""
    want = [fold_text(x) for x in wanted.split("/")]
    w = F.array(*[F.lit(x) for x in want])
    s = F.split(fold("path"), "/")

    def common(a: Column, b: Column) -> Column:
        n = F.least(F.size(a), F.size(b))
        same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y)
        first = F.array_position(F.transform(same, lambda x: x.cast("int")), 0)
        return F.when(first == 0, n).otherwise(first.cast("int") - 1)

    return files.select("path", common(F.reverse(s), F.reverse(w)).alias("suffix"), common(s, w).alias("prefix"), F.abs(F.size(s) - len(want)).alias("off")).orderBy(F.desc("suffix"), F.desc("prefix"), "off", F.length("path"), "path").limit(k)


__all__ = ["bm25", "context_lines", "graded", "grouped_samples", "holding_all", "near_misses", "path_suggestions", "references", "regex_lines", "scan_bm25", "scan_holding", "snippet", "texts_holding", "usage_tier"]
