"""Queries over search pages, references, outlines, declarations, project files and telemetry records, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codeloom.functions import text as X
from codeloom.operators import events as E, graph, search, symbols as S
from codeloom.operators.store import CONFIG_NAMES, TYPE_KINDS, Store, lines_of
from codeloom.plans.navigation import C, EDGE, L, NAME, OWN, POST, PROJ, SY, _has, _list
from codeloom.sources import workspace
from codeloom.sources.tables import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[Store], DataFrame]):
        QUERIES[name or f.__name__] = lambda spark, d: f(Store(spark, d))
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# --------------------------------------------------------------- graded search


def _page_sql(a: str, b: str, where: str, cap: int, limit: int, offset: int, partials: str) -> str:
    """The search page of two tokens in SQL."""
    keep = {"never": "tier < 2", "always": "true", "auto": f"(tier < 2 OR total_precise < {offset + limit})"}[partials]
    return f"""WITH {POST}, {L[len(C) + 2 :]}, q AS (SELECT * FROM po WHERE token IN ('{a}', '{b}')), dl AS (SELECT file_id, sum(tf) AS dl FROM po GROUP BY 1), k AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl), df AS (SELECT token, count(*) AS df FROM q GROUP BY 1),
 bm AS (SELECT q.file_id, sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN df USING (token) JOIN dl ON dl.file_id = q.file_id, k GROUP BY q.file_id HAVING count(*) = 2),
 ranked AS (SELECT file_id, row_number() OVER (ORDER BY is_generated, round(score, 6) DESC, file_id) AS file_rank FROM bm JOIN files f ON f.id = bm.file_id WHERE {where}),
 g AS (SELECT l.file_id, file_rank, line_no, line, {_has(a)} AS h0, {_has(b)} AS h1 FROM l JOIN ranked USING (file_id) WHERE file_rank <= {cap}),
 x AS (SELECT *, bool_or(h0 AND h1) OVER (PARTITION BY file_id) AS any_precise FROM g WHERE h0 OR h1),
 t AS (SELECT file_id, file_rank, min(line_no) FILTER (h0) AS l0, arg_min(h1, line_no) FILTER (h0) AS c1, min(line_no) FILTER (h1) AS l1 FROM x WHERE NOT any_precise GROUP BY 1, 2),
 hits AS (SELECT file_id, file_rank, line_no, CASE WHEN contains(lower(line), '{a} {b}') THEN 0 ELSE 1 END AS tier FROM x WHERE h0 AND h1
   UNION ALL SELECT file_id, file_rank, l0, 2 FROM t WHERE l0 IS NOT NULL UNION ALL SELECT file_id, file_rank, l1, 2 FROM t WHERE l1 IS NOT NULL AND NOT coalesce(c1, false)),
 tot AS (SELECT count_if(tier < 2) AS total_precise, count_if(tier = 2) AS total_partial, count(DISTINCT file_id) AS files FROM hits),
 sc AS (SELECT least(count(*), {cap}) AS scanned, count(*) > {cap} AS more_files FROM ranked)
SELECT row_number() OVER (ORDER BY tier = 2, file_rank, tier, line_no) AS place, file_id, line_no, tier, total_precise, total_partial, files, scanned, more_files FROM hits, tot, sc WHERE {keep} QUALIFY place BETWEEN {offset + 1} AND {offset + limit}"""


_CS = "f.lang = 'cs' AND NOT (lower(path) LIKE '%/third\\_party/%' ESCAPE '\\' OR lower(path) LIKE 'third\\_party/%' ESCAPE '\\')"
_COLUMNS = ("place", "file_id", "line_no", "tier", "total_precise", "total_partial", "files", "scanned", "more_files")


def _page(s: Store, partials: str, limit: int, offset: int, cap: int) -> DataFrame:
    return search.text_page(s, "quota ledger", limit, offset, excludes=("**/third_party/*",), langs=("cs",), max_files=cap, partials=partials).select(*_COLUMNS)


@query(_page_sql("quota", "ledger", _CS, 25, 20, 0, "auto"))
def x5_search_page(s: Store) -> DataFrame:
    """The first page of a graded search in 25 files at most; partial lines where precise ones do not fill it."""
    return _page(s, "auto", 20, 0, 25)


@query(_page_sql("quota", "ledger", _CS, 200, 15, 0, "never"))
def x7_partials_never(s: Store) -> DataFrame:
    """A page of precise lines only."""
    return _page(s, "never", 15, 0, 200)


@query(_page_sql("quota", "ledger", _CS, 200, 30, 5, "always"))
def x7_partials_always(s: Store) -> DataFrame:
    return _page(s, "always", 30, 5, 200)


@query(_page_sql("limit", "key", "f.lang = 'config'", 200, 50, 0, "auto"))
def x20_config_page(s: Store) -> DataFrame:
    """The graded search over configuration files only."""
    return search.text_page(s, "limit key", 50, langs=("config",)).select(*_COLUMNS)


@query(
    f"""WITH {L}, h AS (SELECT DISTINCT file_id, line_no FROM l WHERE contains(line, 'await Task.Yield')),
 x AS (SELECT file_id, line_no, list(line) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a FROM l),
 b AS (SELECT x.file_id, x.line_no, coalesce(array_to_string(a, chr(10)), '') AS t FROM x JOIN h USING (file_id, line_no))
SELECT file_id, line_no, CASE WHEN strlen(t) <= 60 THEN t ELSE substr(t, 1, list_max(list_filter(range(0, 61), lambda k: strlen(substr(t, 1, k)) <= 60))) END AS before FROM b"""
)
def w5_bounded_context(s: Store) -> DataFrame:
    """Lines before a hit, cut at a budget of bytes without splitting a character."""
    lines = s.lines_with("await Task.Yield")
    near = search.context_lines(lines, lines.where(F.col("line").contains("await Task.Yield")), 3, 0)
    return near.select("file_id", "line_no", X.utf8_prefix(F.array_join("before", "\n"), 60).alias("before"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 100 THEN text ELSE substr(text, 1, list_max(list_filter(range(0, 101), lambda k: strlen(substr(text, 1, k)) <= 100))) END AS head FROM documents WHERE text IS NOT NULL")
def f16_utf8_prefix(s: Store) -> DataFrame:
    """The first 100 bytes of each document, whole characters only."""
    return s.raw("documents").where("text is not null").select("doc_id", X.utf8_prefix(F.col("text"), 100).alias("head"))


@query(f"WITH {SY}, n AS (SELECT DISTINCT name FROM s WHERE name IS NOT NULL AND NOT regexp_matches(name, '\\s')), v AS (SELECT name, regexp_replace(regexp_replace(name, '([a-z])([A-Z0-9])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g') AS variant FROM n) SELECT name, variant FROM v WHERE variant <> name")
def x15_split_variants(s: Store) -> DataFrame:
    """Names that read as several words, with those words apart."""
    return s.symbols.where("name is not null").select("name").distinct().withColumn("variant", X.split_variant_column("name")).where("variant is not null")


# ------------------------------------------------------------------ references


_WHOLE = f"(^|[^\\pL\\p{{Nd}}_]){NAME}([^\\pL\\p{{Nd}}_]|$)"


@query(
    f"""WITH {PROJ}, {OWN}, {L}, hit AS (SELECT DISTINCT file_id FROM l WHERE {_has(NAME.lower())}), top AS (SELECT file_id, coalesce(has_test_attrs, false) AS test, row_number() OVER (ORDER BY is_generated, file_id) AS nth FROM hit JOIN files f ON f.id = hit.file_id),
 rf AS (SELECT DISTINCT l.file_id, line_no, project_id, test FROM l JOIN top ON top.file_id = l.file_id AND nth <= 40 LEFT JOIN own ON own.file_id = l.file_id WHERE regexp_matches(line, '{_WHOLE}')),
 r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY file_id, line_no) AS rn FROM rf),
 p1 AS (SELECT count(*) AS physical, count_if(test) AS physical_test, count_if(NOT test) AS physical_production FROM (SELECT DISTINCT file_id, line_no, test FROM rf)), cp AS (SELECT count(*) > 40 AS lower_bound FROM top)
SELECT project_id, count(*) AS hits, count(DISTINCT file_id) AS files, count_if(test) AS test_hits, string_agg(file_id || ':' || line_no, ',' ORDER BY file_id, line_no) FILTER (rn <= 3) AS samples, any_value(physical) AS physical, any_value(physical_test) AS physical_test, any_value(physical_production) AS physical_production, any_value(lower_bound) AS lower_bound
FROM r, p1, cp GROUP BY 1"""
)
def x11_reference_page(s: Store) -> DataFrame:
    """References by project from 40 candidate files at most, with samples, physical totals and whether they are lower bounds."""
    g = search.reference_page(s, NAME, 3, 40)
    return g.withColumn("samples", F.array_join(F.transform("samples", lambda x: F.concat_ws(":", x["file_id"], x["line_no"])), ","))


@query(
    f"""WITH {PROJ}, {OWN}, {L}, rf AS (SELECT l.file_id, line_no, project_id, coalesce(has_test_attrs, false) AS test FROM l JOIN files f ON f.id = l.file_id LEFT JOIN own ON own.file_id = l.file_id WHERE regexp_matches(line, '{_WHOLE}')), d AS (SELECT DISTINCT file_id, line_no, test FROM rf)
SELECT (SELECT count(*) FROM d) AS physical, (SELECT count_if(NOT test) FROM d) AS production, (SELECT count_if(test) FROM d) AS tests, (SELECT count(project_id) FROM rf) AS attributed, (SELECT count(*) FROM rf WHERE project_id IS NULL) AS unowned"""
)
def a5_reference_totals(s: Store) -> DataFrame:
    """Both grains of the reference counts: places in files, and what projects are credited with."""
    f = s.files.select(F.col("id").alias("f_id"), F.coalesce("has_test_attrs", F.lit(False)).alias("test"))
    rf = search.references(s.lines_with(NAME), s.owners, NAME).join(f, F.col("file_id") == F.col("f_id"))
    places = rf.select("file_id", "line_no", "test").distinct().agg(F.count("*").alias("physical"), F.count_if(~F.col("test")).alias("production"), F.count_if("test").alias("tests"))
    return places.crossJoin(rf.agg(F.count("project_id").alias("attributed"), F.count_if(F.col("project_id").isNull()).alias("unowned")))


@query(f"WITH {L} SELECT file_id, line_no, length(regexp_extract(line, '^(.*?(?:^|[^\\pL\\p{{Nd}}_])){NAME}(?:[^\\pL\\p{{Nd}}_]|$)', 1)) + 1 AS start, {len(NAME)} AS length FROM l WHERE regexp_matches(line, '{_WHOLE}')")
def x12_token_spans(s: Store) -> DataFrame:
    """Where a name first stands on each line that holds it."""
    return search.token_spans(s.lines_with(NAME), NAME)


@query(
    f"""WITH {PROJ}, {OWN}, {L}, sp AS (SELECT DISTINCT project_id, l.file_id, line_no, CASE WHEN regexp_matches(line, '(^|[^\\pL\\p{{Nd}}_]){NAME}\\(') THEN 'call' WHEN regexp_matches(line, 'new {NAME}([^\\pL\\p{{Nd}}_]|$)') THEN 'creation' WHEN regexp_matches(line, '(^|[^\\pL\\p{{Nd}}_]){NAME}[<.]') THEN 'qualifier' WHEN regexp_matches(line, '[:<]{NAME}([^\\pL\\p{{Nd}}_]|$)') THEN 'type' ELSE 'mention' END AS usage
 FROM l LEFT JOIN own ON own.file_id = l.file_id WHERE regexp_matches(line, '{_WHOLE}')) SELECT project_id, usage, count(*) AS sites FROM sp GROUP BY 1, 2"""
)
def a7_usage_kinds(s: Store) -> DataFrame:
    """Distinct sites by project and kind of use, told by what stands around the name."""
    n = NAME
    line = F.col("line")
    left, right = r"(?<![\p{L}\p{Nd}_])", r"(?![\p{L}\p{Nd}_])"
    usage = F.when(line.rlike(rf"{left}{n}\("), "call").when(line.rlike(rf"new {n}{right}"), "creation").when(line.rlike(rf"{left}{n}[<.]"), "qualifier").when(line.rlike(rf"[:<]{n}{right}"), "type").otherwise("mention")
    rf = search.references(s.lines_with(n), s.owners, n)
    return rf.select("project_id", "file_id", "line_no", usage.alias("usage")).distinct().groupBy("project_id", "usage").agg(F.count("*").alias("sites"))


# -------------------------------------------------------------------- symbols


@query(f"WITH {SY} SELECT s.id AS symbol_id, name, kind FROM s JOIN files f ON f.id = s.file_id WHERE (lower(ns) = 'tarn.cargo' OR starts_with(lower(ns), 'tarn.cargo.')) AND kind IN {_list(TYPE_KINDS)} ORDER BY is_generated, name, path, s.id LIMIT 41")
def y3_enumerated(s: Store) -> DataFrame:
    """Everything in a scope without a name to look for: a page of 40 and one row that tells of more."""
    f = s.files.select(F.col("id").alias("f_id"), "path", "is_generated")
    t = s.symbols.where(S.namespace_subtree(F.col("ns"), "Tarn.Cargo") & F.col("kind").isin(*TYPE_KINDS)).join(f, F.col("file_id") == F.col("f_id"))
    return t.orderBy("is_generated", "name", "path", "id").limit(41).select(F.col("id").alias("symbol_id"), "name", "kind")


_UP = "e AS (SELECT s.id, q.id AS par FROM s JOIN s q ON s.parent_id = q.id AND s.file_id = q.file_id), r AS (SELECT id AS symbol_id, par AS ancestor_id, 1 AS hops FROM e UNION ALL SELECT r.symbol_id, e.par, hops + 1 FROM r JOIN e ON r.ancestor_id = e.id WHERE hops < 16)"


def _within_file(s: Store) -> DataFrame:
    """Symbols whose parent is kept only if it lies in the same file."""
    p = s.symbols.select(F.col("id").alias("p_id"), F.col("file_id").alias("p_file"))
    j = s.symbols.join(p, (F.col("parent_id") == F.col("p_id")) & (F.col("file_id") == F.col("p_file")), "left")
    return j.withColumn("parent_id", F.col("p_id")).drop("p_id", "p_file")


@query(
    f"""WITH RECURSIVE {SY}, {_UP}, d AS (SELECT symbol_id, max(hops) AS depth FROM r GROUP BY 1), k AS (SELECT par, count(*) AS children FROM e GROUP BY 1), b AS (SELECT file_id, sum(strlen(coalesce(signature, '')) + 1)::BIGINT AS bytes, sum(CASE WHEN kind IN {_list(TYPE_KINDS)} THEN strlen(coalesce(signature, '')) + 1 ELSE 0 END)::BIGINT AS type_bytes FROM s GROUP BY 1)
SELECT s.file_id, s.id AS symbol_id, coalesce(depth, 0)::INT AS depth, coalesce(children, 0) AS children, CASE WHEN bytes <= 400 THEN 'nested' WHEN type_bytes <= 400 THEN 'types' ELSE 'flat' END AS mode
FROM s JOIN b USING (file_id) LEFT JOIN d ON d.symbol_id = s.id LEFT JOIN k ON k.par = s.id WHERE bytes <= 400 AND coalesce(depth, 0) <= 2 OR bytes > 400 AND (type_bytes > 400 OR kind IN {_list(TYPE_KINDS)})"""
)
def y5_outline_tree(s: Store) -> DataFrame:
    """The outline of each file as a tree down to two levels; where its signatures exceed the budget its types only, and flat where these do, too."""
    t = Scratch(s.spark, "outline").cut(_within_file(s).select("id", "file_id", "parent_id", "kind", "signature"))
    depth = S.ancestors(t, Scratch(s.spark, "outline")).groupBy(F.col("symbol_id").alias("d_id")).agg(F.max("hops").alias("depth"))
    kids = t.where("parent_id is not null").groupBy(F.col("parent_id").alias("k_id")).agg(F.count("*").alias("children"))
    size = F.octet_length(F.coalesce("signature", F.lit(""))) + 1
    is_type = F.col("kind").isin(*TYPE_KINDS)
    bytes_ = t.groupBy(F.col("file_id").alias("b_file")).agg(F.sum(size).alias("bytes"), F.sum(F.when(is_type, size).otherwise(0)).alias("type_bytes"))
    j = t.join(bytes_, F.col("file_id") == F.col("b_file")).join(depth, F.col("id") == F.col("d_id"), "left").join(kids, F.col("id") == F.col("k_id"), "left")
    mode = F.when(F.col("bytes") <= 400, "nested").when(F.col("type_bytes") <= 400, "types").otherwise("flat")
    j = j.select("file_id", F.col("id").alias("symbol_id"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("children", F.lit(0)).alias("children"), mode.alias("mode"), is_type.alias("is_type"))
    return j.where(((F.col("mode") == "nested") & (F.col("depth") <= 2)) | ((F.col("mode") == "types") & F.col("is_type")) | (F.col("mode") == "flat")).drop("is_type")


@query(f"WITH RECURSIVE {SY}, {_UP}, p AS (SELECT symbol_id, string_agg(q.kind || ':' || q.name, '/' ORDER BY hops DESC) AS above FROM r JOIN s q ON q.id = ancestor_id GROUP BY 1) SELECT s.id AS symbol_id, coalesce(above || '/', '') || s.kind || ':' || s.name AS path FROM s LEFT JOIN p ON p.symbol_id = s.id")
def y20_identity_paths(s: Store) -> DataFrame:
    """Each symbol's kinds and names from the outermost declaration of its file down."""
    t = Scratch(s.spark, "paths").cut(_within_file(s).select("id", "file_id", "parent_id", F.concat_ws(":", "kind", "name").alias("step")))
    above = S.ancestors(t, Scratch(s.spark, "paths")).join(t.select(F.col("id").alias("q_id"), "step"), F.col("ancestor_id") == F.col("q_id"))
    p = above.groupBy(F.col("symbol_id").alias("p_id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("hops")).alias("h"), "step"))).alias("up"))
    j = t.join(p, F.col("id") == F.col("p_id"), "left")
    return j.select(F.col("id").alias("symbol_id"), F.array_join(F.concat(F.coalesce(F.transform("up", lambda x: x["step"]), F.array().cast("array<string>")), F.array("step")), "/").alias("path"))


@query(f"WITH {SY} SELECT id AS symbol_id, declaration_key IS NOT DISTINCT FROM (kind || '|' || coalesce(container, '') || '.' || name || '|' || right(signature, 40)) AS as_stored FROM s")
def y19_declaration_keys(s: Store) -> DataFrame:
    """The key of a declaration, made anew from its kind, place, name and the end of its signature, against the stored one."""
    key = F.concat("kind", F.lit("|"), F.coalesce("container", F.lit("")), F.lit("."), "name", F.lit("|"), F.right(F.col("signature"), F.lit(40)))
    return s.symbols.select(F.col("id").alias("symbol_id"), F.col("declaration_key").eqNullSafe(key).alias("as_stored"))


@query(f"WITH {SY} SELECT declaration_key, min(id) AS first_id, count(*) AS declared, count(DISTINCT file_id) AS files FROM s WHERE declaration_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT file_id) > 1")
def y12_by_declaration_key(s: Store) -> DataFrame:
    """Declarations that several files have under one key."""
    return s.symbols.where("declaration_key is not null").groupBy("declaration_key").agg(F.min("id").alias("first_id"), F.count("*").alias("declared"), F.count_distinct("file_id").alias("files")).where("files > 1")


@query(f"WITH {SY}, {EDGE} SELECT base_arity, count(DISTINCT derived_id) AS types FROM be WHERE base_name = 'icursor' GROUP BY 1")
def y13_by_arity(s: Store) -> DataFrame:
    """Implementers of a name for each number of type arguments."""
    return s.base_edges.where("base_name = 'icursor'").groupBy("base_arity").agg(F.count_distinct("derived_id").alias("types"))


@query(f"WITH {SY}, {EDGE} SELECT s.id AS symbol_id, EXISTS (SELECT 1 FROM be WHERE be.derived_id = s.id AND base_name = 'icursor') AS edge FROM s WHERE kind IN {_list(TYPE_KINDS)} AND contains(signature, ' : ') AND regexp_matches(lower(regexp_extract(signature, ' : (.*)$', 1)), '(^|[^\\pL\\p{{Nd}}_])icursor([^\\pL\\p{{Nd}}_]|$)')")
def y15_base_mentions(s: Store) -> DataFrame:
    """Types whose base list mentions a name anywhere, arguments included, and whether it is a base itself."""
    listed = F.regexp_extract("signature", r" : (.*)$", 1)
    t = s.symbols.where(F.col("kind").isin(*TYPE_KINDS) & F.col("signature").contains(" : ") & X.whole_token(listed, "ICursor")).select(F.col("id").alias("symbol_id"))
    e = s.base_edges.where("base_name = 'icursor'").select(F.col("derived_id").alias("e_id")).distinct()
    return t.join(e, F.col("symbol_id") == F.col("e_id"), "left").select("symbol_id", F.col("e_id").isNotNull().alias("edge"))


@query(
    f"""WITH {SY}, {EDGE}, i AS (SELECT DISTINCT derived_id FROM be WHERE base_name = 'icursor'), d AS (SELECT DISTINCT derived_id, base_name FROM be),
 t AS (SELECT s.id, lower(s.name) AS n FROM s JOIN i ON i.derived_id = s.id)
SELECT d.derived_id AS symbol_id, min(t.id) AS via_id, count(DISTINCT t.id) AS ways FROM d JOIN t ON d.base_name = t.n WHERE d.derived_id NOT IN (SELECT derived_id FROM i) GROUP BY 1"""
)
def l17_via(s: Store) -> DataFrame:
    """Types that have a contract through a base of theirs: the first such base, and how many introduce it."""
    direct = s.base_edges.where("base_name = 'icursor'").select(F.col("derived_id").alias("i_id")).distinct()
    t = s.symbols.join(direct, F.col("id") == F.col("i_id"), "left_semi").select(F.col("id").alias("via"), X.fold("name").alias("n"))
    d = s.base_edges.select("derived_id", "base_name").distinct()
    j = d.join(t, F.col("base_name") == F.col("n")).join(direct, F.col("derived_id") == F.col("i_id"), "left_anti")
    return j.groupBy(F.col("derived_id").alias("symbol_id")).agg(F.min("via").alias("via_id"), F.count_distinct("via").alias("ways"))


@query(f"WITH {C} SELECT f.path, f.lang, length(content) AS chars FROM files f JOIN c ON c.file_id = f.id WHERE f.path IN (SELECT min(path) FROM files GROUP BY lang)")
def l1_content_by_path(s: Store) -> DataFrame:
    """Files by their exact paths (here the first of each language), with what they hold."""
    want = s.files.groupBy("lang").agg(F.min("path").alias("w_path")).select("w_path")
    f = s.files.join(want, F.col("path") == F.col("w_path"), "left_semi").select(F.col("id").alias("file_id"), "path", "lang")
    return s.contents_of(f).join(f, "file_id").select("path", "lang", F.length("content").alias("chars")).distinct()


# ------------------------------------------------------------------- overview


@query(
    f"""WITH {PROJ}, {OWN}, {SY} SELECT count(*) AS files, count_if(lang = 'cs') AS cs_files, count_if(lang = 'fs') AS fs_files, count_if(lang = 'sql') AS sql_files, count_if(lang = 'md') AS md_files, count_if(lang = 'config') AS config_files, count_if(is_generated) AS generated,
 sum(CASE WHEN lang = 'cs' THEN line_count END)::BIGINT AS cs_lines, sum(CASE WHEN lang = 'fs' THEN line_count END)::BIGINT AS fs_lines, sum(size)::BIGINT AS bytes,
 (SELECT count(*) FROM s) AS symbols, (SELECT count(*) FROM p) AS projects, (SELECT count_if(is_test) FROM p) AS test_projects, (SELECT count_if(starts_with(load_status, 'failed')) FROM p) AS failed, (SELECT count(DISTINCT rel_path) FROM parsed_solutions) AS solutions, (SELECT count(*) FROM refs) AS edges,
 (SELECT count(*) FROM files f WHERE lang IN ('cs', 'fs') AND NOT EXISTS (SELECT 1 FROM own WHERE own.file_id = f.id)) AS orphans FROM files"""
)
def a1_whole_overview(s: Store) -> DataFrame:
    """All counts of a workspace in one row that is kept; each part is a one-row aggregate, so the products are of single rows."""
    return s.kept.table("whole_overview", lambda: _whole_overview(s))


def _whole_overview(s: Store) -> DataFrame:
    lang = F.col("lang")
    a = s.files.agg(
        F.count("*").alias("files"), *[F.count_if(lang == x).alias(f"{x}_files") for x in ("cs", "fs", "sql", "md", "config")], F.count_if("is_generated").alias("generated"),
        F.sum(F.when(lang == "cs", F.col("line_count"))).alias("cs_lines"), F.sum(F.when(lang == "fs", F.col("line_count"))).alias("fs_lines"), F.sum("size").alias("bytes"),
    )
    p = s.projects.agg(F.count("*").alias("projects"), F.count_if("is_test").alias("test_projects"), F.count_if(F.col("load_status").startswith("failed")).alias("failed"))
    orphans = s.files.where(lang.isin("cs", "fs")).select(F.col("id").alias("file_id")).join(s.owners, "file_id", "left_anti").agg(F.count("*").alias("orphans"))
    parts = [s.symbols.agg(F.count("*").alias("symbols")), p, s.raw("parsed_solutions").agg(F.count_distinct("rel_path").alias("solutions")), s.refs.agg(F.count("*").alias("edges")), orphans]
    for x in parts:
        a = a.crossJoin(F.broadcast(x))
    return a


_SUMS = ("total_contexts", "processed_contexts", "truncated_contexts", "truncated_owner_projects", "failed_contexts", "option_project_count", "option_failed_projects", "option_partial_projects")
_COVERAGE = "count(*) AS files, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in _SUMS) + ", count(*) FILTER (truncated_contexts > 0) AS truncated_files, count(*) FILTER (failed_contexts > 0) AS failed_files, count(*) FILTER (option_failed_projects > 0) AS option_failed_files, count(*) FILTER (option_partial_projects > 0) AS option_partial_files"


def _coverage(c: DataFrame) -> DataFrame:
    n = lambda x: F.count_if(F.col(x) > 0)
    return c.agg(F.count("*").alias("files"), *[F.sum(x).alias(x) for x in _SUMS], n("truncated_contexts").alias("truncated_files"), n("failed_contexts").alias("failed_files"), n("option_failed_projects").alias("option_failed_files"), n("option_partial_projects").alias("option_partial_files"))


@query(f"SELECT {_COVERAGE} FROM (SELECT DISTINCT * FROM fsharp_parse_coverage)")
def a2_whole_coverage(s: Store) -> DataFrame:
    return _coverage(s.raw("fsharp_parse_coverage").distinct())


@query(f"SELECT {_COVERAGE} FROM (SELECT DISTINCT c.* FROM fsharp_parse_coverage c JOIN files f ON f.id = c.file_id WHERE starts_with(lower(f.path), 'skiff/')) WHERE failed_contexts > 0 OR truncated_contexts > 0 OR option_failed_projects > 0 OR option_partial_projects > 0")
def l8_scoped_coverage(s: Store) -> DataFrame:
    """The coverage of one directory, of files with anything to report only."""
    f = s.files.where(X.fold("path").startswith("skiff/")).select("id")
    c = s.raw("fsharp_parse_coverage").distinct().join(f, F.col("file_id") == F.col("id"), "left_semi")
    return _coverage(c.where("failed_contexts > 0 or truncated_contexts > 0 or option_failed_projects > 0 or option_partial_projects > 0"))


@query(f"WITH {PROJ} SELECT id AS project_id, rel_path, name FROM p ORDER BY k, name, id LIMIT 100")
def l4_all_projects(s: Store) -> DataFrame:
    """The first hundred projects in order of path and name."""
    return s.projects.orderBy("key", "name", "id").limit(100).select(F.col("id").alias("project_id"), "rel_path", "name")


@query(
    f"""WITH {PROJ}, cf AS (SELECT path, hash, lower(regexp_replace(path, '/?[^/]*$', '')) AS cdir, lower(regexp_extract(path, '[^/]*$')) AS n FROM files WHERE lower(regexp_extract(path, '[^/]*$')) IN {_list(CONFIG_NAMES)}),
 b AS (SELECT p.id AS project_id, n, path || '#' || coalesce(hash::VARCHAR, '') AS x, row_number() OVER (PARTITION BY p.id, n ORDER BY length(cdir) DESC, path DESC) AS rn FROM p JOIN cf ON p.pdir = cdir OR cdir = '' OR starts_with(p.pdir, cdir || '/'))
SELECT project_id, string_agg(x, '|' ORDER BY n) AS identity FROM b WHERE rn = 1 GROUP BY 1"""
)
def l9_config_identity(s: Store) -> DataFrame:
    """What a project's build depends on beyond itself: path and hash of the nearest configuration of each name, as one string."""
    from codeloom.operators.store import ancestors

    p = s.projects.select(F.col("id").alias("project_id"), F.explode(ancestors(F.col("dir"))).alias("above"))
    j = p.join(s.configs, p["above"] == s.configs["config_dir"])
    best = j.groupBy("project_id", "config_name").agg(F.max_by(F.concat_ws("#", "config_path", F.coalesce(F.col("hash").cast("string"), F.lit(""))), F.struct(F.length("above"), "config_path")).alias("x"))
    return best.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("config_name", "x"))).alias("all")).select("project_id", F.array_join(F.transform("all", lambda v: v["x"]), "|").alias("identity"))


@query(f"WITH {PROJ} SELECT f.id AS file_id, p.id AS project_id FROM files f JOIN p ON lower(f.path) = CASE WHEN p.pdir = '' THEN '' ELSE p.pdir || '/' END || 'packages.config'")
def j10_packages_config(s: Store) -> DataFrame:
    """Package lists beside their projects: an equi-join on the path that a project's directory gives."""
    p = s.projects.select(F.col("id").alias("project_id"), F.concat(F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/"))), F.lit("packages.config")).alias("wanted"))
    f = s.files.select(F.col("id").alias("file_id"), X.fold("path").alias("f_path"))
    return f.join(p, F.col("f_path") == F.col("wanted")).select("file_id", "project_id")


@query(f"WITH {L}, k AS (SELECT l.file_id, line_no, line FROM (SELECT file_id, generate_subscripts(a, 1) AS line_no, unnest(a) AS line FROM (SELECT file_id, string_split(content, chr(10)) AS a FROM c)) l JOIN files f ON f.id = l.file_id WHERE f.lang = 'config') SELECT file_id, line_no, (coalesce(sum(length(line) + 1) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS at FROM k")
def w8_line_offsets(s: Store) -> DataFrame:
    """Where each line of a configuration file begins, in characters: a running sum inside the array of a text's lines."""
    f = s.files.where("lang = 'config'").select(F.col("id").alias("file_id"))
    c = s.contents_of(f).where("content is not null").select("file_id", F.transform(F.split("content", "\n"), lambda x: F.length(x) + 1).alias("n"))
    at = F.aggregate("n", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return c.select("file_id", F.posexplode(at).alias("k", "at"), F.size("n").alias("size")).where("k < size").select("file_id", (F.col("k") + 1).alias("line_no"), "at")


@query("SELECT id AS file_id, (row_number() OVER (ORDER BY id) - 1) // 512 AS page FROM files")
def t11_keyset_pages(s: Store) -> DataFrame:
    """The pages of 512 that a scan behind a growing key would read."""
    n = S.numbered(s.files.select(F.col("id").alias("file_id")), [F.col("file_id")], Scratch(s.spark, "pages"))
    return n.select("file_id", F.floor(F.col("place") / 512).alias("page"))


# --------------------------------------------------------------------- graphs


@query(
    f"""WITH RECURSIVE {PROJ}, ro AS (SELECT max(from_id) AS root FROM refs), r AS (SELECT root AS node FROM ro UNION SELECT to_id FROM r JOIN refs ON from_id = r.node) SELECT node FROM r WHERE node IS NOT NULL"""
)
def g2_closure_with_targets(s: Store) -> DataFrame:
    """What a project needs to load, itself included."""
    roots = s.refs.agg(F.max("from_id").alias("root")).where("root is not null")
    e = s.refs.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    return graph.reachable(e, roots, Scratch(s.spark, "closure")).select("node").union(roots).distinct()


@query(
    f"""WITH RECURSIVE {PROJ}, ro AS (SELECT min(to_id) AS root FROM refs), u AS (SELECT root AS node, 0 AS hop FROM ro UNION SELECT from_id, hop + 1 FROM u JOIN refs ON to_id = u.node WHERE hop < 3), un AS (SELECT node, min(hop) AS hop FROM u GROUP BY 1),
 d AS (SELECT root AS node, 0 AS hop FROM ro UNION SELECT to_id, hop + 1 FROM d JOIN refs ON from_id = d.node WHERE hop < 3), dn AS (SELECT node, min(hop) AS hop FROM d GROUP BY 1)
SELECT from_id, to_id, 'upstream' AS side, hop + 1 AS hop FROM refs JOIN un ON to_id = un.node WHERE hop < 3 UNION ALL SELECT from_id, to_id, 'downstream', hop + 1 FROM refs JOIN dn ON from_id = dn.node WHERE hop < 3"""
)
def g1_both_directions(s: Store) -> DataFrame:
    """Every edge of the projects within three hops, in both directions; a project is expanded once."""
    root = s.refs.agg(F.min("to_id").alias("root")).where("root is not null")
    down = s.refs.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    out = None
    for side, e in (("upstream", graph.reverse(down)), ("downstream", down)):
        near = graph.reachable(e, root, Scratch(s.spark, "graph"), 2).select("node", "depth").join(root, F.col("node") == F.col("root"), "left_anti").unionByName(root.select(F.col("root").alias("node"), F.lit(0).alias("depth")))
        hit = e.join(near, F.col("src") == F.col("node")).select("src", "dst", F.lit(side).alias("side"), (F.col("depth") + 1).alias("hop"))
        hit = hit.select(F.col("dst").alias("from_id"), F.col("src").alias("to_id"), "side", "hop") if side == "upstream" else hit.select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"), "side", "hop")
        out = hit if out is None else out.unionByName(hit)
    return out


# -------------------------------------------------- project and solution files


def _tag(x: str) -> str:
    return f"regexp_extract_all(content, '<{x}\\b[^>]*\\bInclude\\s*=\\s*\"([^\"]*)\"', 1)"


@query(
    r"""WITH s AS (SELECT DISTINCT file_id, content FROM file_contents JOIN files ON file_id = id WHERE lang IN ('csproj','fsproj') AND content IS NOT NULL)
SELECT file_id, regexp_extract(content, '<Project\b[^>]*\bSdk\s*=\s*"([^"]*)"', 1) AS sdk, CASE WHEN regexp_extract(content, '<TargetFrameworks>\s*([^<]*?)\s*</TargetFrameworks>', 1) <> '' THEN regexp_extract(content, '<TargetFrameworks>\s*([^<]*?)\s*</TargetFrameworks>', 1) ELSE regexp_extract(content, '<TargetFramework>\s*([^<]*?)\s*</TargetFramework>', 1) END AS frameworks, """
    + f"len({_tag('ProjectReference')}) AS project_refs, len({_tag('PackageReference')}) AS packages, len({_tag('Reference')}) AS assembly_refs, len({_tag('Compile')}) AS compiles, "
    + r"""len(regexp_extract_all(content, '<Compile\b[^>]*\bRemove\s*=\s*"([^"]*)"', 1)) AS removes, CASE WHEN regexp_matches(content, '(?s)<Project\b.*</Project>\s*$') OR regexp_matches(content, '(?s)<Project\b[^>]*/>\s*$') THEN 'parsed' ELSE 'failed:xml' END AS load_status FROM s"""
)
def s6_project_facts(s: Store) -> DataFrame:
    """What project files say, attributes in any order: kind, frameworks, references, packages, compile items and removes; malformed ones are told."""
    f = s.files.where(F.col("lang").isin("csproj", "fsproj")).select(F.col("id").alias("file_id"), "path", "lang")
    texts = s.contents_of(f).where("content is not null").join(f, "file_id").select(F.col("file_id").cast("string").alias("path"), "lang", F.col("content").alias("text"))
    p = workspace.projects(texts)
    return p.select(F.col("path").cast("long").alias("file_id"), "sdk", "frameworks", *[F.size(c).alias(c) for c in ("project_refs", "packages", "assembly_refs", "compiles", "removes")], "load_status").distinct()


@query(
    f"""WITH {PROJ}, {OWN}, rm AS (SELECT DISTINCT p.id AS project_id, p.pdir, lower(replace(unnest(regexp_extract_all(content, '<Compile\\b[^>]*\\bRemove\\s*=\\s*"([^"]*)"', 1)), '\\', '/')) AS pat FROM (SELECT DISTINCT file_id, content FROM file_contents) c JOIN files f ON f.id = c.file_id JOIN p ON p.k = lower(f.path)),
 gone AS (SELECT DISTINCT own.file_id, own.project_id FROM own JOIN files f ON f.id = own.file_id JOIN rm ON rm.project_id = own.project_id AND regexp_matches(lower(f.path), '^' || replace(replace(replace(rm.pdir || '/' || pat, '.', '\\.'), '**/', '(?:.+/)?'), '*', '[^/]*') || '$'))
SELECT file_id, project_id FROM own EXCEPT SELECT file_id, project_id FROM gone"""
)
def j12_owners_less_removed(s: Store) -> DataFrame:
    """Owners of files, less what their projects remove from the build: an equi-join on the project, then the glob as a regular expression."""
    f = s.files.where(F.col("lang").isin("csproj", "fsproj")).select(F.col("id").alias("f_id"), X.fold("path").alias("f_path"))
    c = s.contents_of(f.select(F.col("f_id").alias("file_id"))).where(F.col("content").contains("Remove"))
    globs = c.join(f, F.col("file_id") == F.col("f_id")).join(s.projects.select(F.col("key").alias("k"), F.col("id").alias("r_project"), "dir"), F.col("f_path") == F.col("k"))
    globs = globs.select("r_project", "dir", F.explode(F.regexp_extract_all("content", F.lit(r'<Compile\b[^>]*\bRemove\s*=\s*"([^"]*)"'), F.lit(1))).alias("glob")).distinct()
    globs = globs.select("r_project", X.glob_column_regex(X.fold(F.concat_ws("/", F.expr("nullif(dir, '')"), F.replace("glob", F.lit("\\"), F.lit("/"))))).alias("pattern"))
    src = s.files.select(F.col("id").alias("s_id"), X.fold("path").alias("s_path"))
    gone = s.owners.join(globs, F.col("project_id") == F.col("r_project")).join(src, F.col("file_id") == F.col("s_id")).where(F.expr("s_path rlike pattern")).select("file_id", "project_id").distinct()
    return s.owners.join(gone, ["file_id", "project_id"], "left_anti")


@query(
    r"""WITH s AS (SELECT DISTINCT file_id, content FROM file_contents JOIN files ON file_id = id WHERE lang = 'sln' AND content IS NOT NULL),
 m AS (SELECT file_id, unnest(regexp_extract_all(content, 'Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]*)"', 1)) AS member FROM s)
SELECT file_id, replace(member, '\', '/') AS member FROM m WHERE lower(member) LIKE '%proj' GROUP BY ALL"""
)
def s7_solution_projects(s: Store) -> DataFrame:
    """Projects of solution files of any of the three formats."""
    f = s.files.where("lang = 'sln'").select(F.col("id").alias("file_id"), "path")
    texts = s.contents_of(f).where("content is not null").join(f, "file_id").select(F.col("file_id").cast("string").alias("path"), F.col("path").alias("name"), F.col("content").alias("text"))
    return workspace.solution_projects(texts).select(F.col("path").cast("long").alias("file_id"), "member").distinct()


# ------------------------------------------------------------------- telemetry


def _records(s: Store) -> DataFrame:
    """The event table as lines of a log: one of the five record types each, one in every thousand malformed."""
    e = s.raw("events")
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    result = F.element_at(F.array(*[F.lit(x) for x in ("exact", "partial", "degraded", "unresolved", "error")]), (F.col("user_id") % 5 + 1).cast("int"))
    line = (
        F.when(F.col("event_id") % 1000 == 0, F.lit('{"e": "semanticOp", '))
        .when(F.col("event_type") == "click", F.to_json(F.struct(F.lit("semanticOp").alias("e"), ts.alias("ts"), F.concat(F.lit("c"), "event_id").alias("corr"), F.lit("references").alias("tool"), result.alias("result"), F.lit(40.0).alias("clusterLoadMs"), F.lit(2.5).alias("queryMs"))))
        .when(F.col("event_type") == "view", F.to_json(F.struct(F.lit("buildProgress").alias("e"), ts.alias("ts"), F.concat(F.lit("b"), F.col("user_id") % 7).alias("buildId"), F.lit("running").alias("state"), F.col("user_id").alias("filesDone"))))
        .when(F.col("event_type") == "purchase", F.to_json(F.struct(F.lit("serverInfo").alias("e"), ts.alias("ts"), F.lit("1.0").alias("version"))))
        .when(F.col("event_type") == "signup", F.to_json(F.struct(F.lit("telemetry_dropped").alias("e"), F.col("user_id").alias("count"))))
        .otherwise(F.to_json(F.struct(F.lit("telemetry_truncated").alias("e"), F.lit(16777216).alias("capBytes"))))
    )
    return e.select(line.alias("value"))


_KIND = "CASE WHEN event_id % 1000 = 0 THEN 'invalid' WHEN event_type = 'click' THEN 'semanticOp' WHEN event_type = 'view' THEN 'buildProgress' WHEN event_type = 'purchase' THEN 'serverInfo' WHEN event_type = 'signup' THEN 'telemetry_dropped' ELSE 'telemetry_truncated' END"


@query(
    f"""WITH k AS (SELECT *, {_KIND} AS kind FROM events) SELECT kind, CASE WHEN kind = 'semanticOp' THEN ['success', 'success', 'degraded', 'failed', 'failed'][user_id % 5 + 1] END AS outcome, CASE WHEN kind = 'semanticOp' THEN ['exact', 'partial', 'indexed', 'none', 'none'][user_id % 5 + 1] END AS confidence, count(*) AS n, sum(CASE WHEN kind = 'telemetry_dropped' THEN user_id END)::BIGINT AS dropped FROM k GROUP BY 1, 2, 3"""
)
def r6_record_types(s: Store) -> DataFrame:
    """A log of all five record types normalised: kinds, outcomes, what was dropped; malformed lines are counted, not lost."""
    return E.normalise(_records(s)).groupBy("kind", "outcome", "confidence").agg(F.count("*").alias("n"), F.sum("dropped").alias("dropped"))


@query(
    f"""WITH k AS (SELECT *, {_KIND} AS kind FROM events), o AS (SELECT 'c' || event_id AS correlation_id, date_trunc('milliseconds', ts) AS t, ['success', 'success', 'degraded', 'failed', 'failed'][user_id % 5 + 1] AS outcome, ['exact', 'partial', 'indexed', 'none', 'none'][user_id % 5 + 1] AS confidence FROM k WHERE kind = 'semanticOp')
SELECT correlation_id, outcome FROM o WHERE outcome IN ('success', 'degraded') AND confidence <> 'none' AND t >= TIMESTAMP '2024-01-05' AND t < TIMESTAMP '2024-01-25' ORDER BY t DESC, correlation_id LIMIT 50"""
)
def r10_operation_page(s: Store) -> DataFrame:
    """A page of operations by outcome, confidence, tool, time and duration."""
    ops = E.normalise(_records(s)).where("kind = 'semanticOp'")
    return E.operation_page(ops, 50, outcomes=("success", "degraded"), confidences=("exact", "partial", "indexed"), tools=("references",), since="2024-01-05T00:00:00Z", until="2024-01-25T00:00:00Z", least_ms=40, most_ms=100).select("correlation_id", "outcome")


@query(
    f"""WITH k AS (SELECT *, {_KIND} AS kind FROM events) SELECT (SELECT coalesce(sum(user_id), 0)::BIGINT FROM k WHERE kind = 'telemetry_dropped') AS dropped, count_if(kind = 'invalid') AS invalid, count_if(kind = 'telemetry_truncated') AS truncated,
 NOT (count_if(kind = 'invalid') > 0 OR count_if(kind = 'telemetry_truncated') > 0 OR count_if(kind = 'telemetry_dropped') > 0) AS data_complete FROM k"""
)
def r8_honesty(s: Store) -> DataFrame:
    """What a log admits to have lost, in one row."""
    r = E.normalise(_records(s))
    is_ = lambda x: F.count_if(F.col("kind") == x)
    return r.agg(F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"), is_("invalid").alias("invalid"), is_("telemetry_truncated").alias("truncated"), (is_("invalid") + is_("telemetry_truncated") + is_("telemetry_dropped") == 0).alias("data_complete"))


# --------------------------------------------------------------------- refresh


_KNOWN = "kn AS (SELECT path, hash FROM (SELECT path, hash, row_number() OVER (PARTITION BY path ORDER BY run_id DESC, attempt DESC, recorded_at DESC, checkpoint_id DESC) AS rn FROM file_checkpoints WHERE path IS NOT NULL) WHERE rn = 1)"


@query(
    f"""WITH {C}, {SY}, {_KNOWN}, tx AS (SELECT file_id, max(content) AS content FROM c WHERE content IS NOT NULL GROUP BY 1), f AS (SELECT files.id, files.path, files.hash FROM files JOIN tx ON tx.file_id = files.id),
 d AS (SELECT CASE WHEN kn.path IS NULL THEN 'insert' WHEN f.path IS NULL THEN 'delete' WHEN f.hash = kn.hash THEN 'skip' ELSE 'replace' END AS what FROM f FULL JOIN kn ON f.path = kn.path)
SELECT what, count(*) AS n FROM d GROUP BY 1 UNION ALL SELECT 'files', count(*) FROM f UNION ALL SELECT 'symbols', count(*) FROM (SELECT DISTINCT id, file_id, parent_id, kind, name, ns, container, signature, start_line, end_line FROM s) q JOIN f ON f.id = q.file_id
UNION ALL SELECT 'characters', sum(length(content)) FROM tx JOIN f ON f.id = tx.file_id"""
)
def r1_refresh(s: Store) -> DataFrame:
    """An index of what the last runs knew, refreshed to the files as they are: what was done, and what the new version holds."""
    from codeloom.operators.index import Index

    scratch = Scratch(s.spark, "index")
    readable = s.contents.where("content is not null").select(F.col("file_id").alias("id")).distinct()
    files = s.files.join(readable, "id", "left_semi").select("id", "path", "size", "hash", "lang", "line_count", "is_generated")
    c = s.raw("file_checkpoints").where("path is not null")
    known = c.groupBy("path").agg(F.max(F.struct("run_id", "attempt", "recorded_at", "checkpoint_id", "hash")).alias("v")).select("path", F.col("v.hash").alias("hash"))
    # paths that are gone have no id any more: one of their own
    old = known.join(files.drop("hash"), "path", "left").withColumn("id", F.coalesce("id", -F.abs(F.xxhash64("path")) - 1))
    projects = s.projects.select("id", "key", "dir", "name", "lang")
    index = Index(s.spark, f"{scratch.base}/index")
    index.build(old, s.contents, s.symbols, projects, {"schema": "1"})
    acts = index.refresh(files, s.contents, s.symbols, projects, {"refreshed": "yes"})
    one = lambda name, df, n: df.agg(n.cast("long").alias("n")).select(F.lit(name).alias("what"), "n")
    out = acts.groupBy(F.col("action").alias("what")).agg(F.count("*").alias("n"))
    out = out.unionByName(one("files", index.read_part("files"), F.count("*"))).unionByName(one("symbols", index.read_part("symbols"), F.count("*")))
    return out.unionByName(one("characters", index.read_part("contents"), F.sum(F.length("content"))))


# ------------------------------------------------- logs, diffs, slices, callers


@query(f"WITH k AS (SELECT {_KIND} AS kind FROM events) SELECT kind, count(*) AS n FROM k GROUP BY 1")
def s9_tailed_log(s: Store) -> DataFrame:
    """The log as a stream of text files, read once to its end."""
    from codeloom.streaming import telemetry

    scratch = Scratch(s.spark, "log")
    folder = f"{scratch.base}/in"
    _records(s).write.text(folder)
    return telemetry.drain(telemetry.tail(s.spark, folder), scratch, "append").groupBy("kind").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT event_id, strlen(props) + 1 AS bytes FROM events), t AS (SELECT *, sum(bytes) OVER (ORDER BY event_id) AS running FROM r) SELECT count(*) FILTER (running <= 20000) AS kept, (max(running) > 20000)::INT AS truncated, max(running) FILTER (running <= 20000)::BIGINT AS bytes FROM t")
def k6_capped_log(s: Store) -> DataFrame:
    """A log of at most 20000 bytes, and whether it says that it was cut."""
    from codeloom.streaming import telemetry

    log = telemetry.capped(s.raw("events").select("event_id", F.col("props").alias("value")), [F.col("event_id")], 20000, Scratch(s.spark, "log"))
    cut = F.col("value").contains("telemetry_truncated")
    return log.agg(F.count_if(~cut).alias("kept"), F.count_if(cut).cast("int").alias("truncated"), F.sum(F.when(~cut, F.octet_length("value") + 1)).alias("bytes"))


@query(
    """WITH f AS (SELECT id, path, (id % 11 = 0) AS deleted, 10 + (id % 20)::INT AS a FROM files WHERE lang IN ('cs', 'fs'))
SELECT id AS diff_id, path, deleted, a AS old_start, 3 AS old_count, CASE WHEN deleted THEN 0 ELSE a + 2 END AS new_start, CASE WHEN deleted THEN 0 ELSE 5 END AS new_count FROM f UNION ALL SELECT id, path, deleted, a + 40, 1, a + 44, 2 FROM f WHERE NOT deleted"""
)
def s8_hunks(s: Store) -> DataFrame:
    """Unified diffs (one made for each source file) read back as hunks."""
    from codeloom.sources import diffs

    a = (F.col("id") % 20 + 10).cast("int")
    head = F.concat(F.lit("From: nobody\n\ndiff --git a/"), "path", F.lit(" b/"), "path", F.lit("\nindex 1..2 100644\n--- a/"), "path", F.lit("\n"))
    gone = F.concat(head, F.lit("+++ /dev/null\n@@ -"), a, F.lit(",3 +0,0 @@\n-x\n-y\n-z\n"))
    kept = F.concat(head, F.lit("+++ b/"), "path", F.lit("\n@@ -"), a, F.lit(",3 +"), a + 2, F.lit(",5 @@ class X\n x\n+y\n+@@ no hunk\n@@ -"), a + 40, F.lit(" +"), a + 44, F.lit(",2 @@\n-q\n"))
    text = F.when(F.col("id") % 11 == 0, gone).otherwise(kept)
    return diffs.hunks(s.files.where(F.col("lang").isin("cs", "fs")).select(F.col("id").alias("diff_id"), text.alias("text")))


@query(f"WITH {C} SELECT file_id, array_to_string(string_split(content, chr(10))[1:3], chr(10)) AS head FROM c WHERE content IS NOT NULL")
def s10_first_lines(s: Store) -> DataFrame:
    """The first three lines of each file; the rest of the text is not cut."""
    return s.contents.where("content is not null").select("file_id", F.substring_index("content", "\n", 3).alias("head"))


@query(
    f"""WITH {L}, {SY}, rf AS (SELECT DISTINCT file_id, line_no FROM l WHERE regexp_matches(line, '(^|[^\\pL\\p{{Nd}}_]){NAME}([^\\pL\\p{{Nd}}_]|$)')),
 i AS (SELECT rf.file_id, rf.line_no, s.id, row_number() OVER (PARTITION BY rf.file_id, rf.line_no ORDER BY end_line - start_line, start_line DESC, s.id) AS rn FROM rf JOIN s ON s.file_id = rf.file_id AND rf.line_no BETWEEN start_line AND end_line WHERE s.kind IN ('method', 'constructor', 'function', 'property')),
 k AS (SELECT id, line_no, row_number() OVER (PARTITION BY id ORDER BY line_no) AS nth FROM i WHERE rn = 1)
SELECT id AS symbol_id, count(*) AS sites, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) FILTER (nth <= 5) AS first_sites FROM k GROUP BY 1"""
)
def l18_callers(s: Store) -> DataFrame:
    """Members that mention a name, with their first five sites: references in text, each credited to the innermost member around it."""
    rf = search.references(s.lines_with(NAME), s.owners, NAME).select("file_id", "line_no").distinct()
    members = s.symbols.where(F.col("kind").isin("method", "constructor", "function", "property"))
    at = S.innermost(rf, members)
    w = Window.partitionBy("symbol_id").orderBy("line_no")
    first = at.withColumn("nth", F.row_number().over(w)).where("nth <= 5").groupBy(F.col("symbol_id").alias("f_id")).agg(F.array_sort(F.collect_list("line_no")).alias("a"))
    return at.groupBy("symbol_id").agg(F.count("*").alias("sites")).join(first, F.col("symbol_id") == F.col("f_id")).select("symbol_id", "sites", F.array_join(F.transform("a", lambda x: x.cast("string")), ",").alias("first_sites"))


@query(
    f"""WITH {L}, {SY}, decl AS (SELECT DISTINCT name FROM s WHERE kind IN ('method', 'function') AND name IS NOT NULL), t AS (SELECT id, file_id, start_line, end_line FROM s WHERE kind = 'method'),
 x AS (SELECT t.id, l.line_no, unnest(regexp_extract_all(line, '([A-Za-z_]\\w*)\\s*\\(', 1)) AS callee FROM t JOIN l ON l.file_id = t.file_id AND l.line_no > t.start_line AND l.line_no <= t.end_line)
SELECT id AS symbol_id, callee, count(DISTINCT line_no) AS lines, min(line_no) AS first_line FROM x JOIN decl ON decl.name = callee GROUP BY 1, 2"""
)
def l18_callees(s: Store) -> DataFrame:
    """Names that methods call and the workspace declares: calls in the text of their bodies."""
    t = s.symbols.where("kind = 'method'").select(F.col("id").alias("symbol_id"), F.col("file_id").alias("t_file"), "start_line", "end_line")
    decl = s.symbols.where("kind in ('method', 'function') and name is not null").select(F.col("name").alias("d_name")).distinct()
    lines = lines_of(s.contents_of(t.select(F.col("t_file").alias("file_id"))).where("content is not null"))
    calls = lines.where(F.col("line").contains("(")).select("file_id", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1)))).alias("callee"))
    calls = calls.join(decl, F.col("callee") == F.col("d_name"), "left_semi")
    j = calls.join(t, (F.col("file_id") == F.col("t_file")) & (F.col("line_no") > F.col("start_line")) & (F.col("line_no") <= F.col("end_line")))
    return j.groupBy("symbol_id", "callee").agg(F.count_distinct("line_no").alias("lines"), F.min("line_no").alias("first_line"))


@query(
    f"""WITH RECURSIVE {SY}, {EDGE}, e AS (SELECT DISTINCT base_name AS up, lower(name) AS down FROM be JOIN s ON s.id = derived_id), ro AS (SELECT coalesce(min(up) FILTER (up IN (SELECT down FROM e)), min(up)) AS root FROM e),
 u AS (SELECT up AS name, 1 AS hops FROM e, ro WHERE down = root UNION SELECT e.up, hops + 1 FROM u JOIN e ON e.down = u.name WHERE hops < 30), d AS (SELECT down AS name, 1 AS hops FROM e, ro WHERE up = root UNION SELECT e.down, hops + 1 FROM d JOIN e ON e.up = d.name WHERE hops < 30)
SELECT 'above' AS side, name, min(hops) AS hops FROM u GROUP BY 2 UNION ALL SELECT 'below', name, min(hops) FROM d GROUP BY 2"""
)
def l18_type_hierarchy(s: Store) -> DataFrame:
    """All bases above and all types below a name, with how far they are."""
    e = s.base_edges.join(s.symbols.select(F.col("id").alias("d_id"), X.fold("name").alias("down")), F.col("derived_id") == F.col("d_id")).select(F.col("base_name").alias("src"), F.col("down").alias("dst")).distinct()
    e = Scratch(s.spark, "types").cut(e)
    # a name in the middle if there is one
    d = e.select(F.col("dst").alias("d")).distinct()
    root = e.join(d, F.col("src") == F.col("d"), "left").agg(F.coalesce(F.min(F.when(F.col("d").isNotNull(), F.col("src"))), F.min("src")).alias("root")).where("root is not null")
    out = None
    for side, way in (("above", graph.reverse(e)), ("below", e)):
        hit = graph.reachable(way, root, Scratch(s.spark, "types"), 30).select(F.lit(side).alias("side"), F.col("node").alias("name"), F.col("depth").alias("hops"))
        out = hit if out is None else out.unionByName(hit)
    return out


@query(
    f"""WITH {SY}, t AS (SELECT *, min(id) OVER w AS class_id, count(*) OVER w AS members, row_number() OVER (PARTITION BY kind, name, ns, container ORDER BY id) AS nth FROM s WHERE is_partial WINDOW w AS (PARTITION BY kind, name, ns, container))
SELECT class_id, id AS symbol_id, members > 11 AS more FROM t WHERE members > 1 AND nth <= 11"""
)
def y6_sibling_page(s: Store) -> DataFrame:
    """Of each partial type its first eleven declarations, and whether there are more; ranks are cut before they are shuffled."""
    key = ["kind", "name", "ns", "container"]
    t = s.symbols.where("is_partial").select("id", *key)
    first = t.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).where("nth <= 11")
    c = t.groupBy(*[F.col(k).alias(f"c_{k}") for k in key]).agg(F.min("id").alias("class_id"), F.count("*").alias("members")).where("members > 1")
    same = None
    for k in key:
        test = first[k].eqNullSafe(c[f"c_{k}"])
        same = test if same is None else same & test
    return first.join(c, same).select("class_id", F.col("id").alias("symbol_id"), (F.col("members") > 11).alias("more"))


_TABLES = ("files", "file_contents", "symbols", "parsed_projects", "parsed_solutions", "file_checkpoints", "index_runs", "events")


@query(" UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS held FROM {t}" for t in _TABLES))
def server_capabilities(s: Store) -> DataFrame:
    """What a workspace can be asked about: its sources and how much they hold."""
    out = None
    for t in _TABLES:
        part = s.raw(t).agg(F.count("*").alias("held")).select(F.lit(t).alias("source"), "held")
        out = part if out is None else out.unionByName(part)
    return out


@query(None)
def s4_agreement(s: Store) -> DataFrame:
    """How far the extractor's declarations are those of the symbols table: of each kind those stored, those found, those that agree in place and name, and of these those with equal signatures."""
    from codeloom.operators import extract

    f = s.files.where(F.col("lang").isin("cs", "fs")).select(F.col("id").alias("file_id"))
    key = ["file_id", "kind", "name", "start_line"]
    got = extract.full_declarations(s.contents).join(f, "file_id", "left_semi").groupBy(*key).agg(F.max("signature").alias("g_signature"))
    want = s.symbols.join(f, "file_id", "left_semi").where("start_line is not null").groupBy(*key).agg(F.max("signature").alias("w_signature"))
    j = want.withColumn("w", F.lit(1)).join(got.withColumn("g", F.lit(1)), key, "full")
    return j.groupBy("kind").agg(F.count("w").alias("stored"), F.count("g").alias("found"), F.count_if(F.col("w").isNotNull() & F.col("g").isNotNull()).alias("both"), F.count_if(F.col("w_signature") == F.col("g_signature")).alias("same_signature"))


# ---------------------------------------------------- fingerprints, scans, tests


@query(
    f"""WITH {PROJ}, x AS (SELECT 'project' AS part, k AS v FROM p UNION ALL SELECT 'reference', from_id || '>' || to_id FROM refs UNION ALL SELECT 'solution', rel_path FROM (SELECT DISTINCT rel_path FROM parsed_solutions) UNION ALL SELECT 'file', path || '#' || coalesce(hash::VARCHAR, '') FROM files)
SELECT part, count(*) AS n, sum(('0x' || substr(md5(v), 1, 8))::BIGINT)::BIGINT AS low, sum(('0x' || substr(md5(v), 9, 8))::BIGINT)::BIGINT AS high FROM x GROUP BY 1"""
)
def u2_fingerprint_hashes(s: Store) -> DataFrame:
    """What tells two states of a workspace apart: of projects, references, solutions and files their number and sums of the halves of their hashes, the same in any order."""
    part = lambda df, name, v: df.select(F.lit(name).alias("part"), v.alias("v"))
    x = part(s.projects, "project", F.col("key")).unionByName(part(s.refs, "reference", F.concat_ws(">", "from_id", "to_id")))
    x = x.unionByName(part(s.raw("parsed_solutions").select("rel_path").distinct(), "solution", F.col("rel_path")))
    x = x.unionByName(part(s.files, "file", F.concat("path", F.lit("#"), F.coalesce(F.col("hash").cast("string"), F.lit("")))))
    half = lambda at: F.sum(F.conv(F.substring(F.md5("v"), at, 8), 16, 10).cast("long"))
    return x.groupBy("part").agg(F.count("*").alias("n"), half(1).alias("low"), half(9).alias("high"))


_REFERENCES = f"{PROJ}, {OWN}, {L}, rf AS (SELECT DISTINCT l.file_id, line_no, project_id FROM l LEFT JOIN own ON own.file_id = l.file_id WHERE regexp_matches(line, '{_WHOLE}'))"


@query(
    f"""WITH RECURSIVE {_REFERENCES}, cand AS (SELECT project_id AS id, count(DISTINCT file_id) AS files FROM rf WHERE project_id IS NOT NULL GROUP BY 1), seed AS (SELECT DISTINCT project_id AS id FROM own JOIN symbols s ON s.file_id = own.file_id WHERE s.name = '{NAME}'),
 up AS (SELECT from_id AS id FROM refs WHERE to_id IN (SELECT id FROM seed) UNION SELECT from_id FROM up JOIN refs ON to_id = up.id),
 t AS (SELECT id, files, CASE WHEN id IN (SELECT id FROM seed) THEN 0 WHEN id IN (SELECT id FROM up) THEN 1 END AS tier FROM cand), r AS (SELECT *, row_number() OVER (PARTITION BY tier IS NULL ORDER BY tier, files DESC, id) AS place FROM t)
SELECT id AS project_id, CASE WHEN tier IS NULL THEN 'outside' WHEN place > 5 THEN 'skipped' WHEN tier = 0 THEN 'seed' ELSE 'dependent' END AS status FROM r"""
)
def g10_scan_report(s: Store) -> DataFrame:
    """All textual candidates of a scan with a budget of five: seeds and dependents that are looked at, those skipped, and those outside of the graph."""
    cand = search.references(s.lines_with(NAME), s.owners, NAME).where("project_id is not null").groupBy("project_id").agg(F.count_distinct("file_id").alias("files"))
    declared = s.symbols.where(F.col("name") == NAME).select("file_id").distinct()
    seed = s.owners.join(declared, "file_id", "left_semi").select("project_id").distinct()
    start = seed.select(F.lit(-1).cast("long").alias("src"), F.col("project_id").alias("dst"))
    up = s.refs.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst")).unionByName(start)
    near = graph.reachable(up, s.spark.createDataFrame([(-1,)], "root long"), Scratch(s.spark, "scan")).select(F.col("node").alias("project_id"))
    known = seed.withColumn("tier", F.lit(0)).unionByName(near.withColumn("tier", F.lit(1))).groupBy("project_id").agg(F.min("tier").alias("tier"))
    j = Scratch(s.spark, "scan").cut(cand.join(known, "project_id", "left"))
    taken = j.where("tier is not null").orderBy("tier", F.desc("files"), "project_id").limit(5).select(F.col("project_id").alias("t_id"))
    status = F.when(F.col("tier").isNull(), "outside").when(F.col("t_id").isNull(), "skipped").when(F.col("tier") == 0, "seed").otherwise("dependent")
    return j.join(taken, F.col("project_id") == F.col("t_id"), "left").select("project_id", status.alias("status"))


@query(
    f"""WITH {_REFERENCES}, tp AS (SELECT id, name FROM p WHERE is_test), m AS (SELECT project_id AS id, count(DISTINCT file_id) AS files FROM rf WHERE project_id IN (SELECT id FROM tp) GROUP BY 1),
 n AS (SELECT id, 2 AS tier FROM tp WHERE contains(lower(name), '{NAME.lower()}')), d AS (SELECT DISTINCT from_id AS id, 3 AS tier FROM refs JOIN p ON p.id = to_id WHERE contains(lower(p.name), '{NAME.lower()}') AND from_id IN (SELECT id FROM tp)),
 u AS (SELECT id, min(tier) AS tier FROM (SELECT id, 1 AS tier FROM m UNION ALL SELECT * FROM n UNION ALL SELECT * FROM d) GROUP BY 1)
SELECT u.id AS project_id, tier, coalesce(files, 0) AS files FROM u LEFT JOIN m USING (id) JOIN tp USING (id) ORDER BY tier, files DESC, lower(name), u.id LIMIT 15"""
)
def t9_ranked_tests(s: Store) -> DataFrame:
    """The fifteen test projects nearest to a name: those that mention it, by how many files do, then those named for it, then those that depend on what is."""
    t = s.projects.where("is_test").select(F.col("id").alias("project_id"), X.fold("name").alias("name"))
    hit = search.references(s.lines_with(NAME), s.owners, NAME).groupBy("project_id").agg(F.count_distinct("file_id").alias("files")).join(t.select("project_id"), "project_id", "left_semi")
    named = t.where(F.col("name").contains(NAME.lower())).select("project_id", F.lit(2).alias("tier"))
    target = s.projects.where(X.fold("name").contains(NAME.lower())).select(F.col("id").alias("to_id"))
    depend = s.refs.join(target, "to_id", "left_semi").select(F.col("from_id").alias("project_id"), F.lit(3).alias("tier")).distinct().join(t.select("project_id"), "project_id", "left_semi")
    u = hit.select("project_id", F.lit(1).alias("tier")).unionByName(named).unionByName(depend).groupBy("project_id").agg(F.min("tier").alias("tier"))
    j = u.join(hit, "project_id", "left").join(t, "project_id").withColumn("files", F.coalesce("files", F.lit(0)))
    return j.orderBy("tier", F.desc("files"), "name", "project_id").limit(15).select("project_id", "tier", "files")


@query(f"WITH {SY}, a AS (SELECT unnest(string_split(accessors, ';')) AS x FROM s WHERE accessors IS NOT NULL) SELECT string_split(x, '=')[1] AS accessor, string_split(x, '=')[2] AS access, count(*) AS n FROM a GROUP BY 1, 2")
def l10_accessors(s: Store) -> DataFrame:
    """Accessors and their accessibility, from the text that holds them as a map."""
    a = s.symbols.where("accessors is not null").select(F.explode(F.str_to_map("accessors", F.lit(";"), F.lit("="))).alias("accessor", "access"))
    return a.groupBy("accessor", "access").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 10 SECOND, ts) AS start, count(*) AS n, count_if(event_type = 'error') AS errors FROM events GROUP BY 1")
def r12_ten_seconds(s: Store) -> DataFrame:
    """Events in tumbling windows of ten seconds."""
    w = F.window("ts", "10 seconds")
    return s.raw("events").groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "errors")
