"""Navigation queries over files, texts, symbols, projects and graphs, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codeloom.functions import text as X
from codeloom.operators import extract, graph, search, symbols as S
from codeloom.operators.store import CONFIG_NAMES, TYPE_KINDS, Store, lines_of, nearest_config, ordinal_on_line
from codeloom.sources.tables import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a Store under its name, with its SQL."""

    def add(f: Callable[[Store], DataFrame]):
        QUERIES[f.__name__] = lambda spark, d: f(Store(spark, d))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _list(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def _array(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


# pieces of the SQL: the derived tables as common table expressions
C = "c AS (SELECT DISTINCT file_id, content FROM file_contents)"
L = C + r", l AS (SELECT file_id, generate_subscripts(a, 1) AS line_no, regexp_replace(unnest(a), '\r$', '') AS line FROM (SELECT file_id, string_split(content, chr(10)) AS a FROM c))"
SY = "s AS (SELECT DISTINCT * FROM symbols)"
PROJ = r"""pr AS (SELECT DISTINCT * FROM parsed_projects WHERE removed_at IS NULL),
 asked AS (SELECT id AS from_id, unnest(project_ref_rel_paths) AS r, parsed_at, rel_path FROM pr),
 allp AS (SELECT rel_path AS p FROM pr UNION SELECT r FROM asked WHERE r IS NOT NULL),
 n0 AS (SELECT p, regexp_replace(regexp_replace(lower(trim(p)), '[/\\]+', '/', 'g'), '(^|/)(\./)+', '\1', 'g') AS k FROM allp),
 n1 AS (SELECT p, regexp_replace(k, '(^|/)[^/.][^/]*/\.\./', '\1', 'g') AS k FROM n0),
 n2 AS (SELECT p, regexp_replace(k, '(^|/)[^/.][^/]*/\.\./', '\1', 'g') AS k FROM n1),
 norm AS (SELECT p, trim(regexp_replace(k, '(^|/)[^/.][^/]*/\.\./', '\1', 'g'), '/') AS k FROM n2),
 p AS (SELECT *, regexp_replace(k, '/?[^/]*$', '') AS pdir FROM
   (SELECT pr.*, norm.k, row_number() OVER (PARTITION BY norm.k ORDER BY parsed_at DESC, id DESC) AS rn FROM pr JOIN norm ON pr.rel_path = norm.p) WHERE rn = 1),
 refs AS (SELECT DISTINCT a.id AS from_id, b.id AS to_id FROM (SELECT id, unnest(project_ref_rel_paths) AS r FROM p) a JOIN norm ON a.r = norm.p JOIN p b ON b.k = norm.k)"""
OWN = r"""fd AS (SELECT id AS file_id, lang, lower(regexp_replace(path, '/?[^/]*$', '')) AS dir FROM files WHERE lang IN ('cs', 'fs')),
 own AS (SELECT file_id, project_id FROM (SELECT fd.file_id, p.id AS project_id, row_number() OVER (PARTITION BY fd.file_id ORDER BY length(p.pdir) DESC, p.id) AS rn
   FROM fd JOIN p ON p.lang = fd.lang AND (fd.dir = p.pdir OR starts_with(fd.dir, p.pdir || '/') OR p.pdir = '')) WHERE rn = 1)"""
EDGE = r"""be AS (SELECT DISTINCT lower(regexp_extract(regexp_replace(trim(b), '<.*$', ''), '[^.]*$')) AS base_name,
   CASE WHEN contains(b, '<') THEN length(regexp_replace(b, '[^,]', '', 'g')) + 1 ELSE 0 END AS base_arity, id AS derived_id, file_id
  FROM (SELECT id, file_id, unnest(string_split(regexp_extract(signature, ' : (.*)$', 1), ', ')) AS b FROM s WHERE contains(signature, ' : ') AND kind IN """ + _list(TYPE_KINDS) + "))"
POST = C + r", po AS (SELECT token, file_id, count(*) AS tf FROM (SELECT file_id, unnest(regexp_extract_all(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\pL\p{Nd}_]+')) AS token FROM c) GROUP BY ALL)"

# ------------------------------------------------------------ scans and files


@query(f"SELECT id AS file_id, path FROM files WHERE list_has_any(string_split(lower(path), '/'), {_array(X.EXCLUDED_DIRS)})")
def s2_excluded_paths(s: Store) -> DataFrame:
    return s.files.where(X.has_segment("path", X.EXCLUDED_DIRS)).select(F.col("id").alias("file_id"), "path")


@query("SELECT CASE WHEN lang IN ('csproj','fsproj') THEN 'project' WHEN lang = 'sln' THEN 'solution' ELSE lang END AS bucket, count(*) AS files, sum(size)::BIGINT AS bytes FROM files GROUP BY 1")
def s1_scan_buckets(s: Store) -> DataFrame:
    bucket = F.when(F.col("lang").isin("csproj", "fsproj"), "project").when(F.col("lang") == "sln", "solution").otherwise(F.col("lang"))
    return s.files.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query(f"WITH {C} SELECT file_id, length(content) - length(replace(content, chr(10), '')) + 1 AS lines, strlen(content) AS bytes, md5(content) AS digest FROM c WHERE content IS NOT NULL")
def s3_content_facts(s: Store) -> DataFrame:
    c = s.contents.where("content is not null")
    return c.select("file_id", (F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"), F.octet_length("content").cast("long").alias("bytes"), F.md5("content").alias("digest")).distinct()


@query(
    r"""WITH s AS (SELECT DISTINCT file_id, content FROM file_contents JOIN files ON file_id = id WHERE lang IN ('csproj','fsproj')),
 m AS (SELECT file_id, unnest(regexp_extract_all(content, '<PackageReference Include="[^"]*" Version="[^"]*"')) AS x FROM s)
SELECT file_id, regexp_extract(x, 'Include="([^"]*)"', 1) AS package, regexp_extract(x, 'Version="([^"]*)"', 1) AS version, count(*) AS times FROM m GROUP BY ALL"""
)
def s6_package_refs(s: Store) -> DataFrame:
    f = s.files.where(F.col("lang").isin("csproj", "fsproj")).select(F.col("id").alias("f_id"))
    x = s.contents.join(f, F.col("file_id") == F.col("f_id"), "left_semi").distinct().select("file_id", F.explode(F.regexp_extract_all("content", F.lit('<PackageReference Include="[^"]*" Version="[^"]*"'), F.lit(0))).alias("x"))
    return x.groupBy("file_id", F.regexp_extract("x", 'Include="([^"]*)"', 1).alias("package"), F.regexp_extract("x", 'Version="([^"]*)"', 1).alias("version")).agg(F.count("*").alias("times"))


@query(
    r"""WITH s AS (SELECT DISTINCT file_id, content FROM file_contents JOIN files ON file_id = id WHERE lang = 'sln'),
 m AS (SELECT file_id, unnest(regexp_extract_all(content, 'Project\("[^"]*"\) = "[^"]*", "[^"]*"')) AS x FROM s)
SELECT file_id, regexp_extract(x, '= "([^"]*)"', 1) AS name, regexp_extract(x, ', "([^"]*)"', 1) AS member, count(*) AS times FROM m GROUP BY ALL"""
)
def s7_solution_members(s: Store) -> DataFrame:
    f = s.files.where("lang = 'sln'").select(F.col("id").alias("f_id"))
    x = s.contents.join(f, F.col("file_id") == F.col("f_id"), "left_semi").distinct().select("file_id", F.explode(F.regexp_extract_all("content", F.lit(r'Project\("[^"]*"\) = "[^"]*", "[^"]*"'), F.lit(0))).alias("x"))
    return x.groupBy("file_id", F.regexp_extract("x", '= "([^"]*)"', 1).alias("name"), F.regexp_extract("x", ', "([^"]*)"', 1).alias("member")).agg(F.count("*").alias("times"))


@query(
    f"""WITH {SY}, t AS (SELECT file_id, count(*) AS types FROM s WHERE kind IN {_list(TYPE_KINDS)} GROUP BY 1)
SELECT file_id, types FROM t"""
)
def s4_declared_types(s: Store) -> DataFrame:
    """Declarations that the extractor has stored, per file."""
    return s.symbols.where(F.col("kind").isin(*TYPE_KINDS)).groupBy("file_id").agg(F.count("*").alias("types"))


# ----------------------------------------------------- predicates, projections


@query(
    r"""SELECT id AS file_id FROM files WHERE (lower(path) LIKE '%/%store%.cs' ESCAPE '\' OR lower(path) LIKE '%store%.cs' ESCAPE '\')
 AND NOT (lower(path) LIKE '%/third\_party/%' ESCAPE '\' OR lower(path) LIKE 'third\_party/%' ESCAPE '\') AND NOT (lower(path) LIKE '%/%.designer.cs' ESCAPE '\' OR lower(path) LIKE '%.designer.cs' ESCAPE '\')"""
)
def f1_path_filter(s: Store) -> DataFrame:
    return s.files.where(X.path_filter(F.col("path"), "**/*Store*.cs", ("**/third_party/*", "*.Designer.cs"))).select(F.col("id").alias("file_id"))


@query(r"SELECT id AS file_id FROM files WHERE regexp_matches(lower(path), '^(?:[^/]+/)*scripts/[^/]*reader[^/]*\.sql$')")
def l20_build_glob(s: Store) -> DataFrame:
    return s.files.where(X.fold("path").rlike(X.build_glob_regex("**/Scripts/*Reader*.sql"))).select(F.col("id").alias("file_id"))


@query(f"WITH {SY} SELECT id AS symbol_id, name, 'exact' AS mode FROM s WHERE lower(name) = 'ledger' UNION ALL SELECT id, name, 'prefix' FROM s WHERE starts_with(lower(name), 'ledger') UNION ALL SELECT id, name, 'substring' FROM s WHERE contains(lower(name), 'ledger')")
def f3_name_match(s: Store) -> DataFrame:
    out = None
    for mode in ("exact", "prefix", "substring"):
        part = s.symbols.where(S.name_match(F.col("name"), "Ledger", mode)).select(F.col("id").alias("symbol_id"), "name", F.lit(mode).alias("mode"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {SY} SELECT kind, count(*) AS n FROM s WHERE lower(ns) = 'tarn.cargo' OR starts_with(lower(ns), 'tarn.cargo.') GROUP BY 1")
def f5_namespace_subtree(s: Store) -> DataFrame:
    return s.symbols.where(S.namespace_subtree(F.col("ns"), "Tarn.Cargo")).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {SY} SELECT arity, lang, is_generated, count(*) AS n FROM s JOIN files f ON s.file_id = f.id WHERE kind IN ('method','function') AND NOT is_generated GROUP BY ALL")
def f6_scalar_filters(s: Store) -> DataFrame:
    f = s.files.where("not is_generated").select(F.col("id").alias("f_id"), "lang", "is_generated")
    return s.symbols.where(F.col("kind").isin("method", "function")).join(f, F.col("file_id") == F.col("f_id")).groupBy("arity", "lang", "is_generated").agg(F.count("*").alias("n"))


@query(f"WITH {PROJ}, {OWN} SELECT DISTINCT file_id FROM own JOIN p ON own.project_id = p.id WHERE starts_with(lower(p.name), 'tarn.platform')")
def f7_project_scope(s: Store) -> DataFrame:
    named = s.projects.where(X.fold("name").startswith("tarn.platform")).select(F.col("id").alias("p_id"))
    return s.owners.join(named, F.col("project_id") == F.col("p_id"), "left_semi").select("file_id").distinct()


@query(
    f"""WITH {PROJ}, {OWN}, flags AS (SELECT f.id AS file_id, coalesce(f.has_test_attrs, false) AS attr, bool_or(p.is_test) AS test_owner, bool_or(NOT p.is_test) AS live_owner, count(p.id) AS owners
 FROM files f LEFT JOIN own ON own.file_id = f.id LEFT JOIN p ON own.project_id = p.id WHERE f.lang IN ('cs','fs') GROUP BY ALL)
SELECT file_id, CASE WHEN attr OR coalesce(test_owner, false) THEN 'tests' END AS tests, CASE WHEN NOT attr AND (owners = 0 OR live_owner) THEN 'production' END AS production FROM flags"""
)
def f8_test_scope(s: Store) -> DataFrame:
    p = s.projects.select(F.col("id").alias("p_id"), "is_test")
    owned = s.owners.join(p, F.col("project_id") == F.col("p_id"), "left").groupBy(F.col("file_id").alias("o_id")).agg(F.bool_or("is_test").alias("test_owner"), F.bool_or(~F.col("is_test")).alias("live_owner"), F.count("p_id").alias("owners"))
    f = s.files.where(F.col("lang").isin("cs", "fs")).join(owned, F.col("id") == F.col("o_id"), "left")
    attr = F.coalesce("has_test_attrs", F.lit(False))
    return f.select(F.col("id").alias("file_id"), F.when(attr | F.coalesce("test_owner", F.lit(False)), "tests").alias("tests"), F.when(~attr & ((F.coalesce("owners", F.lit(0)) == 0) | F.col("live_owner")), "production").alias("production"))


@query(f"SELECT id AS file_id FROM files WHERE list_has_any(list_slice(string_split(lower(path), '/'), 1, -2), {_array(X.VENDOR_SEGMENTS)})")
def f9_vendor_paths(s: Store) -> DataFrame:
    return s.files.where(X.has_segment("path", X.VENDOR_SEGMENTS, True)).select(F.col("id").alias("file_id"))


@query(
    f"""WITH d AS (SELECT string_split(path, '/') AS a FROM files), k AS (SELECT a, list_min(list_filter(range(1, len(a)), lambda x: lower(a[x]) IN {_list(X.VENDOR_SEGMENTS)})) AS pos FROM d)
SELECT DISTINCT array_to_string(list_slice(a, 1, pos), '/') || '/**' AS exclude FROM k WHERE pos IS NOT NULL ORDER BY 1 LIMIT 50"""
)
def x23_suggested_excludes(s: Store) -> DataFrame:
    """The shallowest vendor directory of each path, distinct; at most 50 are suggested."""
    a = F.split("path", "/")
    marked = F.transform(X.segments("path"), lambda x: x.isin(*X.VENDOR_SEGMENTS).cast("int"))
    at = F.array_position(F.slice(marked, 1, F.greatest(F.size(a) - 1, F.lit(0))), 1).cast("int")
    d = s.files.select(a.alias("a"), at.alias("at")).where("at > 0")
    return d.select(F.concat(F.concat_ws("/", F.slice("a", F.lit(1), F.col("at"))), F.lit("/**")).alias("exclude")).distinct().orderBy("exclude").limit(50)


@query(
    f"""WITH {C} SELECT f.id AS file_id, coalesce(list_bool_or(list_transform({_array(X.GENERATED_SUFFIXES)}, lambda x: ends_with(lower(f.path), x))), false)
  OR coalesce(contains(lower(substr(content, 1, 400)), '<auto-generated') OR contains(lower(substr(content, 1, 400)), '<autogenerated'), false) AS generated
FROM files f JOIN c ON c.file_id = f.id"""
)
def f10_generated_rule(s: Store) -> DataFrame:
    f = s.files.select("id", "path")
    return f.join(s.contents, f["id"] == F.col("file_id")).select("file_id", X.looks_generated("path", "content").alias("generated")).distinct()


@query(
    f"""WITH {PROJ}, {OWN}, att AS (SELECT DISTINCT project_id FROM own JOIN files f ON f.id = own.file_id WHERE f.has_test_attrs),
 lead AS (SELECT id, name, lang, is_test OR (id IN (SELECT project_id FROM att) AND id NOT IN (SELECT to_id FROM refs)) AS t FROM p)
SELECT id AS project_id, bool_or(t) OVER (PARTITION BY lower(name), lang) AS is_test FROM lead"""
)
def f11_test_projects(s: Store) -> DataFrame:
    """Test projects: by their own markers, or as graph leaves that compile files with test attributes; then all of one name and language."""
    attr = s.files.where("has_test_attrs").select(F.col("id").alias("a_id"))
    has = s.owners.join(attr, F.col("file_id") == F.col("a_id"), "left_semi").select(F.col("project_id").alias("h_id")).distinct()
    used = s.refs.select(F.col("to_id").alias("u_id")).distinct()
    p = s.projects.join(has, F.col("id") == F.col("h_id"), "left").join(used, F.col("id") == F.col("u_id"), "left")
    lead = F.col("is_test") | (F.col("h_id").isNotNull() & F.col("u_id").isNull())
    w = Window.partitionBy(X.fold("name"), "lang")
    return p.select(F.col("id").alias("project_id"), F.bool_or(lead).over(w).alias("is_test"))


@query(f"WITH {L} SELECT file_id, line_no FROM l WHERE regexp_matches(line, 'private static .*\\bstring\\b.*;')")
def f12_regex_lines(s: Store) -> DataFrame:
    return search.regex_lines(s.lines_with("private static ", "string"), r"private static .*\bstring\b.*;").select("file_id", "line_no")


@query(f"WITH {L} SELECT file_id, line_no FROM l WHERE regexp_matches(lower(line), '(^|[^\\pL\\p{{Nd}}_])journal([^\\pL\\p{{Nd}}_]|$)')")
def f13_whole_token(s: Store) -> DataFrame:
    return s.lines_with_folded("journal").where(X.whole_token(F.col("line"), "Journal")).select("file_id", "line_no").distinct()


@query(f"WITH {C} SELECT file_id, CASE WHEN length(content) <= 500 THEN content END AS content FROM c")
def f14_bounded_content(s: Store) -> DataFrame:
    return s.contents.select("file_id", X.bounded(F.col("content"), 500).alias("content")).distinct()


@query(f"WITH {L}, t AS (SELECT file_id, line_no, regexp_replace(line, '\\s+$', '') AS x FROM l WHERE length(line) > 200) SELECT file_id, line_no, CASE WHEN length(x) > 240 THEN substr(x, 1, 240) || '…' ELSE x END AS snippet FROM t")
def f15_snippets(s: Store) -> DataFrame:
    return s.lines.where(F.length("line") > 200).select("file_id", "line_no", X.snippet(F.col("line")).alias("snippet")).distinct()


@query("SELECT count(*) AS n, sum(hash & 4294967295)::BIGINT AS low, sum((hash >> 32) & 4294967295)::BIGINT AS high FROM files WHERE hash IS NOT NULL")
def a3_fingerprint(s: Store) -> DataFrame:
    """Count and sums of the halves of the content hashes, left apart so that nothing wraps."""
    h = F.col("hash")
    return s.files.where("hash is not null").agg(F.count("*").alias("n"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftright(h, 32).bitwiseAND(F.lit(0xFFFFFFFF))).alias("high"))


# ---------------------------------------------------------------------- joins


@query(f"WITH {SY} SELECT f.path, count(*) AS symbols FROM s JOIN files f ON s.file_id = f.id GROUP BY 1")
def j1_symbols_per_file(s: Store) -> DataFrame:
    f = s.files.select(F.col("id").alias("f_id"), "path")
    return s.symbols.groupBy("file_id").agg(F.count("*").alias("symbols")).join(f, F.col("file_id") == F.col("f_id")).select("path", "symbols")


@query(f"WITH {PROJ}, {OWN} SELECT p.name, f.path FROM own JOIN p ON p.id = own.project_id JOIN files f ON f.id = own.file_id")
def j2_project_files(s: Store) -> DataFrame:
    p = s.projects.select(F.col("id").alias("p_id"), "name")
    f = s.files.select(F.col("id").alias("f_id"), "path")
    return s.owners.join(p, F.col("project_id") == F.col("p_id")).join(f, F.col("file_id") == F.col("f_id")).select("name", "path")


@query(f"WITH {PROJ}, {OWN} SELECT f.id AS file_id, f.path FROM files f WHERE lang IN ('cs','fs') AND NOT EXISTS (SELECT 1 FROM own WHERE own.file_id = f.id)")
def j6_orphan_files(s: Store) -> DataFrame:
    f = s.files.where(F.col("lang").isin("cs", "fs")).select(F.col("id").alias("file_id"), "path")
    return f.join(s.owners, "file_id", "left_anti")


@query(f"WITH {PROJ} SELECT id AS project_id, name FROM p WHERE id NOT IN (SELECT to_id FROM refs)")
def j7_leaf_projects(s: Store) -> DataFrame:
    used = s.refs.select(F.col("to_id").alias("u"))
    return s.projects.join(used, F.col("id") == F.col("u"), "left_anti").select(F.col("id").alias("project_id"), "name")


@query(f"WITH {PROJ} SELECT a.name AS from_name, b.name AS to_name FROM refs JOIN p a ON a.id = from_id JOIN p b ON b.id = to_id")
def j8_named_edges(s: Store) -> DataFrame:
    a = s.projects.select(F.col("id").alias("from_id"), F.col("name").alias("from_name"))
    b = s.projects.select(F.col("id").alias("to_id"), F.col("name").alias("to_name"))
    return s.refs.join(a, "from_id").join(b, "to_id").select("from_name", "to_name")


@query(
    f"""WITH {PROJ}, cf AS (SELECT path AS config_path, lower(regexp_replace(path, '/?[^/]*$', '')) AS cdir, lower(regexp_extract(path, '[^/]*$')) AS config_name FROM files WHERE lower(regexp_extract(path, '[^/]*$')) IN {_list(CONFIG_NAMES)})
SELECT project_id, config_name, config_path FROM (SELECT p.id AS project_id, config_name, config_path, row_number() OVER (PARTITION BY p.id, config_name ORDER BY length(cdir) DESC, config_path DESC) AS rn
 FROM p JOIN cf ON p.pdir = cdir OR cdir = '' OR starts_with(p.pdir, cdir || '/')) WHERE rn = 1"""
)
def j11_nearest_config(s: Store) -> DataFrame:
    return nearest_config(s.projects, s.configs)


@query(f"WITH {PROJ}, {OWN} SELECT file_id, project_id FROM own")
def j12_owners(s: Store) -> DataFrame:
    return s.owners


@query(
    f"""WITH {L}, {SY}, pt AS (SELECT file_id, line_no FROM l WHERE contains(line, 'throw new '))
SELECT file_id, line_no, symbol_id FROM (SELECT pt.file_id, pt.line_no, s.id AS symbol_id, row_number() OVER (PARTITION BY pt.file_id, pt.line_no ORDER BY end_line - start_line, start_line DESC, s.id) AS rn
 FROM pt JOIN s ON s.file_id = pt.file_id AND pt.line_no BETWEEN start_line AND end_line) WHERE rn = 1"""
)
def j14_innermost(s: Store) -> DataFrame:
    return S.innermost(s.lines_with("throw new ").where(F.col("line").contains("throw new ")), s.symbols)


RANGES = "rg AS (SELECT id AS file_id, 10 + (id % 20)::INT AS first, 24 + (id % 20)::INT AS last FROM files WHERE lang IN ('cs','fs'))"


def _ranges(s: Store) -> DataFrame:
    """Changed line ranges, one a source file."""
    at = (F.col("id") % 20).cast("int")
    return s.files.where(F.col("lang").isin("cs", "fs")).select(F.col("id").alias("file_id"), (at + 10).alias("first"), (at + 24).alias("last"))


@query(f"WITH {SY}, {RANGES} SELECT rg.file_id, first, last, s.id AS symbol_id FROM rg JOIN s ON s.file_id = rg.file_id AND start_line <= last AND end_line >= first")
def j15_intersecting(s: Store) -> DataFrame:
    return S.intersecting(_ranges(s), s.symbols).select("file_id", "first", "last", "symbol_id")


@query(
    f"""WITH {SY}, {RANGES}, t AS (SELECT rg.file_id, first, last, s.id, s.kind, s.parent_id, first <= start_line AND last >= end_line AS whole FROM rg JOIN s ON s.file_id = rg.file_id AND start_line <= last AND end_line >= first WHERE kind <> 'namespace'),
 kept AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.whole AND u.kind IN {_list(TYPE_KINDS)} AND u.file_id = t.file_id AND u.id = t.parent_id))
SELECT file_id, id AS symbol_id FROM kept k WHERE whole OR NOT EXISTS (SELECT 1 FROM kept q WHERE q.file_id = k.file_id AND q.parent_id = k.id)"""
)
def y10_reviewable(s: Store) -> DataFrame:
    return S.reviewable(S.intersecting(_ranges(s), s.symbols)).select("file_id", "symbol_id")


@query(
    f"""WITH {SY}, t AS (SELECT *, min(id) OVER w AS class_id, count(*) OVER w AS members, min(file_id) OVER w <> max(file_id) OVER w AS apart FROM s WHERE is_partial WINDOW w AS (PARTITION BY kind, name, ns, container))
SELECT id AS symbol_id, class_id, members FROM t WHERE apart"""
)
def j17_partial_siblings(s: Store) -> DataFrame:
    """Partial declarations of one identity over several files: each with its class (the least id) and the class's size; nulls are equal to nulls. Pairs would be quadratic in a class."""
    key = ["kind", "name", "ns", "container"]
    t = s.symbols.where("is_partial").select("id", "file_id", *key)
    c = t.groupBy(*[F.col(k).alias(f"c_{k}") for k in key]).agg(F.min("id").alias("class_id"), F.count("*").alias("members"), (F.min("file_id") != F.max("file_id")).alias("apart")).where("apart")
    same = None
    for k in key:
        test = t[k].eqNullSafe(c[f"c_{k}"])
        same = test if same is None else same & test
    return t.join(c, same).select(F.col("id").alias("symbol_id"), "class_id", "members")


@query(
    f"""WITH st AS (SELECT path, hash FROM (SELECT path, hash, row_number() OVER (PARTITION BY path ORDER BY run_id DESC, attempt DESC, recorded_at DESC, checkpoint_id DESC) AS rn FROM file_checkpoints) WHERE rn = 1)
SELECT coalesce(f.path, st.path) AS path, CASE WHEN st.path IS NULL THEN 'added' WHEN f.path IS NULL THEN 'deleted' WHEN f.hash IS NOT DISTINCT FROM st.hash THEN 'same' ELSE 'changed' END AS change FROM files f FULL JOIN st ON f.path = st.path"""
)
def j18_snapshot_diff(s: Store) -> DataFrame:
    c = s.raw("file_checkpoints")
    last = c.groupBy(F.col("path").alias("s_path")).agg(F.max(F.struct("run_id", "attempt", "recorded_at", "checkpoint_id", "hash")).alias("v")).select("s_path", F.col("v.hash").alias("s_hash"))
    j = s.files.select("path", "hash").join(last, F.col("path") == F.col("s_path"), "full")
    return j.select(F.coalesce("path", "s_path").alias("path"), F.when(F.col("s_path").isNull(), "added").when(F.col("path").isNull(), "deleted").when(F.col("hash").eqNullSafe(F.col("s_hash")), "same").otherwise("changed").alias("change"))


@query(f"WITH {SY}, w AS (SELECT DISTINCT coalesce(ns, '') AS ns, name FROM s WHERE kind = 'interface') SELECT s.id AS symbol_id FROM s WHERE (coalesce(s.ns, ''), coalesce(s.container, '')) IN (SELECT (ns, name) FROM w)")
def j19_members_of(s: Store) -> DataFrame:
    """Members of the types of a set of (namespace, name) pairs: a semi-join on a composite key."""
    w = s.symbols.where("kind = 'interface'").select(F.coalesce("ns", F.lit("")).alias("w_ns"), F.col("name").alias("w_name")).distinct()
    return s.symbols.join(w, (F.coalesce("ns", F.lit("")) == F.col("w_ns")) & (F.coalesce("container", F.lit("")) == F.col("w_name")), "left_semi").select(F.col("id").alias("symbol_id"))


# --------------------------------------------------------------- aggregations


@query(
    f"""WITH {PROJ}, {OWN}, {SY}, a AS (SELECT count(*) AS files, count_if(lang = 'cs') AS cs_files, count_if(lang = 'fs') AS fs_files, count_if(is_generated) AS generated, sum(line_count)::BIGINT AS lines FROM files),
 b AS (SELECT count(*) AS symbols FROM s), d AS (SELECT count(*) AS projects, count_if(is_test) AS test_projects, count_if(starts_with(load_status, 'failed')) AS failed FROM p), e AS (SELECT count(*) AS edges FROM refs), o AS (SELECT count(*) AS owned FROM own)
SELECT * FROM a, b, d, e, o"""
)
def a1_overview(s: Store) -> DataFrame:
    """The counts of a workspace, one row that is kept; each part is a one-row aggregate, so the products are of single rows."""
    return s.kept.table("overview", lambda: _overview(s))


def _overview(s: Store) -> DataFrame:
    a = s.files.agg(F.count("*").alias("files"), F.count_if(F.col("lang") == "cs").alias("cs_files"), F.count_if(F.col("lang") == "fs").alias("fs_files"), F.count_if("is_generated").alias("generated"), F.sum("line_count").alias("lines"))
    b = s.symbols.agg(F.count("*").alias("symbols"))
    d = s.projects.agg(F.count("*").alias("projects"), F.count_if("is_test").alias("test_projects"), F.count_if(F.col("load_status").startswith("failed")).alias("failed"))
    return a.crossJoin(b).crossJoin(d).crossJoin(s.refs.agg(F.count("*").alias("edges"))).crossJoin(s.owners.agg(F.count("*").alias("owned")))


@query(f"WITH {PROJ} SELECT tfms, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, tfms LIMIT 6")
def a1_frameworks(s: Store) -> DataFrame:
    """The six most frequent framework lists."""
    return s.projects.groupBy("tfms").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tfms").limit(6)


@query(
    """SELECT count(*) AS files, sum(total_contexts)::BIGINT AS contexts, sum(processed_contexts)::BIGINT AS processed, count_if(truncated_contexts > 0) AS truncated_files, count_if(failed_contexts > 0) AS failed_files, sum(option_project_count)::BIGINT AS option_projects,
 (SELECT string_agg(r, ';' ORDER BY r) FROM (SELECT DISTINCT unnest(string_split(option_partial_reasons, ';')) AS r FROM fsharp_parse_coverage WHERE option_partial_reasons <> '')) AS reasons FROM fsharp_parse_coverage"""
)
def a2_parse_coverage(s: Store) -> DataFrame:
    c = s.raw("fsharp_parse_coverage").dropDuplicates(["file_id"])
    reasons = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split(F.expr("nullif(option_partial_reasons, '')"), ";"))))), ";")
    return c.agg(F.count("*").alias("files"), F.sum("total_contexts").alias("contexts"), F.sum("processed_contexts").alias("processed"), F.count_if(F.col("truncated_contexts") > 0).alias("truncated_files"), F.count_if(F.col("failed_contexts") > 0).alias("failed_files"), F.sum("option_project_count").alias("option_projects"), reasons.alias("reasons"))


NAME = "Cluster"
REFS = f"{PROJ}, {OWN}, {L}, rf AS (SELECT l.file_id, line_no, line, project_id FROM l LEFT JOIN own ON own.file_id = l.file_id WHERE regexp_matches(line, '(^|[^\\pL\\p{{Nd}}_]){NAME}([^\\pL\\p{{Nd}}_]|$)'))"


def _references(s: Store) -> DataFrame:
    return search.references(s.lines_with(NAME), s.owners, NAME)


@query(f"WITH {REFS} SELECT project_id, count(*) AS hits, count(DISTINCT rf.file_id) AS files, count_if(f.has_test_attrs) AS test_hits FROM rf JOIN files f ON f.id = rf.file_id GROUP BY 1")
def a5_reference_counts(s: Store) -> DataFrame:
    f = s.files.select(F.col("id").alias("f_id"), "has_test_attrs")
    return _references(s).join(f, F.col("file_id") == F.col("f_id")).groupBy("project_id").agg(F.count("*").alias("hits"), F.count_distinct("file_id").alias("files"), F.count_if("has_test_attrs").alias("test_hits"))


@query(
    f"""WITH {REFS}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY file_id, line_no) AS rn FROM rf)
SELECT project_id, count(*) AS hits, string_agg(file_id || ':' || line_no, ',' ORDER BY file_id, line_no) FILTER (rn <= 3) AS samples FROM r GROUP BY 1"""
)
def a6_grouped_samples(s: Store) -> DataFrame:
    g = search.grouped_samples(_references(s), "project_id", 3)
    return g.select("project_id", "hits", F.array_join(F.transform("samples", lambda x: F.concat_ws(":", x["file_id"], x["line_no"])), ",").alias("samples"))


@query(f"WITH {REFS} SELECT CASE WHEN regexp_matches(line, '(^|[^\\pL\\p{{Nd}}_]){NAME}\\(') THEN 3 WHEN regexp_matches(line, '(^|[^\\pL\\p{{Nd}}_]){NAME}[<.]') OR regexp_matches(line, '[:<.]{NAME}([^\\pL\\p{{Nd}}_]|$)') OR regexp_matches(line, 'new {NAME}([^\\pL\\p{{Nd}}_]|$)') THEN 2 ELSE 1 END AS tier, count(*) AS hits FROM rf GROUP BY 1")
def x14_usage_tiers(s: Store) -> DataFrame:
    return _references(s).groupBy(search.usage_tier(F.col("line"), NAME).alias("tier")).agg(F.count("*").alias("hits"))


@query(f"WITH {REFS} SELECT rf.file_id, line_no FROM rf")
def x11_references(s: Store) -> DataFrame:
    return _references(s).select("file_id", "line_no")


@query(f"WITH {SY} SELECT kind, arity, count(*) AS n FROM s GROUP BY 1, 2")
def a10_kinds(s: Store) -> DataFrame:
    return s.symbols.groupBy("kind", "arity").agg(F.count("*").alias("n"))


@query(f"WITH {SY} SELECT name, count(*) AS n FROM s GROUP BY 1 HAVING count(*) > 2")
def a11_vocabulary(s: Store) -> DataFrame:
    return s.symbols.groupBy("name").agg(F.count("*").alias("n")).where("n > 2")


@query(f"WITH {PROJ} SELECT name, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) ELSE 'mixed' END AS lang, bool_or(is_test) AS any_test, bool_and(is_test) AS all_test FROM p GROUP BY 1")
def a13_language_map(s: Store) -> DataFrame:
    return s.projects.groupBy("name").agg(F.when(F.count_distinct("lang") == 1, F.min("lang")).otherwise("mixed").alias("lang"), F.bool_or("is_test").alias("any_test"), F.bool_and("is_test").alias("all_test"))


@query(f"WITH {PROJ}, {OWN} SELECT project_id, count(*) AS files, sum(f.size)::BIGINT AS bytes, max(f.size)::BIGINT AS largest, count_if(f.is_generated) * 100 + sum(f.line_count)::BIGINT AS charge FROM own JOIN files f ON f.id = own.file_id GROUP BY 1")
def a15_planning_charge(s: Store) -> DataFrame:
    f = s.files.select(F.col("id").alias("f_id"), "size", "is_generated", "line_count")
    return s.owners.join(f, F.col("file_id") == F.col("f_id")).groupBy("project_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("size").alias("largest"), (F.count_if("is_generated") * 100 + F.sum("line_count")).alias("charge"))


# -------------------------------------------------------------------- windows


@query(f"WITH {SY} SELECT id AS symbol_id, row_number() OVER (PARTITION BY file_id, start_line ORDER BY id) - 1 AS ordinal FROM s")
def w2_ordinal_on_line(s: Store) -> DataFrame:
    return ordinal_on_line(s.symbols).select(F.col("id").alias("symbol_id"), F.col("ordinal").cast("long").alias("ordinal"))


@query(f"WITH {PROJ} SELECT id AS project_id, count(*) OVER (PARTITION BY name) AS of_name FROM p")
def w1_name_counts(s: Store) -> DataFrame:
    return s.projects.select(F.col("id").alias("project_id"), F.count("*").over(Window.partitionBy("name")).alias("of_name"))


@query(
    f"""WITH {L}, h AS (SELECT file_id, line_no FROM l WHERE contains(line, 'await Task.Yield')),
 x AS (SELECT file_id, line_no, array_to_string(list(line) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), chr(10)) AS before, array_to_string(list(line) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), chr(10)) AS after FROM l)
SELECT x.file_id, x.line_no, coalesce(before, '') AS before, coalesce(after, '') AS after FROM x JOIN h USING (file_id, line_no)"""
)
def w5_context_lines(s: Store) -> DataFrame:
    lines = s.lines_with("await Task.Yield")
    return search.context_lines(lines, lines.where(F.col("line").contains("await Task.Yield")), 2, 2).select("file_id", "line_no", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"))


# ------------------------------------------------------- rankings and paging


@query(
    f"""WITH {SY} SELECT s.id AS symbol_id, name, kind, path, CASE WHEN lower(name) = 'anchor' THEN 0 WHEN starts_with(lower(name), 'anchor') THEN 1 ELSE 2 END AS match_class,
 CASE WHEN lower(name) = 'anchor' AND kind IN {_list(TYPE_KINDS)} THEN 0 WHEN lower(name) = 'anchor' THEN 1 ELSE 2 END AS type_class, is_generated::INT AS generated
FROM s JOIN files f ON f.id = s.file_id WHERE contains(lower(name), 'anchor') ORDER BY match_class, type_class, generated, length(name), name, path, symbol_id LIMIT 50"""
)
def y1_search_symbols(s: Store) -> DataFrame:
    return S.search(s.symbols, s.files, "Anchor", 50)


@query(f"WITH {SY}, m AS (SELECT id, name, CASE WHEN lower(name) = 'drain' THEN 0 WHEN starts_with(lower(name), 'drain') THEN 1 ELSE 2 END AS match_class FROM s WHERE contains(lower(name), 'drain')) SELECT id AS symbol_id, match_class FROM m WHERE match_class = (SELECT min(match_class) FROM m)")
def y2_auto_ladder(s: Store) -> DataFrame:
    return S.best_match_class(s.symbols, "Drain").select(F.col("id").alias("symbol_id"), "match_class")


@query(r"SELECT path, is_generated FROM files WHERE lower(path) LIKE '%/%reader%.cs' ESCAPE '\' ORDER BY is_generated, length(path), path LIMIT 40")
def x21_find_file(s: Store) -> DataFrame:
    return s.files.where(X.path_filter(F.col("path"), "*Reader*.cs")).select("path", "is_generated").orderBy("is_generated", F.length("path"), "path").limit(40)


WANTED = "quay-portal/src/Tarn.Anchor.Store/PolicyReader.cs"


@query(
    f"""WITH w AS (SELECT string_split('{WANTED.lower()}', '/') AS w), s AS (SELECT path, string_split(lower(path), '/') AS a, w FROM files, w),
 k AS (SELECT path, a, w, least(len(a), len(w)) AS n FROM s),
 c AS (SELECT path, len(a) AS la, len(w) AS lw, n, list_position(list_transform(range(1, n + 1), lambda i: a[i] = w[i]), false) AS p, list_position(list_transform(range(1, n + 1), lambda i: a[len(a) + 1 - i] = w[len(w) + 1 - i]), false) AS q FROM k)
SELECT path, (CASE WHEN coalesce(q, 0) = 0 THEN n ELSE q - 1 END)::INT AS suffix, (CASE WHEN coalesce(p, 0) = 0 THEN n ELSE p - 1 END)::INT AS prefix, abs(la - lw)::INT AS off
FROM c ORDER BY suffix DESC, prefix DESC, off, length(path), path LIMIT 10"""
)
def t6_path_suggestions(s: Store) -> DataFrame:
    """The ten stored paths most like one that does not exist."""
    return search.path_suggestions(s.files, WANTED, 10)


@query(f"WITH {SY} SELECT id AS symbol_id, name FROM s WHERE kind = 'class' ORDER BY name, symbol_id LIMIT 21 OFFSET 20")
def t12_offset_page(s: Store) -> DataFrame:
    """A page of 20 and one row more that tells whether another follows."""
    return s.symbols.where("kind = 'class'").select(F.col("id").alias("symbol_id"), "name").orderBy("name", "symbol_id").offset(20).limit(21)


@query(f"WITH {PROJ}, {OWN} SELECT p.name, count(DISTINCT own.file_id) AS files FROM own JOIN p ON p.id = own.project_id GROUP BY 1 ORDER BY files DESC, lower(name), name LIMIT 15")
def t8_candidate_projects(s: Store) -> DataFrame:
    p = s.projects.select(F.col("id").alias("p_id"), "name")
    return s.owners.join(p, F.col("project_id") == F.col("p_id")).groupBy("name").agg(F.count_distinct("file_id").alias("files")).orderBy(F.desc("files"), X.fold("name"), "name").limit(15)


# ------------------------------------------------------------- set operations


@query("SELECT path FROM file_checkpoints EXCEPT SELECT path FROM files")
def u5_deleted_paths(s: Store) -> DataFrame:
    return s.raw("file_checkpoints").select("path").distinct().join(s.files.select("path"), "path", "left_anti")


@query("SELECT path FROM files UNION SELECT path FROM file_checkpoints")
def u4_union_paths(s: Store) -> DataFrame:
    return s.files.select("path").union(s.raw("file_checkpoints").select("path")).distinct()


@query(
    f"""WITH {SY}, tg AS (SELECT id AS key, start_line AS first, end_line AS last FROM s WHERE kind IN ('class','struct')), cv AS (SELECT tg.key, m.start_line AS first, m.end_line AS last FROM tg JOIN s m ON m.parent_id = tg.key),
 marks AS (SELECT tg.key, tg.first, tg.last, greatest(cv.first, tg.first) AS a, least(cv.last, tg.last) AS b FROM tg JOIN cv ON cv.key = tg.key AND cv.first <= tg.last AND cv.last >= tg.first
  UNION ALL SELECT key, first, last, first - 1, first - 1 FROM tg UNION ALL SELECT key, first, last, last + 1, last + 1 FROM tg),
 far AS (SELECT key, a, max(b) OVER (PARTITION BY key, first, last ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM marks)
SELECT key, far + 1 AS gap_first, a - 1 AS gap_last FROM far WHERE a > far + 1"""
)
def u6_uncovered_lines(s: Store) -> DataFrame:
    """Lines of types that none of their members covers."""
    t = s.symbols.where(F.col("kind").isin("class", "struct")).select(F.col("id").alias("key"), F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    m = s.symbols.where("parent_id is not null").select(F.col("parent_id").alias("key"), F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    return S.uncovered(t, m)


@query(f"WITH {SY}, k AS (SELECT file_id, string_agg(coalesce(declaration_key, ''), chr(10) ORDER BY coalesce(declaration_key, '')) AS keys, count(*) AS n FROM s GROUP BY 1) SELECT a.file_id, b.file_id AS same_as FROM k a JOIN k b ON a.keys = b.keys AND a.file_id < b.file_id WHERE a.n > 1 AND a.file_id = (SELECT min(file_id) FROM k c WHERE c.keys = a.keys)")
def u7_equal_declarations(s: Store) -> DataFrame:
    """Files whose declarations are the same multiset as an earlier file's: each with the first file of its class."""
    k = s.symbols.groupBy("file_id").agg(F.array_sort(F.collect_list(F.coalesce("declaration_key", F.lit("")))).alias("keys"), F.count("*").alias("n")).where("n > 1")
    digest = k.select("file_id", F.sha2(F.array_join("keys", "\n"), 256).alias("digest"))
    first = digest.groupBy("digest").agg(F.min("file_id").alias("first"))
    return digest.join(first, "digest").where("file_id <> first").select(F.col("first").alias("file_id"), F.col("file_id").alias("same_as"))


# -------------------------------------------------------------------- search


SEARCH = ["collect", "quota"]
BM = f"""{POST}, q AS (SELECT * FROM po WHERE token IN {_list(SEARCH)}), dl AS (SELECT file_id, sum(tf) AS dl FROM po GROUP BY 1), k AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl), df AS (SELECT token, count(*) AS df FROM q GROUP BY 1),
 bm AS (SELECT q.file_id, sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN df USING (token) JOIN dl ON dl.file_id = q.file_id, k GROUP BY q.file_id HAVING count(*) = {len(SEARCH)})"""


def _ranked(s: Store) -> DataFrame:
    return search.bm25(s.postings_of(SEARCH), s.lengths, s.corpus, SEARCH)


@query(f"WITH {BM} SELECT file_id, round(score, 6) AS score FROM bm")
def x3_bm25(s: Store) -> DataFrame:
    return _ranked(s).select("file_id", F.round("score", 6).alias("score"))


@query(f"WITH {BM} SELECT bm.file_id, path FROM bm JOIN files f ON f.id = bm.file_id ORDER BY is_generated, round(score, 6) DESC, bm.file_id LIMIT 31")
def t3_candidates(s: Store) -> DataFrame:
    """The best 30 candidates and one more that tells of others."""
    f = s.files.select(F.col("id").alias("f_id"), "path", "is_generated")
    return _ranked(s).join(f, F.col("file_id") == F.col("f_id")).orderBy("is_generated", F.desc(F.round("score", 6)), "file_id").limit(31).select("file_id", "path")


@query(f"WITH {POST} SELECT token, count(*) AS files, sum(tf)::BIGINT AS times FROM po GROUP BY 1")
def k2_postings(s: Store) -> DataFrame:
    """The text index in short: of each token the files that hold it and how often it stands."""
    return s.postings.groupBy("token").agg(F.count("*").alias("files"), F.sum("tf").alias("times"))


@query(f"WITH {BM} SELECT file_id, round(score, 6) AS score FROM bm")
def x3_bm25_scan(s: Store) -> DataFrame:
    """BM25 by one scan of the texts, as where no index is kept."""
    return search.scan_bm25(s.contents, SEARCH, Scratch(s.spark, "bm25")).select("file_id", F.round("score", 6).alias("score"))


@query(f"WITH {POST} SELECT file_id FROM po WHERE token IN {_list(SEARCH)} GROUP BY 1 HAVING count(*) = {len(SEARCH)}")
def x2_conjunctive_match(s: Store) -> DataFrame:
    return search.holding_all(s.postings_of(SEARCH), SEARCH)


def _has(t: str) -> str:
    return f"regexp_matches(lower(line), '(^|[^\\pL\\p{{Nd}}_]){t}([^\\pL\\p{{Nd}}_]|$)')"


@query(
    f"""WITH {L}, po AS (SELECT DISTINCT file_id FROM (SELECT file_id, regexp_extract_all(lower(content), '[\\pL\\p{{Nd}}_]+') AS a FROM c) WHERE list_contains(a, 'quota') AND list_contains(a, 'ledger')),
 g AS (SELECT file_id, line_no, line, {_has("quota")} AS h0, {_has("ledger")} AS h1 FROM l WHERE file_id IN (SELECT file_id FROM po)),
 k AS (SELECT *, bool_or(h0 AND h1) OVER (PARTITION BY file_id) AS any_precise FROM g WHERE h0 OR h1),
 t AS (SELECT file_id, min(line_no) FILTER (h0) AS l0, arg_min(h1, line_no) FILTER (h0) AS c1, min(line_no) FILTER (h1) AS l1 FROM k WHERE NOT any_precise GROUP BY 1)
SELECT file_id, line_no, CASE WHEN contains(lower(line), 'quota ledger') THEN 0 ELSE 1 END AS tier FROM k WHERE h0 AND h1
UNION ALL SELECT file_id, l0, 2 FROM t WHERE l0 IS NOT NULL UNION ALL SELECT file_id, l1, 2 FROM t WHERE l1 IS NOT NULL AND NOT coalesce(c1, false)"""
)
def x6_graded_lines(s: Store) -> DataFrame:
    candidates = s.texts_holding(["quota", "ledger"])
    return search.graded(lines_of(candidates), "quota ledger").select("file_id", "line_no", "tier")


# fixed values: languages that a regular expression is searched in
SEARCHED = ("cs", "fs", "md", "sql", "csproj", "fsproj", "sln", "config")


@query(f"WITH {L} SELECT file_id, line_no FROM l WHERE regexp_matches(line, '\\bpublic\\b \\bstatic\\b .*\\(Guid [a-z]+')")
def x8_regex_search(s: Store) -> DataFrame:
    """A regular expression whose required literals prune the files first."""
    pattern = r"\bpublic\b \bstatic\b .*\(Guid [a-z]+"
    return search.regex_lines(lines_of(s.texts_holding(X.required_literals(pattern))), pattern).select("file_id", "line_no")


@query(f"WITH {SY} SELECT name, count(*) AS n FROM s WHERE length(name) BETWEEN 5 AND 7 AND starts_with(lower(name), 'a') AND damerau_levenshtein(lower(name), 'anhcor') = 1 GROUP BY 1")
def x16_near_misses(s: Store) -> DataFrame:
    return search.near_misses(s.symbols, "Anhcor")


@query(f"WITH {L} SELECT l.file_id, line_no FROM l JOIN files f ON f.id = l.file_id WHERE f.lang = 'config' AND {_has('limit')}")
def x20_config_lookup(s: Store) -> DataFrame:
    f = s.files.where("lang = 'config'").select(F.col("id").alias("f_id"))
    return s.lines_with_folded("limit").join(f, F.col("file_id") == F.col("f_id"), "left_semi").where(X.whole_token(F.col("line"), "Limit")).select("file_id", "line_no").distinct()


@query("SELECT DISTINCT lang FROM files WHERE lang IN ('cs','fs','sql','md')")
def x22_languages(s: Store) -> DataFrame:
    return s.files.where(F.col("lang").isin("cs", "fs", "sql", "md")).select("lang").distinct()


# ------------------------------------------------- symbols and implementations


@query(f"WITH {SY} SELECT file_id, id AS symbol_id, row_number() OVER (PARTITION BY file_id ORDER BY start_line, end_line DESC, id) AS place, CASE WHEN container IS NULL THEN 0 ELSE length(container) - length(replace(container, '.', '')) + 1 END AS nesting FROM s")
def y5_outline(s: Store) -> DataFrame:
    w = Window.partitionBy("file_id").orderBy("start_line", F.desc("end_line"), "id")
    nesting = F.when(F.col("container").isNull(), 0).otherwise(F.size(F.split("container", r"\.")))
    return s.symbols.select("file_id", F.col("id").alias("symbol_id"), F.row_number().over(w).cast("long").alias("place"), nesting.cast("long").alias("nesting"))


@query(
    f"""WITH RECURSIVE {SY}, e AS (SELECT s.id, s.parent_id AS par FROM s WHERE parent_id IN (SELECT id FROM s)),
 r AS (SELECT id AS symbol_id, par AS ancestor_id, 1 AS hops FROM e UNION ALL SELECT r.symbol_id, e.par, hops + 1 FROM r JOIN e ON r.ancestor_id = e.id WHERE hops < 16)
SELECT symbol_id, ancestor_id, hops FROM r"""
)
def y7_ancestors(s: Store) -> DataFrame:
    return S.ancestors(s.symbols, Scratch(s.spark, "ancestors"))


@query(f"WITH {SY}, {EDGE} SELECT DISTINCT derived_id AS symbol_id FROM be WHERE base_name = 'icursor'")
def y13_implementers(s: Store) -> DataFrame:
    return S.implementers(s.base_edges, s.symbols, "ICursor").select(F.col("id").alias("symbol_id"))


@query(
    f"""WITH RECURSIVE {SY}, {EDGE}, e AS (SELECT DISTINCT base_name, base_arity, derived_id, lower(name) AS t_name, coalesce(arity, 0) AS t_arity FROM be JOIN s ON s.id = derived_id WHERE kind IN {_list(TYPE_KINDS)}), most AS (SELECT count(*) AS n FROM e),
 r AS (SELECT derived_id, t_name, t_arity, 1 AS depth FROM e WHERE base_name = 'icursor' UNION SELECT e.derived_id, e.t_name, e.t_arity, depth + 1 FROM r JOIN e ON e.base_name = r.t_name AND e.base_arity = r.t_arity, most WHERE depth <= least(n, 200))
SELECT derived_id AS symbol_id, min(depth) AS depth, (SELECT count(DISTINCT derived_id) > 2000 FROM r) AS capped FROM r GROUP BY 1"""
)
def y14_closure(s: Store) -> DataFrame:
    return S.implementation_closure(s.base_edges, s.symbols, "ICursor", Scratch(s.spark, "closure"))


@query(f"WITH {PROJ}, {OWN}, {SY}, {EDGE} SELECT DISTINCT project_id FROM be LEFT JOIN own USING (file_id) WHERE base_name = 'icursor' AND project_id IS NOT NULL")
def y16_implementing_projects(s: Store) -> DataFrame:
    e = s.base_edges.where("base_name = 'icursor'")
    return e.join(s.owners, "file_id", "left").where("project_id is not null").select("project_id").distinct()


@query(f"WITH {SY} SELECT id AS symbol_id, substr(sha256(concat_ws(chr(31), kind, ns, container, name, signature)), 1, 12) AS handle FROM s")
def y17_handles(s: Store) -> DataFrame:
    return s.symbols.select(F.col("id").alias("symbol_id"), S.fingerprint("kind", "ns", "container", "name", "signature").alias("handle"))


@query(f"WITH {SY} SELECT name, count(DISTINCT arity) > 1 AS ambiguous, count(*) AS declared FROM s WHERE kind IN {_list(TYPE_KINDS)} GROUP BY 1")
def l13_arity_ambiguity(s: Store) -> DataFrame:
    return s.symbols.where(F.col("kind").isin(*TYPE_KINDS)).groupBy("name").agg((F.count_distinct("arity") > 1).alias("ambiguous"), F.count("*").alias("declared"))


@query(
    f"""WITH {SY}, {L}, t AS (SELECT id, file_id, start_line, least(end_line, start_line + 5) AS stop FROM s WHERE kind = 'constructor')
SELECT t.id AS symbol_id, string_agg(lpad(line_no::VARCHAR, 5, ' ') || '| ' || line, chr(10) ORDER BY line_no) AS body FROM t JOIN l ON l.file_id = t.file_id AND line_no BETWEEN start_line AND stop GROUP BY 1"""
)
def l14_bodies(s: Store) -> DataFrame:
    """The first six numbered lines of constructors; whole texts are split once per file."""
    t = s.symbols.where("kind = 'constructor'").select(F.col("id").alias("symbol_id"), F.col("file_id").alias("t_file"), "start_line", F.least("end_line", F.col("start_line") + 5).alias("stop"))
    files = t.select(F.col("t_file").alias("file_id")).distinct()
    j = s.lines.join(files, "file_id", "left_semi").join(t, (F.col("file_id") == F.col("t_file")) & F.col("line_no").between(F.col("start_line"), F.col("stop"))).select("symbol_id", "line_no", "line").distinct()
    numbered = F.struct("line_no", F.concat(F.lpad(F.col("line_no").cast("string"), 5, " "), F.lit("| "), "line").alias("x"))
    return j.groupBy("symbol_id").agg(F.array_sort(F.collect_list(numbered)).alias("b")).select("symbol_id", F.array_join(F.transform("b", lambda x: x["x"]), "\n").alias("body"))


@query(f"WITH {SY}, {EDGE}, d AS (SELECT DISTINCT derived_id, base_name FROM be), k AS (SELECT base_name, derived_id, contains(coalesce(modifiers, ''), 'abstract') OR kind = 'interface' AS open, is_partial FROM d JOIN s ON s.id = derived_id) SELECT base_name, count_if(NOT open) AS concrete, count(*) AS implementers, CASE WHEN count_if(NOT open) = 1 AND NOT bool_or(is_partial) THEN min(derived_id) FILTER (NOT open) END AS likely FROM k GROUP BY 1")
def l15_implementation_shape(s: Store) -> DataFrame:
    """Concrete implementers of each base, and the likely one if there is just one."""
    d = s.base_edges.select("base_name", "derived_id").distinct()
    i = s.symbols.select(F.col("id").alias("derived_id"), (F.coalesce("modifiers", F.lit("")).contains("abstract") | (F.col("kind") == "interface")).alias("open"), "is_partial")
    concrete = F.count_if(~F.col("open"))
    return d.join(i, "derived_id").groupBy("base_name").agg(concrete.alias("concrete"), F.count("*").alias("implementers"), F.when((concrete == 1) & ~F.bool_or("is_partial"), F.min(F.when(~F.col("open"), F.col("derived_id")))).alias("likely"))


# --------------------------------------------------------------------- graphs


def _edges(s: Store, reverse: bool = False) -> DataFrame:
    e = s.refs.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    return graph.reverse(e) if reverse else e


def _root(s: Store, pick) -> int | None:
    """One project's id, by a rule that both engines follow."""
    r = s.refs.agg(pick).first()
    return r[0]


@query(
    f"""WITH RECURSIVE {PROJ}, ro AS (SELECT max(from_id) AS root FROM refs),
 r AS (SELECT root, to_id AS node FROM ro JOIN refs ON from_id = root UNION SELECT r.root, to_id FROM r JOIN refs ON from_id = r.node) SELECT root, node FROM r"""
)
def g2_dependencies(s: Store) -> DataFrame:
    roots = s.refs.agg(F.max("from_id").alias("root")).where("root is not null")
    return graph.reachable(_edges(s), roots, Scratch(s.spark, "graph")).select("root", "node")


@query(
    f"""WITH RECURSIVE {PROJ}, ro AS (SELECT min(to_id) AS root FROM refs),
 r AS (SELECT root, from_id AS node, 1 AS depth FROM ro JOIN refs ON to_id = root UNION SELECT r.root, from_id, depth + 1 FROM r JOIN refs ON to_id = r.node WHERE depth < 40) SELECT root, node, min(depth) AS depth FROM r GROUP BY 1, 2"""
)
def g3_dependents(s: Store) -> DataFrame:
    roots = s.refs.agg(F.min("to_id").alias("root")).where("root is not null")
    return graph.reachable(_edges(s, True), roots, Scratch(s.spark, "graph"))


@query(
    f"""WITH RECURSIVE {PROJ}, ro AS (SELECT id AS root FROM p WHERE is_test), r AS (SELECT root, to_id AS node FROM ro JOIN refs ON from_id = root UNION SELECT r.root, to_id FROM r JOIN refs ON from_id = r.node) SELECT root, count(*) AS reached FROM r GROUP BY 1"""
)
def g6_reach_of_tests(s: Store) -> DataFrame:
    """How many projects each test project reaches: one multi-source walk, not a walk a root."""
    roots = s.projects.where("is_test").select(F.col("id").alias("root"))
    return graph.reachable(_edges(s), roots, Scratch(s.spark, "graph")).groupBy("root").agg(F.count("*").alias("reached"))


@query(
    f"""WITH RECURSIVE {PROJ}, ro AS (SELECT max(from_id) AS a, min(to_id) AS b FROM refs),
 r AS (SELECT [a] AS path, a AS tip, 0 AS n FROM ro UNION ALL SELECT list_append(path, to_id), to_id, n + 1 FROM r JOIN refs ON from_id = tip WHERE n < 12 AND NOT list_contains(path, to_id)),
 h AS (SELECT DISTINCT path, n FROM r, ro WHERE tip = b) SELECT array_to_string(path, '>') AS path FROM h WHERE n = (SELECT min(n) FROM h) ORDER BY path LIMIT 100"""
)
def g4_shortest_paths(s: Store) -> DataFrame:
    a, b = s.refs.agg(F.max("from_id"), F.min("to_id")).first()
    if a is None:
        return s.spark.createDataFrame([], "path string")
    return graph.shortest_paths(_edges(s), a, b, 100, Scratch(s.spark, "graph")).select(F.array_join("path", ">").alias("path"))


@query(
    f"""WITH {PROJ}, ro AS (SELECT min(to_id) AS root FROM refs), one AS (SELECT from_id FROM refs, ro WHERE to_id = root)
SELECT from_id, to_id, 1 AS hop FROM refs, ro WHERE to_id = root UNION ALL SELECT from_id, to_id, 2 FROM refs WHERE to_id IN (SELECT from_id FROM one)"""
)
def g1_project_graph(s: Store) -> DataFrame:
    """All edges of two hops upstream of a project, each node expanded once."""
    root = s.refs.agg(F.min("to_id").alias("root"))
    e = s.refs.join(F.broadcast(root), F.col("to_id") == F.col("root"), "left_semi")
    second = s.refs.join(e.select(F.col("from_id").alias("x")).distinct(), F.col("to_id") == F.col("x"), "left_semi")
    return e.withColumn("hop", F.lit(1)).unionByName(second.withColumn("hop", F.lit(2)))


@query(
    f"""WITH RECURSIVE {PROJ}, e AS (SELECT from_id, to_id FROM refs WHERE from_id <> to_id), n AS (SELECT count(*) AS n FROM p),
 r AS (SELECT id AS node, 0 AS hops FROM p UNION SELECT from_id, hops + 1 FROM r JOIN e ON e.to_id = r.node, n WHERE hops <= n.n),
 m AS (SELECT node, max(hops) AS level FROM r GROUP BY 1)
SELECT node, CASE WHEN level < (SELECT n FROM n) THEN level END::INT AS level FROM m"""
)
def g9_levels(s: Store) -> DataFrame:
    """Topological levels of the projects; null on or above a cycle."""
    nodes = s.projects.select(F.col("id").alias("node"))
    return graph.levels(_edges(s), nodes, Scratch(s.spark, "graph"))


@query(
    f"""WITH {PROJ}, {OWN}, {REFS.split(OWN + ', ')[1]}, tp AS (SELECT id, name FROM p WHERE is_test), m AS (SELECT DISTINCT project_id AS id, 1 AS tier FROM rf WHERE project_id IN (SELECT id FROM tp)),
 n AS (SELECT id, 2 AS tier FROM tp WHERE contains(lower(name), 'cluster')), d AS (SELECT DISTINCT from_id AS id, 3 AS tier FROM refs JOIN p ON p.id = to_id WHERE contains(lower(p.name), 'cluster') AND from_id IN (SELECT id FROM tp))
SELECT id AS project_id, min(tier) AS tier FROM (SELECT * FROM m UNION ALL SELECT * FROM n UNION ALL SELECT * FROM d) GROUP BY 1"""
)
def g12_related_tests(s: Store) -> DataFrame:
    """Test projects that mention a name, are named for it, or depend on a project named for it; the first reason counts."""
    t = s.projects.where("is_test").select(F.col("id").alias("project_id"), "name")
    mention = _references(s).select("project_id").distinct().join(t, "project_id", "left_semi").withColumn("tier", F.lit(1))
    named = t.where(X.fold("name").contains("cluster")).select("project_id", F.lit(2).alias("tier"))
    target = s.projects.where(X.fold("name").contains("cluster")).select(F.col("id").alias("to_id"))
    depend = s.refs.join(target, "to_id", "left_semi").select(F.col("from_id").alias("project_id")).distinct().join(t, "project_id", "left_semi").withColumn("tier", F.lit(3))
    return mention.unionByName(named).unionByName(depend).groupBy("project_id").agg(F.min("tier").alias("tier"))


# ----------------------------------------------------------------- composites


@query(
    f"""WITH RECURSIVE {REFS}, hit AS (SELECT DISTINCT project_id FROM rf WHERE project_id IS NOT NULL), direct AS (SELECT DISTINCT from_id AS id FROM refs WHERE to_id IN (SELECT project_id FROM hit)),
 r AS (SELECT from_id AS node FROM refs WHERE to_id IN (SELECT project_id FROM hit) UNION SELECT from_id FROM r JOIN refs ON to_id = r.node)
SELECT (SELECT count(*) FROM rf) AS hits, (SELECT count(*) FROM hit) AS projects, (SELECT count(*) FROM direct) AS direct, (SELECT count(*) FROM r) AS transitive,
 CASE WHEN (SELECT count(*) FROM r) > 50 THEN 'high' WHEN (SELECT count(*) FROM r) > 10 THEN 'medium' ELSE 'low' END AS risk"""
)
def impact(s: Store) -> DataFrame:
    """What a change of a name would touch: references, projects, direct and transitive dependents, and a risk by rule."""
    rf = _references(s)
    hit = rf.where("project_id is not null").select(F.col("project_id").alias("root")).distinct()
    one = hit.withColumnRenamed("root", "h")
    direct = s.refs.join(one, F.col("to_id") == F.col("h"), "left_semi").select("from_id").distinct()
    scratch = Scratch(s.spark, "impact")
    # one virtual root before all hit projects, so each dependent is visited once
    up = _edges(s, True).unionByName(one.select(F.lit(-1).cast("long").alias("src"), F.col("h").alias("dst")))
    reached = graph.reachable(up, s.spark.createDataFrame([(-1,)], "root long"), scratch)
    far = reached.where("depth > 1").select("node").union(reached.join(s.refs, F.col("node") == F.col("to_id")).select(F.col("from_id"))).distinct()
    n = far.agg(F.count("*").alias("transitive"))
    out = rf.agg(F.count("*").alias("hits")).crossJoin(hit.agg(F.count("*").alias("projects"))).crossJoin(direct.agg(F.count("*").alias("direct"))).crossJoin(n)
    return out.withColumn("risk", F.when(F.col("transitive") > 50, "high").when(F.col("transitive") > 10, "medium").otherwise("low"))


@query(f"WITH {SY} SELECT coalesce(ns, '') AS ns, count(*) AS symbols, count_if(kind IN {_list(TYPE_KINDS)}) AS types, count(DISTINCT file_id) AS files FROM s GROUP BY 1")
def namespace_digest(s: Store) -> DataFrame:
    return s.symbols.groupBy(F.coalesce("ns", F.lit("")).alias("ns")).agg(F.count("*").alias("symbols"), F.count_if(F.col("kind").isin(*TYPE_KINDS)).alias("types"), F.count_distinct("file_id").alias("files"))


# ------------------------------------------------------- further joins, unions


NAMED = r"""pk AS (SELECT DISTINCT file_id, lower(trim(regexp_extract(x, 'Include\s*=\s*"([^",]*)', 1))) AS package FROM (SELECT file_id, unnest(regexp_extract_all(content, '<(?:PackageReference|Reference)\b[^>]*\bInclude\s*=\s*"[^",]*')) AS x FROM (SELECT DISTINCT file_id, content FROM file_contents JOIN files ON file_id = id WHERE lang IN ('csproj','fsproj')))),
 q AS (SELECT p.id AS from_id, pk.package FROM pk JOIN files f ON f.id = pk.file_id JOIN p ON p.k = lower(f.path)),
 named AS (SELECT DISTINCT from_id, to_id, lang FROM (SELECT from_id, p.id AS to_id, p.lang FROM q JOIN p ON lower(p.name) = q.package AND p.id <> q.from_id QUALIFY row_number() OVER (PARTITION BY from_id, q.package, p.lang ORDER BY p.id) = 1))"""
EDGES = f"{PROJ}, {NAMED}, edges AS (SELECT from_id, to_id, max(kind) AS kind FROM (SELECT from_id, to_id, 'project' AS kind FROM refs UNION ALL SELECT from_id, to_id, 'assembly' FROM named) GROUP BY 1, 2)"


@query(f"WITH {PROJ}, {NAMED} SELECT from_id, to_id, lang FROM named")
def j16_binary_edges(s: Store) -> DataFrame:
    """Edges recovered from references by name: a project of that name, one a language, never the asking one."""
    return s.named_refs


GLOBS = ("src/**/Generation/*.cs", "**/Scripts/*.sql", "*/docs/**", "src/*.cs")


@query("SELECT id AS file_id, 0 AS glob FROM files WHERE regexp_matches(lower(path), '^src/(?:[^/]+/)*generation/[^/]*\\.cs$') UNION ALL SELECT id, 1 FROM files WHERE regexp_matches(lower(path), '^(?:[^/]+/)*scripts/[^/]*\\.sql$') UNION ALL SELECT id, 2 FROM files WHERE regexp_matches(lower(path), '^[^/]*/docs/.*$') UNION ALL SELECT id, 3 FROM files WHERE regexp_matches(lower(path), '^src/[^/]*\\.cs$')")
def j13_glob_ownership(s: Store) -> DataFrame:
    """Files by include glob; the globs are a query's literals, so each is one predicate of the same scan."""
    which = F.array(*[F.when(X.fold("path").rlike(X.build_glob_regex(g)), k) for k, g in enumerate(GLOBS)])
    return s.files.select(F.col("id").alias("file_id"), F.explode(F.filter(which, lambda x: x.isNotNull())).alias("glob"))


@query(f"WITH {PROJ}, {OWN}, {POST} SELECT own.project_id, count(DISTINCT po.file_id) AS files FROM po JOIN own ON own.file_id = po.file_id WHERE token = 'watcher' GROUP BY 1")
def a4_projects_by_matches(s: Store) -> DataFrame:
    return s.postings_of(["watcher"]).join(s.owners, "file_id").groupBy("project_id").agg(F.count_distinct("file_id").alias("files"))


@query(f"WITH {REFS}, t AS (SELECT DISTINCT project_id, file_id, line_no, CASE WHEN contains(line, 'new ') THEN 'creation' WHEN contains(line, ': ') THEN 'base' ELSE 'use' END AS usage FROM rf) SELECT project_id, usage, count(*) AS sites FROM t GROUP BY 1, 2")
def a7_usage_histogram(s: Store) -> DataFrame:
    """Distinct reference sites by project and how the name is used."""
    usage = F.when(F.col("line").contains("new "), "creation").when(F.col("line").contains(": "), "base").otherwise("use")
    return _references(s).select("project_id", "file_id", "line_no", usage.alias("usage")).distinct().groupBy("project_id", "usage").agg(F.count("*").alias("sites"))


@query(f"WITH {EDGES} SELECT to_id AS project_id, count(*) AS dependents, bool_and(kind = 'assembly') AS only_by_name FROM edges GROUP BY 1")
def a12_direct_dependents(s: Store) -> DataFrame:
    """Direct dependents of each project, and whether all of them refer to it by name only."""
    return s.edges.groupBy(F.col("to_id").alias("project_id")).agg(F.count("*").alias("dependents"), F.every(F.col("kind") == "assembly").alias("only_by_name"))


@query(f"WITH {SY}, {EDGE} SELECT s.id AS symbol_id, path FROM s JOIN (SELECT DISTINCT derived_id FROM be WHERE base_name = 'icursor') e ON e.derived_id = s.id JOIN files f ON f.id = s.file_id ORDER BY is_generated, name, path, symbol_id LIMIT 60")
def t5_ranked_implementers(s: Store) -> DataFrame:
    f = s.files.select(F.col("id").alias("f_id"), "path", "is_generated")
    return S.implementers(s.base_edges, s.symbols, "ICursor").join(f, F.col("file_id") == F.col("f_id")).orderBy("is_generated", "name", "path", "id").limit(60).select(F.col("id").alias("symbol_id"), "path")


@query(f"WITH {REFS} SELECT project_id, count(*) AS hits FROM rf GROUP BY 1 ORDER BY hits DESC, project_id NULLS FIRST LIMIT 20")
def t7_groups_by_hits(s: Store) -> DataFrame:
    """The twenty greatest groups; ties go by project, where the reference leaves them as met."""
    return _references(s).groupBy("project_id").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), F.asc_nulls_first("project_id")).limit(20)


@query(f"WITH {SY} SELECT s.id AS symbol_id FROM s WHERE kind IN ('class','interface') ORDER BY contains(coalesce(modifiers, ''), 'abstract') OR kind = 'interface', name, s.id LIMIT 50")
def t10_concrete_first(s: Store) -> DataFrame:
    open_ = F.coalesce("modifiers", F.lit("")).contains("abstract") | (F.col("kind") == "interface")
    return s.symbols.where(F.col("kind").isin("class", "interface")).orderBy(open_, "name", "id").limit(50).select(F.col("id").alias("symbol_id"))


@query("SELECT id AS file_id, size, (row_number() OVER (ORDER BY size DESC, path) - 1) % 8 AS lane FROM files WHERE lang = 'cs'")
def t15_largest_first(s: Store) -> DataFrame:
    """All sources dealt to eight lanes, largest first, as a cold build takes them; the order is one sort over ranges and the place in it comes from the ranges' counts, not from one task's window."""
    return S.numbered(s.files.where("lang = 'cs'").select(F.col("id").alias("file_id"), "size", "path"), [F.desc("size"), F.col("path")], Scratch(s.spark, "lanes")).select("file_id", "size", (F.col("place") % 8).alias("lane"))


@query(f"WITH {PROJ} SELECT from_id AS node, to_id AS other, 'downstream' AS side FROM refs UNION ALL SELECT to_id, from_id, 'upstream' FROM refs")
def u1_both_directions(s: Store) -> DataFrame:
    down = s.refs.select(F.col("from_id").alias("node"), F.col("to_id").alias("other"), F.lit("downstream").alias("side"))
    return down.unionByName(s.refs.select(F.col("to_id").alias("node"), F.col("from_id").alias("other"), F.lit("upstream").alias("side")))


@query(f"WITH {PROJ} SELECT 'project' AS part, count(*) AS n FROM p UNION ALL SELECT 'reference', count(*) FROM refs UNION ALL SELECT 'solution', count(*) FROM (SELECT DISTINCT id FROM parsed_solutions)")
def u2_fingerprint_parts(s: Store) -> DataFrame:
    part = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return part(s.projects, "project").unionByName(part(s.refs, "reference")).unionByName(part(s.raw("parsed_solutions").select("id").distinct(), "solution"))


# -------------------------------------------------------------- further search


@query(f"WITH {L} SELECT file_id, line_no FROM l WHERE regexp_matches(lower(line), '(^|[^\\pL\\p{{Nd}}_])task[^\\pL\\p{{Nd}}_]+yield([^\\pL\\p{{Nd}}_]|$)')")
def x4_phrase(s: Store) -> DataFrame:
    """A name with separators is a phrase: its tokens side by side. Files without all of them are pruned first."""
    ts = X.query_tokens("Task.Yield")
    near = r"(?<![\p{L}\p{Nd}_])" + r"[^\p{L}\p{Nd}_]+".join(ts) + r"(?![\p{L}\p{Nd}_])"
    return lines_of(s.texts_holding(ts)).where(X.fold("line").rlike(near)).select("file_id", "line_no").distinct()


@query(f"WITH {L}, {SY}, h AS (SELECT file_id, line_no FROM l WHERE {_has('manifest')} AND {_has('ledger')}) SELECT file_id, line_no, inside FROM (SELECT h.file_id, h.line_no, s.name AS inside, row_number() OVER (PARTITION BY h.file_id, h.line_no ORDER BY end_line - start_line, start_line DESC, s.id) AS rn FROM h LEFT JOIN s ON s.file_id = h.file_id AND h.line_no BETWEEN start_line AND end_line) WHERE rn = 1")
def x19_hits_with_symbols(s: Store) -> DataFrame:
    """Search hits with the name of the innermost symbol around each."""
    hits = s.lines_with_folded("manifest", "ledger").where(X.whole_token(F.col("line"), "manifest") & X.whole_token(F.col("line"), "ledger")).select("file_id", "line_no").distinct()
    inside = S.innermost(hits, s.symbols).join(s.symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("inside")), "symbol_id").drop("symbol_id")
    return hits.join(inside, ["file_id", "line_no"], "left")


@query(f"WITH {L} SELECT (SELECT count(*) FROM l WHERE {_has('quota')} AND {_has('ledger')}) AS precise, (SELECT count(DISTINCT file_id) FROM l WHERE {_has('quota')}) AS first_files, (SELECT count(DISTINCT file_id) FROM l WHERE {_has('ledger')}) AS second_files, (SELECT count(*) FROM l WHERE {_has('quotaledger')}) AS joined")
def x17_dead_end_probes(s: Store) -> DataFrame:
    """What an empty page asks next: each token elsewhere, both together, the joined variant; one pass over the lines."""
    a, b, j = (X.whole_token(F.col("line"), t) for t in ("quota", "ledger", "quotaledger"))
    hits = s.lines.where(a | b | j).select("file_id", "line_no", a.alias("a"), b.alias("b"), j.alias("j")).distinct()
    return hits.agg(F.count_if(F.col("a") & F.col("b")).alias("precise"), F.count_distinct(F.when(F.col("a"), F.col("file_id"))).alias("first_files"), F.count_distinct(F.when(F.col("b"), F.col("file_id"))).alias("second_files"), F.count_if("j").alias("joined"))


@query(f"WITH {L}, n AS (SELECT count(*) AS n FROM l WHERE {_has('log')}) SELECT n AS precise, n >= 1000 AS common FROM n")
def x18_common_term(s: Store) -> DataFrame:
    return s.lines_with_folded("log").where(X.whole_token(F.col("line"), "log")).select("file_id", "line_no").distinct().agg(F.count("*").alias("precise"), (F.count("*") >= 1000).alias("common"))


@query("SELECT id AS file_id, path FROM files WHERE lang IN ('cs','fs','md','sql','csproj','fsproj','sln','config') ORDER BY is_generated, length(path), path LIMIT 2001")
def x10_regex_cohort(s: Store) -> DataFrame:
    """Files that a regular expression without literals scans: a bound of 2000, and one more that tells of others."""
    return s.files.where(F.col("lang").isin(*SEARCHED)).orderBy("is_generated", F.length("path"), "path").limit(2001).select(F.col("id").alias("file_id"), "path")


# ------------------------------------------------------------- further symbols


@query(f"WITH {SY} SELECT kind, count(*) AS n FROM s WHERE contains(lower(name), 'zzz') OR contains(lower(name), 'gateway') GROUP BY 1")
def y4_kinds_on_miss(s: Store) -> DataFrame:
    return s.symbols.where(S.name_match(F.col("name"), "zzz", "substring") | S.name_match(F.col("name"), "gateway", "substring")).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {SY}, t AS (SELECT file_id, min(start_line) AS first FROM s WHERE kind = 'method' GROUP BY 1) SELECT s.id AS symbol_id FROM s JOIN t ON t.file_id = s.file_id AND s.start_line = t.first")
def y7_starting_at(s: Store) -> DataFrame:
    t = s.symbols.where("kind = 'method'").groupBy(F.col("file_id").alias("t_file")).agg(F.min("start_line").alias("first"))
    return s.symbols.join(t, (F.col("file_id") == F.col("t_file")) & (F.col("start_line") == F.col("first"))).select(F.col("id").alias("symbol_id"))


@query(f"WITH {SY}, {EDGE}, t AS (SELECT DISTINCT s.ns, s.name, s.file_id FROM be JOIN s ON s.id = derived_id WHERE base_name = 'icursor') SELECT m.id AS symbol_id FROM s m JOIN t ON m.file_id = t.file_id AND m.container = t.name WHERE m.kind = 'method'")
def l16_members_of_implementers(s: Store) -> DataFrame:
    """Methods of the types that implement a contract: implementers, then a semi-join to their members."""
    t = S.implementers(s.base_edges, s.symbols, "ICursor").select(F.col("file_id").alias("t_file"), F.col("name").alias("t_name")).distinct()
    return s.symbols.where("kind = 'method'").join(t, (F.col("file_id") == F.col("t_file")) & (F.col("container") == F.col("t_name")), "left_semi").select(F.col("id").alias("symbol_id"))


@query(
    f"""WITH {PROJ}, {OWN}, {SY}, d AS (SELECT s.id, s.kind, own.file_id IS NOT NULL AS live FROM s LEFT JOIN own ON own.file_id = s.file_id WHERE lower(name) = 'anchor'), x AS (SELECT *, bool_or(live) OVER () AS any_live FROM d)
SELECT id AS symbol_id, CASE WHEN kind = 'interface' THEN 0 WHEN kind IN {_list(TYPE_KINDS)} THEN 1 ELSE 2 END AS rank FROM x WHERE live OR NOT any_live"""
)
def l12_declaration_targets(s: Store) -> DataFrame:
    """Declarations of a name: those in files without a project only if there is no other; interfaces, then types, then the rest."""
    own = s.owners.select(F.col("file_id").alias("o_file"))
    d = s.symbols.where(S.name_match(F.col("name"), "anchor", "exact")).join(own, F.col("file_id") == F.col("o_file"), "left").withColumn("live", F.col("o_file").isNotNull())
    # one row tells whether any is live; a window without partitions would gather all declarations
    any_live = d.agg(F.coalesce(F.max("live"), F.lit(False)).alias("any_live"))
    rank = F.when(F.col("kind") == "interface", 0).when(F.col("kind").isin(*TYPE_KINDS), 1).otherwise(2)
    return d.crossJoin(F.broadcast(any_live)).where("live or not any_live").select(F.col("id").alias("symbol_id"), rank.alias("rank"))


@query("SELECT min(id) AS file_id, lower(path) AS alias FROM files GROUP BY lower(path) HAVING count(*) = 1")
def l2_unique_aliases(s: Store) -> DataFrame:
    return s.files.groupBy(X.fold("path").alias("alias")).agg(F.min("id").alias("file_id"), F.count("*").alias("n")).where("n = 1").select("file_id", "alias")


@query(f"WITH {PROJ} SELECT lower(name) AS name, arg_min(id, path) AS project_id, count(*) AS of_name FROM (SELECT *, k AS path FROM p) GROUP BY 1")
def l3_project_by_name(s: Store) -> DataFrame:
    return s.projects.groupBy(X.fold("name").alias("name")).agg(F.min_by("id", "key").alias("project_id"), F.count("*").alias("of_name"))


@query(f"WITH {PROJ}, {OWN} SELECT DISTINCT lower(p.name) AS name, f.path, f.size FROM own JOIN p ON p.id = own.project_id JOIN files f ON f.id = own.file_id WHERE f.lang = 'cs'")
def l6_files_with_sizes(s: Store) -> DataFrame:
    p = s.projects.select(F.col("id").alias("p_id"), X.fold("name").alias("name"))
    f = s.files.where("lang = 'cs'").select(F.col("id").alias("f_id"), "path", "size")
    return s.owners.join(p, F.col("project_id") == F.col("p_id")).join(f, F.col("file_id") == F.col("f_id")).select("name", "path", "size").distinct()


@query("SELECT path FROM files WHERE is_generated ORDER BY path")
def l7_generated_paths(s: Store) -> DataFrame:
    return s.files.where("is_generated").select("path").orderBy("path")


@query(
    """WITH o AS (SELECT file_id, row_number() OVER (PARTITION BY file_id % 7 ORDER BY file_id) AS nth, file_id % 7 AS owner FROM fsharp_parse_coverage)
SELECT file_id, owner FROM (SELECT *, row_number() OVER (ORDER BY nth, owner) AS rank FROM o) WHERE rank <= 64"""
)
def l24_parse_contexts(s: Store) -> DataFrame:
    """At most 64 contexts: one of each owner first, then second ones, and so on."""
    c = s.raw("fsharp_parse_coverage").select("file_id", (F.col("file_id") % 7).alias("owner"))
    nth = F.row_number().over(Window.partitionBy("owner").orderBy("file_id"))
    # no owner can have more than 64 of 64: the rank's limit prunes before the shuffle
    return c.withColumn("nth", nth).where("nth <= 64").orderBy("nth", "owner").limit(64).select("file_id", "owner")


@query(f"WITH {EDGES} SELECT from_id, to_id, kind FROM edges")
def g5_edge_kinds(s: Store) -> DataFrame:
    """One row a pair of projects; a project reference wins over one by name."""
    return s.edges


@query(
    f"""WITH RECURSIVE {PROJ}, {OWN}, {REFS.split(OWN + ', ')[1]}, cand AS (SELECT project_id AS id, count(DISTINCT file_id) AS files FROM rf WHERE project_id IS NOT NULL GROUP BY 1), seed AS (SELECT DISTINCT project_id AS id FROM own JOIN symbols s ON s.file_id = own.file_id WHERE s.name = '{NAME}'),
 up AS (SELECT from_id AS id FROM refs WHERE to_id IN (SELECT id FROM seed) UNION SELECT from_id FROM up JOIN refs ON to_id = up.id)
SELECT id AS project_id, CASE WHEN id IN (SELECT id FROM seed) THEN 0 ELSE 1 END AS tier FROM cand WHERE id IN (SELECT id FROM up) OR id IN (SELECT id FROM seed) ORDER BY tier, files DESC, id LIMIT 40"""
)
def g10_scan_set(s: Store) -> DataFrame:
    """Projects worth a full look: textual candidates among the seeds and their dependents, seeds first, at most 40."""
    cand = _references(s).where("project_id is not null").groupBy("project_id").agg(F.count_distinct("file_id").alias("files"))
    declared = s.symbols.where(F.col("name") == NAME).select("file_id").distinct()
    seed = s.owners.join(declared, "file_id", "left_semi").select("project_id").distinct()
    # the union of what the seeds reach: one virtual root before them all visits each project once
    start = seed.select(F.lit(-1).cast("long").alias("src"), F.col("project_id").alias("dst"))
    up = graph.reachable(_edges(s, True).unionByName(start), s.spark.createDataFrame([(-1,)], "root long"), Scratch(s.spark, "scan")).select(F.col("node").alias("project_id"))
    known = seed.withColumn("tier", F.lit(0)).unionByName(up.withColumn("tier", F.lit(1))).groupBy("project_id").agg(F.min("tier").alias("tier"))
    return cand.join(known, "project_id").orderBy("tier", F.desc("files"), "project_id").limit(40).select("project_id", "tier")


@query(
    f"""WITH {SY}, t AS (SELECT s.id, s.file_id, s.name, start_line FROM s WHERE kind = 'interface' AND lower(name) LIKE 'a%'),
 m AS (SELECT t.id, count(*) AS members FROM t JOIN s ON s.file_id = t.file_id AND s.container = t.name GROUP BY 1), sib AS (SELECT t.id, count(*) AS siblings FROM t JOIN s ON s.file_id = t.file_id AND s.id <> t.id AND s.container IS NULL GROUP BY 1)
SELECT t.id AS symbol_id, path, start_line, coalesce(members, 0) AS members, coalesce(siblings, 0) AS siblings FROM t JOIN files f ON f.id = t.file_id LEFT JOIN m ON m.id = t.id LEFT JOIN sib ON sib.id = t.id"""
)
def context_pack(s: Store) -> DataFrame:
    """What a reader of a definition needs with it: its place, members and siblings."""
    t = s.symbols.where((F.col("kind") == "interface") & X.fold("name").startswith("a")).select(F.col("id").alias("symbol_id"), F.col("file_id").alias("t_file"), F.col("name").alias("t_name"), F.col("start_line").alias("line"))
    inside = s.symbols.join(t, (F.col("file_id") == F.col("t_file")) & (F.col("container") == F.col("t_name"))).groupBy("symbol_id").agg(F.count("*").alias("members"))
    beside = s.symbols.where("container is null").join(t, (F.col("file_id") == F.col("t_file")) & (F.col("id") != F.col("symbol_id"))).groupBy("symbol_id").agg(F.count("*").alias("siblings"))
    f = s.files.select(F.col("id").alias("f_id"), "path")
    j = t.join(f, F.col("t_file") == F.col("f_id")).join(inside, "symbol_id", "left").join(beside, "symbol_id", "left")
    return j.select("symbol_id", "path", F.col("line").alias("start_line"), F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("siblings", F.lit(0)).alias("siblings"))


@query(f"WITH {SY}, {RANGES}, t AS (SELECT rg.file_id, first, last, s.id, s.kind, s.start_line, s.end_line FROM rg JOIN s ON s.file_id = rg.file_id AND start_line <= last AND end_line >= first) SELECT file_id, count(*) AS touched, count_if(kind IN {_list(TYPE_KINDS)}) AS types, count_if(first <= start_line AND last >= end_line) AS whole FROM t GROUP BY 1")
def review_pack(s: Store) -> DataFrame:
    """Per changed file: touched symbols, types among them, and those changed whole."""
    t = S.intersecting(_ranges(s), s.symbols)
    return t.groupBy("file_id").agg(F.count("*").alias("touched"), F.count_if(F.col("kind").isin(*TYPE_KINDS)).alias("types"), F.count_if((F.col("first") <= F.col("start_line")) & (F.col("last") >= F.col("end_line"))).alias("whole"))


# ------------------------------------------------------------ the last families


@query(None)
def s4_extracted(s: Store) -> DataFrame:
    """Declarations that the light extractor finds in the texts."""
    f = s.files.where(F.col("lang").isin("cs", "fs")).select(F.col("id").alias("file_id"))
    return extract.declarations(s.contents).join(f, "file_id", "left_semi")


@query(
    f"""WITH {SY}, decl AS (SELECT DISTINCT file_id, start_line FROM s WHERE name = '{NAME}'), {REFS}
SELECT DISTINCT rf.file_id, line_no FROM rf WHERE NOT EXISTS (SELECT 1 FROM decl WHERE decl.file_id = rf.file_id AND decl.start_line = rf.line_no)"""
)
def x13_without_declarations(s: Store) -> DataFrame:
    """References less the lines on which the name is declared: an anti-join."""
    d = s.symbols.where(F.col("name") == NAME).select(F.col("file_id").alias("d_file"), F.col("start_line").alias("d_line"))
    r = _references(s)
    return r.join(d, (F.col("file_id") == F.col("d_file")) & (F.col("line_no") == F.col("d_line")), "left_anti").select("file_id", "line_no").distinct()


@query(
    f"""WITH {BM}, inner_ AS (SELECT bm.file_id FROM bm JOIN files f ON f.id = bm.file_id ORDER BY round(score, 6) DESC, bm.file_id LIMIT 2000)
SELECT i.file_id FROM inner_ i JOIN files f ON f.id = i.file_id WHERE f.lang = 'cs' AND NOT f.is_generated ORDER BY i.file_id LIMIT 100"""
)
def t4_nested_top(s: Store) -> DataFrame:
    """Filters after the inner cut, as the regular-expression search orders it: the best 2000 first, then those of the scope."""
    inner = _ranked(s).orderBy(F.desc(F.round("score", 6)), "file_id").limit(2000)
    f = s.files.where("lang = 'cs' and not is_generated").select(F.col("id").alias("f_id"))
    return inner.join(f, F.col("file_id") == F.col("f_id"), "left_semi").select("file_id").orderBy("file_id").limit(100)


@query(f"WITH {PROJ} SELECT from_id, to_id FROM refs JOIN p a ON a.id = from_id JOIN p b ON b.id = to_id WHERE a.lang = 'cs' AND b.lang = 'cs' AND a.load_status = 'parsed' AND b.load_status = 'parsed'")
def g7_semantic_edges(s: Store) -> DataFrame:
    """Edges between C# projects that loaded."""
    ok = s.projects.where("lang = 'cs' and load_status = 'parsed'").select(F.col("id").alias("ok"))
    return s.refs.join(ok, F.col("from_id") == F.col("ok"), "left_semi").join(ok, F.col("to_id") == F.col("ok"), "left_semi")


@query(
    f"""WITH RECURSIVE {SY}, {EDGE}, e AS (SELECT DISTINCT base_name, derived_id, lower(name) AS t_name, file_id FROM (SELECT be.*, s.name FROM be JOIN s ON s.id = derived_id)), good AS (SELECT id FROM files WHERE NOT is_generated),
 r AS (SELECT derived_id, t_name FROM e WHERE base_name IN ('icursor', 'ianchor') AND file_id IN (SELECT id FROM good) UNION SELECT e.derived_id, e.t_name FROM r JOIN e ON e.base_name = r.t_name WHERE e.file_id IN (SELECT id FROM good))
SELECT DISTINCT derived_id AS symbol_id FROM r"""
)
def g11_verified_fixpoint(s: Store) -> DataFrame:
    """Types verified hop by hop until a round adds none: only hand-written files verify."""
    good = s.files.where("not is_generated").select(F.col("id").alias("file_id"))
    e = s.base_edges.join(good, "file_id", "left_semi")
    t = s.symbols.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("id").alias("t_id"), X.fold("name").alias("t_name"))
    named = e.join(t, e["derived_id"] == t["t_id"]).select(F.concat(F.lit("n:"), "base_name").alias("src"), F.concat(F.lit("n:"), "t_name").alias("dst"), "derived_id")
    scratch = Scratch(s.spark, "verified")
    named = scratch.cut(named.distinct())
    roots = s.spark.createDataFrame([("n:icursor",), ("n:ianchor",)], "root string")
    reached = graph.reachable(named.select("src", "dst"), roots, scratch).select(F.col("node").alias("src")).union(roots).distinct()
    return named.join(reached, "src", "left_semi").select(F.col("derived_id").alias("symbol_id")).distinct()


@query("SELECT map_from_entries(list({'key': k, 'value': v} ORDER BY k))::VARCHAR AS meta FROM (SELECT 'files' AS k, count(*)::VARCHAR AS v FROM files UNION ALL SELECT 'events', count(*)::VARCHAR FROM events UNION ALL SELECT 'schema', '1')")
def l10_metadata(s: Store) -> DataFrame:
    """Key-value rows as one map."""
    row = lambda name: s.raw(name).agg(F.count("*").cast("string").alias("v")).select(F.lit(name).alias("k"), "v")
    kv = row("files").unionByName(row("events")).unionByName(s.spark.createDataFrame([("schema", "1")], "k string, v string"))
    m = kv.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("m"))
    return m.select(F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "), F.lit("}")).alias("meta"))


@query(
    """WITH st AS (SELECT path, hash FROM (SELECT path, hash, row_number() OVER (PARTITION BY path ORDER BY run_id DESC, attempt DESC, recorded_at DESC, checkpoint_id DESC) AS rn FROM file_checkpoints) WHERE rn = 1),
 d AS (SELECT CASE WHEN st.path IS NULL THEN 'added' WHEN f.path IS NULL THEN 'deleted' WHEN f.hash IS NOT DISTINCT FROM st.hash THEN 'same' ELSE 'changed' END AS change FROM files f FULL JOIN st ON f.path = st.path)
SELECT change, count(*) AS files, CASE WHEN (SELECT count(*) FROM d WHERE change <> 'same') > 5000 THEN 'sweep' ELSE 'batch' END AS mode FROM d GROUP BY 1"""
)
def r4_refresh_plan(s: Store) -> DataFrame:
    """What a refresh has to do, and whether as a batch or, beyond 5000 changes, as a sweep."""
    d = j18_snapshot_diff(s).groupBy("change").agg(F.count("*").alias("files"))
    n = d.where("change <> 'same'").agg(F.coalesce(F.sum("files"), F.lit(0)).alias("n"))
    return d.crossJoin(F.broadcast(n)).select("change", "files", F.when(F.col("n") > 5000, "sweep").otherwise("batch").alias("mode"))


@query(
    """WITH q AS (SELECT event_id, event_type IN ('signup', 'error') AS lifecycle, ts FROM events),
 k AS (SELECT *, row_number() OVER (ORDER BY lifecycle DESC, ts DESC, event_id DESC) AS place FROM q)
SELECT event_id, lifecycle, (SELECT count(*) FROM q) - 1024 AS dropped FROM k WHERE place <= 1024"""
)
def r11_bounded_queue(s: Store) -> DataFrame:
    """All events put through a queue of 1024 that drops the oldest, but lifecycle events last; what was dropped is told."""
    e = s.raw("events").withColumn("lifecycle", F.col("event_type").isin("signup", "error"))
    n = e.agg((F.count("*") - 1024).alias("dropped"))
    return e.orderBy(F.desc("lifecycle"), F.desc("ts"), F.desc("event_id")).limit(1024).select("event_id", "lifecycle").crossJoin(F.broadcast(n))
