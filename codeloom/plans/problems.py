"""Queries of the general problems (2, 4 and 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.operators import hierarchy, incremental, orphans
from codeloom.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.symbol_hierarchy(table(spark, d, "symbols"))
    return found.select(F.col("id").alias("symbol_id"), F.col("root").alias("root_id"), "depth")


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol with its path, depth, root and number of descendants."""
    found = hierarchy.symbol_hierarchy(table(spark, d, "symbols"), full=True)
    return found.select(F.col("id").alias("symbol_id"), F.col("root").alias("root_id"), "depth", "path", "descendants")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants as intervals: y descends from x if both have one root and x.first <= y.preorder <= x.last."""
    found = hierarchy.symbol_hierarchy(table(spark, d, "symbols"), full=True).where("root <> -1")
    return found.select(F.col("id").alias("symbol_id"), F.col("root").alias("root_id"), "preorder", (F.col("preorder") + 1).alias("first"), (F.col("preorder") + F.col("descendants")).alias("last"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(table(spark, d, "parsed_projects"), table(spark, d, "parsed_solutions"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p4_found(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """What the next run has to process. The state of these tables is kept in one folder of the shared storage; nothing is committed here, so every call gives the same rows until a run commits."""
    return incremental.next_run(spark, table(spark, d, "files"), table(spark, d, "index_runs"), table(spark, d, "file_checkpoints"), f"files of {d}")


QUERIES = {"p2_found": p2_found, "p2_hierarchy": p2_hierarchy, "p2_descendants": p2_descendants, "p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found}

_NODES = """
 s AS (SELECT DISTINCT id, parent_id, file_id, container, name, kind FROM symbols),
 t AS (SELECT file_id, CASE WHEN container IS NULL THEN name ELSE container || '.' || name END AS k, min(id) AS tid
       FROM s WHERE kind IN ('class','interface','struct','record','enum','module') GROUP BY 1, 2),
 n AS (SELECT s.id, s.name, CASE WHEN p.id IS NOT NULL THEN p.id ELSE t.tid END AS par
       FROM s LEFT JOIN (SELECT DISTINCT id FROM s) p ON s.parent_id = p.id
              LEFT JOIN t ON s.file_id = t.file_id AND s.container = t.k)"""

_ORPHANS = r"""
 refs AS (SELECT DISTINCT 'project' AS owner_kind, id AS owner_id, parsed_at AS owner_at, r AS ref_path
            FROM (SELECT id, parsed_at, unnest(project_ref_rel_paths) AS r FROM parsed_projects WHERE removed_at IS NULL) WHERE r IS NOT NULL AND trim(r) <> ''
          UNION SELECT DISTINCT 'solution', id, parsed_at, r
            FROM (SELECT id, parsed_at, unnest(project_rel_paths) AS r FROM parsed_solutions) WHERE r IS NOT NULL AND trim(r) <> ''),
 allp AS (SELECT ref_path AS p FROM refs UNION SELECT rel_path FROM parsed_projects),
 s0 AS (SELECT p, regexp_replace(regexp_replace(lower(trim(p)), '[/\\]+', '/', 'g'), '(^|/)(\./)+', '\1', 'g') AS k FROM allp),
 s1 AS (SELECT p, regexp_replace(k, '(^|/)[^/.][^/]*/\.\./', '\1', 'g') AS k FROM s0),
 s2 AS (SELECT p, regexp_replace(k, '(^|/)[^/.][^/]*/\.\./', '\1', 'g') AS k FROM s1),
 norm AS (SELECT p, trim(regexp_replace(k, '(^|/)[^/.][^/]*/\.\./', '\1', 'g'), '/') AS k FROM s2),
 known AS (SELECT k, min(parsed_at) AS first_at, bool_and(removed_at IS NOT NULL) AS gone
           FROM parsed_projects JOIN norm ON rel_path = p GROUP BY k),
 found AS (SELECT DISTINCT owner_kind, owner_id, ref_path,
             CASE WHEN known.k IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN first_at > owner_at THEN 'late' END AS state,
             strftime(owner_at, '%Y-%m') AS period
           FROM refs JOIN norm ON refs.ref_path = norm.p LEFT JOIN known ON norm.k = known.k)"""

SQL = {
    "p2_found": f"""WITH RECURSIVE {_NODES},
 r AS (SELECT id, id AS root, 0::BIGINT AS depth FROM n WHERE par IS NULL
       UNION ALL SELECT n.id, r.root, r.depth + 1 FROM n JOIN r ON n.par = r.id)
SELECT n.id AS symbol_id, coalesce(r.root, -1) AS root_id, coalesce(r.depth, -1) AS depth FROM n LEFT JOIN r ON n.id = r.id""",
    "p2_hierarchy": f"""WITH RECURSIVE {_NODES},
 r AS (SELECT id, id AS root, 0::BIGINT AS depth, name AS path, [id] AS up FROM n WHERE par IS NULL
       UNION ALL SELECT n.id, r.root, r.depth + 1, r.path || '/' || n.name, list_append(r.up, n.id) FROM n JOIN r ON n.par = r.id),
 d AS (SELECT a AS id, count(*) - 1 AS descendants FROM (SELECT unnest(up) AS a FROM r) GROUP BY a)
SELECT n.id AS symbol_id, coalesce(r.root, -1) AS root_id, coalesce(r.depth, -1) AS depth, r.path, d.descendants
FROM n LEFT JOIN r ON n.id = r.id LEFT JOIN d ON n.id = d.id""",
    "p4_found": f"WITH {_ORPHANS} SELECT owner_kind, owner_id, ref_path, state, period FROM found WHERE state IS NOT NULL",
    "p4_report": f"""WITH {_ORPHANS} SELECT owner_kind, period, state, count(*) AS references, count(DISTINCT owner_id) AS owners
FROM found WHERE state IS NOT NULL GROUP BY 1, 2, 3""",
    "p5_found": """WITH ok AS (SELECT DISTINCT run_id, attempt FROM index_runs WHERE status = 'ok'),
 st AS (SELECT path, hash, mtime_ticks FROM
   (SELECT c.*, row_number() OVER (PARTITION BY path ORDER BY run_id DESC, attempt DESC, recorded_at DESC, checkpoint_id DESC) AS rn
    FROM file_checkpoints c JOIN ok USING (run_id, attempt)) WHERE rn = 1)
SELECT * FROM (SELECT f.id AS file_id, CASE WHEN st.path IS NULL THEN 'new'
   WHEN f.hash IS NULL OR st.hash IS NULL THEN CASE WHEN f.mtime_ticks IS DISTINCT FROM st.mtime_ticks THEN 'changed' END
   WHEN f.hash <> st.hash THEN 'changed' END AS change
 FROM (SELECT DISTINCT id, path, hash, mtime_ticks FROM files) f LEFT JOIN st USING (path)) WHERE change IS NOT NULL""",
}
