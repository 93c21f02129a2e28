"""The registered queries and their SQL.

The driver's tables hold no source code, so the code engines run on text that
:func:`generated` writes from ``part``: every metric of it is arithmetic on
``p_size``, which the SQL repeats. All queries read their tables whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import extract as E
from ..operators import graph as G
from ..operators import quality as Q
from ..operators import tabular as T
from ..session import save

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each part: a function with ``p_size % 6`` nested branches and ``p_size % 4`` more parameters."""
    k, size = F.col("p_partkey").cast("string"), F.col("p_size")
    often = lambda n, text, other=F.lit(""): F.when(size % n == 0, text).otherwise(other)
    upto = lambda n: F.filter(F.sequence(F.lit(1), F.lit(6)), lambda i: i <= n)
    name = F.concat(often(11, F.lit("F"), F.lit("f")), k)
    params = F.concat(F.lit("x"), F.array_join(F.transform(upto(size % 4), lambda i: F.concat(F.lit(", p"), i.cast("string"))), ""), often(7, F.lit(", m=[]")))
    branches = F.array_join(F.transform(upto(size % 6), lambda i: F.concat(F.repeat(F.lit("    "), i), F.lit("if x > "), i.cast("string"), F.lit(":\n"))), "")
    inside = F.repeat(F.lit("    "), (size % 6 + 1).cast("int"))
    content = F.concat(
        often(2, F.lit("import os\n")), often(5, F.concat(F.lit('password = "s3cret'), k, F.lit('"\n'))), often(3, F.concat(F.lit("# TODO(dev): part "), k, F.lit("\n"))),
        F.lit("def "), name, F.lit("("), params, F.lit(")"), F.when(size % 3 == 1, F.lit(" -> int")).otherwise(F.lit("")), F.lit(":\n"),
        F.when(size % 2 == 1, F.lit('    """Doc of a part."""\n')).otherwise(F.lit("")), branches, inside, F.lit("return x\n"), often(13, F.concat(inside, F.lit("x = 0\n"))),
    )
    # rows are small here and dear to parse later
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand").repartition(spark.sparkContext.defaultParallelism)
    return parts.select(F.col("p_brand").alias("project"), F.concat(F.lit("m"), k, F.lit(".py")).alias("path"), content.alias("content"))


SCORE_SQL = "CASE WHEN {0} >= {1} THEN 'A' WHEN {0} >= {2} THEN 'B' WHEN {0} >= {3} THEN 'C' WHEN {0} >= {4} THEN 'D' ELSE 'F' END"


def grade_sql(value: str, engine: str) -> str:
    return SCORE_SQL.format(value, *C.CUTS[engine])


@query("""SELECT p_brand AS project, 'm' || p_partkey || '.py' AS path, CASE WHEN p_size % 11 = 0 THEN 'F' ELSE 'f' END || p_partkey AS name,
  CAST(1 + p_size % 6 AS INT) AS cyclomatic, CAST((p_size % 6) * (p_size % 6 + 1) / 2 AS INT) AS cognitive, CAST(p_size % 6 AS INT) AS nesting,
  CAST(1 + p_size % 4 + CAST(p_size % 7 = 0 AS INT) AS INT) AS params,
  CAST(2 + p_size % 6 + p_size % 2 + CAST(p_size % 13 = 0 AS INT) AS INT) AS length FROM part""")
def ast_functions(spark, d):
    rows = E.facts(generated(spark, d), "functions")
    return rows.select("project", "path", "name", "cyclomatic", "cognitive", "nesting", "params", (F.col("end_line") - F.col("line") + 1).alias("length"))


@query(f"""WITH g AS (SELECT p_brand AS project, count(*) AS functions, avg(1.0 * (1 + p_size % 6)) AS avg_cyclomatic, max(1 + p_size % 6) AS max_cyclomatic,
  CAST(round_even(100 - 20.0 * sum(CASE WHEN p_size % 6 = 5 THEN 1 ELSE 0 END) / count(*), 0) AS INT) AS score FROM part GROUP BY 1)
SELECT project, functions, CAST(avg_cyclomatic AS DOUBLE) AS avg_cyclomatic, CAST(max_cyclomatic AS INT) AS max_cyclomatic, score, {grade_sql('score', 'complexity')} AS grade FROM g""")
def complexity_score(spark, d):
    files = generated(spark, d)
    return Q.complexity_score(files, E.facts(files, "functions")).select("project", "functions", "avg_cyclomatic", "max_cyclomatic", "score", "grade")


@query("""SELECT CASE WHEN p_size % 6 <= 4 THEN 'A' ELSE 'B' END AS grade, count(*) AS functions FROM part GROUP BY 1""")
def grade_distribution(spark, d):
    return E.facts(generated(spark, d), "functions").groupBy(C.cyclomatic_grade(F.col("cyclomatic")).alias("grade")).agg(F.count(F.lit(1)).alias("functions"))


@query("""SELECT p_brand AS project, 'm' || p_partkey || '.py' AS path, rule, severity FROM part,
  (VALUES ('mutable-default-arg', 7, 'warning'), ('unreachable-code', 13, 'warning')) AS r(rule, every, severity) WHERE p_size % every = 0""")
def bug_findings(spark, d):
    return E.facts(generated(spark, d), "bugs").select("project", "path", "rule", "severity")


@query(f"""WITH g AS (SELECT p_brand AS project, count(*) AS files, sum(CAST(p_size % 7 = 0 AS INT) + CAST(p_size % 13 = 0 AS INT)) AS findings FROM part GROUP BY 1),
s AS (SELECT project, files, CAST(findings AS BIGINT) AS findings, CAST(greatest(0, round_even(100 - least(100.0, 2.0 * findings / files * 12), 0)) AS INT) AS score FROM g)
SELECT *, {grade_sql('score', 'bugs')} AS grade FROM s""")
def bug_score(spark, d):
    files = generated(spark, d)
    return Q.density_score(files, E.facts(files, "bugs"), "bugs")


@query("""SELECT p_brand AS project, 'm' || p_partkey || '.py' AS path, 'hardcoded-secret' AS rule, 'high' AS severity,
  'password = "s3cret' || p_partkey || '"' AS snippet FROM part WHERE p_size % 5 = 0""")
def security_findings(spark, d):
    return E.facts(generated(spark, d), "security").select("project", "path", "rule", "severity", "snippet")


@query(f"""WITH g AS (SELECT p_brand AS project, count(*) AS files, CAST(sum(CAST(p_size % 5 = 0 AS INT)) AS BIGINT) AS findings FROM part GROUP BY 1),
s AS (SELECT *, CAST(greatest(0, 100 - CAST(trunc(CAST(4 * (15.0 * findings / files) AS DOUBLE)) AS INT)) AS INT) AS score FROM g) SELECT *, {grade_sql('score', 'security')} AS grade FROM s""")
def security_score(spark, d):
    files = generated(spark, d)
    return Q.density_score(files, E.facts(files, "security"), "security")


@query("""SELECT p_brand AS project, category, severity, count(*) AS findings FROM (
  SELECT p_brand, 'unused-import' AS category, 'medium' AS severity FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT p_brand, 'unused-function', 'low' FROM part
  UNION ALL SELECT p_brand, 'unreachable-code', 'medium' FROM part WHERE p_size % 13 = 0
  UNION ALL SELECT p_brand, 'unused-argument', 'info' FROM part, range(1, 5) AS t(i) WHERE i <= p_size % 4 + CAST(p_size % 7 = 0 AS INT)) GROUP BY ALL""")
def dead_code_counts(spark, d):
    found = Q.dead_code(generated(spark, d), save(E.extract(generated(spark, d), "dead", "definitions"), "facts"))
    return found.groupBy("project", "category", "severity").agg(F.count(F.lit(1)).alias("findings"))


@query("""SELECT p_brand AS project, 'm' || p_partkey || '.py' AS path, 'F' || p_partkey AS name, 'f' || p_partkey AS suggestion FROM part WHERE p_size % 11 = 0""")
def naming_violations(spark, d):
    return Q.naming_violations(E.facts(generated(spark, d), "identifiers")).select("project", "path", "name", "suggestion")


@query("""SELECT p_brand AS project, issue, severity, count(*) AS issues FROM (
  SELECT p_brand, 'missing' AS issue, 'medium' AS severity FROM part
  UNION ALL SELECT p_brand, 'missing', 'medium' FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT p_brand, 'no_params', 'low' FROM part WHERE p_size % 2 = 1) GROUP BY ALL""")
def docstring_issues(spark, d):
    return Q.docstring_issues(E.facts(generated(spark, d), "entities")).groupBy("project", "issue", "severity").agg(F.count(F.lit(1)).alias("issues"))


@query("""SELECT p_brand AS project, count(*) AS functions, CAST(sum(1 + p_size % 4 + CAST(p_size % 7 = 0 AS INT)) AS BIGINT) AS params,
  CAST(sum(CAST(p_size % 3 = 1 AS INT)) AS BIGINT) AS returns FROM part GROUP BY 1""")
def type_coverage(spark, d):
    x = E.extract(generated(spark, d), "signatures", "any_usages", "type_ignores")
    return Q.type_score(*(E.rows_of(x, f) for f in ("signatures", "any_usages", "type_ignores"))).select("project", "functions", "params", "returns")


@query("""SELECT p_brand AS project, 'm' || p_partkey || '.py' AS path, 'TODO' AS tag, 'dev' AS author, 'part ' || p_partkey AS message, 'medium' AS severity FROM part WHERE p_size % 3 = 0""")
def debt_markers(spark, d):
    return Q.debt_markers(generated(spark, d)).select("project", "path", "tag", "author", "message", "severity")


@query()
def debt_score(spark, d):
    return Q.debt_score(generated(spark, d))


@query("""SELECT p_brand AS project, p_size % 6 AS nesting, count(*) AS members FROM (SELECT p_brand, p_size, p_partkey FROM part) GROUP BY ALL""")
def nesting_groups(spark, d):
    return E.facts(generated(spark, d), "functions").groupBy("project", "nesting").agg(F.count(F.lit(1)).alias("members"))


@query()
def exact_clones(spark, d):
    return T.exact_clones(E.facts(generated(spark, d), "blocks"))


@query()
def health_rollup(spark, d):
    files = generated(spark, d)
    return Q.health(Q.all_scores(files, E.extract(files, *Q.HEALTH_FACETS)))


# families on the tables themselves


def parts_sold(spark, d) -> DataFrame:
    pairs = table(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("src"), (F.col("l_partkey") % 40 + 20).alias("dst"))
    return pairs.where("src <> dst").distinct().select(F.lit("trade").alias("project"), "src", "dst")


EDGES = "e AS (SELECT DISTINCT l_suppkey % 40 AS src, l_partkey % 40 + 20 AS dst FROM lineitem WHERE l_suppkey % 40 <> l_partkey % 40 + 20), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"
FANS = f"WITH {EDGES}, f AS (SELECT node, (SELECT count(DISTINCT src) FROM e WHERE dst = node) AS ca, (SELECT count(DISTINCT dst) FROM e WHERE src = node) AS ce FROM n)"


def coupling_of(edges: DataFrame) -> DataFrame:
    nodes = edges.select("project", F.col("src").alias("node")).union(edges.select("project", "dst")).distinct()
    return G.coupling(nodes, edges)


def trade_metrics(spark, d) -> DataFrame:
    return coupling_of(parts_sold(spark, d))


@query(f"{FANS} SELECT node, ca, ce, ce::DOUBLE / (ca + ce) AS instability, ca * ce AS hub FROM f")
def coupling(spark, d):
    return trade_metrics(spark, d).select("node", "ca", "ce", "instability", "hub")


@query(f"""{FANS}, i AS (SELECT *, ce::DOUBLE / (ca + ce) AS x FROM f) SELECT count(*) AS modules, round(avg(x), 9) AS avg_instability, median(x) AS median_instability,
  CAST(sum(CASE WHEN x = 0 AND ca > 0 THEN 1 ELSE 0 END) AS BIGINT) AS stable, CAST(sum(CASE WHEN x = 1 AND ce > 0 THEN 1 ELSE 0 END) AS BIGINT) AS unstable FROM i""")
def coupling_summary(spark, d):
    return G.coupling_summary(trade_metrics(spark, d)).select("modules", F.round("avg_instability", 9).alias("avg_instability"), "median_instability", "stable", "unstable")


# the same over whole keys: every supplier and every part is a node of its own


def supplied(spark, d) -> DataFrame:
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    pairs = table(spark, d, "lineitem").select(key("s", "l_suppkey").alias("src"), key("p", "l_partkey").alias("dst"))
    return pairs.dropna().distinct().select(F.lit("trade").alias("project"), "src", "dst")


WHOLE_FANS = """WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL),
  i AS (SELECT dst AS node, count(DISTINCT src) AS fan FROM e GROUP BY 1), o AS (SELECT src AS node, count(DISTINCT dst) AS fan FROM e GROUP BY 1),
  f AS (SELECT coalesce(i.node, o.node) AS node, coalesce(i.fan, 0) AS ca, coalesce(o.fan, 0) AS ce FROM i FULL JOIN o ON i.node = o.node)"""


@query(f"{WHOLE_FANS} SELECT node, ca, ce, ce::DOUBLE / (ca + ce) AS instability, ca * ce AS hub FROM f")
def supply_coupling(spark, d):
    return coupling_of(supplied(spark, d)).select("node", "ca", "ce", "instability", "hub")


@query(f"""{WHOLE_FANS}, i2 AS (SELECT *, ce::DOUBLE / (ca + ce) AS x FROM f) SELECT count(*) AS modules, CAST(sum(ca) AS BIGINT) AS edges, max(ca) AS max_ca, max(ce) AS max_ce, round(avg(x), 9) AS avg_instability, median(x) AS median_instability,
  CAST(sum(CASE WHEN x = 0 AND ca > 0 THEN 1 ELSE 0 END) AS BIGINT) AS stable, CAST(sum(CASE WHEN x = 1 AND ce > 0 THEN 1 ELSE 0 END) AS BIGINT) AS unstable FROM i2""")
def supply_coupling_summary(spark, d):
    metrics = coupling_of(supplied(spark, d))
    fans = metrics.groupBy("project").agg(F.sum("ca").alias("edges"), F.max("ca").alias("max_ca"), F.max("ce").alias("max_ce"))
    return G.coupling_summary(metrics).join(fans, "project").select("modules", "edges", "max_ca", "max_ce", F.round("avg_instability", 9).alias("avg_instability"), "median_instability", "stable", "unstable")


NEXT = "(SELECT p_partkey AS src, p_partkey // 3 AS dst FROM part WHERE p_partkey // 3 > 0)"


def thirds(spark, d) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, d, "part").select(F.lit("tree").alias("project"), key.alias("src"), F.floor(key / 3).alias("dst")).where("dst > 0")


@query(f"""WITH RECURSIVE r AS (SELECT src AS node, 1 AS depth FROM {NEXT} WHERE dst = 1 UNION ALL SELECT t.src, r.depth + 1 FROM r JOIN {NEXT} t ON t.dst = r.node WHERE r.depth < 10)
SELECT node, min(depth) AS depth, node // 3 AS parent FROM r GROUP BY node""")
def impact_bfs(spark, d):
    changed = spark.createDataFrame([("tree", 1)], "project string, node bigint")
    return G.impact(thirds(spark, d), changed).select("node", "depth", "parent")


@query(f"""WITH RECURSIVE r AS (SELECT src AS node, dst AS up FROM {NEXT} UNION ALL SELECT r.node, r.up // 3 FROM r WHERE r.up // 3 > 0)
SELECT node, min(up) AS root FROM (SELECT * FROM r UNION ALL SELECT dst, dst FROM {NEXT}) GROUP BY node""")
def connected_components(spark, d):
    return G.components(thirds(spark, d)).select("node", "root")


@query()
def cycle_members(spark, d):
    key = F.col("p_partkey")
    edges = table(spark, d, "part").select(F.lit("ring").alias("project"), key.alias("src"), F.when(key % 10 == 9, key - 8).otherwise(key + 1).alias("dst"))
    return G.cycle_members(edges)


def orders_as_churn(spark, d) -> DataFrame:
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    stat = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("project"), F.col("o_custkey").cast("string").alias("path"), F.col("l_quantity").cast("bigint").alias("added"), F.col("l_linenumber").cast("bigint").alias("deleted"))
    changed = T.churn(stat)
    hard = stat.groupBy("project", "path").agg(F.max("deleted").alias("max_cc"))
    return T.hotspots(changed, hard)


HOT = """WITH c AS (SELECT o_orderpriority AS project, CAST(o_custkey AS VARCHAR) AS path, count(*) AS commits, sum(CAST(l_quantity AS BIGINT)) AS added, sum(CAST(l_linenumber AS BIGINT)) AS deleted,
  max(CAST(l_linenumber AS BIGINT)) AS max_cc FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
s AS (SELECT *, sqrt(commits::DOUBLE) * sqrt((added + deleted)::DOUBLE) AS churn FROM c),
m AS (SELECT *, min(churn) OVER w AS lo, max(churn) OVER w AS hi, min(max_cc) OVER w AS l2, max(max_cc) OVER w AS h2 FROM s WINDOW w AS (PARTITION BY project)),
x AS (SELECT *, CASE WHEN hi = lo THEN 0.5::DOUBLE ELSE (churn - lo) / (hi - lo) END AS x, CASE WHEN h2 = l2 THEN 0.5::DOUBLE ELSE (max_cc - l2)::DOUBLE / (h2 - l2) END AS y FROM m),
h AS (SELECT project, path, x * y AS hotspot, CASE WHEN x * y >= 0.7 THEN 'critical' WHEN x * y >= 0.4 THEN 'high' WHEN x * y >= 0.2 THEN 'medium' ELSE 'low' END AS risk,
  CASE WHEN x >= 0.6 AND y >= 0.6 THEN 'dual' WHEN y >= 0.6 THEN 'complexity_driven' WHEN x >= 0.6 THEN 'churn_driven' ELSE 'balanced' END AS category FROM x) """


@query(HOT + "SELECT project, path, round(hotspot, 6) AS hotspot, risk, category FROM h")
def hotspot_rank(spark, d):
    return orders_as_churn(spark, d).select("project", "path", F.round("hotspot", 6).alias("hotspot"), "risk", "category")


@query(HOT + "SELECT project, risk, category, count(*) AS files FROM h GROUP BY ALL")
def hotspot_categories(spark, d):
    return orders_as_churn(spark, d).groupBy("project", "risk", "category").agg(F.count(F.lit(1)).alias("files"))


@query()
def hotspot_score(spark, d):
    return T.hotspot_score(orders_as_churn(spark, d))


STATUS = {"F": "low", "O": "medium", "P": "critical"}


@query("""WITH w AS (SELECT l_orderkey AS sha, CAST(sum(CASE l_returnflag WHEN 'R' THEN 10 WHEN 'A' THEN 3 ELSE 0 END) AS BIGINT) AS weight, count(*) AS findings FROM lineitem GROUP BY 1),
s AS (SELECT o_orderkey AS sha, coalesce(findings, 0) AS findings, CAST(greatest(0, 100 - coalesce(weight, 0)) AS INT) AS score FROM orders LEFT JOIN w ON o_orderkey = sha)
SELECT *, CASE WHEN score >= 97 THEN 'A+' WHEN score >= 93 THEN 'A' WHEN score >= 90 THEN 'A-' WHEN score >= 87 THEN 'B+' WHEN score >= 83 THEN 'B' WHEN score >= 80 THEN 'B-'
  WHEN score >= 77 THEN 'C+' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s""")
def commit_scores(spark, d):
    severity = C.lookup(F.col("l_returnflag"), {"R": "high", "A": "medium"}, "info")
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha"), severity.alias("severity"))
    none = found.select("sha", F.lit(0).alias("cyclomatic")).where(F.lit(False))
    return T.commit_scores(table(spark, d, "orders").select(F.col("o_orderkey").alias("sha")), found, none).select("sha", "findings", "score", "grade")


def parts_as_dependencies(spark, d) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    return table(spark, d, "part").select(
        F.lit("shop").alias("project"), F.concat(F.lit("Pkg_"), F.floor(key / 2).cast("string")).alias("name"), F.when(size % 4 == 1, ">=").when(size % 4 > 1, "==").alias("constraint"),
        F.when(size % 4 > 0, F.concat_ws(".", (size % 3).cast("string"), (size % 5).cast("string"), (key % 7).cast("string"))).alias("version"), F.concat(F.lit("req"), (key % 3).cast("string"), F.lit(".txt")).alias("source_file"),
    )


@query("""WITH p AS (SELECT 'pkg-' || (p_partkey // 2) AS norm, p_size % 4 AS k, (p_size % 3) || '.' || (p_size % 5) || '.' || (p_partkey % 7) AS version, p_partkey % 3 AS f FROM part)
SELECT norm, 'unpinned' AS "check", 'MODERATE' AS severity FROM p WHERE k = 0 UNION ALL SELECT norm, 'wildcard', 'LOW' FROM p WHERE k = 1
UNION ALL SELECT norm, 'duplicate', 'MODERATE' FROM p GROUP BY norm HAVING count(DISTINCT f) > 1
UNION ALL SELECT norm, 'conflict', 'HIGH' FROM p GROUP BY norm HAVING count(DISTINCT CASE WHEN k > 1 THEN version END) > 1""")
def dependency_findings(spark, d):
    return T.dependency_findings(parts_as_dependencies(spark, d)).select("norm", "check", "severity")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 > 1 OR (p_size % 3 = 1 AND (p_size % 5 > 2 OR (p_size % 5 = 2 AND p_partkey % 7 >= 3))) THEN 'up-to-date'
  WHEN p_size % 3 <> 1 THEN 'major' WHEN p_size % 5 <> 2 THEN 'minor' ELSE 'patch' END AS update_kind FROM part""")
def version_classify(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    version = F.concat_ws(".", (size % 3).cast("string"), (size % 5).cast("string"), (key % 7).cast("string"))
    return table(spark, d, "part").select("p_partkey", C.update_kind(version, F.lit("1.2.3")).alias("update_kind"))


@query("""SELECT 'undefined' AS "check", CAST(o_custkey AS VARCHAR) AS name, 'HIGH' AS severity FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'unused', CAST(c_custkey AS VARCHAR), 'LOW' FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'missing_template', CAST(c_custkey AS VARCHAR), 'MODERATE' FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders)""")
def environment_findings(spark, d):
    defs = table(spark, d, "customer").where("c_acctbal > 0").select(F.lit("shop").alias("project"), F.col("c_custkey").cast("string").alias("name"), F.lit("v").alias("value"), F.lit(".env").alias("file"), F.col("c_custkey").alias("line"), F.lit("actual").alias("kind"))
    refs = table(spark, d, "orders").select(F.lit("shop").alias("project"), F.col("o_custkey").cast("string").alias("name"))
    return T.environment_findings(defs, refs).select("check", "name", "severity")


@query("""SELECT c_custkey, lower(c_name) = c_name AS snake, replace(lower(c_name), '#', '#') AS lowered FROM customer""")
def case_styles(spark, d):
    name = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", (F.lower(name) == name).alias("snake"), F.lower(name).alias("lowered"))


@query(r"""WITH n AS (SELECT 'customer' AS kind, c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT 'part', p_partkey, p_name FROM part),
b AS (SELECT *, ltrim(name, '_') AS bare, regexp_extract(name, '^_*') AS lead FROM n)
SELECT kind, key, length(bare) <= 1 OR (name LIKE '\_\_%' ESCAPE '\' AND name LIKE '%\_\_' ESCAPE '\') OR regexp_matches(name, '^_*[a-z][a-z0-9_]*$') AS snake,
  length(bare) <= 1 OR regexp_matches(name, '^_*[A-Z][a-zA-Z0-9]*$') AS camel,
  lead || lower(regexp_replace(regexp_replace(bare, '([A-Z])([A-Z][a-z])', '\1_\2', 'g'), '([^A-Z])([A-Z])', '\1_\2', 'g')) AS to_snake,
  lead || array_to_string(list_transform(list_filter(string_split(bare, '_'), lambda p: p <> ''), lambda p: upper(p[1]) || lower(p[2:])), '') AS to_camel FROM b""")
def name_styles(spark, d):
    names = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    name, names = F.col("name"), names.union(table(spark, d, "part").select(F.lit("part"), "p_partkey", "p_name"))
    return names.select("kind", "key", C.is_snake(name).alias("snake"), C.is_camel(name).alias("camel"), C.to_snake(name).alias("to_snake"), C.to_camel(name).alias("to_camel"))


@query("""SELECT doc_id, regexp_matches(text, '\\b(?:[0-9]{1,3}\\.){3}[0-9]{1,3}\\b') AS has_address, regexp_matches(text, '(?i)\\btoken\\s*=\\s*"') AS has_secret FROM documents WHERE text IS NOT NULL""")
def scan_text(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.rlike(r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b").alias("has_address"), text.rlike(r'(?i)\btoken\s*=\s*"').alias("has_secret"))


def severity_of(kind: Column) -> Column:
    return C.lookup(kind, {"error": "high", "signup": "medium", "purchase": "low"}, "info")


@query("""SELECT user_id, count(*) AS findings, CAST(sum(CASE event_type WHEN 'error' THEN 5 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 1 ELSE 0 END) AS DOUBLE) AS weight FROM events GROUP BY 1""")
def weighted_density(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("project"), severity_of(F.col("event_type")).alias("severity"))
    return Q.weighted(rows, "tests").select(F.col("project").cast("bigint").alias("user_id"), "findings", "weight")


@query("""SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def events_by_day(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
