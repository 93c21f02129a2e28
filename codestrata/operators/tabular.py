"""Engines whose input is tables: dependencies, environment variables, churn, commits and clones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import save
from .extract import lines

# dependencies: deps(project, name, constraint, version, source_file)


def dependency_findings(deps: DataFrame) -> DataFrame:
    """Unpinned, wildcard, duplicate, conflicting and misplaced dependencies; a null version is no version."""
    rows = deps.withColumn("norm", C.package_name(F.col("name")))
    version, op = F.coalesce("version", F.lit("")), F.coalesce("constraint", F.lit(""))
    tools = ("pytest", "black", "ruff", "mypy", "flake8", "isort", "pylint", "tox", "coverage", "pre-commit")

    def finding(frame: DataFrame, check: str, severity: Column) -> DataFrame:
        return frame.select("project", "norm", F.lit(check).alias("check"), severity.alias("severity"))

    loose = op.isin(">=", ">", "!=")
    several = rows.groupBy("project", "norm").agg(F.countDistinct("source_file").alias("files"), F.countDistinct(F.when(op == "==", F.col("version"))).alias("pins"))
    parts = [
        finding(rows.where((version == "") & (op == "")), "unpinned", F.lit("MODERATE")),
        finding(rows.where(loose | version.contains("*")), "wildcard", F.when(loose, "LOW").otherwise("MODERATE")),
        finding(several.where("files > 1"), "duplicate", F.lit("MODERATE")),
        finding(several.where("pins > 1"), "conflict", F.lit("HIGH")),
        finding(rows.where(F.col("norm").isin(*tools) & ~F.lower("source_file").rlike("dev|test")), "hygiene", F.lit("INFO")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def audit_dependencies(deps: DataFrame, latest: DataFrame, advisories: DataFrame) -> DataFrame:
    """Each dependency with its update kind, number of advisories and gravest severity."""
    order = C.rank(F.col("severity"), "dependencies")
    grave = advisories.groupBy(F.col("package").alias("norm")).agg(F.count(F.lit(1)).alias("advisories"), F.max_by("severity", order).alias("max_severity"))
    rows = deps.withColumn("norm", C.package_name(F.col("name"))).join(latest.select(F.col("package").alias("norm"), "latest"), "norm", "left").join(grave, "norm", "left")
    return rows.withColumn("update", F.when(F.col("version").isNotNull() & F.col("latest").isNotNull(), C.update_kind(F.col("version"), F.col("latest")))).na.fill(0, ["advisories"]).na.fill("NONE", ["max_severity"])


# environment: defs(project, name, value, file, line, kind), refs(project, name)


def environment_findings(defs: DataFrame, refs: DataFrame, env_files: DataFrame | None = None) -> DataFrame:
    """The eight checks; a project of ``refs`` without env files (``env_files(project)``, else those of ``defs``) has ``no_env_files`` alone."""
    having = (defs if env_files is None else env_files).select("project").distinct()
    used = refs.select("project", "name").distinct()
    names = lambda kind: defs.where(F.col("kind") == kind).select("project", "name").distinct()
    actual, template = names("actual"), names("template")

    def finding(frame: DataFrame, check: str, severity: str) -> DataFrame:
        return frame.select("project", "name", F.lit(check).alias("check"), F.lit(severity).alias("severity"))

    again = F.row_number().over(Window.partitionBy("project", "file", "name").orderBy("line"))
    secret = F.col("name").rlike(C.SECRET_NAME) & (F.coalesce("value", F.lit("")) != "") & ~F.col("value").rlike(C.PLACEHOLDER_VALUE)
    parts = [
        finding(used.select("project").distinct().join(having, "project", "left_anti").withColumn("name", F.lit("*")), "no_env_files", "MODERATE"),
        finding(used.join(defs.select("project", "name").distinct(), ["project", "name"], "left_anti").join(having, "project", "left_semi"), "undefined", "HIGH"),
        finding(defs.select("project", "name").distinct().join(used, ["project", "name"], "left_anti"), "unused", "LOW"),
        finding(actual.join(template, ["project", "name"], "left_anti").join(used, ["project", "name"], "left_semi"), "missing_template", "MODERATE"),
        finding(template.join(actual, ["project", "name"], "left_anti").join(actual.select("project").distinct(), "project", "left_semi"), "missing_actual", "MODERATE"),
        finding(defs.where((F.col("kind") == "template") & secret), "secret_in_template", "HIGH"),
        finding(defs.withColumn("nth", again).where("nth > 1"), "duplicate", "LOW"),
        finding(defs.where((F.col("kind") == "actual") & (F.coalesce("value", F.lit("")) == "")), "empty", "INFO"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def environment_score(findings: DataFrame, variables: DataFrame) -> DataFrame:
    """100 less the weight of the findings as a share of ten for each variable (``project, variables``)."""
    weight = findings.groupBy("project").agg(F.sum(C.lookup(F.col("severity"), C.WEIGHTS["environment"], 0)).alias("weight"))
    joined = variables.join(weight, "project", "left").na.fill(0, ["weight"])
    score = (100 * (1 - F.least(F.col("weight") / (10 * F.greatest("variables", F.lit(1))), F.lit(1.0)))).cast("int")
    return joined.select("project", "variables", "weight", score.alias("score")).withColumn("grade", C.grade(F.col("score"), "environment"))


#: The env files of a project's root; those with a word of TEMPLATE in their name are templates.
ENV_FILES = (".env", *(f".env.{x}" for x in ("local", "development", "production", "staging", "test", "example", "sample", "template", "defaults")))
TEMPLATE = "example|sample|template|defaults"
#: Endings of source files, and what refers to a variable in them.
ENV_REFERENCES = {
    r"\.py$": (r"""os\.environ(?:\.get)?\s*\[\s*['"](\w+)['"]\s*\]""", r"""os\.environ\.get\s*\(\s*['"](\w+)['"]""", r"""os\.getenv\s*\(\s*['"](\w+)['"]""", r"""(?:config|env)\s*\(\s*['"](\w+)['"]"""),
    r"\.(?:js|jsx|ts|tsx|mjs|cjs)$": (r"process\.env\.([A-Z_][A-Z0-9_]*)", r"""process\.env\[\s*['"](\w+)['"]\s*\]""", r"import\.meta\.env\.([A-Z_][A-Z0-9_]*)"),
    r"\.(?:sh|bash|zsh)$": (r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", r"\$([A-Z_][A-Z0-9_]{2,})"),
}
SYSTEM_VARS = (
    "HOME", "PATH", "USER", "SHELL", "TERM", "LANG", "LC_ALL", "PWD", "OLDPWD", "HOSTNAME", "LOGNAME", "DISPLAY", "EDITOR", "VISUAL", "PAGER", "TMPDIR", "TMP", "TEMP",
    "XDG_CONFIG_HOME", "XDG_DATA_HOME", "XDG_CACHE_HOME", "CI", "GITHUB_ACTIONS", "VERCEL", "NETLIFY", "HEROKU", "NODE_ENV", "PYTHONPATH", "PYTHONDONTWRITEBYTECODE", "VIRTUAL_ENV", "CONDA_DEFAULT_ENV", "npm_package_version",
)


def is_env_file(path: Column) -> Column:
    return F.coalesce(path, F.lit("")).isin(*ENV_FILES)


def environment_references(files: DataFrame) -> DataFrame:
    """``project``, ``path``, ``line``, ``name`` of what source text refers to, without comment lines and system variables."""
    def found(ending: str, pattern: str) -> Column:
        return F.when(F.lower("path").rlike(ending), F.regexp_extract_all("text", F.lit("(?U)" + pattern), F.lit(1))).otherwise(F.array().cast("array<string>"))

    content = F.col("content")
    # without one of these no pattern matches, so the lines of most files are never made
    likely = files.where(content.contains("env") | content.contains("config") | content.contains("$"))
    rows = lines(likely).where(~F.col("text").rlike(r"^\s*(?:#|//)"))
    names = F.flatten(F.array(*(found(ending, p) for ending, patterns in ENV_REFERENCES.items() for p in patterns)))
    return rows.select("project", "path", "line", F.explode(names).alias("name")).where(~F.col("name").isin(*SYSTEM_VARS))


def environment_definitions(files: DataFrame) -> DataFrame:
    """``project``, ``name``, ``value``, ``file``, ``line``, ``kind`` of the variables of env files."""
    text = F.regexp_replace(F.regexp_replace("text", r"^\s+|\s+$", ""), r"^export \s*", "")
    name = F.regexp_extract(text, r"^([A-Za-z_][A-Za-z0-9_]*)\s*(?:=|$)", 1)
    value = F.regexp_replace(F.regexp_extract(text, r"^[^=]*=\s*(.*)$", 1), r"""^(['"])(.*)\1$""", "$2")
    kind = F.when(F.col("path").rlike(TEMPLATE), "template").otherwise("actual")
    return lines(files.where(is_env_file(F.col("path")))).select("project", name.alias("name"), value.alias("value"), F.col("path").alias("file"), "line", kind.alias("kind")).where("name <> ''")


def environment_of(files: DataFrame, paths: DataFrame) -> DataFrame:
    """The score of every project of ``files``, whose ``project, path`` are ``paths``; a variable misses in the template only where there is one.

    Texts are read once for each of the two tables, which are saved.
    """
    defs = save(environment_definitions(files), "definitions")
    refs = save(environment_references(files).select("project", "name").distinct(), "references")
    templates = defs.where("kind = 'template'").select("project").distinct().withColumn("templates", F.lit(True))
    findings = environment_findings(defs, refs, paths.where(is_env_file(F.col("path")))).join(templates, "project", "left").where("check <> 'missing_template' or templates")
    names = defs.select("project", "name").union(refs.select("project", "name")).groupBy("project").agg(F.countDistinct("name").alias("variables"))
    return environment_score(findings, paths.select("project").distinct().join(names, "project", "left").na.fill(0, ["variables"]))


# churn: churn(project, path, commits, added, deleted), complexity(project, path, max_cc)


def churn(numstat: DataFrame, since: Column | None = None) -> DataFrame:
    """Commits and changed lines of each path from ``numstat(project, path, ts, added, deleted)``."""
    rows = numstat if since is None else numstat.where(F.col("ts") >= since)
    return rows.groupBy("project", "path").agg(F.count(F.lit(1)).alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def hotspots(churned: DataFrame, complexity: DataFrame) -> DataFrame:
    """Product of churn and complexity, each scaled to 0..1 in its project (0.5 where all are alike), with risk and category."""
    changed = F.col("added") + F.col("deleted")
    rows = churned.join(complexity, ["project", "path"]).withColumn("churn", F.sqrt(F.col("commits").cast("double")) * F.sqrt(changed.cast("double")))
    ends = rows.groupBy("project").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("churn", "max_cc") for f in (F.min, F.max)))

    def scaled(c: str) -> Column:
        low, high = F.col(f"min_{c}"), F.col(f"max_{c}")
        return F.when(high == low, 0.5).otherwise((F.col(c) - low) / (high - low))

    rows = rows.join(ends, "project").withColumn("x", scaled("churn")).withColumn("y", scaled("max_cc")).withColumn("hotspot", F.col("x") * F.col("y"))
    risk = C.steps(F.col("hotspot"), [(0.7, "critical"), (0.4, "high"), (0.2, "medium")], "low")
    x, y = F.col("x"), F.col("y")
    category = F.when((x >= 0.6) & (y >= 0.6), "dual").when(y >= 0.6, "complexity_driven").when(x >= 0.6, "churn_driven").otherwise("balanced")
    return rows.select("project", "path", "churn", "max_cc", "hotspot", risk.alias("risk"), category.alias("category"))


def hotspot_score(ranked: DataFrame) -> DataFrame:
    count = lambda r: F.sum(F.when(F.col("risk") == r, 1).otherwise(0))
    agg = ranked.groupBy("project").agg(F.count(F.lit(1)).alias("files"), count("critical").alias("critical"), count("high").alias("high"), count("medium").alias("medium"))
    risky = 100.0 * (F.col("critical") + F.col("high")) / F.col("files")
    raw = 100 - F.least(15 * F.col("critical"), F.lit(45)) - F.least(8 * F.col("high"), F.lit(32)) - F.least(3 * F.col("medium"), F.lit(15)) - F.least(0.08 * risky, F.lit(8.0))
    return agg.withColumn("score", C.clamped(C.half_even(raw)).cast("int")).withColumn("grade", C.grade(F.col("score"), "hotspots"))


# commits: commits(sha, ...), findings(sha, severity), complexity(sha, cyclomatic)


def commit_scores(commits: DataFrame, findings: DataFrame, complexity: DataFrame) -> DataFrame:
    """Score and grade of every commit from what it brought in."""
    weight = findings.groupBy("sha").agg(F.count(F.lit(1)).alias("findings"), F.sum(C.lookup(F.col("severity"), C.WEIGHTS["commits"], 0)).alias("weight"))
    cc = F.col("cyclomatic")
    hard = complexity.groupBy("sha").agg(F.sum(F.when(cc >= 20, 5).when(cc >= 15, 3).when(cc >= 10, 1).otherwise(0)).alias("hard"))
    joined = commits.join(weight, "sha", "left").join(hard, "sha", "left").na.fill(0, ["findings", "weight", "hard"])
    return joined.withColumn("score", C.clamped(100 - F.col("weight") - F.col("hard")).cast("int")).withColumn("grade", C.steps(F.col("score"), C.COMMIT_GRADES, "F"))


# clones: blocks of facets.blocks


def exact_clones(blocks: DataFrame) -> DataFrame:
    """Groups of blocks that are alike but for names and literals; one hash shuffle, no pairs."""
    return blocks.groupBy("project", F.sha2("normalized", 256).alias("shape")).agg(
        F.count(F.lit(1)).alias("members"), F.countDistinct(F.sha2("source", 256)).alias("sources"), (F.sum(F.col("end_line") - F.col("start_line") + 1) - F.max(F.col("end_line") - F.col("start_line") + 1)).alias("duplicated_lines"),
    ).where("members > 1").withColumn("kind", F.when(F.col("sources") == 1, "type-1").otherwise("type-2"))


def grams(text: Column, n: int = 4) -> Column:
    """Distinct character n-grams; a shorter text is one gram, an empty one has none."""
    size = F.length(text)
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def near_clones(blocks: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of blocks with unlike shapes whose grams overlap by 0.6 of the threshold at least.

    Two such sets must share a gram among the rarest ``size - needed + 1`` of
    each (prefix filter), so candidates come from an equi-join on rare grams.
    """
    least = 0.6 * threshold
    ids = blocks.select("project", F.xxhash64("path", "name", "start_line").alias("id"), F.sha2("normalized", 256).alias("shape"), "nodes", F.length("normalized").alias("size"), grams(F.col("normalized")).alias("grams"))
    each = ids.select("project", "id", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    counts = each.groupBy("project", "gram").count()
    place = F.row_number().over(Window.partitionBy("project", "id").orderBy("count", "gram"))
    rare = each.join(counts, ["project", "gram"]).withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("project", "id", "gram")
    pairs = rare.join(rare.withColumnRenamed("id", "other"), ["project", "gram"]).where("id < other").select("project", "id", "other").distinct()
    a, b = (ids.select("project", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "shape", "nodes", "size", "grams"))) for s in "ab")
    both = pairs.join(a.withColumnRenamed("id_a", "id"), ["project", "id"]).join(b.withColumnRenamed("id_b", "other"), ["project", "other"])
    ratio = lambda c: F.least(f"{c}_a", f"{c}_b") / F.greatest(f"{c}_a", f"{c}_b")
    found = both.where("shape_a <> shape_b").where((ratio("nodes") >= 0.7 * threshold) & (ratio("size") >= 0.8 * threshold))
    return found.withColumn("similarity", jaccard(F.col("grams_a"), F.col("grams_b"))).where(F.col("similarity") >= least).select("project", F.col("id").alias("a"), F.col("other").alias("b"), "similarity")
