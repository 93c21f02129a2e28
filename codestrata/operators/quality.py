"""Findings and scores for each project, as aggregates over fact tables.

Every score is one row for each project that has files; a project without
functions, tests, names or findings scores 100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import save
from . import graph, tabular
from .extract import facts, lines


def share(part: Column, whole: Column, empty: float = 1.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def projects(files: DataFrame) -> DataFrame:
    return files.groupBy("project").agg(F.count(F.lit(1)).alias("files"))


def weighted(findings: DataFrame, engine: str) -> DataFrame:
    """Number and weight of each project's findings."""
    weight = C.lookup(F.col("severity"), C.WEIGHTS[engine], 0)
    return findings.groupBy("project").agg(F.count(F.lit(1)).alias("findings"), F.sum(weight.cast("double")).alias("weight"))


def density_score(files: DataFrame, findings: DataFrame, engine: str) -> DataFrame:
    """Score and grade from the weighted findings for each file."""
    joined = projects(files).join(weighted(findings, engine), "project", "left").na.fill(0, ["findings", "weight"])
    density = F.col("weight") / F.col("files")
    if engine == "security":
        score = C.clamped(100 - (4 * density).cast("int"))
    else:
        score = C.clamped(C.half_even(100 - F.least(F.lit(100.0), density * (12 if engine == "bugs" else 8))))
    return joined.select("project", "files", "findings", score.cast("int").alias("score")).withColumn("grade", C.grade(F.col("score"), engine))


def profile(findings: DataFrame, kind: str, labels: dict[str, str], clean_to: int) -> DataFrame:
    """The profile of the finding kind that is over half of all; the first seen wins ties."""
    each = findings.groupBy("project", F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "line")).alias("first"))
    order = Window.partitionBy("project").orderBy(F.desc("n"), "first", "kind")
    top = each.withColumn("total", F.sum("n").over(Window.partitionBy("project"))).withColumn("place", F.row_number().over(order)).where("place = 1")
    named = F.when(F.col("total") <= clean_to, "clean").when(F.col("n") * 2 > F.col("total"), C.lookup(F.col("kind"), labels, "mixed")).otherwise("mixed")
    return top.select("project", F.col("kind").alias("dominant"), (100.0 * F.col("n") / F.col("total")).alias("dominant_pct"), named.alias("profile"))


BUG_PROFILES = {"missing-fstring": "fstring_heavy", "late-binding-closure": "closure_heavy", "mutable-class-var": "class_var_heavy", "mutable-default-arg": "default_heavy", "call-default": "default_heavy"}
DEAD_PROFILES = {f"unused-{x}": f"{x}_heavy" for x in ("import", "function", "variable", "argument")}
DEAD_SEVERITY = {"unused-import": "medium", "unused-function": "low", "unused-variable": "low", "unused-argument": "info", "unreachable-code": "medium"}


# complexity


def complexity_score(files: DataFrame, functions: DataFrame, cyclomatic: int = 10, cognitive: int = 15, length: int = 50) -> DataFrame:
    rows = functions.withColumn("grade", C.cyclomatic_grade(F.col("cyclomatic"))).withColumn("length", F.col("end_line") - F.col("line") + 1)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    extreme = F.col("grade").isin("D", "F")
    cc, cog = F.col("cyclomatic") >= cyclomatic, F.col("cognitive") >= cognitive
    agg = rows.groupBy("project").agg(
        F.count(F.lit(1)).alias("n"), F.sum(C.lookup(F.col("grade"), {"A": 0, "B": 1, "C": 3, "D": 8, "F": 20})).alias("penalty"), count(extreme).alias("extreme"), count(cc).alias("cc"), count(cog).alias("cog"),
        count(F.col("nesting") >= 4).alias("deep"), count(F.col("grade").isin("A", "B")).alias("plain"), count(~F.col("grade").isin("A", "B")).alias("hard"),
        count(cc | cog | (F.col("length") >= length)).alias("violations"), F.avg("cyclomatic").alias("avg_cyclomatic"), F.avg("cognitive").alias("avg_cognitive"), F.max("cyclomatic").alias("max_cyclomatic"),
    )
    v = {c: F.col(c) for c in ("n", "penalty", "extreme", "cc", "cog", "deep", "plain", "hard")}
    score = C.clamped(C.half_even(100 - 20.0 * v["penalty"] / v["n"] - F.least(5 * v["extreme"], F.lit(30))))
    kind = (
        F.when((v["plain"] > 0.9 * v["n"]) & (v["extreme"] == 0), "clean")
        .when((v["extreme"] > 0) & (v["extreme"] <= F.greatest(F.lit(3.0), 0.05 * v["n"])), "god_functions")
        .when((v["deep"] > v["cc"]) & (v["deep"] > v["cog"]), "deep_nesting")
        .when(v["cog"] > 1.5 * v["cc"], "cognitive_heavy")
        .when(v["cc"] > 1.5 * v["cog"], "cyclomatic_heavy")
        .when(v["hard"] > 0.3 * v["n"], "uniformly_complex")
        .when((v["cc"] > 0) & (v["cog"] > 0), "mixed")
        .otherwise("clean")
    )
    scored = agg.select("project", v["n"].alias("functions"), "violations", "avg_cyclomatic", "avg_cognitive", "max_cyclomatic", score.cast("int").alias("score"), kind.alias("profile"))
    return projects(files).join(scored, "project", "left").na.fill({"functions": 0, "violations": 0, "avg_cyclomatic": 0.0, "avg_cognitive": 0.0, "max_cyclomatic": 0, "score": 100, "profile": "clean"}).withColumn("grade", C.grade(F.col("score"), "complexity"))


# dead code across modules


def dead_code(files: DataFrame, extracted: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """All dead-code findings; ``edges`` (of :mod:`.graph`) drops functions that another module imports."""
    own = extracted.select("project", "path", F.explode("dead").alias("f")).select("project", "path", "f.*")
    functions = extracted.select("project", "path", F.explode("definitions").alias("f")).select("project", "path", "f.*")
    if edges is not None:
        taken = edges.where("target is not null and target <> module").select("project", F.col("target_path").alias("path"), F.explode("names").alias("taken")).distinct()
        whole = taken.where("taken = '*'").select("project", "path").distinct()
        functions = functions.join(whole, ["project", "path"], "left_anti")
        hit = (functions.project == taken.project) & (functions.path == taken.path)
        functions = functions.join(taken, hit & (functions.name == taken.taken), "left_anti").join(taken, hit & (functions.owner == taken.taken), "left_anti")
    named = functions.select("project", "path", F.lit("unused-function").alias("category"), F.concat_ws(".", "owner", "name").alias("name"), "line", F.lit(None).cast("int").alias("end_line"))
    return own.unionByName(named).withColumn("severity", C.lookup(F.col("category"), DEAD_SEVERITY))


# docstrings, names, tests and types


def docstring_issues(entities: DataFrame) -> DataFrame:
    public = entities.where(~F.col("name").startswith("_") | C.is_dunder(F.col("name")))
    text = F.lower("docstring")
    described = text.rlike(r":param |param |args:|arguments:|parameters:|:type |keyword arguments")
    issue = F.array_compact(F.array(
        F.when(~F.col("documented"), F.struct(F.lit("missing").alias("issue"), F.when(F.col("kind") == "class", "high").otherwise("medium").alias("severity"))),
        F.when(F.col("documented") & (F.length(F.regexp_replace("docstring", r"^\s+|\s+$", "")) < 10), F.struct(F.lit("too_short").alias("issue"), F.lit("low").alias("severity"))),
        F.when(F.col("documented") & (F.col("params") > 0) & ~described, F.struct(F.lit("no_params").alias("issue"), F.lit("low").alias("severity"))),
    ))
    return public.select("project", "path", "name", "kind", "line", F.explode(issue).alias("i")).select("project", "path", "name", "kind", "line", "i.*")


def docstring_score(entities: DataFrame) -> DataFrame:
    public = entities.where(~F.col("name").startswith("_") | C.is_dunder(F.col("name")))
    totals = public.groupBy("project").agg(F.count(F.lit(1)).alias("public"), F.sum(F.col("documented").cast("int")).alias("documented"))
    other = docstring_issues(entities).where("issue <> 'missing'").groupBy("project").agg(F.count(F.lit(1)).alias("other"))
    score = C.clamped((100 * F.col("documented") / F.col("public")).cast("int") - F.least(F.lit(10), F.coalesce("other", F.lit(0))))
    return totals.join(other, "project", "left").select("project", "public", "documented", score.cast("int").alias("score")).withColumn("grade", C.grade(F.col("score"), "docstrings"))


def naming_violations(identifiers: DataFrame) -> DataFrame:
    name, kind = F.col("name"), F.col("kind")
    right = F.when(kind == "class", C.is_camel(name)).when(kind == "constant", C.is_upper(name)).otherwise(C.is_snake(name))
    better = F.when(kind == "class", C.to_camel(name)).when(kind == "constant", F.upper(name)).otherwise(C.to_snake(name))
    return identifiers.where(F.col("checked") & ~right).select("project", "path", "line", "kind", "name", better.alias("suggestion"))


def naming_score(identifiers: DataFrame) -> DataFrame:
    bad = naming_violations(identifiers).groupBy("project").agg(F.count(F.lit(1)).alias("violations"))
    totals = identifiers.groupBy("project").agg(F.count(F.lit(1)).alias("names")).join(bad, "project", "left").na.fill(0, ["violations"])
    score = C.clamped((100 - 200.0 * F.col("violations") / F.col("names")).cast("int"))
    return totals.select("project", "names", "violations", score.cast("int").alias("score")).withColumn("grade", C.grade(F.col("score"), "naming"))


def test_issues(tests: DataFrame, max_length: int = 50, max_assertions: int = 15) -> DataFrame:
    """Issues of test functions; names that repeat in a file count from the second on."""
    def one(check: str, severity: str, when: Column, line: Column = F.col("line")) -> Column:
        return F.when(when, F.array(F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), line.alias("at")))).otherwise(F.array())

    def each(check: str, severity: str, at: str) -> Column:
        return F.transform(at, lambda x: F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), x.alias("at")))

    again = F.row_number().over(Window.partitionBy("project", "path", "qualified").orderBy("position")) > 1
    rows = tests.withColumn("again", again)
    found = F.concat(
        one("empty_test", "high", F.col("is_empty")), one("no_assertions", "high", ~F.col("is_empty") & (F.col("assertions") == 0)),
        one("too_long", "medium", F.col("length") > max_length), one("too_many_asserts", "medium", F.col("assertions") > max_assertions),
        one("bare_assert", "high", F.col("bare_line").isNotNull(), F.col("bare_line")), each("broad_except", "medium", "broad"), each("sleep_in_test", "low", "sleeps"),
        one("no_description", "low", F.col("name").rlike(r"^test_?\d*$|^test_(it|this|func|method|case|example)\d*$")), one("duplicate_name", "medium", F.col("again")),
    )
    return rows.select("project", "path", "qualified", F.explode(found).alias("i")).select("project", "path", "qualified", "i.check", "i.severity", F.col("i.at").alias("line"))


def test_score(tests: DataFrame) -> DataFrame:
    totals = tests.groupBy("project").agg(F.count(F.lit(1)).alias("tests"), F.sum("assertions").alias("assertions"))
    joined = totals.join(weighted(test_issues(tests), "tests"), "project", "left").na.fill(0, ["findings", "weight"])
    score = C.clamped(100 - (100 * F.col("weight") / (3 * F.col("tests"))).cast("int"))
    return joined.select("project", "tests", "assertions", F.col("findings").alias("issues"), score.cast("int").alias("score")).withColumn("grade", C.grade(F.col("score"), "tests"))


def type_score(signatures: DataFrame, any_usages: DataFrame, type_ignores: DataFrame) -> DataFrame:
    full = F.col("has_return") & (F.col("annotated") == F.col("params"))
    totals = signatures.groupBy("project").agg(F.count(F.lit(1)).alias("functions"), F.sum(full.cast("int")).alias("typed"), F.sum("params").alias("params"), F.sum("annotated").alias("annotated"), F.sum(F.col("has_return").cast("int")).alias("returns"))
    for table, name in ((any_usages, "anys"), (type_ignores, "ignores")):
        totals = totals.join(table.groupBy("project").agg(F.count(F.lit(1)).alias(name)), "project", "left").na.fill(0, [name])
    c = F.col
    raw = 40 * share(c("typed"), c("functions")) + 25 * share(c("annotated"), c("params")) + 25 * share(c("returns"), c("functions")) + 10 - F.least(c("anys"), F.lit(5)) - F.least(0.5 * c("ignores"), F.lit(5.0))
    return totals.withColumn("score", C.clamped(raw.cast("int")).cast("int")).withColumn("grade", C.grade(c("score"), "types"))


# debt markers


def debt_markers(files: DataFrame) -> DataFrame:
    """The first marker of each line: tag, author and message."""
    part = lambda i: F.regexp_extract("text", C.DEBT, i)
    rows = lines(files).select("project", "path", "line", F.upper(part(1)).alias("tag"), part(2).alias("author"), F.trim(part(3)).alias("message")).where("tag <> ''")
    return rows.withColumn("severity", C.lookup(F.col("tag"), C.DEBT_TAGS))


def debt_score(files: DataFrame) -> DataFrame:
    tags = lines(files).select("project", F.upper(F.regexp_extract("text", C.DEBT, 1)).alias("tag"))
    weight = C.lookup(C.lookup(F.col("tag"), C.DEBT_TAGS), C.WEIGHTS["debt"], 0)
    totals = tags.groupBy("project").agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("tag") != "", 1)).alias("findings"), F.sum(weight.cast("double")).alias("weight"))
    score = C.clamped((100 - 5000.0 * F.col("weight") / F.col("lines")).cast("int"))
    return totals.select("project", "lines", F.col("findings").alias("markers"), score.cast("int").alias("score")).withColumn("grade", C.grade(F.col("score"), "debt"))


def blame_age(markers: DataFrame, blame: DataFrame, today: Column) -> DataFrame:
    """Markers with the author and age in days of their line; -1 where blame doesn't know it."""
    return markers.join(blame.select("path", "line", "blame_author", "blame_date"), ["path", "line"], "left").withColumn("age_days", F.coalesce(F.datediff(today, "blame_date"), F.lit(-1)))


def health(scores: DataFrame) -> DataFrame:
    """The worst grade and the mean score of each project over all engines (``project, engine, score, grade``)."""
    return scores.groupBy("project").agg(F.count(F.lit(1)).alias("engines"), F.max("grade").alias("overall_grade"), F.min("score").alias("lowest"), F.avg("score").alias("mean_score"))


def import_score(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Import health of the Python modules of ``files``."""
    python = F.col("path").endswith(".py")
    edges = save(graph.edges_of(graph.resolve(files.where(python), imports.where(python))), "imports")
    nodes = graph.modules(files.where(python)).select("project", F.col("module").alias("node")).distinct()
    cycles = graph.cycle_members(edges).groupBy("project").agg(F.countDistinct("component").alias("cycles"))
    return graph.import_health(graph.coupling(nodes, edges), cycles)


def all_scores(files: DataFrame, extracted: DataFrame) -> DataFrame:
    """``project, engine, score, grade`` of the ten engines of the overall grade; one parse for all.

    Env files among the ``files`` are read for the environment only. A project
    that has nothing for an engine to look at scores 100. What needs no text
    reads the paths of the saved facts, as ``files`` may be dear to make again.
    """
    from .extract import rows_of

    env, saved = tabular.is_env_file(F.col("path")), save(extracted, "facts")
    paths, kept = saved.select("project", "path"), saved.where(~env)
    code = kept.select("project", "path")
    table = lambda f: rows_of(kept, f)
    bugs, security = table("bugs"), table("security")
    parts = {
        "complexity": complexity_score(code, table("functions")), "bugs": density_score(code, bugs, "bugs"), "security": density_score(code, security, "security"),
        "naming": naming_score(table("identifiers")), "docstrings": docstring_score(table("entities")), "types": type_score(table("signatures"), table("any_usages"), table("type_ignores")),
        "debt": debt_score(files.where(~env)), "tests": test_score(table("tests")), "imports": import_score(code, table("imports")), "environment": tabular.environment_of(files, paths),
    }
    every, out = save(paths.select("project").distinct(), "projects"), None
    for engine, part in parts.items():
        scored = every.join(part.select("project", "score", "grade"), "project", "left").na.fill({"score": 100, "grade": "A"})
        one = scored.select("project", F.lit(engine).alias("engine"), "score", "grade")
        out = one if out is None else out.unionAll(one)
    return out


HEALTH_FACETS = ("functions", "bugs", "security", "identifiers", "entities", "signatures", "any_usages", "type_ignores", "tests", "imports")

__all__ = [n for n in dir() if not n.startswith("_")] + ["facts"]
