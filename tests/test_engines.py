"""The code engines on small fixtures of our own, and odd input."""

import ast
import random
import textwrap
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codestrata.functions import columns as C
from codestrata.functions import facets
from codestrata.operators import extract, graph, quality, tabular
from codestrata.plans import catalogue


def found(facet, source, path="pkg/mod.py"):
    source = textwrap.dedent(source)
    return facets.FACETS[facet](ast.parse(source), source, path)


def rules(facet, source):
    return [x[0] for x in found(facet, source)]


def files(spark, *rows):
    return spark.createDataFrame([("p", path, textwrap.dedent(text) if text else text) for path, text in rows], extract.FILES)


def test_complexity_metrics():
    source = """
    def outer(a, *rest, b=1, **more):
        for x in rest:
            if x and a or b:
                while x:
                    break
        return [y for y in rest if y]
        def inner(): pass
    """
    name, qualified, line, end, cyclomatic, cognitive, nesting, params, method = found("functions", source)[0]
    # loops and branch 3, two boolean operators, comprehension with a filter 2
    assert (name, cyclomatic, nesting, params, method) == ("outer", 8, 3, 4, False)
    assert cognitive == 1 + 2 + 3 + 2 + 1 + 1 and end - line + 1 == 7


@pytest.mark.parametrize(
    "source, rule",
    [
        ("x = 'dear {name}, hi'", "missing-fstring"),
        ("class A:\n    items = []", "mutable-class-var"),
        ("for i in x:\n    f = lambda: i", "late-binding-closure"),
        ("def f(t=time.time()): pass", "call-default"),
        ("def f(t={}): pass", "mutable-default-arg"),
        ("assert (a, 'b')", "assert-tuple"),
        ("def f():\n    return 1\n    x()", "unreachable-code"),
        ("try: pass\nexcept OSError: pass\nexcept TimeoutError: pass", "unreachable-except"),
    ],
)
def test_bug_rules(source, rule):
    assert rules("bugs", source) == [rule]


@pytest.mark.parametrize(
    "source",
    ["x = '{name}'", "TEMPLATE = 'a {name} b'", "'a {b} c'.format(b=1)", "x = 'a {b} c' % y", "log_message('a {b} c')", "for i in x:\n    sorted(y, key=lambda v: v + i)", "for i in x:\n    f = lambda i=i: i", "class A:\n    ITEMS = []", "try: pass\nexcept KeyError: pass\nexcept LookupError: pass"],
)
def test_bug_rules_leave_good_code_alone(source):
    assert rules("bugs", source) == []


@pytest.mark.parametrize(
    "source, rule",
    [
        ("eval(x)", "eval-exec"),
        ("import subprocess as s\ns.run(x, shell=True)", "command-injection"),
        ("from pickle import loads\nloads(x)", "insecure-deserialization"),
        ("import yaml\nyaml.load(x)", "insecure-yaml"),
        ("db.execute(f'SELECT {x}')", "sql-injection"),
        ("import hashlib\nhashlib.md5(x)", "weak-crypto"),
        ("import requests\nrequests.get(u)", "ssrf"),
        ("api_key = 'abcdef'", "hardcoded-secret"),
        ("import random\ntoken = random.random()", "insecure-random"),
        ("DEBUG = True", "debug-enabled"),
        ("host = '192.168.1.7'", "hardcoded-ip"),
        ("import tempfile\ntempfile.mktemp()", "insecure-temp"),
    ],
)
def test_security_rules(source, rule):
    assert rules("security", source) == [rule]


def test_constant_addresses_are_no_request_forgery():
    assert rules("security", "import requests\nBASE = 'https://a.b'\nu = f'{BASE}/x'\nrequests.get(u)\nrequests.get(f'{BASE}/y')") == []


def test_dead_code_within_a_file():
    source = """
    import os, sys
    def f(a, b):
        x = 1
        y, z = a
        return z
        print()
    """
    assert [(x[0], x[1]) for x in found("dead", source)] == [("unused-import", "os"), ("unused-import", "sys"), ("unused-variable", "x"), ("unused-variable", "y"), ("unused-argument", "b"), ("unreachable-code", "after_return")]


def test_renamed_copies_have_one_shape():
    source = "def f(a):\n    b = a + 1\n    return b\ndef g(x):\n    y = x + 2\n    return y\ndef h(x):\n    return x * x\n"
    shapes = [x[6] for x in found("blocks", source)]
    assert shapes[0] == shapes[1] != shapes[2]


def test_broken_null_and_empty_files_do_not_stop_a_scan(spark):
    rows = files(spark, ("a.py", "def f(:"), ("b.py", None), ("c.py", ""), ("d.py", "x = 1\x00"), ("e.py", "def f(): pass"))
    got = {r.path: r for r in extract.extract(rows.withColumn("error", F.lit("clash")), *facets.FACETS).collect()}
    assert [p for p in sorted(got) if got[p].error] == ["a.py", "d.py"]
    assert len(got["e.py"].functions) == 1 and got["b.py"].functions == []
    none = rows.limit(0)
    assert quality.complexity_score(none, extract.facts(none, "functions")).count() == 0
    score = quality.complexity_score(rows, extract.facts(rows, "functions").limit(0)).first()
    assert (score.score, score.grade, score.profile) == (100, "A", "clean")


def test_tests_names_docstrings_and_debt(spark):
    rows = files(spark, ("test_a.py", '''
        def test_one():
            pass
        def test_two():
            assert True
        def test_two():
            sleep(1)
        class badName:
            def getValue(self, aB): "x"
        # FIXME(kim): soon
    '''))  # fmt: skip
    issues = [(r.qualified, r.check) for r in quality.test_issues(extract.facts(rows, "tests")).collect()]
    assert {("test_one", "empty_test"), ("test_two", "bare_assert"), ("test_two", "no_assertions"), ("test_two", "sleep_in_test"), ("test_two", "duplicate_name")} <= set(issues)
    names = {(r.name, r.suggestion) for r in quality.naming_violations(extract.facts(rows, "identifiers")).collect()}
    assert names == {("badName", "Badname"), ("getValue", "get_value"), ("aB", "a_b")}
    assert {r.issue for r in quality.docstring_issues(extract.facts(rows, "entities")).collect()} == {"missing", "too_short", "no_params"}
    marker = quality.debt_markers(rows).first()
    assert (marker.tag, marker.author, marker.message, marker.severity) == ("FIXME", "kim", "soon", "high")


def test_imports_resolve_and_spare_functions_that_others_take(spark):
    rows = files(spark, ("pkg/__init__.py", ""), ("pkg/a.py", "from . import b\nfrom .b import used\nimport json"), ("pkg/b.py", "def used(): pass\ndef alone(): pass"), ("pkg/c.py", "import pkg.a.deep"))
    resolved = graph.resolve(rows, extract.facts(rows, "imports"))
    assert {(r.src, r.dst) for r in graph.edges_of(resolved).collect()} == {("pkg.a", "pkg.b"), ("pkg.c", "pkg.a")}
    assert [(r.package, r.modules) for r in graph.external_packages(resolved).collect()] == [("json", 1)]
    dead = quality.dead_code(rows, extract.extract(rows, "dead", "definitions"), resolved)
    assert [r.name for r in dead.where("category = 'unused-function'").collect()] == ["alone"]


def test_cycles_and_impact(spark):
    edges = spark.createDataFrame([("p", a, b) for a, b in ["ab", "bc", "ca", "dc", "xy", "yx", "zz"]], "project string, src string, dst string")
    assert {(r.node, r.component, r.size) for r in graph.cycle_members(edges).collect()} == {("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("x", "x", 2), ("y", "x", 2)}
    changed = spark.createDataFrame([("p", "c")], "project string, node string")
    assert {(r.node, r.depth, r.parent) for r in graph.impact(edges, changed).collect()} == {("b", 1, "c"), ("d", 1, "c"), ("a", 2, "b")}
    assert {(r.node, r.root) for r in graph.components(edges).collect()} == {*((n, "a") for n in "abcd"), ("x", "x"), ("y", "x"), ("z", "z")}
    assert graph.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("at_once", [8, 10_000])
def test_cycles_are_those_of_brute_force_however_few_edges_fit_a_search(spark, at_once):
    r, edges = random.Random(at_once), set()
    for project, n, most in (("p", 90, 130), ("q", 60, 75), ("chain", 0, 0)):
        edges |= {(project, f"n{r.randrange(n):02}", f"n{r.randrange(n):02}") for _ in range(most)}
    # a hub that no search holds whole, a ring, and a way with a ring at its end
    edges |= {("hub", *e) for i in range(30) for e in (("h", f"m{i:02}"), (f"m{i:02}", "h"))}
    edges |= {("ring", f"k{i * 7 % 50:02}", f"k{(i + 1) * 7 % 50:02}") for i in range(50)}
    edges |= {("chain", f"c{i * 11 % 40:02}", f"c{(i + 1) * 11 % 40:02}") for i in range(39)} | {("chain", "z1", "z2"), ("chain", "z2", "z1")}
    reach = defaultdict(set)
    for p, a, b in edges:
        reach[p, a].add(b)
    for p, k in list(reach):
        todo = list(reach[p, k])
        while todo:
            new = reach.get((p, todo.pop()), set()) - reach[p, k]
            reach[p, k] |= new
            todo += new
    groups = {(p, a): {a} | {b for b in reach[p, a] if a in reach.get((p, b), ())} for p, a in reach}
    want = {(p, a, min(g), len(g)) for (p, a), g in groups.items() if len(g) > 1}
    given = spark.createDataFrame([*edges, (None, "a", "b"), (None, "b", "a"), ("p", None, "n01")], "project string, src string, dst string")
    got = graph.cycle_members(given, at_once)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert graph.cycle_members(given.limit(0), at_once).count() == 0


def test_no_task_searches_a_project_whole():
    import pandas as pd

    ring = pd.DataFrame({"project": "p", "src": range(1000), "dst": [*range(1, 1000), 0]})
    got = pd.concat(graph.contracting(100)(iter([ring])))
    assert len(got) == 1000 and not got["merged"].any()
    whole = pd.concat(graph.contracting(1000)(iter([ring])))
    assert len(whole) == 1000 and whole["merged"].all() and set(whole["b"]) == {0}


def test_coupling_is_that_of_brute_force(spark):
    r = random.Random(3)
    pairs = {(f"m{r.randrange(60)}", f"m{r.randrange(60)}") for _ in range(400)}
    edges = spark.createDataFrame([("p", a, b) for a, b in pairs if a != b], "project string, src string, dst string")
    got = {x.node: (x.ca, x.ce, x.hub, x.instability) for x in catalogue.coupling_of(edges).collect()}
    for node in {n for a, b in pairs if a != b for n in (a, b)}:
        ca, ce = len({a for a, b in pairs if b == node != a}), len({b for a, b in pairs if a == node != b})
        assert got.pop(node) == (ca, ce, ca * ce, ce / (ca + ce))
    assert got == {}


def test_supply_coupling_keeps_every_supplier_and_part_apart(spark, tmp_path):
    r = random.Random(5)
    pairs = [(r.randrange(1, 300), r.randrange(1, 900)) for _ in range(3000)]
    spark.createDataFrame([*pairs, *pairs[:50], (None, 7), (7, None)], "l_suppkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    parts, suppliers = defaultdict(set), defaultdict(set)
    for s, p in pairs:
        parts[f"s{s}"].add(p)
        suppliers[f"p{p}"].add(s)
    want = {n: (0, len(x), 1.0) for n, x in parts.items()} | {n: (len(x), 0, 0.0) for n, x in suppliers.items()}
    assert {x.node: (x.ca, x.ce, x.instability) for x in catalogue.QUERIES["supply_coupling"](spark, str(tmp_path)).collect()} == want
    row = catalogue.QUERIES["supply_coupling_summary"](spark, str(tmp_path)).first()
    assert (row.modules, row.edges, row.stable, row.unstable) == (len(want), len(set(pairs)), len(suppliers), len(parts))


def test_health_covers_imports_and_environment_and_all_ten_engines(spark):
    source = "'''Reads a setting.'''\nimport os\nfrom {0} import x\nX = os.getenv('API_URL')\n# os.getenv('NOT_THIS')\nH = os.environ['HOME']\n"
    rows = [("p", "a.py", source.format("b")), ("p", "b.py", source.format("a")), ("q", "m.py", "import os\nX = os.environ['DB']\n"), ("q", ".env", "export DB='x'\nOLD=1\n# NO=1\nEMPTY\n"), ("r", "n.py", "")]
    given = spark.createDataFrame(rows, extract.FILES)
    scores = quality.all_scores(given, extract.extract(given, *quality.HEALTH_FACETS))
    got = {(x.project, x.engine): (x.score, x.grade) for x in scores.collect()}
    # a cycle 15, instability of one half 7.5, a hub for the only other module 15; and 5 of 10 for having no env files
    assert got["p", "imports"] == (62, "D") and got["p", "environment"] == (50, "F")
    # one orphan; two unused variables and an empty one: 5 of 30
    assert got["q", "imports"] == (80, "B") and got["q", "environment"] == (83, "B")
    assert got["r", "environment"] == got["r", "tests"] == got["r", "types"] == (100, "A")
    health = {x.project: x for x in quality.health(scores).collect()}
    assert {x.engines for x in health.values()} == {10} and health["p"].overall_grade == "F" and health["p"].lowest == 50


def test_health_makes_each_text_four_times_at_most_and_walks_it_once(spark):
    made = spark.sparkContext.accumulator(0)

    def text(path):
        made.add(1)
        return "import os\nX = os.environ['A']  # TODO: x\n"

    rows = spark.createDataFrame([("p", f"m{i}.py") for i in range(20)], "project string, path string")
    given = rows.withColumn("content", F.udf(text, "string").asNondeterministic()("path"))
    assert quality.health(quality.all_scores(given, extract.extract(given, *quality.HEALTH_FACETS))).first().engines == 10
    # facts, debt, variables and references
    assert 0 < made.value <= 4 * 20
    tree, missed = ast.parse("class A:\n    def f(self): return 1"), facets.walked.cache_info().misses
    for facet in quality.HEALTH_FACETS:
        facets.FACETS[facet](tree, "", "a.py")
    assert facets.walked.cache_info().misses == missed + 1


def test_long_sums_do_not_stop_the_security_rules():
    assert rules("security", "eval(x)\ny = " + " + ".join(["1"] * 2000)) == ["eval-exec"]


def test_projects_without_env_files_have_that_finding_alone(spark):
    defs = spark.createDataFrame([("q", "A", "v", ".env.example", 1, "template"), ("q", "B", "v", ".env", 1, "actual")], "project string, name string, value string, file string, line int, kind string")
    refs = spark.createDataFrame([("p", "A"), ("p", "B"), ("q", "B"), ("q", "C")], "project string, name string")
    got = {(x.project, x.check, x.name) for x in tabular.environment_findings(defs, refs).collect()}
    assert got == {("p", "no_env_files", "*"), ("q", "undefined", "C"), ("q", "unused", "A"), ("q", "missing_template", "B"), ("q", "missing_actual", "A")}


def test_name_styles_are_those_of_whole_names(spark, tmp_path):
    spark.createDataFrame([(1, "a b#1"), (2, "Customer#01"), (3, "get_value")], "c_custkey bigint, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(4, "HTTPClient")], "p_partkey bigint, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {x.key: (x.snake, x.camel, x.to_snake, x.to_camel) for x in catalogue.QUERIES["name_styles"](spark, str(tmp_path)).collect()}
    assert got == {1: (False, False, "a b#1", "A b#1"), 2: (False, False, "customer#01", "Customer#01"), 3: (True, False, "get_value", "GetValue"), 4: (False, True, "http_client", "Httpclient")}


def test_near_clones_are_those_of_all_pairs(spark):
    texts = ["abcdefghijkl", "abcdefghijkm", "zzzzzzzz", "abcdefgh", "", "abc"]
    blocks = spark.createDataFrame([("p", f"{i}.py", "f", 1, 10, t) for i, t in enumerate(texts)], "project string, path string, name string, start_line int, nodes int, normalized string")
    pairs = tabular.near_clones(blocks).collect()
    grams = [{t[i : i + 4] for i in range(max(1, len(t) - 3))} if t else set() for t in texts]
    likeness = [len(x & y) / len(x | y) for i, x in enumerate(grams) for j, y in enumerate(grams) if i < j and texts[i] and texts[j] and min(len(texts[i]), len(texts[j])) >= 0.64 * max(len(texts[i]), len(texts[j]))]
    assert sorted(r.similarity for r in pairs) == pytest.approx(sorted(x for x in likeness if x >= 0.48))


@pytest.mark.parametrize("name, snake, camel", [("HTTPClient", "http_client", "Httpclient"), ("getValue", "get_value", "Getvalue"), ("_a_b", "_a_b", "_AB"), ("__", "__", "__")])
def test_case_conversion(spark, name, snake, camel):
    row = spark.createDataFrame([(name,)], "n string").select(C.to_snake(F.col("n")), C.to_camel(F.col("n"))).first()
    assert tuple(row) == (snake, camel)


def test_src_counts_only_where_it_is_a_package(spark):
    paths = [("a", "src/lib/core.py"), ("b", "src/lib/core.py"), ("b", "src/__init__.py"), ("a", "src/lib/__init__.py"), ("a", "setup.py")]
    files = spark.createDataFrame([(*p, "") for p in paths], "project string, path string, content string")
    got = {(r.project, r.module) for r in graph.modules(files).collect()}
    assert got == {("a", "lib.core"), ("a", "lib"), ("a", "setup"), ("b", "src.lib.core"), ("b", "src")}
    imports = spark.createDataFrame([("a", "src/lib/__init__.py", 1, "core", True, 1, ["x"]), ("a", "setup.py", 1, "lib.core", False, 0, [])], "project string, path string, line int, module string, is_relative boolean, level int, names array<string>")
    assert {(r.module, r.target) for r in graph.resolve(files, imports).collect()} == {("lib", "lib.core"), ("setup", "lib.core")}


def test_coupling_summary_leaves_test_modules_out(spark):
    paths = [("lib/a.py",), ("lib/tests/b.py",), ("test_c.py",), ("lib/contest.py",), ("d_test.py",)]
    flags = spark.createDataFrame(paths, "path string").select("path", C.is_test_path(F.col("path")).alias("is_test")).collect()
    assert {r.path for r in flags if r.is_test} == {"lib/tests/b.py", "test_c.py", "d_test.py"}
    nodes = spark.createDataFrame([("p", "a", False), ("p", "b", False), ("p", "t", True)], "project string, node string, is_test boolean")
    edges = spark.createDataFrame([("p", "a", "b"), ("p", "t", "a")], "project string, src string, dst string")
    row = graph.coupling_summary(graph.coupling(nodes, edges)).first()
    assert (row.modules, row.avg_instability, row.median_instability, row.stable, row.unstable) == (3, 0.25, 0.25, 1, 0)


def test_secret_names_and_placeholders(spark):
    names = ["DB_PWD", "AUTH_USER", "MY_CRED", "DATABASE_URL", "CONNECTION_STRING", "AWS_ACCESS_KEY", "PORT", "HOSTNAME"]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(F.col("n").rlike(C.SECRET_NAME)).collect()] == [True] * 6 + [False] * 2
    values = ["change_me", "REPLACE_THIS", "...", "<key>", "your-key", "s3cr3t", "a..."]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(F.col("v").rlike(C.PLACEHOLDER_VALUE)).collect()] == [True] * 5 + [False] * 2
