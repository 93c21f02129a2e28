"""Facts of one Python source text, facet by facet.

A facet is a function ``(tree, source, path) -> list of tuples``; its columns are
in :data:`SCHEMAS`. ``codestrata.operators.extract`` parses every file once and
runs the facets a query asks for. All facets are total: any tree gives a list.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
SCOPE = (*FUNCTION, ast.ClassDef)
LOOP = (ast.For, ast.AsyncFor, ast.While)
WITH = (ast.With, ast.AsyncWith)
STOP = (ast.Return, ast.Raise, ast.Break, ast.Continue)
#: Types that the parser gives are never subclasses, so membership stands for ``isinstance`` in the loops over all nodes.
PATHS = frozenset([ast.If, ast.IfExp, *LOOP, ast.ExceptHandler, *WITH, ast.Assert])
STEPS = frozenset([ast.If, *LOOP, ast.ExceptHandler, *WITH])
JUMPS = frozenset([ast.Break, ast.Continue, ast.BoolOp, ast.IfExp])
SCOPES = frozenset(SCOPE)
LEVELS = frozenset([ast.If, *LOOP, *WITH, ast.Try, ast.ExceptHandler])

SCHEMAS = {
    "functions": "name string, qualified string, line int, end_line int, cyclomatic int, cognitive int, nesting int, params int, is_method boolean",
    "module": "total_lines int, code_lines int, imports int, classes int, hotspot_max int, hotspot_total int, hotspot_functions int",
    "imports": "module string, names array<string>, is_relative boolean, level int, line int",
    "signatures": "name string, line int, is_method boolean, has_return boolean, params int, annotated int, unannotated array<string>",
    "any_usages": "line int, context string",
    "type_ignores": "line int, codes string, context string",
    "entities": "name string, kind string, line int, documented boolean, docstring string, params int",
    "tests": "qualified string, name string, line int, position int, length int, assertions int, is_empty boolean, bare_line int, broad array<int>, sleeps array<int>",
    "identifiers": "kind string, name string, line int, checked boolean",
    "blocks": "name string, kind string, start_line int, end_line int, nodes int, source string, normalized string",
    "bugs": "rule string, severity string, line int, context string",
    "security": "rule string, severity string, line int, col int, snippet string",
    "dead": "category string, name string, line int, end_line int",
    "definitions": "name string, owner string, line int",
}


def string_of(node: ast.AST | None) -> str | None:
    """The value of a string literal, else None."""
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


#: Fields of names and operators, which are leaves that no facet asks for.
LEAVES = frozenset("ctx op ops id attr kind type_comment lineno".split())


@lru_cache(maxsize=None)
def fields_of(kind: type) -> tuple[str, ...]:
    return tuple(f for f in kind._fields if f not in LEAVES)


def children(node: ast.AST) -> list[ast.AST]:
    """What ``ast.iter_child_nodes`` gives but for operators and contexts, kept at the node."""
    try:
        return node.children
    except AttributeError:
        found = []
        for field in fields_of(type(node)):
            value = getattr(node, field, None)
            if isinstance(value, list):
                found += [x for x in value if isinstance(x, ast.AST)]
            elif isinstance(value, ast.AST):
                found.append(value)
        node.children = found
        return found


@lru_cache(maxsize=1)
def walked(tree: ast.AST) -> list[ast.AST]:
    """The nodes of a tree in the order of ``ast.walk``; all facets of a file share one walk."""
    found = [tree]
    for node in found:
        found += children(node)
    return found


def own_nodes(root: ast.AST) -> list[ast.AST]:
    """Everything below ``root`` that isn't inside a nested function or class; these are given, not entered."""
    found = children(root)[:]
    for node in found:
        if not isinstance(node, SCOPE):
            found += children(node)
    return found


def dotted(func: ast.AST) -> str:
    """``a.b.c`` of a call target; a chain that doesn't start at a name keeps its attributes only."""
    parts = []
    while isinstance(func, ast.Attribute):
        parts.append(func.attr)
        func = func.value
    if isinstance(func, ast.Name):
        parts.append(func.id)
    return ".".join(reversed(parts))


def every_argument(args: ast.arguments) -> list[ast.arg]:
    return [*args.posonlyargs, *args.args, *args.kwonlyargs, *(a for a in (args.vararg, args.kwarg) if a)]


# complexity


def cyclomatic(function: ast.AST) -> int:
    total = 1
    for node in own_nodes(function):
        kind = type(node)
        if kind in PATHS:
            total += 1
        elif kind is ast.BoolOp:
            total += len(node.values) - 1
        elif kind is ast.comprehension:
            total += 1 + len(node.ifs)
    return total


def cognitive(function: ast.AST) -> int:
    total, todo = 0, [(function, 0)]
    while todo:
        parent, depth = todo.pop()
        for node in children(parent):
            kind = type(node)
            if kind in SCOPES:
                total += 1
                todo.append((node, depth + 1))
            elif kind in STEPS:
                total += 1 + depth
                todo.append((node, depth + 1))
            else:
                total += kind in JUMPS
                todo.append((node, depth))
    return total


def nesting(function: ast.AST) -> int:
    deepest, todo = 0, [(function, 0)]
    while todo:
        parent, depth = todo.pop()
        for node in children(parent):
            if isinstance(node, FUNCTION):
                todo.append((node, 0))
            elif not isinstance(node, ast.expr):
                below = depth + (type(node) in LEVELS)
                deepest = max(deepest, below)
                todo.append((node, below))
    return deepest


def functions(tree: ast.Module, source: str, path: str) -> list[tuple]:
    """Functions that are reached through modules, classes and functions only."""
    found: list[tuple] = []

    def descend(parent: ast.AST, prefix: str, in_class: bool) -> None:
        for node in children(parent):
            if isinstance(node, FUNCTION):
                name = f"{prefix}{node.name}"
                found.append((node.name, name, node.lineno, node.end_lineno, cyclomatic(node), cognitive(node), nesting(node), len(every_argument(node.args)), in_class))
                descend(node, f"{name}.", False)
            elif isinstance(node, ast.ClassDef):
                descend(node, f"{prefix}{node.name}.", True)

    descend(tree, "", False)
    return found


def hotspot_cyclomatic(function: ast.AST) -> int:
    """The coarser count of the churn analysis: comprehensions are one path, conditional expressions none."""
    total = 1
    for node in own_nodes(function):
        if isinstance(node, (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.With, ast.Assert, ast.comprehension)):
            total += 1
        elif isinstance(node, ast.BoolOp):
            total += len(node.values) - 1
    return total


def module(tree: ast.Module, source: str, path: str) -> list[tuple]:
    lines = source.splitlines()
    code = sum(1 for x in lines if x.strip() and not x.strip().startswith("#"))
    each = [hotspot_cyclomatic(n) for n in ast.walk(tree) if isinstance(n, FUNCTION)]
    top = list(ast.iter_child_nodes(tree))
    n_imports = sum(isinstance(n, (ast.Import, ast.ImportFrom)) for n in top)
    return [(len(lines), code, n_imports, sum(isinstance(n, ast.ClassDef) for n in top), max(each, default=1), sum(each) or 1, len(each))]


# imports and types


def imports(tree: ast.Module, source: str, path: str) -> list[tuple]:
    found: list[tuple] = []
    for node in walked(tree):
        if isinstance(node, ast.Import):
            found += [(a.name, [a.asname or a.name], False, 0, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            found.append((node.module or "", [a.name for a in node.names], bool(node.level), node.level, node.lineno))
    return found


UNTYPED_DUNDERS = frozenset(
    f"__{x}__" for x in ("repr str hash eq ne lt le gt ge bool len contains iter next enter exit del init_subclass class_getitem").split()
)


@lru_cache(maxsize=1)
def typed_functions(tree: ast.Module) -> list[tuple[ast.AST, str | None]]:
    """Every function whose annotations count, with the class around it."""
    found: list[tuple[ast.AST, str | None]] = []
    todo: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while todo:
        parent, owner = todo.pop()
        for node in reversed(children(parent)):
            # no expression holds a function
            if not isinstance(node, ast.expr):
                todo.append((node, node.name if isinstance(node, ast.ClassDef) else owner))
        if isinstance(parent, FUNCTION) and parent.name not in UNTYPED_DUNDERS:
            found.append((parent, owner))
    return found


def signatures(tree: ast.Module, source: str, path: str) -> list[tuple]:
    found = []
    for node, owner in typed_functions(tree):
        takes = every_argument(node.args)
        first = node.args.args[0] if node.args.args else None
        if owner and first is not None and first.arg in ("self", "cls"):
            takes.remove(first)
        missing = [a.arg for a in takes if a.annotation is None]
        name = f"{owner}.{node.name}" if owner else node.name
        found.append((name, node.lineno, owner is not None, node.returns is not None, len(takes), len(takes) - len(missing), missing))
    return found


def any_usages(tree: ast.Module, source: str, path: str) -> list[tuple]:
    lines, found = source.splitlines(), []
    for node, _ in typed_functions(tree):
        for hint in [node.returns, *(a.annotation for a in every_argument(node.args))]:
            for part in ast.walk(hint) if hint is not None else ():
                if isinstance(part, ast.Name) and part.id == "Any" or isinstance(part, ast.Attribute) and part.attr == "Any":
                    found.append((part.lineno, lines[part.lineno - 1].strip() if part.lineno <= len(lines) else ""))
    return found


TYPE_IGNORE = re.compile(r"#\s*type:\s*ignore(?P<codes>\[[\w,\s-]+\])?")


def type_ignores(tree: ast.Module, source: str, path: str) -> list[tuple]:
    hits = ((n, x, TYPE_IGNORE.search(x)) for n, x in enumerate(source.splitlines(), 1))
    return [(n, m["codes"] or "", x.strip()) for n, x, m in hits if m]


# docstrings, tests and names


def docstring(node: ast.AST) -> str | None:
    first = node.body[0] if node.body else None
    return string_of(first.value) if isinstance(first, ast.Expr) else None


def methods_of(tree: ast.Module) -> set[int]:
    return {id(child) for node in walked(tree) if isinstance(node, ast.ClassDef) for child in node.body if isinstance(child, FUNCTION)}


def entities(tree: ast.Module, source: str, path: str) -> list[tuple]:
    stem = path.rsplit("/", 1)[-1].removesuffix(".py")
    text = docstring(tree)
    found, methods = [(stem, "module", 1, text is not None, text, 0)], methods_of(tree)
    for node in walked(tree):
        if isinstance(node, ast.ClassDef):
            text = docstring(node)
            found.append((node.name, "class", node.lineno, text is not None, text, 0))
        elif isinstance(node, FUNCTION):
            text, takes = docstring(node), every_argument(node.args)
            named = [*node.args.args, *node.args.posonlyargs, *node.args.kwonlyargs]
            bound = bool(named) and named[0].arg in ("self", "cls")
            found.append((node.name, "method" if id(node) in methods else "function", node.lineno, text is not None, text, len(takes) - bound))
    return found


def tests(tree: ast.Module, source: str, path: str) -> list[tuple]:
    """Test functions at the top level and in test classes."""
    found: list[tuple] = []

    def is_test(node: ast.AST) -> bool:
        return isinstance(node, FUNCTION) and (node.name == "test" or node.name.startswith("test_"))

    def facts(node: ast.AST, owner: str | None) -> None:
        asserts = [n for n in ast.walk(node) if isinstance(n, ast.Assert)]
        calls = [(n, dotted(n.func).rpartition(".")[2]) for n in ast.walk(node) if isinstance(n, ast.Call)]
        broad = [n.lineno for n in ast.walk(node) if isinstance(n, ast.ExceptHandler) and (n.type is None or isinstance(n.type, ast.Name) and n.type.id == "Exception")]
        real = [s for s in node.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))]
        bare = next((n.lineno for n in asserts if isinstance(n.test, ast.Constant) and n.test.value), None)
        count = len(asserts) + sum("assert" in name.lower() for _, name in calls)
        name = f"{owner}.{node.name}" if owner else node.name
        sleeps = [n.lineno for n, called in calls if called == "sleep"]
        found.append((name, node.name, node.lineno, len(found), node.end_lineno - node.lineno + 1, count, all(isinstance(s, ast.Pass) for s in real), bare, broad, sleeps))

    for node in tree.body:
        if is_test(node):
            facts(node, None)
        elif isinstance(node, ast.ClassDef) and node.name.startswith("Test"):
            for child in node.body:
                if is_test(child):
                    facts(child, node.name)
    return found


FRAMEWORK_NAME = re.compile(r"visit_[A-Z]|(?:generic_visit|setUp|tearDown|setUpClass|tearDownClass|setUpModule|tearDownModule|addCleanup)$")


def identifiers(tree: ast.Module, source: str, path: str) -> list[tuple]:
    """Names with the kind whose convention holds; ``checked`` is false for those that are counted only."""
    found, methods = [], methods_of(tree)
    for node in walked(tree):
        if isinstance(node, ast.ClassDef):
            found.append(("class", node.name, node.lineno, True))
        elif isinstance(node, FUNCTION):
            exempt = node.name.startswith("__") and node.name.endswith("__") or FRAMEWORK_NAME.match(node.name)
            found.append(("method" if id(node) in methods else "function", node.name, node.lineno, not exempt))
            if not exempt:
                star = [a for a, usual in ((node.args.vararg, "args"), (node.args.kwarg, "kwargs")) if a and a.arg != usual]
                named = [a for a in (*node.args.args, *node.args.posonlyargs, *node.args.kwonlyargs) if a.arg not in ("self", "cls")]
                found += [("parameter", a.arg, a.lineno, True) for a in named + star]
    for node in tree.body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        for target in targets:
            if isinstance(target, ast.Name):
                bare = target.id.lstrip("_")
                constant = len(bare) > 1 and bare[0].isupper() and bare.replace("_", "").isupper()
                dunder = target.id.startswith("__") and target.id.endswith("__")
                kind = "constant" if constant else "variable"
                found.append((kind, target.id, node.lineno, len(bare) > 1 and not dunder and not (constant and isinstance(node, ast.AnnAssign))))
    return found


# clones


class Renamer(ast.NodeTransformer):
    """Gives names numbers in order of appearance and blanks literals, so that renamed copies dump alike."""

    def __init__(self) -> None:
        self.numbers: dict[str, str] = {}

    def number(self, name: str) -> str:
        return self.numbers.setdefault(name, f"V{len(self.numbers)}")

    def generic_visit(self, node: ast.AST) -> ast.AST:
        if isinstance(node, ast.arg):
            node.annotation = None
        for field in ("id", "name", "arg", "attr", "asname"):
            value = getattr(node, field, None)
            if isinstance(value, str):
                setattr(node, field, self.number(value))
        if isinstance(node, ast.Constant):
            if isinstance(node.value, str):
                node.value = "S"
            elif isinstance(node.value, (int, float, complex)):
                node.value = 0
        return super().generic_visit(node)


def blocks(tree: ast.Module, source: str, path: str) -> list[tuple]:
    found = []
    for node in list(ast.walk(tree)):
        is_class = isinstance(node, ast.ClassDef)
        if isinstance(node, FUNCTION) or is_class and sum(not isinstance(s, FUNCTION) for s in node.body) >= 2:
            text = ast.unparse(node)
            copy = ast.parse(text)
            found.append((node.name, "class" if is_class else "function", node.lineno, node.end_lineno, sum(1 for _ in ast.walk(node)), text, ast.dump(Renamer().visit(copy))))
    return found


# bugs

PLACEHOLDER = re.compile(r"(?<!\{)\{([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*(?:\[[^\]]*\])?)\}(?!\})", re.ASCII)
LONE_PLACEHOLDER = re.compile(r"\{[A-Za-z_][\w.]*\}$", re.ASCII)
TEMPLATE_TARGETS = frozenset("template pattern regex fmt format_str sql query url_template path_template msg_template tmpl tpl FORMAT PATTERN TEMPLATE SQL QUERY".split())
TEMPLATE_KEYWORDS = frozenset("help metavar description epilog usage prog template format fmt pattern url endpoint".split())
TEMPLATE_CALLS = ("column", "template", "pattern", "prompt", "message")
DECLARED_CLASS_VARS = frozenset(
    "minimal_roi stoploss trailing_stop trailing_stop_positive trailing_stop_positive_offset order_types order_time_in_force protections "
    "pair_blacklist pair_whitelist fields exclude widgets labels help_texts error_messages field_classes __table_args__ pytestmark".split()
)
CONSUMERS = frozenset("max min sorted filter map reduce any all next".split())
FROZEN_CALLS = frozenset(
    "datetime.now datetime.utcnow datetime.today date.today time.time time.monotonic time.perf_counter uuid.uuid4 uuid.uuid1 "
    "random.random random.randint random.choice os.getenv os.environ.get".split()
)
FROZEN_LAST = frozenset("now utcnow today uuid4 uuid1".split())
CONTAINERS = frozenset("list dict set bytearray deque defaultdict OrderedDict Counter".split())


def parents_of(tree: ast.AST) -> dict[int, ast.AST]:
    return {id(child): node for node in walked(tree) for child in children(node)}


def shouts(name: str) -> bool:
    return name.isupper() or name.startswith("_") and name[1:].isupper()


def is_template(node: ast.Constant, parents: dict[int, ast.AST]) -> bool:
    """Whether a string with placeholders is filled in later by its surroundings."""
    text, parent = node.value, parents.get(id(node))
    if any(mark in text for mark in ("{{", "${", "%{")) or LONE_PLACEHOLDER.match(text) or text.count("\n") >= 3:
        return True
    if isinstance(parent, ast.BinOp) and isinstance(parent.op, ast.Mod) or isinstance(parent, ast.keyword) and parent.arg in TEMPLATE_KEYWORDS:
        return True
    if isinstance(parent, ast.Attribute):
        above = parents.get(id(parent))
        return parent.attr in ("format", "replace") or isinstance(above, ast.Call) and above.func is parent
    if isinstance(parent, ast.Assign) and any(isinstance(t, ast.Name) and (t.id in TEMPLATE_TARGETS or shouts(t.id)) for t in parent.targets):
        return True
    for _ in range(4):
        if isinstance(parent, ast.Call) and any(word in dotted(parent.func).lower() for word in TEMPLATE_CALLS):
            return True
        parent = parents.get(id(parent))
    return False


def names_in(target: ast.AST) -> set[str]:
    if isinstance(target, ast.Name):
        return {target.id}
    return set().union(*map(names_in, target.elts)) if isinstance(target, (ast.Tuple, ast.List)) else set()


def late_bound(root: ast.AST, variables: set[str]) -> Iterator[tuple]:
    """Functions and lambdas below ``root`` that read a loop's variables after the loop has moved on."""
    at_once = set()
    for call in ast.walk(root):
        if isinstance(call, ast.Call):
            at_once |= {id(k.value) for k in call.keywords}
            if isinstance(call.func, (ast.Name, ast.Attribute)) and dotted(call.func).rpartition(".")[2] in CONSUMERS:
                at_once |= set(map(id, call.args))
    for node in ast.walk(root):
        if isinstance(node, (ast.Lambda, *FUNCTION)):
            inside = node.body if isinstance(node, ast.Lambda) else node
            free = {n.id for n in ast.walk(inside) if isinstance(n, ast.Name)} & variables - {a.arg for a in every_argument(node.args)}
            if free and id(node) not in at_once:
                yield "late-binding-closure", "warning", node.lineno, ", ".join(sorted(free))


EXCEPTION_TREE = """
BaseException: Exception GeneratorExit KeyboardInterrupt SystemExit
Exception: ArithmeticError LookupError NameError OSError RuntimeError SyntaxError ValueError ImportError AssertionError AttributeError BufferError
Exception: EOFError MemoryError ReferenceError StopIteration StopAsyncIteration SystemError TypeError
ArithmeticError: FloatingPointError OverflowError ZeroDivisionError
LookupError: IndexError KeyError
NameError: UnboundLocalError
OSError: IOError EnvironmentError BlockingIOError ChildProcessError ConnectionError FileExistsError FileNotFoundError InterruptedError
OSError: IsADirectoryError NotADirectoryError PermissionError ProcessLookupError TimeoutError
ConnectionError: BrokenPipeError ConnectionAbortedError ConnectionRefusedError ConnectionResetError
RuntimeError: NotImplementedError RecursionError
SyntaxError: IndentationError
IndentationError: TabError
ValueError: UnicodeError
UnicodeError: UnicodeDecodeError UnicodeEncodeError UnicodeTranslateError
ImportError: ModuleNotFoundError
"""
EXCEPTION_PARENT = {child: top for line in EXCEPTION_TREE.split("\n") if line for top, _, rest in [line.partition(": ")] for child in rest.split()}


def exception_line(name: str) -> list[str]:
    """A builtin exception and its ancestors; empty for other names."""
    line = [name] if name in EXCEPTION_PARENT or name == "BaseException" else []
    while line and line[-1] in EXCEPTION_PARENT:
        line.append(EXCEPTION_PARENT[line[-1]])
    return line


def shadowed_handlers(node: ast.Try) -> Iterator[tuple]:
    caught: set[str] = set()
    for handler in node.handlers:
        kinds = handler.type.elts if isinstance(handler.type, ast.Tuple) else [handler.type] if handler.type is not None else []
        names = [k.id for k in kinds if isinstance(k, ast.Name)]
        if names and all(caught.intersection(exception_line(n)) for n in names):
            yield "unreachable-except", "error", handler.lineno, ", ".join(names)
        caught |= {n for n in names if exception_line(n)}


def bugs(tree: ast.Module, source: str, path: str) -> list[tuple]:
    parents, found = None, []
    documented = {id(n.body[0].value) for n in walked(tree) if (n is tree or type(n) in SCOPES) and docstring(n) is not None}
    for node in walked(tree):
        if isinstance(node, ast.Name):
            continue
        text = string_of(node)
        if text is not None and id(node) not in documented and PLACEHOLDER.search(text):
            parents = parents or parents_of(tree)
            if not is_template(node, parents):
                found.append(("missing-fstring", "warning", node.lineno, text[:60]))
        if isinstance(node, ast.ClassDef):
            for statement in node.body:
                targets = statement.targets if isinstance(statement, ast.Assign) else [statement.target] if isinstance(statement, ast.AnnAssign) else []
                if targets and isinstance(statement.value, (ast.List, ast.Dict, ast.Set)):
                    shared = [t.id for t in targets if isinstance(t, ast.Name) and t.id != "__all__" and not shouts(t.id) and t.id not in DECLARED_CLASS_VARS]
                    found += [("mutable-class-var", "warning", statement.lineno, f"{node.name}.{name}") for name in shared]
        elif isinstance(node, ast.For):
            found += late_bound(node, names_in(node.target))
        elif isinstance(node, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
            variables = set().union(*(names_in(g.target) for g in node.generators))
            for part in (node.key, node.value) if isinstance(node, ast.DictComp) else (node.elt,):
                found += late_bound(part, variables)
        elif isinstance(node, FUNCTION):
            for default in [*node.args.defaults, *(d for d in node.args.kw_defaults if d is not None)]:
                called = dotted(default.func) if isinstance(default, ast.Call) else ""
                if called in FROZEN_CALLS or called.rpartition(".")[2] in FROZEN_LAST:
                    found.append(("call-default", "warning", default.lineno, called))
                if isinstance(default, (ast.List, ast.Dict, ast.Set)) or called in CONTAINERS:
                    found.append(("mutable-default-arg", "warning", default.lineno, node.name))
        elif isinstance(node, ast.Assert):
            if isinstance(node.test, ast.Tuple) and len(node.test.elts) > 1:
                found.append(("assert-tuple", "error", node.lineno, ""))
        elif isinstance(node, ast.Try):
            found += shadowed_handlers(node)
        for field in () if isinstance(node, ast.expr) else ("body", "orelse", "finalbody", "handlers"):
            statements = getattr(node, field, None)
            if isinstance(statements, list):
                for now, after in zip(statements, statements[1:]):
                    if isinstance(now, STOP) and not (isinstance(after, ast.Expr) and string_of(after.value) is not None):
                        found.append(("unreachable-code", "warning", after.lineno, type(now).__name__.lower()))
                        break
    return sorted(found, key=lambda f: (f[2], f[1]))


# security

SECRET_WORDS = (
    "password passwd secret api_key apikey api_secret apisecret access_key accesskey private_key privatekey token auth_token "
    "authtoken secret_key secretkey db_pass db_password encryption_key signing_key jwt_secret webhook_secret"
).split()
SECRET_NAME = re.compile(rf"(?:^|_)(?:{'|'.join(SECRET_WORDS)})(?:$|_)", re.IGNORECASE)
HARMLESS = frozenset(["", *"None none True true False false changeme placeholder CHANGEME xxx your-api-key-here your-secret-here TODO test testing dummy example".split()])
OCTET = r"\.\d{1,3}"
PRIVATE_ADDRESS = re.compile(rf"(?:\b|https?://)(?:10{OCTET * 3}\b|172\.(?:1[6-9]|2\d|3[01]){OCTET * 2}\b|192\.168{OCTET * 2}\b)|https?://(?:10{OCTET * 3}|172\.(?:1[6-9]|2\d|3[01]){OCTET * 2}|192\.168{OCTET * 2})")
SQL_WORD = re.compile(r"\b(?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|EXEC|EXECUTE|UNION)\b", re.IGNORECASE)
#: Called name -> rule and severity, where the call alone is the finding.
RISKY_CALLS = {
    **dict.fromkeys(("eval", "exec"), ("eval-exec", "critical")),
    **dict.fromkeys(("os.system", "os.popen"), ("command-injection", "critical")),
    **dict.fromkeys((f"{m}.{f}" for m in ("pickle", "cPickle") for f in ("load", "loads")), ("insecure-deserialization", "high")),
    **dict.fromkeys(("marshal.load", "marshal.loads", "shelve.open"), ("insecure-deserialization", "medium")),
    "tempfile.mktemp": ("insecure-temp", "medium"),
    **dict.fromkeys(("hashlib.md5", "hashlib.sha1"), ("weak-crypto", "medium")),
}
FETCHES = frozenset([*(f"requests.{m}" for m in ("get", "post", "put", "delete", "patch", "head")), "urllib.request.urlopen"])


class SecurityVisitor:
    """Goes through a file in order, as aliases and constant addresses must be known before their use."""

    def visit(self, tree: ast.AST) -> None:
        visits = {ast.Import: self.visit_Import, ast.ImportFrom: self.visit_ImportFrom, ast.Call: self.visit_Call, ast.Assign: self.visit_Assign, ast.AnnAssign: self.visit_AnnAssign}
        todo = [tree]
        while todo:
            node = todo.pop()
            if type(node) in visits:
                visits[type(node)](node)
            todo += reversed(children(node))

    def __init__(self, lines: list[str]):
        self.lines, self.alias, self.fixed, self.found = lines, {}, set(), []

    def report(self, node: ast.AST, rule: str, severity: str) -> None:
        snippet = self.lines[node.lineno - 1].strip() if node.lineno <= len(self.lines) else ""
        self.found.append((rule, severity, node.lineno, node.col_offset, snippet))

    def visit_Import(self, node: ast.Import) -> None:
        self.alias |= {a.asname or a.name: a.name for a in node.names}

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        self.alias |= {a.asname or a.name: f"{node.module}.{a.name}" if node.module else a.name for a in node.names}

    def called(self, call: ast.Call) -> str:
        name = dotted(call.func)
        root = call.func
        while isinstance(root, ast.Attribute):
            root = root.value
        if isinstance(root, ast.Name):
            head, dot, rest = name.partition(".")
            name = self.alias.get(head, head) + dot + rest
        return name

    def visit_Call(self, node: ast.Call) -> None:
        name, keywords = self.called(node), {k.arg: k.value for k in node.keywords}
        first = node.args[0] if node.args else None
        if name in RISKY_CALLS:
            self.report(node, *RISKY_CALLS[name])
        elif name == "compile" and first is not None and not isinstance(first, ast.Constant):
            self.report(node, "code-injection", "high")
        elif name.startswith("subprocess."):
            shell = keywords.get("shell")
            if isinstance(shell, ast.Constant) and shell.value is True:
                self.report(node, "command-injection", "high")
        elif name == "yaml.load" and "Loader" not in keywords and len(node.args) < 2:
            self.report(node, "insecure-yaml", "high")
        elif name.endswith((".execute", ".executemany")) and first is not None and self.builds_sql(first):
            self.report(node, "sql-injection", "low" if len(node.args) > 1 else "critical")
        elif name in FETCHES and first is not None and not isinstance(first, ast.Constant) and not self.is_fixed(first):
            self.report(node, "ssrf", "medium")

    def builds_sql(self, node: ast.AST) -> bool:
        joined = isinstance(node, ast.JoinedStr) or isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Mod, ast.Add))
        filled = isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "format"
        return (joined or filled) and any(SQL_WORD.search(string_of(n) or "") for n in ast.walk(node))

    def is_fixed(self, node: ast.AST) -> bool:
        """Whether an address starts with a constant host."""
        if isinstance(node, ast.Constant):
            return (string_of(node) or "").startswith(("http://", "https://"))
        if isinstance(node, ast.JoinedStr) and node.values:
            return self.is_fixed(node.values[0])
        if isinstance(node, ast.FormattedValue):
            return isinstance(node.value, ast.Name) and node.value.id in self.fixed
        return isinstance(node, ast.Name) and node.id in self.fixed

    def assigned(self, node: ast.Assign | ast.AnnAssign, target: ast.AST, value: ast.AST) -> None:
        name = target.id if isinstance(target, ast.Name) else target.attr if isinstance(target, ast.Attribute) else ""
        text, secret = string_of(value), bool(SECRET_NAME.search(name))
        if name:
            wraps = isinstance(value, ast.Call) and self.called(value) in ("urllib.request.Request", "Request") and bool(value.args)
            adds = isinstance(value, ast.BinOp) and isinstance(value.op, ast.Add) and isinstance(value.left, ast.Name)
            fixed = self.is_fixed(value.args[0] if wraps else value.left if adds else value) and not isinstance(value, ast.Name)
            (self.fixed.add if fixed else self.fixed.discard)(name)
        if secret and text is not None and len(text) >= 4 and text not in HARMLESS:
            self.report(node, "hardcoded-secret", "high")
        if isinstance(value, ast.Call) and (secret or any(x in name.lower() for x in ("nonce", "salt", "iv", "otp"))):
            called = self.called(value)
            if called.startswith("random.") and not called.startswith("random.System"):
                self.report(node, "insecure-random", "high")
        if name.upper() in ("DEBUG", "DEBUG_MODE") and isinstance(value, ast.Constant) and value.value is True:
            self.report(node, "debug-enabled", "medium")
        if text is not None and PRIVATE_ADDRESS.search(text):
            self.report(node, "hardcoded-ip", "low")

    def visit_Assign(self, node: ast.Assign) -> None:
        self.assigned(node, node.targets[0], node.value)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if node.value is not None:
            self.assigned(node, node.target, node.value)


def security(tree: ast.Module, source: str, path: str) -> list[tuple]:
    visitor = SecurityVisitor(source.splitlines())
    visitor.visit(tree)
    return visitor.found


# dead code

NEVER_DEAD = frozenset("_ __all__ __version__ __author__ __doc__".split())
EXTERNAL = frozenset(
    "property staticmethod classmethod abstractmethod overload override pytest.fixture fixture pytest.mark.parametrize parametrize app.route app.get app.post "
    "app.put app.delete router.get router.post router.put router.delete api_view action click.command click.group app.command shared_task task receiver".split()
)


def is_external(node: ast.AST) -> bool:
    """Whether a decorator hands the function to a framework."""
    names = {dotted(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list}
    return any(n in EXTERNAL or any(n.endswith(f".{e}") for e in EXTERNAL) for n in names)


def is_test_path(path: str) -> bool:
    base = path.rsplit("/", 1)[-1]
    return base.startswith("test_") or base.endswith("_test.py") or base == "conftest.py" or "/tests/" in path or "/test/" in path


def reads(node: ast.AST) -> set[str]:
    return {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)}


def exported(tree: ast.Module) -> set[str]:
    lists = [n.value for n in ast.walk(tree) if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets)]
    return {string_of(e) for v in lists if isinstance(v, (ast.List, ast.Tuple)) for e in v.elts} - {None}


def unused_imports(tree: ast.Module) -> Iterator[tuple]:
    used = exported(tree)
    for node in ast.walk(tree):
        if isinstance(node, ast.Name):
            used.add(node.id)
        elif isinstance(node, ast.Attribute):
            used |= {node.attr, dotted(node)}
    for node in tree.body:
        if isinstance(node, ast.Import) or isinstance(node, ast.ImportFrom) and node.module != "__future__":
            for alias in node.names:
                name = alias.asname or alias.name
                known = {name, name.partition(".")[0]} if isinstance(node, ast.Import) else {name}
                if alias.name != "*" and not known & used and name not in NEVER_DEAD:
                    yield "unused-import", name, node.lineno, None


def definitions(tree: ast.Module, source: str, path: str) -> list[tuple]:
    """Functions and methods that nothing in their own file refers to; who imports them is a join's question."""
    used = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} | {n.attr for n in ast.walk(tree) if isinstance(n, ast.Attribute)}
    in_test, found = is_test_path(path), []

    def consider(node: ast.AST, owner: ast.ClassDef | None) -> None:
        implicit = node.name.startswith("__") and node.name.endswith("__") or node.name in NEVER_DEAD
        entry = in_test and node.name.startswith(("test_", "setup_", "teardown_"))
        bases = {dotted(b).rpartition(".")[2] for b in owner.bases} if owner else set()
        visits = bool(bases & {"NodeVisitor", "NodeTransformer"}) and (node.name.startswith("visit_") or node.name == "generic_visit")
        if not (implicit or entry or visits or is_external(node) or node.name in used):
            found.append((node.name, owner.name if owner else None, node.lineno))

    for node in tree.body:
        if isinstance(node, FUNCTION):
            consider(node, None)
        elif isinstance(node, ast.ClassDef) and not (in_test and node.name.startswith("Test")):
            for child in node.body:
                if isinstance(child, FUNCTION):
                    consider(child, node)
    return found


def unused_variables(function: ast.AST) -> Iterator[tuple]:
    outer, last = set(), {}
    for node in own_nodes(function):
        if isinstance(node, (ast.Global, ast.Nonlocal)):
            outer |= set(node.names)
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) and node.value is not None else []
        for target in targets:
            flat = target.elts if isinstance(target, ast.Tuple) else [target]
            last |= {t.id: node.lineno for t in flat if isinstance(t, ast.Name) and not t.id.startswith("_")}
    for name, line in last.items():
        if name not in outer and name not in reads(function):
            yield "unused-variable", name, line, None


def is_stub(function: ast.AST) -> bool:
    body = function.body[1:] if len(function.body) == 2 and docstring(function) is not None else function.body
    only = body[0] if len(body) == 1 else None
    if isinstance(only, ast.Expr) and isinstance(only.value, ast.Constant):
        return only.value.value is Ellipsis or len(function.body) == 1 and isinstance(only.value.value, str)
    return isinstance(only, ast.Pass)


def unused_arguments(function: ast.AST) -> Iterator[tuple]:
    args = function.args
    if not (is_stub(function) or is_external(function) or args.vararg or args.kwarg):
        known = reads(function)
        for arg in (*args.args, *args.posonlyargs, *args.kwonlyargs):
            if arg.arg not in ("self", "cls") and not arg.arg.startswith("_") and arg.arg not in known:
                yield "unused-argument", arg.arg, function.lineno, None


def after_stop(body: list[ast.stmt]) -> Iterator[tuple]:
    for i, statement in enumerate(body):
        if isinstance(statement, STOP):
            rest = [s for s in body[i + 1 :] if not (isinstance(s, ast.Expr) and string_of(s.value) is not None)]
            if rest:
                yield "unreachable-code", f"after_{type(statement).__name__.lower()}", rest[0].lineno, rest[-1].end_lineno
            return


def dead(tree: ast.Module, source: str, path: str) -> list[tuple]:
    """All dead-code findings that one file can show, but for functions (see :func:`definitions`)."""
    found = list(unused_imports(tree))
    for node in ast.walk(tree):
        if isinstance(node, FUNCTION):
            found += [*unused_variables(node), *unused_arguments(node), *after_stop(node.body)]
            for child in own_nodes(node):
                if isinstance(child, (ast.If, ast.Try)):
                    found += [*after_stop(child.body), *after_stop(child.orelse), *after_stop(getattr(child, "finalbody", []))]
                elif isinstance(child, (*LOOP, *WITH, ast.ExceptHandler)):
                    found += after_stop(child.body)
    return found


FACETS: dict[str, Callable[[ast.Module, str, str], list[tuple]]] = {
    f.__name__: f
    for f in (functions, module, imports, signatures, any_usages, type_ignores, entities, tests, identifiers, blocks, bugs, security, dead, definitions)
}
