"""Operators that SQL can't say, or whose limits the given tables don't reach, on small fixtures."""

import itertools

import pytest
from pyspark.sql import functions as F

from repolytics import checkpoints
from repolytics.functions import paths
from repolytics.operators import checks, documents, extract, graph, lineage, records, resolve, stack, trace


def table(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_rename_chains_have_no_end(spark):
    n = 30
    files = table(spark, [("r", f"c{i:02d}", f"p{i}", f"p{i - 1}" if i else None, 1, 1) for i in range(n)], "repo_id string, sha string, path string, old_path string, additions long, deletions long")
    commits = table(spark, [("r", f"c{i:02d}", i, "a", "A", "s") for i in range(n)], "repo_id string, sha string, at long, author_email_hash string, author_name string, subject string").withColumn("author_date", F.timestamp_seconds("at"))
    row = lineage.file_history(commits, files, table(spark, [("r", f"p{n - 1}")], "repo_id string, path string")).collect()[0]
    assert (row.total_commits, row.first_known_commit, len(row.rename_history)) == (n, "c00", n - 1)


def brute_cycles(edges):
    nodes = {n for e in edges for n in e}
    ahead = {n: {b for a, b in edges if a == n} for n in nodes}

    def reach(n):
        seen, todo = set(), list(ahead[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += ahead[x]
        return seen

    far = {n: reach(n) for n in nodes}
    return {(n, min(m for m in far[n] if n in far[m])) for n in nodes if n in far[n]}


@pytest.mark.parametrize("small", [50_000, 0])
def test_cycles_in_one_task_and_in_rounds(spark, small):
    edges = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(25)] + [("n25", "n20"), ("n05", "n03"), ("n10", "n10"), ("z", "n00"), ("n12", "a"), ("a", "n11")]
    df = table(spark, [("r", a, b) for a, b in edges], "repo_id string, source string, target string")
    files = table(spark, [("r", n) for n in {n for e in edges for n in e}], "repo_id string, path string")
    assert {(r.path, r.component) for r in graph.dependency_cycles(df, files, small=small).collect()} == brute_cycles(edges)


def brute_paths(start, edges, depth, branch, most):
    ahead = {}
    for a, b in sorted(set(edges)):
        ahead.setdefault(a, []).append(b)
    done, front = {}, [[start]]
    for _ in range(depth):
        more = []
        for p in front:
            nexts = ahead.get(p[-1], [])[:branch]
            if not nexts or any(n in p for n in nexts):
                done[tuple(p)] = any(n in p for n in nexts)
            more += [[*p, n] for n in nexts if n not in p]
        front = sorted(more)[:most]
    for p in front:
        done.setdefault(tuple(p), False)
    return sorted(done.items())[:most]


def test_trace_paths_match_brute_force(spark):
    edges = [(f"s{a}", f"s{b}") for a, b in itertools.product(range(7), repeat=2) if (a * 5 + b * 3) % 4 == 1]
    df = table(spark, [("r", a, b) for a, b in edges], "repo_id string, source string, target string")
    got = trace.trace_paths(table(spark, [("r", "s0")], "repo_id string, step string"), df, depth=5, branch=2, paths=6).collect()
    assert sorted((tuple(r.path), r.cyclic) for r in got) == brute_paths("s0", edges, 5, 2, 6)


FILES = {"ui/Page.tsx": "frontend-component", "api/users.ts": "backend-route", "ctl/user_controller.ts": "controller", "svc/user_service.ts": "service", "db/user.ts": "model", "cfg/env.ts": "config"}
SYMBOLS = [("ui/Page.tsx", "Page", 1), ("ctl/user_controller.ts", "listUsers", 1), ("svc/user_service.ts", "findUsers", 1), ("svc/user_service.ts", "findAll", 5), ("svc/user_service.ts", "dropUsers", 9)]
DEPS = [("ui/Page.tsx", "cfg/env.ts"), ("api/users.ts", "ctl/user_controller.ts"), ("ctl/user_controller.ts", "svc/user_service.ts"), ("svc/user_service.ts", "db/user.ts"), ("svc/user_service.ts", "cfg/env.ts")]
TEXTS = {
    "ui/Page.tsx": "function Page() {\n  fetch('/users/')\n}", "ctl/user_controller.ts": "export function listUsers() {\n  findAll(1)\n  findUsers(2)\n  dropUsers(3)\n}", "svc/user_service.ts": "function findUsers() {\n}\n\n\nfunction findAll() {\n}\n\n\nfunction dropUsers() {}",
}


def step_tables(spark):
    files = table(spark, [("r", p, c) for p, c in FILES.items()], "repo_id string, path string, category string")
    symbols = table(spark, [("r", *s) for s in SYMBOLS], "repo_id string, file string, name string, line int")
    routes = table(spark, [("r", 0, "get", "/users", "api/users.ts", "listUsers"), ("r", 1, "POST", "/none", "api/users.ts", None)], "repo_id string, ord int, method string, path string, file string, handler string")
    texts = table(spark, [("r", p, t) for p, t in TEXTS.items()], "repo_id string, path string, content string")
    return files, symbols, routes, texts


def test_trace_steps(spark):
    files, symbols, routes, texts = step_tables(spark)
    deps = table(spark, [("r", *d) for d in DEPS], "repo_id string, source string, target string")
    models = table(spark, [("r", "db/user.ts", "User")], "repo_id string, file string, name string")
    steps, edges = trace.trace_steps(files, deps, symbols, extract.called_names(texts), extract.function_bodies(texts, symbols), routes, extract.extract_http_calls(texts), models)
    kinds = {r.step: r.type for r in steps.collect()}
    assert kinds["GET /users"] == "API_ROUTE" and kinds["db/user.ts"] == "MODEL" and kinds["ctl/user_controller.ts#listUsers"] == "CONTROLLER" and kinds["ui/Page.tsx#Page"] == "UI_COMPONENT"
    got = {(r.source, r.target): (r.relationship, r.confidence, r.noise) for r in edges.collect()}
    assert got["ui/Page.tsx", "GET /users"] == ("HTTP Request", "HIGH", False) and got["GET /users", "ctl/user_controller.ts#listUsers"] == ("dispatches to", "HIGH", False)
    called = {b for a, b in got if a == "ctl/user_controller.ts#listUsers"}
    assert called == {"svc/user_service.ts#findUsers", "svc/user_service.ts#findAll"}  # the first two, in order of their lines
    assert got["svc/user_service.ts#findAll", "db/user.ts"] == ("queries", "MEDIUM", False) and got["svc/user_service.ts#findAll", "cfg/env.ts"] == ("imports", "MEDIUM", True)
    found = trace.trace_paths(table(spark, [("r", "ui/Page.tsx#Page")], "repo_id string, step string"), edges)
    ranked = trace.rank_paths(found, steps, edges).collect()
    best = next(r for r in ranked if r.primary)
    assert best.path[:3] == ["ui/Page.tsx#Page", "GET /users", "ctl/user_controller.ts#listUsers"] and best.path[-1] == "db/user.ts" and best.category == "ui" and best.confidence == "MEDIUM"
    assert all("cfg/env.ts" not in r.path[2:] for r in ranked)


def test_trace_start_points(spark):
    files, symbols, routes, _ = step_tables(spark)
    entries = table(spark, [("r", "svc/user_service.ts")], "repo_id string, path string")
    asked = [("route", "GET /users/", None, None, None), ("lost", "GET /nowhere", "db/user.ts", None, None), ("symbol", None, "ui/Page.tsx", "go", None), ("file", None, "svc/user_service.ts", None, None), ("context", None, None, None, "zzz"), ("boot", None, None, None, "how does it launch"), ("words", None, None, None, "users page"), ("other", None, None, None, "env of it"), ("none", None, None, None, "??")]
    q = table(spark, [("r", *a) for a in asked], "repo_id string, question_id string, route string, start_file string, start_symbol string, text string")
    context = table(spark, [("r", "context", 0, "gone.ts"), ("r", "context", 1, "db/user.ts")], "repo_id string, question_id string, ord int, path string")
    rows = trace.trace_start_points(q, files, symbols, routes, entries, context).orderBy("question_id", "position").collect()
    got = {}
    for r in rows:
        got.setdefault(r.question_id, []).append((r.step, r.type))
    assert got == {
        "route": [("GET /users", "API_ROUTE")], "lost": [("db/user.ts", "MODEL")], "symbol": [("ui/Page.tsx#go", "UI_COMPONENT")], "file": [("svc/user_service.ts#findUsers", "SERVICE")], "context": [("db/user.ts", "MODEL")], "boot": [("svc/user_service.ts#main", "ENTRY_POINT")],
        "words": [("ui/Page.tsx", "UI_COMPONENT"), ("GET /users", "API_ROUTE")], "other": [("cfg/env.ts", "UNKNOWN")], "none": [("svc/user_service.ts", "ENTRY_POINT")],
    }


def test_relations_between_modules_need_a_name(spark):
    imports = table(spark, [("r", "packages/a-b/x.py", "packages/c/y.py"), ("r", "packages/c/y.py", "packages/a-b/x.py"), ("r", "packages/c/y.py", "packages/c/z.py"), ("s", "packages/c/y.py", "packages/a-b/x.py")], "repo_id string, source string, target string")
    specs = table(spark, [("r", "packages/c/y.py", "packages.a_b.x"), ("r", "packages/a-b/x.py", "other")], "repo_id string, path string, spec string")
    modules = table(spark, [("r", "packages/a-b", True), ("r", "packages/c", True), ("s", "packages/c", False)], "repo_id string, module string, is_multi_module boolean")
    assert {(r.repo_id, r.source[9], r.target[9:12]) for r in resolve.apart_in_modules(imports, specs, modules).collect()} == {("r", "c", "a-b"), ("r", "c", "c/z"), ("s", "c", "a-b")}


def test_check_commands(spark):
    texts = {"package.json": '{"scripts": {"test": "jest", "build": "tsc && rm -rf x", "lint": "eslint .", "prelint": "x", "typecheck": "tsc --noEmit && tsc && tsc && tsc && tsc"}}', "setup.cfg": "[x]\nflake8", "frontend/package.json": "not json", "deep/er/package.json": '{"scripts": {"test": "jest"}}'}
    df = table(spark, [("r", p, t) for p, t in texts.items()], "repo_id string, path string, content string")
    found, warned = checks.discover_commands(df, df.select("repo_id", "path"))
    assert {(r.folder, r.name, r.command) for r in found.collect()} == {(".", "test", "npm test"), (".", "flake8", "flake8")}
    assert {(r.name, r.reason) for r in warned.collect()} == {("build", "unknown tool"), ("lint", "hooks"), ("typecheck", "unknown tool")}
    assert checks.discover_commands(df.limit(0), df.limit(0).select("repo_id", "path"))[0].count() == 0


def test_key_files_of_modules_come_in_turn(spark):
    tree = ["pyproject.toml", "README.md", *[f"crews/{m}/{f}" for m in ("a", "b", "c") for f in ("crew.py", "main.py", "pyproject.toml", "x.py")], ".env", "dist/app.py", "tests/test_app.py"]
    rows = stack.pick_key_files(table(spark, [("r", p) for p in tree], "repo_id string, path string")).orderBy("position").collect()
    assert [r.path for r in rows] == ["pyproject.toml", "crews/a/crew.py", "crews/b/crew.py", "crews/c/crew.py", "crews/a/main.py", "crews/b/main.py", "crews/c/main.py", "crews/a/pyproject.toml"]


def test_bursts_match_a_plain_count(spark):
    times = [0, 1, 1, 30, 59, 60, 61, 61, 119, 120, 500]
    df = table(spark, [("r", i, t) for i, t in enumerate(times)], "root string, event_id long, t long").select("root", "event_id", F.timestamp_seconds("t").alias("ts"))
    got = {r.event_id: (r.recent, r.full) for r in records.burst_flags(df, limit=3, seconds=60).collect()}
    assert got == {i: (n, n >= 3) for i, t in enumerate(times) for n in [sum(1 for j, u in enumerate(times) if (u, j) < (t, i) and t - u < 60)]}


def test_facts_are_sixty_a_list(spark):
    files = table(spark, [("r", f"src/f{i:03d}.py", "service", "Python") for i in range(80)] + [("r", "a/.env", "config", "Unknown")], "repo_id string, path string, category string, language string")
    routes = table(spark, [], "repo_id string, method string, path string, file string")
    rows = documents.readme_facts(files, routes).collect()
    assert len([r for r in rows if r.section == "structure"]) == 2 and [r.kind for r in rows if r.section == "usage"] == ["UNKNOWN"]
    many = documents.facts(files, "d", "s", F.col("path"), F.col("path")).collect()
    assert len(many) == 60 and all(".env" not in r.path for r in many)


def test_repo_urls(spark):
    urls = {"a/b": ("a", "b"), "https://github.com/A/b.git": ("A", "b"), "http://www.github.com/a/b/tree/x": ("a", "b"), "github.com/a/b": ("a", "b"), "https://example.org/a/b": None, "settings/x": None, "a": None, "": None}
    df = table(spark, [(u,) for u in urls], "u string").select("u", paths.parse_repo_url(F.col("u")).alias("r"))
    assert {r.u: r.r and (r.r.owner, r.r.repo) for r in df.collect()} == urls


def test_a_cluster_must_name_its_folder():
    class Cluster:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://x:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        checkpoints.shared_folder(Cluster)
