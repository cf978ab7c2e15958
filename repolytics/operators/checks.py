"""Check commands that a repository's manifests name, and which of them a change calls for.

``contents`` is (repo_id, path, content), ``tree`` (repo_id, path).  Nothing is run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolytics.functions.paths import base_name, is_sensitive_path
from repolytics.operators.history import first_of

# Kinds of package scripts, the tools that a script may call, and the tools of Python projects.
SCRIPT_KINDS = {"test": "test", "test:unit": "unit", "test:integration": "integration", "typecheck": "typecheck", "type-check": "typecheck", "lint": "lint", "build": "build"}
SCRIPT_TOOLS = ("tsc", "vite", "next", "eslint", "jest", "vitest", "tsx", "pytest", "ruff", "mypy", "pyright")
PYTHON_TOOLS = (("pytest", "test", "python -m pytest"), ("ruff", "lint", "ruff check ."), ("flake8", "lint", "flake8"), ("mypy", "typecheck", "mypy ."), ("pyright", "typecheck", "pyright"))
PYTHON_MANIFESTS = ("pyproject.toml", "requirements.txt", "setup.cfg", "tox.ini", "pytest.ini")
FOLDERS = (".", "frontend")
MOST_BYTES = 200_000
COLUMNS = ("repo_id", "folder", "name", "kind", "command", "source", "confidence")


def _folder(path: Column) -> Column:
    """The folder of a root or frontend file, null for other files."""
    return F.when(~path.contains("/"), ".").when(path.rlike("^frontend/[^/]*$"), "frontend")


def _scripts(contents: DataFrame) -> DataFrame:
    """``repo_id, folder, name, body, hooked`` of package scripts of a known kind."""
    rows = contents.filter((_folder(F.col("path")).isNotNull()) & (base_name(F.col("path")) == "package.json") & (F.octet_length("content") <= MOST_BYTES))
    rows = rows.select("repo_id", _folder(F.col("path")).alias("folder"), F.from_json("content", "scripts map<string,string>")["scripts"].alias("s")).filter(F.col("s").isNotNull())
    each = rows.select("repo_id", "folder", "s", F.explode("s").alias("name", "body"))
    hooked = F.map_contains_key("s", F.concat(F.lit("pre"), F.col("name"))) | F.map_contains_key("s", F.concat(F.lit("post"), F.col("name")))
    return each.filter(F.lower("name").isin(*SCRIPT_KINDS) & F.col("body").isNotNull()).select("repo_id", "folder", "name", "body", hooked.alias("hooked"))


def _plain(body: Column) -> Column:
    """Whether a script is one to four known tools in a row and nothing else."""
    parts = F.transform(F.split(body, "&&"), lambda x: F.trim(x))
    return (F.size(parts) <= 4) & F.forall(parts, lambda x: ~x.contains("..") & x.rlike(r"^[\w./ -]+\z") & F.substring_index(x, " ", 1).isin(*SCRIPT_TOOLS))


def discover_commands(contents: DataFrame, tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Check commands of each repository, and warnings (repo_id, folder, name, reason) of scripts that aren't taken.

    The root and ``frontend`` are looked at.  A package script counts if its kind is
    known, it has no hooks and it only calls known tools; a Python tool counts if a
    manifest names it.  Without a test command ``unittest`` stands in where there
    are test files, and ``tsc`` without a type check where there is a tsconfig.
    """
    kinds = F.create_map(*[F.lit(x) for kv in SCRIPT_KINDS.items() for x in kv])
    scripts = _scripts(contents)
    taken = scripts.filter(~F.col("hooked") & _plain(F.col("body")))
    npm = taken.select("repo_id", "folder", "name", kinds[F.lower("name")].alias("kind"), F.when(F.col("name") == "test", "npm test").otherwise(F.concat(F.lit("npm run "), "name")).alias("command"), F.lit("package.json").alias("source"), F.lit("MEDIUM").alias("confidence"))
    warnings = scripts.filter(F.col("hooked") | ~_plain(F.col("body"))).select("repo_id", "folder", "name", F.when(F.col("hooked"), "hooks").otherwise("unknown tool").alias("reason"))
    manifests = contents.filter(_folder(F.col("path")).isNotNull() & base_name(F.col("path")).isin(*PYTHON_MANIFESTS) & (F.octet_length("content") <= MOST_BYTES) & (F.col("content") != ""))
    named = F.array_compact(F.array(*[F.when(F.lower("content").rlike(rf"\b{n}\b"), F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), F.lit(c).alias("command"))) for n, k, c in PYTHON_TOOLS]))
    python = manifests.select("repo_id", _folder(F.col("path")).alias("folder"), F.explode(named).alias("t")).select("repo_id", "folder", "t.*").distinct()
    python = python.select("repo_id", "folder", "name", "kind", "command", F.lit("Python manifests").alias("source"), F.lit("MEDIUM").alias("confidence"))
    found = npm.unionByName(python)
    files = tree.select("repo_id", "path").distinct()
    where = F.when(F.col("path").rlike(r"^(?:test_[^/]*\.py|tests/.*)$"), ".").when(F.col("path").rlike(r"^frontend/(?:test_[^/]*\.py|tests/.*)$"), "frontend")
    projects = manifests.select("repo_id", _folder(F.col("path")).alias("folder")).unionByName(files.filter(base_name(F.col("path")) == "manage.py").select("repo_id", _folder(F.col("path")).alias("folder"))).filter(F.col("folder").isNotNull()).distinct()
    bare = projects.join(found.filter(F.col("kind").isin("test", "unit")).select("repo_id", "folder"), ["repo_id", "folder"], "left_anti")
    bare = bare.join(files.select("repo_id", where.alias("folder")).filter(F.col("folder").isNotNull()), ["repo_id", "folder"], "left_semi")
    unit = bare.select("repo_id", "folder", F.lit("unittest").alias("name"), F.lit("test").alias("kind"), F.lit("python -m unittest").alias("command"), F.lit("test files").alias("source"), F.lit("LOW").alias("confidence"))
    typed = files.filter(base_name(F.col("path")) == "tsconfig.json").select("repo_id", _folder(F.col("path")).alias("folder")).filter(F.col("folder").isNotNull()).distinct()
    typed = typed.join(found.filter(F.col("kind") == "typecheck").select("repo_id", "folder"), ["repo_id", "folder"], "left_anti")
    tsc = typed.select("repo_id", "folder", F.lit("tsc").alias("name"), F.lit("typecheck").alias("kind"), F.lit("npx tsc --noEmit").alias("command"), F.lit("tsconfig.json").alias("source"), F.lit("HIGH").alias("confidence"))
    return found.unionByName(unit).unionByName(tsc).select(*COLUMNS), warnings


# Kinds of checks in the order in which a change calls for them.
WEB_KINDS, OTHER_KINDS = ("typecheck", "unit", "test", "build"), ("unit", "test", "lint")
CANDIDATES, TARGETED = 30, 10


def recommended_commands(changes: DataFrame, commands: DataFrame) -> DataFrame:
    """``repo_id, change, folder, name, kind, position`` of the commands that each change (repo_id, change, path) calls for."""
    web = changes.groupBy("repo_id", "change").agg(F.max(F.col("path").rlike(r"\.(?:ts|tsx|js|jsx)$")).alias("web"))
    kinds = F.when(F.col("web"), F.array(*[F.lit(k) for k in WEB_KINDS])).otherwise(F.array(*[F.lit(k) for k in OTHER_KINDS]))
    wanted = web.select("repo_id", "change", F.posexplode(kinds).alias("k", "kind"))
    rows = wanted.join(commands.select("repo_id", "folder", "name", "kind").distinct(), ["repo_id", "kind"])
    order = Window.partitionBy("repo_id", "change").orderBy("k", "folder", "name")
    return rows.select("repo_id", "change", "folder", "name", "kind", F.row_number().over(order).alias("position"))


def select_tests(changes: DataFrame, affected: DataFrame, tree: DataFrame) -> DataFrame:
    """``repo_id, change, path, position``: test files that a change (repo_id, change, path) is best checked by.

    The affected tests (repo_id, change, path) come first, then the test named
    after each changed Python file; of the first 30 candidates those count that are
    safe ``test_*.py`` files of the tree, ten at most.
    """
    stem = F.regexp_replace(base_name(F.col("path")), r"(?<=.)\.[^.]*$", "")
    own = changes.filter(F.col("path").endswith(".py")).select("repo_id", "change", F.concat(F.lit("test_"), stem, F.lit(".py")).alias("path"), F.lit(1).alias("turn"), F.col("path").alias("why"))
    rows = affected.select("repo_id", "change", "path", F.lit(0).alias("turn"), F.col("path").alias("why")).unionByName(own)
    rows = first_of(rows, ["repo_id", "change"], [F.asc("turn"), F.asc("why")], CANDIDATES)
    safe = F.col("path").rlike(r"(?:^|/)test_[^/]*\.py$") & ~F.col("path").rlike(r"[\\:]") & ~F.exists(F.split("path", "/"), lambda s: s.isin("", ".", "..", ".git", "node_modules")) & ~is_sensitive_path(F.col("path"))
    rows = rows.filter(safe).join(tree.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
    rows = rows.groupBy("repo_id", "change", "path").agg(F.min(F.struct("turn", "why")).alias("first"))
    order = Window.partitionBy("repo_id", "change").orderBy("first")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= TARGETED).drop("first")
