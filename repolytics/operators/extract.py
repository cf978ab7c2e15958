"""Extraction from source texts with built-in expressions: scripts, manifests, calls, citations.

``contents`` is (repo_id, path, content).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolytics.functions.scalars import splitlines
from repolytics.functions.scripts import code_of, lexemes
from repolytics.operators.history import first_of

# Patterns of declarations and calls.
JS_IMPORT = r"""(?:import\s+(?:.*?\s+from\s+)?|require\s*\(\s*)['"]([^'"]+)['"]"""
JS_EXPORT = r"export\s+(?:default\s+)?(?:async\s+)?(?:function\s+|class\s+|const\s+|let\s+|var\s+)?([a-zA-Z0-9_$]+)"
JS_CLASS = r"class\s+([a-zA-Z0-9_$]+)"
JS_FUNCTION = r"(?:function\s+|const\s+|let\s+)([a-zA-Z0-9_$]+)\s*(?:=\s*(?:async\s*)?(?:\([^)]*\)|[a-zA-Z0-9_$]+)\s*=>|\()"
JS_ROUTE = r"""(?i)(?:app|router)\.(get|post|put|delete|patch|all|use)\s*\(\s*['"]([^'"]+)['"]"""
NOT_NAMES = ("function", "class", "const", "let", "var", "default", "async")
ENV_PYTHON = r"""os\.(?:environ(?:\[['"]([a-zA-Z0-9_]+)['"]\]|\.get\(['"]([a-zA-Z0-9_]+)['"])|getenv\(['"]([a-zA-Z0-9_]+)['"])"""
ENV_JS = r"""process\.env(?:\.([a-zA-Z0-9_]+)|\[['"]([a-zA-Z0-9_]+)['"]\])"""
HTTP_CALLS = (
    r"""(?i)fetch\s*\(\s*['"`]?([^'"`\s,]+)['"`]?(?:\s*,\s*\{[^}]*method:\s*['"]([a-zA-Z]+)['"])?""",
    r"""(?i)axios\.(get|post|put|delete|patch)\s*\(\s*['"`]?([^'"`\s,)]+)['"`]?""",
    r"""(?i)(?:apiClient|api|http|request|client)\.(get|post|put|delete|patch)\s*\(\s*['"`]?([^'"`\s,)]+)['"`]?""",
    r"""(?i)requests\.(get|post|put|delete|patch)\s*\(\s*['"`]?([^'"`\s,)]+)['"`]?""",
)
#: What all of them but the first need.
METHOD_CALL = r"(?i)\.(?:get|post|put|delete|patch)\s*\("
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")


def _found(lines: Column, pattern: str, group: int = 1) -> Column:
    """Matches of each line in order, without their repetitions."""
    return F.array_distinct(F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(pattern), group))))


def _first_lines(lines: Column, pattern: str) -> Column:
    """``name, line`` of each line's matches."""
    return F.flatten(F.transform(lines, lambda x, i: F.transform(F.regexp_extract_all(x, F.lit(pattern), 1), lambda n: F.struct(n.alias("name"), (i + 1).alias("line")))))


def _groups(pattern: str, p: int, m: int):  # noqa: ANN202
    """What two groups of ``pattern`` hold in a text that it matches."""
    return lambda z: F.struct(F.regexp_extract(z, pattern, p).alias("p"), F.regexp_extract(z, pattern, m).alias("m"))


SCRIPTS = r"\.(?:js|jsx|ts|tsx|mjs|cjs)$"


def _scripts(contents: DataFrame) -> DataFrame:
    """``repo_id, path, content, lines, code`` of script files: lines with their strings, and lines of code alone."""
    text = F.coalesce("content", F.lit(""))
    rows = contents.filter(F.col("path").rlike(SCRIPTS)).select("repo_id", "path", text.alias("content"))
    # Each text is cut into lexemes once, for both.
    rows = rows.withColumn("pieces", lexemes(F.col("content")))
    return rows.select("repo_id", "path", "content", splitlines(code_of(F.col("pieces"), strings=True)).alias("lines"), splitlines(code_of(F.col("pieces"))).alias("code"))


def extract_js_outline(contents: DataFrame) -> DataFrame:
    """Imports, exports, classes, functions, hooks, components, environment variables and Express routes of script files.

    Comments and what strings hold are no code; environment variables are looked
    for in the whole text.
    """
    rows = _scripts(contents)
    rows = rows.withColumn("functions", _found(F.col("code"), JS_FUNCTION))
    hook = r"^use[A-Z]"
    renders = F.col("path").endswith("x") | F.col("content").contains("return <")
    names = F.array(*[F.lit(x) for x in NOT_NAMES])
    routes = F.flatten(F.transform("lines", lambda x: F.transform(F.transform(F.regexp_extract_all(x, F.lit(JS_ROUTE), 0), _groups(JS_ROUTE, 2, 1)), lambda z: F.struct(F.upper(z["m"]).alias("method"), z["p"].alias("path")))))
    env = F.transform(F.transform(F.regexp_extract_all("content", F.lit(ENV_JS), 0), _groups(ENV_JS, 1, 2)), lambda z: F.when(z["p"] != "", z["p"]).otherwise(z["m"]))
    return rows.select(
        "repo_id", "path", _found(F.col("lines"), JS_IMPORT).alias("imports"), F.array_except(_found(F.col("code"), JS_EXPORT), names).alias("exports"), _found(F.col("code"), JS_CLASS).alias("classes"), "functions",
        F.filter("functions", lambda f: f.rlike(hook)).alias("hooks"), F.filter("functions", lambda f: ~f.rlike(hook) & f.rlike("^[A-Z]") & renders).alias("components"), F.array_distinct(env).alias("env_vars"), routes.alias("routes"),
    )


def js_symbols(contents: DataFrame) -> DataFrame:
    """``repo_id, path, name, type, line``: classes, functions, hooks and components of script files, each by its first line."""
    rows = _scripts(contents).select("repo_id", "path", F.col("code").alias("lines"), F.col("content").contains("return <").alias("renders"))
    rows = rows.withColumns({"class": _first_lines(F.col("lines"), JS_CLASS), "function": _first_lines(F.col("lines"), JS_FUNCTION)})
    rows = rows.select("repo_id", "path", "renders", F.explode(F.array(*[F.struct(F.lit(k).alias("type"), F.col(k).alias("found")) for k in ("class", "function")])).alias("x"))
    rows = rows.select("repo_id", "path", "renders", "x.type", F.explode("x.found").alias("s"))
    out = rows.groupBy("repo_id", "path", "renders", "type", "s.name").agg(F.min("s.line").alias("line"))
    kind = F.when(F.col("type") == "class", "class").when(F.col("name").rlike("^use[A-Z]"), "hook").when(F.col("name").rlike("^[A-Z]") & (F.col("path").endswith("x") | F.col("renders")), "component").otherwise("function")
    return out.select("repo_id", "path", "name", kind.alias("type"), "line")


def nextjs_routes(handlers: DataFrame) -> DataFrame:
    """Routes that a path itself names, for each handler (repo_id, path, name)."""
    app = F.regexp_extract("path", r"app/(api/.+?)/route\.[jt]sx?$", 1)
    page = F.regexp_extract("path", r"pages/(api/.+?)\.[jt]sx?$", 1)
    method = F.when((app != "") & F.upper("name").isin(*METHODS), F.upper("name")).otherwise("ALL")
    route = F.when(app != "", F.concat(F.lit("/"), app)).when(page != "", F.concat(F.lit("/"), F.regexp_replace(page, "/index$", "")))
    return handlers.select("repo_id", F.col("path").alias("file"), method.alias("method"), route.alias("path"), F.col("name").alias("handler"), F.lit("nextjs").alias("framework")).filter(F.col("path").isNotNull())


def extract_prisma_models(contents: DataFrame) -> DataFrame:
    """``repo_id, file, name, fields``: model blocks with the name and type of each field."""
    pattern = r"model\s+([a-zA-Z0-9_]+)\s*\{([^}]+)\}"
    rows = contents.filter(F.col("path").endswith(".prisma")).select("repo_id", F.col("path").alias("file"), F.explode(F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), 1).alias("name"), F.regexp_extract_all("content", F.lit(pattern), 2).alias("body"))).alias("m"))
    lines = F.filter(F.transform(splitlines(F.col("m.body")), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("@@"))
    fields = F.transform(F.filter(F.transform(lines, lambda x: F.split(x, r"\s+")), lambda p: F.size(p) >= 2), lambda p: F.struct(F.get(p, F.lit(0)).alias("name"), F.get(p, F.lit(1)).alias("type")))
    return rows.select("repo_id", "file", F.col("m.name").alias("name"), fields.alias("fields"))


def extract_env_vars(contents: DataFrame) -> DataFrame:
    """Distinct ``repo_id, name, file`` of environment variables that a text reads."""
    rows = contents.select("repo_id", F.col("path").alias("file"), F.explode(F.flatten(F.array(*[F.regexp_extract_all("content", F.lit(p), g) for p, n in ((ENV_PYTHON, 3), (ENV_JS, 2)) for g in range(1, n + 1)]))).alias("name"))
    return rows.filter(F.col("name") != "").select("repo_id", "name", "file").distinct()


def extract_http_calls(contents: DataFrame) -> DataFrame:
    """``repo_id, file, line, method, path`` of literal HTTP calls; template parts become ":param"."""

    def calls(x: Column, i: Column) -> Column:
        parts = []
        for k, p in enumerate(HTTP_CALLS):
            path, method = (1, 2) if k == 0 else (2, 1)
            # A call is found once; its parts are read from what it matched, which a pattern without a look around matches again.
            part = F.transform(F.regexp_extract_all(x, F.lit(p), 0), _groups(p, path, method))
            parts.append(F.transform(part, lambda z: F.struct((i + 1).alias("line"), F.when(z["m"] == "", "GET").otherwise(F.upper(z["m"])).alias("method"), F.trim(z["p"]).alias("path"))))
        fetched, named = parts[0], F.concat(*parts[1:])
        # Few lines hold the word or the method that a pattern needs.
        none = F.array().cast("array<struct<line:int,method:string,path:string>>")
        return F.concat(F.when(F.lower(x).contains("fetch"), fetched).otherwise(none), F.when(x.rlike(METHOD_CALL), named).otherwise(none))

    rows = contents.select("repo_id", F.col("path").alias("file"), F.explode(F.flatten(F.transform(splitlines(F.col("content")), calls))).alias("c"))
    rows = rows.filter(F.col("c.path").startswith("/") | F.col("c.path").startswith("http"))
    return rows.select("repo_id", "file", "c.line", "c.method", F.regexp_replace("c.path", r"\$\{[^}]+\}", ":param").alias("path"))


def extract_manifest_deps(contents: DataFrame) -> DataFrame:
    """``repo_id, path, kind, name, value``: dependencies and scripts of package, requirements and project files."""
    name = F.lower(F.substring_index("path", "/", -1))
    package = contents.filter(name == "package.json").withColumn("j", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>, scripts map<string,string>"))
    parts = [package.select("repo_id", "path", F.lit(kind).alias("kind"), F.explode(f"j.{key}").alias("name", "value")) for kind, key in (("dependency", "dependencies"), ("dev_dependency", "devDependencies"), ("script", "scripts"))]
    lines = contents.filter(name == "requirements.txt").select("repo_id", "path", F.explode(splitlines(F.col("content"))).alias("l")).withColumn("l", F.trim("l")).filter((F.col("l") != "") & ~F.col("l").startswith("#") & ~F.col("l").startswith("-"))
    wanted = r"^([A-Za-z0-9_.\-]+)\s*(.*)$"
    parts.append(lines.select("repo_id", "path", F.lit("dependency").alias("kind"), F.lower(F.regexp_extract("l", wanted, 1)).alias("name"), F.regexp_extract("l", wanted, 2).alias("value")).filter(F.col("name") != ""))
    project = contents.filter(name == "pyproject.toml").select("repo_id", "path", F.explode(F.regexp_extract_all("content", F.lit(r"""(?m)^\s*["']([A-Za-z0-9_.\-]+)\s*[<>=!~\["';,]"""), 1)).alias("name"))
    parts.append(project.select("repo_id", "path", F.lit("dependency").alias("kind"), F.lower("name").alias("name"), F.lit("").alias("value")).distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def extract_ts_aliases(contents: DataFrame) -> DataFrame:
    """``repo_id, alias, target, ord`` of the path aliases in tsconfig files; comments don't matter."""
    rows = contents.filter(F.col("path").rlike(r"(?:^|/)tsconfig\.json$"))
    clean = F.regexp_replace("content", r"(?s)//.*?\n|/\*.*?\*/", "")
    rows = rows.select("repo_id", F.explode(F.from_json(clean, "compilerOptions struct<paths: map<string,array<string>>>")["compilerOptions"]["paths"]).alias("alias", "targets"))
    return rows.select("repo_id", "alias", F.posexplode("targets").alias("ord", "target"))


def extract_python_fallback(contents: DataFrame) -> DataFrame:
    """``repo_id, path, kind, name, line`` by one pattern a line, for Python files that don't parse."""
    rows = contents.filter(F.col("path").endswith(".py")).select("repo_id", "path", F.posexplode(splitlines(F.col("content"))).alias("i", "l"))
    a, b = (F.regexp_extract("l", r"^\s*(?:import\s+([a-zA-Z0-9_., ]+)|from\s+([a-zA-Z0-9_.]+)\s+import)", g) for g in (1, 2))
    cls, fn = F.regexp_extract("l", r"^\s*class\s+([a-zA-Z0-9_]+)", 1), F.regexp_extract("l", r"^\s*def\s+([a-zA-Z0-9_]+)", 1)
    kind = F.when((a != "") | (b != ""), "import").when(cls != "", "class").when(fn != "", "function")
    name = F.when(a != "", F.trim(F.substring_index(a, ",", 1))).when(b != "", b).when(cls != "", cls).otherwise(fn)
    return rows.select("repo_id", "path", kind.alias("kind"), name.alias("name"), (F.col("i") + 1).alias("line")).filter(F.col("kind").isNotNull())


def extract_citations(answers: DataFrame, known: DataFrame) -> DataFrame:
    """``repo_id, answer_id, path, line``: file links, then paths in back ticks, that are known files; the first of each path."""
    link = r"\[[^\]]*\]\((?:file:///?)([^)#\s]+)(?:#L(\d+))?[^)]*\)"
    a = answers.select("repo_id", "answer_id", F.posexplode(F.arrays_zip(F.regexp_extract_all("text", F.lit(link), 1).alias("path"), F.regexp_extract_all("text", F.lit(link), 2).alias("line"))).alias("pos", "m")).select("repo_id", "answer_id", F.lit(0).alias("rank"), "pos", "m.path", F.when(F.col("m.line") != "", F.col("m.line").cast("int")).alias("line"))
    b = answers.select("repo_id", "answer_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"`([^`\s]+)`"), 1)).alias("pos", "path")).select("repo_id", "answer_id", F.lit(1).alias("rank"), "pos", "path", F.lit(None).cast("int").alias("line"))
    rows = a.unionByName(b).join(known.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
    return first_of(rows, ["repo_id", "answer_id", "path"], [F.asc("rank"), F.asc("pos")], 1).select("repo_id", "answer_id", "path", "line")


JS_NEW = r"\bnew\s+([A-Za-z0-9_$]+)\s*\("
# A name that begins right where the last call's bracket ended isn't taken.
JS_CALL = r"(?<![\w$])(?:(?!\G)|^)([A-Za-z_$][\w$]*+)\s*+\("
JS_BASE = r"\bclass\s+[A-Za-z0-9_$]+\s+extends\s+([A-Za-z0-9_$]+)"
NOT_CALLS = ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "super", "require", "import")


def js_usage(contents: DataFrame) -> DataFrame:
    """``repo_id, path, calls, constructs, bases, internal_imports, external_imports`` of script files."""
    rows = _scripts(contents)
    imports = F.col("imports")
    rows = rows.withColumns({"imports": _found(F.col("lines"), JS_IMPORT), "constructs": F.array_sort(_found(F.col("code"), JS_NEW))})
    calls = F.array_except(_found(F.col("code"), JS_CALL), F.concat(F.array(*[F.lit(x) for x in NOT_CALLS]), "constructs"))
    return rows.select(
        "repo_id", "path", F.array_sort(calls).alias("calls"), "constructs", F.array_sort(_found(F.col("code"), JS_BASE)).alias("bases"),
        F.filter(imports, lambda x: x.startswith(".")).alias("internal_imports"), F.filter(imports, lambda x: ~x.startswith(".")).alias("external_imports"),
    )


JS_DECLARED = r"^\s*export\s+(default\s+)?(?:async\s+)?(function|class|const|let|var|interface|type|enum)\s+([A-Za-z0-9_$]+)(.*)$"


def js_api_surface(contents: DataFrame) -> DataFrame:
    """``repo_id, path, kind, name, shape``: what a script file exports; ``shape`` is equal for equal declarations."""
    rows = _scripts(contents).select("repo_id", "path", F.explode("code").alias("l"))
    part = [F.regexp_extract("l", JS_DECLARED, g) for g in range(1, 5)]
    found = rows.select("repo_id", "path", part[1].alias("kind"), part[2].alias("name"), F.concat_ws("|", F.trim(part[0]), F.regexp_extract(part[3], r"^\s*(\([^)]*\)|[^={]*)", 1)).alias("shape"))
    return found.filter(F.col("name") != "").select("repo_id", "path", "kind", "name", F.sha2("shape", 256).alias("shape"))


def called_names(contents: DataFrame) -> DataFrame:
    """``repo_id, file, line, name``: names of three letters or more before a bracket, line by line."""
    rows = contents.select("repo_id", F.col("path").alias("file"), F.posexplode(splitlines(F.col("content"))).alias("i", "l"))
    each = rows.select("repo_id", "file", (F.col("i") + 1).alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("l", F.lit(r"(?<![A-Za-z_$])([A-Za-z_$][\w$]*+)\s*+\("), 1))).alias("name"))
    return each.filter(F.length("name") >= 3)


def function_bodies(contents: DataFrame, symbols: DataFrame) -> DataFrame:
    """``repo_id, file, caller, first, last``: lines of each symbol (repo_id, file, name, line), up to the next unindented declaration."""
    heads = contents.select("repo_id", F.col("path").alias("file"), splitlines(F.col("content")).alias("ls"))
    starts = F.filter(F.transform("ls", lambda x, i: F.when(x.rlike(r"^(?:def|function|class|export|const)\s"), i + 1)), lambda x: x.isNotNull())
    rows = symbols.select("repo_id", "file", F.col("name").alias("caller"), "line").join(heads.select("repo_id", "file", starts.alias("starts"), F.size("ls").alias("n")), ["repo_id", "file"])
    after = F.array_min(F.filter("starts", lambda x: x > F.col("line")))
    return rows.select("repo_id", "file", "caller", F.col("line").alias("first"), F.coalesce(after - 1, F.col("n")).alias("last"))
