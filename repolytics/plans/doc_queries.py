"""Path, document and search queries over views of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolytics.operators import checks, classify, documents, extract, health, trace
from repolytics.plans import code_queries as c
from repolytics.plans import graph_queries as g
from repolytics.plans import history_queries as h
from repolytics.plans import impact_queries as i
from repolytics.plans import record_queries as r
from repolytics.plans.adapters import REPO, once, view, with_views
from repolytics.plans.sql import LANGUAGE, NAME, ROLE, SENSITIVE, quoted


def _routes(spark, sf):  # noqa: ANN001, ANN202
    """Routes of the files of orders: each script declares one, and its function handles it."""
    n = F.col("o") % 3
    rows = c.statements(spark, sf).groupBy("repo_id", "p").agg(F.min("o").alias("o"))
    return rows.select("repo_id", F.col("o").alias("ord"), F.when(n == 0, "ALL").otherwise("GET").alias("method"), F.format_string("/api/p%d", F.col("p")).alias("path"), F.format_string("web/o%d.ts", F.col("o")).alias("file"), F.when(n > 0, F.format_string("h%d", F.col("p"))).alias("handler"))


def _script_tree(spark, sf):  # noqa: ANN001, ANN202
    files = c.script_files(spark, sf).select("repo_id", "path")
    return files.withColumn("category", F.when(F.col("path").endswith("0.ts"), "frontend-component").when(F.col("path").endswith("5.ts"), "config").otherwise("service"))


def _script_edges(spark, sf):  # noqa: ANN001, ANN202
    """Files of one repository: each leads to the ones of the next orders."""

    def make():  # noqa: ANN202
        files = c.script_files(spark, sf).select("repo_id", F.regexp_extract("path", r"o(\d+)", 1).cast("long").alias("o"))
        turn = documents.Window.partitionBy("repo_id").orderBy("o")
        rows = files.select("repo_id", "o", F.lead("o", 1).over(turn).alias("a"), F.lead("o", 3).over(turn).alias("b"), F.lag("o", 2).over(turn).alias("c"))
        rows = rows.select("repo_id", "o", F.explode(F.array_compact(F.array("a", "b", F.when(F.col("o") % 5 == 0, F.col("c"))))).alias("t"))
        return rows.select("repo_id", F.format_string("web/o%d.ts", F.col("o")).alias("source"), F.format_string("web/o%d.ts", F.col("t")).alias("target"), F.lit("imports").alias("type"))

    return once(spark, sf, "script_edges", make)


def _script_symbols(spark, sf):  # noqa: ANN001, ANN202
    return c.script_symbols(spark, sf).select("repo_id", F.col("path").alias("file"), "name", "line")


def _dep(spark, sf):  # noqa: ANN001, ANN202
    return once(spark, sf, "step_dep", lambda: trace.first_dependencies(_script_edges(spark, sf)))


def step_table(spark, sf):  # noqa: ANN001, ANN201
    def make():  # noqa: ANN202
        tree = _script_tree(spark, sf)
        models = tree.filter(F.col("path").endswith("7.ts")).select("repo_id", F.col("path").alias("file"), F.lit("M").alias("name"))
        return trace.step_table(tree, _dep(spark, sf), _script_symbols(spark, sf), _routes(spark, sf), models)

    return once(spark, sf, "steps", make)


def trace_steps(spark, sf):  # noqa: ANN001, ANN201
    def make():  # noqa: ANN202
        files, symbols = c.script_files(spark, sf), _script_symbols(spark, sf)
        return trace.step_edges(step_table(spark, sf), _script_tree(spark, sf), _dep(spark, sf), symbols, extract.called_names(files), extract.function_bodies(files, symbols), _routes(spark, sf), c.http_calls(spark, sf))

    return once(spark, sf, "step_edges", make)


def _trace_questions(spark, sf):  # noqa: ANN001, ANN202
    """A question for each file: by route, by symbol, by file, by an earlier answer, or in words."""
    n, o = F.col("o") % 6, F.regexp_extract("path", r"o(\d+)", 1).cast("long").alias("o")
    rows = _script_tree(spark, sf).select("repo_id", "path", o)
    null = F.lit(None).cast("string")
    text = F.when(F.col("o") % 4 == 0, "where does the startup happen").when(F.col("o") % 4 == 1, F.format_string("what about o%d0 then", F.col("o"))).when(F.col("o") % 4 == 2, F.format_string("p%d", F.col("o"))).otherwise("-")
    return rows.select("repo_id", "path", F.col("path").alias("question_id"), F.when(n == 0, F.format_string("get /api/p%d", F.col("o") % 50)).alias("route"), F.when((n == 1) | (n == 2), F.col("path")).alias("start_file"), F.when(n == 1, "someThing").alias("start_symbol"), F.when(n >= 4, text).otherwise(null).alias("text"), n.alias("n"))


def trace_start_points(spark, sf):  # noqa: ANN001, ANN201
    q = _trace_questions(spark, sf)
    files = _script_tree(spark, sf)
    context = q.filter("n = 3").select("repo_id", "question_id", F.posexplode(F.array("path", F.lit("web/none.ts"))).alias("ord", "path"))
    entries = files.filter(F.col("path").endswith("9.ts"))
    return trace.trace_start_points(q, files, _script_symbols(spark, sf), _routes(spark, sf), entries, context).drop("symbol")


def trace_paths(spark, sf):  # noqa: ANN001, ANN201
    def make():  # noqa: ANN202
        starts = trace_start_points(spark, sf).select("repo_id", "step").distinct()
        return trace.trace_paths(starts, trace_steps(spark, sf))

    return once(spark, sf, "paths", make)


def rank_paths(spark, sf):  # noqa: ANN001, ANN201
    return trace.rank_paths(trace_paths(spark, sf), step_table(spark, sf), trace_steps(spark, sf))


def discover_commands(spark, sf):  # noqa: ANN001, ANN201
    return _commands(spark, sf)[0]


def _commands(spark, sf):  # noqa: ANN001, ANN202
    texts = view(spark, sf, "manifests")
    more = texts.filter(F.length("content") % 2 == 0).select("repo_id", F.explode(F.array(F.lit("tests/test_x.py"), F.lit("frontend/tsconfig.json"))).alias("path"))
    return checks.discover_commands(texts, texts.select("repo_id", "path").unionByName(more))


def command_warnings(spark, sf):  # noqa: ANN001, ANN201
    return _commands(spark, sf)[1]


def recommended_commands(spark, sf):  # noqa: ANN001, ANN201
    changes = view(spark, sf, "manifests").select("repo_id", F.col("path").alias("change"), F.when(F.length("content") % 2 == 0, "a/b.tsx").otherwise("c.py").alias("path"))
    return checks.recommended_commands(changes, discover_commands(spark, sf))


def _with_tests(spark, sf):  # noqa: ANN001, ANN202
    """The tree, and a test at the root for Python files of even length."""
    t = view(spark, sf, "tree")
    own = t.filter(F.col("path").endswith(".py") & (F.length("path") % 2 == 0)).select("repo_id", F.concat(F.lit("test_"), F.substring_index("path", "/", -1)).alias("path"))
    return t.unionByName(own)


def select_tests(spark, sf):  # noqa: ANN001, ANN201
    files = view(spark, sf, "commit_files").select("repo_id", F.col("sha").alias("change"), "path")
    affected = files.filter(F.length("path") % 5 == 0).select("repo_id", "change", F.concat(F.lit("test_"), F.substring_index("path", "/", -1)).alias("path"))
    return checks.select_tests(files, affected, _with_tests(spark, sf))


def _facts(spark, sf):  # noqa: ANN001, ANN202
    def make():  # noqa: ANN202
        files, routes, models, entries, edges = g._files(spark, sf), g._routes(spark, sf), g._models(spark, sf), g._entries(spark, sf), view(spark, sf, "edges")
        symbols = _symbols(spark, sf).withColumn("line", F.lit(1))
        named = routes.withColumn("handler", F.when(F.col("method") == "GET", F.substring_index("path", "/", -1)))
        env = files.filter(F.col("path").startswith("lib")).select("repo_id", F.upper(F.regexp_replace(F.substring_index("path", "/", -1), "[^a-z0-9]", "_")).alias("name"))
        commands = files.filter(F.col("category") == "build").select("repo_id", F.lit(".").alias("folder"), F.concat(F.lit("run "), "path").alias("command"))
        issues = i.simple_findings(spark, sf).withColumn("penalty", health.penalty())
        ranked = files.filter(F.col("path").endswith("9.js")).select("repo_id", F.col("path").alias("start"), F.array("path", F.lit("lib/x")).alias("path"), F.lit(1).alias("position"))
        steps = files.select("repo_id", F.col("path").alias("step"), F.col("path").alias("file"), F.lit(None).cast("string").alias("symbol"))
        technologies = files.groupBy("repo_id", F.col("language").alias("name")).agg(F.lit("language").alias("category"))
        return documents.fact_lists(
            documents.overview_facts(files, routes, models, technologies), documents.architecture_facts(classify.map_layers(files), entries, edges), documents.module_facts(files, symbols, edges, routes), documents.api_facts(named),
            documents.data_model_facts(models, routes), documents.flow_facts(ranked, steps), documents.onboarding_facts(files, entries, env, commands), documents.change_facts(view(spark, sf, "commits"), view(spark, sf, "commit_files")),
            documents.debt_facts(issues, h.hotspots(spark, sf)), documents.readme_facts(files, routes),
        )

    return once(spark, sf, "facts", make)


def doc_facts(spark, sf):  # noqa: ANN001, ANN201
    return _facts(spark, sf)


def dedupe_citations(spark, sf):  # noqa: ANN001, ANN201
    return documents.dedupe_citations(_facts(spark, sf))


def render_markdown(spark, sf):  # noqa: ANN001, ANN201
    return documents.render_markdown(_facts(spark, sf)).select("repo_id", "doc", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


def render_mermaid(spark, sf):  # noqa: ANN001, ANN201
    return documents.render_mermaid(view(spark, sf, "edges"))


def _symbols(spark, sf):  # noqa: ANN001, ANN202
    return view(spark, sf, "tree").select("repo_id", F.concat(F.lit("do_"), F.regexp_extract("path", r"/(f\d+)\.", 1)).alias("name"), F.col("path").alias("file"))


def explore_files(spark, sf):  # noqa: ANN001, ANN201
    return documents.explore_files(g._files(spark, sf), _symbols(spark, sf), query="O_F12", language="Python").select("repo_id", "path", "category", "language")


def explore_layer(spark, sf):  # noqa: ANN001, ANN201
    files = g._files(spark, sf)
    return documents.explore_files(files, _symbols(spark, sf), query="1", layer="Testing", layers=classify.map_layers(files)).select("repo_id", "path")


def filter_options(spark, sf):  # noqa: ANN001, ANN201
    files = g._files(spark, sf)
    return documents.filter_options(files, classify.map_layers(files))


def file_matches(spark, sf):  # noqa: ANN001, ANN201
    return documents.file_matches(view(spark, sf, "tree"), " F1", 30)


def symbol_matches(spark, sf):  # noqa: ANN001, ANN201
    return documents.symbol_matches(_symbols(spark, sf), view(spark, sf, "tree"), "f2", 15)


def cited_files(spark, sf):  # noqa: ANN001, ANN201
    n = F.length("path") % 3
    text = F.when(n == 0, F.concat(F.lit("see [it](file:///"), "path", F.lit("#L12) and `"), "path", F.lit("` and `none/x.py`"))).when(n == 1, F.concat(F.lit("only `"), "path", F.lit("`"))).otherwise("nothing `here`")
    t = view(spark, sf, "tree")
    return extract.extract_citations(t.select("repo_id", F.col("path").alias("answer_id"), text.alias("text")), t)


_ROUTES = "rt AS (SELECT repo_id, p, min(o) AS o FROM st GROUP BY ALL)"
_SYM = "'do_' || regexp_extract(path, '/(f\\d+)\\.', 1)"


def _list(doc: str, section: str, text: str, path: str = "NULL::VARCHAR", source: str = "c", kind: str = "FACT", line: str = "NULL::INT", symbol: str = "NULL::VARCHAR", order: str = "") -> str:
    """One list of facts as SQL."""
    names = ", ".join(f"o{k}" for k in range(len(order.split(" ;; ")))) if order else ""
    cols = ", ".join(f"{e} AS o{k}" for k, e in enumerate(order.split(" ;; "))) if order else ""
    by = (names + ", " if names else "") + "text, path NULLS FIRST, line NULLS FIRST, symbol"
    return f"""SELECT repo_id, doc, '{section}' AS section, '{kind}' AS kind, ord, text, path, line, symbol FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, doc ORDER BY {by} NULLS FIRST) AS ord FROM
  (SELECT DISTINCT repo_id, {doc} AS doc, {text} AS text, {path} AS path, {line} AS line, {symbol} AS symbol{", " + cols if cols else ""} FROM {source}) WHERE text IS NOT NULL AND (path IS NULL OR NOT {SENSITIVE.format(p="path")})) WHERE ord <= 60"""


_MOD = "'module:' || path"
_DOC_LISTS = [
    _list("'overview'", "project", "n || ' modeled files'", source="(SELECT repo_id, count(*) AS n FROM c GROUP BY 1)"),
    _list("'overview'", "surface", "n || ' routes'", source="(SELECT repo_id, count(*) AS n FROM ro GROUP BY 1)"),
    _list("'overview'", "data", "n || ' data models'", source="(SELECT repo_id, count(*) AS n FROM mo GROUP BY 1)"),
    _list("'overview'", "languages", "language || ': ' || n || ' files'", source="(SELECT repo_id, language, count(*) AS n FROM c GROUP BY ALL)"),
    _list("'overview'", "stack", "language || ' (language)'"),
    _list("'architecture'", "layers", "layer || ': ' || n || ' files'", source="(SELECT repo_id, layer, count(DISTINCT path) AS n FROM y GROUP BY ALL)"),
    _list("'architecture'", "entry_points", "'Entry point: ' || path", "path", "en"),
    _list("'architecture'", "dependencies", "source || ' -> ' || target || ' (' || type || ')'", "source", "edges"),
    _list(_MOD, "module", "category || ', ' || language", "path"),
    _list(_MOD, "symbols", "name", "path", "sy", line="1", symbol="name"),
    _list(_MOD, "imports", "'Imports ' || target", "path", "(SELECT repo_id, source AS path, target FROM (SELECT DISTINCT repo_id, source, target FROM edges) QUALIFY row_number() OVER (PARTITION BY repo_id, source ORDER BY target) <= 20)"),
    _list(_MOD, "dependents", "'Used by ' || source", "path", "(SELECT repo_id, target AS path, source FROM (SELECT DISTINCT repo_id, source, target FROM edges) QUALIFY row_number() OVER (PARTITION BY repo_id, target ORDER BY source) <= 20)"),
    _list(_MOD, "surface", "method || ' ' || route", "path", "ro"),
    _list("'api'", "routes", "method || ' ' || route", "path", "ro", symbol="handler"),
    _list("'api'", "handlers", "'Handler of ' || method || ' ' || route || ': ' || handler", "path", "(SELECT * FROM ro WHERE handler IS NOT NULL)", symbol="handler"),
    _list("'api'", "handlers", "'Handler of ' || method || ' ' || route || ': unknown'", "path", "(SELECT * FROM ro WHERE handler IS NULL)", kind="UNKNOWN"),
    _list("'data_models'", "models", "'Model ' || name", "path", "mo", symbol="name"),
    _list("'flow:' || path0", "steps", "'1.' || k || ' ' || path", "CASE WHEN k = 1 THEN path END", "(SELECT repo_id, path AS path0, unnest([1, 2]) AS k, unnest([path, 'lib/x']) AS path FROM c WHERE suffix(path, '9.js'))", order="k"),
    _list("'onboarding'", "manifests", "'Manifest: ' || path", "path", f"(SELECT * FROM c WHERE string_split(path, '/')[-1] IN ({quoted(documents.START_FILES)}))"),
    _list("'onboarding'", "entry_points", "'Entry point: ' || path", "path", "en"),
    _list("'onboarding'", "environment", "name", source="(SELECT repo_id, upper(regexp_replace(string_split(path, '/')[-1], '[^a-z0-9]', '_', 'g')) AS name FROM c WHERE starts_with(path, 'lib'))"),
    _list("'onboarding'", "validation", "'.: run ' || cmd", source="(SELECT repo_id, path AS cmd FROM c WHERE category = 'build')"),
    _list("'changes'", "commits", "left(sha, 8) || ': ' || subject || ', ' || n || ' files, +' || a || ' -' || d", source="(SELECT x.repo_id, x.sha, subject, author_date, coalesce(n, 0) AS n, coalesce(a, 0) AS a, coalesce(d, 0) AS d FROM (SELECT * FROM commits QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY author_date DESC, sha DESC) <= 30) x LEFT JOIN (SELECT repo_id, sha, count(*) AS n, sum(additions)::BIGINT AS a, sum(deletions)::BIGINT AS d FROM commit_files GROUP BY ALL) USING (repo_id, sha))", order="-epoch_us(author_date) ;; sha"),
    _list("'debt'", "health", "severity || ' ' || rule", "path", "(SELECT * FROM fd0 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY pen DESC, rule, path NULLS FIRST, line NULLS FIRST) <= 20)", kind="INFERENCE", line="line"),
    _list("'debt'", "hotspots", "path || ': ' || label || ' (' || score || '), ' || commits || ' commits'", "path", "(SELECT * FROM hot QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, path) <= 10)", kind="INFERENCE"),
    _list("'readme'", "features", "method || ' ' || route", "path", "(SELECT DISTINCT repo_id, method, route, path FROM ro QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY method, route) <= 10)"),
    _list("'readme'", "testing", "'Test: ' || path", "path", f"(SELECT * FROM c WHERE category = 'test' OR starts_with({NAME.format(p='path')}, 'test_') QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY path) <= 30)"),
    _list("'readme'", "structure", "folder || ': ' || n || ' files'", source="(SELECT * FROM (SELECT repo_id, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '.' END AS folder, count(*) AS n FROM c GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY folder) <= 30)"),
    _list("'readme'", "usage", "'Usage isn''t shown by the files.'", kind="UNKNOWN"),
]
_RO = "ro AS (SELECT repo_id, path, CASE WHEN length(path) % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/' || string_split(path, '/')[-2] || '/' || string_split(path, '/')[-1] AS route, CASE WHEN length(path) % 2 = 0 THEN string_split(path, '/')[-1] END AS handler FROM tree WHERE starts_with(path, 'src/api'))"
_MO = "mo AS (SELECT repo_id, path, string_split(string_split(path, '/')[-1], '.')[1] AS name FROM tree WHERE starts_with(path, 'lib'))"
_PARTS = f"""{g._CAT}, {g._LAY}, {_RO}, {_MO}, en AS (SELECT * FROM tree WHERE regexp_matches(path, '/f\\d*0\\.')), sy AS (SELECT repo_id, path, {_SYM} AS name FROM tree)"""


def _doc_sql(tail: str) -> str:
    """SQL over ``fa``, all facts."""
    parts = {"sz": i.t.SQL["size_findings"], "sec": i.t.SQL["security_findings"], "fan": g.SQL["fan_metrics"], "hot": h.SQL["hotspots"]}
    parts |= {v: f"SELECT * FROM ({with_views('SELECT * FROM ' + v, v)})" for v in ("tree", "edges", "commits", "commit_files")}
    lists = " UNION ALL ".join(f"SELECT * FROM ({x})" for x in _DOC_LISTS)
    return "WITH " + ", ".join(f"{n} AS ({q})" for n, q in parts.items()) + f""", {i._FIND}, fd0 AS (SELECT *, {i._PEN} AS pen FROM fd), {_PARTS},
  fa0 AS ({lists}), fa AS (SELECT * FROM fa0 WHERE NOT starts_with(doc, 'module:') OR (repo_id, path) IN (SELECT (repo_id, path) FROM tree)) {tail}"""


SQL = {
    "trace_steps": None,
    "discover_commands": with_views(
        f"""WITH {g._DEPS}, fo AS (SELECT repo_id, path, CASE WHEN contains(path, '/') THEN 'frontend' ELSE '.' END AS folder, content FROM manifests),
  sc AS (SELECT dp.repo_id, CASE WHEN contains(path, '/') THEN 'frontend' ELSE '.' END AS folder, name, value, 'pre' || name IN (SELECT name FROM dp q WHERE q.repo_id = dp.repo_id AND q.path = dp.path AND q.kind = 'script') AS hooked FROM dp WHERE kind = 'script' AND name IN ('test', 'lint', 'build')),
  f AS (SELECT repo_id, folder, name, name AS kind, CASE WHEN name = 'test' THEN 'npm test' ELSE 'npm run ' || name END AS command, 'package.json' AS source, 'MEDIUM' AS confidence FROM sc WHERE NOT hooked AND NOT contains(value, '|')
    UNION ALL SELECT DISTINCT repo_id, folder, u.name, u.kind, u.command, 'Python manifests', 'MEDIUM' FROM fo, (VALUES ('pytest', 'test', 'python -m pytest'), ('ruff', 'lint', 'ruff check .'), ('flake8', 'lint', 'flake8'), ('mypy', 'typecheck', 'mypy .'), ('pyright', 'typecheck', 'pyright')) u(name, kind, command) WHERE NOT suffix(path, '.json') AND regexp_matches(lower(content), '\\b' || u.name || '\\b')),
  tr AS (SELECT DISTINCT repo_id FROM manifests WHERE length(content) % 2 = 0)
SELECT * FROM f UNION ALL SELECT DISTINCT repo_id, folder, 'unittest', 'test', 'python -m unittest', 'test files', 'LOW' FROM fo WHERE NOT suffix(path, '.json') AND folder = '.' AND repo_id IN (SELECT repo_id FROM tr) AND (repo_id, folder) NOT IN (SELECT (repo_id, folder) FROM f WHERE kind = 'test')
UNION ALL SELECT repo_id, 'frontend', 'tsc', 'typecheck', 'npx tsc --noEmit', 'tsconfig.json', 'HIGH' FROM tr WHERE (repo_id, 'frontend') NOT IN (SELECT (repo_id, folder) FROM f WHERE kind = 'typecheck')""",
        "manifests"),
    "command_warnings": with_views(
        f"""WITH {g._DEPS} SELECT repo_id, CASE WHEN contains(path, '/') THEN 'frontend' ELSE '.' END AS folder, name, CASE WHEN hooked THEN 'hooks' ELSE 'unknown tool' END AS reason FROM (SELECT dp.*, 'pre' || name IN (SELECT name FROM dp q WHERE q.repo_id = dp.repo_id AND q.path = dp.path AND q.kind = 'script') AS hooked FROM dp WHERE kind = 'script' AND name IN ('test', 'lint', 'build')) WHERE hooked OR contains(value, '|')""",
        "manifests"),
    "select_tests": with_views(
        f"""WITH tt AS (SELECT * FROM tree UNION SELECT repo_id, 'test_' || string_split(path, '/')[-1] FROM tree WHERE suffix(path, '.py') AND length(path) % 2 = 0),
  ca AS (SELECT repo_id, sha AS change, 'test_' || string_split(path, '/')[-1] AS path, 0 AS turn, 'test_' || string_split(path, '/')[-1] AS why FROM commit_files WHERE length(path) % 5 = 0 UNION ALL SELECT repo_id, sha, 'test_' || regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') || '.py', 1, path FROM commit_files WHERE suffix(path, '.py')),
  c30 AS (SELECT * FROM ca QUALIFY row_number() OVER (PARTITION BY repo_id, change ORDER BY turn, why) <= 30), ok AS (SELECT c30.* FROM c30 SEMI JOIN tt USING (repo_id, path) WHERE regexp_matches(path, '^test_.*\\.py$') AND NOT {SENSITIVE.format(p="path")})
SELECT repo_id, change, path, row_number() OVER (PARTITION BY repo_id, change ORDER BY min((turn, why))) AS position FROM ok GROUP BY repo_id, change, path QUALIFY position <= 10""",
        "tree", "commit_files"),
    "doc_facts": _doc_sql("SELECT * FROM fa"),
    "dedupe_citations": _doc_sql("SELECT repo_id, doc, path, line, symbol, arg_min(section, (section, kind, ord)) AS section FROM fa WHERE path IS NOT NULL GROUP BY repo_id, doc, path, line, symbol"),
    "render_markdown": _doc_sql(
        """, se AS (SELECT repo_id, doc, section, '## ' || section || chr(10) || chr(10) || string_agg('- **' || kind || ':** ' || text, chr(10) ORDER BY list_position(['FACT', 'INFERENCE', 'UNKNOWN'], kind), ord, text)
    || CASE WHEN count(path) > 0 THEN chr(10) || chr(10) || 'Sources:' || chr(10) || (array_to_string(list_sort(list(DISTINCT '- `' || path || coalesce(':' || line, '') || '`') FILTER (WHERE path IS NOT NULL)), chr(10))) ELSE '' END AS t FROM fa GROUP BY repo_id, doc, section),
  md AS (SELECT repo_id, doc, '# ' || doc || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY section) || chr(10) AS text FROM se GROUP BY repo_id, doc) SELECT repo_id, doc, md5(text) AS digest, length(text) AS n FROM md"""),
    "render_mermaid": with_views(
        """WITH t AS (SELECT repo_id, source, target FROM edges QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY source, target) <= 35), n AS (SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY path) - 1 AS k FROM (SELECT repo_id, source AS path FROM t UNION SELECT repo_id, target FROM t)),
  l AS (SELECT repo_id, 0 AS a, path AS b, '' AS c, '  n' || k || '["' || left(regexp_replace(path, '[^A-Za-z0-9_./ -]', '_', 'g'), 90) || '"]' AS s FROM n UNION ALL SELECT t.repo_id, 1, source, target, '  n' || x.k || ' --> n' || y.k FROM t JOIN n x ON x.repo_id = t.repo_id AND x.path = source JOIN n y ON y.repo_id = t.repo_id AND y.path = target)
SELECT repo_id, 'flowchart LR' || chr(10) || string_agg(s, chr(10) ORDER BY a, b, c) AS text FROM l GROUP BY 1""",
        "edges"),
    "explore_files": with_views(f"WITH {g._CAT} SELECT repo_id, path, category, language FROM c WHERE language = 'Python' AND regexp_matches(path, '/f12[0-9]*\\.')", "tree"),
    "explore_layer": with_views(f"WITH {g._CAT} SELECT repo_id, path FROM c WHERE category = 'test' AND (contains(lower(path), '1') OR contains(lower({_SYM}), '1'))", "tree"),
    "filter_options": with_views(f"WITH {g._CAT}, {g._LAY} SELECT DISTINCT repo_id, 'language' AS kind, language AS value FROM c UNION SELECT repo_id, 'category', category FROM c UNION SELECT repo_id, 'layer', layer FROM y", "tree"),
    "file_matches": with_views("SELECT repo_id, path FROM tree WHERE contains(lower(path), 'f1') QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY starts_with(lower(regexp_extract(path, '[^/]*$')), 'f1') DESC, length(path), path) <= 30", "tree"),
    "symbol_matches": with_views(f"SELECT DISTINCT repo_id, {_SYM} AS name, path AS file FROM tree WHERE contains({_SYM}, 'f2') QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY name, path) <= 15", "tree"),
    "cited_files": with_views("SELECT repo_id, path AS answer_id, path, CASE WHEN length(path) % 3 = 0 THEN 12 END AS line FROM tree WHERE length(path) % 3 < 2", "tree"),
}
SQL = {k: v for k, v in SQL.items() if v}
SQL["recommended_commands"] = f"""WITH co AS (SELECT DISTINCT repo_id, folder, name, kind FROM ({SQL["discover_commands"]})), ch AS (SELECT repo_id, change, web FROM ({with_views("SELECT repo_id, path AS change, length(content) % 2 = 0 AS web FROM manifests", "manifests")})),
  kd AS (SELECT * FROM (VALUES (true, 0, 'typecheck'), (true, 1, 'unit'), (true, 2, 'test'), (true, 3, 'build'), (false, 0, 'unit'), (false, 1, 'test'), (false, 2, 'lint')) v(web, k, kind))
SELECT co.repo_id, change, folder, name, co.kind, row_number() OVER (PARTITION BY co.repo_id, change ORDER BY k, folder, name) AS position FROM ch JOIN kd USING (web) JOIN co ON co.repo_id = ch.repo_id AND co.kind = kd.kind"""

QUERIES = {f.__name__: f for f in (trace_start_points, step_table, trace_steps, trace_paths, rank_paths, discover_commands, command_warnings, recommended_commands, select_tests, doc_facts, dedupe_citations, render_markdown, render_mermaid, explore_files, explore_layer, filter_options, file_matches, symbol_matches, cited_files)}
