"""Queries over source texts that Spark derives from the given orders: a Python and a script file for each order."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolytics.operators import extract, pyast, resolve
from repolytics.plans.adapters import once, view, with_views
from repolytics.plans.graph_queries import _DEPS


def _order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each order: ``repo_id, o`` and its distinct statements ``xs`` (line, part, supplier, quantity) in order.

    Orders and lines meet by the order's number, and nothing is shuffled again.
    """

    def make() -> DataFrame:
        o = spark.read.parquet(f"{sf}/orders.parquet").select(F.floor(F.col("o_custkey") / 4).alias("r"), F.col("o_orderkey").alias("o"))
        x = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("o"), F.struct(F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("int").alias("q")).alias("x"))
        rows = x.join(o, "o").groupBy("o", "r").agg(F.array_sort(F.array_distinct(F.collect_list("x"))).alias("xs"))
        return rows.select(F.concat(F.lit("repo-"), F.col("r").cast("string")).alias("repo_id"), "o", "xs")

    return once(spark, sf, "order_lines", make)


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each line item: repo_id, order, line, part, supplier and quantity."""
    return _order_lines(spark, sf).select("repo_id", "o", F.inline("xs"))


def _text(rows: DataFrame, path: str, ending: str, body: Callable[[Column], Column]) -> DataFrame:
    """Statements of each order in order, as one file."""
    name = F.concat(F.lit(path), F.col("o").cast("string"), F.lit(ending))
    return rows.select("repo_id", name.alias("path"), F.array_join(F.transform("xs", body), "").alias("content"))


def _said(template: str, **values: Column) -> Column:
    """``template`` with numbers in the place of their names in braces."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(values[x].cast("string"), F.lit("null")) if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def python_files(spark: SparkSession, sf: str) -> DataFrame:
    def body(x: Column) -> Column:
        p, s, q = x["p"], x["s"], x["q"]
        fn = (
            F.when(q % 4 == 0, _said("def f{p}(a, b):\n    if a:\n        return g{s}(tmp(b))\n    return C{s}(a)\n", p=p, s=s))
            .when(q % 4 == 1, _said("def f{p}(a, b):\n    for x in a:\n        if x and b and x and b and x:\n            while x:\n                with b:\n                    pass\n    return g{s}(b)\n", p=p, s=s))
            .when(q % 4 == 2, _said("def f{p}(a, b):\n" + "    a = a + 1\n" * 40 + "    return C{s}(a)\n", p=p, s=s)).otherwise(_said("def tmp(a):\n    return g{s}(a)\n", s=s))
        )
        cls = F.when(q >= 50, _said("class k_{p}(Base):\n    x = Column(1)\n    def go(self):\n        pass\n", p=p)).when(q >= 48, _said("class K{p}(Base):\n    x = Column(1)\n    def go(self):\n        pass\n", p=p)).otherwise("")
        const = F.when(x["k"] == 1, _said("LIMIT_{s} = os.getenv('VAR_{s}')\n", s=s)).otherwise("")
        return F.concat(_said("import pkg.o{p}\n", p=p), fn, cls, const)

    return once(spark, sf, "python_files", lambda: _text(_order_lines(spark, sf), "pkg/o", ".py", body))


def script_files(spark: SparkSession, sf: str) -> DataFrame:
    def body(x: Column) -> Column:
        p, s = x["p"], x["s"]
        call = F.when(s % 4 == 0, _said("fetch('/api/p{s}/x')", s=s)).when(s % 4 == 1, _said("fetch('/api/p{s}/x', { method: 'DELETE' })", s=s)).when(s % 4 == 2, _said("axios.post('/api/p{s}/x')", s=s)).otherwise(F.concat(_said("client.put(`/api/p{s}/", s=s), F.lit("${x}`)")))
        return F.concat(_said("import { x } from './o{p}'\nexport function h{p}(x) { return ", p=p), call, _said(" }\nrouter.get('/api/p{p}', h)\nconst useT{s} = (x) => process.env.VAR_{s}\n", p=p, s=s))

    return once(spark, sf, "script_files", lambda: _text(_order_lines(spark, sf), "web/o", ".ts", body))


def python_outline(spark, sf):  # noqa: ANN001, ANN201
    rows = python_files(spark, sf).select("repo_id", "path", pyast.python_outline(F.col("content")).alias("o"))
    return rows.select("repo_id", "path", "o.parse_ok", "o.imports", "o.functions", "o.classes", "o.constants", F.size("o.symbols").cast("long").alias("n_symbols"), F.size("o.models").cast("long").alias("n_models"))


def python_usage(spark, sf):  # noqa: ANN001, ANN201
    rows = python_files(spark, sf).select("repo_id", "path", pyast.python_usage(F.col("content")).alias("u"))
    return rows.select("repo_id", "path", "u.calls", "u.constructs", "u.bases", F.size("u.external_imports").cast("long").alias("n_external"))


def python_function_metrics(spark, sf):  # noqa: ANN001, ANN201
    rows = pyast.python_function_metrics(python_files(spark, sf)).select("repo_id", "path", F.explode("functions").alias("f")).select("repo_id", "path", "f.*")
    return rows.groupBy("repo_id", "path", "name", "span", "complexity", "nesting").agg(F.count(F.lit(1)).alias("n"))


def python_findings(spark, sf):  # noqa: ANN001, ANN201
    # Some functions are renamed, and some files don't parse.
    text = F.when(F.col("path").endswith("7.py"), F.concat(F.lit("def broken(\n"), "content")).otherwise(F.replace("content", F.lit("def f1"), F.lit("def F1")))
    files = python_files(spark, sf).withColumn("content", text)
    return pyast.python_findings(pyast.python_function_metrics(files), "Aggressive").groupBy("repo_id", "path", "rule", "severity", "name").agg(F.count(F.lit(1)).alias("n"))


def api_surface(spark, sf):  # noqa: ANN001, ANN201
    return pyast.api_surface(python_files(spark, sf)).groupBy("repo_id", "path", "kind").agg(F.count(F.lit(1)).alias("n"))


def structural_check(spark, sf):  # noqa: ANN001, ANN201
    files = python_files(spark, sf)
    return pyast.structural_check(files, files.select("repo_id", "path"))


def python_fallback(spark, sf):  # noqa: ANN001, ANN201
    return extract.extract_python_fallback(python_files(spark, sf)).groupBy("repo_id", "path", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"))


def js_outline(spark, sf):  # noqa: ANN001, ANN201
    return extract.extract_js_outline(script_files(spark, sf)).select("repo_id", "path", "imports", "exports", "functions", "hooks", "env_vars", F.size("routes").cast("long").alias("n_routes"))


def js_symbols(spark, sf):  # noqa: ANN001, ANN201
    return extract.js_symbols(script_files(spark, sf))


def script_symbols(spark, sf):  # noqa: ANN001, ANN201
    """What js_symbols gives, found once for all that join it with itself."""
    return once(spark, sf, "js_symbols", lambda: js_symbols(spark, sf))


def env_vars(spark, sf):  # noqa: ANN001, ANN201
    return extract.extract_env_vars(python_files(spark, sf).unionByName(script_files(spark, sf)))


def http_calls(spark, sf):  # noqa: ANN001, ANN201
    return extract.extract_http_calls(script_files(spark, sf))


def _routes(spark, sf):  # noqa: ANN001, ANN202
    """A route for each part that a repository names, in order of its first statement: an order and a line of it."""
    rows = statements(spark, sf).groupBy("repo_id", "p").agg(F.min(F.struct("o", "k")).alias("at"))
    ord_ = F.col("at.o") * 8 + F.col("at.k")
    return rows.select("repo_id", ord_.alias("ord"), F.when(F.col("p") % 2 == 0, "GET").otherwise("ALL").alias("method"), F.format_string("/api/p%d", F.col("p")).alias("path"), F.format_string("web/o%d.ts", F.col("at.o")).alias("file"))


def match_calls_to_routes(spark, sf):  # noqa: ANN001, ANN201
    return resolve.match_calls_to_routes(http_calls(spark, sf), _routes(spark, sf))


def route_callers(spark, sf):  # noqa: ANN001, ANN201
    routes = _routes(spark, sf).withColumn("path", F.concat("path", F.lit("/x/")))
    return resolve.route_callers(http_calls(spark, sf), routes)


def _python_names(spark, sf):  # noqa: ANN001, ANN202
    """What each Python file imports, defines and calls: each is parsed once."""

    def make() -> DataFrame:
        return python_files(spark, sf).select("repo_id", "path", pyast.python_names(F.col("content")).alias("n")).select("repo_id", "path", "n.*")

    return once(spark, sf, "python_names", make)


def _imports(spark, sf, aliased=False):  # noqa: ANN001, ANN202
    py = _python_names(spark, sf).select("repo_id", "path", F.posexplode("imports").alias("ord", "spec"))
    js = js_outline(spark, sf).select("repo_id", "path", F.posexplode("imports").alias("ord", "spec"))
    if aliased:
        js = js.withColumn("spec", F.regexp_replace("spec", r"^\./(o\d*[02468])$", "@/$1"))
    return py.unionByName(js)


def _tree(spark, sf):  # noqa: ANN001, ANN202
    return python_files(spark, sf).select("repo_id", "path").unionByName(script_files(spark, sf).select("repo_id", "path"))


def resolve_imports(spark, sf):  # noqa: ANN001, ANN201
    tree = _tree(spark, sf)
    aliases = tree.select("repo_id").distinct().select("repo_id", F.lit("@/*").alias("alias"), F.lit("web/*").alias("target"), F.lit(0).alias("ord"))
    return resolve.resolve_imports(_imports(spark, sf, True), tree, aliases).select("repo_id", "source", "spec", "target").distinct()


def relationships(spark, sf):  # noqa: ANN001, ANN201
    of = _python_names(spark, sf)
    names = [of.select("repo_id", "path", F.explode(c).alias("name")) for c in ("classes", "functions")]
    imports = resolve.resolve_imports(of.select("repo_id", "path", F.posexplode("imports").alias("ord", "spec")), of.select("repo_id", "path"))
    return resolve.relationships(imports, of.select("repo_id", "path", "calls", "constructs"), *names)


def manifest_deps(spark, sf):  # noqa: ANN001, ANN201
    return extract.extract_manifest_deps(view(spark, sf, "manifests"))


def _parts(spark, sf):  # noqa: ANN001, ANN202
    return spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("pack-"), F.floor(F.col("p_partkey") / 4).cast("string")).alias("repo_id"), F.col("p_partkey").alias("p"))


def nextjs_routes(spark, sf):  # noqa: ANN001, ANN201
    k = F.col("p") % 4
    path = F.when(k < 2, F.format_string("src/app/api/u%d/route.ts", F.col("p"))).when(k == 2, F.format_string("pages/api/x%d/index.js", F.col("p"))).otherwise(F.format_string("lib/y%d.ts", F.col("p")))
    return extract.nextjs_routes(_parts(spark, sf).select("repo_id", path.alias("path"), F.when(k == 0, "post").otherwise("helper").alias("name")))


def prisma_models(spark, sf):  # noqa: ANN001, ANN201
    text = F.format_string("model User%d {\n  id Int @id\n  // note\n  name%d String\n  @@map\n}\nmodel B%d {\n  x Y\n}\n", F.col("p"), F.col("p"), F.col("p"))
    rows = extract.extract_prisma_models(_parts(spark, sf).select("repo_id", F.format_string("db/s%d.prisma", F.col("p")).alias("path"), text.alias("content")))
    return rows.select("repo_id", "file", "name", F.array_join(F.transform("fields", lambda x: F.concat_ws(":", x["name"], x["type"])), ",").alias("fields"))


def ts_aliases(spark, sf):  # noqa: ANN001, ANN201
    text = F.format_string('{ // note\n "compilerOptions": { /* more */ "paths": { "@%d/*": ["src/*"], "lib": ["a%d", "b"] } } }', F.col("p"), F.col("p"))
    return extract.extract_ts_aliases(_parts(spark, sf).select("repo_id", F.format_string("m%d/tsconfig.json", F.col("p")).alias("path"), text.alias("content")))


def js_usage(spark, sf):  # noqa: ANN001, ANN201
    return extract.js_usage(script_files(spark, sf))


def js_api_surface(spark, sf):  # noqa: ANN001, ANN201
    return extract.js_api_surface(script_files(spark, sf)).groupBy("repo_id", "path", "kind", "name", "shape").agg(F.count(F.lit(1)).alias("n"))


def build_edges(spark, sf):  # noqa: ANN001, ANN201
    tree = _tree(spark, sf).withColumn("category", F.when(F.col("path").endswith("0.ts"), "frontend-component").when(F.col("path").endswith(".ts"), "service").otherwise("model"))
    return resolve.build_edges(resolve.resolve_imports(_imports(spark, sf), _tree(spark, sf)), tree)


def line_hunks(spark, sf):  # noqa: ANN001, ANN201
    c = view(spark, sf, "contents")
    pairs = c.select("repo_id", "path", F.col("content").alias("before"), F.regexp_replace("content", r"(?m)^(The|Der|Le) ", "").alias("after"))
    return pyast.line_hunks(pairs).select("repo_id", "path", F.size("hunks").cast("long").alias("n_hunks"), F.length("diff").cast("long").alias("n"))


def safe_rewrites(spark, sf):  # noqa: ANN001, ANN201
    rows = python_files(spark, sf).withColumn("content", F.concat(F.replace("content", F.lit("(a, b):\n"), F.lit("(a, b):  \n\n\n\n")), F.lit("# end")))
    return pyast.safe_rewrites(rows).select("repo_id", "path", "rewrite", F.length("proposed").cast("long").alias("n"))


_ST = "st AS (SELECT DISTINCT 'repo-' || floor(o_custkey / 4)::BIGINT AS repo_id, o_orderkey AS o, l_linenumber AS k, l_partkey AS p, l_suppkey AS s, l_quantity::INT AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_PY, _TS = "'pkg/o' || o || '.py'", "'web/o' || o || '.ts'"
_O = "ORDER BY k, p, s, q"
_FN = "CASE WHEN q % 4 = 3 THEN 'tmp' ELSE 'f' || p END"
_CLS = "CASE WHEN q >= 50 THEN 'k_' || p ELSE 'K' || p END"
_CALL = "'/api/p' || s || CASE s % 4 WHEN 3 THEN '/:param' ELSE '/x' END"
_VERB = "CASE s % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'DELETE' WHEN 2 THEN 'POST' ELSE 'PUT' END"
_SIZE = "CASE q % 4 WHEN 0 THEN (4, 2, 1) WHEN 1 THEN (7, 8, 4) WHEN 2 THEN (42, 1, 0) ELSE (2, 1, 0) END"


def _uniq(x: str) -> str:
    """A list's values in order of their first place."""
    return f"list_filter({x}, lambda one, pos: list_position({x}, one) = pos)"


SQL = {
    "python_outline": f"""WITH {_ST} SELECT repo_id, {_PY} AS path, true AS parse_ok, list('pkg.o' || p {_O}) AS imports, list({_FN} {_O}) AS functions, coalesce(list({_CLS} {_O}) FILTER (WHERE q >= 48), []) AS classes, coalesce(list('LIMIT_' || s {_O}) FILTER (WHERE k = 1), []) AS constants,
  count(*) + 2 * count(*) FILTER (WHERE q >= 48) AS n_symbols, count(*) FILTER (WHERE q >= 48) AS n_models FROM st GROUP BY repo_id, o""",
    "python_usage": f"""WITH {_ST}, x AS (SELECT repo_id, o, 'g' || s AS c FROM st WHERE q % 4 <> 2 UNION SELECT repo_id, o, 'tmp' FROM st WHERE q % 4 = 0 UNION SELECT repo_id, o, 'getenv' FROM st WHERE k = 1), n AS (SELECT repo_id, o, 'C' || s AS c FROM st WHERE q % 4 IN (0, 2) UNION SELECT repo_id, o, 'Column' FROM st WHERE q >= 48),
  c AS (SELECT repo_id, o, list_sort(list(c)) AS calls FROM x GROUP BY ALL), d AS (SELECT repo_id, o, list_sort(list(c)) AS constructs FROM n GROUP BY ALL), z AS (SELECT repo_id, o, CASE WHEN bool_or(q >= 48) THEN ['Base'] ELSE [] END AS bases, count(*) AS n_external FROM st GROUP BY ALL)
SELECT repo_id, {_PY} AS path, coalesce(calls, []) AS calls, coalesce(constructs, []) AS constructs, bases, n_external FROM z LEFT JOIN c USING (repo_id, o) LEFT JOIN d USING (repo_id, o)""",
    "python_function_metrics": f"""WITH {_ST}, x AS (SELECT repo_id, o, {_FN} AS name, {_SIZE} AS m FROM st UNION ALL SELECT repo_id, o, 'go', (2, 1, 0) FROM st WHERE q >= 48)
SELECT repo_id, {_PY} AS path, name, m[1] AS span, m[2] AS complexity, m[3] AS nesting, count(*) AS n FROM x GROUP BY ALL""",
    "python_findings": f"""WITH {_ST}, f AS (SELECT repo_id, o, CASE WHEN q % 4 = 3 THEN 'tmp' WHEN starts_with(p::VARCHAR, '1') THEN 'F' || p ELSE 'f' || p END AS name, q, p FROM st WHERE o % 10 <> 7),
  x AS (SELECT repo_id, o, 'long_function' AS rule, 'MEDIUM' AS severity, name FROM f WHERE q % 4 = 2 UNION ALL SELECT repo_id, o, unnest(['branch_complexity', 'deep_nesting']), 'MEDIUM', name FROM f WHERE q % 4 = 1 UNION ALL SELECT repo_id, o, 'vague_name', 'LOW', name FROM f WHERE q % 4 = 3
    UNION ALL SELECT repo_id, o, 'nonstandard_function_name', 'LOW', name FROM f WHERE starts_with(name, 'F') UNION ALL SELECT repo_id, o, 'nonstandard_class_name', 'LOW', 'k_' || p FROM f WHERE q >= 50 UNION ALL SELECT repo_id, o, 'crowded_module', 'LOW', NULL FROM (SELECT repo_id, o, count(*) + count(*) FILTER (WHERE q >= 48) AS n FROM f GROUP BY ALL) WHERE n > 25
    UNION ALL SELECT DISTINCT repo_id, o, 'parse_unavailable', 'LOW', NULL FROM st WHERE o % 10 = 7)
SELECT repo_id, {_PY} AS path, rule, severity, name, count(*) AS n FROM x GROUP BY ALL""",
    "api_surface": f"""WITH {_ST}, x AS (SELECT repo_id, o, 'function' AS kind FROM st UNION ALL SELECT repo_id, o, unnest(['class', 'method']) FROM st WHERE q >= 48 UNION ALL SELECT repo_id, o, 'binding' FROM st WHERE k = 1) SELECT repo_id, {_PY} AS path, kind, count(*) AS n FROM x GROUP BY repo_id, o, kind""",
    "structural_check": f"""WITH {_ST}, f AS (SELECT DISTINCT repo_id, o FROM st), d AS (SELECT repo_id, o, {_FN} AS name FROM st UNION ALL SELECT repo_id, o, {_CLS} FROM st WHERE q >= 48)
SELECT repo_id, {_PY} AS path, 'duplicate_name' AS problem, name AS detail FROM d GROUP BY repo_id, o, name HAVING count(*) > 1
UNION ALL SELECT DISTINCT repo_id, {_PY}, 'unresolved_import', 'pkg.o' || p FROM st WHERE (repo_id, p) NOT IN (SELECT (repo_id, o) FROM f)""",
    "python_fallback": f"""WITH {_ST}, x AS (SELECT repo_id, o, 'import' AS kind, 'pkg.o' || p AS name FROM st UNION ALL SELECT repo_id, o, 'function', {_FN} FROM st UNION ALL SELECT repo_id, o, unnest(['class', 'function']), unnest([{_CLS}, 'go']) FROM st WHERE q >= 48) SELECT repo_id, {_PY} AS path, kind, count(*) AS n, min(name) AS first FROM x GROUP BY repo_id, o, kind""",
    "js_outline": f"""WITH {_ST}, x AS (SELECT repo_id, o, list('./o' || p {_O}) AS i, list('h' || p {_O}) AS e, flatten(list(['h' || p, 'useT' || s] {_O})) AS f, list('useT' || s {_O}) AS h, list('VAR_' || s {_O}) AS v, count(*) AS n FROM st GROUP BY repo_id, o)
SELECT repo_id, {_TS} AS path, {_uniq("i")} AS imports, {_uniq("e")} AS exports, {_uniq("f")} AS functions, {_uniq("h")} AS hooks, {_uniq("v")} AS env_vars, n AS n_routes FROM x""",
    "js_symbols": f"""WITH {_ST}, n AS (SELECT *, 4 * (row_number() OVER (PARTITION BY repo_id, o {_O}) - 1) AS b FROM st), x AS (SELECT repo_id, o, 'h' || p AS name, 'function' AS type, b + 2 AS line FROM n UNION ALL SELECT repo_id, o, 'useT' || s, 'hook', b + 4 FROM n)
SELECT repo_id, {_TS} AS path, name, type, min(line)::INT AS line FROM x GROUP BY repo_id, o, name, type""",
    "js_usage": f"""WITH {_ST}, c AS (SELECT repo_id, o, 'h' || p AS c FROM st UNION SELECT repo_id, o, 'get' FROM st UNION SELECT repo_id, o, CASE s % 4 WHEN 2 THEN 'post' WHEN 3 THEN 'put' ELSE 'fetch' END FROM st), x AS (SELECT repo_id, o, list('./o' || p {_O}) AS i FROM st GROUP BY ALL),
  z AS (SELECT repo_id, o, list_sort(list(c)) AS calls FROM c GROUP BY ALL)
SELECT repo_id, {_TS} AS path, calls, []::VARCHAR[] AS constructs, []::VARCHAR[] AS bases, {_uniq("i")} AS internal_imports, []::VARCHAR[] AS external_imports FROM x JOIN z USING (repo_id, o)""",
    "js_api_surface": f"WITH {_ST} SELECT repo_id, {_TS} AS path, 'function' AS kind, 'h' || p AS name, sha256('|(x)') AS shape, count(*) AS n FROM st GROUP BY repo_id, o, p",
    "env_vars": f"WITH {_ST} SELECT DISTINCT repo_id, 'VAR_' || s AS name, {_PY} AS file FROM st WHERE k = 1 UNION SELECT DISTINCT repo_id, 'VAR_' || s, {_TS} FROM st",
    "http_calls": f"WITH {_ST}, n AS (SELECT *, 4 * (row_number() OVER (PARTITION BY repo_id, o {_O}) - 1) AS b FROM st) SELECT repo_id, {_TS} AS file, (b + 2)::INT AS line, {_VERB} AS method, {_CALL} AS path FROM n",
    "match_calls_to_routes": f"""WITH {_ST}, n AS (SELECT *, 4 * (row_number() OVER (PARTITION BY repo_id, o {_O}) - 1) AS b FROM st), r AS (SELECT repo_id, p, min((o, k)) AS ord FROM st GROUP BY ALL),
  m AS (SELECT n.repo_id, {_TS.replace("|| o ||", "|| n.o ||")} AS file, (b + 2)::INT AS line, {_VERB} AS method, {_CALL} AS called, r.p, r.ord FROM n JOIN r ON r.repo_id = n.repo_id AND starts_with({_CALL}, '/api/p' || r.p) AND (r.p % 2 = 1 OR s % 4 = 0) QUALIFY row_number() OVER (PARTITION BY n.repo_id, n.o, b ORDER BY r.ord) = 1)
SELECT repo_id, file, line, method, called, '/api/p' || p AS route, 'web/o' || ord[1] || '.ts' AS route_file FROM m""",
    "route_callers": f"WITH {_ST}, n AS (SELECT *, 4 * (row_number() OVER (PARTITION BY repo_id, o {_O}) - 1) AS b FROM st) SELECT repo_id, '/api/p' || s || '/x' AS route, {_TS} AS file, (b + 2)::INT AS line, {_VERB} AS method FROM n WHERE s % 4 <> 3 AND (repo_id, s) IN (SELECT (repo_id, p) FROM st)",
    "resolve_imports": f"WITH {_ST}, f AS (SELECT DISTINCT repo_id, o FROM st) SELECT DISTINCT st.repo_id, {_PY.replace('|| o ||', '|| st.o ||')} AS source, 'pkg.o' || p AS spec, 'pkg/o' || p || '.py' AS target FROM st JOIN f ON f.repo_id = st.repo_id AND f.o = p WHERE p <> st.o UNION SELECT DISTINCT st.repo_id, {_TS.replace('|| o ||', '|| st.o ||')}, CASE WHEN p % 2 = 0 THEN '@/o' ELSE './o' END || p, 'web/o' || p || '.ts' FROM st JOIN f ON f.repo_id = st.repo_id AND f.o = p WHERE p <> st.o",
    "relationships": f"""WITH {_ST}, f AS (SELECT DISTINCT repo_id, o FROM st), e AS (SELECT DISTINCT st.repo_id, st.o AS a, p AS b FROM st JOIN f ON f.repo_id = st.repo_id AND f.o = p WHERE p <> st.o)
SELECT repo_id, 'pkg/o' || a || '.py' AS source, 'pkg/o' || b || '.py' AS target, 'imports' AS relation, NULL::VARCHAR AS evidence FROM e
UNION ALL SELECT repo_id, 'pkg/o' || a || '.py', 'pkg/o' || b || '.py', 'executes', 'tmp' FROM e WHERE (repo_id, a) IN (SELECT (repo_id, o) FROM st WHERE q % 4 = 0) AND (repo_id, b) IN (SELECT (repo_id, o) FROM st WHERE q % 4 = 3)""",
    "build_edges": f"""WITH {_ST}, f AS (SELECT DISTINCT repo_id, o FROM st), e AS (SELECT DISTINCT st.repo_id, st.o AS a, p AS b FROM st JOIN f ON f.repo_id = st.repo_id AND f.o = p WHERE p <> st.o)
SELECT repo_id, 'pkg/o' || a || '.py' AS source, 'pkg/o' || b || '.py' AS target, 'imports' AS type, 0.95 AS confidence, 'Import statement: ''pkg.o' || b || '''' AS evidence FROM e
UNION ALL SELECT repo_id, 'web/o' || a || '.ts', 'web/o' || b || '.ts', CASE WHEN a % 10 = 0 AND b % 10 = 0 THEN 'renders' WHEN a % 10 = 0 THEN 'component -> service' ELSE 'imports' END, 0.95, 'Import statement: ''./o' || b || '''' FROM e""",
    "manifest_deps": with_views(f"WITH {_DEPS} SELECT repo_id, path, kind, name, value FROM dp", "manifests"),
    "nextjs_routes": """SELECT 'pack-' || floor(p_partkey / 4)::BIGINT AS repo_id, CASE WHEN p_partkey % 4 < 2 THEN 'src/app/api/u' || p_partkey || '/route.ts' ELSE 'pages/api/x' || p_partkey || '/index.js' END AS file, CASE WHEN p_partkey % 4 = 0 THEN 'POST' ELSE 'ALL' END AS method,
  CASE WHEN p_partkey % 4 < 2 THEN '/api/u' || p_partkey ELSE '/api/x' || p_partkey END AS path, CASE WHEN p_partkey % 4 = 0 THEN 'post' ELSE 'helper' END AS handler, 'nextjs' AS framework FROM part WHERE p_partkey % 4 < 3""",
    "prisma_models": "WITH x AS (SELECT 'pack-' || floor(p_partkey / 4)::BIGINT AS repo_id, 'db/s' || p_partkey || '.prisma' AS file, p_partkey AS p FROM part) SELECT repo_id, file, 'User' || p AS name, 'id:Int,name' || p || ':String' AS fields FROM x UNION ALL SELECT repo_id, file, 'B' || p, 'x:Y' FROM x",
    "ts_aliases": "WITH x AS (SELECT 'pack-' || floor(p_partkey / 4)::BIGINT AS repo_id, p_partkey AS p FROM part) SELECT repo_id, '@' || p || '/*' AS alias, 'src/*' AS target, 0 AS ord FROM x UNION ALL SELECT repo_id, 'lib', unnest(['a' || p, 'b']), unnest([0, 1]) FROM x",
}

QUERIES = {f.__name__: f for f in (python_outline, python_usage, python_function_metrics, python_findings, api_surface, structural_check, python_fallback, js_outline, js_symbols, js_usage, js_api_surface, env_vars, http_calls, match_calls_to_routes, route_callers, resolve_imports, relationships, build_edges, manifest_deps, nextjs_routes, prisma_models, ts_aliases, line_hunks, safe_rewrites)}
