"""Graph, classification and health queries over views of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolytics.operators import classify, graph, stack, technologies
from repolytics.plans.adapters import once, view, with_views
from repolytics.plans.sql import BINARY, EXT, LANGUAGE, NAME, ROLE, SENSITIVE, looked_up, quoted


def _edges(spark, sf):  # noqa: ANN001, ANN202
    return view(spark, sf, "edges")


def _files(spark, sf):  # noqa: ANN001, ANN202
    # Roles are judged once for each file of the tree.
    return once(spark, sf, "classified", lambda: classify.classify_files(view(spark, sf, "tree")))


def dependents(spark, sf):  # noqa: ANN001, ANN201
    return graph.dependents(_edges(spark, sf), view(spark, sf, "tree"))


def degree_metrics(spark, sf):  # noqa: ANN001, ANN201
    e = _edges(spark, sf)
    declared = e.select("repo_id", F.col("target").alias("source"), F.col("source").alias("target")).filter(F.col("source").startswith("lib"))
    return graph.degree_metrics(e, declared)


def fan_metrics(spark, sf):  # noqa: ANN001, ANN201
    return graph.fan_metrics(_edges(spark, sf), view(spark, sf, "tree"), 4)


def dependency_cycles(spark, sf):  # noqa: ANN001, ANN201
    return graph.dependency_cycles(_edges(spark, sf), view(spark, sf, "tree"))


def cycles_of_one_repository(spark, sf):  # noqa: ANN001, ANN201
    """All repositories as one, each a folder of it: more edges than one task takes."""

    def within(df, *columns):  # noqa: ANN001, ANN002, ANN202
        return df.select(F.lit("all").alias("repo_id"), *[F.concat_ws("/", "repo_id", c).alias(c) for c in columns])

    return graph.dependency_cycles(within(_edges(spark, sf), "source", "target"), within(view(spark, sf, "tree"), "path"))


def neighborhood(spark, sf):  # noqa: ANN001, ANN201
    return graph.neighborhood(_edges(spark, sf), view(spark, sf, "tree"), 2)


def subgraph_edges(spark, sf):  # noqa: ANN001, ANN201
    return graph.ego_edges(_edges(spark, sf), view(spark, sf, "tree"))


def relation_edges(spark, sf):  # noqa: ANN001, ANN201
    typed = _edges(spark, sf).withColumn("type", F.when(F.length("source") % 2 == 0, "calls").otherwise("imports"))
    return graph.ego_edges(typed, view(spark, sf, "tree"), relation="calls")


def classify_files(spark, sf):  # noqa: ANN001, ANN201
    return _files(spark, sf).select("repo_id", "path", "category", "language")


def map_layers(spark, sf):  # noqa: ANN001, ANN201
    return classify.map_layers(_files(spark, sf))


def layer_edges(spark, sf):  # noqa: ANN001, ANN201
    return graph.layer_edges(_edges(spark, sf), map_layers(spark, sf))


def _entries(spark, sf):  # noqa: ANN001, ANN202
    return view(spark, sf, "tree").filter(F.col("path").rlike(r"/f\d*0\."))


def _routes(spark, sf):  # noqa: ANN001, ANN202
    t = view(spark, sf, "tree").filter(F.col("path").startswith("src/api"))
    return t.select("repo_id", F.col("path").alias("file"), F.when(F.length("path") % 2 == 0, "GET").otherwise("POST").alias("method"), F.concat(F.lit("/"), F.substring_index("path", "/", -2)).alias("path"))


def _models(spark, sf):  # noqa: ANN001, ANN202
    t = view(spark, sf, "tree").filter(F.col("path").startswith("lib"))
    return t.select("repo_id", F.col("path").alias("file"), F.substring_index(F.substring_index("path", "/", -1), ".", 1).alias("name"))


def important_nodes(spark, sf):  # noqa: ANN001, ANN201
    return graph.important_nodes(_files(spark, sf), _edges(spark, sf), _entries(spark, sf), _routes(spark, sf), _models(spark, sf))


def graph_summary(spark, sf):  # noqa: ANN001, ANN201
    return graph.graph_summary(view(spark, sf, "tree"), _edges(spark, sf), map_layers(spark, sf), _entries(spark, sf), _routes(spark, sf), _models(spark, sf))


def folder_summary(spark, sf):  # noqa: ANN001, ANN201
    return classify.folder_summary(view(spark, sf, "tree"))


def directory_listing(spark, sf):  # noqa: ANN001, ANN201
    return classify.directory_listing(view(spark, sf, "tree"), 5)


def _texts(spark, sf):  # noqa: ANN001, ANN202
    return view(spark, sf, "contents").unionByName(view(spark, sf, "manifests"))


def _paths(spark, sf):  # noqa: ANN001, ANN202
    return view(spark, sf, "tree").unionByName(_texts(spark, sf).select("repo_id", "path"))


def detect_technologies(spark, sf):  # noqa: ANN001, ANN201
    return technologies.detect_technologies(_paths(spark, sf), _texts(spark, sf))


def detect_stack(spark, sf):  # noqa: ANN001, ANN201
    return stack.detect_stack(_paths(spark, sf), _texts(spark, sf))


def pick_key_files(spark, sf):  # noqa: ANN001, ANN201
    return stack.pick_key_files(_paths(spark, sf))


def detect_entry_points(spark, sf):  # noqa: ANN001, ANN201
    files = classify.classify_files(_paths(spark, sf))
    texts = files.select("repo_id", "path", F.when(F.length("path") % 3 == 0, "app.listen(1); createRoot(x)").when(F.length("path") % 3 == 1, "if __name__ == '__main__':").otherwise("x").alias("content"))
    return classify.detect_entry_points(files, texts)


def step_types(spark, sf):  # noqa: ANN001, ANN201
    n = F.length("path")
    symbol = F.when(n % 4 == 0, "handleClick").when(n % 4 == 1, "UserController").when(n % 4 == 2, "run")
    return _files(spark, sf).select("repo_id", "path", classify.step_type(F.col("path"), symbol, F.col("category"), n % 17 == 0, n % 19 == 0).alias("type"))


def detect_modules(spark, sf):  # noqa: ANN001, ANN201
    # Folders of the tree stand for module folders and manifests.
    t = view(spark, sf, "tree")
    return classify.detect_modules(t.withColumn("path", F.regexp_replace(F.regexp_replace("path", "^lib/", "packages/"), r"/f\d*5\.py$", "/pyproject.toml")))


_CAT = f"c AS (SELECT repo_id, path, {ROLE.format(p='path')} AS category, {LANGUAGE.format(p='path')} AS language FROM tree)"
_LAY = f"y AS (SELECT repo_id, {looked_up('category', classify.LAYERS, 'NULL')} AS layer, path FROM c WHERE category IN ({quoted(classify.LAYERS)}))"
_OK = f"i AS (SELECT DISTINCT e.repo_id, source, target FROM edges e JOIN tree a ON a.repo_id = e.repo_id AND a.path = source JOIN tree b ON b.repo_id = e.repo_id AND b.path = target WHERE NOT {SENSITIVE.format(p='source')} AND NOT {SENSITIVE.format(p='target')})"
_ALL = "txt AS (SELECT * FROM contents UNION ALL SELECT * FROM manifests), ap AS (SELECT repo_id, path FROM tree UNION ALL SELECT repo_id, path FROM txt)"


def _java(pattern: str) -> str:
    """A pattern as RE2 reads it, inside a string of SQL."""
    return pattern.replace("(?s)^(?=.*openai)(?=.*[cC][lL][iI][eE][nN][tT])", "openai").replace("'", "''")


def _technologies() -> str:
    """``sh``: what shows each technology of the rule table, after :data:`_ALL` and ``dp``, dependencies of manifests."""
    parts = []
    for name, _, rule in technologies.RULES:
        for kind, value in rule.items():
            if kind == "path":
                parts.append(f"SELECT repo_id, '{name}' AS name, 'path' AS kind, path AS value FROM ap WHERE regexp_matches(path, '{_java(value)}')")
            elif kind == "ext":
                parts.append(f"SELECT repo_id, '{name}', 'extension', {EXT.format(p='path')} FROM ap WHERE {EXT.format(p='path')} IN ({quoted(value.split())})")
            elif kind == "npm":
                parts.append(f"SELECT repo_id, '{name}', 'manifest', name FROM dp WHERE kind <> 'script' AND suffix(path, 'package.json') AND name IN ({quoted(value.split())})")
            elif kind == "py":
                parts.append(f"SELECT repo_id, '{name}', 'manifest', name FROM dp WHERE kind <> 'script' AND NOT suffix(path, 'package.json') AND name IN ({quoted(value.split())})")
            elif kind == "text":
                parts.append(f"SELECT repo_id, '{name}', 'text', path FROM txt WHERE regexp_matches(content, '{_java(value)}')")
            elif kind == "project":
                parts.append(f"SELECT repo_id, '{name}', 'manifest', path FROM txt WHERE regexp_matches(path, '(^|/)pyproject\\.toml$') AND regexp_matches(content, '{_java(value)}')")
    return "sh (repo_id, name, kind, value) AS (" + " UNION ALL ".join(parts) + ")"


#: Dependencies and scripts of the view of manifests.
_DEPS = """js AS (SELECT repo_id, path, content::JSON AS j FROM manifests WHERE suffix(path, 'package.json')),
  jd AS (SELECT repo_id, path, 'dependency' AS kind, unnest(json_keys(j, '$.dependencies')) AS name, '$.dependencies.' AS jp FROM js UNION ALL SELECT repo_id, path, 'dev_dependency', unnest(json_keys(j, '$.devDependencies')), '$.devDependencies.' FROM js UNION ALL SELECT repo_id, path, 'script', unnest(json_keys(j, '$.scripts')), '$.scripts.' FROM js),
  rq AS (SELECT repo_id, path, trim(unnest(string_split(content, chr(10)))) AS l FROM manifests WHERE suffix(path, 'requirements.txt')),
  dp AS (SELECT jd.repo_id, jd.path, kind, name, json_extract_string(j, jp || name) AS value FROM jd JOIN js USING (repo_id, path)
    UNION ALL SELECT repo_id, path, 'dependency', lower(regexp_extract(l, '^([A-Za-z0-9_.-]+)', 1)), regexp_extract(l, '^[A-Za-z0-9_.-]+\\s*(.*)$', 1) FROM rq WHERE l <> '' AND left(l, 1) NOT IN ('#', '-')
    UNION ALL SELECT DISTINCT repo_id, path, 'dependency', lower(unnest(regexp_extract_all(content, '(?m)^\\s*"([A-Za-z0-9_.-]+)[<>=!~"]', 1))), '' FROM manifests WHERE suffix(path, 'pyproject.toml'))"""
_WEAK = quoted([n for n, _, r in technologies.RULES if "text" in r and "npm" in r and "py" not in r and n != "Mongoose"])
_GROUP = "CASE " + " ".join(f"WHEN name IN ({quoted(g)}) THEN '{g[0]}'" for g in technologies.ONE_OF) + " ELSE name END"
_TURN = "CASE name " + " ".join(f"WHEN '{n}' THEN {i}" for g in technologies.ONE_OF for i, n in enumerate(g)) + " ELSE 0 END"


def _stack() -> str:
    """The stack list over ``ap`` and ``txt``."""
    chains = []
    for group in stack.GROUPS:
        whens = []
        for name, kind, listed, confidence, rule in group:
            conds = [f"list_contains(string_split(p, '/'), '{v}')" if k == "part" else f"regexp_matches({'p' if k == 'path' else 'nm'}, '{v}')" for k, v in rule.items() if k != "not"]
            cond = "(" + " OR ".join(conds) + ")" + (f" AND NOT regexp_matches(p, '{rule['not']}')" if "not" in rule else "")
            whens.append(f"WHEN {cond} THEN {{'technology': '{name}', 'kind': '{kind}', 'listed_as': '{listed}', 'confidence': '{confidence}'}}")
        chains.append("CASE " + " ".join(whens) + " END")
    texts = []
    for name, listed, pattern in stack.TEXTS:
        more = " AND regexp_matches(content, '(?i)client')" if "openai" in pattern else ""
        texts.append(f"SELECT repo_id, '{name}' AS technology, 'framework' AS kind, '{listed}' AS listed_as, 'high' AS confidence, path AS evidence, 1 AS r FROM txt WHERE regexp_matches(content, '{_java(pattern)}'){more}")
    return f"""pp AS (SELECT DISTINCT repo_id, lower(path) AS p, lower(string_split(path, '/')[-1]) AS nm FROM ap),
  sh AS (SELECT repo_id, p, unnest(list_filter([{", ".join(chains)}], lambda z: z IS NOT NULL)) AS t FROM pp),
  al AS (SELECT repo_id, t.technology AS technology, t.kind AS kind, t.listed_as AS listed_as, t.confidence AS confidence, p AS evidence, 0 AS r FROM sh UNION ALL {" UNION ALL ".join(texts)}),
  tl AS (SELECT repo_id, technology, arg_min(kind, (r, evidence)) AS kind, arg_min(listed_as, (r, evidence)) AS listed_as, arg_min(confidence, (r, evidence)) AS confidence, arg_min(evidence, (r, evidence)) AS evidence, 0 AS n FROM al GROUP BY ALL),
  lc AS (SELECT repo_id, {looked_up(EXT.format(p="p"), classify.MIX_LANGUAGES, "NULL")} AS technology FROM pp WHERE NOT regexp_matches(p, '{stack.IGNORED}')), ln AS (SELECT repo_id, technology, count(*) AS n FROM lc WHERE technology IS NOT NULL GROUP BY ALL),
  lk AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, technology) AS k FROM ln), un AS (SELECT * FROM tl UNION ALL SELECT repo_id, technology, 'language', technology, CASE WHEN k = 1 THEN 'high' WHEN k <= 4 THEN 'medium' END, n::VARCHAR, n FROM lk)
SELECT repo_id, technology, kind, listed_as, confidence, evidence, row_number() OVER (PARTITION BY repo_id ORDER BY list_position([{quoted(stack.KINDS)}], kind), n DESC, listed_as, technology) AS position FROM un"""


def _in(names, dirs: str = "pt") -> str:  # noqa: ANN001
    return f"list_has_any({dirs}, [{quoted(names)}])"


_MODULES = f"""mt AS (SELECT repo_id, string_split(path, '/') AS s FROM ap), mk AS (SELECT DISTINCT repo_id, lower(s[1]) AS top, s[2] AS child FROM mt WHERE len(s) >= 2 AND lower(s[1]) IN ({quoted(classify.MODULE_DIRS)})),
  mm AS (SELECT repo_id, array_to_string(s[:-2], '/') AS module, false AS l FROM mt WHERE len(s) >= 3 AND lower(s[-1]) IN ({quoted(classify.MODULE_MANIFESTS)}) UNION SELECT repo_id, top || '/' || child, true FROM mk WHERE (repo_id, top) IN (SELECT (repo_id, top) FROM mk GROUP BY ALL HAVING count(*) >= 2)),
  mo AS (SELECT repo_id, module, count(DISTINCT module) OVER (PARTITION BY repo_id) >= 2 OR bool_or(bool_or(l)) OVER (PARTITION BY repo_id) AS many FROM mm GROUP BY repo_id, module)"""
_KEY_FILES = f"""{_MODULES}, f0 AS (SELECT DISTINCT repo_id, path, lower(path) AS lo, string_split(lower(path), '/') AS pt, lower(string_split(path, '/')[-1]) AS nm FROM ap),
  f1 AS (SELECT f0.*, coalesce(g.many, false) AS many, m.module FROM f0 LEFT JOIN (SELECT repo_id, bool_or(many) AS many FROM mo GROUP BY 1) g USING (repo_id) LEFT JOIN (SELECT f0.repo_id, f0.path, min(module) AS module FROM f0 JOIN mo ON mo.repo_id = f0.repo_id AND (starts_with(f0.path, module || '/') OR f0.path = module) GROUP BY ALL) m ON m.repo_id = f0.repo_id AND m.path = f0.path
    WHERE NOT {SENSITIVE.format(p="f0.path")} AND NOT {BINARY.format(p="f0.path")} AND nm NOT IN ({quoted(stack.LOCKS)}) AND NOT {_in(stack.PASSED_DIRS)}),
  f2 AS (SELECT *, {_in(stack.CORE_DIRS, "pt[:-2]")} AS core FROM f1),
  f3 AS (SELECT repo_id, path, module, many, CASE WHEN nm IN ({quoted(stack.MODULE_POINTS)}) THEN {looked_up("nm", {k: str(v) for k, v in stack.MODULE_POINTS.items()}, "'0'")}::INT + CASE WHEN core THEN 5 ELSE 0 END
      WHEN nm IN ({quoted(stack.FACADES)}) THEN CASE WHEN core AND NOT contains(lo, 'test') THEN 14 ELSE 2 END WHEN nm IN ({quoted(stack.MANIFESTS)}) THEN {looked_up("nm", {k: str(v) for k, v in stack.MANIFESTS.items()}, "'0'")}::INT - CASE WHEN len(pt) = 1 THEN 0 ELSE 3 END
      WHEN nm = 'readme.md' THEN CASE WHEN len(pt) = 1 THEN 8 ELSE 2 END WHEN regexp_matches(lo, '{stack.SOURCES}') THEN 6 + CASE WHEN core THEN 4 ELSE 0 END ELSE 0 END
    - CASE WHEN {_in(("test", "tests"))} OR starts_with(nm, 'test_') OR regexp_matches(nm, '\\.(test|spec)\\.[jt]s$') THEN 15 ELSE 0 END - CASE WHEN {_in(("docs", "doc"))} THEN 10 ELSE 0 END - CASE WHEN contains(nm, '.min.') THEN 15 ELSE 0 END
    - CASE WHEN NOT many AND {_in(("example", "examples", "samples"))} THEN 10 ELSE 0 END + CASE WHEN many AND module IS NOT NULL THEN 3 ELSE 0 END - CASE WHEN nm IN ({quoted(stack.MINOR)}) THEN 6 ELSE 0 END AS score FROM f2),
  f4 AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, length(path), path) AS pos, many AND repo_id IN (SELECT repo_id FROM mo GROUP BY 1 HAVING count(*) >= 2) AS dealt FROM f3 WHERE score > 0),
  f5 AS (SELECT repo_id, path, score, (0, 0, '') AS turn FROM f4 WHERE dealt AND module IS NULL AND regexp_matches(path, '\\.(toml|json)$|readme\\.md$') QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY pos) = 1
    UNION ALL SELECT repo_id, path, score, (1, row_number() OVER (PARTITION BY repo_id, module ORDER BY pos), module) FROM f4 WHERE dealt AND module IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo_id, module ORDER BY pos) <= 3
    UNION ALL SELECT repo_id, path, score, (2, pos, '') FROM f4),
  f6 AS (SELECT repo_id, path, score, min(turn) AS turn FROM f5 GROUP BY ALL)
SELECT repo_id, path, score::INT AS score, row_number() OVER (PARTITION BY repo_id ORDER BY turn) AS position FROM f6 QUALIFY position <= 8"""
_FRONT = "(category = 'entrypoint' OR nm IN ('main.tsx', 'main.jsx', 'index.tsx', 'index.jsx', 'layout.tsx'))"
_STEP = """CASE WHEN length(path) % 17 = 0 THEN 'API_ROUTE' WHEN length(path) % 19 = 0 THEN 'ENTRY_POINT' WHEN regexp_matches(p, 'middleware|guard') THEN 'MIDDLEWARE' WHEN contains(p, 'controller') OR contains(sy, 'controller') THEN 'CONTROLLER'
  WHEN (category IN ('frontend-component', 'frontend-page') OR regexp_matches(p, '\\.[tj]sx$')) THEN CASE WHEN regexp_matches(sy, '^handle|click|submit') THEN 'EVENT_HANDLER' ELSE 'UI_COMPONENT' END WHEN category = 'backend-route' OR contains(p, 'route') THEN 'API_ROUTE'
  WHEN category = 'model' OR regexp_matches(p, 'model|schema|entity') THEN 'MODEL' WHEN category = 'database' OR regexp_matches(p, 'db|prisma|repository') THEN 'DATABASE'
  WHEN category = 'service' OR regexp_matches(p, 'service|manager') THEN CASE WHEN regexp_matches(p, 'api|client') THEN 'API_CLIENT' ELSE 'SERVICE' END WHEN category = 'utility' OR regexp_matches(p, 'util|helper') THEN 'UTILITY' WHEN contains(p, 'src') THEN 'SERVICE' ELSE 'UNKNOWN' END"""

SQL = {
    "dependents": with_views("SELECT e.repo_id, target AS path, list_sort(list(DISTINCT source)) AS dependents FROM edges e JOIN tree t ON t.repo_id = e.repo_id AND t.path = e.target GROUP BY ALL", "edges", "tree"),
    "degree_metrics": with_views(
        """WITH d AS (SELECT repo_id, path, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT repo_id, target AS path, 1 AS i, 0 AS o FROM edges UNION ALL SELECT repo_id, source, 0, 1 FROM edges) GROUP BY ALL),
  r AS (SELECT repo_id, target AS path, count(*) AS n FROM (SELECT repo_id, source, target FROM edges UNION SELECT repo_id, target, source FROM edges WHERE starts_with(target, 'lib')) GROUP BY ALL)
SELECT coalesce(d.repo_id, r.repo_id) AS repo_id, coalesce(d.path, r.path) AS path, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, coalesce(n, 0) AS reverse_dependents FROM d FULL JOIN r ON d.repo_id = r.repo_id AND d.path = r.path""",
        "edges"),
    "fan_metrics": with_views(f"WITH {_OK} SELECT repo_id, source AS path, count(*) AS count, 'high_fan_out' AS rule FROM i GROUP BY ALL HAVING count(*) >= 4 UNION ALL SELECT repo_id, target, count(*), 'high_fan_in' FROM i GROUP BY ALL HAVING count(*) >= 4", "edges", "tree"),
    "dependency_cycles": with_views(
        f"""WITH {_OK}, z AS (SELECT repo_id, source AS a, target AS b FROM i UNION SELECT z.repo_id, z.a, i.target FROM z JOIN i ON i.repo_id = z.repo_id AND i.source = z.b)
SELECT x.repo_id, min(y.a) AS component, x.a AS path FROM z x JOIN z y ON y.repo_id = x.repo_id AND y.a = x.b AND y.b = x.a WHERE x.a IN (SELECT a FROM z w WHERE w.repo_id = x.repo_id AND w.a = w.b) GROUP BY x.repo_id, x.a""",
        "edges", "tree").replace("WITH ", "WITH RECURSIVE ", 1),
    "neighborhood": with_views(
        """WITH l AS (SELECT repo_id, source AS a, target AS b FROM edges UNION SELECT repo_id, target, source FROM edges), o AS (SELECT t.repo_id, t.path AS file, t.path FROM tree t UNION SELECT t.repo_id, t.path, b FROM tree t JOIN l ON l.repo_id = t.repo_id AND l.a = t.path)
SELECT repo_id, file, path FROM o UNION SELECT o.repo_id, o.file, l.b FROM o JOIN l ON l.repo_id = o.repo_id AND l.a = o.path""",
        "edges", "tree"),
    "subgraph_edges": with_views(
        """WITH l AS (SELECT repo_id, source AS a, target AS b FROM edges UNION SELECT repo_id, target, source FROM edges), t AS (SELECT * FROM tree), o AS (SELECT t.repo_id, t.path AS file, t.path FROM t UNION SELECT t.repo_id, t.path, b FROM t JOIN l ON l.repo_id = t.repo_id AND l.a = t.path)
SELECT e.repo_id, x.file, source, target FROM edges e JOIN o x ON x.repo_id = e.repo_id AND x.path = source JOIN o y ON y.repo_id = e.repo_id AND y.path = target AND y.file = x.file""",
        "edges", "tree"),
    "classify_files": with_views(f"WITH {_CAT} SELECT * FROM c", "tree"),
    "map_layers": with_views(f"WITH {_CAT}, {_LAY} SELECT * FROM y", "tree"),
    "layer_edges": with_views(f"WITH {_CAT}, {_LAY} SELECT e.repo_id, a.layer AS source_layer, b.layer AS target_layer, count(*) AS edges FROM edges e JOIN y a ON a.repo_id = e.repo_id AND a.path = source JOIN y b ON b.repo_id = e.repo_id AND b.path = target WHERE a.layer <> b.layer GROUP BY ALL", "edges", "tree"),
    "important_nodes": with_views(
        f"""WITH {_CAT}, p AS (SELECT repo_id, source AS path, 3 AS p FROM edges UNION ALL SELECT repo_id, target, 3 FROM edges UNION ALL SELECT repo_id, path, 50 FROM tree WHERE regexp_matches(path, '/f\\d*0\\.') UNION ALL SELECT repo_id, path, 30 FROM tree WHERE starts_with(path, 'src/api') UNION ALL SELECT repo_id, path, 30 FROM tree WHERE starts_with(path, 'lib') UNION ALL SELECT repo_id, path, 20 FROM c WHERE category IN ('service', 'controller', 'model', 'backend-route')),
  s AS (SELECT repo_id, path, sum(p)::BIGINT AS points FROM p GROUP BY ALL)
SELECT t.repo_id, t.path, coalesce(points, 0) AS points FROM tree t LEFT JOIN s USING (repo_id, path) QUALIFY row_number() OVER (PARTITION BY t.repo_id ORDER BY coalesce(points, 0) DESC, t.path) <= 80""",
        "edges", "tree"),
    "graph_summary": with_views(
        f"""WITH {_CAT}, {_LAY}, n AS (SELECT repo_id, count(*) AS files, count(*) FILTER (WHERE regexp_matches(path, '/f\\d*0\\.')) AS entry_points, count(*) FILTER (WHERE starts_with(path, 'src/api')) AS routes, count(*) FILTER (WHERE starts_with(path, 'lib')) AS data_models FROM tree GROUP BY 1)
SELECT n.*, coalesce(edges, 0) AS edges, coalesce(layers, 0) AS layers FROM n LEFT JOIN (SELECT repo_id, count(*) AS edges FROM edges GROUP BY 1) USING (repo_id) LEFT JOIN (SELECT repo_id, count(DISTINCT layer) AS layers FROM y GROUP BY 1) USING (repo_id)""",
        "edges", "tree"),
    "relation_edges": with_views(
        """WITH l AS (SELECT repo_id, source AS a, target AS b FROM edges UNION SELECT repo_id, target, source FROM edges), t AS (SELECT * FROM tree), o AS (SELECT t.repo_id, t.path AS file, t.path FROM t UNION SELECT t.repo_id, t.path, b FROM t JOIN l ON l.repo_id = t.repo_id AND l.a = t.path)
SELECT e.repo_id, x.file, source, target FROM edges e JOIN o x ON x.repo_id = e.repo_id AND x.path = source JOIN o y ON y.repo_id = e.repo_id AND y.path = target AND y.file = x.file WHERE length(source) % 2 = 0""",
        "edges", "tree"),
    "detect_technologies": with_views(
        f"""WITH {_ALL}, {_DEPS}, {_technologies()}, b AS (SELECT repo_id, name, min((kind, value)) AS e, bool_and(kind = 'text') AS text_only, {_GROUP} AS g, {_TURN} AS r FROM sh GROUP BY repo_id, name)
SELECT repo_id, name, {looked_up("name", {n: c for n, c, _ in technologies.RULES}, "NULL")} AS category, CASE WHEN name IN ({_WEAK}) AND text_only THEN 'medium' ELSE 'high' END AS confidence, e[1] || ': ' || e[2] AS evidence FROM b QUALIFY row_number() OVER (PARTITION BY repo_id, g ORDER BY r, name) = 1""",
        "tree", "contents", "manifests"),
    "detect_stack": with_views(f"WITH {_ALL}, {_stack()}", "tree", "contents", "manifests"),
    "pick_key_files": with_views(f"WITH {_ALL}, {_KEY_FILES}", "tree", "contents", "manifests"),
    "detect_entry_points": with_views(
        f"""WITH {_ALL}, x AS (SELECT repo_id, path, {ROLE.format(p="path")} AS category, {LANGUAGE.format(p="path")} AS language, {NAME.format(p="path")} AS nm, length(path) % 3 AS n FROM ap),
  z AS (SELECT repo_id, path, CASE WHEN language = 'Python' AND n = 1 THEN ('cli/service', 0.95::DOUBLE) WHEN language = 'Python' AND nm IN ('main.py', 'app.py', 'manage.py', 'wsgi.py') THEN ('web-backend', 0.9::DOUBLE) WHEN {_FRONT} AND n = 0 THEN ('web-frontend', 0.95::DOUBLE)
    WHEN {_FRONT} AND regexp_matches(path, 'layout\\.[tj]sx') THEN ('web-frontend', 0.9::DOUBLE) WHEN category = 'entrypoint' THEN ('entrypoint', 0.85::DOUBLE) WHEN language IN ('JavaScript', 'TypeScript') AND nm IN ('server.js', 'server.ts', 'index.js', 'index.ts', 'app.js', 'app.ts') AND n = 0 THEN ('web-backend', 0.95::DOUBLE) END AS f FROM x)
SELECT repo_id, path, f[1] AS type, f[2] AS confidence FROM z WHERE f IS NOT NULL""",
        "tree", "contents", "manifests"),
    "step_types": with_views(f"WITH {_CAT}, x AS (SELECT *, lower(path) AS p, coalesce(CASE length(path) % 4 WHEN 0 THEN 'handleclick' WHEN 1 THEN 'usercontroller' WHEN 2 THEN 'run' END, '') AS sy FROM c) SELECT repo_id, path, {_STEP} AS type FROM x", "tree"),
    "detect_modules": with_views(
        r"""WITH t AS (SELECT repo_id, string_split(regexp_replace(regexp_replace(path, '^lib/', 'packages/'), '/f\d*5\.py$', '/pyproject.toml'), '/') AS s FROM tree),
  m AS (SELECT repo_id, array_to_string(s[:-2], '/') AS module, false AS l FROM t WHERE len(s) >= 3 AND s[-1] IN ('pyproject.toml', 'package.json') UNION SELECT repo_id, 'packages/' || s[2], true FROM t WHERE s[1] = 'packages' AND repo_id IN (SELECT repo_id FROM t WHERE s[1] = 'packages' GROUP BY 1 HAVING count(DISTINCT s[2]) >= 2))
SELECT repo_id, module, count(DISTINCT module) OVER (PARTITION BY repo_id) >= 2 OR bool_or(bool_or(l)) OVER (PARTITION BY repo_id) AS is_multi_module FROM m GROUP BY repo_id, module""",
        "tree"),
    "folder_summary": with_views("SELECT repo_id, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '.' END AS folder, count(*) AS files, list_sort(list(path))[1:100] AS paths FROM tree GROUP BY ALL", "tree"),
    "directory_listing": with_views("SELECT repo_id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS directory, list_sort(list(DISTINCT regexp_extract(path, '[^/]*$')))[1:5] AS children FROM tree GROUP BY ALL", "tree"),
}

SQL["cycles_of_one_repository"] = f"SELECT 'all' AS repo_id, repo_id || '/' || component AS component, repo_id || '/' || path AS path FROM ({SQL['dependency_cycles']})"

QUERIES = {f.__name__: f for f in (dependents, degree_metrics, fan_metrics, dependency_cycles, cycles_of_one_repository, neighborhood, subgraph_edges, relation_edges, classify_files, map_layers, layer_edges, important_nodes, graph_summary, detect_technologies, detect_stack, pick_key_files, detect_entry_points, step_types, detect_modules, folder_summary, directory_listing)}
