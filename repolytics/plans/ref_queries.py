"""Reference and retrieval queries over views of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolytics.operators import extract, refs, retrieval
from repolytics.plans import code_queries as c
from repolytics.plans import graph_queries as g
from repolytics.plans.adapters import once, view, with_views
from repolytics.plans.sql import BINARY, SENSITIVE


def _symbols(spark, sf):  # noqa: ANN001, ANN202
    """The first word of every line stands for a symbol of its repository, if of five letters or more."""
    lines = view(spark, sf, "contents").select("repo_id", F.col("path").alias("file"), F.explode(F.split("content", "\n")).alias("line"))
    rows = lines.select("repo_id", F.regexp_extract("line", r"^([A-Za-z_][A-Za-z0-9_]*)", 1).alias("name"), "file")
    return rows.filter(F.length("name") >= 5).distinct()


def symbol_references(spark, sf):  # noqa: ANN001, ANN201
    # Every other symbol also stands in quotes at the end of its text.
    t = view(spark, sf, "contents")
    name = F.regexp_extract("content", r"^([A-Za-z_][A-Za-z0-9_]*)", 1)
    t = t.withColumn("content", F.when(F.length(name) % 2 == 0, F.concat("content", F.lit("\nx = '"), name, F.lit(" z'"))).otherwise(F.col("content")))
    return refs.symbol_references(t, _symbols(spark, sf)).select("repo_id", "name", "path", "line", "in_string", F.md5("evidence").alias("evidence"))


def symbol_mentions(spark, sf):  # noqa: ANN001, ANN201
    return refs.symbol_mentions(view(spark, sf, "contents"), _symbols(spark, sf))


def unresolved_targets(spark, sf):  # noqa: ANN001, ANN201
    s = _symbols(spark, sf)
    return refs.unresolved_targets(s, s)


def _package_files(spark, sf):  # noqa: ANN001, ANN202
    """Manifests, and a source for each part that names its package in several ways."""
    p = F.col("p_partkey")
    path = F.when(p % 3 == 0, F.format_string("src/client%d.ts", p)).when(p % 3 == 1, F.format_string("src/u%d.ts", p)).otherwise(F.format_string("pkg/u%d.go", p))
    text = F.format_string("import x from '@Org/p%d'\nconst y = require(\"p%d\")\n\t\"github.com/acme/p%d/v2\"\n// p%d-extra and xp%d are others\nReact.x or react\nEXPRESS!", p, p, p, p, p)
    used = spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("pack-"), F.floor(p / 4).cast("string")).alias("repo_id"), path.alias("path"), text.alias("content"))
    return view(spark, sf, "manifests").unionByName(used)


def dependency_usage(spark, sf):  # noqa: ANN001, ANN201
    """Every dependency of the manifests, as it stands, scoped, and as a module's address."""
    names = extract.extract_manifest_deps(view(spark, sf, "manifests")).filter(F.col("kind").isin("dependency", "dev_dependency")).select("repo_id", "name").distinct()
    packages = names.select("repo_id", F.explode(F.array("name", F.concat(F.lit("@org/"), "name"), F.concat(F.lit("github.com/acme/"), "name"))).alias("package"))
    return refs.dependency_usage(_package_files(spark, sf), packages, view(spark, sf, "manifests").select("repo_id", "path"))


def move_references(spark, sf):  # noqa: ANN001, ANN201
    """Every script is moved; others name it by path, in a barrel or in a configuration.  So are a dynamic route, a name with a space, and a file of the root."""
    files = c.script_files(spark, sf)
    o = F.regexp_extract("path", r"o(\d+)", 1)
    more = files.select("repo_id", F.when(o.cast("long") % 3 == 0, F.format_string("m%s/index.ts", o)).when(o.cast("long") % 3 == 1, F.format_string("m%s/package.json", o)).otherwise(F.format_string("m%s/x.md", o)).alias("path"), F.concat(F.lit("first\nexport web "), "path", F.lit(" here")).alias("content"))
    docs = files.select("repo_id", F.format_string("docs/d%s.txt", o).alias("path"), F.format_string("see pages/[o%s].tsx, src/a b%s.ts or xN%s.mdx\nnot pages/o%s.tsx", o, o, o, o).alias("content"))
    odd = files.select("repo_id", F.explode(F.array(F.format_string("pages/[o%s].tsx", o), F.format_string("src/a b%s.ts", o), F.format_string("N%s.md", o))).alias("target"))
    return refs.move_references(files.unionByName(more).unionByName(docs), files.select("repo_id", F.col("path").alias("target")).unionByName(odd))


def rewrite_imports(spark, sf):  # noqa: ANN001, ANN201
    files = c.python_files(spark, sf).withColumn("content", F.regexp_replace("content", r"import (pkg\.o\d+)", "from $1 import x"))
    mapping = files.select("repo_id", F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".").alias("old")).withColumn("new", F.concat(F.lit("new."), "old"))
    return refs.rewrite_imports(files, mapping)[0].select("repo_id", "path", F.md5("content").alias("digest"), F.regexp_count("content", F.lit(r"from new\.pkg\.")).cast("long").alias("rewritten"))


def import_conflicts(spark, sf):  # noqa: ANN001, ANN201
    files = c.python_files(spark, sf)
    mapping = files.select("repo_id", F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".").alias("old")).withColumn("new", F.concat(F.lit("new."), "old"))
    return refs.rewrite_imports(files, mapping)[1]


def public_api_factors(spark, sf):  # noqa: ANN001, ANN201
    tree = view(spark, sf, "tree").withColumn("exports", F.when(F.length("path") % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    return refs.public_api_factors(tree, g._routes(spark, sf), g._models(spark, sf), g._entries(spark, sf))


def affected_files(spark, sf):  # noqa: ANN001, ANN201
    e = view(spark, sf, "edges")
    return refs.affected_files(e.select("repo_id", F.col("target"), F.col("source").alias("path")), e.select("repo_id", "target", F.col("target").alias("path")), tree=view(spark, sf, "tree"))


def plan_risk(spark, sf):  # noqa: ANN001, ANN201
    n = F.length("path")
    t = g._files(spark, sf).select(
        "repo_id", F.col("path").alias("target"), F.when(n % 7 == 0, "api_migration").when(n % 5 == 0, "rename_symbol").otherwise("split_module").alias("plan_type"), "category", (n % 4).alias("exports"), F.col("path").endswith("0.py").alias("entry"),
        F.col("path").startswith("src/api").alias("route"), F.col("path").startswith("lib").alias("model"), (n % 6).alias("direct"), (n % 2).alias("cycles"), (n % 3).alias("tests"), (n % 8 > 0).alias("has_content"), (n % 2).alias("references"), (n % 9 > 0).alias("has_impact"),
    )
    return refs.plan_risk(t)


def partition_symbols(spark, sf):  # noqa: ANN001, ANN201
    s = c.script_symbols(spark, sf)
    known = s.filter("type = 'function'").withColumn("n", F.length("name") % 3)
    models = known.filter("n = 0").select("repo_id", F.col("path").alias("file"), "name")
    routes = known.filter("n = 1").select("repo_id", F.col("path").alias("file"), F.col("name").alias("handler"))
    return refs.partition_symbols(s.withColumn("type", F.when(F.col("type") == "hook", "component").otherwise(F.col("type"))), models, routes)


def part_edges(spark, sf):  # noqa: ANN001, ANN201
    # Parts meet themselves four times: they are worked out once.
    parts = once(spark, sf, "parts", lambda: partition_symbols(spark, sf))
    names = parts.select("repo_id", "path", "name")
    calls = names.withColumnRenamed("name", "caller").join(names.withColumnRenamed("name", "callee"), ["repo_id", "path"]).filter((F.length("callee") + F.length("caller")) % 2 == 1)
    return refs.part_edges(parts, calls)


def _questions(spark, sf):  # noqa: ANN001, ANN202
    """Turns of users; each ends with a phrase, and many name a file of their repository."""

    def make():  # noqa: ANN202
        t = spark.read.parquet(f"{sf}/conversations.parquet").filter("role = 'user'")
        tail = F.element_at(F.array(*[F.lit(x) for x in TAILS]), (F.col("conv_id") % len(TAILS) + 1).cast("int"))
        q = t.select(F.concat(F.lit("repo-"), F.col("conv_id").cast("string")).alias("repo_id"), F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.concat(F.coalesce("text", F.lit("")), tail).alias("text"), "turn")
        name = F.when(F.col("path").rlike("/f[0-9]+[.]"), F.col("path"))
        named = view(spark, sf, "tree").groupBy("repo_id").agg(F.min(name).alias("a"), F.max(name).alias("b"))
        q = q.join(named, "repo_id", "left").withColumn("p", F.when(F.col("turn") % 4 == 0, F.col("a")).otherwise(F.col("b")))
        word = F.when(F.col("turn") % 3 == 0, F.substring_index("p", "/", -1)).when(F.col("turn") % 3 == 1, F.concat(F.lit("/"), F.substring_index("p", "/", -2))).otherwise(F.regexp_extract("p", r"/(f\d+)\.", 1))
        return q.select("repo_id", "question_id", F.concat_ws(" ", "text", word).alias("text"))

    return once(spark, sf, "questions", make)


def _tree_symbols(spark, sf):  # noqa: ANN001, ANN202
    return view(spark, sf, "tree").select("repo_id", F.regexp_extract("path", r"/(f\d+)\.", 1).alias("name"), F.col("path").alias("file")).filter(F.col("name").endswith("3"))


def classify_questions(spark, sf):  # noqa: ANN001, ANN201
    q = retrieval.classify_questions(_questions(spark, sf), view(spark, sf, "tree"), _tree_symbols(spark, sf), g._routes(spark, sf), g._models(spark, sf))
    return q.select("repo_id", "question_id", "intent")


def _ranked(spark, sf):  # noqa: ANN001, ANN202
    def make():  # noqa: ANN202
        q = _questions(spark, sf)
        first = view(spark, sf, "tree").groupBy("repo_id").agg(F.max("path").alias("a"), F.min("path").alias("b"))
        ends = F.array(F.struct(F.col("a").alias("path"), F.lit("scope").alias("kind")), F.struct(F.col("b").alias("path"), F.lit("edge").alias("kind")))
        scopes = q.join(first, "repo_id").filter(F.length("question_id") % 2 == 0).select("repo_id", "question_id", F.explode(ends).alias("x")).select("repo_id", "question_id", "x.path", "x.kind")
        return retrieval.rank_relevant_files(q, g._files(spark, sf), view(spark, sf, "edges"), _tree_symbols(spark, sf), g._entries(spark, sf), routes=g._routes(spark, sf), models=g._models(spark, sf), scopes=scopes)

    return once(spark, sf, "ranked", make)


def rank_relevant_files(spark, sf):  # noqa: ANN001, ANN201
    return _ranked(spark, sf)


def budgeted_excerpts(spark, sf):  # noqa: ANN001, ANN201
    # Texts of ranked files are made of their paths; every third holds a secret.
    ranked = _ranked(spark, sf)
    n = F.length("path")
    text = F.concat(F.repeat(F.concat("path", F.lit(" ")), (n * 11).cast("int")), F.when(n % 3 == 0, "password = 'verysecret'").otherwise(""))
    t = ranked.select("repo_id", "path").distinct().select("repo_id", "path", text.alias("content"))
    return retrieval.budgeted_excerpts(ranked, t).select("repo_id", "question_id", "position", "path", F.length("excerpt").cast("long").alias("n"), F.md5("excerpt").alias("digest"))


def evidence_pack(spark, sf):  # noqa: ANN001, ANN201
    out = retrieval.evidence_pack(classify_questions(spark, sf), _ranked(spark, sf), view(spark, sf, "edges"), g._routes(spark, sf), g._models(spark, sf))

    def joined(column: str, *fields: str):  # noqa: ANN202
        return F.array_join(F.transform(column, lambda x: F.concat_ws("|", *[x[f].cast("string") for f in fields])), ",").alias(column)

    return out.select("repo_id", "question_id", "intent", joined("files", "path", "score"), joined("edges", "source", "target"), joined("routes", "method", "route"), F.array_join("models", ",").alias("models"))


_SYM = "ln AS (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS t, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS k FROM contents), sym AS (SELECT DISTINCT repo_id, regexp_extract(t, '^([A-Za-z_][A-Za-z0-9_]*)', 1) AS name FROM ln WHERE length(regexp_extract(t, '^([A-Za-z_][A-Za-z0-9_]*)', 1)) >= 5)"
TAILS = (" what uses this", " list api routes in", " database schema", " how to run it", " overview", "", " the", " languages")
_QS = rf"""nq AS (SELECT repo_id, min(CASE WHEN regexp_matches(path, '/f[0-9]+[.]') THEN path END) AS a, max(CASE WHEN regexp_matches(path, '/f[0-9]+[.]') THEN path END) AS b FROM tree GROUP BY 1),
  q1 AS (SELECT 'repo-' || conv_id AS repo_id, conv_id || '-' || turn AS question_id, coalesce("text", '') || [{", ".join("'" + t + "'" for t in TAILS)}][conv_id % {len(TAILS)} + 1] AS tx, turn FROM conversations WHERE role = 'user'),
  q2 AS (SELECT q1.*, CASE WHEN turn % 4 = 0 THEN a ELSE b END AS p FROM q1 LEFT JOIN nq USING (repo_id)),
  q AS (SELECT repo_id, question_id, concat_ws(' ', tx, CASE turn % 3 WHEN 0 THEN string_split(p, '/')[-1] WHEN 1 THEN '/' || string_split(p, '/')[-2] || '/' || string_split(p, '/')[-1] ELSE regexp_extract(p, '/(f\d+)\.', 1) END) AS text FROM q2)"""
_RO = "ro AS (SELECT repo_id, path AS file, CASE WHEN length(path) % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/' || string_split(path, '/')[-2] || '/' || string_split(path, '/')[-1] AS route FROM tree WHERE starts_with(path, 'src/api'))"
_MO = "mo AS (SELECT repo_id, path AS file, string_split(string_split(path, '/')[-1], '.')[1] AS name FROM tree WHERE starts_with(path, 'lib'))"
_TS = r"ts AS (SELECT repo_id, regexp_extract(path, '/(f\d+)\.', 1) AS name, path AS file FROM tree WHERE suffix(regexp_extract(path, '/(f\d+)\.', 1), '3'))"
_WORDS = r"wd AS (SELECT DISTINCT repo_id, question_id, unnest(regexp_extract_all(text, '\w+')) AS w FROM q), tk AS (SELECT DISTINCT repo_id, question_id, unnest(regexp_extract_all(lower(text), '\w+')) AS w FROM q), pw AS (SELECT DISTINCT repo_id, question_id, regexp_replace(unnest(regexp_extract_all(text, '[\w./\\-]+')), '^[./-]+|[./-]+$', '', 'g') AS w FROM q)"
_MENTION = f"""{_QS}, {_RO}, {_MO}, {_TS}, {_WORDS}, me AS (SELECT pw.repo_id, question_id, t.path, 'file' AS kind FROM pw JOIN tree t ON t.repo_id = pw.repo_id AND (lower(string_split(t.path, '/')[-1]) = lower(w) OR t.path = w)
  UNION SELECT wd.repo_id, question_id, file, 'symbol' FROM wd JOIN ts ON ts.repo_id = wd.repo_id AND ts.name = w WHERE length(w) >= 3 UNION SELECT q.repo_id, question_id, file, 'route' FROM q JOIN ro ON ro.repo_id = q.repo_id AND contains(lower(text), lower(route))
  UNION SELECT wd.repo_id, question_id, file, 'model' FROM wd JOIN mo ON mo.repo_id = wd.repo_id AND lower(mo.name) = lower(w) WHERE length(w) >= 3)"""


def _cases() -> str:
    """The intent of a question by its text and what it names."""
    named = {"API_ROUTE": "route", "DATABASE": "model"}
    whens = []
    for name, pattern in retrieval.INTENTS:
        more = f" OR coalesce(list_contains(kinds, '{named[name]}'), false)" if name in named else ""
        whens.append(f"WHEN regexp_matches(text, '{pattern}'){more} THEN '{name}'")
    return "CASE " + " ".join(whens) + " WHEN kinds IS NOT NULL THEN 'FILE_LOOKUP' ELSE 'GENERAL_REPO' END"


_INTENT = f"{_MENTION}, it AS (SELECT q.repo_id, q.question_id, text, {_cases()} AS intent FROM q LEFT JOIN (SELECT repo_id, question_id, list(DISTINCT kind) AS kinds FROM me GROUP BY ALL) USING (repo_id, question_id))"
_P = retrieval.POINTS
_RANK = f"""{g._CAT}, {_INTENT}, en AS (SELECT * FROM tree WHERE regexp_matches(path, '/f\\d*0\\.')), bn AS (SELECT repo_id, path, regexp_replace(lower(string_split(path, '/')[-1]), '(.)\\.[^.]*$', '\\1') AS w FROM tree), ex AS (SELECT repo_id, max(path) AS a, min(path) AS b FROM tree GROUP BY 1),
  sc AS (SELECT q.repo_id, question_id, a AS path, 'scope' AS kind FROM q JOIN ex USING (repo_id) WHERE length(question_id) % 2 = 0 UNION ALL SELECT q.repo_id, question_id, b, 'edge' FROM q JOIN ex USING (repo_id) WHERE length(question_id) % 2 = 0),
  ra AS (SELECT q.repo_id, q.question_id, file, route FROM q JOIN ro USING (repo_id) WHERE contains(lower(text), lower(route)) UNION SELECT tk.repo_id, question_id, file, route FROM tk JOIN ro ON ro.repo_id = tk.repo_id AND length(w) > 3 AND contains(lower(route), w)),
  ev AS (SELECT DISTINCT repo_id, question_id, path, {_P["mention"]} AS points, 'm' AS why FROM me UNION ALL SELECT tk.repo_id, question_id, path, {_P["base_name"]}, 'b' FROM tk JOIN bn USING (repo_id, w) WHERE length(w) > 2
    UNION ALL SELECT q.repo_id, q.question_id, file, {_P["symbol"]}, 's' FROM q JOIN ts USING (repo_id) WHERE contains(lower(text), lower(name)) AND (length(name) >= 4 OR (q.repo_id, question_id, lower(name)) IN (SELECT (repo_id, question_id, w) FROM tk))
    UNION ALL SELECT repo_id, question_id, file, {_P["route"]}, 'r' FROM ra
    UNION ALL SELECT q.repo_id, q.question_id, file, {_P["model"]}, 'd' FROM q JOIN mo USING (repo_id) WHERE (length(name) >= 3 AND contains(lower(text), lower(name))) OR (q.repo_id, question_id, lower(name)) IN (SELECT (repo_id, question_id, w) FROM tk)
    UNION ALL SELECT repo_id, question_id, path, CASE kind WHEN 'scope' THEN {_P["scope"] + _P["mention"]} ELSE {_P["edge"]} END, 'c' FROM sc
    UNION ALL SELECT it.repo_id, question_id, path, {_P["role"]}, 'o' FROM it JOIN c USING (repo_id) WHERE (intent = 'API_ROUTE' AND contains(category, 'route')) OR (intent = 'DATABASE' AND regexp_matches(category, 'model|database')) OR (intent = 'ENTRY_POINT' AND contains(category, 'entrypoint'))),
  ow AS (SELECT repo_id, question_id, path, sum(points) AS points FROM ev SEMI JOIN tree USING (repo_id, path) GROUP BY ALL), sd AS (SELECT * FROM ow QUALIFY row_number() OVER (PARTITION BY repo_id, question_id ORDER BY points DESC, path) <= 3),
  al AS (SELECT * FROM ow UNION ALL SELECT sd.repo_id, question_id, target, {_P["dependency"]} FROM sd JOIN (SELECT DISTINCT repo_id, source, target FROM edges) e ON e.repo_id = sd.repo_id AND e.source = sd.path UNION ALL SELECT sd.repo_id, question_id, source, {_P["dependent"]} FROM sd JOIN (SELECT DISTINCT repo_id, source, target FROM edges) e ON e.repo_id = sd.repo_id AND e.target = sd.path),
  su AS (SELECT repo_id, question_id, path, sum(points)::BIGINT AS score FROM al SEMI JOIN tree USING (repo_id, path) GROUP BY ALL), e6 AS (SELECT * FROM en QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY path) <= 6), f6 AS (SELECT * FROM tree QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY path) <= 6),
  fi AS (SELECT * FROM su UNION ALL SELECT q.repo_id, question_id, path, {_P["entry"]} FROM q JOIN e6 USING (repo_id) WHERE (q.repo_id, question_id) NOT IN (SELECT (repo_id, question_id) FROM su)
    UNION ALL SELECT q.repo_id, question_id, path, {_P["first"]} FROM q JOIN f6 USING (repo_id) WHERE (q.repo_id, question_id) NOT IN (SELECT (repo_id, question_id) FROM su) AND q.repo_id NOT IN (SELECT repo_id FROM en)),
  rk AS (SELECT *, row_number() OVER (PARTITION BY repo_id, question_id ORDER BY score DESC, path) AS position FROM fi QUALIFY position <= 6)"""

SQL = {
    "symbol_references": with_views(
        f"""WITH {_SYM}, c2 AS (SELECT repo_id, path, content || CASE WHEN length(regexp_extract(content, '^([A-Za-z_][A-Za-z0-9_]*)', 1)) % 2 = 0 THEN chr(10) || 'x = ' || chr(39) || regexp_extract(content, '^([A-Za-z_][A-Za-z0-9_]*)', 1) || ' z' || chr(39) ELSE '' END AS content FROM contents),
  l2 AS (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS t, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS k FROM c2), x AS (SELECT DISTINCT l2.*, unnest(regexp_extract_all(t, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM l2)
SELECT DISTINCT x.repo_id, x.name, path, k::INT AS line, len(list_filter(regexp_extract_all(t, '[''"][^''"]*[''"]'), lambda z: contains(z, x.name))) > 0 AS in_string, md5(left(trim(t), 160)) AS evidence FROM x JOIN sym USING (repo_id, name)""",
        "contents"),
    "symbol_mentions": with_views(f"WITH {_SYM} SELECT DISTINCT ln.repo_id, path AS file, name FROM (SELECT *, unnest(list_distinct(regexp_extract_all(t, '[A-Za-z_][A-Za-z0-9_]*'))) AS name FROM ln) ln JOIN sym USING (repo_id, name)", "contents"),
    "unresolved_targets": with_views("SELECT repo_id, name, count(DISTINCT path) AS files FROM (SELECT repo_id, path, regexp_extract(unnest(string_split(content, chr(10))), '^([A-Za-z_][A-Za-z0-9_]*)', 1) AS name FROM contents) WHERE length(name) >= 5 GROUP BY ALL HAVING count(DISTINCT path) <> 1", "contents"),
    "dependency_usage": with_views(
        f"""WITH {g._DEPS}, nm AS (SELECT DISTINCT repo_id, name FROM dp WHERE kind <> 'script'), pk AS (SELECT repo_id, unnest([name, '@org/' || name, 'github.com/acme/' || name]) AS package FROM nm),
  fl AS (SELECT repo_id, path, content, true AS man FROM manifests UNION ALL SELECT 'pack-' || floor(p_partkey / 4)::BIGINT, CASE p_partkey % 3 WHEN 0 THEN 'src/client' || p_partkey || '.ts' WHEN 1 THEN 'src/u' || p_partkey || '.ts' ELSE 'pkg/u' || p_partkey || '.go' END,
    'import x from ''@Org/p' || p_partkey || '''' || chr(10) || 'const y = require("p' || p_partkey || '")' || chr(10) || chr(9) || '"github.com/acme/p' || p_partkey || '/v2"' || chr(10) || '// p' || p_partkey || '-extra and xp' || p_partkey || ' are others' || chr(10) || 'React.x or react' || chr(10) || 'EXPRESS!', false FROM part),
  l AS (SELECT repo_id, path, man, unnest(string_split(content, chr(10))) AS t, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS k FROM fl)
SELECT DISTINCT l.repo_id, package, path, k::INT AS line, CASE WHEN man THEN 'constraint' WHEN regexp_matches(t, '\\b(?:import|from|require)\\b') THEN 'import' ELSE 'usage' END AS kind, NOT man AND contains(path, 'client') AS wrapper
FROM l JOIN pk ON pk.repo_id = l.repo_id AND contains(lower(t), lower(package)) AND regexp_matches(lower(t), '(^|[^a-z0-9_.\\-])' || regexp_escape(lower(package)) || '([^a-z0-9_.\\-]|$)')""",
        "manifests"),
    "move_references": f"""WITH {c._ST}, n AS (SELECT *, 4 * (row_number() OVER (PARTITION BY repo_id, o {c._O}) - 1) AS b FROM st), f AS (SELECT DISTINCT repo_id, o FROM st)
SELECT repo_id, 'web/o' || o || '.ts' AS target, 'web/o' || o || '.ts' AS path, (b + 1)::INT AS line, 'relative_imports' AS kind FROM n
UNION ALL SELECT a.repo_id, 'web/o' || a.o || '.ts', 'm' || b.o || '/index.ts', 2, 'barrel_exports' FROM f a JOIN f b ON a.repo_id = b.repo_id AND b.o % 3 = 0 AND starts_with('o' || b.o, 'o' || a.o)
UNION ALL SELECT repo_id, 'web/o' || o || '.ts', CASE o % 3 WHEN 1 THEN 'm' || o || '/package.json' ELSE 'm' || o || '/x.md' END, 2, CASE o % 3 WHEN 1 THEN 'config_references' ELSE 'path_references' END FROM f WHERE o % 3 > 0
UNION ALL SELECT repo_id, unnest(['pages/[o' || o || '].tsx', 'src/a b' || o || '.ts', 'N' || o || '.md']), 'docs/d' || o || '.txt', 1, 'path_references' FROM f""",
    "rewrite_imports": f"""WITH {c._ST}, f AS (SELECT DISTINCT repo_id, o FROM st),
  b AS (SELECT st.repo_id, st.o, count(f.o) AS n, string_agg(CASE WHEN f.o IS NULL THEN 'from pkg.o' ELSE 'from new.pkg.o' END || p || ' import x' || chr(10) || CASE q % 4 WHEN 0 THEN 'def f' || p || '(a, b):' || chr(10) || '    if a:' || chr(10) || '        return g' || s || '(tmp(b))' || chr(10) || '    return C' || s || '(a)' || chr(10)
      WHEN 1 THEN 'def f' || p || '(a, b):' || chr(10) || '    for x in a:' || chr(10) || '        if x and b and x and b and x:' || chr(10) || '            while x:' || chr(10) || '                with b:' || chr(10) || '                    pass' || chr(10) || '    return g' || s || '(b)' || chr(10)
      WHEN 2 THEN 'def f' || p || '(a, b):' || chr(10) || repeat('    a = a + 1' || chr(10), 40) || '    return C' || s || '(a)' || chr(10) ELSE 'def tmp(a):' || chr(10) || '    return g' || s || '(a)' || chr(10) END
    || CASE WHEN q >= 48 THEN 'class ' || {c._CLS} || '(Base):' || chr(10) || '    x = Column(1)' || chr(10) || '    def go(self):' || chr(10) || '        pass' || chr(10) ELSE '' END || CASE WHEN k = 1 THEN 'LIMIT_' || s || ' = os.getenv(' || chr(39) || 'VAR_' || s || chr(39) || ')' || chr(10) ELSE '' END, '' {c._O}) AS t
    FROM st LEFT JOIN f ON f.repo_id = st.repo_id AND f.o = st.p GROUP BY st.repo_id, st.o)
SELECT repo_id, 'pkg/o' || o || '.py' AS path, md5(t) AS digest, n AS rewritten FROM b WHERE n > 0""",
    "import_conflicts": f"""WITH {c._ST}, ln AS (SELECT repo_id, o, p, sum(1 + CASE q % 4 WHEN 0 THEN 4 WHEN 1 THEN 7 WHEN 2 THEN 42 ELSE 2 END + CASE WHEN q >= 48 THEN 4 ELSE 0 END + CASE WHEN k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY repo_id, o {c._O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM st), f AS (SELECT DISTINCT repo_id, o FROM st)
SELECT ln.repo_id, 'pkg/o' || ln.o || '.py' AS path, (coalesce(before, 0) + 1)::INT AS line, 'pkg.o' || p AS old FROM ln JOIN f ON f.repo_id = ln.repo_id AND f.o = ln.p""",
    "public_api_factors": with_views(
        "WITH f AS (SELECT repo_id, path, list_filter([CASE WHEN length(path) % 3 = 0 THEN 'exports' END, CASE WHEN starts_with(path, 'src/api') THEN 'routes' END, CASE WHEN starts_with(path, 'lib') THEN 'models' END, CASE WHEN regexp_matches(path, '/f\\d*0\\.') THEN 'entry_point' END], lambda x: x IS NOT NULL) AS factors FROM tree) SELECT *, CASE WHEN len(factors) >= 2 THEN 'HIGH' WHEN len(factors) = 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM f",
        "tree"),
    "affected_files": with_views("SELECT DISTINCT e.repo_id, e.target, t.path FROM edges e JOIN tree t ON t.repo_id = e.repo_id AND t.path IN (e.source, e.target) WHERE NOT " + SENSITIVE.format(p="t.path") + " AND NOT " + BINARY.format(p="t.path"), "edges", "tree"),
    "plan_risk": with_views(
        f"""WITH {g._CAT}, t AS (SELECT repo_id, path AS target, category, length(path) AS n, length(path) % 7 = 0 AS boundary, length(path) % 7 <> 0 AND length(path) % 5 = 0 AS moves, length(path) % 4 > 0 AS ex, suffix(path, '0.py') AS en, starts_with(path, 'src/api') AS ro, starts_with(path, 'lib') AS mo FROM c),
  u AS (SELECT *, ex OR en OR ro OR mo OR n % 6 >= 5 OR boundary AS high FROM t)
SELECT repo_id, target, CASE WHEN high THEN 'HIGH' WHEN n % 6 > 0 OR n % 2 > 0 OR category IN ('service', 'controller', 'middleware') THEN 'MEDIUM' ELSE 'LOW' END AS risk, CASE WHEN n % 8 > 0 AND n % 9 > 0 THEN 'HIGH' WHEN n % 9 > 0 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  list_filter([CASE WHEN ex THEN 'public exports' END, CASE WHEN en THEN 'entry point' END, CASE WHEN ro THEN 'API route' END, CASE WHEN mo THEN 'database model' END, CASE WHEN n % 6 >= 5 THEN 'direct dependents' END, CASE WHEN boundary THEN 'boundary' END, CASE WHEN n % 2 > 0 THEN 'cycle' END, CASE WHEN n % 3 = 0 THEN 'no test' END, CASE WHEN n % 8 = 0 THEN 'no content' END, CASE WHEN moves AND n % 2 = 0 THEN 'unconfirmed references' END], lambda z: z IS NOT NULL) AS factors FROM u""",
        "tree"),
    "partition_symbols": f"WITH {c._ST} SELECT DISTINCT repo_id, 'web/o' || o || '.ts' AS path, CASE length('h' || p) % 3 WHEN 0 THEN 'models' WHEN 1 THEN 'routes' ELSE 'services' END AS part, 'h' || p AS name FROM st UNION SELECT repo_id, 'web/o' || o || '.ts', 'components', 'useT' || s FROM st",
    "part_edges": f"""WITH {c._ST}, x AS (SELECT DISTINCT repo_id, 'web/o' || o || '.ts' AS path, CASE length('h' || p) % 3 WHEN 0 THEN 'models' WHEN 1 THEN 'routes' ELSE 'services' END AS part, 'h' || p AS name FROM st UNION SELECT repo_id, 'web/o' || o || '.ts', 'components', 'useT' || s FROM st)
SELECT a.repo_id, a.path, a.part AS source, b.part AS target, a.name AS caller, b.name AS callee FROM x a JOIN x b ON b.repo_id = a.repo_id AND b.path = a.path AND a.part <> b.part WHERE (length(a.name) + length(b.name)) % 2 = 1""",
    "classify_questions": with_views(f"WITH {_INTENT} SELECT repo_id, question_id, intent FROM it", "tree"),
    "rank_relevant_files": with_views(f"WITH {_RANK} SELECT * FROM rk", "tree", "edges"),
    "budgeted_excerpts": with_views(
        f"""WITH {_RANK}, x AS (SELECT repo_id, question_id, position, path, repeat(path || ' ', length(path) * 11) || CASE WHEN length(path) % 3 = 0 THEN '[REDACTED SECRET]' ELSE '' END AS t FROM rk WHERE position <= 4 AND NOT {SENSITIVE.format(p="path")} AND NOT {BINARY.format(p="path")}),
  y AS (SELECT *, CASE WHEN length(t) > 2500 THEN left(t, 2500) || chr(10) || chr(10) || '[CONTENT TRUNCATED]' ELSE t END AS e FROM x), z AS (SELECT *, 10000 - coalesce(sum(length(e)) OVER (PARTITION BY repo_id, question_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM y),
  w AS (SELECT *, CASE WHEN length(e) <= room THEN e ELSE left(e, greatest(room, 0)::INT) || chr(10) || '... [Source truncated for context limit]' END AS r FROM z WHERE length(e) <= room OR room > 300)
SELECT repo_id, question_id, position, path, length(r) AS n, md5(r) AS digest FROM w""",
        "tree", "edges"),
    "evidence_pack": with_views(
        f"""WITH {_RANK}, fl AS (SELECT repo_id, question_id, string_agg(path || '|' || score, ',' ORDER BY position) AS files FROM rk GROUP BY ALL), de AS (SELECT DISTINCT repo_id, source, target FROM edges),
  ed AS (SELECT repo_id, question_id, string_agg(source || '|' || target, ',' ORDER BY source, target) AS edges FROM (SELECT DISTINCT rk.repo_id, question_id, source, target FROM rk JOIN de ON de.repo_id = rk.repo_id AND (de.source = rk.path OR de.target = rk.path)) GROUP BY ALL),
  rr AS (SELECT rk.repo_id, question_id, method, route FROM rk JOIN ro ON ro.repo_id = rk.repo_id AND ro.file = rk.path UNION SELECT it.repo_id, question_id, method, route FROM it JOIN (SELECT DISTINCT repo_id, method, route FROM ro QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY route, method) <= 30) x ON x.repo_id = it.repo_id WHERE intent = 'API_ROUTE'),
  mm AS (SELECT rk.repo_id, question_id, name FROM rk JOIN mo ON mo.repo_id = rk.repo_id AND mo.file = rk.path UNION SELECT it.repo_id, question_id, name FROM it JOIN (SELECT repo_id, name FROM (SELECT DISTINCT repo_id, name FROM mo) QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY name) <= 30) x ON x.repo_id = it.repo_id WHERE intent = 'DATABASE'),
  r2 AS (SELECT repo_id, question_id, string_agg(method || '|' || route, ',' ORDER BY method, route) AS routes FROM rr GROUP BY ALL), m2 AS (SELECT repo_id, question_id, string_agg(name, ',' ORDER BY name) AS models FROM mm GROUP BY ALL)
SELECT it.repo_id, it.question_id, intent, files, edges, routes, models FROM it LEFT JOIN fl USING (repo_id, question_id) LEFT JOIN ed USING (repo_id, question_id) LEFT JOIN r2 USING (repo_id, question_id) LEFT JOIN m2 USING (repo_id, question_id)""",
        "tree", "edges"),
}

QUERIES = {f.__name__: f for f in (symbol_references, symbol_mentions, unresolved_targets, dependency_usage, move_references, rewrite_imports, import_conflicts, public_api_factors, affected_files, plan_risk, partition_symbols, part_edges, classify_questions, rank_relevant_files, budgeted_excerpts, evidence_pack)}
