"""Views of the given tables in the shapes that the operators take.

A view is one SELECT that Spark SQL and the oracle both read: commits are orders,
their files are line items, the tree is what they touch, and texts are documents.
Repositories and paths are named by whole keys, so that their number grows with
the tables, and each kind of file that an operator tells apart is among the paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolytics.checkpoints import checkpointed

#: The repository of a customer, as SQL.
REPO = "'repo-' || CAST(CAST(floor({c} / 4) AS BIGINT) AS STRING)"

#: Of 101 parts so many stand for files of special kinds.
_SPECIAL = (
    "'config/.env.prod'", "'certs/k' || {k} || '.pem'", "'assets/img' || {k} || '.png'", "'web/dist/app' || {k} || '.min.js'", "'package-lock.json'", "'node_modules/x' || {k} || '/index.js'",
    "'src/models/user' || {k} || '.py'", "'db/migrations/v' || {k} || '.sql'", "'src/routes/r' || {k} || '.ts'", "'src/middleware/w' || {k} || '.ts'", "'scripts/s' || {k} || '.sh'", "'app/p' || {k} || '/page.tsx'",
    "'src/controllers/c' || {k} || '.ts'", "'pkg' || {k} || '/README.md'", "'src/tokens_' || {k} || '.json'", "'src/x' || {k} || '.spec.ts'", "'Dockerfile'", "'src/main.py'", "'.github/workflows/w' || {k} || '.yml'",
    "'packages/a' || CAST({n} % 5 AS STRING) || '/package.json'", "'src/billing/auth' || {k} || '.go'", "'schema' || {k} || '.prisma'", "'vite.config.ts'", "'requirements.txt'", "'src/core/sessions.py'",
)


def path_of(key: str) -> str:
    """The path of a part's file, as SQL."""
    k = f"CAST({key} AS STRING)"
    special = " ".join(f"WHEN {i} THEN {x.format(k=k, n=key)}" for i, x in enumerate(_SPECIAL))
    plain = f"""CASE {key} % 6 WHEN 0 THEN 'src/api/m' WHEN 1 THEN 'src/services/m' WHEN 2 THEN 'src/components/m' WHEN 3 THEN 'tests/m' WHEN 4 THEN 'lib/m' ELSE 'docs/m' END
  || CAST({key} % 10 AS STRING) || '/f' || {k} || CASE {key} % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.js' ELSE '.tsx' END"""
    return f"CASE {key} % 101 {special} ELSE {plain} END"


def same_path(key: str) -> str:
    """A part whose file has the path of ``key``'s, and the same one for all that share it, as SQL."""
    fixed = ", ".join(str(i) for i, x in enumerate(_SPECIAL) if "{" not in x)
    fifth = next(i for i, x in enumerate(_SPECIAL) if "{n} % 5" in x)
    return f"CASE WHEN {key} % 101 IN ({fixed}) THEN {key} % 101 WHEN {key} % 101 = {fifth} THEN {fifth} + 101 * (({key} - {fifth} % 5 + 5) % 5) ELSE {key} END"


#: Lines that a text of every thirteenth id ends with: what the text rules look for.
_TAILS = (
    "'api_key = \"abcd1234efgh\"' || chr(10) || 'password = ''short''' || chr(10) || 'token: plain,next'", "'Authorization: Bearer abcdefghijklmnopqrstuvwxyz0123' || chr(10) || 'postgres://u:p@host/db rest'",
    "'eval(x)' || chr(10) || '# eval(y)' || chr(10) || '// exec (z)' || chr(10) || 'a = exec (z)'", "'// TODO mend' || chr(10) || '# fixme this' || chr(10) || 'hack in code'", "repeat(chr(9), 24) || 'x = 1' || chr(10) || chr(9) || 'y'",
    "'fetch(''/a/b'')' || chr(10) || 'fetch(\"/a/b\")' || chr(10) || 'fetch(''http://h/x y'')' || chr(10) || 'fetch(''/a/b'');fetch(''http://h/x y'')'", "'ghp_' || repeat('a', 36) || ' AKIA' || repeat('B', 16) || ' sk-' || repeat('c', 24)",
    "'one = 1' || chr(10) || 'two  = 2' || chr(10) || 'three = 3' || chr(10) || 'four = 4' || chr(10) || 'gap' || chr(10) || 'one = 1' || chr(10) || 'two = 2' || chr(10) || 'three = 3' || chr(10) || 'four = 4'",
    "'-----BEGIN RSA PRIVATE KEY-----' || chr(10) || 'abc' || chr(10) || '-----END RSA PRIVATE KEY-----'", "'function f(a) { if (a) { while (a) { for (;;) { if (b) { do { g() } while (c) } } } } }' || chr(10) || 'const h = (x) => { { {' || chr(10) || '{ { {' || chr(10) || '} }'",
    "'from flask import Flask' || chr(10) || 'const m = require(\"mongoose\")'", "repeat('# only' || chr(10), 3) || repeat('line of code' || chr(10), 90)", "''",
)

VIEWS: dict[str, str] = {
    "commits": f"""SELECT {REPO.format(c="o_custkey")} AS repo_id, CAST(o_orderkey AS STRING) AS sha, 'u' || CAST(o_orderkey % 7 AS STRING) AS author_email_hash,
  'Author ' || CAST(o_orderkey % 7 AS STRING) || ' ' || o_orderstatus AS author_name, CAST(o_orderdate AS TIMESTAMP) AS author_date, o_orderpriority AS subject, o_orderstatus = 'P' AS is_merge FROM orders""",
    "commit_files": f"""SELECT repo_id, sha, path, CAST(sum(q) AS BIGINT) AS additions, CAST(sum(n) AS BIGINT) AS deletions FROM (
  SELECT {REPO.format(c="o_custkey")} AS repo_id, CAST(l_orderkey AS STRING) AS sha, {path_of("l_partkey")} AS path, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x GROUP BY repo_id, sha, path""",
    # Files of one order: all lead to its first ones, each to those of the next line, and the first of some orders back.
    "edges": f"""SELECT DISTINCT repo_id, source, target, 'imports' AS type FROM (
  SELECT {REPO.format(c="o_custkey")} AS repo_id, {path_of("a.k")} AS source, {path_of("b.k")} AS target FROM (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS k FROM lineitem) a
  JOIN (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS k FROM lineitem) b ON a.o = b.o AND ((b.n = 1 AND a.n > 1) OR b.n = a.n + 1 OR (a.n = 1 AND b.n > 1 AND a.o % 4 = 0)) JOIN orders ON a.o = o_orderkey) x WHERE source <> target""",
    "tree": f"""SELECT DISTINCT {REPO.format(c="o_custkey")} AS repo_id, {path_of("l_partkey")} AS path FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "file_sizes": f"""SELECT repo_id, path, CAST(sum(price) AS BIGINT) AS size FROM (
  SELECT {REPO.format(c="o_custkey")} AS repo_id, {path_of("l_partkey")} AS path, CAST(floor(l_extendedprice) AS BIGINT) * (1 + l_partkey % 9) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x GROUP BY repo_id, path""",
    "contents": f"""SELECT coalesce(source, 'none') AS repo_id, CASE lang WHEN 'en' THEN 'src/m' WHEN 'de' THEN 'lib/m' ELSE 'web/m' END || CAST(doc_id % 7 AS STRING) || '/d' || CAST(doc_id AS STRING)
  || CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.js' WHEN 'fr' THEN '.ts' ELSE '.md' END AS path, text || CASE doc_id % 13 {" ".join(f"WHEN {i} THEN chr(10) || {x}" for i, x in enumerate(_TAILS))} END AS content FROM documents""",
    "snapshots": f"""SELECT DISTINCT {REPO.format(c="o_custkey")} AS repo_id, CAST(date_trunc('year', o_orderdate) AS STRING) AS sha, CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS committed_at,
  {path_of("l_partkey")} AS path FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "activity": """SELECT CAST(user_id AS STRING) AS project_id, event_type AS type, event_id AS id, CAST(ts AS TIMESTAMP) AS created_at, value, props FROM events""",
    # Manifests of packages: one repository for every four parts.
    "manifests": """SELECT 'pack-' || CAST(CAST(floor(p_partkey / 4) AS BIGINT) AS STRING) AS repo_id, CASE p_partkey % 4 WHEN 0 THEN 'package.json' WHEN 1 THEN 'frontend/package.json' WHEN 2 THEN 'requirements.txt' ELSE 'frontend/pyproject.toml' END AS path,
  CASE p_partkey % 4 WHEN 2 THEN 'pytest>=' || CAST(p_size AS STRING) || chr(10) || '# flask' || chr(10) || CASE WHEN p_size % 2 = 0 THEN 'mypy' || chr(10) || 'Django==4' ELSE '-r x' || chr(10) || 'supabase' END
    WHEN 3 THEN '[project]' || chr(10) || 'dependencies = [' || chr(10) || '  "ruff>=1",' || chr(10) || '  "p' || CAST(p_partkey AS STRING) || '"' || chr(10) || ']'
    ELSE '{"scripts": {"test": "jest", "lint": "eslint . | cat", "build": "tsc && vite build"' || CASE WHEN p_size % 3 = 0 THEN ', "pretest": "x"' ELSE '' END || ', "start": "node x"}, "dependencies": {"' || CASE WHEN p_size % 2 = 0 THEN 'react' ELSE 'express' END
      || '": "1", "p' || CAST(p_partkey AS STRING) || '": "2"}, "devDependencies": {"typescript": "5"}}' END AS content FROM part""",
}

_R = "CAST(floor(o_custkey / 4) AS BIGINT) AS r"
_NAMED = "'repo-' || CAST(r AS STRING) AS repo_id"
#: The same views for Spark: what is shuffled are numbers, and names are made of what is left.
NUMBERED: dict[str, str] = {
    "commit_files": f"""SELECT {_NAMED}, CAST(o AS STRING) AS sha, {path_of("k")} AS path, additions, deletions FROM (SELECT r, o, k, CAST(sum(q) AS BIGINT) AS additions, CAST(sum(n) AS BIGINT) AS deletions FROM (
  SELECT {_R}, l_orderkey AS o, {same_path("l_partkey")} AS k, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x GROUP BY r, o, k) y""",
    "tree": f"""SELECT {_NAMED}, {path_of("k")} AS path FROM (SELECT DISTINCT {_R}, {same_path("l_partkey")} AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x""",
    "file_sizes": f"""SELECT {_NAMED}, {path_of("k")} AS path, CAST(size AS BIGINT) AS size FROM (SELECT r, k, sum(price) AS size FROM (
  SELECT {_R}, {same_path("l_partkey")} AS k, CAST(floor(l_extendedprice) AS BIGINT) * (1 + l_partkey % 9) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x GROUP BY r, k) y""",
    "snapshots": f"""SELECT {_NAMED}, CAST(at AS STRING) AS sha, CAST(at AS TIMESTAMP) AS committed_at, {path_of("k")} AS path FROM (
  SELECT DISTINCT {_R}, date_trunc('year', o_orderdate) AS at, {same_path("l_partkey")} AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x""",
}


def _edges(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """The view of edges: the lines of an order meet once, as one array, and edges are told apart by their numbers."""
    lines = lineitem.select(F.col("l_orderkey").alias("o"), F.struct(F.col("l_linenumber").alias("n"), F.expr(same_path("l_partkey")).alias("k")).alias("x")).filter("o IS NOT NULL")
    orders = orders.select(F.col("o_orderkey").alias("o"), F.expr(_R))
    found = """array_distinct(flatten(transform(xs, a -> transform(filter(xs, b -> a.k <> b.k AND ((b.n = 1 AND a.n > 1) OR b.n = a.n + 1 OR (a.n = 1 AND b.n > 1 AND o % 4 = 0))), b -> struct(a.k AS s, b.k AS t)))))"""
    pairs = lines.groupBy("o").agg(F.collect_list("x").alias("xs")).join(orders, "o").select("r", F.explode(F.expr(found)).alias("e")).select("r", "e.*").distinct()
    return pairs.selectExpr(_NAMED, f"{path_of('s')} AS source", f"{path_of('t')} AS target", "'imports' AS type")


#: Which of the given tables a view reads.
TABLES = ("orders", "lineitem", "documents", "events", "pages", "part", "customer", "nation", "conversations", "supplier")
#: Views that take a shuffle: each is derived once in a session and written to the shared folder.
WRITTEN = ("commit_files", "edges", "tree", "file_sizes", "snapshots")
_written: dict[tuple, DataFrame] = {}


def _reads(sql: str) -> list[str]:
    words = set(sql.replace("(", " ").replace(")", " ").split())
    return [t for t in TABLES if t in words]


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """When each of the given tables was last written, and its length."""
    found = []
    for t in TABLES:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(path):
            status = files.getFileStatus(path)
            found.append((t, status.getModificationTime(), status.getLen()))
    return tuple(found)


def once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:  # noqa: ANN001
    """What ``make()`` gives, written to the shared folder the first time that this session asks for it of tables as they are.

    Such a table grows with the given ones and is many times its size on disk, which
    Spark goes by: the hint keeps joins from handing it through the driver.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name, _stamp(spark, sf_dir))
    if key not in _written:
        _written[key] = checkpointed(make()).hint("merge")
    return _written[key]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of :data:`VIEWS` over the tables in ``sf_dir``."""

    def make() -> DataFrame:
        sql = NUMBERED.get(name, VIEWS[name])
        tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _reads(sql)}
        if name == "edges":
            return _edges(tables["lineitem"], tables["orders"])
        sql = sql.replace("{", "{{").replace("}", "}}")
        for t in tables:
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
        return spark.sql(sql, **tables)

    return once(spark, sf_dir, name, make) if name in WRITTEN else make()


def with_views(sql: str, *names: str) -> str:
    """``sql`` for the oracle, the named views before it."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + (", " + sql.lstrip()[4:].lstrip() if sql.lstrip().upper().startswith("WITH ") else " " + sql)
