"""Line and text queries over the texts of the given documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolytics.functions import paths, redact
from repolytics.operators import lines
from repolytics.operators.classify import MIX_LANGUAGES
from repolytics.plans.adapters import view, with_views
from repolytics.plans.sql import BINARY, EXT, GENERATED, LANGUAGE, SENSITIVE, SKIPPED, SYNTAX, TEST, looked_up, quoted, rint


def _contents(spark, sf):  # noqa: ANN001, ANN202
    return view(spark, sf, "contents")


def explode_lines(spark, sf):  # noqa: ANN001, ANN201
    return lines.explode_lines(_contents(spark, sf)).select("repo_id", "path", "line", F.md5("text").alias("digest"))


def line_metrics(spark, sf):  # noqa: ANN001, ANN201
    return lines.line_metrics(_contents(spark, sf))


def line_findings(spark, sf):  # noqa: ANN001, ANN201
    return lines.line_findings(_contents(spark, sf), "Aggressive").select("repo_id", "path", "category", "rule", "line", "severity", "confidence", "message", F.md5("evidence").alias("evidence"))


def brace_nesting(spark, sf):  # noqa: ANN001, ANN201
    return lines.brace_nesting(_contents(spark, sf))


def repeated_blocks(spark, sf):  # noqa: ANN001, ANN201
    return lines.repeated_blocks(_contents(spark, sf), "Aggressive")


def _quality(spark, sf, mode="Balanced"):  # noqa: ANN001, ANN202
    c = _contents(spark, sf)
    blocks = lines.repeated_blocks(c, mode).select("repo_id", "path", F.lit("repeated_block").alias("rule"), F.lit("MEDIUM").alias("severity"), "line")
    vague = lines.vague_functions(c).select("repo_id", "path", F.lit("vague_name").alias("rule"), F.lit("LOW").alias("severity"), F.lit(1).alias("line"))
    return lines.line_findings(c, mode).select("repo_id", "path", "rule", "severity", "line").unionByName(blocks).unionByName(vague)


def maintainability(spark, sf):  # noqa: ANN001, ANN201
    return lines.maintainability(_quality(spark, sf))


def stored_findings(spark, sf):  # noqa: ANN001, ANN201
    return lines.stored_findings(_quality(spark, sf, "Aggressive"), 4).groupBy("repo_id", "path", "rule", "line").agg(F.count(F.lit(1)).alias("n"))


def vague_functions(spark, sf):  # noqa: ANN001, ANN201
    return lines.vague_functions(_contents(spark, sf))


def security_findings(spark, sf):  # noqa: ANN001, ANN201
    return lines.security_findings(_contents(spark, sf), view(spark, sf, "tree"))


def size_findings(spark, sf):  # noqa: ANN001, ANN201
    return lines.size_findings(view(spark, sf, "file_sizes"))


def repeated_fetch(spark, sf):  # noqa: ANN001, ANN201
    # Most texts hold no calls; the first words of their lines stand for them.
    c = _contents(spark, sf).withColumn("content", F.when(F.contains("content", F.lit("fetch(")), F.col("content")).otherwise(F.regexp_replace("content", r"(^|\n)(\w+)", "$1fetch('/$2')")))
    return lines.repeated_fetch(c, 2)


def snapshot_fingerprint(spark, sf):  # noqa: ANN001, ANN201
    return lines.snapshot_fingerprint(_contents(spark, sf))


def redacted_contents(spark, sf):  # noqa: ANN001, ANN201
    c = _contents(spark, sf)
    return c.select("repo_id", "path", F.md5(redact.scrub_metadata(F.col("content"))).alias("scrubbed"), F.md5(redact.redact_log(F.col("content"))).alias("logged"), F.length(redact.truncate_content(F.col("content"), 600)).cast("long").alias("cut"), redact.redact_file(F.col("path"), F.col("content"))["redacted"].alias("redacted"))


def path_facts(spark, sf):  # noqa: ANN001, ANN201
    t = view(spark, sf, "tree")
    p = F.col("path")
    return t.select(
        "repo_id", "path", paths.base_name(p).alias("name"), paths.dir_name(p).alias("folder"), paths.extension(p).alias("extension"), paths.detect_language(p).alias("syntax"), paths.language_name(p).alias("language"),
        paths.is_sensitive_path(p).alias("sensitive"), paths.is_binary_path(p).alias("binary"), paths.is_generated(p).alias("generated"), paths.is_test_path(p).alias("test"), paths.should_skip(p).alias("skipped"),
        paths.norm_join(paths.dir_name(p), F.lit("../x/./y")).alias("joined"), paths.valid_path(p).alias("valid"),
    )


def page_routes(spark, sf):  # noqa: ANN001, ANN201
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", paths.normalize_route(F.regexp_replace("url", r"/(\d+)", "/:id")).alias("route"))


def generated_contents(spark, sf):  # noqa: ANN001, ANN201
    n = F.length("content") % 3
    text = F.when(n == 0, F.concat(F.lit("  # Auto-Generated by x\n"), "content")).when(n == 1, F.concat(F.lit("generated by x\n"), "content")).otherwise(F.col("content"))
    return _contents(spark, sf).select("repo_id", "path", paths.is_generated(F.col("path"), text).alias("generated"))


def repo_urls(spark, sf):  # noqa: ANN001, ANN201
    k = F.pmod("page_id", F.lit(5))
    url = F.when(k == 0, F.concat(F.lit("https://github.com/Own"), F.col("page_id").cast("string"), F.lit("/Repo.git"))).when(k == 1, "own.x/re-po/tree/main").when(k == 2, "www.github.com/settings/x").when(k == 3, F.col("url")).otherwise(" github.com/a_b/c ")
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", paths.parse_repo_url(url).alias("r"))
    return rows.select("page_id", "r.owner", "r.repo", "r.canonical")


def valid_values(spark, sf):  # noqa: ANN001, ANN201
    p = F.col("path")
    date = F.when(F.length(p) % 2 == 0, "2024-01-31T10:20:30Z").otherwise("2024-1-31")
    return view(spark, sf, "tree").select("repo_id", "path", paths.valid_branch(p).alias("branch"), paths.valid_sha(F.md5(p)).alias("sha"), paths.valid_sha(F.substring(F.md5(p), 1, 6)).alias("short_sha"), paths.valid_date(date).alias("date"))


def tree_language(spark, sf):  # noqa: ANN001, ANN201
    from repolytics.operators.classify import language_mix

    return language_mix(view(spark, sf, "tree"))


_L = "l AS (SELECT repo_id, path, CASE WHEN content = '' THEN [] ELSE CASE WHEN suffix(content, chr(10)) THEN string_split(content, chr(10))[:-2] ELSE string_split(content, chr(10)) END END AS ls FROM contents), n AS (SELECT *, CASE WHEN suffix(path, '.py') THEN 'python' WHEN suffix(path, '.js') THEN 'javascript' WHEN suffix(path, '.ts') THEN 'typescript' ELSE 'markdown' END AS language FROM l), e AS (SELECT repo_id, path, language, unnest(ls) AS t, unnest(range(1, len(ls) + 1)) AS k FROM n)"
_MARK = "CASE WHEN language = 'python' THEN '#' ELSE '//' END"
_BARE, _LEAD = "trim(t, ' ' || chr(9))", "ltrim(t, ' ' || chr(9))"
#: Tabs only stand at the begin of lines.
_WIDE = "(length(t) + 3 * (length(t) - length(replace(t, chr(9), ''))))"
_COMMENT = f"starts_with({_LEAD}, {_MARK})"


def _line_findings(limit: int) -> str:
    """``f``: line findings for lines over ``limit``, after :data:`_L`."""
    return f"""f AS (
  SELECT repo_id, path, 'readability' AS category, 'long_line' AS rule, k AS line, 'HIGH' AS confidence, {_WIDE} || ' characters, over {limit}' AS message, t FROM e WHERE {_WIDE} > {limit} QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY k) <= 10
  UNION ALL SELECT repo_id, path, 'comments', 'unresolved_comment', k, 'MEDIUM', 'Open work is marked here.', t FROM e WHERE regexp_matches(t, '(?i)\\b(?:TODO|FIXME|HACK)\\b') AND {_COMMENT} QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY k) <= 10
  UNION ALL SELECT repo_id, path, 'comments', 'sparse_comments', 1, 'LOW', 'Few comments for so much code.', t FROM (
    SELECT repo_id, path, any_value(t) FILTER (WHERE k = 1) AS t, count(*) - count(*) FILTER (WHERE {_BARE} = '') - count(*) FILTER (WHERE {_COMMENT}) AS code, count(*) FILTER (WHERE {_COMMENT}) AS com FROM e GROUP BY ALL) WHERE code > 80 AND com / code < 0.02)"""


def _blocks(n: int) -> str:
    """``rb``: repeated blocks of ``n`` lines, after :data:`_L`."""
    parts = " || chr(10) || ".join(["x"] + [f"lead(x, {i}) OVER w" for i in range(1, n)])
    fine = " AND ".join(f"coalesce({p} NOT IN ('', '{{', '}}', 'else:', 'return'), false)" for p in ["x"] + [f"lead(x, {i}) OVER w" for i in range(1, n)])
    return f"""fl AS (SELECT repo_id, path, k, regexp_replace({_BARE}, '[ \t]+', ' ', 'g') AS x FROM e WHERE language <> 'markdown'),
  bl AS (SELECT repo_id, path, k, {parts} AS block, {fine} AS fine FROM fl WINDOW w AS (PARTITION BY repo_id, path ORDER BY k)),
  st AS (SELECT repo_id, path, block, k, row_number() OVER (PARTITION BY repo_id, path, block ORDER BY k) AS j FROM bl WHERE fine QUALIFY count(*) OVER (PARTITION BY repo_id, path, block) > 1),
  wk AS (SELECT repo_id, path, block, j, k AS anchor, NULL::BIGINT AS first_line, NULL::BIGINT AS line FROM st WHERE j = 1
    UNION ALL SELECT st.repo_id, st.path, st.block, st.j, CASE WHEN st.k - wk.anchor >= {n} THEN wk.anchor ELSE st.k END, CASE WHEN st.k - wk.anchor >= {n} THEN wk.anchor END, CASE WHEN st.k - wk.anchor >= {n} THEN st.k END FROM wk JOIN st ON st.repo_id = wk.repo_id AND st.path = wk.path AND st.block = wk.block AND st.j = wk.j + 1),
  rb AS (SELECT repo_id, path, first_line, line FROM wk WHERE line IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY line, first_line) <= 10)"""


def _recursive(sql: str, *names: str) -> str:
    return with_views(sql, *names).replace("WITH ", "WITH RECURSIVE ", 1)


_FUNCTION = lines.FUNCTION.replace("'", "''")
_VAGUE = f"""fn AS (SELECT repo_id, path, unnest(list_concat(regexp_extract_all(x, '{_FUNCTION}', 1), regexp_extract_all(x, '{_FUNCTION}', 2))) AS name FROM (SELECT repo_id, path, array_to_string(ls, chr(10)) AS x FROM n WHERE language IN ('javascript', 'typescript'))),
  vg AS (SELECT repo_id, path, name, count(*) AS count FROM fn WHERE name IN ({quoted(lines.VAGUE)}) OR (length(name) = 1 AND name NOT IN ('i', 'j', 'k')) GROUP BY ALL)"""


def _all(limit: int, n: int) -> str:
    """``q``: all quality findings."""
    return f"""{_line_findings(limit)}, {_blocks(n)}, {_VAGUE}, q AS (SELECT repo_id, path, rule, 'LOW' AS severity, line::INT AS line FROM f UNION ALL SELECT repo_id, path, 'repeated_block', 'MEDIUM', line::INT FROM rb UNION ALL SELECT repo_id, path, 'vague_name', 'LOW', 1 FROM vg)"""


def _redacted(x: str) -> str:
    for pattern in redact.SECRETS:
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{redact.TOKEN}', 'g')"
    return x


def _replaced(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"


SQL = {
    "explode_lines": with_views(f"WITH {_L} SELECT repo_id, path, k AS line, md5(t) AS digest FROM e", "contents"),
    "line_metrics": with_views(
        f"""WITH {_L}, g AS (SELECT repo_id, path, count(*) AS total_lines, count(*) FILTER (WHERE {_BARE} = '') AS blank_lines, count(*) FILTER (WHERE {_COMMENT}) AS comment_lines, sum(length(t)) AS chars, max(length(t)) AS max_line_length, count(*) FILTER (WHERE {_WIDE} > 100) AS long_line_count FROM e GROUP BY ALL),
  h AS (SELECT n.repo_id, n.path, language, coalesce(total_lines, 0) AS total_lines, coalesce(blank_lines, 0) AS blank_lines, coalesce(comment_lines, 0) AS comment_lines, coalesce(chars, 0) AS chars, coalesce(max_line_length, 0) AS max_line_length, coalesce(long_line_count, 0) AS long_line_count FROM n LEFT JOIN g USING (repo_id, path)),
  i AS (SELECT *, greatest(0, total_lines - blank_lines - comment_lines) AS code_lines FROM h)
SELECT repo_id, path, language, total_lines, code_lines, blank_lines, comment_lines, {rint("comment_lines / greatest(code_lines, 1)", 3)} AS comment_ratio, {rint("chars / greatest(total_lines, 1)", 1)} AS average_line_length, max_line_length, long_line_count FROM i""",
        "contents"),
    "line_findings": with_views(f"WITH {_L}, {_line_findings(88)} SELECT repo_id, path, category, rule, line, 'LOW' AS severity, confidence, message, md5(substr({_BARE}, 1, 160)) AS evidence FROM f", "contents"),
    "brace_nesting": with_views(
        rf"""WITH {_L}, d AS (SELECT repo_id, path, k, sum(len(regexp_extract_all(t, '\{{')) - len(regexp_extract_all(t, '\}}'))) OVER (PARTITION BY repo_id, path ORDER BY k) AS s FROM e WHERE language IN ('javascript', 'typescript')),
  x AS (SELECT repo_id, path, k, s - least(0, min(s) OVER (PARTITION BY repo_id, path ORDER BY k)) AS depth FROM d), y AS (SELECT repo_id, path, max(depth)::BIGINT AS max_nesting, min(k) FILTER (WHERE depth > 6) AS deep_line, arg_min(depth, k) FILTER (WHERE depth > 6) AS deep_depth FROM x GROUP BY ALL)
SELECT n.repo_id, n.path, coalesce(len(regexp_extract_all(array_to_string(ls, chr(10)), '{_FUNCTION}')), 0)::BIGINT AS function_count, coalesce(max_nesting, 0)::BIGINT AS max_nesting, deep_line::BIGINT AS deep_line, deep_depth::BIGINT AS deep_depth FROM n LEFT JOIN y USING (repo_id, path) WHERE language IN ('javascript', 'typescript')""",
        "contents"),
    "repeated_blocks": _recursive(f"WITH {_L}, {_blocks(3)} SELECT repo_id, path, first_line::INT AS first_line, line::INT AS line, 3 AS span FROM rb", "contents"),
    "vague_functions": with_views(f"WITH {_L}, {_VAGUE} SELECT * FROM vg", "contents"),
    "maintainability": _recursive(f"WITH {_L}, {_all(100, 4)} SELECT repo_id, path, greatest(0, 100 - sum(CASE severity WHEN 'MEDIUM' THEN 5 ELSE 2 END))::BIGINT AS maintainability_score, count(*) AS finding_count FROM q GROUP BY ALL", "contents"),
    "stored_findings": _recursive(f"WITH {_L}, {_all(88, 3)}, s AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY line, rule) <= 4) SELECT repo_id, path, rule, line, count(*) AS n FROM s GROUP BY ALL", "contents"),
    "security_findings": with_views(
        f"""WITH {_L} SELECT repo_id, path, 'sensitive_file' AS rule, 'HIGH' AS severity, 'HIGH' AS confidence, NULL::INT AS line FROM tree WHERE {SENSITIVE.format(p="path")}
UNION ALL SELECT repo_id, path, 'literal_secret_candidate', 'MEDIUM', 'MEDIUM', k FROM e WHERE language <> 'markdown' AND regexp_matches(t, '(?i)\\b(?:password|secret|api[_-]?key|access[_-]?token)\\s*[:=]\\s*[''"][^''"]{{4,}}[''"]')
UNION ALL SELECT repo_id, path, 'dynamic_execution', 'MEDIUM', 'MEDIUM', k FROM e WHERE language <> 'markdown' AND regexp_matches(t, '\\b(?:eval|exec)\\s*\\(') AND NOT regexp_matches({_LEAD}, '^(#|//|\\*)')""",
        "contents", "tree"),
    "size_findings": with_views(
        f"""SELECT repo_id, path, 'Architecture' AS category, 'large_module' AS rule, 'HIGH' AS confidence, size, 'LOW' AS severity FROM file_sizes WHERE NOT {SENSITIVE.format(p="path")} AND size >= 100000 AND NOT {BINARY.format(p="path")} AND NOT {GENERATED.format(p="path")}
UNION ALL SELECT repo_id, path, 'Performance', 'large_asset', 'MEDIUM', size, 'LOW' FROM file_sizes WHERE NOT {SENSITIVE.format(p="path")} AND size >= 500000 AND (regexp_matches(path, '\\.(js|css|html)$') OR contains(path, '/dist/'))""",
        "file_sizes"),
    "repeated_fetch": with_views(
        rf"""WITH {_L}, c AS (SELECT repo_id, path, k, unnest(regexp_extract_all(CASE WHEN has THEN t ELSE regexp_replace(t, '^(\w+)', 'fetch(''/\1'')') END, '\bfetch\s*\(\s*[''"]([^''"]{{1,100}})[''"]', 1)) AS target FROM e JOIN (SELECT repo_id, path, contains(content, 'fetch(') AS has FROM contents) USING (repo_id, path))
SELECT repo_id, path, CASE WHEN regexp_matches(target, '^/[A-Za-z0-9_./-]+$') THEN target ELSE 'sha256:' || left(sha256(target), 12) END AS target, count(*) AS count, list_sort(list(k::INT)) AS lines FROM c GROUP BY repo_id, path, c.target HAVING count(*) >= 2""",
        "contents"),
    "snapshot_fingerprint": with_views(
        """WITH d AS (SELECT repo_id, substr(md5(path), 1, 3) AS part, path || chr(9) || sha256(coalesce(content, '')) AS d FROM contents), p AS (SELECT repo_id, part, sha256(string_agg(d, chr(10) ORDER BY d)) AS d, count(*) AS n FROM d GROUP BY ALL)
SELECT repo_id, sha256(string_agg(d, chr(10) ORDER BY part)) AS fingerprint, sum(n)::BIGINT AS files FROM p GROUP BY ALL""",
        "contents"),
    "path_facts": with_views(
        f"""WITH t AS (SELECT *, string_split(path, '/') AS s FROM tree)
SELECT repo_id, path, s[-1] AS name, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS folder, {EXT.format(p="path")} AS extension, {SYNTAX.format(p="path")} AS syntax, {LANGUAGE.format(p="path")} AS language,
  {SENSITIVE.format(p="path")} AS sensitive, {BINARY.format(p="path")} AS binary, {GENERATED.format(p="path")} AS generated, {TEST.format(p="path")} AS test, {SKIPPED.format(p="path")} AS skipped,
  CASE len(s) WHEN 1 THEN '../x/y' WHEN 2 THEN 'x/y' ELSE array_to_string(s[:-3], '/') || '/x/y' END AS joined, NOT {SENSITIVE.format(p="path")} AS valid FROM t""",
        "tree"),
    "generated_contents": with_views(
        rf"""SELECT repo_id, path, {GENERATED.format(p="path")} OR coalesce(regexp_matches(left(content, 500), '(?i)(^|\n)\s*(//|#|/\*)\s*(auto-?generated|code generated by|do not edit|generated by)'), false) AS generated FROM
  (SELECT repo_id, path, CASE WHEN length(content) % 3 = 0 THEN '  # Auto-Generated by x' || chr(10) || content WHEN length(content) % 3 = 1 THEN 'generated by x' || chr(10) || content ELSE content END AS content FROM contents)""",
        "contents"),
    "page_routes": r"SELECT page_id, CASE WHEN r = '' THEN '/' ELSE r END AS route FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '/(\d+)', '/:id', 'g'), '^https?://[^/]+', ''), '/:[a-zA-Z0-9_]+', '/:param', 'g'), '/+$', '') AS r FROM pages)",
    "redacted_contents": with_views(
        f"""WITH r AS (SELECT *, {_redacted("content")} AS safe FROM contents)
SELECT repo_id, path, md5({_replaced(_replaced("coalesce(safe, '')", redact.ASSIGNED, redact.TOKEN), redact.KEY_BLOCK, "[REDACTED PRIVATE KEY]")}) AS scrubbed,
  md5({_replaced(_replaced(_replaced("content", redact.CONNECTION, "[redacted-connection]"), redact.LOGGED, chr(92) + "1[redacted]"), redact.SHAPES, "[redacted]")}) AS logged,
  CASE WHEN length(content) > 600 THEN 600 + 21 ELSE length(content) END AS cut, safe <> content AS redacted FROM r""",
        "contents"),
    "tree_language": with_views(
        f"""WITH t AS (SELECT repo_id, {looked_up(EXT.format(p="path"), MIX_LANGUAGES, "NULL")} AS language FROM tree WHERE NOT regexp_matches(path, 'tests/|test/|docs/|vendor/|node_modules/')), c AS (SELECT repo_id, language, count(*) AS files FROM t WHERE language IS NOT NULL GROUP BY ALL)
SELECT repo_id, language, files, row_number() OVER (PARTITION BY repo_id ORDER BY files DESC, language) AS position FROM c QUALIFY position <= 4""",
        "tree"),
    "repo_urls": r"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://github.com/Own' || page_id || '/Repo.git' WHEN 1 THEN 'own.x/re-po/tree/main' WHEN 2 THEN 'www.github.com/settings/x' WHEN 3 THEN url ELSE ' github.com/a_b/c ' END AS url FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Own' || page_id WHEN 1 THEN 'own.x' WHEN 4 THEN 'a_b' END AS owner, CASE page_id % 5 WHEN 0 THEN 'Repo' WHEN 1 THEN 're-po' WHEN 4 THEN 'c' END AS repo,
  CASE page_id % 5 WHEN 0 THEN 'https://github.com/own' || page_id || '/repo' WHEN 1 THEN 'https://github.com/own.x/re-po' WHEN 4 THEN 'https://github.com/a_b/c' END AS canonical FROM u""",
    "valid_values": with_views(
        r"""SELECT DISTINCT repo_id, path, regexp_matches(path, '^[A-Za-z0-9_][A-Za-z0-9_./-]{0,100}$') AND NOT contains(path, '..') AS branch, regexp_matches(md5(path), '^[0-9a-f]{7,64}$') AS sha, false AS short_sha, length(path) % 2 = 0 AS date FROM tree""",
        "tree"),
}
SQL = {k: v for k, v in SQL.items() if v}

QUERIES = {f.__name__: f for f in (explode_lines, line_metrics, line_findings, brace_nesting, repeated_blocks, vague_functions, maintainability, stored_findings, security_findings, size_findings, repeated_fetch, snapshot_fingerprint, redacted_contents, path_facts, generated_contents, page_routes, repo_urls, valid_values, tree_language)}
