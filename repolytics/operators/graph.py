"""Dependency graphs: degrees, fans, cycles, neighbourhoods and summaries.

``edges`` is (repo_id, source, target, ...), ``files`` (repo_id, path, ...).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolytics.checkpoints import checkpointed
from repolytics.functions.paths import is_sensitive_path
from repolytics.operators.history import first_of


def dependents(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Reverse adjacency: the distinct sources of each modeled target."""
    return edges.join(files.select("repo_id", F.col("path").alias("target")).distinct(), ["repo_id", "target"], "left_semi").groupBy("repo_id", F.col("target").alias("path")).agg(F.array_sort(F.collect_set("source")).alias("dependents"))


def edge_index(edges: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Distinct edges without loops, those that files declare (repo_id, source, target) included."""
    rows = edges.select("repo_id", "source", "target")
    if declared is not None:
        rows = rows.unionByName(declared.select("repo_id", "source", "target"))
    return rows.filter((F.col("source") != F.col("target")) & (F.col("source") != "") & (F.col("target") != "")).distinct()


def degree_metrics(edges: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """In and out degree by rows of the edge table, and distinct reverse dependents by the whole index."""
    rows = edges.filter(F.col("source") != F.col("target"))
    ends = rows.select("repo_id", F.col("target").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(rows.select("repo_id", F.col("source").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    degree = ends.groupBy("repo_id", "path").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    back = edge_index(edges, declared).groupBy("repo_id", F.col("target").alias("path")).agg(F.count(F.lit(1)).alias("reverse_dependents"))
    return degree.join(back, ["repo_id", "path"], "full_outer").na.fill(0, ["in_degree", "out_degree", "reverse_dependents"])


def _internal(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct edges between modeled files that aren't sensitive."""
    known = files.filter(~is_sensitive_path(F.col("path"))).select("repo_id", "path").distinct()
    rows = edges.select("repo_id", "source", "target").distinct()
    return rows.join(known.withColumnRenamed("path", "source"), ["repo_id", "source"], "left_semi").join(known.withColumnRenamed("path", "target"), ["repo_id", "target"], "left_semi")


def fan_metrics(edges: DataFrame, files: DataFrame, least: int = 12) -> DataFrame:
    """Files with ``least`` outgoing or incoming modeled edges or more: ``rule`` and ``count``."""
    rows = _internal(edges, files)
    out = rows.groupBy("repo_id", F.col("source").alias("path")).agg(F.count(F.lit(1)).alias("count")).withColumn("rule", F.lit("high_fan_out"))
    back = rows.groupBy("repo_id", F.col("target").alias("path")).agg(F.count(F.lit(1)).alias("count")).withColumn("rule", F.lit("high_fan_in"))
    return out.unionByName(back).filter(F.col("count") >= least)


#: Edges of a repository up to which its components are found in one task.
SMALL_EDGES = 50_000


def _components(edges: pd.DataFrame) -> pd.DataFrame:
    """``repo_id, component, path`` of one small graph's nodes that lie on a cycle: two depth-first passes over plain lists."""
    ahead: dict[str, list[str]] = {}
    back: dict[str, list[str]] = {}
    for a, b in zip(edges["source"], edges["target"], strict=True):
        ahead.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    order: list[str] = []
    seen: set[str] = set()
    for root in ahead:
        todo = [(root, iter(ahead[root]))] if root not in seen else []
        seen.add(root)
        while todo:
            node, rest = todo[-1]
            step = next((n for n in rest if n not in seen), None)
            if step is None:
                order.append(node)
                todo.pop()
            else:
                seen.add(step)
                todo.append((step, iter(ahead.get(step, ()))))
    out: list[tuple[str, str]] = []
    taken: set[str] = set()
    for root in reversed(order):
        if root in taken:
            continue
        part, todo = [], [root]
        taken.add(root)
        while todo:
            node = todo.pop()
            part.append(node)
            new = [n for n in back.get(node, ()) if n not in taken]
            taken.update(new)
            todo += new
        if len(part) > 1 or root in ahead.get(root, ()):
            out += [(min(part), n) for n in part]
    return pd.DataFrame({"repo_id": edges["repo_id"].iloc[0], "component": [c for c, _ in out], "path": [n for _, n in out]})


def dependency_cycles(edges: DataFrame, files: DataFrame, *, small: int | None = None) -> DataFrame:
    """``repo_id, component, path`` of every file that lies on a cycle; the component is its smallest path.

    A repository of ``small`` edges at most is done by one task.  A larger one is
    done in rounds: nodes without an edge in or out are trimmed; then the smallest
    path is spread along the edges, and back from where it began.  A node that both
    reach is in that path's component and leaves the graph.  Each round works on
    what is left and is written to the checkpoint folder.
    """
    graph = checkpointed(_internal(edges, files))
    sizes = graph.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    large = checkpointed(sizes.filter(F.col("n") > (SMALL_EDGES if small is None else small)).select("repo_id"))
    few = graph.join(large, "repo_id", "left_anti").groupBy("repo_id").applyInPandas(_components, "repo_id string, component string, path string")
    if large.isEmpty():
        return few
    graph = graph.join(large, "repo_id", "left_semi")
    loops = graph.filter(F.col("source") == F.col("target")).select("repo_id", F.col("source").alias("component"), F.col("source").alias("path"))
    rest = graph.filter(F.col("source") != F.col("target"))
    done = loops
    while True:
        rest = _trimmed(rest)
        if rest.isEmpty():
            return few.unionByName(_merged(done))
        ahead = _spread(rest, "source", "target")
        # Backwards only inside one colour, from the node that gave it.
        inside = rest.join(ahead.withColumnRenamed("path", "source").withColumnRenamed("label", "a"), ["repo_id", "source"]).join(ahead.withColumnRenamed("path", "target").withColumnRenamed("label", "b"), ["repo_id", "target"]).filter(F.col("a") == F.col("b")).select("repo_id", "source", "target")
        back = _reach(inside, ahead.filter(F.col("path") == F.col("label")).select("repo_id", "path", "label"))
        found = checkpointed(back.select("repo_id", F.col("label").alias("component"), "path"))
        sizes = found.groupBy("repo_id", "component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        done = done.unionByName(found.join(sizes.select("repo_id", "component"), ["repo_id", "component"], "left_semi"))
        gone = found.select("repo_id", "path")
        rest = checkpointed(rest.join(gone.withColumnRenamed("path", "source"), ["repo_id", "source"], "left_anti").join(gone.withColumnRenamed("path", "target"), ["repo_id", "target"], "left_anti"))


def _merged(rows: DataFrame) -> DataFrame:
    """A self-loop inside a larger component belongs to that one."""
    return rows.groupBy("repo_id", "path").agg(F.min("component").alias("component")).select("repo_id", "component", "path")


def _trimmed(rest: DataFrame) -> DataFrame:
    """Without nodes that lack an edge in or out; each round takes some, so it ends."""
    count = rest.count()
    while True:
        keep = rest.select("repo_id", F.col("source").alias("x")).distinct().join(rest.select("repo_id", F.col("target").alias("x")).distinct(), ["repo_id", "x"], "left_semi")
        rest = checkpointed(rest.join(keep.withColumnRenamed("x", "source"), ["repo_id", "source"], "left_semi").join(keep.withColumnRenamed("x", "target"), ["repo_id", "target"], "left_semi"))
        left = rest.count()
        if left == count:
            return rest
        count = left


def _spread(rest: DataFrame, a: str, b: str) -> DataFrame:
    """The smallest path from which each node can be reached along the edges (itself included).

    Each round takes the labels one edge on, and on to what the label's own node is
    labelled with by then, so that long chains settle in few rounds.
    """
    labels = checkpointed(rest.select("repo_id", F.col(a).alias("path")).union(rest.select("repo_id", F.col(b).alias("path"))).distinct().withColumn("label", F.col("path")))
    while True:
        sent = rest.join(labels.withColumnRenamed("path", a), ["repo_id", a]).groupBy("repo_id", F.col(b).alias("path")).agg(F.min("label").alias("offer"))
        moved = labels.join(sent, ["repo_id", "path"], "left").select("repo_id", "path", F.least("label", "offer").alias("next"), F.col("label").alias("old"))
        # What reaches the label's node reaches this one as well.
        jumped = moved.join(labels.select("repo_id", F.col("path").alias("next"), F.col("label").alias("further")), ["repo_id", "next"])
        moved = checkpointed(jumped.select("repo_id", "path", F.least("next", "further").alias("label"), (F.least("next", "further") < F.col("old")).alias("moved")))
        labels = moved.select("repo_id", "path", "label")
        if moved.filter("moved").isEmpty():
            return labels


def _reach(inside: DataFrame, seeds: DataFrame) -> DataFrame:
    """All nodes from which the seed of their label can be reached, with that label."""
    seen, front = seeds, seeds
    while True:
        front = inside.join(front.withColumnRenamed("path", "target"), ["repo_id", "target"]).select("repo_id", F.col("source").alias("path"), "label").distinct()
        front = checkpointed(front.join(seen, ["repo_id", "path"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = checkpointed(seen.unionByName(front))


def neighborhood(edges: DataFrame, files: DataFrame, hops: int = 1) -> DataFrame:
    """``repo_id, file, path``: what lies within ``hops`` edges of each file (repo_id, path), in either direction."""
    links = edges.select("repo_id", "source", "target").union(edges.select("repo_id", "target", "source")).toDF("repo_id", "a", "b").distinct()
    near = files.select("repo_id", F.col("path").alias("file"), "path").distinct()
    for _ in range(hops):
        near = near.union(near.join(links, (near["repo_id"] == links["repo_id"]) & (near["path"] == links["a"])).select(near["repo_id"], "file", F.col("b").alias("path"))).distinct()
    return near


def subgraph_edges(edges: DataFrame, near: DataFrame, *, relation: str | None = None) -> DataFrame:
    """Edges of each file's neighbourhood, of one ``relation`` if given: both ends lie in it."""
    if relation is not None:
        edges = edges.filter(F.col("type") == relation)
    ends = near.select("repo_id", "file", "path")
    return edges.join(ends.withColumnRenamed("path", "source"), ["repo_id", "source"]).join(ends.withColumnRenamed("path", "target"), ["repo_id", "target", "file"], "left_semi").select("repo_id", "file", "source", "target")


def ego_edges(edges: DataFrame, files: DataFrame, *, relation: str | None = None) -> DataFrame:
    """Edges of each file's neighbourhood of one hop, of one ``relation`` if given: :func:`subgraph_edges` of :func:`neighborhood`.

    A file has the edges that begin or end at it, and those between two that it is
    linked with: the third side of a triangle.  Each triangle is found once, from
    its node of fewest links, whose links to nodes of more are few (at most the root
    of twice all links), however many a node may have.  So no edge is met with every
    file near its source, and what is found isn't shuffled again.
    """
    edges = edges.filter("repo_id IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL")
    counted = F.lit(1) if relation is None else F.when(F.col("type") == relation, 1).otherwise(0)
    rows = edges.select("repo_id", "source", "target", counted.alias("n"))
    first = F.col("source") < F.col("target")
    links = rows.filter("source <> target").groupBy("repo_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    links = links.agg(F.sum(F.when(first, F.col("n")).otherwise(0)).cast("int").alias("ab"), F.sum(F.when(first, 0).otherwise(F.col("n"))).cast("int").alias("ba"))
    ends = links.select("repo_id", F.explode(F.array("a", "b")).alias("path"), F.lit(1).alias("d"), F.lit(False).alias("f"))
    nodes = ends.unionByName(files.select("repo_id", "path", F.lit(0).alias("d"), F.lit(True).alias("f"))).groupBy("repo_id", "path").agg(F.sum("d").alias("d"), F.max("f").alias("f")).filter("d > 0")
    for end in ("a", "b"):
        links = links.join(nodes.select("repo_id", F.col("path").alias(end), F.col("d").alias(f"d{end}"), F.col("f").alias(f"f{end}")), ["repo_id", end])
    # Which end is the lower one: that of fewer links, and of equally many the first.
    links = checkpointed(links.select("repo_id", "a", "b", "ab", "ba", "fa", "fb", (F.col("da") <= F.col("db")).alias("low")))

    def given(file: Column, known: Column, sides: list[tuple[Column, Column, Column]]) -> Column:
        """(file, source, target) for each edge of ``sides``, if ``file`` is ``known``."""
        found = F.flatten(F.array(*[F.array_repeat(F.struct(file.alias("file"), s.alias("source"), t.alias("target")), n) for s, t, n in sides]))
        return F.when(known, found).otherwise(F.slice(found, 1, 0))

    c = F.col
    own = [(c("a"), c("b"), c("ab")), (c("b"), c("a"), c("ba"))]
    out = links.select("repo_id", F.inline(F.concat(given(c("a"), c("fa"), own), given(c("b"), c("fb"), own))))
    # ``to`` are a link's edges from the low node, ``fro`` those to it.
    low = c("low")
    arms = links.select(
        "repo_id", F.when(low, c("a")).otherwise(c("b")).alias("u"), F.when(low, c("fa")).otherwise(c("fb")).alias("fu"),
        F.struct(F.when(low, c("b")).otherwise(c("a")).alias("p"), F.when(low, c("ab")).otherwise(c("ba")).alias("to"), F.when(low, c("ba")).otherwise(c("ab")).alias("fro"), F.when(low, c("fb")).otherwise(c("fa")).alias("f")).alias("arm"),
    )
    arms = arms.groupBy("repo_id", "u", "fu").agg(F.array_sort(F.collect_list("arm")).alias("arms")).filter(F.size("arms") > 1)
    wedges = arms.select("repo_id", "u", "fu", "arms", F.posexplode("arms").alias("i", "x")).select("repo_id", "u", "fu", "x", F.explode(F.slice("arms", c("i") + 2, F.size("arms"))).alias("y"))
    wedges = wedges.withColumns({"a": c("x.p"), "b": c("y.p")})
    both = wedges.hint("merge").join(links.select("repo_id", "a", "b", "ab", "ba").hint("merge"), ["repo_id", "a", "b"])
    u = c("u")
    thirds = F.concat(
        given(u, c("fu"), own),
        given(c("a"), c("x.f"), [(u, c("b"), c("y.to")), (c("b"), u, c("y.fro"))]),
        given(c("b"), c("y.f"), [(u, c("a"), c("x.to")), (c("a"), u, c("x.fro"))]),
    )
    out = out.unionByName(both.select("repo_id", F.inline(thirds)))
    loops = rows.filter("source = target AND n > 0")
    if loops.isEmpty():
        return out
    # A loop belongs to its file and to each that is linked with it.
    near = links.select("repo_id", F.explode(F.array(F.struct(c("a").alias("source"), c("b").alias("file"), c("fb").alias("f")), F.struct(c("b").alias("source"), c("a").alias("file"), c("fa").alias("f")))).alias("x")).select("repo_id", "x.*").filter("f").drop("f")
    near = near.unionByName(files.select("repo_id", c("path").alias("source"), c("path").alias("file")).distinct())
    return out.unionByName(loops.join(near, ["repo_id", "source"]).select("repo_id", "file", "source", "target"))


def graph_summary(files: DataFrame, edges: DataFrame, layers: DataFrame, entry_points: DataFrame, routes: DataFrame, models: DataFrame) -> DataFrame:
    """Counts of each repository's parts."""
    parts = [(files, "files"), (edges, "edges"), (layers.select("repo_id", "layer").distinct(), "layers"), (entry_points, "entry_points"), (routes, "routes"), (models, "data_models")]
    rows = None
    for df, name in parts:
        one = df.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("repo_id").agg(*[F.coalesce(F.max(F.when(F.col("part") == name, F.col("n"))), F.lit(0)).alias(name) for _, name in parts])


def layer_edges(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Edges between different layers; a file belongs to the first layer (by name) that lists it."""
    first = layers.groupBy("repo_id", "path").agg(F.min("layer").alias("layer"))
    rows = edges.join(first.select("repo_id", F.col("path").alias("source"), F.col("layer").alias("source_layer")), ["repo_id", "source"]).join(first.select("repo_id", F.col("path").alias("target"), F.col("layer").alias("target_layer")), ["repo_id", "target"])
    return rows.filter(F.col("source_layer") != F.col("target_layer")).groupBy("repo_id", "source_layer", "target_layer").agg(F.count(F.lit(1)).alias("edges"))


# Points of a node.
NODE_POINTS = {"selected": 1000, "entry": 50, "route": 30, "model": 30, "core": 20, "degree": 3}
CORE_ROLES = ("service", "controller", "model", "backend-route")


def important_nodes(files: DataFrame, edges: DataFrame, entry_points: DataFrame, routes: DataFrame, models: DataFrame, *, selected: DataFrame | None = None, limit: int | None = 80) -> DataFrame:
    """Files (repo_id, path, category) ranked by points for what they hold and how they are linked."""
    p = NODE_POINTS
    degree = edges.select("repo_id", F.col("source").alias("path")).unionAll(edges.select("repo_id", F.col("target").alias("path"))).groupBy("repo_id", "path").agg((F.count(F.lit(1)) * p["degree"]).alias("points"))

    def flag(df: DataFrame, col: str, points: int) -> DataFrame:
        return df.select("repo_id", F.col(col).alias("path")).distinct().withColumn("points", F.lit(points).cast("long"))

    rows = degree.unionByName(flag(entry_points, "path", p["entry"])).unionByName(flag(routes, "file", p["route"])).unionByName(flag(models, "file", p["model"])).unionByName(flag(files.filter(F.col("category").isin(*CORE_ROLES)), "path", p["core"]))
    if selected is not None:
        rows = rows.unionByName(flag(selected, "path", p["selected"]))
    score = rows.groupBy("repo_id", "path").agg(F.sum("points").alias("points"))
    out = files.select("repo_id", "path").distinct().join(score, ["repo_id", "path"], "left").select("repo_id", "path", F.coalesce("points", F.lit(0)).alias("points"))
    return first_of(out, ["repo_id"], [F.desc("points"), F.asc("path")], limit)
