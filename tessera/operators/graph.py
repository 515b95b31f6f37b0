"""Import graphs: fan-in, cycles, clusters, seams, reachability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tessera.operators.components import connected_components
from tessera.session import materialize, release


def fan_in(edges: DataFrame) -> DataFrame:
    """(dst, fan_in): distinct importers of (src, dst)."""
    return edges.select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("fan_in"))


def with_header_importers(edges: DataFrame, files: DataFrame) -> DataFrame:
    """edges, and for each C or C++ implementation the importers of the header with its stem."""
    stem = F.regexp_extract("path", r"^(.*)\.[^./]*$", 1)
    code = files.where(F.col("path").rlike(r"\.(?:c|cc|cpp|cxx)$")).select(stem.alias("stem"), F.col("path").alias("impl"))
    header = files.where(F.col("path").rlike(r"\.(?:h|hh|hpp|hxx)$")).select(stem.alias("stem"), F.col("path").alias("header"))
    pairs = code.join(header, "stem").select("impl", "header")
    more = edges.join(pairs, edges["dst"] == pairs["header"]).where(F.col("src") != F.col("impl")).select("src", F.col("impl").alias("dst"))
    return edges.select("src", "dst").unionByName(more).distinct()


def reach(edges: DataFrame, roots: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(root_kind, node): what roots (kind, path) reach over (src, dst), themselves included.

    Breadth first; each round's frontier joins the edges and leaves out what was reached, and both
    are written before the next round, so lineage does not grow.
    """
    edges = materialize(edges.select("src", "dst").distinct(), "edges")
    seen = frontier = materialize(roots.select(F.col("kind").alias("root_kind"), F.col("path").alias("node")).distinct(), "reached")
    for _ in range(max_rounds):
        following = frontier.join(edges, frontier["node"] == edges["src"]).select("root_kind", F.col("dst").alias("node")).distinct()
        following = materialize(following.join(seen, ["root_kind", "node"], "left_anti"), "frontier")
        if following.isEmpty():
            return seen
        grown = materialize(seen.unionByName(following), "reached")
        if seen is not frontier:
            release(frontier)
        release(seen)
        seen, frontier = grown, following
    raise RuntimeError(f"still reaching after {max_rounds} rounds")


def reach_labels(files: DataFrame, edges: DataFrame, roots: DataFrame, order: tuple[str, ...] = ("launched", "manual", "tests")) -> DataFrame:
    """(path, reach): the first kind of root that reaches each file, else `none`.

    Roots of other kinds, such as docs, launch nothing.  Languages whose imports do not say what is
    linked (files.lang other than python, javascript, typescript) have null.
    """
    found = reach(edges, roots.where(F.col("kind").isin(*order)))
    best = found.groupBy("node").agg(F.min(F.array_position(F.lit(list(order)), F.col("root_kind"))).alias("rank"))
    known = F.col("lang").isin("python", "javascript", "typescript")
    label = F.when(F.col("rank").isNull(), "none").otherwise(F.get(F.lit(list(order)), F.col("rank").cast("int") - 1))
    return files.join(best, files["path"] == best["node"], "left").select("path", F.when(known, label).alias("reach"))


def cycles(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, cycle): nodes on import cycles, with the least node of their strongly connected component.

    Nodes without an edge in or out are peeled away until none is left to peel.  What stays is
    coloured by the least node that reaches it; nodes that also reach the owner of their colour
    are one component, which is taken out, and the rest goes round again.  If max_rounds is not
    enough for any of these steps, RuntimeError is raised: no cycle is left out.
    """
    left = materialize(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    out = [edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("cycle")).distinct()]
    for _ in range(max_rounds):
        left = _peeled(left, max_rounds)
        if left.isEmpty():
            break
        colour = _least_ancestor(left, max_rounds)
        same = left.join(colour.select(F.col("node").alias("src"), F.col("least").alias("c")), "src").join(colour.select(F.col("node").alias("dst"), F.col("least").alias("d")), "dst").where("c = d")
        back = reach(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.where("node = least").select(F.lit("owner").alias("kind"), F.col("node").alias("path")), max_rounds)
        members = materialize(colour.join(back.select("node"), "node", "left_semi").select("node", F.col("least").alias("cycle")), "cycles")
        out.append(members)
        gone = members.select("node")
        left = materialize(left.join(gone, left["src"] == gone["node"], "left_anti").join(gone, F.col("dst") == gone["node"], "left_anti"), "edges")
    else:
        raise RuntimeError(f"cycles are left after {max_rounds} rounds")
    found = reduce(DataFrame.unionByName, out)
    return found.groupBy("node").agg(F.min("cycle").alias("cycle"))


def _peeled(edges: DataFrame, max_rounds: int) -> DataFrame:
    n = edges.count()
    for _ in range(max_rounds):
        starts, ends = edges.select(F.col("src").alias("x")).distinct(), edges.select(F.col("dst").alias("x")).distinct()
        less = materialize(edges.join(ends, edges["src"] == ends["x"], "left_semi").join(starts, F.col("dst") == starts["x"], "left_semi"), "edges")
        now = less.count()
        release(edges)
        edges = less
        if now == n:
            return edges
        n = now
    raise RuntimeError(f"still peeling after {max_rounds} rounds")


def _least_ancestor(edges: DataFrame, max_rounds: int) -> DataFrame:
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    state = materialize(nodes.withColumn("least", F.col("node")), "colours")
    for _ in range(max_rounds):
        sent = edges.join(state, edges["src"] == state["node"]).groupBy("dst").agg(F.min("least").alias("m"))
        after = state.join(sent, state["node"] == sent["dst"], "left").select("node", F.least("least", "m").alias("least"), "least")
        after = materialize(after.toDF("node", "least", "was"), "colours")
        settled = after.where("least <> was").isEmpty()
        release(state)
        state = after.select("node", "least")
        state._tessera_path = after._tessera_path
        if settled:
            return state
    raise RuntimeError(f"colours still move after {max_rounds} rounds")


def clusters(definitions: DataFrame, links: DataFrame) -> DataFrame:
    """(file, name, cluster): definitions of a file that reference each other or share state, by their least name.

    links has file, a, b.  A definition without links is a cluster of its own.
    """
    key = lambda c: F.concat_ws("\u0001", "file", c)
    found = connected_components(links.select(key("a").alias("x"), key("b").alias("y")), "x", "y")
    rows = definitions.withColumn("_k", key("name")).join(found, F.col("_k") == F.col("node"), "left")
    return rows.select("file", "name", F.substring_index(F.coalesce("component", "_k"), "\u0001", -1).alias("cluster"))


def seams(members: DataFrame, calls: DataFrame) -> DataFrame:
    """(file, a, b, seam): pairs of clusters of a file; a seam if no caller uses both.

    calls has file, name, caller.  Clusters without callers are left out.
    """
    callers = members.join(calls, ["file", "name"]).groupBy("file", "cluster").agg(F.collect_set("caller").alias("callers"))
    a, b = callers.toDF("file", "a", "callers_a"), callers.toDF("file", "b", "callers_b")
    return a.join(b, "file").where("a < b").select("file", "a", "b", (~F.arrays_overlap("callers_a", "callers_b")).alias("seam"))
