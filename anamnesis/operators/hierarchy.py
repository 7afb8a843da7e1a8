"""Parent-child links to full hierarchies by Euler tours and parallel list ranking.

1. Nodes with exactly one parent hang in pieces: a piece is a tree below a root
   (no parent) or a junction (several parents).  Pointer doubling finds the top
   of every node in logarithmic rounds; what never finishes is on a circle of
   single-parent nodes or below one.
2. The junctions form a much smaller graph (top of a parent -> junction).
   Peeling it from its free side leaves exactly the junctions on circles or
   below them.
3. Each piece gets an Euler tour (an entry and an exit per node).  List ranking
   over the tour's predecessors gives entry, exit and level; ``u`` is above
   ``v`` if and only if its interval holds the entry of ``v``.  Containment is an
   equi-join on dyadic blocks of the tour, never a range scan.
4. Ways from roots are extended from junction to junction, and a node's path is
   the way to its top followed by its path within the piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.operators.chains import chain_roots, chain_state, neighbours, resolve
from anamnesis.session import cut


def clean_links(nodes: DataFrame, links: DataFrame, id_col: str, parent_col: str, child_col: str) -> tuple[DataFrame, DataFrame]:
    """Distinct ids, and distinct (p, c) links between them."""
    ids = nodes.select(F.col(id_col).alias("node")).where("node IS NOT NULL").distinct()
    pairs = links.select(F.col(parent_col).alias("p"), F.col(child_col).alias("c")).where("p IS NOT NULL AND c IS NOT NULL").distinct()
    pairs = pairs.join(ids.select(F.col("node").alias("p")), "p", "left_semi").join(ids.select(F.col("node").alias("c")), "c", "left_semi")
    return cut(ids), cut(pairs)


def euler_tours(single: DataFrame, members: DataFrame) -> DataFrame:
    """node, piece, entry, leave, level of every member; ``single`` holds the tree links (node, prev)."""
    sib = cut(neighbours(single.select(F.col("prev").alias("parent"), "node"), "parent", "node"))
    first = sib.where("prev IS NULL").select("parent", F.col("node").alias("head"))
    last = sib.where("next IS NULL").select("parent", F.col("node").alias("tail"))
    down, up = (lambda c: F.concat(F.lit("d"), c)), (lambda c: F.concat(F.lit("u"), c))
    prevs = (
        first.select(down(F.col("head")).alias("node"), down(F.col("parent")).alias("prev"))
        .unionByName(sib.where("prev IS NOT NULL").select(down(F.col("node")).alias("node"), up(F.col("prev")).alias("prev")))
        .unionByName(last.select(up(F.col("parent")).alias("node"), up(F.col("tail")).alias("prev")))
        .unionByName(members.join(first.select(F.col("parent").alias("node")), "node", "left_anti").select(up(F.col("node")).alias("node"), down(F.col("node")).alias("prev")))
    )
    elements = members.select(down(F.col("node")).alias("node"), F.lit(1).alias("pos"), F.lit(1).alias("lev")).unionByName(
        members.select(up(F.col("node")).alias("node"), F.lit(1).alias("pos"), F.lit(-1).alias("lev"))
    )
    ranked = chain_roots(prevs, elements, ["pos", "lev"])
    is_down = F.col("node").startswith("d")
    return (
        ranked.select(F.expr("substring(node, 2)").alias("node"), F.expr("substring(root, 2)").alias("piece"), is_down.alias("is_down"), "before_pos", "before_lev")
        .groupBy("node", "piece")
        .agg(F.max(F.when(F.col("is_down"), F.col("before_pos"))).alias("entry"), F.max(F.when(~F.col("is_down"), F.col("before_pos"))).alias("leave"), F.max(F.when(F.col("is_down"), F.col("before_lev"))).alias("level"))
    )


def above(tour: DataFrame) -> DataFrame:
    """(piece, node, node_level, over, over_level) of all nodes and those above them in their piece.

    An interval splits into at most two dyadic blocks per size; a point lies in
    one block of each size up to the size of its piece.
    """
    sizes = tour.where("entry = 0").select("piece", F.expr("CAST(ceil(log2(leave + 2)) AS INT)").alias("top_size"))
    low, high = "shiftright(entry + shiftleft(1L, k) - 1, k)", "shiftright(leave + 1, k)"
    spans = tour.where("leave > entry + 1").selectExpr(
        "piece", "node AS over", "level AS over_level",
        f"""explode(filter(flatten(transform(sequence(0, CAST(ceil(log2(leave + 2)) AS INT)), k -> array(
            IF({low} < {high} AND {low} % 2 = 1, named_struct('size', k, 'block', {low}), NULL),
            IF({low} < {high} AND {high} % 2 = 1, named_struct('size', k, 'block', {high} - 1), NULL)
        ))), x -> x IS NOT NULL)) AS b""",
    ).selectExpr("piece", "over", "over_level", "b.size AS size", "b.block AS block")
    points = tour.where("level > 0").join(sizes, "piece").selectExpr("piece", "node", "level AS node_level", "entry", "explode(sequence(0, top_size)) AS size").selectExpr("piece", "node", "node_level", "size", "shiftright(entry, size) AS block")
    return points.join(spans, ["piece", "size", "block"]).where("node <> over").select("piece", "node", "node_level", "over", "over_level")


def peel(junctions: DataFrame, edges: DataFrame) -> DataFrame:
    """Junctions that can be peeled: all their in-edges (src, dst) come from outside or from peeled ones.

    A round peels one more level of nested junctions.
    """
    free = junctions.select("node").join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    layers, edges = [free], cut(edges)
    while not edges.isEmpty():
        rest = cut(edges.join(layers[-1].select(F.col("node").alias("src")), "src", "left_anti"))
        nxt = cut(edges.select(F.col("dst").alias("node")).distinct().join(rest.select(F.col("dst").alias("node")), "node", "left_anti"))
        if nxt.isEmpty():
            break
        layers.append(nxt)
        edges = rest
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer)
    return out.distinct()


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) of everything reachable over the edges, each pair once.

    Every round joins what was found last with all that is known, on either side,
    so that the reach doubles: rounds grow with the logarithm of the longest way.
    """
    known = fresh = cut(edges.distinct())
    while not fresh.isEmpty():
        step = lambda a, b: a.join(b.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        new = cut(step(fresh, known).unionByName(step(known, fresh)).distinct().join(known, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            break
        known, fresh = known.unionByName(new), new
    return known


def link_hierarchy(nodes: DataFrame, links: DataFrame, id_col: str, parent_col: str, child_col: str) -> DataFrame:
    """One row for every way from a root down to a node: summary_id, root_id, node_level, node_path, n_below.

    Defined cases: null ids and links with an id that is not a node do not
    count; repeated nodes and links count once; a node linked to itself is a
    circle; nodes on or below a circle give one row with empty root and path, -1
    and -1; a node without links is its own root; no nodes, no rows; further
    columns are ignored.
    """
    ids, pairs = clean_links(nodes, links, id_col, parent_col, child_col)
    degree = pairs.groupBy(F.col("c").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("prev"))
    single = cut(degree.where("n = 1").select("node", "prev"))
    state = resolve(chain_state(single, ids, []), [])
    tops = state.where("done").select("node", F.col("ptr").alias("piece"))
    endless = state.where("NOT done").select("node")

    junctions = cut(degree.where("n > 1").select("node"))
    into = cut(pairs.join(junctions.select(F.col("node").alias("c")), "c", "left_semi").select("p", "c"))
    by_top = into.join(tops.select(F.col("node").alias("p"), "piece"), "p", "left").select(F.coalesce("piece", F.lit("")).alias("src"), F.col("c").alias("dst"), F.col("piece").isNull().alias("endless"))
    doomed = by_top.where("endless").select(F.col("dst").alias("src"), "dst").distinct()
    inner = by_top.where("NOT endless").select("src", "dst").distinct()
    inner = inner.join(junctions.select(F.col("node").alias("src")), "src", "left_semi").unionByName(doomed).distinct()
    peeled = peel(junctions, inner)
    bad_tops = junctions.join(peeled, "node", "left_anti").select(F.col("node").alias("piece"))
    good = tops.join(bad_tops, "piece", "left_anti")
    bad = endless.unionByName(tops.join(bad_tops, "piece", "left_semi").select("node"))

    members = tops.select("node")
    tour = cut(euler_tours(single.join(members, "node", "left_semi"), members))
    pairs_up = cut(above(tour))

    tails = pairs_up.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("over_level", "over"))).alias("up"))
    spot = tour.join(good.select("node"), "node", "left_semi").join(tails, "node", "left").select(
        "node", "piece", "level",
        F.expr("CASE WHEN level > 0 THEN concat('/', array_join(array_append(transform(slice(up, 2, size(up)), x -> x.over), node), '/')) ELSE '' END").alias("tail"),
    )
    spot = cut(spot)

    # Ways to the tops, from junction to junction.
    good_into = into.join(peeled.select(F.col("node").alias("c")), "c", "left_semi")
    exits = cut(spot.select(F.col("node").alias("p"), "piece", "level", "tail").join(good_into, "p").select("piece", "level", "tail", "c"))
    roots = good.where("node = piece").select("piece").join(junctions.select(F.col("node").alias("piece")), "piece", "left_anti")
    ways = fresh = cut(roots.select("piece", F.col("piece").alias("root_id"), F.lit(0).cast("bigint").alias("at"), F.col("piece").alias("path")))
    while True:
        fresh = cut(fresh.join(exits, "piece").select(F.col("c").alias("piece"), "root_id", (F.col("at") + F.col("level") + 1).alias("at"), F.concat("path", "tail", F.lit("/"), "c").alias("path")))
        if fresh.isEmpty():
            break
        ways = ways.unionByName(fresh)

    # Below a node: the rest of its piece, and the whole pieces of all junctions it reaches.
    sizes = tour.where("entry = 0").select(F.col("piece").alias("dst"), ((F.col("leave") + 1) / 2).cast("bigint").alias("size"))
    hop = into.join(tops.select(F.col("node").alias("p"), "piece"), "p").select(F.col("piece").alias("src"), F.col("c").alias("dst"))
    hop = hop.join(junctions.select(F.col("node").alias("src")), "src", "left_semi")
    reach = closure(hop)
    direct = into.select(F.col("p").alias("node"), F.col("c").alias("dst"))
    seen = direct.unionByName(pairs_up.join(direct, "node").select(F.col("over").alias("node"), "dst")).distinct()
    seen = seen.unionByName(seen.join(reach.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("node", F.col("far").alias("dst"))).distinct()
    more = seen.join(sizes, "dst").groupBy("node").agg(F.sum("size").alias("more"))
    below = tour.join(more, "node", "left").select("node", (F.expr("(leave - entry - 1) DIV 2") + F.coalesce("more", F.lit(0))).alias("n_below"))

    rows = spot.join(ways, "piece").join(below, "node").select(
        F.col("node").alias("summary_id"), "root_id", (F.col("at") + F.col("level")).cast("bigint").alias("node_level"), F.concat("path", "tail").alias("node_path"), F.col("n_below").cast("bigint").alias("n_below")
    )
    lost = bad.select(F.col("node").alias("summary_id"), F.lit("").alias("root_id"), F.lit(-1).cast("bigint").alias("node_level"), F.lit("").alias("node_path"), F.lit(-1).cast("bigint").alias("n_below"))
    return rows.unionByName(lost)
