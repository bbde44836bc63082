"""Communities by cutting long links, and the graph of notes that hidden notes link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import graph, order
from quillon.session import materialise, partitions

#: Cuts tried at most, how far a cut lies under a length, the largest fan-out.
CUTS, UNDER, MAX_FANOUT = 64, 1 - 1e-9, 64


def candidate_cuts(lengths: DataFrame) -> list[float]:
    """Cuts just under the distinct lengths above the mean, of many those at `CUTS` even places of
    their order; the largest length where all are equal."""
    mean, top = lengths.agg(F.avg("length"), F.max("length")).first()
    above = lengths.where(F.col("length") > F.lit(mean)).select("length").distinct() if mean is not None else None
    if above is None or above.isEmpty():
        return [top if top is not None else 0.0]
    ranked = materialise(order.numbered(above, ["length"]), "cuts")
    n = ranked.count()
    places = range(n) if n <= CUTS else sorted({i * (n - 1) // (CUTS - 1) for i in range(CUTS)})
    return sorted(r[0] * UNDER for r in ranked.where(F.col("index").isin(list(places))).select("length").collect())


def merge_tree(nodes: DataFrame, links: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """How a graph grows together as links of level 0, 1, .. `levels` - 1 join: merges (level,
    component, child, weight), the children of each component that a level makes, named by
    their smallest nodes, and joins (level, links), how many links have both ends in one
    component from that level on.

    nodes: (node, weight), numbered from 0 without gaps; links: (a, b, level). Links of `levels` or more
    never join. The range of levels is halved again and again. A half's problem has the
    components of all levels below as its nodes: a link whose ends meet in the lower half
    goes there, any other to the upper half between components. So each link is in one
    problem of a round, all problems of a round are labelled at once, and there are as many
    rounds as `levels` has binary digits.
    """
    size = 1 << max(0, levels - 1).bit_length()
    n = F.lit(max(1, nodes.count()))
    v = nodes.select(F.lit(0).cast("long").alias("low"), F.col("node").cast("long").alias("node"), F.col("weight").cast("long").alias("weight"))
    e = materialise(links.where("a != b").select(F.lit(0).cast("long").alias("low"), "a", "b", F.col("level").cast("long").alias("level")), "tree-links")
    place = lambda c: F.col("low") * n + F.col(c)
    while True:
        half = size // 2
        joint = e.where(F.col("level") < F.col("low") + max(half, 1)).select(place("a").alias("src"), place("b").alias("dst"))
        label = graph.linked_components(joint)
        top = lambda name, at: label.select(F.col("node").alias(at), (F.col("c") % n).alias(name))
        grown = v.withColumn("at", place("node")).join(top("top", "_at"), F.col("at") == F.col("_at"), "left").select("low", "node", "weight", F.col("top").isNotNull().alias("moved"), F.coalesce("top", "node").alias("top"))
        ends = e.withColumns({"_a": place("a"), "_b": place("b")}).join(top("ta", "_ta"), F.col("_a") == F.col("_ta"), "left").join(top("tb", "_tb"), F.col("_b") == F.col("_tb"), "left")
        ends = ends.select("low", "a", "b", "level", F.coalesce("ta", "a").alias("ta"), F.coalesce("tb", "b").alias("tb"))
        met = F.col("ta") == F.col("tb")
        if size == 1:
            merges = grown.where(F.col("moved") & (F.col("low") < levels)).select(F.col("low").alias("level"), F.col("top").alias("component"), F.col("node").alias("child"), "weight")
            return merges, ends.where(met & (F.col("low") < levels)).groupBy(F.col("low").alias("level")).agg(F.count("*").alias("links"))
        up = F.col("low") + half
        e = materialise(ends.select(F.when(met, F.col("low")).otherwise(up).alias("low"), F.when(met, F.col("a")).otherwise(F.col("ta")).alias("a"), F.when(met, F.col("b")).otherwise(F.col("tb")).alias("b"), "level"), "tree-links")
        # Nodes that the lower half leaves alone make no components there.
        above = grown.groupBy("low", "top").agg(F.sum("weight").alias("weight")).select(up.alias("low"), F.col("top").alias("node"), "weight")
        v = materialise(grown.where("moved").select("low", "node", "weight").union(above), "tree-nodes")
        size = half


def cut_communities(nodes: DataFrame, edges: DataFrame, lengths: DataFrame, cut: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Labels (node, label) and one row (count, cut, q, parted): links longer than a cut are taken
    away, and components of the cut with the best modularity (the smallest of equals, to twelve
    places) are the communities, numbered from 0 in order of their smallest node. `parted`
    is how many the cut made beyond the graph's own components.

    The cuts are levels of one merge tree: what a level joins changes how many components
    there are, the squares of their degrees and the links inside them, and running sums over at most 65
    levels are the modularities. lengths: (edge_id, length).
    """
    spark = edges.sparkSession
    cuts = [cut] if cut is not None else candidate_cuts(lengths)
    at = materialise(order.numbered(nodes.where("node is not null").select("node").distinct(), ["node"]), "cut-nodes")
    links = edges.join(lengths, "edge_id").join(at.select(F.col("node").alias("src"), F.col("index").alias("a")), "src").join(at.select(F.col("node").alias("dst"), F.col("index").alias("b")), "dst")
    level = F.coalesce(F.array_min(F.array(*[F.when(F.col("length") <= F.lit(float(c)), F.lit(k)) for k, c in enumerate(cuts)])), F.lit(len(cuts)))
    links = materialise(links.select("a", "b", level.cast("long").alias("level")), "cut-links")
    both = links.where("a != b").select(F.explode(F.array("a", "b")).alias("index")).groupBy("index").agg(F.count("*").alias("degree"))
    weighed = materialise(at.join(both, "index", "left").select(F.col("index").alias("node"), F.coalesce("degree", F.lit(0)).alias("weight")), "cut-degrees")
    n, start = weighed.agg(F.count("*"), F.coalesce(F.sum(F.col("weight").cast("double") * F.col("weight")), F.lit(0.0))).first()
    m = links.where("a != b").count()
    # One more level holds all longer links: the graph's own components.
    merges, joins = merge_tree(weighed, links, len(cuts) + 1)
    w = F.col("weight").cast("double")
    groups = merges.groupBy("level", "component").agg((F.count("*") - 1).alias("fewer"), (F.pow(F.sum(w), 2) - F.sum(w * w)).alias("more"))
    change = {r.level: r for r in groups.groupBy("level").agg(F.sum("fewer").alias("fewer"), F.sum("more").alias("more")).collect()}
    inner = {r.level: r.links for r in joins.collect()}
    count, squares, inside, best = n, start, 0, None
    for k in range(len(cuts) + 1):
        count -= change[k].fewer if k in change else 0
        if k == len(cuts):
            own = count
            break
        squares += change[k].more if k in change else 0
        inside += inner.get(k, 0)
        q = inside / m - squares / (4.0 * m * m) if m else 0.0
        if n and (best is None or round(q, 12) > round(best[2], 12)):
            best = (count, cuts[k], q, k)
    if best is None:
        return nodes.select("node", F.lit(0).cast("long").alias("label")), spark.createDataFrame([(1, float(cuts[0]), 0.0, 0)], "count long, cut double, q double, parted long")
    kept = links.where(F.col("level") <= best[3]).select(F.lit(0).alias("edge_id"), F.col("a").alias("src"), F.col("b").alias("dst"))
    mine = materialise(graph.components(at.select(F.col("index").alias("node")), kept).withColumnRenamed("node", "index"), "cut-labels")
    label = order.numbered(mine.select("component").distinct(), ["component"], "label")
    labels = mine.join(label, "component").join(at, "index").select("node", "label")
    return labels, spark.createDataFrame([(best[0], float(best[1]), float(best[2]), max(0, best[0] - own))], "count long, cut double, q double, parted long")


def is_landing(note_id: Column, course: Column) -> Column:
    """Whether a note is its course's landing page."""
    return F.coalesce(note_id, F.lit("")).endswith(F.concat(F.lit("/"), F.coalesce(course, F.lit("")), F.lit(".qmd")))


def is_star(note_id: Column, course: Column, week: Column) -> Column:
    return week.isNull() & ~is_landing(note_id, course)


def _hosted(notes: DataFrame, links: DataFrame, number: bool = False) -> tuple[DataFrame, DataFrame]:
    """Links (pos, a, b, sa, la, sb, lb) with their ends' kinds, written, and (pos, hidden, star) of those between a hidden note and a star.
    With `number`, ids of notes are numbered, as (na, nb) and (n)."""
    star, landing = is_star(F.col("id"), F.col("course"), F.col("week")), is_landing(F.col("id"), F.col("course"))
    kinds = notes.groupBy("id").agg(F.max(star).alias("star"), F.max(landing).alias("landing"))
    more = []
    if number:
        kinds, more = order.numbered(kinds.where("id is not null"), ["id"], "n"), ["n"]
    kind = lambda n: kinds.select(F.col("id").alias(n), F.col("star").alias(f"s{n}"), F.col("landing").alias(f"l{n}"), *[F.col(c).alias(f"{c}{n}") for c in more])
    e = links.join(kind("a"), "a", "left").join(kind("b"), "b", "left").fillna(False, ["sa", "la", "sb", "lb"])
    e = materialise(e, "notes-links")
    side = lambda star, hidden: e.where(f"s{star} and not s{hidden} and not l{hidden}").select("pos", F.col(hidden).alias("hidden"), F.col(star).alias("star"), *[F.col(f"{c}{star}").alias(c) for c in more])
    return e, side("a", "b").union(side("b", "a"))


def _met(hosted: DataFrame) -> DataFrame:
    return hosted.select("hidden", (F.row_number().over(Window.partitionBy("hidden").orderBy("pos")) - 1).alias("pos"), "star")


def notes_hosts(notes: DataFrame, links: DataFrame) -> DataFrame:
    """The hosts (hidden, pos, star) of `notes_graph` alone, for which no links are paired or numbered."""
    return _met(_hosted(notes, links)[1])


def notes_graph(notes: DataFrame, links: DataFrame, max_fanout: int = MAX_FANOUT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stars (pos, id, ...), links (ord, a, b) and hosts (hidden, pos, star).

    notes: (pos, id, course, week, ...), links: (pos, a, b), in feed order. A star is a note
    without week that is no landing page. A link of two stars is direct. A hidden note that
    is no landing page hosts the stars that it is linked with, in the order met; up to
    `max_fanout` of them (at most that many squared pairs a note) are linked with each other.
    Direct links come first, then the inherited by host in the order met; of equal pairs the
    first stays, and its direction. ord is the place from 0.
    """
    e, hosted = _hosted(notes, links, True)
    pair = F.shiftleft(F.least("na", "nb"), 32).bitwiseOR(F.greatest("na", "nb")).alias("pair")
    direct = e.where("sa and sb and a != b").groupBy(pair).agg(F.min(F.struct("pos", "a", "b")).alias("k"))
    direct = materialise(direct.select("pair", "k.*"), "notes-direct")
    small = hosted.groupBy("hidden").agg(F.count("*").alias("n")).where(F.col("n") <= max_fanout).select("hidden")
    lists = hosted.join(small, "hidden", "left_semi").groupBy("hidden").agg(F.min("pos").alias("met"), F.sort_array(F.collect_list(F.struct("pos", "star", "n"))).alias("l"))
    # Of the pairs that a host makes of one star and another, that of their first places comes first.
    once = F.expr("transform(filter(l, (x, i) -> array_position(l.n, x.n) = i + 1), x -> named_struct('star', x.star, 'n', x.n))")
    lists = materialise(order.numbered(lists.select("met", once.alias("l")), ["met"], "host").select("host", "l"), "notes-hosts")
    # Only numbers of pairs meet; a host then makes its pairs again, in order, without those met before.
    size = max_fanout * max_fanout
    made = lambda row: f"flatten(transform(l, (x, i) -> transform(slice(l, i + 2, size(l)), (y, j) -> named_struct({row}, 'code', i * {max_fanout} + i + 1 + j))))"
    dealt = lambda df: df.repartition(partitions(df.sparkSession), "host")  # small rows that make many pairs
    each = dealt(lists).select("host", F.explode(F.expr(made("'pair', shiftleft(least(x.n, y.n), 32) | greatest(x.n, y.n)"))).alias("x")).select("x.pair", (F.col("host") * size + F.col("x.code")).alias("place"))
    each = each.union(direct.select("pair", F.lit(-1).cast("long").alias("place")))
    nth = F.row_number().over(Window.partitionBy("pair").orderBy("place")).alias("nth")
    again = each.select("place", nth).where("nth > 1 and place >= 0")
    gone = again.groupBy(F.expr(f"place div {size}").alias("host")).agg(F.collect_list((F.col("place") % size).cast("int")).alias("gone"))
    left = lists.join(gone, "host", "left").select("host", "l", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    left = materialise(left.withColumn("kept", F.expr("cast(size(l) * (size(l) - 1) div 2 - size(gone) as bigint)")), "notes-left")
    before = order.running_total(left.select("host", "kept"), ["host"], "kept", "upto").select("host", (F.col("upto") - F.col("kept") + direct.count()).alias("before"))
    kept = F.posexplode(F.expr(f"filter({made("'a', x.star, 'b', y.star")}, z -> not array_contains(gone, z.code))")).alias("k", "x")
    inherited = dealt(left.join(before, "host")).select("before", kept).select((F.col("before") + F.col("k")).alias("ord"), "x.a", "x.b")
    out = order.numbered(direct.select("pos", "a", "b"), ["pos"], "ord").select("ord", "a", "b").union(inherited)
    star = is_star(F.col("id"), F.col("course"), F.col("week"))
    return notes.where(star), out, _met(hosted)
