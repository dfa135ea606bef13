"""Graph operators as rounds of joins; every round is a table in the shared folder.

Edges are (a, b). Rounds carry only what is new (semi-naive), closures double their reach each
round, and no round gathers a node's neighbours into a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.shared import shuffled
from graphloom.plans.shared import written as cut


def ancestors(edges: DataFrame, reflexive: bool = False) -> DataFrame:
    """(child, parent) -> (node, anc): every ancestor of every node.

    A node is its own ancestor only inside a cycle, or everywhere if ``reflexive``. Path doubling:
    the number of rounds is the logarithm of the longest shortest path. After a round all pairs of
    at most ``reach`` steps are known with their steps; a shortest path that is longer begins with
    one of exactly ``reach``, so those alone are carried on, and a tree's pair is met once.
    """
    pair = cut(edges.select(F.col("child").alias("node"), F.col("parent").alias("anc"), F.lit(1).alias("steps")).filter("node is not null and anc is not null").distinct())
    reach = 1
    while not (far := pair.filter(F.col("steps") == reach)).isEmpty():
        right = pair.select(F.col("node").alias("mid"), "anc", "steps")
        met = far.select("node", F.col("anc").alias("mid")).join(shuffled(right), "mid").groupBy("node", "anc").agg((F.min("steps") + reach).alias("steps"))
        pair = pair.unionByName(cut(met.join(shuffled(pair.select("node", "anc")), ["node", "anc"], "left_anti")))
        reach *= 2
    pair = pair.select("node", "anc")
    if reflexive:
        nodes = edges.select(F.col("child").alias("node")).unionByName(edges.select(F.col("parent").alias("node"))).filter("node is not null").distinct()
        pair = pair.unionByName(nodes.select("node", F.col("node").alias("anc"))).distinct()
    return pair


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b) and (node) -> (node): what can be reached from the roots, these included."""
    seen = cut(roots.select("node").filter("node is not null").distinct())
    front = seen
    while True:
        step = front.join(edges, front["node"] == edges["a"]).select(edges["b"].alias("node")).filter("node is not null").distinct()
        front = cut(step.join(seen, "node", "left_anti"))
        if front.limit(1).count() == 0:
            return seen
        seen = cut(seen.unionByName(front))


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges (a, b) less those that begin where none ends or end where none begins, and their number.

    Goes on while a round takes away a tenth, so long chains do not cost a round for each node.
    """
    edges = cut(edges)
    now = edges.count()
    while now:
        last, begins, ends = now, edges.select(F.col("a").alias("b")).distinct(), edges.select(F.col("b").alias("a")).distinct()
        edges = cut(edges.join(ends, "a", "left_semi").join(begins, "b", "left_semi").select("a", "b"))
        now = edges.count()
        if now > 0.9 * last:
            break
    return edges, now


def _least_before(edges: DataFrame, hops: int = 3) -> DataFrame:
    """(a, b) -> (node, colour): the smallest node from which a node is reached, itself included.

    Rounds of ``hops`` steps each; a step brings partial minima together, never a node's neighbours.
    """
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    colour, last = cut(ends.select("node", F.col("node").alias("colour"))), None
    while True:
        state = colour.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "colour").cast("decimal(38,0)"))).first()
        if state == last:
            return colour
        last = state
        for _ in range(hops):
            step = colour.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node"), "colour")
            colour = colour.unionByName(step).groupBy("node").agg(F.min("colour").alias("colour"))
        colour = cut(colour)


def _named(nodes: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """``column`` replaced by its name in ``names`` (node, name) where it has one."""
    other = names.select(F.col("node").alias("_node"), F.col("name").alias("_name"))
    return nodes.join(other, F.col(column) == F.col("_node"), "left").withColumn(column, F.coalesce("_name", column)).drop("_node", "_name")


def _merged_pairs(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges with the ends of two-way edges made one node, and (node, name) of those that were."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    mutual = cut(edges.join(back, ["a", "b"], "left_semi").filter("a < b"))
    if mutual.isEmpty():
        return edges, None
    names = cut(components(mutual).select("node", F.col("root").alias("name")))
    return cut(_named(_named(edges, "a", names), "b", names).filter("a <> b").distinct()), names


def _bypassed(edges: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Edges with chains (nodes of one edge in and one out) taken out, (node, head, tail) of their
    nodes, and the nodes of chains that close on themselves as edges.

    Each chain node points at the nodes before and after it; pointers double their reach each round.
    """
    one = lambda end, other: edges.groupBy(F.col(end).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min(other).alias("to")).filter("n = 1").select("node", "to")
    chain = cut(one("b", "a").withColumnRenamed("to", "up").join(one("a", "b").withColumnRenamed("to", "down"), "node"))
    n = chain.count()
    if not n:
        return edges, None, None
    inner = chain.select("node")
    for _ in range(n.bit_length() + 1):
        ahead = lambda c: chain.select(F.col("node").alias(c), F.col(c).alias(f"{c}_far"))  # noqa: E731, B023
        step = chain.join(ahead("up"), "up", "left").join(ahead("down"), "down", "left").select("node", F.coalesce("up_far", "up").alias("up"), F.coalesce("down_far", "down").alias("down"))
        chain = cut(step)
        if chain.join(inner.withColumnRenamed("node", "up"), "up", "left_semi").isEmpty():
            break
    closed = cut(chain.join(inner.withColumnRenamed("node", "up"), "up", "left_semi").select("node"))
    told = chain.join(closed, "node", "left_anti")
    rest = edges.join(inner.withColumnRenamed("node", "a"), "a", "left_anti").join(inner.withColumnRenamed("node", "b"), "b", "left_anti")
    more = told.filter("up <> down").select(F.col("up").alias("a"), F.col("down").alias("b"))
    rings = None if closed.isEmpty() else edges.join(closed.withColumnRenamed("node", "a"), "a", "left_semi")
    return cut(rest.unionByName(more).distinct()), told.select("node", F.col("up").alias("head"), F.col("down").alias("tail")), rings


#: Edges from which on a graph is made smaller before its closure is looked at; a closure of fewer has at most so many pairs squared.
FEW_EDGES = 1000


def _by_closure(edges: DataFrame) -> DataFrame:
    """(node, name) of nodes in components of two or more, for a graph of few edges: who reaches each other."""
    up = cut(ancestors(edges.select(F.col("a").alias("child"), F.col("b").alias("parent"))).filter("node <> anc"))
    back = up.select(F.col("anc").alias("node"), F.col("node").alias("anc"))
    return up.join(back, ["node", "anc"], "left_semi").groupBy("node").agg(F.least(F.min("anc"), F.col("node")).alias("name"))


def cycles(edges: DataFrame) -> DataFrame:
    """(child, parent) -> (root, node): strongly connected components of two nodes or more, and self-loops.

    ``root`` is the component's smallest node. The graph is made small first, in rounds that are the
    logarithm of the longest chain: edges that are in no cycle are trimmed, the ends of two-way edges
    become one node, and chains become one edge, until FEW_EDGES are left, whose closure says the
    rest. A graph that does not get smaller in this way is coloured: each node takes the smallest node
    before it and the smallest after it, and where both are one node that is its component; the rest
    is judged again, with those edges only whose ends agree in both. Then what was made small is
    unfolded: a chain belongs to a component if both its ends do.
    """
    known = cut(edges.select(F.col("child").alias("a"), F.col("parent").alias("b")).filter("a is not null and b is not null").distinct())
    loops = known.filter("a = b").select(F.col("a").alias("root"), F.col("a").alias("node"))
    left, n = _trimmed(known.filter("a <> b"))
    folded: list[tuple[str, DataFrame]] = []
    named = None  # (node, name): nodes of a component have one name
    while n > FEW_EDGES:
        last = n
        left, names = _merged_pairs(left)
        folded += [("names", names)] if names is not None else []
        left, chains, rings = _bypassed(left)
        if chains is not None:
            folded.append(("chains", chains))
        if rings is not None:
            ring = components(rings).select("node", F.col("root").alias("name"))
            named = ring if named is None else named.unionByName(ring)
        left, n = _trimmed(left)
        if n > 0.7 * last:
            break
    while n > FEW_EDGES:
        before, after = _least_before(left), _least_before(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = cut(before.withColumnRenamed("colour", "first").join(after.withColumnRenamed("colour", "last"), "node"))
        found = both.filter("first = last").select("node", F.col("first").alias("name"))
        named = found if named is None else named.unionByName(found)
        end = lambda c: both.filter("first <> last").select(F.col("node").alias(c), F.struct("first", "last").alias(f"of_{c}"))  # noqa: E731, B023
        left, n = _trimmed(left.join(end("a"), "a").join(end("b"), "b").filter("of_a = of_b").select("a", "b"))
    if n:
        few = _by_closure(left)
        named = few if named is None else named.unionByName(few)
    if named is None and not folded:
        return loops
    node = known.schema["a"].dataType.simpleString()
    named = known.sparkSession.createDataFrame([], f"node {node}, name {node}") if named is None else named
    for kind, part in reversed(folded):
        named = cut(named)
        if kind == "names":  # nodes that became one have the name of that one, or its own
            more = _named(part, "name", named)
            named = named.join(more.select("node"), "node", "left_anti").unionByName(more)
        else:
            ends = part.withColumn("at_head", F.col("head")).withColumn("at_tail", F.col("tail"))
            met = _named(_named(ends, "head", named), "tail", named).filter("head = tail")
            more = met.select("node", F.col("head").alias("name"))
            # an end that was in no component so far is in one with a chain back to itself
            own = met.select(F.explode(F.array(F.struct(F.col("at_head").alias("node"), F.col("head").alias("name")), F.struct(F.col("at_tail").alias("node"), F.col("tail").alias("name")))).alias("x")).select("x.node", "x.name").distinct()
            named = named.unionByName(more).unionByName(own.join(named.select("node"), "node", "left_anti"))
    roots = named.groupBy("name").agg(F.min("node").alias("root"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("name", "root")
    found = named.join(roots, "name").select("root", "node")
    return found.unionByName(loops.join(found.select("node"), "node", "left_anti").select("root", "node"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): undirected components; ``root`` is the smallest node.

    Large-star and small-star rounds; hubs only meet partial minima.
    """
    e = edges.filter("a is not null and b is not null")
    loops = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct()
    now, last = cut(e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        wide = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        floor = wide.groupBy("hi").agg(F.min("lo").alias("m"))
        tight = wide.join(floor, "hi")
        pairs = tight.select(F.col("lo").alias("x"), F.col("m").alias("y")).unionByName(tight.select(F.col("hi").alias("x"), F.col("m").alias("y")))
        now = cut(pairs.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    roots = now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    return loops.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def pairs_held(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, has), (a, b) -> (node, a, b): pairs a < b both of whose ends are in a node's sorted set.

    Equal sets are judged once, by their own pairs, so a class that many nodes have does not meet
    all the pairs that it is in. A set meets what it holds by its key, not by its members.
    """
    sets = cut(sets.filter("size(has) > 1").select("node", "has", set_key(F.col("has")).alias("kind")))
    return sets.select("node", "kind").join(shuffled(kinds_held(sets.select("kind", "has").distinct(), pairs)), "kind").select("node", "a", "b")


def kinds_held(kinds: DataFrame, pairs: DataFrame) -> DataFrame:
    """(kind, has), (a, b) -> (kind, a, b): the pairs in each kind of set, of which there is one row."""
    first = kinds.select("kind", "has", F.posexplode("has").alias("i", "a"))
    each = first.select("kind", "a", F.explode(F.slice("has", F.col("i") + 2, F.size("has"))).alias("b"))
    return cut(each.join(shuffled(pairs.select("a", "b").distinct()), ["a", "b"]).select("kind", "a", "b"))


def set_key(members: Column) -> Column:
    """16 bytes that stand for a sorted set."""
    return F.unhex(F.md5(F.to_json(members)))


def list_members(quads: DataFrame, heads: DataFrame, first: str, rest: str, nil: str, max_hops: int = 1000) -> DataFrame:
    """(head) -> (head, pos, member): walks of linked lists, at most ``max_hops`` long.

    Pointer jumping: after each round a cell knows the cell 2^n steps on, so a list of length n
    takes log n rounds; a list that closes on itself ends at ``max_hops``.
    """
    cells = quads.filter(F.col("p") == first).select(F.col("s").alias("cell"), F.col("o").alias("member"))
    nexts = quads.filter((F.col("p") == rest) & (F.col("o") != nil)).select(F.col("s").alias("cell"), F.col("o").alias("next"))
    walk = cut(heads.select("head", F.col("head").alias("cell"), F.lit(0).alias("pos")).distinct())
    jump, reach = cut(nexts.distinct()), 1
    while reach <= max_hops:
        new = walk.join(shuffled(jump), "cell").select("head", F.col("next").alias("cell"), (F.col("pos") + reach).alias("pos")).filter(F.col("pos") < max_hops)
        if new.limit(1).count() == 0:
            break
        walk = cut(walk.unionByName(new))
        ahead = jump.select(F.col("cell").alias("next"), F.col("next").alias("far"))
        jump = cut(jump.join(shuffled(ahead), "next").select("cell", F.col("far").alias("next")))
        reach *= 2
    return walk.join(shuffled(cells), "cell").select("head", "pos", "member")


def neighbourhood(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(facet, node, other) one hop around ``nodes``; ``edges``: (facet, a, b), read both ways."""
    out = edges.join(nodes, edges["a"] == nodes["node"]).select("facet", "node", F.col("b").alias("other"))
    back = edges.join(nodes, edges["b"] == nodes["node"]).select(F.concat(F.lit("of_"), F.col("facet")).alias("facet"), "node", F.col("a").alias("other"))
    return out.unionByName(back).distinct()


def display_forest(classes: DataFrame, edges: DataFrame, paths: bool = False) -> DataFrame:
    """(iri, label), (child, parent) -> (node, parent, root, depth, branch, extra, standalone): a forest for display.

    Of its declared parents that are in no cycle with it a class keeps the one first by label, then
    IRI; ``extra`` counts the others. ``branch`` is the class with all that hang below it in the
    forest, ``depth`` its steps to the root. A class with neither parent nor child in the forest is
    standalone. With ``paths`` a column ``path`` of IRIs from the root to the class is added.

    No closure is made: each class points 2^n steps up after n rounds and sends what it counts
    there, so the rounds are the logarithm of the depth, and sums are combined before they meet.
    """
    named = classes.filter("iri is not null").groupBy("iri").agg(F.min("label").alias("label"))
    pair = edges.select("child", "parent").filter("child <> parent").distinct()
    known = pair.join(named.select(F.col("iri").alias("child")), "child", "left_semi").join(named.withColumnRenamed("iri", "parent"), "parent")
    ring = cycles(known.select("child", "parent"))
    side = lambda c: ring.select(F.col("node").alias(c), F.col("root").alias(f"{c}_ring"))
    open_ = known.join(side("child"), "child", "left").join(side("parent"), "parent", "left").filter("child_ring is null or parent_ring is null or child_ring <> parent_ring")
    chosen = open_.groupBy(F.col("child").alias("node")).agg(F.min_by("parent", F.struct(F.coalesce("label", "parent"), "parent")).alias("parent"), (F.count(F.lit(1)) - 1).alias("extra"))
    start = named.select(F.col("iri").alias("node")).join(chosen, "node", "left")
    state = start.select(
        "node", "parent", F.coalesce("extra", F.lit(0)).alias("extra"), F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), F.coalesce("parent", "node").alias("root"),
        F.lit(1).cast("long").alias("branch"), *([F.when(F.col("parent").isNull(), F.array("node")).otherwise(F.array("parent", "node")).alias("path")] if paths else []),
    )
    while True:
        state = cut(state)
        if state.filter("up is not null").isEmpty():
            break
        sent = state.filter("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("branch").alias("more"))
        above = state.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("depth").alias("a_depth"), F.col("root").alias("a_root"), *([F.col("path").alias("a_path")] if paths else []))
        met = state.join(above, "up", "left").join(sent, "node", "left")
        long_path = [F.when(F.col("a_path").isNull(), F.col("path")).otherwise(F.concat("a_path", F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))))).alias("path")] if paths else []
        state = met.select(
            "node", "parent", "extra", F.col("far").alias("up"), (F.col("depth") + F.coalesce("a_depth", F.lit(0))).alias("depth"), F.coalesce("a_root", "root").alias("root"), (F.col("branch") + F.coalesce("more", F.lit(0))).alias("branch"), *long_path
        )
    alone = F.col("parent").isNull() & (F.col("branch") == 1)
    return state.select("node", "parent", "root", "depth", "branch", "extra", alone.alias("standalone"), *(["path"] if paths else []))


def maintained(closure: DataFrame, edges: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """A stored closure (node, anc) of ``edges`` (child, parent) after links are removed and added.

    Returns (node, anc, change): kept, rederived or added pairs of the new closure, and the gone
    ones. Work follows what the links touch:

    * what a removed link could have carried goes first: who reaches its child times what its
      parent reaches, by two joins with the old closure;
    * of that, what other links still carry comes back: nodes that lost a pair are closed among
      themselves (path doubling over their links only), and end in pairs that were never touched;
    * new links are chained where the closure leads from one's parent to another's child, and each
      chain joins what reaches its begin with what its end reaches.
    """
    link = lambda d: d.select(F.col("child").cast(closure.schema["node"].dataType).alias("node"), F.col("parent").cast(closure.schema["anc"].dataType).alias("anc")).filter("node is not null and anc is not null").distinct()
    old, all_links, plus = closure.select("node", "anc").distinct(), link(edges), link(added)
    minus = link(removed).join(all_links, ["node", "anc"], "left_semi").join(plus, ["node", "anc"], "left_anti")
    left = cut(all_links.join(minus, ["node", "anc"], "left_anti"))

    def around(pairs: DataFrame, known: DataFrame) -> DataFrame:
        """Pairs from all that reaches a pair's first node to all that its second reaches, these two included."""
        before = known.select(F.col("node").alias("x"), F.col("anc").alias("node"))
        after = known.select(F.col("node").alias("anc"), F.col("anc").alias("y"))
        wide = pairs.join(before, "node").select(F.col("x").alias("node"), "anc").unionByName(pairs).distinct()
        return wide.join(after, "anc").select("node", F.col("y").alias("anc")).unionByName(wide).distinct()

    lost = cut(around(minus, old))
    safe = cut(old.join(lost, ["node", "anc"], "left_anti"))
    touched = lost.select("node").distinct()
    own = left.join(touched, "node", "left_semi")
    beyond = own.withColumnRenamed("anc", "mid").join(safe.select(F.col("node").alias("mid"), "anc"), "mid").select("node", "anc")
    base = own.unionByName(beyond).distinct()
    inside = ancestors(own.join(touched.withColumnRenamed("node", "anc"), "anc", "left_semi").select(F.col("node").alias("child"), F.col("anc").alias("parent")))
    chained = inside.withColumnRenamed("anc", "mid").join(base.withColumnRenamed("node", "mid"), "mid").select("node", "anc")
    back = cut(base.unionByName(chained).distinct().join(lost, ["node", "anc"], "left_semi"))
    now = safe.unionByName(back)
    starts = plus.select(F.col("node").alias("next")).distinct()
    hop = plus.join(starts.withColumn("at", F.col("next")).unionByName(now.join(starts.withColumnRenamed("next", "anc"), "anc").select(F.col("anc").alias("next"), F.col("node").alias("at"))), F.col("anc") == F.col("at"))
    chain = ancestors(hop.select(F.col("node").alias("child"), F.col("next").alias("parent")))
    ends = chain.withColumnRenamed("anc", "mid").join(plus.withColumnRenamed("node", "mid"), "mid").select("node", "anc").unionByName(plus).distinct()
    fresh = cut(around(ends, now).join(now, ["node", "anc"], "left_anti"))
    gone = lost.join(back, ["node", "anc"], "left_anti").join(fresh, ["node", "anc"], "left_anti")
    told = lambda d, change: d.select("node", "anc", F.lit(change).alias("change"))
    return told(safe, "kept").unionByName(told(back, "rederived")).unionByName(told(fresh, "added")).unionByName(told(gone, "gone"))


def ordered_members(members: Column) -> Column:
    """Members sorted and joined by ``|``, as signatures have them."""
    return F.array_join(F.array_sort(members), "|")
