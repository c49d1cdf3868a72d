"""Property graphs as two DataFrames, and the operators on them.

``vertices`` has a column ``id``; ``edges`` has ``src`` and ``dst``; all other
columns are attributes.

Wherever a join may meet a hub, its other side is a written table.  Both sides
then come in through a plain shuffle, which is what lets AQE split the hub's
partition; an aggregate used directly would keep its own partitioning and pin
the hub to one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.session import materialise, pin

# Out-edges of one vertex that may meet in one join key before they are split.
EDGE_CHUNK_ROWS = 1_000_000


@dataclass(frozen=True)
class PropertyGraph:
    vertices: DataFrame
    edges: DataFrame

    @classmethod
    def build(cls, vertices: DataFrame, edges: DataFrame, default: Mapping[str, Column]) -> PropertyGraph:
        """Give endpoints that have no vertex row the ``default`` attributes."""
        endpoints = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
        absent = endpoints.join(vertices.select("id"), "id", "left_anti")
        filled = absent.select("id", *[default[c].alias(c) for c in vertices.columns if c != "id"])
        return cls(materialise(vertices.unionByName(filled), "vertices"), edges)

    def reverse(self) -> PropertyGraph:
        turned = [F.col("dst").alias("src"), F.col("src").alias("dst")]
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return PropertyGraph(self.vertices, self.edges.select(*turned, *rest))

    def subgraph(self, vertex_predicate: Column | None = None, edge_predicate: Column | None = None) -> PropertyGraph:
        """Keep matching vertices, and matching edges with both ends kept."""
        edges = self.edges if edge_predicate is None else self.edges.filter(edge_predicate)
        if vertex_predicate is None:
            return PropertyGraph(self.vertices, edges)
        kept = self.vertices.filter(vertex_predicate)
        return PropertyGraph(kept, _restrict_edges(edges, kept))

    def mask(self, other: PropertyGraph) -> PropertyGraph:
        """Restrict to the vertices and edges another graph also has."""
        vertices = self.vertices.join(other.vertices.select("id"), "id", "left_semi")
        edges = self.edges.join(other.edges.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
        return PropertyGraph(vertices, edges)

    def triplets(self, ends: Sequence[str] = ("src", "dst")) -> DataFrame:
        """Every edge with the attributes of its ends as ``src_<a>`` and ``dst_<a>``.

        Name only the ends an expression uses: each costs a join.
        """
        attributes = [c for c in self.vertices.columns if c != "id"]
        joined = self.edges
        for end in ends:
            side = self.vertices.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in attributes])
            joined = joined.join(side, end)
        return joined

    def map_vertices(self, **columns: Column) -> PropertyGraph:
        return PropertyGraph(self.vertices.withColumns(columns), self.edges)

    def map_edges(self, **columns: Column) -> PropertyGraph:
        return PropertyGraph(self.vertices, self.edges.withColumns(columns))

    def map_triplets(self, ends: Sequence[str] = ("src", "dst"), **columns: Column) -> PropertyGraph:
        """Edge attributes from expressions over the triplet columns."""
        triplets = self.triplets(ends).withColumns(columns)
        kept = list(dict.fromkeys([*self.edges.columns, *columns]))
        return PropertyGraph(self.vertices, triplets.select(*kept))

    def out_degrees(self) -> DataFrame:
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))

    def outer_join_vertices(self, table: DataFrame, default: Mapping[str, Column]) -> PropertyGraph:
        """Add the columns of ``table`` (keyed by ``id``) to the vertices, defaults where it has no row."""
        joined = self.vertices.join(table, "id", "left")
        filled = {c: F.coalesce(F.col(c), value) for c, value in default.items()}
        return PropertyGraph(materialise(joined.withColumns(filled), "vertices"), self.edges)

    def join_vertices(self, messages: DataFrame, column: str, merged: Column) -> PropertyGraph:
        """Replace ``column`` by ``merged`` where a message row exists; other vertices keep their value."""
        names = [c for c in messages.columns if c != "id"]
        joined = self.vertices.join(messages.withColumn("__hit", F.lit(True)), "id", "left")
        updated = joined.withColumn(column, F.when(F.col("__hit"), merged).otherwise(F.col(column)))
        return PropertyGraph(materialise(updated.drop("__hit", *names), "vertices"), self.edges)

    def aggregate_messages(
        self,
        merge: Mapping[str, Callable[[Column], Column]],
        to_dst: Column | None = None,
        to_src: Column | None = None,
        where: Column | None = None,
        ends: Sequence[str] = ("src", "dst"),
    ) -> DataFrame:
        """Send an expression over the triplet columns along edges and merge per receiver.

        ``merge`` names each result column and the aggregate that makes it.
        """
        triplets = self.triplets(ends)
        if where is not None:
            triplets = triplets.filter(where)
        sent = []
        if to_dst is not None:
            sent.append(triplets.select(F.col("dst").alias("id"), to_dst.alias("message")))
        if to_src is not None:
            sent.append(triplets.select(F.col("src").alias("id"), to_src.alias("message")))
        messages = sent[0] if len(sent) == 1 else sent[0].unionByName(sent[1])
        return messages.groupBy("id").agg(*[f(F.col("message")).alias(name) for name, f in merge.items()])


def _restrict_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    ids = vertices.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )


def load_edge_list(lines: DataFrame, canonical: bool = False) -> DataFrame:
    """Edges from text lines ``src dst``; ``#`` starts a comment line.

    Canonical orientation puts the smaller id first, without self loops and
    copies.
    """
    parts = F.split(F.trim("value"), r"\s+")
    edges = (
        lines.filter(~F.col("value").startswith("#"))
        .select(F.try_element_at(parts, F.lit(1)).alias("a"), F.try_element_at(parts, F.lit(2)).alias("b"))
        .select(F.expr("try_cast(a as bigint)").alias("src"), F.expr("try_cast(b as bigint)").alias("dst"))
        .filter("src is not null and dst is not null")
    )
    return canonical_edges(edges) if canonical else edges


def canonical_edges(edges: DataFrame) -> DataFrame:
    return (
        edges.filter("src <> dst")
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct()
    )


def both_directions(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse, once."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").union(turned).filter("src <> dst").distinct()


class EdgeIndex:
    """Edges written once for repeated joins on ``src``, with the out-edges of hubs split into chunks.

    A vertex with more than ``chunk_rows`` out-edges would put all of them
    behind one join key.  Its edges get a chunk number instead, and rows that
    meet it are repeated once per chunk, so no key holds more than about
    ``chunk_rows`` edges.  The list of such vertices has at most
    |edges| / chunk_rows rows.

    ``pinned`` keeps the edges partitioned by the join key, for loops that join
    them every round with one state row per vertex: then only the messages are
    shuffled.  Loops whose own rows may pile up on one vertex leave it off, so
    that AQE can split either side.
    """

    def __init__(self, edges: DataFrame, chunk_rows: int = EDGE_CHUNK_ROWS, pinned: bool = False):
        stored = materialise(edges, "edges")
        hubs = (
            stored.groupBy("src")
            .agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > chunk_rows)
            .select("src", F.ceil(F.col("n") / chunk_rows).cast("int").alias("chunks"))
        )
        hubs = materialise(hubs, "hubs")
        self.hubs = None if hubs.isEmpty() else hubs
        self.stored = stored
        if self.hubs is None:
            self.edges = stored
        else:
            spread = F.pmod(F.xxhash64(*[c for c in stored.columns if c != "src"]), F.col("chunks"))
            self.edges = (
                stored.join(self._hub_side("src"), "src", "left")
                .withColumn("chunk", F.coalesce(spread, F.lit(0)).cast("int"))
                .drop("chunks")
            )
        if pinned:
            self.edges = pin(self.edges, *(["src"] if self.hubs is None else ["src", "chunk"]))

    def _hub_side(self, key: str) -> DataFrame:
        side = self.hubs.withColumnRenamed("src", key)
        return side

    def follow(self, rows: DataFrame, key: str) -> DataFrame:
        """Join ``rows`` with the out-edges of the vertex in column ``key``."""
        renamed = self.edges.withColumnRenamed("src", key)
        if self.hubs is None:
            return rows.join(renamed, key)
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1)).alias("chunk")
        salted = rows.join(self._hub_side(key), key, "left").select(*rows.columns, copies)
        return salted.join(renamed, [key, "chunk"]).drop("chunk")


def pregel(
    graph: PropertyGraph,
    initial: Mapping[str, Column],
    message: Column,
    merge: Callable[[Column], Column],
    update: Mapping[str, Column],
    changed: Column,
    send_if: Column | None = None,
    max_rounds: int | None = None,
    cut_every: int = 4,
    chunk_rows: int = EDGE_CHUNK_ROWS,
) -> DataFrame:
    """Synchronous vertex rounds until no vertex is ``changed``, or exactly ``max_rounds`` if given and reached first.

    ``initial`` sets the state columns from vertex columns; ``message`` is an
    expression over the source state and the edge columns; ``merge``
    aggregates what a vertex receives into ``message``; ``update`` computes the
    new state from the old one and ``message`` (null when nothing came).

    A marked self edge carries each vertex's own state through the same
    shuffle as the messages, so a round reads the state once and the plan
    grows by a constant amount; every ``cut_every`` rounds the state is written
    out and the stop condition tested.
    """
    names = list(initial)
    state = graph.vertices.select("id", *[c.alias(n) for n, c in initial.items()])
    attributes = [c for c in graph.edges.columns if c not in ("src", "dst")]
    own = graph.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(True).alias("own"))
    edges = graph.edges.select("src", "dst", F.lit(False).alias("own"), *attributes)
    index = EdgeIndex(edges.unionByName(own, allowMissingColumns=True), chunk_rows, pinned=True)
    sending = ~F.col("own") if send_if is None else ~F.col("own") & send_if
    state = materialise(state, "state")
    done = 0
    while max_rounds is None or done < max_rounds:
        for _ in range(cut_every if max_rounds is None else min(cut_every, max_rounds - done)):
            # an edge that sends nothing tells its end nothing: only the own states and the messages are shuffled
            met = index.follow(state.withColumnRenamed("id", "sender"), "sender").filter(F.col("own") | sending)
            state = (
                met.groupBy(F.col("dst").alias("id"))
                .agg(
                    *[F.first(F.when(F.col("own"), F.col(n)), ignorenulls=True).alias(n) for n in names],
                    merge(F.when(sending, message)).alias("message"),
                )
                .select("id", *[update[n].alias(n) if n in update else F.col(n) for n in names])
            )
            done += 1
        state = materialise(state, "state")
        if state.filter(changed).isEmpty():
            break
    return state


def shortest_paths(graph: PropertyGraph, source: int, weight: str, max_rounds: int | None = None, **options) -> DataFrame:
    """Least total ``weight`` from ``source`` to every vertex; infinity where no path leads.

    A bound on the rounds that is reached before the distances settle raises an error.
    """
    infinity = F.lit(float("inf"))
    start = F.when(F.col("id") == source, F.lit(0.0)).otherwise(infinity)
    result = pregel(
        graph,
        initial={"distance": start, "moved": F.col("id") == source},
        message=F.col("distance") + F.col(weight),
        merge=F.min,
        update={
            "distance": F.least(F.col("distance"), F.coalesce(F.col("message"), infinity)),
            "moved": F.coalesce(F.col("message") < F.col("distance"), F.lit(False)),
        },
        changed=F.col("moved"),
        send_if=F.col("moved"),
        max_rounds=max_rounds,
        **options,
    )
    if max_rounds is not None and not result.filter("moved").isEmpty():
        raise RuntimeError(f"distances did not settle within {max_rounds} rounds")
    return result.select("id", "distance")


def pagerank(
    graph: PropertyGraph,
    tolerance: float = 0.001,
    reset: float = 0.15,
    max_rounds: int | None = None,
    cut_every: int = 4,
    **options,
) -> DataFrame:
    """Ranks by passing rank changes above ``tolerance`` along out-edges; ranks are not normalised.

    ``max_rounds`` asks for that many rounds at most instead of convergence.
    """
    weights = graph.out_degrees().select(F.col("id").alias("src"), (1.0 / F.col("out_degree")).alias("weight"))
    weighted = graph.edges.select("src", "dst").join(materialise(weights, "weights"), "src")
    gain = (1.0 - reset) * F.coalesce(F.col("message"), F.lit(0.0))
    result = pregel(
        PropertyGraph(graph.vertices.select("id"), weighted),
        initial={"rank": F.lit(reset), "delta": F.lit(reset)},
        message=F.col("delta") * F.col("weight"),
        merge=F.sum,
        update={"rank": F.col("rank") + gain, "delta": gain},
        changed=F.col("delta") > tolerance,
        send_if=F.col("delta") > tolerance,
        max_rounds=max_rounds,
        cut_every=cut_every,
        **options,
    )
    return result.select("id", "rank")


def connected_components(graph: PropertyGraph) -> DataFrame:
    """Label every vertex with the least id of its undirected component.

    Each round points every vertex at its least smaller neighbour, follows the
    pointers to their roots by doubling, and contracts the edges onto the
    roots.  The edge table shrinks geometrically; the pointers of all rounds
    are composed at the end, smallest table first.
    """
    edges = materialise(canonical_edges(graph.edges), "contracted")
    pointers: list[DataFrame] = []
    while not edges.isEmpty():
        roots = _follow_to_roots(edges.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("root")))
        pointers.append(roots)
        ends = edges
        for end in ("src", "dst"):
            moved = roots.select(F.col("id").alias(end), F.col("root").alias(f"{end}_root"))
            ends = ends.join(moved, end, "left")
        contracted = ends.select(
            F.coalesce("src_root", "src").alias("src"), F.coalesce("dst_root", "dst").alias("dst")
        )
        edges = materialise(canonical_edges(contracted), "contracted")
    labels = None
    for roots in reversed(pointers):
        # a vertex gets a pointer in one round only, so the tables never share an id
        labels = roots if labels is None else materialise(_compose(roots, labels).unionByName(labels), "labels")
    vertices = graph.vertices.select("id")
    if labels is None:
        return vertices.withColumn("component", F.col("id"))
    return vertices.join(labels, "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def _compose(first: DataFrame, then: DataFrame) -> DataFrame:
    """(id, root) of following ``first`` and then, where it leads on, ``then``."""
    return _step_on(first, then).drop("moved")


def _step_on(first: DataFrame, then: DataFrame) -> DataFrame:
    onward = then.select(F.col("id").alias("root"), F.col("root").alias("further"))
    return first.join(onward, "root", "left").select(
        "id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
    )


def _follow_to_roots(pointers: DataFrame) -> DataFrame:
    """Replace every pointer by the end of its chain, doubling the step each time."""
    current = materialise(pointers, "pointers")
    while True:
        stepped = materialise(_step_on(current, current), "pointers")
        current = stepped.drop("moved")
        if stepped.filter("moved").isEmpty():
            return current


def triangle_counts(graph: PropertyGraph) -> DataFrame:
    """Triangles through every vertex of the simple undirected graph.

    Edges point from the end of lower degree to the higher one, which bounds
    every out-list by sqrt(2 |edges|); each edge then intersects the two lists
    of its ends.
    """
    simple = materialise(canonical_edges(graph.edges), "simple")
    ends = simple.select(F.explode(F.array("src", "dst")).alias("id"))
    degree = materialise(ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")), "degree")
    low = degree.select(F.col("id").alias("src"), F.col("degree").alias("src_degree"))
    high = degree.select(F.col("id").alias("dst"), F.col("degree").alias("dst_degree"))
    ranked = simple.join(low, "src").join(high, "dst")
    upward = F.struct("src_degree", "src") < F.struct("dst_degree", "dst")
    oriented = materialise(
        ranked.select(
            F.when(upward, F.col("src")).otherwise(F.col("dst")).alias("low"),
            F.when(upward, F.col("dst")).otherwise(F.col("src")).alias("high"),
        ),
        "oriented",
    )
    lists = materialise(oriented.groupBy("low").agg(F.collect_list("high").alias("above")), "lists")
    of_low = lists.withColumnRenamed("above", "low_above")
    of_high = lists.select(F.col("low").alias("high"), F.col("above").alias("high_above"))
    closing = (
        oriented.join(of_high, "high")
        .join(of_low, "low")
        .select("low", "high", F.explode(F.array_intersect("low_above", "high_above")).alias("top"))
    )
    corners = closing.select(F.explode(F.array("low", "high", "top")).alias("id"))
    counted = corners.groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    return (
        graph.vertices.select("id")
        .join(counted, "id", "left")
        .select("id", F.coalesce("triangles", F.lit(0)).cast("bigint").alias("triangles"))
    )


def top_k(df: DataFrame, by: str, k: int, tie: str = "id", columns: Sequence[str] | None = None) -> DataFrame:
    """The k rows of greatest ``by``, ties to the smaller ``tie``."""
    chosen = df.select(*columns) if columns else df
    return chosen.orderBy(F.col(by).desc(), F.col(tie)).limit(k)
