"""N-gram Jaccard join over a tree of count vectors.

Every document is a set of word shingles.  Shingles are hashed into groups and
the counts per group make the set a point.  For two points the overlap of the
sets is at most the sum of the coordinate minima, so a pair or a whole node
whose bound stays below the needed overlap is discarded unseen; what survives
is verified on the sets themselves.

The tree has three levels, all of them keys of Spark shuffles:

* Cells.  Sets within the threshold differ in at most D shingles, D following
  from the size band.  The groups are dealt into more than D blocks, so at
  least one block has equal counts on both sides; a cell is one block with
  one vector of counts over its fine groups, so many that different shingles
  seldom count in the same one.  Only points that share a cell can be linked,
  and each point sits in about one cell per two (0.8) to five (0.9) shingles.
* Leaves.  A cell is cut into leaves of a bounded number of points.  Two leaves
  meet only if the bound of their boxes, the largest count per coordinate of
  each, allows a link.
* Points.  Of two leaves that meet, the points are compared by their bounds.
  Pairs of large sets, whose counts over ``DIMS`` groups say little, pass a
  second bound over one group per four to eight shingles.

Only pairs that pass the bounds cause texts to be read again: a bitmap of fixed
size screens the documents, and the sets of what is left are built and compared.

Components need no pair inside a connected group: each point is first verified against
the leading point of its cells, the verified links are contracted, and only
cells whose points stay apart are compared further, leaf by leaf.  Equal sets are one
point throughout, so copies cost nothing, and cells of the same points are one.

The join proper (``links``, ``link_counts``) needs every pair.  All links lie inside
components, so it takes the components, cuts each into leaves, and lets every two
leaves of a component meet once with their sets, where all pairs are counted exactly.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import U64, blank_words, fresh_name, list_array, map_batches, mix, shingle_hashes, signed, word_hashes
from quillmesh.session import discard, materialise

DIMS = 256  # coordinates of a point
FINE = 1 << 32  # fine groups per block; with few, blocks of one shingle agree by chance and cells grow with the table
LEAF = 1024  # points per leaf of a cell; a point is placed once per leaf that its own one meets
SET_LEAF = 256  # sets per leaf of a component, for the join proper
FULL = 127  # counts of a point stop here, and then say nothing; fine points serve sets that large
SPARE = 4  # one block more per as many differing shingles, so that each set may leave out that many
FEW = 8  # shingles per coordinate above which a set also has a fine point
SCREEN_BITS = 26  # 8 MB whatever the number of wanted ids; a full bitmap only screens less

_POINT = (
    "doc_id bigint, n_shingles bigint, key bigint, key2 bigint, point array<tinyint>, fine array<smallint>, "
    "cells array<bigint>"
)


def _size_bands() -> list[int]:
    lows = [1]
    while lows[-1] < 1 << 60:
        lows.append(max(lows[-1] + 1, lows[-1] * 3 // 2))
    return lows


BANDS = _size_bands()


def blocks_of(band: int, percent: int) -> tuple[int, int]:
    """(blocks, spare): pairs whose larger set lies in ``band`` agree on more than ``spare`` of the blocks.

    With intersection i and union u, 100 i >= percent u and sizes of at most t
    give u <= 200 t / (100 + percent), and u - i <= (100 - percent) u / 100
    shingles differ, each of which touches one block.
    """
    top = BANDS[band + 1] - 1
    union = 200 * top // (100 + percent)
    differ = (100 - percent) * union // 100
    if differ == 0:
        return 1, 0
    spare = -(-differ // SPARE)
    return differ + 1 + spare, spare


def _salt(band: int, use: int) -> np.uint64:
    return U64((4 * band + use) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def cells_of(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Cells of one set, given its sorted distinct hashes.

    The blocks with the fewest shingles say least: many sets have the same empty
    blocks, and a frequent shingle alone in a block.  The ``spare`` least filled
    ones give no cell.  Equal blocks are equally filled, so a pair, which agrees
    on more than ``spare`` blocks, still shares the cell of the fullest of them.
    """
    n, out = len(shingles), []
    own = bisect_right(BANDS, n) - 1
    largest_partner = 100 * n // percent
    for band in (own, own + 1) if largest_partner >= BANDS[own + 1] else (own,):
        blocks, spare = blocks_of(band, percent)
        block = (shingles >> U64(32)) * U64(blocks) >> U64(32)  # does not fall along sorted hashes
        fine = mix(block * U64(FINE) + (shingles & U64(FINE - 1)) + _salt(band, 1))
        filled = np.bincount(block.astype(np.int64), minlength=blocks)
        used = np.flatnonzero(filled)
        sums = np.zeros(blocks, dtype=U64)
        sums[used] = np.add.reduceat(fine, np.cumsum(filled[used]) - filled[used])
        order = np.argsort(-np.minimum(filled, 32767).astype(np.int16), kind="stable")  # of equally filled blocks the first
        kept = order[: blocks - spare]
        out.append(mix(sums[kept] + mix(kept.astype(U64) + _salt(band, 2))))
    return np.concatenate(out)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; the whole sequence as one when there are fewer words."""
    hashes = word_hashes(blank_words(text))
    if 0 < len(hashes) < size:
        return shingle_hashes(hashes, len(hashes))
    return np.unique(shingle_hashes(hashes, size))


def _set_keys(s: np.ndarray) -> tuple[int, int]:
    return int(s.sum(dtype=U64).view(np.int64)), int(mix(s).sum(dtype=U64).view(np.int64))


def counts_over(s: np.ndarray, dims: int) -> np.ndarray:
    """Shingles per group, ``dims`` being a power of two."""
    return np.bincount((s >> U64(20)).astype(np.int64) & (dims - 1), minlength=dims)


def fine_point(s: np.ndarray) -> np.ndarray:
    """The counts of a large set over more groups; empty for a set that ``DIMS`` groups serve."""
    if len(s) <= FEW * DIMS:
        return np.empty(0, np.int16)
    return np.minimum(counts_over(s, 1 << (len(s) // FEW).bit_length()), 32767).astype(np.int16)


def fine_overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Bound of the overlap by two fine points; the longer one is folded onto the groups of the other."""
    dims = min(len(a), len(b))
    full = (a == 32767).any() or (b == 32767).any()  # such a count is no upper bound
    if full or not dims:
        return 1 << 40
    a, b = (x.astype(np.int64).reshape(-1, dims).sum(axis=0) for x in (a, b))
    return int(np.minimum(a, b).sum())


def points(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per document its set size, two 64-bit keys of the set, its points and its cells."""

    def rows(batch: pa.RecordBatch):
        ids = batch.column(0)
        sets = [shingle_set(t, size) for t in batch.column(1).to_pylist()]
        keys = [_set_keys(s) for s in sets]
        vectors = [np.minimum(counts_over(s, DIMS), FULL).astype(np.int8) for s in sets]
        vectors = [v if len(s) else v[:0] for v, s in zip(vectors, sets)]
        # a null id takes part in no link
        cells = [
            signed(cells_of(s, percent)) if len(s) and i is not None else np.empty(0, np.int64)
            for s, i in zip(sets, ids.to_pylist())
        ]
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([k[0] for k in keys], pa.int64()),
                pa.array([k[1] for k in keys], pa.int64()),
                list_array(vectors, pa.int8()),
                list_array([fine_point(s) for s in sets], pa.int16()),
                list_array(cells, pa.int64()),
            ],
            names=["doc_id", "n_shingles", "key", "key2", "point", "fine", "cells"],
        )

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), _POINT, rows)


def _shared_cells(in_cells: DataFrame) -> DataFrame:
    """``cell, node, lead`` for cells with several nodes; ``lead`` is the least node, or that of a piece of the cell.

    Rows are range partitioned on (cell, node), which also cuts a hot cell into
    pieces, and each batch finds its runs of one cell.  The runs at the ends of
    a batch may go on in the next one: their leads are tied to the least of them.
    """

    def rows(batch: pa.RecordBatch):
        cell, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(cell):
            return
        start = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1))
        length = np.diff(np.append(start, len(cell)))
        edge = np.zeros(len(start), dtype=bool)
        edge[[0, -1]] = True
        keep = np.repeat(edge | (length > 1), length)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(cell[keep]),
                pa.array(node[keep]),
                pa.array(np.repeat(node[start], length)[keep]),
                pa.array(np.repeat(edge, length)[keep]),
            ],
            names=["cell", "node", "lead", "edge"],
        )

    ordered = in_cells.select("cell", "node").repartitionByRange("cell", "node").sortWithinPartitions("cell", "node")
    runs = materialise(map_batches(ordered, "cell bigint, node bigint, lead bigint, edge boolean", rows), "runs")
    pieces = runs.filter("edge").select("cell", "lead").distinct()
    least = pieces.groupBy("cell").agg(F.min("lead").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    ties = pieces.join(least, "cell").select("cell", F.col("lead").alias("node"), F.col("first").alias("lead"))
    return runs.select("cell", "node", "lead").union(ties.filter("node <> lead"))


def _different_cells(members: DataFrame) -> DataFrame:
    """One cell for all cells with the same nodes (told apart by 128 bits and the count), without single nodes."""
    inside = members.select("cell", "node").distinct()
    marks = inside.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"),
    )
    kept = marks.filter("n > 1").groupBy("n", "x", "y").agg(F.min("cell").alias("cell"))
    return members.join(kept.select("cell", F.col("n").alias("size")), "cell")


def _screened(rows: DataFrame, wanted: DataFrame, *keys: str, out: str = "maybe") -> DataFrame:
    """``rows`` with a column ``out``: false where their ``keys`` are surely none of ``wanted``.

    The bitmap has at most 2^SCREEN_BITS bits in rows of 4 KB, which bounds the broadcast.
    """
    spot = F.pmod(F.xxhash64(*keys), F.lit(1 << SCREEN_BITS)) + 1
    marks = wanted.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("bucket"))
    marks = marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    at = F.bitmap_bit_position("spot")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2.0), at % 8)), F.lit(2))
    placed = rows.withColumn("spot", spot).withColumn("bucket", F.bitmap_bucket_number("spot"))
    return placed.join(F.broadcast(marks), "bucket", "left").select(*rows.columns, F.coalesce(bit == 1, F.lit(False)).alias(out))


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``node, shingles`` of the wanted nodes, read from the documents again.

    Ids that repeat with other texts are told apart by the keys of the set;
    repeated rows are reduced to one before their sets are built.
    """

    def rows(batch: pa.RecordBatch):
        sets = [shingle_set(t, size) for t in batch.column(1).to_pylist()]
        expected = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        keep = [k for k, (s, e) in enumerate(zip(sets, expected)) if _set_keys(s) == e]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(keep, pa.int64())), list_array([signed(sets[k]) for k in keep], pa.int64())],
            names=["node", "shingles"],
        )

    wanted = materialise(wanted, "wanted")
    texts = _screened(docs.select(F.col("doc_id").cast("long").alias("node"), "text"), wanted, "node")
    texts = texts.filter("maybe").drop("maybe").join(wanted, "node").distinct()
    return map_batches(texts.select("node", "text", "key", "key2"), "node bigint, shingles array<bigint>", rows)


def _needed(n_a, n_b, percent: int):
    """Least overlap of a link: 100 i >= percent (a + b - i)."""
    return F.ceil((n_a + n_b) * percent / F.lit(100.0 + percent) - 1e-9)


def overlap_bound(a, b):
    """Sum of coordinate minima: no two sets with these counts share more.

    Counts stop at ``FULL``, so a coordinate that full says nothing.
    """
    least = F.zip_with(a, b, lambda x, y: F.when((x == FULL) | (y == FULL), F.lit(1 << 40)).otherwise(F.least(x, y).cast("long")))
    return F.aggregate(least, F.lit(0).cast("long"), lambda s, x: s + x)


def _within_fine_bound(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of ``a, b, n_a, n_b`` that the fine points of two large sets let through."""

    def rows(batch: pa.RecordBatch):
        need = batch.column(2).to_numpy()
        lists = [batch.column(k) for k in (3, 4)]
        values = [x.values.to_numpy() for x in lists]
        starts = [x.offsets.to_numpy() for x in lists]
        part = lambda side, k: values[side][starts[side][k] : starts[side][k + 1]]
        keep = pa.array([k for k in range(len(need)) if fine_overlap(part(0, k), part(1, k)) >= need[k]], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(k).take(keep) for k in (0, 1)], names=["a", "b"])

    both_large = F.least("n_a", "n_b") > FEW * DIMS
    fine = nodes.filter(F.col("n_shingles") > FEW * DIMS)
    large = (
        pairs.filter(both_large)
        .select("a", "b", _needed(F.col("n_a"), F.col("n_b"), percent).alias("need"))
        .join(fine.select(F.col("node").alias("a"), F.col("fine").alias("f_a")), "a")
        .join(fine.select(F.col("node").alias("b"), F.col("fine").alias("f_b")), "b")
        .select("a", "b", "need", "f_a", "f_b")
    )
    return pairs.filter(~both_large).select("a", "b").union(map_batches(large, "a bigint, b bigint", rows))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of nodes that are links: bounds first, then the sets of what they let through."""
    a = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("point").alias("p_a"))
    b = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("point").alias("p_b"))
    bounded = (
        pairs.join(a, "a")
        .join(b, "b")
        .filter((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
        .filter(overlap_bound(F.col("p_a"), F.col("p_b")) >= _needed(F.col("n_a"), F.col("n_b"), percent))
        .select("a", "b", "n_a", "n_b")
    )
    bounded = materialise(bounded, "bounded")
    likely = materialise(_within_fine_bound(bounded, nodes, percent), "likely")
    ends = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = materialise(_sets_of(docs, nodes.join(ends, "node", "left_semi").select("node", "key", "key2"), size), "sets")
    both = likely.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("s_b")), "b"
    )
    shared = F.size(F.array_intersect("s_a", "s_b"))
    links = both.filter(100 * shared >= percent * (F.size("s_a") + F.size("s_b") - shared)).select("a", "b")
    links = materialise(links, "links")
    discard(bounded, likely, sets)
    return links


def contract(edges: DataFrame) -> DataFrame:
    """``node, component`` with the least node of each component, by alternating star contraction.

    Each round links every node to the least neighbour it knows and is written
    out; stars are stable, so the loop ends when a round changes nothing.
    """
    edges = materialise(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links"
    )
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.filter("u <> v").distinct(), "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        small = materialise(small.filter("u <> v").distinct(), "links")
        roots = small.select("v").distinct().join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        if roots.isEmpty() and small.groupBy("u").count().filter("count > 1").isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("component"))
        edges = small


def _connect(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(set size and keys of all rows, classes, points that share a cell, their components)."""
    pts = materialise(points(docs, size, percent), "points")
    linked = pts.filter("n_shingles > 0 and doc_id is not null")
    classes = materialise(linked.groupBy("key", "key2").agg(F.min("doc_id").alias("node")), "classes")

    # One point per set: copies share its cells, so only the least id enters them.  Cells are
    # wide: a row that the screen shows to be no copy stays where it is, the others are looked up.
    own = ["doc_id", "key", "key2"]
    copies = materialise(linked.select(*own).join(classes, ["key", "key2"]).filter("node <> doc_id").select(*own), "copies")
    looked = _screened(linked.select(*own, "cells"), copies, *own)
    least = classes.select(F.col("node").alias("doc_id"), "key", "key2")
    chosen = looked.filter("not maybe").select("doc_id", "cells").union(
        looked.filter("maybe").join(least, own, "left_semi").select("doc_id", "cells")
    )
    in_cells = chosen.select(F.col("doc_id").alias("node"), F.explode("cells").alias("cell"))
    shared = materialise(_shared_cells(in_cells), "members")
    members = materialise(_different_cells(shared), "cells")
    used = members.filter("node <> lead").select(F.explode(F.array("node", "lead")).alias("node")).distinct()
    used = materialise(used, "used")
    nodes = linked.select(F.col("doc_id").alias("node"), "key", "key2", "n_shingles", "point", "fine")
    nodes = _screened(nodes, used, "node").filter("maybe").drop("maybe").join(used, "node", "left_semi")
    nodes = materialise(nodes.join(classes, ["node", "key", "key2"], "left_semi").dropDuplicates(["node"]), "nodes")
    rows = materialise(pts.select("doc_id", "n_shingles", "key", "key2"), "rows")
    discard(pts, shared)

    # Round 1: every node with the least leader of its cells.
    first = members.filter("node <> lead").groupBy("node").agg(F.min("lead").alias("b")).select(F.col("node").alias("a"), "b")
    links = _verified(first, nodes, docs, size, percent)
    found = contract(links)
    # Round 2: with every other leader it is not yet connected to.
    apart = _relabelled(members.filter("node <> lead").select("node", "lead").distinct(), found, ("node", "lead"))
    second = apart.filter("c_node <> c_lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    links = links.union(_verified(second, nodes, docs, size, percent))
    found = contract(links)
    # Round 3: cells whose nodes stay apart, bound by bound down the tree; of two groups the closest pair first.
    labelled = _relabelled(members.select("cell", "node", "size").distinct(), found, ("node",))
    mixed = labelled.groupBy("cell").agg(F.min("c_node").alias("low"), F.max("c_node").alias("high")).filter("low <> high")
    left = materialise(labelled.join(mixed.select("cell"), "cell"), "open-cells")
    left = left.join(nodes.select("node", "n_shingles", "point"), "node")
    near = materialise(_descend(left, percent), "near")
    closest = near.groupBy("c_a", "c_b").agg(F.max(F.struct("slack", "a", "b")).alias("best")).select("best.a", "best.b")
    links = links.union(_verified(closest, nodes, docs, size, percent))
    found = contract(links)
    rest = _relabelled(near.select("a", "b"), found, ("a", "b")).filter("c_a <> c_b").select("a", "b")
    links = links.union(_verified(rest, nodes, docs, size, percent))
    found = contract(links)

    return rows, classes, nodes, found


def _sets_of_found(docs: DataFrame, nodes: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """The sets of all nodes that are linked with others."""
    ends = found.select(F.explode(F.array("node", "component")).alias("node")).distinct()
    return materialise(_sets_of(docs, nodes.join(ends, "node", "left_semi").select("node", "key", "key2"), size), "sets")


def link_components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` for every row of ``docs``.

    ``class_id`` is the smallest id with the same set, ``component_id`` the
    smallest id reachable over links, a link being Jaccard >= percent / 100.
    Rows are kept as they repeat.  A text without words is linked with nothing
    (its own id in both columns); a row without id neither, its columns are null.
    """
    pts, classes, _, found = _connect(docs, size, percent)
    roots = classes.join(found, "node", "left").select(
        "key", "key2", F.col("node").alias("class_id"), F.coalesce("component", "node").alias("component_id")
    )
    return (
        pts.select("doc_id", "n_shingles", "key", "key2")
        .join(roots, ["key", "key2"], "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("class_id", "doc_id")).alias("class_id"),
            F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
    )


def _relabelled(df: DataFrame, found: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    for c in columns:
        df = df.join(found.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")), c, "left")
        df = df.withColumn(f"c_{c}", F.coalesce(f"c_{c}", c))
    return df


def _each_group(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each group of a partition sorted by ``keys``, whole."""
    held = None  # rows of the group that the next batch may go on with
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        marks = np.stack([table.column(c).to_numpy().astype(np.int64) for c in keys])
        cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1), table.num_rows]
        for start, stop in zip(cuts[:-2], cuts[1:-1]):
            yield table.slice(start, stop - start)
        held = table.slice(cuts[-2])
    if held is not None and held.num_rows:
        yield held


def _descend(left: DataFrame, percent: int) -> DataFrame:
    """``a, b, c_a, c_b, slack``: pairs of points from different groups of one cell that the bounds let through.

    Cells of up to ``LEAF`` points are one leaf.  Larger ones are cut by hash
    into leaves, and every pair of leaves whose boxes allow a link meets in one
    group of at most two leaves; nothing is emitted for pairs the bounds exclude.
    """
    cut = left.withColumn("leaves", F.ceil(F.col("size") / F.lit(LEAF)).cast("int")).withColumn(
        "leaf", F.pmod(F.xxhash64("node"), F.col("leaves")).cast("int")
    )
    small, large = cut.filter("leaves = 1"), cut.filter("leaves > 1")
    boxes = large.groupBy("cell", "leaf").agg(
        F.min("n_shingles").alias("n_min"),
        F.max("n_shingles").alias("n_max"),
        F.array(*[F.max(F.get("point", F.lit(k))) for k in range(DIMS)]).alias("box"),
    )
    boxes = materialise(boxes, "boxes")
    other = boxes.select("cell", *[F.col(c).alias(f"{c}_b") for c in ("leaf", "n_min", "n_max", "box")])
    meet = (
        boxes.join(other, "cell")
        .filter("leaf <= leaf_b")
        .filter((100 * F.col("n_max") >= percent * F.col("n_min_b")) & (100 * F.col("n_max_b") >= percent * F.col("n_min")))
        .filter(overlap_bound(F.col("box"), F.col("box_b")) >= _needed(F.col("n_min"), F.col("n_min_b"), percent))
        .select("cell", F.col("leaf").alias("i"), F.col("leaf_b").alias("j"))
    )
    ends = meet.select("cell", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("leaf"))
    columns = ["cell", "i", "j", "leaf", "node", "c_node", "n_shingles", "point"]
    placed = small.select("cell", F.lit(0).alias("i"), F.lit(0).alias("j"), *columns[3:]).union(
        large.join(ends, ["cell", "leaf"]).select(*columns)
    )
    groups = placed.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")

    def near(table: pa.Table) -> pa.RecordBatch:
        """Pairs of one group, all of whose rows are in ``table``."""
        leaf, node, comp, n = (table.column(c).to_numpy() for c in ("leaf", "node", "c_node", "n_shingles"))
        first, second = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        point = table.column("point").combine_chunks().flatten().to_numpy().reshape(len(node), DIMS).astype(np.int32)
        point[point == FULL] = 1 << 22  # a full coordinate says nothing
        out = []
        for k in range(len(node) - 1):
            rest = slice(k + 1, len(node))
            need = -((-percent * (n[k] + n[rest])) // (100 + percent))
            may = (comp[rest] != comp[k]) & (100 * np.minimum(n[k], n[rest]) >= percent * np.maximum(n[k], n[rest]))
            if first != second:
                may &= leaf[rest] != leaf[k]
            at = np.flatnonzero(may)
            slack = np.minimum(point[k], point[rest][at]).sum(axis=1) - need[at]
            at, slack = at[slack >= 0], slack[slack >= 0]
            if len(at):
                other = at + k + 1
                swap = comp[other] < comp[k]
                mine, theirs = np.full(len(at), node[k]), node[other]
                c_mine, c_theirs = np.full(len(at), comp[k]), comp[other]
                pick = lambda x, y: np.where(swap, y, x)
                out.append((pick(mine, theirs), pick(theirs, mine), pick(c_mine, c_theirs), pick(c_theirs, c_mine), slack))
        parts = [np.concatenate(c).astype(np.int64) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 5
        return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=["a", "b", "c_a", "c_b", "slack"])

    def rows(batches):
        for table in _each_group(batches, ("cell", "i", "j")):
            yield near(table)

    pairs = groups.mapInArrow(rows, "a bigint, b bigint, c_a bigint, c_b bigint, slack bigint")
    return pairs.groupBy("a", "b", "c_a", "c_b").agg(F.max("slack").alias("slack"))


def _meeting_leaves(sets: DataFrame, found: DataFrame) -> DataFrame:
    """``component, i, j, leaf, node, shingles``: every two leaves of a component in one group, sorted by it."""
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    inside = materialise(found.select("node", "component").union(roots), "inside")
    counted = inside.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(SET_LEAF)).cast("int").alias("leaves"))
    leaf = F.pmod(F.xxhash64("node"), F.col("leaves")).cast("int")
    placed = inside.join(counted, "component").withColumn("leaf", leaf)
    other = F.explode(F.sequence(F.lit(0), F.col("leaves") - 1)).alias("other")
    placed = placed.join(sets, "node").select("component", "leaf", other, "node", "shingles")
    placed = placed.select(
        "component", F.least("leaf", "other").alias("i"), F.greatest("leaf", "other").alias("j"), "leaf", "node", "shingles"
    )
    return placed.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")


def _linked_rows(table: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per row of one group its number and those of the later rows it is linked with."""
    i, j, leaf = (table.column(c).to_numpy() for c in ("i", "j", "leaf"))
    lists = table.column("shingles").combine_chunks()
    starts = lists.offsets.to_numpy().astype(np.int64)
    _, ids = np.unique(lists.values.to_numpy()[starts[0] : starts[-1]], return_inverse=True)
    starts = starts - starts[0]
    n = np.diff(starts)
    across = i[0] != j[0]
    mark = np.zeros(ids.max() + 1, dtype=bool)
    for k in range(len(n) - 1):
        mine = ids[starts[k] : starts[k + 1]]
        mark[mine] = True
        shared = np.add.reduceat(mark[ids[starts[k + 1] :]], starts[k + 1 : -1] - starts[k + 1], dtype=np.int64)
        mark[mine] = False
        linked = 100 * shared >= percent * (n[k] + n[k + 1 :] - shared)
        if across:
            linked &= leaf[k + 1 :] != leaf[k]
        yield k, np.flatnonzero(linked) + k + 1


def _pairs_of(sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """``a, b`` with a < b: all linked pairs of nodes, each once."""

    def rows(batches):
        for table in _each_group(batches, ("component", "i", "j")):
            node = table.column("node").to_numpy()
            for k, others in _linked_rows(table, percent):
                ends = np.full(len(others), node[k]), node[others]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(*ends)), pa.array(np.maximum(*ends))], names=["a", "b"]
                )

    return _meeting_leaves(sets, found).mapInArrow(rows, "a bigint, b bigint")


def _counts_of(sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """``node, n_links``: counted where the leaves meet, so that no pair is sent anywhere."""

    def rows(batches):
        for table in _each_group(batches, ("component", "i", "j")):
            total = np.zeros(table.num_rows, dtype=np.int64)
            for k, others in _linked_rows(table, percent):
                total[k] += len(others)
                total[others] += 1
            yield pa.RecordBatch.from_arrays(
                [table.column("node").combine_chunks(), pa.array(total)], names=["node", "n"]
            )

    met = _meeting_leaves(sets, found).mapInArrow(rows, "node bigint, n bigint")
    return met.groupBy("node").agg(F.sum("n").alias("n_links"))


def _with_class(pts: DataFrame, classes: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, class_id`` for every row; a row without id has no class, a text without words its own."""
    joined = pts.join(classes.withColumnRenamed("node", "class_id"), ["key", "key2"], "left")
    own = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("class_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", own.alias("class_id"))


def links(docs: DataFrame, size: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """The join: (``a, b`` with a < b, all linked pairs of classes; ``doc_id, n_shingles, class_id`` of every row).

    Rows of one class have equal sets; the pairs of documents are those of the
    classes by membership, which would repeat every link once per pair of copies.
    """
    pts, classes, nodes, found = _connect(docs, size, percent)
    sets = _sets_of_found(docs, nodes, found, size)
    return _pairs_of(sets, found, percent), _with_class(pts, classes)


def link_counts(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, class_id, n_links`` for every row of ``docs``.

    ``n_links`` is the number of other classes the row's class is linked with,
    so copies do not count; 0 without words, null without id.
    """
    pts, classes, nodes, found = _connect(docs, size, percent)
    sets = _sets_of_found(docs, nodes, found, size)
    counts = materialise(_counts_of(sets, found, percent), "link-counts")
    rows = _with_class(pts, classes).join(counts.withColumnRenamed("node", "class_id"), "class_id", "left")
    number = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("n_links", F.lit(0)))
    return rows.select("doc_id", "n_shingles", "class_id", number.cast("long").alias("n_links"))


def one_per_component(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """Keep the document with the smallest id of every component; all columns unchanged.

    Rows without id are kept.  Rows that repeat an id count as one document:
    one of them stays.
    """
    labels = link_components(docs, size, percent)
    kept = labels.filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("__rows"))
    own, times = fresh_name(docs, "__kept_id"), fresh_name(docs, "__rows")
    kept = materialise(kept.select(F.col("doc_id").alias(own), F.col("__rows").alias(times)), "kept")
    # plain rows stay with their id only looked up; ids on several rows are reduced to one of them
    same_id = F.col("doc_id").cast("long") == F.col(own)
    single = docs.join(kept.filter(F.col(times) == 1), same_id, "left_semi")
    several = docs.join(kept.filter(F.col(times) > 1), same_id, "left_semi").dropDuplicates(["doc_id"])
    return single.unionByName(several).unionByName(docs.filter(F.col("doc_id").isNull()))
