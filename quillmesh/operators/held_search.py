"""Breadth-first search from every vertex over a graph that each executor holds as one file.

Pairs that lie within k hops outgrow the graph by far, so nothing made of pairs
is shuffled or written here.  The edges are numbered and sorted by Spark, laid
out as one file of arrays, and given to the executors, whose workers map it into
memory: they share one copy, and the page cache may drop it.  Every task walks
from its share of the vertices, one after the other, and needs a few numbers per
vertex of its own.  What it meets leaves as rows, or added up per source and
level where only totals are asked for.

``hold`` returns None for a graph beyond ``HELD_BYTES``; callers then go hop by
hop with joins.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators.ordering import dense_index
from quillmesh.session import materialise

HELD_BYTES = 1 << 30
_STEP = 1 << 20  # neighbours looked at together
_OUT_ROWS = 1 << 17
_TASKS_PER_CORE = 16
_LEAST_SOURCES = 256  # vertices that are worth a task
_NONE_LEAST, _NONE_GREATEST = (1 << 63) - 1, -(1 << 63)


@dataclass(frozen=True)
class Totals:
    """What is added up over the members of a vertex at one level, as (id, level, ``by``, results).

    The expressions read a row of ``held`` (id and further columns) per member,
    as a join would give it, or ``member`` itself where there is no such table,
    as a text if ``text`` says so.  All are whole numbers; least and greatest
    may be texts.
    """

    count: str
    sums: Mapping[str, Column] = field(default_factory=dict)
    least: Mapping[str, Column] = field(default_factory=dict)
    greatest: Mapping[str, Column] = field(default_factory=dict)
    by: str | None = None
    held: DataFrame | None = None
    text: bool = False

    def of(self, found: DataFrame) -> DataFrame:
        """The totals of rows (id, member, level)."""
        if self.held is not None:
            found = found.withColumnRenamed("member", "__member").join(self.held.withColumnRenamed("id", "__member"), "__member")
        elif self.text:
            found = found.withColumn("member", F.col("member").cast("string"))
        return found.groupBy("id", "level", *self._by).agg(*self._aggregates())

    @property
    def _by(self) -> list[str]:
        return [] if self.by is None else [self.by]

    @property
    def names(self) -> list[str]:
        return [self.count, *self.sums, *self.least, *self.greatest]

    def _aggregates(self) -> list[Column]:
        return [
            F.count(F.lit(1)).alias(self.count),
            *[F.sum(v).alias(k) for k, v in self.sums.items()],
            *[F.min(v).alias(k) for k, v in self.least.items()],
            *[F.max(v).alias(k) for k, v in self.greatest.items()],
        ]


@dataclass(frozen=True)
class _Values:
    """Totals per member, ready to be held: one row per id, texts and groups as numbers."""

    table: DataFrame
    sums: list[str]
    least: list[str]
    greatest: list[str]
    texts: DataFrame | None
    worded: list[str]
    groups: DataFrame | None

    @property
    def columns(self) -> list[str]:
        return [*self.sums, *self.least, *self.greatest, *([] if self.groups is None else ["__by"])]


def _values(totals: Totals, ids: DataFrame) -> _Values | None:
    """None where a member belongs to several groups."""
    rows = totals.held
    if rows is None:
        rows = ids.select("id", F.col("id").cast("string" if totals.text else "long").alias("member"))
    extremes = [*totals.least, *totals.greatest]
    picked = {**totals.sums, **totals.least, **totals.greatest}
    rows = rows.select("id", *totals._by, *[v.alias(k) for k, v in picked.items()]).filter("id is not null")
    texts = groups = None
    worded = [c for c in extremes if rows.schema[c].dataType.simpleString() == "string"]
    if worded:
        rows = materialise(rows, "held-rows")
        words = rows.select(F.explode(F.array(*worded)).alias("text")).filter("text is not null").distinct()
        texts = materialise(dense_index(words, ["text"], "place"), "held-texts")
        rows = as_places(rows, texts, *worded)
    if totals.by is not None:
        groups = materialise(dense_index(rows.select(F.col(totals.by).alias("value")).distinct(), ["value"], "__by"), "held-groups")
        rows = rows.join(groups, F.col(totals.by).eqNullSafe(F.col("value"))).drop("value", totals.by)
    keys = ["id", *([] if groups is None else ["__by"])]
    told = {f"__told_{c}": F.count(c) for c in totals.sums}
    table = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(totals.count),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in totals.sums],
        *[v.alias(k) for k, v in told.items()],
        *[F.coalesce(F.min(c), F.lit(_NONE_LEAST)).cast("long").alias(c) for c in totals.least],
        *[F.coalesce(F.max(c), F.lit(_NONE_GREATEST)).cast("long").alias(c) for c in totals.greatest],
    )
    table = materialise(table, "held-values")
    if groups is not None and not table.groupBy("id").count().filter("count > 1").isEmpty():
        return None
    # where every row has a value, the count tells as much
    unsaid = [F.count_if(F.col(f"__told_{c}") < F.col(totals.count)).alias(c) for c in totals.sums]
    missing = table.agg(F.lit(0), *unsaid).first().asDict()
    kept = [f"__told_{c}" for c in totals.sums if missing[c]]
    return _Values(table, [totals.count, *totals.sums, *kept], [*totals.least], [*totals.greatest], texts, worded, groups)


def as_places(rows: DataFrame, places: DataFrame, *columns: str) -> DataFrame:
    """The texts in ``columns`` as their places in (text, place)."""
    for c in columns:
        place = places.select(F.col("text").alias(c), F.col("place").alias(f"__{c}"))
        rows = rows.join(place, c, "left").drop(c).withColumnRenamed(f"__{c}", c)
    return rows


def as_texts(rows: DataFrame, places: DataFrame, *columns: str) -> DataFrame:
    """The places in ``columns`` as the texts of (text, place)."""
    for c in columns:
        text = places.select(F.col("text").alias(f"__{c}"), F.col("place").alias(c))
        rows = rows.join(text, c, "left").drop(c).withColumnRenamed(f"__{c}", c)
    return rows


@dataclass(frozen=True)
class _Part:
    """An array of the file."""

    dtype: str
    count: int
    offset: int


@dataclass(frozen=True)
class HeldGraph:
    """File of a numbered graph: per way the far ends of every vertex, the ids in order, and values of theirs."""

    spark: SparkSession
    name: str
    parts: dict[str, _Part]
    ways: tuple[str, ...]
    values: _Values | None

    def rows(self, level: int) -> DataFrame:
        """(id, member) at one level from 2 on; members ascend."""
        name, parts, ways = self.name, self.parts, self.ways

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph = _Walker(name, parts, ways)
            sources: list[int] = []
            met: list[np.ndarray] = []
            held = 0
            for source in graph.sources(batches):
                for at, members in graph.levels(source, level):
                    if at == level and len(members):
                        sources.append(source)
                        met.append(np.sort(members))
                        held += len(members)
                if held >= _OUT_ROWS:
                    yield from graph.pairs(sources, met)
                    sources, met, held = [], [], 0
            yield from graph.pairs(sources, met)

        return self._shares().mapInArrow(walk, "id bigint, member bigint")

    def totals(self, rounds: int, totals: Totals) -> DataFrame:
        """(id, level, by, results) from level 2 on; one row each."""
        name, parts, ways, values = self.name, self.parts, self.ways, self.values
        sums, least, greatest, grouped = values.sums, values.least, values.greatest, values.groups is not None
        columns = ["id", "level", *values.columns]
        schema = ", ".join(f"`{c}` {'int' if c == 'level' else 'bigint'}" for c in columns)

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph = _Walker(name, parts, ways)
            out: list[tuple[int, ...]] = []
            for source in graph.sources(batches):
                for level, members in graph.levels(source, rounds + 1):
                    out += [(source, level, *row) for row in graph.added(members, sums, least, greatest, grouped)]
                if len(out) >= _OUT_ROWS >> 3:
                    yield graph.table(out, columns)
                    out = []
            if out:
                yield graph.table(out, columns)

        found = self._shares().mapInArrow(walk, schema)
        for c in totals.sums:
            if f"__told_{c}" in sums:
                found = found.withColumn(c, F.when(F.col(f"__told_{c}") > 0, F.col(c)))
        for c, none in [*((c, _NONE_LEAST) for c in least), *((c, _NONE_GREATEST) for c in greatest)]:
            found = found.withColumn(c, F.when(F.col(c) != none, F.col(c)))
        if values.texts is not None:
            found = as_texts(found, values.texts, *values.worded)
        if grouped:
            found = found.join(values.groups.withColumnRenamed("value", totals.by), "__by")
        return found.select("id", "level", *totals._by, *totals.names)

    def _shares(self) -> DataFrame:
        """A row per task: which share of the vertices it walks from, of how many."""
        worth = -(-self.parts["ids"].count // _LEAST_SOURCES)
        tasks = max(min(worth, self.spark.sparkContext.defaultParallelism * _TASKS_PER_CORE), 1)
        return self.spark.range(0, tasks, 1, tasks).select("id", F.lit(tasks).cast("long").alias("of"))


def hold(vertices: DataFrame, edges: DataFrame, ways: Sequence[str], totals: Totals | None = None, limit: int | None = None) -> HeldGraph | None:
    """The graph of distinct (src, dst) pairs without loops as a file on every executor, or None if it takes too much."""
    limit = HELD_BYTES if limit is None else limit
    spark = vertices.sparkSession
    pairs = materialise(edges.select("src", "dst").filter("src <> dst").distinct(), "pairs")
    size = 4 * pairs.count() * len(ways)
    if size > limit:
        return None
    own = vertices.select("id").distinct().withColumn("own", F.lit(1).cast("long"))
    ends = pairs.select(F.col("src").alias("id")).union(pairs.select(F.col("dst").alias("id"))).distinct()
    places = materialise(dense_index(ends.join(own, "id", "left").fillna(0, ["own"]), ["id"], "place"), "places")
    ids = places.select("id", "place", "own")
    count = places.count()
    values = None
    if totals is not None:
        values = _values(totals, ids)
        if values is None:
            return None
        ids = ids.join(values.table.select("id", *values.columns, F.lit(1).cast("long").alias("__has")), "id", "left")
        # a sum over all members must not leave 64 bits
        largest = values.table.agg(F.lit(0), *[F.max(F.abs(F.col(c).cast("decimal(20,0)"))).alias(c) for c in values.sums]).first()
        if any(int(largest[c] or 0) * max(count, 1) >= 1 << 63 for c in values.sums):
            return None
    columns = [c for c in ids.columns if c not in ("id", "place")]
    size += 8 * count * (2 + len(columns)) + 8 * (count + 1) * len(ways)
    if size > limit or count >= 1 << 31:
        return None
    near = places.select(F.col("id").alias("src"), F.col("place").cast("int").alias("near"))
    far = places.select(F.col("id").alias("dst"), F.col("place").cast("int").alias("far"))
    numbered = materialise(pairs.join(near, "src").join(far, "dst").select("near", "far"), "numbered")
    name = f"held-{uuid.uuid4().hex}"
    path = os.path.join(spark.sparkContext._temp_dir, name)  # goes when the session ends
    parts: dict[str, _Part] = {}
    with open(path, "wb") as file:
        for column in ["ids", *columns]:
            picked = ids.select("place", F.coalesce(F.col("id" if column == "ids" else column), F.lit(0)).alias("value"))
            written = 0
            offset = file.tell()
            for (data,) in _in_order(picked.sort("place").select("value"), "value"):
                written += file.write(data)
            parts[column] = _Part("int64", written >> 3, offset)
        for way in ways:
            a, b = ("near", "far") if way == "out" else ("far", "near")
            offset, written, degrees = file.tell(), 0, np.zeros(count + 1, np.int64)
            for ends_at, data in _in_order(numbered.select(F.col(a).alias("a"), F.col(b).alias("b")).sort("a", "b"), "a", "b"):
                first = np.frombuffer(ends_at, np.int32)
                low = int(first[0])
                seen = np.bincount(first - low)
                degrees[low + 1 : low + 1 + len(seen)] += seen
                written += file.write(data)
            parts[f"{way}_ends"] = _Part("int32", written >> 2, offset)
            file.write(b"\0" * (-file.tell() % 8))
            parts[f"{way}_start"] = _Part("int64", count + 1, file.tell())
            file.write(np.cumsum(degrees).tobytes())
    spark.sparkContext.addFile(path)
    return HeldGraph(spark, name, parts, tuple(ways), values)


def _in_order(rows: DataFrame, *columns: str) -> Iterator[Sequence[bytes]]:
    """The bytes of ``columns``, piece by piece, in the order of the rows."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(c).to_numpy().tobytes()], pa.binary()) for c in columns], names=list(columns))

    return rows.mapInArrow(pieces, ", ".join(f"{c} binary" for c in columns)).toLocalIterator()


class _Walker:
    """The file of a held graph as a worker reads it, and which vertices the present walk has met.

    ``mark`` has a number that grows with every vertex met: one below ``floor``
    is from an earlier walk, so nothing is cleared between walks.
    """

    def __init__(self, name: str, parts: Mapping[str, _Part], ways: Sequence[str]):
        path = SparkFiles.get(name)
        self.arrays = {
            k: np.asarray(np.memmap(path, p.dtype, "r", p.offset, (p.count,))) if p.count else np.zeros(0, p.dtype) for k, p in parts.items()
        }
        self.ids, self.own = self.arrays["ids"], self.arrays["own"]
        self.ways = [(self.arrays[f"{w}_start"], self.arrays[f"{w}_ends"]) for w in ways]
        self.some_lack = "__has" in self.arrays and not self.arrays["__has"].all()
        self.mark = np.full(len(self.ids), -1, np.int32)
        self.next = self.floor = 0
        self.ones = {k for k, a in self.arrays.items() if a.dtype == np.int64 and len(a) and a.min() == 1 == a.max()}
        self.rising = {k for k, a in self.arrays.items() if a.dtype == np.int64 and not (a[1:] < a[:-1]).any()}

    def sources(self, batches: Iterator[pa.RecordBatch]) -> Iterator[int]:
        for batch in batches:
            for share, of in zip(*(c.to_pylist() for c in batch.columns)):
                mine = np.arange(share, len(self.ids), of)
                degree = sum(start[mine + 1] - start[mine] for start, _ in self.ways)
                yield from mine[degree > 0].tolist()

    def levels(self, source: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
        """(level, members first met there) from 2 to ``last``, each at its least level over all ways."""
        walks = [self._way(source, last, *way) for way in self.ways]
        if len(walks) == 1:
            yield from walks[0]
            return
        found = [list(walk) for walk in walks]  # one way after the other, as they share the marks
        self._begin()
        for k in range(max(map(len, found))):
            both = np.concatenate([walk[k][1] for walk in found if k < len(walk)])
            yield k + 2, self._fresh(both)

    def _way(self, source: int, last: int, start: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        self._begin()
        newest = np.array([source])
        if self.own[source]:
            self._fresh(newest)
        for level in range(2, last + 1):
            newest = self._onward(newest, start, ends)
            if not len(newest):
                return
            yield level, newest

    def _begin(self) -> None:
        if self.next >= 1 << 30:
            self.mark.fill(-1)
            self.next = 0
        self.floor = self.next

    def _fresh(self, found: np.ndarray) -> np.ndarray:
        """What the walk had not met, once."""
        found = found[self.mark.take(found) < self.floor]
        number = np.arange(self.next, self.next + len(found), dtype=np.int32)
        self.mark[found] = number
        self.next += len(found)
        return found[self.mark.take(found) == number]

    def _onward(self, newest: np.ndarray, start: np.ndarray, ends: np.ndarray) -> np.ndarray:
        first = start.take(newest)
        counts = start.take(newest + 1) - first
        total = np.cumsum(counts)
        if not len(total) or total[-1] == 0:
            return newest[:0]
        if total[-1] <= _STEP:
            return self._fresh(self._ends(first, counts, total, ends))
        met, at = [], 0
        while at < len(newest):
            done = total[at - 1] if at else 0
            until = max(int(np.searchsorted(total, done + _STEP, "right")), at + 1)
            met.append(self._fresh(self._ends(first[at:until], counts[at:until], total[at:until] - done, ends)))
            at = until
        return np.concatenate(met)

    @staticmethod
    def _ends(first: np.ndarray, counts: np.ndarray, total: np.ndarray, ends: np.ndarray) -> np.ndarray:
        place = np.repeat(first - (total - counts), counts)
        place += np.arange(len(place))
        return ends.take(place).astype(np.intp)

    def pairs(self, sources: list[int], met: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for source, members in zip(_runs(sources, met), _runs(met, met)):
            owner = self.ids[np.repeat(np.array(source), [len(m) for m in members])]
            member = self.ids[np.concatenate(members)]
            for at in range(0, len(owner), 8 * _OUT_ROWS):
                part = [pa.array(c[at : at + 8 * _OUT_ROWS]) for c in (owner, member)]
                yield pa.RecordBatch.from_arrays(part, names=["id", "member"])

    def added(self, members: np.ndarray, sums: list[str], least: list[str], greatest: list[str], grouped: bool) -> list[tuple[int, ...]]:
        if self.some_lack:
            members = members[self.arrays["__has"].take(members) > 0]
        if not len(members):
            return []
        if not grouped:
            results = [len(members) if c in self.ones else self.arrays[c].take(members).sum() for c in sums]
            # values that rise with the vertices need not be looked at one by one
            results += [self.arrays[c][members.min()] if c in self.rising else self.arrays[c].take(members).min() for c in least]
            results += [self.arrays[c][members.max()] if c in self.rising else self.arrays[c].take(members).max() for c in greatest]
            return [tuple(map(int, results))]
        group = self.arrays["__by"].take(members)
        if group.max() < 1 << 16:
            group = group.astype(np.uint16)  # sorted by digits
        order = np.argsort(group, kind="stable")
        members, group = members.take(order), group.take(order)
        cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        results = [np.add.reduceat(self.arrays[c].take(members), cut) for c in sums]
        results += [np.minimum.reduceat(self.arrays[c].take(members), cut) for c in least]
        results += [np.maximum.reduceat(self.arrays[c].take(members), cut) for c in greatest]
        return list(zip(*(r.tolist() for r in [*results, group[cut].astype(np.int64)])))

    def table(self, out: list[tuple[int, ...]], columns: list[str]) -> pa.RecordBatch:
        arrays = [np.array(c, np.int64) for c in zip(*out)]
        arrays[0] = self.ids[arrays[0]]
        arrays[1] = arrays[1].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=columns)


def _runs(items: list, met: list[np.ndarray]) -> Iterator[list]:
    """``items`` in runs whose members in ``met`` make one batch, or of one source."""
    run, held = [], 0
    for item, members in zip(items, met):
        if run and held + len(members) > 8 * _OUT_ROWS:
            yield run
            run, held = [], 0
        run.append(item)
        held += len(members)
    if run:
        yield run
