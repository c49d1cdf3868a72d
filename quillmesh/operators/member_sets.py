"""Pairs (id, member) packed into one row per vertex and block of members.

A packed row holds the sorted members of one block of 2^22 ids, as differences
of one to three bytes each, or as a bitmap where they lie dense: a pair then
costs two bytes or less in a shuffle instead of a row of two numbers, and dense
sets are merged by words.  A vertex's set spreads over as many rows as
it touches blocks, and may also be split inside a block, so no row grows with
a hub.  Rows are packed, merged and unpacked Arrow batch by Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 22
PACKED = "id bigint, block bigint, members binary"
LEVELLED = "id bigint, block bigint, level int, members binary"

_MASK = (1 << BLOCK_BITS) - 1
_HELD_BYTES = 1 << 20  # packed bytes decoded at a time, a byte or more for each member
_FLAGS_PER_MEMBER = 16
_BITMAP = 0  # first byte of a row: bytes per difference, or this
_BITMAP_COST = 2  # a bitmap may take this many times the bytes of the differences
_OUT_ROWS = 1 << 18
TASK_BYTES = 64 << 20


def pack(pairs: DataFrame) -> DataFrame:
    """PACKED rows of distinct (id, member) pairs; rows with a null are left out."""
    split = pairs.dropna().select(
        "id",
        F.shiftright("member", BLOCK_BITS).alias("block"),
        F.col("member").bitwiseAND(F.lit(_MASK)).cast("int").alias("offset"),
    )
    return split.repartition("id", "block").sortWithinPartitions("id", "block", "offset").mapInArrow(_pack_batches, PACKED)


def least_levels(rows: DataFrame, level: int | None = None, parts: int | None = None) -> DataFrame:
    """LEVELLED rows with every (id, member) once, at its least level; with ``level`` only the members of that level."""
    keys = ["id", "block"]
    spread = rows.select("id", "block", "level", "members")
    spread = spread.repartition(parts, *keys) if parts else spread.repartition(*keys)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_groups(batches):
            yield from _merged(whole, level)

    return spread.sortWithinPartitions(*keys).mapInArrow(merge, LEVELLED)


def unpack(packed: DataFrame, *also: str) -> DataFrame:
    """(id, member) rows of PACKED ones, with the columns ``also``."""
    kept = [f for f in packed.schema.fields if f.name in also]
    schema = ", ".join(["id bigint, member bigint", *[f"{f.name} {f.dataType.simpleString()}" for f in kept]])
    names = [f.name for f in kept]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, _HELD_BYTES >> 3)):
            counts, offsets = _decoded(batch.column("members"))
            row = np.repeat(np.arange(batch.num_rows), counts)
            members = (batch.column("block").to_numpy() << BLOCK_BITS)[row] + offsets
            columns = [batch.column("id").to_numpy()[row], members, *[batch.column(n).to_numpy()[row] for n in names]]
            for at in range(0, len(row), _OUT_ROWS):
                part = [pa.array(c[at : at + _OUT_ROWS]) for c in columns]
                yield pa.RecordBatch.from_arrays(part, names=["id", "member", *names])

    return packed.select("id", "block", "members", *names).mapInArrow(rows, schema)


def task_count(spark, size: int) -> int:
    """Tasks for a shuffle of ``size`` bytes, so that none has to spill."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with ``most`` bytes of members, a row at least."""
    sizes = np.cumsum(pc.binary_length(batch.column("members")).to_numpy())
    at, done = 0, 0
    while at < batch.num_rows:
        until = max(int(np.searchsorted(sizes, done + most, "right")), at + 1)
        yield batch.slice(at, until - at)
        at, done = until, sizes[until - 1]


def _heads(members: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all rows, where each row's content begins and ends, and its first byte."""
    _, ends, data = members.buffers()
    ends = np.frombuffer(ends, np.int32)[members.offset : members.offset + len(members) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    return data, ends[:-1] + 1, ends[1:], data[ends[:-1]].astype(np.int64)


def _decoded(members: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Members per row, and their offsets in the block, row after row."""
    if not len(members):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data, begin, ends, planes = _heads(members)
    dense = np.flatnonzero(planes == _BITMAP)
    if not len(dense):
        return _summed(data, begin, ends, planes)
    counts = np.zeros(len(members), np.int64)
    sparse = np.flatnonzero(planes != _BITMAP)
    counts[sparse], listed = _summed(data, begin[sparse], ends[sparse], planes[sparse])
    mapped = [_set_bits(data[begin[row] : ends[row]]) for row in dense]
    counts[dense] = [len(m) for m in mapped]
    first, offsets = _starts(counts), np.empty(counts.sum(), np.int64)
    few = counts[sparse]
    offsets[np.repeat(first[sparse] - _starts(few), few) + np.arange(len(listed))] = listed
    for row, found in zip(dense, mapped):
        offsets[first[row] : first[row] + len(found)] = found
    return counts, offsets


def _set_bits(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap, bitorder="little"))


def _summed(data: np.ndarray, begin: np.ndarray, ends: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    counts = (ends - begin) // planes
    first = _starts(counts)
    place = np.repeat(begin - first, counts) + np.arange(counts.sum())
    steps = data[place].astype(np.int64)
    for plane in range(1, planes.max()):
        wide = np.flatnonzero(np.repeat(planes > plane, counts))
        steps[wide] |= data[place[wide] + plane * np.repeat(counts, counts)[wide]].astype(np.int64) << (8 * plane)
    total = np.cumsum(steps)
    return counts, total - np.repeat(total[first] - steps[first], counts)


def _encoded(first: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary per row; row r holds the ascending offsets from ``first[r]`` to the next row's first."""
    until = np.append(first[1:], len(offsets))
    counts = until - first
    steps = np.diff(offsets, prepend=0)
    steps[first] = offsets[first]
    widest = np.maximum.reduceat(steps, first)
    planes = 1 + (widest > 0xFF) + (widest > 0xFFFF)
    mapped = (offsets[until - 1] >> 3) + 1
    dense = mapped <= _BITMAP_COST * planes * counts
    sizes = 1 + np.where(dense, mapped, planes * counts)
    planes[dense] = _BITMAP
    begin = _starts(sizes)
    data = np.empty(sizes.sum(), np.uint8)
    data[begin] = planes
    place = np.repeat(begin + 1 - first, counts) + np.arange(len(offsets))
    for plane in range(planes.max()):
        wide = np.flatnonzero(np.repeat(planes > plane, counts))
        data[place[wide] + plane * np.repeat(counts, counts)[wide]] = (steps[wide] >> (8 * plane)) & 0xFF
    for row in np.flatnonzero(dense):
        bits = np.zeros(8 * mapped[row], np.uint8)
        bits[offsets[first[row] : until[row]]] = 1
        data[begin[row] + 1 : begin[row] + sizes[row]] = np.packbits(bits, bitorder="little")
    ends = np.append(begin, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            ids, blocks, offsets = (c.to_numpy() for c in batch.columns)
            first = np.flatnonzero(_group_begins(ids, blocks))
            packed = [pa.array(ids[first]), pa.array(blocks[first]), _encoded(first, offsets.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(packed, names=["id", "block", "members"])


def _group_begins(ids: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    begins = np.ones(len(ids), bool)
    begins[1:] = (ids[1:] != ids[:-1]) | (blocks[1:] != blocks[:-1])
    return begins


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end where a group of equal (id, block) ends; a group longer than the limit is merged as it grows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, blocks = batch.column("id").to_numpy(), batch.column("block").to_numpy()
        last = int(np.flatnonzero(_group_begins(ids, blocks))[-1])
        if held:
            end = held[-1].num_rows - 1
            same = held[-1].column("id")[end].as_py() == ids[0] and held[-1].column("block")[end].as_py() == blocks[0]
            if last or not same:
                yield pa.Table.from_batches([*held, batch.slice(0, last)])
                held = []
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held.append(batch.slice(last))
        if sum(b.column("members").nbytes for b in held) > _HELD_BYTES:
            held = list(_merged(pa.Table.from_batches(held), None))
    if held:
        yield pa.Table.from_batches(held)


def _merged(table: pa.Table, level: int | None) -> Iterator[pa.RecordBatch]:
    """LEVELLED rows of the groups in ``table``, which holds each of its groups whole, in slices of bounded size."""
    table = table.combine_chunks()
    if not table.num_rows:
        return
    begins = _group_begins(table.column("id").to_numpy(), table.column("block").to_numpy())
    first = np.append(np.flatnonzero(begins), table.num_rows)
    sizes = np.append(0, np.cumsum(pc.binary_length(table.column("members")).to_numpy()))
    group = 0
    while group < len(first) - 1:
        until = int(np.searchsorted(sizes[first], sizes[first[group]] + _HELD_BYTES, "right")) - 1
        until = max(until, group + 1)
        yield from _merged_slice(table.slice(first[group], first[until] - first[group]).combine_chunks().to_batches()[0], level)
        group = until


def _merged_slice(batch: pa.RecordBatch, level: int | None) -> Iterator[pa.RecordBatch]:
    """Groups with a bitmap one by one, the others together."""
    begins = _group_begins(batch.column("id").to_numpy(), batch.column("block").to_numpy())
    group = np.cumsum(begins) - 1
    mapped = np.unique(group[_heads(batch.column("members"))[3] == _BITMAP])
    for g in mapped:
        at, until = np.searchsorted(group, [g, g + 1])
        yield from _merged_bitmaps(batch.slice(at, until - at), level)
    rest = ~np.isin(group, mapped)
    if rest.any():
        yield from _merged_lists(batch.filter(pa.array(rest)) if len(mapped) else batch, level)


def _merged_bitmaps(rows: pa.RecordBatch, level: int | None) -> Iterator[pa.RecordBatch]:
    """The same for the rows of one group, by words."""
    levels = rows.column("level").to_numpy()
    data, begin, ends, planes = _heads(rows.column("members"))
    sparse = np.flatnonzero(planes != _BITMAP)
    counts, offsets = _summed(data, begin[sparse], ends[sparse], planes[sparse])
    level_of = np.repeat(levels[sparse], counts)
    span = max(int((ends - begin)[planes == _BITMAP].max()), (int(offsets.max()) >> 3) + 1 if len(offsets) else 0)
    seen = np.zeros(span, np.uint8)
    for now in np.unique(levels):
        flags = np.zeros(8 * span, np.uint8)
        flags[offsets[level_of == now]] = 1
        bits = np.packbits(flags, bitorder="little")
        for row in np.flatnonzero((levels == now) & (planes == _BITMAP)):
            bits[: ends[row] - begin[row]] |= data[begin[row] : ends[row]]
        fresh = bits & ~seen
        seen |= fresh
        if (level is None or now == level) and fresh.any():
            found = _set_bits(fresh)
            arrays = [rows.column("id").slice(0, 1), rows.column("block").slice(0, 1), pa.array([now], pa.int32())]
            packed = _encoded(np.zeros(1, np.int64), found)
            yield pa.RecordBatch.from_arrays([*arrays, packed], names=["id", "block", "level", "members"])


def _merged_lists(batch: pa.RecordBatch, level: int | None) -> Iterator[pa.RecordBatch]:
    ids, blocks = batch.column("id").to_numpy(), batch.column("block").to_numpy()
    begins = _group_begins(ids, blocks)
    group, heads = np.cumsum(begins) - 1, np.flatnonzero(begins)
    counts, offsets = _decoded(batch.column("members"))
    known, rank = np.unique(batch.column("level").to_numpy(), return_inverse=True)
    span = int(offsets.max()) + 1
    keys = np.repeat(group * span, counts) + offsets
    ranks = np.repeat(rank, counts)
    cells = len(heads) * span
    if cells <= _FLAGS_PER_MEMBER * len(keys) and len(known) < 255:
        flags = np.full(cells, 255, np.uint8)
        for r in range(len(known) - 1, -1, -1):
            flags[keys[ranks == r] if len(known) > 1 else keys] = r
        found = [(r, np.flatnonzero(flags == r)) for r in range(len(known))]
    else:
        mixed = np.sort(keys * len(known) + ranks)
        keys = mixed // len(known)
        once = np.append(True, keys[1:] != keys[:-1])
        mixed, keys = mixed[once], keys[once]
        found = [(r, keys[mixed - keys * len(known) == r]) for r in range(len(known))]
    for r, kept in found:
        if len(kept) and (level is None or known[r] == level):
            owner = kept // span
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            row = heads[owner[first]]
            arrays = [pa.array(ids[row]), pa.array(blocks[row]), pa.array(np.full(len(row), known[r], np.int32))]
            yield pa.RecordBatch.from_arrays([*arrays, _encoded(first, kept - owner * span)], names=["id", "block", "level", "members"])
