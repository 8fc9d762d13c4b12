"""What changed between full snapshots of a table.

Method: content-defined chunks of key-sorted snapshots. Each key goes to one task with all its snapshots, and every task
sorts its share of each snapshot by key. A chunk ends after a key whose hash has its low bits zero, so equal stretches of
two snapshots fall into equal chunks whatever was inserted before them. Chunks whose digest (keys and content) occurs in
both neighbours are discarded; only rows of unmatched chunks are joined to classify changes, in the task that holds both
sides already. Content travels as a 128-bit
hash, the text itself never leaves the scan.

Defined results
  * Rows with a null key part don't count. Of several rows for one key in a snapshot the latest counts; equal times
    are decided by the greater tie column; a null time is earliest.
  * A snapshot is compared with the next lower one that has rows. The lowest gives nothing. Null and '' content differ,
    two nulls don't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: A chunk holds as many rows as this on average.
CHUNK_ROWS = 8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _digests(keys: np.ndarray, content: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunk digests of a sorted snapshot's share (not empty), and the digest of each row's chunk."""
    ends = (_mix(keys) & np.uint64(rows - 1)) == 0
    chunk = np.cumsum(ends) - ends
    starts = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
    # Order counts: each row's hash is mixed with its place in the chunk.
    place = (np.arange(len(keys)) - starts[chunk]).astype(np.uint64)
    row = _mix(_mix(keys + place * np.uint64(0xD6E8FEB86659FD93)) ^ content)
    digest = np.bitwise_xor.reduceat(row, starts) + np.add.reduceat(_mix(row), starts)
    return digest, digest[chunk]


def changes(df: DataFrame, snapshot: str, keys: list[str], content: str, loaded: str, tie: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(snapshot, *keys, change_kind): 'added', 'removed' or 'changed' against the snapshot before; see the module text."""
    ship(df.sparkSession)
    if chunk_rows & (chunk_rows - 1):
        raise ValueError("chunk_rows must be a power of two")
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(
        F.col(snapshot).cast("int").alias("snap"),
        *[F.col(k).cast("string").alias(n) for k, n in zip(keys, names)],
        F.xxhash64(F.lit(1), content, F.col(content).isNull()).alias("h1"),
        F.xxhash64(F.lit(2), content, F.col(content).isNull()).alias("h2"),
        F.struct(F.col(loaded).alias("at"), F.col(tie).alias("tie")).alias("w"),
    ).na.drop(subset=["snap", *names])
    # Redeliveries of a hot key shrink before the shuffle; then a key has at most one row a snapshot.
    latest = rows.groupBy("snap", *names).agg(F.max_by(F.struct("h1", "h2"), "w").alias("h")).select("snap", *names, "h.h1", "h.h2", F.xxhash64(*names).alias("kh")).repartition(*names)
    snaps = [r[0] for r in df.select(F.col(snapshot).cast("int")).na.drop().distinct().sort(snapshot).collect()]  # one value a snapshot
    following = dict(zip(snaps, snaps[1:]))
    schema = pa.schema([("snap", pa.int32()), *[(n, pa.string()) for n in names], ("kind", pa.string())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by snapshot, then key; of a share of the keys two neighbouring snapshots are held at a time.
        held: list[pa.RecordBatch] = []
        before: tuple[int, pa.Table, np.ndarray, np.ndarray] | None = None

        def emit(snap: int, t: pa.Table, kinds: pa.Array | str) -> Iterator[pa.RecordBatch]:
            if t.num_rows:
                kinds = pa.array([kinds] * t.num_rows) if isinstance(kinds, str) else kinds
                yield from pa.Table.from_arrays([pa.array(np.full(t.num_rows, snap, np.int32)), *[t[n] for n in names], kinds], schema=schema).to_batches()

        def classify(snap: int, old: pa.Table, new: pa.Table) -> Iterator[pa.RecordBatch]:
            sides = [t.select([*names, "h1", "h2"]).append_column("here", pa.array(np.ones(t.num_rows, bool))) for t in (old, new)]
            both = sides[0].join(sides[1], names, join_type="full outer", left_suffix="_o", right_suffix="_n")
            gone, fresh = pc.is_null(both["here_n"]), pc.is_null(both["here_o"])
            other = pc.fill_null(pc.or_(pc.not_equal(both["h1_o"], both["h1_n"]), pc.not_equal(both["h2_o"], both["h2_n"])), True)
            kinds = pc.if_else(fresh, "added", pc.if_else(gone, "removed", "changed"))
            yield from emit(snap, both.filter(other), kinds.filter(other))

        def close(snap: int) -> Iterator[pa.RecordBatch]:
            nonlocal before
            t = pa.Table.from_batches(held)
            held.clear()
            kh = t["kh"].to_numpy().view(np.uint64)
            content = _mix(t["h1"].to_numpy().view(np.uint64)) + t["h2"].to_numpy().view(np.uint64)
            digests, each = _digests(kh, content, chunk_rows)
            if before is not None and following.get(before[0]) == snap:
                yield from classify(snap, before[1].filter(pa.array(~np.isin(before[3], digests))), t.filter(pa.array(~np.isin(each, before[2]))))
            else:
                if before is not None and before[0] in following:  # this share has no rows in the snapshot between
                    yield from emit(following[before[0]], before[1], "removed")
                if snap != snaps[0]:
                    yield from emit(snap, t, "added")
            before = (snap, t, digests, each)

        current = None
        for batch in batches:
            s = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
            for a, z in zip(cuts, cuts[1:]):
                if z > a:
                    if current is not None and s[a] != current:
                        yield from close(current)
                    current = int(s[a])
                    held.append(batch.slice(a, z - a))
        if current is not None:
            yield from close(current)
        if before is not None and before[0] in following:
            yield from emit(following[before[0]], before[1], "removed")

    kinds = "snap int, " + "".join(f"{n} string, " for n in names) + "kind string"
    changed = latest.sortWithinPartitions("snap", *names).mapInArrow(compare, kinds)
    return changed.select(F.col("snap").alias(snapshot), *[F.col(n).alias(k) for n, k in zip(names, keys)], F.col("kind").alias("change_kind"))
