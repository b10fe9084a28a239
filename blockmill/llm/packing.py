"""Problem 3: items placed in containers of fixed capacity.

Mixture-controlled packing: the items of an upload stand in queues by their source. For each container a deficit round-robin
lends every queue its share of the capacity and serves the queue to which most is owed with the largest item that still
fits; what is owed is carried to the next container. A container is closed when nothing fits. Two packings for
fullness alone (best fit in decreasing order; the fullest sum for each container) are made besides, and where one needs fewer containers
it is kept, since few and full containers come first; then the round-robin chooses in which order its containers follow,
and the debts of the queues are those of what they were served.

The target shares are those given, else those of the upload. Every upload is dealt into slices of some SLICE_ITEMS items (most have
one). Containers that a slice leaves unfilled are opened again and dealt anew, until one slice is left or nothing is gained; what is owed to
a queue is divided among the slices that hold it, and kept where none does.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockmill.functions.sizing import resolved_target
from blockmill.llm.pieces import split_oversized
from blockmill.sources.tables import latest_rows, with_checkpoints

#: Items of a slice, on average; a container of less than this share of its capacity is opened again.
SLICE_ITEMS = 500
FULL = 0.97
#: The fullest sum is sought in so many units of the capacity; sizes are rounded up to them.
UNITS = 1 << 15
#: Another round is made if so small a share of the items was left by the one before.
LEFT = 0.5


def shares_of(sizes: list[int], queues: list[str], targets: dict[str, float] | None = None) -> dict[str, float]:
    """The share of each queue: as given, over the queues there are, or its share of the bytes."""
    share: dict[str, float] = {}
    for s, q in zip(sizes, queues):
        share[q] = share.get(q, 0.0) + s
    if targets and any(targets.get(q, 0.0) > 0 for q in share):
        share = {q: max(0.0, targets.get(q, 0.0)) for q in share}
    total = sum(share.values())
    return {q: (x / total if total else 0.0) for q, x in share.items()}


def round_robin(sizes: list[int], queues: list[str], capacity: int, owed: dict[str, float] | None = None, share: dict[str, float] | None = None) -> list[list[int]]:
    """Containers as lists of places in `sizes`. No size is above the capacity."""
    share = share or shares_of(sizes, queues)
    waiting: dict[str, list[tuple[int, int]]] = {}
    for k, (s, q) in enumerate(zip(sizes, queues)):
        waiting.setdefault(q, []).append((s, -k))
    for line in waiting.values():
        line.sort()
    deficit = {q: (owed or {}).get(q, 0.0) for q in share}
    out: list[list[int]] = []
    left = len(sizes)
    while left:
        for q in waiting:
            deficit[q] += share[q] * capacity
        room, held = capacity, []
        while True:
            fitting = [q for q, line in waiting.items() if line and line[0][0] <= room]
            if not fitting:
                break
            best = max(fitting, key=lambda q: deficit[q])
            line = waiting[best]
            size, k = line.pop(bisect_right(line, (room, 1)) - 1)
            held.append(-k)
            room -= size
            deficit[best] -= size
            left -= 1
        out.append(held)
    return out


def debts_after(containers: list[list[int]], sizes: list[int], queues: list[str], capacity: int, share: dict[str, float], owed: dict[str, float]) -> dict[str, float]:
    """What is owed to each queue after these containers: what it was owed and lent, less what it was served."""
    out = {q: owed.get(q, 0.0) + x * capacity * len(containers) for q, x in share.items()}
    for held in containers:
        for k in held:
            out[queues[k]] -= sizes[k]
    return out


def in_turn(containers: list[list[int]], sizes: list[int], queues: list[str], capacity: int, share: dict[str, float], owed: dict[str, float]) -> list[list[int]]:
    """Containers that are packed already, in the order of a deficit round-robin over the queue that each holds most of."""
    lines: dict[str, list[list[int]]] = {}
    for held in containers:
        part = shares_of([sizes[k] for k in held], [queues[k] for k in held])
        lines.setdefault(max(part, key=lambda q: (part[q] - share[q], q)), []).append(held)
    for line in lines.values():
        line.reverse()
    deficit, out = {q: owed.get(q, 0.0) for q in share}, []
    while any(lines.values()):
        for q in deficit:
            deficit[q] += share[q] * capacity
        best = max((q for q, line in lines.items() if line), key=lambda q: (deficit[q], q))
        held = lines[best].pop()
        for k in held:
            deficit[queues[k]] -= sizes[k]
        out.append(held)
    return out


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit in decreasing order."""
    rooms: list[tuple[int, int]] = []
    out: list[list[int]] = []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect_right(rooms, (sizes[k], -1))
        if at < len(rooms):
            room, c = rooms.pop(at)
        else:
            room, c = capacity, len(out)
            out.append([])
        out[c].append(k)
        insort(rooms, (room - sizes[k], c))
    return out


def fullest(sizes: list[int], capacity: int) -> list[list[int]]:
    """Container by container: the largest item left, with those others that fill it best (the reachable sums, in at most UNITS units, are the
    bits of a number)."""
    unit = -(-capacity // UNITS)
    sizes, capacity = [-(-x // unit) for x in sizes], capacity // unit
    left = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    out = []
    while left:
        head, rest = left[0], left[1:]
        room = max(0, capacity - sizes[head])
        mask = (1 << (room + 1)) - 1
        sums, steps = 1, []
        for k in rest:
            steps.append(sums)
            if sizes[k] <= room:
                sums |= (sums << sizes[k]) & mask
        goal = sums.bit_length() - 1
        taken = {head}
        for k, before in zip(reversed(rest), reversed(steps)):
            if not before >> goal & 1:
                taken.add(k)
                goal -= sizes[k]
        out.append([k for k in left if k in taken])
        left = [k for k in left if k not in taken]
    return out


def pack(sizes: list[int], queues: list[str], capacity: int, owed: dict[str, float] | None = None, targets: dict[str, float] | None = None) -> tuple[list[list[int]], dict[str, float]]:
    """The containers of the round-robin, or of the fuller packings where they are fewer; what is owed to each queue."""
    some = [k for k, s in enumerate(sizes) if s > 0]
    none = [k for k, s in enumerate(sizes) if s <= 0]
    sub, names, owed = [sizes[k] for k in some], [queues[k] for k in some], owed or {}
    share = shares_of(sub, names, targets)
    best = round_robin(sub, names, capacity, owed, share)
    least = -(-sum(sub) // capacity)
    for other in (best_fit, fullest):
        if len(best) > least and len(found := other(sub, capacity)) < len(best):
            best = in_turn(found, sub, names, capacity, share, owed)
    debts = {**{q: owed.get(q, 0.0) for q in queues}, **debts_after(best, sub, names, capacity, share, owed)}
    out = [[some[k] for k in c] for c in best]
    if none:
        if not out:
            out.append([])
        out[0] += none
    return out, debts


_KEYS = ["rec", "upload_id", "slice"]
_PACKED = "rec string, upload_id bigint, container bigint, item_id bigint, piece_no int, bytes int, queue string, capacity int, again boolean, owed double"


def _pack_frames(frames: Iterator[pd.DataFrame], round_no: int, last: bool, targets: dict[str, float] | None) -> Iterator[pd.DataFrame]:
    """Packs one slice after another; slices stand together. `last`: containers stay closed however full."""
    held: pd.DataFrame | None = None

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        columns = [frame[c].tolist() for c in ("rec", "upload_id", "slice", "capacity", "item_id", "piece_no", "bytes", "queue", "slices", "owed")]
        n, a = len(frame), 0
        recs, uploads, slices, capacities, items, pieces, sizes, queues, parts, owed = columns
        while a < n:
            b = a + 1
            while b < n and uploads[b] == uploads[a] and slices[b] == slices[a] and recs[b] == recs[a]:
                b += 1
            capacity = int(capacities[a])
            due = {q: d for q, d in zip(queues[a:b], owed[a:b])}
            containers, debts = pack([int(x) for x in sizes[a:b]], queues[a:b], capacity, due, targets)
            final = last or parts[a] <= 1
            for no, held_items in enumerate(containers):
                again = not final and sum(sizes[a + k] for k in held_items) < FULL * capacity
                number = (round_no << 52) | (int(slices[a]) << 26) | no
                out += [(recs[a], uploads[a], number, items[a + k], pieces[a + k], sizes[a + k], queues[a + k], capacity, again, debts[queues[a + k]]) for k in held_items]
            a = b
        return pd.DataFrame(out, columns=["rec", "upload_id", "container", "item_id", "piece_no", "bytes", "queue", "capacity", "again", "owed"])

    for frame in frames:
        if held is not None:
            frame = pd.concat([held, frame], ignore_index=True)
        held = None
        if not len(frame):
            continue
        end = frame.iloc[-1]
        own = (frame["upload_id"] == end["upload_id"]) & (frame["slice"] == end["slice"]) & (frame["rec"] == end["rec"])
        held = frame[own]
        if len(held) < len(frame):
            yield of(frame[~own].reset_index(drop=True))
    if held is not None and len(held):
        yield of(held.reset_index(drop=True))


def pack_items(items: DataFrame, targets: dict[str, float] | None = None, slice_items: int = SLICE_ITEMS) -> DataFrame:
    """(rec, upload_id, container, item_id, piece_no, bytes): every item of (rec, upload_id, item_id, piece_no, bytes, queue, capacity)
    in a container of its upload; the bytes of a container are at most the capacity.

    `targets` gives the shares of queues; without it each upload keeps its own. Items of no bytes go to the first container of
    their slice. No item may be above the capacity: see split_oversized. Items without an upload are taken together.
    The result does not depend on the order or the partitions of rows. An empty table gives an empty result.
    """
    with_checkpoints(items.sparkSession)
    # Items without an upload share a key of their own, the least number there is.
    none = F.lit(-(1 << 63)).cast("bigint")
    keys, columns = ["rec", "upload_id"], ["rec", "upload_id", "item_id", "piece_no", "bytes", "queue", "capacity"]
    rest = items.select("rec", F.coalesce("upload_id", none).alias("upload_id"), "item_id", "piece_no", F.col("bytes").cast("int").alias("bytes"), F.coalesce("queue", F.lit("")).alias("queue"), F.col("capacity").cast("int").alias("capacity")).checkpoint()
    left, done, debts, round_no, final = rest.count(), None, None, 0, False
    while True:
        counts = rest.groupBy(*keys).agg(F.ceil(F.count("*") / slice_items).alias("slices"))
        final = final or (counts.agg(F.max("slices")).first()[0] or 1) <= 1
        sliced = rest.join(counts, keys).withColumn("slice", F.pmod(F.xxhash64("item_id", "piece_no", F.lit(round_no)), F.col("slices")))
        if debts is None:
            due = sliced.withColumn("owed", F.lit(0.0))
        else:
            # A debt is divided among the slices that hold the queue.
            holders = sliced.groupBy(*keys, "queue").agg(F.count_distinct("slice").alias("holders"))
            parts = debts.join(holders, [*keys, "queue"]).select(*keys, "queue", (F.col("owed") / F.col("holders")).alias("owed"))
            due = sliced.join(parts, [*keys, "queue"], "left").withColumn("owed", F.coalesce("owed", F.lit(0.0)))
        laid = due.repartition("rec", "upload_id", "slice").sortWithinPartitions(*_KEYS, F.desc("bytes"), "item_id", "piece_no")
        packed = laid.mapInPandas(lambda f, r=round_no, e=final: _pack_frames(f, r, e, targets), _PACKED)
        if final:
            done = packed if done is None else done.union(packed)
            break
        packed = packed.checkpoint()
        closed = packed.where("NOT again")
        done = closed if done is None else done.union(closed)
        rest = packed.where("again").select(columns)
        debts = debts_of(packed, debts)
        before, left = left, rest.count()
        round_no, final = round_no + 1, left > LEFT * before
    return done.select("rec", F.nullif(F.col("upload_id"), none).alias("upload_id"), "container", "item_id", "piece_no", "bytes")


def debts_of(packed: DataFrame, before: DataFrame | None) -> DataFrame:
    """(rec, upload_id, queue, owed): what all slices of a round owe together; the debt of a queue that none of them held stays."""
    keys = ["rec", "upload_id", "queue"]
    now = packed.select(*keys, F.shiftright("container", 26).alias("part"), "owed").distinct().groupBy(*keys).agg(F.sum("owed").alias("owed"))
    if before is not None:
        now = now.union(before.join(now, keys, "left_anti").select(now.columns))
    return now.checkpoint()


def upload_items(blocks: DataFrame, chunks: DataFrame, uploads: DataFrame) -> DataFrame:
    """(rec, upload_id, item_id, piece_no, bytes, queue, capacity): the texts of the blocks and of the chunks of every upload, each row
    once (the latest of those sent again). A text above the upload's resolved target is cut at natural boundaries; its pieces
    are numbered from 1 and whole items have piece_no 0. Null texts have no bytes; rows without an upload stay together
    under a null upload_id and the default target."""
    sizes = latest_rows(uploads.where("upload_id IS NOT NULL"), ["upload_id"], "received_at", ["upload_id", "target_chars"]).select("upload_id", resolved_target(F.col("target_chars")).alias("capacity"))
    default = resolved_target(F.lit(0))
    out = None
    for rec, rows, key, queue in (("block", blocks, "block_id", "kind"), ("chunk", chunks, "chunk_id", "source_label")):
        rows = rows.where(F.col(key).isNotNull())
        sized = rows.select(F.col(key).alias("item_id"), "upload_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), F.col(queue).alias("queue"), "loaded_at")
        once = latest_rows(sized, ["item_id"], "loaded_at", ["item_id", "upload_id", "bytes", "queue"]).join(sizes, "upload_id", "left").withColumn("capacity", F.coalesce("capacity", default))
        whole = once.where("bytes <= capacity").select(F.lit(rec).alias("rec"), "upload_id", "item_id", F.lit(0).alias("piece_no"), "bytes", "queue", "capacity")
        texts = rows.select(F.col(key).alias("item_id"), "upload_id", "text", "loaded_at", F.col(queue).alias("queue")).where("text IS NOT NULL").join(sizes, "upload_id", "left").withColumn("capacity", F.coalesce("capacity", default)).where(F.octet_length("text") > F.col("capacity"))
        large = latest_rows(texts, ["item_id"], "loaded_at", ["item_id", "upload_id", "text", "queue", "capacity"])
        cut = split_oversized(large.withColumn("__none", F.lit(0)), id_col="item_id", text_col="text", limit_col="capacity", overlap_col="__none")
        pieces = cut.select("item_id", "piece_no", F.octet_length("piece").alias("bytes")).join(once.where("bytes > capacity").select("item_id", "upload_id", "queue", "capacity"), "item_id")
        both = whole.union(pieces.select(F.lit(rec).alias("rec"), "upload_id", "item_id", "piece_no", "bytes", "queue", "capacity"))
        out = both if out is None else out.union(both)
    return out
