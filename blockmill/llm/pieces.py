"""Problem 4: items beyond a size limit cut into overlapping pieces at natural boundaries.

Byte ranges: a text or a file is cut into ranges of whole cells; workers look for boundaries in their range alone (a few bytes
before it are read too) and thin them to the best one of each cell. White space that crosses the edge of a range is
settled when the tables are stitched. Where a walk leaves a range depends only on the cut at which it comes in, and there are at most some
sixty of those: each worker tells for each of them where it goes on and how many pieces it makes. Following these steps from range to range
gives the cut at which the true walk enters each range, and summing their pieces gives the number of its first piece. Then every range emits
its own pieces by offset. Nothing holds a whole file; a text of one range takes the same steps within one task. Sizes and offsets are UTF-8 bytes.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.functions.sizing import resolved_max, resolved_overlap
from blockmill.sources.tables import latest_rows, with_checkpoints, written

#: Bytes of a range, at least; and of what is read before it.
RANGE_BYTES = 1 << 20
HALO = 8
_SPACE = b" \t\n\r\v\f"
_GAP = re.compile(rb"[ \t\n\r\v\f]+")
_WIDE = re.compile(rb"\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|\xe3\x80\x81|\xef\xbc\x8c|\xef\xbc\x9b")  # 。！？、，；
_FULL = (b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x9f")
_CLOSERS = b"\"')]}*_"

PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, CHARACTER = 5, 4, 3, 2, 1, 0
Table = list[tuple[int, int]]


def cell_bytes(limit: int, overlap: int) -> int:
    """Bytes of a cell; small against the limit and against what a piece adds to the one before."""
    return max(1, min(limit // 32, (limit - overlap) // 8))


def range_size(limit: int, overlap: int, least: int) -> int:
    """Bytes of a range: whole cells, and several pieces, so that a piece touches no more than two ranges."""
    cell = cell_bytes(limit, overlap)
    return -(-max(least, 4 * limit + 64) // cell) * cell


def usable_overlap(limit: int, overlap: int) -> int:
    """The asked overlap, or less where a piece could not hold a whole new character beside it."""
    return max(0, min(overlap, limit - 4))


class Found(NamedTuple):
    """What a range knows: its table (offset, strength); of white space that it begins with, the offset behind it (-1: it begins with
    none), its line feeds, and the strength of what stands before the range; of white space that it ends with, its line feeds and the
    strength of what stands before that (None: it ends with none; -1: the range is white space throughout)."""

    table: Table
    lead_end: int
    lead_lines: int
    lead_before: int
    tail_lines: int
    tail_before: int | None


def _before(data: bytes, at: int) -> int:
    """The strength that the text before white space at `at` gives it."""
    k = at
    while k > 0 and at - k < 4 and data[k - 1] in _CLOSERS:
        k -= 1
    last = data[k - 1 : k]
    return SENTENCE if last in (b".", b"!", b"?") else CLAUSE if last in (b",", b";", b":") else WORD


def _gap_strength(lines: int, before: int) -> int:
    return PARAGRAPH if lines > 1 else LINE if lines else before


def boundaries(data: bytes, base: int, lo: int, hi: int, cell: int) -> Found:
    """The boundaries with lo <= offset < hi, the best of each cell. `data` holds the text from offset `base` (at most HALO bytes
    before lo) up to hi; lo is a multiple of the cell."""
    best: dict[int, tuple[int, int]] = {}

    def offer(at: int, strength: int) -> None:
        if lo <= at < hi and at > 0:
            key = at // cell
            if (strength, at) > best.get(key, (-1, -1)):
                best[key] = (strength, at)

    lead_end, lead_lines, tail_lines, tail_before = -1, 0, 0, None
    lead_before = _before(data, lo - base)
    for m in _GAP.finditer(data, lo - base):
        at, lines = base + m.start(), m.group().count(b"\n")
        end = base + m.end()
        if at == lo:
            # It may have begun in the range before; its strength is settled when tables are stitched.
            if end < hi:
                lead_end, lead_lines = end, lines
            else:
                tail_lines, tail_before = lines, -1
        elif end < hi:
            offer(end, _gap_strength(lines, _before(data, m.start())))
        else:
            tail_lines, tail_before = lines, _before(data, m.start())
    for m in _WIDE.finditer(data):
        offer(base + m.end(), SENTENCE if m.group() in _FULL else CLAUSE)
    # Where a cell has no boundary, its last start of a character.
    for key in range(lo // cell, -(-hi // cell)):
        if key not in best:
            at, low = min(hi, (key + 1) * cell) - 1, max(lo, key * cell, 1)
            while at >= low and data[at - base] & 0xC0 == 0x80:
                at -= 1
            if at >= low:
                best[key] = (CHARACTER, at)
    return Found([(at, strength) for _, (strength, at) in sorted(best.items())], lead_end, lead_lines, lead_before, tail_lines, tail_before)


def settled_leads(ranges: list[tuple[int, int, int, int, int, int | None]]) -> list[tuple[int, int]]:
    """For ranges in order, given as (lo, lead_end, lead_lines, lead_before, tail_lines, tail_before): the boundary at the end of white
    space that a range begins with, or that ended just before it, and its strength; -1 where there is none."""
    out = []
    held: tuple[int, int] | None = None  # line feeds and strength of white space that has not ended
    for lo, lead_end, lead_lines, lead_before, tail_lines, tail_before in ranges:
        lines, before = held or (0, lead_before)
        if tail_before == -1:
            held = (lines + tail_lines, before)
            out.append((-1, -1))
            continue
        at = lead_end if lead_end >= 0 else lo if held else -1
        out.append((at, _gap_strength(lines + lead_lines, before) if at > 0 else -1))
        held = None if tail_before is None else (tail_lines, tail_before)
    return out


def with_lead(table: Table, at: int, strength: int, cell: int) -> Table:
    """The table of a range with the boundary that stitching settled."""
    if strength < 0:
        return table
    k = bisect_left(table, (at // cell * cell, -1))
    if k < len(table) and table[k][0] // cell == at // cell:
        return [*table[:k], max(table[k], (at, strength), key=lambda x: (x[1], x[0])), *table[k + 1 :]]
    return [*table[:k], (at, strength), *table[k:]]


class Walk:
    """Cuts over a stretch of a table. Of the boundaries in the later half of what a piece may hold, the strongest
    is taken, the last of equals; where there is none between words, the strongest before it."""

    def __init__(self, table: Table, total: int, limit: int, overlap: int):
        self.table, self.total, self.limit, self.overlap = table, total, limit, overlap
        self.offsets = [at for at, _ in table]
        self.known: dict[int, int] = {}

    def start(self, cut: int) -> int:
        """Where the piece after a cut begins."""
        return cut - self.overlap if cut else 0

    def next(self, cut: int) -> int:
        """The cut after `cut` (0: the beginning), or the end of the text."""
        if cut in self.known:
            return self.known[cut]
        start, offsets, table = self.start(cut), self.offsets, self.table
        if self.total - start <= self.limit:
            end = self.total
        else:
            new = max(cut, self.overlap) + 1  # what the next piece repeats is whole
            lo, hi = max(new, start + self.limit // 2), start + self.limit
            i, j = bisect_left(offsets, lo), bisect_right(offsets, hi)
            if i == j:  # no boundary in the later half: the last one that adds something, else the next one at all
                i = bisect_left(offsets, new)
                i, j = (j - 1, j) if i < j else (i, i + 1)
            end, strength = max(table[i:j], key=lambda x: (x[1], x[0]), default=(self.total, CHARACTER))
            if strength == CHARACTER:  # no pause there: the strongest one before, if any
                early = table[bisect_left(offsets, new) : i]
                end = max((x for x in early if x[1] > CHARACTER), key=lambda x: (x[1], x[0]), default=(end, strength))[0]
        self.known[cut] = end
        return end

    def through(self, cut: int, hi: int) -> tuple[int, int]:
        """(first cut at or beyond `hi`, pieces that end before it), from a cut."""
        made = 0
        while cut < hi:
            cut, made = self.next(cut), made + 1
        return cut, made


def entries_of(walk: Walk, lo: int) -> list[int]:
    """The cuts at which a walk can enter a range: what one piece that began before it can reach."""
    return [0] if lo == 0 else [at for at in walk.offsets[bisect_left(walk.offsets, lo) :] if at <= lo + walk.limit + 8]


def split_text(text: str, limit: int, overlap: int, range_bytes: int = RANGE_BYTES) -> list[tuple[int, int, str]]:
    """(start, end, piece) of one text, in memory."""
    data = text.encode("utf-8", "replace")
    used, total = usable_overlap(limit, overlap), len(data)
    cell, size = cell_bytes(limit, used), range_size(limit, used, range_bytes)
    starts = range(0, max(total, 1), size)
    found = [boundaries(data[max(0, lo - HALO) : min(total, lo + size)], max(0, lo - HALO), lo, min(total, lo + size), cell) for lo in starts]
    leads = settled_leads([(lo, *f[1:]) for lo, f in zip(starts, found)])
    table = [x for f, lead in zip(found, leads) for x in with_lead(f.table, *lead, cell)]
    walk, out, cut = Walk(table, total, limit, used), [], 0
    while cut < total or not out:
        start, cut = walk.start(cut), walk.next(cut)
        out.append(_piece(data, 0, start, cut))
    return out


def _piece(data: bytes, base: int, start: int, end: int) -> tuple[int, int, str]:
    """A start inside a character moves on to the next one."""
    while start < end and data[start - base] & 0xC0 == 0x80:
        start += 1
    return start, end, data[start - base : end - base].decode("utf-8", "replace")


# ---- over DataFrames ----


def split_oversized(items: DataFrame, *, id_col: str, text_col: str, limit_col: str, overlap_col: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(id_col, piece_no, start_byte, end_byte, piece) for every item of more than `limit_col` bytes.

    Pieces are numbered from 1, hold at most the limit (a single character beyond it stays whole) and start
    `overlap_col` bytes before the end of the one before, moved on to the next whole character. Where overlap and limit
    leave no room for a new character, the overlap is cut to limit - 4. Items within the limit, null and empty texts,
    and items without a limit give no rows. Repeated rows give repeated pieces; other columns are not read. The size of a range
    has no part in the result.
    """
    narrow = items.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), F.col(limit_col).cast("int").alias("__limit"), F.coalesce(F.col(overlap_col).cast("int"), F.lit(0)).alias("__overlap"))
    # Written once: only the items to be cut, which both branches below read.
    large = written(narrow.where((F.octet_length("__text") > F.col("__limit")) & (F.col("__limit") > 0)))
    kind = narrow.schema["__id"].dataType.simpleString()
    one_range = F.octet_length("__text") <= F.greatest(F.lit(range_bytes), 4 * F.col("__limit").cast("long") + 64)

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, no, a, b, p) for i, text, limit, overlap in frame.itertuples(index=False) for no, (a, b, p) in enumerate(split_text(text, limit, overlap, range_bytes), 1)]
            yield pd.DataFrame(rows, columns=["__id", "piece_no", "start_byte", "end_byte", "piece"])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ident, text, limit, overlap, row in frame.itertuples(index=False):
                data = text.encode("utf-8", "replace")
                size = range_size(limit, usable_overlap(limit, overlap), range_bytes)
                for lo in range(0, len(data), size):
                    base = max(0, lo - HALO - limit)
                    yield pd.DataFrame({"__row": [row], "__id": [ident], "__limit": [limit], "__overlap": [overlap], "__total": [len(data)], "__lo": [lo], "__base": [base], "__data": [data[base : lo + size]]})

    # Rows are told apart by a number, so that equal rows give their pieces each.
    several = large.where(~one_range).withColumn("__row", F.monotonically_increasing_id())
    ranges = several.mapInPandas(cut, f"__row bigint, __id {kind}, __limit int, __overlap int, __total bigint, __lo bigint, __base bigint, __data binary").checkpoint()
    short = large.where(one_range).mapInPandas(whole, f"__id {kind}, piece_no int, start_byte bigint, end_byte bigint, piece string")
    return short.unionByName(_split_ranges(ranges, kind, range_bytes)).withColumnRenamed("__id", id_col)


def split_files(spark: SparkSession, path: str, limit: int, overlap: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, piece_no, start_byte, end_byte, piece) of UTF-8 files, of any size: workers read byte ranges, and no file is
    held whole. A file within the limit is one piece; files of no bytes have none."""
    with_checkpoints(spark)
    used = usable_overlap(limit, overlap)
    size = range_size(limit, used, range_bytes)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("__total")).where("__total > 0")
    ranges = files.select(F.xxhash64("path").alias("__row"), F.col("path").alias("__id"), F.lit(limit).alias("__limit"), F.lit(overlap).alias("__overlap"), "__total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__total") - 1, F.lit(size).cast("long"))).alias("__lo"))
    ranges = ranges.withColumn("__base", F.greatest(F.lit(0).cast("long"), F.col("__lo") - HALO - limit)).withColumn("__data", F.lit(None).cast("binary"))
    return _split_ranges(ranges.repartition("__id", "__lo"), "string", range_bytes).withColumnRenamed("__id", "path")


def _bytes_of(data: bytes | None, path: object, base: int, end: int) -> bytes:
    """The bytes of a range: those that travel with it, or those of the file from `base` up to `end`."""
    if data is not None:
        return bytes(data)
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(str(path))
    with system.open_input_file(name) as f:
        return f.read_at(end - base, base)


def _split_ranges(ranges: DataFrame, kind: str, range_bytes: int) -> DataFrame:
    """The pieces of (__row, __id, __limit, __overlap, __total, __lo, __base, __data): ranges of texts, __data from __base on, or null for a file."""
    fixed = f"__row bigint, __id {kind}, __limit int, __overlap int, __total bigint, __lo bigint, __base bigint, __data binary"
    names = [x.split(" ")[0] for x in fixed.split(", ")]

    def shape(limit: int, overlap: int) -> tuple[int, int, int]:
        used = usable_overlap(limit, overlap)
        return used, cell_bytes(limit, used), range_size(limit, used, range_bytes)

    def detect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame[names].itertuples(index=False):
                _, ident, limit, overlap, total, lo, base, data = row
                _, cell, size = shape(limit, overlap)
                hi = min(total, lo + size)
                held = _bytes_of(data, ident, base, hi)
                skip = max(0, lo - HALO) - base
                f = boundaries(held[skip:], base + skip, lo, hi, cell)
                yield pd.DataFrame([(*row, [a for a, _ in f.table], [s for _, s in f.table], *f[1:])], columns=[*names, "__at", "__strength", "lead_end", "lead_lines", "lead_before", "tail_lines", "tail_before"])

    tables = ranges.mapInPandas(detect, f"{fixed}, __at array<bigint>, __strength array<int>, lead_end bigint, lead_lines int, lead_before int, tail_lines int, tail_before int").checkpoint()
    key = ["__row", "__lo"]

    def in_order(f, made: str, columns: list[str]):
        """Applies f to the few numbers of all ranges of a text, in order."""
        return lambda df, values: df.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("__lo", *values))).alias("x")).mapInPandas(lambda frames: (pd.DataFrame([(r, *y) for r, x in zip(frame["__row"], frame["x"]) for y in f(x)], columns=["__row", *columns]) for frame in frames), made)

    facts = ["lead_end", "lead_lines", "lead_before", "tail_lines", "tail_before"]

    def settle(x) -> Iterator[tuple[int, int, int]]:
        known = [(int(y["__lo"]), *(y[c] for c in facts)) for y in x]
        return ((k[0], *lead) for k, lead in zip(known, settled_leads(known)))

    led = tables.join(in_order(settle, "__row bigint, __lo bigint, lead_at bigint, lead int", ["__lo", "lead_at", "lead"])(tables, facts), key)
    # What a range hands back to the one before: its boundaries up to where a piece that begins there can end.
    behind = led.select("__row", "__lo", "__at", "__strength", "lead_at", "lead", "__limit", "__overlap")

    def heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row, lo, at, strength, lead_at, lead, limit, overlap in frame.itertuples(index=False):
                used, cell, size = shape(limit, overlap)
                table = with_lead(list(zip(map(int, at), map(int, strength))), lead_at, lead, cell)
                head = [x for x in table if x[0] <= lo + limit + 8 + cell]
                out.append((row, lo - size, [a for a, _ in head], [s for _, s in head]))
            yield pd.DataFrame(out, columns=["__row", "__lo", "next_at", "next_strength"])

    headed = led.join(behind.where("__lo > 0").mapInPandas(heads, "__row bigint, __lo bigint, next_at array<bigint>, next_strength array<int>"), key, "left").checkpoint()

    def walk_of(x) -> tuple[Walk, int]:
        used, cell, size = shape(x["__limit"], x["__overlap"])
        table = with_lead(list(zip(map(int, x["__at"]), map(int, x["__strength"]))), int(x["lead_at"]), int(x["lead"]), cell)
        if x["next_at"] is not None:
            table += zip(map(int, x["next_at"]), map(int, x["next_strength"]))
        return Walk(table, int(x["__total"]), int(x["__limit"]), used), min(int(x["__total"]), int(x["__lo"]) + size)

    def steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for x in frame.to_dict("records"):
                walk, hi = walk_of(x)
                entries = entries_of(walk, int(x["__lo"]))
                ways = [walk.through(e, hi) for e in entries]
                out.append((x["__row"], x["__lo"], entries, [w[0] for w in ways], [w[1] for w in ways]))
            yield pd.DataFrame(out, columns=["__row", "__lo", "entries", "exits", "pieces"])

    def follow(x) -> Iterator[tuple[int, int, int]]:
        """(range, cut at which the walk enters it, number of its first piece)."""
        cut, number = 0, 1
        for y in x:
            yield int(y["__lo"]), cut, number
            ways = {int(e): (int(o), int(n)) for e, o, n in zip(y["entries"], y["exits"], y["pieces"])}
            cut, made = ways.get(cut, (cut, 0))
            number += made

    stepped = headed.select(*key, "__limit", "__overlap", "__total", "__at", "__strength", "lead_at", "lead", "next_at", "next_strength").mapInPandas(steps, "__row bigint, __lo bigint, entries array<bigint>, exits array<bigint>, pieces array<bigint>")
    entered = in_order(follow, "__row bigint, __lo bigint, cut bigint, number bigint", ["__lo", "cut", "number"])(stepped, ["entries", "exits", "pieces"])

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for x in frame.to_dict("records"):
                walk, hi = walk_of(x)
                # A piece is emitted by the range in which the cut before it lies; it may end in the next one, which is read as far.
                cut, number, base, out = int(x["cut"]), int(x["number"]), int(x["__base"]), []
                if cut >= hi:
                    continue
                last, _ = walk.through(cut, hi)
                data = _bytes_of(x["__data"], x["__id"], base, hi)
                if last > hi:
                    data += _bytes_of(x["next_data"], x["__id"], hi, last) if x["__data"] is None else bytes(x["next_data"])
                while cut < hi:
                    start, cut = walk.start(cut), walk.next(cut)
                    out.append((x["__id"], number, *_piece(data, base, start, cut)))
                    number += 1
                yield pd.DataFrame(out, columns=["__id", "piece_no", "start_byte", "end_byte", "piece"])

    # The bytes behind a range that its last piece may reach.
    reach = F.expr("substring(__data, cast(__lo - __base + 1 as int), __limit + 8)")
    near = ranges.where("__lo > 0").select("__row", F.col("__lo").alias("__after"), reach.alias("next_data"))
    sized = headed.join(entered, key).withColumn("__after", F.col("__lo") + _size_column(range_bytes))
    return sized.join(near, ["__row", "__after"], "left").mapInPandas(emit, f"__id {kind}, piece_no int, start_byte bigint, end_byte bigint, piece string")


def _size_column(range_bytes: int):
    """range_size as an expression."""
    limit = F.col("__limit").cast("long")
    used = F.greatest(F.lit(0), F.least(F.col("__overlap").cast("long"), limit - 4))
    cell = F.greatest(F.lit(1), F.least(F.floor(limit / 32), F.floor((limit - used) / 8)))
    return (F.ceil(F.greatest(F.lit(range_bytes).cast("long"), 4 * limit + 64) / cell) * cell).cast("bigint")


def oversized_chunks(chunks: DataFrame, uploads: DataFrame) -> DataFrame:
    """Chunks (latest row of each) beyond the resolved max of their upload, with __limit and __overlap.

    A chunk whose upload is not in `uploads`, or has null options, falls under the defaults.
    """
    sizes = latest_rows(uploads.where(F.col("upload_id").isNotNull()), ["upload_id"], "received_at", ["upload_id", "target_chars", "overlap_chars", "max_chars"])
    sizes = sizes.select(
        "upload_id",
        resolved_max(F.col("target_chars"), F.col("max_chars")).alias("__limit"),
        resolved_overlap(F.col("target_chars"), F.col("overlap_chars")).alias("__overlap"),
    )
    rows = chunks.where(F.col("text").isNotNull()).select("chunk_id", "upload_id", "text", "loaded_at")
    limit, none = F.coalesce(F.col("__limit"), resolved_max(F.lit(0), F.lit(0))), F.lit(0)
    large = rows.join(sizes, "upload_id", "left").where(F.octet_length("text") > limit)
    large = large.select("chunk_id", "text", "loaded_at", limit.alias("__limit"), F.coalesce("__overlap", none).alias("__overlap"))
    return latest_rows(large, ["chunk_id"], "loaded_at", ["text", "__limit", "__overlap"])


def chunk_pieces(chunks: DataFrame, uploads: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The pieces of all chunks beyond their upload's limit."""
    return split_oversized(oversized_chunks(chunks, uploads), id_col="chunk_id", text_col="text", limit_col="__limit", overlap_col="__overlap", range_bytes=range_bytes)
