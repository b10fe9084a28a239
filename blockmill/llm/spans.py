"""Problem 8: long stretches of text that another document holds verbatim.

Fixed-length blocks serve as anchors. Every rolling window of half the span length is hashed, and a window becomes an
anchor where its hash is the least among the windows of some span it lies in; any two equal spans choose equal
anchors, so none is missed, while only about one window in fifty is ever shuffled. (Indexing the non-overlapping blocks and
probing them with every rolling window was measured to shuffle 23.8 times the input; see README.)

Anchors that two documents share are extended: the span that starts at an anchor settles nearly all cases; where it
does not, all spans around the anchor are compared. Hashes of spans have 64 bits. For the repeats that shared_spans reports, texts are
compared: each is extended to both sides, character by character, until the two documents differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from blockmill.sources.tables import spread, with_checkpoints, written

SPAN = 200
#: Characters worked on at once; a longer text is taken in segments that overlap by three spans.
SEGMENT = 1 << 19
#: At most so many ids of documents are broadcast; more are joined.
BROADCAST_IDS = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = SEGMENT + 8 * SPAN + 4096
    out = []
    for base in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _sums(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    up = _powers()[0]
    if len(points) >= len(up):
        raise ValueError("segment too long")
    out = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_mixed(points + np.uint64(0x5851F42D)) * up[: len(points)], out=out[1:])
    return out


def _windows(sums: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the windows of `size` characters: of all, or of those that start at `at`."""
    down = _powers()[1]
    if at is None:
        n = len(sums) - size
        return _mixed((sums[size:] - sums[:n]) * down[:n]) if n > 0 else np.zeros(0, np.uint64)
    return _mixed((sums[at + size] - sums[at]) * down[at])


def _sliding(values: np.ndarray, width: int, f) -> np.ndarray:
    out, span = values, 1
    while span * 2 <= width:
        out = f(out[:-span], out[span:])
        span *= 2
    return f(out[: len(out) - (width - span)], out[width - span :]) if width > span else out


def _segments(text: str, halo: int) -> Iterator[tuple[int, int, int, str]]:
    """(offset of the part, first and last own position, part) with `halo` characters of context on both sides."""
    n = len(text)
    for start in range(0, max(n, 1), SEGMENT):
        lo, hi = max(0, start - halo), min(n, start + SEGMENT + halo)
        yield lo, start, min(n, start + SEGMENT), text[lo:hi]


def anchors(text: str, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash of the block, hash of the span from there, whether it fits, hash of the span that ends with the
    block, or the position where that does not fit) of each anchor."""
    block = span // 2
    width = span - block + 1
    found = []
    for offset, first, last, part in _segments(text, 3 * span):
        if len(part) < span:
            continue
        sums = _sums(part)
        h = _windows(sums, block)
        low = _sliding(h, width, np.minimum)
        rim = np.zeros(width - 1, np.uint64)
        chosen = np.flatnonzero(_sliding(np.concatenate([rim, low, rim]), width, np.maximum)[: len(h)] == h)
        chosen = chosen[(chosen + offset >= first) & (chosen + offset < last)]
        fits = chosen + span <= len(part)
        right = np.zeros(len(chosen), np.uint64)
        right[fits] = _windows(sums, span, chosen[fits])
        start = chosen + block - span
        left = (chosen + offset).astype(np.uint64)
        left[start >= 0] = _windows(sums, span, start[start >= 0])
        found.append((chosen + offset, h[chosen], right, fits, left))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def spans_around(text: str, positions: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every span of the text that holds the block at one of the positions."""
    block = span // 2
    starts, hashes = [], []
    for offset, first, last, part in _segments(text, 3 * span):
        own = positions[(positions >= first) & (positions < last)] - offset
        if len(own):
            at = np.unique((own[:, None] - np.arange(span - block + 1)[None, :]).ravel())
            at = at[(at >= 0) & (at + span <= len(part))]
            starts.append(at + offset)
            hashes.append(_windows(_sums(part), span, at))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def _anchor_table(docs: DataFrame, span: int, all_positions: bool) -> DataFrame:
    """(doc, fp, spanned, pos, first) of the anchors; without all positions only one of those with
    equal text on both sides, as far as a span that holds the block can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    pos, block, right, fits, left = anchors(text, span)
                    if not all_positions and len(pos):
                        keep = np.unique(np.stack([block, np.where(fits, right, pos.astype(np.uint64)), left]), axis=1, return_index=True)[1]
                        pos, block, right, fits = pos[keep], block[keep], right[keep], fits[keep]
                    first = np.zeros(len(pos), bool)
                    first[np.unique(block, return_index=True)[1]] = True
                    rows.append((np.full(len(pos), doc, np.int64), block.view(np.int64), right.view(np.int64), fits, pos, first))
                if rows:
                    doc, block, right, fits, pos, first = (np.concatenate(x) for x in zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(block), pa.array(right, mask=~fits), pa.array(pos.astype(np.int32)), pa.array(first)], names=["doc", "fp", "spanned", "pos", "first"])

    return spread(docs).mapInArrow(run, "doc bigint, fp bigint, spanned bigint, pos int, first boolean")


def _in_two(rows: DataFrame, key: str) -> DataFrame:
    """The values of `key` that rows of two different documents hold. A partial aggregate, so a value that very many
    documents hold is combined before the shuffle."""
    return rows.groupBy(key).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select(key)


class _Shared:
    """The shared anchors of a collection and what is known of them."""

    def __init__(self, documents: DataFrame, id_col: str, text_col: str, span: int, all_positions: bool):
        with_checkpoints(documents.sparkSession)
        self.span = span
        text = F.col(text_col).cast("string")
        self.docs = documents.select(F.col(id_col).cast("bigint").alias("doc"), text.alias("text")).where((F.length("text") >= span) & F.col("doc").isNotNull())
        # Written once, by columns, as both what is counted and what is kept need it.
        table = written(_anchor_table(self.docs, span, all_positions))
        twice = table.where("first").groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
        columns = ["doc", "fp", "spanned", "pos"]
        self.rows = table.select(columns).join(twice, "fp").checkpoint()
        keys = _in_two(self.rows.where("spanned IS NOT NULL"), "spanned")
        self.judged = self.rows.join(keys.withColumn("sure", F.lit(True)), "spanned", "left").withColumn("sure", F.coalesce("sure", F.lit(False)))

    def around(self, open_rows: DataFrame) -> DataFrame:
        """(doc, start, h) of the shared spans that hold an anchor equal to one of `open_rows`."""
        span = self.span
        wanted = self.rows.join(open_rows.select("fp").distinct(), "fp", "left_semi").groupBy("doc").agg(F.collect_set("pos").alias("positions")).checkpoint()
        # Where few documents are wanted, the others leave before the shuffle.
        docs = self.docs.join(F.broadcast(wanted.select("doc")), "doc", "left_semi") if wanted.count() <= BROADCAST_IDS else self.docs
        texts = docs.join(wanted, "doc").select("doc", "text", "positions")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for doc, text, positions in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    starts, hashes = spans_around(text, np.array(sorted(positions), np.int64), span)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), doc, np.int64)), pa.array(hashes.view(np.int64)), pa.array(starts.astype(np.int32))], names=["doc", "h", "start"])

        rows = texts.mapInArrow(run, "doc bigint, h bigint, start int").checkpoint()
        return rows.join(_in_two(rows, "h"), "h").select("doc", "start", "h")


def documents_with_shared_spans(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """(id_col): documents with a stretch of at least `span` characters that another document holds verbatim.

    Null, empty and shorter texts, and rows without an id, are no cases. Rows of the same id are one document. Other
    columns are not read. An empty table gives an empty result.
    """
    shared = _Shared(documents, id_col, text_col, span, all_positions=False)
    sure = shared.judged.where("sure").select("doc").distinct()
    rest = shared.judged.join(sure, "doc", "left_anti")
    more = shared.around(rest).select("doc")
    return sure.union(more).distinct().withColumnRenamed("doc", id_col)


def _shared_starts(shared: _Shared) -> DataFrame:
    """(doc, start, h): spans that another document holds; together they cover all that is shared."""
    judged = shared.judged.checkpoint()
    # An anchor is open if its own span is not shared, or the anchor before it is not shared so.
    order = Window.partitionBy("doc").orderBy("pos")
    marked = judged.withColumn("before", F.lag("sure").over(order)).withColumn("gap", F.col("pos") - F.lag("pos").over(order))
    open_rows = marked.where(~F.col("sure") | F.col("before").isNull() | ~F.col("before") | (F.col("gap") > shared.span))
    return judged.where("sure").select("doc", F.col("pos").alias("start"), F.col("spanned").alias("h")).union(shared.around(open_rows)).distinct()


def _islands(rows: DataFrame, keys: list[str], start: str, span: int) -> DataFrame:
    """(keys, first, last): runs of starts no more than a span apart."""
    step = Window.partitionBy(*keys).orderBy(start)
    edges = rows.withColumn("new", F.coalesce(F.col(start) > F.lag(start).over(step) + span, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(step))
    return edges.groupBy(*keys, "run").agg(F.min(start).alias("first"), F.max(start).alias("last")).drop("run")


def shared_share(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """(id_col, shared_chars, share): how many characters of each document stand in spans that other documents hold, and their share of its
    text. Documents without any, and null or short texts, have no rows. Rows of one id with different texts: as one document."""
    shared = _Shared(documents, id_col, text_col, span, all_positions=True)
    runs = _islands(_shared_starts(shared), ["doc"], "start", span)
    totals = runs.groupBy("doc").agg(F.sum(F.col("last") + span - F.col("first")).cast("bigint").alias("shared_chars"))
    sizes = shared.docs.groupBy("doc").agg(F.max(F.length("text")).alias("n"))
    return totals.join(sizes, "doc").select(F.col("doc").alias(id_col), "shared_chars", (F.col("shared_chars") / F.col("n")).alias("share"))


#: Characters compared at once at either end of a repeat; doubled for those that are still equal.
STEP = 512


def shared_spans(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """(id_col, span_start, span_end, partner_id, partner_start): maximal exact repeats of at least `span` characters, in code points, the end
    exclusive: the text of the partner from partner_start on is the same, and differs, or ends, before and behind.

    Each shared span is linked to one other document that holds it (the first or the last by id), not to all of them: a text that very many documents hold
    gives each of them one row, and copies are not expanded into pairs. Together the rows of a document cover all that it
    shares. Null and short texts have no rows. Rows of one id count as its greatest text.
    """
    unique = documents.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(text_col).cast("string")).alias("text")).checkpoint()
    shared = _Shared(unique, "doc_id", "text", span, all_positions=True)
    starts = _shared_starts(shared).checkpoint()
    here = F.struct("doc", "start")
    ends = starts.groupBy("h").agg(F.min(here).alias("lo"), F.max(here).alias("hi"))
    other = F.when(F.col("lo.doc") == F.col("doc"), F.col("hi")).otherwise(F.col("lo"))
    linked = starts.join(ends, "h").select("doc", "start", other.alias("o")).select("doc", "start", F.col("o.doc").alias("partner"), (F.col("o.start") - F.col("start")).alias("ahead")).where("doc <> partner")
    runs = _islands(linked, ["doc", "partner", "ahead"], "start", span)
    now = runs.select("doc", "partner", "ahead", F.col("first").cast("int").alias("lo"), (F.col("last") + span).cast("int").alias("hi")).checkpoint()
    texts = shared.docs.select("doc", "text")
    done, step = None, STEP
    while True:
        moved = _extended(now, texts, step).checkpoint()
        settled = moved.where("NOT more").drop("more")
        done = settled if done is None else done.union(settled)
        now = moved.where("more").drop("more")
        if now.isEmpty():
            break
        step *= 2
    # Runs of one diagonal that grew into each other are one repeat.
    return done.distinct().select(F.col("doc").alias(id_col), F.col("lo").alias("span_start"), F.col("hi").alias("span_end"), F.col("partner").alias("partner_id"), (F.col("lo") + F.col("ahead")).alias("partner_start"))


def _extended(repeats: DataFrame, texts: DataFrame, step: int) -> DataFrame:
    """`repeats` (doc, partner, ahead, lo, hi) grown by at most `step` characters to both sides, and whether one of them may grow further."""
    keys = ["doc", "partner", "ahead", "lo", "hi"]
    asked = repeats.select(F.col("doc").alias("d"), F.lit(0).alias("who"), *[F.col(c).alias(f"r_{c}") for c in keys], F.col("lo").alias("a"), F.col("hi").alias("b")).union(
        repeats.select(F.col("partner").alias("d"), F.lit(1).alias("who"), *[F.col(c).alias(f"r_{c}") for c in keys], (F.col("lo") + F.col("ahead")).alias("a"), (F.col("hi") + F.col("ahead")).alias("b"))
    )
    # Only the characters before and behind a repeat travel, not the texts of its documents.
    before = F.reverse(F.expr(f"substring(text, greatest(1, a - {step} + 1), least(a, {step}))"))
    behind = F.expr(f"substring(text, b + 1, {step})")
    sides = texts.join(asked.withColumnRenamed("d", "doc"), "doc").select("who", *[f"r_{c}" for c in keys], before.alias("before"), behind.alias("behind"))
    own, its = sides.where("who = 0").drop("who"), sides.where("who = 1").drop("who").withColumnsRenamed({"before": "before2", "behind": "behind2"})
    both = own.join(its, [f"r_{c}" for c in keys]).withColumns({"left": _common("before", "before2"), "right": _common("behind", "behind2")})
    more = (F.col("left") == step) | (F.col("right") == step)
    return both.select(*[F.col(f"r_{c}").alias(c) for c in keys[:3]], (F.col("r_lo") - F.col("left")).cast("int").alias("lo"), (F.col("r_hi") + F.col("right")).cast("int").alias("hi"), more.alias("more"))


@F.pandas_udf(IntegerType())
def _common_length(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            n = next(k for k in range(n) if x[k] != y[k])
        out.append(n)
    return pd.Series(out)


def _common(a: str, b: str):
    """How many characters two texts have in common from their start."""
    return _common_length(F.col(a), F.col(b))
