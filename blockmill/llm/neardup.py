"""Problem 5: editions of the same content, grouped by a chosen-path similarity join.

Each text is the set of its sequences of three words. Equal sets are one class, taken once. Sets are laid on sampled
coordinates (minimum hashes); a tree of sampled coordinates splits the classes again and again into those that share
the sampled tokens. A node has on average 1 / threshold children, so a pair at the threshold shares one child of each
node it shares. Buckets of at most SMALL classes are compared with each other; larger ones are split further. The
tree is drawn anew in each run, and there are as many runs as the target recall of a pair at the threshold needs.
Candidates are verified on the whole sets.

A row of a bucket is 24 bytes: a key that names its node too, the class, and 64 bits of its signature, by which pairs that cannot be alike
are left out. The sets themselves are made a second time, of the texts of candidates alone.

A bucket that stays large over all levels holds near copies throughout: its members are linked to pivots, and
only the members that are like none are compared with all others, in tiles, so no links are lost and no task
holds the bucket.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockmill.llm.components import connected_components
from blockmill.sources.tables import spread, with_checkpoints, written

THRESHOLD, SHINGLE_WORDS, LEAST_WORDS = 0.6, 3, 20
TARGET_RECALL = 0.999
COORDINATES, SKETCH_BITS = 128, 64
SMALL, DEEPER = 64, 1
#: Bits of a key that name the node; the rest are a hash.
NODE_BITS = 16
#: A sketch holds one bit of each of SKETCH_BITS coordinates. It may understate the likeness by so many standard deviations.
SKETCH_DEVIATIONS = 4.0
#: Classes of a bucket that stays large to which the others are compared first, and rows of a tile.
PIVOTS, TILE = 16, 4096
#: At most so many ids are broadcast; more are joined.
BROADCAST_IDS = 200_000
_SPACE = re.compile("[ \t\n]+")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def words_of(text: str) -> list[str]:
    return [w for w in _SPACE.split(text.lower()) if w]


class Shingler:
    """Texts to sorted arrays of 64-bit hashes of their sequences of words."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def _hash(self, word: str) -> int:
        h = self.known.get(word)
        if h is None:
            if len(self.known) > 500_000:
                self.known.clear()
            h = self.known[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h

    def __call__(self, text: str, least: int) -> np.ndarray | None:
        words = words_of(text)
        if len(words) < max(least, self.size):
            return None
        codes = np.fromiter(map(self._hash, words), np.uint64, len(words))
        n = len(codes) - self.size + 1
        h = np.full(n, 0x51ED270B, np.uint64)
        for k in range(self.size):
            h = _mix(h + codes[k : k + n] * np.uint64(2 * k + 0x9E3779B97F4A7C15))
        return np.unique(h)


@lru_cache(maxsize=1)
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240611)
    return r.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1), r.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minimum hash at each coordinate, as 16 bits. The hashes are mixed already, so a multiplication orders them anew."""
    mult, add = _seeds()
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        h = hashes[at : at + 4096, None] * mult[None, :] + add[None, :]
        best = np.minimum(best, h.min(axis=0))
    return (_mix(best) >> np.uint64(48)).astype(np.uint16)


# ---- the tree of sampled coordinates ----


def survival(depth: int, threshold: float) -> float:
    """The chance that a pair at the threshold shares a bucket at this depth in one run."""
    two = min(1.0, 1 / threshold - 1)
    q = 1.0
    for _ in range(depth):
        p = threshold * q
        q = (1 - two) * p + two * (1 - (1 - p) ** 2)
    return q


def runs_needed(depth: int, threshold: float, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(depth, threshold))))


@lru_cache(maxsize=8)
def path_tree(runs: int, depth: int, threshold: float) -> tuple[list[list[tuple[int, int]]], list[list[int]]]:
    """(children of each node as (coordinate, child), nodes of each level). Level 0 holds one root for each run."""
    two = min(1.0, 1 / threshold - 1)
    rng = random.Random(f"{runs}/{threshold}")
    children: list[list[tuple[int, int]]] = [[] for _ in range(runs)]
    levels = [list(range(runs))]
    for _ in range(depth):
        level = []
        for node in levels[-1]:
            for c in rng.sample(range(COORDINATES), 2 if rng.random() < two else 1):
                children.append([])
                children[node].append((c, len(children) - 1))
                level.append(len(children) - 1)
        levels.append(level)
    return children, levels


def _keyed(hashes: np.ndarray, node: int) -> np.ndarray:
    return (hashes & ~np.uint64((1 << NODE_BITS) - 1)) | np.uint64(node)


def _step(keys: np.ndarray, child: int, values: np.ndarray) -> np.ndarray:
    salt = np.uint64(child * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
    return _keyed(_mix(keys * np.uint64(0x9E3779B97F4A7C15) + _mix(values.astype(np.uint64) + salt)), child)


def _sketches(sig: np.ndarray) -> np.ndarray:
    """The lowest bit of each of SKETCH_BITS coordinates."""
    return np.packbits((sig[:, :SKETCH_BITS] & 1).astype(np.uint8), axis=1).view(np.int64).ravel()


def _near(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which sketches may be those of sets at the threshold: bits of a shared coordinate agree, half of the others do by chance."""
    share = (1 + threshold) / 2
    least = SKETCH_BITS * share - SKETCH_DEVIATIONS * math.sqrt(SKETCH_BITS * share * (1 - share))
    return SKETCH_BITS - np.bitwise_count(np.atleast_1d(a ^ b).view(np.uint64)).astype(np.int64) >= least  # of a signed number it would count its absolute


def _buckets(frames: Iterator[pd.DataFrame], small: int, threshold: float) -> Iterator[pd.DataFrame]:
    """Rows (key, rep, sketch) in order of key: pairs of small buckets that may be alike as (rep, other); the rows of
    large buckets as they are. Holds at most a batch and the start of one bucket."""
    held: tuple[np.ndarray, ...] = tuple(np.zeros(0, np.int64) for _ in range(3))
    large_key = None

    def rows(key, rep, sketch, other=None) -> pd.DataFrame:
        n = len(rep)
        none = lambda: pd.array([pd.NA] * n, dtype="Int64")
        return pd.DataFrame({"key": none() if key is None else pd.array(key, dtype="Int64"), "rep": rep, "sketch": none() if sketch is None else pd.array(sketch, dtype="Int64"), "other": none() if other is None else pd.array(other, dtype="Int64")})

    def of(keys: np.ndarray, reps: np.ndarray, sketches: np.ndarray) -> Iterator[pd.DataFrame]:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        big = np.repeat(sizes > small, sizes)
        if big.any():
            yield rows(keys[big], reps[big], sketches[big])
        for size in np.unique(sizes[sizes <= small]):
            if size > 1:
                at = starts[sizes == size]
                a, b = np.triu_indices(size, 1)
                step = max(1, (1 << 18) // len(a))
                for k in range(0, len(at), step):
                    i, j = (at[k : k + step, None] + a[None, :]).ravel(), (at[k : k + step, None] + b[None, :]).ravel()
                    keep = _near(sketches[i], sketches[j], threshold) & (reps[i] != reps[j])
                    if keep.any():
                        pairs = np.unique(np.stack([np.minimum(reps[i[keep]], reps[j[keep]]), np.maximum(reps[i[keep]], reps[j[keep]])]), axis=1)
                        yield rows(None, pairs[0], None, pairs[1])

    for frame in frames:
        keys, reps, sketches = (np.concatenate([h, frame[c].to_numpy(np.int64)]) for h, c in zip(held, ("key", "rep", "sketch")))
        if large_key is not None:
            n = int(np.searchsorted(keys != large_key, True))
            if n:
                yield rows(keys[:n], reps[:n], sketches[:n])
                keys, reps, sketches = keys[n:], reps[n:], sketches[n:]
        held = tuple(x[:0] for x in held)
        if not len(keys):
            continue
        large_key = None
        last = int(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[-1])
        if last:
            yield from of(keys[:last], reps[:last], sketches[:last])
        if len(keys) - last > small:  # it is large whatever follows
            large_key = keys[-1]
            yield rows(keys[last:], reps[last:], sketches[last:])
        else:
            held = (keys[last:], reps[last:], sketches[last:])
    if len(held[0]):
        yield from of(*held)


_BUCKET_SCHEMA = "key bigint, rep bigint, sketch bigint, other bigint"


def likeness(a: Column, b: Column) -> Column:
    """Whether two sorted sets are alike enough is left to the caller; this is shared / either."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def similar_groups(rows: DataFrame, *, id_col: str = "chunk_id", text_col: str = "text", threshold: float = THRESHOLD, shingle_words: int = SHINGLE_WORDS, least_words: int = LEAST_WORDS, recall: float = TARGET_RECALL, small: int = SMALL, deeper: int = DEEPER, depth: int | None = None) -> DataFrame:
    """(id_col, group_id): every row that takes part, with the least id of all rows joined to it by links.

    Two rows are linked if their sets of `shingle_words` consecutive words have at least `threshold` of their union in
    common. Rows with a null text or fewer than `least_words` words take no part and give no row; so do null ids.
    A row sent again counts once. A row like no other is a group of its own. Other columns are not read.
    """
    spark = with_checkpoints(rows.sparkSession)
    narrow = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")

    def shingle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Shingler(shingle_words)
        for frame in frames:
            for at in range(0, len(frame), 500):
                out = []
                for i, text in frame.iloc[at : at + 500].itertuples(index=False):
                    hashes = make(text, least_words)
                    if hashes is not None:
                        out.append((i, hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), signature(hashes).tobytes()))
                yield pd.DataFrame(out, columns=["id", "class", "sig"])

    signed = written(spread(narrow).mapInPandas(shingle, "id bigint, class binary, sig binary"))
    # Rows of one id and different texts, and copies, are combined before the shuffle.
    reps = signed.groupBy("class").agg(F.min("id").alias("rep"))
    members = signed.select("id", "class").distinct().join(reps, "class").select("id", "rep").checkpoint()
    least = members.groupBy("rep").agg(F.lit(1).alias("one")).select(F.col("rep").alias("id"))
    classes = written(signed.join(least, "id", "left_semi").groupBy("id").agg(F.max("sig").alias("sig")).withColumnRenamed("id", "rep"))

    n = classes.count()
    start = depth or max(1, round(math.log(max(1.0, n / small)) / math.log(50)))
    runs = runs_needed(start + deeper, threshold, recall)
    children, levels = path_tree(runs, start + deeper, threshold)
    if sum(map(len, levels)) >= 1 << NODE_BITS:
        raise ValueError("a tree of too many nodes for its keys")

    def signatures(frame: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(frame["sig"]), np.uint16).reshape(-1, COORDINATES)

    def lay_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sig = signatures(frame)
            sketch, rep = _sketches(sig), frame["rep"].to_numpy(np.int64)
            keys = {node: np.full(len(frame), node, np.uint64) for node in levels[0]}
            for level in range(start):
                keys = {child: _step(keys[node], child, sig[:, c]) for node in levels[level] for c, child in children[node]}
            for key in keys.values():
                yield pd.DataFrame({"key": key.view(np.int64), "rep": rep, "sketch": sketch})

    def descend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sig, keys = signatures(frame), frame["key"].to_numpy(np.int64).view(np.uint64)
            nodes = (keys & np.uint64((1 << NODE_BITS) - 1)).astype(np.int64)
            for node in np.unique(nodes):
                at = np.flatnonzero(nodes == node)
                part = frame.iloc[at]
                for c, child in children[node]:
                    yield pd.DataFrame({"key": _step(keys[at], child, sig[at, c]).view(np.int64), "rep": part["rep"].to_numpy(), "sketch": part["sketch"].to_numpy()})

    def sets_of(ids: DataFrame) -> DataFrame:
        """(rep, hashes) of the classes (rep) that are asked for, made of their texts."""
        ids = ids.distinct().checkpoint()
        few = ids.count() <= BROADCAST_IDS
        asked = narrow.join(F.broadcast(ids) if few else ids, narrow["id"] == ids["rep"], "left_semi")

        def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            make = Shingler(shingle_words)
            for frame in frames:
                for at in range(0, len(frame), 500):
                    out = [(i, h.view(np.int64), hashlib.blake2b(h.tobytes(), digest_size=16).digest()) for i, text in frame.iloc[at : at + 500].itertuples(index=False) if (h := make(text, least_words)) is not None]
                    yield pd.DataFrame(out, columns=["rep", "hashes", "class"])

        made = asked.mapInPandas(hashed, "rep bigint, hashes array<bigint>, class binary")
        return made.groupBy("rep").agg(F.max_by("hashes", "class").alias("hashes"))

    made = "key bigint, rep bigint, sketch bigint"
    frontier = classes.mapInPandas(lay_out, made)
    candidates: DataFrame | None = None
    linked: DataFrame | None = None
    for level in range(start, start + deeper + 1):
        split = written(frontier.repartition("key").sortWithinPartitions("key").mapInPandas(lambda f: _buckets(f, small, threshold), _BUCKET_SCHEMA))
        pairs = split.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b"))
        candidates = pairs if candidates is None else candidates.union(pairs)
        frontier = split.where("other IS NULL").select("key", "rep", "sketch")
        if frontier.isEmpty():
            break
        if level < start + deeper:
            frontier = frontier.join(classes, "rep").mapInPandas(descend, made)
        else:
            linked, more = _dense(frontier, sets_of, threshold, small)
            candidates = candidates.union(more)
    pairs = candidates.distinct().checkpoint()
    verified = _verified(pairs, sets_of(pairs.select(F.col("a").alias("rep")).union(pairs.select("b"))), threshold)
    return _grouped(members, verified.union(linked) if linked is not None else verified, id_col)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hb")), "b")
    return both.where(likeness(F.col("ha"), F.col("hb")) >= threshold).select("a", "b")


def _dense(frontier: DataFrame, sets_of, threshold: float, small: int) -> tuple[DataFrame, DataFrame]:
    """Links to the pivots of each bucket that stayed large, and candidates between what is like none of them and the rest. Two members like the
    same pivot are joined by it and need no comparison."""
    rows = frontier.dropDuplicates(["key", "rep"]).checkpoint()
    # The classes of least hash, found by partial aggregates: a pivot is the least of its share of the bucket.
    shares = rows.withColumn("share", F.pmod(F.xxhash64("rep", "key"), F.lit(PIVOTS)))
    pivots = shares.groupBy("key", "share").agg(F.min("rep").alias("pivot")).select("key", "pivot")
    sets = sets_of(rows.select("rep")).checkpoint()
    own = rows.join(sets, "rep")
    held = pivots.join(sets.select(F.col("rep").alias("pivot"), F.col("hashes").alias("hp")), "pivot")
    like = own.join(held, "key").where(likeness(F.col("hashes"), F.col("hp")) >= threshold).select("key", "rep", "pivot").checkpoint()
    linked = like.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
    apart = rows.join(like.select("key", "rep").distinct(), ["key", "rep"], "left_anti")
    counts = rows.groupBy("key").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    parts = apart.groupBy("key").agg(F.ceil(F.count("*") / small).alias("parts"))
    blocks = apart.join(parts, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts"))).groupBy("key", "block").agg(F.collect_list(F.struct("rep", "sketch")).alias("held"))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for rep, sketch, held in zip(frame["rep"], frame["sketch"], frame["held"]):
                others = np.fromiter((x["sketch"] for x in held), np.int64, len(held))
                out += [(min(rep, held[k]["rep"]), max(rep, held[k]["rep"])) for k in np.flatnonzero(_near(others, np.int64(sketch), threshold)) if held[k]["rep"] != rep]
            yield pd.DataFrame(out, columns=["a", "b"])

    # In tiles: some TILE rows of a bucket with all its blocks, so that a bucket of any size is many tasks.
    left = rows.join(counts, "key").withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")))
    right = blocks.join(counts, "key").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
    more = left.select("key", "tile", "rep", "sketch").join(right.select("key", "tile", "held"), ["key", "tile"]).select("rep", "sketch", "held").mapInPandas(compare, "a bigint, b bigint")
    return linked, more


def _grouped(members: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    parts = connected_components(links, "a", "b")
    joined = members.join(parts, members["rep"] == parts["node"], "left")
    return joined.select(F.col("id").alias(id_col), F.coalesce("component", "rep").alias("group_id"))


def pairs_within(groups: DataFrame, id_col: str = "chunk_id", tile: int = TILE) -> DataFrame:
    """Every pair of a group, the smaller id first. The result is quadratic in a group by its definition; groups of one
    row are left out before the join, and a group is joined in tiles of some `tile` rows a side, so that no task holds the pairs of a large one."""
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id", F.ceil(F.col("n") / tile).alias("tiles"))
    rows = groups.join(sizes, "group_id").withColumn("own", F.pmod(F.xxhash64(id_col), F.col("tiles")))
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1))
    a = rows.select("group_id", F.col(id_col).alias(f"{id_col}_a"), F.col("own").alias("i"), others.alias("j"))
    b = rows.select("group_id", F.col(id_col).alias(f"{id_col}_b"), F.col("own").alias("j"), others.alias("i"))
    return a.join(b, ["group_id", "i", "j"]).where(F.col(f"{id_col}_a") < F.col(f"{id_col}_b")).select(f"{id_col}_a", f"{id_col}_b")
