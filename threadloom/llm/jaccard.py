"""Operator 2, exact n-gram Jaccard join by count vectors in an R-tree.

1. Documents with one and the same shingle set become one node, so copies cost nothing later.
2. Shingles are hashed into groups. Sets with similarity t differ in few shingles, so that, with more
   groups than differences, one group is alike in both; the contents of the groups are the keys under
   which nodes meet (a bucket). Groups are as large as that allows, since large ones are seldom alike by
   chance. Shingles that more than 3 in 10,000 sets hold are no keys by themselves.
3. In each bucket the group counts are points of an R-tree, and summed coordinate minima bound the
   overlap of two boxes or points. Points that pass are plausible; buckets give spanning forests of
   plausible pairs, and their components hold every link.
4. In each such component the R-tree runs once more over the sets themselves and every surviving pair is
   verified exactly, but for pairs that are connected already. The forests of verified links give the
   components.

Nothing is capped. Buckets and components over the size of a tile are cut into blocks, dealt out in more
than one way, which connects groups of alike sets at a cost that grows in proportion; only what is then
still apart from the largest connected part is compared across all blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import batches, mark, marked, rows_marked, spent, spread_join, written
from threadloom.llm.graph import Forest, components
from threadloom.llm.shingles import PLACES, Shingler, mixed, set_key

#: A shingle is common from this share of the sets on; the list of such shingles is at most the mean set size over it.
COMMON = 0.0003
#: Points in a tile of a bucket; shingles in a tile of a component.
TILE_POINTS, TILE_SHINGLES = 4096, 100_000
LEAF, FAN = 32, 8
#: Sets that a Python worker remembers, so as not to describe copies again.
REMEMBERED = 200_000
#: Low bits of a key: its level, and a flag for groups of common shingles only.
_COMMON, _LOW = np.uint64(64), np.uint64(127)
_HALF = np.uint64(32)


class Threshold:
    """Similarity num / den in whole numbers."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def linked(self, overlap, na, nb):
        return (self.num + self.den) * overlap >= self.num * (na + nb)

    def differences(self, total: int) -> int:
        """Most differences of two linked sets with so many shingles together."""
        return total * (self.den - self.num) // (self.den + self.num)

    def largest_partner(self, n: int) -> int:
        return n * self.den // self.num

    def top(self, level: int) -> int:
        """The largest set of a level: levels are half powers of two."""
        return isqrt(1 << level)

    def level(self, n: int) -> int:
        level = max(0, 2 * (n.bit_length() - 1))
        while self.top(level) < n:
            level += 1
        return level

    def levels(self, n: int) -> list[int]:
        """Two sets meet at the level of the larger one. Levels are further apart than sizes of linked sets."""
        return sorted({self.level(m) for m in (n, self.largest_partner(n))})

    def groups(self, level: int) -> int:
        """Groups of a level: a sixteenth more than the differences that its sets may have, and one."""
        d = self.differences(2 * self.top(level))
        return d + d // 16 + 1

    def width(self, level: int) -> int:
        """Coordinates of the points of a level."""
        return max(32, -(-self.groups(level) // 4))


def _dealt(h: np.ndarray, groups: int) -> np.ndarray:
    """Group of each hash; hashes in order give groups in order."""
    return (((h >> _HALF) * np.uint64(groups)) >> _HALF).astype(np.int64)


def group_counts(h: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """The point of a set: shingles per group as bytes, and what exceeds a byte."""
    counts = np.bincount(_dealt(h, width), minlength=width)
    return np.minimum(counts, 255).astype(np.uint8), int(np.maximum(counts - 255, 0).sum())


def keys_of(h: np.ndarray, level: int, rare: np.ndarray, threshold: Threshold) -> np.ndarray:
    """Keys of a set at a level: hash of a group's contents; below it a bit for groups of common
    shingles only, and the level. The first d + 1 groups with a rare shingle are enough (groups that are
    alike are rare in both sets, and at most d differ before the first); a set with fewer such groups
    gives all of its groups."""
    n = len(h)
    group = _dealt(h, threshold.groups(level))
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    keys = mixed(np.add.reduceat(mixed(h ^ PLACES[37]), starts) + PLACES[36:37] * np.uint64(level + 1)) & ~_LOW | np.uint64(level)
    has_rare = np.add.reduceat(rare.astype(np.int64), starts) > 0
    keys |= np.where(has_rare, np.uint64(0), _COMMON)
    d = threshold.differences(n + min(threshold.largest_partner(n), threshold.top(level)))
    first = keys[has_rare]
    if len(first) > d:
        return first[: d + 1]
    if len(keys) <= d:  # all groups that are alike may be empty ones
        keys = np.append(keys, mixed(PLACES[35:36] * np.uint64(level + 1)) & ~_LOW | _COMMON | np.uint64(level))
    return keys


class CountTree:
    """R-tree over count vectors, loaded in bulk: by set size, then by the widest coordinate. A box keeps
    the largest counts and the smallest size of its points."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, over: np.ndarray) -> None:
        m = len(points)
        slab = max(LEAF, int(np.sqrt(m * LEAF)))
        axis = int(points.var(0).argmax())
        by_size = np.argsort(sizes, kind="stable")
        self.order = np.lexsort((points[by_size, axis], np.arange(m) // slab))
        self.order = by_size[self.order]
        self.levels = [(points[self.order], sizes[self.order], over[self.order])]
        fan = LEAF
        while len(self.levels[-1][0]) > 1:
            top, small, more = self.levels[-1]
            cut = np.arange(0, len(top), fan)
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(small, cut), np.maximum.reduceat(more, cut)))
            fan = FAN

    def pairs(self, threshold: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Batches of point pairs (i, j, bound) with i != j whose bound allows a link."""
        step = max(1, (8 << 20) // max(1, self.levels[0][0].shape[1]))
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            if len(i) > step:
                stack += [(level, i[k : k + step], j[k : k + step]) for k in range(0, len(i), step)]
                continue
            top, small, more = self.levels[level]
            bound = np.minimum(top[i], top[j]).sum(1, dtype=np.int64) + np.minimum(more[i], more[j])
            fit = threshold.linked(bound, small[i], small[j])
            i, j, bound = i[fit], j[fit], bound[fit]
            if not level:
                if len(i):
                    yield self.order[i], self.order[j], bound
                continue
            fan, below = LEAF if level == 1 else FAN, len(self.levels[level - 1][0])
            a, b = (np.repeat(x * fan, fan * fan) for x in (i, j))
            grid = np.arange(fan * fan)
            a += np.tile(grid // fan, len(i))
            b += np.tile(grid % fan, len(i))
            keep = (a < b if level == 1 else a <= b) & (b < below)
            stack.append((level - 1, a[keep], b[keep]))


def common_shape(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))


SETS = "kind int, doc_id long, n long, node long, level int, over long, counts binary"


def describe(docs: DataFrame, size: int, threshold: Threshold) -> DataFrame:
    """Kind 0: a document, its set's size and name. Kind 1: a set's point at a level. Kind 2: a shingle
    that many sets of a batch hold, in ``node``, with their number."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(size), set()
        for b in batches(it, 2000):
            rows: list[tuple] = []
            sets = []
            for doc_id, h in zip(b.column(0).to_pylist(), shingler.sets(b.column(1).to_pylist()), strict=True):
                node = set_key(h) if len(h) else 0
                rows.append((0, doc_id, len(h), node, None, None, None))
                if len(h) and node not in seen:
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    seen.add(node)
                    sets.append(h)
                    for level in threshold.levels(len(h)):
                        counts, over = group_counts(h, threshold.width(level))
                        rows.append((1, None, len(h), node, level, over, counts.tobytes()))
            if sets:
                found, times = np.unique(np.concatenate(sets), return_counts=True)
                often = times >= max(4, len(sets) // 2000)
                rows += [(2, None, k, x, None, None, None) for x, k in zip(found[often].view(np.int64).tolist(), times[often].tolist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["kind", "doc_id", "n", "node", "level", "over", "counts"])

    return docs.mapInArrow(run, SETS)


ENTRY = np.dtype([("key", "<u8"), ("node", "<i8")])


def entries(docs: DataFrame, size: int, threshold: Threshold, common: np.ndarray, buckets: int) -> DataFrame:
    """Keys with two nodes at least: (node, level, key, members). Keys of common shingles are spread by
    node and not tested; members is null there."""

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(size), set()
        for b in batches(it, 2000):
            keys, nodes = [], []
            for h in shingler.sets(b.column(1).to_pylist()):
                if not len(h) or (node := set_key(h)) in seen:
                    continue
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.add(node)
                rare = np.ones(len(h), bool) if not len(common) else common[np.minimum(np.searchsorted(common, h), len(common) - 1)] != h
                for level in threshold.levels(len(h)):
                    keys.append(keys_of(h, level, rare, threshold))
                    nodes.append(np.full(len(keys[-1]), node, np.int64))
            if not keys:
                continue
            out = np.empty(sum(map(len, keys)), ENTRY)
            out["key"], out["node"] = np.concatenate(keys), np.concatenate(nodes)
            spread = np.where(out["key"] & _COMMON, mixed(out["key"] ^ out["node"].view(np.uint64)), out["key"])
            bucket = ((spread >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            out, bucket = out[order], bucket[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array([x.tobytes() for x in np.split(out, cut[1:])], pa.binary())], ["bucket", "packed"])

    def gather(t: pa.Table) -> pa.Table:
        got = np.unique(np.frombuffer(b"".join(x.as_py() for x in t.column("packed")), ENTRY))
        cut = np.flatnonzero(np.concatenate([[True], got["key"][1:] != got["key"][:-1]]))
        members = np.diff(np.append(cut, len(got)))
        each = np.repeat(members, members)
        hot = got["key"] & _COMMON != 0
        got, each, hot = (x[(each > 1) | hot] for x in (got, each, hot))
        return pa.table({"node": got["node"], "level": (got["key"] & np.uint64(63)).astype(np.int32), "key": got["key"].view(np.int64), "members": pa.array(each, pa.int64(), mask=hot)})

    return docs.mapInArrow(split, "bucket int, packed binary").groupBy("bucket").applyInArrow(gather, "node long, level int, key long, members long")


def dealt(df: DataFrame, group: str, member: str, blocks: Column, parts: int, salt: int) -> DataFrame:
    """Adds ``tile``, a name of the block of its group that a row stands in, and ``part``. Another salt deals
    members in another way; groups of one block are one tile."""
    own = F.pmod(F.xxhash64(F.lit(salt), group, member), F.greatest(F.lit(1), blocks.cast("long")))
    return df.withColumn("tile", F.xxhash64(group, own)).withColumn("part", F.pmod("tile", F.lit(parts)))


def apart(df: DataFrame, group: str, member: str, blocks: Column, parts: int, labels: DataFrame) -> DataFrame:
    """What groups of several blocks still have to compare, by their labels (node, component): rows of a
    group's most frequent label stand in one block each, all others in every block. Groups of one label
    are done."""
    label = labels.select(F.col("node").alias(member), F.col("component").alias("_label"))
    rows = df.withColumn("_blocks", blocks.cast("long")).where("_blocks > 1").join(label, member, "left").withColumn("_label", F.coalesce("_label", member))
    rows = written(rows, "apart")
    counts = rows.groupBy(group, "_label").agg(F.count("*").alias("_n"))
    top = counts.groupBy(group).agg(F.max_by("_label", F.struct("_n", "_label")).alias("_top"), F.count("*").alias("_labels")).where("_labels > 1")
    rows = spread_join(rows, top, group)
    own = F.array(F.pmod(F.xxhash64(F.lit(7), group, member), F.col("_blocks")))
    rows = rows.withColumn("_block", F.explode(F.when(F.col("_label") == F.col("_top"), own).otherwise(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))))
    return rows.withColumn("tile", F.xxhash64(group, "_block")).withColumn("part", F.pmod("tile", F.lit(parts)))


def plausible(table: pa.Table, threshold: Threshold) -> pa.Table:
    """Forest of the pairs in a part's tiles whose counts allow a link."""
    node, tile, n, over, level = (table.column(c).to_numpy() for c in ("node", "tile", "n", "over", "level"))
    counts = table.column("counts").combine_chunks()
    if isinstance(counts, pa.ChunkedArray):
        counts = pa.concat_arrays(counts.chunks)
    offsets = np.frombuffer(counts.buffers()[1], np.int32)[counts.offset : counts.offset + len(counts) + 1]
    data = np.frombuffer(counts.buffers()[2], np.uint8) if counts.buffers()[2] else np.empty(0, np.uint8)
    names, ids = np.unique(node, return_inverse=True)
    forest = Forest(len(names))
    order = np.lexsort((node, tile))
    cut = np.flatnonzero(np.concatenate([[True], tile[order][1:] != tile[order][:-1]]))
    done = set()
    edges: list[tuple[int, int]] = []
    twos: list[tuple[int, int, int]] = []
    for rows in np.split(order, cut[1:]):
        if len(rows) < 2:
            continue
        who = ids[rows]
        name = who.tobytes() + level[rows[:1]].tobytes()
        if name in done:
            continue
        done.add(name)
        if len(rows) == 2:
            twos.append((int(level[rows[0]]), *rows.tolist()))
            continue
        roots = {forest.root(x) for x in who.tolist()}
        if len(roots) == 1:
            continue
        width = threshold.width(int(level[rows[0]]))
        points = data[offsets[rows][:, None] + np.arange(width)]
        for i, j, _ in CountTree(points, n[rows], over[rows]).pairs(threshold):
            for x, y in set(zip(who[i].tolist(), who[j].tolist(), strict=True)):
                if forest.join(x, y):
                    edges.append((x, y))
    pairs = np.asarray(twos, np.int64).reshape(-1, 3)
    for at in np.unique(pairs[:, 0]):
        own, width = pairs[pairs[:, 0] == at], threshold.width(int(at))
        for k in range(0, len(own), step := max(1, (4 << 20) // width)):
            a, b = own[k : k + step, 1], own[k : k + step, 2]
            bound = np.minimum(data[offsets[a][:, None] + np.arange(width)], data[offsets[b][:, None] + np.arange(width)]).sum(1, dtype=np.int64) + np.minimum(over[a], over[b])
            fit = threshold.linked(bound, n[a], n[b])
            edges += [(x, y) for x, y in zip(ids[a[fit]].tolist(), ids[b[fit]].tolist(), strict=True) if forest.join(x, y)]
    found = names[np.asarray(edges, np.int64).reshape(-1, 2)]
    return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})


def linked_forest(sets: list[np.ndarray], threshold: Threshold) -> list[tuple[int, int]]:
    """Spanning forest of the links among sets, by an R-tree over group counts and exact verification."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    bits = int(np.clip(np.ceil(np.log2(max(1.0, float(np.median(sizes))))), 5, 10))
    points = np.zeros((len(sets), 1 << bits), np.uint16)
    over = np.zeros(len(sets), np.int64)
    for k, h in enumerate(sets):
        counts = np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        points[k], over[k] = np.minimum(counts, 65535), np.maximum(counts - 65535, 0).sum()
    forest, edges = Forest(len(sets)), []
    for i, j, bound in CountTree(points, sizes, over).pairs(threshold):
        order = np.lexsort((-bound, i))
        i, j = i[order], j[order]
        cut = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        for x, left in zip(i[cut].tolist(), np.split(j, cut[1:]), strict=True):
            while len(left):
                root = forest.root(x)
                roots = np.fromiter(map(forest.root, left.tolist()), np.int64, len(left))
                left, roots = left[roots != root], roots[roots != root]
                if not len(left):
                    break
                _, first = np.unique(roots, return_index=True)  # one of each component first, the likeliest
                now = left[first]
                h, others = sets[x], [sets[y] for y in now.tolist()]
                flat = np.concatenate(others)
                hit = h[np.minimum(np.searchsorted(h, flat), len(h) - 1)] == flat
                overlap = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(sizes[now])[:-1]]))
                for y in now[threshold.linked(overlap, len(h), sizes[now])].tolist():
                    if forest.join(x, y):
                        edges.append((x, y))
                left = np.delete(left, first)
    return edges


def verified(table: pa.Table, threshold: Threshold) -> pa.Table:
    """Forest of the links in a part's tiles."""
    node, tile = table.column("node").to_numpy(), table.column("tile").to_numpy()
    packed = table.column("packed")
    order = np.lexsort((node, tile))
    edges: list[tuple[int, int]] = []
    cut = np.flatnonzero(np.concatenate([[True], tile[order][1:] != tile[order][:-1]]))
    for rows in np.split(order, cut[1:]):
        _, first = np.unique(node[rows], return_index=True)
        rows = rows[first]
        if len(rows) > 1:
            sets = [np.frombuffer(packed[k].as_py(), np.uint64) for k in rows.tolist()]
            edges += [(int(node[rows[x]]), int(node[rows[y]])) for x, y in linked_forest(sets, threshold)]
    found = np.asarray(edges, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})


def sets_of(docs: DataFrame, size: int, marks: np.ndarray) -> DataFrame:
    """(doc_id, node, packed): the sets of documents whose id is marked. Marks may cover too much, never
    too little; the join with the candidates that follows is exact."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(size), set()
        for b in it:
            rows = rows_marked(b.column(2), marks)
            for k in range(0, len(rows), 500):
                own = b.take(pa.array(rows[k : k + 500]))
                sets = shingler.sets(own.column(1).to_pylist())
                nodes = [set_key(h) if len(h) else 0 for h in sets]
                out = pa.RecordBatch.from_arrays([own.column(0), pa.array(nodes, pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], ["doc_id", "node", "packed"])
                if own.column(0).null_count:  # all rows without an id are marked alike: each set once
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    out = out.filter(pa.array([known or not (x in seen or seen.add(x)) for x, known in zip(nodes, own.column(0).is_valid().to_pylist(), strict=True)], pa.bool_()))
                yield out

    return docs.select("doc_id", "text", mark(F.col("doc_id")).alias("bit")).mapInArrow(run, "doc_id long, node long, packed binary")


def compared(rows: DataFrame, group: str, blocks: Column, parts: int, with_data: Callable[[DataFrame], DataFrame], columns: list[str], compare: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Edges (a, b) that connect the members ``node`` of each group as far as ``compare`` links them.
    ``with_data`` joins to rows what is compared; a row has a node once per group."""

    def edges(tiles: DataFrame) -> DataFrame:
        return tiles.select("part", "tile", *columns).groupBy("part").applyInArrow(compare, "a long, b long")

    out = written(edges(with_data(dealt(rows, group, "node", blocks, parts, 1))), "edges")
    large = rows.where(blocks > 1)
    if large.isEmpty():
        return out
    again = written(edges(with_data(dealt(large, group, "node", blocks, parts, 2))), "edges")
    found = out.unionByName(again)
    rest = written(edges(with_data(apart(large, group, "node", blocks, parts, components(found)))), "edges")
    return found.unionByName(rest)


def join(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: components of the links of similarity >= num / den.

    A-Z are lower-cased, words are split at ASCII white space. Null or blank texts have no shingles and
    are components of their own; with fewer than ``size`` words the whole sequence is one shingle.
    Rows with equal texts are one component; so are repeated rows. Rows with a null id link others by
    their texts and get their component's least id, null where no row of it has one. An empty table gives no rows; other
    columns are ignored.
    """
    threshold, docs = Threshold(num, den), common_shape(docs)
    spark = docs.sparkSession
    made = written(describe(docs, size, threshold), "sets")
    own = made.where("kind = 0").select("doc_id", "n", "node")
    total = own.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles")).first()
    often = made.where("kind = 2").groupBy("node").agg(F.sum("n").alias("times")).where(F.col("times") >= max(16, COMMON * total["rows"]))
    common = np.sort(np.fromiter((r["node"] for r in often.select("node").collect()), np.int64).view(np.uint64))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total["shingles"] // 2_000_000)

    keyed = written(entries(docs, size, threshold, common, 2 * parts), "keys")
    points = made.where("kind = 1").dropDuplicates(["node", "level"]).select("node", "level", "n", "over", "counts")
    hot = keyed.where("members is null")
    members = hot.groupBy("key").agg(F.count("*").alias("found"))
    hot = written(spread_join(hot.drop("members"), members.where("found > 1"), "key").withColumnRenamed("found", "members"), "common-keys")
    pairs = keyed.where("members is not null").unionByName(hot)
    blocks = F.ceil(F.col("members") / TILE_POINTS)
    maybe = compared(pairs, "key", blocks, 2 * parts, lambda rows: rows.join(points.hint("merge"), ["node", "level"]), ["node", "level", "n", "over", "counts"], lambda t: plausible(t, threshold))
    groups = components(maybe)
    spent(keyed, hot, maybe)

    nodes = written(own.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "nodes")
    candidates = written(groups.join(nodes, "node").select("node", "doc_id", "n", F.col("component").alias("group")), "candidates")
    weights = candidates.groupBy("group").agg(F.ceil(F.sum("n") / TILE_SHINGLES).alias("blocks"))
    wanted = written(spread_join(candidates.select("doc_id", "node", "group"), weights, "group"), "wanted")

    def with_sets(rows: DataFrame) -> DataFrame:
        sets = sets_of(docs, size, marked(rows, "doc_id")).withColumnsRenamed({"doc_id": "_id", "node": "_node"})
        return sets.join(rows.hint("merge"), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_node") == F.col("node"))).drop("_id", "_node")

    links = compared(wanted, "group", F.col("blocks"), 2 * parts, with_sets, ["node", "packed"], lambda t: verified(t, threshold))
    labels = components(links)
    spent(links, candidates, wanted)

    named = written(labels.join(nodes.select("node", "doc_id"), "node"), "named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("least"))
    labelled = spread_join(named, least, "component").select("node", "least")
    classes = nodes.join(labelled, "node", "left").select("node", F.coalesce("least", "doc_id").alias("component_id"))
    empty = own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return spread_join(own.where("n > 0"), classes, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)
