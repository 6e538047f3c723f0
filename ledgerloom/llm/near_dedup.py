"""Near duplicates by a chosen-path set similarity join over word shingles.

Every distinct shingle set is embedded as `SIGNATURE` minwise tokens. A tree branches a document
along the tokens that a hash of the path so far selects, `FIRST_BRANCHES` at the root and 1 / t
(t: the threshold) below, both in expectation, so documents of similarity t stay together with a
probability that a further tree repeats independently. A node of at most `SMALL` documents is
compared exhaustively; a larger one is first linked through its centre, the
document most alike to the others. If all its documents are
then known to be connected it is done; if all but `SMALL` are, each of these few is compared to all
others in blocks; else its documents go down new trees, `STEPS` levels deeper each time, or, where
that would make more rows, the node is dealt to runs of about `RUN_DOCS` documents and every run is
compared with every run. At 1 / t branches a pair at the threshold is less and less likely to stay
together in one tree, so the number of trees grows with the depth (`repetitions`): such a pair is
left out with a probability below 1e-4 over the first level (`TREES` trees) and all later ones
together, and a pair above the threshold with less. Documents that enough other nodes have settled
(`still_open`) are left out of that. How often documents split follows from how much
they are alike, so a node of documents barely less alike than the threshold is compared whole: n
documents make n * n / `RUN_DOCS` rows then, and n * n comparisons of 128 bytes in the workers.

Comparisons in a node use 8-bit sketches of the tokens and only nominate pairs, at a similarity four
standard deviations below the threshold; every link is confirmed on the full sets. Pairs whose ends
are connected already are not nominated, so a group of near copies costs links in proportion to its
size, and no link between two components is lost: nominations are repeated for every pair of a
small node that the first links left apart. Where these would outnumber the node's documents, as in
a group that is just below the threshold, the full sets of the node are gathered instead and all its
pairs compared at once, as a product of its membership matrix.

Defined cases: a text without words (null and empty too) has an empty set and is linked to nothing;
a text of fewer words than a shingle is one shingle; equal sets are linked; rows that repeat an id
are rows of their own and share the id's components; a null id never is the smallest of a component
that holds another id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .bytesops import LOWER, mix, slices, span_hashes, words
from .common import arrow_map, checked_join, hot_split_join, materialise, scratch, text_hash, without
from .components import components

SIGNATURE = 128
#: The least for which a pair at the threshold meets in a first-level node with probability 0.9999:
#: a tree misses it with exp(-FIRST_BRANCHES * 0.8).
TREES = 6
FIRST_BRANCHES = 2.0
SMALL = 200
PROBES = 16
#: Levels that the documents of large nodes go down before their nodes are counted again.
STEPS = 3
#: Documents, and shingles but for a longer document, of a run: a large node is compared run with run.
RUN_DOCS, RUN_ITEMS = 1024, 250_000
#: For all depths below the first level together, what TREES leave of 1e-4; each depth has half of what is left.
MISS = 3e-5
#: A document of undecided nodes is done if its other nodes miss a partner at the threshold with less than this probability.
SETTLED = 1e-4
#: A small node with more nominated pairs a row than this is settled at once, on its full sets.
PAIRS_A_ROW = 1
#: The comparison of a node of more documents than this ends as soon as it has too many pairs.
BROKEN_OFF = 512
#: Shingles that a node settled at once may hold, 8 bytes each; the pairs of longer ones are joined.
NODE_ITEMS = 1_000_000
#: Items of a membership matrix that are multiplied at once.
COLUMNS = 2048
#: Rows that a worker looks at together.
ROWS = 512
_NO_ID = -(2**63)
_ODD = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PLACE = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of the word shingles of each text."""
    weights = mix(np.arange(101, 101 + width, dtype=np.uint64)) | np.uint64(1)
    for lo, hi, data, offsets in slices(column):
        data = LOWER[data]
        starts, ends, rows = words(data, offsets)
        hashes = span_hashes(data, starts, ends)
        bounds = np.searchsorted(rows, np.arange(hi - lo + 1)).tolist()
        if len(hashes) >= width:
            n = len(hashes) - width + 1
            windows = np.zeros(n, np.uint64)
            for k in range(width):
                windows += hashes[k : k + n] * weights[k]
            windows = mix(windows)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= width:
                yield np.unique(windows[a : b - width + 1])
            elif b > a:  # too short: all its words as one
                yield mix(np.array([(hashes[a:b] * weights[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minwise token at each of the SIGNATURE places, 32 bits of each."""
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 4096):
        np.minimum(least, np.multiply.outer(hashes[k : k + 4096], _ODD).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ROWS rows, so that a worker's arrays are small."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def fixed(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """A binary column of equal lengths as a matrix of `width` items a row."""
    out = np.frombuffer(b"".join(column.to_pylist()), dtype)
    return out.reshape(-1, width)


def chosen(tokens: np.ndarray, path: np.ndarray, branches: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) of every token that the hash of path and token selects."""
    drawn = mix(tokens ^ path[:, None])
    row, place = np.nonzero(drawn < np.uint64(int(branches / SIGNATURE * 2**64)))
    return row, mix(drawn[row, place] + np.uint64(1)).view(np.int64)


def _features(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            n, key, sig = [], [], []
            for s in shingle_sets(batch.column("text"), width):
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            cols = [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "n_shingles", "set_key", "sig"])

    rows = docs.select(F.col("doc_id").cast("long"), text_hash(F.col("text")).alias("text_hash"), F.col("text").cast("string"))
    return arrow_map(rows, run, "doc_id long, text_hash long, n_shingles long, set_key binary, sig binary")


def repetitions(threshold: float, depth: int, miss: float) -> int:
    """The least number of trees of which none keeps a pair at the threshold together, `depth` levels below the first, with probability `miss`.

    The pair agrees in a binomial number of places, and each of these tokens is selected on its own.
    """
    equal = np.arange(SIGNATURE + 1)
    weight = np.array([math.comb(SIGNATURE, k) * threshold**k * (1 - threshold) ** (SIGNATURE - k) for k in equal.tolist()])
    lost = np.zeros(len(equal))  # of a common node, that no path leads on from it to the depth
    for _ in range(depth):
        lost = (1 - (1 - lost) / (threshold * SIGNATURE)) ** equal
    tree = (1 - (1 - lost) * FIRST_BRANCHES / SIGNATURE) ** equal
    trees = 1
    while (weight * tree**trees).sum() > miss:
        trees += 1
    return trees


def rows_below(threshold: float, depth: int) -> float:
    """Rows that a document makes in nodes `depth` levels below the first, in all repetitions."""
    return repetitions(threshold, depth, MISS / 2) * FIRST_BRANCHES * threshold**-depth


def _nodes(column: str, dtype: str, trees: range, depth: int, threshold: float):
    """Nodes of the trees, `depth` levels below the first, from the tokens in `column`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            tokens = mix(fixed(part.column(column), dtype, SIGNATURE).astype(np.uint64) ^ _PLACE)
            for tree in trees:
                seed = np.full(len(tokens), 0x5851F42D4C957F2D * (tree + 1) & (2**64 - 1), np.uint64)
                row, node = chosen(tokens, seed, FIRST_BRANCHES)
                for _ in range(depth):
                    own, node = chosen(tokens[row], mix(node.view(np.uint64)), 1 / threshold)
                    row = row[own]
                yield pa.RecordBatch.from_arrays([pa.array(node), part.column("set_key").take(pa.array(row))], ["node", "set_key"])

    return run


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low = (fixed(batch.column("sig"), "<u4", SIGNATURE) & 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column("set_key"), batch.column("n_shingles"), pa.array([x.tobytes() for x in low], pa.binary())], ["set_key", "size", "sketch"])


def _ordered(a: list[bytes], b: list[bytes]) -> pa.RecordBatch:
    pairs = [(x, y) if x < y else (y, x) for x, y in zip(a, b, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])


def _to_centre(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (fixed(batch.column("sketch"), "u1", SIGNATURE) == fixed(batch.column("centre_sketch"), "u1", SIGNATURE)).sum(axis=1)
            near = pa.array(np.flatnonzero(same >= least))
            yield _ordered(batch.column("set_key").take(near).to_pylist(), batch.column("centre").take(near).to_pylist())

    return run


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the places in which their sketch agrees with the node's probes, added up."""
    for batch in parts(batches):
        probes = batch.column("probes")
        sizes = np.diff(probes.offsets.to_numpy())
        each = fixed(batch.column("sketch"), "u1", SIGNATURE)[np.repeat(np.arange(len(sizes)), sizes)]
        same = (each == fixed(probes.flatten(), "u1", SIGNATURE)).sum(axis=1)
        alike = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=same, minlength=len(sizes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "set_key", "sketch", "root")], pa.array(alike)], ["node", "set_key", "sketch", "root", "alike"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """(starts of the runs of one node, rows): runs are whole, a run that reaches a batch's end waits."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        node = batch.column("node").to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1])
        held = batch.slice(int(starts[-1]))
        if len(starts) > 1:
            yield starts, batch.slice(0, int(starts[-1]))
    if held is not None:
        yield np.array([0, held.num_rows]), held


def _forest(root: np.ndarray, first: np.ndarray, second: np.ndarray) -> list[int]:
    """The places of those pairs, in their order, that join roots which the earlier ones left apart."""
    up = {int(r): int(r) for r in root}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    kept = []
    for k in range(len(first)):
        x, y = top(int(root[first[k]])), top(int(root[second[k]]))
        if x != y:
            up[y] = x
            kept.append(k)
    return kept


def _nominate(least: int, percent: int, per_row: int | None, forest: bool = False):
    """Pairs (a, b) of a node's documents that look similar, could be by their sizes, and have different `root`s.

    Rows of side 0 and 1 are compared with the other side only, a node of one side within itself.
    With `forest` only a spanning forest of the roots is nominated. Else a node of more than
    `per_row` pairs a row yields (set_key, root, node, side) of all its rows instead, so that the
    rows made stay in proportion to those read; None: pairs in any case.
    """

    def pairs_of(own: np.ndarray, size: np.ndarray, root: np.ndarray, side: np.ndarray, most: int | None) -> tuple[list[np.ndarray], ...]:
        crossed = side.any() and not side.all()
        other = np.flatnonzero(side == 1) if crossed else None
        first, second, score, n = [], [], [], 0
        for k in np.flatnonzero(side == 0).tolist() if crossed else range(len(own) - 1):
            at = other if crossed else np.arange(k + 1, len(own))
            near = (root[at] != root[k]) & (100 * np.minimum(size[at], size[k]) >= percent * np.maximum(size[at], size[k]))
            at = at[near]
            if not len(at):
                continue
            same = np.count_nonzero(own[at] == own[k], axis=1)
            hit = at[same >= least]
            if len(hit):
                first.append(np.full(len(hit), k))
                second.append(hit)
                score.append(same[same >= least])
                n += len(hit)
                if most is not None and n > most and len(own) > BROKEN_OFF:
                    break
        return first, second, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, rows in _blocks(batches):
            sketch = fixed(rows.column("sketch"), "u1", SIGNATURE)
            size, side = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("size", "side"))
            keys, names = rows.column("set_key").to_pylist(), rows.column("root").to_pylist()
            nodes = rows.column("node").to_pylist()
            roots = np.unique(np.array(names, "S16"), return_inverse=True)[1]
            counts = np.diff(starts)
            one = starts[:-1][counts == 2]  # the bulk: two documents
            fits = 100 * np.minimum(size[one], size[one + 1]) >= percent * np.maximum(size[one], size[one + 1])
            near = one[fits & (roots[one] != roots[one + 1]) & ((sketch[one] == sketch[one + 1]).sum(axis=1) >= least)]
            left, right, marked = near.tolist(), (near + 1).tolist(), []
            for a, n in zip(starts[:-1][counts > 2].tolist(), counts[counts > 2].tolist(), strict=True):
                own, root = slice(a, a + n), roots[a : a + n]
                if (root == root[0]).all():
                    continue
                most = None if forest or per_row is None else per_row * n
                first, second, score = pairs_of(sketch[own], size[own], root, side[own], most)
                if not first:
                    continue
                first, second, score = (np.concatenate(x) for x in (first, second, score))
                if forest:
                    best = np.argsort(-score, kind="stable")
                    first, second = first[best], second[best]
                    kept = _forest(root, first, second)
                    first, second = first[kept], second[kept]
                elif most is not None and len(first) > most:
                    marked += range(a, a + n) if n > BROKEN_OFF else (np.union1d(first, second) + a).tolist()
                    continue
                left += (first + a).tolist()
                right += (second + a).tolist()
            pairs = _ordered([keys[k] for k in left], [keys[k] for k in right])
            yield pa.RecordBatch.from_arrays([*pairs.columns, pa.nulls(len(left), pa.int64()), pa.nulls(len(left), pa.int32())], ["a", "b", "node", "side"])
            if marked:
                columns = [pa.array([keys[k] for k in marked], pa.binary()), pa.array([names[k] for k in marked], pa.binary()), pa.array([nodes[k] for k in marked], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(side[marked], pa.int32())], ["a", "b", "node", "side"])

    return run


def shared_items(items: np.ndarray, offsets: np.ndarray, split: int = 0) -> np.ndarray:
    """The sizes of the intersections of all pairs of sets, set k being items[offsets[k] : offsets[k + 1]].

    With `split` of the sets before it with the others only.
    """
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    _, place, count = np.unique(items, return_inverse=True, return_counts=True)
    often = np.flatnonzero(count > 1)  # an item of one set is in no intersection
    column = np.full(len(count), -1)
    column[often] = np.arange(len(often))
    place = column[place]
    row, place = row[place >= 0], place[place >= 0]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((split or n, n - split), np.int32)
    for lo in range(0, len(often), COLUMNS):
        a, b = np.searchsorted(place, [lo, lo + COLUMNS])
        has = np.zeros((n, min(COLUMNS, len(often) - lo)), np.float32)
        has[row[a:b], place[a:b] - lo] = 1
        out += (has[: split or n] @ has[split:].T).astype(np.int32)
    return out


def _links_within(percent: int):
    """A spanning forest, over the roots, of the links of each node, from the full sets of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, rows in _blocks(batches):
            keys = rows.column("set_key").to_pylist()
            roots = np.unique(np.array(rows.column("root").to_pylist(), "S16"), return_inverse=True)[1]
            items, side = rows.column("items"), rows.column("side").to_numpy(zero_copy_only=False)
            values, bounds = items.values.to_numpy(zero_copy_only=False), items.offsets.to_numpy()
            left, right = [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                at, root, size = bounds[a : b + 1], roots[a:b], np.diff(bounds[a : b + 1]).astype(np.int64)
                split = int((side[a:b] == 0).sum()) % (b - a)  # sorted by side; one side: all with all
                shared = shared_items(values[at[0] : at[-1]], at - at[0], split).astype(np.int64)
                rows_of, others = slice(0, split or b - a), slice(split, b - a)
                alike = 100 * shared >= percent * (size[rows_of, None] + size[None, others] - shared)
                alike &= root[rows_of, None] != root[None, others]
                first, second = np.nonzero(alike if split else np.triu(alike, 1))
                second = second + split
                kept = _forest(root, first, second)
                left += (first[kept] + a).tolist()
                right += (second[kept] + a).tolist()
            yield _ordered([keys[k] for k in left], [keys[k] for k in right])

    return run


class _Join:
    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs, self.width, self.percent = docs, width, percent
        t = percent / 100
        self.least = int(SIGNATURE * (t - 4 * (t * (1 - t) / SIGNATURE) ** 0.5))
        self.rows = materialise(_features(docs, width), "near-features")
        known = self.rows.where("set_key IS NOT NULL")
        grouped = known.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_rows"), F.max("n_shingles").alias("n_shingles"), F.max("sig").alias("sig"))
        self.sets = materialise(grouped, "near-sets")
        self.sketches = materialise(arrow_map(self.sets.select("set_key", "n_shingles", "sig"), _sketches, "set_key binary, size long, sketch binary"), "near-sketches")

    def live(self, nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Rows of the nodes whose documents are not all connected, with the node's size, their roots and sketches."""
        nodes = self.nodes = materialise(self.labelled(nodes.distinct(), labels), "near-nodes")
        sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("_lo"), F.max("root").alias("_hi"))
        sizes = materialise(sizes.where("_lo < _hi").select("node", "n"), "near-sizes")
        rows = nodes.join(sizes.hint("merge"), "node")
        return materialise(rows.join(self.sketches.hint("merge"), "set_key"), "near-live")

    def centres(self, many: DataFrame) -> DataFrame:
        """The document of each large node that is on average most alike to PROBES of its others."""
        order = W.Window.partitionBy("node").orderBy(F.xxhash64("set_key"), "set_key")
        probes = many.select("node", "set_key", "sketch").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= PROBES)
        probes = materialise(probes.groupBy("node").agg(F.collect_list("sketch").alias("probes")), "near-probes")
        alike = checked_join(many, probes, ["node"], row_bytes=PROBES * SIGNATURE + 400).select("node", "set_key", "sketch", "root", "probes")
        alike = arrow_map(alike, _alike, "node long, set_key binary, sketch binary, root binary, alike long")
        best = alike.groupBy("node").agg(F.max(F.struct("alike", "set_key", "sketch", "root")).alias("_b"))
        share = F.col("_b.alike") / F.lit(float(PROBES * SIGNATURE))
        return best.select("node", share.alias("alike"), F.col("_b.set_key").alias("centre"), F.col("_b.sketch").alias("centre_sketch"), F.col("_b.root").alias("centre_root"))

    def items(self, keys: DataFrame) -> DataFrame:
        """set_key and items of the wanted keys (and perhaps some others), from the texts."""
        wanted = self.sets.select("set_key", "doc_id").join(keys.hint("merge"), "set_key", "left_semi")
        wanted = materialise(wanted.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("_id")).distinct(), "near-wanted")
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches):
                sets = list(shingle_sets(batch.column("text"), width))
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["set_key", "items"])

        texts = self.docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_id"), F.col("text").cast("string"))
        items = arrow_map(checked_join(texts, wanted, ["_id"], "left_semi").select("text"), run, "set_key binary, items array<long>")
        return materialise(items.dropDuplicates(["set_key"]), "near-items")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar on their full sets."""
        items = self.items(pairs.select(F.col("a").alias("set_key")).unionByName(pairs.select(F.col("b").alias("set_key"))).distinct())
        both = pairs.withColumnRenamed("a", "set_key").join(items.hint("merge"), "set_key")
        both = both.select(F.col("set_key").alias("a"), F.col("b").alias("set_key"), F.col("items").alias("of_a")).join(items.hint("merge"), "set_key")
        shared = F.size(F.array_intersect("of_a", "items")).cast("long")
        both = both.select("a", F.col("set_key").alias("b"), shared.alias("shared"), (F.size("of_a") + F.size("items")).cast("long").alias("total"))
        alike = F.lit(100) * F.col("shared") >= F.lit(self.percent) * (F.col("total") - F.col("shared"))
        return materialise(both.where(alike).select("a", "b"), "near-links")

    def labelled(self, rows: DataFrame, labels: DataFrame | None) -> DataFrame:
        """`rows` with the root of each set; a set without links is its own."""
        if labels is None:
            return rows.withColumn("root", F.col("set_key"))
        named = rows.join(labels.withColumnRenamed("key", "set_key").hint("merge"), "set_key", "left")
        return named.withColumn("root", F.coalesce("root", "set_key"))

    def merged(self, labels: DataFrame | None, links: DataFrame) -> DataFrame:
        """The labels after further links."""
        if labels is None:
            return components(links)
        for end in ("a", "b"):
            named = links.withColumnRenamed(end, "key").join(labels.hint("merge"), "key", "left")
            links = named.select(F.coalesce("root", "key").alias(end), *[c for c in links.columns if c != end])
        links = materialise(links.where("a <> b").distinct(), "near-joins")
        if links.isEmpty():
            return labels
        moved = materialise(components(links), "near-moved")
        old = checked_join(labels.withColumnRenamed("root", "was"), moved.select(F.col("key").alias("was"), "root"), ["was"], "left")
        old = old.select("key", F.coalesce("root", "was").alias("root"))
        fresh = moved.join(labels.select("key").hint("merge"), "key", "left_anti").select("key", "root")
        return materialise(old.unionByName(fresh), "near-labels")

    def still_open(self, rest: DataFrame) -> DataFrame:
        """Of the rows of undecided first-level nodes those of documents that their other nodes have not settled.

        Every node of a document holds a partner at the threshold t with probability t; given that
        a share h of its nodes is undecided, each of its m decided ones does with (t - h) / (1 - h)
        at least, even if all the undecided ones hold it. So the partner is in none of them with
        probability ((1 - t) / (1 - h)) ** m. Where that is below SETTLED, the document need not be
        compared again; a pair of which one end is settled is found in that end's nodes. Documents
        that have one phrase in common with thousands are settled, those of a template are not.
        """
        t = self.percent / 100
        held = materialise(rest.groupBy("set_key").agg(F.count(F.lit(1)).alias("u")), "near-held")
        met = checked_join(self.nodes.select("set_key"), held.select("set_key"), ["set_key"], "left_semi").groupBy("set_key").agg(F.count(F.lit(1)).alias("k"))
        share = (F.col("u") + 1) / (F.col("k") + 2)
        lost = F.when(share < t, F.pow((1 - t) / (1 - share), F.col("k") - F.col("u"))).otherwise(1.0)
        unsettled = materialise(held.join(met.hint("merge"), "set_key").where(lost > SETTLED).select("set_key"), "near-open")
        return materialise(checked_join(rest, unsettled, ["set_key"], "left_semi"), "near-rest")

    def goes_down(self, depth: int) -> Column:
        """Whether a node of `_runs` runs, whose documents agree with the centre in `alike` of the places, is split by new trees.

        They must go so deep that its nodes fit in a run; that makes a known number of rows a
        document, against `_runs` if the node is compared whole. Documents almost as alike as the
        threshold never get there: no hash tells them apart at less cost than looking.
        """
        t = self.percent / 100
        costs = F.array(*[F.lit(rows_below(t, d)) for d in range(depth + 1, depth + 31)])
        alike = F.least(F.greatest(F.col("alike"), F.lit(0.01)), F.lit(0.999))
        needed = F.ceil(F.log(F.col("_runs").cast("double")) / -F.log(alike)).cast("int")
        return F.col("_runs") > F.coalesce(F.get(costs, F.greatest(needed, F.lit(STEPS)) - 1), F.lit(float("inf")))

    def links(self) -> DataFrame:
        """All confirmed links that connect what is connected."""
        pair, found_as = "a binary, b binary", "a binary, b binary, node long, side int"
        node = "node long, set_key binary"
        own = ["set_key", "size", "sketch"]
        nodes = arrow_map(self.sets.select("set_key", "sig"), _nodes("sig", "<u4", range(TREES), 0, self.percent / 100), node)
        found, tried, labels, small = [], [], None, []
        depth, grown, miss = 0, TREES, MISS
        union = lambda frames: reduce(DataFrame.unionByName, frames)
        by_node = lambda rows: rows.repartition("node").sortWithinPartitions("node", "side")

        def confirm(pairs: DataFrame) -> None:
            nonlocal labels
            pairs = pairs.distinct()
            if tried:
                pairs = pairs.join(union(tried).hint("merge"), ["a", "b"], "left_anti")
            pairs = materialise(pairs, "near-pairs")
            tried.append(pairs)
            found.append(self.confirmed(pairs))
            labels = self.merged(labels, found[-1])

        while True:
            live = self.live(nodes, labels)
            few = live.where(F.col("n") <= SMALL).select("node", *own, "root", F.lit(0).alias("side"))
            small.append(few.drop("root"))
            many = live.where(F.col("n") > SMALL)
            centres = materialise(self.centres(many), "near-centres")
            pairs = arrow_map(by_node(few), _nominate(self.least, self.percent, None, forest=True), found_as).select("a", "b")
            if centres.isEmpty():
                confirm(pairs)
                break
            star = checked_join(many, centres, ["node"], row_bytes=400).where("set_key <> centre AND root <> centre_root")
            star = arrow_map(star.select("set_key", "sketch", "centre", "centre_sketch"), _to_centre(self.least), pair)
            confirm(pairs.unionByName(star))
            named = materialise(self.labelled(many.select("node", "n", *own), labels), "near-large")
            parts = named.groupBy("node", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("w")).groupBy("node")
            parts = parts.agg(F.max(F.struct("c", "root")).alias("_m"), F.sum("c").alias("_n"), F.sum("w").alias("weight"))
            parts = parts.select("node", F.col("_m.root").alias("most"), (F.col("_n") - F.col("_m.c")).alias("others"), "weight").where("others > 0")
            parts = materialise(parts.join(centres.select("node", "alike").hint("merge"), "node"), "near-parts")
            rows = materialise(checked_join(named, parts, ["node"], row_bytes=120), "near-mixed")
            # a few beside one component: each of the few meets all, in blocks
            blocks = F.ceil(F.col("n") / SMALL).cast("int")
            near = rows.where(F.col("others") <= SMALL)
            block = F.when(F.col("root") == F.col("most"), F.array(F.pmod(F.xxhash64("set_key"), blocks).cast("int"))).otherwise(F.sequence(F.lit(0), blocks - 1))
            near = near.withColumn("_b", F.explode(block)).select(F.xxhash64("node", "_b").alias("node"), *own, F.lit(0).alias("side"))
            small.append(near)
            # the others: run with run, unless going down makes fewer rows
            rest = rows.where(F.col("others") > SMALL).select("node", *own, "alike")
            if not depth:
                rest = self.still_open(rest)
            sizes = materialise(rest.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight")).where("n > 1"), "near-sizes")
            runs = F.greatest(F.ceil(F.col("n") / RUN_DOCS), F.ceil(F.col("weight") / RUN_ITEMS)).cast("int")
            rest = checked_join(rest, sizes, ["node"]).withColumn("_runs", runs)
            whole = rest.where(~self.goes_down(depth)).withColumn("_i", F.pmod(F.xxhash64("set_key"), F.col("_runs")).cast("int"))
            whole = whole.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_runs") - 1)))
            small.append(whole.select(F.xxhash64("node", F.least("_i", "_j"), F.greatest("_i", "_j"), F.lit("runs")).alias("node"), *own, (F.col("_i") > F.col("_j")).cast("int").alias("side")))
            deep = materialise(rest.where(self.goes_down(depth)).select("set_key", "sketch").dropDuplicates(["set_key"]), "near-deep")
            if deep.isEmpty():
                break
            depth, miss = depth + STEPS, miss / 2
            trees = range(grown, grown + repetitions(self.percent / 100, depth, miss))
            grown = trees.stop
            nodes = arrow_map(deep, _nodes("sketch", "u1", trees, depth, self.percent / 100), node)
        apart = materialise(self.labelled(union(small), labels), "near-apart")
        nominated = materialise(arrow_map(by_node(apart), _nominate(self.least, self.percent, PAIRS_A_ROW), found_as), "near-nominated")
        pairs = nominated.where("node IS NULL").select("a", "b")
        dense = nominated.where("node IS NOT NULL").select(F.col("a").alias("set_key"), F.col("b").alias("root"), "node", "side")
        weights = dense.join(self.sets.select("set_key", "n_shingles").hint("merge"), "set_key").groupBy("node").agg(F.sum("n_shingles").alias("_w"))
        heavy = materialise(weights.where(F.col("_w") > NODE_ITEMS).select("node"), "near-heavy")
        if not heavy.isEmpty():  # too long to be held at once: few documents, or many of very unlike sizes
            held = checked_join(apart, heavy, ["node"], "left_semi").select("node", *own, "root", "side")
            held = arrow_map(by_node(held), _nominate(self.least, self.percent, None), found_as)
            pairs = pairs.unionByName(held.select("a", "b"))
            dense = checked_join(dense, heavy, ["node"], "left_anti")
        confirm(pairs)
        dense = materialise(self.labelled(dense.select("set_key", "node", "side"), labels), "near-dense")
        if not dense.isEmpty():
            sets = self.items(dense.select("set_key").distinct())
            whole = dense.join(sets.hint("merge"), "set_key").select("node", "set_key", "root", "side", "items")
            links = arrow_map(by_node(whole), _links_within(self.percent), pair)
            found.append(materialise(links.distinct(), "near-links"))
            labels = self.merged(labels, found[-1])
        self.labels = labels
        return union(found)


def _classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and class (null: no words) of every row, as a written table."""
    with scratch(docs.sparkSession) as keep:
        join = _Join(docs, width, percent)
        join.links()
        named = materialise(join.labelled(join.sets.select("set_key", "doc_id", "n_rows"), join.labels), "near-named")
        least = materialise(named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n_sets")), "near-least")
        sets = hot_split_join(named.select("set_key", "root", "n_rows"), least, "root", "n_sets")
        sets = materialise(sets.select("set_key", "component_id", F.col("root").alias("class"), "n_rows"), "near-classes")
        rows = join.rows.select("doc_id", "text_hash", "n_shingles", "set_key")
        shape = ["doc_id", "text_hash", "n_shingles", "component_id", "class"]
        linked = hot_split_join(rows.where("set_key IS NOT NULL"), sets, "set_key", "n_rows").select(*shape)
        alone = rows.where("set_key IS NULL").withColumn("component_id", F.col("doc_id")).withColumn("class", F.lit(None).cast("binary"))
        return keep(linked.unionByName(alone.select(*shape)), "near-result")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest connected id) and kept of every row."""
    return _classes(docs, width, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class of near duplicates, of the smallest id, with its columns; rows without words all stay.

    A row is decided by its own text: of several texts under the class's smallest id that of the
    least hash stays, of rows that repeat id and text any one.
    """
    rows = _classes(docs, width, percent).where("class IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = rows.groupBy("class").agg(F.min(order).alias("_f"), F.count(F.lit(1)).alias("n"))
    first = materialise(first.select("class", F.col("_f.doc_id").alias("first_id"), F.col("_f.text_hash").alias("first_hash"), "n"), "near-first")
    marked = hot_split_join(rows.select("class", "doc_id", "text_hash"), first, "class", "n")
    stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    gone = materialise(marked.where(~stays).select("doc_id", "text_hash").distinct(), "near-gone")
    again = marked.where(stays).groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "text_hash")
    return without(docs, gone, materialise(again, "near-again"))
