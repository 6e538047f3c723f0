"""Benchmark decontamination by pigeonhole edit matching over words.

Words are runs of letters, digits and non-ASCII characters in lower case; ASCII punctuation and
white space only separate them. A test item of m words may appear with up to k = floor(rate * m)
words changed, added or left out. It is split into k + 1 pieces: k edits leave one piece whole, so
every match has an exact piece hit. Hits are found by rolling hashes over all words of all texts;
around each hit Myers' bit-parallel algorithm gives the least edit distance, over any stretch of
the text, of the whole item.

The items are a query set: they are read on the driver in blocks of bounded size, and each block is
broadcast and matched against all rows where these are read, without a shuffle.

Defined cases: a null or empty text, and a text or an item without words, match nothing; an item
whose budget is 0 matches exactly; repeated items and repeated rows each give their own matches,
equal result rows once; a null id is kept as it is; either table empty gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import doc_starts, mix, slices, span_hashes
from .common import arrow_map, materialise, text_hash, without

_APART = np.ones(256, bool)
_APART[[c for c in range(128) if chr(c).isalnum()]] = False
_APART[128:] = False


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased bytes, and the place of each row's first word (and the end)."""
    inside = ~_APART[data]
    first = doc_starts(len(data), offsets)
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1] | first[1:-1]
    tail[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(head)
    return span_hashes(data, starts, np.flatnonzero(tail) + 1), np.searchsorted(starts, offsets)


def least_distance(item: list[int], text: list[int]) -> tuple[int, int]:
    """Myers: the least edit distance of `item` to any stretch of `text`, and where the first such ends."""
    m = len(item)
    places: dict[int, int] = {}
    for k, word in enumerate(item):
        places[word] = places.get(word, 0) | 1 << k
    top, ones = 1 << (m - 1), (1 << m) - 1
    plus, minus, score, best, end = ones, 0, m, m, 0
    for k, word in enumerate(text):
        eq = places.get(word, 0)
        across = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(across | plus) & ones, plus & across
        score += bool(up & top) - bool(down & top)
        if score < best:
            best, end = score, k + 1
        up, down = up << 1 & ones, down << 1 & ones
        own = eq | minus
        plus, minus = down | ~(own | up) & ones, up & own
    return best, end


class Items:
    """The pieces of a block of test items, by length."""

    def __init__(self, ids: list[int | None], texts: list[str], rate: float):
        column = pc.utf8_lower(pa.array(texts, pa.large_string()))
        self.ids: list[int | None] = []
        self.words: list[np.ndarray] = []
        for lo, _, data, offsets in slices(column):
            hashes, at = plain_words(data, offsets)
            for k in range(len(at) - 1):
                if at[k + 1] > at[k]:
                    self.ids.append(ids[lo + k])
                    self.words.append(hashes[at[k] : at[k + 1]])
        self.budget = [int(rate * len(w)) for w in self.words]
        pieces: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for n, (own, k) in enumerate(zip(self.words, self.budget, strict=True)):
            cuts = [j * len(own) // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = int(windows(own[a:b], b - a)[0])
                pieces.setdefault(b - a, {}).setdefault(key, []).append((n, a))
        self.pieces = pieces
        self.sorted = {length: np.sort(np.fromiter(by, np.uint64, len(by))) for length, by in pieces.items()}
        self.coarse = {}
        for length, keys in self.sorted.items():
            self.coarse[length] = np.zeros(1 << 18, bool)
            self.coarse[length][keys & np.uint64((1 << 18) - 1)] = True

    def matches(self, hashes: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, distance, first word, word after the last looked at) of the best match of each pair."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        seen = set()
        for length, keys in self.sorted.items():
            if len(hashes) < length:
                continue
            own = windows(hashes, length)
            near = np.flatnonzero(self.coarse[length][own & np.uint64((1 << 18) - 1)])
            where = np.minimum(np.searchsorted(keys, own[near]), len(keys) - 1)
            near = near[keys[where] == own[near]]
            rows = np.searchsorted(at, near, "right") - 1
            inside = near + length <= at[rows + 1]
            for p, row in zip(near[inside].tolist(), rows[inside].tolist(), strict=True):
                for item, offset in self.pieces[length][int(own[p])]:
                    m, k = len(self.words[item]), self.budget[item]
                    if (row, item, p - offset) in seen:
                        continue
                    seen.add((row, item, p - offset))
                    if found.get((row, item), (m,))[0] == 0:
                        continue
                    a, b = max(int(at[row]), p - offset - k), min(int(at[row + 1]), p - offset + m + k)
                    distance, end = least_distance(self.words[item].tolist(), hashes[a:b].tolist())
                    if distance <= k and (distance, a + end) < found.get((row, item), (m + 1, 0)):
                        found[row, item] = distance, a + end
        for (row, item), (distance, end) in found.items():
            yield row, item, distance, end - int(at[row]), len(self.words[item])


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` words."""
    weights = mix(np.arange(1001, 1001 + length, dtype=np.uint64)) | np.uint64(1)
    n = len(hashes) - length + 1
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out += hashes[k : k + n] * weights[k]
    return mix(out)


def _blocks(items: DataFrame, rate: float, block_bytes: int) -> Iterator[Items]:
    ids, texts, size = [], [], 0
    for row in items.toLocalIterator():  # one partition at a time
        ids.append(row[0])
        texts.append(row[1] or "")
        size += len(texts[-1])
        if size > block_bytes:
            yield Items(ids, texts, rate)
            ids, texts, size = [], [], 0
    if texts:
        yield Items(ids, texts, rate)


def leaks(docs: DataFrame, items: DataFrame, rate: float = 0.15, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, distance, budget, item_words and end_word (words of the text up to the match's end) of each match."""
    return _matches(docs, items, rate, block_bytes).drop("text_hash").distinct()


def _matches(docs: DataFrame, items: DataFrame, rate: float, block_bytes: int) -> DataFrame:
    schema = "doc_id long, text_hash long, item_id long, distance int, budget int, item_words int, end_word long"
    rows = docs.select(F.col("doc_id").cast("long"), text_hash(F.col("text")).alias("text_hash"), F.col("text").cast("string"))
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")), rate, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in batches:
                ids, hashes = batch.column("doc_id"), batch.column("text_hash")
                for lo, _, data, offsets in slices(pc.utf8_lower(batch.column("text").fill_null(""))):
                    got = list(block.matches(*plain_words(data, offsets)))
                    if got:
                        row, item, distance, end, n = zip(*got, strict=True)
                        at = pa.array([lo + r for r in row])
                        cols = [ids.take(at), hashes.take(at), pa.array([block.ids[i] for i in item], pa.int64()), pa.array(distance, pa.int32())]
                        cols += [pa.array([block.budget[i] for i in item], pa.int32()), pa.array(n, pa.int32()), pa.array(end, pa.int64())]
                        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "item_id", "distance", "budget", "item_words", "end_word"])

        out = out.unionByName(arrow_map(rows, run, schema))
    return out


def keep_clean(docs: DataFrame, items: DataFrame, rate: float = 0.15, least_words: int = 5) -> DataFrame:
    """The rows of `docs` that hold no test item of `least_words` words or more, with their columns.

    Shorter items are phrases of the language and would take clean documents away; `leaks` reports
    them. A row is decided by its own text, whatever else has its id.
    """
    found = _matches(docs, items, rate, 8 << 20).where(F.col("item_words") >= least_words)
    gone = materialise(found.select("doc_id", "text_hash").distinct(), "leaks")
    return without(docs, gone)
