"""Language-model scores of whole documents: a gated recurrent network with a class-factored output.

Tokens are lower-cased words and one end for each document; their counts come from all training
documents. The `HEAD` most frequent words are symbols of their own, in classes of `PLACES` words by
falling count; every other word is one of 2 * `SUFFIXES` symbols, which follow from its last two
bytes and whether punctuation ends it and are classes of their own. The network reads symbols, so
it knows which frequent word stood there, and the output softmax is factored:

    P(word | past) = P(class | state) * P(word | class, state)

The second factor of a frequent word is a softmax over its class's places, from a projection of the
state. That of any other word is (c + 0.5) / Z(class), where c is its count and Z sums c + 0.5 over
the class's words and one slot for unknown ones: of words seen a few times there is no more to
learn. The state is carried across windows from a document's first token to its end.

Training is truncated backpropagation in numpy. A network starts from a small sample of documents,
drawn by the hash of their text in a parallel scan and fitted in one task, for averaging copies
needs a common start; then every partition of all training documents trains a copy on every window
of its documents, and the copies are added up by tokens in a tree. What is counted and learnt grows
with the corpus; the sample only says where to begin.

Documents are dealt to lanes and read a window of all lanes at a time, so a task holds its batch's
symbols and one window, however long a text is.

The `HEAD_WORDS` most frequent words are broadcast with their counts; occurrences of rarer words,
whose number a word is bounded by their rarity, are joined with the count table.

Defined cases: a null or empty text is its end alone; a null id and repeated rows are scored like
others; a text of any length is one sequence; without training documents every count is 0 and the
classes are uniform; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import LOWER, mix, row_sums, slices, span_hashes, words
from .common import arrow_map, id_remainder, materialise, tree_sum

HEAD, PLACES, SUFFIXES = 1024, 32, 16
GROUPS = HEAD // PLACES
#: Symbols: 0 the end, then HEAD words, then the rest by ending; classes: 0 the end, then groups of words, then endings.
SYMBOLS = 1 + HEAD + 2 * SUFFIXES
CLASSES = 1 + GROUPS + 2 * SUFFIXES
HIDDEN, STATE = 16, 8
WINDOW = 16
LANES = 256
#: Tokens after which training begins anew in a long text; scores carry the state to its end.
STRETCH = 2048
#: Bytes of text that are scored together, but for a longer text.
SCORED_BYTES = 12 << 20
#: The words broadcast with their counts: 16 bytes each.
HEAD_WORDS = 1 << 18
#: Documents, in expectation, that the common start is fitted to.
WARM_DOCS = 1200
WARM_EPOCHS = 3
END = np.uint64(0)  # its hash; no word has it but by chance

_CLASS = np.concatenate([[0], 1 + np.arange(HEAD) // PLACES, 1 + GROUPS + np.arange(2 * SUFFIXES)])
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


class Batch:
    """Tokens of a column of texts: hash and ending of each word, and the row bounds."""

    def __init__(self, column: pa.Array):
        hashes, ending, n_words = [], [], []
        for lo, hi, data, offsets in slices(column):
            data = LOWER[data]
            starts, ends, rows = words(data, offsets)
            hashes.append(span_hashes(data, starts, ends))
            marked = _PUNCT[data[ends - 1]] & (ends - starts > 1) if len(starts) else np.zeros(0, bool)
            core = ends - marked
            pair = data[np.maximum(core - 2, starts)].astype(np.uint64) * np.uint64(256) + data[core - 1] if len(starts) else np.zeros(0, np.uint64)
            ending.append((2 * (mix(pair) % np.uint64(SUFFIXES)).astype(np.int64) + marked).astype(np.uint8))
            n_words.append(np.bincount(rows, minlength=hi - lo))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.hashes, self.ending = join(hashes, np.uint64), join(ending, np.uint8)
        self.n_words = join(n_words, np.int64)

    def symbols(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts, each with its end last, and their bounds; `own`: sorted hashes of the head's words, then their symbols."""
        word = self.ending.astype(np.uint16) + np.uint16(1 + HEAD)
        if own.shape[1] and len(word):
            at = np.minimum(np.searchsorted(own[0], self.hashes), own.shape[1] - 1)
            word = np.where(own[0][at] == self.hashes, own[1][at].astype(np.uint16), word)
        self.word = word
        bounds = np.concatenate([[0], np.cumsum(self.n_words + 1)])
        out = np.zeros(int(bounds[-1]), np.uint16)
        inside = np.ones(len(out), bool)
        inside[bounds[1:] - 1] = False
        out[inside] = word
        return out, bounds


def _joined(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about `size` bytes: with more texts beside each other fewer windows are nearly empty."""
    held, have = [], 0
    for batch in batches:
        held.append(batch)
        have += batch.nbytes
        if have >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if any(b.num_rows for b in held) else held[0]
            held, have = [], 0
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Lanes:
    """Texts dealt to lanes of near equal length, longest first, and read a window at a time."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray, most: int):
        sizes = np.diff(bounds)
        order = np.argsort(-sizes, kind="stable").tolist()
        heap = [(0, j) for j in range(min(most, len(sizes)))]
        lanes: list[list[int]] = [[] for _ in heap]
        for k in order:
            size, j = heapq.heappop(heap)
            lanes[j].append(k)
            heapq.heappush(heap, (size + int(sizes[k]), j))
        lanes.sort(key=lambda lane: -int(sizes[lane].sum()))
        self.order = np.array([k for lane in lanes for k in lane], np.int64)
        self.counts = np.array([len(lane) for lane in lanes])
        own = sizes[self.order]
        ends = np.cumsum(own)
        # all lanes one after the other
        place = np.arange(int(ends[-1]) if len(ends) else 0)
        self.flat = symbols[place + np.repeat(bounds[self.order] - (ends - own), own)] if len(place) else symbols
        lengths = np.array([int(sizes[lane].sum()) for lane in lanes], np.int64)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.doc_ends = ends
        self.first = np.zeros(len(place), bool)
        self.first[ends - own] = True

    def windows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(lanes that still run, inputs, targets, valid places, places in the flat symbols), all (time, lane)."""
        for t in range(0, int(self.lengths[0]) if len(self.lengths) else 0, WINDOW):
            n = int(np.searchsorted(-self.lengths, -t, "left"))
            at = self.starts[:n] + t + np.arange(min(WINDOW, int(self.lengths[0]) - t))[:, None]
            live = at < self.starts[:n] + self.lengths[:n]
            at = np.where(live, at, 0)
            y = self.flat[at].astype(np.int64)
            x = np.where(self.first[at], 0, self.flat[at - 1]).astype(np.int64)  # the end stands before a text's first token
            yield n, x, y, live, at


class Gru:
    """Symbol embedding, gates, softmax over classes and over the places of a class. All in float32."""

    def __init__(self, shares: np.ndarray, places: np.ndarray):
        draw = np.random.default_rng(7)
        s = 1 / HIDDEN**0.5
        p = {
            "x": draw.uniform(-s, s, (SYMBOLS, 3 * HIDDEN)),
            "h": draw.uniform(-s, s, (HIDDEN, 3 * HIDDEN)),
            "o": draw.uniform(-s, s, (HIDDEN, CLASSES)) * 0.1,
            "c": np.log(shares),
            "q": draw.uniform(-s, s, (HIDDEN, STATE)),
            "e": draw.uniform(-s, s, (GROUPS, PLACES, STATE)) * 0.1,
            "b": np.log(places),
        }
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.steps = 0

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> Gru:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def states(self, x: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """The state after each place of a window; a text's first token is read from the zero state."""
        out = np.empty((*x.shape, HIDDEN), np.float32)
        read = self.p["x"][x]
        for t in range(len(x)):
            before, first = h, np.flatnonzero(x[t] == 0)
            if len(first):
                before = h.copy()
                before[first] = 0
            a, u = read[t], before @ self.p["h"]
            gates = a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r, inner = gates[:, :HIDDEN], gates[:, HIDDEN:], u[:, 2 * HIDDEN :]
            n = r * inner
            n += a[:, 2 * HIDDEN :]
            np.tanh(n, out=n)
            h = out[t]
            np.subtract(before, n, out=h)
            h *= z
            h += n
            if keep is not None:
                keep.append((before, z, r, n, inner))
        return out

    def class_exps(self, h: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """exp of every class's logit, their sums, and the logit of each target's class."""
        logits = h @ self.p["o"]
        logits += self.p["c"]
        if np.abs(self.p["o"]).sum(axis=0).max() + np.abs(self.p["c"]).max() > 60:  # states are within 1: else nothing can overflow
            logits -= logits.max(axis=1, keepdims=True)
        target = logits[np.arange(len(y)), _CLASS[y]]
        np.exp(logits, out=logits)
        return logits, logits.sum(axis=1), target

    def place_exps(self, q: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same over the places of each head word's group, from the projected states."""
        group = own // PLACES
        logits = np.einsum("mjk,mk->mj", self.p["e"][group], q)
        logits += self.p["b"][group]
        logits -= logits.max(axis=1, keepdims=True)
        target = logits[np.arange(len(own)), own % PLACES]
        np.exp(logits, out=logits)
        return logits, logits.sum(axis=1), target

    def token_logs(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """log P(class) of each target, with log P(word | class) where the word is the head's."""
        _, total, out = self.class_exps(h, y)
        out -= np.log(total)
        head = np.flatnonzero((y > 0) & (y <= HEAD))
        if len(head):
            _, total, target = self.place_exps(h[head] @ self.p["q"], y[head] - 1)
            out[head] += target - np.log(total)
        return out

    def train_window(self, x: np.ndarray, y: np.ndarray, live: np.ndarray, h: np.ndarray, rate: float) -> tuple[np.ndarray, float]:
        """One truncated window, all (time, lane); the state after it and the loss."""
        kept: list = []
        states = self.states(x, h, kept)
        hs, at = states.reshape(-1, HIDDEN), y.ravel()
        weight = live.ravel().astype(np.float32)
        total = np.float32(max(float(weight.sum()), 1.0))
        d, sums, target = self.class_exps(hs, at)
        loss = float(((np.log(sums) - target) * weight).sum())
        weight /= total
        d *= (weight / sums)[:, None]
        d[np.arange(len(at)), _CLASS[at]] -= weight
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["o"], grad["c"] = hs.T @ d, d.sum(axis=0)
        back = d @ self.p["o"].T
        head = np.flatnonzero((at > 0) & (at <= HEAD) & (weight > 0))
        if len(head):
            head = head[np.argsort(at[head], kind="stable")]  # by group
            own = at[head] - 1
            group = own // PLACES
            q = hs[head] @ self.p["q"]
            dw, sums, target = self.place_exps(q, own)
            loss += float((np.log(sums) - target).sum())
            dw *= (1 / (total * sums))[:, None]
            dw[np.arange(len(head)), own % PLACES] -= 1 / total
            dq = np.einsum("mj,mjk->mk", dw, self.p["e"][group])
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            bounds = np.append(first, len(group))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                grad["e"][group[a]] = dw[a:b].T @ q[a:b]
                grad["b"][group[a]] = dw[a:b].sum(axis=0)
            grad["q"] = hs[head].T @ dq
            back[head] += dq @ self.p["q"].T
        back = back.reshape(states.shape)
        flow = np.zeros_like(h)
        das, dus = (np.empty((*x.shape, 3 * HIDDEN), np.float32) for _ in range(2))
        turn = self.p["h"].T.copy()
        for t in reversed(range(len(x))):
            before, z, r, n, u = kept[t]
            flow = flow + back[t]
            dn = flow * (1 - z)
            dn *= 1 - n * n
            da, du = das[t], dus[t]
            da[:, :HIDDEN] = flow * (before - n) * z * (1 - z)
            da[:, HIDDEN : 2 * HIDDEN] = dn * u * r * (1 - r)
            da[:, 2 * HIDDEN :] = dn
            du[:, : 2 * HIDDEN] = da[:, : 2 * HIDDEN]
            np.multiply(dn, r, out=du[:, 2 * HIDDEN :])
            flow = flow * z
            flow += du @ turn
            flow[x[t] == 0] = 0
        grad["h"] = np.concatenate([k[0] for k in kept]).T @ dus.reshape(-1, 3 * HIDDEN)
        das = das.reshape(-1, 3 * HIDDEN)
        order = np.argsort(x.ravel(), kind="stable")
        read = x.ravel()[order]
        first = np.flatnonzero(np.append(True, read[1:] != read[:-1]))
        grad["x"][read[first]] = np.add.reduceat(das[order], first)
        self.update(grad, rate)
        return states[-1], loss

    def update(self, grad: dict, rate: float) -> None:
        """Adam on gradients of bounded length."""
        self.steps += 1
        size = sum(float((g * g).sum()) for g in grad.values()) ** 0.5
        shrink = np.float32(min(1.0, 1.0 / max(size, 1e-9)))
        first, second = 1 - 0.9**self.steps, 1 - 0.99**self.steps
        for k, g in grad.items():
            m, v = self.moments[k]
            g *= shrink
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            g *= g
            v *= np.float32(0.99)
            v += np.float32(0.01) * g
            self.p[k] -= np.float32(rate / first) * m / (np.sqrt(v * np.float32(1 / second)) + np.float32(1e-6))

    def train(self, symbols: np.ndarray, bounds: np.ndarray, rate: float) -> tuple[float, int]:
        """One pass; the loss in nats and the tokens. Texts of more than STRETCH tokens are read in stretches beside each other."""
        loss, tokens = 0.0, 0
        cuts = [np.arange(a, b, STRETCH) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)] if len(bounds) > 1 and np.diff(bounds).max() > STRETCH else None
        lanes = Lanes(symbols, bounds if cuts is None else np.append(np.concatenate(cuts), bounds[-1]), LANES)
        h = np.zeros((len(lanes.lengths), HIDDEN), np.float32)
        for n, x, y, live, _ in lanes.windows():
            h, own = self.train_window(x, y, live, h[:n], rate)
            loss, tokens = loss + own, tokens + int(live.sum())
        return loss, tokens

    def log_probs(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The sum over each text of what `token_logs` gives, as log10."""
        lanes = Lanes(symbols, bounds, 4 * LANES)
        each = np.zeros(len(lanes.flat), np.float32)
        h = np.zeros((len(lanes.lengths), HIDDEN), np.float32)
        for n, x, y, live, at in lanes.windows():
            states = self.states(x, h[:n])
            h = states[-1]
            valid = live.ravel()
            each[at.ravel()[valid]] = self.token_logs(states.reshape(-1, HIDDEN), y.ravel())[valid]
        out = np.zeros(len(bounds) - 1)
        sums = np.concatenate([[0], np.cumsum(each, dtype=float)])
        out[lanes.order] = np.diff(sums[np.concatenate([[0], lanes.doc_ends]).astype(np.int64)])
        return out / np.log(10)


class Counts:
    """What the corpus's counts give to the model; built from aggregates of bounded size."""

    def __init__(self, vocab: DataFrame):
        total = vocab.agg(F.sum("c"), F.count(F.lit(1))).first()
        self.n_tokens, self.n_words = total[0] or 0, total[1]
        level = F.floor(F.log2("c") * 32)
        levels = vocab.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 64 * 32 rows
        least, n = 0, 0
        for row in sorted(levels, key=lambda r: -r["level"]):
            n += row["n"]
            if n > HEAD_WORDS:
                least = row["level"] + 1
                break
        frequent = vocab.where(level >= least).select("h", "c").toArrow()  # HEAD_WORDS rows at most
        hashes, times = (frequent.column(c).to_numpy().astype(np.int64) for c in ("h", "c"))
        order = np.argsort(hashes.view(np.uint64))
        self.known, self.known_counts = hashes.view(np.uint64)[order], times[order]
        own = vocab.where(F.col("s") >= 0).orderBy(F.desc("c"), "h").limit(HEAD).select("h", "s", "c").collect()
        sums = np.full(CLASSES, 0.5)
        self.end = 0
        for row in vocab.groupBy("s").agg(F.sum(F.col("c") + 0.5).alias("z"), F.sum("c").alias("c")).collect():
            if row["s"] < 0:
                self.end = row["c"]
            else:
                sums[1 + GROUPS + row["s"]] += row["z"]
        self.own_logs = np.zeros(SYMBOLS)  # log10 of c + 0.5 of the head's words
        self.own_counts = np.zeros(SYMBOLS, np.int64)
        places = np.full(HEAD, 0.5)
        for k, row in enumerate(own):
            sums[1 + GROUPS + row["s"]] -= row["c"] + 0.5
            places[k] = row["c"] + 0.5
            self.own_logs[1 + k] = np.log10(row["c"] + 0.5)
            self.own_counts[1 + k] = row["c"]
        self.places = (places.reshape(GROUPS, PLACES).T / places.reshape(GROUPS, PLACES).sum(axis=1)).T
        sums = np.maximum(sums, 0.5)
        self.own_logs[0] = np.log10(self.end + 0.5)
        self.own_logs[1 + HEAD :] = np.log10(sums[1 + GROUPS :])
        sums[0], sums[1 : 1 + GROUPS] = self.end + 0.5, places.reshape(GROUPS, PLACES).sum(axis=1)
        self.shares = sums / sums.sum()
        pairs = sorted((row["h"] & (2**64 - 1), 1 + k) for k, row in enumerate(own))
        self.own = np.array(pairs, np.uint64).reshape(-1, 2).T

    def network(self) -> Gru:
        return Gru(self.shares, self.places)


def count_words(docs: DataFrame) -> DataFrame:
    """(h, s, c): hash, ending and count of every distinct token; the end has hash 0 and ending -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Batch(batch.column("text"))
            h, first, c = np.unique(own.hashes, return_index=True, return_counts=True)
            h, s, c = np.append(h, END), np.append(own.ending[first].astype(np.int32), np.int32(-1)), np.append(c, len(own.n_words))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s), pa.array(c.astype(np.int64))], ["h", "s", "c"])

    counted = arrow_map(docs.select(F.col("text").cast("string")), run, "h long, s int, c long")
    return counted.groupBy("h", "s").agg(F.sum("c").alias("c")).where("c > 0")


def _fit(docs: DataFrame, counts: Counts, start: np.ndarray | None, rate: float, epochs: int) -> np.ndarray | None:
    """Train a copy in every partition; the copies' mean by tokens, None without a text."""
    sent = docs.sparkSession.sparkContext.broadcast((counts.shares, counts.places, counts.own, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shares, places, own, start = sent.value
        model, tokens = Gru(shares, places), 0
        if start is not None:
            model.load(start)
        for batch in batches:
            symbols, bounds = Batch(batch.column("text")).symbols(own)
            for k in range(epochs):
                tokens += model.train(symbols, bounds, rate / (1 + 2 * k))[1]
        sums = np.append(tokens, tokens * model.flat().astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["at", "sums"])

    total = tree_sum(arrow_map(docs.select(F.col("text").cast("string")), run, "at long, sums binary"))
    return None if total is None or not total[0] else total[1:] / total[0]


def train(docs: DataFrame, counts: Counts) -> np.ndarray:
    """The network's parameters, from a bounded sample and then from all of `docs`."""
    n = docs.count()
    # the sample: the documents whose text hash is lowest, about WARM_DOCS of them, found by all tasks
    share = min(1.0, WARM_DOCS / max(n, 1))
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("text"), F.lit(""))), 1, 8), 16, 10).cast("double") / 2**32
    sample = materialise(docs.where(draw < share).select("text"), "lm-sample").coalesce(1)
    model = _fit(sample, counts, None, 0.02, WARM_EPOCHS)
    if model is None:
        model = counts.network().flat()
    fitted = _fit(docs, counts, model, 0.002, 1)
    return model if fitted is None else fitted


def score_documents(docs: DataFrame, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Learns from rows whose id has another remainder than `held_out`; both scores are log10
    probabilities of the whole text.
    """
    training = docs.where(id_remainder(F.col("doc_id")) != held_out)
    vocab = materialise(count_words(training), "lm-counts")
    counts = Counts(vocab)
    return score_with(docs, vocab, counts, train(training, counts), held_out)


def score_with(docs: DataFrame, vocab: DataFrame, counts: Counts, model: np.ndarray, held_out: int) -> DataFrame:
    """The columns of `score_documents`, by the parameters `model` and the written count table `vocab`."""
    sent = docs.sparkSession.sparkContext.broadcast((model.astype(np.float32), counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        flat, counts = sent.value
        model = counts.network().load(flat)
        rid = TaskContext.get().partitionId() << 40
        for batch in _joined(batches, SCORED_BYTES):
            own = Batch(batch.column("text"))
            n = len(own.n_words)
            rows = np.repeat(np.arange(n), own.n_words)
            symbols, bounds = own.symbols(counts.own)
            c = counts.own_counts[own.word]  # 0 but for the head's words
            if len(counts.known):
                other = np.flatnonzero(own.word > HEAD)
                hashes = own.hashes[other]
                at = np.minimum(np.searchsorted(counts.known, hashes), len(counts.known) - 1)
                c[other] = np.where(counts.known[at] == hashes, counts.known_counts[at], 0)
            rare = c == 0
            rare_rows, rare_hashes = rows[rare], own.hashes[rare]
            order = np.lexsort((rare_hashes, rare_rows))
            rare_rows, rare_hashes = rare_rows[order], rare_hashes[order]
            new = np.ones(len(order), bool)
            new[1:] = (rare_rows[1:] != rare_rows[:-1]) | (rare_hashes[1:] != rare_hashes[:-1])
            times = np.diff(np.append(np.flatnonzero(new), len(new)))
            logs = np.where(rare, 0, np.log10(c + 0.5))
            # what the model gives beyond the counts, which the columns below add
            gain = model.log_probs(symbols, bounds) - np.diff(np.concatenate([[0], np.cumsum(counts.own_logs[symbols])])[bounds])
            head_log = np.zeros(n)
            np.add.at(head_log, rows, logs)
            at = np.concatenate([[0], np.cumsum(np.bincount(rare_rows[new], minlength=n))]).astype(np.int32)
            tail = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (rare_hashes[new].view(np.int64), times.astype(np.int32))]
            cols = [pa.array(np.arange(rid, rid + n)), batch.column("doc_id"), pa.array(own.n_words + 1), pa.array(row_sums(~rare, rows, n) + (counts.end > 0))]
            cols += [pa.array(head_log + np.log10(counts.end + 0.5)), pa.array(gain), *tail]
            rid += n
            yield pa.RecordBatch.from_arrays(cols, ["rid", "doc_id", "n_tokens", "head_known", "head_log", "gain", "tail", "times"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = arrow_map(rows, run, "rid long, doc_id long, n_tokens long, head_known long, head_log double, gain double, tail array<long>, times array<int>")
    scored = materialise(scored, "lm-scored")
    rare = scored.select("rid", F.explode(F.arrays_zip(F.col("tail").alias("h"), F.col("times").alias("m"))).alias("_t")).select("rid", "_t.h", "_t.m")
    found = rare.join(vocab.select("h", "c").hint("merge"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = found.groupBy("rid").agg(F.sum(F.col("m") * F.log10(F.col("c") + 0.5)).alias("tail_log"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("tail_known"))
    out = scored.drop("tail", "times").join(sums.hint("merge"), "rid", "left").na.fill(0, ["tail_log", "tail_known"])
    tokens = F.col("head_log") + F.col("tail_log")
    base = tokens - F.col("n_tokens") * F.log10(F.lit(counts.n_tokens + 0.5 * (counts.n_words + 1)))
    return out.select(
        "doc_id", (id_remainder(F.col("doc_id")) == held_out).alias("held_out"), "n_tokens",
        (F.col("head_known") + F.col("tail_known")).alias("n_known"), F.lit(counts.n_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (tokens + F.col("gain")).alias("score"),
    )
