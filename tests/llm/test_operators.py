"""Every operator on awkward rows, and against brute force on small ones."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import chat_format, decontaminate, exact_dedup, gru_lm, near_dedup, quality, sharding, sp_codec, token_counts, token_store
from ledgerloom.llm.queries import vocabulary
from ledgerloom.llm.wordbpe import WordBpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, rank int, keep_id long, set_key string, root int"
rng = random.Random(11)
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def word():
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def prose(n):
    return " ".join(word() for _ in range(n))


def table(spark, rows, schema=SCHEMA):
    wide = [(*r, *[None] * (len(schema.split(", ")) - len(r))) for r in rows]
    return spark.createDataFrame(wide, schema)


BASE = prose(120)
AWKWARD = [
    (0, BASE), (1, BASE), (2, BASE.replace(" ", "  \n")), (3, None), (4, ""), (5, "   "), (6, "a"), (7, "é 中 <|endoftext|> ▁x"), (8, BASE + " tail"), (8, BASE + " tail"),
    (None, "no id"), (None, None), (9, prose(9000)), (10, "x" * 70000), (11, prose(60).upper()), (12, "One two three"), (13, "one  TWO three"),
]
ROWS = [(i, t, "en", None if i == 6 else f"s{(i or 0) % 3}") for i, t in AWKWARD]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


def everything(spark, docs):
    labels, items = spark.createDataFrame([(0, 1, 0), (7, 0, None), (None, None, 1)], LABELS), spark.createDataFrame([(1, prose(20)), (2, None), (None, "")], ITEMS)
    yield sharding.proportional_shards(docs)
    yield token_counts.token_counts(docs, vocabulary("word_bpe_49k.json"))
    yield quality.score_quality(docs, labels)
    yield gru_lm.score_documents(docs)
    yield exact_dedup.exact_dedup(docs)
    yield near_dedup.near_duplicates(docs, 4)
    yield sp_codec.encode_decode(docs, vocabulary("piece_bpe_32k.model"))
    yield token_store.store_and_read(docs, vocabulary("word_bpe_49k.json"))
    yield decontaminate.leaks(docs, items)


def test_awkward_rows_are_all_there(spark, docs):
    for out in everything(spark, docs):
        ids = Counter(r.doc_id for r in out.select("doc_id").collect())
        assert "item_id" in out.columns or ids == Counter(r[0] for r in ROWS)


def test_empty_tables(spark, empty):
    assert all(out.count() == 0 for out in everything(spark, empty))


def test_shards(spark):
    rows = [(i, prose(3), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(997)] + [(5000, None, "en", None)]
    got = sharding.proportional_shards(table(spark, rows), 24).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == 998 and sizes.max() - sizes.min() <= 1 and len(sizes) == 24
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    for source, n in got.groupby("source").size().items():  # every shard holds the mixture
        each = got[got.source == source].groupby("shard").size().reindex(range(24), fill_value=0)
        assert each.max() <= math.ceil(n / 24) + 1 and each.min() >= n // 24 - 1
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    for doc_id, size, crc in zip(got["doc_id"], got["size"], got["text_crc32"], strict=True):
        assert size == len(texts[doc_id]) + 8 and crc == zlib.crc32(texts[doc_id])


def test_units_are_the_librarys():
    pieces = "aAbZ  \n\t.,!'’stdré9٣Éİſ à\u0085\x00—🙂中ǆΣς&<|>▁ﬁ½\r"
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + [None, "", "<|endoftext|> x", "<|ENDOFTEXT|>y", "a" * 5000 + " b"]
    column, bpe = pa.array(texts), WordBpe.load(vocabulary("word_bpe_49k.json"))
    want = [bpe.whole(t or "") for t in texts]
    for chunk, overlap in ((64, 8), (16, 2), (1 << 16, 8)):
        assert token_counts.count_column(column, bpe, chunk, overlap).tolist() == [len(w) for w in want]
    got = []
    for _, _, ids, counts in token_store.encode_rows(column, bpe, 1):
        ends = np.cumsum(counts)
        got += [ids[e - c : e].tolist() for c, e in zip(counts, ends)]
    assert got == [[*w, 1] for w in want]
    flat = np.concatenate([np.array(g) for g in got])
    code = token_store.Dac.encode(flat)
    assert (code.decode() == flat).all() and all(code[i] == flat[i] for i in range(0, len(flat), 500))
    at = np.random.default_rng(1).integers(0, len(flat), 9000)
    assert (code.take(at) == flat[at]).all()
    big = rng.sample(range(1 << 24), 999)
    code = token_store.Dac.encode(np.array(big))
    assert len(code.levels) == 3 and [code[i] for i in range(999)] == big
    words = sp_codec.MarkedWords.load(vocabulary("piece_bpe_32k.model"))
    for (ids, text), own in zip(words.rows(pa.array([(t or "").replace("▁", "") for t in texts])), texts, strict=True):
        ref = words.library.encode((own or "").replace("▁", ""), add_bos=True, add_eos=True)
        assert ids.tolist() == ref and text.decode() == words.library.decode(ref)


def test_overlaps_widen():
    """A stretch without white space that is longer than chunk and overlap, and special strings with `<|` on every side."""
    bpe = WordBpe.load(vocabulary("word_bpe_49k.json"))
    calls = []
    whole = bpe._chunk
    bpe._chunk = lambda text, start, size: calls.append(size) or whole(text, start, size)
    try:
        for text in ("a b " * 40 + "x" * 900 + " c d" * 60, ("<|endoftext|> one " * 50), "y" * 700, prose(3000)):
            calls.clear()
            assert np.concatenate(list(bpe.spliced(text, 100, 10))).tolist() == bpe.whole(text)
            assert "xxx" not in text or max(calls) > 900
    finally:
        del bpe._chunk


def stored_order(rows, bpe):
    """Per id, in ascending order (null first), the ids of its rows in any order."""
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append([*bpe.whole(r[1] or ""), 1])
    return out


def test_store_reads_back(spark, docs, monkeypatch):
    bpe = WordBpe.load(vocabulary("word_bpe_49k.json"))
    path = token_store.work_dir(spark, "store")
    token_store.write_store(docs, path, vocabulary("word_bpe_49k.json"), segment_tokens=200)
    got = sorted(token_store.read_store(spark, path).collect(), key=lambda r: r.start)
    want, flat = stored_order(ROWS, bpe), []
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i or 0))
    for r in got:
        ids = next(x for x in want[r.doc_id] if zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32 and len(x) == r.n_tokens)
        want[r.doc_id].remove(ids)
        assert r.start == len(flat)
        flat += ids
    assert not any(want.values())
    for start, n in ((0, 1), (0, 500), (199, 2), (len(flat) - 3, 50), (len(flat) + 5, 2), (777, 4000)):
        assert token_store.tokens(spark, path, start, n).tolist() == flat[start : start + n]
    assert token_store.directory(spark, path).count() > 3
    # a vocabulary of over 65536 ids
    monkeypatch.setattr(bpe, "dtype", np.uint32)
    assert sorted(tuple(r) for r in token_store.store_and_read(docs, vocabulary("word_bpe_49k.json")).collect() if r.doc_id == 9) == [tuple(r) for r in got if r.doc_id == 9]


def test_queries_of_tokens_are_the_librarys(spark, tmp_path):
    """op2, op8 and op10 as registered, against the libraries, on awkward rows."""
    from ledgerloom.llm import queries

    table(spark, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    bpe, pieces = WordBpe.load(vocabulary("word_bpe_49k.json")), sp_codec.MarkedWords.load(vocabulary("piece_bpe_32k.model")).library
    texts = [(i, t or "") for i, t, *_ in ROWS]
    counted = Counter((i, len(t.encode()), n := len(bpe.whole(t)), n > 2048) for i, t in texts)
    assert Counter(tuple(r) for r in queries.op2_token_counts(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == counted

    def digests(t):
        ids = pieces.encode(t, add_bos=True, add_eos=True)
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(pieces.decode(ids).encode()).hexdigest()

    got = queries.op8_sentencepiece(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *digests(t)) for i, t in texts)
    got = queries.op10_token_store(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_crc32").collect()
    assert Counter(tuple(r) for r in got) == Counter((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in texts for ids in [[*bpe.whole(t), 1]])


def test_exact_index_grows(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=3)
    first = {r.doc_id: r for r in exact_dedup.exact_dedup(table(spark, [(5, "a b"), (3, "a  b"), (4, "c")]), index).collect()}
    assert first[5].keep_id == 3 and first[5].group_size == 2 and not first[5].kept and first[3].kept
    later = {r.doc_id: r for r in exact_dedup.exact_dedup(table(spark, [(1, "a\tb"), (2, "new")]), index).collect()}
    assert later[1].keep_id == 3 and not later[1].kept and later[2].kept
    again = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=3)
    assert again.rows().count() == 3
    assert first[3].text_sha256 == hashlib.sha256(b"a b").hexdigest()


def test_index_reopened_with_other_settings(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    rows = table(spark, [(k, f"text {k}") for k in range(200)])
    index = exact_dedup.DigestIndex(spark, path, buckets=8)
    assert all(r.kept for r in exact_dedup.exact_dedup(rows, index).collect())
    index.close()  # as in a new session: the catalogue has no such table
    again = exact_dedup.DigestIndex(spark, path, buckets=4)
    later = table(spark, [(1000 + k, f"text  {k}") for k in range(200)] + [(5000, "unseen")])
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(later, again).collect()}
    assert again.buckets == 8 and [i for i, r in got.items() if r.kept] == [5000]
    assert all(got[1000 + k].keep_id == k for k in range(200)) and again.rows().count() == 201
    exact_dedup.exact_dedup(later, again).count()  # a repeated append
    assert again.rows().count() == 201
    again.close()
    (tmp_path / "other").mkdir()
    (tmp_path / "other/part.parquet").write_bytes(b"")
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, f"file://{tmp_path}/other")


def test_without_an_index_nothing_stays_in_the_catalogue(spark):
    before = len(spark.catalog.listTables())
    exact_dedup.exact_dedup(table(spark, [(1, "a")])).count()
    assert len(spark.catalog.listTables()) == before


def test_keep_first_leaves_one_of_repeated_rows(spark, docs):
    kept = exact_dedup.keep_first(docs).collect()
    texts = [re.sub(r"[ \t-\r]+", " ", r.text or "") for r in kept]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[ \t-\r]+", " ", r[1] or "") for r in ROWS})
    assert kept[0].__fields__ == docs.columns


def test_rows_are_decided_by_their_own_text(spark):
    """An id that stands for two texts, null ids, and columns named as the operators' own."""
    schema = "doc_id long, text string, _digest string, _DIGEST_ string, _id int, text_hash string"
    a, b = prose(40), prose(40)
    rows = [(1, a), (2, a), (2, b), (3, b), (None, a), (None, "alone"), (None, "alone"), (7, None), (8, "")]
    got = sorted(((r.doc_id or -1, r.text) for r in exact_dedup.keep_first(table(spark, rows, schema)).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (-1, "alone"), (7, None)], key=str)
    near = near_dedup.keep_one(table(spark, rows, schema)).collect()
    assert Counter((r.doc_id, r.text) for r in near) == Counter([(1, a), (2, b), (None, "alone"), (7, None), (8, "")])
    items = spark.createDataFrame([(1, a)], ITEMS)
    clean = decontaminate.keep_clean(table(spark, rows, schema), items).collect()
    assert Counter((r.doc_id, r.text) for r in clean) == Counter([(2, b), (3, b), (None, "alone"), (None, "alone"), (7, None), (8, "")])
    assert clean[0].__fields__ == ["doc_id", "text", "_digest", "_DIGEST_", "_id", "text_hash"]


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def classes(rows, width, percent=80):
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[top(i)].append(doc)
    return {doc: (len(sets[i]), min(least[top(i)])) for i, (doc, _) in enumerate(rows)}


def test_near_duplicates(spark):
    rows = []
    for _ in range(25):
        base = prose(rng.randint(30, 120)).split()
        for _ in range(rng.randint(1, 6)):
            own = [word() if rng.random() < 0.02 else w for w in base]
            rows.append((len(rows), " ".join(own)))
    shared = prose(60)
    rows += [(len(rows) + k, shared + " " + prose(40)) for k in range(20)] + [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, "c")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table(spark, rows), 4).collect()}
    assert got == classes(rows, 4)


def test_large_nodes(spark, monkeypatch):
    """With tiny nodes and runs the tree branches, links through centres and settles run with run."""
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "RUN_DOCS", 3)
    base = prose(150).split()
    rows = [(k, " ".join(word() if rng.random() < 0.01 else w for w in base)) for k in range(40)]
    rows += [(100 + k, " ".join(base[:100]) + " " + prose(45)) for k in range(15)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table(spark, rows), 4).collect()}
    assert got == classes(rows, 4)


@pytest.mark.parametrize("held", [2_000_000, 1000])
def test_groups_just_below_the_threshold(spark, monkeypatch, held):
    """Nodes of many similar pairs that are not linked: settled at once, or joined if they are too long."""
    monkeypatch.setattr(near_dedup, "NODE_ITEMS", held)
    base, rows = prose(120).split(), []
    for k in range(60):
        own = list(base)
        for at in rng.sample(range(len(base)), 2 + k % 3):
            own[at] = word()
        rows.append((k, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table(spark, rows), 4).collect()}
    assert got == classes(rows, 4)


def test_shared_items_counts_intersections():
    sets = [np.unique(np.array([rng.randrange(30000) for _ in range(n)], np.int64)) for n in (0, 1, 9000, 12000, 20000, 7)]
    got = near_dedup.shared_items(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert i == j or got[i, j] == len(np.intersect1d(a, b))
    assert (near_dedup.shared_items(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), 2) == got[:2, 2:]).all()


def edit_distance_within(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks(spark):
    items = [(k, prose(rng.randint(12, 40))) for k in range(8)] + [(50, None), (51, "...")]
    rows = []
    for k, text in items[:8]:
        for edits in (0, 1, 2, 4, 9):
            own = text.split()
            for _ in range(edits):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[word()], [], [own[at], word()]])
            rows.append((len(rows), prose(30) + ", " + " ".join(own).upper() + "! " + prose(30)))
    rows += [(800, None), (801, ""), (802, prose(80))]
    plain = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    want = {}
    for doc, text in rows:
        for item, own in items:
            m = len(plain(own))
            if m and (d := edit_distance_within(plain(own), plain(text))) <= int(0.15 * m):
                want[doc, item] = d
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(table(spark, rows), spark.createDataFrame(items, ITEMS), 0.15).collect()}
    assert got == want and len(want) > 12


def test_items_in_blocks(spark):
    items = [(k, prose(15)) for k in range(30)]
    rows = [(k, prose(5) + " " + t + " " + prose(5)) for k, t in items]
    got = decontaminate.leaks(table(spark, rows), spark.createDataFrame(items, ITEMS), 0.15, block_bytes=300)
    assert {(r.doc_id, r.item_id) for r in got.collect()} >= {(k, k) for k, _ in items}


def test_quality_on_held_out_rows(spark):
    rows, labels = [], []
    for k in range(400):
        good = rng.random() < 0.7
        rows.append((k, prose(80).capitalize() + "." if good else rng.choice([" ".join([word()] * 60), prose(50).upper().replace(" ", "!! ") + "!!", prose(50).replace(" ", "### ")])))
        labels.append((k, int(good), 0))
    got = quality.score_quality(table(spark, rows), spark.createDataFrame(labels, LABELS)).toPandas()
    truth = dict((a, b) for a, b, _ in labels)
    held = got[got.held_out]
    assert set(got.held_out) == {True, False} and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))
    assert np.mean([p == truth[i] for i, p in zip(held.doc_id, held.predicted)]) > 0.95


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.array([0, 2, 1, 3, 3.0]), np.array([3, 3, 3, 3, 3.0]))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == 1


def test_language_model(spark):
    common = [word() for _ in range(30)]
    rows = [(k, " ".join(common[(j + k) % 30] if j % 9 else word() for j in range(rng.randint(5, 90)))) for k in range(300)] + [(900, None), (901, "")]
    got = {r.doc_id: r for r in gru_lm.score_documents(table(spark, rows)).collect()}
    words = {k: re.findall(r"\S+", (t or "").lower()) + [None] for k, t in rows}
    counts = Counter(w for k, ws in words.items() if zlib.crc32(str(k).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for k, ws in words.items():
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def plain_log_probability(model, symbols):
    """The recurrence token by token, with nothing shared with the operator but the parameters."""
    p = {k: v.astype(float) for k, v in model.p.items()}
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    n, total, last, h = gru_lm.HIDDEN, 0.0, 0, np.zeros(gru_lm.HIDDEN)
    for s in symbols:
        a, u = p["x"][last], h @ p["h"]
        z, r = sigmoid(a[:n] + u[:n]), sigmoid(a[n : 2 * n] + u[n : 2 * n])
        new = np.tanh(a[2 * n :] + r * u[2 * n :])
        h = z * h + (1 - z) * new
        logits = h @ p["o"] + p["c"]
        kind = 0 if s == 0 else 1 + (s - 1) // gru_lm.PLACES if s <= gru_lm.HEAD else 1 + gru_lm.GROUPS + s - 1 - gru_lm.HEAD
        total += logits[kind] - np.log(np.exp(logits).sum())
        if 0 < s <= gru_lm.HEAD:
            group, place = divmod(s - 1, gru_lm.PLACES)
            within = p["e"][group] @ (h @ p["q"]) + p["b"][group]
            total += within[place] - np.log(np.exp(within).sum())
        last = int(s)
    return total / np.log(10)


def random_network(seed=3):
    draw = np.random.default_rng(seed)
    shares, places = draw.uniform(0.1, 1, gru_lm.CLASSES), draw.uniform(0.1, 1, (gru_lm.GROUPS, gru_lm.PLACES))
    model = gru_lm.Gru(shares / shares.sum(), (places.T / places.sum(axis=1)).T)
    model.p["e"] = draw.normal(0, 1, model.p["e"].shape).astype(np.float32)
    return model


def ended(texts):
    return np.concatenate([np.append(t, 0) for t in texts]).astype(np.uint16), np.cumsum([0, *(len(t) + 1 for t in texts)])


def test_network_against_plain_recurrence():
    draw, model = np.random.default_rng(5), random_network()
    texts = [draw.integers(1, gru_lm.SYMBOLS, n) for n in (0, 1, 7, 40, 200, 16, 17, 15)]
    symbols, bounds = ended(texts)
    got = model.log_probs(symbols, bounds)
    assert got == pytest.approx([plain_log_probability(model, np.append(t, 0)) for t in texts], rel=1e-4)
    first = model.train(symbols, bounds, 0.02)[0]
    for _ in range(8):
        last = model.train(symbols, bounds, 0.02)[0]
    assert last < first


def test_factors_sum_to_one():
    model = random_network()
    h = np.random.default_rng(1).normal(0, 0.3, (6, gru_lm.HIDDEN)).astype(np.float32)
    each = np.array([np.exp(model.token_logs(h, np.full(6, y))) for y in range(gru_lm.SYMBOLS)])
    assert each.sum(axis=0) == pytest.approx(1, rel=1e-4)
    exps, sums, _ = model.place_exps(h @ model.p["q"], np.full(6, 2 * gru_lm.PLACES))
    assert np.ptp(np.log(exps / sums[:, None]), axis=0).max() > 0.1  # the word's factor depends on the state


def test_gradients():
    """Against finite differences."""
    draw, model = np.random.default_rng(2), random_network()
    x, y = draw.integers(0, gru_lm.SYMBOLS, (5, 3)), draw.integers(0, gru_lm.SYMBOLS, (5, 3))
    x[0] = 0
    live, h = np.ones((5, 3), bool), np.zeros((3, gru_lm.HIDDEN), np.float32)
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    seen = {}
    model.update = lambda grad, rate: seen.update(grad)

    def loss():
        return model.train_window(x, y, live, h, 0)[1] / 15

    loss()
    grad = dict(seen)
    for k, v in model.p.items():
        flat = np.flatnonzero(np.abs(grad[k]).ravel() > 1e-4)
        for i in draw.choice(flat, min(5, len(flat)), replace=False):
            at, old = np.unravel_index(i, v.shape), v.flat[i]
            v[at] = old + 1e-2
            up = loss()
            v[at] = old - 1e-2
            down = loss()
            v[at] = old
            assert (up - down) / 2e-2 == pytest.approx(grad[k][at], rel=0.05, abs=2e-5), k


def test_score_against_plain_recomputation(spark):
    common = [word() for _ in range(40)]
    rows = [(k, " ".join(common[(j + k) % 40] if j % 5 else word() for j in range(rng.randint(0, 60)))) for k in range(120)]
    docs = table(spark, rows)
    vocab = gru_lm.materialise(gru_lm.count_words(docs.where(gru_lm.id_remainder(docs.doc_id) != 1)), "counts")
    counts = gru_lm.Counts(vocab)
    model = gru_lm.train(docs.where(gru_lm.id_remainder(docs.doc_id) != 1), counts)
    network = counts.network().load(model.astype(np.float32))
    times = Counter(w for k, t in rows if zlib.crc32(str(k).encode()) % 5 != 1 for w in t.split())
    order = {h: int(s) for h, s in zip(counts.own[0].tolist(), counts.own[1].tolist())}

    def symbol(w):
        batch = gru_lm.Batch(pa.array([w]))
        return order.get(int(batch.hashes[0]), 1 + gru_lm.HEAD + int(batch.ending[0]))

    total = defaultdict(lambda: 0.5)  # of each ending: its rare words and the unknown one
    for w, c in times.items():
        if symbol(w) > gru_lm.HEAD:
            total[symbol(w)] += c + 0.5
    got = {r.doc_id: r.score for r in gru_lm.score_with(docs, vocab, counts, model, 1).collect()}
    for k, t in rows:
        seq = [symbol(w) for w in t.split()]
        want = plain_log_probability(network, [*seq, 0])
        want += sum(math.log10((times[w] + 0.5) / total[s]) for w, s in zip(t.split(), seq) if s > gru_lm.HEAD)
        assert got[k] == pytest.approx(want, rel=1e-4), k


def test_long_text_beside_short_ones():
    """A batch's memory is that of its symbols and one window, however long a text is."""
    import tracemalloc

    texts = [np.full(1_000_000, 5, np.uint16)] + [np.full(20, 7, np.uint16)] * 1200
    symbols, bounds = ended(texts)
    lanes = gru_lm.Lanes(symbols, bounds, 1024)
    tracemalloc.start()
    seen = 0
    for k, (n, x, y, live, at) in enumerate(lanes.windows()):
        seen += int(live.sum())
        assert x.shape[0] <= gru_lm.WINDOW and (k < 10 or n == 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == len(symbols) and peak < 8 << 20


def test_quality_against_plain_recomputation(spark):
    """Statistics, features, ridge and the isotonic curve written out once more, without partitions or slices."""
    rows, labels = [], []
    for k in range(240):
        good = rng.random() < 0.6
        rows.append((k, prose(40).capitalize() + ".\nAnd then.\n" if good else rng.choice([" ".join([word()] * 30), prose(20).upper() + "!!", "### " + prose(15).replace(" ", " | "), "", None])))
        labels.append((k, int(good), 0))
    got = {r.doc_id: r.score for r in quality.score_quality(table(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}

    def stats(text):
        raw = (text or "").encode()
        ws = [w for w in re.split(rb"[ \t-\r]+", raw) if w]
        lines = [x for x in re.split(rb"(?<=\n)", raw) if x]
        n, m, b = len(ws), len(raw), max(len(raw), 1)
        upper = lambda w: sum(65 <= c <= 90 for c in w)
        odd = lambda w: sum(33 <= c < 127 and not chr(c).isalnum() and chr(c) not in ".,;:?!'\"()-" for c in w)
        share = lambda k: k / max(n, 1)
        count = lambda f: sum(map(f, raw)) / b
        return [
            math.log1p(m), math.log1p(n), share(sum(map(len, ws))), share(sum(len(w) > 12 for w in ws)), share(sum(len(w) < 4 for w in ws)),
            upper(raw) / b, count(lambda c: 48 <= c <= 57), count(lambda c: chr(c) in ".,;:?!'\"()-"), odd(raw) / b, count(lambda c: c == 33),
            count(lambda c: c == 124), count(lambda c: c > 127), count(lambda c: c == 10), share(len(set(ws))), share(sum(x == y for x, y in zip(ws, ws[1:]))),
            share(sum(odd(w) + w.count(b"!") > 1 for w in ws)), share(sum(upper(w) > 1 and 2 * upper(w) >= len(w) for w in ws)), len(set(lines)) / max(len(lines), 1), count(lambda c: c == 46),
        ]

    values = np.array([stats(t) for _, t in rows])
    fold = np.array([zlib.crc32(str(k).encode()) % 5 for k, _ in rows])
    y = np.array([q for _, q, _ in labels], float)
    known = fold != 0
    kernel = quality.Kernel(values[known].mean(axis=0), np.maximum(values[known].std(axis=0), 1e-3))
    z = kernel.features(values)
    fit = known & (fold != 1)
    a, side = z[fit].T @ z[fit], z.shape[1]
    raw = z @ np.linalg.solve(a + quality.RIDGE * max(a[-1, -1], 1) * np.eye(side) / quality.FEATURES, z[fit].T @ y[fit])
    own = fold == 1
    bins = np.floor((np.clip(raw[own], -0.5, 1.5) + 0.5) * (quality.BINS / 2))
    each = sorted(set(bins))
    x = [raw[own][bins == b].mean() for b in each]
    s, n = np.array([y[own][bins == b].sum() for b in each]), np.array([(bins == b).sum() for b in each], float)
    # least squares under order, by the minimum of maxima of means over stretches
    mean = lambda i, j, v: (v[i : j + 1]).sum() / n[i : j + 1].sum()
    level = [max(min(mean(i, j, s) for j in range(k, len(each))) for i in range(k + 1)) for k in range(len(each))]
    blocks = [[k for k in range(len(each)) if abs(level[k] - v) < 1e-12] for v in sorted(set(np.round(level, 12)))]
    blocks = [[k for k in range(len(each)) if abs(level[k] - v) < 1e-9] for v in sorted({round(v, 9) for v in level})]
    at = [mean(b[0], b[-1], np.array(x) * n) for b in blocks]
    want = 0.999 * np.interp(raw, at, [level[b[0]] for b in blocks]) + 0.001 * np.clip(raw, 0, 1)
    assert [got[k] for k, _ in rows] == pytest.approx(want.tolist(), abs=2e-3)


def test_chats(spark):
    turns = "conv_id long, turn long, role string, text string, pos int, rank int"
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 3, "assistant", "yo"), (2, 7, "user", None), (3, 0, "user", "hi"), (3, 1, "assistant", "no"),
        (4, 0, "user", "hi"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (None, 0, None, "lost"), (6, None, "user", "first"), (6, 1, "user", "last"),
    ]
    got = {r.conv_id: r for r in chat_format.format_chats(table(spark, rows, turns)).collect()}
    assert set(got) == {2, 3, None, 6}
    assert got[2].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert got[None].text == "<|im_start|>unknown\nlost<|im_end|>\n" and got[6].text.index("first") < got[6].text.index("last")
    parts = chat_format.format_chats(table(spark, [(1, k, "user", str(k)) for k in range(10)], turns), part_turns=3).orderBy("part").collect()
    assert len(parts) == 4 and re.findall(r"\n(\d)<", "".join(p.text for p in parts)) == list("0123456789")
    assert chat_format.format_chats(table(spark, [], turns)).count() == 0


@pytest.mark.parametrize("run_docs", [1024, 40, 2])
def test_near_duplicates_templated(spark, monkeypatch, run_docs):
    """Pairs just above the threshold in a group of which all other pairs are far below it, in nodes of hundreds; tiny runs make nodes go down."""
    monkeypatch.setattr(near_dedup, "RUN_DOCS", run_docs)
    own = random.Random(5)
    template, rows = [f"w{own.getrandbits(40)}" for _ in range(804)], []
    for pair in range(300):
        places = own.sample(range(6, 800, 6), 29)  # far apart: each changes five shingles
        for k, mine in enumerate((places[12:20], places[20:])):
            text = list(template)
            for at in places[:12]:
                text[at] = f"p{pair}x{at}"
            for at in mine:
                text[at] = f"d{pair}x{k}x{at}"
            rows.append((2 * pair + k, " ".join(text)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    missed = [p for p in range(300) if got[2 * p + 1] != 2 * p]
    assert missed == [] and len(set(got.values())) == 300


def templated(n, alike, own):
    """n texts of which each pair shares about `alike` of its shingles of four words."""
    words, rows = [f"w{own.getrandbits(40)}" for _ in range(400)], []
    edits = round(400 * (1 - alike) / (1 + alike) / 8)  # an edit changes four shingles of each of the two
    for k in range(n):
        text = list(words)
        for at in own.sample(range(4, 396, 5), edits):
            text[at] = f"d{k}x{at}"
        rows.append((k, " ".join(text)))
    return rows


@pytest.mark.parametrize("alike", [0.7, 0.84])
def test_rows_of_large_groups(spark, monkeypatch, alike):
    """In groups below and above the threshold, in nodes of over SMALL documents, the rows grow as the group while a node fits in a run, not as its square; nothing is lost.

    600 texts give nodes of some 420, of 167000 shingles: within RUN_DOCS and RUN_ITEMS.
    """
    made = defaultdict(int)
    whole = near_dedup.materialise

    def counted(df, name):
        out = whole(df, name)
        if name in ("near-nodes", "near-apart", "near-nominated"):
            made[n] += out.count()
        return out

    monkeypatch.setattr(near_dedup, "materialise", counted)
    for n in (350, 600):
        rows = templated(n, alike, random.Random(4))
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table(spark, rows), 4).collect()}
        assert n > 350 or got == classes(rows, 4)
        assert (len({c for _, c in got.values()}) == 1) == (alike > 0.8)
    assert made[600] < 1.25 * 600 / 350 * made[350]


def test_common_passages_hide_no_pair(spark):
    """Texts of which a third is one passage, so that all meet in nodes of hundreds; pairs of them just above the threshold."""
    own, rows = random.Random(8), []
    passage = [f"c{own.getrandbits(30)}" for _ in range(60)]
    for pair in range(250):
        rest = [f"p{own.getrandbits(40)}" for _ in range(130)]
        for k in (0, 1):
            text = list(rest)
            for at in own.sample(range(3, 127, 5), 2):
                text[at] = f"d{pair}x{k}x{at}"
            rows.append((2 * pair + k, " ".join(passage + text)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, rows), 4).collect()}
    want = {doc: least for doc, (_, least) in classes([r for r in rows if r[0] < 60], 4).items()}
    assert {k: got[k] for k in want} == want
    assert all(got[2 * p + 1] == 2 * p for p in range(250) if len(shingles(rows[2 * p][1], 4) & shingles(rows[2 * p + 1][1], 4)) >= 0.8 * len(shingles(rows[2 * p][1], 4) | shingles(rows[2 * p + 1][1], 4)))
