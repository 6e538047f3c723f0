"""The pipeline's stages against brute force on the smallest tables."""

import re
from collections import Counter

import corpus_pipeline as pipeline
from ledgerloom.llm.queries import vocabulary
from test_operators import classes, edit_distance_within

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        seen[name] = (docs, docs := spark.read.parquet(path))
        assert name == "sentencepiece" or sorted(docs.columns) == sorted(columns)
    rows = {name: ({r.doc_id: r for r in a.collect()}, {r.doc_id: r for r in b.collect()}) for name, (a, b) in seen.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = rows["quality"]
    known = [i for i in before if i in labels]
    assert sum((i in after) == bool(labels[i]) for i in known) >= 0.95 * len(known)
    before, after = rows["exact_dedup"]
    first = {}
    for i in sorted(before):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", before[i].text or ""), i)
    assert set(after) == set(first.values())
    before, after = rows["near_dedup"]
    assert set(after) == {i for i, (_, least) in classes([(i, before[i].text) for i in sorted(before)], 5).items() if i == least}
    before, after = rows["decontaminate"]
    plain = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i in before:
        if i not in after:
            assert any(edit_distance_within(item, plain(before[i].text)) <= int(0.15 * len(item)) for item in items)
        else:
            assert not any(" ".join(item) in " ".join(plain(before[i].text)) for item in items)
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    before, after = rows["sentencepiece"]
    assert set(before) == set(after)
    assert all(after[i].ids == library.encode(before[i].text, add_bos=True, add_eos=True) for i in before)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _digest string, _hash long, class binary, text_hash int, kept boolean"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[None] * 5) for i, t in rows], SCHEMA)


def test_stages_on_awkward_rows(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(30).collect()
    long = " ".join(r.text for r in base if r.text) * 3
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    good = [(r.doc_id, r.text) for r in base]
    odd = [(None, "no id at all"), (None, None), (None, "no id at all"), (900_001, None), (900_002, ""), (900_003, long), (900_003, long), (900_004, f"Begin {item} end."), (None, f"Begin  {item} end."), (900_005, good[0][1]), (900_005, "another text of this id")]
    docs = table(spark, good + odd)
    for name, stage in pipeline.STAGES:
        before = Counter((r.doc_id, r.text) for r in docs.collect())
        out = stage(spark, docs, SF)
        if name == "sentencepiece":
            assert Counter(r.doc_id for r in out.collect()) == Counter(i for i, _ in before.elements())
            break
        assert out.columns == docs.columns, name
        after = Counter((r.doc_id, r.text) for r in out.collect())
        assert not after - before, name
        if name == "quality":  # the other stages are given what it may have taken
            assert all(after[k] in (0, n) for k, n in before.items())
            continue
        if name == "exact_dedup":
            normal = lambda t: re.sub(r"[ \t-\r]+", " ", t or "")
            assert Counter(normal(t) for _, t in after.elements()) == Counter({normal(t): 1 for _, t in before})
            assert after[None, "no id at all"] == 1 and after[900_005, "another text of this id"] == 1 and after[900_003, long] == 1
        if name == "decontaminate":
            assert not any(item in (t or "") for _, t in after) and after[None, "no id at all"] == 1
        docs = out


def test_stages_on_an_empty_table(spark):
    docs = table(spark, [])
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (name == "sentencepiece" or out.columns == docs.columns)
