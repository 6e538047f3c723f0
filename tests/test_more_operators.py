"""Operators that SQL does not reach, against plain Python on small inputs."""

import random
import statistics
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import narrative_tasks as nt
from ledgerloom.operators import passages as ps
from ledgerloom.operators import scoring as sc
from ledgerloom.operators import tasks as tk
from ledgerloom.operators import uk
from ledgerloom.operators.retrieval import bm25, with_unscored
from ledgerloom.operators.sampling import halves, quotas, reserve


def test_deduplicated_tasks_merge_codes(spark):
    rows = spark.createDataFrame([("t", 2, "late", ["B"]), ("t", 1, "first", ["C", "A"]), ("u", 1, "x", [])], "task_id string, at int, v string, validator_codes array<string>")
    assert sorted(map(tuple, tk.deduplicated(rows, ["at"]).select("task_id", "v", "validator_codes").collect())) == [("t", "first", ["A", "B", "C"]), ("u", "x", [])]


def test_doubled_labels_are_left_out(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    assert {r.v for r in uk.unique_labels(rows, ["k"]).collect()} == {"c", "d"}


def test_cluster_interval_is_pythons(spark):
    own = random.Random(1)
    rows = [(c, own.random() < 0.3 + c / 40) for c in range(20) for _ in range(own.randint(1, 9))]
    got = sc.cluster_summary(spark.createDataFrame(rows, "cluster int, hit boolean"), "cluster", "hit", "cluster").first()
    rates = [statistics.fmean(h for k, h in rows if k == c) for c in range(20)]
    draw = random.Random(sc.SEED)
    means = sorted(statistics.fmean(draw.choice(rates) for _ in rates) for _ in range(sc.BOOTSTRAP))

    def at(p):
        k = (len(means) - 1) * p
        return means[int(k)] * (1 - k % 1) + means[min(int(k) + 1, len(means) - 1)] * (k % 1)

    assert (got.clusters, got.macro, got.low, got.high) == (20, pytest.approx(statistics.fmean(rates)), pytest.approx(at(0.025)), pytest.approx(at(0.975)))


def test_excerpts():
    text = "First here. We go on, and in our opinion, the financial statements present fairly what they do! Last."
    start = text.index("in our opinion")
    assert ps._excerpt(text, start, start + 14, 500) == "We go on, and in our opinion, the financial statements present fairly what they do!"
    for most in (20, 40, 60):
        own = ps._excerpt(text, start, start + 14, most)
        assert own in text and len(own) <= most and "in our opinion" in own
    assert ps._excerpt(text, start, start + 14, 5) == "in ou" and ps._excerpt("in our opinion", 0, 14, 90) == "in our opinion"


def test_sentences_stems_anchors(spark):
    text = "The U.S. market grew. Acme Inc. sells it. Sold by Co. of it! Is it? 3.5 left"
    assert [text[a:b] for a, b in ps.sentence_spans(text)] == ["The U.S. market grew.", "Acme Inc. sells it.", "Sold by Co. of it!", "Is it?"]
    words = {"Investments": "invest", "'leases'": "lease", "going": "going", "utilities": "utiliti", "cat": "cat", "provisions.": "provis"}
    rows = spark.createDataFrame(list(words.items()), "w string, want string").select("want", ps.stem(F.col("w")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    stop = ["the", "of", "a", "to"]
    lines = [("the fair, value of goodwill", "the fair, value of"), ("of the value", "value"), ("lease of (the) cost", "lease of (the) cost"), ("a of to", None)]
    got = spark.createDataFrame(lines, "t string, want string").select("want", ps.anchor(F.col("t"), stop).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_first_acceptable_donor_is_found_however_far(spark):
    schema = "s struct<task_id:string,filing_id:string,pool:int,n:int>"
    sources = spark.createDataFrame([((f"s{k}", "f", 0, k),) for k in (0, 5, 70, 999)], schema)
    donors = spark.createDataFrame([((f"d{k:03}", "g", 0, k),) for k in range(100)], schema.replace("s struct", "d struct"))
    got = {r.s.task_id: r.d.task_id for r in nt.first_acceptable(sources, donors, "pool", F.col("d.n") >= F.col("s.n"), width=2).collect()}
    assert got == {"s0": "d000", "s5": "d005", "s70": "d070"}


def test_narrative_routing(spark):
    schema = "task_id string, filing_id string, ticker string, period_key string, label string, question string, retrieval_query string, item string, heading string, subheading string, heading_path string"
    rows = [
        ("t1", "f", "k", "FY1", "a", "How are leases recognised?", "leases recognised liabilities", None, "Leases", "Operating Leases", None),
        ("t2", "f", "k", "FY1", "a", "How is goodwill tested?", "goodwill tested impairment", None, "Goodwill", "Goodwill Impairment", None),
        ("t3", "f", "k", "FY1", "b", "How is goodwill tested?", "goodwill tested impairment", None, "Goodwill", "Goodwill Impairment", None),
    ]
    frame = spark.createDataFrame(rows, schema)
    tasks = nt.prepared(frame, nt.filing_tokens(frame.withColumn("retrieval_text", F.col("retrieval_query"))), [])
    asked = [(1, "f", "how are  LEASES recognised"), (2, "f", "How is goodwill tested?"), (3, "f", "Tell how operating leases liabilities are recognised"), (4, "f", "weather"), (5, "other", "How are leases recognised?"), (6, "f", "")]
    got = {r.question_id: (r.task_id, r.code) for r in nt.routed(spark.createDataFrame(asked, "question_id int, filing_id string, question string"), tasks).collect()}
    assert got == {1: ("t1", None), 2: (None, "AMBIGUOUS"), 3: ("t1", None), 4: (None, "NO_MATCH"), 5: (None, "NO_MATCH"), 6: (None, "NO_MATCH")}
    assert SequenceMatcher(None, "ab", "ab").ratio() == 1


def test_routing_scores_few_pairs_and_finds_what_all_pairs_would(spark, monkeypatch):
    own = random.Random(3)
    word = lambda most: f"{'abcdefghij'[int(own.random() ** 2 * most)]}word"
    schema = "task_id string, filing_id string, ticker string, period_key string, label string, question string, retrieval_query string, item string, heading string, subheading string, heading_path string"
    rows = [(f"t{k:03}", f"f{k % 2}", "k", "FY1", "a", f"How is {word(9)} {word(9)} x{k // 2 % 97}?", " ".join(word(9) for _ in range(own.randint(0, 4))), None, f"Part {word(5)}", word(9), None) for k in range(240)]
    frame = spark.createDataFrame(rows, schema)
    tasks = nt.prepared(frame, None, []).cache()
    asked = [(k, r[1], f"Tell of {r[9]}: {r[6]} {r[5]}" if k % 3 else " ".join(word(9) for _ in range(k % 7))) for k, r in enumerate(rows)] + [(900, "f0", rows[0][5]), (901, "none", "x1"), (902, "f1", None)]
    questions = spark.createDataFrame(asked, "question_id int, filing_id string, question string")
    pairs, ratio = [], nt._with_ratio
    monkeypatch.setattr(nt, "_with_ratio", lambda frame: (pairs.append(frame.count()), ratio(frame))[1])
    got = {r.question_id: (r.task_id, r.code) for r in nt.routed(questions, tasks).collect()}
    assert pairs[0] < len(rows) * len(asked) / 8  # all pairs of a filing are half of that
    held, want = tasks.collect(), {}
    for q in questions.select("question_id", "filing_id", nt.question_key(F.col("question")).alias("key"), nt.nv.query_tokens(F.coalesce("question", F.lit(""))).alias("words")).collect():
        near = [t for t in held if t.filing_id == q.filing_id]
        same = sorted(t.task_id for t in near if t.question_key == q.key)
        share = lambda ws: len(set(ws) & set(q.words)) / len(ws) if ws else 0.0  # noqa: B023, E731
        score = lambda t: 2.5 * share(t.question_words) + 2.0 * share(t.query_words) + 1.5 * share(t.scope_words) + share(t.heading_words) + (0.5 if t.scope.lower() in q.key else 0.0) + 0.5 * SequenceMatcher(None, q.key, t.question_key).ratio()  # noqa: B023, E731
        top = sorted((-score(t) if q.words else 0.0, t.task_id) for t in near)[:2] + [(0.0, "")] * 2
        if len(same) == 1:
            want[q.question_id] = (same[0], None)
        elif same or (-top[0][0] >= nt.LEAST_SCORE and top[1][0] - top[0][0] < nt.MARGIN):
            want[q.question_id] = (None, "AMBIGUOUS")
        else:
            want[q.question_id] = (top[0][1], None) if -top[0][0] >= nt.LEAST_SCORE else (None, "NO_MATCH")
    assert got == want and {c for _, c in want.values()} == {None, "AMBIGUOUS", "NO_MATCH"}


def test_a_large_group_of_runs_is_cut_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(sc, "GROUP_PAIRS", 100)
    rows = [(f"r{k}", None if k % 10 else "c", "bf16" if k % 3 else "fp8", k / 7, float(k)) for k in range(90)] + [("n", None, None, 1.0, 1.0)]
    runs = spark.createDataFrame(rows, "run string, corpus string, kind string, acc double, speed double").repartition(3)
    out = sc.matched_pairs(runs, ["corpus"], "kind", ["acc"], ["speed"], F.col("kind") == "bf16")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[2] == "bf16" and b[2] == "fp8" and a[1] == b[1])
    assert sorted((r.baseline, r.challenger) for r in out.select("baseline", "challenger").collect()) == want


def test_quotas_and_reservations(spark):
    rows = spark.createDataFrame([(k, "OK" if k % 3 else "REFUSAL", k % 5) for k in range(60)], "id int, status string, stratum int")
    assert halves(7) == {"OK": 4, "REFUSAL": 3}
    got = quotas(rows, "status", halves(7), ["stratum"], "id", "s").collect()
    assert sorted(r.status for r in got) == ["OK"] * 4 + ["REFUSAL"] * 3 and len({r.stratum for r in got if r.status == "OK"}) == 4
    with pytest.raises(ValueError, match="short by 30 of REFUSAL"):
        quotas(rows, "status", {"REFUSAL": 50}, ["stratum"], "id")
    taken, left = reserve(rows, "status", {"OK": 2}, ["stratum"], "id", lambda rest: rest.where("stratum = 0").count() >= 10, "s")
    assert taken.count() == 2 and left.count() == 58


def test_documents_without_a_shared_term_score_zero(spark):
    docs = spark.createDataFrame([("s", 1, "red fox"), ("s", 2, "dog"), ("t", 3, "fox")], "scope string, doc_id long, text string")
    asked = spark.createDataFrame([(7, "s", "fox")], "qid long, scope string, text string")
    got = {r.doc_id: r.score for r in with_unscored(bm25(docs, asked), docs, asked).collect()}
    assert set(got) == {1, 2} and got[2] == 0 < got[1]


def test_uk_sentence_chunks(spark):
    long = "x" * 30
    docs = spark.createDataFrame([(1, f"One two. Three four! {long}. Five."), (2, None), (3, "")], "doc_id long, text string")
    got = [r.text for r in uk.sentence_chunks(docs, "doc_id", 20).orderBy("chunk_index").collect()]
    assert got == ["One two. Three four!"[:8] + " Three four!" if len("One two. Three four!") < 20 else "One two.", *got[1:]] and got[-1] == "Five." and "".join(got).count("x") == 30 and all(len(c) <= 20 for c in got)
