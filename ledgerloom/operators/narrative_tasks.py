"""Questions on notes that a filing answers, and questions that it does not: donors, phrases, routing.

A donor is another task whose words are moved into a question on the source. The first acceptable
donor in the order of (filing, task) is looked for in stretches of donors that grow, so no source
meets all donors unless none of them will do. What depends on the source's filing only is decided
once a filing, and of a filing's words a pair of tasks carries those of the donor.

Unlike a walk that remembers what it made, each source decides on its own; equal questions of one
filing are left out afterwards (`first_questions`).

Defined cases: a task without scope is titled `this note`; a source without an acceptable donor has
no question of that type; a task without words in its question scores 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import narrative as nv
from ..functions.text import collapse
from ..storage import materialise
from .sampling import round_robin

UNSEEN, ATTRIBUTE = 3, 2
LEAST_SCORE, MARGIN = 2.0, 0.15
NEGATIVES = ["same_filing_wrong_note", "same_issuer_wrong_period", "unsupported_attribute", "cross_label_query_transfer", "cross_filing_query_transfer"]


def filing_tokens(chunks: DataFrame) -> DataFrame:
    """filing_id and the distinct query words of all its texts and headings."""
    own = F.array_union(F.array_union(nv.query_tokens(F.coalesce("retrieval_text", F.lit(""))), nv.query_tokens(F.coalesce("heading", F.lit("")))), nv.query_tokens(F.coalesce("subheading", F.lit(""))))
    return chunks.select("filing_id", F.explode(own).alias("t")).groupBy("filing_id").agg(F.array_sort(F.collect_set("t")).alias("filing_words"))


def scope_title() -> Column:
    """The first of subheading, path, heading and item that is not blank."""
    return F.coalesce(*[F.nullif(nv.heading(F.col(c)), F.lit("")) for c in ("subheading", "heading_path", "heading", "item")], F.lit("this note"))


def prepared(tasks: DataFrame, words: DataFrame | None, focus_stop: list[str]) -> DataFrame:
    """Tasks with their scope and the words of question, query, scope, heading and focus, and with `words` their filing's words.

    tasks: task_id, filing_id, ticker, period_key, label, question, retrieval_query, item, heading, subheading, heading_path.
    A filing's words in each of its tasks are many times the tasks themselves; routing and donors do without.
    """
    rows = tasks.withColumn("scope", scope_title()).withColumn("scope_key", F.lower("scope")).withColumn("scope_words", nv.query_tokens(F.col("scope")))
    rows = rows.withColumn("query_words", nv.query_tokens(F.coalesce("retrieval_query", F.lit("")))).withColumn("question_words", nv.query_tokens(F.coalesce("question", F.lit(""))))
    rows = rows.withColumn("heading_words", nv.query_tokens(F.coalesce("heading_path", "heading", F.lit("")))).withColumn("question_key", question_key(F.col("question")))
    free = lambda xs: F.filter(xs, lambda w: ~w.isin(*focus_stop)) if focus_stop else xs
    focus = F.array_except(free(F.when(F.size("query_words") > 0, F.col("query_words")).otherwise(F.col("question_words"))), F.col("scope_words"))
    rows = rows.withColumn("focus", F.when(F.size(focus) > 0, focus).otherwise(free(F.col("scope_words"))))
    if words is None:
        return rows
    return rows.join(words, "filing_id", "left").withColumn("filing_words", F.coalesce("filing_words", F.array().cast("array<string>")))


def question_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(collapse(F.coalesce(text, F.lit("")))), r"[\s?.!]+$", ""))


def attribute_phrase(s: str = "s", d: str = "d") -> Column:
    """Words of the donor's scope and focus that the source's filing lacks: two to four; null if fewer."""
    new = lambda xs, most: F.slice(F.array_except(F.array_except(xs, F.col(f"{s}.filing_words")), F.col(f"{s}.scope_words")), 1, most)
    scope = F.array_except(F.array_except(F.col(f"{d}.scope_words"), F.col(f"{s}.filing_words")), F.col(f"{s}.scope_words"))
    focus = F.array_except(new(F.slice(F.col(f"{d}.focus"), 1, 6), 6), F.col(f"{d}.scope_words"))
    first = F.concat(F.slice(scope, 1, 3), F.slice(focus, 1, 3))
    other = F.slice(F.array_except(F.col(f"{d}.query_words"), F.col(f"{s}.filing_words")), 1, 4)
    found = F.when(F.size(first) >= ATTRIBUTE, first).otherwise(other)
    return F.when(F.size(found) >= ATTRIBUTE, F.array_join(F.slice(found, 1, 4), " "))


def transfer_phrase(s: str = "s", d: str = "d") -> Column:
    """The donor's focus, then its words that the source's filing lacks, without the source's scope: three to six; null if fewer."""
    focus = F.array_except(F.slice(F.col(f"{d}.focus"), 1, 8), F.col(f"{s}.scope_words"))
    new = F.array_except(F.array_except(F.col(f"{d}.query_words"), F.col(f"{s}.filing_words")), F.col(f"{s}.scope_words"))
    found = F.concat(focus, F.array_except(new, focus))
    return F.when(F.size(found) >= UNSEEN, F.array_join(F.slice(found, 1, 6), " "))


def _places(donors: DataFrame) -> DataFrame:
    """With `at`: the place of each donor of a pool by filing and task, counted in ranges of them, so no pool passes through one task."""
    order = ["pool", "d.filing_id", "d.task_id"]
    dealt = materialise(donors.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "dealt")
    parts = dealt.groupBy("pool", "_p").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(W.Window.partitionBy("pool").orderBy("_p")) - F.col("_rows")
    parts = parts.withColumn("_before", before).drop("_rows")
    return materialise(dealt.join(parts, ["pool", "_p"]).select("pool", "d", (F.col("_before") + F.col("_i") - F.col("_first")).alias("at")), "donors")


def first_acceptable(
    sources: DataFrame, donors: DataFrame, pool: str, accept: Column, width: int = 64, words: DataFrame | None = None, differs: tuple[str, ...] = (), likely: Column | None = None
) -> DataFrame:
    """For each source (struct `s`) the first donor (struct `d`) of its pool in another filing, by filing and task, for which `accept` holds.

    Sources of one filing and pool that agree on `differs` look as a group: it meets stretches of 64, 256, 1024 ... donors,
    passing over its own filing's, and its sources meet the first 4, 8, 16 ... that are `likely`. `likely` must hold wherever
    `accept` does; its `s` has the group's columns and no scope words. A source leaves with a donor or at its pool's end.
    With `words` (filing_id, _word) the `s.filing_words` of each pair are those of the filing that the donor has, too.
    """
    ranked = _places(donors.select(F.col(f"d.{pool}").alias("pool"), "d"))
    sizes = ranked.groupBy("pool").agg(F.count(F.lit(1)).alias("size"))
    own = ranked.groupBy("pool", F.col("d.filing_id").alias("_f")).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    keyed = sources.select(F.struct("s.filing_id", *[f"s.{c}" for c in differs], F.col(f"s.{pool}").alias("_pool")).alias("g"), "s")
    outside = F.when(F.col("next").between(F.col("lo"), F.col("hi")), F.col("hi") + 1).otherwise(F.col("next")).cast("long")
    groups = keyed.select("g", F.col("g._pool").alias("pool"), F.col("g.filing_id").alias("_f")).distinct().join(sizes, "pool").join(own, ["pool", "_f"], "left")
    state = materialise(groups.withColumn("next", F.lit(0).cast("long")).withColumn("k", F.lit(4)).withColumn("next", outside), "groups")
    left = materialise(keyed.join(state.where("next < size").select("g"), "g", "left_semi"), "sources")
    none, found = F.array().cast("array<string>"), []
    while not left.isEmpty():
        blocks = F.sequence(F.floor(F.col("next") / width), F.floor((F.col("next") + width - 1) / width))
        here = state.where("next < size").withColumn("_b", F.explode(blocks))
        pairs = here.join(ranked.withColumn("_b", F.floor(F.col("at") / width)), ["pool", "_b"])
        pairs = pairs.where((F.col("at") >= F.col("next")) & (F.col("at") < F.col("next") + width) & ~F.coalesce(F.col("at").between(F.col("lo"), F.col("hi")), F.lit(False))).select("g", "k", "at", "d")
        group = ["g.filing_id", *[f"g.{c}" for c in differs]]
        if words is not None:
            theirs = F.array_union(F.array_union("d.query_words", "d.scope_words"), F.col("d.focus"))
            held = pairs.select("g", "at", "g.filing_id", F.explode(theirs).alias("_word")).join(words, ["filing_id", "_word"]).groupBy("g", "at").agg(F.collect_set("_word").alias("known"))
            pairs = pairs.join(held, ["g", "at"], "left").withColumn("known", F.coalesce("known", none))
            group += [none.alias("scope_words"), F.col("known").alias("filing_words")]
        if likely is not None:
            pairs = pairs.withColumn("s", F.struct(*group)).where(likely).drop("s")
        place = F.row_number().over(W.Window.partitionBy("g").orderBy("at"))
        liked = materialise(pairs.withColumn("n", place).where("n <= k").drop("k"), "liked")
        met = left.join(liked.drop("n"), "g")
        if words is not None:
            met = met.withColumn("s", F.col("s").withField("filing_words", F.col("known")))
        met = met.where(accept).groupBy("s.task_id").agg(F.min_by(F.struct("s", "d"), "at").alias("_b")).select("_b.s", "_b.d")
        found.append(materialise(met, "donated"))
        seen = liked.groupBy("g").agg(F.max("n").alias("got"), F.max("at").alias("last"))
        state = state.where("next < size").join(seen, "g", "left").withColumn("next", F.when(F.col("got") >= F.col("k"), F.col("last") + 1).otherwise(F.col("next") + width))
        state = materialise(state.withColumn("k", F.when(F.col("got") > 0, F.col("k") * 2).otherwise(F.col("k"))).drop("got", "last").withColumn("next", outside), "groups")
        done = found[-1].select(F.col("s.task_id").alias("_t"))
        left = materialise(left.join(state.where("next < size").select("g"), "g", "left_semi").join(done, F.col("s.task_id") == F.col("_t"), "left_anti"), "sources")
        width *= 4
    if not found:
        return sources.join(donors, F.lit(False))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _other_note(tasks: DataFrame) -> DataFrame:
    """For each task (struct `s`) the first task (struct `d`) of its filing with another scope: the filing's first task, or the first that differs from it."""
    s, d = F.struct(*tasks.columns).alias("s"), F.struct(*tasks.columns).alias("d")
    rows = tasks.select("filing_id", d)
    first = materialise(rows.groupBy("filing_id").agg(F.min_by("d", "d.task_id").alias("first")), "first-notes")
    # a row for each filing is broadcast, so that a large filing's tasks stay where they are
    second = rows.join(F.broadcast(first.select("filing_id", F.col("first.scope_key").alias("_scope"))), "filing_id").where("d.scope_key <> _scope").groupBy("filing_id").agg(F.min_by("d", "d.task_id").alias("second"))
    both = materialise(first.join(second, "filing_id"), "other-notes")  # a filing of one scope has none
    found = F.when(F.col("s.scope_key") != F.col("first.scope_key"), F.col("first")).otherwise(F.col("second"))
    return tasks.select("filing_id", s).join(F.broadcast(both), "filing_id").select("s", found.alias("d"))


def unanswerable(tasks: DataFrame, words: DataFrame, limit: int | None = None) -> DataFrame:
    """Questions that their filing does not answer, of five types: source task, type, donor, question and retrieval query.

    `tasks` are `prepared`, each of an id of its own; `words` are their `filing_tokens`. With `limit` the types take turns until so many are there.
    """
    tasks = tasks.drop("filing_words")
    held = materialise(words.select("filing_id", F.explode("filing_words").alias("_word")), "filing-words")
    s, d = F.struct(*tasks.columns).alias("s"), F.struct(*tasks.columns).alias("d")
    sources, donors = tasks.select(s), tasks.select(d)
    other = F.col("d.filing_id") != F.col("s.filing_id")
    scope = F.col("s.scope")
    lacking = F.size(F.array_except("d.query_words", "s.filing_words")) >= UNSEEN
    asked = lambda phrase: F.concat(F.lit("Does the "), scope, F.lit(" note discuss "), phrase, F.lit("?"))
    with_scope = lambda text: F.concat_ws(" ", scope, text)
    everyone = lambda frame, c: frame.withColumn(c, F.col(c).withField("every", F.lit(1)))
    wrong_note = F.concat(F.lit("In the "), scope, F.lit(" note, "), F.regexp_replace("d.question", r"[ ?]+$", ""), F.lit("?"))
    period = F.concat(F.lit("For this period, does the "), scope, F.lit(" note discuss "), transfer_phrase(), F.lit("?"))
    kinds = [
        ("same_issuer_wrong_period", "ticker", ("period_key",), other & (F.col("d.period_key") != F.col("s.period_key")) & transfer_phrase().isNotNull(), period, with_scope(transfer_phrase())),
        ("unsupported_attribute", "label", (), other & attribute_phrase().isNotNull(), asked(attribute_phrase()), with_scope(attribute_phrase())),
        ("cross_label_query_transfer", "every", ("label",), other & (F.col("d.label") != F.col("s.label")) & lacking, F.col("d.question"), F.col("d.retrieval_query")),
        ("cross_filing_query_transfer", "label", (), other & transfer_phrase().isNotNull(), asked(transfer_phrase()), with_scope(transfer_phrase())),
    ]
    shape = lambda met, name, text, query: met.select(F.col("s.task_id").alias("source_task"), F.col("s.filing_id").alias("filing_id"), F.lit(name).alias("negative_type"), F.col("d.task_id").alias("donor_task"), text.alias("question"), query.alias("retrieval_query"))
    rows = shape(_other_note(tasks), "same_filing_wrong_note", wrong_note, with_scope("d.retrieval_query"))
    for name, pool, differs, accept, text, query in kinds:
        left, right = (everyone(sources, "s"), everyone(donors, "d")) if pool == "every" else (sources, donors)
        rows = rows.unionByName(shape(first_acceptable(left, right, pool, accept, words=held, differs=differs, likely=accept), name, text, query))
    rows = first_questions(rows, tasks)
    if limit is None:
        return rows
    order = F.element_at(F.create_map(*[F.lit(x) for n, k in enumerate(NEGATIVES) for x in (k, n)]), F.col("negative_type"))
    return round_robin(rows.withColumn("_type", order).withColumn("_all", F.lit(1)), "_type", ["filing_id", "source_task"], limit, ["_all"]).drop("_type", "_all")


def first_questions(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """Of equal questions of a filing the first by source and type, without those that the filing's own tasks ask."""
    keyed = rows.withColumn("_k", question_key(F.col("question")))
    asked = tasks.select("filing_id", F.col("question_key").alias("_k")).distinct()
    # an aggregate, since thousands of sources may make one question
    first = keyed.groupBy("filing_id", "_k").agg(F.min_by(F.struct(*rows.columns), F.struct("source_task", "negative_type")).alias("_r"))
    return first.join(asked, ["filing_id", "_k"], "left_anti").select("_r.*")


def routed(questions: DataFrame, tasks: DataFrame) -> DataFrame:
    """With task_id and code: the filing's one task of that question, else the best by shared words if it scores 2 and leads by 0.15.

    questions: question_id, filing_id, question; tasks are `prepared`. Codes: NO_MATCH, AMBIGUOUS.
    Equal questions, and tasks that score alike, are scored once. Tasks that can neither be the best at 2 nor come within
    0.15 of it are left out: see `_near`.
    """
    key, said = question_key(F.col("question")), nv.query_tokens(F.coalesce("question", F.lit("")))
    asked = materialise(questions.withColumn("_key", key).withColumn("_words", said), "questions")
    fields = ["question_words", "query_words", "scope_words", "heading_words"]
    own = tasks.dropDuplicates(["task_id"])
    alike = own.groupBy("filing_id", F.col("question_key").alias("_theirs"), *fields, F.lower("scope").alias("_scope")).agg(F.count(F.lit(1)).alias("_tasks"), F.min("task_id").alias("task_id"))
    alike = materialise(alike.withColumn("_t", F.monotonically_increasing_id()), "alike-tasks")
    exact = alike.groupBy("filing_id", F.col("_theirs").alias("_key")).agg(F.sum("_tasks").alias("_exact"), F.min("task_id").alias("_own"))
    once = asked.select("filing_id", "_key", "_words").distinct().join(exact, ["filing_id", "_key"], "left")
    once = materialise(once.withColumn("_q", F.monotonically_increasing_id()), "distinct-questions")
    near = _near(once.where((F.col("_key") != "") & (F.size("_words") > 0) & F.col("_exact").isNull()).select("_q", "filing_id", "_key", "_words"), alike)
    scored = _with_ratio(near).withColumn("_score", F.col("_score") + 0.5 * F.col("ratio"))
    # two tasks that score alike are a best and a second
    two = F.transform(F.sequence(F.lit(1), F.least("_tasks", F.lit(2)).cast("int")), lambda k: F.struct((-F.col("_score")).alias("score"), "task_id"))
    best = scored.withColumn("_two", two).groupBy("_q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_two"))), 1, 2).alias("_top"))
    first, second = -F.get("_top", 0)["score"], -F.get("_top", 1)["score"]
    code = (
        F.when(F.col("_exact") == 1, None).when(F.col("_exact") > 1, "AMBIGUOUS").when(F.col("_top").isNull() | (first < LEAST_SCORE), "NO_MATCH").when(second.isNotNull() & (first - second < MARGIN), "AMBIGUOUS")
    )
    chosen = F.when(F.col("_exact") == 1, F.col("_own")).otherwise(F.get("_top", 0)["task_id"])
    said = once.join(best, "_q", "left").withColumn("code", code).select("filing_id", "_key", "_words", "code", F.when(F.col("code").isNull(), chosen).alias("task_id"), F.lit(True).alias("_known"))
    out = asked.join(said, ["filing_id", "_key", "_words"], "left")
    return out.select(*questions.columns, F.when(F.col("_known").isNull(), "NO_MATCH").otherwise(F.col("code")).alias("code"), "task_id")


WEIGHTS = {"question_words": 2.5, "query_words": 2.0, "scope_words": 1.5, "heading_words": 1.0}
#: Bounds on the shared words' score under which pairs are looked for one after the other.
BOUNDS = [4.5, 3.0, 1.8, LEAST_SCORE - MARGIN - 1.0]


def _near(asked: DataFrame, tasks: DataFrame) -> DataFrame:
    """Questions with the tasks of their filing that may be the best or come within the margin of it, and their scores without ratio.

    Scope and ratio add 0.5 each at most, so a task that counts shares words of LEAST_SCORE - MARGIN - 1 or more, and of the
    best score found - MARGIN - 1. A task that shares words of `bound` or more shares one of its rarest words whose others
    weigh less than that: pairs meet by those. The first bound leaves each task its one or two rarest words; questions that
    no task answers well enough for that bound to cover all that count go on to the next.
    """
    least, slack = LEAST_SCORE - MARGIN, 1e-6
    share = lambda c: F.coalesce(F.try_divide(F.size(F.array_intersect("_words", c)), F.size(c)), F.lit(0.0))
    words = WEIGHTS["question_words"] * share("question_words") + WEIGHTS["query_words"] * share("query_words") + WEIGHTS["scope_words"] * share("scope_words") + share("heading_words")
    title = F.when((F.col("_scope") != "") & F.contains("_key", F.col("_scope")), 0.5).otherwise(0.0)
    weighed = lambda c: F.transform(F.array_distinct(c), lambda w: F.struct(w.alias("w"), (F.lit(WEIGHTS[c]) / F.size(c)).alias("x")))
    weight = F.concat(*map(weighed, WEIGHTS))
    weights = tasks.select("filing_id", "_t", F.explode(weight).alias("_w")).groupBy("filing_id", "_t", F.col("_w.w").alias("_word")).agg(F.sum("_w.x").alias("_x"))
    weights = materialise(weights, "task-words")
    often = weights.groupBy("filing_id", "_word").agg(F.count(F.lit(1)).alias("_n"))
    commoner = F.sum("_x").over(W.Window.partitionBy("_t").orderBy(F.desc("_n"), F.desc("_word")))  # of this word and the more frequent ones
    lists = materialise(weights.join(often, ["filing_id", "_word"]).withColumn("_up_to", commoner).select("filing_id", "_word", "_t", "_up_to"), "task-word-lists")
    left, found = materialise(asked, "open-questions"), []
    for bound in BOUNDS:
        reached = lists.where(F.col("_up_to") >= bound - slack).drop("_up_to")
        met = left.select("filing_id", "_q", F.explode("_words").alias("_word")).join(reached, ["filing_id", "_word"]).select("_q", "_t").distinct()
        pairs = left.drop("filing_id").join(met, "_q").join(tasks.drop("filing_id"), "_t")
        pairs = pairs.select("_q", "_key", "_theirs", "task_id", "_tasks", (words + title).alias("_score")).where(F.col("_score") + 0.5 >= least - slack)
        top = pairs.groupBy("_q").agg(F.max("_score").alias("_best"))
        done = F.lit(True) if bound == BOUNDS[-1] else F.col("_best") - MARGIN - 1.0 >= bound + slack
        top = materialise(top.where(done), "best-scores")
        found.append(materialise(pairs.join(top, "_q").where(F.col("_score") + 0.5 >= F.col("_best") - MARGIN - slack).drop("_best"), "near-tasks"))
        left = materialise(left.join(top.select("_q"), "_q", "left_anti"), "open-questions")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _with_ratio(pairs: DataFrame) -> DataFrame:
    """With `ratio`: how much of both keys the matching blocks cover, as Ratcliff and Obershelp count them."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("_key").to_pylist(), batch.column("_theirs").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([SequenceMatcher(None, a or "", b or "").ratio() for a, b in both], pa.float64())], [*batch.schema.names, "ratio"])

    return pairs.mapInArrow(run, f"{shape}, ratio double")
