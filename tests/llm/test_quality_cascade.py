"""The cascade of quality rules: order, laziness and edges."""

import pytest

from tidemark.llm import quality_rules as q


def rows(*told):
    return [(frozenset(out), {"rows": 1, "chars": 100, "words": 20, "lines": 2}) for out in told]


def test_next_is_what_rejects_most_for_its_cost_among_those_left():
    named = {r.name: r for r in q.RULES}
    a, b, c = named["capitals"], named["symbols"], named["repeated_windows"]
    # repeated_windows rejects all that symbols rejects and one more, but costs more; after symbols it has one left.
    sample = rows({b.name, c.name}, {b.name, c.name}, {c.name}, {a.name}, {a.name}, set())
    order = q.cascade(sample, (c, a, b))
    assert [r.name for r in order][-1] == "repeated_windows"
    # With its measures at hand for every document it is as cheap as any, and rejects most.
    assert q.cascade(sample, (c, a, b), ("n_repeat_words", "n_words", "n_symbols"))[0] is c
    assert {r.name for r in q.cascade([], q.RULES)} == {r.name for r in q.RULES}
    assert [r.name for r in q.cascade(sample)] == [r.name for r in q.cascade(sample[::-1], q.RULES[::-1])]


def test_measures_of_rejected_documents_are_not_made(spark):
    broken = q.Rule("broken", ("broken",), lambda m: m("broken") > 0)
    q.MEASURES["broken"] = q.Measure(lambda m: q.F.raise_error(q.F.lit("made")).cast("int"), ("text",), 1e9)
    try:
        df = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
        few = q.Rule("few_words", ("n_words",), lambda m: m("n_words") < 10)
        known = {"text"}
        first = q.with_measures(df.withColumnRenamed("text", "_text"), few.needs, known).withColumn("_open", ~few.rejects(q.look))
        told = q.with_measures(first, broken.needs, known, q.F.col("_open"))
        assert [r["_broken"] for r in told.collect()] == [None, None]
        with pytest.raises(Exception, match="made"):
            told.withColumn("_open", q.F.lit(True)).select(q.F.when(q.F.col("_open"), q.MEASURES["broken"].make(q.look))).collect()
    finally:
        del q.MEASURES["broken"]


def test_lazy_and_full_results_agree_and_edges_hold(spark):
    texts = [None, "", " \n ", "a b", "word " * 30, "One two three four five six seven eight nine ten eleven.", "# $ % " * 20, "LOUD WORDS ARE " * 3 + "HERE AND THERE TODAY", "w" * 100_000]
    df = spark.createDataFrame([(i, t, True, "x") for i, t in enumerate(texts)] + [(5, texts[5], False, "y"), (None, "no id", True, "z")], "doc_id long, text string, kept boolean, _words string")
    full, lazy = q.quality_rules(df), q.quality_rules(df, measures=())
    assert lazy.columns == ["doc_id", "kept", "rejected_by"] and full.columns == ["doc_id", *q.BASE, "base_failed", "kept", "rejected_by"]
    told = lambda d: sorted((-1 if r.doc_id is None else r.doc_id, r.kept) for r in d.collect())
    assert told(full) == told(lazy) and len(told(full)) == len(texts) + 2
    assert q.quality_rules(df.where("false")).count() == 0 and q.quality_rules(df.where("false"), measures=()).count() == 0


def test_sample_is_bounded_and_holds_no_texts(spark):
    df = spark.range(2000).selectExpr("repeat('a b c ', cast(id % 7 AS int)) AS _text")
    sample = q.sampled(df, rows=50)
    assert len(sample) == 50 and all(set(size) == {"rows", "chars", "words", "lines"} for _, size in sample)
