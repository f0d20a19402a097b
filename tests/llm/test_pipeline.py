"""The pipeline against a brute-force run of its stages, and the registered queries."""

import collections

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from loomcast.llm import _shared, decontaminate, queries, secrets  # noqa: E402

from .test_operators import brute_classes, brute_quality  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = _shared.table(spark, SF, "documents")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    (_, quality), (_, near), (_, clean), (_, redact), (_, pack) = corpus_pipeline.STAGES
    one, _ = _shared.materialize(quality(spark, docs, SF), "t")
    assert one.columns == columns
    ids = {r.doc_id for r in one.collect()}
    assert not any(brute_quality(rows[i].text)[5] for i in ids) and len(ids) > 0.5 * len(rows)
    two, _ = _shared.materialize(near(spark, one, SF), "t")
    kept = {r.doc_id for r in two.collect()}
    assert two.columns == columns and kept == {c for _, c in brute_classes([(i, rows[i].text) for i in sorted(ids)])}
    three, _ = _shared.materialize(clean(spark, two, SF), "t")
    items = [(str(r.item_id), r.text) for r in _shared.table(spark, SF, "benchmark").collect()]
    automaton = decontaminate.build([(p, n, i) for i, t in items for p, n in decontaminate.windows_of(t, 10)])
    assert {r.doc_id for r in three.collect()} == {i for i in kept if not decontaminate.scan(rows[i].text, automaton)[1]}
    four, _ = _shared.materialize(redact(spark, three, SF), "t")
    assert four.columns == columns and four.count() == three.count()
    assert not any(secrets.base_spans(r.text) or r.n_chars != len(r.text) for r in four.collect())
    five = pack(spark, four, SF)
    total = collections.Counter()
    for p in five.collect():
        total[(p.doc_id, p.doc_tokens)] += p.length
    assert all(n == t for (_, t), n in total.items()) and {i for i, _ in total} == {r.doc_id for r in four.collect()}


def test_every_query_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(names)


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns[0] == "doc_id" and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("rows", [[], "odd"])
def test_stages_on_odd_tables(spark, rows):
    """Nulls in any column, repeated rows, a very long text, extra and clashing columns; and no rows at all."""
    text = " ".join(f"word{k} and other{k % 17}" for k in range(60))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, start string, kept string, row string"
    if rows:
        rows = [(1, text, "en", "s", 5, "a", "b", "c"), (1, text, "en", "s", 5, "a", "b", "c"), (2, None, None, None, None, None, None, None), (None, text + " more", None, "s", None, "a", "b", "c"),
                (3, "", "en", "s", 0, "a", "b", "c"), (4, " ".join(f"long{k}" for k in range(40_000)), "en", "s", 1, "a", "b", "c")]
    docs = spark.createDataFrame(rows, schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out, _ = _shared.materialize(stage(spark, docs, SF), f"odd{k}")
        assert out.columns == docs.columns
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == ({r.doc_id for r in docs.collect()} if rows else set())
    if rows:
        assert 4 in {p.doc_id for p in pieces} and not {2, 3} & {p.doc_id for p in pieces}
