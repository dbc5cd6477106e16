"""The pipeline on a small fixture, against each stage done plainly."""

import corpus_pipeline
from stforecast.llm.lang_id import Classifier, train
from stforecast.llm.mixing import document_levels, mix_plan, with_domain, words
from stforecast.llm.shared import written
from test_near_dedup import brute
from test_tokens import check_pieces


def stages(spark, docs):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], "")))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_every_stage(spark, sf):
    from stforecast.llm.shared import table

    docs = table(spark, sf, "documents")
    start, known, exact, near, mix, packed = stages(spark, docs)
    for df in (known, exact, near, mix):
        assert df.schema == start.schema
    books = train(docs)
    work = Classifier(books)
    want = {d: t for d, t in texts(docs).items() if not work.decide(t)[3]}
    assert texts(known) == want

    first = {}
    for d in sorted(want):
        norm = want[d].encode().lower()  # bytes lower A-Z only
        first.setdefault(norm, d)
    want = {d: want[d] for d in first.values()}
    assert texts(exact) == want

    parts = brute(sorted(want.items()), width=5, percent=80)
    want = {d: want[d] for d, (_, root) in parts.items() if d == root}
    assert texts(near) == want

    kept = texts(mix)
    assert set(kept) < set(want)
    plan = mix_plan(with_domain(near), document_levels(), 80, 1, 17, words(near["text"])).collect()
    total, took = sum(r.tokens for r in plan), sum(len((t or "").split()) for t in kept.values())
    assert sum(r.budget for r in plan) <= total * 80 // 100 and took <= total * 80 // 100
    assert took >= 0.6 * total

    rows = [(r.doc_id, r.text) for r in mix.collect()]
    ids = {d: 0 for d, _ in rows}
    for r in packed.collect():
        ids[r.doc_id] += r.length
    assert set(ids) == {r.doc_id for r in packed.collect()} and all(n > 0 for n in ids.values())


def test_run_on_odd_rows(spark, clashing, tmp_path):
    clashing.where("doc_id IS NULL OR doc_id NOT IN (5, 6)").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {None, 1, 2, 7, 8, 10, 12} and len(out) > 0
    assert check_pieces is not None


def test_run_on_an_empty_table(spark, odd, tmp_path):
    odd.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
