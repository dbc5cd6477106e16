from pyspark.sql import functions as F

from stforecast.llm import exact_dedup
from stforecast.llm.exact_dedup import drop_exact, exact_groups
from stforecast.llm.shared import ascii_lower


def groups_of(rows, keep):
    pick = {"smallest": min, "largest": max}[keep]
    texts = {}
    for doc, text in rows:
        norm = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        texts.setdefault(norm, []).append(doc)
    return texts, {norm: pick([d for d in ids if d is not None], default=None) for norm, ids in texts.items()}


def test_odd_rows_and_clashing_columns(clashing):
    rows = [(r.doc_id, r.text) for r in clashing.collect()]
    for keep in ("smallest", "largest"):
        texts, stay = groups_of(rows, keep)
        got = sorted(tuple(r)[:4] for r in exact_groups(clashing, keep).collect() if r.doc_id is not None)
        want = sorted(
            (d, stay[n], len(ids), d == stay[n]) for n, ids in texts.items() for d in ids if d is not None
        )
        assert got == want
    nobody = exact_groups(clashing).where("doc_id IS NULL").collect()
    assert len(nobody) == 1 and nobody[0].kept and nobody[0].group_size == 1


def test_rows_that_stay_keep_their_columns(clashing):
    out = drop_exact(clashing)
    assert out.columns == clashing.columns
    texts, stay = groups_of([(r.doc_id, r.text) for r in clashing.collect()], "smallest")
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, stay.values()))


def test_equal_hashes_of_different_texts_are_told_apart(docs_of, monkeypatch):
    """With a hash of one value for all, bytes alone decide."""
    real = F.md5
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: real(F.lit("one")) if c is not None else real(c))
    docs = docs_of([(1, "a"), (2, "A"), (3, "b"), (4, None), (5, ""), (6, "b"), (7, "c")])
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_groups(docs).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 2), 6: (3, 2), 4: (4, 2), 5: (4, 2), 7: (7, 1)}


def test_empty_table(docs_of, spark):
    none = docs_of([(1, "a")]).where("false")
    assert exact_groups(none).count() == 0 and drop_exact(none).count() == 0


def test_only_ascii_is_lowered(docs_of):
    got = docs_of([(1, "ÄbC İ"), (2, None), (3, "ABC Z[")]).select("doc_id", ascii_lower(F.col("text")).alias("t"))
    assert {r.doc_id: r.t for r in got.collect()} == {1: "Äbc İ", 2: "", 3: "abc z["}
