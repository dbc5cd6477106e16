import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stforecast.llm import fill_middle
from stforecast.llm.fill_middle import fill_in_middle, restore

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, percent=50, spm=80, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows(df):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in df.collect()), key=key)


def expected(df, **how):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((brute(r.doc_id, r.text, **how) for r in df.select("doc_id", "text").collect()), key=key)


@pytest.mark.parametrize("how", [{}, {"percent": 100}, {"percent": 100, "spm_percent": 0, "seed": 7}, {"percent": 0}])
def test_equals_plain_slicing_and_comes_back(clashing, how, monkeypatch):
    monkeypatch.setattr(fill_middle, "PIECE_BYTES", 1000)
    filled = fill_in_middle(clashing.withColumn("restored", F.lit(1)), **how)
    names = {"spm_percent": "spm"}
    assert rows(filled) == expected(clashing, **{names.get(k, k): v for k, v in how.items()})
    back = sorted(r.restored for r in restore(filled).collect())
    assert back == sorted(r.text or "" for r in clashing.select("text").collect())


def test_texts_that_hold_marks_or_parts_of_them(docs_of):
    texts = ["a <P> b", "<S>", "<M", "<", "a < P> <<<", "x <M> y", "M> <S P>", "<P", ">", "P>a <", "é<ö> ü", "\x1c \x85 a b"]
    df = docs_of([(i, t) for i, t in enumerate(texts * 40)])
    filled = fill_in_middle(df, percent=100)
    assert rows(filled) == expected(df, percent=100)
    assert all(r.restored == r.text for r in restore(filled).join(df, "doc_id").collect())


def test_empty_table(docs_of):
    none = docs_of([(1, "a")]).where("false")
    assert restore(fill_in_middle(none)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \t\n\x0b\x0c\r\x1caé<>PSM漢\U0001f600"), max_size=12), min_size=1, max_size=9))
def test_any_batch_round_trips(texts):
    import numpy as np
    import pyarrow as pa

    raw, at = fill_middle.buffers(pa.array(["skipped", *texts]).slice(1))
    ids = list(range(len(texts)))
    n, form, cut, stop = fill_middle.cut_points(raw, at, fill_middle.draws(42, ids), 100, 80)
    out, to = fill_middle.scattered(raw, at, form, cut, stop)
    want = [brute(i, t, percent=100) for i, t in enumerate(texts)]
    assert fill_middle.strings(out, to).to_pylist() == [w[-1] for w in want]
    assert n.tolist() == [w[1] for w in want]
    again, starts = fill_middle.gathered(out, to, form)
    assert fill_middle.strings(again, starts).to_pylist() == texts
    assert np.array_equal(starts, at)
