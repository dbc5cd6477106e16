import random

import pyarrow as pa
from pyspark.sql import functions as F

from stforecast.llm.components import components, extended
from stforecast.llm.near_dedup import drop_near, least_overlap, near_components, shingle_sets


def sets_of(rows, width):
    out = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        n = min(width, len(words))
        out[doc] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
    return out


def brute(rows, width=5, percent=80):
    sets = sets_of(rows, width)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def varied(draw):
    """Chains of edited copies, groups of copies, texts that share a passage, short texts."""
    word = lambda: f"w{draw.randint(0, 3000)}"
    texts = []
    passage = [word() for _ in range(120)]
    for _ in range(40):
        texts.append([word() for _ in range(draw.randint(1, 400))])
    for _ in range(8):
        text = [word() for _ in range(draw.randint(20, 500))]
        for _ in range(12):
            texts.append(list(text))
            for _ in range(draw.randint(0, max(1, len(text) // 40))):
                text[draw.randrange(len(text))] = word()
    for _ in range(30):
        texts.append([word() for _ in range(draw.randint(5, 60))] + passage)
    texts += [["a", "b"], ["A", "B"], ["a"], [], ["a", "b", "c", "d"]]
    draw.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_components_equal_brute_force(docs_of):
    rows = varied(random.Random(3))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_components(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_odd_rows_and_clashing_columns(clashing):
    rows = clashing.collect()
    out = near_components(clashing, width=4).collect()
    assert len(out) == len(rows)
    want = brute([(r.doc_id, r.text) for r in rows if r.doc_id is not None], width=4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == want
    nobody = [r for r in out if r.doc_id is None]
    assert len(nobody) == 1 and nobody[0].component_id is None and nobody[0].kept
    stay = drop_near(clashing, width=4)
    assert stay.columns == clashing.columns
    kept = {d for d, (_, c) in want.items() if d == c}
    assert {r.doc_id for r in stay.select("doc_id").collect()} == kept | {None}


def test_empty_table(odd):
    assert near_components(odd.where("false")).count() == 0


def test_shingle_sets_do_not_depend_on_slices():
    texts = pa.array(["Some Words of A text here", None, "", " \t", "some words", "ÉTÉ été ab cd", "some words of a text here"])
    whole = [s.tolist() for s in shingle_sets(texts, 4)]
    assert whole[0] == whole[6] and len(whole[0]) == 3 and whole[1] == whole[2] == whole[3] == [] and len(whole[4]) == 1
    for at in range(len(texts)):
        assert [s.tolist() for s in shingle_sets(texts.slice(at), 4)] == whole[at:]


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 140)]
    links = spark.createDataFrame(path[::-1] + star + [(200, 200)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}
    assert components(links.where(F.lit(False))).count() == 0


def test_the_bound_on_common_values():
    assert 20 <= least_overlap(64, 80) <= 30 and least_overlap(64, 100) == 64


def test_repeated_and_null_ids_keep_the_links_of_their_texts(docs_of):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "of its own"), (None, "x " + a), (None, b + " end more"),
            (5, "c " * 3), (None, "nobody else has this text"), (4, "of its own")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_components(docs_of(rows)).collect()), key=str)
    both = [(None, None, True), (None, None, True), (None, None, True), (1, None, False), (1, None, False), (2, None, False),
            (3, None, False), (4, 4, True), (4, 4, True), (5, 5, True)]
    assert [(d, c, k) for d, _, c, k in got] == sorted(both, key=str)
    named = [r for r in rows if r[0] is not None]
    got = {(r.doc_id, r.component_id) for r in near_components(docs_of(named)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}
    stay = sorted((r.text for r in drop_near(docs_of(named)).collect()))
    assert stay == sorted([a, b, "of its own", "of its own", "c " * 3])
    stay = sorted(r.text for r in drop_near(docs_of([(None, a), (None, a + " more"), (None, b), (None, None)])).collect() if r.text)
    assert len(stay) == 2 and b in stay and stay[0][:5] == "a0 a1"


def test_components_go_on_from_components(spark):
    draw = random.Random(5)
    pairs = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)]
    links = spark.createDataFrame(pairs, "a long, b long")
    first, later = (spark.createDataFrame(part, "a long, b long") for part in (pairs[:15], pairs[15:]))
    got = {(r.node, r.component) for r in extended(components(first), later).collect()}
    assert got == {(r.node, r.component) for r in components(links).collect()}
    none = links.where(F.lit(False))
    assert extended(components(links), none).count() == len(got)


def test_edited_copies_meet_their_hub(spark, monkeypatch):
    """Copies edited in places of their own are linked with few others, and not compared with all."""
    from stforecast.llm import near_dedup

    draw = random.Random(4)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for doc in range(400):
        text = list(base)
        for place in draw.sample(range(200), draw.randint(3, 7)):
            text[place] = f"x{doc}_{place}"
        rows.append((doc, " ".join(text)))
    rows[200] = (200, " ".join(base))
    compared = []
    confirm = near_dedup.confirmed

    def counted(pairs, sets, percent):
        compared.append(pairs.count())
        return confirm(pairs, sets, percent)

    monkeypatch.setattr(near_dedup, "confirmed", counted)
    out = near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
    assert got == brute(rows, 4)
    assert sum(compared) <= 6 * len(rows), compared
