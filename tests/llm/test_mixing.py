import hashlib

from pyspark.sql import functions as F

from stforecast.llm.mixing import budgets, drop_to_mix, mixed


def spread(children, budget):
    """Shares of (capacity, weight) children, one after the other by capacity per weight."""
    out = {k: 0 for k, (c, w) in children.items() if w <= 0}
    open_ = {k: v for k, v in children.items() if v[1] > 0}
    left = budget
    for k in sorted(open_, key=lambda k: (open_[k][0] / open_[k][1], str(k))):
        pull = sum(w for n, (_, w) in open_.items() if n not in out)
        if open_[k][0] * pull > left * open_[k][1]:
            break
        out[k] = open_[k][0]
        left -= out[k]
    rest = {k: w for k, (_, w) in open_.items() if k not in out}
    return out | {k: w * left // sum(rest.values()) for k, w in rest.items()}


def levels():
    return [("d", F.when(F.col("d") == "a", 3).otherwise(1)), ("s", F.when(F.col("s") == "x", 2).otherwise(1))]


def test_a_shortage_is_made_up_by_siblings_first(spark):
    rows = [("a", "x", 10), ("a", "y", 1000), ("b", "x", 500), ("b", "z", 500), (None, "x", 40), (None, None, 2)]
    leaves = spark.createDataFrame(rows, "d string, s string, capacity long")
    for budget in (0, 7, 100, 400, 1500, 1e9):
        got = {(r.d, r.s): int(r.budget) for r in budgets(leaves, levels(), int(budget)).collect()}
        tops = {d: (sum(c for x, _, c in rows if x == d), 3 if d == "a" else 1) for d in ("a", "b", None)}
        want = {}
        for d, share in spread(tops, int(budget)).items():
            below = {s: (c, 2 if s == "x" else 1) for x, s, c in rows if x == d}
            want |= {(d, s): n for s, n in spread(below, share).items()}
        assert got == want
    assert got == {(d, s): c for d, s, c in rows}
    # leaf (a, x) is short of its share: (a, y) takes all of what is missing, domain b none of it
    got = {(r.d, r.s): int(r.budget) for r in budgets(leaves, levels(), 400).collect()}
    assert got["a", "x"] == 10 and got["a", "x"] + got["a", "y"] >= 3 * (got["b", "x"] + got["b", "z"])


def test_prefixes_of_seeded_epochs(spark):
    rows = [(i, "w " * (i % 7), "a" if i % 3 else "b", "x") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d string, s string").repartition(3)
    out = mixed(docs, levels(), percent=150, epochs=4, seed=5).collect()
    for d, weight, other in (("a", 3, 1), ("b", 1, 3)):
        size = {i: i % 7 for i, _, x, _ in rows if x == d}
        t, total = sum(size.values()), sum(i % 7 for i, *_ in rows)
        caps = {"a": (4 * sum(i % 7 for i, _, x, _ in rows if x == "a"), 3), "b": (4 * sum(i % 7 for i, _, x, _ in rows if x == "b"), 1)}
        share = spread(caps, total * 150 // 100)[d]
        whole, rest = divmod(share, t)
        order = sorted(size, key=lambda i: hashlib.md5(f"5:{whole}:{i}".encode()).hexdigest())
        run, last = 0, []
        for i in order:
            run += size[i]
            if run > rest:
                break
            last.append(i)
        want = sorted([(i, e) for i in size for e in range(whole)] + ([(i, whole) for i in last] if rest else []))
        assert sorted((r.doc_id, r.epoch) for r in out if r.d == d) == want


def test_one_epoch_keeps_rows_and_columns(clashing):
    by = [("lang", F.lit(1)), ("source", F.lit(1))]
    everything = drop_to_mix(clashing, by, percent=100, seed=1)
    assert everything.columns == clashing.columns
    # a leaf without tokens has nothing to give; all others are whole
    rest = {r.doc_id for r in clashing.collect()} - {r.doc_id for r in everything.collect()}
    assert rest == set()
    half = drop_to_mix(clashing, by, percent=50, seed=1)
    assert 0 < half.count() < clashing.count()
    assert [sorted(map(str, half.collect()))] == [sorted(map(str, drop_to_mix(clashing, by, percent=50, seed=1).collect()))]


def test_empty_table_and_zero_weights(odd):
    by = [("lang", F.lit(1)), ("source", F.lit(0))]
    assert mixed(odd.where("false"), by).count() == 0
    assert mixed(odd, by).count() == 0
