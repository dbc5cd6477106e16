import zlib

import numpy as np
import pytest

from stforecast.llm import sharding
from stforecast.llm.sharding import balanced, difference, shard_documents


def test_differencing_beats_its_parts():
    sizes = [8, 7, 6, 5, 4]
    parts = difference([(np.array([n, 0], np.int64), [[n], []]) for n in sizes], 2)
    assert sorted(sum(parts, [])) == sorted(sizes) and abs(sum(parts[0]) - sum(parts[1])) == 2
    draw = np.random.default_rng(1)
    sizes = draw.integers(1, 10_000, 500).tolist()
    parts = difference([(np.array([n, 0, 0, 0], np.int64), [[n], [], [], []]) for n in sizes], 4)
    sums = [sum(p) for p in parts]
    assert sorted(sum(parts, [])) == sorted(sizes) and max(sums) - min(sums) < 20


@pytest.mark.parametrize(("chunk", "top", "direct"), [(2000, 400, 8000), (40, 400, 100), (10, 20, 100)])
def test_groups_are_placed_once_and_evenly(spark, monkeypatch, chunk, top, direct):
    for name, value in (("CHUNK", chunk), ("TOP", top), ("DIRECT", direct), ("FAN", 3)):
        monkeypatch.setattr(sharding, name, value)
    draw = np.random.default_rng(2)
    rows = [(bytes([i % 256, i // 256]), int(n)) for i, n in enumerate(draw.integers(10, 3000, 900))] + [(b"big", 300_000)]
    groups = spark.createDataFrame(rows, "key binary, bytes long")
    got = {bytes(r.key): r.shard for r in balanced(groups, 4).collect()}
    assert len(got) == len(rows)
    sums = [sum(n for k, n in rows if got[k] == s) for s in range(4)]
    assert max(sums) - min(sums) < 0.03 * sum(sums) / 4


def test_odd_rows_and_clashing_columns(clashing):
    rows = clashing.collect()
    got = shard_documents(clashing, shards=5).collect()
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got) == sorted(
        str((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()))) for r in rows)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    places = {}
    for r in got:
        places.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in places.values())
    for s in range(5):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_empty_table(odd):
    assert shard_documents(odd.where("false")).count() == 0


def test_the_query_balances(spark):
    from stforecast.llm import QUERIES

    got = QUERIES["op2_sharding"](spark, "/root/testdata/sf0.01").toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 24 and sums.max() - sums.min() <= 100
    assert got.groupby("shard")["slot"].apply(lambda s: sorted(s) == list(range(len(s)))).all()
