import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stforecast.llm import ngram_model as nm
from stforecast.llm.quality_rules import base_counts, quality_rules, repeated_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_symbols(text):
    low = [c.lower() if len(c.lower()) == 1 and ord(c) < 1 << 16 else c for c in text]
    low = ["0" if "0" <= c <= "9" else " " if c in " \t\n\x0b\x0c\r" else c for c in low]
    low = [chr(0xD800 + ord(c) % 2048) if ord(c) >= 1 << 16 else c for c in low]
    keep = [c for i, c in enumerate(low) if i == 0 or c != low[i - 1] or c.isalnum() or 0xD800 <= ord(c) < 0xE000]
    return "".join(keep)


class Brute:
    """Interpolated modified Kneser-Ney on dictionaries, for one language."""

    def __init__(self, texts):
        each = [Counter(s[i : i + 4] for i in range(len(s) - 3)) for s in map(plain_symbols, texts)]
        total, most = Counter(), Counter()
        for one in each:
            total += one
            most |= one
        self.c = {4: +(total - most)}
        for k in (3, 2, 1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.d, self.total, self.taken = {}, defaultdict(int), defaultdict(float)
        for k, table in self.c.items():
            n = [sum(c == m for c in table.values()) for m in range(5)]
            if all(n[1:]):
                y = n[1] / (n[1] + 2 * n[2])
                d = [max(0.01, min(m, m - (m + 1) * y * n[m + 1] / n[m])) for m in (1, 2, 3)]
            else:
                d = [0.5, 1.0, 1.5]
            self.d[k] = d
            for g, c in table.items():
                self.total[k, g[:-1]] += c
                self.taken[k, g[:-1]] += d[min(c, 3) - 1]

    def p(self, g):
        k = len(g)
        if not self.c[4]:
            return math.nan
        if k == 0:
            return 1 / (len(self.c[1]) + 1)
        context = k, g[:-1]
        if context not in self.total:
            return self.p(g[1:])
        c = self.c[k].get(g, 0)
        own = c - self.d[k][min(c, 3) - 1] if c else 0
        return own / self.total[context] + self.taken[context] / self.total[context] * self.p(g[1:])

    def loss(self, text):
        s = plain_symbols(text)
        parts = [-math.log(self.p(s[i : i + 4])) for i in range(len(s) - 3)]
        return sum(parts) / len(parts) if parts and self.c[4] else None


def plain_base(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t\x0b\x1c\x85é#|<漢"), max_size=60))
def test_base_counts(text):
    assert base_counts(text) == plain_base(text)


def test_repeated_words_of_a_long_text():
    draw = np.random.default_rng(0)
    words = [b"w%d" % k for k in draw.integers(0, 60, 30_000)] + [b"x%d" % k for k in range(5000)]
    assert repeated_words(words) == plain_base(b" ".join(words).decode())[4]


def test_hash_equals_that_of_the_tables(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 200)
    df = spark.createDataFrame([(int(k),) for k in keys], "k long").select("k", F.xxhash64("k").alias("h"))
    assert {r.k: r.h for r in df.collect()} == dict(zip(keys.tolist(), nm.spark_hash(keys).tolist(), strict=True))


@pytest.mark.parametrize("shard_rows", [1 << 18, 64])
def test_model_equals_dictionaries(spark, clashing, monkeypatch, shard_rows):
    monkeypatch.setattr(nm, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(nm, "CACHE_BYTES", 4000)
    texts = [r.text or "" for r in clashing.where("lang = 'en'").collect()]
    brute = Brute(texts)
    rows = clashing.where("lang = 'en'").select(F.xxhash64("lang").alias("lg"), "text")
    model = nm.fit(rows)
    assert (model.shards > 1) == (shard_rows == 64)
    arrays = nm.Arrays(model)
    lg = rows.first().lg
    for text in [*texts[:4], "Alpha Zeta \U0001f600 quux!!! beta", "ß漢漢漢", "abc", LONG]:
        raw = np.frombuffer(text.encode(), np.uint8)
        keys, _ = nm.grams(*nm.symbols(raw, np.array([0, len(raw)])))
        got = -arrays.log_probabilities(lg, keys)
        want = brute.loss(text)
        assert (want is None) == (len(got) == 0)
        if want is not None:
            assert got.mean() == pytest.approx(want, rel=1e-9)
    # the probabilities of all symbols after a context, and of an unknown one, sum to one
    context = plain_symbols("alp")
    assert sum(brute.p(context + c) for c in brute.c[1]) + brute.p(context + "\U000fffff") == pytest.approx(1)


LONG = "Alpha beta gamma. " * 3000


def expected(rows, width=12.0, least=0.15):
    rows = [(r.doc_id, r.lang, r.text or "") for r in rows]
    out, loss = [], {}
    for lang in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == lang]
        brute = Brute([t for *_, t in own])
        for _, _, t in own:
            loss[lang, t] = brute.loss(t)
    failed = {t: (b := plain_base(t))[0] < 50 or 100 * b[4] > 50 * b[0] for *_, t in rows}

    def median(values):
        bins = sorted(math.floor(v * 1000) for v in values)
        return (bins[(len(bins) + 1) // 2 - 1] + 0.5) / 1000 if bins else None

    for doc_id, lang, t in rows:
        fine = [loss[lang, x] for _, g, x in rows if g == lang and not failed[x] and loss[lang, x] is not None]
        kept = not failed[t]
        if kept and fine:
            middle = median(fine)
            half = max(width * median([abs(v - middle) for v in fine]), least)
            kept = loss[lang, t] is None or middle - half <= loss[lang, t] <= middle + half
        out.append((doc_id, *plain_base(t), failed[t], kept))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_odd_rows_equal_brute_force(clashing):
    got = quality_rules(clashing.withColumn("lg", F.lit("x")).withColumn("low", F.lit("x"))).select(*COLUMNS)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(clashing.select("doc_id", "lang", "text").collect())


def test_text_of_another_kind_is_rejected_in_its_language_only(docs_of):
    draw = np.random.default_rng(2)

    def prose(parts):
        return " ".join("".join(draw.choice(parts, 3)) for _ in range(90))

    one, two = ["an", "the", "or", "in", "es"], ["kö", "müß", "xyl", "zuk", "qua"]
    rows = [(i, prose(one), "one", "s", 0) for i in range(60)] + [(100 + i, prose(two), "two", "s", 0) for i in range(60)]
    rows += [(200, prose(two), "one", "s", 0), (201, prose(one), "two", "s", 0)]
    rows += [(202, " ".join(w + "#$%"[i % 3] * 3 for i, w in enumerate(prose(one).split())), "one", "s", 0)]
    got = {r.doc_id: r.kept for r in quality_rules(docs_of(rows)).collect()}
    assert {k for k, kept in got.items() if not kept} == {200, 201, 202}
    df = docs_of(rows)
    again = sorted((tuple(r) for r in quality_rules(df).select(*COLUMNS).collect()), key=str)
    assert again == expected(df.select("doc_id", "lang", "text").collect())


def test_empty_table(docs_of):
    assert quality_rules(docs_of([(1, "a")]).where("false")).collect() == []
