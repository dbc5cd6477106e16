"""Quality rules: counts on words and lines, and bands of n-gram perplexity for each language."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stforecast.llm.ngram_model import Arrays, Model, by_language, fit, grams, symbols
from stforecast.llm.shared import query, table, written
from stforecast.session import broadcast_within

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STEP = 1000  # bins of one unit of log perplexity, for the medians
SCORED = ("doc_id long, lg long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, n_scored long, log_perplexity double")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    fresh = count()
    ids = np.fromiter((numbers.setdefault(w, next(fresh)) for w in words), np.int64, len(words))
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    if len(words) < 1 << 21:
        window = a << 42 | b << 21 | c
    else:
        _, pair = np.unique(a << 32 | b, return_inverse=True)
        window = pair.astype(np.int64) << 32 | c
    ordered = np.sort(window)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = twice[np.minimum(np.searchsorted(twice, window), len(twice) - 1)] == window
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(window)] |= again
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    words = text.encode().split()  # bytes split at ASCII white space only
    lines, seen, copies = text.split("\n"), set(), 0
    for line in lines:
        if line in seen:
            copies += 1
        elif line.strip(SPACE):
            seen.add(line)
    chars = len(text) - sum(map(text.count, SPACE))
    return len(words), chars, sum(map(text.count, SYMBOLS)), copies, repeated_words(words)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Base counts and log perplexity of whole texts ``(doc_id, lg, text)``; no text leaves its task.

    ``log_perplexity`` is the mean of -log p over all symbols with a full context; null for
    shorter texts and for languages the model does not have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(model)
        for batch in batches:
            for lg, rows, raw, at in by_language(batch, 1, 2):
                n = len(rows)
                keys, text = grams(*symbols(raw, at))
                scored = np.bincount(text, minlength=n)
                lost = np.bincount(text, weights=-arrays.log_probabilities(lg, keys), minlength=n)
                mean = np.divide(lost, scored, out=np.full(n, np.nan), where=scored > 0)
                whole = raw.tobytes()
                edges = at.tolist()
                base = [base_counts(whole[a:b].decode()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                columns = [batch.column(0).take(pa.array(rows)), pa.array(np.full(n, lg))]
                columns += [pa.array(c, pa.int64()) for c in zip(*base, strict=True)]
                columns += [pa.array(scored), pa.array(mean, mask=np.isnan(mean))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCORED.split(", ")])

    return docs.select("doc_id", "lg", "text").mapInArrow(run, SCORED)


def base_failed(min_words: int = 50, repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def _median(values: DataFrame, value: str) -> DataFrame:
    """``(lg, median)`` of non-negative values in bins of 1 / STEP: the middle of the bin of the
    lower median. The windows run over bins, not rows."""
    bins = values.groupBy("lg", F.floor(F.col(value) * STEP).alias("bin")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lg").orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy("lg"))
    half = bins.select("lg", "bin", upto.alias("upto"), total.alias("total")).where("2 * upto >= total")
    return half.groupBy("lg").agg(((F.min("bin") + 0.5) / STEP).alias("median"))


def bands(scored: DataFrame, width: float, least: float) -> DataFrame:
    """``(lg, low, high)``: the median log perplexity of a language's rows plus and minus ``width``
    times the median deviation, but ``least`` at the least."""
    middle = written(_median(scored, "log_perplexity"))
    away = scored.join(broadcast_within(middle, middle.count(), 32), "lg")
    spread = _median(away.select("lg", F.abs(F.col("log_perplexity") - F.col("median")).alias("away")), "away")
    half = F.greatest(width * F.col("deviation"), F.lit(least))
    return middle.join(spread.withColumnRenamed("median", "deviation"), "lg").select(
        "lg", (F.col("median") - half).alias("low"), (F.col("median") + half).alias("high"))


def quality_rules(docs: DataFrame, width: float = 12.0, least: float = 0.15, min_words: int = 50,
                  repeat_percent: int = 50) -> DataFrame:
    """Which documents pass the counting rules and lie in their language's band of perplexity.

    ``docs`` needs doc_id, text and lang; other columns are ignored, whatever their names. A null
    text is empty; rows with a null lang are a language of their own; a null doc_id stays null; rows
    that repeat are documents of their own. An empty table gives no rows.

    All n-grams of all whole texts are counted, but what only one document has does not speak for
    it; bands come from all documents that pass the counting rules. A rejected document has a perplexity far from its language's: too high for text
    of that language, or so low that it repeats what others have. Returns doc_id, the counts,
    base_failed, log_perplexity (null: too short to tell, or alone in its language), low, high, kept.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("lang").alias("lg"), "text")
    model = fit(rows.select("lg", "text"))
    scored = written(score(rows, model).withColumn("base_failed", base_failed(min_words, repeat_percent)))
    limits = written(bands(scored.where("NOT base_failed AND log_perplexity IS NOT NULL"), width, least))
    near = broadcast_within(limits, limits.count(), 48)  # one row a language
    outside = F.coalesce(~F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return scored.join(near, "lg", "left").withColumn("kept", ~F.col("base_failed") & ~outside).drop("lg", "n_scored")


def _sql() -> str:
    counted = ", ".join(f"""
      c{k} AS (SELECT lang, g[2:] AS g, count(*) AS c FROM c{k + 1} GROUP BY ALL)""" for k in (3, 2, 1))
    orders = "\n      UNION ALL ".join(f"SELECT {k} AS ord, lang, g, c FROM c{k}" for k in (1, 2, 3, 4))
    cuts = ", ".join(f"""CASE WHEN n1 > 0 AND n2 > 0 AND n3 > 0 AND n4 > 0
        THEN greatest(0.01, least({k}, {k} - {k + 1} * (n1 / (n1 + 2 * n2)) * n{k + 1} / n{k}))
        ELSE {(0.5, 1.0, 1.5)[k - 1]} END AS d{k}""" for k in (1, 2, 3))
    steps = ", ".join(f"""
      p{k} AS (SELECT e.lang, e.g, (e.c - e.d) / x.total + x.taken / x.total * {below} AS p
        FROM e JOIN x ON x.lang = e.lang AND x.ord = e.ord AND x.context = e.g[:{k - 1}]
        {lower} WHERE e.ord = {k})""" for k, below, lower in (
        (1, "(1 / (x.kinds + 1))", ""), *((k, "l.p", f"JOIN p{k - 1} l ON l.lang = e.lang AND l.g = e.g[2:]") for k in (2, 3, 4))))
    backs = "".join(f"""
        LEFT JOIN p{k - 1} ON p{k - 1}.lang = h.lang AND p{k - 1}.g = h.g[{6 - k}:]
        LEFT JOIN x x{k} ON x{k}.lang = h.lang AND x{k}.ord = {k} AND x{k}.context = h.g[{5 - k}:3]""" for k in (4, 3, 2))
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '<null>') AS lang, coalesce(text, '') AS text FROM documents),
      w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
      win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
      twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
      rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r),
      li AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
      base AS (SELECT d.r, doc_id, lang, text, len(w) AS n_words,
          length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
          length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
          len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
        FROM d JOIN w USING (r) JOIN li USING (r) LEFT JOIN rep USING (r)),
      ch AS (SELECT r, lang, i, s[i] AS x, s[i - 1] AS before FROM (
        SELECT r, lang, s, unnest(range(1, length(s) + 1)) AS i FROM (
          SELECT r, lang, regexp_replace(regexp_replace(lower(text), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]', ' ', 'g') AS s FROM d))),
      g AS (SELECT r, lang, lag(x, 3) OVER o || lag(x, 2) OVER o || lag(x) OVER o || x AS g
        FROM (SELECT * FROM ch WHERE i = 1 OR x <> before OR regexp_full_match(x, '[\p{{L}}\p{{N}}]')) WINDOW o AS (PARTITION BY r ORDER BY i)),
      c4 AS (SELECT lang, g, sum(n) - max(n) AS c FROM (SELECT r, lang, g, count(*) AS n FROM g WHERE g IS NOT NULL GROUP BY ALL)
        GROUP BY ALL HAVING sum(n) > max(n)), {counted},
      a AS ({orders}),
      n AS (SELECT lang, ord, count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c = 3) AS n3,
        count(*) FILTER (c = 4) AS n4 FROM a GROUP BY ALL),
      cut AS (SELECT lang, ord, {cuts} FROM n),
      e AS (SELECT a.*, CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END::DOUBLE AS d FROM a JOIN cut USING (lang, ord)),
      x AS (SELECT lang, ord, g[:ord - 1] AS context, sum(c)::DOUBLE AS total, sum(d) AS taken, count(*) AS kinds FROM e GROUP BY ALL),
      {steps},
      lp AS (SELECT h.lang, h.g, ln(coalesce(p4.p, coalesce(x4.taken / x4.total, 1) * coalesce(p3.p, coalesce(x3.taken / x3.total, 1)
          * coalesce(p2.p, coalesce(x2.taken / x2.total, 1) * coalesce(p1.p, x1.taken / x1.total / (x1.kinds + 1)))))) AS lp
        FROM (SELECT DISTINCT lang, g FROM g WHERE g IS NOT NULL) h LEFT JOIN p4 ON p4.lang = h.lang AND p4.g = h.g {backs}
        LEFT JOIN x x1 ON x1.lang = h.lang AND x1.ord = 1),
      sc AS (SELECT r, avg(-lp) AS l FROM g JOIN lp USING (lang, g) GROUP BY r),
      f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base LEFT JOIN sc USING (r)),
      ok AS (SELECT * FROM f WHERE NOT base_failed AND l IS NOT NULL),
      m AS (SELECT lang, (min(bin) + 0.5) / {STEP} AS m FROM (
        SELECT lang, bin, sum(n) OVER (PARTITION BY lang ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang) AS total
        FROM (SELECT lang, floor(l * {STEP}) AS bin, count(*) AS n FROM ok GROUP BY ALL)) WHERE 2 * upto >= total GROUP BY lang),
      v AS (SELECT lang, m, greatest(12.0 * (min(bin) + 0.5) / {STEP}, 0.15) AS half FROM (
        SELECT lang, m, bin, sum(n) OVER (PARTITION BY lang ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang) AS total
        FROM (SELECT lang, m, floor(abs(l - m) * {STEP}) AS bin, count(*) AS n FROM ok JOIN m USING (lang) GROUP BY ALL))
        WHERE 2 * upto >= total GROUP BY lang, m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND coalesce(l BETWEEN m - half AND m + half, true) AS kept
    FROM f LEFT JOIN v USING (lang)
    """


SQL = _sql()


@query("op12_quality_rules", SQL)
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
