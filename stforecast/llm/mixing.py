"""Mixing sources to target weights: budgets down a tree, then a seeded token prefix per leaf."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stforecast.llm.shared import columns_of, query, table, written

Levels = list[tuple[str, Column]]
WIDE = "decimal(38,0)"
BUCKET_ROWS = 256  # documents of a bucket of the seeded order, on average
WORDS = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Tokens of a text when they are counted without a tokenizer: runs of non-space. Null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _same(names: list[str]) -> Column:
    """Null-safe equality of a node's path in tables ``l`` and ``r``."""
    return reduce(and_, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in names], F.lit(True))


def filled(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share ``budget`` among the children of each parent by ``weight``, none above ``capacity``.

    What a child cannot take goes to its siblings in proportion to their weights. In order of
    capacity per weight, the children up to some place take their capacity and the rest share
    what is left. All arithmetic is on integers; shares are rounded down.
    """
    nodes = nodes.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0).cast(WIDE))
    nodes = nodes.withColumn("weight", F.greatest("weight", F.lit(0)).cast(WIDE))
    ratio = F.when(F.col("weight") > 0, F.col("capacity").cast("double") / F.col("weight").cast("double"))
    order = Window.partitionBy(*parent).orderBy(ratio.asc_nulls_last(), F.col(name).asc_nulls_first())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    nodes = nodes.withColumns({
        "taken": F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast(WIDE),
        "pull": F.sum("weight").over(after).cast(WIDE),
    })
    full = (F.col("taken") * F.col("weight") + F.col("capacity") * F.col("pull")).cast(WIDE) <= (
        F.col("budget") * F.col("weight")).cast(WIDE)
    nodes = nodes.withColumn("full", full | (F.col("weight") == 0))
    whole = Window.partitionBy(*parent)
    nodes = nodes.withColumns({
        "left": (F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(whole)).cast(WIDE),
        "pull": F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole).cast(WIDE),
    })
    share = F.expr("CAST((weight * left) DIV pull AS DECIMAL(38,0))")
    return nodes.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(share).cast(WIDE))


def budgets(leaves: DataFrame, levels: Levels, budget: int) -> DataFrame:
    """Budget of every leaf. ``leaves``: the level columns, tokens and capacity. A node's capacity
    is that of its leaves, so a shortage is made up by siblings first, and by the siblings of an
    ancestor only when all below it are full."""
    names = [name for name, _ in levels]
    above = leaves.limit(0).select().agg(F.lit(budget).cast(WIDE).alias("budget"))
    for depth, (name, weight) in enumerate(levels):
        path, parent = names[: depth + 1], names[:depth]
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight.cast("long"))
        if parent:
            nodes = nodes.alias("l").join(above.alias("r"), _same(parent)).select("l.*", "r.budget")
        else:
            nodes = nodes.withColumn("budget", F.lit(budget).cast(WIDE))
        above = filled(nodes, parent, name).select(*path, "budget")
    return leaves.alias("l").join(above.alias("r"), _same(names)).select("l.*", "r.budget")


def mix_plan(docs: DataFrame, levels: Levels, percent: int, epochs: int, seed: int, tokens: Column) -> DataFrame:
    """Per leaf: tokens, budget, whole epochs, and up to which place of the seeded order the last,
    partial epoch goes (``cut``, null for none)."""
    names = [name for name, _ in levels]
    size = written(docs.select("doc_id", *names, tokens.alias("n_tokens")))
    leaves = written(size.groupBy(*names).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")))
    count, total = leaves.agg(F.sum("docs"), F.sum("tokens")).first()
    budget = (total or 0) * percent // 100
    plan = written(budgets(leaves.withColumn("capacity", F.col("tokens") * epochs), levels, budget).select(
        *names, "tokens", F.col("budget").cast("long").alias("budget"),
        F.when(F.col("tokens") > 0, F.expr("CAST(budget AS BIGINT) DIV tokens")).otherwise(0).alias("whole"),
    ))
    rest = F.col("budget") - F.col("whole") * F.col("tokens")
    buckets = max(1, min(1 << 20, (count or 0) // BUCKET_ROWS))
    placed = size.alias("l").join(plan.alias("r"), _same(names)).where(rest > 0).select(
        "l.*", rest.alias("rest"), place("doc_id", "whole", seed).alias("place"))
    placed = placed.withColumn("bucket", F.floor(
        F.conv(F.substring("place", 1, 6), 16, 10).cast("long") * buckets / F.lit(1 << 24)).cast("int"))
    sums = placed.groupBy(*names, "bucket").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    upto = F.sum("t").over(Window.partitionBy(*names).orderBy("bucket"))
    # the one bucket of a leaf in which its rest ends
    edge = sums.withColumn("upto", upto).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("t") <= F.col("rest")))
    edge = written(edge.select(*names, "bucket", (F.col("upto") - F.col("t")).alias("before")))
    inside = placed.alias("l").join(edge.alias("r"), _same([*names, "bucket"])).select("l.*", "r.before")
    # rows of one place (a repeated id) come or go together
    run = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*names).orderBy("place"))
    within = inside.withColumn("upto", run).where("upto <= rest").groupBy(*names).agg(F.max("place").alias("in_edge"))
    cut = edge.alias("l").join(within.alias("r"), _same(names), "left").select(
        *[f"l.{c}" for c in names], F.coalesce(F.col("in_edge"), F.lpad(
            F.lower(F.hex(F.ceil(F.col("l.bucket").cast("long") * F.lit(1 << 24) / buckets))), 6, "0")).alias("cut"))
    return written(plan.alias("l").join(cut.alias("r"), _same(names), "left").select("l.*", "r.cut"))


def place(doc_id: str, epoch: str, seed: int) -> Column:
    """Place of a document in the seeded order of an epoch."""
    known = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(epoch).cast("string"), known))


def mixed(
    docs: DataFrame, levels: Levels, percent: int = 100, epochs: int = 1, seed: int = 0, tokens: Column | None = None
) -> DataFrame:
    """The rows of ``docs`` that a mix takes, with ``epoch``: as often as they are taken.
    A column of that name gives way.

    ``docs`` needs doc_id, text and the level columns from the root down; each level has an
    integer weight (a column of its path), null or below 1 for nothing. The budget is ``percent``
    of all tokens (``tokens``, words of the text by default), and no leaf is taken more than
    ``epochs`` times. A leaf with budget b and t tokens gives b div t whole epochs and from one
    more the longest prefix, in that epoch's seeded order, of at most b mod t tokens. Null level
    values are nodes of their own; a null text has no tokens; a null id has a place like any
    other, and rows with one id share theirs. Rounding leaves less than a token a node unused.

    Only sizes are shuffled. Plans have a row per leaf; prefixes are found by sums over buckets
    of the order and then inside one bucket of each leaf, so no leaf is sorted.
    """
    names = [name for name, _ in levels]
    plan = mix_plan(docs, levels, percent, epochs, seed, words(F.col("text")) if tokens is None else tokens)
    plan = plan.select(*names, F.col("whole").alias("__whole"), F.col("cut").alias("__cut"))
    rows = docs.alias("l").join(plan.alias("r"), _same(names)).select("l.*", "__whole", "__cut")
    last = F.col("__cut").isNotNull() & (place("doc_id", "__whole", seed) <= F.col("__cut"))
    taken = F.sequence(F.lit(0), (F.col("__whole") + last.cast("long")).cast("int") - 1)
    rows = rows.where((F.col("__whole") > 0) | last)
    return rows.select(*[f"`{c}`" for c in docs.columns if c != "epoch"], F.explode(taken).alias("epoch"))


def drop_to_mix(docs: DataFrame, levels: Levels, **options) -> DataFrame:
    """The rows of ``docs`` that a mix of one epoch takes, with their own columns only."""
    own = docs.withColumnsRenamed({"epoch": "__epoch"})
    return columns_of(docs, mixed(own, levels, epochs=1, **options).drop("epoch").withColumnsRenamed({"__epoch": "epoch"}))


def document_levels() -> Levels:
    """Domain, language and source of ``documents``: larger domains of sources weigh more."""
    number = F.regexp_extract("source", "[0-9]+", 0).try_cast("int")
    languages = F.when(F.col("lang") == "en", 5).when(F.col("lang").isin("de", "fr"), 2).otherwise(1)
    return [("domain", 4 - F.col("domain")), ("lang", languages), ("source", 1 + F.coalesce(number, F.lit(0)) % 3)]


def with_domain(docs: DataFrame) -> DataFrame:
    """Domains 0 to 3 by the number in the name of the source."""
    number = F.regexp_extract("source", "[0-9]+", 0).try_cast("int")
    return docs.withColumn("domain", F.coalesce(number, F.lit(0)) % 4)


def _sql_level(path: str, parent: str, weight: str, source: str) -> str:
    """One level of ``filled`` in SQL."""
    over = f"PARTITION BY {parent}" if parent else ""
    on = " AND ".join(f"n.{c} IS NOT DISTINCT FROM p.{c}" for c in parent.split(", ")) if parent else "true"
    last = path.split(", ")[-1]
    return f"""
      SELECT {path}, CASE WHEN sat THEN capacity ELSE (weight * rest) // pull END AS budget FROM (
        SELECT *, budget - coalesce(sum(capacity) FILTER (sat) OVER ({over}), 0) AS rest,
               sum(weight) FILTER (NOT sat) OVER ({over}) AS pull FROM (
          SELECT *, taken * weight + capacity * later <= budget * weight AS sat FROM (
            SELECT *, coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
                   sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later
            FROM (SELECT n.*, ({weight})::HUGEINT AS weight, p.budget FROM (
                    SELECT {path}, sum(capacity)::HUGEINT AS capacity FROM leaves GROUP BY {path}) n
                  JOIN {source} p ON {on})
            WINDOW w AS ({over} ORDER BY capacity::DOUBLE / weight::DOUBLE, {last}))))"""


LANGUAGE = "CASE WHEN n.lang = 'en' THEN 5 WHEN n.lang IN ('de', 'fr') THEN 2 ELSE 1 END"
NUMBER = "coalesce(TRY_CAST(regexp_extract({0}source, '[0-9]+') AS INTEGER), 0)"
SQL = f"""
WITH sized AS (
  SELECT doc_id, {NUMBER.format('')} % 4 AS domain, lang, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens) AS tokens, 3 * sum(n_tokens) AS capacity FROM sized GROUP BY ALL
), root AS (SELECT (sum(tokens) * 120 // 100)::HUGEINT AS budget FROM leaves
), one AS ({_sql_level('domain', '', '4 - n.domain', 'root')}
), two AS ({_sql_level('domain, lang', 'domain', LANGUAGE, 'one')}
), three AS ({_sql_level('domain, lang, source', 'domain, lang', f"1 + {NUMBER.format('n.')} % 3", 'two')}
), plan AS (
  SELECT l.*, t.budget // l.tokens AS whole, t.budget % l.tokens AS rest FROM leaves l JOIN three t
  ON l.domain = t.domain AND l.lang IS NOT DISTINCT FROM t.lang AND l.source IS NOT DISTINCT FROM t.source
), placed AS (
  SELECT s.*, p.whole, p.rest, sum(s.n_tokens) OVER (PARTITION BY s.domain, s.lang, s.source
         ORDER BY md5('17:' || p.whole::VARCHAR || ':' || s.doc_id::VARCHAR)) AS upto
  FROM sized s JOIN plan p ON s.domain = p.domain
    AND s.lang IS NOT DISTINCT FROM p.lang AND s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, e::INTEGER AS epoch, domain, lang, source, n_tokens::BIGINT AS n_tokens FROM (
  SELECT *, unnest(range(whole::BIGINT + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS e FROM placed)
"""


@query("op3_mixing", SQL)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(table(spark, sf_dir, "documents"))
    taken = mixed(docs, document_levels(), percent=120, epochs=3, seed=17)
    return taken.select("doc_id", F.col("epoch").cast("int").alias("epoch"), "domain", "lang", "source",
                        words(F.col("text")).alias("n_tokens"))
