"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Each source has a share p of all tokens; its weight is p ** a over the sum of these. The
exponent a is found on a grid of 1 / GRID by bisection, many ways at a time: the largest whose
weights have the wanted entropy, or a larger one where no source may otherwise be repeated
as often as it would have to. A source's part of the budget is spent in whole epochs, and what
is left on the first blocks of one more epoch, in that epoch's own permutation; the block that no
longer fits is dealt out by its smaller blocks. A block's place in the stream is the share of its
source's part that is spent before it, so every stretch of the stream has about the target weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickwell.llm.work import free_name, stored, table

GRID = 16_384
#: Wanted entropy of the weights, as a share of the entropy of equal weights.
ENTROPY = 0.95
#: The most often that a source may be repeated.
REPETITION = 4.0
#: Blocks of a source, and smaller blocks of a block (three hexadecimal digits of a hash each).
BLOCKS = 4096
_BROADCAST_ROWS = 1 << 18
_WAYS = 128


def token_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def _place(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def exponent(sources: DataFrame, budget: int, entropy: float = ENTROPY, repetition: float = REPETITION) -> float:
    """For ``sources`` (source, tokens > 0). The repetition limit wins over the entropy; if even a = 1 breaks it, a is 1."""
    total, n = sources.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not n or n == 1:
        return 1.0
    p = F.col("tokens") / F.lit(total)

    def measured(steps: list[int]) -> dict[int, tuple[float, float]]:
        w = F.pow(p, F.col("k") / F.lit(GRID))
        rows = sources.withColumn("k", F.explode(F.array(*map(F.lit, steps)))).groupBy("k").agg(F.sum(w).alias("z"), F.sum(w * F.log(w)).alias("e"), F.max(w / F.col("tokens")).alias("r")).collect()
        return {r["k"]: (math.log(r["z"]) - r["e"] / r["z"], budget * r["r"] / r["z"]) for r in rows}

    def last(good) -> int:  # noqa: ANN001  the largest step that is good, given that good ones come first and 0 is one
        low, high = 0, GRID + 1
        while high - low > 1:
            steps = sorted({low + (high - low) * i // _WAYS for i in range(1, _WAYS)} - {low})
            got = measured(steps)
            passed = [k for k in steps if good(*got[k])]
            failed = [k for k in steps if not good(*got[k])]
            low, high = max(passed, default=low), min(failed, default=high)
        return low

    by_entropy = last(lambda h, r: h >= entropy * math.log(n))
    if measured([by_entropy])[by_entropy][1] <= repetition:
        return by_entropy / GRID
    too_often = last(lambda h, r: r > repetition)
    return min(GRID, max(by_entropy, too_often + 1)) / GRID


def mix(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, repetition: float = REPETITION, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, as often as they are to be read, with all their columns and a struct ``mix`` of:

    ``copy`` (0 for the first), ``place`` (rows are to be read in its order, from 0 to 1, a block at
    a time; equal places by source), ``source`` and ``tokens``. ``budget``: tokens, by default as many as there are.

    Rows without a source are one source, together with those of an empty name. A source without
    tokens has no weight, and its rows are left out, as are rows that the budget does not reach. Repeated rows
    count each. Rows without an id share one block. Empty table: no rows. A column named ``mix`` of ``docs`` is replaced.
    """
    m = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    own = F.struct(
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), token_count(F.col(text)).alias("tokens"),
        F.conv(F.substring(m, 1, 3), 16, 10).cast("int").alias("block"), F.conv(F.substring(m, 4, 3), 16, 10).cast("int").alias("part"),
    )
    rows = docs.withColumn("mix", own)
    totals = stored(rows.groupBy("mix.source", "mix.block", "mix.part").agg(F.sum("mix.tokens").alias("tokens")), "blocks")
    sources = totals.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    a = exponent(sources, budget, entropy, repetition)

    weight = F.pow(F.col("tokens") / F.lit(max(total, 1)), F.lit(a))
    norm = sources.agg(F.sum(weight)).first()[0] or 1.0
    spent = sources.withColumn("spend", F.floor(weight / F.lit(norm) * F.lit(budget)).cast("long"))
    spent = spent.select("source", "spend", F.col("tokens").alias("size"), F.expr("spend div tokens").cast("int").alias("epochs"), F.expr("spend % tokens").alias("rest"))
    blocks = totals.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")).join(spent, "source").withColumn("copy", F.explode(F.sequence(F.lit(0), "epochs")))
    blocks = blocks.withColumn("key", _place(F.col("source"), F.col("copy").cast("string"), F.col("block").cast("string")))
    blocks = blocks.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source", "copy").orderBy("key", "block").rowsBetween(Window.unboundedPreceding, 0)))
    left = F.when((F.col("copy") == F.col("epochs")) & (F.col("upto") > F.col("rest")), F.col("rest") - F.col("upto") + F.col("tokens"))
    place = (F.col("copy") * F.col("size") + F.col("upto") - F.col("tokens")) / F.col("spend")
    blocks = blocks.where("spend > 0").select("source", "block", "copy", left.alias("left"), place.alias("place")).where("left IS NULL OR left > 0")
    blocks = stored(blocks, "block_plan")

    cut = totals.join(blocks.where("left IS NOT NULL").select("source", "block", "copy", "left"), ["source", "block"])
    cut = cut.withColumn("key", _place(F.col("source"), F.col("copy").cast("string"), F.col("block").cast("string"), F.col("part").cast("string")))
    cut = cut.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("key", "part").rowsBetween(Window.unboundedPreceding, 0)))
    parts = stored(cut.where("upto <= left").select("source", "block", "part", F.lit(True).alias("fits")), "part_plan")

    small = lambda df: F.broadcast(df) if df.count() <= _BROADCAST_ROWS else df
    own_name = free_name(docs, "mix_")
    named = lambda df, name, *keys: df.select(F.struct(*df.columns).alias(own_name + name), *[F.col(k).alias(own_name + k) for k in keys])
    at = {k: F.col(f"mix.{k}") == F.col(own_name + k) for k in ("source", "block", "part")}
    keys = [own_name + k for k in at]
    r = rows.join(named(small(blocks), "plan", "source", "block"), at["source"] & at["block"]).drop(*keys)
    r = r.join(named(small(parts), "fit", "source", "block", "part"), at["source"] & at["block"] & at["part"], "left").drop(*keys)
    r = r.where(F.col(f"{own_name}plan.left").isNull() | F.coalesce(F.col(f"{own_name}fit.fits"), F.lit(False)))
    mix_of = F.struct(F.col(f"{own_name}plan.copy").alias("copy"), F.col(f"{own_name}plan.place").alias("place"), F.col("mix.source").alias("source"), F.col("mix.tokens").alias("tokens"))
    return r.withColumn("mix", mix_of).drop(f"{own_name}plan", f"{own_name}fit")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "mix.source", "mix.copy", "mix.tokens", "mix.place")


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS tokens,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS m FROM documents),
r AS (SELECT doc_id, source, tokens, CAST('0x' || m[1:3] AS INTEGER) AS block, CAST('0x' || m[4:6] AS INTEGER) AS part FROM d),
s AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens FROM r GROUP BY source HAVING sum(tokens) > 0),
t AS (SELECT CAST(sum(tokens) AS BIGINT) AS total, count(*) AS n FROM s),
g AS (SELECT k, pow(s.tokens / t.total, k / {GRID}.0) AS w, s.tokens FROM s, t, range(0, {GRID + 1}) x(k)),
h AS (SELECT k, ln(sum(w)) - sum(w * ln(w)) / sum(w) AS h, max(w / tokens) / sum(w) AS r FROM g GROUP BY k),
e AS (SELECT coalesce(max(k) FILTER (h >= {ENTROPY} * ln(n)), 0) AS k FROM h, t),
o AS (SELECT coalesce(min(k) FILTER (r * total <= {REPETITION}), {GRID}) AS k FROM h, t),
a AS (SELECT CASE WHEN n = 1 THEN 1.0 ELSE greatest(e.k, o.k) / {GRID}.0 END AS a FROM e, o, t),
w AS (SELECT source, tokens, pow(tokens / total, a) AS w FROM s, t, a),
b AS (SELECT source, tokens, CAST(floor(w / (SELECT sum(w) FROM w) * total) AS BIGINT) AS spend FROM w, t),
c AS (SELECT source, tokens AS size, spend, CAST(spend // tokens AS INTEGER) AS epochs, spend % tokens AS rest FROM b WHERE spend > 0),
q AS (SELECT r.source, block, sum(tokens) AS tokens FROM r GROUP BY r.source, block),
u AS (SELECT q.source, block, tokens, size, spend, epochs, rest, unnest(range(0, epochs + 1)) AS copy FROM q JOIN c USING (source)),
v AS (SELECT *, sum(tokens) OVER (PARTITION BY source, copy ORDER BY md5(source || ':' || copy || ':' || block), block ROWS UNBOUNDED PRECEDING) AS upto FROM u),
x AS (SELECT source, block, part, sum(r.tokens) AS tokens, any_value(v.copy) AS copy, any_value(v.rest - v.upto + v.tokens) AS left_over
  FROM r JOIN v USING (source, block) WHERE v.copy = v.epochs AND v.upto > v.rest AND v.upto - v.tokens < v.rest GROUP BY source, block, part),
y AS (SELECT *, sum(tokens) OVER (PARTITION BY source, block ORDER BY md5(source || ':' || copy || ':' || block || ':' || part), part ROWS UNBOUNDED PRECEDING) AS upto FROM x)
SELECT r.doc_id, r.source, CAST(v.copy AS INTEGER) AS copy, r.tokens, CAST(v.copy * v.size + v.upto - v.tokens AS DOUBLE) / CAST(v.spend AS DOUBLE) AS place
FROM r JOIN v USING (source, block) LEFT JOIN y ON y.source = r.source AND y.block = r.block AND y.part = r.part
WHERE v.copy < v.epochs OR v.upto <= v.rest OR (v.upto - v.tokens < v.rest AND coalesce(y.upto <= y.left_over, false))
"""
