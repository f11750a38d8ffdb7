"""Mixing sources to target weights by Poisson replication.

Each source's mean repetition rate is its target share of the output over its rows. A document's
count inverts the Poisson distribution of that mean at a number in 0..1 that is hashed from the seed
and its key, so the draw is the same in every run and on every executor. Counts are exploded and the
copies are shuffled globally by a second hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stratum, whole_rows

SEED = "poisson-1"
#: The registered query and the pipeline give every source a share in proportion to rows ** POWER.
POWER = 0.7
#: Rates are broadcast up to this size, else joined by shuffle.
BROADCAST_BYTES = 16 << 20


def hashed_unit(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the seed and the parts."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def poisson_steps(mean: Column) -> Column:
    """The distribution function at 0, 1, 2, ... until what is left is under double precision.

    A count is the number of steps at or under the drawn number. Logarithms are kept, so large means
    don't underflow.
    """
    most = (mean + 12 * F.sqrt(mean) + 30).cast("int")
    steps = F.aggregate(
        F.sequence(F.lit(1), most),
        F.struct((-mean).alias("log"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("all")),
        lambda a, k: F.struct(
            (a["log"] + F.log(mean) - F.log(k)).alias("log"),
            (a["sum"] + F.exp(a["log"] + F.log(mean) - F.log(k))).alias("sum"),
            F.array_append(a["all"], a["sum"] + F.exp(a["log"] + F.log(mean) - F.log(k))).alias("all"),
        ),
        lambda a: a["all"],
    )
    return F.when(mean > 0, steps).otherwise(F.array(F.lit(1.0)))


def mix_sources(
    rows: DataFrame, source: str = "source", key: str = "doc_id", weights: dict[str, float] | None = None,
    target_rows: int | None = None, seed: str = SEED, shuffle: bool = True,
) -> DataFrame:
    """``rows`` replicated to the target weights, with columns copy (1..), copies, rate and mix_order.

    ``weights``: target share by source, normalised over the sources present; sources it doesn't name
    get none. Without it, shares go with rows ** 0.7. ``target_rows``: expected size of the output,
    else the table's own. A null source is a source of its own ('' names the empty one only), chosen
    by the weight under None. Rows with equal keys get equal counts; a null key draws one number for
    all null keys. Empty tables give empty results. Clashing columns of these names are replaced.
    ``mix_order`` is random and sorts the whole output; each partition is written in that order.
    """
    base = rows.select(whole_rows(rows, "copy", "copies", "rate", "mix_order"), stratum(source).alias("s"), F.col(key).alias("key"))
    sizes = base.groupBy("s").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(POWER))
    else:
        named = [("-" if k is None else "=" + k, float(v)) for k, v in weights.items()]
        share = F.create_map(*(F.lit(x) for kv in named for x in kv)) if named else None
        weight = F.coalesce(F.try_element_at(share, F.col("s")), F.lit(0.0)) if named else F.lit(0.0)
    # one row: sums over the sources
    all_rows, all_weight, sources, longest, most = sizes.agg(
        F.sum("n"), F.sum(weight), F.count("*"), F.max(F.length("s")), F.max(weight / F.col("n"))
    ).first()
    wanted = float(target_rows if target_rows is not None else all_rows or 0)
    # of a rate's row: its name and some 30 steps of the distribution, more of them where sources are repeated often
    top_rate = wanted * (most or 0.0) / (all_weight or 1.0)
    row_bytes = 200 + 4 * (longest or 0) + 8 * (top_rate + 12 * top_rate**0.5 + 30)
    rates = sizes.select(
        "s", (F.lit(wanted) * weight / F.lit(all_weight or 1.0) / F.col("n")).alias("rate")
    ).withColumn("steps", poisson_steps(F.col("rate")))
    # a row for each source: known few are broadcast, so whole texts move only once, in the shuffle at the end
    few = F.broadcast(rates) if sources * row_bytes <= BROADCAST_BYTES else rates
    drawn = base.withColumn("u", hashed_unit(seed, F.col("key"))).join(few, "s")
    counted = drawn.withColumn("copies", F.size(F.filter("steps", lambda x: x <= F.col("u")))).where("copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    order = F.md5(F.concat_ws(":", F.lit(seed + "/order"), F.coalesce(F.col("key").cast("string"), F.lit("-")), "copy"))
    mixed = copies.select("row.*", "rate", "copies", "copy", order.alias("mix_order"))
    if not shuffle:
        return mixed
    # a hash of the random order deals the copies out evenly whatever their source or key
    return mixed.repartition(F.col("mix_order")).sortWithinPartitions("mix_order")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents replicated to the sources' shares. A null source is a source of its own; equal ids get equal counts, null ids one draw; null and empty texts count as rows; an empty table gives an empty result."""
    mixed = mix_sources(documents(spark, sf_dir))
    return mixed.withColumn("rate", F.round("rate", 9))


OP10_SQL = """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT sum(n) FROM sizes)::DOUBLE * pow(n::DOUBLE, 0.7) / (SELECT sum(pow(n::DOUBLE, 0.7)) FROM sizes) / n AS rate FROM sizes),
steps(source, rate, k, lg, c) AS (
  SELECT source, rate, 0, -rate, exp(-rate) FROM rates
  UNION ALL SELECT source, rate, k + 1, lg + ln(rate) - ln(k + 1), c + exp(lg + ln(rate) - ln(k + 1)) FROM steps WHERE k < rate + 12 * sqrt(rate) + 29),
drawn AS (SELECT *, ('0x' || substr(md5('poisson-1:' || coalesce(doc_id::VARCHAR, '-')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) AS copies, any_value(s.rate) AS rate
  FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.c <= d.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS rate, copies::INTEGER AS copies, copy::INTEGER AS copy,
       md5('poisson-1/order:' || coalesce(doc_id::VARCHAR, '-') || ':' || copy) AS mix_order
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted)
"""
