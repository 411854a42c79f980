"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Tables of rates of up to so many steps in all (8 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_STEPS = 1_000_000
#: Up to this rate a source's distribution function is a table; beyond, it is summed for each document, which makes as many copies anyway.
LONG_RATE = 1_000


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the seed and the parts; the same on every run and engine."""
    return F.conv(F.substr(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), F.lit(1), F.lit(13)), 16, 10).cast("double") / F.lit(float(1 << 52))


def _poisson(rate: Column, zero: Column, keep, finish) -> Column:
    """Runs over the distribution function of Poisson(rate) at 0, 1, 2, ... until it is 1 for any practical u. The sum so far and ln k! go along, so nothing underflows; ``keep`` folds each value into what ``finish`` gives back."""
    top = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(zero.alias("out"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("log"))

    def step(s: Column, k: Column) -> Column:
        log = s["log"] + F.when(k == 0, 0.0).otherwise(F.ln(F.greatest(k, F.lit(1)).cast("double")))
        total = s["sum"] + F.exp(k * F.ln(rate) - rate - log)
        return F.struct(keep(s["out"], total).alias("out"), total.alias("sum"), log.alias("log"))

    return F.aggregate(F.sequence(F.lit(0), top), start, step, lambda s: finish(s["out"]))


def poisson_steps(rate: Column) -> Column:
    """The distribution function at 0, 1, 2, ... as an array; null for rates over ``LONG_RATE``, whose array would be long."""
    steps = _poisson(rate, F.array().cast("array<double>"), F.array_append, lambda x: x)
    return F.when(rate <= 0, F.array(F.lit(2.0))).when(rate <= LONG_RATE, steps)


def poisson_count(rate: Column, u: Column) -> Column:
    """The least count whose distribution function is over u, in work that is linear in the rate."""
    return F.when(rate <= 0, 0).otherwise(_poisson(rate, F.lit(0), lambda n, total: n + (total <= u).cast("int"), lambda n: n))


def source_rates(documents: DataFrame, weights: Mapping[str, float] | None, *, source_col: str, text_col: str, temperature: float, budget: float) -> DataFrame:
    """(source, rate, steps): the mean number of copies that brings each source to its share of ``budget`` times the text there is."""
    sizes = cut(documents.groupBy(F.col(source_col).alias("source")).agg(F.coalesce(F.sum(F.char_length(text_col).cast("double")), F.lit(0.0)).alias("size")))
    if weights is None:
        share = F.when(F.col("size") > 0, F.pow("size", F.lit(float(temperature)))).otherwise(0.0)
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)) & (F.col("size") > 0), float(weight)).otherwise(share)
    shares = sizes.withColumn("share", share)
    total, norm = shares.agg(F.sum("size"), F.sum("share")).first()
    wanted = (total or 0.0) * budget / norm if norm else 0.0
    rate = F.when(F.col("size") > 0, F.col("share") * wanted / F.col("size")).otherwise(0.0)
    return cut(shares.select("source", rate.alias("rate")).withColumn("steps", poisson_steps(F.col("rate"))))


def mix_sources(documents: DataFrame, weights: Mapping[str, float] | None = None, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", temperature: float = 0.5, budget: float = 1.0, seed: int = 17) -> DataFrame:
    """The rows of ``documents``, each as often as its Poisson count says, in a random global order, with ``copy_no`` and ``shuffle_key``.

    A source's rate is its target share of the text (code points) over its present share, times ``budget``; the count of
    a document inverts Poisson(rate) at a uniform number hashed from ``seed`` and its id. ``weights`` maps sources to
    shares (any scale; a source left out gets none); without it shares follow size ** ``temperature``.
    Copies are dealt to partitions by the hash ``shuffle_key`` and ordered by it within each: a global shuffle in one exchange.

    An empty table gives an empty mixture. Null sources are a source of their own (key None). Null text has no size. Rows that repeat an id get the same count;
    a null id hashes as an empty one. A source without any text has rate 0. Input columns named like the two added ones are replaced.
    """
    rates = source_rates(documents, weights, source_col=source_col, text_col=text_col, temperature=temperature, budget=budget).toDF("of", "rate", "steps")
    if (rates.agg(F.sum(F.coalesce(F.size("steps"), F.lit(0)) + 16)).first()[0] or 0) <= BROADCAST_STEPS:
        rates = F.broadcast(rates)
    own = documents.drop("copy_no", "shuffle_key")
    name = F.coalesce(own[id_col].cast("string"), F.lit(""))
    packed = own.select(F.struct(*(own[c] for c in own.columns)).alias("row"), own[source_col].alias("source"), name.alias("name"))  # so that no input column meets one of ours
    counted = packed.join(rates, F.col("source").eqNullSafe(F.col("of"))).withColumn("u", uniform(seed, F.col("name")))
    copies = F.when(F.col("steps").isNotNull(), F.size(F.filter("steps", lambda c: c <= F.col("u")))).otherwise(poisson_count(F.col("rate"), F.col("u")))
    dealt = counted.withColumn("n", copies).where("n > 0").select("row", "name", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("copy_no"))
    key = F.substr(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("name"), F.col("copy_no").cast("string"))), F.lit(1), F.lit(16))
    return dealt.select("row.*", "copy_no", key.alias("shuffle_key")).repartition("shuffle_key").sortWithinPartitions("shuffle_key", id_col)
