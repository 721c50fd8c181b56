"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. A document is expected e = min(2, rate * level) times in the mix, where its
level makes odds unequal within a source (by default the number of binary digits of its size, so longer documents are
likelier) and the source's rate makes the expected words meet the target. The whole part of e is taken with certainty,
and the rest by Pareto order sampling: documents are ranked by random odds u / (1 - u) divided by inclusion odds
p / (1 - p), and the first in that order are taken until the source's remaining words are reached, the document at the
boundary only if that comes nearer.

Nulls: a null text has size 0 and takes part as an empty document; a null source is a source of its own, the last;
a null id is hashed by its text; a null or negative weight counts as 0. Ties and repeated rows are separate documents
with the same rank. Very long texts are only counted. An empty table gives an empty result. Extra columns: not read,
unless named in ``carry``; no name clashes with the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD_PATTERN, stored

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_COPIES = 2
SEED = "mix-1"
#: Ranks of a source are cut into so many ranges; only the range that holds the boundary is sorted.
RANGES = 1024
#: Weights are rounded to multiples of 1 / STEPS of their power of two, so that a source has a bounded number of levels.
STEPS = 256


def uniform(id_column: Column, text: Column, seed: str = SEED) -> Column:
    """A number strictly between 0 and 1, fixed by the id (null: by the text): 48 bits of its MD5, plus a half."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_column.cast("string"), F.concat(F.lit("text "), text), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """sources (source, source_size) with target: weights share the total, none above most times its size.

    With one row per source: each source gets min(rate * weight, cap) where rate makes the sum right. In the order of
    cap / weight the capped sources come first, so the rate follows from running sums."""
    ordered = sources.withColumn("_at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ordered = ordered.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_at") % len(weights) + 1).cast("int"))).withColumn("_cap", F.col("source_size") * most)
    rank = Window.orderBy((F.col("_cap") / F.col("_weight")).asc(), F.col("_at").asc())
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    ordered = (
        ordered.withColumn("_total", total * share_percent)
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_open", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
        .withColumn("_rate", (F.col("_total") - 100 * F.col("_capped")).cast("double") / (100 * F.col("_open")).cast("double"))
    )
    # The rate of the first source that stays below its cap holds for all later ones.
    rate = F.min(F.when(F.col("_rate") * F.col("_weight") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("_weight")).alias("k"), F.col("_at"), F.col("_rate").alias("r")))).over(everything)
    return ordered.withColumn("_final", rate["r"]).select("source", "source_size", F.when(F.col("_final").isNull() | (F.col("_final") * F.col("_weight") >= F.col("_cap")), F.col("_cap").cast("double")).otherwise(F.col("_final") * F.col("_weight")).alias("target"))


def levels(weight: Column) -> Column:
    """A weight rounded to STEPS steps a power of two; null, negative and not finite: 0."""
    whole = F.pow(F.lit(2.0), F.floor(F.log2(weight)))
    return F.when((weight > 0) & (weight < float("inf")), F.round(weight / whole * STEPS) * whole / STEPS).otherwise(0.0)


def expectations(sums: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """sums (source, target, level, words) with ``expected``, the copies of a document of each level: the least of most and
    rate * level, where the rate makes the words of the source meet its target.

    The highest levels are capped first, so the rate follows from running sums over the levels of a source."""
    w = Window.partitionBy("source").orderBy(F.col("level").desc())
    before, whole = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("source")
    at = (
        sums.withColumn("_product", F.col("words") * F.col("level"))
        .withColumn("_capped", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .withColumn("_open", F.sum("_product").over(whole) - F.coalesce(F.sum("_product").over(before), F.lit(0.0)))
        .withColumn("_rate", (F.col("target") - most * F.col("_capped")) / F.when(F.col("_open") > 0, F.col("_open")))
    )
    first = F.max(F.when(F.col("_rate") * F.col("level") <= most, F.struct("level", "_rate"))).over(whole)["_rate"]
    # Where no rate suffices, all documents that can be taken are capped.
    share = F.when(F.col("level") <= 0, 0.0).when(first.isNull(), float(most)).otherwise(F.least(F.col("_r") * F.col("level"), F.lit(float(most))))
    return at.withColumn("_r", first).withColumn("expected", share).select("source", "target", "level", "expected")


def mix(docs: DataFrame, id_column: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_COPIES, seed: str = SEED, weight_column: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken, *carry) for every row of docs."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    level = levels(F.col(weight_column).cast("double")) if weight_column else F.length(F.bin(size)).cast("double")
    u = uniform(F.col(id_column), F.col("text"), seed)
    sized = stored(docs.select(F.col(id_column).alias("id"), "source", size.alias("size"), level.alias("level"), u.alias("_u"), *[F.col(c).alias(f"c_{c}") for c in carry]), "mix-sizes")
    sums = stored(sized.groupBy("source", "level").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "mix-levels")
    same = F.col("source").eqNullSafe(F.col("_s"))
    plan = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share_percent, most)
    plan = stored(plan.withColumnRenamed("source", "_s"), "mix-targets")  # one row per source
    shares = expectations(sums.join(plan, same).select("source", "target", "level", "words"), most)
    wanted = sums.join(plan, same).drop("_s")
    wanted = wanted.join(shares.select(F.col("source").alias("_s"), F.col("level").alias("_l"), "expected"), same & (F.col("level") == F.col("_l")))
    wanted = stored(wanted.select(F.col("source").alias("_s"), F.col("level").alias("_l"), "source_size", "target", "words", "expected"), "mix-expected")
    odds = lambda p: p / (F.lit(1.0) - p)
    ranked = (
        sized.join(wanted.drop("words"), same & (F.col("level") == F.col("_l")))
        .withColumn("_whole", F.floor("expected").cast("long"))
        .withColumn("_p", F.col("expected") - F.col("_whole"))
        .withColumn("_q", F.when((F.col("_p") > 0) & (F.col("size") > 0), odds(F.col("_u")) / odds(F.col("_p"))))
        .withColumn("_range", F.floor(F.col("_q") / (F.col("_q") + 1) * RANGES).cast("int"))
        .drop("_s", "_l", "expected", "_p")
    )
    ranges = ranked.filter(F.col("_range").isNotNull()).groupBy("source", "_range").agg(F.sum("size").alias("_words"))
    certain = wanted.groupBy("_s", "target").agg(F.sum(F.col("words") * F.floor("expected")).alias("_certain"))
    # Of each source: words still to be drawn after the certain copies, the range of ranks where they run out, and the
    # words before it. One row per source.
    w = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.join(certain, same).withColumn("_rest", F.col("target") - F.col("_certain")).withColumn("_before", F.coalesce(F.sum("_words").over(w), F.lit(0)))
    over = F.when(F.col("_before") + F.col("_words") > F.col("_rest"), F.struct("_range", "_before"))
    left = placed.groupBy("_s", "_rest").agg(F.min(over).alias("_edge")).select("_s", "_rest", F.coalesce("_edge._range", F.lit(RANGES + 1)).alias("_r"), "_edge._before")
    found = ranked.join(stored(left, "mix-edges"), same, "left")
    boundary = F.coalesce(F.col("_range") == F.col("_r"), F.lit(False))
    order = Window.partitionBy("source").orderBy("_q", F.col("id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("_before") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2.0
    plain = found.filter(~boundary).withColumn("_drawn", F.coalesce(F.col("_range") < F.col("_r"), F.lit(False)))
    both = plain.unionByName(found.filter(boundary).withColumn("_drawn", reached <= F.col("_rest")))
    copies = F.col("_whole") + F.col("_drawn").cast("long")
    return both.select("id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *[F.col(f"c_{c}").alias(c) for c in carry])


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: 150% of their words over sources weighing 5, 2, 1, at most two copies each."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


#: The same mix as one ordered window per source.
MIX_SQL = r"""
d as (select doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size from {docs}),
s as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 pos from d group by source),
w as (select *, case pos % 3 when 0 then 5 when 1 then 2 else 1 end weight, source_size * 2 cap, sum(source_size) over () * 150 total from s),
c as (select *, coalesce(sum(cap) over (order by cap / weight, pos rows between unbounded preceding and 1 preceding), 0) capped,
  sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, pos rows between unbounded preceding and 1 preceding), 0) remaining from w),
r as (select *, (total - 100 * capped)::double / (100 * remaining)::double rate from c),
f as (select *, first_value(case when rate * weight <= cap then rate end ignore nulls) over (order by cap / weight, pos rows between unbounded preceding and unbounded following) final from r),
t as (select source, source_size, case when final is null or final * weight >= cap then cap::double else final * weight end target from f),
v as (select doc_id, source, size, length(bin(size))::double as lvl, text from d),
h as (select v.source, lvl, target, sum(size)::bigint words, (sum(size) * lvl)::double prod from v join t on v.source is not distinct from t.source group by v.source, lvl, target),
g as (select *, (target - 2 * coalesce(sum(words) over (w rows between unbounded preceding and 1 preceding), 0))
  / nullif(sum(prod) over (partition by source) - coalesce(sum(prod) over (w rows between unbounded preceding and 1 preceding), 0), 0) rate from h window w as (partition by source order by lvl desc)),
l as (select source, lvl, target, max_by(rate, lvl) filter (where rate * lvl <= 2) over (partition by source) r from g),
e as (select doc_id, v.source, v.size, t.source_size, t.target, text, case when l.r is null then 2.0::double else least(l.r * l.lvl, 2.0::double) end expected
  from v join t on v.source is not distinct from t.source join l on l.source is not distinct from v.source and l.lvl = v.lvl),
p as (select *, floor(expected)::bigint whole, expected - floor(expected) p,
  (('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, 'text ' || text, '')), 1, 12))::bigint::double + 0.5::double) / 281474976710656.0::double u from e),
q as (select *, case when p > 0 and size > 0 then (u / (1.0::double - u)) / (p / (1.0::double - p)) end q, target - sum(size * whole) over (partition by source) rest from p),
k as (select *, q is not null and coalesce(sum(size) filter (where q is not null) over (partition by source order by q nulls last, doc_id, size rows between unbounded preceding and 1 preceding), 0) + size / 2.0::double <= rest drawn from q),
mixed as (select doc_id, source, size, source_size, target, whole + drawn::int copies, (whole + drawn::int) * size taken from k)
"""
OP1_SQL = "with " + MIX_SQL.format(docs="documents") + " select doc_id, size, source_size, target, taken::bigint taken from mixed"
