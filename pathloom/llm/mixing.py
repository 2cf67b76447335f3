"""Mixing sources to target weights, with DataFrame functions only.

Per source the words are summed, targets are set, and the repetition rate target / words follows.
Each document is emitted floor(rate) times, and once more if a draw seeded by a hash falls below
the fraction, which is the extra copy's probability for every document; reruns agree. Documents
short beside their source (under 1 / LONG of its words) draw by their ids, each for itself. The
LONG at most that are longer share one draw of their source, systematically: ranked by size, the
r-th gets a copy if a whole number lies between (r - 1) and r fractions beyond the draw, so each
has the same probability still, and a source of few documents comes near its target too.

Sources are ranked and filled to their level by sorts and sums over a table of one row a source; no
document moves, and no task sees all sources.

Defined results: a null text has no words; texts of any length are counted whole; a null source is a source of its own and comes last;
a source without words has target 0 and rate 0; rows that repeat an id share its draw; sources with
equal caps are filled alike; an empty table gives an empty mix. `mix` keeps other columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, apart, picked, restored, settled, small_side

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: Draws are numbers of 52 bits.
BITS = 2**52
#: Documents above a LONG-th of their source's words draw together: LONG a source at most.
LONG = 1000
#: Long documents up to which (some 40 bytes a row) their copies are broadcast.
BROADCAST_LONG = 500_000
#: Sources up to which the table of targets (some 60 bytes a row) is broadcast.
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_column: Column, seed: str = SEED) -> Column:
    """52 bits of an MD5 of the seed and the id, as a whole number."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank, from 0 in the code-point order of the names, null last.

    A sort deals ranges of names to partitions; a row's rank is its place in the partition and
    what the partitions before hold, one count each.
    """
    ordered = settled(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted(tuple(r) for r in ordered.groupBy(part.alias("p")).agg(F.count("*")).collect())
    before, so_far = {}, 0
    for p, n in counts:  # one entry a partition
        before[p] = so_far
        so_far += n
    starts = ordered.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "_p long, _before long")
    at = F.col("_at") - F.shiftleft(part, 33)
    return ordered.join(F.broadcast(starts), part == F.col("_p")).withColumn("rank", F.col("_before") + at).drop("_at", "_p", "_before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """source, source_size, target from (source, source_size).

    share of all sizes is divided by weight (in code-point order of the names, repeating); a
    target above cap times its source's size stops there and the excess is divided among the
    rest. The level of the rest rises from round to round until it stops no further source; each
    round is one sum over the sources.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = settled(ranked(sizes).select("source", "source_size", weight.alias("weight"), (F.lit(float(cap)) * F.col("source_size")).alias("most")))
    total = share * float(s.agg(F.sum("source_size")).first()[0] or 0)
    level, before = -1.0, -1
    while True:
        stopped = F.col("most") / F.col("weight") <= level
        stops, held, left = s.agg(F.count_if(stopped), F.sum(F.when(stopped, F.col("most"))), F.sum(F.when(~stopped, F.col("weight")))).first()
        if stops == before or not left:
            break
        before, level = stops, (total - (held or 0.0)) / left
    return s.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), F.col("most")).alias("target"))


def uniform(id_column: Column, seed: str) -> Column:
    return draw(id_column, seed).cast("double") / F.lit(float(BITS))


def planned(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, share: float = 1.0, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target and copies."""
    sized = docs.withColumn("size", words(F.col("text")))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    plan = targets(sums, weights, cap, share).withColumn("_rate", rate)
    plan = settled(plan.withColumns({"_times": F.floor("_rate"), "_part": F.col("_rate") - F.floor("_rate"), "_start": uniform(F.col("source"), f"{seed}:source")}).drop("_rate")).withColumnRenamed("source", "_source")
    plan = small_side(plan, BROADCAST_SOURCES)
    out = sized.join(plan, F.col("source").eqNullSafe(F.col("_source")), "left")
    long = sized.select("doc_id", "source", "size").join(plan, F.col("source").eqNullSafe(F.col("_source"))).where(F.col("size") * LONG > F.col("source_size"))
    long = long.groupBy("_source", "doc_id", "_start", "_part").agg(F.max("size").alias("size"))
    place = F.row_number().over(Window.partitionBy("_source").orderBy(F.desc("size"), draw(F.col("doc_id"), seed), "doc_id"))
    passed = F.floor(F.col("_start") + place * F.col("_part")) - F.floor(F.col("_start") + (place - 1) * F.col("_part"))
    together = settled(long.select(F.col("_source").alias("_s"), F.col("doc_id").alias("_d"), passed.alias("_together")))
    out = out.join(small_side(together, BROADCAST_LONG), F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    alone = F.when(uniform(F.col("doc_id"), seed) < F.col("_part"), 1).otherwise(0)
    return out.withColumn("copies", (F.col("_times") + F.coalesce("_together", alone)).cast("int")).drop("_source", "_times", "_part", "_start", "_s", "_d", "_together")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as planned, in the columns of docs."""
    p = planned(apart(docs, "doc_id", "text", "source"), **options).where("copies > 0")
    return restored(p.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)


def taken(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, copies."""
    p = planned(picked(docs, "doc_id", "text", "source"), **options)
    return p.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [5.0::DOUBLE, 2.0, 1.0][((ROW_NUMBER() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 3.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, ROW_NUMBER() OVER o AS n,
  ((SUM(source_size) OVER ())::DOUBLE - COALESCE(SUM(most) OVER (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
   / SUM(weight) OVER (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY most / weight, encode(source) NULLS LAST)),
f AS (SELECT level AS final FROM l WHERE level < most / weight ORDER BY n LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN level < most / weight THEN LEAST((SELECT final FROM f) * weight, most) ELSE most END AS target FROM l),
r AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN LEAST(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM t),
x AS (SELECT d.doc_id, d.size, r.source, r.source_size, r.target, FLOOR(rate) AS times, rate - FLOOR(rate) AS part, ('0x' || substr(md5('mix-1:' || COALESCE(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS draw,
    ('0x' || substr(md5('mix-1:source:' || COALESCE(r.source, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS start
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
g AS (SELECT doc_id, source, part, start, draw, MAX(size) AS size FROM x WHERE size * 1000 > source_size GROUP BY ALL),
h AS (SELECT doc_id, source, part, start, ROW_NUMBER() OVER (PARTITION BY source ORDER BY size DESC, draw, doc_id) AS n FROM g),
t2 AS (SELECT doc_id, source, FLOOR(start + n * part) - FLOOR(start + (n - 1) * part) AS together FROM h),
c AS (SELECT x.doc_id, x.size, x.source_size, x.target, (times + COALESCE(together, CASE WHEN draw::DOUBLE / 4503599627370496.0::DOUBLE < part THEN 1 ELSE 0 END))::INT AS copies
  FROM x LEFT JOIN t2 ON t2.doc_id IS NOT DISTINCT FROM x.doc_id AND t2.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""
