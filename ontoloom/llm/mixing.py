"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

DataFrame functions only. Sizes are word counts. Three small tables carry the decisions:
one row per source, one per (source, hash bucket), one per (source, boundary sub-bucket).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ontoloom.llm.common import Saved, documents, word_count

#: Hash buckets per source at each of the two levels.
BUCKETS = 1024


def source_targets(sources: DataFrame, weights: tuple[float, ...], max_epochs: float) -> DataFrame:
    """Water-filling over a table (source, source_size): adds weight and target.

    The level is total size over total weight. Sources whose cap (max_epochs * size) lies below
    weight * level stay at their cap, and what they leave raises the level for the others. In
    order of cap / weight the sources at their cap come first, so one pass of running sums finds the
    level: the first source whose own ratio reaches the level computed from the sources before it.
    The table has a row per source; it is metadata, and the windows over it are not split.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    place = (F.row_number().over(by_name) - 1) % n
    weighted = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
    weighted = weighted.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = weighted.withColumn("level", level)
    final = F.min_by(F.when(F.col("ratio") >= F.col("level"), F.col("level")), F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", -F.col("level")))).over(everything)
    target = F.when(final.isNull() | (F.col("ratio") < final), F.col("cap")).otherwise(F.col("weight") * final)
    return levelled.withColumn("target", target).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: float = 3.0, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken, and the columns in keep.

    docs needs doc_id, text and source; other columns are ignored unless named in keep. Every document gets the
    whole part of target / source_size as copies. The fractional rest is an extra copy for the documents
    that come first in the order of a seeded hash, as long as their running size fits; then twice
    the largest document that still fits what is left. The draw depends on the seed and
    the ids only, so that reruns agree.

    Null text: size 0. Null source: a source of its own, last. Null doc_id: hashed as an empty
    id. Rows with equal (hash, id) are taken or left together. Empty documents have as many copies as
    the rule gives and take nothing. An empty table gives an empty result; a corpus without words has targets of 0.
    """
    spark = docs.sparkSession
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # 40 bits of md5: the first ten are the bucket, the next ten the sub-bucket.
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 10), 16, 10).cast("long")
    sized = Saved(
        docs.select("doc_id", "source", *kept, word_count(F.col("text")).alias("size"), h.alias("h"))
        .withColumn("b1", F.shiftright("h", 30).cast("int"))
        .withColumn("b2", F.shiftright("h", 20).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")),
        "mix-sizes",
    ).df
    buckets = Saved(sized.groupBy("source", "b1").agg(F.sum("size").alias("bucket_size")), "mix-buckets").df
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    whole = F.floor(rate + F.lit(1e-12)).cast("long")
    budget = F.greatest(F.floor(F.col("target") + F.lit(1e-6)) - F.col("whole") * F.col("source_size"), F.lit(0)).cast("long")
    targets = Saved(targets.withColumn("whole", whole).withColumn("budget", budget), "mix-targets").df

    def joined(left: DataFrame, right: DataFrame, *names: str) -> DataFrame:
        """An inner join that also matches null sources."""
        right = right.select(F.col("source").alias("r_source"), *[F.col(x) for x in right.columns if x != "source" and x not in names], *[F.col(x).alias(f"r_{x}") for x in names])
        on = left["source"].eqNullSafe(right["r_source"])
        for x in names:
            on = on & (left[x] == right[f"r_{x}"])
        return left.join(right, on).drop("r_source", *[f"r_{x}" for x in names])

    def boundary(parts: DataFrame, column: str, size: str, budget: str) -> DataFrame:
        """The first part at which the running size exceeds the budget, and what the parts before it leave."""
        order = Window.partitionBy("source").orderBy(column)
        run = parts.withColumn("run", F.sum(size).over(order))
        return run.where(F.col("run") > F.col(budget)).groupBy("source").agg(F.min(column).alias(column), F.min_by(F.col(budget) - F.col("run") + F.col(size), column).alias("left"))

    first = boundary(joined(buckets, targets.select("source", "budget")), "b1", "bucket_size", "budget")
    first = Saved(first.select("source", "b1", F.col("left").alias("left1")), "mix-boundary").df
    inside = joined(sized, first, "b1")
    second = boundary(inside.groupBy("source", "b2").agg(F.sum("size").alias("sub_size"), F.first("left1").alias("left1")), "b2", "sub_size", "left1")
    second = Saved(second.select("source", "b2", F.col("left").alias("left2")), "mix-boundary2").df
    bounds = (
        targets.alias("t")
        .join(first.alias("f"), F.col("t.source").eqNullSafe(F.col("f.source")), "left")
        .join(second.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source")), "left")
        .select("t.*", F.coalesce("f.b1", F.lit(BUCKETS)).alias("end1"), F.coalesce("s.b2", F.lit(BUCKETS)).alias("end2"), "s.left2")
    )
    bounds = Saved(bounds, "mix-bounds").df
    # Only the rows of a boundary sub-bucket, about a millionth of a source, are put in order.
    edge = joined(joined(sized, first.drop("left1"), "b1"), second, "b2")
    edge = edge.withColumn("run", F.sum("size").over(Window.partitionBy("source").orderBy(F.struct("h", "doc_id"))))
    cut = edge.where(F.col("run") <= F.col("left2")).groupBy("source").agg(F.max(F.struct("h", F.coalesce("doc_id", F.lit(-1)).alias("id"))).alias("cut"), F.max("run").alias("got"))
    bounds = (
        bounds.alias("t").join(cut.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left")
        .select("t.*", "c.cut", (F.coalesce("t.left2", F.lit(0)) - F.coalesce("c.got", F.lit(0))).alias("room"))
    )
    bounds = Saved(bounds, "mix-cuts").df
    place = F.struct("h", F.coalesce("doc_id", F.lit(-1)).alias("id"))
    early = (F.col("b1") < F.col("end1")) | ((F.col("b1") == F.col("end1")) & ((F.col("b2") < F.col("end2")) | ((F.col("b2") == F.col("end2")) & F.coalesce(place <= F.col("cut"), F.lit(False)))))
    drawn = joined(sized, bounds).withColumn("place", place).withColumn("extra", F.when(F.col("budget") > 0, early).otherwise(F.lit(False)))

    # What the next document in order is too large for goes to the largest documents that fit, twice.
    fills = []
    for k in (1, 2):
        free = drawn.where(~F.col("extra") & (F.col("size") > 0) & (F.col("size") <= F.col("room")))
        for x in fills:
            free = joined(free.drop("fill_place", "fill_size"), x).where(F.col("fill_place").isNull() | (F.col("place") != F.col("fill_place"))).withColumn("room", F.col("room") - F.col("fill_size")).where(F.col("size") <= F.col("room"))
        together = free.groupBy("source", "place").agg(F.sum("size").alias("fits"), F.max("room").alias("room")).where(F.col("fits") <= F.col("room"))
        best = together.groupBy("source").agg(F.max(F.struct("fits", "place")).alias("best"))
        fill = targets.select("source").alias("t").join(best.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source")), "left")
        fills.append(Saved(fill.select("t.source", F.col("best.place").alias("fill_place"), F.coalesce("best.fits", F.lit(0)).alias("fill_size")), f"mix-fill{k}").df)
    for k, x in enumerate(fills):
        drawn = joined(drawn, x.select("source", F.col("fill_place").alias(f"fill{k}")))
    extra = F.col("extra") | F.coalesce(F.col("place") == F.col("fill0"), F.lit(False)) | F.coalesce(F.col("place") == F.col("fill1"), F.lit(False))
    copies = F.col("whole") + F.when(extra, 1).otherwise(0)
    return drawn.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *["kept"] * bool(keep))


def repeat_by_copies(mixed: DataFrame) -> DataFrame:
    """The mix as documents: the columns kept by mix, each row as many times as it has copies; rows without any go."""
    return mixed.where(F.col("copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("kept.*")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 10) AS BIGINT) AS h
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sources),
levelled AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS ratio FROM weighted),
levels AS (
  SELECT *, ((SELECT CAST(sum(source_size) AS BIGINT) FROM levelled) - coalesce(sum(cap) OVER b, 0.0::DOUBLE)) / ((SELECT sum(weight) FROM levelled) - coalesce(sum(weight) OVER b, 0.0::DOUBLE)) AS level
  FROM levelled WINDOW b AS (ORDER BY ratio, encode(source) ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT level FROM levels WHERE ratio >= level ORDER BY ratio, level DESC LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN (SELECT level FROM final) IS NULL OR ratio < (SELECT level FROM final) THEN cap ELSE weight * (SELECT level FROM final) END AS target FROM levels),
rates AS (SELECT *, CAST(floor(coalesce(target / nullif(source_size, 0), 0) + 1e-12) AS BIGINT) AS whole FROM targets),
budgets AS (SELECT *, greatest(CAST(floor(target + 1e-6) AS BIGINT) - whole * source_size, 0) AS budget FROM rates),
run AS (
  SELECT s.*, b.source_size, b.target, b.whole, b.budget, sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id) AS run
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source),
drawn AS (SELECT *, budget > 0 AND run <= budget AS extra FROM run),
room0 AS (SELECT source, any_value(budget) - coalesce(sum(size) FILTER (WHERE extra), 0) AS room FROM drawn GROUP BY source),
free0 AS (
  SELECT d.source, h, doc_id, sum(size) AS fits, any_value(room) AS room FROM drawn d JOIN room0 r ON d.source IS NOT DISTINCT FROM r.source
  WHERE NOT extra AND size > 0 AND size <= room AND budget > 0 GROUP BY d.source, h, doc_id),
fill0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY fits DESC, h DESC, doc_id DESC) AS k FROM free0 WHERE fits <= room) WHERE k = 1),
free1 AS (
  SELECT d.source, d.h, d.doc_id, sum(size) AS fits, any_value(r.room - f.fits) AS room
  FROM drawn d JOIN room0 r ON d.source IS NOT DISTINCT FROM r.source JOIN fill0 f ON d.source IS NOT DISTINCT FROM f.source
  WHERE NOT extra AND budget > 0 AND size > 0 AND (d.h <> f.h OR d.doc_id <> f.doc_id) AND size <= r.room - f.fits GROUP BY d.source, d.h, d.doc_id),
fill1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY fits DESC, h DESC, doc_id DESC) AS k FROM free1 WHERE fits <= room) WHERE k = 1),
copied AS (
  SELECT d.*, whole + CASE WHEN extra OR EXISTS (SELECT 1 FROM (SELECT source, h, doc_id FROM fill0 UNION ALL SELECT source, h, doc_id FROM fill1) f
    WHERE f.source IS NOT DISTINCT FROM d.source AND f.h = d.h AND f.doc_id IS NOT DISTINCT FROM d.doc_id) THEN 1 ELSE 0 END AS copies
  FROM drawn d)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies, source FROM copied
"""
