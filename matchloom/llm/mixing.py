"""Mixing sources to target weights, with DataFrame functions only.

Targets fill by weight up to a cap of epochs. A source takes as many complete epochs as fit its
target; the rest is drawn without replacement by exponential keys (Efraimidis and Spirakis), scaled
by the quality of the documents, smallest first until the words left are used up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import WORD, materialize

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
GOOD, POOR = 2.0, 0.5
SEED = "mix-1"


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): GOOD or POOR by the best quality label; repeated labels count once."""
    best = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return best.select("doc_id", F.when(F.col("quality") > 0, GOOD).otherwise(POOR).alias("weight"))


def source_weights(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Give the sources, in order of code points with null last, the weights in turn.

    The order number is a count of the rows in earlier ranges plus the place in one's own range, so
    that no task sees all sources.
    """
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = materialize(ranged.withColumn("range", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id() % (1 << 33)), "mix-sources")
    ranges = placed.groupBy("range").agg(F.count("*").alias("n"))
    # One row a range: as many as Spark has partitions, whatever the number of sources.
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select("range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    turn = F.array(*(F.lit(float(w)) for w in weights))
    return placed.join(before, "range").withColumn("w", F.element_at(turn, ((F.col("before") + F.col("place")) % len(weights) + 1).cast("int"))).drop("range", "place", "before")


def targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to (source, source_size, w): min(cap, level * w) with the level that spends
    the sum of all sizes. Each round fixes the sources over their cap and shares what is left."""
    cap = F.col("source_size") * float(max_epochs)
    level = None
    while True:
        over = F.lit(False) if level is None else cap <= F.col("w") * F.lit(level)
        spent, weight, total, n = sources.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0)),
            F.coalesce(F.sum("source_size"), F.lit(0)).cast("double"), F.count_if(over),
        ).first()
        if not weight:
            break
        if level is not None and n == fixed:
            break
        level, fixed = (total - spent) / weight, n
    return sources.withColumn("target", cap if level is None else F.least(cap, F.col("w") * F.lit(level)))


def mix(docs: DataFrame, labels: DataFrame | None = None, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies for every row of ``docs``.

    size: number of words (null texts: 0, texts of any length are counted whole); copies: how often the mix holds the
    document, ``max_epochs`` at most; taken: the words of these copies. A null source is a source of its own; a null doc_id is drawn by its text;
    ``row`` names a further column to keep; equal keys go by doc_id and size, and rows equal in all these are alike. Sources without
    words get nothing. Extra columns are ignored; no rows give no rows.
    """
    carried = [] if row is None else [row]
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    sized = docs.select(*carried, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), name.alias("name"))
    digest = F.md5(F.concat("name", F.lit(f":{seed}")).cast("binary"))
    draw = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    if labels is None:
        sized = sized.withColumn("weight", F.lit(1.0))
    else:
        sized = sized.join(quality_weights(labels), "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    sized = materialize(sized.select(*carried, "doc_id", "source", "size", (-F.log(draw) / F.col("weight")).alias("key"), F.monotonically_increasing_id().alias("nth")), "mix-sizes")
    by_source = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sums")
    plan = targets(source_weights(by_source, weights), max_epochs)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = materialize(plan.select("source", "source_size", "target", "epochs", "left"), "mix-plan")
    # Spark's own ranges of source, key and row cut a source into parts of like size, whatever the weights and however often a
    # key repeats; only the sums of the parts meet.
    order = [F.col("source").asc_nulls_last(), "key", "doc_id", "size", "nth"]
    parts = materialize(sized.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    same = lambda a, b: a.alias("a").join(b.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "inner")
    ranged = same(parts, plan).select("a.*", "source_size", "target", "epochs", "left")
    sums = parts.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "range", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = ranged.withColumn("run", F.sum("size").over(within)).alias("a")
    run = run.join(sums.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.range") == F.col("b.range")))
    # Nearest whole document: it is drawn if its middle lies within the words left.
    drawn = (F.col("ahead") + F.col("run") - F.col("size") / 2 <= F.col("left")).cast("long")
    copies = F.least(F.col("epochs") + drawn, F.lit(max_epochs).cast("long"))
    return run.select(*carried, "doc_id", "a.source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


ORACLE = f"""
WITH sized AS (
  SELECT d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    -ln((CAST('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, md5(coalesce(text, ''))) || ':{SEED}'), 1, 13) AS BIGINT)::DOUBLE + 0.5) / {float(1 << 52)}) / coalesce(weight, 1.0) AS key
  FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN max(quality) > 0 THEN {GOOD} ELSE {POOR} END AS weight FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) q ON d.doc_id = q.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM sized GROUP BY source),
r AS (SELECT *, 3.0 * source_size AS cap, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS k FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent, sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS total FROM r),
l AS (SELECT (total - spent) / rest AS level FROM c WHERE (total - spent) / rest <= cap / w ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(cap, w * coalesce((SELECT level FROM l), 'inf'::DOUBLE)) AS target FROM r),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
run AS (SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS left_words, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS run
  FROM sized d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target, (size * least(epochs + (run - size / 2 <= left_words)::INT, {MAX_EPOCHS}))::BIGINT AS taken, least(epochs + (run - size / 2 <= left_words)::BIGINT, {MAX_EPOCHS}) AS copies FROM run"""
