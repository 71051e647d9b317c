"""Operator 4: mixing sources to target weights by Pareto order sampling.

A source with weight w gets w * total characters of the mixture. A document of the source is due m copies in
expectation, in proportion to its length to the power ``length_power``: floor(m) whole copies are certain, and the
fractions are the inclusion odds of a sample of fixed size. Pareto sampling (Rosen 1997) ranks the documents of a
source by u / (1 - u) over p / (1 - p), u being uniform and p the fraction, and takes the least, as many as the
fractions sum to, rounded.

A source may be half the corpus, so its rows are never brought together: the n-th least rank of each source is found
by counting ranks in bins, then by sorting the one bin in which it falls, and a last pass compares each row with it. Only
counts, and the rows of that bin without their texts, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import fresh, scratch_path, stored, table

#: Exponent of a source's share of characters that gives its default weight.
TEMPERATURE = 0.5
LENGTH_POWER = 0.5
SEED = "mix-1"
#: Bins a source's ranks are counted in; a rank is binned by the order of magnitude of its square root.
BINS = 65_536


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the first 13 hexadecimal digits of an MD5 hash, of which every system makes the same.

    Rows without an id are told apart by their texts.
    """
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name).cast("binary")), 1, 13), 16, 10).cast("double")
    return (digits + 0.5) / F.lit(float(2**52))


def _size(docs: DataFrame, column: str) -> Column:
    return F.greatest(F.coalesce(F.col(column).cast("double"), F.lit(1.0)), F.lit(1.0)) if column in docs.columns else F.greatest(F.coalesce(F.length("text").cast("double"), F.lit(1.0)), F.lit(1.0))


def source_targets(docs: DataFrame, weights: dict[str, float] | None = None, total: float = 1.0, size: str = "n_chars", length_power: float = LENGTH_POWER) -> DataFrame:
    """Per source: gw_key, rows, characters, the sum of length powers, and the copies due on average to a unit of that power.

    A null source is one of its own, with the key "".
    """
    x = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("gw_key"), _size(docs, size).alias("gw_size"))
    sources = x.groupBy("gw_key").agg(
        F.count(F.lit(1)).alias("gw_rows"),
        F.sum(F.col("gw_size").cast("decimal(20,0)")).cast("double").alias("gw_chars"),
        F.sum(F.floor(F.pow("gw_size", F.lit(length_power)) * 1024).cast("decimal(20,0)")).cast("double").alias("gw_power"),
        F.sum(F.floor(F.pow("gw_size", F.lit(length_power)) * 1024).cast("decimal(20,0)") * F.col("gw_size").cast("decimal(18,0)")).cast("double").alias("gw_product"),
    )
    if weights is None:
        weight = F.pow(F.col("gw_chars"), F.lit(TEMPERATURE))
    else:
        weight = F.lit(0.0)
        for k, v in weights.items():
            weight = F.when(F.col("gw_key") == k, F.lit(float(v))).otherwise(weight)
    # one row a source: the sums over all sources are of integers, so that they are the same in any order
    wide = sources.withColumn("gw_weight", F.floor(weight * 1024).cast("decimal(30,0)"))
    sums = wide.agg(F.sum("gw_weight").cast("double").alias("gw_all"), F.sum(F.col("gw_chars").cast("decimal(30,0)")).cast("double").alias("gw_total"))
    rate = F.col("gw_total") * F.lit(float(total)) * (F.col("gw_weight").cast("double") / F.col("gw_all")) / F.col("gw_product")
    return wide.crossJoin(sums).select("gw_key", F.coalesce(rate, F.lit(0.0)).alias("gw_rate"))


def _with_odds(docs: DataFrame, targets: DataFrame, size: str, length_power: float, seed: str) -> DataFrame:
    due = F.floor(F.pow(_size(docs, size), F.lit(length_power)) * 1024).cast("double")
    # texts are read for this only where an id is missing
    text = F.lit(None).cast("string") if docs.where("doc_id is null").isEmpty() else F.col("text")
    keyed = docs.withColumns({"gw_key": F.coalesce(F.col("source").cast("string"), F.lit("")), "gw_due": due, "gw_u": uniform(F.col("doc_id"), text, seed)})
    rated = keyed.join(targets, "gw_key").withColumn("gw_m", F.col("gw_due") * F.col("gw_rate"))
    rated = rated.withColumn("gw_sure", F.floor("gw_m")).withColumn("gw_p", F.col("gw_m") - F.col("gw_sure"))
    rank = (F.col("gw_u") / (1 - F.col("gw_u"))) / (F.col("gw_p") / (1 - F.col("gw_p")))
    rated = rated.withColumn("gw_q", F.when(F.col("gw_p") > 0, rank))
    # the order of the bins is that of the ranks, which is all that matters; the bins only have to be many
    half = F.sqrt("gw_q")
    return rated.withColumn("gw_bin", F.floor(half / (1 + half) * BINS))


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, total: float = 1.0, size: str = "n_chars", length_power: float = LENGTH_POWER, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, whole, each with ``copies``.

    ``weights`` gives the sources' shares of the mixture's characters (in any unit; a source that isn't named gets
    none); by default a share is in proportion to the square root of the source's own. The mixture has ``total`` times
    the characters of the corpus in expectation. ``size`` names the column of a document's length in characters (where
    there is none, the text is measured); null, zero and negative lengths count as 1, and very long texts are due copies
    by their length like any other. A null source is a source of its own, and so is an empty one with it. u depends on
    doc_id, or where that is null on the text, and on the seed alone; documents of equal rank are taken by doc_id, and
    rows that agree in this too are interchangeable: as many as are due are taken. Null and empty texts are rows like
    others. An empty table gives an empty result. An existing column ``copies`` is replaced; other columns are carried
    along, whatever their names.
    """
    needed = ("doc_id", "source", "text", size)
    # inside, all columns but those that are read have names that nothing here can clash with
    inner = {c: c if c in needed else f"column_{i}" for i, c in enumerate(docs.columns) if c.lower() != "copies"}
    taken = _taken(docs.select([F.col(f"`{c}`").alias(n) for c, n in inner.items()]), weights, total, size, length_power, seed)
    return taken.select(*[F.col(n).alias(c) for c, n in inner.items()], F.col("gw_copies").cast("long").alias("copies"))


def _taken(docs: DataFrame, weights: dict[str, float] | None, total: float, size: str, length_power: float, seed: str) -> DataFrame:
    targets = stored(source_targets(docs, weights, total, size, length_power))
    rated = _with_odds(docs, targets, size, length_power, seed).withColumn("gw_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)))
    narrow = rated.select("gw_key", "gw_q", "gw_bin", "gw_p", "gw_id").where("gw_p > 0")
    counted = narrow.groupBy("gw_key", "gw_bin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("gw_p") * 2**40).cast("decimal(20,0)")).alias("p"))
    by_source = W.partitionBy("gw_key")
    upto = counted.withColumns({"before": F.sum("n").over(by_source.orderBy("gw_bin").rowsBetween(W.unboundedPreceding, -1)), "want": F.round((F.sum("p").over(by_source) / 2**40).cast("double")).cast("long")})
    before = F.coalesce("before", F.lit(0))
    cut = stored(upto.where((before < F.col("want")) & (before + F.col("n") >= F.col("want"))).select("gw_key", F.col("gw_bin").alias("gw_cut"), (F.col("want") - before).alias("gw_left")))
    # the bin in which the last one falls, its rows of equal rank counted before they meet: its last rank, and how many of the rows at just that rank are taken
    inside = narrow.join(cut, (narrow.gw_key == cut.gw_key) & (narrow.gw_bin == cut.gw_cut)).groupBy(narrow.gw_key, "gw_q", "gw_id").agg(F.count(F.lit(1)).alias("gw_same"), F.first("gw_left").alias("gw_left"))
    inside = inside.withColumn("gw_upto", F.sum("gw_same").over(W.partitionBy("gw_key").orderBy("gw_q", "gw_id")))
    first = F.col("gw_upto") - F.col("gw_same")
    last = inside.where((first < F.col("gw_left")) & (F.col("gw_upto") >= F.col("gw_left")))
    last = stored(last.select(F.col("gw_key").alias("gw_k"), F.col("gw_q").alias("gw_last"), F.col("gw_id").alias("gw_last_id"), (F.col("gw_left") - first).alias("gw_take"), "gw_same"))
    placed = rated.join(last, F.col("gw_key") == F.col("gw_k"), "left")
    below = (F.col("gw_q") < F.col("gw_last")) | ((F.col("gw_q") == F.col("gw_last")) & (F.col("gw_id") < F.col("gw_last_id")))
    level = (F.col("gw_q") == F.col("gw_last")) & (F.col("gw_id") == F.col("gw_last_id"))
    due = F.coalesce(below | (level & (F.col("gw_take") == F.col("gw_same"))), F.lit(False))
    split = F.coalesce(level & (F.col("gw_take") < F.col("gw_same")), F.lit(False))
    if last.where("gw_take < gw_same").isEmpty():
        out = placed.withColumn("gw_copies", F.col("gw_sure") + due.cast("long"))
    else:
        whole = placed.where(~split).withColumn("gw_copies", F.col("gw_sure") + due.cast("long"))
        out = whole.unionByName(_some_of(placed.where(split)))
    return out.where("gw_copies > 0")


def _some_of(level: DataFrame) -> DataFrame:
    """Of each source's interchangeable rows, gw_take get a copy more: by their places in the files that they are written to, however many there are."""
    path = scratch_path(level.sparkSession)
    # a file for each source and task, so that a row's place in its file is its place among the source's rows there
    level.withColumn("gw_part", F.col("gw_key")).write.partitionBy("gw_part").parquet(path)
    rows = level.sparkSession.read.schema(level.schema).parquet(path).withColumns({"gw_file": F.col("_metadata.file_path"), "gw_at": F.col("_metadata.row_index")})
    sizes = rows.groupBy("gw_key", "gw_file").agg(F.count(F.lit(1)).alias("gw_rows"))
    before = F.coalesce(F.sum("gw_rows").over(W.partitionBy("gw_key").orderBy("gw_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = stored(sizes.select("gw_file", before.alias("gw_start")))
    extra = (F.col("gw_start") + F.col("gw_at") < F.col("gw_take")).cast("long")
    return rows.join(starts, "gw_file").withColumn("gw_copies", F.col("gw_sure") + extra).select(*level.columns, "gw_copies")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, total: float = 1.0, size: str = "n_chars", seed: str = SEED) -> DataFrame:
    """The mixture as rows of ``docs``, with all of their columns: a row stands there as often as it has copies. See ``mixture``."""
    own = [c for c in docs.columns if c.lower() == "copies"]
    held = fresh(docs, "gw_copies_held")
    mixed = mixture(docs.withColumnRenamed(own[0], held) if own else docs, weights, total, size, seed=seed)
    repeated = mixed.withColumn(fresh(mixed, "gw_copy"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select([F.col(held).alias(c) if c in own else F.col(f"`{c}`") for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_chars", "copies")


_POWER = f"CAST(floor(pow(size, {LENGTH_POWER}) * 1024) AS DOUBLE)"
OP4_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, n_chars, coalesce(source, '') AS k, greatest(coalesce(CAST(n_chars AS DOUBLE), 1.0), 1.0) AS size,
         (CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null' || md5(coalesce(text, '')))), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / CAST({2**52} AS DOUBLE) AS u
  FROM documents),
sources AS (
  SELECT k, CAST(sum(CAST(size AS HUGEINT)) AS DOUBLE) AS chars, CAST(sum(CAST({_POWER} AS HUGEINT) * CAST(size AS HUGEINT)) AS DOUBLE) AS product FROM sized GROUP BY k),
weighed AS (SELECT *, CAST(floor(pow(chars, {TEMPERATURE}) * 1024) AS DOUBLE) AS weight FROM sources),
rates AS (
  SELECT k, (SELECT CAST(sum(CAST(chars AS HUGEINT)) AS DOUBLE) FROM sources) * CAST(1.0 AS DOUBLE)
            * (weight / (SELECT CAST(sum(CAST(weight AS HUGEINT)) AS DOUBLE) FROM weighed)) / product AS rate FROM weighed),
due AS (SELECT s.*, {_POWER} * rate AS m FROM sized s JOIN rates USING (k)),
parts AS (SELECT *, floor(m) AS sure, m - floor(m) AS p FROM due),
ranked AS (
  SELECT *, CASE WHEN p > 0 THEN row_number() OVER (PARTITION BY k, p > 0 ORDER BY (u / (1 - u)) / (p / (1 - p)), doc_id NULLS LAST) END AS r,
         round(CAST(sum(CAST(round(p * {2**40}) AS HUGEINT)) OVER (PARTITION BY k) AS DOUBLE) / {2**40}) AS want
  FROM parts)
SELECT doc_id, source, n_chars, CAST(sure AS BIGINT) + CASE WHEN r <= want THEN 1 ELSE 0 END AS copies
FROM ranked WHERE sure + CASE WHEN r <= want THEN 1 ELSE 0 END > 0
"""
