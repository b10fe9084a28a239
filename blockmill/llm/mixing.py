"""Problem 7: sources mixed to target weights of tokens.

Efraimidis-Spirakis: each document has the key -ln(u) / weight, with u drawn from a hash of its id and the mixture, and the
least keys come first. A source is taken in complete epochs as long as they fit its budget, then in part: in order of
keys until the rest of the budget is reached.

The order is never sorted as a whole. Keys are laid on a fixed grid; the sums of its cells (at most GRID for each source
of a mixture) give the cell in which the budget ends, that cell is laid on a second grid, and only the documents of one
cell of that grid are put in order one by one. A source that holds most rows is thus no larger task than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockmill.llm.tokens import count_tokens
from blockmill.sources.tables import with_checkpoints, written

GRID = 4096
#: Plans of at most so many rows (sources of all mixtures) are broadcast; larger ones are joined.
BROADCAST_ROWS = 20_000


def fresh_lines(text: Column) -> Column:
    """The share of the lines of a text that are not repeated within it."""
    lines = F.split(text, "\n", -1)
    return F.when(F.length(text) > 0, F.size(F.array_distinct(lines)) / F.size(lines)).otherwise(1.0)


def quality_weights(sized: DataFrame) -> DataFrame:
    """`sized` (doc_id, source, n_tokens, n_chars, fresh) with `weight`: how typical a document is of its source, measured over all of them.

    The tokens that a character costs tell odd text (keys, minified code, wrong encodings) from that of its source: at z standard deviations
    from the mean the weight is 1 / (1 + z * z). It is lowered to the share of lines that are not repeated.
    """
    density = F.when(F.col("n_chars") > 0, F.col("n_tokens") / F.col("n_chars"))
    measured = sized.withColumn("density", density)
    usual = measured.groupBy("source").agg(F.avg("density").alias("mean"), F.stddev_pop("density").alias("spread")).checkpoint()
    # One row for each source; joined null-safe, as documents may have none.
    known = _small(usual.withColumnRenamed("source", "of"), usual.count())
    joined = measured.join(known, measured["source"].eqNullSafe(known["of"]), "left")
    z = F.when(F.col("spread") > 0, (F.col("density") - F.col("mean")) / F.col("spread")).otherwise(0.0)
    weight = F.coalesce(F.col("fresh") / (1 + z * z), F.lit(1.0))
    return joined.select("doc_id", "source", "n_tokens", weight.alias("weight"))


def weighed_documents(documents: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, weight), one row for each id (of several the one of most tokens)."""
    with_checkpoints(documents.sparkSession)
    rows = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "source", "text", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), F.coalesce(fresh_lines(F.col("text")), F.lit(1.0)).alias("fresh"))
    sized = count_tokens(rows, keep=["doc_id", "source", "n_chars", "fresh"], tokenizer_file=tokenizer_file)
    best = F.max(F.struct("n_tokens", "source", "n_chars", "fresh")).alias("x")
    once = sized.groupBy("doc_id").agg(best).select("doc_id", "x.*").checkpoint()
    return quality_weights(once).checkpoint()


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def plan_of(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, wanted, epochs, rest): the whole epochs of each source and the tokens to take
    beyond them. A source without documents, or with no positive share, has neither; a null max_repeats counts as 1."""
    wanted = targets.where("mix_name IS NOT NULL AND source_name IS NOT NULL").groupBy("mix_name", "source_name").agg(
        F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"),
        F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"),
        F.max(F.coalesce("total_factor", F.lit(0.0))).alias("total_factor"),
    )
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    have = sized.where("source IS NOT NULL").groupBy("source").agg(F.sum("n_tokens").alias("have"))
    rows = wanted.join(have, wanted["source_name"] == have["source"], "left")
    size = F.greatest(F.lit(0.0), F.col("target_share")) * F.greatest(F.lit(0.0), F.col("total_factor")) * F.lit(float(total))
    rows = rows.withColumn("wanted", size).withColumn("have", F.coalesce("have", F.lit(0)))
    epochs = F.when(F.col("have") > 0, F.least(F.floor(F.col("wanted") / F.col("have")), F.greatest(F.lit(0), F.col("max_repeats")).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    rows = rows.withColumn("epochs", epochs)
    rest = F.when((F.col("epochs") < F.col("max_repeats")) & (F.col("have") > 0), F.col("wanted") - F.col("epochs") * F.col("have")).otherwise(F.lit(0.0))
    return rows.select("mix_name", F.col("source_name").alias("source"), "target_share", "max_repeats", "wanted", "epochs", rest.alias("rest"))


def _cut(rows: DataFrame, cell: str, rest: Column) -> DataFrame:
    """For each source of a mixture, the cell in which `rest` is reached and the tokens before it."""
    sums = rows.groupBy("mix_name", "source", cell).agg(F.sum("n_tokens").alias("n"), F.first(rest).alias("rest"))
    order = Window.partitionBy("mix_name", "source").orderBy(cell)  # at most GRID rows each
    run = sums.withColumn("until", F.sum("n").over(order)).where(F.col("until") > F.col("rest"))
    return run.groupBy("mix_name", "source").agg(F.min(F.struct(cell, (F.col("until") - F.col("n")).alias("before"))).alias("x")).select("mix_name", "source", F.col(f"x.{cell}").alias("cut"), "x.before")


def mix_sources(sized: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(mix_name, source_name, doc_id, n_tokens, times): the documents taken and how often.

    `sized` holds doc_id, source, n_tokens and weight. Documents of no tokens, or of a source that a mixture does not list
    (a null one among them), are not taken. Of the document at which a budget ends, the nearer of with and without is
    chosen. Weights that are null or not positive count as tiny. The same seed gives the same result, whatever the order
    or the partitions of rows. Empty tables give an empty result.
    """
    with_checkpoints(sized.sparkSession)
    plan = plan_of(sized, targets).checkpoint()
    size = plan.count()
    rows = sized.where("n_tokens > 0 AND source IS NOT NULL").join(_small(plan.where("epochs > 0 OR rest > 0"), size), "source")
    weight = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(1e-6))
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "mix_name", F.lit(seed)), 12).cast("double") + 0.5) / float(1 << 52)
    # 1 - exp(-key): the keys in the same order, between 0 and 1.
    rows = rows.withColumn("place", 1 - F.pow(u, 1 / weight))
    rows = rows.withColumn("cell", F.least(F.floor(F.col("place") * GRID), F.lit(GRID - 1)).cast("int")).withColumn("inner", F.least(F.floor((F.col("place") * GRID - F.col("cell")) * GRID), F.lit(GRID - 1)).cast("int"))
    part = rows.where("rest > 0")
    first = _cut(part, "cell", F.col("rest")).withColumnsRenamed({"cut": "cut1", "before": "before1"})
    staged = rows.join(_small(first, size), ["mix_name", "source"], "left")
    within = staged.where("rest > 0 AND cell = cut1")
    second = _cut(within, "inner", F.col("rest") - F.col("before1")).withColumnsRenamed({"cut": "cut2", "before": "before2"})
    staged = staged.join(_small(second, size), ["mix_name", "source"], "left")
    keys = ["mix_name", "source", "doc_id"]
    last = staged.where("rest > 0 AND cell = cut1 AND inner = cut2")
    order = Window.partitionBy("mix_name", "source").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = last.withColumn("until", F.sum("n_tokens").over(order) + F.col("before1") + F.col("before2"))
    fits = (F.col("until") <= F.col("rest")) | (F.col("until") - F.col("n_tokens") / 2 <= F.col("rest"))
    edge = run.where(fits).select(*keys, F.lit(1).alias("edge"))
    whole = F.when((F.col("rest") > 0) & (F.col("cut1").isNull() | (F.col("cell") < F.col("cut1")) | ((F.col("cell") == F.col("cut1")) & (F.col("cut2").isNull() | (F.col("inner") < F.col("cut2"))))), 1).otherwise(0)
    inside = staged.where("NOT (rest > 0 AND cell <=> cut1 AND inner <=> cut2)").withColumn("times", F.col("epochs") + whole)
    border = staged.where("rest > 0 AND cell <=> cut1 AND inner <=> cut2").join(edge, keys, "left").withColumn("times", F.col("epochs") + F.coalesce("edge", F.lit(0)))
    columns = ["mix_name", F.col("source").alias("source_name"), "doc_id", "n_tokens", F.col("times").cast("int").alias("times")]
    return inside.select(columns).union(border.select(columns)).where("times > 0")


def reached_shares(taken: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source_name, target_share, reached_share, wanted_tokens, reached_tokens, documents): one row for each source
    of each mixture, also where nothing could be taken."""
    plan = plan_of(sized, targets)
    got = taken.groupBy("mix_name", "source_name").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("reached_tokens"), F.count("*").alias("documents"))
    rows = plan.withColumnRenamed("source", "source_name").join(got, ["mix_name", "source_name"], "left").withColumn("reached_tokens", F.coalesce("reached_tokens", F.lit(0)))
    all_of = F.sum("reached_tokens").over(Window.partitionBy("mix_name"))
    share = F.when(all_of > 0, F.col("reached_tokens") / all_of).otherwise(F.lit(0.0))
    return rows.select("mix_name", "source_name", "target_share", share.alias("reached_share"), F.col("wanted").alias("wanted_tokens"), "reached_tokens", F.coalesce("documents", F.lit(0)).alias("documents"))


def mixture(documents: DataFrame, targets: DataFrame, tokenizer_file: str | None = None, seed: int = 0) -> DataFrame:
    """(mix_name, source_name, doc_id, n_tokens, times, target_share, reached_share): what is taken, with the wanted and
    the reached share of tokens of its source."""
    sized = weighed_documents(documents, tokenizer_file)
    taken = written(mix_sources(sized, targets, seed))
    shares = reached_shares(taken, sized, targets).select("mix_name", "source_name", "target_share", "reached_share").checkpoint()
    return taken.join(_small(shares, shares.count()), ["mix_name", "source_name"]).select("mix_name", "source_name", "doc_id", "n_tokens", "times", "target_share", "reached_share")
