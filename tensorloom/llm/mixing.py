"""Mixing sources to target weights by entropy balancing.

Of all rates in [0, MOST] that make each source take its target of words, those of largest entropy are exponentially
tilted: min(MOST, exp(tilt * z)), z being the size of the document against its source's mean. The tilts are the multipliers of
the token constraints; the convex dual is solved by Newton's iterations over the cluster. Each iteration adds up the gradient
and the Hessian of every source from its documents, of which those of one size are one row with their number, as their
rates are the same. A source with k sizes has k * k / 2 words at least, so even a third of all documents has few.

Rates become copies in two steps. From the largest size down, each size of a source gives the whole number of copies that
best makes up the words still owed, so what remains at the end is a small document's size. Within a size the copies are
spread evenly over its documents in a fixed order. Sums are of whole numbers, so that reruns and any partitioning agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.functions.ranking import with_rank
from tensorloom.llm.common import arrow, cut, narrow, small_batches, text_of, without
from tensorloom.llm.words import count_words

OUT = ("size", "source_size", "target", "taken", "copies")
MOST = 3  # copies of a document
CLOSE = 1e-7  # how near to its target, as a share of it, a source's rates come
STEPS = 80  # iterations at most: a bracket that is halved so often is as narrow as numbers are
PART_ROWS = 20_000  # rows of a size that one task numbers
FEW = 10_000  # sources whose multipliers are broadcast; those of more are joined


def water_fill(sources: DataFrame, most: int = MOST) -> DataFrame:
    """sources (source, source_size, weight) with target: shares of the total by weight, none above most * source_size.

    What a source can't take is shared anew among the others by weight until none is above: the water level (target a unit
    of weight) rises with every pass that finds more sources full, until a pass finds no more.
    """
    cap, level, full = F.col("source_size") * F.lit(most), 0.0, -1
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        over = cap < F.lit(level) * F.col("weight")
        row = sources.agg(F.count_if(over).alias("full"), F.sum(F.when(over, cap)).alias("taken"), F.sum(F.when(~over, F.col("weight"))).alias("weights")).first()
        if row["full"] == full or not row["weights"]:
            break
        full, level = row["full"], (total - (row["taken"] or 0)) / row["weights"]
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def _rate(tilt: Column, z: Column) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(tilt * z))


def _whole(x: Column) -> Column:
    """Billionths, as a whole number: sums of these are the same in any order."""
    return F.rint(x * 1e9).cast("decimal(38,0)")


def tilts(classes: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """sources (source, source_size, target, mean) with tilt, null where every rate is MOST (the target is all there can be).

    classes (source, size, n) are the documents; those without words have no part in it. Newton's steps on the logarithm of
    the words taken; one that leaves the bracket of the root is replaced by its middle.
    """
    size, target, mean = F.col("source_size").cast("double"), F.col("target"), F.col("mean")
    free = (F.col("source_size") > 0) & (target < MOST * size * (1 - CLOSE))
    wanted = F.log(target / size) * mean  # with this tilt even the smallest documents take no more than the target
    state = sources.withColumns({"low": F.when(free, F.least(wanted, F.lit(0.0))), "high": F.when(free, F.when(target > size, F.lit(float(np.log(MOST))) * mean).otherwise(0.0)), "tilt": F.when(free, 0.0), "open": free})
    state = cut(state)
    some = classes.where("size > 0").withColumnRenamed("source", "__s")
    for _ in range(STEPS):
        if state.where("open").isEmpty():
            break
        ask = state.where("open").select("source", "tilt", "mean")
        met = some.join(F.broadcast(ask) if n_sources <= FEW else ask, F.col("__s") == F.col("source"))
        z = F.col("size") / F.col("mean")
        met = met.select("source", (F.col("n") * F.col("size") * _rate(F.col("tilt"), z)).alias("words"), z.alias("z"), (F.col("tilt") * z < F.lit(float(np.log(MOST)))).alias("below"))
        totals = met.groupBy(F.col("source").alias("__s")).agg(F.sum(_whole(F.col("words"))).cast("double").alias("__got"), F.sum(_whole(F.when(F.col("below"), F.col("words") * F.col("z")).otherwise(0.0))).cast("double").alias("__slope"))
        step = state.join(totals, F.col("source") == F.col("__s"), "left")
        got, slope = F.col("__got") / 1e9, F.col("__slope") / 1e9
        gap = got - target
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.log(got / target) * got / F.when(slope > 0, slope)
        inside = F.coalesce((newton > low) & (newton < high), F.lit(False))
        still = F.col("open") & (F.abs(gap) > CLOSE * target)
        moved = F.when(inside, newton).otherwise((low + high) / 2)
        state = cut(step.select("source", "source_size", "target", "mean", F.when(still, low).otherwise(F.col("low")).alias("low"), F.when(still, high).otherwise(F.col("high")).alias("high"), F.when(still, moved).otherwise(F.col("tilt")).alias("tilt"), F.coalesce(still, F.lit(False)).alias("open")))
    return state.select("source", "source_size", "target", "mean", "tilt")


def round_off(rate: np.ndarray, size: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Copies that each size gives in all: from the largest size down, each makes up what is still owed."""
    copies, owed = np.zeros(len(rate), np.int64), 0.0
    for i in np.argsort(-size, kind="stable"):
        if size[i]:
            owed += rate[i] * size[i] * rows[i]
            copies[i] = int(np.clip(np.rint(owed / size[i]), 0, MOST * rows[i]))
            owed -= copies[i] * size[i]
    return copies


def _rounded(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("size", ignore_index=True)
    return frame.assign(__copies=round_off(frame["rate"].to_numpy(float), frame["size"].to_numpy(float), frame["n"].to_numpy(float)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """docs with size (words; null text: 0), source_size, target, copies (0 to 3) and taken (copies * size).

    Sources in order of code point, null last as a source of its own, weigh `weights` in turn. Documents without words
    keep one copy and take nothing. Rows that are repeated are documents of their own. An empty table gives none; sources
    without words have target 0. Input columns named like an output column are replaced. Repeat each row `copies` times
    (see `expand`) to get the mix itself.

    Totals are summed up by source and size before they are exchanged. A size that more than PART_ROWS documents of a source
    have (and more than one in 100,000 of all, so that such sizes number 100,000 at most) is numbered in parts, each with its
    share of the size's copies. So all documents may be of one source and one size.
    """
    small_batches(docs.sparkSession)
    rows = without(docs, *OUT).withColumn("size", arrow(count_words, "bigint")(F.col(text_col)))
    # a key that is never null, so that the window and the join below share one exchange of the rows; null comes last
    rows = rows.withColumn("__source", F.when(F.col(source_col).isNull(), "t").otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string"))))
    classes = cut(rows.groupBy(F.col("__source").alias("source"), "size").agg(F.count("*").alias("n")))
    n_rows = classes.agg(F.sum("n")).first()[0] or 0
    classes = narrow(classes, classes.count())
    sources = classes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("__docs"))
    sources = cut(with_rank(sources, "__number", F.substring("source", 1, 3), F.col("source")))
    n_sources = sources.count()
    sources = narrow(sources, n_sources)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("__number") % len(weights) + 1).cast("int"))
    targets = water_fill(sources.withColumn("weight", weight)).select("source", "source_size", "target", (F.col("source_size") / F.col("__docs")).alias("mean"))
    tilted = tilts(classes, targets, n_sources).withColumnRenamed("source", "__s")

    rated = classes.join(tilted, F.col("source") == F.col("__s"))
    rated = rated.select("source", "size", "n", "source_size", "target", F.when(F.col("tilt").isNull(), float(MOST)).otherwise(_rate(F.col("tilt"), F.col("size") / F.when(F.col("mean") > 0, F.col("mean")))).alias("rate"))
    rated = rated.groupBy("source").applyInPandas(_rounded, "source string, size long, n long, source_size long, target double, rate double, __copies long")

    most = max(PART_ROWS, n_rows // 100_000)
    parts = F.when(F.col("n") > most, F.ceil(F.col("n") / PART_ROWS)).otherwise(1).cast("int")
    rated = cut(rated.withColumns({"__parts": parts, "__key": F.xxhash64("source", "size")}))
    large = rated.where("__parts > 1").groupBy(F.col("__key").alias("__large")).agg(F.max("__parts").alias("__dealt"))  # 100,000 pairs of numbers at most
    # keys that collide are dealt alike
    rated = rated.join(F.broadcast(large), F.col("__key") == F.col("__large"), "left").withColumn("__t", F.explode(F.sequence(F.lit(0), F.coalesce("__dealt", F.lit(1)) - 1)))
    facts = rated.select(F.col("source").alias("__s"), F.col("size").alias("__z"), "__t", "source_size", "target", F.col("n").alias("__of"), F.expr("__copies div n").alias("__whole"), (F.col("__copies") % F.col("n")).alias("__more"), F.col("__dealt").isNotNull().alias("__salted"))

    rows = rows.withColumns({"__tie": F.crc32(text_of(text_col).cast("binary")), "__key": F.xxhash64("__source", "size")})
    rows = rows.join(F.broadcast(large), F.col("__key") == F.col("__large"), "left")
    rows = rows.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(F.col(id_col), F.col("__tie")), F.col("__dealt")).cast("int"), F.lit(0)))
    rows = rows.withColumn("__at", F.row_number().over(Window.partitionBy("__source", "size", "__salt").orderBy(F.col(id_col), "__tie")).cast("long"))
    rows = rows.join(facts, (F.col("__source") == F.col("__s")) & (F.col("size") == F.col("__z")) & (F.col("__salt") == F.col("__t")))
    # of the rows of a size, numbered in turn, `__more` evenly spaced ones get one copy more; parts begin at places of their own
    start = F.when(F.col("__salted"), F.pmod(F.xxhash64("__salt", "size"), F.col("__of"))).otherwise(F.expr("__of div 2"))
    rows = rows.withColumn("__start", start).withColumn("__extra", F.expr("(__at * __more + __start) div __of - ((__at - 1) * __more + __start) div __of"))
    rows = rows.withColumn("copies", F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("__whole") + F.col("__extra")).cast("int"))
    rows = rows.withColumn("taken", F.col("copies") * F.col("size"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in OUT], *OUT)


def expand(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: these columns of each row, as often as its copies say."""
    rows = mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(*[F.col(f"`{c}`") for c in columns])
