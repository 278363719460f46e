"""Mixing sources to target weights by entropy balancing.

Each source has a token target. One constraint stands over all documents: the
mix keeps the corpus' length profile, that is the mean log length of the document
that a token comes from, so that a source with long documents does not pull the
mix to long ones. Among the rates between 0 and ``CAP`` copies that meet the
source targets, those closest in entropy to no preference (tokens as base
measure) are exponentially tilted ones: CAP / (1 + exp(-a - b x)), with a
multiplier a for each source, one b for the profile, and x the document's
standardised length class. Newton iterations on the convex dual find them; each
aggregates gradient and Hessian of all documents' rates. As documents of one
source and length class have one rate, they are summed up first, into at most
``CLASSES`` cells a source. Source targets are met exactly, the profile as far as
``RIDGE`` (a quadratic penalty on b, which also keeps a profile that cannot be
met finite). Sources whose target is 0 or CAP copies of everything leave nothing
to choose.

Rates become copies, cell by cell: every document gets the whole part; the extra
copies go to the documents with the smallest hashes until the cell's words are
used up. The hash at which that happens is found by radix selection: word sums by
the next 12 hash bits, again inside the crossing bucket, until it holds one
document. That last document gives a part of a copy, so the words taken are the
target to within a word a cell (or, among rows that are equal, a word each), and
the cells' targets are rounded so that their sum is the source's.

With a column ``within`` (the pipeline's languages) a cell is of one of its values, too:
each value's words of a source and length class are taken at the cell's rate, to within
a word, so that the draw of the extra copies favours none.

Defined results: null texts have size 0; null is a source of its own, last;
sources without words have target 0; repeated rows are documents of their own;
very long texts are counted whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from . import runtime

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
NEWTON_STEPS = 60
TOLERANCE = 1e-10
RIDGE = 0.05
#: Length classes: powers of two of the number of words.
CLASSES = 24
BITS = 12
#: Cells (source and length class) that may be broadcast.
BROADCAST_CELLS = 200_000


def n_words(text: Column) -> Column:
    """Runs of other characters than [\\x20\\x09-\\x0D], without making them."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")
    return F.length(F.translate(marks, " \t\n\x0b\f\r", "")).cast("long")


def length_class(size: Column) -> Column:
    return F.least(F.lit(CLASSES - 1), F.when(size > 0, F.floor(F.log2(size.cast("double")) + 1e-9)).otherwise(F.lit(0))).cast("int")


def _numbered(sizes: DataFrame) -> DataFrame:
    """(source, source_size, place): places by code point, null last. Sorted by range
    and numbered part by part, as there may be many sources."""
    parts = runtime.stored(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    start = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return parts.withColumn("own", own).join(F.broadcast(start), "part").select("source", "source_size", (F.col("start") + F.col("own")).alias("place"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the shares of
    sources above ``cap`` times their size go to the others by weight. That is
    the level L with sum(min(cap * size, L * weight)) = share * all sizes, found
    from below: sources that a level fills are set aside until none is."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    s = runtime.stored(_numbered(sizes).select("source", "source_size", w.alias("w"), (cap * F.col("source_size")).alias("c")), "weights")
    total = s.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level = 0.0
    while True:  # the level rises with each source that it fills, and ends within as many steps
        full = F.col("c") <= level * F.col("w")
        r = s.agg(F.sum(F.when(full, F.col("c"))).alias("c"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        new = (share * total - (r.c or 0.0)) / r.w if r.w else None
        if new is None or new <= level * (1 + 1e-14):
            break
        level = new
    return s.select("source", "source_size", F.least(F.col("c"), F.col("w") * F.lit(level) if new is not None else F.col("c")).alias("target"))


def rates(cells: DataFrame, cap: float = CAP, ridge: float = RIDGE, steps: int = NEWTON_STEPS) -> DataFrame:
    """(source, class, rate) of cells (source, class, words, x, target, source_size)
    by Newton's method on the dual. ``x`` is the length feature, standardised over
    all words, so that the profile to keep has mean 0."""
    total = cells.agg(F.sum("words").alias("n")).first()["n"] or 0
    free = (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12))
    fixed = F.when(F.col("target") > 0, F.lit(float(cap))).otherwise(F.lit(0.0))
    mean = F.col("target") / F.col("source_size") / cap  # without a profile every rate is this
    state = cells.withColumn("free", free).withColumn("a", F.when(free, F.log(mean / (1 - mean))).otherwise(F.lit(0.0)))
    state = runtime.stored(state, "dual")
    constant = state.where("NOT free").agg(F.sum(F.col("words") * F.col("x") * fixed).alias("m")).first()["m"] or 0.0
    b = 0.0
    for step in range(steps):
        p = 1 / (1 + F.exp(-(F.col("a") + b * F.col("x"))))
        rate, slope = cap * p * F.col("words"), cap * p * (1 - p) * F.col("words")
        per = state.where("free").groupBy("source").agg(
            (F.sum(rate) - F.max("target")).alias("g"), F.sum(slope).alias("h"), F.sum(slope * F.col("x")).alias("hx"), F.sum(slope * F.col("x") * F.col("x")).alias("hxx"), F.sum(rate * F.col("x")).alias("gx"), F.max("target").alias("t"),
        )
        per = runtime.stored(per.withColumn("h", F.greatest("h", F.lit(1e-9))), "newton")
        # The Hessian is diagonal in the sources, with one row and column for b.
        r = per.agg(F.sum("gx").alias("gx"), F.sum(F.col("hxx") - F.col("hx") * F.col("hx") / F.col("h")).alias("s"), F.sum(F.col("hx") * F.col("g") / F.col("h")).alias("hg"), F.max(F.abs("g") / F.greatest("t", F.lit(1.0))).alias("err")).first()
        if r.gx is None:
            runtime.drop_stored(per)
            break
        grad = r.gx + constant + ridge * total * b
        done = r.err < TOLERANCE and abs(grad) <= 1e-7 * max(total, 1)
        if done:
            runtime.drop_stored(per)
            break
        db = max(-1.0, min(1.0, -(grad - r.hg) / (r.s + ridge * total)))
        da = -(F.col("g") + F.col("hx") * db) / F.col("h")
        move = per.select(F.col("source").alias("s"), F.greatest(F.lit(-2.0), F.least(F.lit(2.0), da)).alias("da"))
        after = state.join(move, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("a", F.col("a") + F.coalesce("da", F.lit(0.0))).select(*state.columns)
        after = runtime.stored(after, "dual")
        runtime.drop_stored(per)
        runtime.drop_stored(state)
        state, b = after, b + db
    p = 1 / (1 + F.exp(-(F.col("a") + b * F.col("x"))))
    return state.select("source", "class", F.when(F.col("free"), cap * p).otherwise(fixed).alias("rate"))


def plan_cells(rows: DataFrame, weights: tuple, share: float, cap: float) -> DataFrame:
    """(source, class, source_size, target, whole, extra) of the cells of ``rows``
    (source, class, size): whole copies of each document, and the words to take on
    top of them. ``class`` is a length class, or a struct that begins with one."""
    cells = runtime.stored(rows.groupBy("source", "class").agg(F.sum("size").alias("words")), "cells")
    plan = runtime.stored(targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap), "targets")
    length = F.col("class") if rows.schema["class"].dataType == IntegerType() else F.col("class.length")
    mean = length.cast("double")
    m = cells.agg(F.sum("words").alias("n"), F.sum(mean * F.col("words")).alias("m"), F.sum(mean * mean * F.col("words")).alias("q")).first()
    n = m.n or 0
    center = m.m / n if n else 0.0
    spread = max(m.q / n - center * center, 0.0) ** 0.5 if n else 0.0
    x = (mean - center) / spread if spread > 1e-9 else F.lit(0.0)
    named = plan.withColumnRenamed("source", "s")
    cells = cells.withColumn("x", x).join(_few(named), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    found = rates(cells, cap).select(F.col("source").alias("s"), F.col("class").alias("c"), "rate")
    cells = cells.join(_few(found), F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))).drop("s", "c")
    # Whole words for each cell, which add up to the source's target; none above its cap.
    per = Window.partitionBy("source")
    share_ = F.col("rate") * F.col("words")
    scale = F.col("target") / F.greatest(F.sum(share_).over(per), F.lit(1e-9))
    upto = F.round(F.sum(share_).over(per.orderBy("class")) * scale)
    cells = cells.withColumn("upto", upto)
    given = (F.col("upto") - F.coalesce(F.lag("upto").over(per.orderBy("class")), F.lit(0.0))).cast("long")
    cells = cells.withColumn("given", F.least(given, F.floor(cap * F.col("words")).cast("long")))
    whole = F.when(F.col("words") > 0, F.least(F.floor(F.col("given") / F.col("words")), F.lit(int(cap)))).otherwise(F.lit(0)).cast("long")
    return cells.withColumn("whole", whole).select("source", "class", "source_size", "target", "whole", (F.col("given") - whole * F.col("words")).alias("extra"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, within: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document; null is a value of
    ``within`` like any other."""
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.xxhash64("text")), 4)  # 60 bits
    class_ = length_class(F.col("size"))
    if within is not None:  # hashed, so that whatever values compare alike in joins, null included
        class_ = F.struct(class_.alias("length"), F.xxhash64("_within").alias("value"))
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), unit.alias("u"), (F.lit(None) if within is None else F.col(within)).alias("_within"))
    rows = runtime.stored(rows.withColumn("class", class_).drop("_within"), "sizes")
    plan = runtime.stored(plan_cells(rows, weights, share, cap).withColumn("prefix", F.lit(0).cast("long")), "plan")
    of = F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))
    key = [F.col("source").alias("s"), F.col("class").alias("c")]
    at = 60
    while at > 0:  # extra: the words still to take inside the hash prefix
        at -= BITS
        inside = rows.join(_few(plan.select(*key, "prefix")), of & (F.shiftright("u", at + BITS) == F.col("prefix")))
        sums = inside.groupBy("source", "class", F.shiftright("u", at).alias("b")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs"))
        run = F.sum("n").over(Window.partitionBy("source", "class").orderBy("b"))
        sums = sums.withColumn("upto", run).join(_few(plan.select(*key, "extra")), of).where((F.col("upto") > F.col("extra")) & (F.col("upto") - F.col("n") <= F.col("extra")))
        cross = sums.select("s", "c", F.col("b"), (F.col("extra") - F.col("upto") + F.col("n")).alias("rest"), "n", "docs")
        rest = plan.drop("n", "docs").join(cross, of, "left")
        # A cell whose bucket none crosses takes all extra copies there are.
        past = F.shiftleft(F.col("prefix") + 1, BITS)
        plan = runtime.stored(rest.select("source", "class", "source_size", "target", "whole", F.coalesce("b", past).alias("prefix"), F.coalesce("rest", F.lit(0)).alias("extra"), "n", "docs"), "plan")
        if not plan.where("docs > 1").limit(1).count():
            break
    p = F.shiftright("u", at)
    # Inside the last bucket the rest is shared by size.
    more = F.when(p < F.col("prefix"), F.col("size")).when((p == F.col("prefix")) & (F.col("n") > 0), F.floor(F.col("size") * F.col("extra") / F.col("n"))).otherwise(F.lit(0))
    out = rows.join(_few(plan.withColumnRenamed("source", "s").withColumnRenamed("class", "c")), of)
    return out.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + more).cast("long").alias("taken"))


def _few(plan: DataFrame) -> DataFrame:
    """Marked for broadcast if there are few rows."""
    return F.broadcast(plan) if plan.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS else plan


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(runtime.read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
