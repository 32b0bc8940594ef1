"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled and laid end to end; its stream of words is cut
into blocks of equal size, wherever documents begin.  The mix is a sequence of slots.
Slot number n is the point whose binary digits are those of n read backwards (van der
Corput); the sources' shares of all slots cut the unit interval, and the point says
whose slot it is.  The r-th slot of a source takes its r-th block, around again from
the start once the stream ends, so every stretch of the mix has all sources in nearly
their shares.

How many of a source's slots come before a slot needs no count over the table: numbers
below n fall into runs of a power of two, and the points of a run are evenly spaced,
so a run's share of an interval is one division.  Slots are joined with blocks on
(source, block), keys with as many rows as a block has documents, so a source with
most of the words is spread like any other.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scans import numbered, prefix_scan
from .common import stored

WEIGHTS = (5, 2, 1)
#: Points are whole numbers of 2**-DIGITS; slots are fewer than 2**DIGITS.
DIGITS = 40
#: The unit interval is cut in so many cells to look up whose slot a point is.
_CELL_BITS = 10
_WORD = r"[^\x20\x09-\x0D]++"


def words_in(text: Column) -> Column:
    """Words between ASCII white space; none in a null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = Fraction(3, 2), most: int = 2) -> DataFrame:
    """(source, ord, weight, source_size, target): words that the mix should take of each source.

    Sources in code-point order, null last, have the weights in turn.  ``share`` of
    all words is dealt out by weight; a source stops at ``most`` times its size and
    what is over goes to the others by weight, until none is above.  Each round is
    one aggregate over the table of sources.  ``share`` beyond ``most`` stops there.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(by_source, F.col("source").isNull(), "source", name="ord")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("ord") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = stored(ranked.select("source", "ord", weight.cast("long").alias("weight"), "source_size"), "sources")
    whole = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    level, full = None, F.lit(False)
    while True:
        state = table.agg(F.sum(F.when(full, F.col("source_size"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("rest")).first()
        found = Fraction(max(0, share * whole - most * (state["full"] or 0)), state["rest"]) if state["rest"] else level
        if found == level:
            break
        level = found  # it only rises, so a full source stays full
        full = F.col("weight") * F.lit(float(level)) >= F.col("source_size") * F.lit(float(most))
    target = F.least(F.col("source_size") * F.lit(float(most)), F.col("weight") * F.lit(float(level or 0)))
    return table.withColumn("target", target)


def _reversed_bits(n: Column) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(n), DIGITS, "0")), 2, 10).cast("long")


def _slots_before(n: Column, point: Column, low: Column, high: Column) -> Column:
    """How many of the numbers 0 to n - 1 have their point in [low, high); ``point`` is that of n."""

    def run(total: Column, k: Column) -> Column:
        # bit k of n stands for 2**k numbers that share n's digits above k: their points begin at ``first``, 2**(DIGITS - k) apart
        step = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(DIGITS) - k)
        first = point.bitwiseAND((step / 2).cast("long") - 1)
        below = lambda bound: F.when(bound > first, F.floor((bound - first - 1) / step) + 1).otherwise(F.lit(0))
        has = F.call_function("shiftright", n, k).bitwiseAND(F.lit(1)) == 1
        return total + F.when(has, below(high) - below(low)).otherwise(F.lit(0)).cast("long")

    return F.aggregate(F.sequence(F.lit(0), F.lit(DIGITS - 1)), F.lit(0).cast("long"), run)


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """(slot, source, ord, rank): whose slot each is, and its place among that source's, from 0.

    ``sources`` has ord and slots (how many each takes).  A source that the points
    alone give fewer has the rest after all others' last; what they give beyond is
    left out.  The points miss a source's share by the number of their digits at most.
    """
    whole = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n"), F.max("slots").alias("m")).first()["n"]
    bound = lambda slots: F.floor(slots.cast("decimal(38,0)") * F.lit(1 << DIGITS).cast("decimal(20,0)") / F.lit(max(1, whole)).cast("decimal(20,0)")).cast("long")
    placed = prefix_scan(sources.where("slots > 0"), ["ord"], _until=("sum", F.col("slots"))).select("source", "ord", "slots", bound(F.col("_until") - F.col("slots")).alias("low"), bound(F.col("_until")).alias("high"))
    placed = stored(placed, "intervals")
    shift = DIGITS - _CELL_BITS
    cells = placed.where("high > low").select("*", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))).alias("cell"))
    n = F.col("slot")
    points = placed.sparkSession.range(whole).select(F.col("id").alias("slot"), _reversed_bits(F.col("id")).alias("point")).withColumn("at", F.shiftright("point", shift))
    mine = points.join(cells, (F.col("at") == F.col("cell")) & (F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    ranked = mine.select("slot", "source", "ord", _slots_before(n, F.col("point"), F.col("low"), F.col("high")).alias("rank"), "slots")
    given = _slots_before(F.lit(whole).cast("long"), _reversed_bits(F.lit(whole).cast("long")), F.col("low"), F.col("high"))
    short = placed.withColumn("given", given).where("given < slots")
    late = short.select((F.lit(whole) + F.col("ord")).alias("slot"), "source", "ord", F.explode(F.sequence("given", F.col("slots") - 1)).alias("rank"))
    return ranked.where(F.col("rank") < F.col("slots")).drop("slots").unionByName(late)


def mix(sizes: DataFrame, sources: DataFrame, block: int = 4096, seed: int = 27) -> DataFrame:
    """(slot, source, doc_id, row, start, length): which words of which document stand in each slot of the mix.

    A source's documents follow one another by a hash of (seed, doc_id); ``start``
    counts a document's words from 0.  A source's slots hold its target, rounded to
    a whole word, so its last slot may be shorter.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    streams = prefix_scan(sizes.where("size > 0").withColumn("_h", order), ["_h", "size"], ["source"], _end=("sum", F.col("size")))
    spans = streams.withColumn("_begin", F.col("_end") - F.col("size"))
    none = F.col("source").isNull().alias("none")
    pieces = spans.select("doc_id", "row", "source", none, "_begin", "_end", F.explode(F.sequence(F.floor(F.col("_begin") / block), F.floor((F.col("_end") - 1) / block))).alias("block"))
    wanted = sources.select("*", F.round("target").cast("long").alias("words"))
    slots = schedule(wanted.withColumn("slots", F.ceil(F.col("words") / block)), block)
    # the stream of a source goes around: what a slot covers are one or two stretches of it, and a block or two of each
    asked = slots.join(wanted.select(F.col("ord").alias("_ord"), "source_size", "words"), F.col("ord") == F.col("_ord"))
    a = F.col("rank") * block
    asked = asked.withColumns({"a": a, "b": F.least(a + block, F.col("words"))})
    rounds = F.explode(F.sequence(F.floor(F.col("a") / F.col("source_size")), F.floor((F.col("b") - 1) / F.col("source_size")))).alias("round")
    turns = asked.select("slot", "source", "source_size", "a", "b", rounds)
    lap = F.col("round") * F.col("source_size")
    turns = turns.select("slot", "source", F.greatest(F.col("a") - lap, F.lit(0)).alias("from"), F.least(F.col("b") - lap, F.col("source_size")).alias("to"))
    stretches = turns.select("slot", F.coalesce("source", F.lit("")).alias("s_source"), F.col("source").isNull().alias("s_none"), "from", "to", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))).alias("s_block"))
    at = F.col("block") * block
    met = pieces.join(stretches, (F.coalesce("source", F.lit("")) == F.col("s_source")) & (F.col("none") == F.col("s_none")) & (F.col("block") == F.col("s_block")))
    cut = met.withColumns({"x": F.greatest("_begin", "from", at), "y": F.least("_end", "to", at + block)}).where("x < y")
    return cut.select("slot", "source", "doc_id", "row", (F.col("x") - F.col("_begin")).alias("start"), (F.col("y") - F.col("x")).alias("length"))


def mixed(docs: DataFrame, block: int = 4096, seed: int = 27, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target of its source, and the words that the mix takes of it.

    A null text has no words, nor has an empty one: nothing is taken of them, and a
    source of such documents alone has a target of 0.  Rows with a null or repeated
    doc_id are documents of their own.  Very long documents are cut by blocks like
    all others.  Other columns of ``docs`` are not read; an empty table gives no rows.
    """
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"))
    sizes = stored(sizes.withColumn("row", F.monotonically_increasing_id()), "sizes")
    sources = stored(targets(sizes, weights), "targets")
    taken = mix(sizes, sources, block, seed).groupBy(F.col("row").alias("_row")).agg(F.sum("length").alias("taken"))
    rows = sizes.join(taken, F.col("row") == F.col("_row"), "left")
    own = sources.select(F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"), "source_size", "target")
    found = rows.join(own, (F.coalesce("source", F.lit("")) == F.col("_source")) & (F.col("source").isNull() == F.col("_none")))
    return found.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
