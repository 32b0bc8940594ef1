"""Order, limits, samples, splits and nearest neighbours.

Random choice is a hash of a row's key and a seed, so it is the same on every run
and every partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .scans import numbered


def hash_order(key: str, seed: int = 27) -> Column:
    """A pseudo-random order that other engines can compute too: the MD5 of ``seed:key``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def sample_rows(frame: DataFrame, n: int, key: str, seed: int = 27) -> DataFrame:
    """``n`` rows, or all if there are fewer; a top-n by hash, never a global sort."""
    return frame.orderBy(hash_order(key, seed), key).limit(n)


def permuted(n: Column, size: int, seed: int = 27, rounds: int = 6) -> Column:
    """The place of row number ``n`` (from 0) in a pseudo-random permutation of ``size`` rows: no sort, no shuffle.

    A Feistel network over the bits of the row numbers, whose halves take turns to be
    changed by a hash of the other, is a bijection of all numbers of so many bits.
    What falls outside the table is sent through again until it is inside, which it
    is each time with a chance of more than a half; this keeps the bijection.
    """
    bits = max(2, (size - 1).bit_length())
    a, b = bits // 2, bits - bits // 2

    def hashed(k: int, v: Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{k}:"), v.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")

    def turn(k: int) -> Callable[[Column], Column]:
        if k % 2 == 0:
            return lambda h: F.struct(h["l"].bitwiseXOR(hashed(k, h["r"]).bitwiseAND((1 << a) - 1)).alias("l"), h["r"].alias("r"))
        return lambda h: F.struct(h["l"].alias("l"), h["r"].bitwiseXOR(hashed(k, h["l"]).bitwiseAND((1 << b) - 1)).alias("r"))

    def once(x: Column) -> Column:
        halves = F.struct(F.shiftright(x, b).alias("l"), x.bitwiseAND((1 << b) - 1).alias("r"))
        for k in range(rounds):
            halves = let(halves, turn(k))
        return let(halves, lambda h: F.shiftleft(h["l"], b).bitwiseOR(h["r"]))

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(128)), once(n.cast("long")), lambda x, _: F.when(x >= size, once(x)).otherwise(x))
    return let(walk, lambda x: F.when(x < size, x).otherwise(F.raise_error(F.lit("the walk didn't end"))))


def shuffled(frame: DataFrame, key: str, seed: int = 27) -> DataFrame:
    """``frame`` with ``place``, from 0, in a full shuffle that depends on the order of ``key`` and the seed alone.

    Null keys come last.  Rows of equal keys may change places from run to run.
    """
    size = frame.count()
    return numbered(frame, F.col(key).isNull(), key, name="_n").withColumn("place", permuted(F.col("_n") - 1, max(1, size), seed)).drop("_n")


def split_rows(frame: DataFrame, key: str, holdout: int | float, longest: int = 300, columns: tuple[str, ...] = (), seed: int = 27) -> DataFrame:
    """``frame`` with ``split``: the last rows of the hash order and over-long rows are ``val``, others ``train``.

    ``holdout`` is a count, or a share of all rows; only keys are ranked, to find
    where the holdout begins.
    """
    order = hash_order(key, seed)
    total = frame.count() if isinstance(holdout, float) else None
    n = holdout if total is None else int(total * holdout)
    last = frame.select(order.alias("h"), F.col(key).alias("_k")).orderBy(F.col("h").desc(), F.col("_k").desc()).limit(n)
    edge = last.agg(F.min(F.struct("h", "_k")).alias("edge"))
    too_long = F.lit(False)
    for c in columns:
        too_long = too_long | (F.length(c) > longest)
    placed = frame.join(edge, F.lit(True), "left")
    held = F.coalesce(F.struct(order.alias("h"), F.col(key).alias("_k")) >= F.col("edge"), F.lit(False))
    return placed.withColumn("split", F.when(held | too_long, "val").otherwise("train")).drop("edge")


def rows_between(frame: DataFrame, start: int, end: int, n: str = "n") -> DataFrame:
    """Numbered rows after ``start`` up to ``end``."""
    return frame.where((F.col(n) > start) & (F.col(n) <= end))


def nearest(vectors: DataFrame, query: list[float], k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cosine) of the ``k`` nearest vectors to one query, by a top-k."""
    v = F.col(vector_col).cast("array<double>")
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = F.try_divide(dot(v, q), F.sqrt(dot(v, v)) * F.sqrt(dot(q, q)))
    return vectors.select(F.col(id_col), cosine.alias("cosine")).orderBy(F.col("cosine").desc_nulls_last(), id_col).limit(k)
