"""Best-fit packing of documents into fixed-length sequences, with swap-based local search.

Documents become pieces of at most ``capacity`` ids; only longer ones are cut.
Pieces are dealt by a hash of their place in the stored table, so that equal rows
spread too, into groups of about ``GROUP`` pieces, and each group is packed alone:
best fit in decreasing length, then local search between underfull bins.  Groups
hold lengths and ids, never texts, so a group's memory is bounded by ``GROUP`` at
every input size; each group may end with one bin more than its share of a packing
of all pieces at once.

The search stops when no move is left, or when the bins are as few as their
content can fill.  Every step makes a fuller bin fuller at the cost of a less
filled one, so the sum of squared fills rises and the search ends by itself.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, stored, texts
from .encoding import encoder

#: Pieces in a group, about.
GROUP = 60_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece.

    A null or empty text has only the end id, very long texts are cut into as many
    pieces as they need, rows with a null or repeated doc_id are documents of their
    own, other columns are not read, and an empty table gives no rows.
    """
    return _pieces(docs, tokenizer, capacity, end_id).drop("slot")


def _pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """``pieces`` with a number of its own for each piece."""
    end = struct.pack("<I", end_id)
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 4]

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot = TaskContext.get().partitionId() << 40
        encode = encoder(tokenizer).encode_many
        for whole in rows:
            for batch in batches_by_bytes(whole, "text", 2 << 20):
                out: list[tuple] = []
                for doc_id, encoded in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
                    ids = encoded + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), slot))
                        slot += 1
                yield _batch(out, types, ["doc_id", "piece", "start", "length", "ids_crc32", "slot"])

    return texts(docs).mapInArrow(cut, PIECES + ", slot long")


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


class Bins:
    """Bins of one group; items are positions in ``lengths``."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.free: list[int] = []

    def best_fit(self) -> None:
        """Best fit, longest first: a bit for each amount of free space that some bin has."""
        by_free: dict[int, list[int]] = defaultdict(list)
        some = 0
        for item in sorted(range(len(self.lengths)), key=lambda i: -self.lengths[i]):
            n = self.lengths[item]
            fits = some >> n
            if fits:
                free = n + (fits & -fits).bit_length() - 1
                b = by_free[free].pop()
                if not by_free[free]:
                    some &= ~(1 << free)
                self.items[b].append(item)
                self.free[b] -= n
            else:
                b = len(self.items)
                self.items.append([item])
                self.free.append(self.capacity - n)
            if self.free[b]:
                by_free[self.free[b]].append(b)
                some |= 1 << self.free[b]

    def fewest(self) -> bool:
        """Whether no packing of this content has fewer bins."""
        return sum(map(bool, self.items)) <= -(-sum(self.lengths) // self.capacity)

    def local_search(self) -> int:
        """Empty the least filled bins into fuller ones; returns the number of steps.

        For each bin, least filled first: move an item to the fuller bin where it
        fits best; else exchange one item, or two, for one shorter item of a fuller
        bin.  A bin that gave all its items away is gone.  Passes go on until one
        makes no step.
        """
        steps = -1
        total = 0
        while steps and not self.fewest():
            steps = self._pass()
            total += steps
        return total

    def _pass(self) -> int:
        lengths, free, items = self.lengths, self.free, self.items
        under = sorted((b for b in range(len(items)) if free[b] and items[b]), key=lambda b: (-free[b], b))
        spaces: dict[int, set[int]] = defaultdict(set)  # free space -> underfull bins
        holds: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))  # length -> free space -> underfull bins with such an item
        # which keys are in use, as bits
        some_space, some_length, some_holder = 0, 0, defaultdict(int)

        def note(b: int) -> None:
            nonlocal some_space, some_length
            spaces[free[b]].add(b)
            some_space |= 1 << free[b]
            for n in {lengths[i] for i in items[b]}:
                holds[n][free[b]].add(b)
                some_holder[n] |= 1 << free[b]
                some_length |= 1 << n

        def forget(b: int) -> None:
            nonlocal some_space, some_length
            spaces[free[b]].discard(b)
            if not spaces[free[b]]:
                some_space &= ~(1 << free[b])
            for n in {lengths[i] for i in items[b]}:
                holds[n][free[b]].discard(b)
                if not holds[n][free[b]]:
                    some_holder[n] &= ~(1 << free[b])
                    if not some_holder[n]:
                        some_length &= ~(1 << n)

        def exchange(a: int, give: list[int], b: int, take: list[int]) -> None:
            forget(a)
            forget(b)
            for x, gone, come in ((a, give, take), (b, take, give)):
                for i in gone:
                    items[x].remove(i)
                items[x].extend(come)
                free[x] += sum(lengths[i] for i in gone) - sum(lengths[i] for i in come)
                if items[x] and free[x]:
                    note(x)

        def other(bins: set[int], a: int) -> int | None:
            return next((b for b in bins if b != a), None)

        def room(a: int, n: int) -> int | None:
            """The fuller bin with the least space for ``n`` ids."""
            left = (some_space >> n << n) & ((2 << free[a]) - 1)
            while left:
                space = (left & -left).bit_length() - 1
                b = other(spaces[space], a)
                if b is not None:
                    return b
                left &= left - 1
            return None

        def partner(a: int, give: int) -> tuple[int, int] | None:
            """A fuller bin and its item of the least length that ``give`` ids can stand in for."""
            least = max(1, give - free[a])
            left = (some_length >> least << least) & ((1 << give) - 1)
            while left:
                n = (left & -left).bit_length() - 1
                grow = give - n
                fits = (some_holder[n] >> grow << grow) & ((2 << free[a]) - 1)
                while fits:
                    b = other(holds[n][(fits & -fits).bit_length() - 1], a)
                    if b is not None:
                        return b, next(i for i in items[b] if lengths[i] == n)
                    fits &= fits - 1
                left &= left - 1
            return None

        def step(a: int) -> bool:
            mine: dict[int, list[int]] = defaultdict(list)  # items of ``a`` by length, longest first
            for i in sorted(items[a], key=lambda i: (-lengths[i], i)):
                mine[lengths[i]].append(i)
            for n, same in mine.items():
                b = room(a, n)
                if b is not None:
                    exchange(a, same[:1], b, [])
                    return True
            tried = set()
            values = list(mine)
            gives = ([n] for n in values)
            pairs = ([n, m] for k, n in enumerate(values) for m in values[k:] if n != m or len(mine[n]) > 1)
            for give in (*gives, *pairs):
                if sum(give) in tried:
                    continue
                tried.add(sum(give))
                found = partner(a, sum(give))
                if found:
                    chosen = mine[give[0]][:2] if len(give) == 2 and give[0] == give[1] else [mine[n][0] for n in give]
                    exchange(a, chosen, found[0], [found[1]])
                    return True
            return False

        for b in under:
            note(b)
        steps = 0
        for a in under:
            while items[a] and free[a] and step(a):
                steps += 1
        return steps


def pack_lengths(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin and the offset there of each item."""
    bins = Bins(lengths, capacity)
    bins.best_fit()
    bins.local_search()
    bin_of, offset = [0] * len(lengths), [0] * len(lengths)
    number = 0
    for content in bins.items:
        if content:
            at = 0
            for i in content:
                bin_of[i], offset[i] = number, at
                at += lengths[i]
            number += 1
    return bin_of, offset


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, group: int = GROUP) -> DataFrame:
    """Pieces with sequence_id and offset; sequences never exceed ``capacity``.

    Null and very long texts and null or repeated doc_ids are as in ``pieces``;
    repeated rows are packed as often as they come; an empty table gives no rows.
    """
    cut = stored(_pieces(docs, tokenizer, capacity, end_id), "pieces")
    groups = max(1, -(-cut.count() // group))

    def fill(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = np.lexsort([table[c].to_numpy(zero_copy_only=False) for c in ("slot", "ids_crc32", "piece", "doc_id")])  # the same packing on each attempt
        table = table.take(pa.array(order))
        bin_of, offset = pack_lengths(table["length"].to_pylist(), capacity)
        base = (table["group"][0].as_py() if len(table) else 0) << 32
        ids = [base + b for b in bin_of]
        return table.drop_columns(["group", "slot"]).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = cut.withColumn("group", F.pmod(F.xxhash64("slot"), F.lit(groups)).cast("long"))
    return dealt.groupBy("group").applyInArrow(fill, PACKED)
