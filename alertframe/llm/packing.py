"""Best-fit packing by bin completion.

Documents become token pieces of at most `size` tokens: full pieces are a sequence each, so only a document's one
shorter piece has to be packed. What packs depends on lengths alone, so the corpus is reduced to a histogram of at
most `size` - 1 counts, and a plan of fillings (a filling: lengths that share a sequence, and how often it is used)
is made from that: its size is bounded by `size`, never by the number of documents. Pieces then find their place
from their rank among the pieces of their length.

Plan: branch and bound. The largest length left is completed by the undominated fillings around it, of any number of
pieces, the fullest of the fewest pieces first; a branch ends when its waste rules out beating the incumbent. Incumbents are best-fit decreasing
plans, of the whole and now and then of what a branch has left. If the search's nodes run out, the incumbent stands;
over_bound states how many sequences it has above the lower bound (0: it is proven best).

Defined results: a null or empty text is its end id alone; repeated rows are packed one by one; a null doc_id is
kept; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, write_table
from .kernels import pieces as slices
from .kernels import utf8
from .tokens import encoder, vocab_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
Plan = list[tuple[tuple[int, ...], int]]


def cut_pieces(docs: DataFrame, size: int = 1024, end_id: int = 2, vocab: str | None = None) -> DataFrame:
    """A row per piece; rank counts the task's pieces (part) of the same length."""
    path = vocab or vocab_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for b in slices(batches, "text"):
            ids, off = encoder(path).encode(*utf8(b.column(1)))
            n = np.diff(off) + 1
            count = -(-n // size)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            first = n - (count - 1) * size
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * size)
            length = np.where(piece == 0, first[doc], size)
            tail = np.array([end_id], "<u4").tobytes()
            raw, begin = ids.astype("<u4", copy=False), off[:-1][doc] + start
            last = piece == count[doc] - 1
            crc = np.fromiter(
                (zlib.crc32(tail, zlib.crc32(raw[a : a + k - 1])) if z else zlib.crc32(raw[a : a + k]) for a, k, z in zip(begin.tolist(), length.tolist(), last.tolist(), strict=True)),
                np.int64, len(doc),
            )
            order = np.argsort(length, kind="stable")
            run_length = length[order]
            new = np.flatnonzero(np.diff(run_length, prepend=-1))
            within = np.empty(len(doc), np.int64)
            within[order] = np.arange(len(doc)) - np.repeat(new, np.diff(np.append(new, len(doc))))
            rank = within + seen[length]
            seen += np.bincount(length, minlength=size + 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(doc), part), pa.int32()), pa.array(rank)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
            )

    return docs.mapInArrow(run, PIECES)


def best_fit_decreasing(counts: np.ndarray, size: int) -> Plan:
    """Best-fit decreasing on counts per length; open bins with equal contents move together."""
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(size + 1)]
    for length in range(size, 0, -1):
        left = int(counts[length])
        for r in range(length, size + 1):
            if not left:
                break
            fit, groups, room[r] = r // length, room[r], []
            for content, times in groups:
                full = min(times, left // fit)
                if full:
                    room[r - fit * length].append((content + (length,) * fit, full))
                    left -= full * fit
                if full < times and left:
                    room[r - left * length].append((content + (length,) * left, 1))
                    full, left = full + 1, 0
                if full < times:
                    room[r].append((content, times - full))
        if left:
            fit = size // length
            if left // fit:
                room[size - fit * length].append(((length,) * fit, left // fit))
            if left % fit:
                room[size - left % fit * length].append(((length,) * (left % fit), 1))
    return [g for groups in room for g in groups]


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Sequences that any packing needs: all lengths above size - k alone, those above size / 2 apart, and what lengths of
    k and more don't find room for beside them, at its largest over k."""
    lengths = np.arange(len(counts))
    amount = np.cumsum(counts * lengths)  # tokens in lengths up to each
    number = np.cumsum(counts)
    best, half = 0, size // 2
    for k in range(half + 1):
        alone = int(number[-1] - number[size - k])
        apart = int(number[size - k] - number[half])
        room = apart * size - int(amount[size - k] - amount[half])
        small = int(amount[half] - (amount[k - 1] if k else 0))
        best = max(best, alone + apart + max(0, -(-(small - room) // size)))
    return best


class Completions:
    """The undominated fillings of a room, lazily.

    A filling is dominated if a length that it leaves out could take the place of some of its pieces, or stand beside
    them, in the same room: the pieces it displaces would then fit wherever that one would have gone.
    """

    def __init__(self, counts: np.ndarray, room: int, steps: list[int]) -> None:
        """steps[0] is what the search may still spend; enumeration ends when it is used up."""
        self.steps = steps
        self.lengths, self.room = [int(x) for x in np.flatnonzero(counts[: room + 1]) if x], room
        self.left = {x: int(counts[x]) for x in self.lengths}
        self.spare = sum(1 << x for x in self.lengths)
        self.sums = [1]  # sums[p]: bit s is set if p pieces, however often a length is used, can make s

    def _may(self, p: int, total: int) -> bool:
        while len(self.sums) <= p:
            bits = 0
            for x in self.lengths:
                bits |= self.sums[-1] << x
            self.sums.append(bits & (1 << self.room + 1) - 1)
        return bool(self.sums[p] >> total & 1)

    def within(self, waste: int, price: int) -> Iterator[tuple[int, ...]]:
        """Fillings that waste no more, by their waste and `price` for each piece: small pieces are what later bins lack."""
        waste, most = min(waste, self.room), self.room // self.lengths[0] if self.lengths else 0
        for cost in range(waste + price * most + 1):
            if self.steps[0] <= 0:
                return
            for p in range(min(most, cost // price) + 1):
                lost = cost - price * p
                if lost <= waste and self._may(p, self.room - lost):
                    yield from self._exact(self.room - lost, p, len(self.lengths), (), 1, 0, self.spare, lost)

    def _exact(self, total: int, p: int, k: int, taken: tuple[int, ...], any_: int, many: int, spare: int, waste: int) -> Iterator[tuple[int, ...]]:
        """p more pieces, of the first k lengths. any_, many: sums of subsets of taken, and of two or more of them; spare:
        lengths that are left over."""
        self.steps[0] -= 1
        if not p:
            if not any(any_ << w & spare for w in range(1, waste + 1)):
                yield taken
            return
        for j in range(bisect.bisect_right(self.lengths, total, 0, k) - 1, -1, -1):
            x = self.lengths[j]
            if x * p < total or self.steps[0] <= 0:
                return
            used = taken.count(x) + 1
            if used > self.left[x] or not self._may(p - 1, total - x):
                continue
            now = many | (any_ ^ 1) << x
            over = spare & ~(1 << x) if used == self.left[x] else spare
            if not now & over:  # else all that hold these are dominated
                yield from self._exact(total - x, p - 1, j + 1, (*taken, x), any_ | any_ << x, now, over, waste)


def plan_bins(counts: np.ndarray, size: int = 1024, nodes: int = 30_000) -> Plan:
    """Fillings with their times for counts[length] pieces of each length, by bin completion.

    For numbers of sequences at the lower bound and 1, 2, 4, ... above it, below the incumbent's, the waste that each
    allows bounds a search. Every undominated filling, and every number of times down from the most, is tried in turn; bin packing
    being NP-hard, a number is given up after `nodes` steps, and lower_bound() tells how far off the result may be.
    """
    counts = np.asarray(counts, np.int64)
    best, least = best_fit_decreasing(counts, size), lower_bound(counts, size)
    most, above = sum(t for _, t in best), 0
    while least + above < most:
        for price in (size // 100 + 1, size // 32 + 1):  # two orders of trying
            if plan := _search(counts, size, least + above, nodes, price):
                return plan
        above = max(1, 2 * above)
    return best


def _search(counts: np.ndarray, size: int, bins: int, nodes: int, price: int) -> Plan | None:
    """A plan of that many bins."""
    steps = [nodes]
    allowed = bins * size - int((counts * np.arange(len(counts))).sum())

    def children(c: np.ndarray, waste: int) -> Iterator[tuple[tuple[int, ...], int]]:
        top = int(np.flatnonzero(c)[-1])
        rest = c.copy()
        rest[top] -= 1
        for f in Completions(rest, size - top, steps).within(waste, price):
            need = np.bincount((top, *f), minlength=len(c))
            lost = size - top - sum(f)
            most = int((c[need > 0] // need[need > 0]).min())
            for times in range(min(most, waste // lost) if lost else most, 0, -1):
                yield (top, *f), times

    if allowed < 0:
        return None
    stack = [(counts, allowed, children(counts, allowed))]  # depth first: counts left, waste left, fillings to try
    plan: Plan = []
    tried = 0
    while stack and steps[0] > 0:
        c, waste, rest = stack[-1]
        step = next(rest, None)
        if step is None:
            stack.pop()
            del plan[len(stack) - 1 :]
            continue
        tried, steps[0] = tried + 1, steps[0] - 10
        del plan[len(stack) - 1 :]
        plan.append(step)
        f, times = step
        left = c.copy()
        np.subtract.at(left, list(f), times)
        if not left.any():
            return plan
        waste -= times * (size - sum(f))
        if tried % 64 == 0:  # a best-fit finish may do already
            finish = best_fit_decreasing(left, size)
            if sum(t for _, t in plan) + sum(t for _, t in finish) <= bins:
                return plan + finish
        stack.append((left, waste, children(left, waste)))
    return None


def place_table(plan: Plan) -> tuple[np.ndarray, ...]:
    """Per length and stretch of ranks: length, first rank, pieces per bin, first bin, offset of the first piece."""
    rows, given, first_bin = [], {}, 0
    for filling, times in plan:
        offset = 0
        for length in dict.fromkeys(filling):
            m = filling.count(length)
            rows.append((length, given.get(length, 0), m, first_bin, offset))
            given[length] = given.get(length, 0) + m * times
            offset += m * length
        first_bin += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return tuple(cols)


def pack(docs: DataFrame, size: int = 1024, end_id: int = 2, vocab: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per piece with its sequence and offset. Odd sequence ids are full pieces, even ones are planned bins."""
    cut, _ = write_table(cut_pieces(id_text(docs, text, key), size, end_id, vocab), "pieces")
    short = cut.filter(F.col("length") < size)
    sizes = short.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(size + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # size - 1 rows at most
        counts[r.length] = r.n
    plan = plan_bins(counts, size)
    over = sum(t for _, t in plan) - lower_bound(counts, size)
    length, first, per_bin, first_bin, offset = place_table(plan)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    full = cut.filter(F.col("length") == size).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (((F.col("part").cast("long") * (1 << 38)) + F.col("rank")) * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    ranked = short.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = 1 << 50
        steps = length * shift + first
        for b in batches:
            size_of, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            k = np.searchsorted(steps, size_of * shift + rank, "right") - 1
            q = rank - first[k]
            bins, slot = first_bin[k] + q // per_bin[k], q % per_bin[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(2 * bins), pa.array(offset[k] + slot * size_of)], names=[f.split()[0] for f in PACKED.split(", ")])

    return ranked.mapInArrow(run, PACKED).unionByName(full).withColumn("over_bound", F.lit(over).cast("long"))
