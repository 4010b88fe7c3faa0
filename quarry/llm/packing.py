"""Packing documents into sequences of CAPACITY tokens by bin completion, over counts of lengths.

Which document has a length doesn't matter to the packing, only how many have it. So the lengths' counts (at
most CAPACITY of them, from all pieces) are packed on the driver, and the plan is dealt back to the pieces by their
place among those of their length. The plan's size is bounded by the capacity, whatever the corpus holds.

The search is exact if it ends: its fillings are all the undominated ones, and each is tried as often as the counts
allow and every number of times below that. As bin packing has no known fast exact way, the search takes a budget of
nodes (None: none); the plan says how many sequences there are, a proven lower bound, and whether it is proven least.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, pick, slots_in_order
from quarry.llm.encode import encoder, forget

CAPACITY, NODES = 4096, 1_000
Pattern = tuple[tuple[int, ...], int]  # lengths in descending order; how many sequences are so


#: States that the search remembers at most.
SEEN = 200_000


@dataclass
class Plan:
    patterns: list[Pattern]
    bins: int
    bound: int  # no packing has fewer
    proven: bool  # whether no packing has fewer than bins


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing, many equal items at a time: bins are kept as (contents, how many) by the room left."""
    rooms: dict[int, list[list]] = {}
    order: list[int] = []  # rooms in use, ascending

    def put(room: int, contents: tuple, n: int) -> None:
        if room not in rooms:
            rooms[room] = []
            order.insert(bisect_right(order, room), room)
        rooms[room].append([contents, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_right(order, length - 1)
            if k == len(order):
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * length, ((length, each),), full)
                if rest:
                    put(capacity - rest * length, ((length, rest),), 1)
                break
            room = order[k]
            contents, n = rooms[room].pop()
            each = room // length
            take = min(n, left // each)
            if take:
                if n > take:
                    rooms[room].append([contents, n - take])
                used, now = each, take
            else:
                if n > 1:
                    rooms[room].append([contents, n - 1])
                used, now = left, 1
            if not rooms[room]:
                del rooms[room]
                order.pop(k)
            left -= used * now
            put(room - used * length, (*contents, (length, used)), now)
    return [(tuple(x for x, k in contents for _ in range(k)), n) for groups in rooms.values() for contents, n in groups]


def best_fit_bins(have: list[int], lengths: list[int], capacity: int) -> int:
    """How many bins best_fit() takes of have[x] items of each length x of lengths (descending), without their contents.

    Bins with equal room are alike to it, so only their number by room is kept, and rooms that no item fits are dropped.
    """
    number, order, bins = [0] * (capacity + 1), [], 0  # bins by room; rooms in use, ascending
    least = next((x for x in reversed(lengths) if have[x]), 0)

    def put(room: int, n: int) -> None:
        if room >= least:
            if not number[room]:
                order.insert(bisect_left(order, room), room)
            number[room] += n

    for length in lengths:
        left = have[length]
        while left:
            k = bisect_left(order, length)
            if k == len(order):
                each = capacity // length
                full, rest = divmod(left, each)
                bins += full
                if full:
                    put(capacity - each * length, full)
                if rest:
                    bins += 1
                    put(capacity - rest * length, 1)
                break
            room = order[k]
            each = room // length
            now = min(number[room], left // each)
            used = each if now else left
            now = now or 1
            number[room] -= now
            if not number[room]:
                order.pop(k)
            left -= used * now
            put(room - used * length, now)
    return bins


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The L2 bound: for each size, large items need bins of their own and the others the room that is left."""
    lengths = sorted(counts)
    number, total = np.asarray([counts[x] for x in lengths], dtype=np.int64), 0
    sizes = np.asarray(lengths, dtype=np.int64)
    best = -(-int((sizes * number).sum()) // capacity)
    for alpha in [0, *[x for x in lengths if 2 * x <= capacity]]:
        alone, half = sizes > capacity - alpha, (sizes > capacity // 2) & (sizes <= capacity - alpha)
        small = (sizes >= alpha) & (sizes <= capacity // 2)
        n2 = int(number[half].sum())
        room = n2 * capacity - int((sizes * number)[half].sum())
        total = int(number[alone].sum()) + n2 + max(0, -(-(int((sizes * number)[small].sum()) - room) // capacity))
        best = max(best, total)
    return best


class Spent(Exception):
    """The search's budget is used up."""


def completions(have: list[int], lengths: list[int], first: int, capacity: int, slack: int, step: Callable[[], None] = lambda: None) -> Iterator[tuple[int, ...]]:
    """Undominated fillings around an item of length `first` with a waste of at most slack, those with longer items first.

    have[x] says how many items of length x there are; lengths has all lengths in descending order. A filling is
    dominated if an unused item fits beside it, or if one of its items could be swapped for a longer unused one that
    still fits; another filling is then at least as good. Fillings are made one by one, as they are asked for, and have
    is as it was whenever one is given; step() is called for each place tried and may raise Spent.
    """
    chosen: list[int] = []
    room, tried = capacity - first, [0]  # the next length to try at each depth

    def take(n: int) -> None:
        for x in (first, *chosen):
            have[x] -= n

    def dominated() -> bool:
        for x in set(chosen):
            k = bisect_left_desc(lengths, x + room, 0)
            while lengths[k] > x:
                if have[lengths[k]] > 0:
                    return True
                k += 1
        return any(have[y] > 0 for y in lengths[bisect_left_desc(lengths, room, 0) :])

    take(1)
    while tried:
        step()
        k = bisect_left_desc(lengths, room, tried[-1])
        while k < len(lengths) and not have[lengths[k]]:
            k += 1
        if k < len(lengths):
            x = lengths[k]
            tried[-1] = k + 1
            tried.append(k)
            chosen.append(x)
            have[x] -= 1
            room -= x
            continue
        if room <= slack and not dominated():
            take(-1)
            yield (first, *chosen)
            take(1)
        tried.pop()
        if chosen:
            have[chosen[-1]] += 1
            room += chosen.pop()
    take(-1)


def bisect_left_desc(lengths: list[int], most: int, at: int) -> int:
    """The first place from `at` in descending lengths that holds `most` or less."""
    low, high = at, len(lengths)
    while low < high:
        mid = (low + high) // 2
        if lengths[mid] > most:
            low = mid + 1
        else:
            high = mid
    return low


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = NODES) -> Plan:
    """Best-fit decreasing is the first incumbent; if it is above the bound, depth-first branch and bound fills the bin
    of the largest item left with each undominated filling in turn, and leaves a branch when the waste so far can't
    beat the incumbent. At each node best-fit of what is left may better the incumbent. A filling is repeated as often
    as the counts allow, then fewer times. `nodes` bounds the nodes, and a hundred times as many steps of their fillings;
    with None the search runs to its end and the plan is proven least.
    """
    counts = {x: n for x, n in counts.items() if n > 0}
    if not counts:
        return Plan([], 0, 0, True)
    if max(counts) > capacity or min(counts) < 1:
        raise ValueError("an item is longer than a sequence, or empty")
    best = best_fit(counts, capacity)
    most = sum(n for _, n in best)
    bound, total = lower_bound(counts, capacity), sum(x * n for x, n in counts.items())
    opened = steps = 0

    def step() -> None:
        nonlocal steps
        steps += 1
        if nodes is not None and steps > 100 * nodes:
            raise Spent

    lengths = sorted(counts, reverse=True)
    left = [0] * (capacity + 1)  # one table for all nodes, changed on the way down and put back on the way up
    for x, n in counts.items():
        left[x] = n
    made: list[Pattern] = []
    bins = waste = 0

    def fillings() -> Iterator[tuple[tuple[int, ...], int]]:
        """(filling, times) to try at a node."""
        first = next(x for x in lengths if left[x])
        for filling in completions(left, lengths, first, capacity, (most - 1) * capacity - total - waste, step):
            each = min(left[x] // filling.count(x) for x in set(filling))
            for times in range(each, 0, -1):
                step()
                yield filling, times

    def use(filling: tuple[int, ...], times: int) -> None:
        nonlocal bins, waste
        for x in filling:
            left[x] -= times
        bins, waste = bins + times, waste + (capacity - sum(filling)) * times

    stack = [fillings()] if most > bound else []
    seen: set[tuple[int, bytes]] = set()
    while stack and most > bound:
        try:
            found = next(stack[-1], None)
        except Spent:
            return Plan(best, most, bound, False)
        if nodes is not None and opened >= nodes:
            return Plan(best, most, bound, False)
        if found is None:
            stack.pop()
            if made:
                filling, times = made.pop()
                use(filling, -times)
            continue
        filling, times = found
        if waste + (capacity - sum(filling)) * times > (most - 1) * capacity - total:
            continue
        use(filling, times)
        state = (bins, xxhash.xxh3_128_digest(array("q", left).tobytes()))
        if state in seen:  # the same items are left after as many sequences
            use(filling, -times)
            continue
        if len(seen) < SEEN:
            seen.add(state)
        opened += 1
        made.append(found)
        rest = best_fit_bins(left, lengths, capacity)
        if bins + rest < most:
            best, most = [*made, *best_fit({x: left[x] for x in lengths if left[x]}, capacity)], bins + rest
        if rest:
            stack.append(fillings())
        else:
            made.pop()
            use(filling, -times)
    return Plan(best, most, bound, True)


def dealt(patterns: list[Pattern]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """For each length: where runs of places begin, and the first sequence and the offset of each run.

    The piece of that length at place p of a run that begins at s is in sequence first + p - s, at the run's offset.
    """
    out: dict[int, tuple[list[int], list[int], list[int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for lengths, n in patterns:
        at = 0
        for x in lengths:
            starts, firsts, offsets = out.setdefault(x, ([], [], []))
            starts.append(taken.get(x, 0))
            firsts.append(base)
            offsets.append(at)
            taken[x] = taken.get(x, 0) + n
            at += x
        base += n
    return out


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and with_ids the ids (little-endian unsigned 32-bit) of each piece.

    A document is its whole text's ids, then end_id; only one longer than capacity is cut. Null text is empty.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[tuple] = []
                for doc, raw in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist()), strict=True):
                    ids = raw + end
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[a : a + 4 * capacity]
                        rows.append((doc, k, a // 4, len(piece) // 4, zlib.crc32(piece), piece)[: len(schema)])
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = pick(docs, doc_id=key, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int | None = NODES) -> DataFrame:
    """pieces with sequence_id and offset, and n_sequences, least_sequences (the bound) and proven, alike in all rows.

    pieces has doc_id, piece, start, length (1 to capacity), ids_crc32 and maybe more.

    Places within a length are dealt over many tasks, so a length that a third of the pieces share is no bottleneck.
    An empty table gives an empty one. Rows that repeat a document are packed each. The search hangs on the counts alone,
    so the driver searches while the executors find the places.
    """
    with ThreadPoolExecutor(1) as beside:
        searched: list[Future[Plan]] = []

        def search(rows: DataFrame) -> None:
            counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
            searched.append(beside.submit(bin_completion, counts, capacity, nodes))

        placed = slots_in_order(pieces, "length", ["doc_id", "piece", "ids_crc32"], "_place", "pieces", search)
        placed = materialize(placed, "pieces-placed")
        plan = searched[0].result()
    runs = {x: tuple(np.asarray(y, dtype=np.int64) for y in v) for x, v in dealt(plan.patterns).items()}
    names = pieces.columns
    spec = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            sequence, offset = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            length, place = batch.column("length").to_numpy(), batch.column("_place").to_numpy()
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                starts, firsts, offsets = runs[x]
                k = np.searchsorted(starts, place[at], side="right") - 1
                sequence[at], offset[at] = firsts[k] + place[at] - starts[k], offsets[k]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    told = {"n_sequences": F.lit(plan.bins).cast("long"), "least_sequences": F.lit(plan.bound).cast("long"), "proven": F.lit(plan.proven)}
    return placed.mapInArrow(assign, spec).withColumns(told)


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False, nodes: int | None = NODES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset of every piece of every document, and what pack() tells of the plan."""
    return pack(pieces_of(docs, tokenizer, end_id, capacity, key, text, with_ids), capacity, nodes)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the sequences themselves, from packed documents with ids. A sequence is bounded by its capacity."""
    each = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x"), F.sum("length").alias("length"))
    joined = F.aggregate("x", F.lit(b"").cast("binary"), lambda s, y: F.concat(s, y["ids"]))
    return each.select("sequence_id", "length", joined.alias("ids"))
