"""Problem 8: texts into containers of a fixed number of tokens, with as little room left as can be found.

Sizes are whole numbers of at most the capacity, so however many texts there are, the problem is a histogram of
at most `capacity` counts. It is packed by bin completion: a container is built around the largest text left, the
fillings of its room that no other filling dominates are enumerated one by one, least waste first, a filling is used
for as many containers as the counts allow (or for one), and a branch is cut once the room it has wasted rules out
beating the best packing known. Best-fit packing gives the first incumbent. The result is a list of patterns; texts
find their container by their rank among those of equal size, which is worked out in ranges. Several capacities are
packed side by side, each search its own task.

`nodes` is the work the search may do (None: it goes on until the packing is proved to be the best).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.tokenizer import TOKENIZERS, count_tokens
from corvane.session import Workspace

Pattern = tuple[tuple[int, int], ...]  # (size, how many) of one container
NODES = 30_000  # containers tried by the search, over all branches; 500 steps of an enumeration count as one
FRESH = 256  # up to so many sizes the attainable sums are worked out anew for each container
MEMO = 2_000_000  # states remembered as searched; beyond that states are searched again


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Containers no packing can do without: by volume, and by what cannot share (the bound L2)."""
    sizes = sorted(counts)
    best = -(-sum(s * c for s, c in counts.items()) // capacity)
    for k in [0, *[s for s in sizes if s <= capacity // 2]]:
        big = sum(counts[s] for s in sizes if s > capacity - k)
        mid = [s for s in sizes if capacity // 2 < s <= capacity - k]
        n_mid = sum(counts[s] for s in mid)
        small = sum(s * counts[s] for s in sizes if k <= s <= capacity // 2)
        room = n_mid * capacity - sum(s * counts[s] for s in mid)
        best = max(best, big + n_mid + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing, on groups of equal containers."""
    rooms: list[int] = []  # sorted rooms that some group has
    groups: dict[int, list[tuple[Pattern, int]]] = {}

    def put(room: int, pattern: Pattern, n: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((pattern, n))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                pattern, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(i)
            else:
                room, pattern, n = capacity, (), -(-left // (capacity // s))
            m = room // s
            full = min(n, left // m)
            if full:
                put(room - m * s, (*pattern, (s, m)), full)
                n, left = n - full, left - full * m
            if n and 0 < left < m:
                put(room - left * s, (*pattern, (s, left)), 1)
                n, left = n - 1, 0
            if n and pattern:
                put(room, pattern, n)
    return [g for room in sorted(groups) for g in groups[room]]


def attainable(sizes: list[int], left: dict[int, int], capacity: int) -> list[int]:
    """For each i a bit set of the sums up to the capacity that the sizes from the i-th on can give. sizes: descending."""
    full, sums, bits = (1 << (capacity + 1)) - 1, [0] * (len(sizes) + 1), 1
    sums[len(sizes)] = bits
    for i in range(len(sizes) - 1, -1, -1):
        s = sizes[i]
        rest, step = min(left[s], capacity // s), 1
        while rest:
            m = min(step, rest)
            bits |= bits << (m * s) & full
            rest, step = rest - m, step * 2
        sums[i] = bits
    return sums


def fillings(room: int, sizes: list[int], left: dict[int, int], sums: list[int] | None = None, waste: int | None = None, work: list[int] | None = None) -> Iterator[Pattern]:
    """Undominated fillings of the room, one by one, least waste first and large texts first. sizes: descending.

    A filling is dominated if a text that is left over would still fit, or if one of its texts could be swapped for
    a larger one that is left over. sums: attainable() of the sizes, perhaps of an earlier, fuller state. waste: the
    most room that may stay free. work: [steps that are left]; the enumeration ends when they are used up.
    """
    sums = attainable(sizes, left, room) if sums is None else sums
    work = [1 << 62] if work is None else work

    def undominated(used: Pattern, slack: int) -> bool:
        held = dict(used)
        for s in reversed(sizes):
            if s > slack:
                break
            if left[s] > held.get(s, 0):
                return False
        for x in held:
            i = bisect_left(sizes, -x, key=lambda s: -s) - 1
            while i >= 0 and sizes[i] - x <= slack:
                if left[sizes[i]] > held.get(sizes[i], 0):
                    return False
                i -= 1
        return True

    def exactly(i: int, target: int, used: Pattern) -> Iterator[Pattern]:
        if not target:
            yield used
            return
        i = max(i, bisect_left(sizes, -target, key=lambda s: -s))
        while i < len(sizes) and sums[i] >> target & 1 and work[0] > 0:
            work[0] -= 1
            s = sizes[i]
            for m in range(min(target // s, left[s]), 0, -1):
                if sums[i + 1] >> (target - m * s) & 1:
                    yield from exactly(i + 1, target - m * s, (*used, (s, m)))
            i += 1

    for slack in range(min(room, room if waste is None else waste) + 1):
        if work[0] <= 0:
            return
        for used in exactly(0, room - slack, ()):
            if undominated(used, slack):
                yield used


def complete(counts: dict[int, int], capacity: int, nodes: int | None = NODES) -> list[tuple[Pattern, int]]:
    """Bin completion; the best packing found within so much work, best-fit decreasing if none is better."""
    counts = {s: c for s, c in counts.items() if s > 0 and c > 0}
    if not counts:
        return []
    best = best_fit(counts, capacity)
    best_n, floor = sum(n for _, n in best), lower_bound(counts, capacity)
    if best_n == floor:
        return best
    total = sum(s * c for s, c in counts.items())
    work = [1 << 62 if nodes is None else nodes * 500]
    rng = np.random.default_rng(1)
    mark = {s: int(x) for s, x in zip(counts, rng.integers(1, 1 << 62, len(counts)))}
    left, sizes, chosen, used, placed, state = dict(counts), sorted(counts, reverse=True), [], 0, 0, 0
    every = sums_of = None  # attainable sums, and the sizes they are for
    seen: set[tuple[int, int]] = set()

    def take(pattern: Pattern, sign: int, t: int) -> None:
        nonlocal used, placed, state
        for s, m in pattern:
            before = left[s]
            left[s] -= sign * m * t
            if before and not left[s]:
                sizes.pop(bisect_left(sizes, -s, key=lambda x: -x))
            elif left[s] and not before:
                sizes.insert(bisect_left(sizes, -s, key=lambda x: -x), s)
            state += sign * m * t * mark[s]
        used += sign * t
        placed += sign * t * sum(s * m for s, m in pattern)

    def around(s: int, sums_of_all: list[int] | None) -> Iterator[Pattern]:
        """The fillings of the room beside one text of size s, within the waste that is still allowed."""
        nonlocal every, sums_of
        now = sizes if left[s] > 1 else [x for x in sizes if x != s]
        count = dict(left)
        count[s] -= 1
        if sums_of_all is not None:
            sums = sums_of_all if len(now) == len(sizes) else [x for x, y in zip(sums_of_all, sizes) if y != s] + [1]
        else:
            if every is None:
                sums_of = sorted(counts, reverse=True)
                every = attainable(sums_of, counts, capacity)
            at = {x: i for i, x in enumerate(sums_of)}
            sums = [every[at[x]] for x in now] + [1]
        allowance = (best_n - 1) * capacity - total - (used * capacity - placed)
        return fillings(capacity - s, list(now), count, sums, allowance, work)

    def choices() -> Iterator[tuple[Pattern, int]]:
        """Containers around one text, each for as many as the counts allow, then for one.

        The text is the largest left; while there are few sizes and hardly any waste is allowed, the one with the
        fewest fillings. Any text may be chosen: it has to go somewhere.
        """
        s, sums = sizes[0], None
        if len(sizes) <= FRESH:
            sums = attainable(sizes, left, capacity)
            if (best_n - 1) * capacity - total - (used * capacity - placed) < capacity // 20:
                fewest = 1 << 30
                for x in sizes:
                    n = sum(1 for _ in islice(around(x, sums), fewest))
                    if n < fewest:
                        s, fewest = x, n
                        if not n:
                            return
        for f in around(s, sums):
            held = {s: 1}
            for x, m in f:
                held[x] = held.get(x, 0) + m
            p = tuple(held.items())
            t = min(left[x] // m for x, m in p)
            yield p, t
            if t > 1:
                yield p, 1

    stack: list[tuple[Iterator, tuple[Pattern, int] | None]] = [(choices(), None)]
    while stack and best_n > floor and work[0] > 0:
        options, undo = stack[-1]
        if undo:
            chosen.pop()
            take(undo[0], -1, undo[1])
            stack[-1] = (options, None)
        option = next(options, None)
        if option is None:
            stack.pop()
            continue
        work[0] -= 500
        take(option[0], 1, option[1])
        chosen.append(option)
        stack[-1] = (options, option)
        if not sizes:
            if used < best_n:
                best_n, best = used, list(chosen)
        elif used + -(-(total - placed) // capacity) < best_n and (state, used) not in seen:
            if len(seen) < MEMO:
                seen.add((state, used))
            stack.append((choices(), None))
    return best


def _pieces(capacity: Column) -> Column:
    """The sizes of a text's pieces: the whole text, or full pieces and a rest."""
    n = F.col("n_tokens")
    rest = F.when(n % capacity > 0, F.array((n % capacity).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n <= capacity, F.array(n)).otherwise(F.concat(F.array_repeat(capacity.cast("bigint"), F.floor(n / capacity).cast("int")), rest))


def pack_all(df: DataFrame, budgets: dict[str, int], key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS, nodes: int | None = NODES) -> DataFrame:
    """(budget_name, key, piece, tokens, container_id): for each budget every text in a container of its capacity.

    A text is split only if it is larger than the capacity, into full pieces and one rest. Null and empty texts
    take no room and share container 0. No container holds more than the capacity. An empty table gives none.
    What comes to the driver are the patterns, whose number is bounded by the capacity, however many texts there are.
    """
    ws = Workspace(df.sparkSession, "packing")
    counted = ws.save(count_tokens(df, [key], text, name, folder), "tokens")  # the range partitioner reads its input twice
    budget = F.explode(F.array(*[F.struct(F.lit(b).alias("budget_name"), F.lit(int(c)).cast("bigint").alias("capacity")) for b, c in budgets.items()]))
    each = counted.select(key, "n_tokens", budget.alias("b")).select("b.budget_name", "b.capacity", key, "n_tokens")
    items = each.select("budget_name", key, F.posexplode(_pieces(F.col("capacity"))).alias("piece", "size"))
    at = ("budget_name", "size")
    items = items.repartitionByRange(*at, key, "piece").select(*at, key, "piece", F.spark_partition_id().alias("pid"))
    items = ws.save(items, "items")
    per = ws.save(items.groupBy(*at, "pid").agg(F.count(F.lit(1)).alias("n")), "counts")

    def search(t: pa.Table) -> pa.Table:
        b = t.column("budget_name")[0].as_py()
        packing = complete(dict(zip(t.column("size").to_pylist(), t.column("n").to_pylist())), budgets[b], nodes)
        rows = _intervals(packing)
        return pa.table({"budget_name": pa.array([b] * len(rows), pa.string()), **{c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(("size", "low", "base", "each"))}})

    whole = per.groupBy(*at).agg(F.sum("n").alias("n"))  # at most capacity + 1 rows a budget
    found = whole.groupBy("budget_name").applyInArrow(search, "budget_name string, size bigint, low bigint, base bigint, each bigint").toArrow()
    patterns = {}
    for b in budgets:
        mine = found.filter(pa.compute.equal(found.column("budget_name"), b))
        patterns[b] = tuple(mine.column(c).to_numpy() for c in ("size", "low", "base", "each"))
    before = per.select(*at, "pid", (F.sum("n").over(W.partitionBy(*at).orderBy("pid")) - F.col("n")).alias("before"))
    rank = F.row_number().over(W.partitionBy(*at, "pid").orderBy(key, "piece")) - 1
    ranked = items.withColumn("rn", rank).join(before, [*at, "pid"]).select("budget_name", key, "piece", "size", (F.col("rn") + F.col("before")).alias("rank"))
    fields = dict(ranked.dtypes)
    shared = df.sparkSession.sparkContext.broadcast(patterns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            box = np.zeros(batch.num_rows, dtype=np.int64)
            names = np.asarray(batch.column("budget_name").to_pylist(), dtype=object)
            for b, (s, low, base, each) in shared.value.items():
                rows = np.flatnonzero(names == b)
                if len(rows) and len(s):
                    size, r = batch.column("size").to_numpy()[rows], batch.column("rank").to_numpy()[rows]
                    i = np.maximum(np.searchsorted(s << 40 | low, size << 40 | r, side="right") - 1, 0)
                    box[rows] = np.where(size > 0, base[i] + (r - low[i]) // each[i], 0)
            yield pa.RecordBatch.from_arrays([batch.column("budget_name"), batch.column(key), batch.column("piece"), batch.column("size"), pa.array(box, pa.int64())], names=["budget_name", key, "piece", "tokens", "container_id"])

    return ranked.mapInArrow(place, f"budget_name string, `{key}` {fields[key]}, piece int, tokens bigint, container_id bigint")


def pack(df: DataFrame, capacity: int, key: str = "doc_id", **options) -> DataFrame:
    """(key, piece, tokens, container_id): pack_all() for one capacity."""
    return pack_all(df, {"": capacity}, key, **options).drop("budget_name")


def _intervals(packing: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int]]:
    """(size, low, base, each): from rank `low` on, texts of the size go into the containers from `base` on, `each` in one."""
    rows, taken, boxes = [], {}, 0
    for p, t in packing:
        for s, m in p:
            low = taken.get(s, 0)
            rows.append((s, low, boxes, m))
            taken[s] = low + m * t
        boxes += t
    return sorted(rows)


def fill_report(packed: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """(budget_name, capacity, pieces, tokens, containers, bound, waste): bound is the least number of containers that
    the tokens fill, waste the share of room that stays free."""
    t = packed.groupBy("budget_name").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"), (F.max("container_id") + 1).alias("containers"))
    capacity = F.create_map(*[x for b, c in budgets.items() for x in (F.lit(b), F.lit(int(c)).cast("bigint"))])[F.col("budget_name")]
    t = t.withColumn("capacity", capacity)
    return t.select("budget_name", "capacity", "pieces", "tokens", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("bound"), F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("waste"))
