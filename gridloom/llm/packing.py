"""Packing token runs into sequences of a fixed length by bin completion.

Documents are encoded, an end id appended, and only those longer than a sequence are cut: into full pieces, the first
of which may be shorter. A piece is an item whose size is at most the capacity, so the whole corpus is a histogram
with at most ``capacity`` sizes, however many documents there are. Bin completion (branch and bound) runs over that
histogram: it takes the largest size left, enumerates the undominated fillings of the room beside it (a filling is
dominated if exchanging one of its items for a larger one, or adding one, still fits), prunes fillings whose waste
exceeds what the incumbent leaves to beat, and applies a filling to as many bins at once as its counts allow. Best-fit
decreasing gives the incumbent, the search replaces it where it needs fewer bins, and the lower bound (the total over
the capacity, and items that pair with nothing) ends it once met.

A plan (runs of equal bins) names bins for ranks of pieces of a size; the pieces are ranked by counts of input tasks
and sizes and their place in a task, so no size, however frequent, is gathered in one task.

Defined cases: a null text is empty, and so one piece with the end id alone; an id of a row that repeats is packed as
often as it comes; an empty table makes no sequence; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import chunks, places, shared_dir, stored, text_bytes
from gridloom.llm.tokens import encoder

#: Branches tried at each step of the first search; each further one tries twice as many, until a search has left out
#: no filling (it is complete then) or ``STEPS`` steps are spent, when the incumbent stands. They bound the driver's
#: time, not the documents. One enumeration of fillings looks at most at LOOKS sizes for each branch.
WIDTH, STEPS, LOOKS = 3, 6000, 500


def fillings(room: int, sizes: list[int], counts: dict[int, int], slack: int, width: int = 8) -> tuple[list[tuple[int, ...]], bool]:
    """Undominated fillings of ``room`` with at most ``slack`` waste, least waste first, and whether these are all.

    At most ``width`` are returned; eight times as many are looked for.

    ``sizes`` are in falling order. Depth-first, larger items first; only fillings to which nothing can be added count.
    """
    found: dict[tuple[int, ...], int] = {}
    have = set(sizes)
    falling = [-s for s in sizes]
    looks, whole = 0, True

    def grow(left: int, at: int, items: tuple[int, ...]) -> None:
        nonlocal looks, whole
        if left in have and counts[left] > items.count(left) and left <= (items[-1] if items else left):
            found[items + (left,)] = 0  # nothing dominates an exact filling but others of the same sum
        fits = False
        for k in range(max(at, bisect.bisect_left(falling, -left)), len(sizes)):
            s = sizes[k]
            if counts[s] <= items.count(s):
                continue
            fits = True
            looks += 1
            if looks > LOOKS * width or len(found) >= 8 * width:
                whole = False
                return
            if s != left:
                grow(left - s, k, items + (s,))
        if not fits and left <= slack:
            found.setdefault(items, left)

    grow(room, 0, ())
    out = [f for f, _ in sorted(found.items(), key=lambda x: (x[1], len(x[0]), tuple(-i for i in x[0])))]
    kept: list[tuple[int, ...]] = []
    for f in out:
        if not any(_dominates(g, f) for g in kept):
            kept.append(f)
    return kept[:width], whole and len(kept) <= width


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether ``a`` has, item for item from the largest, at least what ``b`` has (so ``b`` need not be tried)."""
    return a != b and len(a) >= len(b) and all(x >= y for x, y in zip(a, b))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over the histogram: ``(items of a bin, bins)`` runs."""
    left = dict(counts)
    plan: list[tuple[tuple[int, ...], int]] = []
    while left:
        top = max(left)
        items, room, used = [top], capacity - top, {top: 1}
        while room:
            nxt = max((s for s in left if s <= room and left[s] > used.get(s, 0)), default=0)
            if not nxt:
                break
            items.append(nxt)
            used[nxt] = used.get(nxt, 0) + 1
            room -= nxt
        n = min(left[s] // k for s, k in used.items())
        plan.append((tuple(items), n))
        for s, k in used.items():
            left[s] -= k * n
            if not left[s]:
                del left[s]
    return plan


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: the total, and large items with those that fit beside none of them."""
    half = capacity // 2
    n = np.zeros(capacity + 1, np.int64)
    n[list(counts)] = list(counts.values())
    upto, weight = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    total = -(-int(weight[-1]) // capacity)
    low = np.arange(1, half + 1)
    if not len(low):
        return max(total, int(upto[-1]))
    # Items above capacity - low have a bin each without room for others; those above the half have one with some room.
    alone, mid = upto[-1] - upto[capacity - low], upto[capacity - low] - upto[half]
    free = mid * capacity - (weight[capacity - low] - weight[half])
    small = weight[half] - weight[low - 1]
    return max(total, int((alone + mid + np.maximum(0, -(-(small - free) // capacity))).max()))


def bin_completion(counts: dict[int, int], capacity: int, width: int = WIDTH, steps: int = STEPS) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """``(plan, lower bound)`` of a packing of the histogram in as few bins as the search finds."""
    counts = {s: n for s, n in counts.items() if n}
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    best_n = sum(n for _, n in best)
    total = sum(s * n for s, n in counts.items())
    spent = 0

    def search(left: dict[int, int], plan: list, bins: int, waste: int, width: int) -> bool:
        """Depth first; True once the bound is met or nothing was left out."""
        nonlocal best, best_n, spent
        complete = True
        path: list[tuple[dict[int, int], list, int, int, list]] = [(left, plan, bins, waste, None)]
        while path:
            left, plan, bins, waste, todo = path.pop()
            if todo is None:
                if not left:
                    if bins < best_n:
                        best, best_n = list(plan), bins
                    if best_n <= bound:
                        return True
                    continue
                spent += 1
                # Bins below the incumbent leave so much room for waste.
                slack = (best_n - 1) * capacity - total - waste
                if spent > steps:
                    return False
                if slack < 0:
                    continue
                top = max(left)
                sizes = sorted(left, reverse=True)
                rest = {**left, top: left[top] - 1}
                todo, whole = fillings(capacity - top, sizes, rest, slack, width)
                complete &= whole
            if not todo:
                continue
            fill, more = todo[0], todo[1:]
            if more:
                path.append((left, plan, bins, waste, more))
            top = max(left)
            items = (top, *fill)
            used = {s: items.count(s) for s in set(items)}
            each = capacity - sum(items)
            n = min(left[s] // k for s, k in used.items())
            complete &= n == 1 or not more  # equal bins are filled together
            if each:  # wasteful bins a few at a time: sizes left later may fill better
                n = max(1, min(n, max(1, ((best_n - 1) * capacity - total - waste) // each)))
            nxt = {s: c - used.get(s, 0) * n for s, c in left.items()}
            path.append(({s: c for s, c in nxt.items() if c}, [*plan, (items, n)], bins + n, waste + each * n, None))
        return complete

    while best_n > bound and spent < steps and not search(dict(counts), [], 0, 0, width):
        width *= 2
    return best, bound


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """``(task, doc_id, piece, start, length, ids_crc32, ids, rank)``; ``rank`` counts the pieces of a length in a task."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        enc, task = encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            for lo, hi in chunks(off):
                ids, at = enc.encode(data, off[lo : hi + 1], end_id)
                # Full pieces of a document, the first of which may be shorter.
                n = np.diff(at)
                many = -(-n // capacity)
                doc = np.repeat(np.arange(hi - lo), many)
                piece = places(np.zeros(hi - lo, np.int64), many)
                length = np.where(piece == 0, (n - (many - 1) * capacity)[doc], capacity)
                begin = np.append(0, np.cumsum(length)[:-1])  # pieces follow each other without a gap
                raw = memoryview(ids.astype("<u4")).cast("B")
                cut = (4 * np.append(begin, len(ids))).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(cut, cut[1:])]
                slim = ids.astype(f"<u{width}").tobytes()
                cut = (width * np.append(begin, len(ids))).tolist()
                parts = [slim[a:b] for a, b in zip(cut, cut[1:])]
                # The place of a piece among those of its length in this task.
                order = np.argsort(length, kind="stable")
                of = length[order]
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(of)) - np.searchsorted(of, of) + seen[of]
                seen += np.bincount(length, minlength=capacity + 1)
                names = batch.column(0).slice(lo, hi - lo).take(pa.array(doc))
                cols = [pa.array(np.full(len(doc), task, np.int32)), names, pa.array(piece.astype(np.int32)), pa.array(begin - at[doc]), pa.array(length), pa.array(crc, pa.int64()), pa.array(parts, pa.binary()), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(cols, ["task", "doc_id", "piece", "start", "length", "ids_crc32", "ids", "rank"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "task int, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, rank long"
    )


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    capacity: int = 2048,
    vocabulary_size: int = 1 << 32,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(placed, tokens)``: where each piece lies, and the written ids of each piece.

    ``placed``: doc_id, piece, start, length, ids_crc32, sequence_id, offset. ``tokens``: doc_id, piece, ids (2-byte
    integers if the vocabulary allows it, else 4-byte). :func:`sequences` joins the two.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark)
    width = 2 if vocabulary_size <= 1 << 16 else 4
    tokens = stored(pieces(docs, vocabulary, end_id, capacity, width, id_col, text_col), f"{path}/tokens")
    # The ranks of a task's pieces of a length follow those of the tasks before; one row for each task and length.
    counts = tokens.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), f"{path}/bases")
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan, _ = bin_completion(histogram, capacity)

    # For each length, runs of ranks: where each begins, its first bin and its offset in the bin. Their number depends
    # on the capacity, not on the documents.
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    bins = 0
    for items, n in plan:
        offset = 0
        for s in items:
            lo = taken.get(s, 0)
            runs.setdefault(s, []).append((lo, bins, offset))
            taken[s] = lo + n
            offset += s
        bins += n
    shared = spark.sparkContext.broadcast({s: tuple(np.asarray(c, np.int64) for c in zip(*r)) for s, r in runs.items()})

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = shared.value
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            length, rank = cols["length"].to_numpy(), cols["rank"].to_numpy() + cols["base"].to_numpy()
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for s in np.unique(length):
                at = np.flatnonzero(length == s)
                lo, first, offset = table[int(s)]
                k = np.searchsorted(lo, rank[at], side="right") - 1
                seq[at], off[at] = first[k] + rank[at] - lo[k], offset[k]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(cols[n] for n in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    slim = tokens.select("task", "doc_id", "piece", "start", "length", "ids_crc32", "rank")
    # Not broadcast: there are as many rows as lengths and tasks, and tasks grow with the input.
    placed = slim.join(bases.select("length", "task", "base").hint("merge"), ["length", "task"]).mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return placed, tokens.select("doc_id", "piece", "ids")


def sequences(placed: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(sequence_id, n_tokens, ids)``: the packed sequences; a sequence gathers at most ``capacity`` ids."""
    rows = placed.join(tokens, ["doc_id", "piece"]).groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    return rows.select("sequence_id", "n_tokens", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
