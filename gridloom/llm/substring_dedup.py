"""Near-duplicate passages by compact windows.

A text is a row of 5-word shingles, and a passage a run of ``width`` of them (by default 46, that is 50 words). For a
hash function, all passages whose smallest hash lies at place c form a compact window: they start and end inside the
span of c's node in the Cartesian tree of the hashes. Only nodes at least ``width`` wide matter; those are the places
that are smallest in some passage, and the tree is built over them alone. Each window is one row: its key (its smallest
hash), the place of that hash, and the first and last passage that it stands for. ``BANDS`` hash functions are used:
equal passages always share all keys, those of similarity 0.75 at least one with a chance of 0.996.

Windows of one key that hold the same shingles at the same places are one: the smallest document's stands for them, and
the others are found whole in it. Those that are left are joined: each window of a key meets the key's window of the smallest
document. All that two documents have met in, whatever the hash function, is verified at once: the places of the shared
smallest hash align the two, and each passage of the window is compared with the aligned passage of the other document by
the Jaccard similarity of their full shingle sets. Windows that hold a passage for which no earlier document is found yet
meet all others of their key: directly where a key has at most ``FEW``, else through lists. Two passages that are similar
share one of the 12 rarest of their 46 shingles (of the 7 rarest, if no shingle repeats in either), so windows are listed
under their key and the rarest shingles of each passage. What holds the same in a list is one again; a window that asks
meets the window that holds the same, else the list's smallest document and what most of the list hold, then, for what is
left, all the others. Shingles that only one document has list nothing. What is rare is read off a sketch of fixed size; if
it is too small for an input, more windows meet and results stay the same. No pair of windows of a key that holds a
similar pair of aligned passages stays untested where that passage has no earlier partner yet, whatever the key's size.

The result has, for each document, the spans of words covered by passages that some document of smaller id holds.

Defined cases: null, empty and short texts (under 50 words) have no passage; a null id is ignored; rows that repeat an
id count as one document (the first by text); copies inside one document do not count; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import _powers, checked_broadcast, chunks, document_words, forget, mixed, places, release, shared_dir, shingle_hashes, stored, text_bytes, unique_ids

SHINGLE = 5
#: Words of the shortest passage.
WORDS = 50
BANDS = 4
#: Windows of a key that meet pair by pair.
FEW = 4
#: log2 of the cells of the sketch and the bits of the bitmap at most; cells in a part that is summed up in one row.
LG_CELLS, PART = 25, 1 << 16
#: A shingle counts as the rarer the fewer of these numbers of documents have it; fewer than the first: it has one alone.
LEVELS = (2, 4, 16, 128)
#: Requests for parts of one document that share a copy of its text.
PER_SALT = 256
#: Words of 64 bits that mark what a window holds.
MARKS = 16
#: Words that are held, and pairs of equal shingles that are counted, at once (a longer text or passage by itself).
AT_ONCE = 200_000

_RNG = np.random.default_rng(613)
_SEEDS = _RNG.integers(1, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value (of equals the first) in each run of ``width`` values."""
    n = len(h)
    low_bits = np.uint64((1 << max(20, n.bit_length())) - 1)
    tagged = (h & ~low_bits) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    pad = np.full(blocks * width, np.iinfo(np.uint64).max)
    pad[:n] = tagged
    pad = pad.reshape(blocks, width)
    up = np.minimum.accumulate(pad, axis=1).ravel()
    down = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(down[: n - width + 1], up[width - 1 : n]) & low_bits).astype(np.int64)


def _smaller_before(v: np.ndarray, equal: bool) -> np.ndarray:
    """For each value the place of the last one before it that is smaller (or ``equal``), -1 if there is none."""
    at, todo = np.arange(-1, len(v) - 1), np.arange(len(v))
    while True:
        todo = todo[at[todo] >= 0]
        todo = todo[v[at[todo]] > v[todo] if equal else v[at[todo]] >= v[todo]]
        if not len(todo):
            return at
        at[todo] = at[at[todo]]  # what lies between is larger still


def compact_windows(h: np.ndarray, width: int) -> np.ndarray:
    """Rows ``(left, place, right)``: nodes of the Cartesian tree of ``h`` that span at least ``width`` places, in order.

    All runs from left <= i <= place to place <= j <= right have their (first) minimum at ``place``.
    """
    if len(h) < width:
        return np.empty((0, 3), np.int64)
    at = _sliding_argmin(h, width)
    places = at[np.flatnonzero(np.diff(at, prepend=-1))]
    values = h[places]
    left = np.append(places, -1)[_smaller_before(values, True)] + 1
    right = np.append(places[::-1], len(h))[_smaller_before(values[::-1], False)][::-1] - 1
    return np.stack((left, places, right), axis=1)


def windows_of(shingles: np.ndarray, inside: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """``(keys, at, before, after)`` of the compact windows: key, place of the smallest hash, and how far before it the
    first and the last passage start.

    ``inside`` is false at places between documents, which no passage holds.
    """
    if len(shingles) < width:
        return (np.empty(0, np.int64),) * 4
    keys, cols = [], []
    for b in range(BANDS):
        # A place between documents is the minimum of all runs that hold it.
        h = np.where(inside, mixed(shingles ^ _SEEDS[b]) | np.uint64(1 << 63), np.uint64(0))
        left, place, right = compact_windows(h, width).T
        whole = inside[place]
        left, place, right = left[whole], place[whole], right[whole]
        keys.append(mixed(h[place] + np.uint64(b)))
        cols.append((place, place - np.maximum(left, place - width + 1), place - np.minimum(place, right - width + 1)))
    at, before, after = (np.concatenate(c) for c in zip(*cols))
    return np.concatenate(keys).astype(np.int64), at, before, after


def _windows(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, off = text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            for lo, hi in chunks(off, 1 << 18):
                words, first = document_words(data, off, lo, hi)
                if len(words) < width + SHINGLE - 1:
                    continue
                shingles = shingle_hashes(words, SHINGLE)
                n = np.diff(np.append(first, len(words)))
                inside = np.arange(len(words)) < np.repeat(first + n - SHINGLE + 1, n)
                key, at, before, after = windows_of(shingles, inside[: len(shingles)], width)
                doc = np.searchsorted(first, at, side="right") - 1
                held = _content(shingles, at - before, before - after + width, before)
                place = (at - first[doc]) << 32 | before << 16 | after
                cols = [pa.array(c) for c in (key, held, ids[lo + doc], place)]
                yield pa.RecordBatch.from_arrays(cols, ["key", "held", "doc_id", "place"])

    return docs.mapInArrow(run, "key long, held long, doc_id long, place long")


def _content(shingles: np.ndarray, begin: np.ndarray, n: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A hash of the ``n`` shingles from each place ``begin`` on, and of the number ``more``."""
    return mixed(_run_hashes(shingles.astype(np.uint64), begin, n, 1)[0].view(np.uint64) ^ mixed((n << 32 | more).astype(np.uint64))).view(np.int64)


def _classes(windows: DataFrame) -> DataFrame:
    """Windows of keys that several documents have, each with the smallest document's window (``rep``, ``rep_at``) of the same
    key and shingles; a document that has that window more than once stands for itself each time."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["key", "held", "doc_id", "place"]
        none = [np.empty(0, np.int64)] * 4
        # Rows of a key of which one document is met so far; the last row that went out, with what stands for it.
        kept, last = none, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, held, doc, place = (np.concatenate([k, batch.column(c).to_numpy()]) for k, c in zip(kept, names))
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
            several = np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start)
            if last is not None and last[0] == key[0]:
                several[0] = True
            new = np.append(True, (key[1:] != key[:-1]) | (held[1:] != held[:-1]))
            top = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            rep, rep_at = doc[top], place[top] >> 32
            if last is not None and last[:2] == (key[0], held[0]):
                rep[top == 0], rep_at[top == 0] = last[2:]
            kept = none if several[-1] else [c[start[-1] :] for c in (key, held, doc, place)]
            last = (key[-1], held[-1], rep[-1], rep_at[-1]) if several[-1] else None
            go = several[group]
            cols = [pa.array(c[go]) for c in (key, doc)] + [pa.array((c[go]).astype(np.int32)) for c in (place >> 32,)]
            cols += [pa.array(((place[go] >> b) & 0xFFFF).astype(np.int16)) for b in (16, 0)] + [pa.array(rep[go]), pa.array(rep_at[go].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "doc_id", "at", "before", "after", "rep", "rep_at"])

    # One shuffle in which each key's windows lie together; only the last key's rows of one document are held.
    dealt = windows.repartition("key").sortWithinPartitions("key", "held", "doc_id", "place")
    return dealt.mapInArrow(run, "key long, doc_id long, at int, before short, after short, rep long, rep_at int")


def _merged(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching ranges ``lo <= x < hi`` of a group (a small number) as one, in order of group and place."""
    if not len(lo):
        return group, lo, hi
    far = int(hi.max()) + 2  # sets the ranges of one group apart from those of the next
    begin = group * far + lo
    order = np.argsort(begin)
    begin, group = begin[order], group[order]
    reach = np.maximum.accumulate(group * far + hi[order])
    first = np.flatnonzero(np.append(True, begin[1:] > reach[:-1]))
    last = np.append(first[1:], len(lo)) - 1
    group = group[first]
    return group, begin[first] - group * far, reach[last] - group * far


def _parts(off: np.ndarray, more: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with texts of about AT_ONCE words, and as many values of ``more``."""
    size = np.append(0, np.cumsum(np.diff(off) // 6 + more))
    lo = 0
    while lo < len(more):
        hi = max(lo + 1, int(np.searchsorted(size, size[lo] + AT_ONCE, side="right")) - 1)
        yield lo, hi
        lo = hi


def _numbers(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, one list after another, and the length of each list."""
    import pyarrow.compute as pc

    return column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False)


def _short(words: np.ndarray) -> np.ndarray:
    """32 bits of the hash of each shingle; as many values as words, of which the last ones mean nothing."""
    if len(words) < SHINGLE:
        return np.zeros(len(words), np.uint32)
    return np.append(shingle_hashes(words, SHINGLE) >> np.uint64(32), np.zeros(SHINGLE - 1, np.uint64)).astype("<u4")


_REQUEST = "at array<int>, y_at array<int>, before array<short>, after array<short>, key array<long>"


def _with_parts(anchors: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """For each pair of documents ``(x, y)`` its anchors as lists, and the parts of y that the windows of y cover."""
    names = ["at", "y_at", "before", "after", "key"]
    pairs = anchors.groupBy("x", "y").agg(F.collect_list(F.struct(*names)).alias("a"))  # a document's own windows
    pairs = pairs.select("x", "y", *[F.col(f"a.{c}").alias(c) for c in names])
    wanted = pairs.groupBy("y").agg(F.count("*").alias("n"))
    salted = pairs.join(wanted, "y").withColumn("salt", F.pmod(F.xxhash64("x"), F.ceil(F.col("n") / PER_SALT)))
    requests = salted.groupBy("y", "salt").agg(F.collect_list(F.struct("x", *names)).alias("r"))  # about PER_SALT

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            data, off = text_bytes(batch.column(1))
            number = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            asked = batch.column(2).flatten()
            windows = pc.list_value_length(asked.field("y_at")).to_numpy(zero_copy_only=False)
            for lo, hi in _parts(off, np.bincount(np.repeat(np.arange(len(number)), number), windows * width, minlength=len(number))):
                words, first = document_words(data, off, lo, hi)
                sh = _short(words)
                asked = batch.column(2).slice(lo, hi - lo).flatten()
                row = np.repeat(np.arange(hi - lo), number[lo:hi])
                y_at, n = _numbers(asked.field("y_at"))
                before, after = (_numbers(asked.field(c))[0].astype(np.int64) for c in ("before", "after"))
                request = np.repeat(np.arange(len(row)), n)
                base = first[row[request]]
                # The window of y may be narrower: its text ends where the text ends.
                end = np.append(first[1:], len(words))[row[request]] - SHINGLE + 1
                begin, stop = np.maximum(base, base + y_at - before), np.minimum(end, base + y_at - after + width)
                request, begin, stop = _merged(request, begin, stop)
                size = stop - begin
                cut = sh[places(begin, size)]
                per = np.bincount(request, minlength=len(row))
                bytes_ = 4 * np.bincount(request, size, minlength=len(row)).astype(np.int64)
                lists = pa.array(np.append(0, np.cumsum(per)).astype(np.int32))
                ends = pa.py_buffer(np.append(0, np.cumsum(bytes_)).astype(np.int32))
                cols = [asked.field("x"), batch.column(0).slice(lo, hi - lo).take(pa.array(row)), *(asked.field(c) for c in names)]
                cols += [pa.ListArray.from_arrays(lists, pa.array((v).astype(np.int32))) for v in (begin - first[row[request]], size)]
                cols.append(pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, ends, pa.py_buffer(np.ascontiguousarray(cut))]))
                yield pa.RecordBatch.from_arrays(cols, ["x", "y", *names, "cut_at", "cut_n", "cut"])

    rows = docs.join(requests.withColumnRenamed("y", "doc_id"), "doc_id").select("doc_id", "text", "r")
    return rows.mapInArrow(run, f"x long, y long, {_REQUEST}, cut_at array<int>, cut_n array<int>, cut binary")


def _distinct(values: np.ndarray, width: int) -> np.ndarray:
    """How many distinct values each run of ``width`` values has, by its first place."""
    n = len(values)
    order = np.sort(values.astype(np.uint64) << np.uint64(32) | np.arange(n, dtype=np.uint64))
    same = np.flatnonzero(order[1:] >> np.uint64(32) == order[:-1] >> np.uint64(32))
    order = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
    before = np.full(n, -width)
    before[order[same + 1]] = order[same]
    at = np.arange(n)
    change = np.bincount(np.maximum(np.maximum(before, at - width) + 1, 0), minlength=n + 1) - np.bincount(at + 1, minlength=n + 1)
    return np.cumsum(change)[:n]


def aligned(x: np.ndarray, y: np.ndarray, lo: np.ndarray, n: np.ndarray, shift: np.ndarray, width: int, percent: int) -> np.ndarray:
    """Whether passages reach the similarity: of each job those of ``x`` that start at lo, ..., lo + n - 1, against those
    of ``y`` that start ``shift`` further on. The answers follow each other, job by job.
    """
    n_x, n_y = _distinct(x, width), _distinct(y, width)
    start = places(lo, n)
    both = n_x[start] + n_y[start + np.repeat(shift, n)]
    # Equal shingles at equal places are shared ones; where none repeats, they count as such.
    span = n + width - 1
    place = places(lo, span)
    equal = np.append(0, np.cumsum(x[place] == y[place + np.repeat(shift, span)]))
    first = places(np.append(0, np.cumsum(span)[:-1]), n)
    shared = equal[first + width] - equal[first]
    ok = (100 * shared >= percent * (both - shared)) & (n_x[start] == width)
    left = np.flatnonzero(~ok)
    if not len(left):
        return ok
    job = np.repeat(np.arange(len(n)), n)[left]
    runs = np.flatnonzero(np.append(True, (np.diff(left) != 1) | (np.diff(job) != 0)))
    answers = left[runs]
    lo, n, shift = start[answers], np.diff(np.append(runs, len(left))), shift[job[runs]]
    # The rest: all pairs of equal shingles that one pair of aligned passages holds, and the passages that hold them.
    sorted_y = np.sort(y.astype(np.uint64) << np.uint64(32) | np.arange(len(y), dtype=np.uint64))
    span = n + width - 1
    place, of = places(lo, span), np.repeat(np.arange(len(n)), span)
    to = place + shift[of]
    value = x[place].astype(np.uint64) << np.uint64(32)
    begin = np.searchsorted(sorted_y, value | np.maximum(to - width + 1, 0).astype(np.uint64))
    many = np.searchsorted(sorted_y, value | (to + width).astype(np.uint64)) - begin
    heavy = np.append(0, np.cumsum(np.bincount(of, many, minlength=len(n)))).astype(np.int64)
    j = 0
    while j < len(n):  # so many jobs as have a bounded number of pairs, one at least
        k = max(j + 1, int(np.searchsorted(heavy, heavy[j] + AT_ONCE, side="right")) - 1)
        some = slice(int(np.searchsorted(of, j)), int(np.searchsorted(of, k)))
        shared = _shared(place[some], value[some] >> np.uint64(32), of[some] - j, begin[some], many[some], sorted_y, lo[j:k], n[j:k], shift[j:k], width)
        todo = places(answers[j:k], n[j:k])
        ok[todo] |= 100 * shared >= percent * (both[todo] - shared)
        j = k
    return ok


def _shared(place, value, of, begin, many, sorted_y, lo, n, shift, width) -> np.ndarray:
    """Shingles that each pair of aligned passages shares, job by job; ``begin`` and ``many`` tell which of ``sorted_y``
    equal the shingle at ``place`` of job ``of``."""
    p = np.repeat(np.arange(len(place)), many)
    of = of[p]
    q = (sorted_y[places(begin, many)] & np.uint64(0xFFFFFFFF)).astype(np.int64) - shift[of]
    at = place[p]
    a = np.maximum(np.maximum(at, q) - width + 1, lo[of])
    b = np.minimum(np.minimum(at, q), lo[of] + n[of] - 1)
    real = a <= b
    a, b, of, value = a[real], b[real], of[real], value[p[real]]
    base = np.append(0, np.cumsum(n + 1)[:-1])  # each job's passages and one place more
    a, b = a - lo[of] + base[of], b - lo[of] + base[of] + 1
    # A shingle counts once for each passage.
    _, shingle = np.unique(of.astype(np.uint64) << np.uint64(32) | value, return_inverse=True)
    _, a, b = _merged(shingle, a, b)
    total = int((n + 1).sum())
    return np.cumsum(np.bincount(a, minlength=total + 1) - np.bincount(b, minlength=total + 1))[places(base, n)]


def _verified(parts: DataFrame, docs: DataFrame, width: int, percent: int, again: bool = True) -> DataFrame:
    """``(doc_id, lo, hi, lead, lead_at, key)``: runs of passages that another document holds; and, if ``again``, without
    ``lead`` the windows of ``key`` that hold a passage for which none was found, with their place as ``lead_at``.
    """
    names = ["y", "at", "y_at", "before", "after", "key", "cut_at", "cut_n", "cut"]
    own = parts.groupBy("x").agg(F.collect_list(F.struct(*names)).alias("r"))  # a document's own windows
    kinds = ["doc_id", "lo", "hi", "lead", "lead_at", "key"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            data, off = text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            number = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            cut_bytes = pc.binary_length(batch.column(2).flatten().field("cut")).to_numpy(zero_copy_only=False)
            for lo, hi in _parts(off, np.bincount(np.repeat(np.arange(len(number)), number), cut_bytes // 4, minlength=len(number))):
                words, first = document_words(data, off, lo, hi)
                x = _short(words)
                met = batch.column(2).slice(lo, hi - lo).flatten()
                row = np.repeat(np.arange(hi - lo), number[lo:hi])
                lead = met.field("y").to_numpy()
                at, per = _numbers(met.field("at"))
                y_at, before, after, key = (_numbers(met.field(c))[0] for c in ("y_at", "before", "after", "key"))
                cut_at, cuts = _numbers(met.field("cut_at"))
                cut_n = _numbers(met.field("cut_n"))[0].astype(np.int64)
                raw, ends = text_bytes(met.field("cut"))
                y = raw[ends[0] : ends[-1]].view("<u4")
                pair, pair_of_cut = np.repeat(np.arange(len(row)), per), np.repeat(np.arange(len(row)), cuts)
                cut_base = np.append(0, np.cumsum(cut_n)[:-1])
                cut = np.searchsorted(pair_of_cut.astype(np.int64) << 32 | cut_at, pair.astype(np.int64) << 32 | y_at, side="right") - 1
                begin, stop = first[row[pair]] + at - before, first[row[pair]] + at - after + 1
                shift = cut_base[cut] + y_at - cut_at[cut] - (first[row[pair]] + at)
                # Only passages of y that its part holds.
                begin = np.maximum(begin, cut_base[cut] - shift)
                stop = np.minimum(stop, cut_base[cut] + cut_n[cut] - width + 1 - shift)
                some = begin < stop
                # Passages of one pair of documents and one alignment make a job.
                low = int(shift.min()) if len(shift) else 0
                wide = int(shift.max()) - low + 1 if len(shift) else 1
                kinds_of, number_of = np.unique(cut[some] * wide + shift[some] - low, return_inverse=True)
                job, a, b = _merged(number_of, begin[some], stop[some])
                job_cut, job_shift = kinds_of[job] // wide, kinds_of[job] % wide + low
                good = aligned(x, y, a, b - a, job_shift, width, percent) if len(a) else np.empty(0, bool)
                # Runs of passages that are alike, and what is left.
                spots, of = places(a, b - a), np.repeat(np.arange(len(a)), b - a)
                hit = np.flatnonzero(good)
                new = np.flatnonzero((np.diff(spots[hit], prepend=-2) != 1) | (np.diff(of[hit], prepend=-1) != 0))
                last = np.append(new[1:], len(hit)) - 1
                i, j, k = spots[hit[new]], spots[hit[last]] if len(hit) else hit, of[hit[new]]
                doc = row[pair_of_cut[job_cut[k]]]
                lead_at = i + job_shift[k] - cut_base[job_cut[k]] + cut_at[job_cut[k]]
                covered = np.zeros(len(x) + 1, np.int64)
                covered[1 + spots[hit]] = 1
                covered = np.cumsum(covered)
                begin, stop = first[row[pair]] + at - before, first[row[pair]] + at - after + 1
                rest = np.flatnonzero(covered[stop] - covered[begin] < stop - begin) if again else np.empty(0, np.int64)
                # From the first to the last passage for which none was found.
                bare = np.flatnonzero(np.diff(covered) == 0)
                begin[rest], stop[rest] = bare[np.searchsorted(bare, begin[rest])], bare[np.searchsorted(bare, stop[rest]) - 1] + 1
                back = first[row[pair[rest]]]
                cols = [
                    pa.array(np.append(ids[lo + doc], ids[lo + row[pair[rest]]])),
                    pa.array(np.append(i - first[doc], begin[rest] - back).astype(np.int32)),
                    pa.array(np.append(j - first[doc], stop[rest] - 1 - back).astype(np.int32)),
                    pa.array(np.append(lead[pair_of_cut[job_cut[k]]], np.zeros(len(rest), np.int64)), mask=np.arange(len(k) + len(rest)) >= len(k)),
                    pa.array(np.append(lead_at, at[rest]).astype(np.int32)),
                    pa.array(np.append(np.zeros(len(k), np.int64), key[rest]), mask=np.arange(len(k) + len(rest)) < len(k)),
                ]
                yield pa.RecordBatch.from_arrays(cols, kinds)

    rows = docs.join(own.withColumnRenamed("x", "doc_id"), "doc_id").select("doc_id", "text", "r")
    return rows.mapInArrow(run, "doc_id long, lo int, hi int, lead long, lead_at int, key long")


def _run_hashes(words: np.ndarray, at: np.ndarray, n, hashes: int = 2) -> list[np.ndarray]:
    """So many hashes of the ``n`` words from each place ``at`` on."""
    out = []
    for base in _SEEDS[:hashes]:
        power, inverse = _powers(base, len(words) + 1), _powers(np.uint64(pow(int(base), -1, 1 << 64)), len(words) + 1)
        total = np.append(np.uint64(0), np.cumsum(mixed(words ^ base) * power[:-1], dtype=np.uint64))
        out.append(mixed((total[at + n] - total[at]) * inverse[at]).view(np.int64))
    return out


def _with_windows(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """``(doc_id, text, r)``: texts with their windows (key, at, before, after, ask_from, ask_to)."""
    own = windows.groupBy("doc_id").agg(F.collect_list(F.struct("key", "at", "before", "after", "ask_from", "ask_to")).alias("r"))  # a document's own
    return docs.join(own, "doc_id").select("doc_id", "text", "r")


def _bits(rows: DataFrame, values, lg: int, levels: tuple[int, ...]) -> list[np.ndarray]:
    """For each level a bitmap of the 2 ** ``lg`` cells that so many of the hashes fall into that ``values`` tells of each
    Arrow batch of ``rows``; cells are counted in tasks, up to the highest level, and summed up by parts.
    """
    size = 1 << lg
    part, top = min(PART, size), max(levels)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cells = np.zeros(size, np.uint8)
        for batch in batches:
            for hashes in values(batch):
                at, n = np.unique(hashes & np.uint64(size - 1), return_counts=True)
                at = at.astype(np.int64)
                cells[at] = np.minimum(cells[at] + n, top)
        for p in range(size // part):
            if len(at := np.flatnonzero(here := cells[p * part : (p + 1) * part])):
                yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "at": [at.astype("<u2").tobytes()], "n": [here[at].tobytes()]})

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, total = None, None
        done = lambda: pa.RecordBatch.from_pydict({"part": pa.array([now], pa.int32()), "bits": [b"".join(np.packbits(total >= x, bitorder="little").tobytes() for x in levels)]})
        for batch in batches:
            for p, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                if now != p:
                    if now is not None:
                        yield done()
                    now, total = p, np.zeros(part, np.int64)
                total[np.frombuffer(at, "<u2")] += np.frombuffer(n, np.uint8)
        if now is not None:
            yield done()

    counted = rows.mapInArrow(count, "part int, at binary, n binary")
    summed = counted.repartition("part").sortWithinPartitions("part").mapInArrow(add, "part int, bits binary")
    out = [np.zeros(size // 8, np.uint8) for _ in levels]
    for r in summed.toLocalIterator():  # so many bits, whatever the input
        for bits, own in zip(out, np.frombuffer(r["bits"], np.uint8).reshape(len(levels), -1)):
            bits[r["part"] * part // 8 : (r["part"] + 1) * part // 8] = own
    return out


def _set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _lists(key: np.ndarray, shingle: np.ndarray, odd) -> np.ndarray:
    """Numbers of the lists of a key and a shingle; ``odd`` ones are for passages in which a shingle repeats."""
    return mixed(key ^ mixed(shingle.astype(np.uint64) + (odd.astype(np.uint64) << np.uint64(33))))


def rare_shingles(sh: np.ndarray, at: np.ndarray, lone: np.ndarray, often: np.ndarray, width: int, percent: int) -> tuple[np.ndarray, ...]:
    """``(passage, shingle, odd)``: of the passages that start at ``at``, shingles of which any similar passage has one.

    Of n different shingles a passage of that similarity shares ``percent`` of a hundred at least, so one of the rarest
    n - ceil(percent * n / 100) + 1; and where neither repeats a shingle, fewer do: those beyond are ``odd``.
    Shingles that are ``lone`` come first and are left out, the more ``often`` others are met the later they come.
    """
    order = (np.where(lone, np.uint64(0), often.astype(np.uint64) + np.uint64(1)) << np.uint64(32)) | sh.astype(np.uint64)
    apart = width - -(-2 * percent * width // (100 + percent)) + 1
    out: list[tuple] = []
    for lo in range(0, len(at), AT_ONCE // width):
        own = at[lo : lo + AT_ONCE // width]
        v = np.sort(order[own[:, None] + np.arange(width)], axis=1)
        new = np.append(np.ones((len(own), 1), bool), v[:, 1:] != v[:, :-1], axis=1)
        rank = np.cumsum(new, axis=1)
        n = rank[:, -1:]
        take = new & (rank <= n + (-percent * n) // 100 + 1) & (v >> np.uint64(32) > 0)
        i, j = np.nonzero(take)
        out.append((lo + i, v[i, j] & np.uint64(0xFFFFFFFF), (n[i, 0] == width) & (rank[i, j] > apart)))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool))


def _cuts(windows: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The shingles that windows hold, in place of texts: ``(doc_id, cut, key, at, before, begin, n, ask, asks)``, where
    ``begin`` is the place of a window's first passage in the cut, ``n`` its passages, and ``asks`` passages from ``ask`` on
    are those without a partner."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            data, off = text_bytes(batch.column(1))
            number = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for lo_, hi_ in _parts(off, number * width):
                words, first = document_words(data, off, lo_, hi_)
                sh, r = _short(words), batch.column(2).slice(lo_, hi_ - lo_).flatten()
                row = np.repeat(np.arange(hi_ - lo_), number[lo_:hi_])
                key, at, before, after, ask, to = (r.field(c).to_numpy().astype(np.int64) for c in ("key", "at", "before", "after", "ask_from", "ask_to"))
                lo, hi = first[row] + at - before, first[row] + at - after
                group, begin, stop = _merged(row, lo, hi + width)
                size = stop - begin
                cut, start = sh[places(begin, size)], np.cumsum(size) - size
                of = np.searchsorted(begin, lo, side="right") - 1
                long = np.bincount(group, size, minlength=hi_ - lo_).astype(np.int64)
                own = (np.cumsum(long) - long)[row]
                ends = pa.py_buffer(np.append(0, 4 * np.cumsum(long)).astype(np.int32))
                lists = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=hi_ - lo_))).astype(np.int32))
                cols = [batch.column(0).slice(lo_, hi_ - lo_), pa.BinaryArray.from_buffers(pa.binary(), hi_ - lo_, [None, ends, pa.py_buffer(np.ascontiguousarray(cut))])]
                place = start[of] + lo - begin[of] - own
                for c, kind in ((key, np.int64), (at, np.int32), (before, np.int16), (place, np.int32), (hi - lo + 1, np.int16), (before - ask, np.int16), (ask - to + 1, np.int16)):
                    cols.append(pa.ListArray.from_arrays(lists, pa.array(c.astype(kind))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "cut", "key", "at", "before", "begin", "n", "ask", "asks"])

    schema = "doc_id long, cut binary, key array<long>, at array<int>, before array<short>, begin array<int>, n array<short>, ask array<short>, asks array<short>"
    return _with_windows(windows, docs).mapInArrow(run, schema)


def _cut(batch, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of some cuts at a time: their numbers, shingles, and for each window its cut, key, place, passages before that, first
    and last passage, and first and last that asks; passages count in the shingles."""
    data, off = text_bytes(batch.column(1))
    ids = batch.column(0).to_numpy()
    count = _numbers(batch.column(2))[1]
    for lo, hi in _parts(off, count * width):
        sh = data[off[lo] : off[hi]].view("<u4")
        row = np.repeat(np.arange(hi - lo), count[lo:hi])
        key, at, before, begin, n, ask, asks = (_numbers(batch.column(c).slice(lo, hi - lo))[0].astype(np.int64) for c in range(2, 9))
        first = begin + ((off[lo:hi] - off[lo]) // 4)[row]
        yield ids[lo:hi], sh, row, key.view(np.uint64), at, before, first, first + n - 1, first + ask, first + ask + asks - 1


def _repeating(sh: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    """Whether windows hold a passage in which a shingle repeats."""
    repeats = np.append(0, np.cumsum(_distinct(sh, width) < width))
    return repeats[hi + 1] > repeats[lo]


def _listed(cuts: DataFrame, bits: list[np.ndarray], odd: np.ndarray, width: int, percent: int) -> DataFrame:
    """``(list, key, x, at, held, holds, lo, hi)``: windows under their key and the rarest shingles of each passage.

    Rows that hold have a hash of what their passages in the list hold; rows with ``lo`` and ``hi`` ask. Two passages without
    repeats meet by few shingles (list 0); one that repeats a shingle holds list 1 and asks list 2 for more ones of others.
    """
    known = cuts.sparkSession.sparkContext.broadcast((bits, odd))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        levels, odd = known.value
        for batch in batches:
            for ids, sh, row, key, at, before, lo, hi, ask, to in _cut(batch, width):
                hashes = mixed(sh.astype(np.uint64))
                level = sum(_set(b, hashes).astype(np.int64) for b in levels)
                lone, different = level == 0, _distinct(sh, width)
                window, passage = np.repeat(np.arange(len(row)), hi - lo + 1), places(lo, hi - lo + 1)
                # Most passages have too many shingles of their own.
                alone = np.append(0, np.cumsum(lone))
                mixed_key = _set(odd, mixed(key))[window]  # a window of the key repeats a shingle
                most = np.where(mixed_key, width - -(-percent * width // 100), width - -(-2 * percent * width // (100 + percent)))
                some = (alone[passage + width] - alone[passage] <= most) | (different[passage] < width)
                window, passage, mixed_key = window[some], passage[some], mixed_key[some]
                each, of = np.unique(passage, return_inverse=True)  # a passage of several windows is sorted once
                p, shingle, far = rare_shingles(sh, each, lone, np.maximum(level - 1, 0), width, percent)
                count, start = np.bincount(p, minlength=len(each)), np.searchsorted(p, np.arange(len(each)))
                spot = places(start[of], count[of])
                window, passage, mixed_key = (np.repeat(c, count[of]) for c in (window, passage, mixed_key))
                shingle, far = shingle[spot], far[spot]
                again = different[passage] < width
                near, more = np.flatnonzero(~far), np.flatnonzero(mixed_key & (far | again))
                parts = [(near, 0, True, True)]
                parts += [(more[far[more]], 1, True, False), (more[far[more]], 2, False, True), (more[again[more]], 1, False, True), (more[again[more]], 2, True, False)]
                window, passage, lists, asks, holds = (
                    np.concatenate(c) for c in zip(*((window[i], passage[i], _lists(key[window[i]], shingle[i], np.full(len(i), k)), np.full(len(i), a), np.full(len(i), h)) for i, k, a, h in parts))
                )
                asks &= (passage >= ask[window]) & (passage <= to[window])
                order = np.lexsort((lists, window))
                window, passage, lists, asks, holds = (c[order] for c in (window, passage, lists, asks, holds))
                if not len(window):
                    continue
                new = np.flatnonzero(np.append(True, (window[1:] != window[:-1]) | (lists[1:] != lists[:-1])))
                far_off = len(sh)
                h_lo, a_lo = (np.minimum.reduceat(np.where(c, passage, far_off), new) for c in (holds, asks))
                h_hi, a_hi = (np.maximum.reduceat(np.where(c, passage, -1), new) for c in (holds, asks))
                w, holding, asking = window[new], h_hi >= 0, a_hi >= 0
                held = np.zeros(len(w), np.int64)
                key_place = lo[w] + before[w]
                held[holding] = _content(sh, h_lo[holding], h_hi[holding] - h_lo[holding] + width, (key_place - h_lo)[holding])
                shift = at[w] - key_place
                used = holding | asking
                cols = [pa.array(c[used]) for c in (lists[new].view(np.int64), key[w].view(np.int64), ids[row[w]], at[w].astype(np.int32), held, holding)]
                cols += [pa.array((c + shift)[used].astype(np.int32), mask=~asking[used]) for c in (a_lo, a_hi)]
                yield pa.RecordBatch.from_arrays(cols, ["list", "key", "x", "at", "held", "holds", "lo", "hi"])

    return cuts.mapInArrow(run, "list long, key long, x long, at int, held long, holds boolean, lo int, hi int")


def _of(rows: DataFrame, ids: DataFrame, path: str) -> DataFrame:
    """The ``rows`` of the documents in ``ids``, which are written."""
    ids = stored(ids.distinct(), path)
    return rows.join(checked_broadcast(ids, ids.count(), 16), "doc_id", "left_semi").select(rows.columns)


def _marks(sh: np.ndarray, of: np.ndarray, place: np.ndarray, n: int):
    """For each of ``n`` sets a bit for each shingle at the places ``place``, which are those of set ``of``."""
    import pyarrow as pa

    out = np.zeros((n, 64 * MARKS), bool)
    out[of, (mixed(sh[place].astype(np.uint64)) % np.uint64(64 * MARKS)).astype(np.int64)] = True
    return pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(out, axis=1).view(np.int64).ravel()), MARKS).cast(pa.list_(pa.int64()))


def _window_marks(windows: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``(y, y_at, holds, n_y)``: marks of all shingles of the passages that hold a place, all of which may be compared with
    others; how many different shingles each of these has, by how far the place lies behind its start."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, off = text_bytes(batch.column(1))
            ids, number = batch.column(0).to_numpy(), _numbers(batch.column(2))[1]
            for lo_, hi_ in _parts(off, number * width):
                words, first = document_words(data, off, lo_, hi_)
                sh, row = _short(words), np.repeat(np.arange(hi_ - lo_), number[lo_:hi_])
                different, end = _distinct(sh, width), np.append(first[1:], len(words)) - SHINGLE + 1 - width
                at = _numbers(batch.column(2).slice(lo_, hi_ - lo_))[0]
                lo, hi = np.maximum(first[row], first[row] + at - width + 1), np.minimum(first[row] + at, end[row])
                n = hi - lo + 1
                # By how far the place lies behind the passage; a passage that is not there is like none.
                back = first[row] + at - np.arange(width)[:, None]
                there = (back >= lo) & (back <= hi)
                many = np.where(there, different[np.where(there, back, 0)], 2 * width).T.astype(np.int32)
                for i in range(0, len(row), AT_ONCE // width):
                    k = slice(i, i + AT_ONCE // width)
                    span = n[k] + width - 1
                    marks = _marks(sh, np.repeat(np.arange(len(span)), span), places(lo[k], span), len(span))
                    n_y = pa.FixedSizeListArray.from_arrays(pa.array(many[k].ravel()), width).cast(pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo_:hi_][row[k]]), pa.array(at[k].astype(np.int32)), marks, n_y], ["y", "y_at", "holds", "n_y"])

    own = windows.groupBy("y").agg(F.collect_set("y_at").alias("r"))  # a document's own
    rows = docs.join(own.withColumnRenamed("y", "doc_id"), "doc_id").select("doc_id", "text", "r")
    return rows.mapInArrow(run, "y long, y_at int, holds array<long>, n_y array<int>")


def _passage_marks(cuts: DataFrame, width: int) -> DataFrame:
    """``(x, p, own, n_x)``: marks of the shingles of each passage that asked, and how many different ones it has."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for ids, sh, row, _, at, before, lo, _, ask, to in _cut(batch, width):
                n = np.maximum(0, to - ask + 1)
                passage, one = np.unique(places(ask, n), return_index=True)
                window = np.repeat(np.arange(len(row)), n)[one]
                doc, place = ids[row[window]], passage + (at - lo - before)[window]
                different = _distinct(sh, width)[passage].astype(np.int32)
                for i in range(0, len(passage), AT_ONCE // width):
                    k = slice(i, i + AT_ONCE // width)
                    n = len(passage[k])
                    marks = _marks(sh, np.repeat(np.arange(n), width), places(passage[k], np.full(n, width)), n)
                    yield pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array(place[k].astype(np.int32)), marks, pa.array(different[k])], ["x", "p", "own", "n_x"])

    return cuts.mapInArrow(run, "x long, p int, own array<long>, n_x int")


def repeated_passages(
    docs: DataFrame,
    threshold: float = 0.75,
    words: int = WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
) -> DataFrame:
    """``(doc_id, first_word, n_words, n_passages, other_id, other_word)``: spans of words that an earlier document holds.

    Places count words from 0; ``other_id`` is the smallest document found to hold a passage of the span, and
    ``other_word`` where that passage begins there.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark)
    width, percent = words - SHINGLE + 1, round(threshold * 100)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = unique_ids(rows.where("doc_id is not null and text is not null"))
    shared = stored(_classes(_windows(rows, width)), f"{path}/shared")
    release(spark)
    # Equal windows are found whole in the one of the smallest document, which stands for them from here on.
    lo, hi = F.col("at") - F.col("before"), F.col("at") - F.col("after")
    equal = shared.where("doc_id <> rep").select("doc_id", lo.alias("lo"), hi.alias("hi"), F.col("rep").alias("lead"), (F.col("rep_at") - F.col("before")).alias("lead_at"))
    own = shared.where("doc_id = rep").select("key", "doc_id", "at", "before", "after")
    place = F.struct("doc_id", "at")
    keys = own.groupBy("key").agg(F.min(place).alias("lead"), F.max("doc_id").alias("high")).where("lead.doc_id < high").select("key", "lead")
    reps = stored(own.join(keys, "key").select(*own.columns, "lead"), f"{path}/reps")
    anchors = reps.where("doc_id > lead.doc_id").select(
        "key", F.col("doc_id").alias("x"), F.col("lead.doc_id").alias("y"), "at", F.col("lead.at").alias("y_at"), "before", "after"
    )
    first = stored(_verified(_with_parts(anchors, rows, width), rows, width, percent), f"{path}/first")
    release(spark)
    # The windows that are left, against all others of their keys.
    left = first.where("lead is null").select("key", F.col("doc_id").alias("x"), F.col("lead_at").alias("at"), "lo", "hi").distinct()
    left = stored(left, f"{path}/left")
    # Written, so that a key with many windows is split while they are joined and summed up in part before they meet.
    members = reps.join(left.select("key").distinct(), "key", "left_semi").where("doc_id > lead.doc_id or at > lead.at").drop("lead")
    members = stored(members.join(left.withColumnRenamed("x", "doc_id"), ["key", "doc_id", "at"], "left"), f"{path}/members")
    forget(spark, f"{path}/reps")
    release(spark)
    counts = stored(members.groupBy("key").agg(F.count("*").alias("n")), f"{path}/counts")
    few = members.join(counts.where(F.col("n") <= FEW).select("key"), "key").select("key", F.col("doc_id").alias("y"), F.col("at").alias("y_at"))
    few = stored(few, f"{path}/few")
    direct = left.join(few, "key").where("y < x").select("key", "x", "y", "at", "y_at", "lo", "hi")
    # Larger keys, by lists of the rarest shingles.
    large = members.join(counts.where(F.col("n") > FEW).select("key"), "key")
    ask = [F.coalesce(F.col("at") - F.col(c), F.lit(v)).cast("short").alias(n) for c, v, n in (("lo", -1, "ask_from"), ("hi", 0, "ask_to"))]
    large = stored(large.select("key", "doc_id", "at", "before", "after", *ask), f"{path}/large")
    forget(spark, f"{path}/members")
    lg = max(16, min(LG_CELLS, (large.count() * 2 * width).bit_length()))
    cuts = stored(_cuts(large, rows, width), f"{path}/cuts")
    release(spark)

    def shingles(batch) -> Iterator[np.ndarray]:
        for _, sh, row, _, _, _, lo, hi, _, _ in _cut(batch, width):
            own, begin, stop = _merged(row, lo, hi + width)
            own = np.unique(np.repeat(own, stop - begin).astype(np.uint64) << np.uint64(32) | sh[places(begin, stop - begin)])
            yield mixed(own & np.uint64(0xFFFFFFFF))  # each document counts once

    def repeating(batch) -> Iterator[np.ndarray]:
        for _, sh, _, key, _, _, lo, hi, _, _ in _cut(batch, width):
            yield mixed(key[_repeating(sh, lo, hi, width)])

    bits = _bits(cuts, shingles, lg, LEVELS)
    odd = _bits(cuts, repeating, min(lg, 22), (1,))[0]
    listed = stored(_listed(cuts, bits, odd, width, percent), f"{path}/listed")
    forget(spark, f"{path}/large")
    release(spark)
    # Windows that hold the same in a list are one; asks meet the one that holds the same, else the list's smallest
    # document and the smallest one of what most windows of the list hold.
    held = listed.where("holds").groupBy("list", "held").agg(F.min(F.struct(F.col("x").alias("y"), F.col("at").alias("y_at"))).alias("m"), F.count("*").alias("n"))
    held = stored(held, f"{path}/held")
    lists = stored(held.groupBy("list").agg(F.min("m").alias("s"), F.max(F.struct("n", "m")).alias("top")).select("list", "s", F.col("top.m").alias("top")), f"{path}/lists")
    asks = listed.where("lo is not null").join(lists, "list").where("s.y < x")
    asks = asks.join(held.select("list", "held", "m"), ["list", "held"], "left").select("list", "key", "x", "at", "lo", "hi", "s", "top", "m")
    asks = stored(asks, f"{path}/asks")
    forget(spark, f"{path}/listed")
    partners = F.when(F.col("m.y") < F.col("x"), F.array("m")).otherwise(F.array_distinct(F.array("s", "top")))
    met = asks.withColumn("o", F.explode(partners)).where("o.y < x").select("key", "x", F.col("o.y").alias("y"), "at", F.col("o.y_at").alias("y_at"), "lo", "hi")
    offsets = [(F.col("at") - F.col(c)).cast("short").alias(n) for c, n in (("lo", "before"), ("hi", "after"))]

    def tested(pairs: DataFrame, name: str, again: bool) -> DataFrame:
        once = pairs.groupBy("key", "x", "y", "at", "y_at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        once = stored(once.select("key", "x", "y", "at", "y_at", *offsets), f"{path}/{name}_pairs")
        # Only the texts of documents that are in a pair move.
        texts = _of(rows, once.select(F.col("x").alias("doc_id")).union(once.select("y")), f"{path}/{name}_docs")
        out = stored(_verified(_with_parts(once, texts, width), texts, width, percent, again), f"{path}/{name}")
        release(spark)
        return out

    second = tested(direct.unionByName(met), "second", True)
    # What these do not have, against all others of the lists.
    still = second.where("lead is null").select("key", F.col("doc_id").alias("x"), F.col("lead_at").alias("at"), F.col("lo").alias("from"), F.col("hi").alias("to"))
    still = still.groupBy("key", "x", "at").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    asks = asks.join(still, ["key", "x", "at"]).where(F.col("lo") <= F.col("to")).where(F.col("hi") >= F.col("from"))
    asks = stored(asks.drop("from", "to", "m"), f"{path}/still")
    # Passages that have no partner so far; marks of what they and the windows hold tell most pairs that cannot be similar.
    gone = _of(first.unionByName(second).where("lead is not null"), asks.select(F.col("x").alias("doc_id")), f"{path}/asking")
    gone = gone.select(F.col("doc_id").alias("x"), F.explode(F.sequence("lo", "hi")).alias("p")).distinct()
    bare = _passage_marks(_of(cuts, asks.select(F.col("x").alias("doc_id")), f"{path}/asking2"), width).join(gone, ["x", "p"], "left_anti")
    left = asks.withColumn("p", F.explode(F.sequence("lo", "hi"))).join(bare, ["x", "p"])
    others = held.join(asks.select("list").distinct(), "list").select("list", F.col("m.y").alias("y"), F.col("m.y_at").alias("y_at"))
    others = stored(others, f"{path}/others")
    texts = _of(rows, others.select(F.col("y").alias("doc_id")), f"{path}/holding")
    right = others.join(_window_marks(others, texts, width), ["y", "y_at"])
    left, right = stored(left, f"{path}/bare"), stored(right, f"{path}/marked")
    apart = sum((F.bit_count(F.col("own")[i].bitwiseAND(F.bitwise_not(F.col("holds")[i]))) for i in range(MARKS)), F.lit(0))
    o = F.struct("y", "y_at")
    alike = (left["list"] == right["list"]) & (F.col("y") < F.col("x")) & (o != F.col("s")) & (o != F.col("top"))
    # Of n_x different shingles at least ``apart`` are not shared.
    alike &= (100 + percent) * (F.col("n_x") - apart) >= percent * (F.col("n_x") + F.col("n_y")[F.col("at") - F.col("p")])
    pairs = left.join(right, alike).select("key", "x", "y", "at", "y_at", "lo", "hi")
    third = tested(pairs, "third", False)
    columns = ["doc_id", "lo", "hi", "lead", "lead_at"]
    found = first.unionByName(second).unionByName(third).where("lead is not null").select(columns)
    found = stored(found.unionByName(equal), f"{path}/found")
    done = ["left", "few", "counts", "cuts", "asks", "held", "lists", "still", "asking", "asking2", "others", "holding", "bare", "marked", "shared"]
    for table in (*done, "first", "second", "third", "second_pairs", "third_pairs", "second_docs", "third_docs"):
        forget(spark, f"{path}/{table}")
    return _spans(found, words)


def _spans(found: DataFrame, words: int) -> DataFrame:
    """Overlapping and touching passages of a document as one span."""
    best = found.groupBy("doc_id", "lo").agg(F.max("hi").alias("hi"), F.min(F.struct("lead", "lead_at")).alias("o"))
    order = Window.partitionBy("doc_id").orderBy("lo")
    run = best.withColumn("before", F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    run = run.withColumn("fresh", F.coalesce((F.col("lo") > F.col("before") + words).cast("int"), F.lit(1)))
    run = run.withColumn("span", F.sum("fresh").over(order))
    added = F.greatest(F.lit(0), F.col("hi") - F.greatest(F.coalesce("before", F.lit(-1)), F.col("lo") - 1))
    return run.groupBy("doc_id", "span").agg(
        F.min("lo").alias("first_word"), (F.max("hi") - F.min("lo") + words).cast("int").alias("n_words"),
        F.sum(added).cast("long").alias("n_passages"), F.min("o").alias("o"),
    ).select("doc_id", "first_word", "n_words", "n_passages", F.col("o.lead").alias("other_id"), F.col("o.lead_at").alias("other_word"))
