"""Removal of repeated passages by bucket-pointer refinement (Schuermann and Stoye, 2005) to a fixed depth.

A suffix array to depth 100 puts the positions of all texts into buckets of equal 100-byte strings.  Following the method,
buckets of q-grams come first (q = 20).  A bucket is refined by sorting its members on the bucket pointers found at later
offsets, and refined pointers are reused at once: those to depth 40 are made of pairs of those to depth 20, those to depth 80 of
pairs of those to depth 40, and depth 100 adds a q-gram's pointer once more.  A bucket with one member is finished.

Two kinds of pointers are used.  Within a task they are places in the sorted order, as in the paper (``refined``).  Between
tasks there is no common order, so there a bucket's pointer is a 64-bit hash of its string, made by the same pairing.

Refining every position would move many times the input.  So the initial buckets are sampled: of the q-grams in a 100-byte
string the one with the least identifier is its anchor.  Equal strings have equal anchors, and consecutive strings mostly share
one, so a text becomes a short list of runs (anchor, pointer of the whole run, place).  The members of an anchor's bucket are
sorted on the pointers of their runs; equal ones are copies from end to end, and only where one anchor has different runs is the
bucket refined string by string.

Anchors in many documents are hot keys: a bounded sample of the documents names them, and their runs are dealt by anchor *and* run
pointer; of the copies of a run a task passes on only the first as undecided.  The sample steers where rows go, not what is found.

Texts are read in the Arrow buffers, in windows of BLOCK bytes that overlap by a string, so memory does not depend on a text's length.

Defined cases: a null text is empty; texts shorter than the depth are never touched; a null id counts as the
smallest; rows with equal id and equal text are one document, so neither is earlier; rows with equal id and different
texts are told apart by a digest; an empty table gives an empty result; further columns are kept or ignored, never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import numbered, written

DEPTH = 100
Q = 20
#: Bytes of text worked on at a time.
BLOCK = 1 << 18
#: Strings of large buckets that are sorted together before their shuffle.
STRINGS = 1 << 18
#: A bucket with more than this share of all open runs is refined through a shuffle of single strings, which spreads it over all
#: tasks; others are refined within one task, which never gets more than MOST_LOCAL runs of a bucket.  Results are the same.
LOCAL_SHARE, LEAST_LOCAL, MOST_LOCAL = 1 / 2000, 64, 4000
#: Documents in the sample that names hot anchors, about, and in how many of them an anchor is hot.
SAMPLE, HOT = 1 << 14, 16
#: Runs of hot anchors that a task remembers at most.
RUNS_KEPT = 1 << 18
_NO_ID = -(1 << 63)

_C = np.uint64(0x9E3779B97F4A7C15)
#: Buckets of single bytes.
_BYTES = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") for i in range(256)], np.uint64)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pointer of the pair of two buckets."""
    x = a * _C
    x += b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _later(ids: np.ndarray, other: np.ndarray, offset: int) -> np.ndarray:
    """Refine buckets by the pointers of ``other`` at a later offset."""
    n = max(0, len(other) - offset)
    return _join(ids[:n], other[offset : offset + n])


def identifiers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed pointers to depth 20 and to depth 100 of all positions that have so many bytes left."""
    ids = _BYTES[data]
    for offset in (1, 2):
        ids = _later(ids, ids, offset)
    four = ids
    for offset in (4, 8):
        ids = _later(ids, ids, offset)
    q = ids = _later(ids, four, 16)
    del four
    for offset in (20, 40):
        ids = _later(ids, ids, offset)
    return q, _later(ids, q, 80)


def _ranked(keys: np.ndarray) -> np.ndarray:
    """Each key's bucket pointer: the place of its bucket in the sorted order."""
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[False], keys[order[1:]] != keys[order[:-1]]]) if len(keys) else np.zeros(0, bool)
    out = np.empty(len(keys), np.int64)
    out[order] = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    return out


def refined(data: np.ndarray) -> np.ndarray:
    """Bucket pointers to depth DEPTH of all positions that have so many bytes left: equal only for equal strings.

    Q-gram buckets are sorted first.  Then each bucket of several members is sorted on the pointers at a later offset; its
    members' pointers are replaced in place, so that the next step, which looks at them from further left, has twice the depth.
    Positions near the end, whose strings are cut off there, have buckets of their own.
    """
    n = len(data) - DEPTH + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    total = len(data)
    eight = np.zeros(total, np.uint64)
    for i in range(8):
        eight[: total - i] |= data[i:].astype(np.uint64) << np.uint64(56 - 8 * i)
    eight = _ranked(eight)

    def pairs(first: np.ndarray, at: np.ndarray, offset: int, second: np.ndarray) -> np.ndarray:
        """Sort keys of positions: their own pointer, then the one at an offset; beyond the end each has its own."""
        later = at + offset
        return first[at] * (2 * total) + np.where(later < total, second[np.minimum(later, total - 1)], total + at)

    every = np.arange(total)
    grams = _ranked(pairs(eight, every, 8, eight))
    grams = _ranked(pairs(grams, every, 12, eight))  # bytes 0 to 15 and 12 to 19
    pointers = grams.copy()
    for offset, second in ((20, pointers), (40, pointers), (80, grams)):
        counts = np.bincount(pointers, minlength=total)
        open_ = np.flatnonzero(counts[pointers] > 1)
        keys = pairs(pointers, open_, offset, second)
        order = np.argsort(keys, kind="stable")
        keys, place = keys[order], open_[order]
        if len(keys):
            # A bucket's members stand side by side; each new bucket is named after the old one and its place within it.
            old = pointers[place]
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            begin = np.concatenate([[True], old[1:] != old[:-1]])
            where = np.arange(len(keys))
            pointers[place] = old + np.maximum.accumulate(np.where(new, where, 0)) - np.maximum.accumulate(np.where(begin, where, 0))
    return pointers[:n]


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column, as they lie in its buffer, and the edges of its values; a null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, edges, data = column.buffers()
    if not len(column) or edges is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    edges = np.frombuffer(edges, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), edges


_RUN_NAMES = ["x", "y", "k1", "k2", "at"]


def _emit(x, y, k1, k2, at, hot: np.ndarray | None = None, seen: dict | None = None) -> pa.RecordBatch:
    """Rows for the shuffle, combined as far as one batch goes.  Of equal (x, y) only the first row can decide about
    others; the rest are done, whatever comes, and are dealt out evenly: a key that many texts share stays small.
    The last two bits of ``at`` say that a row is done, and that its anchor is hot; ``seen`` holds the first of a task's runs
    of hot anchors."""
    order = np.lexsort((at, k2, k1, y, x))
    x, y, k1, k2, at = (c[order] for c in (x, y, k1, k2, at))
    same = np.concatenate([[False], (x[1:] == x[:-1]) & (y[1:] == y[:-1])])
    again = same & np.concatenate([[False], (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1]) & (at[1:] == at[:-1])])
    warm = np.zeros(len(x), bool)
    if hot is not None and len(hot):
        warm = hot[np.minimum(np.searchsorted(hot, x), len(hot) - 1)] == x
        if len(seen) > RUNS_KEPT:
            seen.clear()
        heads = np.flatnonzero(warm & ~same)
        for i, *key, a, b, c in zip(heads.tolist(), *(v[heads].tolist() for v in (x, y, k1, k2, at))):
            key, mine = tuple(key), (a, b, c)
            first = seen.get(key)
            if first is None or mine < first:
                seen[key] = mine
            elif mine == first:
                again[i] = True
            else:
                same[i] = True
    x = np.where(same, _join(x, _join(k1.view(np.uint64), at.view(np.uint64))), x)
    at = at * 4 + same + 2 * (warm & ~same)
    keep = ~again
    return pa.RecordBatch.from_arrays(
        [pa.array(c[keep].view(np.int64)) for c in (x, y, k1, k2, at)], _RUN_NAMES
    )


def _windows(batch: pa.RecordBatch, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of a batch's texts, window by window: anchor, run pointer, row, first start, number of strings."""
    data, edges = _bytes(batch.column("text"))
    for a in range(int(edges[0]), int(edges[-1]) - DEPTH + 1, block):
        part = data[a : min(a + block + DEPTH - 1, int(edges[-1]))]
        near = np.searchsorted(edges, [a, a + len(part)])
        anchor, run, first, size = runs(np.concatenate([[0], edges[near[0] : near[1]] - a, [len(part)]]), part)
        row = np.searchsorted(edges, first + a, "right") - 1
        yield anchor, run, row, first + a - edges[row], size


def _all_runs(hot: np.ndarray, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        with np.errstate(over="ignore"):
            for batch in batches:
                k1, k2 = (np.array(batch.column(c)) for c in ("k1", "k2"))
                for anchor, pointer, row, first, size in _windows(batch, block):
                    yield _emit(anchor, pointer, k1[row], k2[row], first * 128 + size, hot, seen)

    return run


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of each text, once each."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for anchor, _, row, _, _ in _windows(batch, BLOCK):
                once = np.unique(np.stack([anchor, row.astype(np.uint64)]), axis=1)[0]
                yield pa.RecordBatch.from_arrays([pa.array(once.view(np.int64))], ["x"])


def _hot_anchors(source: DataFrame, rows: int) -> np.ndarray:
    """Anchors in a thousandth of the documents or more, sorted, from a sample.  Each stands in HOT of about SAMPLE documents, so a few
    thousand at most come to the driver."""
    share = min(1.0, SAMPLE / max(rows, 1))
    some = source.where(F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).select("text")
    counts = some.mapInArrow(_anchors, "x long").groupBy("x").count().where(F.col("count") >= HOT)
    return np.sort(np.array(counts.select("x").toArrow().column("x"), np.int64).view(np.uint64))


def runs(edges: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, run pointer, first start and number of strings of each run of several texts laid end to end.

    Strings that cross a text's end are left out.  A string's anchor is the leftmost of its q-grams with the least
    leading bits; a run is the strings with their anchor at one place, at most 81, of which no two are equal.
    """
    q, full = identifiers(data)
    place = np.uint64((1 << 28) - 1)
    least = _sliding_least((q & ~place) | np.arange(len(q), dtype=np.uint64) & place, DEPTH - Q + 1)
    inside = np.ones(len(least), bool)
    for e in edges[1:-1].tolist():
        inside[max(0, e - DEPTH + 1) : e] = False
    starts = np.flatnonzero(inside)
    own = least[starts]
    new = own[1:] != own[:-1]
    at = np.flatnonzero(np.concatenate([[True], new])) if len(own) else starts
    size = np.diff(np.append(at, len(starts)))
    first = starts[at]
    offset = ((own[at] & place).astype(np.int64) - first) & int(place)
    run = _join(_join(full[first], full[first + size - 1]), size.astype(np.uint64))
    return q[first + offset], run, first, size


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (x, y, place) in; out go rows that repeat an earlier row's x and y (``mixed`` false), and the first
    row of each y under an x that has several (``mixed`` true).  Only the open bucket's state is held."""
    last = None  # x, y, and whether x has several y
    pending = None  # the first row of an x that has one y so far
    previous = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.array(batch.column(c)) for c in _RUN_NAMES]
        if previous is not None:
            before = [np.concatenate([[p], c[:-1]]) for p, c in zip(previous, cols)]
            new_x = cols[0] != before[0]
        else:
            before = [np.concatenate([c[:1], c[:-1]]) for c in cols]
            new_x = cols[0] != before[0]
            new_x[0] = True
        new_y = new_x | (cols[1] != before[1])
        done, hot = (cols[4] & 1) == 1, (cols[4] & 2) == 2
        twice = ~new_y & (cols[2] == before[2]) & (cols[3] == before[3]) & (cols[4] >> 2 == before[4] >> 2)
        repeats = (~new_y & ~twice) | done
        group = np.cumsum(new_x)
        open_group = group[0] == 0
        heads = np.bincount(group, weights=new_y, minlength=group[-1] + 1)
        several = (heads > 1) | (np.bincount(group, weights=hot, minlength=len(heads)) > 0)  # a hot anchor's other runs are elsewhere
        if open_group:
            several[0] |= last or heads[0] > 0
        mixed = new_y & several[group] & ~done
        extra = None
        if open_group and not last and heads[0] > 0 and pending is not None:
            extra = pending
        picked = np.flatnonzero(repeats | mixed)
        rows = [c[picked] for c in cols]
        flags = mixed[picked]
        if extra is not None:
            rows = [np.concatenate([[e], c]) for e, c in zip(extra, rows)]
            flags = np.concatenate([[True], flags])
        if group[-1] > 0 or not open_group:  # the bucket that is open at the batch's end began in this batch
            begin = int(np.flatnonzero(new_x)[-1])
            last = bool(several[group[-1]])
            pending = None if last or done[begin] else [c[begin] for c in cols]
        else:
            last = bool(several[0])
            pending = None if last else pending
        previous = [c[-1] for c in cols]
        if len(flags):
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in (rows[0], rows[2], rows[3], rows[4] >> 2)), pa.array(flags, pa.bool_())],
                ["x", "k1", "k2", "at", "mixed"],
            )


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The numbers of each list of a column without nulls."""
    edges, values = np.array(column.offsets), np.array(column.values)
    return [values[i:j] for i, j in zip(edges[:-1], edges[1:])]


def _laid(body: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of runs of a text, side by side."""
    length = size + DEPTH - 1
    return body[np.arange(length.sum()) - np.repeat(np.cumsum(length) - length - start, length)]


def _own(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the strings of runs laid side by side, and each string's number within its run."""
    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    length = size + DEPTH - 1
    return np.repeat(np.cumsum(length) - length, size) + nth, nth


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single strings of the open runs of large buckets: pointer, anchor, place."""
    with np.errstate(over="ignore"):
        out, total = [], 0
        for batch in batches:
            k1, k2 = (np.array(batch.column(c)) for c in ("k1", "k2"))
            data, edges = _bytes(batch.column("text"))
            for i, (at, xs) in enumerate(zip(_lists(batch.column("open_at")), _lists(batch.column("open_x")))):
                body = data[edges[i] : edges[i + 1]]
                for a in range(0, len(at), BLOCK // 256):
                    start, size = at[a : a + BLOCK // 256] >> 7, at[a : a + BLOCK // 256] & 127
                    place, nth = _own(size)
                    full = identifiers(_laid(body, start, size))[1][place]
                    anchor = np.repeat(xs[a : a + BLOCK // 256].view(np.uint64), size)
                    out.append((full, anchor, np.full(len(full), k1[i]), np.full(len(full), k2[i]), np.repeat(start, size) + nth))
                    total += len(full)
                    if total >= STRINGS:
                        yield _emit(*map(np.concatenate, zip(*out)))
                        out, total = [], 0
        if out:
            yield _emit(*map(np.concatenate, zip(*out)))


def _open_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the open runs of small buckets: anchor, place, bytes."""
    for batch in batches:
        k1, k2 = (np.array(batch.column(c)) for c in ("k1", "k2"))
        data, edges = _bytes(batch.column("text"))
        for i, (at, xs) in enumerate(zip(_lists(batch.column("open_at")), _lists(batch.column("open_x")))):
            body = data[edges[i] : edges[i + 1]]
            for a in range(0, len(at), BLOCK // 64):
                part = at[a : a + BLOCK // 64]
                start, size = part >> 7, part & 127
                cuts = np.concatenate([[0], np.cumsum(size + DEPTH - 1)]).astype(np.int32)
                bodies = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(cuts), pa.py_buffer(_laid(body, start, size))])
                numbers = (xs[a : a + len(part)], np.full(len(part), k1[i]), np.full(len(part), k2[i]), part)
                yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), bodies], ["x", "k1", "k2", "at", "body"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open runs sorted by anchor and place in; out go the places of strings that stand earlier in their bucket, as
    (start, number).  A bucket has MOST_LOCAL runs at most; only the open one is kept between batches."""
    held: list[pa.RecordBatch] = []

    def settled(table: pa.Table) -> pa.RecordBatch:
        x, k1, k2, at = (np.array(table.column(c)) for c in ("x", "k1", "k2", "at"))
        body = np.concatenate([(lambda d, e: d[e[0] : e[-1]])(*_bytes(c)) for c in table.column("body").chunks])
        start, size = at >> 7, at & 127
        place, nth = _own(size)
        pointers = refined(body)[place]
        run = np.repeat(np.arange(len(at)), size)
        order = np.lexsort((nth, run, pointers, x[run]))
        same = np.concatenate([[False], (pointers[order][1:] == pointers[order][:-1]) & (x[run[order]][1:] == x[run[order]][:-1])])
        hit = np.zeros(len(pointers), bool)
        hit[order] = same
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        a, b = edge[::2], edge[1::2]
        # A stretch of hits may run over the end of a run: cut it there.
        cuts = np.cumsum(size)[:-1]
        points = np.unique(np.concatenate([a, cuts[hit[cuts] & hit[cuts - 1]] if len(cuts) else cuts]))
        ends = np.minimum(np.append(points[1:], len(hit)), b[np.searchsorted(b, points, "right")] if len(b) else points)
        own = run[points]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (k1[own], k2[own], (start[own] + nth[points]) * 128 + (ends - points))], ["k1", "k2", "at"]
        )

    for whole in batches:
        for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
            x = np.array(batch.column("x"))
            last = 0 if x[0] == x[-1] else int(np.flatnonzero(x != x[-1])[-1]) + 1
            if not last and held and held[-1].column("x")[-1].as_py() != int(x[0]) and sum(h.nbytes for h in held) > BLOCK:
                yield settled(pa.Table.from_batches(held))
                held = [batch]
            elif last and sum(h.nbytes for h in held) + batch.nbytes > BLOCK:
                yield settled(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = [batch.slice(last)]
            else:
                held.append(batch)
    if held:
        yield settled(pa.Table.from_batches(held))


_SHUFFLED = "x long, y long, k1 long, k2 long, at long"


def _repeats(rows: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one, and the undecided ones.  Runs of a hot anchor are dealt by run pointer as well."""
    hot = F.col("at").bitwiseAND(2) > 0
    return rows.repartition(F.when(hot, F.xxhash64("x", "y")).otherwise(F.col("x"))).sortWithinPartitions(*_RUN_NAMES).mapInArrow(
        _found, "x long, k1 long, k2 long, at long, mixed boolean"
    )


def merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Maximal runs (start, end) of the union of intervals; touching intervals are one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return np.stack([starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]], axis=1)


def _spans(run_at: pa.Array | None, string_at: pa.Array | None) -> np.ndarray:
    at = np.concatenate([np.zeros(0, np.int64), *(np.array(a, np.int64) for a in (run_at, string_at) if a is not None)])
    if not len(at):
        return np.zeros((0, 2), np.int64)
    return merged(at >> 7, (at >> 7) + (at & 127) + DEPTH - 1)


def located(docs: DataFrame, rest: dict, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Where texts repeat.  Returns the documents with a repeat (all columns of ``docs``, ``__runs`` and ``__strings``:
    places of removed runs and strings) and the others, reduced to the columns of ``rest`` (name to expression).

    Texts are shuffled once; runs once, before it; strings and the texts of documents that have repeats once more.
    """
    ids = docs.select(F.col(id_col).alias("id"))
    rows, groups = ids.groupBy("id").count().agg(F.sum("count"), F.count("*")).first()
    unique = (rows or 0) == groups and ids.where("id is null").isEmpty()
    keys = {
        "__k1": F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)),
        "__k2": F.lit(0).cast("long") if unique else F.xxhash64(text_col),
    }
    source = docs.withColumns(keys)
    narrow = source.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col(text_col).alias("text"))
    hot = _hot_anchors(narrow, rows or 0)
    found = written(_repeats(narrow.mapInArrow(_all_runs(hot, block), _SHUFFLED)), "runs", sweep=True)
    limit = min(MOST_LOCAL, max(LEAST_LOCAL, int(LOCAL_SHARE * found.where("mixed").count())))
    large = written(found.where("mixed").groupBy("x").count().where(F.col("count") > limit).select("x", F.lit(True).alias("large")), "large")
    is_large = F.coalesce("large", F.lit(False))
    places = written(
        found.join(large, "x", "left").groupBy("k1", "k2").agg(
            F.collect_list(F.when(~F.col("mixed"), F.col("at"))).alias("__runs"),
            F.collect_list(F.when(F.col("mixed") & is_large, F.struct("at", "x"))).alias("__far"),
            F.collect_list(F.when(F.col("mixed") & ~is_large, F.struct("at", "x"))).alias("__near"),
        ),
        "places",
    ).withColumnsRenamed({"k1": "__k1", "k2": "__k2"})
    hit = F.col("__runs").isNotNull()
    joined = source.join(places, ["__k1", "__k2"], "left").withColumn("__hit", hit)
    wide = [F.when(hit, F.col(c)).alias(c) for c in docs.columns]
    table = written(joined.select("__k1", "__k2", "__hit", *wide, F.struct(*[F.when(~hit, e).alias(c) for c, e in rest.items()]).alias("__rest"), "__runs", "__far", "__near"), "texts", sweep=True)
    others = table.where("not __hit").select("__rest.*")
    hits = table.where("__hit").drop("__rest", "__hit")

    def opened(column: str) -> DataFrame:
        return hits.where(F.size(column) > 0).select(
            F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col(text_col).alias("text"), F.col(f"{column}.at").alias("open_at"), F.col(f"{column}.x").alias("open_x")
        )

    far = _repeats(opened("__far").mapInArrow(_strings, _SHUFFLED)).where("not mixed").select("k1", "k2", (F.col("at") * 128 + 1).alias("at"))
    near = opened("__near").mapInArrow(_open_runs, "x long, k1 long, k2 long, at long, body binary")
    near = near.repartition("x").sortWithinPartitions("x", "k1", "k2", "at").mapInArrow(_settle, "k1 long, k2 long, at long")
    strings = written(far.unionByName(near).groupBy("k1", "k2").agg(F.collect_list("at").alias("__strings")), "strings", sweep=True)
    hits = hits.drop("__far", "__near").join(
        strings.withColumnsRenamed({"k1": "__k1", "k2": "__k2"}), ["__k1", "__k2"], "left"
    )
    return hits.drop("__k1", "__k2"), others


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    body = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    zero = F.lit(0).cast("long")
    rest = {"doc_id": F.col(id_col), "n_bytes": F.length(body).cast("long"), "n_removed": zero, "n_spans": zero, "kept_sha256": F.sha2(body, 256)}
    hits, others = located(docs.select(id_col, text_col), rest, id_col, text_col, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            data, edges = _bytes(batch.column("text"))
            for i, (a, b) in enumerate(zip(*(batch.column(c) for c in ("__runs", "__strings")))):
                body = data[edges[i] : edges[i + 1]].tobytes()
                spans = _spans(a.values, b.values)
                out.append((len(body), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(_left(body, spans)).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    done = hits.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), "__runs", "__strings").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    return done.unionByName(others)


def _left(body: bytes, spans: np.ndarray) -> bytes:
    at, out = 0, []
    for a, b in spans.tolist():
        out.append(body[at:a])
        at = b
    out.append(body[at:])
    return b"".join(out)


def whole_characters(body: bytes, spans: np.ndarray) -> np.ndarray:
    """Spans shrunk to whole code points, so that what is left is UTF-8; empty ones are dropped."""
    out = []
    for a, b in spans.tolist():
        while a < b and body[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(body) and body[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of the texts (whole code points).  Documents that lose all of their text
    are left out; those that were empty stay."""
    given, docs = docs.columns, numbered(docs)  # no column's name can clash
    id_col, text_col = (f"c{given.index(c)}" for c in (id_col, text_col))
    names = docs.columns
    hits, others = located(docs, {c: F.col(c) for c in names}, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            data, edges = _bytes(batch.column(text_col))
            for i, (a, b) in enumerate(zip(*(batch.column(c) for c in ("__runs", "__strings")))):
                body = data[edges[i] : edges[i + 1]].tobytes()
                texts.append(_left(body, whole_characters(body, _spans(a.values, b.values))).decode())
            columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    from pyspark.sql.types import StructType

    schema = StructType([docs.schema[c] for c in names])
    return hits.mapInArrow(run, schema).where(F.length(text_col) > 0).unionByName(others).toDF(*given)
