"""Near-duplicate groups by order MinHash (Marcais et al., 2019).

A text's k-mers are its windows of five words, labelled with their occurrence number.  Each of SKETCHES sketches takes the
TAKEN k-mers with the least hashes and keeps them in text order, so that two sketches are equal only if the texts share these
k-mers in the same order.  Texts with an equal sketch are candidates.  A candidate pair is a link if a banded alignment of the
words finds an edit similarity (one minus distance over the longer length) of at least 0.8; nothing else decides.

Candidates are formed without all pairs of a group.  Equal texts are one node from the start.  Then each sketch bucket compares its
members with one leader, and links are closed transitively.  In buckets that still mix components, the members outside of the
largest one are compared with the members of other components, whatever the bucket's size.  This is done in blocks: the bitmaps of such members
meet blocks of the others, which leaves each a list of partners; then the texts of blocks of members meet the texts on their lists.  No row
stands for a pair.  A pair is left out before its alignment only if the lengths, or the parity bitmaps of the words, prove a similarity below 0.8.

Recall: texts with a share J of common k-mers agree in one sketch with probability of about J^2, and in none of 48 with (1 - J^2)^48.
Changes that are spread evenly leave J = 0.2 at an edit similarity of 0.8 (86 % of pairs are candidates), 0.35 at 0.87 (99.8 %); changes
that stand together leave more.  Texts of a few words lose most k-mers to one change.

Defined cases: null and empty texts are equal to each other and to nothing else, as are all texts that lack a word
only if equal byte for byte; texts of one to four words are one k-mer; words are what str.split finds; repeated rows share a class;
null ids are kept, a class whose ids are all null has a null class id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import numbered, written

K = 5
SIMILARITY = 0.8
#: Sketches of a text, and the k-mers in each.
SKETCHES, TAKEN = 48, 2
#: Hashes of words that a task remembers at most.
WORDS_KEPT = 400_000
#: 64-bit words of the parity bitmaps that rule pairs out.  In texts far longer than its 1024 bits they rule out less, and the alignment
#: decides.
PARITY_WORDS = 16
#: Members of a mixed bucket whose bitmaps meet at a time; larger buckets are dealt into blocks of about this size.
SMALL_BUCKET = 1024
#: Members whose texts are held while the texts on their lists pass by.
TOGETHER = 64
#: Texts on the lists of a block that one task aligns, about.
PARTNERS = 1024


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; wraps around."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """64-bit hashes of a text's words; remembers a bounded number of them."""

    def __init__(self) -> None:
        self._known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        known = self._known
        if len(known) > WORDS_KEPT:
            known.clear()
        words = (text or "").split()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter((known[w] for w in words), np.uint64, len(words))


def kmers(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the windows of k words; a shorter text is one window."""
    n = max(1, len(hashes) - k + 1) if len(hashes) else 0
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(k, len(hashes))):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
        return _mix(out)


def labelled(windows: np.ndarray) -> np.ndarray:
    """Add the number of earlier equal windows to each window; the first of its kind stays as it is."""
    order = np.argsort(windows, kind="stable")
    sorted_windows = windows[order]
    new = np.flatnonzero(np.concatenate([[True], sorted_windows[1:] != sorted_windows[:-1]]))
    if len(new) == len(windows):
        return windows
    nth = np.arange(len(windows)) - np.repeat(new, np.diff(np.append(new, len(windows))))
    again = np.flatnonzero(nth)
    out = windows.copy()
    with np.errstate(over="ignore"):
        out[order[again]] = _mix(sorted_windows[again] + nth[again].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return out


def _least_in_order(labels: np.ndarray, seeds: np.ndarray, take: int) -> np.ndarray:
    """Positions of the ``take`` labels with the least hashes under each seed, in text order."""
    x = (labels >> np.uint64(32)).astype(np.uint32)[None, :] ^ (seeds >> np.uint64(32)).astype(np.uint32)[:, None]
    x *= np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    if take == x.shape[1]:
        return np.tile(np.arange(take), (len(seeds), 1))
    least = np.partition(x, take - 1, axis=1)[:, take - 1 : take]
    row, at = np.nonzero(x <= least)
    if len(row) == take * len(seeds):
        return at.reshape(-1, take)
    return np.sort(np.argsort(x, axis=1, kind="stable")[:, :take], axis=1)  # equal hashes: the earlier position


def parities(words: np.ndarray) -> np.ndarray:
    """A bitmap of 64 * PARITY_WORDS bits (Sandes et al., 2020): each the parity of the number of labelled words that fall on it."""
    at = (labelled(words) % np.uint64(64 * PARITY_WORDS)).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    return np.packbits((np.bincount(at, minlength=64 * PARITY_WORDS) & 1).astype(bool)).view(np.int64)


def sketches(words: np.ndarray) -> np.ndarray:
    """Keys of all sketches of a text, as signed 64-bit numbers; each key tells its sketch's number."""
    windows = kmers(words)
    n = len(windows)
    if not n:
        return np.zeros(0, np.int64)
    labels, take, keys = labelled(windows), min(TAKEN, n), []
    with np.errstate(over="ignore"):
        seeds = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
        step = max(1, 4_000_000 // n)
        for a in range(0, SKETCHES, step):
            part = seeds[a : a + step]
            ordered = windows[_least_in_order(labels, part, take)]
            key = part + np.uint64(TAKEN)
            for i in range(take):
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + ordered[:, i])
            keys.append(key.view(np.int64))
    return np.concatenate(keys)


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if at most ``most``, else ``most + 1``.

    Only cells at most ``most`` off the main diagonal are worked on; one integer holds a column of the band, its bits
    the differences between neighbouring cells (Myers, 1999; Hyyro, 2003).
    """
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return most + 1
    if not m or not n:
        return max(m, n)
    most = max(most, 1)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    mask = (1 << 2 * most + 1) - 1
    up, down = mask & ~((1 << most) - 1), 0
    score = min(most, m)
    for j in range(n):
        equal = places.get(b[j], 0)
        equal = (equal >> j - most if j >= most else equal << most - j) & mask
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & mask
        right_up = (down | ~(diagonal | up)) & mask
        right_down = diagonal & up
        if j + most <= m - 1:
            score += not diagonal >> 2 * most & 1
        else:
            bit = m - 1 - j + most
            score += (right_up >> bit & 1) - (right_down >> bit & 1)
        up = (right_down | ~(diagonal >> 1 | right_up)) & mask
        down = diagonal >> 1 & right_up
    return min(score, most + 1)


class Parsed:
    """What the verification needs of one text."""

    def __init__(self, text: str | None, words: Words):
        hashes = words(text)
        self.words = hashes.tolist()
        self.labels = np.sort(labelled(hashes)) if len(hashes) else hashes


def most_edits(longer: int, least: float = SIMILARITY) -> int:
    return int((1 - least) * longer + 1e-9)


def similar(a: Parsed, b: Parsed, least: float = SIMILARITY) -> bool:
    """Whether two texts are a link: a banded alignment of their words finds few enough edits.

    Words that only one of the texts has are edits in any alignment, so pairs with too many of them are not aligned.
    """
    x, y = a.words, b.words
    longer = max(len(x), len(y))
    most = most_edits(longer, least)
    if not x or not y or longer - min(len(x), len(y)) > most:
        return False
    if len(np.intersect1d(a.labels, b.labels, assume_unique=True)) < longer - most:
        return False
    first, last = 0, 0  # what both begin and end with needs no alignment
    shorter = min(len(x), len(y))
    while first < shorter and x[first] == y[first]:
        first += 1
    while last < shorter - first and x[-1 - last] == y[-1 - last]:
        last += 1
    return banded_distance(x[first : len(x) - last], y[first : len(y) - last], most) <= most


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A map over the scan: id, node (digest of the text), keys (its sketches), n (its words), bits (their parity bitmap)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            keys, n, bits = [], [], []
            for text in batch.column("text"):
                hashes = words(text.as_py())
                keys.append(sketches(hashes))
                n.append(len(hashes))
                bits.append(parities(hashes))
            columns = [pa.array(keys, pa.list_(pa.int64())), pa.array(n, pa.int64()), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("node"), *columns], ["id", "node", "keys", "n", "bits"])

    return docs.select(F.col(id_col).alias("id"), node_of(text_col), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, node binary, keys array<long>, n long, bits array<long>"
    )


def node_of(text_col: str):
    """Digest of a text, null as empty: equal texts are one node."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("node")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are links.  Both joins are plain joins on a node, split if one node is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = Words(), {}
        for batch in batches:
            a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))
            good = []
            for x, y, tx, ty in zip(a, b, ta, tb):
                if x not in held:
                    held = {x: Parsed(tx, words)}  # pairs arrive sorted by a
                good.append(similar(held[x], Parsed(ty, words)))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    full = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return full.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def _stars(rows: DataFrame) -> DataFrame:
    """Pairs of each bucket's leader with its other members; rows: key, node, root, rank.  The leader is the member with the
    least rank.  Members of the leader's own component are left out."""
    leaders = written(
        rows.groupBy("key").agg(F.min(F.struct("rank", "node", "root")).alias("l")).select("key", F.col("l.node").alias("a"), F.col("l.root").alias("own")),
        "leaders",
    )
    return rows.join(leaders, "key").where("node <> a and root <> own").select("a", F.col("node").alias("b")).distinct()


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of buckets that hold members of several components."""
    several = written(rows.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key"), "mixed")
    return rows.join(several, "key")


def _near(a: str, b: str):
    """Whether lengths and bitmaps leave a pair a chance.  With c words in common (repeats counted) a pair has max(n) - c edits at least, and
    n_a + n_b - 2 c words that only one of them has; two parity bitmaps never differ in more bits than that."""
    na, nb = F.col(f"n{a}"), F.col(f"n{b}")
    longer = F.greatest(na, nb)
    most = F.floor((1 - SIMILARITY) * longer + 1e-9)
    differ = sum(F.bit_count(F.col(f"w{i}{a}").bitwiseXOR(F.col(f"w{i}{b}"))) for i in range(PARITY_WORDS))
    return (F.least(na, nb) >= longer - most) & (differ <= na + nb - 2 * longer + 2 * most)


def _sided(frame: DataFrame, side: str, *same: str) -> DataFrame:
    return frame.select(*same, *[F.col(c).alias(c + side) for c in frame.columns if c not in same])


def _possible(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that lengths and bitmaps leave a chance."""
    one = pairs.join(_sided(bits, "a").withColumnRenamed("nodea", "a"), "a")
    return one.join(_sided(bits, "b").withColumnRenamed("nodeb", "b"), "b").where(_near("a", "b")).select("a", "b")


def _cells(mixed: DataFrame, bits: DataFrame) -> DataFrame:
    """Members of mixed buckets, split by length: a text stands in the cell of its length class and in the next one, so texts whose lengths
    differ by a fifth at most meet.  Cells of one component are dropped; ``big`` is the largest component, ``blocks`` the number of blocks."""
    known = mixed.join(bits, "node").withColumn("class", F.floor(F.log("n") / F.log(F.lit(1 / SIMILARITY)) + 1e-9))
    placed = known.withColumn("cell", F.explode(F.array(F.col("class"), F.col("class") + 1)))
    cell = ["key", "cell"]
    parts = placed.groupBy(*cell, "root").count()
    sizes = written(
        parts.groupBy(*cell).agg(F.max(F.struct("count", "root")).alias("big"), F.sum("count").alias("size"), F.count("*").alias("roots"))
        .where("roots > 1").select(*cell, F.col("big.root").alias("big"), F.ceil(F.col("size") / SMALL_BUCKET).alias("blocks")),
        "sizes",
    )
    return written(placed.join(sizes, cell), "cells")


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Groups of equal ``names`` (numbers) of sorted rows; only the open group is held between batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([np.array(batch.column(c)) for c in names], 1)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), len(values)]
        if held and any(held[-1].column(c)[-1].as_py() != v for c, v in zip(names, values[0].tolist())):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            held.append(batch.slice(a, b - a))
            if i < len(cuts) - 2:
                yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells' blocks in; out go the members that came to a block (``own`` false) with the block's members (``own`` true) that they may equal."""
    for group in _groups(batches, ["key", "cell", "block"]):
        own = np.array(group.column("own"), bool)
        come = np.flatnonzero(~own)
        if not len(come) or len(come) == len(own):
            continue
        node = np.array(group.column("node").to_pylist(), object)
        order = np.array([int.from_bytes(x[:8], "big") for x in node], np.uint64)
        _, root = np.unique(np.array([x.hex() for x in group.column("root").to_pylist()]), return_inverse=True)
        level, n = (np.array(group.column(c)) for c in ("class", "n"))
        small, cell = np.array(group.column("small"), bool), group.column("cell")[0].as_py()
        bits = np.array(group.column("bits").flatten()).reshape(len(own), -1).view(np.uint64)
        here = np.flatnonzero(own)
        out_a, out_b = [], []
        for i in come.tolist():
            longer = np.maximum(n[i], n[here])
            most = np.floor((1 - SIMILARITY) * longer + 1e-9).astype(np.int64)
            good = (root[here] != root[i]) & (np.maximum(level[i], level[here]) == cell) & (np.minimum(n[i], n[here]) >= longer - most)
            good &= ~small[here] | (order[i] <= order[here])  # two that both go round meet twice
            if good.any():
                at = here[good]
                differ = np.bitwise_count(bits[i] ^ bits[at]).sum(1).astype(np.int64)
                at = at[differ <= (n[i] + n[at] - 2 * longer[good] + 2 * most[good])]
                if len(at):
                    out_a.append(node[i])
                    out_b.append(node[at].tolist())
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.list_(pa.binary()))], ["a", "partners"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of members with their lists, each followed by the texts on the lists; out go the links."""
    words, block, asked = Words(), None, []
    for batch in batches:
        found_a, found_b = [], []
        columns = (batch.column(c) for c in ("block", "part", "own", "node", "text", "partners"))
        for key, part, own, node, text, partners in zip(*columns):
            if (key, part) != block:
                block, asked = (key, part), []
            name = node.as_py()
            if not own.as_py():
                asked.append((name, Parsed(text.as_py(), words), set(partners.as_py())))
                continue
            parsed = None
            for a, mine, wanted in asked:
                if name in wanted:
                    parsed = parsed or Parsed(text.as_py(), words)
                    if similar(mine, parsed):
                        found_a.append(a)
                        found_b.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.binary()), pa.array(found_b, pa.binary())], ["a", "b"])


def _across(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between members of a cell in different components.

    Of a cell of m members, r are not in its largest component.  They meet the cell's blocks of SMALL_BUCKET members: r x m / SMALL_BUCKET
    rows of bitmaps.  Members with lists, in blocks by a bucket that they share, meet the texts on these lists: as many rows as there are texts on the lists of a
    block, once for all of its members.
    """
    some = ["key", "cell", "block"]
    bits = F.array(*[F.col(f"w{i}") for i in range(PARITY_WORDS)]).alias("bits")
    small = F.col("root") != F.col("big")
    every = cells.withColumns({"block": F.pmod(F.xxhash64("node"), F.col("blocks")), "own": F.lit(True), "small": small})
    come = cells.where(small).withColumns({"own": F.lit(False), "small": F.lit(True)}).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    columns = [*some, "own", "node", "root", "class", "small", "n", bits]
    rows = come.select(*columns).unionByName(every.select(*columns))
    lists = rows.repartition(*some).sortWithinPartitions(*some).mapInArrow(_meet, "a binary, partners array<binary>")
    lists = written(lists.groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("partners"))).alias("partners")), "lists")

    # Members whose least common bucket is the same have much the same partners: they make blocks.
    place = written(cells.where(small).groupBy("node").agg(F.min("key").alias("place")), "places")
    sizes = written(place.groupBy("place").agg(F.ceil(F.count("*") / TOGETHER).alias("blocks")), "block-sizes")
    block = F.xxhash64("place", F.pmod(F.xxhash64("node"), F.col("blocks")))
    asked = written(place.join(sizes, "place").select(F.col("node").alias("a"), block.alias("block")).join(lists, "a"), "asked")
    union = asked.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("partners"))).alias("partners"))
    union = written(union.withColumn("parts", F.ceil(F.size("partners") / PARTNERS)), "unions")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    left = asked.join(union.select("block", parts), "block").join(texts.withColumnRenamed("node", "a"), "a")
    right = union.select("block", "parts", F.explode("partners").alias("node")).join(texts, "node")
    right = right.select("block", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), F.lit(True).alias("own"), "node", "text", F.lit(None).cast("array<binary>").alias("partners"))
    both = left.select("block", "part", F.lit(False).alias("own"), F.col("a").alias("node"), "text", "partners").unionByName(right)
    return both.repartition("block", "part").sortWithinPartitions("block", "part", "own").mapInArrow(_align, "a binary, b binary")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (key, node) with the root of each node's component."""
    return rows.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Class of every row: id, node, class_id (least id of the class), n_texts (different texts of the class), keep.

    ``keep`` marks the row (or the equal repeated rows) that stands for its class: the least id, and of texts under the same id
    the least digest.
    """
    rows = written(signatures(docs, id_col, text_col), "signatures")
    nodes = written(
        rows.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "keys", "n", "bits")).alias("s")).select("node", "s.id", "s.keys", "s.n", "s.bits"), "nodes"
    )
    spread = nodes.select("node", F.explode("keys").alias("key"))
    shared = written(spread.groupBy("key").count().where("count > 1"), "shared", sweep=True)
    members = written(spread.join(shared, "key").select("key", "node", "count"), "members", sweep=True)
    # Texts and bitmaps of all nodes that have a candidate, once.
    ranks = written(members.groupBy("node").agg((-F.sum(F.col("count") - 1)).alias("rank")), "ranks")
    bits = written(nodes.join(ranks.select("node"), "node").select("node", "n", *[F.col("bits")[i].alias(f"w{i}") for i in range(PARITY_WORDS)]), "bits")
    texts = written(
        docs.select(F.col(id_col).alias("id"), node_of(text_col), F.col(text_col).alias("text"))
        .join(nodes.select("node", "id").join(ranks, "node"), ["node", "id"], "left_semi")
        .dropDuplicates(["node"])
        .select("node", "text"),
        "texts",
        sweep=True,
    )
    # Leaders are texts that share sketches with many others: near the middle of a group, they link to most of it.
    fresh = members.join(ranks, "node").select("key", "node", F.col("node").alias("root"), "rank")
    links = written(_verified(written(_possible(_stars(fresh), bits), "stars"), texts), "verified", sweep=True)
    roots = written(components(links), "roots")
    # What is left: members of buckets with several components.
    cells = _cells(_mixed(_rooted(members.select("key", "node"), roots)), bits)
    links = written(links.unionByName(_across(cells, texts)), "all_links", sweep=True)
    roots = written(components(links), "roots")

    member = written(nodes.select("node", "id").join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root")), "member")
    classes = written(
        member.groupBy("root").agg(
            F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "node")).alias("first"), F.count("*").alias("n_texts")
        ).select("root", F.col("first.id").alias("class_id"), F.col("first.node").alias("class_node"), "n_texts"),
        "classes",
    )
    by_node = written(member.join(classes, "root").select("node", "class_id", "class_node", "n_texts"), "by_node")
    return rows.select("id", "node").join(by_node, "node").select(
        "id", "node", "class_id", "n_texts", (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("class_node"))).alias("keep")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class.  Equal repeated rows of one id become one row."""
    own = numbered(docs)  # no column's name can clash
    own_id, own_text = (own.columns[docs.columns.index(c)] for c in (id_col, text_col))
    kept = written(near_duplicates(own, own_id, own_text).where("keep").select("id", "node"), "kept")
    single = kept.distinct()
    repeated = kept.count() > single.count()
    keyed = own.withColumn("node", node_of(own_text))
    joined = keyed.alias("d").join(single.alias("k"), (F.col("k.node") == F.col("d.node")) & F.col("k.id").eqNullSafe(F.col(f"d.{own_id}")), "left_semi")
    return (joined.dropDuplicates(["node", own_id]) if repeated else joined).drop("node").toDF(*docs.columns)
