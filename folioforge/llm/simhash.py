"""SimHash fingerprints (Charikar, 2002; Manku et al., 2007).

Terms are words and pairs of neighbouring words.  Each distinct term's hash votes on every bit of the
fingerprint, for it where the hash has a one and against it where it has a zero, with a weight that grows with the
term's count and is higher for pairs, which tell texts apart.  The sign of the sum is the bit.  The likeness of two
fingerprints is the share of equal bits.

``within`` finds all fingerprints in a Hamming radius: a fingerprint is cut into radius + 1 blocks, and each of the
permuted tables has another block in front; two fingerprints at most ``radius`` bits apart agree on a block at least.

Defined cases: a null text is empty; a text without words has the fingerprint of zeros; equal texts have equal
fingerprints; repeated rows are neighbours of each other; an empty table gives an empty result; a table of one row
is its own next document; null ids come after all others.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written

BITS = 128
PAIR_WEIGHT = 3.0
#: Hashes of words that a task remembers at most.
WORDS_KEPT = 400_000


class Fingerprinter:
    """Fingerprints of texts; remembers the hashes of frequent words, up to a fixed number."""

    def __init__(self) -> None:
        self._known: dict[bytes, int] = {}

    def _hashes(self, words: list[bytes]) -> list[int]:
        import xxhash

        known = self._known
        if len(known) > WORDS_KEPT:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_128_intdigest(w)
            out.append(h)
        return out

    def __call__(self, text: str) -> str:
        words = text.encode("utf-8", "surrogatepass").split()
        if not words:
            return "0" * (BITS // 4)
        single = Counter(words)
        raw = b"".join(h.to_bytes(16, "little") for h in self._hashes(list(single)))
        hashes = np.frombuffer(raw, np.uint64).reshape(-1, 2)
        weights = np.log2(1.0 + np.fromiter(single.values(), np.float64, len(single)))
        if len(words) > 1:
            at = {w: i for i, w in enumerate(single)}
            place = np.fromiter((at[w] for w in words), np.int64, len(words))
            keys, counts = np.unique(place[:-1] * len(at) + place[1:], return_counts=True)
            left, right = hashes[keys // len(at)], hashes[keys % len(at)]
            with np.errstate(over="ignore"):
                pair = (left * np.uint64(0x9E3779B97F4A7C15) + right) * np.uint64(0xD6E8FEB86659FD93)
                pair ^= pair >> np.uint64(32)
                pair *= np.uint64(0xD6E8FEB86659FD93)
                pair ^= pair >> np.uint64(29)
            hashes = np.concatenate([hashes, pair])
            weights = np.concatenate([weights, PAIR_WEIGHT * np.log2(1.0 + counts)])
        votes = np.zeros(BITS)
        for a in range(0, len(hashes), 8192):  # a long text's bits are voted on in blocks
            bits = np.unpackbits(np.ascontiguousarray(hashes[a : a + 8192]).view(np.uint8).reshape(-1, 16), axis=1)
            votes += weights[a : a + 8192] @ bits
        return np.packbits(votes * 2 > weights.sum()).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal bits of two fingerprints in hexadecimal."""
    return 1.0 - (int(a, 16) ^ int(b, 16)).bit_count() / (4 * len(a))


def edited(text: str, following: str) -> str:
    """The text whose last third is replaced by the beginning of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_OUT = "doc_id {0}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGE = ", edge boolean, task long, head_id {0}, head_key long, head_text string, tail_text string, tail_print string, head_print string"
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _outcome(key, text: str, own: str, following: str, next_print: str, printer: Fingerprinter) -> tuple:
    changed = edited(text, following)
    other = printer(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return key, len(text), digest, own, other, likeness(own, other), likeness(own, next_print)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text and its edited text (last third from the next document, by descending id).

    Texts are range-partitioned by id once and each task streams through its sorted rows, holding two texts.  A task's
    last row needs the first row of the next task: these few rows, one pair a task, are joined afterwards.
    """
    key_type = docs.schema[id_col].dataType.simpleString()
    schema = (_OUT + _EDGE).format(key_type)
    arrow = [docs.select(F.col(id_col)).schema.fields[0].dataType]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(arrow[0])
        types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_(),
                 pa.int64(), kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        names = [x.split()[0] for x in schema.split(", ")]
        pack = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], names
        )
        printer, head, last = Fingerprinter(), None, None
        for batch in batches:
            done = []
            for key, order, text in zip(*(batch.column(c).to_pylist() for c in ("id", "order", "text"))):
                now = (key, order, text, last[3] if last and last[2] == text else printer(text))
                head = head or now
                if last:
                    done.append((*_outcome(last[0], last[2], last[3], text, now[3], printer), False, *[None] * 7))
                last = now
            if done:
                yield pack(done)
        if last:
            task = TaskContext.get().partitionId()
            yield pack([(last[0], *[None] * 6, True, task, head[0], head[1], head[2], last[2], last[3], head[3])])

    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("order"), F.coalesce(text_col, F.lit("")).alias("text")
    )
    order = [F.desc_nulls_last("id"), F.asc("order")]
    ran = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "fingerprints")
    # One row a task; the order of the tasks is worked out on numbers alone, the texts follow by a join.
    edges = ran.where("edge")
    line = edges.select("task", "head_id", "head_key")
    by_head = W.orderBy(F.desc_nulls_last("head_id"), F.asc("head_key"), F.asc("task"))
    links = line.select(
        "task",
        F.coalesce(
            F.lead("task").over(by_head),
            F.first("task").over(by_head.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        ).alias("next_task"),
    )
    heads = edges.select(F.col("task").alias("next_task"), F.col("head_text").alias("next_text"), F.col("head_print").alias("next_print"))
    pairs = edges.select("task", "doc_id", "tail_text", "tail_print").join(links, "task").join(heads, "next_task")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Fingerprinter()
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "tail_text", "tail_print", "next_text", "next_print"))
            rows = [_outcome(*x, printer) for x in zip(*columns)]
            kinds = [batch.schema.field("doc_id").type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _NAMES)

    closed = pairs.select("doc_id", "tail_text", "tail_print", "next_text", "next_print").mapInArrow(close, _OUT.format(key_type))
    return ran.where("not edge").select(*_NAMES).unionByName(closed)


def blocks(radius: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(first hexadecimal digit, number of digits) of each of the radius + 1 blocks."""
    digits = bits // 4
    if not 0 <= radius < digits:
        raise ValueError("the radius must be below the number of hexadecimal digits")
    edges = [round(i * digits / (radius + 1)) for i in range(radius + 2)]
    return [(a + 1, b - a) for a, b in zip(edges, edges[1:])]


def within(prints: DataFrame, queries: DataFrame, radius: int = 3, bits: int = BITS) -> DataFrame:
    """Fingerprints at most ``radius`` bits from a query: query_print, print, distance; classes, not documents.

    ``prints`` and ``queries`` have a column ``fingerprint``.  Equal fingerprints are one class, so a group of copies
    is one row here however large it is; the permuted tables are joined on block number and block.
    """
    keys = F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"), F.substring("fingerprint", a, n).alias("value")) for i, (a, n) in enumerate(blocks(radius, bits))
    ]))
    table = prints.select("fingerprint").where("fingerprint is not null").distinct().select("fingerprint", keys.alias("k"))
    asked = queries.select("fingerprint").where("fingerprint is not null").distinct().select("fingerprint", keys.alias("k"))
    word = lambda c, i: F.conv(F.substring(c, 1 + 8 * i, 8), 16, 10).cast("long")
    distance = sum(F.bit_count(word("print", i).bitwiseXOR(word("query_print", i))) for i in range(bits // 32))
    return (
        table.select(F.col("fingerprint").alias("print"), "k.block", "k.value")
        .join(asked.select(F.col("fingerprint").alias("query_print"), "k.block", "k.value"), ["block", "value"])
        .withColumn("distance", distance)
        .where(F.col("distance") <= radius)
        .select("query_print", "print", "distance")
        .distinct()
    )


def neighbours(docs: DataFrame, radius: int = 7, every: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document whose id is divisible by ``every``: doc_id, fingerprint, n_prints (different fingerprints in the radius, its own
    among them) and n_docs (documents that have one of them).  The search covers all rows; copies are counted, not listed."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Fingerprinter()
        for batch in batches:
            prints = [printer(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints, pa.string())], ["id", "fingerprint"])

    rows = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fingerprint string"), "prints")
    counts = written(rows.groupBy("fingerprint").agg(F.count("*").alias("n")), "print-counts")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0)
    near = within(counts, asked, radius).join(counts.withColumnRenamed("fingerprint", "print"), "print")
    found = near.groupBy(F.col("query_print").alias("fingerprint")).agg(F.count("*").alias("n_prints"), F.sum("n").alias("n_docs"))
    return asked.join(found, "fingerprint").select(F.col("id").alias("doc_id"), "fingerprint", "n_prints", "n_docs")
