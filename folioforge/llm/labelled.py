"""A bounded sample of labelled documents for fitting, and the folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows used for fitting at most; those with the least hash of their id, so any input gives a fair sample.
FIT_ROWS = 4000


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)).cast("int")


#: Range of the hash that orders rows.
RANGE = 1 << 30


def fair(rows: DataFrame, total: int, most: int, *key: str) -> DataFrame:
    """The ``most`` rows with the least hash of ``key``, or somewhat fewer, of about ``total`` rows.

    Rows whose hash is so large that they have no chance are dropped by a filter first, so what the top-k gathers does not
    grow with the input.
    """
    h = F.pmod(F.xxhash64(*key), F.lit(RANGE))
    bound = int(min(1.0, 2 * (most + 50) / max(total, 1)) * RANGE)
    return rows.where(h < bound).orderBy(h, *key).limit(most)


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts and labels (text, y) of at most ``rows`` labelled training documents, picked by hash.

    The picked ids number ``rows`` at most, so they are broadcast to the documents whatever the input's size.
    """
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isNotNull())
        .where(train)
    )
    picked = fair(known, known.count(), rows, "id", "y")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), "id").select("text", "y")
