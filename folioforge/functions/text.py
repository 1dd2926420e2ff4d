"""Text expressions: folding, markers, ratios.  All but the exact fold stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

URL_HINTS = ("http://", "https://", ".com", ".net", ".org", "www.")


def fold_text(text: str | None, casefold: bool = True) -> str:
    """Compatibility decomposition without combining marks, case folded, alphanumerics only."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    return "".join(c for c in (bare.casefold() if casefold else bare.lower()) if c.isalnum())


@F.pandas_udf(StringType())
def fold(texts: pd.Series) -> pd.Series:
    """Exact fold of a column, in Arrow batches."""
    return texts.map(fold_text)


def exact_fold(text: Column) -> Column:
    """Exact fold; only texts with more than ASCII go to Python."""
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, fold_simple(text)).otherwise(fold(F.when(~plain, text)))


def fold_simple(text: Column) -> Column:
    """Fold of text without letters that decompose: lower case, letters and digits only.  Runs in the JVM."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def parse_markers(text: str) -> list[str]:
    """Marker lines: trimmed, without blank lines and comments."""
    return [x for x in map(str.strip, text.splitlines()) if x and not x.startswith("#")]


def has_marker(text: Column, marker: str) -> Column:
    """The marker's ASCII projection occurs: exactly, in any case, or hexadecimal."""
    plain = marker.encode("ascii", "ignore").decode()
    if not plain:
        return F.lit(False)
    low = F.lower(text)
    return text.contains(plain) | low.contains(plain.lower()) | low.contains(plain.encode().hex())


def matched(text: Column, markers: list[str]) -> Column:
    """Markers that occur, in their order."""
    each = [F.when(has_marker(text, m), F.lit(m)) for m in markers]
    return F.array_compact(F.array(*each)) if each else F.array().cast("array<string>")


def upper_ratio(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(text, F.lit(r"\p{Lu}")) / letters).otherwise(F.lit(0.0))


def any_of(text: Column, literals: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for x in literals:
        out = out | text.contains(x)
    return out


def safe_file_name(name: Column, suffix: str = ".pdf") -> Column:
    """Letters, digits, space and ``._-`` stay, others become ``_``; the suffix is enforced."""
    clean = F.regexp_replace(F.trim(name), r"[^0-9A-Za-zÀ-ɏḀ-ỿ ._-]+", "_")
    return F.when(F.lower(clean).endswith(suffix), clean).otherwise(F.concat(clean, F.lit(suffix)))


def edge_height(value: Column, height: Column) -> Column:
    """Whole pixels of an edge given as ``8%``, a ratio below one, or pixels; invalid values are 0, large ones the height."""
    text = F.trim(value)
    number = F.trim(F.regexp_replace(text, "%$", "")).try_cast("double")
    pixels = F.when(text.endswith("%"), height * number / 100).when((number > 0) & (number < 1), height * number).otherwise(number)
    whole = F.greatest(F.lit(0.0), F.least(height.cast("double"), F.signum(pixels) * F.floor(F.abs(pixels))))
    return F.when(pixels.isNull() | F.isnan(pixels), 0).otherwise(whole.cast("int"))


def latin1(text: Column) -> Column:
    """The bytes of a text read one by one as Latin-1 letters."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def markers_of(text: Column) -> Column:
    """Marker lines of a settings text: trimmed, without blank lines and comments."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))


def occurrences(text: Column, alias: str) -> Column:
    """Places (from 1) at which a text holds the alias, overlapping ones too."""
    n = len(alias)
    places = F.filter(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)) == alias)
    return F.when(text.contains(alias), places).otherwise(F.array().cast("array<int>"))
