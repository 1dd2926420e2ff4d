"""Line-first cleaning.

Each line is judged on its own by punctuation, navigation and boilerplate rules; failing lines are removed; then
a document is rejected that lost too large a part of its words, or that has too few left.

Navigation is known by its form, in any language: separators between few words, or a short row of capitalised words without a
sentence's end.  Word lists for English, German, French and Spanish add menus in small letters and the usual notices.

Defined cases: a null text has no line and no word and is rejected; an empty one likewise; repeated rows are
judged each, in the same way; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
_DROP_ALL_BUT_SYMBOLS = bytes(x for x in range(256) if x not in SYMBOLS)


@dataclass(frozen=True)
class Rules:
    """Thresholds of the line rules and of the verdict on what is left."""

    symbol_words: float = 0.3  # a line fails if a larger share of its words holds a symbol,
    shouted_words: float = 0.5  # or is in capitals with an exclamation mark,
    repeated_words: float = 0.6  # or repeats the word before
    bare_words: int = 40  # a line of that many words needs a sentence end somewhere
    navigation_bars: int = 3  # separators that make a line a menu
    lost_words: float = 0.5  # a document fails if a larger share of its words went
    least_words: int = 20  # and if fewer words are left


#: Phrases of web page furniture, in lower case (English, German, French, Spanish).
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "click here to", "cookie policy", "enable javascript", "javascript is disabled",
    "lorem ipsum", "privacy policy", "share on facebook", "sign up for our newsletter", "skip to content", "skip to main content",
    "subscribe to our newsletter", "terms of service", "terms of use",
    "alle cookies akzeptieren", "alle rechte vorbehalten", "auf facebook teilen", "datenschutzerklärung", "hier klicken",
    "javascript aktivieren", "newsletter abonnieren", "nutzungsbedingungen", "wir verwenden cookies", "zum inhalt springen",
    "abonnez-vous à notre newsletter", "accepter tous les cookies", "activer javascript", "aller au contenu", "cliquez ici",
    "conditions d'utilisation", "nous utilisons des cookies", "partager sur facebook", "politique de confidentialité", "tous droits réservés",
    "aceptar todas las cookies", "activar javascript", "compartir en facebook", "condiciones de uso", "haga clic aquí", "haz clic aquí",
    "ir al contenido", "política de privacidad", "suscríbete a nuestro boletín", "todos los derechos reservados", "utilizamos cookies",
)
#: Words that make up menus, in lower case (English, German, French, Spanish).
NAVIGATION = frozenset(
    """
    about account archive back blog cart categories contact faq help home login logout menu next news previous register search shop sign sitemap support
    abmelden anmelden archiv hilfe impressum kategorien konto kontakt registrieren startseite suche warenkorb weiter zurück
    accueil aide boutique catégories compte connexion déconnexion inscription panier précédent recherche suivant
    anterior ayuda buscar carrito categorías contacto cuenta inicio registrarse siguiente tienda
    """.split()
)
#: Sides of a menu that is known by its form: words, and the share of them that begin with a capital.
MENU_WORDS, MENU_CAPITALS = range(4, 13), 0.9
_END = re.compile(rb"[.!?:;\"'\)\]]|\xe2\x80\xa6|\xe3\x80\x82")


def line_fault(line: bytes, rules: Rules = Rules()) -> str:
    """The rule that a line fails, or "" if it may stay; blank lines stay."""
    words = line.split()
    if not words:
        return ""
    lower = line.lower().decode("utf-8", "replace")
    if any(phrase in lower for phrase in BOILERPLATE) and len(words) <= 30:
        return "boilerplate"
    bars = sum(w in (b"|", b">", b"\xc2\xbb", b"\xe2\x80\xa2") for w in words)
    if bars >= rules.navigation_bars and bars * 4 >= len(words):
        return "navigation"
    if len(words) >= 3 and sum(w in NAVIGATION for w in lower.split()) * 5 >= len(words) * 4:
        return "navigation"
    if len(words) in MENU_WORDS and not _END.search(line) and not any(x in line for x in b",{}=/"):
        letters = [w for w in line.decode("utf-8", "replace").split() if w[0].isalpha()]
        if len(letters) >= MENU_WORDS.start and sum(w[0].isupper() for w in letters) >= MENU_CAPITALS * len(letters):
            return "navigation"
    n = len(words)
    marked = sum(1 for w in words if w.translate(None, _DROP_ALL_BUT_SYMBOLS))
    if marked > rules.symbol_words * n and n >= 3:
        return "punctuation"
    if b"!" in line and n >= 3:
        shouted = sum(1 for w in words if w.endswith(b"!") and w == w.upper())
        if shouted > rules.shouted_words * n:
            return "punctuation"
    if n >= rules.bare_words and not _END.search(line):
        return "punctuation"
    if n >= 10 and sum(a == b for a, b in zip(words, words[1:])) > rules.repeated_words * n:
        return "repetition"
    return ""


def base_counts(body: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text.

    ``bytes.split`` parts exactly at space and the control characters 9 to 13.  A repeated word is one in a
    window of three words that occurs twice or more.
    """
    words = body.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "surrogatepass"))
    symbols = len(body.translate(None, _DROP_ALL_BUT_SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in body.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        upto = 0  # words before this index are counted
        for i, window in enumerate(windows):
            if counts[window] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return n, chars, symbols, dup, repeated


def judge(text: str | None, rules: Rules = Rules()) -> dict:
    """All columns of one document, its cleaned text among them."""
    body = (text or "").encode("utf-8", "surrogatepass")
    n, chars, symbols, dup, repeated = base_counts(body)
    failed = n < 50 or 100 * repeated > 50 * n
    stay, lost, faults = [], 0, Counter()
    known: dict[bytes, str] = {}
    for line in body.split(b"\n"):
        fault = known.get(line)
        if fault is None:
            fault = known[line] = line_fault(line, rules)
        if fault:
            faults[fault] += 1
            lost += len(line.split())
        else:
            stay.append(line)
    kept = not failed and n - lost >= rules.least_words and lost <= rules.lost_words * n
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeated,
        "base_failed": failed, "kept": kept, "n_lost_words": lost, "n_removed_lines": sum(faults.values()),
        "clean_text": b"\n".join(stay).decode("utf-8", "surrogatepass"),
    }


COLUMNS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "n_lost_words": pa.int64(),
    "n_removed_lines": pa.int64(), "clean_text": pa.string(),
}
_DDL = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lost_words long, n_removed_lines long"
)


def clean(
    docs: DataFrame, rules: Rules = Rules(), texts: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Judge and clean every document; a map over the scan.  ``texts``: also return the cleaned text."""
    names = [x for x in COLUMNS if texts or x != "clean_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(x, rules) for x in batch.column("text").to_pylist()]
            arrays = [pa.array([r[c] for r in rows], COLUMNS[c]) for c in names]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], ["doc_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, {_DDL}" + ", clean_text string" * texts
    )
