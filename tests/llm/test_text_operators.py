"""Operators that judge each document on its own."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.llm import labelled, licences, linerules, packing, quality, queries, sharding, simhash, toxicity

from .fixtures import awkward, docs, words

texts = st.text(alphabet="ab \n\t|!.é", max_size=60)


# ---- line rules
@given(texts)
@settings(max_examples=300, deadline=None)
def test_base_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(w, w[1:], w[2:]))
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))
    assert linerules.base_counts(text.encode()) == expected


def test_line_rules():
    fault = linerules.line_fault
    assert fault(b"A plain sentence, with an end.") == "" and fault(b"  ") == ""
    assert fault(b"Home | About | Contact | Help | Login") == "navigation" and fault(b"Please accept all cookies now") == "boilerplate"
    assert fault(b"one*** two### three$$$ four") == "punctuation" and fault(b"BUY!! NOW!! HERE!!") == "punctuation"
    assert fault(b"x " * 20) == "repetition"
    good = " ".join(words(5, 80)) + "."
    row = linerules.judge(good + "\nHome | About | Contact | Help")
    assert row["kept"] and row["clean_text"] == good and row["n_removed_lines"] == 1
    assert not linerules.judge("one*** two### three$$$ four%%%\n" * 40)["kept"]
    for line in ("Alle Rechte vorbehalten", "Wir verwenden Cookies. Alle akzeptieren", "Tous droits réservés 2020", "Todos los derechos reservados"):
        assert fault(line.encode()) == "boilerplate", line
    for line in ("Accueil Contact Panier Connexion Recherche", "Inicio Contacto Carrito Buscar Ayuda", "startseite kontakt impressum", "Koti Yhteystiedot Ostoskori Haku"):
        assert fault(line.encode()) == "navigation", line
    for line in ("for (i = 0; i < n; i++) { total += i; }", "Der Hund und die Katze schlafen im Haus", "Ein Satz, der ein Komma hat", "Anna Bert"):
        assert fault(line.encode()) == "", line


def test_clean_awkward(spark):
    rows = linerules.clean(docs(spark, awkward())).collect()
    assert len(rows) == len(awkward())
    assert all(not r.kept and r.base_failed and r.n_words == 0 for r in rows if r.doc_id in (5, 6, 7))
    assert linerules.clean(docs(spark, [])).count() == 0


# ---- packing
def test_tokenizer_is_the_same():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = packing.default_encoder()
    for t in ["", " ", "a<|endoftext|>b", "x y\n\n z", "été \U0001f600", "a" * 300, *(t for _, t, _ in awkward() if t)]:
        assert fast(t[:20_000]) == slow.encode(t[:20_000], add_special_tokens=False).ids


@given(st.integers(1, 5000), st.integers(1, 600))
@settings(max_examples=200, deadline=None)
def test_cut(length, capacity):
    parts = packing.cut(length, capacity)
    assert [a for a, _ in parts] == list(np.cumsum([0, *(n for _, n in parts)])[:-1]) and sum(n for _, n in parts) == length
    assert all(n == capacity for _, n in parts[1:]) and 0 < parts[0][1] <= capacity and len(parts) == -(-length // capacity)


@given(st.lists(st.integers(1, 50), max_size=80))
@settings(max_examples=200, deadline=None)
def test_sum_of_squares(lengths):
    lengths.sort(reverse=True)
    bins, offsets = packing.sum_of_squares(lengths, 50)
    # A plain version: try every placement.
    gaps, plain = [], []
    for n in lengths:
        def cost(change):
            g = list(gaps)
            if change < 0:
                g.append(50 - n)
            else:
                g[change] -= n
            counts = {}
            for x in g:
                counts[x] = counts.get(x, 0) + (0 < x < 50)
            return sum(v * v for v in counts.values())

        options = [i for i, g in enumerate(gaps) if g >= n]
        best = min([*(cost(i) for i in options), cost(-1)])
        plain.append(best)
        b = bins[len(plain) - 1]
        assert cost(b if b < len(gaps) else -1) == best
        if b == len(gaps):
            gaps.append(50)
        assert offsets[len(plain) - 1] == 50 - gaps[b]
        gaps[b] -= n
        assert gaps[b] >= 0


def test_pack(spark):
    rows = packing.pack(docs(spark, awkward())).collect()
    encode = packing.default_encoder()
    by_row, bins = {}, {}
    for r in rows:
        by_row.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *(n for _, n in parts)])[:-1]) and sum(n for _, n in parts) <= 1024
    for i, t, _ in awkward():
        if i in (10, 5, 6, 12):
            ids = np.array([*encode(t or ""), 2], "<u4")
            own = sorted(by_row[i], key=lambda r: r.piece)
            assert b"".join(ids[r.start : r.start + r.length].tobytes() for r in own) == ids.tobytes()
            assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    assert packing.pack(docs(spark, [])).count() == 0


# ---- sharding
def _jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(0).integers(0, 2**63, 2000).astype(np.uint64)
    for n in (1, 2, 8, 9, 100):
        assert sharding.jump_hash(keys, n).tolist() == [_jump(int(k), n) for k in keys]
    moved = sharding.jump_hash(keys, 8) != sharding.jump_hash(keys, 9)
    assert (sharding.jump_hash(keys, 9)[moved] == 8).all() and 0.07 < moved.mean() < 0.15


def test_shard(spark):
    rows = sharding.shard(docs(spark, awkward()), 8).collect()
    for s in range(8):
        own = sorted(r.slot for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    assert all(r.size == 1 and r.text_crc32 == 0 for r in rows if r.id in (5, 6))
    assert all(r.grown_shard in (r["shard"], 8) for r in rows) and sharding.shard(docs(spark, []), 8).count() == 0


# ---- simhash
def test_fingerprints(spark):
    data = sorted(((i, t) for i, t, _ in awkward()), key=lambda r: -(r[0] if r[0] is not None else -(1 << 70)))
    rows = simhash.fingerprints(docs(spark, awkward()).withColumnRenamed("n_chars", "fingerprint")).collect()
    assert len(rows) == len(data)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    once = [i for i, _ in data if i not in (None, 14)]
    for k, (i, t) in enumerate(data):
        following = data[(k + 1) % len(data)]
        if i in once and following[0] in once:
            r, third = got[i][0], len(t or "") // 3
            changed = (t or "")[: len(t or "") - third] + (following[1] or "")[:third]
            assert (r.n_chars, r.edited_sha256) == (len(t or ""), hashlib.sha256(changed.encode()).hexdigest())
            p = simhash.Fingerprinter()
            assert r.fingerprint == p(t or "") and r.edited_fingerprint == p(changed) and r.near_next == simhash.likeness(p(t or ""), p(following[1] or ""))
    assert got[1][0].fingerprint == got[2][0].fingerprint and got[10][0].near_edited > got[10][0].near_next
    assert simhash.fingerprints(docs(spark, [])).count() == 0
    single = simhash.fingerprints(docs(spark, [(1, "abcdef")])).first()
    assert single.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_within(spark):
    rng = np.random.default_rng(0)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(20)]
    every = base + [b ^ sum(1 << int(i) for i in rng.choice(128, k, replace=False)) for b in base for k in (1, 3, 4)]
    frame = spark.createDataFrame([(f"{v:032x}",) for v in every], "fingerprint string")
    got = {(r.query_print, r.print, r.distance) for r in simhash.within(frame, frame, 3).collect()}
    expected = {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in every for b in every if (a ^ b).bit_count() <= 3}
    assert got == expected


def test_neighbours(spark):
    rows = [(i * 50, " ".join(words(i % 7, 300)[: 300 - i % 3])) for i in range(40)] + [(7000, None), (7001, "")]
    got = {r.doc_id: (r.fingerprint, r.n_prints, r.n_docs) for r in simhash.neighbours(docs(spark, rows)).collect()}
    p = simhash.Fingerprinter()
    prints = {i: p(t or "") for i, t in rows}
    for i in (i for i in prints if i % 100 == 0):
        near = [x for x in prints.values() if (int(x, 16) ^ int(prints[i], 16)).bit_count() <= 7]
        assert got[i] == (prints[i], len(set(near)), len(near))
    assert len(got) == 21


def test_votes():
    """Against a plain vote, term by term and bit by bit."""
    import xxhash

    text = "a b a c b a"
    w = text.encode().split()
    hashes = {x: xxhash.xxh3_128_intdigest(x).to_bytes(16, "little") for x in w}
    terms = {x: (h, math.log2(1 + w.count(x))) for x, h in hashes.items()}
    mask = (1 << 64) - 1
    for x, y in set(zip(w, w[1:])):
        h = b""
        for k in (0, 8):
            a, b = (int.from_bytes(hashes[z][k : k + 8], "little") for z in (x, y))
            v = (a * 0x9E3779B97F4A7C15 + b) * 0xD6E8FEB86659FD93 & mask
            v = (v ^ v >> 32) * 0xD6E8FEB86659FD93 & mask
            h += (v ^ v >> 29).to_bytes(8, "little")
        terms[x, y] = (h, 3.0 * math.log2(1 + list(zip(w, w[1:])).count((x, y))))
    bits = ""
    for i in range(128):
        total = sum(weight * (1 if h[i // 8] >> (7 - i % 8) & 1 else -1) for h, weight in terms.values())
        bits += "1" if total > 0 else "0"
    assert simhash.Fingerprinter()(text) == f"{int(bits, 2):032x}"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_parts_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got, expected = queries.queries()[name](spark, sf_dir).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got[columns].values.tolist()), key=str) == sorted(map(tuple, expected[columns].values.tolist()), key=str)


def test_clashing_columns(spark):
    """Further columns, under names that the operators use themselves, change nothing."""
    rows = [*awkward(), (50, "Released under the MIT License. " + " ".join(words(4, 80)))]
    plain = docs(spark, rows)
    names = ("id", "text_crc32", "size", "key", "block", "piece", "length", "shard", "score", "fingerprint", "order", "held_out", "kept", "y", "c1", "__id")
    more = plain.withColumns({n: F.lit("x") for n in names})
    empty = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    runs = {
        "pack": lambda d: packing.pack(d).select("doc_id", "piece", "ids_crc32"), "clean": linerules.clean, "shard": lambda d: sharding.shard(d, 8), "licences": licences.scan,
        "quality": lambda d: quality.classify(d, empty), "toxicity": lambda d: toxicity.classify(d, empty), "neighbours": simhash.neighbours,
    }
    for name, f in runs.items():
        one, two = (sorted(map(str, f(d).collect())) for d in (plain, more))
        assert one == two, name


# ---- labels
@pytest.fixture(scope="module")
def big():
    return "/root/testdata/sf0.01"


def _held_out(spark, big, query, label):
    got = query(spark, big).where("held_out").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").toPandas()
    assert got.score.between(0, 1).all()
    return (got.predicted == got[label]).mean(), got


def test_quality(spark, big):
    accuracy, _ = _held_out(spark, big, queries.op6_quality, "quality")
    assert accuracy > 0.97


def test_toxicity(spark, big):
    accuracy, got = _held_out(spark, big, queries.op5_toxicity, "toxic")
    assert accuracy > 0.97 and got[got.toxic == 0].predicted.mean() < 0.02


def test_dual_coordinate_descent():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 4)), rng.choice([-1.0, 1.0], 60)
    x += y[:, None] * 0.7
    w = quality.dual_coordinate_descent(x, y, np.full(60, 0.3), rounds=400)
    loss = lambda w: 0.5 * w @ w + 0.3 * np.maximum(0, 1 - y * (x @ w)).sum()
    assert all(loss(w) <= loss(w + d) + 1e-6 for d in rng.normal(scale=1e-2, size=(300, 4)))


def test_fold_and_match():
    assert toxicity.fold("1d10t, IDIОT  stupíd w0rthle$$") == " idiot idiot stupid worthless "
    assert toxicity.fold("price 100$ in 2024!!!").split() == ["price", "in"]
    m = toxicity.Matcher(toxicity.Lexicon())
    assert m.measure("a trash can and trash")[0] == toxicity.DEFAULT_WEIGHT and m.measure("class clown")[0] == 0 and m.measure("trashy clowns")[0] == 0
    assert m.measure("idiot idiot")[0] == 2 * toxicity.DEFAULT_WEIGHT and m.measure(None) == (0.0, 0, 0)


def test_stems():
    """Stems are matched like terms: disguised as well as plain, and not inside exception phrases."""
    m = toxicity.Matcher(toxicity.Lexicon({"greb": 1.0}, {"gre": 1.5, "idio": 2.0}, ("grebo park",)))
    assert m.measure("Gréba, xgréba gré grébo") == (4.5, 4, 3) and m.measure("greb") == (1.0, 1, 1) and m.measure("grebo park") == (0.0, 2, 0)
    assert m.measure("idiotic idiotov") == m.measure("1d10tic idі0tov") == (4.0, 2, 2)
    assert toxicity.stems("abcde") == {"abc": {"abcde"}, "abcd": {"abcde"}}


def test_order_of_arrival(spark, big):
    """Permuted input gives bit-equal models."""
    d, l = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    one, two = (quality.model(x, l, "quality", labelled.fold("id", 4) != 2) for x in (d, d.repartition(7).orderBy(d.text)))
    assert (one[0] == two[0]).all() and one[1:] == two[1:]
    one, two = (toxicity.learn(x, l, "toxic", labelled.fold("id", 5) != 0) for x in (d, d.repartition(7).orderBy(d.text)))
    assert one == two


def test_scores_without_labels(spark):
    d = docs(spark, [*awkward(), (99, "you idiot scum trash moron")])
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    tox = {r.doc_id: r for r in toxicity.classify(d, empty).collect()}
    assert tox[99].predicted == 1 and tox[5].predicted == 0 and tox[6].score == tox[5].score
    assert {round(r.score, 6) for r in quality.classify(d, empty).collect()} == {0.5}
    assert toxicity.classify(docs(spark, []), empty).count() == 0 and quality.classify(docs(spark, []), empty).count() == 0


def test_fold_numbers(spark):
    rows = spark.range(200).select("id", labelled.fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


# ---- licences
def test_licences(spark):
    notices = {
        1: ("text before\nLicensed under the Apache License, Version 2.0.\nafter", "apache"), 2: ("Released under the MIT License.", "mit"),
        3: ("This work is licensed under the GNU General Public License, version 3.", "gpl"), 4: ("Licensed under CC BY-NC 4.0.", "cc"),
        5: ("He had a license to drive and a permission to stay.", None), 6: (None, None), 7: ("", None),
        8: (" ".join(words(9, 400)) + " Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files " + " ".join(words(8, 300)), "mit"),
        9: (" ".join(words(7, 200)), None),
    }
    got = {r.doc_id: r.licence for r in licences.scan(docs(spark, [(i, t) for i, (t, _) in notices.items()])).collect()}
    assert got == {i: f for i, (_, f) in notices.items()}
    assert licences.scan(docs(spark, [])).count() == 0


def test_licence_filter_is_complete(spark):
    """Notices without a usual cue word are found; what the filter drops, no template confirms."""
    notices = [("Released under the MIT Licence.", "mit"), ("Released under the BSD 3-Clause Licence.", "bsd"), ("This project is released under the Apache 2.0 licence.", "apache"), ("Released under the MIT.", "mit")]
    got = {r.doc_id: r.licence for r in licences.scan(docs(spark, [(i, t) for i, (t, _) in enumerate(notices)])).collect()}
    assert got == {i: f for i, (_, f) in enumerate(notices)}
    r = random.Random(8)
    pool = [w for ts in licences.TEMPLATES.values() for t in ts for w in licences.tokens(t)]
    for _ in range(2000):
        k = r.randrange(len(pool) - 9)
        words = pool[k : k + r.randrange(9)] + r.choices(pool, k=r.randrange(9))
        if not licences.candidates(words):
            assert all(licences.confirmed(words, f) < licences.CONFIRM for f in licences.TEMPLATES)
