"""Operators that compare or count documents, against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioforge.llm import graph, mixing, orderminhash, scratch, suffix

from .fixtures import awkward, docs, edit, near_classes, near_pairs, words


# ---- suffix
def _expected(rows):
    """kept bytes, removed and spans by brute force; rows in the order that counts."""
    seen, out = {}, []
    for key, text in rows:
        body = (text or "").encode()
        gone = np.zeros(len(body), bool)
        for s in range(len(body) - 99):
            w = body[s : s + 100]
            first = seen.setdefault(w, (key, s))
            if first != (key, s):
                gone[s : s + 100] = True
        out.append((len(body), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(body, np.uint8)[~gone])).hexdigest()))
    return out


def _suffix_rows():
    r = random.Random(4)
    passage = " ".join(words(50, 40))
    rows = []
    for i in range(60):
        own = " ".join(words(100 + i, r.randrange(5, 120)))
        if i % 3 == 0:
            own += " " + passage[r.randrange(30) :] + " " + own[: r.randrange(200)]
        rows.append((i, own))
    rows += [(60, "ab" * 300), (61, "ab" * 80 + "c" * 250), (62, ""), (63, None), (64, "é" * 150), (65, rows[3][1]), (66, " ".join(words(2, 20_000)))]
    return rows


@pytest.mark.parametrize("limit", [64, 1])
def test_suffix(spark, monkeypatch, limit):
    """Both ways of refining: within a task and through single strings."""
    monkeypatch.setattr(suffix, "LEAST_LOCAL", limit)
    rows = _suffix_rows()
    got = {r.doc_id: tuple(r)[1:] for r in suffix.digests(docs(spark, rows).repartition(3)).collect()}
    assert [got[i] for i, _ in rows] == _expected(rows)


@pytest.mark.parametrize("block, hot", [(300, 2), (1000, 10**9)])
def test_suffix_windows_and_hot_anchors(spark, monkeypatch, block, hot):
    """Texts that are cut into many windows, and anchors that are dealt by their runs too, give the same result."""
    monkeypatch.setattr(suffix, "HOT", hot)
    rows = _suffix_rows()
    got = {r.doc_id: tuple(r)[1:] for r in suffix.digests(docs(spark, rows).repartition(5), block=block).collect()}
    assert [got[i] for i, _ in rows] == _expected(rows)


def test_refined():
    """Pointers are equal exactly for equal strings."""
    r = random.Random(8)
    for letters, n in (("a", 300), ("ab", 2000), ("abc", 100), ("abcdefgh", 99), ("xy", 0)):
        part = "".join(r.choice(letters) for _ in range(n))
        data = (part + part[: n // 2] + part).encode()
        got = suffix.refined(np.frombuffer(data, np.uint8)).tolist()
        strings = [data[i : i + 100] for i in range(len(data) - 99)]
        assert len(got) == len(strings) and len(set(zip(got, strings))) == len(set(got)) == len(set(strings))


def test_suffix_awkward(spark):
    rows = suffix.digests(docs(spark, awkward()).withColumn("x", F.lit(1))).collect()
    assert len(rows) == len(awkward())
    got = {r.doc_id: r for r in rows}
    assert got[1].n_removed == 0 and got[2].n_removed == got[2].n_bytes and got[6].n_bytes == 0 and got[14].n_removed == 0
    assert suffix.digests(docs(spark, [])).count() == 0


def test_suffix_remove(spark):
    rows = _suffix_rows()
    left = {r.doc_id: r.text for r in suffix.remove(docs(spark, rows)).collect()}
    whole = dict(rows)
    for (i, t), (n, removed, _, digest) in zip(rows, _expected(rows)):
        if removed == 0:
            assert left[i] == t
        elif removed == n:
            assert i not in left
        elif (t or "").isascii():
            assert hashlib.sha256(left[i].encode()).hexdigest() == digest
    assert set(left) <= set(whole) and left[62] == "" and left[63] is None


# ---- near duplicates
def test_banded_distance():
    r = random.Random(0)
    for _ in range(3000):
        a = [r.randrange(3) for _ in range(r.randrange(14))]
        b = [x for x in a if r.random() < 0.8] if r.random() < 0.5 else [r.randrange(3) for _ in range(r.randrange(14))]
        most = r.randrange(1, 8)
        assert orderminhash.banded_distance(a, b, most) == min(edit(a, b), most + 1)


def test_sketches():
    """Agreement follows the similarity to the power of the k-mers taken, and their order counts."""
    hasher, agree, n = orderminhash.Words(), 0, 0
    for seed in range(60):
        w = words(seed, 400)
        a, c = (hasher(" ".join(v)) for v in (w, [*w[:80], "p", *w[81:160], "q", *w[161:240], "r", *w[241:320], "s", *w[321:], "t"]))
        assert orderminhash.sketches(a).tolist() == orderminhash.sketches(a.copy()).tolist() and len(orderminhash.sketches(a)) == orderminhash.SKETCHES
        agree += len(set(orderminhash.sketches(a)) & set(orderminhash.sketches(c)))
        n += orderminhash.SKETCHES
    j = (396 - 20) / (397 + 20)  # about: four exchanged words and one more
    assert abs(agree / n - j**2) < 0.04
    moved = [*words(1, 200)[100:], *words(1, 200)[:100]]
    one, two = (hasher(" ".join(v)) for v in (words(1, 200), moved))
    assert 10 < len(set(orderminhash.sketches(one)) & set(orderminhash.sketches(two))) < 35  # about half of them


def test_labels():
    """A repeated k-mer elsewhere in the text changes no other label."""
    x = np.array([5, 6, 7], np.uint64)
    assert orderminhash.labelled(np.array([5, 6, 7, 6], np.uint64))[:3].tolist() == orderminhash.labelled(x).tolist() == x.tolist()


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: find(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _near_rows():
    """Groups of near copies with more and more changes, a shared passage, short texts."""
    r, rows, i = random.Random(3), [], 0
    for g in range(6):
        base = words(1000 + g, r.choice([6, 12, 30, 150, 400]))
        for c in range(14):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 18)):
                w[r.randrange(len(w))] = f"new{r.randrange(9999)}"
            if r.random() < 0.3:
                del w[r.randrange(len(w))]
            rows.append((i := i + 1, " ".join(w)))
    passage = words(77, 70)
    rows += [(200 + k, " ".join(words(300 + k, 60) + passage + words(400 + k, 60))) for k in range(25)]
    blocks = words(88, 300)
    rows += [(300, " ".join(blocks)), (301, " ".join(blocks[150:] + blocks[:150]))]  # the same shingles in another order
    return rows


@pytest.mark.parametrize("small", [1024, 2])
def test_near_duplicates(spark, monkeypatch, small):
    monkeypatch.setattr(orderminhash, "SMALL_BUCKET", small)
    rows = _near_rows()
    expected = near_classes(rows)
    got = {r.id: r.class_id for r in orderminhash.near_duplicates(docs(spark, rows)).collect()}
    assert [got[i] for i, _ in rows if i >= 29] == [rows[c][0] for c, (i, _) in zip(expected, rows) if i >= 29] and got[300] != got[301]


def _pairs_on_a_core(seed, n, pairs):
    """Texts of n words with a common core: the two of a pair have an edit similarity just above 0.8, all others one just below."""
    own = n // 5 - 1
    core, rows = words(seed, n - own - 3), []
    for i in range(pairs):
        rows += [(2 * i + c, " ".join([*core, *(f"pair{i}-{k}" for k in range(3)), *(f"own{i}-{c}-{k}" for k in range(own))])) for c in range(2)]
    return rows


@pytest.mark.parametrize("n, pairs, small", [(300, 40, 2), (120, 160, 64)])
def test_mixed_buckets(spark, monkeypatch, n, pairs, small):
    """Pairs that stand in mixed buckets of 80 to 320 members, below and above SMALL_BUCKET."""
    monkeypatch.setattr(orderminhash, "SMALL_BUCKET", small)
    rows = _pairs_on_a_core(5, n, pairs)
    got = {r.id: r.class_id for r in orderminhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows}


def test_parities():
    """Bitmaps never differ in more bits than the texts in words, so they leave out no pair."""
    hasher, r = orderminhash.Words(), random.Random(6)
    for n in (1, 4, 5, 30, 400, 5000):
        a = words(n, n)
        b = [w if r.random() > 0.02 else "new" for w in a]
        x, y = (hasher(" ".join(v)) for v in (a, b))
        differ = np.setxor1d(*(orderminhash.labelled(v) for v in (x, y)))
        bits = np.bitwise_xor(orderminhash.parities(x), orderminhash.parities(y)).view(np.uint64)
        assert len(bits) == orderminhash.PARITY_WORDS and sum(int(v).bit_count() for v in bits) <= len(differ)


def test_recall(spark, sf_dir):
    """Of all pairs with an edit similarity of 0.8 or more, found by aligning every pair, nine tenths end in one class; no other texts do."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.id: r.class_id for r in orderminhash.near_duplicates(docs(spark, rows)).collect()}
    pairs = near_pairs([t for _, t in rows])
    found = sum(got[rows[a][0]] == got[rows[b][0]] for a, b, _ in pairs)
    assert pairs and found >= 0.9 * len(pairs)
    whole = near_classes(rows)
    whole_of = {i: whole[n] for n, (i, _) in enumerate(rows)}
    assert all(whole_of[i] == whole_of[c] for i, c in got.items())


def test_near_awkward(spark):
    rows = awkward()
    found = orderminhash.near_duplicates(docs(spark, rows).withColumn("node", F.lit(1))).collect()
    assert len(found) == len(rows)
    got = {r.id: r for r in found if r.id is not None}
    assert got[1].class_id == got[2].class_id == got[3].class_id == 1 and got[4].class_id == 1 and got[11].class_id == 10
    assert got[5].class_id == got[6].class_id == got[15].class_id == 5 and got[7].class_id == 7 and got[8].class_id == got[9].class_id == 8
    assert got[3].n_texts == 3 and sum(r.keep for r in found if r.class_id == 1) == 1
    kept = orderminhash.deduplicate(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [-5, 1, 5, 7, 8, 10, 12, 13, 14] and kept.where("doc_id is null").count() == 2
    assert kept.columns == docs(spark, []).columns and orderminhash.near_duplicates(docs(spark, [])).count() == 0


# ---- mixing
def _targets(sizes, share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            out |= {s: weight[s] * level for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_mix(spark):
    r = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(int(r.lognormvariate(4, 1)))), r.choice(["b", "a", "ä", None, "Z", "c", "d"])) for i in range(3000)]
    got = mixing.mix(docs(spark, rows)).collect()
    again = {x.doc_id: x.taken for x in mixing.mix(docs(spark, rows).repartition(5)).collect()}
    sizes, taken, target = {}, {}, {}
    source = {i: s for i, _, s in rows}
    for x in got:
        assert x.size == len(rows[x.doc_id][1].split()) and 0 <= x.taken <= 2 * x.size and again[x.doc_id] == x.taken
        s = source[x.doc_id]
        sizes[s] = sizes.get(s, 0) + x.size
        taken[s] = taken.get(s, 0) + x.taken
        target[s] = x.target
    expected = _targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(expected[s]) and abs(taken[s] - target[s]) <= max(3, 1e-3 * target[s])


def test_mix_awkward(spark):
    rows = mixing.mix(docs(spark, awkward()).withColumn("size", F.lit("x"))).collect()
    assert len(rows) == len(awkward()) and all(r.taken == 0 for r in rows if r.doc_id in (5, 6, 7))
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [(1, None), (2, "")])).count() == 2
    mixed = mixing.mixed(docs(spark, awkward()))
    assert mixed.columns == docs(spark, []).columns
    copies = {r.doc_id: r["copies"] for r in rows if r.doc_id not in (None, 14)}
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(counts.get(i, 0) == n for i, n in copies.items())


# ---- pipeline
def test_stages(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [frame.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame = scratch_copy(spark, stage(spark, frame, sf_dir))
        sizes.append(frame.count())
        if i < 4:
            assert frame.columns == names, name
        if i == 1:
            texts = [(r.doc_id, r.text) for r in frame.collect()]
            assert len(set(near_classes(texts))) == len(texts)
    assert sizes[0] > sizes[1] > sizes[2] and sizes[3] <= sizes[2] and corpus_pipeline.ORACLE_SQL is None


def test_stages_awkward(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, an empty table and clashing columns through every stage."""
    spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    names = ("c0", "node", "id", "__id", "__k1", "__runs", "s", "copies", "shard")
    frame = docs(spark, awkward()).withColumns({n: F.lit(i) for i, n in enumerate(names)})
    columns = frame.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        if i == 0:
            out = out.limit(0).unionByName(frame)  # so few labels decide nothing that the later stages need
        frame = scratch_copy(spark, out)
        assert i == 4 or (frame.columns == columns and frame.where("c0 <> 0 or shard <> 8").isEmpty()), name
        assert frame.count() > 0, name
        empty = stage(spark, spark.createDataFrame([], docs(spark, []).schema), str(tmp_path))
        assert empty.count() == 0, name


def test_owned_tables(spark):
    """A caller's release leaves the tables of others alone."""
    kept = scratch.written(spark.range(3), "kept")
    with scratch.owned("one"):
        scratch.written(spark.range(4), "gone")
    with scratch.owned("two"):
        other = scratch.written(spark.range(5), "other")
    scratch.release(spark, "one")
    assert kept.count() == 3 and other.count() == 5 and scratch._TABLES["one"] == []


def scratch_copy(spark, frame):
    path = f"{scratch.shared_dir(spark)}/stage-{random.random()}"
    frame.write.parquet(path)
    return spark.read.parquet(path)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and "sequence_id" in out.columns
