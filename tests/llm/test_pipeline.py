"""The pipeline against its stages done by hand, on the smallest tables and on odd ones."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from tessera.llm import nearcopies, secrets

STAGE = dict(corpus_pipeline.STAGES)


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_groups(texts, least):
    """Group number of each text: components of exact resemblance of at least ``least``."""
    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and (bool(sets[i]) == bool(sets[j])) and jaccard(sets[i], sets[j]) >= least:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(STAGE) == 5
    good = STAGE["quality rules"](spark, docs, sf).cache()
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    one = STAGE["simhash near-dedup"](spark, good, sf).cache()
    assert one.columns == docs.columns
    texts = [r.text for r in good.orderBy("doc_id").collect()]
    # between the groups of a lower and a higher resemblance than asked for
    assert len(set(brute_groups(texts, 0.7))) <= one.count() <= len(set(brute_groups(texts, 0.87)))
    clean = STAGE["secret scans"](spark, one, sf).cache()
    assert clean.columns == docs.columns and clean.count() == one.count()
    assert secrets.scan(clean).where("n_assign + n_access + n_hex > 0").count() == 0
    mixed = STAGE["source mixing"](spark, clean, sf).cache()
    assert mixed.columns == docs.columns
    last = STAGE["byte-level bpe"](spark, mixed, sf)
    assert last.count() == mixed.count() == corpus_pipeline.run(spark, sf).count()


ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, copies string, node string, slot string"


def odd_rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    text = " ".join(rng.choice(words) for _ in range(300))
    texts = [None, "", " \n\t", "one two", text, text, text.upper(), text + " more words here", "x" * 200_000, " ".join(rng.choice(words) for _ in range(60_000)), "password=hunter22 " + text[:400]]
    rows = [(None if i == 3 else i, t, "en", [None, "a", "b"][i % 3], len(t or ""), "r", "c", "n", "s") for i, t in enumerate(texts)]
    return rows + [rows[4], rows[0]]


@pytest.mark.parametrize("name", list(STAGE))
def test_stages_on_odd_rows(spark, sf, name):
    """Nulls in any column, empty and very long texts, repeated rows, empty tables, clashing names."""
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    got = STAGE[name](spark, docs, sf)
    rows = got.collect()
    if name == "byte-level bpe":
        assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd_rows())
    else:
        assert got.columns == docs.columns and all((r.row, r.copies, r.node, r.slot) == ("r", "c", "n", "s") for r in rows)
    if name == "quality rules":
        assert {r.text for r in rows} <= {r[1] for r in odd_rows() if r[1] and len(r[1].split()) >= 50}
    if name == "simhash near-dedup":  # texts without words; the five alike; the four others
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, i) for i in (0, 4, 8, 9, 10)] + [(True, 0)]
    if name == "secret scans":
        assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd_rows()) and sum(secrets.MARK in (r.text or "") for r in rows) == 1
    if name == "source mixing":
        assert all(n <= 2 * sum(r[0] == i for r in odd_rows()) for i, n in Counter(r.doc_id for r in rows).items())
    assert STAGE[name](spark, docs.limit(0), sf).count() == 0


def test_near_copies_against_brute_force(spark):
    """Edits of some base texts: what is 0.85 alike is joined, what is under 0.72 alike to all others is not."""
    rng = random.Random(31)
    words = [f"word{i}" for i in range(3000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice((60, 200, 700)))]
        texts.append(" ".join(base))
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randint(0, len(copy) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {r.doc_id: r.root for r in nearcopies.near_components(frame).collect()}
    sets, pairs, missed = [shingles(t) for t in texts], 0, 0
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.85:
                pairs, missed = pairs + 1, missed + (root[i] != root[j])
        if max(jaccard(sets[i], s) for j, s in enumerate(sets) if j != i) < 0.72:
            assert sum(r == root[i] for r in root.values()) == 1
    assert pairs > 50 and missed <= 0.02 * pairs


def test_complete_fingerprints_estimate_resemblance():
    rng = random.Random(8)
    for share in (1.0, 0.95, 0.9, 0.8):
        a = [f"w{rng.randrange(5000)}" for _ in range(2000)]
        b = a[: int(share * 2000)] + [f"v{rng.randrange(5000)}" for _ in range(2000 - int(share * 2000))]
        (_, p, m), (_, q, n) = (nearcopies.prints_of(" ".join(t).encode()) for t in (a, b))
        apart = sum(bin((int(x) ^ int(y)) & (2**64 - 1)).count("1") for x, y in zip(p, q, strict=True))
        import math

        shared = math.cos(apart * math.pi / nearcopies.BITS) * math.sqrt(m * n)
        assert abs(shared / (m + n - shared) - jaccard(shingles(" ".join(a)), shingles(" ".join(b)))) < 0.06
