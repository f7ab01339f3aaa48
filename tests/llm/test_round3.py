"""Toxicity, centroid clustering and ranked search against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rillmark.llm import centroids, search, toxicity

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- centroids


def plain_clusters(rows, k, rounds, dims, scale):
    kept = [(i, tuple(math.floor(scale * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, tuple(max(-(2**62), min(2**62, x)) for x in v)) for i, v in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i8").tobytes()))
    centres = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        new = list(centres)
        for n in set(own):
            members = [v for (_, v), m in zip(kept, own, strict=True) if m == n]
            new[n] = tuple(sum(column) // len(members) for column in zip(*members, strict=True))
        centres = new
    last = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, n in last:
        inertia[n] += d
    top = lambda x: min(x, 2**63 - 1)
    return sorted(((i, n, top(d), top(inertia[n]), top(sum(inertia.values())), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, d, n in last), key=str)


def clustered(df, **more):
    return sorted((tuple(r) for r in centroids.cluster_vectors(df, **more).collect()), key=str)


VECTORS = "vec_id long, embedding array<double>, label int, digest binary, cluster int, id string"


@pytest.mark.parametrize("large", [False, True])
def test_clusters_equal_plain_rounds(spark, large):
    r = random.Random(4)
    vector = lambda: [r.gauss(0, 1) for _ in range(6)]
    rows = [(i, vector()) for i in range(150)] + [(1000 + i, [0.5] * 6) for i in range(90)]  # a hot vector
    rows += [(3, vector()), (3, vector()), (None, vector()), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [1.0] * 5 + [None]), (2004, [1.0] * 5 + [math.nan]), (2005, [1.0] * 5 + [math.inf]), (2006, [-0.0] * 6), (2007, [1.0] * 7)]
    if large:
        rows += [(3000 + i, [x * 1e6 for x in vector()]) for i in range(5)] + [(4000, [1e30] * 6), (4001, [-1e30] * 6)]
    df = spark.createDataFrame([(*row, None, b"x", 1, "y") for row in rows], VECTORS).repartition(5)
    want = plain_clusters(rows, 8, 3, 6, 256)
    assert clustered(df, k=8, rounds=3, dims=6) == want
    assert len({w[1] for w in want}) > 3


def test_few_vectors_and_none(spark):
    rows = [(i, [float(i)] * 4) for i in range(3)]
    df = spark.createDataFrame([(*row, None, None, None, None) for row in rows], VECTORS)
    assert clustered(df, dims=4) == plain_clusters(rows, 40, 5, 4, 256)
    assert clustered(df.limit(0), dims=4) == [] and clustered(df, dims=5) == []
    assert centroids.cluster_vectors(df.limit(0)).dtypes == centroids.cluster_vectors(df, dims=4).dtypes


def test_equal_vectors_are_one_row_of_the_rounds(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0] if i % 3 else [float(i), 0.0], None, None, None, None) for i in range(90)], VECTORS)
    seen = []
    whole = centroids.lloyd
    try:
        centroids.lloyd = lambda distinct, *more: (seen.append(distinct.count()), whole(distinct, *more))[1]
        assert centroids.cluster_vectors(df, dims=2, k=3).count() == 90
    finally:
        centroids.lloyd = whole
    assert seen == [31]


# ---- search


def plain_search(docs, items, k):
    bags = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, whole = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for (doc, bag), size in zip(bags, sizes, strict=True):
            m = 10 + 90 * size * n // whole if size else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in set(TERM.findall((text or "").translate(UPPER))) if t in bag)
            if score > 0:
                scores.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def odd_texts(spark, docs):
    r = random.Random(9)
    words = ["alpha", "Beta", "GAMMA", "été", "x1", "Ä", "tie"]
    rows = [(x["doc_id"], x["text"]) for x in docs.collect()]
    rows += [(500 + i, " ".join(r.choices(words, k=r.randint(1, 12)))) for i in range(120)] + [(700 + i, "tie-break, tie") for i in range(40)]
    return rows + [(None, "tie-break, tie"), (900, "tie " * 5000), (901, "!!! ---"), (902, "日本語 text alpha")]


def test_search_equals_brute_force(spark, docs, monkeypatch):
    rows = odd_texts(spark, docs)
    items = [(1, "alpha beta BETA"), (2, "tie"), (3, None), (4, ""), (5, "nowhere"), (2, "été ä x1"), (None, "gamma 日本語"), (6, rows[3][1]), (7, rows[60][1]), (8, "tie break alpha ?")]
    df = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], "doc_id long, text string, rank int, doc string, term int, score long").repartition(4)
    asked = spark.createDataFrame([(i, t, 1, "y") for i, t in items], "item_id long, text string, row int, doc_id string").repartition(2)
    want = plain_search(rows, items, 10)
    got = search.search(search.build_index(df), asked)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    # in small blocks, chunks and runs of postings, the same
    for name, value in (("BLOCK_DOCS", 7), ("CHUNK_TERMS", 3), ("POSTINGS", 50), ("PART", 64)):
        monkeypatch.setattr(search, name, value)
    got = search.search(search.build_index(df), asked, k=10)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_search_of_nothing(spark, docs, nothing):
    asked = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    for found in (search.search(search.build_index(nothing), asked), search.search(search.build_index(docs), asked.limit(0)), search.search(search.build_index(docs.where("doc_id = 101")), asked)):
        assert found.count() == 0 and found.dtypes == [("id", "bigint"), ("rank", "int"), ("doc", "bigint"), ("score", "bigint")]


def test_bounds_hold_and_prune(spark, docs):
    """Byte impacts bound each score from both sides, so few documents need an exact one."""
    rows = odd_texts(spark, docs)
    index = search.build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    for block in index.blocks.collect():
        slots, impacts, tf = np.frombuffer(block["slots"], "<i4"), np.frombuffer(block["impacts"], np.uint8).astype(int), np.frombuffer(block["counts"], "<i8")
        m = np.array(search.lengths(block["sizes"], index.docs, index.terms))
        exact = 10**9 * tf // (1000 * tf + 8 * m[slots])
        assert (impacts * search.STEP >= exact).all() and ((impacts - 1) * search.STEP < exact).all() and impacts.max() < 256
        assert block["ends"][-1] == len(slots) and list(block["terms"]) == sorted(block["terms"])


# ---- toxicity


def plain_clause(symbols, weights):
    """By rules, without automata: denied after a negation, else reported, else aimed near a target; a target after a hit may
    serve if it comes soon enough, and then all hits up to it are aimed."""
    best = 0.0
    kinds = []
    for k, s in enumerate(symbols):
        if s in "it":
            denied = "n" in symbols[max(0, k - toxicity.SCOPE) : k]
            told = "r" in symbols[:k]
            kinds.append("q" if told else "d" if denied else s)
        else:
            kinds.append("y" if s == "y" else "o")
    for k, (s, w) in enumerate(zip(kinds, weights, strict=True)):
        if s in "it":
            near = "y" in kinds[max(0, k - toxicity.NEAR) : k] or "y" in kinds[k + 1 : k + 1 + toxicity.NEAR]
            best += w * toxicity.FACTORS["a" if near else s]
        elif s in "dq":
            best += w * toxicity.FACTORS[s]
    return best


def test_composed_transducers_equal_the_rules():
    for n in range(1, 7):
        for symbols in itertools.product("oiynr", repeat=n):
            line = "".join(symbols)
            score, out = toxicity.clause_score(line, [2.0 if s == "i" else 0.0 for s in line])
            assert len(out) == n
            assert score == pytest.approx(plain_clause(line, [2.0 if s == "i" else 0.0 for s in line])), line


def test_clauses_not_words_are_scored():
    words = toxicity.Words({"idiot$": 4.0})
    total = lambda text: words.features(text)[0]
    assert total("you are an idiot") > total("an idiot") > total("he said an idiot came") > total("that is not an idiot") > total("nothing here") == 0
    assert total("not so. an idiot") == total("an idiot")  # a negation ends with its clause
    assert total("he will kill you") > total("kill time")
    assert words.features("")[0] == 0 and len(words.features("")) == len(toxicity.FEATURES)
    # a part of a clause far from hits changes nothing but the number of words
    far = " ".join(["word"] * 500)
    assert total(f"{far} you are an idiot {far}") == total("you are an idiot")


def test_long_texts_in_parts_score_alike(monkeypatch):
    words, text = toxicity.Words({"idiot": 4.0}), ("what an idiotic day. " * 200 + "plain words here\n") * 3
    whole = words.features(text)
    monkeypatch.setattr(toxicity, "PART", 997)
    assert words.features(text)[5] == whole[5] == 600
    assert "".join(toxicity._parts(text)) == text and "".join(toxicity._parts("x" * 5000)) == "x" * 5000


def toxic_corpus(n, seed=1):
    """Documents of made-up words; toxic ones hold words that begin with zorg-, a stem that labels must teach."""
    r = random.Random(seed)
    syllables = ["ba", "ko", "ti", "re", "su", "ma", "ne", "lo"]
    word = lambda: "".join(r.choices(syllables, k=r.randint(2, 4)))
    rows, labels = [], []
    for i in range(n):
        toxic, own = r.random() < 0.25, [word() for _ in range(r.randint(20, 120))]
        if toxic:
            for _ in range(max(2, len(own) // 25)):
                own[r.randrange(len(own))] = "zorg" + r.choice(syllables)
        elif r.random() < 0.1:
            own[r.randrange(len(own))] = "zorg" + r.choice(syllables)
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    return rows, labels


def scored(spark, rows, labels, held=lambda c: c % 3 == 1):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], "doc_id long, text string, label string, fold int, sketch long").repartition(3)
    told = spark.createDataFrame([(*x, 0, "q") for x in labels], "doc_id long, toxic int, quality int, id string")
    learn = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")), F.lit(0)) % 3 != 1
    return [tuple(r) for r in toxicity.score_toxicity(df, told, learn).collect()]


def test_toxicity_learns_stems_for_held_out_rows(spark):
    rows, labels = toxic_corpus(600)
    got = scored(spark, [*rows, *rows[:5], (None, "zorgba"), (9000, None), (9001, ""), (9002, "zorgti " * 9 + "." + "ko " * 300_000)], [*labels, (0, None), (1, 7), (None, 1), (77777, 1)])
    assert len(got) == 609 and all(0 <= s <= 1 for _, _, s in got)
    held = [(s, labels[i][1]) for i, mark, s in got if i is not None and i < 600 and not mark]
    assert all((zlib.crc32(str(i).encode()) % 3 != 1) == mark for i, mark, _ in got if i is not None)
    toxic, clean = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([s >= toxicity.THRESHOLD for s in toxic]) > 0.9 and np.mean([s >= toxicity.THRESHOLD for s in clean]) < 0.05
    by = {}
    for i, _, s in got:
        by.setdefault(i, set()).add(s)
    assert all(len(s) == 1 for s in by.values())  # repeated rows score alike
    assert by[9000] == by[9001] and max(by[9000]) < 0.3


def test_labels_of_held_out_rows_are_never_read(spark):
    rows, labels = toxic_corpus(250, seed=3)
    other = [(i, 1 - y) if zlib.crc32(str(i).encode()) % 3 == 1 else (i, y) for i, y in labels]
    assert sorted(scored(spark, rows, labels), key=str) == sorted(scored(spark, rows, other), key=str)


def test_toxicity_without_labels_or_rows(spark):
    rows = [(1, "you are an idiot, you moron"), (2, "a calm day by the sea"), (3, None)]
    got = {i: s for i, _, s in scored(spark, rows, [])}
    assert got[1] > 0.7 > 0.3 > got[2] == got[3]
    assert scored(spark, [], []) == [] and len(scored(spark, rows, [(1, 1), (2, 1)])) == 3
