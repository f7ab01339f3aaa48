"""Corpus operators against plain versions, on odd rows: see the docs fixture."""

import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillmark.llm import boosting, common, exact_dedup, jaccard, line_dedup, mixing, packing, pii, ppm, quality, urls, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# ---- exact copies


def test_exact_groups(docs):
    got = rows_of(exact_dedup.exact_groups(docs, k=3))
    base = [(r["doc_id"], hashlib.sha256((r["text"] or "").encode().lower()).digest()) for r in docs.collect()]
    groups = defaultdict(list)
    for i, d in base:
        groups[d].append(i)
    assert len(got) == len(base)
    assert sum(r["kept"] for r in got) == len(groups)
    for r in got:
        own = groups[bytes(r["digest"])]
        assert r["group_size"] == len(own)
        assert r["keep_id"] == max((x for x in own if x is not None), default=None)
        assert not r["kept"] or r["id"] == r["keep_id"]


def test_exact_dedup_keeps_columns_and_one_row(docs, nothing):
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    texts = [(r["text"] or "").encode().lower() for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({(r["text"] or "").encode().lower() for r in docs.collect()})
    assert exact_dedup.exact_dedup(nothing).count() == 0 and exact_dedup.exact_groups(nothing).count() == 0


def test_heavy_hitters_finds_every_frequent_key(spark):
    r = random.Random(3)
    keys = [bytes([x]) for x in [1] * 400 + [2] * 300 + [r.randint(3, 255) for _ in range(600)]]
    r.shuffle(keys)
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary").repartition(5)
    found = {bytes(r["k"]) for r in common.heavy_hitters(df, "k", 10).collect()}
    assert {b"\x01", b"\x02"} <= found and len(found) <= 10


# ---- WARC


def test_warc_round_trip(spark, tmp_path):
    big = "x<p>é\r\n\r\n" * 40
    rows = [(1, "http://a/\r\nEvil: 1", big, 0), (2, None, big, 0), (3, "http://c", None, 0), (4, "http://d", "", 0), (5, "u", "short", 0), (6, "u", "short", 0), (None, "n", big, 0), (1, "http://a/", big, 0), (9, "long", "y" * 3_000_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset int").repartition(3)
    index = warc.write_warc(pages, f"file://{tmp_path}/w")
    got = warc.read_warc(index).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h or "" for i, _, h, _ in rows if i == r["page_id"]).encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), hashlib.sha256(html).hexdigest())
        revisit = r["page_id"] == 2
        assert (r["record_type"], r["refers_to"]) == (("revisit", 1) if revisit else ("response", None))
        assert revisit or bytes(r["payload"]) == html
    some = warc.read_warc(index.where("page_id IN (2, 9)")).collect()
    assert sorted(r["page_id"] for r in some) == [2, 9]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(empty, f"file://{tmp_path}/e")).count() == 0


def test_warc_ranges_join_neighbours_only():
    runs = warc._ranges([("a", 0, 10), ("a", 10, 10), ("a", 20 + warc.GAP + 1, 5), ("b", 0, 5), ("b", 5, warc.SPAN)])
    assert [len(r) for r in runs] == [2, 1, 1, 1]


# ---- personal data


def luhn(x):
    return sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(x))) % 10 == 0


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans(spark):
    r = random.Random(1)
    parts = ["a@b.co", "x.y@z-w.org.", "@", "a@b", "1.2.3.4", "999.1.1.1", "001.2.3.255.7", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 123-4567", "+49 30 1234", "é😀", " ", "\n", "5", "-", ".", "+", "12", "word"]
    texts = [None, ""] + ["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(150)] + ["a@" + "b." * 20000 + "c", "1" * 30000, "a" * 5000, "a@b.co_x@c.de%y@d.ef", "1.2.3.4.5.6.7.8", "1.2.3.4 " * 3000, "+1" + "(" * 9000 + "2", "a@" * 3000, "x.co " * 100 + "q@w.er"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS start", "'k' AS kind", "'t' AS __text", "2 AS __base")
    got = pii.find_personal(df)
    assert got.columns == [*df.columns, "__spans"]
    for row in got.collect():
        assert [(s["kind"], s["start"], s["end"]) for s in row["__spans"] if s["base"]] == base_spans(row["text"] or ""), row["text"]
    assert pii.find_personal(df.limit(0)).count() == 0


def test_pii_proposals(spark):
    texts = ["call me: phone (555) 123-4567 today", 'the token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" here', "number 9870157079875996 of the", "plain prose without anything", "on 12.03.2024 it was"]
    got = [[s["kind"] for s in r["__spans"]] for r in pii.find_personal(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")).orderBy("doc_id").collect()]
    assert got == [["phone"], ["secret"], [], [], []]
    one = pii.find_personal(spark.createDataFrame([("mail a@b.co or +1 555 123 4567.",)], "text string"))
    assert one.select(pii.redacted(one["text"], one["__spans"])).first()[0] == "mail [email] or [phone]."


def test_pii_recall_and_precision_of_proposals_by_kind(spark):
    """Spans made with another seed, each in a text of its own: what generators propose and thresholds take."""
    rows = [(i, kind, before, hit, label) for i, (kind, before, hit, _, label) in enumerate(pii.labelled(1500, seed=99))]
    df = spark.createDataFrame([(i, f"{before}{hit} and more words") for i, _, before, hit, _ in rows], "doc_id int, text string")
    spans = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["__spans"]] for r in pii.find_personal(df).collect()}
    for kind in pii.GENERATORS:
        taken, real = Counter(), Counter()
        for i, k, before, hit, label in rows:
            if k == kind:
                real[label] += 1
                taken[label] += any(a < len(before) + len(hit) and b > len(before) for a, b, _ in spans[i])
        assert taken[1] / real[1] >= 0.85, (kind, taken, real)
        assert taken[1] / (taken[1] + taken[0]) >= 0.9, (kind, taken, real)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_pii_proposals_on_documents(spark):
    """Keys written out are found; documents without digits, marks or long codes get no proposal."""
    rows = pii.find_personal(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")).collect()
    written_out = [r for r in rows if re.search(r'(?:password=|token = ")[0-9a-f]{16,}|\bAKIA[A-Z2-7]{16}\b', r["text"] or "")]
    assert written_out and sum(any(s["kind"] == "secret" for s in r["__spans"]) for r in written_out) >= 0.95 * len(written_out)
    plain = [r for r in rows if not re.search(r"[0-9=]", r["text"] or "")]
    assert len(plain) > 100 and sum(bool(r["__spans"]) for r in plain) <= 0.01 * len(plain)


def test_pii_sample_has_different_texts_and_is_the_same_however_rows_lie(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(pii, "SAMPLE_DOCS", 30)
    r = random.Random(8)
    part = lambda: str(r.randint(0, 255))
    texts = [f"host {'.'.join(part() for _ in range(4))} and {r.randint(256, 999)}.1.2.{part()} see {i}" for i in range(60)]
    frame = lambda rows, n: spark.createDataFrame([(t,) for t in rows], "__text string").repartition(n)
    first = min(texts, key=lambda t: frame([t], 1).select(F.xxhash64("__text")).first()[0])
    sampled = lambda rows, n: sorted(map(str, pii._labelled_by_formats(frame(rows, n)).collect()))
    plain = sampled(texts, 2)
    assert len(plain) >= 30
    assert sampled([*texts, *[first] * 500], 7) == plain
    monkeypatch.setattr(pii, "SAMPLE_KIND", 10)
    assert sampled(texts, 1) == sampled(texts[::-1], 5)


def test_pii_cost_follows_the_length(spark):
    texts = ["z" * 1_000_000, "1.2.3.4 " * 20_000, "(555) 123-4567, " * 5_000]
    pii.find_personal(spark.createDataFrame([(0, "x")], "doc_id int, text string")).count()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    began = time.time()
    got = {r["doc_id"]: r["n"] for r in pii.find_personal(df).selectExpr("doc_id", "size(__spans) AS n").collect()}
    assert got[0] == 0 and got[1] == 20_000 and time.time() - began < 60


def test_boosting_on_held_out_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.Boosted().fit(x[:1000], y[:1000])
    scores = model.score(x[1000:])
    assert ((scores > 0) == (y[1000:] > 0.5)).mean() > 0.93
    a, b = boosting.platt(scores, y[1000:])
    assert abs((1 / (1 + np.exp(-(a * scores + b)))).mean() - y[1000:].mean()) < 0.02


# ---- quality rules


def plain_stats(text):
    t = text or ""
    words = WORD.findall(t)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\x0b#\x85 é", max_size=120), max_size=6))
def test_text_stats(texts):
    got = quality.text_stats([*texts, None])
    for i, t in enumerate([*texts, None]):
        assert tuple(int(c[i]) for c in got[:5]) == plain_stats(t)


def test_quality_rejects_outliers_only(spark, docs, nothing):
    out = rows_of(quality.quality_rules(docs))
    assert len(out) == docs.count()
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality_rules(nothing).count() == 0
    r = random.Random(4)
    clean = [(i, " ".join(r.choice(["some", "plain", "words", "here", "again", "other", "thing"]) + r.choice(["", "s"]) for _ in range(r.randint(60, 200))), "en", r.choice("ab")) for i in range(400)]
    junk = [(1000 + i, " ".join("w%d###" % r.randint(0, 99) for _ in range(80)), "en", "a") for i in range(20)]
    judged = {x["id"]: x["kept"] for x in rows_of(quality.quality_rules(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")))}
    assert sum(not judged[i] for i, *_ in clean if i in judged) <= 2
    assert not any(judged[i] for i, *_ in junk)


def test_chi2():
    assert abs(quality.chi2_quantile(0.95, 6) - 12.5916) < 1e-3


def plain_mcd(rows, floor):
    """(mean, covariance) by group of rows (group, language, vector): the same steps with every distance sorted."""
    lang = {g: x for g, x, _ in rows}
    data = {g: np.array([v for h, _, v in rows if h == g]) for g in lang}

    def leaning(n, mean, cov, prior):
        return (n * mean + quality.PRIOR * prior[0]) / (n + quality.PRIOR), (n * cov + quality.PRIOR * prior[1]) / (n + quality.PRIOR)

    def moments(parts):
        x = np.concatenate(parts)
        return len(x), x.mean(axis=0), np.cov(x.T, bias=True)

    inner = data
    for _ in range(quality.STEPS):
        all_ = moments(list(inner.values()))[1:]
        of_lang = {x: leaning(*moments([inner[g] for g in lang if lang[g] == x]), all_) for x in set(lang.values())}
        params = {g: leaning(*moments([inner[g]]), of_lang[lang[g]]) for g in lang}
        inner = {}
        for g, x in data.items():
            mean, cov = params[g]
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov * quality.CONSISTENCY + floor), x - mean)
            inner[g] = x[np.argsort(d)[: math.ceil(quality.H_SHARE * len(x))]]
    return params


def test_mcd_equals_a_plain_version_and_resists_contamination(spark):
    rng = np.random.default_rng(1)
    floor = np.diag(np.array(list(quality.FEATURES.values())) ** 2)
    rows = []
    for g, lang, centre, n in (("a", "x", 1.0, 600), ("b", "x", 1.5, 300), ("c", "y", 0.0, 400), ("d", "y", 0.3, 7)):
        v = rng.normal(size=(n, quality.P)) * 0.5 + centre
        v[: n // 8] += 8
        rows += [(g, lang, x) for x in v]
    frame = spark.createDataFrame([(g, x, *map(float, v)) for g, x, v in rows], "grp string, lang string, " + ", ".join(f"f{j} double" for j in range(quality.P)))
    got = {r["grp"]: r for r in quality.mcd(frame.repartition(3)).collect()}
    plain = plain_mcd(rows, floor)
    for g, (mean, cov) in plain.items():
        assert np.abs(np.array(got[g]["mean"]) - mean).max() < 0.05, g
        assert abs(got[g]["det"] - np.linalg.slogdet(cov * quality.CONSISTENCY + floor)[1]) < 0.25, g
    clean = np.array([v for g, _, v in rows if g == "a"])[75:]
    assert np.abs(np.array(got["a"]["mean"]) - clean.mean(axis=0)).max() < 0.15
    white = np.array(got["a"]["white"]).reshape(quality.P, -1)
    far = ((np.array([v for g, _, v in rows if g == "a"]) - got["a"]["mean"]) @ white.T) ** 2
    assert (far.sum(axis=1) > quality.chi2_quantile(quality.QUANTILE, quality.P)).tolist()[:75] == [True] * 75


def test_mcd_is_the_same_with_many_groups_and_says_when_it_does_not_stand(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{g}", f"l{g % 2}", *map(float, rng.normal(size=quality.P) * 0.1 + g)) for g in range(6) for _ in range(40 if g else 3)]
    df = spark.createDataFrame(rows, "grp string, lang string, " + ", ".join(f"f{j} double" for j in range(quality.P)))
    with pytest.warns(UserWarning, match="estimates still moved after 1 "):
        quality.mcd(df, steps=1)
    few, many = ({r["grp"]: (r["mean"], r["white"], r["det"]) for r in quality.mcd(df, most=most).collect()} for most in (100, 0))
    assert few.keys() == many.keys()
    for g in few:
        for a, b in zip(few[g], many[g], strict=True):
            assert np.allclose(a, b, rtol=1e-6, atol=1e-9)


def test_quality_has_no_size_at_which_the_rule_changes(spark):
    """A junk document is rejected and plain ones stay, whatever the number of documents of its source."""
    r = random.Random(6)
    words = ["some", "plain", "words", "here", "again", "other", "thing", "more", "said"]
    plain = lambda: " ".join(r.choice(words) + r.choice(["", "s", "ed"]) for _ in range(r.randint(60, 200)))
    rows, sizes = [], (2, 10, 40, 99, 101, 200)
    for k, n in enumerate(sizes):
        rows += [(1000 * k + i, plain(), "en", f"s{k}") for i in range(n)] + [(1000 * k + 999, "#*$%&|<> " * 60 + plain(), "en", f"s{k}")]
    judged = {x["id"]: x["kept"] for x in rows_of(quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))}
    assert [judged[1000 * k + 999] for k in range(len(sizes))] == [False] * len(sizes)
    assert sum(not kept for i, kept in judged.items() if i % 1000 != 999) <= 3


# ---- URL filters


def test_url_rules(spark):
    cases = ["http://A.Example.com/en/x?y#z", "https://www.example.com/en/1", "x://b.net/es/", "http://c.org", None, "", "no scheme", "http://com/", "http://notcom/", "http://q.net/fr", "HTTP://a.net/fr/x", "a://b://c.com/d", "http://h.com?x=/", "http://é.com/ü"] + [f"http://s{i}.example.com/en/{i}" for i in range(60)] + [f"http://s{i}.shop.com/p/{i}" for i in range(60)]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(cases)], "page_id int, url string, key string, __url string")
    got = {r["page_id"]: r for r in urls.filter_urls(df, urls.RULES).collect()}
    for i, u in enumerate(cases):
        rest = u[u.find("://") + 3 :] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=lambda x: len(x[0]), default=(None, None))
        assert (got[i]["__host"], got[i]["__path"], got[i]["__rule"]) == (host, path, best[0]), u
        assert got[i]["__verdict"] in ("allow", "block") and (best[1] is None or got[i]["__verdict"] == best[1])
    assert urls.filter_urls(df.limit(0), urls.RULES).count() == 0


def test_url_threshold_is_calibrated_on_all_decided_urls_not_fitted_to(spark, monkeypatch):
    decided = [f"https://a.com/x{i}" for i in range(150)] + [f"https://b.net/es/{i}" for i in range(90)]
    df = spark.createDataFrame([(u,) for u in [*decided, *decided[:40], "https://c.org/1", None]], "url string")
    seen = {}
    monkeypatch.setattr(urls, "fit", lambda rows, f=urls.fit: seen.update(fit={r["url"]: r["verdict"] for r in rows.collect()}) or f(rows))
    monkeypatch.setattr(urls, "calibrate", lambda rows, f=urls.calibrate: seen.update(held=Counter(r["verdict"] for r in rows.collect())) or f(rows))
    assert urls.filter_urls(df, urls.RULES, sample=20).count() == df.count()
    assert Counter(seen["fit"].values()) == {"allow": 20, "block": 20}
    assert seen["held"] == {"allow": 130, "block": 70} and urls.SAMPLE >= 10_000


def test_url_model_tells_classes_apart_on_held_out_urls(spark):
    r = random.Random(2)
    good = [f"http://{r.choice(['alpha', 'beta', 'gamma'])}{r.randint(0, 99)}.example.org/wiki/{r.randint(0, 999)}" for _ in range(300)]
    bad = [f"http://{r.choice(['cheap', 'pills', 'casino'])}{r.randint(0, 99)}.example.org/buy/{r.randint(0, 999)}" for _ in range(300)]
    sample = spark.createDataFrame([(u, "allow") for u in good[:200]] + [(u, "block") for u in bad[:200]], "url string, verdict string")
    held = spark.createDataFrame([(u, u) for u in set(good[200:] + bad[200:])], "key string, url string")
    scores = {x["key"]: x["score"] for x in urls.score(held, urls.fit(sample)).collect()}
    assert sum(scores[u] > 0 for u in set(good[200:])) > 0.95 * len(set(good[200:])) and sum(scores[u] < 0 for u in set(bad[200:])) > 0.95 * len(set(bad[200:]))


def plain_url_score(sample, url):
    """Mean over a URL's characters of the log ratio of both models, interpolated from the definition."""
    counts = {c: [defaultdict(Counter) for _ in range(urls.ORDER + 1)] for c in urls.CLASSES}
    for u, verdict in sample:
        padded = " " * urls.ORDER + u + "\n"
        for i in range(urls.ORDER, len(padded)):
            for k in range(urls.ORDER + 1):
                counts[verdict][k][padded[i - k : i]][padded[i]] += 1
    padded, total = " " * urls.ORDER + url + "\n", 0.0
    for i in range(urls.ORDER, len(padded)):
        p = {}
        for c in urls.CLASSES:
            p[c] = 1 / 1_114_112
            for k in range(urls.ORDER + 1):
                own = counts[c][k].get(padded[i - k : i])
                if own:
                    n, t = sum(own.values()), len(own)
                    p[c] = own[padded[i]] / (n + t) + t / (n + t) * p[c]
        total += math.log(p["allow"]) - math.log(p["block"])
    return total / (len(padded) - urls.ORDER)


def test_url_scores_equal_the_definition(spark):
    r = random.Random(8)
    sample = [(f"http://{r.choice('ab')}{r.randint(0, 9)}.org/{r.choice(['x', 'wiki', 'é'])}/{i}", r.choice(urls.CLASSES)) for i in range(40)]
    wanted = ["", "http://a1.org/wiki/3", "zzz", "ftp://é.net/" + "long/" * 900, *(u for u, _ in sample[:5])]
    tables = urls.fit(spark.createDataFrame(sample, "url string, verdict string"))
    got = {x["key"]: x["score"] for x in urls.score(spark.createDataFrame([(u, u) for u in wanted], "key string, url string"), tables).collect()}
    for u in wanted:
        assert math.isclose(got[u], plain_url_score(sample, u), rel_tol=1e-9, abs_tol=1e-12)


def test_url_cost_follows_the_length_and_repeats_are_split(spark):
    long = "http://a.org/" + "path-é/" * 150_000  # a megabyte
    rows = [(0, long), (1, None)] + [(10 + i, "http://hot.org/x") for i in range(3000)] + [(5000 + i, f"http://{i}.com/") for i in range(40)] + [(6000 + i, f"http://{i}.net/es/") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(4)
    began = time.time()
    got = urls.filter_urls(df, urls.RULES)
    assert Counter(r["page_id"] for r in got.collect()) == Counter(i for i, _ in rows)
    assert time.time() - began < 60
    assert got.where("url = 'http://hot.org/x'").select("__score").distinct().count() == 1 and got.where("__score IS NULL AND __rule IS NULL").count() == 0


# ---- mixing


def test_mix_meets_targets(docs, nothing):
    got = rows_of(mixing.mix(docs, [3, 1, 2]))
    again = rows_of(mixing.mix(docs.repartition(5), [3, 1, 2]))
    assert sorted((r["mark"], r["taken"]) for r in got) == sorted((r["mark"], r["taken"]) for r in again)
    size = Counter()
    for r in docs.collect():
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    names = sorted((s for s in size if s is not None), key=str.encode) + [None]
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * size[s], weight[s] * mid) for s in names) < 1.5 * sum(size.values()) else (low, mid)
    by_target = {round(min(2 * size[s], weight[s] * low), 3): s for s in names}
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = by_target[round(r["target"], 3)]
        assert r["source_size"] == size[s]
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - min(2 * size[s], weight[s] * low)) <= 1
    assert mixing.mix(nothing, [3, 1, 2]).count() == 0


def test_mixed_rows_hold_what_is_taken(docs, nothing):
    total = sum(r["taken"] for r in rows_of(mixing.mix(docs, [3, 1, 2])))
    out = mixing.mixed_rows(docs, [3, 1, 2])
    assert out.columns == docs.columns
    assert sum(len(WORD.findall(r["text"])) for r in out.collect()) == total
    whole = {r["text"] or "" for r in docs.collect()}
    assert all(any(t.startswith(r["text"]) for t in whole) for r in out.collect())  # parts are beginnings, lines and all
    assert mixing.mixed_rows(nothing, [3, 1, 2]).count() == 0


# ---- packing


def check_bins(lengths, bins, size):
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(0 < sum(lengths[i] for i in b) <= size for b in bins)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_pack(lengths):
    bins = packing.pack(lengths, 50)
    check_bins(lengths, bins, 50)
    assert len(bins) <= len(packing.best_fit(lengths, 50))


def test_local_search_empties_bins():
    bins = [[0, 1], [2, 3], [4, 5]]  # 6+3, 6+3, 4+2 of 12: the third fits into the others after exchanges
    lengths = [6, 3, 6, 3, 4, 2]
    out = packing.local_search(lengths, bins, 12)
    check_bins(lengths, out, 12)
    assert len(out) == 2


def test_local_search_ends_only_where_no_exchange_helps():
    for seed in range(40):
        r = random.Random(seed)
        lengths = [r.randint(1, 6) for _ in range(60)]
        bins = [[*range(i, min(i + 8, 60))] for i in range(0, 60, 8)]  # many pieces in a bin
        out = packing.local_search(lengths, bins, 50)
        check_bins(lengths, out, 50)
        if len(out) == -(-sum(lengths) // 50):
            continue
        fill = [sum(lengths[i] for i in b) for b in out]
        for x, own in enumerate(out):
            sums = {lengths[i] for i in own} | {lengths[i] + lengths[j] for i, j in itertools.combinations(own, 2)}
            for y, other in enumerate(out):
                moves = [t - z for t in sums for z in {0, *(lengths[i] for i in other)} if t > z]
                assert y == x or fill[x] == 50 or fill[y] < fill[x] or not any(fill[y] + d <= 50 for d in moves)
    r = random.Random(7)
    lengths = [r.randint(90, 130) for _ in range(2000)]
    assert len(packing.pack(lengths, 1024)) == -(-sum(lengths) // 1024)


def test_pieces_equal_the_tokenizers_library(docs, nothing):
    from tokenizers import Tokenizer

    path = packing.vocabulary()
    tokenizer = Tokenizer.from_file(path)
    texts = ["", "a<|endoftext|> b", " x  y\n\n z\t", "é…　x\x00y ", "don't I'll  'S 12345 ½", "a" * 3000, *(r["text"] or "" for r in docs.collect())]
    # runs that tiktoken's pattern has no stack for, and a megabyte of other kinds
    texts += [" " * 1_000_000, " " * 1_000_000 + "x", "\n" * 1_000_000, "ab" * 500_000, "1" * 1_000_000, (" " * 600_000 + "é") * 2]
    for t, ids in zip(texts, packing.encoder(path)(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    got = rows_of(packing.pack_documents(docs, path, size=128, block=30))
    expected = Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        n = len(ids)
        cuts = [0, n] if n <= 128 else [0, *range(n % 128 or 128, n + 1, 128)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[(r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= 1.03 * math.ceil(sum(r["length"] for r in got) / 128) + 1
    assert packing.pack_documents(nothing, path).count() == 0
    long = docs.sparkSession.createDataFrame([(1, " " * 1_000_000), (2, "\n" * 1_000_000 + "end"), (3, "x")], "doc_id long, text string")
    pieces = rows_of(packing.pack_documents(long, path))
    assert {i: sum(r["length"] for r in pieces if r["id"] == i) for i in (1, 2, 3)} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in long.collect()}


# ---- near duplicates


def test_jaccard_classes_equal_brute_force(docs, nothing):
    got = rows_of(jaccard.near_classes(docs))
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in docs.collect()]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None for _, w in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][1] == rows[j][1] or (a and b and len(a & b) >= 0.8 * len(a | b)):
                parent[find(i)] = find(j)
    classes = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        classes[find(i)].append(doc_id)
    expected = Counter((x, min((y for y in own if y is not None), default=None), len(own)) for own in classes.values() for x in own)
    assert Counter((r["id"], r["class_id"], r["class_size"]) for r in got) == expected
    assert sum(r["kept"] for r in got) == len(classes)
    texts = {b" ".join(w): s for (_, w), s in zip(rows, sets, strict=True)}
    links = {k: sum(bool(a and b) and j != k and len(a & b) >= 0.8 * len(a | b) for j, b in texts.items()) for k, a in texts.items()}
    copies = Counter(b" ".join(w) for _, w in rows)
    assert Counter((r["n_links"], r["n_copies"]) for r in got) == Counter((links[b" ".join(w)], copies[b" ".join(w)] - 1) for _, w in rows)
    assert jaccard.near_classes(nothing).count() == 0
    assert jaccard.near_dedup(docs).count() == len(classes)


def test_jaccard_finds_links_across_components(spark, monkeypatch):
    """Tiny blocks, so that the exchange of chunks is used."""
    monkeypatch.setattr(jaccard, "CHUNK", 3)
    r = random.Random(9)
    base = ["w%d" % i for i in range(300)]
    texts = []
    for i in range(30):  # a chain: neighbours are alike, far ones are not
        base = base[4:] + [f"n{i}_{k}" for k in range(4)]
        texts.append(" ".join(base))
    r.shuffle(texts)
    got = jaccard.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert {x["class_id"] for x in got} == {0}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    links = [sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets]
    assert [x["n_links"] for x in sorted(got, key=lambda x: x["id"])] == links


def test_pruning_table_and_recall():
    least = jaccard.least_matches(0.8, 1e-6)
    rng = np.random.default_rng(3)
    left = rng.integers(0, 1 << 16, (5000, jaccard.SIGNATURE), dtype=np.uint16)
    near = np.where(rng.random(left.shape) < 0.8, left, rng.integers(0, 1 << 16, left.shape, dtype=np.uint16))
    far = np.where(rng.random(left.shape) < 0.3, left, rng.integers(0, 1 << 16, left.shape, dtype=np.uint16))
    assert len(jaccard.survivors(left, near, least)) >= 0.999 * len(left)
    assert len(jaccard.survivors(left, far, least)) <= 0.01 * len(left)


# ---- language model


class PlainModel:
    """The language model from its definition, byte by byte."""

    def __init__(self, train):
        self.n = [Counter() for _ in range(ppm.ORDER + 1)]
        for text in train:
            text = b" " * ppm.ORDER + text
            self.n[ppm.ORDER].update((text[i - ppm.ORDER : i], text[i]) for i in range(ppm.ORDER, len(text)))
        for k in range(ppm.ORDER - 1, -1, -1):  # once for each longer context
            self.n[k].update((c[1:], b) for c, b in self.n[k + 1])
        self.after = [defaultdict(dict) for _ in self.n]
        for k, table in enumerate(self.n):
            for (c, b), n in table.items():
                self.after[k][c][b] = n
        self.fresh, self.all = Counter(), Counter()
        for k, table in enumerate(self.after):
            for own in table.values():
                t = sum(own.values())
                for n in own.values():  # each occurrence taken out
                    for _ in range(n) if t > 1 else ():
                        kinds = len(own) - (n == 1)
                        cell = (k, math.floor(math.log2(max(t - 1, 1)) * 2), math.floor(math.log2(max(kinds, 1)) * 2))
                        self.fresh[cell] += n == 1
                        self.all[cell] += 1

    def escape(self, k, t, kinds):
        cell = (k, math.floor(math.log2(max(t, 1)) * 2), math.floor(math.log2(max(kinds, 1)) * 2))
        return min(max((self.fresh[cell] + 2 * kinds / (t + kinds)) / (self.all[cell] + 2), 1e-6), 1 - 1e-6)

    def p(self, context, byte):
        gone, p = set(), 1.0
        for k in range(ppm.ORDER, -1, -1):
            own = self.after[k].get(context[len(context) - k :])
            left = {b: n for b, n in (own or {}).items() if b not in gone}
            if left:
                e = self.escape(k, sum(left.values()), len(left))
                if byte in left:
                    return p * (1 - e) * left[byte] / sum(left.values())
                p *= e
            gone |= set(own or ())
        return p / (256 - len(gone))

    def steps(self, text):
        """(state, hit, guess, byte, context) of the bytes of a text; state is None where its long context is new."""
        text, last, times, run = b" " * ppm.ADAPTIVE + text, {}, Counter(), 0
        for i in range(ppm.ADAPTIVE, len(text)):
            long = text[i - ppm.ADAPTIVE : i]
            met = long in last
            hit = met and last[long] == text[i]
            state = (min(times[long], ppm.TIMES) - 1) * ppm.RUNS + min(int(math.log2(run + 1)), ppm.RUNS - 1) if met else None
            yield state, hit, last.get(long), text[i], text[i - ppm.ORDER : i]
            run = run + 1 if hit else 0
            last[long] = text[i]
            times[long] += 1

    def scores(self, texts, train):
        tries, hits = Counter(), Counter()
        for text, use in zip(texts, train, strict=True):
            for state, hit, *_ in self.steps(text) if use else ():
                if state is not None:
                    tries[state] += 1
                    hits[state] += hit
        out = []
        for text in texts:
            total = 0.0
            for state, hit, guess, byte, context in self.steps(text):
                if state is not None:
                    e = (tries[state] - hits[state] + 0.5) / (tries[state] + 1)
                    total += math.log10(1 - e) if hit else math.log10(e)
                if not hit:
                    total += math.log10(self.p(context, byte))
                    if state is not None:  # the wrong guess is left out below
                        total -= math.log10(max(1 - self.p(context, guess), 1e-9))
            out.append(total)
        return out


def test_ppm_equals_the_definition(docs, nothing):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    words = [(i, t.lower().split() + [b""]) for i, t in rows]
    counts = Counter()
    for i, w in words:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(w)
    total, kinds = sum(counts.values()), len(counts)
    streams = [ppm._stream(ppm.tokens(t)) for _, t in rows]
    train = [not ppm.held_out(i) for i, _ in rows]
    plain = PlainModel([x for x, use in zip(streams, train, strict=True) if use]).scores(streams, train)
    base = [sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w) for _, w in words]
    expected = sorted((len(w), sum(counts[x] > 0 for x in w), round(b, 6), round(p, 6)) for (_, w), b, p in zip(words, base, plain, strict=True))
    for out in (ppm.score_documents(docs), ppm.score_documents(docs, hot=3)):  # all broadcast, and nearly nothing
        got = rows_of(out)
        assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == expected
        assert all(r["train_tokens"] == total and r["held_out"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 1) for r in got)
    assert ppm.score_documents(nothing).count() == 0


def test_ppm_chances_sum_to_one(spark):
    r = random.Random(5)
    text = ppm._stream(["".join(r.choice("abcd") for _ in range(r.randint(1, 7))).encode() for _ in range(60)])
    keys, n = np.unique(ppm.Positions([text], adaptive=False).key, return_counts=True)
    contexts = [b"     ", b"  abc", b"abcda", b"zzzzz", b" zzza", text[20:25]]
    every = {(int.from_bytes(c, "big") << 8) + b for c in contexts for b in range(256)}
    rows = [(int(k), int(x)) for k, x in zip(keys, n, strict=True)] + [(k, 0) for k in every - set(keys.tolist())]
    got = {x["key"]: 10 ** x["score"] for x in ppm.score_keys(spark.createDataFrame(rows, "key long, n long")).collect()}
    assert len(got) == len(rows)
    plain = PlainModel([text])
    for c in contexts:
        own = [got[(int.from_bytes(c, "big") << 8) + b] for b in range(256)]
        assert abs(sum(own) - 1) < 1e-9
        assert all(math.isclose(own[b], plain.p(c, b), rel_tol=1e-9) for b in range(256))


def test_ppm_reads_across_words(spark):
    fluent = "the cat sat on the mat and saw the dog run to the end of the road"
    words = fluent.split()
    random.Random(1).shuffle(words)
    train = [i for i in range(60) if not ppm.held_out(i)]
    tests = [i for i in range(60) if ppm.held_out(i)][:2]
    frame = spark.createDataFrame([(i, fluent) for i in train] + [(tests[0], fluent), (tests[1], " ".join(words))], "doc_id int, text string")
    scores = {r["id"]: r["score"] for r in rows_of(ppm.score_documents(frame))}
    assert scores[tests[0]] > scores[tests[1]] + 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_ppm_beats_the_unigram_base_on_held_out_texts(spark):
    out = ppm.op10_ppm(spark, "/root/testdata/sf0.01").where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert out["sum(score)"] > out["sum(base_score)"]


# ---- pipeline


def test_scratch_is_cleared(spark):
    path = common.scratch(spark)
    kept = common.written(spark.range(3), "something")
    assert kept.count() == 3 and path.split("://")[-1].startswith("/")
    common.clear(spark)
    import os

    assert not os.path.exists(path.removeprefix("file://"))


def test_pipeline_stages(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    now = docs
    for name, stage in pipeline.STAGES[:-1]:
        before, now = now, common.written(stage(spark, now, ""), name)
        assert now.columns == docs.columns
        assert name == "source_mixing" or now.count() <= before.count()
    packed = pipeline.STAGES[-1][1](spark, now, "")
    assert packed.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()


def test_pipeline_equals_plain_stages(spark):
    """Which documents the first three stages keep, against plain versions; the others' words and tokens are counted.

    One source and one language of even prose, so that the outlier rule has nothing to reject but the marked junk; null,
    empty and short texts fail the base rules.
    """
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(12)
    words = ["some", "plain", "words", "here", "again", "other", "thing", "more", "said", "since", "under", "every"]
    text = lambda n=120: " ".join(r.choice(words) + r.choice(["", "s", "ed"]) for _ in range(n))
    texts = [text(r.randint(60, 160)) for _ in range(120)]
    texts += [t.upper() if i % 2 else t for i, t in enumerate(texts[:20])]  # exact copies but for letters' case
    near = [t.split() for t in texts[20:40]]
    texts += [" ".join([*w[:30], "changed", *w[31:]]) for w in near]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)] + [(900, None, "en", "a", 0), (901, "", "en", "a", 0), (902, "too short", None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = []
    now = docs
    for name, stage in pipeline.STAGES[:-1]:
        now = common.written(stage(spark, now, ""), name)
        kept.append({x["doc_id"] for x in now.collect()})
    upper = {i for i, t, *_ in rows if t and t.isupper()}
    assert kept[0] >= {i for i, t, *_ in rows if t and len(t.split()) >= 20} - upper and not kept[0] & {900, 901, 902}
    largest = {}
    for i, t, *_ in rows:
        if i in kept[0]:
            largest[t.lower()] = max(i, largest.get(t.lower(), -1))
    assert kept[1] == set(largest.values())
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i in kept[1] for w in [rows[i][1].lower().split()]}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(sorted(sets), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            parent[find(j)] = find(i)
    least = {}
    for i in sets:
        least[find(i)] = min(i, least.get(find(i), i))
    assert kept[2] == set(least.values()) and len(kept[2]) < len(kept[1])
    sizes = sum(len(rows[i][1].split()) for i in kept[2])
    taken = sum(len(x["text"].split()) for x in now.collect())
    assert abs(taken - 1.5 * sizes) <= 1
    packed = rows_of(pipeline.STAGES[-1][1](spark, now, ""))
    assert {x["doc_id"] for x in packed} == kept[3]
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        out = stage(spark, empty, "")
        assert out.count() == 0


# ---- lines


def test_line_dedup(spark, nothing):
    r = random.Random(8)
    common_lines = [f"shared line {i}" for i in range(12)]
    rows = [(i, "\n".join([" " + r.choice(common_lines) + "\t" if r.random() < 0.5 else f"own {r.randint(0, 400)}" for _ in range(r.randint(1, 8))] + ["", " "][: r.randint(0, 2)]), f"s{r.randint(0, 14)}" if i % 9 else None, "x") for i in range(200)]
    rows += [(500, None, "s1", "x"), (501, "", "s1", "x"), (None, "shared line 1\nk", "s2", "x"), (3, *rows[3][1:]), (502, "own\n" * 3000, "s3", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, at string")
    bare = lambda x: x.strip(" \t\x0b\x0c\r")
    sites = defaultdict(set)
    for _, t, s, _ in rows:
        for line in (t or "").split("\n"):
            sites[bare(line)].add(s)
    bad = {x for x, s in sites.items() if x and len(s) >= 6}
    assert bad
    expected = Counter((i, None if t is None else "\n".join(x for x in t.split("\n") if bare(x) not in bad)) for i, t, *_ in rows)
    got = line_dedup.drop_boilerplate(df, 6)
    assert got.columns == df.columns
    assert Counter((x["doc_id"], x["text"]) for x in got.collect()) == expected
    assert line_dedup.drop_boilerplate(nothing, 6).count() == 0
