"""Personal data: exact base formats, and further spans proposed widely and chosen by boosted trees. SQL only."""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm.boosting import Boosted, platt
from rillmark.llm.common import written

#: The formats of the base kinds. Possessive where no shorter run could match, so that long runs need no stack. A match of
#: the first two can only begin where a run of its first characters does (or, for email, where the last match ended): a
#: later begin in the run meets the same end. So no run is tried from each of its characters, and texts cost their length.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further candidates; they may overlap each other and the base spans. Every match is of at most LONGEST and at
#: least SHORTEST characters: longer runs are encoded data, not secrets.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}+(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,63}+){1,5}+",
    "ip": r"(?<![0-9A-Za-z.:])(?:[0-9]{1,3}+(?:(?:\.|\x20?[\[(]\x20?(?:\.|dot)\x20?[\])]\x20?|\x20(?:\.|dot)\x20)[0-9]{1,3}+){3}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[\x20._/-]{0,3}[0-9]{4}){3}|[0-9]{4}[\x20._/-]{0,3}[0-9]{6}[\x20._/-]{0,3}[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+.-])[(0-9][0-9().\x20/-]{6,20}[0-9](?![0-9])",
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,256}+(?![A-Za-z0-9_/+-])={0,2}",
}
SHORTEST, LONGEST = 8, 512
ORDER = ["email", "ip", "card", "phone", "secret"]
CONTEXT = 32
#: Words around a span, as patterns; fixed values.
CUES = {
    "cue_phone": r"(?i)(?:phone|tel|call|mobile|fax|cell|whatsapp|sms)",
    "cue_mail": r"(?i)(?:mail|contact|write|reach)",
    "cue_secret": r"(?i)(?:token|passw|secret|api.?key|credential|bearer)",
    "cue_card": r"(?i)(?:card|visa|amex|credit|payment|paid)",
    "cue_host": r"(?i)(?:host|server|address|\bip\b|login|connect|from)",
    "cue_plain": r"(?i)(?:order|invoice|version|isbn|page|total|ref|build|commit|doi|http|www|ticket|price|date|year)",
}
FEATURES = ["length", "digits", "letters", "uppers", "marks", "groups", "longest", "switches", "hex", "luhn", "bytes", *CUES, *(f"is_{k}" for k in GENERATORS)]
#: Made-up labelled spans, and spans of documents that formats label (from so many documents, and so many of each kind),
#: half of them to fit and half to calibrate; least calibrated probability, by kind, of a span that is taken.
SAMPLE, SAMPLE_DOCS, SAMPLE_KIND = 5000, 2000, 400
CONFIDENCE = {"email": 0.9, "ip": 0.9, "card": 0.95, "phone": 0.95, "secret": 0.95}
#: Elements that a running sum or maximum takes together.
BLOCK = 64


def _running(values: Column, combine, zero: int = 0) -> Column:
    """Running combination (a sum, a maximum) of an array of int, each element included; in blocks, so that the cost is
    far from the square of the array's length."""
    start = F.struct(F.lit(zero).alias("last"), F.array().cast("array<int>").alias("all"))

    def add(state, x):
        now = combine(state["last"], x)
        return F.struct(now.alias("last"), F.concat(state["all"], F.array(now)).alias("all"))

    def skip(state, block):  # what stands before each block
        return F.struct(combine(state["last"], block["last"]).alias("last"), F.concat(state["all"], F.array(state["last"])).alias("all"))

    n = F.greatest(F.size(values), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda i: F.aggregate(F.slice(values, i * BLOCK + 1, F.lit(BLOCK)), start, add))
    # the blocks are made once, then read by both
    return F.element_at(F.transform(F.array(blocks), lambda b: F.flatten(F.zip_with(b, F.aggregate(b, start, skip, lambda s: s["all"]), lambda x, before: F.transform(x["all"], lambda v: combine(before, v))))), 1)


def _found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, hit, before, after) in code points.

    What lies between the matches comes from splitting by the same pattern, and positions from adding lengths up.
    """
    kind = "array<struct<start:int,end:int,hit:string,before:string,after:string>>"
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def spans(both):
        hits, gaps = both["hits"], both["gaps"]
        n = F.size(hits)
        ends = _running(F.zip_with(hits, F.slice(gaps, F.lit(1), n), lambda h, g: F.length(h) + F.length(g)), lambda a, b: a + b)
        each = F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), n).alias("gap"), F.slice(gaps, F.lit(2), n).alias("next"), ends.alias("end"))
        return F.transform(each, lambda x: F.struct((x["end"] - F.length(x["hit"])).alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), F.right(x["gap"], F.lit(CONTEXT)).alias("before"), F.left(x["next"], F.lit(CONTEXT)).alias("after")))

    some = F.element_at(F.transform(F.array(F.struct(hits.alias("hits"), gaps.alias("gaps"))), spans), 1)
    return F.when(text.rlike(pattern), some).otherwise(F.array().cast(kind))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(c, i):
        d = c.cast("int") * F.when((F.length(digits) - i) % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return hit.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    n = F.length(_digits(hit))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(hit))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _features(span: Column, kind: str) -> dict[str, Column]:
    """Format of a span and words around it."""
    hit, around = span["hit"], F.concat(span["before"], F.lit(" "), span["after"])
    count = lambda pattern: F.regexp_count(hit, F.lit(pattern)).cast("double")
    out = {
        "length": F.length(hit).cast("double"), "digits": count("[0-9]"), "letters": count("[A-Za-z]"), "uppers": count("[A-Z]"), "marks": count("[^A-Za-z0-9]"), "groups": count("[0-9]+"),
        "longest": F.array_max(F.transform(F.regexp_extract_all(hit, F.lit("[0-9]+|[A-Za-z]+"), F.lit(0)), F.length)).cast("double"),
        "switches": count("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"), "hex": hit.rlike("^[0-9a-f]+$").cast("double"),
        "luhn": F.when(F.length(_digits(hit)).between(13, 19), _luhn(_digits(hit)).cast("double")).otherwise(0.0),
        "bytes": F.regexp_count(hit, F.lit(r"(?<![0-9])0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?![0-9])")).cast("double"),
    }
    out |= {name: around.rlike(pattern).cast("double") for name, pattern in CUES.items()}
    return out | {f"is_{k}": F.lit(float(k == kind)) for k in GENERATORS}


def _base(kind: str, pattern: str) -> Column:
    """Matches of a base format: array of (start, end, hit, valid)."""
    return F.transform(_found(F.col("__text"), pattern), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), _valid(kind, s["hit"]).alias("valid")))


def _proposed(kind: str, pattern: str) -> Column:
    """What a generator finds, with its features."""
    return F.transform(_found(F.col("__text"), pattern), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), *(c.alias(n) for n, c in _features(s, kind).items())))


def _touching(spans: Column, others: Column) -> Column:
    """For each of the spans (in order, apart from each other), whether it touches one of others: by one sorted pass over both.

    In order of start, a span touches an other before it if the largest end of these is over its start, and one after
    it if the least start of these is under its end.
    """
    event = lambda own: lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"))
    both = F.array_sort(F.concat(F.transform(spans, event(1)), F.transform(others, event(0))))

    def touched(rows):
        far = 2**31 - 1
        ends = _running(F.transform(rows, lambda r: F.when(r["own"] == 0, r["end"]).otherwise(0)), F.greatest)
        starts = F.reverse(_running(F.reverse(F.transform(rows, lambda r: F.when(r["own"] == 0, r["start"]).otherwise(far))), F.least, far))
        each = F.filter(F.arrays_zip(rows.alias("r"), ends.alias("e"), starts.alias("s")), lambda x: x["r"]["own"] == 1)
        return F.transform(each, lambda x: (x["e"] > x["r"]["start"]) | (x["s"] < x["r"]["end"]))

    none = F.transform(spans, lambda _: F.lit(False))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), F.element_at(F.transform(F.array(both), touched), 1)).otherwise(none)


def _apart(spans: Column, others: Column) -> Column:
    """The spans that touch none of others."""
    marked = F.arrays_zip(spans.alias("x"), _touching(spans, others).alias("touches"))
    return F.transform(F.filter(marked, lambda z: ~z["touches"]), lambda z: z["x"])


def _candidates(docs: DataFrame) -> DataFrame:
    """docs (with __text) and, by base kind, __<kind>: matches of its format; by generator, __new_<kind>: what it proposes."""
    out = docs
    for kind, pattern in KINDS.items():
        out = out.withColumn(f"__{kind}", _base(kind, pattern))
    for kind, pattern in GENERATORS.items():
        out = out.withColumn(f"__new_{kind}", _proposed(kind, pattern))
    return out


def labelled(n: int, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Made-up (kind, before, hit, after, label): personal data in common formats, and look-alikes that are not."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda k=6: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, k)))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    text = lambda: " ".join(word(8) for _ in range(3))
    rows = []
    for i in range(n):
        kind = list(GENERATORS)[i % len(GENERATORS)]
        good = r.random() < 0.5
        if kind == "email":
            at, dot = r.choice([(" (at) ", "."), ("[at]", "[dot]"), (" at ", " dot "), (" [at] ", " [dot] ")]) if good else (" at ", ".")
            hit = f"{word()}{r.choice(['', '.', '_']) + word() if r.random() < 0.5 else ''}{at}{word(9)}{dot}{r.choice(['com', 'org', 'net', 'de']) if good else word()}"
            before = f"{text()} {r.choice(['mail', 'contact', 'write to', ''])} " if good else f"{text()} "
        elif kind == "phone":
            if good:
                hit = r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}"])
                before = f"{text()} {r.choice(['phone', 'tel.', 'call', 'mobile:', 'fax'])} "
            else:
                hit = r.choice([d(16), d(r.randint(8, 12)), f"20{d(2)}-{d(2)}-{d(2)} {d(2)}", f"{d(2)}.{d(2)}.20{d(2)}", f"{d(1)}.{d(2)}.{d(3)}.{d(2)}", f"{d(3)}.{d(3)}.{d(2)}.{d(3)}", f"{d(4)} {d(4)} {d(4)} {d(4)}"])
                before = f"{text()} {r.choice(['order', 'invoice', 'version', 'in', 'of', word(), word()])} "
        elif kind == "ip":
            part = lambda most=255: str(r.randint(0, most))
            sep = r.choice(["[.]", " [.] ", "(.)", "[dot]", " dot ", " (dot) ", "."])
            if good:
                hit = sep.join(part() for _ in range(4)) if r.random() < 0.8 else ":".join(hexa(4) for _ in range(8))
                before = f"{text()} {r.choice(['host', 'server', 'ip', 'address', 'login from', word(), word()])} "
            else:
                hit = r.choice([f"{part(9)} . {part(9)} . {part(9)} . {part(9)}", ".".join(str(r.randint(256, 999)) for _ in range(4)), sep.join([part(), part(), str(r.randint(256, 999)), part()])])
                before = f"{text()} {r.choice(['version', 'page', 'total', 'price', word()])} "
        elif kind == "card":
            digits = r.choice("3456") + d(14)
            check = next(c for c in "0123456789" if sum((v := int(x) * (1 + k % 2)) - 9 * (v > 9) for k, x in enumerate(reversed(digits + c))) % 10 == 0)
            digits += check if good else r.choice([c for c in "0123456789" if c != check])
            sep = r.choice(["", " ", "-", ".", "/", "  ", " - ", "_"])
            hit = sep.join(digits[k : k + 4] for k in range(0, 16, 4))
            before = f"{text()} {r.choice(['card', 'visa', 'paid by', word(), word()] if good else ['order', 'invoice', 'ref', word(), word()])} "
        elif good and r.random() < 0.3:  # keys with a known beginning need no word before them
            caps = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(k))
            hit = r.choice([f"AKIA{caps(16)}", f"ASIA{caps(16)}", "ghp_" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(36))])
            before = f"{text()} {word()} "
        elif good:
            hit = r.choice([hexa(18), hexa(24), hexa(40), hexa(32), hexa(64), "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz0123456789") for _ in range(r.randint(20, 44)))])
            before = f"{text()} {r.choice(['token = "', 'secret: ', 'password=', 'api_key=', 'bearer '])}"
        else:
            hit = r.choice([word(6) + word(8) + word(8) + word(8) + "xyabcdefg", f"{word()}-{word()}-{word()}-{word()}-{word()}", f"/{word()}/{word()}/{d(4)}/{word()}{word()}", d(18), hexa(40), (word(8) + word(8) + word(8) + "abcdefg").upper()])
            before = f"{text()} {r.choice(['commit ', 'http://' + word() + '.com', '', 'see ', ''])}"
        rows.append((kind, before[-CONTEXT:], hit, f" {text()}"[:CONTEXT], int(good)))
    return rows


def _labelled_by_formats(docs: DataFrame) -> DataFrame:
    """(kind, label, features) of proposals from a bounded sample of docs (with __text): 1 if they touch a valid base span
    of their kind, 0 if they touch a match of its format that fails the check (digits, parts, Luhn); others have no label."""
    # written, so that what explodes it doesn't search the texts again for each condition
    rows = docs.select("__text", F.xxhash64("__text").alias("h"))
    # the hash up to which texts are taken is found among different hashes alone: no task gathers texts of all others, and
    # a frequent text counts once
    edge = rows.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    some = rows.where(F.lit(False) if edge is None else F.col("h") <= edge).dropDuplicates(["h"]).repartition(docs.sparkSession.sparkContext.defaultParallelism)
    found = written(_candidates(some), "pii-sample")

    def judged(kind: str) -> DataFrame:
        whole = lambda b: F.length(b["hit"]) >= (13 if kind == "card" else 1)  # noqa: E731  a group of a card's digits tells nothing
        touches = lambda valid: _touching(F.col(f"__new_{kind}"), F.filter(f"__{kind}", lambda b: (b["valid"] == F.lit(valid)) & whole(b)))
        each = F.transform(F.arrays_zip(F.col(f"__new_{kind}").alias("s"), touches(True).alias("good"), touches(False).alias("bad")), lambda z: F.struct(z["s"].alias("s"), F.when(z["good"], 1).when(z["bad"], 0).alias("label")))
        rows = found.select("h", F.explode(each).alias("x")).where("x.label IS NOT NULL")
        rows = rows.orderBy(F.xxhash64("h", "x.s.start", "x.s.end"), "h", "x.s.start").limit(SAMPLE_KIND)  # by content, however the files lie
        return rows.select(F.lit(kind).alias("kind"), "x.label", *(F.col(f"x.s.{n}").alias(n) for n in FEATURES))

    return functools.reduce(DataFrame.unionByName, map(judged, KINDS))


def fitted(docs: DataFrame) -> tuple[Boosted, dict[str, float]]:
    """The trees, and by kind the score at which its calibrated probability reaches its CONFIDENCE. The sample is bounded."""
    spark = docs.sparkSession
    rows = spark.createDataFrame(labelled(SAMPLE), "kind string, before string, hit string, after string, label int")
    span = F.struct("hit", "before", "after")
    made = functools.reduce(DataFrame.unionByName, (rows.where(F.col("kind") == k).select("kind", "label", *(c.alias(n) for n, c in _features(span, k).items())) for k in GENERATORS))
    got = made.unionByName(_labelled_by_formats(docs)).select("kind", *FEATURES, "label").collect()
    got.sort()  # rows come in any order
    kinds, x = np.array([r[0] for r in got]), np.array([[float(v) for v in r[1:]] for r in got])
    order = np.random.default_rng(5).permutation(len(got))
    kinds, x = kinds[order], x[order]
    half = len(got) // 2
    model = Boosted().fit(x[:half, :-1], x[:half, -1])
    scores, least = model.score(x[half:, :-1]), {}
    for kind, confidence in CONFIDENCE.items():
        own = kinds[half:] == kind
        a, b = platt(scores[own], x[half:, -1][own])
        least[kind] = (float(np.log(confidence / (1 - confidence))) - b) / a if a > 0 else float("inf")
    return model, least


def find_personal(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with one more column, __spans (one of that name is replaced): an array of (rank, start, end, kind, base, hit) in order of kind and start.

    Base spans are those of the formats, checked (parts of an ip, digits and Luhn sum of a card, digits of a phone).
    Generators propose more; a proposal is taken if its calibrated score allows, it touches no base span, and no
    better proposal that it touches. Offsets count code points; a null text is empty; the whole text is read, at a cost
    that follows its length.
    """
    rest = [c for c in docs.columns if c != "__spans"]  # packed, so that no name can clash with those used here
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("__row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))
    model, least = fitted(out)
    out = _candidates(out)
    base = lambda kind: F.transform(F.filter(f"__{kind}", lambda s: s["valid"]), lambda s: F.struct(F.lit(ORDER.index(kind)).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(True).alias("base"), s["hit"].alias("hit")))
    out = out.withColumn("__base", F.concat(*(base(k) for k in KINDS)))
    named = lambda k: lambda s: F.struct(s["start"].alias("start"), F.lit(ORDER.index(k)).alias("rank"), s["end"].alias("end"), F.lit(k).alias("kind"), s["hit"].alias("hit"), *(s[n].alias(n) for n in FEATURES))
    for kind in GENERATORS:
        out = out.withColumn(f"__new_{kind}", F.transform(_apart(F.col(f"__new_{kind}"), F.col("__base")), named(kind)))
    out = out.withColumn("__new", F.concat(*(f"__new_{k}" for k in GENERATORS)))
    limits = " ".join(f"WHEN {ORDER.index(k)} THEN {x!r}D" if np.isfinite(x) else f"WHEN {ORDER.index(k)} THEN double('inf')" for k, x in least.items())
    scored = f"transform(__new, s -> struct(s.start AS start, s.rank AS rank, s.end AS end, {model.sql([f's.{n}' for n in FEATURES])} AS score, s.kind AS kind, false AS base, s.hit AS hit))"
    out = out.withColumn("__more", F.expr(f"array_sort(filter({scored}, s -> s.score >= CASE s.rank {limits} END))"))
    better = lambda a, b: (a["score"] > b["score"]) | ((a["score"] == b["score"]) & (F.struct(a["start"], a["rank"]) < F.struct(b["start"], b["rank"])))
    # in order of start, what touches a span begins at most LONGEST before or after it, and so many spans of each generator at most
    near = len(GENERATORS) * 2 * LONGEST // SHORTEST
    around = lambda i: F.slice("__more", F.greatest(i + 1 - near, F.lit(1)), F.lit(2 * near + 1))
    chosen = F.filter("__more", lambda s, i: ~F.exists(around(i), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]) & better(b, s)))
    chosen = F.transform(chosen, lambda s: F.struct(*(s[c].alias(c) for c in ("rank", "start", "end", "kind", "base", "hit"))))
    return out.withColumn("__spans", F.array_sort(F.concat("__base", chosen))).select("__row.*", "__spans")


def redacted(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in brackets; what overlapping spans cover goes too, under the first one's kind."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def parts(rows):
        before = F.concat(F.array(F.lit(0)), _running(F.transform(rows, lambda r: r["end"]), F.greatest))  # where the text goes on after all spans before
        each = F.arrays_zip(rows.alias("r"), F.slice(before, F.lit(1), F.size(rows)).alias("at"))
        piece = lambda x: F.concat(F.substr(text, x["at"] + 1, F.greatest(x["r"]["start"] - x["at"], F.lit(0))), F.when(x["r"]["start"] >= x["at"], F.concat(F.lit("["), x["r"]["kind"], F.lit("]"))).otherwise(""))
        return F.concat(F.array_join(F.transform(each, piece), ""), F.substr(text, F.element_at(before, -1) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.element_at(F.transform(F.array(ordered), parts), 1)).otherwise(text)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("__spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, functools.partial(lambda k, s: s["kind"] == k, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("__spans")).alias("spans"), F.size("__spans").cast("long").alias("n_spans"))


QUERIES = {"op2_pii": op2_pii}
SQL: dict = {}
