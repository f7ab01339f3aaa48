"""Toxicity by a weighted grammar over clauses, its words learned from labelled documents.

Words become symbols: insults (stems, each with a weight), threats, targets, negations and words of reported speech. Three
transducers rewrite a clause's symbols: an insult or threat in the scope of a negation is denied, one after a word of
saying is reported, one near a target is aimed. Composed into one automaton, they give a clause the weight of its best
path, so a word counts by the clause that it stands in. Boosted trees turn what a document's clauses have matched into a
calibrated probability.
"""

from __future__ import annotations

import functools
import re
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm.boosting import Boosted, platt
from rillmark.llm.common import map_arrow, written

#: Words of the fixed classes, in the corpus's languages; fixed values. Insults here have the weight SEED until labels say more.
INSULTS = "idiot moron stupid loser scum trash clown worthless pathetic disgusting idiota imbécile imbécil estúpido stupide dummkopf abschaum".split()
THREATS = "kill hurt destroy beat burn shoot stab crush strangle punch töten schlagen vernichten tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours yourself u he him she her they them their people everyone du dich dir euch ihr sie tu te toi vous tú usted ustedes vosotros".split()
NEGATIONS = "not no never none cannot don't isn't aren't won't wasn't nicht kein keine nie jamais pas non nunca ni".split()
REPORTS = "said says say told tells wrote writes claimed claims reported quoted called sagte sagt schrieb dit écrit affirme dijo dice escribió".split()
#: Symbols, and what transducers write: o other, i insult, t threat, y target, n negation, r report; d denied, q reported, a aimed.
SEED = 3.0
#: Shares of a hit's weight that count, by what the clause makes of it.
FACTORS = {"i": 1.0, "t": 0.2, "d": 0.5, "q": 0.6, "a": 1.3}
#: Words that a negation reaches, and words between a hit and its target at most.
SCOPE, NEAR = 2, 3
#: Stems have STEMS characters, or are whole words; most of them in the lexicon; least documents that support one, least log
#: ratio of its rates in toxic and other documents, and least ratio of that to its standard error.
STEMS, LEXICON, SUPPORT, RATIO, SURE = range(3, 9), 5000, 4, 1.5, 3.0
#: Labelled rows that are learned from, at most, of each label; parts of them, each scored by the lexicon of the others.
SAMPLE, FOLDS = {1: 4000, 0: 8000}, 5
THRESHOLD = 0.7
#: Characters of a text that are read at once.
PART = 1 << 20
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n]")
FEATURES = ["total", "rate", "best", "matched", "words", "plain", "aimed", "denied", "reported", "stems", "per_word"]


class Transducer:
    """arcs: (state, symbol) -> [(next state, written symbol)]; ends: states in which a clause may end. Start is state 0."""

    def __init__(self, arcs: dict, ends: set):
        self.arcs, self.ends = arcs, ends

    def compose(self, after: Transducer) -> Transducer:
        """What `after` makes of what this one writes; states are pairs, those reached from the start."""
        number, todo, arcs, ends = {(0, 0): 0}, [(0, 0)], {}, set()
        symbols = sorted({s for _, s in self.arcs})
        while todo:
            pair = todo.pop()
            if pair[0] in self.ends and pair[1] in after.ends:
                ends.add(number[pair])
            for symbol in symbols:
                for left, written_ in self.arcs.get((pair[0], symbol), ()):
                    for right, last in after.arcs.get((pair[1], written_), ()):
                        if (left, right) not in number:
                            number[left, right] = len(number)
                            todo.append((left, right))
                        arcs.setdefault((number[pair], symbol), []).append((number[left, right], last))
        return Transducer(arcs, ends)


def negation(scope: int = SCOPE) -> Transducer:
    """State: words that a negation still reaches."""
    arcs = {}
    for state in range(scope + 1):
        for symbol in "oityr":
            arcs[state, symbol] = [(max(state - 1, 0), "d" if state and symbol in "it" else symbol)]
        arcs[state, "n"] = [(scope, "o")]
    return Transducer(arcs, set(range(scope + 1)))


def reported() -> Transducer:
    """State 1: the clause's speaker reports what follows."""
    arcs = {(state, s): [(state, "q" if state and s in "itd" else s)] for state in (0, 1) for s in "oityd"}
    return Transducer(arcs | {(state, "r"): [(1, "o")] for state in (0, 1)}, {0, 1})


def aimed(near: int = NEAR) -> Transducer:
    """A hit is aimed if a target stands at most `near` words before it, or after it: then the path waits for it, and ends
    nowhere before it has come. States: 0; 1..near, words since a target; near+1.., words that a target may still come in."""
    arcs: dict = {}
    seen, wait = lambda k: k, lambda k: near + k
    for k in range(near + 1):
        on = 0 if k in (0, near) else seen(k + 1)
        for s in "odq":
            arcs[seen(k), s] = [(on, s)]
        arcs[seen(k), "y"] = [(seen(1), "o")]
        for s in "it":
            arcs[seen(k), s] = [(on, "a" if k else s)] + ([] if k else [(wait(near), "a")])
    for k in range(1, near + 1):
        for s in "odqit":
            arcs[wait(k), s] = [(wait(k - 1), "a" if s in "it" else s)] if k > 1 else []
        arcs[wait(k), "y"] = [(seen(1), "o")]
    return Transducer(arcs, set(range(near + 1)))


@functools.cache
def grammar() -> Transducer:
    return negation().compose(reported()).compose(aimed())


def clause_score(symbols: str, weights: list[float]) -> tuple[float, str]:
    """Weight of the best path over a clause, and what it writes. weights: of its symbols, 0 where none."""
    machine, paths = grammar(), {0: (0.0, "")}
    for symbol, weight in zip(symbols, weights, strict=True):
        then: dict = {}
        for state, (total, line) in paths.items():
            for on, out in machine.arcs.get((state, symbol), ()):
                new = total + FACTORS.get(out, 0.0) * weight
                if on not in then or new > then[on][0]:
                    then[on] = (new, line + out)
        paths = then
    return max((path for state, path in paths.items() if state in machine.ends), key=lambda p: p[0])


def _parts(text: str):
    """text in parts of about PART characters, cut at blanks where there are any."""
    start = 0
    while start < len(text):
        end = start + PART
        if end < len(text):
            end = max(text.rfind(" ", start, end), text.rfind("\n", start, end)) + 1 or end
        yield text[start : max(end, start + 1)]
        start = max(end, start + 1)


class Words:
    """Symbols and weights of words; a stem is written as it is, a whole word with $ at its end."""

    def __init__(self, stems: dict[str, float]):
        self.stems, self.known = stems, {}
        self.fixed = {w: (s, SEED if s == "t" else 0.0) for s, words in (("t", THREATS), ("y", TARGETS), ("n", NEGATIONS), ("r", REPORTS)) for w in words}

    def symbol(self, word: str) -> tuple[str, float, str]:
        if (got := self.known.get(word)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            weight, stem = max(((self.stems[s], s) for s in (f"{word}$", *(word[:k] for k in STEMS if k <= len(word))) if s in self.stems), default=(0.0, ""))
            got = ("i", weight, stem) if stem else (*self.fixed.get(word, ("o", 0.0)), "")
            self.known[word] = got
        return got

    def features(self, text: str) -> list[float]:
        total = best = 0.0
        matched = words = 0
        kinds, stems = dict.fromkeys("iadq", 0), set()
        for part in _parts(text):
            for ends, clause in groupby(TOKEN.findall(part.lower()), lambda t: t in ".!?;:\n"):
                if ends:
                    continue
                found = [self.symbol(w) for w in clause]
                words += len(found)
                hits = [k for k, f in enumerate(found) if f[0] in "it"]
                if not hits:
                    continue
                # what lies further from the hits than any transducer looks is not read; but a report reaches to the end
                first = next((k for k, f in enumerate(found) if f[0] == "r"), len(found))
                clear = max(0, hits[0] - SCOPE - NEAR)
                own = ([found[first]] if first < clear else []) + found[clear : hits[-1] + NEAR + 1]
                score, line = clause_score("".join(f[0] for f in own), [f[1] for f in own])
                total, best, matched = total + score, max(best, score), matched + 1
                for kind in kinds:
                    kinds[kind] += line.count(kind)
                stems.update(f[2] for f in own if f[2])
        hits = sum(kinds.values())
        return [total, 100 * total / (words + 20), best, float(matched), float(np.log1p(words)), *(float(kinds[k]) for k in "iadq"), float(len(stems)), 100 * hits / (words + 20)]


class _Counted:
    """(fold, feature, label, documents, occurrences) of stems and words in the sample, and under the empty feature its words."""

    def __call__(self, batches):
        for batch in batches:
            counts: dict = {}
            for fold, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own: dict = {}
                for part in _parts(text or ""):
                    for word in TOKEN.findall(part.lower()):
                        if word not in ".!?;:\n":
                            for stem in ("", f"{word}$", *(word[:k] for k in STEMS if k <= len(word))):
                                own[stem] = own.get(stem, 0) + 1
                for stem, n in own.items():
                    docs, all_ = counts.get((fold, stem, label), (0, 0))
                    counts[fold, stem, label] = docs + 1, all_ + n
            keys = list(counts)
            columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int32()))] + [pa.array([counts[k][i] for k in keys], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["fold", "stem", "label", "docs", "n"])


class _Sketched:
    """(fold, label, text, sketch): fold by the text; near copies have most likely the same sketch, the least hash of five words."""

    def __call__(self, batches):
        for batch in batches:
            sketches = []
            for text in batch.column(1).to_pylist():
                least = 2**64
                for part in _parts(text or ""):
                    words = TOKEN.findall(part.lower())
                    least = min([least, *(hash5(words[k : k + 5]) for k in range(max(1, len(words) - 4)))])
                sketches.append(least % 2**63)
            sketch = pa.array(sketches, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([s % FOLDS for s in sketches], pa.int32()), batch.column(0), batch.column(1), sketch], names=["fold", "label", "text", "sketch"])


def hash5(words: list[str]) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(" ".join(words))


class _Features:
    def __init__(self, lexicons: list[dict[str, float]]):
        self.lexicons = lexicons

    def __call__(self, batches):
        words = [Words(stems) for stems in self.lexicons]
        for batch in batches:
            rows = [words[fold].features(text or "") for fold, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["label", "features"])


class Model:
    """Lexicon, trees, and a, b of the probability."""

    def __init__(self, stems: dict[str, float], trees: Boosted | None, a: float, b: float):
        self.stems, self.trees, self.a, self.b = stems, trees, a, b

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        # without labels to learn from, the grammar's rate decides
        raw = self.trees.score(x) if self.trees else x[:, FEATURES.index("rate")] - 2
        return 1 / (1 + np.exp(-np.clip(self.a * raw + self.b, -500, 500)))


class _Scored:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches):
        words = Words(self.model.stems)
        for batch in batches:
            x = np.array([words.features(text or "") for text in batch.column(2).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(self.model.probabilities(x), pa.float64())], names=["id", "mark", "score"])


def lexicon(rows: list, words: dict[int, float]) -> dict[str, float]:
    """Weights of stems. rows: (stem, toxic documents, toxic occurrences, other documents, other occurrences).

    Of stems that begin alike, the one that tells most stays: by the documents that have it, beyond what others' share
    would give. Its weight is the log ratio of its rates in the words of toxic and of other documents, 6 at most.
    """
    weight = {s: float(np.log((n1 + 0.5) / (words[1] + 1)) - np.log((n0 + 0.5) / (words[0] + 1))) for s, _, n1, _, n0 in rows}
    sure = lambda n1, n0: SURE * (1 / (n1 + 0.5) + 1 / (n0 + 0.5)) ** 0.5
    good = [(d1 * min(weight[s], 6.0), len(s), s) for s, d1, n1, _, n0 in rows if d1 >= SUPPORT and weight[s] >= max(RATIO, sure(n1, n0))]
    kept: dict[str, float] = {w + "$": SEED for w in INSULTS}
    begun: set[str] = set()
    for _, _, s in sorted(good, reverse=True):
        stem = s.rstrip("$")
        if any(stem[:k] in kept for k in STEMS) or stem in begun:  # a shorter or longer one says it better
            continue
        kept[s] = min(weight[s], 6.0)
        begun.update(stem[:k] for k in range(1, len(stem) + 1))
    return kept


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of labels (id, label) and docs (id, text). At most SAMPLE rows of each label are learned from.

    The lexicon that scores a sampled document for the trees comes from the other parts of the sample, so that the
    trees see stems at their worth for unseen documents.
    """
    known = labels.where("label IN (0, 1)").groupBy("id").agg(F.max("label").cast("int").alias("label"))
    share = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = functools.reduce(DataFrame.unionByName, (known.where(F.col("label") == k).orderBy(F.xxhash64("id", F.lit(11)), "id").limit(n) for k, n in SAMPLE.items()))
    picked = written(picked, "toxic-labels")
    some = docs.join(F.broadcast(picked), "id").select("label", "text").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    some = map_arrow(some, _Sketched(), "fold int, label int, text string, sketch long")
    some = written(some.groupBy("sketch").agg(F.max(F.struct("label", "fold", "text")).alias("x")).select("x.fold", "x.label", "x.text"), "toxic-sample")
    counts = map_arrow(some, _Counted(), "fold int, stem string, label int, docs long, n long")
    folds = range(FOLDS)
    of = lambda c, label, fold: F.sum(F.when((F.col("label") == label) & (F.col("fold") == fold), F.col(c)).otherwise(0)).alias(f"{c}{label}{fold}")
    counts = counts.groupBy("stem").agg(*(of(c, label, fold) for label in (1, 0) for c in ("docs", "n") for fold in folds))
    over = lambda name: functools.reduce(lambda p, q: p + q, (F.col(f"{name}{fold}") for fold in folds))
    counts = written(counts.where((over("docs1") >= SUPPORT) | (F.col("stem") == "")), "toxic-stems")
    words = {(label, fold): float(r[f"n{label}{fold}"]) for r in counts.where("stem = ''").collect() for label in (1, 0) for fold in folds}
    if not words or not all(sum(words[label, fold] for fold in folds) for label in (1, 0)):
        return Model({w + "$": SEED for w in INSULTS}, None, 1.0, 0.0)
    least = float(np.exp(RATIO)) * sum(words[1, f] for f in folds) / sum(words[0, f] for f in folds) / 4  # a part may have a higher ratio
    ratio = (over("n1") + 0.5) / (over("n0") + 0.5)
    rows = counts.where((F.col("stem") != "") & (ratio >= least)).orderBy(F.desc(over("docs1") * F.log(ratio / least + 1)), "stem").limit(8 * LEXICON).collect()

    def own(*taken: int) -> dict[str, float]:
        all_ = lambda r, c: sum(r[f"{c}{f}"] for f in taken)
        found = lexicon([(r["stem"], all_(r, "docs1"), all_(r, "n1"), all_(r, "docs0"), all_(r, "n0")) for r in rows], {k: sum(words[k, f] for f in taken) for k in (0, 1)})
        return dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])

    got = map_arrow(some, _Features([own(*(f for f in folds if f != fold)) for fold in folds]), "label int, features array<double>").collect()
    got = sorted((r["label"], *r["features"]) for r in got)
    y, x = np.array([r[0] for r in got], float), np.array([r[1:] for r in got], float)
    if min((y == 1).sum(), (y == 0).sum()) < 2 * SUPPORT:
        return Model(own(*folds), None, 1.0, 0.0)
    trees = Boosted(trees=60, leaf=max(2, min(10, int(y.sum()) // 10))).fit(x, y)
    a, b = platt(trees.score(x), y)
    shift = np.log(share[1] / share[0]) - np.log(y.sum() / (len(y) - y.sum()))  # from the sample's share to the labels'
    return Model(own(*folds), trees, a, b + float(shift))


def score_toxicity(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id: str = "doc_id") -> DataFrame:
    """(id, mark, score) for each row of docs: the probability that it is toxic; mark is `learn` of its id.

    learn: an expression of an id; labels of ids for which it holds are learned from, others never read. A null or
    empty text scores as one without hits. Labels other than 0 and 1 count as none; an id labelled twice is toxic if one label
    says so; repeated rows score alike. Without labels of both kinds a fixed lexicon and the grammar's rate decide.
    Columns other than those named are not read.
    """
    id_ = F.col(f"`{id_col}`")
    picked = docs.select(id_.alias("id"), learn(id_).alias("mark"), F.col(f"`{text_col}`").cast("string").alias("text"))
    own = F.col(f"`{label_id}`")
    told = labels.where(learn(own)).select(own.alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    model = fitted(picked.where("mark").select("id", "text"), told)
    return map_arrow(picked, _Scored(model), f"id {docs.schema[id_col].dataType.simpleString()}, mark boolean, score double")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    learn = lambda id_: F.coalesce(F.crc32(id_.cast("string").cast("binary")), F.lit(0)) % 3 != 1
    out = score_toxicity(read("documents"), read("labels"), learn)
    return out.select(F.col("id").alias("doc_id"), (~F.col("mark")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op11_toxicity": op11_toxicity}
SQL: dict = {}
