"""Language-model scoring by prediction by partial matching over the bytes of tokens.

A text is its tokens, each followed by a space, and an end; spaces stand before it. Contexts run over the borders of
tokens. The longest context, of ADAPTIVE bytes, is the document's own: where it stood before in the same text, it
predicts the byte that followed it last. Below it lies a trie of the training texts, for contexts of ORDER bytes down to
none: which bytes followed and how often (in shorter contexts a byte counts once for each longer context it followed).
A byte unseen in a context is reached by an escape to the next shorter one, where the bytes already excluded are left
out. Escapes are estimated from the training texts: by order and by how many bytes of how many kinds a context has seen,
the share of occurrences that would be new if they were taken out; for the document's own context by how often and how
long it has been right, as counted over all training texts.

The trie is never in one place. Its orders are tables keyed by context and byte, and a code length is built from the
shortest context up: of a key's row and the row of its key one byte shorter, which at most 256 keys share.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm.common import forget, map_arrow, utf8, written

#: Bytes of the trie's longest context and of the document's own; what ends a token and stands before a text.
ORDER, ADAPTIVE, SPACE = 5, 12, 0x20
ALPHABET = 256
#: Entries of a worker's table before it is emptied; words broadcast to all workers; contexts broadcast for each of them.
FLUSH, HOT, PER_WORD = 200_000, 200_000, 10
#: Bytes of text that a worker turns into contexts at once.
CHUNK = 1_000_000
#: States of the document's own context: times it stood before (3 and more are one) and the binary size of its run of hits.
TIMES, RUNS = 3, 6
STATES = TIMES * RUNS
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 1


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, A-Z lower-cased; bytes.split() splits at exactly space and U+0009 to U+000D."""
    return text.lower().split()


def _counts(batches):
    """Partial (word, n) of every word, n rows of it in training documents; b'' stands for the texts' ends."""
    trained: Counter = Counter()
    others: set[bytes] = set()

    def out():
        others.difference_update(trained)
        words = [*trained, *others]
        n = np.zeros(len(words), np.int64)
        n[: len(trained)] = list(trained.values())
        trained.clear()
        others.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n)], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            if held_out(doc_id):
                others.update(tokens(text))
                others.add(b"")
            else:
                trained.update(tokens(text))
                trained[b""] += 1
        if len(trained) + len(others) > FLUSH:
            yield out()
    if trained or others:
        yield out()


def _stream(words: list[bytes]) -> bytes:
    """A text's tokens as the model reads them."""
    return b" ".join([*words, b"\n"])


class Positions:
    """Every byte of some streams: key (its ORDER bytes of context and itself as one number), the number of its stream and,
    where the ADAPTIVE bytes before it stood earlier in the stream, the byte that followed them last and the state."""

    def __init__(self, streams: list[bytes], adaptive: bool = True):
        before = bytes([SPACE]) * ADAPTIVE
        sizes = np.array([len(x) for x in streams], np.int64)
        joined = before + before.join(streams)
        n = len(joined) - ADAPTIVE  # the window of eight bytes that ends at place p begins at p - 7
        windows = np.ndarray((len(joined) - 7,), ">i8", joined, 0, (1,)).astype(np.int64)
        starts = np.cumsum(sizes + ADAPTIVE) - (sizes + ADAPTIVE)
        own = np.ones(n, bool)  # places from the first stream's first byte on, less the spaces before the others
        for k in range(ADAPTIVE):
            own[starts[1:] - 1 - k] = False
        self.owner = np.repeat(np.arange(len(streams)), sizes)
        self.key = (windows[ADAPTIVE - 7 :] & ((1 << 8 * (ORDER + 1)) - 1))[own]
        if adaptive:
            h = windows[ADAPTIVE - 8 : -1].view(np.uint64) * _M1
            h ^= h >> np.uint64(32)
            h += windows[:n].view(np.uint64)
            h *= _M2
            h ^= h >> np.uint64(29)
            h = h[own]
            h += self.owner.astype(np.uint64)
            h *= _M3
            self._look_back(h)

    def _look_back(self, context: np.ndarray) -> None:
        n = len(context)
        bits = np.uint64(max(1, n.bit_length()))
        low = (np.uint64(1) << bits) - np.uint64(1)
        ranked = np.sort((context & ~low) | np.arange(n, dtype=np.uint64))  # contexts by their high bits, in order of place
        order = (ranked & low).astype(np.int64)
        again = np.zeros(n, bool)
        again[1:] = (ranked[1:] ^ ranked[:-1]) <= low
        later = np.flatnonzero(again)
        if (context[order[later]] != context[order[later - 1]]).any():  # high bits that different contexts share
            order = np.argsort(context, kind="stable")
            again[1:] = context[order[1:]] == context[order[:-1]]
            later = np.flatnonzero(again)
        at, last = order[later], order[later - 1]
        byte = (self.key & 0xFF).astype(np.uint8)
        self.met = np.zeros(n, bool)
        self.met[at] = True
        self.guess = np.zeros(n, np.uint8)
        self.guess[at] = byte[last]
        self.hit = self.met & (self.guess == byte)
        # how often the context stood before: its place in its run of equal ones
        rank = np.arange(len(later))
        begins = np.diff(later, prepend=-2) > 1
        times = np.empty(n, np.int8)
        times[at] = np.minimum(rank - np.maximum.accumulate(np.where(begins, rank, 0)), TIMES - 1)
        # hits in a row just before, within the text: a text's first byte has no context that stood before
        places = np.flatnonzero(self.met)
        missed = np.flatnonzero(~self.hit)
        run = places - 1 - missed[np.searchsorted(missed, places) - 1]
        size = np.minimum(np.frexp(run + 1.0)[1] - 1, RUNS - 1)
        #: of the places that the context told anything about, in order: their states
        self.state = times[places] * RUNS + size


def _chunks(texts):
    """(first, words of each text) of runs of texts with about CHUNK bytes."""
    own: list[list[bytes]] = []
    first = held = 0
    for i, text in enumerate(texts):
        own.append(tokens(text))
        held += len(text)
        if held > CHUNK:
            yield first, own
            own, first, held = [], i + 1, 0
    if own:
        yield first, own


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, inverse = np.unique(keys, return_inverse=True)
    return found, np.bincount(inverse, n, len(found)).astype(np.int64)


def _contexts(batches):
    """Partial (key, n) of the texts' bytes in their contexts, n of them in training documents."""
    table: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out():
        keys, n = _summed(*(np.concatenate(c) for c in zip(*table, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    for batch in batches:
        use = np.array([not held_out(i) for i in batch.column(0).to_pylist()], bool)
        for first, words in _chunks(utf8(batch.column(1))):
            for train in (True, False):
                own = [_stream(x) for x, u in zip(words, use[first : first + len(words)], strict=True) if u == train]
                if not own:
                    continue
                keys = np.sort(Positions(own, adaptive=False).key)
                at = np.flatnonzero(np.diff(keys, prepend=-1))
                table.append((keys[at], np.diff(at, append=len(keys)) * train))
                size += len(at)
            if size > PER_WORD * FLUSH:
                yield out()
                table.clear()
                size = 0
    if table:
        yield out()


def _shorter(key: str, order: Column) -> Column:
    """A key of the byte and its context, less the context's bytes beyond `order`."""
    return F.col(key).bitwiseAND(F.element_at(F.array(*(F.lit((1 << 8 * (k + 1)) - 1) for k in range(ORDER + 1))), order + 1))


def _orders(keys: DataFrame, last: int) -> DataFrame:
    """keys with a row for each order from 0 to `last`."""
    return keys.withColumn("order", F.explode(F.array(*map(F.lit, range(last + 1)))))


def _octave(n: Column) -> Column:
    """Half octaves of a count: few classes at any size."""
    return F.floor(F.log2(F.greatest(n, F.lit(1))) * 2).cast("int")


def escapes(contexts: DataFrame) -> DataFrame:
    """(order, t, k, fresh_n, all_n) from contexts (order, t, k, s): at most some hundreds of classes an order.

    A context of T + 1 occurrences of K kinds is, less any one of them, one of T: the occurrence taken out is new to it
    if it was the only one of its kind (s of them are; then K - 1 kinds are left).
    """
    own = contexts.where("t > 1")
    left = _octave(F.col("t") - 1).alias("t")
    one = own.select("order", left, _octave(F.col("k") - 1).alias("k"), F.col("s").alias("fresh_n"), F.lit(0).alias("old_n"))
    two = own.select("order", left, _octave(F.col("k")).alias("k"), F.lit(0).alias("fresh_n"), (F.col("t") - F.col("s")).alias("old_n"))
    return one.unionByName(two).groupBy("order", "t", "k").agg(F.sum("fresh_n").cast("double").alias("fresh_n"), F.sum(F.col("fresh_n") + F.col("old_n")).cast("double").alias("all_n"))


def _with_escape(contexts: DataFrame, rates: DataFrame, order: Column, total: str, kinds: str, name: str) -> DataFrame:
    """contexts with a column for the chance of an escape, given a total and kinds in an order.

    By class of both: occurrences that would be new if they were taken out, of all; two more occurrences stand for
    method C, so that rare classes have it.
    """
    rates = F.broadcast(rates.select(F.col("order").alias("__o"), F.col("t").alias("__t"), F.col("k").alias("__k"), "fresh_n", "all_n"))
    joined = contexts.withColumns({"__o": order, "__t": _octave(F.col(total)), "__k": _octave(F.col(kinds))}).join(rates, ["__o", "__t", "__k"], "left")
    plain = F.coalesce(F.try_divide(F.col(kinds), F.col(total) + F.col(kinds)), F.lit(0.0))
    e = (F.coalesce("fresh_n", F.lit(0.0)) + 2 * plain) / (F.coalesce("all_n", F.lit(0.0)) + 2)
    return joined.withColumn(name, F.least(F.greatest(e, F.lit(1e-6)), F.lit(1 - 1e-6))).drop("__o", "__t", "__k", "fresh_n", "all_n")


def trie(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bytes (order, key, n) and the contexts (order, c, t, k, e, left, fresh, m) of training counts (key, n).

    t and k: occurrences and kinds; e: chance of an escape. left and fresh: occurrences and kinds that the context one
    byte shorter has besides them; m: the chance of an escape there. All orders are in one table each; a row is joined
    by those of keys one byte longer, at most 256 of them.
    """
    used = counts.where("n > 0").select("key", "n")
    longer = _orders(used.select("key"), ORDER - 1)
    longer = longer.select("order", _shorter("key", F.col("order") + 1).alias("key")).distinct()
    shorter = longer.groupBy("order", _shorter("key", F.col("order")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    bytes_ = written(used.select(F.lit(ORDER).alias("order"), "key", "n").unionByName(shorter), "bytes")
    up = bytes_.select((F.col("order") + 1).alias("order"), F.col("key").alias("__s"), F.col("n").alias("__n"))
    own = bytes_.withColumns({"c": F.shiftright("key", 8), "__s": F.when(F.col("order") > 0, _shorter("key", F.greatest(F.col("order") - 1, F.lit(0))))})
    sums = own.join(up, ["order", "__s"], "left").groupBy("order", "c").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"), F.count_if(F.col("n") == 1).alias("s"), F.sum("__n").alias("gone"))
    sums = written(sums, "sums")
    rates = escapes(sums)
    parent = sums.select((F.col("order") + 1).alias("order"), F.col("c").alias("__u"), F.col("t").alias("__t0"), F.col("k").alias("__k0"))
    # of a context of `order` bytes, all but the first: a mask of order - 1 bytes
    last = F.when(F.col("order") > 1, _shorter("c", F.greatest(F.col("order") - 2, F.lit(0)))).when(F.col("order") == 1, F.lit(0).cast("long"))
    now = sums.withColumn("__u", last).join(parent, ["order", "__u"], "left")
    now = now.withColumns({"left": F.col("__t0") - F.col("gone"), "fresh": F.col("__k0") - F.col("k")})
    now = _with_escape(now, rates, F.col("order"), "t", "k", "e")
    now = _with_escape(now, rates, F.col("order") - 1, "left", "fresh", "m")
    contexts = written(now.select("order", "c", "t", "k", "e", "left", "fresh", "m"), "trie")
    forget(sums)
    return bytes_, contexts


def score_keys(counts: DataFrame) -> DataFrame:
    """(key, n, score): log10 probability of each key's byte in its context, by the trie of the training counts (key, n).

    Keys in the trie are settled by its longest context. The others go down by distinct suffixes, and up again with two
    values each: `met`, the score where the context is the longest met, and `escaped`, that where it was escaped from.
    """
    bytes_, contexts = trie(counts)
    log = F.log10
    known = counts.where("n > 0").withColumn("c", F.shiftright("key", 8)).join(contexts.where(F.col("order") == ORDER), "c")
    known = known.select("key", "n", (log(1 - F.col("e")) + log(F.col("n") / F.col("t"))).alias("score"))
    wanted = _orders(counts.where("n = 0").select("key"), ORDER).select("order", _shorter("key", F.col("order")).alias("key")).distinct()
    local = wanted.join(bytes_, ["order", "key"], "left").withColumn("c", F.shiftright("key", 8)).join(contexts, ["order", "c"], "left")
    local = written(local, "wanted")
    seen = log(1 - F.col("e")) + log(F.col("n") / F.col("t"))
    below = None
    for order in range(ORDER + 1):
        rows = local.where(F.col("order") == order)
        if below is None:  # under the shortest context all bytes that it lacks are alike
            escaped, unmet = -log(F.greatest(F.lit(ALPHABET) - F.coalesce("k", F.lit(0)), F.lit(1))), F.lit(-float(np.log10(ALPHABET)))
        else:
            under = below.select(F.col("key").alias("__s"), F.col("n").alias("__n"), F.col("met").alias("__met"), F.col("escaped").alias("__escaped"))
            # those of up to one byte of context are at most 65,536 whatever the input
            rows = rows.withColumn("__s", _shorter("key", F.lit(order - 1))).join(F.broadcast(under) if order < 3 else under, "__s")
            lower = F.when(F.col("__n").isNotNull(), log(1 - F.col("m")) + log(F.try_divide("__n", "left"))).otherwise(log("m") + F.col("__escaped"))
            escaped, unmet = F.when(F.col("fresh") > 0, lower).otherwise(F.col("__escaped")), F.col("__met")
        rows = rows.withColumn("escaped", escaped)
        met = F.when(F.col("t").isNull(), unmet).when(F.col("n").isNotNull(), seen).otherwise(log("e") + F.col("escaped"))
        below = rows.select("key", "n", met.alias("met"), "escaped")
    out = written(known.unionByName(below.select("key", F.lit(0).cast("long").alias("n"), F.col("met").alias("score"))), "scores")
    forget(bytes_, contexts, local)
    return out


def _frequent(counted: DataFrame, most: int) -> int:
    """The least length of n in bits for which at most `most` rows of counted (magnitude) have so many or more."""
    least, held = 99, 0
    for magnitude, n in counted.groupBy("magnitude").count().orderBy(F.desc("magnitude")).collect():  # 64 rows at most
        if held + n > most:
            break
        least, held = magnitude, held + n
    return least


def _documents(hot, hot_keys):
    """A row per document, with the sums over its broadcast words and contexts and the counts of its own context's states,
    and a row for each other word or context of it."""
    names = ["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score", "tries", "hits", "word", "key", "guess"]

    def score(batches):
        (known, seen, bases), (keys, scores) = hot.value, hot_keys.value
        seen, bases, scores = (np.append(x, 0) for x in (seen, bases, scores))  # the last one stands for what isn't there

        def looked_up(owner: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """owner, key and number in keys (or -1) of the wanted keys, in order of keys: sorted lookups stay in the processor's cache."""
            if not len(wanted):
                return owner, wanted, owner
            both = np.sort((wanted << 15) | owner) if owner[-1] < 1 << 15 else None
            if both is None:  # more texts than fit beside a key
                order = np.argsort(wanted)
                owner, wanted = owner[order], wanted[order]
            else:
                owner, wanted = both & ((1 << 15) - 1), both >> 15
            first = np.flatnonzero(np.diff(wanted, prepend=-1))
            near = np.minimum(np.searchsorted(keys, wanted[first]), max(len(keys) - 1, 0))
            near = np.where(keys[near] == wanted[first], near, -1) if len(keys) else np.full(len(first), -1)
            return owner, wanted, np.repeat(near, np.diff(first, append=len(wanted)))

        for batch in batches:
            longs = pa.list_(pa.int64())
            kinds = [pa.int64(), batch.schema.field(1).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), longs, longs, pa.binary(), pa.int64(), pa.bool_()]

            def rows(n: int, kinds=kinds, **columns):
                return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names=names)

            numbers, ids = batch.column(0).to_numpy(), batch.column(1)
            for first, words in _chunks(utf8(batch.column(2))):
                n = len(words)
                row = numbers[first : first + n]
                at = Positions([_stream(x) for x in words])
                cells = at.owner[at.met] * STATES + at.state
                tries, hits = (np.bincount(x, minlength=n * STATES).reshape(n, STATES) for x in (cells, cells[at.hit[at.met]]))
                # what the document's own context didn't tell is read from the trie, less the byte that it told wrongly
                sums = np.zeros(n)
                wrong = at.met & ~at.hit
                for guess, owner, wanted in ((False, at.owner[~at.hit], at.key[~at.hit]), (True, at.owner[wrong], (at.key[wrong] & ~0xFF) | at.guess[wrong])):
                    owner, wanted, found = looked_up(owner, wanted)
                    value = scores[found]
                    if guess:
                        value = np.where(found < 0, 0.0, -np.log10(np.maximum(1 - 10**value, 1e-9)))
                    sums += np.bincount(owner, value, n)
                    if (rare := found < 0).any():
                        yield rows(int(rare.sum()), row=row[owner[rare]], key=wanted[rare], guess=np.full(int(rare.sum()), guess))
                sizes = np.array([len(x) + 1 for x in words], np.int64)
                flat = [w for own in words for w in (*own, b"")]
                owner = np.repeat(np.arange(n), sizes)
                found = np.fromiter(map(known.get, flat, repeat(-1)), np.int64, len(flat))
                if (rare := np.flatnonzero(found < 0)).size:
                    yield rows(len(rare), row=row[owner[rare]], word=[flat[i] for i in rare.tolist()])
                own = ids.slice(first, n)
                yield rows(n, row=row, id=own, held_out=[held_out(i) for i in own.to_pylist()], n_tokens=sizes, n_known=np.bincount(owner, seen[found], n).astype(np.int64), base_score=np.bincount(owner, bases[found], n), score=sums, tries=list(tries), hits=list(hits))

    return score


def score_documents(docs: DataFrame, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training documents are those whose crc32(id as text) mod 5 is not 1 (a null id: the text None). Each text is its
    words and one end; a null text is empty. base_score is the unigram score of the contract, score that of the model;
    both are sums of log10 probabilities. The most frequent words, at most `hot` of them, and the most
    frequent contexts, PER_WORD times as many, are broadcast with their scores; the others are joined by shuffle, and
    no such word or context is in more than a small share of the rows.
    """
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    counted = map_arrow(picked, _counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = written(counted, "vocabulary")
    total, kinds = counted.agg(F.sum("n"), F.sum((F.col("n") > 0).cast("long"))).first()
    total, kinds = total or 0, kinds or 0
    base = lambda c: F.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
    magnitude = F.length(F.bin("n")).alias("magnitude")
    words = counted.select("word", (F.col("n") > 0).cast("long").alias("seen"), base(F.col("n")).alias("base"), magnitude)
    least = _frequent(words, hot)
    got = words.where(F.col("magnitude") >= least).select("word", "seen", "base").toArrow()
    table = {word: i for i, word in enumerate(got.column(0).to_pylist())}
    table = docs.sparkSession.sparkContext.broadcast((table, got.column(1).to_numpy(), got.column(2).to_numpy()))
    contexts = written(map_arrow(picked, _contexts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "contexts")
    contexts = score_keys(contexts).select("key", "score", magnitude)
    least_key = _frequent(contexts, PER_WORD * hot)
    got = contexts.where(F.col("magnitude") >= least_key).select("key", "score").toArrow()
    order = np.argsort(got.column(0).to_numpy())
    hot_keys = docs.sparkSession.sparkContext.broadcast((got.column(0).to_numpy()[order], got.column(1).to_numpy()[order]))
    numbered = picked.withColumn("row", F.monotonically_increasing_id())
    schema = f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, tries array<long>, hits array<long>, word binary, key long, guess boolean"
    parts = written(map_arrow(numbered.select("row", "id", "text"), _documents(table, hot_keys), schema), "parts")
    rare = words.where(F.col("magnitude") < least).select("word", "seen", "base")
    rest = parts.where("word IS NOT NULL").select("row", "word").join(rare, "word")
    rest = rest.groupBy("row").agg(F.sum("seen").alias("k"), F.sum("base").alias("b"))
    rare_keys = contexts.where(F.col("magnitude") < least_key).select("key", F.col("score").alias("bits"))
    bits = F.when(F.col("guess"), -F.log10(F.greatest(1 - F.pow(F.lit(10.0), F.col("bits")), F.lit(1e-9)))).otherwise(F.col("bits"))
    more = parts.where("key IS NOT NULL").select("row", "key", "guess").join(rare_keys, "key").groupBy("row").agg(F.sum(bits).alias("s"))
    whole = parts.where("tries IS NOT NULL").drop("word", "key", "guess")
    # over all training texts: how often the document's own context is wrong in each of its states
    each = [F.sum(F.col(c)[i]) for c in ("tries", "hits") for i in range(STATES)]
    sums = [x or 0 for x in whole.where("NOT held_out").agg(*each).first()]
    escape = [(t - h + 0.5) / (t + 1) for t, h in zip(sums[:STATES], sums[STATES:], strict=True)]
    own = sum((F.col("hits")[i] * float(np.log10(1 - e)) + (F.col("tries")[i] - F.col("hits")[i]) * float(np.log10(e)) for i, e in enumerate(escape)), F.lit(0.0))
    whole = whole.withColumn("score", F.col("score") + own).drop("tries", "hits").join(rest, "row", "left").join(more, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return whole.select("id", "held_out", "n_tokens", plus("n_known", "k"), F.lit(total).cast("long").alias("train_tokens"), plus("base_score", "b"), plus("score", "s"))


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


QUERIES = {"op10_ppm": op10_ppm}
SQL: dict = {}
