"""N-gram Jaccard join: MinHash candidates, pruned by the posterior of reaching the threshold, the rest verified exactly."""

from __future__ import annotations

import hashlib
import math
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillmark.llm.common import bucketed, group_winner, keep_rows, map_arrow, mark, small, utf8, written
from rillmark.llm.components import components

#: Words of a shingle and the least similarity of a link.
GRAM, THRESHOLD = 5, 0.8
#: A pair is a candidate if all ROWS MinHash values of one of BANDS bands agree: 0.06 % of pairs at 0.8 are not.
BANDS, ROWS = 40, 8
#: MinHash values (their lowest bytes) that pruning compares, STEP at a time; posterior probability of reaching the threshold below which it drops a pair.
SIGNATURE, STEP, TOLERANCE = BANDS * ROWS, 32, 1e-5
#: Rows of one side that a pruning task compares at once; words whose hashes a worker keeps.
CHUNK, CACHE = 300, 150_000

_random = np.random.default_rng(20)
_A = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PLACES = _random.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(threshold: float, tolerance: float, step: int = STEP, n: int = SIGNATURE) -> dict[int, int]:
    """By values compared, the fewest matches with which a pair stays: with a uniform prior of the similarity, m matches
    of n leave a posterior P(similarity >= t) = P(Binomial(n + 1, t) <= m)."""
    out = {}
    for k in range(step, n + 1, step):
        p, m = 0.0, -1
        while p < tolerance:
            m += 1
            p += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out[k] = m
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


class _Hashes(dict):
    """64-bit hashes of words, kept by each worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def shingles(words: list[list[bytes]], gram: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of `gram` words, and how many each text has; a shorter text with a word has one of all its words."""
    sizes = np.array([len(w) for w in words], np.int64)
    n = int(sizes.sum())
    counts = np.where(sizes >= gram, sizes - gram + 1, np.minimum(sizes, 1))
    if not n:
        return np.zeros(0, np.uint64), counts
    flat = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(words)), np.uint64, n)
    padded = np.concatenate([flat, np.zeros(gram, np.uint64)])
    h = np.zeros(n, np.uint64)
    for j in range(gram):  # a sum of word hashes times an odd number for each place
        h += padded[j : n + j] * _PLACES[j]
    ends = np.cumsum(sizes)
    for i in np.flatnonzero((sizes > 0) & (sizes < gram)):  # what follows a short text isn't part of it
        own = flat[ends[i] - sizes[i] : ends[i]]
        h[ends[i] - sizes[i]] = (own * _PLACES[: len(own)]).sum(dtype=np.uint64)
    first = np.arange(n) - np.repeat(ends - sizes, sizes)
    return _mix(h[first < np.repeat(counts, sizes)]), counts


def minhashes(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of BANDS * ROWS MinHash values for each text with shingles."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    sizes = counts[counts > 0]
    out = np.full((len(sizes), BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    for own, end, n in zip(out, np.cumsum(sizes), sizes, strict=True):
        for i in range(end - n, end, 512):  # blocks that stay in the processor's cache
            np.minimum(own, (x[i : min(i + 512, end), None] * _A + _B).min(axis=0), out=own)
    return out


def _sketches(gram: int):
    def sketch(batches):
        for batch in batches:
            words = [t.lower().split() for t in utf8(batch.column(3))]
            digests = [hashlib.sha256(b" ".join(own)).digest() for own in words]
            h, counts = shingles(words, gram)
            bands, signatures = [None] * len(words), [None] * len(words)
            if (own := np.flatnonzero(counts)).size:
                values = minhashes(h, counts)
                keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _M1, (len(own), 1))
                for r in range(ROWS):
                    keys = _mix(keys * _M1 + values[:, r::ROWS].astype(np.uint64))
                keys = keys.view(np.int64)
                tail = (values[:, :SIGNATURE] & np.uint32(0xFF)).astype(np.uint8)
                for k, i in enumerate(own):
                    bands[i], signatures[i] = keys[k], tail[k].tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())], names=["row", "id", "mark", "text", "digest", "bands", "sig"])

    return sketch


def survivors(left: np.ndarray, right: np.ndarray, least: dict[int, int], x: np.ndarray | None = None, y: np.ndarray | None = None) -> np.ndarray:
    """Of pairs of signatures (rows x of left and y of right), the numbers of those that incremental comparison doesn't drop."""
    x = np.arange(len(left)) if x is None else x
    y = np.arange(len(right)) if y is None else y
    alive = np.arange(len(x))
    matches = np.zeros(len(x), np.int64)
    for k, m in least.items():
        if not alive.size:
            break
        matches = matches + (left[x[alive], k - STEP : k] == right[y[alive], k - STEP : k]).sum(axis=1)
        keep = matches >= m
        alive, matches = alive[keep], matches[keep]
    return alive


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, SIGNATURE)


def _prune(least: dict[int, int]):
    def prune(batches):
        for batch in batches:
            if batch.num_rows:
                keep = survivors(_signatures(batch.column(2).to_pylist()), _signatures(batch.column(3).to_pylist()), least)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], names=["a", "b"])

    return prune


def _verify(gram: int, threshold: float):
    def verify(batches):
        for batch in batches:
            a, b, sims = [], [], []
            left, right = ([t.lower().split() for t in utf8(batch.column(c))] for c in (2, 3))
            (h, n), (g, m) = shingles(left, gram), shingles(right, gram)
            ends, others = np.cumsum(n), np.cumsum(m)
            for i, (x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                similarity = jaccard(np.unique(h[ends[i] - n[i] : ends[i]]), np.unique(g[others[i] - m[i] : others[i]]))
                if similarity >= threshold - 1e-12:
                    a.append(x)
                    b.append(y)
                    sims.append(similarity)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])

    return verify


class _Merged:
    """Components that links found so far have merged."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            x = up
        return x

    def join(self, x: int, y: int) -> None:
        self.parent[self.find(x)] = self.find(y)


def _block_links(key: tuple, rows: list[tuple], least: dict[int, int], gram: int, threshold: float) -> list[tuple]:
    """Links between different components in one block of rows (side, rep, label, sig, text): pairs that pruning leaves are
    verified here on whole texts, unless links of the block have joined their components already. So a block returns
    fewer links than it has components."""
    one, two = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
    if key[1] < 0 and not two:  # a chunk against itself
        two = one
    out: list[tuple] = []
    if not one or not two or len({r[2] for r in rows}) < 2:
        return out
    sets: dict[int, np.ndarray] = {}

    def shingled(row: tuple) -> np.ndarray:
        if row[1] not in sets:
            sets[row[1]] = np.unique(shingles([row[4].encode().lower().split()], gram)[0])
        return sets[row[1]]

    s, t, merged = _signatures([r[3] for r in one]), _signatures([r[3] for r in two]), _Merged()
    c, d = np.array([r[2] for r in one]), np.array([r[2] for r in two])
    for i in range(0, len(one), 64):
        x, y = np.nonzero(c[i : i + 64, None] != d[None, :])
        x += i
        for k in survivors(s, t, least, x, y).tolist():
            u, v = one[x[k]], two[y[k]]
            if merged.find(u[2]) != merged.find(v[2]):
                similarity = jaccard(shingled(u), shingled(v))
                if similarity >= threshold - 1e-12:
                    merged.join(u[2], v[2])
                    out.append((min(u[1], v[1]), max(u[1], v[1]), similarity))
    return out


def _blocks(least: dict[int, int], gram: int, threshold: float):
    """Rows (key, i, j, side, rep, label, sig, text) sorted by block, block after block; a block may span batches."""

    def links(batches):
        key, rows = None, []
        found: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key:
                    if len(rows) > 1:
                        found += _block_links(key, rows, least, gram, threshold)
                    key, rows = row[:3], []
                rows.append(row[3:])
        if len(rows) > 1:
            found += _block_links(key, rows, least, gram, threshold)
        found = sorted(set(found))
        columns = list(zip(*found, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["a", "b", "similarity"])

    return links


def jaccard(one: np.ndarray, two: np.ndarray) -> float:
    """Similarity of two sorted arrays of different hashes."""
    if not len(one) or not len(two):
        return 0.0
    at = np.minimum(np.searchsorted(one, two), len(one) - 1)
    common = int((one[at] == two).sum())
    return common / (len(one) + len(two) - common)


def _attached(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """(a, b, one, two): pairs with a column of both members; a may be a hub of any number of pairs.

    A hub's pairs are dealt over as many salts as they make chunks, and its value is repeated for each, so no task has
    more than about a chunk of them. The table of sets stays in its buckets.
    """
    of = lambda c, name: sets.select(F.col("row").alias(c), F.col(column).alias(name))
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("salts"))
    ones = hubs.join(of("a", "one"), "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    large = small(hubs.where("salts > 1"))
    salted = pairs.join(large, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int"))
    return salted.select("a", "b", "salt").join(of("b", "two"), "b").join(ones, ["a", "salt"]).select("a", "b", "one", "two")


def _checked(pairs: DataFrame, sets: DataFrame, gram: int, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs that whole texts confirm."""
    return written(map_arrow(_attached(pairs, sets, "text"), _verify(gram, threshold), "a long, b long, similarity double"), "links")


def _near_pairs(one: list[np.ndarray], two: list[np.ndarray], threshold: float, width: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """How many of the other side's sets each set is similar to. Common hashes are counted by products of 0/1 matrices over
    the hashes that two sets at least have, a slice of them at a time."""
    sizes, others = np.array([len(x) for x in one], np.int64), np.array([len(x) for x in two], np.int64)
    common = np.zeros((len(one), len(two)), np.float32)
    sides = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (one, two)]
    shared = np.intersect1d(*sides)
    rows = [np.repeat(np.arange(len(n)), n) for n in (sizes, others)]
    places = []
    for side, row in zip(sides, rows, strict=True):
        at = np.minimum(np.searchsorted(shared, side), max(len(shared) - 1, 0))
        hit = shared[at] == side if len(shared) else np.zeros(len(side), bool)
        order = np.argsort(at[hit], kind="stable")
        places.append((at[hit][order], row[hit][order]))
    for start in range(0, len(shared), width):
        slices = []
        for (at, row), n in zip(places, (len(one), len(two)), strict=True):
            a, b = np.searchsorted(at, (start, start + width))
            matrix = np.zeros((n, min(width, len(shared) - start)), np.float32)
            matrix[row[a:b], at[a:b] - start] = 1
            slices.append(matrix)
        common += slices[0] @ slices[1].T
    near = common >= (threshold - 1e-12) * (sizes[:, None] + others[None, :] - common)
    return near.sum(axis=1), near.sum(axis=0)


def _block_counts(key: tuple, rows: list[tuple], gram: int, threshold: float) -> list[tuple]:
    """(row, n): similar texts that each text (side, row, text) has in one block of a component."""
    found, counts = shingles([r[2].encode().lower().split() for r in rows], gram)
    ends = np.cumsum(counts)
    sets = [np.unique(found[e - n : e]) for e, n in zip(ends, counts, strict=True)]
    if key[1] == key[2]:
        n, _ = _near_pairs(sets, sets, threshold)
        return [(r[1], int(k) - 1) for r, k in zip(rows, n, strict=True)]
    one, two = [i for i, r in enumerate(rows) if r[0] == 0], [i for i, r in enumerate(rows) if r[0] == 1]
    n, m = _near_pairs([sets[i] for i in one], [sets[i] for i in two], threshold)
    return [(rows[i][1], int(k)) for i, k in (*zip(one, n, strict=True), *zip(two, m, strict=True))]


def _counts(gram: int, threshold: float):
    """Rows (label, i, j, side, row, text) sorted by block, block after block."""

    def count(batches):
        key, rows = None, []

        def out():
            got = _block_counts(key, rows, gram, threshold) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], names=["rep", "n"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key:
                    yield out()
                    key, rows = row[:3], []
                rows.append(row[3:])
        yield out()

    return count


def link_counts(sets: DataFrame, labels: DataFrame, gram: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(rep, n_links): for each text (row, text) of a component, the different texts of at least the threshold's similarity.

    Exact for any component: its texts are dealt into chunks of about CHUNK, and each pair of chunks is one block whose
    common shingles are counted by matrix products; only counts leave it. That work is quadratic in the different texts
    of a component, as the number of links is.
    """
    large = small(labels.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("c")).where("c > 1"))
    rows = labels.join(large, "label", "left").withColumn("c", F.coalesce("c", F.lit(1))).withColumn("q", F.pmod(F.xxhash64("node"), F.col("c")).cast("int"))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    rows = rows.select("label", F.least("q", "x").alias("i"), F.greatest("q", "x").alias("j"), F.when(F.col("q") <= F.col("x"), 0).otherwise(1).alias("side"), F.col("node").alias("row"))
    cells = rows.join(sets.select("row", "text"), "row").select("label", "i", "j", "side", "row", "text")
    cells = cells.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
    return map_arrow(cells, _counts(gram, threshold), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n_links"))


def jaccard_links(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sets, members, links, labels) of the texts of docs.

    sets: row, text and sketches; members: row, id, mark, rep (row of its representative: texts with equal words, A-Z lower-cased, have one); links: (a, b,
    similarity) of representatives; labels: (node, label) of the components of the links.

    Buckets of equal bands are not expanded into pairs. Every member is first compared with the bucket's smallest
    representative. Where members of a bucket are then still in different components, all pairs across components are
    pruned and verified inside blocks of at most CHUNK by CHUNK rows, from which only links come out; after this each
    candidate pair is either in one component or known to be none. Null texts count as empty; texts without words
    are equal to each other and to nothing else.
    """
    least = least_matches(threshold, tolerance)
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), mark(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    # texts are moved once, here: the joins below that need some of them leave this table in its buckets
    sets = bucketed(map_arrow(picked, _sketches(gram), f"row long, id {kind}, mark long, text string, digest binary, bands array<long>, sig binary"), "row", "sketches")
    keyed = sets.select("row", "id", "mark", "digest", F.struct(F.lit(0).alias("z"), (-F.col("row")).alias("r")).alias("order"))
    members = written(group_winner(keyed, "digest", "order").select("row", "id", "mark", (-F.col("winner.r")).alias("rep")), "members")
    reps = sets.where("sig IS NOT NULL").join(members.where("row = rep").select("row"), "row", "left_semi")
    bands = written(reps.select(F.col("row").alias("rep"), F.explode("bands").alias("key")), "bands")
    buckets = bands.groupBy("key").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    crowd = written(bands.join(buckets, "key").select("key", "rep", "first", "n"), "buckets")
    stars = written(crowd.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    pairs = written(map_arrow(_attached(stars, sets, "sig"), _prune(least), "a long, b long"), "pairs")
    links = _checked(pairs, sets, gram, threshold)
    labels = written(components(links), "labels")
    # buckets that still hold several components
    crowd = crowd.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    parts = crowd.groupBy("key", "label").agg(F.count(F.lit(1)).alias("own"))
    of_key = W.partitionBy("key")
    rank = F.row_number().over(of_key.orderBy(F.desc("own"), "label"))
    parts = parts.withColumns({"parts": F.count(F.lit(1)).over(of_key), "total": F.sum("own").over(of_key), "rank": rank}).where("parts > 1")
    parts = written(parts.groupBy("key").agg(F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("main"), F.max(F.when(F.col("rank") == 1, F.col("own"))).alias("n_main"), F.max("total").alias("total")), "mixed")
    mixed = crowd.join(parts, "key").select("key", "rep", "label", (F.col("label") == F.col("main")).alias("is_main"), (F.col("total") - F.col("n_main")).alias("n_other"), F.ceil(F.col("n_main") / CHUNK).cast("int").alias("c1"), F.ceil((F.col("total") - F.col("n_main")) / CHUNK).cast("int").alias("c2"))
    # members of the largest component meet the others chunk by chunk; the others meet each other likewise
    draw = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    cell = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    main = F.transform(upto("c2"), lambda j: cell(draw("c1"), j, 0))
    other = F.transform(upto("c1"), lambda i: cell(i, draw("c2"), 1))
    among = F.transform(upto("c2"), lambda j: F.when(j >= draw("c2"), cell(-1 - draw("c2"), j, 0)).otherwise(cell(-1 - j, draw("c2"), 1)))
    cells = mixed.withColumn("cell", F.explode(F.when(F.col("is_main"), main).when(F.col("n_other") > 1, F.concat(other, among)).otherwise(other))).select("key", "cell.i", "cell.j", "cell.side", "rep", "label")
    cells = cells.join(sets.select(F.col("row").alias("rep"), "sig", "text"), "rep")
    cells = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "side", "rep", "label", "sig", "text")
    found = map_arrow(cells, _blocks(least, gram, threshold), "a long, b long, similarity double")
    found = written(found.distinct(), "more-links")
    if found.limit(1).count():
        links = links.unionByName(found)
        labels = written(components(links), "labels")
    return sets, members, links, labels


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """One row per row of docs: id, mark, class_id (smallest id of the class), kept, class_size, n_links, n_copies.

    n_links counts the different word sequences of its class that are similar to the row's (null without count_links), n_copies the other rows with its
    words. A class holds all rows that links and equal words connect; of its rows exactly one is kept: that with the
    smallest id (a null id counts as the largest), the first of several. See jaccard_links for odd texts.
    """
    sets, members, _, labels = jaccard_links(docs, threshold, gram, id_col=id_col, text_col=text_col)
    ends = link_counts(sets, labels, gram, threshold) if count_links else labels.select(F.col("node").alias("rep"), F.lit(None).cast("long").alias("n_links"))
    reps = members.groupBy("rep").agg((F.count(F.lit(1)) - 1).alias("n_copies"))
    reps = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(ends, "rep", "left")
    reps = written(reps.select("rep", "n_copies", F.coalesce("label", "rep").alias("label"), (F.coalesce("n_links", F.lit(0)) if count_links else F.col("n_links")).cast("long").alias("n_links")), "reps")
    alone = reps.where("n_copies = 0").withColumnRenamed("rep", "row")
    # rows of texts with copies know their representative's figures by its number; such hot groups are split by AQE
    lone = members.where("row = rep").join(alone, "row").select("row", "id", "mark", "label", "n_links", "n_copies")
    rest = members.join(reps.where("n_copies > 0"), "rep").select("row", "id", "mark", "label", "n_links", "n_copies")
    rows = lone.unionByName(rest).withColumn("digest", F.unhex(F.lpad(F.hex("label"), 16, "0")))
    rows = written(rows.withColumn("order", F.struct(F.col("id").isNotNull().alias("known"), (-F.col("id").cast("long")).alias("least"), (-F.col("row")).alias("row"))), "classed")
    out = group_winner(rows, "digest", "order")
    return out.select("id", "mark", (-F.col("winner.least")).alias("class_id"), (F.col("winner.row") == -F.col("row")).alias("kept"), F.col("group_size").alias("class_size"), "n_links", "n_copies")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of near duplicates."""
    return keep_rows(docs, near_classes(docs, id_col=id_col, text_col=text_col, count_links=False), id_col, mark(text_col))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("mark").withColumnRenamed("id", "doc_id")


QUERIES = {"op9_jaccard": op9_jaccard}
SQL: dict = {}
