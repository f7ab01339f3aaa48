"""Ranked lexical search over a two-level quantised index.

The index has a row for each block of documents, an inverted list of its terms. The first level holds a byte for each
posting: its impact (what a term of weight 1 adds to the document's score) divided by STEP and rounded upwards. Bytes give
an upper bound of a score, and a lower one, by additions alone. The second level holds what the exact integer score
needs. A search reads the first level once to find each item's k-th largest lower bound, and scores exactly every
document whose upper bound reaches it. Postings never move: blocks are searched where they lie, and a task sends back k
documents an item at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rillmark.llm.common import map_arrow, small_batches, utf8, written

TOP = 10
#: Impacts are below 10**6, so that a step of 4096 leaves bytes of 245 at most.
UNIT, STEP = 10**9, 4096
#: Bytes of a text that are split into terms at once, terms of the items that are searched for together, and postings
#: that a task adds up at once.
PART, CHUNK_TERMS, POSTINGS = 1 << 20, 200_000, 500_000
#: Documents of a block, and blocks that a Python worker gets at once.
BLOCK_DOCS, BLOCKS = 256, 4
#: Separators (fixed values): all ASCII but letters and digits; A-Z become a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
BLOCK = "ids array<{}>, sizes array<long>, terms array<binary>, ends array<long>, slots binary, impacts binary, counts binary"


def term_parts(text: bytes):
    """The terms of a text in UTF-8, in lists of those that start within PART bytes."""
    start = 0
    while start < len(text):
        end = min(len(text), start + PART)
        while end < len(text) and _TABLE[text[end]] != 32:
            end += 1
        yield text[start:end].translate(_TABLE).split()
        start = end


class _Sizes:
    """(documents with a term, terms) of a task."""

    def __call__(self, batches):
        docs = terms = 0
        for batch in batches:
            for text in utf8(batch.column(0)):
                n = sum(map(len, term_parts(text)))
                docs, terms = docs + (n > 0), terms + n
        yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], names=["docs", "terms"])


def _counted(texts: list[bytes]) -> pa.Table:
    """(term, slot, n): occurrences of each term by text, in order of term and slot."""
    found = []
    for slot, text in enumerate(texts):
        for part in term_parts(text):
            if part:
                found.append(pa.table({"term": pa.array(part, pa.binary()), "slot": np.full(len(part), slot, np.int32)}))
    if not found:
        return pa.table({"term": pa.array([], pa.binary()), "slot": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
    counted = pa.concat_tables(found).group_by(["term", "slot"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["term", "slot", "n"])
    return counted.sort_by([("term", "ascending"), ("slot", "ascending")])


def lengths(sizes: list[int], docs: int, terms: int) -> list[int]:
    """The m of documents of these sizes; sizes without terms have none (0)."""
    return [10 + 90 * n * docs // terms if n else 0 for n in sizes]


class _Block:
    """A row of the index for each batch."""

    def __init__(self, docs: int, terms: int):
        self.docs, self.terms = docs, terms

    def __call__(self, batches):
        for batch in (whole.slice(i, BLOCK_DOCS) for whole in batches for i in range(0, whole.num_rows, BLOCK_DOCS)):
            counted = _counted(utf8(batch.column(1)))
            slot, tf = counted["slot"].to_numpy(), counted["n"].to_numpy()
            sizes = np.bincount(slot, tf, minlength=batch.num_rows).astype(np.int64)
            m = np.array(lengths(sizes.tolist(), self.docs, self.terms), np.int64)
            impact = UNIT * tf // (1000 * tf + 8 * m[slot])
            term = pa.concat_arrays(counted["term"].chunks) if counted.num_rows else pa.array([], pa.binary())
            last = np.ones(len(term), bool)  # of its term's postings
            last[:-1] = pc.not_equal(term[:-1], term[1:]).to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(last)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = [one(batch.column(0)), one(pa.array(sizes)), one(term.take(pa.array(ends))), one(pa.array(ends + 1))]
            columns += [pa.array([x.tobytes()], pa.binary()) for x in (slot.astype("<i4"), (-(-impact // STEP)).astype(np.uint8), tf.astype("<i8"))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in BLOCK.split(", ")])
            pa.default_memory_pool().release_unused()


class Index:
    """The written blocks, N (documents with a term) and L (all terms)."""

    def __init__(self, blocks: DataFrame, docs: int, terms: int):
        self.blocks, self.docs, self.terms = blocks, docs, terms


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all rows of docs; a null text has no terms. Rows may repeat ids and texts: each row is a document."""
    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    n, terms = map_arrow(picked.select("text"), _Sizes(), "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    blocks = map_arrow(picked, _Block(n or 0, terms or 0), BLOCK.format(docs.schema[id_col].dataType.simpleString()))
    # few blocks to a row group: a reader holds one
    return Index(written(blocks, "index", {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 4}), n or 0, terms or 0)


class _Items:
    """(chunk, row, id, terms): each item with its different terms; a chunk has CHUNK_TERMS of them, or one item."""

    def __call__(self, batches):
        chunk, held = 0, 0
        for batch in batches:
            terms = [sorted({t for part in term_parts(text) for t in part}) for text in utf8(batch.column(2))]
            at = []
            for own in terms:
                if held and held + len(own) > CHUNK_TERMS:
                    chunk, held = chunk + 1, 0
                held += len(own)
                at.append(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.binary()))], names=["chunk", "row", "id", "terms"])


class _Chunk:
    """Items searched for together: the vocabulary, and of each item its terms' numbers in it."""

    def __init__(self, rows: list[int], terms: list[list[bytes]]):
        self.rows = rows
        self.vocabulary = sorted({bytes(t) for own in terms for t in own})
        number = {t: i for i, t in enumerate(self.vocabulary)}
        self.items = [np.array([number[bytes(t)] for t in own], np.int64) for own in terms]
        self.weights = np.zeros(len(self.vocabulary), np.int64)

    def postings(self, block: dict) -> tuple[np.ndarray, np.ndarray]:
        """By term of the vocabulary: first and last posting in the block (alike where it has none)."""
        ends = block["ends"].values.to_numpy()
        at = pc.index_in(pa.array(self.vocabulary, pa.binary()), value_set=block["terms"].values)
        known, at = at.is_valid().to_numpy(zero_copy_only=False), at.fill_null(0).to_numpy(zero_copy_only=False)
        if not len(ends):
            return np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        return np.where(known, starts[at], 0), np.where(known, ends[at], 0)

    def groups(self, first: np.ndarray, last: np.ndarray, wide: int):
        """Items in runs of about POSTINGS postings, and sums of as many documents: (numbers of the items, postings, their items' places, their weights)."""
        run, held = [], 0
        for i, own in enumerate([*self.items, None]):
            n = 0 if own is None else int((last[own] - first[own]).sum())
            if run and (own is None or held + n > POSTINGS or (len(run) + 1) * wide > POSTINGS):
                terms = np.concatenate([self.items[j] for j in run])
                place = np.repeat(np.arange(len(run)), [len(self.items[j]) for j in run])
                many = last[terms] - first[terms]
                start = np.concatenate([[0], many.cumsum()[:-1]]) if len(many) else many
                posting = np.repeat(first[terms] - start, many) + np.arange(many.sum())
                yield run, posting, np.repeat(place, many), np.repeat(self.weights[terms], many)
                run, held = [], 0
            if n:
                run.append(i)
                held += n


def _blocks(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}


class _Frequencies:
    """(term, documents) of a task for the chunk's terms, terms by number."""

    def __init__(self, chunk: _Chunk):
        self.chunk = chunk

    def __call__(self, batches):
        n = np.zeros(len(self.chunk.vocabulary), np.int64)
        for block in _blocks(batches):
            first, last = self.chunk.postings(block)
            n += last - first
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some])], names=["term", "n"])


def _bounds(chunk: _Chunk, block: dict):
    """(items, postings, places, weights, lower, upper): bounds of all documents of the block, a row for each item."""
    slots, impacts = np.frombuffer(block["slots"].as_py(), "<i4"), np.frombuffer(block["impacts"].as_py(), np.uint8)
    wide = len(block["ids"].values)
    for run, posting, place, weight in chunk.groups(*chunk.postings(block), wide):
        cell, high = place * wide + slots[posting], impacts[posting].astype(np.int64) * STEP
        total = lambda x: np.bincount(cell, weight * x, minlength=len(run) * wide).reshape(len(run), wide)  # noqa: B023, E731  whole numbers below 2**53
        yield run, posting, place, weight, total(np.maximum(high - STEP + 1, 0)), total(high)


class _Lower:
    """(row, bound): the k largest lower bounds of each item in a task."""

    def __init__(self, chunk: _Chunk, k: int):
        self.chunk, self.k = chunk, k

    def __call__(self, batches):
        best: dict[int, np.ndarray] = {}
        for block in _blocks(batches):
            for run, _, _, _, lower, _ in _bounds(self.chunk, block):
                top = np.partition(lower, -min(self.k, lower.shape[1]), axis=1)[:, -self.k :] if lower.shape[1] else lower
                for i, own in zip(run, top, strict=True):
                    both = np.concatenate([best.get(i, np.zeros(0)), own[own > 0]])
                    best[i] = np.sort(both)[-self.k :]
        rows = [(self.chunk.rows[i], int(v)) for i, own in best.items() for v in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["row", "bound"])


class _Exact:
    """(row, doc, score): a task's k best documents of each item, of those whose upper bound reaches the item's least."""

    def __init__(self, chunk: _Chunk, least: list[int], k: int, docs: int, terms: int, kind: pa.DataType):
        self.chunk, self.least, self.k, self.docs, self.terms, self.kind = chunk, np.array(least), k, docs, terms, kind

    def __call__(self, batches):
        best: dict[int, list] = {}
        for block in _blocks(batches):
            slots, tf = np.frombuffer(block["slots"].as_py(), "<i4"), np.frombuffer(block["counts"].as_py(), "<i8")
            ids, sizes = block["ids"].values, block["sizes"].values.to_numpy()
            m = np.array(lengths(sizes.tolist(), self.docs, self.terms), np.int64)
            order = np.empty(len(ids), np.int64)
            order[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
            for run, posting, place, weight, _, upper in _bounds(self.chunk, block):
                reach = (upper >= self.least[run][:, None]) & (upper > 0)
                own = reach[place, slots[posting]]
                at, n = slots[posting[own]], tf[posting[own]]
                score = np.zeros(reach.shape, np.int64)
                np.add.at(score, (place[own], at), weight[own] * (UNIT * n // (1000 * n + 8 * m[at])))
                for j, i in enumerate(run):
                    some = np.flatnonzero(score[j])
                    some = some[np.lexsort((order[some], -score[j, some]))[: self.k]]
                    best[i] = sorted([*best.get(i, []), *((-int(score[j, x]), *_rank(ids[int(x)].as_py())) for x in some)])[: self.k]
        rows = [(self.chunk.rows[i], doc, -score) for i, own in best.items() for score, known, doc in own for doc in [doc if known else None]]
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], self.kind), pa.array([r[2] for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "doc", "score"])


def _rank(doc) -> tuple:
    """Orders documents of one score: a null id first."""
    return (False, 0) if doc is None else (True, doc)


def search(index: Index, items: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, rank, doc, score): each item's k documents of the highest score above 0, equal scores by ascending doc.

    An item's terms count once each; one without terms, or with none that a document holds, has no row, and so has a
    null text. Rows of items may repeat ids and texts: each is answered for itself. A null doc comes before others of
    its score. Items are searched for in chunks of CHUNK_TERMS terms, every chunk against all blocks.
    """
    spark, blocks = items.sparkSession, index.blocks
    kind, doc_kind = items.schema[id_col].dataType.simpleString(), blocks.schema["ids"].dataType.elementType.simpleString()
    empty = spark.createDataFrame([], f"id {kind}, rank int, doc {doc_kind}, score long")
    picked = items.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    asked = map_arrow(picked, _Items(), f"chunk int, row long, id {kind}, terms array<binary>").withColumn("part", F.spark_partition_id())
    asked = written(asked.where(F.size("terms") > 0), "items")
    if not index.terms or not (chunks := asked.select("part", "chunk").distinct().collect()):
        return empty
    doc_type, out = to_arrow_type(blocks.schema["ids"].dataType.elementType), empty
    with small_batches(spark, BLOCKS):
        for part, number in chunks:  # each of bounded size, from one task of the items' table
            own = asked.where((F.col("part") == part) & (F.col("chunk") == number))
            got = own.select("row", "terms").orderBy("row").collect()
            chunk = _Chunk([r["row"] for r in got], [r["terms"] for r in got])
            found = map_arrow(blocks.select("ids", "terms", "ends"), _Frequencies(chunk), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
            weigh = F.floor(1000 * F.log((2.0 * index.docs + 2) / (2.0 * F.col("n") + 1)))
            for r in found.select("term", weigh.alias("w")).collect():  # a row for each term of the chunk
                chunk.weights[r["term"]] = r["w"]
            lower = map_arrow(blocks.select("ids", "terms", "ends", "slots", "impacts"), _Lower(chunk, k), "row long, bound long")
            last = lower.withColumn("r", F.row_number().over(W.partitionBy("row").orderBy(F.desc("bound")))).where(F.col("r") == k)
            reached = {r["row"]: r["bound"] for r in last.collect()}  # a row for each item of the chunk
            exact = _Exact(chunk, [reached.get(row, 0) for row in chunk.rows], k, index.docs, index.terms, doc_type)
            scored = map_arrow(blocks, exact, f"row long, doc {doc_kind}, score long")
            ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k)
            out = out.unionByName(written(ranked.join(own.select("row", "id"), "row").select("id", "rank", "doc", "score"), "found"))
    return out


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


QUERIES = {"op13_search": op13_search}
SQL = {
    "op13_search": r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY ALL),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, whole GROUP BY term, docs),
lengths AS (SELECT doc_id, 100 - 90 + (90 * n * docs) // terms AS m FROM sizes, whole),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (doc_id) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""
}
