"""Packing token sequences: best fit by length, then swaps, two-for-one exchanges and moves until bins empty."""

from __future__ import annotations

import functools
import json
import zlib
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm.common import map_arrow, written

#: Tokens of a sequence, and pieces of a block that one task packs.
SEQUENCE, BLOCK = 1024, 2000
#: Bins with more than this share of free room are packed again with those of other blocks.
LOOSE = 0.02
END_ID = 2
PIECE = "piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Little-endian 32-bit ids of texts, as the tokenizers library gives them for a byte-level BPE file.

    Its vocabulary is read from that file and handed to tiktoken as ranks: both split by the same pattern and merge by
    the same ranks, so the ids are equal (tests compare them), in a fifth of the time. Added tokens, like a mark of a
    text's end, are found in texts as that library finds them. A text that tiktoken refuses (a run of blanks of about a
    million characters is too long for its pattern) is encoded by the tokenizers library itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path, self.plain = path, None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        added = {x["content"]: x["id"] for x in file["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in added}
        self.encoding, self.added = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added), set(added)

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [self.ids(t).astype("<u4").tobytes() for t in texts]

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text, allowed_special=self.added, disallowed_special=())
        except ValueError:
            import tokenizers

            self.plain = self.plain or tokenizers.Tokenizer.from_file(self.path)
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


class _Pieces:
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def __call__(self, batches):
        encode, end, size = encoder(self.path), np.array([END_ID], "<u4").tobytes(), self.size
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for i, ids in enumerate(encode([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, x in zip(rows, (i, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        column.append(x)
            columns = [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *(x.split()[0] for x in PIECE.split(", "))])


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin with room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r is set if a bin has r left
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if fit := rooms >> lengths[i]:
            room = lengths[i] + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := room - lengths[i]:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def local_search(lengths: list[int], bins: list[list[int]], size: int) -> list[list[int]]:
    """Exchanges that raise the sum of squared fill, from the emptiest bins, until none of them helps.

    For an item, or two items, of the bin x in hand (the emptier one): move it into a bin's room, or exchange it for
    one smaller item of a bin that is at least as full. Each step moves d tokens to that bin: 2d(fill - own + d) > 0
    more squared fill, so it ends; the best step is taken. Bins that become empty go.
    """
    length = np.array(lengths, np.int64)
    home = np.empty(len(lengths), np.int64)
    for b, own in enumerate(bins):
        home[own] = b
    fill = np.array([length[own].sum() for own in bins], np.int64)
    least = -(-int(length.sum()) // size)
    held = [set(own) for own in bins]
    alive = len(bins)
    changed = True
    while changed and alive > least:
        changed = False
        for b in np.argsort(fill, kind="stable").tolist():
            while alive > least and 0 < fill[b] < size:
                best, step = 0, None
                own = sorted(held[b], key=lambda i: (-lengths[i], i))
                # one item of each length, two where a pair takes both: all sums of one or two items
                kinds = [i for k, i in enumerate(own) if k < 2 or lengths[own[k - 2]] != lengths[i]]
                seen = set()
                for group in [*((i,) for i in kinds), *combinations(kinds, 2)]:
                    total = sum(lengths[i] for i in group)
                    if total in seen:
                        continue
                    seen.add(total)
                    open_ = (fill + total <= size) & (fill >= fill[b]) & (fill > 0)
                    open_[b] = False
                    if open_.any():
                        gain = np.where(open_, 2 * total * (fill - fill[b] + total), 0)
                        t = int(gain.argmax())
                        if gain[t] > best:
                            best, step = int(gain[t]), (group, t, None)
                    moved = total - length
                    theirs = fill[home]
                    fits = (moved > 0) & (theirs + moved <= size) & (theirs >= fill[b]) & (home != b)
                    if fits.any():
                        gain = np.where(fits, 2 * moved * (theirs - fill[b] + moved), 0)
                        y = int(gain.argmax())
                        if gain[y] > best:
                            best, step = int(gain[y]), (group, int(home[y]), y)
                if step is None:
                    break
                changed = True
                group, t, y = step
                for i in group:
                    held[b].remove(i)
                    held[t].add(i)
                    home[i] = t
                if y is not None:
                    held[t].remove(y)
                    held[b].add(y)
                    home[y] = b
                moved = sum(lengths[i] for i in group) - (lengths[y] if y is not None else 0)
                fill[b] -= moved
                fill[t] += moved
                alive -= not held[b]
    return [sorted(own) for own in held if own]


def pack(lengths: list[int], size: int) -> list[list[int]]:
    bins = best_fit(lengths, size)
    if len(bins) > -(-sum(lengths) // size):
        bins = local_search(lengths, bins, size)
    return bins


def _packer(size: int, level: int):
    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", ignore_index=True)
        lengths = group["length"].tolist()
        ids, offset, room = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for b, own in enumerate(pack(lengths, size)):
            ids[own] = (level << 56) | (int(key[0]) << 20) | b
            at = 0
            for i in own:
                offset[i] = at
                at += lengths[i]
            room[own] = size - at
        return pd.DataFrame({"row": group["row"], "length": group["length"], "sequence_id": ids, "offset": offset, "room": room})

    return one


def pack_documents(docs: DataFrame, path: str, size: int = SEQUENCE, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A text's ids end with id 2; longer ones are cut into pieces of `size`, of which the first may be shorter. Full
    pieces are sequences of their own. The others are dealt into blocks of about `block` pieces by a hash of their
    row number, packed apart, and what lies in bins with room is packed again across blocks until one block holds
    it. A null text is empty (one token). Rows may repeat ids and texts: each row's pieces are placed on their own.
    """
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = map_arrow(picked, _Pieces(path, size), f"id {kind}, {PIECE}").withColumn("row", F.monotonically_increasing_id())
    pieces = written(pieces, "pieces")
    done, todo, level = [], pieces.where(F.col("length") < size).select("row", "length"), 1
    while True:
        count = todo.count()
        blocks = max(1, -(-count // block))
        keyed = todo.withColumn("block", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(blocks)))
        packed = keyed.groupBy("block").applyInPandas(_packer(size, level), "row long, length long, sequence_id long, offset long, room long")
        packed = written(packed, "packed")
        if blocks == 1:
            done.append(packed)
            break
        done.append(packed.where(F.col("room") <= LOOSE * size))
        todo, level = packed.where(F.col("room") > LOOSE * size).select("row", "length"), level + 1
        if level > 2 and blocks <= -(-todo.count() // block):  # as many blocks again: nothing to gain from another deal
            done.append(packed.where(F.col("room") > LOOSE * size))
            break
    placed = functools.reduce(DataFrame.unionByName, done).select("row", "sequence_id", "offset")
    whole = pieces.where(F.col("length") == size).select(*pieces.columns[:-1], F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < size).join(placed, "row").select(*pieces.columns[:-1], "sequence_id", "offset")
    return whole.unionByName(rest)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary()).withColumnRenamed("id", "doc_id")


QUERIES = {"op8_packing": op8_packing}
SQL: dict = {}
