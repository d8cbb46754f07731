"""Token ids in packed rows of fixed length.

Texts are encoded with an existing byte-level BPE vocabulary and end with its separator.
Documents longer than a row are cut into pieces, without loss. Pieces are packed
best-fit-decreasing: from the longest down, each goes to the fullest row that still has
room, found in a segment tree over the room that rows have left. Rows are packed in
pools of consecutive documents, so a task holds one pool whatever the input, nothing is
shuffled, and the order of documents (a curriculum) survives between pools.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from turnledger.llm.common import map_batches, text_or_empty

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed values of that vocabulary: how texts are cut before merging, the separator's id.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEPARATOR = 50256
ROW_TOKENS = 2048
# Tokens that are packed together.
POOL_TOKENS = 1 << 22

SCHEMA = (
    "pack_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, "
    "doc_ids array<long>, pieces array<int>"
)


def encoder(data: bytes):
    """Text -> ids, from the lines of a rank file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines())}
    return tiktoken.Encoding(
        "ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary


class Rooms:
    """How many rows have each amount of room, as a segment tree of counts."""

    def __init__(self, largest: int):
        self.size = 1 << (largest + 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) with the least room of at least `need`, removed from the tree."""
        at, count = need + self.size, self.count
        while not count[at]:
            while at & 1:  # a right child: nothing further right under this parent
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self.size:
            at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        row = self.rows[room].pop()
        self._change(room, -1)
        return room, row


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Pieces in rows: positions in `sizes`, none larger than `capacity`."""
    rooms, rows = Rooms(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = rooms.take(sizes[i])
        room, row = found or (capacity, len(rows))
        if found is None:
            rows.append([])
        rows[row].append(i)
        rooms.add(room - sizes[i], row)
    return rows


def id_type(vocabulary: bytes) -> np.dtype:
    """Little-endian, two bytes where all ids and the separator fit in them."""
    largest = max([SEPARATOR, *(int(line.split()[1]) for line in vocabulary.splitlines())])
    return np.dtype("<u2" if largest < 1 << 16 else "<u4")


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, row_tokens: int = ROW_TOKENS,
         separator: int = SEPARATOR, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """One row for each row of the packed id matrix.

    pack_id; n_tokens in use; ids: `row_tokens` little-endian ids, the rest filled with
    the separator; cu_seqlens: 0 and the end of each segment; position_ids: as ids, a
    position that begins at 0 in each segment and in the filling; doc_ids and pieces: the
    document of each segment and which of its pieces it is, from 0.

    Null and empty texts are one separator; rows without doc_id have a null in doc_ids;
    repeated rows are packed each; an empty table gives no row. Other columns are not
    read. ids take two bytes for a vocabulary below 65,536, else four.
    """
    with open(vocabulary, "rb") as file:
        data = file.read()
    sent = docs.sparkSession.sparkContext.broadcast(data)
    kind, places = id_type(data), np.dtype("<u2" if row_tokens <= 1 << 16 else "<u4")

    def pool(ids: list[np.ndarray], owners: list, first: int) -> pa.RecordBatch:
        parts = [
            (doc, k, tokens[k * row_tokens : (k + 1) * row_tokens])
            for doc, tokens in zip(owners, ids)
            for k in range(-(-len(tokens) // row_tokens))
        ]
        rows = best_fit([len(t) for _, _, t in parts], row_tokens)
        matrix = np.full((len(rows), row_tokens), separator, kind)
        place = np.zeros((len(rows), row_tokens), places)
        count = np.arange(row_tokens, dtype=places)
        ends = []
        for r, row in enumerate(rows):
            at = 0
            ends.append([0])
            for i in row:
                tokens = parts[i][2]
                matrix[r, at : at + len(tokens)] = tokens
                place[r, at : at + len(tokens)] = count[: len(tokens)]
                at += len(tokens)
                ends[-1].append(at)
            place[r, at:] = count[: row_tokens - at]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(first, first + len(rows))),
                pa.array([e[-1] for e in ends], pa.int32()),
                pa.array([m.tobytes() for m in matrix], pa.binary()),
                pa.array(ends, pa.list_(pa.int32())),
                pa.array([p.tobytes() for p in place], pa.binary()),
                pa.array([[parts[i][0] for i in row] for row in rows], pa.list_(pa.int64())),
                pa.array([[parts[i][1] for i in row] for row in rows], pa.list_(pa.int32())),
            ],
            names=[c.split()[0] for c in SCHEMA.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(sent.value)
        next_id = TaskContext.get().partitionId() << 40
        ids, owners, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(np.array([*encode(text), separator], kind))
                owners.append(doc)
                held += len(ids[-1])
                if held >= pool_tokens:
                    out = pool(ids, owners, next_id)
                    next_id += out.num_rows
                    yield from (out.slice(i, 256) for i in range(0, out.num_rows, 256))
                    ids, owners, held = [], [], 0
        if ids:
            out = pool(ids, owners, next_id)
            yield from (out.slice(i, 256) for i in range(0, out.num_rows, 256))

    source = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return map_batches(source, run, SCHEMA)


def write_matrix(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet files, without a shuffle: each task writes its own."""
    packed.write.mode("overwrite").parquet(path)
