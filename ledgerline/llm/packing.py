"""Operator 1: sum-of-squares online packing.

Documents become token pieces (windows of a full sequence and one remainder);
each piece in turn goes to the fill level that keeps the sum over levels of the
squared number of partially filled sequences smallest. The state of a packer is
the level array: how many open sequences stand at each fill level, and which.

Null texts count as empty: they hold only the closing id. Repeated rows are
packed each on its own. Texts of any length are cut whole. An empty table gives no
rows. Only the id is carried, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.bpe import load
from ledgerline.llm.common import prepare, stage

# Pieces one online packer sees. More packers run side by side as the table grows;
# each leaves at most a few hundred sequences partly filled.
PACKER_ROWS = 40_000


class LevelArray:
    """Open sequences by fill level; ``place`` returns (sequence, offset) of a piece."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[list[int]] = [[] for _ in range(capacity)]
        self.count = np.zeros(capacity + 1, np.int64)
        self.sequences = 0

    def place(self, size: int) -> tuple[int, int]:
        if size == self.capacity:
            self.sequences += 1
            return self.sequences - 1, 0
        # Placing on level h changes the sum of squares by 2 * (n[h + size] - n[h]) + 2;
        # level 0 (a new sequence) and a level that fills up lack one of the two terms.
        n = self.count
        change = 2 * n[size : self.capacity + 1] + 1
        change[-1] = 0
        change[1:] -= 2 * n[1 : self.capacity - size + 1] - 1
        change[1:][n[1 : self.capacity - size + 1] == 0] = np.iinfo(np.int64).max
        level = len(change) - 1 - int(np.argmin(change[::-1]))  # ties: the fullest level
        if level:
            sequence = self.open[level].pop()
            n[level] -= 1
        else:
            sequence = self.sequences
            self.sequences += 1
        if level + size < self.capacity:
            self.open[level + size].append(sequence)
            n[level + size] += 1
        return sequence, level


PIECE = "{id} {id_type}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text: str,
                 with_ids: bool) -> DataFrame:
    """Each document's ids and ``end_id``, cut into windows of ``capacity`` and a remainder."""
    schema = PIECE.format(id=id_col, id_type=docs.schema[id_col].dataType.simpleString())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(vocabulary)
        for batch in batches:
            rows = []
            for key, ids in zip(batch["_id"].tolist(), bpe.encode(batch["_text"].fillna("").tolist())):
                ids = np.append(ids, end_id).astype("<u4")
                for at in range(0, len(ids), capacity):
                    raw = ids[at : at + capacity].tobytes()
                    rows.append((key, at, len(raw) // 4, zlib.crc32(raw), len(ids), raw if with_ids else None))
            yield pd.DataFrame(rows, columns=[id_col, "start", "length", "ids_crc32", "doc_tokens", "ids"])

    source = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    return source.mapInPandas(cut, schema)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id",
         text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``sequence_id`` is the packer's number times 2**32 plus the sequence's number there.
    Null ids are kept; they must be of an integer or string type.
    """
    prepare(docs.sparkSession)
    pieces = token_pieces(docs, vocabulary, capacity, end_id, id_col, text, with_ids)
    # A packer meets its pieces in a hash order of their position: like a random stream, the same on a
    # rerun over the same files, and even over the packers whatever ids or texts repeat.
    pieces = stage(pieces.withColumn("_order", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    packers = max(1, -(-pieces.count() // PACKER_ROWS))
    kept = [c for c in pieces.columns if c != "_order"]
    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in kept)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_order", ignore_index=True)
        levels = LevelArray(capacity)
        places = [levels.place(n) for n in group["length"].tolist()]
        out = group[kept].copy()
        out["sequence_id"] = np.array([s for s, _ in places], np.int64) + (int(group["_packer"].iloc[0]) << 32)
        out["offset"] = np.array([o for _, o in places], np.int64)
        return out

    dealt = pieces.withColumn("_packer", F.pmod("_order", F.lit(packers)).cast("int"))
    packed = dealt.groupBy("_packer").applyInPandas(run, f"{schema}, sequence_id long, offset long")
    return packed if with_ids else packed.drop("ids")
