"""Documents packed into sequences by vector best-fit.

A document's ids and one end id are cut only where it is longer than a sequence; all pieces but the last are then
full sequences. The pieces are dealt evenly into groups of about GROUP pieces, and each group is packed on its own,
which costs at most about one part-filled sequence per group (0.02 %) and bounds the memory of a task at any size.

Within a group, pieces come longest first. A sequence has three residual capacities: tokens, documents and attention
cost (the sum of squared lengths). Among the open sequences that can take the piece under all three, the piece goes to
the one with the least weighted norm of what is left afterwards ("norm"), or with the greatest weighted dot product of
demand and residual ("dot"); all quantities are shares of their capacity, and the oldest sequence wins a tie.

Defined cases: a null or empty text has only its end id. Repeated rows and null ids are packed as they come. A piece whose
attention cost alone is above the capacity gets a sequence of its own, as no sequence could meet the limit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm import tokens
from trafficlens.llm.tables import store

MAX_TOKENS = 4096
END_ID = 1
GROUP = 16_384
WEIGHTS = (1.0, 0.001, 0.001)
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(
    lengths: np.ndarray,
    max_tokens: int = MAX_TOKENS,
    max_documents: int | None = None,
    max_attention: int | None = None,
    rule: str = "norm",
    weights: tuple[float, float, float] = WEIGHTS,
) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) of each piece; ``lengths`` must not increase."""
    capacity = np.array([max_tokens, max_documents or max_tokens, max_attention or max_tokens**2], dtype=float)
    w = np.array(weights)
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    left = np.empty((3, 1024))  # residuals of the open sequences, oldest first
    number = np.empty(1024, dtype=np.int64)
    n_open = n_all = 0
    shortest = int(lengths[-1]) if len(lengths) else 0
    for i, length in enumerate(lengths.tolist()):
        need = np.array([length, 1, length * length], dtype=float)
        fits = np.flatnonzero((left[0, :n_open] >= length) & (left[1, :n_open] >= 1) & (left[2, :n_open] >= need[2]))
        if len(fits):
            residual = left[:, fits]
            if rule == "norm":
                after = (residual - need[:, None]) / capacity[:, None]
                best = int(fits[np.argmin(w @ (after * after))])
            else:
                best = int(fits[np.argmax((w * need / capacity) @ (residual / capacity[:, None]))])
        else:
            if n_open == left.shape[1]:
                left = np.concatenate([left, np.empty_like(left)], axis=1)
                number = np.concatenate([number, np.empty_like(number)])
            best, n_open = n_open, n_open + 1
            left[:, best], number[best] = capacity, n_all
            n_all += 1
        sequence[i], offset[i] = number[best], max_tokens - int(left[0, best])
        left[:, best] -= need
        # Sequences that can take nothing more are closed.
        if left[0, best] < shortest or left[1, best] < 1 or left[2, best] < shortest * shortest:
            left[:, best : n_open - 1] = left[:, best + 1 : n_open]
            number[best : n_open - 1] = number[best + 1 : n_open]
            n_open -= 1
    return sequence, offset


def pieces(docs: DataFrame, vocabulary: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary)
        for batch in batches:
            out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(map(str, batch["text"]))):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[at : at + 4 * max_tokens]
                    for name, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        out[name].append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECE)


def pack(cut: DataFrame, group: int = GROUP, **limits) -> DataFrame:
    """``cut`` (see ``pieces``; a stored table) with sequence_id and offset. ``limits`` as in ``best_fit``."""
    groups = max(1, -(-cut.count() // group))
    full = limits.get("max_tokens", MAX_TOKENS)

    def place(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        lengths = part["length"].to_numpy()
        attention = limits.get("max_attention")
        alone = (lengths >= full) | (lengths**2 > (attention or full**2))  # each is a sequence of its own
        sequence, offset = np.arange(len(part)), np.zeros(len(part), dtype=np.int64)
        first, offset[~alone] = best_fit(lengths[~alone], **limits)
        sequence[~alone] = len(part) + first
        part["sequence_id"] = sequence + (np.int64(key[0]) << 32)
        part["offset"] = offset
        return part.drop(columns="deal")

    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    return cut.withColumn("deal", deal).groupBy("deal").applyInPandas(place, f"{PIECE}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, max_tokens: int = MAX_TOKENS, **limits) -> DataFrame:
    """All documents in sequences of at most ``max_tokens``: one row per piece."""
    cut = store(pieces(docs, vocabulary or tokens.vocabulary(), max_tokens), "pieces")
    return pack(cut, max_tokens=max_tokens, **limits)
