"""Token counts of whole texts: only lengths leave the workers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.bytesets import SPACE, groups, text_bytes
from tapeloom.llm.vocab import Encoder, encoder

#: Bytes of text encoded at a time: batches are balanced by bytes, not rows.
BATCH_BYTES = 2 << 20


def lengths(enc: Encoder, data: np.ndarray, offs: np.ndarray, limit: int = BATCH_BYTES) -> np.ndarray:
    """Tokens of each row; a row over limit is split before ASCII white space, where the tokenizer allows it."""
    if enc.pieces is None or len(offs) > 2 or len(data) <= limit:
        return enc.encode(data, offs, ids=False)[1]
    space = np.flatnonzero(SPACE[data])
    cuts = np.unique(space[np.minimum(np.searchsorted(space, np.arange(limit, len(data), limit)), len(space) - 1)]) if len(space) else space
    parts = np.concatenate([[0], cuts, [len(data)]])
    return np.array([sum(int(enc.encode(data[i:j], np.array([0, j - i]), ids=False)[1][0]) for i, j in zip(parts[:-1], parts[1:], strict=True))])


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_bytes, n_tokens, over_limit.

    A null text counts as empty (0 bytes, 0 tokens); null ids and repeated rows are kept as they are; other columns
    are not read. An empty table gives an empty one. Whole texts are counted, without special tokens of the encoder's own.
    """

    def run(batches):
        enc = encoder(tokenizer_path)
        for b in batches:
            data, offs = text_bytes(b.column(1))
            n = np.zeros(b.num_rows, np.int64)
            for i, j in groups(offs, BATCH_BYTES):
                n[i:j] = lengths(enc, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
