"""SentencePiece encoding and decoding through a table of distinct marked words.

No piece of the model holds a white-space marker after another character, so each marked word is
segmented by itself: every task's table segments a distinct word once, and all its occurrences get
their ids by position. The table is bounded (chunk_table.CAPACITY) and nothing is shuffled. A model
whose pieces may cross markers is used on whole texts.

Null and empty texts have only the begin and end ids. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import tokens
from pagemill.llm.common import ship


def encode_decode(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids also ids and decoded."""
    ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def run(batches):
        table, sp = tokens.pieces(path), tokens.piece_processor(path)
        begin, end = np.uint32(sp.bos_id()), np.uint32(sp.eos_id())
        for part, ids, at in tokens.token_slices(batches, table):
            each = [np.concatenate([[begin], ids[a:b], [end]]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            texts = sp.decode([x.tolist() for x in each], num_threads=1)
            out = {
                "doc_id": part.column("doc_id"),
                "n_tokens": pa.array([len(x) for x in each], pa.int64()),
                "ids_sha256": pa.array([tokens.sha256(x) for x in each]),
                "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts]),
            }
            if keep_ids:
                out |= {"ids": pa.array(each, pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
