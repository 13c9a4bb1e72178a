"""Token counts of whole texts by overlap resynchronisation.

A text longer than ``chunk_chars`` is encoded in overlapping chunks with offsets.
Two neighbours are spliced at a position where both start a pre-token.  The
pre-tokenizers in use scan from left to right without looking behind, so from a
common start on both chunks continue alike; the position must also lie so far
from the end of the left chunk that no look-ahead or special string reaches
beyond it.  Without such a position the overlap is doubled, up to the last
proven boundary, from where the new chunk is right by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.tokenization import library

BATCH_BYTES = 1 << 20


class _Starts:
    """Where pre-tokens of ``text[at:to]`` start, in characters, and how many tokens precede each."""

    def __init__(self, tokenizer, text: str, at: int, to: int):
        got = tokenizer.encode(text[at:to], add_special_tokens=False)
        self.at, self.to, self.tokens = at, to, len(got.ids)
        words = got.word_ids
        first = [i for i, w in enumerate(words) if not i or w is None or w != words[i - 1]]
        offsets = got.offsets
        self.index = np.asarray(first, dtype=np.int64)
        self.place = np.asarray([offsets[i][0] + at for i in first], dtype=np.int64)

    def before(self, place: int) -> int:
        """Tokens ahead of the pre-token that starts at ``place``."""
        return 0 if place == self.at else int(self.index[np.searchsorted(self.place, place)])


def spliced_count(tokenizer, text: str, chunk_chars: int, overlap: int) -> tuple[int, int, int]:
    """Tokens, chunks and widened overlaps of one text."""
    margin = 2 + max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)
    proven, total, chunks, widened = 0, 0, 1, 0
    left = _Starts(tokenizer, text, 0, min(len(text), chunk_chars))
    while left.to < len(text):
        reach = max(overlap, margin)
        while True:
            at, to = max(proven, left.to - reach), min(len(text), left.to + chunk_chars)
            right = _Starts(tokenizer, text, at, to)
            chunks += 1
            common = np.intersect1d(left.place, right.place)
            common = common[(common > proven) & (common <= left.to - margin)]
            if len(common) or at == proven:
                break
            reach, widened = reach * 2, widened + 1
        if at > proven:
            place = int(common[-1])
            total += left.before(place) - left.before(proven)
            proven = place
        left = right
    return total + left.tokens - left.before(proven), chunks, widened


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    chunk_chars: int = 1 << 16,
    overlap: int = 256,
) -> DataFrame:
    """Tokens of every text: ``id_col``, ``n_bytes``, ``n_tokens``, ``n_chunks``, ``n_widened``.

    One row out for each row in, repeated rows and null ids included; an empty table gives
    no rows.  Very long texts are counted whole, chunk by chunk.  A null or empty text has 0 bytes and 0 tokens.  Other columns of ``docs`` are not read.
    No shuffle; a worker holds one Arrow batch and the encodings of one chunk or of
    ``BATCH_BYTES`` of short texts.
    """
    if chunk_chars < 64 or overlap < 1:
        raise ValueError("chunk_chars must be 64 at least and overlap 1")
    slim = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        tok = library(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = [len(t.encode()) for t in texts]
            found = [(0, 1, 0)] * len(texts)
            group, held = [], 0
            for i, t in enumerate(texts):
                if len(t) > chunk_chars:
                    found[i] = spliced_count(tok, t, chunk_chars, overlap)
                elif t:
                    group.append(i)
                    held += sizes[i]
                if group and (held > BATCH_BYTES or i == len(texts) - 1):
                    for k, e in zip(group, tok.encode_batch_fast([texts[k] for k in group], add_special_tokens=False)):
                        found[k] = (len(e), 1, 0)
                    group, held = [], 0
            if group:
                for k, e in zip(group, tok.encode_batch_fast([texts[k] for k in group], add_special_tokens=False)):
                    found[k] = (len(e), 1, 0)
            counts = [pa.array(list(c), pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *counts], names=["key", "n_bytes", "n_tokens", "n_chunks", "n_widened"])

    kind = slim.schema["key"].dataType.simpleString()
    out = slim.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, n_chunks long, n_widened long")
    return out.withColumnRenamed("key", id_col)
