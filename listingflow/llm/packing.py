"""Packing documents into fixed-length sequences by minimum bin slack.

Every document gives as many full sequences as it fills; what remains of it is
shorter than a sequence and waits in a bounded window.  A sequence takes the
longest remainder and then the multiset of other remainders whose lengths sum
closest to what is left: a subset-sum over the bits of an integer, built from
long to short until the sum is met, with the counts found by going back through
the stored states.  Where even the best multiset leaves slack, one waiting
remainder is cut to fill it.  The last sequence of a partition is cut into
powers of two, which need no padding.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.tokenization import IdEncoder

SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length give the sum closest to ``capacity`` from below.

    ``counts``: how many there are of each length.  States are integers whose bit
    s says that the sum s can be met; lengths enter in powers of two of their counts.
    """
    full, states, steps = (1 << (capacity + 1)) - 1, [1], []
    for length in sorted((n for n, c in counts.items() if c and n <= capacity), reverse=True):
        left, power = min(counts[length], capacity // length), 1
        while left:
            take = min(power, left)
            steps.append((length, take))
            states.append(states[-1] | states[-1] << (length * take) & full)
            left, power = left - take, power * 2
        if states[-1] >> capacity & 1:
            break
    total, used = states[-1].bit_length() - 1, defaultdict(int)
    for (length, take), before in zip(reversed(steps), reversed(states[:-1])):
        if not before >> total & 1:
            used[length] += take
            total -= length * take
    return dict(used)


class Packer:
    """Packs a stream of documents; holds fewer than ``window`` remainders and one document."""

    def __init__(self, capacity: int, window: int, first_sequence: int):
        self.capacity, self.window, self.next = capacity, window, first_sequence
        self.waiting: dict[int, list] = defaultdict(list)
        self.counts: dict[int, int] = defaultdict(int)
        self.n = 0
        self.out: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        at = 0
        for key, start, ids, tokens in pieces:
            self.out.append((key, start, len(ids), ids.tobytes(), tokens, self.next, at))
            at += len(ids)
        self.next += 1

    def _hold(self, piece: tuple) -> None:
        self.waiting[len(piece[2])].append(piece)
        self.counts[len(piece[2])] += 1
        self.n += 1

    def _take(self, length: int) -> tuple:
        self.counts[length] -= 1
        self.n -= 1
        if not self.counts[length]:
            del self.counts[length]
        return self.waiting[length].pop()

    def add(self, key, ids: np.ndarray) -> None:
        full = len(ids) // self.capacity * self.capacity
        for at in range(0, full, self.capacity):
            self._emit([(key, at, ids[at : at + self.capacity], len(ids))])
        if full < len(ids):
            self._hold((key, full, ids[full:].copy(), len(ids)))
        if self.n >= self.window:
            while self.n > self.window // 2:
                self._fill()

    def _fill(self) -> None:
        pieces = [self._take(max(self.counts))]
        left = self.capacity - len(pieces[0][2])
        for length, times in closest_fill(self.counts, left).items():
            pieces += [self._take(length) for _ in range(times)]
            left -= length * times
        if left and self.counts:
            key, start, ids, tokens = self._take(min(n for n in self.counts if n > left))
            pieces.append((key, start, ids[:left], tokens))
            self._hold((key, start + left, ids[left:], tokens))
            left = 0
        if left:
            self._powers(pieces)
        else:
            self._emit(pieces)

    def _powers(self, pieces: list) -> None:
        """The last sequence, cut into powers of two from large to small."""
        total = sum(len(p[2]) for p in pieces)
        for size in (1 << b for b in reversed(range(total.bit_length())) if total >> b & 1):
            part = []
            while size:
                key, start, ids, tokens = pieces.pop(0)
                part.append((key, start, ids[:size], tokens))
                if len(ids) > size:
                    pieces.insert(0, (key, start + size, ids[size:], tokens))
                size -= len(part[-1][2])
            self._emit(part)

    def finish(self) -> None:
        while self.counts:
            self._fill()

    def drain(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    tokenizer: str = "byte_bpe_50k.json",
    separator: int = 0,
    window: int = 4096,
) -> DataFrame:
    """Pieces of documents in sequences of at most ``capacity`` ids.

    Returns ``id_col``, ``start``, ``length``, ``ids`` (unsigned 32-bit, little-endian),
    ``doc_tokens``, ``sequence_id`` and ``offset``.  A document is its ids and then
    ``separator``; a null or empty text is the separator alone.  Every id lies in one
    piece; repeated rows are packed as often as they occur.  Other columns of ``docs``
    are not read; an empty table gives no pieces.  A very long text is encoded whole and cut into pieces, which one task holds at once.

    Each partition packs its own documents in one pass without a shuffle and numbers
    its sequences above ``partition << 40``, so the work grows with the number of
    partitions alone and a lost task is simply run again.  A task holds ``window``
    remainders of less than ``capacity`` ids.
    """
    slim = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches):
        encoder = IdEncoder(tokenizer)
        packer = Packer(capacity, window, TaskContext.get().partitionId() << 40)
        end = np.asarray([separator], dtype=np.uint32)
        keys, held = None, 0

        def rows():
            got = list(zip(*packer.drain()))
            kinds = (keys, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            names = ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(got, kinds)], names=names)

        for batch in batches:
            keys = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encoder.ids(text.as_py() or ""), end]).astype("<u4")
                packer.add(key, ids)
                held += len(ids)
                if held > 1 << 20 and packer.out:
                    yield rows()
                    held = 0
        packer.finish()
        if packer.out:
            yield rows()

    return slim.mapInArrow(run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", id_col)
