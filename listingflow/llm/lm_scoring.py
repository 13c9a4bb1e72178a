"""LM scoring: a causal self-attention model in numpy, and a smoothed unigram base.

The model reads subword ids.  The 1,023 most frequent ids have states of their own; all
others share one, to which those of the two halves of their number are added, so that all are
told apart.  One attention layer with a learned weight for each distance and a small
feed-forward layer correct the log probabilities of smoothed pair counts.  The softmax has two
levels, 32 groups of 32; within the class of rarer ids an id has its share of the
training counts.  Counts cover all training texts.  The weights are trained on every window
of all of them, by trainers that start alike and whose weights are averaged; a trainer
takes a fixed number of windows, dealt by hash, so neither its time nor the scores depend on
the cluster.  For scoring, windows overlap: the first places of a window are context
only and the rest is scored, so each id counts once.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.common import staged, unstage
from listingflow.llm.tokenization import IdEncoder

STEP, SPAN = 48, 64  # ids scored and seen in a window
BEFORE = SPAN - STEP
GROUP = 32
KNOWN = GROUP * GROUP  # the last stands for all rarer ids
WIDTH = 32
PAD = 0xFFFF
TOGETHER, BATCH = 48, 96  # windows scored and learned at once
BLOCK = 16  # rows of a product that are rounded alike
TAKEN = 1 << 18  # ids put into windows at once, or one text
NEAR = 48  # windows whose gradients are taken at once, so that they stay in the cache
SCALE = float(1 << 32)  # of weights as whole numbers, whose sums don't depend on their order
LOG10 = math.log(10.0)
HIGH, LOW = KNOWN + 1, KNOWN + 257  # where the rows of the two halves of rarer ids begin
ROOT = np.float32(1 / math.sqrt(WIDTH))
SAFE = 40.0  # sums of exp of values nearer to 0 are far from the limits of short numbers


class Counts:
    """What counts over the training texts say: which ids are known, shares among the rarer, and log probabilities of pairs."""

    def __init__(self, by_id: np.ndarray, end: int):
        self.end = end
        smooth = by_id + 0.5
        order = np.argsort(-by_id, kind="stable")
        order = np.concatenate([[end], order[order != end]])
        self.known_of = np.full(PAD + 1, KNOWN - 1, np.int64)
        self.known_of[order[: KNOWN - 1]] = np.arange(min(KNOWN - 1, len(order)))
        rare = order[KNOWN - 1 :]
        self.share = np.zeros(PAD + 1, np.float32)
        self.share[rare] = np.log(smooth[rare] / smooth[rare].sum())
        self.one = np.bincount(self.known_of[: len(by_id)], smooth, KNOWN)
        self.one = np.maximum(self.one, 1e-9) / np.maximum(self.one, 1e-9).sum()

    def pair(self, places: np.ndarray, n: np.ndarray) -> None:
        """``places``: first * KNOWN + second; unseen pairs share as much as there are kinds of seen ones."""
        two = np.zeros(KNOWN * KNOWN)
        two[places] = n
        two = two.reshape(KNOWN, KNOWN)
        kinds = np.maximum((two > 0).sum(1, keepdims=True), 1)
        p = (two + kinds * self.one) / (two.sum(1, keepdims=True) + kinds)
        p = p.reshape(KNOWN, GROUP, GROUP)
        group = p.sum(2)
        self.group = np.log(group).astype(np.float32)
        self.member = np.log(p / group[:, :, None]).astype(np.float32)


def _flat(a: np.ndarray) -> np.ndarray:
    return a.reshape(-1, a.shape[-1])


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` for a matrix ``b``, as one product whatever the shape of ``a``."""
    return (_flat(a) @ b).reshape(*a.shape[:-1], b.shape[1])


def _sums(z: np.ndarray) -> np.ndarray:
    """Sums of the last axis, which as a product take a fifth of the time."""
    return _times(z, np.ones((z.shape[-1], 1), z.dtype))


def _far(z: np.ndarray, most: float = SAFE) -> tuple:
    """The rows with a value so far from 0 that ``exp`` must not be taken of it as it is.  No row's result depends on the others."""
    if z.size == 0 or (z.max() < most and z.min() > -most):
        return ()
    return np.nonzero(~((z < most) & (z > -most)).all(axis=-1))  # so are values that are no numbers


def _lower(z: np.ndarray, rows: tuple) -> np.ndarray:
    """``z`` with the largest value of each of ``rows`` taken from them, in place."""
    if len(rows):
        z[rows] -= z[rows].max(axis=-1, keepdims=True)
    return z


def _softmax(z: np.ndarray) -> np.ndarray:
    z = _lower(z, _far(z))
    np.exp(z, out=z)
    z *= 1 / _sums(z)
    return z


def _log_share(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log softmax of ``z`` at one place of each row."""
    z = _lower(z, _far(z))
    own = z[np.arange(len(z)), at]
    return own - np.log(_sums(np.exp(z, out=z))[:, 0])


def _summed(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The sums of ``rows`` by their place ``at`` among ``n``."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at.astype(np.uint16), kind="stable")  # short numbers are sorted by their digits
        place = at[order]
        first = np.nonzero(np.diff(place, prepend=-1))[0]
        out[place[first]] = np.add.reduceat(rows.take(order, axis=0), first, axis=0)
    return out


def _halves(from_: int) -> list[tuple[int, int]]:
    """Where the places from ``from_`` on are parted, as those of the first half see nothing of the second."""
    return [(from_, (from_ + SPAN) // 2), ((from_ + SPAN) // 2, SPAN)]


class AttentionModel:
    SHAPES = {
        "by_id": (KNOWN + 1, WIDTH), "high": (PAD // 256 + 1, WIDTH), "low": (256, WIDTH), "qkv": (WIDTH, 3 * WIDTH), "back": (WIDTH, WIDTH), "far": (SPAN,),
        "up": (WIDTH, 2 * WIDTH), "at": (2 * WIDTH,), "down": (2 * WIDTH, WIDTH), "group": (WIDTH, GROUP), "member": (GROUP, WIDTH, GROUP),
    }

    def __init__(self, counts: Counts, weights: dict | None = None):
        self.counts = counts
        if weights is None:
            r = np.random.default_rng(11)
            weights = {n: (r.standard_normal(s) * 0.15).astype(np.float32) for n, s in self.SHAPES.items()}
            for n in ("far", "at", "group", "member"):
                weights[n][:] = 0
        self.w = weights
        distance = np.arange(SPAN)[:, None] - np.arange(SPAN)[None, :]
        self.distance = np.maximum(distance, 0)
        self.causal = distance >= 0

    def onward(self) -> np.ndarray:
        """From an input to its query, by the root of their width, its key, and what its value adds to a state."""
        q, k, v = np.split(self.w["qkv"], 3, axis=1)
        return np.concatenate([q * ROOT, k, v @ self.w["back"]], axis=1)

    def rows(self) -> np.ndarray:
        """Input, query, key and value of each known id, of padding, and of each half of a rarer number.

        No place is part of an input, so those of every place are sums of these, and scoring computes them once.
        """
        e = np.concatenate([self.w["by_id"], self.w["high"], self.w["low"]])
        return np.concatenate([e, e @ self.onward()], axis=1)

    def forward(self, ids: np.ndarray, from_: int, rows: np.ndarray | None = None) -> tuple:
        """The state after each place from ``from_`` on in every window, and what led to it; ``rows`` are those of the weights at hand, if there are any."""
        w = self.w
        pad = ids == PAD
        c = self.counts.known_of[ids]
        c[pad] = KNOWN
        x = (w["by_id"] if rows is None else rows).take(c, axis=0)
        rare = np.nonzero(c == KNOWN - 1)  # told apart by the two halves of their number
        if len(rare[0]):
            high, low = (w["high"], w["low"]) if rows is None else (rows[HIGH:LOW], rows[LOW:])
            x[rare] += high.take(ids[rare] >> 8, axis=0) + low.take(ids[rare] & 255, axis=0)
        x, *qkv = (x, *np.split(_times(x, self.onward()), 3, axis=-1)) if rows is None else np.split(x, 4, axis=-1)
        q, k, v = qkv
        seen = np.where(self.causal, w["far"][self.distance], -1e9).astype(np.float32)
        padded = np.nonzero(pad.any(axis=1))[0]
        unseen = pad[padded][:, None, :] & (self.distance[None] > 0)
        shares, mixed = [], np.empty((len(ids), SPAN - from_, WIDTH), np.float32)
        for a, b in _halves(from_):
            s = q[:, a:b] @ k[:, :b].transpose(0, 2, 1)
            low = _far(s, SAFE / 2) if np.abs(w["far"]).max() < SAFE / 2 else np.nonzero(np.ones(s.shape[:2]))  # all that these see may be far below 0
            s += seen[a:b, :b]
            if len(padded):
                s[padded] = np.where(unseen[:, a:b, :b], np.float32(-1e9), s[padded])
            shares.append(np.exp(_lower(s, low), out=s))
            np.matmul(s, v[:, :b], out=mixed[:, a - from_ : b - from_])
        shrink = 1 / np.concatenate([_sums(s) for s in shares], axis=1)  # what follows is shorter than a row of shares, so it is divided instead
        mixed *= shrink
        y = mixed + x[:, from_:]
        u = _times(y, w["up"])
        u += w["at"]
        np.maximum(u, 0, out=u)
        state = _times(u, w["down"])
        state += y
        return state, (c, rare, x, q, k, v, shares, shrink, mixed, y, u)

    def _in_groups(self, state: np.ndarray, prev: np.ndarray, known: np.ndarray, block: int = 1):
        """The order of places by the group of ``known``, states in it, their logits within the group, where groups begin and end, and which rows are no filling: groups are filled up to whole ``block`` s."""
        group = known // GROUP
        n = np.bincount(group, minlength=GROUP)
        edge = np.concatenate([[0], np.cumsum(-(-n // block) * block)])
        own = np.arange(len(group)) + np.repeat(edge[:-1] - np.cumsum(n) + n, n)
        order = np.zeros(edge[-1], np.int64)
        order[own] = np.argsort(group.astype(np.uint8), kind="stable")
        in_group = np.repeat(np.arange(GROUP), np.diff(edge))
        held = state.take(order, axis=0)
        z = _flat(self.counts.member).take(prev[order] * GROUP + in_group, axis=0)
        spans = [(g, slice(edge[g], edge[g + 1])) for g in range(GROUP) if edge[g] < edge[g + 1]]
        more = np.empty_like(held)
        for g, at in spans:
            np.matmul(held[at], self.w["member"][g], out=more[at])
        z += more
        return order, held, z, spans, own

    def log_likelihood(self, ids: np.ndarray, after: np.ndarray, from_: int, rows: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of each of ``after``; 0 where it is padding."""
        state, (c, *_) = self.forward(ids, from_, rows)
        # places after padding are taken along and groups filled up, as products round the rows beyond whole blocks otherwise
        state, prev, target = _flat(state), np.minimum(c[:, from_:].ravel(), KNOWN - 1), after.ravel()
        known = self.counts.known_of[target]
        z = state @ self.w["group"]
        z += self.counts.group.take(prev, axis=0)
        got = _log_share(z, known // GROUP)
        order, _, z, _, own = self._in_groups(state, prev, known, BLOCK)
        got[order[own]] += _log_share(z, known[order] % GROUP)[own]
        got += self.counts.share[target] * (known == KNOWN - 1)
        return np.where(after != PAD, got.reshape(after.shape), 0.0).astype(np.float64)

    def gradients(self, ids: np.ndarray, after: np.ndarray, from_: int) -> dict:
        """Of the mean loss over the places from ``from_`` on; ``after`` are the ids that follow those."""
        n = max(1, int(((after != PAD) & (ids[:, from_:] != PAD)).sum()))
        total: dict = {}
        for at in range(0, len(ids), NEAR):
            for name, g in self._gradients(ids[at : at + NEAR], after[at : at + NEAR], from_, n).items():
                if name in total:
                    total[name] += g
                else:
                    total[name] = g
        q, v = slice(WIDTH), slice(2 * WIDTH, None)
        total["back"] = self.w["qkv"][:, v].T @ total["qkv"][:, v]
        total["qkv"][:, q] *= ROOT
        total["qkv"][:, v] = total["qkv"][:, v] @ self.w["back"].T
        return total

    def _gradients(self, ids: np.ndarray, after: np.ndarray, from_: int, n_places: int) -> dict:
        """Of the summed loss, divided by ``n_places``; those of ``qkv`` and ``back`` are as :meth:`onward` has them."""
        w, g = self.w, {}
        state, (c, rare, x, q, k, v, shares, shrink, mixed, y, u) = self.forward(ids, from_)
        real = np.nonzero(((after != PAD) & (ids[:, from_:] != PAD)).ravel())[0]
        h, prev, known = _flat(state).take(real, axis=0), c[:, from_:].ravel()[real], self.counts.known_of[after.ravel()[real]]
        z = h @ w["group"]
        z += self.counts.group.take(prev, axis=0)
        z = _softmax(z)
        z[np.arange(len(z)), known // GROUP] -= 1
        z *= np.float32(1 / n_places)
        g["group"], dh = h.T @ z, z @ w["group"].T
        order, held, z, spans, _ = self._in_groups(h, prev, known)
        z = _softmax(z)
        z[np.arange(len(z)), known[order] % GROUP] -= 1
        z *= np.float32(1 / n_places)
        g["member"], back = np.zeros(self.SHAPES["member"], np.float32), np.empty_like(held)
        for n, at in spans:
            np.matmul(held[at].T, z[at], out=g["member"][n])
            np.matmul(z[at], w["member"][n].T, out=back[at])
        dh[order] += back
        dstate = np.zeros((after.size, WIDTH), np.float32)
        dstate[real] = dh
        g["down"] = _flat(u).T @ dstate
        du = dstate @ w["down"].T
        du *= _flat(u) > 0
        g["up"], g["at"] = _flat(y).T @ du, du.sum(0)
        dstate += du @ w["up"].T
        dy = dstate.reshape(state.shape)
        dm = dy * shrink
        less = _sums(dm * mixed)  # which is the sum of ds by shares
        d, far = np.empty((*c.shape, 3 * WIDTH), np.float32), np.zeros((SPAN, SPAN))
        dq, dk, dv = np.split(d, 3, axis=-1)
        dq[:, :from_] = 0
        for (a, b), s in zip(_halves(from_)[::-1], shares[::-1]):  # the second half first, as it reaches all places
            own = dm[:, a - from_ : b - from_]
            ds = own @ v[:, :b].transpose(0, 2, 1)
            ds -= less[:, a - from_ : b - from_]
            ds *= s
            far[a:b, :b] = ds.sum(0)
            np.matmul(ds, k[:, :b], out=dq[:, a:b])
            if b == SPAN:
                np.matmul(ds.transpose(0, 2, 1), q[:, a:b], out=dk)
                np.matmul(s.transpose(0, 2, 1), own, out=dv)
            else:
                dk[:, :b] += ds.transpose(0, 2, 1) @ q[:, a:b]
                dv[:, :b] += s.transpose(0, 2, 1) @ own
        g["far"] = np.bincount(self.distance.ravel(), (far * self.causal).ravel(), SPAN).astype(np.float32)
        g["qkv"] = _flat(x).T @ _flat(d)
        dx = _times(d, self.onward().T)
        dx[:, from_:] += dy
        g["by_id"] = _summed(_flat(dx), c.ravel(), KNOWN + 1)
        g["high"], g["low"] = (_summed(dx[rare], at.astype(np.int64), len(w[n])) for n, at in (("high", ids[rare] >> 8), ("low", ids[rare] & 255)))
        return g

    def fit(self, batches, steps: int, rate: float = 0.01, state: tuple | None = None) -> tuple:
        """Adam over ``batches`` of (ids, next ids), at a rate that falls to a twentieth by ``steps``; returns its state, which a later call goes on from: two kinds of moments, and how many batches there were."""
        m, v, t = state or ({n: np.zeros(s, np.float32) for n, s in self.SHAPES.items()}, {n: np.zeros(s, np.float32) for n, s in self.SHAPES.items()}, 0)
        own, m, v = ({n: a.astype(np.float32) for n, a in x.items()} for x in (self.w, m, v))  # copies, as they are changed in place
        self.w = own
        for ids, after in batches:
            now = rate * max(0.05, 1 - t / max(1, steps))
            t += 1
            for n, g in self.gradients(ids, after, SPAN - after.shape[1]).items():
                m[n] *= np.float32(0.9)
                m[n] += np.float32(0.1) * g
                g *= g
                g *= np.float32(0.01)
                v[n] *= np.float32(0.99)
                v[n] += g
                np.divide(v[n], np.float32(1 - 0.99**t), out=g)
                np.sqrt(g, out=g)
                g += np.float32(1e-8)
                np.divide(m[n], g, out=g)
                g *= np.float32(now / (1 - 0.9**t))
                own[n] -= g
        return m, v, t


def windows_of(ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of inputs and of the ids that follow them.

    The inputs are ``end`` and then ``ids``; what follows are ``ids`` and then ``end``.
    Window k has the inputs from k * STEP - BEFORE on; those before the first are padding.
    """
    n = len(ids) + 1
    chunks = -(-n // STEP)
    line = np.full(BEFORE + STEP * chunks, PAD, np.uint16)
    after = np.full(BEFORE + STEP * chunks, PAD, np.uint16)
    line[BEFORE], line[BEFORE + 1 : BEFORE + n] = end, ids
    after[BEFORE : BEFORE + n - 1], after[BEFORE + n - 1] = ids, end
    view = lambda a: np.lib.stride_tricks.sliding_window_view(a, SPAN)[::STEP]
    return view(line), view(after)


def windows_of_texts(column: pa.Array, end: int):
    """The windows of :func:`windows_of` for a column of ids as bytes, by parts of a bounded number of ids.

    Yields the lines of inputs and of the ids that follow them with all texts of a part one after the other, where each window begins there,
    the place of its text in the column, and its place in the text.
    """
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    edges = np.flatnonzero(np.diff(np.cumsum(sizes + 1) // TAKEN)) + 1
    for first, last in zip([0, *edges], [*edges, len(sizes)]):
        ids = np.frombuffer(b"".join(column.slice(first, last - first).to_pylist()), "<u2")
        n = sizes[first:last]
        chunks = -(-(n + 1) // STEP)
        room = BEFORE + STEP * chunks
        begin = np.cumsum(room) - room
        line, after = np.full(room.sum(), PAD, np.uint16), np.full(room.sum(), PAD, np.uint16)
        at = np.arange(len(ids)) + np.repeat(begin + BEFORE - (np.cumsum(n) - n), n)
        line[begin + BEFORE], line[at + 1] = end, ids
        after[begin + BEFORE + n], after[at] = end, ids
        place = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        yield line, after, np.repeat(begin, chunks) + place * STEP, np.repeat(np.arange(first, last), chunks), place


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _lowered(text: str | None) -> str:
    return (text or "").encode().lower().decode()


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    folds: int = 5,
    held: int = 1,
    frequent: int = 200_000,
    windows_each: int = 1 << 16,
    rounds: int = 8,
) -> DataFrame:
    """Scores of every whole text; A-Z count as a-z, a null text is empty.

    Returns ``id_col``, ``held_out`` (crc32 of the id as text, modulo ``folds``, is
    ``held``), ``n_tokens`` (words and one end), ``n_known``, ``train_tokens``,
    ``base_score`` (log10 of the smoothed unigram) and ``score`` (log10 probability by the
    model, the end included).  A null id counts as the empty string.  Repeated rows stay; an
    empty table gives no rows; other columns are not read.  Very long texts are scored whole,
    window by window.  Without any training text all ids are alike.

    Words of a share of 1 / ``frequent`` or more of the training tokens, of which there are
    ``frequent`` at most, are broadcast; all others are counted by a join.
    Every window of every training text trains the weights once, about ``windows_each`` a trainer, in ``rounds`` of equal
    shares: each starts from the mean of what all trainers had learned in the rounds before.

    The pair counts, and so the groups of the output, know the ``KNOWN`` - 1 most frequent ids; on input all ids are told apart, on
    output the rarer ones share a place of the last group by their counts.  These are parameters of the model, alike at every size.
    """
    spark = docs.sparkSession
    end = IdEncoder(tokenizer).tokenizer.get_vocab_size()
    if end >= PAD:
        raise ValueError("ids must fit in 16 bits")
    size = end + 1
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).alias("key"), text.alias("text"), (F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held).alias("held_out"))
    kind = slim.schema["key"].dataType.simpleString()
    slim = slim.withColumn("row", F.monotonically_increasing_id())

    def encode(batches):
        encoder = IdEncoder(tokenizer)
        for batch in batches:
            found = [encoder.ids(_lowered(t.as_py())).astype("<u2").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=["key", "text", "held_out", "row", "ids"])

    coded = staged(slim.mapInArrow(encode, f"key {kind}, text string, held_out boolean, row long, ids binary"), "lm-ids")
    slim = coded.select("key", "text", "held_out", "row")  # the numbers of rows are those written

    # counts over all training texts
    def count_ids(batches):
        seen = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                seen += np.bincount(np.frombuffer(ids.as_py(), "<u2"), minlength=size)
                seen[end] += 1
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at])], names=["id", "n"])

    by_id = coded.where("not held_out").select("ids").mapInArrow(count_ids, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row for each id of the vocabulary at most
    seen_ids = np.zeros(size)
    for r in by_id:
        seen_ids[r["id"]] = r["n"]
    counts = Counts(seen_ids, end)
    known_of = counts.known_of

    def count_pairs(batches):
        seen = np.zeros(KNOWN * KNOWN, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                k = known_of[np.concatenate([[end], np.frombuffer(ids.as_py(), "<u2"), [end]])]
                np.add.at(seen, k[:-1] * KNOWN + k[1:], 1)
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at])], names=["at", "n"])

    pairs = coded.where("not held_out").select("ids").mapInArrow(count_pairs, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # KNOWN squared at most
    counts.pair(pairs["at"].to_numpy(), pairs["n"].to_numpy())

    model = _train(coded.where("not held_out"), counts, windows_each, rounds)
    shared = spark.sparkContext.broadcast((counts, model))

    def score(batches):
        net, seen = AttentionModel(*shared.value), np.arange(SPAN)
        own = net.rows()
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for line, after, begin, owner, _ in windows_of_texts(batch.column(2), end):
                for at in range(0, len(begin), TOGETHER):
                    here = begin[at : at + TOGETHER, None] + seen
                    np.add.at(total, owner[at : at + TOGETHER], net.log_likelihood(line[here], after[here[:, BEFORE:]], BEFORE, own).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total / LOG10)], names=["key", "row", "score"])

    scored = coded.select("key", "row", "ids").mapInArrow(score, f"key {kind}, row long, score double").select("row", "score")

    # words of all training texts
    def count_words(batches):
        seen: Counter = Counter()
        ends = 0
        for batch in batches:
            for t in batch.column(0):
                seen.update(_words(t.as_py()))
                ends += 1
            if len(seen) > 500_000:
                yield rows(seen)
                seen = Counter()
        seen[b""] = ends  # no word is empty, so this can stand for the end
        yield rows(seen)

    def rows(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

    words = slim.where("not held_out").select("text").mapInArrow(count_words, "word binary, c long").where("c > 0").groupBy("word").agg(F.sum("c").alias("c"))
    words = staged(words, "lm-words")
    about = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_all, distinct = about["n"] or 0, about["v"]
    scale = n_all + 0.5 * (distinct + 1)
    known = {bytes(r["word"]): r["c"] for r in words.where(F.col("c") >= max(1, n_all / frequent)).collect()}  # frequent of them at most
    common = spark.sparkContext.broadcast({w: math.log10((c + 0.5) / scale) for w, c in known.items()})

    def split(batches):
        """For each text a row with the sum of its frequent words; for each other word of it a row with its count."""
        value = common.value
        names = ["key", "held_out", "row", "word", "times", "n_tokens", "n_known", "part"]
        for batch in batches:
            out = [[] for _ in names[3:]]
            take = []
            for i, t in enumerate(batch.column(1)):
                own, part, hits, n = [], 0.0, 0, 1
                for w, c in Counter(_words(t.as_py())).items():
                    n += c
                    if (x := value.get(w)) is None:
                        own.append((w, c))
                    else:
                        part, hits = part + c * x, hits + c
                if (x := value.get(b"")) is None:
                    own.append((b"", 1))
                else:
                    part, hits = part + x, hits + 1
                for word, times, a, b, c in [(None, 0, n, hits, part), *((w, c, 0, 0, 0.0) for w, c in own)]:
                    take.append(i)
                    for column, x in zip(out, (word, times, a, b, c)):
                        column.append(x)
            at = pa.array(take, pa.int64())
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(j).take(at) for j in (0, 2, 3)] + [pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    parts = slim.mapInArrow(split, f"key {kind}, held_out boolean, row long, word binary, times long, n_tokens long, n_known long, part double")
    parts = staged(parts, "lm-parts")
    rare = words.where(F.col("c") < max(1, n_all / frequent)).select(F.col("word").alias("w"), "c")
    worth = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(float(scale)))
    looked = parts.where("word is not null").select("row", "word", "times").join(rare, F.col("word") == F.col("w"), "left")
    looked = looked.select("row", F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("n_known"), (F.col("times") * worth).alias("part"))
    firsts = parts.where("word is null")
    sums = looked.unionByName(scored.select("row", F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("part"), "score"), allowMissingColumns=True)
    sums = sums.groupBy("row").agg(F.sum("n_known").alias("more"), F.sum("part").alias("rest"), F.sum("score").alias("score"))
    out = firsts.select("key", "held_out", "row", "n_tokens", "n_known", "part").join(sums, "row", "left")
    return out.select(
        F.col("key").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        "score",
    )


def _dealt(coded: DataFrame, end: int, windows_each: int, turn: int = 0, rounds: int = 1) -> tuple[DataFrame, int, int]:
    """The windows of ``ids`` whose ``turn`` it is in one of ``rounds``, with the id after each (``line``), dealt to trainers; how many of these there are, and how many windows in all rounds.

    Windows are dealt and sorted by a hash of the row's id and ids and of their place in it.  Only rows that repeat in
    both are told apart by their number, so that repeats are spread.
    """

    def draw(batches):
        for batch in batches:
            keys = np.array([k % (1 << 64) for k in batch.column(0).to_pylist()], np.uint64)
            for line, after, begin, owner, place in windows_of_texts(batch.column(1), end):
                with np.errstate(over="ignore"):
                    h = keys[owner] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(31)
                own = np.flatnonzero((h >> np.uint64(32)) % np.uint64(rounds) == turn)
                here = begin[own, None] + np.arange(SPAN)
                a, b = line[here], after[here]
                b[:, :-1] = np.where(b[:, :-1] == PAD, a[:, 1:], b[:, :-1])  # the end before the first id; what follows padding isn't learned
                lines = pa.array(np.concatenate([a[:, :1], b], axis=1).view(f"V{2 * SPAN + 2}").ravel().tolist(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(h[own].view(np.int64)), lines], names=["mark", "line"])

    windows = coded.agg(F.sum(F.ceil((F.length("ids") / 2 + 1) / STEP))).first()[0] or 0
    trainers = max(1, -(-windows // windows_each))
    drawn = coded.select("k", "ids").mapInArrow(draw, "mark long, line binary")
    return drawn.repartition(trainers, "mark").sortWithinPartitions("mark", "line"), trainers, windows


def _marked(coded: DataFrame) -> DataFrame:
    """``ids`` and ``k``, a hash of the row's id and ids, with its number if rows repeat in both."""
    keyed = coded.select(F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit("")), "ids").alias("k"), "ids")
    repeats = staged(keyed.groupBy("k").count().where("count > 1").select(F.col("k").alias("again")), "lm-repeats")
    if repeats.isEmpty():
        return keyed
    numbered = keyed.withColumn("at", F.monotonically_increasing_id()).join(repeats, F.col("k") == F.col("again"), "left")
    return numbered.select(F.when(F.col("again").isNotNull(), F.xxhash64("k", "at")).otherwise(F.col("k")).alias("k"), "ids")


def _train(coded: DataFrame, counts: Counts, windows_each: int, rounds: int = 8) -> dict:
    """The weights after ``rounds``, in each of which every trainer goes on from the mean of all and takes its share of the windows, in the order of a hash."""
    spark, names, sizes = coded.sparkSession, list(AttentionModel.SHAPES), [math.prod(s) for s in AttentionModel.SHAPES.values()]
    marked = _marked(coded)
    split = lambda flat: {n: x.reshape(AttentionModel.SHAPES[n]).astype(np.float32) for n, x in zip(names, np.split(flat, np.cumsum(sizes)[:-1]))}
    model, moments = None, None
    for turn in range(rounds):
        dealt, trainers, windows = _dealt(marked, counts.end, windows_each, turn, rounds)
        steps = windows // trainers // BATCH
        start = spark.sparkContext.broadcast((counts, model, moments))

        def train(batches, start=start, steps=steps):
            counts, model, moments = start.value
            net = AttentionModel(counts, model and dict(model))  # what is shared stays as it is

            def some():
                held = np.zeros((0, SPAN + 1), "<u2")
                for batch in batches:
                    held = np.concatenate([held, np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, SPAN + 1)])
                    whole = len(held) // BATCH * BATCH
                    for at in range(0, whole, BATCH):
                        yield held[at : at + BATCH, :-1], held[at : at + BATCH, BEFORE + 1 :]
                    held = held[whole:]
                if len(held):
                    yield held[:, :-1], held[:, BEFORE + 1 :]

            m, v, t = net.fit(some(), steps, state=moments and (dict(moments[0]), dict(moments[1]), moments[2]))
            if t > (moments[2] if moments else 0):
                flat = np.concatenate([x[n].ravel() for x in (net.w, m, {n: np.sqrt(y) for n, y in v.items()}) for n in names] + [[t]])
                yield _row(1, flat, "<f4")

        got, left, add = staged(dealt.mapInArrow(train, "n long, weights binary"), "lm-trained"), trainers, _total_of_floats
        while left:  # sums of sums, so that the driver takes eight rows at most
            left = -(-left // 64) if left > 64 * 8 else 0
            total = staged(got.coalesce(left or 8).mapInArrow(add, "n long, weights binary"), "lm-totals", rows_per_batch=8)  # no shuffle, whose files would stay
            unstage(got)
            got, add = total, _total
        rows = got.collect()
        unstage(got)
        start.unpersist()
        if rows:
            mean = sum(np.frombuffer(r["weights"], "<i8") for r in rows) / (SCALE * sum(r["n"] for r in rows))
            w, m, root = np.split(mean[:-1], 3)
            model, moments = split(w), (split(m), split(root**2), round(mean[-1]))
    return model or AttentionModel(counts).w


def _row(n: int, weights: np.ndarray, kind: str = "<i8") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([weights.astype(kind).tobytes()], pa.binary())], names=["n", "weights"])


def _total_of_floats(batches):
    """Like :func:`_total`, of rows as trainers write them."""
    whole = lambda w: np.rint(np.frombuffer(w.as_py(), "<f4").astype(np.float64) * SCALE).astype(np.int64)
    return _total(_row(n, whole(w)) for batch in batches for n, w in zip(batch.column(0).to_pylist(), batch.column(1)))


def _total(batches):
    n, weights = 0, None
    for batch in batches:
        for k, w in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.frombuffer(w.as_py(), "<i8")
            n, weights = n + k, own if weights is None else weights + own
    if n:
        yield _row(n, weights)
