"""Mixture-controlled packing by deficit round-robin over source queues.

The queues are the sources. A window of `width` tokens owes each queue its share of the width; what a queue could not
get in whole tokens is its deficit, carried to the next window, and what an exhausted queue leaves goes to the others
by share. The schedule depends on nothing but the shares and the queues' lengths, so it is a function of the window's
number: after w windows queue j has had A_j(w) tokens, where the first w * width tokens in order of virtual time
(k-th token of j: k / share_j) are counted. Every task evaluates A for its own windows; deficits are thus carried
across windows and partitions without a chain of tasks, every window but the last is full, and no token is moved.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

MOST_BROADCAST = 50_000
#: The most numbers in a table of queues by windows.
MOST_CELLS = 4_000_000


class _Numbers(dict):
    """Numbers of pieces in order of their first coming; `fresh` holds those that came since it was emptied."""

    def __init__(self) -> None:
        self.fresh: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self.fresh.append(piece)
        n = self[piece] = len(self)
        return n


class Encoder:
    """Token ids of texts. The tokenizer reads a text piece by piece (letters, a digit, other marks); equal pieces have equal
    ids, so each is encoded once and kept, in bounded memory.

    A piece of letters ends in a token with the end-of-word mark, so many are encoded as one text. Texts with characters
    that are neither ASCII nor letters, or with the opening of a special token, go to the tokenizer as they are.
    """

    most = 1_000_000
    piece = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.wide = size > 65_536
        self.kind = "<u4" if self.wide else "<u2"
        self.ends = np.zeros(size + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.ids, self.start, self.count = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Keep the ids of the fresh pieces; a count of -1 marks those with a character neither ASCII nor a letter."""
        fresh, self.numbers.fresh = self.numbers.fresh, []
        texts = [p.decode("utf-8", "replace") for p in fresh]
        count = np.full(len(fresh), -1, np.int64)
        start = np.zeros(len(fresh), np.int64)
        letters = [i for i, t in enumerate(texts) if t.isalpha()]
        other = [i for i, t in enumerate(texts) if t.isascii() and not t.isalpha()]
        kept, at = [], len(self.ids)
        for lo in range(0, len(letters), 5000):
            some = np.array(letters[lo : lo + 5000])
            ids = np.array(self.tokenizer.encode(" ".join([texts[i] for i in some]), add_special_tokens=False).ids, self.kind)
            stops = np.nonzero(self.ends[ids])[0] + 1
            if len(stops) != len(some):
                other += some.tolist()
                continue
            begins = np.concatenate(([0], stops[:-1]))
            start[some], count[some] = at + begins, stops - begins
            kept.append(ids)
            at += len(ids)
        for i, ids in zip(other, self._each([texts[i] for i in other])):
            start[i], count[i] = at, len(ids)
            kept.append(ids)
            at += len(ids)
        self.ids = np.concatenate([self.ids, *kept])
        self.start, self.count = np.concatenate([self.start, start]), np.concatenate([self.count, count])

    def encode(self, texts: list[bytes | None], end: int | None) -> list[bytes]:
        """The ids of each text, as bytes, and the end token."""
        tail = b"" if end is None else int(end).to_bytes(4 if self.wide else 2, "little")
        if len(self.numbers) > self.most:
            self._forget()
        parts = [self.piece.findall(x.lower()) if x and b"<|" not in x else [] for x in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        if self.numbers.fresh:
            self._learn()
        count = self.count[flat]
        odd = np.nonzero(count < 0)[0]
        ends = np.cumsum(sizes)
        plain = set(np.searchsorted(ends, odd, side="right").tolist()) | {i for i, x in enumerate(texts) if x and b"<|" in x}
        count = np.maximum(count, 0)
        stops = np.cumsum(count)
        ids = self.ids[np.repeat(self.start[flat] - stops + count, count) + np.arange(int(stops[-1]) if len(stops) else 0)].tobytes()
        step = 4 if self.wide else 2
        upto = np.concatenate(([0], stops))[ends] * step
        out, at = [], 0
        for i, stop in enumerate(upto.tolist()):
            out.append((self._each([texts[i].decode("utf-8", "replace")])[0].tobytes() if i in plain else ids[at:stop]) + tail)
            at = stop
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokens(docs: DataFrame, path: str, end: int | None = 1) -> DataFrame:
    """doc_id, queue, n, ids (16- or 32-bit little-endian), part, and before: the tokens of its queue ahead of it in its part."""
    small_batches(docs.sparkSession, 500)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.col("text").cast("binary").alias("text"), "queue")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, had, enc = TaskContext.get().partitionId(), {}, encoder(path)
        step = 4 if enc.wide else 2
        for batch in batches:
            ids = enc.encode(batch.column(1).to_pylist(), end)
            before = []
            for queue, x in zip(batch.column(2).to_pylist(), ids):
                before.append(had.get(queue, 0))
                had[queue] = before[-1] + len(x) // step
            n = pa.array([len(x) // step for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n, pa.array(ids, pa.binary()), pa.array([part] * len(ids), pa.int64()), pa.array(before, pa.int64())], ["doc_id", "queue", "n", "ids", "part", "before"])

    return slim.mapInArrow(run, f"doc_id {id_type}, queue string, n long, ids binary, part long, before long")


class Schedule:
    """A_j(w): the tokens that queue j has had before window w."""

    def __init__(self, lengths: list[int], shares: list[float], width: int) -> None:
        self.lengths, self.shares, self.width = np.array(lengths, np.int64), np.array(shares, float), width
        self.total = int(self.lengths.sum())
        done = self.lengths / self.shares
        ends = np.unique(np.concatenate(([0.0], done)))
        order = np.argsort(done, kind="stable")  # queues in order of their end; sums instead of a table of queues by ends
        over = np.searchsorted(done[order], ends, side="right")
        had = np.concatenate(([0], np.cumsum(self.lengths[order])))
        rate = np.concatenate((np.cumsum(self.shares[order][::-1])[::-1], [0.0]))
        self.times, self.served = ends, had[over] + rate[over] * ends

    def _had(self, t: np.ndarray) -> np.ndarray:
        return np.minimum(self.lengths, np.floor(self.shares * t[:, None]).astype(np.int64))

    def before(self, windows: np.ndarray) -> np.ndarray:
        """Rows of A for windows, each summing to min(w * width, total)."""
        want = np.minimum(windows.astype(np.int64) * self.width, self.total)
        slack = len(self.lengths) + 1
        low, high = (np.interp(np.clip(want + d, 0, self.total), self.served, self.times) for d in (-slack, slack))
        for _ in range(24):
            mid = (low + high) / 2
            over = self._had(mid).sum(axis=1) > want
            low, high = np.where(over, low, mid), np.where(over, mid, high)
        had = self._had(low)
        short = want - had.sum(axis=1)
        while (short > 0).any():  # the next tokens in virtual time, ties to the first queue
            due = np.where(had < self.lengths, (had + 1) / self.shares, np.inf)
            rank = np.argsort(np.argsort(due, axis=1, kind="stable"), axis=1)
            had = had + ((rank < short[:, None]) & (had < self.lengths))
            short = want - had.sum(axis=1)
        return had

    def column(self, windows: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        """A_j for windows, and the sum of A over the queues ahead of j, from tables of bounded size."""
        most = max(1, MOST_CELLS // max(1, len(self.lengths)))
        tables = (self.before(windows[k : k + most]) for k in range(0, len(windows), most))
        mine, ahead = zip(*((t[:, j], t[:, :j].sum(axis=1)) for t in tables))
        return np.concatenate(mine), np.concatenate(ahead)


def pack(docs: DataFrame, tokenizer_path: str | None = None, width: int = 2048, end: int | None = 1, weights: dict[str | None, float] | None = None) -> DataFrame:
    """Pieces of docs (doc_id, text, source): doc_id, source, start, length, ids (32-bit little-endian), doc_tokens, sequence_id, offset.

    weights: the target share of tokens of each source while it lasts (those not named: 0.0001 of the least), by default
    the sources' own shares, so that every window mirrors the whole. Each token lies in one piece; sequences are full
    but the last. Null texts are empty and hold the end token only; without end token they have no piece. A null source
    is a queue of its own. Each source has its own queue, at every number of sources. Repeated rows are packed each. An
    empty table gives none.
    """
    spark = docs.sparkSession
    path = tokenizer_path or default_tokenizer()
    name = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    held = stored(tokens(docs.select("doc_id", "text", name.alias("queue")), path, end), "tokens")
    # sums of parts: as many rows as parts times queues; parts of one queue are summed up in their order
    sums = held.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    ahead = sums.select("queue", "part", (F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")).alias("ahead"), "n").checkpoint()
    queues = sorted((r["queue"], r["n"]) for r in ahead.groupBy("queue").agg(F.sum("n").alias("n")).collect() if r["n"])
    small = F.broadcast(ahead.drop("n")) if ahead.count() <= MOST_BROADCAST else ahead.drop("n")
    placed = held.join(small, ["queue", "part"]).select("doc_id", "queue", "n", "ids", (F.col("before") + F.col("ahead")).alias("at"))
    names = [q for q, _ in queues]
    lengths = [n for _, n in queues]
    if weights is None:
        shares = [n / sum(lengths) for n in lengths]
    else:
        given = {("n" if k is None else f"s{k}"): float(v) for k, v in weights.items() if v > 0}
        least = min(given.values(), default=1.0) * 1e-4
        shares = [given.get(q, least) for q in names]
        shares = [x / sum(shares) for x in shares]
    place = {q: j for j, q in enumerate(names)}
    id_type = docs.schema["doc_id"].dataType.simpleString()
    wide = encoder(path).wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Schedule(lengths, shares, width)
        for batch in batches:
            yield from cut(batch, plan)

    def cut(batch: pa.RecordBatch, plan: Schedule) -> Iterator[pa.RecordBatch]:
        queue = np.array([place.get(q, -1) for q in batch.column(1).to_pylist()], np.int64)
        n, at, ids = batch.column(2).to_numpy(), batch.column(4).to_numpy(), batch.column(3)
        for j in np.unique(queue[n > 0]):
            rows = np.nonzero((queue == j) & (n > 0))[0]
            rows = rows[np.argsort(at[rows], kind="stable")]
            for some in np.array_split(rows, max(1, int(n[rows].sum()) // 500_000 + 1)):
                if not len(some):
                    continue
                # runs of neighbours in the stream share one table of windows
                for near in np.split(some, np.nonzero(at[some][1:] != (at[some] + n[some])[:-1])[0] + 1):
                    yield pieces(batch, plan, int(j), near, n, at, ids)

    def pieces(batch: pa.RecordBatch, plan: Schedule, j: int, rows: np.ndarray, n: np.ndarray, at: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
        first, last = int(at[rows[0]]), int(at[rows[-1]] + n[rows[-1]])
        guess = np.minimum(plan.lengths, plan.shares * (np.array([[first], [last]]) / plan.shares[j])).sum(axis=1) // width
        spare = 2 + len(plan.lengths) // width  # a queue lacks less than a token of its share
        lo, hi = max(0, int(guess[0]) - spare), min(-(-plan.total // width), int(guess[1]) + spare + 1)
        mine, before = plan.column(np.arange(lo, hi + 1), j)
        lead = np.diff(before)
        inside = mine[(mine > first) & (mine < last)]
        cuts = np.unique(np.concatenate((at[rows], inside)))
        stops = np.append(cuts[1:], last)
        owner = rows[np.searchsorted(at[rows], cuts, side="right") - 1]
        window = np.searchsorted(mine, cuts, side="right") - 1
        start, length = cuts - at[owner], stops - cuts
        # the stream's ids stand in one buffer; a piece is a range of it
        whole = np.frombuffer(b"".join(ids.take(pa.array(rows)).to_pylist()), "<u4" if wide else "<u2").astype("<u4")
        offsets = np.append(cuts - first, last - first) * 4
        body = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(whole.tobytes())])
        take = pa.array(owner)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), pa.array(start), pa.array(length), body, pa.array(n[owner]), pa.array(window + lo), pa.array(lead[window] + cuts - mine[window])],
            ["doc_id", "queue", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )

    out = placed.mapInArrow(run, f"doc_id {id_type}, queue string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.select("doc_id", F.col("queue").alias("queue"), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
