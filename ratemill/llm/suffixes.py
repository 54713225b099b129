"""Repeated byte strings across documents, by distributed prefix doubling.

Wanted is, for every string of LENGTH bytes, the least document it starts in. Ranks are
fingerprints of growing prefixes: 16 bytes, then 32 from the pair of ranks at offset 16,
then LENGTH from two that overlap. After each round Spark deals the ranks by their
leading bits, a task sorts its share and answers which of them occur elsewhere; positions
whose rank is unique leave. Two things keep the rounds small:

* Ranks of 16 bytes are only taken at sampled positions. Every window of LENGTH bytes holds
  one, the least digest among its 16-byte strings, so equal windows hold equal ones.
* A sampled position stands for the run of windows that chose it. Runs with equal bytes
  are one: all but those of the least document are repeats, with no window looked at.
  Single windows are ranked only where one sampled string has different surroundings.

Documents are worked on in batches. A batch names each of its ranks once, whatever
the number of its documents that hold it, so a passage in every document is dealt as one
value per batch. Answers are bits in the order of the question.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a batch, and ranks that one task of a round sorts.
BATCH_BYTES, SHARE_RANKS = 2_000_000, 400_000
SEED = 16
#: Bits of a position beside the digest that chooses the sampled one.
PLACE = np.uint64((1 << 31) - 1)
NO_ID = np.iinfo(np.int64).max

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

QUESTION = "share int, batch int, ranks binary, runs binary, ids binary"
ANSWER = "batch int, round int, share int, bits binary"
RESULT = "doc_id long, n_bytes long, removed array<struct<start:int,end:int>>, kept binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, odd in enumerate((_ODD, _ODD_INVERSE)):
            steps = np.full(n, odd, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Asked:
    """Distinct ranks of a batch in order, the least document of each, and where each came from."""

    def __init__(self, ranks: np.ndarray, ids: np.ndarray, runs: np.ndarray | None = None) -> None:
        order = np.lexsort((ids, ranks)) if runs is None else np.lexsort((ids, runs, ranks))
        ranks, ids = ranks[order], ids[order]
        new = np.ones(len(order), bool)
        new[1:] = ranks[1:] != ranks[:-1]
        if runs is not None:
            runs = runs[order]
            new[1:] |= runs[1:] != runs[:-1]
        at = np.flatnonzero(new)
        self.ranks, self.least, self.runs = ranks[at], ids[at], None if runs is None else runs[at]
        self.back = np.empty(len(order), np.int64)
        self.back[order] = np.cumsum(new) - 1
        last = np.append(at[1:], len(order)) - 1
        self.several = ids[last] > self.least if len(at) else np.empty(0, bool)


class Batch:
    """Fingerprints and runs of the documents of one batch."""

    def __init__(self, doc_ids: list, texts: list, length: int, bits: int) -> None:
        self.length, self.bits, self.round = length, bits, 0
        self.covered = [np.empty(0, np.int64)] * 2
        self.doc_ids = doc_ids
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.array([len(d) for d in data], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.joined = b"".join(data)
        ids = np.array([NO_ID if d is None else d for d in doc_ids], np.int64)
        n = len(self.joined)
        span = length - SEED + 1
        self.at = self.low = self.high = self.ids = self.first = self.end = np.empty(0, np.int64)
        self.rank = np.empty(0, np.uint64)
        if n < length:
            return
        raw = np.frombuffer(self.joined, np.uint8)
        grams = _mix(np.ndarray((n - 7,), "<u8", raw, strides=(1,)) + _ODD)
        power, self.inverse = _power(n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams * power[:n - 7], dtype=np.uint64)])
        del grams
        chosen = _mix(self.fingerprint(slice(0, n - SEED + 1), SEED))
        chosen = (chosen & ~PLACE) | np.arange(len(chosen), dtype=np.uint64)
        size = 1
        while size < span:
            step = min(size, span - size)
            chosen = np.minimum(chosen[:-step], chosen[step:])
            size += step
        owner = np.repeat(np.arange(len(sizes)), sizes)[:len(chosen)]
        windows = np.flatnonzero(np.arange(len(chosen)) + length <= self.ends[owner])
        if not len(windows):
            return
        own = (chosen[windows] & PLACE).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        self.at, self.low = own[new], windows[new]
        self.high = windows[np.append(new[1:], len(own)) - 1]
        holder = owner[self.low]
        self.ids, self.first, self.end = ids[holder], self.starts[holder], self.ends[holder]
        self.rank = _mix(self.fingerprint(self.at, SEED))

    def fingerprint(self, at, size) -> np.ndarray:
        """Of the ``size`` bytes from each place ``at``; at least 8."""
        if isinstance(at, slice):
            return (self.sums[at.start + size - 7: at.stop + size - 7] - self.sums[at]) * self.inverse[at]
        return (self.sums[at + size - 7] - self.sums[at]) * self.inverse[at]

    def keep(self, mask: np.ndarray) -> None:
        for name in ("at", "low", "high", "ids", "first", "end", "rank"):
            setattr(self, name, getattr(self, name)[mask])

    def short(self, ranks: np.ndarray) -> np.ndarray:
        """Leading bits that choose a share, and 32 more."""
        return ranks >> np.uint64(32 - self.bits)

    def next_question(self) -> Asked:
        """What this round asks for; ``take`` has the answers of the rounds before."""
        if self.round == 0:
            return Asked(self.short(self.rank), self.ids)
        if self.round == 1:
            self.right, self.left = self.at + 2 * SEED <= self.end, self.at - SEED >= self.first
            right, left = self.at[self.right], self.at[self.left] - SEED
            ranks = [_mix(self.fingerprint(x, 2 * SEED) + np.uint64(k)) for k, x in enumerate((right, left), 1)] if len(self.at) else [self.rank, self.rank]
            return Asked(self.short(np.concatenate(ranks)), np.concatenate([self.ids[self.right], self.ids[self.left]]))
        if self.round == 2:
            if not len(self.at):
                return Asked(self.rank, self.ids, self.rank)
            extent = (self.at - self.low).astype(np.uint64) + ((self.high - self.low).astype(np.uint64) << np.uint64(20))
            return Asked(self.short(self.rank), self.ids, _mix(self.fingerprint(self.low, self.high - self.low + self.length) + _mix(extent)))
        counts = self.high - self.low + 1
        self.places = np.repeat(self.low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        self.place_ids = np.repeat(self.ids, counts)
        return Asked(_mix(self.fingerprint(self.places, self.length)) if len(self.places) else self.rank, self.place_ids)

    def take(self, asked: Asked, bits: np.ndarray) -> None:
        """Drop what the answer to ``asked`` decides; note covered byte ranges."""
        if self.round == 0:
            self.keep((asked.several | bits)[asked.back])
        elif self.round == 1:
            shared = (asked.several | bits)[asked.back]
            count = int(self.right.sum())
            right, left = self.right.copy(), self.left.copy()
            right[right], left[left] = shared[:count], shared[count:]
            # Windows that begin at most so far before the sampled place hold 32 bytes from it on; those that begin SEED before it or earlier hold 32 bytes up to its end.
            reach = self.length - 2 * SEED
            self.low = np.where(left, self.low, np.maximum(self.low, self.at - reach))
            self.high = np.where(right, self.high, np.minimum(self.high, self.at - SEED))
            self.keep((right | left) & (self.low <= self.high))
        elif self.round == 2:
            smaller, several = np.split(bits, 2)
            repeats = (self.ids > asked.least[asked.back]) | smaller[asked.back]
            self.covered = [self.low[repeats], self.high[repeats] + self.length]
            self.keep(~repeats & several[asked.back])
        else:
            repeats = (self.place_ids > asked.least[asked.back]) | bits[asked.back]
            own = self.places[repeats]
            self.covered = [np.concatenate([self.covered[0], own]), np.concatenate([self.covered[1], own + self.length])]
        self.round += 1

    def replay(self, rounds: int, answers: list[dict]) -> None:
        """Take the answers of the first ``rounds`` rounds, rows as ``ANSWER``."""
        for k in range(rounds):
            asked = self.next_question()
            own = {r["share"]: np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in answers if r["round"] == k}
            parts = [(own[share], len(ranks) // (8 if k == 3 else 4)) for share, ranks, _, _ in self.question(asked)]
            bits = [b[:n] for b, n in parts] + ([b[n:2 * n] for b, n in parts] if k == 2 else [])
            self.take(asked, np.concatenate(bits).astype(bool) if bits else np.empty(0, bool))

    def question(self, asked: Asked) -> list[tuple]:
        """Rows for the shares, as ``QUESTION`` without the batch."""
        whole = self.round == 3
        share = (asked.ranks >> np.uint64(64 - self.bits if whole else 32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(share)) + 1
        rows = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(share)]):
            if b > a:
                ranks = asked.ranks[a:b].astype("<u8") if whole else (asked.ranks[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4")
                runs = asked.runs[a:b].astype("<u8").tobytes() if self.round == 2 else None
                rows.append((int(share[a]), ranks.tobytes(), runs, asked.least[a:b].astype("<i8").tobytes() if self.round >= 2 else None))
        return rows

    def cut(self) -> list[tuple]:
        """Rows as ``RESULT``, after all rounds."""
        n = len(self.joined) + 1
        level = np.bincount(self.covered[0], minlength=n) - np.bincount(self.covered[1], minlength=n)
        gone = np.cumsum(level[:-1]) > 0
        raw = np.frombuffer(self.joined, np.uint8)
        rows = []
        for doc_id, a, b in zip(self.doc_ids, self.starts.tolist(), self.ends.tolist()):
            own = gone[a:b]
            if not own.any():
                rows.append((doc_id, b - a, [], self.joined[a:b]))
                continue
            turns = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))).tolist()
            rows.append((doc_id, b - a, [{"start": s, "end": e} for s, e in zip(turns[::2], turns[1::2])], raw[a:b][~own].tobytes()))
        return rows


def answer(number: int, rows: list[dict]) -> list[np.ndarray]:
    """Bits for each row of one share. Rounds 0 and 1: in another batch too. Then: a smaller document has it (and, in round 2, whether its rank has several runs)."""
    ranks = np.concatenate([np.frombuffer(r["ranks"], "<u8" if number == 3 else "<u4") for r in rows])
    ends = np.cumsum([len(r["ranks"]) // (8 if number == 3 else 4) for r in rows])[:-1]
    if number < 2:
        _, back, counts = np.unique(ranks, return_inverse=True, return_counts=True)
        return np.split(counts[back] > 1, ends)
    ids = np.concatenate([np.frombuffer(r["ids"], "<i8") for r in rows])
    runs = np.concatenate([np.frombuffer(r["runs"], "<u8") for r in rows]) if number == 2 else None
    asked = Asked(ranks, ids, runs)
    smaller = asked.least[asked.back] < ids
    if number == 3:
        return np.split(smaller, ends)
    _, back, counts = np.unique(asked.ranks, return_inverse=True, return_counts=True)
    several = (counts[back] > 1)[asked.back]
    return [np.concatenate(x) for x in zip(np.split(smaller, ends), np.split(several, ends))]


def remove_repeats(docs: DataFrame, scratch: str, length: int = 50) -> DataFrame:
    """``doc_id, n_bytes, removed`` (maximal byte ranges) and ``kept`` (remaining bytes) of every row.

    Removed is each byte of a text, as UTF-8, that a string of ``length`` bytes covers
    which also starts in a document with a smaller ``doc_id``. Null and empty texts, and
    those shorter than ``length``, lose nothing. Rows without ``doc_id`` come after all
    others; rows with the same one do not touch each other. Other columns are not read.

    Batches stay on the executors' disks between the rounds and are made again from the
    input when an executor is lost; answers are written to ``scratch``.
    """
    import pyarrow as pa

    if length < 3 * SEED:
        raise ValueError(f"length must be at least {3 * SEED}")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-total // BATCH_BYTES))
    bits = max(1, int(np.ceil(np.log2(max(2, total / 18 / SHARE_RANKS)))))
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("batch"))
    held = dealt.repartition(-(-batches // 4), "batch").sortWithinPartitions("batch").persist(StorageLevel.DISK_ONLY)

    def table(rows: list[tuple], schema: str):
        types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<struct<start:int,end:int>>": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))}
        fields = [f.split(" ", 1) for f in schema.split(", ")]
        columns = list(zip(*rows)) if rows else [[]] * len(fields)
        return pa.table([pa.array(list(c), types[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

    def replayed(own, answered, rounds: int) -> Batch:
        batch = Batch(own.column("doc_id").to_pylist(), own.column("text").to_pylist(), length, bits)
        batch.replay(rounds, answered.to_pylist())
        return batch

    def ask(number: int):
        def rows(own, answered):
            batch = replayed(own, answered, number)
            name = own.column("batch")[0].as_py()
            return table([(r[0], name, *r[1:]) for r in batch.question(batch.next_question())], QUESTION)

        return rows

    def reply(number: int):
        def rows(asked):
            own = asked.to_pylist()
            return table([(r["batch"], number, r["share"], np.packbits(b).tobytes()) for r, b in zip(own, answer(number, own))], ANSWER)

        return rows

    def finish(own, answered):
        return table(replayed(own, answered, 4).cut(), RESULT)

    answered = spark.createDataFrame([], ANSWER)
    for number in range(4):
        questions = held.groupBy("batch").cogroup(answered.groupBy("batch")).applyInArrow(ask(number), QUESTION)
        questions.groupBy("share").applyInArrow(reply(number), ANSWER).write.mode("overwrite").parquet(f"{scratch}/round={number}")
        answered = spark.read.schema(ANSWER).option("recursiveFileLookup", "true").parquet(*(f"{scratch}/round={k}" for k in range(number + 1)))
    return held.groupBy("batch").cogroup(answered.groupBy("batch")).applyInArrow(finish, RESULT)
