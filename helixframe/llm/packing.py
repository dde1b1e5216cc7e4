"""Best-fit packing of token pieces into fixed-size sequences.

Documents become token pieces; the histogram of piece lengths (at most one row for each length) reaches the driver, where a
configuration linear program over it is solved by multiplicative weights with knapsack pricing and then rounded. The
plan's size depends on the sequence size alone. Each piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, freed

#: Fixed value: the word pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs without a break over this many characters go to the tokenizer whose time is not quadratic in them.
LONG_RUN = 1000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """A function from text to ids (uint32 array) equal to those of ``tokenizers`` with the file's vocabulary.

    Ordinary text takes a faster engine over the same vocabulary; long unbroken runs and texts that hold an added token's
    string go to ``tokenizers`` itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    special = [t["content"] for t in raw.get("added_tokens", [])]
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
    ranks = {bytes(chars[c] for c in t): i for t, i in raw["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(path)

    def ids(text: str) -> np.ndarray:
        if len(text) > LONG_RUN:
            sizes = list(map(len, text.split()))
            if max(sizes, default=0) > LONG_RUN or len(text) - sum(sizes) > len(sizes) + LONG_RUN:
                return np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if any(s in text for s in special):
            return np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(fast.encode_ordinary(text), dtype="<u4")

    return ids


def pieces(docs: DataFrame, path: str, *, id: str = "doc_id", text: str = "text", size: int = 1024, end: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row.

    A null or empty text is the end id alone. Only documents over ``size`` tokens are cut, and only the first piece of such
    a document can be shorter than ``size``. Repeated rows give repeated pieces; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = tokenizer(path)
        tail = np.array([end], dtype="<u4")
        for batch in batches:
            out: list[tuple] = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.concatenate([ids(t.as_py() or ""), tail])
                n = -(-len(x) // size)
                at = 0
                for k in range(n):
                    to = len(x) - size * (n - 1 - k)
                    out.append((doc, k, at, to - at, zlib.crc32(x[at:to].tobytes())))
                    at = to
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(freed(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[tuple[int, int], ...]  # lengths, greatest first, and how often each


class Knapsack:
    """Unbounded knapsacks of every capacity up to size at given prices, by dynamic programming."""

    def __init__(self, lengths: np.ndarray, prices: np.ndarray, size: int):
        order = np.argsort(-lengths)
        ls, ps = lengths[order], prices[order]
        self.size = size
        self.value, self.take = np.zeros(size + 1), np.zeros(size + 1, dtype=np.int64)
        first = np.searchsorted(-ls, -np.arange(size + 1)).tolist()  # from here on the lengths fit
        for c in range(1, size + 1):
            k = first[c]
            self.value[c] = self.value[c - 1]
            if k < len(ls):
                v = self.value[c - ls[k:]] + ps[k:]
                b = int(v.argmax())
                if v[b] > self.value[c] + 1e-12:
                    self.value[c], self.take[c] = v[b], ls[k + b]

    def pattern(self, *given: int) -> Pattern:
        """The lengths given, and those of greatest price in the room that they leave."""
        out = Counter(given)
        c = self.size - sum(given)
        while c > 0:
            if self.take[c]:
                out[int(self.take[c])] += 1
                c -= int(self.take[c])
            else:
                c -= 1
        return tuple(sorted(out.items(), reverse=True))


@dataclass
class Program:
    """A fractional solution of the configuration program: how often each pattern is used, so that every length is covered;
    the prices at the end; and a number of sequences that no packing is below."""

    uses: dict[Pattern, float]
    prices: dict[int, float]
    bound: float


def solve(counts: dict[int, int], size: int, *, rounds: int = 600, eta: float = 0.5, calm: float = 100.0, slack: float = 0.01) -> Program:
    """Multiplicative weights for the covering program (after Plotkin, Shmoys and Tardos, 1995, and Fleischer, 2000).

    The weight of a length begins as its share of all tokens; its price is its weight over its count. A round prices patterns by
    one dynamic program, which gives for every length the best pattern that holds it, and uses those within ``slack`` of the
    best of all together, so much that no length is covered more than once; weights then fall by the factor exp(-eta x how much
    the round covers), with ``eta`` itself falling over some ``calm`` rounds. The solution is the mean of the later half of the
    rounds, when prices have settled. Prices over the best pattern's price
    are a dual solution, so every round gives a lower bound; the greatest counts.
    """
    lengths = np.array(sorted(counts), dtype=np.int64)
    need = np.array([counts[k] for k in lengths.tolist()], dtype=np.float64)
    at = {k: i for i, k in enumerate(lengths.tolist())}
    fall, kept = np.zeros(len(lengths)), np.zeros(len(lengths))
    uses: Counter[Pattern] = Counter()
    bound = 0.0
    for r in range(rounds):
        prices = lengths * np.exp(fall.min() - fall)
        k = Knapsack(lengths, prices, size)
        best = k.value[size]
        bound = max(bound, float(prices @ need / best))
        good = prices + k.value[size - lengths] >= (1 - slack) * best
        found = {p: min(need[at[m]] / a for m, a in p) for p in {k.pattern(m) for m in lengths[good].tolist()}}
        covered = np.zeros(len(lengths))
        for p, n in found.items():
            for m, a in p:
                covered[at[m]] += a * n / need[at[m]]
        share = 1 / covered.max()
        fall += eta / (1 + r / calm) * share * covered
        if 2 * r >= rounds:
            kept += share * covered
            for p, n in found.items():
                uses[p] += share * n
    for m in lengths[kept <= 0].tolist():  # never worth its room: covered by the best pattern that holds it
        uses[k.pattern(m)] += need[at[m]] * max(kept.max(), 1.0)
    least = float(kept[kept > 0].min())
    return Program({p: n / least for p, n in uses.items()}, dict(zip(lengths.tolist(), (prices / best).tolist())), bound)


def best_fit(counts: dict[int, int], size: int) -> Counter[Pattern]:
    """Best-fit decreasing over a histogram: how often each pattern is used.

    Sequences that hold the same are one entry with a number, and all pieces of a length are placed together: a sequence takes
    pieces until no more fit before the next one does, as one by one.
    """
    open_: dict[int, Counter[Pattern]] = {}  # patterns by the room left

    def put(p: Pattern, room: int, n: int) -> None:
        if n:
            open_.setdefault(room, Counter())[p] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in open_ if r >= length):
            if not left:
                break
            each = room // length
            for p, n in list(open_[room].items()):
                full = min(n, left // each)
                some = left - full * each if full < n else 0  # one more sequence takes what is left
                taken = full + bool(some)
                if not taken:
                    break
                open_[room][p] -= taken
                if not open_[room][p]:
                    del open_[room][p]
                put((*p, (length, each)), room - each * length, full)
                if some:
                    put((*p, (length, some)), room - some * length, 1)
                left -= full * each + some
            if not open_[room]:
                del open_[room]
        each = size // length
        put(((length, each),), size - each * length, left // each)
        if left % each:
            put(((length, left % each),), size - left % each * length, 1)
    out: Counter[Pattern] = Counter()
    for ps in open_.values():
        out.update(ps)
    return out


def rounded(program: Program, counts: dict[int, int], size: int) -> Counter[Pattern]:
    """Whole uses of patterns that hold each length as often as it is counted.

    First the program's patterns in the proportions that it uses them in, rounded down, where enough pieces are left; then, for these, the
    best patterns at the program's prices of what is left, each as often as it fits; where those are no longer full, best fit
    packs the rest, from whichever point that takes the fewest sequences.
    """
    left = {k: n for k, n in counts.items() if n}
    out: Counter[Pattern] = Counter()

    def use(p: Pattern, most: float) -> int:
        n = min(int(most), *(left.get(k, 0) // a for k, a in p))
        if n > 0:
            out[p] += n
            for k, a in p:
                left[k] -= a * n
                if not left[k]:
                    del left[k]
        return n

    share = program.bound / sum(program.uses.values())  # lengths that lag behind raise all uses; what they lack comes after
    for p, n in sorted(program.uses.items(), key=lambda u: (-u[1], u[0])):
        use(p, n * share + 1e-9)
    best: tuple[int, Counter[Pattern]] | None = None
    lowest = size
    while True:
        room = size if not left else 0
        if left:
            lengths = np.array(sorted(left), dtype=np.int64)
            p = Knapsack(lengths, np.array([program.prices[k] for k in lengths.tolist()]), size).pattern()
            # as often of each length as is left of it
            p = tuple((k, min(a, left[k])) for k, a in p)
            room = sum(k * a for k, a in p)
        if room < lowest or not left:  # fuller patterns have run out: a point to stop at
            rest = best_fit(left, size)
            total = sum(out.values()) + sum(rest.values())
            if best is None or total < best[0]:
                best = (total, out + rest)
            lowest = room - size // 64
        if not left or room < size // 2:
            return best[1]
        use(p, sum(left.values()))


def plan(counts: dict[int, int], size: int) -> pd.DataFrame:
    """Where the pieces of each length go, by rank: columns length, first, last, sequence, per, offset. ``attrs`` has the number
    of sequences and the program's lower bound of it.

    The program rounded, or best fit alone where that takes fewer sequences. Pieces as long as a sequence are one by
    themselves. The ranks first to last - 1 of a length fill the sequences from ``sequence`` on, ``per`` in each, from
    ``offset`` on. Work and memory hang on the number of different lengths, not on that of pieces.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    whole = left.pop(size, 0)
    patterns: Counter[Pattern] = Counter()
    bound = 0.0
    if left:
        program = solve(left, size)
        bound = program.bound
        patterns = min(rounded(program, left, size), best_fit(left, size), key=lambda ps: sum(ps.values()))
    if whole:
        patterns[((size, 1),)] += whole
    first: Counter[int] = Counter()
    rows, sequence = [], 0
    for p, n in sorted(patterns.items(), reverse=True):
        offset = 0
        for k, a in p:
            rows.append((k, first[k], first[k] + a * n, sequence, a, offset))
            first[k] += a * n
            offset += a * k
        sequence += n
    out = pd.DataFrame(rows, columns=["length", "first", "last", "sequence", "per", "offset"]).astype("int64").sort_values(["length", "first"]).reset_index(drop=True)
    out.attrs |= {"sequences": sequence, "bound": math.ceil(bound - 1e-6) + whole}
    return out


def ranked(rows: DataFrame, n: int, *, rows_per_bucket: int = 2_000) -> DataFrame:
    """Adds ``rank``: 0, 1, ... among the rows of each length, counted over hashed buckets so that no length meets in one task."""
    buckets = max(1, min(1 << 20, n // rows_per_bucket))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sums = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    base = sums.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("base"))
    w = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    rows = rows.withColumn("nth", F.row_number().over(w) - 1)
    return rows.join(base, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))


def pack(docs: DataFrame, path: str, *, id: str = "doc_id", text: str = "text", size: int = 1024, end: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece and its place in a sequence.

    Sequences hold at most ``size`` tokens, gapless from offset 0. An empty table gives an empty result.
    """
    rows = cut(pieces(docs, path, id=id, text=text, size=size, end=end))
    counts = {int(r["length"]): r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    p = plan(counts, size)
    key = (p["length"].to_numpy() << 44) + p["first"].to_numpy()
    first, sequence, per, offset = (p[c].to_numpy() for c in ("first", "sequence", "per", "offset"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(k).to_numpy() for k in (3, 5))
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            nth, within = np.divmod(rank - first[at], per[at])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence[at] + nth), pa.array(offset[at] + within * length)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked(rows, sum(counts.values())).mapInArrow(freed(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
