"""Documents packed into context windows by length patterns.

A window of capacity C is filled by a pattern of binned lengths. How often each
pattern is used is fitted to the histogram of bins by non-negative least squares; the
patterns are enumerated as the fit asks for them, each the one of all patterns that
fit a window along which the error falls most. Repeats are rounded, and a pattern is
drawn with the lengths of its bins that leave least room. What the plan leaves over,
room and pieces, is packed by the best fit. The driver holds histograms and patterns
only, whose size is bounded by the capacities; documents are given their places by
rank within their length, and a length with more than PART pieces is ranked in parts,
so one that a third of all documents share is no single task.

A document is whole unless it alone exceeds the window; then it is cut into full
windows and a rest, and the rest is packed like a document.

Defined cases: null and blank texts have no tokens and get no place; repeated rows
are separate rows of one id and keep separate places; rest pieces carry their piece
number; an empty table gives no places; null or non-positive capacities are no windows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspark.session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Pieces of one length that one task ranks, at most.
PART = 200_000
#: Capacities the histograms are made for, at most: they bound what the driver holds.
MOST_CAPACITY, MOST_WINDOWS = 1_000_000, 64


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every document with a token, by a public tokenizer's file (a path all executors share)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        for b in batches:
            for lo in range(0, b.num_rows, 256):  # bounded encodings at a time
                part = b.slice(lo, 256)
                texts = [x or "" for x in part.column("text").to_pylist()]
                lengths = [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lengths, pa.int64())], schema=schema)

    texts = documents.filter(F.length(F.trim("text")) > 0).select("doc_id", "text")
    return texts.mapInArrow(run, "doc_id bigint, n_tokens bigint").filter("n_tokens > 0")


# ---------------------------------------------------------------- plan of one capacity, on its histogram

#: Cells of a window for the binning, and for the sums of patterns.
BINS, GRID = 64, 1024
#: The fit ends when its squared error falls by less than this share.
TOLERANCE = 1e-4
#: Bins by which a pattern's last piece may differ from the fitted one.
BESIDE = 2
#: A pattern is drawn while its windows stay open by at most this part.
OPEN = 64
#: Lengths on either side of the fitting one that are tried for the piece before it.
TRIED = 12
Pattern = tuple[int, ...]


def _bins(hist: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of every length: equal widths, cut again where a bin would hold more than a BINS-th of the pieces; full windows have their own."""
    n = np.arange(capacity + 1)
    width = np.ceil(n * BINS / capacity).astype(np.int64)
    mass = np.floor((np.cumsum(hist) - hist) * BINS / max(1, hist.sum())).astype(np.int64)
    edge = np.r_[True, (np.diff(width) != 0) | (np.diff(mass) != 0)]
    edge[capacity] = True
    return np.cumsum(edge) - 1


def _full_pattern(gain: np.ndarray, weight: np.ndarray, waste: float) -> tuple[np.ndarray, float]:
    """The pattern (pieces of each bin, their grid weights at most GRID) of the greatest gain less waste for each cell left open."""
    held, last = np.full(2 * GRID + 1, -np.inf), np.full(GRID + 1, -1)  # no gain is known below nothing
    best = held[GRID:]
    best[0] = 0.0
    at = GRID - weight
    for s in range(1, GRID + 1):
        v = held[at + s] + gain
        k = v.argmax()
        best[s], last[s] = v[k], k
    score = best - waste * (GRID - np.arange(GRID + 1))
    s = int(score[1:].argmax()) + 1
    pieces, value = np.zeros(len(gain)), float(score[s])
    while s > 0 and last[s] >= 0:
        pieces[last[s]] += 1
        s -= int(weight[last[s]])
    return pieces, value


def fitted(count: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows: pieces of each bin) and repeats x >= 0 that minimise |A x - count|^2 plus a small price of open cells.

    Active-set non-negative least squares; the next pattern is the one, of all that fit a window,
    along which the error falls most, so patterns have as many pieces as fit and none is left out.
    """
    waste = 0.2 * count.mean() / GRID
    rows, x = np.zeros((0, len(count))), np.zeros(0)
    error = float(count @ count)
    while True:
        pieces, value = _full_pattern(count - x @ rows, weight, waste)
        if value <= 0 or (len(rows) and (rows == pieces).all(1).any()):
            break
        rows, x = np.vstack([rows, pieces]), np.append(x, 0.0)
        price = waste * np.maximum(0, GRID - rows @ weight)
        passive = x > 0
        passive[-1] = True
        while True:  # Lawson and Hanson: back to the border while a repeat would turn negative
            a = rows[passive]
            z = np.zeros(len(x))
            z[passive] = np.linalg.lstsq(a @ a.T, a @ count - price[passive], rcond=None)[0]
            if (z[passive] > 0).all():
                x = z
                break
            low = passive & (z <= 0)
            step = (x[low] / np.maximum(x[low] - z[low], 1e-300)).min()
            x = np.where(passive, x + step * (z - x), 0.0)
            passive &= x > 1e-12
            x[~passive] = 0.0
            if not passive.any():
                break
        rows, x = rows[x > 0], x[x > 0]
        left = count - x @ rows
        now = float(left @ left)
        if error - now <= TOLERANCE * error:
            break
        error = now
    return rows, x


class _Stock:
    """Pieces left of each length, by bin."""

    def __init__(self, hist: np.ndarray, of: np.ndarray):
        self.left = hist.astype(np.int64).copy()
        self.by: list[list[int]] = [[] for _ in range(int(of.max()) + 1)]
        for a in np.flatnonzero(hist).tolist():
            self.by[of[a]].append(a)
        self.all = [a for held in self.by for a in held]
        self.of = of

    def near(self, held: list[int], target: int, most: int, used: dict[int, int]) -> int | None:
        """The length of the list nearest to the target and at most most, of which a piece is left."""
        i = bisect_right(held, min(target, most))
        lo, hi = i - 1, i
        while lo >= 0 or hi < len(held):
            below, above = held[lo] if lo >= 0 else None, held[hi] if hi < len(held) and held[hi] <= most else None
            if above is None and below is None:
                return None
            take_below = above is None or below is not None and target - below <= above - target
            a = below if take_below else above
            if self.left[a] > used.get(a, 0):
                return a
            lo, hi = (lo - 1, hi) if take_below else (lo, hi + 1)
        return None

    def take(self, used: dict[int, int], times: int) -> None:
        for a, c in used.items():
            self.left[a] -= c * times
            if not self.left[a]:
                for held in (self.by[self.of[a]], self.all):
                    held.pop(bisect_right(held, a) - 1)


def plan_windows(hist: np.ndarray, capacity: int) -> list[tuple[Pattern, Pattern, int]]:
    """[(pieces of the fitted pattern, pieces added, repeats)] that use up the histogram (index: length) exactly."""
    if not hist.any():
        return []
    of = _bins(hist, capacity)
    stock, plan = _Stock(hist, of), []
    count = np.bincount(of, hist, of[-1] + 1)
    kept = np.flatnonzero(count)
    mean = np.bincount(of, hist * np.arange(capacity + 1.0), of[-1] + 1)[kept] / count[kept]
    rows, x = fitted(count[kept], np.maximum(1, np.round(mean * GRID / capacity)).astype(np.int64))

    def fill(room: int, used: dict[int, int]) -> list[int]:
        """What still fits best, again and again."""
        more = []
        while room > 0 and (a := stock.near(stock.all, room, room, used)) is not None:
            more.append(a)
            used[a] = used.get(a, 0) + 1
            room -= a
        return more

    def closing(bins: list[int], room: int, used: dict[int, int]) -> list[int]:
        """The last two pieces (or the only one): of the first one's bin the length that leaves the second the least room."""
        first, last = (stock.by[kept[bins[0]]] if len(bins) > 1 else [0]), int(kept[bins[-1]])
        middle = bisect_right(first, room - int(mean[bins[-1]]))
        best: tuple[int, list[int]] = (room, [])
        for a in sorted(first[max(0, middle - TRIED) : middle + TRIED], key=lambda a: abs(a + int(mean[bins[-1]]) - room)):
            if a > room or a and stock.left[a] <= used.get(a, 0):
                continue
            now = used | {a: used.get(a, 0) + 1} if a else used
            z = stock.near(stock.all, room - a, room - a, now)
            if z is not None and abs(int(of[z]) - last) > BESIDE:  # the piece that closes the window may be of a bin beside its own
                z = stock.near(stock.by[last], room - a, room - a, now)
            open_ = room - a - (z or 0)
            if open_ < best[0]:
                best = (open_, [v for v in (a, z) if v])
                if not open_:
                    break
        return best[1]

    # Patterns of few long pieces first: short ones close gaps to the last.
    for k in np.lexsort((-x, rows.sum(1))).tolist():
        want = int(x[k] + 0.5)  # what is not there is not drawn, so rounding up is safe
        parts = [b for b in range(len(kept) - 1, -1, -1) for _ in range(int(rows[k, b]))]
        rest = np.r_[np.cumsum(mean[parts][::-1])[::-1][1:], 0.0]  # mean length of the parts that follow
        while want > 0:
            room, used, pattern = capacity, {}, []
            for i, (b, after) in enumerate(zip(parts, rest.tolist())):
                if i < len(parts) - 2:
                    a = stock.near(stock.by[kept[b]], room - int(after), room, used)
                    drawn = [] if a is None else [a]
                elif i == len(parts) - 2 or len(parts) == 1:
                    drawn = closing(parts[i:], room, used)
                else:
                    break
                for a in drawn:
                    pattern.append(a)
                    used[a] = used.get(a, 0) + 1
                    room -= a
            if not pattern:
                break
            more = fill(room, used)
            if capacity - sum(pattern) - sum(more) > capacity // OPEN:
                break  # the stock no longer has lengths that close this pattern: its pieces are packed with the rest
            times = int(min(want, *(stock.left[a] // c for a, c in used.items())))
            stock.take(used, times)
            plan.append((tuple(pattern), tuple(more), times))
            want -= times
    # Residual: the longest left, then the best fit again and again, as often as the counts allow.
    while stock.all:
        used: dict[int, int] = {}
        more = fill(capacity, used)
        times = int(min(stock.left[a] // c for a, c in used.items()))
        stock.take(used, times)
        plan.append(((), tuple(more), times))
    return plan


Run = tuple[int, int, int, int, bool]


def slots(plan: list[tuple[Pattern, Pattern, int]]) -> tuple[dict[int, list[Run]], int]:
    """For each length its runs (first rank, end rank, first window, pieces of it in each window, whether of a pattern), and the number of windows."""
    runs: dict[int, list[Run]] = {}
    used: dict[int, int] = {}
    window = 0
    for pattern, more, times in plan:
        for pieces, fitted_ in ((pattern, True), (more, False)):
            for a, each in Counter(pieces).items():
                start = used.get(a, 0)
                used[a] = start + each * times
                runs.setdefault(a, []).append((start, used[a], window, each, fitted_))
        window += times
    return runs, window


# ---------------------------------------------------------------- Spark


def _capacities(budgets: DataFrame) -> list[int]:
    rows = budgets.filter("capacity_tokens > 0").select("capacity_tokens").distinct().orderBy("capacity_tokens").limit(MOST_WINDOWS + 1).collect()
    sizes = [int(r[0]) for r in rows]
    if len(sizes) > MOST_WINDOWS or sizes and sizes[-1] > MOST_CAPACITY:
        raise ValueError(f"at most {MOST_WINDOWS} capacities up to {MOST_CAPACITY} tokens are planned at once")
    return sizes


def pieces(lengths: DataFrame, capacities: list[int]) -> DataFrame:
    """(capacity, doc_id, piece_no, len): whole documents, or full windows and a rest."""
    each = lengths.withColumn("capacity", F.explode(F.array(*(F.lit(c).cast("bigint") for c in capacities))))
    n = F.ceil(F.col("n_tokens") / F.col("capacity")).cast("bigint")
    cut = each.withColumn("n", n).withColumn("piece_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    rest = F.col("n_tokens") - (F.col("n") - 1) * F.col("capacity")
    return cut.select("capacity", "doc_id", "piece_no", F.when(F.col("piece_no") < F.col("n"), F.col("capacity")).otherwise(rest).alias("len"))


def pack(documents: DataFrame, budgets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(capacity_tokens, window_no, doc_id, piece_no, n_tokens): the window of every document or piece, for every capacity."""
    return pack_lengths(cut_lineage(token_counts(documents, tokenizer)), _capacities(budgets))


_PLACED = "capacity_tokens bigint, window_no bigint, doc_id bigint, piece_no bigint, n_tokens bigint, fitted boolean"


def pack_lengths(lengths: DataFrame, capacities: list[int], part: int = PART) -> DataFrame:
    spark = lengths.sparkSession
    if not capacities:
        return spark.createDataFrame([], _PLACED)
    each = pieces(lengths, capacities)
    # A number for each capacity and length comes to the driver, whatever the number of documents.
    held = each.groupBy("capacity", "len").agg(F.count(F.lit(1)).alias("n")).toPandas()
    hot = held[held["n"] > part]
    parts = spark.createDataFrame([(int(c), int(a), int(-(-n // part))) for c, a, n in zip(hot["capacity"], hot["len"], hot["n"])], "capacity bigint, len bigint, parts bigint")
    # A length with more pieces than a task should rank is dealt into parts, which are counted too.
    salted = each.join(F.broadcast(parts), ["capacity", "len"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", "piece_no"), F.col("parts")), F.lit(0))).drop("parts")
    offsets: dict[tuple[int, int, int], int] = {}
    if len(hot):
        of_part = salted.join(F.broadcast(parts), ["capacity", "len"]).groupBy("capacity", "len", "salt").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["capacity", "len", "salt"])
        first = of_part.groupby(["capacity", "len"])["n"].cumsum() - of_part["n"]
        offsets = {(int(c), int(a), int(s)): int(o) for c, a, s, o in zip(of_part["capacity"], of_part["len"], of_part["salt"], first)}
    runs: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
    for c in capacities:
        hist = np.zeros(c + 1, np.int64)
        mine = held[held["capacity"] == c]
        hist[mine["len"].to_numpy()] = mine["n"].to_numpy()
        for a, r in slots(plan_windows(hist, c))[0].items():
            runs[c, a] = tuple(np.array(x, np.int64) for x in zip(*r))
    shared = spark.sparkContext.broadcast((offsets, runs))  # bounded by the capacities, which _capacities checks

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, runs = shared.value
        names = ["capacity_tokens", "window_no", "doc_id", "piece_no", "n_tokens", "fitted"]
        key, at = None, 0  # rank within (capacity, length, salt), whose rows come together
        for b in batches:
            c, a, s = (b.column(x).to_numpy(zero_copy_only=False) for x in ("capacity", "len", "salt"))
            window, of_plan = np.empty(b.num_rows, np.int64), np.empty(b.num_rows, bool)
            edge = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (a[1:] != a[:-1]) | (s[1:] != s[:-1])]) if b.num_rows else []
            for i, j in zip(edge, [*edge[1:], b.num_rows]):
                k = (int(c[i]), int(a[i]), int(s[i]))
                if k != key:
                    key, at = k, 0
                rank = offsets.get(k, 0) + at + np.arange(j - i)
                at += int(j - i)
                start, _, base, each, of_pattern = runs[k[0], k[1]]
                r = np.searchsorted(start, rank, "right") - 1
                window[i:j] = base[r] + (rank - start[r]) // each[r]
                of_plan[i:j] = of_pattern[r] > 0
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(window), b.column("doc_id"), b.column("piece_no"), pa.array(a), pa.array(of_plan)], names=names)

    # Ranks need no global order: any order within a part of a length serves.
    routed = salted.repartition("capacity", "len", "salt").sortWithinPartitions("capacity", "len", "salt", "doc_id", "piece_no")
    return routed.select("capacity", "len", "salt", "doc_id", "piece_no").mapInArrow(place, _PLACED)


def fill_report(packed: DataFrame) -> DataFrame:
    """(capacity_tokens, n_windows, n_pieces, n_tokens, fill, fitted): how full the windows are, and the share of pieces placed by fitted patterns."""
    windows = packed.groupBy("capacity_tokens", "window_no").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"), F.count_if("fitted").alias("f"))
    sums = windows.groupBy("capacity_tokens").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n").alias("n_pieces"), F.sum("t").alias("n_tokens"), F.sum("f").alias("f"))
    return sums.withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_windows") * F.col("capacity_tokens")), 6)).withColumn("fitted", F.round(F.col("f") / F.col("n_pieces"), 6)).drop("f")
