"""Texts whose word sets are alike: a Jaccard join.

Two operators find the pairs of different sets at or above the threshold; equal sets
form one class first.

``voronoi_pairs`` is the metric-space join. Sampled sets are pivots, each set belongs to
the region of its nearest pivot, and by the triangle inequality a set within the
distance of one in another region lies in that region's window, d(x, q) <= d(x, p) + 2 e,
to which it is copied. Regions above a bound are split again by pivots of their own, and
what can't be split is compared in blocks of the bound. It is exact. On sets of words it
prunes nothing: unrelated questions lie at 0.88, the nearest of 32 pivots at 0.78, and the
window is 0.6 wide, so a set goes to 31.9 of 32 regions (README) and all pairs are compared.

``class_pairs`` is therefore what the queries use: MinHash in BANDS bands of ROWS rows, a
join on the bands with size and parity-sketch bounds (which lose nothing), and an exact
comparison of what is left. Two sets at similarity s share a band with probability
1 - (1 - s^ROWS)^BANDS; it misses one at exactly 0.7 with probability 4e-7.

Copies are expanded only where pairs of texts are asked for.

Defined cases: null texts and texts without words have no partners; rows repeated
under one id are one row; a word's repetitions count once; similarity exactly at the
threshold counts; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspark.session import cut_lineage

#: Threshold as a fraction, so that it is exact.
OVER, UNDER = 7, 10
ROWS, BANDS = 5, 80
_SEED = 20


def word_sets(texts: DataFrame, id_col: str = "question_id", text_col: str = "question") -> DataFrame:
    """(id, key, words): the distinct words of each text in order, and a key equal for equal sets."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit("[a-z0-9]+"), F.lit(0))))
    sets = texts.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), words.alias("words")).filter(F.size("words") > 0)
    return sets.select("id", F.sha2(F.concat_ws(" ", "words"), 256).alias("key"), "words").dropDuplicates(["id", "key"])


def classes(sets: DataFrame) -> DataFrame:
    """(cls, key, words): one row for each different set, named by its least id."""
    return sets.groupBy("key").agg(F.min("id").alias("cls"), F.first("words").alias("words"))


_ARROW = pa.schema([("band", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("p", pa.int64()), ("q", pa.int64())])


def _bands(rows_: int, bands: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(_SEED)
        xor = rng.integers(0, 2**64, bands * rows_, np.uint64)
        mul = rng.integers(0, 2**64, bands * rows_, np.uint64) | np.uint64(1)
        salt = rng.integers(0, 2**64, bands, np.uint64)
        mix = np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            codes, cls = b.column("codes"), b.column("cls").to_numpy(zero_copy_only=False)
            flat, at = codes.values.to_numpy(zero_copy_only=False).view(np.uint64), codes.offsets.to_numpy()
            for lo in range(0, b.num_rows, 500):
                rows = range(lo, min(lo + 500, b.num_rows))
                keys = np.empty((len(rows), bands), np.uint64)
                sketch = np.empty((len(rows), 2), np.int64)
                sizes = np.empty(len(rows), np.int32)
                for k, i in enumerate(rows):
                    c = flat[at[i] : at[i + 1]]
                    sizes[k] = len(c)
                    with np.errstate(over="ignore"):
                        low = np.full(bands * rows_, np.iinfo(np.uint64).max, np.uint64)
                        for part in range(0, len(c), 256):  # long texts piece by piece
                            low = np.minimum(low, ((c[part : part + 256, None] ^ xor) * mul).min(axis=0))
                        h = salt.copy()
                        for m in low.reshape(bands, rows_).T:
                            h = (h ^ m) * mix
                            h ^= h >> np.uint64(31)
                    keys[k] = h
                    cells = np.bincount(((c * mix) >> np.uint64(57)).astype(np.int64), minlength=128) & 1
                    sketch[k] = np.packbits(cells.astype(np.uint8)).view(np.int64)
                each = lambda x: np.repeat(x, bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(each(cls[lo : lo + 500])), pa.array(each(sizes)), pa.array(each(sketch[:, 0])), pa.array(each(sketch[:, 1]))], schema=_ARROW)

    return run


def class_pairs(cls: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(a, b, common, either), a < b: different sets at or above the threshold, by MinHash bands and an exact comparison."""
    codes = cls.select("cls", F.transform("words", lambda w: F.xxhash64(w)).alias("codes"))
    placed = codes.mapInArrow(_bands(rows, bands), "band bigint, cls bigint, n int, p bigint, q bigint").repartition("band")
    x, y = placed.alias("x"), placed.alias("y")
    n = F.col("x.n") + F.col("y.n")
    fits = (F.least("x.n", "y.n") * UNDER >= F.greatest("x.n", "y.n") * OVER) & (
        (F.bit_count(F.col("x.p").bitwiseXOR(F.col("y.p"))) + F.bit_count(F.col("x.q").bitwiseXOR(F.col("y.q")))) * (UNDER + OVER) <= n * (UNDER - OVER)
    )
    near = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.cls") < F.col("y.cls")) & fits)
    near = near.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
    words = cls.select("cls", "words")
    both = near.join(words.select(F.col("cls").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("cls").alias("b"), F.col("words").alias("wb")), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    exact = both.select("a", "b", common.alias("common"), (F.size("wa") + F.size("wb") - common).alias("either"))
    return exact.filter(F.col("common") * UNDER >= F.col("either") * OVER)


#: Pivots of a region, rows compared in one task, and how often regions are split.
PIVOTS, BOUND, SPLITS = 16, 2000, 2
_PLACED = "region string, cls bigint, anchor boolean, codes array<bigint>"


def _split(pivots: dict[str, list[np.ndarray]]):
    """Rows of a region with pivots go to their nearest pivot's region, and as copies to those in whose window they lie."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {r: np.unique(np.concatenate(ps)) for r, ps in pivots.items()}
        of = {r: np.stack([np.isin(words[r], p) for p in ps]).T for r, ps in pivots.items()}
        sizes = {r: np.array([len(p) for p in ps]) for r, ps in pivots.items()}
        for b in batches:
            out: list[tuple] = []
            for region, cls, anchor, codes in zip(*(b.column(c).to_pylist() for c in ("region", "cls", "anchor", "codes"))):
                if region not in pivots:
                    out.append((region, cls, anchor, codes))
                    continue
                x = np.array(codes, np.int64)
                at = np.minimum(np.searchsorted(words[region], x), len(words[region]) - 1)
                common = of[region][at[words[region][at] == x]].sum(0)
                far = 1 - common / (len(x) + sizes[region] - common)
                home = int(far.argmin())
                window = far <= far[home] + 2 * (1 - OVER / UNDER) + 1e-9
                out += [(f"{region}/{q}", cls, anchor and q == home, codes) for q in np.flatnonzero(window | (np.arange(len(far)) == home)).tolist()]
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.int64())))], names=["region", "cls", "anchor", "codes"])

    return run


def voronoi_regions(cls: DataFrame, pivots: int = PIVOTS, bound: int = BOUND, splits: int = SPLITS) -> DataFrame:
    """(region, cls, anchor, codes): each set an anchor in one region, and copied to every region in whose window it lies."""
    rows = cls.select(F.lit("").alias("region"), "cls", F.lit(True).alias("anchor"), F.transform("words", lambda w: F.xxhash64(w)).alias("codes"))
    for _ in range(splits):
        # Regions are at most pivots to the power of the splits, their pivots so many each.
        large = [r[0] for r in rows.groupBy("region").count().filter(F.col("count") > bound).select("region").collect()]
        if not large:
            break
        first = Window.partitionBy("region", F.pmod(F.col("h"), F.lit(64))).orderBy("h")
        some = rows.filter(F.col("region").isin(large) & F.col("anchor")).withColumn("h", F.xxhash64("cls", "region")).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= pivots)
        held: dict[str, list[np.ndarray]] = {}
        for r in some.withColumn("n", F.row_number().over(Window.partitionBy("region").orderBy("h"))).filter(F.col("n") <= pivots).orderBy("region", "h").collect():
            held.setdefault(r["region"], []).append(np.array(r["codes"], np.int64))
        held = {r: ps for r, ps in held.items() if len(ps) > 1}
        if not held:
            break
        rows = cut_lineage(rows.mapInArrow(_split(held), _PLACED))
    return rows


def _compare(rows):  # noqa: ANN001, ANN202
    """Pairs of an anchor and another row of a block, by postings."""
    import pandas as pd

    mine = rows["side"].to_numpy() == 0
    a, o = rows[mine], rows[~mine]
    where: dict[int, list[int]] = {}
    for k, codes in enumerate(o["codes"]):
        for c in codes.tolist():
            where.setdefault(c, []).append(k)
    postings = {c: np.array(v) for c, v in where.items()}
    sizes, names, out = np.array([len(c) for c in o["codes"]], np.int64), o["cls"].to_numpy(), []
    for cls, codes in zip(a["cls"].tolist(), a["codes"]):
        held = [postings[c] for c in codes.tolist() if c in postings]
        if held:
            common = np.bincount(np.concatenate(held), minlength=len(o))
            either = len(codes) + sizes - common
            for k in np.flatnonzero((common * UNDER >= either * OVER) & (names > cls)).tolist():
                out.append((cls, int(names[k]), int(common[k]), int(either[k])))
    return pd.DataFrame(out, columns=["a", "b", "common", "either"], dtype="int64")


def voronoi_pairs(cls: DataFrame, pivots: int = PIVOTS, bound: int = BOUND, splits: int = SPLITS) -> DataFrame:
    """(a, b, common, either), a < b: different sets at or above the threshold, exactly. The lesser of a pair meets the other in its own region."""
    rows = voronoi_regions(cls, pivots, bound, splits)
    parts = rows.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / bound).cast("int").alias("parts"))
    dealt = rows.join(parts, "region").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = dealt.filter("anchor").select("region", F.col("own").alias("i"), other.alias("j"), F.lit(0).alias("side"), "cls", "codes")
    right = dealt.select("region", other.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "cls", "codes")
    return left.unionByName(right).groupBy("region", "i", "j").applyInPandas(_compare, "a bigint, b bigint, common bigint, either bigint")


def _joined(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (id, cls) and pairs of classes."""
    sets = cut_lineage(word_sets(texts))  # membership and classes both read it
    cls = cut_lineage(classes(sets))
    return sets.select("id", "key").join(cls.select("key", "cls"), "key").select("id", "cls"), class_pairs(cls)


def similar_pairs(texts: DataFrame) -> DataFrame:
    """(question_id_a, question_id_b), a < b: all pairs of texts at or above the threshold, copies included."""
    members, pairs = _joined(texts)
    a, b = members.select(F.col("cls").alias("a"), F.col("id").alias("ia")), members.select(F.col("cls").alias("b"), F.col("id").alias("ib"))
    across = pairs.select("a", "b").join(a, "a").join(b, "b").select("ia", "ib")
    # Copies of one set: only classes with more than one text meet themselves.
    many = members.groupBy("cls").count().filter("count > 1").select("cls")
    shared = members.join(many, "cls", "left_semi")
    within = shared.select("cls", F.col("id").alias("ia")).join(shared.select("cls", F.col("id").alias("ib")), "cls").filter("ia < ib").select("ia", "ib")
    out = across.unionByName(within)
    return out.select(F.least("ia", "ib").alias("question_id_a"), F.greatest("ia", "ib").alias("question_id_b")).filter("question_id_a < question_id_b").distinct()


def groups(texts: DataFrame) -> DataFrame:
    """(question_id, group_id, n_links): each text that has a partner, its group's least id, its links to different texts' sets.

    Groups are the connected components of the class pairs, by least labels with
    pointer jumping; the labels stay in tables and only the number of changes is read.
    """
    members, pairs = _joined(texts)
    pairs = cut_lineage(pairs.select("a", "b"))
    links = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = links.select(F.col("a").alias("cls")).distinct().withColumn("label", F.col("cls"))
    while True:
        seen = links.join(label.select(F.col("cls").alias("b"), "label"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("label").alias("least"))
        lower = label.join(seen, "cls").select("cls", "label", F.least("label", "least").alias("next"))
        jump = lower.join(lower.select(F.col("cls").alias("next"), F.col("next").alias("far")), "next").select("cls", "label", F.least("next", "far").alias("next"))
        jump = cut_lineage(jump)
        changed = jump.filter("next <> label").limit(1).count()
        label = jump.select("cls", F.col("next").alias("label"))
        if not changed:
            break
    degree = links.groupBy(F.col("a").alias("cls")).agg(F.count(F.lit(1)).alias("n_links"))
    alone = members.groupBy("cls").count().filter("count > 1").select("cls")  # copies without other partners
    held = alone.join(label, "cls", "full").select("cls", F.coalesce("label", "cls").alias("group_id"))
    rows = members.join(held, "cls").join(degree, "cls", "left")
    return rows.select(F.col("id").alias("question_id"), "group_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
