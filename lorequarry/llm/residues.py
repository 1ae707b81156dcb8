"""Hard-negative mining with exact scores from a residue number system.

Vectors of whole numbers are multiplied modulo several small primes. Residues lie around zero, so that a product of
SLICE components stays below 2^24 and a float32 matrix product is exact; the residues of the products are put together
by Chinese remaindering in mixed radix with signed digits, which gives the signed score without a comparison. As many
primes are taken as the largest possible score asks for, by Cauchy and Schwarz over all rows.

Anchors and rows are dealt into groups by a hash of a row's own number, so that neither a common label, a repeated id nor
a repeated vector makes a group large. Each pair of groups meets in one task, as two tables of bounded size; it gives
the best rows of its tile, and a window keeps the best over all tiles. The first pass finds the positives, the second one
selects negatives within the score windows that follow from them. Nothing is broadcast or collected but one row of
extremes.

Defined results: a row with a null id, label or vector, or with a component that is null, not finite or not finite when
scaled, takes no part; a shorter vector has zeros beyond its end; repeated rows are rows of their own, each an anchor, a
positive or a negative (a row is not its own positive, a copy of it is); equal scores go by the smaller id; an anchor
without another row of its label gives nothing; extra columns are ignored; an empty table gives an empty result. Vectors
whose scores might exceed a long are an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.llm.common import Scratch

SLICE = 64  # components of one exact product
SCALE = 256
ANCHORS, ROWS = 1024, 4096  # of a tile, about
POSITIVES, NEGATIVES = 5, 10
LEAST, MOST = 30, 90  # per cent of the positive's score

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
FOUND = "anchor_row long, anchor_id long, positive_id long, positive_score long"
TAKEN = "anchor_row long, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def primes(bound: int) -> list[int]:
    """The largest primes whose residues multiply exactly, as many as a score of at most ``bound`` in size needs."""
    most = 2 * math.isqrt((2**24 - 1) // SLICE) + 1
    out: list[int] = []
    for p in range(most, 2, -1):
        if all(p % k for k in range(2, math.isqrt(p) + 1)):
            out.append(p)
            if math.prod(out) > 2 * bound:
                return out
    raise ValueError(f"no primes for scores up to {bound}")


def residues(values: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers modulo p, between -p/2 and p/2, as float32. fmod is exact for floats of any size."""
    r = np.fmod(values, p)
    r[r > p // 2] -= p
    r[r < -(p // 2)] += p
    return r.astype(np.float32)


def product_modulo(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a times the transpose of b modulo p as int64, by float32 products of SLICE components each."""
    left, right, total = residues(a, p), residues(b, p), np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], SLICE):
        total += left[:, k : k + SLICE] @ right[:, k : k + SLICE].T
    return residues(total, p).astype(np.int64)


def scores(a: np.ndarray, b: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Exact inner products of all rows of a with all of b, as int64."""
    digits: list[np.ndarray] = []
    value, weight = np.zeros((len(a), len(b)), np.int64), 1
    for k, p in enumerate(moduli):
        digit = product_modulo(a, b, p)
        for q, earlier in zip(moduli[:k], digits, strict=True):
            digit = (digit - earlier) * pow(q, -1, p) % p
        digit -= np.where(digit > p // 2, p, 0)
        digits.append(digit)
        # beyond 64 bits the sum wraps around, and comes back to the score, which fits
        value += digit * np.int64((weight + 2**63) % 2**64 - 2**63)
        weight *= p
    return value


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, label, q: the rows that take part, with whole components."""
    def whole(x: Column) -> Column:
        y = x.cast("double") * SCALE
        # floor() gives a long; a double of 2^52 and more is whole already
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    def usable(x: Column) -> Column:
        return F.coalesce(F.abs(x.cast("double") * SCALE) < float("inf"), F.lit(False))  # NaN is above infinity

    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    able = named.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(F.forall("embedding", usable))
    return able.select("vec_id", "label", F.transform("embedding", whole).alias("q"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix, zeros beyond their ends."""
    lists = column.combine_chunks()
    lengths, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lists), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _ints(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _tile(rows: pa.Table, anchors: pa.Table, width: int, moduli: list[int]) -> tuple[pa.Table, np.ndarray]:
    """The rows of a tile by id, and their scores with each anchor."""
    rows = rows.sort_by("vec_id")
    return rows, scores(_matrix(anchors.column("q"), width), _matrix(rows.column("q"), width), moduli)


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in text.split(", "))])


def _table(parts: list[list[np.ndarray]], schema: str) -> pa.Table:
    shape = _schema(schema)
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [[] for _ in shape]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)


def _positives_of(width: int, moduli: list[int], keep: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def of(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = []
        if rows.num_rows and anchors.num_rows:
            rows, score = _tile(rows, anchors, width, moduli)
            ids, labels, numbers = (_ints(rows, n) for n in ("vec_id", "label", "row"))
            wanted, who, name = (_ints(anchors, n) for n in ("label", "row", "vec_id"))
            for label in np.unique(wanted):
                mine, of_label = np.flatnonzero(wanted == label), np.flatnonzero(labels == label)
                part = score[np.ix_(mine, of_label)]
                best = np.argsort(-part, axis=1, kind="stable")[:, : keep + 1]  # stable: equal scores stay in the order of ids
                for i, order in zip(mine, best, strict=True):
                    chosen = of_label[order]
                    chosen = chosen[numbers[chosen] != who[i]][:keep]
                    parts.append([np.full(len(chosen), who[i]), np.full(len(chosen), name[i]), ids[chosen], score[i, chosen]])
        return _table(parts, FOUND)

    return of


def _negatives_of(width: int, moduli: list[int], keep: int, least: int, most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def of(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = []
        if rows.num_rows and anchors.num_rows:
            rows, score = _tile(rows, anchors, width, moduli)
            ids, labels = (_ints(rows, n) for n in ("vec_id", "label"))
            for i, a in enumerate(anchors.drop(["q"]).to_pylist()):
                # in whole numbers of Python, which do not overflow
                windows = [(w, -(-least * w["positive_score"] // 100), most * w["positive_score"] // 100) for w in a["positives"]]
                windows = [(w, low, high) for w, low, high in windows if low <= high]
                if not windows:
                    continue
                able = np.flatnonzero((labels != a["label"]) & (score[i] >= min(w[1] for w in windows)) & (score[i] <= max(w[2] for w in windows)))
                able = able[np.argsort(-score[i, able], kind="stable")]
                falling = -score[i, able]
                for w, low, high in windows:
                    start, end = np.searchsorted(falling, -high, "left"), np.searchsorted(falling, -low, "right")
                    chosen = able[start : min(end, start + keep)]
                    same = (a["row"], w["place"], a["vec_id"], w["positive_id"], w["positive_score"])
                    parts.append([*(np.full(len(chosen), v) for v in same), ids[chosen], score[i, chosen]])
        return _table(parts, TAKEN)

    return of


def _tiles(rows: DataFrame, anchors: DataFrame, groups: int, anchor_groups: int, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """work() for every pair of a group of rows and one of anchors."""
    left = rows.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(anchor_groups - 1)))).groupBy("a", "r")
    right = anchors.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).groupBy("a", "r")
    return left.cogroup(right).applyInArrow(work, schema)


def _first(rows: DataFrame, keys: list[str], score: str, vec_id: str, keep: int, place: str) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc(score), vec_id)
    return rows.withColumn(place, F.row_number().over(best)).where(F.col(place) <= keep)


def mined(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
    anchors_a_tile: int = ANCHORS, rows_a_tile: int = ROWS,
) -> DataFrame:
    """RESULT: for each anchor and each of its positives the best rows of another label whose score lies between
    ``least`` and ``most`` per cent of the positive's. vectors have vec_id, embedding and label; is_anchor is a
    condition on vec_id and label."""
    spark = vectors.sparkSession
    with Scratch(spark, "residues") as scratch:
        numbered = scaled(vectors).withColumn("row", F.monotonically_increasing_id())
        rows = scratch.written(numbered, "rows")  # the numbers of rows are fixed from here on
        square = F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x)
        top = rows.select(
            F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors"), F.max(square).alias("square"), F.max(F.size("q")).alias("width"),
            F.max(F.array_max(F.transform("q", F.abs))).alias("largest"),
        ).first()
        if not top["anchors"]:
            return spark.createDataFrame([], RESULT)
        bound = int(top["square"] * (1 + 1e-6)) + 1 if math.isfinite(top["square"]) else 1 << 1024
        if bound >= 1 << 63:
            raise ValueError("scores of these vectors might exceed a long")
        moduli, width = primes(bound), max(1, top["width"])
        groups = max(-(-top["n"] // rows_a_tile), min(top["n"], 4 * spark.sparkContext.defaultParallelism))
        anchor_groups = -(-top["anchors"] // anchors_a_tile)
        kind = "array<float>" if (top["largest"] or 0) < 2**24 else "array<double>"
        dealt = rows.select("row", "vec_id", "label", F.col("q").cast(kind).alias("q"))
        others = dealt.withColumn("r", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
        placed = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(anchor_groups)).cast("int")
        anchors = scratch.written(dealt.where(is_anchor).withColumn("a", placed), "anchors")

        near = _tiles(others, anchors, groups, anchor_groups, _positives_of(width, moduli, positives), FOUND)
        chosen = scratch.written(_first(near, ["anchor_row"], "positive_score", "positive_id", positives, "place"), "positives")
        lists = chosen.groupBy("anchor_row").agg(F.collect_list(F.struct("place", "positive_id", "positive_score")).alias("positives"))
        informed = anchors.join(lists, F.col("row") == F.col("anchor_row")).drop("anchor_row")
        hard = _tiles(others, informed, groups, anchor_groups, _negatives_of(width, moduli, negatives, least, most), TAKEN)
        ranked = _first(hard, ["anchor_row", "place"], "negative_score", "negative_id", negatives, "rank")
        return scratch.result(ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
