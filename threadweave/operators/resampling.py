"""Bootstraps, permutation tests and rank correlation of any number of rows, without copies of rows.

Each row gets a number below 2^31 - 1 from its key. A draw is a random cubic over the integers modulo that prime: the values of any
four rows are independent. A task makes the draws' weights of a batch of rows as a matrix and multiplies it with the rows' values, so
what leaves it is a row a draw, however many rows it read. The paired bootstrap's weights are independent of each other, each from a
digest of its own. All draws follow from the seed alone, on any partitioning and any engine."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadweave.sources.files import kept

PRIME = (1 << 31) - 1
# fixed values: cumulated Poisson(1) probabilities of 0 to 5
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)
#: Cells of a weight matrix that are filled at once; groups whose sums a task holds at once; bins of a permutation's values.
CELLS, GROUPS, BINS = 1 << 20, 256, 1024
#: Rows of a strip of the plane that one task compares.
STRIP = 1 << 20


def coefficients(draws: int, seed: int) -> np.ndarray:
    """Four numbers below the prime for each draw, from its digest."""
    made = [[int(hashlib.md5(f"{seed}-{d}-{j}".encode()).hexdigest()[:8], 16) % PRIME for j in range(4)] for d in range(1, draws + 1)]
    return np.array(made, np.int64).reshape(draws, 4)


def row_number_of(key: Column, seed: int) -> Column:
    """A row's number, from its key's digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("bigint") % PRIME


def values_of(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """draws x rows: the draws' cubics at the rows' numbers."""
    out = np.broadcast_to(c[:, :1], (len(c), len(x)))
    for j in (1, 2, 3):
        out = (out * x + c[:, j : j + 1]) % PRIME
    return out


def poisson_steps(size: int = PRIME) -> list[int]:
    """The least values whose share of `size` (the prime) is above each cumulated probability."""
    out = []
    for p in POISSON:
        k = int(p * size) - 2
        while not (k + 0.5) / size > p:
            k += 1
        out.append(k)
    return out


def resampled_sums(rows: DataFrame, key: str, sums: dict[str, Column], resamples: int, seed: int, by: str | None = None) -> DataFrame:
    """(by,) draw and the sums of each resample, a row being in it as often as a Poisson(1) quantile of its value says."""
    names = list(sums)
    kind = f"{rows.schema[by].dataType.simpleString()}" if by else "int"
    group = F.col(by) if by else F.lit(0)
    wide = rows.select(group.alias("__g"), row_number_of(F.col(key), seed).alias("__x"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"__s{k}") for k, c in enumerate(sums.values())])
    steps = poisson_steps()

    def given(held: dict, kind: pa.DataType) -> pa.RecordBatch:
        made = np.concatenate(list(held.values()))
        label = pa.array([g for g in held for _ in range(resamples)], kind)
        return pa.RecordBatch.from_arrays([label, pa.array(np.tile(np.arange(1, resamples + 1, dtype=np.int32), len(held))), *[pa.array(made[:, k]) for k in range(len(names))]], names=["__g", "draw", *names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, held = coefficients(resamples, seed), {}
        for batch in batches:
            groups = pc.dictionary_encode(batch.column("__g"), null_encoding="encode")
            code, labels = groups.indices.to_numpy(), groups.dictionary.to_pylist()
            x = batch.column("__x").to_numpy()
            v = np.stack([batch.column(f"__s{k}").to_numpy() for k in range(len(names))], axis=1)
            order = np.argsort(code, kind="stable")
            edge = np.searchsorted(code[order], np.arange(len(labels) + 1))
            for g, label in enumerate(labels):
                of = order[edge[g] : edge[g + 1]]
                if label not in held:
                    if len(held) >= GROUPS:
                        yield given(held, groups.dictionary.type)
                        held = {}
                    held[label] = np.zeros((resamples, len(names)))
                total, step = held[label], max(1, CELLS // resamples)
                for a in range(0, len(of), step):
                    part = of[a : a + step]
                    drawn = values_of(c, x[part])
                    total += sum((drawn >= k).astype(np.int8) for k in steps).astype(np.float64) @ v[part]
        if held:
            yield given(held, groups.dictionary.type)

    found = wide.where("__x IS NOT NULL").mapInArrow(work, f"__g {kind}, draw int, " + ", ".join(f"`{n}` double" for n in names))
    found = found.groupBy("__g", "draw").agg(*[F.sum(n).alias(n) for n in names])
    return found.withColumnRenamed("__g", by) if by else found.drop("__g")


def independent_sums(rows: DataFrame, key: str, sums: dict[str, Column], resamples: int, seed: int) -> DataFrame:
    """draw and the sums of each resample, a row being in it as often as a Poisson(1) quantile of the digest of row and draw says.

    Few rows make many draws, so they are dealt evenly; a task unfolds its rows and adds them up, and a row a draw leaves it."""
    wide = rows.where(F.col(key).isNotNull()).select(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"), F.lit("-")).alias("__k"), *[c.cast("double").alias(n) for n, c in sums.items()])
    wide = wide.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    drawn = wide.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("__h", F.md5(F.concat("__k", F.col("draw").cast("string"))))
    # digests are in hexadecimal digits, which are ordered as their numbers are
    drawn = drawn.withColumn("__w", sum((F.col("__h") >= f"{k:08x}").cast("int") for k in poisson_steps(1 << 32)))
    return drawn.groupBy("draw").agg(*[F.sum(F.col("__w") * F.col(n)).alias(n) for n in sums])


def interval(draws: DataFrame, value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """low, high (linear percentiles) and the number of resamples, of which there are a few thousand, in which the value is defined."""
    return draws.agg(F.percentile(value, F.lit(low)).alias("low"), F.percentile(value, F.lit(high)).alias("high"), F.count(value).alias("n_defined"))


def bootstrap_mean(df: DataFrame, key: str, by: str, value: str, resamples: int = 2000, seed: int = 20261019) -> DataFrame:
    """by, n, mean, low, high: percentile interval of each group's mean, the resamples' means in order at a fortieth from either
    end (of 2,000: the 50th and the 1,950th). Groups without a value have no row; rows are told apart by their key."""
    rows = df.where(F.col(value).isNotNull()).select(key, by, F.col(value).cast("double").alias("__v"))
    s = resampled_sums(rows, key, {"n": F.lit(1), "s": F.col("__v")}, resamples, seed, by)
    means = s.where("n > 0").groupBy(by).agg(F.array_sort(F.collect_list(F.col("s") / F.col("n"))).alias("m"))
    place = lambda share: F.get("m", F.floor(F.size("m") * share).cast("int"))
    ends = means.select(F.col(by).alias("__by"), place(0.025).alias("low"), F.get("m", F.ceil(F.size("m") * 0.975).cast("int") - 1).alias("high"))
    whole = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg("__v").alias("mean"))
    return whole.join(ends, F.col(by).eqNullSafe(F.col("__by"))).drop("__by")


def bootstrap_kappa(df: DataFrame, key: str, a: str, b: str, resamples: int = 2000, seed: int = 20261019) -> DataFrame:
    """Percentile interval of Cohen's kappa of two yes/no ratings over resampled items; undefined resamples are left out."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(key), F.col(a).cast("int").alias("x"), F.col(b).cast("int").alias("y"))
    cells = {f"c{i}{j}": ((F.col("x") == i) & (F.col("y") == j)).cast("int") for i in (0, 1) for j in (0, 1)}
    s = resampled_sums(rows, key, cells, resamples, seed)
    n = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    agree = (F.col("c00") + F.col("c11")) / n
    chance = ((F.col("c00") + F.col("c01")) * (F.col("c00") + F.col("c10")) + (F.col("c11") + F.col("c01")) * (F.col("c11") + F.col("c10"))) / (n * n)
    return interval(s.where(n > 0).withColumn("kappa", F.when(chance < 1, (agree - chance) / (1 - chance))), "kappa")


def bootstrap_difference(df: DataFrame, key: str, group: Column, value: str, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """Percentile interval of the difference of two groups' means (where `group` holds, less the rest's)."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(key), group.cast("int").alias("g"), F.col(value).cast("double").alias("v"))
    s = resampled_sums(rows, key, {"n1": F.col("g"), "s1": F.col("g") * F.col("v"), "n0": 1 - F.col("g"), "s0": (1 - F.col("g")) * F.col("v")}, resamples, seed)
    return interval(s.withColumn("d", F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0"))), "d")


def paired_bootstrap(df: DataFrame, key: str, difference: Column, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean of paired differences, by their key; every row has a draw of its own in every resample."""
    rows = df.select(F.col(key), difference.cast("double").alias("d")).where("d IS NOT NULL")
    s = independent_sums(rows, key, {"n": F.lit(1), "s": F.col("d")}, resamples, seed)
    return interval(s.withColumn("m", F.when(F.col("n") > 0, F.col("s") / F.col("n"))), "m")


def permutation_test(df: DataFrame, key: str, group: Column, value: str, permutations: int = 2000, seed: int = 42, bins: int = BINS) -> DataFrame:
    """difference (mean where `group` holds, less the rest's), p = (permutations at least as far from 0, plus 1) / (permutations + 1).

    In a permutation the rows of least values (then keys) make the group. Nothing is sorted as a whole: tasks sum values in bins of the
    draws' values; of the bin that holds a permutation's last place, a bins-th of the rows, the rows themselves are put in order."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.coalesce(group, F.lit(False)).alias("g"), F.col(value).cast("double").alias("v"), row_number_of(F.col(key), seed).alias("x")).where("x IS NOT NULL")
    rows = kept(rows, "permuted")
    means = F.avg(F.when(F.col("g"), F.col("v"))) - F.avg(F.when(~F.col("g"), F.col("v")))
    n1, n, total, difference = rows.agg(F.count_if("g"), F.count("*"), F.sum("v"), means).first()
    observed = rows.sparkSession.createDataFrame([(difference, None)], "difference double, p double")
    if not n1 or n1 == n:
        return observed
    width = -(-PRIME // bins)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, counts, sums = coefficients(permutations, seed), np.zeros((permutations, bins)), np.zeros((permutations, bins))
        for batch in batches:
            x, v = batch.column("x").to_numpy(), batch.column("v").to_numpy()
            step = max(1, CELLS // permutations)
            for a in range(0, len(x), step):
                at = values_of(c, x[a : a + step]) // width + bins * np.arange(permutations)[:, None]
                counts += np.bincount(at.ravel(), minlength=bins * permutations).reshape(counts.shape)
                sums += np.bincount(at.ravel(), np.broadcast_to(v[a : a + step], at.shape).ravel(), bins * permutations).reshape(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(permutations, dtype=np.int32)), pa.array(list(counts)), pa.array(list(sums))], names=["r", "counts", "sums"])

    def added(table: pa.Table) -> pa.Table:
        """The bin with a permutation's n1-th place; rows and values before it."""
        counts, sums = (np.stack(table.column(c).to_numpy()).sum(axis=0) for c in ("counts", "sums"))
        upto = np.cumsum(counts)
        b = int(np.searchsorted(upto, n1))
        return pa.table({"r": table.column("r")[:1], "bin": pa.array([b], pa.int32()), "before": pa.array([upto[b] - counts[b]]), "below": pa.array([float(sums[:b].sum())])})

    edges = kept(rows.select("x", "v").mapInArrow(binned, "r int, counts array<double>, sums array<double>").groupBy("r").applyInArrow(added, "r int, bin int, before double, below double"), "edges")
    last = np.zeros(permutations, np.int64)
    found = edges.select("r", "bin").toArrow()
    last[found.column("r").to_numpy()] = found.column("bin").to_numpy()

    def at_edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coefficients(permutations, seed)
        for batch in batches:
            x = batch.column("x").to_numpy()
            step = max(1, CELLS // permutations)
            for a in range(0, len(x), step):
                drawn = values_of(c, x[a : a + step])
                r, row = np.nonzero(drawn // width == last[:, None])
                part = batch.slice(a, step).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(drawn[r, row]), part.column("key"), part.column("v")], names=["r", "at", "key", "v"])

    kind = rows.schema["key"].dataType.simpleString()
    edge = rows.select("x", "key", "v").mapInArrow(at_edge, f"r int, at bigint, key {kind}, v double")
    place = F.row_number().over(Window.partitionBy("r").orderBy("at", "key"))
    edge = edge.join(edges, "r").withColumn("place", F.col("before") + place).where(F.col("place") <= n1).groupBy("r").agg(F.sum("v").alias("more"))
    chosen = edges.join(edge, "r", "left").withColumn("s", F.col("below") + F.coalesce("more", F.lit(0.0)))
    d = F.col("s") / n1 - (F.lit(total) - F.col("s")) / (n - n1)
    far = F.count_if(F.abs(d) >= abs(difference) - 1e-9)
    return chosen.agg(F.lit(difference).alias("difference"), ((far + 1) / (permutations + 1)).alias("p"))


def below_left(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each point the weight of those with smaller x and smaller y: by the bits of y's rank, each level one stable sort."""
    order = np.lexsort((-y, x))  # of equal x the greater y first, so that equal x never count
    rank = np.unique(y[order], return_inverse=True)[1]
    w, out = weight[order].astype(np.float64), np.zeros(len(x))
    for bit in range(max(1, int(rank.max(initial=0))).bit_length()):
        by = np.argsort(rank >> (bit + 1), kind="stable")
        r = rank[by]
        one = (r >> bit) & 1 == 1
        low = np.cumsum(np.where(one, 0.0, w[by]))
        head = np.concatenate(([True], r[1:] >> (bit + 1) != r[:-1] >> (bit + 1)))
        start = np.maximum.accumulate(np.where(head, np.arange(len(r)), 0))
        before = np.concatenate(([0.0], low))[start]
        out[by[one]] += (low - before)[one]
    result = np.empty(len(x))
    result[order] = out
    return result


def kendall_tau(df: DataFrame, x: str, y: str, strip: int = STRIP) -> DataFrame:
    """n, tau (tau-b) of any two ordered columns; null without spread. No pairs of rows are made, and no number of levels is too large.

    The plane is cut into strips of x and of y with about `strip` rows; a value with more rows than that has a strip of its own. A row's
    concordant partners below it are whole cells of lower strips (running sums of the grid), rows of its own x strip, and rows of its own
    y strip in lower x strips; a task compares a strip. Within a strip of one value there is nothing to compare."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    cells = kept(both.groupBy("x", "y").agg(F.count("*").cast("double").alias("c")), "cells")
    n = cells.agg(F.coalesce(F.sum("c"), F.lit(0.0))).first()[0]
    parts = max(1, min(1000, int(-(-n // strip))))
    cuts = both.agg(*[F.percentile_approx(c, [k / parts for k in range(1, parts)], 10 * parts) if parts > 1 else F.array().cast("array<double>") for c in ("x", "y")]).first()

    def strip_of(col: str, points: list[float] | None) -> Column:
        points = points or []
        again = sorted({p for i, p in enumerate(points) if p in points[:i]})
        at = F.array(*[F.lit(float(p)) for p in sorted(set(points))]).cast("array<double>")
        return (2 * F.size(F.filter(at, lambda p: p < F.col(col))) + F.col(col).isin(again).cast("int") if again else 2 * F.size(F.filter(at, lambda p: p < F.col(col)))).cast("int")

    cells = kept(cells.withColumn("i", strip_of("x", cuts[0])).withColumn("j", strip_of("y", cuts[1])), "strips")
    grid = cells.groupBy("i", "j").agg(F.sum("c").alias("c"))
    corner = grid.toArrow()  # at most some thousands of strips a side
    gi, ii = np.unique(corner.column("i").to_numpy(), return_inverse=True)
    gj, jj = np.unique(corner.column("j").to_numpy(), return_inverse=True)
    table = np.zeros((len(gi) + 1, len(gj) + 1))
    table[ii + 1, jj + 1] = corner.column("c").to_numpy()
    whole = float((table[1:, 1:] * np.cumsum(np.cumsum(table, axis=0), axis=1)[:-1, :-1]).sum())

    def compared(across: str):
        def work(rows: pa.Table) -> pa.Table:
            a, b, c = (rows.column(k).to_numpy().astype(np.float64) for k in (across, "y", "c"))
            return pa.table({"up": pa.array([float((c * below_left(a, b, c)).sum())])})

        return work

    many = lambda by, col: cells.join(cells.groupBy(by).agg(F.min(col).alias("lo"), F.max(col).alias("hi")).where("lo < hi").select(by), by)
    up = many("i", "x").groupBy("i").applyInArrow(compared("x"), "up double").union(many("j", "y").groupBy("j").applyInArrow(compared("i"), "up double"))
    pairs = F.coalesce(F.sum(F.col("c") * (F.col("c") - 1) / 2), F.lit(0.0))
    s = up.agg((F.coalesce(F.sum("up"), F.lit(0.0)) + whole).alias("up"))
    ties = [d.agg(pairs.alias(t)) for d, t in ((cells, "txy"), (cells.groupBy("x").agg(F.sum("c").alias("c")), "tx"), (cells.groupBy("y").agg(F.sum("c").alias("c")), "ty"))]
    for one in ties:
        s = s.join(F.broadcast(one), F.lit(True))
    every = n * (n - 1) / 2
    down = every - F.col("tx") - F.col("ty") + F.col("txy") - F.col("up")
    free = F.sqrt((every - F.col("tx")) * (every - F.col("ty")))
    return s.select(F.lit(int(n)).cast("bigint").alias("n"), F.when(free > 0, (F.col("up") - down) / free).alias("tau"))
