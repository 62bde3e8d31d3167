"""Whitening of vectors: blockwise QR, Householder bidiagonalisation, dqds, twisted factorisations.

Vectors become whole numbers, whose counts and sums are exact. Each partition reduces its centred
rows, block by block, to one triangle; triangles are reduced together in groups until one is left
for each length of vectors. Its singular values and right vectors are found in one task
(``bidiagonal``). The covariance matrix is never formed, so small variances keep their digits.

The driver sees counts, sums and directions: some numbers for each dimension and component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm import bidiagonal
from foliomill.llm.vectors import floored, matrix, usable
from foliomill.sources import workspace

COMPONENTS = 32
BLOCK_BYTES = 32 << 20  # of the rows that are reduced at once
FAN = 32  # triangles that one task reduces together, fewer if they are large
MODEL_BYTES = 64 << 20  # of the models that one scan of the rows applies
WHOLE = 2.0**62


@dataclass(frozen=True)
class Model:
    """What whitens vectors of one length."""

    n: int
    sums: np.ndarray  # exact, a whole number for each dimension
    variances: np.ndarray  # of the components, falling
    directions: np.ndarray  # a column for each component, divided by its standard deviation
    total: float  # variance of all dimensions

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.total


def whole(vectors: DataFrame, vector: str, scale: int, offset: int) -> DataFrame:
    """The usable rows with ``_x``, their components as whole numbers, and ``_dims``."""
    return vectors.filter(usable(vector)).withColumn("_x", floored(vector, scale, offset)).withColumn(
        "_dims", F.size(vector))


def _sums(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Count and exact sums by length."""
    told = rows.select("_dims", F.posexplode("_x").alias("at", "x")).groupBy("_dims", "at").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"),
        F.min("x").alias("least"), F.max("x").alias("most")).collect()
    found: dict[int, tuple[int, np.ndarray]] = {}
    for r in told:
        if r.n * max(abs(r.least), abs(r.most)) >= WHOLE:
            raise OverflowError("components times rows must stay below 2^62")
        sums = found.setdefault(r["_dims"], (r.n, np.zeros(r["_dims"], np.int64)))[1]
        sums[r.at] = r.s
    return found


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - sums, exact whole numbers: n times the distance from the mean."""
    return n * x - sums


def _stacked(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The triangle of a triangle and further rows."""
    return np.linalg.qr(np.concatenate([r, rows]), mode="r")


def _triangles(found: dict[int, tuple[int, np.ndarray]]):
    """One triangle of the centred rows of a partition, for each length."""
    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: dict[int, np.ndarray] = {}
        for batch in batches:
            for dims, part in batch.groupby("_dims"):
                n, sums = found[int(dims)]
                step = max(int(dims), BLOCK_BYTES // (8 * int(dims)))
                r = left.get(dims, np.zeros((0, dims)))
                for at in range(0, len(part), step):
                    x = matrix(part["_x"].iloc[at:at + step], dims)
                    r = _stacked(r, _centred(x, n, sums).astype(np.float64) / n)
                left[dims] = r
        for dims, r in left.items():
            yield pd.DataFrame({"dims": [dims], "part": [TaskContext.get().partitionId()], "r": [r.tobytes()]})
    return reduce


def _joined(part: pd.DataFrame) -> pd.DataFrame:
    dims = int(part["dims"].iloc[0])
    r = np.zeros((0, dims))
    for piece in part.sort_values("part")["r"]:
        r = _stacked(r, np.frombuffer(piece).reshape(-1, dims))
    return pd.DataFrame({"dims": [dims], "part": [int(part["group"].iloc[0])], "r": [r.tobytes()]})


def _solved(components: int, found: dict[int, tuple[int, np.ndarray]]):
    def solve(part: pd.DataFrame) -> pd.DataFrame:
        dims = int(part["dims"].iloc[0])
        r = np.frombuffer(_joined(part.assign(group=0))["r"].iloc[0]).reshape(-1, dims)
        n = found[dims][0]
        square = np.zeros((dims, dims))
        square[: len(r)] = r
        values, directions = bidiagonal.right_vectors(square)
        kept = min(components, directions.shape[1])
        variances = values[:kept] / n
        return pd.DataFrame({
            "dims": [dims], "variances": [variances.tobytes()], "total": [float((r * r).sum()) / n],
            "directions": [(directions[:, :kept] / np.sqrt(variances)).tobytes()]})
    return solve


TRIANGLE = "dims int, part long, r binary"


def fit(vectors: DataFrame, vector: str = "embedding", scale: int = 64, offset: int = 1_000_000,
        components: int = COMPONENTS) -> dict[int, Model]:
    """The model of each length of vectors, from all usable rows.

    Rows count as often as they are there. Components are numbered by falling variance; those whose
    variance cannot be told from zero are left out, so equal rows, or a single one, give none.
    """
    rows = whole(vectors.select(vector), vector, scale, offset).select("_dims", "_x").filter("_dims > 0")
    found = _sums(rows)
    triangles = workspace.written(rows.mapInPandas(_triangles(found), TRIANGLE), "triangles")
    widest = max(found, default=1)
    fan = max(2, min(FAN, MODEL_BYTES // (8 * widest * widest)))
    while triangles.filter(F.col("part") >= fan).limit(1).count():
        triangles = workspace.written(
            triangles.withColumn("group", F.floor(F.col("part") / fan)).groupBy("dims", "group").applyInPandas(
                _joined, TRIANGLE), "triangles")
    solved = triangles.groupBy("dims").applyInPandas(
        _solved(components, found), "dims int, variances binary, total double, directions binary").collect()
    models = {}
    for r in solved:
        variances = np.frombuffer(r.variances)
        models[r.dims] = Model(
            *found[r.dims], variances, np.frombuffer(r.directions).reshape(r.dims, len(variances)), r.total)
    return models


def _batches(models: dict[int, Model]) -> list[dict[int, Model]]:
    """Models in shares of bounded size, nearly always one."""
    shares: list[dict[int, Model]] = []
    room = 0
    for dims in sorted(models):
        size = models[dims].directions.nbytes + 8 * dims
        if not shares or size > room:
            shares.append({})
            room = MODEL_BYTES
        shares[-1][dims] = models[dims]
        room -= size
    return shares


def _deviations(distance: np.ndarray) -> list[Decimal]:
    """Exact sums of squares."""
    most = float(np.abs(distance).max()) if distance.size else 0.0
    if most * most * distance.shape[1] < WHOLE:
        return [Decimal(int(v)) for v in (distance * distance).sum(axis=1)]
    return [Decimal(sum(int(v) ** 2 for v in row)) for row in distance]


def _apply(models: dict[int, Model]):
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for dims_of, vectors in batches:
            deviations, whitened = np.empty(len(vectors), object), np.empty(len(vectors), object)
            for dims in np.unique(dims_of):
                where, model = np.flatnonzero(dims_of == dims), models[int(dims)]
                step = max(1, BLOCK_BYTES // (8 * int(dims)))
                for at in range(0, len(where), step):
                    rows = where[at:at + step]
                    distance = _centred(matrix(vectors.iloc[rows], int(dims)), model.n, model.sums)
                    values = (distance.astype(np.float64) / model.n) @ model.directions
                    for row, deviation, value in zip(rows, _deviations(distance), values):
                        deviations[row], whitened[row] = deviation, value
            yield pd.DataFrame({"deviation": deviations, "whitened": whitened})
    return apply


def whiten(vectors: DataFrame, models: dict[int, Model], vector: str = "embedding", scale: int = 64,
           offset: int = 1_000_000, into: str = "white") -> DataFrame:
    """The usable rows, all columns kept, with ``into``: struct<deviation: decimal, whitened: array<double>>.

    ``deviation`` is the exact sum of the squares of n x - sums. Rows whose vector is null or holds a
    null or non-finite component are left out, and so are vectors of a length that no model is for. A
    column of the same name is replaced. One scan, no shuffle, while the models take less than 64 MB;
    beyond that a scan for each 64 MB.
    """
    rows = whole(vectors, vector, scale, offset)
    schema = "struct<deviation: decimal(38,0), whitened: array<double>>"
    parts = []
    for share in _batches(models):
        run = F.pandas_udf(_typed(_apply(share)), schema)
        parts.append(rows.filter(F.col("_dims").isin(*share)).withColumn(into, run("_dims", "_x")))
    if not parts:
        parts = [rows.filter(F.lit(False)).withColumn(into, F.lit(None).cast(schema))]
    whitened = parts[0]
    for part in parts[1:]:
        whitened = whitened.unionByName(part)
    return whitened.drop("_x", "_dims")


def _typed(run):
    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return run


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums and products of the whitened values of a partition: (dims, i, j, value), j = -1 for sums."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for dims, part in batch.groupby("dims"):
            w = np.array(part["whitened"].tolist()).reshape(len(part), -1)
            w = np.concatenate([w, np.ones((len(w), 1))], axis=1)
            sums[dims] = sums.get(dims, 0.0) + w.T @ w
    for dims, gram in sums.items():
        i, j = np.triu_indices(len(gram))
        yield pd.DataFrame({"dims": np.full(len(i), dims, np.int32), "i": i, "j": j, "value": gram[i, j]})


def identity_errors(whitened: DataFrame, vector: str = "embedding", into: str = "white") -> dict[int, float]:
    """By length: the largest entry by which the covariance of the whitened rows differs from the identity."""
    rows = whitened.select(F.size(vector).alias("dims"), F.col(into)["whitened"].alias("whitened")).filter(
        F.size("whitened") > 0)
    told = rows.mapInPandas(_grams, "dims int, i int, j int, value double").groupBy("dims", "i", "j").agg(
        F.sum("value").alias("value")).collect()
    found: dict[int, dict] = {}
    for r in told:
        found.setdefault(r.dims, {})[r.i, r.j] = r.value
    errors = {}
    for dims, entries in found.items():
        last = max(j for _, j in entries)
        n = entries[last, last]
        errors[dims] = max(
            abs(entries[i, j] / n - entries[i, last] / n * (entries[j, last] / n) - (i == j))
            for i, j in entries if j != last)
    return errors


def components_of(models: dict[int, Model], dims: Column, value) -> Column:
    """A literal of each length's model, chosen by the row's length."""
    chosen = F.lit(None)
    for d, model in models.items():
        chosen = F.when(dims == d, value(d, model)).otherwise(chosen)
    return chosen
