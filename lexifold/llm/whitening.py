"""Whitening of vectors by their leading principal components, found by Chebyshev-filtered subspace iteration.

Entries are put on a whole-numbered grid, ``x = floor(scale * c) + offset``, so that counts, sums and squares are exact
in any order. The covariance ``V`` of the x-vectors (divisor n, centred before multiplying) is never formed: the rows
lie in blocks, and a pass over the blocks multiplies ``V`` with a narrow matrix, ``V Q = X'(X Q) / n``, adding up one
small matrix for each task. With a block of more columns than wanted components, one round is

* a polynomial in ``V`` of ``degree`` passes, by the three-term recurrence of Chebyshev polynomials on the interval
  from the lower end of the spectrum (a few Lanczos passes) to the least Ritz value of the block, which damps every
  direction of an eigenvalue in it and lets those above grow,
* QR, then Rayleigh-Ritz in the block, whose product with ``V`` also gives the residual ``|V q - e q|`` of each component.
  Leading components that are certified already stay in the block, but are filtered no more.

Rounds end when all wanted residuals are ``tolerance`` times the greatest eigenvalue or less; an error is raised if
``rounds`` do not reach it. A residual r bounds the eigenvalue's error by r, and by r*r / gap next to other
eigenvalues. The start is a seeded random block. Where the block is as wide as the vectors, the first pass is exact.

Defined results: a row is dropped if its vector is null or empty, holds null or non-finite entries, or entries whose
grid number is not between -2^31 and 2^31 (offset left out), or is not as long as most vectors are (of equally
frequent lengths the longest); null keys, repeated rows and ties are kept; components whose eigenvalue is at most
1e-12 of the greatest carry no direction and are left out, so a single row, or equal rows, give no component; an empty
table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexifold.sources.scratch import materialize

BLOCK_ROWS = 4_096
# Tasks that add up the matrices of all others before the driver does.
ADDERS = 64
BLOCKS = "n int, keys array<long>, grid binary"
GRID_LIMIT = 2**31


@dataclass(frozen=True)
class WhiteningOptions:
    """``guard``: columns of the block beside the wanted components; ``probe``: Lanczos steps towards the least eigenvalue."""

    components: int = 32
    guard: int = 16
    probe: int = 10
    degree: int = 12
    tolerance: float = 1e-13
    rounds: int = 60
    scale: int = 64
    offset: int = 1_000_000
    seed: int = 42


@dataclass(frozen=True)
class Whitening:
    """``blocks``: the rows on the grid. ``sums`` are without the offset; ``vectors`` has a component in each column."""

    blocks: DataFrame
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int

    @property
    def scales(self) -> np.ndarray:
        return 1 / np.sqrt(self.values)


def _grid(batch: pa.RecordBatch, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and grid numbers (without the offset) of the rows that count."""
    column = batch.column("vector")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    right = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    right = right[lengths[right] == dims]
    chosen = column.take(pa.array(right, pa.int64()))
    entries = np.asarray(chosen.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(right), dims)  # null becomes nan
    with np.errstate(all="ignore"):
        on_grid = np.floor(entries * scale)
        good = (np.isfinite(entries) & (np.abs(on_grid) < GRID_LIMIT)).all(axis=1)
    return right[good], on_grid[good].astype(np.int64)


def _to_blocks(dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                rows, grid = _grid(batch, dims, scale)
                if len(rows):
                    keys = batch.column("key").take(pa.array(rows, pa.int64())).to_pylist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([len(rows)], pa.int32()), pa.array([keys], pa.list_(pa.int64())), pa.array([grid.astype(np.int32).tobytes()], pa.binary())],
                        ["n", "keys", "grid"],
                    )

    return run


def _unpack(payload: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(payload, np.int32).reshape(-1, dims).astype(np.int64)


def _counts(dims: int):
    """Of a task: rows, sums and sums of squares as decimal texts, which have no greatest number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, [0] * dims, [0] * dims
        for batch in batches:
            for payload in batch.column("grid"):
                grid = _unpack(payload.as_py(), dims)
                square = grid * grid  # below 2^62; both halves of it can be added up
                high, low = (square >> 31).sum(axis=0).tolist(), (square & (2**31 - 1)).sum(axis=0).tolist()
                n += len(grid)
                sums = [a + b for a, b in zip(sums, grid.sum(axis=0).tolist(), strict=True)]
                squares = [a + (h << 31) + b for a, h, b in zip(squares, high, low, strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"numbers": [[str(n), *map(str, sums), *map(str, squares)]]})

    return run


def _add_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for row in batch.column("numbers"):
            numbers = [int(t) for t in row.as_py()]
            total = numbers if total is None else [a + b for a, b in zip(total, numbers, strict=True)]
    if total is not None:
        yield pa.RecordBatch.from_pydict({"numbers": [[str(t) for t in total]]})


def _add_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for payload in batch.column("matrix"):
            part = np.frombuffer(payload.as_py())
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_pydict({"matrix": pa.array([total.tobytes()], pa.binary())})


def _added(parts: DataFrame, tasks: int, adder: Callable, schema: str) -> DataFrame:
    """A row for each task becomes ``ADDERS`` rows at most; few rows are left to the driver."""
    if tasks <= ADDERS:
        return parts
    return parts.repartition(ADDERS).mapInArrow(adder, schema)


def _centred(payload: bytes, dims: int, n: int, sums: np.ndarray) -> np.ndarray:
    """Rows less the mean, each from one exact whole number where a long can hold it."""
    grid = _unpack(payload, dims)
    if n < 2**31:
        return (n * grid - sums.astype(np.int64)) / n
    return grid - sums.astype(np.float64) / n


def _products(dims: int, n: int, sums: np.ndarray, matrix: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for payload in batch.column("grid"):
                rows = _centred(payload.as_py(), dims, n, sums)
                part = rows.T @ (rows @ matrix)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"matrix": pa.array([total.tobytes()], pa.binary())})

    return run


def _moments(dims: int, n: int, sums: np.ndarray, matrix: np.ndarray):
    """Of a task: sum of the projected rows, and of their outer products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for payload in batch.column("grid"):
                rows = _centred(payload.as_py(), dims, n, sums) @ matrix
                part = np.concatenate((rows.sum(axis=0)[None], rows.T @ rows))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"matrix": pa.array([total.tobytes()], pa.binary())})

    return run


def _sum_of(whitening_blocks: DataFrame, run: Callable, shape: tuple[int, int]) -> np.ndarray:
    grids = whitening_blocks.select("grid")
    parts = _added(grids.mapInArrow(run, "matrix binary"), grids.rdd.getNumPartitions(), _add_matrices, "matrix binary")
    found = sorted(bytes(r["matrix"]) for r in parts.collect())  # the order of tasks does not show in the sum
    return sum((np.frombuffer(p).reshape(shape) for p in found), np.zeros(shape))


def lower_end(apply: Callable[[np.ndarray], np.ndarray], dims: int, options: WhiteningOptions) -> float:
    """About the least eigenvalue, rather below it: the least Ritz value of a few Lanczos steps less the last residual.

    Were an eigenvalue below it, its direction would grow with the wanted ones and be sorted out by Rayleigh-Ritz.
    """
    steps = min(options.probe, dims)
    now = np.random.default_rng(options.seed + 1).standard_normal(dims)
    basis, alphas, betas = [now / np.linalg.norm(now)], [], []
    for _ in range(steps):
        image = apply(basis[-1][:, None])[:, 0]
        alphas.append(float(image @ basis[-1]))
        for known in (*basis, *basis):
            image = image - (image @ known) * known
        betas.append(float(np.linalg.norm(image)))
        if betas[-1] <= 1e-9 * abs(alphas[0]):
            break
        basis.append(image / betas[-1])
    inner = betas[: len(alphas) - 1]
    values = np.linalg.eigvalsh(np.diag(alphas) + np.diag(inner, 1) + np.diag(inner, -1))
    return max(0.0, float(values[0] - betas[-1]))


def filtered(
    apply: Callable[[np.ndarray], np.ndarray], block: np.ndarray, image: np.ndarray, bounds: tuple[float, float], top: float, degree: int
) -> np.ndarray:
    """The Chebyshev polynomial of ``degree`` on the interval, scaled to 1 at ``top``, in the operator, applied to ``block``.

    ``image`` is ``apply(block)``, which the caller has already. The scaling keeps numbers from overflowing.
    """
    centre, half = (bounds[1] + bounds[0]) / 2, (bounds[1] - bounds[0]) / 2
    sigma = first = half / (top - centre)
    before, now = block, (image - centre * block) * (first / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (apply(now) - centre * now) * (2 * following / half) - (sigma * following) * before
        sigma = following
    return now


def leading_pairs(
    apply: Callable[[np.ndarray], np.ndarray], dims: int, trace: float, options: WhiteningOptions = WhiteningOptions()
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greatest eigenvalues (falling), unit eigenvectors in columns, and residuals, of a semidefinite operator with this ``trace``."""
    wanted = min(options.components, dims)
    width = min(dims, wanted + options.guard)
    start = np.random.default_rng(options.seed).standard_normal((dims, width))
    basis = np.linalg.qr(start)[0] if width < dims else np.eye(dims)
    lower = lower_end(apply, dims, options) if width < dims else 0.0
    for _ in range(options.rounds):
        image = apply(basis)
        ritz = basis.T @ image
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        residuals = np.linalg.norm(image - basis * values, axis=0)[:wanted]
        found = residuals <= options.tolerance * values[0]
        if values[0] <= 0 or found.all():
            return values[:wanted], basis[:, :wanted], residuals
        done = int(np.argmin(found))  # leading components that are certified are not filtered any more
        top, last, upper = values[done], values[wanted - 1], values[-1]
        if last - upper < 0.01 * (last - lower):  # a cluster fills the block; of the other directions some at least are below their mean
            upper = min(upper, (trace - values.sum()) / (dims - width))
        upper = max(upper, lower + 1e-8 * top)
        known, active = basis[:, :done], basis[:, done:]

        def rest(matrix: np.ndarray, known: np.ndarray = known, inside: float = (lower + upper) / 2) -> np.ndarray:
            """The operator with the certified directions moved into the interval, where they are damped."""
            image = apply(matrix)
            return image - known @ (known.T @ image - inside * (known.T @ matrix))

        # The greatest active direction may not outgrow the last wanted one beyond what double precision keeps apart.
        growth = [np.arccosh(max(1.0, 1 + 2 * (v - upper) / (upper - lower))) for v in (top, last)]
        degree = max(1, min(options.degree, int(np.log(1e8) / max(growth[0] - growth[1], 1e-9))))
        grown = filtered(rest, active, image[:, done:], (lower, upper), max(top, upper * (1 + 1e-8)), degree)
        basis = np.linalg.qr(np.concatenate((known, grown - known @ (known.T @ grown)), axis=1))[0]
    raise ArithmeticError(f"residual {residuals.max():.3g} after {options.rounds} rounds; widen the block or raise the degree")


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", options: WhiteningOptions = WhiteningOptions()) -> Whitening:
    """Mean and leading components of all vectors of ``vectors`` that count."""
    column = F.col(vector)
    lengths = vectors.where(column.isNotNull() & (F.size(column) > 0)).groupBy(F.size(column).alias("dims")).count()
    most = lengths.agg(F.max(F.struct("count", "dims")).alias("most")).first()["most"]
    dims = most["dims"] if most else 0
    rows = vectors.select(F.col(key).cast("long").alias("key"), column.cast("array<double>").alias("vector"))
    blocks = materialize(rows.mapInArrow(_to_blocks(dims, options.scale), BLOCKS), "grid-blocks")

    grids = blocks.select("grid")
    parts = _added(grids.mapInArrow(_counts(dims), "numbers array<string>"), grids.rdd.getNumPartitions(), _add_texts, "numbers array<string>")
    total = [0] * (1 + 2 * dims)
    for part in parts.collect():
        total = [a + int(b) for a, b in zip(total, part["numbers"], strict=True)]
    n, sums, squares = total[0], total[1 : 1 + dims], total[1 + dims :]
    none = np.zeros(0), np.zeros((dims, 0)), np.zeros(0)
    if not n:
        return Whitening(blocks, 0, sums, 0.0, *none, 0)
    trace = sum(n * q - s * s for q, s in zip(squares, sums, strict=True)) / n**2  # whole numbers up to the division

    exact, passes = np.array(sums, dtype=object), 0

    def apply(matrix: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return _sum_of(blocks, _products(dims, n, exact, matrix), matrix.shape) / n

    values, basis, residuals = leading_pairs(apply, dims, trace, options)
    some = values > 1e-12 * max(values[0], 0)
    return Whitening(blocks, n, sums, trace, values[some], basis[:, some], residuals[some], passes)


def identity_error(white: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, measured by a pass over all rows."""
    width = len(white.values)
    if not width:
        return 0.0
    run = _moments(len(white.sums), white.n, np.array(white.sums, dtype=object), white.vectors * white.scales)
    total = _sum_of(white.blocks, run, (1 + width, width)) / white.n
    covariance = total[1:] - np.outer(total[0], total[0])
    return float(np.abs(covariance - np.eye(width)).max())


def transform(white: Whitening) -> DataFrame:
    """``key, deviation, whitened`` (a double for each component) of every row that counts.

    ``deviation`` is the exact sum over dimensions of ``(n*x - S)^2``; null where a long cannot hold it.
    """
    dims, n, sums, matrix = len(white.sums), white.n, np.array(white.sums, dtype=object), white.vectors * white.scales
    schema = "key long, deviation long, whitened array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, payload in zip(batch.column("keys"), batch.column("grid"), strict=True):
                payload = payload.as_py()
                found = _centred(payload, dims, n, sums) @ matrix
                grid = _unpack(payload, dims)
                reach = n * max(int(np.abs(grid).max()), 1) + max(map(abs, white_sums))
                if reach * reach * dims < 2**63:
                    far = n * grid - sums.astype(np.int64)
                    deviations = (far * far).sum(axis=1).tolist()
                else:
                    far = n * grid.astype(object) - sums
                    deviations = [d if d < 2**63 else None for d in (far * far).sum(axis=1).tolist()]
                ends = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [keys.values, pa.array(deviations, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))],
                    ["key", "deviation", "whitened"],
                )

    white_sums = [int(s) for s in white.sums] or [0]
    return white.blocks.mapInArrow(run, schema)
