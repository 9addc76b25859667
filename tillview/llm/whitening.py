"""Embedding whitening: principal axes by spectral divide and conquer, then a broadcast projection.

Vectors become whole numbers, so sums and products of their deviations from a whole centre are exact
and do not depend on how rows are dealt. Each distinct vector counts once. Spark adds up the covariance;
one square matrix per number of components reaches the driver, which takes it apart: the polar factor
of the matrix less a shift, found by dynamically weighted Halley steps (QDWH) without any eigenvalue
solver, is +1 on the axes above the shift and -1 below. Half of it plus the identity projects on the
upper ones. Both invariant subspaces are split again until each is one axis, or a space in which all axes
are alike. The axes times one over the root of their eigenvalues go to the tasks as a broadcast.

Defined cases: null vectors, vectors with null or non-finite entries or entries whose whole number needs
more than 62 bits, and vectors without entries take no part and are not returned. Vectors of different
lengths are fitted apart. Repeated vectors are fitted once and all returned. Axes whose eigenvalue is zero
to working precision (constant columns, fewer distinct vectors than axes) are not returned; with a single
distinct vector none is, and ``whitened`` is empty. A ``deviation`` beyond the range of long is null. An
empty table gives an empty table. Other columns pass through; input columns named like an added one are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillview.llm.common import add_columns, map_rows, stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
WIDTHS = (1, 2, 4, 8)
EPS = np.finfo(np.float64).eps
ADDED = {
    "n": "long", "deviation": "long", "whitened": "array<double>", "explained": "array<double>", "identity_error": "double",
}


@dataclass
class Axes:
    """What whitening needs to know of the fit list of one vector length."""

    n: int
    centre: np.ndarray  # whole numbers next to the mean of SCALE * entry
    rest: np.ndarray  # sums of the deviations from it, whole numbers
    project: np.ndarray  # one column per axis, divided by the root of its eigenvalue
    explained: np.ndarray
    identity_error: float = 0.0

    def deviations(self, whole: np.ndarray) -> np.ndarray:
        """Exact sums of squares of n * x less the sums over the fit list; masked where too large."""
        far = whole - self.centre
        most = self.n * int(np.abs(far).max(initial=0)) + int(np.abs(self.rest).max(initial=0))
        if whole.shape[1] * most * most < 1 << 63:
            return np.ma.array(((self.n * far - self.rest) ** 2).sum(axis=1))
        exact = [sum(int(v) ** 2 for v in row) for row in self.n * far.astype(object) - self.rest.astype(object)]
        large = [v >= 1 << 63 for v in exact]
        return np.ma.array([0 if big else v for v, big in zip(exact, large, strict=True)], dtype=np.int64, mask=large)

    def whitened(self, whole: np.ndarray) -> np.ndarray:
        return ((whole - self.centre).astype(np.float64) - self.rest / self.n) @ self.project


def whole_vectors(column, scale: int = SCALE) -> list[np.ndarray | None]:
    """floor(scale * entry) of each vector of an Arrow column; None for vectors that take no part."""
    import pyarrow.compute as pc

    sizes = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    values = scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    bad = ~(np.abs(values) < 2.0**62)
    bad_before = np.concatenate([[0], np.cumsum(bad)])
    fine = (bad_before[ends] == bad_before[ends - sizes]) & (sizes > 0)
    whole = np.floor(np.where(bad, 0, values)).astype(np.int64)
    return [whole[e - s : e] if ok else None for e, s, ok in zip(ends.tolist(), sizes.tolist(), fine.tolist(), strict=True)]


def packed(whole: np.ndarray) -> bytes:
    """The numbers in the narrowest width that holds them all; equal vectors are equal bytes."""
    low, high = int(whole.min()), int(whole.max())
    width = next(w for w in WIDTHS if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return bytes([width]) + whole.astype(f"<i{width}").tobytes()


def unpacked(column) -> dict[int, np.ndarray]:
    """Rows of an Arrow column of packed vectors as one matrix per length."""
    parts: dict[tuple[int, int], list[bytes]] = {}
    for data in column.to_pylist():
        parts.setdefault((data[0], (len(data) - 1) // data[0]), []).append(data[1:])
    out: dict[int, list[np.ndarray]] = {}
    for (width, dim), rows in parts.items():
        out.setdefault(dim, []).append(np.frombuffer(b"".join(rows), f"<i{width}").reshape(-1, dim).astype(np.int64))
    return {dim: np.concatenate(matrices) for dim, matrices in out.items()}


def fit_list(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Each distinct vector once, packed; copies meet before the shuffle."""
    import pyarrow as pa

    def run(batch):
        rows = [packed(v) for v in whole_vectors(batch.column(0)) if v is not None]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["data"])

    plain = vectors.select(F.col(vector).cast("array<double>").alias(vector))
    return stored(map_rows(plain, "data binary", run).distinct(), "fit-list")


def sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and exact sums by length; one number per entry reaches the driver."""

    def run(batches):
        import pyarrow as pa

        held: dict[int, list] = {}
        for batch in batches:
            for dim, whole in unpacked(batch.column("data")).items():
                state = held.setdefault(dim, [0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)])
                state[0] += len(whole)
                # Two halves, so that no sum overflows.
                state[1] += (whole >> 31).sum(axis=0)
                state[2] += (whole & (1 << 31) - 1).sum(axis=0)
        for dim, (n, high, low) in held.items():
            totals = [n, *[(h << 31) + v for h, v in zip(high.tolist(), low.tolist(), strict=True)]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * len(totals), pa.int32()), pa.array(range(len(totals)), pa.int32()), pa.array(map(str, totals), pa.string())],
                names=["dim", "entry", "total"],
            )

    parts = fit.mapInArrow(run, "dim int, entry int, total string")
    rows = parts.groupBy("dim", "entry").agg(F.sum(F.col("total").cast("decimal(28,0)")).alias("total")).collect()
    found: dict[int, list[int]] = {r["dim"]: [0] * (r["dim"] + 1) for r in rows}
    for r in rows:
        found[r["dim"]][r["entry"]] = int(r["total"])
    return {dim: (totals[0], totals[1:]) for dim, totals in found.items()}


def outer_sums(fit: DataFrame, far) -> dict[int, np.ndarray]:
    """Sums of the outer products of ``far(dim, whole)`` with itself by length.

    Every task passes on one row per line of its matrix; lines are added up by key, not in one task.
    """
    schema = "dim int, line int, data binary"

    def batch_of(held):
        import pyarrow as pa

        keys = list(held)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([d for d, _ in keys], pa.int32()), pa.array([k for _, k in keys], pa.int32()),
                pa.array([held[key].tobytes() for key in keys], pa.binary()),
            ],
            names=["dim", "line", "data"],
        )

    def multiply(batches):
        products: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, whole in unpacked(batch.column("data")).items():
                x = far(dim, whole)
                products[dim] = products.get(dim, 0) + x.T @ x
        yield batch_of({(dim, k): line for dim, matrix in products.items() for k, line in enumerate(matrix)})

    def add(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for dim, line, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held[dim, line] = held.get((dim, line), 0) + np.frombuffer(data, np.float64)
        yield batch_of(held)

    parts = fit.mapInArrow(multiply, schema)
    rows = parts.repartition("dim", "line").mapInArrow(add, schema).collect()
    lines: dict[int, dict[int, np.ndarray]] = {}
    for r in rows:
        lines.setdefault(r["dim"], {})[r["line"]] = np.frombuffer(r["data"], np.float64)
    return {dim: np.stack([part[k] for k in sorted(part)]) for dim, part in lines.items()}


def polar(x: np.ndarray, steps: int = 30) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH steps.

    The lower bound of the singular values starts at the rounding unit, which is safe and costs one or
    two steps. Early steps go through a QR decomposition, later ones through a Cholesky one.
    """
    n = len(x)
    one = np.eye(n)
    x = x / np.abs(x).sum(axis=0).max()
    low = EPS
    for _ in range(steps):
        low2 = low * low
        root = np.cbrt(4 * (1 - low2) / (low2 * low2))
        a = np.sqrt(1 + root) + 0.5 * np.sqrt(8 - 4 * root + 8 * (2 - low2) / (low2 * np.sqrt(1 + root)))
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        if c > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(c) * x, one]))[0]
            new = b / c * x + (a - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        else:
            lower = np.linalg.cholesky(one + c * (x.T @ x))
            half = np.linalg.solve(lower, x.T)
            new = b / c * x + (a - b / c) * np.linalg.solve(lower.T, half).T
        new = (new + new.T) / 2
        low = min(1.0, low * (a + b * low2) / (1 + c * low2))
        moved = np.linalg.norm(new - x)
        x = new
        if moved < 1e-5 and 1 - low < 1e-8:
            break
    return x


def split(matrix: np.ndarray, shift: float, least: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the axes above and below ``shift``, or None if it does not part them cleanly."""
    n = len(matrix)
    projector = (polar(matrix - shift * np.eye(n)) + np.eye(n)) / 2
    rank = round(float(np.trace(projector)))
    if not 0 < rank < n:
        return None
    # The longest columns span the upper space; two rounds of projecting and orthogonalising clean it.
    start = np.argsort(-np.abs(np.diag(projector)), kind="stable")[:rank]
    rest = np.setdiff1d(np.arange(n), start)
    basis = np.eye(n)[:, [*start, *rest]]
    for _ in range(3):
        joined = np.hstack([projector @ basis[:, :rank], basis[:, rank:] - projector @ basis[:, rank:]])
        basis = np.linalg.qr(joined)[0]
        upper, lower = basis[:, :rank], basis[:, rank:]
        if np.linalg.norm(lower.T @ matrix @ upper) <= least:
            return upper, lower
    return None


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    scale = np.linalg.norm(matrix)
    values, vectors = [], []
    work = [(np.eye(len(matrix)), (matrix + matrix.T) / 2)]
    while work:
        basis, block = work.pop()
        n, diagonal = len(block), np.diag(block)
        if n == 1 or np.linalg.norm(block - diagonal.mean() * np.eye(n)) <= 4 * n * EPS * scale:
            values += diagonal.tolist()
            vectors.append(basis)
            continue
        if np.linalg.norm(block - np.diag(diagonal)) <= EPS * scale:
            # Already apart: every column is an axis.
            values += diagonal.tolist()
            vectors.append(basis)
            continue
        low, high = diagonal.min(), diagonal.max()
        shifts = [np.median(diagonal), diagonal.mean(), *(low + (high - low) * np.linspace(0.03, 0.97, 23))]
        # The mean lies between the least and the largest eigenvalue, so some shift parts them.
        for least in (8 * n * EPS * scale, 1e3 * n * EPS * scale):
            parts = next((p for p in (split(block, float(s), least) for s in shifts) if p), None)
            if parts:
                break
        else:
            raise ArithmeticError("no shift parts the eigenvalues")
        for part in parts:
            inner = part.T @ block @ part
            work.append((basis @ part, (inner + inner.T) / 2))
    found = np.hstack(vectors)
    order = np.argsort(-np.array(values), kind="stable")
    found = found[:, order]
    # Either sign is an axis: the entry of largest size is positive.
    found = found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    return np.einsum("ij,ij->j", found, matrix @ found), found


def fitted(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Axes]:
    """Axes by vector length, of the table that ``fit_list`` returns."""
    totals = sums(fit)
    centres = {dim: np.array([(2 * s + n) // (2 * n) for s in total], dtype=np.int64) for dim, (n, total) in totals.items()}
    products = outer_sums(fit, lambda dim, whole: (whole - centres[dim]).astype(np.float64))
    axes = {}
    for dim, (n, total) in totals.items():
        rest = np.array([s - n * c for s, c in zip(total, centres[dim].tolist(), strict=True)], dtype=np.int64)
        off = rest / n
        covariance = products[dim] / n - np.outer(off, off)
        values, vectors = eigen(covariance) if covariance.any() else (np.zeros(dim), np.eye(dim))
        used = [k for k in range(min(components, dim)) if values[k] > dim * EPS * values[0]]
        axes[dim] = Axes(
            n, centres[dim], rest, vectors[:, used] / np.sqrt(values[used]), values[used] / (np.trace(covariance) or 1.0)
        )

    def whitened(dim, whole):
        # The column of ones carries the sums, which centre the products.
        return np.hstack([axes[dim].whitened(whole), np.ones((len(whole), 1))])

    for dim, product in outer_sums(fit, whitened).items():
        n, mean = axes[dim].n, product[-1, :-1] / product[-1, -1]
        gap = product[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(mean))
        axes[dim].identity_error = float(np.abs(gap).max(initial=0.0))
    return axes


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vectors`` with ``whitened`` and what it rests on (``ADDED``); rows that take no part are gone.

    ``deviation`` is the exact sum over entries of (n * x - S)^2, with x = floor(64 * entry) + 1000000 and
    S its sums over the fit list; the constant cancels out.
    """
    axes = vectors.sparkSession.sparkContext.broadcast(fitted(fit_list(vectors, vector), components))

    def run(column):
        import pyarrow as pa

        whole = whole_vectors(column.cast(pa.list_(pa.float64())))
        rows: dict[str, list] = {name: [None] * len(whole) for name in ADDED}
        by_size: dict[int, list[int]] = {}
        for k, v in enumerate(whole):
            if v is not None:
                by_size.setdefault(len(v), []).append(k)
        for dim, at in by_size.items():
            known, block = axes.value[dim], np.stack([whole[k] for k in at])
            explained = known.explained.tolist()
            for k, far, values in zip(at, known.deviations(block).tolist(), known.whitened(block).tolist(), strict=True):
                for name, value in zip(ADDED, (known.n, far, values, explained, known.identity_error), strict=True):
                    rows[name][k] = value
        return list(rows.values())

    return add_columns(vectors, [vector], ADDED, run).where("n IS NOT NULL")
