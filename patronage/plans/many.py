"""Many clusterings at once: every k, restart and group of a table in the same passes.

Rows are (group, key, x). A pass reads the rows once; each task adds up, for every model of a row's group, sums by
centre, and only these partial sums are shuffled, so a group of any size is spread over all tasks and a hundred models
cost the readings of one. Centres live with the driver: their number is bounded by ``MOST_CENTRES`` for one pass, and
more models are taken in several blocks.

Starting points are drawn as k-means++ does it, one further point for all models in each pass: a row's chance is its
squared distance to the nearest centre so far, by the smallest of -ln(u) / d, with u from a hash of its key, so that
reruns and other partitionings draw the same points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.sources.landing import work_path

#: Centres of all models of one pass at most; rows that one numpy step measures against them; rows that a task holds while it packs, bytes of its blocks in a unit of its file.
MOST_CENTRES, STEP_ROWS, HELD_ROWS, BLOCK_BYTES = 20_000, 2_000, 200_000, 8 << 20
#: Squared distances closer than this share of the squared lengths are not told apart by products.
CLOSE = 1e-10


@dataclass
class Model:
    """One clustering of one group."""

    group: str
    k: int
    seed: int
    centers: np.ndarray
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    inertia: float = float("nan")
    silhouette: float = float("nan")
    rounds: int = 0
    active: bool = True


def stash_points(points: DataFrame, group: str | None = None, key: str = "customer_id") -> DataFrame:
    """(group, key, h, x) in the shared folder: what the passes read. Without ``group`` all rows are one group."""
    path = work_path(points.sparkSession, "points")
    name = F.col(group).cast("string") if group else F.lit("")
    points.select(name.alias("group"), F.col(key).alias("key"), F.xxhash64(key).alias("h"), "x").write.parquet(path)
    return points.sparkSession.read.parquet(path)


def packed(points: DataFrame) -> DataFrame:
    """The points in the shared folder as blocks of up to ``STEP_ROWS`` rows of a group: their hashes and their matrix as bytes.

    Some tens of passes read them, and a block costs a pass as little as one row did. Keys are left out.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list] = {}
        rows: dict[str | None, int] = {}

        def block(group: str | None) -> pa.RecordBatch:
            parts = held.pop(group)
            h, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            return pa.RecordBatch.from_arrays([pa.array([group], pa.string()), pa.array([rows.pop(group)], pa.int32()), pa.array([h.tobytes()]), pa.array([x.tobytes()])], ["group", "n", "h", "x"])

        for batch in batches:
            for group, _, h, x in _steps(batch):
                if rows.get(group, 0) + len(h) > STEP_ROWS:
                    yield block(group)
                held.setdefault(group, []).append((h, x))
                rows[group] = rows.get(group, 0) + len(h)
            if sum(rows.values()) > HELD_ROWS:
                for group in list(rows):
                    yield block(group)
        for group in list(rows):
            yield block(group)

    path = work_path(points.sparkSession, "blocks")
    points.mapInArrow(each, "group string, n int, h binary, x binary").write.option("parquet.block.size", BLOCK_BYTES).parquet(path)
    return points.sparkSession.read.parquet(path)


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[str | None, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, row numbers, hashes, matrix) of the rows of each group in a batch, in steps of bounded size; of packed points each block, without row numbers."""
    if pa.types.is_binary(batch.schema.types[3]) or pa.types.is_large_binary(batch.schema.types[3]):
        for group, n, h, x in zip(*batch.columns, strict=True):
            yield group.as_py(), np.zeros(0, np.int64), np.frombuffer(h.as_buffer(), np.int64), np.frombuffer(x.as_buffer()).reshape(n.as_py(), -1)
        return
    coded = batch.column(0).dictionary_encode()
    codes, h = coded.indices.fill_null(-1).to_numpy(), batch.column(2).to_numpy()
    column = batch.column(3)
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
    for c in np.unique(codes):
        rows = np.flatnonzero(codes == c)
        d = int(starts[rows[0] + 1] - starts[rows[0]])
        name = coded.dictionary[int(c)].as_py() if c >= 0 else None
        for at in range(0, len(rows), STEP_ROWS):
            part = rows[at : at + STEP_ROWS]
            yield name, part, h[part], flat[starts[part][:, None] + np.arange(d)]


def _far(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    out = np.zeros((len(x), len(centers)))
    for i in range(x.shape[1]):
        out += (x[:, i, None] - centers[:, i]) ** 2
    return out


def _unit(h: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from hashes and a salt."""
    z = h.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53) + 2.0**-54


def _by_group(models: list[Model]) -> dict[str | None, list[int]]:
    out: dict[str | None, list[int]] = {}
    for m, model in enumerate(models):
        out.setdefault(model.group, []).append(m)
    return out


def sums_by_centre(points: DataFrame, models: list[Model], width: int, add: Callable[[np.ndarray, np.ndarray, Model, int], tuple[np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
    """One pass: for each model the sum over its rows of what ``add`` gives, a matrix of (centres, width).

    ``add`` takes the rows, their hashes, the model and its number, and returns that matrix for these rows.
    """
    return _summed(points, models, width, lambda x, h, own: ((m, add(x, h, models[m], m)) for m in own))


def _summed(points: DataFrame, models: list[Model], width: int, add_all: Callable[[np.ndarray, np.ndarray, list[int]], Iterable[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """``sums_by_centre`` with a function that takes the numbers of all models of a group at once."""
    of = _by_group(models)
    names = [f"s{i}" for i in range(width)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for group, _, h, x in _steps(batch):
                for m, part in add_all(x, h, of.get(group, [])):
                    total[m] = total[m] + part if m in total else part
        if total:
            which = np.concatenate([np.full(len(t), m, np.int32) for m, t in total.items()])
            centre = np.concatenate([np.arange(len(t), dtype=np.int32) for t in total.values()])
            rows = np.concatenate([np.pad(t, ((0, 0), (0, width - t.shape[1]))) for t in total.values()])
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(centre), *[pa.array(rows[:, i]) for i in range(width)]], ["m", "c", *names])

    sent = points.mapInArrow(each, "m int, c int, " + ", ".join(f"{n} double" for n in names))
    out: dict[int, list] = {}
    for r in sent.groupBy("m", "c").agg(*[F.sum(n).alias(n) for n in names]).collect():
        out.setdefault(r["m"], []).append((r["c"], [r[n] for n in names]))
    return {m: np.array([v for _, v in sorted(rows)]) for m, rows in out.items()}


def _draw(points: DataFrame, models: list[Model], step: int) -> None:
    """One further starting centre for every active model."""
    of = _by_group(models)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            for group, _, h, x in _steps(batch):
                for m in of.get(group, ()):
                    model = models[m]
                    far = _far(x, model.centers).min(1) if len(model.centers) else np.ones(len(x))
                    with np.errstate(divide="ignore"):
                        score = np.where(far > 0, -np.log(_unit(h, 1_000_003 * model.seed + 101 * model.k + step)) / far, np.inf)
                    least = np.flatnonzero(score == score.min())
                    i = int(least[h[least].argmin()])
                    if np.isfinite(score[i]) and (m not in best or (score[i], h[i]) < best[m][:2]):
                        best[m] = (score[i], h[i], x[i])
        if best:
            rows = list(best.items())
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in rows], pa.int32()), pa.array([b[0] for _, b in rows]), pa.array([int(b[1]) for _, b in rows]), pa.array([b[2].tolist() for _, b in rows])], ["m", "score", "h", "x"])

    found = points.mapInArrow(each, "m int, score double, h long, x array<double>").groupBy("m").agg(F.min(F.struct("score", "h", "x")).alias("b")).collect()
    drawn = {r["m"]: np.array(r["b"]["x"]) for r in found}
    for m, model in enumerate(models):
        if m in drawn:
            model.centers = np.vstack([model.centers.reshape(-1, len(drawn[m])), drawn[m][None]])


def _lloyd(x: np.ndarray, h: np.ndarray, model: Model, m: int) -> np.ndarray:
    """Sums, counts, squared lengths and squared distances of rows by their nearest centre."""
    far = _far(x, model.centers)
    near = far.argmin(1)
    hot = np.zeros((len(model.centers), len(x)))
    hot[near, np.arange(len(x))] = 1
    return np.column_stack([hot @ x, hot.sum(1), hot @ (x * x).sum(1), hot @ far[np.arange(len(x)), near]])


def _step(points: DataFrame, models: list[Model], d: int) -> dict[int, np.ndarray]:
    """Sums, counts, squared lengths and squared distances of rows by their nearest centre, a step of all models.

    Models of one group and k are measured together: one matrix product gives the distances to all their centres but for
    the rows' own lengths, which change no choice, another the sums of the rows by their nearest; distances follow from these.
    """

    def add_all(x: np.ndarray, h: np.ndarray, own: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        by_k: dict[int, list[int]] = {}
        for m in own:
            by_k.setdefault(len(models[m].centers), []).append(m)
        if own:
            # Measured from the middle of these rows, so that few digits are lost where values are large.
            middle = x.mean(0)
            away = x - middle
            columns = np.column_stack([x, np.ones(len(x)), (x * x).sum(1), away, (away * away).sum(1)])
        for k, same in by_k.items():
            centers = np.concatenate([models[m].centers for m in same]) - middle
            long = (centers * centers).sum(1)
            far = (long[:, None] - 2 * (centers @ away.T)).reshape(len(same), k, -1)
            hot = far <= (far.min(1) + CLOSE * (columns[:, -1] + long.max()))[:, None]
            which, rows = np.nonzero(hot.sum(1) > 1)
            if len(rows):  # where products cannot tell, differences do, and of equals the first is nearest
                exact, every = np.zeros((len(rows), k)), np.stack([models[m].centers for m in same])
                for i in range(x.shape[1]):
                    exact += (x[rows, i, None] - every[which, :, i]) ** 2
                hot[which, :, rows] = np.arange(k) == exact.argmin(1)[:, None]
            sums = hot.reshape(len(centers), -1).astype(np.float64) @ columns
            width = x.shape[1]
            inner = sums[:, 2 * width + 2] - 2 * (centers * sums[:, width + 2 : 2 * width + 2]).sum(1) + sums[:, width] * long
            yield from zip(same, np.column_stack([sums[:, : width + 2], np.maximum(inner, 0)]).reshape(len(same), k, -1), strict=True)

    return _summed(points, models, d + 3, add_all)


def _width(points: DataFrame) -> int:
    return points.agg(F.max(F.size("x")).alias("d")).first()["d"] or 0


def _blocks(models: list[Model]) -> Iterator[list[Model]]:
    block, held = [], 0
    for model in models:
        if block and held + model.k > MOST_CENTRES:
            yield block
            block, held = [], 0
        block.append(model)
        held += model.k
    if block:
        yield block


def evaluate(points: DataFrame, models: list[Model], d: int | None = None) -> list[Model]:
    """Sizes, inertia and silhouette of given centres, each row with its nearest; two passes for all models.

    The silhouette is that of squared Euclidean distances, whose means over a cluster follow from the cluster's sums;
    a row alone in its cluster scores 0, a model with one cluster that has rows -1.
    """
    d = _width(points) if d is None else d
    for block in _blocks(models):
        found = sums_by_centre(points, block, d + 3, _lloyd)
        stats = {}
        for m, s in found.items():
            own = block[m].centers.shape[1]
            n = s[:, own]
            block[m].sizes, block[m].inertia = n.astype(np.int64), float(s[:, own + 2].sum())
            safe = np.maximum(n, 1)
            stats[m] = n, s[:, :own] / safe[:, None], s[:, own + 1] / safe

        def score(x: np.ndarray, h: np.ndarray, model: Model, m: int, stats=stats) -> np.ndarray:
            n, mean, square = stats[m]
            near = _far(x, model.centers).argmin(1)
            to = (x * x).sum(1)[:, None] - 2 * x @ mean.T + square
            at = np.arange(len(x))
            inner = to[at, near] * n[near] / np.maximum(n[near] - 1, 1)
            to[:, n == 0] = np.inf
            to[at, near] = np.inf
            other = to.min(1)
            with np.errstate(invalid="ignore", divide="ignore"):
                s = np.where((n[near] > 1) & np.isfinite(other) & (np.maximum(inner, other) > 0), (other - inner) / np.maximum(inner, other), 0.0)
            return np.array([[s.sum()]])

        many = [m for m, (n, *_) in stats.items() if (n > 0).sum() > 1]
        totals = sums_by_centre(points, [block[m] for m in many], 1, lambda x, h, model, m, many=many, score=score: score(x, h, model, many[m])) if many else {}
        for m in stats:
            block[m].silhouette = -1.0
        for i, m in enumerate(many):
            block[m].silhouette = float(totals[i][0, 0] / block[m].sizes.sum())
    return models


def kmeans_many(points: DataFrame, wanted: dict[str | None, list[int]], restarts: int = 10, rounds: int = 100, tolerance: float = 1e-4, seed: int = 1) -> dict[tuple[str | None, int], Model]:
    """For each group and each of its k the restart of least inertia, with sizes and silhouette.

    A k of which a group has too few different rows is left out. ``tolerance`` is the squared shift of all centres of a
    model at which it stops.
    """
    d, points = _width(points), packed(points)
    models = [Model(g, k, seed * 1000 + r, np.zeros((0, 0))) for g, ks in wanted.items() for k in ks for r in range(restarts)]
    best: dict[tuple, Model] = {}
    for block in _blocks(models):
        for step in range(max(m.k for m in block)):
            growing = [m for m in block if m.k > step and len(m.centers) == step]
            if growing:
                _draw(points, growing, step)
        block = [m for m in block if len(m.centers) == m.k]
        for _ in range(rounds):
            moving = [m for m in block if m.active]
            if not moving:
                break
            for m, s in _step(points, moving, d).items():
                model, own = moving[m], moving[m].centers.shape[1]
                n = s[:, own]
                new = np.where(n[:, None] > 0, s[:, :own] / np.maximum(n, 1)[:, None], model.centers)
                # The inertia belongs to the centres before this step; the last step hardly moves them.
                model.active, model.inertia = bool(((new - model.centers) ** 2).sum() > tolerance), float(s[:, own + 2].sum())
                model.centers, model.rounds = new, model.rounds + 1
        for m in block:
            key = (m.group, m.k)
            if key not in best or m.inertia < best[key].inertia:
                best[key] = m
    for m in best.values():
        m.centers = m.centers[np.lexsort(m.centers.T[::-1])]
    evaluate(points, list(best.values()), d)
    return best


def fuzzy_many(points: DataFrame, ks: list[int], m: float = 2.0, rounds: int = 150, tolerance: float = 1e-5, seed: int = 5, starts: dict[int, np.ndarray] | None = None) -> dict[int, Model]:
    """Fuzzy c-means of one group for several k in the same passes, each until its memberships change by less than ``tolerance`` in all (their L2 norm).

    Memberships are a function of the centres and are never stored: a pass works out those before and after the last
    step. Starting memberships are drawn by a hash of the key, alike for any partitioning, or are those of the centres
    in ``starts`` for each k.
    """
    d = _width(points)
    models = [Model("", k, seed, np.zeros((k, d))) for k in ks]
    before: list[np.ndarray | None] = [None] * len(models)

    def soft(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
        near = np.maximum(_far(x, centers), 1e-20) ** (-1 / (m - 1))
        return near / near.sum(1, keepdims=True)

    def start(x: np.ndarray, h: np.ndarray, k: int) -> np.ndarray:
        if starts is not None:
            return soft(x, starts[k])
        u = np.stack([_unit(h, 7919 * seed + 31 * k + c) for c in range(k)], 1)
        return u / u.sum(1, keepdims=True)

    for no in range(rounds + 1):
        moving = [i for i, model in enumerate(models) if model.active]
        if not moving:
            break

        def add(x: np.ndarray, h: np.ndarray, model: Model, i: int, moving=moving, no=no) -> np.ndarray:
            u = start(x, h, model.k) if no == 0 else soft(x, model.centers)
            if no == 0:
                change = np.full(len(x), np.inf)
            else:
                old = start(x, h, model.k) if no == 1 else soft(x, before[moving[i]])
                change = ((u - old) ** 2).sum(1)
            w = u**m
            return np.column_stack([w.T @ x, w.sum(0), np.full(model.k, change.sum())])

        found = sums_by_centre(points, [models[i] for i in moving], d + 2, add)
        if not found:
            break
        for place, s in found.items():
            model = models[moving[place]]
            if no and np.sqrt(s[0, d + 1]) < tolerance or no == rounds:
                model.active = False
                continue
            before[moving[place]] = model.centers
            model.centers, model.rounds = s[:, :d] / np.maximum(s[:, d : d + 1], 1e-300), no + 1
    for model in models:
        model.centers = model.centers[np.lexsort(model.centers.T[::-1])]
    return {model.k: model for model in evaluate(points, models)}


def labelled(points: DataFrame, centers: dict[str | None, np.ndarray], schema: str) -> DataFrame:
    """The rows of ``points`` with ``label``, the number of the nearest centre of their group (-1 without any), and ``far``, the distance to it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, far = np.full(batch.num_rows, -1, np.int32), np.full(batch.num_rows, np.nan)
            for group, rows, _, x in _steps(batch):
                if group in centers:
                    d = _far(x, centers[group])
                    label[rows] = d.argmin(1)
                    far[rows] = np.sqrt(d.min(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label), pa.array(far)], [*batch.schema.names, "label", "far"])

    return points.mapInArrow(each, f"{schema}, label int, far double")
