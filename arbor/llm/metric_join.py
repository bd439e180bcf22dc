"""Exact near-duplicate join of vectors: a metric range join with pivots.

cosine >= c means that unit vectors are within r = sqrt(2 - 2 c). Every vector is at home in the cell of its
nearest pivot. If y at home in cell p is within r of x, then |x p| <= |x y| + |y p| <= r + |y h| <= 2 r + |x h| where
h is the home of x. Cells are packed into parts of about `side` vectors, a large cell into several, and a square is two parts, or
one with itself: x goes to the squares of its own part with the parts of cells that have |x p| <= |x h| + 2 r, and to no other. That holds from
both ends of a link, so each link is found in exactly one square, and each pair is multiplied at most once.

Equal vectors are one point with a count, so copies are never paired. A square returns, for each of its vectors that
has links, the number of vectors linked to it there, and a spanning forest of its links: rows grow with its vectors,
not with its links, and a square keeps one stripe of products at a time.

Pivots are at most PIVOTS points with the least hash (a documented bound); they decide the speed, not the
result. In high dimensions the triangle inequality excludes little: then products near n * n / 2, and shuffled rows
n * n / side, as floats where the input has floats. A side is SPREAD times `side_of(n)`: 16,384 vectors up to 262,144, then 32 * sqrt(n), but no more
than SIDE_BYTES of doubles: about 4 n rows at 51,282 vectors, 32 n at a million. Products are made in single
precision; those nearer to the bound than its rounding are summed again in double precision.

Rules. Vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of
other lengths than most link only with their own length. Null ids are allowed and are one id below all
others. The input's other columns are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbor.llm.cells import NULL_ID
from arbor.llm.components import connected_components

PIVOTS = 24
BLOCK = 4096
MOST_BLOCK = 32768
#: Blocks a side of a square, and bytes of a side as doubles, at most.
SPREAD, SIDE_BYTES = 4, 32 << 20
#: Slack for rounding in distances and products; pairs inside it are compared in a fixed order of summation.
EPS = 1e-9


def _matrix(col, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), dim)


def usable(v: Column) -> Column:
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.isNotNull() & F.coalesce(F.forall(v, good) & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _near(b, pivots: np.ndarray) -> np.ndarray:
    x = _unit(_matrix(b.column("vec"), pivots.shape[1]))
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def _homes(pivots: np.ndarray):
    def run(batches):
        for b in batches:
            if len(b):
                yield pa.record_batch([pa.array(_near(b, pivots).argmin(1), pa.int32())], ["cell"])

    return run


def parts_of(sizes: list[int], side: int) -> list[range]:
    """The parts of each cell: several for one larger than a side, one shared by small cells that fit into a side together."""
    out, n, room = [], 0, 0
    for size in sizes:
        if size > side:
            out.append(range(n, n - (-size // side)))
            n, room = out[-1].stop, 0
        else:
            if size > room or not out:
                n, room = n + 1, side
            out.append(range(n - 1, n))
            room -= size
    return out


def _place(pivots: np.ndarray, r: float, parts: list[range]):
    """Each row with its part and the parts that may hold vectors within r."""
    first, many = np.array([p.start for p in parts]), np.array([len(p) for p in parts])
    holds = np.zeros((len(parts), max(p.stop for p in parts)), np.float32)
    for c, p in enumerate(parts):
        holds[c, p.start : p.stop] = 1

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            d = _near(b, pivots)
            home = d.argmin(1)
            part = first[home] + b.column("deal").to_numpy() % many[home]
            reach = (d <= d.min(1, keepdims=True) + 2 * r + EPS).astype(np.float32) @ holds > 0
            ends = np.concatenate([[0], reach.sum(axis=1).cumsum()])
            to = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(reach)[1], pa.int32()))
            yield pa.record_batch([pa.array(part, pa.int32()), to, b.column("point"), b.column("times"), b.column("vec")], ["part", "to", "point", "times", "vec"])

    return run


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> list:
    """Links (a, b) that join trees of the forest whose labels these are; the labels are changed."""
    keep = []
    while len(a):
        open_ = np.flatnonzero(label[a] != label[b])
        a, b = a[open_], b[open_]
        if not len(a):
            break
        hi, lo = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
        order = np.lexsort((lo, hi))
        first = order[np.concatenate([[True], hi[order][1:] != hi[order][:-1]])]
        keep += zip(a[first].tolist(), b[first].tolist())
        label[hi[first]] = lo[first]
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
    return keep


_SQUARE = "point long, linked long, a long, b long"


def _square(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        own = table["side"].to_numpy()
        dim = len(table["vec"][0])
        point, times = table["point"].to_numpy(), table["times"].to_numpy()
        x = _unit(_matrix(table["vec"], dim))
        h, o = np.flatnonzero(own == 0), np.flatnonzero(own == 1)
        one = table["lo"][0].as_py() == table["hi"][0].as_py()
        o = h if one else o
        rough, other = x[h].astype(np.float32), x[o].astype(np.float32)
        slack = EPS + (dim + 8) * 2.0**-23  # more than single precision can be off for unit vectors
        count, label, forest = np.zeros(len(point), np.int64), np.arange(len(point)), []
        rows, some = max(16, (1 << 21) // max(1, len(o))), max(1, (1 << 21) // dim)  # 8 MB of products, 16 MB of rows at once
        for at in range(0, len(h), rows):
            skip = at if one else 0  # a part with itself: pairs above the diagonal only
            s = rough[at : at + rows] @ other[skip:].T
            i, j = np.nonzero(s >= cosine - slack)
            if one:
                up = np.flatnonzero(j > i)
                i, j = i[up], j[up]
            ok, left, right = s[i, j] >= cosine + slack, h[at + i], o[skip + j]
            close = np.flatnonzero(~ok)
            for k in range(0, len(close), some):
                c = close[k : k + some]
                ok[c] = (x[left[c]] * x[right[c]]).sum(axis=1) >= cosine
            left, right = left[ok], right[ok]
            count += np.bincount(left, times[right], len(point)).astype(np.int64) + np.bincount(right, times[left], len(point)).astype(np.int64)
            forest += _joined(label, left, right)
        linked, f, none = np.flatnonzero(count), np.array(forest, np.int64).reshape(-1, 2), [None]
        column = lambda some, rest: pa.array([*some, *rest], pa.int64())
        return pa.table({"point": column(point[linked].tolist(), none * len(f)), "linked": column(count[linked].tolist(), none * len(f)), "a": column(none * len(linked), point[f[:, 0]].tolist()), "b": column(none * len(linked), point[f[:, 1]].tolist())})

    return run


def side_of(n: int, block: int = BLOCK) -> int:
    """Vectors a side of a square for n vectors."""
    return max(block, min(MOST_BLOCK, int(8 * math.sqrt(n))))


def squares(vectors: DataFrame, cosine: float, pivots: int, block: int) -> DataFrame | None:
    """Vectors of one length (point, times, vec) in the squares (lo, hi) that they go to, with the side that is theirs."""
    r = math.sqrt(max(0.0, 2 - 2 * cosine))
    chosen = vectors.orderBy(F.xxhash64("vec"), "point").limit(pivots).select("vec").collect()  # at most `pivots` vectors
    if not chosen:
        return None
    p = _unit(np.array([c.vec for c in chosen], np.float64))
    sizes = {c.cell: c.n for c in vectors.mapInArrow(_homes(p), "cell int").groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a pivot
    side = max(1, min(SPREAD * side_of(sum(sizes.values()), block), SIDE_BYTES // (8 * p.shape[1])))
    parts = parts_of([sizes.get(c, 0) for c in range(len(p))], side)
    kind = vectors.schema["vec"].dataType.simpleString()
    dealt = vectors.withColumn("deal", F.pmod(F.xxhash64("point", F.lit(1)), F.lit(1 << 30)))
    dealt = dealt.mapInArrow(_place(p, r, parts), f"part int, to array<int>, point long, times long, vec {kind}").select("*", F.explode("to").alias("at"))
    lo, hi = F.least("part", "at").alias("lo"), F.greatest("part", "at").alias("hi")
    return dealt.select(lo, hi, (F.col("part") > F.col("at")).cast("int").alias("side"), "point", "times", "vec")


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    kind = "float" if vectors.select(vec_col).schema[0].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
    ready = rows.withColumn("vec", F.when(usable(F.col("vec")), F.transform("vec", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x))))
    grouped = ready.where("vec is not null").groupBy("vec").agg(F.count("*").alias("times"), F.min("vec_id").alias("least_id"))
    points = grouped.withColumn("point", F.xxhash64("vec", "least_id")).checkpoint()
    lengths = [x.n for x in points.select(F.size("vec").alias("n")).groupBy("n").count().orderBy("n").collect()]
    dealt = [squares(points.where(F.size("vec") == n).select("point", "times", "vec"), cosine, pivots, block) for n in lengths]
    parts = [q.groupBy("lo", "hi").applyInArrow(_square(cosine), _SQUARE) for q in dealt if q is not None]
    if not parts:
        links = vectors.sparkSession.createDataFrame([], _SQUARE)
    else:
        links = parts[0]
        for q in parts[1:]:
            links = links.unionByName(q)
        links = links.checkpoint()
    counts = links.where("point is not null").groupBy("point").agg(F.sum("linked").alias("linked"))
    comps = connected_components(links.where("a is not null").select("a", "b"))
    of_point = points.join(counts, "point", "left").join(comps.withColumnRenamed("node", "point"), "point", "left").withColumn("component", F.coalesce("component", "point"))
    least = of_point.groupBy("component").agg(F.min("least_id").alias("component_id"))
    found = of_point.join(least, "component").select("vec", (F.coalesce("linked", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    linked = ready.where("vec is not null").join(found, "vec").select("vec_id", "n_links", "component_id")
    alone = ready.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return linked.unionByName(alone).select(back("vec_id"), "n_links", back("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept"))
