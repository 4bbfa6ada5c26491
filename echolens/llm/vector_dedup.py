"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one representative per group.

Equal vectors are first counted as one class. K-means is fitted on a bounded sample (``FIT_ROWS`` classes by hash) with
one cell per ``CELL`` vectors; then every class goes to its nearest cell and, as a guest, to every other cell that can
hold a vector linked with it. Three cuts of guests lose no link: a border further off than sin(acos(threshold)), which
no angle of a link spans (``exact_margin``, the default); a centroid further off than the angle of a link and the widest
angle of the cell's own vectors together; and of two cells only one takes guests of the other (``takes``), where a link
counts for both its ends. A ``margin`` below the bound is faster and may miss links. Within a cell, the vectors at home
are dealt to blocks of about ``ROWS`` and all its vectors to blocks of about ``MEMBERS``; each pair of blocks is one
task of matrix products, so a hot cell is many tasks. A task returns counts and a spanning forest of its links, never
the pairs. Guests are found anew where they are needed, so no copy of a vector is written but by the shuffle.

Cases: null, empty or zero vectors and vectors with null, NaN or infinite parts link with nothing and are kept; vectors
of different length never link; equal vectors link with cosine 1; rows that share a vec_id are one node of the graph
but a row each in the result; a null vec_id links with nothing; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import components
from .frames import table, written
from .langid import cluster

THRESHOLD = 0.9
SLACK = 1e-4  # far above the rounding of borders and angles; it only adds guests
FIT_ROWS, CELL, MAX_CELLS, ROWS, MEMBERS, STEP = 65_536, 2048, 4096, 4096, 16_384, 512


def centroids_of(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    x = unit(np.array(frame.sort_values("h")["v"].tolist(), float))
    found, _ = cluster(x, k)
    return pd.DataFrame({"dim": x.shape[1], "vector": list(found)})


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def exact_margin(threshold: float) -> float:
    """A border this far off is crossed by no link: borders are planes through the origin."""
    return float(np.sin(np.arccos(min(threshold, 1.0)))) + SLACK if threshold > 0 else np.inf


def takes(cell: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether ``cell`` takes guests of ``other``: true for one of any two cells, and evenly dealt."""
    return (cell > other) == ((cell + other) % 2 == 0)


def homes_of(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The products with all centroids, and the nearest cell of each row."""
    near = x @ centroids.T
    return near, near.argmax(axis=1)


def cells_of(x: np.ndarray, centroids: np.ndarray, margin: float, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, is home): the nearest cell of each row, and the cells it is a guest of. ``least``: smallest product of a guest per cell."""
    near, home = homes_of(x, centroids)
    square = (centroids**2).sum(axis=1)
    apart = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * (centroids @ centroids.T), 1e-10))
    border = (near[np.arange(len(x)), home][:, None] - near) / apart[home]
    inside = (border <= margin) & (near >= least) & takes(np.arange(len(centroids))[None, :], home[:, None])
    inside[np.arange(len(x)), home] = True
    row, cell = np.nonzero(inside)
    return row, cell, cell == home[row]


def compare(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of a block at home with a block of members: weighted links per class at home and per guest, and star edges of the groups."""
    frame = frame.sort_values(["rep", "h", "at_home"], kind="stable").reset_index(drop=True)
    x = unit(np.array(frame["v"].tolist(), float))
    node = frame.groupby(["rep", "h"], sort=True).ngroup().to_numpy().astype(np.int32)
    home, member = np.flatnonzero(frame["at_home"]), np.flatnonzero(~frame["at_home"])
    weight, to = frame["n"].to_numpy(np.float64)[member], np.ascontiguousarray(x[member].T)
    guest, own_weight = np.flatnonzero(~frame["home"].to_numpy()[member]), frame["n"].to_numpy(np.float64)
    links, guest_links, packed = np.zeros(len(home), np.int64), np.zeros(len(guest)), []
    for low in range(0, len(home), STEP):
        own = home[low : low + STEP]
        link = (x[own] @ to >= threshold) & (node[own][:, None] != node[member][None, :])
        links[low : low + STEP] = link @ weight
        guest_links += own_weight[own] @ link[:, guest]
        packed.append(np.packbits(link, axis=1))
    first = np.full(node.max() + 1, len(frame))
    np.minimum.at(first, node, np.arange(len(frame)))
    label, none, moved = np.arange(node.max() + 1, dtype=np.int32), np.int32(node.max() + 1), bool(links.any())
    while moved:  # the smallest node that is reached, until nothing changes
        before = label.copy()
        for k, low in enumerate(range(0, len(home), STEP)):
            own = node[home[low : low + STEP]]
            link = np.unpackbits(packed[k], axis=1, count=len(member)).astype(bool)
            np.minimum.at(label, own, np.where(link, label[node[member]][None, :], none).min(axis=1))
            np.minimum.at(label, node[member], np.where(link, label[own][:, None], none).min(axis=0))
        label = label[label]
        moved = (label != before).any()
    rep, h = frame["rep"].to_numpy()[first], frame["h"].to_numpy()[first]
    count = np.zeros(len(rep), np.int64)
    np.add.at(count, node[home], links)
    np.add.at(count, node[member[guest]], guest_links.astype(np.int64))
    out = pd.DataFrame({"rep": rep, "h": h, "links": count, "other": rep[label]})
    return out[(out["links"] > 0) | (label != np.arange(len(label)))]


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, margin: float | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    margin = exact_margin(threshold) if margin is None else margin
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0) & F.col("vec_id").isNotNull()
    plus_zero = F.transform("v", lambda c: F.when(c == 0, F.lit(0).cast(kind)).otherwise(c))  # -0 equals 0
    rows = written(rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("v", F.when(F.col("sound"), plus_zero)), "vectors")
    member = rows.withColumn("h", F.xxhash64("v"))
    classes = member.filter("sound").groupBy("v", "h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = written(classes.withColumn("dim", F.size("v")), "vector-classes")
    total = classes.count()
    cells = min(MAX_CELLS, max(1, total // CELL))
    sample = classes.orderBy(F.xxhash64("h", F.lit(7)), "h").limit(FIT_ROWS)
    found = sample.groupBy("dim").applyInPandas(lambda f: centroids_of(f, cells), "dim int, vector array<double>").toArrow().to_pandas()
    model = rows.sparkSession.sparkContext.broadcast({d: np.array(g["vector"].tolist(), float) for d, g in found.groupby("dim")})

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray, np.ndarray]]:
        for batch in batches:
            for dim, group in batch.to_pandas().groupby("dim"):
                # A length that the sample holds no vector of has one cell.
                centroids = model.value.get(dim, np.eye(1, dim))
                for low in range(0, len(group), 4096):
                    part = group.iloc[low : low + 4096]
                    yield dim, part, unit(np.array(part["v"].tolist(), float)), centroids

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, _, x, centroids in parts(batches):
            near, home = homes_of(x, centroids)
            found = pd.DataFrame({"cell": home, "near": near[np.arange(len(x)), home]}).groupby("cell", as_index=False).agg(n=("near", "size"), near=("near", "min"))
            yield pa.RecordBatch.from_pandas(found.assign(dim=dim), preserve_index=False, schema=pa.schema(counted))

    counted = [("dim", pa.int32()), ("cell", pa.int32()), ("n", pa.int64()), ("near", pa.float64())]
    homes = classes.select("v", "dim").mapInArrow(at_home, "dim int, cell int, n bigint, near double").groupBy("dim", "cell")
    homes = written(homes.agg(F.sum("n").alias("n"), F.min("near").alias("near")), "vector-homes")
    known, angle = homes.toArrow().to_pandas(), np.arccos(np.clip(threshold, -1, 1))  # a row per cell
    known["least"] = np.cos(np.minimum(np.arccos(np.clip(known["near"], -1, 1)) + angle, np.pi)) - SLACK
    # A cell where nothing is at home takes no guests.
    least = {d: dict(zip(g["cell"], g["least"])) for d, g in known.groupby("dim")}
    bound = rows.sparkSession.sparkContext.broadcast({d: np.array([g.get(c, np.inf) for c in range(max(g) + 1)]) for d, g in least.items()})

    def cells_in(dim: int, x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        have = bound.value[dim]
        return cells_of(x, centroids, margin, np.pad(have, (0, len(centroids) - len(have)), constant_values=np.inf))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, _, x, centroids in parts(batches):
            cell, n = np.unique(cells_in(dim, x, centroids)[1], return_counts=True)
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"dim": dim, "cell": cell, "n": n}), preserve_index=False, schema=pa.schema(counted[:3]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part, x, centroids in parts(batches):
            row, cell, home = cells_in(dim, x, centroids)
            for low in range(0, len(row), 4096):
                at = slice(low, low + 4096)
                out = part.iloc[row[at]].assign(cell=cell[at], home=home[at])
                yield pa.RecordBatch.from_pandas(out[["rep", "h", "n", "v", "dim", "cell", "home"]], preserve_index=False, schema=placed_schema)

    placed_schema = pa.schema([("rep", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("v", pa.list_(pa.float32() if kind == "float" else pa.float64())), ("dim", pa.int32()), ("cell", pa.int32()), ("home", pa.bool_())])
    placed = classes.select("rep", "h", "n", "v", "dim").mapInArrow(assign, f"rep bigint, h bigint, n bigint, v array<{kind}>, dim int, cell int, home boolean")
    # A row per cell: into how many blocks its vectors at home and all its vectors are dealt.
    members = classes.select("v", "dim").mapInArrow(tally, "dim int, cell int, n bigint").groupBy("dim", "cell").agg(F.ceil(F.sum("n") / MEMBERS).cast("int").alias("members"))
    sizes = written(homes.select("dim", "cell", F.ceil(F.col("n") / ROWS).cast("int").alias("homes")).join(members, ["dim", "cell"]), "vector-sizes")
    spot = lambda n: F.pmod(F.xxhash64("rep", "h", F.lit(1)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("at_home"))
    own = F.when(F.col("home"), F.transform(every("members"), lambda j: place(spot("homes"), j, True)))
    inside = F.transform(every("homes"), lambda i: place(i, spot("members"), False))
    dealt = placed.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("places", F.concat(F.coalesce(own, F.slice(inside, 1, 0)), inside))
    dealt = dealt.select("dim", "cell", "rep", "h", "n", "v", "home", F.inline("places"))
    links = dealt.groupBy("dim", "cell", "i", "j").applyInPandas(lambda f: compare(f, threshold), "rep bigint, h bigint, links bigint, other bigint")
    links = written(links, "vector-links")
    equal = member.filter("sound").join(classes.select("h", "v", "rep", "n"), ["h", "v"]).select("vec_id", "rep", "h", "n")
    per_class = links.groupBy("rep", "h").agg(F.sum("links").alias("links"))
    group = components(links.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    out = equal.join(per_class, ["rep", "h"], "left").join(group, equal["rep"] == group["id"], "left").select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = rows.filter("NOT sound").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (SELECT a AS id, a AS reached FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id),
n AS (SELECT a AS id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id,
  e.vec_id = coalesce(component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.id = e.vec_id"""
