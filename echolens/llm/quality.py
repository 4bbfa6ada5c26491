"""Quality classifier: a generalised additive model with pairwise interactions, learned by cyclic boosting.

A text is described by a few dozen figures (``FEATURES``): shares of kinds of characters, words and lines, repetition,
lengths. Each figure is cut into at most ``BINS`` bins at quantiles of the sample. The model is an intercept, one lookup
table per figure and one per chosen pair of figures; a score is the logistic function of the sum of the looked-up values,
so scoring is one addition per table.

**Main effects.** Rounds visit the figures in turn. A visit fits one shallow tree (``LEAVES`` leaves, best split first) to
the gradients and curvatures summed per bin, and adds a part (``RATE``) of its leaf values to the figure's table. As every
visit moves a little only, correlated figures share an effect, whatever their order.

**Pairs.** All pairs are ranked by what one cut along each figure (four cells) would gain on what the main effects
leave over; the best ``PAIRS`` get a table on coarser bins, learned by the same cyclic boosting with four-cell trees. At
last the tables are centred, their means going into the intercept.

The fit reads a bounded sample: at most ``FIT_ROWS`` labelled keys, those of smallest hash, as figures and not as texts,
in one task (boosting is sequential). Scoring reads every whole text.

Cases: null or empty text has figures of zero and is scored like any other; a null label is not learned from; of several labels of one
key the largest counts; of several texts of one key one is learned from; without labelled rows every
score is 0.5; labels of one kind only give one score for all; repeated documents are scored each; an empty table gives no
row. Columns of the input pass through, result columns replace any of the same name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .frames import table, written
from .ragged import NOT_SPACE, Block, Words, blocks
from .toxicity import held_out

FIT_ROWS = 20_000
BINS, COARSE, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 120, 40, 0.15, 3
DAMP, LEAST = 1.0, 5.0  # added to the curvature of a leaf; least curvature of a leaf
THRESHOLD = 0.3

KINDS = ("lower", "upper", "digit", "space", "newline", "full_stop", "comma", "exclaim", "symbol", "other_mark", "lead", "trail", "control")


def _kinds() -> np.ndarray:
    at = np.full(256, KINDS.index("control"), np.uint8)
    for chars, name in (
        (range(33, 127), "other_mark"), (range(97, 123), "lower"), (range(65, 91), "upper"), (range(48, 58), "digit"), ((32, 9, 11, 12, 13), "space"), ((10,), "newline"),
        (b".", "full_stop"), (b",;:", "comma"), (b"!?", "exclaim"), (b"#$%&*|<>{}[]\\^~=+_@/", "symbol"), (range(0xC0, 256), "lead"), (range(0x80, 0xC0), "trail"),
    ):
        at[list(chars)] = KINDS.index(name)
    return at


KIND_OF = _kinds()
FEATURES = (
    "log_length", *[f"{k}_share" for k in KINDS], "upper_of_letters", "log_words", "word_length", "long_words", "short_words", "distinct_words", "distinct_pairs",
    "top_word", "log_lines", "line_length", "distinct_lines", "marks_per_word", "symbols_per_word", "exclaims_per_word", "stops_per_word",
)


def _ratio(a, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def _per_text(owner: np.ndarray, size: int, values=None) -> np.ndarray:
    return np.bincount(owner, values, size).astype(float)


def _distinct(owner: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the number of distinct values and the count of the most frequent one."""
    top = np.zeros(size)
    if not len(owner):
        return np.zeros(size), top
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])]))
    np.maximum.at(top, o[new], np.diff(np.append(new, len(o))))
    return _per_text(o[new], size), top


def block_figures(block: Block) -> np.ndarray:
    """Texts x FEATURES of a block."""
    n = len(block)
    size = np.diff(block.starts)
    kind = KIND_OF[block.data]
    if n == 1:
        counts = np.bincount(kind, minlength=len(KINDS)).reshape(1, -1).astype(float)
    else:
        owner = np.repeat(np.arange(n) * len(KINDS), size)
        counts = np.bincount(owner + kind, minlength=n * len(KINDS)).reshape(n, -1).astype(float)
    of = {k: counts[:, i] for i, k in enumerate(KINDS)}
    w = Words(block, NOT_SPACE)
    words = np.diff(w.first).astype(float)
    length = w.end - w.start
    distinct, top = _distinct(w.text, w.hash, n)
    pair, at = w.windows(2)
    pairs, _ = _distinct(w.text[at], pair, n)
    # Lines: pieces between line feeds that hold anything.
    is_text = np.ones(256, bool)
    is_text[10] = False
    lines = Words(block, is_text)
    n_lines = np.diff(lines.first).astype(float)
    distinct_lines, _ = _distinct(lines.text, lines.hash, n)
    letters = of["lower"] + of["upper"] + of["lead"]
    marks = of["full_stop"] + of["comma"] + of["exclaim"] + of["symbol"] + of["other_mark"]
    columns = [
        np.log1p(size), *[_ratio(of[k], size) for k in KINDS], _ratio(of["upper"], letters), np.log1p(words), _ratio(_per_text(w.text, n, length), words),
        _ratio(_per_text(w.text, n, length > 12), words), _ratio(_per_text(w.text, n, length < 3), words), _ratio(distinct, words), _ratio(pairs, _per_text(w.text[at], n)),
        _ratio(top, words), np.log1p(n_lines), np.log1p(_ratio(size, n_lines)), _ratio(distinct_lines, n_lines), _ratio(marks, words), _ratio(of["symbol"], words),
        _ratio(of["exclaim"], words), _ratio(of["full_stop"], words),
    ]
    return np.stack(columns, axis=1)


def figures(column: pa.Array) -> Iterator[np.ndarray]:
    for block in blocks(column):
        yield block_figures(block)


# ---- the model

@dataclass
class Model:
    """Bin edges and tables per figure; coarse edges and tables per pair."""

    intercept: float = 0.0
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    coarse: list = field(default_factory=list)
    pairs: list = field(default_factory=list)  # (figure, figure, table)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, values in enumerate(self.tables):
            total += values[binned(x[:, f], self.edges[f])]
        cells = {f: binned(x[:, f], self.coarse[f]) for a, b, _ in self.pairs for f in (a, b)}
        for a, b, values in self.pairs:
            total += values[cells[a], cells[b]]
        return logistic(total)

    def to_json(self) -> str:
        lists = lambda arrays: [x.tolist() for x in arrays]
        return json.dumps({"intercept": self.intercept, "edges": lists(self.edges), "tables": lists(self.tables), "coarse": lists(self.coarse), "pairs": [(a, b, t.tolist()) for a, b, t in self.pairs]})

    @staticmethod
    def from_json(text: str) -> Model:
        d = json.loads(text)
        arrays = lambda lists: [np.array(x, float) for x in lists]
        return Model(d["intercept"], arrays(d["edges"]), arrays(d["tables"]), arrays(d["coarse"]), [(a, b, np.array(t)) for a, b, t in d["pairs"]])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Distinct inner edges of about equally filled bins."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher"))


def binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin of each value: the number of edges it reaches."""
    return np.searchsorted(edges, values, "right")


def leaf(g: float, h: float) -> float:
    return -g / (h + DAMP)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Values per bin of the tree that grows by the best split first; g and h are sums per bin in bin order."""
    before_g, before_h = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def best(lo: int, hi: int) -> tuple[float, int]:
        cut = np.arange(lo + 1, hi)
        if not len(cut):
            return 0.0, lo
        lg, lh = before_g[cut] - before_g[lo], before_h[cut] - before_h[lo]
        rg, rh = before_g[hi] - before_g[cut], before_h[hi] - before_h[cut]
        whole = (before_g[hi] - before_g[lo]) ** 2 / (before_h[hi] - before_h[lo] + DAMP)
        gain = np.where((lh >= LEAST) & (rh >= LEAST), lg**2 / (lh + DAMP) + rg**2 / (rh + DAMP) - whole, 0.0)
        k = int(np.argmax(gain))
        return float(gain[k]), int(cut[k])

    parts = [(0, len(g), *best(0, len(g)))]
    while len(parts) < leaves:
        k = max(range(len(parts)), key=lambda i: parts[i][2])
        lo, hi, gain, cut = parts[k]
        if gain <= 0:
            break
        parts[k : k + 1] = [(lo, cut, *best(lo, cut)), (cut, hi, *best(cut, hi))]
    out = np.zeros(len(g))
    for lo, hi, _, _ in parts:
        out[lo:hi] = leaf(before_g[hi] - before_g[lo], before_h[hi] - before_h[lo])
    return out


def four_cells(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best tree with one cut along each axis of the sums per cell: its gain and its values per cell."""
    cg, ch = (np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0))) for x in (g, h))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(1, len(g)), np.arange(1, g.shape[1]), indexing="ij"))
    if not len(a):
        return 0.0, np.zeros(g.shape)

    def corners(c):
        low, left, up, every = c[a, b], c[a, -1], c[-1, b], c[-1, -1]
        return np.stack([low, left - low, up - low, every - left - up + low])

    qg, qh = corners(cg), corners(ch)
    gain = (qg**2 / (qh + DAMP)).sum(0) - cg[-1, -1] ** 2 / (ch[-1, -1] + DAMP)
    k = int(np.argmax(gain))
    value = leaf(qg[:, k], np.maximum(qh[:, k], 0))
    out = np.empty(g.shape)
    out[: a[k], : b[k]], out[: a[k], b[k] :], out[a[k] :, : b[k]], out[a[k] :, b[k] :] = value
    return float(gain[k]), out


def boosted(x: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, n_pairs: int = PAIRS) -> Model:
    """Learn the model of a matrix of figures and 0/1 labels."""
    n, width = x.shape
    share = (labels.sum() + 0.5) / (n + 1)
    model = Model(float(np.log(share / (1 - share))))
    model.edges = [cuts(x[:, f], BINS) for f in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = [cuts(x[:, f], COARSE) for f in range(width)]
    bins = [binned(x[:, f], model.edges[f]) for f in range(width)]
    total = np.full(n, model.intercept)

    def slopes():
        p = logistic(total)
        return p - labels, p * (1 - p)

    for _ in range(rounds):
        for f in range(width):
            if len(model.tables[f]) < 2:
                continue
            g, h = slopes()
            step = RATE * shallow_tree(np.bincount(bins[f], g, len(model.tables[f])), np.bincount(bins[f], h, len(model.tables[f])))
            model.tables[f] += step
            total += step[bins[f]]
    wide = [f for f in range(width) if len(model.coarse[f])]
    cells = {f: binned(x[:, f], model.coarse[f]) for f in wide}
    sizes = {f: len(model.coarse[f]) + 1 for f in wide}

    def sums(a, b, values):
        return np.bincount(cells[a] * sizes[b] + cells[b], values, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    g, h = slopes()
    ranked = sorted(((four_cells(sums(a, b, g), sums(a, b, h))[0], -a, -b) for a, b in combinations(wide, 2)), reverse=True)
    model.pairs = [(-a, -b, np.zeros((sizes[-a], sizes[-b]))) for _, a, b in ranked[:n_pairs]]
    for _ in range(pair_rounds):
        for a, b, values in model.pairs:
            g, h = slopes()
            step = RATE * four_cells(sums(a, b, g), sums(a, b, h))[1]
            values += step
            total += step[cells[a], cells[b]]
    for f, values in enumerate(model.tables):
        centre = values[bins[f]].mean()
        values -= centre
        model.intercept += centre
    for a, b, values in model.pairs:
        centre = values[cells[a], cells[b]].mean()
        values -= centre
        model.intercept += centre
    model.intercept = float(model.intercept)
    return model


# ---- the jobs

def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [x.tobytes() for part in figures(batch.column(2)) for x in part]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["key", "label", "figures"])


def train(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("key")
    x = np.stack([np.frombuffer(r, float) for r in frame["figures"]])
    return pd.DataFrame({"model": [boosted(x, frame["label"].to_numpy(float)).to_json()]})


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = FIT_ROWS) -> Model | None:
    """Learn from at most ``max_rows`` labelled keys of ``docs``; None if there are none."""
    known = labels.select(F.col(key).cast("bigint").alias("key"), F.col(label).cast("int").alias("label")).filter("key IS NOT NULL AND label IN (0, 1)")
    chosen = known.groupBy("key").agg(F.max("label").alias("label")).orderBy(F.xxhash64("key"), "key").limit(max_rows)
    chosen = written(chosen, "quality-sample")  # max_rows short rows
    texts = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "key").select("key", "label", "text").mapInArrow(_packed, "key bigint, label int, figures binary")
    rows = rows.groupBy("key", "label").agg(F.min("figures").alias("figures"))
    found = rows.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(lambda frame: train(frame), "model string").collect()  # one row
    return Model.from_json(found[0]["model"]) if found else None


def score(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` plus ``score`` and ``predicted`` (1 if the score reaches the threshold)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    at = docs.columns.index(text)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if held.value is None:
                p = np.full(batch.num_rows, 0.5)
            else:
                p = np.concatenate([np.zeros(0), *[held.value.scores(x) for x in figures(batch.column(at))]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "score"])

    out = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, folder, "labels").filter(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
