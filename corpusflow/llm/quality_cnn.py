"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, each with a mark that tells whether it continues a
stretch repeated from at most ``LAGS`` bytes before (a single byte pattern can't
see that).  The whole text is covered by overlapping chunks; learned filters
slide over every chunk and each keeps its strongest answer there.  The largest
and the mean answer over the chunks combine into one probability, so a long
text is judged by all of it.

Filters act on one symbol per place, so a filter is a table of weights by place
and symbol, and running it is a sum of table rows.  The network is trained in
one Spark task on a bounded sample: at most ``PER_CLASS`` labelled rows of each
class (those with the smallest hash), weighted back to the classes' true shares.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.arrow import arrow_udf, on_workers, parts
from corpusflow.llm.common import cut, held_out

#: Chunk length, step between chunks, filter width and stride, all in bytes; number of filters.
CHUNK, STEP, WIDTH, STRIDE, FILTERS = 256, 192, 8, 2, 16
#: Symbols: byte, byte in a repeated stretch, and the filling of a short chunk.
SYMBOLS, FILL = 513, 512
LAGS, RUN = 32, 8
PER_CLASS, EPOCHS, BATCH, RATE, SEED = 800, 8, 16, 0.02, 20


def symbols(b: np.ndarray) -> np.ndarray:
    """Byte values, plus 256 where the last ``RUN`` bytes repeat those of one of the ``LAGS`` shifts before."""
    again = np.zeros(len(b), dtype=bool)
    for lag in range(1, min(LAGS, len(b) - RUN) + 1):
        same, have = b[lag:] == b[:-lag], 1
        while have < RUN:
            same, have = same[have:] & same[:-have], 2 * have
        again[lag + RUN - 1:] |= same
    return b.astype(np.uint16) + (again.astype(np.uint16) << np.uint16(8))


def chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of all texts as rows of symbols, and the row at which each text's chunks begin."""
    gap = np.zeros(LAGS + RUN, dtype=np.uint8)  # apart far enough that no text repeats its neighbour
    raw = [np.frombuffer(t.encode("utf-8"), dtype=np.uint8) for t in texts]
    flat = symbols(np.concatenate([x for b in raw for x in (gap, b)] + [gap]))
    size = np.array([len(b) for b in raw])
    begin = np.cumsum(size + len(gap)) - size
    count = np.maximum(1, -(-(size - CHUNK) // STEP) + 1)
    owner = np.repeat(np.arange(len(texts)), count)
    first = np.cumsum(count) - count
    at = np.minimum((np.arange(len(owner)) - first[owner]) * STEP, np.maximum(size[owner] - CHUNK, 0))
    place = at[:, None] + np.arange(CHUNK)[None, :]
    rows = flat[np.minimum(begin[owner][:, None] + place, len(flat) - 1)]
    rows[place >= size[owner][:, None]] = FILL
    return rows, first


@dataclass
class Network:
    tables: np.ndarray  # (WIDTH, SYMBOLS, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS,): of the largest, of the mean answers
    base: float

    def answers(self, rows: np.ndarray) -> np.ndarray:
        span = CHUNK - WIDTH + 1
        total = np.take(self.tables[0], rows[:, 0:span:STRIDE], axis=0)
        for j in range(1, WIDTH):
            total += np.take(self.tables[j], rows[:, j:j + span:STRIDE], axis=0)
        return total  # (chunks, places, FILTERS)

    def score(self, texts: list[str]) -> np.ndarray:
        rows, first = chunks(texts)
        pooled = np.empty((len(rows), FILTERS), dtype=np.float32)
        for i in range(0, len(rows), 512):
            pooled[i:i + 512] = np.maximum(self.answers(rows[i:i + 512]).max(axis=1) + self.bias, 0)
        count = np.diff(np.append(first, len(rows)))[:, None]
        both = np.hstack([np.maximum.reduceat(pooled, first), np.add.reduceat(pooled.astype(np.float64), first) / count])
        return 1 / (1 + np.exp(-np.clip(both @ self.out + self.base, -50, 50)))

    def pack(self) -> bytes:
        return np.concatenate([x.ravel() for x in (self.tables, self.bias, self.out, np.array([self.base]))]).astype("<f4").tobytes()

    @staticmethod
    def unpack(data: bytes) -> Network:
        x = np.frombuffer(data, dtype="<f4")
        n = WIDTH * SYMBOLS * FILTERS
        return Network(x[:n].reshape(WIDTH, SYMBOLS, FILTERS), x[n:n + FILTERS], x[n + FILTERS:n + 3 * FILTERS].astype(np.float64), float(x[-1]))


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray) -> Network:
    """Weighted logistic loss by Adam; gradients reach only the places where a filter answered most."""
    rng = np.random.default_rng(SEED)
    net = Network(rng.normal(0, 0.1, (WIDTH, SYMBOLS, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
                  rng.normal(0, 0.3, 2 * FILTERS), 0.0)
    net.tables[:, FILL] = 0
    data = [chunks([t])[0] for t in texts]
    state = {k: [0.0, 0.0] for k in ("tables", "bias", "out", "base")}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), BATCH):
            some = order[s:s + BATCH]
            rows = np.concatenate([data[i] for i in some])
            count = np.array([len(data[i]) for i in some])
            owner = np.repeat(np.arange(len(some)), count)
            first = np.cumsum(count) - count
            total = net.answers(rows)
            best = total.argmax(axis=1)
            pooled = np.maximum(np.take_along_axis(total, best[:, None, :], axis=1)[:, 0] + net.bias, 0)
            high = np.maximum.reduceat(pooled, first)
            both = np.hstack([high, np.add.reduceat(pooled, first) / count[:, None]])
            p = 1 / (1 + np.exp(-np.clip(both @ net.out + net.base, -30, 30)))
            d = (p - labels[some]) * weights[some] / len(some)
            top = (pooled == high[owner]) & (pooled > 0)
            ties = np.maximum(np.add.reduceat(top, first, dtype=np.int64), 1)
            back = d[owner][:, None] * (net.out[:FILTERS] * top / ties[owner] + net.out[FILTERS:] / count[owner][:, None]) * (pooled > 0)
            grad = {"out": both.T @ d + 1e-4 * net.out, "base": d.sum(), "bias": back.sum(axis=0)}
            g = np.zeros(net.tables.shape)
            f = np.broadcast_to(np.arange(FILTERS), back.shape)
            here = np.arange(len(rows))[:, None]
            for j in range(WIDTH):
                seen = rows[here, best * STRIDE + j].astype(np.int64)
                g[j] = np.bincount((seen * FILTERS + f).ravel(), weights=back.ravel(), minlength=SYMBOLS * FILTERS).reshape(SYMBOLS, FILTERS)
            g[:, FILL] = 0
            grad["tables"] = g
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for k, v in grad.items():
                m = state[k]
                m[0], m[1] = 0.9 * m[0] + 0.1 * v, 0.999 * m[1] + 0.001 * v * v
                new = getattr(net, k) - rate * m[0] / (np.sqrt(m[1]) + 1e-8)
                setattr(net, k, new.astype(np.float32) if k in ("tables", "bias") else new)
    return Network.unpack(net.pack())


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        per_class: int = PER_CLASS) -> Network:
    """Learn from labelled rows outside the evaluation fold; null labels, ids and texts teach nothing.

    Labels other than 0 count as 1; an id labelled twice counts with its larger
    label.  With no labelled text the network answers one half for everything.
    """
    on_workers()
    known = labels.where(~held_out(doc_id) & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(
        F.col(doc_id).alias("_id")).agg(F.max((F.col(label) != 0).cast("int")).alias("_y"))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    known = known.join(texts.select("_id").distinct(), "_id", "left_semi")
    share = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    order = F.xxhash64(F.lit(23), "_id")
    picks = [known.where(F.col("_y") == y).orderBy(order, "_id").limit(per_class) for y in (0, 1)]
    chosen = cut(picks[0].unionByName(picks[1]))
    sample = texts.join(F.broadcast(chosen), "_id").dropDuplicates(["_id"])  # 2 * per_class rows

    def learn(t: pa.Table) -> pa.Table:
        t = t.sort_by("_id")
        y = t["_y"].to_numpy().astype(np.float64)
        weights = np.ones(len(y))
        for c in (0, 1):
            weights[y == c] = share.get(c, 0) / max(1, (y == c).sum())
        return pa.table({"net": [train(t["_text"].to_pylist(), y, weights / weights.mean()).pack()]})

    found = sample.groupBy(F.lit("all").alias("_all")).applyInArrow(learn, "net binary").collect()
    if not found:
        return Network(np.zeros((WIDTH, SYMBOLS, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS), 0.0)
    return Network.unpack(found[0]["net"])


def quality_score(text: Column, net: Network) -> Column:
    """Probability of label 1 for a whole text; null counts as empty, which has a score of its own."""

    @arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(net.score(some) for some in parts(texts, 1 << 18))]), pa.float64())

    return of(text)
