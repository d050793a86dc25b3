"""Boosted trees over sparse features that are 0 or more: columns are spread over tasks, each of which knows all rows' gradients.

The trees are those of second-order boosting on the logistic loss: gain and leaves with the squared leaves as penalty, a sum of
second derivatives of one at least on either side, rows and columns drawn anew for every tree. Splits are exact: every value of
a column is tried. All trees are grown in one stage whose tasks tell each other, for every level, their best split of each node
and the rows beyond it; no task holds more than its columns and a few numbers a row.
"""

from __future__ import annotations

import base64
import json
import secrets
import socket
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.session import cut_lineage

#: seconds that a task waits for the others
WAIT = 600
PENALTY, LEAST_WEIGHT, LEAST_GAIN = 1.0, 1.0, 1e-6


def best_splits(g: np.ndarray, h: np.ndarray, node: np.ndarray, nodes: list[int], columns: dict, allowed: np.ndarray, known: dict | None = None) -> list[tuple[float, int, int] | None]:
    """For each node the gain, column and place of the best split: the entries of the column up to the place go right.

    ``known`` keeps what a tree's levels share: a node's sums are those of the node above it without those of its sibling.
    """
    known, both, out = {} if known is None else known, g + 1j * h, []

    def sums(k: int, at: np.ndarray, base: np.ndarray) -> np.ndarray:
        c = np.zeros(len(known["row"]) + 1, complex)
        np.cumsum(np.where(node == k, both, 0)[known["row"]], out=c[1:])
        right = c[at + 1]
        right -= c[base]
        return right

    if "places" not in known:
        of = columns["column"]
        entries = np.flatnonzero(allowed[of])
        known["row"], sizes = columns["row"][entries], np.diff(columns["start"], append=len(of)) * allowed
        at = np.flatnonzero(columns["ends"][entries])
        base = (np.cumsum(sizes) - sizes)[of[entries[at]]]
        # a split that leaves too little at the root does so everywhere
        if nodes == [1]:
            right = sums(1, at, base)
            some = (right.imag >= LEAST_WEIGHT) & (h.sum() - right.imag >= LEAST_WEIGHT - 1e-6)
            at, base, known[1] = at[some], base[some], right[some]
        known["places"] = at, base, entries[at]
    at, base, entry = known["places"]
    for k in sorted(nodes, reverse=True):
        if k not in known:
            known[k] = known[k // 2] - known[k + 1] if k % 2 == 0 and k + 1 in known and k // 2 in known else sums(k, at, base)
    for k in nodes:
        total = both[node == k].sum()
        rg, rh = known[k].real.copy(), known[k].imag.copy()
        lg, lh = total.real - rg, total.imag - rh
        few = np.minimum(rh, lh) < LEAST_WEIGHT
        for x, weight in ((rg, rh), (lg, lh)):
            x *= x
            weight += PENALTY
            x /= weight
        rg += lg
        rg -= total.real**2 / (total.imag + PENALTY)
        rg[few] = 0
        best = int(rg.argmax()) if len(rg) else -1
        out.append((round(float(rg[best]), 9), int(columns["column"][entry[best]]), int(entry[best])) if best >= 0 and rg[best] > LEAST_GAIN else None)
    return out


def sorted_columns(row: np.ndarray, column: np.ndarray, value: np.ndarray, width: int) -> dict:
    """Entries by column, the largest value first; where columns start; whether an entry is the last of its value."""
    by = np.lexsort((row, -value, column))
    row, column, value = row[by].astype(np.int32), column[by].astype(np.int32), value[by]
    ends = np.ones(len(row), bool)
    ends[:-1] = (column[1:] != column[:-1]) | (value[1:] != value[:-1])
    return {"row": row, "column": column, "value": value, "start": np.searchsorted(column, np.arange(width)), "ends": ends}


def grown(label: np.ndarray, weight: np.ndarray, columns: dict, width: int, trees: int, depth: int, rate: float, rows_share: float, columns_share: float, seed: int, gather) -> list[dict]:
    """All trees: of each its splits, by number of node (column, threshold), and its leaves. ``gather`` gives all tasks' texts to all of them, one's own at ``gather.own``."""
    margin, n, out = np.zeros(len(label)), len(label), []
    value, column = columns["value"], columns["column"]
    for tree in range(trees):
        r = np.random.default_rng([seed, tree])
        allowed = np.zeros(width, bool)
        allowed[r.permutation(width)[: max(1, round(columns_share * width))]] = True
        drawn = weight * (r.random(n) < rows_share)
        p = 0.5 * (1 + np.tanh(margin / 2))
        g, h = drawn * (p - label), drawn * p * (1 - p)
        node, splits, nodes, known = np.ones(n, np.int32), {}, [1], {}
        for _ in range(depth):
            mine = best_splits(g, h, node, nodes, columns, allowed, known)
            all_of = [json.loads(x) for x in gather(json.dumps([s and s[:2] for s in mine]))]
            beyond, split = {}, []
            for j, k in enumerate(nodes):
                best = max(((-a[j][0], a[j][1], t) for t, a in enumerate(all_of) if a[j]), key=lambda x: (-x[0], -x[1]), default=None)
                if best is None:
                    continue
                split.append(k)
                if best[2] == gather.own:
                    c, at = mine[j][1:]
                    here = np.zeros(n, bool)
                    here[columns["row"][columns["start"][c] : at + 1]] = True
                    after = value[at + 1] if at + 1 < len(value) and column[at + 1] == c else 0.0
                    beyond[k] = (c, float(value[at] + after) / 2, base64.b64encode(zlib.compress(np.packbits(here & (node == k)), 1)).decode())
            if not split:
                break
            for told in gather(json.dumps(beyond)):
                for k, (c, threshold, bits) in json.loads(told).items():
                    right = np.unpackbits(np.frombuffer(zlib.decompress(base64.b64decode(bits)), np.uint8), count=n).view(bool)
                    splits[int(k)] = (c, threshold)
                    node = np.where(node == int(k), 2 * node + right, node)
            nodes = [c for k in split for c in (2 * k, 2 * k + 1)]
        most = 2 << depth
        leaves = -rate * np.bincount(node, g, most) / (np.bincount(node, h, most) + PENALTY)
        margin += leaves[node]
        out.append({"splits": splits, "leaves": leaves.tolist()})
    return out


def margins(trees: list[dict], indices: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
    """The sum of the trees' leaves for each row of sparse features."""
    used = np.array(sorted({c for t in trees for c, _ in t["splits"].values()}), dtype=np.int64)
    sizes = [len(i) for i in indices]
    x = np.zeros((len(indices), len(used) + 1))  # the last column takes what no tree asks for
    if len(used) and sum(sizes):
        place = np.concatenate(indices).astype(np.int64)
        at = np.minimum(np.searchsorted(used, place), len(used) - 1)
        x[np.repeat(np.arange(len(indices)), sizes), np.where(used[at] == place, at, len(used))] = np.concatenate(values)
    out, slot = np.zeros(len(indices)), {int(c): k for k, c in enumerate(used)}
    for t in trees:
        node = np.ones(len(indices), np.int64)
        for k, (c, threshold) in sorted(t["splits"].items()):
            node = np.where(node == k, 2 * node + (x[:, slot[c]] > threshold), node)
        out += np.array(t["leaves"])[node]
    return out


class Gathered:
    """Gives the texts of all tasks of a stage to each of them, by way of the first one. The context's own way waits a second at every turn."""

    def __init__(self, context):
        self.own, infos = context.partitionId(), context.getTaskInfos()
        self.peers: list[socket.socket] = [None] * len(infos)
        hub = socket.create_server((infos[0].address.rsplit(":", 1)[0] if self.own == 0 else "127.0.0.1", 0))
        token = secrets.token_hex(16)  # a stranger who connects is not heard
        port, token = json.loads(context.allGather(json.dumps([hub.getsockname()[1], token]))[0])
        if self.own:
            self.hub = socket.create_connection((infos[0].address.rsplit(":", 1)[0], port), WAIT)
            self._tell(self.hub, json.dumps([token, self.own]))
        else:
            hub.settimeout(WAIT)
            while None in self.peers[1:]:
                s, _ = hub.accept()
                s.settimeout(WAIT)
                said, own = json.loads(self._hear(s))
                if said == token:
                    self.peers[own] = s
        hub.close()
        for s in self.peers[1:] if self.own == 0 else [self.hub]:
            s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def __call__(self, text: str) -> list[str]:
        if self.own:
            self._tell(self.hub, text)
            return json.loads(self._hear(self.hub))
        out = [text, *map(self._hear, self.peers[1:])]
        for s in self.peers[1:]:
            self._tell(s, json.dumps(out))
        return out

    def close(self) -> None:
        for s in self.peers[1:] if self.own == 0 else [self.hub]:
            s.close()

    @staticmethod
    def _tell(s: socket.socket, text: str) -> None:
        data = text.encode()
        s.sendall(len(data).to_bytes(8, "big") + data)

    @staticmethod
    def _hear(s: socket.socket) -> str:
        def exactly(n: int) -> bytes:
            out = bytearray()
            while len(out) < n:
                if not (part := s.recv(min(n - len(out), 1 << 20))):
                    raise ConnectionError("a task of the stage has ended")
                out += part
            return bytes(out)

        return exactly(int.from_bytes(exactly(8), "big")).decode()


class Boosted:
    """A classifier by boosted trees of frames with label, weight and features; ``fit`` and ``transform`` as the library's."""

    def __init__(self, trees: int, depth: int, rate: float, rows_share: float, columns_share: float, seed: int):
        self.trees, self.depth, self.rate, self.rows_share, self.columns_share, self.seed = trees, depth, rate, rows_share, columns_share, seed

    def getMaxIter(self) -> int:
        return self.trees

    def getMaxDepth(self) -> int:
        return self.depth

    def fit(self, train: DataFrame) -> BoostedTrees:
        sc = train.sparkSession.sparkContext
        scala = sc._jsc.sc()
        tasks = max(1, min(sc.defaultParallelism, scala.maxNumConcurrentTasks(scala.resourceProfileManager().defaultResourceProfile())))  # all run at once
        v = F.unwrap_udt("features")
        rows = cut_lineage(train.select(F.monotonically_increasing_id().alias("id"), "label", "weight", v["size"].alias("width"), v["indices"].alias("places"), v["values"].alias("values")))
        width = rows.agg(F.max("width")).first()[0]
        entries = rows.select("id", F.explode(F.arrays_zip("places", "values")).alias("e")).select("id", F.col("e.places").alias("column"), F.col("e.values").alias("value"), F.lit(0.0).alias("weight")).where("value > 0")
        heads = rows.select("id", F.explode(F.sequence(F.lit(-tasks), F.lit(-1))).alias("column"), F.col("label").alias("value"), "weight")
        own = entries.unionByName(heads).repartitionById(tasks, F.pmod("column", F.lit(tasks)).cast("int"))
        set_up = (width, self.trees, self.depth, self.rate, self.rows_share, self.columns_share, self.seed)

        def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import BarrierTaskContext

            gather = Gathered(BarrierTaskContext.get())
            parts = [[b[c].to_numpy() for c in b.columns] for b in batches]
            key, column, value, weight = (np.concatenate(x) for x in zip(*parts))
            head = column < 0
            by = np.argsort(key[head])
            ids, label, row_weight = (x[head][by] for x in (key, value, weight))
            columns = sorted_columns(np.searchsorted(ids, key[~head]), column[~head], value[~head], width)
            trees = grown(label, row_weight, columns, *set_up, gather)
            gather.close()
            if gather.own == 0:
                yield pd.DataFrame({"trees": [json.dumps(trees)]})

        told = json.loads(own.mapInPandas(grow, "trees string", barrier=True).collect()[0].trees)
        return BoostedTrees([{"splits": {int(k): tuple(s) for k, s in t["splits"].items()}, "leaves": t["leaves"]} for t in told])


class BoostedTrees:
    def __init__(self, trees: list[dict]):
        self.trees = trees

    def transform(self, rows: DataFrame) -> DataFrame:
        trees = self.trees

        @F.pandas_udf("double")
        def predict(places: pd.Series, values: pd.Series) -> pd.Series:
            made = [margins(trees, places[lo : lo + 1000].tolist(), values[lo : lo + 1000].tolist()) for lo in range(0, len(places), 1000)]
            return pd.Series((np.concatenate(made) if made else np.zeros(0)) > 0).astype(float)

        v = F.unwrap_udt("features")
        return rows.withColumn("prediction", predict(v["indices"], v["values"]))
