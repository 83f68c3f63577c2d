"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A text is cut into windows of bytes. In each window one network reads forwards and one backwards; at every byte
both states together give language probabilities, and a document's probability is their mean over all its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gateflow.llm.common import arrow_map, release, ship, text_bytes

UNKNOWN = "und"
WINDOW = 96          # bytes read from a fresh state
HIDDEN = 8           # units of each direction
SAMPLE = 240         # training documents per language: the bound of the sample
SAMPLE_WINDOWS = 4   # windows taken from each of them, evenly spaced over the whole text
STEPS, BATCH, RATE = 240, 128, 0.02
COLUMNS = 2048       # windows read side by side


def _sigmoid(x):
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class ByteGru:
    """h' = z h + (1 - z) tanh(w[x] + r (u h)); update gate z and reset gate r look at the byte x and the state h."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        n = len(languages)
        self.weights = {}
        for way in "fb":
            self.weights[f"w{way}"] = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
            self.weights[f"u{way}"] = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32)
        self.weights["v"] = rng.normal(0, 0.3, (n, 2 * hidden)).astype(np.float32)
        self.weights["c"] = np.zeros((n, 1), np.float32)
        self._hold()

    def _hold(self):
        for way in "fb":  # byte 0 fills windows: it leaves the state as it is
            self.weights[f"w{way}"][: self.hidden, 0] = 30.0

    def _read(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """States (window, hidden, columns) after each byte of x (window, columns)."""
        h_, w, u = self.hidden, self.weights[f"w{way}"], self.weights[f"u{way}"]
        steps, columns = x.shape
        states = np.empty((steps, h_, columns), np.float32)
        h = np.zeros((h_, columns), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            a = np.take(w, x[t], axis=1)
            b = u @ h
            gates = _sigmoid(a[: 2 * h_] + b[: 2 * h_])
            z, r = gates[:h_], gates[h_:]
            n = np.tanh(a[2 * h_:] + r * b[2 * h_:])
            if keep is not None:
                keep.append((t, h, z, r, n, b[2 * h_:]))
            h = n + z * (h - n)
            states[t] = h
        return states

    def _labels(self, states: np.ndarray) -> np.ndarray:
        logits = np.matmul(self.weights["v"], states) + self.weights["c"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Language probabilities (window, languages, columns) of every byte."""
        return self._labels(np.concatenate([self._read(x, "f"), self._read(x, "b")], axis=1))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the bytes of x (window, columns) with languages y, and its gradients."""
        h_ = self.hidden
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._read(x, "f", kept["f"]), self._read(x, "b", kept["b"])], axis=1)
        p = self._labels(states)
        real = (x != 0).astype(np.float32)[:, None, :]
        total = max(1.0, float(real.sum()))
        columns = np.arange(x.shape[1])
        loss = -float((np.log(p[:, y, columns] + 1e-9) * real[:, 0]).sum()) / total
        d = p.copy()
        d[:, y, columns] -= 1
        d *= real / total
        grads = {"v": np.einsum("tlb,thb->lh", d, states), "c": d.sum(axis=(0, 2))[:, None]}
        above = np.matmul(self.weights["v"].T, d)
        for k, way in enumerate("fb"):
            u = self.weights[f"u{way}"]
            gw, gu = np.zeros((256, 3 * h_), np.float32), np.zeros_like(u)
            dh = np.zeros((h_, x.shape[1]), np.float32)
            for t, before, z, r, n, un in reversed(kept[way]):  # back through time
                dh = dh + above[t, k * h_: (k + 1) * h_]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (before - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                da = np.concatenate([dz, dr, dn])
                db = np.concatenate([dz, dr, dn * r])
                gu += db @ before.T
                np.add.at(gw, x[t], da.T)
                dh = dh * z + u.T @ db
            grads[f"w{way}"], grads[f"u{way}"] = gw.T, gu
        return loss, grads

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = 4) -> ByteGru:
        """Adam on windows x (n, window) with language numbers y; every language weighs the same."""
        rng = np.random.default_rng(seed)
        rows = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        rows = [r for r in rows if len(r)]
        first = {k: np.zeros_like(w) for k, w in self.weights.items()}
        second = {k: np.zeros_like(w) for k, w in self.weights.items()}
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(r, -(-batch // len(rows))) for r in rows])
            _, grads = self.gradients(np.ascontiguousarray(x[pick].T), y[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.weights[k] -= (rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
            self._hold()
        return self

    def documents(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Mean probabilities (rows, languages) of the texts between ``bounds``; rows without bytes are zero."""
        sizes = np.diff(bounds)
        counts = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(sizes)), counts)
        start = bounds[:-1][owner] + WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
        length = np.minimum(WINDOW, bounds[1:][owner] - start)
        order = np.argsort(-length, kind="stable")  # windows of about equal length run together
        out = np.zeros((len(sizes), len(self.languages)))
        padded = np.r_[data, np.zeros(WINDOW, np.uint8)]
        for at in range(0, len(order), COLUMNS):
            some = order[at: at + COLUMNS]
            steps = np.arange(int(length[some[0]]))[:, None]
            inside = steps < length[some]
            x = np.where(inside, padded[start[some] + steps], 0)
            p = self.positions(x)
            pooled = (p * inside[:, None, :]).sum(axis=0).T
            np.add.at(out, owner[some], pooled)
        return out / np.maximum(sizes, 1)[:, None]


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample: int = SAMPLE, steps: int = STEPS) -> ByteGru:
    """Network fitted on at most ``sample`` documents of each language that are not held out.

    The sample takes the smallest hashes of the ids. Without labelled rows the network knows no language.
    """
    known = (docs.filter(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
             .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("turn"),
                     F.xxhash64(F.col(text_col)).alias("content")))
    # narrow rows decide; the few texts follow. Equal rows are one
    place = F.row_number().over(Window.partitionBy("lang").orderBy("turn", "content"))
    chosen = known.select("lang", "turn", "content").distinct().withColumn("place", place).filter(F.col("place") <= sample).drop("place")
    top = (known.join(F.broadcast(chosen), ["lang", "turn", "content"])  # at most ``sample`` rows of a language
           .groupBy("lang", "turn", "content").agg(F.first("text").alias("text")))

    def windows(batch):
        data, bounds = text_bytes(batch.column(1))
        out = {"lang": [], "bytes": []}
        for lang, a, b in zip(batch.column(0).to_pylist(), bounds[:-1], bounds[1:], strict=True):
            for s in np.unique(np.linspace(a, max(a, b - WINDOW), SAMPLE_WINDOWS).astype(int)):
                out["lang"].append(lang)
                out["bytes"].append(data[s: min(b, s + WINDOW)].tobytes())
        return out

    found = sorted((r.lang, bytes(r.bytes)) for r in arrow_map(top.select("lang", "text"), windows, "lang string, bytes binary").collect())
    languages = sorted({lang for lang, _ in found})
    net = ByteGru(languages)
    if found:
        x = np.zeros((len(found), WINDOW), np.uint8)
        for i, (_, b) in enumerate(found):
            x[i, : len(b)] = np.frombuffer(b, np.uint8)
        net.fit(x, np.array([languages.index(lang) for lang, _ in found]), steps)
    return net


def language(net: ByteGru, text: Column) -> Column:
    """struct(lang_pred, score) of a text column; ``und`` with score 0 for texts that are null or have no letter."""
    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for at in range(0, len(texts), 512):
            data, bounds = text_bytes(texts.slice(at, 512))
            if net.languages:
                p = net.documents(data, bounds)
                best = p.argmax(axis=1)
                names += [net.languages[k] for k in best]
                scores += np.clip(p[np.arange(len(p)), best], 0, 1).tolist()
            else:
                names += [UNKNOWN] * (len(bounds) - 1)
                scores += [0.0] * (len(bounds) - 1)
        out = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
        release()
        return out

    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return F.when(letters, predict(text)).otherwise(none)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row, by a network trained on the rows that are not held out.

    Null texts, empty ones and those without a letter are ``und`` with score 0. Equal texts have equal predictions, rows
    with equal ids are scored apart, a null id is not held out and never learned from. Without labelled rows every text
    is ``und``. Other columns are left alone; an empty table gives an empty result.
    """
    net = train(docs, id_col, text_col, lang_col)
    ship(docs.sparkSession)
    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), language(net, F.col(text_col)).alias("p")).select(
        id_col, "held_out", "p.lang_pred", "p.score")
