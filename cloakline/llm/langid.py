"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text in both directions and gives every
position a distribution over the languages; a document's probabilities are the
mean over all its positions. The state is carried over words, lines and
everything else. So that many places of a long text can be read at a time, a
text is cut into windows of WINDOW bytes, and the state that a window begins with
is that after the LEAD bytes before it (in the other direction: behind it), or
the zero state at the ends of the text. A text of one window is read as a whole;
each position of a text counts once.

It is trained in numpy by backpropagation through time on spans from places all
over the texts of a bounded sample of labelled documents.

Defined results. Null text or text without a letter: `und`, score 0. No labelled
rows to learn from: `und` for all. Null doc_id: predicted, held_out false, never
learnt from. Empty table: no rows. Languages beyond the `most` most frequent of
the labelled rows are not learnt. Only doc_id, text and lang are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakline.llm.common import arrow_bytes, pieces, unit

WINDOW, LEAD, BATCH = 512, 32, 2048
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights of both directions: x (bytes to gates), u (state to gates), b; and the output layer o, c."""

    def __init__(self, hidden: int, languages: list[str], seed: int):
        rng = np.random.default_rng(seed)
        self.hidden, self.languages = hidden, languages
        g = 3 * hidden
        self.w = {}
        for d in "fb":
            self.w |= {f"x{d}": rng.normal(0, 0.1, (256, g)), f"u{d}": rng.normal(0, hidden**-0.5, (hidden, g)), f"b{d}": np.zeros(g)}
        self.w |= {"o": rng.normal(0, 0.1, (2 * hidden, len(languages))), "c": np.zeros(len(languages))}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def scan(self, d: str, codes: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """States after each byte; codes: (span, step), longest spans first, so that a step's spans are a prefix."""
        h, n = self.hidden, len(codes)
        x, u, b = self.w["x" + d], self.w["u" + d], self.w["b" + d]
        state, states, saved = np.zeros((n, h), np.float32), np.zeros((codes.shape[1] + 1, n, h), np.float32), []
        for t in range(codes.shape[1]):
            m = int(np.searchsorted(-lengths, -t, "left"))  # spans longer than t
            a, s = x[codes[:m, t]] + b, state[:m]
            v = s @ u
            zr = _sigmoid(a[:, : 2 * h] + v[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(a[:, 2 * h :] + r * v[:, 2 * h :])
            new = c + z * (s - c)
            if keep:
                saved.append((m, s.copy(), z, r, c, v[:, 2 * h :]))
            state[:m] = new
            states[t + 1, :m] = new
        return states[1:], saved

    def backward(self, d: str, codes, saved, grad, out):
        """Backpropagation through time: grad is by states, (step, span, hidden); sums into out."""
        h, u = self.hidden, self.w["u" + d]
        carry = np.zeros((len(codes), h), np.float32)
        for t in range(len(saved) - 1, -1, -1):
            m, s, z, r, c, vc = saved[t]
            dh = carry[:m] + grad[t, :m]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (s - c) * z * (1 - z)
            dr = dc * vc * r * (1 - r)
            da = np.concatenate([dz, dr, dc], 1)
            dv = np.concatenate([dz, dr, dc * r], 1)
            np.add.at(out["x" + d], codes[:m, t], da)
            out["b" + d] += da.sum(0)
            out["u" + d] += s.T @ dv
            carry[:m] = dv @ u.T + dh * z
        return out

    @staticmethod
    def turned(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each span's bytes from its last to its first; also takes states back to the order of the bytes."""
        steps = np.arange(codes.shape[1])
        at = lengths[:, None] - 1 - steps[None, :]
        return np.where(at >= 0, at, steps[None, :])

    def forward(self, codes, lengths, keep=False):
        back = self.turned(codes, lengths)
        hf, sf = self.scan("f", codes, lengths, keep)
        turned = np.take_along_axis(codes, back, 1)
        hb, sb = self.scan("b", turned, lengths, keep)
        hb = np.take_along_axis(hb, back.T[:, :, None], 0)
        both = np.concatenate([hf, hb], 2)
        logits = both @ self.w["o"] + self.w["c"]
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        return p, (both, back, turned, sf, sb)

    def train(self, codes, lengths, labels, steps: int, batch: int, rate: float, seed: int):
        rng = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(codes), batch)
            pick = pick[np.argsort(-lengths[pick], kind="stable")]
            n, y = lengths[pick], labels[pick]
            c = codes[pick][:, : int(n[0])]
            p, (both, back, turned, sf, sb) = self.forward(c, n, keep=True)
            inside = (np.arange(c.shape[1])[:, None] < n[None, :])[:, :, None]
            err = p.copy()
            err[:, np.arange(batch), y] -= 1
            err *= inside / n.sum()
            grads = {k: np.zeros_like(v) for k, v in self.w.items()}
            flat = err.reshape(-1, err.shape[2])
            grads["o"] = both.reshape(-1, both.shape[2]).T @ flat
            grads["c"] = flat.sum(0)
            dh = err @ self.w["o"].T
            self.backward("f", c, sf, dh[:, :, : self.hidden], grads)
            self.backward("b", turned, sb, np.take_along_axis(dh[:, :, self.hidden :], back.T[:, :, None], 0), grads)
            lr = rate * min(1, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                self.w[k] -= (lr * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def ready(self) -> None:
        """Tables for reading, by gate: a byte's input with the bias, and the state's weights, so that an exp of their sum
        is what a gate's sigmoid, 1 / (1 + exp(-a)), or the candidate's tanh, 1 - 2 / (1 + exp(2 a)), is made from."""
        h = self.hidden
        scale = np.array([-1, -1, 2], np.float32)[:, None, None]
        self.fast = {d: tuple(np.ascontiguousarray(w.reshape(-1, 3, h).transpose(1, 0, 2) * scale) for w in (self.w["x" + d] + self.w["b" + d], self.w["u" + d])) for d in "fb"}
        o, c = self.w["o"], self.w["c"]
        self.large = float((np.abs(o).sum(0) + np.abs(c)).max()) > 80  # exp of a logit might not be a number, as states are within 1

    def pooled(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Sums over its positions of the distributions of each window [start, end) of a text [low, high)."""
        out = np.zeros((len(start), len(self.languages)), np.float32)
        order = np.argsort(start - end, kind="stable")
        with np.errstate(over="ignore"):  # a closed gate's exp may be infinite
            for a in range(0, len(order), BATCH):
                pick = order[a : a + BATCH]
                out[pick] = self._windows(data, start[pick], end[pick], low[pick], high[pick])
        return out

    def _step(self, d: str, codes: np.ndarray, s: np.ndarray, gates: np.ndarray, products: np.ndarray) -> None:
        """Takes the states s over one byte each. Every gate has an array of its own, so all arithmetic is on whole rows."""
        x, u = self.fast[d]
        m = len(codes)
        g, v = gates[:, :m], products[:, :m]
        np.take(x, codes, axis=1, out=g, mode="clip")
        np.matmul(s, u, out=v)
        zr, c, vc = g[:2], g[2], v[2]
        zr += v[:2]
        np.exp(zr, out=zr)
        zr += 1
        vc /= zr[1]
        c += vc
        np.exp(c, out=c)
        c += 1
        np.divide(2, c, out=c)
        np.subtract(1, c, out=c)
        s -= c
        s /= zr[0]
        s += c

    def _windows(self, data, start, end, low, high):
        """Windows, longest first: those that have a position are a prefix, in both directions."""
        h, n, length = self.hidden, len(start), end - start
        most, k = int(length[0]), len(self.languages)
        # written over at each step, as fresh memory of this size costs more than the arithmetic
        gates, products = (np.empty((3, n, h), np.float32) for _ in range(2))
        logits, sums, share, total = np.empty((most, k, n), np.float32), np.empty((k, n), np.float32), np.empty(n, np.float32), np.zeros((k, n), np.float32)
        longer = np.searchsorted(-length, -np.arange(most), "left")  # windows longer than each position
        for d, inside, output in (("f", start > low, self.w["o"][:h]), ("b", end < high, self.w["o"][h:])):
            state, output = np.zeros((n, h), np.float32), np.ascontiguousarray(output.T)
            led = np.flatnonzero(inside)
            if len(led):
                s = np.zeros((len(led), h), np.float32)
                for t in range(LEAD, 0, -1):
                    at = start[led] - t if d == "f" else end[led] + t - 1
                    self._step(d, np.take(data, at, mode="clip"), s, gates, products)
                    s *= ((at >= low[led]) if d == "f" else (at < high[led]))[:, None]  # before the text begins there is no state
                state[led] = s
            for t in range(most) if d == "f" else range(most - 1, -1, -1):
                m = int(longer[t])
                s = state[:m]  # backwards, those that begin at this position still have the state of their lead
                self._step(d, np.take(data, start[:m] + t), s, gates, products)
                if d == "f":
                    np.matmul(output, s.T, out=logits[t, :, :m])
                    continue
                e, p = sums[:, :m], share[:m]
                np.matmul(output, s.T, out=e)
                e += logits[t, :, :m]
                e += self.w["c"][:, None]
                if self.large:
                    e -= e.max(0)
                np.exp(e, out=e)
                np.sum(e, axis=0, out=p)
                e /= p
                total[:, :m] += e
        return total.T


def windows(offsets: np.ndarray):
    """Start, end, text, and the text's start and end of each window."""
    size = np.diff(offsets)
    parts = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), parts)
    first = np.repeat(np.cumsum(parts) - parts, parts)
    start = offsets[text] + (np.arange(len(text)) - first) * WINDOW
    return start, np.minimum(start + WINDOW, offsets[text + 1]), text, offsets[text], offsets[text + 1]


def sample(docs: DataFrame, per_language: int = 300, spans: int = 16, chars: int = 64, most: int = 64, seed: int = 5) -> DataFrame:
    """(lang, part): spans of `chars` characters from hashed places all over the texts of about per_language documents of
    each of the `most` most frequent languages, `spans` of each document."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most)
    chosen = known.select("doc_id", "lang", "text").join(sizes, "lang").where(unit(seed, "doc_id") < F.lit(float(per_language)) / F.col("n"))
    numbers = F.explode(F.sequence(F.lit(1), F.lit(spans))).alias("number")
    each = chosen.select("doc_id", "lang", "text", numbers)
    place = F.floor(unit(seed, "doc_id", "number") * F.greatest(F.length("text") - chars + 1, F.lit(1))) + 1
    return each.select("lang", "doc_id", "number", F.substring("text", place.cast("int"), F.lit(chars)).alias("part"))


def fitted(docs: DataFrame, per_language: int = 300, spans: int = 16, chars: int = 64, hidden: int = 12, steps: int = 200, seed: int = 5) -> Network | None:
    """A network learnt from sample()."""
    rows = sample(docs, per_language, spans, chars, seed=seed).collect()
    rows = sorted((r for r in rows if r["part"]), key=lambda r: (r["lang"], r["doc_id"], r["number"], r["part"]))
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    texts = [r["part"].encode("utf-8", "surrogateescape")[:chars] for r in rows]
    length = np.array([len(t) for t in texts])
    codes = np.zeros((len(texts), chars), np.uint8)
    for i, t in enumerate(texts):
        codes[i, : len(t)] = np.frombuffer(t, np.uint8)
    labels = np.array([languages.index(r["lang"]) for r in rows])
    net = Network(hidden, languages, seed)
    # the same number of spans of each language in the mean
    rng = np.random.default_rng(seed)
    pick = np.concatenate([rng.choice(np.flatnonzero(labels == k), 5_000) for k in np.unique(labels)])
    net.train(codes[pick], length[pick], labels[pick], steps, 128, 0.02, seed)
    return net


def predictor(net: Network | None):
    """A function from texts (bytes and offsets) to predictions."""
    if net is not None:
        net.ready()

    def predict(data, offsets):
        n = len(offsets) - 1
        marks = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_LETTER[data], out=marks[1:])
        letters = marks[offsets[1:]] > marks[offsets[:-1]]
        for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
            letters[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
        if net is None or not len(data):
            return ["und"] * n, np.zeros(n)
        start, end, text, low, high = windows(offsets)
        each = net.pooled(data, start, end, low, high)
        total = np.zeros((n, len(net.languages)))
        for k in range(total.shape[1]):
            total[:, k] = np.bincount(text, weights=each[:, k], minlength=n)
        share = total / np.maximum(total.sum(1, keepdims=True), 1e-9)
        best = share.argmax(1)
        return [net.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, np.minimum(share[np.arange(n), best], 1.0), 0.0)

    return predict


def predicted(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs; reads doc_id and text only."""

    def run(batches):
        predict = predictor(net)
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(2))
            for a, b in pieces(offsets, 4 << 20):
                names, scores = predict(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predicted(docs, fitted(docs))
