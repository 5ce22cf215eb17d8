"""op5's network against a plain one, byte by byte; op4's merges with dropout against a plain agenda."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from cloakline.llm import langid
from cloakline.llm import sentencepiece_dropout as sp
from cloakline.llm.common import arrow_bytes
from test_operators import words

# ---------------------------------------------------------------- language


def network(languages=("a", "b", "c")):
    net = langid.Network(5, list(languages), 1)
    rng = np.random.default_rng(2)
    net.w = {k: rng.normal(0, 0.6, v.shape).astype(np.float32) for k, v in net.w.items()}
    net.ready()
    return net


def plain_states(net, d, data):
    h = net.hidden
    x, u, b = (net.w[k + d].astype(float) for k in "xub")
    s, out = np.zeros(h), []
    for byte in data:
        g, v = x[byte] + b, s @ u
        z, r = 1 / (1 + np.exp(-(g[:h] + v[:h]))), 1 / (1 + np.exp(-(g[h : 2 * h] + v[h : 2 * h])))
        c = np.tanh(g[2 * h :] + r * v[2 * h :])
        s = (1 - z) * c + z * s
        out.append(s)
    return out


def plain_sum(net, data, a, b):
    """Sum of the distributions of the positions [a, b), each window with its lead."""
    total = np.zeros(len(net.languages))
    for start in range(a, b, langid.WINDOW):
        end = min(start + langid.WINDOW, b)
        f = plain_states(net, "f", data[max(a, start - langid.LEAD) : end])[-(end - start) :]
        k = plain_states(net, "b", data[start : min(b, end + langid.LEAD)][::-1])[-(end - start) :][::-1]
        for x, y in zip(f, k, strict=True):
            e = np.exp(np.concatenate([x, y]) @ net.w["o"] + net.w["c"])
            total += e / e.sum()
    return total


def test_reading_is_the_plain_network():
    net = network()
    texts = [words(9, 1), "", "x", words(40, 2)[:256], words(60, 3)[:257], words(200, 4), "ł ö\n" * 80]
    data, offsets = arrow_bytes(pa.array(texts, pa.string()))
    start, end, text, low, high = langid.windows(offsets)
    got = np.zeros((len(texts), 3))
    np.add.at(got, text, net.pooled(data, start, end, low, high))
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        assert got[i] == pytest.approx(plain_sum(net, data.tolist(), a, b), abs=1e-3 * max(1, b - a) ** 0.5)
    # the state is carried over words: the same word counts otherwise behind another one
    alone, behind = (plain_states(net, "f", t.encode())[-1] for t in ("over", "word over"))
    assert np.abs(alone - behind).max() > 1e-3
    # whatever else the task reads, and in which batches, a text's prediction stays
    predict = langid.predictor(net)
    whole = predict(data, offsets)[1]
    for i, t in enumerate(texts):
        one = predict(*arrow_bytes(pa.array([t], pa.string())))
        assert one[1][0] == pytest.approx(whole[i], abs=1e-5)


def test_reading_needs_one_exp_a_gate(monkeypatch):
    net, counts = network(), {"exp": 0, "tanh": 0}
    data, offsets = arrow_bytes(pa.array([words(80, i) * 3 for i in range(5)] + ["x", ""], pa.string()))
    start, end, _, low, high = langid.windows(offsets)

    def counted(name, plain):
        def call(x, *args, **kwargs):
            counts[name] += np.size(x)
            return plain(x, *args, **kwargs)

        return call

    for name in counts:
        monkeypatch.setattr(np, name, counted(name, getattr(np, name)))
    net.pooled(data, start, end, low, high)
    # numpy's tanh takes twice the time of its exp; a lead is read only where a window does not begin with the text
    steps = 2 * len(data) + langid.LEAD * ((start > low).sum() + (end < high).sum())
    assert counts == {"exp": steps * 3 * net.hidden + len(data) * len(net.languages), "tanh": 0}


@pytest.mark.parametrize("heavy", [1, 30, 3000])
def test_gates_and_logits_of_any_size(heavy):
    net = network()
    net.w = {k: v * heavy for k, v in net.w.items()}
    net.ready()
    data, offsets = arrow_bytes(pa.array([words(9, 1), "x", words(200, 4)], pa.string()))
    start, end, text, low, high = langid.windows(offsets)
    got = np.zeros((3, 3))
    with np.errstate(all="raise", under="ignore"):
        np.add.at(got, text, net.pooled(data, start, end, low, high))
    assert np.isfinite(got).all() and got.sum(1) == pytest.approx(np.diff(offsets), rel=1e-4)


def test_gradients_of_the_input_and_output_matrices():
    rng = np.random.default_rng(0)
    net = langid.Network(3, ["a", "b"], 0)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    lengths, codes, labels = np.array([5, 3, 2]), rng.integers(0, 4, (3, 5)), np.array([0, 1, 0])

    def loss():
        p, _ = net.forward(codes, lengths)
        return -sum(np.log(p[t, i, labels[i]]) for i in range(3) for t in range(lengths[i])) / lengths.sum()

    p, (both, back, turned, sf, sb) = net.forward(codes, lengths, keep=True)
    err = p.copy()
    err[:, np.arange(3), labels] -= 1
    err *= (np.arange(5)[:, None] < lengths[None, :])[:, :, None] / lengths.sum()
    grads = {k: np.zeros_like(v) for k, v in net.w.items()}
    flat = err.reshape(-1, 2)
    grads["o"], grads["c"] = both.reshape(-1, both.shape[2]).T @ flat, flat.sum(0)
    dh = err @ net.w["o"].T
    net.backward("f", codes, sf, dh[:, :, :3], grads)
    net.backward("b", turned, sb, np.take_along_axis(dh[:, :, 3:], back.T[:, :, None], 0), grads)
    for name in ("xf", "xb", "o", "c"):
        for at in [(int(codes[0, 1]), 2), (int(codes[1, 0]), 7)] if name[0] == "x" else [(1, 1), (4, 0)] if name == "o" else [(0,), (1,)]:
            keep, step = net.w[name][at], 1e-3
            net.w[name][at] = keep + step
            up = loss()
            net.w[name][at] = keep - step
            down = loss()
            net.w[name][at] = keep
            assert grads[name][at] == pytest.approx((up - down) / 2 / step, rel=0.05, abs=2e-4)


def test_language_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, score string, held_out int")
    assert langid.predicted(none, network()).count() == 0
    odd = spark.createDataFrame([(1, None, "a", "x", 1), (2, "123 %", "a", "x", 1), (None, "Wort", None, "x", 1), (3, "é", "b", "x", 1), (3, "é", "b", "x", 1)], none.schema)
    got = sorted(map(tuple, langid.predicted(odd, network()).collect()), key=str)
    assert [(r[0], r[1], r[2] == "und") for r in got] == sorted([(None, False, False), (1, zlib.crc32(b"1") % 3 == 1, True), (2, zlib.crc32(b"2") % 3 == 1, True), *[(3, zlib.crc32(b"3") % 3 == 1, False)] * 2], key=str)


def test_the_sample_reaches_all_of_a_text_and_bounds_languages(spark):
    rows = [(i, "".join(chr(97 + j // 200) for j in range(5200)), "en") for i in range(12)] + [(100 + i, "x", f"l{i}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(df).collect()
    assert len({r.lang for r in got}) <= 64
    seen = {c for r in got if r.lang == "en" for c in r.part}
    assert len(seen) >= 24


# ---------------------------------------------------------------- SentencePiece


def plain_merges(coder, text, doc_id):
    """The agenda over a whole text, without segments, caches or vectors."""
    v = coder.v
    out = []
    codes = [32, *map(ord, text)] if text else []
    mask = (1 << 64) - 1

    def mixed(h):
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> shift)) * times & mask
        return h ^ (h >> 31)

    c = [int(x) for x in sp._C]
    own = mixed((int(coder.seeds[0]) + doc_id * c[1]) & mask)
    symbols = [int(v.char[sp.MARK]) if x == 32 else -1 if x == sp.MARK else int(v.char[x]) for x in codes]
    inner = [bool(v.inner[sp.MARK]) if x == 32 else x != sp.MARK and bool(v.inner[x]) for x in codes]
    begins = [i == 0 or not inner[i] or not inner[i - 1] or codes[i] == 32 and codes[i - 1] != 32 for i in range(len(codes))]
    starts = [i for i, b in enumerate(begins) if b] + [len(codes)]
    ranks = {}
    for r, piece in enumerate(v.merged.tolist()):
        ranks[v.names[piece]] = r
    name = lambda s: v.names[s] if s < len(v.names) else v.char_of[s]
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a == 1 and symbols[a] < 0:
            out += coder._bytes(codes[a]).tolist()
            continue
        parts = [(i, symbols[a + i]) for i in range(b - a)]
        key = mixed((own + a * c[2] + int(coder.seeds[1])) & mask)
        while True:
            best = None
            for k, ((i, x), (_, y)) in enumerate(zip(parts, parts[1:], strict=False)):
                r = ranks.get(name(x) + name(y))
                if r is None or mixed((key + i * c[1] + x * c[2] + y * c[3]) & mask) < int(coder.bound):
                    continue
                if best is None or r < best[0]:
                    best = (r, k)
            if best is None:
                break
            r, k = best
            parts[k : k + 2] = [(parts[k][0], int(v.merged[r]))]
        for _, p in parts:
            out += [p] if p < len(v.names) else coder._bytes(ord(v.char_of[p])).tolist()
    return out


@pytest.mark.parametrize("dropout", [0.1, 0.4])
def test_merge_dropout_against_a_plain_agenda(dropout):
    texts = [words(60, 1), "the nation and the international nations of the", "a  b\n\tc ▁ ñ 日本語 𝔘 ", "ab" * 90 + " tail", "", "x", "https://example.com/a-very-long-unbroken-path/that/goes/on?and=on&on=on"]
    coder = sp.Encoder(sp.model_bytes(), dropout)
    ids, at = coder.encode(texts, np.arange(7) * 11)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == plain_merges(coder, t, i * 11)


def test_what_is_kept_is_bounded_by_size():
    coder = sp.Encoder(sp.model_bytes(), 0.1, keep=1000)
    for i in range(20):
        coder.encode([words(2000, i)], np.array([i]))
        assert len(coder.flat) + len(coder.cands) < 16 * 1000 + 200_000
