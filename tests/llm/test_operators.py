"""Each dealt operator against brute force, and on nulls, blanks, ties, repeats, empty tables and clashing columns."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakline.llm import ann, html_text, jaccard, langid, mixing, quality, sharding, suffix_dedup, warc
from cloakline.llm import sentencepiece_dropout as sp
from cloakline.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, node long, u string, n string, block string, start string"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abdeiklmnoprst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def rows():
    """Copies, near copies, a shared passage, nulls, blanks, one very long text, short texts and repeated rows."""
    base, passage = words(300, 1), words(60, 2)
    near = base.split()
    near[150] = "changed"
    texts = [base, base, " ".join(near), words(50, 3) + " " + passage + " " + words(50, 4), passage + "\n" + words(80, 5), None, "", "  \n\t ", "one", "One", "two words", "ö ß ł " * 40, words(30_000, 6)]
    texts += [words(40 + i, 100 + i) for i in range(20)] + ["Ab cd ef gh ij kl mn op qr st " * 12, "x\ny\nx\ny\nlonger line here\nlonger line here"]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None, i, 7, "u", "n", "b", "s") for i, t in enumerate(texts)]
    return [*out, out[3], (None, words(45, 77), "de", "s1", None, 1, 1, "", "", "", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def count(text):
    return len(WORD.findall(text or ""))


# ---------------------------------------------------------------- WARC


def test_warc_round_trip_and_revisits(spark, tmp_path):
    pages = [(3, "http://a/é\r\nx", "<p>ł\r\n\r\nWARC/1.1\r\n</p>"), (1, None, "same"), (2, "http://b", "same"), (5, "u", None), (6, "v", ""), (7, "w", "x" * 200_000), (None, "n", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_warc(df.repartition(2), str(tmp_path / "w"))
    got = warc.assemble(warc.read_warc(spark, str(tmp_path / "w"))).collect()
    assert len(got) == len(pages)
    by = {r["metadata"][0]["fields"]["page-id"]: r for r in got}
    kinds = {k: r["response"]["warc_type"] for k, r in by.items()}
    assert kinds == {"3": "response", "1": "response", "2": "revisit", "5": "response", "6": "revisit", "7": "response", "": "revisit"}
    assert by["2"]["response"]["refers_to"] == by["1"]["capture_id"]
    for page_id, _, html in pages[:1] + pages[5:6]:
        r = by[str(page_id)]["response"]
        assert bytes(r["payload"]) == html.encode()
        assert r["payload_digest"] == r["declared_digest"] == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    assert all(len(r["requests"]) == 1 and len(r["metadata"]) == 1 for r in got)
    assert by["2"]["response"]["payload_bytes"] == 4


def test_warc_blocks_that_end_in_line_ends(spark, tmp_path):
    blocks = [b"abc", b"abc\n", b"abc\r\n", b"\n", b"a\n\n", b"", b"\r\n\r\n", b"a\nb"]
    data = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks)
    assert [b for _, b in warc.parse_records(("f", x) for x in data.split(b"\n"))] == blocks
    htmls = ["<p>x</p>\n", "<p>x</p>\r\n", "<p>x</p>", "\n", "\r\n\r\n", "\r", " ", "<p>x</p>\r\n\r\n"]
    df = spark.createDataFrame([(i, f"http://{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    warc.write_warc(df.repartition(2), str(tmp_path / "w"))
    got = {int(r["metadata"][0]["fields"]["page-id"]): r["response"] for r in warc.assemble(warc.read_warc(spark, str(tmp_path / "w"))).collect()}
    for i, h in enumerate(htmls):
        assert (bytes(got[i]["payload"]), got[i]["payload_bytes"]) == (h.encode(), len(h.encode()))
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()


def test_warc_empty(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0


def test_warc_records_named_the_other_way(spark):
    def record(kind, name, near=()):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\n" + "".join(f"WARC-Concurrent-To: {n}\r\n" for n in near) + "Content-Length: 2\r\n\r\nab\r\n\r\n"

    data = record("warcinfo", "i") + record("response", "r", ["q"]) + record("request", "q") + record("metadata", "m", ["q"]) + record("metadata", "lost", ["zz"])
    lines = [("f", x) for x in data.encode().split(b"\n")]
    found = list(warc.parse_records(iter(lines)))
    assert [b for _, b in found] == [b"ab"] * 5
    df = spark.createDataFrame([(dict(h)["warc-type"], dict(h)["warc-record-id"], None, [v for k, v in h if k == "warc-concurrent-to"], None, None, 2, None, {}, None) for h, _ in found], warc.RECORD)
    got = warc.assemble(df).collect()
    assert len(got) == 1 and got[0]["requests"][0]["record_id"] == "q" and [m["record_id"] for m in got[0]["metadata"]] == ["m"]


# ---------------------------------------------------------------- HTML


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies on this site to serve you</div>
<div class="ad">Buy now, really, buy it now for a very good price</div><article><h1>Title &amp; more</h1><p><b>First&nbsp;paragraph <i>with</i>\n text.<br>Next<p>Second.</p>
<form><input name=x><label>Mail</label></form><aside>Related stories that nobody reads at all</aside><ul><li>item 1</li><li>item 2</li></ul>
<div class="share-buttons"><a href=#>Share</a></div><p>Last &lt;p&gt; one.</p></article><section id="comments"><p>Great article, I liked it very much!</p></section>
<div class=sidebar><p>Sidebar text which is long enough to surge in the distribution</p></div><footer>&copy; 2024</footer></body></html>"""


def test_main_text_of_marked_article():
    assert html_text.main_text(PAGE) == "Title & more\nFirst paragraph with text. Next\nSecond.\nitem 1\nitem 2\nLast <p> one."


def test_main_text_without_article_mark():
    body = "\n".join(f"<p>{words(40, i)}.</p>" for i in range(5))
    page = f"<body><div><a href=/x>Home</a> <a href=/y>About us</a></div><section><p>Short blurb here.</p></section><section>{body}</section><section><p>Tail.</p></section></body>"
    assert html_text.main_text(page) == "\n".join(f"{words(40, i)}." for i in range(5))


def test_main_text_of_a_container_parted_by_adverts():
    long = [words(40, i) + "." for i in range(6)]
    advert = "<div class='ad'>Buy it now, for a very good price indeed, or never</div>"
    body = "".join(f"<p>{t}</p>" for t in long)
    page = f"<body><p>Skip.</p><div><p>Not of it.</p></div><div id=main-text><h2>Head</h2>{advert}{body}{advert}<p>Short end.</p></div><div>Also not.</div></body>"
    assert html_text.main_text(page) == "\n".join(["Head", *long, "Short end."])


def test_main_text_edges(spark):
    for page in (None, "", "<", "<p", "<!-- open", "<script>x", "plain", "<div>" * 500 + "deep" + "</div>" * 3, "</p></p>", "<p>&#0;&bogus;&amp;</p>"):
        html_text.main_text(page)
    assert html_text.main_text("just text") == "just text"
    assert html_text.main_text("<article>a</article>") == "a"
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>hi</p>", "y")], "page_id long, url string, html string, text string")
    got = html_text.extracted(df).collect()
    assert sorted((r.text, r.n_chars) for r in got) == [("", 0), ("", 0), ("hi", 2)]
    assert html_text.extracted(df.where("false")).count() == 0


# ---------------------------------------------------------------- mixing


def water(sizes, share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        free -= set(over)
    return target


def test_mixing(spark, docs, none):
    got = mixing.mixed(docs.select("doc_id", "source", "text", "u"), block_words=16).collect()
    sizes = collections.Counter()
    for r in rows():
        sizes[r[3]] += count(r[1])
    target = water(dict(sizes))
    assert len(got) == len(rows())
    taken = collections.Counter()
    for r in got:
        assert r.taken <= 2 * r.size
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 16 * 4
    again = mixing.mixed(docs.select("doc_id", "source", "text", "u").repartition(5), block_words=16).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mixed(none).count() == 0


# ---------------------------------------------------------------- SentencePiece


def test_merge_dropout(docs, none):
    import sentencepiece

    texts = [r[1] or "" for r in rows() if count(r[1]) < 5000] + ["▁ mark", " a  b\n\tc ", "日本語 ñ 𝔘", "e" * 400, "ab" * 300 + " tail"]
    ids = np.arange(len(texts))
    library = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    plain = sp.Encoder(sp.model_bytes(), 0.0)
    got, at = plain.encode(texts, ids)
    for i, t in enumerate(texts):
        if "▁" not in t:
            assert got[at[i] : at[i + 1]].tolist() == library.encode(t)
    varied = sp.Encoder(sp.model_bytes(), 0.3, variants=8)
    more, bounds = varied.encode(texts, ids)
    data, back = varied.decode(more, bounds)
    assert [data[a:b].tobytes().decode() for a, b in zip(back[:-1], back[1:], strict=True)] == texts
    assert len(more) > len(got)
    one, _ = sp.Encoder(sp.model_bytes(), 0.3, variants=8).encode(["the nation and the nation " * 20], np.array([1]))
    two, _ = sp.Encoder(sp.model_bytes(), 0.3, variants=8).encode(["the nation and the nation " * 20], np.array([2]))
    assert one.tolist() != two.tolist()
    rows_out = sp.encoded(docs, "source", "u").collect()
    assert all(r.lossless and r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, np.int32).tobytes()) for r in rows_out)
    assert sp.decoded(sp.encoded(docs)).where("text <> ''").count() == sum(bool(r[1]) for r in rows())
    assert sp.encoded(none).count() == 0


def test_merge_dropout_heap_is_the_matrix(monkeypatch):
    texts = [words(60, i) for i in range(5)]
    a, _ = sp.Encoder(sp.model_bytes(), 0.3).encode(texts, np.arange(5))
    monkeypatch.setattr(sp, "WIDEST", 1)
    b, _ = sp.Encoder(sp.model_bytes(), 0.3).encode(texts, np.arange(5))
    assert a.tolist() == b.tolist()


# ---------------------------------------------------------------- language


def test_network_gradients():
    """Backpropagation through time against differences."""
    rng = np.random.default_rng(0)
    net = langid.Network(3, ["a", "b"], 0)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    lengths, codes = np.array([5, 3, 2]), rng.integers(0, 256, (3, 5))
    labels = np.array([0, 1, 0])

    def loss():
        p, _ = net.forward(codes, lengths)
        return -sum(np.log(p[t, i, labels[i]]) for i in range(3) for t in range(lengths[i])) / lengths.sum()

    p, (both, back, turned, sf, sb) = net.forward(codes, lengths, keep=True)
    err = p.copy()
    err[:, np.arange(3), labels] -= 1
    err *= (np.arange(5)[:, None] < lengths[None, :])[:, :, None] / lengths.sum()
    grads = {k: np.zeros_like(v) for k, v in net.w.items()}
    dh = err @ net.w["o"].T
    net.backward("f", codes, sf, dh[:, :, :3], grads)
    net.backward("b", turned, sb, np.take_along_axis(dh[:, :, 3:], back.T[:, :, None], 0), grads)
    for name in ("uf", "ub", "bf", "bb"):
        at = np.unravel_index(rng.integers(0, net.w[name].size), net.w[name].shape)
        keep, step = net.w[name][at], 1e-3
        net.w[name][at] = keep + step
        up = loss()
        net.w[name][at] = keep - step
        down = loss()
        net.w[name][at] = keep
        assert grads[name][at] == pytest.approx((up - down) / 2 / step, rel=0.03, abs=1e-4)


def test_language(spark, docs, none):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.fitted(table, steps=200)
    known = {r.doc_id: r.lang for r in table.select("doc_id", "lang").collect()}
    got = langid.predicted(table, net).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in known if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.97 * len(held)
    odd = {r.doc_id: r for r in langid.predicted(docs, net).collect()}
    assert odd[5].lang_pred == odd[6].lang_pred == odd[7].lang_pred == "und" and odd[5].score == 0
    assert odd[8].lang_pred in net.languages and 0 <= odd[8].score <= 1
    assert langid.fitted(none) is None
    assert {r.lang_pred for r in langid.predicted(docs, None).collect()} == {"und"}


# ---------------------------------------------------------------- quality


def base_counts(text):
    w = WORD.findall(text or "")
    seen, dup, cover, places = set(), 0, set(), collections.defaultdict(list)
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    for i in range(len(w) - 4):
        places[tuple(w[i : i + 5])].append(i)
    for at in places.values():
        if len(at) > 1:
            cover.update(x + j for x in at for j in range(5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def test_quality_counts(docs, none):
    got = quality.judged(docs, "doc_id", "key", "n").collect()
    want = collections.Counter((r[0], *base_counts(r[1])) for r in rows())
    assert collections.Counter((r.doc_id, r.q_words, r.q_word_chars, r.q_symbols, r.q_dup_lines, r.q_repeat_words) for r in got) == want
    for r in got:
        assert r.q_failed == (r.q_words < 10 or 100 * r.q_repeat_words > 20 * r.q_words)
        assert not (r.q_failed and r.q_kept)
    with_text = quality.judged(docs, *docs.columns)
    assert with_text.columns[: len(docs.columns)] == docs.columns and with_text.count() == len(rows())
    assert quality.judged(none, "doc_id").count() == 0


def test_quality_thresholds_adapt_and_merge(spark):
    plain = [(i, words(60, i), "en", "a") for i in range(150)]
    marked = [(1000 + i, " ".join(w + "###" for w in words(60, i).split()), "en", "a") for i in range(5)]
    habit = [(2000 + i, " | ".join(words(60, 500 + i).split()), "en", "tables") for i in range(150)]  # usual in its source
    df = spark.createDataFrame(plain + marked + habit, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.q_kept for r in quality.judged(df, "doc_id").collect()}
    assert all(got[r[0]] for r in plain + habit) and not any(got[r[0]] for r in marked)
    whole, parts = quality.sketches(quality.counted(df)), [quality.sketches(quality.counted(df.where(f"doc_id % 2 = {k}"))) for k in (0, 1)]
    both = parts[0].unionByName(parts[1]).groupBy("q_lang", "q_source", "rate", "bin").agg({"n": "sum"})
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, both.collect()))


# ---------------------------------------------------------------- neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)) + 2 * rng.normal(size=(10, 16))[rng.integers(0, 10, 1500)]
    x[200:260] = x[100]  # ties
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0] * 3), (5004, [None] + [1.0] * 15), (50, x[50].tolist())]
    data += [(None, x[7].tolist())]
    rows_ = ann.usable(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3))
    assert rows_.count() == 1501
    books = ann.fit(rows_, books=8, words=32)
    index = ann.coded(rows_, books)
    got = collections.defaultdict(list)
    for r in ann.search(index, ann.pruned(rows_, 5), rows_.where("vec_id % 50 = 0"), books, candidates=64, block=400, block_queries=10).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in range(0, 1500, 50):
        best = sorted(got[q])
        assert [b[0] for b in best] == [1, 2, 3, 4, 5]
        s = u @ u[q]
        s[q] = -2
        want = np.lexsort((np.arange(1500), -s.round(12)))[:5]
        hit += len(set(want) & {b[1] for b in best})
        for _, v, score in best:
            assert score == pytest.approx(s[v], abs=1e-12)
    assert hit >= 0.9 * 30 * 5
    assert [b[1] for b in sorted(got[100])] == [200, 201, 202, 203, 204]
    assert ann.fit(rows_.where("false")) is None


def test_neighbours_with_the_query_s_own_parameters(spark, tmp_path):
    """Recall of the registered query on a table that its candidates are a small share of; copies, and an empty table."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 24)).astype(np.float32)
    x[3000:3900] = x[17]  # a large group of copies
    frame = "vec_id long, embedding array<float>, label int, code string, norm string"
    spark.createDataFrame([(i, v.tolist(), 1, "c", "n") for i, v in enumerate(x)], frame).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = collections.defaultdict(dict)
    for r in ann.op7(spark, str(tmp_path)).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    y = x.astype(float)
    u = y / np.linalg.norm(y, axis=1)[:, None]
    hit = 0
    for q in range(0, 6000, 50):
        s = u @ u[q]
        s[q] = -2
        want = np.lexsort((np.arange(6000), -s.round(9)))[:5]
        hit += len(set(want) & {v for v, _ in got[q].values()})
        assert all(score == pytest.approx(s[v], abs=1e-12) for v, score in got[q].values()) and sorted(got[q]) == [1, 2, 3, 4, 5]
    assert hit >= 0.9 * 120 * 5
    assert [got[3050][i][0] for i in range(1, 6)] == [17, 3000, 3001, 3002, 3003]
    spark.createDataFrame([], frame).write.parquet(str(tmp_path / "none/embeddings.parquet"))
    assert ann.op7(spark, str(tmp_path / "none")).count() == 0


def test_neighbours_are_the_true_ones_whatever_the_codes(spark, tmp_path):
    """Clusters far narrower than the codes' errors, a few outliers, and vectors too long or short to be squared."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(12, 16))[rng.integers(0, 12, 6000)] + 0.004 * rng.normal(size=(6000, 16))
    x[::500] = rng.normal(size=(12, 16))
    x[1::7] *= 1e200
    x[2::7] *= 1e-200
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = collections.defaultdict(list)
    for r in ann.op7(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    y = x / np.abs(x).max(1)[:, None]
    u = y / np.linalg.norm(y, axis=1)[:, None]
    for q in range(0, 6000, 50):
        s = u @ u[q]
        s[q] = -2
        assert [v for v, _ in got[q]] == np.argsort(-s, kind="stable")[:5].tolist()
        assert [score for _, score in got[q]] == pytest.approx([s[v] for v, _ in got[q]], abs=1e-12)


# ---------------------------------------------------------------- suffix dedup


def removed(texts, width):
    where = collections.defaultdict(list)
    for i, t in enumerate(texts):
        for j in range(len(t) - width + 1):
            where[t[j : j + width]].append((i, j))
    marks = [bytearray(len(t)) for t in texts]
    for at in where.values():
        if len(at) > 1:
            for i, j in at:
                marks[i][j : j + width] = b"\1" * width
    return marks


def test_suffix_dedup(docs, none):
    data = [(r[1] or "").encode() for r in rows()]
    want = collections.Counter()
    for r, t, m in zip(rows(), data, removed(data, 40), strict=True):
        spans = sum(1 for i, x in enumerate(m) if x and (not i or not m[i - 1]))
        want[(r[0], len(t), sum(m), spans, hashlib.sha256(bytes(c for c, x in zip(t, m, strict=True) if not x)).hexdigest())] += 1
    got = suffix_dedup.deduplicated(docs, "key", "start", width=40, gram=12)
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want
    kept = suffix_dedup.deduplicated(docs, width=40, gram=12, with_text=True).collect()
    assert all(len(r.kept.encode()) >= r.n_bytes - r.n_removed for r in kept)
    assert suffix_dedup.deduplicated(none).count() == 0


def test_common_anchors_go_by_windows(spark):
    """A passage in most documents: its anchors are too frequent for one shard."""
    passage = words(30, 9)
    texts = [words(20, 40 + i) + " " + passage + " " + words(20, 4000 + i) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    data = [t.encode() for t in texts]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.deduplicated(df, width=40, gram=12).collect()}
    assert got == {i: sum(m) for i, m in enumerate(removed(data, 40))}


def test_run_length_index_alone():
    rng = random.Random(3)
    for _ in range(20):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 90))) for _ in range(8)]
        texts += [texts[0][3:60], texts[1]]
        index = suffix_dedup.run_index(texts, 14)
        which, start, size = suffix_dedup.repeated(index)
        got = [sorted({j for w, a, n in zip(which, start, size, strict=True) if w == i for j in range(a, a + n - 13)}) for i in range(len(texts))]
        assert sum(index.lengths) == sum(map(len, texts)) + len(texts) and len(index.heads) == len(index.lengths)
        where = collections.Counter(t[j : j + 14] for t in texts for j in range(len(t) - 13))
        assert got == [[j for j in range(len(t) - 13) if where[t[j : j + 14]] > 1] for t in texts]


def test_run_length_index_of_copies_grows_with_runs():
    rng = random.Random(4)
    passage = bytes(rng.choice(b"abcdefgh") for _ in range(400))
    runs = [len(suffix_dedup.run_index([passage[rng.randint(0, 9) :] + bytes([i]) for i in range(n)], 200).heads) for n in (10, 80)]
    assert runs[1] < runs[0] + 4 * 70  # a few for each further copy of 400 bytes


def test_texts_that_share_a_key_stay_apart(spark):
    texts = [words(60, 1), words(60, 1), words(60, 2), words(60, 3) + words(60, 2), "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    data = [(t or "").encode() for t in texts]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.deduplicated(df, width=40, gram=12, hashed=lambda t: F.length(t).cast("long") % 2).collect()}
    assert got == {i: sum(m) for i, m in enumerate(removed(data, 40))}


# ---------------------------------------------------------------- sharding


def test_shards(docs, none):
    got = sharding.shuffled_shards(docs.select("doc_id", "text", "u", "node"), shards=4, least_parts=8).collect()
    assert len(got) == len(rows())
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) == {0, 1, 2, 3} and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert sharding.shuffled_shards(none).count() == 0


def test_communication_matrix_law(spark, monkeypatch):
    """Rows and columns add up, with and without groups."""
    sizes = {i: 3 + i % 5 for i in range(12)}
    df = spark.createDataFrame(list(sizes.items()), "part int, n long")
    n, shards = sum(sizes.values()), 3
    want = [(n + shards - 1 - j) // shards for j in range(shards)]
    for group in (1024, 4):
        monkeypatch.setattr(sharding, "GROUP", group)
        got = {r.part: r.gets for r in sharding.communication_matrix(df, shards, 100).collect()}
        assert {p: sum(g) for p, g in got.items()} == sizes
        assert [sum(g[j] for g in got.values()) for j in range(shards)] == want


def test_copies_of_a_row_are_spread(spark):
    df = spark.createDataFrame([(1, "same")] * 600 + [(i, "x") for i in range(200)], "doc_id long, text string").repartition(3)
    got = sharding.shuffled_shards(df, shards=4, least_parts=16).where("doc_id = 1").groupBy("shard").count().collect()
    assert len(got) == 4 and all(110 < r["count"] < 190 for r in got)


def test_hypergeometric_law(spark):
    from pyspark.sql import functions as F

    long = lambda x: F.lit(x).cast("long")
    got = spark.range(4000).select(sharding.hypergeometric(long(60), long(20), long(15), sharding.unit(9, "id")).alias("x")).groupBy("x").count().collect()
    from math import comb

    for r in got:
        p = comb(20, r.x) * comb(40, 15 - r.x) / comb(60, 15)
        assert abs(r["count"] / 4000 - p) < 5 * (p * (1 - p) / 4000) ** 0.5 + 1e-3


# ---------------------------------------------------------------- similarity join


def components_of(texts, k=4, percent=85):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append(frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    p = list(range(len(sets)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                p[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("options", [{}, {"tile": 4, "frequent": 2, "combine": 20}])
def test_similar_groups(spark, options):
    rng = random.Random(8)
    texts = [r[1] for r in rows()]
    for family in range(4):  # copies with edits around the threshold, short and long
        base = words((12, 40, 150, 400)[family], 900 + family).split()
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = "edit%d" % rng.randrange(50)
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(df, **options).collect()}
    n, root = components_of(texts)
    assert got == {i: (n[i], root[i]) for i in range(len(texts))}


def test_similar_groups_edges(docs, none):
    got = jaccard.similar_groups(docs).collect()
    assert len(got) == len(rows()) and sum(r.doc_id is None for r in got) == 1
    assert jaccard.similar_groups(none).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(2200)] + [(i, i + 1) for i in range(4000, 4300)] + [(1, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), finish=100).collect()}
    p = {}

    def find(x):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        p[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in p if find(x) != x}


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from cloakline.llm.queries import oracle_sql, queries

    good = [(i, words(60 + i % 50, 7000 + i), "en", f"s{i % 3}", 1) for i in range(60)]
    near = good[5][1].split()
    near[7] = "other"
    passage = words(70, 31)
    odd = [(100, " ".join(near), "en", "s1", 1), (101, good[6][1], "en", "s2", 1), (102, None, None, None, None), (103, "too short", "en", "s0", 1)]
    odd += [(104 + k, words(60, 8000 + k) + " " + passage + " " + words(60, 8100 + k), "en", "s0", 1) for k in range(2)]
    spark.createDataFrame(good + odd, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert ids == {r[0] for r in good} | {104, 105}
    texts = {r.doc_id: r.text for r in got}
    assert all(texts[r[0]] == r[1] for r in good)
    assert passage not in texts[104] and all(r.n_chars == len(r.text) for r in got)
    assert set(oracle_sql()) <= set(queries())
