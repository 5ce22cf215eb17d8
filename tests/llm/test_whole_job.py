"""What the review of the first round found cut short."""

import collections
import random

import numpy as np

import corpus_pipeline
from cloakline.llm import html_text, quality
from cloakline.llm import sentencepiece_dropout as sp


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abdeiklmnoprst") for _ in range(rng.randint(2, 8))) for _ in range(n))


# ---------------------------------------------------------------- quality


def test_quality_fences_are_the_groups_own(spark):
    """A tight group's fence is tight, a wide group's wide, for each rate; one chance event fails no text."""
    every = lambda n, k, mark: " ".join(w + mark * (i % k == 0) for i, w in enumerate(n.split()))
    tight = [(i, words(100, i), "en", "tight") for i in range(150)]
    wide = [(1000 + i, every(words(100, 300 + i), 2 + i % 9, "#"), "en", "wide") for i in range(150)]
    odd = {
        5000: every(words(100, 900), 6, "#"),  # a symbol in six words: usual in wide only
        5001: words(100, 901).upper()[:120] + words(100, 902),  # about a quarter in capitals
        5002: "\n".join([words(5, 910 + i) if i % 5 else "one line" for i in range(20)]),  # three lines of 20 again
        5003: " ".join(w + "xy" for w in words(100, 903).split()),  # words longer by two
    }
    chance = {6000: words(11, 904) + " #", 6001: words(20, 905) + "\n" + words(8, 906) + "\n" + words(60, 907) + "\n" + words(8, 906)}
    more = [(k, t, "en", "tight") for k, t in (odd | chance).items()] + [(7000, odd[5000], "en", "wide")]
    df = spark.createDataFrame(tight + wide + more, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.q_failed, r.q_kept) for r in quality.judged(df, "doc_id").collect()}
    assert all(got[r[0]][1] for r in tight + wide) and got[7000][1]
    assert {k: got[k] for k in odd} == {k: (False, False) for k in odd}
    assert {k: got[k] for k in chance} == {k: (False, True) for k in chance}


# ---------------------------------------------------------------- SentencePiece


def test_merge_dropout_draws_for_each_occurrence(monkeypatch):
    """Words of one candidate vary everywhere at the rate, variety grows with the input, and what is kept changes nothing."""
    n = 4000
    coder = sp.Encoder(sp.model_bytes())
    ids, at = coder.encode(["to " * n, "to " * n], np.array([1, 2]))
    names = [coder.v.names[i] for i in ids]
    plain, _ = sp.Encoder(sp.model_bytes(), 0.0).encode(["to " * n], np.array([1]))
    assert collections.Counter(coder.v.names[i] for i in plain)["▁to"] == n
    split = 1 - collections.Counter(names)["▁to"] / (2 * n)
    forms = set()
    for d in range(40):
        ids, at = coder.encode([" ".join(["international"] * 50)], np.array([d]))
        forms |= set(" ".join(coder.v.names[i] for i in ids).split("▁"))
    assert 0.08 < split < 0.3 and len(forms) > 40
    texts = [words(300, i) + " the of " * 50 for i in range(4)] * 2
    one = sp.Encoder(sp.model_bytes(), 0.2).encode(texts, np.arange(8))
    kept = sp.Encoder(sp.model_bytes(), 0.2, keep=10)
    parts = [kept.encode([t], np.array([i]))[0] for i, t in enumerate(texts)]
    assert np.concatenate(parts).tolist() == one[0].tolist()
    monkeypatch.setattr(sp, "SHORT", 0)
    alone = sp.Encoder(sp.model_bytes(), 0.2).encode(texts, np.arange(8))
    assert alone[0].tolist() == one[0].tolist() and alone[1].tolist() == one[1].tolist()


def test_pieces_are_returned(spark):
    """The pieces themselves come out of op4 and of the pipeline's last stage, and decode to the texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for out in (sp.op4(spark, "/root/testdata/sf0.001"), corpus_pipeline.pieces(spark, docs, "/root/testdata/sf0.001")):
        assert dict(out.dtypes)["ids"] == "array<int>"
        assert all(len(r.ids) == r.n_pieces for r in out.select("ids", "n_pieces").collect())
        assert {r.doc_id: r.text for r in sp.decoded(out).collect()} == want


# ---------------------------------------------------------------- HTML


def test_hinted_wrappers_keep_their_article_and_comments_go():
    text = [words(30, i) + "." for i in range(4)]
    body = "".join(f"<p>{t}</p>" for t in text)
    side = "<div class='sidebar'><p>Sidebar text which is long enough to surge in the distribution</p></div>"
    comment = f"<article class='comment'><p>{words(40, 50)}</p></article>"
    for name in ("class='has-sidebar'", "class=no-sidebar", "class='content-with-sidebar'", "class='layout sidebar-right'", "class=page-with-toc", "id='post-share-wrapper'", "class='sidebar-right'"):
        for a, b in (("<article>", "</article>"), ("", "")):
            for tail in (side, comment, f"<section id=comments>{comment}<p>{words(20, 51)}</p></section>"):
                page = f"<body><div {name}>{a}{body}{b}{tail}</div></body>"
                assert html_text.main_text(page) == "\n".join(text), page
    long = "".join(f"<article><p>{words(90, 60 + i)}</p></article>" for i in range(5))
    assert html_text.main_text(f"<body><article>{body}</article><div id=comments>{long}</div></body>") == "\n".join(text)


def test_all_of_the_main_container_is_output():
    """Short chapters beside a long one, paragraphs of links, and an article mark on what isn't the article."""
    menu = "<div><a href=/x>Home</a> <a href=/y>About us</a></div>"
    chapters = [words(20, 1) + ".", words(400, 2) + ".", words(15, 3) + ".", words(12, 4) + "."]
    page = f"<body>{menu}<div><h1>Title</h1>" + "".join(f"<section><p>{t}</p></section>" for t in chapters) + "<p>End.</p></div></body>"
    assert html_text.main_text(page) == "\n".join(["Title", *chapters, "End."])
    long = [words(40, 10 + i) + "." for i in range(4)]
    page = f"<body>{menu}<div><p>{long[0]}</p><p>See <a href=/z>{long[1]}</a></p><p>{long[2]}</p><p><a href=/q>More</a></p></div></body>"
    assert html_text.main_text(page) == "\n".join([long[0], "See " + long[1], long[2], "More"])
    text = "".join(f"<p>{t}</p>" for t in long)
    page = f"<body>{menu}<div>{text}</div><article><p>A teaser for another page.</p></article></body>"
    assert html_text.main_text(page) == "\n".join(long)
    # blocks each in a container of their own
    page = f"<body>{menu}<section><div>" + "".join(f"<div><p>{t}</p></div>" for t in long) + "<div>Fin.</div></div></section></body>"
    assert html_text.main_text(page) == "\n".join([*long, "Fin."])
