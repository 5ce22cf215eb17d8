"""The line-block distribution against brute force, pages it decides, hostile markup; op6's verdict against brute force."""

import collections
import math
import random
import time

import numpy as np
import pytest

from cloakline.llm import html_text, quality
from test_operators import base_counts, words

# ---------------------------------------------------------------- HTML


def by_hand(weights, width, threshold):
    sums = [sum(weights[i : i + width]) for i in range(len(weights))]
    out, i = [], 0
    while i < len(weights):
        if weights[i] and sums[i] > threshold:
            j = i
            while j < len(weights) and sums[j]:
                j += 1
            out.append((i, j))
            i = j
        i += 1
    if not out and any(weights):
        best = sums.index(max(sums))
        out = [(best, min(best + width, len(weights)))]
    return out


def test_distribution_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        weights = [rng.choice((0, 0, 0, 5, 30, 60)) for _ in range(rng.randint(1, 40))]
        for width, threshold in ((1, 10), (3, 40), (5, 70)):
            assert html_text.regions(np.array(weights), width, threshold) == by_hand(weights, width, threshold)


def test_the_distribution_decides():
    """Surge and dive pick the text where no mark does, and against a mark that stands elsewhere."""
    long = [words(40, i) + "." for i in range(4)]
    text = "".join(f"<p>{t}</p>" for t in long)
    menu = "".join(f"<p><a href=/{i}>{words(2, 50 + i)}</a></p>" for i in range(8))
    page = f"<body><div>{menu}</div><div>{text}</div><div>{menu}</div></body>"
    assert html_text.main_text(page) == "\n".join(long)
    assert html_text.main_text(f"<body>{menu}{text}{menu}</body>") == "\n".join(long)  # no container but the body
    assert html_text.main_text(f"<body>{menu}{text}{menu}</body>", threshold=10**6) == "\n".join(long[:3])  # nothing surges: the heaviest window
    teasers = "".join(f"<article><p>{words(4, 90 + i)}</p></article>" for i in range(3))
    assert html_text.main_text(f"<body><div>{teasers}</div><div>{text}</div></body>") == "\n".join(long)
    two = f"<body><article><h2>Old</h2><p>{words(9, 70)}</p></article><article><h1>New</h1>{text}<p>End.</p></article></body>"
    assert html_text.main_text(two) == "\n".join(["New", *long, "End."])


def test_names_inside_the_article_lose_nothing():
    long = [words(40, i) + "." for i in range(4)]
    kept = f"<p class=social-history>{long[1]}</p><p id=legal>{long[2]}</p><p class='reply'>{long[3]}</p><p>so <math><mi>x</mi> = 1</math></p>"
    page = f"<body><article><p>{long[0]}</p>{kept}<p class=advert>Buy it now.</p><div class=notice>We changed our terms.</div></article></body>"
    assert html_text.main_text(page) == "\n".join([*long, "so x = 1"])


@pytest.mark.parametrize("piece", ['<p class="x>', "<a \"", "<b title='", "</b>", "<div class=ad>", "<section><p>" + "w " * 30, "<article>", "<b>", "<script>", "<!--", "<a<a"])
def test_hostile_markup_takes_linear_time(piece):
    began = time.time()
    html_text.main_text(piece * 20_000)
    assert time.time() - began < 8


def test_quotes_that_never_close():
    assert html_text.main_text('<p class="x>Hello</p>') == "Hello"
    assert html_text.main_text("<p title=it's>Hello</p><p>you</p>") == "Hello\nyou"
    assert html_text.main_text("a < b and 1<2 <i") == "a < b and 1<2 <i"
    assert html_text.main_text('<p title="a > b">x</p>') == "x"


# ---------------------------------------------------------------- quality


def verdicts(rows, prior=10.0, spread=3.0, sure=1.5):
    """op6's rule, plainly: exact quartiles in place of sketches."""
    facts = []
    for doc_id, text, lang, source in rows:
        n, chars, symbols, dup, repeat = base_counts(text)
        lines = sum(1 for x in (text or "").split("\n") if x.strip())
        upper, letters = sum("A" <= c <= "Z" for c in text or ""), sum(c.isascii() and c.isalpha() for c in text or "")
        counts = {"word_length": (chars, n, 1), "symbols": (symbols, n, 1), "dup_lines": (dup, lines, 1), "repeats": (repeat, n, 10), "upper": (upper, letters, 1)}
        facts.append((doc_id, lang, source, n < 10 or 100 * repeat > 20 * n, counts))

    def quartiles(name, pick):
        x = sorted(c[name][0] / max(c[name][1], 1) for _, lang, source, failed, c in facts if not failed and pick(lang, source))
        return (len(x), *[x[math.ceil(q * len(x) / 4) - 1] for q in (1, 2, 3)]) if x else None

    out = {}
    for doc_id, lang, source, failed, counts in facts:
        good = not failed
        for name, (k, n, unit) in counts.items() if good else ():
            whole, language, own = quartiles(name, lambda a, b: True), quartiles(name, lambda a, b: a == lang), quartiles(name, lambda a, b: (a, b) == (lang, source))
            language = [(language[0] * language[q] + prior * whole[q]) / (language[0] + prior) for q in (1, 2, 3)]
            q1, _, q3 = ((own[0] * own[q] + prior * language[q - 1]) / (own[0] + prior) for q in (1, 2, 3))
            events, n = k / unit, max(n, 1)
            low, high = max(events - sure * events**0.5, 0) * unit / n, (events + sure * events**0.5) * unit / n
            margin = 0.02 * max(abs(q3), abs(q1), 0.001)  # of the sketch
            over, under = low - (q3 + spread * (q3 - q1)), q1 - spread * (q3 - q1) - high
            if low and abs(over) < 7 * margin or name == "word_length" and abs(under) < 7 * margin:
                good = None  # the sketch's error may decide
                break
            good = good and (not low or over <= 0) and not (name == "word_length" and under > 0)
        out[doc_id] = good
    return out


def test_quality_verdict_against_brute_force(spark):
    rng, rows = random.Random(2), []
    for i in range(240):
        text = words(rng.randint(8, 150), i).split()
        source, lang = f"s{rng.randint(0, 3)}", rng.choice(("en", "de", None))
        rate = {"s0": 0.0, "s1": 0.05, "s2": 0.3, "s3": 0.0}[source] if rng.random() < 0.9 else 0.5
        text = [w + "#" if rng.random() < rate else w.upper() if rng.random() < 0.02 else w for w in text]
        if rng.random() < 0.2:
            text += ["\n"] + (text[:6] + ["\n"]) * rng.randint(1, 5)
        rows.append((i, " ".join(text), lang, source))
    rows += [(900, None, "en", "s0"), (901, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {r.doc_id: r.q_kept for r in quality.judged(df, "doc_id").collect()}
    want = verdicts(rows)
    sure = {k: v for k, v in want.items() if v is not None}
    assert len(sure) > 150 and 10 < sum(not v for v in sure.values())
    assert {k: got[k] for k in sure} == sure


def test_groups_have_verdicts_of_their_own(spark):
    """The same text: usual in one group, far out in another of the same language, for each rate."""
    rng = random.Random(3)
    mark = lambda t, k: " ".join(w + "#" * (i % k == 0) for i, w in enumerate(t.split()))
    loud = lambda t, k: " ".join(w.upper() if i % k == 0 else w for i, w in enumerate(t.split()))
    lines = lambda t, k: "\n".join(" ".join(t.split()[i : i + 4]) if i % k else "one line" for i in range(0, 96))
    for change in (mark, loud, lines):
        plain = [(i, words(100, i), "en", "plain") for i in range(120)]
        wide = [(1000 + i, change(words(100, 300 + i), rng.randint(3, 9)), "en", "wide") for i in range(120)]
        odd = change(words(100, 900), 4)
        df = spark.createDataFrame([*plain, *wide, (5000, odd, "en", "plain"), (5001, odd, "en", "wide")], "doc_id long, text string, lang string, source string")
        got = {r.doc_id: (r.q_failed, r.q_kept) for r in quality.judged(df, "doc_id").collect()}
        assert got[5000] == (False, False) and got[5001] == (False, True)


def test_quality_edges_and_clashes(spark):
    names = ["doc_id", "text", "lang", "source", "q_words", "q_kept", "q_lang", "rate", "bin", "n", "b", "_c0", "a.b"]
    rows = [(i, words(30, i), "en", "s", 1, True, "l", 2, 3, 4, 5, "c", "d") for i in range(12)] + [(99, None, None, None, 1, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, q_words int, q_kept boolean, q_lang string, rate int, bin int, n int, b int, _c0 string, `a.b` string")
    got = quality.accepted(df)
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(rows[:12])
    assert quality.accepted(df.where("false")).count() == 0
    assert quality.judged(df, "doc_id", "q_kept").columns[:2] == ["doc_id", "docs_q_kept"]
    twice = df.unionByName(df).select("doc_id", "text", "lang", "source")
    assert collections.Counter(r.doc_id for r in quality.accepted(twice).collect()) == {i: 2 for i in range(12)}
