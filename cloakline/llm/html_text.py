"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per text block, with blank lines where the
page's structure breaks: at dropped elements and at the edges of sections. The
distribution is the sum of text lengths over windows of `width` lines (length
of link text counts against a line). It surges where a window's sum passes the
threshold and dives where it falls to zero; the text between a surge and the
next dive is a region. The heavy regions tell the main container: the innermost
one that holds all their blocks, or, if that is a section with other sections of
regions beside it, the one around these. If it lies in an element that the page
marks as its article, that element is the main container. All its lines are the
main text, links and short ones too, and so are the heavy regions. Where heavy
regions lie all over the page, what it marks as articles is the main text if
this outweighs each region outside it, else all between the first surge and the
last dive.

Elements that never hold article text (scripts, navigation, forms) are dropped
while the markup is stripped. Blocks whose class, id or role as a whole says
advert, menu, sidebar, notice, comments and the like are dropped when the page is
known, unless they hold the page's article or most of its text. A paragraph, a
heading or the like is dropped for such a name only where it says advert.

Tags are found in one pass: a quote that never closes ends with its tag, and a
character after which no tag can end is text.

Defined results. Null or empty html: empty text. Unclosed elements end with
the element around them. Blocks nested in over 64 blocks of such names, or in over
64 articles, count to the 64th. Repeated rows are extracted each for itself. Columns
other than page_id, url and html are not read, so they can't clash.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_IN_TAG = re.compile(r"""[>]|=\s*["']""")
#: Elements whose content is no markup of the page, up to their end.
RAW = frozenset("script style noscript template textarea title svg iframe select".split())
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_HINT = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

#: Elements that hold no article text.
DROPPED = frozenset("head nav footer aside form button input label fieldset menu dialog figure video audio map option".split()) - {"figure"}
#: Elements that end a block.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements at whose edges the page's structure breaks.
SECTIONS = frozenset("article section main aside nav footer header body".split())
#: Elements that hold blocks of one part of a page.
CONTAINERS = frozenset("article section main div td center blockquote".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that mark what isn't article text.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle banner sponsor sponsored promo promotion promoted menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar aside footer masthead comment comments disqus respond reply replies cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget pagination pager "
    "toolbar skip copyright legal disclaimer contentinfo complementary search discussion feedback paywall toc".split()
)
#: A class that names the article is no hint, whatever else it says.
_OWN = frozenset("article content main body story post entry text".split())


#: Words beside a hint that leave a name a hint as a whole; a name with others ("has-sidebar") says something else.
_BESIDE = frozenset(
    "box boxes bar block blocks button buttons link links list lists item items icon icons section area unit units slot slots form top bottom left right "
    "side site page post posts article articles entry story stories content body text main header head title inner panel card cards primary secondary sticky google x js".split()
)


#: Blocks of running text, and the hints that drop them too.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption tr".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion promoted".split())
DEEPEST = 64


def _hinted(tag: str, attributes: str) -> bool:
    if not attributes or tag in ("html", "body", "main"):
        return False
    hints = ADVERTS if tag in RUNNING else HINTS
    for m in _HINT.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in _WORDS.findall(name)]
            if any(w in hints for w in words) and all(w in hints or w in _BESIDE or w.isdigit() for w in words) and not (words[-1] in _OWN and words[0] not in hints):
                return True
    return False


def tokens(page: str):
    """(start, end, closing, tag, attributes, text) of all markup, in one pass; text is that of a CDATA section."""
    n, at, never = len(page), 0, set()  # never: what doesn't occur in the rest of the page

    def find(what: str, start: int) -> int:
        if what in never:
            return -1
        i = page.find(what, start)
        if i < 0:
            never.add(what)
        return i

    while (m := _OPEN.search(page, at)) is not None:
        start, tag = m.start(), m[2]
        if tag is None:
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
            # an open comment or section ends with the page, a declaration with its tag
            end = find(close, m.end() if close != "-->" else start + 2)
            stop = n if end < 0 else end + len(close)
            yield start, stop, False, None, "", page[m.end() : end if end >= 0 else n] if close == "]]>" else ""
            at = stop
            continue
        end = -1
        if (first := find(">", m.end())) >= 0:
            here = m.end()
            while (x := _IN_TAG.search(page, here)) is not None:
                if x[0] == ">":
                    end = x.start()
                    break
                here = find(x[0][-1], x.end()) + 1
                if not here:  # the quote never closes: the tag ends as if there were none
                    end = first
                    break
        if end < 0 and first < 0:
            at = m.end()  # no tag
            continue
        if end < 0:
            end = first
        tag, attributes, at = tag.lower(), page[m.end() : end], end + 1
        if tag in RAW and not m[1] and not attributes.endswith("/"):
            close = None if tag in never else _RAW_END[tag].search(page, at)
            if close is None:
                never.add(tag)
            at = close.end() if close else n
            yield start, at, False, None, "", ""
            continue
        yield start, at, bool(m[1]), tag, attributes, ""


def _dropped_hints(hints: list[tuple], weights: list[int], within: list[tuple], articles: list[tuple]) -> set[int]:
    """The hinted blocks to drop, outer ones first. hints: the hinted blocks around each; within, articles: those
    around each line. One stays if it, or an article in it, outweighs all text outside it, and articles outside
    the hinted blocks have next to no text."""
    drop: set[int] = set()
    lines: list[list[int]] = [[] for _ in hints]
    for i, around in enumerate(within):
        if weights[i]:
            for h in around:
                lines[h].append(i)
    total = sum(weights)  # of what is not dropped
    for h, around in enumerate(hints):
        if drop.intersection(around):
            drop.add(h)
            continue
        here, inner = sum(weights[i] for i in lines[h]), {}
        for i in lines[h]:
            for a, over in articles[i]:
                if h in over:
                    inner[a] = inner.get(a, 0) + weights[i]
        rest, core = total - here, max(inner.values(), default=0)
        if here > rest or core >= rest and core:
            free = sum(w for w, own, arts in zip(weights, within, articles, strict=True) if w and h not in own and not drop.intersection(own) and any(set(over) <= set(around) for _, over in arts))
            if 10 * free < here:
                continue
        drop.add(h)
        total = rest
    return drop


def lines_of(page: str) -> tuple[list[str], list[int], list[int], list[tuple[int, bool, str]]]:
    """Lines (empty: a break), characters of link text in each, and the number of the container each stands in (0:
    none but the body; a break: -1); then of each container the one around it, whether it is a section, and the name of
    its element if that marks an article."""
    lines, links, homes = [], [], []
    block, linked = [], 0
    stack: list[tuple[str, bool, bool, bool]] = []  # element, whether it is dropped, hinted, an article
    blocks: list[int] = []  # places in the stack of the elements that are blocks
    opens: dict[str, int] = {}
    hints: list[tuple] = []  # the hinted blocks around each hinted block
    in_hints: tuple = ()
    hints_of, articles_of, in_articles, n_articles = [], [], (), 0
    within = [0]  # numbers of the open containers
    containers = [(0, False, "")]
    opened = dropped = in_link = in_article = 0

    def end(breaks: int = 0):
        nonlocal linked
        if block:
            text = " ".join(entities.unescape("".join(block)).split())
            if text:
                lines.append(text)
                links.append(min(linked, len(text)))
                homes.append(within[-1])
                hints_of.append(in_hints)
                articles_of.append(in_articles)
            block.clear()
        linked = 0
        for _ in range(breaks):
            lines.append("")
            links.append(0)
            homes.append(-1)
            hints_of.append(in_hints)
            articles_of.append(in_articles)

    def pop():
        nonlocal dropped, in_link, in_article, in_hints, in_articles
        tag, drop, hint, article = stack.pop()
        opens[tag] -= 1
        if blocks and blocks[-1] == len(stack):
            blocks.pop()
        if drop:
            dropped -= 1
        elif not dropped:
            if tag in BLOCKS:
                end(3 if tag in SECTIONS else 0)
        if article:
            in_article -= 1
            if len(in_articles) > in_article:
                in_articles = in_articles[:-1]
        if hint:
            in_hints = in_hints[:-1]
        if tag in CONTAINERS:
            within.pop()
        if tag == "a":
            in_link -= 1

    at = 0
    for start, stop, closing, tag, attributes, text in tokens(page):
        if start > at and not dropped:
            piece = page[at:start]
            block.append(piece)
            if in_link:
                linked += len(piece.strip())
        at = stop
        if tag is None:
            if text and not dropped:
                block.append(entities.escape(text))
            continue
        if closing:
            if opens.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag == "p" and not dropped:
                end()
            continue
        if tag in VOID:
            if not dropped:
                if tag == "hr":
                    end()
                elif tag == "br":
                    block.append(" ")
            continue
        if tag in BLOCKS and blocks:  # an open paragraph ends with the next block, and with it the phrases in it
            last = stack[blocks[-1]][0]
            if last == "p" or last == tag and tag in ("li", "dt", "dd", "tr", "td", "th"):
                for _ in range(len(stack) - blocks[-1]):
                    pop()
        drop = hint = article = False
        if not dropped:
            hint = _hinted(tag, attributes)
            drop = tag in DROPPED or tag == "header" and not in_article or bool(_HIDDEN.search(attributes) and tag not in ("html", "body", "article", "main")) or hint and tag not in BLOCKS
            hint = hint and not drop
            if drop:
                if tag in BLOCKS:
                    end(3)
            elif tag in BLOCKS:
                end(3 if tag in SECTIONS or hint else 0)
                article = tag in ("article", "main") and not hint
                if hint and (hint := len(in_hints) < DEEPEST):
                    hints.append(in_hints)
                    in_hints = (*in_hints, len(hints) - 1)
                if article:
                    in_article += 1
                    if in_article <= DEEPEST:
                        n_articles += 1
                        in_articles = (*in_articles, (n_articles, in_hints))
        if attributes.endswith("/") and tag not in BLOCKS:
            continue
        if drop:
            dropped += 1
        if tag in CONTAINERS:
            opened += 1
            containers.append((within[-1], tag == "section", tag if article else ""))
            within.append(opened)
        if tag == "a":
            in_link += 1
        if tag in BLOCKS:
            blocks.append(len(stack))
        opens[tag] = opens.get(tag, 0) + 1
        stack.append((tag, drop, hint, article))
    if at < len(page) and not dropped:
        block.append(page[at:])
    while stack:
        pop()
    end()
    if hints:
        weights = [max(len(t) - 2 * k, 0) for t, k in zip(lines, links, strict=True)]
        gone = _dropped_hints(hints, weights, hints_of, articles_of)
        left = [i for i, around in enumerate(hints_of) if not gone.intersection(around)]
        lines, links, homes = ([x[i] for i in left] for x in (lines, links, homes))
    return lines, links, homes, containers


def regions(weights: np.ndarray, width: int = 3, threshold: int = 40) -> list[tuple[int, int]]:
    """The distribution's regions: from each line whose window surges to the next window that is empty. If nothing
    surges, the heaviest window."""
    if not weights.any():
        return []
    sums = np.convolve(weights, np.ones(width, np.int64))[width - 1 :]  # of the lines from here on
    found, start = [], None
    for i, s in enumerate(sums.tolist()):
        if start is None and weights[i] and s > threshold:
            start = i
        elif start is not None and not s:
            found.append((start, i))
            start = None
    if start is not None:
        found.append((start, len(weights)))
    best = int(np.argmax(sums))
    return found or [(best, min(best + width, len(weights)))]


def main_text(page: str | None, width: int = 3, threshold: int = 40, share: float = 0.25) -> str:
    """The main text of a page: its blocks, joined by line ends."""
    if not page:
        return ""
    lines, links, homes, containers = lines_of(page)
    weights = np.array([max(len(t) - 2 * k, 0) for t, k in zip(lines, links, strict=True)], np.int64)
    if not weights.any():  # nothing but links
        weights = np.array([len(t) for t in lines], np.int64)
    found = regions(weights, width, threshold)
    if not found:
        return ""
    homes = np.array(homes)
    around = np.array([c[0] for c in containers])
    marked = np.zeros(len(containers), bool)  # what lies in a marked article
    for c, (home, _, name) in enumerate(containers):
        marked[c] = bool(name) or marked[home]
    heavy = [int(weights[a:b].sum()) for a, b in found]
    keep, surging = np.zeros(len(lines), bool), np.zeros(len(lines), bool)
    least = share * max(heavy)
    for (a, b), h in zip(found, heavy, strict=True):
        surging[a:b] = True
        keep[a:b] = h >= least
    placed = homes >= 0
    by = lambda pick: np.bincount(homes[placed & pick], weights=weights[placed & pick], minlength=len(containers))
    of_heavy, of_surging = by(keep), by(surging)
    main = _innermost(of_heavy > min(threshold, of_heavy.max() - 1), containers)
    main = _with_chapters(main, of_surging > threshold, containers)
    own = [c for c in _upwards(main, containers) if containers[c][2]]
    articles = [c for c in own if containers[c][2] == "article"]
    if own:
        main = articles[-1] if articles else own[0]
    else:
        in_marked = np.append(marked, False)[homes] & placed  # breaks are at -1
        outside = max((int(weights[a:b][~in_marked[a:b]].sum()) for a, b in found), default=0)
        if any(t and i for t, i in zip(lines, in_marked, strict=True)) and int(weights[in_marked].sum()) >= outside:
            return "\n".join(t for t, i in zip(lines, in_marked, strict=True) if i and t)
    if not main:  # the body itself holds the heavy regions: what lies between the first surge and the last dive
        first, last = np.flatnonzero(keep)[[0, -1]]
        return "\n".join(t for t in lines[first : last + 1] if t)
    under = np.zeros(len(containers) + 1, bool)  # the last is that of breaks
    under[main] = True
    for c in range(main + 1, len(containers)):  # numbered as they open, so the one around comes first
        under[c] = under[around[c]]
    keep |= under[homes]
    return "\n".join(t for t, k in zip(lines, keep, strict=True) if k and t)


def _upwards(c: int, containers: list) -> list[int]:
    """c and the containers around it, but the body."""
    out = []
    while c:
        out.append(c)
        c = containers[c][0]
    return out


def _innermost(some: np.ndarray, containers: list) -> int:
    """The innermost container that is or holds all of some."""
    held = some.astype(np.int64).tolist()
    for c in range(len(containers) - 1, 0, -1):
        held[containers[c][0]] += held[c]
    return max(c for c, n in enumerate(held) if n == held[0])


def _with_chapters(main: int, surging: np.ndarray, containers: list) -> int:
    """The container around main, if main is a section with other sections beside it in which text surges; and so on."""
    has, chapters = surging.tolist(), [0] * len(containers)
    for c in range(len(containers) - 1, 0, -1):
        home = containers[c][0]
        has[home] = has[home] or has[c]
        chapters[home] += containers[c][1] and has[c]
    while containers[main][1] and chapters[containers[main][0]] > has[main]:
        main = containers[main][0]
    return main


def extracted(pages: DataFrame, width: int = 3, threshold: int = 40, share: float = 0.25) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [main_text(x.as_py(), width, threshold, share) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.col("html")))
