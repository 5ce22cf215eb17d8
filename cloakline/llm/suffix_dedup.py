"""Removal of repeated byte strings with a run-compressed Burrows-Wheeler index.

Every window of `width` bytes has an anchor: the leftmost of its `gram`-byte
grams with the smallest hash. Equal windows have equal anchors at equal places,
so all windows whose anchor is one gram of a document form one context, and
only contexts of the same anchor gram can hold equal windows.

1. Anchors. Each document's contexts (anchor hash, hash of the context, place)
   go to the home of the anchor. Equal contexts of different places are repeated
   in whole; anchors of one context drop out. Of the others, each different
   context goes on, once.
2. Index. The contexts of a shard's anchors are laid end to end with separators
   of their own and sorted into a suffix array; of its Burrows-Wheeler transform
   the runs are kept, with samples at both ends of each: the suffix's place and
   its match with the neighbour outside the run. Arrays as long as the text are
   needed to build this index, not to use it. Matching statistics are then
   streamed from sample to sample; places that match for `width` bytes or more
   start a repeated window.
3. Marking. The windows' bytes are merged per document and removed.

Anchors that make up more than about a thousandth of all contexts (common
passages, whose surroundings differ from document to document) don't go to one
shard: their windows are hashed one by one and counted by hash. A batch of
documents settles what repeats within it and sends one exemplar on, so that
what a home gets of one string is bounded by the number of batches. Equal texts
are one text with a count.

Defined results. Null text: as empty, nothing removed. Texts shorter than a
window: nothing removed. Repeated rows are texts that occur elsewhere. Null
doc_id: kept as null. Empty table: no rows. Only doc_id and text are read;
further columns are carried along by name, those named like a result with docs_
before their names.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakline.llm.common import arrow_bytes, column, dropped, pieces, result_names, written
from cloakline.llm.textops import BYTE, mix, span_hash, sums


def contexts(data: np.ndarray, offsets: np.ndarray, width: int, gram: int):
    """Of each context: document, first window, last window, anchor hash and the prefix sums for further hashes."""
    prefix = sums(BYTE[data])
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < width:
        return none, none, none, np.zeros(0, np.uint64), prefix
    at = np.arange(n - gram + 1)
    hashes = span_hash(prefix, at, at + gram)
    bits = np.uint64((1 << max(1, n.bit_length())) - 1)
    low = (hashes & ~bits) | at.astype(np.uint64)
    size, span = 1, width - gram + 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if span > size:
        low = np.minimum(low[: -(span - size)], low[span - size :])
    anchor = (low & bits).astype(np.int64)
    whole = np.zeros(n + 1, np.int64)  # windows within a document
    long = np.diff(offsets) >= width
    np.add.at(whole, offsets[:-1][long], 1)
    np.add.at(whole, offsets[1:][long] - width + 1, -1)
    whole = np.cumsum(whole)[: len(anchor)] > 0
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(anchor)) - 1
    first, last = first[whole[first]], last[whole[first]]
    return np.searchsorted(offsets, first, "right") - 1, first, last, hashes[anchor[first]], prefix


def _texts(batches):
    """Batches of different texts: keys, bytes and offsets. Equal texts of a batch are one."""
    for batch in batches:
        data, offsets = arrow_bytes(batch.column(1))
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b in pieces(offsets):
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            first = np.zeros(b - a, bool)
            first[np.unique(keys[a:b], return_index=True)[1]] = True
            yield keys[a:b], part, at, first


def _same(*columns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, starts of the groups of equal rows in it, and each group's size."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    starts = np.flatnonzero(new)
    return order, starts, np.diff(np.append(starts, len(order)))


def _frequent(batches, width: int, gram: int, least: int):
    """(anchor, contexts) of the anchors with `least` different contexts in a batch, and (null, 1) for the batch."""
    for _, data, offsets, first in _texts(batches):
        doc, lo, hi, anchor, prefix = contexts(data, offsets, width, gram)
        keep = first[doc]
        code = span_hash(prefix, lo[keep], hi[keep] + width)
        pairs = np.unique(np.stack([anchor[keep], code]), axis=1) if keep.any() else np.zeros((2, 0), np.uint64)
        which, count = np.unique(pairs[0], return_counts=True)
        which, count = which[count >= least].view(np.int64), count[count >= least]
        yield pa.RecordBatch.from_arrays([pa.array([None, *which.tolist()], pa.int64()), pa.array([1, *count.tolist()], pa.int64())], ["anchor", "n"])


_ASK = "home int, kind int, anchor binary, key binary, start binary, size binary, code binary, many binary"
_MARK = "key long, kind int, starts binary, sizes binary, anchors binary"


def _marks(key, start, size, kind=0, anchors=None) -> list[tuple]:
    """Rows (key, kind, starts, sizes, anchors) with the places of each key together."""
    order = np.argsort(key, kind="stable")
    key, start, size = key[order], start[order].astype(np.int64), size[order].astype(np.int64)
    cut = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)) if len(key) else np.zeros(1, np.int64)
    anchors = anchors[order] if anchors is not None else np.zeros(len(key), np.uint64)
    return [(int(key[a]), kind, start[a:b].tobytes(), size[a:b].tobytes(), anchors[a:b].tobytes() if kind else b"") for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _ask(batches, width: int, gram: int, homes: int, common: np.ndarray):
    """Rows for the homes; kind 0 contexts, 1 windows of common anchors, 2 what the batch settled itself."""
    for keys, data, offsets, first in _texts(batches):
        doc, lo, hi, anchor, prefix = contexts(data, offsets, width, gram)
        keep = first[doc]
        doc, lo, hi, anchor = doc[keep], lo[keep], hi[keep], anchor[keep]
        often = np.isin(anchor, common)
        rows = []
        for kind in (0, 1):
            pick = np.flatnonzero(often) if kind else np.flatnonzero(~often)
            d, a, b, g = doc[pick], lo[pick], hi[pick], anchor[pick]
            if kind:  # a context becomes its windows
                n = b - a + 1
                total = np.cumsum(n)
                a = np.repeat(a - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)
                d, b = np.repeat(d, n), a
                g = span_hash(prefix, a, a + width)
            if not len(a):
                continue
            code = span_hash(prefix, a, b + width)
            order, starts, count = _same(g, code)
            twice = np.repeat(count > 1, count)
            settled = order[twice]
            if len(settled):
                own = int(mix(np.array([keys[d[settled[0]]]]).view(np.uint64))[0] % np.uint64(homes))
                at = settled
                rows.append((own, 2, b"", keys[d[at]].tobytes(), (a - offsets[d])[at].astype(np.int64).tobytes(), (b - a + width)[at].astype(np.int64).tobytes(), b"", b""))
            sent, many = order[starts], (count > 1).astype(np.uint8)
            home = ((g[sent] >> np.uint64(32)) % np.uint64(homes)).astype(np.uint16 if homes < 65536 else np.int64)
            by = np.argsort(home, kind="stable")
            sent, many, home = sent[by], many[by], home[by]
            at = np.searchsorted(home, np.arange(homes + 1))
            columns = (g[sent], keys[d[sent]], (a - offsets[d])[sent].astype(np.uint32), (b - a + width)[sent].astype(np.uint16), code[sent], many)
            for x in np.unique(home).astype(int):
                s = slice(at[x], at[x + 1])
                cut = [c[s].tobytes() for c in columns]
                if kind:  # a window's code is its anchor, its size known
                    cut[3] = cut[4] = b""
                rows.append((x, kind, *cut))
        if rows:
            kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["home", "kind", "anchor", "key", "start", "size", "code", "many"])


def _joined(table, name, dtype):
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)


def _settle(table: pa.Table, width: int) -> pa.Table:
    """At a home: places whose whole context is repeated (kind 0), and contexts to compare (kind 1)."""
    kind = table.column("kind").to_numpy()
    rows = []
    done = table.filter(pa.array(kind == 2))
    if done.num_rows:
        rows += _marks(_joined(done, "key", np.int64), _joined(done, "start", np.int64), _joined(done, "size", np.int64))
    for k in (0, 1):
        part = table.filter(pa.array(kind == k))
        if not part.num_rows:
            continue
        anchor, key, start, many = _joined(part, "anchor", np.uint64), _joined(part, "key", np.int64), _joined(part, "start", np.uint32), _joined(part, "many", np.uint8)
        size = np.full(len(key), width, np.uint16) if k else _joined(part, "size", np.uint16)
        code = anchor if k else _joined(part, "code", np.uint64)
        # equal texts of different batches are one place
        order, starts, count = _same(anchor, code, key, start)
        weight = np.maximum.reduceat(many[order].astype(np.int64), starts) + 1 if len(starts) else np.zeros(0, np.int64)
        one = order[starts]
        anchor, key, start, size, code = anchor[one], key[one], start[one], size[one], code[one]
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (code[1:] != code[:-1])) if len(one) else np.zeros(0, bool)
        group = np.flatnonzero(new)
        total = np.add.reduceat(weight, group) if len(group) else weight
        length = np.diff(np.append(group, len(one)))
        twice = np.repeat(total > 1, length)
        rows += _marks(key[twice], start[twice], size[twice])
        if not k and len(one):  # one of each different context, where its anchor has others
            lead = np.append(True, anchor[group][1:] != anchor[group][:-1])
            others = np.diff(np.append(np.flatnonzero(lead), len(group)))
            go = group[np.repeat(others > 1, others)]
            rows += _marks(key[go], start[go], size[go], 1, anchor[go])
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "kind", "starts", "sizes", "anchors"])


def suffix_array(data: np.ndarray, part: np.ndarray, left: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes, and the ranks by their first `keep` bytes.

    data ends each part with a separator; separators differ and are below all
    bytes, in the order of the parts. left is the distance to the separator.
    Ranks are doubled in length, and only suffixes that still share a rank are
    sorted again. keep is seven times a power of two.
    """
    n, h = len(data), 7
    key = np.zeros(n, np.int64)
    for i in range(h):
        key <<= 9
        live = left >= i
        shifted = np.zeros(n, np.int64)
        shifted[: n - i] = data[i:]
        key |= np.where(live, shifted, 0)
    order = np.argsort(key)
    rank = np.zeros(n, np.int64)
    new = np.append(True, key[order][1:] != key[order][:-1])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    size = np.diff(np.append(np.flatnonzero(new), n))
    active = order[np.repeat(size > 1, size)]
    kept = None
    while len(active) or kept is None:
        if h >= keep and kept is None:
            kept = rank.copy()
            if not len(active):
                break
        if len(active):
            # within the window of h: a separator was passed, and parts decide
            second = np.where(left[active] < h, part[active] - n, rank[np.minimum(active + h, n - 1)])
            by = np.lexsort((second, rank[active]))
            a, s = active[by], second[by]
            r = rank[a]
            head = np.append(True, r[1:] != r[:-1])
            begin = np.flatnonzero(head)
            inside = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a))))
            new = head | np.append(True, s[1:] != s[:-1])
            rank[a] = np.maximum.accumulate(np.where(new, r + inside, 0))
            size = np.diff(np.append(np.flatnonzero(new), len(a)))
            active = a[np.repeat(size > 1, size)]
        h *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes, kept


class RunIndex(NamedTuple):
    """A run-compressed transform of texts, and samples at the ends of its runs.

    heads and lengths are the runs' bytes (-1 where a text begins) and their
    lengths. samples are two pairs, for run starts and run ends: the places of
    the suffixes in text order, and how long each matches its neighbour outside
    the run (0 below the width). ends are the texts' ends, with a separator
    behind each text. All but ends grow with the runs, not with the texts.
    """

    heads: np.ndarray
    lengths: np.ndarray
    samples: tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    ends: np.ndarray
    width: int


def run_index(texts: list[bytes], width: int) -> RunIndex:
    size = np.array([len(t) for t in texts], np.int64)
    n = int(size.sum()) + len(texts)
    ends = np.cumsum(size + 1) - 1  # the separators
    data = np.zeros(n, np.int64)
    plain = np.ones(n, bool)
    plain[ends] = False
    data[plain] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    part = np.repeat(np.arange(len(texts)), size + 1)
    left = ends[part] - np.arange(n)
    keep = 7
    while keep * 2 <= width:
        keep *= 2
    order, rank = suffix_array(data, part, left, keep)
    # the transform and its runs; separators differ, so each is a run
    before = order - 1
    char = np.where((before >= 0) & plain[before], data[before] - 1, -1).astype(np.int16)
    border = np.append(True, (char[1:] != char[:-1]) | (char[1:] < 0))[:n]
    begin = np.flatnonzero(border)
    lengths = np.diff(np.append(begin, n))
    step = width - keep
    samples = []
    for at_run, other in ((begin, -1), (begin + lengths - 1, 1)):
        places, matches = order[at_run], np.zeros(len(at_run), np.int64)
        ok = np.flatnonzero((at_run + other >= 0) & (at_run + other < n))
        at, to = places[ok], order[at_run[ok] + other]
        same = (left[at] >= width) & (left[to] >= width)
        ok, at, to = ok[same], at[same], to[same]
        same = (rank[at] == rank[to]) & (rank[at + step] == rank[to + step])
        ok, at, to = ok[same], at[same], to[same]
        length = np.full(len(at), width)
        live = np.arange(len(at))
        while len(live):  # the whole length of the sampled matches
            x, y = at[live] + length[live], to[live] + length[live]
            live = live[plain[x] & plain[y] & (data[x] == data[y])]
            length[live] += 1
        matches[ok] = length
        by = np.argsort(places)
        samples.append((places[by], matches[by]))
    return RunIndex(char[begin], lengths, tuple(samples), ends, width)


def repeated(index: RunIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and size of the byte runs covered by strings of the index's width that start elsewhere too.

    Matching statistics are streamed from sample to sample in the order of the
    texts: from a sampled place on, the match with the neighbour is one shorter
    with each byte until the next sample, so a sample decides on all places up
    to the next one. Runs of one text may overlap.
    """
    ends, found = index.ends, []
    for places, matches in index.samples:
        count = np.minimum(matches - index.width + 1, np.diff(np.append(places, ends[-1:] + 1)))
        live = count > 0
        found.append((places[live], count[live] - 1 + index.width))
    start, size = (np.concatenate(x) for x in zip(*found, strict=True))
    which = np.searchsorted(ends, start)
    begins = np.append(0, ends[:-1] + 1)[: len(ends)]
    return which, start - begins[which], size


def _indexed(table: pa.Table, width: int) -> pa.Table:
    key, start = table.column("key").to_numpy(), table.column("start").to_numpy()
    which, local, size = repeated(run_index(table.column("context").to_pylist(), width))
    rows = _marks(key[which], start[which] + local, size)
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], ["key", "starts", "sizes"])


def _cut_out(batches, shards: int):
    """Contexts, by shard, of rows (key, text, starts, sizes, anchors)."""
    for batch in batches:
        rows = []
        for key, text, starts, sizes, anchors in zip(*[batch.column(i) for i in range(5)], strict=True):
            data = text.as_py().encode("utf-8", "surrogateescape") if pa.types.is_string(text.type) else text.as_py()
            a, n, g = (np.frombuffer(b"".join(x.as_py()), t) for x, t in ((starts, np.int64), (sizes, np.int64), (anchors, np.uint64)))
            for x, y, z in zip(a.tolist(), n.tolist(), g.tolist(), strict=True):
                rows.append(((z >> 20) % shards, key.as_py(), x, data[x : x + y]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["shard", "key", "start", "context"])


def merged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs (start, end) of intervals."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate(starts[order] + sizes[order])
    new = np.append(True, a[1:] > b[:-1]) if len(a) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return a[at], b[np.append(at[1:], len(a)) - 1] if len(a) else a


def _removed(batches, with_text: bool):
    """(key, n_removed, n_spans, kept_sha256, kept) of rows (key, text as bytes, lists of starts and of sizes)."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for key, text, starts, sizes in zip(*[batch.column(i) for i in range(4)], strict=True):
            data = text.as_py()
            a, b = merged(*(np.frombuffer(b"".join(x.as_py()), np.int64) for x in (starts, sizes)))
            edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(data)]
            kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
            clean = None
            if with_text:  # a character goes if all its bytes go
                inside = lambda p: p < len(data) and data[p] & 0xC0 == 0x80
                clean, last = [], 0
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    while inside(x):
                        x += 1
                    while y > x and inside(y):
                        y -= 1
                    clean.append(data[last:x])
                    last = max(y, x)
                clean = b"".join([*clean, data[last:]]).decode("utf-8", "replace")
            for c, v in zip(out, (key.as_py(), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), clean), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["key", "n_removed", "n_spans", "kept_sha256", "kept"])


RESULTS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def _keyed(docs: DataFrame, text, aside: list, hashed) -> tuple:
    """The texts' key, the table of documents with it, and each key's first document and number of documents.

    Where different texts share a hash, their keys are drawn again from their
    digests until no two do. Of n texts about n * n / 2**65 hashes are shared
    (3 of 10**10), which bounds what is collected.
    """
    shared, turn = [], 0
    sha = F.sha2(text.cast("binary"), 256)
    while True:
        key = F.when(hashed(text).isin(shared), F.xxhash64(sha, F.lit(turn))).otherwise(hashed(text)) if shared else hashed(text)
        slim = docs.select("doc_id", *aside, key.alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), sha.alias("sha"))
        slim = written(slim, "texts")
        first = F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("first")
        copies = written(slim.groupBy("key").agg(first, F.count("*").alias("copies"), (F.min("sha") != F.max("sha")).alias("shared")), "copies")
        clashes = [r["key"] for r in copies.where("shared").select("key").collect()]
        if not clashes:
            return key, slim, copies.drop("shared")
        shared, turn = shared + clashes, turn + 1
        dropped(slim), dropped(copies)


def deduplicated(docs: DataFrame, *carried: str, width: int = 200, gram: int = 64, with_text: bool = False, home_bytes: int = 8 << 20, shard_bytes: int = 1 << 20, hashed=F.xxhash64) -> DataFrame:
    """doc_id, the carried columns, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the text, with_text).

    Removed is each byte of a string of `width` bytes that also starts
    elsewhere in the texts; what remains is hashed. In kept, a character goes
    only if all its bytes go. (With with_text, text itself is read once more.)
    hashed makes a text's key; texts that share one get others.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    aside = [column(c).alias(f"_carried{i}") for i, c in enumerate(carried)]  # names that can't clash
    key, slim, copies = _keyed(docs, text, aside, hashed)
    known = docs.select(key.alias("key"), text.cast("binary").alias("text"))
    total = slim.agg(F.sum("n_bytes").alias("b")).first()["b"] or 0
    homes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // home_bytes))

    counts = known.mapInArrow(lambda x: _frequent(x, width, gram, 8), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    counts = written(counts, "anchors")
    batches = counts.where("anchor is null").agg(F.sum("n").alias("n")).first()["n"] or 1
    # at most a batch's contexts over 12 of these, whatever the size of the table
    common = np.array(sorted(r["anchor"] for r in counts.where(F.col("anchor").isNotNull() & (F.col("n") >= 12 * batches)).select("anchor").collect()), np.int64).view(np.uint64)

    asked = known.mapInArrow(lambda x: _ask(x, width, gram, homes, common), _ASK)
    told = written(asked.groupBy("home").applyInArrow(lambda t: _settle(t, width), _MARK), "told")
    # the text of each key once: of the first of its documents
    lists = told.groupBy("key").agg(*[F.collect_list(F.when(F.col("kind") == 1, F.col(c))).alias(c) for c in ("starts", "sizes", "anchors")])
    wanted = lists.join(copies.select("key", "first"), "key")
    own = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("first"), key.alias("key"), text.cast("binary").alias("text"))
    held = written(own.join(wanted, ["key", "first"]).select("key", "text", "starts", "sizes", "anchors"), "held")
    todo = held.where(F.size("starts") > 0)
    size = todo.select(F.sum(F.aggregate("starts", F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x) * 40)).alias("b")).first()["b"] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    cut = todo.mapInArrow(lambda x: _cut_out(x, shards), "shard int, key long, start long, context binary")
    found = cut.groupBy("shard").applyInArrow(lambda t: _indexed(t, width), "key long, starts binary, sizes binary")
    marks = told.where("kind = 0").select("key", "starts", "sizes").unionByName(found).groupBy("key").agg(F.collect_list("starts").alias("starts"), F.collect_list("sizes").alias("sizes"))
    done = held.select("key", "text").join(marks, "key").select("key", "text", "starts", "sizes")
    done = done.mapInArrow(lambda x: _removed(x, with_text), "key long, n_removed long, n_spans long, kept_sha256 string, kept string")
    facts = done.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256", "kept")])
    facts = written(copies.where("copies > 1").select("key", "copies").join(facts, "key", "full"), "facts")
    for table in (told, held):  # all that was made from them is written
        dropped(table)

    # equal texts: each window of one is in the other
    if with_text:
        slim = docs.select("doc_id", *aside, text.alias("text"), key.alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha"))
    rows = slim.join(facts, "key", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= width)
    gone = F.coalesce(gone, F.lit(False))
    return rows.select(
        "doc_id", *[F.col(f"_carried{i}").alias(c) for i, c in enumerate(result_names(carried, RESULTS))], "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *([F.when(gone, F.lit("")).otherwise(F.coalesce("kept", "text")).alias("kept")] if with_text else []),
    )


def op8(spark, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
