"""Exact Jaccard join on word shingles by token-combination prefixes.

1. Sharing. Each document's distinct shingles are hashed to 64-bit tokens, and
   batches of documents send their tokens to home partitions, each token of a
   batch once. A home counts how many documents hold a token and tells the
   batches which tokens are shared, with the logarithm of that count, the
   token's class. A document with fewer shared tokens than the join asks of its
   set can have no partner and goes no further. Documents of equal sets are one
   node from here on.
2. Index. A node's shared tokens are ordered by class and token, rare first. Of
   two linked sets the first common tokens lie in the prefixes of both. Rare
   tokens of the prefix are index keys. For frequent classes the prefix is
   extended by one token and the keys are the combinations of two tokens; sets
   over `combine` tokens use single tokens there as well, those near the limit
   both. Nodes that share a key and whose sizes allow a link are in one block.
3. Verification. All pairs of a block are compared exactly, as overlaps of
   token sets. Blocks too large for a task are cut into tiles: tiles are
   compared within, then some members of each tile's components between tiles,
   and in the end every node outside a block's largest component with all nodes
   of the block. Pairs left out are of one component already, so no link
   between different components is lost, and nothing is capped.

Defined results. Null or blank text: empty set, linked with nothing, its own
component. Fewer words than a shingle: the whole sequence is one shingle. Rows
that repeat a doc_id are documents of their own. Null doc_id: linked like
others; a component's id is null only if all its doc_ids are. Empty table: no
rows. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakline.llm.common import arrow_bytes, dropped, pieces, written
from cloakline.llm.components import components, forest, roots
from cloakline.llm.textops import Words, mix, shingles

LOW = np.uint64((1 << 48) - 1)
_ROW = "home int, batch long, kind int, a binary, b binary, c binary, d binary, e binary"
_NAMES = ["home", "batch", "kind", "a", "b", "c", "d", "e"]
NO_ID = (1 << 63) - 1


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)


def token_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts end to end, sorted within each, and their bounds."""
    n = len(offsets) - 1
    words = Words(data, offsets, lower=True)
    h, doc = shingles(words, k)
    bounds = np.searchsorted(doc, np.arange(n + 1))
    count = np.diff(words.first)
    sets = []
    for i in range(n):
        s = h[bounds[i] : bounds[i + 1]]
        if len(s) > 1:
            s = np.sort(s)
            s = s[np.append(True, s[1:] != s[:-1])]
        elif not len(s) and count[i]:
            w = words.hash[words.first[i] : words.first[i + 1]]
            s = _short(w)
        sets.append(s)
    return (np.concatenate(sets) if sets else h), np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int64)


def _short(w: np.ndarray) -> np.ndarray:
    """One token for a text of fewer words than a shingle."""
    h = np.uint64(len(w)) * np.ones(1, np.uint64)
    for x in w:
        h = mix(h + x)
    return h


def _compact(low: np.ndarray, home: np.ndarray) -> np.ndarray:
    return mix(low + mix(home.astype(np.uint64) + np.uint64(1)))


def _ask(batches, k: int, homes: int):
    """Tokens of each batch of documents for their homes, and what goes back to the batch."""
    part, number = TaskContext.get().partitionId(), 0
    for arrow in batches:
        data, offsets = arrow_bytes(arrow.column(1))
        ids = arrow.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        for a, b in pieces(offsets, 2 << 20):
            for lo in range(a, b, 60_000):
                hi = min(lo + 60_000, b)
                yield _table(_asked(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ids[lo:hi], (part << 32) + number, k, homes))
                number += 1


def _asked(data, offsets, ids, batch: int, k: int, homes: int) -> list[tuple]:
    tokens, bounds = token_sets(data, offsets, k)
    n = np.diff(bounds)
    sums = []
    for salt in (0, 0x5851F42D4C957F2D):
        total = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(mix(tokens ^ np.uint64(salt)), out=total[1:])
        sums.append(mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(np.uint64)))
    own = int(mix(np.array([batch], np.uint64))[0] % np.uint64(homes))
    rows = [(own, batch, 0, ids.astype(np.int64).tobytes(), n.astype(np.int32).tobytes(), sums[0].tobytes(), sums[1].tobytes(), b"")]
    # one document of each set asks
    first = np.zeros(len(ids), bool)
    first[np.unique(sums[0], return_index=True)[1]] = True
    doc = np.repeat(np.arange(len(ids)), n)
    tokens, doc = tokens[first[doc]], doc[first[doc]].astype(np.uint16)
    order = np.argsort(tokens)
    ordered = tokens[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    count = np.diff(np.append(starts, len(ordered)))
    single = np.zeros(len(tokens), bool)
    single[order[starts[count == 1]]] = True
    many = count > 1
    many_tokens, many_count = ordered[starts[many]], count[many]
    many_home = ((many_tokens >> np.uint64(32)) % np.uint64(homes)).astype(np.int64)
    if len(many_tokens):
        held = doc[order[np.repeat(many, count)]]
        rows.append((own, batch, 1, _compact(many_tokens & LOW, many_home).tobytes(), many_count.astype(np.int32).tobytes(), held.tobytes(), b"", b""))
    tokens, doc = tokens[single], doc[single]
    home = ((tokens >> np.uint64(32)) % np.uint64(homes)).astype(np.uint16 if homes < 65536 else np.int64)
    by, many_by = np.argsort(home, kind="stable"), np.argsort(many_home, kind="stable")
    low, doc = tokens[by] & LOW, doc[by]
    many_low, many_count = many_tokens[many_by] & LOW, many_count[many_by]
    at, many_at = np.searchsorted(home[by], np.arange(homes + 1)), np.searchsorted(many_home[many_by], np.arange(homes + 1))
    small, high = low.astype(np.uint32), (low >> np.uint64(32)).astype(np.uint16)
    for x in range(homes):
        s, m = slice(at[x], at[x + 1]), slice(many_at[x], many_at[x + 1])
        if s.stop > s.start or m.stop > m.start:
            rows.append((x, batch, 2, small[s].tobytes(), high[s].tobytes(), doc[s].tobytes(), many_low[m].tobytes(), many_count[m].astype(np.uint16).tobytes()))
    return rows


def _buffers(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All rows' arrays end to end, and their bounds."""
    parts = [np.frombuffer(x or b"", dtype) for x in column]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64)


def _answer(table: pa.Table) -> pa.Table:
    """At a home: which tokens more than one document holds, told to each batch that asked."""
    kind = table.column("kind").to_numpy()
    passed = table.filter(pa.array(kind != 2))
    asked = table.filter(pa.array(kind == 2)).select(_NAMES)
    rows = [tuple(r.values()) for r in passed.select(_NAMES).to_pylist()]
    if asked.num_rows:
        cols = {c: asked.column(c).to_pylist() for c in "abcde"}
        home = asked.column("home").to_numpy()[:1]
        small, at = _buffers(cols["a"], np.uint32)
        high, _ = _buffers(cols["b"], np.uint16)
        doc, _ = _buffers(cols["c"], np.uint16)
        many, many_at = _buffers(cols["d"], np.uint64)
        count, _ = _buffers(cols["e"], np.uint16)
        tokens = np.concatenate([small.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), many])
        weight = np.concatenate([np.ones(len(small), np.int64), count.astype(np.int64)])
        order = np.argsort(tokens)
        ordered = tokens[order]
        starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
        held = np.add.reduceat(weight[order], starts) if len(starts) else weight[:0]
        held_by = np.zeros(len(tokens), np.int64)
        held_by[order] = np.repeat(held, np.diff(np.append(starts, len(ordered))))
        grade = np.floor(np.log2(np.maximum(held_by, 1))).astype(np.uint8)
        code = _compact(tokens, np.broadcast_to(home, tokens.shape))
        n = len(small)
        shared, codes, grades = held_by[:n] >= 2, code[:n], grade[:n]
        for i, batch in enumerate(asked.column("batch").to_pylist()):
            s, m = slice(at[i], at[i + 1]), slice(n + many_at[i], n + many_at[i + 1])
            keep = shared[s]
            if keep.any() or m.stop > m.start:
                rows.append((0, batch, 3, codes[s][keep].tobytes(), doc[s][keep].tobytes(), grades[s][keep].tobytes(), code[m].tobytes(), grade[m].tobytes()))
    return pa.Table.from_batches([_table(rows)])


_DOC = "doc_id long, n int, node long, twin long, codes binary, grades binary"


def _gathered(table: pa.Table, percent: int) -> pa.Table:
    """Of a batch: each document, with its shared tokens by class if it may have a partner."""
    rows = {k: table.filter(pa.array(table.column("kind").to_numpy() == k)) for k in (0, 1, 3)}
    meta = rows[0].to_pylist()[0]
    ids, n = np.frombuffer(meta["a"], np.int64), np.frombuffer(meta["b"], np.int32).astype(np.int64)
    node, twin = np.frombuffer(meta["c"], np.int64), np.frombuffer(meta["d"], np.int64)
    code, _ = _buffers(rows[3].column("a").to_pylist(), np.uint64)
    doc, _ = _buffers(rows[3].column("b").to_pylist(), np.uint16)
    grade, _ = _buffers(rows[3].column("c").to_pylist(), np.uint8)
    if rows[1].num_rows:
        local = rows[1].to_pylist()[0]
        codes, count, held = np.frombuffer(local["a"], np.uint64), np.frombuffer(local["b"], np.int32), np.frombuffer(local["c"], np.uint16)
        told, _ = _buffers(rows[3].column("d").to_pylist(), np.uint64)
        grades, _ = _buffers(rows[3].column("e").to_pylist(), np.uint8)
        by = np.argsort(told)
        grades = grades[by][np.searchsorted(told[by], codes)]
        code, doc, grade = np.concatenate([code, np.repeat(codes, count)]), np.concatenate([doc, held]), np.concatenate([grade, np.repeat(grades, count)])
    shared = np.bincount(doc, minlength=len(n))
    fit = (n >= 2) & (100 * shared >= percent * n)
    keep = fit[doc]
    code, doc, grade = code[keep], doc[keep], grade[keep]
    order = np.lexsort((code, grade, doc))
    code, grade, at = code[order], grade[order], np.searchsorted(doc[order], np.arange(len(n) + 1))
    lists = [[x[at[i] : at[i + 1]].tobytes() if fit[i] else None for i in range(len(n))] for x in (code, grade)]
    return pa.table([pa.array(ids), pa.array(n, pa.int32()), pa.array(node), pa.array(twin), pa.array(lists[0], pa.binary()), pa.array(lists[1], pa.binary())], ["doc_id", "n", "node", "twin", "codes", "grades"])


def _keys(codes: np.ndarray, grades: np.ndarray, n: int, percent: int, frequent: int, combine: int) -> np.ndarray:
    """Index keys of one node."""
    least = -(-percent * n // 100)
    prefix = len(codes) - least + 1  # tokens that no other document holds come before these
    rare = int(np.searchsorted(grades, frequent))
    keys = [codes[: min(prefix, rare)]]
    if prefix > rare:
        if n > combine:
            keys.append(codes[rare:prefix])
        if n <= combine * 100 // percent + 1:
            part = codes[rare : prefix + 1]
            i, j = np.triu_indices(len(part), 1)
            keys.append(mix(part[i] * np.uint64(0x9E3779B97F4A7C15) + part[j]))
    return np.concatenate(keys)


def _index(batches, percent: int, frequent: int, combine: int, homes: int):
    for batch in batches:
        found, names, sizes = [], [], []
        for node, n, codes, grades in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            keys = _keys(np.frombuffer(codes, np.uint64), np.frombuffer(grades, np.uint8), n, percent, frequent, combine)
            found.append(keys)
            names.append(np.full(len(keys), node))
            sizes.append(np.full(len(keys), n, np.int32))
        if not found:
            continue
        keys, names, sizes = np.concatenate(found), np.concatenate(names), np.concatenate(sizes)
        home = ((keys >> np.uint64(32)) % np.uint64(homes)).astype(np.int32)
        by = np.argsort(home, kind="stable")
        at = np.searchsorted(home[by], np.arange(homes + 1))
        rows = [(x, *(v[by[at[x] : at[x + 1]]].tobytes() for v in (keys, names, sizes))) for x in range(homes) if at[x + 1] > at[x]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["home", "a", "b", "c"])


def _chains(table: pa.Table, percent: int) -> pa.Table:
    """Links between nodes next in size that share a key, without those that others imply."""
    keys, _ = _buffers(table.column("a").to_pylist(), np.uint64)
    names, _ = _buffers(table.column("b").to_pylist(), np.int64)
    sizes, _ = _buffers(table.column("c").to_pylist(), np.int32)
    order = np.lexsort((names, sizes, keys))
    keys, names, sizes = keys[order], names[order], sizes[order].astype(np.int64)
    next_to = (keys[1:] == keys[:-1]) & (names[1:] != names[:-1]) & (100 * sizes[:-1] >= percent * sizes[1:])
    a, b = forest(names[:-1][next_to], names[1:][next_to])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def overlaps(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of all sets with each other, or with those of others."""
    every = sets + (others or [])
    m, low = len(every), 0 if others is None else len(sets)
    if m <= 4:
        out = np.zeros((m, m), np.int64)
        for i in range(m):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(every[i], every[j], assume_unique=True))
        return out if others is None else out[:low, low:]
    tokens, column, held = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(s) for s in every])
    out = np.zeros((m, m) if others is None else (low, m - low), np.int64)
    few = (held >= 2) & (held < 8) if m > 64 else np.zeros(len(tokens), bool)
    if few.any():  # pairs of holders, token by token
        by = np.argsort(column, kind="stable")
        first = np.cumsum(held) - held
        flat = np.zeros(m * m, np.int64)
        for d in range(2, 8):
            at = first[few & (held == d)]
            holders = row[by[at[:, None] + np.arange(d)]]
            for i in range(d):
                for j in range(d):
                    if i != j:
                        flat += np.bincount(holders[:, i] * m + holders[:, j], minlength=m * m)
        flat = flat.reshape(m, m)
        out += flat if others is None else flat[:low, low:]
    dense = np.flatnonzero((held >= 2) & ~few)
    place = np.full(len(tokens), -1)
    place[dense] = np.arange(len(dense))
    where = place[column]
    step = max(256, (16 << 20) // (4 * m))
    for a in range(0, len(dense), step):
        pick = (where >= a) & (where < a + step)
        part = np.zeros((m, min(step, len(dense) - a)), np.float32)
        part[row[pick], where[pick] - a] = 1
        out += np.rint(part @ part.T if others is None else part[:low] @ part[low:].T).astype(np.int64)
    return out


def _similar(shared, n, others, percent):
    return 100 * shared >= percent * (n[:, None] + others[None, :] - shared)


def _decoded(table: pa.Table, pick) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    part = table.take(pa.array(pick))
    return part.column("node").to_numpy(), part.column("n").to_numpy().astype(np.int64), [np.frombuffer(x, np.uint64) for x in part.column("codes").to_pylist()]


def _within(table: pa.Table, percent: int) -> pa.Table:
    """Links of a forest over the linked nodes of each block of a pack."""
    block = table.column("block").to_numpy()
    order = np.argsort(block, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, block[order][1:] != block[order][:-1])), len(order))
    a, b = [], []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        node, n, sets = _decoded(table, order[lo:hi])
        x, y = np.nonzero(_similar(overlaps(sets), n, n, percent))
        p = roots(len(node), x, y)
        own = p != np.arange(len(node))
        a.append(node[own])
        b.append(node[p[own]])
    return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})


def _across(table: pa.Table, percent: int) -> pa.Table:
    """Links between the outer nodes and the others of a pair of tiles."""
    outer = table.column("outer").to_numpy(zero_copy_only=False).astype(bool)
    left, right = _decoded(table, np.flatnonzero(outer)), _decoded(table, np.flatnonzero(~outer))
    if not len(left[0]) or not len(right[0]):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    x, y = np.nonzero(_similar(overlaps(left[2], right[2]), left[1], right[1], percent))
    a, b = forest(left[0][x], right[0][y])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


_LINK = "a long, b long"


def _spread(column, n) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(31), column), n).cast("int")


def linked(nodes: DataFrame, blocks: DataFrame, percent: int, tile: int, packs: int) -> DataFrame:
    """Links (a, b) with the components of all similar pairs of nodes in the same block."""
    held = nodes.join(blocks, "node").withColumn("size", (F.octet_length("codes") / 8).cast("long"))
    every_node = held = written(held.select("node", "n", "codes", "size", "block"), "held")
    sizes = held.groupBy("block").agg(F.count("*").alias("m"), F.sum("size").alias("t"))
    # a tile holds `tile` nodes and a thousand times as many tokens at most
    sizes = written(sizes.select("block", "m", F.greatest(F.ceil(F.col("m") / tile), F.ceil(F.col("t") / (tile * 1000)), F.lit(1)).cast("int").alias("tiles")), "blocks")
    held = held.join(sizes, "block")
    within = lambda t: _within(t, percent)
    small = held.where("tiles = 1").groupBy(_spread(F.col("block"), F.lit(packs)).alias("pack")).applyInArrow(within, _LINK)
    large = held.where("tiles > 1")
    if not sizes.where("tiles > 1").limit(1).count():
        links = written(small, "links")
        dropped(every_node)
        return links
    tiles = large.withColumn("tile", _spread(F.col("node"), F.col("tiles")))
    inner = written(tiles.groupBy("block", "tile").applyInArrow(within, _LINK), "links")
    links = written(small.unionByName(inner), "links")

    # some members of each tile's components, between tiles
    local = tiles.select("node", "n", "codes", "block", "tile", "tiles").join(inner.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    chosen = local.groupBy("block", "tile", "root").agg(F.array_distinct(F.array(F.min("node"), F.max("node"), F.min_by("node", F.xxhash64("node")), F.max_by("node", F.xxhash64("node")))).alias("some"))
    chosen = written(chosen.select(F.explode("some").alias("node"), "block"), "chosen")
    some = chosen.groupBy("block").agg(F.count("*").alias("c"))
    chosen = chosen.join(some, "block").withColumn("tile", F.pmod(F.xxhash64(F.lit(57), "node"), F.ceil(F.col("c") / tile)).cast("int"))
    met = nodes.join(chosen.select("node", "block", "tile"), "node")
    links = written(links.unionByName(met.groupBy("block", "tile").applyInArrow(within, _LINK)), "links")

    # what lies outside a block's largest component, with everything of the block
    now = components(links)
    held = large.select("node", "n", "codes", "block", "tiles").join(now, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = written(held.groupBy("block", "root").agg(F.count("*").alias("c")), "parts")
    main = parts.groupBy("block").agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("all"))
    main = written(main.select("block", F.col("main.root").alias("main"), F.ceil((F.col("all") - F.col("main.c")) / tile).cast("int").alias("outers")).where("outers > 0"), "outers")
    held = held.select("node", "n", "codes", "block", "tiles", "root").join(main, "block")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inside = held.withColumn("x", _spread(F.col("node"), F.col("tiles"))).withColumn("y", every("outers")).withColumn("outer", F.lit(False))
    outside = held.where("root <> main").withColumn("x", every("tiles")).withColumn("y", F.pmod(F.xxhash64(F.lit(57), "node"), F.col("outers")).cast("int")).withColumn("outer", F.lit(True))
    names = ["node", "n", "codes", "block", "x", "y", "outer"]
    rest = inside.select(names).unionByName(outside.select(names)).groupBy("block", "x", "y").applyInArrow(lambda t: _across(t, percent), _LINK)
    links = written(links.unionByName(rest), "links")
    dropped(every_node)
    return links


def similar_groups(docs: DataFrame, percent: int = 85, words: int = 4, frequent: int = 6, combine: int = 160, tile: int = 1024, home_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    Two documents are linked if 100 * intersection >= percent * union of their
    sets of `words`-word shingles; a component's id is the smallest doc_id in it.
    """
    spark = docs.sparkSession
    plain = docs.select("doc_id", "text")
    total = plain.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    homes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // home_bytes))
    asked = plain.mapInArrow(lambda x: _ask(x, words, homes), _ROW)
    told = asked.groupBy("home").applyInArrow(_answer, _ROW)
    rows = written(told.groupBy("batch").applyInArrow(lambda t: _gathered(t, percent), _DOC), "sets")
    nodes = rows.where("codes is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("codes").alias("codes"), F.first("grades").alias("grades"))
    nodes = written(nodes, "nodes")
    index = nodes.select("node", "n", "codes", "grades").mapInArrow(lambda x: _index(x, percent, frequent, combine, homes), "home int, a binary, b binary, c binary")
    found = components(index.groupBy("home").applyInArrow(lambda t: _chains(t, percent), _LINK))
    # the smallest node of a block is in it as well
    blocks = written(found.select("node", F.col("root").alias("block")).unionByName(found.select(F.col("root").alias("node"), F.col("root").alias("block")).distinct()), "blocks")
    joined = written(components(linked(nodes.select("node", "n", "codes"), blocks, percent, tile, homes)), "joined")
    slim = written(rows.select("doc_id", "n", "node"), "slim")
    for table in (rows, nodes):  # all that was made from them is written
        dropped(table)

    known = slim.where("n > 0").join(joined, "node", "left").select("doc_id", "n", F.coalesce("root", "node").alias("root"))
    least = written(known.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    out = known.join(least, "root").select("doc_id", "n", "component_id")
    out = out.unionByName(slim.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("doc_id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), real("component_id").alias("component_id"))


def op10(spark, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
