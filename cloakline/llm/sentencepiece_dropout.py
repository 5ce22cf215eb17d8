"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A text becomes symbols: an added space, then its characters, spaces written as
the vocabulary's space mark. Adjacent symbols whose concatenation is a piece
are candidate merges; the agenda takes the candidate of the highest score,
leftmost first. A candidate (place of its left symbol, left piece, right piece)
is skipped for good if a hash keyed by the seed, the doc_id and the place in the
text falls under the dropout rate, so every occurrence draws for itself. Characters that no piece holds become
byte pieces. Decoding is the concatenation of the pieces' bytes without the
added space, so it gives any text back, whatever was skipped.

No piece of a vocabulary with words split at spaces reaches over a space after
another character, so such a place parts the text into segments that are
merged each for itself (this is checked against the vocabulary). Merges depend on
the segment and on which of the candidates that come up are skipped. They are kept
by these two, with all candidates that came up, so that an occurrence whose draws
on these candidates give the same skips has the same merges; if they give others,
it goes on with those. Each round follows the occurrence's own merges further, so
the end is what merging it alone gives. Segments of over SHORT symbols, which
hardly ever draw alike, are merged alone. Short segments are merged many at a
time, longer ones one by one with a heap; the merges are the same. What is kept is
forgotten beyond a number of segments and of pieces and candidates in them.

Defined results. Null or empty text: no pieces. Null doc_id: as 0. The mark
itself in a text, and bytes that are no UTF-8, become byte pieces and come back.
Rows that repeat a doc_id and text have the same pieces. Empty table: no rows.
Only doc_id and text are read, and further columns are carried along by name; one
named like a result is returned with docs_ before its name.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakline.llm.common import arrow_bytes, column, pieces, result_names
from cloakline.llm.textops import mix, span_hash, sums

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
_NONE = np.int64(1) << 40
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
WIDEST = 32
SHORT = 6


class Vocabulary:
    """Pieces, scores and merges of a SentencePiece BPE model with byte fallback."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.byte = np.zeros(256, np.int64)
        data = [b""] * n
        for i in plain:
            data[i] = self.names[i].replace(chr(MARK), " ").encode()
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(self.names[i][3:5], 16)] = i
                data[i] = bytes([int(self.names[i][3:5], 16)])
        self.size = np.array([len(x) for x in data])
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(data), np.uint8)
        # characters: those of longer pieces have a symbol even if they are no piece of their own
        self.char = np.full(0x110001, -1, np.int64)
        self.inner = np.zeros(0x110001, bool)
        self.char_of = {}
        for piece in self.ids:
            for c in piece if len(piece) > 1 else "":
                self.inner[ord(c)] = True
                if c not in self.ids and self.char[ord(c)] < 0:
                    self.char[ord(c)] = n + len(self.char_of)
                    self.char_of[n + len(self.char_of)] = c
            if len(piece) == 1:
                self.char[ord(piece)] = self.ids[piece]
        self.parted = not any(a != chr(MARK) and b == chr(MARK) for p in self.ids for a, b in zip(p, p[1:], strict=False))
        self.base = n + len(self.char_of)
        order = sorted((i for p, i in self.ids.items() if len(p) > 1), key=lambda i: (-sp.get_score(i), i))
        self.merged = np.array(order, np.int64)  # by rank
        symbol = lambda s: self.ids.get(s, int(self.char[ord(s)]) if len(s) == 1 else -1)
        keys, ranks = [], []
        for rank, i in enumerate(order):
            p = self.names[i]
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a >= 0 and b >= 0:
                    keys.append(a * self.base + b)
                    ranks.append(rank)
        self._hashed(np.array(keys, np.int64), np.array(ranks, np.int64))
        self.rank_of = dict(zip(keys, ranks, strict=True))

    def _hashed(self, keys, ranks):
        bits = max(4, int(len(keys) * 8).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots, self.ranks = np.full((1 << bits) + 64, -1, np.int64), np.zeros((1 << bits) + 64, np.int64)
        place, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            assert self.probes < 64, "the table of merges is too full"
            where = place[left] + self.probes
            free, first = np.unique(where, return_index=True)
            good = self.slots[free] < 0
            self.slots[free[good]], self.ranks[free[good]] = keys[left[first[good]]], ranks[left[first[good]]]
            left = np.delete(left, first[good])
            self.probes += 1

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * _C[0]) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of a and b, or _NONE."""
        keys = a * self.base + b
        where = self._slot(keys)
        out = np.full(keys.shape, _NONE)
        for probe in range(self.probes):
            here = self.slots[where + probe]
            hit = here == keys
            out[hit] = self.ranks[where + probe][hit]
            if not (~hit & (here >= 0)).any():
                break
        return out


_ALL = (1 << 64) - 1
_P = [int(x) for x in _C]


def _mixed(h: int) -> int:
    """mix() of one number."""
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & _ALL
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & _ALL
    return h ^ (h >> 31)


def _candidate(place, a, b):
    return place.astype(np.uint64) * _C[1] + a.astype(np.uint64) * _C[2] + b.astype(np.uint64) * _C[3]


class Encoder:
    """With variants, equal segments draw alike in so many ways; without, each occurrence draws for itself."""

    def __init__(self, model: bytes, dropout: float = 0.1, seed: int = 11, variants: int | None = None, keep: int = 1 << 19):
        self.v, self.variants, self.keep = Vocabulary(model), variants, keep
        self.seeds = np.uint64(seed) * _C[:2]
        self.bound = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))
        self._forget()

    def _forget(self):
        """Of segments with their skips: where the pieces and the candidates that came up stand in two flat arrays."""
        self.keys, self.flat, self.cands = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.start, self.count, self.cand_start, self.cand_count = (np.zeros(0, np.int64) for _ in range(4))

    def _ranks(self, key, place, a, b, rows=None, seen=None):
        """Ranks of the merges; skipped are those that key draws or, if it has one more dimension, that it lists."""
        r = self.v.rank(a, b)
        if self.bound:
            real = r < _NONE
            cand = _candidate(place[real], a[real], b[real])
            key = np.broadcast_to(key, r.shape + key.shape[r.ndim :])[real]
            skip = mix(key + cand) < self.bound if key.ndim == 1 else (key == cand[:, None]).any(1)
            if seen is not None:
                seen.append((np.broadcast_to(rows, r.shape)[real], cand))
            r[real] = np.where(skip, _NONE, r[real])
        return r

    def _matrix(self, symbols: np.ndarray, keys: np.ndarray, names: np.ndarray, seen: list | None) -> list[np.ndarray]:
        """Merges rows of symbols of one length, each step one merge in each row that has one."""
        n, width = symbols.shape
        out, rows = [None] * n, np.arange(n)
        a, place = symbols, np.broadcast_to(np.arange(width), symbols.shape).copy()
        r = self._ranks(keys[:, None], place[:, :-1], a[:, :-1], a[:, 1:], names[:, None], seen) if width > 1 else np.zeros((n, 0), np.int64)
        while len(rows):
            best = r.argmin(1) if r.shape[1] else np.zeros(len(rows), np.int64)
            live = r[np.arange(len(rows)), best] < _NONE if r.shape[1] else np.zeros(len(rows), bool)
            for i in np.flatnonzero(~live):
                out[rows[i]] = a[i]
            if not live.any():
                break
            rows, a, place, r, best, keys = rows[live], a[live], place[live], r[live], best[live], keys[live]
            every = np.arange(len(rows))
            a[every, best] = self.v.merged[r[every, best]]
            cols = np.arange(a.shape[1] - 1)[None, :]
            take = cols + (cols > best[:, None])
            a, place = np.take_along_axis(a, take, 1), np.take_along_axis(place, take, 1)
            cols = np.arange(r.shape[1] - 1)[None, :]
            r = np.take_along_axis(r, cols + (cols >= best[:, None]), 1)
            for at in (best - 1, best):
                ok = np.flatnonzero((at >= 0) & (at < r.shape[1]))
                if len(ok):
                    c = at[ok]
                    r[ok, c] = self._ranks(keys[ok], place[ok, c], a[ok, c], a[ok, c + 1], names[rows[ok]], seen)
        return out

    def _heap(self, symbols: np.ndarray, key: np.ndarray, name: int, seen: list | None) -> np.ndarray:
        """The same merges of one long segment, by an agenda of plain numbers."""
        n, merged, rank_of, base, bound = len(symbols), self.v.merged, self.v.rank_of, self.v.base, int(self.bound)
        piece, nxt, prv = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        drawn = int(key) if key.ndim == 0 else None
        listed = None if drawn is not None else set(key.tolist())
        came, agenda = [], []

        def add(x: int, a: int, b: int):
            rank = rank_of.get(a * base + b)
            if rank is None:
                return
            if bound:
                cand = (x * _P[1] + a * _P[2] + b * _P[3]) & _ALL
                if seen is not None:
                    came.append(cand)
                if (_mixed((drawn + cand) & _ALL) < bound) if listed is None else cand in listed:
                    return
            agenda.append((rank, x, a, b)) if first else heapq.heappush(agenda, (rank, x, a, b))

        first = True
        for x in range(n - 1):
            add(x, piece[x], piece[x + 1])
        heapq.heapify(agenda)
        first = False
        while agenda:
            rank, i, a, b = heapq.heappop(agenda)
            j = nxt[i]
            if piece[i] != a or j >= n or piece[j] != b:
                continue
            piece[i], piece[j] = int(merged[rank]), -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < n:
                    add(x, piece[x], piece[y])
        if seen is not None:
            seen.append((np.full(len(came), name), np.array(came, np.uint64)))
        return np.array([p for p in piece if p >= 0], np.int64)

    def _bytes(self, code: int) -> np.ndarray:
        return self.v.byte[np.frombuffer(chr(code).encode("utf-8", "surrogateescape"), np.uint8)]

    def _merge(self, codes, symbols, start, length, keys, seen=None) -> list[np.ndarray]:
        out = [None] * len(start)
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            if n == 1 or n > WIDEST:
                for i in rows:
                    s = symbols[start[i] : start[i] + n]
                    out[i] = self._heap(s, keys[i], i, seen) if n > 1 else s if s[0] >= 0 else self._bytes(int(codes[start[i]]))
                continue
            for a in range(0, len(rows), 8192):
                part = rows[a : a + 8192]
                for i, got in zip(part, self._matrix(symbols[start[part][:, None] + np.arange(n)], keys[part], part, seen), strict=True):
                    out[i] = got
        if self.v.char_of:  # characters that stayed alone but are no piece
            for i, x in enumerate(out):
                if (x >= len(self.v.names)).any():
                    out[i] = np.concatenate([self._bytes(ord(self.v.char_of[p])) if p >= len(self.v.names) else np.array([p]) for p in x.tolist()])
        return out

    def encode(self, texts: list[str], doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts end to end, and the offsets of each text's pieces."""
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        n = int(sizes.sum())
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        codes = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        symbols = np.where(codes == 32, self.v.char[MARK], np.where(codes == MARK, -1, self.v.char[codes]))
        alone = ~np.where(codes == 32, self.v.inner[MARK], (codes != MARK) & self.v.inner[codes])
        begins = np.zeros(n, bool)
        ends = np.cumsum(sizes)
        begins[(ends - sizes)[sizes > 0]] = True
        begins |= alone
        begins[1:] |= alone[:-1]
        if self.v.parted:
            space = codes == 32
            begins[1:] |= space[1:] & ~space[:-1]
        start = np.flatnonzero(begins)
        length = np.diff(np.append(start, n))
        doc = np.searchsorted(ends, start, "right")
        prefix = sums(mix((codes + 1).astype(np.uint64)))
        segment = mix(span_hash(prefix, start, start + length) + self.seeds[1])
        if self.variants:
            number = np.arange(len(start)) - np.searchsorted(doc, np.arange(len(texts)))[doc]
            variant = mix(self.seeds[0] + doc_ids[doc].astype(np.uint64) * _C[1] + number.astype(np.uint64) * _C[2]) % np.uint64(self.variants)
            keys = mix(segment + variant * _C[3])
        else:
            place = start - (ends - sizes)[doc]
            keys = mix(mix(self.seeds[0] + doc_ids[doc].astype(np.uint64) * _C[1]) + place.astype(np.uint64) * _C[2] + self.seeds[1])
        if len(self.keys) > self.keep or len(self.flat) + len(self.cands) > 16 * self.keep:
            self._forget()
        begin, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        short = (length <= SHORT) | (self.bound == 0)
        self._follow(np.flatnonzero(short), segment, keys, codes, symbols, start, length, begin, count)
        flat = self.flat
        alone = np.flatnonzero(~short)
        if len(alone):
            got = self._merge(codes, symbols, start[alone], length[alone], keys[alone])
            count[alone] = [len(x) for x in got]
            begin[alone] = len(flat) + np.cumsum(count[alone]) - count[alone]
            flat = np.concatenate([flat, *got])
        stop = np.cumsum(count)
        ids = flat[np.repeat(begin - (stop - count), count) + np.arange(int(stop[-1]))]
        bounds = np.append(0, stop)[np.searchsorted(doc, np.arange(len(texts) + 1))]
        return ids, bounds

    def _follow(self, todo, segment, keys, codes, symbols, start, length, begin, count):
        """Set where the pieces of the segments todo stand, by rounds: the skips that the last round's candidates draw."""
        state = np.zeros(len(todo), np.uint64)  # sum of the hashes of the skips
        owner, drawn = np.zeros(0, np.int64), np.zeros(0, np.uint64)  # the skips, by place in todo
        while len(todo):
            unique, first, inverse = np.unique(segment[todo] + state, return_index=True, return_inverse=True)
            self._learn(unique, first, owner, drawn, codes, symbols, start[todo], length[todo])
            where = np.searchsorted(self.keys, unique)[inverse]
            begin[todo], count[todo] = self.start[where], self.count[where]
            if not self.bound:
                break
            n = self.cand_count[where]
            stop = np.cumsum(n)
            owner = np.repeat(np.arange(len(todo)), n)
            drawn = self.cands[np.repeat(self.cand_start[where] - (stop - n), n) + np.arange(int(stop[-1]))]
            hit = np.flatnonzero(mix(keys[todo][owner] + drawn) < self.bound)
            owner, drawn = owner[hit], drawn[hit]
            total = np.append(np.uint64(0), np.cumsum(mix(drawn ^ _C[0]), dtype=np.uint64))
            edges = np.searchsorted(owner, np.arange(len(todo) + 1))
            now = total[edges[1:]] - total[edges[:-1]]
            left = now != state
            owner, drawn = (np.cumsum(left) - 1)[owner][left[owner]], drawn[left[owner]]
            todo, state = todo[left], now[left]

    def _learn(self, unique, first, owner, drawn, codes, symbols, start, length):
        at = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        new = self.keys[at] != unique if len(self.keys) else np.ones(len(unique), bool)
        if not new.any():
            return
        rows, seen = first[new], []
        a, b = np.searchsorted(owner, rows), np.searchsorted(owner, rows, "right")
        skips = np.zeros((len(rows), int((b - a).max())), np.uint64)
        for k in range(skips.shape[1]):
            has = np.flatnonzero(a + k < b)
            skips[has, k] = drawn[a[has] + k]
        got = self._merge(codes, symbols, start[rows], length[rows], skips, seen)
        by = np.concatenate([np.zeros(0, np.int64), *[np.broadcast_to(x, c.shape) for x, c in seen]])
        cands = np.concatenate([np.zeros(0, np.uint64), *[c for _, c in seen]])[np.argsort(by, kind="stable")]
        many = np.bincount(by, minlength=len(rows))
        size = np.array([len(x) for x in got])
        keys = np.concatenate([self.keys, unique[new]])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.start, self.count = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])[order], np.concatenate([self.count, size])[order]
        self.cand_start, self.cand_count = np.concatenate([self.cand_start, len(self.cands) + np.cumsum(many) - many])[order], np.concatenate([self.cand_count, many])[order]
        self.flat, self.cands = np.concatenate([self.flat, *got]), np.concatenate([self.cands, cands])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts of pieces laid end to end."""
        size = self.v.size[ids]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        data = self.v.data[np.repeat(self.v.at[ids] - (stop - size), size) + np.arange(total)]
        bounds = np.append(0, stop)[offsets]
        drop = bounds[:-1][offsets[1:] > offsets[:-1]]  # the added spaces
        return np.delete(data, drop), bounds - np.searchsorted(drop, bounds, "left")


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, *carried: str, model: str = MODEL, dropout: float = 0.1, seed: int = 11, variants: int | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, the carried columns, n_pieces, ids_crc32, lossless and ids (null without with_ids).

    ids_crc32 is that of the ids as little-endian 32-bit numbers; lossless
    tells that decoding the ids gave the text's bytes back.
    """
    proto = model_bytes(model)
    others = [c for c in carried if c not in ("doc_id", "text")]
    results = ["n_pieces", "ids_crc32", "lossless", "ids"]
    back = result_names(others, ["doc_id", "text", *results])
    plain = docs.select("doc_id", "text", *[column(c).alias(f"_c{i}") for i, c in enumerate(others)])
    names = plain.columns

    def run(batches):
        encoder = Encoder(proto, dropout, seed, variants)
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(1))
            keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in pieces(offsets, 2 << 20):
                part, at = batch.slice(a, b - a), offsets[a : b + 1] - offsets[a]
                raw = data[offsets[a] : offsets[b]]
                texts = [raw[x:y].tobytes().decode("utf-8", "surrogateescape") for x, y in zip(at[:-1], at[1:], strict=True)]
                ids, bounds = encoder.encode(texts, keys[a:b])
                back, back_at = encoder.decode(ids, bounds)
                ids = ids.astype(np.int32)
                same = np.array_equal(back, raw) and np.array_equal(back_at, at)
                lossless = [same or back[x:y].tobytes() == t.encode("utf-8", "surrogateescape") for x, y, t in zip(back_at[:-1], back_at[1:], texts, strict=True)]
                codes = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)) if with_ids else pa.nulls(b - a, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(bounds), pa.int64()), pa.array(codes, pa.int64()), pa.array(lossless, pa.bool_()), lists], [*names, *results])

    schema = ", ".join([f"`{x.name}` {x.dataType.simpleString()}" for x in plain.schema] + ["n_pieces long", "ids_crc32 long", "lossless boolean", "ids array<int>"])
    out = plain.mapInArrow(run, schema)
    return out.select("doc_id", "text", *[F.col(f"_c{i}").alias(c) for i, c in enumerate(back)], *results)


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""
    proto = model_bytes(model)

    def run(batches):
        encoder = Encoder(proto, 0.0)
        for batch in batches:
            lists = batch.column(1).fill_null([])
            data, at = encoder.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            texts = [data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encoded(docs).select("doc_id", "n_pieces", "ids_crc32", "lossless", "ids")
