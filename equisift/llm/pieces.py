"""SentencePiece encoding and decoding by batched numpy Viterbi.

Texts are cut into units that no piece crosses: a run of word marks and what follows it. Distinct units of equal length advance together,
character by character: hashes of all substrings probe the sorted hashes of the pieces, and for each end the vectorised maximum over
the pieces that end there stores a backpointer.

What is maximised depends on the model. Unigram models sum piece scores. A BPE model is not a best sum: its scores are the order of merges. There a
step from piece a to piece b counts 1 if merging a's and b's characters gives just a, b, else minus infinity; the encoding of
a prefix ends in exactly one piece, so this Viterbi gives the encoding that merging would.

Units without word marks inside (scripts without spaces, base64) can be of any length. Up to WINDOW characters they are padded to a common
length. Longer ones are cut into overlapping windows that advance together; what a prefix ends in depends on as many places before as the longest
piece has characters, so a window is right from where it agrees with the one before on that many places, and until then the recursion is taken place by place.
"""

from __future__ import annotations

import heapq
import os
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from .common import in_arrow, mix

#: Where the public vocabulary files are; a parameter of every operator here.
MODEL = os.environ.get("EQUISIFT_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
_UNIT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Units up to SHORT characters advance with those of equal length, up to WINDOW padded to a multiple of SHORT, beyond it in windows that overlap.
SHORT, WINDOW, OVERLAP = 32, 256, 64
#: A code that no character has, so that no piece is found where a unit is padded.
_PAD = np.uint64(0x110001)
#: Memory of a task: units known, slots of the pairs tried, characters of a slice of texts, characters that advance together.
_MOST_UNITS, _PAIR_BITS, _BATCH_CHARS, _ADVANCE_CHARS = 150_000, 20, 1 << 21, 1 << 18
#: Between two units: before a run of word marks, and on both sides of a line's end.
_BETWEEN = re.compile(f"(?<=[^ {MARK}])(?=[ {MARK}])|(?<=\n)|(?=\n)")


def _sum(codes: np.ndarray) -> np.uint64:
    """The polynomial whose mix() is a string's hash. Codes must not be 0, or strings of several lengths would share one."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for c in codes:
            h = h * _BASE + c
    return h


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


class Pieces:
    """A model's pieces, and the encoder and decoder made of them."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: str, bpe: bool):
        """kinds: for each piece N (normal), B (byte <0xNN>) or another letter (never encoded)."""
        self.bpe, self.n = bpe, len(pieces)
        self.pieces, self.scores = pieces, scores
        self.ids = {p: i for i, p in enumerate(pieces) if kinds[i] == "N"}
        self.bytes = [0] * 256
        for i, p in enumerate(pieces):
            if kinds[i] == "B":
                self.bytes[int(p[3:5], 16)] = i
        self.longest = max(map(len, self.ids), default=1)
        order = sorted(self.ids.items(), key=lambda x: len(x[0]))
        raw = np.array([_sum(_codes(p)) for p, _ in order], np.uint64)
        h = mix(raw)
        at = np.argsort(h)
        self.keys, self.key_ids = h[at], np.array([order[i][1] for i in at], np.int32)
        assert len(np.unique(h)) == len(h), "two pieces share a hash"
        self.score = np.array(scores, float)
        self.unknown = min((scores[i] for i in self.ids.values()), default=0.0) - 10
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.sum, self.size = np.zeros(self.n, np.uint64), np.zeros(self.n, np.int64)
        for (p, i), x in zip(order, raw):
            self.sum[i], self.size[i] = x, len(p)
        self.power = np.array([pow(int(_BASE), i, 1 << 64) for i in range(self.longest + 1)], np.uint64)
        #: Pairs of pieces that have been tried: twice the pair, and 1 if allowed; a slot holds the last pair that fell there.
        self.tried = np.full(1 << _PAIR_BITS, -1, np.int64)
        self.table = [bytes([int(p[3:5], 16)]) if kinds[i] == "B" else p.replace(MARK, " ").encode() if kinds[i] == "N" else b"" for i, p in enumerate(pieces)]
        self.whole = np.ones(self.n + 1, bool)
        self.rank = np.full(self.n, -1, np.int64)
        self.left, self.right = np.zeros(self.n, np.int32), np.zeros(self.n, np.int32)
        if bpe:
            # The order of merges; one character is there from the start. A piece that merging its own characters doesn't give never comes up.
            long = sorted((p for p in self.ids if len(p) > 1), key=lambda p: -scores[self.ids[p]])
            self.rank[[self.ids[p] for p in long]] = np.arange(len(long))
            ties = Counter(scores[self.ids[p]] for p in long)
            #: Pieces that share their score, come before one of their parts, or have such a part (in the public model, runs of word marks): pairs with these are merged.
            self.odd = np.zeros(self.n, bool)
            for p in long:
                i, tree = self.ids[p], []
                self.whole[i] = self.merged(p, tree) == [i]
                if self.whole[i]:
                    self.left[i], self.right[i] = (self.ids.get(x, -1) for x in tree[-1])
                    parts = [self.left[i], self.right[i]]
                    self.odd[i] = min(parts) < 0 or max(self.rank[parts]) >= self.rank[i] or self.odd[parts].any()
                self.odd[i] |= not self.whole[i] or ties[scores[i]] > 1

    @staticmethod
    def load(path: str) -> "Pieces":
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("only models without normalisation and with a dummy prefix are supported")
        kinds = "".join("N" if p.type in (1, 4) else "B" if p.type == 6 else "-" for p in proto.pieces)
        found = [p.piece for p in proto.pieces]
        if any(MARK in p.lstrip(MARK) for p, k in zip(found, kinds) if k == "N"):
            raise ValueError("a piece crosses words")
        return Pieces(found, [sp.get_score(i) for i in range(len(found))], kinds, proto.trainer_spec.model_type == 2)

    def merged(self, text: str, tree: list | None = None) -> list[int]:
        """BPE by its definition: merge the adjacent pair of best score, the first of equals, until none is a piece. -1 for a character that is no piece. tree: gets the merges."""
        if len(text) == 1:
            return [self.ids.get(text, -1)]
        parts = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list = []

        def push(i, j):
            if 0 <= i and j < len(parts) and (k := self.ids.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, parts[i], parts[j], j))

        for i in range(len(parts) - 1):
            push(i, i + 1)
        while heap:
            _, i, a, b, j = heapq.heappop(heap)
            if parts[i] != a or j >= len(parts) or parts[j] != b or after[i] != j:
                continue
            if tree is not None:
                tree.append((a, b))
            parts[i] = a + b
            parts[j] = ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            push(before[i], i)
            push(i, after[i])
        return [self.ids.get(p, -1) for p in parts if p]

    def _find(self, sums: np.ndarray) -> np.ndarray:
        """The pieces of strings with these polynomials, else -1."""
        out, probe = np.full(len(sums), -1, np.int32), mix(sums)
        at = np.flatnonzero(self.maybe[(probe >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, probe[at]), len(self.keys) - 1)
        right = self.keys[place] == probe[at]
        out[at[right]] = self.key_ids[place[right]]
        return out

    def _stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of whole pieces a and b gives a, b, elementwise.

        The merges of a and of b are undone, the latest first. What then stands at both sides of the border was there until the undone merge, and would have been merged
        if it makes a piece that comes earlier; of the same piece the one further left comes first: a's own merge goes before the border's, the border's before b's.
        """
        odd = self.odd[a] | self.odd[b]
        if odd.any():
            out, rest = np.zeros(len(a), bool), np.flatnonzero(~odd)
            out[odd] = [self.merged(self.pieces[x] + self.pieces[y]) == [x, y] for x, y in zip(a[odd].tolist(), b[odd].tolist())]
            out[rest] = self._stay_apart(a[rest], b[rest])
            return out
        first, out, at = (a, b), np.ones(len(a), bool), np.arange(len(a))
        until = np.full(len(a), np.iinfo(np.int64).max)
        while len(at):
            with np.errstate(over="ignore"):
                both = self._find(self.sum[a] * self.power[self.size[b] % len(self.power)] + self.sum[b])
            both = np.where(self.size[a] + self.size[b] <= self.longest, both, -1)
            joined = (both >= 0) & ((self.rank[both] < until) | self.odd[both])
            out[at[joined]] = False
            for k in at[joined & self.odd[both]].tolist():
                x, y = int(first[0][k]), int(first[1][k])
                out[k] = self.merged(self.pieces[x] + self.pieces[y]) == [x, y]
            ra, rb = self.rank[a], self.rank[b]
            go = ~joined & (np.maximum(ra, rb) >= 0)
            a, b, ra, rb, at = a[go], b[go], ra[go], rb[go], at[go]
            # Equal pieces: the right one's last merge came later.
            undo = ra > rb
            until = np.where(undo, ra, rb + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return out

    def _allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may follow a (n: a boundary), elementwise."""
        out = self.whole[b]
        inner = np.flatnonzero(out & (a < self.n))
        if len(inner):
            a, b = a[inner].astype(np.int64), b[inner].astype(np.int64)
            pair = a * self.n + b
            slot = (mix(pair.view(np.uint64) + np.uint64(1)) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)
            known = self.tried[slot]
            found = (known & 1).astype(bool)
            new = np.flatnonzero(known >> 1 != pair)
            if len(new):
                found[new] = self._stay_apart(a[new], b[new])
                self.tried[slot[new]] = pair[new] * 2 + found[new]
            out[inner] = found
        return out

    def _candidates(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """By length: the piece that begins at each place (rows) of each unit (columns), else -1."""
        size, found = len(codes), {}
        with np.errstate(over="ignore"):
            h = np.zeros(codes.shape, np.uint64)
            for m in range(1, min(size, self.longest) + 1):
                h = h[: size - m + 1] * _BASE + codes[m - 1 :]
                own = self._find(h.ravel())
                if m == 1 or (own >= 0).any():
                    found[m] = own.reshape(h.shape)
        return found

    def _advance(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """For every place of every unit: the piece its prefix ends in (n: a character that is no piece, or the start; -1: no encoding), and
        that piece's characters. codes: a row for each place, a column for each unit."""
        size, n = codes.shape
        cand = self._candidates(codes)
        best = np.full((size + 1, n), -np.inf)
        last = np.full((size + 1, n), -1, np.int32)
        step = np.ones((size + 1, n), np.int16)
        best[0], last[0] = 0, self.n
        for i in range(1, size + 1):
            starts = []
            for m, found in cand.items():
                if m <= i and len(at := np.flatnonzero((found[i - m] >= 0) & (last[i - m] >= 0))):
                    starts.append((m, at, found[i - m][at]))
            if starts:
                if self.bpe:
                    value = np.where(self._allowed(np.concatenate([last[i - m][at] for m, at, _ in starts]), np.concatenate([c for *_, c in starts])), 0.0, -np.inf)
                else:
                    value = np.concatenate([best[i - m][at] + self.score[c] for m, at, c in starts])
                done = 0
                for m, at, c in starts:
                    own = value[done : done + len(at)]
                    done += len(at)
                    up = own > best[i][at]
                    at = at[up]
                    best[i, at], last[i, at], step[i, at] = own[up], c[up], m
            none = np.flatnonzero((cand[1][i - 1] < 0) & (last[i - 1] >= 0))  # a character that is no piece: its bytes, and a boundary
            value = best[i - 1][none] + (0.0 if self.bpe else self.unknown)
            up = value > best[i][none]
            none = none[up]
            best[i, none], last[i, none], step[i, none] = value[up], self.n, 1
        return last, step, cand

    def encode_equal(self, units: list[str]) -> list[bytes]:
        """Ids (int32 bytes) of units of up to WINDOW characters, of one length or to be padded to the longest's."""
        n, sizes = len(units), np.array([len(u) for u in units])
        size = int(sizes.max())
        if n > 1 and n * size > _ADVANCE_CHARS:
            half = max(1, _ADVANCE_CHARS // size)
            return [x for a in range(0, n, half) for x in self.encode_equal(units[a : a + half])]
        codes = np.full((n, size), _PAD, np.uint64)
        codes[np.arange(size) < sizes[:, None]] = _codes("".join(units))
        last, step, _ = self._advance(np.ascontiguousarray(codes.T))
        pos, rows, path = sizes.copy(), np.arange(n), []
        while (pos > 0).any():
            path.append((np.where(pos > 0, last[pos, rows], -1), pos))
            pos = np.where(pos > 0, pos - step[pos, rows], 0)
        ids = np.stack([x[0] for x in path[::-1]], 1)
        plain, whole = (ids != self.n).all(1), last[sizes, rows] >= 0
        keep = ids >= 0
        raw, ends = ids[keep].astype(np.int32).tobytes(), (4 * np.cumsum(keep.sum(1))).tolist()
        out = [raw[a:b] for a, b in zip([0, *ends], ends)]
        for k in np.flatnonzero(~(whole & plain)).tolist():
            out[k] = self._with_bytes(units[k], [(t, int(x[1][k])) for t, x in zip(ids[k].tolist(), path[::-1]) if t >= 0]) if whole[k] else self.encode_one(units[k])
        return out

    def _with_bytes(self, unit: str, parts: list[tuple[int, int]]) -> bytes:
        """Ids of (piece or n, end): a character that is no piece gives the pieces of its bytes."""
        own: list[int] = []
        for t, end in parts:
            own += [self.bytes[b] for b in unit[end - 1].encode("utf-8", "surrogatepass")] if t == self.n else [t]
        return np.array(own, np.int32).tobytes()

    def encode_long(self, unit: str) -> bytes:
        """Ids of a unit of more than WINDOW characters of a BPE model, in windows that advance together."""
        size, stride = len(unit), WINDOW - OVERLAP
        codes, true = _codes(unit), np.full(size + 1, -1, np.int32)
        starts = list(range(0, max(1, size - OVERLAP), stride))
        most = max(1, _ADVANCE_CHARS // WINDOW)
        for a in range(0, len(starts), most):
            own = starts[a : a + most]
            block = np.full((len(own), WINDOW), _PAD, np.uint64)
            for k, s in enumerate(own):
                block[k, : min(WINDOW, size - s)] = codes[s : s + WINDOW]
            last, _, cand = self._advance(np.ascontiguousarray(block.T))
            for k, s in enumerate(own):
                end = min(s + WINDOW, size)
                mine = last[: end - s + 1, k]
                if s == 0:
                    true[: end + 1] = mine
                    continue
                i = s - stride + WINDOW  # known up to here
                same = mine[1 : i - s + 1] == true[s + 1 : i + 1]
                agreed = len(same) if same.all() else int(np.argmin(same[::-1]))
                while i < end and agreed < self.longest:
                    i += 1
                    true[i] = self._end(unit, true, i)
                    agreed = agreed + 1 if true[i] == mine[i - s] else 0
                true[i + 1 : end + 1] = mine[i - s + 1 :]
        if true[size] < 0:
            return self.encode_one(unit)
        parts, i = [], size
        while i:
            t = int(true[i])
            parts.append((t, i))
            i -= 1 if t == self.n else len(self.pieces[t])
        return self._with_bytes(unit, parts[::-1])

    def _end(self, unit: str, true: np.ndarray, i: int) -> int:
        """The piece that the prefix of i characters ends in, from those of the shorter prefixes."""
        for m in range(1, min(i, self.longest) + 1):
            c = self.ids.get(unit[i - m : i])
            if c is not None and true[i - m] >= 0 and self._allowed(true[i - m : i - m + 1], np.array([c], np.int32))[0]:
                return c
        return self.n if unit[i - 1] not in self.ids and true[i - 1] >= 0 else -1

    def encode_one(self, unit: str) -> bytes:
        """The same for one unit, without batches: merging for BPE (only units of which some prefix has no encoding come here), else the sums one end after the other."""
        if self.bpe:
            parts, at, own = self.merged(unit), 0, []
            for p in parts:
                own += [p] if p >= 0 else [self.bytes[b] for b in unit[at].encode("utf-8", "surrogatepass")]
                at += len(self.pieces[p]) if p >= 0 else 1
            return np.array(own, np.int32).tobytes()
        size = len(unit)
        best, step = [0.0] + [-np.inf] * size, [0] * (size + 1)
        for i in range(1, size + 1):
            if unit[i - 1] not in self.ids:
                best[i], step[i] = best[i - 1] + self.unknown, -1
            for m in range(1, min(i, self.longest) + 1):
                k = self.ids.get(unit[i - m : i])
                if k is not None and best[i - m] + self.scores[k] > best[i]:
                    best[i], step[i] = best[i - m] + self.scores[k], m
        own, i = [], size
        while i:
            own += [self.ids[unit[i - step[i] : i]]] if step[i] > 0 else [self.bytes[b] for b in reversed(unit[i - 1].encode("utf-8", "surrogatepass"))]
            i -= abs(step[i])
        return np.array(own[::-1], np.int32).tobytes()

    def encode_texts(self, texts: list[str], memory: dict[str, bytes]) -> list[np.ndarray]:
        """Ids of whole texts; memory holds units seen before."""
        out: list[list[bytes]] = [[] for _ in texts]
        for group in _groups(texts):
            units = [_UNIT.findall(t.replace(" ", MARK)) for _, t in group]
            if len(memory) > _MOST_UNITS:
                memory.clear()
            new: dict[int, list[str]] = {}
            for u in set().union(*units).difference(memory):
                size = len(u) if len(u) <= SHORT else -(-len(u) // SHORT) * SHORT if len(u) <= WINDOW else WINDOW + 1
                new.setdefault(size, []).append(u)
            long = new.pop(WINDOW + 1, [])
            memory.update((u, self.encode_long(u) if self.bpe else self.encode_one(u)) for u in long)
            for own in new.values():
                own.sort()
                memory.update(zip(own, self.encode_equal(own)))
            for (k, _), u in zip(group, units):
                out[k].append(b"".join(map(memory.__getitem__, u)))
            for u in long:
                del memory[u]
        return [np.frombuffer(b"".join(x), np.int32) for x in out]

    def decode_ids(self, ids) -> str:
        """The text of ids: bytes that are no UTF-8 become U+FFFD; the dummy prefix goes; other kinds of pieces have no text."""
        raw = b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw


@lru_cache(2)
def _loaded(path: str) -> Pieces:
    return Pieces.load(path)


def _groups(texts: list[str]):
    """Lists of (text's number, part of it) with about _BATCH_CHARS characters; parts end between units, the first of a text has the dummy prefix."""
    group, size = [], 0
    for k, t in enumerate(texts):
        start = 0
        while start < len(t):
            cut = _BETWEEN.search(t, start + _BATCH_CHARS - size) if start + _BATCH_CHARS - size < len(t) else None
            end = cut.start() if cut else len(t)
            group.append((k, (MARK if start == 0 else "") + t[start:end]))
            size += end - start
            start = end
            if size >= _BATCH_CHARS:
                yield group
                group, size = [], 0
    if group:
        yield group


def _slices(column: pa.Array):
    """(first, end, texts) of slices of a string column, of about _BATCH_CHARS bytes each; nulls are empty."""
    sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + _BATCH_CHARS, "right")))
        yield start, end, [t or "" for t in column.slice(start, end - start).to_pylist()]
        start = end


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "ids", model: str = MODEL, drop_text: bool = True) -> DataFrame:
    """Every row with its text's piece ids (array<int>); the text is left out unless drop_text is False.

    Null and empty texts have no ids. Rows, other columns and their order are as in docs, whatever they hold; a column named like out_col is replaced.
    """
    rows = docs.drop(out_col) if out_col != text_col else docs
    rest = [c for c in rows.columns if c != text_col or not drop_text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in rest) + f", `{out_col}` array<int>"

    def run(batches):
        pieces, memory = _loaded(model), {}
        for batch in batches:
            for a, b, texts in _slices(batch.column(text_col)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], _lists(pieces.encode_texts(texts, memory))], [*rest, out_col])

    return rows.transform(in_arrow, run, schema)


def decode(rows: DataFrame, ids_col: str = "ids", out_col: str = "text", model: str = MODEL) -> DataFrame:
    """Every row with the text of its ids in place of them; null ids give null."""
    rest = [c for c in rows.columns if c not in (ids_col, out_col)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in rest) + f"{', ' if rest else ''}`{out_col}` string"

    def run(batches):
        pieces = _loaded(model)
        for batch in batches:
            column = batch.column(ids_col)
            flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            texts = [pieces.decode_ids(flat[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(texts, pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False))], [*rest, out_col])

    return rows.transform(in_arrow, run, schema)


def tokens_of(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Every row with its other columns and, in place of the text: ids, n_tokens, ids_hash (xxhash64 of the ids), round_trip (whether decoding the ids gives the text again).

    Null and empty texts have no ids and round-trip as empty. A text that holds U+2581, the word mark itself, decodes to spaces there, as in the library, and does not
    round-trip. Columns named like the four are replaced. Encoding and decoding are one pass, so that a task has one Python worker and texts don't come back.
    """
    added = ("ids", "n_tokens", "ids_hash", "round_trip")
    rows = docs.drop(*(c for c in added if c != text_col))
    rest = [c for c in rows.columns if c != text_col]
    schema = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in rest) + "ids array<int>, round_trip boolean"

    def run(batches):
        pieces, memory = _loaded(model), {}
        for batch in batches:
            for a, b, texts in _slices(batch.column(text_col)):
                part, ids = batch.slice(a, b - a), pieces.encode_texts(texts, memory)
                same = [pieces.decode_ids(x.tolist()) == t for x, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], _lists(ids), pa.array(same, pa.bool_())], [*rest, "ids", "round_trip"])

    coded = rows.transform(in_arrow, run, schema)
    return coded.select(*[F.col(f"`{c}`") for c in rest], "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return tokens_of(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "ids_hash", "round_trip", "ids")
