"""Benchmark decontamination by pigeonhole edit matching.

Texts and benchmark items are normalised (lower case; every run of characters that are no letters, digits or underscores is one space), and have a space at
both ends, so that words count as wholes. An item with an error budget of e edits is split into e + 1 pieces: a passage within e edits holds at least one piece unchanged. Cuts are even, unless a piece
would be one that many items share (a template): then pieces of one size, each disjoint from the others, are laid where the benchmark's grams are rarest. The rule holds for any e + 1 disjoint pieces, so
that changes which places are looked at and no result.

The benchmark stays a table. Its pieces' hashes make a Bloom filter of bounded size, which is all that is sent to the tasks; one scan of the texts looks all windows of the pieces'
lengths up in it and keeps the few hits; these are joined with the table of pieces, which places items in texts; and Myers' bit-parallel distance decides about each place
at which at most e of the item's disjoint three-character parts are missing (each missing part takes an edit).
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, forget, in_arrow, mix

#: One edit for so many characters of an item.
CHARS_PER_EDIT = 16
#: Bloom filter: bits for each piece, at most 2**FILTER_BITS in all (128 MB) in FILTER_PARTS parts, probed so many times. Beyond 2**FILTER_BITS / BITS_PER_PIECE pieces more hits are wrong, and go at the join.
BITS_PER_PIECE, FILTER_BITS, FILTER_PARTS, PROBES = 24, 30, 64, 6
#: Characters of texts that are hashed at once; items of which a text meets about so many in one row; text hashes that are broadcast at most.
SLICE, ITEMS_PER_ROW, BROADCAST_ROWS = 1 << 19, 4096, 1 << 20
#: Characters of the grams whose number of items tells rare places of the benchmark from common ones; buckets of that count (2**COUNT_BITS longs come to the driver at most).
GRAM, COUNT_BITS = 8, 20
#: Pieces become shorter than even ones only where more items than this share one, as short pieces are found in more texts.
COMMON = 16
#: Characters of the parts of an item of which no more than its edits may be missing.
PART = 3
_GAP = re.compile(r"\W+")
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def normalise(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip(" ")


def budget(item: str, chars_per_edit: int = CHARS_PER_EDIT) -> int:
    return len(item) // chars_per_edit


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): edits + 1 pieces that make up the item."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b]


def _packed(allowed: np.ndarray, size: int, most: int) -> list[int]:
    """Starts, of those allowed (ascending), of at most `most` disjoint windows: the leftmost choice, which has as many as there can be."""
    found: list[int] = []
    at = 0
    while len(found) < most and at < len(allowed):
        found.append(int(allowed[at]))
        at = int(np.searchsorted(allowed, found[-1] + size))
    return found


def rare_pieces(item: str, edits: int, counts: np.ndarray) -> list[tuple[int, str]]:
    """edits + 1 disjoint pieces, as pieces() has them unless one of those is common. counts: of each gram of the item, in how many items it is; a piece is as common as the rarest of its grams.

    Of sizes from the even one down to GRAM, that counts whose most common piece is rarest; each change must halve it, and sizes below the even one are tried only while more than COMMON items share a piece.
    """
    even = pieces(item, edits)
    widest = len(item) // (edits + 1)
    if not edits or widest <= GRAM:
        return even
    least = max(int(counts[a : a + len(x) - GRAM + 1].min()) for a, x in even)
    for size in sorted({widest, (widest + GRAM) // 2, GRAM}, reverse=True):
        if least <= (1 if size == widest else COMMON):
            break
        worth = np.lib.stride_tricks.sliding_window_view(counts, size - GRAM + 1).min(axis=1)
        levels = np.unique(worth)
        low, high = 0, len(levels) - 1  # the highest level admits all starts, so it has room for all pieces
        while low < high:
            mid = (low + high) // 2
            if len(_packed(np.flatnonzero(worth <= levels[mid]), size, edits + 1)) > edits:
                high = mid
            else:
                low = mid + 1
        if 2 * int(levels[low]) <= least:
            least = int(levels[low])
            even = [(a, item[a : a + size]) for a in _packed(np.flatnonzero(worth <= levels[low]), size, edits + 1)]
    return even


@lru_cache(1 << 14)
def _parts(pattern: str) -> list[str]:
    return [pattern[i : i + PART] for i in range(0, len(pattern) - PART + 1, PART)]


def _hopeless(pattern: str, region: str, edits: int) -> bool:
    """Whether more than `edits` disjoint parts of pattern are nowhere in region."""
    left = edits
    for part in _parts(pattern):
        if part not in region:
            if not left:
                return True
            left -= 1
    return False


def peq(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def myers_end(pattern: str, text: str, most: int, bits: dict[str, int] | None = None) -> tuple[int, int] | None:
    """(distance, end) of the substring of text nearest to pattern (the first end of the least distance), if within `most` edits."""
    m = len(pattern)
    bits = peq(pattern) if bits is None else bits
    ones, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = ones, 0, m, most + 1, -1
    for j, c in enumerate(text):
        eq = bits.get(c, 0)
        x = eq | vn
        d0 = ((vp + (x & vp)) ^ vp) | x
        hn = vp & d0
        hp = vn | (ones & ~(vp | d0))
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & ones  # a match may begin anywhere: row 0 stays 0
        hn = hn << 1 & ones
        vp = hn | (ones & ~(d0 | hp))
        vn = hp & d0
        if score < best:
            best, end = score, j + 1
            if best == 0:
                break
    return (best, end) if end >= 0 else None


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class WindowHashes:
    """Hashes of all windows of a string, by the sums of its codes times powers of a base that has an inverse modulo 2**64."""

    def __init__(self, n: int):
        self.up, self.down = _powers(n + 1, _BASE), _powers(n + 1, _BACK)

    def sums(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * self.down[: len(codes)], dtype=np.uint64)])

    def of(self, sums: np.ndarray, size: int) -> np.ndarray:
        """The hash of each window of `size` characters; none if the string is shorter."""
        n = len(sums) - size
        return mix((sums[size:] - sums[:n]) * self.up[size - 1 : size - 1 + n] + np.uint64(size)) if n > 0 else np.empty(0, np.uint64)


def _slots(h: np.ndarray, bits: int, probe: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h + np.uint64((probe * _BASE) % (1 << 64))) >> np.uint64(64 - bits)).astype(np.int64)


def _buckets(text: str) -> np.ndarray:
    """The bucket of each gram of a text."""
    hashes = WindowHashes(len(text))
    return (hashes.of(hashes.sums(text), GRAM) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _items(bench: DataFrame, id_col: str, text_col: str, chars_per_edit: int) -> tuple[DataFrame, DataFrame]:
    """(ik, item, norm) of the items that have words, and their pieces (key, ik, at, size)."""
    rows = bench.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    kind = rows.schema["item"].dataType.simpleString()

    def clean(batches):
        for batch in batches:
            norm = [normalise(t) for t in batch.column("text").to_pylist()]
            keep = pa.array([bool(t) for t in norm], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("item").filter(keep), pa.array([t for t in norm if t], pa.string())], ["item", "norm"])

    items = cut(rows.transform(in_arrow, clean, f"item {kind}, norm string").withColumn("ik", F.monotonically_increasing_id()), "leak-items")

    def grams(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.concatenate([np.empty(0, np.int64), *(np.unique(_buckets(f" {t} ")) for t in batch.column("norm").to_pylist())]), pa.int64())})

    # Items that share a bucket: a row for each bucket at most. It only guides the cuts, so buckets may stand for several grams.
    shared = items.select("norm").transform(in_arrow, grams, "bucket bigint").groupBy("bucket").count().filter("count > 1").toArrow()
    counts = np.ones(1 << COUNT_BITS, np.int64)
    counts[shared.column("bucket").to_numpy()] = shared.column("count").to_numpy()
    shared_counts = bench.sparkSession.sparkContext.broadcast(counts)

    def split(batches):
        for batch in batches:
            out = []
            for ik, norm in zip(batch.column("ik").to_pylist(), batch.column("norm").to_pylist()):
                text = f" {norm} "
                for at, piece in rare_pieces(text, budget(norm, chars_per_edit), shared_counts.value[_buckets(text)]):
                    hashes = WindowHashes(len(piece))
                    out.append((int(hashes.of(hashes.sums(piece), len(piece)).view(np.int64)[0]), ik, at, len(piece)))
            yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(("key", "ik", "at", "size"), zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))})

    return items, cut(items.select("ik", "norm").transform(in_arrow, split, "key bigint, ik bigint, at int, size int"), "leak-pieces")


def _filter(found: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """The Bloom filter of n pieces' keys: (bits, bytes). What comes to the driver is 2**FILTER_BITS bits at most, whatever the benchmark's size."""
    bits = min(max(int(n * BITS_PER_PIECE).bit_length(), 16), FILTER_BITS)
    width = 1 << bits - 3

    def spread(batches):
        for batch in batches:
            h = batch.column("key").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_pydict({"slot": pa.array(np.concatenate([_slots(h, bits, k) for k in range(PROBES)]), pa.int64())})

    def fill(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = batch.column("slot").to_numpy()
            for part in np.unique(slots * FILTER_PARTS >> bits).tolist():
                own = slots[slots * FILTER_PARTS >> bits == part] - (part * (1 << bits) // FILTER_PARTS)
                np.bitwise_or.at(parts.setdefault(part, np.zeros(width // FILTER_PARTS, np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
        for part, x in parts.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "raw": pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())})

    slots = found.select("key").transform(in_arrow, spread, "slot bigint").distinct()
    out = np.zeros((FILTER_PARTS, width // FILTER_PARTS), np.uint8)
    for r in slots.repartition(FILTER_PARTS, F.shiftright(F.col("slot"), bits - FILTER_PARTS.bit_length() + 1)).transform(in_arrow, fill, "part int, raw binary").collect():
        out[r["part"]] |= np.frombuffer(zlib.decompress(r["raw"]), np.uint8)
    return bits, out.ravel()


def _text_keys(text_col: str):
    """128 bits that stand for a text."""
    return F.xxhash64(F.lit(1), text_col).alias("t1"), F.xxhash64(F.lit(2), text_col).alias("t2")


def _hits(rows: DataFrame, sizes: list[int], bloom) -> DataFrame:
    """rows: (id, text). (id, t1, t2, hits) of each row: keys and places of windows that may be pieces."""
    rest = rows.select("id", *_text_keys("text"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    one = pa.struct([("key", pa.int64()), ("pos", pa.int32())])

    def run(batches):
        bits, raw = bloom.value
        longest = max(sizes, default=1)
        hashes = WindowHashes(SLICE + longest)

        def probe(h: np.ndarray) -> np.ndarray:
            at = np.arange(len(h))
            for k in range(PROBES):
                slot = _slots(h[at], bits, k)
                at = at[(raw[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
            return at

        for batch in batches:
            texts, ends, found = [], [], []
            done = total = 0
            column = batch.column("text")

            def flush():
                flat, where = "\0".join(texts), np.cumsum([0, *(len(t) + 1 for t in texts)])
                key, pos = [], []
                for a in range(0, len(flat), SLICE):
                    sums = hashes.sums(flat[a : a + SLICE + longest - 1])
                    for size in sizes:
                        h = hashes.of(sums, size)[:SLICE]
                        at = probe(h)
                        key.append(h[at])
                        pos.append(at + a)
                key, pos = np.concatenate(key or [np.empty(0, np.uint64)]), np.concatenate(pos or [np.empty(0, np.int64)])
                order = np.argsort(pos, kind="stable")
                key, pos = key[order].view(np.int64), pos[order]
                row = np.searchsorted(where, pos, "right") - 1
                found.append((key, pos - where[row], np.bincount(row, minlength=len(texts))[: len(texts)]))
                texts.clear()

            for k in range(batch.num_rows):
                t = normalise(column[k].as_py())
                texts.append(f" {t} " if t else "")
                total += len(t)
                if total >= SLICE:
                    flush()
                    total = 0
            if texts:
                flush()
            offsets = np.concatenate([[0], *(np.asarray(n) for *_, n in found)]).cumsum().astype(np.int32)
            both = [pa.array(np.concatenate([f[0] for f in found]) if found else [], pa.int64()), pa.array(np.concatenate([f[1] for f in found]).astype(np.int32) if found else [], pa.int32())]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(both, fields=list(one)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t1"), batch.column("t2"), lists], ["id", "t1", "t2", "hits"])

    return rest.transform(in_arrow, run, f"id {kind}, t1 bigint, t2 bigint, hits array<struct<key:bigint,pos:int>>")


def spans(text: str, norm: str, starts: list[int], edits: int) -> list[tuple[int, int, int]]:
    """(start, end, distance) in the normalised text of an item's places; starts: where the item with its spaces may begin in the text with its spaces."""
    pattern = f" {norm} "
    bits, m, done, found = None, len(pattern), -1, []
    for start in sorted(starts):
        if start + m <= done:  # inside what has been matched
            continue
        if start >= 0 and text.startswith(pattern, start):
            end, d = start + m, 0
        else:
            low = max(0, start - edits)
            region = text[low : start + m + edits]
            if _hopeless(pattern, region, edits):
                continue
            bits = bits or peq(pattern)
            hit = myers_end(pattern, region, edits, bits)
            if not hit:
                continue
            d, end = hit[0], low + hit[1]
        # The text has one space before and after it, the item too.
        stop = min(max(end - 2, 0), len(text) - 2)
        found.append((max(0, stop - len(norm)), stop, d))
        done = end
    return found


def _matches(docs: DataFrame, bench: DataFrame, text_col: str, id_col: str | None, item_col: str, item_text_col: str, chars_per_edit: int) -> tuple[DataFrame, DataFrame]:
    """(id, t1, t2) of each row, and (t1, t2, spans) of the texts that items match."""
    spark = docs.sparkSession
    rows = docs.select((F.col(id_col) if id_col else F.lit(0)).alias("id"), F.col(text_col).alias("text"))
    items, found = _items(bench, item_col, item_text_col, chars_per_edit)
    kind = items.schema["item"].dataType.simpleString()
    n, n_items = found.count(), items.count()
    sizes = sorted(r["size"] for r in found.select("size").distinct().collect())  # chars_per_edit + 2 at most
    hits = cut(_hits(rows, sizes, spark.sparkContext.broadcast(_filter(found, n))), "leak-hits")
    placed = hits.select("t1", "t2", F.inline("hits")).join(found, "key").groupBy("t1", "t2", "ik").agg(F.collect_set(F.col("pos") - F.col("at")).alias("starts"))
    # A text meets its items in rows of about ITEMS_PER_ROW at most.
    own = F.struct("item", "norm", "starts")
    asked = placed.join(items, "ik").groupBy("t1", "t2", F.pmod(F.xxhash64("ik"), F.lit(n_items // ITEMS_PER_ROW + 1)).alias("block")).agg(F.collect_list(own).alias("items"))
    asked = cut(asked, "leak-asked")
    wanted = asked.select("t1", "t2").distinct()
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = rows.filter(F.col("text").isNotNull()).select(*_text_keys("text"), "text").join(side, ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.first("text").alias("text"))
    one = pa.struct([("item", pa.null()), ("start", pa.int32()), ("end", pa.int32()), ("distance", pa.int32())])

    def verify(batches):
        for batch in batches:
            t1, t2, out = [], [], []
            kind = batch.schema.field("items").type.value_type.field("item").type
            for k in range(batch.num_rows):
                text = f" {normalise(batch.column('text')[k].as_py())} "
                got = []
                for x in batch.column("items")[k].as_py():
                    got += [{"item": x["item"], "start": a, "end": b, "distance": d} for a, b, d in spans(text, x["norm"], x["starts"], budget(x["norm"], chars_per_edit))]
                if got:
                    got.sort(key=lambda g: (g["item"] is None, g["item"] if g["item"] is not None else 0, g["start"], g["end"]))
                    t1.append(batch.column("t1")[k])
                    t2.append(batch.column("t2")[k])
                    out.append(got)
            fields = pa.struct([pa.field("item", kind), *list(one)[1:]])
            yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in t1], pa.int64()), pa.array([x.as_py() for x in t2], pa.int64()), pa.array(out, pa.list_(fields))], ["t1", "t2", "spans"])

    schema = f"t1 bigint, t2 bigint, spans array<struct<item:{kind},start:int,end:int,distance:int>>"
    right = texts.join(asked, ["t1", "t2"]).select("t1", "t2", "text", "items").transform(in_arrow, verify, schema)
    right = cut(right.groupBy("t1", "t2").agg(F.flatten(F.collect_list("spans")).alias("spans")), "leak-found")
    forget(items, found, asked)
    return hits.select("id", "t1", "t2"), right


def decontaminate(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", chars_per_edit: int = CHARS_PER_EDIT
) -> DataFrame:
    """One row per input row: id, spans (array of item, start, end, distance in the normalised text).

    An item matches a text that holds a passage within len(item) // chars_per_edit edits of it, both normalised and with a space at both ends: an item of one word is not found
    inside another word, and of longer items a missing border of words is an edit. Ids of rows and items are of any type that has an order. Items without letters or digits match nothing; an item with a
    null id matches as any other, and is a null in lists; repeated items each have their spans; null and empty texts match nothing; without items each row comes with no spans. Texts with equal 128-bit hashes count as equal.
    Other columns are ignored.
    """
    rows, found = _matches(docs, bench, text_col, id_col, item_col, item_text_col, chars_per_edit)
    none = F.array().cast(found.schema["spans"].dataType)
    return rows.join(found, ["t1", "t2"], "left").select(F.col("id").alias(id_col), F.coalesce("spans", none).alias("spans"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """The rows of docs, with all their columns, that no item matches. The hashes of matched texts are broadcast if they are BROADCAST_ROWS at most, which is counted; else the rows are shuffled."""
    _, found = _matches(docs, bench, text_col, None, item_col, item_text_col, chars_per_edit)
    bad = found.select("t1", "t2")
    side = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.select(F.struct("*").alias("row"), *_text_keys(text_col)).join(side, ["t1", "t2"], "left_anti").select("row.*")


def by_document(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per row of matches: id, contaminated, items (sorted distinct), n_spans, least_distance (null if none)."""
    return matches.select(
        id_col, (F.size("spans") > 0).alias("contaminated"), F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item"]))).alias("items"),
        F.size("spans").alias("n_spans"), F.array_min(F.transform("spans", lambda s: s["distance"])).alias("least_distance"),
    )


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return by_document(decontaminate(docs, bench))
