"""Packing documents into token sequences: best fit, then swap-based local search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Pieces that one task packs.
BUCKET = 20_000


# Fixed value: how the byte-level pre-tokenizer of the tokenizers library cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str):
    """A function from texts to the ids that the tokenizers library gives them, without added special tokens.

    The file's vocabulary and added tokens are loaded into tiktoken, which encodes several times
    as fast; a few texts are held against the library itself at once, and files of other
    kinds are refused. Strings of added tokens in a text have these tokens' ids.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(tokenizer_file, encoding="utf-8") as f:
        spec = json.load(f)
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or {k: (spec["pre_tokenizer"] or {}).get(k) for k in plain} != plain:
        raise ValueError("only byte-level BPE files without normalizer and prefix space are supported")
    if any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that reach beyond their string are not supported")
    special, letters = {t["content"]: t["id"] for t in spec["added_tokens"]}, byte_letters()
    ranks = {bytes(map(letters.__getitem__, piece)): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    library, encode = Tokenizer.from_file(tokenizer_file), lambda text: own.encode(text, allowed_special="all")
    for text in ("It's  12 o'clock\n\n\tnaïve 中文 \U0001f600 x1y2 ", *(f"a {t} b{t}" for t in special)):
        if encode(text) != library.encode(text, add_special_tokens=False).ids:
            raise ValueError(f"{tokenizer_file} is not encoded as the library does")
    return encode


def pieces(docs: DataFrame, tokenizer_file: str, limit: int = 2048, end: int = 0, doc_id: str = "doc_id", text: str = "text", payload: bool = False) -> DataFrame:
    """Token pieces of every row: ``doc_id, piece, start, length, ids_crc32`` and, with
    ``payload``, ``ids``.

    A document is its text's ids (``encoder``; null counts as empty) and then the id
    ``end``. Documents of more than ``limit`` ids, and only they, are cut into pieces of
    ``limit`` ids, of which the first may be shorter.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * payload
        for b in batches:
            out: list[list] = [[] for _ in names]
            for key, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.array([*encode(t.as_py() or ""), end], dtype="<u4")
                first = len(ids) % limit if len(ids) > limit else len(ids)
                cuts = [0, *range(first or limit, len(ids), limit), len(ids)]
                for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[lo:hi]
                    for column, x in zip(out, (key, i, lo, hi - lo, zlib.crc32(part.tobytes()), part.astype("<i4"))):
                        column.append(x)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * payload
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, schema)


def best_fit(sizes: list[int], limit: int) -> list[list[int]]:
    """Bins of indices: each item, largest first, goes where the least space is left over."""
    by_space: list[list[int]] = [[] for _ in range(limit + 1)]
    open_spaces, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        if above := open_spaces >> size:
            space = size + (above & -above).bit_length() - 1
            k = by_space[space].pop()
            if not by_space[space]:
                open_spaces &= ~(1 << space)
            bins[k].append(i)
        else:
            space, k = limit, len(bins)
            bins.append([i])
        if left := space - size:
            by_space[left].append(k)
            open_spaces |= 1 << left
    return bins


class _Exchanges:
    """What the underfull bins can do for a giver: their spaces, alone and with one or two items taken back.

    Items of one size are alike, so a bin offers each size, and each pair of sizes, once. A changed bin
    is entered anew and its old entries are struck out.
    """

    def __init__(self):
        self.bin, self.room, self.back = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.live = np.empty(0, bool)

    def enter(self, entries: list[tuple[int, int, np.ndarray]]) -> None:
        """Enters (bin, space, sizes or sums that it can return) for each of the bins."""
        changed = [b for b, _, _ in entries]
        keep = self.live & ~np.isin(self.bin, changed)
        self.bin = np.concatenate([self.bin[keep], *(np.full(len(back), b) for b, _, back in entries)])
        self.room = np.concatenate([self.room[keep], *(space + back for _, space, back in entries)])
        self.back = np.concatenate([self.back[keep], *(back for _, _, back in entries)])
        self.live = np.ones(len(self.bin), bool)

    def best(self, giver: int, gifts: np.ndarray, fill: np.ndarray) -> tuple[int, int, int] | None:
        """(bin, gift, return) with the largest increase of squared fill, if any increases it."""
        if not len(gifts) or not len(self.bin):
            return None
        at = np.searchsorted(gifts, self.room, side="right") - 1
        gift = gifts[np.maximum(at, 0)]
        gain = gift - self.back
        # (fb + g)^2 + (fa - g)^2 - fb^2 - fa^2
        increase = np.where((at >= 0) & (gain > 0) & (self.bin != giver), 2 * gain * (fill[self.bin] - fill[giver] + gain), 0)
        k = int(increase.argmax())
        return (int(self.bin[k]), int(gift[k]), int(self.back[k])) if increase[k] > 0 else None


def _sums(items: list[int], most: int) -> dict[int, tuple[int, ...]]:
    """Sizes of up to ``most`` of the items, each sum with one choice that has it, fewest items first."""
    sizes = sorted(set(items))
    out: dict[int, tuple[int, ...]] = {}
    for x in sizes:
        out.setdefault(x, (x,))
    if most > 1:
        twice = {x for x in sizes if items.count(x) > 1}
        for i, x in enumerate(sizes):
            for y in ([x] if x in twice else []) + sizes[i + 1 :]:
                out.setdefault(x + y, (x, y))
    return out


def local_search(bins: list[list[int]], sizes: list[int], limit: int) -> list[list[int]]:
    """Empties underfull bins by moves and exchanges, each of which increases squared fill.

    The emptiest bin gives: one or two items move to another underfull bin, against none, one
    or two of its items that are smaller together; of all such steps the one with the largest
    increase is taken. The search ends when no bin has a step left, or when there are as few
    bins as the sum of the sizes allows.
    """
    held = [[sizes[i] for i in b] for b in bins]
    fill = np.array([sum(h) for h in held], np.int64)
    least = -(-int(fill.sum()) // limit)
    under = {k for k in range(len(bins)) if 0 < fill[k] < limit}
    if len(bins) <= least or len(under) < 2:
        return [b for b in bins if b]
    offers = _Exchanges()

    def entry(k: int) -> tuple[int, int, np.ndarray]:
        return k, limit - int(fill[k]), np.array([0, *_sums(held[k], 2)], np.int64) if 0 < fill[k] < limit else np.empty(0, np.int64)

    offers.enter([entry(k) for k in under])
    count, heap, moved = len([b for b in bins if b]), [], True
    stuck: set[tuple[int, ...]] = set()  # contents of givers that have no step as the offers stand
    while count > least:
        if not heap:
            if not moved:
                break
            heap, moved = sorted((int(fill[k]), k) for k in under), False
        f, a = heappop(heap)
        if a not in under or f != fill[a] or (content := tuple(sorted(held[a]))) in stuck:
            continue
        gifts = _sums(held[a], 2)
        step = offers.best(a, np.array(sorted(gifts), np.int64), fill)
        if step is None:
            stuck.add(content)
            continue
        b, gift, back = step
        give, take = gifts[gift], _sums(held[b], 2)[back] if back else ()
        for source, target, sent in ((a, b, give), (b, a, take)):
            for size in sent:
                held[source].remove(size)
                held[target].append(size)
                i = next(i for i in bins[source] if sizes[i] == size)
                bins[source].remove(i)
                bins[target].append(i)
        fill[a] -= gift - back
        fill[b] += gift - back
        count -= not bins[a]
        under -= {k for k in (a, b) if not 0 < fill[k] < limit}
        offers.enter([entry(a), entry(b)])
        stuck, moved = set(), True
        for k in under & {a, b}:
            heappush(heap, (int(fill[k]), k))
    return [b for b in bins if b]


def pack(sizes: list[int], limit: int) -> list[list[int]]:
    """Bins of indices of ``sizes``, none over ``limit``: best fit, then local search."""
    return local_search(best_fit(sizes, limit), sizes, limit)


def pack_documents(docs: DataFrame, tokenizer_file: str, limit: int = 2048, end: int = 0, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """Every piece and its place: ``pieces`` and ``sequence_id, offset``.

    Sequences hold at most ``limit`` ids, and their pieces stand gapless from 0. Pieces are
    dealt by hash over buckets of about ``bucket`` pieces, each packed by itself, so no
    task grows with the input and no source, copy or long document is hot; more input makes
    more buckets. What stands in sequences that are half full at most is dealt and packed
    again, until one bucket holds it or nothing is won. Null and empty texts are documents of
    one id; repeated rows and doc_ids and null doc_ids are each packed as they stand; of a very
    long text all ids are held at once; other columns play no part; an empty table gives an
    empty result.
    """
    rows = cut(pieces(docs, tokenizer_file, limit, end, doc_id, text), "packing-pieces")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, filled long"

    def packed(rows: DataFrame, n: int, base: int) -> DataFrame:
        def place(t: pa.Table) -> pa.Table:
            t = t.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "start", "ids_crc32")])
            sizes = t["length"].to_pylist()
            sequence, offset, filled = (np.zeros(len(sizes), dtype=np.int64) for _ in range(3))
            first = base + t["bucket"][0].as_py() << 32
            for k, items in enumerate(pack(sizes, limit)):
                at = 0
                for i in items:
                    sequence[i], offset[i] = first + k, at
                    at += sizes[i]
                filled[items] = at
            t = t.drop_columns("bucket")
            for name, column in (("sequence_id", sequence), ("offset", offset), ("filled", filled)):
                t = t.append_column(name, pa.array(column))
            return t

        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(n)).cast("int"))
        return dealt.groupBy("bucket").applyInArrow(place, schema)

    count, base, parts = rows.count(), 0, []
    while True:
        n = max(1, -(-count // bucket))
        done = packed(rows, n, base)
        base += n
        if n == 1:
            parts.append(done)
            break
        done = cut(done, "packing-places")
        rows = done.where(F.col("filled") <= limit // 2).drop("sequence_id", "offset", "filled")
        left = rows.count()
        if not left or left > count // 2:  # nothing to win: most of it fits with nothing else
            parts.append(done)
            break
        parts.append(done.where(F.col("filled") > limit // 2))
        count = left
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("filled")
