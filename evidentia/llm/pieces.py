"""SentencePiece encoding and decoding for merge-type vocabularies, by an agenda of pairs.

The agenda holds adjacent symbol pairs whose join is a piece, best score first, leftmost
among equals; popping one merges it and enters the two pairs that it makes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Distinct segments whose ids a Python worker keeps, and the longest that it keeps.
CACHE, CACHE_CHARS = 400_000, 48
#: New words that one call to the library checks, as one text.
CHECKED = 100
#: Segments up to this length keep their agenda in a list, longer ones in a heap.
SHORT = 64
#: The rank of a pair that is no piece.
NEVER = float("inf")


class PieceCodec:
    """Encodes and decodes as the sentencepiece library does with the same model file.

    For BPE models with byte fallback, a dummy prefix and no other normalisation; other
    models are refused. ``check``: ``"segments"`` holds the ids and the decoding of every new
    segment (a run of spaces and the word after it) against the library, a batch at a time, and
    of every batch one whole text; ``"texts"`` holds every whole text and its decoding against
    it, which takes about 1.7 times the time; None checks nothing. A difference raises.
    """

    def __init__(self, model_file: str, check: str | None = "segments"):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.check = check
        lib, n = self.library, self.library.get_piece_size()
        if lib.normalize(" ﬁ  é\t") != f"{SPACE * 2}ﬁ{SPACE * 2}é\t":
            raise ValueError("only models that replace spaces and add one prefix space are supported")
        self.bos, self.eos = lib.bos_id(), lib.eos_id()
        self.rank, self.ids, self.raw = {}, {}, [b""] * n
        self.bytes = [None] * 256
        for i in range(n):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif lib.is_unused(i):
                raise ValueError("vocabularies with unused pieces are not supported")
            elif not lib.is_control(i) and not lib.is_unknown(i):
                self.rank[piece], self.ids[piece] = -lib.get_score(i), i
                self.raw[i] = piece.replace(SPACE, " ").encode()
        if None in self.bytes:
            raise ValueError("only models with byte fallback are supported")
        #: Pieces never run on from a word into a space, so words can be encoded apart.
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.rank)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._rank = self.rank.get
        self._one = {c: i.to_bytes(4, "little") for c, i in self.ids.items()}

    def _short_agenda(self, text: str) -> list[str]:
        """Symbols of a short text: its agenda is the list of all pairs' ranks, of which the first least one is next."""
        rank = self._rank
        symbols = [*text]
        agenda = [rank(p, NEVER) for p in map(add, text, text[1:])]
        while agenda and (best := min(agenda)) < NEVER:
            i = agenda.index(best)
            symbols[i] = piece = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + piece, NEVER)
            if i < len(agenda):
                agenda[i] = rank(piece + symbols[i + 1], NEVER)
        return symbols

    def _agenda(self, text: str) -> list[str]:
        if len(text) <= SHORT:
            return self._short_agenda(text)
        rank, n = self.rank.get, len(text)
        agenda = [(r, i, p) for i, p in enumerate(map(add, text, text[1:])) if (r := rank(p)) is not None]
        symbols: list[str | None] = list(text)
        if not agenda:
            return symbols
        heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, piece = heappop(agenda)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or left + symbols[j] != piece:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = piece, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(p := piece + symbols[k])) is not None:
                    heappush(agenda, (r, i, p))
            if (h := before[i]) >= 0 and (r := rank(p := symbols[h] + piece)) is not None:
                heappush(agenda, (r, h, p))
        return [s for s in symbols if s is not None]

    def _segment(self, text: str) -> bytes:
        """Ids of a piece of normalised text, as little-endian unsigned 32-bit integers."""
        one = self._one
        try:
            return b"".join([one[s] for s in self._agenda(text)])
        except KeyError:  # a character without a piece is its bytes
            return b"".join([one[s] if s in one else b"".join(self.bytes[b].to_bytes(4, "little") for b in s.encode()) for s in self._agenda(text)])

    def _new(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words, each without the one space before it, held against the library."""
        found = {w: self._segment(SPACE + w) for w in words}
        if self.check == "segments":
            own = [w for w in words if w]  # a space alone is no word after others
            for at in range(0, len(own), CHECKED):
                part = own[at : at + CHECKED]
                ids = self.library.encode(" ".join(part).replace(SPACE, " "))
                raw = b"".join([found[w] for w in part])
                if np.array(ids, dtype="<u4").tobytes() != raw or self.decode(raw) != self.library.decode(ids):
                    raise AssertionError(f"the library encodes {part!r} as {ids}")
        return found

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word; words met lately stay in one of two generations of the cache."""
        try:
            return [self.cache[w] for w in words]
        except KeyError:
            pass
        if len(self.cache) > CACHE // 2:
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        missing = [w for w in dict.fromkeys(words) if w not in cache]
        found = {w: older[w] for w in missing if w in older}
        found |= self._new([w for w in missing if w not in found])
        cache |= {w: ids for w, ids in found.items() if len(w) <= CACHE_CHARS}
        return [found[w] if w in found else cache[w] for w in words]

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` without begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.apart:
            return self._segment(SPACE + text.replace(" ", SPACE))
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            normal = SPACE + text.replace(" ", SPACE)
            words = [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]*", normal)]
        else:
            words = text.split(" ")
        return b"".join(self._of_words(words))

    def decode(self, ids: bytes) -> str:
        """Text of ids as ``encode`` gives them; begin, end and other control ids are nothing."""
        raw = self.raw
        text = b"".join([raw[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(model_file: str, check: str | None) -> PieceCodec:
    """One codec, with its cache, for all batches of a Python worker."""
    return PieceCodec(model_file, check)


def encode_documents(docs: DataFrame, model_file: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", check: str | None = "segments") -> DataFrame:
    """``keep``, ``ids`` (array of int, with begin and end id) and ``decoded`` for each row.

    A null or empty text has the begin and end id alone and decodes to the empty text.
    Ids and decoding are held against the library's, a batch at a time, and a difference
    raises (``check``, see ``PieceCodec``). Very long texts are encoded whole. Equal
    texts get equal ids; repeated rows, ties and other columns change nothing; an
    empty table gives an empty result. ``model_file`` is a path on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file, check)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [x or "" for x in part.column(len(keep)).to_pylist()]
                inner, lengths, decoded = [], [0], []
                for t, raw in zip(texts, _encoded(c, texts)):
                    inner.append(raw)
                    lengths.append(lengths[-1] + len(raw) // 4)
                    decoded.append(c.decode(raw))
                values = pa.array(np.frombuffer(b"".join(inner), dtype="<i4"))
                ids = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], ids, pa.array(decoded, pa.string())], names=[*keep, "ids", "decoded"])

    picked = docs.select(*keep, F.col(text).alias("__text"))
    schema = picked.drop("__text").select("*", F.array(F.lit(0)).alias("ids"), F.lit("").alias("decoded")).schema
    return picked.mapInArrow(run, schema)


def _encoded(c: PieceCodec, texts: list[str]) -> list[bytes]:
    """Ids of each text of a batch with begin and end id; whole texts, or one of them, held against the library."""
    begin, end = (i.to_bytes(4, "little") for i in (c.bos, c.eos))
    out = [begin + c.encode(t) + end for t in texts]
    checked = {"texts": texts, "segments": texts[:1]}.get(c.check)
    if checked:
        want = c.library.encode(checked, add_bos=True, add_eos=True, num_threads=1)
        for t, raw, ids, back in zip(checked, out, want, c.library.decode(want, num_threads=1)):
            if np.array(ids, dtype="<u4").tobytes() != raw or c.decode(raw) != back:
                raise AssertionError(f"the library differs on {t[:200]!r}")
    return out


def digest_documents(docs: DataFrame, model_file: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", check: str | None = "segments") -> DataFrame:
    """``keep, n_tokens, ids_sha256, decoded_sha256``: ``encode_documents`` in digest form.

    The ids need not leave the Python worker for that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file, check)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [(len(raw) // 4, sha(raw), sha(c.decode(raw).encode())) for raw in _encoded(c, [x or "" for x in part.column(len(keep)).to_pylist()])]
                n, i, d = zip(*rows)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(i), pa.array(d)], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(*keep, F.col(text).alias("__text"))
    schema = picked.drop("__text").select("*", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema
    return picked.mapInArrow(run, schema)
