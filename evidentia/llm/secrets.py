"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials.

Grammar inference is state merging on a prefix tree (ALERGIA, red-blue order): two states
merge when the frequencies of ending and of each next symbol agree within Hoeffding's bound,
and so do those of the states that the merge joins below them.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds in the order of their listing.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What the automata judge: whole runs of the characters that credentials are made of.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
#: Characters of a string that the automata learn from; candidates are scored whole.
LONGEST = 256

#: Symbols of the automata: characters by class.
CLASSES = {
    **dict.fromkeys("0123456789", "0"),
    **dict.fromkeys("abcdef", "a"),
    **dict.fromkeys("ghijklmnopqrstuvwxyz", "z"),
    **dict.fromkeys("ABCDEF", "A"),
    **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "Z"),
    **dict.fromkeys("+/", "+"),
    **dict.fromkeys("-_", "-"),
    ".": ".",
    "=": "=",
}
ALPHABET = sorted(set(CLASSES.values()))
UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Publicly documented credential formats: prefix, alphabet of the rest, its lengths.
FORMATS = {
    "code-host": (("ghp_", "gho_", "glpat-"), UPPER + LOWER + DIGIT, (20, 36)),
    "chat": (("xoxb-", "xoxp-"), DIGIT + DIGIT + LOWER + UPPER, (24, 48)),
    "cloud": (("AIza",), UPPER + LOWER + DIGIT + "-_", (35,)),
    "cloud-secret": (("",), UPPER + LOWER + DIGIT + "+/", (40,)),
    "payment": (("sk_live_", "pk_live_"), UPPER + LOWER + DIGIT, (24, 32)),
}


def format_examples(n: int = 150, seed: int = 7) -> list[tuple[str, str]]:
    """Labelled credentials (value, kind) of the public formats, made from a fixed seed."""
    rnd = random.Random(seed)
    return [(rnd.choice(prefixes) + "".join(rnd.choices(letters, k=rnd.choice(lengths))), kind) for kind, (prefixes, letters, lengths) in FORMATS.items() for _ in range(n)]


def plain_examples(n: int = 300, seed: int = 7) -> dict[str, list[str]]:
    """Ordinary long tokens by kind, made from a fixed seed: what texts hold beside credentials."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("bcdfghklmnprstvw") + rnd.choice("aeiou") + rnd.choice(["", "n", "s", "r"]) for _ in range(rnd.randrange(1, 4)))
    words = lambda lo, hi: [word() for _ in range(rnd.randrange(lo, hi))]
    number = lambda digits: str(rnd.randrange(10**digits))
    makers = {
        "path": lambda: "/".join(words(3, 6)) + rnd.choice([".html", ".py", ".txt", "/", "/" + number(4)]),
        "slug": lambda: rnd.choice("-_.").join(words(3, 8) + [number(4)] * rnd.randrange(2)),
        "camel": lambda: "".join(w.capitalize() for w in words(3, 7)) + rnd.choice(["", number(2)]),
        "shout": lambda: rnd.choice(["_", "-", ""]).join(words(3, 7)).upper(),
        "acronym": lambda: "".join(w.upper() if i == 1 else w.capitalize() for i, w in enumerate(words(3, 7))),
        "number": lambda: rnd.choice(["2024-0", "20240", "+", "", "v1.", "10."]) + rnd.choice([number(16), ".".join(number(3) for _ in range(5)), f"{number(2)}T{number(6)}.{number(6)}", "-".join(number(4) for _ in range(4))]),
    }
    return {kind: [make() for _ in range(n)] for kind, make in makers.items()}


#: Natural logarithm of how many characters a symbol stands for.
SPREAD = {s: math.log(sum(x == s for x in CLASSES.values())) for s in ALPHABET}

#: Log odds over the likeliest ordinary kind that make a candidate a secret. Tests measure it on formats and tokens not learnt from.
MARGIN = 7.0
#: What a character of a filler must be likelier by: any long string is likeliest under its own counts.
HANDICAP = 0.5


def repetition(value: str) -> float:
    """Natural logarithm of the likelihood of characters that are drawn as often as they stood before.

    High where few characters return again and again, as in rulers and fillers, which symbols do not show.
    """
    seen: dict[str, int] = defaultdict(int)
    total = 0.0
    for i, c in enumerate(value):
        total += math.log((seen[c] + 1 / len(CLASSES)) / (i + 1))
        seen[c] += 1
    return total


def symbols(value: str) -> str:
    return "".join(map(CLASSES.__getitem__, value))


@dataclass
class Automaton:
    """A probabilistic automaton: for each state, the log probability of ending and next states."""

    ends: list[float]
    steps: list[dict[str, tuple[int, float]]]
    miss: list[float]

    def log_likelihood(self, word: str) -> float:
        """Natural logarithm of the likelihood of a symbol string; unseen steps are smoothed."""
        state, total = 0, 0.0
        for s in word:
            if (step := self.steps[state].get(s)) is None:
                total += self.miss[state]  # stays where it is
            else:
                state, p = step
                total += p
        return total + self.ends[state]


class _Tree:
    """A prefix tree of symbol strings with counts, folded as states merge.

    ``step[q][s]`` is ``[state, times taken]``; ``count[q]`` is how often a string is at ``q``.
    Of a string over ``LONGEST`` symbols only the first ones count, and it ends nowhere.
    """

    def __init__(self, words: list[str]):
        self.count, self.final = [0], [0]
        self.step: list[dict[str, list[int]]] = [{}]
        for w in words:
            at = 0
            self.count[0] += 1
            for s in w[:LONGEST]:
                if s not in self.step[at]:
                    self.step[at][s] = [len(self.count), 0]
                    self.count.append(0)
                    self.final.append(0)
                    self.step.append({})
                self.step[at][s][1] += 1
                at = self.step[at][s][0]
                self.count[at] += 1
            self.final[at] += len(w) <= LONGEST

    def compatible(self, a: int, b: int, bound: float) -> bool:
        todo, zero = [(a, b)], [None, 0]
        while todo:
            a, b = todo.pop()
            n, m = self.count[a], self.count[b]
            most = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.final[a] / n - self.final[b] / m) > most:
                return False
            for s in self.step[a].keys() | self.step[b].keys():
                (x, f), (y, g) = self.step[a].get(s, zero), self.step[b].get(s, zero)
                if abs(f / n - g / m) > most:
                    return False
                if x is not None and y is not None and x != y:
                    todo.append((x, y))
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds the states below and at ``b``, still the root of a tree, to state ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.final[a] += self.final[b]
            for s, (y, g) in self.step[b].items():
                if s in self.step[a]:
                    self.step[a][s][1] += g
                    todo.append((self.step[a][s][0], y))
                else:
                    self.step[a][s] = [y, g]


def infer(words: list[str], alpha: float = 0.05, smooth: float = 0.05) -> Automaton:
    """The automaton of labelled symbol strings, by merging compatible prefix-tree states."""
    t, bound = _Tree(sorted(words)), math.sqrt(0.5 * math.log(2 / alpha))
    red = [0]
    while True:
        inner = set(red)
        blue = [(t.count[y], -i, s, r, y) for i, r in enumerate(red) for s, (y, _) in t.step[r].items() if y not in inner]
        if not blue:
            break
        _, _, s, r, b = max(blue)
        for a in red:
            if t.compatible(a, b, bound):
                t.step[r][s][0] = a
                t.fold(a, b)
                break
        else:
            red.append(b)
    place = {r: i for i, r in enumerate(red)}
    totals = [t.final[r] + sum(f for _, f in t.step[r].values()) + smooth * (len(ALPHABET) + 1) for r in red]
    return Automaton(
        [math.log((t.final[r] + smooth) / n) for r, n in zip(red, totals)],
        [{s: (place[y], math.log((f + smooth) / n)) for s, (y, f) in t.step[r].items()} for r, n in zip(red, totals)],
        [math.log(smooth / n) for n in totals],
    )


@dataclass
class Model:
    """Automata by kind, of the documents' ordinary tokens and of made ones; ``margin``: log odds that a hit takes."""

    kinds: dict[str, Automaton]
    ordinary: Automaton | None
    margin: float = MARGIN
    plain: tuple[Automaton, ...] = ()

    def kind_of(self, value: str) -> str | None:
        """The kind under which a candidate is likeliest, if likely enough to be a credential."""
        if not self.kinds:
            return None
        word = symbols(value)
        score, kind = max((a.log_likelihood(word), k) for k, a in self.kinds.items())
        plain = self.ordinary.log_likelihood(word) if self.ordinary else -len(word) * math.log(len(ALPHABET))
        plain = max(plain, *(a.log_likelihood(word) for a in self.plain), repetition(value) - HANDICAP * len(value) + sum(map(SPREAD.__getitem__, word)))
        return kind if score - plain >= self.margin else None


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) of the base patterns, by start, then kind as listed.

    Per kind leftmost and non-overlapping; a match that is too short is passed over, and the
    search goes on after it. Positions are code points, ends exclusive.
    """
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return [(BASE[k], a, b, v) for a, k, b, v in sorted(out)]


def spans(text: str, model: Model) -> list[tuple[str, int, int, int]]:
    """Base spans and, of candidates that touch none of them, those that the automata take.

    An automaton's hit has kind ``format-`` and the kind of credential that it learnt.
    """
    tokens = list(CANDIDATE.finditer(text))
    if not tokens and ":" not in text and "=" not in text:
        return []  # hex runs and access keys are candidates, too
    base = base_spans(text)
    more = [(f"format-{kind}", m.start(), m.end(), m.start()) for m in tokens if not any(a < m.end() and m.start() < b for _, a, b, _ in base) if (kind := model.kind_of(m[0]))]
    order = {k: i for i, k in enumerate(BASE)}
    return sorted(base + more, key=lambda x: (x[1], order.get(x[0], len(BASE)), x[0]))


def smallest(docs: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows with the smallest id hashes, and rows that share the last one's id."""
    h = docs.select(F.xxhash64("doc_id").alias("h"))
    last = h.orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return docs.where(F.xxhash64("doc_id") <= F.lit(last)) if last is not None else docs.limit(0)


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 20_000, per_kind: int = 300, extra: list[tuple[str, str]] | None = None, margin: float = MARGIN) -> Model:
    """A model from at most ``sample`` documents, those whose ids have the smallest hashes.

    Labelled credentials are the values that base patterns match there (by kind: whole-hex
    values count as hex) and ``extra`` (value, kind), by default examples of public formats;
    ``per_kind`` of each are used, of long ones the first ``LONGEST`` characters. Candidates that no pattern matches train the automaton
    of ordinary tokens, beside those of ``plain_examples``. Whatever the table, at most ``sample`` texts are read for this and
    ``per_kind`` strings a kind reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, set[str]] = defaultdict(set)
            for t in b.column(0):
                t = t.as_py() or ""
                base = base_spans(t)
                for kind, _, end, value in base:
                    found["hex" if HEX.fullmatch(t, value, end) else kind].add(t[value : min(end, value + LONGEST + 1)])
                for m in CANDIDATE.finditer(t):
                    if not any(a < m.end() and m.start() < e for _, a, e, _ in base):
                        found["ordinary"].add(m[0][: LONGEST + 1])
            rows = [(k, v) for k, values in sorted(found.items()) for v in sorted(values, key=lambda v: (hash_of(v), v))[:per_kind]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["kind", "value"])

    picked = smallest(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), sample).select("text")
    rows = picked.mapInArrow(run, "kind string, value string").distinct()
    ranked = rows.groupBy("kind").agg(F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("value").alias("h"), "value"))), 1, per_kind).alias("v"))
    words = {r.kind: [x.value for x in r.v] for r in ranked.collect()}
    ordinary = words.pop("ordinary", [])
    for value, kind in format_examples() if extra is None else extra:
        words.setdefault(kind, []).append(value)
    usable = {k: [symbols(v) for v in sorted(vs)[:per_kind] if all(c in CLASSES for c in v)] for k, vs in words.items()}
    made = tuple(infer([symbols(v) for v in vs]) for vs in plain_examples().values())
    return Model({k: infer(v) for k, v in sorted(usable.items()) if len(v) >= 20}, infer([symbols(v) for v in ordinary]) if ordinary else None, margin, made)


def hash_of(value: str) -> int:
    """A fixed order of strings that has nothing to do with their spelling."""
    import xxhash

    return xxhash.xxh64_intdigest(value)


def scan(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` and ``spans``, an array of (kind, start, end, value), for every row.

    ``value`` is where the secret itself begins, after a name and sign before it. Null and
    empty texts have no spans; very long texts are scanned whole; repeated rows are each
    scanned; an empty table gives an empty result.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "value"), s)) for s in spans(t.as_py() or "", model)] for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(found, kind)], names=[*keep, "spans"])

    picked = docs.select(*keep, F.col(text).alias("__text"))
    empty = F.lit(None).cast("array<struct<kind:string,start:bigint,end:bigint,value:bigint>>")
    return picked.mapInArrow(run, picked.drop("__text").withColumn("spans", empty).schema)


def redact(docs: DataFrame, model: Model, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; all else as it was.

    Overlapping secrets are replaced together. A null text stays null.
    """
    names = docs.columns
    at = names.index(text)

    def clean(t: str | None) -> str | None:
        found = sorted((v, e) for _, _, e, v in spans(t or "", model))
        if not found:
            return t
        out, last = [], 0
        for v, e in found:
            if v >= last:
                out += [t[last:v], mark]
            last = max(last, e)
        return "".join([*out, t[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cleaned = pa.array([clean(t.as_py()) for t in b.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([cleaned if i == at else c for i, c in enumerate(b.columns)], names=names)

    return docs.mapInArrow(run, docs.schema)


def listing(found: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
