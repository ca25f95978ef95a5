"""Toxicity: texts are restored from noisy spelling, then scored.

Noisy channel: a suspicious word (digits or signs among or beside letters, doubled or repeated letters, letters set apart)
is a lattice: each character stands for itself or for the letters it imitates, a run of one letter
for one or two of it, a separator among letters set apart for nothing or for a word's end. A Viterbi search over states of two letters finds the
likeliest path under a trigram character model and the channel's costs. Words that have no other path
than themselves are taken as they are; each distinct word is restored once.

The character model's counts come from all words of all documents (partial counts in every task, then
one shuffle); its size is fixed by the alphabet. The words' stems (their beginnings, and the whole) are weighed by
log-odds of at most ``sample`` labelled rows (of near copies, one): a stem has a weight, for or against, if its counts cannot be
chance (``CHANCE``). A document's score is a logistic function of its heaviest restored word, of all weights for
label 1 and of all against it. Executors restore the sample too; the driver sees counts of stems and three numbers a row.

Results for odd input: null text is empty text; an empty text has a score, that of no evidence; texts
of any length are scored whole, and letters set apart are restored however many they are and whatever white space and
separators stand between them; equal texts get equal scores; without labels of both kinds every
score is the share of label 1 (0 without labels at all). Null and repeated keys are rows like others (of a labelled key that repeats one
text is learnt from); an empty table gives no rows; other columns may have any names. Key, label, language and source are never inputs of a score.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterable, Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, text_slices
from ledgerloom.llm.quality import is_held_out, labelled_sample, scored

#: Labelled rows that stems are weighed by, at most; shortest and longest stem; words remembered by a worker.
SAMPLE, SHORTEST, LONGEST_STEM, REMEMBERED = 8000, 4, 7, 150_000
#: How unlikely a stem's counts must be if it had nothing to do with the label; rows at least; share of its rows that are of one label.
CHANCE, LEAST, PURE = 1e-6, 3, 0.75
#: Letters of the model; all other letters are one class. State 0 is a word's edge.
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêçàâîôûëïñáíóú"
CLASSES = len(LETTERS) + 2

# The letters that a sign imitates.
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y", "*": "aeiou", "#": "h",
}
#: Costs, in nats, of a sign for a letter, of a run for one or two letters, of a sign as itself, of a separator left out or ending a word.
SIGN, RUN, ITSELF, APART, BREAK = 0.5, 0.3, 9.0, 0.3, 1.0

_CLASS = {c: i + 1 for i, c in enumerate(LETTERS)}
_HEAD, _TAIL = "\"'`.,;:?()[]{}<>«»„“”‘’…*_-~/\\%&#=^", "\"'`.,;:?!()[]{}<>«»„“”‘’…*_-~|/\\%&#$=+^"
_SEPARATORS = ".-_*~·'’,/\\"
_SPACED = re.compile(r"(?<![^\s])(?:[^\W_]|[@$!|+€£])(?:[\s.\-_*~·'’,/\\]+(?:[^\W_]|[@$!|+€£])){3,}(?![^\s.,;:!?])")
#: Edges' signs that stand for no letter.
_MARKS, _MARKS_AFTER = ("".join(c for c in x if c not in IMITATES) for x in (_HEAD, _TAIL))
_CUT = re.compile(r"[\s.\-_*~·'’,/\\]+")
_RUN = re.compile(r"(.)\1")
_PLAIN = re.compile(r"[^\W\d_]+\Z")
#: Bytes of lower-cased Latin-1-like text that the model knows, for counting with arrays.
_POINTS = np.full(0x250, CLASSES - 1, np.int64)
for _c, _i in _CLASS.items():
    _POINTS[ord(_c)] = _i
for _p in range(0x250):
    if not chr(_p).isalpha():
        _POINTS[_p] = 0


def trigram_counts(text: str) -> np.ndarray:
    """Counts, by code, of three letters in a row of the lower-cased text, edges (signs) included."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    c = np.concatenate(([0, 0], np.where(points < len(_POINTS), _POINTS[np.minimum(points, len(_POINTS) - 1)], CLASSES - 1), [0]))
    return np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)


def character_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts over all rows. What a task sends is bounded by the alphabet, not by its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for part in text_slices(batch, "_text"):
                total += trigram_counts("\n".join(part.column("_text").to_pylist()))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": pa.array(code, pa.int64()), "n": pa.array(total[code], pa.int64())})

    parts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, "code long, n long")
    got = parts.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES**3)
    out[got.column("code").to_numpy().astype(np.int64)] = got.column("n").to_numpy()
    return out


def set_apart(word: str) -> bool:
    return len(word) > 4 and sum(c in _SEPARATORS for c in word[1:-1]) >= max(2, (len(word) - 1) // 2 - 1)


class Restorer:
    """Viterbi decoding of words under a trigram character model."""

    def __init__(self, counts: np.ndarray):
        n3 = counts.reshape(CLASSES, CLASSES, CLASSES)
        n2, n1 = n3.sum(0), n3.sum((0, 1))
        p1 = (n1 + 1) / (n1.sum() + CLASSES)
        p2 = (n2 + 20 * p1) / (n2.sum(1, keepdims=True) + 20)
        p3 = (n3 + 20 * p2[None]) / (n3.sum(2, keepdims=True) + 20)
        self.cost = (-np.log(p3)).tolist()

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        """For each place of a lower-cased word the strings that may stand there, with their costs."""
        places: list[list[tuple[str, float]]] = []
        apart = set_apart(word)
        i = 0
        while i < len(word):
            c, j = word[i], i + 1
            while j < len(word) and word[j] == c:
                j += 1
            if c.isalpha():
                places.append([(c, 0.0)] if j - i == 1 else [(c * 2, 0.0), (c, RUN)] if j - i == 2 else [(c, RUN), (c * 2, RUN)])
            else:
                options = [(x, SIGN) for x in IMITATES.get(c, "")]
                if apart and c in _SEPARATORS or c.isspace():
                    options += [("", APART * (j - i) ** 2), (" ", BREAK)]
                if j - i > 1 and options:
                    options += [(x * 2, cost) for x, cost in options if x.isalpha()]
                places.append([*options, (c * (j - i), ITSELF * (j - i))])
            i = j
        return places

    def decode(self, word: str) -> str:
        """The likeliest word behind a lower-cased one."""
        cost, edge = self.cost, 0
        # A path is a chain of (path before, letters), so a long word costs no more a letter than a short one.
        best: dict[tuple[int, int], tuple[float, tuple]] = {(edge, edge): (0.0, ())}
        for place in self.lattice(word):
            then: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (total, path) in best.items():
                for letters, extra in place:
                    x, y, c = a, b, total + extra
                    for letter in letters:
                        z = _CLASS.get(letter, CLASSES - 1 if letter.isalpha() else 0)
                        c += cost[x][y][z]
                        x, y = y, z
                    old = then.get((x, y))
                    if old is None or c < old[0]:
                        then[x, y] = (c, (path, letters))
            best = then
        path = min(((total + cost[a][b][edge], path) for (a, b), (total, path) in best.items()), key=lambda x: x[0])[1]
        out = []
        while path:
            path, letters = path
            out.append(letters)
        return "".join(reversed(out))

    def spelt(self, noisy: str) -> list[str]:
        """The words that letters spell, restored, cut where the likeliest path ends a word. Three letters do not
        tell for sure where words end among letters set apart, so there each letter may begin one."""
        out = [x for x in _CUT.split(self.decode(noisy)) if x]
        if set_apart(noisy) or any(c.isspace() for c in noisy):
            one = self.decode(_CUT.sub("", noisy))
            out += [one, *(one[i : i + LONGEST_STEM] for i in range(1, len(one) - SHORTEST + 1))]
        return out

    def words(self, token: str) -> tuple[str, ...]:
        """The words of a token, restored if it has another path than itself. Signs at its edges that imitate
        letters are read in both ways, left out and as letters."""
        core, wide = token.lstrip(_HEAD).rstrip(_TAIL), token.lstrip(_MARKS).rstrip(_MARKS_AFTER)
        if not any(c.isalpha() for c in core):
            return (core,)
        out = [core] if _PLAIN.match(core) and not _RUN.search(core) else self.spelt(core)
        if wide != core:
            out += [x for x in self.spelt(wide) if x not in out]
        return tuple(out)


def spaced_words(low: str, restorer: Restorer) -> list[str]:
    """What letters set apart spell, restored, in a lower-cased text."""
    return [x for m in _SPACED.finditer(low) if any(c.isalpha() for c in m[0]) for x in restorer.spelt(m[0])]


def restored_words(text: str, restorer: Restorer, known: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    """The distinct words of a text, restored. ``known`` remembers what was restored before."""
    low = text.lower()
    out = set(spaced_words(low, restorer))
    for token in set(low.split()):
        words = known.get(token)
        if words is None:
            if len(known) >= REMEMBERED:
                known.clear()
            known[token] = words = tuple(map(sys.intern, restorer.words(token)))
        out.update(words)
    return tuple(sorted(out))


def stems(word: str) -> list[str]:
    """A word's beginnings, and the whole with an end mark."""
    return [word[:n] for n in range(SHORTEST, min(len(word), LONGEST_STEM) + 1)] + [word + "$"]


class Scorer:
    """Stems' weights, and a logistic function of a text's evidence."""

    def __init__(self, restorer: Restorer, weights: dict[str, float], slopes: tuple[float, ...], bias: float):
        self.restorer, self.weights, self.slopes, self.bias = restorer, weights, slopes, bias
        self.known: dict[str, list[tuple[str, float]]] = {}

    def weight(self, word: str) -> float:
        """The largest weight for label 1 of the word's stems; without one, the largest against it, negative."""
        weights = [x for s in stems(word) if (x := self.weights.get(s))]
        return max(weights) if weights and max(weights) > 0 else min(weights, default=0.0)

    def found(self, text: str) -> list[float]:
        """The weights of a text's distinct restored words, but for those of weight 0. A token is restored once."""
        low = text.lower()
        hits = {w: x for w in spaced_words(low, self.restorer) if (x := self.weight(w))}
        for token in set(low.split()):
            if token not in self.known:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[token] = [(w, x) for w in self.restorer.words(token) if (x := self.weight(w))]
            hits.update(self.known[token])
        return list(hits.values())

    def score(self, text: str) -> float:
        margin = sum(a * b for a, b in zip(self.slopes, evidence(self.found(text)), strict=True))
        return float(1 / (1 + np.exp(-np.clip(margin + self.bias, -30, 30))))


def evidence(weights: list[float]) -> tuple[float, float, float]:
    """The heaviest word's weight, and (the logarithms of) all words' weights for label 1 and against it."""
    up, down = sorted(x for x in weights if x > 0), sorted(-x for x in weights if x < 0)
    return (up[-1] if up else 0.0), float(np.log1p(sum(up))), float(np.log1p(sum(down)))


def tail(hits: int, n: int, p: float) -> float:
    """The probability of at least ``hits`` in ``n`` independent trials."""
    if hits <= 0:
        return 1.0
    logs = [lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p) for k in range(hits, n + 1)]
    return sum(map(exp, logs))


def weigh(counts: Iterable[tuple[str, int, int]], bad: int, good: int) -> dict[str, float]:
    """Log-odds of stems (stem, rows of label 1, rows of label 0) that are mostly of one label, and not by chance; ``bad`` and ``good`` are all rows.

    A stem of which a longer one has all the evidence has no weight for label 1: what else begins like it is mostly of label 0.
    """
    known = {s: (k, m) for s, k, m in counts}
    out, share = {}, min(max(bad / max(bad + good, 1), 1e-6), 1 - 1e-6)

    def odds(k: int, m: int) -> float:
        return float(np.log((k + 0.5) / (bad + 1)) - np.log((m + 0.5) / (good + 1)))

    for s, (k, m) in known.items():
        x = odds(k, m)
        if x > 0 and k >= LEAST and k >= PURE * (k + m) and tail(k, k + m, share) < CHANCE or x < 0 and m >= LEAST and tail(m, k + m, 1 - share) < CHANCE:
            out[s] = x
    longer: dict[str, tuple[int, int]] = {}
    for s in out:
        above = s[:-1][:LONGEST_STEM]
        longer[above] = max(longer.get(above, (0, 0)), known[s])
    for s in [s for s in out if s in longer and out[s] > 0]:
        k, m = known[s][0] - longer[s][0], known[s][1] - longer[s][1]
        if m > 0 and k < PURE * (k + m):
            del out[s]
    return out


def cluster(text: str) -> int:
    """The smallest hash of three words in a row: near copies mostly share it, other texts do not."""
    words = text.lower().split()
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", key: str = "doc_id") -> tuple[np.ndarray, dict[str, float], tuple[float, ...], float]:
    """(character counts, weights, slopes, bias)."""
    counts = character_counts(docs, text)
    scratch = Scratch(docs.sparkSession)
    rows = labelled_sample(docs, labels, "toxic", sample, text, key)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text"):
                keys = pa.array([cluster(t) for t in part.column("_text").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, keys], names=["h", "_text", "_label", "c"])

    # Of near copies one is learnt from. Weights are learnt from one half and the logistic function from the other, then weights from all.
    apart = rows.select(F.xxhash64("_id").alias("h"), "_text", "_label").mapInArrow(keyed, "h long, _text string, _label int, c long")
    once = apart.groupBy("c", "_label").agg(F.min_by(F.struct("h", "_text"), "h").alias("r")).select("r.*", "_label")
    once = scratch.save("sample", once.withColumn("half", F.pmod(F.xxhash64("h"), F.lit(2)).cast("int")))
    n = {(r["_label"], r["half"]): r["count"] for r in once.groupBy("_label", "half").count().collect()}
    bad, good = (sum(n.get((label, half), 0) for half in (0, 1)) for label in (1, 0))
    if not bad or not good:
        scratch.close()
        share = bad / max(bad + good, 1)
        return counts, {}, (0.0, 0.0, 0.0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, known = Restorer(sent.value), {}
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for t, label, half in zip(*(batch.column(c).to_pylist() for c in ("_text", "_label", "half")), strict=True):
                for s in {s for w in restored_words(t, restorer, known) for s in stems(w)}:
                    counts.setdefault(s, [0, 0, 0, 0])[2 * half + label] += 1
            columns = zip(("g0", "b0", "g1", "b1"), zip(*counts.values(), strict=True) if counts else [()] * 4, strict=True)
            yield pa.RecordBatch.from_pydict({"stem": pa.array(counts, pa.string()), **{c: pa.array(x, pa.int64()) for c, x in columns}})

    total = lambda *columns: F.sum(sum(map(F.col, columns), F.lit(0)))
    by_stem = once.select("_text", "_label", "half").mapInArrow(listed, "stem string, g0 long, b0 long, g1 long, b1 long").groupBy("stem")
    by_stem = by_stem.agg(total("b0").alias("b0"), total("g0").alias("g0"), total("b0", "b1").alias("b"), total("g0", "g1").alias("g"))
    # Only stems that may have a weight reach the driver: mostly of label 1, or rarer there than by half, in many rows.
    some = by_stem.where((F.col("b") >= LEAST) & (F.col("b") >= 0.5 * (F.col("b") + F.col("g"))) | (F.col("g") >= 50) & (F.col("b") * (2.0 * good) <= F.col("g") * float(bad))).toArrow()
    columns = {c: some.column(c).to_pylist() for c in ("stem", "b0", "g0", "b", "g")}
    first = weigh(zip(columns["stem"], columns["b0"], columns["g0"], strict=True), n.get((1, 0), 0), n.get((0, 0), 0))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Restorer(sent.value), first, (0.0, 0.0, 0.0), 0.0)
        for batch in batches:
            top, up, down = zip(*[evidence(scorer.found(t)) for t in batch.column("_text").to_pylist()], strict=True) if len(batch) else ((), (), ())
            yield pa.RecordBatch.from_pydict({"h": batch.column("h"), "y": batch.column("_label"), "top": pa.array(top, pa.float64()), "up": pa.array(up, pa.float64()), "down": pa.array(down, pa.float64())})

    got = once.where("half = 1").select("_text", "_label", "h").mapInArrow(weighed, "h long, y int, top double, up double, down double").toArrow().sort_by("h")
    slopes, bias = logistic(np.stack([got.column(c).to_numpy() for c in ("top", "up", "down")], axis=1), got.column("y").to_numpy().astype(float))
    scratch.close()
    return counts, weigh(zip(columns["stem"], columns["b"], columns["g"], strict=True), bad, good), slopes, bias


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 80) -> tuple[tuple[float, ...], float]:
    """Slopes and bias by damped Newton steps; a ridge keeps them finite when x separates y."""
    scale = np.maximum(np.abs(x).max(0, initial=0.0), 1e-9)
    a = np.column_stack((x / scale, np.ones(len(x))))
    w, ridge = np.zeros(a.shape[1]), np.diag([0.02] * x.shape[1] + [0.001])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge @ w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge
        w = w - np.clip(np.linalg.solve(h, g), -4, 4)
    return tuple((w[:-1] / scale).tolist()), float(w[-1])


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(row, score, predicted) of every row of ``docs``; row is the whole row. Scoring has no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample, text, key))
    made: list[Scorer] = []

    def score(texts: list[str]) -> list[float]:
        if not made:
            counts, weights, slopes, bias = sent.value
            made.append(Scorer(Restorer(counts), weights, slopes, bias))
        return [made[0].score(t) for t in texts]

    return scored(docs, text, threshold, score)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted) of every row of ``docs``."""
    rows = toxicity_scores(docs.select(key, text), labels, threshold, sample, text, key)
    return rows.select(F.col(f"row.{key}").alias(key), is_held_out(F.col(f"row.{key}")).alias("held_out"), "score", "predicted")
