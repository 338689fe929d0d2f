"""Operator 8, toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel counts common subsequences of ``LENGTH`` characters that span at most ``SPAN``, each weighed
by ``DECAY`` for every character skipped; a gap or an inserted character lowers it but little. It is
taken between landmarks and every window of a text, spaces included, all windows of a batch at once:
a table lookup finds the subsequences that any landmark holds. Landmarks are words and word beginnings
that tell toxic from clean training documents, short words with the blanks around them; the inverse root of their own kernel matrix gives the
Nystroem features. A linear SVM is trained on windows by multiple instances: of a toxic document its
most toxic window counts, of a clean one its worst. A document's score is the logistic of its most
toxic window's margin, over the whole text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, takewhile
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import batches, crc_fold, worker_state
from threadloom.llm.shingles import mixed

LENGTH, SPAN, DECAY = 4, 7, 0.85
#: The labelled sample that is fitted at most, per label.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1000, 5000
#: Toxic documents without an earlier landmark that a landmark stands in at least; two in samples of under 210.
FEW = 3
#: So many words that always stand together beside other landmarks are a copied passage.
PASSAGE = 8
#: Factor for each white space that a subsequence spans, but for those of a word spelt out by single letters.
ACROSS = 0.6
#: A window is two buckets of this many characters; windows below the least kernel value count as none.
BUCKET, LEAST = 8, 0.25
_PATTERNS = [(0, *c) for c in combinations(range(1, SPAN), LENGTH - 1)]
#: Characters of a text that are taken at a time, with an overlap; bounds memory, drops nothing.
_CHUNK = 1 << 18


_SPELT = re.compile(r"(?<!\w)(?:\w[^\w\n]){3,}\w(?!\w)")
_MARKS = re.compile(r"\W")


#: Characters of scripts that part no words by blanks, and pictures.
_WIDE = re.compile("[\u0e00-\u0eff\u2600-\u27bf\u2e80-\u2fff\u3005-\u3007\u3021-\ua4cf\uac00-\ud7af\uf900-\ufaff\U0001f000-\U0001faff\U00020000-\U0003ffff]+")


def pairs(text: str) -> list[str]:
    """Neighbours in runs of such characters as words of two; a single one is taken twice."""
    if text.isascii():
        return []
    return [p for run in _WIDE.findall(text) for p in (map("".join, zip(run, run[1:], strict=False)) if len(run) > 1 else [run * 2])]


def expanded(text: str) -> str:
    """A text, followed by the words that it spells out letter by letter and by its pairs."""
    found = [_MARKS.sub("", x) for x in _SPELT.findall(text)] + pairs(text)
    return " ".join([text, *found]) + " " if found else text


#: Lengths of the beginnings of words that may be landmarks; texts are scored whole whatever these are.
STEMS = (*range(LENGTH, 11), 12, 16, 24, 32)
#: Bits of the hashes of terms at most.
TABLE_BITS = 21
#: Marks next to a word; they count as blanks.
EDGES = ".,;:!?\"'()*$&%#|"
_BLANKS = (9, 10, 11, 12, 13, 32)
_FOLD = dict.fromkeys([*_BLANKS, *map(ord, EDGES)], " ")


def subsequences(word: str, across: float = 1.0) -> dict[str, float]:
    """Terms of the kernel's feature map: subsequence to weight, times ``across`` for each blank spanned."""
    out: dict[str, float] = {}
    for k in range(len(word)):
        for p in _PATTERNS:
            if k + p[-1] < len(word):
                u = "".join([word[k + x] for x in p])
                out[u] = out.get(u, 0.0) + DECAY ** (p[-1] - LENGTH + 1) * across ** word.count(" ", k + 1, k + p[-1] + 1)
    return out


class Model(NamedTuple):
    landmarks: list[str]
    whiten: np.ndarray  # inverse root of the landmarks' kernel matrix
    weights: np.ndarray
    bias: float
    slope: float
    offset: float


class Values(NamedTuple):
    """Kernel values of windows with landmarks, those above zero only: memory grows with what is found in a
    text, not with the number of landmarks."""

    own: np.ndarray  # the text of each window
    row: np.ndarray  # per value: window, landmark
    mark: np.ndarray
    value: np.ndarray

    def times(self, line: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * line[self.mark], minlength=len(self.own))

    def transposed_times(self, rows: np.ndarray, count: int) -> np.ndarray:
        return np.bincount(self.mark, self.value * rows[self.row], minlength=count)

    def largest(self) -> np.ndarray:
        out = np.zeros(len(self.own))
        np.maximum.at(out, self.row, self.value)
        return out

    def take(self, windows: np.ndarray) -> Values:
        at = np.full(len(self.own), -1)
        at[windows] = np.arange(len(windows))
        keep = at[self.row] >= 0
        return Values(self.own[windows], at[self.row[keep]], self.mark[keep], self.value[keep])

    def dense(self, count: int, first: int, rows: int) -> np.ndarray:
        out = np.zeros((min(rows, len(self.own) - first), count))
        keep = (self.row >= first) & (self.row < first + rows)
        out[self.row[keep] - first, self.mark[keep]] = self.value[keep]
        return out


def stacked(parts: list[Values]) -> Values:
    first = np.cumsum([0, *(len(p.own) for p in parts)])
    rows = [p.row + k for p, k in zip(parts, first.tolist(), strict=False)]
    columns = [[p.own for p in parts], rows, [p.mark for p in parts], [p.value for p in parts]]
    return Values(*(np.concatenate([np.empty(0, t), *c]) for c, t in zip(columns, (np.int64, np.int64, np.int64, float), strict=True)))


class Kernel:
    """Kernel values of a text's windows with all landmarks, each in units of the landmark's own."""

    def __init__(self, landmarks: list[str]) -> None:
        maps, sizes = [], []
        for x in landmarks:
            both: list[dict[str, float]] = [{}, {}]
            for out, across in zip(both, (1.0, ACROSS), strict=True):
                short = x[0] == " "
                for u, v in subsequences(x, across).items():
                    if short and u not in x:
                        continue
                    out[u.translate(_FOLD)] = out.get(u.translate(_FOLD), 0.0) + v
            maps.append(both[0])
            sizes.append(sum(v * both[1][u] for u, v in both[0].items()) or 1.0)
        #: The landmarks' characters in order; a character's class is its place from 1 on, 0 is in no landmark.
        self.letters = np.array(sorted({ord(c) for m in maps for u in m for c in u}), np.uint32)
        self.base = len(self.letters) + 1
        self.low = np.zeros(0x3000, np.int32)
        self.low[self.letters[self.letters < 0x3000]] = 1 + np.flatnonzero(self.letters < 0x3000)
        self.low[list(_FOLD)] = self.low[32]
        terms: dict[tuple[int, ...], dict[int, float]] = {}
        for k, (m, size) in enumerate(zip(maps, sizes, strict=True)):
            for u, v in m.items():
                own = terms.setdefault(tuple(self.classes(np.array([ord(c) for c in u], np.uint32)).tolist()), {})
                own[k] = own.get(k, 0.0) + v / size
        names = sorted(terms)
        rows = [sorted(terms[u].items()) for u in names]
        self.terms = np.array(names, np.int32).reshape(-1, LENGTH)
        # a table of the terms' hashes leaves few places to look at; there the term is compared class by class
        bits = int(np.clip(np.ceil(np.log2(max(1, 200 * len(names)))), 16, TABLE_BITS))
        self.hashes = [(mixed(np.arange(self.base, dtype=np.uint64) + np.uint64(7000 * k + 1)) >> np.uint64(64 - bits)).astype(np.int32) for k in range(LENGTH)]
        slot = self.hashes[0][self.terms[:, 0]] ^ self.hashes[1][self.terms[:, 1]] ^ self.hashes[2][self.terms[:, 2]] ^ self.hashes[3][self.terms[:, 3]]
        self.table, self.layers = np.zeros(1 << bits, bool), []
        self.table[slot] = True
        left = np.arange(len(slot))
        while len(left):  # terms of one slot go to further layers
            own, first = np.unique(slot[left], return_index=True)
            layer = np.full(1 << bits, -1, np.int32)
            layer[own] = left[first]
            self.layers.append(layer)
            left = np.delete(left, first)
        self.first = np.cumsum([0, *map(len, rows)])
        self.landmark = np.array([k for r in rows for k, _ in r], np.int64)
        self.weight = np.array([v for r in rows for _, v in r])
        self.count = len(landmarks)
        self.short = np.array([x[0] == " " for x in landmarks], bool)  # these count as a whole and without gaps only

    def classes(self, points: np.ndarray) -> np.ndarray:
        """Classes of code points, over all of Unicode; white space and marks beside words count as blanks."""
        out = self.low[np.minimum(points, len(self.low) - 1)]
        high = np.flatnonzero(points >= len(self.low) - 1)
        if len(high) and len(self.letters):
            at = np.minimum(np.searchsorted(self.letters, points[high]), len(self.letters) - 1)
            out[high] = np.where(self.letters[at] == points[high], at + 1, 0)
        return out

    def _terms(self, c: np.ndarray, at: np.ndarray, slot: np.ndarray, pattern: tuple[int, ...]) -> np.ndarray:
        """Numbers of the terms at places, -1 where there is none."""
        seen = [c[at + p] for p in pattern]
        out = np.full(len(at), -1, np.int32)
        for layer in self.layers:
            t = layer[slot]
            fits = t >= 0
            for k in range(LENGTH):
                fits &= self.terms[t, k] == seen[k]
            out[fits] = t[fits]
        return out

    def windows(self, texts: list[str]) -> Values:
        """The windows with a value of ``LEAST`` at least."""
        found = []
        for k, text in self._pieces(texts):
            v = self._windows(text)
            found.append(v._replace(own=np.asarray(k)[v.own]))
        return stacked(found)

    def _pieces(self, texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
        numbers, group, size = [], [], 0
        for k, text in enumerate(texts):
            for at in range(0, max(1, len(text)), _CHUNK):
                end = at + _CHUNK + 4 * BUCKET
                piece = " " * (at == 0) + text[at:end] + " " * (end >= len(text))
                numbers.append(k)
                group.append(piece)
                size += len(piece)
                if size >= _CHUNK:
                    yield numbers, group
                    numbers, group, size = [], [], 0
        if group:
            yield numbers, group

    def _windows(self, texts: list[str]) -> Values:
        gap = "\0" * (2 * BUCKET + SPAN)
        lowered = [expanded(t.lower()) for t in texts]
        points = np.frombuffer((gap.join(lowered) + gap).encode("utf-32-le", "replace"), np.uint32)
        starts = np.cumsum([0, *(len(t) + len(gap) for t in lowered)])[:-1]
        c = self.classes(points)
        n = len(c) - SPAN
        blank = np.isin(points, _BLANKS)
        near = np.pad(blank, 2)
        crossed = np.cumsum(blank & ~near[:-4] & ~near[4:])
        at, term, scale, width = [], [], [], []
        h = [x[c] for x in self.hashes]
        two = {g: h[0][:n] ^ h[1][g : g + n] for g in range(1, SPAN - 2)}
        last = {(a, b): h[2][a : a + n] ^ h[3][b : b + n] for a in range(2, SPAN - 1) for b in range(a + 1, SPAN)}
        for p in _PATTERNS:
            slot = two[p[1]] ^ last[p[2], p[3]]
            hit = np.flatnonzero(self.table[slot])
            t = self._terms(c, hit, slot[hit], p)
            hit, t = hit[t >= 0], t[t >= 0]
            at.append(hit)
            width.append(np.full(len(hit), p[-1]))
            term.append(t)
            scale.append(DECAY ** (p[-1] - LENGTH + 1) * ACROSS ** (crossed[hit + p[-1]] - crossed[hit]))
        at, term, scale = np.concatenate(at), np.concatenate(term), np.concatenate(scale)
        width = np.concatenate(width)
        times = self.first[term + 1] - self.first[term]
        pos = np.repeat(at, times)
        index = np.arange(len(pos)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.first[term], times)
        landmark, value = self.landmark[index], self.weight[index] * np.repeat(scale, times)
        solid = ~self.short[landmark] | (np.repeat(width, times) < LENGTH)
        pos, landmark, value = pos[solid], landmark[solid], value[solid]
        bucket = pos // BUCKET
        key = np.concatenate([bucket * self.count + landmark, (bucket - 1) * self.count + landmark])  # window b: buckets b and b + 1
        key += self.count  # bucket -1
        names, inverse = np.unique(key, return_inverse=True)
        total = np.bincount(inverse, np.concatenate([value, value]), minlength=len(names))
        window, mark = np.divmod(names, self.count)
        total[self.short[mark] & (total < 0.9)] = 0.0
        strong = np.unique(window[total >= LEAST])
        keep = np.isin(window, strong) & (total > 0)
        own = np.searchsorted(starts, np.maximum(0, (strong - 1) * BUCKET + BUCKET), side="right") - 1
        return Values(own, np.searchsorted(strong, window[keep]), mark[keep], np.minimum(total[keep], 1.0))


class Scorer:
    """Margins and scores of texts; ``floor`` is the margin of a text without any strong window."""

    def __init__(self, model: Model) -> None:
        self.model, self.kernel = model, Kernel(model.landmarks)
        self.line, self.floor = model.whiten @ model.weights, float(model.bias)

    def margins(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.floor)
        if self.model.landmarks and texts:
            values = self.kernel.windows(texts)
            np.maximum.at(out, values.own, values.times(self.line) + self.floor)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.model.slope * self.margins(texts) + self.model.offset, -30, 30)))


def _stems(text: str) -> set[str]:
    """Beginnings of a text's words, of the lengths ``STEMS`` as far as the word goes; words of two and three
    characters, and pairs, with the blanks around them."""
    text = text.lower()
    out = {f" {p} " for p in pairs(text)}
    for w in set(text.split()):
        w = w.strip(EDGES)
        out.update(w[:k] for k in STEMS if k <= len(w))
        if LENGTH - 2 <= len(w) < LENGTH:
            out.add(f" {w} ")
    return out


def choose_landmarks(toxic: list[str], clean: list[str]) -> list[str]:
    """Words and word beginnings, greedily: each time the one that occurs in most toxic documents which
    no earlier one explains, among those hardly found in clean ones, until none occurs in ``FEW`` of the
    documents that are left, however many landmarks that takes. Of beginnings that explain nearly as much, the longest. Only
    counts of repeated beginnings are kept, never all of a sample's words."""
    few = FEW if len(toxic) >= 210 else 2
    bad = Counter(x for t in toxic for x in _stems(t))
    bad = Counter({x: n for x, n in bad.items() if n >= few})
    good = Counter(x for t in clean for x in _stems(t) if x in bad)
    ratio = len(toxic) / max(1, len(clean))
    likely = {x for x, n in bad.items() if good[x] * ratio <= 0.02 * n}
    left, out = [_stems(t) & likely for t in toxic], []
    count = Counter(x for d in left for x in d)
    while count:
        best = max(count, key=lambda x: (count[x], bad[x], len(x), x))
        if count[best] < few:
            break
        best = max((x for x in count if x.startswith(best) and bad[x] >= 0.8 * bad[best]), key=lambda x: (len(x), x))
        out.append(best)
        for d in left:
            if best in d:
                count.subtract(d)
                d.clear()
        count = +count
    # toxic words by themselves too, though others in the same documents explain them: those more frequent
    # than the one that chance alone would put into toxic documents only
    share, number, more = len(toxic) / max(1, len(toxic) + len(clean)), Counter(bad.values()), 0
    chance = {}
    for n in sorted(number, reverse=True):
        more += number[n]
        chance[n] = more * share**n
    words = sorted(likely)

    def whole(x: str) -> str:
        longer = takewhile(lambda y: y.startswith(x), words[bisect_left(words, x) :])
        return max((y for y in longer if bad[y] >= 0.8 * bad[x]), key=lambda y: (len(y), y))

    often = sorted({whole(x) for x in likely if bad[x] >= FEW and chance[bad[x]] < 1}, key=lambda x: (-bad[x], -len(x), x))
    passage = _of_passages([_stems(t) for t in toxic], often)
    for x in often:
        if x not in passage and not any(x.startswith(y) or y.startswith(x) for y in out):
            out.append(x)
    return out


def _of_passages(docs: list[set[str]], words: list[str]) -> set[str]:
    """Words that share nearly all their documents with more than ``PASSAGE`` others: those of copied text,
    which say nothing by themselves."""
    held = np.array([[x in d for d in docs] for x in words], np.float32).reshape(len(words), len(docs))
    size, out = held.sum(1), set()
    for k in range(0, len(words), 500):
        alike = held[k : k + 500] @ held.T >= 0.8 * np.maximum(size[k : k + 500, None], size)
        out.update(words[k + int(j)] for j in np.flatnonzero(alike.sum(1) > PASSAGE + 1))
    return out


def train(texts: list[str], labels: list[int], seed: int = 3) -> Model:
    """Fits on documents with labels 0 and 1. Without both labels every text gets the base rate."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, float)
    toxic, clean = ([t for t, z in zip(texts, labels, strict=True) if z == k] for k in (1, 0))
    landmarks = choose_landmarks(toxic, clean) if toxic and clean else []
    base = (len(toxic) + 1) / (len(texts) + 2)
    if not landmarks:
        return Model([], np.zeros((0, 0)), np.zeros(0), 0.0, 1.0, float(np.log(base / (1 - base))))
    kernel = Kernel(landmarks)

    def of(words: list[str]) -> Values:
        """One row a word: the largest values of its windows."""
        found = kernel.windows(words)
        key, inverse = np.unique(found.own[found.row] * kernel.count + found.mark, return_inverse=True)
        value = np.zeros(len(key))
        np.maximum.at(value, inverse, found.value)
        return Values(np.arange(len(words)), key // kernel.count, key % kernel.count, value)

    gram = of(landmarks).dense(kernel.count, 0, len(landmarks))
    value, vector = np.linalg.eigh((gram + gram.T) / 2 + 0.05 * np.eye(len(landmarks)))
    whiten = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T
    values = kernel.windows(texts)
    own = values.own
    spoilt = []  # landmarks with a character put in, as insults are disguised
    for x in landmarks:
        if x[0] == " ":
            continue
        for mark in "*.-_ ":
            at = int(rng.integers(1, len(x)))
            spoilt.append(x[:at] + mark + x[at:])
        spoilt.append(".".join(x))
    disguised = of(spoilt)
    weights = np.linalg.solve(whiten, np.ones(len(landmarks)))
    whole = values.largest() >= 0.98  # a landmark as it stands counts in toxic documents, whatever else they hold
    bias = 0.0
    for _ in range(4):
        margin = values.times(whiten @ weights)
        order = np.lexsort((-margin, own))
        rank = np.arange(len(order)) - np.searchsorted(own[order], own[order])
        positive = order[((rank == 0) | whole[order]) & (y[own[order]] > 0)]
        negative = order[(rank < 3) & (y[own[order]] == 0)]
        nothing = Values(np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        x = stacked([values.take(positive), disguised, values.take(negative), nothing])
        z = np.concatenate([np.ones(len(positive) + len(spoilt)), -np.ones(len(negative) + 1)])
        weights, bias = _squared_hinge(x, whiten, z)
    model = Model(landmarks, whiten, weights, bias, 1.0, 0.0)
    slope, offset = _platt(Scorer(model).margins(texts), y)
    return model._replace(slope=slope, offset=offset)


def _squared_hinge(x: Values, whiten: np.ndarray, y: np.ndarray, strength: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear SVM on whitened values with squared hinge and balanced classes by accelerated gradient steps."""
    count = len(whiten)
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    square = np.zeros((count + 1, count + 1))
    for k in range(0, len(y), 1000):
        a = np.hstack([x.dense(count, k, 1000) @ whiten, np.ones((len(y[k : k + 1000]), 1))])
        square += a.T @ (a * cost[k : k + 1000, None])
    w = v = np.zeros(count + 1)
    step = 1 / (2 * float(np.linalg.eigvalsh(square)[-1]) + strength)
    for k in range(400):
        slack = np.maximum(0, 1 - y * (x.times(whiten @ v[:-1]) + v[-1]))
        pull = cost * y * slack
        now = v - step * (-2 * np.append(x.transposed_times(pull, count) @ whiten, pull.sum()) + strength * np.append(v[:-1], 0))
        v = now + k / (k + 3) * (now - w)
        w = now
    return w[:-1], float(w[-1])


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic calibration by Newton steps, with softened targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * margin * margin).sum(), (w * margin).sum()], [(w * margin).sum(), w.sum()]]) + 1e-3 * np.eye(2)
        move = np.linalg.solve(h, g)
        a, b = a - float(np.clip(move[0], -2, 2)), b - float(np.clip(move[1], -2, 2))
    return max(a, 1e-3), b


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on labelled rows whose id isn't held out, at most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` of them:
    those with the least hashes of their ids, whatever the number of rows."""
    known = labels.where(F.col("toxic").isNotNull() & (crc_fold(F.col("doc_id")) != 0)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    chosen = None
    for value, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        part = known.where((F.col("toxic") > 0).cast("int") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = {r["doc_id"]: int(r["toxic"] > 0) for r in chosen.collect()}  # at most SAMPLE_TOXIC + SAMPLE_CLEAN
    wanted = docs.sparkSession.createDataFrame([(i, y) for i, y in ids.items()], "doc_id long, toxic int")
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(wanted), "doc_id").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([r["text"] or "" for r in rows], [r["toxic"] for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row, from the whole text and nothing else.

    Null and empty texts get the score of a text without any suspicious word; repeated rows give equal
    rows; an empty table gives none; other columns are ignored.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model)
        for b in batches(it, 200):
            values = scorer.scores([x or "" for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(values, pa.float64()), pa.array((values >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held.alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def scorer_of(model: Model) -> Scorer:
    """One per Python worker."""
    return worker_state("toxicity", (tuple(model.landmarks), model.weights.tobytes(), model.bias, model.slope, model.offset), lambda: Scorer(model))
