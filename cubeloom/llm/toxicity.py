"""Toxicity by a string-kernel support vector machine with Nystroem landmarks.

The kernel counts the common subsequences of three letters of two strings, each weighed down by its length with gaps, so
that words with inserted or missing characters stay close to what they hide; it is scaled by the lengths of both strings
and taken to the fourth power, so that what few subsequences many words share stays small, and is a kernel still. Landmarks are strings that tell labelled
toxic texts from clean ones. Every word has its whole kernel values with all landmarks: the landmarks hold few different
subsequences, and a word's weight of each of these, times the landmarks' weights, is the kernel. A sentence is the
elementwise maximum of its words' values, whitened by the landmarks' own kernel matrix; a linear machine is trained on
labelled sentences (of a toxic text, the sentence that looks worst stands for the label and is chosen again between
fits). Some toxic texts have no such sentence, but words with certain stems far more often than clean texts do. Further
landmarks are such stems; a text's mean kernel value with each is what a second machine is trained on, with the toxic texts
that the first one misses. A text scores by its worst sentence or by its means, whichever is worse.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import combinations, compress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, in_task, small_batches

LENGTH, DECAY, POWER, PIECE = 3, 0.8, 4, 32
#: Bits of the table of first counts in training.
SEEN_BITS = 24
#: The weight in training of a hidden form of a landmark, of which there are a few, against that of a text.
HIDDEN = 10.0
#: Stems at most, their letters, and words that are added to a text's when a share of them is taken, so that few words say little.
STEMS, STEM_LETTERS, BESIDES = 24, (4, 5, 6, 7), 50
#: One clean text in so many may stand among the toxic ones.
MISTAKEN = 400
#: The power of a stem's kernel value: few words hold most of its subsequences and not the stem.
STEM_POWER = 8
NOT_LETTER = re.compile(r"[\W\d_]+")


def subsequence_kernel(s: list[str], t: list[str], n: int = LENGTH, decay: float = DECAY) -> np.ndarray:
    """K_n(s[i], t[i]): for all common subsequences of n letters, the sum of decay ** (both spans)."""
    if not s:
        return np.zeros(0)
    wide, tall = max(map(len, s)), max(map(len, t))
    a = np.zeros((len(s), wide), np.int32)
    b = np.full((len(s), tall), -1, np.int32)
    for i, (x, y) in enumerate(zip(s, t)):
        a[i, : len(x)] = [ord(c) for c in x]
        b[i, : len(y)] = [ord(c) for c in y]
    fall = np.tril(decay ** np.maximum(0, np.arange(tall)[:, None] - np.arange(tall)[None, :])).T  # from where a letter matched to where the prefix ends
    inner = [np.ones((len(s), tall + 1)) if i == 0 else np.zeros((len(s), tall + 1)) for i in range(n)]
    total = np.zeros(len(s))
    for k in range(wide):
        match = (a[:, k : k + 1] == b) & (a[:, k : k + 1] > 0)
        total += decay**2 * np.where(match, inner[n - 1][:, :-1], 0).sum(axis=1)
        for i in range(n - 1, 0, -1):
            inner[i][:, 1:] = decay * inner[i][:, 1:] + decay**2 * np.where(match, inner[i - 1][:, :-1], 0) @ fall
    return total


def _same(size: int) -> float:
    """What each subsequence of a string of this size has in common with itself."""
    return sum((size - k + 1) * (k - 2) * DECAY ** (2 * k) for k in range(LENGTH, size + 1)) or 1.0


SAME = np.sqrt([_same(n) for n in range(PIECE + 1)])


def scale(strings: list[str]) -> np.ndarray:
    return SAME[[len(s) for s in strings]] if strings else np.zeros(0)


class Landmarks:
    """The kernel of words with fixed strings, by the subsequences that these hold."""

    most_table = 2_000_000

    def __init__(self, strings: list[str], n: int = LENGTH, decay: float = DECAY) -> None:
        self.n, self.decay = n, decay
        letters = sorted(set("".join(strings)))
        self.letter = {c: i + 1 for i, c in enumerate(letters)}
        self.base = len(letters) + 1
        weights: dict[int, np.ndarray] = {}
        for j, s in enumerate(strings):
            codes = self._codes([s])
            for at in combinations(range(len(s)), n):
                row = weights.setdefault(int(self._code(codes[:, at])[0]), np.zeros(len(strings)))
                row[j] += decay ** (at[-1] - at[0] + 1)
        self.known = np.array(sorted(weights), np.int64)
        self.weights = np.array([np.zeros(len(strings)), *(weights[c] for c in sorted(weights))]).reshape(len(weights) + 1, len(strings))
        self.table = None
        if self.base**n <= self.most_table:
            self.table = np.zeros(self.base**n, np.int32)
            self.table[self.known] = np.arange(1, len(self.known) + 1)
        self.places: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _codes(self, words: list[str]) -> np.ndarray:
        """Numbers of letters, 0 for those of no landmark, of words of one length."""
        return np.array([[self.letter.get(c, 0) for c in w] for w in words], np.int64).reshape(len(words), -1)

    def _code(self, codes: np.ndarray) -> np.ndarray:
        """One number for the letters of each subsequence; a letter of no landmark makes it one that no landmark holds."""
        out = codes[:, 0]
        for k in range(1, self.n):
            out = out * self.base + codes[:, k]
        return np.where((codes == 0).any(axis=1), 0, out)

    def values(self, words: list[str]) -> np.ndarray:
        """K(word, landmark) for each word and landmark."""
        out = np.zeros((len(words), self.weights.shape[1]))
        by: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            by[len(w)].append(i)
        for size, rows in by.items():
            if size < self.n or not len(self.known):
                continue
            if size not in self.places:
                at = np.array(list(combinations(range(size), self.n)))
                self.places[size] = at, self.decay ** (at[:, -1] - at[:, 0] + 1.0)
            at, fall = self.places[size]
            step = max(1, 2_000_000 // len(at))
            for lo in range(0, len(rows), step):
                some = np.array(rows[lo : lo + step])
                codes = self._codes([words[i] for i in some])
                code = codes[:, at[:, 0]]
                ok = code > 0
                for k in range(1, self.n):
                    ok &= codes[:, at[:, k]] > 0
                    code = code * self.base + codes[:, at[:, k]]
                code = np.where(ok, code, 0)
                if self.table is not None:
                    place = self.table[code]
                else:
                    near = np.minimum(np.searchsorted(self.known, code), len(self.known) - 1)
                    place = np.where(self.known[near] == code, near + 1, 0)
                w, k = np.nonzero(place)
                part = self.weights[place[w, k]] * fall[k][:, None]
                ends = np.searchsorted(w, np.arange(len(some) + 1))
                sums = np.concatenate((np.zeros((1, out.shape[1])), np.cumsum(part, axis=0))) if len(w) else np.zeros((1, out.shape[1]))
                out[some] = sums[ends[1:]] - sums[ends[:-1]]
        return out


def words_of(text: str | None) -> list[str]:
    """Lower-case words; three or more single letters in a row are one word."""
    words = (text or "").lower().split()
    single = [i for i, w in enumerate(words) if len(w) == 1]
    if len(single) >= 3:
        at = np.array(single)
        for run in np.split(at, np.nonzero(np.diff(at) != 1)[0] + 1):
            if len(run) >= 3:
                words[run[0]] = "".join(words[run[0] : run[-1] + 1])
                words[run[0] + 1 : run[-1] + 1] = [""] * (len(run) - 1)
    return words


def _pieces(word: str) -> list[str]:
    letters = NOT_LETTER.sub("", word)
    return [letters] if len(letters) <= PIECE else [letters[i : i + PIECE] for i in range(0, len(letters) - PIECE // 2, PIECE // 2)]


@dataclass
class Model:
    landmarks: list[str] = field(default_factory=list)
    alpha: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    stems: int = 0  # the last landmarks
    gamma: np.ndarray = field(default_factory=lambda: np.zeros(2))
    base: float = -30.0

    def __post_init__(self) -> None:
        self.first = len(self.landmarks) - self.stems  # landmarks of sentences
        self.kernel = Landmarks(self.landmarks)
        own = subsequence_kernel(self.landmarks, self.landmarks)
        self.own, self.held = own / scale(self.landmarks), own[self.first :]
        self.known: dict[str, int] = {"": 0}
        self.rows = np.zeros((1, len(self.landmarks)), np.float32)

    def __reduce__(self):
        return Model, (self.landmarks, self.alpha, self.bias, self.slope, self.shift, self.stems, self.gamma, self.base)

    def values(self, words: list[str]) -> np.ndarray:
        """For each word and landmark the kernel, in parts of the landmark's own; of a word in pieces, the greatest."""
        pieces = [(i, p) for i, w in enumerate(words) for p in _pieces(w)]
        out = np.zeros((len(words), len(self.landmarks)))
        if pieces and self.landmarks:
            text = [p for _, p in pieces]
            k = self.kernel.values(text)
            value = (k / scale(text)[:, None] / self.own) ** POWER
            if self.stems:  # a stem counts for what a word holds of it, whatever else it holds
                value[:, self.first :] = np.minimum(1.0, k[:, self.first :] / self.held) ** STEM_POWER
            np.maximum.at(out, [i for i, _ in pieces], value)
        return out

    def learn(self, words: set[str], most: int = 200_000) -> None:
        """Keep the values of words not met yet, in bounded memory."""
        new = list(words.difference(self.known))
        if len(self.known) + len(new) > most:
            self.known, new = {"": 0}, list(words - {""})
        lo, hi = len(self.known), len(self.known) + len(new)
        if hi > len(self.rows):
            self.rows = np.concatenate((self.rows[:lo], np.zeros((max(2 * hi, 1000) - lo, len(self.landmarks)), np.float32)))
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            self.rows[lo + at : lo + at + len(some)] = self.values(some)
        self.known.update(zip(new, range(lo, hi)))

    def sentences(self, words: list[str]) -> np.ndarray:
        """A row of landmark values for each sentence."""
        if not words:
            return np.zeros((1, self.first), np.float32)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        ends = np.fromiter((w[-1:] in (".", "!", "?") for w in words), bool, len(words))
        starts = np.concatenate(([0], np.nonzero(ends[:-1])[0] + 1))
        return np.maximum.reduceat(self.rows[at, : self.first], starts, axis=0)

    def means(self, words: list[str]) -> np.ndarray:
        """The mean value of a text's words with the stem that they have most of, and how short the text is: what some words of a stem say falls with the length that they are found in."""
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return np.array([self.rows[at, self.first :].sum(axis=0, dtype=float).max(initial=0.0), BESIDES]) / (len(words) + BESIDES)

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """The log odds of a text by its worst sentence or, if it is worse, by its stems."""
        words = [words_of(x) for x in texts]
        fresh: set[str] = set()
        for w in words:
            fresh.update(w)
        self.learn(fresh)
        one = self.slope * (np.array([(self.sentences(w) @ self.alpha).max() for w in words]) + self.bias) + self.shift
        return np.maximum(one, np.array([self.means(w) @ self.gamma + self.base for w in words])) if self.stems else one

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts), -30, 30)))


def choose_landmarks(toxic: list[set[str]], clean: list[set[str]], most: int = 64) -> list[str]:
    """Strings of four to six letters, and words, that cover the toxic texts and few of the clean, chosen one by one."""
    common = set().union(*clean) if clean else set()

    def grams(words: set[str]) -> set[str]:
        out = set()
        for w in words:
            for p in _pieces(w):
                if len(p) >= 4:
                    out.add(p)
                    for n in (4, 5, 6):
                        out.update(p[i : i + n] for i in range(len(p) - n + 1))
        return out

    novel = [{w for w in t if w not in common} for t in toxic]
    least = 2 if len(toxic) < 200 else 4
    # first counts by hash, which are never too low, leave few strings to be counted themselves
    seen = np.zeros(1 << SEEN_BITS, np.uint16)
    placed = lambda strings: np.fromiter(map(hash, strings), np.int64, len(strings)) & ((1 << SEEN_BITS) - 1)
    for x in novel:
        own = np.unique(placed(grams(x)))
        seen[own] += seen[own] < 65_535
    times: Counter = Counter()
    for x in novel:
        some = list(grams(x))
        times.update(compress(some, seen[placed(some)] >= least))
    times = Counter({g: k for g, k in times.items() if k >= least})
    del seen
    against: Counter = Counter()
    for x in clean if times else ():
        against.update(grams(x) & times.keys())
    rate = len(toxic) / max(1, len(clean))
    good = {g for g in times if against[g] * rate <= 0.05 * times[g]}
    where = defaultdict(list)
    for i, x in enumerate(novel):
        for g in grams(x) & good:
            where[g].append(i)
    where = {g: np.array(v) for g, v in where.items()}
    weight, chosen = np.ones(len(toxic)), []

    def worth(g: str) -> tuple:
        return -round(weight[where[g]].sum() - 20 * rate * against[g], 6), -len(g), g

    heap = [worth(g) for g in where]  # gains only fall, so the first whose gain is of now is the best
    heapq.heapify(heap)
    while heap and len(chosen) < most:
        best = heapq.heappop(heap)
        now = worth(best[2])
        if now != best:
            heapq.heappush(heap, now)
            continue
        if -best[0] < least - 0.5:
            break
        chosen.append(best[2])
        weight[where[best[2]]] *= 0.25
    return chosen


def told_by_words(words: list[list[str]], y: np.ndarray, part: float = 0.03) -> set[int]:
    """The toxic texts with a word that no clean text has and that many toxic texts have."""
    letters = {w: NOT_LETTER.sub("", w) for w in {w for x in words for w in x}}
    clean = {letters[w] for x, k in zip(words, y) if not k for w in x}
    own = {i: {letters[w] for w in words[i]} - clean - {""} for i in np.nonzero(y)[0].tolist()}
    times = Counter(w for v in own.values() for w in v)
    told = {w for w, k in times.items() if k >= max(4, part * len(own))}
    return {i for i, v in own.items() if v & told}


def choose_stems(words: list[list[str]], y: np.ndarray, most: int = STEMS) -> tuple[list[str], set[int]]:
    """Strings of letters that clean texts have too, but nearly none in such a share of its words as toxic texts do, chosen one by one to cover the toxic texts; and the texts that they cover."""
    pieces: dict[str, tuple[str, ...]] = {}

    def grams(w: str) -> tuple[str, ...]:
        if w not in pieces:
            k = NOT_LETTER.sub("", w)
            pieces[w] = tuple({k[i : i + n] for n in STEM_LETTERS for i in range(len(k) - n + 1)}) if len(k) <= PIECE else ()
        return pieces[w]

    def counted(x: list[str], known: dict | None = None) -> Counter:
        out: Counter = Counter()
        for w, k in Counter(x).items():
            for g in grams(w):
                if known is None or g in known:
                    out[g] += k
        return out

    # near copies, which have the least hash of five words in common, count once
    alike = [min((zlib.crc32(" ".join(x[i : i + 5]).encode()) for i in range(max(1, len(x) - 4)))) for x in words]
    toxic = [x for x, k in zip(words, y) if k]
    often: Counter = Counter()  # toxic texts with a string at least three times
    for x in toxic:
        often.update(g for g, k in counted(x).items() if k >= 3)
    often = Counter({g: k for g, k in often.items() if k >= max(3, len(toxic) // 100)})
    shares: dict[str, list[tuple[float, int]]] = {g: [] for g in often}
    clean: dict[str, list[float]] = {g: [] for g in often}
    pieces.clear()
    for i, (x, label) in enumerate(zip(words, y)):
        for g, k in counted(x, often).items():
            if label:
                shares[g].append((k / (len(x) + BESIDES), i))
            else:
                clean[g].append(k / (len(x) + BESIDES))
    spare, rate = int((len(words) - len(toxic)) / MISTAKEN), len(toxic) / max(1, len(words) - len(toxic))  # clean texts that may be beyond
    shared = [g for g, v in clean.items() if len(v) * rate > 0.05 * len(shares[g])]  # others can be landmarks of sentences
    edge = {g: 1.1 * (sorted(clean[g])[-spare - 1] if len(clean[g]) > spare else 0.0) + 1e-3 for g in shared}
    beyond = {g: {i for s, i in shares[g] if s > edge[g]} for g in shared}
    covers = {g: {alike[i] for i in v} for g, v in beyond.items()}
    least = max(6.0, 4 + 4 * spare * rate)  # far more than chance puts beyond an edge that `spare` clean texts are beyond
    left, chosen = {i for c in covers.values() for i in c}, []
    all_covered: set[int] = set()
    while left and len(chosen) < most:
        best = max(covers, key=lambda g: (len(covers[g] & left), -edge[g], len(g), g))
        if len(covers[best] & left) < least:
            break
        chosen.append(best)
        left -= covers[best]
        all_covered |= beyond[best]
    return chosen, all_covered


def _odds(m: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the log odds of a margin, by Platt's fit."""
    a, b = 4.0, 0.0
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    aim = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - aim) * m).sum() + 0.01 * a, (p - aim).sum()])
        h = p * (1 - p)
        step = np.linalg.solve(np.array([[(h * m * m).sum() + 0.01, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-6]]), g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(a), float(b)


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps over the rows inside the margin."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.eye(len(w)) / cost
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        inside = np.nonzero(y * (x @ w[:-1] + w[-1]) < 1)[0]
        square, aim = ridge.copy(), np.zeros(len(w))
        for lo in range(0, len(inside), 20_000):
            some = inside[lo : lo + 20_000]
            a = np.hstack([x[some].astype(float), np.ones((len(some), 1))])
            c = a * weight[some, None]
            square += c.T @ a
            aim += c.T @ y[some]
        new = np.linalg.solve(square, aim)
        if np.allclose(new, w, atol=1e-9):
            break
        w = 0.5 * w + 0.5 * new
    return w[:-1], float(w[-1])


def gapped(word: str) -> list[str]:
    """The word with a letter doubled, with one inserted, and with one left out."""
    k = len(word) // 2
    return [word[:k] + word[k - 1 : k] + word[k:], word[:k] + "x" + word[k:], word[:k] + word[k + 1 :]]


def fit_sentences(words: list[list[str]], y: np.ndarray, apart: set[str] = frozenset(), rounds: int = 3) -> Model:
    """The landmarks, none of words set apart, and the machine of sentences."""
    letters: dict[str, str] = {}
    pool: dict[str, str] = {}  # equal strings are one
    for x in words:
        for w in x:
            if w not in letters:
                k = NOT_LETTER.sub("", w)
                letters[w] = pool.setdefault(k, k)
    distinct = [{letters[w] for w in x if w not in apart} for x in words]
    chosen = choose_landmarks([d for d, k in zip(distinct, y) if k], [d for d, k in zip(distinct, y) if not k])
    if not chosen:
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        return Model(shift=float(np.log(share / (1 - share))))
    model = Model(chosen)
    matrix = model.values(chosen)
    matrix = (matrix + matrix.T) / 2
    value, vector = np.linalg.eigh(matrix)
    white = vector @ np.diag(1 / np.sqrt(np.maximum(value, 0.05))) @ vector.T
    sentences = []
    for x in words:
        model.learn(set(x), 60_000)
        sentences.append(model.sentences(x))
    hidden = model.values([g for c in chosen for g in gapped(c)]).astype(np.float32)
    white = white.astype(np.float32)
    worth = [s.max(axis=1) for s in sentences]
    for _ in range(rounds):
        witness = [s[w.argmax()] for s, w, k in zip(sentences, worth, y) if k]
        clean = np.concatenate([s for s, k in zip(sentences, y) if not k] or [np.zeros((0, len(chosen)), np.float32)])
        x = np.vstack([np.array(witness, np.float32).reshape(-1, len(chosen)), hidden, clean])
        t = np.concatenate([np.ones(len(witness) + len(hidden)), -np.ones(len(clean))])
        c = np.ones(len(x))
        c[len(witness) : len(witness) + len(hidden)] = HIDDEN
        beta, bias = _machine(x @ white, t, c)
        model.alpha, model.bias = white @ beta, bias
        worth = [s @ model.alpha for s in sentences]
    # what is hidden alone in a text counts as one more toxic text, so that the score is not set by texts full of insults
    worst = np.array([w.max() for w in worth]) + model.bias
    a, b = _odds(np.concatenate((worst, hidden @ model.alpha + model.bias)), np.concatenate((y, np.ones(len(hidden)))))
    return Model(chosen, model.alpha, model.bias, a, b)  # without the words that were kept


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """Train on labelled texts: the stems first, then sentences on the toxic texts that stems do not cover. Without any text of one of the labels, the score is the share of the other."""
    y = np.array(labels, int)
    pool: dict[str, str] = {}  # equal words share one string
    words = [[pool.setdefault(w, w) for w in words_of(t)] for t in texts]
    plain = told_by_words(words, y)
    kept = [i for i in range(len(y)) if i not in plain]
    stems, some = choose_stems([words[i] for i in kept], y[kept])
    covered = {kept[i] for i in some}
    # a toxic text with some words of a stem is one of those too, and these words tell nothing of sentences
    held = {w for w in pool if any(s in w for s in stems)}
    covered |= {i for i in kept if y[i] and sum(w in held for w in words[i]) > 1}
    rest = [i for i in range(len(y)) if i not in covered]
    found = fit_sentences([words[i] for i in rest], y[rest], held)
    if not stems:
        return found
    gauge, means, label = Model(stems, stems=len(stems)), [], []
    for i, x in enumerate(words):
        if i in covered or not y[i]:
            gauge.learn(set(x), 60_000)
            means.append(gauge.means(x))
            label.append(int(y[i]))
    x, told = np.array(means), np.array(label)
    spread = np.maximum(x.std(axis=0), 1e-9)
    aim, ones = np.where(told == 1, 1.0, -1.0), np.ones(len(x))
    beta, bias = _machine(x / spread, aim, ones)
    # a clean text in MISTAKEN may be labelled wrongly: the ones that look worst do not pull the machine to themselves
    odd = np.argsort(np.where(told == 0, x / spread @ beta, -np.inf), kind="stable")[len(x) - int((told == 0).sum() / MISTAKEN) :]
    ones[odd] = 0
    beta, bias = _machine(x / spread, aim, ones)
    c, d = _odds((x / spread @ beta + bias)[ones > 0], told[ones > 0])
    return Model([*found.landmarks, *stems], found.alpha, found.bias, found.slope, found.shift, len(stems), c * beta / spread, c * bias + d)


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 1200, max_clean: int = 3000, max_bytes: int = 24 << 20) -> Model:
    """Fit on a bounded sample of labelled rows (the first by a hash of the id, of each label), never on those with crc32(doc_id) mod 5 of 0."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    first = own.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_toxic).unionByName(own.where("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_clean))
    some = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id")
    sizes = some.select("doc_id", "y", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_toxic + max_clean).collect()
    left, ids = {1: max_bytes // 2, 0: max_bytes // 2}, set()
    for r in sizes:
        if r["n"] <= left[r["y"]]:
            left[r["y"]] -= r["n"]
            ids.add(r["doc_id"])
    kept = first.where(F.col("doc_id").isin([])) if not ids else docs.sparkSession.createDataFrame([(i,) for i in sorted(ids)], docs.select("doc_id").schema)
    rows = docs.select("doc_id", "text").join(F.broadcast(kept.select("doc_id")), "doc_id").join(F.broadcast(first), "doc_id").select("doc_id", "y", "text").dropDuplicates(["doc_id"])

    def fitted(some: pd.DataFrame) -> Model:
        some = some.sort_values("doc_id")
        return fit([t if isinstance(t, str) else None for t in some["text"]], [int(y) for y in some["y"]])

    small_batches(docs.sparkSession)
    return in_task(rows, fitted)


def score_column(text: str | Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()))

    return scored(text)


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """docs with the column `into`: 0 to 1, higher where label 1 is likelier; a column of that name gives way.

    Null and empty texts score as texts whose words have nothing in common with any landmark. Words of more than 32 letters are read in overlapping
    pieces; the whole text counts. Other columns play no part; nulls and repeated rows stay. An empty table gives none.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(into, score_column("text", model))
