"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine over sentences.

The kernel of two words sums over shared character subsequences of length `ORDER`, each weighted by
DECAY to the length it spans in both, so insertions and gaps lower it only step by step. The kernel of a sentence and a
landmark is the sum over its words, and over its runs of short neighbouring tokens joined, so that a word written with spaces or line
breaks is seen; values of a word under FLOOR count as 0.

Landmarks are fragments that mark toxic texts beyond chance, so wrong labels don't make landmarks of their own, and the
words of clean texts that come nearest to them. Labels are those of whole texts, so training is multiple-instance: a clean
text's sentences are all negative, of a toxic text those are positive that the machine takes for toxic, one at least. A squared-hinge machine over
the Nystroem map of sentence rows, begun at the sentences near a fragment, is trained until these sentences stay the same. Near
copies of a toxic text count once. Gapped and stretched forms of the words that mark toxic texts are added as
positive sentences. A logistic curve over the TOP largest margins of a text's sentences, fitted on texts left aside, gives the score.

Training reads at most `TRAIN_TOXIC` + `TRAIN_CLEAN` labelled texts (those with the smallest
hash of their id); scoring reads every whole text, once, with no shuffle.

Defined cases: null or empty texts score as a text without toxic words; words longer than
`PIECE` are scored in overlapping pieces, sentences beyond SENTENCE words in parts; repeated rows and rows of one id are scored each, as are
rows without an id; null labels are not used; an id with both labels counts as either; ties go to the alphabetically first;
with no labelled texts of either class, or nothing that tells them apart, every score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icspark.llm.common import Held, free_name, give_back, small_batches

ORDER, DECAY, PIECE = 3, 0.6, 24
#: Bound of the labelled sample, by class.
TRAIN_TOXIC, TRAIN_CLEAN = 1200, 4000
#: Landmarks at most: fragments of toxic words, and clean words near them.
FRAGMENTS, HARD = 24, 16
#: Kernel values below it count as 0; words of a sentence at most; rounds of the machine at most; sentences that make a text's score.
FLOOR, SENTENCE, ROUNDS, TOP = 0.5, 64, 6, 3
#: Kernel with a fragment at which a sentence of a toxic text is positive to begin with.
NEAR = 0.7
#: Share of clean texts that a fragment may stand in, against its share of toxic ones.
IMPURE = 0.2
#: Chance that some fragment marks toxic texts without meaning to.
CHANCE = 0.01
#: Most letters of a token that is also joined with its neighbours.
SHORT = 3
#: Tokens that a worker knows the margins of, in each of two generations.
KNOWN_TOKENS = 150_000
#: Tokens with signs that a worker remembers without them.
KNOWN_EDGED = 50_000
_EDGE, _INNER = re.compile(r"^[\W_]+|[\W_]+$"), re.compile(r"[\W_]+")


class Edged(dict):
    """Tokens without signs at their ends, found once."""

    def __missing__(self, token: str) -> str:
        if len(self) > KNOWN_EDGED:
            self.clear()
        value = self[token] = _EDGE.sub("", token)
        return value


_edged = Edged()


def pieces(word: str) -> list[str]:
    """A long word as overlapping pieces."""
    if len(word) <= PIECE:
        return [word]
    return [word[k : k + PIECE] for k in range(0, len(word) - PIECE // 2, PIECE // 2)]


class Kernel:
    """Gap-weighted subsequence kernel of many words against fixed landmarks, in vector steps."""

    def __init__(self, landmarks: list[str], order: int = ORDER, decay: float = DECAY):
        self.order, self.decay, self.landmarks = order, decay, landmarks
        self.codes = np.array(sorted({c for w in landmarks for c in w}))
        self.index = {c: k for k, c in enumerate(self.codes.tolist())}
        width = max(map(len, landmarks), default=1)
        self.table = np.full((len(landmarks), width), -1, np.int32)
        for k, w in enumerate(landmarks):
            self.table[k, : len(w)] = [self.index[c] for c in w]
        # onehot[place, letter, landmark]
        self.onehot = (self.table.T[:, None] == np.arange(len(self.codes))[None, :, None]).astype(np.float32)
        self.own = np.sqrt(np.maximum(self_kernel(landmarks, order, decay), 1e-30)).astype(np.float32)
        spans = np.array([math.comb(x - 2, order - 2) * decay ** (2 * x) if x >= order else 0 for x in range(PIECE + 1)])
        #: Of a word by its length, the least that its own kernel can be.
        self.least_own = np.array([sum((n - x + 1) * spans[x] for x in range(order, n + 1)) for n in range(PIECE + 1)])
        # the subsequences of each landmark in turn, as pairs of neighbouring letters, with their normalised weights
        pairs: dict[tuple[int, int], int] = {}
        steps, weights, self.begins = [], [], []
        for k, w in enumerate(landmarks):
            weigh: dict[tuple[int, ...], float] = {}
            for at in itertools.combinations(range(len(w)), order):
                u = tuple(self.index[w[x]] for x in at)
                weigh[u] = weigh.get(u, 0) + decay ** (at[-1] - at[0] + 1)
            self.begins.append(len(steps))
            for u, x in weigh.items() or [((0,) * order, 0.0)]:
                steps.append([pairs.setdefault(p, len(pairs)) for p in itertools.pairwise(u)])
                weights.append(decay * x / self.own[k])
        self.steps, self.pairs, self.weights = np.array(steps, np.int64), np.array(list(pairs), np.int64), np.array(weights, np.float32)

    def may_reach(self, words: list[str], least: float) -> np.ndarray:
        """False only for words whose normalised kernel with every landmark is below `least`.

        A subsequence weighs in a word at most the product of what its pairs of neighbouring letters weigh, summed over their places;
        the word's own kernel is at least what its subsequences make if all differ.
        """
        out = np.zeros(len(words), bool)
        letters = np.array([ord(c) for c in self.codes.tolist()], np.uint32)
        n_letters, lam = len(letters), np.float32(self.decay)
        for part, code in padded(words, self.order):
            n, size = code.shape
            at = np.minimum(np.searchsorted(letters, code), n_letters - 1)
            known = np.where(letters[at] == code, at, n_letters)  # the last stands for letters of no landmark
            rows, before, met = np.arange(n), np.zeros((n, n_letters + 1), np.float32), np.zeros((n, n_letters + 1, n_letters + 1), np.float32)
            for s in range(size):
                met[rows, known[:, s]] += before
                before[rows, known[:, s]] += 1
                before *= lam
            near = np.ascontiguousarray(met[:, self.pairs[:, 1], self.pairs[:, 0]].T)
            held = near[self.steps[:, 0]]
            for k in range(1, self.steps.shape[1]):
                held *= near[self.steps[:, k]]
            held *= self.weights[:, None]
            most = np.add.reduceat(held, self.begins, axis=0).max(0)
            out[part] = most >= (least - 1e-3) * np.sqrt(self.least_own[(code != 0).sum(1)])
        return out

    def __call__(self, words: list[str]) -> np.ndarray:
        """Normalised kernel, words by landmarks."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        letters = np.array([ord(c) for c in self.codes.tolist()], np.uint32)
        for part, code in padded(words, self.order):
            at = np.minimum(np.searchsorted(letters, code), len(letters) - 1)
            known = np.where(letters[at] == code, at, -1)
            own = np.sqrt(np.maximum(_self_block(code, self.order, self.decay), 1e-30))
            out[part] = self._block(known) / own[:, None] / self.own[None]
        return out

    def _block(self, code: np.ndarray) -> np.ndarray:
        """code: words by places, -1 for letters of no landmark and after a word's end, which change nothing. Arrays run place of the landmark first."""
        n, size = code.shape
        m, width = self.table.shape
        lam, lam2 = np.float32(self.decay), np.float32(self.decay**2)
        onehot = np.concatenate([self.onehot, np.zeros((width, 1, m), np.float32)], 1)  # the last row for letters of no landmark
        prime = [np.ones((width + 1, n, m), np.float32)] + [np.zeros((width + 1, n, m), np.float32) for _ in range(self.order - 1)]
        total = np.zeros((n, m), np.float32)
        for s in range(size):
            same = onehot[:, code[:, s]]
            total += lam2 * (same * prime[self.order - 1][:width]).sum(0)
            for i in range(self.order - 1, 0, -1):
                step = same if i == 1 else same * prime[i - 1][:width]
                fresh, run = prime[i], np.zeros((n, m), np.float32)
                fresh *= lam
                for t in range(width):
                    run *= lam
                    run += step[t]
                    fresh[t + 1] += lam2 * run
        return total


def padded(words: list[str], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, code points by place, 0 after a word's end) of words of `least` letters or more, those of like length together, 512 at most."""
    by_size: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        if len(w) >= least:
            by_size.setdefault(-(-len(w) // 4) * 4, []).append(k)
    for size, where in by_size.items():
        for a in range(0, len(where), 512):
            part = where[a : a + 512]
            text = "".join([words[k].replace("\0", " ").ljust(size, "\0") for k in part])
            yield np.array(part), np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), size)


def self_kernel(words: list[str], order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Kernel of each word with itself."""
    out = np.zeros(len(words))
    for part, code in padded(words, order):
        out[part] = _self_block(code, order, decay)
    return out


def _self_block(code: np.ndarray, order: int, decay: float) -> np.ndarray:
    """code: words by places, 0 after a word's end."""
    n, size = code.shape
    lam, lam2 = decay, decay**2
    same = ((code[:, :, None] == code[:, None, :]) & (code[:, :, None] != 0)).astype(np.float64)
    prime = [np.ones((n, size + 1))] + [np.zeros((n, size + 1)) for _ in range(order - 1)]
    total = np.zeros(n)
    for s in range(size):
        total += lam2 * (same[:, s] * prime[order - 1][:, :size]).sum(1)
        for i in range(order - 1, 0, -1):
            step = lam2 * same[:, s] * prime[i - 1][:, :size]
            run = np.zeros(n)
            prime[i] *= lam
            for t in range(size):
                run = lam * run + step[:, t]
                prime[i][:, t + 1] += run
    return total


def mark(word: str) -> str:
    """The word between marks of its begin and end, which take part in subsequences."""
    return f"^{word}$"


def tokens_of(text: str | None) -> tuple[list[str], list[tuple[int, str]]]:
    """White-space separated tokens, and each run of two or more tokens of one to SHORT letters, joined, with the place where it begins."""
    tokens, runs, run, begun = (text or "").lower().split(), [], [], 0
    for k, x in enumerate(tokens):
        if len(x) > SHORT and x.isalnum():  # most tokens
            if not run:
                continue
            w = x
        else:
            w = x if x.isalnum() else _edged[x]
        if len(w) > SHORT:
            if len(run) > 1:
                runs.append((begun, "".join(run)))
            run = []
        elif w:
            if not run:
                begun = k
            run.append(w)
    if len(run) > 1:
        runs.append((begun, "".join(run)))
    return tokens, runs


def sentences_of(tokens: list[str], places: list[int]) -> list[tuple[int, int]]:
    """The sentence of each of some places in order; a token that ends in . ! or ? ends one, and it ends after SENTENCE tokens."""
    ends = [k for k, x in enumerate(tokens) if x[-1] in ".!?"]
    out = []
    for k in places:
        n = bisect_left(ends, k)
        out.append((n, (k - (ends[n - 1] + 1 if n else 0)) // SENTENCE))
    return out


def bare(token: str) -> str:
    """The token without signs at its ends and, among single letters, between them: `i.d.i.o.t` is `idiot`."""
    if token.isalnum():
        return token
    word = _edged[token]
    if not word.isalnum() and len(word) > 2:
        letters = _INNER.sub("", word)
        if 2 * len(letters) <= len(word) + 1 or len(word) - len(letters) == 1:
            return letters
    return word


def words_of(text: str | None) -> list[str]:
    """The different words of a text, marked; a word that differs by signs around it may stand twice."""
    tokens, runs = tokens_of(text)
    return [mark(w) for x in {*tokens, *(r for _, r in runs)} if (w := bare(x))]


@dataclass
class Model:
    """Landmarks: fragments and hard clean words; the machine's weights over a sentence's kernel row; slopes by place of a margin, and shift, of the logistic curve."""

    fragments: list[str]
    hard: list[str]
    weights: np.ndarray
    bias: float
    slopes: np.ndarray
    shift: float

    def score(self, margins: np.ndarray) -> np.ndarray:
        """margins: texts by TOP."""
        return 1 / (1 + np.exp(-np.clip(margins @ self.slopes + self.shift, -40, 40)))


class Rows:
    """Kernel rows of words against landmarks, floored; row 0 is that of words near no fragment. Hard words are compared with words near fragments only."""

    def __init__(self, fragments: list[str], hard: list[str]):
        self.first, self.second = Kernel(fragments), Kernel(hard) if hard else None
        self.rows, self.size = np.zeros((1024, len(fragments) + len(hard)), np.float32), 1

    def _of(self, kernel: Kernel, words: list[str]) -> np.ndarray:
        once: dict[str, int] = {}  # long runs repeat their pieces
        flat, first = [], []
        for w in words:
            first.append(len(flat))
            flat += [once.setdefault(x, len(once)) for x in pieces(w)]
        every = list(once)
        go = np.flatnonzero(kernel.may_reach(every, FLOOR))  # the others are 0 by the floor
        values = np.zeros((len(every), len(kernel.landmarks)), np.float32)
        values[go] = kernel([every[k] for k in go.tolist()])
        made = np.maximum.reduceat(values[flat], first) if flat else np.empty((0, len(kernel.landmarks)), np.float32)
        made[made < FLOOR] = 0
        return made

    def add(self, words: list[str]) -> np.ndarray:
        """Places of the rows of marked words."""
        at = np.zeros(len(words), np.int64)
        for k in range(0, len(words), 20_000):
            part = words[k : k + 20_000]
            made = self._of(self.first, part)
            near = np.flatnonzero(made.any(1))
            made = made[near]
            if self.second:
                made = np.hstack([made, self._of(self.second, [part[x] for x in near])])
            while self.size + len(near) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.size : self.size + len(near)] = made
            at[k + near] = np.arange(self.size, self.size + len(near))
            self.size += len(near)
        return at


def pooled(tokens: list[str], runs: list[tuple[int, str]], place: dict[str, int], rows: np.ndarray) -> np.ndarray:
    """Rows of the sentences that hold a word near a fragment: the sums over their words, a joined run among them where it begins."""
    near = [(k, r) for k, x in enumerate(tokens) if (r := place[x])]
    joined = [(k, r) for k, x in runs if (r := place[x])]
    near = sorted(near + joined) if joined else near
    if not near:
        return np.empty((0, rows.shape[1]), np.float32)
    sentences = sentences_of(tokens, [k for k, _ in near])
    starts = [k for k in range(len(near)) if not k or sentences[k] != sentences[k - 1]]
    return np.add.reduceat(rows[[r for _, r in near]], starts)


def largest(rows: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """The TOP largest margins of a text's sentences, in order; sentences near no fragment, and missing ones, have the bias."""
    margins = np.full(TOP, bias)
    if len(rows):
        values = np.sort(np.concatenate([rows @ weights + bias, margins]))[::-1]
        margins = values[:TOP]
    return margins


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Squared-hinge linear support vector machine, by Newton steps on the active rows. y: 1 or -1."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(z.shape[1]), None
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        active = y * (z @ w) < 1
        if keep is not None and (active == keep).all():
            break
        keep = active
        a, s = z[active], c * weight[active]
        w = np.linalg.solve(ridge + (a * s[:, None]).T @ a, (a * s[:, None]).T @ y[active])
    return w[:-1], float(w[-1])


def fragments(word: str) -> set[str]:
    """Stretches of four to eight characters of a marked word."""
    return {word[k : k + n] for n in range(4, 9) for k in range(len(word) - n + 1)}


def cover(vocabulary: list[str], bags: list[np.ndarray], labels: np.ndarray, most: int) -> list[str]:
    """Fragments that mark toxic texts beyond chance and hardly any clean one; each next one covers most texts not yet covered.

    bags: ids of the distinct words of each text, near copies of toxic ones once. Fragments are counted by hash, so only those of
    three texts or more (of n1 / 150 in large samples) are ever held as strings. A second pass adds other fragments, unlike those
    found, that mark many texts already covered.
    """
    n1 = max(int(labels.sum()), 1)
    n0 = max(len(labels) - n1, 1)
    seen = np.zeros(len(vocabulary), np.int64)
    for bag, y in zip(bags, labels):
        if not y:
            seen[bag] += 1
    rare = seen < 0.005 * n0
    mine = [(k, bag[rare[bag]]) for k, (bag, y) in enumerate(zip(bags, labels)) if y]
    of = lambda bag: set().union(*(fragments(vocabulary[w]) for w in bag.tolist()))
    digest = xxhash.xxh3_64_intdigest
    every = np.concatenate([np.empty(0, np.uint64), *(np.fromiter(map(digest, of(bag)), np.uint64) for _, bag in mine)])
    values, counts = np.unique(every, return_counts=True)
    often = set(values[counts >= max(3, n1 // 150)].tolist())
    n_values = len(values)
    del every, values, counts
    toxic: dict[str, set[int]] = {}
    for k, bag in mine:
        for f in of(bag):
            if digest(f) in often:
                toxic.setdefault(f, set()).add(k)
    toxic = {f: at for f, at in toxic.items() if len(at) >= 3}
    clean: dict[str, int] = {}
    for w in np.flatnonzero(seen).tolist():
        for f in fragments(vocabulary[w]):
            if f in toxic:
                clean[f] = clean.get(f, 0) + int(seen[w])
    pure = {f: at for f, at in toxic.items() if clean.get(f, 0) / n0 < IMPURE * len(at) / n1 and _chance(len(at), (clean.get(f, 0) + 1) * n1 / n0) < CHANCE / max(n_values, 1)}
    out: list[str] = []
    for least in (3, max(3, n1 // 50)):
        left = {f: set(at) for f, at in pure.items() if not any(_alike(f, g) for g in out)}
        while left and len(out) < most:
            best = max(left, key=lambda f: (len(left[f]) - 3 * clean.get(f, 0) * n1 / n0, len(f), f))
            gone = left.pop(best)
            if len(gone) < least:
                if max(map(len, left.values()), default=0) < least:
                    break
                continue
            out.append(best)
            left = {f: rest for f, at in left.items() if (rest := at - gone) and (least == 3 or not _alike(f, best))}
            if least > 3:
                left = {f: pure[f] for f in left}
    return out


def _chance(n: int, mean: float) -> float:
    """That a Poisson count of this mean is n or more."""
    term = math.exp(-mean + n * math.log(mean) - math.lgamma(n + 1))
    total, k = term, n
    while term > 1e-12 * total:
        k += 1
        term *= mean / k
        total += term
    return total


def unlike(bags: list[tuple[int, np.ndarray]], words: int = 8, least: int = 6) -> list[tuple[int, np.ndarray]]:
    """Bags without near copies of earlier ones, so that one copied text counts once: they share `least` of their `words` smallest-hash words."""
    seen: dict[int, set[int]] = {}
    out = []
    for k, bag in bags:
        first = sorted(bag.tolist(), key=lambda w: (w * 2654435761) % (1 << 32))[:words]
        shared: dict[int, int] = {}
        for w in first:
            for other in seen.get(w, ()):
                shared[other] = shared.get(other, 0) + 1
        if max(shared.values(), default=0) >= min(least, len(first)):
            continue
        out.append((k, bag))
        for w in first:
            seen.setdefault(w, set()).add(k)
    return out


def _alike(a: str, b: str) -> bool:
    """Whether two fragments share four characters in a row."""
    return a in b or b in a or any(a[k : k + 4] in b for k in range(len(a) - 3))


def loosened(word: str) -> list[str]:
    """The word with gaps and with inserted characters, as people write to slip past lists."""
    body = word.strip("^$")
    mid = len(body) // 2
    return [mark(x) for x in (".".join(body), "-".join(body), body[:mid] + "*" + body[mid:], body[:mid] + body[mid - 1] + body[mid:], body[:mid] + "x" + body[mid:])]


def fit(texts: list[str], labels: list[int]) -> Model | None:
    """Train on labelled texts. Deterministic: ties go to the alphabetically first word."""
    y_doc = np.array(labels, bool)
    if not len(y_doc) or y_doc.all() or not y_doc.any():
        return None
    ids: dict[str, int] = {}
    bags = [np.array(sorted({ids.setdefault(w, len(ids)) for w in sorted(words_of(t))}), np.int32) for t in texts]
    vocabulary = list(ids)
    # every fourth text is left for the logistic curve: its words are as new to the machine as those of other texts
    aside = np.arange(len(bags)) % 4 == 3
    if not (y_doc[aside].any() and y_doc[~aside].any() and not y_doc[~aside].all()):
        aside[:] = False
    held = aside if aside.any() else np.ones(len(bags), bool)
    once = {k for k, _ in unlike([(k, bags[k]) for k in np.flatnonzero(y_doc & ~aside).tolist()])}
    used = [k for k in np.flatnonzero(~aside).tolist() if not y_doc[k] or k in once]
    mine, y_mine = [bags[k] for k in used], y_doc[used]
    found = cover(vocabulary, mine, y_mine, FRAGMENTS)
    if not found:
        return None
    clean, strong = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    for bag, y in zip(mine, y_mine):
        (strong if y else clean)[bag] += 1
    order = sorted(range(len(vocabulary)), key=vocabulary.__getitem__)
    fragments = [m[:PIECE] for m in found]
    near = Rows(fragments, []).add(vocabulary) > 0
    tell = clean / max((~y_mine).sum(), 1) - strong / max(y_mine.sum(), 1)  # words near a fragment that are the clean texts'
    hard = [vocabulary[k][:PIECE] for k in sorted(order, key=lambda k: -tell[k])[: len(vocabulary)] if near[k] and tell[k] > 0][:HARD]
    rows = Rows(fragments, hard)
    known = dict(zip([vocabulary[k] for k in np.flatnonzero(near)], rows.add([vocabulary[k] for k in np.flatnonzero(near)]).tolist()))
    landmarks = fragments + hard
    gram = Kernel(landmarks)(landmarks).astype(float)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    good = value > 1e-4
    root = vector[:, good] / np.sqrt(value[good])  # Nystroem map: kernel row @ root
    place = Tokens(lambda token: known.get(mark(w), 0) if (w := bare(token)) else 0)
    sentences = [pooled(*tokens_of(t), place, rows.rows) for t in texts]
    hit = [k for k in sorted(order, key=lambda k: -strong[k]) if strong[k] and not clean[k] and any(f in vocabulary[k] for f in found)]
    forms = [x for k in hit[:40] for x in loosened(vocabulary[k]) if not (x in ids and clean[ids[x]])]
    added = rows.rows[rows.add(forms)] if forms else np.empty((0, len(landmarks)), np.float32)
    nothing = np.zeros((1, len(landmarks)), np.float32)
    negative = [sentences[k] for k, y in zip(used, y_mine) if not y]
    x0, n0 = np.unique(np.concatenate([*negative, nothing]), axis=0, return_counts=True)
    weigh0 = n0.astype(float)
    weigh0[~x0.any(1)] += sum(not len(x) for x in negative)  # texts near no fragment
    bag_of = [np.concatenate([sentences[k], nothing]) for k, y in zip(used, y_mine) if y]
    near_of = [x[:, : len(found)].max(1) for x in bag_of]
    taken = [(x >= NEAR) | (np.arange(len(x)) == x.argmax()) for x in near_of]
    for _ in range(ROUNDS):
        x1 = np.concatenate([x[t] for x, t in zip(bag_of, taken)])
        share = np.concatenate([np.full(t.sum(), 1 / t.sum()) for t in taken])  # a text weighs 1
        x = np.concatenate([x1, added, x0]).astype(float) @ root
        y = np.r_[np.ones(len(x1) + len(added)), -np.ones(len(x0))]
        extra = np.full(len(added), 0.25 * len(bag_of) / max(len(added), 1))  # all added forms weigh a quarter of the texts
        weight = np.r_[share, extra, weigh0]
        weight /= np.where(y > 0, weight[y > 0].sum(), weight[y < 0].sum())
        w, bias = machine(x, y, weight * len(y))
        weights = (root @ w).astype(np.float32)
        margins = [x @ weights + bias for x in bag_of]
        now = [(m > 0) | (np.arange(len(m)) == m.argmax()) for m in margins]
        if all((a == b).all() for a, b in zip(now, taken)):
            break
        taken = now
    top = np.stack([largest(x, weights, bias) for x, use in zip(sentences, held) if use])
    return Model(fragments, hard, weights, bias, *_logistic(top, y_doc[held].astype(float)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """(slopes, shift) of a lightly smoothed logistic regression; no margin counts against toxicity."""
    use = np.arange(x.shape[1])
    while True:
        z = np.hstack([x[:, use], np.ones((len(x), 1))])
        ridge = np.r_[np.full(len(use), 0.1), 1e-6]
        w = np.zeros(z.shape[1])
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        if len(use) < 2 or (w[:-1] >= 0).all():
            break
        use = use[w[:-1] >= 0] if (w[:-1] >= 0).any() else use[:1]
    slopes = np.zeros(x.shape[1])
    slopes[use] = np.maximum(w[:-1], 0.1 if len(use) < 2 else 0)
    return slopes, float(w[-1])


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TRAIN_TOXIC, clean_rows: int = TRAIN_CLEAN) -> Model | None:
    """Fit on a bounded sample of labelled texts that are not held out."""
    marks = labels.where(~held_out() & F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") > 0).alias("y")).distinct()
    sample = [marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((True, toxic_rows), (False, clean_rows))]
    chosen = F.broadcast(sample[0].unionByName(sample[1]))  # at most toxic_rows + clean_rows rows
    rows = docs.select("doc_id", "text").where("text is not null").join(chosen, "doc_id").select("doc_id", "y", "text").distinct().collect()
    rows.sort(key=lambda r: (r["doc_id"], r["y"], r["text"]))
    texts, marks = [r["text"] for r in rows], [int(r["y"]) for r in rows]
    del rows
    model = fit(texts, marks)
    give_back()
    return model


class Tokens(dict):
    """Places of rows by token, found on demand."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, token: str) -> int:
        value = self[token] = self.find(token)
        return value


class Scorer(dict):
    """Place of the row of each token, 0 for one near no fragment; kept per worker in two generations, and new ones are taken in whole batches."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.rows, self.old = model, Rows(model.fragments, model.hard), {}

    def learn(self, tokens: set[str]) -> None:
        if len(self) > KNOWN_TOKENS:
            self.old = dict(self)
            self.clear()
        new = [t for t in tokens if t not in self]
        if self.old:
            self.update((t, self.old[t]) for t in new if t in self.old)
            new = [t for t in new if t not in self]
        if self.rows.size > KNOWN_TOKENS:  # rows of tokens long forgotten
            self.rows, self.old = Rows(self.model.fragments, self.model.hard), {}
            new = list(tokens)
            self.clear()
        stripped = [bare(t) for t in new]
        words = sorted({w for w in stripped if w})
        place = dict(zip(words, self.rows.add([mark(w) for w in words]).tolist()))
        self.update((t, place.get(w, 0)) for t, w in zip(new, stripped))

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """The TOP largest margins of the sentences of each text."""
        split = [tokens_of(t) for t in texts]
        self.learn({x for tokens, _ in split for x in tokens} | {r for _, runs in split for _, r in runs})
        return np.array([largest(pooled(*x, self, self.rows.rows), self.model.weights, self.model.bias) for x in split]).reshape(-1, TOP)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, score) of every row; with keep, all columns of docs and at the end `score`, or a free name like it."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs if keep else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = rows.columns
    at = names.index(text_col if keep else "text")
    from pyspark.sql import types as T

    last = free_name(docs, "score") if keep else "score"
    schema = T.StructType([f for f, n in zip(rows.schema.fields, names) if keep or n != "text"] + [T.StructField(last, T.DoubleType())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = None
        if model is not None:
            scorer = Held.get(("toxicity", tuple(model.fragments), model.bias), lambda: Scorer(model))
        for b in batches:
            scores = np.zeros(b.num_rows) if scorer is None else model.score(scorer.margins(b.column(at).to_pylist()))
            columns = [b.column(k) for k in range(len(names)) if keep or k != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=[f.name for f in schema.fields])

    return rows.mapInArrow(go, schema)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those that score `threshold` or more; null texts stay."""
    scored = score(docs, train(docs, labels), keep=True)
    return scored.where(f"`{scored.columns[-1]}` < {threshold}").select(*[f"`{c}`" for c in docs.columns])
