"""Toxicity by weak supervision.

Voters look at a text and say toxic or nothing: fixed lexicons, patterns (shouting, insults at a "you", letters
replaced by signs), and stems that the labelled fit rows show to be telling. The known labels are one more
voter, which says toxic, clean or, of a row without a label, nothing: its accuracy is estimated like that of
any other, so labels may be wrong or missing. A generative label model (expectation maximisation) estimates in
every round each voter's accuracy and, from what voters say together beyond what the label explains, their
correlations; correlated voters share their weight. A linear classifier over stems and the pattern votes is
trained on the posterior labels and scores every whole text.

Without the labels as a voter the estimate settles on the largest group of words that occur together (one
language's) and takes the others for noise: votes alone do not tell which words are toxic.

Fitting uses at most ``2 * PER_LABEL`` texts of each label, chosen by a hash of the text; scoring is one
pass without a shuffle. Stems are looked up in a table of the classifier's features, of bounded size.

Defined results: null and empty texts get the score of a text without any feature; without labels the
label model runs on the votes of an empty sample and the fixed lexicons alone decide; null ids and
repeated rows are ordinary rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_parts, crc_mod, sample_by_labels, utf8

PER_LABEL = 1500
MAX_STEMS, MAX_FEATURES = 48, 4096
STEM = (4, 5, 6, 7)
THRESHOLD = 0.3
#: Tokens that a task remembers.
CACHE_TOKENS = 200_000
#: Bytes of a text that are split at once.
PART_BYTES = 1 << 18
#: Log odds from which a voter counts as accurate.
MIN_ODDS = 1.5

# Words of each lexicon voter.
LEXICONS: dict[str, str] = {
    "insult": "idiot idiots moron morons imbecile stupid dumb dumbass fool loser losers clown jerk",
    "contempt": "trash garbage scum filth vermin worthless pathetic disgusting subhuman parasite parasites",
    "profanity": "fuck fucking fucked shit shitty bullshit asshole bastard bitch crap cunt dick",
    "threat": "kill murder hang exterminate lynch strangle stab",
    "french": "connard connasse salope imbécile crétin ordure abruti débile merde putain enculé",
    "german": "arschloch idioten trottel dummkopf scheiße scheisse hurensohn abschaum wichser drecksau",
    "spanish": "idiotas estúpido estupido imbécil pendejo cabrón mierda puta gilipollas basura escoria",
}
_SIGNS = bytes.maketrans(b"0134$@!", b"oieasai")
_EDGES = b"\"'()[]{}<>.,;:!?*#|&%-_/\\`~=+"
_WHOLE = {w.encode(): name for name, words in LEXICONS.items() for w in words.split()}
PATTERNS = ("shouting", "exclaiming", "at_you", "disguised")


def _stems(token: bytes) -> tuple[str, ...]:
    """The token's features: itself and its beginnings; a disguised lexicon word as a feature of its own."""
    core = token.strip(_EDGES)
    word = core.decode("utf-8", "replace").lower()
    out = ["=" + word] if word else []
    out += [word[:n] for n in STEM if len(word) >= n]
    plain = core.lower().translate(_SIGNS)
    if plain != core.lower() and plain in _WHOLE:
        out.append("~")
    return tuple(out)


def text_patterns(b: bytes, words: set[bytes]) -> dict[str, bool]:
    letters = sum(map(b.count, (b"E", b"A", b"N", b"I")))
    small = sum(map(b.count, (b"e", b"a", b"n", b"i")))
    return {
        "shouting": letters > 20 and letters > 2 * small,
        "exclaiming": b.count(b"!!") >= 3,
        "at_you": any(p in b for p in (b"you are a ", b"You are a ", b"you're a ", b"you idiot", b"du bist ein", b"tu es un")) and bool(words),
    }


def features(b: bytes) -> set[str]:
    words = set(b.split())
    out = {s for w in words for s in _stems(w)}
    return out | {f"?{k}" for k, v in text_patterns(b, words).items() if v}


class Voters:
    """Each voter: a set of features any of which makes it say toxic."""

    def __init__(self, sample: list[tuple[int, set[str]]]):
        self.sets: list[frozenset[str]] = [frozenset("=" + w for w in words.split()) for words in LEXICONS.values()]
        self.sets += [frozenset({"~"}), *[frozenset({f"?{p}"}) for p in PATTERNS[:3]]]
        toxic = [f for y, f in sample if y]
        clean = Counter(s for y, f in sample if not y for s in f)
        n_clean = max(1, sum(1 for y, _ in sample if not y))
        seen = Counter(s for f in toxic for s in f)

        def worth(s: str) -> float:
            p, q = (seen[s] + 0.5) / (len(toxic) + 1), (clean[s] + 0.5) / (n_clean + 1)
            return math.log(p / q)

        telling = [s for s in seen if seen[s] >= max(4, 0.004 * len(toxic)) and worth(s) > 2.5 and s[0] not in "?~"]
        known = set(telling)
        left = [f & known for f in toxic]
        for _ in range(MAX_STEMS):  # each next stem covers the most toxic texts that none yet covers
            gain = Counter(s for f in left for s in f)
            if not gain or gain.most_common(1)[0][1] < 3:
                break
            best = min(gain, key=lambda s: (-gain[s] - 1e-3 * worth(s), s))
            self.sets.append(frozenset({best}))
            left = [f for f in left if best not in f]

    def votes(self, f: set[str]) -> list[int]:
        """1 toxic, 0 nothing."""
        return [1 if not s.isdisjoint(f) else 0 for s in self.sets]


def label_model(votes: np.ndarray, known: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of toxic for every row, log odds that each voter's "toxic" speaks for, correlations of the voters).

    ``votes``: 1 toxic, -1 clean, 0 nothing. ``known`` (1, 0, or -1 for unknown) is the last voter, and starts
    the estimate. Every round estimates what each voter says of toxic and of clean rows, the correlations of
    the voters within the classes, and from both the posterior: the voters' log ratios, each divided by how many
    voters it stands for (the sum of its positive correlations, itself included).
    """
    votes = np.column_stack([votes, np.where(known == 1, 1.0, np.where(known == 0, -1.0, 0.0))])
    n, m = votes.shape
    if not n:
        return np.zeros(0), np.zeros(m), np.eye(m)
    post = np.where(known >= 0, np.clip(known, 0.02, 0.95), np.where((votes > 0).any(axis=1), 0.7, 0.2 * prior))
    spoke = {v: (votes == v).astype(float) for v in (-1, 0, 1)}
    weight, odds, corr = np.ones(m), np.zeros(m), np.eye(m)
    for _ in range(rounds):
        ratio = np.zeros((n, m))
        for v, x in spoke.items():
            toxic = (x.T @ post + 0.5) / (post.sum() + 1.5)
            clean = (x.T @ (1 - post) + 0.5) / ((1 - post).sum() + 1.5)
            ratio += x * np.log(toxic / clean)
            if v == 1:
                odds = np.log(toxic / clean)
        means = [(votes.T @ p) / max(p.sum(), 1e-9) for p in (post, 1 - post)]
        rest = votes - np.outer(post, means[0]) - np.outer(1 - post, means[1])
        cov = rest.T @ rest / n + 1e-9 * np.eye(m)
        d = np.sqrt(np.diag(cov))
        corr = cov / np.outer(d, d)
        shared = np.where(corr < 0.1, 0, np.minimum(corr, 1))  # less is noise of a sample
        weight = 0.5 * weight + 0.5 / np.maximum(shared.sum(axis=1), 1)
        logit = math.log(prior / (1 - prior)) + ratio @ weight
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post, odds, corr


def train_linear(rows: list[set[str]], target: np.ndarray, epochs: int = 300) -> tuple[dict[str, float], float]:
    """Logistic regression of soft labels on presence features: (weights, bias). Full-batch Adam, L2."""
    df = Counter(s for f in rows for s in f)
    n = len(rows)
    if not n:
        return {}, 0.0
    total = target.sum()
    mass = Counter()
    for f, t in zip(rows, target.tolist()):
        for s in f:
            mass[s] += t
    gain = {s: abs(mass[s] - c * total / n) / math.sqrt(c) for s, c in df.items() if c >= 3}
    names = sorted(gain, key=lambda s: (-gain[s], s))[:MAX_FEATURES]
    at = {s: i for i, s in enumerate(names)}
    pairs = [(r, i) for r, f in enumerate(rows) for s in f if (i := at.get(s)) is not None]
    r_, c_ = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    w, b = np.zeros(len(names)), math.log((total + 0.5) / (n - total + 0.5))
    m, v, mb, vb = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    for k in range(1, epochs + 1):
        z = b + np.bincount(r_, weights=w[c_], minlength=n)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        gw, gb = np.bincount(c_, weights=g[r_], minlength=len(names)) + 3e-5 * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        b -= 0.05 * (mb / (1 - 0.9**k)) / (math.sqrt(vb / (1 - 0.999**k)) + 1e-8)
    return {s: float(w[i]) for s, i in at.items() if abs(w[i]) > 0.02}, float(b)


def with_votes(f: set[str], strong: frozenset[str]) -> set[str]:
    """Adds what the accurate voters say together: one word of theirs, several words."""
    n = len(f & strong)
    return f | ({"#one"} if n else set()) | ({"#more"} if n > 1 else set())


class Model:
    """strong: the features of the voters that the label model found accurate."""

    def __init__(self, weights: dict[str, float], bias: float, strong: frozenset[str] = frozenset()):
        self.weights, self.bias, self.strong = weights, bias, strong

    def scorer(self):
        """A function text -> score with a bounded memory of tokens."""
        weights, bias, strong = self.weights, self.bias, self.strong
        wanted = weights.keys() | strong
        cache: dict[bytes, tuple[str, ...]] = {}

        def score(b: bytes) -> float:
            words: set[bytes] = set()  # of a long text, part by part, the distinct ones only
            for part in byte_parts(b, PART_BYTES):
                words.update(part.split())
            found: set[str] = set()
            for w in words:
                hit = cache.get(w)
                if hit is None:
                    hit = tuple(s for s in _stems(w) if s in wanted)
                    if len(cache) >= CACHE_TOKENS:
                        cache.clear()
                    if len(w) <= 64:
                        cache[w] = hit
                if hit:
                    found.update(hit)
            found.update(k for p, v in text_patterns(b, words).items() if v and (k := f"?{p}") in wanted)
            z = bias + math.fsum(weights[s] for s in with_votes(found, strong) if s in weights)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def _kept_features(sample: list[tuple[int, bytes]]) -> list[tuple[int, set[str]]]:
    """Features of the sample, one string each in memory; those of one or two texts can decide nothing and go,
    but for the fixed voters'."""
    count = Counter(s for _, t in sample for s in features(t))
    fixed = {f"={w.decode()}" for w in _WHOLE}
    held = {s: s for s, c in count.items() if c >= 3 or s in fixed or s[0] in "?~"}
    del count
    return [(int(y), {held[s] for s in features(t) if s in held}) for y, t in sample]


def fit(sample: list[tuple[int, bytes]], prior: float) -> Model:
    rows = _kept_features(sample)
    voters = Voters(rows)
    votes = np.array([voters.votes(f) for _, f in rows], float).reshape(len(rows), len(voters.sets))
    labels = np.array([y for y, _ in rows], int)
    share = min(0.95, max(0.02, labels.mean() if len(rows) else 0.1))
    post, odds, _ = label_model(votes, labels, share)
    strong = frozenset().union(*[v for v, o in zip(voters.sets, odds[:-1].tolist()) if o > MIN_ODDS])
    if not rows:
        return Model({s: 4.0 for v in voters.sets[: len(LEXICONS)] for s in v}, -3.0)
    weights, bias = train_linear([with_votes(f, strong) for _, f in rows], post)
    # The sample holds the labels in other shares than the corpus.
    return Model(weights, bias + math.log(prior / (1 - prior)) - math.log(share / (1 - share)), strong)


def score_texts(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            out = pa.array([score(x.as_py()) for x in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("_b"))
    return rows.mapInArrow(run, "doc_id long, score double").withColumnRenamed("doc_id", doc_id)


def toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 4, held_out: int = 2
) -> DataFrame:
    """(id, held_out, score, predicted): learnt from labelled rows outside the held-out fold of crc32(id)."""
    fold = crc_mod(doc_id, folds)
    sample, counts = sample_by_labels(docs, labels.where(fold != held_out), doc_id, text, label, PER_LABEL)
    prior = min(0.98, max(0.02, counts.get(1, 0) / max(1, sum(counts.values()))))
    out = score_texts(docs, fit(sample, prior), doc_id, text)
    return out.select(doc_id, (fold == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
