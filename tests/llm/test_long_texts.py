"""Whole texts of tens of MB in bounded memory, and scorers against plain loops."""

import math
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from scribewash.llm import quality_mil, toxicity

ROOT = str(Path(__file__).resolve().parents[2])
MB = 20
WORK = {
    "fingerprint": "from scribewash.llm.simhash import fingerprint as f; f(text)",
    "quality counts": "from scribewash.llm.quality_rules import text_counts as f; f(text)",
    "quality passages": "from scribewash.llm.quality_mil import passage_features as f; f(np.frombuffer(text, np.uint8))",
    "template windows": "from scribewash.llm import decontaminate as d; c = d.Canon(); seen = np.zeros(1 << d.FILTER_BITS, bool)\n"
    "for p in d.text_parts(0, text): list(d.document_windows(c, [p], [5], seen))",
    "toxicity": "from scribewash.llm import toxicity as t; t.Model({'=lorem': 1.0}, 0.0).scorer()(text)",
    "pieces": "from scribewash.llm import sentencepiece_viterbi as s; e = s.Encoder(s.Vocabulary.load(s.DEFAULT_MODEL)); t = text.decode()\n"
    "for _ in e.parts(t): pass",
    "language": "from scribewash.llm import language_id as l; l.presence([text], np.arange(1 << l.HASH_BITS), 1 << l.HASH_BITS)",
}


@pytest.mark.parametrize("name", WORK)
def test_one_long_text(name):
    """Peak memory over what the imports and an equal, short text take: at most fourteen times the text."""
    program = f"""
import resource, sys
sys.path.insert(0, {ROOT!r})
import numpy as np, random
rng = random.Random(1)
words = ["".join(rng.choices("abcdefgh ijkl", k=rng.randrange(1, 9))) for _ in range(5000)]
def peak():
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
def run(text):
    {WORK[name].replace(chr(10), chr(10) + '    ')}
run((" ".join(rng.choices(words, k=1000)) + "\\n").encode())
line = (" ".join(rng.choices(words, k=40000)) + "\\n").encode()
long = line * ({MB} * 1000000 // len(line))
before = peak()
run(long)
print(peak() - before)
"""
    out = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, timeout=240)
    assert out.returncode == 0, out.stderr[-800:]
    assert float(out.stdout) < 14 * MB


def test_passage_features_against_plain_loops(monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(quality_mil, "PART_PASSAGES", 2)
    q = quality_mil
    for n in (0, 1, 2, 17, 18, 512, 513, 1024, 1025, 3000):
        body = rng.integers(30, 60, n).astype(np.uint8)
        rows = []
        for p in range(max(1, -(-n // q.PASSAGE))):
            f = np.zeros(q.WIDTH)
            size = len(body[p * q.PASSAGE : (p + 1) * q.PASSAGE])
            for i in range(p * q.PASSAGE, p * q.PASSAGE + size):
                f[q.CLASS[body[i]]] += 1 / size
                if i:
                    f[q.N_CLASSES + 9 * q.COARSE[q.CLASS[body[i - 1]]] + q.COARSE[q.CLASS[body[i]]]] += 1 / size
                for k, lag in enumerate(q.LAGS):
                    if i >= lag and body[i] == body[i - lag]:
                        f[q.N_CLASSES + 81 + k] += 1 / size
            f = np.sqrt(f)
            f[-1] = math.log1p(size) / 8 if n else 0
            rows.append(f)
        assert np.abs(q.passage_features(body) - np.array(rows)).max() < 1e-5


def test_attention_scores_against_plain_loops():
    rng = np.random.default_rng(1)
    m = quality_mil.Model(rng.normal(size=5), np.ones(5) * 2, {"E": rng.normal(size=(5, 4)), "e": rng.normal(size=4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)), "w": rng.normal(size=3), "c": rng.normal(size=4), "b": np.ones(1)}, 0.3)
    bags = [rng.normal(size=(k, 5)) for k in (1, 3, 7)]
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    want = []
    for bag in bags:
        encoded, weight = [], []
        for x in bag:
            z = [(x[i] - m.mean[i]) / 2 for i in range(5)]
            h = [math.tanh(sum(z[i] * m.p["E"][i, j] for i in range(5)) + m.p["e"][j]) for j in range(4)]
            gate = [math.tanh(sum(h[i] * m.p["V"][i, j] for i in range(4))) * sigmoid(sum(h[i] * m.p["U"][i, j] for i in range(4))) for j in range(3)]
            encoded.append(h), weight.append(math.exp(sum(gate[j] * m.p["w"][j] for j in range(3))))
        r = [sum(w * h[j] for w, h in zip(weight, encoded)) / sum(weight) for j in range(4)]
        want.append(sigmoid(sum(r[j] * m.p["c"][j] for j in range(4)) + 1 + 0.3))
    assert np.allclose(m.scores(np.concatenate(bags), np.array([0, 1, 4])), want)


def test_toxicity_scores_against_plain_loops(monkeypatch):
    monkeypatch.setattr(toxicity, "PART_BYTES", 16)
    monkeypatch.setattr(toxicity, "CACHE_TOKENS", 3)
    weights = {"=idiot": 2.0, "idio": 0.5, "~": 1.5, "?exclaiming": 0.7, "#one": 0.3, "#more": 0.9, "=été": -1.0}
    strong = frozenset({"=idiot", "=trash", "~"})
    score = toxicity.Model(weights, -1.0, strong).scorer()
    for text in ("You idiot, TRASH!! !! !!!!", "1d10t! idiots été Été", "", "nothing here\tidio", "idiot " * 50):
        z, found = -1.0, set()
        for token in text.split():
            core = token.strip("\"'()[]{}<>.,;:!?*#|&%-_/\\`~=+")
            found |= {"=" + core.lower()} | {core.lower()[:n] for n in (4, 5, 6, 7) if len(core) >= n}
            plain = core.lower()
            for a, b in zip("0134$@!", "oieasai"):
                plain = plain.replace(a, b)
            if plain != core.lower() and any(plain in words.split() for words in toxicity.LEXICONS.values()):
                found.add("~")
        n = len(found & strong)
        found |= ({"?exclaiming"} if text.count("!!") >= 3 else set()) | ({"#one"} if n else set()) | ({"#more"} if n > 1 else set())
        z += sum(w for k, w in weights.items() if k in found)
        assert math.isclose(score(text.encode()), 1 / (1 + math.exp(-z)))
