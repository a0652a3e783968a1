"""Decontamination against plain loops, recall on planted variants, long texts in parts."""

import random
import re
from collections import defaultdict

import pytest

from scribewash.llm import decontaminate as d
from test_operators import documents, found, prose

EDGES = "\"'()[]{}<>.,;:!?*#|&$-_/\\`~=+"
UNITS = {u.decode() for u in d.UNITS}


def brute_kinds(tokens):
    """The template of each token, "#", "@" or "^" for number, unit, name."""
    out = []
    for i, t in enumerate(tokens):
        core = t.strip(EDGES) or t
        if re.fullmatch(r"\d[\d.,:/]*%?", core):
            out.append("#")
        elif core.lower() in UNITS and i and out[i - 1] == "#":
            out.append("@")
        elif re.fullmatch(r"\d[\d.,]*[A-Za-z]+", core) and re.sub(r"[\d.,]", "", core).lower() in UNITS:
            out.append("@")
        elif core[:1].isupper() and not (len(core) > 1 and core.isupper()) and core.lower() not in UNITS:
            out.append("^")
        else:
            out.append(core.lower())
    return out


def brute_windows(tokens, w, exact):
    kinds = brute_kinds(tokens) if not exact else [(t.strip(EDGES) or t).lower() for t in tokens]
    out = []
    for i in range(len(tokens) - w + 1):
        k = kinds[i : i + w]
        slots = [] if exact else [tokens[i + j].strip(EDGES) for j in range(w) if k[j] in "#@^"]
        if exact or w - len(slots) >= min(2, w):
            out.append((i, tuple(k), slots))
    return out


def brute_report(doc, item):
    """(share, kind) of the best alignment of an item in a document, or None."""
    words, of_item = doc.split(), item.split()
    if not of_item:
        return None
    w = min(5, len(of_item))
    exact = not brute_windows(of_item, w, False)
    mine = brute_windows(of_item, w, exact)
    hits = [(at, i, a, b) for i, k, a in mine for at, l, b in brute_windows(words, w, exact) if k == l]
    lines = defaultdict(list)
    for h in hits:
        lines[h[0] - h[1]].append(h)

    def runs(rows):
        rows, out = sorted(rows, key=lambda h: h[1]), []
        for h in rows:
            if out and h[1] == out[-1][-1][1] + 1:
                out[-1].append(h)
            else:
                out.append([h])
        return out

    longest = max((len(r) for rows in lines.values() for r in runs(rows)), default=0) + 4
    ways = [(hits, longest)]
    for rows in lines.values():
        ways.append((rows, max(map(len, runs(rows))) + 4))
        ways += [(r, len(r) + 4) for r in runs(rows)]
        ways += [(r, len(r) + 4) for r in runs([h for h in rows if h[2] == h[3]])]
    for centre in range(min(lines, default=0) - 4, max(lines, default=0) + 5):
        picked = []
        for i, _, _ in mine:
            near = [(abs(h[0] - h[1] - centre), h) for h in hits if h[1] == i and abs(h[0] - h[1] - centre) <= 4]
            picked += [h for away, h in near if away == min(near)[0]]
        if picked:
            ways.append((picked, max(len(r) for rows in lines.values() for r in runs(rows) if any(h in picked for h in r)) + 4))
    best = None
    for rows, run in ways:
        pairs = {p for h in rows for p in zip(h[2], h[3])}
        consistency = min(len({a for a, _ in pairs}), len({b for _, b in pairs})) / len(pairs) if pairs else 1.0
        share = len({h[1] for h in rows}) / len(mine)
        if rows and (share >= 0.8 or run >= 13) and consistency >= 0.8:
            told = (share, consistency, all(a == b for a, b in pairs))
            best = max(best, told) if best else told
    return best and (round(best[0], 6), "exact" if best[2] else "reparameterised")


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "train", "in", "has", "red", "old", "Anna", "Bob", "Rome", "12", "7", "45", "km", "s", "of", "sold", "Paris", "with"]
    items = [" ".join(rng.choices(words, k=rng.randrange(1, 24))) for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = rng.choices(words, k=rng.randrange(30))
        for _ in range(rng.randrange(3)):
            t = rng.choice(items).split()
            if rng.random() < 0.5:
                new = {x: rng.choice(["3", "88"]) for x in ("12", "7", "45")} | {"Anna": rng.choice(["Eva", "Tom"]), "Rome": "Oslo"}
                t = [new.get(x, x) for x in t]
            if t and rng.random() < 0.4:
                t.insert(rng.randrange(len(t)), rng.choice(words))
            parts += t[rng.randrange(3) :] + rng.choices(words, k=rng.randrange(6))
        texts.append(" ".join(parts))
    return texts, items


@pytest.mark.parametrize("part", [1 << 18, 24])
def test_against_brute_force(spark, monkeypatch, part):
    """With tiny parts every window stands at the edge of one."""
    monkeypatch.setattr(d, "PART_BYTES", part)
    monkeypatch.setattr(d, "PART_TOKENS", 40 if part < 100 else 1 << 16)
    for seed in (1, 2):
        texts, items = corpus(seed)
        want = {(i, j): r for i, t in enumerate(texts) for j, x in enumerate(items) if (r := brute_report(t, x))}
        got = {k: (round(r.share, 6), r.kind) for k, r in found(spark, texts, list(enumerate(items))).items()}
        assert set(got) == set(want) and sum(got[k] == want[k] for k in want) >= 0.98 * len(want)
        assert len(want) > 30


QUESTIONS = (
    "{n} bought {a} apples and {b} pears at the market in {c}. {n} gave {b} of the apples to {m}. How many apples does {n} have left?",
    "The distance from {c} to {k} is {a} km. {m} drives {b} km every hour. How long does {m} need for the way from {c} to {k}?",
    "{m} is {a} years old. In {b} years {m} will be twice as old as {n} is today. How old is {n} today?",
    "In {c} there are {a} schools with {b} teachers each. How many teachers work in {c} if {n} counts them all?",
)


def test_recall_on_planted_variants(spark):
    rng = random.Random(8)
    names, towns = ["Anna", "Bruno", "Clara", "David", "Emma", "Felix"], ["Berlin", "Porto", "Lyon", "Oslo", "Turin"]

    def fill(q):
        n, m = rng.sample(names, 2)
        c, k = rng.sample(towns, 2)
        a, b = rng.sample(range(2, 400), 2)
        return q.format(n=n, m=m, c=c, k=k, a=a, b=b)

    items = [(j, fill(q)) for j, q in enumerate(QUESTIONS)]
    texts, truth = [], set()
    for i in range(80):
        j = i % len(QUESTIONS)
        around = lambda: prose(rng, rng.randrange(20, 200)) + rng.choice([". ", "\n", " 17 km to Bern "])
        copies = [fill(QUESTIONS[j])] + ([items[j][1]] if i % 5 == 0 else []) + ([fill(QUESTIONS[j])] if i % 7 == 0 else [])
        texts.append(around() + around().join(copies) + " " + around())
        truth.add((i, j))
    texts += [prose(rng, 20000) + " " + fill(QUESTIONS[0]) + " " + prose(rng, 3000)] + [prose(rng, 300) + " Anna bought 3 apples in Berlin. " for _ in range(20)]
    truth.add((80, 0))
    got = set(found(spark, texts, items))
    assert len(got & truth) >= 0.9 * len(truth) and (80, 0) in got and not got - truth


def test_clashing_columns_and_ties(spark):
    text = "seven old men walked to the river and sold 12 fish in the town"
    docs = documents(spark, [(1, text), (1, text), (None, text), (2, None)]).selectExpr("*", "1 AS at", "2 AS h", "3 AS item", "4 AS line")
    bench = spark.createDataFrame([(5, text, 1), (6, text, 2), (7, None, 3)], "item_id long, text string, doc_id long")
    assert sorted((str(r.doc_id), r.item_id) for r in d.decontaminate(docs, bench).collect()) == [("1", 5), ("1", 6), ("None", 5), ("None", 6)]
