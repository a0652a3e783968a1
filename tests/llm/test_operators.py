"""Each operator against brute force or planted cases, and the same edge cases for all."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from scribewash.llm import chat_format, common, decontaminate, language_id, license_scan, quality_mil, quality_rules, queries
from scribewash.llm import sentencepiece_viterbi as spv
from scribewash.llm import simhash, suffix_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


def documents(spark, rows, lang="en"):
    """rows: (id, text). Further columns have names that operators use inside."""
    full = [(i, t, lang, "src0", None if t is None else len(t), "x", 1, b"z") for i, t in rows]
    return spark.createDataFrame(full, DOCS + ", fp string, block long, _b binary").coalesce(2)


def prose(rng, n, vocabulary=400):
    return " ".join("".join(rng.choice(["an", "the", "or", "ti", "re", "en"]) for _ in range(1 + rng.randrange(vocabulary) % 4)) for _ in range(n))


EDGES = [
    (None, "a null id"), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "same text here and there and everywhere for all of them to see"),
    (6, "same text here and there and everywhere for all of them to see"), (6, "same text here and there and everywhere for all of them to see"),
    (7, "日本語 ▁ \U0001f600 é\u0000"), (8, "lang word " * 9000),
]


# --- op6


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for k in range(64):
            votes[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * votes[k] > len(shingles)) if shingles else 0


def brute_components(fps, radius=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("cell_max", [48, 3])
def test_simhash_against_brute_force(spark, monkeypatch, cell_max):
    """With tiny cells the crowded path does the work."""
    monkeypatch.setattr(simhash, "CELL_MAX", cell_max)
    rng = random.Random(3)
    base = [prose(rng, 120) for _ in range(12)]
    rows = []
    for i in range(150):
        w = base[i % 12].split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        rows.append((i, " ".join(w)))
    rows += [(200, ""), (201, None), (202, "A b"), (203, "a  B")]
    got = {r.doc_id: r for r in simhash.simhash_groups(documents(spark, rows)).collect()}
    fps = [brute_fingerprint(t) for _, t in rows]
    assert [got[i].fingerprint for i, _ in rows] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i, _ in rows] == [rows[k][0] for k in brute_components(fps)]


def test_simhash_long_texts_are_whole(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    text = prose(random.Random(1), 3000)
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)
    assert simhash._fingerprints([text.encode(), b"", b"a b c"], 3).tolist() == [brute_fingerprint(x) for x in (text, "", "a b c")]


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(2)
    pairs = [(rng.getrandbits(64) - (1 << 63), rng.getrandbits(64) - (1 << 63)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a long, b long")
    e = [simhash.embedding(F.col(c)) for c in "ab"]
    for r in df.select("a", "b", F.bit_count(e[0].bitwiseXOR(e[1])).alias("bound")).collect():
        a, b = r.a & (1 << 64) - 1, r.b & (1 << 64) - 1
        manhattan = sum(abs((a >> k & 3).bit_count() - (b >> k & 3).bit_count()) for k in range(0, 64, 2))
        assert r.bound == manhattan <= (a ^ b).bit_count()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[501] == 500


# --- op8


def brute_cut(rows):
    """By id: n_bytes, n_removed, n_spans, kept. Rows in any order; ids may repeat."""
    first = {}
    data = [((1 << 63) - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        g = gone[: len(b)]
        spans = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        out.append((len(b), int(g.sum()), spans, np.frombuffer(b, np.uint8)[~g].tobytes()))
    return out


def passages(seed=5, n=60):
    rng = random.Random(seed)
    shared = [prose(rng, 30) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [prose(rng, rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            parts += [s[rng.randrange(60) : len(s) - rng.randrange(60)], prose(rng, rng.randrange(12))]
        rows.append((i, rng.choice(["", "é", "\n"]).join(parts)))
    rows += [(900, "ab" * 400), (901, "ab" * 300), (902, rows[3][1]), (903, None), (904, ""), (None, rows[4][1]), (905, "x" * 49), (906, "x" * 49)]
    return rows


@pytest.mark.parametrize("hot, block, piece, sort", [(2000, 4 << 20, 1 << 20, 1 << 18), (2, 900, 300, 64)])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, hot, block, piece, sort):
    """Tiny limits send everything through hot anchors, many blocks, pieces and sorts."""
    for name, v in (("HOT", hot), ("BLOCK_BYTES", block), ("PIECE", piece), ("SORT_BYTES", sort)):
        monkeypatch.setattr(suffix_dedup, name, v)
    rows = passages()
    got = suffix_dedup.suffix_dedup(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == Counter((i, *x) for (i, _), x in zip(rows, brute_cut(rows)))


def test_suffix_dedup_gathers_in_parts(spark, monkeypatch):
    for name, v in (("HOT", 6), ("BLOCK_BYTES", 9000), ("GATHER_BYTES", 700), ("SORT_BYTES", 200)):
        monkeypatch.setattr(suffix_dedup, name, v)
    rows = passages(seed=6)
    got = suffix_dedup.suffix_dedup(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == Counter((i, *x) for (i, _), x in zip(rows, brute_cut(rows)))


def test_suffix_dedup_messages_at_size():
    """10 GB of text: a message costs time whatever it holds, so there are far fewer than the 12 million of once."""
    asked, sorted_ = suffix_dedup._bucket_counts(10 << 30)
    blocks = (10 << 30) / suffix_dedup.BLOCK_BYTES
    assert blocks * asked < 1e6 and blocks * sorted_ < 2e6


def test_suffix_dedup_passage_of_many_documents_is_not_sent_by_windows():
    """A passage of 3000 documents: less is sent than its texts have, and equal segments once."""
    rng = random.Random(3)
    passage = prose(rng, 90).encode()[:300]
    texts = [rng.randbytes(20).hex().encode() + passage + rng.randbytes(20).hex().encode() for _ in range(3000)]
    rows = []
    for k in range(0, 3000, 250):
        some = texts[k : k + 250]
        ids, lens = np.arange(k, k + 250).astype("<i8").tobytes(), np.array([len(t) for t in some], "<i8").tobytes()
        rows.append({"block": k, "n_bytes": sum(map(len, some)), "ids": ids, "lens": lens, "body": suffix_dedup._press(b"".join(some))})
    asked = pd.concat([b.to_pandas() for b in suffix_dedup._ask(4)(iter([pa.RecordBatch.from_pylist(rows)]))])
    marks = pd.concat([suffix_dedup._mark(g) for _, g in asked.groupby("bucket")])
    for row in rows:
        row["marks"] = marks[marks["block"] == row["block"]][["bucket", "marks"]].to_dict("records")
    sent = pd.concat([b.to_pandas() for b in suffix_dedup._send(4)(iter([pa.RecordBatch.from_pylist(rows)]))])
    n_bytes = sum(len(suffix_dedup._unpress(b)) for b in sent["bytes"])
    assert 12 * len(passage) < n_bytes < sum(map(len, texts))


def test_suffix_array():
    rng = random.Random(4)
    for _ in range(200):
        x = np.array([rng.randint(1, rng.choice([1, 2, 6, 1 << 22])) for _ in range(rng.randint(0, 50))], np.int64)
        assert suffix_dedup.suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def test_suffix_dedup_equal_ids_keep_their_bytes(spark):
    got = suffix_dedup.suffix_dedup(documents(spark, [(1, "q" * 80), (1, "q" * 80)])).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_suffix_dedup_texts_stay_valid(spark):
    text = "é" * 60
    got = suffix_dedup.suffix_dedup(documents(spark, [(1, text), (2, "e" + text + "日")]), keep=["doc_id", "lang"], as_text=True).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [text, "e日"] and got[0].lang == "en"


# --- op3


def test_viterbi_against_brute_force():
    vocabulary = spv.Vocabulary.load(spv.DEFAULT_MODEL)
    encoder, table = spv.Encoder(vocabulary), vocabulary.bytes_of()
    scores = {p: (s, i) for p, s, i in vocabulary.pieces}

    def brute(c):
        best, back = [0.0] + [-1e301] * len(c), [None] * (len(c) + 1)
        for j in range(1, len(c) + 1):
            for k in range(min(j, 20), 0, -1):
                if (hit := scores.get(c[j - k : j])) and best[j - k] + hit[0] > best[j]:
                    best[j], back[j] = best[j - k] + hit[0], (k, [hit[1]])
            if c[j - 1] not in scores and best[j - 1] + encoder.unknown > best[j]:
                best[j], back[j] = best[j - 1] + encoder.unknown, (1, [vocabulary.byte_ids[x] for x in c[j - 1].encode()])
        out, at = [], len(c)
        while at:
            k, ids = back[at]
            out, at = ids + out, at - k
        return out

    rng = random.Random(0)
    for _ in range(600):
        t = "".join(rng.choice(["a", "the", "▁", " ", "  ", "\n", "é", "日", "\U0001f600", "ing", "Z", " un", "\x00"]) for _ in range(rng.randrange(25)))
        ids = np.frombuffer(encoder.encode(t), np.int32).tolist()
        assert ids == (brute(" " + t) if t else [])
        assert spv.decode_ids(ids, table).decode() == t


def test_encode_then_decode(spark):
    rows = [(i, t) for i, (_, t) in enumerate(EDGES)]
    encoded = spv.encode(documents(spark, rows))
    assert {r.doc_id: r.text for r in spv.decode(encoded).collect()} == dict(rows)
    digest = {r.doc_id: r for r in spv.encode_digest(documents(spark, rows)).collect()}
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    for i, t in rows:
        if t is None:
            assert digest[i].n_pieces is None and ids[i] is None
        else:
            assert digest[i].round_trip and digest[i].n_pieces == len(ids[i])
            assert digest[i].ids_sha256 == hashlib.sha256(np.array(ids[i], "<i4").tobytes()).hexdigest()


# --- op7


def brute_counts(text):
    b = (text or "").encode()
    words = b.split()
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dup = set(), 0
    for line in b.split(b"\n"):
        if line.split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in b"#*$%&|<>" for c in b), dup, len(repeated)


def test_quality_counts_against_brute_force(spark):
    rng = random.Random(8)
    rows = list(enumerate(t for _, t in EDGES))
    rows += [(100 + i, "\n".join(rng.choice(["a b c", "a  b", "", " ", "x # | y", "é ü"]) for _ in range(rng.randrange(30)))) for i in range(60)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(documents(spark, rows)).collect()}
    for i, t in rows:
        c = brute_counts(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0])
        assert not (r.base_failed and r.kept)


def test_outliers_are_rejected_clean_documents_kept(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 80 + rng.randrange(300), 4000)) for i in range(300)]
    rows += [(1000 + i, " ".join(w + "$$$" for w in prose(rng, 150).split())) for i in range(20)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(documents(spark, rows)).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(20))


def test_each_statistic_alone_rejects(spark):
    rng = random.Random(15)
    clean = [prose(rng, 150 + rng.randrange(150), 4000) for _ in range(300)]
    words = [t.split() for t in clean[:6]]
    planted = [
        "\n".join(x for i in range(0, 144, 3) for x in (" ".join(words[0][i : i + 3]), "and")),  # repeated lines
        " ".join(words[1][:80] + 8 * (words[1][80:88])),  # repeated words
        " ".join(w + "$$$" for w in words[2]), " ".join(words[3]).upper(),
        " ".join(w * 6 for w in words[4]), prose(rng, 20000, 4000),
    ]
    got = {r.doc_id: r for r in quality_rules.quality_rules(documents(spark, list(enumerate(clean + planted)))).collect()}
    assert all(got[i].kept for i in range(300))
    assert [i for i in range(300, 306) if got[i].kept or (i < 305 and got[i].base_failed)] == []
    assert got[300].n_repeat_words == 0 and got[301].n_dup_lines == 0


def test_chi_square():
    assert abs(quality_rules.chi2_quantile(0.95, 6) - 12.5916) < 1e-3


# --- op9


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chats_round_trip(spark):
    texts = ["", None, "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "<\\|im_sep|>", "<\\\\|x", "a|b <| c", "日本\n"]
    rows = [(1, i, ("user", "assistant", "assistant", "sys\\n\ntem", None)[i % 5], t) for i, t in enumerate(texts)]
    rows += [(2, 0, "user", "a"), (2, 0, "user", "a"), (2, None, "assistant", "first"), (None, 1, "user", "n")]
    out = chat_format.format_chats(chats(spark, rows).withColumn("_t", F.lit(1)))
    read = {r.conv_id: [(t.role, t.text) for t in r.r] for r in out.select("conv_id", chat_format.read_back(F.col("formatted")).alias("r")).collect()}
    assert read[1] == [(r or "", t or "") for _, _, r, t in rows[:8]]
    assert read[2] == [("assistant", "first"), ("user", "a"), ("user", "a")]
    assert read[None] == [("user", "n")]
    one = {r.conv_id: r for r in out.collect()}
    assert one[2].formatted.count("<|im_start|>") == 2 and one[2].formatted.count("<|im_sep|>") == 1
    assert "".join(s.text for s in one[1].segments) == one[1].formatted
    digest = {r.conv_id: r for r in chat_format.chat_digest(out).collect()}
    learnt = "".join(t or "" for _, _, r, t in rows[:8] if r == "assistant")
    assert digest[1].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest() and digest[1].loss_chars == len(learnt)
    said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows[:8])
    assert digest[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and digest[1].n_turns == 8


def test_chats_stay_in_the_jvm(spark):
    plan = chat_format.chat_digest(chat_format.format_chats(chats(spark, [(1, 0, "user", "a")])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hash") == 1


# --- op1

ITEM = "The train leaves Paris at 9:30 with 120 people and travels 45 km to Lyon while another train with 80 people waits near the old station"


def found(spark, texts, items=((7, ITEM),)):
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.decontaminate(documents(spark, list(enumerate(texts))), bench).collect()}


def test_contamination(spark):
    rng = random.Random(1)
    other = ITEM.replace("Paris", "Rome").replace("120", "340").replace("45 km", "99 km").replace("80", "61").replace("Lyon", "Bari")
    mixed = ITEM.replace("120 people and", "5 people and").replace("80 people", "5 people").replace("45 km", "5 km").replace("9:30", "5")
    texts = [
        prose(rng, 50) + ". " + ITEM + ". " + prose(rng, 50), ITEM.upper().lower(), prose(rng, 90) + ". " + other, prose(rng, 100), None, "",
        " ".join(ITEM.split()[:10]), prose(rng, 20) + ". " + " ".join(ITEM.split()[5:22]), mixed,
    ]
    got = found(spark, texts)
    assert got[0, 7].kind == "exact" and got[2, 7].kind == "reparameterised" and got[2, 7].share >= 0.8
    assert (7, 7) in got and got[7, 7].run_tokens >= 13
    assert not {i for i, _ in got} & {3, 4, 5, 6, 8}


def test_short_items_and_empty_tables(spark):
    assert (0, 1) in found(spark, ["two words"], [(1, "two words")])
    assert found(spark, [], [(1, "two words")]) == {}
    assert found(spark, ["two words here now then"], [(1, None), (2, "")]) == {}


def test_other_places_do_not_veto_a_copy(spark):
    rng = random.Random(13)
    short = "the old mill by the river sold 12 sacks of the finest flour"
    variant = short.replace("12", "31")
    twice = "first we count 12 red balls here then we count 15 red balls here and stop"
    split = ITEM.replace("travels", "then travels")
    foreign = " we sold 77 sacks of the"  # a chance hit of the windows around a slot
    texts = [
        prose(rng, 30) + " . " + short + " . " + prose(rng, 30) + foreign + " finest grain",
        prose(rng, 30) + " . " + short + " . " + prose(rng, 30) + " . " + variant,
        prose(rng, 30) + " . " + twice,
        prose(rng, 30) + " . " + split + " . " + prose(rng, 30) + " . " + ITEM.replace("120", "7").replace("80", "7").replace("45", "7").replace("9:30", "7"),
        prose(rng, 30) + " . " + short.replace("12", "31") + foreign,
    ]
    got = found(spark, texts, [(7, ITEM), (8, short), (9, twice)])
    assert set(got) == {(0, 8), (1, 8), (2, 9), (3, 7), (4, 8)}
    assert {k: r.kind for k, r in got.items()} == {(0, 8): "exact", (1, 8): "exact", (2, 9): "exact", (3, 7): "exact", (4, 8): "reparameterised"}


def test_short_and_slot_heavy_items_inside_documents(spark):
    rng = random.Random(14)
    items = [(1, "two words"), (2, "Berlin hosts old museums"), (3, "Where did Anna buy the bread"), (4, "12 km 30 Anna 45 Bob 7"), (5, "1999")]
    around = lambda x: "\n".join([prose(rng, 15).replace(".", ""), x, prose(rng, 15)])
    got = found(spark, [around(t) for _, t in items] + [around("12 km 30 Anna 46 Bob 8"), around("two sharp words")], items)
    assert set(got) == {(i, item) for i, (item, _) in enumerate(items)}


# --- op2, op4, op10: held-out accuracy


def _held(spark, name, label):
    rows = queries.queries()[name](spark, SF.replace("0.01", "0.1")).join(spark.read.parquet(f"{SF.replace('0.01', '0.1')}/labels.parquet"), "doc_id").where("held_out")
    y, s = zip(*[(r[label], r.score) for r in rows.collect()])
    y, order = np.array(y), np.argsort(np.argsort(s))
    n1 = (y == 1).sum()
    return (order[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (y == 0).sum())


def test_toxicity_held_out(spark):
    assert _held(spark, "op2_toxicity_weak_supervision", "toxic") > 0.97


def test_quality_held_out(spark):
    assert _held(spark, "op4_quality_attention_mil", "quality") > 0.98


def test_language_held_out(spark):
    got = queries.queries()["op10_language_string_kernels"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1))).first()
    assert r[0] > 0.98 and r[1] > 100


def test_folds(spark):
    df = spark.createDataFrame([(i,) for i in [*range(50), None]], "i long")
    got = {r.i: r.f for r in df.select("i", common.crc_mod("i", 4).alias("f")).collect()}
    assert all(got[i] == zlib.crc32(str(i).encode()) % 4 for i in range(50)) and got[None] == -1


def test_mil_gradient():
    rng = np.random.default_rng(0)
    m = quality_mil.Model(np.zeros(5), np.ones(5), {"E": rng.normal(size=(5, 4)), "e": rng.normal(size=4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)), "w": rng.normal(size=3), "c": rng.normal(size=4), "b": np.zeros(1)})
    x, starts, y = rng.normal(size=(7, 5)), np.array([0, 2, 6]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = quality_mil._sigmoid(m.forward(x, starts)["s"])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = m.gradient(x, starts, y)
    for k, v in m.p.items():
        at = tuple(0 for _ in v.shape)
        v[at] += 1e-5
        up = loss()
        v[at] -= 2e-5
        down = loss()
        v[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6, k


def test_presence_against_brute_force():
    """Features by plain Python integers and slices of whole texts; parts of a long text overlap."""
    mask, bits = (1 << 32) - 1, language_id.HASH_BITS

    def code(gram):
        c = len(gram)
        for x in gram:
            c = ((c << 8) & mask) ^ (((c >> 24) * 0x01000193) & mask) ^ x
        return ((c * 0x9E3779B1) & mask) >> (32 - bits)

    lookup = np.arange(1 << bits)
    rng = random.Random(1)
    texts = [b"Hello world", b"", b"ab", "ÉÀ Straße İ".encode() * 9] + ["".join(rng.choices("abcÄé ", k=rng.randrange(60))).encode() for _ in range(40)]
    want = []
    for t in texts:
        low = t.decode().lower().encode()
        want.append({code(low[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(low) - n + 1)})
    for part in (language_id.PART_BYTES, 7):
        old, language_id.PART_BYTES = language_id.PART_BYTES, part
        try:
            assert [set(np.flatnonzero(r).tolist()) for r in language_id.presence(texts, lookup, 1 << bits)] == want
        finally:
            language_id.PART_BYTES = old


def test_ridge_against_the_kernel_matrix():
    """The scores by presence vectors are those of kernel ridge regression through the landmarks' kernel, from sets."""
    rng = random.Random(2)
    words = {"de": "und die der nicht mit", "en": "and the of not with", "fr": "et les des pas avec"}
    sample = [(y, " ".join(rng.choices(w.split(), k=12)).encode()) for y, w in sorted(words.items()) for _ in range(20)]
    model = language_id.fit(sample)
    grams = lambda t: {t[i : i + n] for n in language_id.NGRAMS for i in range(len(t) - n + 1)}
    kernel = lambda a, b: len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b)))
    marks = [t for _, t in sample]  # fewer than LANDMARKS of each language: all are
    k = np.array([[kernel(a, b) for b in marks] for a in marks])
    y = np.array([[1.0 if z == lang else -1.0 for lang in sorted(words)] for z, _ in sample])
    alpha = np.linalg.solve(k.T @ k + language_id.RIDGE * len(sample) * k + 1e-8 * np.eye(len(marks)), k.T @ y)
    queries = [b"und der mit die", b"the of and", b"les pas avec des et"]
    want = np.array([[kernel(t, m) for m in marks] for t in queries]) @ alpha
    assert np.abs(model.scores(queries) - want).max() < 0.02
    assert [model.languages[i] for i in want.argmax(axis=1)] == ["de", "en", "fr"]


def test_dirty_language_column(spark, monkeypatch):
    """Only the most frequent values are learned."""
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    rows = [(i, "the cat and the dog", "en") for i in range(30)] + [(100 + i, "der hund und die katze", "de") for i in range(30)]
    rows += [(200 + i, f"noise {i}", f"x{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.language_id(docs).collect()} == {"de", "en"}


def test_label_model_finds_the_accurate_voters():
    rng = np.random.default_rng(3)
    y = rng.random(600) < 0.3
    votes = np.stack([np.where(y & (rng.random(600) < 0.8), 1, 0), np.where(rng.random(600) < 0.3, 1, 0), np.where(~y, -1, 0)], axis=1).astype(float)
    post, odds, _ = toxicity.label_model(votes, np.full(600, -1), 0.3)
    assert ((post > 0.5) == y).mean() > 0.9 and odds[0] > 2 and abs(odds[1]) < 1


def test_label_model_sees_copies_of_a_voter():
    """A noisy voter said five times over counts as one: it does not outvote three independent good ones."""
    rng = np.random.default_rng(4)
    y = rng.random(3000) < 0.4
    good = [np.where(y, np.where(rng.random(3000) < 0.75, 1, 0), np.where(rng.random(3000) < 0.1, 1, 0)) for _ in range(3)]
    noisy = np.where(rng.random(3000) < 0.35, 1, 0)
    known = np.where(rng.random(3000) < 0.2, y, -1)
    post, odds, corr = toxicity.label_model(np.stack([*good, *[noisy] * 5], axis=1).astype(float), known, 0.4)
    assert corr[3, 4] > 0.99 and abs(corr[0, 1]) < 0.3
    assert ((post > 0.5) == y).mean() > 0.9 and min(odds[:3]) > 1 > max(odds[3:8])


def test_label_model_corrects_wrong_labels():
    """A tenth of the labels is wrong: the posterior is nearer to the truth than they are."""
    rng = np.random.default_rng(5)
    y = rng.random(3000) < 0.3
    good = [np.where(y, np.where(rng.random(3000) < 0.8, 1, 0), np.where(rng.random(3000) < 0.05, 1, 0)) for _ in range(4)]
    told = np.where(rng.random(3000) < 0.1, ~y, y).astype(int)
    post, odds, _ = toxicity.label_model(np.stack(good, axis=1).astype(float), told, 0.3)
    assert ((post > 0.5) == y).mean() > 0.97 and odds[-1] < 4


def test_hidden_labels_are_found(spark):
    """The posterior of rows whose label the model does not see."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    sample, _ = common.sample_by_labels(docs, labels, "doc_id", "text", "toxic", toxicity.PER_LABEL)
    rows = toxicity._kept_features(sample)
    voters = toxicity.Voters(rows)
    votes = np.array([voters.votes(f) for _, f in rows], float)
    y = np.array([v for v, _ in rows])
    hidden = np.arange(len(y)) % 2 == 0
    post, _, _ = toxicity.label_model(votes, np.where(hidden, -1, y), y.mean())
    assert ((post > 0.5) == y)[hidden].mean() > 0.93


# --- all


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("rows", [EDGES, []], ids=["edges", "no rows"])
def test_edge_cases(spark, rows):
    docs = documents(spark, rows, lang=None)
    labels = _labels(spark, [(None, None, None), (4, 1, 0), (5, None, 1), (5, 0, 1)] if rows else [])
    n = len(rows)
    for out in (toxicity.toxicity(docs, labels), quality_mil.quality_mil(docs, labels)):
        got = out.collect()
        assert len(got) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    got = language_id.language_id(docs).collect()
    assert len(got) == n and all(r.lang_pred == "und" for r in got)
    assert quality_rules.quality_rules(docs).count() == simhash.simhash_groups(docs).count() == suffix_dedup.suffix_dedup(docs).count() == n
    assert license_scan.license_scan(docs).count() == 0
    bench = spark.createDataFrame([(None, None), (1, ""), (2, "same text here and there and everywhere for all of them to see")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == ({5, 6} if rows else set())
    assert chat_format.format_chats(chats(spark, [])).count() == 0


def test_language_without_letters(spark):
    docs = documents(spark, [(i, "hello there my friend") for i in range(8)] + [(50, "123 !?"), (51, None), (52, "")])
    got = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    assert got[0].lang_pred == "en" and [got[i].lang_pred for i in (50, 51, 52)] == ["und"] * 3


# --- pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, prose(rng, 120 + rng.randrange(80), 4000)) for i in range(120)]
    shared = prose(rng, 40, 4000)
    rows += [(200 + i, prose(rng, 70, 4000) + " " + shared + " " + prose(rng, 70, 4000)) for i in range(6)]
    rows += [(300, rows[5][1]), (301, " ".join("$$$" + w for w in rows[6][1].split())), (302, "too short"), (303, rows[7][1] + ". " + ITEM), (304, None)]
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = [(i, t) for i, t in rows if i not in (301, 302, 304)]  # what the rules reject here
    groups = brute_components([brute_fingerprint(t) for _, t in kept])
    kept = [x for k, x in enumerate(kept) if groups[k] == k]
    assert 300 not in dict(kept)
    kept = [(i, c[3].decode("utf-8", "ignore")) for (i, _), c in zip(kept, brute_cut(kept))]
    assert any(shared not in t for i, t in kept if i > 200)
    kept = [(i, t) for i, t in kept if i != 303]
    vocabulary = spv.Vocabulary.load(spv.DEFAULT_MODEL)
    encoder = spv.Encoder(vocabulary)
    assert got == {i: np.frombuffer(encoder.encode(t), np.int32).tolist() for i, t in kept}


def test_pipeline_stages_return_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]


def test_salted_estimates_agree_with_broadcast_ones(spark, monkeypatch):
    rng = random.Random(10)
    docs = documents(spark, [(i, prose(rng, 60 + rng.randrange(200), 4000)) for i in range(130)])
    told = {r.doc_id: (r.kept, round(r.distance, 6)) for r in quality_rules.quality_rules(docs).collect()}
    monkeypatch.setattr(quality_rules, "MAX_BROADCAST_GROUPS", 0)
    assert {r.doc_id: (r.kept, round(r.distance, 6)) for r in quality_rules.quality_rules(docs).collect()} == told


def test_large_id_sets_are_joined_by_a_shuffle(spark, monkeypatch):
    docs = documents(spark, [(1, "a"), (2, "b"), (None, "c"), (2, "d")])
    ids = spark.createDataFrame([(2,), (None,)], "doc_id long")
    small = sorted(r.text for r in common.without_ids(docs, ids).collect())
    monkeypatch.setattr(common, "MAX_BROADCAST_IDS", 0)
    assert sorted(r.text for r in common.without_ids(docs, ids).collect()) == small == ["a", "c"]


def test_pipeline_stages_pass_any_column_through(spark):
    """Null, empty and repeated rows, an empty table, columns with the names that operators use inside."""
    names = ["kept", "n_removed", "n_bytes", "n_spans", "component_id", "fingerprint", "distance", "cut_kept", "gkey", "item", "share"]
    rows = [(i, prose(random.Random(i), 90, 4000), "en", "a", 1) for i in range(12)] + [(3, "", "en", "a", 0), (20, None, None, None, None), (None, "x", "en", "a", 1), (4, prose(random.Random(4), 90, 4000), "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", *[f"'{n}' AS {n}" for n in names]).coalesce(2)
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, "/root/testdata/sf0.001")
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
            assert all(r[n] == n for r in out.collect() for n in names)
        ids = corpus_pipeline.encode_pieces(spark, table, "/root/testdata/sf0.001").collect()
        assert len(ids) == table.count() and all((r.n_pieces == 0) == (not r.ids) for r in ids)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "yarn"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
